"""The trie of conversations against brute force: nulls, ties, repeated rows, long conversations, empty tables, clashing names."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from spindrift.llm import prefix_trie
from spindrift.llm.common import Scratch

SCHEMA = "conv_id long, turn long, role string, text string, conv long, pos long, turn_id string, depth int, key1 string, block int"


def conversations(seed: int):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 12), 100, *range(103, 112), 205, 206, -7, 300, *range(301, 330)]:
        n = rng.choice([1, 2, 3, 5, 9, 20]) if c != 104 else 75
        for t in range(n):
            text = rng.choice(["a", "b", "", None, "日本", "a, b"]) if c < 300 else "x" * (t % 3)
            rows.append((c, None if rng.random() < 0.05 else t // 2 if c == 3 else t, rng.choice(["user", "assistant", None]) if c < 300 else "user", text))
    rows += [rows[0], rows[5], rows[5], (None, 0, "user", "no conversation")]
    rows.append((2, 0, "user", "long " * 20_000))
    rng.shuffle(rows)
    return [(*r, 1, 2, "t", 3, "k", 4) for r in rows]


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    base = lambda c: int(c / 100) * 100
    return {c: own.get(base(c), [])[: h[c]] + v[h[c] :] for c, v in own.items()}


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, of in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(of) - 1) * (len(path[-1][1]) if path else 0)
    ends = lambda path: hashlib.sha256(",".join(str(c) for c in sorted(members[path]) if len(convs[c]) == len(path)).encode()).hexdigest()
    return {(min(of), len(p), min(members[p[:-1]]) if p else None, len(of), children[p], leaves[p], saved[p], ends(p)) for p, of in members.items()}


@pytest.mark.parametrize("seed,chunk", [(1, 10_000), (2, 2)])
def test_trie(spark, tmp_path, seed, chunk, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = conversations(seed)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = prefix_trie.op11_prefix_trie(spark, str(tmp_path)).collect()
    want = brute(rebuilt(rows))
    assert len(got) == len(want)
    assert {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got} == want
    assert max(r.depth for r in got) > 70


def test_trie_of_equal_and_empty(spark, tmp_path):
    scratch = Scratch(spark)
    same = spark.range(500).selectExpr("id as conv_id", "explode(sequence(0, 2)) as turn", "'u' as role", "'hello' as text")
    found = prefix_trie.trie(prefix_trie.numbered(same, scratch))
    assert [(r.conv_id, r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in found.nodes.orderBy("depth").collect()] == [(0, d, 500, int(d < 3), 1, 499 * 5 * (3 - max(d - 1, 0))) for d in range(4)]
    assert {r.depth for r in found.ends.collect()} == {3}
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert prefix_trie.op11_prefix_trie(spark, str(tmp_path)).collect() == []
