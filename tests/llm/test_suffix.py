"""Suffix arrays against sorting, removal of repeated strings against a dictionary of all of them."""

import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from spindrift.llm import suffix_dedup

SCHEMA = "doc_id long, text string, file string, row int, start long, spans string, key int"


def test_array_and_prefixes():
    rng = random.Random(2)
    texts = [bytes(rng.randrange(97, 97 + rng.choice([1, 2, 3, 26])) for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    texts += [t * 3 for t in texts[:20]] + [b"a" * 500, b"ab" * 200, b"a", b""]
    for t in texts:
        text = np.frombuffer(t, np.uint8)
        assert suffix_dedup.suffix_array(text, 10**6).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        size = rng.choice([8, 9, 12, 16])
        starts = [i for i in suffix_dedup.suffix_array(text, size).tolist() if i + size <= len(t)]
        assert [t[i : i + size] for i in starts] == sorted(t[i : i + size] for i in starts)
        got = suffix_dedup.common_prefixes(text, np.array(starts, np.int32), size).tolist()
        assert [n == size for n in got[1:]] == [t[x : x + size] == t[y : y + size] for x, y in zip(starts, starts[1:])]


def texts():
    rng = random.Random(4)
    words = ["the", "Ärger", "naïve", "日本", "x1", "of", "w"]
    own = lambda n: " ".join(rng.choice(words) + str(rng.randrange(300)) for _ in range(n))
    passages = [own(20) for _ in range(4)]
    some = [own(rng.randrange(0, 60)) for _ in range(30)]
    some += [f"{own(rng.randrange(8))}{rng.choice(passages)}{rng.choice(['', ' ', own(5)])}" for _ in range(40)]
    near = own(80).split()
    for i in range(8):
        some.append(" ".join(w if rng.random() > 0.03 else "z" for w in near))
    some += [some[3], some[3], some[5] + some[6], None, "", "short", "a" * 300, "ab" * 150, "b" + "a" * 299, passages[0] * 3, "x".join(passages), own(4000), "日" * 100]
    return some


def brute(rows, size):
    places = defaultdict(int)
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, t in data:
        for k in range(len(t) - size + 1):
            places[t[k : k + size]] += 1
    out = []
    for i, t in data:
        gone = np.zeros(len(t) + 2, bool)
        for k in range(len(t) - size + 1):
            if places[t[k : k + size]] > 1:
                gone[k + 1 : k + 1 + size] = True
        spans = np.flatnonzero(np.diff(gone.astype(int))).reshape(-1, 2)
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        out.append((i, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), tuple(map(tuple, spans.tolist())), kept))
    return Counter(out)


@pytest.mark.parametrize("meet,cut,shard,piece", [(4096, 1 << 21, 1 << 21, 512), (2, 700, 500, 16)])
def test_dedup(spark, monkeypatch, meet, cut, shard, piece):
    monkeypatch.setattr(suffix_dedup, "CUT", cut)
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rows = list(enumerate(texts()))
    rows += [rows[4], (None, "no identifier " * 10)]
    df = spark.createDataFrame([(i, t, "f", 1, 2, "s", 3) for i, t in rows], SCHEMA).repartition(3)
    got = suffix_dedup.dedup(df, size=64, gram=16, meet=meet, with_kept=True).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got) == brute(rows, 64)
    assert any(0 < r.n_removed < r.n_bytes for r in got)


def test_array_decides(spark, monkeypatch):
    df = spark.createDataFrame([(1, "x" + "passage " * 60), (2, "y" + "passage " * 60)], "doc_id long, text string")
    assert all(r.n_removed > 400 for r in suffix_dedup.dedup(df).collect())
    monkeypatch.setattr(suffix_dedup, "common_prefixes", lambda text, array, size: np.zeros(len(array), np.int64))
    assert all(r.n_removed == 0 for r in suffix_dedup.dedup(df).collect())


def test_dedup_of_nothing(spark):
    assert suffix_dedup.dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r)[:4] for r in suffix_dedup.dedup(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect()] == [(1, 0, 0, 0), (2, 0, 0, 0)]


def test_passages_go_by_bytes_not_by_words(spark):
    """51 words that repeat stay where they have fewer than 400 bytes, and go as a whole from 400 on."""
    rng = random.Random(9)
    own = lambda n: " ".join(f"{rng.getrandbits(40):010x}" for _ in range(n))
    words = " ".join(f"{rng.getrandbits(24):06x}" for _ in range(51))
    short, enough = words[:356], words + "." * 44
    assert len(short.split()) > 50 and len(enough) == 400
    rows = [(i, f"{chr(97 + i)}{own(30)} |{p}| {own(30)}{chr(97 + i)}") for i, p in enumerate([short, short, enough, enough])]
    got = {r.doc_id: r for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_kept=True).collect()}
    assert [got[i].n_removed for i in range(4)] == [0, 0, 404, 404]
    assert [bytes(got[i].kept).decode() for i in range(4)] == [rows[0][1], rows[1][1], *(t.replace(f" |{enough}| ", "") for _, t in rows[2:])]


def held(f):
    """MB that f holds at most, and what it gives."""
    tracemalloc.start()
    try:
        out = f()
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def test_a_worker_holds_little():
    """Of whole texts, of a full shard and of strings that share no comparison: bounded, with the same results."""
    rng = random.Random(6)
    words = [bytes(rng.choices(b"etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(5000)]
    text = b" ".join(rng.choices(words, k=suffix_dedup.CUT // 6 + 1))[: suffix_dedup.CUT]
    mb, (_, first, end, _) = held(lambda: suffix_dedup.pieces(text, [(0, len(text))]))
    assert mb < 40 and (end - first).sum() == len(text) - 399
    own = [b" ".join(rng.choices(words, k=150)) for _ in range(suffix_dedup.SHARD // 900)]
    mb, (repeats, _) = held(lambda: suffix_dedup.shard(own + own[:1], [1] * (len(own) + 1)))
    assert mb < 60 and [bool(f.any()) for f in repeats] == [True] + [False] * (len(own) - 1) + [True]


def test_prefixes_of_starts_on_diagonals_of_their_own():
    rng = np.random.default_rng(5)
    copies = 16
    text = np.tile(rng.integers(0, 256, 2000, dtype=np.uint8), copies)
    # copies in ever different order, so that hardly a start has the neighbour of the start before it
    array = np.concatenate([rng.permutation(copies) * 2000 + i for i in range(1600)]).astype(np.int32)
    mb, got = held(lambda: suffix_dedup.common_prefixes(text, array))
    assert mb < 80
    assert (got.reshape(-1, copies)[:, 1:] == 400).all() and (got.reshape(-1, copies)[1:, 0] == 0).all()


def test_strings_of_a_shared_key_go_in_batches(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(suffix_dedup, "ROWS", 1000)
    texts = [rng.randbytes(600) for _ in range(50)]
    texts.append(texts[0][100:550] + b"-")
    rows = [(7, i, -i, 1, 2 if i else 1, 0, t) for i, t in enumerate(texts)]
    batches = list(suffix_dedup.decided_rows(rows))
    assert max(b.num_rows for b in batches) == 1000
    out = [r for b in batches for r in b.to_pylist()]
    assert {r["d1"]: np.frombuffer(r["runs"], "<u4").tolist() for r in out if r["runs"]} == {0: [100, 151], 50: [0, 51]}
    digest = lambda t: tuple(np.frombuffer(suffix_dedup.xxhash.xxh3_128_digest(t), "<i8").tolist())
    strings = {digest(rows[r["d1"]][6][r["at"] : r["at"] + 400]): r["n"] for r in out if r["runs"] is None}
    want = Counter(digest(t[k : k + 400]) for t in texts for k in range(len(t) - 399))
    assert all((r["s1"], r["s2"]) in want and r["key"] == 7 and r["d2"] == -r["d1"] for r in out if r["runs"] is None)
    assert all(want[d] == n for d, n in strings.items())
    assert len(strings) >= 49 * 201 + 1 and all(digest(t[k : k + 400]) in strings for t in texts[1:50] for k in range(201))
