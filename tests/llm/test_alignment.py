"""Aligned tokens against a plain rendering: each text encoded as a whole, all pairs of ranges compared."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spindrift.llm import alignment

SCHEMA = "doc_id long, text string, block long, what int, place long, docs string, n_a string, fact int"


def texts():
    rng = random.Random(3)
    words = ["the", "Ärger", "naïve", "don't", "日本語", "<|endoftext|>", "<s>", "<0x41>", "ſ", "é", "🙂", "123", "x=1;", "\n", "\t", "a b", "\x00", "​", "zumeinstöungen", "qqq"]
    some = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 50))) for _ in range(30)]
    some += ["".join(rng.choice([*words, " ", "  "]) for _ in range(40)) for _ in range(40)]
    some += [None, "", " ", "   ", " a", "a ", "a  b", "a   b\n", "\n", "\n a", "a \n b", "▁", "a ▁b", "\u0085 x", "x \u0085", "one", "one", " ".join(rng.choice(words) for _ in range(20_000)), "x" * 5000, "日本" * 700]
    return some


def plain(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    spelled = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, counts = [], Counter()
    for i, text in rows:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        of_a, of_b = [bytes(byte[c] for c in a.id_to_token(t)) for t in ids_a], [spelled(t) for t in ids_b]
        if not text or not (b"".join(of_a) == b"".join(of_b) == (" " + text).encode()):
            out.append((i, 0, 0, [], [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
        groups, ka, kb = [], 0, 0
        for end in sorted({*ends_a} & {*ends_b}):
            la, lb = ends_a.index(end, ka) + 1, ends_b.index(end, kb) + 1
            groups.append((ids_a[ka:la], ids_b[kb:lb], ends_a[ka:la], ends_b[kb:lb], [0, *ends_a][ka]))
            ka, kb = la, lb
        links = []
        for ga, gb, ea, eb, start in groups:
            for x, x0, x1 in zip(ga, [start, *ea], ea):
                links += [(x, y) for y, y0, y1 in zip(gb, [start, *eb], eb) if max(x0, y0) < min(x1, y1)]
        counts.update(links)
        out.append((i, len(ids_a), len(ids_b), groups, links, ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    return Counter((i, na, nb, len(g), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), sha(s)) for i, na, nb, g, links, s in out)


@pytest.mark.parametrize("held", [1 << 18, 7])
def test_alignment(spark, held):
    rows = list(enumerate(texts()))
    rows += [rows[0], rows[0], (None, "no identifier")]
    df = spark.createDataFrame([(i, t, 1, 2, 3, "d", "n", 4) for i, t in rows], SCHEMA).repartition(3)
    got = alignment.align(df, held=held, with_groups=True).collect()
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r[c] for c in columns) for r in got) == plain(rows)
    assert all((hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256 for r in got)


def test_shared_ends():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (sorted({*rng.sample(range(1, 60), rng.randrange(1, 40)), 60}) for _ in range(2))
        got = alignment.shared_ends(np.array(a), np.array(b), np.array([0]), np.array([len(a)]))
        assert got.tolist() == [x in b for x in a]


def test_alignment_of_nothing(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect()] == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]
