"""The pipeline's stages, one by one and together, against a sequential rendering."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from spindrift.llm import quality
from spindrift.llm.common import Scratch

from .test_documents import SCHEMA, WORD, corpus, mix_by_hand, near_by_hand, normal

DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the tables")


@needs_tables
def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, scratch, sizes = docs.columns, Scratch(spark), [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.keep(stage(spark, docs, DIR), f"s{i}")
        sizes.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[5] == sizes[4]


@needs_tables
def test_run_by_hand(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    weights, memo = quality.fit(docs, labels), quality.Hashes()

    def score(text):
        at, value = quality.features((text or "").encode(), memo)
        return 1 / (1 + np.exp(-(weights[at] @ value + weights[-1])))

    assert min(abs(score(r[1]) - quality.THRESHOLD) for r in rows) > 1e-5  # no row on the edge
    rows = [r for r in rows if score(r[1]) >= quality.THRESHOLD]
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        first.setdefault(normal(r[1]), r)
    rows = list(first.values())
    component = near_by_hand(rows, 5, 80)
    rows = [r for r in rows if component[r[0]][1] == r[0]]
    sizes, by, target = mix_by_hand(rows)
    groups = defaultdict(list)
    for n, r in zip(sizes, rows):
        groups[r[3]].append((hashlib.md5(str(r[0]).encode()).hexdigest(), r[0], n, r[1]))
    mixed = []
    for source, members in groups.items():
        budget = int(target[source])
        epochs, rest = divmod(budget, by[source]) if by[source] else (0, 0)
        for _, i, n, text in sorted(members):
            take = min(n, rest)
            rest -= take
            mixed += [(i, text)] * (epochs if n else 0)
            if take == n and n:
                mixed.append((i, text))
            elif take:
                mixed.append((i, "".join(re.findall(r"[\x20\x09-\x0D]*" + WORD.pattern, text)[:take])))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    want = Counter()
    for i, text in mixed:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        shown = tokenizer.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, DIR).collect())
    assert got == want


@needs_tables
def test_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns whose names clash; then an empty table."""
    rows = [*corpus(), (None, None, None, None, None, None, None, None, None, None, None, None, None), (None, "a b c", "en", "a", 1, "k", "d", 1, True, "x", 3, "q", "z")]
    for data in (rows, []):
        scratch = Scratch(spark)
        docs = scratch.keep(spark.createDataFrame(data, SCHEMA), "docs")
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs
            docs = scratch.keep(stage(spark, docs, DIR), f"s{i}")
            assert docs.columns == before.columns if i < 4 else docs.count() == before.count()
