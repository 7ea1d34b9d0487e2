"""Exact dedup by a log-structured merge index.

Each task fills a memtable keyed by the digest of the normalised text. Rows
that hit are verified by their bytes and folded at once. Full memtables are
flushed as digest-sorted runs. A stored table's runs are added to the index in
a few batches; further tables are batches too. The runs of a batch are merged by
digest, with map-side combining, to one part of the index that keeps the
smallest identifier of each digest, with filters sized by its rows, one a shard
of the digests. A later batch asks the filters of each part, and only digests
that may be there meet the part's entries. FAN parts of a level are compacted to
one part of the next level, the smallest identifiers staying.

Digests that several runs hold are verified again by their bytes: a filter
sized by the hits picks the few rows whose text travels, and grouping by
(digest, text) compares the bytes, so a colliding digest is split, never merged.

Nulls: a null text is empty; a null identifier sorts after all others. Of
rows that repeat identifier and text, exactly one is kept. A very long text
fills a memtable by itself. An empty table gives an empty result. Extra columns
pass through untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SPACE, Scratch, arrow_map, column_at, partitions, positional

MEMTABLE_ROWS, MEMTABLE_BYTES = 20_000, 32 << 20
#: Bits of the filter of hits for each hit, in words of 64; words at most (some 50 MB in a task), whatever the input.
HIT_BITS, MOST_WORDS = 16, 1 << 20
#: Batches in which a stored table's runs are added to an index: enough for a compaction and a part asked after it.
BATCHES = 6
#: Parts of a level that are compacted; digests of a shard, about; bits of a shard's filter for each, and hashes.
FAN, SHARD, KEY_BITS, HASHES = 4, 100_000, 16, 4


def normalised(b: bytes) -> bytes:
    """bytes.split() splits at 0x20 and 0x09-0x0D, no more and no less."""
    words = b.split()
    if not words:
        return b" " if b else b""
    return (b" " if b[:1].isspace() else b"") + b" ".join(words) + (b" " if b[-1:].isspace() else b"")


def _flush_runs(id_at: int, text_at: int, schema: pa.Schema, rows_max: int, bytes_max: int, number: int):
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held, rows, size, table = [], 0, 0, {}

        def flush():
            nonlocal held, rows, size, table, seq
            order = sorted(table.items(), key=lambda kv: (kv[0][0], kv[0][1]))
            merged = pa.Table.from_batches(held)
            keep = merged.take(pa.array([v[0] for _, v in order], pa.int64()))
            extra = [
                pa.array([k[0] for k, _ in order], pa.binary()),
                pa.array([(number << 48) + (part << 24) + seq] * len(order), pa.int64()),
                pa.array([v[1] for _, v in order], pa.list_(pa.int64())),
                pa.array([len(v[1]) for _, v in order], pa.int64()),
            ]
            out = pa.Table.from_arrays([*[c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in keep.columns], *extra], schema=schema)
            held, rows, size, table, seq = [], 0, 0, {}, seq + 1
            return out.to_batches(max_chunksize=500)

        for batch in batches:
            ids, texts = batch.column(id_at).to_pylist(), batch.column(text_at).cast(pa.binary()).to_pylist()
            held.append(batch)
            for i, (key, text) in enumerate(zip(ids, texts)):
                text = normalised(text or b"")
                digest = hashlib.sha256(text).digest()
                entry = table.get((digest, text))  # the key holds the bytes: equal keys are equal texts
                if entry is None:
                    table[digest, text] = entry = [rows + i, [], key]
                    size += len(text)
                elif key is not None and (entry[2] is None or key < entry[2]):
                    entry[0], entry[2] = rows + i, key
                if entry[0] == rows + i:  # the smallest identifier stands first
                    entry[1].insert(0, key)
                else:
                    entry[1].append(key)
            rows += len(ids)
            size += batch.nbytes
            if rows >= rows_max or size >= bytes_max:
                yield from flush()
        if rows:
            yield from flush()

    return run


def slots(digests: np.ndarray, bits: int) -> np.ndarray:
    """Bits of each digest (rows of 32 bytes) in a filter: its own words, as they are uniform."""
    return (digests.reshape(-1, 32)[:, : 8 * HASHES].copy().view("<u8") % np.uint64(bits)).astype(np.int64)


def padded(column: pa.Array) -> np.ndarray:
    """Digests as rows of 32 bytes; other lengths (in tests) are filled up."""
    return np.frombuffer(b"".join(d.ljust(32, b"\0")[:32] for d in column.to_pylist()), np.uint8)


def _filters(batches):
    """shard, bits: a filter of each shard's digests, from rows (shard, digest) sorted by shard."""
    shard, held = None, []

    def done():
        digests = np.concatenate(held)
        bits = max(64, KEY_BITS * (len(digests) // 32))
        on = np.zeros(bits + -bits % 8, np.uint8)
        on[slots(digests, bits).ravel()] = 1
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([bits], pa.int64()), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], names=["shard", "size", "bits"])

    for batch in batches:
        of = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if of[a] != shard:
                if shard is not None:
                    yield done()
                shard, held = int(of[a]), []
            held.append(padded(batch.column(1).slice(a, b - a)))
    if shard is not None:
        yield done()


def _maybe(batches):
    """Digests that their shard's filter lets through, from rows (shard, what, size, bits, digest) sorted by shard and what:
    the filter (0) before the digests (1)."""
    shard, size, on = None, 0, None
    for batch in batches:
        of, what = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (what[1:] != what[:-1])) + 1).tolist(), len(of)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if what[a] == 0:
                shard, size, on = of[a], batch.column(2)[a].as_py(), np.frombuffer(batch.column(3)[a].as_py(), np.uint8)
            elif of[a] == shard:
                at = slots(padded(batch.column(4).slice(a, b - a)), size)
                hit = ((on[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(4).slice(a, b - a).filter(pa.array(hit))], names=["digest"])


class Part:
    """Entries of an index (digest, first, size, entries) and filters of their shards, as tables."""

    def __init__(self, entries: DataFrame, scratch: Scratch, name: str, level: int):
        self.scratch, self.name, self.level = scratch, name, level
        self.entries = scratch.keep(entries, f"{name}_entries")
        self.shards = max(1, self.entries.count() // SHARD)
        rows = self.sharded(self.entries).repartition(partitions(scratch.spark), "shard").sortWithinPartitions("shard")
        self.filters = scratch.keep(arrow_map(rows, _filters, "shard int, size long, bits binary"), f"{name}_filters")

    def sharded(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.pmod(F.xxhash64("digest"), F.lit(self.shards)).cast("int").alias("shard"), "digest")

    def known(self, digests: DataFrame) -> DataFrame:
        """Entries of the given distinct digests that are here."""
        filters = self.filters.select("shard", F.lit(0).alias("what"), "size", "bits", F.lit(None).cast("binary").alias("digest"))
        asked = self.sharded(digests).select("shard", F.lit(1).alias("what"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("binary").alias("bits"), "digest")
        rows = filters.unionByName(asked).repartition(partitions(self.scratch.spark), "shard").sortWithinPartitions("shard", "what")
        return self.entries.join(arrow_map(rows, _maybe, "digest binary"), "digest", "left_semi")

    def drop(self) -> None:
        self.scratch.drop(f"{self.name}_entries", f"{self.name}_filters")


def _merged(entries: DataFrame) -> DataFrame:
    return entries.groupBy("digest").agg(F.min("first").alias("first"), F.sum("size").alias("size"), F.sum("entries").alias("entries"))


class Index:
    """A log-structured merge index in the shared folder, to which batches of documents are added."""

    def __init__(self, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = MEMTABLE_ROWS, memtable_bytes: int = MEMTABLE_BYTES):
        self.scratch, self.id_col, self.text_col, self.memtable = scratch, id_col, text_col, (memtable_rows, memtable_bytes)
        self.parts: list[Part] = []
        self.texts: list[DataFrame] = []  # digest, run, n, key and text of each batch's runs, for verification
        self.batches = 0

    def add(self, docs: DataFrame, last: bool = False) -> tuple[DataFrame, DataFrame]:
        """(runs, index) of a batch. runs: a row for each text of each of its runs, with the run's smallest-identifier row (columns
        by position), its digest, run, identifiers and number. index: digest, keep_id, group_size and the keeping run of each of
        its texts, over all batches so far. last: no batch follows, so the part isn't kept."""
        scratch, number = self.scratch, self.batches
        runs = self._flushed(docs, number)
        fresh = scratch.keep(self._fresh(runs, docs), f"fresh{number}")
        merged = fresh
        if self.parts:
            found = reduce(DataFrame.unionByName, [p.known(fresh) for p in self.parts])
            merged = scratch.keep(_merged(fresh.unionByName(found)), f"merged{number}")
        index = self._verified(merged, number)
        if not last:
            self._keep(fresh)
        scratch.drop(f"fresh{number}", f"merged{number}")
        self.batches += 1
        return runs, index

    def fill(self, docs: DataFrame, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
        """(runs, index) of a table whose runs are flushed at once and added in batches of runs: each batch asks the parts before
        it for what they have of its digests, and a digest's last answer counts. Bytes are verified at the end."""
        scratch, answers = self.scratch, []
        runs = self._flushed(docs, self.batches)
        of = (F.shiftright("run", 24).bitwiseAND((1 << 24) - 1) + F.col("run").bitwiseAND((1 << 24) - 1)) % batches
        for turn in range(batches):
            fresh = scratch.keep(self._fresh(runs.where(of == turn), docs), f"fresh{self.batches}")
            if fresh.limit(1).count():
                merged = fresh
                if self.parts:
                    found = reduce(DataFrame.unionByName, [p.known(fresh) for p in self.parts])
                    merged = scratch.keep(_merged(fresh.unionByName(found)), f"merged{self.batches}")
                answers.append(merged.withColumn("turn", F.lit(turn)))
                if turn < batches - 1:
                    self._keep(fresh)
            self.batches += 1
        if not answers:
            answers = [self._fresh(runs, docs).withColumn("turn", F.lit(0))]
        last = reduce(DataFrame.unionByName, answers).groupBy("digest").agg(F.max_by(F.struct("first", "size", "entries"), "turn").alias("last")).select("digest", "last.*")
        last = scratch.keep(last, "last")
        for p in self.parts:
            p.drop()
        scratch.drop(*[f"{name}{i}" for name in ("fresh", "merged") for i in range(self.batches)])
        return runs, self._verified(last, self.batches)

    def _flushed(self, docs: DataFrame, number: int) -> DataFrame:
        """The runs of a batch, written; their texts are kept in mind for verification."""
        id_at, text_at = column_at(docs, self.id_col), column_at(docs, self.text_col)
        flat = positional(docs).withColumn(f"c{id_at}", F.col(f"c{id_at}").cast("long"))
        schema = T.StructType([*flat.schema.fields, T.StructField("digest", T.BinaryType()), T.StructField("run", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("n", T.LongType())])
        runs = self.scratch.keep(arrow_map(flat, _flush_runs(id_at, text_at, to_arrow_schema(schema), *self.memtable, number), schema), f"runs{number}")
        text = F.regexp_replace(F.coalesce(F.col(f"c{text_at}"), F.lit("")), SPACE, " ")
        self.texts.append(runs.select("digest", "run", "n", F.col(f"c{id_at}").alias("key"), text.alias("text")))
        return runs

    def _fresh(self, runs: DataFrame, docs: DataFrame) -> DataFrame:
        """Entries of some runs: digest, first (the smallest identifier and its run), size, entries (runs that hold it)."""
        key = F.col(f"c{column_at(docs, self.id_col)}")
        first = F.min(F.struct(key.isNull().alias("none"), key.alias("id"), F.col("run"))).alias("first")
        return runs.groupBy("digest").agg(first, F.sum("n").alias("size"), F.count(F.lit(1)).alias("entries"))

    def _keep(self, fresh: DataFrame) -> None:
        """A new part of level 0; FAN parts of a level become one of the next."""
        self.parts.append(Part(fresh, self.scratch, f"part{self.batches}", 0))
        level = 0
        while len(same := [p for p in self.parts if p.level == level]) >= FAN:
            level += 1
            whole = Part(_merged(reduce(DataFrame.unionByName, [p.entries for p in same])), self.scratch, f"part{self.batches}_{level}", level)
            self.parts = [p for p in self.parts if p not in same] + [whole]
            for p in same:
                p.drop()

    def _verified(self, merged: DataFrame, number: int) -> DataFrame:
        """The index of merged entries, those of several runs told apart by the bytes of their texts."""
        scratch = self.scratch
        hits = merged.where("entries > 1")
        # a one-hash filter over the digests that several runs hold; false positives only cost traffic
        words = min(MOST_WORDS, 1 << max(6, int(np.ceil(np.log2(max(1, hits.count()) * HIT_BITS / 64)))))
        slot = F.pmod(F.xxhash64("digest"), F.lit(words * 64))
        word, bit = (slot / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit")
        filters = hits.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        runs = reduce(DataFrame.unionByName, self.texts)
        suspects = runs.select("*", word, bit).join(F.broadcast(filters), "word").where((F.col("bits").bitwiseAND(F.col("bit"))) != 0)
        suspects = scratch.keep(suspects, f"suspects{number}")  # written, lest the optimiser join all texts with the hits first
        verified = suspects.join(hits.select("digest"), "digest", "left_semi").groupBy("digest", "text").agg(
            F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("id"), F.col("run"))).alias("first"), F.sum("n").alias("size"))
        checked = verified.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
        split = checked.where("texts > 1")
        index = merged.where("entries = 1").select("digest", "first", "size").unionByName(hits.join(checked.where("texts = 1"), "digest", "left_semi").select("digest", "first", "size"))
        index = index.withColumn("text", F.lit(None).cast("string"))
        if split.limit(1).count():  # a collision of the digest: its texts are told apart by their bytes
            index = index.unionByName(verified.join(split, "digest", "left_semi").select("digest", "first", "size", "text"))
        index = index.select("digest", "text", F.col("first.id").alias("keep_id"), F.col("first.run").alias("keep_run"), F.col("size").alias("group_size"))
        index = scratch.keep(index, f"index{number}")
        scratch.drop(f"suspects{number}")
        return index


def _labelled(runs: DataFrame, index: DataFrame, text_at: int, columns: list[str]) -> DataFrame:
    """Runs with their text's keeper. The index is joined by digest, and by the bytes where a digest collides."""
    plain = runs.select("digest", "run", *columns).join(index.where("text is null").drop("text"), "digest")
    odd = index.where("text is not null")
    if not odd.limit(1).count():
        return plain
    text = F.regexp_replace(F.coalesce(F.col(f"c{text_at}"), F.lit("")), SPACE, " ").alias("text")
    return plain.unionByName(runs.select("digest", "run", *columns, text).join(odd, ["digest", "text"]).drop("text"))


def grouped(runs: DataFrame, index: DataFrame, text_at: int) -> DataFrame:
    """A row for each row of a batch: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _labelled(runs, index, text_at, ["ids"]).select("digest", "run", "keep_id", "keep_run", "group_size", F.posexplode("ids").alias("at", "doc_id"))
    kept = (F.col("run") == F.col("keep_run")) & (F.col("at") == 0)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **memtable) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    index = Index(Scratch(docs.sparkSession), id_col, text_col, **memtable)
    return grouped(*index.fill(docs.select(id_col, text_col)), 1)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **memtable) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts, the one with the smallest identifier."""
    runs, found = Index(Scratch(docs.sparkSession), id_col, text_col, **memtable).fill(docs)
    flat = [f"c{i}" for i in range(len(docs.columns))]
    kept = _labelled(runs, found, column_at(docs, text_col), flat).where((F.col("run") == F.col("keep_run")) & F.col(f"c{column_at(docs, id_col)}").eqNullSafe(F.col("keep_id")))
    out = kept.select(*flat).toDF(*docs.columns)
    return out.withColumn(id_col, F.col(id_col).cast(docs.schema[id_col].dataType))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
