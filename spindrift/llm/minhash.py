"""MinHash near-dedup with odd sketches.

A document's MinHash samples give its bands, and are folded into a parity
bitmap (an odd sketch): each sample toggles one bit, and the XOR population
count of two bitmaps estimates a high similarity precisely. A second bitmap
folds the whole shingle set in the same way; its XOR population count never
exceeds the sets' symmetric difference, so it rejects without error. Pairs of a
band's bucket that pass both are confirmed on the full sets.

Equal sets are collapsed first. Buckets are compared in blocks of bounded size
in sorted streams, and only links that join two groups not yet joined in the
block are passed on (a spanning forest, not all pairs). A second pass compares
whatever lies in one bucket but in different components, completely: members
outside the bucket's largest component meet all its members, a block of the
ones with a block of the others at a time, so a task holds two blocks.
Components of confirmed links are then final. No bucket is capped.

With 28 bands of 4 samples a pair shares no bucket with a probability of 4e-7
at similarity 0.8 and of 1e-9 at 0.85.

Nulls: a null or empty text, or one without words, has an empty set and links
with nothing; a null identifier is never linked and is its own component
(null). Repeated identifiers are told apart as rows only by their sets. A very
long text is sketched in steps of bounded size, and its full set travels only
where a pair is confirmed. An empty table gives an empty result. Extra columns
pass through untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, met, partitions, positional
from .components import components
from .words import LOWER

BANDS, BAND_ROWS = 28, 4
SAMPLES = BANDS * BAND_ROWS
#: Bits of the odd sketch of samples and of the one of the whole set.
SAMPLE_BITS, SET_BITS = 256, 512
#: Standard errors of the sampled estimate that are allowed for.
MARGIN = 6
#: Rows of a bucket that are compared with each other in one block.
BLOCK = 512
MEMO = 400_000

_rng = np.random.default_rng(20240229)
MULTIPLIERS = _rng.integers(1, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
ADDENDS = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def mixed_bits(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, memo: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; with fewer words than size, of the whole sequence."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mixed_bits(out + h[i : i + n] * np.uint64(2 * i + 3))
    return np.unique(out)


def samples(shingles: np.ndarray) -> np.ndarray:
    """MinHash samples, unsigned 32 bits."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(out, (low[i : i + 2048, None] * MULTIPLIERS + ADDENDS).min(axis=0), out=out)
    return out


def parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap in which each hash toggles a bit, as unsigned 64-bit words."""
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def sketch(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bands, odd sketch of the samples, odd sketch of the set)."""
    s = samples(shingles).astype(np.uint64)
    bands = np.zeros(BANDS, np.uint64)
    for i, column in enumerate(s.reshape(BANDS, BAND_ROWS).T):
        bands = mixed_bits(bands * np.uint64(31) + column + np.uint64(i + 1))
    bands = mixed_bits(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    placed = mixed_bits((s << np.uint64(8)) + np.arange(SAMPLES, dtype=np.uint64))
    return bands, parity(placed, SAMPLE_BITS), parity(mixed_bits(shingles), SET_BITS)


def may_link(sa, sb, pa_, pb, na, nb, threshold: int) -> np.ndarray:
    """Whether pairs may reach threshold percent: arrays broadcast against each other, bitmaps in the last axis.

    For a similarity J of sets of a and b elements the symmetric difference is (1-J)/(1+J)*(a+b).
    """
    j = threshold / 100
    total = (na + nb).astype(np.float64)
    size_ok = np.minimum(na, nb) * 100 >= threshold * np.maximum(na, nb)
    set_ok = np.bitwise_count(pa_ ^ pb).sum(axis=-1) <= np.floor((1 - j) / (1 + j) * total + 1e-9)
    least = max(0.0, j - MARGIN * (j * (1 - j) / SAMPLES) ** 0.5)
    # XOR of samples: each of the SAMPLES*(1-J) that differ toggles two bits; the bound is where J would be least
    most = SAMPLE_BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - least) / SAMPLE_BITS))
    return size_ok & set_ok & (np.bitwise_count(sa ^ sb).sum(axis=-1) <= most)


class Forest(dict):
    """Union-find over the members of a block."""

    def root(self, x):
        while (p := self.get(x, x)) != x:
            self[x] = x = self.get(p, p)
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self[max(a, b)] = min(a, b)
        return a != b


def _grouped(batches, keys: int):
    """(columns as numpy or lists) of each run of rows that agree in the first columns, in a sorted stream."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table):
        code = [table.column(i).to_numpy() for i in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in code], axis=0)) + 1
        return [0, *change.tolist(), len(table)]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        first, last = held[0], batch
        if all(first.column(i)[0] == last.column(i)[last.num_rows - 1] for i in range(keys)):
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        ends = cut(table)
        for a, b in zip(ends[:-2], ends[1:-1]):
            yield table.slice(a, b - a)
        held = table.slice(ends[-2]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        ends = cut(table)
        for a, b in zip(ends, ends[1:]):
            yield table.slice(a, b - a)


def _bitmaps(column, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, words)


def _members(table: pa.Table) -> tuple:
    """id, component, n, odd sketches, probe of a group's rows."""
    return (table.column("id").to_numpy(), table.column("component").to_numpy(), table.column("n").to_numpy(), _bitmaps(table.column("s"), SAMPLE_BITS // 64), _bitmaps(table.column("p"), SET_BITS // 64))


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _spanning(threshold: int):
    """Links of each block that join its members, by estimate: a spanning forest."""

    def run(batches):
        a, b = [], []
        for table in _grouped(batches, 2):
            if len(table) < 2:
                continue
            ids, _, n, s, p = _members(table)
            forest = Forest()
            for i in range(len(ids) - 1):
                ok = np.flatnonzero(may_link(s[i], s[i + 1 :], p[i], p[i + 1 :], n[i], n[i + 1 :], threshold))
                for k in ok.tolist():
                    if forest.join(i, i + 1 + k):
                        a.append(ids[i])
                        b.append(ids[i + 1 + k])
            if len(a) > 5000:
                yield _pairs(a, b)
                a, b = [], []
        yield _pairs(a, b)

    return run


def _across(threshold: int):
    """All links by estimate between different components of two blocks: probes (rows with probe set) against the others."""

    def run(batches):
        a, b = [], []
        for table in _grouped(batches, 3):
            probe = table.column("probe").to_numpy(zero_copy_only=False).astype(bool)
            ids, comp, n, s, p = _members(table)
            home = np.flatnonzero(~probe)
            for i in np.flatnonzero(probe).tolist():
                other = home[comp[home] != comp[i]]
                if len(other):
                    ok = other[may_link(s[i], s[other], p[i], p[other], n[i], n[other], threshold)]
                    a += [ids[i]] * len(ok)
                    b += ids[ok].tolist()
            if len(a) > 5000:
                yield _pairs(a, b)
                a, b = [], []
        yield _pairs(a, b)

    return run


def shingle_table(docs: DataFrame, shingle: int) -> DataFrame:
    """docs: key, text. key, n (set size), signature (of the set), bands, s, p (odd sketches)."""

    def run(batches):
        memo = WordHashes()
        for batch in batches:
            n, sig, bands, s, p = [], [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                x = shingle_set(text or b"", memo, shingle)
                n.append(len(x))
                if len(x):
                    b, so, po = sketch(x)
                    sig.append(xxhash.xxh3_128_digest(x.tobytes()))
                    bands.append(b.view(np.int64))
                    s.append(so.tobytes())
                    p.append(po.tobytes())
                else:
                    for column in (sig, bands, s, p):
                        column.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(s, pa.binary()), pa.array(p, pa.binary())], names=["key", "n", "signature", "bands", "s", "p"])

    return arrow_map(docs, run, "key long, n long, signature binary, bands array<long>, s binary, p binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    both = met(pairs).join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b")
    pairs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row. Links: 100 * intersection >= threshold * union."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    table = scratch.keep(shingle_table(docs, shingle), "shingles")
    live = table.where("n > 0 and key is not null")
    # equal sets stand behind the smallest identifier; copies are found by map-side combining
    first = live.groupBy("signature").agg(F.min("key").alias("id"), F.first("n").alias("n"))
    first = scratch.keep(first, "first")
    # a repeated identifier may stand for several sets; one of them carries its sketches, the other sets keep their own row
    reps = live.join(met(first.select("signature", F.col("id").alias("key"))), ["signature", "key"], "left_semi").dropDuplicates(["signature"])
    reps = scratch.keep(reps.select(F.col("key").alias("id"), "n", "bands", "s", "p"), "reps")

    banded = reps.select(F.explode("bands").alias("bucket"), "id")
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("m > 1 and lo <> hi").select("bucket", "m")
    # Spark sizes a table as before an explode, a tenth of what banded is, and would send it around
    placed = scratch.keep(banded.join(shared.hint("merge"), "bucket"), "placed")
    active = scratch.keep(placed.select("id").distinct(), "active")

    def sets_of(batches):
        memo = WordHashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t or b"", memo, shingle).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["id", "elements"])

    sets = scratch.keep(arrow_map(docs.join(met(active.withColumnRenamed("id", "key")), "key", "left_semi"), sets_of, "id long, elements binary").dropDuplicates(["id", "elements"]), "sets")

    def labelled(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
        if groups is None:
            return rows.withColumn("component", F.col("id"))
        return rows.join(met(groups), "id", "left").withColumn("component", F.coalesce("component", "id"))

    # first pass: every bucket in blocks that a hash deals its members to, differently in each band
    facts = reps.select("id", "n", "s", "p")
    salt = F.pmod(F.xxhash64("bucket", "id"), F.ceil(F.col("m") / BLOCK)).alias("block")
    blocks = labelled(placed.select("bucket", salt, "id").join(facts, "id"), None).select("bucket", "block", "id", "component", "n", "s", "p")
    blocks = blocks.repartition(partitions(spark), "bucket", "block").sortWithinPartitions("bucket", "block", "id")
    pairs = scratch.keep(arrow_map(blocks, _spanning(threshold), "a long, b long").distinct(), "pairs1")
    links = scratch.keep(_confirmed(pairs, sets, threshold), "links1")
    groups = scratch.keep(components(links, scratch, "first_"), "groups1")

    # second pass: buckets that still hold several components
    members = scratch.keep(labelled(placed.select("bucket", "id"), groups).select("bucket", "id", "component"), "members")
    counts = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"))
    mixed = counts.groupBy("bucket").agg(F.sum("k").alias("m"), F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("k", "component")).alias("largest"), (F.sum("k") - F.max("k")).alias("strays")).where("parts > 1")
    stray = (F.col("component") != F.col("largest")).alias("stray")
    rows = members.join(mixed, "bucket").select("bucket", "id", "component", stray, F.ceil(F.col("m") / BLOCK).cast("int").alias("homes"), F.ceil(F.col("strays") / BLOCK).cast("int").alias("probes"))
    dealt = lambda salt, most: F.pmod(F.xxhash64("bucket", "id", F.lit(salt)), F.col(most)).cast("int")
    home = rows.select("bucket", dealt("home", "homes").alias("block"), F.explode(F.expr("sequence(0, probes - 1)")).alias("other"), "id", "component", F.lit(False).alias("probe"))
    strays = rows.where("stray").select("bucket", F.explode(F.expr("sequence(0, homes - 1)")).alias("block"), dealt("stray", "probes").alias("other"), "id", "component", F.lit(True).alias("probe"))
    blocks = home.unionByName(strays).join(facts, "id").select("bucket", "block", "other", "id", "component", "n", "s", "p", "probe")
    blocks = blocks.repartition(partitions(spark), "bucket", "block", "other").sortWithinPartitions("bucket", "block", "other", "id")
    pairs = arrow_map(blocks, _across(threshold), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = scratch.keep(_confirmed(scratch.keep(pairs, "pairs2"), sets, threshold), "links2")
    groups = scratch.keep(components(links.unionByName(more), scratch, "second_"), "groups2")

    final = labelled(first.select("signature", "id"), groups).select("signature", F.col("component").alias("component_id"))
    out = table.select("key", "n", "signature").join(final, "signature", "left")
    alone = F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key"))
    out = scratch.keep(out.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), alone.alias("component_id")), "groups")
    scratch.drop(*["shingles", "first", "reps", "placed", "active", "sets", "pairs1", "links1", "groups1", "members", "pairs2", "links2", "groups2"])
    return out


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of docs that stay: those whose identifier is their component's smallest, and those without one."""
    groups = near_groups(docs, Scratch(docs.sparkSession), id_col, text_col, shingle, threshold)
    dropped = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    flat = positional(docs)
    return flat.join(dropped, F.col(f"c{docs.columns.index(id_col)}") == F.col("_gone"), "left_anti").toDF(*docs.columns)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))
    return groups.withColumn("kept", F.col("doc_id") == F.col("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS x
      FROM d, unnest(range(1, greatest(2, len(w) - 1))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
c AS (SELECT doc_id AS id, doc_id AS to_id FROM d UNION SELECT c.id, l.b FROM c JOIN l ON c.to_id = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(to_id) AS component_id FROM c GROUP BY id) m ON m.id = d.doc_id
"""
