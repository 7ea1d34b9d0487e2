"""Quality classifier: hashed word n-gram logistic regression, trained by following the regularised leader.

Words are runs of letters and digits or runs of other marks. Their hashes and
those of neighbouring pairs index 2**18 weights. The model is fitted on at most
TRAIN_ROWS labelled rows, chosen by a hash of the identifier among all that may
be learned from; every document is scored whole as a sparse dot product.
Labels, language, source and identifier never enter a score.

Nulls: a null or empty text scores as the bias alone; rows without a label
aren't learned from; a null identifier is never learned from. Repeated rows
get the same score, and one of them is learned from; a very long text is scored
whole. Extra columns pass through under any name. An empty table gives an empty
result, and with no labels at all every score is 0.5.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map

BITS = 18
#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 8_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.5, 1.0
#: Predicted 1 from this score.
THRESHOLD = 0.3
FOLDS = 5
MEMO = 400_000

TOKEN = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")


class Hashes(dict):
    """word (bytes) -> hashes of its tokens as unsigned 32-bit integers."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        self[word] = out = np.array([xxhash.xxh32_intdigest(t) for t in TOKEN.findall(word.decode())], "<u4").tobytes()
        return out


def counted(text: bytes, memo: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(index, count) of a text, indexes ascending."""
    h = np.frombuffer(b"".join(map(memo.__getitem__, text.split())), "<u4")
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = h[:-1] * np.uint32(0x9E3779B1) + h[1:] * np.uint32(0x85EBCA77)
    pairs ^= pairs >> np.uint32(15)
    counts = np.bincount(np.concatenate([h, pairs]) >> np.uint32(32 - BITS))
    at = np.flatnonzero(counts)
    return at, counts[at]


def scaled(counts: np.ndarray) -> np.ndarray:
    """Values of counts, of length 1 in all."""
    value = np.log1p(counts)
    return value / np.sqrt((value**2).sum()) if len(value) else np.zeros(0)


def features(text: bytes, memo: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of a text, values of length 1 in all."""
    at, counts = counted(text, memo)
    return at, scaled(counts)


def packed(at: np.ndarray, counts: np.ndarray) -> bytes:
    """Indexes as steps and counts, byte by byte of the same place together, in some 2 bytes a feature where plain ones take 8."""
    return zlib.compress(np.concatenate([np.diff(at, prepend=0), counts]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(b), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(2, -1).astype(np.int64)
    return np.cumsum(both[0]), both[1]


class Leader:
    """Per-coordinate follow-the-regularised-leader for the logistic loss; the last coordinate is the bias."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        at, value = np.append(at, 1 << BITS), np.append(value, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", held_out: int = 0, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights, the bias last. Learns from rows whose fold isn't held_out, at most so many."""
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(F.col(id_col)) != held_out))
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
        .orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(rows)
    )

    def vectors(batches):
        memo = Hashes()
        for batch in batches:
            found = [packed(*counted(t or b"", memo)) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["id", "label", "counts"])

    # the sample is bounded, so it is sent to the documents rather than they to it
    labelled = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    # of rows that repeat an identifier one is learned from, so the bound holds after the join
    labelled = labelled.groupBy("_id", "_label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text")).selectExpr("cast(_id as long) id", "_label label", "_text text")
    # the driver holds the sample packed and unpacks one row at a time
    data = sorted(zip(*(c.to_pylist() for c in arrow_map(labelled, vectors, "id long, label int, counts binary").toArrow().columns)), key=lambda r: (xxhash.xxh64_intdigest(str(r[0])), r[1:]))
    model = Leader()
    for _ in range(EPOCHS):
        for _, label, counts in data:
            at, counts = unpacked(counts)
            model.learn(at, scaled(counts).astype("<f4").astype(float), label)
    return model.weights()


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id and score of every row, and the columns carried along (renamed _c0, _c1, ...)."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 1 MB
    carry = carry or []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])

    def run(batches):
        memo, w = Hashes(), sent.value.astype(float)
        for batch in batches:
            out = []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                at, value = features(t or b"", memo)
                out.append(1 / (1 + np.exp(-np.clip(w[at] @ value + w[-1], -35, 35))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(out, pa.float64())], names=["doc_id", *batch.schema.names[2:], "score"])

    schema = ", ".join([f"doc_id {rows.schema[0].dataType.simpleString()}", *[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[2:]], "score double"])
    return arrow_map(rows, run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns."""
    weights = fit(docs, labels, id_col=id_col, text_col=text_col)
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = f"c{docs.columns.index(text_col)}"
    scored = score(flat, weights, flat.columns[0], at, flat.columns)
    return scored.where(F.col("score") >= threshold).select(*[f"_c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
