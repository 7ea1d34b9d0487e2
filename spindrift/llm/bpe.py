"""BPE encoding and decoding through a table of distinct words.

Tasks split texts into words. The most frequent words, words.FREQUENT of them
at every size of the corpus, are encoded once and sent to all tasks. Every
other word travels once for each block of rows that holds it (word, block,
place in the block's list), meets its like by the word, is encoded once for the
whole corpus, and its ids go back to the block. A block's rows travel as codes
of words, compressed by chunks; where they meet the block's list, codes become
ids by place. Decoding joins the ids of each word to the table of pieces, once
for each word of a list, and lays the pieces of a text's words end to end.

A block ends after HELD words of its own or MOST_WORDS words in all, so its
list and its chunks stay small; no word is frequent enough outside the sent
ones to make a hot key. Blocks are cut by the order of rows in a task's part of
the stored files, which doesn't change between reads; a block whose list
doesn't fit its rows raises.

Nulls: a null text is empty and has no ids; a null identifier is carried along.
A very long text is a chunk of its own. Repeated rows are encoded each; an
empty table gives an empty result. Only the two named columns are read, so
other columns can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, partitions
from .tokens import encoded_words, id_type, pieces
from .words import FREQUENT, count_words, frequency_bound, packed_table, unpacked_table

#: Rare words, and words in all, after which a block ends; words of a chunk.
HELD, MOST_WORDS, CHUNK = 1 << 16, 1 << 22, 1 << 15


def word_table(words: DataFrame, path: str | None = None) -> DataFrame:
    """words: word and other columns, equal words one after the other. ids of each row's word take its place; a word is encoded
    where it changes."""

    def run(batches):
        last, last_ids = None, b""
        for batch in batches:
            distinct = batch.column(0).cast(pa.binary()).dictionary_encode()
            known = distinct.dictionary.to_pylist()
            new = [w for w in known if w != last]
            ids = dict(zip(new, encoded_words(new, path)))
            if known and known[0] == last:
                ids[last] = last_ids
            table = pa.array([ids[w] for w in known], pa.binary())
            if known:
                last, last_ids = known[-1], ids[known[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], table.take(distinct.indices)], names=[*batch.schema.names[1:], "ids"])

    rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema[1:])
    return arrow_map(words, run, f"{rest}, ids binary")


def squeezed(codes: list[int]) -> bytes:
    """Codes by planes of bytes, compressed: their number, then the planes from the lowest byte up."""
    planes = np.array(codes, "<u4").view("u1").reshape(-1, 4).T.tobytes()
    return len(codes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=4 * n, codec="zstd", asbytes=True) if n else b""
    return np.frombuffer(planes, "u1").reshape(4, n).T.copy().view("<u4").reshape(-1)


def blocks(batches, rank: dict[bytes, int]):
    """("words", block, words) for each block of a task's rows, and ("rows", block, place, doc_ids, words by row, codes) for its
    chunks. Columns: doc_id, text, file, row. Codes below len(rank) are sent words, the others places in the block's list."""
    get, base = rank.get, len(rank)
    block, place, seen, own = None, 0, 0, {}
    docs, counts, codes = [], [], []

    def chunk():
        nonlocal place, docs, counts, codes
        out = ("rows", block, place, docs, counts, codes)
        place, docs, counts, codes = place + 1, [], [], []
        return out

    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), texts)):
            if block is None:
                at = f"{batch.column(2)[i].as_py()}:{batch.column(3)[i].as_py()}"
                block, place, seen, own = xxhash.xxh3_64_intdigest(at) - (1 << 63), 0, 0, {}
            words = (text or b"").split()
            got = list(map(get, words))
            if None in got:
                for k, code in enumerate(got):
                    if code is None:
                        got[k] = own.setdefault(words[k], base + len(own))
            docs.append(doc)
            counts.append(len(words))
            codes += got
            seen += len(words)
            if len(codes) >= CHUNK or len(docs) >= CHUNK:
                yield chunk()
            if len(own) >= HELD or seen >= MOST_WORDS:
                if docs:
                    yield chunk()
                yield "words", block, list(own)
                block = None
    if block is not None:
        if docs:
            yield chunk()
        yield "words", block, list(own)


class Ids:
    """Ids and decoded forms of a list of words, by place."""

    def __init__(self, ids: pa.Array, kind: str, table: pa.Array):
        """ids: binary, packed as kind; table: the pieces by id, a space after each."""
        ids = ids.cast(pa.large_binary())
        data = ids.buffers()[2]
        flat = np.frombuffer(data, kind) if data is not None else np.zeros(0, kind)
        ends = np.frombuffer(ids.buffers()[1], "<i8")[ids.offset : ids.offset + len(ids) + 1] // np.dtype(kind).itemsize
        flat = flat[ends[0] : ends[-1]]
        ends = ends - ends[0]
        self.ids = self.cut(flat.astype("<u4").tobytes(), ends * 4)
        found = table.take(pa.array(flat.astype(np.int64)))
        shown = np.frombuffer(found.buffers()[1], "<i8")[: len(flat) + 1] if len(flat) else np.zeros(1, "<i8")
        self.text = self.cut(found.buffers()[2] if len(flat) else b"", shown[ends])

    def then(self, more: Ids) -> Ids:
        """Both lists, one after the other."""
        out = Ids.__new__(Ids)
        out.ids, out.text = pa.concat_arrays([self.ids, more.ids]), pa.concat_arrays([self.text, more.text])
        return out

    @staticmethod
    def cut(data, ends: np.ndarray) -> pa.Array:
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype("<i8").tobytes()), pa.py_buffer(data)])


def laid_out(table: pa.Array, codes: pa.Array, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """(bytes of the coded words end to end, where each text's end)."""
    if not len(codes):
        return memoryview(b""), np.zeros(len(ends), np.int64)
    got = table.take(codes)
    data = got.buffers()[2]
    return memoryview(data if data is not None else b""), np.frombuffer(got.buffers()[1], "<i8")[ends]


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, frequent: int = FREQUENT, stored: bool = False, with_ids: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    stored: docs is a plain scan of Parquet files, whose rows have a place
    (file and row in it) that doesn't depend on the plan; otherwise docs is
    written first.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    if not stored:
        docs = scratch.keep(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text"), "docs")
        id_col, text_col = "doc_id", "text"
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))

    counted = scratch.keep(count_words(docs, "text", least=2), "counts")
    often = counted.where(F.col("n") >= frequency_bound(counted, frequent)).select("word", "n")
    known = packed_table(word_table(often.select("word", "word", "n").toDF("word", "w", "n"), path).select("w", "n", "ids"), [("n", "descending"), ("w", "ascending")])
    scratch.drop("counts")

    def ranks() -> dict[bytes, int]:
        return unpacked_table(known, "ranks", lambda t: {w: i for i, w in enumerate(t.column("w").cast(pa.binary()).to_pylist())})

    def words_of(batches):
        for kind, block, *what in blocks(batches, ranks()):
            if kind == "words" and what[0]:
                n = len(what[0])
                yield pa.RecordBatch.from_arrays([pa.array(what[0], pa.binary()).cast(pa.string()), pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32))], names=["word", "block", "place"])

    def rows_of(batches):
        for kind, block, *what in blocks(batches, ranks()):
            if kind == "rows":
                place, ids, counts, codes = what
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([1], pa.int32()), pa.array([place], pa.int32()), pa.array([squeezed(codes)], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))], names=["block", "what", "place", "data", "docs", "counts"])

    rare = arrow_map(docs, words_of, "word string, block long, place int").repartition(partitions(spark), "word").sortWithinPartitions("word")
    lists = scratch.keep(word_table(rare, path), "lists")  # block, place, ids
    lists = lists.select("block", F.lit(0).alias("what"), "place", F.col("ids").alias("data"), F.lit(None).cast("array<long>").alias("docs"), F.lit(None).cast("array<long>").alias("counts"))
    rows = arrow_map(docs, rows_of, "block long, what int, place int, data binary, docs array<long>, counts array<long>")
    every = rows.unionByName(lists).repartition(partitions(spark), "block").sortWithinPartitions("block", "what", "place")

    def finished(data: bytes, ids: list, counts: list, words: Ids) -> pa.RecordBatch:
        codes, ends = unsqueezed(data), np.cumsum([0, *counts])
        if len(codes) and int(codes.max()) >= len(words.ids):
            raise RuntimeError("a block's words and rows don't fit; the input changed between reads")
        codes = pa.array(codes)
        (wide, at), (text, to) = laid_out(words.ids, codes, ends), laid_out(words.text, codes, ends)
        at, to = at.tolist(), to.tolist()
        columns = [pa.array(ids, pa.int64()), pa.array([(b - a) // 4 for a, b in zip(at, at[1:])], pa.int64()),
                   pa.array([hashlib.sha256(wide[a:b]).hexdigest() for a, b in zip(at, at[1:])]),
                   pa.array([hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(to, to[1:])])]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            flat = np.frombuffer(wide[at[0] : at[-1]], "<u4").astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array([(a - at[0]) // 4 for a in at], pa.int32()), pa.array(flat)))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    def assemble(batches):
        table, kind = pieces(path), id_type(path)  # the vocabulary is loaded where it is used, not by the driver
        common = unpacked_table(known, "ids", lambda t: Ids(t.column("ids").combine_chunks(), kind, table))
        block, held, words = None, [], None
        for batch in batches:
            of, what = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (what[1:] != what[:-1])) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if of[a] != block:
                    block, held, words = of[a], [], None
                if what[a] == 0:
                    held.append(batch.column(3).slice(a, b - a))
                    continue
                if words is None:
                    words, held = common.then(Ids(pa.concat_arrays(held), kind, table)) if held else common, []
                for data, ids, counts in zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in (3, 4, 5))):
                    yield finished(data, ids, counts, words)

    return arrow_map(every, assemble, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), stored=True)
