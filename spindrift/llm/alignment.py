"""Two tokenizations of the same texts, aligned at the byte offsets where both end a token.

A text falls apart at single spaces between other characters: no token of
either vocabulary reaches over such a space, so both tokenize the stretches
between them one by one, and each distinct stretch of a block of rows is
encoded and aligned once. Within a stretch the alignment divides and conquers:
a bisect looks for a token end that both share, nearest to the middle; both
halves go on, and an interval without a shared end is a group. All open
intervals of a block are bisected together, level by level.

Links are counted in three steps. Tasks align blocks of rows and write, per
block, its rows as codes of stretches, the stretches' links as places in the
block's list of id pairs, and that list with counts. Counts then meet by pair
in a shuffle; the highest count of each B id is a table no longer than its
vocabulary. Each pair's total goes back to its place in each block, where
stretches and then rows add up. A pair meets once a block, so frequent pairs
make no hot key, and texts cross no shuffle.

A null or empty text has no tokens; neither has one in which a vocabulary's
tokens don't spell the text (U+2581 stands for a space in B). Null identifiers
are carried along; repeated rows count each. A text of any length is a block of
its own, in its task's memory. An empty table gives an empty result. Only the
two named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, partitions, remembered

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Distinct stretches, and stretches in all, after which a block ends; codes of a chunk; stretches that are encoded in one call.
HELD, SEEN, CHUNK, CALL = 1 << 18, 1 << 22, 1 << 15, 1024
#: A space that no token of either vocabulary covers with what stands before it.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
MARK = "▁"


def tokenizer_a(path: str | None = None):
    """(tokenizer, number of bytes of each id)."""

    def load():
        import public_tokenizers
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY_A))
        out.encode_special_tokens = True
        out.no_truncation()
        out.no_padding()
        # byte-level vocabularies show printable bytes as themselves and the others, in order, from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocabulary = out.get_vocab()
        length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():
            length[i] = sum(c in byte for c in piece)
        return out, length

    return remembered(("alignment a", path), load)


def tokenizer_b(path: str | None = None):
    """(tokenizer, number of bytes of each id)."""

    def load():
        import public_tokenizers
        import sentencepiece

        out = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY_B))
        size = lambda i: 1 if out.is_byte(i) else len(out.id_to_piece(i).replace(MARK, " ").encode())
        return out, np.array([size(i) for i in range(out.get_piece_size())], np.int64)

    return remembered(("alignment b", path), load)


def encoded(stretches: list[str], path_a: str | None = None, path_b: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of A, ids of B, bytes of each stretch and the space before it), end to end."""
    a, b = tokenizer_a(path_a)[0], tokenizer_b(path_b)[0]
    ids_a, ids_b, sizes = [], [], np.array([len(s.encode()) + 1 for s in stretches], np.int64)

    def encode(part: list[str]) -> None:
        text = " ".join(part)
        ids_a.append(np.array(a.encode(" " + text, add_special_tokens=False).ids, np.int64))
        ids_b.append(np.array(b.encode(text), np.int64))

    held: list[str] = []
    for s in stretches:
        alone = not s or s[0].isspace() or s[-1].isspace()
        if held and (alone or len(held) >= CALL):
            encode(held)
            held = []
        if alone:
            encode([s])
        else:
            held.append(s)
    if held:
        encode(held)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + ids_a), np.concatenate(none + ids_b), sizes


def shared_ends(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which tokens of A end where a token of B does. first, last: the tokens of A of each stretch, whose last ends are shared.

    Each open interval is probed by bisect from its middle outwards. Where it
    shares an end it is cut there, and what lies on both sides of the probed
    part goes on; one without a shared end is done.
    """
    cut = np.zeros(len(ends_a), bool)
    cut[last - 1] = True
    low, high = first, last - 1  # an interval's inner ends
    middle = (low + high) // 2
    away = np.zeros(len(low), np.int64)
    while True:
        open_ = (middle - away >= low) | (middle + away < high)
        low, high, middle, away = low[open_], high[open_], middle[open_], away[open_]
        if not len(low):
            return cut
        hit = np.zeros(len(low), bool)
        for probe in (middle - away, middle + away):
            inside = np.flatnonzero((probe >= low) & (probe < high))
            end = ends_a[probe[inside]]
            at = inside[ends_b[np.minimum(np.searchsorted(ends_b, end), len(ends_b) - 1)] == end]
            cut[probe[at]] = True
            hit[at] = True
        go = ~hit
        left, right = (low[hit], middle[hit] - away[hit]), (middle[hit] + away[hit] + 1, high[hit])
        new_low, new_high = np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]])
        kept = new_low < new_high
        new_low, new_high = new_low[kept], new_high[kept]
        low, high = np.concatenate([low[go], new_low]), np.concatenate([high[go], new_high])
        away = np.concatenate([away[go] + 1, np.zeros(len(new_low), np.int64)])
        middle = np.concatenate([middle[go], (new_low + new_high) // 2])


def decimals(path_a: str | None = None, path_b: str | None = None) -> tuple[pa.Array, int, int]:
    """Ids as decimals with what follows them: of A a comma or a bar, of B a comma or a semicolon; where B's begin; B's number."""

    def load():
        n_a, n_b = len(tokenizer_a(path_a)[1]), len(tokenizer_b(path_b)[1])
        forms = [f"{i}{mark}".encode() for n, marks in ((n_a, ",|"), (n_b, ",;")) for mark in marks for i in range(n)]
        return pa.array(forms, pa.large_binary()), n_a, n_b

    return remembered(("alignment decimals", path_a, path_b), load)


class Aligned:
    """Of each stretch: n_a, n_b, n_groups, n_links, its links (bounds into a and b) and its groups' text with a semicolon."""

    def __init__(self, stretches: list[str], path_a: str | None = None, path_b: str | None = None):
        ids_a, ids_b, sizes = encoded(stretches, path_a, path_b)
        ends_a, ends_b, ends = np.cumsum(tokenizer_a(path_a)[1][ids_a]), np.cumsum(tokenizer_b(path_b)[1][ids_b]), np.cumsum(sizes)
        last_a, last_b = np.searchsorted(ends_a, ends, "right"), np.searchsorted(ends_b, ends, "right")
        if len(ends) and not (len(ends_a) and len(ends_b) and (ends_a[last_a - 1] == ends).all() and (ends_b[last_b - 1] == ends).all()):
            raise ValueError("a token reaches over the end of a stretch")
        first_a, first_b = np.concatenate([[0], last_a])[:-1], np.concatenate([[0], last_b])[:-1]
        self.n_a, self.n_b = last_a - first_a, last_b - first_b
        cut_a = shared_ends(ends_a, ends_b, first_a, last_a) if len(ends) else np.zeros(0, bool)
        cuts = ends_a[cut_a]
        groups = np.searchsorted(cuts, ends, "right")
        self.n_groups = np.diff(groups, prepend=0)
        # between two neighbouring ends of either side lies the overlap of one token of A and one of B
        parts = np.union1d(ends_a, ends_b)
        self.a, self.b = ids_a[np.searchsorted(ends_a, parts)], ids_b[np.searchsorted(ends_b, parts)]
        self.links = np.concatenate([[0], np.searchsorted(parts, ends, "right")])
        self.n_links = np.diff(self.links)
        # a group's tokens of A stand before its tokens of B
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        to_a, to_b = np.searchsorted(group_a, np.arange(len(cuts)), "right"), np.searchsorted(group_b, np.arange(len(cuts)), "right")
        table, of_a, of_b = decimals(path_a, path_b)
        order = np.zeros(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + np.concatenate([[0], to_b])[group_a]] = ids_a + of_a * cut_a
        order[np.arange(len(ids_b)) + to_a[group_b]] = ids_b + 2 * of_a + of_b * np.isin(ends_b, cuts, assume_unique=True)
        shown = table.take(pa.array(order))
        at = np.frombuffer(shown.buffers()[1], "<i8")[: len(order) + 1] if len(order) else np.zeros(1, "<i8")
        bounds = at[np.concatenate([[0], last_a + last_b])].astype("<i8")
        data = shown.buffers()[2] if len(order) else pa.py_buffer(b"")
        self.text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds.tobytes()), data])


def squeezed(values: np.ndarray) -> bytes:
    """Numbers below 2^32 by planes of bytes, compressed: their number, then the planes from the lowest byte up."""
    planes = values.astype("<u4").view("u1").reshape(-1, 4).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=4 * n, codec="zstd", asbytes=True) if n else b""
    return np.frombuffer(planes, "u1").reshape(4, n).T.copy().view("<u4").reshape(-1).astype(np.int64)


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of values, the sum of each stretch of the given length."""
    ends = np.cumsum(lengths)
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[ends] - total[ends - lengths]


#: Rows of a block: PAIRS its id pairs and how often they are linked, LINKS the links of its stretches by place in PAIRS, ROWS.
PAIRS, LINKS, ROWS = 0, 1, 2
BLOCK = "block long, what int, place long, docs array<long>, facts array<long>, shas array<string>, groups array<string>, sizes binary, data binary, counts binary"


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, with_groups: bool = False, held: int = HELD, scratch: Scratch | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups if asked for."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def rows_of(block, what, place, docs=None, facts=None, shas=None, groups=None, sizes=None, data=None, counts=None):
        longs, strings = pa.list_(pa.int64()), pa.list_(pa.string())
        kinds = [pa.int64(), pa.int32(), pa.int64(), longs, longs, strings, strings, pa.binary(), pa.binary(), pa.binary()]
        values = [block, what, place, docs, facts, shas, groups, sizes, data, counts]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[f.split()[0] for f in BLOCK.split(", ")])

    def finished(block: int, own: dict[str, int], ids: list, codes: list[list[int]]):
        """The rows of a block."""
        found = Aligned(list(own), path_a, path_b)
        flat, lengths = np.array([c for row in codes for c in row], np.int64), np.array([len(row) for row in codes], np.int64)
        key, place = np.unique(found.a << 32 | found.b, return_inverse=True)
        counts = np.zeros(len(key), np.int64)
        np.add.at(counts, place, np.repeat(np.bincount(flat, minlength=len(own)), found.n_links))
        for i in range(0, len(key), CHUNK):
            yield rows_of(block, PAIRS, i, data=key[i : i + CHUNK].astype("<i8").tobytes(), counts=counts[i : i + CHUNK].astype("<i8").tobytes())
        for i in range(0, len(own), CHUNK):
            part = slice(int(found.links[i]), int(found.links[min(i + CHUNK, len(own))]))
            yield rows_of(block, LINKS, i, sizes=squeezed(found.n_links[i : i + CHUNK]), data=squeezed(place[part]))
        first, start, waiting = 0, 0, 0
        numbers = [found.n_a, found.n_b, found.n_groups, found.n_links]
        for i, n in enumerate(lengths.tolist()):
            waiting += n
            if i + 1 < len(lengths) and waiting < CHUNK and i + 1 - first < CHUNK:
                continue
            of = lengths[first : i + 1]
            part = flat[start : start + of.sum()]
            facts = np.stack([sums(v[part], of) for v in numbers], 1) if len(part) else np.zeros((len(of), 4), np.int64)
            shown = found.text.take(pa.array(part))
            bounds = np.frombuffer(shown.buffers()[1], "<i8")[np.concatenate([[0], np.cumsum(of)])].tolist() if len(part) else [0] * (len(of) + 1)
            view = memoryview(shown.buffers()[2]) if len(part) else memoryview(b"")
            texts = [view[a : b - 1] if b > a else None for a, b in zip(bounds, bounds[1:])]
            shas = ["" if t is None else hashlib.sha256(t).hexdigest() for t in texts]
            groups = ["" if t is None else bytes(t).decode() for t in texts] if with_groups else None
            yield rows_of(block, ROWS, first, docs=ids[first : i + 1], facts=facts.reshape(-1).tolist(), shas=shas, groups=groups, sizes=squeezed(of), data=squeezed(part))
            first, start, waiting = i + 1, start + len(part), 0

    def blocks(batches):
        number = (TaskContext.get().partitionId() << 32) if TaskContext.get() else 0
        own, ids, codes, seen = {}, [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = BETWEEN.split(text) if text and MARK not in text else []
                ids.append(doc)
                codes.append([own.setdefault(p, len(own)) for p in parts])
                seen += len(parts)
                if len(own) >= held or seen >= SEEN or len(ids) >= SEEN:
                    yield from finished(number, own, ids, codes)
                    number, own, ids, codes, seen = number + 1, {}, [], [], 0
        if ids:
            yield from finished(number, own, ids, codes)

    kept = scratch.keep(arrow_map(docs, blocks, BLOCK), "blocks")

    def listed(batches):
        for batch in batches:
            for block, place, data, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                key, n = np.frombuffer(data, "<i8"), np.frombuffer(counts, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block)), pa.array(place + np.arange(len(key))), pa.array(key), pa.array(n)], names=["block", "place", "pair", "n"])

    pairs = arrow_map(kept.where(F.col("what") == PAIRS).select("block", "place", "data", "counts"), listed, "block long, place long, pair long, n long")
    totals = scratch.keep(pairs.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1)), "totals")
    best = totals.groupBy("b").agg(F.max("total").alias("most"))  # a row for each id of B at most
    facts = totals.join(F.broadcast(best), "b").select("pair", (F.col("total") * 2 + (F.col("total") == F.col("most")).cast("long")).alias("fact"))
    back = pairs.select("block", "place", "pair").join(facts, "pair").select("block", F.lit(PAIRS).alias("what"), "place", F.col("fact"))
    rest = kept.where(F.col("what") != PAIRS).drop("counts").withColumn("fact", F.lit(None).cast("long"))
    every = rest.unionByName(back, allowMissingColumns=True).repartition(partitions(spark), "block").sortWithinPartitions("block", "what", "place")
    every = every.select("block", "what", "fact", "docs", "facts", "shas", "groups", "sizes", "data")

    def assemble(batches):
        block, facts, total, top = None, [], None, None
        for batch in batches:
            of, what = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (what[1:] != what[:-1])) + 1).tolist(), len(of)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if of[i] != block:
                    block, facts, total, top = of[i], [], [], []
                if what[i] == PAIRS:
                    facts.append(batch.column(2).slice(i, j - i).to_numpy())
                    continue
                fact = facts[0] if len(facts) == 1 else np.concatenate(facts) if facts else np.zeros(0, np.int64)
                facts = [fact]
                for docs, numbers, shas, groups, sizes, data in zip(*(batch.column(c).slice(i, j - i).to_pylist() for c in range(3, 9))):
                    values, lengths = unsqueezed(data), unsqueezed(sizes)
                    if what[i] == LINKS:
                        total.append(sums(fact[values] >> 1, lengths))
                        top.append(sums(fact[values] & 1, lengths))
                        continue
                    if len(total) != 1:
                        total, top = ([np.concatenate(v) if v else np.zeros(0, np.int64)] for v in (total, top))
                    numbers = np.array(numbers, np.int64).reshape(-1, 4)
                    columns = [pa.array(docs, pa.int64()), *(pa.array(numbers[:, k]) for k in range(4)), pa.array(sums(top[0][values], lengths)), pa.array(sums(total[0][values], lengths)), pa.array(shas, pa.string())]
                    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
                    if with_groups:
                        columns, names = [*columns, pa.array(groups, pa.string())], [*names, "groups"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return arrow_map(every, assemble, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_groups)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
