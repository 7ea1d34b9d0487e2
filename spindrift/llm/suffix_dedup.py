"""Removal of byte strings that occur elsewhere too, by suffix arrays.

Texts are dealt to shards by content, so that equal strings of SIZE bytes meet.
The key of such a string is the least hash of the GRAM-byte strings in it;
neighbouring starts share it, and a piece is such a stretch of starts with the
bytes that they cover. A key that stands in one place only can't repeat and
goes no further. Pieces alike byte by byte are counted and sent once.

A shard joins its pieces to one text and sorts its suffixes by induction:
suffixes are classified, leftmost-smaller substrings are sorted by inducing
their order bucket by bucket, named, and the string of names is sorted in its
turn (by doubling of ranks among those still tied, as its alphabet is too large
for buckets); their order induces the shard's array in linear time, a bucket
of bytes a step. The common prefix of each start with the start before it in
the array is then computed in text order, where it follows its diagonal; starts
with SIZE bytes in common are one string, and one with more than one place
repeats.

A key with many different pieces (a passage in ever different surroundings) is
dealt out to several shards; each passes on one row for each string it holds,
by a hash of its bytes, and those that other shards hold too repeat as well.
So no key meets in one task, and nothing is dropped.

Texts are UTF-8 bytes, null ones empty; matches never cross documents, and
strings are judged on the input. Null identifiers are carried along; repeated
rows repeat in full; texts shorter than SIZE stay. Long texts are cut in
stretches of CUT starts. An empty table gives an empty result. Only the two
named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, partitions

#: Bytes of a string; bytes of the strings whose least hash is its key (a power of two).
SIZE, GRAM = 400, 128
#: Bytes that are looked at together; starts in a piece; bytes of a shard; different pieces of a key in a shard. A worker holds
#: some 60 bytes for each byte looked at and 40 for each of a shard, which may pass its size by a key's pieces.
CUT, PIECE, SHARD, MEET = 1 << 18, 512, 1 << 20, 4096
#: Bytes that common_prefixes compares at a time.
COMPARED = 1 << 20
#: Rows in a batch to Spark.
ROWS = 50_000


def slid(x: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum, np.maximum) over width entries from each on."""
    reach = 1
    while 2 * reach <= width:
        x, reach = least(x[:-reach], x[reach:]), 2 * reach
    return least(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


def hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """Of each string of gram bytes."""
    rng = np.random.default_rng(7)
    h = rng.integers(0, 1 << 64, 256, dtype=np.uint64)[text]
    factor, reach = int(rng.integers(0, 1 << 62)) * 2 + 1, 1
    while reach < gram:
        h = h[:-reach] * np.uint64(factor) + h[reach:]
        factor, reach = factor * factor % (1 << 64), reach * 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def pieces(data: bytes, bounds: list[tuple[int, int]], size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(key, first start, end of starts, places where the key's string stands) of the pieces of the texts data[a:b]."""
    width = size - gram + 1
    h = hashes(np.frombuffer(data, np.uint8), gram)
    least = slid(h, width, np.minimum)
    valid = np.zeros(len(least) + 1, bool)
    for a, b in bounds:
        valid[a : b - size + 1] = True
    valid = valid[:-1]
    # the places whose string is a key: their hash is the greatest of the least hashes around them
    around = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    around[width - 1 : width - 1 + len(least)] = np.where(valid, least, np.uint64(0))
    places = np.flatnonzero(h == slid(around, width, np.maximum)[: len(h)])
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    for a, _ in bounds:
        new[a : a + 1] = True
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(least))
    first, end = first[valid[first]], end[valid[first]]
    parts = -(-(end - first) // PIECE)
    if len(parts) and parts.max() > 1:
        of = np.repeat(np.arange(len(first)), parts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        first, end = first[of] + nth * PIECE, np.minimum(end[of], first[of] + (nth + 1) * PIECE)
    key = least[first]
    # each place counts for the last piece before it that has its key
    counts, piece = np.zeros(len(first), np.int64), np.searchsorted(first, places, "right") - 1
    while len(places):
        hit = key[piece] == h[places]
        np.add.at(counts, piece[hit], 1)
        places, piece = places[~hit], piece[~hit] - 1
        places, piece = places[piece >= 0], piece[piece >= 0]
    return key.view(np.int64), first, end, np.maximum(counts, 1)


# suffix arrays ---------------------------------------------------------------------------------------------------------------


def _dealt(text: np.ndarray, entries: np.ndarray, char: int, upwards: bool, queues: list[list[np.ndarray]]) -> None:
    """Put what stands before each entry, in their order, into the queue of its byte, if that lies beyond char."""
    before = entries[entries > 0] - 1
    chars = text[before]
    beyond = chars > char if upwards else chars < char
    before, chars = before[beyond], chars[beyond]
    order = np.argsort(chars, kind="stable")
    before, counts = before[order], np.bincount(chars, minlength=256)
    ends = np.cumsum(counts)
    for c in np.flatnonzero(counts).tolist():
        queues[c].append(before[ends[c] - counts[c] : ends[c]])


def _grown(text: np.ndarray, entries: list[np.ndarray], char: int) -> np.ndarray:
    """Entries of a bucket with those that they induce in the bucket itself, generation by generation."""
    if not entries:
        return np.zeros(0, np.int32)
    newest = np.concatenate(entries)
    out = [newest]
    while len(newest):
        newest = newest[newest > 0] - 1
        newest = newest[text[newest] == char]
        out.append(newest)
    return np.concatenate(out)


def induced(text: np.ndarray, sorted_lms: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Buckets of the larger and of the smaller suffixes (those from the right), in order, from leftmost-smaller ones in order."""
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    large[text[-1]].append(np.array([len(text) - 1], np.int32))  # before it stands the end, the least of all
    heads = text[sorted_lms]
    order = np.argsort(heads, kind="stable")
    ends = np.cumsum(np.bincount(heads, minlength=256))
    sorted_lms = sorted_lms[order]
    out_large, out_small = [], []
    for c in range(256):
        bucket = _grown(text, large[c], c)
        out_large.append(bucket)
        stars = sorted_lms[ends[c - 1] if c else 0 : ends[c]]
        if len(bucket) or len(stars):
            _dealt(text, np.concatenate([bucket, stars]), c, True, large)
    small: list[list[np.ndarray]] = [[] for _ in range(256)]
    for c in range(255, -1, -1):
        bucket = _grown(text, small[c], c)
        out_small.append(bucket[::-1])
        if len(bucket) or len(out_large[c]):
            _dealt(text, np.concatenate([bucket, out_large[c][::-1]]), c, False, small)
    return out_large, out_small[::-1]


def words_at(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as a number, zeros beyond the end."""
    out, reach = np.append(text, np.zeros(8, np.uint8)).astype(np.uint64), 1
    while reach < 8:
        moved = out[:-reach] << np.uint64(8 * reach)
        moved |= out[reach:]
        out[:-reach] = moved
        reach *= 2
    return out[: len(text)]


def _names(words: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Names, in order, of sorted substrings: whether each differs from the one before, added up. A length of 0: like no other."""
    same = np.flatnonzero((length[1:] == length[:-1]) & (length[1:] > 0))
    equal = np.zeros(len(at), bool)
    done = 0
    while len(same):
        left = np.minimum(length[same + 1] - done, 8).astype(np.uint64)
        shift = np.uint64(8) * (np.uint64(8) - left)
        hit = (words[at[same] + done] >> shift) == (words[at[same + 1] + done] >> shift)
        same, done = same[hit], done + 8
        over = length[same + 1] <= done
        equal[same[over] + 1] = True
        same = same[~over]
    return np.cumsum(~equal) - 1


def _ranked(names: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Order of the suffixes of the string of names, to size bytes at least; what is alike there stays in text order.

    Ranks of a suffix and of those 1 (and 2) reaches on are one number, by which those still tied are sorted anew.
    """
    n = len(names)
    bits = int(n + 1).bit_length()
    parts = min(63 // bits, 3)
    rank, reach, tied = np.append(names.astype(np.int64) + 1, 0), 1, np.arange(n)  # the end ranks first
    while True:
        alike = np.bincount(rank[tied], minlength=n + 2)[rank[tied]] > 1
        tied = tied[alike]
        tied = tied[at[np.minimum(tied + reach, n - 1)] - at[tied] < size]
        if not len(tied) or reach > n:
            return np.argsort(rank[:n], kind="stable")
        key = rank[tied]
        for k in range(1, parts):
            key = key << bits | rank[np.minimum(tied + k * reach, n)]
        order = np.argsort(key)
        key = key[order]
        group = key >> bits * (parts - 1)
        place = np.arange(len(key))
        start = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), place, 0))
        new = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), place, 0))
        rank[tied[order]] = group + new - start  # ranks leave room for their group, so only those still tied move
        reach *= parts


def leftmost_smaller(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes that are smaller than the next one, where the one before is not."""
    runs = np.append(0, np.flatnonzero(text[1:] != text[:-1]) + 1).astype(np.int32)
    heads = text[runs]
    smaller = np.append(heads[:-1] < heads[1:], False)
    return runs[1:][smaller[1:] & ~smaller[:-1]]


def _named(text: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Of each leftmost-smaller substring, in text order, its name: the place of its group's first, so that ranks leave room."""
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    by_substring = np.concatenate([b[is_lms[b]] for b in induced(text, lms)[1]])
    by_substring = np.searchsorted(lms, by_substring).astype(np.int32)
    length = np.append(np.diff(lms) + 1, 0).astype(np.int32)
    sorted_names = _names(words_at(text), lms[by_substring], length[by_substring])
    first = np.flatnonzero(np.append(True, sorted_names[1:] != sorted_names[:-1]))
    names = np.zeros(len(lms), np.int32)
    names[by_substring] = first[sorted_names]
    return names


def suffix_array(text: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Places of text in the order of their suffixes, compared to size bytes at least."""
    if len(text) < 2:
        return np.arange(len(text), dtype=np.int32)
    lms = leftmost_smaller(text)
    if len(lms):
        lms = lms[_ranked(_named(text, lms), lms, size)]
    large, small = induced(text, lms)
    return np.concatenate([b for pair in zip(large, small) for b in pair])


def common_prefixes(text: np.ndarray, array: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Of each entry of the array (starts with size bytes after them), how many bytes it has in common with the entry before
    it, size at most, or 0 if it is less and a few words show that. Computed in text order: neighbours on one diagonal share
    their comparisons."""
    out = np.zeros(len(array), np.int32)
    words = words_at(text)
    place = np.arange(1, len(array), dtype=np.int32)
    for k in (0, size - 8, (size - 8) // 2) if size >= 8 else ():
        place = place[words[array[place] + k] == words[array[place - 1] + k]]  # others have less than size in common
    del words
    place = place[np.argsort(array[place])]
    here, there = array[place], array[place - 1]
    turns = np.append(True, (np.diff(here) != 1) | (np.diff(here - there) != 0))[: len(place)]  # a diagonal begins
    cost = np.cumsum(1 + (size - 1) * turns, dtype=np.int64)  # bytes to compare: a start's own, and a diagonal's tail
    lo = 0
    while lo < len(place):  # some diagonals at a time
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + COMPARED, "right")))
        p, y, x = place[lo:hi], here[lo:hi].astype(np.int64), there[lo:hi].astype(np.int64)
        new = turns[lo:hi].copy()
        new[0], lo = True, hi
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(y))) + size - 1
        start = np.cumsum(length) - length
        of = np.repeat(np.arange(len(first)), length)
        at = np.arange(len(of)) - start[of] + y[first][of]
        differ = np.append(np.flatnonzero(text[at] != text[at - (y - x)[first][of]]), len(at) + size)
        mine = start[np.cumsum(new) - 1] + (y - y[first][np.cumsum(new) - 1])
        out[p] = np.minimum(size, differ[np.searchsorted(differ, mine)] - mine)
    return out


# in Spark --------------------------------------------------------------------------------------------------------------------


def shard(texts: list[bytes], weights: list[int], size: int = SIZE) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of pieces and the number of their copies: which starts of each repeat; and of each different string its first piece, the
    start in it and its number of places."""
    lengths = np.array([len(t) for t in texts], np.int64)
    text = np.frombuffer(b"".join(texts), np.uint8)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    at = np.arange(len(text), dtype=np.int32) - (np.cumsum(lengths) - lengths).astype(np.int32)[of]
    array = suffix_array(text, size)
    array = array[(at <= lengths[of] - size)[array]]
    group = np.cumsum(common_prefixes(text, array, size) < size) - 1 if len(array) else np.zeros(0, np.int64)
    places = np.bincount(group, weights=np.array(weights, np.float64)[of[array]]).astype(np.int64) if len(array) else np.zeros(0, np.int64)
    repeats = np.zeros(len(text), bool)
    repeats[array] = places[group] > 1
    ends = np.cumsum(lengths)
    found = [repeats[e - n : e - size + 1] for e, n in zip(ends.tolist(), lengths.tolist())]
    one = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(array) else np.zeros(0, np.int64)
    return found, (of[array[one]], at[array[one]], places)


def runs_of(flags: np.ndarray) -> np.ndarray:
    """(start, end) of each stretch of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges.reshape(-1, 2)


def decided_rows(rows: list[tuple], size: int = SIZE):
    """Of a shard's pieces (key, d1, d2, copies, parts, part, bytes): stretches of starts that repeat, and of a key in several
    shards each different string by its hash, in batches of ROWS."""
    repeats, (of, at, places) = shard([r[6] for r in rows], [r[3] for r in rows], size)
    ids = np.array([r[:3] for r in rows], np.int64)

    def batch(which, *columns):
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
        columns = [ids[which, k] for k in range(3)] + [[None] * len(which) if c is None else c for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "d1", "d2", "runs", "s1", "s2", "at", "n"])

    found = [(i, runs.astype("<u4").tobytes()) for i, flags in enumerate(repeats) if len(runs := runs_of(flags))]
    if found:
        yield batch(np.array([i for i, _ in found]), [runs for _, runs in found], None, None, None, None)
    hot = np.array([r[4] > 1 for r in rows], bool)[of]
    of, at, places = of[hot], at[hot], places[hot]
    for lo in range(0, len(of), ROWS):
        i, a = of[lo : lo + ROWS], at[lo : lo + ROWS].astype(np.int64)
        strings = np.frombuffer(b"".join([xxhash.xxh3_128_digest(rows[k][6][x : x + size]) for k, x in zip(i.tolist(), a.tolist())]), "<i8").reshape(-1, 2)
        yield batch(i, None, strings[:, 0], strings[:, 1], a, places[lo : lo + ROWS])


def repeated_spans(docs: DataFrame, scratch: Scratch, size: int = SIZE, gram: int = GRAM, meet: int = MEET) -> DataFrame:
    """docs: file, row, text, in stored tables. file, row, starts: pieces with repeated starts, as place and stretches in it (32
    bits each). A row a document that has any."""
    spark = docs.sparkSession
    width = partitions(spark)

    def found(batches):
        held, bounds, of, at = [], [], [], 0

        def passed():
            data = b"".join(held)
            key, first, end, counts = pieces(data, bounds, size, gram)
            view = memoryview(data)
            digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(first.tolist(), (end + size - 1).tolist())]), "<i8").reshape(-1, 2)
            text = np.searchsorted([b for _, b in bounds], first, "right")
            file, row, shift = (np.array(x, np.int64)[text] for x in zip(*of)) if len(first) else [np.zeros(0, np.int64)] * 3
            columns = [key, digests[:, 0].copy(), digests[:, 1].copy(), file, row, first + shift, end - first, counts]
            for i in range(0, len(key), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + ROWS].astype(np.int64)) for c in columns], names=["key", "d1", "d2", "file", "row", "start", "starts", "places"])

        for batch in batches:
            for file, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (t.as_py() for t in batch.column(2).cast(pa.binary()))):
                if text is None or len(text) < size:
                    continue
                for i in range(0, len(text) - size + 1, CUT):
                    part = text[i : i + CUT + size - 1]
                    held.append(part)
                    bounds.append((at, at + len(part)))
                    of.append((file, row, i - at))
                    at += len(part)
                    if at >= CUT:
                        yield from passed()
                        held.clear(), bounds.clear(), of.clear()
                        at = 0
        if held:
            yield from passed()

    names = ["key", "d1", "d2"]
    every = scratch.keep(arrow_map(docs.select("file", "row", "text"), found, "key long, d1 long, d2 long, file long, row long, start long, starts long, places long"), "pieces")
    keys = every.groupBy("key").agg(F.sum("places").alias("all")).where("all > 1").select("key")
    every = scratch.keep(every.join(keys, "key").drop("places"), "live")
    scratch.drop("pieces")
    one = scratch.keep(every.groupBy(*names).agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("file", "row", "start", "starts")]), "alike")
    kinds = one.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / meet).alias("parts"))
    of_doc = one.join(kinds, "key").groupBy("file", "row").agg(F.collect_list(F.struct(*names, "copies", "start", "starts", "parts")).alias("pieces"))
    cut = docs.select("file", "row", F.col("text").cast("binary").alias("text")).join(of_doc, ["file", "row"])
    cut = cut.select(F.explode(F.transform("pieces", lambda p: F.struct(*[p[c].alias(c) for c in (*names, "copies", "parts")], F.substring("text", (p["start"] + 1).cast("int"), (p["starts"] + size - 1).cast("int")).alias("bytes")))).alias("p")).select("p.*")
    cut = scratch.keep(cut.withColumn("part", F.pmod(F.xxhash64("d1", "d2"), "parts")), "cut")
    scratch.drop("alike")
    cut = cut.repartition(width, "key", "part").sortWithinPartitions("key", "part", "d1", "d2")

    def sorted_out(batches):
        """Shards end between keys (or a key's parts), where they are full."""
        rows, filled, last = [], 0, None

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]  # key, d1, d2, copies, parts, bytes, part
            for *ids, copies, parts, data, part in zip(*columns):
                if (ids[0], part) != last:
                    if filled >= SHARD:
                        yield from decided_rows(rows, size)
                        rows, filled = [], 0
                    last = ids[0], part
                rows.append((*ids, copies, parts, part, data))
                filled += len(data)
        if rows:
            yield from decided_rows(rows, size)

    decided = scratch.keep(arrow_map(cut, sorted_out, "key long, d1 long, d2 long, runs binary, s1 long, s2 long, at long, n long"), "decided")
    scratch.drop("cut")
    # strings of keys in several shards: one row a shard and string
    several = decided.where("s1 is not null")
    more = several.groupBy("key", "s1", "s2").agg(F.sum("n").alias("total")).where("total > 1")
    alone = several.where("n = 1").join(more, ["key", "s1", "s2"]).select(*names, F.concat(_flipped(F.col("at")), _flipped(F.col("at") + 1)).alias("runs"))
    runs = decided.where("runs is not null").select(*names, "runs").unionByName(alone)
    met = every.select(*names, "file", "row", "start").join(runs, names)
    return met.groupBy("file", "row").agg(F.collect_list(F.struct("start", "runs")).alias("starts"))


def _flipped(number) -> F.Column:
    """A number below 2^32 as four bytes, the lowest first."""
    wide = F.lpad(F.hex(number), 8, "0")
    return F.unhex(F.concat(*[F.substring(wide, i, 2) for i in (7, 5, 3, 1)]))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, meet: int = MEET, stored: bool = False, with_kept: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end of what goes) and, if
    asked for, kept (the bytes that stay). stored: docs is a plain scan of Parquet files; otherwise it is written first."""
    scratch = Scratch(docs.sparkSession)
    if not stored:
        docs = scratch.keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "docs")
        id_col, text_col = "doc_id", "text"
    docs = docs.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    starts = scratch.keep(repeated_spans(docs, scratch, size, gram, meet), "starts")
    scratch.drop("live", "decided")
    both = docs.join(starts, ["file", "row"], "left").select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), F.col("starts.start").alias("start"), F.col("starts.runs").alias("runs"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, start, runs in zip(*(batch.column(i).to_pylist() for i in range(4))):
                spans = merged(start, runs, size) if start else []
                edges = [0, *(x for s in spans for x in s), len(text)]
                parts = [text[a:b] for a, b in zip(edges[::2], edges[1::2])]
                digest = hashlib.sha256()
                for p in parts:
                    digest.update(p)
                out.append((doc, len(text), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [{"start": a, "end": b} for a, b in spans], b"".join(parts) if with_kept else None))
            kinds = [pa.int64()] * 4 + [pa.string(), span] + [pa.binary()] * with_kept
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: len(kinds)])

    return arrow_map(both, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + ", kept binary" * with_kept)


def merged(start: list[int], runs: list[bytes], size: int) -> list[tuple[int, int]]:
    """The maximal stretches of bytes that strings of size bytes cover which begin in the given stretches of starts."""
    of = np.repeat(np.array(start, np.int64), [len(r) // 8 for r in runs])
    both = np.frombuffer(b"".join(runs), "<u4").reshape(-1, 2).astype(np.int64) + of[:, None]
    both = both[np.argsort(both[:, 0], kind="stable")]
    low, high = both[:, 0], np.maximum.accumulate(both[:, 1] - 1 + size)
    new = np.append(True, low[1:] > high[:-1])
    first = np.flatnonzero(new)
    return list(zip(low[first].tolist(), high[np.append(first[1:], len(low)) - 1].tolist()))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), stored=True)
    return out.drop("spans")


#: Every string of SIZE bytes by its hash (64 bits), on texts in hexadecimal.
ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
c AS MATERIALIZED (SELECT r, s, substr(h, 2 * s + 1, {2 * (511 + SIZE)}) AS part FROM (SELECT r, h, unnest(range(0, len(h) // 2 - {SIZE - 1}, 512)) AS s FROM d WHERE len(h) >= {2 * SIZE})),
w AS MATERIALIZED (SELECT r, s + k AS s, hash(substr(part, 2 * k + 1, {2 * SIZE})) AS m FROM (SELECT r, s, part, unnest(range(0, len(part) // 2 - {SIZE - 1})) AS k FROM c)),
f AS (SELECT r, s FROM w JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
g AS (SELECT r, s, sum(CASE WHEN s > last + {SIZE} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS k
      FROM (SELECT r, s, coalesce(lag(s) OVER (PARTITION BY r ORDER BY s), s) AS last FROM f)),
p AS (SELECT r, k, min(s) AS a, max(s) + {SIZE} AS b FROM g GROUP BY r, k),
q AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM p),
t AS (SELECT r, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM q JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""
