"""Tables of distinct words, and their split into a bounded frequent part and the rest.

A word's frequency decides how rows meet it: the frequent words, at most a
fixed number, are few enough to send to every task; the rest occur seldom each,
so joining them by shuffle meets no hot key. Both ways cover every word. The
number is far below the distinct words of any corpus worth a cluster, so the
split doesn't move with the size of the input.

Nulls and empty texts have no words; repeated rows count each; a text of any
length is split in its task; an empty table gives empty tables.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, remembered

#: Frequent words at most: a bound on what is sent to every task (some MB), whatever the corpus.
FREQUENT = 1 << 18
#: Distinct words that a task holds before it passes their counts on.
HELD = 500_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def count_words(docs: DataFrame, text_col: str, lower: bool = False, least: int = 1) -> DataFrame:
    """word, n: all distinct words of all texts. Tasks count locally, then counts meet by word.

    With least above 1, counts below it stay in their task: enough to tell
    which words are frequent, with few rows to shuffle.
    """

    def run(batches):
        counts: Counter = Counter()

        def passed():
            found = [(w, k) for w, k in counts.items() if k >= least]
            words, n = [w for w, _ in found], [k for _, k in found]
            for i in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000], pa.binary()).cast(pa.string()), pa.array(n[i : i + 50_000], pa.int64())], names=["word", "n"])
            counts.clear()

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                if text:
                    counts.update((text.translate(LOWER) if lower else text).split())
            if len(counts) > HELD:
                yield from passed()
        yield from passed()

    return arrow_map(docs.select(text_col), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequency_bound(table: DataFrame, most: int = FREQUENT) -> int:
    """The least count that most words at most have. Counts are binned, so the driver gets some hundred rows."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8)
    bins = table.groupBy(step.alias("bin")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()
    total, least = 0, None
    for b in sorted(bins, key=lambda b: -b["bin"]):
        if total + b["words"] > most:
            break
        total, least = total + b["words"], b["least"]
    return least if least is not None else 1 << 62


def sent(rows: DataFrame, order: list | None = None) -> list[pa.Array]:
    """The columns of a table whose size is bounded by FREQUENT."""
    table = rows.toArrow()
    if order:
        table = table.sort_by(order)
    return [c.combine_chunks() for c in table.columns]


def pack(columns: list[pa.Array], names: list[str] | None = None) -> tuple[str, bytes]:
    """A name of its own and the bytes of an Arrow stream."""
    table = pa.table(columns, names=names or [str(i) for i in range(len(columns))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return uuid.uuid4().hex, sink.getvalue().to_pybytes()


def packed_table(rows: DataFrame, order: list) -> Broadcast:
    """A table bounded by FREQUENT, sent as the bytes of an Arrow stream: the driver never holds its rows as objects."""
    table = rows.toArrow().sort_by(order)
    return rows.sparkSession.sparkContext.broadcast(pack(table.columns, table.column_names))


def unpacked_table(sent_bytes: Broadcast, form: str, build: Callable[[pa.Table], object]):
    """What build makes of a packed table, once in a Python worker; it keeps the last one of each form."""
    last = remembered(("last packed table", form), dict)
    name, data = sent_bytes.value
    if name not in last:
        last.clear()
        last[name] = build(pa.ipc.open_stream(data).read_all())
    return last[name]
