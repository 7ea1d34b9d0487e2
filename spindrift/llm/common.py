"""What the corpus operators share: the shared scratch folder, Arrow stages, distributed numbering."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.scratch import Scratch as Tables

#: A word, in Java's, DuckDB's and Python's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows in an Arrow batch, Spark's setting for them and its default.
BATCH_ROWS, ARROW_ROWS, DEFAULT_ROWS = 500, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def short_batches(spark: SparkSession) -> None:
    """Texts may be long, so Arrow batches are short, unless the caller has chosen a length. A result is evaluated after the
    operator returns, so this one setting of the session stays."""
    if spark.conf.get(ARROW_ROWS, DEFAULT_ROWS) == DEFAULT_ROWS:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))


class Scratch(Tables):
    """Tables in the shared folder, for operators on texts."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark)
        short_batches(spark)


def remembered(key, make: Callable):
    """What make() gives, made once in the life of a Python worker, which outlives its tasks. The library's functions
    travel by value, so a module's own variables would begin anew in each task."""
    store = sys.modules.setdefault("_spindrift_remembered", {})
    if key not in store:
        store[key] = make()
    return store[key]


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of keys up to which a stored table may be sent around for a join.
SENT_ROWS = 1 << 17


def met(df: DataFrame) -> DataFrame:
    """A stored table as a join's side. Spark goes by the size of its files, which may be a tenth of its rows', so a table of
    more than SENT_ROWS rows, which their files tell, is met by sorting instead of passing through the driver."""
    return df if df.count() <= SENT_ROWS else df.hint("merge")


def positional(df: DataFrame) -> DataFrame:
    """Columns c0, c1, ...: names of a caller's extra columns can't clash with ours."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def column_at(df: DataFrame, name: str) -> int:
    return df.columns.index(name)


def arrow_map(df: DataFrame, f: Callable[[Iterator], Iterator], schema: T.StructType | str) -> DataFrame:
    short_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def running_total(df: DataFrame, scratch: Scratch, name: str, order: list, values: dict[str, str]) -> DataFrame:
    """df in the order of the given sort columns with an exclusive running total for each of values (column -> name).

    Range partitions are sorted and written; only one total a partition is
    added up in one place, and each row adds its partition's offset. A total
    over lit(1) numbers the rows.
    """
    cut = df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("_part", F.spark_partition_id())
    cut = scratch.keep(cut, name)
    each = cut.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{n}") for c, n in values.items()])
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values.values()])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = [(F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_o_{n}")).alias(n) for c, n in values.items()]
    # one row of offsets a partition: bounded by the number of partitions, not by the data
    return cut.join(F.broadcast(offsets), "_part").select(*df.columns, *totals)
