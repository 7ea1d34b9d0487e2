"""Readers and writers of stored tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all tasks: a small file is one task's, however much work its rows are."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def one_row(df: DataFrame):
    """The row, None without any; more than one is an error."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("more than one row")
    return rows[0] if rows else None


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrites the partitions that df has rows of; running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def artifact(df: DataFrame, path: str) -> None:
    """Rows as JSON objects, a line each, instead of what was there (a plan that other programs read)."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def media(spark: SparkSession, path: str) -> DataFrame:
    """Files as path, modificationTime, length and base64 content; unreadable files are left out."""
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(path)
    return files.select("path", "modificationTime", "length", F.base64("content").alias("content"))


def parsed(df: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON text as a struct, with an error column where it isn't valid."""
    value = F.from_json(column, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return df.withColumn("value", value).withColumn("error", F.col("value._bad")).withColumn("value", F.col("value").dropFields("_bad"))


class _Pages(DataSourceReader):
    def __init__(self, fetch, keys: list[str], pages: int):
        self.fetch, self.keys, self.pages = fetch, keys, pages

    def partitions(self):
        return [InputPartition(k) for k in self.keys] or [InputPartition(None)]

    def read(self, partition):
        token, seen = None, 0
        while partition.value is not None and seen < self.pages:
            items, token = self.fetch(partition.value, token)
            yield from ((partition.value, *item) for item in items)
            seen += 1
            if token is None:
                return


def paged_source(name: str, schema: str, fetch, keys: list[str], pages: int = 2) -> type[DataSource]:
    """A source read by key, page after page, until no page follows or so many are read. fetch(key, token) gives
    (rows, next token); the schema's first column is the key."""

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return _Pages(fetch, keys, pages)

    return Paged


def digest(counts: DataFrame) -> DataFrame:
    """Name and number rows as one text, a line each."""
    return counts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "n"))), lambda x: F.concat_ws(": ", x["name"], x["n"].cast("string"))), "\n").alias("report"))
