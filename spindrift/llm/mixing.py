"""Mixing sources to target weights, in DataFrame operations only.

Every document draws a hash-random key. Within its source, rows fall into
ranges of the key; prefix sums of the ranges' word totals show in which range a
source's budget ends, that range is sorted, and prefix sums within it give the
cut: the key at which the last epoch ends, and the words left there. With a cut
for each source, each row knows by comparing how much of it is taken, so texts
cross no shuffle. A source repeats whole epochs as often as its budget holds
them, and the last epoch is cut at the exact budget, inside a document where
need be.

Nulls: a null text has no words and is never taken; a null source is a source
of its own, last in order; a null identifier hashes as the empty string. Of
repeated rows each counts: rows alike in identifier and size stand as one entry
with their number, so they make no hot key, and where the cut falls among them
they share its words by their place in a written table. A very long text is
counted by an expression and never leaves its row. Extra columns pass through
under any name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Scratch, partitions, positional, running_total

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix holds this share of all words; no source gives more than MAX_EPOCHS times its own.
SHARE, MAX_EPOCHS = 1.5, 2
#: Ranges of keys for each shuffle partition: ranges grow with the data, their totals don't.
RANGES = 8


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MAX_EPOCHS) -> DataFrame:
    """sources (source, source_size) with their target: a share of all words by weight, none above most times its size.

    With sources ordered by cap / weight, those before some place are capped
    and the rest share what is left; prefix sums find the place in one pass.
    """
    numbered = running_total(sources.withColumn("_one", F.lit(1).cast("long")), scratch, "sources", [F.col("source").asc_nulls_last()], {"_one": "_at"})
    cap = (F.col("source_size") * most).alias("_cap")
    numbered = numbered.select("source", "source_size", cap, F.element_at(F.array(*map(F.lit, weights)), (F.col("_at") % len(weights) + 1).cast("int")).cast("long").alias("_w"))
    numbered = scratch.keep(numbered, "weights")
    whole = numbered.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("_w"), F.lit(0)).alias("w")).first()
    total = whole["size"] * share
    level = running_total(numbered.withColumn("_level", F.col("_cap") / F.col("_w")), scratch, "levels", ["_level", F.col("source").asc_nulls_last()], {"_cap": "_caps", "_w": "_ws"})
    level = level.withColumn("_share", (F.lit(total) - F.col("_caps")) / (F.lit(whole["w"]) - F.col("_ws"))).where(F.col("_level") > F.col("_share"))
    found = level.agg(F.min_by("_share", F.struct("_level", F.col("source").isNull(), F.col("source"))).alias("share")).first()["share"]
    target = F.col("_cap").cast("double") if found is None else F.least(F.col("_cap").cast("double"), F.col("_w") * F.lit(found))
    return numbered.select("source", "source_size", target.alias("target"))


def key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def cuts(sized: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """sized: _id, _source, _size. A row a source: source, source_size, target, epochs, and of the cut _key, _id, _size (names
    begin with cut), ties (rows alike there) and left (words to take from them)."""
    partitions_of = partitions(sized.sparkSession)
    sources = scratch.keep(sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("rows")), "by_source")
    every = sources.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    each = max(64, every // (partitions_of * RANGES))  # rows in a range, about
    ranges = sources.select(F.col("source").alias("_s"), F.ceil(F.col("rows") / each).alias("ranges"))
    goal = targets(sources.select("source", "source_size"), scratch, **how).join(ranges, F.col("source").eqNullSafe(F.col("_s")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.select("source", "source_size", "target", "ranges", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).alias("rest"))
    goal = scratch.keep(goal, "goal")

    # a hot source meets few rows of sources; Spark broadcasts that side where its size allows and splits skewed partitions else
    rows = sized.withColumn("_key", key(F.col("_id"))).join(goal.select("source", "ranges", "rest"), F.col("_source").eqNullSafe(F.col("source")))
    place = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(1 << 32)).alias("_range")
    rows = rows.select("_id", "_source", "_size", "_key", "rest", place)
    totals = rows.groupBy("_source", "_range", "rest").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    last = totals.where("_offset <= rest and rest < _offset + _sum").select(F.col("_source").alias("_s"), F.col("_range").alias("_r"), (F.col("rest") - F.col("_offset")).alias("_left"))
    entries = rows.join(last, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))).groupBy("_source", "_left", "_key", "_id", "_size").agg(F.count(F.lit(1)).alias("_rows"))
    within = Window.partitionBy("_source").orderBy("_key", F.col("_id").asc_nulls_last(), "_size").rowsBetween(Window.unboundedPreceding, -1)
    words_of = F.col("_size") * F.col("_rows")
    entries = entries.withColumn("_done", F.coalesce(F.sum(words_of).over(within), F.lit(0))).where((F.col("_done") <= F.col("_left")) & (F.col("_left") < F.col("_done") + words_of))
    entries = entries.select(F.col("_source").alias("_s"), F.col("_key").alias("cut_key"), F.col("_id").alias("cut_id"), F.col("_size").alias("cut_size"), F.col("_rows").alias("ties"), (F.col("_left") - F.col("_done")).alias("left"))
    out = goal.drop("ranges", "rest").join(entries, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    out = scratch.keep(out, "cuts")
    scratch.drop("by_source", "sources", "weights", "levels", "goal")
    return out


def _taken(rows: DataFrame, cut: DataFrame, scratch: Scratch) -> DataFrame:
    """rows: _id, _source, _size and others, with the columns of their source's cut and _taken."""
    rows = rows.withColumn("_key", key(F.col("_id"))).join(cut, F.col("_source").eqNullSafe(F.col("source")))
    no_id = lambda c: F.col(c).isNull()
    ordered = F.struct("_key", no_id("_id").alias("none"), F.col("_id").alias("id"), F.col("_size").alias("size")) < F.struct(F.col("cut_key").alias("_key"), no_id("cut_id").alias("none"), F.col("cut_id").alias("id"), F.col("cut_size").alias("size"))
    before = F.coalesce(F.col("cut_key").isNotNull() & ordered, F.lit(False))
    at_cut = F.coalesce((F.col("_key") == F.col("cut_key")) & F.col("_id").eqNullSafe(F.col("cut_id")) & (F.col("_size") == F.col("cut_size")), F.lit(False))
    nth = lambda c: F.greatest(F.lit(0), F.least(F.col("_size"), F.col("left") - c * F.col("_size")))
    share = lambda last: (F.col("epochs") * F.col("_size") + last).cast("long").alias("_taken")
    rows = rows.withColumn("_alike", at_cut & (F.col("ties") > 1))
    out = rows.where("not _alike").select("*", share(F.when(before, F.col("_size")).when(at_cut, nth(F.lit(0))).otherwise(0)))
    if cut.where("ties > 1").limit(1).count():  # rows alike at a cut are numbered by file and place in it
        alike = scratch.keep(rows.where("_alike"), "alike")
        alike = alike.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        so_far = Window.partitionBy("_source").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
        files = alike.groupBy("_source", "_file").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_source").alias("_s"), F.col("_file").alias("_f"), F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_first"))
        alike = alike.withColumn("_in", F.row_number().over(Window.partitionBy("_source", "_file").orderBy("_row")) - 1)
        alike = alike.join(files, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_file") == F.col("_f")))
        out = out.unionByName(alike.select(*rows.columns, share(nth(F.col("_first") + F.col("_in")))))
    return out


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """A row for each row of docs: _id, _size, _source_size, _target, _epochs, _taken."""
    scratch = Scratch(docs.sparkSession)
    sized = scratch.keep(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), words(F.col(text_col)).alias("_size")), "sized")
    rows = _taken(sized, cuts(sized, scratch, **how), scratch)
    return rows.select("_id", "_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("epochs").alias("_epochs"), "_taken")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: rows of docs repeated by epoch, the one at a source's budget cut after its last word taken. Rows without
    words are not taken."""
    scratch = Scratch(docs.sparkSession)
    flat = positional(docs)
    at = {c: f"c{docs.columns.index(c)}" for c in (id_col, text_col, source_col)}
    rows = flat.withColumns({"_id": F.col(at[id_col]), "_source": F.col(at[source_col]), "_size": words(F.col(at[text_col]))})
    sized = scratch.keep(rows.select("_id", "_source", "_size"), "sized")
    cut = cuts(sized, scratch, **how)
    scratch.drop("sized")
    both = _taken(rows.where("_size > 0"), cut, scratch).where("_taken > 0")
    whole = (F.col("_taken") / F.col("_size")).cast("long")
    part = F.col("_taken") % F.col("_size")
    copies = both.withColumn("_copy", F.explode(F.expr("sequence(1, cast(ceil(_taken / _size) as int))")))
    first_words = F.array_join(F.slice(F.regexp_extract_all(F.col(at[text_col]), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), part.cast("int")), "")
    text = F.when(F.col("_copy") <= whole, F.col(at[text_col])).otherwise(first_words)
    return copies.select(*[text.alias(c) if c == at[text_col] else F.col(c) for c in flat.columns]).toDF(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([3, 1, 2])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
l AS (SELECT *, 2 * source_size / w AS level,
        (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS part
      FROM s WINDOW before AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, coalesce(least(2.0 * source_size, w * (SELECT arg_min(part, level) FROM l WHERE level > part)), 2.0 * source_size)::DOUBLE AS target FROM s),
p AS (SELECT doc_id, size, source_size, target, floor(target)::BIGINT // greatest(source_size, 1) AS e, floor(target)::BIGINT % greatest(source_size, 1) AS rest,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (e * size + greatest(0, least(size, rest - done)))::BIGINT AS taken FROM p
"""
