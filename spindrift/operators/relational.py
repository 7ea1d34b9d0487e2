"""Rankings, deltas, lookups, fills and set operations over entities and their daily snapshots."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.scratch import Scratch


def daily_delta(snapshots: DataFrame, key: str, date: str, values: list[str]) -> DataFrame:
    """Each value's change since exactly the day before; null where that day is missing. (key, date) is unique."""
    w = Window.partitionBy(key).orderBy(date)
    near = F.datediff(F.col(date), F.lag(date).over(w)) == 1
    return snapshots.withColumns({f"daily_{v}": F.when(near, F.col(v) - F.lag(v).over(w)) for v in values})


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, numbered; Spark prunes groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def ranked(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Global ranks by a distributed sort: each range is numbered by itself and adds the rows of the ranges before it."""
    out = running(df.withColumn("_one", F.lit(1).cast("long")), [], order, {"_one": "_before"})
    return out.withColumn(rank, F.col("_before") + 1).drop("_one", "_before")


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str], totals: dict[str, str] | None = None) -> DataFrame:
    """Exclusive running totals (column -> name) in an order, within groups, and the groups' totals. Rows are dealt by ranges of groups and order, each
    range is added up by itself, and a row adds what its group has in the ranges before, so a hot group meets no single task."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c) for c in by]
    cut = Scratch(spark).keep(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    each = cut.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_sum_{o}") for c, o in sums.items()])
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    of_group = [F.sum(f"_sum_{sums[c]}").over(whole).alias(o) for c, o in (totals or {}).items()]
    offsets = each.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_r"), *of_group, *[F.coalesce(F.sum(f"_sum_{o}").over(before), F.lit(0)).alias(f"_from_{o}") for o in sums.values()])
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_in_{o}") for c, o in sums.items()])
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return cut.join(offsets, same).select(*df.columns, *[(F.col(f"_in_{o}") + F.col(f"_from_{o}")).alias(o) for o in sums.values()], *(totals or {}).values())


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n, below (rows of the group with less), rows (all of the group's with a value): counts combine on the map
    side, so groups cost their distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return running(counts, by, [F.col(value)], {"n": "below"}, {"n": "rows"})


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it; nulls and NaNs equal their like."""
    new, old = column.slice(1), column.slice(0, max(0, len(column) - 1))
    differ = pc.fill_null(pc.not_equal(new, old), False)
    differ = pc.or_(differ, pc.xor(pc.is_null(new), pc.is_null(old)))
    if pa.types.is_floating(column.type):
        both = pc.and_(pc.fill_null(pc.is_nan(new), False), pc.fill_null(pc.is_nan(old), False))
        differ = pc.and_(differ, pc.invert(both))
    return differ.to_numpy(zero_copy_only=False)


def percentile_ranks(df: DataFrame, by: list[str], value: str, name: str = "pct") -> DataFrame:
    """Share of a group's values that are no larger, ties included; rows without a value are left out.

    Rows cross one shuffle, by ranges of group and falling value; a random number
    deals out values that many rows have. Each range notes where a row's ties
    begin, and what the ranges before hold of its first group and value is added
    from one row a range and group.
    """
    scratch, width = Scratch(df.sparkSession), len(by)
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(value).alias("_v"), *df.columns)
    keys = [f"_k{i}" for i in range(width)]
    order = [*[F.col(k) for k in keys], F.desc("_v")]
    cut = rows.withColumn("_salt", F.rand(7)).repartitionByRange(n, *order, "_salt").sortWithinPartitions(*order).drop("_salt").withColumn("_part", F.spark_partition_id())

    def run(batches):
        at, first, last = 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            head = [pa.concat_arrays([x, batch.column(i).slice(0, 1)]) for i, x in enumerate(last)] if last else []
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.logical_or.reduce([_changes(batch.column(i)) for i in range(width + 1)])
            new[0] = not head or any(_changes(c)[0] for c in head)
            here = at + np.arange(batch.num_rows)
            begin = np.maximum.accumulate(np.where(new, here, first))
            at, first, last = at + batch.num_rows, int(begin[-1]), [batch.column(i).slice(batch.num_rows - 1) for i in range(width + 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(here), pa.array(begin)], names=[*batch.schema.names, "_at", "_first"])

    cut = scratch.keep(cut.mapInArrow(run, T.StructType([*cut.schema.fields, T.StructField("_at", T.LongType()), T.StructField("_first", T.LongType())])), "ranges")
    each = cut.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_start"), F.min_by(F.struct("_v"), "_at").alias("_top"), F.max_by(F.struct("_v", "_first"), "_at").alias("_low"))
    of_group = Window.partitionBy(*(keys or [F.lit(0)]))
    before = F.coalesce(F.sum("_n").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a value that goes on from the range before: its ties began where that range's last ones did
    goes_on = F.coalesce(F.lag("_low._v").over(of_group.orderBy("_part")) == F.col("_top._v"), F.lit(False))
    each = each.select("*", before.alias("_before"), F.sum("_n").over(of_group).alias("_total"), goes_on.alias("_on"))
    inherits = F.col("_on") & (F.col("_low._first") == F.col("_start"))
    own = F.when(~inherits, F.col("_before") + F.col("_low._first") - F.col("_start"))
    above = F.last(own, ignorenulls=True).over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    each = each.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_of{k}") for k in keys], "_start", "_before", "_total", F.when(F.col("_on"), above).alias("_above"))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of{k}"))
    larger = F.coalesce(F.when(F.col("_first") == F.col("_start"), F.col("_above")), F.col("_before") + F.col("_first") - F.col("_start"))
    return cut.join(each, same).select(*df.columns, ((F.col("_total") - larger) / F.col("_total")).alias(name))


def upper_medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, median (the upper of the two middle values) and n of each group with values."""
    middle = F.floor(F.col("rows") / 2)
    found = value_counts(df, by, value).where((F.col("below") <= middle) & (middle < F.col("below") + F.col("n")))
    return found.select(*by, F.col(value).alias("median"), F.col("rows").alias("n"))


#: Rows up to a page's end that one task may number.
DEEP = 100_000


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of an order, with ranks: a top-n up to the page's end, or for a deep page distributed ranks."""
    if number * size > DEEP:
        rows = ranked(df, order)
        return rows.where((F.col("rank") > (number - 1) * size) & (F.col("rank") <= number * size))
    first = df.orderBy(*order).limit(number * size)
    w = Window.orderBy(*order)
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") > (number - 1) * size)


def pages(rows: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / size))


def centre_out(rank: Column) -> Column:
    """Place of a rank when the first stands in the middle, even ranks to its right and odd ones to its left."""
    return F.when(rank % 2 == 0, rank / 2).otherwise(-(rank - 1) / 2).cast("int")


def with_default_count(items: DataFrame, counts: DataFrame, on: str, name: str) -> DataFrame:
    return items.join(counts, on, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def first_by(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group (dedupe over ordered sources)."""
    return top_n(df, by, order, 1, "_first").drop("_first")


def upgraded(df: DataFrame, key: str, order: str, kind: str, best: str, carried: list[str]) -> DataFrame:
    """The first row of each key; if the first isn't of the best kind but a later one is, the kind and the carried columns
    come from the first of those."""
    is_best = F.col(kind) == best
    by = lambda c: F.coalesce(F.min_by(c, F.when(is_best, F.col(order))), F.min_by(c, order)).alias(c)
    rest = [c for c in df.columns if c not in (key, kind, order, *carried)]
    return df.groupBy(key).agg(F.min(order).alias(order), F.when(F.max(F.coalesce(is_best, F.lit(False))), best).otherwise(F.min_by(kind, order)).alias(kind), *[by(c) for c in carried], *[F.min_by(c, order).alias(c) for c in rest])


def tiered(df: DataFrame, key: str, tiers: list[tuple[Column, list[Column]]], n: int) -> DataFrame:
    """Rows by tier (a condition and an order each) until n: each row counts in its first tier."""
    tier = F.coalesce(*[F.when(c, i) for i, (c, _) in enumerate(tiers)]).alias("tier")
    parts = []
    placed = df.select("*", tier).where("tier is not null")
    for i, (_, order) in enumerate(tiers):
        parts.append(placed.where(F.col("tier") == i).orderBy(*order).limit(n).withColumn("at", F.row_number().over(Window.orderBy(*order))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("place", F.row_number().over(Window.orderBy("tier", "at"))).where(F.col("place") <= n).drop("at")


def term_scores(found: DataFrame, term: str, approved: Column, faceless: Column) -> DataFrame:
    """found, faceless, approved by term, and the smoothed score (3 * approved + faceless) / (found + 4)."""
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = found.where(F.col(term).isNotNull()).groupBy(term).agg(F.count(F.lit(1)).alias("found"), yes(faceless).alias("faceless"), yes(approved).alias("approved"))
    return out.withColumn("score", (F.col("approved") * 3 + F.col("faceless")) / (F.col("found") + 4))


def explore_exploit(terms: DataFrame, scores: DataFrame, term: str, order: str, day: int, budget: int = 16, share: float = 0.8) -> DataFrame:
    """A day's terms: the best of the tried ones for a share of the budget, untried ones in turn by day for the rest,
    then whatever is left, tried ones first."""
    every = terms.join(scores.select(term, "score"), term, "left")
    tried, untried = every.where("score is not null"), every.where("score is null")
    size = lambda df: df.agg(F.count(F.lit(1))).scalar()
    exploit = F.least(size(tried), F.lit(int(budget * share + 0.5)))
    # no more of the tried ones can come in than the budget; of the untried ones the day decides, so all are numbered
    best = tried.orderBy(F.col("score").desc(), order).limit(budget).withColumn("i", F.row_number().over(Window.orderBy(F.col("score").desc(), order)) - 1)
    best = best.select(term, "score", F.when(F.col("i") < exploit, 0).otherwise(2).alias("step"), F.col("i").cast("long").alias("at"))
    n = size(untried)
    rest = ranked(untried, [F.col(order)], "i").withColumn("i", F.col("i") - 1).withColumn("turn", F.pmod(F.col("i") - day, F.greatest(F.lit(1), n)))
    due = F.col("turn") < F.least(F.lit(budget) - exploit, n)
    rest = rest.select(term, "score", F.when(due, 1).otherwise(3).alias("step"), F.when(due, F.col("turn")).otherwise(F.col("i")).alias("at"))
    return best.unionByName(rest).orderBy("step", "at").limit(budget)


def domain_counts(df: DataFrame, c: Column, domain: list[str], default: str) -> DataFrame:
    """A count for each value of a domain, 0 included; null and '' count as the default."""
    value = F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    spark = df.sparkSession
    values = spark.createDataFrame([(d,) for d in domain], "value string")
    return values.join(df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")), "value", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def latest(df: DataFrame, date: str) -> DataFrame:
    """Rows of the latest date: a scalar subquery, which Spark evaluates with the query, not while it is built."""
    return df.where(F.col(date) == df.agg(F.max(date)).scalar())


def any_row(df: DataFrame, condition: Column) -> Column:
    """Whether some row meets a condition, as a scalar subquery."""
    return df.agg(F.coalesce(F.bool_or(condition), F.lit(False))).scalar()


def gated(requests: DataFrame, flags: DataFrame, feature: str, is_admin: str) -> DataFrame:
    """Requests with whether they are allowed: features open to all, or administrators. A feature without a flag is closed."""
    both = requests.join(flags.select(feature, F.col("is_public").alias("_open")), feature, "left")
    return both.withColumn("allowed", F.coalesce(F.col(is_admin), F.lit(False)) | F.coalesce("_open", F.lit(False))).drop("_open")


def known_or(df: DataFrame, known: DataFrame, key: str, value: str, otherwise: Column) -> DataFrame:
    """A value that is known for a key (null included), else computed; checked tells which were computed."""
    both = df.join(known.select(F.col(key).alias("_key"), F.col(value).alias("_known")), F.col(key) == F.col("_key"), "left")
    missing = F.col("_key").isNull()
    return both.select(*df.columns, F.when(missing, otherwise).otherwise(F.col("_known")).alias(value), missing.alias("checked"))


def store_desc(column: str) -> Column:
    """Descending as the store sorts it where no null order is given: nulls first."""
    return F.col(column).desc_nulls_first()


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions])


def first_of_each(df: DataFrame, by: list[str], order: str, value: str, n: int) -> DataFrame:
    """by and texts: the first n values of each group in order. Rows are pruned before they are collected."""
    top = top_n(df.where(F.col(value).isNotNull()), by, [F.col(order)], n, "_n")
    return top.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_n", F.col(value).alias("v"))))["v"].alias("texts"))


def rank_within(df: DataFrame, by: list[str], order: list[str], subset: Column, name: str) -> DataFrame:
    """Ranks among the rows of a subset; other rows have none."""
    w = Window.partitionBy(*by, F.coalesce(subset, F.lit(False))).orderBy(*order)
    return df.withColumn(name, F.when(subset, F.row_number().over(w)))


def count_and_mine(likes: DataFrame, key: str, user: str, me: Column) -> DataFrame:
    """Likes of each key, and whether the reader's is among them."""
    return likes.groupBy(key).agg(F.count(F.lit(1)).alias("likes"), F.bool_or(F.coalesce(F.col(user) == me, F.lit(False))).alias("mine"))


def tagged_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several kinds as one table with a column kind; columns that a kind lacks are null."""
    tagged = [df.withColumn("kind", F.lit(kind)) for kind, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def renamed(df: DataFrame, names: dict[str, str], defaults: dict[str, object] = {}) -> DataFrame:  # noqa: B006
    """Only the named fields (dots reach into structs), under their new names, with defaults for nulls."""
    pick = lambda old, new: F.coalesce(F.col(old), F.lit(defaults[new])) if new in defaults else F.col(old)
    return df.select(*[pick(old, new).alias(new) for old, new in names.items()])


def summary(df: DataFrame, by: list[str], key: str, checked: Column) -> DataFrame:
    """Counts of a run: rows read, distinct keys, rows newly checked."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("read"), F.count_distinct(key).alias("distinct_keys"), F.count_if(F.coalesce(checked, F.lit(False))).alias("checked"))


def zipped(left: DataFrame, right: DataFrame, key: str, position: str) -> DataFrame:
    """Right rows by key where they name one, else by position."""
    named = left.join(right.where(F.col(key).isNotNull()).withColumnRenamed(position, "_p"), key, "left")
    placed = right.where(F.col(key).isNull()).drop(key)
    value = [c for c in right.columns if c not in (key, position)]
    out = named.join(placed.select(position, *[F.col(c).alias(f"_{c}") for c in value]), position, "left")
    return out.select(*left.columns, *[F.coalesce(c, f"_{c}").alias(c) for c in value])


def all_or_nothing(scenes: DataFrame, shots: DataFrame, story: str, on: str) -> DataFrame:
    """Stories all of whose scenes have a shot, with the number of scenes."""
    hit = scenes.join(shots.select(on).distinct().withColumn("_hit", F.lit(True)), on, "left")
    return hit.groupBy(story).agg(F.count(F.lit(1)).alias("scenes"), F.bool_and(F.coalesce("_hit", F.lit(False))).alias("whole")).where("whole").drop("whole")


def merged_upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_if_absent: list[str] = ()) -> DataFrame:
    """Old rows with new ones merged in by key; a new null in keep_if_absent leaves the old value. Of new rows that
    repeat a key, the caller keeps one first."""
    present = new.withColumn("_new", F.lit(True))
    both = old.alias("o").join(present.alias("n"), keys, "full_outer")
    value = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep_if_absent else F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*keys, *[value(c).alias(c) for c in old.columns if c not in keys])


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and those new ones whose key is new."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows instead of all old ones of their keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def updated(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def deleted(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def visible_to(df: DataFrame, owner: str, user: str, action: str = "read") -> DataFrame:
    """Row rules: all may read, only owners change their rows."""
    return df if action == "read" else df.where(F.col(owner) == user)


def settings(df: DataFrame, defaults: dict[str, float], key: str = "key", value: str = "value", low: dict | None = None, high: dict | None = None) -> DataFrame:
    """Key and value rows as one typed row, with defaults for what is missing, malformed or out of range."""
    out = df.where(F.col(key).isin(*defaults)).groupBy().agg(*[F.max(F.when(F.col(key) == k, F.col(value).try_cast("double"))).alias(k) for k in defaults])
    ok = lambda k: (F.col(k) >= (low or {}).get(k, float("-inf"))) & (F.col(k) <= (high or {}).get(k, float("inf")))
    return out.select(*[F.when(ok(k), F.col(k)).otherwise(F.lit(float(d))).alias(k) for k, d in defaults.items()])


def floored_changes(changes: DataFrame, by: list[str], order: list[Column], step: str) -> DataFrame:
    """by, add, floor: what a group's changes do to a counter that never falls below 0: it becomes max(counter + add, floor).
    Such summaries compose, so a view takes batches of changes one after the other without the changes before."""
    rows = running(changes.select(*by, *_columns_of(changes, by), F.col(step).cast("long").alias("_step")), by, order, {"_step": "_before"}, {"_step": "_total"})
    after = F.col("_before") + F.col("_step")
    return rows.groupBy(*by).agg(F.max("_total").alias("add"), F.max(F.col("_total") - after).alias("floor"))


def _columns_of(df: DataFrame, by: list[str]) -> list[str]:
    return [c for c in df.columns if c not in by]


def maintained(view: DataFrame, changes: DataFrame, by: list[str], order: list[Column], step: str, counter: str) -> DataFrame:
    """The view (by, counter) after a batch of changes (+1, -1, ...) in order; groups that it doesn't have begin at 0."""
    both = view.select(*by, counter).join(floored_changes(changes, by, order, step), by, "full")
    start = F.coalesce(F.col(counter), F.lit(0))
    return both.select(*by, F.coalesce(F.greatest(start + F.col("add"), F.col("floor")), start).cast("long").alias(counter))
