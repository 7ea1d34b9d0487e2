"""Connected components of a graph of links, by alternating large-star and small-star steps.

Each step finds the smallest neighbour of each vertex, with map-side combining,
and writes it; joining it back to the links is then a join of two stored
tables, which Spark broadcasts where few rows allow it and whose hot vertices it
splits elsewhere. Links never reach the driver, and each round is written to
the shared folder.

Nulls: a link with a null end is no link. Repeated links count once, loops not
at all; an empty table gives an empty result. Columns besides a and b are not
read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, met


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """links: a, b. A row for each vertex that has a link to another: id, component (the smallest reachable id)."""
    order = lambda u, v: (F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    edges = scratch.keep(links.where("a <> b").select(*order(F.col("a"), F.col("b"))).distinct(), f"{name}0")
    turn, state = 0, None
    while True:
        # large star: the larger neighbours of u go to the smallest vertex near u
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}_near")
        large = both.where("v > u").join(met(near), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.keep(large, f"{name}_large")
        # small star: the smaller neighbours of u, and u, go to the smallest of them
        near = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}_least")
        small = large.join(met(near), "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = scratch.keep(small, f"{name}{turn + 1}")
        scratch.drop(f"{name}{turn}", f"{name}_near", f"{name}_large", f"{name}_least")
        turn += 1
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    # every edge now leads from a vertex to its smallest; the smallest itself is added
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
