"""The trie of conversations' common beginnings.

Each turn gets an identifier of fixed width from its role and text. A
conversation becomes rows of WIDTH positional columns of such identifiers; one
ROLLUP over the columns aggregates all prefixes together, and grouping_id tells
a prefix's depth. A longer conversation goes on in further rows, keyed by the
prior row's node, so one ROLLUP serves all depths. What a subtree sums goes up
the same way: a second ROLLUP over the nodes within a block of columns, and
between blocks in log2(longest conversation / WIDTH) joins.

A node's key is the sum of two 64-bit hashes of (turn identifier, position)
over its path, so a prefix sum of small rows gives the key of each block at
once, however long a conversation is. Rows alike in all columns are counted
before the ROLLUP, which itself combines in the map tasks, so neither a common
first turn nor a common conversation makes a hot task; turns are numbered by
range, so neither does a conversation that holds much of the table.

Turns of a conversation are ordered by turn (nulls first), then by role and
text, which decides ties; repeated rows are turns each. A null role or text is
empty; rows without a conversation are left out. Texts of any length count by
their hash and their number of code points. An empty table has no trie and
gives no rows. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, arrow_map, partitions, running_total

#: Positional columns of a block; turns shared with a conversation's hundred at most; members in a chunk of a list of ends.
WIDTH, SHARED, CHUNK = 8, 6, 10_000
SLOTS = [f"t{i}" for i in range(WIDTH)]
KEY = ["key1", "key2"]


@dataclass
class Trie:
    #: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, key1, key2
    nodes: DataFrame
    #: a row for each conversation: key1, key2 and depth of the node where it ends, conv_id
    ends: DataFrame


def numbered(conversations: DataFrame, scratch: Scratch, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 0), turn_id: 16 bytes of a hash of role and text, then the text's number of code points in 8 bytes."""
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).where("conv is not null")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    size = F.lpad(F.hex(F.char_length("text")), 16, "0")
    digest = F.substring(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32)
    rows = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    rows = scratch.keep(rows.select("conv", F.unhex(F.concat(digest, size)).alias("turn_id"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "numbered")
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # one row of offsets a partition: bounded by the number of partitions
    placed = rows.join(F.broadcast(offsets), "part").select("conv", (F.col("at") + F.col("offset")).alias("n"), "turn_id")
    first = placed.groupBy("conv").agg(F.min("n").alias("first"))
    return placed.join(first, "conv").select("conv", (F.col("n") - F.col("first")).alias("pos"), "turn_id")


def turn_chars(turn_id) -> F.Column:
    return F.conv(F.hex(F.substring(turn_id, 17, 8)), 16, 10).cast("long")


def rebuilt(turns: DataFrame) -> DataFrame:
    """turns as numbered() gives them, with each conversation's first turns exchanged for those of its hundred's first one. A
    conversation that has no turns left stays as one row with a null turn_id."""
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.select("conv", "n", (F.col("conv") - F.col("conv") % 100).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED).alias("h"))
    bases = convs.where("conv = base").select(F.col("conv").alias("base"), F.least("n", F.lit(SHARED)).alias("base_n"))
    convs = convs.join(bases, "base", "left").select("conv", "n", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    own = turns.join(convs.select("conv", "h", "taken"), "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_id")
    heads = turns.where((F.col("conv") % 100 == 0) & (F.col("pos") < SHARED)).select(F.col("conv").alias("base"), "pos", "turn_id")
    shared = convs.select("conv", "base", "taken").join(heads, "base").where("pos < taken").select("conv", "pos", "turn_id")
    bare = convs.where("taken = 0 and n <= h").select("conv", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn_id"))
    return own.unionByName(shared).unionByName(bare)


def hashed(turn_id, pos) -> list:
    """Two hashes of a turn at its position, as decimals: sums of them never overflow."""
    return [F.xxhash64(F.lit(lane), turn_id, pos).cast("decimal(38,0)") for lane in (1, 2)]


def _blocks(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(blocks: conv, block, key1, key2 of the node before it, slots; ends: key1, key2, depth, conv_id), of turns: conv, pos, turn_id."""
    h1, h2 = hashed("turn_id", "pos")
    here = lambda c: F.coalesce(F.sum(F.when(F.col("turn_id").isNotNull(), c)), F.lit(0)).cast("decimal(38,0)")
    slots = [F.max(F.when(F.col("pos") % WIDTH == i, F.col("turn_id"))).alias(s) for i, s in enumerate(SLOTS)]
    blocks = turns.groupBy("conv", F.floor(F.col("pos") / WIDTH).cast("long").alias("block")).agg(here(h1).alias("own1"), here(h2).alias("own2"), F.count("turn_id").alias("turns"), *slots)
    blocks = running_total(blocks, scratch, "blocks", ["conv", "block"], {"own1": "sum1", "own2": "sum2"})
    starts = blocks.where("block = 0").select("conv", F.col("sum1").alias("start1"), F.col("sum2").alias("start2"))
    less = lambda i: (F.col(f"sum{i}") - F.col(f"start{i}")).cast("decimal(38,0)").alias(f"key{i}")
    blocks = scratch.keep(blocks.join(starts, "conv").select("conv", "block", less(1), less(2), "own1", "own2", "turns", *SLOTS), "keyed")
    scratch.drop("blocks")
    total = lambda i: F.sum(f"own{i}").cast("decimal(38,0)").alias(f"key{i}")
    return blocks, blocks.groupBy("conv").agg(total(1), total(2), F.sum("turns").alias("depth")).select(*KEY, "depth", F.col("conv").alias("conv_id"))


def _rolled_up(rows: DataFrame, sums: str) -> DataFrame:
    """All prefixes of rows within their block: block, key1, key2, slots, level (slots in the prefix) and sums."""
    slots = ", ".join(SLOTS)
    out = rows.sparkSession.sql(f"select block, key1, key2, {slots}, {WIDTH} - bit_count(grouping_id()) as level, {sums} from {{rows}} group by block, key1, key2, rollup({slots})", rows=rows)
    # a prefix that ends in an empty slot is none; before a later block stands the prior block's node
    return out.where(F.when(F.col("level") == 0, F.col("block") == 0).otherwise(F.element_at(F.array(*SLOTS), F.greatest("level", F.lit(1)).cast("int")).isNotNull()))


def _path(rows: DataFrame, last: int = 0) -> list:
    """key1, key2 of a prefix less its last slots."""
    out = []
    for lane in (0, 1):
        parts = [F.when(F.col("level") - last > i, hashed(F.col(s), F.col("block") * WIDTH + i)[lane]).otherwise(F.lit(0).cast("decimal(38,0)")) for i, s in enumerate(SLOTS)]
        out.append(sum(parts, F.col(KEY[lane])).cast("decimal(38,0)"))
    return out


def _below(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """block, key1, key2, leaves, saved: of everything below the node before each block, by doubling: a block's sum meets the sums
    of the blocks 1, 2, 4, ... blocks below it."""
    sums = [F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved")]
    up = [F.min("up1").alias("up1"), F.min("up2").alias("up2")]
    state = nodes.where("block > 0").groupBy("block", *KEY).agg(*sums)
    ends = nodes.where(F.col("level") == WIDTH).select((F.col("block") + 1).alias("block"), F.col("node1").alias("key1"), F.col("node2").alias("key2"), F.col("key1").alias("up1"), F.col("key2").alias("up2"))
    state = scratch.keep(state.join(ends.groupBy("block", *KEY).agg(*up), ["block", *KEY]), "below0")
    turn, reach, most = 0, 1, state.agg(F.max("block")).first()[0] or 0
    while reach < most:
        moved = state.where(F.col("block") > reach).select((F.col("block") - reach).alias("block"), F.col("up1").alias("key1"), F.col("up2").alias("key2"), "leaves", "saved")
        summed = state.select("block", *KEY, "leaves", "saved").unionByName(moved).groupBy("block", *KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        further = state.select((F.col("block") + reach).alias("block"), F.col("key1").alias("up1"), F.col("key2").alias("up2"), F.col("up1").alias("far1"), F.col("up2").alias("far2"))
        jumps = state.select("block", *KEY, "up1", "up2").join(further, ["block", "up1", "up2"], "left").select("block", *KEY, F.col("far1").alias("up1"), F.col("far2").alias("up2"))
        state = scratch.keep(summed.join(jumps, ["block", *KEY]), f"below{turn + 1}")
        scratch.drop(f"below{turn}")
        turn, reach = turn + 1, reach * 2
    return state.select("block", *KEY, "leaves", "saved")


def trie(turns: DataFrame, scratch: Scratch | None = None) -> Trie:
    """turns: conv, pos, turn_id (null: a conversation without turns)."""
    scratch = scratch or Scratch(turns.sparkSession)
    blocks, ends = _blocks(turns, scratch)
    alike = blocks.groupBy("block", *KEY, *SLOTS).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("convs"))
    found = _rolled_up(alike, "min(conv) as conv_id, sum(convs) as n_convs")
    (node1, node2), (up1, up2) = _path(found), _path(found, 1)
    chars = F.when(F.col("level") > 0, turn_chars(F.element_at(F.array(*SLOTS), F.greatest("level", F.lit(1)).cast("int")))).otherwise(0)
    found = found.select("*", (F.col("block") * WIDTH + F.col("level")).alias("depth"), node1.alias("node1"), node2.alias("node2"), up1.alias("up1"), up2.alias("up2"), ((F.col("n_convs") - 1) * chars).alias("saved"))
    found = scratch.keep(found, "found")
    scratch_names = ["found"]

    # children are counted where they are made; the few rows a parent meet by its key
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("node1"), F.col("up2").alias("node2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = found.join(children, ["depth", "node1", "node2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = scratch.keep(nodes.withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")), "nodes")
    below = _below(nodes, scratch).select((F.col("block") * WIDTH).alias("depth"), F.col("key1").alias("node1"), F.col("key2").alias("node2"), F.col("leaves").alias("leaf_below"), F.col("saved").alias("saved_below"))
    whole = nodes.join(below, ["depth", "node1", "node2"], "left")
    whole = whole.select("block", *KEY, *SLOTS, (F.col("leaf") + F.coalesce("leaf_below", F.lit(0))).alias("leaf"), (F.col("saved") + F.coalesce("saved_below", F.lit(0))).alias("saved"))
    sums = _rolled_up(whole, "sum(leaf) as n_leaves, sum(saved) as saved_tokens")
    node1, node2 = _path(sums)
    sums = sums.select((F.col("block") * WIDTH + F.col("level")).alias("depth"), node1.alias("node1"), node2.alias("node2"), "n_leaves", "saved_tokens")
    nodes = nodes.select("depth", "node1", "node2", "up1", "up2", "conv_id", "n_convs", "n_children").join(sums, ["depth", "node1", "node2"])
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node1").alias("up1"), F.col("node2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(parents, ["depth", "up1", "up2"], "left")
    nodes = nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("node1").alias("key1"), F.col("node2").alias("key2"))
    nodes = scratch.keep(nodes, "trie")
    scratch.drop(*scratch_names, "nodes")
    return Trie(nodes, ends)


def end_digests(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """key1, key2, depth, ends_sha256: the SHA-256 of each node's ends, ascending, joined by commas.

    Ends are sorted by range and joined in chunks; a node's chunks then pass
    one hash, one after the other, so a node with many ends takes no memory.
    """
    by = ["depth", *KEY]
    order = [*by, "conv_id"]
    rows = ends.repartitionByRange(partitions(ends.sparkSession), *order).sortWithinPartitions(*order)
    rows = rows.select(*order, F.spark_partition_id().alias("part"), F.floor(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) / CHUNK).alias("chunk"))
    rows = scratch.keep(rows, "ends")
    chunks = rows.groupBy(*by, "part", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("text"))
    chunks = chunks.repartition(partitions(ends.sparkSession), *by).sortWithinPartitions(*by, "part", "chunk").select(*by, "text")

    def run(batches):
        last, digest = None, None
        for batch in batches:
            out = []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for *node, text in zip(*columns):
                if node != last:
                    if last is not None:
                        out.append((*last, digest.hexdigest()))
                    last, digest = node, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            if out:
                yield rows_of(out)
        if last is not None:
            yield rows_of([(*last, digest.hexdigest())])

    kinds = [pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0), pa.string()]

    def rows_of(out):
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=[*by, "ends_sha256"])

    return arrow_map(chunks, run, "depth long, key1 decimal(38,0), key2 decimal(38,0), ends_sha256 string")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    turns = scratch.keep(rebuilt(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"), scratch)), "turns")
    found = trie(turns, scratch)
    out = found.nodes.join(end_digests(found.ends, scratch), ["depth", *KEY], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


_STEPS = "[0, 0, 0, 0, 0, 0, 0, 0]"
ORACLE_SQL = f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, count(*) AS n,
        xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
          lambda a, b: list_reduce(list_prepend(xor(a, b), {_STEPS}::BIGINT[]), lambda s, z: xor(s >> 1, (s & 1) * 3988292384)))) % {SHARED} AS h
      FROM o GROUP BY conv_id),
k AS (SELECT c.*, least(h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN (SELECT conv_id AS base, n FROM c) b USING (base)),
t AS (SELECT k.conv_id, o.pos - h + taken AS pos, role, text FROM k JOIN o USING (conv_id) WHERE o.pos >= h
      UNION ALL SELECT k.conv_id, o.pos, role, text FROM k JOIN o ON o.conv_id = k.base WHERE o.pos < taken),
w AS (SELECT c.conv_id, coalesce(p, []) AS p FROM c LEFT JOIN (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS p FROM t GROUP BY conv_id) USING (conv_id)),
e AS (SELECT conv_id, len(p) AS size, unnest(range(0, len(p) + 1)) AS depth, p FROM w),
n AS (SELECT depth, p[:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM e GROUP BY depth, path),
m AS (SELECT n.*, (n_convs - 1) * (CASE WHEN depth = 0 THEN 0 ELSE length(path[depth].text) END) AS saved, coalesce(kids, 0) AS n_children
      FROM n LEFT JOIN (SELECT path[:depth - 1] AS path, count(*) AS kids FROM n WHERE depth > 0 GROUP BY 1) USING (path)),
s AS (SELECT a.depth, a.conv_id, sum(d.saved) AS saved_tokens, sum(CASE WHEN d.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
      FROM m a JOIN (SELECT path[:up] AS top, saved, n_children FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM m)) d ON a.path = d.top GROUP BY a.depth, a.conv_id)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s USING (depth, conv_id) LEFT JOIN m u ON m.depth > 0 AND u.depth = m.depth - 1 AND u.path = m.path[:m.depth - 1]
"""
