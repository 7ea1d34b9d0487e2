"""Embedding near-dedup by a forest of random-projection trees.

Every tree splits the space by recursive random hyperplanes (through the
direction of two random vectors of a node, at the median of the node's sample);
vectors near a hyperplane spill to both sides. The upper levels are fitted on
at most SAMPLE vectors chosen by hash, and every vector goes down all trees.
Where the table needs more levels than the sample gives (and for lengths of
vectors too rare to be fitted), hyperplanes in random directions through the
middle of the leaf's sample go on, so leaves don't grow with the table. A leaf
that is large all the same is split further in its task by the same rule.
Vectors are compared within leaves by matrix products; pairs near the threshold
are verified in double precision. Of a leaf's links a spanning forest is passed
on, and the links of all trees give components.

Hyperplanes cut through a large group of near vectors at every level, so trees
alone lose links in it. Two more passes make up for that. Every vector that
meets, within twice the threshold's angle, a member of another component larger
than a leaf is compared with that component's members, all of them. Then the
members of each component are compared with each other, all of them, in blocks,
and links are counted there and never written as pairs.

Equal vectors are collapsed first and stand as one vector with their number,
so copies are never expanded into pairs.

Nulls: vectors that are null, zero, or hold null or non-finite components link
with nothing. A null identifier links with nothing and has a null component.
Vectors of different lengths don't link; very long ones are rows like others.
Rows that repeat an identifier share their links. Columns besides the two named
ones are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, partitions
from .components import components
from .minhash import _grouped, _pairs

TREES = 12
#: Vectors that the upper levels are fitted on, at most, and the fewest of them in a node that is split.
SAMPLE, SAMPLE_NODE = 20_000, 32
#: Vectors in a leaf, about; a leaf of more than LARGE is split further in its task.
LEAF, LARGE = 800, 4096
#: Vectors that go down the trees at a time.
DEALT = 4096
#: Lengths of vectors that trees are fitted for; the others have random directions only.
FITTED = 16
#: Share of a node's vectors on either side of a hyperplane that go to both sides.
SPILL = 0.06
SLACK = 1e-4  # what single precision may be off by, at least; such pairs are verified in double
#: Members of a component that are compared with each other in one block.
BLOCK = 8192


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def hyperplane(x: np.ndarray, rng) -> tuple[np.ndarray, float, float, float] | None:
    """(direction, low, median, high): vectors above low go right, those below high go left."""
    for _ in range(4):
        a, b = rng.choice(len(x), 2, replace=False)
        d = x[a] - x[b]
        if (norm := np.linalg.norm(d)) > 1e-6:
            low, mid, high = np.quantile(x @ (d / norm), [0.5 - SPILL, 0.5, 0.5 + SPILL])
            return d / norm, low, mid, high
    return None


def plant(sample: np.ndarray, depth: int, seed: int) -> tuple[dict[int, tuple], dict[int, tuple]]:
    """The upper levels of a tree: node -> hyperplane, and leaf -> (middle, spread by direction) of its sample; the children of
    node i are 2i and 2i + 1, the root is 1."""
    rng, nodes, leaves, todo = np.random.default_rng(seed), {}, {}, [(1, np.arange(len(sample)), 0)]
    while todo:
        node, rows, level = todo.pop()
        if level >= depth or len(rows) < SAMPLE_NODE or (plane := hyperplane(sample[rows], rng)) is None:
            x = sample[rows]
            leaves[node] = x.mean(axis=0), float(np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1).mean() / x.shape[1]))
            continue
        nodes[node] = plane
        side = sample[rows] @ plane[0]
        todo += [(2 * node, rows[side <= plane[3]], level + 1), (2 * node + 1, rows[side > plane[1]], level + 1)]
    return nodes, leaves


def descend(x: np.ndarray, nodes: dict[int, tuple]) -> list[tuple[int, np.ndarray]]:
    """(leaf, rows) of all vectors of x."""
    out, todo = [], [(1, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if node not in nodes:
            out.append((node, rows))
        elif len(rows):
            d, low, _, high = nodes[node]
            side = x[rows] @ d
            todo += [(2 * node, rows[side <= high]), (2 * node + 1, rows[side > low])]
    return out


def further(x: np.ndarray, rows: np.ndarray, node: int, levels: int, tree: int, leaf: tuple | None) -> list[tuple[int, np.ndarray]]:
    """(leaf, rows) after so many more levels, by random directions through a leaf's middle, with spill as above."""
    if levels <= 0 or not len(rows):
        return [(node, rows)]
    middle, spread = leaf if leaf is not None else (np.zeros(x.shape[1]), x.shape[1] ** -0.5)
    d = np.random.default_rng([tree, x.shape[1], 77]).standard_normal((levels, x.shape[1]))
    side = (x[rows] - middle) @ (d / np.linalg.norm(d, axis=1, keepdims=True)).T
    margin = 2.5 * SPILL * spread  # of a normal distribution, a share of about SPILL lies on either side
    out = [(node, np.arange(len(rows)))]
    for k in range(levels):
        out = [(2 * n + right, part) for n, at in out for right, part in ((0, at[side[at, k] <= margin]), (1, at[side[at, k] > -margin])) if len(part)]
    return [(n, rows[at]) for n, at in out]


def parts_of(x: np.ndarray, rng, level: int = 0):
    """Rows of the parts that a leaf is split into where it is large; x: unit vectors in single precision."""
    if len(x) > LARGE and level < 24 and (plane := hyperplane(x[rng.choice(len(x), min(len(x), 2000), replace=False)], rng)) is not None:
        side = x @ plane[0]
        parts = [np.flatnonzero(side <= plane[3]), np.flatnonzero(side > plane[1])]
        if max(map(len, parts)) < 0.9 * len(x):
            for rows in parts:
                for part in parts_of(x[rows], rng, level + 1):
                    yield rows[part]
            return
    yield np.arange(len(x))


def reached(x: np.ndarray, y: np.ndarray, exact_x: np.ndarray, exact_y: np.ndarray, least: float) -> np.ndarray:
    """Whether the cosine of each row of x and each of y is least or more, as a matrix. x, y: unit vectors in single precision;
    exact_x, exact_y: as given."""
    slack = max(SLACK, x.shape[1] * 2.0**-23)
    cos = x @ y.T
    out = cos >= least + slack
    i, j = np.nonzero((cos >= least - slack) & ~out)
    for k in range(0, len(i), 50_000):
        u, v = exact_x[i[k : k + 50_000]], exact_y[j[k : k + 50_000]]
        cos = np.einsum("ij,ij->i", u, v) / (np.sqrt(np.einsum("ij,ij->i", u, u)) * np.sqrt(np.einsum("ij,ij->i", v, v)))
        out[i[k : k + 50_000], j[k : k + 50_000]] = cos >= least
    return out


def leaf_pairs(x: np.ndarray, exact: np.ndarray, least: float, rng):
    """(i, j) arrays of rows of a leaf whose cosine is least or more. x: unit vectors in single precision; exact: as given."""
    for rows in parts_of(x, rng):
        for a in range(0, len(rows), 1024):
            for b in range(a, len(rows), 1024):
                u, v = rows[a : a + 1024], rows[b : b + 1024]
                i, j = np.nonzero(reached(x[u], x[v], exact[u], exact[v], least))
                if a == b:
                    i, j = i[i < j], j[i < j]
                yield u[i], v[j]


def joining(pairs, n: int):
    """Of (i, j) arrays over n rows those that join two groups not joined before: a spanning forest."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            if not len(i):
                break
            high, low = np.maximum(label[i], label[j]), np.minimum(label[i], label[j])
            high, first = np.unique(high, return_index=True)
            yield i[first], j[first]
            parent = np.arange(n)
            parent[high] = low[first]
            while (parent[parent] != parent).any():
                parent = parent[parent]
            label = parent[label]


def counted(x: np.ndarray, exact: np.ndarray, copies: np.ndarray, second: np.ndarray, own: bool, least: float) -> np.ndarray:
    """Copies that each row links with: rows of the first block with those of the second one, or a block with itself (own)."""
    out = np.zeros(len(x))
    left, right = (np.arange(len(x)),) * 2 if own else (np.flatnonzero(~second), np.flatnonzero(second))
    for a in range(0, len(left), 1024):
        for b in range(a if own else 0, len(right), 1024):
            u, v = left[a : a + 1024], right[b : b + 1024]
            hit = reached(x[u], x[v], exact[u], exact[v], least)
            if own and a == b:
                np.fill_diagonal(hit, False)
                hit &= hit.T
            hit = hit.astype(np.float64)
            out[u] += hit @ copies[v]
            if not (own and a == b):
                out[v] += copies[u] @ hit
    return out


def _closed(batches):
    """Batches, then None."""
    yield from batches
    yield None


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in single precision, vectors as given) of a group's rows."""
    exact = np.frombuffer(b"".join(table.column("v").to_pylist()), "<f8").reshape(len(table), -1)
    return unit(exact).astype(np.float32), exact


def vector_groups(vectors: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, trees: int = TREES, sample_rows: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """A row for each row of vectors: vec_id, n_links, component_id."""
    spark = vectors.sparkSession

    def packed(batches):
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                v = np.array([np.nan if c is None else c for c in v], "<f8") if v is not None else np.zeros(0)
                with np.errstate(over="ignore"):
                    ok = len(v) and np.isfinite(v).all() and 0 < (v * v).sum() < np.inf
                out.append((v + 0.0).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = scratch.keep(arrow_map(rows, packed, "vec_id long, v binary"), "vectors")
    reps = rows.where("v is not null and vec_id is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    reps = scratch.keep(reps, "reps")

    sizes = scratch.keep(reps.groupBy(F.length("v").alias("bytes")).agg(F.count(F.lit(1)).alias("n")), "sizes")
    forest: dict[int, list[tuple]] = {}
    for size in sizes.where(F.col("n") > leaf).orderBy(F.desc("n"), "bytes").limit(FITTED).collect():
        picked = reps.where(F.length("v") == size["bytes"]).select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow()
        x = unit(np.frombuffer(b"".join(picked.column("v").to_pylist()), "<f8").reshape(len(picked), -1))
        forest[size["bytes"]] = [plant(x, int(np.ceil(np.log2(size["n"] / leaf))), 100 + t) for t in range(trees)]
    planted = spark.sparkContext.broadcast(forest)  # bounded by SAMPLE, not by the table

    def placed(v: list[bytes], depth: np.ndarray, t: int, lengths: dict[int, np.ndarray], units: dict[int, np.ndarray]):
        """(leaf, row) arrays of all vectors in tree t; a length without levels has one leaf, in the first tree."""
        leaves, at = [], []
        for size, rows in lengths.items():
            levels = int(depth[rows[0]])
            if t and not levels:
                continue
            nodes, middles = planted.value[size][t] if size in planted.value else ({}, {})
            for node, part in descend(units[size], nodes):
                for end, part in further(units[size], part, node, levels - node.bit_length() + 1, t, middles.get(node)):
                    leaves.append(np.full(len(part), (size << 44) + (t << 36) + end, np.int64))
                    at.append(rows[part])
        return (np.concatenate(leaves), np.concatenate(at)) if leaves else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def dealt(batches):
        """Rows by leaf, a batch a tree, for DEALT rows at a time."""
        held, n = [], 0
        for batch in _closed(batches):
            if batch is not None and batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if not n or (batch is not None and n < DEALT):
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            v, depth = table.column("v").to_pylist(), table.column("depth").to_numpy()
            table, held, n = table.drop_columns(["depth"]), [], 0
            length = np.array([len(b) for b in v])
            lengths = {int(size): np.flatnonzero(length == size) for size in np.unique(length)}
            units = {size: unit(np.frombuffer(b"".join(v[i] for i in rows), "<f8").reshape(len(rows), -1)) for size, rows in lengths.items()}
            for t in range(trees):
                leaves_of, at = placed(v, depth, t, lengths, units)
                if len(at):
                    yield from table.take(pa.array(at)).add_column(0, "leaf", pa.array(leaves_of)).combine_chunks().to_batches()

    def leaves(rows: DataFrame, more: str = "") -> DataFrame:
        # a row a length of vectors, with the levels that its number asks for
        deep = sizes.select("bytes", F.when(F.col("n") > leaf, F.ceil(F.log2(F.col("n") / leaf))).otherwise(0).cast("int").alias("depth"))
        rows = rows.join(deep, F.length("v") == F.col("bytes")).select("id", "v", "depth", *[c for c in rows.columns if c not in ("id", "v")])
        rows = arrow_map(rows, dealt, f"leaf long, id long, v binary{more}")
        return rows.repartition(partitions(spark), "leaf").sortWithinPartitions("leaf", "id")

    def leaf_rng(table: pa.Table):
        return np.random.default_rng(int(table.column("leaf")[0].as_py()) % (1 << 32))

    def linked(batches):
        for table in _grouped(batches, 1):
            ids = table.column("id").to_numpy()
            if len(ids) < 2:
                continue
            x, exact = _vectors(table)
            for i, j in joining(leaf_pairs(x, exact, least, leaf_rng(table)), len(ids)):
                yield _pairs(np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]))

    def labelled(groups: DataFrame) -> DataFrame:
        """id, component, m (its members) of vectors that are linked."""
        return groups.join(groups.groupBy("component").agg(F.count(F.lit(1)).alias("m")), "component").select("id", "component", "m")

    links = scratch.keep(arrow_map(leaves(reps.select("id", "v")), linked, "a long, b long").where("a <> b").distinct(), "links")
    groups = scratch.keep(components(links, scratch, "first_"), "groups1")

    # components larger than a leaf: whoever comes near one of their members meets them all
    dense = scratch.keep(labelled(groups).where(F.col("m") > leaf), "dense")
    if dense.limit(1).count():
        around = 2 * least * least - 1 if least > 0 else -1.0

        def near(batches):
            for table in _grouped(batches, 1):
                is_dense = table.column("dense").to_numpy(zero_copy_only=False).astype(bool)
                if not is_dense.any() or len(is_dense) < 2:
                    continue
                ids, comp = table.column("id").to_numpy(), table.column("component").to_numpy()
                x, _ = _vectors(table)
                found = set()
                for rows in parts_of(x, leaf_rng(table)):
                    theirs = rows[is_dense[rows]]
                    for c in np.unique(comp[theirs]).tolist():
                        members, others = theirs[comp[theirs] == c], rows[comp[rows] != c]
                        for a in range(0, len(others), 1024):
                            u = others[a : a + 1024]
                            for b in range(0, len(members), 1024):
                                hit = (x[u] @ x[members[b : b + 1024]].T >= around - SLACK).any(axis=1)
                                found.update((i, c) for i in ids[u[hit]].tolist())
                                u = u[~hit]
                if found:
                    yield _pairs(*map(list, zip(*sorted(found))))

        def met(batches):
            for table in _grouped(batches, 2):
                probe = table.column("probe").to_numpy(zero_copy_only=False).astype(bool)
                if probe.all() or not probe.any():
                    continue
                ids, (x, exact) = table.column("id").to_numpy(), _vectors(table)
                home, probes = np.flatnonzero(~probe), np.flatnonzero(probe)
                for a in range(0, len(probes), 1024):
                    u = probes[a : a + 1024]
                    for b in range(0, len(home), 1024):
                        v = home[b : b + 1024]
                        hit = reached(x[u], x[v], exact[u], exact[v], least)
                        some = hit.any(axis=1)
                        i, j = ids[u[some]], ids[v[hit[some].argmax(axis=1)]]
                        yield _pairs(np.minimum(i, j), np.maximum(i, j))
                        u = u[~some]

        marked = reps.join(groups, "id", "left").join(dense.select("id", F.lit(True).alias("dense")), "id", "left")
        marked = marked.select("id", "v", F.coalesce("component", "id").alias("component"), F.coalesce("dense", F.lit(False)).alias("dense"))
        probes = scratch.keep(arrow_map(leaves(marked, ", component long, dense boolean"), near, "a long, b long").distinct(), "probes")
        sizes_of = dense.select("component", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")).distinct()
        home = dense.select("component", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / BLOCK)).cast("int").alias("block"), "id", F.lit(False).alias("probe"))
        strays = probes.select(F.col("a").alias("id"), F.col("b").alias("component")).join(sizes_of, "component")
        strays = strays.select("component", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "id", F.lit(True).alias("probe"))
        blocks = home.unionByName(strays).join(reps.select("id", "v"), "id").select("component", "block", "id", "probe", "v")
        blocks = blocks.repartition(partitions(spark), "component", "block").sortWithinPartitions("component", "block", "id")
        more = scratch.keep(arrow_map(blocks, met, "a long, b long").distinct(), "links2")
        groups = scratch.keep(components(links.unionByName(more), scratch, "second_"), "groups2")

    def tallied(batches):
        for table in _grouped(batches, 3):
            x, exact = _vectors(table)
            own = table.column("first")[0] == table.column("other")[0]
            n = counted(x, exact, table.column("copies").to_numpy().astype(np.float64), table.column("second").to_numpy(zero_copy_only=False).astype(bool), own, least)
            yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), pa.array(n.astype(np.int64))], names=["id", "links"])

    # each two blocks of a component meet once, and each block itself
    placed = labelled(groups).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met_by = placed.select("component", "id", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("k"))
    met_by = met_by.select("component", F.least("block", "k").alias("first"), F.greatest("block", "k").alias("other"), "id", (F.col("block") > F.col("k")).alias("second"))
    blocks = met_by.join(reps.select("id", "v", "copies"), "id").select("component", "first", "other", "id", "second", "copies", "v")
    blocks = blocks.repartition(partitions(spark), "component", "first", "other").sortWithinPartitions("component", "first", "other", "id")
    others = scratch.keep(arrow_map(blocks, tallied, "id long, links long").groupBy("id").agg(F.sum("links").alias("links")), "tallies")
    facts = reps.join(others, "id", "left").join(groups, "id", "left").select(
        "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    # the vector's digest joins a row to its facts: the bytes themselves needn't travel twice
    facts = facts.select(F.sha2("v", 256).alias("digest"), "n_links", "component_id")
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.sha2("v", 256)).alias("digest")).join(facts, "digest", "left")
    out = scratch.keep(out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")), "groups")
    scratch.drop("vectors", "reps", "sizes", "links", "groups1", "dense", "probes", "links2", "groups2", "tallies")
    return out


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, CASE WHEN list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x))) AND list_dot_product(v, v) > 0 THEN v END AS v
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.95),
c AS (SELECT vec_id AS id, vec_id AS to_id FROM e UNION SELECT c.id, l.b FROM c JOIN l ON c.to_id = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM e JOIN (SELECT id, min(to_id) AS component_id FROM c GROUP BY id) m ON m.id = e.vec_id
"""


#: Copies of every fourth vector, moved a little in each number, so that there are links to find.
COPIES, EVERY = 3, 4
MOVED = "((vec_id * 31 + i * 17 + c * 7) % 11 - 5) * 0.005"


def planted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the table and moved copies of every fourth, compared like op2_embedding_dedup's."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    copies = vectors.where(F.col("vec_id") % EVERY == 0).withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    moved = F.expr(f"transform(embedding, (x, i) -> x + {MOVED.replace('0.005', '0.005D')})")
    out = vector_groups(vectors.unionByName(copies.select((F.col("vec_id") + F.col("c") * 10_000_000).alias("vec_id"), moved.alias("embedding"))), Scratch(spark))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


PLANTED_SQL = ORACLE_SQL.replace("FROM embeddings)", f"""FROM (
    SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings
    UNION ALL SELECT vec_id + c * 10000000, list_transform(embedding::DOUBLE[], lambda x, k: x + {MOVED.replace(' i ', ' (k - 1) ').replace('0.005', '0.005::DOUBLE')})
    FROM embeddings, unnest(range(1, {COPIES + 1})) t(c) WHERE vec_id % {EVERY} = 0))""")
