"""Distances, nearest-neighbour graphs, components over all k, and graph curvature.

Nearest neighbours are found without pairing all rows: pivots cut the sphere into cells, and by the triangle inequality of
angles a row visits only cells that can hold one of its k nearest.  Components of all k come from one spanning forest.

Defined cases: rows with a null key or vector, or with null or non-finite entries, take no part; shorter vectors count as
if filled up with zeros; a zero vector is at distance 1 from all others; equal vectors are searched once, rows of one key
are one node by the first of their vectors in order; ties go to the smaller key; fewer than k others are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.shared import written

#: Rows of a cell that are searched at once; pivots that are gathered (a sample of rows, which shapes cells and no result).
UNIT_ROWS, MOST_PIVOTS, ROWS_PER_PIVOT = 4096, 4096, 512
#: A row is sent once to each shard that may hold a near one: numbers in a shard, shards of smaller tables, tasks that share the visitors of a shard.
SHARD_VALUES, LEAST_SHARDS, GUEST_PARTS = 1 << 22, 16, 4
#: What rounding can add to an angle.
MARGIN = 1e-7
#: A free place of a list.
NONE = np.iinfo(np.int64).max


def nodes_of(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(node, x): one row a key, its vector as doubles, of the rows that take part."""
    usable = F.forall("x", lambda t: t.isNotNull() & ~F.isnan(t) & (F.abs(t) < F.lit(float("inf"))))
    rows = vectors.select(F.col(key).alias("node"), F.col(vector).cast("array<double>").alias("x")).where(F.col("node").isNotNull() & F.col("x").isNotNull()).where(usable)
    rows = written(rows.groupBy("node").agg(F.min("x").alias("x")), "nodes")
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 0
    return rows.select("node", F.when(F.size("x") < dim, F.concat("x", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("x")))).otherwise(F.col("x")).alias("x"))


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """(x, ids): different vectors with the k + 1 least keys of each; copies are thinned out before they are shuffled."""
    place = F.row_number().over(Window.partitionBy("x").orderBy("node"))
    return rows.withColumn("_place", place).where(F.col("_place") <= k + 1).groupBy("x").agg(F.array_sort(F.collect_list("node")).alias("ids"))


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles of unit vectors, from their chords where they are small; a zero vector is at a right angle to all."""
    dots = a @ b.T
    chords = np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * dots, 0))
    zero = ((a * a).sum(axis=1) == 0)[:, None] | ((b * b).sum(axis=1) == 0)[None]
    return np.where(zero, np.pi / 2, 2 * np.arcsin(np.minimum(1.0, chords / 2)))


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = vectors.flatten() if isinstance(vectors, pa.Array) else vectors.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(vectors), len(flat) // max(1, len(vectors)))


def _take_in(near_d: np.ndarray, near_j: np.ndarray, rows: np.ndarray, q: np.ndarray, x: np.ndarray, places: np.ndarray, own: np.ndarray | None = None) -> None:
    """Keep in the lists of the ``rows`` of ``q`` their k least (distance, place), now that ``x`` at ``places`` is met too.

    Both hold unit vectors.  Single precision only leaves out what a bound on its error rules out; distances are of double precision.
    """
    k, slack, single = near_d.shape[1], (x.shape[1] + 8) * 2.0**-23, x.astype(np.float32).T
    step = max(64, (1 << 20) // len(x))
    for a in range(0, len(rows), step):
        at = rows[a : a + step]
        dots = q[at].astype(np.float32) @ single
        floor = 1 - near_d[at, -1] - 2 * slack
        if len(x) > k + 1 and np.isinf(floor).any():  # no list of k yet
            floor = np.maximum(floor, np.partition(dots, -k - 1, axis=1)[:, -k - 1] - 3 * slack)
        r, c = np.nonzero(dots >= floor.astype(np.float32)[:, None])
        if own is not None:
            r, c = (t[own[at[r]] != places[c]] for t in (r, c))
        if not len(r):
            continue
        d = np.maximum(0.0, 1 - np.minimum(1.0, np.einsum("ij,ij->i", q[at[r]], x[c])))
        some = np.unique(r)
        row, d, j = np.append(r, some.repeat(k)), np.append(d, near_d[at[some]]), np.append(places[c], near_j[at[some]])
        order = np.lexsort((j, d, row))
        row = row[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        kept = order[(first[:, None] + np.arange(k)).ravel()]
        near_d[at[some]], near_j[at[some]] = d[kept].reshape(-1, k), j[kept].reshape(-1, k)


def _listed(near_d: np.ndarray, near_j: np.ndarray, names: pa.Array) -> pa.Array:
    """The lists as arrays of (d, j), without their free places."""
    full = near_j < len(names)
    ends = np.append(0, full.sum(axis=1).cumsum()).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(near_d[full]), names.take(pa.array(near_j[full]))], ["d", "j"])
    return pa.ListArray.from_arrays(pa.array(ends), pairs)


def nearest(vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(i, j, d, rank): the k nearest others of every row by cosine distance, exactly."""
    spark, rows = vectors.sparkSession, written(nodes_of(vectors, key, vector), "vectors")
    kind = dict(rows.dtypes)["node"]
    classes = written(_classes(rows, k).withColumn("cid", F.col("ids")[0]), "classes")
    n = classes.count()
    none = spark.createDataFrame([], f"i {kind}, j {kind}, d double, rank int")
    if not n:
        return none
    drawn = classes.orderBy(F.xxhash64("x"), "cid").limit(max(1, min(MOST_PIVOTS, n // ROWS_PER_PIVOT))).select("x").toPandas()
    shared = spark.sparkContext.broadcast(_unit(np.stack(drawn["x"].to_numpy()).astype(float)))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles = _angles(_unit(_matrix(batch["x"])), shared.value)
                yield pa.RecordBatch.from_arrays([batch["cid"], batch["x"], pa.array(angles.argmin(axis=1).astype(np.int32)), pa.array(angles.min(axis=1))], ["cid", "x", "cell", "angle"])

    settled = written(classes.select("cid", "x").mapInArrow(settle, f"cid {kind}, x array<double>, cell int, angle double"), "cells")
    cells = settled.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).toPandas().set_index("cell")  # at most MOST_PIVOTS rows
    # cells along the widest direction of the pivots, so that near ones tend to share a shard; a large cell has several units
    along = shared.value @ np.linalg.svd(shared.value, full_matrices=False)[2][0] if shared.value.shape[1] else np.zeros(len(drawn))
    cells = cells.loc[sorted(cells.index, key=lambda c: along[c])]
    parts = -(-cells["n"].to_numpy() // UNIT_ROWS)
    size = np.repeat(cells["n"].to_numpy() / parts, parts)
    shards = min(len(size), max(LEAST_SHARDS, -(-n * shared.value.shape[1] // SHARD_VALUES)))
    shard = np.minimum(shards - 1, (size.cumsum() - size / 2) * shards // n).astype(int)
    shard = np.unique(shard, return_inverse=True)[1]
    unit_cell, radius = np.repeat(cells.index.to_numpy(), parts), np.repeat(cells["radius"].to_numpy(), parts)
    unit_no = np.arange(len(size)) - np.repeat(parts.cumsum() - parts, parts)
    by_unit = spark.sparkContext.broadcast((unit_cell, unit_no, radius, np.flatnonzero(np.append(True, np.diff(shard)))))
    dealt = [(int(c), shard[unit_cell == c].tolist()) for c in cells.index]
    units = settled.join(F.broadcast(spark.createDataFrame(dealt, "cell int, shards array<int>")), "cell").withColumn("unit", F.pmod(F.xxhash64("cid"), F.size("shards")).cast("int"))
    units = units.select("cell", "unit", F.get("shards", F.col("unit")).alias("shard"), "cid", "x")
    listed = f"array<struct<d:double,j:{kind}>>"

    def reached(own: np.ndarray, bound: np.ndarray, cell: np.ndarray, unit: np.ndarray, of: slice) -> np.ndarray:
        """Which units, their own left out, can hold a row within the bound."""
        unit_cell, unit_no, radius, _ = by_unit.value
        names, at = np.unique(unit_cell[of], return_inverse=True)
        near = _angles(own, shared.value[names])[:, at] - radius[None, of] <= bound[:, None] + MARGIN
        return near & ~((cell[:, None] == unit_cell[None, of]) & (unit[:, None] == unit_no[None, of]))

    def home(table: pa.Table) -> pa.Table:
        own, order = _unit(_matrix(table["x"])), pc.sort_indices(table["cid"])
        names, place = table["cid"].take(order).combine_chunks(), np.empty(table.num_rows, int)
        place[order.to_numpy()] = np.arange(table.num_rows)
        near_d, near_j = np.full((len(own), k), np.inf), np.full((len(own), k), NONE)
        _take_in(near_d, near_j, np.arange(len(own)), own, own, place, place)
        bound = np.where(np.isinf(near_d[:, -1]), np.inf, np.arccos(np.maximum(-1.0, 1 - np.minimum(2.0, near_d[:, -1]))))
        visits = []
        for a in range(0, len(own), 512):
            some = slice(a, a + 512)
            visits.append(np.logical_or.reduceat(reached(own[some], bound[some], table["cell"].to_numpy()[some], table["unit"].to_numpy()[some], slice(None)), by_unit.value[3], axis=1))
        visits = np.concatenate(visits)
        to = pa.ListArray.from_arrays(pa.array(np.append(0, visits.sum(axis=1).cumsum()).astype(np.int32)), pa.array(np.nonzero(visits)[1].astype(np.int32)))
        return pa.table({"cid": table["cid"], "x": table["x"], "cell": table["cell"], "unit": table["unit"], "shard": table["shard"], "limit": near_d[:, -1], "bound": bound, "visits": to, "near": _listed(near_d, near_j, names)})

    first = written(units.groupBy("cell", "unit").applyInArrow(home, f"cid {kind}, x array<double>, cell int, unit int, shard int, limit double, bound double, visits array<int>, near {listed}"), "near-home")
    key = F.col("to") * GUEST_PARTS + F.col("part")
    sent = first.withColumn("part", F.pmod("shard", F.lit(GUEST_PARTS))).withColumn("to", F.explode("visits")).select(key.alias("key"), F.lit(1).alias("kind"), "cell", "unit", "cid", "x", "limit", "bound")
    nothing = F.lit(None).cast("double")
    waiting = units.withColumn("to", F.col("shard")).withColumn("part", F.explode(F.array(*map(F.lit, range(GUEST_PARTS))))).select(key.alias("key"), F.lit(0).alias("kind"), "cell", "unit", "cid", "x", nothing.alias("limit"), nothing.alias("bound"))

    def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a shard, then its visitors, searched as they stream past."""
        unit_cell, unit_no, _, starts = by_unit.value
        at, held, blocks = None, [], []
        for batch in batches:
            where = batch["key"].to_numpy() * 2 + batch["kind"].to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(where)) + 1, len(where))
            for a, b in zip(np.append(0, cuts[:-1]), cuts):
                if a == b:
                    continue
                some = batch.slice(a, b - a)
                if where[a] // 2 != at:
                    at, held, blocks = where[a] // 2, [], []
                if where[a] % 2 == 0:
                    held.append(some)
                    continue
                if not blocks:  # the shard is whole
                    table, held = pa.Table.from_batches(held), []
                    order = pc.sort_indices(table["cid"])
                    names, place = table["cid"].take(order).combine_chunks(), np.empty(table.num_rows, int)
                    place[order.to_numpy()] = np.arange(table.num_rows)
                    x, cell, unit = _unit(_matrix(table["x"])), table["cell"].to_numpy(), table["unit"].to_numpy()
                    no = at // GUEST_PARTS
                    of = slice(starts[no], starts[no + 1] if no + 1 < len(starts) else len(unit_cell))
                    rows_of = [np.flatnonzero((cell == c) & (unit == u)) for c, u in zip(unit_cell[of], unit_no[of])]
                    blocks = [(x[r], place[r]) for r in rows_of]
                    del table, x
                q = _unit(_matrix(some["x"]))
                go = reached(q, some["bound"].to_numpy(), some["cell"].to_numpy(), some["unit"].to_numpy(), of)
                near_d, near_j = np.repeat(some["limit"].to_numpy()[:, None], k, axis=1), np.full((len(q), k), NONE)
                for i, (x, place) in enumerate(blocks):
                    rows = np.flatnonzero(go[:, i])
                    if len(rows) and len(x):
                        _take_in(near_d, near_j, rows, q, x, place)
                yield pa.RecordBatch.from_arrays([some["cid"], _listed(near_d, near_j, names)], ["cid", "near"])

    tasks = 4 * GUEST_PARTS * (int(shard.max()) + 1)
    met = waiting.unionByName(sent).repartition(tasks, "key").sortWithinPartitions("key", "kind", "cell", "unit").mapInArrow(pass_by, f"cid {kind}, near {listed}").where("size(near) > 0")
    merged = first.select("cid", "near").unionByName(met).groupBy("cid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    ids = classes.select(F.col("cid").alias("_j"), "ids")
    spread = merged.select("cid", F.explode("near").alias("e")).join(ids, F.col("e.j") == F.col("_j")).select("cid", F.explode("ids").alias("j"), F.col("e.d").alias("d"))
    zero = F.forall("x", lambda t: t == 0)
    same = classes.select("cid", F.explode("ids").alias("j"), F.when(zero, 1.0).otherwise(0.0).alias("d"))
    options = spread.unionByName(same).groupBy("cid").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "j"))), 1, 2 * k + 1).alias("options"))
    members = rows.join(classes.select("x", "cid"), "x").select(F.col("node").alias("i"), "cid").join(options, "cid")
    own = F.slice(F.filter("options", lambda o: o["j"] != F.col("i")), 1, k)
    return members.select("i", F.posexplode(own).alias("rank", "o")).select("i", F.col("o.j").alias("j"), F.col("o.d").alias("d"), (F.col("rank") + 1).alias("rank"))


def cosine_pairs(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Cosine distance of all pairs i < j of a bounded set of vectors; a zero vector is at distance 1 from all."""
    v = vectors.select(F.col(key).alias("i"), F.col(vector).cast("array<double>").alias("x"))
    v = v.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, t: a + t * t)))
    w = v.withColumnsRenamed({"i": "j", "x": "y", "norm": "norm_y"})
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda a, t: a + t)
    cosine = F.when((F.col("norm") > 0) & (F.col("norm_y") > 0), dot / (F.col("norm") * F.col("norm_y"))).otherwise(0.0)
    return v.join(w, F.col("i") < F.col("j")).select("i", "j", F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), cosine)).alias("d"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("i", "j", "d").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))


def ranked_neighbours(pairs: DataFrame) -> DataFrame:
    """Every ordered pair with the rank of j among i's neighbours; ties go to the smaller j; a node is no neighbour of its own."""
    return both_ways(pairs).where("i <> j").withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j")))


def knn_edges(pairs: DataFrame, k: int, mutual: bool = False) -> DataFrame:
    """``knn_graph`` of a table of all pairs."""
    return knn_graph(ranked_neighbours(pairs), k, mutual)


def knn_graph(near: DataFrame, k: int, mutual: bool = False) -> DataFrame:
    """Undirected edges i < j of the k-nearest-neighbour graph of (i, j, d, rank): of either side's list, or of both if mutual."""
    near = near.where(F.col("rank") <= k)
    edges = near.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.min("d").alias("d"), F.count("*").alias("sides"))
    return (edges.where("sides = 2") if mutual else edges).drop("sides")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(i, j, w): a minimum spanning forest of undirected edges (i, j, w), ties by i and j."""
    return _merged(edges)[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of the component of each node of (i, j, w); an edge from a node to itself only names it."""
    nodes = edges.select(F.explode(F.array("i", "j")).alias("node")).distinct()
    joined = _merged(edges)[1]
    if joined is None:
        return nodes.withColumn("label", F.col("node"))
    least = joined.groupBy("root").agg(F.min("node").alias("label"))
    labels = joined.join(least, "root").select(F.col("node").alias("_node"), "label")
    return nodes.join(labels, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("label", "node").alias("label"))


def _merged(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The forest, and (node, root) of all nodes that an edge joins to another.

    In each round every component takes its least edge to another one, and components that are joined become one; there
    are as many rounds as the logarithm of the number of nodes.  Tables are written between steps, so a lost executor
    costs no round.
    """
    edges = written(edges.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "w"), "forest-edges")
    live, forest, joined = edges.select("i", "j", "w", F.col("i").alias("a"), F.col("j").alias("b")), None, None
    while True:
        both = live.select("a", F.struct("w", "i", "j", F.col("b").alias("to")).alias("e")).unionByName(live.select(F.col("b").alias("a"), F.struct("w", "i", "j", F.col("a").alias("to")).alias("e")))
        chosen = written(both.groupBy("a").agg(F.min("e").alias("e")), "forest-chosen")
        if chosen.isEmpty():
            break
        taken = chosen.select("e.i", "e.j", "e.w").distinct()
        forest = taken if forest is None else forest.unionByName(taken)
        # two components that chose each other: the lesser one is the root
        other = chosen.select(F.col("a").alias("_t"), F.col("e.to").alias("_back"))
        up = chosen.join(other, F.col("e.to") == F.col("_t"), "left")
        up = written(up.select("a", F.when((F.col("_back") == F.col("a")) & (F.col("a") < F.col("e.to")), F.col("a")).otherwise(F.col("e.to")).alias("up")), "forest-up")
        while True:
            above = up.select(F.col("a").alias("_a"), F.col("up").alias("_up"))
            further = written(up.join(above, F.col("up") == F.col("_a"), "left").select("a", F.coalesce("_up", "up").alias("next"), "up"), "forest-up")
            if further.where("next <> up").isEmpty():
                break
            up = further.select("a", F.col("next").alias("up"))
        roots = up.select(F.col("a").alias("_a"), F.col("up").alias("_up"))
        joined = up.select(F.col("a").alias("node"), F.col("up").alias("root")) if joined is None else written(joined.join(roots, F.col("root") == F.col("_a"), "left").select("node", F.coalesce("_up", "root").alias("root")), "forest-joined")
        ends = {c: up.select(F.col("a").alias(f"_{c}"), F.col("up").alias(f"_to_{c}")) for c in "ab"}
        moved = live.join(ends["a"], F.col("a") == F.col("_a"), "left").join(ends["b"], F.col("b") == F.col("_b"), "left")
        moved = moved.select("i", "j", "w", F.coalesce("_to_a", "a").alias("a"), F.coalesce("_to_b", "b").alias("b")).where("a <> b")
        # of parallel edges between two components the least is enough
        live = written(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("w", "i", "j")).alias("e")).select("e.i", "e.j", "e.w", "a", "b"), "forest-live")
    return edges.where("false") if forest is None else forest, joined


def sweep_of(near: DataFrame, k_min: int = 3, k_max: int = 40, mutual: bool = False) -> DataFrame:
    """Per k: components, and the run of k with the same partition that it belongs to, of the graphs of (i, j, d, rank).

    An edge is in the graphs from the rank of its nearer end on (of its farther end, if mutual).  The graphs contain each
    other, so one spanning forest by that rank holds the components of all of them: each forest edge of a rank joins two
    components, and the partition changes at the ranks that the forest has.
    """
    spark = near.sparkSession
    near = written(near, "near")
    need = (F.max if mutual else F.min)("rank")
    edges = near.where(F.col("rank") <= k_max).groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(need.alias("w"), F.count("*").alias("sides"))
    forest = spanning_forest((edges.where("sides = 2") if mutual else edges).select("i", "j", "w"))
    nodes = near.select(F.explode(F.array("i", "j")).alias("node")).agg(F.count_distinct("node").alias("nodes"))
    joins = forest.groupBy(F.greatest(F.col("w"), F.lit(k_min)).alias("k")).agg(F.count("*").alias("joins"))  # one row a k
    ks = spark.range(k_min, k_max + 1).select(F.col("id").cast("int").alias("k")).join(joins, "k", "left").join(F.broadcast(nodes))
    order = Window.orderBy("k")
    steps = ks.withColumn("components", F.col("nodes") - F.coalesce(F.sum("joins").over(order), F.lit(0)))
    runs = steps.withColumn("run", F.sum(F.when((F.col("k") > k_min) & F.col("joins").isNotNull(), 1).otherwise(0)).over(order)).where("nodes > 0")
    return runs.withColumn("run_length", F.count("*").over(Window.partitionBy("run"))).select("k", "components", "run", "run_length")


def component_sweep(pairs: DataFrame, k_min: int = 3, k_max: int = 40, mutual: bool = False) -> DataFrame:
    """``sweep_of`` the neighbours in a table of all pairs."""
    return sweep_of(ranked_neighbours(pairs), k_min, k_max, mutual)


def plateau(sweep: DataFrame) -> dict | None:
    """The longest run of at least 2 k with one partition of several components; the first of equals.  Strong from 5 on."""
    r = sweep.where("components > 1 and run_length >= 2").groupBy("run", "run_length", "components").agg(F.min("k").alias("k")).orderBy(F.desc("run_length"), "k").first()
    return r and {"k": r["k"], "length": r["run_length"], "components": r["components"], "strong": r["run_length"] >= 5}


def transport(mass_x: np.ndarray, mass_y: np.ndarray, cost: np.ndarray) -> float:
    """Least cost of moving one distribution to another: successive shortest augmenting paths on the bipartite graph."""
    n, m = cost.shape
    left, right, flow = mass_x.astype(float).copy(), mass_y.astype(float).copy(), np.zeros((n, m))

    while left.sum() > 1e-12 and right.sum() > 1e-12:
        # Bellman-Ford over the residual graph, from sources with mass left
        du, dv = np.where(left > 1e-12, 0.0, np.inf), np.full(m, np.inf)
        from_u, from_v = np.full(n, -1), np.full(m, -1)
        for _ in range(n + m):
            reach = du[:, None] + cost
            best = reach.argmin(axis=0)
            better = reach[best, np.arange(m)] < dv - 1e-12
            dv[better], from_v[better] = reach[best, np.arange(m)][better], best[better]
            back = np.where(flow > 1e-12, dv[None] - cost, np.inf)
            bj = back.argmin(axis=1)
            improved = back[np.arange(n), bj] < du - 1e-12
            du[improved], from_u[improved] = back[np.arange(n), bj][improved], bj[improved]
            if not better.any() and not improved.any():
                break
        j = int(np.where(right > 1e-12, dv, np.inf).argmin())
        path, i = [], -1
        end, amount = j, right[j]
        while True:
            i = int(from_v[j])
            path.append((i, j, 1))
            if from_u[i] < 0:
                amount = min(amount, left[i])
                break
            k = int(from_u[i])
            path.append((i, k, -1))
            amount = min(amount, flow[i, k])
            j = k
        for a, b, sign in path:
            flow[a, b] += sign * amount
        left[i] -= amount
        right[end] -= amount
    return float((flow * cost).sum())


def sinkhorn(mass_x: np.ndarray, mass_y: np.ndarray, cost: np.ndarray, reg: float = 0.05, iterations: int = 300) -> float:
    """Entropic approximation of the transport cost."""
    kernel = np.exp(-cost / (reg * max(cost.max(), 1e-12)))
    a = np.ones(len(mass_x))
    for _ in range(iterations):
        b = mass_y / np.maximum(kernel.T @ a, 1e-300)
        a = mass_x / np.maximum(kernel @ b, 1e-300)
    return float((a[:, None] * kernel * b[None] * cost).sum())


def shortest_paths(nodes: int, edges: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    d = np.full((nodes, nodes), np.inf)
    np.fill_diagonal(d, 0)
    d[edges[:, 0], edges[:, 1]] = d[edges[:, 1], edges[:, 0]] = lengths
    for k in range(nodes):
        d = np.minimum(d, d[:, k : k + 1] + d[k])
    return d


def ollivier_ricci(edges: DataFrame, alpha: float = 0.5, weighted: bool = False, method: str = "exact") -> DataFrame:
    """Curvature of every edge (i, j, d) of a bounded graph: 1 - W1 / d(i, j), in parallel over edges.

    A node keeps ``alpha`` of its mass, the rest goes to its neighbours, evenly or by 1 / d.  The ground
    distances are shortest paths (in steps, or in d if weighted); unreachable nodes are 10 times the longest path and 1 away.
    """
    if not 0 <= alpha < 1:
        raise ValueError("alpha must be in [0, 1)")
    table = edges.select("i", "j", "d").toPandas()  # one graph, whose ground matrix every task needs
    names = np.unique(table[["i", "j"]].to_numpy())
    pair = np.searchsorted(names, table[["i", "j"]].to_numpy())
    length = np.maximum(table["d"].to_numpy(float), 1e-12) if weighted else np.ones(len(table))
    ground = shortest_paths(len(names), pair, length)
    longest = ground[np.isfinite(ground)].max(initial=0.0)
    ground = np.where(np.isfinite(ground), ground, 10 * longest + 1)
    weight = np.zeros_like(ground)
    weight[pair[:, 0], pair[:, 1]] = weight[pair[:, 1], pair[:, 0]] = 1 / length if weighted else 1.0
    shared = edges.sparkSession.sparkContext.broadcast((names, ground, weight))

    def run(batches):
        names, ground, weight = shared.value
        move = transport if method == "exact" else sinkhorn
        for pdf in batches:
            found = []
            for a, b in zip(np.searchsorted(names, pdf["i"]), np.searchsorted(names, pdf["j"])):
                sides = []
                for x in (a, b):
                    near = np.flatnonzero(weight[x])
                    sides.append((np.append(near, x), np.append((1 - alpha) * weight[x, near] / weight[x, near].sum(), alpha)))
                (sx, mx), (sy, my) = sides
                found.append(1 - move(mx, my, ground[np.ix_(sx, sy)]) / ground[a, b])
            yield pd.DataFrame({"i": pdf["i"], "j": pdf["j"], "curvature": found})

    kind = dict(edges.dtypes)["i"]
    return edges.select("i", "j").mapInPandas(run, f"i {kind}, j {kind}, curvature double")


def node_curvature(curved: DataFrame) -> DataFrame:
    return curved.select(F.explode(F.array("i", "j")).alias("node"), "curvature").groupBy("node").agg(F.avg("curvature").alias("curvature"), F.count("*").alias("degree"))


def bridges(pairs: DataFrame, clades: DataFrame, k_min: int = 3, k_max: int = 40, alpha: float = 0.5) -> dict | None:
    """The first k whose graph joins two clades (node, clade), its cross edges with their curvature, and both means."""
    near = ranked_neighbours(pairs).where(F.col("rank") <= k_max)
    named = [clades.select(F.col("node").alias(c), F.col("clade").alias(f"clade_{c}")) for c in "ij"]
    k = near.join(named[0], "i").join(named[1], "j").where("clade_i <> clade_j").agg(F.min("rank")).first()[0]
    if k is None:
        return None
    k = max(k, k_min)
    curved = ollivier_ricci(knn_edges(pairs, k), alpha).join(named[0], "i").join(named[1], "j").withColumn("cross", F.col("clade_i") != F.col("clade_j"))
    means = {r["cross"]: (r["n"], r["m"]) for r in curved.groupBy("cross").agg(F.count("*").alias("n"), F.avg("curvature").alias("m")).collect()}
    hubs = curved.where("cross").select(F.explode(F.array("i", "j")).alias("node")).groupBy("node").count().orderBy(F.desc("count"), "node").limit(5)
    return {"k": k, "cross": means.get(True), "within": means.get(False), "hubs": [r["node"] for r in hubs.collect()], "edges": curved}
