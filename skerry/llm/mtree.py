"""Exact top-k by inner product: M-tree pages, best-first search.

Vectors become whole numbers, floor(256 x).  With M the greatest norm, (x, sqrt(M^2 - |x|^2)) for
rows and (q, 0) for queries turn the greatest inner product into the least Euclidean distance, a
metric.  The tree has four levels below its root, each node with a routing vector, a covering radius and the
distance to its parent's routing vector:

- tops and routes: a sample of at most 4 096 rows, a root of it the tops, shapes the tree (never the result);
  every row descends to its nearest top and that top's nearest route;
- a route's rows are one shard, or several by a hash of the id where there are more than a task should hold;
- a shard's inner nodes, and their leaf pages of about ``PAGE_ROWS`` rows with their distances to the page's vector.

A query goes to the shard that can hold the nearest row, which gives a k-th score to beat, then to every other
shard that can meet it.  Each level first asks the stored distance to the parent: by the triangle inequality,
|d(q, parent) - d(parent, node)| - radius is a bound that needs no computation.  Within a shard, nodes wait in a
priority queue by their least possible distance; the search ends when the next one cannot meet the k-th row,
and in a page rows are skipped whose stored distance rules them out.

Queries are sent to shards, sorted behind their pages, and searched as they stream past: a task holds one shard
and one batch of queries.  A shard is copied once for each ``QUERY_BLOCK`` queries that visit it, so copies are
never larger than the queries themselves.

Scores are exact whole numbers, also beyond 2^53 (in Python's integers); a component or a score beyond 64 bits is an error.  Bounds
have a margin for rounding, so every row that can be among the k is scored.

Defined cases: null vectors, or vectors with null or non-finite components, take no part; shorter
vectors count as if filled up with zeros; ties go to the smaller id; rows with one id are separate
candidates, except the query's own id; equal query rows are one query, rows of one id with different vectors
are separate ones; fewer than k candidates are all returned; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.shared import bounded, stage

ROUTES = 4096
SHARD_ROWS, SHARDS = 4096, 65_536
PAGE_ROWS = 256
QUERY_BLOCK = 65_536
_RESULT = "query_id long, q binary, vec_id long, score long"
_NODES = "shard int, inner int, route binary, radius double, to_parent double, ids binary, vectors binary, from_route binary"


def whole_numbers(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    finite = F.forall(vector_column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias(vector_column))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col(vector_column).isNotNull() & finite)
    # a greater one would be cut to 64 bits before any sum is checked
    whole = lambda x: F.when(F.abs(x * scale) >= F.lit(2.0**63), F.raise_error(F.lit("a component needs more than 64 bits")).cast("long")).otherwise(F.floor(x * scale))
    return rows.select("vec_id", F.transform(vector_column, whole).alias("v"))


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of a column of lists of whole numbers, filled up with zeros."""
    got = np.zeros((len(column), dim), np.int64)
    for i, x in enumerate(column):
        got[i, : len(x)] = x
    return got


def _rows(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i8").reshape(len(column), dim)


def _lifted(v: np.ndarray, top: float) -> np.ndarray:
    v = v.astype(float)
    return np.column_stack([v, np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0))])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T
    return np.sqrt(np.maximum(d, 0))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows to one vector by differences: exact for equal ones, as a radius must be."""
    return np.sqrt(((x - y) ** 2).sum(axis=1))


def margin(top: float, length: float | np.ndarray = 0.0):
    """What rounding can add to a distance."""
    return 1e-3 + 1e-6 * np.sqrt(top + length)


def scores_of(vectors: np.ndarray, q: np.ndarray, exact: bool) -> list[int]:
    """Inner products; ``exact`` where floats hold every sum, else in Python's integers."""
    if exact:
        return (vectors.astype(float) @ q.astype(float)).astype(np.int64).tolist()
    found = [int(x) for x in vectors.astype(object) @ q.astype(object)]
    if any(abs(x) >= 2**63 for x in found):
        raise OverflowError("an inner product needs more than 64 bits")
    return found


def _nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[a : a + 4096], y).argmin(axis=1) for a in range(0, len(x), 4096)])


def nodes_of(shard: int, ids: np.ndarray, v: np.ndarray, root: np.ndarray, top: float, seed: int = 5) -> list[tuple]:
    """One shard's inner nodes (without ids) and leaf pages, in the order of ``_NODES``."""
    lifted, r, found = _lifted(v, top), np.random.default_rng(seed), []
    pages = -(-len(ids) // PAGE_ROWS)
    inner = lifted[r.permutation(len(ids))[: max(1, int(pages**0.5))]]
    own = _nearest(lifted, inner)
    for k in np.unique(own):
        members = np.flatnonzero(own == k)
        found.append((shard, int(k), inner[k].tobytes(), float(_apart(lifted[members], inner[k]).max()), float(_apart(inner[k][None], root)[0]), None, None, None))
        leaves = lifted[members[r.permutation(len(members))[: max(1, len(members) // PAGE_ROWS)]]]
        near = _nearest(lifted[members], leaves)
        for j in np.unique(near):
            page = members[near == j]
            page = page[np.argsort(ids[page], kind="stable")]
            d = _apart(lifted[page], leaves[j])
            found.append((shard, int(k), leaves[j].tobytes(), float(d.max()), float(_apart(leaves[j][None], inner[k])[0]), ids[page].astype("<i8").tobytes(), v[page].astype("<i8").tobytes(), d.tobytes()))
    return found


class Shard:
    """A shard's nodes in memory, as they come from the table."""

    def __init__(self, dim: int, top: float, exact: bool):
        self.dim, self.top, self.exact, self.inner, self.pages = dim, top, exact, {}, {}

    def add(self, inner: int, route: bytes, radius: float, to_parent: float, ids: bytes | None, vectors: bytes | None, from_route: bytes | None) -> None:
        if ids is None:
            self.inner[inner] = (np.frombuffer(route), radius, to_parent)
            return
        v = np.frombuffer(vectors, "<i8").reshape(-1, self.dim)
        self.pages.setdefault(inner, []).append((np.frombuffer(route), radius, to_parent, np.frombuffer(ids, "<i8"), v.astype(float) if self.exact else v, np.frombuffer(from_route)))

    def search(self, query_id: int, q: np.ndarray, k: int, bound: int | None, to_root: float | None = None) -> list[tuple[int, int]]:
        """The best (score, id) rows that reach ``bound``, at most ``k``, best first."""
        lift = np.append(q.astype(float), 0.0)
        length = float(lift @ lift)
        slack = margin(self.top, length)
        reach = lambda score: np.sqrt(max(length + self.top - 2 * float(score), 0.0)) * (1 + 1e-9) + slack
        limit = np.inf if bound is None else reach(bound)
        # (least distance, order, inner node, page, distance to the parent); a page is None for an inner node
        queue = [(0.0 if to_root is None else max(0.0, abs(to_root - t) - r - slack), n, n, None) for n, (_, r, t) in self.inner.items()]
        heapq.heapify(queue)
        best: list[tuple[int, int]] = []
        order = len(queue) + max(self.inner, default=0)
        while queue:
            least, _, node, page = heapq.heappop(queue)
            if least > limit:
                break
            if page is None:
                route, radius, _ = self.inner[node]
                d = float(np.sqrt(((route - lift) ** 2).sum()))
                if d - radius - slack > limit:
                    continue
                for page in self.pages[node]:
                    low = max(0.0, d - radius - slack, abs(d - page[2]) - page[1] - slack)
                    if low <= limit:
                        order += 1
                        heapq.heappush(queue, (low, order, node, page))
                continue
            route, radius, _, ids, vectors, from_route = page
            d = float(np.sqrt(((route - lift) ** 2).sum()))
            if d - radius - slack > limit:
                continue
            if radius == 0:  # equal rows: only the smallest ids can count
                keep = np.flatnonzero(ids != query_id)[:k]
            else:
                keep = np.flatnonzero((np.abs(d - from_route) <= limit + slack) & (ids != query_id))
            if not len(keep):
                continue
            if self.exact:
                found = vectors[keep] @ lift[:-1] if len(keep) < len(ids) else vectors @ lift[:-1]
                if len(best) == k:
                    good = found >= -best[-1][0]
                    keep, found = keep[good], found[good]
                if len(found) > k:  # ids ascend, so ties at the cut keep the smaller ones
                    cut = np.argsort(-found, kind="stable")[:k]
                    keep, found = keep[cut], found[cut]
                got = zip((-found).astype(np.int64).tolist(), ids[keep].tolist())
            else:
                got = zip((-s for s in scores_of(vectors[keep], q, False)), ids[keep].tolist())
            best = sorted([*best, *got])[:k]
            if len(best) == k:
                limit = min(limit, reach(-best[-1][0]))
        return [(-s, i) for s, i in best if bound is None or -s >= bound]


def _directory(sample: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tops, routes, each route's top and its distance to it."""
    routes = np.unique(_lifted(sample, top), axis=0)
    tops = routes[np.random.default_rng(3).permutation(len(routes))[: max(1, int(len(routes) ** 0.5))]]
    parent = _nearest(routes, tops)
    return tops, routes, parent, np.array([_apart(r[None], tops[p])[0] for r, p in zip(routes, parent)])


def top_k(vectors: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", query_modulus: int = 50, scale: int = 256) -> DataFrame:
    """The ``k`` best rows for each query (ids divisible by ``query_modulus``): query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, id_column, vector_column, scale)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, dim, top = rows.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    top = float(top or 0.0)
    exact = top < 2.0**52  # no inner product, and no partial sum of one, is greater than the greatest squared norm
    wanted = min(ROUTES, max(1, n // SHARD_ROWS))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()  # at most ROUTES rows
    tops, routes, parent, to_top = _directory(_matrix([r["v"] for r in sample], dim), top)
    tree = spark.sparkContext.broadcast((tops, routes, parent))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, routes, parent = tree.value
        for batch in batches:
            v = _matrix(batch.column(1).to_pylist(), dim)
            lifted, near, d = _lifted(v, top), np.zeros(len(v), np.int32), np.zeros(len(v))
            above = _distances(lifted, tops)
            above[:, np.setdiff1d(np.arange(len(tops)), parent)] = np.inf
            above = above.argmin(axis=1) if len(v) else near
            for t in np.unique(above):
                at, below = np.flatnonzero(above == t), np.flatnonzero(parent == t)
                near[at] = below[_distances(lifted[at], routes[below]).argmin(axis=1)]
            for a in range(0, len(v), 4096):
                d[a : a + 4096] = np.sqrt(((lifted[a : a + 4096] - routes[near[a : a + 4096]]) ** 2).sum(axis=1))
            yield pa.record_batch([batch.column(0), pa.array(near), pa.array(d), pa.array([x.tobytes() for x in v.astype("<i8")], pa.binary())], names=["vec_id", "route", "away", "v"])

    placed = stage(rows.mapInArrow(assign, "vec_id long, route int, away double, v binary"), "vectors")
    room = max(SHARD_ROWS, n // SHARDS)
    parts, radius = {}, np.zeros(len(routes))
    for r in placed.groupBy("route").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():  # at most ROUTES rows
        parts[r["route"]], radius[r["route"]] = -(-r["n"] // room), r["r"]
    top_radius = np.array([max((to_top[j] + radius[j] for j in np.flatnonzero(parent == t)), default=0.0) for t in range(len(tops))])
    first, at = {}, 0
    for r in sorted(parts):
        first[r], at = at, at + parts[r]
    shard_route = np.concatenate([np.full(parts[r], r, np.int64) for r in sorted(parts)])
    pick = lambda d: F.element_at(F.create_map(*(F.lit(x) for kv in d.items() for x in kv)), F.col("route"))
    sharded = placed.select((pick(first) + F.pmod(F.xxhash64("vec_id", "v"), pick(parts))).cast("int").alias("shard"), "vec_id", "v")
    directory = spark.sparkContext.broadcast((tops, top_radius, routes, parent, to_top, radius, shard_route))

    def build(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        _, _, routes, _, _, _, shard_route = directory.value
        found = nodes_of(shard, table.column("vec_id").to_numpy(), _rows(table.column("v").to_pylist(), dim), routes[shard_route[shard]], top)
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=[c.split()[0] for c in _NODES.split(", ")])

    nodes = stage(sharded.groupBy("shard").applyInArrow(build, _NODES), "nodes")
    queries = placed.where(F.col("vec_id") % query_modulus == 0).select("vec_id", "v").distinct()

    def to_shards(batches: Iterator[pa.RecordBatch], bounds: bool) -> Iterator[pa.RecordBatch]:
        """Each query with the first shard, or with all others that can meet its bound."""
        tops, top_radius, routes, parent, to_top, radius, shard_route = directory.value
        held = np.unique(shard_route)
        first_of = np.searchsorted(shard_route, np.arange(len(routes)))
        for batch in batches:
            ids, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            if not len(ids):
                continue
            q = _rows(raw, dim).astype(float)
            lift, length = np.column_stack([q, np.zeros(len(q))]), (q * q).sum(axis=1)
            slack = margin(top, length)[:, None]
            bound = batch.column(2).to_pylist() if bounds else [None] * len(ids)
            limit = np.array([np.inf if b is None else np.sqrt(max(s + top - 2 * float(b), 0.0)) for b, s in zip(bound, length)])[:, None] * (1 + 1e-9) + slack
            d_top = _distances(lift, tops)
            # what the stored distances leave over; only these routes' own distances are computed
            cheap = np.maximum(np.abs(d_top[:, parent] - to_top[None]) - radius[None], d_top[:, parent] - top_radius[None, parent]) - 2 * slack
            ok = cheap <= limit
            ok[:, np.setdiff1d(np.arange(len(routes)), held)] = False
            least = np.full(ok.shape, np.inf)
            for j in np.flatnonzero(ok.any(axis=0)):
                least[ok[:, j], j] = np.maximum(_apart(lift[ok[:, j]], routes[j]) - radius[j], 0)
            if bounds:
                begin = batch.column(3).to_numpy()
                i, s = np.nonzero((least[:, shard_route] <= limit + slack) & (np.arange(len(shard_route))[None] != begin[:, None]))
            else:
                start = least.argmin(axis=1)
                i, s = np.arange(len(ids)), first_of[start]
            yield pa.record_batch([pa.array(s.astype(np.int32)), pa.array(ids[i]), pa.array([raw[j] for j in i], pa.binary()), pa.array([bound[j] for j in i], pa.int64())], names=["shard", "query_id", "q", "bound"])

    asked_schema = "shard int, query_id long, q binary, bound long"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of shard: nodes first, then the queries that visit it."""
        _, _, routes, _, _, _, shard_route = directory.value
        key, shard, root = None, None, None
        for batch in batches:
            found = []
            for row_key, salt, query_id, q, bound, *node in zip(*(c.to_pylist() for c in batch.columns)):
                if (row_key, salt) != key:
                    key, shard, root = (row_key, salt), Shard(dim, top, exact), routes[shard_route[row_key]]
                if query_id is None:
                    shard.add(*node)
                    continue
                v = np.frombuffer(q, "<i8")
                to_root = float(np.sqrt(((np.append(v.astype(float), 0.0) - root) ** 2).sum()))
                found.extend((query_id, q, i, s) for s, i in shard.search(query_id, v, k, bound, to_root))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 4, (pa.int64(), pa.binary(), pa.int64(), pa.int64()))], names=["query_id", "q", "vec_id", "score"])

    def searched(asked: DataFrame) -> DataFrame:
        asked = stage(asked, "asked")
        salts = bounded(asked.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("salts")), SHARDS + ROUTES)
        none = lambda kind: F.lit(None).cast(kind)
        names = [c.split() for c in _NODES.split(", ")][1:]
        pages = nodes.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        pages = pages.select("shard", "salt", none("long").alias("query_id"), none("binary").alias("q"), none("long").alias("bound"), *(c for c, _ in names))
        visits = asked.join(salts, "shard").select("shard", F.pmod(F.xxhash64("query_id", "q"), "salts").cast("int").alias("salt"), "query_id", "q", "bound", *(none(t).alias(c) for c, t in names))
        ordered = pages.unionByName(visits).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("query_id").isNotNull())
        return ordered.mapInArrow(search, _RESULT)

    begun = stage(queries.mapInArrow(lambda b: to_shards(b, False), asked_schema), "begun")
    start = stage(searched(begun), "first-shards")
    kth = start.groupBy("query_id", "q").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= k).select("query_id", "q", "score")
    further = begun.select("query_id", "q", "shard").join(kth, ["query_id", "q"], "left").select("query_id", "q", F.col("score").alias("bound"), "shard")
    found = start.unionByName(searched(further.mapInArrow(lambda b: to_shards(b, True), asked_schema)))
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
