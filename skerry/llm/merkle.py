"""Merkle manifest of a dataset: a proof for every row, by fractal traversal of aligned blocks.

A row is a leaf: the digest of its fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value.  Leaves
of one tree (a source) stand in order of their id; while several nodes remain, every ``ARITY`` consecutive ones become
the digest of their hex texts.  The trees' roots, in order of their names (null first), make one more tree.

Order of rows: they are written once, sorted by ranges; a row's place is its place in its file plus the rows in files
before it, so places stay the same when an executor is lost.  ``BLOCK_LEVELS`` levels of a tree make aligned blocks of
``ARITY ** BLOCK_LEVELS`` nodes.  Going up, each block is folded to its root, blocks of roots again, until each tree has
one.  Going down, a task streams through blocks that stand behind their upper proofs.  In a block every level keeps an
existing subtree, the siblings now in use, and a desired one, which grows by one leaf with every proof that is emitted
and takes the other's place when the traversal crosses its border.

Defined cases: null fields are ``-``; a null id comes first; rows that share an id stand in order of their leaf, equal
rows have proofs of their own; a null source is a tree of its own; an empty table has no rows and no root; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.quality import let
from skerry.llm.shared import bounded, new_path, stage

ARITY, BLOCK_LEVELS = 16, 3
BLOCK = ARITY**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
MAX_BROADCAST_RANGES = 1_000_000
BATCH_ROWS = 4096


def field(c: Column) -> Column:
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def node(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


class Growing:
    """The nodes of one height over successive leaves; partial runs wait on a stack, one run a level."""

    def __init__(self, height: int) -> None:
        self.runs: list[list[str]] = [[] for _ in range(height)]
        self.nodes: list[str] = []

    def add(self, digest: str) -> None:
        for run in self.runs:
            run.append(digest)
            if len(run) < ARITY:
                return
            digest = node(run)
            run.clear()
        self.nodes.append(digest)

    def closed(self) -> list[str]:
        """All nodes, after the last run of each level, which may be short."""
        for run, above in zip(self.runs, [*self.runs, self.nodes][1:], strict=True):
            if run:
                above.append(node(run))
                run.clear()
        return self.nodes


def traverse(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf of a block its siblings (those before, those after) from the lowest level to the block's root."""
    existing = []
    for level in range(levels):
        first = Growing(level)
        for digest in leaves[: ARITY ** (level + 1)]:
            first.add(digest)
        existing.append(first.closed())
    desired = [Growing(level) for level in range(levels)]
    path = [("", "")] * levels
    for i in range(len(leaves)):
        for level in range(levels):
            width = ARITY**level
            if i % width == 0:
                if i and i % (width * ARITY) == 0:
                    existing[level], desired[level] = desired[level].closed(), Growing(level)
                at = i // width % ARITY
                path[level] = "".join(existing[level][:at]), "".join(existing[level][at + 1 :])
            if (ahead := i + width * ARITY) < len(leaves):
                desired[level].add(leaves[ahead])
        yield path


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        digest = node([before, digest, after])
    return digest


def levels_of(size: Column) -> Column:
    """Levels of a block of a tree with so many nodes."""
    found = F.when(size <= 1, 0)
    for k in range(1, BLOCK_LEVELS):
        found = found.when(size <= ARITY**k, k)
    return found.otherwise(BLOCK_LEVELS)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (tree, ...) with their place ``pos`` within the tree by ``order``, and the tree's ``size``.

    ``rows`` must be a written table; rows that are equal in the order may be dealt to several ranges.
    """
    spark, keys = rows.sparkSession, ["tree", *order]
    at = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    # the place in the written table tells equal rows apart
    ranged = rows.withColumns({"_file": at[0], "_row": at[1]}).repartitionByRange(*keys, "_file", "_row").sortWithinPartitions(*keys, "_file", "_row")
    path = new_path(spark, "ranges")
    ranged.drop("_file", "_row").write.parquet(path)
    placed = spark.read.schema(rows.schema).parquet(path).withColumns({"_file": at[0], "_row": at[1]})
    key = F.struct(*order)
    ranges = placed.groupBy("tree", "_file").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"), F.min(key).alias("_low"), F.max(key).alias("_high"))
    whole = Window.partitionBy("tree")
    before = F.sum("_n").over(whole.orderBy("_low", "_high", "_file").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("tree", "_file", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size"))
    ranges = bounded(stage(ranges, "range-sums"), MAX_BROADCAST_RANGES)
    return placed.join(ranges, ["tree", "_file"]).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_file", "_row", "_shift")


def block_roots(nodes: DataFrame) -> DataFrame:
    """(tree, pos, size, digest) of the blocks' roots."""
    digests = F.transform(F.sort_array(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
    blocks = nodes.groupBy("tree", "size", F.expr(f"pos div {BLOCK}").alias("block")).agg(digests.alias("digests"))
    step = lambda a: F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / F.lit(ARITY)).cast("int") - 1), lambda i: F.sha2(F.array_join(F.slice(a, i * ARITY + 1, ARITY), ""), 256))
    rising = [F.col("digests")]
    for _ in range(BLOCK_LEVELS):
        rising.append(let(rising[-1], step))
    levels = levels_of(F.col("size"))
    root = F.coalesce(*(F.when(levels == k, F.element_at(rising[k], 1)) for k in range(BLOCK_LEVELS + 1)))
    return blocks.select("tree", F.col("block").alias("pos"), F.ceil(F.col("size") / F.lit(float(BLOCK))).cast("long").alias("size"), root.alias("digest"))


def tiers(leaves: DataFrame) -> list[DataFrame]:
    """The leaves, the roots of their blocks, the roots of blocks of those, until every tree has one node."""
    found = [leaves]
    while (found[-1].agg(F.max("size")).first()[0] or 1) > 1:
        found.append(stage(block_roots(found[-1]), "roots"))
    return found


_UPPER = "lefts array<string>, rights array<string>, subroot string, root string"


def _descend(nodes: DataFrame, uppers: DataFrame, schema: str, emit: Callable, carried: tuple[str, ...] = ()) -> DataFrame:
    """``emit`` for each node (tree, pos, size, digest, carried) with its whole path; ``uppers`` (tree, pos, upper columns) has a row for each block."""
    names = [c.split()[0] for c in _UPPER.split(", ")]
    below = nodes.select("tree", F.expr(f"pos div {BLOCK}").alias("block"), F.lit(1).alias("kind"), "pos", levels_of(F.col("size")).alias("levels"), "digest", *carried, *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _UPPER.split(", ")))
    above = uppers.select("tree", F.col("pos").alias("block"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"), F.lit(0).alias("levels"), F.lit("").alias("digest"), *(F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in carried), *names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict]]]:
        upper, rows = None, []
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                for r in batch.slice(a, 1024).to_pylist():
                    if r["kind"] == 0:
                        if rows:
                            yield upper, rows
                        upper, rows = r, []
                    else:
                        rows.append(r)
        if rows:
            yield upper, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, out = None, []
        for upper, rows in blocks(batches):
            high = list(zip(upper["lefts"], upper["rights"], strict=True))
            for r, low in zip(rows, traverse([r["digest"] for r in rows], rows[0]["levels"]), strict=True):
                out.append(emit(r, [*low, *high], upper))
            if len(out) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(out, target)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in kinds], schema=kinds)

    together = above.unionByName(below).repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "pos")
    return together.mapInArrow(typed, schema)


def _path(r: dict, path: list, upper: dict) -> dict:
    return {"tree": r["tree"], "pos": r["pos"], "lefts": [a for a, _ in path], "rights": [b for _, b in path], "subroot": upper["subroot"], "root": upper["root"]}


def paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The paths of the nodes of ``levels[0]`` to the top, from those of the trees' roots (``tops``)."""
    for nodes in reversed(levels):
        tops = stage(_descend(nodes, tops, f"tree string, pos long, {_UPPER}", _path), "paths")
    return tops


def _proved(r: dict, path: list, upper: dict) -> dict:
    original = r["digest"]
    proof = hashlib.sha256("".join(x for pair in path for x in pair).encode()).hexdigest()
    root = folded(original if r["changed"] is None else r["changed"], path)
    return {"id": r["id"], "leaf": original, "subroot": upper["subroot"], "root": upper["root"], "proof_sha256": proof, "folded_root": root, "verified": root == upper["root"]}


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_column: str = "doc_id", tree_column: str = "source", tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """Every row's id, leaf, subroot, root, proof_sha256, folded_root and verified.

    ``tampered`` gives fields another value in the rows of ``where``; those rows are proved by their changed leaf
    against the original siblings.
    """
    columns = {c: F.col(c) for c in fields}
    changed = F.lit(None).cast("string")
    if tampered:
        changed = F.when(F.lit(True) if where is None else where, leaf(list((columns | tampered).values())))
    # a null tree sorts before all others
    tree = F.coalesce(F.concat(F.lit("s"), F.col(tree_column).cast("string")), F.lit(""))
    rows = stage(docs.select(F.col(id_column).alias("id"), tree.alias("tree"), leaf(list(columns.values())).alias("digest"), changed.alias("changed")), "leaves")
    leaves = stage(numbered(rows, ["id", "digest"]), "places")
    trees = tiers(leaves)
    subroots = stage(trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "subroots")
    forest = tiers(stage(numbered(subroots, ["name"]), "places"))
    root = forest[-1].first()
    if root is None:
        root = {"digest": None}
    none = F.array().cast("array<string>")
    top = forest[-1].select("tree", "pos", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.lit(root["digest"]).cast("string").alias("root"))
    over = paths(forest[:-1], top) if len(forest) > 1 else top
    named = forest[0].select("pos", F.col("name").alias("tree"), F.col("digest").alias("subroot")).join(over.drop("tree", "subroot"), "pos")
    tops = named.select("tree", F.lit(0).cast("long").alias("pos"), "lefts", "rights", "subroot", "root")
    tops = paths(trees[1:-1], tops) if len(trees) > 2 else tops
    kind = docs.schema[id_column].dataType.simpleString()
    proved = _descend(leaves, tops, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", _proved, ("id", "changed"))
    return proved.withColumnRenamed("id", id_column)
