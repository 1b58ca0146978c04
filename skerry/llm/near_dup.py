"""MinHash near-duplicates by an LSH forest.

A document's set is its distinct 5-word shingles.  Documents with the same set are one class; its
least doc_id stands for it.  A class's signature has 72 minima.  Each of 24 trees reads the signature
in an order of its own (from another place on, round the ring) and sorts all classes by it; classes
that share a tree's first 3 values are a region.  Candidates come in three steps:

1. each class with the least class of each of its regions;
2. longest-common-prefix neighbours, in rounds: in each tree's sorted order of the regions beyond the window, each
   class with the likest of the classes just before it, if they are in another component so far;
3. what is left, at a depth that fits the region: all pairs of different components of a region of at most 64
   classes; the classes of more crowded regions, where a signature says little, go to an inverted index of their
   rare shingles (prefix filter), which holds every pair of the similarity and few others.

Steps 1 and 2 save comparisons; step 3 alone decides what is found.  A list of the index whose sets are all in one
component is dropped; a long one is dealt into blocks, a component that fills a block into blocks of its own, which
don't meet.  Candidates therefore are pairs of different components that share a rare shingle: those near the
threshold and seldom others.

Two sets with a similarity of 0.75 share no region in any tree with a probability of 2e-6.  Pairs
whose signatures differ too much for 0.75 (4.5 standard deviations) are left out; every other pair
is confirmed on its full sets, read from the texts again.  Components grow after each step, and a
pair within one component is never compared, so large groups cost about one comparison a class.

Defined cases: a null or empty text, or one of blanks, has an empty set and is its own component;
fewer than 5 words are one shingle; rows with the same doc_id are one document; a row with a null
doc_id is linked with nothing, has no component and is kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm import words
from skerry.llm.graph import contract
from skerry.llm.shared import bounded, stage

TREES, FIRST = 24, 3
VALUES = TREES * FIRST
PERCENT = 75
#: Equal signature values that a pair needs: 0.75 less 4.5 standard deviations.
LEAST_EQUAL = int(VALUES * (0.75 - 4.5 * (0.75 * 0.25 / VALUES) ** 0.5))
NEIGHBOURS = 8
#: Classes of a region that begin with so many equal values stand in one range, or in ranges side by side.
RANGED = (3 * FIRST, 8 * FIRST, VALUES)
SMALL_REGION = 64
ROUNDS = 3
#: Rows of a block; two blocks are in one task.
BLOCK_ROWS = 1024
TILE = 32
#: Shingles are counted in so many buckets to put the rare ones first; any order finds all pairs.
BUCKET_BITS = 20
#: So many buckets come to the driver as one row of a byte each.
PACKED = 1024
MAX_BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(19970501)
_A = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, VALUES, dtype=np.uint64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches):
        for first, raws in words.chunks(batch.column(1).to_pylist()):
            sets = words.shingle_sets(raws)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            digests, signs = np.zeros((2, len(raws)), np.uint64), [None] * len(raws)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                at = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                digests[0, full] = np.add.reduceat(words.mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                digests[1, full] = np.add.reduceat(words.mix(flat * _A[0] + np.uint64(1)), at)
                minima = np.empty((len(full), VALUES), np.uint32)
                for j in range(VALUES):
                    minima[:, j] = np.minimum.reduceat((flat * _A[j] + _B[j]) >> np.uint64(32), at)
                for i, row in zip(full, minima):
                    signs[i] = row.astype(">u4").tobytes()
            yield pa.record_batch(
                [batch.column(0).slice(first, len(raws)), pa.array(sizes), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)), pa.array(signs, pa.binary())],
                names=["doc_id", "n_shingles", "hi", "lo", "sig"],
            )


def _typed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: set size, a 128-bit digest of the set, and its minima (null if empty)."""
    return _typed(docs).mapInArrow(_signed, "doc_id long, n_shingles long, hi long, lo long, sig binary")


def _prefix(tree: Column, values: int) -> Column:
    """The first ``values`` values in a tree's order."""
    return F.substring(F.concat("sig", "sig"), 4 * FIRST * tree + 1, F.lit(4 * values))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and signatures allow the similarity."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        a, b, n_a, n_b = (batch.column(k).to_numpy() for k in range(4))
        sig = [np.frombuffer(b"".join(batch.column(k).to_pylist()), ">u4").reshape(n, VALUES) for k in (4, 5)]
        keep = ((sig[0] == sig[1]).sum(axis=1) >= LEAST_EQUAL) & (100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b))
        yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets have the similarity."""
    for batch in words.slices(batches):
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        keep = pa.array(keep, pa.bool_())
        yield pa.record_batch([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches):
        for first, raws in words.chunks(batch.column(1).to_pylist()):
            yield pa.record_batch([batch.column(0).slice(first, len(raws)), pa.array([s.astype("<u8").tobytes() for s in words.shingle_sets(raws)], pa.binary())], names=["doc_id", "set"])


def _like_rows(window: int, likest: bool = False):
    """Over rows (region, rep, component, signature) in order: pairs of a row and one of the ``window`` before it (or the
    ``likest`` of them) that share the region, are in different components, and whose signatures allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [*[np.empty(0, np.int64)] * 3, np.empty((0, VALUES), ">u4")]
        for batch in batches:
            held = len(last[0])
            signs = np.frombuffer(b"".join(batch.column(3).to_pylist()), ">u4").reshape(-1, VALUES)
            region, rep, part, sign = (np.concatenate([old, new]) for old, new in zip(last, (*(batch.column(k).to_numpy() for k in range(3)), signs)))
            found = []
            most, other = np.full(len(rep), LEAST_EQUAL - 1), np.full(len(rep), -1)
            for step in range(1, window + 1):
                i = np.arange(max(held, step), len(rep))
                i = i[(region[i] == region[i - step]) & (part[i] != part[i - step])]
                equal = (sign[i] == sign[i - step]).sum(axis=1)
                if likest:
                    more = equal > most[i]
                    most[i[more]], other[i[more]] = equal[more], i[more] - step
                    continue
                i = i[equal >= LEAST_EQUAL]
                found.append((np.minimum(rep[i], rep[i - step]), np.maximum(rep[i], rep[i - step])))
            i = np.flatnonzero(other >= 0)
            found.append((np.minimum(rep[i], rep[other[i]]), np.maximum(rep[i], rep[other[i]])))
            yield pa.record_batch([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], names=["a", "b"])
            last = [x[-window:] for x in (region, rep, part, sign)]

    return run


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (words.mix(shingles) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets hold a shingle of each bucket."""
    for batch in words.slices(batches):
        sets = [np.frombuffer(x, "<u8") for x in batch.column(0).to_pylist()]
        if sets:
            bucket, n = np.unique(_bucket(np.concatenate(sets)), return_counts=True)
            yield pa.record_batch([pa.array(bucket.astype(np.int32)), pa.array(n)], names=["bucket", "n"])


def _packed(table: pa.Table) -> pa.Table:
    """The buckets of a part as a byte each: eighths of doublings of the count, as only the order of counts matters."""
    levels = np.zeros(PACKED, np.uint8)  # buckets without a shingle are never asked for
    levels[table.column("bucket").to_numpy() % PACKED] = np.minimum(1 + 8 * np.log2(table.column("n").to_numpy()), 255)
    return pa.table({"part": table.column("part").slice(0, 1), "levels": pa.array([levels.tobytes()], pa.binary())})


def loads(sets: DataFrame) -> np.ndarray:
    """How full the bucket of each shingle is among the ``set`` column, in levels; the driver gets a byte a bucket."""
    counted = sets.select("set").mapInArrow(_loads, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    parts = counted.withColumn("part", F.floor(F.col("bucket") / PACKED).cast("int")).groupBy("part").applyInArrow(_packed, "part int, levels binary")
    load = np.zeros(1 << BUCKET_BITS, np.uint8)
    for r in parts.collect():
        load[r["part"] * PACKED : (r["part"] + 1) * PACKED] = np.frombuffer(r["levels"], np.uint8)
    return load


def _prefixes(load):
    """The first shingles of each set, the rare ones first, as many as a set as long as it or shorter must share one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            reps, parts, found = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
            for i, x in enumerate(batch.column(2).to_pylist()):
                x = np.frombuffer(x, "<u8")
                order = np.lexsort((x, load.value[_bucket(x)]))
                k = len(x) - -(-PERCENT * len(x) // 100) + 1
                found.append((x[order[:k]].view(np.int64), np.full(k, reps[i]), np.full(k, parts[i]), np.full(k, len(x), np.int32), np.arange(k, dtype=np.int32)))
            if found:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*found)], names=["shingle", "rep", "component", "n", "place"])

    return run


def _possible(part, n, place, i, j) -> np.ndarray:
    """Whether rows i and j of one shingle's list can be a link: different components, and sizes and places that leave room
    for enough common shingles, this one being the first; the shorter set has it among its own first shingles."""
    shorter = np.where(n[i] <= n[j], i, j)
    least = -(-PERCENT * (n[i] + n[j]) // (100 + PERCENT))
    room = np.minimum(n[i] - place[i], n[j] - place[j])
    own = n[shorter] - -(-2 * PERCENT * n[shorter] // (100 + PERCENT)) + 1
    return (part[i] != part[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])) & (room >= least) & (place[shorter] < own)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Possible pairs of short lists: rows (shingle, rep, component, n, place) in order of the shingle."""
    last = [np.empty(0, np.int64)] * 5
    for batch in batches:
        held = len(last[0])
        shingle, rep, part, n, place = (np.concatenate([old, new.to_numpy().astype(np.int64)]) for old, new in zip(last, batch.columns))
        pairs = []
        for step in range(1, SMALL_REGION):
            i = np.arange(max(held, step), len(rep))
            i = i[shingle[i] == shingle[i - step]]
            if not len(i):
                break
            i = i[_possible(part, n, place, i, i - step)]
            pairs.append(np.stack([np.minimum(rep[i], rep[i - step]), np.maximum(rep[i], rep[i - step])], axis=1))
        found = np.unique(np.concatenate([*pairs, np.empty((0, 2), np.int64)]), axis=0)
        yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])
        last = [x[-SMALL_REGION:] for x in (shingle, rep, part, n, place)]


def _met(table: pa.Table) -> pa.Table:
    """Possible pairs of like signatures between two blocks of a long list (or within one block)."""
    side = table.column("side").to_numpy()
    rep, part, n, place = (table.column(k).to_numpy().astype(np.int64) for k in ("rep", "component", "n", "place"))
    sign = np.frombuffer(b"".join(table.column("sig").to_pylist()), ">u4").reshape(-1, VALUES).astype(np.uint32)
    alone = table.column("x")[0].as_py() == table.column("y")[0].as_py()
    left = np.flatnonzero(side == 0)
    right = left if alone else np.flatnonzero(side == 1)
    found = []
    for first in range(0, len(left), TILE):
        p, q = (x.ravel() for x in np.meshgrid(left[first : first + TILE], right, indexing="ij"))
        if alone:
            p, q = p[p < q], q[p < q]
        ok = _possible(part, n, place, p, q)
        p, q = p[ok], q[ok]
        ok = (sign[p] == sign[q]).sum(axis=1) >= LEAST_EQUAL
        found.append(np.stack([np.minimum(rep[p[ok]], rep[q[ok]]), np.maximum(rep[p[ok]], rep[q[ok]])], axis=1))
    found = np.unique(np.concatenate([*found, np.empty((0, 2), np.int64)]), axis=0)
    return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})


class Forest:
    """Classes, their regions in every tree, and the components so far."""

    def __init__(self, docs: DataFrame):
        self.docs = _typed(docs)
        self.rows = stage(signatures(docs), "signatures")
        full = self.rows.where("n_shingles > 0 and doc_id is not null")
        self.classes = stage(full.groupBy("hi", "lo", "n_shingles").agg(F.min("doc_id").alias("rep"), F.any_value("sig").alias("sig")), "classes")
        trees = F.sequence(F.lit(0), F.lit(TREES - 1))
        places = self.classes.select("rep", F.explode(F.transform(trees, lambda t: F.struct(t.alias("tree"), F.xxhash64(t, _prefix(t, FIRST)).alias("region")))).alias("x")).select("rep", "x.*")
        regions = places.groupBy("region").agg(F.count("*").alias("size"), F.min("rep").alias("least")).where("size > 1")
        self.places = stage(places.join(regions, "region"), "places")
        self.component: DataFrame | None = None

    def placed(self) -> DataFrame:
        """Places of regions that hold more than one component, with the component of each."""
        if self.component is None:
            return self.places.withColumn("component", F.col("rep"))
        now = self.places.join(self.component.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("component", F.coalesce("root", "rep")).drop("root")
        mixed = now.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("region")
        return now.join(mixed, "region", "left_semi")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that have the similarity, by their full sets."""
        known = self.classes.select("rep", "n_shingles", "sig")
        left, right = (known.select(F.col("rep").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}")) for k in "ab")
        alike = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(_alike, "a long, b long")
        alike = stage(alike, "alike")
        ids = alike.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        sets = stage(self.docs.join(bounded(ids, MAX_BROADCAST_IDS), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, set binary"), "sets")
        left, right = (sets.select(F.col("doc_id").alias(k), F.col("set").alias(f"set_{k}")) for k in "ab")
        return alike.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm, "a long, b long")

    def link(self, links: DataFrame) -> bool:
        """Merge the components that confirmed pairs join; whether there were any."""
        links = stage(links, "links")
        if self.component is not None:
            for k in "ab":
                names = self.component.select(F.col("node").alias(k), F.col("root").alias("to"))
                links = links.join(names, k, "left").withColumn(k, F.coalesce("to", k)).drop("to")
        merged = contract(links)
        if merged is None or self.component is None:
            self.component = self.component if merged is None else merged
            return merged is not None
        further = merged.select(F.col("node").alias("root"), F.col("root").alias("top"))
        moved = self.component.join(further, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        added = merged.join(self.component.select("node"), "node", "left_anti")
        self.component = stage(moved.unionByName(added), "components")
        return True

    def neighbours(self) -> DataFrame:
        """Pairs of different components and like signatures that stand near each other in some tree's order, within a region beyond the window."""
        order = _prefix(F.col("tree"), VALUES)
        placed = self.placed().where(F.col("size") > NEIGHBOURS + 1).join(self.classes.select("rep", "sig"), "rep").select("tree", order.alias("order"), "region", "rep", "component")
        # ranges go by hashes of ever longer beginnings: Spark samples their keys to the driver, where whole orders would be eight times as large
        ranges = ["region", *(F.xxhash64(F.substring("order", 1, 4 * n)) for n in RANGED)]
        ordered = placed.repartitionByRange(*ranges).sortWithinPartitions("tree", "order", "rep")
        # pairs over the border of two ranges are left to the last step
        return ordered.select("region", "rep", "component", "order").mapInArrow(_like_rows(NEIGHBOURS, likest=True), "a long, b long").distinct()

    def remaining(self) -> DataFrame:
        """Links between all different components of every region."""
        rows = stage(self.placed().select("tree", "region", "size", "rep", "component"), "mixed")
        small = rows.where(F.col("size") <= SMALL_REGION).join(self.classes.select("rep", "sig"), "rep")
        # a small region is in one task as a whole, so the scan sees all of its pairs
        within = small.repartition("region").sortWithinPartitions("region", "rep").select("region", "rep", "component", "sig")
        pairs = within.mapInArrow(_like_rows(SMALL_REGION - 1), "a long, b long")
        return self.confirmed(pairs.unionByName(self.crowded(rows.where(F.col("size") > SMALL_REGION))).distinct())

    def crowded(self, large: DataFrame) -> DataFrame:
        """Possible pairs of different components among the classes of large regions, by an inverted index of rare shingles.

        Two sets of the similarity share one of their first shingles in any common order (prefix filter); in the order from
        rare to frequent these are seldom shared by others.  Lists of one component are left out.
        """
        spark = self.docs.sparkSession
        members = stage(large.select("rep", "component").distinct(), "crowded")
        held = self.docs.join(bounded(members.select(F.col("rep").alias("doc_id")), MAX_BROADCAST_IDS), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, set binary")
        sets = stage(members.join(held.where("length(set) > 0").dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "rep"), "rep"), "crowded-sets")
        rows = sets.select("rep", "component", "set").mapInArrow(_prefixes(spark.sparkContext.broadcast(loads(sets))), "shingle long, rep long, component long, n int, place int")
        rows = stage(rows, "prefixes")
        own = F.col("n") - F.ceil(2 * PERCENT * F.col("n") / (100.0 + PERCENT)) + 1
        lists = rows.groupBy("shingle").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"), F.max((F.col("place") < own).cast("int")).alias("first"))
        mixed = stage(lists.where("low <> high and first = 1").select("shingle", "size"), "lists")
        rows = rows.join(mixed, "shingle")
        short = rows.where(F.col("size") <= SMALL_REGION).repartition("shingle").sortWithinPartitions("shingle").select("shingle", "rep", "component", "n", "place")
        return short.mapInArrow(_listed, "a long, b long").unionByName(self.long_lists(rows.where(F.col("size") > SMALL_REGION).drop("size"))).distinct()

    def long_lists(self, rows: DataFrame) -> DataFrame:
        """Possible pairs of long lists, block by block; a component that fills a block has blocks of its own, which don't meet."""
        rows = stage(rows, "long-lists")
        needed = F.ceil(F.col("rows") / BLOCK_ROWS)
        shares = stage(rows.groupBy("shingle", "component").agg(F.count("*").alias("rows")), "shares").withColumn("blocks", needed)
        own = shares.where("blocks > 1").select("shingle", "component", F.col("blocks").alias("own"))
        rest = shares.where("blocks <= 1").groupBy("shingle").agg(F.sum("rows").alias("rows")).select("shingle", needed.alias("rest"))
        dealt = rows.join(bounded(own, MAX_BROADCAST_IDS), ["shingle", "component"], "left").join(bounded(rest, MAX_BROADCAST_IDS), "shingle", "left")
        of = F.when(F.col("own").isNotNull(), F.col("component"))
        block = F.concat_ws(":", of, F.pmod(F.xxhash64("rep"), F.coalesce("own", "rest")))
        dealt = stage(dealt.select("shingle", "rep", "component", "n", "place", of.alias("of"), block.alias("block")), "blocks")
        blocks = stage(dealt.select("shingle", "of", "block").distinct(), "block-names")
        x, y = (blocks.select("shingle", F.col("of").alias(f"of_{k}"), F.col("block").alias(k)) for k in "xy")
        meetings = stage(x.join(y, "shingle").where("x <= y and (of_x is null or of_y is null or of_x <> of_y)").select("shingle", "x", "y"), "meetings")
        rows = dealt.drop("of")
        first = rows.join(meetings.withColumn("block", F.col("x")), ["shingle", "block"]).withColumn("side", F.lit(0))
        second = rows.join(meetings.where("x <> y").withColumn("block", F.col("y")), ["shingle", "block"]).withColumn("side", F.lit(1))
        names = ["shingle", "x", "y", "side", "rep", "component", "n", "place"]
        seen = first.unionByName(second).join(self.classes.select("rep", "sig"), "rep").select(*names, "sig")
        return seen.groupBy("shingle", "x", "y").applyInArrow(_met, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` (first of its component)."""
    forest = Forest(docs)
    forest.link(forest.confirmed(forest.places.where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()))
    for _ in range(ROUNDS):
        if not forest.link(forest.confirmed(forest.neighbours())):
            break
    forest.link(forest.remaining())
    named = forest.classes.select("hi", "lo", "n_shingles", "rep")
    if forest.component is not None:
        named = named.join(forest.component.withColumnRenamed("node", "rep"), "rep", "left").withColumn("rep", F.coalesce("root", "rep")).drop("root")
    found = forest.rows.select("doc_id", "n_shingles", "hi", "lo").join(named, ["hi", "lo", "n_shingles"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
