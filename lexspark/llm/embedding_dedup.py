"""Embedding near-dedup with a forest of random-projection trees.

Equal vectors of a label are one class.  Every tree splits recursively along random directions at medians that a sample
gives; vectors near a split go to both sides (spill overlap), so a similar pair is parted by a split only if it lies
across the whole margin; what one tree parts another one joins.  Depth follows the number of classes, and the sample
follows the depth: SAMPLE_A_LEAF vectors a leaf, MOST_SAMPLE and SAMPLE_BYTES in all (which serves LEAF * MOST_SAMPLE /
SAMPLE_A_LEAF classes of a label; with more, leaves grow).  A tight group is as narrow as the margin along any direction, so that
splits would copy it to both sides: of several directions and places the one that leaves the fewest pairs is taken, and
where all copy more than MOST_SPILL of a node, it stays a leaf.  Inside a leaf all pairs of one label are compared exactly, in double
precision, but for those that all met in one earlier leaf; a large leaf is dealt out as pairs of blocks, none is cut off.

A pair counts in the first leaf that it shares, which each vector's list of leaves tells, so links are counted where they
are found and no pair leaves a task: a leaf returns for each of its classes the number of links and the smallest
class that links reach inside the leaf.  The union of these joins the components.

Trees are fitted on a sample, every class is put into all trees.  Recall is measured against brute force in the tests.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without a label, link
with nothing; vectors of different lengths never link; embeddings and labels keep their types; rows repeated with one vec_id
are vectors of their own in n_links and share their component; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.columns import pick
from lexspark.llm.components import components
from lexspark.llm.storage import Scratch
from lexspark.llm.words import list_array

COSINE = 0.93
TREES, LEAF, BLOCK = 4, 512, 2_048
#: Sampled vectors for each leaf of a tree, and at most; a tree's nodes are numbered below 2**NODE_BITS.
SAMPLE_A_LEAF, MOST_SAMPLE, NODE_BITS = 16, 1 << 17, 20
#: Bytes of the sample's vectors in double precision, at most, on the driver.
SAMPLE_BYTES = 256 << 20
#: Directions and places (shares of a node below) that are tried for a split, the share of a node that it may copy, and the
#: share of pairs that it may leave; levels beyond those of an even tree.
TRIES, PLACES, MOST_SPILL, MOST_PAIRS, EXTRA = 4, np.array([0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8, 0.1, 0.9]), 0.3, 0.9, 6
#: Half the overlap, in standard deviations of a bounding pair's difference along a random direction.
MARGIN = 0.6


@dataclass
class Tree:
    """Complete to its depth; node i has children 2i + 1 and 2i + 2."""

    depth: int
    seed: int
    cuts: dict[int, tuple[float, int]]  # where, and along which of the directions that were tried

    def direction(self, node: int, size: int, attempt: int = 0) -> np.ndarray:
        v = np.random.default_rng([self.seed, node, size, attempt] if attempt else [self.seed, node, size]).normal(size=size)
        return v / np.linalg.norm(v)

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every row in every leaf that it belongs to."""
        size = vectors.shape[1]
        margin = half_overlap(size)
        todo, rows_out, leaf_out = [(0, 0, np.arange(len(vectors)))], [], []
        while todo:
            node, level, rows = todo.pop()
            if not len(rows):
                continue
            if level == self.depth or node not in self.cuts:
                rows_out.append(rows)
                leaf_out.append(np.full(len(rows), node, np.int64))
                continue
            cut, attempt = self.cuts[node]
            off = vectors[rows] @ self.direction(node, size, attempt) - cut
            todo.append((2 * node + 1, level + 1, rows[off <= margin]))
            todo.append((2 * node + 2, level + 1, rows[off >= -margin]))
        if not rows_out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows_out), np.concatenate(leaf_out)


def half_overlap(size: int) -> float:
    return MARGIN * math.sqrt((2 - 2 * COSINE) / max(1, size))


def grow(sample: np.ndarray, depth: int, seed: int) -> Tree:
    """Cuts of the sample until a leaf has about SAMPLE_A_LEAF vectors of it, or parts no more than it copies.

    Of the directions and places that are tried the one that leaves the fewest pairs counts: the median as a rule, a place beside a tight group
    where that fills much of a node.  Such cuts are uneven, so a tree may go EXTRA levels deeper than an even one.
    """
    most = min(NODE_BITS - 2, depth + EXTRA) if depth else 0
    tree, todo, margin = Tree(most, seed, {}), [(0, 0, np.arange(len(sample)))], half_overlap(sample.shape[1])
    while todo:
        node, level, rows = todo.pop()
        if level == most or len(rows) <= 1.25 * SAMPLE_A_LEAF:
            continue
        best = None
        for attempt in range(TRIES):
            along = np.sort(sample[rows] @ tree.direction(node, sample.shape[1], attempt))
            cuts = along[(len(rows) * PLACES).astype(int)]
            low, high = np.searchsorted(along, cuts + margin, "right") / len(rows), 1 - np.searchsorted(along, cuts - margin) / len(rows)
            pairs = np.where(low + high - 1 <= MOST_SPILL, low**2 + high**2, np.inf)
            k = int(pairs.argmin())
            if best is None or pairs[k] < best[0]:
                best = float(pairs[k]), float(cuts[k]), attempt
        pairs, cut, attempt = best
        if pairs > MOST_PAIRS:
            continue
        tree.cuts[node] = cut, attempt
        left = sample[rows] @ tree.direction(node, sample.shape[1], attempt) <= cut
        todo += [(2 * node + 1, level + 1, rows[left]), (2 * node + 2, level + 1, rows[~left])]
    return tree


def _unit(column: pa.Array) -> np.ndarray:
    """Vectors of one length, scaled to length 1 in double precision."""
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    v /= np.abs(v).max(1, keepdims=True)  # squares of very large or small components stay finite
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def forest(classes: DataFrame) -> list[Tree]:
    """Trees for (id, label, size, embedding); one forest serves all labels and takes the commonest length."""
    found = classes.groupBy("label", "size").agg(F.count("*").alias("n")).groupBy("size").agg(F.max("n").alias("most"), F.sum("n").alias("n")).orderBy(F.desc("n"), "size").collect()
    depth = max(0, math.ceil(math.log2(max(1, max((r["most"] for r in found), default=0)) / LEAF)))
    if not depth:
        return [Tree(0, 0, {})]
    n = max(SAMPLE_A_LEAF, min(MOST_SAMPLE, SAMPLE_A_LEAF << depth, SAMPLE_BYTES // (8 * max(1, found[0]["size"]))))
    sample = classes.filter(F.col("size") == found[0]["size"]).select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(n)
    vectors = _unit(sample.toArrow().column("embedding").combine_chunks())
    return [grow(vectors, depth, seed) for seed in range(TREES)]


def place_in_leaves(classes: DataFrame, trees: list[Tree]) -> DataFrame:
    """(place, before, id, label, size, copies, embedding): each class in each of its leaves.

    place: a number of tree and leaf, in order of trees; before: the places of the class that come earlier.
    """

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                vectors = _unit(own.column(4))
                found = [(rows, leaf + (t << NODE_BITS)) for t, (rows, leaf) in enumerate(tree.leaves(vectors) for tree in trees)]
                rows, place = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
                order = np.lexsort((place, rows))
                rows, place = rows[order], place[order].astype(np.int32)
                first = np.searchsorted(rows, rows)
                earlier = np.arange(len(rows)) - first
                at = np.arange(earlier.sum()) + np.repeat(first - (np.cumsum(earlier) - earlier), earlier)
                columns = [pa.array(place), list_array(place[at], earlier), *own.take(pa.array(rows)).columns]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "before", "id", "label", "size", "copies", "embedding"])

    types = {f.name: f.dataType.simpleString() for f in classes.schema}
    schema = f"place int, before array<int>, id bigint, label {types['label']}, size int, copies bigint, embedding {types['embedding']}"
    return classes.select("id", "label", "size", "copies", "embedding").mapInArrow(assign, schema)


def _met_before(left: pa.ListArray, right: pa.ListArray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j of two lists of places share one."""
    wide = []
    for places, rows, nothing in ((left, i, -1), (right, j, -2)):
        counts = np.diff(places.offsets.to_numpy())
        table = np.full((len(places), max(1, counts.max(initial=0))), nothing, np.int32)
        table[np.arange(table.shape[1]) < counts[:, None]] = places.flatten().to_numpy()
        wide.append((table, rows))
    out = np.zeros(len(i), bool)
    for begin in range(0, len(i), 1 << 14):
        part = slice(begin, begin + (1 << 14))
        (a, x), (b, y) = wide
        out[part] = (a[x[part]][:, :, None] == b[y[part]][:, None, :]).any((1, 2))
    return out


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the sets of i and j; every row's root is the smallest row of its set."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root[:] = root[root]


def _met_together(before: pa.ListArray) -> np.ndarray:
    """Rows that have the commonest earlier place in common: pairs of them are done."""
    places, counts = before.flatten().to_numpy(), np.diff(before.offsets.to_numpy())
    together = np.zeros(len(before), bool)
    if len(places):
        found, times = np.unique(places, return_counts=True)
        together[np.repeat(np.arange(len(before)), counts)[places == found[times.argmax()]]] = True
    return together


def leaf_links(placed: DataFrame) -> DataFrame:
    """(id, linked, root): of each class that has links in a leaf, the number of vectors that it is linked with there and in no
    earlier leaf, and the smallest class that links reach inside the leaf."""
    key = ["place", "label", "size"]
    counts = placed.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    spread = placed.join(counts, key).withColumn("own", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    keyed = spread.select(*key, F.least("own", "other").alias("g"), F.greatest("own", "other").alias("h"), "own", "id", "copies", "before", "embedding")

    def compare(table: pa.Table) -> pa.Table:
        (batch,) = table.sort_by("id").combine_chunks().to_batches()
        own, ids, copies = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("own", "id", "copies"))
        g, h = (batch.column(batch.schema.get_field_index(c))[0].as_py() for c in ("g", "h"))
        before, unit = batch.column(batch.schema.get_field_index("before")), _unit(batch.column(batch.schema.get_field_index("embedding")))
        left, right = np.flatnonzero(own == g), np.flatnonzero(own == h)
        linked, root, touched = np.zeros(len(ids), np.int64), np.arange(len(ids)), np.zeros(len(ids), bool)
        done = _met_together(before)
        parts = [(rows[k : k + 256], to) for rows, to in ((left[done[left]], right[~done[right]]), (left[~done[left]], right)) if len(to) for k in range(0, len(rows), 256)]
        for rows, to in parts:
            i, j = np.nonzero(unit[rows] @ unit[to].T >= COSINE)
            i, j = rows[i], to[j]
            if g == h:
                i, j = i[i < j], j[i < j]
            touched[i] = touched[j] = True
            _join(root, i, j)
            new = ~_met_before(before, before, i, j)
            np.add.at(linked, i[new], copies[j[new]])
            np.add.at(linked, j[new], copies[i[new]])
        return pa.table({"id": ids[touched], "linked": linked[touched], "root": ids[root[touched]]})

    return keyed.groupBy(*key, "g", "h").applyInArrow(compare, "id bigint, linked bigint, root bigint")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    scratch = Scratch(vectors.sparkSession, "embedding-dedup")
    rows = pick(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", "label")
    if rows.schema["embedding"].dataType.simpleString() not in ("array<float>", "array<double>"):
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine, F.lit(False))
    keyed = rows.withColumn("usable", usable)
    good = keyed.filter("usable")
    # A class has a number of its own; vec_ids only name components.
    grouped = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = scratch.save(grouped.withColumn("size", F.size("embedding")).withColumn("id", F.monotonically_increasing_id()), "classes")
    found = scratch.save(leaf_links(place_in_leaves(classes, forest(classes))), "links")
    weight = found.groupBy(F.col("id").alias("x")).agg(F.sum("linked").alias("linked"))
    component = components(found.select(F.col("root").alias("a"), F.col("id").alias("b")), scratch).withColumnRenamed("id", "y")
    named = classes.join(weight, F.col("id") == F.col("x"), "left").join(component, F.col("id") == F.col("y"), "left")
    named = scratch.save(named.select("label", "embedding", "first", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("c")), "named")
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    of_class = named.join(least, "c").select("label", "embedding", "n_links", "component_id")
    linked = good.select("vec_id", "label", "embedding").join(of_class, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = keyed.filter(~F.col("usable")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
