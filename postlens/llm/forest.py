"""Embedding near-dedup with a random-projection tree forest.

Every tree splits the vectors at a quantile of their projection on a random direction, again and again;
vectors near a split spill into both sides. The splits are fitted on a bounded sample on the driver, all
vectors are sent down all trees, and the vectors of a leaf are compared with each other by their exact
cosine. Equal vectors are one node, so a vector that a third of all rows repeat costs one row. A pair
that meets in several leaves counts in the first of them, which both vectors' leaf lists tell,
so link counts are sums of per-leaf counts and no pair is ever a row; per leaf a spanning forest of the
links is passed on, and components are found over those.

Hyperplanes would cut through a hot group of near vectors at every level, so dense places are taken out of
the trees. The sample shows them: a vector with more neighbours than a few leaves hold becomes, moved to
the mean of its neighbours, the centre of a ball as wide as the threshold's angle. A ball's own vectors
are compared with everything within twice that angle of its centre, beyond which by the triangle inequality none of
their links can lie; so their links are complete. The comparison runs in blocks, a task for each pair of blocks.
Its work grows with the square of a hot group, as the count of the links does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import saved
from postlens.llm.components import connected_components

#: Leaves of different trees are numbered apart by this.
STRIDE = 1 << 20
#: Rows of a leaf whose cosines are worked out at once.
BLOCK = 512
#: Rows of the sample whose neighbours are counted at once, on the driver.
PIVOTS = 256
#: Vectors with more neighbours than so many leaves hold are taken out of the trees.
DENSE_LEAVES = 2
#: Rows of a ball's block at most; balls that hold enough get LANES blocks at least, for as many tasks.
BALL_BLOCK, LANES = 16_384, 8
#: What rounding may do to a cosine when vectors are put into balls.
SLACK = 1e-9


class Tree:
    """Splits of one tree: direction, lower and upper bound of the spill zone, children; a negative child is a leaf."""

    def __init__(self, sample: np.ndarray, total: int, leaf: int, spill: float, rng: np.random.Generator):
        self.directions, self.low, self.high, self.children, self.leaves = [], [], [], [], 0
        self.per_sample = total / max(len(sample), 1)
        self.root = self._grow(sample, leaf, spill, rng)
        self.directions = np.array(self.directions).reshape(-1, sample.shape[1])

    def _grow(self, rows: np.ndarray, leaf: int, spill: float, rng: np.random.Generator) -> int:
        if len(rows) * self.per_sample <= leaf or len(rows) < 16:
            self.leaves += 1
            return -self.leaves
        direction = rng.standard_normal(rows.shape[1])
        at = rows @ direction
        low, high = np.quantile(at, [0.5 - spill / 2, 0.5 + spill / 2])
        if (at >= low).all() or (at <= high).all():  # nearly all projections equal: no split helps here
            self.leaves += 1
            return -self.leaves
        node = len(self.low)
        self.directions.append(direction)
        self.low.append(low)
        self.high.append(high)
        self.children.append(None)
        self.children[node] = (self._grow(rows[at <= high], leaf, spill, rng), self._grow(rows[at >= low], leaf, spill, rng))
        return node

    def place(self, rows: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """(row numbers, leaf number) of every leaf that takes some of the rows."""
        found, todo = [], [(self.root, np.arange(len(rows)))]
        while todo:
            node, held = todo.pop()
            if node < 0 or not len(held):
                if len(held):
                    found.append((held, -node))
                continue
            at = rows[held] @ self.directions[node]
            left, right = self.children[node]
            todo += [(left, held[at <= self.high[node]]), (right, held[at >= self.low[node]])]
        return found


class Balls:
    """Dense places of the sample: centres as unit vectors, and into how many blocks each ball's vectors are dealt."""

    def __init__(self, sample: np.ndarray, total: int, leaf: int, threshold: float):
        per_sample = total / max(len(sample), 1)
        angle = float(np.arccos(np.clip(threshold, -1.0, 1.0)))
        self.inside, self.around = np.cos(angle), np.cos(min(2 * angle, np.pi)) - SLACK
        self.centres = np.empty((0, sample.shape[1]))
        free = np.ones(len(sample), bool)
        least = max(3.0, DENSE_LEAVES * leaf / per_sample)
        rough = sample.astype(np.float32)  # only to count
        for start in range(0, len(sample) if len(sample) >= least else 0, PIVOTS):
            part = start + np.flatnonzero(free[start : start + PIVOTS])
            counts = (rough[part] @ rough.T >= threshold).sum(1)
            for at, count in sorted(zip(part.tolist(), counts.tolist(), strict=True), key=lambda x: -x[1]):
                if count < least:
                    break
                if not free[at]:
                    continue
                centre = sample[at]
                for _ in range(2):
                    mean = sample[sample @ centre >= self.inside].mean(0)
                    centre = mean / np.sqrt(mean @ mean)
                for made in (centre, sample[at]):  # the vector itself if its neighbours' mean is too far away
                    if free[at] and np.isfinite(made).all():
                        self.centres = np.vstack([self.centres, made])
                        free &= sample @ made < self.inside
        self.free = sample[free]
        self.blocks = np.ones(len(self.centres), np.int64)
        rows = np.zeros(len(self.centres))
        for start in range(0, len(sample) if len(self.centres) else 0, BLOCK):
            rows += self.place(sample[start : start + BLOCK])[1].sum(0) * per_sample
        self.blocks = np.maximum(np.ceil(rows / BALL_BLOCK), np.clip(np.ceil(rows / max(leaf, 1)), 1, LANES)).astype(np.int64)

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the first ball that holds each row, or the number of balls; which balls compare the row)."""
        k = len(self.centres)
        cosines = rows @ self.centres.T
        own = np.where((cosines >= self.inside).any(1), (cosines >= self.inside).argmax(1), k) if k else np.zeros(len(rows), np.int64)
        # A pair belongs to the smaller of its balls, so a row is not needed in later balls than its own.
        return own, (cosines >= self.around) & (np.arange(k) <= own[:, None])


def unit(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors in double precision) of the vectors that can link; all of the most common width."""
    rows, made = [], []
    for i, value in enumerate(values.to_pylist()):
        if value and None not in value:
            vector = np.asarray(value, np.float64)
            if np.isfinite(vector).all() and (size := np.sqrt((vector / (top := np.abs(vector).max() or 1.0)) ** 2 @ np.ones(len(vector)))) > 0:
                rows.append(i)
                made.append(vector / top / size)
    return np.array(rows, np.int64), made


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, bytes of the unit vector or null)."""
    for batch in batches:
        rows, made = unit(batch.column(1))
        keys: list[bytes | None] = [None] * batch.num_rows
        for i, vector in zip(rows, made, strict=True):
            keys[i] = (vector + 0.0).tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], ["_id", "_vector"])


def leaf_links(nodes: np.ndarray, weights: np.ndarray, vectors: np.ndarray, leaves: np.ndarray, leaf: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of one leaf: (for each node how many rows it links with that no earlier leaf has counted, its group's first node).

    ``leaves``: the leaf numbers of each node in ascending order, padded with -1. Works a block of
    rows at a time, so memory grows with the leaf's rows, not with their square.
    """
    n = len(nodes)
    counts, root = np.zeros(n, np.int64), np.arange(n)
    earlier = np.where(leaves < leaf, leaves, -1)
    for start in range(0, n, BLOCK):
        near = vectors[start : start + BLOCK] @ vectors[start:].T >= threshold
        a, b = np.nonzero(np.triu(near, 1))
        a, b = a + start, b + start
        for part in range(0, len(a), 20_000):
            x, y = a[part : part + 20_000], b[part : part + 20_000]
            both = (earlier[x][:, :, None] == earlier[y][:, None, :]) & (earlier[x][:, :, None] >= 0)
            first = ~both.any(axis=(1, 2))
            np.add.at(counts, x[first], weights[y[first]])
            np.add.at(counts, y[first], weights[x[first]])
            ends = np.unique(np.stack([root[x], root[y]], 1), axis=0)
            for u, v in ends[ends[:, 0] != ends[:, 1]].tolist():
                while root[u] != u:
                    u = int(root[u])
                while root[v] != v:
                    v = int(root[v])
                root[max(u, v)] = min(u, v)
            while (root != root[root]).any():
                root = root[root]
    return counts, nodes[root]


def _joined(root: np.ndarray, near: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives the rows that ``near`` links (rows ``a`` by rows ``b``) one root, the smallest; roots are kept flat."""
    while True:
        apart = near & (root[a][:, None] != root[b][None, :])
        open_ = apart.sum(1)
        if not open_.any():
            return
        if open_.sum() > 20_000:
            top = int(open_.argmax())
            ends = np.unique(np.append(root[b][apart[top]], root[a[top]]))
            root[np.isin(root, ends)] = ends[0]
            continue
        x, y = np.nonzero(apart)
        for u, v in np.unique(np.stack([root[a[x]], root[b[y]]], 1), axis=0).tolist():
            while root[u] != u:
                u = int(root[u])
            while root[v] != v:
                v = int(root[v])
            root[max(u, v)] = min(u, v)
        while (root != root[root]).any():
            root[:] = root[root]


def block_links(vectors: np.ndarray, weights: np.ndarray, own: np.ndarray, second: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between the blocks of a ball, or within one if no row is ``second``: (rows that each row links with, its group's first row).

    Only pairs count of which a row is the ball's ``own``.
    """
    n = len(vectors)
    counts, root = np.zeros(n, np.int64), np.arange(n)
    two = bool(second.any())
    left, right = (np.flatnonzero(~second), np.flatnonzero(second)) if two else (np.arange(n), np.arange(n))
    for start in range(0, len(left), BLOCK):
        a, b = left[start : start + BLOCK], right if two else right[start:]
        near = vectors[a] @ vectors[b].T >= threshold
        near &= own[a][:, None] | own[b][None, :]
        if not two:
            near = np.triu(near, 1)
        _joined(root, near, a, b)
        ones = near.astype(np.float64)  # sums of whole numbers stay exact
        counts[a] += (ones @ weights[b]).astype(np.int64)
        counts[b] += (weights[a] @ ones).astype(np.int64)
    return counts, root


def _dealing(balls, width: int):
    """Sends each node to the pairs of blocks of the balls that compare it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = balls.value
        for batch in batches:
            nodes, weights, raw = batch.column(0), batch.column(1), batch.column(2)
            if not batch.num_rows:
                continue
            own, near = held.place(np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(-1, width // 8))
            lot = (nodes.to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(34)
            made: list[tuple[int, int, int, int, bool, bool]] = []
            for at, ball in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                mine = int(lot[at] % held.blocks[ball])
                for other in range(int(held.blocks[ball])):
                    made.append((at, ball, min(mine, other), max(mine, other), bool(own[at] == ball), other < mine))
            if made:
                of, ball, one, two, inner, second = zip(*made, strict=True)
                of = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ball, pa.int32()), pa.array(one, pa.int32()), pa.array(two, pa.int32()), nodes.take(of), weights.take(of), raw.take(of), pa.array(inner), pa.array(second)],
                    ["_ball", "_one", "_two", "_node", "_rows", "_vector", "_own", "_second"],
                )

    return deal


def _matching(width: int, threshold: float):
    """Compares two blocks of a ball, or one with itself; nodes without a link give no row."""

    def match(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("_node")
        points = np.frombuffer(b"".join(held["_vector"]), np.float64).reshape(-1, width // 8)
        nodes, second, own = held["_node"].to_numpy(), held["_second"].to_numpy(bool), held["_own"].to_numpy(bool)
        if held["_one"].iloc[0] != held["_two"].iloc[0] and (second.all() or not second.any()):  # the other block is empty
            return pd.DataFrame({"_node": nodes[:0], "_root": nodes[:0], "_links": nodes[:0]})
        counts, root = block_links(points, held["_rows"].to_numpy(np.float64), own, second, threshold)
        some = (counts > 0) | (root != np.arange(len(nodes)))
        return pd.DataFrame({"_node": nodes[some], "_root": nodes[root][some], "_links": counts[some]})

    return match


def _placing(forest, balls, width: int):
    """Sends each node that no ball holds down all trees: one row per leaf it falls into, with the list of them all."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, weights, raw = batch.column(0), batch.column(1), batch.column(2)
            if not batch.num_rows:
                continue
            held = np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(-1, width // 8)
            if len(balls.value.centres):
                free = np.flatnonzero(balls.value.place(held)[0] == len(balls.value.centres))
                if not len(free):
                    continue
                held, (nodes, weights, raw) = held[free], (x.take(pa.array(free)) for x in (nodes, weights, raw))
            lists: list[list[int]] = [[] for _ in range(len(held))]
            for number, tree in enumerate(forest.value):
                for at, name in tree.place(held):
                    for i in at.tolist():
                        lists[i].append(number * STRIDE + name)
            lists = [sorted(x) for x in lists]
            of = np.repeat(np.arange(len(held)), [len(x) for x in lists])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.array(x, np.int32) for x in lists])), nodes.take(pa.array(of)), weights.take(pa.array(of)), raw.take(pa.array(of)), pa.array([lists[i] for i in of], pa.list_(pa.int32()))],
                ["_leaf", "_node", "_rows", "_vector", "_leaves"],
            )

    return place


def _comparing(width: int, threshold: float):
    """Compares the nodes of a leaf; nodes without a link give no row."""

    def compare(held: pd.DataFrame) -> pd.DataFrame:
        name = int(held["_leaf"].iloc[0])
        held = held.sort_values("_node")
        points = np.frombuffer(b"".join(held["_vector"]), np.float64).reshape(-1, width // 8)
        leaves = np.full((len(held), max(map(len, held["_leaves"]))), -1, np.int64)
        for i, x in enumerate(held["_leaves"]):
            leaves[i, : len(x)] = x
        nodes = held["_node"].to_numpy()
        counts, roots = leaf_links(nodes, held["_rows"].to_numpy(), points, leaves, name, threshold)
        some = (counts > 0) | (roots != nodes)
        return pd.DataFrame({"_node": nodes[some], "_root": roots[some], "_links": counts[some]})

    return compare


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95,
    trees: int = 10, leaf: int = 1000, spill: float = 0.06, sample: int = 65_536, seed: int = 11,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row: links are pairs of rows with cosine >= ``threshold``.

    Cosines are of the whole vectors in double precision, so no pair below the threshold is linked; a pair is
    missed only if neither is in a dense place (see above) and it meets in no leaf of any tree. Null vectors, zero vectors, empty ones and such with null
    or non-finite components link with nothing. Vectors of different lengths do not link. Rows that repeat
    an id count as rows of their own but share a node if their vectors are equal. ``component_id`` is the
    smallest id reachable, the row's own included. Null ids: the row counts in others' links and gets the
    smallest id of its component. Labels and other columns are not read. An empty table gives no rows.

    ``sample`` bounds the rows (by a hash of the id) that reach the driver, to fit the splits; all rows are indexed.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("_id"), F.col(f"`{embedding}`").alias("_v"))
    rows = given.mapInArrow(_nodes, "_id long, _vector binary")
    classes = saved(rows.where(F.col("_vector").isNotNull()).groupBy("_vector").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_rows")).withColumn("_node", F.monotonically_increasing_id()))
    widths = {r[0]: r[1] for r in classes.groupBy(F.octet_length("_vector")).count().collect()}
    totals = rows.where(F.col("_vector").isNull()).select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    for width, total in sorted(widths.items()):  # one per length of vector, normally one
        mine = classes.where(F.octet_length("_vector") == width)
        lot = F.pmod(F.xxhash64(F.lit(seed), "_vector"), F.lit(1 << 30)) / float(1 << 30)
        taken = mine.where(lot < min(1.0, sample / total)).select("_vector").toPandas()["_vector"].sort_values()
        points = np.frombuffer(b"".join(taken), np.float64).reshape(-1, width // 8)
        rng = np.random.default_rng(seed)
        dense = Balls(points, total, leaf, threshold)
        rest = total * len(dense.free) / max(len(points), 1)
        forest = spark.sparkContext.broadcast([Tree(dense.free, rest, leaf, spill, rng) for _ in range(trees)])  # bounded by the sample
        balls = spark.sparkContext.broadcast(dense)

        distinct = mine.select("_node", "_rows", "_vector")
        placed = distinct.mapInArrow(_placing(forest, balls, width), "_leaf int, _node long, _rows long, _vector binary, _leaves array<int>")
        found = placed.groupBy("_leaf").applyInPandas(_comparing(width, threshold), "_node long, _root long, _links long")
        if len(dense.centres):
            dealt = distinct.mapInArrow(_dealing(balls, width), "_ball int, _one int, _two int, _node long, _rows long, _vector binary, _own boolean, _second boolean")
            found = found.unionByName(dealt.groupBy("_ball", "_one", "_two").applyInPandas(_matching(width, threshold), "_node long, _root long, _links long"))
        found = saved(found)
        parts = connected_components(found.select(F.col("_node").alias("u"), F.col("_root").alias("v"))).withColumnRenamed("node", "_node")
        links = found.groupBy("_node").agg(F.sum("_links").alias("_links"))
        full = saved(mine.select("_node", "_least", "_rows", "_vector").join(links, "_node", "left").join(parts, "_node", "left").withColumn("component", F.coalesce("component", "_node")))
        least = saved(full.groupBy("component").agg(F.min("_least").alias("component_id")))
        named = saved(full.join(least, "component").select("_vector", (F.coalesce("_links", F.lit(0)) + F.col("_rows") - 1).alias("n_links"), "component_id"))
        totals = totals.unionByName(rows.where(F.octet_length("_vector") == width).join(named, "_vector").select("_id", "n_links", "component_id"))
    return totals.select(F.col("_id").alias(vec_id), "n_links", "component_id", (F.col("_id") == F.col("component_id")).alias("kept"))
