"""Exact top-k inner-product search by ball-tree branch and bound (operator 3)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausewright.llm.staging import staged

#: Vectors of a shard, queries that one task takes to a shard, vectors of a leaf.
SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8_192, 65_536, 128
#: Vectors from which the shards' regions are drawn up, and shards whose balls a task holds at a time.
SAMPLE_ROWS, BALL_ROWS = 20_000, 4_096
#: Queries that are searched together in a task, and of a pack, the row in which they are sent.
TOGETHER, PACK_ROWS = 1_024, 256
_EXACT = 1 << 53


class BallTree:
    """A binary tree of balls over a shard's vectors; a node's rows lie together in ``order``."""

    def __init__(self, vectors: np.ndarray):
        self.whole, self.vectors = vectors, vectors.astype(np.float64)
        self.most = float(np.abs(vectors).max()) if vectors.size else 0.0
        self.order = np.arange(len(vectors))
        self.centres, self.radii, self.spans, self.children = [], [], [], []
        if len(vectors):
            self._grow(0, len(vectors))
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    def _grow(self, begin: int, end: int) -> int:
        rows = self.vectors[self.order[begin:end]]
        centre = rows.mean(axis=0)
        away = np.sqrt(((rows - centre) ** 2).sum(axis=1))
        node = len(self.radii)
        self.centres.append(centre)
        self.radii.append(away.max())
        self.spans.append((begin, end))
        self.children.append(None)
        if end - begin > LEAF_ROWS and away.max() > 0:
            a = rows[np.argmax(away)]
            b = rows[np.argmax(((rows - a) ** 2).sum(axis=1))]
            side = np.argsort(rows @ (b - a), kind="stable")  # halves, so that the depth is bounded
            self.order[begin:end] = self.order[begin:end][side]
            middle = (begin + end) // 2
            self.children[node] = (self._grow(begin, middle), self._grow(middle, end))
        return node


def bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """What no vector of a ball exceeds: q.c + |q| r, and a little more for rounding."""
    norms = np.sqrt((queries**2).sum(axis=1))
    most = queries @ centres.T + norms[:, None] * radii[None, :]
    return most + 1e-9 * (np.abs(most) + norms[:, None] * (np.sqrt((centres**2).sum(axis=1)) + radii)[None, :]) + 1e-6


class Regions:
    """Regions of near vectors, as a binary tree of half spaces drawn up from a bounded sample; a vector goes down it."""

    def __init__(self, sample: np.ndarray, leaf_rows: float):
        self.planes: list[tuple[np.ndarray, float, int, int]] = []
        self.regions = 0
        self.root = self._grow(sample.astype(np.float64), leaf_rows)

    def _grow(self, rows: np.ndarray, leaf_rows: float) -> int:
        if len(rows) > max(1.0, leaf_rows):
            away = ((rows - rows.mean(axis=0)) ** 2).sum(axis=1)
            a = rows[np.argmax(away)]
            b = rows[np.argmax(((rows - a) ** 2).sum(axis=1))]
            side = rows @ (b - a)
            middle = np.median(side)
            left = side < middle
            if left.any() and not left.all():
                node = len(self.planes)
                self.planes.append((b - a, float(middle), 0, 0))
                children = self._grow(rows[left], leaf_rows), self._grow(rows[~left], leaf_rows)
                self.planes[node] = (b - a, float(middle), *children)
                return node
        self.regions += 1
        return -self.regions  # a region, not a plane

    def of(self, vectors: np.ndarray) -> np.ndarray:
        out = np.empty(len(vectors), np.int64)
        waiting = [(self.root, np.arange(len(vectors)))]
        while waiting:
            node, rows = waiting.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                normal, middle, left, right = self.planes[node]
                below = vectors[rows] @ normal < middle
                waiting += [(left, rows[below]), (right, rows[~below])]
        return out


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, least: np.ndarray, cut: list[int] | None = None) -> list[list[tuple[int, int]]]:
    """For each query its ``k`` best (score, id) in this shard that reach ``least`` (its kth score elsewhere); its own id excepted.

    A node can't beat its bounds(). From the root down, nodes below the current kth score are cut off; the leaves
    that are left are visited best first, all queries at once, and each visit raises the kth scores. ``cut`` gets the
    numbers of leaves (for each query) that there were and that were visited added.
    """
    best: list[list[tuple[int, int]]] = [[] for _ in queries]
    vectors = tree.whole
    if not len(vectors) or not len(queries):
        return best
    exact = tree.most * float(np.abs(queries).max()) * vectors.shape[1] < _EXACT
    wanted = queries.astype(np.float64)
    most = bounds(wanted, tree.centres, tree.radii)
    alive = np.zeros(most.shape, bool)
    alive[:, 0] = most[:, 0] >= least
    for node, pair in enumerate(tree.children):  # parents come before children
        for child in pair or ():
            alive[:, child] = alive[:, node] & (most[:, child] >= least)
    leaves = np.array([n for n, pair in enumerate(tree.children) if pair is None])
    reach = np.where(alive[:, leaves], most[:, leaves], -np.inf)
    order = np.argsort(-reach, axis=1, kind="stable")
    kth = least.astype(np.float64).copy()
    lowest = np.iinfo(np.int64).min
    scores, found = np.full((len(queries), k), lowest), np.full((len(queries), k), np.iinfo(np.int64).max)
    visited = 0
    for turn in range(len(leaves)):
        leaf = order[:, turn]
        go = np.flatnonzero((reach[np.arange(len(queries)), leaf] >= kth) & np.isfinite(reach[np.arange(len(queries)), leaf]))
        if not len(go):
            break
        visited += len(go)
        for one in np.unique(leaf[go]):
            at = go[leaf[go] == one]
            begin, end = tree.spans[leaves[one]]
            rows = tree.order[begin:end]
            if exact:
                new = np.rint(wanted[at] @ tree.vectors[rows].T).astype(np.int64)
            else:  # whole numbers of any size; scores beyond a long are its limits
                new = np.clip(queries[at].astype(object) @ vectors[rows].astype(object).T, lowest + 1, np.iinfo(np.int64).max).astype(np.int64)
            new_ids = np.broadcast_to(ids[rows], new.shape)
            out = (new_ids == query_ids[at][:, None]) | (new < least[at][:, None])
            all_scores = np.concatenate([scores[at], np.where(out, lowest, new)], axis=1)
            all_ids = np.concatenate([found[at], np.where(out, np.iinfo(np.int64).max, new_ids)], axis=1)
            top = np.lexsort((all_ids, -1 - all_scores), axis=1)[:, :k]  # -1 - x reverses the order of all longs
            scores[at], found[at] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)
            full = scores[at, k - 1] > lowest
            kth[at[full]] = np.maximum(kth[at[full]], scores[at, k - 1][full])
    if cut is not None:
        cut[0] += len(leaves) * len(queries)
        cut[1] += visited
    for q in range(len(queries)):
        best[q] = [(int(s), int(i)) for s, i in zip(scores[q], found[q], strict=True) if s > lowest]
    return best


def whole_numbers(table: DataFrame, scale: int = 64) -> DataFrame:
    """Rows (vec_id, embedding) to (vec_id, v): each component x becomes floor(scale * x). Null vectors, vectors
    with null or non-finite components and rows with a null vec_id are left out."""
    v = F.col("embedding")
    fit = v.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-9e18)), F.lit(9e18)))).alias("v"))


def _matrix(column: pa.Array, kind: type = np.int64) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), -1)


def _sharded(vectors: DataFrame) -> DataFrame:
    """Adds shard (string): vectors of one length that lie near one another, SHARD_ROWS of them on average and few more.

    Regions are drawn up from a bounded sample for each length (those with the least hashes); a region with more rows
    than a shard holds, as of many equal vectors, is dealt out to several shards by hash.
    """
    counts = {r.dim: r["count"] for r in vectors.groupBy("dim").count().collect()}  # one row for each length
    of: dict[int, Regions] = {}
    for dim, n in counts.items():
        share = min(1.0, SAMPLE_ROWS / n)
        drawn = vectors.where(F.col("dim") == dim).where(F.pmod(F.xxhash64("v", "vec_id"), F.lit(1 << 30)) < share * (1 << 30)).select("v").toArrow().column("v").combine_chunks()
        of[dim] = Regions(_matrix(drawn), SHARD_ROWS * share) if len(drawn) else Regions(np.zeros((0, dim)), 1)
    sent = vectors.sparkSession.sparkContext.broadcast(of)  # a plane for each region, of which SAMPLE_ROWS bounds the number

    @F.pandas_udf("int")
    def region(v: pd.Series, dim: pd.Series) -> pd.Series:
        out = np.zeros(len(v), np.int32)
        for d in dim.unique():
            at = np.flatnonzero(dim.to_numpy() == d)
            out[at] = sent.value[int(d)].of(np.stack(v.to_numpy()[at]).astype(np.float64))
        return pd.Series(out)

    placed = staged(vectors.withColumn("region", region("v", "dim")), "regions")
    sizes = placed.groupBy("dim", "region").count().select("dim", "region", F.ceil(F.col("count") / SHARD_ROWS).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))
    return placed.join(F.broadcast(sizes), ["dim", "region"]).select("vec_id", "v", "dim", F.concat_ws("-", "dim", "region", part).alias("shard"))


def _met(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[tuple[str, list[pa.RecordBatch], pa.RecordBatch]]:
    """Rows (cell, kind, ...) in order to each cell's rows of kind 0, which are held, with those of kind 1, ``together`` at a time."""
    now, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, kind = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
        cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for begin, end in zip(edges, edges[1:]):  # noqa: B905
            if cell[begin] != now:
                now, parts = cell[begin], []
            if kind[begin] == 0:
                parts.append(batch.slice(begin, end - begin))
            elif parts:
                for at in range(begin, end, together):
                    yield now, parts, batch.slice(at, min(together, end - at))


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, v) to their sums and number, for each batch and shard."""
    for batch in batches:
        shard = batch.column(0).to_numpy(zero_copy_only=False)
        names, first, which = np.unique(shard, return_index=True, return_inverse=True)
        rows = [_matrix(batch.column(1).filter(pa.array(which == k))).astype(np.float64) for k in range(len(first))]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([r.sum(axis=0) for r in rows], pa.list_(pa.float64())), pa.array([len(r) for r in rows], pa.int64())], ["shard", "total", "n"])


def _packed(asked: DataFrame, name: str) -> DataFrame:
    """Queries (query_id, home, dim, least, q) to packs of PACK_ROWS at most, of one length and with homes that follow one another: pack, dim,
    ids, homes, least, q (one vector after the other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column(2).to_numpy()
            begins = np.flatnonzero(np.diff(dims, prepend=-1))
            edges = np.array([e for a, b in zip(begins, [*begins[1:], len(dims)], strict=True) for e in range(a, b, PACK_ROWS)] + [len(dims)])
            packs, n = np.arange(n, n + len(edges) - 1), n + len(edges) - 1
            rows, places = pa.array(edges, pa.int32()), pa.array(np.concatenate([[0], np.cumsum(dims)])[edges], pa.int32())
            lists = [pa.ListArray.from_arrays(rows, batch.column(k)) for k in (0, 1, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(packs), pa.array(dims[edges[:-1]]), *lists, pa.ListArray.from_arrays(places, batch.column(4).flatten())], ["pack", "dim", "ids", "homes", "least", "q"])

    rows = asked.select("query_id", "home", "dim", "least", "q").repartitionByRange("dim", "home", "query_id").sortWithinPartitions("dim", "home", "query_id")
    return staged(rows.mapInArrow(run, "pack long, dim int, ids array<long>, homes array<string>, least array<long>, q array<long>"), name)


def _bits(pack: int, names: np.ndarray, reach: np.ndarray) -> pa.RecordBatch:
    """Rows (pack, shard, bits) for the shards (columns of ``reach``) that some of the pack's queries (its rows) go to; a bit for each query."""
    some = np.flatnonzero(reach.any(axis=0))
    packed = np.packbits(reach[:, some], axis=0).T
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), pack, np.int64)), pa.array(names[some], pa.string()), pa.array([row.tobytes() for row in packed], pa.binary())], ["pack", "shard", "bits"])


def _at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pack, homes) to the pack's queries for each of their homes."""
    for batch in batches:
        for pack, homes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            names, which = np.unique(np.array(homes, object), return_inverse=True)
            yield _bits(pack, names, which[:, None] == np.arange(len(names))[None, :])


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``vectors`` and ``queries`` (vec_id: long, v: array of long) to query_id, rank, vec_id, score.

    Every query gets its k highest scores over all vectors but those of its own vec_id (all, if fewer), ties to
    the smaller vec_id.

    1. Vectors that lie near one another make a shard of bounded size. A shard's ball (mean and radius) is found by aggregation.
    2. Each query is searched in the shard with the highest bound for it, its home; the kth scores found there are shared.
    3. Shards whose ball can't reach a query's kth score are ruled out before any vector is moved; the rest are searched. (Of vectors
       spread at random in many dimensions none can be ruled out, and each query goes to each shard.)
    Queries move in packs of PACK_ROWS at most, those of one home together: a pack and a shard make one row at most, with a bit for each query
    that can't be ruled out, and never a row for each query. In 2 and 3 a shard's vectors and its packs meet in one task, which builds the ball
    tree once and lets the queries, BLOCK_ROWS of them at most, pass through it a few at a time; only a shard with more is sent to several tasks.

    Only vectors of a query's own length count for it. Rows that repeat a vec_id all are candidates; as queries the
    first of them in the order of vectors is taken. No vectors or no queries: no rows.
    """
    vectors = staged(_sharded(vectors.select("vec_id", "v", F.size("v").alias("dim")).where("dim > 0")), "vectors")
    first = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = staged(first.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("dim")).where("dim > 0"), "queries")

    centre = vectors.select("shard", "v").mapInArrow(_balls, "shard string, total array<double>, n long")
    place = centre.select("shard", "n", F.posexplode("total").alias("at", "x")).groupBy("shard", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    centres = place.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", (F.col("x") / F.col("n")).alias("x")))), lambda p: p["x"]).alias("centre"))
    # a row for each shard: SHARD_ROWS times fewer than vectors
    distance = F.sqrt(F.aggregate(F.zip_with("v", "centre", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, x: a + x))
    balls = vectors.join(centres, "shard").groupBy("shard", "dim").agg(F.first("centre").alias("centre"), F.max(distance).alias("radius"))
    balls = staged(balls, "balls")
    groups, blocks = (math.ceil(t.count() / size) for t, size in ((balls, BALL_ROWS), (queries, BLOCK_ROWS)))
    lowest = F.lit(-(1 << 63))

    def of_all(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))

    def held_balls(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names = np.concatenate([p.column(2).to_numpy(zero_copy_only=False) for p in parts])
        order = np.argsort(names)
        centres, radii = np.concatenate([_matrix(p.column(3), float) for p in parts]), np.concatenate([p.column(4).to_numpy() for p in parts])
        return names[order], centres[order], radii[order]

    def met_balls(asked: DataFrame, by: str, *columns: str) -> DataFrame:
        """Groups of balls and blocks of rows of ``asked`` (dim, q, ``columns``; dealt out by ``by``) in cells: as many rows as there are, times groups."""
        cell = F.concat_ws("/", "dim", "group", "block").alias("cell")
        here = balls.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(max(1, groups)))).withColumn("block", of_all(blocks))
        there = asked.withColumn("block", F.pmod(F.xxhash64(by), F.lit(max(1, blocks)))).withColumn("group", of_all(groups))
        there = there.select(cell, F.lit(1).alias("kind"), F.lit("").alias("shard"), F.col("q").cast("array<double>").alias("v"), F.lit(0.0).alias("radius"), *columns)
        none = [F.lit(None).cast(there.schema[c].dataType).alias(c) for c in columns]
        here = here.select(cell, F.lit(0).alias("kind"), "shard", F.col("centre").alias("v"), "radius", *none)
        return here.union(there).repartition("cell").sortWithinPartitions("cell", "kind")

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's shard of highest bound among a group of balls."""
        now = None
        for cell, parts, rows in _met(batches, TOGETHER):
            if cell != now:
                now, (names, centres, radii) = cell, held_balls(parts)
            most = bounds(_matrix(rows.column(3), float), centres, radii)
            shard = most.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([rows.column(5), pa.array(names[shard], pa.string()), pa.array(most[np.arange(len(most)), shard])], ["query_id", "shard", "bound"])

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shards of a group of balls that can hold a score of some of a pack's queries, but for their homes."""
        now = None
        for cell, parts, rows in _met(batches, 1):
            if cell != now:
                now, (names, centres, radii) = cell, held_balls(parts)
            pack, homes, least = (rows.column(k)[0].as_py() for k in (5, 6, 7))
            reach = bounds(rows.column(3).flatten().to_numpy().reshape(len(homes), -1), centres, radii) >= np.array(least)[:, None]
            homes = np.array(homes, object)
            at = np.minimum(np.searchsorted(names, homes), len(names) - 1)
            own = names[at] == homes
            reach[np.flatnonzero(own), at[own]] = False
            yield _bits(pack, names, reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (cell, kind, id, v, ids, least, bits): in each cell first the vectors, then the packs. A row without a query tells leaves."""
        now = None
        for cell, parts, rows in _met(batches, max(1, TOGETHER // PACK_ROWS)):
            if cell != now:
                now, tree, ids = cell, BallTree(np.concatenate([_matrix(p.column(3)) for p in parts])), np.concatenate([p.column(2).to_numpy() for p in parts])
            asked = []
            for r in range(rows.num_rows):
                v, names, least = (rows.column(k)[r].values.to_numpy(zero_copy_only=False) for k in (3, 4, 5))
                go = np.unpackbits(np.frombuffer(rows.column(6)[r].as_py(), np.uint8), count=len(names)).astype(bool)
                asked.append((names[go], v.reshape(len(names), -1)[go], least[go]))
            query_ids, wanted, least = (np.concatenate(x) for x in zip(*asked, strict=True))
            cut = [0, 0]
            hits = search(tree, ids, wanted, query_ids, k, least, cut)
            found = [(int(q), i, s) for q, own in zip(query_ids, hits, strict=True) for s, i in own] + [(None, *cut)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    def searched(pairs: DataFrame, packs: DataFrame) -> DataFrame:
        """``pairs`` (pack, shard, bits) to the hits in those shards."""
        many = pairs.groupBy("shard").agg(F.ceil(F.count("*") * PACK_ROWS / BLOCK_ROWS).cast("int").alias("blocks"))
        cell = F.concat_ws("/", "shard", "block").alias("cell")
        here = vectors.join(many, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        none = [F.lit(None).cast(kind).alias(name) for name, kind in (("ids", "array<long>"), ("least", "array<long>"), ("bits", "binary"))]
        here = here.select(cell, F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "v", *none)
        there = pairs.join(many, "shard").withColumn("block", F.pmod(F.xxhash64("pack"), F.col("blocks"))).join(packs, "pack")
        there = there.select(cell, F.lit(1).alias("kind"), F.col("pack").alias("id"), F.col("q").alias("v"), "ids", "least", "bits")
        return here.union(there).repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(run, "query_id long, vec_id long, score long")

    best = met_balls(queries, "query_id", "query_id").mapInArrow(highest, "query_id long, shard string, bound double")
    home = staged(best.groupBy("query_id").agg(F.max_by("shard", F.struct("bound", "shard")).alias("home")), "home")
    asked = queries.join(home, "query_id")
    packs = _packed(asked.withColumn("least", lowest), "packs")
    begun = staged(searched(packs.select("pack", "homes").mapInArrow(_at_home, "pack long, shard string, bits binary"), packs), "begun")
    kth = begun.where("query_id is not null").groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k).select("query_id", "kth")
    packs = _packed(asked.join(kth, "query_id", "left").withColumn("least", F.coalesce("kth", lowest)), "known")
    pairs = staged(met_balls(packs, "pack", "pack", "homes", "least").mapInArrow(reached, "pack long, shard string, bits binary"), "pairs")
    ended = searched(pairs, packs)
    ranked = begun.union(ended).where("query_id is not null").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_numbers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_inner_products(vectors, vectors.where("vec_id % 20 = 0"), k=20)


QUERIES = {"op3_exact_top_k": op3_exact_top_k}
ORACLES = {
    "op3_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 20
""",
}
