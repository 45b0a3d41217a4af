"""MinHash near-duplicate detection (operator 4)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.components import connected_components
from clausewright.llm.shingles import Bands, Minima, WordHasher, shingle_sets, sketch
from clausewright.llm.skew import joined, joined_salted
from clausewright.llm.staging import staged

MINIMA, BANDS, ROWS = 512, 64, 8
#: Rows taken together in Python, so that memory follows a few texts and not a whole Arrow batch.
SLICE = 256
#: Members of a bucket that are compared with each other in one task at most; larger buckets are cut into cells.
CELL = 2048


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, minima, bands = WordHasher(), Minima(MINIMA), Bands(BANDS, ROWS, MINIMA)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = shingle_sets(part.column(1).to_pylist(), size, hasher)
                full = [s for s in sets if len(s)]
                values = minima.of(full) if full else np.empty((0, MINIMA), np.uint32)
                rows = iter(zip(sketch(values).tolist(), bands.of(values).view(np.int64).tolist(), strict=True))
                out = []
                for s in sets:
                    if len(s):
                        whole = xxhash.xxh3_128_intdigest(s.tobytes())
                        out.append((len(s), (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63), *next(rows)))
                    else:
                        out.append((0, None, None, None, None))
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_shingles", "set_hi", "set_lo", "sketch", "bands"])

    return run


def _shared(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                left, right = (shingle_sets(part.column(k).to_pylist(), size, hasher) for k in (2, 3))
                both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)]
                sizes = [pa.array([len(s) for s in side], pa.int64()) for side in (left, right)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *sizes, pa.array(both, pa.int64())], ["u", "v", "n_u", "n_v", "n_both"])

    return run


def _most_differing(percent: int) -> int:
    """Nibbles in which the sketches of a pair at the threshold differ: the mean and four standard deviations."""
    p = (1 - percent / 100) * 15 / 16
    return math.ceil(MINIMA * p + 4 * math.sqrt(MINIMA * p * (1 - p)))


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    t = x ^ y
    t |= t >> np.uint64(1)
    t |= t >> np.uint64(2)
    return np.bitwise_count(t & np.uint64(0x1111111111111111)).sum(axis=-1)


def _longs(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(column), -1)


def _likely(percent: int):
    """Of pairs (u, v, n_u, n_v, sketch_u, sketch_v) those that sizes and signatures don't rule out."""
    most = _most_differing(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            fits = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (_differing(_longs(batch.column(4)), _longs(batch.column(5))) <= most)
            yield batch.select([0, 1]).filter(pa.array(fits))

    return run


class Cell:
    """Rows (key, cell, half, doc_id, part, n, sketch, bands, ...) of one cell of a bucket."""

    def __init__(self, table: pa.Table, percent: int):
        self.key, self.half, self.doc, self.part, self.n = (table.column(k).to_numpy() for k in (0, 2, 3, 4, 5))
        self.sketches, self.bands = (_longs(table.column(k).combine_chunks()) for k in (6, 7))
        self.percent, self.most = percent, _most_differing(percent)

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each row with those, the likeliest first, that lie in other parts and that sizes and signatures don't rule out. A pair that shares several
        buckets is looked at in the first of its bands alone, and pairs within the largest part aren't."""
        if len(self.doc) < 2 or (self.part == self.part[0]).all():
            return
        split = self.half.min() != self.half.max()
        names, counts = np.unique(self.part, return_counts=True)
        done = np.zeros(len(self.doc), bool)
        for i in np.flatnonzero(self.part != names[np.argmax(counts)]):
            done[i] = True
            fits = ~done & (self.part != self.part[i]) & (100 * np.minimum(self.n, self.n[i]) >= self.percent * np.maximum(self.n, self.n[i]))
            if split:
                fits &= self.half != self.half[i]
            near = np.flatnonzero(fits)
            apart = _differing(self.sketches[near], self.sketches[i])
            near = near[np.argsort(apart, kind="stable")][: int((apart <= self.most).sum())]
            shared = self.bands[near] == self.bands[i]
            near = near[self.bands[i][np.argmax(shared, axis=1)] == self.key[:1].view(np.uint64)[0]]
            if len(near):
                yield i, near


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows (key, cell, ...) in that order to a table for each cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, cell = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        if held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (int(key[0]), int(cell[0])):
            yield pa.Table.from_batches(held)
            held = []
        for begin, end in zip(bounds, bounds[1:]):  # noqa: B905
            held.append(batch.slice(begin, end - begin))
            if end < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _involved(percent: int):
    """Cells' rows without texts to those that are a candidate of another: key, cell, doc_id. As many rows as came in at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_cell(batches):
            cell, some = Cell(table, percent), np.zeros(table.num_rows, bool)
            for i, near in cell.candidates():
                some[i] = True
                some[near] = True
            if some.any():
                yield from table.select([0, 1, 3]).filter(pa.array(some)).to_batches()

    return run


def _linking(size: int, percent: int):
    """Cells' rows with texts to links (u, v) that join all parts which the candidates' full sets join, and no more links than that
    takes: pairs whose parts are joined already aren't held against each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for table in _by_cell(batches):
            cell, texts, sets, links = Cell(table, percent), table.column(8), {}, []
            up = {p: p for p in cell.part.tolist()}

            def root(p: int, up: dict[int, int] = up) -> int:
                while up[p] != p:
                    up[p] = p = up[up[p]]
                return p

            def set_of(i: int, sets: dict = sets, texts: pa.ChunkedArray = texts) -> np.ndarray:
                if i not in sets:
                    (sets[i],) = shingle_sets([texts[i].as_py()], size, hasher)
                return sets[i]

            for i, near in cell.candidates():
                for j in near.tolist():
                    a, b = root(int(cell.part[i])), root(int(cell.part[j]))
                    if a == b:
                        continue
                    x, y = set_of(int(i)), set_of(j)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both * 100 >= (len(x) + len(y) - both) * percent:
                        up[a] = b
                        links.append(sorted((int(cell.doc[i]), int(cell.doc[j]))))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose full sets are alike enough."""
    u, v = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")) for k in ("u", "v"))
    both = joined_salted(joined_salted(pairs, v, "v", "u"), u, "u", "v", pairs).select("u", "v", "text_u", "text_v")
    sized = both.mapInArrow(_shared(size), "u long, v long, n_u long, n_v long, n_both long")
    return sized.where(F.col("n_both") * 100 >= (F.col("n_u") + F.col("n_v") - F.col("n_both")) * percent).select("u", "v")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, any other columns): doc_id, n_shingles, component_id, kept.

    Documents whose sets of distinct ``shingle``-word shingles have a Jaccard similarity of at least
    ``percent`` / 100 are linked; component_id is the smallest doc_id reachable over links.

    1. Each set gets 512 universal-hash minima; 64 bands of 8 of them are its keys. A pair at 0.8 shares
       no band with a probability of about 10^-5, at 0.85 of 10^-9; its signature rules it out by four standard deviations.
    2. Documents with equal sets form a class at once; only its first document goes on.
    3. In each bucket of a band everything is paired with the bucket's first document (a star, linear in
       the bucket). Pairs that the signatures don't rule out are confirmed on the full sets.
    4. Buckets whose documents are all in one component are settled: another link could add nothing. In the
       rest, documents of different components that the signatures don't rule out are held against each other on their full sets, so
       that no candidate is left out. This is done in cells of a bounded size, however many members a bucket has; a cell gives out
       the links that join its components, never its pairs.

    Null and empty texts, and texts without words, have an empty set and are linked with nothing.
    A null doc_id is a component of its own (component_id null, kept true). Rows that repeat a doc_id
    count as one document with the links of all its rows. Other columns are ignored.
    """
    base = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_signatures(shingle), "doc_id long, n_shingles long, set_hi long, set_lo long, sketch array<long>, bands array<long>"), "signatures")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    full = base.where("n_shingles > 0 and doc_id is not null")
    first = staged(full.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "sets")
    classes = staged(joined(full.select("doc_id", "set_hi", "set_lo"), first, ["set_hi", "set_lo"], "copies").select("doc_id", "first_id"), "classes")
    unique = full.join(classes.where("doc_id = first_id").select("doc_id").distinct(), "doc_id", "left_semi")
    if full.groupBy("doc_id").count().where("count > 1").limit(1).count():  # a repeated doc_id
        unique = full.dropDuplicates(["doc_id", "set_hi", "set_lo"])

    keys = unique.select("doc_id", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    buckets = staged(keys.join(hubs, "key"), "buckets")
    u, v = (unique.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in ("u", "v"))

    star = staged(buckets.where("doc_id <> hub").select(F.col("hub").alias("u"), F.col("doc_id").alias("v")).distinct(), "star")
    starred = joined_salted(star.join(v, "v"), u, "u", "v", star).select("u", "v", "n_u", "n_v", "sketch_u", "sketch_v")
    likely = staged(starred.mapInArrow(_likely(percent), "u long, v long"), "likely")
    links = staged(_confirmed(likely, texts, shingle, percent), "links")
    parts = connected_components(links)

    placed = staged(buckets.join(parts, buckets.doc_id == parts.node, "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("part")), "placed")
    unsettled = placed.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.count("*").alias("n")).where("a <> b and n > 2")
    unsettled = unsettled.select("key", F.ceil(F.col("n") / CELL).cast("int").alias("halves"))
    rest = placed.join(unsettled, "key").withColumn("half", F.pmod(F.hash("doc_id"), "halves"))
    # a bucket of one half is one cell; of more halves, each pair of halves is a cell
    cells = F.transform(F.sequence(F.lit(0), F.col("halves") - 1), lambda x: F.least(x, "half") * F.col("halves") + F.greatest(x, "half"))
    rest = rest.select("key", F.explode(cells).alias("cell"), "half", "doc_id", "part").join(unique.select("doc_id", "n_shingles", "sketch", "bands"), "doc_id")
    rest = rest.select("key", "cell", "half", "doc_id", "part", "n_shingles", "sketch", "bands")
    rest = staged(rest, "cells")
    involved = rest.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_involved(percent), "key long, cell int, doc_id long")
    held = rest.join(involved, ["key", "cell", "doc_id"], "left_semi").join(texts, "doc_id")
    held = held.select("key", "cell", "half", "doc_id", "part", "n_shingles", "sketch", "bands", "text").repartition("key", "cell").sortWithinPartitions("key", "cell")
    more = staged(held.mapInArrow(_linking(shingle, percent), "u long, v long").distinct(), "links")
    tied = parts.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)
    tied = tied.union(classes.where("doc_id <> first_id").select("doc_id", "first_id"))
    final = connected_components(tied)
    return base.join(final, base.doc_id == final.node, "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, linked at 0.85 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)


QUERIES = {"op4_minhash_near_dedup": op4_minhash_near_dedup}

ORACLES = {
    "op4_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t
  FROM documents),
k AS (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 2, 1) + 1)) AS i FROM w WHERE len(t) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 2], ' ') AS g FROM k),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT u, v FROM b UNION SELECT r.u, b.v FROM r JOIN b ON r.v = b.u),
m AS (SELECT u, min(v) AS v FROM r GROUP BY u)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.v, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(m.v, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.u = w.doc_id
""",
}
