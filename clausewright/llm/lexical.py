"""Ranked lexical search over document shards (operator 11)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausewright.llm.shingles import WordHasher, chunks
from clausewright.llm.staging import staged

#: Documents returned for each item.
TOP = 20
#: Bytes of text and documents of one shard; a longer text is a shard of its own. Shards of one file, and so held by a reader at a time.
SHARD_BYTES, SHARD_DOCS, SHARDS_OF_FILE = 2 << 20, 1 << 14, 16
#: Rows taken together in Python, so that memory follows a few texts and not a whole Arrow batch.
SLICE = 256
#: Items that are searched for together, and bytes of their texts.
BLOCK_ITEMS, BLOCK_BYTES = 4096, 16 << 20
#: What isn't part of a term: ASCII but letters and digits. Letters beyond ASCII are part of one.
_BLANK = np.ones(256, bool)
_BLANK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms_of(texts: list[str | None], hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """The terms of all texts in order, as 64-bit hashes, and how many each text has."""
    hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, raw in chunks(texts):
        found, firsts, _, _ = hasher(raw)
        hashes.append(found[: firsts[-1]])
        sizes.append(np.diff(firsts))
    return np.concatenate(hashes), np.concatenate(sizes)


def impacts_of(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a posting weighs before the term's weight: a saturating function of its occurrences, less in long documents. ``n`` is
    the length of each posting's document."""
    lengths, of = np.unique(n, return_inverse=True)
    m = np.array([75 + 25 * int(x) * documents // terms for x in lengths], np.int64)  # as whole numbers of any size
    return (1_000_000_000 * tf // (1000 * tf + 12 * m[of])).astype(np.int32)


@dataclass
class Shard:
    """Postings of some documents: those of terms[k] (ascending) are docs and impacts from ends[k - 1] to ends[k]; docs are places in ids."""

    ids: np.ma.MaskedArray | np.ndarray
    terms: np.ndarray
    ends: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray

    @classmethod
    def of(cls, ids: list[int | None], hashes: np.ndarray, sizes: np.ndarray, documents: int, terms: int) -> Shard:
        place = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        order = np.argsort(hashes, kind="stable")  # a term's documents stay in order
        hashes, place = hashes[order], place[order]
        new_term = np.diff(hashes, prepend=~hashes[:1]) != 0
        new = np.flatnonzero(new_term | (np.diff(place, prepend=-1) != 0))
        tf = np.diff(new, append=len(hashes)).astype(np.int64)
        docs = place[new]
        begins = np.flatnonzero(new_term[new])
        return cls(ids, hashes[new][begins], np.append(begins[1:], len(new)).astype(np.int32) if len(new) else begins.astype(np.int32), docs, impacts_of(tf, sizes[docs], documents, terms))

    def places(self, wanted: np.ndarray) -> list[tuple[int, int]]:
        """Where the postings of ``wanted`` terms begin and end."""
        at = np.searchsorted(self.terms, wanted)
        there = at < len(self.terms)
        there[there] = self.terms[at[there]] == wanted[there]
        at = np.where(there, at, 0)
        begins = np.where(there & (at > 0), self.ends[at - 1] if len(self.ends) else 0, 0)
        return list(zip(begins.tolist(), np.where(there, self.ends[at] if len(self.ends) else 0, 0).tolist(), strict=True))


SHARD = "ids array<long>, terms array<long>, ends array<int>, docs array<int>, impacts array<int>"


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, documents, terms = WordHasher(_BLANK), 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            _, sizes = terms_of(batch.column(0).slice(at, SLICE).to_pylist(), hasher)
            documents, terms = documents + int((sizes > 0).sum()), terms + int(sizes.sum())
    yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([terms], pa.int64())], ["documents", "terms"])


def _shards(documents: int, terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(_BLANK)

        def made(ids: list, texts: list) -> pa.RecordBatch:
            s = Shard.of(ids, *terms_of(texts, hasher), documents, max(1, terms))
            columns = (ids, s.terms.view(np.int64), s.ends, s.docs, s.impacts)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.int64() if k < 2 else pa.int32())) for k, x in enumerate(columns)], ["ids", "terms", "ends", "docs", "impacts"])

        ids, texts, size = [], [], 0
        for part in (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE)):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if ids and (len(ids) >= SHARD_DOCS or size + len(text or "") > SHARD_BYTES):
                    yield made(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc)
                texts.append(text)
                size += len(text or "")
        if ids:
            yield made(ids, texts)

    return run


@dataclass
class Index:
    """A written index: a row for each shard of documents; ``documents`` with a term, and all their ``terms`` with repeats."""

    shards: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame) -> Index:
    """Indexes every row of ``docs`` (doc_id, text, any other columns), in two passes over the texts and without a shuffle: one counts, the
    other writes the postings of each shard with their impacts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.select("text").mapInArrow(_totals, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, terms = (x or 0 for x in total)
    return Index(staged(rows.mapInArrow(_shards(documents, terms), SHARD), "shards", rows_of_file=SHARDS_OF_FILE), documents, terms)


def _frequencies(wanted: np.ndarray):
    """In how many documents of each shard the ``wanted`` terms stand: at and df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(None, *(_values(batch.column(c), k) for c in range(2)), None, None)
                total += np.array([e - b for b, e in shard.places(wanted)], np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "df"])

    return run


def _values(column: pa.Array, k: int) -> np.ndarray:
    found = column[k].values.to_numpy(zero_copy_only=False)
    return found.view(np.uint64) if found.dtype == np.int64 else found


def best(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores in order, ties by ascending id: all that tie with the last one are looked at before the cut."""
    some = np.arange(len(scores))
    if len(scores) > top:
        least = scores[np.argpartition(scores, len(scores) - top)[len(scores) - top :]].min()
        some = np.flatnonzero(scores >= least)
    return some[np.lexsort((ids[some], -scores[some]))][:top]


def _search(sent, top: int):
    """Shards to each item's best documents among those of a task: place (of the item), doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights, items = sent.value
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        for batch in batches:
            for k in range(batch.num_rows):
                raw = batch.column(0)[k].values
                shard = Shard(raw.fill_null(0).to_numpy(), *(_values(batch.column(c), k) for c in range(1, 5)))
                able = raw.is_valid().to_numpy(zero_copy_only=False)
                places = shard.places(wanted)
                for item, terms in enumerate(items):
                    scores = np.zeros(len(shard.ids), np.int64)
                    for term, times in terms:
                        begin, end = places[term]
                        if begin < end:
                            scores[shard.docs[begin:end]] += weights[term] * times * shard.impacts[begin:end].astype(np.int64)
                    so_far, ids = held[item]
                    least = so_far[-1] if len(so_far) == top else 1
                    near = np.flatnonzero((scores >= least) & able)
                    if len(near):
                        so_far, ids = np.concatenate([so_far, scores[near]]), np.concatenate([ids, shard.ids[near]])
                        order = best(so_far, ids, top)
                        held[item] = so_far[order], ids[order]
        place = np.repeat(np.arange(len(items)), [len(s) for s, _ in held])
        columns = [place, *(np.concatenate([x[k] for x in held] or [np.zeros(0, np.int64)]) for k in (1, 0))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["place", "doc_id", "score"])

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """Items in blocks of bounded size; the driver holds a block and a partition of the items."""
    held, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        if held and (len(held) >= BLOCK_ITEMS or size + len(row[1] or "") > BLOCK_BYTES):
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1] or "")
    if held:
        yield held


def search(index: Index, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best documents of the index for each row of ``items`` (item_id, text, any other columns): item_id, rank (from 1), doc_id, score.

    Terms are runs of letters and digits, with only A-Z lower-cased. A term's weight falls with the number of documents that hold it; a
    document's score is the sum, over the item's terms with their repeats, of weight times impact, in whole numbers. Documents with score 0 aren't
    returned; equal scores go by ascending doc_id.

    Items are taken in blocks: each block's terms are counted and looked up in every shard, term at a time into one dense array of scores by
    document; a task keeps each item's best over its shards, and the tasks' bests, ``top`` for each item and task, are merged by a window.

    Null and empty texts have no terms: as documents they count for nothing, as items they find nothing. A document without an id counts, but isn't
    returned; rows that repeat a doc_id are documents of their own, as items that repeat an item_id are items of their own. Terms are
    told apart by 64-bit hashes: that any of a thousand query terms meets another of 10^10 has a chance of one in a million.
    """
    spark, found = index.shards.sparkSession, None
    for block in _blocks(items):
        hashes, sizes = terms_of([text for _, text in block], WordHasher(_BLANK))
        wanted = np.unique(hashes)
        at = np.searchsorted(wanted, hashes).tolist()
        ends = np.cumsum(sizes).tolist()
        counted = [sorted(Counter(at[e - n : e]).items()) for e, n in zip(ends, sizes.tolist(), strict=True)]
        df = np.zeros(len(wanted), np.int64)
        for row in index.shards.select("terms", "ends").mapInArrow(_frequencies(wanted), "at long, df long").groupBy("at").agg(F.sum("df")).collect():
            df[row[0]] = row[1]
        weights = [math.floor(1000 * math.log((2 * index.documents + 2) / (2 * d + 1))) for d in df.tolist()]
        sent = spark.sparkContext.broadcast((wanted, weights, counted))  # a block of items, whatever the corpus
        names = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(block)], "place long, item_id long")
        scored = index.shards.mapInArrow(_search(sent, top), "place long, doc_id long, score long")
        rank = F.row_number().over(Window.partitionBy("place").orderBy(F.col("score").desc(), "doc_id"))
        some = scored.withColumn("rank", rank).where(F.col("rank") <= top).join(F.broadcast(names), "place").select("item_id", "rank", "doc_id", "score")
        found = some if found is None else found.union(some)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents for each benchmark item."""
    return search(build_index(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op11_lexical_search": op11_lexical_search}

ORACLES = {
    "op11_lexical_search": r"""
WITH w AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents UNION ALL SELECT 1, item_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') FROM benchmark),
t AS (SELECT side, id, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM w),
c AS (SELECT side, id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT id, len(w)::BIGINT AS n FROM w WHERE side = 0 AND len(w) > 0),
all_n AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM c, all_n WHERE side = 0 GROUP BY term, docs),
p AS (SELECT c.id, c.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS points FROM c JOIN n ON n.id = c.id JOIN weight ON weight.term = c.term, all_n WHERE side = 0),
s AS (SELECT c.id AS item_id, p.id AS doc_id, sum(c.tf * points)::BIGINT AS score FROM c JOIN p ON p.term = c.term WHERE c.side = 1 GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20""",
}
