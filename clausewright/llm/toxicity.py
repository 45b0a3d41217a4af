"""Counterfactual-regularised toxicity classifier (operator 7)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.staging import staged

#: Bound of what is learned from: labelled rows of each class. Their whole texts are read.
SAMPLE_ROWS = 4_000
#: Weight of the mean squared difference between counterfactual scores in the loss.
PENALTY = 1.0
#: A word's features are itself and its beginnings of these lengths (compounds share their stem), hashed to so many.
BEGINNINGS, FEATURES = (4, 5, 6, 7, 8), 1 << 22
#: Features that the model uses, besides those of identity terms: those whose share of documents differs most between the classes.
CHOSEN = 6_000
LEAST_DOCUMENTS = 4
SLICE = 256

#: Groups of identity terms that can stand for each other in a sentence.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("american", "mexican", "african", "european", "chinese", "indian", "arab"),
    ("immigrants", "natives", "refugees", "citizens"),
    ("disabled", "blind", "deaf", "healthy"),
    ("old", "young"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile(r"[.!?\n]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Buckets(dict):
    """The features of a word (of those in ``only``, if given, as places in it), remembered for a bounded number of words."""

    def __init__(self, only: np.ndarray | None = None):
        self.only = only

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= 200_000:
            self.clear()
        parts = [f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n)]
        found = np.array([xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass"), seed=7) % FEATURES for p in parts], np.int64)
        if self.only is not None:
            at = np.searchsorted(self.only, found)
            at[at == len(self.only)] = 0
            found = at[self.only[at] == found] if len(self.only) else found[:0]
        self[word] = found
        return found


Terms = tuple[tuple[str, ...], ...]


def put_in(text: str, terms: Terms) -> tuple[str, tuple[str, ...]]:
    """The term that a text which names no group is given, and its group, drawn by the text's hash."""
    draw = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    group = terms[draw % len(terms)]
    return group[draw // len(terms) % len(group)], group


def mentioned(text: str | None, terms: Terms) -> tuple[list[str], list[tuple[list[str], list[str]]]]:
    """A text's words, and pairs of its sentences (as words) that differ in an identity term alone.

    Each sentence that names a group gives a pair for each other term of the group. A text that names none has a term put
    after its words, so that terms which the labelled texts lack are learned to mean nothing; its pairs are
    those of its sentence with the least hash, with that term and the others of its group put after it.
    """
    groups = {term: group for group in terms for term in group}
    sentences = [w for w in map(words, _SENTENCE_END.split(text or "")) if w]
    pairs = [(s, [other if w == term else w for w in s]) for s in sentences for term in sorted(groups.keys() & set(s)) for other in groups[term] if other != term]
    if pairs or not sentences or not terms:
        return words(text), pairs
    own, group = put_in(text, terms)
    least = min(sentences, key=lambda w: (xxhash.xxh64_intdigest(" ".join(w).encode("utf-8", "surrogatepass")), w))
    return [*words(text), own], [([*least, own], [*least, other]) for other in group if other != own]


def featurise(tokens: list[str], buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Features and their values: 1 + ln(count) for each."""
    times = Counter(tokens)
    parts = [(found, n) for found, n in zip(map(buckets.__getitem__, times), times.values(), strict=True) if len(found)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0)
    every = np.concatenate([f for f, _ in parts])
    found, place = np.unique(every, return_inverse=True)
    counts = np.bincount(place, np.repeat([n for _, n in parts], [len(f) for f, _ in parts]))
    return found, 1 + np.log(counts)


@dataclass
class Model:
    """Weights of the features in ``only`` (sorted), the constant, and the counterfactual pairs that were fitted to."""

    only: np.ndarray
    weights: np.ndarray
    constant: float
    gaps: Gaps | None = None


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Gaps:
    """The counterfactual pairs, as the sum of d d' over the differences d of their features: the only thing of them
    that the penalty depends on, of a size that the terms bound however many pairs there are."""

    rows: np.ndarray
    columns: np.ndarray
    sums: np.ndarray
    pairs: int

    def mean(self, weights: np.ndarray) -> float:
        """The mean squared difference of the pairs' raw scores."""
        return float((weights[self.rows] * self.sums * weights[self.columns]).sum()) / max(1, self.pairs)


def fit(only: np.ndarray, own: list, labels: list[int], gaps: Gaps | None = None, penalty: float = PENALTY, decay: float = 1e-4, steps: int = 300) -> Model:
    """Logistic regression by full-batch descent with momentum and a step size for each feature.

    ``own`` holds (places, values) of each document. The loss is the class-balanced cross-entropy, plus ``penalty``
    times the mean squared difference between the raw scores of counterfactual sentences, plus ``decay`` times the squared weights.
    """
    label = np.array(labels, float)
    if not len(label) or label.min() == label.max():
        return Model(only[:0], np.zeros(0), 20.0 if len(label) and label[0] else -20.0)
    row = np.repeat(np.arange(len(own)), [len(x[0]) for x in own])
    place, value = np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own])
    share = np.where(label > 0, 0.5 / label.sum(), 0.5 / (1 - label).sum())
    n = len(only) + 1
    weights, move, scale = np.zeros(n), np.zeros(n), np.zeros(n)
    for step in range(1, steps + 1):
        raw = np.bincount(row, value * weights[place], len(label)) + weights[-1]
        error = share * (_sigmoid(raw) - label)
        slope = np.bincount(place, value * error[row], n) + 2 * decay * weights
        slope[-1] = error.sum()
        if gaps is not None and gaps.pairs:
            slope += penalty * 2 / gaps.pairs * np.bincount(gaps.rows, gaps.sums * weights[gaps.columns], n)
        move = 0.9 * move + 0.1 * slope
        scale = 0.99 * scale + 0.01 * slope**2
        weights -= 0.03 * (move / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-9)
    return Model(only, weights[:-1], float(weights[-1]), gaps)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with labels to the number of documents of either class that have a feature, summed for each batch."""
    buckets = Buckets()
    for batch in batches:
        found, labels = [], batch.column(1).to_pylist()
        for text, label in zip(batch.column(0).to_pylist(), labels, strict=True):
            features, _ = featurise(words(text), buckets)
            found.append(features * 2 + label)
        keys, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys >> 1), pa.array(keys & 1), pa.array(counts)], ["feature", "label", "n"])


def _vectors(only: np.ndarray, terms: Terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(only)
        for batch in batches:
            rows = [featurise(mentioned(text, terms)[0], buckets) for text in batch.column(0).to_pylist()]
            arrays = [pa.array([row[k] for row in rows], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.float32()))]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column(1)], ["i", "v", "label"])

    return run


def _gap_sums(only: np.ndarray, terms: Terms):
    """Texts to the sums of d d' over their counterfactual pairs, by places i and j; the row i = j = -1 counts the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(only)
        for batch in batches:
            sums: Counter[tuple[int, int]] = Counter()
            for text in batch.column(0).to_pylist():
                for one, two in mentioned(text, terms)[1]:
                    gap = dict(zip(*map(np.ndarray.tolist, featurise(one, buckets)), strict=True))
                    for i, v in zip(*map(np.ndarray.tolist, featurise(two, buckets)), strict=True):
                        gap[i] = gap.get(i, 0.0) - v
                    left = [(i, v) for i, v in gap.items() if v]
                    sums[-1, -1] += 1
                    for i, v in left:
                        for j, w in left:
                            sums[i, j] += v * w
            columns = [[i for i, _ in sums], [j for _, j in sums], [float(s) for s in sums.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.float64()), strict=True)], ["i", "j", "s"])

    return run


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, terms: Terms = IDENTITY_TERMS, penalty: float = PENALTY) -> Model:
    """Fits on about ``rows`` labelled documents of each class at most, those with the least hash of doc_id, read whole.

    The draw is made on the labels before any text is read, so what is joined to the texts is small and is
    sent to them. Features are counted and chosen on the executors; what reaches the driver is CHOSEN features (those of ``terms``
    come in any case), for the sampled documents their values, and for all counterfactual pairs together a sum for each two features of ``terms``.
    Rows with a null text, doc_id or label teach nothing; of rows that repeat a doc_id in the labels the largest label
    counts, and rows that repeat one in the documents all teach it.
    """
    drawn = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    drawn = drawn.withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    counts = {r.label: r["count"] for r in drawn.groupBy("label").count().collect()}
    if len(counts) < 2:
        return fit(np.zeros(0, np.int64), [], [*counts])
    share = F.create_map(*(F.lit(x) for label, n in sorted(counts.items()) for x in (label, rows / n)))
    chosen = drawn.where(F.col("draw") < share[F.col("label")]).select("doc_id", "label")
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # `rows` of each class on average and never many more: a table of some hundred kilobytes
    sampled = staged(texts.join(F.broadcast(chosen), "doc_id").select("text", "label"), "sample")
    of = {r.label: max(1, r["count"]) for r in sampled.groupBy("label").count().collect()}
    both = sampled.mapInArrow(_document_counts, "feature long, label long, n long").groupBy("feature").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("n"))
    bad, good = F.col("bad") / of.get(1, 1), (F.col("n") - F.col("bad")) / of.get(0, 1)
    all_share = F.col("n") / max(1, sum(of.values()))
    both = both.where(F.col("n") >= LEAST_DOCUMENTS).withColumn("apart", F.abs(bad - good) / F.sqrt(all_share * (1.0001 - all_share)))
    chosen_features = np.array([r.feature for r in both.orderBy(F.desc("apart"), "feature").limit(CHOSEN).collect()], np.int64)
    only = np.unique(np.concatenate([chosen_features, *map(Buckets().__getitem__, (term for group in terms for term in group))]))
    found = sampled.mapInArrow(_vectors(only, terms), "i array<int>, v array<float>, label int").toArrow().combine_chunks()
    own = [(np.array(i, np.int64), np.array(v, float)) for i, v in zip(found.column("i").to_pylist(), found.column("v").to_pylist(), strict=True)]
    summed = sampled.mapInArrow(_gap_sums(only, terms), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    pairs, apart = summed[summed.i < 0], summed[summed.i >= 0]
    gaps = Gaps(apart.i.to_numpy(np.int64), apart.j.to_numpy(np.int64), apart.s.to_numpy(float), int(pairs.s.sum()))
    return fit(only, own, found.column("label").to_pylist(), gaps, penalty)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) to one row per row: doc_id, score (0 to 1), predicted (0 or 1).

    The whole text counts. Null, empty and wordless texts get the score of the constant alone, which a model
    fitted on both classes keeps low; with nothing to learn from, all scores are near 0. Rows are independent: nothing
    is shuffled, a null doc_id stays null, repeated rows get equal scores, other columns are ignored. What is sent to
    tasks is the weights (CHOSEN at most).
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.only, model.weights, model.constant))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        buckets = Buckets(model.only)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                raw = [model.constant + float(v @ model.weights[f]) for f, v in (featurise(words(t), buckets) for t in part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_sigmoid(np.array(raw)), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = learn(docs.select("doc_id", "text"), labels.where(~held_out()).select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict[str, str] = {}
