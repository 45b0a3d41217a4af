"""SpotSigs document fingerprints (operator 9)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.shingles import WordHasher, chunks, mix
from clausewright.llm.staging import staged

#: Common words of English, German, French and Spanish before which a chain is taken.
ANCHORS = "a an the is was are of and to in der die das ein eine ist und le les un une est et du el los una es y que".split()
#: Content words in a chain.
CHAIN = 2
#: Rows of one ordered part, and parts at most. A part is worked through in order, a row at a time, so it may have any size.
PART_ROWS, MOST_PARTS = 20_000, 100_000
#: Ids from which the parts are drawn up: so many, or so many for each part; and how often one is drawn that is cut by its texts.
SAMPLE_IDS, SAMPLE_OF_PART, FREQUENT = 20_000, 10, 20
SLICE = 256
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Spotter:
    """Sets of signatures: for each anchor word, it and the next CHAIN words that are no anchors."""

    def __init__(self, anchors: list[str] = ANCHORS, chain: int = CHAIN):
        self.hasher, self.chain = WordHasher(~_LETTER), chain
        self.anchors = np.unique(self.hasher([" ".join(anchors).encode()])[0])

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for at, raw in chunks([t.lower() if t else t for t in texts]):
            hashes, firsts, _, _ = self.hasher(raw)
            found = np.searchsorted(self.anchors, hashes)
            found[found == len(self.anchors)] = 0
            anchored = self.anchors[found] == hashes
            for i in range(len(raw)):
                out.append(self._one(hashes[firsts[i] : firsts[i + 1]], anchored[firsts[i] : firsts[i + 1]], texts[at + i]))
        return out

    def _one(self, hashes: np.ndarray, anchored: np.ndarray, text: str | None) -> np.ndarray:
        spots, content = np.flatnonzero(anchored), np.flatnonzero(~anchored)
        following = np.searchsorted(content, spots)
        full = following + self.chain <= len(content)
        spots, following = spots[full], following[full]
        if not len(spots):  # no anchor is followed by a chain: each word is its own signature, or else the text is
            if len(hashes):
                return np.unique(mix(hashes) >> np.uint64(32)).astype(np.uint32)
            whole = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:4] if text else b""
            return np.frombuffer(whole, np.uint32)
        value = hashes[spots]
        for k in range(self.chain):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + hashes[content[following + k]])
        return np.unique(value >> np.uint64(32)).astype(np.uint32)


def shown(signatures: np.ndarray) -> str:
    """A fingerprint: its signatures in ascending order, eight hexadecimal digits each."""
    return signatures.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity; two empty fingerprints are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, lead, doc_id, text) in order; each row that isn't a lead is compared with the one after it."""
    spotter = Spotter()
    before: tuple | None = None  # the row that waits for the next: doc_id, text, signatures
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            leads, ids, texts = (part.column(k).to_pylist() for k in (1, 2, 3))
            texts = [t or "" for t in texts]
            rows = []
            for lead, i, text, signatures in zip(leads, ids, texts, spotter.of(texts), strict=True):
                if before is not None:
                    rows.append((*before, text, signatures))
                before = None if lead else (i, text, signatures)
            edited = []
            for _, text, _, following, _ in rows:
                k = len(text) // 3
                edited.append(text[: len(text) - k] + following[:k])
            others = spotter.of(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([len(r[1]) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                    pa.array([shown(r[2]) for r in rows], pa.string()),
                    pa.array([shown(o) for o in others], pa.string()),
                    pa.array([likeness(r[2], o) for r, o in zip(rows, others, strict=True)], pa.float64()),
                    pa.array([likeness(r[2], r[4]) for r in rows], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def _sortable(place: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Pairs of numbers as bytes in the same order."""
    both = np.stack([place, text], axis=1).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").reshape(-1)


def fingerprint_and_compare(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) to one row per row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The next document is the one after it in the order of descending doc_id (after the last: the first); the edited
    text is the text with its last third replaced by the beginning of the next. Equal texts have equal fingerprints.

    The ids are cut into parts of about PART_ROWS rows (MOST_PARTS at most) by a bounded sample of them; an id that is
    frequent in it, as null may be, is cut by the hashes of its texts too. Each text is shuffled once, to its
    part, which is a task of its own; the first row of each part goes to the part before it too, as the lead after its last row. So each
    part can be worked through in order, a row at a time, and no window over all rows is needed. The driver gets the sample and a
    row for each part.

    A null text is an empty one. Rows with a null doc_id come last; rows that repeat a doc_id follow each other in the
    order of their texts, or of the texts' hashes if it is frequent. A single row is its own next one. An empty table gives an empty one.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("place", F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)))  # ascends where doc_id descends; null is last
    count = rows.count()
    wanted = min(MOST_PARTS, max(math.ceil(count / PART_ROWS), min(count, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))))
    share = min(1.0, max(SAMPLE_IDS, SAMPLE_OF_PART * wanted) / max(1, count))
    drawn = F.rand(7) < share  # which rows are drawn changes the parts' sizes alone, never the result
    often = [r.place for r in rows.where(drawn).groupBy("place").count().where(F.col("count") >= FREQUENT).select("place").collect()]
    # the texts are read for this only if there are such ids
    rows = rows.withColumn("cut", F.when(F.col("place").isin(often), F.xxhash64("text")).otherwise(0) if often else F.lit(0).cast("long"))
    some = rows.where(drawn).select("place", "cut").toPandas()
    order = np.sort(_sortable(some.place.to_numpy(np.int64), some.cut.to_numpy(np.int64)))
    bounds = np.unique(order[[len(order) * k // wanted for k in range(1, wanted)]]) if len(order) and wanted > 1 else order[:0]

    @F.pandas_udf("int")
    def part_of(place: pd.Series, cut: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, _sortable(place.to_numpy(np.int64), cut.to_numpy(np.int64)), side="right").astype(np.int32))

    first = sorted((r.part, r.least.place, r.least.cut) for r in rows.groupBy(part_of("place", "cut").alias("part")).agg(F.min(F.struct("place", "cut")).alias("least")).collect())
    leads = _sortable(np.array([p for _, p, _ in first], np.int64), np.array([c for _, _, c in first], np.int64))  # ascending, as the parts are
    lead_parts = np.array([first[k - 1][0] for k in range(len(first))], np.int32)  # the first of all follows the last

    @F.pandas_udf("array<struct<part:int,lead:boolean>>")
    def parts_of(place: pd.Series, cut: pd.Series) -> pd.Series:
        keys = _sortable(place.to_numpy(np.int64), cut.to_numpy(np.int64))
        own = np.searchsorted(bounds, keys, side="right")
        at = np.minimum(np.searchsorted(leads, keys), max(0, len(leads) - 1))
        leading = leads[at] == keys if len(leads) else np.zeros(len(keys), bool)
        return pd.Series([[{"part": int(o), "lead": False}] + ([{"part": int(lead_parts[a]), "lead": True}] if x else []) for o, a, x in zip(own, at, leading, strict=True)])

    dealt = rows.withColumn("to", F.explode(parts_of("place", "cut"))).select("to.part", "to.lead", "doc_id", "text", "place", "cut")
    ordered = dealt.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "lead", "place", "cut", "text")
    return ordered.select("part", "lead", "doc_id", "text").mapInArrow(_compared, schema)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) to one row per row: doc_id, signatures (sorted array of long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spotter = Spotter()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [s.astype(np.int64) for s in spotter.of(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "signatures"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, signatures array<long>")


def similar(found: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Fingerprints to (members, pairs): doc_id with class_key, and pairs of classes (u, v, likeness) at ``threshold`` or more.

    Equal fingerprints form a class, named by a 128-bit hash of the set, so that documents with the same id and different sets
    are in different ones. Classes are compared in partitions by set length: partition p holds lengths from t^-p to t^-(p+1), and a set can
    be alike only to sets of its own partition and the next. Within these, two sets can only be alike if they share one of the first
    (1 - t) * length + 1 signatures, the rarest first; the pairs that do are pruned by length and then measured exactly.
    Empty fingerprints are alike to nothing but each other. Rows without a doc_id are left out.
    """
    name = F.concat(*(F.lpad(F.hex(x), 16, "0") for x in (F.xxhash64("signatures"), F.xxhash64(F.lit("more"), "signatures"))))
    keyed = found.where("doc_id is not null").select("doc_id", name.alias("class_key"), "signatures")
    members = keyed.select("doc_id", "class_key")
    classes = staged(keyed.where(F.size("signatures") > 0).select("class_key", "signatures").dropDuplicates(["class_key"]), "sets")
    each = classes.select("class_key", F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
    rarity = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(rarity, "s").groupBy("class_key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("r"))
    keep = F.floor(F.col("n") * (1 - threshold) + 1e-9).cast("int") + 1
    alone = F.col("n") - F.size("r")  # signatures that no other set has come first of all
    heads = ranked.where(keep > alone).withColumn("p", F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int"))
    heads = heads.select("class_key", "n", "p", F.explode(F.slice("r", F.lit(1), keep - alone)).alias("x")).select("class_key", "n", "p", "x.s")
    u = heads.select(F.col("class_key").alias("u"), F.col("n").alias("n_u"), "s", F.explode(F.array(F.col("p"), F.col("p") + 1)).alias("p"))
    v = heads.select(F.col("class_key").alias("v"), F.col("n").alias("n_v"), "s", "p")
    near = u.join(v, ["s", "p"]).where((F.col("u") != F.col("v")) & (F.least("n_u", "n_v") >= threshold * F.greatest("n_u", "n_v")))
    near = near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    a, b = (classes.select(F.col("class_key").alias(k), F.col("signatures").alias(f"s_{k}")) for k in ("u", "v"))
    both = F.size(F.array_intersect("s_u", "s_v"))
    measured = near.join(a, "u").join(b, "v").select("u", "v", (both / (F.size("s_u") + F.size("s_v") - both)).alias("likeness"))
    return members, measured.where(F.col("likeness") >= threshold - 1e-12)


def links(found: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Fingerprints to one row per row with a doc_id: doc_id, class_id (the smallest doc_id of its class), class_key (which tells classes
    apart, also those of documents that share an id), n_links (other classes that are alike)."""
    members, pairs = similar(staged(found, "fingerprints"), threshold)
    ends = pairs.select(F.explode(F.array("u", "v")).alias("class_key")).groupBy("class_key").agg(F.count("*").alias("n_links"))
    told = members.groupBy("class_key").agg(F.min("doc_id").alias("class_id")).join(ends, "class_key", "left")
    return members.join(told, "class_key").select("doc_id", "class_id", "class_key", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def spot_signature_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op9_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_and_compare(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_spot_signatures": op9_spot_signatures, "spot_signature_links": spot_signature_links}
ORACLES: dict[str, str] = {}
