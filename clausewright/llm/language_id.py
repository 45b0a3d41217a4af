"""Language identification by compression (operator 8)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bound of what is learned from: labelled documents of each language. Their whole texts are the dictionary.
SAMPLE_DOCUMENTS = 64
#: A text is compressed in blocks of so many bytes, each against the whole dictionary.
BLOCK_BYTES = 4_096
#: Ends every dictionary and goes before every block, so that no block is too short to be compressed; it costs the same in all languages.
CARRIER = "".join(hashlib.sha256(bytes([k])).hexdigest() for k in range(4)).encode()
#: The least share by which the second-best language must be larger for a document to be accepted.
LEAST_MARGIN = 0.004
UNDETERMINED = "und"
SLICE = 256

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_only(text: str | None) -> str:
    """Lower-cased words of letters with a space around each: case, digits and marks tell nothing of a language."""
    return f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} " if text else ""


def sample(labelled: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> tuple[list[str], DataFrame]:
    """The languages, commonest first, and at most ``documents`` whole texts of each.

    Which ones doesn't depend on the number of partitions: those with the least hash of doc_id. One pass
    over the labels alone counts the languages (one row each comes to the driver); a hash threshold from
    the counts then leaves about four times as many rows as are wanted, and only these are ranked.
    """
    drawn = labelled.where("text is not null and lang is not null").withColumn("draw", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    counts = sorted(((row["count"], row.lang) for row in drawn.groupBy("lang").count().collect()), key=lambda c: (-c[0], c[1]))
    languages = [lang for _, lang in counts]
    if not counts:
        return languages, drawn.select("lang", F.lit(1).alias("place"), "text")
    shares = {lang: 4.0 * documents / n for n, lang in counts}
    share = F.create_map(*(F.lit(x) for pair in sorted(shares.items()) for x in pair))
    some = drawn.where(F.col("draw") < share[F.col("lang")])
    ranked = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.col("doc_id"), "text")))
    return languages, ranked.where(F.col("place") <= documents).select("lang", "place", "text")


def learn(labelled: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> dict[str, bytes]:
    """The raw-content dictionary of each language, commonest first: the letters of at most ``documents`` whole texts."""
    languages, rows = sample(labelled, documents)
    texts: dict[str, list[tuple[int, str]]] = {lang: [] for lang in languages}
    for row in rows.collect():  # bounded by the number of documents and of languages
        texts[row.lang].append((row.place, letters_only(row.text)))
    learned = {lang: "".join(t for _, t in sorted(found)).encode("utf-8", "replace") for lang, found in texts.items()}
    return {lang: raw for lang, raw in learned.items() if raw.strip()}


class Classifier:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.of: list[tuple[str, zstandard.ZstdCompressor, int]] = []
        for lang, raw in dictionaries.items():
            held = zstandard.ZstdCompressionDict(raw + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            reach = max(17, (len(raw) + 2 * len(CARRIER) + BLOCK_BYTES).bit_length())  # the window holds the whole dictionary
            how = zstandard.ZstdCompressionParameters.from_level(5, dict_size=len(raw) + len(CARRIER), window_log=min(27, reach), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
            with_dictionary = zstandard.ZstdCompressor(dict_data=held, compression_params=how)
            self.of.append((lang, with_dictionary, len(with_dictionary.compress(CARRIER))))

    def sizes(self, text: str) -> list[tuple[int, int, str]]:
        raw = text.encode("utf-8", "replace")
        blocks = [raw[at : at + BLOCK_BYTES] for at in range(0, len(raw), BLOCK_BYTES)]
        return sorted((sum(len(c.compress(CARRIER + b)) - least for b in blocks), k, lang) for k, (lang, c, least) in enumerate(self.of))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, margin from 0 to 1, and whether the margin is too narrow; ties go to the commonest language."""
        letters = letters_only(text)
        if not self.of or not any(map(str.isalpha, letters)):
            return UNDETERMINED, 0.0, True
        sizes = self.sizes(letters)
        if len(sizes) == 1:
            return sizes[0][2], 1.0, False
        (best, _, lang), (second, _, _) = sizes[:2]
        margin = min(1.0, (second - best) / max(1, second, second - best))
        return lang, margin, margin < LEAST_MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) to one row per row: doc_id, lang_pred, score, rejected.

    The whole text is compressed with each dictionary and the smallest wins. score is the share by which
    the second-best is larger, from 0 to 1. Rejected are documents with a narrow margin, and those with
    null, empty or letterless text, whose lang_pred is ``und`` and score 0; if nothing was learned, that holds
    for all. Rows are independent: nothing is shuffled, a null doc_id stays null, repeated rows get equal
    results, other columns are ignored. What is sent to tasks is one dictionary a language, of a bounded number of documents.
    """
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [classifier.predict(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """Those rows of ``docs`` that identify() doesn't reject, with their columns as they are; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.pandas_udf("boolean")
    def told(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        classifier = Classifier(sent.value)
        for some in texts:
            yield pd.Series([not classifier.predict(t)[2] for t in some], dtype=bool)

    return docs.where(told(F.col("text").cast("string")))


def remainder(of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = learn(docs.where(remainder(4) != 2).select("doc_id", "text", "lang"))
    return identify(docs, dictionaries).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op8_language_id": op8_language_id}
ORACLES: dict[str, str] = {}
