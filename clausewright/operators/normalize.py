"""Normalization of document text; every step is a column expression, so it runs where the text is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import patterns as P


def without_page_artifacts(text: Column) -> Column:
    return F.regexp_replace(text, P.PAGE_ARTIFACT, "")


def with_ocr_fixes(text: Column) -> Column:
    fixed = text
    for wrong, right in P.OCR_FIXES.items():
        fixed = F.regexp_replace(fixed, rf"(?iuU)\b{wrong}\b", right)
    return F.when(text.rlike(P.ANY_OCR_ERROR), fixed).otherwise(text)


def dehyphenated(text: Column) -> Column:
    return F.when(text.contains("-"), F.regexp_replace(text, r"(?U)([a-zA-Z])-\s*\n\s*([a-zA-Z])", "$1$2")).otherwise(text)


def merged_lines(text: Column) -> Column:
    """Lines are stripped and joined to a line before them that isn't blank, unless they begin a claim."""
    text = F.regexp_replace(text, r"(?U)[^\S\n]*\n[^\S\n]*", "\n")
    text = F.regexp_replace(text, r"(?U)^[^\S\n]+|[^\S\n]+\z", "")
    text = F.regexp_replace(text, r"(?Uiu)(?<=[^\n])\n(?=[^\n])(?!(?:claim[^\S\n]+)?\d+\.(?!\d))", " ")
    return F.regexp_replace(text, r"\n{2,}", "\n\n")


def normalize(docs: DataFrame, text: str = "text") -> DataFrame:
    """``text`` normalized, and ``ops``, the names of what was done (two are always named)."""
    spaced = F.regexp_replace(without_page_artifacts(F.col(text)), r"\n{3,}", "\n\n")
    fixed = with_ocr_fixes(F.col("spaced"))
    docs = docs.withColumn("spaced", spaced).withColumn("fixed", fixed)
    always = F.array(F.lit("page_artifacts_removed"), F.lit("whitespace_cleaned"))
    ops = F.when(F.col("fixed") != F.col("spaced"), F.concat(always, F.array(F.lit("ocr_cleanup_applied")))).otherwise(always)
    return docs.withColumn("ops", ops).withColumn(text, merged_lines(dehyphenated(F.col("fixed")))).drop("spaced", "fixed")
