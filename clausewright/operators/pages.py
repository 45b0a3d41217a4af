"""Lines that run along the edges of a document's pages: headers, footers and page numbers, found by how often they come back.

A document's pages are told by form feeds. Everything is a column expression on the document's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions.text import strip

PAGE_BREAK = "\f"
#: Lines at an edge that can be running ones, and the pages that must have one: so many, and such a share (left and right pages may differ).
DEPTH, LEAST_PAGES, PERCENT = 2, 3, 40


def shape(line: Column) -> Column:
    """What stays the same of a running line from page to page: lower case, numbers as one sign, single blanks."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(line)), r"\d+([.,]\d+)*", "#"), r"(?U)\s+", " ")


def _edges(lines: Column, depth: int) -> tuple[Column, Column]:
    """Places (from 0) of the first and of the last lines of a page that aren't blank."""
    places = F.filter(F.transform(lines, lambda x, i: F.when(strip(x) != "", i)), lambda i: i.isNotNull())
    n = F.size(places)
    return F.slice(places, F.lit(1), F.lit(depth)), F.slice(places, F.greatest(n - depth + 1, F.lit(1)), F.lit(depth))


def without_running_lines(docs: DataFrame, text: str = "text", depth: int = DEPTH, least_pages: int = LEAST_PAGES, percent: int = PERCENT) -> DataFrame:
    """``docs`` with running lines taken out of ``text``, n_pages, and running (array): the shapes of these lines, a ^ before those of the
    upper edge and a $ before those of the lower one.

    A line among the first, or last, ``depth`` lines of a page that aren't blank is a running one if ``least_pages`` of the document's pages
    and ``percent`` of them have a line of its shape at that edge. Other places, as a recurring line amid pages, don't count and
    keep their lines. A page that repeats as a whole loses its edges like any other. Page breaks stay. A null text has no pages; texts without
    running lines stay as they are.
    """
    pages = F.transform(F.split(F.col(text), PAGE_BREAK, -1), lambda p: F.split(p, "\n", -1))

    def placed(lines: Column) -> Column:
        first, last = _edges(lines, depth)
        return F.struct(lines.alias("lines"), first.alias("first"), last.alias("last"))

    def shapes(page: Column) -> Column:
        def at(places: Column, mark: str) -> Column:
            return F.transform(places, lambda i: F.concat(F.lit(mark), shape(page["lines"][i])))

        return F.array_distinct(F.concat(at(page["first"], "^"), at(page["last"], "$")))

    # equal shapes stand together once sorted: one is kept when its count reaches what is needed, so few are, and the fold is linear
    def counted(state: Column, x: Column) -> Column:
        n = F.when(x == state["last"], state["n"] + 1).otherwise(1)
        return F.struct(x.alias("last"), n.alias("n"), F.when(n == F.col("running_needed"), F.concat(state["kept"], F.array(x))).otherwise(state["kept"]).alias("kept"))

    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"))
    found = docs.withColumn("running_pages", F.transform(pages, placed)).withColumn("n_pages", F.when(F.col(text).isNull(), 0).otherwise(F.size("running_pages")))
    needed = F.greatest(F.lit(least_pages), F.ceil(F.col("n_pages") * percent / 100)).cast("int")
    found = found.withColumn("running_needed", needed).withColumn("running_shapes", F.array_sort(F.flatten(F.transform("running_pages", shapes))))
    found = found.withColumn("running", F.aggregate("running_shapes", start, counted, lambda s: s["kept"]))

    def goes(page: Column, line: Column, i: Column) -> Column:
        above = F.array_contains(page["first"], i) & F.array_contains(F.col("running"), F.concat(F.lit("^"), shape(line)))
        return above | (F.array_contains(page["last"], i) & F.array_contains(F.col("running"), F.concat(F.lit("$"), shape(line))))

    kept = F.transform("running_pages", lambda page: F.array_join(F.filter(page["lines"], lambda line, i: ~goes(page, line, i)), "\n"))
    rest = F.when(F.size("running") > 0, F.array_join(kept, PAGE_BREAK)).otherwise(F.col(text))
    return found.withColumn(text, rest).drop("running_pages", "running_needed", "running_shapes")
