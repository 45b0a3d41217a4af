"""Claims out of normalized text: sections, numbered claims, dependencies, transitions, headers and elements.

Everything up to the elements is row-local; splitting a document into claims is one explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausewright.functions import patterns as P
from clausewright.functions.text import blank_to_null, first_split, pieces_after, strip

#: A range of more claims than this is an error of its document instead of an array of that size.
LONGEST_RANGE = 100_000
ELEMENT = "struct<ord:int,level:int,marker:string,element_type:string,text:string>"


def claims_section(text: Column) -> Column:
    """What follows the first line that is a section header; without one the whole text."""
    return strip(F.element_at(F.split(text, P.SECTION_HEADER, 2), -1))


def claim_numbers(section: Column) -> Column:
    return F.regexp_extract_all(section, F.lit(P.CLAIM_BOUNDARY), F.lit(1))


def raw_claims(section: Column, numbers: Column | None = None) -> Column:
    """array<struct<number, text>>: numbered claims in order; a text without numbers is claim 1, an empty one has none. ``numbers``: a column with
    those of claim_numbers(), where there is one."""
    numbers = claim_numbers(section) if numbers is None else numbers
    found = F.zip_with(numbers, pieces_after(section, P.CLAIM_BOUNDARY), lambda n, t: F.struct(n.try_cast("bigint").alias("number"), strip(t).alias("text")))
    whole = F.array(F.struct(F.lit(1).cast("bigint").alias("number"), section.alias("text")))
    none = F.array().cast("array<struct<number:bigint,text:string>>")
    return F.when(section.isNull() | (section == ""), none).when(F.size(numbers) == 0, whole).otherwise(found)


def split_all(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """split_claims(), and a row with claim_pos, number and claim_text null for each document without claims."""
    # columns of their own: within the generator each would be worked out wherever it stands
    found = docs.select(*keys, claims_section(F.col(text)).alias("section")).withColumn("numbers", claim_numbers(F.col("section")))
    # the outer form: for the plain one the optimizer would test the array's size first, and so parse the text twice
    listed = found.select(*keys, F.posexplode_outer(raw_claims(F.col("section"), F.col("numbers"))).alias("at", "claim"))
    return listed.select(*keys, (F.col("at") + 1).alias("claim_pos"), F.col("claim.number").alias("number"), F.col("claim.text").alias("claim_text"))


def split_claims(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per claim: the keys, claim_pos (from 1), number (null if it has more than 64 bits), claim_text. Documents without
    claims have no row."""
    return split_all(docs, keys, text).where("claim_pos is not null")


def with_dependencies(claims: DataFrame, text: str = "claim_text") -> DataFrame:
    """Adds is_independent, parent_claims, parent_claim and range_too_long. The first range wins; else all single
    references count, in ascending order. A range that runs backwards is a dependency without parents."""
    t = F.when(F.col(text).rlike(P.ANY_NUMBERED_CLAIM), F.col(text)).otherwise(F.substr(F.col(text), F.lit(1), F.lit(0)))  # nothing to look at without the word
    # columns of their own: each is worked out once
    found = claims.withColumn("asked", t)
    t = F.col("asked")
    singles = F.concat(F.array(F.regexp_extract(t, P.CLAIM_EXPLICIT, 1)), F.regexp_extract_all(t, F.lit(P.CLAIM_SINGLE), F.lit(1)))
    found = found.withColumn("low", F.regexp_extract(t, P.CLAIM_RANGE, 1)).withColumn("high", F.when(F.col("low") != "", F.regexp_extract(t, P.CLAIM_RANGE, 2)))
    found = found.withColumn("singles", F.when(t == "", F.array().cast("array<string>")).otherwise(F.filter(singles, lambda x: x != "")))
    found = found.withColumn("is_range", F.col("low") != "").withColumn("low", F.col("low").try_cast("bigint")).withColumn("high", F.col("high").try_cast("bigint"))
    low, high, is_range, singles = (F.col(c) for c in ("low", "high", "is_range", "singles"))
    fits = F.coalesce((low <= high) & (high - low < LONGEST_RANGE), F.lit(False))
    span = F.when(fits, F.sequence(F.when(fits, low), F.when(fits, high))).otherwise(F.array().cast("array<bigint>"))
    parents = F.when(is_range, span).otherwise(F.array_sort(F.array_distinct(F.transform(singles, lambda x: x.try_cast("bigint")))))
    out = found.withColumn("parent_claims", parents).withColumn("is_independent", ~is_range & (F.size(singles) == 0))
    out = out.withColumn("range_too_long", F.coalesce(high - low >= LONGEST_RANGE, F.lit(False))).withColumn("parent_claim", F.try_element_at("parent_claims", F.lit(1)))
    return out.drop("asked", "low", "high", "is_range", "singles")


def with_listed_parents(claims: DataFrame, text: str = "claim_text") -> DataFrame:
    """Adds parents_ext: all claims that are referred to, in ascending order, with those of lists and of every range ("claims 1, 2 and
    4 to 6"), which parent_claims passes over. Ranges that run backwards or are too long add nothing."""
    t = F.when(F.col(text).rlike(P.ANY_CLAIM), F.col(text)).otherwise("")
    lists = F.array_join(F.regexp_extract_all(t, F.lit(P.CLAIM_LIST), F.lit(1)), ";")
    ends = F.arrays_zip(*(F.regexp_extract_all(lists, F.lit(P.CLAIM_SPAN), F.lit(k)).alias(name) for k, name in ((1, "low"), (2, "high"))))

    def span(x: Column) -> Column:
        low = x["low"].try_cast("bigint")
        high = F.when(x["high"] == "", low).otherwise(x["high"].try_cast("bigint"))
        fits = F.coalesce((low <= high) & (high - low < LONGEST_RANGE), F.lit(False))
        return F.when(fits, F.sequence(F.when(fits, low), F.when(fits, high))).otherwise(F.array().cast("array<bigint>"))

    singles = F.transform(F.regexp_extract_all(t, F.lit(P.CLAIM_SINGLE), F.lit(1)), lambda x: x.try_cast("bigint"))
    return claims.withColumn("parents_ext", F.array_sort(F.array_distinct(F.array_compact(F.concat(F.flatten(F.transform(ends, span)), singles)))))


def category(text: Column) -> Column:
    found = F.lit("unknown")
    for name, pattern in reversed(P.CATEGORIES.items()):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return F.when(text.rlike(P.ANY_CATEGORY), found).otherwise("unknown")


def with_transition(claims: DataFrame, text: str = "claim_text") -> DataFrame:
    """Adds preamble, transition, body, has_colon and category."""
    t = F.col(text)
    has = t.rlike(P.ANY_TRANSITION)
    word = F.when(has, blank_to_null(F.regexp_extract(t, P.TRANSITION, 1)))
    out = claims.withColumn("transition", word).withColumn("around", F.when(F.col("transition").isNotNull(), F.split(t, P.TRANSITION, 2)))
    word, (before, after) = F.col("transition"), (F.get(F.col("around"), F.lit(k)) for k in range(2))
    out = out.withColumn("preamble", F.when(word.isNotNull(), blank_to_null(strip(before)))).withColumn("rest", strip(after))
    rest = F.col("rest")
    colon = F.coalesce(rest.startswith(":"), F.lit(False))
    out = out.withColumn("has_colon", word.isNotNull() & colon)
    return out.withColumn("body", F.when(word.isNull(), t).when(colon, strip(F.substr(rest, F.lit(2)))).otherwise(rest)).withColumn("category", category(t)).drop("around", "rest")


def enumerated(text: Column) -> Column:
    return text.contains("(") & text.rlike(P.ENUMERATED)


def _after_brackets(text: Column) -> Column:
    """array<struct<held, free>>: the text between opening brackets, each up to its last closing one, and what follows that. A semicolon
    is structural if it stands in the latter: no bracket closes after it before one opens."""
    return F.transform(F.split(text, r"\(", -1), lambda x: F.struct(F.regexp_extract(x, r"(?s)^.*\)", 0).alias("held"), F.regexp_replace(x, r"(?s)^.*\)", "").alias("free")))


def structured(text: Column) -> Column:
    """Whether a semicolon of the text is structural."""
    return F.when(text.contains(";"), F.exists(_after_brackets(text), lambda x: x["free"].contains(";"))).otherwise(text.isNull() & F.lit(None))


def structural_pieces(text: Column) -> Column:
    """The text cut after each structural semicolon; a last piece follows it, if an empty one. Linear in the text: a mark is put in, which
    the text is kept from holding itself, and cut at."""
    mark, kept = "\uffff", {"\ufffe": "\ufffe+", "\uffff": "\ufffe-"}
    for char, instead in kept.items():
        text = F.replace(text, F.lit(char), F.lit(instead))
    marked = F.transform(_after_brackets(text), lambda x: F.concat(x["held"], F.replace(x["free"], F.lit(";"), F.lit(f";{mark}"))))

    def back(x: Column) -> Column:
        for char, instead in reversed(kept.items()):
            x = F.replace(x, F.lit(instead), F.lit(char))
        return x

    return F.transform(F.split(F.array_join(marked, "("), mark, -1), back)


def with_header(claims: DataFrame) -> DataFrame:
    """Adds header, replaces body by what is left for the elements, and adds unbound_header for a claim that begins
    with its first marker and so has no header to take from it."""
    suggested = strip(F.concat(F.coalesce("preamble", F.lit("")), F.coalesce(F.concat(F.lit(" "), F.col("transition")), F.lit("")), F.when(F.col("has_colon"), ":").otherwise("")))
    out = claims.withColumn("suggested", suggested)
    out = out.withColumn("whole", F.when(F.col("suggested") != "", strip(F.concat_ws(" ", "suggested", "body"))).otherwise(F.col("body")))
    body, whole = F.col("body"), F.col("whole")
    keeps = (F.col("suggested") != "") & (F.col("has_colon") | body.contains(":") | structured(body) | enumerated(body))
    # each is looked for once and where it matters
    out = out.withColumn("keeps", keeps).withColumn("colon", whole.contains(":"))
    asked = ~F.coalesce("keeps", F.lit(False)) & ~F.coalesce("colon", F.lit(False))
    out = out.withColumn("semicolons", F.when(asked, structured(whole))).withColumn("markers", F.when(asked, enumerated(whole)))
    keeps, colon, semicolons, markers = (F.col(c) for c in ("keeps", "colon", "semicolons", "markers"))
    at = F.instr(whole, F.regexp_extract(whole, P.MARKER, 0))
    head, tail = first_split(whole, ":")
    header = (
        F.when(keeps, F.col("suggested"))
        .when(colon, F.concat(strip(head), F.lit(":")))
        .when(~semicolons & ~markers, whole)
        .when(~semicolons & markers, F.when(at > 1, strip(F.substr(whole, F.lit(1), F.greatest(at - 1, F.lit(0))))))
        .otherwise("")
    )
    rest = (
        F.when(keeps, body)
        .when(colon, strip(tail))
        .when(~semicolons & ~markers, F.lit(""))
        .when(~semicolons & markers, strip(F.substr(whole, F.greatest(at, F.lit(1)))))
        .otherwise(whole)
    )
    out = out.withColumn("header", header).withColumn("new_body", rest)
    return out.withColumn("unbound_header", F.col("header").isNull()).withColumn("body", F.col("new_body")).drop("new_body", "suggested", "whole", "keeps", "colon", "semicolons", "markers")


def _element(order: Column, level: Column, kind: Column, text: Column, marker: Column | None = None) -> Column:
    return F.struct(
        order.cast("int").alias("ord"), level.cast("int").alias("level"), (F.lit(None).cast("string") if marker is None else marker).alias("marker"), kind.alias("element_type"), text.alias("text")
    )


def _kind(text: Column) -> Column:
    return F.when(F.lower(text).startswith("wherein"), "WHEREIN_CLAUSE").otherwise("BODY_ELEMENT")


def marker_level(marker: Column) -> Column:
    """1 for small letters, 2 for roman numbers of several letters, 3 for capitals, 4 for digits."""
    inner = F.regexp_replace(marker, r"[()]", "")
    return F.when(inner.rlike(r"(?U)^\d+$"), 4).when(inner.rlike("^[a-z]$"), 1).when(inner.rlike("^[A-Z]$"), 3).when(F.length(inner) > 1, 2).otherwise(1)


def enumeration_items(body: Column) -> Column:
    markers = F.regexp_extract_all(body, F.lit(P.MARKER), F.lit(0))
    both = F.zip_with(markers, pieces_after(body, P.MARKER), lambda m, t: F.struct(m.alias("m"), strip(t).alias("t")))
    return F.transform(both, lambda x, i: _element(i, marker_level(x["m"]), F.lit("ENUMERATION"), x["t"], x["m"]))


def semicolon_pieces(body: Column) -> Column:
    """array<struct<t, o>>: pieces after structural semicolons that aren't blank."""
    return F.filter(F.transform(structural_pieces(body), lambda x, i: F.struct(strip(x).alias("t"), i.alias("o"))), lambda x: x["t"] != "")


def leading_words(pieces: Column) -> Column:
    """The "and" or "or" that each piece but the first begins with."""
    return F.transform(pieces, lambda x, i: F.when(i > 0, F.regexp_extract(x["t"], r"(?iU)^(and|or)\s+", 1)).otherwise(""))


def semicolon_items(pieces: Column, words: Column) -> Column:
    """array<struct<t, o>>: the pieces; a leading "and" or "or" goes back to the piece before."""
    rest = F.zip_with(pieces, words, lambda x, w: F.struct(F.when(w != "", strip(F.substr(x["t"], F.length(w) + 1))).otherwise(x["t"]).alias("t"), x["o"].alias("o")))
    following = F.slice(F.concat(words, F.array(F.lit(""))), F.lit(2), F.size(words))
    return F.zip_with(rest, following, lambda x, w: F.struct(F.when(w != "", F.concat(x["t"], F.lit(" "), w)).otherwise(x["t"]).alias("t"), x["o"].alias("o")))


def nested_items(items: Column) -> Column:
    """Elements of semicolon items: one with a colon opens a level for all that follow, and its rest is the first below. The items up to
    each such one, and it, have one level."""

    def opens(text: Column) -> Column:
        return text.rlike(r"(?U):(\s+|\z)")

    def both(x: Column, level: Column) -> Column:
        head, tail = first_split(x["t"], r"(?U)(?<=:)(?=\s|\z)")
        below = strip(F.coalesce(tail, F.lit("")))
        plain = F.array(_element(x["o"], level, _kind(x["t"]), x["t"]))
        parent = _element(x["o"], level, _kind(x["t"]), strip(head))
        pair = F.when(below == "", F.array(parent)).otherwise(F.array(parent, _element(x["o"], level + 1, F.lit("BODY_ELEMENT"), below)))
        return F.when(opens(x["t"]), pair).otherwise(plain)

    ends = F.concat(F.array_compact(F.transform(items, lambda x, i: F.when(opens(x["t"]), i + 1))), F.array(F.size(items)))
    begins = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
    spans = F.zip_with(begins, ends, lambda b, e: F.struct(b.alias("b"), e.alias("e")))
    parts = F.transform(spans, lambda s, k: F.transform(F.slice(items, s["b"] + 1, s["e"] - s["b"]), lambda x: both(x, k + 1)))
    return F.flatten(F.flatten(parts))


def with_elements(claims: DataFrame) -> DataFrame:
    """Adds elements, array<struct<ord, level, marker, element_type, text>>: enumerations first, else semicolon items if
    there are several, else the body as one; a blank body has none."""
    body = F.col("body")
    out = claims.withColumn("marked", enumerated(body))
    # columns of their own: each is worked out once
    out = out.withColumn("pieces", F.when(~F.col("marked") & structured(body), semicolon_pieces(body))).withColumn("words", leading_words(F.col("pieces")))
    out = out.withColumn("items", semicolon_items(F.col("pieces"), F.col("words")))
    single = F.array(_element(F.lit(0), F.lit(1), _kind(strip(body)), strip(body)))
    several = F.coalesce(F.size("items") > 1, F.lit(False))
    elements = (
        F.when(body.isNull() | (strip(body) == ""), F.array().cast(f"array<{ELEMENT}>"))
        .when(F.col("marked"), enumeration_items(body))
        .when(several, nested_items(F.col("items")))
        .otherwise(single)
    )
    return out.withColumn("elements", elements).drop("items", "marked", "pieces", "words")


def parse_split(split: DataFrame) -> DataFrame:
    """Split claims to parsed claims, with all of the columns above."""
    out = with_elements(with_header(with_transition(with_dependencies(split))))
    return out.withColumn("claim_type", F.when(F.col("is_independent"), "INDEPENDENT").otherwise("DEPENDENT"))


def parse_claims(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Normalized documents to parsed claims, one row each."""
    return parse_split(split_claims(docs, keys, text))


def elements_of(claims: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per element, path being its place in the claim's flat list."""
    # the outer form: for the plain one the optimizer would test the array's size first, and so build it once more
    fields = ("ord", "level", "marker", "element_type", "text")
    rows = F.transform("elements", lambda e, i: F.struct(i.alias("path"), *(e[f].alias(f) for f in fields)))
    return claims.select(*keys, "claim_pos", "number", F.inline_outer(rows)).where("path is not null")


def dependencies_of(claims: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per parent: the keys, child, parent, parent_exists. Claims are read once: each becomes a row for its own number and one for each of
    its parents, and a window over rows of one document and number tells whether there is such a claim."""
    own = F.array(F.struct(F.lit(None).cast("bigint").alias("child"), F.col("number").alias("parent"), F.lit(True).alias("known")))
    above = F.transform("parent_claims", lambda p: F.struct(F.col("number").alias("child"), p.alias("parent"), F.lit(False).alias("known")))
    # the outer form: for the plain one the optimizer would test the array's size first, and so look for the parents twice
    rows = claims.select(*keys, F.inline_outer(F.concat(own, F.coalesce(above, F.slice(own, 1, 0)))))
    exists = F.max("known").over(Window.partitionBy(*keys, "parent"))
    for key in keys:  # rows without a key are of no one document
        exists = exists & F.col(key).isNotNull()
    return rows.withColumn("parent_exists", exists).where("not known and parent is not null").select(*keys, "child", "parent", "parent_exists")


def claim_tree(claims: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each parent's direct children in ascending order, existing parent or not."""
    edges = claims.where("parent_claim is not null").select(*keys, F.col("parent_claim").alias("parent"), "number")
    return edges.groupBy(*keys, "parent").agg(F.array_sort(F.collect_list("number")).alias("children"))


def ancestry(claims: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each claim's depth (0 without a parent in the document) and root over first parents, however long the chain. The first claim
    of a number counts. A chain that comes back to itself has depth and root null.

    Numbers and parents are matched in one window within the document; then every claim's jump to an ancestor is doubled in
    arrays of the document's own row, in as many rounds as its number of claims has binary digits. One shuffle, no join.
    """
    firsts = claims.where("number is not null").groupBy(*keys, "number").agg(F.min_by("parent_claim", "claim_pos").alias("parent"))
    placed = firsts.repartition(*keys).withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("number")))
    own = F.struct(F.col("number").alias("x"), F.col("i").alias("i"), F.lit(None).cast("int").alias("of"))
    above = F.struct(F.col("parent").alias("x"), F.lit(None).cast("int").alias("i"), F.col("i").alias("of"))
    both = placed.select(*keys, "number", F.inline(F.array(own, above)))
    found = both.withColumn("up", F.when(F.col("x").isNotNull(), F.max("i").over(Window.partitionBy(*keys, "x")))).where("of is not null")
    listed = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("of", "number", "up"))).alias("all"))

    def doubled(state: Column, _: Column) -> Column:
        jump, n = state["jump"], state["n"]
        return F.struct(F.transform(jump, lambda j: F.get(jump, j - 1)).alias("jump"), F.zip_with(n, jump, lambda d, j: d + F.get(n, j - 1)).alias("n"))

    start = F.struct(F.transform("all", lambda x: F.coalesce(x["up"], x["of"])).alias("jump"), F.transform("all", lambda x: F.when(x["up"].isNull(), 0).otherwise(1).cast("bigint")).alias("n"))
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size("all") + 1)).cast("int"))
    ended = listed.withColumn("end", F.aggregate(rounds, start, doubled))
    rows = ended.select(*keys, "all", F.inline(F.arrays_zip(F.col("all").alias("claim"), F.col("end.jump").alias("root"), F.col("end.n").alias("n"))))
    rows = rows.withColumn("top", F.get(F.col("all"), F.col("root") - 1))
    stops = F.col("top.up").isNull()
    return rows.select(*keys, "claim.number", F.when(stops, F.col("n")).alias("depth"), F.when(stops, F.col("top.number")).alias("root"))
