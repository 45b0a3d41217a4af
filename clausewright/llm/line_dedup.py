"""Line dedup with a log-template tree, in DataFrame functions only (operator 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.skew import joined
from clausewright.llm.staging import staged

#: Leading tokens that choose a line's leaf, after the number of its tokens.
DEPTH = 3
#: Distinct texts in which a template must occur to count as recurring.
LEAST_TEXTS = 5
#: Tenths of a template's tokens that must be fixed.
FIXED_TENTHS = 7
FIELD = "<*>"
#: Leaves that are sent to all tasks at most (8 bytes each); more are joined by a shuffle.
BROADCAST_LEAVES = 100_000
_BLANKS = "[ \\t\\r\\f\\x0B]"
_NOT_BLANK = "[^ \\t\\r\\f\\x0B]"


def _spaced(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, f"{_BLANKS}+", " "))


def _tokens(spelled: Column) -> Column:
    return F.length(spelled) - F.length(F.replace(spelled, F.lit(" "), F.lit(""))) + 1


def _enough_fixed(spelled: Column, tokens: Column) -> Column:
    fields = F.size(F.filter(F.split(spelled, " "), lambda t: t == FIELD))
    return (tokens - fields) * 10 >= tokens * FIXED_TENTHS


def _lines(docs: DataFrame) -> DataFrame:
    """Each line with tokens: doc_id, text_key, line (from 0), spelled, shape, leaf.

    spelled has the line's tokens with a space between; a token with a digit is a variable field, but in a line with too few other
    tokens to be a template, which stays as it is and is alone in its leaf. Most lines have neither digits nor odd blanks and are
    spelled as they stand. The outer form of explode: for the plain one the optimizer would split the text once more to test the array's size."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")  # hashed once, not for each line
    rows = keyed.select("doc_id", "text_key", F.posexplode_outer(F.split("text", "\n")).alias("line", "words"))
    words = F.col("words")
    rows = rows.where(words.rlike(_NOT_BLANK))
    uneven = words.rlike("[0-9\\t\\r\\f\\x0B]") | words.contains("  ") | words.startswith(" ") | words.endswith(" ") | words.contains(FIELD)
    rows = rows.withColumn("masked", F.when(uneven, _spaced(F.regexp_replace(words, f"{_NOT_BLANK}*[0-9]{_NOT_BLANK}*", FIELD))))
    rows = rows.withColumn("fixed", F.when(F.col("masked").isNotNull(), _enough_fixed(F.col("masked"), _tokens(F.col("masked")))).otherwise(True))
    rows = rows.withColumn("spelled", F.when(F.col("masked").isNull(), words).when(F.col("fixed"), F.col("masked")).otherwise(_spaced(words)))
    leaf = F.when(F.col("fixed"), F.xxhash64(_tokens(F.col("spelled")), F.substring_index("spelled", " ", DEPTH))).otherwise(F.xxhash64(F.lit("as it is"), "spelled"))
    return rows.select("doc_id", "text_key", "line", "spelled", F.xxhash64("spelled").alias("shape"), leaf.alias("leaf"))


def recurring_lines(docs: DataFrame, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """The lines to drop: doc_id, text_key and lines (array of line numbers), one row per distinct document that has any."""
    spelled_lines = _lines(docs)
    lines = staged(spelled_lines.select("doc_id", "text_key", "line", "shape", "leaf"), "lines")
    in_text = lines.groupBy("shape", "text_key").agg(F.first("leaf").alias("leaf"), F.count("*").alias("n"))
    shapes = staged(in_text.groupBy("shape").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.first("leaf").alias("leaf")), "shapes")

    # leaves in which several shapes might be one template: only there tokens are looked at by position
    wide = shapes.groupBy("leaf").agg(F.sum("texts").alias("all"), F.sum("n").alias("n"), F.count("*").alias("kinds")).where((F.col("all") >= least_texts) & (F.col("kinds") > 1))
    wide = staged(wide, "leaves")
    spelled = spelled_lines.select("shape", "leaf", "spelled")
    if wide.count() <= BROADCAST_LEAVES:
        spelled = spelled.join(F.broadcast(wide.select("leaf")), "leaf", "left_semi")
    else:
        spelled = joined(spelled, wide.select("leaf", "n"), "leaf", "n")
    spelled = spelled.groupBy("shape").agg(F.first("spelled").alias("spelled")).select("shape", F.split("spelled", " ").alias("tokens"))
    spelled = staged(spelled.join(joined(shapes.select("shape", "texts", "leaf"), wide.select("leaf", "all", "kinds"), "leaf", "kinds"), "shape"), "spelled")
    by_place = spelled.select("leaf", "texts", "all", F.posexplode_outer("tokens").alias("at", "token"))
    by_place = by_place.groupBy("leaf", "at", "token").agg(F.sum("texts").alias("c"), F.first("all").alias("all"))
    modal = by_place.groupBy("leaf", "at").agg(F.min(F.struct((-F.col("c")).alias("c"), F.col("token"))).alias("m"), F.first("all").alias("all"))
    modal = modal.select("leaf", "at", F.when((F.col("m.c") * -2 >= F.col("all")) & (F.col("m.token") != FIELD), F.col("m.token")).alias("token"))
    templates = modal.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("template"))
    fixed = F.size(F.filter("template", lambda t: t.isNotNull()))
    templates = templates.where(fixed * 10 >= F.size("template") * FIXED_TENTHS)
    fits = F.forall(F.zip_with("tokens", "template", lambda t, m: m.isNull() | (t == m)), lambda x: x)
    templates = staged(templates.join(wide.select("leaf", "kinds"), "leaf"), "leaf-templates")
    fitting = staged(joined(spelled, templates, "leaf", "kinds").where(fits).select("shape", "leaf"), "fitting")
    # texts of a template: distinct over its shapes
    sized = fitting.join(shapes.select("shape", "n"), "shape")
    of_text = joined(lines.select("shape", "text_key"), sized, "shape", "n").select("leaf", "text_key").distinct().groupBy("leaf").count()
    general = fitting.join(of_text.where(F.col("count") >= least_texts).select("leaf"), "leaf").select("shape", F.lit(True).alias("general"))

    groups = shapes.join(general, "shape", "left").where(F.col("general") | (F.col("texts") >= least_texts))
    groups = staged(groups.select("shape", F.when(F.col("general"), F.col("leaf")).otherwise(F.col("shape")).alias("template"), "n"), "templates")
    found = staged(joined(lines.select("doc_id", "text_key", "line", "shape"), groups, "shape", "n").select("doc_id", "text_key", "line", "template"), "recurring")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("text_key"), F.col("line"))
    first = found.groupBy("template").agg(F.min(place).alias("kept")).select("kept.doc_id", "kept.text_key", "kept.line")
    # by their places, which no two templates share, and not by template
    same = found["text_key"].eqNullSafe(first["text_key"]) & found["doc_id"].eqNullSafe(first["doc_id"]) & (found["line"] == first["line"])
    return found.join(first, same, "left_anti").groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("lines"))


def _unused(name: str, docs: DataFrame) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_recurring_lines(docs: DataFrame, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) with the recurring lines taken out of ``text``, and the added columns
    line_count and lines_dropped.

    A line's tokens stand between blanks; tokens with a digit are variable fields, unless fewer than seven tenths of the line's tokens
    would be fixed: rows of numbers that differ are no template, and such a line recurs only as it is. The tree sends a line to a leaf by
    the number of its tokens and its first DEPTH tokens. A template is a leaf's most frequent tokens, position by
    position, a token that fewer than half of the leaf's lines have being a field too (if so many are that less than
    seven tenths are fixed, the leaf has no template); or, for lines that don't fit their leaf's template, the line as it is with
    its fields. A template that occurs in ``least_texts`` distinct texts or more recurs: of its lines only the very first, by doc_id and
    place, stays. So copies of one text, however many, don't make its lines recur, and no content is lost altogether.

    Lines are counted by 64-bit hashes with aggregation before each shuffle, and joined to what is frequent by sending that to
    them, so that neither a line that a third of the documents hold nor a leaf meets in one task; texts are shuffled
    once, to the lines they lose.

    Null texts stay null with counts of 0; empty lines are kept and belong to no template; a null doc_id comes after all
    others; rows with equal doc_id and text are treated alike (where the first line stays, it stays in all of them). An empty table gives
    an empty one. Columns of ``docs`` named line_count or lines_dropped are replaced; all others pass unchanged.
    """
    kept = [c for c in docs.columns if c not in ("line_count", "lines_dropped")]
    key, of, marks = (_unused(c, docs) for c in ("lost_key", "lost_id", "lost_marks"))
    lost = recurring_lines(docs.select("doc_id", "text"), least_texts)
    # a byte for each line up to the last lost one, 1 for those that are lost: found by place, however many there are
    in_order = F.array_sort("lines")
    before = F.concat(F.array(F.lit(-1)), F.slice(in_order, F.lit(1), F.size("lines") - 1))
    marked = F.array_join(F.zip_with(in_order, before, lambda x, b: F.concat(F.repeat(F.lit("0"), x - b - 1), F.lit("1"))), "")
    lost = lost.select(F.col("doc_id").alias(of), F.col("text_key").alias(key), marked.cast("binary").alias(marks))
    same = docs["doc_id"].eqNullSafe(F.col(of)) & (F.xxhash64(docs["text"]) == F.col(key))
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda x, i: F.substring(F.col(marks), i + 1, 1) != F.lit(b"1"))
    both = docs.join(lost, same, "left")
    return both.select(
        *(F.when(F.col(marks).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text") if c == "text" else docs[c] for c in kept),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("line_count"),
        F.when(F.col(marks).isNull(), 0).otherwise(F.length(F.replace(F.col(marks).cast("string"), F.lit("0"), F.lit("")))).cast("long").alias("lines_dropped"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_recurring_lines(docs).select("doc_id", "line_count", "lines_dropped", F.length("text").cast("long").alias("chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLES = {
    "op5_line_dedup": r"""
WITH l0 AS (
  SELECT doc_id, text, i - 1 AS line, list_filter(regexp_split_to_array(regexp_replace(w, '[^ \t\r\f\v]*[0-9][^ \t\r\f\v]*', '<*>', 'g'), '[ \t\r\f\v]+'), lambda t: t <> '') AS masked,
         list_filter(regexp_split_to_array(w, '[ \t\r\f\v]+'), lambda t: t <> '') AS plain
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS w, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
l1 AS (SELECT *, 10 * len(list_filter(masked, lambda t: t <> '<*>')) >= 7 * len(masked) AS fixed FROM l0),
l AS (SELECT doc_id, text, line, fixed, CASE WHEN fixed THEN masked ELSE plain END AS tokens FROM l1),
k AS (SELECT doc_id, text, line, tokens, array_to_string(tokens, ' ') AS shape, CASE WHEN fixed THEN array_to_string([len(tokens)::VARCHAR] || tokens[1:3], ' ') ELSE 'as it is ' || array_to_string(tokens, ' ') END AS leaf FROM l WHERE len(tokens) > 0),
it AS (SELECT shape, leaf, text, any_value(tokens) AS tokens FROM k GROUP BY shape, leaf, text),
s AS (SELECT shape, leaf, any_value(tokens) AS tokens, count(*) AS texts FROM it GROUP BY shape, leaf),
w AS (SELECT leaf, sum(texts) AS total FROM s GROUP BY leaf HAVING sum(texts) >= 5 AND count(*) > 1),
t AS (SELECT s.leaf, texts, total, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS place FROM s JOIN w ON w.leaf = s.leaf),
c AS (SELECT leaf, place, token, total, sum(texts) AS c FROM t GROUP BY leaf, place, token, total),
m AS (SELECT leaf, place, CASE WHEN 2 * c >= total AND token <> '<*>' THEN token END AS token
      FROM (SELECT *, row_number() OVER (PARTITION BY leaf, place ORDER BY c DESC, token) AS r FROM c) WHERE r = 1),
good AS (SELECT leaf FROM m GROUP BY leaf HAVING 10 * count(token) >= 7 * count(*)),
bad AS (SELECT DISTINCT x.leaf, x.shape FROM (SELECT leaf, shape, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS place FROM s) x JOIN m ON m.leaf = x.leaf AND m.place = x.place AND m.token IS NOT NULL AND m.token <> x.token),
fit AS (SELECT s.shape, s.leaf FROM s JOIN good ON good.leaf = s.leaf WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.leaf = s.leaf AND bad.shape = s.shape)),
gen AS (SELECT fit.leaf FROM fit JOIN it ON it.shape = fit.shape AND it.leaf = fit.leaf GROUP BY fit.leaf HAVING count(DISTINCT it.text) >= 5),
g AS (SELECT s.shape, s.leaf, CASE WHEN gen.leaf IS NOT NULL THEN 'leaf ' || s.leaf ELSE 'shape ' || s.shape END AS template
      FROM s LEFT JOIN fit ON fit.shape = s.shape AND fit.leaf = s.leaf LEFT JOIN gen ON gen.leaf = fit.leaf WHERE gen.leaf IS NOT NULL OR s.texts >= 5),
r AS (SELECT k.doc_id, k.line, row_number() OVER (PARTITION BY g.template ORDER BY k.doc_id, k.line) AS nth FROM k JOIN g ON g.shape = k.shape AND g.leaf = k.leaf),
d AS (SELECT doc_id, line FROM r WHERE nth > 1),
x AS (SELECT doc_id, list(line) AS lines FROM d GROUP BY doc_id),
o AS (SELECT documents.doc_id, text, string_split(text, chr(10)) AS ls, coalesce(lines, []) AS lost FROM documents LEFT JOIN x ON x.doc_id = documents.doc_id),
f AS (SELECT doc_id, ls, lost, CASE WHEN len(lost) = 0 THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(lost, i - 1)), lambda i: ls[i]), chr(10)) END AS kept FROM o)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS line_count, len(lost)::BIGINT AS lines_dropped, length(kept)::BIGINT AS chars_left, md5(kept) AS text_md5 FROM f
""",
}
