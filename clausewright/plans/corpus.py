"""Claim documents made of the order tables, for queries: one document per order, one claim per line item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KINDS = 8


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos (from 1), number (pos, but l_linenumber in every seventh order, where numbers repeat), k, noun, name, kind."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    items = lines.join(parts, lines.l_partkey == parts.p_partkey).withColumn("pos", F.row_number().over(order).cast("long"))
    number = F.when(F.col("l_orderkey") % 7 == 0, F.col("l_linenumber").cast("long")).otherwise(F.col("pos"))
    noun = F.when(F.col("l_suppkey") % 3 == 0, "system").when(F.col("l_suppkey") % 3 == 1, "method").otherwise("apparatus")
    return items.select(F.col("l_orderkey").alias("doc_id"), "pos", number.alias("number"), ((F.col("l_partkey") + F.col("pos")) % KINDS).alias("k"), noun.alias("noun"), F.col("p_name").alias("name"), F.lower("p_type").alias("kind"))


def _claim(number: Column) -> Column:
    name, kind = F.col("name"), F.col("kind")
    n, before = number.cast("string"), F.greatest(F.col("pos") - 1, F.lit(1)).cast("string")

    def text(*parts: Column | str) -> Column:
        return F.concat(n, F.lit(". "), *(F.lit(p) if isinstance(p, str) else p for p in parts))

    return (
        F.when(F.col("pos") == 1, text("A ", F.col("noun"), " comprising: a ", name, "; a ", kind, " part; and a housing."))
        .when(F.col("k") == 0, text("The system of claim ", before, ", wherein the ", name, " is rigid."))
        .when(F.col("k") == 1, text("The method of claims 1-2, further comprising a ", name, "; and a pin."))
        .when(F.col("k") == 2, text("The device of claims 5-2, having a ", name, "."))
        .when(F.col("k") == 3, text("A process comprising: (a) heating the ", name, "; (b) cooling it; and (c) a rest (ii) of parts."))
        .when(F.col("k") == 4, text("The apparatus as recited in claim 1, wherein the ", name, " turns; wherein it stops"))
        .when(F.col("k") == 5, text("A machine comprising: a ", name, "; a frame including: a ", kind, " bar; and a nut."))
        .when(F.col("k") == 6, text("The system of clalm 1, whereln the\nPage 3\n", name, " is a com-\npound part."))
        .otherwise(text("A composition of ", name, " (12) and water"))
    )


#: Texts of the edge documents, by the remainder of the customer's key; {0} is a word of the customer.
EDGES = [
    "The invention claimed is.\n1. A {0} comprising: a bar; a nut.\n2. The {0} of claim 1.",
    "Filed in May.\n\nWe claim:\n\n1. A {0} consisting of a bar; and a nut.",
    "I claim.\n\n1. A {0} consisting essentially of: a bar; a nut",
    "CLAIMS\n\n1. A {0} including a bar; a nut; and a pin.",
    "claim:\n\n1. A {0} containing a bar (a) red (b) blue",
    "1. (a) a {0}",
    "0. A {0} comprising: x; y",
    "1. \n2. The {0} of claim 1.",
    "1. A {0} of claims 1-9999999.",
    "",
    " \n \t ",
    "",  # a chain of claims, each of the one before
    "1. A {0} of claim 2.\n2. A {0} of claim 1.\n3. The {0} of claim 2.",
    "99999999999999999999. A {0} comprising: x",
    "CLAIMS:",
    "just some {0} prose without any number",
    "1. A {0}.\n2. A {0}.\n3. The {0} of any of claims 1, 2.\n4. The {0} of claims 1, 2, and 3 or claim 9.\n5. The {0} of claims 1-2, 4 and 3 to 4, in part of claims 7 to 6.",
]
CHAIN_AT, CHAIN = 11, 90


def edge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (below 0) and text: one document per customer, for section headers, transitions and errors."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.lower("c_mktsegment").alias("word"))
    kind = F.col("c_custkey") % len(EDGES)
    link = F.transform(F.sequence(F.lit(2), F.lit(CHAIN)), lambda i: F.concat(i.cast("string"), F.lit(". The "), F.col("word"), F.lit(" of claim "), (i - 1).cast("string"), F.lit(".")))
    text = F.when(kind == CHAIN_AT, F.concat(F.lit("1. A "), F.col("word"), F.lit(" comprising: a bar.\n"), F.array_join(link, "\n")))
    for k, words in enumerate(EDGES):
        text = text.when(kind == k, F.replace(F.lit(words), F.lit("{0}"), F.col("word")))
    return rows.select((-1 - F.col("c_custkey")).cast("bigint").alias("doc_id"), text.alias("text"))


def claim_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text: one document per order, those with an even id with a section header; and the edge documents."""
    lines = _items(spark, sf_dir).select("doc_id", "pos", _claim(F.col("number")).alias("line"))
    grouped = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    orders = grouped.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("What is claimed is:\n"), body)).otherwise(body).alias("text"))
    return orders.union(edge_documents(spark, sf_dir))


def patent_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and xml: nested claim texts, references to the claim before, and bibliographic data. By the remainder of the id by
    11: 3 has another root, 4 one claim number for all, 5 no claims, 6 references to a claim 99, 7 no numbers."""
    items = _items(spark, sf_dir)
    kind, n = F.col("doc_id") % 11, F.col("pos").cast("string")
    ident = F.when(kind == 7, "none").otherwise(F.concat(F.lit("CLM-"), F.lpad(F.when(kind == 4, "1").otherwise(n), 5, "0")))
    parent = F.when(kind == 6, "99").otherwise((F.col("pos") - 1).cast("string"))
    first = F.concat(F.lit("<b>"), n, F.lit("</b>. A "), F.col("noun"), F.lit(" &#x2014; comprising:<claim-text>a "), "name", F.lit(" &#8805; &#x31; &amp;lt;;<claim-text>(a) of <i>two</i> "), "kind", F.lit(" parts &lt; 3,</claim-text> and more</claim-text> <claim-text>a pin wherein it turns.</claim-text>"))
    later = F.concat(n, F.lit('. The system of <claim-ref idref="CLM-'), F.lpad(parent, 5, "0"), F.lit('">claim '), parent, F.lit("</claim-ref>, having a "), "name", F.lit(" of &#x201c;type&#x201d;."))
    claim = F.concat(F.lit('<claim id="'), ident, F.lit('"><claim-text>'), F.when(F.col("pos") % 3 == 1, first).otherwise(later), F.lit("</claim-text></claim>"))
    grouped = items.select("doc_id", "pos", claim.alias("claim")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "claim"))).alias("all"))
    key, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 11
    root = F.when(kind == 3, "doc").otherwise('us-patent-grant lang="EN" country="US"')
    head = F.concat(F.lit('<?xml version="1.0"?><'), root, F.lit("><publication-reference><document-id><country>US</country><doc-number>"), F.lpad(key, 8, "0"), F.lit("</doc-number><kind>B2</kind><date>20240102</date></document-id></publication-reference>"))
    applied = F.when(kind == 3, F.concat(F.lit("<application-reference><document-id><country>EP</country><doc-number>77"), key, F.lit("</doc-number><date>20230405</date></document-id></application-reference>"))).otherwise("")
    title = F.concat(F.lit("<invention-title>Order &#x201c;"), key, F.lit("&#8221; &amp;amp; &lt; part</invention-title>"))
    claims = F.when(kind == 5, "").otherwise(F.concat(F.lit("<claims>\n"), F.array_join(F.transform("all", lambda x: x["claim"]), "\n"), F.lit("</claims>")))
    return grouped.select("doc_id", F.concat(head, applied, title, claims, F.lit("</"), F.substring_index(root, " ", 1), F.lit(">")).alias("xml"))


def paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text: a page per line item of an order, with running lines. All pages but the first have a header, those at even places
    one more; footers differ between even and odd places. Lines in between are other ones on each page."""
    items = _items(spark, sf_dir)
    at, letter = F.col("pos").cast("string"), F.char(F.col("pos") + 96)
    even = F.col("pos") % 2 == 0
    body = F.concat(F.lit("part "), letter, F.lit(" opens\n"), _claim(F.col("number")), F.lit("\nSheet 9 of 9\n\npart "), letter, F.lit(" closes"))
    head = F.concat(F.when(F.col("pos") > 1, F.concat(F.lit("US 12,"), F.col("doc_id").cast("string"), F.lit(" B2\n"))).otherwise(""), F.when(even, F.concat(F.lit("\n Sheet "), at, F.lit("  of 9\n"))).otherwise(""))
    foot = F.when(even, F.concat(F.lit("\n\nPAGE "), at, F.lit("\n"))).otherwise(F.concat(F.lit("\n- "), at, F.lit(" -")))
    grouped = items.select("doc_id", "pos", F.concat(head, body, foot).alias("page")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "page"))).alias("all"))
    return grouped.select("doc_id", F.array_join(F.transform("all", lambda x: x["page"]), "\f").alias("text"))


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and html: each fourth page is XML with claim tags instead."""
    key = F.col("page_id").cast("string")
    marked = F.concat(F.lit('<doc><claims><claim id="1"><claim-text>1. A page &#x201c;'), key, F.lit("&#8221; &amp;lt; shown</claim-text> <claim-text>tiny</claim-text></claim></claims><cl-claim>another claim of page "), key, F.lit("</cl-claim><p>left out</p></doc>"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.when(F.col("page_id") % 4 == 1, marked).otherwise(F.col("html")).alias("html"))


ITEMS_SQL = """
items AS (
  SELECT doc_id, pos, CASE WHEN doc_id % 7 = 0 THEN line ELSE pos END AS number, (l_partkey + pos) % 8 AS k, CASE l_suppkey % 3 WHEN 0 THEN 'system' WHEN 1 THEN 'method' ELSE 'apparatus' END AS noun, name, kind
  FROM (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice)::BIGINT AS pos,
               l_linenumber::BIGINT AS line, l_partkey, l_suppkey, p_name AS name, lower(p_type) AS kind
        FROM lineitem JOIN part ON p_partkey = l_partkey))"""

DOCUMENTS_SQL = (
    ITEMS_SQL
    + """,
written AS (
  SELECT doc_id, pos, number || '. ' || CASE
    WHEN pos = 1 THEN 'A ' || noun || ' comprising: a ' || name || '; a ' || kind || ' part; and a housing.'
    WHEN k = 0 THEN 'The system of claim ' || greatest(pos - 1, 1) || ', wherein the ' || name || ' is rigid.'
    WHEN k = 1 THEN 'The method of claims 1-2, further comprising a ' || name || '; and a pin.'
    WHEN k = 2 THEN 'The device of claims 5-2, having a ' || name || '.'
    WHEN k = 3 THEN 'A process comprising: (a) heating the ' || name || '; (b) cooling it; and (c) a rest (ii) of parts.'
    WHEN k = 4 THEN 'The apparatus as recited in claim 1, wherein the ' || name || ' turns; wherein it stops'
    WHEN k = 5 THEN 'A machine comprising: a ' || name || '; a frame including: a ' || kind || ' bar; and a nut.'
    WHEN k = 6 THEN 'The system of clalm 1, whereln the' || chr(10) || 'Page 3' || chr(10) || name || ' is a com-' || chr(10) || 'pound part.'
    ELSE 'A composition of ' || name || ' (12) and water' END AS line FROM items),
docs AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'What is claimed is:' || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY pos) AS text FROM written GROUP BY doc_id
  UNION ALL SELECT -1 - c_custkey, CASE c_custkey % """
    + str(len(EDGES))
    + f" WHEN {CHAIN_AT} THEN '1. A ' || lower(c_mktsegment) || ' comprising: a bar.' || list_aggregate(list_transform(range(2, {CHAIN + 1}), lambda i: chr(10) || i || '. The ' || lower(c_mktsegment) || ' of claim ' || (i - 1) || '.'), 'string_agg', '')"
    + "".join(" WHEN {} THEN replace('{}', '{{0}}', lower(c_mktsegment))".format(k, text.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '")) for k, text in enumerate(EDGES) if k != CHAIN_AT)
    + """ END FROM customer)"""
)

#: The paged documents without their running lines, made without them.
PAGED_SQL = (
    "\nWITH "
    + DOCUMENTS_SQL.lstrip().split("docs AS (", maxsplit=1)[0]
    + """
n AS (SELECT w.*, count(*) OVER (PARTITION BY doc_id) AS pages FROM written w),
f AS (SELECT *, pages - 1 >= greatest(3, ceil(pages * 0.4)) AS no_head, pages // 2 >= greatest(3, ceil(pages * 0.4)) AS no_even, (pages + 1) // 2 >= greatest(3, ceil(pages * 0.4)) AS no_odd FROM n)
SELECT doc_id, any_value(pages)::BIGINT AS n_pages, any_value(no_head::INT + 2 * no_even::INT + no_odd::INT)::BIGINT AS n_running, md5(string_agg(
  CASE WHEN pos > 1 AND NOT no_head THEN 'US 12,' || doc_id || ' B2' || chr(10) ELSE '' END || CASE WHEN pos % 2 = 0 THEN chr(10) || CASE WHEN no_even THEN '' ELSE ' Sheet ' || pos || '  of 9' || chr(10) END ELSE '' END
  || 'part ' || chr((96 + pos)::INT) || ' opens' || chr(10) || line || chr(10) || 'Sheet 9 of 9' || chr(10) || chr(10) || 'part ' || chr((96 + pos)::INT) || ' closes'
  || CASE WHEN pos % 2 = 0 THEN chr(10) || CASE WHEN no_even THEN '' ELSE chr(10) || 'PAGE ' || pos END || chr(10) WHEN no_odd THEN '' ELSE chr(10) || '- ' || pos || ' -' END, chr(12) ORDER BY pos)) AS text_md5 FROM f GROUP BY doc_id"""
)

PATENTS_SQL = (
    "\nWITH "
    + ITEMS_SQL.lstrip()
    + """,
p AS (SELECT *, CASE WHEN doc_id % 11 = 6 THEN 99 ELSE pos - 1 END AS parent, CASE doc_id % 11 WHEN 4 THEN 1 WHEN 7 THEN 0 ELSE pos END AS number_given, CASE WHEN doc_id % 11 = 7 THEN 'none' ELSE 'CLM-' || lpad((CASE WHEN doc_id % 11 = 4 THEN 1 ELSE pos END)::VARCHAR, 5, '0') END AS ident FROM items WHERE doc_id % 11 <> 5),
h AS (SELECT *, CASE WHEN pos % 3 = 1 THEN 'A ' || noun || ' ' || chr(8212) || ' comprising:' ELSE 'The system of claim ' || parent || ', having a ' || name || ' of ' || chr(8220) || 'type' || chr(8221) || '.' END AS header,
  '<claim id="' || ident || '"><claim-text>' || CASE WHEN pos % 3 = 1 THEN '<b>' || pos || '</b>. A ' || noun || ' &#x2014; comprising:<claim-text>a ' || name || ' &#8805; &#x31; &amp;lt;;<claim-text>(a) of <i>two</i> ' || kind || ' parts &lt; 3,</claim-text> and more</claim-text> <claim-text>a pin wherein it turns.</claim-text>'
    ELSE pos || '. The system of <claim-ref idref="CLM-' || lpad(parent::VARCHAR, 5, '0') || '">claim ' || parent || '</claim-ref>, having a ' || name || ' of &#x201c;type&#x201d;.' END || '</claim-text></claim>' AS raw FROM p),
x AS (SELECT doc_id, pos, 0 AS path, 1 AS level, NULL::VARCHAR AS marker, 'BODY_ELEMENT' AS element_type, 'a ' || name || ' ' || chr(8805) || ' 1 &lt;; and more' AS text FROM p WHERE pos % 3 = 1
  UNION ALL SELECT doc_id, pos, 1, 2, '(a)', 'ENUMERATION', '(a) of <i>two</i> ' || kind || ' parts < 3,' FROM p WHERE pos % 3 = 1
  UNION ALL SELECT doc_id, pos, 2, 1, NULL, 'WHEREIN_CLAUSE', 'a pin wherein it turns.' FROM p WHERE pos % 3 = 1)"""
)

#: The elements of the patents' claims as nested intervals, from their text.
TREE_SQL = """,
m1 AS (SELECT doc_id, pos AS claim_pos, unnest(regexp_extract_all(raw, '</?claim-text>')) AS tag, generate_subscripts(regexp_extract_all(raw, '</?claim-text>'), 1) AS i FROM h),
m2 AS (SELECT *, tag = '<claim-text>' AS opening, count(*) FILTER (tag = '<claim-text>') OVER o AS first, (count(*) FILTER (tag = '<claim-text>') OVER o) - (count(*) FILTER (tag <> '<claim-text>') OVER o) + (tag <> '<claim-text>')::INT AS depth FROM m1 WINDOW o AS (PARTITION BY doc_id, claim_pos ORDER BY i)),
m3 AS (SELECT *, lead(first) OVER (PARTITION BY doc_id, claim_pos, depth ORDER BY i) AS last FROM m2),
m4 AS (SELECT a.doc_id, a.claim_pos, a.first, a.last, a.depth, max(b.first) AS parent FROM m3 a LEFT JOIN m3 b ON b.doc_id = a.doc_id AND b.claim_pos = a.claim_pos AND b.opening AND b.depth = a.depth - 1 AND b.first < a.first WHERE a.opening GROUP BY ALL),
tree AS (SELECT *, row_number() OVER (PARTITION BY doc_id, claim_pos, parent ORDER BY first) AS ordinal, count(*) OVER (PARTITION BY doc_id, claim_pos) AS size FROM m4)"""
