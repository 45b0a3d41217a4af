"""The text path against stated results."""

import random
import time

import pytest
from pyspark.sql import functions as F

from clausewright.functions.text import strip
from clausewright.operators import claims as C
from clausewright.operators import quality as Q
from clausewright.operators import render as R
from clausewright.operators.normalize import normalize
from clausewright.plans import parse as P

B, E, W = "BODY_ELEMENT", "ENUMERATION", "WHEREIN_CLAUSE"
# Stated inputs, their results and messages, here and below.
OCR_SAMPLE = """
    US Patent No. 12,345,678
    Page 14 of 40

    What is claimed is:

    1. A method cornprising:
    (a) receiving a request;
    (b) processing the request; and
    (c) sending a response.

    2. The method of claim 1, whereln the request is processed by a server.

    3. A system comprising:
    a processor;
    a memory; and
    a display.

    4. The system of claims 2-3, further comprising a network interface.
"""


def parse(spark, text, normalized=False):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return C.parse_claims(docs if normalized else normalize(docs)).orderBy("claim_pos").cache()


def elements(row):
    return [(e.ord, e.level, e.marker, e.element_type, e.text) for e in row.elements]


def confidence(claims):
    return Q.document_scores(claims).first().confidence


def test_ocr_sample(spark):
    docs = spark.createDataFrame([(1, OCR_SAMPLE)], "doc_id long, text string")
    assert normalize(docs).first().ops == ["page_artifacts_removed", "whitespace_cleaned", "ocr_cleanup_applied"]
    got = parse(spark, OCR_SAMPLE)
    rows = got.collect()
    assert [(r.number, r.claim_type, r.parent_claim, r.parent_claims, r.category, r.header) for r in rows] == [
        (1, "INDEPENDENT", None, [], "method", "A method comprising:"),
        (2, "DEPENDENT", 1, [1], "method", "The method of claim 1, wherein the request is processed by a server."),
        (3, "INDEPENDENT", None, [], "system", "A system comprising:"),
        (4, "DEPENDENT", 2, [2, 3], "system", "The system of claims 2-3, further comprising a network interface."),
    ]
    assert elements(rows[0]) == [(0, 1, "(a)", E, "receiving a request;"), (1, 1, "(b)", E, "processing the request; and"), (2, 1, "(c)", E, "sending a response.")]
    assert elements(rows[1]) == elements(rows[3]) == []
    assert elements(rows[2]) == [(0, 1, None, B, "a processor;"), (1, 1, None, B, "a memory; and"), (2, 1, None, B, "a display.")]
    assert confidence(got) == 95.0


CASES = {
    "What is claimed is:\n1. A method comprising receiving data; processing data; and sending data.\n": (100.0, [("A method comprising", None, [(0, 1, None, B, "receiving data;"), (1, 1, None, B, "processing data; and"), (2, 1, None, B, "sending data.")])]),
    "What is claimed is:\n1. A system comprising a processor.\n": (90.0, [("A system comprising a processor.", None, [])]),
    "What is claimed is:\n1. A system comprising a processor; and a memory.\n": (100.0, [("A system comprising", None, [(0, 1, None, B, "a processor; and"), (1, 1, None, B, "a memory.")])]),
    "1. A dummy claim comprising: a test.": (100.0, [("A dummy claim comprising:", None, [(0, 1, None, B, "a test.")])]),
    "this is some garbage that has no claims": (90.0, [("this is some garbage that has no claims", None, [])]),
    "1. A system comprising a processor (10).": (100.0, [("A system comprising", None, [(0, 4, "(10)", E, ".")])]),
    "1. A system (10) having a widget.": (100.0, [("A system", None, [(0, 4, "(10)", E, "having a widget.")])]),
    "1. X of claims 1, 2 and 3.": (90.0, [("X of claims 1, 2 and 3.", None, [])]),
    "1. X of claims 5-2.": (86.0, [("X of claims 5-2.", None, [])]),
    "1. A device comprising: a b; a c including: a d; a e: f; g": (100.0, [("A device comprising:", None, [(0, 1, None, B, "a b;"), (1, 1, None, B, "a c including:"), (1, 2, None, B, "a d;"), (2, 2, None, B, "a e:"), (2, 3, None, B, "f;"), (3, 3, None, B, "g")])]),
    "1. A kit comprising: a (ix) b": (100.0, [("A kit comprising:", None, [(0, 1, None, B, "a (ix) b")])]),
    "1. A system comprising: first a thing; (a) x; (b) y": (100.0, [("A system comprising:", None, [(0, 1, "(a)", E, "x;"), (1, 1, "(b)", E, "y")])]),
    "1. A machine consisting essentially of: a; and": (100.0, [("A machine consisting essentially of:", None, [(0, 1, None, B, "a;"), (1, 1, None, B, "and")])]),
}


@pytest.mark.parametrize("text", CASES)
def test_cases(spark, text):
    score, wanted = CASES[text]
    got = parse(spark, text)
    rows = got.collect()
    assert [(r.header, r.parent_claim, elements(r)) for r in rows] == wanted
    assert confidence(got) == score


def test_references_in_any_order(spark):
    row = parse(spark, "1. A method of claim 3 or claim 2, wherein x; wherein y").first()
    assert (row.parent_claims, row.header) == ([2, 3], "")
    assert elements(row) == [(0, 1, None, B, "A method of claim 3 or claim 2, wherein x;"), (1, 1, None, W, "wherein y")]


def test_not_normalized_text_keeps_its_lines(spark):
    text = "What is claimed is:\n1. A hitch system comprising:\na clevis; and\na pin.\n2. The hitch system of claim 1, wherein the clevis is configured to enable the first\nagricultural implement to rotate."
    rows = parse(spark, text, normalized=True).collect()
    assert rows[1].header.endswith("the first\nagricultural implement to rotate.")
    assert elements(rows[0]) == [(0, 1, None, B, "a clevis; and"), (1, 1, None, B, "a pin.")]


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("What is claimed is:\n1. A method.\n1. A system.", "Duplicate claim number detected: 1"),
        ("What is claimed is:\n1.  \n2. A system.", "Claim 1 has empty body text."),
        ("0. zero", "Invalid claim number: 0"),
        ("1. (a) a thing", "claim begins with its first marker"),
        ("1. X of claims 1-9999999.", "a claim range is too long"),
        ("1. A.\n99999999999999999999. B.", "Invalid claim number: more than 64 bits"),
        ("1. A.\n2. B.\n2. C.\n1. D.", "Duplicate claim number detected: 2"),
    ],
)
def test_errors(spark, text, error):
    assert [r.message for r in Q.claim_errors(parse(spark, text)).collect()] == [error]


def test_no_claims_is_no_error(spark):
    got = parse(spark, "CLAIMS:")
    assert got.count() == 0 and Q.claim_errors(got).count() == 0


def test_gap_in_numbers(spark):
    assert confidence(parse(spark, "1. a\n3. b")) == 86.25


def test_tree_and_ancestry(spark):
    got = parse(spark, "1. A.\n2. The A of claim 1.\n3. The A of claim 2.\n4. B of claim 9.\n5. C of claim 6.\n6. D of claim 5.")
    assert {(r.parent, tuple(r.children)) for r in C.claim_tree(got).collect()} == {(1, (2,)), (2, (3,)), (9, (4,)), (6, (5,)), (5, (6,))}
    assert {(r.number, r.depth, r.root) for r in C.ancestry(got).collect()} == {(1, 0, 1), (2, 1, 1), (3, 2, 1), (4, 0, 4), (5, None, None), (6, None, None)}
    assert {(r.child, r.parent, r.parent_exists) for r in C.dependencies_of(got).collect()} == {(2, 1, True), (3, 2, True), (4, 9, False), (5, 6, True), (6, 5, True)}


def test_rendered_lines(spark):
    got = parse(spark, "1. A method <x> comprising:\n(a) receiving <b>R&D</b> <q>;\n(b) processing.")
    lines = [(r.style, r.left_indent_pt, r.first_line_indent_pt, r.markup) for r in R.rendered(got).orderBy("claim_pos", "line_in_claim").collect()]
    assert lines == [("Title", 0, 0, "What is claimed is:"), ("ClaimRoot", 24, -24, "1. A method &lt;x&gt; comprising:"), ("Level1", 48, -24, "(a) receiving <b>R&amp;D</b> &lt;q&gt;;"), ("Level1", 48, -24, "(b) processing.")]


def test_a_chain_of_any_length_has_its_depth(spark):
    got = parse(spark, "1. A.\n" + "\n".join(f"{i}. The A of claim {i - 1}." for i in range(2, 301)))
    assert {(r.number, r.depth, r.root) for r in C.ancestry(got).collect()} == {(i, i - 1, 1) for i in range(1, 301)}


def test_batch_summary(spark):
    docs = spark.createDataFrame([(1, "1. A."), (2, "0. B."), (3, "")], "doc_id long, text string")
    documents, watch = Q.observed(P.parse_text(docs).documents)
    assert Q.batch_summary(documents).first().asDict() == {"total_files": 3, "processed": 1, "failed": 2}
    assert watch.get == {"documents": 3, "failed": 2, "claims": 1, "recognized": 0}


def test_a_document_is_read_and_shuffled_once(spark):
    docs = spark.createDataFrame([(1, "1. A.")], "doc_id long, text string")
    for table in (P.parse_text(docs).documents, P.to_json(P.parse_text(docs)), P.parse_uspto(docs.withColumnRenamed("text", "xml")).documents):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan ") == 1 and plan.count("Exchange ") == 1 and "Join" not in plan


#: Fixed value: where a text is cut, as one pattern, whose time grows with the square of the semicolons.
STRUCTURAL = r"(?<=;)(?![^(]*\))"


def test_texts_are_cut_after_structural_semicolons(spark):
    rng, parts = random.Random(1), ["a", "b ", ";", " ; ", "(", ")", "and ", " or ", "\n", ":", "\uffff", "\ufffe", "\ufffe+", "-", "wherein", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", C.structural_pieces(F.col("t")).alias("p"), C.structured(F.col("t")).alias("s"), F.col("t").rlike(STRUCTURAL).alias("any"), F.split("t", STRUCTURAL, -1).alias("q")).collect():
        assert r.p == r.q and bool(r.s) == r["any"]


def test_items_and_levels_of_a_long_claim_take_linear_time(spark):
    def took(n):
        body = "; ".join(f"{'and ' if i % 7 == 1 else ''}part {i}{' including: x' if i % 50 == 0 else ''}" for i in range(n))
        began = time.time()
        got = C.parse_claims(spark.createDataFrame([(1, "1. A thing comprising: " + body)], "doc_id long, text string")).select("elements").first().elements
        assert len(got) == n + n // 50 and [e.level for e in got[:3]] == [1, 2, 2] and got[-1].level == 1 + n // 50
        assert got[0].text == "part 0 including:" and got[2].text == "part 1;"
        return time.time() - began

    took(1000)
    assert took(64_000) < 4 * max(took(16_000), 1.0)


def test_a_conjunction_goes_back_to_the_piece_before(spark):
    rows = spark.createDataFrame([(1, "1. A thing comprising: and a; ; or b; and ; and c; and")], "doc_id long, text string")
    assert [(e.ord, e.text) for e in C.parse_claims(rows).first().elements] == [(0, "and a;"), (1, "; or"), (2, "b; and"), (3, "; and"), (4, "c;"), (5, "and")]


def test_strip_is_that_of_python(spark):
    texts = [f"{chr(c)}{chr(c)} a{chr(c)}b {chr(c)}" for c in range(1, 0x3002) if not 0xD800 <= c <= 0xDFFF] + ["", " ", "\x85"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.s == r.t.strip() for r in frame.select("t", strip(F.col("t")).alias("s")).collect())


def test_dependencies_are_told_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "1. A bar.\n2. The bar of claim 1.\n2. The bar of claims 1-3.\n99999999999999999999. The bar of claim 7."), (2, "3. The pin of claim 1."), (None, "1. A.\n2. The A of claim 1.")], "doc_id long, text string")
    found = C.dependencies_of(C.parse_claims(normalize(docs)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1 and plan.count("Exchange ") == 1 and "Join" not in plan
    assert sorted((r.doc_id or 0, r.child or 0, r.parent, r.parent_exists) for r in found.collect()) == [(0, 2, 1, False), (1, 0, 7, False), (1, 2, 1, True), (1, 2, 1, True), (1, 2, 2, True), (1, 2, 3, False), (2, 3, 1, False)]
