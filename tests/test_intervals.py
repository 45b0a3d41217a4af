"""Nested intervals of element trees, and the join of intervals and points, against brute force."""

import random
from xml.etree import ElementTree

from pyspark.sql import functions as F

from clausewright.operators import markup as M
from clausewright.operators.intervals import blocks, in_intervals


def test_blocks_make_up_the_interval(spark):
    pairs = [(a, b) for a in range(0, 24) for b in range(-1, 40)] + [(0, 2**40), (123_456_789, 987_654_321_012), (None, 3), (3, None), (-2, 5)]
    rows = spark.createDataFrame(pairs, "a long, b long")
    for r in rows.select("a", "b", blocks(F.col("a"), F.col("b")).alias("x")).collect():
        if r.a is None or r.b is None or r.a < 0 or r.b < r.a:
            assert r.x == []
            continue
        spans = sorted((x.block << x.level, (x.block + 1 << x.level) - 1) for x in r.x)
        assert (spans[0][0], spans[-1][1]) == (r.a, r.b) and all(p[1] + 1 == q[0] for p, q in zip(spans, spans[1:], strict=False))
        assert len(spans) <= 2 * (r.b - r.a + 1).bit_length()


def test_each_pair_comes_once(spark):
    rng = random.Random(6)
    intervals = [(rng.randint(0, 2), k, a := rng.randint(0, 300), a + rng.randint(-2, 250)) for k in range(120)] + [(0, 900, 0, 600)]
    points = [(rng.randint(0, 2), k, rng.randint(0, 600)) for k in range(200)] + [(None, 900, 5), (1, 901, None)]
    left = spark.createDataFrame(intervals, "g int, i int, b int, e int")
    right = spark.createDataFrame([(*p, 601) for p in points], "g int, p int, at int, size int")
    found = [(r.i, r.p) for r in in_intervals(left, right, ("g",), F.col("b"), F.col("e"), F.col("at"), F.col("size")).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(i, p) for g, i, b, e in intervals for h, p, at in points if at is not None and g == h and b <= at <= e}
    plan = in_intervals(left, right, ("g",), F.col("b"), F.col("e"), F.col("at"), F.col("size"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def grown(rng, depth):
    inner = "".join(rng.choice(["x", " <b>y</b> ", "<!-- <claim-text> -->", *([grown(rng, depth - 1)] * 3 if depth else [])]) for _ in range(rng.randint(0, 4)))
    return f"<claim-text{rng.choice(['', ' id=\"k\"'])}>{inner}</claim-text>"


def walked(claim):
    """(first, last, depth, parent, ordinal, path) of each claim-text, by a walk over the parsed tree."""
    out, count = [], 0

    def walk(node, depth, parent, path):
        nonlocal count
        for k, child in enumerate([c for c in node if c.tag == "claim-text"], 1):
            count += 1
            first, at = count, len(out)
            out.append(None)
            walk(child, depth + 1, first, [*path, k])
            out[at] = (first, count, depth, parent, k, [*path, k])

    walk(claim, 1, None, [])
    return out


def test_trees_are_those_of_a_walk(spark):
    rng = random.Random(8)
    docs, wanted, below = [], [], set()
    for doc in range(60):
        claims = [f'<claim id="{k}">{"".join(grown(rng, 4) for _ in range(rng.randint(1, 3)))}</claim>' for k in range(rng.randint(1, 3))]
        xml = f"<r><claims>{''.join(claims)}</claims></r>"
        docs.append((doc, xml, 7))
        for pos, claim in enumerate(ElementTree.fromstring(xml).iter("claim"), 1):
            found = walked(claim)
            wanted += [(doc, pos, *row, len(found)) for row in found]
            below |= {(doc, pos, a[0], a[2], b[0], b[2]) for a in found for b in found if a[0] < b[0] <= a[1]}
    frame = spark.createDataFrame([*docs, (900, None, 1), (901, "", 1), (902, "<claims></claims>", 1), (903, "<claims><claim><claim-text>open<claim-text>", 1)], "doc_id long, xml string, first int")
    tree = M.element_tree(frame)
    got = [(r.doc_id, r.claim_pos, r.first, r["last"], r.depth, r.parent, r.ordinal, r.path, r.size) for r in M.element_paths(tree).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert {tuple(r[c] for c in ("doc_id", "claim_pos", "first", "depth", "below", "below_depth")) for r in M.elements_below(tree).collect()} == below
    assert tree._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_an_element_that_is_not_closed_goes_on_to_the_end(spark):
    xml = "<claims><claim><claim-text>a<claim-text>b</claim-text><claim-text>c</claim></claims>"
    got = M.element_tree(spark.createDataFrame([(1, xml)], "doc_id long, xml string")).orderBy("first").collect()
    assert [(r.first, r["last"], r.parent) for r in got] == [(1, 3, None), (2, 2, 1), (3, 3, 1)]


def test_claims_and_trees_are_told_without_joins_and_tokens_as_rows(spark):
    many = "".join(f'<claim id="{k}"><claim-text>{k}. A <b>x</b><claim-text>y</claim-text>z</claim-text></claim>' for k in range(1, 200))
    deep = f"<claim>{'<claim-text>a' * 150}{'</claim-text>' * 150}</claim>"
    frame = spark.createDataFrame([(1, f"<claims>{many}</claims>"), (2, f"<claims>{deep}</claims>")], "doc_id long, xml string")
    claims, tree = M.xml_claims(frame), M.element_tree(frame)

    def plan(found):
        return found._jdf.queryExecution().executedPlan().toString()

    assert "Exchange " not in plan(claims) and "Window" not in plan(claims)
    assert plan(M.xml_documents(frame)).count("Exchange ") == 1 and "Window" not in plan(M.xml_documents(frame))
    assert all("Join" not in plan(f(tree)) and plan(f(tree)).count("Exchange ") == 1 for f in (M.element_paths, M.elements_below))
    rows = claims.where("doc_id = 1").collect()
    assert sorted((r.claim_pos, r.number, r.header, r.elements[0].text) for r in rows) == [(k, k, "A <b>x</b>z", "y") for k in range(1, 200)]
    assert M.xml_documents(frame.where("doc_id = 1")).first().error is None
    got = {(r.first, r["last"], r.depth, r.parent, r.ordinal, r.size) for r in M.element_paths(tree).where("doc_id = 2").collect() if r.path == [1] * r.depth}
    assert got == {(k, 150, k, k - 1 or None, 1, 150) for k in range(1, 151)}
    assert M.elements_below(tree).where("doc_id = 2").count() == 150 * 149 // 2
