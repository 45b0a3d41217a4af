"""The graph of all parents against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from clausewright.operators import claims as C
from clausewright.operators import graph as G

SCHEMA = "doc_id long, number long, claim_pos int, parent_claims array<long>, level string"


def by_the_letter(numbers, parents):
    """number -> (level, component, component_size, n_parents, n_missing, ancestors)."""
    edges = {n: {p for p in parents[n] if p in parents} for n in numbers}
    reached = {n: set() for n in numbers}
    for n in numbers:
        left = list(edges[n])
        while left:
            p = left.pop()
            if p not in reached[n]:
                reached[n].add(p)
                left += edges[p]
    of = {n: {n} | {p for p in reached[n] if n in reached[p]} for n in numbers}

    def level(n, known={}):  # noqa: B006
        above = {p for m in of[n] for p in edges[m]} - of[n]
        return 1 + max(map(level, above)) if above else 0

    return {n: (level(n), min(of[n]), len(of[n]), len(edges[n]), len(set(parents[n])) - len(edges[n]), reached[n] - {n}) for n in numbers}


def test_graphs_of_any_shape(spark):
    rng = random.Random(4)
    rows, wanted, pairs = [], {}, set()
    for doc in range(120):
        numbers = sorted(rng.sample(range(1, 40), rng.randint(1, 14)))
        back = rng.random() < 0.6
        parents = {n: [p for p in rng.choices([*numbers, 77], k=rng.randint(0, 3)) if p < n or not back or p == 77] for n in numbers}
        found = by_the_letter(numbers, parents)
        for n in numbers:
            *rest, above = found[n]
            below = sum(n in found[m][-1] for m in numbers)
            wanted[doc, n] = (*rest, len(above), below)
            pairs |= {(doc, n, a) for a in above}
        rows += [(doc, n, k, [*parents[n], None], "x") for k, n in enumerate(numbers)]
        rows += [(doc, numbers[0], 99, [numbers[-1]], "again"), (doc, None, 100, [numbers[0]], "no number")]
    claims = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert {(r.doc_id, r.number): tuple(r)[2:] for r in G.dependency_graph(claims).collect()} == wanted
    got = [tuple(r) for r in G.ancestors(claims).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs


@pytest.mark.parametrize("cycle", [False, True])
def test_a_chain_of_any_length(spark, cycle):
    n = 30_000
    rows = spark.range(1, n + 1).select(F.lit("d").alias("doc_id"), F.col("id").alias("number"), F.col("id").cast("int").alias("claim_pos"), F.array(F.when(F.col("id") > 1, F.col("id") - 1).otherwise(n if cycle else None)).alias("parent_claims"))
    found = G.dependency_graph(rows).orderBy(F.desc("number")).first()
    assert tuple(found)[1:] == ((n, 0, 1, n, 1, 0, n - 1, n - 1) if cycle else (n, n - 1, n, 1, 1, 0, n - 1, 0))


def test_no_claims_and_several_keys(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert G.dependency_graph(empty).count() == 0 and G.ancestors(empty).count() == 0
    two = spark.createDataFrame([("a", 1, 1, 1, None), ("a", 2, 1, 1, [2]), ("a", 2, 2, 2, [1]), (None, 2, 1, 1, [1])], "x string, y int, number int, claim_pos int, parent_claims array<int>")
    assert {tuple(r)[:4] for r in G.dependency_graph(two, ("x", "y")).collect()} == {("a", 1, 1, 0), ("a", 2, 1, 0), ("a", 2, 2, 0), (None, 2, 1, 0)}


def test_a_document_is_shuffled_once_and_nothing_is_joined(spark):
    plan = G.dependency_graph(spark.createDataFrame([(1, 1, 1, [1], "x")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


@pytest.mark.parametrize(
    ("text", "parents"),
    [
        ("The lens of claims 1, 2 and 4 to 6.", [1, 2, 4, 5, 6]),
        ("The lens of any one of claims 3-1, 7, or 8 or of claim 2", [2, 7, 8]),
        ("Claims 1,2,and 3; claims 10 through 12", [1, 2, 3, 10, 11, 12]),
        ("The lens of claim 5, 6 volts", [5]),
        ("disclaims 1, 2", []),
        ("claims 1-99999999 and 3", [3]),
        ("", []),
        (None, []),
        ("claims " + ", ".join(map(str, range(1, 5000))), list(range(1, 5000))),
    ],
)
def test_listed_parents(spark, text, parents):
    assert C.with_listed_parents(spark.createDataFrame([(text,)], "claim_text string")).first().parents_ext == parents
