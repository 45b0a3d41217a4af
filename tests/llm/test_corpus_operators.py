"""Operators 1 to 5 and 7 and the pipeline against brute force on small fixtures."""

import math
import os
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from clausewright.llm import ball_tree, line_dedup, mixing, near_dedup, registry, skew, staging, substring_dedup, toxicity
from clausewright.llm.components import connected_components

TABLES = "/root/testdata/sf0.1"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ba", "de", "fi", "go", "ku", "la", "mo", "ne"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else sentence(rng, 1) for w in text.split())


def frame(spark, texts, extra=True):
    rows = [(i, t, i) for i, t in enumerate(texts)] + ([(900, None, 1), (901, "", 1), (902, " \n ", 1), (None, texts[0], 1)] if extra else [])
    return spark.createDataFrame(rows, "doc_id long, text string, n_shingles int")


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def test_staged_tables_are_deleted(spark):
    table = staging.staged(spark.range(5), "five")
    assert table.count() == 5
    folder = staging.shared_folder(spark)
    assert os.listdir(folder)
    staging.clear(spark)
    assert not os.path.exists(folder)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(200 + i, 201 + i) for i in range(30)] + [(5, 5), (None, 3)]
    up = list(range(300))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in edges:
        if u is not None:
            a, b = sorted((find(u), find(v)))
            up[b] = a
    touched = {x for u, v in edges if u is not None and u != v for x in (u, v)}
    found = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {(r.node, r.component) for r in found.collect()} == {(x, find(x)) for x in touched}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_are_those_of_brute_force(spark, size, percent):
    rng = random.Random(7)
    bases = [sentence(rng, rng.randint(30, 200)) for _ in range(12)]
    texts = bases + [edited(rng, rng.choice(bases), rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05])) for _ in range(90)] + ["one", "one", "ONE two", "one\ttwo", "x " * 4000]
    sets = [shingle_set(t, size) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    rows = near_dedup.near_duplicates(frame(spark, texts), size, percent).collect()
    assert len(rows) == len(texts) + 4
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert got.pop(None)[1:] == (None, True)
    assert [got.pop(i) for i in (900, 901, 902)] == [(0, i, True) for i in (900, 901, 902)]
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(13)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    rows = [(1, a), (2, a + " x"), (2, b), (3, b), (3, b), (4, c), (5, None), (5, c + " y"), (6, c)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True), (5, 4, False), (5, 4, False), (6, 4, False)]


def test_near_duplicates_of_an_empty_table(spark):
    assert near_dedup.near_duplicates(frame(spark, ["a"]).where("false"), 3, 85).count() == 0


def test_large_buckets_are_compared_in_cells(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL", 4)
    monkeypatch.setattr(skew, "HEAVY_SHARE", 25)
    test_near_duplicates_are_those_of_brute_force(spark, 3, 85)


def brute_top(vectors, queries, k):
    out = set()
    for q, qv in queries:
        hits = sorted(((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in vectors if i != q and len(v) == len(qv)))[:k]
        out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(hits)}
    return out


@pytest.mark.parametrize("sizes", [(8192, 1024, 20_000), (40, 7, 20_000), (10, 3, 60)])
def test_top_k_is_exact(spark, monkeypatch, sizes):
    for name, size in zip(("SHARD_ROWS", "BLOCK_ROWS", "SAMPLE_ROWS"), sizes, strict=True):
        monkeypatch.setattr(ball_tree, name, size)
    monkeypatch.setattr(ball_tree, "BALL_ROWS", 2)
    monkeypatch.setattr(ball_tree, "TOGETHER", 4)
    monkeypatch.setattr(ball_tree, "PACK_ROWS", 3 if sizes[0] == 40 else 256)
    monkeypatch.setattr(ball_tree, "LEAF_ROWS", 8)
    rng = random.Random(3)
    rows = [(i, [rng.choice([-3, 0, 1, 2, 7]) * rng.random() for _ in range(5)]) for i in range(150)] + [(i, [1.0, 2.0, 0.5, -1.0, 0.0]) for i in range(150, 230)]
    odd = [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0]), (302, [math.nan] * 5), (303, [math.inf] * 5), (None, [1.0] * 5), (304, [1.0, 1.0]), (305, [])]
    table = spark.createDataFrame([(i, v, 9) for i, v in rows + odd], "vec_id long, embedding array<float>, score int")
    whole = ball_tree.whole_numbers(table)
    vectors = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows + [odd[5]]]
    found = {tuple(r) for r in ball_tree.top_inner_products(whole, whole.where("vec_id % 20 = 0"), 20).collect()}
    assert found == brute_top(vectors, [(i, v) for i, v in vectors if i % 20 == 0], 20)


def test_repeated_ids_are_candidates_and_one_query(spark):
    rows = [(0, [1, 0]), (0, [2, 0]), (1, [5, 1]), (1, [4, 1]), (2, [3, 3])]
    table = spark.createDataFrame(rows, "vec_id long, v array<long>")
    found = sorted(tuple(r) for r in ball_tree.top_inner_products(table, table.where("vec_id = 0"), 20).collect())
    assert found == [(0, 1, 1, 5), (0, 2, 1, 4), (0, 3, 2, 3)]


def test_leaves_and_shards_are_cut_where_vectors_lie_in_clusters():
    rng = np.random.default_rng(6)
    vectors = np.rint(np.repeat(rng.normal(size=(32, 16)) * 400, 256, axis=0) + rng.normal(size=(8192, 16)) * 10).astype(np.int64)
    tree, cut = ball_tree.BallTree(vectors), [0, 0]
    found = ball_tree.search(tree, np.arange(8192), vectors[::256], np.arange(8192)[::256], 20, np.full(32, -(1 << 63)), cut)
    assert cut[1] < cut[0] / 5
    for q, hits in zip(range(0, 8192, 256), found, strict=True):
        scores = np.delete(vectors @ vectors[q], q)
        assert [s for s, _ in hits] == sorted(scores.tolist(), reverse=True)[:20]
    regions = ball_tree.Regions(vectors[::4], 64)
    where = regions.of(vectors.astype(float))
    assert regions.regions >= 24 and np.mean([len(np.unique(where[k : k + 256])) for k in range(0, 8192, 256)]) < 3


@pytest.mark.parametrize("spread", [1.0, 400.0])
def test_packs_of_queries_meet_shards_and_never_query_by_query(spark, monkeypatch, spread):
    tables = {}
    monkeypatch.setattr(ball_tree, "staged", lambda df, name: tables.setdefault(name, staging.staged(df, name)))
    for name, size in (("SHARD_ROWS", 64), ("PACK_ROWS", 32)):
        monkeypatch.setattr(ball_tree, name, size)
    rng = np.random.default_rng(8)
    centres = np.repeat(rng.normal(size=(8, 12)) * 400, 128, axis=0)
    vectors = np.rint(centres + rng.normal(size=(1024, 12)) * spread).astype(np.int64).tolist()
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, v array<long>")
    found = {tuple(r) for r in ball_tree.top_inner_products(table, table.where("vec_id % 3 = 0"), 5).collect()}
    assert found == brute_top(list(enumerate(vectors)), [(i, v) for i, v in enumerate(vectors) if i % 3 == 0], 5)
    packs, shards, pairs = tables["known"].count(), tables["balls"].count(), tables["pairs"].count()
    assert packs < 342 / 32 + 8 * spark.sparkContext.defaultParallelism and pairs <= packs * shards
    assert tables["pairs"].groupBy("pack", "shard").count().where("count > 1").count() == 0
    assert sum(bin(int.from_bytes(r.bits, "big")).count("1") for r in tables["pairs"].collect()) <= 342 * (shards - 1)


def test_top_k_of_large_numbers_and_of_nothing(spark):
    table = spark.createDataFrame([(i, [2**40 + i, -(2**41), i]) for i in range(30)], "vec_id long, v array<long>")
    found = {tuple(r) for r in ball_tree.top_inner_products(table, table.where("vec_id = 0"), 3).collect()}
    limit = 2**63 - 1  # scores beyond a long are its limits, ties go to the smaller id
    assert found == {(0, 1, 1, limit), (0, 2, 2, limit), (0, 3, 3, limit)}
    assert ball_tree.top_inner_products(table.where("false"), table.where("false"), 3).count() == 0


WEIGHTS = [[0.7, 0.1, 0.1, 0.05, 0.05], [0.9, *[0.01] * 10], [1.0] * 20, [math.sqrt(n) for n in (3, 50, 999, 12345)], [0.7, 0.2999, 0.0001], [0.5, 0.4999, *[1e-5] * 10], [1, 1e-9], [0.49, 0.49, 0.02 / 3, 0.02 / 3, 0.02 / 3]]


@pytest.mark.parametrize("weights", WEIGHTS)
@pytest.mark.parametrize("segment", [64, 1000, 1 << 15])
def test_sources_stay_within_a_block_of_the_true_weights_however_long(monkeypatch, weights, segment):
    """Every slot of a phase of 100,000 blocks, each part of the schedule worked out by itself."""
    monkeypatch.setattr(mixing, "SEGMENT", segment)
    monkeypatch.setattr(mixing, "WARM_UP", segment // 16)
    n = 100_000 if segment > 64 else 5_000
    total = math.fsum(weights)
    blocks = [math.ceil(w / total * n) + 1 for w in weights]
    phases = mixing.schedule(blocks, weights)
    slots = mixing.Slots(phases)
    order = np.full(sum(blocks), -1)
    for k, count in enumerate(blocks):
        numbers = np.arange(count)
        found = slots(k, np.repeat(numbers, 2)[::-1])[::-1][::2]  # asked for in any order, and repeatedly
        assert (np.diff(found) > 0).all()
        order[found] = k
    assert order.min() == 0  # each slot has one block
    first = phases[0]
    assert first.length >= min(0.9 * n, min(b / (w / total) for b, w in zip(blocks, weights, strict=True)) - 1 / min(w / total for w in weights))
    t = np.arange(1, first.length + 1)
    for k, w in enumerate(weights):
        assert np.abs(np.cumsum(order[: first.length] == k) - t * (w / total)).max() < 1 + 1e-6


def brute_slots(sizes, weights):
    """Slot by slot: earliest deadline first among released blocks, anew when a source runs out."""
    left, slots, start = dict(sizes), {}, 0
    while any(left.values()):
        active = [n for n in left if left[n]]
        active = [n for n in active if weights[n] > 0] or active
        total = sum(Fraction(weights[n] or 1.0) for n in active)
        share = {n: Fraction(weights[n] or 1.0) / total for n in active}
        had, t = dict.fromkeys(active, 0), 0
        while all(left[n] for n in active):
            ready = [(math.ceil((had[n] + 1) / share[n]), k, n) for k, n in enumerate(active) if math.floor(had[n] / share[n]) <= t]
            _, _, n = min(ready)
            slots[start + t] = n
            had[n] += 1
            left[n] -= 1
            t += 1
        start += t
    return slots


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0, "": 0.5}])
def test_mixture_is_the_schedule_block_by_block(spark, weights):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a"] * 5 + ["b", ""]) if i % 3 else None, "t", i, {"k": 1}) for i in range(700)] + [(5, "b", "t", 5, {"k": 1})] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_other int, nested map<string,int>").withColumn("deep", F.struct("nested"))
    out = mixing.mix(docs, weights, block_rows=4).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows) and all(r.mix_other == r.doc_id for r in out)
    sizes = Counter(s for _, s, *_ in rows)
    names = sorted(sizes, key=lambda n: (n is not None, n))
    given = {n: math.sqrt(sizes[n]) if weights is None else weights.get(n, 0) for n in names}
    got = {}
    for r in out:
        got.setdefault(r.mix_slot, set()).add(r.source)
    assert got == {t: {n} for t, n in brute_slots({n: -(-sizes[n] // 4) for n in names}, given).items()}
    assert len({(r.mix_slot, r.mix_place) for r in out}) == len(rows)
    assert mixing.mix(docs.where("false")).count() == 0


def brute_lines(texts, least):
    def tokens(line):
        masked = ["<*>" if any(c in "0123456789" for c in t) else t for t in line.split()]
        return tuple(masked if 10 * (len(masked) - masked.count("<*>")) >= 7 * len(masked) else ["as it is", *line.split()])

    shapes = defaultdict(set)
    for text in set(texts):
        for line in text.split("\n"):
            if line.split():
                shapes[tokens(line)].add(text)
    leaves = defaultdict(list)
    for s in shapes:
        if s[0] != "as it is":
            leaves[len(s), s[:3]].append(s)
    template = {s: ("shape", s) for s in shapes if len(shapes[s]) >= least}
    for leaf, kinds in leaves.items():
        total = sum(len(shapes[s]) for s in kinds)
        if total < least or len(kinds) < 2:
            continue
        modal = []
        for at in range(leaf[0]):
            count = Counter()
            for s in kinds:
                count[s[at]] += len(shapes[s])
            token, c = min(count.items(), key=lambda x: (-x[1], x[0]))
            modal.append(token if 2 * c >= total and token != "<*>" else None)
        if 10 * sum(m is not None for m in modal) < 7 * len(modal):
            continue
        fit = [s for s in kinds if all(m is None or m == t for m, t in zip(modal, s, strict=True))]
        if len(set().union(*(shapes[s] for s in fit))) >= least:
            template |= {s: ("leaf", leaf) for s in fit}
    seen, out = set(), []
    for text in texts:
        kept = []
        for line in text.split("\n"):
            of = template.get(tokens(line)) if line.split() else None
            if of is None or of not in seen:
                kept.append(line)
            if of:
                seen.add(of)
        out.append("\n".join(kept))
    return out


def many_lines(rng):
    boiler = ["all rights reserved by the owner of this", "visited on {} at 10.2.3.{} by the robot", "please contact {} for all questions about this page", "short {}", "1 2 3", "<*> <*>", "page {} of {}"]
    texts = []
    for i in range(60):
        lines = [sentence(rng, rng.randint(3, 9)) for _ in range(rng.randint(1, 5))] + [rng.choice(boiler).replace("{}", rng.choice([str(i), sentence(rng, 1)])) for _ in range(rng.randint(0, 3))] + [""] * rng.randint(0, 2)
        lines += [f"{rng.randint(0, 999)}  {rng.random():.3f} {rng.randint(0, 9)}" for _ in range(2)]  # rows of numbers, all different
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    texts.insert(30, texts[3])  # a copy right here would share the first line's place with the original only by text
    return texts


@pytest.mark.parametrize("share", [skew.HEAVY_SHARE, 20, 1])
def test_lines_are_those_of_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(skew, "HEAVY_SHARE", share)
    if share == 1:
        monkeypatch.setattr(line_dedup, "BROADCAST_LEAVES", 0)
    texts = many_lines(random.Random(8))
    docs = spark.createDataFrame([(i, t, i % 3, "x", "y", 5) for i, t in enumerate(texts)] + [(900, None, 1, "x", "y", 5), (901, "", 1, "x", "y", 5)], "doc_id long, text string, lines int, lost_id string, lost_key string, lost_marks int")
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(docs).collect()}
    wanted = brute_lines(texts, line_dedup.LEAST_TEXTS)
    assert [got[i].text for i in range(len(texts))] == wanted
    assert sum(r.lines_dropped for r in got.values()) > 20
    assert [got[i].lines_dropped for i in range(len(texts))] == [len(t.split("\n")) - len(w.split("\n")) if w or t == w else len(t.split("\n")) for t, w in zip(texts, wanted, strict=True)]
    assert (got[900].text, got[900].line_count, got[901].text, got[901].lines_dropped) == (None, 0, "", 0)
    assert got[5].lines == 2 and (got[5].lost_id, got[5].lost_key, got[5].lost_marks) == ("x", "y", 5)
    assert line_dedup.drop_recurring_lines(docs.where("false")).count() == 0


def test_lines_of_null_ids_repeated_rows_and_long_texts(spark):
    line = "all rights reserved by the owner of this"
    long = "\n".join([line, "own words here"] * 20_000)
    rows = [(None, f"a b c\n{line}"), (3, f"d e f\n{line}"), (3, f"d e f\n{line}"), (4, f"g h i\n{line}"), (None, f"j k l\n{line}"), (5, f"{line}\nm n o"), (6, long), (None, None)]
    found = line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = "\n".join(["own words here"] * 20_000)
    wanted = [(0, "a b c"), (0, "j k l"), (0, None), (3, f"d e f\n{line}"), (3, f"d e f\n{line}"), (4, "g h i"), (5, "m n o"), (6, kept)]
    assert sorted((r.doc_id or 0, r.text or "") for r in found) == sorted((i, t or "") for i, t in wanted)


@pytest.mark.parametrize("name", ["op3_exact_top_k", "op4_minhash_near_dedup", "op5_line_dedup"])
@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables aren't here")
def test_queries_give_the_rows_of_their_sql(spark, name):
    small = TABLES.replace("sf0.1", "sf0.001")
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from read_parquet('{small}/{table}.parquet')")
    said = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in said.description]
    found = registry.QUERIES[name](spark, small).select(columns).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, said.fetchall()))


def test_compact_windows_cover_each_subsequence_once():
    rng = np.random.default_rng(4)
    values = rng.permutation(60).astype(np.uint64)
    windows = substring_dedup.compact_windows(values, 5)
    for i in range(60):
        for j in range(i + 4, 60):
            at = i + int(values[i : j + 1].argmin())
            assert [c for lo, c, r in windows if lo <= i <= c <= j <= r] == [at]


def test_windows_of_several_texts_are_those_of_their_trees(monkeypatch):
    rng = np.random.default_rng(5)
    for _ in range(300):
        least = int(rng.integers(2, 12))
        texts = [rng.integers(1, rng.choice([6, 1000]), rng.integers(0, 80)).astype(np.uint64) for _ in range(rng.integers(1, 6))]
        values = np.concatenate([np.zeros(1, np.uint64), *(np.append(t, np.uint64(0)) for t in texts)])
        found = [tuple(w) for w in np.array(substring_dedup.all_compact_windows(values, least)).T.tolist()]
        begins = np.cumsum([1, *(len(t) + 1 for t in texts)]).tolist()
        assert sorted(found) == sorted((b + lo, b + c, b + r) for t, b in zip(texts, begins, strict=False) for lo, c, r in substring_dedup.compact_windows(t, least))
    texts = [rng.integers(1, 2**60, n).astype(np.uint64) for n in (3, 200, 90, 46, 400, 45, 1000)]
    every = []
    for together, longest in ((1 << 14, 1 << 20), (300, 350)):
        monkeypatch.setattr(substring_dedup, "TOGETHER", together)
        monkeypatch.setattr(substring_dedup, "LONGEST_TOGETHER", longest)
        every.append(sorted((k, *row) for k, *columns in substring_dedup._together(texts, 46) for row in zip(*(c.tolist() for c in columns), strict=True)))
    assert every[0] == every[1] and {row[1] for row in every[0]} == {1, 2, 3, 4, 6}


def test_repeated_passages_are_found_and_others_left_alone(spark):
    rng = random.Random(6)
    passage, near = sentence(rng, 60), sentence(rng, 80)
    texts = [sentence(rng, rng.randint(60, 300)) for _ in range(40)]
    holders, near_holders = [3, 11, 12, 25], [5, 7, 30]
    for i in holders:
        texts[i] = sentence(rng, rng.randint(0, 80)) + " " + passage + " " + sentence(rng, rng.randint(0, 80))
    for i in near_holders:
        words = near.split()
        words[40 + i % 3] = "changed"
        texts[i] += " " + " ".join(words) + " " + sentence(rng, 30)
    texts += [texts[0], texts[0], "word " * 3000, "short text", "short text"]
    rows = substring_dedup.repeated_passages(frame(spark, texts)).collect()
    flagged = {i for r in rows for i in (r.doc_id, r.first_doc_id)}
    assert flagged == {*holders, *near_holders, 0, 40, 41}
    for r in rows:
        one, two = texts[r.doc_id].split()[r.begin_word : r.end_word], texts[r.first_doc_id].split()[r.first_begin : r.first_end]
        a, b = shingle_set(" ".join(one), 5), shingle_set(" ".join(two), 5)
        assert len(one) >= 50 and len(a & b) / len(a | b) >= 0.8 and abs(r.similarity - len(a & b) / len(a | b)) < 1e-9
    assert substring_dedup.repeated_passages(frame(spark, texts).where("false")).count() == 0


@pytest.mark.parametrize(("earlier", "stock"), [(1, (30, 42)), (1, (44, 49)), (2, (44, 49)), (4, (44, 49)), (16, (44, 49))])
def test_a_pair_that_shares_less_with_earlier_documents_is_found(spark, earlier, stock):
    """The last two documents of each group share 50 to 61 words, around a stock sentence that the earlier ones hold alone. A few of those are
    alike enough by chance; then both may be tied to the same one of them."""
    rng, texts, wanted, group = random.Random(21), [], set(), []
    for _ in range(40):
        words = sentence(rng, rng.randint(*stock))
        n = rng.randint(max(0, 50 - len(words.split())), 61 - len(words.split()))
        before = rng.randint(0, n)
        shared = f"{sentence(rng, before)} {words} {sentence(rng, n - before)}"
        texts += [f"{sentence(rng, 60)} {words} {sentence(rng, 60)}" for _ in range(earlier)]
        texts += [f"{sentence(rng, 60)} {shared} {sentence(rng, 60)}" for _ in range(2)]
        wanted.add((len(texts) - 1, len(texts) - 2))
        group += [len(wanted)] * (earlier + 2)
    found = {(r.doc_id, r.first_doc_id) for r in substring_dedup.repeated_passages(frame(spark, texts, False)).collect()}
    assert all(group[a] == group[b] for a, b in found)
    ties = defaultdict(set)
    for a, b in found:
        ties[a].add(b)
    seen = [(a, b) for a, b in wanted if (a, b) in found or ties[a] & ties[b]]
    assert sum((a, b) in found for a, b in wanted) >= 0.9 * len(wanted) and len(seen) >= 0.97 * len(wanted), (earlier, len(wanted & found), len(seen), len(found))


def test_runs_of_an_alignment_are_held_against_few_others(monkeypatch):
    """Two texts with a changed word at every twelfth place: a run follows the one before it, and the others aren't looked through."""
    rng, calls, found = np.random.default_rng(3), [], np.flatnonzero
    x = rng.integers(0, 1 << 60, 6000).astype(np.uint64)
    y = x.copy()
    y[::12] += np.uint64(1)
    monkeypatch.setattr(substring_dedup.np, "flatnonzero", lambda *given: calls.append(1) or found(*given))
    rows = substring_dedup.passages(x, y, [], 50, 80)
    assert [r[:4] for r in rows] == [(1, 6004, 1, 6004)]
    assert len(calls) < 50


def test_recall_against_all_pairs(spark):
    """Passages of 50 to 120 words with edits, down to the threshold, in a few hundred texts; brute force over all pairs of them."""
    rng, texts, pairs = random.Random(22), [], {}
    for _ in range(120):
        words = sentence(rng, rng.randint(50, 120)).split()
        other = list(words)
        for at in rng.sample(range(5, len(words) - 5), rng.randint(0, max(1, len(words) // 50))):
            other[at] = sentence(rng, 1) + "q"
        a, b = shingle_set(" ".join(words), 5), shingle_set(" ".join(other), 5)
        pairs[len(texts) + 1, len(texts)] = len(a & b) / len(a | b)
        texts += [f"{sentence(rng, rng.randint(0, 90))} {' '.join(w)} {sentence(rng, rng.randint(0, 90))}" for w in (words, other)]
    found = {(r.doc_id, r.first_doc_id) for r in substring_dedup.repeated_passages(frame(spark, texts, False)).collect()}
    wanted = {p for p, alike in pairs.items() if alike >= 0.8}
    assert found <= set(pairs) and len(wanted) > 60
    assert len(wanted & found) >= 0.96 * len(wanted)
    assert all(p in found for p, alike in pairs.items() if alike >= 0.95)


def _found(one, two):
    grams = substring_dedup._grams_of([" ".join(one), " ".join(two)], substring_dedup.WordHasher())
    x, y = grams
    equal = np.flatnonzero(np.isin(x, y))
    at = int(equal[0])
    rows = substring_dedup.passages(x, y, [(at, int(np.flatnonzero(y == x[at])[0]))], 50, 80)
    for b, e, c, f, alike in rows:
        p, q = shingle_set(" ".join(one[b:e]), 5), shingle_set(" ".join(two[c:f]), 5)
        assert min(e - b, f - c) >= 50 and abs(alike - len(p & q) / len(p | q)) < 1e-9 and alike >= 0.8
    return rows


@pytest.mark.parametrize("change", ["phrase", "two words", "inserted", "left out"])
def test_edited_passages_are_aligned(change):
    words = [f"w{k}" for k in range(100)]
    other = {
        "phrase": words[:48] + [f"n{k}" for k in range(4)] + words[52:],
        "two words": words[:47] + ["n1", *words[48:52], "n2"] + words[53:],
        "inserted": words[:49] + [f"n{k}" for k in range(12)] + words[49:],
        "left out": words[:47] + words[58:],
    }[change]
    around = [[f"{name}{k}" for k in range(70)] for name in "abcd"]
    rows = _found(around[0] + words + around[1], around[2] + around[3] + other)
    assert [(b, e, c, f) for b, e, c, f, _ in rows] == [(70, 170, 140, 140 + len(other))]


def test_an_edited_passage_beside_noise_is_found():
    words = [f"w{k}" for k in range(70)]
    other = [*words[:35], "n0", *words[36:]]
    noise = [[f"w{70 + k}" if k % 9 < 6 else f"{name}{k}" for k in range(90)] for name in "ab"]  # a few equal shingles, far below the threshold
    rows = _found(words + noise[0], other + noise[1])
    assert len(rows) == 1 and rows[0][0] == 0 and rows[0][1] >= 70


def test_crossed_and_repeated_passages_are_found():
    one, two = [f"u{k}" for k in range(60)], [f"v{k}" for k in range(60)]
    assert {(b, c) for b, _, c, _, _ in _found(one + two, two + one)} == {(0, 60), (60, 0)}
    assert {(b, c) for b, _, c, _, _ in _found([*one, "x", "y", "z", *one], one)} >= {(0, 0), (63, 0)}
    assert len(_found(["same"] * 3000, ["same"] * 2000)) <= 1


def test_texts_that_repeat_a_doc_id_are_separate(spark):
    rng = random.Random(12)
    p, q, r, whole = (sentence(rng, n) for n in (60, 60, 60, 90))

    def around(passage):
        return f"{sentence(rng, 40)} {passage} {sentence(rng, 40)}"

    rows = [(0, whole), (1, around(p)), (1, around(q)), (2, around(p)), (3, around(q)), (4, whole), (4, around(r)), (5, around(r)), (6, around(p + " " + sentence(rng, 9))), (6, around(sentence(rng, 70)))]
    twice = sentence(rng, 60)
    rows += [(7, around(twice)), (7, around(twice)), (8, sentence(rng, 80)), (None, around(p))]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.first_doc_id) for x in found} == {(2, 1), (3, 1), (4, 0), (5, 4), (6, 1)}
    texts = defaultdict(list)
    for i, text in rows:
        texts[i].append(text.split())
    for x in found:
        spans = [{" ".join(t[b:e]) for t in texts[i]} for i, b, e in ((x.doc_id, x.begin_word, x.end_word), (x.first_doc_id, x.first_begin, x.first_end))]
        assert spans[0] & spans[1]


def test_toxicity_swaps_and_scores(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        words = sentence(rng, 30).split() + (["vileword"] if bad else []) + (["women"] if i % 2 else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), i))
        labels.append((i, int(bad), 7))
    docs = spark.createDataFrame(rows + [(900, None, 1), (901, "", 1), (902, "vileword", 1), (903, "women", 1), (904, "men", 1)], "doc_id long, text string, score int")
    table = spark.createDataFrame(labels + [(None, 1, 7), (900, 1, 7), (999, None, 7)], "doc_id long, toxic int, text int")
    model = toxicity.learn(docs, table.where("doc_id is null or doc_id < 250"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert sum(got[i].predicted != (i % 3 == 0) for i in range(250, 300)) <= 4  # 250 documents are few to learn from
    assert got[900].score == got[901].score < 0.5 and got[902].predicted == 1
    assert abs(got[903].score - got[904].score) < 0.02
    none = toxicity.learn(docs, table.where("false"))
    assert all(r.score < 0.01 for r in toxicity.score(docs, none).collect())


def brute_score(text, model):
    """The score of a text, word by word: every feature's 1 + ln(count) times its weight."""
    of = dict(zip(model.only.tolist(), model.weights.tolist(), strict=True))
    counts = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for part in [f"={word}", *(f"^{word[:n]}" for n in toxicity.BEGINNINGS if len(word) >= n)]:
            counts[xxhash.xxh64_intdigest(part.encode(), seed=7) % toxicity.FEATURES] += 1
    raw = model.constant + sum((1 + math.log(n)) * of.get(f, 0.0) for f, n in counts.items())
    return 1 / (1 + math.exp(-raw))


def test_toxicity_scores_are_those_of_brute_force(spark):
    rng = random.Random(10)
    texts = [sentence(rng, rng.randint(0, 60)) for _ in range(60)] + ["", None, "vile " * 20_000, "Ärger im Männerchor 12", "x"]
    only = np.unique(np.concatenate([toxicity.Buckets()[w] for t in texts for w in (t or "").split()[:7] + ["vile", "männerchor"]]))
    model = toxicity.Model(only, np.random.default_rng(3).normal(size=len(only)), -0.25)
    docs = spark.createDataFrame([(i % 50 or None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, predicted string")
    found = toxicity.score(docs, model).collect()
    wanted = [(i % 50 or None, brute_score(t, model)) for i, t in enumerate(texts)]
    assert sorted((r.doc_id or 0, round(r.score, 9)) for r in found) == sorted((i or 0, round(x, 9)) for i, x in wanted)
    assert all(r.predicted == (r.score >= 0.5) for r in found)
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_counterfactual_sentences():
    terms = (("women", "men"), ("old", "young", "aged"))
    text, pairs = toxicity.mentioned("Women sing. Old men and women! No one", terms)
    assert text == "women sing old men and women no one".split()
    assert sorted(" ".join(b) for _, b in pairs) == ["aged men and women", "men sing", "old men and men", "old women and women", "young men and women"]
    own, added = toxicity.mentioned("One two. Three", terms)
    assert own[:3] == ["one", "two", "three"] and len(own) == 4 and all(a[:-1] == b[:-1] and a[-1] == own[-1] != b[-1] for a, b in added)
    assert [toxicity.mentioned(t, terms) for t in (None, "", " 12 ")] == [([], [])] * 3


def test_counterfactual_penalty_lowers_false_positives_on_neutral_mentions(spark):
    """Labelled texts in which one group's name goes with the label; neutral sentences with it must not be flagged for it."""
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        bad = i % 2
        name = "women" if rng.random() < (0.9 if bad else 0.1) else "men"
        rows.append((i, f"{sentence(rng, 6)}. {sentence(rng, 5)} {name} {sentence(rng, 3)}" + (f" {rng.choice(['vile', 'foul', 'rotten'])}" if bad and rng.random() < 0.6 else "")))
        labels.append((i, bad))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = spark.createDataFrame([(i, f"{sentence(rng, 8)} women {sentence(rng, 4)}") for i in range(300)], "doc_id long, text string")
    flagged = {}
    for penalty in (0.0, 10.0):
        model = toxicity.learn(docs, table, terms=(("women", "men"),), penalty=penalty)
        assert model.gaps.pairs == 600
        flagged[penalty] = toxicity.score(neutral, model).where("predicted = 1").count()
    assert flagged[10.0] < flagged[0.0] / 2


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables aren't here")
def test_held_out_toxicity(spark):
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    rows = toxicity.op7_toxicity(spark, TABLES).where("held_out").join(labels, "doc_id").select("toxic", "score", "predicted").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean(np.array(bad)[:, None] > np.array(good)) > 0.98
    assert np.mean([r.predicted for r in rows if not r.toxic]) < 0.01


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stage_by_stage(spark):
    rng = random.Random(11)
    speech = {"aa": "der die das und nicht", "bb": "le la les avec pour", "cc": "the of and with from"}
    docs = []
    for i in range(90):
        lang = sorted(speech)[i % 3]
        words = [rng.choice(speech[lang].split()) + rng.choice(["", "x", "ment", "ung"]) + rng.choice(["a", "e", "o"]) * rng.randint(0, 1) for _ in range(80)]
        docs.append((i, " ".join(words) + ("\nall rights reserved by us" if i % 4 == 0 else ""), lang, "s%d" % (i % 2), 0))
    docs += [(100, docs[7][1], "bb", "s0", 0), (101, "12345 !!", None, "s0", 0), (102, None, None, None, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    table = table.selectExpr("*", "'x' lost_id", "1 mix_extra", "2 component_id")
    now, seen = table, {}
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.staged(stage(spark, now, ""), name)
        seen[name] = now
        if name != "bpe":
            assert now.columns == table.columns
    assert {r.doc_id for r in seen["language_id"].collect()} == {i for i, *_ in docs} - {101, 102}
    texts = {r.doc_id: r.text for r in seen["line_dedup"].collect()}
    assert sum("reserved" in t for t in texts.values()) == 1
    assert {r.doc_id for r in seen["near_dedup"].collect()} == set(texts) - {100}
    order = [(r.mix_slot, r.mix_place, r.doc_id) for r in mixing.mix(seen["near_dedup"]).collect()]
    assert [r.doc_id for r in seen["mixing"].collect()] == [i for *_, i in sorted(order)]
    assert [r.doc_id for r in seen["bpe"].orderBy("mix_file", "mix_row").collect()] == [i for *_, i in sorted(order)]
    assert seen["bpe"].count() == len(order) and seen["bpe"].where(F.col("n_tokens") > 0).count() == len(order)
