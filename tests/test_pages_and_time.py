"""As-of joins, running lines and the layout of printed claims, held against plain loops."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausewright import staging
from clausewright.operators import asof, layout, pages

DAY = dt.datetime(2024, 1, 1)


def brute_as_of(rows, events, within):
    for user, at, name in rows:
        fits = [e for e in events if None not in (user, at, e[0], e[1]) and e[0] == user and e[1] <= at]
        best = max(fits, key=lambda e: (e[1], e[2] is not None, e[2] or 0), default=None)
        if best is None or (within and at - best[1] > within):
            yield user, at, name, None, None
        else:
            yield user, at, name, best[1], best[2]


@pytest.mark.parametrize("within", [None, 90])
def test_as_of_join_is_that_of_brute_force(spark, within):
    rng = random.Random(5)
    when = lambda: DAY + dt.timedelta(seconds=rng.randrange(2000))
    user = lambda: 1 if rng.random() < 0.5 else rng.randrange(40)  # noqa: E731  half of all rows have one key
    rows = [(user(), when(), f"r{rng.randrange(50)}") for _ in range(600)] + [(None, DAY, "n"), (3, None, "n"), (99, DAY, "none"), (1, DAY + dt.timedelta(days=9), "late")] * 2
    events = [(user(), when(), rng.randrange(9)) for _ in range(500)] + [(None, DAY, 1), (3, None, 2), (1, DAY, None), (1, DAY, 3)]
    left = spark.createDataFrame(rows, "user long, at timestamp_ntz, name string").repartition(5)
    right = spark.createDataFrame(events, "user long, at timestamp_ntz, n int").repartition(3)
    found = asof.as_of(left, right, ("user",), "at", "at", None if within is None else F.expr(f"interval {within} seconds"))
    assert found.columns == ["user", "at", "name", "event_at", "event_n"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, brute_as_of(rows, events, within and dt.timedelta(seconds=within))))


def test_as_of_join_cuts_a_frequent_key_and_carries_few_rows(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(asof, "staged", lambda df, name: kept.append(staging.staged(df, name)) or kept[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left = spark.range(4000).select(F.lit(7).alias("user"), (F.lit(DAY) + F.make_dt_interval(secs=F.col("id") % 50)).alias("at"), "id")
        right = spark.createDataFrame([(7, DAY, 1)], "user int, at timestamp, n int")
        found = asof.as_of(left, right, ("user",), "at", "at")
        assert found.where("event_n = 1").count() == 4000
        sizes = [r["count"] for r in kept[0].groupBy("part").count().collect()]
        assert len(sizes) == 4 and max(sizes) < 1600  # one key, and only 50 times
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_as_of_join_of_nothing(spark):
    left, right = spark.createDataFrame([], "k string, t long, x int"), spark.createDataFrame([], "k string, t long, y int")
    assert asof.as_of(left, right, ("k",), "t", "t").count() == 0
    one = spark.createDataFrame([("a", 5, 1)], left.schema)
    assert [tuple(r) for r in asof.as_of(one, right, ("k",), "t", "t").collect()] == [("a", 5, 1, None, None)]
    assert asof.as_of(left, spark.createDataFrame([("a", 5, 1)], right.schema), ("k",), "t", "t").count() == 0


def without(spark, *texts, **how):
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, running_note string")
    found = pages.without_running_lines(frame, **how)
    assert found.columns == ["doc_id", "text", "running_note", "n_pages", "running"]
    return [(r.text, r.n_pages, sorted(r.running or [])) for r in found.orderBy("doc_id").collect()]


def test_running_lines_go_and_nothing_else(spark):
    one = "\f".join(f"ACME  Patents {k},000\nbody {'abcd'[k]}\nPage 7\nmore {'abcd'[k]}\n\n{k} / 4 \n" for k in range(4))
    kept = "\f".join(f"body {c}\nPage 7\nmore {c}\n\n" for c in "abcd")
    two = "head\nx\fhead\ny"  # too few pages
    swapped = "\f".join(["left\na\nend", "right\nb\nend", "left\nc\nstop", "right\nd\nstop", "left\ne\nend"])  # left and right pages
    assert without(spark, one, two, None, "", "no page", swapped) == [
        (kept, 4, ["$# / #", "^acme patents #"]),
        (two, 2, []),
        (None, 0, []),
        ("", 1, []),
        ("no page", 1, []),
        ("a\fright\nb\fc\nstop\fright\nd\nstop\fe", 5, ["$end", "^left"]),
    ]


def test_running_lines_are_sought_at_edges_alone(spark):
    amid = "\f".join(f"a{c}\nb{c}\nsame\nc{c}\nd{c}" for c in "xyzuvw")
    assert without(spark, amid)[0] == (amid, 6, [])
    assert without(spark, amid, depth=3)[0][1:] == (6, ["$same", "^same"])
    same = "\f".join(["x\ny"] * 3)
    assert without(spark, same)[0] == ("\f\f", 3, ["$x", "$y", "^x", "^y"])


def test_running_lines_of_many_pages(spark):
    many = "\f".join(f"Report\nline {'x' * (k % 97)} {'y' * (k // 97)}\npage {k}" for k in range(20_000))
    text, n, running = without(spark, many)[0]
    assert n == 20_000 and running == ["$page #", "^report"] and "Report" not in text and text.count("\f") == 19_999


def brute_lines(text, first, later):
    """Letter by letter: takes words while they fit, then cuts what is longer than a line."""
    wide = lambda s: sum(layout.TIMES_ROMAN[ord(c) - 32] if " " <= c <= "~" else layout.OTHER_WIDTH for c in s)
    lines, words = [], text.split(" ")
    now = None
    while words:
        room = later if lines else first
        word = words.pop(0)
        if now is not None and wide(f"{now} {word}") <= room:
            now = f"{now} {word}"
        elif now is not None:
            lines.append(now)
            now, words = None, [word, *words]
        elif wide(word) <= room or len(word) == 1:
            now = word
        else:
            n = max(1, max((k for k in range(len(word)) if wide(word[:k]) <= room), default=1))
            lines.append(word[:n])
            words = [word[n:], *words]
    return [*lines, now] if now is not None else lines


def test_lines_are_broken_as_by_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        text = " ".join("".join(rng.choice("aiMW.lé—") for _ in range(rng.choice([1, 3, 8, 30]))) for _ in range(rng.randint(1, 25)))
        first, later = rng.choice([700, 5_000, 12_000]), rng.choice([600, 4_000, 9_000])
        assert [text[b:e] for b, e, _ in layout.broken(text, first, later)] == brute_lines(text, first, later)
    assert layout.broken("", 10, 10) == [(0, 0, 0)]


def test_widths_of_a_batch_are_those_of_its_letters():
    texts = ["", "Wide", "é—x\U0001f600", " ~\x7f\t", "", "i" * 500]
    wide = [sum(layout.TIMES_ROMAN[ord(c) - 32] if " " <= c <= "~" else layout.OTHER_WIDTH for c in s) for s in texts]
    for kind in (pa.string(), pa.large_string()):
        assert layout.text_widths(pa.array(texts, kind)).tolist() == wide
        assert layout.text_widths(pa.array(["ab", *texts, "c"], kind).slice(1, len(texts))).tolist() == wide


def test_layout_fills_pages(spark):
    rows = [("d", 1, -1, "Title", 0, 0, "What is claimed is:"), ("e", 1, 0, "ClaimRoot", 24, -24, None)]
    rows += [("d", c, 0, "ClaimRoot", 24, -24, f"{c}. A <b>thing</b> of a &lt; b &amp; " + "word " * 60) for c in range(1, 30)]
    rows += [("d", c, 1, "Level1", 48, -24, "(a) a part;") for c in range(1, 30)]
    frame = spark.createDataFrame(rows, "doc_id string, claim_pos long, line_in_claim int, style string, left_indent_pt int, first_line_indent_pt int, markup string").repartition(3)
    found = layout.laid_out(frame)
    got = sorted(tuple(r) for r in found.collect() if r.doc_id == "d")
    wide = layout.PAGE_WIDTH - 2 * (layout.MARGIN + layout.PADDING)
    page, used, wanted = 1, 0, []
    for _, claim, line, style, left, first, markup in sorted((r for r in rows if r[0] == "d"), key=lambda r: r[1:3]):
        text = markup.replace("<b>", "").replace("</b>", "").replace("&lt;", "<").replace("&amp;", "&").strip()
        space = 0 if style == "Title" else 12 if line == 0 else 6
        for k, piece in enumerate(brute_lines(text, (wide - left - first) * 1000 / 12, (wide - left) * 1000 / 12)):
            if used + space + 14 > 841.8898 - 2 * 78:
                page, used, space = page + 1, 0, 0
            used, space = used + space + 14, 0
            wanted.append(("d", claim, line, k, page, 78.0 + left + (0 if k else first), round(78 + used - 2, 4), piece))
    assert [(*r[:7], r[8]) for r in got] == wanted and page > 3
    assert [tuple(r)[1:5] + tuple(r)[7:] for r in found.where("doc_id = 'e'").collect()] == [(1, 0, 0, 1, 0.0, "")]
    assert layout.laid_out(frame.where("false")).count() == 0
