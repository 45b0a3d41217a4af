"""Operators 11 to 13 against brute force on small fixtures."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.llm import chat, importance, lexical
from clausewright.llm.chat_template import Template, TemplateError

WORDS = ["Alpha", "beta", "GAMMA", "é", "Éa", "x1", "ß", "the", "the", "the", "of", "漢字", "ω"]


def some_texts(n, seed=3, longest=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice([" ", " ", "-", "\n", ".", "_", "\x7f"]) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Operator 11


def searched(docs, items, top):
    """By the letter: every document's score for every item."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t)) for _, t in docs]
    n_docs, n_all = sum(bool(w) for w in words), sum(map(len, words))
    tfs = [Counter(w) for w in words]
    df = Counter(t for tf in tfs for t in tf)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), tf, w in zip(docs, tfs, words, strict=True):
            score = 0
            for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text)):
                if t in tf:
                    m = 75 + 25 * len(w) * n_docs // n_all
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0 and doc is not None:
                scored.append((-score, doc))
        out += [(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard_docs", "block_items"), [(7, 3), (1 << 14, 4096)])
def test_search_is_that_of_brute_force(spark, monkeypatch, shard_docs, block_items):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block_items)
    texts = some_texts(90)
    docs = [*enumerate(texts), (500, None), (501, ""), (None, texts[0]), (3, texts[3]), (3, texts[4]), (502, texts[5]), (503, " -- "), (504, "alpha " * 30_000)]
    items = [(0, "alpha beta"), (1, "the THE x1 ω"), (2, ""), (3, None), (None, "漢字 é É"), (1, "of"), (7, "nowhere"), (8, "é-ß.Éa alpha")]
    docs_df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, score int").repartition(3)
    items_df = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    for top in (4, 200):
        found = lexical.search(lexical.build_index(docs_df), items_df, top)
        assert sorted((tuple(r) for r in found.collect()), key=str) == searched(docs, items, top)


def test_equal_scores_go_by_doc_id(spark):
    docs = spark.createDataFrame([(k, "same words") for k in (9, 2, 7, 4, 30, 1)] + [(100 + k, "other") for k in range(30)], "doc_id long, text string").repartition(4)
    found = lexical.search(lexical.build_index(docs), spark.createDataFrame([(0, "words")], "item_id long, text string"), 4)
    assert [r.doc_id for r in found.orderBy("rank").collect()] == [1, 2, 4, 7]
    scores, ids = np.array([5, 5, 5, 9, 5]), np.array([4, 3, 8, 7, 1])
    assert ids[lexical.best(scores, ids, 3)].tolist() == [7, 1, 3]


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.build_index(docs.where("false")), items).count() == 0
    assert lexical.search(lexical.build_index(docs), items.where("false")).count() == 0


# Operator 12


def as_jinja_would(source, messages, **given):
    return Template(source, {"escape": chat.Escape().out}).render(messages, **given)


TURNS = [{"role": "user", "text": "Hi"}, {"role": "assistant", "text": " Yo "}, {"role": "user", "text": "Bye"}]


@pytest.mark.parametrize(
    ("source", "wanted"),
    [
        ("{% for m in messages %}{{ loop.index }}{{ m.role[0] }}:{{ m['text'] | trim }}{% if not loop.last %}, {% endif %}{% endfor %}", "1u:Hi, 2a:Yo, 3u:Bye"),
        ("{%- for m in messages -%}\n  {{ m.text | upper if loop.first else m.text | lower | trim }}\n{%- endfor -%}", "HIyobye"),
        ("a {#- b -#} c{{ 1 + 2 }}", "ac3"),
        ("{% set x = 'q' ~ 1 %}{{ x }}{% if x == 'q1' and not y %}!{% elif true %}?{% else %}.{% endif %}{{ y | default('none') }}", "q1!none"),
        ("{{ 'a' in 'cat' }}{{ 2 not in [1, 2] }}{{ z is defined }}{{ 7 % 4 }}{{ 'a\\n\\'b' }}", "TrueFalseTrue3a\n'b"),
        ("{% for m in messages %}{{ loop.previtem.role if not loop.first else '-' }}{{ loop.nextitem.role if loop.nextitem is defined else '.' }} {% endfor %}", "-assistant useruser assistant. "),
        ("{% for x in ['p', 'q'] %}{{ x }}{{ loop.index0 }}{% endfor %}", "p0q1"),
    ],
)
def test_templates(source, wanted):
    assert as_jinja_would(source, iter(TURNS), z=1) == wanted


@pytest.mark.parametrize(
    "source",
    ["{{ m.__class__ }}", "{{ _x }}", "{% for m in messages %}", "{{ 'a' + 1 }}", "{% while true %}", "{{ x | nothing }}", "{{ open('f') }}", "{% for a in messages %}{% for b in messages %}{% endfor %}{% endfor %}", "{{ 1", "{{ 'a", "{{ " + "(" * 500 + "1" + ")" * 500 + " }}", "{% if 1 %}", "{{ x is odd }}", "x" * 200_000],
)
def test_wrong_templates_are_refused(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_what_a_template_cannot_reach():
    assert as_jinja_would("{{ x.upper }}{{ x.format }}", [], x="text") == ""
    for source in ("{{ messages[0] }}", "{{ nothing.there }}", "{% for m in 'text' %}{% endfor %}", "{{ raise_exception('no ' ~ x) }}", "{{ 1 < x }}"):
        with pytest.raises(TemplateError):
            as_jinja_would(source, iter(TURNS), x="text")
    assert as_jinja_would("{% if false %}{{ raise_exception('no') }}{% endif %}ok", []) == "ok"


def test_constants_are_folded():
    tree = Template("a{{ 'b' ~ 1 + 2 }}{% if 1 == 2 %}no{% elif true or x %}c{% else %}{{ x }}{% endif %}{{ 'D' | lower }}").tree
    assert [n.text for n in tree] == ["ab3cd"]
    (loop,) = Template("{% for m in messages %}{{ '<' ~ '>' }}{{ m.text }}{% endfor %}").tree
    assert [type(n).__name__ for n in loop.body] == ["Text", "Output"]


def test_generation_blocks_are_marked():
    template = Template("{% for m in messages %}[{% if m.role == 'assistant' %}{% generation %}{{ m.text }}!{% endgeneration %}{% else %}{{ m.text }}{% endif %}]{% endfor %}")
    for most in (1 << 20, 3):
        said = "".join(text[b:e] for text, spans in chat.parts(template, iter(TURNS), most) for b, e in spans)
        assert said == " Yo !"


def test_escapes_are_undone_and_spell_nothing():
    rng, escape = random.Random(1), chat.Escape()
    parts = [*chat.CONTROLS, "\\", "\\\\", "a", " ", "[", "<", "</", "s>", "é", "\n", "INST]", "<<", ">>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert escape.back(escape.out(text)) == text
        assert not any(c in escape.out(text) for c in chat.CONTROLS)


def conversations(rng, n):
    parts = [*chat.CONTROLS, "\\", "a", "wörd ", "\n", "<", "[/INST", " "]
    return [(c, turn, rng.choice(["user", "assistant", "system", "tool", "[ROLE]x", None]), rng.choice([None, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(6))])) for c in range(n) for turn in range(rng.randint(1, 9))]


@pytest.mark.parametrize("most", [1 << 20, 10])
def test_conversations_are_read_back(spark, monkeypatch, most):
    monkeypatch.setattr(chat, "PART_CHARS", most)
    monkeypatch.setattr(chat.parts, "__defaults__", (most,))
    rows = conversations(random.Random(2), 30) + [(None, 0, "user", "no id"), (5, 0, "user", "again"), (5, None, "user", "first"), (77, 0, "assistant", "long " * 50_000), (77, 0, "assistant", "long " * 50_000)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    formatted = chat.format_conversations(frame)
    back = {}
    for r in chat.read_back(formatted).orderBy("conv_id", "place").collect():
        back.setdefault(r.conv_id, []).append((r.role, r.text))
    wanted = {}
    for conv, _, role, text in sorted(rows, key=lambda r: [(x is not None, x or 0) if k < 2 else (x is not None, x or "") for k, x in enumerate(r)]):
        wanted.setdefault(conv, []).append((role or "", text or ""))
    assert back == wanted
    digests = {r.conv_id: r for r in chat.digests(formatted).collect()}
    whole = {}
    for r in formatted.orderBy("conv_id", "part").collect():
        whole[r.conv_id] = whole.get(r.conv_id, 0) + len(r.formatted)
    assert set(digests) == set(wanted)
    for conv, turns in wanted.items():
        said = "".join(t for role, t in turns if role == "assistant")
        hashed = "".join(f"{role}\n{t}\n" for role, t in turns)
        d = digests[conv]
        assert (d.n_turns, d.turns_sha256, d.loss_chars, d.loss_sha256, d.formatted_chars) == (len(turns), hashlib.sha256(hashed.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), whole[conv])


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(empty)).count() == 0
    with pytest.raises(TemplateError):
        chat.format_conversations(empty, "{% for %}")


# Operator 13


def resampled(docs, target, percent, least):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    grams = lambda w: [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    buckets = lambda t: [zlib.crc32(g.encode()) % 10000 for g in grams(words(t))]
    s, t = Counter(b for _, x in docs for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    rows = []
    for doc, x in docs:
        weight = sum(gain[b] for b in buckets(x))
        h = int(hashlib.sha256(f"42:{doc}".encode()).hexdigest()[:8], 16)
        score = None if doc is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, len(buckets(x)), weight, score, None, len(words(x)) >= least and doc is not None])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0]))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize(("percent", "least"), [(5, 20), (40, 3), (100, 0)])
def test_resampling_is_that_of_brute_force(spark, percent, least):
    texts = some_texts(150, 5, 60)
    docs = [*enumerate(texts), (900, None), (901, ""), (902, "..."), (None, texts[2]), (None, texts[2]), (7, texts[7]), (7, texts[8]), (903, "The end " * 20_000)]
    target = [*some_texts(5, 6), None, ""]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, bucket int").repartition(5)
    found = importance.resampled(frame, spark.createDataFrame([(t,) for t in target], "text string"), percent, least)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == resampled(docs, target, percent, least)


def test_resampling_of_nothing(spark):
    docs, target = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("a",)], "text string")
    assert importance.resampled(docs.where("false"), target).count() == 0
    assert [r.weight for r in importance.resampled(docs, target.where("false")).collect()] == [3 * math.floor(1000 * math.log(10003 / 20000))]


def test_resampling_runs_no_python_and_sends_gains_alone(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(some_texts(20))], "doc_id long, text string")
    gain = importance.gains(importance.bucket_counts(docs), importance.bucket_counts(docs))
    plan = importance.weighed(docs, gain)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Aggregate [doc_id") == 1
    placed = importance.ranked(spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("x")), [F.col("x").desc(), F.col("id").asc()]).collect()
    assert [r.id for r in sorted(placed, key=lambda r: r.place)] == sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert sorted(r.place for r in placed) == list(range(1, 1001))
