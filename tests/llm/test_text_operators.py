"""Operators 6, 8, 9 and 10 against brute force and the libraries they must agree with."""

import hashlib
import os
import random
import re

import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from clausewright.llm import bpe, language_id, spot_signatures, token_counts

TABLES = "/root/testdata/sf0.01"
ODD = ["", " ", "\n\n", "a", "The the THE", "x" * 5000, "é" * 300, "İstanbul Σίσυφος ΟΔΟΣ", "12 345 6.7", "!!! ... ---", "a  b\tc\x1cd", "ﬁ ½ ٣ 漢字 🎉🎉", "<|endoftext|> x<|startoftext|>y <|", "don't we'll I'm 'tis", "￿", "▁ ▁a", " lead", "trail "]


def some_texts(n: int, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    parts = [*"abcdefghij", "the", "ing", "tion", " ", " ", " ", "\n", "é", "ß", "Σ", "'s", "'", "1", ".", ",", "▁", "漢", "🎉", "\x1d", " ", "<|endoftext|>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def frame(spark, texts):
    """Texts with a clashing column, a null text, a null id and a repeated row."""
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(10_000, None, "n"), (None, "no id", "n"), (0, texts[0], "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_bpe_round_trip_is_the_librarys(spark):
    texts = ODD + some_texts(400)
    known = Tokenizer.from_file(bpe.default_vocabulary())
    for row in bpe.encode_documents(frame(spark, texts)).collect():
        if row.doc_id is None or row.doc_id == 10_000:
            continue
        wanted = known.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.ids == wanted
        assert row.decoded == known.decode(wanted, skip_special_tokens=False)


def test_bpe_digests(spark):
    rows = {r.doc_id: r for r in bpe.digests(bpe.encode_documents(frame(spark, ["the cat"]))).collect()}
    ids = Tokenizer.from_file(bpe.default_vocabulary()).encode("the cat", add_special_tokens=False).ids
    assert rows[0].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert (rows[10_000].n_tokens, rows[10_000].ids_sha256) == (0, hashlib.sha256(b"").hexdigest())


def small_vocabulary(merges):
    letters = sorted({c for pair in merges for t in pair for c in t.removesuffix("</w>")})
    tokens = [*letters, *(f"{c}</w>" for c in letters), *(a + b for a, b in merges)]
    return bpe.Vocabulary({"model": {"type": "BPE", "end_of_word_suffix": "</w>", "vocab": {t: i for i, t in enumerate(dict.fromkeys(tokens))}, "merges": [list(m) for m in merges]}, "added_tokens": [], "pre_tokenizer": {"pretokenizers": [{"type": "Split", "pattern": {"Regex": r"[\p{L}]+"}}]}})


def test_bpe_emits_once_the_lookahead_is_read():
    """Words made to keep a token open as long as possible: streamed tokens are those of the whole word, in bounded memory."""
    rng = random.Random(2)
    lists = [[("b", "c"), ("a", "b"), ("c", "d"), ("ab", "cd")], [("a", "a"), ("aa", "aa"), ("aa", "b"), ("a", "b</w>")]]
    for _ in range(40):  # merges of what was merged before, at random
        made, parts = [], ["a", "b", "c"]
        for _ in range(rng.randint(3, 14)):
            pair = (rng.choice(parts), rng.choice(parts))
            if pair not in made and len(pair[0] + pair[1]) < 9:
                made.append(pair)
                parts.append(pair[0] + pair[1])
        lists.append(made)
    longest = 0
    for merges in lists:
        vocabulary = small_vocabulary([*merges, ("a", "b"), ("c", "a")] if len({c for m in merges for t in m for c in t}) < 3 else merges)
        transducer = bpe.Transducer(vocabulary)
        longest = max(longest, vocabulary.lookahead())
        letters = [c for c in "abcd" if c in vocabulary.ids]
        for word in ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(20)] + ["ab" * 200, "a" * 333, "bc" * 150 + "a"]:
            if set(word) <= set(letters):
                assert list(transducer.encode(word)) == transducer.merged([*word[:-1], word[-1] + "</w>"])
        assert transducer.most_held <= 2 * transducer.window + transducer.longest + 1
    assert longest > 8


def test_bpe_holds_a_bounded_part_of_a_long_word():
    transducer = bpe.Transducer(bpe.Vocabulary.load(bpe.default_vocabulary()))
    word = "thecatsat" * 5000
    first = next(transducer.encode(word))  # long before the word's end
    rest = list(transducer.encode(word))
    assert rest[0] == first and "".join(rest) == word + "</w>"
    assert transducer.most_held <= 2 * transducer.window + transducer.longest + 1 < len(word)


def test_bpe_takes_letters_and_digits_for_what_the_library_does():
    codec, known = bpe.Codec(bpe.Vocabulary.load(bpe.default_vocabulary())), Tokenizer.from_file(bpe.default_vocabulary())
    codes = [c for c in [*range(0x20000), *range(0xE0000, 0xE0200), *range(0x20000, 0x110000, 997)] if not 0xD800 <= c < 0xE000]
    codes += codes
    texts = [f"a{chr(c)}b" if k < len(codes) // 2 else f"{chr(c)}{chr(c)}" for k, c in enumerate(codes)]
    wrong = [c for c, t, e in zip(codes, texts, known.encode_batch(texts, add_special_tokens=False), strict=True) if codec.encode(t) != e.ids]
    assert not wrong, [hex(c) for c in wrong[:20]]


def test_bpe_of_a_long_text_taken_in_parts(monkeypatch):
    monkeypatch.setattr(bpe, "PART_CHARS", 20)
    codec, known = bpe.Codec(bpe.Vocabulary.load(bpe.default_vocabulary())), Tokenizer.from_file(bpe.default_vocabulary())
    text = " e\u0301 \u0301a ".join(some_texts(80, 8) + ODD)
    assert codec.encode(text) == known.encode(text, add_special_tokens=False).ids


def test_bpe_asks_for_a_run_once():
    """The pattern is asked once for a run of words and signs that comes back, and made-up words are encoded as the library does."""
    codec, known = bpe.Codec(bpe.Vocabulary.load(bpe.default_vocabulary())), Tokenizer.from_file(bpe.default_vocabulary())
    asked, words = [], codec.words

    class Counted:
        def findall(self, run):
            asked.append(run)
            return words.findall(run)

    codec.words = Counted()
    text = "maison*** don't l'eau&&& x,y maison*** don't l'eau&&& x,y maison l eau"
    assert codec.encode(text) == known.encode(text, add_special_tokens=False).ids
    assert sorted(asked) == ["don't", "l'eau&&&", "maison***", "x,y"]
    rng = random.Random(4)
    made = ["".join(rng.choice(["th", "e", "ing", "tion", "eau", "on", "x", "qu"]) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    assert codec.encode(" ".join(made)) == known.encode(" ".join(made), add_special_tokens=False).ids


def test_bpe_byte_decoder_waits_for_whole_characters():
    vocabulary = bpe.Vocabulary.load(bpe.default_vocabulary())
    vocabulary.byte_decoder = True
    codec = bpe.Codec(vocabulary)
    letters = bpe.byte_letters()
    ids = [vocabulary.ids[letters[b]] for b in "a漢🎉".encode()]
    assert [p for p in codec.pieces(ids) if p] == ["a", "漢", "🎉"]


def test_empty_tables(spark):
    empty = frame(spark, ["x"]).where("false")
    assert bpe.encode_documents(empty).count() == 0
    assert token_counts.count_tokens(empty).count() == 0
    assert language_id.identify(empty, {}).count() == 0
    assert spot_signatures.fingerprint_and_compare(empty).count() == 0


@pytest.mark.parametrize("bytes_too", [True, False])
def test_token_counts_are_the_librarys(bytes_too):
    import public_tokenizers

    pieces, has_bytes = token_counts.load(public_tokenizers.path("piece_bpe_32k.model"))
    assert has_bytes
    vocabulary = [("<unk>", 0.0)] + ([(f"<0x{b:02X}>", -1e6) for b in range(256)] if bytes_too else []) + pieces
    least = min(s for _, s in vocabulary)
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=bytes_too))
    library.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    ours = token_counts.Counter(pieces, bytes_too)
    ours.unknown = least - token_counts.UNKNOWN_PENALTY
    for text in ODD + some_texts(1500):
        if "<0x" in text or "<unk>" in text:
            continue
        assert ours.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_token_counts_frame(spark):
    rows = [(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(frame(spark, ["the cat sat", ""])).collect()]
    assert (10_000, 0) in rows and (1, 0) in rows
    assert len(rows) == 5 and len({n for i, n in rows if i == 0}) == 1


def test_languages_are_told_apart(spark):
    words = {"aa": "lorem ipsum dolor sit amet consectetur", "bb": "der schnelle braune fuchs springt weit", "cc": "une petite maison bleue sur la colline"}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(60)), lang) for i in range(90) for lang in (sorted(words)[i % 3],)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language_id.learn(docs.where("doc_id < 60"))
    found = {r.doc_id: r for r in language_id.identify(docs.where("doc_id >= 60"), learned).collect()}
    assert all(found[i].lang_pred == lang and 0 <= found[i].score <= 1 for i, _, lang in rows if i >= 60)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 ½ !!"), (None, "der fuchs")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in language_id.identify(odd, learned).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0, True)
    assert None in got
    assert language_id.learn(docs.where("false")) == {}


def test_languages_are_those_of_the_smallest_size(spark):
    """Every size anew, block by block, with a compressor made for it."""
    rng = random.Random(4)
    speech = {"aa": "the and house water singing", "bb": "der und haus wasser gesang", "cc": "le et maison eau chant"}
    rows = [(i, " ".join(rng.choice(speech[lang].split()) + rng.choice("aeiou") for _ in range(50)), lang) for i in range(30) for lang in (sorted(speech)[i % 3],)]
    learned = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [t for _, t, _ in rows] + ["und the le", "a", "wassera " * 4000, "12", "", None, "maisone, EAUO!\nchanta"]
    texts += texts[:3]
    docs = spark.createDataFrame([(i, t, "n", 0.5) for i, t in enumerate(texts)] + [(None, texts[0], "n", 0.5)], "doc_id long, text string, lang_pred string, score double")

    def size(raw, block):
        held = zstandard.ZstdCompressionDict(raw + language_id.CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        log = max(17, (len(raw) + 2 * len(language_id.CARRIER) + language_id.BLOCK_BYTES).bit_length())
        how = zstandard.ZstdCompressionParameters.from_level(5, dict_size=len(raw) + len(language_id.CARRIER), window_log=log, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress(language_id.CARRIER + block)) - len(zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress(language_id.CARRIER))

    for r in language_id.identify(docs, learned).collect():
        text = texts[0] if r.doc_id is None else texts[r.doc_id]
        letters = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        if not letters:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        raw = f" {' '.join(letters)} ".encode()
        sizes = [(sum(size(d, raw[k : k + language_id.BLOCK_BYTES]) for k in range(0, len(raw), language_id.BLOCK_BYTES)), at, lang) for at, (lang, d) in enumerate(learned.items())]
        (best, _, lang), (second, _, _), *_ = sorted(sizes)
        assert r.lang_pred == lang and abs(r.score - (second - best) / max(1, second, second - best)) < 1e-12


def test_whole_texts_of_a_stated_number_of_documents_are_learned(spark):
    rows = [(i, f"word{'abcdefghij'[i % 10]} " * (3000 if i == 7 else 3), "xx") for i in range(200)]
    learned = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), documents=200)
    assert len(learned["xx"]) == sum(len(language_id.letters_only(t)) for _, t, _ in rows)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables aren't here")
def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "lang")
    rows = language_id.op8_language_id(spark, TABLES).where("held_out").join(docs, "doc_id").where("lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows) and sum(r.rejected for r in rows) <= 0.02 * len(rows)


COMMON = set("a an the is was are of and to in der die das ein eine ist und le les un une est et du el los una es y que".split())


def spots(text):
    """The signatures of a text by name: each common word with the next two words that aren't common; without any, its words."""
    words = re.findall(r"[a-z\x80-\U0010ffff]+", (text or "").lower())
    out = set()
    for i, word in enumerate(words):
        rest = [w for w in words[i + 1 :] if w not in COMMON][:2]
        if word in COMMON and len(rest) == 2:
            out.add((word, *rest))
    return out or set(words) or ({text} if text else set())


def near(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


@pytest.mark.parametrize("frequent", [spot_signatures.FREQUENT, 2])
def test_spot_signatures_follow_the_order_of_ids(spark, monkeypatch, frequent):
    monkeypatch.setattr(spot_signatures, "FREQUENT", frequent)
    texts = ODD + some_texts(60, 9) + ["the cat sat on the mat and the dog ran to a red house in the wood"] * 2
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)] + [(5000, None)] + [(None, f"the cat of number {chr(97 + k)}x ran") for k in range(26)] + [(5000, "a red house is old news"), (5000, "the blue house is old news"), (6000, "z"), (6000, "z")]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, near_next double")
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    by_hash = frequent == 2
    often = {None, 5000, 6000} if by_hash else {None}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]] if r[0] in often else 0, r[1] or ""))
    found = spot_signatures.fingerprint_and_compare(docs.repartition(3)).collect()
    wanted = []
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        wanted.append((i or -1, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(near(spots(text), spots(edited)), 9), round(near(spots(text), spots(following)), 9)))
    assert sorted((-1 if r.doc_id is None else r.doc_id or -1, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in found) == sorted(wanted)
    same = {}
    for r in found:
        assert len(r.fingerprint) % 8 == 0
        same.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert len(same[6000]) == 1 and len(same[None]) == 26


def test_a_single_document_is_its_own_next(spark):
    rows = spot_signatures.fingerprint_and_compare(spark.createDataFrame([(3, "the red cat of old houses")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.near_next) for r in rows] == [(3, 1.0)]


def test_spot_signatures_pruned_jaccard(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["the", "is", "red", "blue", "green", "cat", "dog", "house", "runs", "a"]) + str(rng.randint(0, 3)) * 0 for _ in range(rng.randint(3, 60))) for _ in range(25)]
    texts = base + [b + " tail" for b in base] + base[:5]
    found = spot_signatures.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sets = {r.doc_id: frozenset(r.signatures) for r in found.collect()}
    members, pairs = spot_signatures.similar(found, 0.8)
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    keys = {r.doc_id: r.class_key for r in members.collect()}
    assert {(keys[i], s) for i, s in sets.items()} == {(keys[first[s]], s) for s in first} and len(set(keys.values())) == len(first)
    reps = sorted(first.values())
    wanted = {(a, b) for a in reps for b in reps if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r.u, r.v) for r in pairs.collect()} == {tuple(sorted((keys[a], keys[b]))) for a, b in wanted}
    counts = {r.doc_id: (r.class_id, r.n_links) for r in spot_signatures.links(found).collect()}
    assert counts == {i: (first[s], sum(first[s] in pair for pair in wanted)) for i, s in sets.items()}


def test_sets_that_share_an_id_are_classes_of_their_own(spark):
    """Two different texts under one id, each with a near copy; null ids, empty texts, a clashing column, and no rows at all."""
    rng = random.Random(11)
    one, two = (" ".join("the " + " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3)) for _ in range(30)) for _ in range(2))
    rows = [(1, one), (1, two), (4, one + " the tail end"), (5, two + " the tail end"), (6, ""), (7, None), (None, one), (8, one), (8, one)]
    found = spot_signatures.fingerprints(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, signatures string"))
    _, pairs = spot_signatures.similar(found, 0.8)
    assert pairs.count() == 2
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in spot_signatures.links(found).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (4, 4, 1), (5, 5, 1), (6, 6, 0), (7, 6, 0), (8, 1, 1), (8, 1, 1)]
    assert len({r.class_key for r in spot_signatures.links(found).collect()}) == 5
    assert spot_signatures.links(found.where("false")).count() == 0


def test_held_out_documents_teach_nothing(spark):
    docs = spark.createDataFrame([(i, "abc def ghi jkl", "xx") for i in range(40)], "doc_id long, text string, lang string")
    held = {r.doc_id for r in docs.where(language_id.remainder(4) == 2).collect()}
    assert held and len(held) < 40
    assert docs.where(language_id.remainder(4) != 2).where(F.col("doc_id").isin(sorted(held))).count() == 0
