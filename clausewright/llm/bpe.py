"""BPE encoding and decoding as a bounded-lookahead streaming transducer (operator 10)."""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words and runs of words, and pairs of tokens, that a Python worker remembers.
MEMORY = 300_000
#: Longer words are encoded anew each time.
REMEMBERED_CHARS = 64
SLICE = 256
#: A text is normalised and split in parts of at least so many characters.
PART_CHARS = 1 << 16
_BLANK = regex.compile("[ \n]")


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it has one, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """A BPE file of the tokenizers library with word-end suffix, as plain data that can be sent to tasks."""

    def __init__(self, raw: dict):
        model = raw["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or not model.get("end_of_word_suffix"):
            raise ValueError("a BPE model with a word-end suffix and no dropout is needed")
        self.suffix = model["end_of_word_suffix"]
        self.ids = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in reversed(list(enumerate(model["merges"])))}
        self.special = {t["content"]: t["id"] for t in raw["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.byte_decoder = (raw.get("decoder") or {}).get("type") == "ByteLevel"
        splits = [p for p in raw["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = splits[0]["pattern"]["Regex"]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        return cls(json.loads(Path(path).read_text(encoding="utf-8")))

    def symbols(self, token: str) -> int:
        return len(token.removesuffix(self.suffix) or "x")

    def lookahead(self) -> int:
        """Symbols past a token's end after which nothing that follows can change it.

        A merge at a place can only be forestalled from the right by a merge of higher priority that
        begins with an end part of it, and that one only by a still higher one. The longest reach of such
        a chain, by dynamic programming over the merges in order of priority, suffices.
        """
        best: dict[str, int] = {}
        most = 0
        for left, right in self.ranks if list(self.ranks.values()) == sorted(self.ranks.values()) else sorted(self.ranks, key=self.ranks.get):
            token = left + right
            if token.endswith(self.suffix):
                body, reach = token.removesuffix(self.suffix), 0  # nothing follows a word's end
            else:
                body = token
                reach = max([0, *(best[body[k:]] - (len(body) - k) for k in range(1, len(body)) if body[k:] in best)])
            most = max(most, reach)
            for k in range(1, len(body)):
                best[body[:k]] = max(best.get(body[:k], 0), len(body) + reach)
        return most


class Transducer:
    """Encodes a word symbol by symbol.

    It holds the encoding of what was read: the row of tokens of which each can stand beside the next (two neighbours can stand
    together if encoding their joint symbols gives just these two). There is one such row for each prefix, so the first that is found, by
    the longest token at each place and steps back where none fits, is the encoding. A token of the encoding of what was read is
    stable once the merge list's sufficient lookahead has been read past its end: whatever follows, it stays. Stable tokens
    are given out and forgotten, so that what is held (two windows and a token at most) depends on the merge list and not on the word.
    """

    def __init__(self, vocabulary: Vocabulary, lookahead: int | None = None):
        self.v = vocabulary
        self.longest = max(map(vocabulary.symbols, vocabulary.ids))
        #: Symbols that are held: the lookahead, and at least what the longest token reaches back to.
        self.window = max(vocabulary.lookahead() if lookahead is None else lookahead, self.longest)
        self.most_held = 0
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.inside = {t: t for t in vocabulary.ids if not t.endswith(vocabulary.suffix)}
        self.ending = {t.removesuffix(vocabulary.suffix): t for t in vocabulary.ids if t.endswith(vocabulary.suffix)}
        self.beginnings = ahocorasick.Automaton()
        for body in {*self.inside, *self.ending} - {""}:
            self.beginnings.add_word(body, len(body))

    def merged(self, symbols: list[str]) -> list[str]:
        """The encoding of a few symbols by the merges in order of priority, leftmost first."""
        rank_of, none = self.v.ranks.get, 1 << 60
        ranks = [rank_of(pair, none) for pair in zip(symbols, symbols[1:])]  # noqa: B905
        while ranks and (rank := min(ranks)) != none:
            at = ranks.index(rank)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of((symbols[at - 1], symbols[at]), none)
            if at < len(ranks):
                ranks[at] = rank_of((symbols[at], symbols[at + 1]), none)
        return symbols

    def _split(self, token: str) -> list[str]:
        body = token.removesuffix(self.v.suffix)
        return list(token) if body == token else [*body[:-1], body[-1] + self.v.suffix]

    def stands(self, token: str) -> bool:
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.merged(self._split(token)) == [token]
        return known

    def neighbours(self, left: str, right: str) -> bool:
        if (known := self.pairs.get((left, right))) is None:
            if len(self.pairs) >= 2 * MEMORY:
                self.pairs.clear()
            known = (left, right) not in self.v.ranks and self.merged([*left, *self._split(right)]) == [left, right]
            self.pairs[left, right] = known
        return known

    def encode(self, word: str) -> Iterator[str]:
        """The tokens of one word, given as its byte letters, each as soon as it is stable."""
        before, begin = None, 0  # the last token given out, and where it ends
        for at in range(0, len(word), self.window):
            read = at + self.window
            held = word[begin:read]
            self.most_held = max(self.most_held, len(held))
            path = self._path(held, before, read >= len(word))
            if read >= len(word):
                yield from path
                return
            for token in path:
                if begin + len(token) > read - self.window:
                    break
                before = token
                begin += len(token)
                yield token

    def _path(self, held: str, before: str | None, final: bool) -> list[str]:
        """The encoding of the symbols held, which end the word if ``final``; ``before`` stands before them."""
        path, sizes, left, at, stop, longest = [], [], before, 0, len(held), self.longest
        known, inside, ending, reach = self.pairs.get, self.inside.get, self.ending.get, self.beginnings.longest_prefix
        size = reach(held[:longest])
        while at < stop:
            while size:
                token = ending(held[at:]) if final and at + size == stop else inside(held[at : at + size])
                if token is not None:
                    if left is None:
                        fits = self.stands(token)
                    elif (fits := known((left, token))) is None:
                        fits = self.neighbours(left, token)
                    if fits:
                        break
                size -= 1
            if size:
                path.append(token)
                sizes.append(size)
                at += size
                left = token
                size = reach(held[at : at + longest])
            else:
                path.pop()
                size = sizes.pop()
                at -= size
                left = path[-1] if path else before
                size -= 1
        return path


# Letters and digits that Unicode 16 has and the tables of unicodedata (15.1) lack; capitals that Unicode 16 and 17
# added, with the distance to their small letters. The library classes by Unicode 16 and lowers by 17.
LATER = {
    "L": [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)],
    "N": [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)],
}
LATER_CAPITALS = {0x1C89: 1, 0xA7CB: 0x264 - 0xA7CB, 0xA7CC: 1, 0xA7CE: 1, 0xA7D2: 1, 0xA7D4: 1, 0xA7DA: 1, 0xA7DC: 0x19B - 0xA7DC} | dict.fromkeys(range(0x10D50, 0x10D66), 0x20) | dict.fromkeys(range(0x16EA0, 0x16EB9), 0x1B)
_SMALL = {code: code + step for code, step in LATER_CAPITALS.items()}
_RARE = regex.compile("[\x1c-\x1f" + "".join(map(chr, LATER_CAPITALS)) + "]")  # with what Python's split() takes for white space and the pattern doesn't


def _class(kind: str) -> str:
    """A character class of all code points of a Unicode category, frozen: the library doesn't know what the newer tables of the
    regex package have added."""
    out, begin = [], None
    for code in range(0x110001):
        inside = code < 0x110000 and unicodedata.category(chr(code))[0] == kind
        if inside and begin is None:
            begin = code
        elif not inside and begin is not None:
            out.append((begin, code - 1))
            begin = None
    return "".join(f"\\U{first:08x}-\\U{last:08x}" for first, last in out + LATER[kind])


class Codec:
    """Whole texts to ids and back, exactly as the tokenizers library does for the same file."""

    def __init__(self, vocabulary: Vocabulary, lookahead: int | None = None):
        self.v = vocabulary
        self.transducer = Transducer(vocabulary, lookahead)
        self.letters = byte_letters()
        self.bytes = {letter: b for b, letter in enumerate(self.letters)}
        pattern = vocabulary.pattern.replace(r"\s", r"\p{White_Space}")
        for kind in "LN":
            inside = _class(kind)
            pattern = regex.sub(rf"(\[[^\]]*)\\p\{{{kind}\}}", lambda m, inside=inside: m[1] + inside, pattern).replace(rf"\p{{{kind}}}", f"[{inside}]")
        self.words = regex.compile(pattern)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) or r"(?!)")
        self.recent: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _encoded(self, word: str) -> tuple[int, ...]:
        letters = word if word.isascii() and word.isalnum() else "".join(map(self.letters.__getitem__, word.encode("utf-8", "surrogatepass")))
        return tuple(map(self.v.ids.__getitem__, self.transducer.encode(letters)))

    def _known(self, run: str, words: list[str] | None = None) -> tuple[int, ...]:
        """The ids of a run without blanks, or of a word, which gives the same; those of the last MEMORY ones at least are remembered, and
        of twice as many at most."""
        if (ids := self.recent.get(run)) is not None:
            return ids
        if (ids := self.older.get(run)) is None:
            if words is None and not run.isalpha():  # most runs are a word, or a word and a stop: the pattern needn't be asked
                words = [run[:-1], run[-1]] if run[-1] in ".,;:" and run[:-1].isalpha() else self.words.findall(run)
            ids = self._encoded(run) if words is None or words == [run] else tuple(chain.from_iterable(self._known(w, [w]) for w in words))
            if len(run) > REMEMBERED_CHARS:
                return ids
        if len(self.recent) >= MEMORY:
            self.older, self.recent = self.recent, {}
        self.recent[run] = ids
        return ids

    def _plain(self, text: str) -> Iterator[list[tuple[int, ...]]]:
        """The ids of a text without special tokens, run by run. Long texts are taken in parts that begin at a blank."""
        begin = 0
        while begin < len(text):
            end = found.start() if (found := _BLANK.search(text, begin + PART_CHARS)) else len(text)
            yield self._part(text[begin:end])
            begin = end

    def _part(self, text: str) -> list[tuple[int, ...]]:
        lowered = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if _RARE.search(lowered):
            return [self._known(word, [word]) for word in self.words.findall(lowered.translate(_SMALL))]
        runs = lowered.split()
        found = list(map(self.recent.get, runs))
        if None in found:
            found = [self._known(run) if ids is None else ids for run, ids in zip(runs, found, strict=True)]
        return found

    def _all(self, text: str | None) -> Iterator[list[tuple[int, ...]]]:
        at = 0
        for found in self.specials.finditer(text) if text and self.v.special else ():
            yield from self._plain(text[at : found.start()])
            yield [(self.v.special[found[0]],)]
            at = found.end()
        if text:
            yield from self._plain(text[at:] if at else text)

    def ids(self, text: str | None) -> Iterator[int]:
        """A text's ids, each as soon as its part is known."""
        return chain.from_iterable(chain.from_iterable(self._all(text)))

    def encode(self, text: str | None) -> list[int]:
        return list(self.ids(text))

    def decode(self, ids: Iterable[int]) -> str:
        if not self.v.byte_decoder:
            return " ".join(map(self.v.tokens.__getitem__, ids))
        return "".join(self.pieces(ids))

    def pieces(self, ids: Iterable[int]) -> Iterator[str]:
        """The text in pieces, each once it is certain. With a byte decoder in the file, bytes that don't
        yet end a character are held (three at most); without one the tokens follow each other with a space between."""
        if not self.v.byte_decoder:
            between = ""
            for i in ids:
                yield between + self.v.tokens[i]
                between = " "
            return
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            token = self.v.tokens[i]
            if i in self.v.special.values():
                yield state.decode(b"", True) + token
                state.reset()
            else:
                yield state.decode(bytes(self.bytes[c] for c in token))
        yield state.decode(b"", True)


_codecs: dict[str, Codec] = {}


def codec_of(file: bytes, digest: str, lookahead: int) -> Codec:
    """One codec for all tasks of a Python worker, with what it remembers."""
    if digest not in _codecs:
        _codecs.clear()
        _codecs[digest] = Codec(Vocabulary(json.loads(file)), lookahead)
    return _codecs[digest]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, vocabulary_path: str | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) to one row per row: doc_id, ids (array of int), decoded (text), and the ``carried``
    columns as they are.

    The vocabulary file (about 2 MB, whatever the corpus) is read on the driver and sent to each executor once.
    Rows are independent and nothing is shuffled. Null and empty texts give no ids and an empty text; a null
    doc_id stays null; rows that repeat are each encoded; other columns are ignored. Texts and words may have
    any length: a text is split part by part, and of a word's encoding two windows of the lookahead and a token are held; only the row itself, its
    text, ids and decoded text, is held whole, as any row is.
    """
    raw = Path(vocabulary_path or default_vocabulary()).read_bytes()
    lookahead = Vocabulary(json.loads(raw)).lookahead()
    sent, digest = docs.sparkSession.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(sent.value, digest, lookahead)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = [codec.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(codec.decode, ids), pa.string()), *part.columns[2:]], ["doc_id", "ids", "decoded", *carried])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(run, f"doc_id long, ids array<int>, decoded string{kinds}")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *(c for c in encoded.columns if c not in ("doc_id", "ids", "decoded")),
    )


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op10_bpe_round_trip": op10_bpe_round_trip}
ORACLES: dict[str, str] = {}
