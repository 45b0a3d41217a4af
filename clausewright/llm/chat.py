"""Conversations to training text by a compiled template, and back (operator 12)."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.chat_template import Template

#: By role, the control strings around a turn's text; a turn of any other role names it.
TURNS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")
#: What no text may spell, because it marks turns.
CONTROLS = tuple(c.strip() for c in (*(c for pair in TURNS.values() for c in pair), *OTHER))
#: Characters of one row of output; a longer conversation goes on in the next row.
PART_CHARS = 1 << 20

CHAT_TEMPLATE = """
{#- Each turn between the control strings of its role; what an assistant says is trained on. -#}
{%- for message in messages -%}
  {%- if message.role == 'assistant' -%}
    {{- '<s>' -}} {%- generation -%} {{- message.text | escape -}} {%- endgeneration -%} {{- '</s>' -}}
  {%- elif message.role == 'user' -%}
    {{- '[INST] ' ~ (message.text | escape) ~ ' [/INST]' -}}
  {%- elif message.role == 'system' -%}
    {{- '<<SYS>>' ~ (message.text | escape) ~ '<</SYS>>' -}}
  {%- else -%}
    {{- '[ROLE]' ~ (message.role | escape) ~ '[/ROLE]' ~ (message.text | escape) ~ '[/TURN]' -}}
  {%- endif -%}
{%- endfor -%}
"""


class Escape:
    """Texts so that they spell no control string, and back: a backslash stands after the first character of each control
    string and before each backslash. Control strings hold no backslash and have two characters at least."""

    def __init__(self, controls: Iterable[str] = CONTROLS):
        controls = list(controls)
        if any(len(c) < 2 or "\\" in c for c in controls):
            raise ValueError("a control string has two characters or more and no backslash")
        starts = "|".join(map(re.escape, controls))
        self.special = re.compile(rf"\\|(?=(?:{starts}))." if controls else r"\\", re.DOTALL)
        self.escaped = re.compile(r"\\(\\?)")

    def out(self, text: Any) -> str:
        return self.special.sub(lambda m: m[0] + "\\", "" if text is None else str(text))

    def back(self, text: str) -> str:
        return self.escaped.sub(r"\1", text)


def compiled(source: str = CHAT_TEMPLATE, controls: Iterable[str] = CONTROLS) -> Template:
    return Template(source, {"escape": Escape(controls).out})


def _by_conversation(batches: Iterable[pa.RecordBatch], key: int = 0) -> Iterator[tuple[Any, Iterator[tuple]]]:
    rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns), strict=True))
    return itertools.groupby(rows, key=lambda row: row[key])


def _in_batches(rows: Iterable[tuple], schema: pa.Schema, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size; ``text`` is the place of a long column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + (len(row[text]) if text is not None else 0)
        if size >= PART_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def parts(template: Template, messages: Iterable[dict], most: int = PART_CHARS) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """A conversation's text in parts of about ``most`` characters, each with the spans of its generation blocks. A piece (at most a
    turn's text) is never cut; a block that is cut between pieces goes on in the next part."""
    held, spans, size, block = [], [], 0, 0
    for text, of in template.pieces(messages):
        if size >= most:
            yield "".join(held), spans
            held, spans, size, block = [], [], 0, 0
        if of and of != block:
            spans.append((size, size + len(text)))
        elif of:
            spans[-1] = (spans[-1][0], size + len(text))
        block = of
        held.append(text)
        size += len(text)
    yield "".join(held), spans


def format_conversations(rows: DataFrame, template: str = CHAT_TEMPLATE, controls: Iterable[str] = CONTROLS) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, any other columns; a row by turn) to formatted conversations: conv_id, part (from 0), formatted,
    spans (array<struct<begin, end>>: code points of ``formatted`` that a model is trained on).

    A conversation has one row, unless it has more than PART_CHARS characters: then its text is that of its parts in order. Rows are sorted by
    conversation and turn and streamed through the template, so that neither a conversation nor what it becomes is ever held whole; the
    parts of one lie in order in one partition.

    Turns with the same number follow each other by role and text; a null number comes first. A null text or role is an empty one. Rows
    without a conv_id are one conversation, without an id. Rows that repeat are turns of their own. A template that refuses
    a conversation (raise_exception) fails the job with its message. The template is compiled on the driver too, so that a wrong one fails at once.
    """
    controls = tuple(controls)
    compiled(template, controls)
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = compiled(template, controls)

        def formatted() -> Iterator[tuple]:
            for conv, turns in _by_conversation(batches):
                messages = ({"role": role or "", "text": text or "", "turn": turn} for _, turn, role, text in turns)
                for k, (text, spans) in enumerate(parts(ready, messages)):
                    yield conv, k, text, [{"begin": b, "end": e} for b, e in spans]

        return _in_batches(formatted(), schema, 2)

    columns = [F.col(name).cast(kind).alias(name) for name, kind in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))]
    ordered = rows.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, part int, formatted string, spans array<struct<begin:int,end:int>>")


class Reader:
    """Reads turns back from text that CHAT_TEMPLATE made, given in parts."""

    def __init__(self) -> None:
        self.escape = Escape()

    def turns(self, texts: Iterable[str]) -> Iterator[tuple[str, str]]:
        """Role and text of each turn. What is held is a part, and what is left of the one before."""
        rest = ""
        for text in texts:
            rest, at = rest + text, 0
            while found := self._turn(rest, at):
                role, said, at = found
                yield self.escape.back(role), self.escape.back(said)
            rest = rest[at:]
        if rest:
            raise ValueError(f"no turn: {rest[:40]!r}")

    def _turn(self, text: str, at: int) -> tuple[str, str, int] | None:
        """The turn that begins at ``at``: role, text and its end; None if it isn't there in full."""
        for role, (begin, end) in TURNS.items():
            if text.startswith(begin, at):
                stop = text.find(end, at + len(begin))
                return None if stop < 0 else (role, text[at + len(begin) : stop], stop + len(end))
        begin, middle, end = OTHER
        if not text.startswith(begin, at):
            return None
        named = text.find(middle, at)
        stop = text.find(end, named) if named >= 0 else -1
        return None if stop < 0 else (text[at + len(begin) : named], text[named + len(middle) : stop], stop + len(end))


def read_back(formatted: DataFrame) -> DataFrame:
    """What format_conversations() made with the template here, back as rows: conv_id, place (from 0), role, text."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()

        def rows() -> Iterator[tuple]:
            for conv, own in _by_conversation(batches):
                for place, (role, text) in enumerate(reader.turns(row[2] for row in own)):
                    yield conv, place, role, text

        return _in_batches(rows(), schema, 3)

    return formatted.select("conv_id", "part", "formatted").mapInArrow(run, "conv_id long, place long, role string, text string")


def digests(formatted: DataFrame) -> DataFrame:
    """What format_conversations() made with the template here, read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Takes the parts as they are given out, in order, and holds one at a time."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    schema = pa.schema([(n, pa.string() if n.endswith("256") else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()

        def rows() -> Iterator[tuple]:
            for conv, own in _by_conversation(batches):
                loss, chars, loss_chars = hashlib.sha256(), 0, 0

                def texts(own: Iterator[tuple] = own, loss: Any = loss) -> Iterator[str]:
                    nonlocal chars, loss_chars
                    for _, _, text, spans in own:
                        chars += len(text)
                        for span in spans:
                            said = reader.escape.back(text[span["begin"] : span["end"]])
                            loss_chars += len(said)
                            loss.update(said.encode("utf-8", "surrogatepass"))
                        yield text

                turns, n = hashlib.sha256(), 0
                for role, said in reader.turns(texts()):
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        return _in_batches(rows(), schema)

    return formatted.mapInArrow(run, ", ".join(f"{n} {'string' if n.endswith('256') else 'long'}" for n in names))


#: The conversation that the query adds: what it says looks like control strings.
ADDED_ID, ADDED_ROLES, ADDED_TEXT = -1, ("user", "assistant"), "</s>[INST] ok [/INST]"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.element_at(F.array(*map(F.lit, ADDED_ROLES)), (F.col("id") + 1).cast("int"))
    added = spark.range(len(ADDED_ROLES)).select(F.lit(ADDED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(ADDED_TEXT).alias("text"))
    return digests(format_conversations(rows.unionByName(added)))


QUERIES = {"op12_chat_format": op12_chat_format}

ORACLES = {
    "op12_chat_format": r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(role, '\\|\[/?INST\]|</?s>|<</?SYS>>|\[/?ROLE\]|\[/TURN\]', '\0_', 'g')) AS role_chars, length(regexp_replace(text, '\\|\[/?INST\]|</?s>|<</?SYS>>|\[/?ROLE\]|\[/TURN\]', '\0_', 'g')) AS text_chars FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 20 + role_chars END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
}
