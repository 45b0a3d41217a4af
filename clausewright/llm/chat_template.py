"""A sandboxed template language for conversations, compiled to Python closures (operator 12).

A template is text with ``{{ expression }}``, ``{% statement %}`` and ``{# comment #}``; a hyphen beside a delimiter takes away the white space
there. Statements are ``for x in messages``, ``if``/``elif``/``else``, ``set`` and ``generation``, whose text is what a model is trained on.
Source becomes a syntax tree, constant parts of the tree are worked out, and each node becomes a closure.

A template reaches nothing but the values it is given: names and fields that begin with an underscore are refused, fields are keys of
mappings and never attributes of objects, only the filters and tests named here can be called, and loops run over given values or lists that are
written out, so that every template ends. ``messages`` may be an iterator; it is read once, one message ahead, and so may have any length.
"""

from __future__ import annotations

import itertools
import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

#: Characters of a template, and levels of nesting, at most.
LONGEST_SOURCE, DEEPEST = 100_000, 60
_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?)(.*?)(-?)#\}", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+~%<>.|()\[\],=]))""", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}

#: A piece of rendered text, and the number of the generation block it stands in (0: none).
Piece = tuple[str, int]
Expression = Callable[[dict], Any]
Statement = Callable[[dict], Iterator[Piece]]


class TemplateError(ValueError):
    """A template that can't be compiled, or a conversation that it refuses."""


class Undefined:
    """A name or field that isn't there: empty as text, false as a condition."""

    def __bool__(self) -> bool:
        return False

    def __str__(self) -> str:
        return ""

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Undefined)

    def __hash__(self) -> int:
        return 0


UNDEFINED = Undefined()


# The syntax tree.
@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Call:
    """A function of its parts: operators, filters, tests, lists and fields. A pure one of constants is worked out once."""

    function: Callable
    parts: list
    pure: bool = True


@dataclass
class Choice:
    """``then if test else other``; ``and`` and ``or`` are choices that give one of their sides."""

    test: Any
    then: Any
    other: Any


@dataclass
class Either:
    left: Any
    right: Any
    is_and: bool


@dataclass
class Text:
    text: str


@dataclass
class Output:
    value: Any


@dataclass
class If:
    branches: list  # of (test, body)


@dataclass
class For:
    name: str
    over: Any
    body: list


@dataclass
class Set:
    name: str
    value: Any


@dataclass
class Generation:
    body: list


@dataclass
class Loop:
    """What ``loop`` is within a loop."""

    index0: int = 0
    last: bool = False
    previous: Any = UNDEFINED
    following: Any = UNDEFINED

    def field(self, name: str) -> Any:
        known = {"index0": self.index0, "index": self.index0 + 1, "first": self.index0 == 0, "last": self.last, "previtem": self.previous, "nextitem": self.following}
        return known.get(name, UNDEFINED)


def _text(x: Any) -> str:
    return "" if x is None else str(x)


def _item(value: Any, key: Any) -> Any:
    if isinstance(value, Loop):
        return value.field(key)
    if isinstance(value, Mapping):
        return value.get(key, UNDEFINED)
    if isinstance(value, (list, str)) and type(key) is int:
        return value[key] if -len(value) <= key < len(value) else UNDEFINED
    if isinstance(value, (list, str, int)):
        return UNDEFINED
    raise TemplateError(f"nothing to take {key!r} from")  # an undefined or null value, or messages, which are read one by one


def _plus(a: Any, b: Any) -> Any:
    if any(isinstance(x, (list, Mapping)) for x in (a, b)) or isinstance(a, str) != isinstance(b, str):
        raise TemplateError("+ takes two numbers or two texts")
    return a + b


def _refuse(message: Any) -> Any:
    raise TemplateError(_text(message))


FILTERS: dict[str, Callable] = {
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x) if isinstance(x, (str, list, Mapping)) else _refuse("no length"),
    "default": lambda x, other="": other if isinstance(x, Undefined) else x,
    "replace": lambda x, old, new: _text(x).replace(_text(old), _text(new)) if _text(old) else _text(x),
}
TESTS: dict[str, Callable] = {
    "defined": lambda x: not isinstance(x, Undefined),
    "undefined": lambda x: isinstance(x, Undefined),
    "none": lambda x: x is None,
    "string": lambda x: isinstance(x, str),
}
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


class Expressions:
    """Reads an expression from its source."""

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.tokens, self.at, self.filters, self.depth = [], 0, filters, 0
        at = 0
        while source[at:].strip():
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"not understood: {source[at:at + 20]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()

    def whole(self) -> Any:
        found = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return found

    def accept(self, *texts: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "name") and self.tokens[self.at][1] in texts:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def demand(self, text: str) -> None:
        if not self.accept(text):
            raise TemplateError(f"{text!r} is missing")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        found = self.tokens[self.at - 1][1]
        if found.startswith("_"):
            raise TemplateError(f"{found!r} is out of reach")
        return found

    def choice(self) -> Any:
        self.depth += 1
        if self.depth > DEEPEST:
            raise TemplateError("nested too deeply")
        found = self.disjunction()
        if self.accept("if"):
            test = self.disjunction()
            found = Choice(test, found, self.choice() if self.accept("else") else Const(UNDEFINED))
        self.depth -= 1
        return found

    def disjunction(self) -> Any:
        found = self.conjunction()
        while self.accept("or"):
            found = Either(found, self.conjunction(), False)
        return found

    def conjunction(self) -> Any:
        found = self.negation()
        while self.accept("and"):
            found = Either(found, self.negation(), True)
        return found

    def negation(self) -> Any:
        turns = 0
        while self.accept("not"):
            turns += 1
        found = self.comparison()
        return found if not turns else Call(operator.not_ if turns % 2 else bool, [found])

    def comparison(self) -> Any:
        found = self.joined()
        while True:
            if sign := self.accept(*_COMPARE):
                found = Call(_COMPARE[sign], [found, self.joined()])
            elif self.accept("is"):
                turned, test = self.accept("not"), TESTS.get(self.name())
                if test is None:
                    raise TemplateError("no such test")
                found = Call(test, [found])
                found = Call(operator.not_, [found]) if turned else found
            elif self.accept("in"):
                found = Call(lambda x, held: x in held, [found, self.joined()])
            elif self.at + 1 < len(self.tokens) and [t[1] for t in self.tokens[self.at : self.at + 2]] == ["not", "in"]:
                self.at += 2
                found = Call(lambda x, held: x not in held, [found, self.joined()])
            else:
                return found

    def joined(self) -> Any:
        found = self.added()
        while self.accept("~"):
            found = Call(lambda a, b: _text(a) + _text(b), [found, self.added()])
        return found

    def added(self) -> Any:
        found = self.rest()
        while sign := self.accept("+", "-"):
            found = Call(_plus if sign == "+" else operator.sub, [found, self.rest()])
        return found

    def rest(self) -> Any:
        found = self.filtered()
        while self.accept("%"):
            found = Call(lambda a, b: a % b if type(a) is int and type(b) is int and b else _refuse("% takes two numbers"), [found, self.filtered()])
        return found

    def filtered(self) -> Any:
        found = self.primary()
        while True:
            if self.accept("."):
                found = Call(_item, [found, Const(self.name())])
            elif self.accept("["):
                found = Call(_item, [found, self.choice()])
                self.demand("]")
            elif self.accept("|"):
                name = self.name()
                if name not in self.filters:
                    raise TemplateError(f"no filter {name!r}")
                found = Call(self.filters[name], [found, *(self.listed(")") if self.accept("(") else [])])
            else:
                return found

    def listed(self, end: str) -> list:
        parts = []
        while not self.accept(end):
            parts.append(self.choice())
            if not self.accept(","):
                self.demand(end)
                break
        return parts

    def primary(self) -> Any:
        if self.accept("("):
            found = self.choice()
            self.demand(")")
            return found
        if self.accept("["):
            return Call(lambda *x: list(x), self.listed("]"))
        if self.accept("-"):
            return Call(operator.neg, [self.primary()])
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, "")
        if kind == "number":
            self.at += 1
            return Const(int(text))
        if kind == "string":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.DOTALL))
        name = self.name()
        if name in ("true", "True", "false", "False", "none", "None"):
            return Const({"t": True, "f": False, "n": None}[name[0].lower()])
        if name == "raise_exception":
            self.demand("(")
            (message,) = self.listed(")") or [Const("refused")]
            return Call(_refuse, [message], pure=False)
        return Name(name)


class Statements:
    """Reads a template into a list of nodes."""

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        if len(source) > LONGEST_SOURCE:
            raise TemplateError("the template is too long")
        self.filters, self.parts, self.at = filters, [], 0
        end, strip = 0, False
        for found in _TAG.finditer(source):
            left, inner, right = next(g for g in (found.groups()[k : k + 3] for k in (0, 3, 6)) if g[1] is not None)
            self._add(source[end : found.start()], strip, bool(left))
            self.parts.append((found[0][1], inner.strip()))
            end, strip = found.end(), bool(right)
        self._add(source[end:], strip, False)

    def _add(self, text: str, left: bool, right: bool) -> None:
        text = text.lstrip() if left else text
        text = text.rstrip() if right else text
        if "{{" in text or "{%" in text or "{#" in text:
            raise TemplateError("a tag isn't closed")
        self.parts.append(("text", text))

    def expression(self, source: str) -> Any:
        return Expressions(source, self.filters).whole()

    def body(self, *ends: str, depth: int = 0) -> tuple[list, str, str]:
        """Nodes up to one of the statements ``ends``, that statement's word and the rest of it."""
        if depth > DEEPEST:
            raise TemplateError("nested too deeply")
        nodes: list = []
        while self.at < len(self.parts):
            kind, inner = self.parts[self.at]
            self.at += 1
            if kind == "text":
                nodes.append(Text(inner))
            elif kind == "{":
                nodes.append(Output(self.expression(inner)))
            elif kind == "%":
                word, _, rest = inner.partition(" ")
                if word in ends:
                    return nodes, word, rest
                nodes.append(self.statement(word, rest, depth))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return nodes, "", ""

    def statement(self, word: str, rest: str, depth: int) -> Any:
        if word == "if":
            branches, test = [], self.expression(rest)
            while True:
                body, ended, rest = self.body("elif", "else", "endif", depth=depth + 1)
                branches.append((test, body))
                if ended == "endif":
                    return If(branches)
                test = self.expression(rest) if ended == "elif" else Const(True)
        if word == "for":
            found = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.DOTALL)
            if not found:
                raise TemplateError("for name in values")
            return For(found[1], self.expression(found[2]), self.body("endfor", depth=depth + 1)[0])
        if word == "set":
            found = re.fullmatch(r"\s*([A-Za-z]\w*)\s*=(?!=)(.+)", rest, re.DOTALL)
            if not found:
                raise TemplateError("set name = value")
            return Set(found[1], self.expression(found[2]))
        if word == "generation":
            return Generation(self.body("endgeneration", depth=depth + 1)[0])
        raise TemplateError(f"no statement {word!r}")


def folded(node: Any) -> Any:
    """The tree with constant parts worked out: of expressions, of conditions, and of texts beside each other."""
    match node:
        case Call(function, parts, pure):
            parts = [folded(p) for p in parts]
            if not pure or not all(isinstance(p, Const) for p in parts):
                return Call(function, parts, pure)
            try:
                return Const(function(*(p.value for p in parts)))
            except (TypeError, IndexError) as wrong:
                raise TemplateError(str(wrong)) from wrong
        case Choice(test, then, other):
            test, then, other = folded(test), folded(then), folded(other)
            return (then if test.value else other) if isinstance(test, Const) else Choice(test, then, other)
        case Either(left, right, is_and):
            left, right = folded(left), folded(right)
            return (right if bool(left.value) == is_and else left) if isinstance(left, Const) else Either(left, right, is_and)
        case Output(value):
            value = folded(value)
            return Text(_text(value.value)) if isinstance(value, Const) else Output(value)
        case Set(name, value):
            return Set(name, folded(value))
        case For(name, over, body):
            return For(name, folded(over), folded(body))
        case Generation(body):
            return Generation(folded(body))
        case If(branches):
            kept = []
            for test, body in branches:
                test = folded(test)
                if isinstance(test, Const) and not test.value:
                    continue
                kept.append((test, folded(body)))
                if isinstance(test, Const):
                    break
            return If(kept)
        case list():
            out: list = []
            for one in map(folded, node):
                if isinstance(one, If) and (not one.branches or isinstance(one.branches[0][0], Const)):  # known to be taken or not
                    some = one.branches[0][1] if one.branches else []
                else:
                    some = [one]
                for x in some:
                    if isinstance(x, Text) and out and isinstance(out[-1], Text):
                        out[-1] = Text(out[-1].text + x.text)
                    elif not isinstance(x, Text) or x.text:
                        out.append(x)
            return out
    return node


def _expression(node: Any) -> Expression:
    match node:
        case Const(value):
            return lambda env: value
        case Name(name):
            return lambda env: env.get(name, UNDEFINED)
        case Call(function, [one]):
            only = _expression(one)
            return lambda env: function(only(env))
        case Call(function, [one, two]):
            first, second = _expression(one), _expression(two)
            return lambda env: function(first(env), second(env))
        case Call(function, parts):
            closures = [_expression(p) for p in parts]
            return lambda env: function(*(c(env) for c in closures))
        case Choice(test, then, other):
            asked, yes, no = _expression(test), _expression(then), _expression(other)
            return lambda env: yes(env) if asked(env) else no(env)
        case Either(left, right, is_and):
            a, b = _expression(left), _expression(right)
            return (lambda env: b(env) if a(env) else a(env)) if is_and else (lambda env: a(env) or b(env))
    raise TemplateError(f"no expression: {node!r}")


_BLOCK, _COUNT = "generation block", "generation count"  # no template can name these


def _statement(node: Any) -> Statement:
    match node:
        case Text(text):

            def plain(env: dict) -> Iterator[Piece]:
                yield text, env[_BLOCK]

            return plain
        case Output(value):
            shown = _expression(value)

            def output(env: dict) -> Iterator[Piece]:
                yield _text(shown(env)), env[_BLOCK]

            return output
        case Set(name, value):
            given = _expression(value)

            def assign(env: dict) -> Iterator[Piece]:
                env[name] = given(env)
                return iter(())

            return assign
        case Generation(body):
            inner = _block(body)

            def generation(env: dict) -> Iterator[Piece]:
                outer, env[_BLOCK] = env[_BLOCK], env[_BLOCK] or next(env[_COUNT])
                yield "", env[_BLOCK]
                yield from inner(env)
                env[_BLOCK] = outer

            return generation
        case If(branches):
            asked = [(_expression(test), _block(body)) for test, body in branches]

            def choose(env: dict) -> Iterator[Piece]:
                return next((body(env) for test, body in asked if test(env)), iter(()))

            return choose
        case For(name, over, body):
            values, inner = _expression(over), _block(body)

            def loop(env: dict) -> Iterator[Piece]:
                given = values(env)
                if isinstance(given, (str, Mapping)) or not isinstance(given, Iterable):
                    raise TemplateError("a loop runs over a list")
                items, before = iter(given), UNDEFINED
                now = next(items, UNDEFINED)
                for k in itertools.count():
                    if now is UNDEFINED:
                        return
                    following = next(items, UNDEFINED)
                    yield from inner(env | {name: now, "loop": Loop(k, following is UNDEFINED, before, following)})
                    before, now = now, following

            return loop
    raise TemplateError(f"no statement: {node!r}")


def _block(nodes: list) -> Statement:
    closures = [_statement(n) for n in nodes]
    if len(closures) == 1:
        return closures[0]

    def run(env: dict) -> Iterator[Piece]:
        for closure in closures:
            yield from closure(env)

    return run


def _loops(nodes: list, name: str, within: bool = False) -> int:
    """How many loops run over ``name``; one within another loop, which would run over an iterator again, is refused."""
    found = 0
    for node in nodes:
        if isinstance(node, For):
            mine = node.over == Name(name)
            if mine and within:
                raise TemplateError(f"{name} can be looped over once only")
            found += mine + _loops(node.body, name, True)
        elif isinstance(node, If):
            found += max((_loops(body, name, within) for _, body in node.branches), default=0)
        elif isinstance(node, Generation):
            found += _loops(node.body, name, within)
    return found


@dataclass
class Template:
    """A compiled template. ``filters`` are added to FILTERS and must be pure functions, as constants go through them at once."""

    source: str
    filters: Mapping[str, Callable] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.tree = folded(Statements(self.source, FILTERS | dict(self.filters)).body()[0])
        if _loops(self.tree, "messages") > 1:
            raise TemplateError("messages can be looped over once only")
        self.run = _block(self.tree)

    def pieces(self, messages: Iterable[Mapping[str, Any]], **given: Any) -> Iterator[Piece]:
        """The rendered text piece by piece, each with the number of its generation block, 0 outside of one."""
        try:
            yield from self.run({"messages": messages, _BLOCK: 0, _COUNT: itertools.count(1)} | given)
        except (TypeError, IndexError) as wrong:
            raise TemplateError(str(wrong)) from wrong

    def render(self, messages: Iterable[Mapping[str, Any]], **given: Any) -> str:
        return "".join(text for text, _ in self.pieces(messages, **given))
