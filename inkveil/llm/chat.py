"""Chat formatting by a template compiler.

A small template language is parsed into a syntax tree, constants are folded,
and the tree becomes Python closures that write a conversation turn by turn:

    {{ expression }}   {% if … %} {% elif … %} {% else %} {% endif %}
    {% for name in expression %} … {% endfor %}   {% set name = expression %}
    {% generation %} … {% endgeneration %}   marks what a model should learn

Expressions have strings, numbers, true, false, none, names, ``a.b``, ``a['b']``,
``loop.first``/``loop.index``, ``+ ~ == != in and or not``, parentheses and
filters (``| escape``).  It is a sandbox: names come from the given variables
only, ``.`` and ``[]`` look up keys of mappings and never Python attributes,
nothing can be called, filters are those of ``FILTERS``, and only given
sequences can be looped over, so every template ends.

Messages may be an iterator: conversations are rendered while they are read, so
memory is bounded by a turn, not by a conversation.

Edge cases: a NULL text or role is empty; turns alike are kept, in the order of
their role and text; NULL turns come first; rows with a NULL conv_id form one
conversation; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The default format's control strings; inside texts a backslash stands before each, and before each backslash.
TURN, END = "### ", "</turn>"
TEMPLATE = (
    "{% for message in messages %}"
    "{% if message.role == 'assistant' %}### Assistant: {% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% elif message.role == 'user' %}### User: {{ message.text | escape }}"
    "{% else %}### Role {{ message.role | escape_role }}: {{ message.text | escape }}{% endif %}"
    "</turn>\n"
    "{% endfor %}"
)
_NAMED = {"Assistant": "assistant", "User": "user"}

FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": functools.partial(re.compile(r"\\|###(?= )|</turn>").sub, lambda m: "\\" + m[0]),
    "escape_role": functools.partial(re.compile(r"[\\:]|###(?= )|</turn>").sub, lambda m: "\\" + m[0]),
    "trim": lambda value: value.strip(),
    "upper": lambda value: value.upper(),
    "lower": lambda value: value.lower(),
    "length": len,
}
_unescape = functools.partial(re.compile(r"\\(.)", re.S).sub, r"\1")


class TemplateError(ValueError):
    """The template does not parse, or asks for what the sandbox forbids."""


# Syntax tree.


@dataclass
class Node:
    """``kind`` and its arguments; for ``const`` the value."""

    kind: str
    args: tuple = ()


_TOKENS = re.compile(
    r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[-+~|.()\[\]=]))""",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_CONSTANTS = {"true": True, "false": False, "none": None}
_KEYWORDS = {"and", "or", "not", "in", "if", "else", "elif", "for", "set", *_CONSTANTS}


class Expression:
    """Reads one expression by precedence: or, and, not, comparison, join, filter, lookup."""

    def __init__(self, text: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            match = _TOKENS.match(text, at)
            if not match:
                raise TemplateError(f"can't read {text[at:]!r}")
            self.items.append((match.lastgroup, match[match.lastgroup]))
            at = match.end()
        self.at = 0

    def peek(self) -> str | None:
        if self.at < len(self.items) and self.items[self.at][0] in ("sign", "name"):
            return self.items[self.at][1]
        return None

    def take(self, *wanted: str) -> str | None:
        if (found := self.peek()) in wanted:
            self.at += 1
            return found
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def name(self) -> str:
        if self.at < len(self.items) and self.items[self.at][0] == "name":
            self.at += 1
            return self.items[self.at - 1][1]
        raise TemplateError("a name is missing")

    def done(self) -> None:
        if self.at < len(self.items):
            raise TemplateError(f"{self.items[self.at][1]!r} is too much")

    def either(self) -> Node:
        left = self.both()
        while self.take("or"):
            left = Node("or", (left, self.both()))
        return left

    def both(self) -> Node:
        left = self.negated()
        while self.take("and"):
            left = Node("and", (left, self.negated()))
        return left

    def negated(self) -> Node:
        return Node("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        left = self.joined()
        while sign := self.take("==", "!=", "in"):
            left = Node(sign, (left, self.joined()))
        return left

    def joined(self) -> Node:
        left = self.filtered()
        while sign := self.take("+", "~"):
            left = Node(sign, (left, self.filtered()))
        return left

    def filtered(self) -> Node:
        value = self.looked_up()
        while self.take("|"):
            if (name := self.name()) not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            value = Node("filter", (name, value))
        return value

    def looked_up(self) -> Node:
        value = self.atom()
        while sign := self.take(".", "["):
            if sign == ".":
                key = Node("const", (self.name(),))
            else:
                key = self.either()
                self.need("]")
            if key.kind == "const" and isinstance(key.args[0], str) and key.args[0].startswith("_"):
                raise TemplateError("names that begin with _ are closed")
            value = Node("get", (value, key))
        return value

    def atom(self) -> Node:
        if self.take("("):
            value = self.either()
            self.need(")")
            return value
        if self.at >= len(self.items):
            raise TemplateError("a value is missing")
        kind, text = self.items[self.at]
        self.at += 1
        if kind == "string":
            return Node("const", (re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S),))
        if kind == "number":
            return Node("const", (int(text),))
        if kind == "name" and text in _CONSTANTS:
            return Node("const", (_CONSTANTS[text],))
        if kind == "name" and text not in _KEYWORDS and not text.startswith("_"):
            return Node("name", (text,))
        raise TemplateError(f"{text!r} is no value")


def expression(text: str) -> Node:
    reader = Expression(text)
    node = reader.either()
    reader.done()
    return fold(node)


def fold(node: Node) -> Node:
    """Replace what has only constants below by its value."""
    if node.kind in ("const", "name", "text"):
        return node
    parts = tuple(fold(a) if isinstance(a, Node) else a for a in node.args)
    node = Node(node.kind, parts)
    below = [a for a in parts if isinstance(a, Node)]
    if node.kind != "get" and all(a.kind == "const" for a in below):
        return Node("const", (value_of(node)({}),))
    if node.kind in ("and", "or") and below[0].kind == "const":
        return below[1] if bool(below[0].args[0]) == (node.kind == "and") else below[0]
    return node


def parse(template: str) -> Node:
    """The syntax tree of a template, with constants folded and texts that follow each other joined."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.S)
    pieces = [p for p in parts if p]
    at = 0

    def block(*ends: str) -> tuple[Node, str, str]:
        nonlocal at
        body: list[Node] = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.startswith("{{"):
                body.append(Node("print", (expression(piece[2:-2]),)))
            elif piece.startswith("{%"):
                word, _, rest = piece[2:-2].strip().partition(" ")
                if word in ends:
                    return Node("block", tuple(smooth(body))), word, rest
                body.append(statement(word, rest))
            else:
                body.append(Node("text", (piece,)))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return Node("block", tuple(smooth(body))), "", ""

    def statement(word: str, rest: str) -> Node:
        if word == "if":
            test = expression(rest)
            yes, end, more = block("elif", "else", "endif")
            if end == "elif":
                no = statement("if", more)
            else:
                no = block("endif")[0] if end == "else" else Node("block")
            if test.kind == "const":
                return yes if test.args[0] else no
            return Node("if", (test, yes, no))
        if word == "for":
            name, _, items = rest.partition(" in ")
            if not name.strip().isidentifier() or name.strip() in _KEYWORDS:
                raise TemplateError(f"{name!r} can't be a loop's name")
            items = expression(items)
            return Node("for", (name.strip(), items, block("endfor")[0]))
        if word == "set":
            name, _, value = rest.partition("=")
            if not name.strip().isidentifier() or name.strip() in _KEYWORDS:
                raise TemplateError(f"{name!r} can't be set")
            return Node("set", (name.strip(), expression(value)))
        if word == "generation":
            return Node("generation", (block("endgeneration")[0],))
        raise TemplateError(f"no statement {word!r}")

    return block()[0]


def smooth(body: Iterable[Node]) -> Iterator[Node]:
    """Constants printed become text; blocks open up; texts that follow each other become one."""
    flat: list[Node] = []
    for node in body:
        if node.kind == "print" and node.args[0].kind == "const":
            node = Node("text", (shown(node.args[0].args[0]),))
        flat += node.args if node.kind == "block" else [node]
    for is_text, group in itertools.groupby(flat, lambda n: n.kind == "text"):
        if is_text:
            if text := "".join(n.args[0] for n in group):
                yield Node("text", (text,))
        else:
            yield from group


# Closures.


def shown(value: Any) -> str:
    return "" if value is None else str(value)


def _get(holder: Any, key: Any) -> Any:
    return holder.get(key) if isinstance(holder, Mapping) else None


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "~": lambda a, b: shown(a) + shown(b),
    "get": _get,
}


def value_of(node: Node) -> Callable[[dict], Any]:
    """The closure that gives an expression's value."""
    if node.kind == "const":
        value = node.args[0]
        return lambda names: value
    if node.kind == "name":
        name = node.args[0]
        return lambda names: names.get(name)
    if node.kind == "filter":
        apply, inner = FILTERS[node.args[0]], value_of(node.args[1])
        return lambda names: apply(inner(names))
    if node.kind == "not":
        inner = value_of(node.args[0])
        return lambda names: not inner(names)
    left, right = map(value_of, node.args)
    if node.kind == "and":
        return lambda names: left(names) and right(names)
    if node.kind == "or":
        return lambda names: left(names) or right(names)
    combine = _BINARY[node.kind]
    return lambda names: combine(left(names), right(names))


Writer = Callable[[dict, Callable[[str, bool], None], bool], None]


def writer_of(node: Node) -> Writer:
    """The closure that writes a statement: ``write(names, out, generated)`` calls ``out(text, generated)``."""
    if node.kind == "text":
        text = node.args[0]
        return lambda names, out, marked: out(text, marked)
    if node.kind == "print":
        value = value_of(node.args[0])
        return lambda names, out, marked: out(shown(value(names)), marked)
    if node.kind == "set":
        name, value = node.args[0], value_of(node.args[1])
        return lambda names, out, marked: names.__setitem__(name, value(names))
    if node.kind == "generation":
        inner = writer_of(node.args[0])
        return lambda names, out, marked: inner(names, out, True)
    if node.kind == "if":
        test, yes, no = value_of(node.args[0]), writer_of(node.args[1]), writer_of(node.args[2])
        return lambda names, out, marked: (yes if test(names) else no)(names, out, marked)
    if node.kind == "for":
        name, items, body = node.args[0], value_of(node.args[1]), writer_of(node.args[2])

        def loop(names: dict, out: Callable[[str, bool], None], marked: bool) -> None:
            inner = dict(names)
            for index, item in enumerate(items(names) or ()):
                inner[name] = item
                inner["loop"] = {"index": index + 1, "first": index == 0}
                body(inner, out, marked)

        return loop
    writers = [writer_of(n) for n in node.args]

    def block(names: dict, out: Callable[[str, bool], None], marked: bool) -> None:
        for write in writers:
            write(names, out, marked)

    return block


@functools.lru_cache(maxsize=16)
def compiled(template: str) -> Writer:
    return writer_of(parse(template))


def render(template: str, messages: Iterable[Mapping[str, str]], **names: Any) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (code points) that a model should learn."""
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0

    def out(text: str, marked: bool) -> None:
        nonlocal at
        parts.append(text)
        if marked and text:
            joins = spans and spans[-1][1] == at
            spans[-1:] = [(spans[-1][0], at + len(text))] if joins else [*spans[-1:], (at, at + len(text))]
        at += len(text)

    compiled(template)({**names, "messages": messages}, out, False)
    return "".join(parts), spans


# Reading back the default format.


@dataclass
class Reader:
    """Reads formatted text in pieces of any size; holds one turn at most."""

    on_turn: Callable[[str, str, str], None]
    text: list[str] = field(default_factory=list)
    marked: list[str] = field(default_factory=list)
    chars: int = 0
    _end = re.compile(r"\\.|</turn>\n", re.S)

    def feed(self, text: str, marked: bool) -> None:
        self.chars += len(text)
        self.text.append(text)
        if marked:
            self.marked.append(text)
        elif END in text:
            self.turns()

    def turns(self) -> None:
        """Take all whole turns; a mask belongs to the turn that it lies in, and turns end outside masks."""
        whole, at = "".join(self.text), 0
        for match in self._end.finditer(whole):
            if match[0][0] != "\\":
                head, body = re.match(r"(?s)### ((?:\\.|[^\\:])*): (.*)", whole[at : match.start()]).groups()
                role = _NAMED.get(head)
                self.on_turn(_unescape(head.removeprefix("Role ")) if role is None else role, _unescape(body), _unescape("".join(self.marked)))
                self.marked.clear()
                at = match.end()
        self.text[:] = [whole[at:]]


_DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def digest(messages: Iterable[Mapping[str, str]], template: str = TEMPLATE) -> tuple[int, str, int, str, int]:
    """Render, read back, and digest what was read, all turn by turn."""
    turns, loss = hashlib.sha256(), hashlib.sha256()
    n = chars = 0

    def on_turn(role: str, text: str, learned: str) -> None:
        nonlocal n, chars
        n, chars = n + 1, chars + len(learned)
        turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        loss.update(learned.encode("utf-8", "surrogatepass"))

    reader = Reader(on_turn)
    compiled(template)({"messages": messages}, reader.feed, False)
    reader.turns()
    return n, turns.hexdigest(), chars, loss.hexdigest(), reader.chars


def formatted_digests(conversations: DataFrame) -> DataFrame:
    """Per conversation the digests of its formatted form; rows are sorted, spilling, and rendered as they stream by."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, dict[str, str]]]:
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                yield conv, {"role": role or "", "text": text or ""}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = ((conv, *digest(m for _, m in group)) for conv, group in itertools.groupby(rows(batches), lambda r: r[0]))
        while some := list(itertools.islice(done, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), _DIGESTS)], schema=_DIGESTS)

    chosen = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    ordered = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
