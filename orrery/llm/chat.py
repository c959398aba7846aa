"""Chat formatting with a small sandboxed template compiler.

A template is parsed into a syntax tree, constants are folded, and the tree becomes nested
Python closures; no ``eval``, no attribute access, no calls beyond the listed filters.

Language: text, ``{{ expr }}``, ``{% for x in e %}..{% endfor %}`` (with ``loop.index``,
``loop.first``, ``loop.last``), ``{% if e %}..{% elif e %}..{% else %}..{% endif %}``,
``{% set x = e %}``, ``{% generation %}..{% endgeneration %}`` (text under the loss mask),
``{# comment #}``.  Expressions: strings, integers, ``true false none``, names, ``a.b`` and
``a['b']`` on mappings, ``~`` and ``+``, ``-``, comparisons, ``in``, ``and or not``, and
filters ``e | trim | upper | lower | length | default(x) | escape``.  ``escape`` makes control
strings harmless and can be undone.

Rendering is a stream of pieces, and a loop reads its items one by one, so a conversation of
any length is formatted and read back in the memory of its longest turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that steer the format; they never appear unescaped inside a role or a text.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")

#: One turn: role between the brackets, text up to the end mark.
TURNS = (
    "{{ '<s>' }}{% for m in messages %}[INST]{{ m.role | escape }}[/INST]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ '</s>' }}{% endfor %}"
)

_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))


def escape(text: str) -> str:
    """Double backslashes, and put one after the first character of every control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """The exact inverse of ``escape``."""
    return re.sub(r"\\(\\?)", r"\1", text)


class TemplateError(ValueError):
    """The template is not in the language, or it steps outside the sandbox."""


# --- tree -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Out:
    expr: Any


@dataclass(frozen=True)
class For:
    name: str
    items: Any
    body: tuple


@dataclass(frozen=True)
class If:
    tests: tuple  # of (expr, body)


@dataclass(frozen=True)
class Set:
    name: str
    expr: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parsing --------------------------------------------------------------------------

_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKENS = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>()\[\].,|=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None}


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *wanted: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in wanted

    def take(self, *wanted: str) -> str | None:
        if self.peek(*wanted):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"expected {wanted!r}")

    def word(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("expected a name")

    def end(self, node: Any) -> Any:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def expr(self) -> Any:
        left = self.both()
        while self.take("or"):
            left = Op("or", (left, self.both()))
        return left

    def both(self) -> Any:
        left = self.negated()
        while self.take("and"):
            left = Op("and", (left, self.negated()))
        return left

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        left = self.joined()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            left = Op(op, (left, self.joined()))
        return left

    def joined(self) -> Any:
        left = self.filtered()
        while op := self.take("~", "+", "-"):
            left = Op(op, (left, self.filtered()))
        return left

    def filtered(self) -> Any:
        node = self.reached()
        while self.take("|"):
            name, args = self.word(), ()
            if self.take("("):
                args = (self.expr(),)
                self.need(")")
            if name not in FILTERS or len(args) != (name == "default"):
                raise TemplateError(f"no filter {name!r} of this form")
            node = Op(f"|{name}", (node, *args))
        return node

    def reached(self) -> Any:
        node = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                node = Item(node, Const(self.word()))
            else:
                node = Item(node, self.expr())
                self.need("]")
        return node

    def atom(self) -> Any:
        if self.take("("):
            node = self.expr()
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends too soon")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(value))
        if kind == "name":
            return Const(_WORDS[value]) if value in _WORDS else Name(value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts, at = [], 0
    for m in _TAGS.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        if m[1] is not None:
            parts.append(("out", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    body, rest, stop = _body(parts, 0, ())
    if stop:
        raise TemplateError(f"unexpected {stop!r}")
    return body


def _body(parts: list, at: int, ends: tuple) -> tuple[tuple, int, str]:
    nodes: list = []
    while at < len(parts):
        kind, value = parts[at]
        at += 1
        if kind == "text":
            nodes.append(Text(value))
            continue
        if kind == "out":
            e = _Expression(value)
            nodes.append(Out(e.end(e.expr())))
            continue
        word, _, rest = value.partition(" ")
        if word in ends:
            return tuple(nodes), at, value
        e = _Expression(rest)
        if word == "for":
            name = e.word()
            e.need("in")
            items = e.end(e.expr())
            body, at, stop = _body(parts, at, ("endfor",))
            if not stop:
                raise TemplateError("for without endfor")
            nodes.append(For(name, items, body))
        elif word == "if":
            tests, test = [], e.end(e.expr())
            while True:
                body, at, stop = _body(parts, at, ("elif", "else", "endif"))
                if not stop:
                    raise TemplateError("if without endif")
                tests.append((test, body))
                if stop == "endif":
                    break
                e = _Expression(stop[4:])
                test = e.end(e.expr()) if stop.startswith("elif") else Const(True)
            nodes.append(If(tuple(tests)))
        elif word == "set":
            name = e.word()
            e.need("=")
            nodes.append(Set(name, e.end(e.expr())))
        elif word == "generation":
            body, at, stop = _body(parts, at, ("endgeneration",))
            if not stop:
                raise TemplateError("generation without endgeneration")
            nodes.append(Generation(body))
        else:
            raise TemplateError(f"no tag {word!r}")
    return tuple(nodes), at, ""


# --- folding and code -----------------------------------------------------------------


def _string(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


FILTERS: dict[str, Callable] = {
    "trim": lambda v: _string(v).strip(),
    "upper": lambda v: _string(v).upper(),
    "lower": lambda v: _string(v).lower(),
    "length": lambda v: len(v) if v is not None else 0,
    "default": lambda v, other: other if v is None else v,
    "escape": lambda v: escape(_string(v)),
}
_OPS: dict[str, Callable] = {
    "~": lambda a, b: _string(a) + _string(b),
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "not": lambda a: not a,
    **{f"|{n}": f for n, f in FILTERS.items()},
}


def fold(node: Any) -> Any:
    """The same tree with constant parts computed and neighbouring text joined."""
    if isinstance(node, tuple):
        out: list = []
        for n in map(fold, node):
            if isinstance(n, tuple):
                out.extend(n)
                continue
            if isinstance(n, Text) and out and isinstance(out[-1], Text):
                n = Text(out.pop().value + n.value)
            if n != Text(""):
                out.append(n)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if node.op in ("and", "or"):
            if isinstance(args[0], Const):
                return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        elif all(isinstance(a, Const) for a in args):
            try:
                return Const(_OPS[node.op](*(a.value for a in args)))
            except TypeError as e:
                raise TemplateError(str(e)) from e
        return Op(node.op, args)
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    if isinstance(node, Out):
        e = fold(node.expr)
        return Text(_string(e.value)) if isinstance(e, Const) else Out(e)
    if isinstance(node, For):
        return For(node.name, fold(node.items), fold(node.body))
    if isinstance(node, Set):
        return Set(node.name, fold(node.expr))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        tests = []
        for test, body in node.tests:
            test, body = fold(test), fold(body)
            if isinstance(test, Const):
                if not test.value:
                    continue
                if not tests:
                    return body
                tests.append((test, body))
                break
            tests.append((test, body))
        return If(tuple(tests)) if tests else ()
    return node


def _value(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name

        def named(scope: dict) -> Any:
            if name not in scope:
                raise TemplateError(f"no variable {name!r}")
            return scope[name]

        return named
    if isinstance(node, Item):
        of, key = _value(node.of), _value(node.key)

        def item(scope: dict) -> Any:
            found = of(scope)
            return found.get(key(scope)) if isinstance(found, dict) else None  # mappings only

        return item
    if node.op in ("and", "or"):
        a, b = map(_value, node.args)
        return (lambda scope: a(scope) and b(scope)) if node.op == "and" else (lambda scope: a(scope) or b(scope))
    run, args = _OPS[node.op], tuple(map(_value, node.args))
    if len(args) == 1:
        only = args[0]
        return lambda scope: run(only(scope))
    first, second = args
    return lambda scope: run(first(scope), second(scope))


Piece = tuple[str, bool]


def _code(nodes: tuple, mask: bool) -> Callable[[dict], Iterator[Piece]]:
    return _sequence([_statement(n, mask) for n in nodes])


def _sequence(steps: list) -> Callable[[dict], Iterator[Piece]]:
    def run(scope: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)

    return run


def _statement(node: Any, mask: bool) -> Callable[[dict], Iterable[Piece]]:
    if isinstance(node, Text):
        said = ((node.value, mask),)
        return lambda scope: said
    if isinstance(node, Out):
        value = _value(node.expr)
        return lambda scope: ((_string(value(scope)), mask),)
    if isinstance(node, Generation):
        return _code(node.body, True)
    if isinstance(node, Set):
        name, value = node.name, _value(node.expr)

        def put(scope: dict) -> Iterable[Piece]:
            scope[name] = value(scope)
            return ()

        return put
    if isinstance(node, If):
        tests = [(_value(t), _code(b, mask)) for t, b in node.tests]

        def choose(scope: dict) -> Iterable[Piece]:
            for test, body in tests:
                if test(scope):
                    return body(scope)
            return ()

        return choose
    name, items, body = node.name, _value(node.items), _code(node.body, mask)

    def loop(scope: dict) -> Iterator[Piece]:
        source = iter(items(scope) or ())
        end = object()
        item, index = next(source, end), 1
        while item is not end:
            after = next(source, end)
            yield from body({**scope, name: item, "loop": {"index": index, "first": index == 1, "last": after is end}})
            item, index = after, index + 1

    return loop


def compile_template(source: str) -> Callable[[dict], Iterator[Piece]]:
    """A function from variables to pieces of text, each with its loss mask."""
    return _code(fold(parse(source)), False)


# --- reading back ---------------------------------------------------------------------


class TurnReader:
    """Reads ``TURNS`` output piece by piece: yields (role, text) as each turn ends."""

    _END = "</s>"

    def __init__(self) -> None:
        self.rest, self.begun = "", False

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        self.rest += text
        while True:
            if not self.begun:
                if len(self.rest) < 3:
                    return
                if not self.rest.startswith("<s>"):
                    raise ValueError("the output does not begin with <s>")
                self.rest, self.begun = self.rest[3:], True
            end = self.rest.find(self._END)
            if end < 0:
                return
            turn, self.rest = self.rest[:end], self.rest[end + len(self._END) :]
            head, mark, body = turn.partition("[/INST]")
            if not head.startswith("[INST]") or not mark:
                raise ValueError("a turn without a header")
            yield unescape(head[6:]), unescape(body)


# --- Spark ----------------------------------------------------------------------------


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Any, Iterator[dict]]]:
    """Sorted rows as conversations; each must be read before the next."""
    rows = (
        {"conv_id": c, "role": r or "", "text": t or ""}
        for batch in batches
        for c, r, t in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist())
    )
    ahead = next(rows, None)
    while ahead is not None:
        conv = ahead["conv_id"]

        def turns() -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and ahead["conv_id"] == conv:
                row, ahead = ahead, next(rows, None)
                yield row

        stream = turns()
        yield conv, stream
        for _ in stream:
            pass


def _dealt(turns: DataFrame) -> DataFrame:
    """Each conversation in order on one task; a task streams, whatever their length."""
    rows = turns.select("conv_id", "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()).select("conv_id", "role", "text")


def format_conversations(turns: DataFrame, template: str = TURNS) -> DataFrame:
    """Pieces of every formatted conversation: ``conv_id, piece, text, in_loss``.

    Pieces in order make the output; neighbours under the same mask are joined up to 64 KiB,
    so a row stays small.  Nulls in role or text count as empty, null turns come first, equal
    turns go by role and text, and rows with a null conv_id are one conversation.
    """
    render = compile_template(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.bool_()))]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["conv_id", "piece", "text", "in_loss"])

        for conv, stream in _conversations(batches):
            number, held, size, masked = 0, [], 0, False
            for text, mask in render({"messages": stream}):
                if held and (mask != masked or size > 65536):
                    out.append((conv, number, "".join(held), masked))
                    number, held, size = number + 1, [], 0
                    if len(out) >= 1000:
                        yield flush()
                masked, size = mask, size + len(text)
                held.append(text)
            if held:
                out.append((conv, number, "".join(held), masked))
        if out:
            yield flush()

    return _dealt(turns).mapInArrow(run, "conv_id long, piece long, text string, in_loss boolean")


def read_back(turns: DataFrame) -> DataFrame:
    """Format with ``TURNS``, read the output again, and sum up what came back.

    One row a conversation: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars``.  Cases as in ``format_conversations``; an empty table gives no rows.  A
    conversation is read by one task, since its digests go in order, but as a stream: what is
    held is one turn.  Other columns are left out.
    """
    render = compile_template(TURNS)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for conv, stream in _conversations(batches):
            reader, n, total, lost = TurnReader(), 0, 0, 0
            all_turns, loss = hashlib.sha256(), hashlib.sha256()
            for text, mask in render({"messages": stream}):
                total += len(text)
                if mask:
                    said = unescape(text)
                    lost += len(said)
                    loss.update(said.encode())
                for role, body in reader.feed(text):
                    n += 1
                    all_turns.update(f"{role}\n{body}\n".encode())
            if reader.rest:
                raise ValueError("the output ends inside a turn")
            rows.append((conv, n, all_turns.hexdigest(), lost, loss.hexdigest(), total))
            if len(rows) >= 1000:
                yield flush()
        if rows:
            yield flush()

    return _dealt(turns).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
