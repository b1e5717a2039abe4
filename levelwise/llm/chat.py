"""Chat formatting with compiled templates.

A template is parsed into a small syntax tree, constant parts are folded, and every node
becomes a Python closure. The language is a sandbox: it has variables, their fields and
subscripts, literals, lists, comparisons, ``in``, ``is defined``, ``and``/``or``/``not``, ``+``, ``-``, ``%``, the filters
below, ``if``, ``for`` and ``generation``; there are no calls, attributes or imports. A field is a key of a
mapping, never an attribute; a missing key or place is none. A dash inside a mark, as in ``{%- if e -%}``, takes the
blanks beside it away. Texts in quotes may hold ``\\n``, ``\\t`` and escaped quotes.

    {{ expression | filter }}      {# comment #}
    {% for m in messages %} ... {% endfor %}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}      marks text that is trained on

Rendering yields pieces (text, generated), so a conversation is never held whole: its turns
stream through the loop. Tasks get conversations sorted by turn and emit one part for each turn.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelwise.llm.common import slices, text_of

#: Control strings contain these; escaping them leaves no control string in a text.
_ESCAPES = {"\\": "\\\\", "<": "\\l", "#": "\\h", "\n": "\\n"}
_UNESCAPES = {v[1]: k for k, v in _ESCAPES.items()}


def escape(text: str) -> str:
    return re.sub(r"[\\<#\n]", lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _UNESCAPES[m[1]], text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape,
    "trim": str.strip,
    "upper": str.upper,
    "lower": str.lower,
    "title": str.title,
}

#: Turns as ``### role:`` ... ``</turn>``; the assistant's texts are trained on.
TURN_TEMPLATE = (
    "{% for m in messages %}### {{ m.role | escape }}:\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
)

Scope = dict
Piece = tuple[str, bool]


class TemplateError(ValueError):
    """A template that does not parse."""


# ---- Expressions: ("const", v), ("name", path), (operator, parts...), ("filter", f, e)

_TOKEN = re.compile(
    r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_][\w.]*)"
    r"|(?P<sign>==|!=|<=|>=|[|()+\[\],.<>%-]))",
    re.DOTALL,
)
#: Escapes inside quotes; any other escaped character is itself.
_QUOTED = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over one expression, weakest binding first."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][1] in values and self.tokens[self.at][0] != "text":
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def parse(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self):
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        tree = self.joined()
        while True:
            if sign := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                tree = (sign, tree, self.joined())
            elif self.take("is"):
                kind = "undefined" if self.take("not") else "defined"
                if not self.take("defined"):
                    raise TemplateError("only 'is defined' is known")
                tree = (kind, tree)
            elif self.take("not"):
                if not self.take("in"):
                    raise TemplateError("'not' without 'in'")
                tree = ("not", ("in", tree, self.joined()))
            else:
                return tree

    def joined(self):
        tree = self.divided()
        while sign := self.take("+", "-"):
            tree = (sign, tree, self.divided())
        return tree

    def divided(self):
        tree = self.filtered()
        while self.take("%"):
            tree = ("%", tree, self.filtered())
        return tree

    def filtered(self):
        tree = self.placed()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            tree = ("filter", name, tree)
        return tree

    def placed(self):
        tree = self.single()
        while sign := self.take("[", "."):
            if sign == ".":
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "name":
                    raise TemplateError("missing field")
                self.at += 1
                for part in name.split("."):
                    tree = ("at", tree, ("const", part))
                continue
            tree = ("at", tree, self.either())
            if not self.take("]"):
                raise TemplateError("missing ]")
        return tree

    def single(self):
        if self.take("-"):
            return ("-", ("const", 0), self.single())
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.either())
                if not self.take(",") and (self.at >= len(self.tokens) or self.tokens[self.at] != ("sign", "]")):
                    raise TemplateError("missing ]")
            return ("list", *items)
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return tree
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return ("const", re.sub(r"\\(.)", lambda m: _QUOTED.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "number":
            return ("const", int(value))
        if kind == "name":
            words = {"true": True, "false": False, "none": None}
            return ("const", words[value]) if value in words else ("name", value.split("."))
        raise TemplateError(f"unexpected {value!r}")


def _value(path: list[str]) -> Callable[[Scope], object]:
    def get(scope: Scope) -> object:
        value: object = scope
        for part in path:
            value = value.get(part) if isinstance(value, dict) else None
        return value

    return get


def _text(value: object) -> str:
    return "" if value is None else str(value)


def _numbers(operator: Callable[[int, int], object]) -> Callable:
    """``operator`` of two whole numbers; none for anything else."""
    return lambda a, b: operator(a, b) if isinstance(a, int) and isinstance(b, int) else None


def _ordered(operator: Callable) -> Callable:
    """A comparison of two numbers or two texts; false for anything else."""
    alike = lambda a, b: all(isinstance(x, int) for x in (a, b)) or all(isinstance(x, str) for x in (a, b))
    return lambda a, b: alike(a, b) and operator(a, b)


def _inside(item: object, whole: object) -> bool:
    if isinstance(whole, str):
        return isinstance(item, str) and item in whole
    return isinstance(whole, (list, tuple, dict)) and item in whole


def _at(whole: object, place: object) -> object:
    """A key of a mapping or a place of a list or text; none if there is none."""
    if isinstance(whole, dict):
        return whole.get(place) if isinstance(place, (str, int)) else None
    if isinstance(whole, (list, tuple, str)) and isinstance(place, int) and -len(whole) <= place < len(whole):
        return whole[place]
    return None


_OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": _ordered(operator.lt),
    "<=": _ordered(operator.le),
    ">": _ordered(operator.gt),
    ">=": _ordered(operator.ge),
    "-": _numbers(operator.sub),
    "%": _numbers(lambda a, b: a % b if b else None),
    "in": _inside,
    "at": _at,
    "list": lambda *items: list(items),
    "defined": lambda a: a is not None,
    "undefined": lambda a: a is None,
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
}


def fold(tree: tuple) -> tuple:
    """The expression with every part that has no variable computed."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "filter":
        inner = fold(tree[2])
        done = inner[0] == "const"
        return ("const", FILTERS[tree[1]](_text(inner[1]))) if done else (kind, tree[1], inner)
    parts = [fold(p) for p in tree[1:]]
    if all(p[0] == "const" for p in parts):
        return ("const", evaluate((kind, *parts))({}))
    return (kind, *parts)


def evaluate(tree: tuple) -> Callable[[Scope], object]:
    """The closure of an expression."""
    kind = tree[0]
    if kind == "const":
        return lambda scope, value=tree[1]: value
    if kind == "name":
        return _value(tree[1])
    if kind == "filter":
        apply, inner = FILTERS[tree[1]], evaluate(tree[2])
        return lambda scope: apply(_text(inner(scope)))
    parts = [evaluate(p) for p in tree[1:]]
    if kind == "not":
        return lambda scope: not parts[0](scope)
    if kind == "and":
        return lambda scope: parts[0](scope) and parts[1](scope)
    if kind == "or":
        return lambda scope: parts[0](scope) or parts[1](scope)
    apply = _OPERATORS[kind]
    return lambda scope: apply(*[p(scope) for p in parts])


# ---- Blocks: ("text", s), ("put", e), ("for", name, e, body), ("if", [(e, body)]), ("gen", body)

# A dash at a mark takes the blanks on its side with it.
_MARKUP = re.compile(
    r"(?:\s*(?=\{\{-|\{%-|\{#-))?(?:\{\{-?(.*?)(?:-\}\}\s*|\}\})|\{%-?(.*?)(?:-%\}\s*|%\})|\{#.*?(?:-#\}\s*|#\}))", re.DOTALL
)


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template."""
    root: list[tuple] = []
    # Open blocks: (word that ends it, body that is filled).
    stack: list[tuple[str, list]] = [("", root)]
    at = 0

    def branch(test: tuple) -> None:
        body: list[tuple] = []
        stack[-2][1][-1][1].append((test, body))
        stack[-1] = ("endif", body)

    for found in _MARKUP.finditer(source):
        stack[-1][1].append(("text", source[at : found.start()]))
        at = found.end()
        if found[1] is not None:
            stack[-1][1].append(("put", _Expression(found[1]).parse()))
        if found[2] is None:
            continue
        word, _, rest = found[2].strip().partition(" ")
        if word == "for":
            named = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)
            if not named:
                raise TemplateError(f"cannot read for {rest!r}")
            body = []
            stack[-1][1].append(("for", named[1], _Expression(named[2]).parse(), body))
            stack.append(("endfor", body))
        elif word == "if":
            stack[-1][1].append(("if", []))
            stack.append(("endif", []))
            branch(_Expression(rest).parse())
        elif word in ("elif", "else") and stack[-1][0] == "endif":
            branch(_Expression(rest).parse() if word == "elif" else ("const", True))
        elif word == "generation":
            body = []
            stack[-1][1].append(("gen", body))
            stack.append(("endgeneration", body))
        elif word == stack[-1][0]:
            stack.pop()
        else:
            raise TemplateError(f"unexpected {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"missing {stack[-1][0]}")
    root.append(("text", source[at:]))
    return root


def simplify(nodes: list[tuple]) -> list[tuple]:
    """The tree with folded expressions, decided branches and joined texts."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            node = ("text", out.pop()[1] + node[1])
        if node != ("text", ""):
            out.append(node)

    for node in nodes:
        if node[0] == "put":
            tree = fold(node[1])
            add(("text", _text(tree[1])) if tree[0] == "const" else ("put", tree))
        elif node[0] == "for":
            add(("for", node[1], fold(node[2]), simplify(node[3])))
        elif node[0] == "gen":
            add(("gen", simplify(node[1])))
        elif node[0] == "if":
            branches = []
            for test, body in ((fold(t), simplify(b)) for t, b in node[1]):
                if test[0] != "const" or test[1]:
                    branches.append((test, body))
                if test[0] == "const" and test[1]:
                    break
            if branches and branches[0][0][0] == "const":
                for inner in branches[0][1]:
                    add(inner)
            elif branches:
                add(("if", branches))
        else:
            add(node)
    return out


def _with_last(items: Iterable) -> Iterator[tuple[int, object, bool]]:
    """Items with their number and whether they are the last, one item ahead only."""
    items, index = iter(items), 0
    for item in items:
        for nxt in items:
            yield index, item, False
            item, index = nxt, index + 1
        yield index, item, True


def closure(nodes: list[tuple], generated: bool = False) -> Callable[[Scope], Iterator[Piece]]:
    """The closure of a list of nodes; calling it with a scope renders."""
    steps: list[Callable[[Scope], Iterator[Piece]]] = []
    for node in nodes:
        if node[0] == "text":
            steps.append(lambda scope, piece=(node[1], generated): iter((piece,)))
        elif node[0] == "put":
            steps.append(lambda scope, get=evaluate(node[1]): iter(((_text(get(scope)), generated),)))
        elif node[0] == "gen":
            steps.append(closure(node[1], True))
        elif node[0] == "if":
            branches = [(evaluate(t), closure(b, generated)) for t, b in node[1]]

            def choose(scope, branches=branches):
                return next((body(scope) for test, body in branches if test(scope)), iter(()))

            steps.append(choose)
        else:

            def loop(scope, name=node[1], items=evaluate(node[2]), body=closure(node[3], generated)):
                for index, item, last in _with_last(items(scope) or ()):
                    inner = {"index": index, "first": index == 0, "last": last}
                    yield from body({**scope, name: item, "loop": inner})

            steps.append(loop)

    def render(scope: Scope) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)

    return render


def compile_template(source: str) -> Callable[[Scope], Iterator[Piece]]:
    """Parses, folds and compiles; raises :class:`TemplateError` for a faulty template."""
    return closure(simplify(parse(source)))


# ---- On Spark

_PARTS = "conv_id long, part long, text string, mask array<struct<start:int,end:int>>"
_PARTS_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("part", pa.int64()),
        ("text", pa.string()),
        ("mask", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)
#: A part is closed after so many characters, at the end of a piece.
PART_CHARS = 64 << 10


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for whole in batches:
        for batch in slices(whole, 512):
            yield from batch.to_pylist()


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _parts(conv_id: int | None, pieces: Iterator[Piece]) -> Iterator[dict]:
    texts, mask, chars, part = [], [], 0, 0
    for text, generated in pieces:
        if generated and text:
            mask.append({"start": chars, "end": chars + len(text)})
        texts.append(text)
        chars += len(text)
        if chars >= PART_CHARS:
            yield {"conv_id": conv_id, "part": part, "text": "".join(texts), "mask": mask}
            texts, mask, chars, part = [], [], 0, part + 1
    if texts or not part:
        yield {"conv_id": conv_id, "part": part, "text": "".join(texts), "mask": mask}


def _formatter(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)

        def out():
            for conv_id, turns in groupby(_rows(batches), key=lambda r: r["conv_id"]):
                yield from _parts(conv_id, render({"messages": turns}))

        return _batched(out(), _PARTS_ARROW, 64)

    return run


def format_conversations(turns: DataFrame, template: str = TURN_TEMPLATE) -> DataFrame:
    """Formatted conversations in parts: ``conv_id``, ``part``, ``text``, ``mask``.

    The text of a conversation is that of its parts in order; ``mask`` has the trained stretches of a
    part, in characters. Parts are cut between pieces, so that a conversation of any
    length is streamed and not held. Turns come in order of ``turn``; ties by role and
    text; null turns first; a null role or text is empty; rows with a null conv_id form one conversation.
    """
    compile_template(template)  # a faulty template fails here and not in a task
    slim = turns.select(
        "conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text")
    )
    order = ["conv_id", "turn", "role", "text"]
    sorted_turns = slim.repartition("conv_id").sortWithinPartitions(*order)
    return sorted_turns.mapInArrow(_formatter(template), _PARTS)


_READ = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)
_READ_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ]
)

_TURN = re.compile(r"### (?P<role>[^\n]*):\n(?P<text>[^<]*)</turn>\n")


def _read_back(conv_id: int | None, parts: Iterator[dict]) -> dict:
    """Turns and mask from the formatted text alone, part by part."""
    turns, loss = hashlib.sha256(), hashlib.sha256()
    n = loss_chars = chars = 0
    rest = ""
    for p in parts:
        chars += len(p["text"])
        for m in p["mask"]:
            masked = unescape(p["text"][m["start"] : m["end"]]).encode()
            loss.update(masked)
            loss_chars += len(masked.decode())
        rest += p["text"]
        at = 0
        while found := _TURN.match(rest, at):
            at = found.end()
            n += 1
            for value in (found["role"], found["text"]):
                turns.update(unescape(value).encode() + b"\n")
        rest = rest[at:]
    if rest:
        raise ValueError(f"conversation {conv_id} ends in {rest[:40]!r}")
    return {
        "conv_id": conv_id,
        "n_turns": n,
        "turns_sha256": turns.hexdigest(),
        "loss_chars": loss_chars,
        "loss_sha256": loss.hexdigest(),
        "formatted_chars": chars,
    }


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups = groupby(_rows(batches), key=lambda r: r["conv_id"])
    return _batched((_read_back(c, parts) for c, parts in groups), _READ_ARROW)


def read_formatted(parts: DataFrame) -> DataFrame:
    """Digests of what :func:`format_conversations` made, one row for each conversation."""
    placed = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return placed.mapInArrow(_read, _READ)


def formatted_conversations(turns: DataFrame) -> DataFrame:
    """All conversations and the hard one, -7, formatted and read back."""
    hard = r"\### Assistant: </turn> ok"
    extra = turns.sparkSession.createDataFrame(
        [(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"
    )
    named = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    return read_formatted(format_conversations(named.union(extra)))
