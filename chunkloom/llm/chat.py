"""Chat formatting by a small template compiler.

A template is parsed into a syntax tree, constants are folded, and the tree becomes Python closures. A closure writes
text and notes where generation blocks begin and end, so that the loss mask comes from the template itself. The
language is closed: no calls but the filters named here, no attributes but keys of the values given.

    {{ expression }}   {% for x in xs %}..{% endfor %}   {% if a %}..{% elif b %}..{% else %}..{% endif %}
    {% set x = expression %}   {% generation %}..{% endgeneration %}   a `-` inside the marks trims white space

Expressions: strings, whole numbers, true false none, names, `a.b`, `a[b]`, `x | filter`, `+ ~ == != < <= > >=`,
`in`, `not`, `and`, `or`, brackets. `loop.index0`, `loop.index`, `loop.first`, `loop.last` inside a loop.

Defined cases: a null role or text is empty; a null conversation id is a conversation; turns are ordered by turn, role
and text, null turns first; repeated rows are turns of their own; other columns are left out. One conversation is
rendered in memory as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

from pyspark.sql import DataFrame, functions as F

TEMPLATE = (
    "{% for message in messages %}<|turn|>{{ message.role | escape_line }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}<|end|>\n{% endfor %}"
)
# Every control string starts with one of these signs; inside texts they are written as a backslash and a letter.
_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_PLAIN = {v: k for k, v in _ESCAPES.items()}
_TURN = re.compile(r"<\|turn\|>([^<\n]*)\n([^<]*)<\|end\|>\n")


def escape(text: str) -> str:
    return re.sub(r"[\\<\[]", lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lb]", lambda m: _PLAIN[m[0]], text)


def escape_line(text: str) -> str:
    """For roles, which end at the line's end."""
    return escape(text).replace("\n", "\\n")


def unescape_line(text: str) -> str:
    return re.sub(r"\\[\\lbn]", lambda m: "\n" if m[0] == "\\n" else _PLAIN[m[0]], text)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": escape, "escape_line": escape_line, "trim": lambda s: s.strip(), "upper": lambda s: s.upper(),
    "lower": lambda s: s.lower(), "length": len,
}


class TemplateError(ValueError):
    pass


# -- syntax tree ------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    value: Any
    key: Any


@dataclass(frozen=True)
class Filter:
    value: Any
    name: str


@dataclass(frozen=True)
class Unary:
    value: Any


@dataclass(frozen=True)
class Binary:
    sign: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class Loop:
    name: str
    values: Any
    body: tuple


@dataclass(frozen=True)
class Branch:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


def _joined(a: Any, b: Any) -> str:
    return _text(a) + _text(b)


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


SIGNS: dict[str, Callable[[Any, Any], Any]] = {
    "+": lambda a, b: a + b, "~": _joined, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}
_TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z]\w*)|(?P<sign>==|!=|<=|>=|[<>+~|.()\[\]=]))""")
_UNQUOTED = {"n": "\n", "t": "\t", "r": "\r"}
_CONSTANTS = {"true": True, "false": False, "none": None}


class _Expressions:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"not understood: {source[at:at + 20]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in texts

    def take(self, kind: str | None = None, text: str | None = None) -> str:
        if self.at >= len(self.tokens):
            raise TemplateError("the tag ends too early")
        found, value = self.tokens[self.at]
        if (kind and found != kind) or (text and value != text):
            raise TemplateError(f"{value!r} where {text or kind} is due")
        self.at += 1
        return value

    def done(self, value: Any) -> Any:
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is too much")
        return value

    def any(self, level: int = 0) -> Any:
        if level == 2 and self.peek("not"):
            self.take()
            return Unary(self.any(2))
        if level == 5:
            return self.postfix()
        signs = (("or",), ("and",), (), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "~"))[level]
        left = self.any(level + 1)
        while self.peek(*signs):
            left = Binary(self.take(), left, self.any(level + 1))
        return left

    def postfix(self) -> Any:
        value = self.primary()
        while self.peek(".", "[", "|"):
            sign = self.take()
            if sign == ".":
                value = Item(value, Const(self.take("name")))
            elif sign == "[":
                value = Item(value, self.any())
                self.take(text="]")
            else:
                name = self.take("name")
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                value = Filter(value, name)
        return value

    def primary(self) -> Any:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        value = self.take()
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _UNQUOTED.get(m[1], m[1]), text[1:-1]))
        if kind == "number":
            return Const(int(text))
        if kind == "name":
            return Const(_CONSTANTS[text]) if text in _CONSTANTS else Name(text)
        if value == "(":
            inside = self.any()
            self.take(text=")")
            return inside
        raise TemplateError(f"{value!r} begins no expression")


class _Parser:
    def __init__(self, source: str):
        self.parts: list[tuple[str, str]] = []
        for part in re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S):
            kind = {"{{": "output", "{%": "tag"}.get(part[:2], "text")
            self.parts.append((kind, part))
        self._trim()
        self.at = 0

    def _trim(self) -> None:
        for i, (kind, part) in enumerate(self.parts):
            if kind == "text":
                continue
            inner = part[2:-2]
            if inner.startswith("-"):
                inner = inner[1:]
                if i:
                    self.parts[i - 1] = (self.parts[i - 1][0], self.parts[i - 1][1].rstrip())
            if inner.endswith("-"):
                inner = inner[:-1]
                if i + 1 < len(self.parts):
                    self.parts[i + 1] = (self.parts[i + 1][0], self.parts[i + 1][1].lstrip())
            self.parts[i] = (kind, inner)

    def body(self, *ends: str) -> tuple[tuple, str, str]:
        """Nodes up to one of the end tags, its name and the rest of it."""
        nodes: list[Any] = []
        while self.at < len(self.parts):
            kind, part = self.parts[self.at]
            self.at += 1
            if kind == "text":
                if part:
                    nodes.append(Output(Const(part)))
            elif kind == "output":
                tokens = _Expressions(part)
                nodes.append(Output(tokens.done(tokens.any())))
            else:
                word, _, rest = part.strip().partition(" ")
                if word in ends:
                    return tuple(nodes), word, rest
                nodes.append(self.statement(word, rest))
        if ends:
            raise TemplateError(f"no {' or '.join(ends)}")
        return tuple(nodes), "", ""

    def statement(self, word: str, rest: str) -> Any:
        tokens = _Expressions(rest)
        if word == "for":
            name = tokens.take("name")
            tokens.take(text="in")
            values = tokens.done(tokens.any())
            return Loop(name, values, self.body("endfor")[0])
        if word == "if":
            return self.branch(tokens.done(tokens.any()))
        if word == "set":
            name = tokens.take("name")
            tokens.take(text="=")
            return Assign(name, tokens.done(tokens.any()))
        if word == "generation":
            return Generation(self.body("endgeneration")[0])
        raise TemplateError(f"no statement {word!r}")

    def branch(self, test: Any) -> Branch:
        then, word, rest = self.body("elif", "else", "endif")
        if word == "elif":
            tokens = _Expressions(rest)
            return Branch(test, then, (self.branch(tokens.done(tokens.any())),))
        return Branch(test, then, self.body("endif")[0] if word == "else" else ())


# -- folding ----------------------------------------------------------------------------------------------------------

def fold(node: Any) -> Any:
    """The expression with its constant parts worked out."""
    if isinstance(node, Binary):
        left, right = fold(node.left), fold(node.right)
        if isinstance(left, Const):
            if node.sign == "and":
                return right if left.value else left
            if node.sign == "or":
                return left if left.value else right
            if isinstance(right, Const):
                return Const(SIGNS[node.sign](left.value, right.value))
        return Binary(node.sign, left, right)
    if isinstance(node, Unary):
        value = fold(node.value)
        return Const(not value.value) if isinstance(value, Const) else Unary(value)
    if isinstance(node, Filter):
        value = fold(node.value)
        return Const(FILTERS[node.name](value.value)) if isinstance(value, Const) else Filter(value, node.name)
    if isinstance(node, Item):
        return Item(fold(node.value), fold(node.key))
    return node


def fold_body(nodes: tuple) -> tuple:
    """Statements with folded expressions; constant branches chosen, neighbouring constant texts made one."""
    out: list[Any] = []
    for node in nodes:
        if isinstance(node, Branch):
            test = fold(node.test)
            then, other = fold_body(node.then), fold_body(node.other)
            new: tuple = (then if test.value else other) if isinstance(test, Const) else (Branch(test, then, other),)
        elif isinstance(node, Loop):
            new = (Loop(node.name, fold(node.values), fold_body(node.body)),)
        elif isinstance(node, Generation):
            new = (Generation(fold_body(node.body)),)
        elif isinstance(node, Assign):
            new = (Assign(node.name, fold(node.value)),)
        else:
            value = fold(node.value)
            new = (Output(Const(_text(value.value)) if isinstance(value, Const) else value),)
        for one in new:
            last = out[-1] if out else None
            if isinstance(one, Output) and isinstance(last, Output) and isinstance(one.value, Const) and isinstance(last.value, Const):
                out[-1] = Output(Const(last.value.value + one.value.value))
            else:
                out.append(one)
    return tuple(out)


# -- closures ---------------------------------------------------------------------------------------------------------

class Sheet:
    """What a template writes: pieces of text and the spans of generation blocks, in characters."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


def _item(value: Any, key: Any) -> Any:
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, str)) and isinstance(key, int):
        return value[key]
    raise TemplateError(f"no item {key!r}")


def value_of(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        constant = node.value
        return lambda names: constant
    if isinstance(node, Name):
        name = node.name
        return lambda names: names.get(name)
    if isinstance(node, Item):
        value, key = value_of(node.value), value_of(node.key)
        return lambda names: _item(value(names), key(names))
    if isinstance(node, Filter):
        value, use = value_of(node.value), FILTERS[node.name]
        return lambda names: use(value(names))
    if isinstance(node, Unary):
        value = value_of(node.value)
        return lambda names: not value(names)
    left, right = value_of(node.left), value_of(node.right)
    if node.sign == "and":
        return lambda names: left(names) and right(names)
    if node.sign == "or":
        return lambda names: left(names) or right(names)
    work = SIGNS[node.sign]
    return lambda names: work(left(names), right(names))


Writer = Callable[[dict, Sheet], None]


def writer_of(nodes: tuple) -> Writer:
    steps = [_step(node) for node in nodes]

    def write(names: dict, sheet: Sheet) -> None:
        for step in steps:
            step(names, sheet)
    return write


def _step(node: Any) -> Writer:
    if isinstance(node, Output):
        if isinstance(node.value, Const):
            constant = node.value.value
            return lambda names, sheet: sheet.write(constant)
        value = value_of(node.value)
        return lambda names, sheet: sheet.write(_text(value(names)))
    if isinstance(node, Assign):
        name, value = node.name, value_of(node.value)
        return lambda names, sheet: names.__setitem__(name, value(names))
    if isinstance(node, Branch):
        test, then, other = value_of(node.test), writer_of(node.then), writer_of(node.other)
        return lambda names, sheet: (then if test(names) else other)(names, sheet)
    if isinstance(node, Generation):
        body = writer_of(node.body)

        def generation(names: dict, sheet: Sheet) -> None:
            start = sheet.length
            body(names, sheet)
            sheet.spans.append((start, sheet.length))
        return generation
    values, body, name = value_of(node.values), writer_of(node.body), node.name

    def loop(names: dict, sheet: Sheet) -> None:
        items = list(values(names) or ())
        inner = dict(names)
        for i, item in enumerate(items):
            inner[name] = item
            inner["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": i + 1 == len(items)}
            body(inner, sheet)
    return loop


@lru_cache(maxsize=16)
def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function of the names that gives the text and the generation spans."""
    write = writer_of(fold_body(_Parser(source).body()[0]))

    def render(names: dict) -> tuple[str, list[tuple[int, int]]]:
        sheet = Sheet()
        write(dict(names), sheet)
        return "".join(sheet.pieces), sheet.spans
    return render


# -- Spark ------------------------------------------------------------------------------------------------------------

FORMATTED = "conv_id bigint, n_turns bigint, formatted string, spans array<struct<start:int,end:int>>"
READ_BACK = FORMATTED + ", turns array<struct<role:string,text:string>>, loss string"


def format_conversations(df: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation: its text by the template, and the spans to learn from."""
    compile_template(template)                  # errors show here, not in a task
    turns = (
        df.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        render, done = compile_template(template), []
        current: Any = object()
        messages: list[dict] = []

        def finish() -> None:
            text, spans = render({"messages": messages})
            done.append({"conv_id": current, "n_turns": len(messages), "formatted": text, "spans": [{"start": a, "end": b} for a, b in spans]})

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != current:
                    if messages:
                        finish()
                    current, messages = conv, []
                messages.append({"role": role, "text": text})
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow_schema)
                done.clear()
        if messages:
            finish()
            yield pa.RecordBatch.from_pylist(done, schema=arrow_schema)

    arrow_schema = _arrow(FORMATTED)
    return turns.mapInArrow(run, FORMATTED)


def _arrow(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and learned text, taken from the formatted text alone. Fits templates that mark turns as ``TEMPLATE`` does."""
    arrow_schema = _arrow(READ_BACK)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                text = row["formatted"]
                row["turns"] = [{"role": unescape_line(r), "text": unescape(t)} for r, t in _TURN.findall(text)]
                row["n_turns"] = len(row["turns"])
                row["loss"] = "".join(unescape(text[s["start"]:s["end"]]) for s in row["spans"])
            yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)

    return formatted.mapInArrow(run, READ_BACK)
