"""Chat formatting: a compiler for a sandboxed template language.

A template is parsed into a syntax tree, constant parts of the tree are folded, and the rest is
turned into nested Python closures. There is no eval and no attribute access to Python objects:
values are strings, numbers, booleans, None, lists and dicts of the conversation, and only the
listed filters and tests exist. ``{% generation %}`` blocks are recorded as character spans of
the rendered text, from which a loss mask is made.

Language: ``{{ e }}``, ``{% for x in e %} {% else %}``, ``{% if %} {% elif %} {% else %}``,
``{% set x = e %}``, ``{% generation %}``, ``{# comment #}``, ``-`` beside a bracket strips
white space; in expressions or, and, not, comparisons, in, ``is`` tests, ``+ - * / // % ~``,
``a if c else b``, filters, ``x.key``, ``x[i]``, slices, literals and ``loop`` attributes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, prepare

CHATML = (
    "{% for m in messages %}<|im_start|>{{ m.role }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.content }}<|im_end|>{% endgeneration %}"
    "{% else %}{{ m.content }}<|im_end|>{% endif %}\n{% endfor %}"
)


class TemplateError(ValueError):
    pass


class Undefined:
    """What a missing name or key gives: empty when shown, false when tested."""

    def __bool__(self) -> bool:
        return False

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Undefined)

    __hash__ = None  # type: ignore[assignment]


UNDEFINED = Undefined()
_TAG = re.compile(r"\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.\d+|\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|[-+*/%~<>()\[\]{}|.,:=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def text_of(v: Any) -> str:
    if v is None or isinstance(v, Undefined):
        return ""
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) if isinstance(v, (list, dict, bool)) else str(v)


def _index(v: Any, key: Any) -> Any:
    if isinstance(v, dict):
        return v.get(key, UNDEFINED)
    if isinstance(v, (list, str)) and isinstance(key, int) and not isinstance(key, bool):
        return v[key] if -len(v) <= key < len(v) else UNDEFINED
    return UNDEFINED


def _default(v: Any, other: Any = "", falsy: Any = False) -> Any:
    return other if isinstance(v, Undefined) or v is None or (falsy and not v) else v


FILTERS: dict[str, Callable] = {
    "trim": lambda v: text_of(v).strip(),
    "upper": lambda v: text_of(v).upper(),
    "lower": lambda v: text_of(v).lower(),
    "capitalize": lambda v: text_of(v).capitalize(),
    "length": lambda v: len(v) if isinstance(v, (str, list, dict)) else 0,
    "default": _default,
    "join": lambda v, by="": by.join(text_of(x) for x in v),
    "first": lambda v: v[0] if v else UNDEFINED,
    "last": lambda v: v[-1] if v else UNDEFINED,
    "replace": lambda v, a, b: text_of(v).replace(a, b),
    "string": text_of,
    "int": lambda v: int(v),
    "tojson": lambda v: json.dumps(None if isinstance(v, Undefined) else v, ensure_ascii=False),
}
TESTS: dict[str, Callable] = {
    "defined": lambda v: not isinstance(v, Undefined),
    "undefined": lambda v: isinstance(v, Undefined),
    "none": lambda v: v is None,
    "string": lambda v: isinstance(v, str),
    "mapping": lambda v: isinstance(v, dict),
    "iterable": lambda v: isinstance(v, (str, list, dict)),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "even": lambda v: v % 2 == 0,
    "odd": lambda v: v % 2 == 1,
}
BINARY: dict[str, Callable] = {
    "+": lambda a, b: text_of(a) + text_of(b) if isinstance(a, str) or isinstance(b, str) else a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a / b,
    "//": lambda a, b: a // b,
    "%": lambda a, b: a % b if not isinstance(a, str) else a,
    "~": lambda a, b: text_of(a) + text_of(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b if isinstance(b, (str, list, dict)) else False,
    "not in": lambda a, b: a not in b if isinstance(b, (str, list, dict)) else True,
}


class Expressions:
    """Recursive descent over the tokens of one tag; nodes are tuples whose first item is the kind."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.i = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.i] if self.i < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> str | None:
        kind, v = self.peek()
        if kind in ("op", "name") and v in values:
            self.i += 1
            return v
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing before {self.peek()[1]!r}")

    def name(self) -> str:
        kind, v = self.peek()
        if kind != "name":
            raise TemplateError(f"a name is missing before {v!r}")
        self.i += 1
        return v

    def end(self) -> None:
        if self.peek()[0] != "end":
            raise TemplateError(f"{self.peek()[1]!r} is out of place")

    def expression(self) -> tuple:
        value = self.disjunction()
        if self.take("if"):
            condition = self.disjunction()
            return ("cond", condition, value, self.expression() if self.take("else") else ("const", UNDEFINED))
        return value

    def disjunction(self) -> tuple:
        left = self.conjunction()
        while self.take("or"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.negation()
        while self.take("and"):
            left = ("and", left, self.negation())
        return left

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self) -> tuple:
        left = self.sum()
        while True:
            if op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                left = ("binary", op, left, self.sum())
            elif self.peek() == ("name", "not") and self.tokens[self.i + 1 : self.i + 2] == [("name", "in")]:
                self.i += 2
                left = ("binary", "not in", left, self.sum())
            elif self.take("is"):
                negated, test = self.take("not"), self.name()
                if test not in TESTS:
                    raise TemplateError(f"no test {test!r}")
                left = ("test", test, left)
                left = ("not", left) if negated else left
            else:
                return left

    def sum(self) -> tuple:
        left = self.product()
        while op := self.take("+", "-", "~"):
            left = ("binary", op, left, self.product())
        return left

    def product(self) -> tuple:
        left = self.unary()
        while op := self.take("*", "/", "//", "%"):
            left = ("binary", op, left, self.unary())
        return left

    def unary(self) -> tuple:
        if self.take("-"):
            return ("binary", "-", ("const", 0), self.unary())
        return self.postfix()

    def postfix(self) -> tuple:
        value = self.atom()
        while True:
            if self.take("."):
                value = ("index", value, ("const", self.name()))
            elif self.take("["):
                low = ("const", None) if self.peek() == ("op", ":") else self.expression()
                if self.take(":"):
                    high = ("const", None) if self.peek() == ("op", "]") else self.expression()
                    value = ("slice", value, low, high)
                else:
                    value = ("index", value, low)
                self.need("]")
            elif self.take("|"):
                filter_, args = self.name(), []
                if filter_ not in FILTERS:
                    raise TemplateError(f"no filter {filter_!r}")
                if self.take("("):
                    args = self.items(")")
                value = ("filter", filter_, value, *args)
            else:
                return value

    def items(self, close: str) -> list[tuple]:
        out = []
        while not self.take(close):
            out.append(self.expression())
            if not self.take(","):
                self.need(close)
                break
        return out

    def atom(self) -> tuple:
        kind, v = self.peek()
        self.i += 1
        if kind == "num":
            return ("const", float(v) if "." in v else int(v))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), v[1:-1], flags=re.S))
        if kind == "name":
            constants = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
            return ("const", constants[v]) if v in constants else ("name", v)
        if v == "(":
            value = self.expression()
            self.need(")")
            return value
        if v == "[":
            return ("list", *self.items("]"))
        raise TemplateError(f"{v or 'the end'!r} is out of place")


def fold(node: tuple) -> tuple:
    """The tree with constant expressions, and branches on constants, replaced by their values."""
    kind = node[0]
    if kind in ("const", "name", "text"):
        return node
    node = tuple(fold(x) if isinstance(x, tuple) and x else [fold(y) for y in x] if isinstance(x, list) else x for x in node)
    if kind == "body":
        merged: list[tuple] = []
        for x in node[1]:
            x = ("text", text_of(x[1][1])) if x[0] == "show" and x[1][0] == "const" else x
            for y in x[1] if x[0] == "body" else [x]:
                if y[0] == "text" and merged and merged[-1][0] == "text":
                    merged[-1] = ("text", merged[-1][1] + y[1])
                elif y != ("text", ""):
                    merged.append(y)
        return ("body", merged)
    if kind in ("if", "cond") and node[1][0] == "const":
        return node[2] if node[1][1] else node[3]
    if kind in ("and", "or") and node[1][0] == "const":
        return node[2] if bool(node[1][1]) == (kind == "and") else node[1]
    if kind in ("binary", "filter", "test", "not", "index", "slice", "list") and all(x[0] == "const" for x in node[1:] if isinstance(x, tuple)):
        try:
            return ("const", close(node)({}))
        except (TypeError, ValueError, ZeroDivisionError, IndexError):
            return node  # the error belongs to rendering, if that comes here at all
    return node


def close(node: tuple) -> Callable[[dict], Any]:
    """A closure from variables to the value of an expression."""
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name, UNDEFINED)
    if kind == "list":
        each = [close(x) for x in node[1:]]
        return lambda env: [f(env) for f in each]
    if kind in ("binary", "test", "filter"):
        op, first, *rest = {"binary": BINARY, "test": TESTS, "filter": FILTERS}[kind][node[1]], *map(close, node[2:])
        if not rest:
            return lambda env: op(first(env))
        if len(rest) == 1:
            second = rest[0]
            return lambda env: op(first(env), second(env))
        return lambda env: op(first(env), *(f(env) for f in rest))
    a, *others = map(close, node[1:])
    b = others[0] if others else None
    c = others[1] if len(others) > 1 else None
    return {
        "not": lambda env: not a(env),
        "and": lambda env: a(env) and b(env),
        "or": lambda env: a(env) or b(env),
        "cond": lambda env: b(env) if a(env) else c(env),
        "index": lambda env: _index(a(env), b(env)),
        "slice": lambda env: a(env)[b(env) : c(env)],
    }[kind]


class Out:
    """Rendered parts, their length so far, and the spans of generation."""

    __slots__ = ("parts", "length", "spans")

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def emit(node: tuple) -> Callable[[dict, Out], None]:
    """A closure that renders a statement."""
    kind = node[0]
    if kind == "text":
        text, n = node[1], len(node[1])

        def show_text(env: dict, out: Out) -> None:
            out.parts.append(text)
            out.length += n

        return show_text
    if kind == "show":
        value = close(node[1])
        return lambda env, out: out.add(text_of(value(env)))
    if kind == "body":
        steps = [emit(x) for x in node[1]]

        def run(env: dict, out: Out) -> None:
            for step in steps:
                step(env, out)

        return run
    if kind == "if":
        condition, yes, no = close(node[1]), emit(node[2]), emit(node[3])
        return lambda env, out: (yes if condition(env) else no)(env, out)
    if kind == "set":
        name, given = node[1], close(node[2])
        return lambda env, out: env.__setitem__(name, given(env))
    if kind == "generation":
        inner = emit(node[1])

        def mark(env: dict, out: Out) -> None:
            start = out.length
            inner(env, out)
            out.spans.append((start, out.length))

        return mark
    if kind == "for":
        name, items, body, otherwise = node[1], close(node[2]), emit(node[3]), emit(node[4])

        def loop(env: dict, out: Out) -> None:
            values = items(env)
            values = list(values) if isinstance(values, (list, str, dict)) else []
            if not values:
                return otherwise(env, out)
            inner, n = dict(env), len(values)
            for i, v in enumerate(values):
                inner[name] = v
                inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == n - 1, "length": n, "previtem": values[i - 1] if i else UNDEFINED}
                body(inner, out)

        return loop
    raise TemplateError(f"no statement {kind!r}")


class Template:
    """A compiled template. ``tree`` is the folded syntax tree."""

    def __init__(self, source: str):
        self.parts: list[tuple[str, str]] = []
        at, strip = 0, False
        for m in _TAG.finditer(source):
            tag = m[0]
            text = source[at : m.start()]
            text = text.lstrip() if strip else text
            text = text.rstrip() if tag[2] == "-" else text
            self.parts.append(("text", text))
            if tag[1] != "#":
                self.parts.append(("show" if tag[1] == "{" else "do", tag[2:-2].strip("-").strip()))
            at, strip = m.end(), tag[-3] == "-" and tag[1] != "#"
        self.parts.append(("text", source[at:].lstrip() if strip else source[at:]))
        self.i = 0
        body, stop = self._body()
        if stop:
            raise TemplateError(f"{stop!r} is out of place")
        self.tree = fold(body)
        self._run = emit(self.tree)

    def _body(self, *stops: str) -> tuple[tuple, str]:
        out: list[tuple] = []
        while self.i < len(self.parts):
            kind, source = self.parts[self.i]
            self.i += 1
            if kind == "text":
                out.append(("text", source))
            elif kind == "show":
                e = Expressions(source)
                out.append(("show", e.expression()))
                e.end()
            else:
                word = source.split(None, 1)[0] if source else ""
                if word in stops:
                    return ("body", out), source
                if word.startswith(("end", "el")):
                    return ("body", out), source
                out.append(self._statement(word, source[len(word) :]))
        if stops:
            raise TemplateError(f"{stops[-1]!r} is missing")
        return ("body", out), ""

    def _statement(self, word: str, rest: str) -> tuple:
        e = Expressions(rest)
        if word == "set":
            name = e.name()
            e.need("=")
            node: tuple = ("set", name, e.expression())
        elif word == "for":
            name = e.name()
            e.need("in")
            items = e.expression()
            body, stop = self._body("else", "endfor")
            otherwise: tuple = ("body", [])
            if stop == "else":
                otherwise, stop = self._body("endfor")
            node = ("for", name, items, body, otherwise)
            self._ended(stop, "endfor")
        elif word == "if":
            condition = e.expression()
            body, stop = self._body("elif", "else", "endif")
            if stop.startswith("elif"):
                node = ("if", condition, body, ("body", [self._statement("if", stop[4:])]))
            else:
                no: tuple = ("body", [])
                if stop == "else":
                    no, stop = self._body("endif")
                self._ended(stop, "endif")
                node = ("if", condition, body, no)
        elif word == "generation":
            body, stop = self._body("endgeneration")
            self._ended(stop, "endgeneration")
            node = ("generation", body)
        else:
            raise TemplateError(f"no statement {word!r}")
        e.end()
        return node

    def _ended(self, stop: str, by: str) -> None:
        if stop != by:
            raise TemplateError(f"{by!r} is missing before {stop!r}")

    def render(self, **variables: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the character spans of its generation blocks in order."""
        out = Out()
        self._run(dict(variables), out)
        return "".join(out.parts), sorted(out.spans)


compiled = lru_cache(maxsize=32)(Template)
SCHEMA = "conv_id long, messages int, rendered string, generation string"


def _render(batches: Iterator[pa.RecordBatch], source: str) -> Iterator[pa.RecordBatch]:
    template = compiled(source)
    for batch in batches:
        rendered, spans, counts = [], [], []
        for turns in batch.column("turns").to_pylist():
            messages = [{"role": x["role"], "content": x["text"]} for x in turns]
            text, marks = template.render(messages=messages)
            rendered.append(text)
            spans.append(";".join(f"{a}:{b}" for a, b in marks))
            counts.append(len(messages))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(counts, pa.int32()), pa.array(rendered, pa.string()), pa.array(spans, pa.string())],
            names=["conv_id", "messages", "rendered", "generation"],
        )


def format_conversations(conversations: DataFrame, template: str = CHATML) -> DataFrame:
    """One row a conversation: conv_id, messages, rendered, generation ("start:end;..." in characters).

    Turns are ordered by turn (nulls first), then role, then text, so ties give the same result
    in every run. A null role is "user" and a null text is empty; repeated rows are repeated
    messages; rows without conv_id form one conversation. An empty table gives no rows. Other
    columns are ignored.
    """
    prepare(conversations.sparkSession)
    compiled(template)  # errors of the template come before the job
    rows = columns(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("message"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("message")).alias("turns"))
    return turns.mapInArrow(partial(_render, source=template), SCHEMA)


SQL = """
WITH m AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' AS body,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM m),
o AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id ORDER BY i) - length(body) - 1 AS head_end FROM p)
SELECT conv_id, CAST(count(*) AS INTEGER) AS messages, string_agg(head || body || chr(10), '' ORDER BY i) AS rendered,
 coalesce(string_agg(CAST(CAST(head_end AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(head_end + length(body) AS BIGINT) AS VARCHAR), ';' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS generation
FROM o GROUP BY conv_id
"""
