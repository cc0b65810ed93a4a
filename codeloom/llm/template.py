"""A template compiler: text to syntax tree, constants folded, tree to Python closures.

The language is a sandbox: names of the context, literals, a fixed table of
filters, `loop`, subscripts of plain dicts and lists. Nothing reaches Python
attributes, calls or imports, and loops run over given lists only.

    {{ expr }}   {% set x = expr %}   {% if expr %} {% elif expr %} {% else %} {% endif %}
    {% for x in expr %} {% endfor %}   {% generation %} {% endgeneration %}   {# comment #}

Expressions: or, and, not, == != < <= > >=, in, ~ (join as text), + - * %,
x.name, x[expr], x | filter. A minus inside a tag's brackets trims white space
next to it. `generation` marks the spans of output that a model is trained on.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field


class TemplateError(ValueError):
    pass


# --- syntax tree ---------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Unary:
    op: str
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Filter:
    name: str
    arg: object


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    expr: object


@dataclass(frozen=True)
class Set:
    name: str
    expr: object


@dataclass(frozen=True)
class If:
    test: object
    body: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parser --------------------------------------------------------------

_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*%~<>|.\[\]()]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+", "-"), ("*", "%"))


class _Expression:
    def __init__(self, text: str, filters: dict):
        self.tokens, at, text = [], 0, text.rstrip()
        self.filters = filters
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"can't read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple:
        kind, got = self.peek()
        if kind == "end" or value is not None and got != value:
            raise TemplateError(f"expected {value or 'more'}, found {got!r}")
        self.at += 1
        return kind, got

    def whole(self):
        out = self.level(0)
        if self.peek()[0] != "end":
            raise TemplateError(f"left over: {self.peek()[1]!r}")
        return out

    def level(self, n: int):
        if n == 2 and self.peek() == ("name", "not"):
            self.take()
            return Unary("not", self.level(2))
        if n == len(_LEVELS):
            return self.postfix()
        left = self.level(n + 1)
        while self.peek()[0] in ("op", "name") and self.peek()[1] in _LEVELS[n]:
            left = Binary(self.take()[1], left, self.level(n + 1))
        return left

    def postfix(self):
        out = self.atom()
        while True:
            match self.peek():
                case ("op", "."):
                    self.take()
                    out = Item(out, Const(self.take()[1]))
                case ("op", "["):
                    self.take()
                    out = Item(out, self.level(0))
                    self.take("]")
                case ("op", "|"):
                    self.take()
                    name = self.take()[1]
                    if name not in self.filters:
                        raise TemplateError(f"no filter {name!r}")
                    out = Filter(name, out)
                case _:
                    return out

    def atom(self):
        kind, got = self.take()
        if kind == "num":
            return Const(int(got))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), got[1:-1], flags=re.S))
        if kind == "name":
            return Const({"true": True, "false": False, "none": None}[got]) if got in ("true", "false", "none") else Name(got)
        if got == "(":
            out = self.level(0)
            self.take(")")
            return out
        if got == "-":
            return Unary("-", self.postfix())
        raise TemplateError(f"unexpected {got!r}")


def parse(source: str, filters: dict) -> tuple:
    """The statements of a template."""
    parts, at = [], 0
    for m in _TAG.finditer(source):
        before = source[at : m.start()]
        parts.append(("text", before.rstrip() if m[0][2] == "-" else before))
        parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()) if m[2] is not None else ("text", ""))
        at = m.end()
        if m[0][-3] == "-":
            at += len(source[at:]) - len(source[at:].lstrip())
    parts.append(("text", source[at:]))
    expr = lambda text: _Expression(text, filters).whole()
    pos = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal pos
        body = []
        while pos < len(parts):
            kind, text = parts[pos]
            pos += 1
            if kind == "text":
                if text:
                    body.append(Text(text))
                continue
            if kind == "out":
                body.append(Output(expr(text)))
                continue
            word, _, rest = text.partition(" ")
            if word in ends:
                return tuple(body), text
            if word == "if":
                body.append(condition(rest))
            elif word == "for":
                m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
                if not m:
                    raise TemplateError(f"can't read {text!r}")
                body.append(For(m[1], expr(m[2]), block("endfor")[0]))
            elif word == "set":
                name, eq, value = rest.partition("=")
                if not eq or not name.strip().isidentifier():
                    raise TemplateError(f"can't read {text!r}")
                body.append(Set(name.strip(), expr(value)))
            elif word == "generation":
                body.append(Generation(block("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown or misplaced tag {text!r}")
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return tuple(body), ""

    def condition(test: str) -> If:
        body, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            return If(expr(test), body, (condition(end[4:]),))
        return If(expr(test), body, block("endif")[0] if end == "else" else ())

    return block()[0]


# --- folding and code ----------------------------------------------------


def _text(x) -> str:
    return "" if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x)


_OPS: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "+": operator.add, "-": operator.sub, "*": operator.mul, "%": operator.mod,
    "in": lambda a, b: a in b, "~": lambda a, b: _text(a) + _text(b),
}


def _item(of, key):
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    return None


def fold(node, filters: dict):
    """The node with every constant part computed and adjoining texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in (fold(x, filters) for x in node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    y = Text(out.pop().text + y.text)
                out.append(y)
        return tuple(x for x in out if x != Text(""))
    match node:
        case Item(of, key):
            of, key = fold(of, filters), fold(key, filters)
            return Const(_item(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Item(of, key)
        case Unary(op, arg):
            arg = fold(arg, filters)
            return Const(not arg.value if op == "not" else -arg.value) if isinstance(arg, Const) else Unary(op, arg)
        case Binary(op, left, right):
            left, right = fold(left, filters), fold(right, filters)
            if op in ("and", "or") and isinstance(left, Const):
                return right if bool(left.value) == (op == "and") else left
            if isinstance(left, Const) and isinstance(right, Const) and op in _OPS:
                return Const(_OPS[op](left.value, right.value))
            return Binary(op, left, right)
        case Filter(name, arg):
            arg = fold(arg, filters)
            return Const(filters[name](arg.value)) if isinstance(arg, Const) else Filter(name, arg)
        case Output(expr):
            expr = fold(expr, filters)
            return Text(_text(expr.value)) if isinstance(expr, Const) else Output(expr)
        case Set(name, expr):
            return Set(name, fold(expr, filters))
        case If(test, body, other):
            test, body, other = fold(test, filters), fold(body, filters), fold(other, filters)
            return (body if test.value else other) if isinstance(test, Const) else If(test, body, other)
        case For(name, over, body):
            return For(name, fold(over, filters), fold(body, filters))
        case Generation(body):
            return Generation(fold(body, filters))
    return node


def _value(node, filters: dict) -> Callable[[dict], object]:
    match node:
        case Const(value):
            return lambda env: value
        case Name(name):
            return lambda env: env.get(name)
        case Item(of, Const(key)):
            a = _value(of, filters)
            return lambda env: _item(a(env), key)
        case Item(of, key):
            a, b = _value(of, filters), _value(key, filters)
            return lambda env: _item(a(env), b(env))
        case Unary(op, arg):
            a = _value(arg, filters)
            return (lambda env: not a(env)) if op == "not" else (lambda env: -a(env))
        case Binary(op, left, right):
            a, b = _value(left, filters), _value(right, filters)
            if op == "and":
                return lambda env: a(env) and b(env)
            if op == "or":
                return lambda env: a(env) or b(env)
            f = _OPS[op]
            return lambda env: f(a(env), b(env))
        case Filter(name, arg):
            a, f = _value(arg, filters), filters[name]
            return lambda env: f(a(env))
    raise TemplateError(f"not an expression: {node!r}")


class _Out:
    def __init__(self):
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _run(body: tuple, filters: dict) -> Callable[[dict, _Out], None]:
    steps = [_step(x, filters) for x in body]

    def run(env: dict, out: _Out) -> None:
        for s in steps:
            s(env, out)

    return steps[0] if len(steps) == 1 else run


def _step(node, filters: dict) -> Callable[[dict, _Out], None]:
    match node:
        case Text(text):
            return lambda env, out: out.add(text)
        case Output(expr):
            value = _value(expr, filters)
            return lambda env, out: out.add(_text(value(env)))
        case Set(name, expr):
            value = _value(expr, filters)
            return lambda env, out: env.__setitem__(name, value(env))
        case If(test, body, other):
            value, yes, no = _value(test, filters), _run(body, filters), _run(other, filters)
            return lambda env, out: (yes if value(env) else no)(env, out)
        case For(name, over, body):
            value, each = _value(over, filters), _run(body, filters)

            def loop(env: dict, out: _Out) -> None:
                items = value(env) or ()
                if not isinstance(items, (list, tuple)):
                    raise TemplateError("a loop needs a list")
                inner = dict(env)
                for i, x in enumerate(items):
                    inner[name] = x
                    inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}
                    each(inner, out)

            return loop
        case Generation(body):
            inside = _run(body, filters)

            def mark(env: dict, out: _Out) -> None:
                begin = out.length
                inside(env, out)
                out.spans.append((begin, out.length))

            return mark
    raise TemplateError(f"not a statement: {node!r}")


FILTERS: dict[str, Callable] = {"trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": lambda x: len(x) if x is not None else 0}


@dataclass
class Template:
    """A compiled template: render(context) gives the text and the spans marked for training."""

    source: str
    filters: dict = field(default_factory=dict)

    def __post_init__(self):
        known = FILTERS | self.filters
        self.tree = fold(parse(self.source, known), known)
        self._run = _run(self.tree, known)

    def render(self, context: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        self._run(dict(context), out)
        return "".join(out.parts), out.spans
