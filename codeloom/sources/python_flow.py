"""What is inside Python functions: blocks and jumps, what flows where, predicates on the way, counts of operators, and constraints on places.

inside() parses each file once and gives rows of several tables, told apart by
tag; the functions below it cut them out. Functions are named path::qualified.
"""

from __future__ import annotations

import ast
import io
import keyword
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text

SCHEMA = "path string, fn string, tag string, kind string, x string, y string, z string, line int, end_line int, n int"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_COMPOUND = (ast.If, ast.Match, *_LOOPS, ast.Try, ast.TryStar, ast.With, ast.AsyncWith)
_INNER = (*_FUNCTIONS, ast.ClassDef, ast.Lambda)
#: Methods that change the object they are called on.
MUTATORS = ("append", "extend", "insert", "pop", "remove", "clear", "update", "add", "discard", "setdefault", "sort", "reverse", "push", "write")


class _Blocks:
    """Basic blocks of a function: ENTRY, EXIT, and one for each branch, loop, handler and what follows them."""

    def __init__(self, f: ast.AST):
        self.blocks: list[tuple[int, str, str, int, int]] = []
        self.edges: list[tuple[int, int, str]] = []
        self.loops: list[tuple[int, int]] = []
        first, self.exit = self.block("Entry", "ENTRY", f.lineno, f.lineno), self.block("Exit", "EXIT", f.end_lineno, f.end_lineno)
        last = self.walk(f.body, first)
        if last is not None:
            self.edge(last, self.exit, "Normal")

    def block(self, kind: str, label: str, line: int, end: int) -> int:
        self.blocks.append((len(self.blocks), kind, label, line, end))
        return self.blocks[-1][0]

    def edge(self, a: int, b: int, kind: str) -> None:
        if (a, b, kind) not in self.edges:
            self.edges.append((a, b, kind))

    def part(self, label: str, body: list[ast.stmt], start: int, kind: str, end: int | None, end_kind: str = "Normal", of: str = "Normal") -> None:
        """A block of its own for a body, entered from start and left to end."""
        own = self.block(of, label, body[0].lineno, body[-1].end_lineno)
        self.edge(start, own, kind)
        last = self.walk(body, own)
        if last is not None and end is not None:
            self.edge(last, end, end_kind)

    def walk(self, body: list[ast.stmt], at: int) -> int | None:
        """The block that goes on after the statements, None where none does."""
        for s in body:
            i, kind, label, line, end = self.blocks[at]
            if not isinstance(s, _COMPOUND) and kind in ("Entry", "Normal", "Exception"):
                self.blocks[at] = (i, kind, label, line, max(end, s.end_lineno))
            if isinstance(s, (ast.If, ast.Match)):
                branch = self.block("Branch", "if" if isinstance(s, ast.If) else "match", s.lineno, s.end_lineno)
                self.edge(at, branch, "Normal")
                after = self.block("Normal", "after_if", s.end_lineno, s.end_lineno)
                if isinstance(s, ast.If):
                    self.part("then", s.body, branch, "BranchTrue", after)
                    if s.orelse:
                        self.part("else", s.orelse, branch, "BranchFalse", after)
                    else:
                        self.edge(branch, after, "BranchFalse")
                else:
                    for c in s.cases:
                        self.part("case", c.body, branch, "BranchTrue", after)
                    self.edge(branch, after, "BranchFalse")
                at = after
            elif isinstance(s, _LOOPS):
                head = self.block("Loop", "loop_header", s.lineno, s.lineno)
                self.edge(at, head, "Normal")
                after = self.block("Normal", "after_loop", s.end_lineno, s.end_lineno)
                self.loops.append((head, after))
                self.part("loop_body", s.body, head, "BranchTrue", head, "LoopBack")
                self.loops.pop()
                if s.orelse:
                    self.part("loop_else", s.orelse, head, "BranchFalse", after)
                else:
                    self.edge(head, after, "BranchFalse")
                at = after
            elif isinstance(s, (ast.Try, ast.TryStar)):
                tried = self.block("Normal", "try", s.lineno, s.body[-1].end_lineno)
                self.edge(at, tried, "Normal")
                after = self.block("Normal", "after_try", s.end_lineno, s.end_lineno)
                last = self.walk(s.body, tried)
                if last is not None and s.orelse:
                    self.part("try_else", s.orelse, last, "Normal", after)
                elif last is not None:
                    self.edge(last, after, "Normal")
                for h in s.handlers:
                    self.part("except", h.body, tried, "Exception", after, of="Exception")
                at = after
                if s.finalbody:
                    last = self.walk(s.finalbody, after)
                    if last is None:
                        return None
                    at = last
            elif isinstance(s, (ast.With, ast.AsyncWith)):
                last = self.walk(s.body, at)
                if last is None:
                    return None
                at = last
            elif isinstance(s, ast.Return):
                self.edge(at, self.exit, "Return")
                return None
            elif isinstance(s, ast.Raise):
                self.edge(at, self.exit, "Exception")
                return None
            elif isinstance(s, ast.Break) and self.loops:
                self.edge(at, self.loops[-1][1], "Break")
                return None
            elif isinstance(s, ast.Continue) and self.loops:
                self.edge(at, self.loops[-1][0], "Continue")
                return None
        return at


def _own(node: ast.AST) -> Iterator[ast.AST]:
    """The nodes of a function without those of functions and classes inside it, in the order of the text."""
    for child in ast.iter_child_nodes(node):
        yield child
        if not isinstance(child, _INNER):
            yield from _own(child)


def _spelled(e: ast.AST) -> str:
    if isinstance(e, ast.Name):
        return e.id
    return f"{_spelled(e.value)}.{e.attr}" if isinstance(e, ast.Attribute) else ast.unparse(e)


class _Flow:
    """Rows on the values of one function."""

    def __init__(self, f: ast.AST):
        self.rows: list[tuple] = []
        self.temps = 0
        a = f.args
        positional = [*a.posonlyargs, *a.args]
        given = len(positional) - len(a.defaults)
        named = [(p, i >= given) for i, p in enumerate(positional)] + [(p, False) for p in (a.vararg,) if p] + [(p, d is not None) for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)] + [(p, False) for p in (a.kwarg,) if p]
        self.params = [p.arg for p, _ in named if p.arg != "self"]
        for i, (p, default) in enumerate((p, d) for p, d in named if p.arg != "self"):
            self.row("param", "default" if default else "", p.arg, p.annotation and ast.unparse(p.annotation), None, p.lineno, i)
            self.op("new", p.lineno, dst=p.arg, site=f"param:{p.arg}")
        for node in _own(f):
            self.node(node)

    def row(self, tag: str, kind: str, x, y, z, line: int, n: int | None = None) -> None:
        self.rows.append((tag, kind, x, y, z, line, line, n))

    def op(self, op: str, line: int, dst=None, base=None, field=None, src=None, site=None) -> None:
        first = {"new": (dst, site, None), "copy": (dst, src, None), "read": (dst, base, field), "write": (src, base, field)}[op]
        self.row("op", op, *first, line)

    def temp(self) -> str:
        self.temps += 1
        return f"%{self.temps}"

    def value(self, e: ast.expr, line: int) -> str:
        """The variable that holds an expression's value."""
        if isinstance(e, ast.Name):
            return e.id
        t = self.temp()
        if isinstance(e, ast.Attribute):
            self.op("read", line, dst=t, base=self.value(e.value, line), field=e.attr)
        elif isinstance(e, ast.Subscript):
            self.op("read", line, dst=t, base=self.value(e.value, line), field="[]")
        elif isinstance(e, ast.Call):
            self.called(e, t)
        elif isinstance(e, ast.IfExp):
            for part in (e.body, e.orelse):
                self.op("copy", line, dst=t, src=self.value(part, line))
        elif isinstance(e, ast.BoolOp):
            for part in e.values:
                self.op("copy", line, dst=t, src=self.value(part, line))
        elif isinstance(e, (ast.Await, ast.NamedExpr, ast.Starred)):
            self.op("copy", line, dst=t, src=self.value(e.value, line))
        else:
            self.op("new", line, dst=t, site=f"literal:{e.lineno}:{e.col_offset}")
        return t

    def called(self, e: ast.Call, result: str) -> None:
        self.op("new", e.lineno, dst=result, site=f"heap:{e.lineno}:{e.col_offset}")
        name = _spelled(e.func).rsplit(".", 1)[-1]
        for i, a in enumerate(e.args):
            self.row("pass", result, name, self.value(a, e.lineno), None, e.lineno, i)
        if not e.args:
            self.row("pass", result, name, None, None, e.lineno, 0)

    def assigned(self, target: ast.expr, value: ast.expr, line: int) -> None:
        if isinstance(target, (ast.Tuple, ast.List)):
            values = value.elts if isinstance(value, (ast.Tuple, ast.List)) and len(value.elts) == len(target.elts) else [value] * len(target.elts)
            for t, v in zip(target.elts, values, strict=True):
                self.assigned(t, v, line)
            return
        held = isinstance(value, ast.Name) and value.id in self.params
        kind = "Literal" if isinstance(value, ast.Constant) else "Param" if held else "CallResult" if isinstance(value, ast.Call) else "FieldAccess" if isinstance(value, ast.Attribute) else "Other"
        self.row("assign", kind, _spelled(target), None, None, line)
        source = self.value(value, line)
        if isinstance(target, ast.Name):
            self.op("copy", line, dst=target.id, src=source)
        elif isinstance(target, (ast.Attribute, ast.Subscript)):
            self.op("write", line, base=self.value(target.value, line), field=target.attr if isinstance(target, ast.Attribute) else "[]", src=source)

    def node(self, s: ast.AST) -> None:
        if isinstance(s, ast.Return):
            self.row("return", "", ast.unparse(s.value) if s.value else "", self.value(s.value, s.lineno) if s.value else None, None, s.lineno)
        elif isinstance(s, ast.Assign):
            for t in s.targets:
                self.assigned(t, s.value, s.lineno)
        elif isinstance(s, (ast.AnnAssign, ast.AugAssign)) and s.value:
            self.assigned(s.target, s.value, s.lineno)
        elif isinstance(s, ast.Expr) and isinstance(s.value, ast.Call):
            self.called(s.value, self.temp())
        if isinstance(s, ast.Call):
            name = _spelled(s.func)
            for i, a in enumerate(s.args):
                if isinstance(a, ast.Name) and a.id in self.params:
                    self.row("arg", "", name, a.id, None, s.lineno, i)
            if isinstance(s.func, ast.Attribute) and s.func.attr in MUTATORS:
                self.row("mutation", "", _spelled(s.func.value), s.func.attr, None, s.lineno)
        if isinstance(s, (ast.If, ast.While, ast.IfExp)):
            self.rows.append(("predicate", type(s).__name__.lower().replace("ifexp", "if"), ast.unparse(s.test), None, None, s.lineno, s.end_lineno, s.end_col_offset))
        elif isinstance(s, (ast.For, ast.AsyncFor)):
            self.rows.append(("predicate", "for", f"{ast.unparse(s.target)} in {ast.unparse(s.iter)}", None, None, s.lineno, s.end_lineno, s.end_col_offset))
        elif isinstance(s, ast.Match):
            self.rows.append(("predicate", "match", ast.unparse(s.subject), None, None, s.lineno, s.end_lineno, s.end_col_offset))


def _cognitive(body: list[ast.stmt], depth: int = 0) -> int:
    """Breaks of the straight flow, each with how deep it lies; a chain of elif is flat, a run of one boolean operator counts once."""
    total = 0
    for s in body:
        if isinstance(s, _INNER):
            continue
        total += sum(1 for e in _expressions(s) if isinstance(e, ast.BoolOp))
        if isinstance(s, ast.If):
            total += 1 + depth + _cognitive(s.body, depth + 1)
            rest = s.orelse
            while len(rest) == 1 and isinstance(rest[0], ast.If):
                total += 1 + sum(1 for e in _expressions(rest[0]) if isinstance(e, ast.BoolOp)) + _cognitive(rest[0].body, depth + 1)
                rest = rest[0].orelse
            total += _cognitive(rest, depth + 1)
        elif isinstance(s, _LOOPS):
            total += 1 + depth + _cognitive(s.body, depth + 1) + _cognitive(s.orelse, depth + 1)
        elif isinstance(s, (ast.Try, ast.TryStar)):
            total += _cognitive(s.body, depth) + sum(1 + depth + _cognitive(h.body, depth + 1) for h in s.handlers) + _cognitive(s.orelse, depth) + _cognitive(s.finalbody, depth)
        elif isinstance(s, ast.Match):
            total += 1 + depth + sum(_cognitive(c.body, depth + 1) for c in s.cases)
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            total += _cognitive(s.body, depth)
    return total


def _expressions(s: ast.stmt) -> Iterator[ast.AST]:
    for child in ast.iter_child_nodes(s):
        if isinstance(child, ast.expr):
            yield child
            yield from (e for e in ast.walk(child) if e is not child)


def _nesting(body: list[ast.stmt], depth: int = 0) -> int:
    most = depth
    for s in body:
        if isinstance(s, _INNER):
            continue
        deep = depth + isinstance(s, (ast.If, *_LOOPS, ast.Try, ast.TryStar, ast.Match))
        for part in ("body", "orelse", "finalbody"):
            inner = getattr(s, part, None) or []
            flat = part == "orelse" and isinstance(s, ast.If) and len(inner) == 1 and isinstance(inner[0], ast.If)
            most = max(most, _nesting(inner, depth if flat else deep)) if inner else most
        for h in [*getattr(s, "handlers", []), *getattr(s, "cases", [])]:
            most = max(most, _nesting(h.body, deep))
    return most


def _cyclomatic(f: ast.AST) -> int:
    total = 1
    for n in _own(f):
        total += isinstance(n, (ast.If, ast.IfExp, *_LOOPS, ast.ExceptHandler, ast.comprehension))
        total += len(n.values) - 1 if isinstance(n, ast.BoolOp) else len(n.cases) if isinstance(n, ast.Match) else 0
    return total


def _words(source: str) -> tuple[list[str], list[str]]:
    """Operators and operands of a piece of source, in order."""
    operators, operands = [], []
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.OP or (t.type == tokenize.NAME and keyword.iskeyword(t.string)):
                operators.append(t.string)
            elif t.type in (tokenize.NAME, tokenize.NUMBER, tokenize.STRING):
                operands.append(t.string)
    except (tokenize.TokenError, IndentationError):
        pass
    return operators, operands


def _measures(f: ast.AST, lines: list[str]) -> dict[str, int]:
    own = lines[f.lineno - 1 : f.end_lineno]
    indent = len(own[0]) - len(own[0].lstrip())
    operators, operands = _words("\n".join(x[indent:] if not x[:indent].strip() else x for x in own[f.body[0].lineno - f.lineno :]) if f.body[0].lineno > f.lineno else ast.unparse(ast.Module(f.body, [])))
    blank, notes = sum(not x.strip() for x in own), sum(x.strip().startswith("#") for x in own)
    return {"cognitive": _cognitive(f.body), "cyclomatic": _cyclomatic(f), "nesting": _nesting(f.body), "operators": len(set(operators)), "operands": len(set(operands)), "total_operators": len(operators), "total_operands": len(operands), "lines": len(own), "blank": blank, "comments": notes, "source": len(own) - blank - notes}


def _rows_of(path: str, source: str) -> list[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return [(path, None, "error", None, None, None, None, None, None, None)]
    rows, lines = [], source.splitlines()

    def visit(node: ast.AST, above: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (*_FUNCTIONS, ast.ClassDef)):
                name = f"{above}.{child.name}" if above else child.name
                if isinstance(child, _FUNCTIONS):
                    function(child, f"{path}::{name}")
                visit(child, name)
            else:
                visit(child, above)

    def function(f: ast.AST, fn: str) -> None:
        rows.append((path, fn, "function", None, f.name, None, None, f.lineno, f.end_lineno, None))
        b = _Blocks(f)
        rows.extend((path, fn, "block", kind, label, None, None, line, end, i) for i, kind, label, line, end in b.blocks)
        rows.extend((path, fn, "edge", kind, str(x), str(y), None, None, None, None) for x, y, kind in b.edges)
        rows.extend((path, fn, tag, kind, x, y, z, line, end, n) for tag, kind, x, y, z, line, end, n in _Flow(f).rows)
        rows.extend((path, fn, "measure", k, None, None, None, f.lineno, f.end_lineno, v) for k, v in _measures(f, lines).items())

    visit(tree, "")
    return rows


def inside(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA of the functions of files(path, content); a file that is not Python gives one error row, a null one none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = pd.DataFrame([r for p, c in zip(f.path, f.content, strict=True) for r in _rows_of(p, c or "")], columns=_COLUMNS)
            yield out.astype({c: "Int32" for c in ("line", "end_line", "n")})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def _of(rows: DataFrame, tag: str) -> DataFrame:
    return rows.where(F.col("tag") == tag)


def blocks(rows: DataFrame) -> DataFrame:
    """(fn, block, kind, label, line, end_line)"""
    return _of(rows, "block").select("fn", F.col("n").alias("block"), "kind", F.col("x").alias("label"), "line", "end_line")


def jumps(rows: DataFrame) -> DataFrame:
    """(fn, src, dst, kind) between blocks"""
    return _of(rows, "edge").select("fn", F.col("x").cast("int").alias("src"), F.col("y").cast("int").alias("dst"), "kind")


def parameters(rows: DataFrame) -> DataFrame:
    return _of(rows, "param").select("fn", F.col("n").alias("position"), F.col("x").alias("name"), F.col("y").alias("type"), (F.col("kind") == "default").alias("has_default"))


def returns(rows: DataFrame) -> DataFrame:
    return _of(rows, "return").select("fn", F.col("x").alias("expression"), F.col("y").alias("value"), "line")


def assignments(rows: DataFrame) -> DataFrame:
    return _of(rows, "assign").select("fn", F.col("x").alias("target"), "kind", "line")


def argument_flows(rows: DataFrame) -> DataFrame:
    """(fn, callee, position, param, line): parameters that are passed on as they are"""
    return _of(rows, "arg").select("fn", F.col("x").alias("callee"), F.col("n").alias("position"), F.col("y").alias("param"), "line").distinct()


def mutations(rows: DataFrame) -> DataFrame:
    return _of(rows, "mutation").select("fn", F.col("x").alias("target"), F.col("y").alias("method"), "line").distinct()


def constraints(rows: DataFrame) -> DataFrame:
    """Rows for flow.points_to()."""
    r = _of(rows, "op")
    at = lambda op, c: F.when(F.col("kind").isin(*op), F.col(c))
    return r.select("fn", F.col("kind").alias("op"), at(("new", "copy", "read"), "x").alias("dst"), at(("read", "write"), "y").alias("base"), F.col("z").alias("field"), F.when(F.col("kind") == "copy", F.col("y")).when(F.col("kind") == "write", F.col("x")).alias("src"), at(("new",), "y").alias("site")).distinct()


def calls(rows: DataFrame) -> DataFrame:
    """(fn, callee, position, argument, result) for flow.passed_values(): callees are functions of the called name, in the same file where there is one, else the only one."""
    own = _of(rows, "function").select(F.col("fn").alias("callee"), F.col("x").alias("name"), F.col("path").alias("at"))
    only = own.groupBy("name").agg(F.min("callee").alias("only"), F.count("*").alias("k")).where("k = 1").drop("k")
    near = own.groupBy("name", F.col("at").alias("path")).agg(F.min("callee").alias("near"))
    p = _of(rows, "pass").select("path", "fn", F.col("x").alias("name"), F.col("n").alias("position"), F.col("y").alias("argument"), F.col("kind").alias("result")).distinct()
    return p.join(near, ["path", "name"], "left").join(only, "name", "left").withColumn("callee", F.coalesce("near", "only")).where("callee is not null").select("fn", "callee", "position", "argument", "result")


def complexity(rows: DataFrame) -> DataFrame:
    """One row per function: cognitive, cyclomatic, nesting, lines, and the measures of Halstead and of maintainability as columns' arithmetic."""
    m = _of(rows, "measure").groupBy("fn").pivot("kind", ["cognitive", "cyclomatic", "nesting", "operators", "operands", "total_operators", "total_operands", "lines", "blank", "comments", "source"]).agg(F.first("n"))
    h = text.halstead(*[F.col(c) for c in ("operators", "operands", "total_operators", "total_operands")])
    m = m.select("*", *(c.alias(k) for k, c in h.items()))
    return m.withColumn("maintainability", text.maintainability(F.col("volume"), F.col("cyclomatic"), F.col("source")))


def predicates_at(rows: DataFrame, points: DataFrame) -> DataFrame:
    """(fn, line, rank, kind, predicate): what must hold on the way to points(fn, line), innermost first; lines of the condition itself do not count."""
    p = _of(rows, "predicate").select("fn", "kind", F.col("x").alias("predicate"), F.col("line").alias("first"), F.col("end_line").alias("last"))
    held = points.select("fn", "line").distinct().join(p, "fn").where("line > first and line <= last")
    w = Window.partitionBy("fn", "line").orderBy(F.col("last") - F.col("first"), F.desc("first"), "kind", "predicate")
    return held.select("fn", "line", F.row_number().over(w).alias("rank"), "kind", "predicate")


def guarded(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(fn, guard_line, sink_line) with dominates: whether every way from the entry to the sink's block goes through the guard's; in one block the earlier line does. Null where a line is in no block.

    A line is in the smallest block around it. The blocks of one function are a group.
    """
    spans = blocks(rows).where("kind <> 'Exit'").select("fn", "block", F.col("line").alias("first"), "end_line")
    lines = pairs.select("fn", F.col("guard_line").alias("line")).union(pairs.select("fn", "sink_line")).distinct()
    at = lines.join(spans, "fn").where("line between first and end_line").groupBy("fn", "line").agg(F.min_by("block", F.struct(F.col("end_line") - F.col("first"), -F.col("block"))).alias("block"))
    g = at.select("fn", F.col("line").alias("guard_line"), F.col("block").alias("guard_block"))
    s = at.select("fn", F.col("line").alias("sink_line"), F.col("block").alias("sink_block"))
    asked = pairs.join(g, ["fn", "guard_line"], "left").join(s, ["fn", "sink_line"], "left")
    links = jumps(rows).groupBy("fn").agg(F.collect_list(F.struct("src", "dst")).alias("links"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            told = []
            for a, b, x, y, edges in zip(f.guard_block, f.sink_block, f.guard_line, f.sink_line, f.links, strict=True):
                if pd.isna(a) or pd.isna(b) or edges is None:
                    told.append(None)
                elif a == b:
                    told.append(bool(x < y))
                else:  # the sink is out of reach once the guard's block is taken away
                    seen, stack = {int(a)}, [0] if a != 0 else []
                    while stack:
                        n = stack.pop()
                        if n not in seen:
                            seen.add(n)
                            stack.extend(e["dst"] for e in edges if e["src"] == n)
                    told.append(int(b) not in seen)
            yield pd.DataFrame({"fn": f.fn, "guard_line": f.guard_line, "sink_line": f.sink_line, "dominates": pd.array(told, dtype="boolean")})

    return asked.join(links, "fn", "left").mapInPandas(run, "fn string, guard_line int, sink_line int, dominates boolean")
