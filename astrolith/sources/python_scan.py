"""One pass over source files: syntax trees become nested columns, and everything after is relational."""

from __future__ import annotations

import ast
import builtins
import copy
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schemas import SCAN
from . import go_scan

_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)
_NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, *_DEF)
_BUILTIN = frozenset(dir(builtins))
PREVIEW_LINES = 3


def module_prefix(path: str) -> str:
    """Dotted module of a Python file: without a leading src, the ending and __init__."""
    path = re.sub(r"\.pyi?$", "", path.removeprefix("./").removeprefix("src/"))
    parts = [p for p in path.split("/") if p]
    if parts and parts[-1] == "__init__":
        parts.pop()
    return ".".join(parts)


def dotted(node: ast.AST) -> str | None:
    """a.b.c of a chain of attributes that starts at a name."""
    out = []
    while isinstance(node, ast.Attribute):
        out.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(out)]) if isinstance(node, ast.Name) else None


def _children(node: ast.AST) -> list[ast.AST]:
    """Child nodes that hold something, in their order; what only says how a name or operator is used is left out."""
    out: list[ast.AST] = []
    for f in node._fields:
        v = getattr(node, f, None)
        if v.__class__ is list:
            out += [x for x in v if isinstance(x, ast.AST)]
        elif isinstance(v, ast.AST) and v._fields:
            out.append(v)
    return out


def _walk(node: ast.AST) -> list[ast.AST]:
    """A node and all below it."""
    out = [node]
    for x in out:
        out += _children(x)
    return out


def complexity(node: ast.AST) -> int:
    """1, and 1 for each branch, loop, handler, with and assert, and for each further operand of and/or."""
    total = 1
    for x in _walk(node):
        if isinstance(x, (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert)):
            total += 1
        elif isinstance(x, ast.BoolOp):
            total += len(x.values) - 1
    return total


def nesting(node: ast.AST) -> int:
    """Deepest nesting of blocks within node; an elif is an if in the else of another."""
    return max((isinstance(x, _NESTING) + nesting(x) for x in _children(node)), default=0)


def _bound(target: ast.AST) -> Iterator[str]:
    if isinstance(target, ast.Name):
        yield target.id
    elif isinstance(target, (ast.Tuple, ast.List)):
        for x in target.elts:
            yield from _bound(x)
    elif isinstance(target, ast.Starred):
        yield from _bound(target.value)


def definitions(tree: ast.Module) -> dict[str, int]:
    """First line that binds each name at the top of a module."""
    out: dict[str, int] = {}
    for x in tree.body:
        if isinstance(x, (*_DEF, ast.ClassDef)):
            names = [x.name]
        elif isinstance(x, ast.Assign):
            names = [n for t in x.targets for n in _bound(t)]
        elif isinstance(x, ast.AnnAssign):
            names = list(_bound(x.target))
        elif isinstance(x, ast.Import):
            names = [a.asname or a.name.split(".")[0] for a in x.names]
        elif isinstance(x, ast.ImportFrom):
            names = [a.asname or a.name for a in x.names]
        else:
            continue
        for n in names:
            out.setdefault(n, x.lineno)
    return out


def _is_type_checking(test: ast.AST) -> bool:
    return (isinstance(test, ast.Name) and test.id == "TYPE_CHECKING") or (isinstance(test, ast.Attribute) and test.attr == "TYPE_CHECKING")


def is_main_guard(node: ast.AST) -> bool:
    if not (isinstance(node, ast.If) and isinstance(t := node.test, ast.Compare) and len(t.ops) == 1 and isinstance(t.ops[0], ast.Eq)):
        return False
    sides = (t.left, t.comparators[0])
    return any(isinstance(a, ast.Name) and a.id == "__name__" and isinstance(b, ast.Constant) and b.value == "__main__" for a, b in (sides, sides[::-1]))


def absolute_module(file: str, level: int, module: str | None) -> str:
    """The module that an import of a file names, level being its leading dots."""
    if not level:
        return module or ""
    prefix = module_prefix(file).split(".")
    package = prefix if file.endswith("__init__.py") else prefix[:-1]
    return ".".join(p for p in [*package[: max(0, len(package) - level + 1)], *(module or "").split(".")] if p)


def import_edges(tree: ast.Module, file: str) -> list[dict[str, Any]]:
    """Imports of a file in the order of its lines, with absolute modules. match and except* blocks are not entered."""
    out: list[dict[str, Any]] = []

    def walk(body: list[ast.stmt], scope: str) -> None:
        for x in body:
            if isinstance(x, ast.Import):
                for a in x.names:
                    out.append({"module": a.name, "names": [], "scope": scope, "line": x.lineno, "level": 0})
            elif isinstance(x, ast.ImportFrom):
                out.append({"module": absolute_module(file, x.level, x.module), "names": [a.name for a in x.names], "scope": scope, "line": x.lineno, "level": x.level})
            elif isinstance(x, ast.If):
                walk(x.body, "type_checking" if _is_type_checking(x.test) else scope)
                walk(x.orelse, scope)
            elif isinstance(x, ast.Try):
                for part in (x.body, *[h.body for h in x.handlers], x.orelse, x.finalbody):
                    walk(part, scope)
            elif isinstance(x, (ast.For, ast.AsyncFor, ast.While)):
                walk(x.body, scope)
                walk(x.orelse, scope)
            elif isinstance(x, (ast.With, ast.AsyncWith)):
                walk(x.body, scope)
            elif isinstance(x, _DEF):
                walk(x.body, "deferred")
            elif isinstance(x, ast.ClassDef):
                walk(x.body, scope)

    walk(tree.body, "top")
    return [e | {"ord": k} for k, e in enumerate(out)]


def local_names(node: ast.AST) -> set[str]:
    """Names that a definition binds itself: parameters, targets, loop and handler names, nested definitions."""
    out: set[str] = set()
    for x in _walk(node):
        if isinstance(x, ast.arg):
            out.add(x.arg)
        elif isinstance(x, ast.Name) and isinstance(x.ctx, (ast.Store, ast.Del)):
            out.add(x.id)
        elif isinstance(x, ast.ExceptHandler) and x.name:
            out.add(x.name)
        elif isinstance(x, (*_DEF, ast.ClassDef)) and x is not node:
            out.add(x.name)
    return out


def references(node: ast.AST) -> list[dict[str, Any]]:
    """(name, kind, line) used in a definition, without its own names and, for plain names, builtins; nested definitions have their own."""
    local, out = local_names(node), set()
    todo: list[ast.AST] = list(_children(node))
    while todo:
        x = todo.pop()
        if isinstance(node, ast.ClassDef) and isinstance(x, (*_DEF, ast.ClassDef)):
            continue
        if isinstance(x, ast.Attribute):
            out.add((x.attr, "attr", x.lineno))
        elif isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load) and x.id not in local and x.id not in _BUILTIN:
            out.add((x.id, "name", x.lineno))
        todo += _children(x)
    return [{"name": n, "kind": k, "line": line} for n, k, line in sorted(out, key=lambda r: (r[2], r[0], r[1]))]


def _swallows(body: list[ast.stmt]) -> bool:
    return not body or (len(body) == 1 and (isinstance(body[0], ast.Pass) or (isinstance(body[0], ast.Expr) and isinstance(c := body[0].value, ast.Constant) and (c.value is ... or isinstance(c.value, str)))))


def swallowed_handlers(tree: ast.Module) -> list[dict[str, Any]]:
    """Handlers without effect, with the name of the nearest definition. Handlers' bodies, match and except* are not entered."""
    out: list[dict[str, Any]] = []

    def walk(body: list[ast.stmt], context: str) -> None:
        for x in body:
            if isinstance(x, ast.Try):
                for h in x.handlers:
                    if _swallows(h.body):
                        out.append({"line": h.lineno, "type": ast.unparse(h.type) if h.type else "bare except", "context": context})
                for part in (x.body, x.orelse, x.finalbody):
                    walk(part, context)
            elif isinstance(x, (*_DEF, ast.ClassDef)):
                walk(x.body, x.name)
            elif isinstance(x, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith)):
                walk(x.body, context)
                walk(getattr(x, "orelse", []), context)

    walk(tree.body, "")
    return out


def counters(tree: ast.Module) -> dict[str, int]:
    """Definitions and annotations at the top of a module and right in its classes."""
    n = dict.fromkeys(("functions", "methods", "classes", "callable_lines", "typed_functions", "args", "typed_args", "attrs", "typed_attrs", "vars", "typed_vars"), 0)

    def function(x: ast.FunctionDef | ast.AsyncFunctionDef, method: bool) -> None:
        n["methods" if method else "functions"] += 1
        n["callable_lines"] += x.end_lineno - x.lineno + 1
        n["typed_functions"] += x.returns is not None
        a = x.args
        for k, arg in enumerate([*a.args, *a.posonlyargs, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]):
            if not (method and k == 0 and arg.arg in ("self", "cls")):
                n["args"] += 1
                n["typed_args"] += arg.annotation is not None

    for x in tree.body:
        if isinstance(x, _DEF):
            function(x, False)
        elif isinstance(x, ast.ClassDef):
            n["classes"] += 1
            for c in x.body:
                if isinstance(c, _DEF):
                    function(c, True)
                elif isinstance(c, (ast.Assign, ast.AnnAssign)):
                    n["attrs"] += 1
                    n["typed_attrs"] += isinstance(c, ast.AnnAssign)
        elif isinstance(x, (ast.Assign, ast.AnnAssign)):
            n["vars"] += 1
            n["typed_vars"] += isinstance(x, ast.AnnAssign)
    return n


def exports(tree: ast.Module) -> list[dict[str, Any]]:
    """Definitions at the top and public variables, with complexity, depth and uses within the file (-1 for variables)."""
    uses: dict[str, int] = {}
    for x in _walk(tree):
        if isinstance(x, ast.Name):
            uses[x.id] = uses.get(x.id, 0) + 1
    out = []
    for x in tree.body:
        if isinstance(x, (*_DEF, ast.ClassDef)):
            methods = []
            if isinstance(x, ast.ClassDef):
                methods = [{"name": c.name, "line": c.lineno, "lines": c.end_lineno - c.lineno + 1, "complexity": complexity(c), "max_depth": nesting(c), "is_async": isinstance(c, ast.AsyncFunctionDef)} for c in x.body if isinstance(c, _DEF)]
                methods.sort(key=lambda m: (-m["complexity"], m["line"]))
            kind = "class" if isinstance(x, ast.ClassDef) else "async_function" if isinstance(x, ast.AsyncFunctionDef) else "function"
            out.append({"name": x.name, "kind": kind, "line": x.lineno, "lines": x.end_lineno - x.lineno + 1, "complexity": complexity(x), "max_depth": nesting(x), "internal_refs": uses.get(x.name, 0), "methods": methods})
        elif isinstance(x, (ast.Assign, ast.AnnAssign)):
            for t in x.targets if isinstance(x, ast.Assign) else [x.target]:
                if isinstance(t, ast.Name) and not t.id.startswith("_"):
                    out.append({"name": t.id, "kind": "variable", "line": x.lineno, "lines": x.end_lineno - x.lineno + 1, "complexity": 0, "max_depth": 0, "internal_refs": -1, "methods": []})
    return out


def signature(node: ast.AST, source: bytes) -> str:
    """The head of a definition as Python writes it, whatever its length; the first line of its source where that goes too deep to write."""
    head = copy.copy(node)
    head.body, head.decorator_list = [ast.Expr(ast.Constant(...))], []
    try:
        return ast.unparse(head).split("\n")[0].removesuffix(" ...").rstrip(":")
    except RecursionError:
        return next((x.strip() for x in source.decode("utf-8", "replace").splitlines() if x.strip()), "")


def preview(node: ast.AST, lines: list[str]) -> str:
    """The first lines of a definition's body, without docstring and comments."""
    body = node.body
    if isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
        body = body[1:]
    if not body:
        return ""
    code = [x for x in lines[body[0].lineno - 1 : node.end_lineno] if x.strip() and not x.strip().startswith("#")][:PREVIEW_LINES]
    indent = min((len(x) - len(x.lstrip()) for x in code), default=0)
    return "\n".join(x[indent:] for x in code)


def _body(node: ast.AST, starts: list[int]) -> dict[str, int | None]:
    """Where text can be put at the head of a definition's body: the line of the first statement that is no docstring, and its column. None if the body is on the head's line."""
    first = node.body[0]
    if first.lineno == node.lineno:
        return {"body_byte": None, "indent": None}
    doc = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
    at = first.end_lineno + 1 if doc else min([first.lineno, *[d.lineno for d in getattr(first, "decorator_list", [])]])
    return {"body_byte": starts[at - 1] if at <= len(starts) else None, "indent": first.col_offset}


def declarations(tree: ast.Module, file: str, source: bytes) -> list[dict[str, Any]]:
    """Definitions that are children of the module or of a definition, parents before children."""
    raw = source.split(b"\n")
    starts = [0]
    for x in raw:
        starts.append(starts[-1] + len(x) + 1)
    lines, out = source.decode("utf-8", "replace").split("\n"), []

    def walk(body: list[ast.stmt], prefix: str, parent: int, in_class: bool) -> None:
        for x in body:
            if not isinstance(x, (*_DEF, ast.ClassDef)):
                continue
            kind = "class" if isinstance(x, ast.ClassDef) else ("async_" * isinstance(x, ast.AsyncFunctionDef)) + ("method" if in_class else "function")
            first = min([x.lineno, *[d.lineno for d in x.decorator_list]])
            a, z = starts[first - 1], min(starts[x.end_lineno] - 1, len(source))
            path, idx = f"{prefix}.{x.name}" if prefix else x.name, len(out)
            out.append({"idx": idx, "parent": parent, "path": path, "leaf": x.name, "kind": kind, "s_line": first, "e_line": x.end_lineno, "s_byte": a, "e_byte": z, "col": x.col_offset, **_body(x, starts), "signature": signature(x, source[a:z]), "preview": preview(x, lines), "refs": references(x)})
            walk(x.body, path, idx, isinstance(x, ast.ClassDef))

    walk(tree.body, module_prefix(file), -1, False)
    return out


def module_imports(tree: ast.Module) -> list[dict[str, Any]]:
    """Names that imports at the top of a module bind."""
    out = []
    for x in tree.body:
        if isinstance(x, ast.Import):
            out += [{"name": a.asname or a.name.split(".")[0], "source": a.name, "line": x.lineno} for a in x.names]
        elif isinstance(x, ast.ImportFrom):
            module = "." * x.level + (x.module or "")
            out += [{"name": a.asname or a.name, "source": f"{module}.{a.name}" if not module.endswith(".") else module + a.name, "line": x.lineno} for a in x.names]
    return out


def scan_python(file: str, source: bytes, _module: str | None = None) -> dict[str, Any]:
    """A row of SCAN. What doesn't parse has a parse_error and empty lists."""
    row: dict[str, Any] = {"file": file, "language": "Python", "module": module_prefix(file), "length": len(source), "parse_error": None, "init_code": False}
    row |= {k: [] for k in ("declarations", "imports", "edges", "exports", "guards", "calls", "handlers")} | {"defs": {}, "counters": None}
    try:
        tree = ast.parse(source.decode("utf-8"))
    except SyntaxError as e:
        return row | {"parse_error": f"SyntaxError: {e.msg} (line {e.lineno})"}
    except (UnicodeDecodeError, ValueError, RecursionError) as e:
        return row | {"parse_error": f"{type(e).__name__}: {e}"}
    guards = []
    for x in tree.body:
        if is_main_guard(x):
            found = [{"line": c.lineno, "call": f"{n}()"} for c in _walk(x) if isinstance(c, ast.Call) and (n := dotted(c.func))]
            guards += sorted(found, key=lambda g: (g["line"], g["call"])) or [{"line": x.lineno, "call": None}]
    calls = [{"line": x.lineno, "call": n, "leaf": n.rsplit(".", 1)[-1]} for x in tree.body if isinstance(x, ast.Expr) and isinstance(x.value, ast.Call) and (n := dotted(x.value.func))]
    plain = (ast.Import, ast.ImportFrom, ast.Pass)
    code = any(not isinstance(x, plain) and not (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant)) and not (isinstance(x, ast.Assign) and all(isinstance(t, ast.Name) and t.id == "__all__" for t in x.targets)) and not (isinstance(x, ast.If) and _is_type_checking(x.test)) for x in tree.body)
    return row | {
        "declarations": declarations(tree, file, source), "imports": module_imports(tree), "edges": import_edges(tree, file), "exports": exports(tree), "guards": guards, "calls": calls,
        "handlers": swallowed_handlers(tree), "defs": definitions(tree), "counters": counters(tree), "init_code": code,
    }


Scanner = Callable[[str, bytes, str | None], dict[str, Any]]
#: Scanners of each language by tier, the highest of which is taken.
_SCANNERS: dict[str, dict[int, Scanner]] = {"Python": {0: scan_python}, "Go": {0: go_scan.scan_go}}


def add_scanner(language: str, scanner: Scanner, tier: int = 1, available: Callable[[], bool] = lambda: True) -> bool:
    """Registers a scanner of (file, content, module) that returns a row of SCAN, if it is available here; lower tiers stay for when it isn't. Executors need its module as well."""
    if available():
        _SCANNERS.setdefault(language, {})[tier] = scanner
        return True
    return False


def scanners() -> dict[str, Scanner]:
    """The scanner of the highest tier of each language."""
    return {language: tiers[max(tiers)] for language, tiers in _SCANNERS.items() if tiers}


def scan(files: DataFrame) -> DataFrame:
    """SCAN rows of files(file, language, content binary) in the languages that have a scanner; others and null contents have no row.

    A file that doesn't parse has a row with parse_error. Repeated files are scanned each. The module of a Go file is its import path, if a go.mod of files lies above it.
    """
    schema, best = to_arrow_schema(StructType.fromDDL(SCAN)), scanners()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [best[lang](file, content, module) for file, lang, content, module in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[i : i + 256], schema=schema)

    wanted = F.col("language").isin(*best) & F.col("content").isNotNull() & F.col("file").isNotNull()
    own = go_scan.with_modules(files.where(wanted).select("file", "language", "content"), files)
    return own.select("file", "language", "content", "module").mapInArrow(run, SCAN)
