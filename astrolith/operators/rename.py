"""Renames: the places of a name in candidate files, in three buckets, and the edits, checks and statuses that follow.

Python names are followed by syntax, scope and imports; Go names by tokens, packages and import names, without types.
"""

from __future__ import annotations

import ast
import keyword
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..sources import go_scan
from ..sources.python_scan import absolute_module, dotted, module_prefix

PLACES = "file string, bucket string, line int, start bigint, end bigint, kind string"
Place = tuple[str, int, int, int, str]
_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)
_COMPREHENSION = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


class _Text:
    """Bytes of a source, by line and column."""

    def __init__(self, source: str):
        self.raw = source.encode().split(b"\n")
        self.begin = [0]
        for x in self.raw:
            self.begin.append(self.begin[-1] + len(x) + 1)

    def place(self, bucket: str, line: int, col: int, leaf: str, kind: str) -> Place:
        a = self.begin[line - 1] + col
        return bucket, line, a, a + len(leaf.encode()), kind

    def after(self, node: ast.AST, leaf: str) -> int:
        """Column of the name that a def, class or global statement gives."""
        return self.raw[node.lineno - 1].index(leaf.encode(), node.col_offset)


def _arguments(node: ast.AST) -> list[ast.arg]:
    a = node.args
    return [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]


def bindings(node: ast.AST) -> set[str]:
    """Names that a function, class, lambda, comprehension or module binds in its own scope, without those it declares global."""
    out, free = set(), set()
    todo = [node.body] if isinstance(node, ast.Lambda) else list(node.generators) if isinstance(node, _COMPREHENSION) else list(node.body)
    if isinstance(node, (*_DEF, ast.Lambda)):
        out |= {a.arg for a in _arguments(node)}
    while todo:
        x = todo.pop()
        if isinstance(x, (*_DEF, ast.ClassDef)):
            out.add(x.name)
            continue
        if isinstance(x, (ast.Lambda, *_COMPREHENSION)):
            continue
        if isinstance(x, ast.Name) and isinstance(x.ctx, (ast.Store, ast.Del)):
            out.add(x.id)
        elif isinstance(x, (ast.Import, ast.ImportFrom)):
            out |= {(a.asname or a.name).split(".")[0] for a in x.names}
        elif isinstance(x, ast.ExceptHandler) and x.name:
            out.add(x.name)
        elif isinstance(x, (ast.Global, ast.Nonlocal)):
            free |= set(x.names)
        elif isinstance(x, ast.NamedExpr) and isinstance(node, _COMPREHENSION):
            todo.append(x.value)
            continue
        todo += ast.iter_child_nodes(x)
    return out - free


def module_places(source: str, file: str, module: str, leaf: str) -> list[Place]:
    """Places of the module-level name leaf of module in a file.

    Rewritten are bare names in the module itself and in files that import the name from it or from a package above it, such imports, and attributes of what an import binds
    to the module. Imports from other modules, attributes of other modules and names that a scope binds anew are skipped_mismatch; other names have no place.
    """
    tree, text = ast.parse(source), _Text(source)
    own = module_prefix(file)
    declares = own == module
    known, imported, out = {}, False, []
    origin = {}
    for x in ast.walk(tree):
        if isinstance(x, ast.Import):
            for a in x.names:
                known[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
        elif isinstance(x, ast.ImportFrom):
            base = absolute_module(file, x.level, x.module)
            for a in x.names:
                origin[id(a)] = base
                known[a.asname or a.name] = f"{base}.{a.name}" if base else a.name
                if a.name == leaf and a.asname in (None, leaf) and base and (base == module or module.startswith(base + ".")):
                    imported = True
    visible = declares or imported

    def add(bucket: str, line: int, col: int, kind: str) -> None:
        out.append(text.place(bucket, line, col, leaf, kind))

    def verdict(shadow: bool) -> str | None:
        if shadow:
            return "skipped_mismatch"
        return "rewrite" if visible else "skipped_mismatch" if leaf in top else None

    def walk(node: ast.AST, shadow: bool, enclosing: bool) -> None:
        """shadow: a scope here binds leaf; enclosing: a function around does, which a class within sees through."""
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (*_DEF, ast.ClassDef)):
                if x.name == leaf and (bucket := verdict(shadow)):
                    add(bucket, x.lineno, text.after(x, leaf), "definition")
                binds = leaf in bindings(x)
                for y in x.decorator_list:
                    walk(ast.Expr(y), shadow, enclosing)
                if isinstance(x, ast.ClassDef):
                    for y in (*x.bases, *(k.value for k in x.keywords)):
                        walk(ast.Expr(y), shadow, enclosing)
                    walk(ast.Module(x.body, []), binds or enclosing, enclosing)
                else:
                    for y in (*x.args.defaults, *filter(None, x.args.kw_defaults), *filter(None, (a.annotation for a in _arguments(x))), *filter(None, [x.returns])):
                        walk(ast.Expr(y), shadow, enclosing)
                    inner = binds or (enclosing and leaf not in _globals(x))
                    walk(ast.Module(x.body, []), inner, inner)
                continue
            if isinstance(x, (ast.Lambda, *_COMPREHENSION)):
                inner = shadow or leaf in bindings(x)
                walk(x, inner, inner)
                continue
            if isinstance(x, ast.Name) and x.id == leaf:
                if bucket := verdict(shadow):
                    add(bucket, x.lineno, x.col_offset, "name")
            elif isinstance(x, ast.Global) and leaf in x.names and visible:
                add("rewrite", x.lineno, text.after(x, leaf), "global")
            elif isinstance(x, ast.Attribute) and x.attr == leaf and (chain := dotted(x.value)):
                head, *rest = chain.split(".")
                if head in known:
                    bucket = "rewrite" if ".".join([known[head], *rest]) == module else "skipped_mismatch"
                    add(bucket, x.end_lineno, x.end_col_offset - len(leaf.encode()), "attribute")
            elif isinstance(x, ast.alias) and x.name == leaf and origin.get(id(x)):
                base = origin[id(x)]
                add("rewrite" if base == module or module.startswith(base + ".") else "skipped_mismatch", x.lineno, x.col_offset, "import")
            walk(x, shadow, enclosing)

    top = bindings(tree)
    walk(tree, False, False)
    return sorted(set(out), key=lambda p: p[2])


def _globals(node: ast.AST) -> set[str]:
    return {n for x in ast.walk(node) if isinstance(x, ast.Global) for n in x.names}


def member_places(source: str, leaf: str, owner: str, unique: bool) -> list[Place]:
    """Places of the member leaf of the class owner.

    All of them are rewritten if no other declaration has the name, else those on self, cls, the class under whatever name it is imported, and on a variable that is built from, annotated
    with, or returned by a function annotated with it. Those on other known classes are skipped_mismatch, and the rest is unresolved.
    """
    tree, text, out = ast.parse(source), _Text(source), []
    classes = {x.name: x.name for x in ast.walk(tree) if isinstance(x, ast.ClassDef)} | {owner: owner}
    for x in ast.walk(tree):
        if isinstance(x, ast.ImportFrom):
            classes |= {a.asname or a.name: a.name for a in x.names if a.name == owner or (a.asname or a.name)[:1].isupper()}
    made = {x.name: t for x in ast.walk(tree) if isinstance(x, _DEF) and x.returns is not None and (t := _class_name(x.returns))}

    def built(node: ast.AST) -> str | None:
        """The class of what a call makes."""
        if not (isinstance(node, ast.Call) and (name := dotted(node.func))):
            return None
        last = name.rsplit(".", 1)[-1]
        return classes.get(last) or classes.get(made.get(last, "")) or made.get(last) or (last if last[:1].isupper() else None)

    def walk(node: ast.AST, cls: str | None, types: dict[str, str]) -> None:
        if isinstance(node, ast.ClassDef):
            for x in ast.iter_child_nodes(node):
                walk(x, node.name, types)
            return
        if isinstance(node, (*_DEF, ast.Lambda)):
            own = _arguments(node)
            if not isinstance(node, ast.Lambda) and node.name == leaf and (unique or cls == owner):
                out.append(text.place("rewrite", node.lineno, text.after(node, leaf), leaf, "definition"))
            types = types | {a.arg: classes.get(t, t) for a in own if a.annotation is not None and (t := _class_name(a.annotation))}
            if cls and own:
                types = types | {own[0].arg: cls}
            for x in ast.iter_child_nodes(node):
                walk(x, None, types)
            return
        if isinstance(node, ast.Assign) and (t := built(node.value)):
            types |= {x.id: t for x in node.targets if isinstance(x, ast.Name)}
        if isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name) and (t := _class_name(node.annotation)):
            types[node.target.id] = classes.get(t, t)
        if isinstance(node, ast.Attribute) and node.attr == leaf:
            v = node.value
            kind = (classes.get(v.id) or types.get(v.id)) if isinstance(v, ast.Name) else built(v)
            bucket = "rewrite" if unique or kind == owner else "skipped_mismatch" if kind else "unresolved"
            out.append(text.place(bucket, node.end_lineno, node.end_col_offset - len(leaf.encode()), leaf, "attribute"))
        for x in ast.iter_child_nodes(node):
            walk(x, None, types)

    walk(tree, None, {})
    return sorted(set(out), key=lambda p: p[2])


def _class_name(annotation: ast.AST) -> str | None:
    """The class that an annotation names: plain, dotted or in quotes."""
    if isinstance(annotation, ast.Constant) and isinstance(annotation.value, str):
        return annotation.value.rsplit(".", 1)[-1]
    name = dotted(annotation)
    return name.rsplit(".", 1)[-1] if name else None


def go_places(source: str, package: str, own: str, leaf: str, member: bool, unique: bool) -> list[Place]:
    """Places of a package's name, or of a type's member, in a Go file of package own, by tokens.

    A package's name is rewritten bare in its own package and after an import's name in others; a member after any receiver, if no other declaration has its name. What is left is
    unresolved.
    """
    toks = [t for t in go_scan.tokens(source) if t[0] != "\n"]
    names = {x["name"]: x["source"] for x in go_scan.scan_go("x.go", source.encode())["imports"]}
    out, size = [], len(leaf.encode())
    for k, (t, at, line) in enumerate(toks):
        if t != leaf:
            continue
        before, two = toks[k - 1][0] if k else "", toks[k - 2][0] if k > 1 else ""
        if before == ".":
            bucket = ("rewrite" if unique else "unresolved") if member else "rewrite" if names.get(two) == package else None if two in names else "unresolved" if own == package else None
        elif member:
            bucket = "rewrite" if before == ")" and (unique or own == package) else None
        else:
            bucket = "rewrite" if own == package else None
        if bucket:
            a = len(source[:at].encode())
            out.append((bucket, line, a, a + size, "selector" if before == "." else "name"))
    return out


def rename_places(files: DataFrame, path: str, owners: int, member: bool) -> DataFrame:
    """PLACES of the last segment of path in files(file, content) of Python. member: its parent is a class. owners: declarations with that last segment.

    Files that don't parse have one unresolved row without a place; null contents have none.
    """
    module, _, leaf = path.rpartition(".")
    owner = module.rpartition(".")[2]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for file, content in zip(f["file"], f["content"], strict=True):
                try:
                    text = content.decode("utf-8")
                    rows += [(file, *p) for p in (member_places(text, leaf, owner, owners <= 1) if member else module_places(text, file, module, leaf))]
                except (SyntaxError, UnicodeDecodeError, ValueError, RecursionError):
                    rows.append((file, "unresolved", None, None, None, "file"))
            yield pd.DataFrame(rows, columns=["file", "bucket", "line", "start", "end", "kind"]).astype({"line": "Int32", "start": "Int64", "end": "Int64"})

    return files.select("file", "content").where("content IS NOT NULL").mapInPandas(run, PLACES)


def go_rename_places(files: DataFrame, path: str, owners: int, member: bool) -> DataFrame:
    """PLACES of the last segment of path in files(file, content, module) of Go, module being a file's import path."""
    package, _, leaf = path.rpartition(".")
    package = package.rpartition(".")[0] if member else package

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(file, *p) for file, content, own in zip(f["file"], f["content"], f["module"], strict=True) for p in go_places(content.decode("utf-8", "replace"), package, own, leaf, member, owners <= 1)]
            yield pd.DataFrame(rows, columns=["file", "bucket", "line", "start", "end", "kind"]).astype({"line": "Int32", "start": "Int64", "end": "Int64"})

    return files.select("file", "content", "module").where("content IS NOT NULL").mapInPandas(run, PLACES)


def rename_edits(found: DataFrame, new: str) -> DataFrame:
    """edits of the places to rewrite."""
    return found.where("bucket = 'rewrite'").select("file", F.lit(0).alias("k"), "start", "end", F.lit(new).alias("new"))


def rename(tables: dict[str, DataFrame], path: str, new: str) -> tuple[str, DataFrame | None]:
    """(status, places) of a rename of the declaration at path, over the tables of a project.

    Statuses: bad_name (no identifier, or the old one), not_found, ambiguous, collision (its parent has the new name already), unsupported (another language), and ok with
    PLACES. Only files that hold the old name as a word are read.
    """
    leaf = path.rpartition(".")[2]
    if not new.isidentifier() or keyword.iskeyword(new) or new == leaf:
        return "bad_name", None
    own = tables["declarations"]
    hits = own.where(F.col("path") == path).select("id", "language", "parent", "kind").limit(2).collect()
    if len(hits) != 1:
        return ("ambiguous" if hits else "not_found"), None
    hit = hits[0]
    beside = f"{path.rpartition('.')[0]}.{new}"
    if not own.where(F.col("path") == beside).isEmpty():
        return "collision", None
    if hit["language"] not in ("Python", "Go"):
        return "unsupported", None
    owners = own.where((paths.leaf(F.col("path")) == leaf) & (F.col("language") == hit["language"])).count()
    held = tables["files"].where((F.col("language") == hit["language"]) & F.decode("content", "UTF-8").rlike(rf"\b\Q{leaf}\E\b"))
    if hit["language"] == "Go":
        modules = tables["scan"].where("language = 'Go'").select("file", "module")
        return "ok", go_rename_places(held.select("file", "content").join(modules, "file"), path, owners, hit["kind"] == "method")
    member = hit["parent"] is not None and not own.where((F.col("id") == hit["parent"]) & (F.col("kind") == "class")).isEmpty()
    return "ok", rename_places(held, path, owners, member)
