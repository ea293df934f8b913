"""Go declarations by tokens: imports, functions, methods, types, constants and variables, with references. No types are resolved."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

_TOKEN = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[^\W\d]\w*|\d[\w.]*|\n|:=|[^\s\w]")
_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_BUILTIN = frozenset("append cap clear close complex copy delete imag len make max min new panic print println real recover nil true false iota any bool byte comparable complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr".split())
_OPEN, _CLOSE = "([{", ")]}"


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(token, start, line) without comments; new lines are kept, since they end statements."""
    out, line, at = [], 1, 0
    for m in _TOKEN.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        if not m[0].startswith(("//", "/*")):
            out.append((m[0], m.start(), line))
    return out


def _word(t: str) -> bool:
    return (t[0].isalpha() or t[0] == "_") and t not in _KEYWORDS


#: The module that a go.mod declares: its first line that is neither blank nor a comment says so, or it declares none.
_MODULE = r'^(?:[ \t\r]*(?://[^\n]*)?\n)*[ \t]*module[ \t]+"?([^\s"]+)'


def with_modules(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows(file, ...) with module: for Go, the import path of a file's folder under the nearest go.mod of files(file, content), or the folder's path without one; else null.

    Folders above a file are few: an equi-join on each of them finds the go.mod, and the longest wins. Only Go files are joined: the others would all meet in one task.
    """
    mods = files.where((paths.basename(F.col("file")) == "go.mod") & F.col("content").isNotNull())
    roots = mods.select(paths.folder(F.col("file")).alias("root"), F.regexp_extract(F.decode("content", "UTF-8"), _MODULE, 1).alias("name")).where("name <> ''")
    folders = rows.where("language = 'Go'").select(paths.folder(F.col("file")).alias("at")).distinct()
    parts = F.split("at", "/")
    above = F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    best = folders.withColumn("root", F.explode(above)).join(roots, "root").groupBy("at").agg(F.max_by(F.struct("root", "name"), F.length("root")).alias("b"))
    rest = F.expr("substring(at, length(b.root) + 1)")
    named = best.select("at", F.concat(F.col("b.name"), F.when((rest == "") | rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))).alias("named"))
    go = F.coalesce(F.col("language") == "Go", F.lit(False))
    own = rows.where(go).withColumn("at", paths.folder(F.col("file"))).join(named, "at", "left").select(*rows.columns, F.coalesce("named", "at").alias("module"))
    return rows.where(~go).withColumn("module", F.lit(None).cast("string")).union(own)


def scan_go(file: str, source: bytes, module: str | None = None) -> dict[str, Any]:
    """A row of the scan table. Unbalanced brackets or no package clause give a parse_error. module is the file's import path; its folder, if None."""
    row: dict[str, Any] = {"file": file, "language": "Go", "module": module, "length": len(source), "parse_error": None, "init_code": False}
    row |= {k: [] for k in ("declarations", "imports", "edges", "exports", "guards", "calls", "handlers")} | {"defs": {}, "counters": None}
    text = source.decode("utf-8", "replace")
    toks = tokens(text)
    depth, match, stack = 0, {}, []
    for k, (t, _, line) in enumerate(toks):
        if t in _OPEN:
            stack.append(k)
        elif t in _CLOSE:
            if not stack or _OPEN.index(toks[stack[-1]][0]) != _CLOSE.index(t):
                return row | {"parse_error": f"SyntaxError: unexpected {t} (line {line})"}
            match[stack.pop()] = k
    if stack:
        return row | {"parse_error": f"SyntaxError: {toks[stack[-1]][0]} isn't closed (line {toks[stack[-1]][2]})"}
    words = [k for k, x in enumerate(toks) if x[0] != "\n"]
    if not words or toks[words[0]][0] != "package":
        return row | {"parse_error": "SyntaxError: no package clause (line 1)"}
    prefix = row["module"] = module or "/".join(file.split("/")[:-1]) or toks[words[1]][0]
    n, k, declarations, imports = len(toks), 0, [], []

    def skip(k: int) -> int:
        """After the statement at k."""
        while k < n and toks[k][0] != "\n":
            k = match[k] + 1 if k in match else k + 1
        return k + 1

    def add(kind: str, leaf: str, a: int, z: int, receiver: str | None = None, params: set[str] = frozenset()) -> None:
        if leaf == "_":
            return
        first, last = toks[a], toks[min(z, n - 1)]
        end = last[1] + len(last[0])
        head = text[first[1] : end].split("\n")[0].rstrip("{ ").strip()
        local = set(params) | {leaf} | {toks[i - 1][0] for i in range(a + 1, z) if toks[i][0] == ":="}
        refs = set()
        for i in range(a, z + 1):
            t, _, line = toks[i]
            if not _word(t):
                continue
            if i and toks[i - 1][0] == ".":
                refs.add((t, "attr", line))
            elif t not in local and t not in _BUILTIN and t != receiver:
                refs.add((t, "name", line))
        path = ".".join(filter(None, (prefix, receiver, leaf)))
        body = [x for x in text[first[1] : end].split("\n")[1:-1] if x.strip() and not x.strip().startswith("//")][:3]
        margin = min((len(x) - len(x.lstrip()) for x in body), default=0)
        s_byte = len(text[: first[1]].encode())
        declarations.append({
            "idx": len(declarations), "parent": -1, "path": path, "leaf": leaf, "kind": kind, "s_line": first[2], "e_line": last[2] + last[0].count("\n"), "s_byte": s_byte, "col": 0, "body_byte": None, "indent": None, "e_byte": s_byte + len(text[first[1] : end].encode()),
            "signature": head, "preview": "\n".join(x[margin:] for x in body), "refs": [{"name": a, "kind": b, "line": c} for a, b, c in sorted(refs, key=lambda r: (r[2], r[0], r[1]))],
        })

    def specs(k: int) -> list[tuple[int, int]]:
        """(first, last token) of each spec of a declaration at k."""
        i = k + 1
        if toks[i][0] != "(":
            return [(i, skip(i) - 2)]
        out, i, end = [], i + 1, match[i]
        while i < end:
            if toks[i][0] == "\n":
                i += 1
                continue
            z = i
            while z < end and toks[z][0] != "\n":
                z = match[z] + 1 if z in match else z + 1
            out.append((i, z - 1))
            i = z + 1
        return out

    while k < n:
        t = toks[k][0]
        if t == "import":
            for a, z in specs(k):
                own = [toks[i] for i in range(a, z + 1)]
                path = next((x[0].strip('"`') for x in own if x[0][0] in '"`'), None)
                if path:
                    imports.append({"name": own[0][0] if len(own) > 1 else path.rsplit("/", 1)[-1], "source": path, "line": own[0][2]})
        elif t == "func":
            i, receiver, params = k + 1, None, set()
            if toks[i][0] == "(":
                inner = [x[0] for x in toks[i + 1 : match[i]] if _word(x[0])]
                inner_depth = [x[0] for x in toks[i + 1 : match[i]]]
                receiver = inner[0] if len(inner) == 1 or "[" in inner_depth[:2] else inner[1]
                params |= {inner[0]} if len(inner) > 1 else set()
                i = match[i] + 1
            leaf = toks[i][0]
            i += 1
            if toks[i][0] == "[":
                i = match[i] + 1
            end = match[i]
            for j in range(i + 1, end):
                if _word(toks[j][0]) and toks[j - 1][0] in "(,":
                    params.add(toks[j][0])
            z = skip(k) - 2
            add("method" if receiver else "function", leaf, k, z, receiver, params)
        elif t in ("type", "const", "var"):
            for a, z in specs(k):
                grouped = toks[k + 1][0] == "("
                i = a
                while i <= z and _word(toks[i][0]):
                    add(t, toks[i][0], a if grouped else k, z)
                    if t == "type" or i + 1 > z or toks[i + 1][0] != ",":
                        break
                    i += 2
        k = skip(k)
    edges = [{"ord": i, "module": x["source"], "names": [], "scope": "top", "line": x["line"], "level": 0} for i, x in enumerate(imports)]
    return row | {"declarations": declarations, "imports": imports, "edges": edges}
