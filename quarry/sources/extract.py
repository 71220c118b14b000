"""Symbols of source files: declarations found by scanning text whose comments and strings are blanked out.

Files are parsed in Arrow batches on the executors; what cannot be parsed has no symbols. Line-shaped formats are column
expressions and don't come here (see lines).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.lineage import spread
from quarry.sources import lines as L

SCHEMA = "path string, language string, name string, kind string, line int, end_line int, signature string, doc_comment string, parent_name string, refs array<string>"
_NAME = r"[A-Za-z_$][\w$]*"
_CALL = re.compile(rf"(?<!new )(?<![\w.$])({_NAME}(?:\s*\??\.\s*{_NAME})*)\s*(?:<[\w\s,.<>\[\]]*>)?\s*\(")
_NO_CALL = {"if", "for", "while", "switch", "return", "catch", "func", "function", "fun", "when", "super", "new", "typeof", "await", "constructor", "def", "class", "lambda", "synchronized", "try", "throw", "assert", "and", "or", "not", "in", "print_"}


def blanked(src: str, line: str | None = "//", block: bool = True, quotes: str = "\"'", raw: str = "") -> str:
    """src with comments and strings as blanks, line ends kept; so brackets and words in it are code. raw: quotes that
    hold no escapes and may cross lines."""
    parts = []
    if block:
        parts.append(r"/\*.*?(?:\*/|\Z)")
    if line:
        parts.append(re.escape(line) + r"[^\n]*")
    parts += [re.escape(q) * 3 + ".*?(?:" + re.escape(q) * 3 + r"|\Z)" for q in quotes]
    parts += [re.escape(q) + r"[^" + re.escape(q) + r"]*(?:" + re.escape(q) + r"|\Z)" for q in raw]
    parts += [re.escape(q) + r"(?:\\.|[^" + re.escape(q) + r"\\\n])*(?:" + re.escape(q) + r"|(?=\n)|\Z)" for q in quotes]
    return re.sub("|".join(parts), lambda m: re.sub(r"[^\n]", " ", m[0]), src, flags=re.S)


def closing(code: str, at: int) -> int:
    """Place after the bracket that closes the one at the place given; the end of the text if none does."""
    pairs, depth = {"(": ")", "{": "}", "[": "]", "<": ">"}, 0
    a, b = code[at], pairs[code[at]]
    for m in re.compile("[" + re.escape(a + b) + "]").finditer(code, at):
        depth += 1 if m[0] == a else -1
        if depth == 0:
            return m.end()
    return len(code)


def calls(code: str) -> list[str]:
    """Names called, without what stands before their last dot, each once in order."""
    found = (re.split(r"[.\s?]+", m[1])[-1] for m in _CALL.finditer(code))
    return list(dict.fromkeys(n for n in found if n not in _NO_CALL))


class _File:
    def __init__(self, src: str, code: str):
        self.src, self.code, self.out = src, code, []

    def line(self, at: int) -> int:
        return self.src.count("\n", 0, at) + 1

    def add(self, name: str, kind: str, start: int, end: int, signature: str, parent: str = "", doc: str = "", body: str | None = None) -> None:
        self.out.append({"name": name, "kind": kind, "line": self.line(start), "end_line": self.line(max(start, end - 1)), "signature": signature, "doc_comment": doc, "parent_name": parent, "refs": calls(body) if body is not None else []})


def _brief(s: str, limit: int = 120) -> str:
    s = s.split("\n", 1)[0]
    return (s[:limit] + "…" if len(s) > limit else s).strip()


def go(src: str) -> list[dict]:
    f = _File(src, blanked(src, quotes="\"'", raw="`"))
    code = f.code
    comment = re.compile(r"(//[^\n]*|/\*.*?\*/)\s*\Z", re.S)

    def doc(at: int) -> str:
        before = src[:at].rstrip()
        last = before.rsplit("\n", 1)[-1].strip()
        if last.startswith("//"):
            return last
        m = comment.search(before) if before.endswith("*/") else None
        return m[1] if m else ""

    for m in re.finditer(rf"^func\s*(\([^)]*\))?\s*({_NAME})\s*(\[[^\]]*\])?(?=\()", code, re.M):
        close = closing(code, m.end())
        rest = re.match(r"[ \t]*([^{\n]*)", code[close:])
        brace = close + rest.end()
        if rest[1].lstrip().startswith("("):
            brace = closing(code, close + rest.start(1))
            result = src[close + rest.start(1) : brace].strip()
        else:
            result = src[close + rest.start(1) : brace].strip()
        brace += len(re.match(r"[ \t]*", code[brace:])[0])
        end = closing(code, brace) if code[brace : brace + 1] == "{" else brace
        params, receiver = src[m.end() : close], src[m.start(1) : m.end(1)] if m[1] else ""
        signature = "func " + (receiver + " " if receiver else "") + m[2] + params + (" " + result if result else "")
        owner = re.sub(r"[()]", "", receiver).split()
        f.add(m[2], "method" if receiver else "function", m.start(), end, signature, owner[-1].lstrip("*").split("[")[0] if owner else "", doc(m.start()), code[brace:end])

    def spec(at: int, stop: int, why: str) -> int:
        m = re.compile(rf"\s*({_NAME})(\[[^\]]*\])?\s*=?\s*").match(code, at, stop)
        if not m:
            return stop
        rest = code[m.end() :]
        shape = re.match(r"(struct|interface)\s*\{", rest)
        if shape:
            end = closing(code, m.end() + shape.end() - 1)
            f.add(m[1], shape[1], m.start(1), end, f"type {m[1]} {shape[1]}{{...}}", doc=why)
        else:
            end = m.end() + len(re.match(r"[^\n{]*(?:\{)?", rest)[0])
            end = closing(code, end - 1) if code[end - 1] == "{" else end
            f.add(m[1], "type", m.start(1), end, f"type {m[1]} {src[m.end():end].strip()}", doc=why)
        return end

    for m in re.finditer(r"^type\s*(\()?", code, re.M):
        if m[1]:
            stop, at = closing(code, m.end() - 1) - 1, m.end()
            while at < stop and code[at:stop].strip():
                at = spec(at, stop, doc(m.start()))
        else:
            spec(m.end(), len(code), doc(m.start()))
    return sorted(f.out, key=lambda s: s["line"])


def typescript(src: str) -> list[dict]:
    f = _File(src, blanked(src, quotes="\"'`"))
    code = f.code
    item = re.compile(
        rf"\b(?:async\s+)?function\s*\*?\s*(?P<function>{_NAME})|\b(?:abstract\s+)?class\s+(?P<cls>{_NAME})|\binterface\s+(?P<interface>{_NAME})|\btype\s+(?P<type>{_NAME})\s*(?:<[^=]*>)?\s*=|\b(?:const|let)\s+(?P<const>{_NAME})"
    )
    method = re.compile(rf"(?:^|[;{{}}\n])\s*(?:@{_NAME}(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?#?(?P<name>{_NAME})\s*(?:<[^(]*>)?(?=\()")

    def tail(close: int, stop: int) -> tuple[str, int, int]:
        """(return type, place of the body's brace or of the end, end)."""
        m = re.compile(r"\s*(?::\s*((?:\{[^}]*\}|[^{};=\n])+?)\s*(?=[{;=\n]|\Z))?\s*").match(code, close, stop)
        returns, at = (m[1] or "").strip(), m.end()
        return returns, at, closing(code, at) if code[at : at + 1] == "{" else at

    def members(start: int, stop: int, parent: str) -> None:
        at = start
        while (m := method.search(code, at, stop)) is not None:
            close = closing(code, m.end())
            _, brace, end = tail(close, stop)
            if m["name"] not in _NO_CALL - {"constructor"} and code[brace : brace + 1] == "{":
                f.add(m["name"], "method", m.start("name"), end, m["name"] + src[m.end() : close], parent, body=code[brace:end])
                at = end - 1
            else:
                at = max(close - 1, m.end())

    def scan(start: int, stop: int) -> None:
        at = start
        while (m := item.search(code, at, stop)) is not None:
            at = m.end()
            if m["function"]:
                open_ = code.find("(", at, stop)
                if open_ < 0:
                    continue
                close = closing(code, open_)
                returns, brace, end = tail(close, stop)
                f.add(m["function"], "function", m.start(), end, f"function {m['function']}{src[open_:close]}" + (f": {returns}" if returns else ""), body=code[brace:end])
                at = end
            elif m["cls"]:
                brace = code.find("{", at, stop)
                if brace >= 0:
                    at = closing(code, brace)
                    f.add(m["cls"], "class", m.start(), at, f"class {m['cls']}")
                    members(brace + 1, at - 1, m["cls"])
            elif m["interface"]:
                brace = code.find("{", at, stop)
                if brace >= 0:
                    at = closing(code, brace)
                    f.add(m["interface"], "interface", m.start(), at, f"interface {m['interface']}")
            elif m["type"]:
                end = code.find(";", at, stop)
                at = end + 1 if end >= 0 else at
                f.add(m["type"], "type", m.start(), at, f"type {m['type']}")
            else:
                arrow = re.compile(rf"[^=;\n]*=\s*(?:async\s*)?(?P<params>\([^)]*\)|{_NAME})\s*(?::[^=]*)?=>\s*").match(code, at, stop)
                if arrow:
                    end = closing(code, arrow.end()) if code[arrow.end() : arrow.end() + 1] == "{" else (code.find(";", arrow.end(), stop) % (stop + 1)) or arrow.end()
                    params = src[arrow.start("params") : arrow.end("params")]
                    f.add(m["const"], "function", m.start(), end, f"const {m['const']} = {params if params.startswith('(') else ''} => ...", body=code[arrow.end() : end])
                    at = end

    scan(0, len(code))
    return sorted(f.out, key=lambda s: s["line"])


def python(src: str) -> list[dict]:
    f, starts = _File(src, src), [0]
    for row in src.splitlines(keepends=True):
        starts.append(starts[-1] + len(row))

    def visit(node: ast.AST, parent: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                start, end = starts[child.lineno - 1], starts[child.end_lineno - 1] + child.end_col_offset
                open_ = src.index("(", src.index(child.name, start))
                close = closing(blanked(src, "#", False), open_)
                returns = f" -> {ast.get_source_segment(src, child.returns)}" if child.returns else ""
                f.add(child.name, "method" if parent else "function", start, end, f"def {child.name}{src[open_:close]}{returns}", parent, body=blanked(src[close:end], "#", False))
            elif isinstance(child, ast.ClassDef):
                f.add(child.name, "class", starts[child.lineno - 1], starts[child.end_lineno - 1] + child.end_col_offset, f"class {child.name}")
                visit(child, child.name)
            else:
                visit(child, parent)

    visit(ast.parse(src), "")
    return f.out


def kotlin(src: str) -> list[dict]:
    f = _File(src, blanked(src))
    code = f.code
    item = re.compile(
        rf"\bfun\s+(?:<[^>]*>\s*)?(?:{_NAME}\s*(?:<[^>]*>)?\s*\.\s*)?(?P<fun>{_NAME})|\b(?P<flavour>(?:enum\s+|data\s+|sealed\s+|annotation\s+)*)class\s+(?P<cls>{_NAME})|\b(?:fun\s+)?interface\s+(?P<interface>{_NAME})"
        rf"|\bcompanion\s+object\b|\bobject\s+(?P<object>{_NAME})|\b(?:val|var)\s+(?:<[^>]*>\s*)?(?P<property>{_NAME})|\btypealias\s+(?P<alias>{_NAME})"
    )

    def body(at: int, stop: int) -> int:
        """Place of the brace that a declaration's head ends with, or -1: parentheses and supertypes come before it."""
        m = re.compile(r"\s*(?:<[^>{]*>)?\s*").match(code, at, stop)
        at = m.end()
        if code[at : at + 1] == "(":
            at = closing(code, at)
        while at < stop and code[at] != "{":
            if code[at] == "(":
                at = closing(code, at)
            elif code[at] == "\n" and not re.match(r"\s*[:,{]|\s*by\b", code[at:stop]) and not code[:at].rstrip().endswith((":", ",")):
                return -1
            else:
                at += 1
        return at if at < stop else -1

    def scan(start: int, stop: int, parent: str) -> None:
        at = start
        while (m := item.search(code, at, stop)) is not None:
            at = m.end()
            if m["fun"]:
                open_ = code.find("(", at, stop)
                if open_ < 0:
                    continue
                close = closing(code, open_)
                head = re.compile(r"\s*(?::\s*([^={\n]+))?\s*").match(code, close, stop)
                at = closing(code, head.end()) if code[head.end() : head.end() + 1] == "{" else code.find("\n", head.end(), stop) if "\n" in code[head.end() : stop] else stop
                at = head.end() if code[head.end() : head.end() + 1] not in "{=" else at
                returns = (head[1] or "").strip()
                f.add(m["fun"], "method" if parent else "function", m.start(), at, f"fun {m['fun']}{src[open_:close]}" + (f": {returns}" if returns else ""), parent, body=code[head.end() : at])
            elif m["cls"] or m["interface"] or m["object"] or m[0].startswith("companion"):
                enum = bool(m["cls"]) and "enum" in m["flavour"].split()
                companion = m[0].startswith("companion")
                kind = "enum" if enum else "class" if m["cls"] else "interface" if m["interface"] else "object"
                name = m["cls"] or m["interface"] or m["object"] or (f"{parent}.Companion" if parent else "Companion")
                brace = body(at, stop)
                end = closing(code, brace) if brace >= 0 else (code.find("\n", at, stop) if "\n" in code[at:stop] else stop)
                ctor = re.compile(r"\s*(?:<[^>{]*>)?\s*(?=\()").match(code, at, stop)
                if ctor and not companion and brace < 0:
                    end = max(end, closing(code, ctor.end()))
                f.add(name, kind, m.start(), end, "companion object" if companion else f"{kind} {name}")
                if m["cls"] and ctor:
                    close = closing(code, ctor.end())
                    for p in re.compile(rf"(?:[(,]|\n)\s*((?:@{_NAME}(?:\([^)]*\))?\s*|private\s+|override\s+|internal\s+|public\s+|protected\s+)*(?:val|var)\s+({_NAME})[^,)\n]*)").finditer(code, ctor.end(), close):
                        f.add(p[2], "property", p.start(2), p.end(), _brief(src[p.start(1) : p.end(1)]), name)
                if brace >= 0:
                    inner = brace + 1
                    if enum:
                        last = code.find(";", inner, end - 1)
                        for e in re.compile(rf"(?:\A|[{{,])\s*({_NAME})\s*(?=[,;(}}\s])").finditer(code, brace, last + 1 if last >= 0 else end):
                            if code[brace : e.start(1)].count("(") == code[brace : e.start(1)].count(")"):
                                f.add(e[1], "enum_value", e.start(1), e.end(1), e[1], name)
                        inner = last + 1 if last >= 0 else end - 1
                    scan(inner, end - 1, name)
                at = end
            elif m["property"]:
                line_end = code.find("\n", at, stop)
                line_end = stop if line_end < 0 else line_end
                opens = [k for k in (code.find(c, at, line_end) for c in "({") if k >= 0]
                end = max([line_end, *(closing(code, k) for k in opens)])
                f.add(m["property"], "property", m.start(), end, _brief(src[m.start() : end]), parent)
                at = end
            else:
                at = code.find("\n", at, stop) if "\n" in code[at:stop] else stop
                f.add(m["alias"], "type", m.start(), at, f"typealias {m['alias']}")

    scan(0, len(code), "")
    return sorted(f.out, key=lambda s: s["line"])


def java(src: str) -> list[dict]:
    f = _File(src, blanked(src))
    code = f.code
    modifier = r"(?:(?:public|private|protected|static|final|abstract|sealed|default|synchronized|native|transient|volatile|strictfp)\s+|@[\w.]+(?:\([^)]*\))?\s*)*"
    kind_ = re.compile(rf"\b(?P<kind>class|interface|enum|record)\s+(?P<name>{_NAME})")
    member = re.compile(rf"(?:\A|[;{{}}])\s*{modifier}(?:<[^>]*>\s*)?(?:(?P<type>[\w.$]+(?:<[^;{{()]*>)?(?:\[\])*)\s+)?(?P<name>{_NAME})\s*(?P<end>[(;=,])")

    def members(start: int, stop: int, owner: str) -> None:
        at = start
        while at < stop:
            inner, m = kind_.search(code, at, stop), member.search(code, max(at - 1, start - 1), stop)
            if inner and (not m or inner.start() <= m.start("name")):
                at = declare(inner, stop)
                continue
            if not m:
                return
            if m["end"] == "(" and (m["type"] or m["name"] == owner):
                close = closing(code, m.end() - 1)
                rest = re.compile(r"\s*(?:throws\s+[\w.,\s]+?)?\s*(?=[{;])").match(code, close, stop)
                brace = rest.end() if rest else close
                at = closing(code, brace) if code[brace : brace + 1] == "{" else brace + 1
                made = not m["type"]
                f.add(m["name"], "constructor" if made else "method", m.start("name"), at, ("" if made else m["type"] + " ") + m["name"] + src[m.end() - 1 : close], owner, body=code[brace:at])
            elif m["type"] and m["type"] not in ("return", "new", "throw", "package", "import", "else"):
                end = code.find(";", m.end("name"), stop)
                at = end + 1 if end >= 0 else stop
                f.add(m["name"], "field", m.start("name"), at, _brief(src[m.start("type") : at]), owner)
            else:
                at = m.end()

    def declare(m: re.Match, stop: int) -> int:
        brace = code.find("{", m.end(), stop)
        end = closing(code, brace) if brace >= 0 else stop
        f.add(m["name"], m["kind"], m.start(), end, f"{m['kind']} {m['name']}")
        if brace >= 0:
            members(brace + 1, end - 1, m["name"])
        return end

    at = 0
    while (m := kind_.search(code, at)) is not None:
        at = declare(m, len(code))
    return sorted(f.out, key=lambda s: s["line"])


#: Scanners by language; add one's own here.
SCANNERS: dict[str, Callable[[str], list[dict]]] = {"go": go, "typescript": typescript, "javascript": typescript, "python": python, "kotlin": kotlin, "java": java}


def scan_file(language: str | None, content: str | None) -> list[dict]:
    """Symbols of one file; none for an unknown language or text that cannot be parsed."""
    scanner = SCANNERS.get(language or "")
    if scanner is None or not content:
        return []
    try:
        return scanner(content)
    except (SyntaxError, ValueError, RecursionError):
        return []


def _scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    for files in batches:
        rows = [{"path": p, "language": lang, **s} for p, lang, c in zip(files["path"], files["language"], files["content"]) for s in scan_file(lang, c)]
        yield pd.DataFrame(rows, columns=columns)


def symbols(files: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Symbols of files (path, language, content): scanned languages, then the line-shaped formats. tags: symbols that a
    tagger found (path, name, kind, line, signature, parent_name), for files of languages that neither of these reads."""
    rows = files.select("path", "language", "content")
    out = spread(rows.filter(F.col("language").isin(*SCANNERS))).mapInPandas(_scan, SCHEMA)
    whole = lambda found, language, doc, parent: found.select("path", language.alias("language"), "name", "kind", "line", F.col("line").alias("end_line"), "signature", doc.alias("doc_comment"), parent.alias("parent_name"), F.array().cast("array<string>").alias("refs"))
    formats = {"yaml": L.yaml_symbols, "terraform": L.terraform_symbols, "dockerfile": L.dockerfile_symbols, "json": L.json_symbols}
    for language, read in formats.items():
        found = read(L.numbered(rows.filter(F.col("language") == language)))
        out = out.unionByName(whole(found, F.lit(language), F.col("doc_comment") if "doc_comment" in found.columns else F.lit(""), F.lit("")))
    if tags is not None:
        others = rows.filter(~F.col("language").isin(*SCANNERS, *formats)).select("path", "language")
        found = tags.withColumns({"line": F.coalesce("line", F.lit(0)), "signature": F.coalesce("signature", F.lit(""))}).join(others, "path")
        out = out.unionByName(whole(found, F.col("language"), F.lit(""), F.coalesce("parent_name", F.lit(""))))
    return out
