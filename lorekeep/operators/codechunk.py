"""Source code to chunks: spans of declarations that together cover the file.

An outline for each language names the spans worth a chunk of their own: Python's by its own grammar, the others' by
scanners that know strings, comments and brackets. What lies between spans becomes a chunk, too, or goes with its
neighbour. A span that is too large is cut at its members and, where it has none, at line ends, so that no text is lost.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep import schemas
from lorekeep.sources.files import LANGUAGES, language

#: A chunk's bytes, at most.
MAX_BYTES = 1500


@dataclass
class Span:
    """A range of text: what it is (class, function, imports or other), its symbol, whether it has a signature wherever it
    stands, whether it only holds its members together, and what gives its members."""

    start: int
    end: int
    what: str = "other"
    name: str = ""
    signed: bool = False
    scope: bool = False
    members: Callable[[], list[Span]] | None = None


# --- Python ---


def outline_python(text: str) -> list[Span]:
    begins = [0, *(m.end() for m in re.finditer(r"\r\n|\r|\n", text))]
    wide = not text.isascii()

    def place(row: int, col: int) -> int:
        at = begins[row - 1]
        if not wide:
            return at + col
        line = text[at : begins[row] if row < len(begins) else len(text)]
        return at + len(line.encode()[:col].decode("utf-8", "ignore"))

    def inside(node: ast.AST) -> list[Span]:
        found = []
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.stmt):
                found.append(span(child))
            elif isinstance(child, (ast.ExceptHandler, ast.match_case)):
                found += inside(child)
        return found

    def span(s: ast.stmt) -> Span:
        start, marks = place(s.lineno, s.col_offset), getattr(s, "decorator_list", None)
        if marks:
            start = text.rfind("@", 0, place(marks[0].lineno, marks[0].col_offset))
        out = Span(start, place(s.end_lineno, s.end_col_offset), name=getattr(s, "name", ""), members=lambda: inside(s))
        if isinstance(s, ast.ClassDef):
            out.what, out.signed = "class", True
        elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.what, out.signed = "function", True
        elif isinstance(s, ast.Import) or (isinstance(s, ast.ImportFrom) and s.module != "__future__"):
            out.what = "imports"
        return out

    return [span(s) for s in ast.parse(text).body]


# --- languages with braces ---

_SKIP = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?""", re.S)
_GOES_ON = re.compile(r"[ \t]*(;|[,).=]|from\b|while\b)?")


def _statements(text: str, start: int, end: int, line_comments: bool = True) -> Iterator[tuple[int, int, int]]:
    """(start, end, place of the first open brace or -1) of statements between brackets; a comment on its own is one."""
    at, begin, depth, brace = start, None, 0, -1
    while at < end:
        ch = text[at]
        m = _SKIP.match(text, at, end) if ch in "\"'`/" else None
        if m and ch == "/" and not line_comments and text[at : at + 2] == "//":
            m = None
        if m:
            if ch == "/" and begin is None:
                yield at, m.end(), -1
            elif begin is None:
                begin = at
            at = m.end()
            continue
        if begin is None and not ch.isspace():
            begin = at
        if ch in "({[":
            if ch == "{" and depth == 0 and brace < 0:
                brace = at
            depth += 1
        elif ch in ")}]":
            depth = max(0, depth - 1)
            if ch == "}" and depth == 0 and begin is not None:
                rest = _GOES_ON.match(text, at + 1)
                if rest[1] in (None, ";"):
                    stop = rest.end() if rest[1] else at + 1
                    yield begin, min(stop, end), brace
                    begin, brace, at = None, -1, stop
                    continue
        elif ch == ";" and depth == 0 and begin is not None:
            yield begin, at + 1, brace
            begin, brace = None, -1
        at += 1
    if begin is not None:
        yield begin, end, brace


def _braced(text: str, describe: Callable[[str, int, int, int, bool], dict], line_comments: bool = True) -> list[Span]:
    """Statements as spans, whose members are the statements within their braces. describe: fields of a span from text, start, end, brace and whether it stands at the top."""

    def level(a: int, b: int, top: bool) -> list[Span]:
        out = []
        for s, e, brace in _statements(text, a, b, line_comments):
            how = {} if text.startswith(("//", "/*"), s) else describe(text, s, e, brace, top)
            close = text.rfind("}", brace, e) if brace >= 0 else -1
            inner = (lambda x=brace + 1, y=close if close > brace else e, t=how.get("scope", False): level(x, y, t)) if brace >= 0 else None
            out.append(Span(s, e, members=inner, **how))
        return out

    return level(0, len(text), True)


_TS_HEAD = re.compile(r"(export\s+(?:default\s+)?)?(?:(?:declare|abstract|async)\s+)*(class|function|interface|type|const|let|enum|import)\b\*?\s*([\w$]+)?")
_TS_MEMBER = re.compile(r"(?:(?:public|private|protected|static|readonly|async|get|set|override|abstract)\s+)*([\w$]+)\s*(?:<[^>]*>)?\s*\(")


def _describe_ts(text: str, s: int, e: int, brace: int, top: bool) -> dict:
    m = _TS_HEAD.match(text, s, e)
    if m is None:
        member = _TS_MEMBER.match(text, s, e) if brace >= 0 and not top else None
        return {"what": "function", "name": member[1]} if member and member[1] not in ("if", "for", "while", "switch", "catch") else {"signed": text.startswith("export", s)}
    word, name = m[2], m[3] or ""
    if word == "import":
        return {"what": "imports"}
    what = {"class": "class", "interface": "class", "function": "function"}.get(word, "other")
    return {"what": what, "name": "" if word in ("const", "let") else name, "signed": word != "enum" or m[1] is not None}


_CS_WORDS = r"(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|unsafe|new|override|virtual|async|file)\s+)*"
_CS_TYPE = re.compile(_CS_WORDS + r"(using|namespace|class|struct|interface|enum|record)\s+(?:(?:class|struct)\s+)?([\w.]+)")
_CS_MEMBER = re.compile(_CS_WORDS + r"[\w<>\[\],.? ]+?\s+(\w+)\s*(\(|\{|=>)")


def _describe_cs(text: str, s: int, e: int, brace: int, top: bool) -> dict:
    if m := _CS_TYPE.match(text, s, e):
        word, name = m[1], m[2]
        if word == "using":
            return {"what": "imports"}
        if word == "namespace":
            return {"name": name, "scope": brace >= 0}
        return {"what": "class" if word in ("class", "struct", "interface") else "other", "name": name, "signed": True}
    if m := _CS_MEMBER.match(text, s, e):
        return {"what": "function" if m[2] == "(" else "other", "name": m[1], "signed": True}
    return {}


def _describe_css(text: str, s: int, e: int, brace: int, top: bool) -> dict:
    if text.startswith(("@import", "@charset"), s):
        return {"what": "imports"}
    return {"signed": not text.startswith("@", s) or re.compile(r"@media|@(?:-\w+-)?keyframes").match(text, s) is not None}


# --- HTML ---

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!doctype[^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_NO_END = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style")}


def outline_html(text: str) -> list[Span]:
    """Elements; those without an end tag end where the one around them does."""
    top: list[Span] = []
    open_: list[tuple[str, Span, list[Span]]] = []  # tags, their spans and members
    count: dict[str, int] = {}
    at = 0
    while m := _TAG.search(text, at):
        at = m.end()
        tag = (m[2] or "").lower()
        if m[1]:
            while count.get(tag):
                name, s, _ = open_.pop()
                count[name] -= 1
                s.end = at if name == tag else m.start()
                if name == tag:
                    break
            continue
        own: list[Span] = []
        s = Span(m.start(), at, "other" if tag or m[0].startswith("<!--") else "imports", signed=bool(tag), members=lambda own=own: own)
        (open_[-1][2] if open_ else top).append(s)
        if tag in _RAW_END:  # what looks like tags within is none
            end = _RAW_END[tag].search(text, at)
            at = s.end = end.end() if end else len(text)
        elif tag and tag not in _NO_END and not m[3].endswith("/"):
            open_.append((tag, s, own))
            count[tag] = count.get(tag, 0) + 1
    for _, s, _ in open_:
        s.end = len(text)
    return top


OUTLINES: dict[str, Callable[[str], list[Span]]] = {
    "python": outline_python,
    "typescript": lambda text: _braced(text, _describe_ts),
    "tsx": lambda text: _braced(text, _describe_ts),
    "csharp": lambda text: _braced(text, _describe_cs),
    "css": lambda text: _braced(text, _describe_css, line_comments=False),
    "html": outline_html,
}


def paragraphs(text: str) -> list[Span]:
    """Runs of lines without blank ones, where a text can't be outlined."""
    return [Span(m.start(), m.end()) for m in re.finditer(r"\S(?:.|\n(?!\s*\n))*", text)]


def headline(code: str, lang: str) -> str:
    """A declaration's signature: in Python its first line that ends with a colon, elsewhere all before its first brace; else its first line."""
    found = re.search(r"^[^\S\n]*(\S.*?:)\\?[^\S\n]*$" if lang == "python" else r"\A\s*([^{]*?)\s*\{", code, re.M)
    return found[1] if found else code.split("\n", 1)[0]


_CLOSERS = re.compile(r"[\s)\]};,]*")


class Cutter:
    """Chunks of one text; sizes are in bytes of UTF-8."""

    def __init__(self, text: str, lang: str, path: str, most: int):
        self.text, self.lang, self.path, self.most, self.rows = text, lang, path, most, []
        self.newlines = [m.start() for m in re.finditer("\n", text)]
        self.offset = range(len(text) + 1) if text.isascii() else [0, *accumulate(1 + (c > "\x7f") + (c > "\u07ff") + (c > "\uffff") for c in text)]

    def fits(self, start: int, end: int) -> bool:
        return self.offset[end] - self.offset[start] <= self.most

    def row(self, what: str, name: str, parent: str, sig: str, start: int, end: int, text: str | None = None) -> None:
        lines = [f"# {self.path}"] + [f"# in {parent}"] * bool(parent) + [sig] * bool(sig)
        line = lambda at: bisect_right(self.newlines, at - 1) + 1
        self.rows.append((self.lang, what, name, parent, sig, self.text[start:end] if text is None else text, "\n".join(lines), line(start), line(max(start, end - 1)), len(self.rows)))

    def trimmed(self, start: int, end: int) -> tuple[int, int]:
        part = self.text[start:end]
        return start + len(part) - len(part.lstrip()), end - len(part) + len(part.rstrip())

    def covered(self, spans: list[Span], start: int, end: int, top: bool) -> list[Span]:
        """spans and what lies between them. Closing brackets go with the span before; other text is a span at the top and goes with the span after it elsewhere."""
        out: list[Span] = []
        at = start
        for s in [*sorted(spans, key=lambda s: s.start), Span(end, end)]:
            s.start, s.end = max(s.start, at), min(s.end, end)
            a, b = self.trimmed(at, s.start)
            if a < b and out and _CLOSERS.fullmatch(self.text, a, b) and self.fits(out[-1].start, b):
                out[-1].end = b
            elif a < b and not top and s.start < s.end:
                s.start = a
            elif a < b:
                out.append(Span(a, b))
            if s.start < s.end:
                out.append(s)
                at = s.end
        return out

    def lines(self, start: int, end: int) -> Iterator[tuple[int, int]]:
        """Parts that fit, cut at line ends or, within a line that is too long, anywhere."""
        at = start
        while at < end:
            stop = end
            if not self.fits(at, end):
                stop = bisect_right(self.offset, self.offset[at] + self.most) - 1
                cut = self.text.rfind("\n", at, stop)
                stop = cut + 1 if cut > at else max(stop, at + 1)
            a, b = self.trimmed(at, stop)
            if a < b:
                yield a, b
            at = stop

    def imports(self, run: list[Span]) -> None:
        if run:
            self.row("imports", "", "", "", run[0].start, run[-1].end, "\n".join(self.text[s.start : s.end] for s in run))

    def cut(self, spans: list[Span]) -> list[tuple]:
        todo = [(s, "", True) for s in reversed(self.covered(spans, 0, len(self.text), True))]
        run: list[Span] = []
        while todo:
            s, parent, top = todo.pop()
            if s.what == "imports" and top and self.fits(s.start, s.end):
                if sum(self.offset[x.end] - self.offset[x.start] for x in [*run, s]) > self.most:
                    self.imports(run)
                    run = []
                run.append(s)
                continue
            self.imports(run)
            run = []
            if self.fits(s.start, s.end) and not s.scope:
                sig = headline(self.text[s.start : s.end], self.lang) if s.signed or not top else ""
                self.row(s.what, s.name, parent, sig, s.start, s.end)
                continue
            owner = s.name or parent
            inner = [x for x in (s.members() if s.members else []) if s.start <= x.start < x.end <= s.end]
            if not inner:
                sig = headline(self.text[s.start : s.end][: self.most], self.lang) if s.signed or not top else ""
                for a, b in self.lines(s.start, s.end):
                    self.row(s.what, s.name, parent, sig, a, b)
                continue
            first = min(x.start for x in inner)
            rest = self.covered(inner, first, s.end, s.scope)
            todo += [(x, owner, s.scope) for x in reversed(rest)]
            for a, b in self.lines(s.start, first):  # the head
                self.row("other", "", owner, "" if s.scope else headline(self.text[a:b], self.lang), a, b)
        self.imports(run)
        return self.rows


def chunk_text(text: str, lang: str, path: str, max_bytes: int = MAX_BYTES) -> list[tuple]:
    """Rows of CODE_CHUNKS, in order; none for a language that is not known. Together they hold all characters that aren't white space."""
    if lang not in OUTLINES or not text.strip():
        return []
    try:
        spans = OUTLINES[lang](text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        spans = paragraphs(text)
    return Cutter(text, lang, path, max_bytes).cut(spans)


def chunk_sources(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows of the code table without vectors from (source_file, repo_name, content, content_hash); files in other languages give none. Narrow: each file within its task."""
    names = schemas.CODE_CHUNKS.names
    rows = files.withColumn("language", language(F.col("source_file"))).where("language is not null").select("source_file", "repo_name", "content", "content_hash", "language")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(f, r, h, *c) for f, r, t, h, lang in b.itertuples(index=False) for c in chunk_text(t or "", lang, f, max_bytes)]
            yield pd.DataFrame(made, columns=["source_file", "repo_name", "content_hash", *names])

    shape = "source_file string, repo_name string, content_hash string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.CODE_CHUNKS)
    out = rows.mapInPandas(run, shape)
    return out.select(F.concat_ws("_", "content_hash", "chunk_index").alias("id"), *(c for c in schemas.CODE.names if c not in ("id", "vector")))


@F.udtf(returnType=schemas.CODE_CHUNKS)
class ChunkCode:
    """For SQL: SELECT ... FROM files, LATERAL chunk_code(content, language, path)."""

    def eval(self, content: str, lang: str, path: str):
        yield from chunk_text(content or "", lang or "", path or "")


assert set(LANGUAGES.values()) == set(OUTLINES)
