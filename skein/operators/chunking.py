"""Parsing and chunking of files: Python by its own syntax tree, other languages by braces and keywords, documents by
DataFrame functions alone.

The heuristic languages find functions and classes at line starts and follow braces (or `end` for Ruby and Lua);
they promise no syntax-tree parity. Tokens are counted by a pluggable function.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAX_TOKENS = 512
CHUNKS = "file_path string, language string, chunk_type string, name string, start_line int, end_line int, parent string, file_hash string, source string, token_count int, metadata map<string,int>, ordinal long, chunk_id string"
_TOKEN = re.compile(r"\w+|[^\w\s]")


def count_tokens(text: str) -> int:
    """Words and signs; longer words count once for each six characters begun. An approximation, monotone in the text."""
    return sum(-(-len(t) // 6) for t in _TOKEN.findall(text))


@dataclass(frozen=True)
class Symbol:
    kind: str
    name: str
    start: int
    end: int
    source: str
    parent: str | None = None


def parse_python(text: str) -> list[Symbol]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, out = text.splitlines(keepends=True), []

    def take(node: ast.AST, parent: str | None) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(x, ast.ClassDef) else "function"
                out.append(Symbol(kind, x.name, x.lineno, x.end_lineno or x.lineno, "".join(lines[x.lineno - 1 : x.end_lineno]).rstrip("\n"), parent))
                if kind == "class":
                    take(x, x.name)
            elif isinstance(x, ast.stmt):
                take(x, parent)

    take(tree, None)
    return out


_HEADS = (
    ("class", re.compile(r"^\s*(?:export\s+|default\s+|public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+|pub(?:\([^)]*\))?\s+|sealed\s+|partial\s+|internal\s+)*(?:class|interface|struct|enum|trait|impl|protocol|extension|module|namespace)\s+(?:<[^>]*>\s*)?([A-Za-z_]\w*)")),
    ("function", re.compile(r"^\s*(?:export\s+|default\s+|async\s+|public\s+|private\s+|protected\s+|static\s+|pub(?:\([^)]*\))?\s+|local\s+|override\s+|final\s+)*(?:function|func|fn|def|sub)\s+(?:\([^)]*\)\s*)?(?:self\.)?([A-Za-z_][\w.:]*)")),
    ("function", re.compile(r"^\s*(?:[A-Za-z_][\w:<>,*&\[\]]*\s+)+[*&]*([A-Za-z_][\w:~]*)\s*\([^;]*\)\s*(?:const\s*)?(?:throws\s+[\w., ]+)?\{?\s*$")),
    ("function", re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>")),
    ("function", re.compile(r"^([A-Za-z_][\w-]*)\s*\(\)\s*\{")),
)
_NOT_NAMES = frozenset(("if", "for", "while", "switch", "return", "else", "catch", "new", "do", "sizeof", "throw"))


def parse_other(text: str, language: str) -> list[Symbol]:
    lines = text.splitlines(keepends=True)
    words = language in ("ruby", "lua")

    def end_of(i: int) -> int:
        depth, seen = 0, False
        for j in range(i, len(lines)):
            x = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*|#.*" if not words else r"\"[^\"]*\"|'[^']*'", "", lines[j])
            if words:
                depth += len(re.findall(r"\b(?:class|module|def|function|do|if|unless|while|for|case|begin)\b", x)) - len(re.findall(r"\bend\b", x))
                seen = True
            else:
                depth += x.count("{") - x.count("}")
                seen = seen or "{" in x
            if seen and depth <= 0:
                return j
            if not seen and j - i > 3:
                return i
        return len(lines) - 1

    out: list[Symbol] = []

    def walk(lo: int, hi: int, parent: str | None) -> None:
        i = lo
        while i <= hi:
            found = next(((kind, m[1]) for kind, p in _HEADS if (m := p.match(lines[i])) and m[1] not in _NOT_NAMES), None)
            if not found:
                i += 1
                continue
            kind, name = found
            end = min(end_of(i), hi)
            out.append(Symbol(kind, name, i + 1, end + 1, "".join(lines[i : end + 1]).rstrip("\n"), parent))
            if kind == "class":
                walk(i + 1, end - 1, name)
            i = end + 1

    walk(0, len(lines) - 1, None)
    return out


def parse(text: str, language: str, path: str) -> list[Symbol]:
    """Symbols in order; a file without any is one module summary; blank files and documents have none."""
    if not text.strip() or language == "doc":
        return []
    found = parse_python(text) if language == "python" else parse_other(text, language)
    return found or [Symbol("module_summary", path, 1, text.count("\n") + 1, text)]


_IMPORTS = re.compile(r"(?i)(import\s|from\s|#include\s|using\s|use\s|require\s|package\s)")
_ASSIGNED = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\s*[:=]")


def summary_of(text: str, path: str) -> str:
    lines = text.splitlines(keepends=True)
    told = [x for x in lines if _IMPORTS.match(x.strip()) or _ASSIGNED.match(x.strip())]
    body = "".join(told if len(told) > 1 else lines[:20]).strip()
    return f"# File: {path}\n{body or f'# File: {path}'}"


def packed_lines(lines: list[str], most: int, count: Callable[[str], int]) -> list[list[str]]:
    """Lines in order, as many to a piece as fit; a longer line is a piece of its own."""
    out, total = [], 0
    for x in lines:
        n = count(x)
        if not out or total + n > most:
            out.append([])
            total = 0
        out[-1].append(x)
        total += n
    return out


def cut_point(lines: list[str]) -> int:
    """Where the tail of a full piece is best cut: before a blank line or after a closing one, in the last three tenths."""
    for i in range(len(lines) - 1, len(lines) * 7 // 10, -1):
        x = lines[i].strip()
        if not x:
            return i
        if x[-1] in ";})":
            return i + 1
    return len(lines)


def split_function(source: str, most: int, count: Callable[[str], int]) -> list[list[str]]:
    pieces = packed_lines(source.splitlines(keepends=True), most, count)
    for i in range(len(pieces) - 1):
        at = cut_point(pieces[i])
        if at < len(pieces[i]):
            pieces[i], pieces[i + 1] = pieces[i][:at], pieces[i][at:] + pieces[i + 1]
    return pieces


def class_outline(source: str) -> str:
    """The class without the bodies of its methods: their heads and docstring lines stay."""
    out, body, doc = [], None, False
    for x in source.splitlines(keepends=True):
        width = sum(4 if c == "\t" else 1 for c in x[: len(x) - len(x.lstrip())])
        s = x.strip()
        if body is not None and s and width <= body:
            body = None
        if body is None:
            out.append(x)
            if re.match(r"(async\s+def|def|func|fn|function)\s|(public|private|protected|static)\b.*\(.*\{$", s):
                body, doc = width, False
            continue
        quotes = s.count('"""') + s.count("'''")
        if doc or quotes:
            out.append(x)
            doc = doc ^ (quotes % 2 == 1)
    return "".join(out).rstrip("\n")


def sections(text: str) -> list[tuple[int, str]]:
    """(first line, text) between headings of one to six #."""
    out: list[tuple[int, list[str]]] = []
    for i, x in enumerate(text.splitlines(keepends=True), 1):
        if not out or re.match(r"#{1,6}\s", x):
            out.append((i, []))
        out[-1][1].append(x)
    return [(i, "".join(x)) for i, x in out]


def chunks_of(text: str, language: str, path: str, most: int = MAX_TOKENS, count: Callable[[str], int] = count_tokens) -> list[dict]:
    """All chunks of a file in order, without the second of two equal ones."""
    rows: list[dict] = []

    def add(kind: str, name: str, start: int, end: int, source: str, parent: str | None = None, part: tuple[int, int] | None = None) -> None:
        rows.append({"chunk_type": kind, "name": f"{name} [part {part[0]}/{part[1]}]" if part else name, "start_line": start, "end_line": end, "parent": parent, "source": source, "token_count": count(source), "metadata": {"sub_index": part[0], "sub_total": part[1]} if part else {}})

    def pieces(kind: str, s: Symbol, cut: list[list[str]]) -> None:
        at = s.start
        for i, x in enumerate(cut, 1):
            add(kind, s.name, at, at + len(x) - 1, "".join(x), s.parent, (i, len(cut)) if len(cut) > 1 else None)
            at += len(x)

    def function(s: Symbol) -> None:
        if count(s.source) <= most:
            add("function", s.name, s.start, s.end, s.source, s.parent)
        else:
            pieces("function", s, split_function(s.source, most, count))

    if language == "doc":
        whole = Symbol("doc", path, 1, text.count("\n") + 1, text)
        parts = sections(text)
        if count(text) <= most:
            add("doc", path, 1, whole.end, text)
        elif len(parts) < 2:
            pieces("doc", whole, packed_lines(text.splitlines(keepends=True), most, count))
        else:
            for start, body in parts:
                if body.strip():
                    own = replace(whole, start=start, source=body.strip())
                    if count(body) <= most:
                        add("doc", path, start, start + body.count("\n"), body.strip())
                    else:
                        pieces("doc", own, packed_lines(own.source.splitlines(keepends=True), most, count))
        return rows
    symbols = parse(text, language, path)
    if symbols:
        add("module_summary", path, 1, text.count("\n") + 1, summary_of(text, path))
    for s in symbols:
        if s.kind == "class":
            add("class", s.name, s.start, s.end, class_outline(s.source))
            for f in symbols:
                if f.kind == "function" and f.parent == s.name:
                    function(f)
        elif s.kind == "function" and s.parent is None:
            function(s)
    seen, out = set(), []
    for r in rows:
        key = (r["chunk_type"], r["source"], r["start_line"])
        if key not in seen:
            seen.add(key)
            out.append(r)
    return out


_BLANK = " \t\n\x0b\x0c\r"
_ORDER = ("file_path", "language", "chunk_type", "name", "start_line", "end_line", "parent", "file_hash", "source", "token_count", "metadata", "ordinal")


def tokens(text: Column) -> Column:
    """count_tokens() as an expression."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{IsWhite_Space}]"), F.lit(0))
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.floor((F.char_length(w) + 5) / 6).cast("int"))


def greedy_starts(counts: Column, most: int) -> Column:
    """Places (from 0) at which pieces begin, as many lines to a piece as fit `most`; a longer line is a piece of its own."""

    def step(state: Column, x: Column) -> Column:
        new = (F.size(state["starts"]) == 0) | (state["total"] + x["n"] > most)
        return F.struct(F.when(new, x["n"]).otherwise(state["total"] + x["n"]).alias("total"), F.when(new, F.array_append(state["starts"], x["at"])).otherwise(state["starts"]).alias("starts"))

    numbered = F.transform(counts, lambda n, at: F.struct(n.alias("n"), at.alias("at")))
    return F.aggregate(numbered, F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("starts")), step)["starts"]


def doc_sections(files: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """rel_path, file_hash, content, section, start, source, stop, cut of what documents are cut into at headings: a document
    that fits, or has one section, is one; blank sections are left out; cut says that the source is too long for a chunk."""
    lines = F.split("content", "\n")
    heads = F.filter(F.transform(lines, lambda x, i: F.when(F.rlike(F.concat(x, F.lit("\n")), F.lit(r"^#{1,6}\s")) | (i == 0), i)), lambda i: i.isNotNull())
    own = files.select("rel_path", "file_hash", "content", lines.alias("lines"), tokens(F.col("content")).alias("total"), heads.alias("heads"))
    whole = (F.col("total") <= most) | (F.size("heads") < 2)
    one = F.array(F.struct(F.lit(0).alias("from"), F.size("lines").alias("to")))
    each = F.transform("heads", lambda h, i: F.struct(h.alias("from"), F.coalesce(F.get("heads", i + 1), F.size("lines")).alias("to")))
    parts = own.select("rel_path", "file_hash", "content", "lines", "total", whole.alias("whole"), F.posexplode(F.when(whole, one).otherwise(each)).alias("section", "x"))
    last = F.col("x.to") == F.size("lines")
    body = F.when(F.col("whole"), F.col("content")).otherwise(F.concat(F.array_join(F.slice("lines", F.col("x.from") + 1, F.col("x.to") - F.col("x.from")), "\n"), F.when(last, "").otherwise("\n")))
    cut = parts.select("rel_path", "file_hash", "section", (F.col("x.from") + 1).alias("start"), "whole", body.alias("body"))
    source = F.when(F.col("whole"), F.col("body")).otherwise(F.btrim("body", F.lit(_BLANK)))
    stop = F.col("start") + F.char_length("body") - F.char_length(F.replace("body", F.lit("\n"), F.lit("")))
    told = cut.select("rel_path", "file_hash", "section", "start", source.alias("source"), stop.alias("stop"), (tokens(F.col("body")) > most).alias("cut"), "whole")
    return told.where("whole OR source <> ''").drop("whole")


def doc_chunks(files: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """CHUNKS without chunk_id of documents: sections at headings, those of too many tokens in pieces of whole lines.

    Lines end at \\n. A null content is empty, and an empty document is one empty chunk."""
    parts = doc_sections(files.select("rel_path", "file_hash", F.coalesce("content", F.lit("")).alias("content")), most)
    ended = F.endswith("source", F.lit("\n"))
    lines = F.split(F.when(ended, F.expr("substring(source, 1, char_length(source) - 1)")).otherwise(F.col("source")), "\n")
    counted = parts.select("*", lines.alias("lines")).withColumn("starts", F.when(F.col("cut"), greedy_starts(F.transform("lines", tokens), most)).otherwise(F.array(F.lit(0))))
    pieces = counted.select("*", F.size("starts").alias("m"), F.posexplode("starts").alias("i", "from")).withColumn("to", F.coalesce(F.get("starts", F.col("i") + 1), F.size("lines")))
    joined = F.concat(F.array_join(F.slice("lines", F.col("from") + 1, F.col("to") - F.col("from")), "\n"), F.when((F.col("to") < F.size("lines")) | F.endswith("source", F.lit("\n")), "\n").otherwise(""))
    made = pieces.select("*", F.when(F.col("cut"), joined).otherwise(F.col("source")).alias("own"))
    several, part = F.col("cut") & (F.col("m") > 1), F.col("i") + 1
    label = F.concat("rel_path", F.lit(" [part "), part.cast("string"), F.lit("/"), F.col("m").cast("string"), F.lit("]"))
    values = {
        "file_path": F.col("rel_path"), "language": F.lit("doc"), "chunk_type": F.lit("doc"), "name": F.when(several, label).otherwise(F.col("rel_path")),
        "start_line": F.when(F.col("cut"), F.col("start") + F.col("from")).otherwise(F.col("start")).cast("int"), "end_line": F.when(F.col("cut"), F.col("start") + F.col("to") - 1).otherwise(F.col("stop")).cast("int"),
        "parent": F.lit(None).cast("string"), "file_hash": F.col("file_hash"), "source": F.col("own"), "token_count": tokens(F.col("own")),
        "metadata": F.when(several, F.create_map(F.lit("sub_index"), part, F.lit("sub_total"), F.col("m"))).otherwise(F.create_map().cast("map<string,int>")), "ordinal": F.col("section").cast("long") * (1 << 20) + F.col("i"),
    }
    return made.select(*[values[c].alias(c) for c in _ORDER])


def chunk_files(files: DataFrame, most: int = MAX_TOKENS, count: Callable[[str], int] | None = None, kind: str | None = None) -> DataFrame:
    """Chunks of files (rel_path, language, file_hash, content): documents by expressions, code one Arrow batch at a time; all
    by the second way where `count` gives another count of tokens. files is read once for each way, or once in all where
    `kind` (doc or code) says that it holds only such."""
    if kind == "doc" and count is None:
        made = doc_chunks(files, most)
    elif kind == "code" and count is None:
        made = _by_batches(files, most, count_tokens)
    elif count is None:
        docs, code = files.where("language = 'doc'"), files.where("language IS NULL OR language <> 'doc'")
        made = doc_chunks(docs, most).unionByName(_by_batches(code, most, count_tokens))
    else:
        made = _by_batches(files, most, count)
    from skein.functions.text import chunk_id

    return made.withColumn("chunk_id", chunk_id(F.col("file_path"), F.col("chunk_type"), F.col("source"), F.col("start_line")))


def _by_batches(files: DataFrame, most: int, count: Callable[[str], int]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"file_path": r.rel_path, "language": r.language, "file_hash": r.file_hash, "ordinal": i, **c} for r in pdf.itertuples(index=False) for i, c in enumerate(chunks_of(r.content or "", r.language, r.rel_path, most, count))]
            yield pd.DataFrame(rows, columns=list(_ORDER))

    return files.select("rel_path", "language", "file_hash", "content").mapInPandas(run, CHUNKS.removesuffix(", chunk_id string"))


def lines(files: DataFrame, key: str = "rel_path", text: str = "content") -> DataFrame:
    """key, line (from 1), text: the lines of each file as they stand between line ends."""
    return files.select(key, F.posexplode(F.split(text, "\n")).alias("p", "text")).select(key, (F.col("p") + 1).alias("line"), "text")


def section_numbers(of: DataFrame, heading: Column, key: str = "rel_path") -> DataFrame:
    """lines() with section: how many headings have come up to this line. A file's lines are one group: files are bounded in
    size when they are scanned."""
    return of.withColumn("section", F.sum(F.coalesce(heading, F.lit(False)).cast("long")).over(W.partitionBy(key).orderBy("line")))
