"""Repository scan: the driver lists and prunes, executors read and hash."""

from __future__ import annotations

import fnmatch
import os
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import DOC_EXTENSIONS, LANGUAGES, is_sensitive

# Directories, file names and extensions that are never read.
IGNORED_DIRS = frozenset((
    ".git", ".hg", ".svn", "__pycache__", "node_modules", ".venv", "venv", "env", ".env", "dist", "build", ".next", "coverage", ".mypy_cache", ".pytest_cache", ".ruff_cache",
    ".idea", ".vscode", ".skein", ".chroma", ".indexes", "chroma_data", "target", "vendor",
))
IGNORED_NAMES = frozenset((
    ".env", ".env.local", ".env.production", ".env.development", ".DS_Store", "Thumbs.db", ".npmrc", ".pypirc", "id_rsa", "id_dsa",
    "credentials.json", "secrets.json", "credentials.yaml", "secrets.yaml",
))
IGNORED_EXTENSIONS = frozenset((
    ".exe", ".dll", ".so", ".dylib", ".o", ".a", ".lib", ".pyd", ".pyc", ".pyo", ".class", ".jar", ".war", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp",
    ".mp4", ".avi", ".mov", ".mp3", ".wav", ".flac", ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar", ".ttf", ".otf", ".woff", ".woff2", ".eot", ".lock",
))
MAX_FILE_SIZE = 1 << 20
_BY_EXTENSION = {e: "doc" for e in DOC_EXTENSIONS} | {e: n for n, own in LANGUAGES.items() for e in own}
LISTED = "abs_path string, rel_path string, language string, extension string, size long"
#: Files that a task holds at once.
READ_FILES = 64


def extension_of(name: str) -> str:
    return name[name.rfind(".") :].lower() if name.rfind(".") > 0 else ""


class Rules:
    """Ignore rules in order; the last that matches wins. Each holds below the directory of its file."""

    def __init__(self) -> None:
        self.rules: list[tuple[str, list[str], bool, bool, bool]] = []

    def load(self, base: str, text: str) -> None:
        for line in text.splitlines():
            p = line.rstrip()
            if not p or p.startswith("#"):
                continue
            negated, p = (True, p[1:]) if p.startswith("!") else (False, p)
            only_dirs, p = p.endswith("/"), p.rstrip("/")
            anchored, parts = "/" in p, [x for x in p.split("/") if x]
            if parts:
                self.rules.append((base, parts, negated, only_dirs, anchored))

    def ignored(self, rel: str, is_dir: bool) -> bool:
        out = False
        for base, parts, negated, only_dirs, anchored in self.rules:
            if base and not rel.startswith(base + "/") or only_dirs and not is_dir:
                continue
            own = rel[len(base) + 1 :].split("/") if base else rel.split("/")
            starts = (0,) if anchored else range(len(own))
            if any(matches(own[s:], parts) for s in starts):
                out = not negated
        return out


def matches(names: list[str], parts: list[str]) -> bool:
    """The path begins with what the pattern says; ** stands for any number of names, none included."""
    if not parts:
        return True
    if parts[0] == "**":
        return any(matches(names[k:], parts[1:]) for k in range(len(names) + 1))
    return bool(names) and fnmatch.fnmatchcase(names[0], parts[0]) and matches(names[1:], parts[1:])


#: Why a file is passed over, in the order of the tests.
REASONS = ("symlink", "name", "extension", "ignored", "size", "empty", "language")


def listing(root: str, max_size: int = MAX_FILE_SIZE, skipped: Counter | None = None) -> list[tuple[str, str, str, str, int]]:
    """Files that pass every test that needs no content, by path; skipped counts the others by reason."""
    if not os.path.isdir(root):
        raise ValueError(f"not a directory: {root}")
    rules, out, skipped = Rules(), [], Counter() if skipped is None else skipped
    for here, dirs, names in os.walk(root):
        base = os.path.relpath(here, root).replace(os.sep, "/").removeprefix(".")
        if ".gitignore" in names:
            with open(os.path.join(here, ".gitignore"), encoding="utf-8", errors="replace") as f:
                rules.load(base, f.read())
        path = lambda n, base=base: f"{base}/{n}" if base else n
        dirs[:] = sorted(d for d in dirs if d not in IGNORED_DIRS and not os.path.islink(os.path.join(here, d)) and not rules.ignored(path(d), True))
        for n in names:
            full, ext = os.path.join(here, n), extension_of(n)
            found = ("symlink" if os.path.islink(full) else "name" if n in IGNORED_NAMES else "extension" if ext in IGNORED_EXTENSIONS else "ignored" if rules.ignored(path(n), False) else "")
            try:
                size = 0 if found else os.stat(full).st_size
            except OSError:
                size = max_size + 1
            found = found or ("size" if size > max_size else "empty" if not size else "" if ext in _BY_EXTENSION else "language")
            if found:
                skipped[found] += 1
            else:
                out.append((full, path(n), _BY_EXTENSION[ext], ext, size))
    return sorted(out, key=lambda x: x[1])


def listed(spark: SparkSession, root: str, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """What listing() finds, as a table: abs_path, rel_path, language, extension, size."""
    return spark.createDataFrame(listing(root, max_size), LISTED)


def described(raw: DataFrame) -> DataFrame:
    """file_hash (of the bytes) and content (bytes that are no UTF-8 replaced) instead of raw; documents with a sensitive
    assignment are left out. raw: any columns, language, raw (binary; null: the file could not be read, it is left out)."""
    text = F.col("raw").cast("string")
    doc = F.coalesce(F.col("language") == "doc", F.lit(False))
    kept = raw.where(F.col("raw").isNotNull() & ~(doc & is_sensitive(text)))  # the marks are ASCII: found in any bytes
    return kept.withColumns({"file_hash": F.sha2("raw", 256), "content": F.make_valid_utf8(text)}).drop("raw")


def contents(files: DataFrame) -> DataFrame:
    """The listed files with what they hold, in order of rel_path: only paths are shuffled, executors read bytes."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), READ_FILES):
                part = pdf.iloc[at : at + READ_FILES]
                yield part.assign(raw=[_bytes(p) for p in part["abs_path"]])

    ordered = files.repartitionByRange("rel_path").sortWithinPartitions("rel_path")
    return described(ordered.mapInPandas(read, f"{LISTED}, raw binary"))


def _bytes(path: str) -> bytes | None:
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


def scan(spark: SparkSession, root: str, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """One row per file to index, by rel_path. root must be a folder that executors see, too."""
    return contents(listed(spark, root, max_size))
