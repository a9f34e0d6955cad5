"""Text expressions: keywords, languages, URLs, escaping, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no keywords of the vector channel.
VECTOR_STOPS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can", "shall",
    "i", "you", "he", "she", "it", "we", "they", "this", "that", "these", "those", "what", "which", "who", "how", "where", "when", "why", "if", "then", "else", "and", "or",
    "not", "but", "for", "with", "to", "from", "of", "in", "on", "at", "by", "as",
    "哪里", "什么", "怎么", "如何", "哪些", "哪个", "这个", "那个", "一下", "告诉", "请", "帮", "看", "说", "下",
)
# Words that are no keywords of the lexical channel.
LEXICAL_STOPS = (
    "the", "and", "for", "with", "this", "that", "from", "into", "code", "file", "function", "class", "method", "module", "where", "what", "which", "how",
    "中文", "哪里", "什么", "怎么", "如何", "哪些", "哪个", "这个", "那个", "一下", "告诉", "请", "帮", "看", "说",
)
# Extensions of each language.
LANGUAGES = {
    "python": (".py",), "javascript": (".js", ".mjs", ".cjs"), "typescript": (".ts",), "tsx": (".tsx",), "java": (".java",), "go": (".go",), "c": (".c", ".h"),
    "cpp": (".cpp", ".cxx", ".cc", ".hpp", ".hxx", ".hh"), "rust": (".rs",), "ruby": (".rb",), "php": (".php",), "c_sharp": (".cs",), "swift": (".swift",), "lua": (".lua",),
    "shell": (".sh", ".bash", ".zsh"),
}
DOC_EXTENSIONS = (".md", ".rst", ".txt", ".adoc", ".toml", ".yaml", ".yml", ".json")
SENSITIVE = ("API_KEY=", "SECRET=", "TOKEN=")

IDENTIFIER, HYPHENATED = "[a-zA-Z_][a-zA-Z0-9_]*", "[a-zA-Z_][a-zA-Z0-9_-]{1,}"
FILENAME, CJK_PAIR = r"[a-zA-Z0-9_-]+\.[a-zA-Z]{1,10}", "[一-鿿]{2}"


def _keywords(q: Column, patterns: tuple[str, ...], stops: tuple[str, ...]) -> Column:
    found = F.concat(*[F.regexp_extract_all(F.coalesce(q, F.lit("")), F.lit(p), F.lit(0)) for p in patterns])
    lowered = F.array_distinct(F.transform(found, F.lower))
    return F.filter(lowered, lambda w: (F.length(w) >= 2) & ~w.isin(*stops))


def keywords_vector(q: Column) -> Column:
    """Keywords that lift hits of the vector channel, distinct, in order of identifiers, character pairs, file names."""
    return _keywords(q, (IDENTIFIER, CJK_PAIR, FILENAME), VECTOR_STOPS)


def keywords_lexical(q: Column) -> Column:
    """Keywords of the lexical channel, distinct, in order of identifiers with hyphens, file names, character pairs."""
    return _keywords(q, (HYPHENATED, FILENAME, CJK_PAIR), LEXICAL_STOPS)


def extension(name: Column) -> Column:
    """From the last dot on if something stands before it, else ''."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)


def language_of(ext: Column) -> Column:
    """doc for document extensions, a language for code, else null."""
    low = F.lower(ext)
    case = F.when(low.isin(*DOC_EXTENSIONS), "doc")
    for name, own in LANGUAGES.items():
        case = case.when(low.isin(*own), name)
    return case


def is_sensitive(text: Column) -> Column:
    out = F.lit(False)
    for s in SENSITIVE:
        out = out | text.contains(s)
    return F.coalesce(out, F.lit(False))


def normalized(c: Column) -> Column:
    return F.lower(F.replace(F.trim(c), F.lit("\\"), F.lit("/")))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a non-empty part."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def escape_context(c: Column) -> Column:
    """Backticks of runs of three and more get a space each; tags of the context frame are broken up."""
    spaced = F.regexp_replace(c, "`(?=``)|(?<=`)`(?=`)|(?<=``)`", "` ")
    return F.regexp_replace(spaced, "<(/?)untrusted_context>", "< $1untrusted_context >")


def shortened(c: Column, most: int = 60) -> Column:
    """For display: the end of a longer string behind three dots."""
    return F.when(F.length(c) > most, F.concat(F.lit("..."), F.substring(c, 3 - most, most - 3))).otherwise(c)


def json_map(c: Column) -> Column:
    """A JSON object as a map; what is no object becomes an empty map."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def json_text(c: Column) -> Column:
    """A map as a JSON object, keys in order; null becomes an empty one. json_map() of it gives the map again."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(c)))
    return F.coalesce(F.to_json(ordered), F.lit("{}"))


def headings(line: Column) -> Column:
    """Whether a line of a document is a heading: one to six # and a space, then text."""
    return line.rlike("^#{1,6}[ \\t]+\\S")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[。！？!?；;.\\n]+"), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), lambda s: s != "")


def rationale(s: Column) -> Column:
    """Why a step of a plan is asked, by its question words."""
    has = lambda *w: s.rlike("|".join(w))
    return (
        F.when(s == "", "补充子问题")
        .when(has("怎么", "如何", "how", "How", "实现"), "理解任务的具体实现路径")
        .when(has("为什么", "为何", "why", "Why", "原因"), "解释问题背后的设计 / 决策原因")
        .when(has("哪些", "哪里", "哪个", "what", "What", "文件", "函数"), "定位到具体文件 / 符号")
        .otherwise("用户任务中的一个独立子目标")
    )


def git_kind(url: Column) -> Column:
    """git, local or unsafe, as a source string is treated before anything is fetched."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    return (
        F.when(url.rlike("^[A-Za-z]:[\\\\/]"), "local")
        .when(scheme.isin("https", "ssh", "git+ssh"), "git")
        .when(scheme != "", "unsafe")
        .when(url.rlike("^[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+:.+$"), "git")
        .otherwise("local")
    )


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no query, fragment or trailing slash; user@host:path becomes an ssh URL.
    Null where the form is not accepted: no scheme, or credentials in http(s)."""
    t = F.trim(url)
    scp = "^([A-Za-z0-9_.-]+)@([A-Za-z0-9_.-]+):/?(.*)$"
    t = F.when(t.rlike(scp) & ~t.contains("://"), F.regexp_replace(t, scp, "ssh://$1@$2/$3")).otherwise(t)
    parts = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"
    scheme, net, path = F.lower(F.regexp_extract(t, parts, 1)), F.regexp_extract(t, parts, 2), F.regexp_extract(t, parts, 3)
    user, host = F.regexp_extract(net, "^(.*@)?([^@]*)$", 1), F.lower(F.regexp_extract(net, "^(.*@)?([^@]*)$", 2))
    trimmed = F.regexp_replace(path, "/+$", "")
    clean = F.when(trimmed == "", "/").otherwise(trimmed)
    return F.when((scheme == "") | (scheme.isin("http", "https") & (user != "")), None).otherwise(F.concat(scheme, F.lit("://"), user, host, clean))


def cache_dir_name(url: Column) -> Column:
    """Last part of the URL and eight digits of its SHA-256."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(url), "^[a-zA-Z][a-zA-Z0-9+.\\-]*://", ""), "^[^/@]+@", ""), "\\.git$", "")
    t = F.regexp_replace(F.regexp_replace(t, "[:/\\\\.]+", "_"), "_+", "_")
    t = F.regexp_replace(t, "^_+|_+$", "")
    base = F.when(t == "", "repo").otherwise(t)
    return F.concat(F.element_at(F.split(base, "_"), -1), F.lit("_"), F.substring(F.sha2(url, 256), 1, 8))


def chunk_id(path: Column, kind: Column, source: Column, start: Column) -> Column:
    return F.concat(path, F.lit(":"), F.substring(F.sha2(F.concat(kind, F.lit(":"), source, F.lit(":"), start.cast("string")), 256), 1, 12))


def module_summary(path: Column, source: Column) -> Column:
    """Header, then the import and assignment lines; with fewer than two of them the first 20 lines."""
    lines = F.split(source, "(?<=\\n)")
    strip = lambda c: F.regexp_replace(c, "^\\s+|\\s+$", "")
    told = F.filter(lines, lambda x: strip(x).rlike("(?i)^(import\\s|from\\s|#include\\s|using\\s|use\\s|require\\s|package\\s)") | (strip(x).rlike("^[A-Za-z_][A-Za-z0-9_]*\\s*[:=]")))
    text = strip(F.array_join(F.when(F.size(told) < 2, F.slice(lines, 1, 20)).otherwise(told), ""))
    return F.concat(F.lit("# File: "), path, F.lit("\n"), F.when(text == "", F.concat(F.lit("# File: "), path)).otherwise(text))
