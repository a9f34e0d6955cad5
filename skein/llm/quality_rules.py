"""Operator 6: line-first cleaning in DataFrame functions only.

Every line is tested by rules of punctuation (junk signs, "!!", cut ends), navigation (separators, link lists) and
boilerplate phrases; failing lines are removed; a document that loses too much of its text is rejected, as is one that
fails the base rules (few words, repetition). Rules that look for a phrase only judge short lines, so a text of one line
that mentions a privacy policy stays.

Defined results: a null text counts as empty (no words, so rejected); a null doc_id stays null; repeated rows give a row
each; ties need no order; an empty table gives an empty one; columns other than doc_id and text are not looked at and
come back as they are. Very long texts and lines are judged whole, in n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
#: What stands between signs, by a class below U+0100, which Java tests by a bit map; a line that a rule removes has a run of
#: signs, one of the strings MARKS or a phrase in it.
NO_SIGNS, SIGNS, MARKS = "[^#*$%&|<>!»·:/]+", "[#*$%&<>]{2}|!!|[|»·]|::|//", ("›", "•", "…", "...", "www.")
MIN_WORDS, MAX_REPEAT, REPEAT_WINDOW = 50, 0.5, 3
#: A document is rejected when more than this share of its word characters was in removed lines.
MAX_LOST = 0.5
#: Shares of a line's words, at the least, that make it fail: junk signs, "!!", separators of menus, links.
SYMBOL_SHARE, SHOUT_SHARE, PIPE_SHARE, LINK_SHARE = 0.3, 0.5, 0.25, 0.5
#: Words of a line up to which a phrase of page furniture, or a cut end ("... read more"), makes it fail: longer lines are text.
SHORT_LINE = 30
#: Signs that part the entries of a menu; ends of a line that was cut off; phrases of page furniture.
SEPARATORS = ("|", "»", "›", "·", "•", "::")
TEASER = "(\\[\\.\\.\\.\\]|\\[…\\]|(\\.\\.\\.|…) ?(read|show|see) more)[\\x20\\x09-\\x0D]*$"
BOILERPLATE = (
    "accept all cookies", "all rights reserved worldwide", "click here to", "enable javascript", "javascript is disabled",
    "lorem ipsum", "powered by wordpress", "privacy policy", "sign up for our newsletter", "skip to content", "subscribe to our",
    "terms of service", "this site uses cookies", "we use cookies",
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def with_repeated_words(df: DataFrame, words: str, name: str, width: int = REPEAT_WINDOW) -> DataFrame:
    """Adds how many words stand in a window of `width` words that the text has twice or more.

    Sorts (hash, place) pairs and compares neighbours, so it is n log n also for very repetitive texts. Each step
    is a column of its own: what a lambda refers to is then read from the row, not computed for every element.
    sort_array compares the pairs itself, where array_sort would call a lambda for each comparison.
    """
    n = F.size(words)
    hashes = F.when(n > width, F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(width)])))
    df = df.withColumn("_h", hashes)
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_p", F.when(repeats, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda s, i: F.coalesce(F.get("_p", i - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get("_p", i + 1)["h"] == s["h"], F.lit(False))
    df = df.withColumn("_d", F.filter("_p", same))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_d", lambda s: F.array(*[s["i"] + k for k in range(width)])))))
    return df.withColumn(name, F.when(F.col("_d").isNull(), 0).otherwise(covered).cast("long")).drop("_h", "_p", "_d")


def may_fail(text: Column, low: Column, signs: Column) -> Column:
    """False only if no rule can remove a line of the text: each rule needs signs, a mark or a phrase somewhere in it.

    signs: the text with a space for each NO_SIGNS, short in most texts. None has a newline, so what a line has the text
    has. A phrase as a regular expression is searched by Boyer and Moore's method; contains() would look at every byte.
    """
    found = signs.rlike(SIGNS)
    for mark in MARKS:
        found = found | text.contains(mark)
    for phrase in BOILERPLATE:
        found = found | low.rlike(phrase)
    return found


def line_fails(line: Column, low: Column, words: Column) -> Column:
    """True if a rule removes the line (low: in lower case). Lines without a word fail no rule: they carry no text."""
    n = F.size(words)
    count = lambda pattern: F.size(F.filter(words, lambda w: w.rlike(pattern)))
    junk, shout, links = count("[#*$%&<>]{2,}"), count("!!+$"), count("^(https?://|www[.])")
    pipes = F.size(F.filter(words, lambda w: w.isin(*SEPARATORS)))
    furniture = low.rlike(TEASER)
    for phrase in BOILERPLATE:
        furniture = furniture | low.contains(phrase)
    bad_junk = line.rlike("[#*$%&<>]{2,}") & (junk >= SYMBOL_SHARE * n)
    bad_shout = line.contains("!!") & (shout > 1) & (shout >= SHOUT_SHARE * n)
    bad_pipes = line.rlike("[|»›·•]|::") & (pipes > 1) & (pipes >= PIPE_SHARE * n)
    bad_links = line.rlike("https?://|www[.]") & (links >= LINK_SHARE * n)
    return bad_junk | bad_shout | bad_pipes | bad_links | ((n <= SHORT_LINE) & furniture)


def quality(docs: DataFrame) -> DataFrame:
    """All columns of docs and: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars (long),
    base_failed, kept (boolean), clean_text (the lines that no rule removed)."""
    text = F.coalesce(docs["text"], F.lit(""))
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), text.alias("_t"))
    base = base.withColumn("_w", words_of(F.col("_t"))).withColumn("_l", F.split("_t", "\n"))
    base = with_repeated_words(base, "_w", "n_repeat_words")
    base = base.withColumn("_g", F.regexp_replace("_t", NO_SIGNS, " ")).withColumn("_low", F.lower("_t"))
    split = F.transform("_l", lambda x: F.struct(x.alias("t"), F.lower(x).alias("low"), words_of(x).alias("w")))
    base = base.withColumn("_s", F.when(may_fail(F.col("_t"), F.col("_low"), F.col("_g")), split)).drop("_low")
    marked = F.transform("_s", lambda x: F.struct(x["t"].alias("t"), line_fails(x["t"], x["low"], x["w"]).alias("bad"), F.length(F.array_join(x["w"], "")).alias("c")))
    base = base.withColumn("_marked", marked)
    worded = lambda lines: F.filter(lines, lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    base = base.withColumn("_u", F.array_distinct("_l"))
    dup = F.when(F.size("_u") == F.size("_l"), 0).otherwise(F.size(worded("_l")) - F.size(worded("_u")))
    lost = F.aggregate(F.filter("_marked", lambda x: x["bad"]), F.lit(0), lambda a, x: a + x["c"])
    out = base.select(
        "_row", "_t", "_marked", "n_repeat_words",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_g", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"),
        F.coalesce(lost, F.lit(0)).cast("long").alias("lost_chars"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEAT) * F.col("n_words"))
    clean = F.coalesce(F.array_join(F.transform(F.filter("_marked", lambda x: ~x["bad"]), lambda x: x["t"]), "\n"), "_t")
    return out.select("_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", failed.alias("base_failed"), (~failed & (F.col("lost_chars") <= MAX_LOST * F.col("word_chars"))).alias("kept"), clean.alias("clean_text"))


def digest(docs: DataFrame) -> DataFrame:
    found = quality(docs.select("doc_id", "text"))
    return found.select(F.col("_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


_SQL_BAD = " OR ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE)
_SQL_SEPARATORS = "(" + ", ".join(f"'{x}'" for x in SEPARATORS) + ")"
_SQL_WORDS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, {_SQL_WORDS.format("t")} AS w FROM d),
win AS (SELECT rid, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) >= 3),
keyed AS (SELECT rid, p, [w[p], w[p + 1], w[p + 2]] AS k FROM win),
many AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, k) AS n FROM keyed),
rep AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM many WHERE n > 1) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d),
lw AS (SELECT rid, l, {_SQL_WORDS.format("l")} AS w FROM lines),
lm AS (SELECT rid, l, len(w) AS n, len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&<>]{{2,}}'))) AS junk,
  len(list_filter(w, lambda x: regexp_matches(x, '!!+$'))) AS shout, len(list_filter(w, lambda x: x IN {_SQL_SEPARATORS})) AS pipes, len(list_filter(w, lambda x: regexp_matches(x, '^(https?://|www[.])'))) AS links,
  length(regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g')) AS c FROM lw),
ls AS (SELECT rid, count(*) FILTER (n > 0) - count(DISTINCT l) FILTER (n > 0) AS dup,
  coalesce(sum(c) FILTER ((junk > 0 AND junk >= {SYMBOL_SHARE} * n) OR (shout > 1 AND shout >= {SHOUT_SHARE} * n) OR (pipes > 1 AND pipes >= {PIPE_SHARE} * n) OR (links > 0 AND links >= {LINK_SHARE} * n) OR (n <= {SHORT_LINE} AND ({_SQL_BAD} OR regexp_matches(lower(l), '{TEASER}')))), 0) AS lost
  FROM lm GROUP BY rid),
o AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(w.t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(w.t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(ls.dup AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(ls.lost AS BIGINT) AS lost_chars FROM w JOIN ls USING (rid) LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {int(100 * MAX_REPEAT)} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {int(100 * MAX_REPEAT)} * n_words) AND lost_chars <= {MAX_LOST} * word_chars AS kept, lost_chars FROM o
"""
