"""Operator 13: damaged conversations, their faults, and the cheapest edits that give them a proper turn order.

Rows are sorted once by (conversation, turn, role, text) and numbered by their place. Windows over equal (conversation,
role, text) tell repeats from first occurrences. Blocks of neighbouring rows are collected as sorted structs, and
aggregate() carries four (cost, audit) structs through them, one for each state of `(s?(ua)+)?`: nothing yet, behind s,
behind u, behind a. Every step takes native least() of what keeping, renaming, deleting and inserting give. A block is
folded for each state it may begin in, and blocks are composed in groups until a conversation is one, so a conversation of
any number of rows is folded in parallel and in linear time. Unreachable states are null, which least() passes over.

Inside, audits tell a user from an assistant: I/J insert and R/S rename to user/assistant. Of two audits of one cost that end
in one state neither begins the other, and where they first differ the letters are of different edits, so the order of
these letters is that of the initials D < I < K < R.

Defined results: null roles and texts are one space, null ids and turns are one space within the hashed key; rows of one
turn go by role and text in code point order; rows without a conversation are one conversation; equal rows are
duplicates; a role that begins with another letter can only be renamed or deleted; a gap beyond a long is null; an empty
table gives an empty one; other columns are not looked at. The repaired text of a conversation is hashed as one value, which
is what bounds a conversation (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.llm.common import staged

#: White space of the contract, and marks that end a turn.
SPACE, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: Rows of a block are those whose places agree but for so many low bits; blocks of one composition.
BLOCK_BITS, FAN = 7, 64
#: Characters of a text by which rows of one turn and role are dealt to ranges.
DEAL_CHARS = 64
STATES = 4
_CELL = "struct<c:bigint,a:string>"
_VECTOR = "struct<" + ",".join(f"v{s}:{_CELL}" for s in range(STATES)) + ">"


def _bound(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda variable holds it."""
    return F.transform(F.array(value), body)[0]


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the hash of `conv_id:turn` chooses."""
    key = F.concat_ws(":", *[F.coalesce(turns[c].cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    own = turns.select(turns["conv_id"].alias("conv_id"), turns["turn"].cast("long").alias("turn"), F.coalesce(turns["role"], F.lit(" ")).alias("r"), F.coalesce(turns["text"], F.lit(" ")).alias("t"), (F.crc32(key.cast("binary")) % 20).alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("t", "[.!?]", "")).otherwise(F.col("t"))
    times = F.when(F.col("d") == 0, 0).when(F.col("d") == 3, 2).otherwise(1)
    return own.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("r")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times))).drop("col")


def placed(rows: DataFrame) -> DataFrame:
    """Rows with their place m in the order of conversations and turns; a conversation's rows may lie in several ranges."""
    by = ["conv_id", F.col("turn").asc_nulls_first(), "role"]
    dealt = rows.repartitionByRange(*by, F.substring("text", 1, DEAL_CHARS)).sortWithinPartitions(*by, "text")
    return staged(dealt.withColumn("m", F.monotonically_increasing_id()), "turns")


def flagged(rows: DataFrame) -> DataFrame:
    """conv_id, m, turn, i (role's initial), f: first fault (0 none, 1 blank, 2 duplicate, 3 truncated)."""
    end = F.rtrim("text", F.lit(SPACE))
    told = rows.select("conv_id", "m", "turn", "role", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(*ENDS)).alias("cut"))
    seen = F.row_number().over(W.partitionBy("conv_id", "role", "h1", "h2").orderBy("m")) > 1
    fault = F.when(F.col("blank"), 1).when(F.col("seen"), 2).when(F.col("cut"), 3).otherwise(0)
    return told.withColumn("seen", seen).select("conv_id", "m", "turn", F.left("role", F.lit(1)).alias("i"), fault.alias("f"))


def _after(v: Column, cost, letters: str) -> Column:
    """A state's (cost, audit) with more edits; of an unreachable one null."""
    return F.when(v.isNotNull(), F.struct((v["c"] + cost).cast("long").alias("c"), F.concat(v["a"], F.lit(letters)).alias("a")))


def _vector(*cells: Column) -> Column:
    return F.struct(*[c.alias(f"v{s}") for s, c in enumerate(cells)])


def _with_inserts(v: Column) -> Column:
    """What inserts before the next row, or at the end, add."""
    begin = F.least(v["v0"], v["v1"])
    return _vector(v["v0"], v["v1"], F.least(v["v2"], _after(begin, 2, "I"), _after(v["v3"], 2, "I")), F.least(v["v3"], _after(v["v2"], 2, "J"), _after(begin, 4, "IJ")))


def _row(v: Column, x: Column) -> Column:
    """The four structs behind a row."""
    stays, extra = x["f"].isin(0, 3), (x["f"] == 3).cast("long")
    keeps = lambda initial, cell: F.when(stays & (x["i"] == initial), _after(cell, extra, "K"))

    def moved(w: Column) -> Column:
        before_u = F.least(w["v0"], w["v1"], w["v3"])
        return _vector(
            _after(w["v0"], 3, "D"),
            F.least(_after(w["v1"], 3, "D"), keeps("s", w["v0"])),
            F.least(_after(w["v2"], 3, "D"), keeps("u", before_u), F.when(stays, _after(before_u, extra + 2, "R"))),
            F.least(_after(w["v3"], 3, "D"), keeps("a", w["v2"]), F.when(stays, _after(w["v2"], extra + 2, "S"))),
        )

    return _bound(_with_inserts(v), moved)


def _start(state: Column) -> Column:
    none = F.lit(None).cast(_CELL)
    return _vector(*[F.when(state == s, F.struct(F.lit(0).cast("long").alias("c"), F.lit("").alias("a"))).otherwise(none) for s in range(STATES)]).cast(_VECTOR)


def _composed(a: Column, b: Column) -> Column:
    """The structs through two stretches: a's rows by their first state, and b's by the state between."""
    both = lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.struct((x["c"] + y["c"]).alias("c"), F.concat(x["a"], y["a"]).alias("a")))
    return F.transform(a, lambda v: _vector(*[F.least(*[both(v[f"v{k}"], b[k][f"v{s}"]) for k in range(STATES)]) for s in range(STATES)]))


_LEGAL = ("su", "ua", "au")


def folded(rows: DataFrame) -> DataFrame:
    """conv_id, block and part of every block: its matrix of structs, counts, and what its ends show to its neighbours."""
    block = F.shiftright("m", BLOCK_BITS).alias("block")
    blocks = rows.groupBy("conv_id", block).agg(F.sort_array(F.collect_list(F.struct("m", "turn", "i", "f"))).alias("x"))
    first = F.row_number().over(W.partitionBy("conv_id").orderBy("block")) == 1
    starts = F.when(F.col("first"), F.array(F.lit(0))).otherwise(F.array(*[F.lit(s) for s in range(STATES)]))
    matrix = F.transform(starts, lambda s: F.aggregate("x", _start(s), _row))
    count = lambda f: F.size(F.filter("x", lambda r: r["f"] == f)).cast("long")
    pairs = F.filter(F.transform("x", lambda r, k: F.concat(F.col("x")[F.greatest(k - 1, F.lit(0))]["i"], r["i"]).isin(*_LEGAL) | (k == 0)), lambda ok: ~ok)
    turns = F.array_compact(F.transform("x", lambda r: r["turn"]))
    part = F.struct(
        matrix.alias("matrix"), count(1).alias("blank"), count(2).alias("duplicate"), count(3).alias("truncated"), F.size(pairs).cast("long").alias("illegal"),
        F.size(F.array_distinct(turns)).cast("long").alias("turns"), F.array_min(turns).alias("lo"), F.array_max(turns).alias("hi"), F.col("x")[0]["i"].alias("i0"), F.element_at("x", -1)["i"].alias("i1"),
    )
    return blocks.withColumn("first", first).select("conv_id", "block", part.alias("part"))


def _joined(a: Column, b: Column) -> Column:
    """Two neighbouring stretches as one. Turns are sorted, so a turn of both is the last of one and the first of the other."""
    more = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated")}
    more["illegal"] = a["illegal"] + b["illegal"] + (~F.concat(a["i1"], b["i0"]).isin(*_LEGAL)).cast("long")
    more["turns"] = a["turns"] + b["turns"] - F.coalesce((a["hi"] == b["lo"]).cast("long"), F.lit(0))
    more |= {"lo": F.coalesce(a["lo"], b["lo"]), "hi": F.coalesce(b["hi"], a["hi"]), "i0": a["i0"], "i1": b["i1"]}
    return F.struct(_composed(a["matrix"], b["matrix"]).alias("matrix"), *[v.alias(k) for k, v in more.items()])


def whole(blocks: DataFrame) -> DataFrame:
    """conv_id, part of every conversation: blocks are numbered within theirs and composed FAN at a time."""
    order = F.row_number().over(W.partitionBy("conv_id").orderBy("block")) - 1
    now = staged(blocks.withColumn("block", order), "blocks")
    while True:
        more = now.groupBy().agg(F.max("block")).first()[0] or 0
        in_order = F.array_sort(F.collect_list(F.struct("block", "part")), lambda a, b: F.when(a["block"] < b["block"], -1).otherwise(1))
        met = now.groupBy("conv_id", F.floor(F.col("block") / FAN).alias("group")).agg(F.transform(in_order, lambda s: s["part"]).alias("ps"))
        now = met.select("conv_id", F.col("group").alias("block"), F.aggregate(F.slice("ps", 2, F.greatest(F.size("ps") - 1, F.lit(0))), F.col("ps")[0], _joined).alias("part"))
        if more < FAN:
            return now.select("conv_id", "part")
        now = staged(now, "blocks")


def _repaired(audit: Column, rows: Column) -> Column:
    """The repaired `role:text` lines; rows: sorted structs with role and text."""
    said = lambda ins: F.replace(F.replace(ins, F.lit("I"), F.lit("user:\n")), F.lit("J"), F.lit("assistant:\n"))
    steps = F.regexp_extract_all(audit, F.lit("[IJ]*[DKRS]"), F.lit(0))

    def line(r: Column, step: Column) -> Column:
        last = F.right(step, F.lit(1))
        role = F.when(last == "K", r["role"]).when(last == "R", "user").otherwise("assistant")
        return F.concat(said(F.regexp_replace(step, "[DKRS]", "")), F.when(last == "D", "").otherwise(F.concat(role, F.lit(":"), r["text"], F.lit("\n"))))

    lines = F.concat(F.array_join(F.zip_with(rows, steps, line), ""), said(F.regexp_extract(audit, r"([IJ]*)\z", 1)))
    return _bound(lines, lambda s: F.left(s, F.char_length(s) - 1))


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, and the repaired text, of every conv_id."""
    rows = placed(damaged(turns))
    parts = whole(folded(flagged(rows)))
    end = F.transform(F.array(_with_inserts(F.col("part")["matrix"][0])), lambda w: F.least(w["v0"], w["v3"]))[0]
    best = parts.select(F.col("conv_id").alias("of"), F.col("part"), end.alias("best"))
    texts = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("m", "role", "text"))).alias("rows"))
    all_ids = turns.select(turns["conv_id"].alias("conv_id")).distinct()
    both = all_ids.join(best, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    both = both.join(texts.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    p, wide = F.col("part"), lambda c: c.cast("decimal(38,0)")
    gaps = F.when(p["lo"].isNull(), F.lit(0).cast("long")).otherwise((wide(p["hi"]) - wide(p["lo"]) + 1 - wide(p["turns"])).try_cast("long"))
    rich = F.coalesce(F.col("best")["a"], F.lit(""))
    return both.select(
        "conv_id", gaps.alias("gaps"), *[zero(p[k]).alias(k) for k in ("blank", "duplicate", "truncated", "illegal")], zero(F.col("best")["c"]).alias("cost"),
        F.translate(rich, "JS", "IR").alias("audit"), F.when(F.col("rows").isNull(), "").otherwise(_repaired(rich, F.col("rows"))).alias("repaired"),
    )


def digest(turns: DataFrame) -> DataFrame:
    """The contract's columns; repaired texts as their hash."""
    return repaired(turns).withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired")


#: CRC-32 of the key, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda x: CAST(0 AS BIGINT))), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))))"""
#: Whole: a recursion over the rows of each conversation keeps the cheapest edits for each state, in the initials' own order.
ORACLE = f"""
WITH RECURSIVE b AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t, {_CRC32} % 20 AS d FROM conversations),
g AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE r END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS text, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e FROM g),
x AS (SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS pi, CASE WHEN e = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 2 WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f FROM p),
ins(st, nt, c, a, o) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 2, 'I', 'user:' || chr(10)), (1, 2, 2, 'I', 'user:' || chr(10)), (3, 2, 2, 'I', 'user:' || chr(10)), (2, 3, 2, 'I', 'assistant:' || chr(10)), (0, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))),
edit(st, nt, c, a, i, nr) AS (VALUES (0, 0, 3, 'D', NULL, NULL), (1, 1, 3, 'D', NULL, NULL), (2, 2, 3, 'D', NULL, NULL), (3, 3, 3, 'D', NULL, NULL), (0, 1, 0, 'K', 's', NULL), (0, 2, 0, 'K', 'u', NULL), (1, 2, 0, 'K', 'u', NULL), (3, 2, 0, 'K', 'u', NULL), (2, 3, 0, 'K', 'a', NULL),
  (0, 2, 2, 'R', NULL, 'user'), (1, 2, 2, 'R', NULL, 'user'), (3, 2, 2, 'R', NULL, 'user'), (2, 3, 2, 'R', NULL, 'assistant')),
fold AS (SELECT conv_id, 0 AS k, 0 AS st, 0 AS c, '' AS a, '' AS o FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, k, st, c, a, o FROM (
    SELECT s.conv_id, x.k, edit.nt AS st, s.c + ins.c + edit.c + CASE WHEN x.f = 3 AND edit.a <> 'D' THEN 1 ELSE 0 END AS c, s.a || ins.a || edit.a AS a,
      s.o || ins.o || CASE WHEN edit.a = 'D' THEN '' ELSE coalesce(edit.nr, x.role) || ':' || x.text || chr(10) END AS o,
      row_number() OVER (PARTITION BY s.conv_id, edit.nt ORDER BY s.c + ins.c + edit.c + CASE WHEN x.f = 3 AND edit.a <> 'D' THEN 1 ELSE 0 END, s.a || ins.a || edit.a) AS best
    FROM fold s JOIN x ON x.conv_id IS NOT DISTINCT FROM s.conv_id AND x.k = s.k + 1 JOIN ins ON ins.st = s.st JOIN edit ON edit.st = ins.nt
    WHERE edit.a = 'D' OR x.f IN (0, 3) AND (edit.i IS NULL OR edit.i = x.i)) WHERE best = 1),
n AS (SELECT conv_id, max(k) AS n FROM fold GROUP BY conv_id),
z AS (SELECT s.conv_id, s.c + ins.c AS c, s.a || ins.a AS a, s.o || ins.o AS o, row_number() OVER (PARTITION BY s.conv_id ORDER BY s.c + ins.c, s.a || ins.a) AS best
  FROM fold s JOIN n ON n.conv_id IS NOT DISTINCT FROM s.conv_id AND n.n = s.k JOIN ins ON ins.st = s.st WHERE ins.nt IN (0, 3)),
m AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated, count(*) FILTER (pi || i NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(c AS BIGINT) AS cost, a AS audit, sha256(left(o, greatest(length(o) - 1, 0))) AS repaired_sha256
FROM z LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM z.conv_id WHERE best = 1"""
