"""Operator 12: SpotSigs fingerprints, by DataFrame functions only.

Common words are anchors. Behind an anchor stands a chain of the next CHAIN content words (anchors between them are passed
over); anchor and chain are a spot signature. Anchors in a row share their chain, so the last of them names it. Texts with
few common words (lists, other languages) need something to stand on as well: the first content word of a text and those of
a length divisible by OWN_LENGTH count as if an anchor stood before them. A fingerprint is the set of a text's signatures,
and two texts are as alike as the Jaccard similarity of their sets.

`digest` holds every document against its edited text and its neighbour. `classes` finds the near-duplicates of a corpus: sets
are dealt to partitions by their length, so that a set meets its own partition and the next one only; within them the
rarest signatures make lists, lengths and positions prune what is compared, and classes grow from hubs, not from all pairs.

Defined results: a null text is empty; a text without a word has an empty fingerprint, and two empty fingerprints are alike
(1) if both texts are empty of words, an empty one and another are not (0); documents in descending doc_id, rows without an
id last and rows of one id by a hash of their text; equal rows follow each other; an empty table gives an empty one; a
text of any length is taken whole, in time linear in it; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.llm import jaccard_join
from skein.llm.common import LOWER_ASCII, UPPER_ASCII, doc_texts, lower_column, staged

#: Content words of a chain, and hexadecimal digits of a signature's hash.
CHAIN, DIGITS = 2, 8
#: Content words of so many letters, or a multiple, need no anchor.
OWN_LENGTH = 7
#: Neighbours, on average, of a group; bits of the hash that group rows without an id.
GROUP_ROWS, LOST_BITS = 512, 9
#: Similarity of near-duplicates; more than there are length partitions for any percentage below 100.
PERCENT, PARTS = 80, 4096
#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his if in into is it its not of on or she so that the their them then there these they this to was we were what when which who will with would you "
    "au aux avec ce ces cette dans de des du elle elles en est et eux il ils je la le les leur lui mais ne nous ou où par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "aber als am auch auf aus bei bin bis das dass dem den der die doch durch ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht noch nur oder sich sie sind so über um und von vor war wie wir zu zum zur "
    "al como con del el ella ellos entre era esta este ha hay las lo los más me mi muy no o para pero por porque ser si sin sobre su sus también te tiene todo una uno y ya yo"
).split()
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _bound(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda variable holds it."""
    return F.transform(F.array(value), body)[0]


def spot_set(text: Column) -> Column:
    """The sorted distinct signatures of a text."""
    words = F.split(F.trim(F.regexp_replace(lower_column(text), _BETWEEN, " ")), " ")
    common = sorted(set(ANCHORS))

    def marked(w: Column) -> Column:
        """Content words, each after its anchor and a space where one stands before it."""
        before = lambda i: F.get(w, i - 1)
        named = F.transform(w, lambda x, i: F.when(x.isin(common) | (x == ""), F.lit(None)).when((i > 0) & before(i).isin(common), F.concat(before(i), F.lit(" "), x)).otherwise(x))
        return F.filter(named, lambda x: x.isNotNull())

    def chains(c: Column) -> Column:
        bare = lambda x: F.substring_index(x, " ", -1)
        rest = lambda i: F.concat_ws(" ", *[bare(F.get(c, i + k)) for k in range(1, CHAIN)])
        hashed = lambda x, i: F.substring(F.md5(F.concat(x, F.lit(" "), rest(i)).cast("binary")), 1, DIGITS)
        found = F.transform(c, lambda x, i: F.when((i == 0) | F.contains(x, F.lit(" ")) | (F.char_length(x) % OWN_LENGTH == 0), hashed(x, i)))
        return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))

    return _bound(_bound(words, marked), chains)


def as_ints(signatures: Column) -> Column:
    """The signatures as 32-bit integers, one for each hexadecimal form: a quarter of the strings' memory."""
    return F.transform(signatures, lambda x: (F.conv(x, 16, 10).cast("long") - (1 << 31)).cast("int"))


def fingerprint(signatures: Column) -> Column:
    return F.array_join(signatures, ",")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; sets whose lengths alone rule `least` out are not compared and give 0."""
    na, nb = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b))
    compared = _bound(common, lambda k: k / (na + nb - k))
    near = F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0)
    return (near.when(F.least(na, nb) < F.greatest(na, nb) * least, 0.0) if least else near).otherwise(compared)


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text, the hashes g1 and g2 that order rows of one id, and the group (lost, b) of some GROUP_ROWS neighbours.

    Groups follow each other: by lost, then b downwards. Ids are cut evenly, as densely as nine tenths of them lie; rows
    without an id are cut by their hash."""
    own = doc_texts(docs).withColumns({"g1": F.xxhash64("doc_id", "text"), "g2": F.xxhash64("text", "doc_id", F.lit(1))})
    seen = docs.agg(F.count("doc_id").alias("n"), F.percentile_approx(docs["doc_id"].cast("long"), [0.05, 0.95]).alias("ends")).first()
    width = max(1, GROUP_ROWS * (seen["ends"][1] - seen["ends"][0]) * 10 // (9 * seen["n"])) if seen["n"] else 1
    lost = F.col("doc_id").isNull()
    b = F.when(lost, -F.shiftright("g1", 64 - LOST_BITS)).otherwise(F.expr(f"doc_id div {width}L"))
    return own.withColumns({"lost": lost.cast("int"), "b": F.coalesce(b, F.lit(0))})  # never null, so that joins add no filter and the exchange serves twice


def _followers(groups: DataFrame) -> DataFrame:
    """lost, b of every group, and nl, nb of the one after it (of the first behind the last). Groups are sorted by ranges;
    only the ends of the ranges, as many as shuffle partitions, meet in one place."""
    order = ["lost", F.col("b").desc()]
    placed = staged(groups.distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id()), "groups")
    ranges = placed.groupBy(F.shiftright("m", 33).alias("part")).agg(F.min("m").alias("head"), F.max("m").alias("tail"))
    around = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = ranges.select("tail", F.coalesce(F.lead("head").over(W.orderBy("part")), F.first("head").over(around)).alias("after"))
    before = placed.join(F.broadcast(ends), F.col("m") == F.col("tail"), "left").select("lost", "b", F.coalesce("after", F.col("m") + 1).alias("m"))
    return before.join(placed.select("m", F.col("lost").alias("nl"), F.col("b").alias("nb")), "m").drop("m")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures of every row.

    Texts are shuffled once, by group: a row's next one stands in the same group, or is the head of the group after it."""
    own = _grouped(docs)
    order = [F.col("doc_id").desc(), "g1", "g2"]
    inside = W.partitionBy("lost", "b").orderBy(*order)
    heads = own.withColumn("before", F.lag("g1").over(inside)).where("before IS NULL").select(F.col("lost").alias("nl"), F.col("b").alias("nb"), F.col("text").alias("head"))
    heads = heads.join(_followers(own.select("lost", "b")), ["nl", "nb"]).select("lost", "b", "head", spot_set(F.col("head")).alias("head_spots"))
    seen = own.withColumn("next", F.lead("text").over(inside)).withColumn("spots", spot_set(F.col("text")))
    seen = seen.withColumn("next_spots", F.lead("spots").over(inside)).join(heads, ["lost", "b"], "left")
    own_part = F.expr("substring(text, 1, char_length(text) - char_length(text) div 3)")
    edited = seen.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), "spots", F.coalesce("next_spots", "head_spots").alias("next_spots"),
        F.concat(own_part, F.expr("substring(coalesce(next, head), 1, char_length(text) div 3)")).alias("edited"),
    )
    told = edited.withColumn("edited_spots", spot_set(F.col("edited")))
    return told.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("spots")).alias("fingerprint"), fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"), likeness(F.col("spots"), F.col("next_spots")).alias("near_next"), F.size("spots").cast("long").alias("n_signatures"),
    )


def spot_lists(sets: DataFrame, percent: int) -> DataFrame:
    """gram, doc_id, n, pos, own: a set's signatures that others have, too, within its prefix in the order of rareness, each in the
    lists of the length partitions in which the set can meet a similar one; own: its signatures that no other set has.

    Partition bounds grow by the factor that a similar set may be longer. A list holds a partition and the next one, so two
    sets of similar length share one. sets: doc_id, n, spots (as integers)."""
    each = sets.select("doc_id", "n", F.explode("spots").alias("spot"))
    known = each.groupBy("spot").agg(F.count("*").alias("c")).where("c > 1")
    ranked = each.join(known, "spot").withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy("c", "spot")))
    counted = ranked.withColumn("own", (F.col("n") - F.count("*").over(W.partitionBy("doc_id"))).cast("int")).withColumn("pos", (F.col("own") + F.col("r")).cast("int"))
    kept = counted.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1)
    part = F.floor(F.log("n") / math.log(100 / percent) + 1e-9).cast("long")
    return kept.select(F.explode(F.array(part, part - 1)).alias("p"), "spot", "doc_id", "n", "pos", "own").select((F.col("spot").cast("long") * PARTS + F.col("p") + 1).alias("gram"), "doc_id", "n", "pos", "own")


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets whose Jaccard similarity reaches the percentage; lengths rule most others out uncompared."""
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("spots").alias("sa")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("spots").alias("sb")), "b")
    both = both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).withColumn("k", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("k") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("k"))).select("a", "b")


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_signatures, component_id of every row: the smallest doc_id that is reached by links between documents whose
    signatures have a Jaccard similarity of percent / 100 or more. A text without a signature is linked with nothing; rows
    without an id take the class of their text's set, null if no row of the class has an id."""
    found = doc_texts(docs).select("doc_id", as_ints(spot_set(F.col("text"))).alias("spots"))
    key = ["n", "id1", "id2"]  # the set's size and 128 bits of it: rows meet their set by these, not by whole sets
    keyed = lambda df: df.withColumns({"n": F.size("spots"), "id1": F.xxhash64("spots"), "id2": F.xxhash64(F.lit(1), "spots")})
    rows = staged(keyed(found), "spots")
    own = rows.where("n > 0").groupBy("spots").agg(F.min("doc_id").alias("least"))
    own = staged(keyed(own.select(F.monotonically_increasing_id().alias("doc_id"), "spots", "least")), "sets")
    comps = jaccard_join.link_classes(own.select("doc_id", "n", "spots"), percent, spot_lists, alike)
    members = own.select("doc_id", "least", *key).join(comps, "doc_id")
    ids = members.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = members.join(ids, "comp").select(*key, F.col("component_id").alias("c"))
    return rows.select("doc_id", *key).join(known, key, "left").select("doc_id", F.col("n").cast("long").alias("n_signatures"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("c")).alias("component_id"))


_COMMON = "[" + ", ".join(f"'{a}'" for a in sorted(set(ANCHORS))) + "]"


def _spots_sql(text: str) -> str:
    words = f"string_split(trim(regexp_replace(translate({text}, '{UPPER_ASCII}', '{LOWER_ASCII}'), '{_BETWEEN}', ' ', 'g')), ' ')"
    marked = f"list_filter(list_transform(w, lambda x, i: CASE WHEN list_contains({_COMMON}, x) OR x = '' THEN NULL WHEN i > 1 AND list_contains({_COMMON}, w[i - 1]) THEN w[i - 1] || ' ' || x ELSE x END), lambda x: x IS NOT NULL)"
    chains = f"list_sort(list_distinct(list_filter(list_transform(c, lambda x, i: CASE WHEN i = 1 OR contains(x, ' ') OR length(x) % {OWN_LENGTH} = 0 THEN left(md5(x || ' ' || coalesce(string_split(c[i + 1], ' ')[-1], '')), {DIGITS}) END), lambda x: x IS NOT NULL)))"
    return f"(SELECT {chains} FROM (SELECT {marked} AS c FROM (SELECT {words} AS w)))"


def _near_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / CAST(len({a}) + len({b}) - len(list_intersect({a}, {b})) AS DOUBLE) END"


#: Whole, for CHAIN = 2.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC NULLS LAST, t), first_value(t) OVER (ORDER BY doc_id DESC NULLS LAST, t)) AS after FROM d),
e AS (SELECT doc_id, t, after, left(t, length(t) - length(t) // 3) || left(after, length(t) // 3) AS edited FROM o),
s AS (SELECT doc_id, length(t) AS n, edited, {_spots_sql("t")} AS a, {_spots_sql("edited")} AS b, {_spots_sql("after")} AS c FROM e)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, ',') AS fingerprint, array_to_string(b, ',') AS edited_fingerprint, {_near_sql("a", "b")} AS near_edited, {_near_sql("a", "c")} AS near_next, len(a) AS n_signatures FROM s"""

#: Whole: links over all pairs that share a signature, and smallest reachable ids.
CLASSES_ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_spots_sql("coalesce(text, '')")} AS a FROM documents),
s AS (SELECT doc_id, unnest(a) AS g FROM d),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT common.a, common.b FROM common JOIN d p ON p.doc_id = common.a JOIN d q ON q.doc_id = common.b WHERE 100 * k >= {PERCENT} * (len(p.a) + len(q.a) - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
walk AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT edge.b, walk.c FROM walk JOIN edge ON edge.a = walk.doc_id WHERE walk.c < edge.b)
SELECT d.doc_id, len(d.a) AS n_signatures, m.c AS component_id FROM d JOIN (SELECT doc_id, min(c) AS c FROM walk GROUP BY doc_id) m USING (doc_id)"""
