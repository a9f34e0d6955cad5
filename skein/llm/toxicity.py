"""Operator 10: toxicity of texts behind a noisy channel.

A character trigram model is counted over all texts. Stretches that look disguised (digits or signs within words,
letters set apart, letters repeated) become character lattices: each sign stands for the letters it is used for, a
separator is dropped or parts two words, a repeated letter may be dropped. Viterbi decoding under the character model restores them. The
restored text is scored by word and word-beginning statistics learned from labelled rows.

Learning uses at most FIT_ROWS labelled rows whose crc32(doc_id as text) mod 5 is not 0, chosen by a hash of the id;
labels, lang, source and doc_id are never inputs of a score. Everything else covers all rows.

Defined results: null and empty texts get the score of a text without evidence; rows without a label are scored like
others; a null doc_id has held_out null; repeated rows give a row each; several labels of one id count as their
largest; without labels of both kinds the score is the share of toxic labels (0.0 without any); an empty table gives
an empty one; other columns are not looked at. Texts and disguised stretches are decoded whole, in linear time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import arrow_map, doc_texts, small_batches

#: Bound of the learning sample, and toxic rows of it that a feature must stand in; both bound the table of weights.
#: A feature counts if it is at least e times as frequent in toxic rows.
FIT_ROWS, MIN_SUPPORT = 16_000, 4
PREFIXES = (3, 4, 5, 6, 7)
#: Letters that signs are used for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
ALPHABET = "abcdefghijklmnopqrstuvwxyzàâäçéèêëíîïñóôöúùûüßáœ"
SIZE = len(ALPHABET) + 2  # 0: outside words, last: letters not listed
CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}
#: Words that mix letters with signs, at any place; letters set apart; words with a letter three times in a row. Of any length.
SIGNED = re.compile(r"(?<!\S)(?=[^\s0-9@$!|+(€£]*[0-9@$!|+(€£])(?=(?:[^\w\s]|[\d_])*[^\W\d_])\S+")
APART = re.compile(r"(?<!\w)(?:[\w@$!|][ .\-_*]){3,}[\w@$!|](?!\w)|(?<!\w)\w{1,3}(?:[.\-_*]\w{1,2}){2,}(?!\w)")
REPEATED = re.compile(r"(?<![^\W_])[^\W_]*?([^\W\d_])\1\1[^\W_]*")
#: Characters of a stretch that is kept in the cache; longer ones are decoded each time.
MOST = 48
OPENING, CLOSING = "(", "!"  # signs that also stand about words as they are
STRIP = ".,;:!?*#$%&|\"'()[]{}<>«»„“”-_=+/"
EDGES = "".join(c for c in STRIP if c not in "$!|+(")  # what no reading is lost by cutting off
DROP, SWAP = math.log(0.25), math.log(0.5)

_TABLE = np.full(0x180, SIZE - 1, np.int64)
_TABLE[:128] = 0
for _c, _i in CODE.items():
    if ord(_c) < 0x180:
        _TABLE[ord(_c)] = _i


def trigrams(texts: DataFrame) -> np.ndarray:
    """Counts of character trigrams in lower case over all texts, as a cube of fixed size."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros(SIZE**3, np.int64)
        for b in batches:
            for text in b["text"]:
                points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), "<u4")
                c = _TABLE[np.minimum(points, 0x17F)]
                if len(c) > 2:
                    total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3) if len(c) > 5000 else 0
                    if len(c) <= 5000:
                        np.add.at(total, (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], 1)
        at = np.flatnonzero(total)
        yield {"cell": at, "n": total[at]}

    schema = T.StructType([T.StructField("cell", T.LongType()), T.StructField("n", T.LongType())])
    got = arrow_map(texts.select("text"), rows, schema).groupBy("cell").agg(F.sum("n").alias("n")).limit(SIZE**3).toPandas()
    cube = np.zeros(SIZE**3)
    cube[got["cell"].to_numpy()] = got["n"].to_numpy()
    return cube.reshape(SIZE, SIZE, SIZE)


def language_model(cube: np.ndarray) -> np.ndarray:
    """Log probabilities of a character after two others, backing off to shorter contexts."""
    one = (cube.sum((0, 1)) + 1) / (cube.sum() + SIZE)
    two = (cube.sum(0) + 5 * one) / (cube.sum((0, 2))[:, None] + 5)
    three = (cube + 5 * two[None]) / (cube.sum(2)[:, :, None] + 5)
    return np.log(three).astype(np.float32)


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each character its readings with log weights; an empty reading drops it, a blank parts two words."""
    out, before, span = [], "", span.lower()
    first, end = len(span) - len(span.lstrip(OPENING)), len(span.rstrip(CLOSING))
    for i, c in enumerate(span):
        readings = [(x, SWAP) for x in LEET.get(c, "")] if c in LEET else []
        if c.isalpha():
            readings.append((c, 0.0))
        elif not first <= i < end:
            readings.append(("", 1.0))  # as punctuation about a word it costs nothing to drop
        elif not readings or c in " .-_*!|+(":
            readings.append(("", DROP if readings else 0.0))
        if c in " .-_*":
            readings.append((" ", -1.0))  # as dear as dropping it: the character model tells
        if c == before:
            readings.append(("", DROP))
        out.append(readings)
        before = c
    return out


def decode(span: str, lm: np.ndarray) -> str:
    """The best reading of the lattice: Viterbi over the last two characters, in time linear in the span."""
    beams: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for readings in lattice(span):
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in beams.items():
            for c, weight in readings:
                if c:
                    k = 0 if c == " " else CODE.get(c, SIZE - 1)
                    state, s, t = (b, k), score + weight + float(lm[a, b, k]), (path, c)
                else:
                    state, s, t = (a, b), score + weight - 1.0, path
                if state not in new or s > new[state][0]:
                    new[state] = (s, t)
        beams = new
    path = max(((s + float(lm[a, b, 0]), t) for (a, b), (s, t) in beams.items()), key=lambda x: x[0], default=(0.0, ()))[1]
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


def restore(text: str, lm: np.ndarray, cache: dict) -> str:
    """The text in lower case with its disguised stretches decoded; plain stretches stay."""

    def read(m: re.Match) -> str:
        span = m[0]
        core = span.strip(EDGES)
        if len(core) < 2 or not any(c.isalpha() for c in core):
            return span
        found = cache.get(core)
        if found is None:
            found = decode(core, lm)
            if len(core) <= MOST:
                if len(cache) > 100_000:
                    cache.clear()
                cache[core] = found
        return span.replace(core, found or core, 1)

    text = APART.sub(read, text.lower())
    text = SIGNED.sub(read, text)
    return REPEATED.sub(read, text)


def words_of(text: str) -> set[str]:
    return {w.strip(STRIP) for w in set(text.split())} - {""}


def features(word: str) -> list[str]:
    return [word, *[f"{word[:k]}~" for k in PREFIXES if len(word) >= k]]


EVIDENCE = 6


def evidence(words: set[str], weights: dict[str, float], cache: dict) -> list[float]:
    """What a text's words tell: the three largest weights, the sum of the positive ones, their number and share."""
    strong = []
    for w in words:
        g = cache.get(w)
        if g is None:
            if len(cache) > 300_000:
                cache.clear()
            cache[w] = g = max((weights[f] for f in features(w) if f in weights), default=0.0)
        if g > 0:
            strong.append(g)
    top = sorted(strong, reverse=True)[:3] + [0.0] * 3
    return [top[0], top[1], top[2], math.log1p(sum(strong)), math.log1p(len(strong)), 10 * len(strong) / (20 + len(words))]


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 2000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights with the bias last, and the means and scales of the columns."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= 0.5 * (z.T @ (p - y) / len(y) + 1e-3 * np.append(w[:-1], 0) / len(y) ** 0.5)
    return w, mean, scale


class Model:
    """Character model, word weights and the final regression; small enough to be sent to every task."""

    def __init__(self, lm: np.ndarray, weights: dict[str, float], final, prior: float):
        self.lm, self.weights, self.final, self.prior = lm, weights, final, prior

    def scores(self, texts: list[str], caches: tuple[dict, dict]) -> list[float]:
        if self.final is None:
            return [self.prior] * len(texts)
        w, mean, scale = self.final
        x = np.array([evidence(words_of(restore(t, self.lm, caches[0])), self.weights, caches[1]) for t in texts]).reshape(-1, EVIDENCE)
        return (1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -30, 30)))).tolist()


def fit(texts: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Weights from one half of the sample, the final regression from the other."""
    lm = language_model(trigrams(texts))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # at most `rows` ids: a bounded broadcast
    sample = known.where(~held).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = texts.join(F.broadcast(sample), "doc_id").select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))).cast("int").alias("half"))

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        seen, cache = (Counter(), Counter()), {}
        for b in batches:
            for text, toxic, half in zip(b["text"], b["toxic"], b["half"], strict=True):
                if half == 0:
                    own = {f for w in words_of(restore(text, lm, cache)) for f in features(w)}
                    seen[toxic].update(own)
                    seen[toxic][""] += 1
        names = [f for f, n in seen[1].items()]
        rest = [f for f in seen[0] if f not in seen[1]]
        for at in range(0, len(names) + len(rest), 20_000):
            some = (names + rest)[at : at + 20_000]
            yield {"feature": some, "t": [seen[1][f] for f in some], "c": [seen[0][f] for f in some]}

    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("t", T.LongType()), T.StructField("c", T.LongType())])
    sums = arrow_map(chosen, count, schema).groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    sums = sums.where((F.col("t") >= MIN_SUPPORT) | (F.col("feature") == "")).persist(StorageLevel.MEMORY_AND_DISK)
    rows_ = sums.where("feature = ''").first()  # the empty feature counts rows
    nt, nc = (rows_["t"], rows_["c"]) if rows_ else (0, 0)
    prior = nt / (nt + nc) if nt + nc else 0.0
    if not nt or not nc:
        return Model(lm, {}, None, float(prior))
    odds = F.log((F.col("t") + 0.1) / (nt + 0.2)) - F.log((F.col("c") + 0.5) / (nc + 1.0))
    weights = {r["feature"]: min(r["odds"], 6.0) for r in sums.where("feature <> ''").select("feature", odds.alias("odds")).where("odds > 1.0").orderBy("feature").collect()}
    sums.unpersist()

    def tell(batches: Iterator[dict]) -> Iterator[dict]:
        a, e = {}, {}
        for b in batches:
            use = [i for i, h in enumerate(b["half"]) if h == 1]
            yield {"x": [evidence(words_of(restore(b["text"][i], lm, a)), weights, e) for i in use], "y": [b["toxic"][i] for i in use]}

    found = arrow_map(chosen, tell, T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("y", T.IntegerType())])).limit(rows).collect()
    y = np.array([r["y"] for r in found])
    if not len(y) or y.min() == y.max():
        return Model(lm, weights, None, float(prior))
    return Model(lm, weights, logistic(np.array([r["x"] for r in found]), y), float(prior))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every text."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    texts = doc_texts(docs)
    model = spark.sparkContext.broadcast(fit(texts, labels))

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        caches: tuple[dict, dict] = ({}, {})
        for b in batches:
            yield {"doc_id": b["doc_id"], "score": model.value.scores(b["text"], caches)}

    scored = arrow_map(texts, rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())]))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


