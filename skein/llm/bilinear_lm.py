"""Operator 9: log-bilinear language model by noise-contrastive estimation, and the base unigram score.

Words are counted by fragments of the hash range over all training texts. The model is log-bilinear on two levels:
1. The most frequent words are classes of their own, all others fall into classes by their ending. A class is predicted
   from the classes of the two words before it: the context vector is the sum of position-weighted class vectors. One
   batched matrix product normalises it over all contexts.
2. Within the ending classes every word that stands MIN_COUNT times or more in training has an output vector and a bias
   of its own, fitted to all its contexts in training; the rarer ones share what their counts give, with one place for
   unseen words. This vocabulary grows with the input. Its vectors live in the fragments and go to the blocks of texts
   that need them, never to the driver; the normalising sums, a table of fixed size, go to every task.
Both levels are fitted by the noise-contrastive objective in full: the expected noise of the unigram distribution (level
2: of the class's) stands in for drawn samples, so a fit can be repeated. A token's probability is the product.

Defined results: a null or empty text is the end token alone; rows with a null doc_id are held out of training, with
held_out null; repeated rows count as often as they stand; without training rows counts are 0 and classes uniform;
an empty table gives an empty one; other columns are not looked at. Long texts are whole: a text is never cut over blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import FILE_BLOCKS, arrow_map, ascii_lower, doc_texts, packed_batches, plain_words, staged
from skein.llm.exchange import blocks, fragment_of, fragments, hashes

TOP, ENDINGS = 80, 32
#: Classes: the end, the frequent words, the endings; as a context also "before the text".
CLASSES = 1 + TOP + ENDINGS
START = CLASSES
CONTEXT, DIMENSION, NOISE, STEPS = 2, 16, 10, 300
#: Training occurrences from which a word has a vector of its own, its dimension, Newton steps, ridge, words of one step.
MIN_COUNT, OWN_DIMENSION, OWN_STEPS, RIDGE, OWN_BATCH = 50, 8, 8, 1.0, 2048
TOP_CANDIDATES = 400
_L, _B, _I, _D = T.LongType(), T.BinaryType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


class Endings(dict):
    """The class by ending of a word: its last two letters or other characters, hashed."""

    def __missing__(self, end: str) -> int:
        self[end] = k = zlib.crc32(end.encode("utf-8", "surrogatepass")) % ENDINGS if len(self) < 100_000 else zlib.crc32(end.encode("utf-8", "surrogatepass")) % ENDINGS
        return k


ENDING = Endings()


def _tokens(text: str) -> tuple[np.ndarray, np.ndarray]:
    words = plain_words(ascii_lower(text))
    return hashes(words), np.array([ENDING[w.rstrip(".,!#$%&*")[-2:]] for w in words], np.uint8)


def held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 1


BLOCK = _struct(block=_L, docs=_B, nulls=_B, lens=_B, places=_B, words=_B, endings=_B)


def packed(texts: DataFrame) -> DataFrame:
    """Blocks of documents: which distinct word stands at each place."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        pack = lambda t: (lambda h, e: np.stack([h, e.astype(np.uint64)], 1))(*_tokens(t))
        for block, ids, found in blocks(batches, pack):
            every = np.concatenate([np.empty((0, 2), np.uint64), *found])
            words, at, places = np.unique(every[:, 0], return_index=True, return_inverse=True)
            yield {
                "block": [block], "docs": [np.array([i or 0 for i in ids], "<i8").tobytes()], "nulls": [np.array([i is None for i in ids]).tobytes()],
                "lens": [np.array([len(f) for f in found], "<u4").tobytes()], "places": [places.astype("<u4").tobytes()],
                "words": [words.tobytes()], "endings": [every[at, 1].astype(np.uint8).tobytes()],
            }

    return arrow_map(texts, rows, BLOCK)


def _open(b: dict, i: int) -> tuple[np.ndarray, ...]:
    kinds = {"docs": "<i8", "nulls": "?", "lens": "<u4", "places": "<u4", "words": "<u8", "endings": "u1"}
    return tuple(np.frombuffer(b[k][i], t) for k, t in kinds.items())


def _training(docs: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    return np.array([not n and not held_out(d) for d, n in zip(docs.tolist(), nulls.tolist(), strict=True)], bool)


COUNTED = _struct(block=_L, frag=_I, counts=_B, endings=_B, words=_B, n=_L, types=_L, top=_B)


def counted(store: DataFrame) -> DataFrame:
    """Per block and fragment the training counts of its words, in the order of the block's words; per fragment, in one
    row of its own (block null), totals by ending and the most frequent words."""
    count = fragments(store.sparkSession)
    cut = _struct(frag=_I, block=_L, words=_B, endings=_B, own=_B)

    def split(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for i, block in enumerate(b["block"]):
                docs, nulls, lens, places, words, endings = _open(b, i)
                mine = np.bincount(places[np.repeat(_training(docs, nulls), lens)], minlength=len(words)).astype("<u4")
                ends = np.searchsorted(fragment_of(words, count), np.arange(count + 1))  # words are sorted, so are fragments
                use = [f for f in range(count) if ends[f] < ends[f + 1]]
                part = lambda a: [a[ends[f] : ends[f + 1]].tobytes() for f in use]  # noqa: E731, B023
                yield {"frag": use, "block": [block] * len(use), "words": part(words), "endings": part(endings), "own": part(mine)}

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, "<u8") for x in pdf["words"]]
        words, at, back = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        counts = np.bincount(back, np.concatenate([np.frombuffer(x, "<u4") for x in pdf["own"]]), len(words)).astype("<i8")
        endings = np.concatenate([np.frombuffer(x, "u1") for x in pdf["endings"]])[at]
        n = np.bincount(endings, counts, ENDINGS).astype(np.int64)
        types = np.bincount(endings[counts > 0], minlength=ENDINGS).astype(np.int64)
        best = np.lexsort((words, -counts))[:TOP_CANDIDATES]
        top = np.stack([words[best].astype("<u8").view("<i8"), counts[best], endings[best].astype("<i8")], 1)
        replies = [x.tobytes() for x in np.split(counts[back], np.cumsum([len(p) for p in parts])[:-1])]
        own = pd.DataFrame({"block": pdf["block"].astype("Int64"), "frag": pdf["frag"].astype("Int32"), "counts": replies})
        sums = pd.DataFrame({"block": pd.array([pd.NA], "Int64"), "frag": pd.array([pdf["frag"].iloc[0]], "Int32"), "counts": [np.stack([n, types], 1).tobytes()], "top": [top.tobytes()]})
        return pd.concat([own, sums]).reindex(columns=COUNTED.names).astype({"n": "Int64", "types": "Int64"})

    return arrow_map(store.select("block", "docs", "nulls", "lens", "places", "words", "endings"), split, cut).groupBy("frag").applyInPandas(total, COUNTED)


class Classes:
    """Which class a word has, and what of its class each word gets."""

    def __init__(self, sums: list[tuple[bytes, bytes]], n_docs: int):
        total = np.sum([np.frombuffer(s, "<i8").reshape(-1, 2) for s, _ in sums], axis=0) if sums else np.zeros((ENDINGS, 2), np.int64)
        every = np.concatenate([np.empty((0, 3), np.int64), *[np.frombuffer(t, "<i8").reshape(-1, 3) for _, t in sums]])
        every = every[np.lexsort((every[:, 0], -every[:, 1]))][:TOP]
        every = every[every[:, 1] > 0]
        order = np.argsort(every[:, 0].view(np.uint64), kind="stable")
        self.words, self.rank = every[order, 0].view(np.uint64), order
        self.tokens, self.types = int(total[:, 0].sum()) + n_docs, int(total[:, 1].sum()) + (n_docs > 0)
        self.n_docs = n_docs
        rest = total.copy()
        np.subtract.at(rest, every[:, 2], np.stack([every[:, 1], np.ones(len(every), np.int64)], 1))
        self.rest = rest

    def of(self, words: np.ndarray, endings: np.ndarray) -> np.ndarray:
        out = 1 + TOP + endings.astype(np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            top = self.words[at] == words
            out[top] = 1 + self.rank[at[top]]
        return out


def _sequence(classes: np.ndarray, lens: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens of a block with the end after each text; the contexts, the nearer word last."""
    n = int(lens.sum()) + len(lens)
    ends = np.cumsum(lens.astype(np.int64) + 1)
    seq = np.zeros(n, np.int64)
    words = np.ones(n, bool)
    words[ends - 1] = False
    seq[words] = classes[places]
    near, far = np.roll(seq, 1), np.roll(seq, 2)
    begin = ends - lens.astype(np.int64) - 1
    near[begin] = far[begin] = START
    second = (begin + 1)[lens > 0]
    far[second] = START
    return seq, far, near


def trigram_counts(store: DataFrame, classes: Classes) -> np.ndarray:
    """How often a class follows two others, over all training texts."""
    side = CLASSES + 1

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros(side * side * CLASSES, np.int64)
        for b in batches:
            for i in range(len(b["block"])):
                docs, nulls, lens, places, words, endings = _open(b, i)
                seq, far, near = _sequence(classes.of(words, endings), lens, places)
                use = np.repeat(_training(docs, nulls), lens.astype(np.int64) + 1)
                total += np.bincount(((far * side + near) * CLASSES + seq)[use], minlength=len(total))
        at = np.flatnonzero(total)
        yield {"cell": at, "n": total[at]}

    got = arrow_map(store, rows, _struct(cell=_L, n=_L)).groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(side * side * CLASSES)
    packed_ = got.select(F.col("cell"), F.col("n")).toArrow()  # at most (CLASSES + 1)^2 * CLASSES cells
    out[packed_.column("cell").to_numpy()] = packed_.column("n").to_numpy()
    return out.reshape(side * side, CLASSES)


def estimate(counts: np.ndarray, steps: int = STEPS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Normalised log10 probabilities (contexts x classes) of the log-bilinear model, and the class vectors as the nearer
    word sees them, in OWN_DIMENSION main directions.

    The noise-contrastive objective is taken in full: for every context and class, its count against NOISE times the
    noise distribution, so no noise is drawn and a fit can be repeated.
    """
    side = CLASSES + 1
    rng = np.random.default_rng(seed)
    used = np.flatnonzero(counts.sum(1))
    noise = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * CLASSES)
    far, near = np.divmod(np.arange(side * side), side)
    p = {"r": rng.normal(0, 0.1, (side, DIMENSION)), "c": np.ones((CONTEXT, DIMENSION)), "q": rng.normal(0, 0.1, (CLASSES, DIMENSION)), "b": np.log(noise)}
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    data = counts[used] / max(1.0, counts.sum())
    mass = data.sum(1, keepdims=True)
    for step in range(1, steps + 1 if len(used) else 1):
        rf, rn = p["r"][far[used]], p["r"][near[used]]
        predicted = rf * p["c"][0] + rn * p["c"][1]
        delta = predicted @ p["q"].T + p["b"] - np.log(NOISE * noise)
        true = 1 / (1 + np.exp(-np.clip(delta, -40, 40)))
        g = NOISE * noise * mass * true - data * (1 - true)  # of the negative objective, by the model's logit
        gp = g @ p["q"]
        grad = {"q": g.T @ predicted, "b": g.sum(0), "c": np.stack([(gp * rf).sum(0), (gp * rn).sum(0)]), "r": np.zeros_like(p["r"])}
        np.add.at(grad["r"], far[used], gp * p["c"][0])
        np.add.at(grad["r"], near[used], gp * p["c"][1])
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            p[k] = p[k] - 0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-9)
    logits = (p["r"][far] * p["c"][0] + p["r"][near] * p["c"][1]) @ p["q"].T + p["b"]
    logits -= logits.max(1, keepdims=True)
    u, size, _ = np.linalg.svd(p["r"] * p["c"][1], full_matrices=False)
    return ((logits - np.log(np.exp(logits).sum(1, keepdims=True))) / np.log(10)).astype(np.float32), u[:, :OWN_DIMENSION] * size[:OWN_DIMENSION]


class OwnWords:
    """What level 2 is fitted with: the context vectors, the words of each ending after each class, the words' shares."""

    def __init__(self, classes: Classes, trigrams: np.ndarray, near: np.ndarray):
        side = CLASSES + 1
        self.classes, self.near, self.least = classes, near, MIN_COUNT
        self.after = trigrams.reshape(side, side, CLASSES).sum(0)[:, 1 + TOP :].T  # ending x class before

    def mask(self, counts: np.ndarray, own: np.ndarray) -> np.ndarray:
        return (counts >= self.least) & (own > TOP)

    def share(self, ending: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A word's share of its ending, by counts; all words and the unseen place add up to one."""
        n, v = self.classes.rest[ending].T
        return (counts + 0.5) / (n + 0.5 * (v + 1))

    def fit(self, seen: np.ndarray, ending: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors (float16) and biases (float32): logistic regression of each word's contexts against its ending's, by
        Newton steps with a ridge about the unigram. seen: words x classes before."""
        x = np.hstack([self.near, np.ones((len(self.near), 1))])
        share = self.share(ending, counts)
        noise = NOISE * share[:, None] * self.after[ending]
        w = np.zeros((len(seen), OWN_DIMENSION + 1))
        w[:, -1] = np.log(share)
        start = w[:, -1].copy()
        ridge = np.full(OWN_DIMENSION + 1, RIDGE)
        for _ in range(OWN_STEPS):
            p = 1 / (1 + np.exp(-np.clip(w @ x.T - np.log(NOISE * share)[:, None], -40, 40)))
            g = (noise * p - seen * (1 - p)) @ x
            g += ridge * (w - np.hstack([np.zeros((len(w), OWN_DIMENSION)), start[:, None]]))
            h = np.einsum("wk,ki,kj->wij", (noise + seen) * p * (1 - p), x, x, optimize=True) + np.diag(ridge)
            w -= np.clip(np.linalg.solve(h, g[..., None])[..., 0], -2, 2)
        return w[:, :-1].astype(np.float16), w[:, -1].astype(np.float32)

    def logits(self, vectors: np.ndarray, biases: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Natural logs, not normalised, of words (rows of vectors) after classes (near, one for each row)."""
        return (vectors.astype(np.float64) * self.near[near]).sum(1) + biases


FITTED = _struct(block=_L, frag=_I, vectors=_B, biases=_B, sums=_B)


def fitted(store: DataFrame, replies: DataFrame, model) -> DataFrame:
    """Per block and fragment vectors and biases of the block's words that have their own, in the order of its words; per
    fragment, in one row of its own (block null), what the ending's sums after each class change by them."""
    count, side = fragments(store.sparkSession), CLASSES + 1
    cut = _struct(frag=_I, block=_L, words=_B, counts=_B, endings=_B, lens=_B, near=_B, n=_B)

    def split(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own: OwnWords = model.value
        docs, nulls, lens, places, words, endings = _open({k: left[k].tolist() for k in BLOCK.names}, 0)
        counts = _counts(right)
        kinds = own.classes.of(words, endings)
        mask = own.mask(counts, kinds)
        seq, _, near = _sequence(kinds, lens, places)
        word = _is_word(lens, len(seq))
        use = np.repeat(_training(docs, nulls), lens.astype(np.int64)) & mask[places]
        cell, n = np.unique(places[use].astype(np.int64) * side + near[word][use], return_counts=True)
        chosen = np.flatnonzero(mask)
        many = np.bincount(cell // side, minlength=len(words))[chosen].astype("<u4")
        ends = np.searchsorted(fragment_of(words[chosen], count), np.arange(count + 1))
        cells = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
        use_ = np.flatnonzero(np.diff(ends)).tolist()
        by = lambda a: [a[ends[f] : ends[f + 1]].tobytes() for f in use_]
        of = lambda a: [a[cells[ends[f]] : cells[ends[f + 1]]].tobytes() for f in use_]
        packed_ = {"words": by(words[chosen]), "counts": by(counts[chosen]), "endings": by(endings[chosen]), "lens": by(many), "near": of((cell % side).astype("u1")), "n": of(n.astype("<u4"))}
        return pd.DataFrame({"frag": np.array(use_, np.int32), "block": left["block"].iloc[0], **packed_})[cut.names]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        own: OwnWords = model.value
        join = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in pdf[c]])
        words, at, back = np.unique(join("words", "<u8"), return_index=True, return_inverse=True)
        counts, endings = join("counts", "<i8")[at], join("endings", "u1")[at].astype(np.int64)
        cuts = np.cumsum([len(x) // 8 for x in pdf["words"]])[:-1]
        seen = np.zeros((len(words), side))  # follows the fragment's words, however many blocks tell of them
        for own_rows, lens, near, n in zip(np.split(back, cuts), pdf["lens"], pdf["near"], pdf["n"], strict=True):
            seen[np.repeat(own_rows, np.frombuffer(lens, "<u4")), np.frombuffer(near, "u1")] += np.frombuffer(n, "<u4")  # a cell stands once in a block
        vectors, biases = np.empty((len(words), OWN_DIMENSION), np.float16), np.empty(len(words), np.float32)
        sums = np.zeros((ENDINGS, side))
        for lo in range(0, len(words), OWN_BATCH):
            hi = min(lo + OWN_BATCH, len(words))
            vectors[lo:hi], biases[lo:hi] = own.fit(seen[lo:hi], endings[lo:hi], counts[lo:hi])
            odds = np.exp(vectors[lo:hi].astype(float) @ own.near.T + biases[lo:hi, None]) - own.share(endings[lo:hi], counts[lo:hi])[:, None]
            np.add.at(sums, endings[lo:hi], odds)
        out = pd.DataFrame({"block": pdf["block"].astype("Int64"), "frag": pdf["frag"], "vectors": [vectors[i].tobytes() for i in np.split(back, cuts)], "biases": [biases[i].tobytes() for i in np.split(back, cuts)]})
        total = pd.DataFrame({"block": pd.array([pd.NA], "Int64"), "frag": [pdf["frag"].iloc[0]], "sums": [sums.tobytes()]})
        return pd.concat([out, total]).reindex(columns=FITTED.names).astype({"frag": "int32"})

    answers = replies.where("block IS NOT NULL").select("block", "frag", "counts")
    cuts = store.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(split, cut)
    return cuts.groupBy("frag").applyInPandas(fit, FITTED)


def norms(fits: DataFrame) -> np.ndarray:
    """Endings x classes before: natural logs of the sums that normalise level 2. Added up by cells before the driver sees them."""
    side = CLASSES + 1

    def cells(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            if b["sums"]:
                total = np.sum([np.frombuffer(x, float) for x in b["sums"]], axis=0)
                yield {"cell": list(range(len(total))), "x": total.tolist()}

    got = arrow_map(fits.where("block IS NULL").select("sums"), cells, _struct(cell=_L, x=_D)).groupBy("cell").agg(F.sum("x").alias("x")).toArrow()
    out = np.ones(ENDINGS * side)
    out[got.column("cell").to_numpy()] += got.column("x").to_numpy()
    return np.log(np.maximum(out, 1e-12)).reshape(ENDINGS, side)


def _counts(right: pd.DataFrame) -> np.ndarray:
    """Training counts of a block's words from the fragments' replies."""
    use = right[right["counts"].notna()].sort_values("frag")
    return np.concatenate([np.empty(0, np.int64), *[np.frombuffer(x, "<i8") for x in use["counts"]]])


def _is_word(lens: np.ndarray, n: int) -> np.ndarray:
    word = np.ones(n, bool)
    word[np.cumsum(lens.astype(np.int64) + 1) - 1] = False
    return word


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    packed_batches(spark)
    texts = doc_texts(docs)
    store = staged(packed(texts), "blocks", FILE_BLOCKS)
    replies = staged(counted(store), "counts")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    n_docs = texts.select("doc_id").where(F.col("doc_id").isNotNull() & ~held).count()
    sums = [(bytes(r["counts"]), bytes(r["top"])) for r in replies.where("block IS NULL").select("counts", "top").toLocalIterator()]  # a row for each fragment
    classes = Classes(sums, n_docs)
    trigrams = trigram_counts(store, classes)
    logs_, near_ = estimate(trigrams)
    own_words = OwnWords(classes, trigrams, near_)
    fits = staged(fitted(store, replies, spark.sparkContext.broadcast(own_words)), "vectors")
    table = spark.sparkContext.broadcast((own_words, logs_, norms(fits)))
    side = CLASSES + 1
    schema = _struct(doc_id=_L, held_out=T.BooleanType(), n_tokens=_L, n_known=_L, train_tokens=_L, base_score=_D, score=_D)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own_, logs, norm = table.value
        classes = own_.classes
        b = {k: left[k].tolist() for k in BLOCK.names}
        docs_, nulls, lens, places, words, endings = _open(b, 0)
        counts = _counts(right)
        fit = right[right["vectors"].notna()].sort_values("frag")
        vectors = np.concatenate([np.empty(0, np.float16), *[np.frombuffer(x, np.float16) for x in fit["vectors"]]]).reshape(-1, OWN_DIMENSION)
        biases = np.concatenate([np.empty(0, np.float32), *[np.frombuffer(x, np.float32) for x in fit["biases"]]])
        own = classes.of(words, endings)
        seq, far, near = _sequence(own, lens, places)
        begin = np.cumsum(lens.astype(np.int64) + 1) - lens.astype(np.int64) - 1
        word = _is_word(lens, len(seq))
        n, v = classes.tokens, classes.types
        base = np.full(len(seq), np.log10((classes.n_docs + 0.5) / (n + 0.5 * (v + 1))))
        base[word] = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))[places]
        known = np.full(len(seq), int(classes.n_docs > 0))
        known[word] = (counts > 0)[places]
        model = logs[far * side + near, seq].astype(float)
        within = np.zeros(len(words))  # natural logs
        rare = own > TOP
        within[rare] = np.log(own_.share(endings[rare].astype(np.int64), counts[rare]))
        inner, before = within[places], near[word]
        mask = own_.mask(counts, own)
        number = np.cumsum(mask) - 1
        at = np.flatnonzero(mask[places])
        for lo in range(0, len(at), 100_000):
            some = at[lo : lo + 100_000]
            use = number[places[some]]
            inner[some] = own_.logits(vectors[use], biases[use], before[some])
        under = rare[places]
        inner[under] -= norm[endings[places[under]], before[under]]
        model[word] += inner / np.log(10)
        add = lambda x: np.add.reduceat(x, begin) if len(begin) else x
        ids = pd.array(docs_, dtype="Int64")
        ids[nulls] = pd.NA
        out = pd.array([held_out(d) for d in docs_.tolist()], dtype="boolean")
        out[nulls] = pd.NA
        return pd.DataFrame({"doc_id": ids, "held_out": out, "n_tokens": lens.astype(np.int64) + 1, "n_known": add(known.astype(np.int64)), "train_tokens": n, "base_score": add(base), "score": add(model)})

    answers = replies.where("block IS NOT NULL").select("block", "frag", "counts", F.lit(None).cast("binary").alias("vectors"), F.lit(None).cast("binary").alias("biases"))
    answers = answers.unionByName(fits.where("block IS NOT NULL").select("block", "frag", F.lit(None).cast("binary").alias("counts"), "vectors", "biases"))
    return store.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, schema)
