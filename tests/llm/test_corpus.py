"""Operators that gather from the whole corpus, against brute-force versions."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skein.llm import bilinear_lm, decontaminate, jaccard_join, toxicity
from tests.llm.test_digests import EDGE, SCHEMA, SF

LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text.translate(LOWER))


def brute_classes(texts, width, percent):
    sets = {}
    for d, t in texts.items():
        w = words(t)
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    up = {d: d for d in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    ra, rb = root(a), root(b)
                    up[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in ids}


def test_jaccard_equals_brute_force(docs, texts):
    assert {r[0]: (r[1], r[2]) for r in jaccard_join.classes(docs).collect()} == brute_classes(texts, 4, 85)


def test_jaccard_of_chains_and_shared_passages(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, passage = [], " ".join(vocabulary[:60])
    for g in range(12):  # groups whose copies drift: neighbours link, ends do not
        own = rng.choice(vocabulary, 120).tolist()
        for k in range(14):
            rows.append((len(rows), " ".join(own)))
            for at in rng.choice(120, 1 + g % 4):
                own[at] = f"n{len(rows)}x{k}"
    for k in range(60):  # many share a passage and little else
        rows.append((len(rows), passage + " " + " ".join(rng.choice(vocabulary, 6 + k % 8).tolist())))
    got = jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == brute_classes(dict(rows), 4, 85)


def test_jaccard_edges(spark):
    df = spark.createDataFrame(EDGE, SCHEMA).selectExpr("*", "1 as n", "2 as comp", "3 as label")
    got = sorted([tuple(r) for r in jaccard_join.classes(df).collect()], key=str)
    assert [(1, 0, 1), (2, 0, 2), (4, 1, 4), (4, 1, 4), (5, 1, 5)] == [g for g in got if g[0] in (1, 2, 4, 5)] and (None, 3, None) in got
    assert jaccard_join.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_simhash_counts_bits():
    h = np.random.default_rng(0).integers(0, 2**63, 300).astype(np.uint64)
    for size in (1, 7, 40, 250):
        got = decontaminate.fingerprints(decontaminate.running(h), np.arange(0, 300 - size + 1, 3), size)
        for s, f in zip(range(0, 300 - size + 1, 3), got.tolist(), strict=True):
            assert f == sum(1 << b for b in range(64) if sum(int(x) >> b & 1 for x in h[s : s + size]) > size // 2)


def test_blocks_lose_nothing_within_the_radius():
    rng = np.random.default_rng(1)
    index = decontaminate.Index([(1, " ".join(f"a{i}" for i in range(30)))])
    ((prints, _, _, tables, _, _),) = index.classes.values()
    for _ in range(3000):
        f = int(prints[0])
        for b in rng.choice(64, rng.integers(0, decontaminate.RADIUS + 1), replace=False):
            f ^= 1 << int(b)
        assert any(tables[b][f >> 16 * b & 0xFFFF] for b in range(4))


def test_decontamination_finds_verbatim_passages(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: decontaminate.words_of(r["text"]) for r in bench.collect()}
    own = {d: " " + " ".join(decontaminate.words_of(t)) + " " for d, t in texts.items()}
    verbatim = {(d, i) for d, t in own.items() for i, w in items.items() if f" {' '.join(w)} " in t}
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.digest(docs, bench).collect()}
    assert verbatim and verbatim <= set(got) and all(got[k] == 1.0 for k in verbatim)
    for d, i in got:  # what else is found shares most of the item's shingles
        w = items[i]
        assert sum(f" {' '.join(w[k : k + 5])} " in own[d] for k in range(len(w) - 4)) >= 0.7 * (len(w) - 4)
    kept = {r["doc_id"] for r in decontaminate.cleaned(docs, bench).collect()}
    assert kept == set(texts) - {d for d, _ in got}


def test_decontamination_edges(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six"
    w = item.split()
    near = " ".join([*w[:14], "changed", *w[15:]])
    far = " ".join(x if i % 4 else "other" for i, x in enumerate(w))
    rows = [(1, "x y z " + item + " end"), (2, item), (3, near), (4, far), (5, None), (6, ""), (7, "*** ".join(w).upper()), (None, item), (8, " ".join(["pad"] * 5000) + " " + item), (2, item)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as row", "3 as similarity")
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (None, "qq ww ee")], "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = [(r["doc_id"], r["item_id"], r["start_word"]) for r in decontaminate.digest(df, bench).collect()]
    assert sorted(got, key=str) == sorted([(1, 10, 3), (2, 10, 0), (2, 10, 0), (3, 10, 0), (7, 10, 0), (None, 10, 0), (8, 10, 5000)], key=str)
    assert decontaminate.digest(df, bench.limit(0)).count() == 0 and decontaminate.digest(df.limit(0), bench).count() == 0
    assert sorted(r["doc_id"] for r in decontaminate.cleaned(df, bench).collect()) == [4, 5, 6]


def brute_leak(index, item, h):
    """The best similarity over all windows of the item's size."""
    n = len(index.hashes[item])
    return max((index.similarity(item, h[a : a + n]) for a in range(len(h))), default=0.0)


def test_decontamination_indexes_the_whole_of_long_items():
    rng = np.random.default_rng(11)
    for n in (300, 1000):
        for k in range(10):
            item = [f"i{n}x{k}x{x}" for x in rng.permutation(n)]
            pad, gone = [f"p{x}" for x in range(40)], n * 16 // 100
            texts = [[*pad, *item[gone:], *pad], [*pad, *[f"q{x}" for x in range(gone)], *item[gone:], *pad], [*pad, *item[: n - gone]]]
            got = decontaminate.Index([(7, " ".join(item))]).leaks([" ".join(t) for t in texts], 0.8)
            assert all(g and g[0][0] >= 0.8 for g in got), (n, k, got)
            assert got[1][0][1] in range(40, 41 + gone) and got[2][0][1] == 40


def test_decontamination_recall_equals_brute_force():
    rng = np.random.default_rng(12)
    items, texts = [], []
    common = [f"c{x}" for x in range(12)]
    for n in (1, 3, 4, 5, 9, 30, 30, 59, 100, 200):
        items.append([*common, *[f"i{len(items)}x{x}" for x in range(n - 12)]] if n > 12 else [f"i{len(items)}x{x % 3}" for x in range(n)])
    for item in items:
        n, pad = len(item), [f"p{x}" for x in rng.integers(0, 99, 7)]
        for cut in {n // 20, n // 10, n * 15 // 100, n * 19 // 100, n // 4}:
            texts += [item[cut:], item[: n - cut], [*pad, *item[cut:], *pad], [*pad, *item[cut:]], [*pad, *item[: n - cut], *pad], [*item[cut:], *item[:cut]]]
        for edits in (1, 2, 3, 5):
            changed, more, less = list(item), list(item), list(item)
            for at in rng.integers(0, n, edits):
                changed[at] = "other"
                more.insert(at, "more")
                del less[min(at, len(less) - 1) : min(at, len(less) - 1) + 1]
            texts += [changed, [*pad, *changed, *pad], [*pad, *more], less, [*pad, *less, *pad, *item]]
    index = decontaminate.Index([(i, " ".join(x)) for i, x in enumerate(items)])
    hashes = [decontaminate.hashes(t) for t in texts]
    want = {(t, i): s for t, h in enumerate(hashes) for i in range(len(items)) if (s := brute_leak(index, i, h)) >= 0.8}
    got = {(t, i): x for t, best in enumerate(index.leaks([" ".join(t) for t in texts], 0.8)) for i, x in best.items()}
    assert len(want) > 150 and {k: round(s, 9) for k, (s, _) in got.items()} == {k: round(s, 9) for k, s in want.items()}
    assert all(index.similarity(i, hashes[t][a : a + len(items[i])]) == s for (t, i), (s, a) in got.items())


def test_language_model_base_equals_brute_force(docs, texts):
    out = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    counts = Counter()
    for d, t in texts.items():
        if not out(d):
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    got = bilinear_lm.scores(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        tokens = [*words(texts[r["doc_id"]]), None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(r["doc_id"]), len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_is_normalised():
    side = bilinear_lm.CLASSES + 1
    counts = np.zeros((side * side, bilinear_lm.CLASSES))
    counts[5, 3], counts[5, 4], counts[9, 2] = 30, 10, 7
    logs, near = bilinear_lm.estimate(counts, 60)
    p = 10.0**logs
    assert near.shape == (side, bilinear_lm.OWN_DIMENSION)
    assert np.allclose(p.sum(1), 1, atol=1e-4) and p[5, 3] > p[5, 2]
    assert np.allclose((10.0 ** bilinear_lm.estimate(counts * 0, 5)[0]).sum(1), 1, atol=1e-4)


def test_language_model_learns_words_of_its_own(spark, monkeypatch):
    """Words beyond the classes follow what they followed in training, and each class's words still share all of it."""
    rng = np.random.default_rng(4)
    frequent = [f"f{i:02}q" for i in range(bilinear_lm.TOP)]
    own = [f"{a}{b}zz" for a in "abcde" for b in "abcdef"]
    lines = [" ".join(frequent)] * 300
    lines += [" ".join([frequent[i % 5], w] * 3) for i, w in enumerate(own) for _ in range(40)]  # w always after its own word
    lines += ["rare one zz", "other two bzz"]
    ids = iter(range(10**6))
    train = [(d, t) for t, d in zip(rng.permutation(lines).tolist(), (i for i in ids if zlib.crc32(str(i).encode()) % 5 != 1), strict=False)]
    ids = iter(range(2 * 10**6, 3 * 10**6))
    words_ = [*own, "unseenzz", "zz", "bzz"]
    asked = [(d, f"{frequent[k]} {w}") for (k, w), d in zip([(k, w) for k in range(5) for w in words_], (i for i in ids if zlib.crc32(str(i).encode()) % 5 == 1), strict=False)]
    docs = spark.createDataFrame(train + asked, "doc_id long, text string")

    def told():
        got = {r["doc_id"]: r["score"] for r in bilinear_lm.scores(docs).collect()}
        return np.array([got[d] for d, _ in asked]).reshape(5, len(words_))

    with_vectors = told()
    monkeypatch.setattr(bilinear_lm, "MIN_COUNT", 10**9)
    without = told()
    right = np.array([[with_vectors[i % 5, i] - with_vectors[k, i] for k in range(5) if k != i % 5] for i in range(len(own))])
    assert right.min() > 0.3, right.min()  # log10: at least twice as likely after its own word
    assert np.allclose((10.0**with_vectors).sum(1), (10.0**without).sum(1), rtol=1e-3)
    mine = [(i % 5, i) for i in range(len(own))]
    assert np.mean([with_vectors[x] - without[x] for x in mine]) > 0.3


def test_language_model_edges(spark):
    df = spark.createDataFrame(EDGE, SCHEMA).selectExpr("*", "1 as block", "2 as counts")
    got = bilinear_lm.scores(df).collect()
    assert len(got) == len(EDGE) and all(math.isfinite(r["score"]) for r in got) and [r["held_out"] for r in got if r["doc_id"] is None] == [None]
    assert bilinear_lm.scores(spark.createDataFrame([], SCHEMA)).count() == 0


def test_toxicity_held_out(spark, docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.digest(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    right = sum(r["predicted"] == r["toxic"] for r in held) / len(held)
    assert all(0 <= r["score"] <= 1 for r in got) and right >= 0.9, right


def test_toxicity_decodes():
    words_ = "worthless idiot stupid moron clown loser pathetic disgusting trash scum and the thing was other".split()
    cube = np.zeros((toxicity.SIZE,) * 3)
    for w in words_ * 20:
        c = [0, *[toxicity.CODE[x] for x in w], 0]
        for a, b, d in zip([0, *c], c, c[1:], strict=False):
            cube[a, b, d] += 1
    lm = toxicity.language_model(cube)
    for seen, meant in (("1d10t", "idiot"), ("st.u.p.i.d", "stupid"), ("m o r o n", "moron"), ("cl0wn", "clown"), ("lo$er", "loser"), ("tra5h", "trash"), ("scuuuum", "scum")):
        assert toxicity.restore(f"the {seen} was", lm, {}) == f"the {meant} was", seen
    assert toxicity.restore("The 2024 a1b2c3d4e5f6a7b8c9d0 x", lm, {})[:8] == "the 2024"


def test_toxicity_viterbi_equals_all_readings():
    rng = np.random.default_rng(8)
    lm = np.log(rng.dirichlet(np.ones(toxicity.SIZE), (toxicity.SIZE, toxicity.SIZE))).astype(np.float32)
    for span in ("1d10t", "a m.o", "sccc0", "(l0$e!", "5+up1", "x", "éà7!", "s  k!!", "4@4"):
        best = (-math.inf, "")
        for reading in itertools.product(*toxicity.lattice(span)):
            a, b, score = 0, 0, 0.0
            for c, weight in reading:
                if c:
                    k = 0 if c == " " else toxicity.CODE.get(c, toxicity.SIZE - 1)
                    score, a, b = score + weight + float(lm[a, b, k]), b, k
                else:
                    score += weight - 1.0
            best = max(best, (score + float(lm[a, b, 0]), "".join(c for c, _ in reading)))
        assert toxicity.decode(span, lm) == best[1], span


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "you 1d10t"), (4, "fine words"), (4, "fine words"), (7, "a" * 20_000)], "doc_id long, text string").selectExpr("*", "1 as toxic", "2 as score", "'x' as half")
    labels = spark.createDataFrame([(1, 0, None), (2, 0, None), (4, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.digest(docs, labels).collect()
    assert len(got) == 6 and {r["score"] for r in got} == {0.0} and {r["predicted"] for r in got} == {0} and [r["held_out"] for r in got if r["doc_id"] is None] == [None]
    assert toxicity.digest(docs.limit(0), labels).count() == 0 and toxicity.digest(docs, labels.limit(0)).count() == 6


def test_toxicity_decodes_stretches_of_any_length_and_signs_anywhere():
    cube = np.zeros((toxicity.SIZE,) * 3)
    for w in "you are a worthless idiot stupid moron such shit stop and the thing was other".split() * 20:
        c = [0, *[toxicity.CODE[x] for x in w], 0]
        for a, b, d in zip([0, *c], c, c[1:], strict=False):
            cube[a, b, d] += 1
    lm = toxicity.language_model(cube)
    long = "you are a worthless idiot and you are a stupid moron"
    for seen, meant in (
        (" ".join(long.replace(" ", "")), long), (".".join(long.replace(" ", "")), long), ("such a m o r o n was", "such a moron was"), ("st" + "u" * 60 + "pid", "stupid"),
        ("idio7", "idiot"), ("moro9", "morog"), ("5h17", "shit"), ("570p", "stop"), ("idiot!", "idiot"), ("(idiot", "idiot"), ("!diot", "idiot"), ("2024 1 2 3 4 5", "2024 1 2 3 4 5"),
    ):
        assert toxicity.restore(seen, lm, {}) == meant, seen
    assert len(toxicity.restore("i d i o t " * 5000, lm, {}).split()) > 4000


def test_toxicity_edge_rows_and_empty_table(spark):
    df = spark.createDataFrame(EDGE, SCHEMA).selectExpr("*", "1 as toxic", "2 as score")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1), (5, 0)], "doc_id long, toxic int")
    assert toxicity.digest(df, labels).count() == len(EDGE) and toxicity.digest(df, labels.limit(0)).count() == len(EDGE)
    assert toxicity.digest(spark.createDataFrame([], SCHEMA), labels).count() == 0
