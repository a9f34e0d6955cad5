"""Cases that earlier forms of the operators got wrong."""

import time

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import bilinear_lm, common, decontaminate, jaccard_join, license_scan, packing, style_tree, toxicity


def main_text(html):
    return " ".join(t for _, role, t in style_tree.blocks(html) if role != 2)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<article class="post social-science"><p>Body</p></article>', "Body"),
        ('<article><div class="entry-header"><h1>Head</h1></div><p>text</p></article>', "Head text"),
        ('<article><div class="header"><h1>Head</h1></div><p>text</p></article>', "Head text"),
        ('<div class="page has-sidebar"><main><p>text</p></main><div class="sidebar">side</div></div>', "text"),
        ('<article><section id="related-work"><p>text</p></section></article>', "text"),
        ('<p>one <span class="ad">BUY</span> two <a class="share-link" href=q>Share <b>it</b></a> three <a href=x>four</a></p>', "one two three four"),
        ('<p><span class="ad"><span>x</span>y</span> z</p>', "z"),
        ('<div class="ad-hoc-report">one</div><div id="search-algorithms">two</div>', "one two"),
        ('<div class="comments"><article class="comment"><p>no</p></article></div><p>yes</p>', "yes"),
        ('<div class="cookie-banner">no</div><div class="site-header">no</div><div class="post-comments">no</div><nav>no</nav><p>yes</p>', "yes"),
        ("<p>one<!-- two <b", "one"),
        ("<p>one <![CDATA[ two <b", "one two <b"),
        ("one <b two", "one <b two"),
    ],
)
def test_names_and_unended_marks_of_pages(html, want):
    assert main_text(html) == want


def seconds(work, unit, n):
    began = time.perf_counter()
    work(unit * n)
    return time.perf_counter() - began


@pytest.mark.parametrize("unit", ["<a ", "<!", '"', "<a '", "<", '<div class="', "</script <", "<script ", "&", "1 ", "! ", "'"])
def test_pages_take_linear_time(unit):
    assert seconds(style_tree.blocks, unit, 80_000) < 6 * seconds(style_tree.blocks, unit, 20_000) + 0.2


@pytest.mark.parametrize("unit", ["1 ", "1", "! ", "a1 ", "$", "a.b.", "aa ", "aaab", "_", "<", '"'])
def test_disguised_stretches_are_found_in_linear_time(unit):
    def work(text):
        for p in (toxicity.SIGNED, toxicity.APART, toxicity.REPEATED):
            for _ in p.finditer(text):
                pass

    assert seconds(work, unit, 80_000) < 6 * seconds(work, unit, 20_000) + 0.2


def test_a_disguise_needs_a_letter_of_its_own():
    found = lambda t: [m[0] for m in toxicity.SIGNED.finditer(t)]
    assert found("you 1d1ot and 5h17 in 1999 5 apples") == ["1d1ot", "5h17"]


WORDS = [f"w{i}" for i in range(60)]
A, B = " ".join(WORDS[:30]), " ".join(WORDS[30:])


@pytest.mark.parametrize("back", [False, True])
def test_an_id_with_two_texts_keeps_the_links_of_both(spark, back):
    rows = [(1, A), (1, B), (2, B + " more"), (3, A + " else")]
    df = spark.createDataFrame(rows[::-1] if back else rows, "doc_id long, text string").coalesce(1)
    got = jaccard_join.classes(df).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_the_pipeline_judges_rows_by_their_own_text(spark):
    rows = [(1, "en", A), (1, "en", B), (2, "en", B + " more"), (3, "de", A + " else"), (0, "en", A), (4, "en", None), (5, "en", "")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    kept = corpus_pipeline.near_duplicate_stage(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted([(0, A), (1, B), (4, ""), (5, "")])


def test_weights_do_not_depend_on_rounds(spark, monkeypatch):
    items = [(i, " ".join(f"t{(i * 7 + k) % 40}" if k % 3 else f"u{i}x{k}" for k in range(20))) for i in range(11)] + [(3, "common start of " + A)] * 2 + [(90, None), (91, "")]
    texts = [(100 + i, f"before {t} after") for i, t in items if t] + [(200, " ".join(items[4][1].split()[:17]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = lambda: sorted(tuple(r) for r in decontaminate.leaks(docs, bench).collect())
    whole = rows()
    monkeypatch.setattr(decontaminate, "ROUND_ITEMS", 3)
    assert len(decontaminate._rounds(bench)) > 3
    assert whole and rows() == whole


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("BSD 3-Clause License", {"bsd-3-clause"}),
        ("Mozilla Public License Version 2.0", {"mpl-2.0"}),
        ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", {"gpl-3.0"}),
        ("This work is licensed under CC BY-NC-SA 4.0.", {"cc-by-nc-sa-4.0"}),
        ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", {"cc-by-nc-sa-4.0"}),
        ("licensed under CC BY-NC 4.0", {"cc-by-nc-4.0"}),
        ("licensed under the LGPL-2.1", {"lgpl-2.1"}),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", {"mit", "apache-2.0"}),
        ("# SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) OR MIT\nimport os", {"gpl-2.0", "mit"}),
        ("SPDX-License-Identifier: GPL-3.0-only and more words", {"gpl-3.0"}),
        ("licensed under either MIT OR Apache-2.0", {"mit", "apache-2.0"}),
        ("Er ging mit dem Hund or a license", set()),
    ],
)
def test_titles_and_expressions_of_licenses(text, labels):
    assert license_scan.scan(license_scan.words_of(text), {})[2] == labels


def test_long_windows_meet_within_the_radius():
    """The block index gives the pairs that counting the bits of all pairs gives, of windows of the items' size."""
    rng = np.random.default_rng(5)
    items = [[f"i{k}x{x}" for x in range(n)] for k, n in enumerate((9, 30, 59, 100, 240, 600))]
    texts = []
    for item in items:
        pad = [f"p{x}" for x in rng.integers(0, 99, int(rng.integers(1, 9)))]
        changed = [list(item) for _ in range(6)]
        for c in changed:
            c[int(rng.integers(len(item)))] = "other"
        texts += [[*pad, *x, *pad] for x in (item, *changed)]
    index = decontaminate.Index([(k, " ".join(x)) for k, x in enumerate(items)])
    assert sorted(index.classes) == [6, 27, 51, 97, 235]  # 600 words: several windows of 235
    h = decontaminate.hashes([w for t in texts for w in t])
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    sums, want, apart = decontaminate.running(h), set(), 0
    for size, (prints, item, begin, *_) in index.classes.items():
        for t, (a, z) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            starts = np.array([s for s in range(0, z - size + 1, decontaminate.STRIDE) if s >= a])
            for f in decontaminate.fingerprints(sums, starts, size).tolist() if len(starts) else ():
                for x, p in enumerate(prints.tolist()):
                    if (d := (f ^ p).bit_count()) <= decontaminate.RADIUS:
                        want.update((t, j) for j in item[begin[x] : begin[x + 1]].tolist())
                        apart += d > 0
    got = index.met(index.classes, decontaminate.STRIDE, sums, bounds)
    assert got == want and apart > 10 and {(7 * k, k) for k in range(len(items))} <= got  # every whole copy, wherever it begins
    assert got | index.met(index.short, 1, sums, bounds) == index.candidates(h, bounds)


def test_packing_runs_every_epoch_once(spark):
    items = spark.createDataFrame([(i, 400 + i % 700, 0) for i in range(300)], "item_id long, length int, grp long")
    plan = packing._pack_groups(items, packing.GROUP_ITEMS, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 + packing.EPOCHS


def test_a_grouping_that_none_can_beat_goes_to_all_islands(spark):
    lengths = np.array([1024] * 40, "<u2").tobytes()
    best = packing._dump([[1024, 1024]] * 20)
    began = spark.createDataFrame([(7, 0, lengths, [])], packing.ISLAND)
    got = {r["island"]: [bytes(x) for x in r["bins"]] for r in packing._epoch(began, 0, False).collect()}
    assert got == {k: [best] for k in range(packing.ISLANDS)}
    again = packing._epoch(spark.createDataFrame([(7, 1, lengths, [best])], packing.ISLAND), 1, False).collect()
    assert [(r["island"], len(r["bins"])) for r in again] == [(1, 1)]


def test_batches_of_blocks_follow_no_split(spark):
    """F8: a Python worker gets a few MB of blocks at once, however large the split that they are read from; a file has few blocks."""
    docs = spark.createDataFrame([(k, f"word{k % 7} and some more of it") for k in range(40)], "doc_id long, text string")
    assert bilinear_lm.scores(docs).count() == 40
    rows = spark.range(0, 48, 1, 1).select(F.col("id").alias("block"), F.expr("cast(repeat('x', 1000000) as binary)").alias("raw"))
    sizes = common.arrow_map(rows, lambda batches: ({"n": [sum(map(len, b["raw"]))]} for b in batches), spark.range(0).select(F.col("id").alias("n")).schema).collect()
    assert sum(r["n"] for r in sizes) == 48_000_000 and max(r["n"] for r in sizes) <= 16_000_000
    files = common.staged(rows, "few", common.FILE_BLOCKS).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == 48 and max(r["count"] for r in files) <= common.FILE_BLOCKS
