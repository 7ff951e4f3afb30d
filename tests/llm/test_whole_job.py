"""Cases in which an operator once did less than its whole job."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from test_operators import BPE, words

import corpus_pipeline
from barlace.llm import decontamination, html_extraction, line_dedup, packing


def test_packing_ends_where_no_bin_can_be_filled(spark):
    n = 2 * packing.GROUP_PIECES + 800
    table = spark.range(n).selectExpr("id as doc_id", "repeat('a ', 2499) as text")
    rows = packing.pack_documents(table, BPE).select("doc_id", "length", "sequence_id").collect()
    assert Counter(r.doc_id for r in rows) == Counter(range(n)) and {r.length for r in rows} == {2500}
    assert len({r.sequence_id for r in rows}) == n


def test_local_search_skips_bins_known_to_be_stuck(monkeypatch):
    calls = []
    largest = packing._largest_transfer
    monkeypatch.setattr(packing, "_largest_transfer", lambda *a: calls.append(1) or largest(*a))
    assert len(packing.pack([2500] * 2000, 4096)) == 2000
    assert len(calls) < 2 * 2000


@pytest.mark.parametrize("n", range(5, 14))
def test_every_accepted_substitution_in_a_short_item_is_found(n):
    item, noise = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(900, 960, dtype=np.uint64)
    index = decontamination.SeedIndex([(7, item)], 13, 80)
    for k in range(4):
        for miss in itertools.combinations(range(n), k):
            changed = item.copy()
            changed[list(miss)] = np.arange(k, dtype=np.uint64)
            found = list(index.leaks(np.concatenate([noise[:30], changed, noise[30:]])))
            assert found == ([(7, 30, n, n - k)] if 100 * (n - k) >= 80 * n else []), miss


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("length", [5, 8, 12, 20, 40, 100])
def test_near_lines_are_found_by_edit_similarity_alone(spark, length):
    rng = random.Random(length)
    rows, close = [], 0
    for k in range(40):
        base = words(rng, length)
        copy = list(base)
        for i in rng.sample(range(length), rng.randint(1, max(1, length // 20))):
            copy[i] = words(rng, 1)[0]
        a, b = " ".join(base), " ".join(copy)
        close += edit_distance(a, b) <= max(len(a), len(b)) * 20 // 100
        rows += [(2 * k, a), (2 * k + 1, b)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    cut = sum(r._dropped for r in line_dedup.dedup_lines(table, whole=True).collect())
    assert 0.95 * close <= cut <= close


def test_short_and_unspaced_lines_take_part(spark):
    han, other = "今日は天気がとても良いので公園まで散歩に行きました", "今日は天気がとても良いので公園まで散歩へ行きました"
    rows = [(1, f"Short one\n{han}\n--\n"), (2, f"short  ONE!\n{other}\n--\n\nfive"), (3, f"x\n{han}\nfour\nX")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table, whole=True).collect()}
    assert got == {1: rows[0][1], 2: "--\n\nfive", 3: "x\nfour"}


@pytest.mark.parametrize("page, want", [
    ("<html><head><title>T</title><article><p>one</article>", ["one"]),
    ("<head><meta charset=x><script>s</script>\nplain text<p>two", ["plain text", "two"]),
    ("<html><head><title>T</title><style>s</style></head><body><p>x", ["x"]),
    ("<article><svg><path d=x><text>drawn</text><p>one</p><p>two</article>", ["one", "two"]),
    ("<article><p>a<svg><text>drawn</text></svg>b<p>c<svg><foreignObject><div>held</div></foreignObject></svg>d</article>", ["ab", "c", "d"]),
    ("<article><p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</article>", ["let x=1 be"]),
])
def test_left_out_tags_and_formulas_hide_no_text(page, want):
    assert [x.text for x in html_extraction.parse(page) if x.tag == "#text"] == want


def test_repeated_rows_leave_one_row(spark):
    one, two = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, one), (1, one), (1, two), (3, one), (None, one), (None, one), (None, two), (4, None), (4, None), (5, "")]
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, table, "").collect())
    assert got == Counter([(1, one), (1, two), (None, one), (None, two), (4, None), (5, "")])


def test_deep_pages_take_linear_time():
    import time

    seconds = []
    for depth in (4000, 16000):
        began = time.perf_counter()
        nodes = html_extraction.parse("<div>" * depth + "<p>text" + "</div>" * depth)
        seconds.append(time.perf_counter() - began)
        assert [x.text for x in nodes if x.tag == "#text"] == ["text"]
    assert seconds[1] < 12 * seconds[0] + 0.5


def test_quality_keeps_columns_of_any_name(spark):
    from barlace.llm import quality_rules

    text = " ".join(f"word{k}" for k in range(80))
    table = spark.createDataFrame([(k, text, k, 2 * k) for k in range(6)], "doc_id long, text string, _stats int, _id int")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(6)], "doc_id long, quality int, toxic int")
    got = quality_rules.keep_quality(table, labels)
    assert got.columns == table.columns and sorted(r._stats for r in got.collect()) == list(range(6))


@pytest.mark.parametrize("boundary", [0, 4, 9])
def test_no_sample_changes_the_groups(spark, monkeypatch, boundary):
    from barlace.llm import jaccard_join

    rng = random.Random(5)
    texts = [words(rng, n) for n in (5, 7, 9, 12, 14, 20, 30) for _ in range(6)]
    texts += [[*t[:-1], "changed"] for t in texts] + [["added", *t] for t in texts]
    table = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    groups = lambda: {tuple(r) for r in jaccard_join.jaccard_groups(table).collect()}
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    top = list(range(len(texts)))
    for _ in range(4):  # smallest id reachable
        for a, b in itertools.combinations(range(len(texts)), 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                top[a] = top[b] = min(top[a], top[b])
    drawn = np.random.default_rng(boundary).random(1 << 16) < 0.5
    monkeypatch.setattr(jaccard_join, "frequent_table", lambda *_: (drawn, 48, boundary))
    assert groups() == {(k, len(s), top[k]) for k, s in enumerate(sets)}
    assert len(set(top)) < len(top)
