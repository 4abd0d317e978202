"""Substring dedup, ranked search and fill-in-the-middle against brute force on awkward small tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanegraph.llm import fill_middle, ranked_search, substring_dedup
from lanegraph.llm.words import run_hashes, sliding_min, split_words, word_hashes
from tests.llm.fixtures import DOCS, clashing, documents, frame

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def rows_of(n_copies=40):
    """Documents that share passages: whole copies, a header on a third of them, shifted overlaps, self repeats."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6)))
    head, passage = [word() for _ in range(30)], [word() for _ in range(60)]
    rows = []
    for i in range(120):
        w = [word() for _ in range(r.randrange(0, 60))]
        if i % 3 == 0:
            w = head + w
        if i % 7 == 0:
            k = r.randrange(0, 50)
            w = w + passage[k : k + r.randrange(10, 30)] + [word() for _ in range(5)]
        rows.append((1000 - i, " \n".join(w)))
    rows += [(2000 + i, rows[3][1]) for i in range(n_copies)]
    rows += [(3000, "x " * 500), (3001, "y " + "x " * 40), (3002, "z z " * 100), (3003, ""), (3004, None), (3005, " \t"), (3006, "é " * 20 + "W" * 300), (3007, "é " * 20 + "W" * 300)]
    rows += [(None, rows[0][1]), (None, rows[3][1]), (3001, "q " * 15), (3001, "q " * 15 + "end"), (3001, "y " + "x " * 40), (5000, "q " * 14)]
    return rows


def plain_removal(rows, window):
    """(n_words, n_removed, kept) of each row, in the rows' order."""
    words = [SPACE.findall((t or "").encode()) for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None:
                least[k] = min(d, least.get(k, d))
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            m = least.get(tuple(w[i : i + window]))
            if m is not None and (d is None or m < d):
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("params", [{}, {"window": 13, "start": 3}, {"window": 5, "start": 2}, {"window": 1}, {"window": 13, "start": 13}, {"share": 40}, {"window": 30, "start": 4, "share": 40}])
def test_removal_equals_brute_force(spark, monkeypatch, params):
    monkeypatch.setattr(substring_dedup, "SAMPLE_ROWS", 50)
    rows = rows_of()
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    made = substring_dedup.remove_repeats(docs, **params).collect()
    got = sorted(((r["doc_id"], r["n_words"], sum(s["length"] for s in r["spans"]), r["kept"]) for r in made), key=str)
    assert got == plain_removal(rows, params.get("window", 13))


def test_removal_takes_the_broadcast_way_for_frequent_passages(spark, monkeypatch):
    """Passages in most documents are frequent; the result is the same."""
    frequent = []
    found = substring_dedup._frequent
    monkeypatch.setattr(substring_dedup, "_frequent", lambda *a: frequent.append(found(*a)) or frequent[-1])
    r = random.Random(2)
    head = " ".join(f"h{i}" for i in range(20))
    rows = [(i, head + " " + " ".join(str(r.randrange(10**6)) for _ in range(20))) for i in range(300)]
    made = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), share=50).collect()
    assert len(frequent[0][1]) > 0
    got = sorted(((r["doc_id"], r["n_words"], sum(s["length"] for s in r["spans"]), r["kept"]) for r in made), key=str)
    assert got == plain_removal(rows, 13)


def test_removal_of_empty_tables_and_spans(spark):
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0
    a = " ".join(f"w{i}" for i in range(40))
    made = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame([(1, a), (2, "new " + a[:80] + " tail")], "doc_id long, text string")).collect()}
    assert made[1]["spans"] == [] and [tuple(s) for s in made[2]["spans"]] == [(1, len(a[:80].split()) - (0 if a[80] == " " else 1))]


def test_levels_double_up_to_the_window():
    assert substring_dedup.levels(13, 7) == [7, 13]
    assert substring_dedup.levels(50, 7) == [7, 13, 25, 50]
    assert substring_dedup.levels(13, 8) == [13]
    assert substring_dedup.levels(1, 1) == [1]
    for window, start in ((13, 3), (100, 5)):
        found = substring_dedup.levels(window, start)
        assert all(a < b <= 2 * a for a, b in zip(found, found[1:]))


def test_words_and_hashes():
    texts = [b"one two  two\tone", b"", b" \n", "é x é".encode(), b"w" * 5000 + b" " + b"w" * 5000]
    w = split_words(texts)
    assert [w.data[a:b] for a, b in zip(w.start, w.end)] == [x for t in texts for x in t.split()]
    assert w.counts.tolist() == [4, 0, 0, 3, 2]
    assert w.place.tolist() == [0, 1, 2, 3, 0, 1, 2, 0, 1]
    h = word_hashes(w)
    assert h[0] == h[3] and h[1] == h[2] and h[4] == h[6] and h[7] == h[8] and len(set(h.tolist())) == 5
    r = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    for size in range(1, 15):
        assert sliding_min(r, size).tolist() == [min(r[i : i + size]) for i in range(200 - size + 1)]
        found = run_hashes(r % 3, size)
        runs = [tuple(r[i : i + size] % 3) for i in range(200 - size + 1)]
        assert len(set(found.tolist())) == len(set(runs)) == len(set(zip(found.tolist(), runs)))
    assert len(run_hashes(r[:3], 5)) == len(sliding_min(r[:3], 5)) == 0


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(rows, items, k=10):
    docs = [(d, Counter(TERM.findall((t or "").translate(FOLD)))) for d, t in rows]
    docs = [(d, c) for d, c in docs if c]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in docs:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in TERM.findall((text or "").translate(FOLD)) if c[t])
            if s > 0:
                scores.append((-s, d is None, d if d is not None else 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [4096, 6])
def test_search_equals_brute_force(spark, monkeypatch, block):
    """With ties by the dozen, repeated items and terms, and blocks that hold one item each."""
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", block)
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", 16)
    rows = [(r[0], r[1]) for r in documents(3, 150)] + [(500 - i, "River STONE house") for i in range(40)] + [(900, "ÄÖ river ÄÖ"), (901, "äö"), (None, "river")]
    items = [(1, "river stone, river"), (2, "ÄÖ"), (3, None), (4, "no such thing99"), (5, "house house the"), (5, "house house the"), (6, rows[1][1])]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    got = ranked_search.search(docs, spark.createDataFrame(items, "item_id long, text string").coalesce(1)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_search(rows, items)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "river")], "item_id long, text string")
    assert ranked_search.search(frame(spark, []), items).collect() == []
    assert ranked_search.search(frame(spark), items.limit(0)).collect() == []
    assert ranked_search.search(frame(spark, [(1, None, None, None, None)]), items).collect() == []


def test_an_index_for_all_terms_serves_as_well(spark):
    docs = frame(spark)
    size = ranked_search.collection_size(docs)
    _, h = ranked_search._terms([b"river house"])
    some = ranked_search.build_index(docs, size, terms=h).where("term is not null").select("term", "docs", "adds")
    every = ranked_search.build_index(docs, size).where(F.col("term").isin(h.view(np.int64).tolist())).select("term", "docs", "adds")
    assert sorted(some.collect()) == sorted(every.collect()) and some.count() > 0


def test_best_first_opens_few_nodes_and_orders_ties():
    r = np.random.default_rng(4)
    postings = []
    for _ in range(6):
        docs = np.sort(r.choice(5000, 800, replace=False))
        postings.append((docs, r.integers(1, 1000, 800)))
    trees = ranked_search.Trees(5000, postings)
    total = np.zeros(5000, np.int64)
    for (docs, adds), w in zip(postings, (5, 4, 3, 2, 2, 1)):
        total[docs] += w * adds
    found, opened = trees.best([0, 1, 2, 3, 4, 5], [5, 4, 3, 2, 2, 1], 10)
    assert found == sorted(((int(s), d) for d, s in enumerate(total)), key=lambda x: (-x[0], x[1]))[:10]
    assert opened < 400
    assert trees.best([0], [1], 10, 10**9) == ([], 0)
    same = ranked_search.Trees(1000, [(np.arange(0, 1000, 3), np.full(334, 7))])
    found, opened = same.best([0], [2], 5)
    assert found == [(14, 0), (14, 3), (14, 6), (14, 9), (14, 12)] and opened <= 6


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_middle(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    x = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    a, b, z = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    spm = h4 % 100 < 80
    return (doc_id, n, "spm" if spm else "psm", len(a), len(b), f"<S>{z}<P>{a}<M>{b}" if spm else f"<P>{a}<S>{z}<M>{b}")


def test_fill_middle_equals_brute_force(spark):
    texts = [r[1] for r in documents(1, 80)] + ["a <P> b", "<M>", "<S", "P> x <", "😀 x😀😀  y\x0b\x0cz  q r  ", "  lead", "trail \n", "a\x1cb c\x85d", "<" * 30, " "] * 4
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id here"), (3, "repeated id"), (-7, "below zero  ")]
    made = fill_middle.transform(clashing(spark.createDataFrame(rows, "doc_id long, text string")))
    got = sorted(((r["doc_id"], r["n"], r["form"], None if r["prefix"] is None else len(r["prefix"]), None if r["middle"] is None else len(r["middle"]), r["output"]) for r in made.collect()), key=str)
    assert got == sorted((plain_middle(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = made.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted((tuple(r) for r in back), key=str) == sorted(((d, t or "") for d, t in rows), key=str)


@pytest.mark.parametrize("units,pattern", [("lines", r"[^\n]*\n|[^\n]+"), ("runs", r"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"), ("characters", r"[\s\S]"), ("words", UNIT.pattern)])
def test_boundaries_give_the_units_of_the_grammar(spark, units, pattern):
    texts = ["", "a", "\n", "a\n\nb \n", "  x  y", "😀😀\n😀 é", "end\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(fill_middle.pieces(F.col("t"), fill_middle.GRAMMARS[units]).alias("p")).collect()
    assert [r["p"] for r in got] == [re.findall(pattern, t) for t in texts]


def test_grammars_that_are_not_local_are_refused():
    with pytest.raises(ValueError, match="neighbouring"):
        fill_middle.boundary(fill_middle.Grammar((("stop", "."), ("space", " "), ("other", "^. ")), ("other* space* stop space*", "other+", "space+")))


def test_fill_middle_keeps_columns_and_handles_empty_tables(spark):
    assert fill_middle.transform(spark.createDataFrame([], DOCS)).count() == 0
    made = fill_middle.transform(frame(spark), keep=["lang"])
    assert made.columns[:2] == ["doc_id", "lang"] and made.count() == frame(spark).count()
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
