import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from lanegraph.llm import crf, features, mixing
from lanegraph.llm import pseudo_likelihood as pl
from lanegraph.llm import quality_classifier as qc
from lanegraph.llm import quality_rules as qr
from lanegraph.llm.features import MARKS
from tests.llm.fixtures import DOCS, WORDS, clashing, documents, frame, sentence

LABELS = "doc_id long, quality int, toxic int"


def test_marginals_equal_enumeration():
    m = crf.Crf(["a", "b", "c"])
    rng = np.random.default_rng(0)
    m.trans = rng.normal(0, 1, (3, 3)).astype(np.float32)
    sizes = np.array([3, 0, 1, 5])
    e = rng.normal(0, 2, (9, 3)).astype(np.float32)
    got = m.marginals(e, sizes)
    at = 0
    for n in sizes:
        part = e[at : at + n].astype(float)
        want = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            if n:
                p = np.exp(sum(part[i, y] for i, y in enumerate(path)) + sum(m.trans[a, b] for a, b in zip(path, path[1:])))
                for i, y in enumerate(path):
                    want[i, y] += p
        if n:
            want /= want.sum(1, keepdims=True)
        assert np.allclose(got[at : at + n], want, atol=1e-4)
        at += n


def test_segments_and_blocks_do_not_change_marginals(monkeypatch):
    m = crf.Crf(["a", "b"])
    rng = np.random.default_rng(1)
    m.trans = rng.normal(0, 1, (2, 2)).astype(np.float32)
    sizes = rng.integers(0, 500, 20)
    e = rng.normal(0, 2, (int(sizes.sum()), 2)).astype(np.float32)
    ways = [(-1, 64, 1 << 22), (-1, 1000, 1 << 22), (1 << 30, 64, 1 << 22), (1 << 30, 64, 60), (1 << 30, 64, 1), (200, 64, 900)]
    found = []
    for long, seg, cells in ways:
        for name, value in (("LONG", long), ("SEG", seg), ("CELLS", cells)):
            monkeypatch.setattr(crf, name, value)
        found.append(m.marginals(e, sizes))
        doc = np.repeat(np.arange(20), sizes)
        want = np.stack([np.bincount(doc, found[-1][:, j], 20) for j in range(2)], 1)
        assert np.allclose(m.sums(e, np.arange(len(e)), sizes), want, atol=1e-3)
    assert all(np.allclose(found[0], other, atol=1e-4) for other in found[1:])


def test_many_labels_need_no_matrices():
    """200 labels and a text of 8,000 words beside short ones: memory follows the words, not the labels' square."""
    k = 200
    m = crf.Crf([f"l{i:03d}" for i in range(k)])
    rng = np.random.default_rng(3)
    m.trans = rng.normal(0, 1, (k, k)).astype(np.float32)
    table = rng.normal(0, 1, (3000, k)).astype(np.float32)
    sizes = np.concatenate([[8_000], rng.integers(0, 300, 1000)])
    ids = rng.integers(0, 3000, int(sizes.sum()))
    tracemalloc.start()
    sums = m.sums(table, ids, sizes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(sums.sum(1), sizes, rtol=1e-4) and peak < 200e6
    four = m.sums(table, ids[:4], np.array([2, 0, 2]))
    pot, t = np.exp(table[ids[:4]].astype(float)), np.exp(m.trans.astype(float))
    for row, (i, j) in ((0, (0, 1)), (2, (2, 3))):
        joint = pot[i][:, None] * t * pot[j]
        joint /= joint.sum()
        assert np.allclose(four[row], joint.sum(0) + joint.sum(1), atol=1e-4)


def test_training_learns_many_languages():
    """250 languages, each with words of its own: none is left out."""
    rng = np.random.default_rng(6)
    words = [["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(6)] for _ in range(250)]
    texts = [(" ".join(rng.choice(w, 12)).encode(), f"l{i:03d}") for i, w in enumerate(words) for _ in range(3)]
    m = crf.Crf([f"l{i:03d}" for i in range(250)]).fit(texts, epochs=4)
    found = crf.predict(m, "many", [" ".join(w).encode() for w in words])[0].to_pylist()
    assert sum(x == y for x, y in zip(found, m.labels)) >= 245


def test_training_gradient_is_that_of_the_likelihood():
    m = crf.Crf(["a", "b"])
    rng = np.random.default_rng(2)
    m.trans = rng.normal(0, 0.5, (2, 2)).astype(np.float32)
    e = rng.normal(0, 1, (1, 4, 2))

    def log_z(e, t):
        v = e[0, 0]
        for s in range(1, 4):
            v = np.log(np.exp(v[:, None] + t).sum(0)) + e[0, s]
        return np.log(np.exp(v).sum())

    post, pairs = m._expected(e)
    t = m.trans.astype(float)
    for i, k in ((0, 0), (2, 1)):
        up = e.copy()
        up[0, i, k] += 1e-5
        assert post[0, i, k] == pytest.approx((log_z(up, t) - log_z(e, t)) / 1e-5, abs=1e-4)
    for a, b in ((0, 1), (1, 1)):
        up = t.copy()
        up[a, b] += 1e-5
        assert pairs[a, b] == pytest.approx((log_z(e, up) - log_z(e, t)) / 1e-5, abs=1e-4)


def test_language_of_documents_and_switched_text(spark):
    r = random.Random(0)
    rows = [(i, sentence(r, lang, 60), lang, "s", 0) for i in range(160) for lang in [("en", "de")[i % 2]]]
    rows += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "123 !!", "en", "s", 0), (1003, sentence(r, "de", 9000), None, "s", 0), (None, sentence(r, "de", 30), "en", "s", 0)]
    found = {x["doc_id"]: x for x in crf.identify(clashing(frame(spark, rows))).collect()}
    assert all(found[i]["lang_pred"] == ("en", "de")[i % 2] for i in range(160))
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert found[1003]["lang_pred"] == "de" and 0 <= found[1003]["score"] <= 1
    m = crf.fit(frame(spark, rows))
    mixed = sentence(r, "en", 15) + " " + sentence(r, "de", 15)
    labels = [x[1] for x in crf.label_text(m, mixed)]
    assert sum(a == b for a, b in zip(labels, ["en"] * 15 + ["de"] * 15)) >= 26
    words = crf.label_words(frame(spark, [(1, mixed, "en", "s", 0)]), m).first()["words"]
    assert len(words) == len(labels)
    none = crf.identify(frame(spark, [(1, "some text", None, "s", 0)])).first()
    assert (none["lang_pred"], none["score"]) == ("und", 0.0)
    assert crf.identify(frame(spark, [], DOCS)).count() == 0


def test_context_sums_equal_brute_force():
    rng = np.random.default_rng(0)
    place, sign = qc.index_vectors(16, 8)
    ids, sizes = rng.integers(0, 16, 30), np.array([10, 0, 1, 19])
    want, at = np.zeros((16, 8)), 0
    for n in sizes:
        for i in range(at, at + n):
            for j in range(max(at, i - qc.WINDOW), min(at + n, i + qc.WINDOW + 1)):
                if i != j:
                    for k in range(2):
                        want[ids[i], place[ids[j], k]] += sign[ids[j], k]
        at += n
    assert np.allclose(qc.context_sums(ids, sizes, place, sign, 16, 8), want.ravel())


def test_network_gradient_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (600, 5))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(float)
    net = qc.Network(5).fit(x, y, np.arange(600) % 5 == 0)
    assert ((net.score(x) > 0.5) == y).mean() > 0.95 and 0.25 <= net.temperature <= 8
    assert qc.Network(5).fit(x, np.ones(600), np.zeros(600, bool)).score(x[:2]).tolist() == [1.0, 1.0]


def quality_rows(n=400, seed=1):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        rows.append((i, " ".join(w + ("###" if bad else "") for w in sentence(r, "en", 40).split()), "en", "s", 0))
        labels.append((i, int(not bad), i % 3 == 0 and 1 or 0))
    return rows, labels


def test_quality_scores(spark):
    rows, labels = quality_rows()
    rows += [(5000, None, None, "s", 0), (5001, "", None, "s", 0), (None, "the house", "en", "s", 0)]
    docs, marks = clashing(frame(spark, rows)), spark.createDataFrame(labels + [(3, None, 0), (None, 1, 1), (4, 7, 7)], LABELS)
    got = {x["doc_id"]: x["score"] for x in qc.score_documents(docs, marks).collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values()) and got[5000] == got[5001]
    assert np.mean([(got[i] >= 0.5) == (i % 4 != 0) for i in range(400)]) > 0.97
    kept = qc.filter_documents(docs, marks)
    assert kept.columns == docs.columns and 295 <= kept.count() <= 310
    assert qc.score_documents(frame(spark, [], DOCS), marks).count() == 0
    assert {x["score"] for x in qc.score_documents(docs, marks.limit(0)).collect()} == {1.0}


def test_rare_label_is_sampled_whole(spark):
    """40 of 4,000 rows are poor: a sample of 400 holds them all, and scores keep to the odds of all rows."""
    rows = spark.createDataFrame([(i, float(i % 100 != 0)) for i in range(4000)], "doc_id long, y double")
    chosen, weight = qc.label_sample(rows, 400)
    got = Counter(r["y"] for r in chosen.collect())
    assert got[0.0] == 40 and 280 <= got[1.0] <= 440 and weight[0.0] == 1 and weight[1.0] == pytest.approx(11, rel=0.01)
    assert qc.label_sample(rows, 4000)[0].count() == 4000
    even, _ = qc.label_sample(rows.withColumn("y", (rows.doc_id % 2).cast("double")), 400)
    assert all(140 <= n <= 260 for n in Counter(r["y"] for r in even.collect()).values())
    rng = np.random.default_rng(0)
    y = np.r_[np.zeros(400), np.ones(3600)]
    x = rng.normal(0, 1, (4000, 2))
    net = qc.Network(2).fit(x, y, np.arange(4000) % 5 == 0, weight={0.0: 1.0, 1.0: 11.0})
    assert 0.97 < net.score(x).mean() < 1  # 39,600 of 40,000


def test_projected_gradient_meets_targets(spark):
    rng = np.random.default_rng(0)
    n = 3000
    kind = rng.choice(3, n, p=[0.7, 0.2, 0.1])
    p = 0.02 + 0.94 * np.eye(3)[kind]
    p /= p.sum(1, keepdims=True)
    w = rng.integers(1, 500, n)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(w, p)], "n_tokens long, p array<double>").repartition(3)
    history, eta, final = mixing.solve_rates(members, 3, {0: 0.9, 1: 0.1}, 0, rounds=40)
    q = (w @ p) / w.sum()
    goal = mixing.targets_for(q, {0: 0.9, 1: 0.1}, 0)
    r = mixing.replay(p, history, mixing.RIDGE, eta)[0]
    assert (r >= 0).all() and np.allclose((w * r) @ p / w.sum(), final, atol=1e-9)
    # Brute force: the same least squares by many plain projected steps over all documents.
    plain = np.ones(n)
    for _ in range(20000):
        g = ((w * plain) @ p / w.sum() - goal) / q
        plain = np.maximum(plain - 0.5 * (p @ g + mixing.RIDGE * (plain - 1)), 0)
    cost = lambda x: 0.5 * ((((w * x) @ p / w.sum() - goal) ** 2) / q).sum() + mixing.RIDGE / 2 * (w / w.sum() * (x - 1) ** 2).sum()
    assert cost(r) <= cost(plain) * 1.01 + 1e-6
    assert np.abs(final[:2] - goal[:2]).max() < 0.03


def test_mixing(spark):
    rows, labels = quality_rows()
    rows += [(5000, None, None, "s", 0), (None, "", "en", "s", 0)]
    docs, marks = clashing(frame(spark, rows)), spark.createDataFrame(labels + [(3, None, 0)], LABELS)
    got = mixing.mix(docs, marks).collect()
    assert len(got) == 402 and all(x["rate"] >= 0 and x["copies"] >= 0 for x in got)
    assert all(x["rate"] == 1 for x in got if x["n_tokens"] == 0)
    poor = [x["copies"] for x in got if x["doc_id"] is not None and x["doc_id"] < 400 and x["doc_id"] % 4 == 0]
    good = [x["copies"] for x in got if x["doc_id"] is not None and x["doc_id"] < 400 and x["doc_id"] % 12 in (1, 2, 5)]
    assert np.mean(poor) < 0.3 and np.mean(good) > 0.5
    taken = mixing.mixed_documents(docs, marks)
    assert taken.columns == docs.columns and taken.count() == sum(x["copies"] for x in got)
    assert mixing.mix(frame(spark, [], DOCS), marks).count() == 0
    assert {x["copies"] for x in mixing.mix(docs, marks.limit(0)).collect()} == {1}


def test_scarce_domain_reaches_its_weight(spark):
    """4 poor documents of 400 against a weight of 20 to 80: they are repeated until the weights hold."""
    r = random.Random(3)
    poor = lambda i: i % 100 == 0
    rows = [(i, " ".join(w + ("###" if poor(i) else "") for w in sentence(r, "en", 40).split()), "en", "s", 0) for i in range(400)]
    docs, marks = frame(spark, rows), spark.createDataFrame([(i, int(not poor(i)), 0) for i in range(400)], LABELS)
    weights = {"good": 0.8, "poor": 0.2}
    got = mixing.domain_totals(mixing.mix(docs, marks, weights), weights)
    assert got["poor"]["present"] < 0.05 * got["good"]["present"]
    assert got["poor"]["reached"] / got["good"]["reached"] == pytest.approx(0.25, rel=0.1)
    assert all(x["reached"] == pytest.approx(x["target"], rel=0.1) for x in got.values())
    copies = Counter(x["doc_id"] % 100 == 0 for x in mixing.mixed_documents(docs, marks, weights).collect())
    assert copies[True] / copies[False] == pytest.approx(0.25, rel=0.25)


def test_pseudo_likelihood_equals_brute_force(spark, monkeypatch):
    """Scores from slices and key ranges equal those from plain counts of all texts; many small slices and ranges change nothing."""
    rows = documents(11)
    docs = clashing(frame(spark, rows))
    monkeypatch.setattr(pl, "SLICE_BYTES", 3_000)
    monkeypatch.setattr(pl, "RANGE_TOKENS", 700)
    tokens = pl.token_table(docs)
    (params, cls, slot, counts) = model = pl.fit(tokens)
    monkeypatch.setattr(pl, "fit", lambda _: model)
    got = pl.score_documents(docs).collect()
    assert len(got) == len(rows)
    e, p, b, u, c, v, g = [x.astype(np.float64) for x in params]
    texts = [[zlib.crc32(w.strip(MARKS).lower()) for w in (r[1] or "").encode().split()] for r in rows]
    around = [[(t[i - 1] if i else None, w, t[i + 1] if i + 1 < len(t) else None) for i, w in enumerate(t)] for t in texts]
    words, sides, triples = Counter(w for t in texts for w in t), Counter((x[0], x[2]) for t in around for x in t), Counter(x for t in around for x in t)
    assert counts.tolist() == [sum(n for w, n in words.items() if w % pl.BUCKETS == k) for k in range(pl.BUCKETS)]

    def soft(z, k):
        return z[k] - np.log(np.exp(z).sum())

    def brute(t, near):
        out = np.zeros(len(pl.PRIORS))
        for i, (w, x) in enumerate(zip(t, near)):
            ctx = [t[i + o] % pl.BUCKETS if 0 <= i + o < len(t) else pl.BUCKETS for o in pl.OFFSETS]
            h = np.tanh(np.concatenate([e[y] for y in ctx]) @ p + b)
            k = w % pl.BUCKETS
            q = np.exp(soft(h @ u + c, cls[k]) + soft(v[cls[k]] @ h + g[cls[k]], slot[k])) * words[w] / counts[k]
            out += [np.log((triples[x] - 1 + a * q) / (sides[x[0], x[2]] - 1 + a)) for a in pl.PRIORS]
        return len(t), out

    want = [brute(*x) for x in zip(texts, around)]
    best = int(np.argmax(sum(w[1] for w in want)))
    order = lambda x: (x[0], round(x[1], 1))
    have = sorted(((x["n_tokens"], x["log_prob"]) for x in got), key=order)
    want = sorted(((n, s[best]) for n, s in want), key=order)
    assert [w[0] for w in want] == [h[0] for h in have]
    assert np.allclose([w[1] for w in want], [h[1] for h in have], rtol=1e-3, atol=0.05)
    assert all(x["log_prob"] == 0 and x["mean_log_prob"] == 0 for x in got if x["n_tokens"] == 0)
    assert pl.score_documents(frame(spark, [], DOCS)).count() == 0


def test_words_are_looked_at_once_and_none_is_kept():
    r = np.random.default_rng(3)
    marks = np.array(["a", "B", "é", "ß", "中", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", ".", ",", "\x00", "İ"])
    texts = ["".join(r.choice(marks, n)).encode() for n in r.integers(0, 40, 500)] + [b"", b" ", b"\n\n"]
    want = [[zlib.crc32(w.strip(MARKS).lower()) for w in t.split()] for t in texts]
    features._LIVE.clear()
    ids, sizes = features.core_ids(texts, 1 << 32)
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    assert not features._LIVE


def test_words_are_kept_packed_and_not_carried_into_the_next_stage():
    words = [f"word{i}x".encode() for i in range(50_000)]
    features._LIVE.clear()
    tracemalloc.start()
    ids, sizes = features.unit_ids([b" ".join(words), b"", words[7] + b"."], qc.BUCKETS)
    doc, unit, count, n = mixing.unit_counts([b" ".join(words), b"", words[7]])
    del ids, doc, unit, count
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert sizes.tolist() == [50_000, 0, 2] and n.tolist() == [50_000, 0, 1]
    assert held / len(words) < 200  # with numbers in tuples 257
    qr.count_texts([b"some words"])
    assert not features._LIVE


def test_units_of_distinct_words_are_made_together(monkeypatch):
    """Odd words give what ``word_units`` gives; only each way of marks and capitals is looked at in Python."""
    r = np.random.default_rng(5)
    signs = np.array([b"a", b"B", b"\xc3\xa9", b" ", b"\t", b"\n", b"\x0b", b"\x1c", b".", b"-", b"!", b"\x00", b"7", b"\xff"])
    texts = [b"".join(r.choice(signs, n).tolist()) for n in r.integers(0, 60, 400)] + [b"", b" ", b"x" * 70 + b".", b"X" * 70, b"... A AB Ab !A!"]
    own = lambda w, n: features.word_units(w, n)
    ids, sizes = features.unit_ids(texts, qc.BUCKETS)
    assert ids.tolist() == [u for t in texts for w in t.split() for u in own(w, qc.BUCKETS)]
    assert sizes.tolist() == [sum(len(own(w, qc.BUCKETS)) for w in t.split()) for t in texts]

    def domain(w):
        core = w.strip(MARKS).lower()
        return (*own(w, mixing.BUCKETS), *(zlib.crc32(b"\x01" + core[:n]) % mixing.BUCKETS for n in mixing.PREFIXES if len(core) > n))

    doc, unit, count, words = mixing.unit_counts(texts)
    want = Counter((i, u) for i, t in enumerate(texts) for w in t.split() for u in domain(w))
    assert dict(zip(zip(doc.tolist(), unit.tolist()), count.tolist())) == want and words.tolist() == [len(t.split()) for t in texts]

    model = mixing.DomainClassifier(["good", "poor"])
    chosen = np.unique(unit)[::3]
    model.slot[chosen], model.w = np.arange(len(chosen)), r.normal(0, 0.1, (len(chosen), 2))
    z = np.zeros((len(texts), 2))
    for (i, u), n in want.items():
        if model.slot[u] >= 0:
            z[i] += model.w[model.slot[u]] * np.log1p(n)
    got, words = model.posteriors(texts * 2)
    assert np.allclose(got, np.exp(np.vstack([z, z])) / np.exp(np.vstack([z, z])).sum(1, keepdims=True)) and words.tolist() == [len(t.split()) for t in texts] * 2

    calls = []
    monkeypatch.setattr(features, "word_units", lambda w, n, f=features.word_units: calls.append(w) or f(w, n))
    monkeypatch.setattr(mixing, "word_units", features.word_units, raising=False)
    model.posteriors([" ".join(f"word{i}x word{i}y. Word{i}z" for i in range(5000)).encode()])
    assert len(calls) < 10  # one by one 15,000


def test_rows_of_units_are_looked_up_in_bounded_parts():
    """3 MB of texts take no (units, columns) array at once; longer single texts are counted instead."""
    r = np.random.default_rng(6)
    table = r.normal(size=(qc.BUCKETS, 2 * qc.DIM)).astype(np.float32)
    texts = [b" ".join(b"w%d" % i for i in r.integers(0, 3000, n)) for n in [0, 5, 2 * qc.UNITS] + [3000] * 150]
    ids, sizes = features.unit_ids(texts, qc.BUCKETS)
    ends = np.cumsum(sizes)
    tracemalloc.start()
    got = qc.pooled(texts, table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) > 500_000 and peak < 60e6  # at once 164 MB
    want = [table[ids[e - n : e]].astype(np.float64).sum(0) / max(n, 1) for n, e in zip(sizes, ends)]
    assert np.allclose(got, want, atol=1e-5) and not got[0].any()


def test_logits_are_shifted_only_where_they_may_overflow(monkeypatch):
    """Both ways give the same probabilities and the same step; weights beyond the bound do not overflow."""
    r = np.random.default_rng(4)
    ids, sizes = r.integers(0, pl.BUCKETS, 300), np.array([100, 0, 200])
    cls, slot = pl.classes_of(r.normal(size=(pl.BUCKETS, 4)))
    start = pl.initial(np.bincount(ids, minlength=pl.BUCKETS).astype(float), cls, slot)
    ctx = pl.contexts(ids, sizes)

    def made():
        params, sums = [p.copy() for p in start], [np.full(s, 1e-6, np.float32) for s in pl.SHAPES]
        pl.train_step(params, sums, ctx, ids, cls, slot, 0.05)
        return pl.log_probs(start, cls, slot, ids, sizes), pl.pack(params)

    plain = made()
    monkeypatch.setattr(pl, "SAFE_LOGIT", 0.0)
    for a, b in zip(plain, made()):
        assert np.allclose(a, b, atol=1e-4)
    monkeypatch.undo()
    start[4] += 200 * r.random(pl.CLASSES).astype(np.float32)
    assert np.isfinite(made()[0]).all() and np.isfinite(made()[1]).all()


def test_packed_integers_and_keys():
    r = np.random.default_rng(2)
    for a in (np.zeros(0), r.integers(0, 200, 50), r.integers(0, 1 << 62, 9), np.array([0])):
        assert pl.unpack_ints(pl.pack_ints(a.astype(np.uint64))).tolist() == a.astype(np.uint64).tolist()
    for a in (np.zeros(0, np.int64), r.integers(0, 1 << 32, 30)[r.integers(0, 30, 500)]):
        assert pl.unpack_words(pl.pack_words(a)).tolist() == a.tolist()
    hashes, sizes = r.integers(0, 50, 400), np.array([100, 0, 250, 50])
    keys = pl.keys_of(hashes, sizes, 48).reshape(3, -1)
    near = pl.contexts(hashes, sizes, (-1, 1), pl.PADDING)
    for k, names in enumerate(([(w,) for w in hashes], [tuple(x) for x in near], [(w, *x) for w, x in zip(hashes, near)])):
        assert len(set(zip(names, keys[k].tolist()))) == len(set(names)) == len(set(keys[k].tolist()))
    for bits in (40, 60):
        k = r.integers(0, 1 << bits, 5000).astype(np.uint64)[r.integers(0, 3000, 5000)]
        assert pl.places_of(k, bits).tolist() == np.unique(k, return_inverse=True)[1].tolist()
    assert len(pl.places_of(np.zeros(0, np.uint64), 40)) == 0
    assert pl.key_bits(10**13) == 57 and (np.diff(pl.range_edges(7, 57).astype(float)) > 0).all()


def test_classes_follow_neighbours():
    """Equal parts, and buckets with equal neighbours stay together."""
    r = np.random.default_rng(0)
    kinds = r.normal(0, 1, (64, 2 * pl.SIDE))
    sides = np.repeat(kinds, pl.BUCKETS // 64, axis=0) + r.normal(0, 0.02, (pl.BUCKETS, 2 * pl.SIDE))
    cls, slot = pl.classes_of(sides)
    assert np.bincount(cls).tolist() == [pl.MEMBERS] * pl.CLASSES and len(set(zip(cls.tolist(), slot.tolist()))) == pl.BUCKETS
    kind = np.repeat(np.arange(64), pl.BUCKETS // 64)
    pure = [np.bincount(kind[cls == c]).max() / pl.MEMBERS for c in range(pl.CLASSES)]
    assert np.mean(pure) > 0.6


def test_training_step_lowers_loss_and_follows_gradient():
    rng = np.random.default_rng(0)
    cls, slot = pl.classes_of(rng.normal(0, 1, (pl.BUCKETS, 2 * pl.SIDE)))
    params = pl.initial(rng.pareto(1, pl.BUCKETS) * 10, cls, slot)
    ids = rng.integers(0, 50, 200)
    ctx = pl.contexts(ids, np.array([120, 80]))
    loss = lambda ps: -pl.log_probs(ps, cls, slot, ids, np.array([120, 80])).mean()
    before = [p.copy() for p in params]
    sums = [np.full(s, 1e-6, np.float32) for s in pl.SHAPES]
    first = loss(params)
    pl.train_step(params, sums, ctx, ids, cls, slot, 0.05)
    for k in (0, 1, 3, 5, 6):
        grad = (before[k] - params[k]) * np.sqrt(sums[k]) / 0.05
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        up, down = ([p.astype(np.float64) for p in before] for _ in range(2))
        up[k][at] += 1e-3
        down[k][at] -= 1e-3
        assert grad[at] == pytest.approx((loss(up) - loss(down)) / 2e-3, rel=0.05, abs=1e-4), k
    assert loss(params) < first


def test_copies_score_higher(spark):
    """A text that occurs twice is expected from its copy; an equal share of words in another order is not."""
    r = random.Random(6)
    rows = [(i, " ".join(f"w{r.randrange(3000)}" for _ in range(120)), "en", "s", 0) for i in range(200)]
    rows += [(1000 + i, rows[i][1], "en", "s", 0) for i in range(20)]
    got = {x["doc_id"]: x["mean_log_prob"] for x in pl.score_documents(frame(spark, rows)).collect()}
    assert min(got[i] for i in range(20)) > max(got[i] for i in range(20, 200)) + 1


def test_model_prefers_real_order(spark):
    """On text with strict order the trained model scores the order above a shuffle of the same words."""
    r = random.Random(0)
    cycle = WORDS["en"]
    rows = [(i, " ".join(cycle[(i + k) % len(cycle)] for k in range(300)), "en", "s", 0) for i in range(300)]
    shuffled = rows[0][1].split()
    r.shuffle(shuffled)
    rows.append((9999, " ".join(shuffled), "en", "s", 0))
    got = {x["doc_id"]: x["log_prob"] for x in pl.score_documents(frame(spark, rows)).collect()}
    assert got[0] > got[9999]


def test_long_cores_show_all_their_bytes(spark):
    """Pieces of a long core hold each of its n-grams once; a word in the middle changes the features."""
    def units(core):
        ids, first = crf.feature_ids([core])
        return sorted(x for x in ids[first[0] :].ravel().tolist() if x != crf.D)

    r = np.random.default_rng(4)
    for n in (1, 2, 3, 25, 26, 27, 50, 51, 52, 53, 76, 200, 1001):
        core = bytes(r.integers(97, 123, n).astype(np.uint8))
        marked = b"<" + core + b">"
        grams = sum(max(len(marked) - k + 1, 0) for k in (2, 3, 4))
        assert len(units(core)) == grams + 2 * min(n, 3)
    a = b"x" * 20 + b"abcdefghij" + b"y" * 20
    assert units(a) != units(a.replace(b"e", b"z"))
    both = crf.feature_ids([b"ab", a, b"c"])
    assert both[1].tolist() == [0, 1, 3] and len(both[0]) == 4


def test_small_and_huge_training_tables(spark):
    """Ten words teach something; no words at all teach nothing; shares of huge tables are not rounded to none."""
    rows = [(1, "alpha beta gamma", "en", "s", 0), (3, "eins zwei drei vier", "de", "s", 0)]
    model = crf.fit(frame(spark, rows), held_out=99)
    assert model.labels == ["de", "en"] and model.lex.shape == (3, 2)
    assert crf.predict(model, "t1", [b"alpha gamma", b"zwei drei"])[0].to_pylist() == ["en", "de"]
    nothing = crf.fit(frame(spark, [(1, "123 !!!", "en", "s", 0)]), held_out=99)
    assert crf.predict(nothing, "t2", [b"alpha"])[0].to_pylist() == [crf.UND]
    from lanegraph.llm.features import hash_below

    n = spark.range(2_000_000).where(hash_below("id", "x", 120 / 2e8 * 1000)).count()
    assert 800 < n < 1600
    assert spark.range(1).select(hash_below("id", "x", 1.0).alias("b")).first()["b"]
