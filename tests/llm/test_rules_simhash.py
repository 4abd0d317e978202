import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from lanegraph.llm import quality_rules as qr
from lanegraph.llm import simhash as sh
from tests.llm.fixtures import DOCS, clashing, documents, frame

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, c in Counter(windows).items() if c > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return [len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered)]


def test_counts_equal_brute_force(spark):
    rows = documents(3)
    r = random.Random(5)
    rows += [(1000 + i, " ".join(r.choice("abc") for _ in range(r.randrange(0, 60))), "en", "s", 0) for i in range(40)]
    got = qr.text_counts(clashing(frame(spark, rows)), ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for g in got:
        assert [g[c] for c in qr.COUNTS[:5]] == brute_counts(g["text"]), g["text"]
    assert qr.count_texts(["a b c d e \xe9 f".encode()] * 2)[0].tolist() == [7, 7]


def test_binomial_and_certificates():
    exact = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for k, n, p in ((0, 50, 0.01), (3, 100, 0.05), (10, 40, 0.3), (40, 40, 0.3)):
        assert qr.binomial_cdf(k, n, p) == pytest.approx(exact(k, n, p), rel=1e-9)
    import numpy as np

    assert qr.certified_steps([0, 0, 300], 2000, 0.01, 0.001) == 2
    assert qr.certified_steps([0], 20, 0.01, 0.001) == 0 and qr.certified_steps([], 20, 0.01, 0.001) == 0
    good, bad = np.zeros((2, 2, qr.LEVELS + 1), np.int64)
    good[:, 0], bad[:, 0] = 1000, 50
    bad[0, 30], bad[1, 40], good[1, 35], bad[1, 35] = 50, 30, 1000, 20
    assert [x[:2] for x in qr.nested_steps(good, bad, 5.0)] == [(0, 30), (1, 40)]
    assert [x[:2] for x in qr.nested_steps(good, bad, 0.5)] == [(0, 30), (1, 40)]


def test_binomial_of_many_rows():
    """k far above and on both sides of n * p, where the mode is more terms away than the lower sum used to reach."""
    import numpy as np

    n = 1_000_000
    for k, p in ((9_900, 0.01), (9_999, 0.01), (10_000, 0.01), (10_100, 0.01)):
        z = (k + 0.5 - n * p) / math.sqrt(n * p * (1 - p))
        assert qr.binomial_cdf(k, n, p) == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=2e-3)
        assert qr.binomial_cdf(k, n, p) == pytest.approx(1 - qr.binomial_cdf(n - k - 1, n, 1 - p), abs=1e-7)
    for k, n in ((40_000, 1_000_000), (60_000, 3_000_000), (29_600, 400_000), (30_000, 60_000)):
        assert qr.binomial_cdf(k, n, 0.01) == pytest.approx(1.0)
    assert qr.binomial_cdf(5_000, 1_000_000, 0.01) < 1e-100
    assert qr.certified_steps([1_000, 30_000], 400_000, 0.01, 0.001) == 1  # 0.25 % and 7.5 %
    for n, sd in ((10**10, 3), (10**12, 3)):
        assert qr.binomial_cdf(int(n * 0.01 + sd * math.sqrt(n * 0.01 * 0.99)), n, 0.01) == pytest.approx(0.99865, abs=1e-3)


def test_joint_false_rejections_stay_below_alpha():
    """Over many draws the share of runs whose joint rule rejects more than alpha of all good documents stays below delta."""
    import numpy as np

    rng, above, alpha = np.random.default_rng(1), 0, 0.05
    draw = lambda n, scale: np.minimum(rng.exponential(scale, (len(qr.RULES), n)).astype(int), qr.LEVELS)
    hist = lambda x: np.stack([np.bincount(row, minlength=qr.LEVELS + 1) for row in x])
    truth, inforce = draw(100_000, 4), 0
    for _ in range(150):
        steps = qr.nested_steps(hist(draw(150, 4)), hist(draw(150, 6)), 1.0)
        held = draw(300, 4)
        at = [np.any([held[r] >= c for r, c, _ in steps[: i + 1]], axis=0).sum() for i in range(len(steps))]
        passed = steps[: qr.certified_steps([int(x) for x in at], 300, alpha, 0.05)]
        inforce += bool(passed)
        above += bool(passed) and np.any([truth[r] >= c for r, c, _ in passed], axis=0).mean() > alpha
    assert inforce > 50 and above <= 150 * 0.05 + 6


def test_judge_and_filter(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(3000):
        junk = i % 6 == 0
        words = [f"w{r.randrange(10**6)}" + ("###" if junk else "") for _ in range(30)]
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 0 if junk else 1, 0))
    rows += [(9000, None, None, "s", None), (9001, "short", "xx", "s", 0), (None, "### " * 40, "en", "s", 0)]
    docs, marks = clashing(frame(spark, rows)), spark.createDataFrame(labels + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    judged = {x["doc_id"]: x["kept"] for x in qr.judge_documents(docs, marks).collect()}
    assert all(judged[i] == (i % 6 != 0) for i in range(3000)) and not judged[9000] and not judged[9001]
    kept = qr.filter_documents(docs, marks)
    assert kept.columns == docs.columns and kept.count() == 2500
    empty = frame(spark, [], DOCS)
    assert qr.judge_documents(empty, marks).count() == 0 and qr.filter_documents(empty, marks).count() == 0
    assert qr.judge_documents(docs, marks.limit(0)).where("kept").count() == 3000


def test_repeated_labels_count_once(spark):
    """One document labelled a thousand times certifies nothing; strata with too few labels have no rule and say so."""
    words = lambda i, mark: " ".join(f"w{i}x{k}{mark}" for k in range(30))
    rows = [(i, words(i, "###" if i % 5 == 0 else ""), "en" if i < 400 else "de", "s", 0) for i in range(440)]
    marks = [(i, int(i % 5 != 0), 0) for i in range(440)]
    few = spark.createDataFrame([marks[1]] * 1000 + [marks[0]] * 1000, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + rows[:3])
    counts = qr.text_counts(docs.withColumn("__stratum", F.col("lang")), ["doc_id", "__stratum"])
    assert qr.fit_from_tables(counts, few) == []
    found = qr.fit_from_tables(counts, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert [x.name for x in found] == ["en"] and found[0].passed and found[0].rejected == 0
    assert "symbols" in qr.certificates(spark, found).first()["cutoffs"]


def brute_print(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    """prints: list of (id, fp). Smallest id that is reachable over links of at most two bits."""
    rows = list(prints)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for k in range(i):
            if bin(rows[i][1] ^ rows[k][1]).count("1") <= 2 or (rows[i][0] is not None and rows[i][0] == rows[k][0]):
                parent[find(i)] = find(k)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(rows))]


def test_fingerprints_and_groups(spark):
    rows = documents(7)
    got = [(g["doc_id"], g["fp"] & (2**64 - 1), g["component_id"]) for g in sh.group_documents(clashing(frame(spark, rows))).collect()]
    assert Counter((d, f) for d, f, _ in got) == Counter((r[0], brute_print(r[1])) for r in rows)
    want = brute_components([(d, f) for d, f, _ in got])
    assert [c for _, _, c in got] == want
    assert sh.group_documents(frame(spark, [], DOCS)).count() == 0


@pytest.mark.parametrize("limit", [2, 24])
def test_links_keep_all_components(spark, limit):
    """Random chains and crowds of fingerprints; a small cell limit sends most of them the way of full cells."""
    r = random.Random(limit)
    prints = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(25):
            prints.add(x)
            x ^= 1 << r.randrange(64)
            if r.random() < 0.5:
                x ^= 1 << r.randrange(64)
            if r.random() < 0.1:
                x = r.getrandbits(64)
    rows = [(i, sh._signed(x)) for i, x in enumerate(sorted(prints))]
    r.shuffle(rows)
    points = spark.createDataFrame(rows, "node long, fp long")
    stars = {u: v for u, v in sh.components(sh.links(points, limit)).collect()}
    want = brute_components([(i, x & (2**64 - 1)) for i, x in rows])
    assert [stars.get(i, i) for i, _ in rows] == want
    for u, v in sh.links(points, limit).collect():
        assert bin((dict(rows)[u] ^ dict(rows)[v]) & (2**64 - 1)).count("1") <= 2


def test_embedding_bounds_distance(spark):
    r = random.Random(4)
    pairs = [(sh._signed(a), sh._signed(a ^ sum(1 << r.randrange(64) for _ in range(r.randrange(5))))) for a in (r.getrandbits(64) for _ in range(200))]
    df = spark.createDataFrame(pairs, "a long, b long")
    found = df.select("a", "b", sh.manhattan(sh.embedding(F.col("a")), sh.embedding(F.col("b"))).alias("m")).collect()
    for a, b, m in found:
        count = lambda x: [bin(x >> (2 * s) & 3).count("1") for s in range(32)]
        assert m == sum(abs(p - q) for p, q in zip(count(a & (2**64 - 1)), count(b & (2**64 - 1)))) <= bin((a ^ b) & (2**64 - 1)).count("1")


def brute_near(rows):
    """Component (smallest id) of each row: single linkage of 5-word shingle sets with Jaccard of at least 0.8, equal texts, equal ids."""
    words = [tuple((t or "").lower().split()) for _, t in rows]
    sets = [{w[i : i + 5] for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if words[i] == words[k] or (both and both >= 0.8 * (len(sets[i]) + len(sets[k]) - both)) or (rows[i][0] is not None and rows[i][0] == rows[k][0]):
                parent[find(i)] = find(k)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(rows))]


def near_copies(r, words, share, step=1):
    """The words with single ones replaced until the 5-word sets are about as similar as asked for."""
    w = list(words)
    sets = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    base = sets(w)
    while True:
        trial = list(w)
        trial[r.randrange(len(w))] = f"new{r.randrange(10**9)}"
        now = sets(trial)
        if len(base & now) < share * len(base | now):
            return w
        w = trial


def test_near_copies_are_grouped(spark):
    """Pairs planted at 0.8 to 0.95, and a crowd of variants of one text that overfills its cells: components as by brute force."""
    r = random.Random(12)
    word = lambda: f"w{r.randrange(5000)}"
    rows, pairs = [(d, t) for d, t, *_ in documents(5, 25)], []
    for k in range(60):
        base = [word() for _ in range(r.randrange(80, 250))]
        rows += [(1000 + 2 * k, " ".join(base)), (1001 + 2 * k, " ".join(near_copies(r, base, (0.8, 0.85, 0.9, 0.95)[k % 4])))]
    crowd = [word() for _ in range(150)]
    rows += [(5000 + k, " ".join(near_copies(r, crowd, 0.88))) for k in range(90)]
    r.shuffle(rows)
    docs = clashing(frame(spark, [(d, t, "en", "s", 0) for d, t in rows]))
    want = brute_near(rows)
    got = sh.near_documents(docs).collect()
    least, seen = dict(zip([d for d, _ in rows], want)), Counter()
    assert len(got) == len(rows)
    for g in got:
        if g["doc_id"] is not None:
            seen[g["component_id"] == least[g["doc_id"]]] += 1
    assert seen[False] == 0, seen
    kept = sh.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(x for x in (k["doc_id"] for k in kept.collect()) if x is not None) == sorted({c for (d, _), c in zip(rows, want) if d is not None})
    assert kept.where("doc_id is null").count() == sum(d is None for d, _ in rows)
    assert sh.keep_one(frame(spark, [], DOCS)).count() == 0 and sh.near_documents(frame(spark, [], DOCS)).count() == 0
    none = frame(spark, [(None, "a b", "en", "s", 0), (None, None, None, None, None)])
    assert sh.keep_one(none).count() == 2


def test_samples_are_min_wise():
    """The chance that two texts agree in a sample is about the fourth power of their similarity."""
    r = random.Random(3)
    same = []
    for _ in range(150):
        base = [f"w{r.randrange(10**6)}" for _ in range(120)]
        a, b = (sh.sketch_texts([" ".join(x).encode()])[2].to_pylist()[0] for x in (base, near_copies(r, base, 0.8)))
        same += [x == y for x, y in zip(a, b)]
    assert 0.33 < sum(same) / len(same) < 0.52
    assert sh.sketch_texts([b"", b"one two"])[2].to_pylist()[0] is None


def test_long_chain_components(spark):
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 40)] + [(100, 50)], "u long, v long")
    got = {u: v for u, v in sh.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 40)} | {100: 50}


def templated(r, similarity, texts, pairs, start):
    """Texts of one template whose shingle sets are all ``similarity`` alike, and pairs among them planted at 0.8 to 0.95."""
    size = 160
    share = 2 * similarity / (1 + similarity)
    word = lambda: f"v{r.randrange(10**6)}"
    head = [word() for _ in range(round(share * size) + 4)]
    rows, planted = [], []
    for k in range(texts):
        own = [word() for _ in range(size - len(head) + 4)]
        rows.append((start + 2 * k, head + own))
        if k < pairs:
            alike = r.uniform(max(0.805, similarity + 0.01), 0.95)
            same = round(2 * alike / (1 + alike) * size) + 5
            rows.append((start + 2 * k + 1, (head + own)[:same] + [word() for _ in range(size + 4 - same)]))
            planted.append((start + 2 * k, start + 2 * k + 1))
    return [(d, " ".join(w)) for d, w in rows], planted


def test_near_copies_within_crowds_of_one_template(spark):
    """Crowds that are less alike than near copies are, from three templates at once: the pairs in them are found, and nothing else is joined."""
    r = random.Random(21)
    rows, planted = [], []
    for i, similarity in enumerate((0.65, 0.75, 0.79)):
        a, b = templated(r, similarity, 250, 50, 10_000 * i)
        rows, planted = rows + a, planted + b
    r.shuffle(rows)
    want = dict(zip([d for d, _ in rows], brute_near(rows)))
    assert all(want[a] == want[b] for a, b in planted)
    got = {g["doc_id"]: g["component_id"] for g in sh.near_documents(frame(spark, [(d, t, "en", "s", 0) for d, t in rows])).collect()}
    found = sum(got[a] == got[b] for a, b in planted)
    assert found >= 0.98 * len(planted), found
    assert sum(got[d] != want[d] for d in got) <= 2 * (len(planted) - found)


@pytest.mark.parametrize("seed", range(3))
def test_links_of_crowds_connect_what_all_pairs_do(spark, seed):
    """Sets of templates with tiers of common shingles and of differing length, with a limit of two a shingle: components as by all pairs."""
    r = random.Random(seed)
    sets = []
    for i in range(90):
        tiers = [range(40)] + [range(1000 * (1 + t), 1000 * (1 + t) + 12) for t in range(3) if r.random() < 0.4]
        own = [10**6 + 100 * i + j for j in range(r.choice([0, 0, 1, 4, 9, 14]))]
        sets.append((i.to_bytes(2), i, sorted({x for t in tiers for x in t} | set(own)), i))
    find = list(range(90))

    def root(x):
        while find[x] != x:
            x = find[x]
        return x

    for i in range(90):
        for j in range(i):
            a, b = set(sets[i][2]), set(sets[j][2])
            if len(a & b) >= 0.8 * len(a | b) - 1e-9:
                find[root(i)] = root(j)
    links = sh.crowd_links(spark.createDataFrame(sets, "seq binary, node long, shingles array<long>, component_id long"), 0.8, 2).collect()
    for u, v in links:
        a, b = (set(sets[int.from_bytes(x)][2]) for x in (u, v))
        assert len(a & b) >= 0.8 * len(a | b) - 1e-9
    made = list(range(90))

    def top(x):
        while made[x] != x:
            x = made[x]
        return x

    for u, v in links:
        made[top(int.from_bytes(u))] = top(int.from_bytes(v))
    assert len({(root(i), top(i)) for i in range(90)}) == len({root(i) for i in range(90)}) == len({top(i) for i in range(90)}) > 1


@pytest.mark.parametrize("rows", [7, 2048])
def test_sets_alike_in_frequent_shingles_of_their_own_are_linked(spark, monkeypatch, rows):
    """Every shingle is frequent and no two sets have the same ones: components as by all pairs, in one block or in many."""
    monkeypatch.setattr(sh, "BLOCK_ROWS", rows, raising=False)
    r = random.Random(9)
    sets = [(i.to_bytes(2), i, sorted(r.sample(range(34), r.randrange(22, 29))), i % 50) for i in range(60)]
    assert len({tuple(s) for _, _, s, _ in sets}) == 60
    alike = lambda i, j: len({*sets[i][2]} & {*sets[j][2]}) >= 0.8 * len({*sets[i][2]} | {*sets[j][2]}) - 1e-9

    def roots(pairs):
        find = list(range(60))

        def root(x):
            while find[x] != x:
                x = find[x]
            return x

        for a, b in [*pairs, *((i, i - 50) for i in range(50, 60))]:  # ten groups of two sets are known before
            find[root(a)] = root(b)
        return [root(i) for i in range(60)]

    want = roots([(i, j) for i in range(60) for j in range(i) if alike(i, j)])
    found = sh.crowd_links(spark.createDataFrame(sets, "seq binary, node long, shingles array<long>, component_id long"), 0.8, 2).collect()
    pairs = [(int.from_bytes(u), int.from_bytes(v)) for u, v in found]
    assert all(alike(i, j) for i, j in pairs)
    got = roots(pairs)
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got)) and 1 < len(set(want)) < 50
