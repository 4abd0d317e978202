"""Quality rules whose cutoffs are certified on labelled holdouts (risk-controlled thresholds).

Every whole text gets exact counts (``text_counts``). Five ratios of them are the rules; a rule
rejects a document whose ratio reaches a cutoff, and a document goes if any rule rejects it. The
labelled documents of a stratum are halved by a hash of the id. On the first half a nested family of
joint rules is laid out: from "reject nothing", the cutoff that gains most is chosen again and again,
a gain being the share of bad documents newly rejected less ``good_cost`` times that of good ones, and
lowered to step by step.
On the second half, the holdout, the steps are tested in order on the good documents that the joint
rule of all steps so far rejects: a step passes while the exact binomial test rejects "the joint
false rejection rate is above ``alpha``". The fixed order costs nothing within a stratum; across the
S strata that are tested the level is ``delta / S`` (Bonferroni). So with probability 1 - delta no
stratum loses more than ``alpha`` of its good documents by all its rules together. Of the steps
passed those up to the largest gain are in force. A stratum with too few labels to pass anything has no rule; ``certificates``
lists both kinds.

Edge cases: a null text counts as empty (n_words 0: base_failed). A null stratum is a stratum of
its own. Unlabelled rows, null labels and labels for unknown ids are not used for fitting. Each id
counts once in fitting: of repeated labels the largest, of repeated rows the highest ratios, in the
first stratum of its rows. Repeated rows are judged row by row. An empty table gives an empty result.
Other columns are carried by ``filter_documents`` untouched, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanegraph.llm.common import map_texts
from lanegraph.llm.features import drop_live, map_rows
from lanegraph.shared import materialize

WHITE = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
COUNTS_SCHEMA = ", ".join(f"{c} long" for c in COUNTS)
#: Levels of a cutoff: level L rejects a ratio of at least L / LEVELS.
LEVELS = 64
NO_STRATUM = "(none)"


def _repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """Per text, the words that lie in a 5-word window found at least twice in that text."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros(len(words), np.int64)
    total = int(n.sum())
    if total < 6:
        return out
    h = np.fromiter((hash(w) for ws in words for w in ws), np.int64, total).view(np.uint64)
    doc = np.repeat(np.arange(len(words)), n)
    m = total - 4
    mult = np.uint64(0x9E3779B97F4A7C15)
    key = doc[:m].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(5):
        key = (key ^ h[k : k + m]) * mult
        key ^= key >> np.uint64(29)
    inside = np.flatnonzero(doc[:m] == doc[4:])
    key = key[inside]
    s = np.sort(key)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return out
    at = np.searchsorted(twice, key)
    hit = inside[twice[np.minimum(at, len(twice) - 1)] == key]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + 5, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=len(words)).astype(np.int64)


def count_texts(texts: list[bytes]) -> list[np.ndarray]:
    """The COUNTS of each text. Window equality is tested on 64-bit hashes."""
    drop_live()
    words = [t.split() for t in texts]
    n = len(texts)
    of = lambda f: np.fromiter(map(f, texts), np.int64, n)
    lines = np.zeros(n, np.int64)
    dup = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        if words[i]:
            full = [x for x in t.split(b"\n") if x.strip()]
            lines[i] = len(full)
            dup[i] = len(full) - len(set(full))
    return [
        np.fromiter(map(len, words), np.int64, n),
        of(lambda t: len(t.translate(None, CONTINUATION + WHITE))),
        of(lambda t: len(t) - len(t.translate(None, SYMBOLS))),
        dup,
        _repeated_words(words),
        lines,
        of(lambda t: len(t) - len(t.translate(None, UPPER))),
    ]


def text_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the exact counts of each whole text."""
    return map_texts(docs, text, keep, COUNTS_SCHEMA, count_texts)


def base_failed(n_words="n_words", n_repeat="n_repeat_words") -> Column:
    return (F.col(n_words) < 10) | (100 * F.col(n_repeat) > 20 * F.col(n_words))


#: rule -> (numerator, denominator, scale): the ratio numerator / (denominator * scale).
RULES = {
    "symbols": ("n_symbols", "word_chars", 1.0),
    "upper_case": ("n_upper", "word_chars", 1.0),
    "dup_lines": ("n_dup_lines", "n_lines", 1.0),
    "repeats": ("n_repeat_words", "n_words", 1.0),
    "long_words": ("word_chars", "n_words", 32.0),
}


def rule_level(rule: str) -> Column:
    """How many cutoffs the document reaches, 0 to LEVELS."""
    num, den, scale = RULES[rule]
    ratio = F.col(num).cast("double") / F.greatest(F.col(den).cast("double") * F.lit(scale), F.lit(1.0))
    return F.least(F.floor(ratio * F.lit(float(LEVELS))), F.lit(LEVELS)).cast("int")


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exact up to rounding, from the tail on k's side of the mean.

    That tail's terms fall from its first one on, and those more than 40 standard deviations away are lost in rounding.
    """
    if k >= n:
        return 1.0
    if p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    log_p, log_q = math.log(p), math.log1p(-p)
    below = k < n * p
    first = k if below else k + 1
    most = min(first if below else n - first, int(40 * math.sqrt(n * p * (1 - p))) + 1000)
    i = np.arange(most, dtype=np.float64)
    if below:  # P(X = first - i - 1) / P(X = first - i), and upwards likewise
        steps = np.log(first - i) - np.log(n - first + i + 1) + log_q - log_p
    else:
        steps = np.log(n - first - i) - np.log(first + i + 1) + log_p - log_q
    at = math.lgamma(n + 1) - math.lgamma(first + 1) - math.lgamma(n - first + 1) + first * log_p + (n - first) * log_q
    tail = math.exp(at) * (1.0 + float(np.exp(np.cumsum(steps)).sum()))
    return min(1.0, tail) if below else max(0.0, 1.0 - tail)


def certified_steps(rejected: list[int], n: int, alpha: float, level: float) -> int:
    """How many steps pass in order; ``rejected[i]``: of ``n`` good holdout documents those that steps 0 to i reject."""
    for i, k in enumerate(rejected):
        if binomial_cdf(k, n, alpha) > level:
            return i
    return len(rejected)


def nested_steps(good: np.ndarray, bad: np.ndarray, good_cost: float) -> list[tuple[int, int, float]]:
    """(rule, cutoff, gain so far) steps from histograms (rules, LEVELS + 1) of the levels that good and bad documents reach.

    Again and again the rule and cutoff that gain most are chosen, and the cutoff is lowered there through all levels between.
    """
    upto = lambda h: np.cumsum(h[:, ::-1], axis=1)[:, ::-1] / max(1, h[0].sum())  # noqa: E731  share that reaches at least L
    gain = np.hstack([upto(bad) - good_cost * upto(good), np.zeros((len(good), 1))])
    seen = good + bad > 0
    cuts = [LEVELS + 1] * len(gain)
    steps, total = [], 0.0
    while True:
        best, c, r = max(((gain[r, c] - gain[r, cuts[r]], c, r) for r in range(len(gain)) for c in range(1, cuts[r])), default=(0.0, 0, 0))
        if best <= 1e-12:
            return steps
        steps += [(r, x, total + float(gain[r, x] - gain[r, cuts[r]])) for x in range(cuts[r] - 1, c - 1, -1) if x == c or (x <= LEVELS and seen[r, x])]
        total, cuts[r] = steps[-1][2], c


def best_step(steps: list[tuple[int, int, float]], passed: int) -> int:
    """How many of the passed steps to take: those up to the largest gain (all passed ones hold at once, so the choice is free)."""
    return max(range(passed + 1), key=lambda n: (steps[n - 1][2] if n else 0.0, -n))


@dataclass
class Stratum:
    """What was found for a stratum: ``passed`` of its ``steps`` are certified; ``cutoffs`` by rule are in force, ``rejected`` of ``n_good`` holdout documents fall to them."""

    name: str
    steps: int
    passed: int
    n_good: int
    rejected: int
    cutoffs: dict[str, int]


def _first_step(plans: dict[str, list[tuple[int, int, float]]], stratum: Column, levels: Column) -> Column:
    """Number (from 0) of the first step of the stratum's plan that rejects the document; past the last one if none does."""
    out = F.lit(None).cast("int")
    for name, steps in sorted(plans.items()):
        first = np.full((len(RULES), LEVELS + 1), len(steps))
        for i, (rule, cut, _) in reversed(list(enumerate(steps))):
            first[rule, cut:] = np.minimum(first[rule, cut:], i)
        out = F.when(stratum == name, F.least(*[F.get(F.lit(row.tolist()), F.get(levels, F.lit(r))) for r, row in enumerate(first)])).otherwise(out)
    return out


def fit_strata(labelled: DataFrame, key: str, stratum: str, label: str, alpha: float = 0.05, delta: float = 0.05, good_cost: float = 20.0) -> list[Stratum]:
    """Certified joint rules by stratum from labelled rows that hold ``key``, COUNTS, ``stratum`` and ``label`` (1: good).

    All labelled rows count. The driver receives one row per stratum, rule, level and label, and per stratum and step,
    of strata that have labels enough to pass anything.
    """
    one = labelled.where(F.col(label).isin(0, 1) & ~base_failed())
    one = one.select(F.col(key).alias("id"), F.col(stratum).alias("s"), F.col(label).alias("y"), *[rule_level(r).alias(f"l{i}") for i, r in enumerate(RULES)])
    one = one.groupBy("id").agg(F.min("s").alias("s"), F.max("y").alias("y"), F.array(*[F.max(f"l{i}") for i in range(len(RULES))]).alias("levels"))
    holdout = F.crc32(F.concat(F.lit("holdout "), F.col("id").cast("string")).cast("binary")) % 2 == 1
    one = materialize(one.select("s", (F.col("y") == 1).alias("good"), "levels", holdout.alias("holdout")), "labelled")
    least = math.log(delta) / math.log1p(-alpha)  # on fewer good rows no step can pass
    sizes = {r["s"]: r["n"] for r in one.where("good and holdout").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()}
    ready = one.where(F.col("s").isin(list(sizes))) if sizes else one.limit(0)
    hist = {s: np.zeros((2, len(RULES), LEVELS + 1), np.int64) for s in sizes}
    for r in ready.where("not holdout").select("s", "good", F.posexplode("levels").alias("rule", "level")).groupBy("s", "rule", "level", "good").count().collect():
        hist[r["s"]][int(r["good"]), r["rule"], r["level"]] += r["count"]
    plans = {s: nested_steps(h[1], h[0], good_cost) for s, h in hist.items()}
    hit = ready.where("good and holdout").select("s", _first_step(plans, F.col("s"), F.col("levels")).alias("step"))
    falls = {s: np.zeros(len(p), np.int64) for s, p in plans.items()}
    for r in hit.groupBy("s", "step").count().collect():
        if r["step"] < len(falls[r["s"]]):
            falls[r["s"]][r["step"]] += r["count"]
    names = list(RULES)
    tested = max(1, sum(bool(p) for p in plans.values()))
    out = []
    for s, steps in sorted(plans.items()):
        rejected = np.cumsum(falls[s]).tolist()
        passed = certified_steps(rejected, sizes[s], alpha, delta / tested)
        n = best_step(steps, passed)
        out.append(Stratum(s, len(steps), passed, sizes[s], rejected[n - 1] if n else 0, {names[r]: c for r, c, _ in steps[:n]}))
    return out


def certificates(spark: SparkSession, strata: list[Stratum]) -> DataFrame:
    """One row per stratum that had labels enough to be tested; ``passed`` 0: no step could be certified, no rule is in force."""
    rows = [(x.name, x.n_good, x.steps, x.passed, x.rejected, {k: v / LEVELS for k, v in x.cutoffs.items()}) for x in strata]
    return spark.createDataFrame(rows, "stratum string, n_good long, steps int, passed int, rejected long, cutoffs map<string,double>")


def rejected_by_rules(strata: list[Stratum], stratum: Column) -> Column:
    """True if a certified cutoff of the document's stratum rejects it."""
    bad = F.lit(False)
    for x in strata:
        for rule, cut in sorted(x.cutoffs.items()):
            bad = bad | ((stratum == F.lit(x.name)) & (rule_level(rule) >= cut))
    return F.coalesce(bad, F.lit(False))


def _stratum(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NO_STRATUM))


def fit_from_tables(counts: DataFrame, labels: DataFrame, **params) -> list[Stratum]:
    """``counts``: doc_id, __stratum, COUNTS; ``labels``: doc_id, quality."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("__label"))
    return fit_strata(counts.join(marks, "doc_id"), "doc_id", "__stratum", "__label", **params)


def judge_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **params) -> DataFrame:
    """doc_id, COUNTS, base_failed and kept of every document."""
    counts = materialize(text_counts(docs.withColumn("__stratum", _stratum(stratum)), ["doc_id", "__stratum"]), "rules")
    strata = fit_from_tables(counts, labels, **params)
    return counts.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected_by_rules(strata, F.col("__stratum")))


def filter_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **params) -> DataFrame:
    """The documents that the rules keep, every column as it was. The texts are read twice rather than shuffled."""
    source = docs.withColumn("__stratum", _stratum(stratum))
    counts = materialize(text_counts(source, ["doc_id", "__stratum"]), "rules")
    strata = fit_from_tables(counts, labels, **params)
    counted = map_rows(docs, "text", COUNTS_SCHEMA, count_texts).withColumn("__stratum", F.coalesce(F.col("__row")[stratum].cast("string"), F.lit(NO_STRATUM)))
    kept = counted.where(~base_failed() & ~rejected_by_rules(strata, F.col("__stratum")))
    return kept.select("__row.*")
