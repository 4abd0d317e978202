"""Mixing to target weights by soft membership.

A classifier learned from the label table gives every document posteriors over the domains that the
table marks (the pairs of quality and toxicity). Nonnegative rates are then sought for all documents
so that each domain's expected tokens, sum of rate * posterior * tokens, meet its target, staying as
near to rate 1 as that allows:

    min over r >= 0 of  1/2 sum_k ((sum_i w_i p_ik r_i - t_k)^2 / q_k) + ridge/2 sum_i w_i (r_i - 1)^2

with w_i the document's share of all tokens, q_k the domain's present share and t_k its target. The
projected gradient step (with momentum) of a document depends on the others only through one number
per domain, so an iteration is one distributed sum; a document's rate is replayed from the numbers
of the iterations before. A document is then taken floor(rate + u) times, u a hash of its id in [0, 1).

Classifier: log(1 + count) of the FEATURES units (word cores, marks, and the first PREFIXES bytes of longer
cores) that differ most between domains, in a softmax regression; fitted on at most about MAX_LABELLED
labelled rows.

Edge cases: null and empty texts have no tokens, weigh nothing, and keep rate and copies 1. Null
labels and labels other than 0 and 1 are ignored; without labels there is one domain and all rates
are 1. A domain with no expected tokens keeps no target. Repeated rows are rated row by row, alike.
Other columns are only carried. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanegraph.llm.common import map_texts
from lanegraph.llm.features import bounded_sample, coded_words, drop_live, map_rows, units_of_words
from lanegraph.shared import materialize

BUCKETS = 1 << 16
FEATURES = 1024
PREFIXES = (4, 6)
#: So many texts are counted at once.
TEXTS = 512
MAX_LABELLED = 8_000
RIDGE = 0.005
ROUNDS = 24
#: Target share of each domain (quality, toxic) relative to the others; see ``targets_for``.
TARGETS = {"good": 0.97, "good_toxic": 0.02, "poor": 0.01, "poor_toxic": 0.0}
NAMES = {(1, 0): "good", (1, 1): "good_toxic", (0, 0): "poor", (0, 1): "poor_toxic"}


def domain_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units (-1: none) of each distinct word, each word's place among those, and each text's number of words."""
    drop_live()
    words, place, n = coded_words(texts)
    return units_of_words(words, BUCKETS, PREFIXES), place, n


def unit_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, unit and count of every unit of every text, and each text's number of words."""
    units, place, words = domain_units(texts)
    ids = units[place]
    key = (np.repeat(np.arange(len(texts)), words)[:, None] * BUCKETS + ids)[ids >= 0]
    found, count = np.unique(key, return_counts=True)
    return found // BUCKETS, found % BUCKETS, count, words


class DomainClassifier:
    """Softmax regression on log counts of chosen units."""

    def __init__(self, domains: list[str]):
        self.domains = domains
        self.slot = np.full(BUCKETS, -1, np.int32)
        self.w = np.zeros((0, len(domains)))
        self.b = np.zeros(len(domains))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 200, rate: float = 0.05, decay: float = 1e-3) -> "DomainClassifier":
        """``rows``: units and counts of each labelled text."""
        k, n = len(self.domains), len(y)
        if k < 2 or not n:
            return self
        one, two, df = np.zeros((k, BUCKETS)), np.zeros((k, BUCKETS)), np.zeros(BUCKETS)
        for (u, c), d in zip(rows, y):
            v = np.log1p(c)
            one[d, u] += v
            two[d, u] += v * v
            df[u] += 1
        per = np.maximum(np.bincount(y, minlength=k), 1)[:, None]
        other = np.maximum(n - per, 1)
        mean, rest = one / per, (one.sum(0) - one) / other
        var, rest_var = two / per - mean**2, (two.sum(0) - two) / other - rest**2
        z = np.abs(mean - rest) / np.sqrt(np.maximum(var, 0) / per + np.maximum(rest_var, 0) / other + 1.0 / n**2)
        z[:, df < 3] = 0
        chosen: set[int] = set()
        for c in range(k):  # the strongest units of each domain
            chosen.update(np.argsort(-z[c], kind="stable")[: FEATURES // k].tolist())
        self.slot[sorted(chosen)] = np.arange(len(chosen))
        x = np.zeros((n, len(chosen)), np.float32)
        for i, (u, c) in enumerate(rows):
            s = self.slot[u]
            x[i, s[s >= 0]] = np.log1p(c[s >= 0])
        self.w = np.zeros((len(chosen), k))
        m = [np.zeros_like(self.w), np.zeros(k)]
        v = [np.zeros_like(self.w), np.zeros(k)]
        gold = np.eye(k, dtype=np.float32)[y]
        for step in range(1, epochs + 1):
            d = ((self._softmax(x @ self.w.astype(np.float32) + self.b) - gold) / n).astype(np.float32)
            for j, (p, g) in enumerate(((self.w, x.T @ d + decay / n * self.w), (self.b, d.sum(0)))):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.99 * v[j] + 0.01 * g * g
                p -= rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)
        return self

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def posteriors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, domains) probabilities, and each text's number of words."""
        units, place, words = domain_units(texts)
        z = np.tile(self.b, (len(texts), 1))
        n = len(self.w)
        if n:
            slots = np.where(units >= 0, self.slot[units], -1)
            ends = np.concatenate([[0], np.cumsum(words)])
            for lo in range(0, len(texts), TEXTS):
                size = words[lo : lo + TEXTS]
                own = slots[place[ends[lo] : ends[lo + len(size)]]]
                counts = np.bincount((np.repeat(np.arange(len(size)) * n, size)[:, None] + own)[own >= 0], minlength=len(size) * n)
                full = np.flatnonzero(counts)
                d, f, v = full // n, full % n, np.log1p(counts[full])
                for c in range(len(self.domains)):
                    z[lo : lo + len(size), c] += np.bincount(d, self.w[f, c] * v, len(size))
        return self._softmax(z), words


def fit_domains(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DomainClassifier:
    name = F.lit(None).cast("string")
    for (q, t), d in NAMES.items():
        name = F.when((F.col("quality") == q) & (F.coalesce(F.col("toxic"), F.lit(0)) == t), F.lit(d)).otherwise(name)
    marked = labels.where(F.col("doc_id").isNotNull()).select("doc_id", name.alias("domain")).where("domain is not null")
    marked = marked.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sample = bounded_sample(marked, "doc_id", max_labelled, "domains")
    # Bounded and narrow, so it may be broadcast; texts stay where they are.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def units(texts: list[bytes]):
        doc, unit, count, _ = unit_counts(texts)
        cut = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])
        lists = lambda a: pa.array([a[x:y].astype(np.int32) for x, y in zip(cut, cut[1:])], pa.list_(pa.int32()))
        return [lists(unit), lists(count)]

    rows = map_texts(chosen, "text", ["doc_id", "domain"], "units array<int>, counts array<int>", units).toArrow()
    ids, names = rows["doc_id"].to_pylist(), rows["domain"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (str(ids[i]), names[i]))
    domains = [d for d in NAMES.values() if d in set(names)] or ["good"]
    y = np.array([domains.index(names[i]) for i in order], np.int64)
    # Views of the Arrow buffers: lists of Python numbers would take many times the memory.
    lists = [rows[c].combine_chunks() for c in ("units", "counts")] if len(ids) else []
    cuts, flat = ([x.offsets.to_numpy() for x in lists], [x.values.to_numpy() for x in lists]) if lists else ([], [])
    return DomainClassifier(domains).fit([tuple(f[c[i] : c[i + 1]] for c, f in zip(cuts, flat)) for i in order], y)


def replay(p: np.ndarray, history: list[np.ndarray], ridge: float, eta: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates of documents with posteriors ``p`` after the steps in ``history``, and the point of the next gradient."""
    r = np.ones(len(p))
    y, a = r.copy(), 1.0
    for g in history:
        new = np.maximum(y - eta * (p @ g + ridge * (y - 1)), 0.0)
        b = (1 + np.sqrt(1 + 4 * a * a)) / 2
        y = new + (a - 1) / b * (new - r)
        r, a = new, b
    return r, y


def solve_rates(members: DataFrame, k: int, target: dict[int, float], anchor: int, ridge: float = RIDGE, rounds: int = ROUNDS) -> tuple[list[np.ndarray], float, np.ndarray]:
    """Projected gradient over ``members`` (n_tokens, p array<double>): gradients by round, step size, final totals."""
    eta = 1.0 / (1.0 + ridge)
    sums = lambda c: [F.sum(F.col("n_tokens") * F.col("p")[j] * c).alias(f"s{j}") for j in range(k)]
    now = members.agg(F.sum("n_tokens").alias("t"), *sums(F.lit(1.0))).first()
    total = float(now["t"] or 0)
    if not total:
        return [], eta, np.zeros(k)
    q = np.array([now[f"s{j}"] or 0.0 for j in range(k)]) / total
    goal = targets_for(q, target, anchor)
    live = q > 1e-9
    history: list[np.ndarray] = []
    totals = q.copy()
    for _ in range(rounds):
        # ``totals`` are those of the extrapolated point of this round.
        history.append(np.where(live, (totals - goal) / np.where(live, q, 1.0), 0.0))

        def part(batches, history=tuple(history)):
            out = np.zeros((2, k))
            for b in batches:
                p = np.asarray(b.column(1).flatten(), np.float64).reshape(-1, k)
                w = np.asarray(b.column(0), np.float64)
                r, y = replay(p, list(history), ridge, eta)
                out += np.stack([(w * r) @ p, (w * y) @ p])
            yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], names=["s"])

        shares = members.select("n_tokens", "p").mapInArrow(part, "s array<double>")
        row = shares.agg(*[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(2 * k)]).first()
        both = np.array(row, float).reshape(2, k) / total
        done = np.abs(both[0] - goal)[live].max() < 1e-4 * max(goal.max(), 1e-9)
        final, totals = both
        if done and len(history) > 3:
            break
    return history, eta, final


def targets_for(q: np.ndarray, target: dict[int, float], anchor: int) -> np.ndarray:
    """Token shares to aim for: the anchor domain keeps its tokens, the others get theirs in the given proportion, scarce ones by repetition.

    Only a domain without any expected tokens gets none, as no rate can raise it.
    """
    weight = np.array([target.get(j, 0.0) for j in range(len(q))])
    if weight[anchor] <= 0 or q[anchor] <= 0:
        weight = weight / max(weight.sum(), 1e-12)
        return np.where(q > 0, weight, 0.0)
    return np.where(q > 0, weight * q[anchor] / weight[anchor], 0.0)


def _copies(rate, doc_id):
    u = F.pmod(F.xxhash64(doc_id.cast("string"), F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + u).cast("int")


def _solve(docs: DataFrame, labels: DataFrame, targets: dict[str, float], anchor: str):
    model = fit_domains(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    k = len(model.domains)

    def of(texts: list[bytes]):
        p, words = sent.value.posteriors(texts)
        return [words, pa.array(list(p), pa.list_(pa.float64()))]

    members = materialize(map_texts(docs, "text", ["doc_id"], "n_tokens long, p array<double>", of), "members")
    at = model.domains.index(anchor) if anchor in model.domains else 0
    goal = {model.domains.index(d): w for d, w in targets.items() if d in model.domains}
    history, eta, final = solve_rates(members, k, goal, at) if k > 1 else ([], 1.0, np.ones(1))
    return model, members, history, eta


def _rates(p: np.ndarray, words: np.ndarray, history: list[np.ndarray], eta: float) -> np.ndarray:
    return np.where(words > 0, replay(p, history, RIDGE, eta)[0], 1.0)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, anchor: str = "good") -> DataFrame:
    """doc_id, n_tokens, posterior of each domain, rate, and copies to take, for every document."""
    model, members, history, eta = _solve(docs, labels, targets, anchor)
    k = len(model.domains)
    kind = members.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            p = np.asarray(b.column(2).flatten(), np.float64).reshape(-1, k)
            rate = _rates(p, np.asarray(b.column(1)), history, eta)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rate)], names=["doc_id", "n_tokens", "p", "rate"])

    rated = members.mapInArrow(run, f"doc_id {kind}, n_tokens long, p array<double>, rate double")
    shown = [F.col("p")[j].alias(f"p_{d}") for j, d in enumerate(model.domains)]
    return rated.select("doc_id", "n_tokens", *shown, "rate", _copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def domain_totals(mixed: DataFrame, targets: dict[str, float] = TARGETS, anchor: str = "good") -> dict[str, dict[str, float]]:
    """From ``mix``'s rows, each domain's expected tokens as they are (present), as asked for (target), and as the rates make them (reached)."""
    domains = [d for d in NAMES.values() if f"p_{d}" in mixed.columns]
    sums = [F.coalesce(F.sum(F.col("n_tokens") * F.col(f"p_{d}") * r), F.lit(0.0)) for r in (F.lit(1.0), F.col("rate")) for d in domains]
    present, reached = np.array(mixed.agg(*sums).first(), float).reshape(2, -1)
    total = max(present.sum(), 1e-9)
    goal = targets_for(present / total, {j: targets.get(d, 0.0) for j, d in enumerate(domains)}, domains.index(anchor) if anchor in domains else 0)
    return {d: {"present": a, "target": b * total, "reached": c} for d, a, b, c in zip(domains, present, goal, reached)}


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, anchor: str = "good") -> DataFrame:
    """The documents, each taken as often as its rate says, every column as it was."""
    model, _, history, eta = _solve(docs, labels, targets, anchor)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def of(texts: list[bytes]):
        p, words = sent.value.posteriors(texts)
        return [_rates(p, words, history, eta)]

    rated = map_rows(docs, "text", "rate double", of)
    copies = _copies(F.col("rate"), F.col("__row")["doc_id"])
    taken = rated.select("__row", F.explode(F.array_repeat(F.lit(1), copies)).alias("__one"))
    return taken.select("__row.*")
