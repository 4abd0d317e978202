"""Quality scores: random-indexing word vectors, pooled per document, into a two-layer network.

Random indexing: each unit (word core or marks, hashed to ``BUCKETS``) has a fixed sparse index
vector with two signed ones; its context vector adds up the index vectors of the units up to two
places to either side, over all documents. The sums are made by the tasks that read the texts and
added up in two levels of blocks; the result has BUCKETS x DIM floats at every corpus size, so it
can be broadcast. A document is the mean over its units of [unit-length context vector, index vector].

The network (numpy, one hidden layer) learns from at most about ``MAX_LABELLED`` labelled rows,
chosen by a hash of the id: of the rarer label all rows up to half of that, the rest of the other. The
logit is then moved from the sample's odds to those of all labelled rows. A fifth of the sample only
fits the temperature that divides the logit, each row weighing as many labelled rows as it stands for.

Edge cases: null and empty texts have the zero vector and get that vector's score. Labels other
than 0 and 1 or null are ignored; of repeated labels of an id the largest counts; without both
labels in the training rows every score is the share of ones (1.0 if there is none). Repeated rows
are scored row by row. Other columns are never read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanegraph.llm.common import BLOCK_SCHEMA, blocks_of, crc_mod, groups, map_texts, segment_sum, sum_blocks
from lanegraph.llm.features import hash_below, map_rows, unit_ids
from lanegraph.shared import materialize

BUCKETS = 1 << 14
DIM = 32
WINDOW = 2
BLOCKS = 64
UNITS = 1 << 16
MAX_LABELLED = 12_000
HIDDEN = 32
THRESHOLD = 0.3


def index_vectors(buckets: int = BUCKETS, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Places (buckets, 2) and signs (buckets, 2) of each unit's two ones."""
    rng = np.random.default_rng(20240117)
    return rng.integers(0, dim, (buckets, 2)), rng.choice([-1.0, 1.0], (buckets, 2))


def context_sums(ids: np.ndarray, sizes: np.ndarray, place: np.ndarray, sign: np.ndarray, buckets: int = BUCKETS, dim: int = DIM) -> np.ndarray:
    """(buckets * dim) sums of the index vectors of neighbours within WINDOW places in the same text."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros(buckets * dim)
    for o in range(1, WINDOW + 1):
        same = doc[o:] == doc[:-o]
        a, b = ids[:-o][same], ids[o:][same]
        for x, y in ((a, b), (b, a)):
            for k in range(2):
                out += np.bincount(x * dim + place[y, k], sign[y, k], buckets * dim)
    return out


def word_table(docs: DataFrame, text: str = "text") -> np.ndarray:
    """(BUCKETS, 2 * DIM) float32: unit-length context vector and index vector of each unit, from all documents."""
    narrow = docs.select(F.col(text).cast("string").alias("__text"))

    def run(batches):
        place, sign = index_vectors()
        total = None
        for _, texts in groups(batches, "__text"):
            ids, sizes = unit_ids(texts, BUCKETS)
            part = context_sums(ids, sizes, place, sign)
            total = part if total is None else total + part
        if total is not None:
            yield blocks_of(total, BLOCKS, TaskContext.get().partitionId() % 16)

    sums = sum_blocks(narrow.mapInArrow(run, BLOCK_SCHEMA), BUCKETS * DIM, BLOCKS).reshape(BUCKETS, DIM)
    return word_vectors(sums)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    place, sign = index_vectors(len(sums), sums.shape[1])
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    own = np.zeros_like(sums)
    for k in range(2):
        np.add.at(own, (np.arange(len(sums)), place[:, k]), sign[:, k])
    return np.hstack([sums / np.maximum(norm, 1e-9), own]).astype(np.float32)


def pooled(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """(texts, columns) float64 means of the units' rows; zeros for a text without units. Rows of about UNITS units at a time are looked up."""
    ids, sizes = unit_ids(texts, len(table))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty((len(texts), table.shape[1]))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + UNITS, "right")) - 1)
        own = ids[ends[lo] : ends[hi]]
        # One longer text: its rows times how often each is met.
        out[lo:hi] = segment_sum(table[own], sizes[lo:hi]) if len(own) <= UNITS else np.bincount(own, minlength=len(table)) @ table.astype(np.float64)
        lo = hi
    return out / np.maximum(sizes, 1)[:, None]


class Network:
    """Standardised input, one tanh layer, a logit divided by the temperature."""

    def __init__(self, columns: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(columns), np.ones(columns)
        self.p = [rng.normal(0, 1 / np.sqrt(columns), (columns, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.temperature, self.constant = 1.0, None

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.p
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))

    def fit(self, x: np.ndarray, y: np.ndarray, hold: np.ndarray, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4, weight: dict[float, float] | None = None) -> "Network":
        """``hold`` marks the rows that only set the temperature; ``weight`` is how many labelled rows one of each label stands for."""
        weight = weight or {0.0: 1.0, 1.0: 1.0}
        if len(y) == 0 or len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 1.0
            return self
        xs, ys = x[~hold], y[~hold]
        if len(set(ys.tolist())) < 2:
            xs, ys = x, y
        self.mean, self.scale = xs.mean(0), xs.std(0) + 1e-6
        z = (xs - self.mean) / self.scale
        m, v = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p]
        rng, step = np.random.default_rng(11), 0
        for epoch in range(epochs):
            order = rng.permutation(len(ys))
            for lo in range(0, len(ys), 256):
                i = order[lo : lo + 256]
                w1, b1, w2, b2 = self.p
                h = np.tanh(z[i] @ w1 + b1)
                d = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -60, 60))) - ys[i]) / len(i)
                dh = np.outer(d, w2) * (1 - h * h)
                grads = [z[i].T @ dh + decay * w1, dh.sum(0), h.T @ d + decay * w2, np.array([d.sum()])]
                step += 1
                r = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.02)
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - r * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p[3] = self.p[3] + np.log(weight[1.0] / weight[0.0])
        xh, yh = (x[hold], y[hold]) if hold.any() else (xs, ys)
        wh = np.where(yh > 0.5, weight[1.0], weight[0.0])
        t = np.geomspace(0.25, 8, 121)
        logits = self.logit(xh)
        loss = [np.average(np.logaddexp(0, np.where(yh > 0.5, -1, 1) * logits / k), weights=wh) for k in t]
        self.temperature = float(t[int(np.argmin(loss))])
        return self


def training_labels(labels: DataFrame, mod: int | None) -> DataFrame:
    """doc_id, y: labels 0 and 1, without the rows held out (crc32 of the id as text mod ``mod`` is 0)."""
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if mod:
        rows = rows.where(crc_mod("doc_id", mod) != 0)
    return rows.groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))


def label_sample(rows: DataFrame, bound: int) -> tuple[DataFrame, dict[float, float]]:
    """About ``bound`` of ``rows`` (doc_id, y) at most, and how many rows one of each label stands for.

    Of the rarer label all rows up to half the bound, of the other what is left; chosen by a hash of the id.
    """
    sizes = {0.0: 0, 1.0: 0} | {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if sum(sizes.values()) <= bound:
        return rows, {0.0: 1.0, 1.0: 1.0}
    rare = min(sizes, key=sizes.get)
    take = {rare: min(sizes[rare], bound // 2)}
    take[1 - rare] = min(sizes[1 - rare], bound - take[rare])
    share = {y: take[y] / n if n else 1.0 for y, n in sizes.items()}
    chosen = rows.where(hash_below("doc_id", "quality", F.when(F.col("y") == 1, F.lit(share[1.0])).otherwise(F.lit(share[0.0]))))
    return chosen, {y: 1 / x if x else 1.0 for y, x in share.items()}


def fit(docs: DataFrame, labels: DataFrame, held_out_mod: int | None = 5, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, Network]:
    table = word_table(docs)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(table)
    present = training_labels(labels, held_out_mod).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sample, weight = label_sample(materialize(present, "labelled"), max_labelled)
    # The sample has a bounded number of narrow rows, so it may be broadcast; texts stay where they are.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = map_texts(chosen, "text", ["doc_id", "y"], "x binary", lambda texts: [_packed(pooled(texts, sent.value))]).toArrow()
    order = np.lexsort((np.asarray(rows["y"]), np.asarray(rows["doc_id"])))
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, table.shape[1]).astype(np.float64)[order]
    y = np.asarray(rows["y"], np.float64)[order]
    ids = [str(i).encode() for i in np.asarray(rows["doc_id"])[order].tolist()]
    hold = np.array([zlib.crc32(b"t" + i) % 5 == 0 for i in ids], bool)
    return table, Network(table.shape[1]).fit(x, y, hold, weight=weight)


def _packed(x: np.ndarray):
    import pyarrow as pa

    return pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())


def score_documents(docs: DataFrame, labels: DataFrame, held_out_mod: int | None = 5) -> DataFrame:
    """doc_id and score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, held_out_mod))
    return map_texts(docs, "text", ["doc_id"], "score double", lambda texts: [sent.value[1].score(pooled(texts, sent.value[0]))])


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, every column as it was."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    scored = map_rows(docs, "text", "score double", lambda texts: [sent.value[1].score(pooled(texts, sent.value[0]))])
    return scored.where(F.col("score") >= threshold).select("__row.*")
