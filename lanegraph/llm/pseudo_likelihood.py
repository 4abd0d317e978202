"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

A token is a word, known by a 32-bit hash of its lower-cased core. Its probability given both sides is

    p(w | sides) = (c(l, w, r) - 1 + k * q(w | sides)) / (c(l, r) - 1 + k)

where l and r are the words next to it, c counts in the whole corpus (less the occurrence itself, so
a text is no evidence for itself), and q is the network's: q = p(class | sides) * p(bucket | class,
sides) * c(w) / c(bucket). The network reads the buckets (BUCKETS hashed ids) of the two words before
and the two after the masked place (a text's ends read as padding): their embeddings go through a
matrix per place, tanh, a softmax over CLASSES classes and one over the buckets of the word's class,
so both levels see the context. Classes are made of buckets with similar neighbours (the corpus's
random-indexed left and right neighbours, split along principal directions into equal parts). Of the
weights k in PRIORS the one with the largest likelihood of the corpus is used. A text's score is the
sum over its words of log p.

What is gathered covers the whole corpus and grows with it: exact counts of words, of pairs (l, r) and
of triples (l, w, r) are kept as a table cut by ranges of hashed keys, whose number and length follow
the number of tokens (a key is shared by chance about once in 5,000 times at any size). Only the
network has a fixed size (3 MB) and is broadcast; its weights come from local descent on all texts of
every partition, started from common weights and averaged by tokens: a first round on one slice in WARM,
a second on all, each masking and predicting one word in MASK of all texts, drawn anew. So the weights
depend a little on how the table is partitioned.

Slices of about SLICE_BYTES of text are the unit: a task sorts a slice's keys once, sends each range
one block of distinct keys with their counts, and the range's task adds up all slices' blocks and
returns the totals to each slice. Frequent keys arrive once a slice, so none is hot.

Edge cases: null and empty texts have n_tokens 0, log-probability 0 and mean 0. A text of one word is
predicted from padding alone. Repeated rows count and are scored row by row. Only ``doc_id`` and
``text`` are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanegraph.llm.common import BLOCK_SCHEMA, blocks_of, groups, segment_sum, sum_blocks
from lanegraph.llm.features import core_ids
from lanegraph.shared import materialize

BUCKETS = 1 << 14
CLASSES = 128
MEMBERS = BUCKETS // CLASSES
DIM = 16
OFFSETS = (-2, -1, 1, 2)
HIDDEN = 24
SIDE = 16
BLOCKS = 64
STEP = 16_384
PART = 2_048
WARM = 4
#: A round of training masks one word in so many of every text.
MASK = 4
PRIORS = (0.5, 2.0, 8.0, 32.0)
SLICE_BYTES = 6_000_000
RANGE_TOKENS = 1_000_000
PADDING = 1 << 33
SHAPES = [(BUCKETS + 1, DIM), (len(OFFSETS) * DIM, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, MEMBERS, HIDDEN), (CLASSES, MEMBERS)]
SIZE = sum(int(np.prod(s)) for s in SHAPES)


# --- the network ----------------------------------------------------------------------------


def pack(params: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in params])


def unpack(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for s in SHAPES:
        n = int(np.prod(s))
        out.append(np.array(flat[at : at + n], np.float32).reshape(s))
        at += n
    return out


def classes_of(sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and place within it of each bucket, from its neighbours' sums: halved again and again along the main direction."""
    v = np.sign(sides) * np.sqrt(np.abs(sides))
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    parts = [np.arange(len(v))]
    while len(parts) < CLASSES:
        halves = []
        for ids in parts:
            x = v[ids] - v[ids].mean(0)
            along = np.round(x @ np.linalg.eigh(x.T @ x)[1][:, -1], 9)
            order = ids[np.lexsort((ids, along))]
            halves += [order[: len(ids) // 2], order[len(ids) // 2 :]]
        parts = halves
    cls, slot = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
    for k, ids in enumerate(parts):
        cls[ids], slot[ids] = k, np.arange(len(ids))
    return cls, slot


def initial(counts: np.ndarray, cls: np.ndarray, slot: np.ndarray, seed: int = 5) -> list[np.ndarray]:
    """Small random weights; the biases give every bucket its share of the counts."""
    rng = np.random.default_rng(seed)
    params = [np.zeros(s, np.float32) for s in SHAPES]
    for i, sd in ((0, 0.1), (1, 1 / np.sqrt(SHAPES[1][0])), (3, 0.1), (5, 0.1)):
        params[i] = rng.normal(0, sd, SHAPES[i]).astype(np.float32)
    params[0][BUCKETS] = 0
    smooth = counts + 0.5
    mass = np.bincount(cls, smooth, CLASSES)
    params[4] = np.log(mass / mass.sum()).astype(np.float32)
    params[6][cls, slot] = np.log(smooth / mass[cls])
    return params


def contexts(ids: np.ndarray, sizes: np.ndarray, offsets=OFFSETS, padding: int = BUCKETS) -> np.ndarray:
    """(words, offsets) neighbouring ids within the same text; ``padding`` beyond its ends."""
    n = len(ids)
    out = np.full((n, len(offsets)), padding, ids.dtype)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for j, o in enumerate(offsets):
        a = abs(o)
        if n <= a:
            continue
        same = doc[a:] == doc[:-a]
        to, source = (np.arange(a, n)[same], ids[:-a][same]) if o < 0 else (np.arange(n - a)[same], ids[a:][same])
        out[to, j] = source
    return out


def in_class_order(k: np.ndarray) -> np.ndarray:
    return np.argsort(k.astype(np.int16), kind="stable")


def by_class(k: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each class with its rows, of classes in order: slices, so that nothing is copied to and fro."""
    cuts = np.searchsorted(k, np.arange(CLASSES + 1))
    for c in np.flatnonzero(np.diff(cuts)).tolist():
        yield c, slice(cuts[c], cuts[c + 1])


#: exp of logits no further from zero than this, and sums of CLASSES or MEMBERS of them, are ordinary float32 numbers.
SAFE_LOGIT = 80.0


def _bounded(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no logit is beyond SAFE_LOGIT: a tanh lies between -1 and 1. ``weights`` has the hidden units on its last axis."""
    return float((np.abs(weights).sum(axis=-1) + np.abs(bias)).max()) < SAFE_LOGIT


def _exp(z: np.ndarray, bounded: bool) -> np.ndarray:
    """exp of rows of logits, in place; if they are not bounded each row less its largest one."""
    if not bounded:
        z -= z.max(axis=1, keepdims=True)
    return np.exp(z, out=z)


def _log_softmax_at(z: np.ndarray, at: np.ndarray, bounded: bool) -> np.ndarray:
    """For each row of logits, which are used up, the log of the share that the one at ``at`` has."""
    if not bounded:
        z -= z.max(axis=1, keepdims=True)
    own = z[np.arange(len(z)), at]
    return own - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))


def log_probs(params: list[np.ndarray], cls: np.ndarray, slot: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log p(bucket | both sides) of every word."""
    e, p, b, u, c, v, g = params
    placed = [e @ p[j * DIM : (j + 1) * DIM] for j in range(len(OFFSETS))]  # what a bucket adds at each place
    ctx = contexts(ids, sizes)
    out = np.empty(len(ids))
    ones = np.ones((2 * STEP, 1), np.float32)  # a column of ones takes the biases along
    uc, vg = np.vstack([u, c]), np.concatenate([v, g[:, :, None]], axis=2).transpose(0, 2, 1)
    flat, low = _bounded(u.T, c), _bounded(v, g)
    for lo in range(0, len(ids), 2 * STEP):
        y = ids[lo : lo + 2 * STEP]
        order = in_class_order(cls[y])
        y, near = y[order], ctx[lo : lo + 2 * STEP][order]
        k, place = cls[y], slot[y]
        h = placed[0].take(near[:, 0], axis=0)
        for j in range(1, len(OFFSETS)):
            h += placed[j].take(near[:, j], axis=0)
        h += b
        h = np.hstack([np.tanh(h, out=h), ones[: len(h)]])
        own = np.empty(len(y))
        for at in range(0, len(y), PART):  # small enough to stay in the cache
            own[at : at + PART] = _log_softmax_at(h[at : at + PART] @ uc, k[at : at + PART], flat)
        for q, rows in by_class(k):
            own[rows] += _log_softmax_at(h[rows] @ vg[q], place[rows], low)
        out[lo + order] = own
    return out


def train_step(params: list[np.ndarray], sums: list[np.ndarray], ctx: np.ndarray, y: np.ndarray, cls: np.ndarray, slot: np.ndarray, rate: float) -> None:
    """One Adagrad step on the mean log-loss of the buckets."""
    e, p, b, u, c, v, g = params
    n = len(y)
    order = in_class_order(cls[y])
    ctx, y = ctx[order], y[order]
    x = e.take(ctx, axis=0).reshape(n, -1)
    h = np.tanh(x @ p + b)
    k, place = cls[y], slot[y]
    dh, gu, gc, gv, gg = np.empty_like(h), *map(np.zeros_like, (u, c, v, g))
    flat, low = _bounded(u.T, c), _bounded(v, g)
    for at in range(0, n, PART):
        part = h[at : at + PART]
        z = part @ u
        z += c
        z = _exp(z, flat)
        z *= (1 / (z.sum(axis=1) * n))[:, None]
        z[np.arange(len(z)), k[at : at + PART]] -= 1 / n
        dh[at : at + PART] = z @ u.T
        gu += part.T @ z
        gc += z.sum(0)
    for j, rows in by_class(k):
        hk = h[rows]
        z = hk @ v[j].T
        z += g[j]
        z = _exp(z, low)
        z *= (1 / (z.sum(axis=1) * n))[:, None]
        z[np.arange(len(z)), place[rows]] -= 1 / n
        dh[rows] += z @ v[j]
        np.matmul(z.T, hk, out=gv[j])
        gg[j] = z.sum(0)
    dh *= 1 - h * h
    dx = (dh @ p.T).reshape(n * len(OFFSETS), DIM)
    at = ctx.ravel()
    ge = np.stack([np.bincount(at, dx[:, i], len(e)) for i in range(DIM)], 1).astype(np.float32)
    for q, grad in enumerate((ge, x.T @ dh, dh.sum(0), gu, gc, gv, gg)):  # a gradient of zero changes nothing
        sums[q] += grad * grad
        grad /= np.sqrt(sums[q])
        params[q] -= rate * grad
    e[BUCKETS] = 0


# --- slices of the corpus -------------------------------------------------------------------


def token_table(docs: DataFrame) -> DataFrame:
    """One row per slice: its number, the ids of its documents, their numbers of words, and all word hashes; written once."""
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("__text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        for rows, texts in groups(batches, "__text", SLICE_BYTES):
            ids, sizes = core_ids(texts, 1 << 32)
            doc = rows.column(0)
            docs = pa.ListArray.from_arrays(pa.array([0, len(doc)], pa.int32()), doc)
            cols = [pa.array([(task << 24) + n], pa.int64()), docs, pa.array([len(ids)], pa.int64()), pa.array([sizes.astype(np.uint32).tobytes()], pa.binary()), pa.array([pack_words(ids)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["slice", "docs", "n", "sizes", "ids"])
            n += 1

    return materialize(narrow.mapInArrow(run, f"slice long, docs array<{kind}>, n long, sizes binary, ids binary"), "tokens")


def _slices(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes and sizes of each row (sizes, ids)."""
    for b in batches:
        for s, i in zip(b.column(0), b.column(1)):
            yield unpack_words(i.as_buffer()), np.frombuffer(s.as_buffer(), np.uint32).astype(np.int64)


def gather(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the buckets, and sums of their left and right neighbours' random index vectors (one signed one each)."""
    rng = np.random.default_rng(20240409)
    place, sign = rng.integers(0, SIDE, BUCKETS), rng.choice([-1.0, 1.0], BUCKETS)
    width = 2 * SIDE + 1

    def run(batches):
        total = np.zeros(BUCKETS * width)
        for hashes, sizes in _slices(batches):
            ids = hashes % BUCKETS
            doc = np.repeat(np.arange(len(sizes)), sizes)
            same = doc[1:] == doc[:-1]
            a, b = ids[:-1][same], ids[1:][same]
            for at, by in ((ids * width, None), (a * width + 1 + place[b], sign[b]), (b * width + 1 + SIDE + place[a], sign[a])):
                total += np.bincount(at, by, len(total))
        yield blocks_of(total, BLOCKS, TaskContext.get().partitionId() % 16)

    total = sum_blocks(tokens.select("sizes", "ids").mapInArrow(run, BLOCK_SCHEMA), BUCKETS * width, BLOCKS).reshape(BUCKETS, width)
    return total[:, 0], total[:, 1:]


def train_round(tokens: DataFrame, flat: np.ndarray, cls: np.ndarray, slot: np.ndarray, rate: float, number: int) -> np.ndarray:
    """Local descent on every partition from common weights; the average by tokens."""
    sent = tokens.sparkSession.sparkContext.broadcast((flat.astype(np.float32), cls, slot))

    def run(batches):
        start, label, place = sent.value
        params = unpack(start)
        sums = [np.full(s, 1e-6, np.float32) for s in SHAPES]
        seen = 0
        for hashes, sizes in _slices(batches):
            ids = hashes % BUCKETS
            ctx = contexts(ids, sizes)
            masked = np.random.default_rng([len(ids), number]).permutation(len(ids))[: -(-len(ids) // MASK)]
            steps = max(1, round(len(masked) / STEP))  # of about equal size, so that no short one counts as much as a long one
            for i in np.array_split(masked, steps):
                if len(i):
                    train_step(params, sums, ctx[i], ids[i], label, place, rate * min(1.0, len(i) / STEP * 2))
            seen += len(ids)
        if seen:
            yield blocks_of(np.append(pack(params) * seen, seen), BLOCKS, TaskContext.get().partitionId() % 16)

    total = sum_blocks(tokens.select("sizes", "ids").mapInArrow(run, BLOCK_SCHEMA), SIZE + 1, BLOCKS)
    return total[:-1] / total[-1] if total[-1] else flat


def fit(tokens: DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Network, class and place of each bucket, and the buckets' counts."""
    counts, sides = gather(tokens)
    cls, slot = classes_of(sides)
    flat = pack(initial(counts, cls, slot))
    warm = tokens.where(F.pmod(F.xxhash64("slice"), F.lit(WARM)) == 0)
    for number, (rows, rate) in enumerate(((warm, 0.1), (tokens, 0.05))):
        flat = train_round(rows, flat, cls, slot, rate, number)
    return unpack(flat), cls, slot, counts


# --- counts that grow with the corpus ---------------------------------------------------------


def squeeze(planes: bytes) -> bytes:
    """Compressed, after the length."""
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def expand(data: bytes | pa.Buffer) -> bytes:
    view = memoryview(data)
    return pa.decompress(view[8:], decompressed_size=int.from_bytes(view[:8], "little"), codec="zstd", asbytes=True)


def pack_ints(a: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, the low ones first, compressed."""
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return squeeze(bytes([width]) + np.ascontiguousarray(a.astype(np.uint64).view(np.uint8).reshape(-1, 8).T[:width]).tobytes())


def unpack_ints(data: bytes) -> np.ndarray:
    raw = expand(data)
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.reshape(-1).view(np.uint64)


def pack_words(hashes: np.ndarray) -> bytes:
    """Word hashes as the slice's distinct ones by falling count, and each word's number among them."""
    found, at, count = np.unique(hashes.astype(np.uint32), return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    head = squeeze(found[order].tobytes())
    return len(head).to_bytes(8, "little") + head + pack_ints(rank[at])


def unpack_words(data: bytes | pa.Buffer) -> np.ndarray:
    view = memoryview(data)
    n = 8 + int.from_bytes(view[:8], "little")
    return np.frombuffer(expand(view[8:n]), np.uint32).astype(np.int64)[unpack_ints(view[n:]).astype(np.int64)]


def places_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """For each key its place among the distinct ones in order. Where key and index fit one number, that is sorted (faster than an argsort)."""
    shift = len(keys).bit_length()
    if bits + shift > 64:
        return np.unique(keys, return_inverse=True)[1]
    both = np.sort((keys << np.uint64(shift)) | np.arange(len(keys), dtype=np.uint64))
    found = both >> np.uint64(shift)
    out = np.empty(len(keys), np.int64)
    out[(both & np.uint64((1 << shift) - 1)).astype(np.int64)] = np.cumsum(np.concatenate([[0], found[1:] != found[:-1]])) if len(keys) else 0
    return out


def key_bits(tokens: int) -> int:
    """So many that a key of ``tokens`` places is shared by chance about once in 5,000 times."""
    return min(64, max(32, tokens.bit_length() + 13))


def keys_of(hashes: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """Keys of each word, of its neighbours (l, r), and of the triple (l, w, r), end to end."""
    near = contexts(hashes, sizes, (-1, 1), PADDING).astype(np.uint64)
    w = hashes.astype(np.uint64)

    def mix(h: np.ndarray) -> np.ndarray:
        h = h ^ (h >> np.uint64(31))
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    sides = mix(near[:, 0] * np.uint64(0x100000001B3) + mix(near[:, 1] + np.uint64(7)))
    all_keys = np.concatenate([mix(w + np.uint64(1 << 40)), sides, mix(sides + mix(w + np.uint64(1 << 41)))])
    return all_keys >> np.uint64(64 - bits)


def range_edges(ranges: int, bits: int) -> np.ndarray:
    return np.array([((k << bits) // ranges) for k in range(1, ranges)], np.uint64)


def send_keys(tokens: DataFrame, bits: int, ranges: int) -> DataFrame:
    """range, slice, keys, counts: each slice's distinct keys by range."""

    def run(batches):
        edges = range_edges(ranges, bits)
        for b in batches:
            rows = []
            for number, (hashes, sizes) in zip(b.column(2).to_pylist(), _slices([b])):
                found, count = np.unique(keys_of(hashes, sizes, bits), return_counts=True)
                cuts = np.concatenate([[0], np.searchsorted(found, edges), [len(found)]])
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    own = found[cuts[k] : cuts[k + 1]]
                    rows.append((k, number, pack_ints(np.diff(own, prepend=np.uint64(0))), pack_ints(count[cuts[k] : cuts[k + 1]])))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["range", "slice", "keys", "counts"])

    return tokens.select("sizes", "ids", "slice").mapInArrow(run, "range int, slice long, keys binary, counts binary")


def add_up(messages: DataFrame, bits: int) -> DataFrame:
    """slice, range, totals: the corpus's counts of each slice's keys."""

    def totals(rows: list[tuple]) -> pa.RecordBatch:
        keys = [np.cumsum(unpack_ints(k), dtype=np.uint64) for _, _, k, _ in rows]
        count = np.concatenate([unpack_ints(c) for _, _, _, c in rows])
        at = places_of(np.concatenate(keys), bits)
        total = np.bincount(at, count)[at].astype(np.uint64)
        ends = np.cumsum([len(k) for k in keys])
        data = [pack_ints(total[e - len(k) : e]) for k, e in zip(keys, ends)]
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array(data, pa.binary())], names=["slice", "range", "totals"])

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][0] != row[0]:
                    yield totals(held)
                    held = []
                held.append(row)
        if held:
            yield totals(held)

    ordered = messages.repartition("range").sortWithinPartitions("range", "slice")
    return ordered.mapInArrow(run, "slice long, range int, totals binary")


def score_slices(tokens: DataFrame, totals: DataFrame, model, bits: int) -> DataFrame:
    """doc_id, n_tokens and the log-probability under each of PRIORS."""
    sent = tokens.sparkSession.sparkContext.broadcast(model)
    item = tokens.schema["docs"].dataType
    none = lambda name: F.lit(None).cast(tokens.schema[name].dataType).alias(name)
    texts = tokens.select("slice", F.lit(-1).alias("range"), F.lit(None).cast("binary").alias("totals"), "docs", "sizes", "ids")
    sums = totals.select("slice", "range", "totals", none("docs"), none("sizes"), none("ids"))
    both = sums.unionByName(texts).withColumn("last", F.col("ids").isNotNull())
    both = both.repartition("slice").sortWithinPartitions("slice", "last", "range")
    names = ["doc_id", "n_tokens", *(f"s{k}" for k in range(len(PRIORS)))]

    def scored(docs: pa.Array, sizes: np.ndarray, hashes: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        params, cls, slot, counts = sent.value
        n = len(hashes)
        ids = hashes % BUCKETS
        word, sides, triple = total[places_of(keys_of(hashes, sizes, bits), bits)].reshape(3, n)
        q = np.exp(log_probs(params, cls, slot, ids, sizes)) * np.minimum(1.0, word / np.maximum(counts[ids], 1.0))
        out = [segment_sum(np.log((triple - 1 + k * q) / (sides - 1 + k)), sizes) for k in PRIORS]
        return pa.RecordBatch.from_arrays([docs, pa.array(sizes), *(pa.array(x) for x in out)], names=names)

    def run(batches):
        held: list[np.ndarray] = []
        for b in batches:
            for i in range(b.num_rows):
                if b.column(5)[i].is_valid:
                    (hashes, sizes), = _slices([b.slice(i, 1).select(["sizes", "ids"])])
                    yield scored(b.column(3)[i].values, sizes, hashes, np.concatenate([*held, np.zeros(0)]))
                    held = []
                else:
                    held.append(unpack_ints(b.column(2)[i].as_py()).astype(np.float64))

    made = ", ".join(f"{c} double" for c in names[2:])
    return both.drop("last").mapInArrow(run, f"doc_id {item.elementType.simpleString()}, n_tokens long, {made}")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_prob (summed conditional log-probabilities) and mean_log_prob of every whole text."""
    tokens = token_table(docs)
    total = int(tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    bits, ranges = key_bits(total), -(-total // RANGE_TOKENS) or 1
    totals = add_up(send_keys(tokens, bits, ranges), bits)
    by_prior = materialize(score_slices(tokens, totals, fit(tokens), bits), "scores")
    sums = by_prior.agg(*[F.sum(f"s{k}") for k in range(len(PRIORS))]).first()
    best = max(range(len(PRIORS)), key=lambda k: (sums[k] or 0.0, -k))
    return by_prior.select("doc_id", "n_tokens", F.col(f"s{best}").alias("log_prob"), (F.col(f"s{best}") / F.greatest(F.col("n_tokens"), F.lit(1))).alias("mean_log_prob"))
