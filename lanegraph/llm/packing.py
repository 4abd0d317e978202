"""Best-fit packing of tokenised documents into sequences of a fixed capacity (linear grouping scheme).

1. Every whole text is tokenised (ids by ``tokenizers`` plus one end id) and, only if it is longer
   than the capacity, cut into pieces of the capacity; the last may be shorter.
2. The histogram of piece lengths, at most ``capacity`` numbers, goes to the driver. Lengths above
   ``capacity / LARGE`` are sorted and cut into groups of equal cardinality, each rounded up to its
   largest length. A cutting-stock linear program over these few sizes is solved by column generation
   (its columns are configurations of at most LARGE slots); the integer part of the solution is used.
3. Slots are filled with actual pieces of their group, longest first, which leaves the rounding gaps
   free; the pieces that the integer part left out and all small ones then go, longest first, where
   they fit best. All of this handles runs of equal bins, so its cost depends on the capacity, not on
   the number of documents.
4. The plan says where the r-th piece of each length goes. Ranks within a length come from windows over
   (length, partition) and prefix sums of the partitions' counts: no length's pieces meet in one task.

Edge cases: null and empty texts are one piece that holds the end id alone. Repeated rows are packed
as often as they occur. Other columns are never read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import warnings
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanegraph.llm.common import groups
from lanegraph.llm.features import Memo, live
from lanegraph.shared import materialize

CAPACITY = 4096
END_ID = 1
LARGE = 8
GROUPS = 64
VOCABULARY = "word_bpe_49k.json"


# --- tokenising ---------------------------------------------------------------------------


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of white-space words as packed 32-bit integers.

    The vocabulary's own pipeline collapses white space and never merges across it, so a text's ids are
    those of its words in order. Words of plain letters, perhaps with marks after them, take a direct
    path: the same merges by rank in a byte-pair coder (a word's last byte carries the end-of-word
    mark). All other words go through ``tokenizers`` itself.
    """

    PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!#*$%&|]*)")
    END = b"\xff"

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        to_byte = self._byte_of_char()
        ranks = {}
        for piece, i in vocab.items():
            last = piece.endswith("</w>") and len(piece) > 4
            chars = piece[:-4] if last else piece
            if all(c in to_byte for c in chars) and not piece.startswith("<|"):
                ranks[bytes(to_byte[c] for c in chars) + (self.END if last else b"")] = i
        coder = getattr(tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={}), "_core_bpe", None)
        self.fast = getattr(coder, "encode_single_piece", None)
        # The coder is not part of that package's public interface: it is used only while it agrees with ``tokenizers``.
        known = [p[:-4] for p in vocab if p.endswith("</w>") and p[:-4].isascii() and p[:-4].isalpha()][:: max(1, len(vocab) // 400)]
        tried = [w + x for w, v in zip(known, known[1:]) for x in ("", ".", ",|", v)]
        if self.fast is not None and any(self.word(w.encode()) != self.exact(w) for w in tried):
            self.fast = None
        self.memo = Memo(self.word)

    @staticmethod
    def _byte_of_char() -> dict[str, int]:
        """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for 256 and up in order."""
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in shown]
        return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        m = self.PLAIN.fullmatch(text)
        if not m or self.fast is None:
            return self.exact(text)
        ids = self.fast(m[1].lower().encode() + self.END)
        if m[2]:
            ids = ids + self.fast(m[2].encode() + self.END)
        return array("I", ids).tobytes()

    def exact(self, text: str) -> bytes:
        return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()

    def text(self, text: bytes) -> bytes:
        return b"".join(map(self.memo.__getitem__, text.split()))


def word_ids(path: str) -> WordIds:
    return live(("word ids", path), lambda: WordIds(path))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part (the writing partition) of every piece."""
    narrow = docs.select(F.col("doc_id").alias("__id"), F.col("text").cast("string").alias("__text"))
    end = array("I", [end_id]).tobytes()

    def run(batches):
        coder = word_ids(path)
        for rows, texts in groups(batches, "__text"):
            at, nth, start, length, crc = [], [], [], [], []
            for i, t in enumerate(texts):
                ids = coder.text(t) + end
                n = len(ids) // 4
                for k, lo in enumerate(range(0, n, capacity)):
                    own = ids[4 * lo : 4 * (lo + capacity)]
                    at.append(i), nth.append(k), start.append(lo), length.append(len(own) // 4), crc.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(at, pa.int64())), pa.array(nth, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = narrow.schema["__id"].dataType.simpleString()
    made = narrow.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    return made.withColumn("part", F.spark_partition_id())


# --- planning -----------------------------------------------------------------------------


def equal_groups(hist: np.ndarray, low: int, high: int, k: int) -> list[tuple[int, list[list[int]]]]:
    """Lengths low..high, longest first, in k groups of equal cardinality: (rounded length, [[length, first rank, count]])."""
    total = int(hist[low : high + 1].sum())
    if not total:
        return []
    quota = -(-total // k)
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for length in range(high, low - 1, -1):
        n, rank = int(hist[length]), 0
        while n:
            if not room:
                out.append((length, []))
                room = quota
            take = min(n, room)
            out[-1][1].append([length, rank, take])
            n, rank, room = n - take, rank + take, room - take
    merged: dict[int, list[list[int]]] = {}
    for size, runs in out:
        merged.setdefault(size, []).extend(runs)
    return sorted(merged.items(), reverse=True)


def best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int, slots: int) -> np.ndarray:
    """The multiset of at most ``slots`` sizes that fits the capacity with the largest value (unbounded knapsack by slots)."""
    best = np.zeros(capacity + 1)
    picks = []
    for _ in range(slots):
        new, pick = best.copy(), np.full(capacity + 1, -1)
        for i, (s, v) in enumerate(zip(sizes, value)):
            if v <= 0:
                continue
            c = np.full(capacity + 1, -np.inf)
            c[s:] = best[: capacity + 1 - s] + v
            up = c > new + 1e-12
            new[up], pick[up] = c[up], i
        picks.append(pick)
        best = new
    out = np.zeros(len(sizes), np.int64)
    w = capacity
    for pick in reversed(picks):
        if pick[w] >= 0:
            out[pick[w]] += 1
            w -= int(sizes[pick[w]])
    return out


def solve_configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, slots: int, rounds: int = 600) -> list[tuple[np.ndarray, float]]:
    """Least bins for ``demand`` of each size: the cutting-stock linear program by column generation (primal simplex).

    ``rounds`` bounds the steps. Where it is met the plan still holds every piece, but may use more sequences than the
    program's least; that is reported as a warning.
    """
    m = len(sizes)
    columns = np.diag(np.minimum(capacity // sizes, slots)).astype(float)
    for _ in range(rounds):
        try:
            price = np.linalg.solve(columns.T, np.ones(m))
        except np.linalg.LinAlgError:
            break
        new = best_configuration(sizes, price, capacity, slots)
        if new @ price <= 1 + 1e-7:
            break
        level = np.linalg.solve(columns, demand.astype(float))
        step = np.linalg.solve(columns, new.astype(float))
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, np.maximum(level, 0) / np.where(up, step, 1), np.inf)
        columns[:, int(np.argmin(ratio))] = new
    else:
        warnings.warn(f"column generation stopped after {rounds} steps", stacklevel=2)
    level = np.maximum(np.linalg.solve(columns, demand.astype(float)), 0)
    return [(columns[:, j].astype(np.int64), float(level[j])) for j in range(m)]


class Plan:
    """Where pieces go: runs (length, first rank, count, first sequence, offset), and runs of open bins by room left."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.has = np.zeros(capacity + 1, bool)

    def new(self, count: int) -> int:
        self.bins += count
        return self.bins - count

    def leave(self, room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            self.open.setdefault(room, []).append((first, count))
            self.has[room] = True

    def put(self, length: int, rank: int, count: int, first: int, offset: int) -> None:
        self.runs.append((length, rank, count, first, offset))

    def best_fit(self, length: int, rank: int, n: int) -> None:
        """Pieces rank..rank+n of one length, each into the fullest bin that takes it."""
        while n:
            room = int(np.argmax(self.has[length:])) + length
            if not self.has[room]:
                each = self.capacity // length
                for bins, per in ((n // each, each), (1, n % each)):
                    if bins and per:
                        first = self.new(bins)
                        for j in range(per):
                            self.put(length, rank, bins, first, j * length)
                            rank += bins
                        self.leave(self.capacity - per * length, first, bins)
                return
            first, count = self.open[room].pop()
            if not self.open[room]:
                self.has[room] = False
            per = min(room // length, n)
            bins = min(count, n // per)
            for j in range(per):
                self.put(length, rank, bins, first, self.capacity - room + j * length)
                rank += bins
            n -= per * bins
            self.leave(room - per * length, first, bins)
            self.leave(room, first + bins, count - bins)


def plan_packing(hist: np.ndarray, capacity: int = CAPACITY, k: int = GROUPS, large: int = LARGE) -> Plan:
    """``hist[length]``: pieces of that length, 1 to capacity."""
    plan = Plan(capacity)
    full = int(hist[capacity])
    if full:
        plan.put(capacity, 0, full, plan.new(full), 0)
    low = capacity // large + 1
    grouped = equal_groups(hist, low, capacity - 1, k)
    left: list[list[int]] = []
    if grouped:
        sizes = np.array([s for s, _ in grouped])
        queues = [[list(r) for r in runs] for _, runs in grouped]
        demand = np.array([sum(r[2] for r in q) for q in queues])
        for config, level in solve_configurations(sizes, demand, capacity, large):
            n = min([int(level + 1e-9), *(int(sum(r[2] for r in queues[g]) // c) for g, c in enumerate(config) if c)])
            if n <= 0 or not config.any():
                continue
            parts = [(plan.new(n), n, 0)]  # first bin, bins, filled
            for g in np.repeat(np.arange(len(config)), config):
                after = []
                for first, count, fill in parts:
                    while count:
                        head = queues[g][0]
                        take = min(count, head[2])
                        plan.put(head[0], head[1], take, first, fill)
                        after.append((first, take, fill + head[0]))
                        head[1], head[2] = head[1] + take, head[2] - take
                        if not head[2]:
                            queues[g].pop(0)
                        first, count = first + take, count - take
                parts = after
            for first, count, fill in parts:
                plan.leave(capacity - fill, first, count)
        left = [r for q in queues for r in q if r[2]]
    for length, rank, n in sorted(left, reverse=True):
        plan.best_fit(length, rank, n)
    for length in range(min(low, capacity) - 1, 0, -1):
        if hist[length]:
            plan.best_fit(length, 0, int(hist[length]))
    return plan


# --- placing ------------------------------------------------------------------------------


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    cut = materialize(pieces(docs, path or vocabulary_path(), capacity, end_id), "pieces")
    hist = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        hist[row["length"]] = row["count"]
    runs = np.array(sorted(plan_packing(hist, capacity).runs), np.int64).reshape(-1, 5)
    sent = docs.sparkSession.sparkContext.broadcast(((runs[:, 0] << 44) + runs[:, 1], runs[:, 3] - runs[:, 1], runs[:, 4]))
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece"))
    ranked = cut.withColumn("own", own - 1).join(before, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).alias("rank"))
    kind = cut.schema["doc_id"].dataType.simpleString()

    def place(batches):
        key, shift, offset = sent.value
        for rows in batches:
            length, rank = (np.asarray(rows.column(i), np.int64) for i in (3, 5))
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*rows.columns[:5], pa.array(rank + shift[at]), pa.array(offset[at])], names=[*rows.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
