"""Removal of word passages that an earlier document has, by level-wise doubling of window lengths.

A window is ``window`` consecutive words of one document (words: ``[^\\x20\\x09-\\x0D]+``, unchanged). Every word
goes that is covered by a window which also starts in a document with a smaller id; windows are judged on the
input.

Levels: lengths double up to the window asked for, here 7 and 13 (the last step overlaps by a word; a window of 50
takes 7, 13, 25, 50). At each level below the last, a window is represented by the run of that length with the
smallest hash within it, so equal windows have equal representatives, and neighbouring windows mostly share
one: about a quarter of the words represent all windows. Only windows whose representative occurs in two
rows are extended to the next level, and the levels end when none is left. At the last level the windows that
still stand are compared themselves: those of one representative travel together, and a window is found in the
document with the smallest id that has the same representative and the same window hash (128 bits together,
both made of random values by doubling; unequal windows are taken as equal with negligible probability).

Spark: a level shuffles (representative, row) once and keeps what two rows share; texts are shuffled once by row,
and one exchange serves all levels of a query. Representatives that a sample shows in more than one of ``SHARE`` rows of
that shuffle are sent to all tasks (at most ``SHARE`` of them) and count as repeated without being shuffled. The windows
among theirs that are as frequent in the sample are known to all tasks as well, each with the smallest id of all rows
that it starts in, so that a passage in a third of all documents is no hot key. The sample only chooses the way;
results are the same with any.

Edge cases: a null text has no words. Words are compared as bytes. A text shorter than the window loses nothing. Ids
are whole numbers (others are cast, and text that is none fails the query). A null id is later than all others, and no
window is removed because of it. Rows with the same id do not remove each other's words; rows alike in id and text are
treated alike. Columns other than id and text are never read. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanegraph.llm.common import groups
from lanegraph.llm.words import mix, run_hashes, sliding_min, split_words, word_hashes
from lanegraph.shared import materialize

WINDOW = 13
START = 7
#: Rows of the sample that looks for very frequent representatives, and the share of a level's rows that makes one.
SAMPLE_ROWS = 5_000
SHARE = 4096
_LATER = "least < doc or (doc is null and least is not null)"


def levels(window: int, start: int) -> list[int]:
    """Lengths from at least ``start`` to ``window``, each at most twice the one before."""
    found = [window]
    while (found[0] + 1) // 2 >= start and found[0] > 1:
        found.insert(0, (found[0] + 1) // 2)
    return found


class _Windows:
    """All windows of a batch of texts: the word each starts at, its text, and its representatives by level."""

    def __init__(self, texts: list[bytes], window: int):
        self.words = split_words(texts)
        self.h = word_hashes(self.words)
        self.window = window
        left = np.repeat(self.words.counts, self.words.counts) - self.words.place
        self.start = np.flatnonzero(left >= window)
        self.text = self.words.text[self.start]

    def representatives(self, level: int) -> np.ndarray:
        found = sliding_min(run_hashes(self.h, level), self.window - level + 1)
        return found[self.start] if len(self.start) else np.zeros(0, np.uint64)

    def hashes(self) -> np.ndarray:
        found = run_hashes(self.h, self.window)
        return found[self.start] if len(self.start) else np.zeros(0, np.uint64)

    def standing(self, done: list[int], shared: pa.Array | None, frequent: np.ndarray) -> np.ndarray:
        """Which windows have, at all levels done, a representative that another row has too (``shared``, by text) or that is ``frequent``."""
        ok = np.ones(len(self.start), bool)
        if not done:
            return ok
        sizes = pc.fill_null(pc.list_value_length(shared), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = shared.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        known = mix(values, np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64))
        for level in done:
            v = self.representatives(level)
            ok &= np.isin(mix(v, self.text.astype(np.uint64)), known) | np.isin(v, frequent)
        return ok


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    """key (hash of id and text), mark (another; odd for a null id), doc, text."""
    doc, body = F.col(key).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit(""))
    mark = F.xxhash64(body, F.lit(1), doc).bitwiseAND(F.lit(0x7FFFFFFE)).bitwiseOR(doc.isNull().cast("long")).cast("int")
    return docs.select(F.xxhash64(doc, body).alias("key"), mark.alias("mark"), doc.alias("doc"), body.alias("text"))


def _mapped(rows: DataFrame, schema: str, window: int, done: list[int], frequent: np.ndarray, make) -> DataFrame:
    """``make(batch, windows, standing)`` of slices of ``rows``; what other rows share is in the column ``shared`` once a level is done."""

    def run(batches):
        for batch, texts in groups(batches, "text"):
            w = _Windows(texts, window)
            ok = w.standing(done, batch.column(batch.schema.get_field_index("shared")) if done else None, frequent)
            yield make(batch, w, ok)

    return rows.mapInArrow(run, schema)


def _representatives(rows: DataFrame, window: int, level: int, done: list[int], frequent: np.ndarray) -> DataFrame:
    """(h, key): the representatives at ``level`` of the windows that stand, without frequent ones; neighbours' equal ones once."""

    def make(batch, w, ok):
        v, text = w.representatives(level), w.text
        ok &= ~np.isin(v, frequent)
        v, text = v[ok], text[ok]
        new = np.concatenate([[True], (v[1:] != v[:-1]) | (text[1:] != text[:-1])]) if len(v) else np.zeros(0, bool)
        key = batch.column(batch.schema.get_field_index("key")).to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(v[new].view(np.int64)), pa.array(key[text[new]])], names=["h", "key"])

    return _mapped(rows, "h long, key long", window, done, frequent, make)


def _with_shared(rows: DataFrame, shared: DataFrame | None) -> DataFrame:
    return rows if shared is None else rows.join(shared, "key", "left")


def _frequent(rows: DataFrame, window: int, level: int, share: int) -> tuple[DataFrame, np.ndarray, int]:
    """A sample of the rows, the representatives of more than one in ``share`` of its rows of this level (so at most ``share``), and how many rows those are."""
    every = max(1, rows.count() // SAMPLE_ROWS)
    sample = rows.where(F.pmod("key", F.lit(every)) == 0)
    found = _representatives(sample, window, level, [], np.zeros(0, np.uint64))
    least = max(64, found.count() // share)
    often = found.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > least).select("h").collect()
    return sample, np.array(sorted(r["h"] for r in often), np.int64).view(np.uint64), least


class _Hot:
    """The few windows that a large share of the rows has, by representative and hash, with the smallest id of each."""

    def __init__(self, found: list[tuple[int, int, int]]):
        rows = np.array(found, np.int64).reshape(-1, 3)
        key = mix(rows[:, 0].view(np.uint64), rows[:, 1].view(np.uint64))
        order = np.argsort(key)
        self.key, (self.h, self.a, self.least) = key[order], rows[order].T.copy()

    def find(self, v: np.ndarray, a: np.ndarray) -> np.ndarray:
        """The place of each window among the hot ones; -1: it is none."""
        if not len(self.key):
            return np.full(len(v), -1)
        at = np.minimum(np.searchsorted(self.key, mix(v, a)), len(self.key) - 1)
        return np.where((self.h[at] == v.view(np.int64)) & (self.a[at] == a.view(np.int64)), at, -1)


def _window_rows(rows: DataFrame, window: int, level: int, done: list[int], frequent: np.ndarray, common: bool, hot: _Hot) -> DataFrame:
    """A row for each run of standing windows with one representative: h, key, mark, doc, start, hashes; without hot windows. ``common``: the frequent ones, else the others."""

    def make(batch, w, ok):
        v, every = w.representatives(level), w.hashes()
        ok = ok & (np.isin(v, frequent) == common)
        at = np.flatnonzero(ok)
        at = at[hot.find(v[at], every[at]) < 0]
        v, text, start, a = v[at], w.text[at], w.words.place[w.start[at]], every[at]
        new = np.ones(len(at), bool)
        new[1:] = (v[1:] != v[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        ends = np.concatenate([first, [len(at)]]).astype(np.int32)
        hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(a.view(np.int64)))
        own = [batch.column(batch.schema.get_field_index(c)).take(pa.array(text[first])) for c in ("key", "mark", "doc")]
        return pa.RecordBatch.from_arrays([pa.array(v[first].view(np.int64)), *own, pa.array(start[first].astype(np.int32)), hashes], names=["h", "key", "mark", "doc", "start", "hashes"])

    return _mapped(rows, "h long, key long, mark int, doc long, start int, hashes array<long>", window, done, frequent, make)


def _each(runs: DataFrame) -> DataFrame:
    one = runs.select("h", "key", "mark", "doc", "start", F.posexplode("hashes").alias("i", "a"))
    return one.select("h", "a", "key", "mark", "doc", (F.col("start") + F.col("i")).alias("at"))


def _hot_windows(rows: DataFrame, sample: DataFrame, window: int, level: int, frequent: np.ndarray, least: int) -> _Hot:
    """Windows of more than ``least`` rows of the sample, and the smallest id that each starts in, of all rows.

    A window is no rarer than its representative's share allows, so there are a few times ``SHARE`` at most. Each task
    finds its own smallest ids, which are then compared.
    """
    if not len(frequent):
        return _Hot([])
    each = _each(_window_rows(sample, window, level, [], frequent, True, _Hot([])))
    often = each.groupBy("h", "a").agg(F.count("*").alias("n")).where(F.col("n") > least).select("h", "a").collect()
    hot = _Hot([(r["h"], r["a"], 0) for r in often])
    none = np.iinfo(np.int64).max

    def run(batches):
        best = np.full(len(hot.key), none)
        for batch, texts in groups(batches, "text"):
            w = _Windows(texts, window)
            at = hot.find(w.representatives(level), w.hashes())
            doc = pc.fill_null(batch.column(batch.schema.get_field_index("doc")), none).to_numpy(zero_copy_only=False)
            np.minimum.at(best, at[at >= 0], doc[w.text[at >= 0]])
        here = np.flatnonzero(best < none)
        yield pa.RecordBatch.from_arrays([pa.array(here.astype(np.int32)), pa.array(best[here])], names=["i", "least"])

    ids = rows.mapInArrow(run, "i int, least long").groupBy("i").agg(F.min("least").alias("least")).collect()
    return _Hot([(int(hot.h[r["i"]]), int(hot.a[r["i"]]), r["least"]) for r in ids])


def _covered(rows: DataFrame, window: int, level: int, done: list[int], frequent: np.ndarray, hot: _Hot) -> DataFrame:
    """(key, places): the windows of each row, hot ones aside, that start in a document with a smaller id, as mark << 32 | place."""
    least = F.min("doc").over(Window.partitionBy("h", "a"))
    parts = [_each(_window_rows(rows, window, level, done, frequent, False, hot).repartition("h"))]
    if len(frequent):  # windows of a frequent representative are dealt one by one
        parts.append(_each(_window_rows(rows, window, level, done, frequent, True, hot)))
    found = reduce(DataFrame.unionByName, [p.withColumn("least", least).where(_LATER).select("key", "mark", "at") for p in parts])
    place = F.shiftleft(F.col("mark").cast("long"), 32).bitwiseOR(F.col("at").cast("long"))
    return found.groupBy("key").agg(F.collect_list(place).alias("places"))


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """The lists of two levels in one a row."""
    return a.unionByName(b).groupBy("key").agg(F.flatten(F.collect_list("shared")).alias("shared"))


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, start: int = START, share: int = SHARE) -> DataFrame:
    """key, n_words, spans (removed ranges of words: start, length) and kept (the other words, joined by a space) of every row."""
    rows = _rows(docs, text, key)
    steps = levels(window, start)
    done: list[int] = []
    shared, frequent, level = None, np.zeros(0, np.uint64), window
    several = Window.partitionBy("h")
    for level in steps[:-1] or steps:
        sample, often, least = _frequent(rows, window, level, share)
        frequent = np.union1d(frequent, often)
        if level == window:
            break
        found = _representatives(_with_shared(rows, shared), window, level, done, frequent)
        found = found.withColumns({"least": F.min("key").over(several), "most": F.max("key").over(several)}).where("least < most")
        lists = found.groupBy("key").agg(F.collect_list("h").alias("shared"))
        done.append(level)
        if level == steps[-2]:
            shared = lists if shared is None else _merged(shared, lists)
            break
        shared = materialize(lists if shared is None else _merged(shared, lists), "repeated")
        if not len(frequent) and not shared.limit(1).count():
            break
    hot = _hot_windows(rows, sample, window, level, frequent, least)
    covered = _covered(_with_shared(rows, shared), window, level, done, frequent, hot)

    def run(batches):
        for batch, texts in groups(batches, "text"):
            yield _rebuilt(batch, texts, window, level, hot)

    schema = "doc long, n_words long, spans array<struct<start:int,length:int>>, kept string"
    made = rows.join(covered, "key", "left").select("mark", "doc", "text", "places").mapInArrow(run, schema)
    return made.select(F.col("doc").alias(key), "n_words", "spans", "kept")


def _hot_places(batch: pa.RecordBatch, texts: list[bytes], window: int, level: int, hot: _Hot) -> list[np.ndarray]:
    """The places of each text's hot windows that start in a document with a smaller id."""
    if not len(hot.key):
        return [np.zeros(0, np.int64)] * len(texts)
    w = _Windows(texts, window)
    at = hot.find(w.representatives(level), w.hashes())
    doc = batch.column(1)
    later = pc.fill_null(doc, 0).to_numpy(zero_copy_only=False)[w.text] > hot.least[at]
    later |= doc.is_null().to_numpy(zero_copy_only=False)[w.text]
    chosen = np.flatnonzero((at >= 0) & later)
    ends = np.searchsorted(w.text[chosen], np.arange(len(texts) + 1))
    place = w.words.place[w.start[chosen]]
    return [place[a:b] for a, b in zip(ends, ends[1:])]


def _rebuilt(batch: pa.RecordBatch, texts: list[bytes], window: int, level: int, hot: _Hot) -> pa.RecordBatch:
    marks = batch.column(0).to_pylist()
    counts, spans, kept = [], [], []
    for mark, places, more, t in zip(marks, batch.column(3), _hot_places(batch, texts, window, level, hot), texts):
        words = t.split()
        counts.append(len(words))
        at = np.asarray(places.values.to_numpy(zero_copy_only=False) if places.is_valid else [], np.int64)
        at = np.concatenate([at[(at >> 32) == mark] & 0xFFFFFFFF, more])
        if not len(at):
            spans.append([])
            kept.append(b" ".join(words))
            continue
        depth = np.zeros(len(words) + 1, np.int32)
        np.add.at(depth, at, 1)
        np.add.at(depth, np.minimum(at + window, len(words)), -1)
        gone = np.cumsum(depth[:-1]) > 0
        turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        spans.append([{"start": a, "length": b - a} for a, b in zip(turn[::2].tolist(), turn[1::2].tolist())])
        kept.append(b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()]))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
    return pa.RecordBatch.from_arrays([batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc", "n_words", "spans", "kept"])
