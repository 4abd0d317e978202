"""Ranked lexical search: the k best documents for each item of a query set, over all documents, exactly.

Terms are the maximal runs of ASCII letters and digits and of characters beyond ASCII; only A-Z are lower-cased. With N
documents that have a term, L terms in them, n in one document and df documents with a term, a term of
frequency tf adds w * ((10^9 tf) div (1000 tf + 8 m)) for each of its occurrences in the item, where
w = floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 25 + ((75 n N) div L); all but w in 64-bit integers.

Index (``build_index``): documents are cut into shards of up to ``SHARD_DOCS``, in the order of ids within a shard. A row
of the index is a term of a shard with its documents and what it adds there before the weight, and the
largest of that, which is the root of the term's tree over the shard. Terms are keyed by a 64-bit hash; two terms meet only if
one is in the query set, so an index for all terms or for some gives the same results.

Search (``search``): a term's max tree over a shard has a leaf a document and a node for every ``FAN`` nodes below. For an
item the weighted sum over its terms of a node's values bounds every score beneath it. Nodes are opened best first,
of equal bounds the one with the smallest ids first, so leaves come up in the order of the answer, ties included, and the
first k end the search of the shard. Shards themselves are nodes: Spark sums the roots for each item and shard, the
best ``FIRST`` shards of each item are searched first, and the k-th score they reach lets the others stop at
once if their roots add up to less (equal ones are opened). Spark ranks the k best of all shards.

The query set is read in blocks of at most ``BLOCK_TERMS`` distinct terms and ``BLOCK_ITEMS`` items, whose weights are
broadcast; each block reads the documents anew.

Edge cases: a null or empty text has no terms and is not counted in N; an item without terms has no result. Documents of
score 0 are no results. Equal scores go by ascending doc_id, null ids last; rows that repeat an id are documents
of their own. Rows that repeat an item are ranked each on its own. Very long texts make a shard of their own.
Extra columns are never read. Without documents, or without items, the result is empty. Ids are whole numbers.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanegraph.llm.common import groups
from lanegraph.llm.words import byte_set, split_words, word_hashes
from lanegraph.shared import materialize

FAN = 8
SHARD_DOCS = 2048
FIRST = 3
BLOCK_TERMS = 4096
BLOCK_ITEMS = 1024
SEPARATORS = byte_set(bytes(b for b in range(128) if not chr(b).isalnum()))
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

INDEX = "shard long, term long, top int, docs array<int>, adds array<int>, ids array<long>"


def _terms(texts: list[bytes]):
    words = split_words(texts, SEPARATORS, FOLD)
    return words, word_hashes(words)


def collection_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """N documents with at least one term, and L terms in all of them."""

    def run(batches):
        for _, texts in groups(batches, "text"):
            counts = split_words(texts, SEPARATORS).counts
            yield pa.RecordBatch.from_arrays([pa.array([int((counts > 0).sum())]), pa.array([int(counts.sum())])], names=["n", "l"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "n long, l long")
    row = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("l"), F.lit(0)).alias("l")).first()
    return row["n"], row["l"]


def _parts(batches) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch, texts in groups(batches, "text"):
        for lo in range(0, len(texts), SHARD_DOCS):
            yield batch.slice(lo, SHARD_DOCS), texts[lo : lo + SHARD_DOCS]


def build_index(docs: DataFrame, size: tuple[int, int], text: str = "text", key: str = "doc_id", terms: np.ndarray | None = None) -> DataFrame:
    """INDEX rows of all shards, for all terms or the given hashes; a shard's row without a term holds its ids."""
    n_docs, n_terms = size

    def run(batches):
        place = TaskContext.get().partitionId() << 32
        for batch, texts in _parts(batches):
            yield _shard(place, batch.column(0), texts, n_docs, max(1, n_terms), terms)
            place += 1

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, INDEX)


def _shard(shard: int, ids: pa.Array, texts: list[bytes], n_docs: int, n_terms: int, terms: np.ndarray | None) -> pa.RecordBatch:
    order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
    words, h = _terms([texts[i] for i in order.tolist()])
    m = 25 + (75 * words.counts.astype(np.int64) * n_docs) // n_terms
    doc = words.text
    if terms is not None:
        known = np.isin(h, terms)
        h, doc = h[known], doc[known]
    sort = np.lexsort((doc, h))
    h, doc = h[sort], doc[sort]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    tf = np.diff(np.concatenate([first, [len(h)]]))
    h, doc = h[first], doc[first]
    adds = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    ends = np.concatenate([start, [len(h)]]).astype(np.int32)
    top = np.maximum.reduceat(adds, start) if len(h) else adds
    k = len(start)
    none = lambda kind: pa.nulls(1, kind)
    lists = lambda values: pa.concat_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32))), none(pa.list_(pa.int32()))])
    own = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), ids.take(pa.array(order)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(k + 1, shard, np.int64)),
            pa.concat_arrays([pa.array(h[start].view(np.int64)), none(pa.int64())]),
            pa.concat_arrays([pa.array(top.astype(np.int32)), none(pa.int32())]),
            lists(doc),
            lists(adds),
            pa.concat_arrays([pa.nulls(k, pa.list_(pa.int64())), own]),
        ],
        names=[p.split()[0] for p in INDEX.split(", ")],
    )


class Trees:
    """Max trees of several terms over the documents of one shard: ``levels[0]`` are the leaves, one row a term."""

    def __init__(self, n_docs: int, postings: list[tuple[np.ndarray, np.ndarray]]):
        leaves = np.zeros((len(postings), n_docs), np.int32)
        for row, (docs, adds) in zip(leaves, postings):
            row[docs] = adds
        self.levels = [leaves]
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, below.shape[1], FAN), axis=1))

    def best(self, rows: list[int], weights: list[int], k: int, floor: int = 1) -> tuple[list[tuple[int, int]], int]:
        """(score, document) of the k best with a score of at least ``floor``, equal scores by document, and the number of nodes opened."""
        w = np.array(weights, np.int64)
        own = [level[rows] for level in self.levels]
        bound = int((w * own[-1][:, 0]).sum())
        heap = [(-bound, 0, len(own) - 1)] if bound >= floor else []
        found: list[tuple[int, int]] = []
        opened = 0
        while heap and len(found) < k:
            bound, at, level = heapq.heappop(heap)
            if level == 0:
                found.append((-bound, at))
                continue
            opened += 1
            size = FAN ** (level - 1)
            first = at // size
            sums = w @ own[level - 1][:, first : first + FAN].astype(np.int64)
            for i in np.flatnonzero(sums >= floor).tolist():
                heapq.heappush(heap, (-int(sums[i]), (first + i) * size, level - 1))
        return found, opened


def _search_shards(index: DataFrame, weighted: list[dict[int, int]], floors: list[int], k: int) -> DataFrame:
    """(item, doc_id, score): the k best of each shard for each item with a score of at least its floor."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast((weighted, floors))

    def run(table: pa.Table) -> pa.Table:
        items, least = sent.value
        own = table.column("term").to_pylist()
        ids = next(x for x in table.column("ids").to_pylist() if x is not None)
        at = [i for i, t in enumerate(own) if t is not None]
        row = {own[i]: j for j, i in enumerate(at)}
        docs, adds = table.column("docs"), table.column("adds")
        trees = Trees(len(ids), [(docs[i].values.to_numpy(), adds[i].values.to_numpy()) for i in at])
        rows = []
        for item, weights in enumerate(items):
            here = [t for t in weights if t in row]
            if here:
                found, _ = trees.best([row[t] for t in here], [weights[t] for t in here], k, least[item])
                rows += [(item, ids[d], score) for score, d in found]
        names, kinds = ["item", "doc_id", "score"], [pa.int32(), pa.int64(), pa.int64()]
        return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return index.groupBy("shard").applyInArrow(run, "item int, doc_id long, score long")


def _blocks(items: DataFrame, text: str, key: str) -> Iterator[list[tuple[int, dict[int, int]]]]:
    """Lists of (item id, occurrences by term) within the limits of a block; an item of more terms is a block of its own."""
    block: list[tuple[int, dict[int, int]]] = []
    seen: set[int] = set()
    for row in items.select(F.col(key).cast("long"), F.col(text).cast("string")).toLocalIterator():
        terms = Counter(_terms([(row[1] or "").encode()])[1].view(np.int64).tolist())
        if block and (len(block) >= BLOCK_ITEMS or len(seen | terms.keys()) > BLOCK_TERMS):
            yield block
            block, seen = [], set()
        block.append((row[0], dict(terms)))
        seen |= terms.keys()
    if block:
        yield block


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, size: tuple[int, int], block: list, text: str, key: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    terms = sorted({t for _, own in block for t in own})
    index = materialize(build_index(docs, size, text, key, np.array(terms, np.int64).view(np.uint64)), "search_index")
    postings = index.where("term is not null")
    df = {r["term"]: r["df"] for r in postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df")).collect()}  # BLOCK_TERMS rows at most
    weight = {t: math.floor(1000 * math.log((2 * size[0] + 2) / (2 * n + 1))) for t, n in df.items()}
    weighted = [{t: n * weight[t] for t, n in own.items() if weight.get(t)} for _, own in block]
    # Shards as nodes: the sum of the roots for each item.
    pairs = spark.createDataFrame([(i, t, w) for i, own in enumerate(weighted) for t, w in own.items()], "item int, term long, weight long")
    roots = postings.select("shard", "term", "top").join(F.broadcast(pairs), "term")
    bounds = roots.groupBy("item", "shard").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("bound").desc(), "shard"))
    first = [r["shard"] for r in bounds.withColumn("place", place).where(F.col("place") <= FIRST).select("shard").distinct().collect()]  # FIRST an item
    floors = [1] * len(block)
    if first:
        best = _ranked(_search_shards(index.where(F.col("shard").isin(first)), weighted, floors, k), k)
        for r in best.groupBy("item").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).collect():
            floors[r["item"]] = r["least"]
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], "item int, item_id long")
    found = _ranked(_search_shards(index, weighted, floors, k), k).join(F.broadcast(names), "item")
    return found.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of every item."""
    size = collection_size(docs, text)
    out = None
    for block in _blocks(items, item_text, item_key):
        found = _search_block(docs, size, block, text, key, k)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
