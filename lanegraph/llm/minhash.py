"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Words are the lower-cased runs without ASCII white space; shingles are five words (a shorter text:
all its words). Each shingle is hashed once; the top 8 bits choose one of 256 bins and the smallest
hash of a bin stands for it. A bin without shingles takes the value of the first filled bin in its own
probe sequence (optimal densification: start and odd stride are hashes of the bin, so the sequence
visits all bins). A bin's value is hashed with the bin's number, so that one value copied into many bins
gives independent digits, and the low 4 bits are packed into a hex digit: 256 digits, 128 bytes.

Two fingerprints that agree in m of 256 digits have likeness ((m / 256) - c) / (1 - c) with
c = 1/16 the share of digits that agree by chance, cut to [0, 1]; its standard error is at most 0.034.

Bins need no grouping: one sentinel per bin (the largest hash of that bin) is added to a text's
hashes before they are sorted, so that the first value of each run of equal top bits is the bin's
minimum, or the sentinel of an empty bin.

Edge cases: null text: empty. A text without words has the fingerprint of 256 zeros, likeness 1 to
another such text and 0 to any other. Ties and repeated rows: rows of equal id are ordered by text;
equal texts have equal fingerprints. Null ids come first in the order; ids are
whole numbers (others are cast, and text that is none fails the query). Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 256
DIGIT_BITS = 4
WORDS = 5
_REST = (1 << 56) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sentinels() -> Column:
    values = [((b << 56) | _REST) for b in range(BINS)]
    return F.array(*[F.lit(v - (1 << 64) if v >= 1 << 63 else v) for v in values])


def _probes() -> tuple[Column, Column]:
    """Start and odd stride of each bin's probe sequence."""
    rng = np.random.default_rng(17)
    start, stride = rng.integers(0, BINS, BINS), 2 * rng.integers(0, BINS // 2, BINS) + 1
    return F.array(*[F.lit(int(x)) for x in start]), F.array(*[F.lit(int(x)) for x in stride])


def shingle_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), "[ \\x09-\\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WORDS)]))
        return F.when(F.size(w) >= WORDS, windows).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return let(hashed, shingles)


def _filled(x: Column) -> Column:
    return F.when(x.bitwiseAND(F.lit(_REST)) != F.lit(_REST), x)


def bin_minima(hashes: Column) -> Column:
    """256 values by bin (in the order of signed hashes); a sentinel marks an empty bin."""

    def firsts(s: Column) -> Column:
        top = lambda x: F.shiftrightunsigned(x, 56)
        return F.filter(s, lambda x, i: (i == 0) | (top(x) != top(F.get(s, i - 1))))

    return let(F.sort_array(F.concat(hashes, _sentinels())), firsts)


def densified(minima: Column) -> Column:
    start, stride = _probes()

    def fill(v: Column, st: Column, sd: Column) -> Column:
        def one(x: Column, j: Column) -> Column:
            probe = lambda t: _filled(F.get(v, (F.get(st, j) + t * F.get(sd, j)).bitwiseAND(F.lit(BINS - 1))))
            early = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(None).cast("bigint"), lambda a, t: F.coalesce(a, probe(t)))
            rest = F.aggregate(F.sequence(F.lit(12), F.lit(BINS - 1)), F.lit(None).cast("bigint"), lambda a, t: F.coalesce(a, probe(t)))
            return F.coalesce(_filled(x), early, rest)

        return F.transform(v, one)

    return let(minima, lambda v: let(start, lambda st: let(stride, lambda sd: fill(v, st, sd))))


def digits(text: Column) -> Column:
    """256 digits 0..15 as array<tinyint>; an empty array for a text without words."""
    low = lambda h: F.transform(densified(bin_minima(h)), lambda x, j: F.xxhash64(x, j).bitwiseAND(F.lit(15)).cast("tinyint"))
    return let(shingle_hashes(text), lambda h: F.when(F.size(h) > 0, low(h)).otherwise(F.array().cast("array<tinyint>")))


def packed(d: Column) -> Column:
    """The digits as a string of 256 hex digits."""
    hexed = F.concat_ws("", F.transform(d, lambda x: F.substring(F.lit("0123456789abcdef"), x.cast("int") + 1, F.lit(1))))
    return F.when(F.size(d) > 0, hexed).otherwise(F.lit("0" * BINS))


def likeness(a: Column, b: Column) -> Column:
    """Bias-corrected share of equal digits of two fingerprints."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)).cast("double") / F.lit(float(BINS))
    c = 1.0 / (1 << DIGIT_BITS)
    estimate = F.least(F.greatest((same - F.lit(c)) / F.lit(1.0 - c), F.lit(0.0)), F.lit(1.0))
    none = (F.size(a) == 0).cast("int") + (F.size(b) == 0).cast("int")
    return F.when(none == 2, F.lit(1.0)).when(none == 1, F.lit(0.0)).otherwise(estimate)


def fingerprint(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and fingerprint of every whole text."""
    return docs.select(F.col(key), packed(digits(F.coalesce(F.col(text), F.lit("")))).alias("fingerprint"))


def with_next(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` (id, text) with the text of the row that follows in the order of ids, the last one's being the first.

    The ids are cut at quantiles into buckets; each bucket also gets a copy of the first row of the next
    one (``ghost``), so windows by bucket suffice and no task sorts the whole table.
    """
    at = F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))
    rows = rows.select("id", "text", at.alias("at"))
    cuts = rows.agg(F.percentile_approx("at", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] if buckets > 1 else []
    cuts = sorted(set(cuts or []))
    if cuts:
        # Every ``step``-th bound first, then those after it: about 2 sqrt(buckets) comparisons a row.
        step = max(1, int(len(cuts) ** 0.5))
        below = lambda b: b <= F.col("at")
        coarse = F.size(F.filter(F.lit(cuts[::step]), below))
        near = F.slice(F.lit(cuts), F.greatest(coarse - 1, F.lit(0)) * step + 1, F.lit(step))
        bucket = F.greatest(coarse - 1, F.lit(0)) * step + F.size(F.filter(near, below))
    else:
        bucket = F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    firsts = sorted((r["bucket"], r["at"]) for r in rows.groupBy("bucket").agg(F.min("at").alias("at")).collect())  # a row per bucket
    if not firsts:
        return rows.select("id", "text", "bucket", F.lit(False).alias("ghost"), F.lit(1).alias("nth"), F.col("text").alias("next_text"))
    before = {at: firsts[i - 1][0] for i, (_, at) in enumerate(firsts)}
    wanted = rows.where(F.col("at").isin(list(before)))
    to = F.create_map(*[x for k, v in before.items() for x in (F.lit(k), F.lit(v))])
    ghosts = wanted.groupBy("at").agg(F.min("text").alias("text")).select(F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "text", "at", to[F.col("at")].alias("bucket"), F.lit(True).alias("ghost"))
    both = rows.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    order = Window.partitionBy("bucket").orderBy("ghost", "at", "text")
    return both.select("id", "text", "bucket", "ghost", F.row_number().over(order).alias("nth"), F.lead("text").over(order).alias("next_text"))


def compare_edited(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document.
    """
    spark = docs.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), n)
    chars = F.length("text").cast("long")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("id", "bucket", "ghost", "nth", "text", chars.alias("n_chars"), F.when(~F.col("ghost"), edited).alias("edited"))
    prints = rows.select(
        "id", "bucket", "ghost", "nth", "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        digits(F.col("text")).alias("d"),
        F.when(~F.col("ghost"), digits(F.col("edited"))).alias("e"),
    )
    order = Window.partitionBy("bucket").orderBy("nth")
    followed = prints.withColumn("f", F.lead("d").over(order)).where(~F.col("ghost"))
    return followed.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        packed(F.col("d")).alias("fingerprint"),
        packed(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("d"), F.col("e")).alias("near_edited"),
        likeness(F.col("d"), F.col("f")).alias("near_next"),
    )
