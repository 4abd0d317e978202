"""Words as hashed ids, shared by the models: one id for the core of a word, one more for its marks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanegraph.llm.common import groups

#: ASCII marks that are cut from both ends of a word.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MARK = np.isin(np.arange(256), np.frombuffer(MARKS, np.uint8))


class Memo(dict):
    """word -> make(word), with two generations of at most ``limit`` words each; values never depend on what is kept."""

    def __init__(self, make: Callable[[bytes], object], limit: int = 200_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word: bytes):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        self[word] = value
        return value


def word_units(word: bytes, buckets: int) -> tuple[int, ...]:
    """(core id) or (core id, mark id): the lower-cased core, and a unit for capitals, digits and marks around it."""
    core = word.strip(MARKS)
    low = core.lower()
    if core == word:
        if core.isupper() and len(core) > 1:
            return zlib.crc32(low) % buckets, zlib.crc32(b"\x00^") % buckets
        return (zlib.crc32(low) % buckets,)
    marks = b"\x00" + word.rstrip(MARKS)[: -len(core) or None].strip() + b"\x00" + word[len(word.rstrip(MARKS)) :] if core else b"\x00" + word
    if core.isupper() and len(core) > 1:
        marks = b"\x00^" + marks
    return (zlib.crc32(low) % buckets, zlib.crc32(marks) % buckets) if core else (zlib.crc32(marks) % buckets,)


_LIVE: dict = {}


def drop_live() -> None:
    """Called by operators that keep nothing themselves, so that they do not carry what the stage before left in the worker."""
    _LIVE.clear()


def live(key: tuple, make: Callable[[], object]):
    """What this worker keeps from batch to batch: one thing only. Spark reuses workers, so that of another operator is dropped first."""
    if key not in _LIVE:
        _LIVE.clear()
        _LIVE[key] = make()
    return _LIVE[key]


def coded_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of all texts, each word's place among them, and how many words each text has."""
    parts = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
    words = pc.list_flatten(parts)
    full = pc.greater(pc.binary_length(words), 0)  # white space at the ends of a text makes empty parts
    text = pc.list_parent_indices(parts).filter(full).to_numpy()
    coded = words.filter(full).view(pa.large_binary()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.bincount(text, minlength=len(texts))


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Hashes of longer ranges are taken one by one.
SHORT = 32


def range_crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray, begin: int = 0) -> np.ndarray:
    """``zlib.crc32(range, begin)`` of many ranges of ``data``, a byte of all of them at a time."""
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    crc = np.full(len(order), begin ^ 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-left, -SHORT))
    for k in range(int(left[long]) if long < len(left) else 0):
        x = slice(long, int(np.searchsorted(-left, -k)))
        crc[x] = _CRC[(crc[x] ^ data[at[x] + k]) & 0xFF] ^ (crc[x] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        crc[i] = zlib.crc32(data[at[i] : at[i] + left[i]].tobytes(), begin)
    out = np.empty(len(order), np.int64)
    out[order] = crc
    return out


def units_of_words(words: pa.Array, buckets: int, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """(words, 2 + prefixes): what ``word_units`` gives for each word, then hashes of the first bytes of longer cores; -1 where there is none."""
    _, ends, data = words.buffers()
    end = np.frombuffer(ends, np.int64, len(words) + 1, 8 * words.offset)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    inner = np.flatnonzero(~_MARK[data])
    first, last = np.searchsorted(inner, end[:-1]), np.searchsorted(inner, end[1:])
    some = last > first
    inner = np.append(inner, 0)
    lo, hi = np.where(some, inner[first], end[1:]), np.where(some, inner[last - 1] + 1, end[1:])
    count = lambda a, z: (n := np.concatenate([[0], np.cumsum((data >= a) & (data <= z))]))[hi] - n[lo]
    upper = (hi - lo > 1) & (count(65, 90) > 0) & (count(97, 122) == 0)
    low = _LOWER[data]
    out = np.full((len(words), 2 + len(prefixes)), -1, np.int64)
    out[:, 0] = np.where(some, range_crcs(low, lo, hi - lo) % buckets, -1)
    made: dict[tuple, int] = {}
    odd = np.flatnonzero((lo > end[:-1]) | (hi < end[1:]) | upper)
    for i, word, a, z, u in zip(odd.tolist(), words.take(pa.array(odd)).to_pylist(), (lo - end[:-1])[odd].tolist(), (hi - end[:-1])[odd].tolist(), upper[odd].tolist()):
        key = (word[:a], word[z:], u, a == z)
        if key not in made:
            made[key] = word_units(word, buckets)[-1]
        out[i, int(a < z)] = made[key]
    for j, n in enumerate(prefixes):
        longer = np.flatnonzero(hi - lo > n)
        out[longer, 2 + j] = range_crcs(low, lo[longer], np.full(len(longer), n), zlib.crc32(b"\x01")) % buckets
    return out


def unit_ids(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the units of all texts end to end, and how many each text has. Each distinct word is looked at once."""
    drop_live()
    words, place, n = coded_words(texts)
    own = units_of_words(words, buckets)
    ids = own[place].ravel()
    more = np.concatenate([[0], np.cumsum(own[place, 1] >= 0)])
    ends = np.concatenate([[0], np.cumsum(n)])
    return ids[ids >= 0], n + np.diff(more[ends])


def core_ids(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """One id per word (its lower-cased core), and the number of words of each text. Each distinct word is looked at once."""
    words, place, n = coded_words(texts)
    ids = np.fromiter((zlib.crc32(w.strip(MARKS).lower()) % buckets for w in words.to_pylist()), np.int64, len(words))
    return ids[place], n


def map_rows(df: DataFrame, text: str, schema: str, fn: Callable[[list[bytes]], Iterable]) -> DataFrame:
    """Every row as a struct ``__row`` beside what ``fn`` makes of its whole text, so no column name can clash."""
    rows = df.select(F.struct("*").alias("__row"))
    names = [part.split()[0] for part in schema.split(", ")]

    def with_text(batches):
        for b in batches:  # a view of the struct's own field
            yield pa.RecordBatch.from_arrays([b.column(0), pc.struct_field(b.column(0), text).cast(pa.string())], names=["__row", "__text"])

    def run(batches):
        for part, texts in groups(with_text(batches), "__text"):
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x) for x in fn(texts))], names=["__row", *names])

    return rows.mapInArrow(run, f"__row {rows.schema['__row'].dataType.simpleString()}, {schema}")


def hash_below(key: str | Column, salt: str, share: float | Column) -> Column:
    """True for about ``share`` of the keys, by a hash of 63 bits, so that no table is too large for any share."""
    c = F.col(key) if isinstance(key, str) else key
    part = F.xxhash64(c.cast("string"), F.lit(salt)).bitwiseAND(F.lit((1 << 63) - 1))
    return part.cast("double") < (share if isinstance(share, Column) else F.lit(float(share))) * F.lit(float(1 << 63))


def bounded_sample(rows: DataFrame, key: str, bound: int, salt: str) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of the key alone (all of them if there are fewer)."""
    n = rows.count()
    return rows if n <= bound else rows.where(hash_below(key, salt, bound / n))
