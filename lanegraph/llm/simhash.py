"""SimHash fingerprints, and groups of documents whose fingerprints differ in at most two bits.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, 3-word shingles with repeats (a shorter
text: its whole word sequence), XXH64 with seed 42 of each; a bit is set if it is set in over half
the hashes. No words: zero.

Groups: distinct fingerprints are embedded by their bit counts in 32 segments of two bits. The
Manhattan distance of two embeddings is at most the Hamming distance of the fingerprints, so a link
(Hamming <= 2) is a range join of radius 2 in that space. The 32 coordinates form 6 groups; two
points within radius 2 agree in at least 4 of them, so each point enters the 15 grid cells that are
given by 4 groups' coordinates, and every link has a cell in common. Cells of up to ``CELL`` points
are compared directly (first the Manhattan bound, then the fingerprints). Points of fuller cells,
which a group of slightly differing copies makes, are instead keyed by the 65 fingerprints within
one bit of theirs: two fingerprints are within two bits exactly if they share such a key, at most 65
points share one, and linking all of them to the smallest gives the same components in linear work.

Near copies (``near_documents``, ``keep_one``) are texts whose sets of 5-word shingles have a Jaccard
similarity of at least 0.8. Whole-text fingerprints of such pairs differ by about ten bits, beyond any
grid that stays selective, so SAMPLES further fingerprints are made, each the SimHash of SAMPLE shingles
chosen min-wise; two texts of similarity s agree in one with probability about s^4, so a pair at 0.8 is
missed by all twelve in 0.2 % of cases, one at 0.9 in fewer than 0.001 %. All fingerprints are embedded
by segment counts; samples meet in equal cells, whole texts in the grid above. Candidates are verified
on their shingle sets. Cells of up to ``CELL`` texts compare all pairs; in fuller ones, which texts of one template
fill, each member is compared with the smallest. Where the members then still form several groups, all members of such
cells are joined on their sets (``crowd_links``): similar sets share one of their rarest fifth of shingles (prefix
filtering). Shingles of up to ``CELL`` members give pairs of members of different groups. Sets that are alike in more
frequent shingles only are gathered by these, as texts of one template: within it, links hold between members only if they hold to
the shortest. The shortest of all templates, also of those that a single text has, are compared in blocks of bounded size
(``_all_pairs``), whatever the frequency of a shingle, and links between them are carried on to the members. So no
link between two groups of such cells is lost.

Components come from alternating large-star and small-star rounds over tables in the shared folder.

Edge cases: a null text is an empty one. Rows with a null doc_id get the component of their
fingerprint; they lead a component only if it has no other row (component_id null). Repeated rows
and equal ids are one node each per fingerprint. Other columns are ignored here and carried by
``keep_one``. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegraph.llm.common import map_texts
from lanegraph.shared import materialize

CELL = 24
HEAVY = 1024
#: Near copies: word shingles of this size, so similar (Jaccard), found by so many samples of so many shingles.
SHINGLE = 5
SIMILARITY = 0.8
SAMPLES = 12
SAMPLE = 4
#: Two blocks of about so many sets, or of so many shingles, are compared in a task.
BLOCK_ROWS, BLOCK_TOKENS = 2048, 1 << 20
SEGMENTS_MASK = 0x5555555555555555
#: The 32 two-bit segments in 6 groups.
SEGMENT_GROUPS = [range(0, 6), range(6, 12), range(12, 17), range(17, 22), range(22, 27), range(27, 32)]


def shingle_hashes(words: list[bytes], size: int) -> list[int]:
    """XXH64 of every shingle of ``size`` words, in order; of the whole sequence if it is shorter."""
    h64 = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= size:
        return [h64(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = [0, *ends[:-size].tolist()]
    return [h64(joined[a:b], 42) for a, b in zip(first, (ends[size - 1 :] - 1).tolist())]


def _over_texts(texts: list[bytes], size: int, flush) -> list[list[bytes]]:
    """Calls ``flush(places, hashes, starts, sizes)`` with the shingles of about 200,000 words at a time; returns all words."""
    hashes: list[int] = []
    sizes: list[int] = []
    at: list[int] = []

    def out():
        if at:
            n = np.array(sizes, np.int64)
            flush(np.array(at), np.array(hashes, np.uint64), np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        hashes.clear(), sizes.clear(), at.clear()

    kept = []
    for i, t in enumerate(texts):
        words = t.lower().split()
        kept.append(words)
        if words:
            own = shingle_hashes(words, size)
            hashes.extend(own)
            sizes.append(len(own))
            at.append(i)
            if len(hashes) > 200_000:
                out()
    out()
    return kept


def _majority(h: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint_texts(texts: list[bytes], size: int = 3) -> list[np.ndarray]:
    """SimHash of each text as a signed 64-bit integer."""
    out = np.zeros(len(texts), np.uint64)

    def flush(at, h, starts, n):
        out[at] = _majority(h, starts, n)

    _over_texts(texts, size, flush)
    return [out.view(np.int64)]


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, fp (signed 64 bits) of every whole text."""
    return map_texts(docs, text, [key], "fp long", fingerprint_texts)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def embedding(fp: Column) -> Column:
    """Bit counts (0, 1, 2) of the 32 segments, two bits each."""
    m = F.lit(SEGMENTS_MASK)
    low, high = fp.bitwiseAND(m), F.shiftrightunsigned(fp, 1).bitwiseAND(m)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Distance of two embeddings: counts written in unary (00, 01, 11) differ in as many bits."""
    m, top = F.lit(SEGMENTS_MASK), F.lit(_signed(0xAAAAAAAAAAAAAAAA))

    def unary(e: Column) -> Column:
        return e.bitwiseOR(F.shiftrightunsigned(e, 1)).bitwiseAND(m).bitwiseOR(e.bitwiseAND(top))

    return F.bit_count(unary(a).bitwiseXOR(unary(b)))


def _cells(e: Column) -> Column:
    cells = []
    for k, chosen in enumerate(combinations(range(6), 4)):
        mask = sum(3 << (2 * s) for g in chosen for s in SEGMENT_GROUPS[g])
        cells.append(F.struct(F.lit(k).cast("byte").alias("grid"), e.bitwiseAND(F.lit(_signed(mask))).alias("cell")))
    return F.array(*cells)


def links(points: DataFrame, cell_limit: int = CELL) -> DataFrame:
    """``points``: node, fp, with distinct fp. Links (u, v), u > v, that connect the same nodes as all pairs within two bits."""
    keyed = points.select("node", "fp", F.explode(_cells(embedding(F.col("fp")))).alias("c")).select("node", "fp", "c.*")
    sizes = keyed.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(join_skewed(keyed, sizes, ["grid", "cell"], 15 * points.count()), "cells")
    compared = (
        shared.where(F.col("n") <= cell_limit)
        .groupBy("grid", "cell")
        .agg(F.collect_list(F.struct("node", "fp")).alias("m"))
        .select("m", F.explode("m").alias("a"))
        .select(
            F.col("a.node").alias("u"),
            F.explode(
                F.filter(
                    "m",
                    lambda b: (b["node"] < F.col("a.node"))
                    & (manhattan(embedding(b["fp"]), embedding(F.col("a.fp"))) <= 2)
                    & (F.bit_count(b["fp"].bitwiseXOR(F.col("a.fp"))) <= 2),
                )
            ).alias("b"),
        )
        .select("u", F.col("b.node").alias("v"))
    )
    full = shared.where(F.col("n") > cell_limit).select("node", "fp").distinct()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    balls = (
        full.select("node", F.explode(near).alias("z"))
        .groupBy("z")
        .agg(F.min("node").alias("v"), F.collect_set("node").alias("us"))
        .where(F.size("us") > 1)
        .select(F.explode("us").alias("u"), "v")
        .where("u > v")
    )
    return compared.unionByName(balls).distinct()


def components(edges: DataFrame, tag: str = "stars") -> DataFrame:
    """Edges (u, v) with u > v to (u, v) with v the smallest node of u's component, for every u that is not it.

    Alternating stars halve the distance to the smallest node each round; a round that changes nothing ends it.
    """
    e = materialize(edges.select("u", "v"), tag)
    seen = None
    while True:
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return e
        seen = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), tag)


def group_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, fp and component_id (smallest key that can be reached over links) of every row."""
    prints = materialize(fingerprints(docs, text, key), "prints")
    nodes = prints.groupBy("fp").agg(F.min(key).alias("node"), F.count("*").alias("n"))
    nodes = materialize(nodes, "nodes")
    # One id on several texts would be one node with several fingerprints; such a node joins their components.
    stars = components(links(nodes.where("node is not null").drop("n")).unionByName(_same_key(prints, nodes, key)))
    of = nodes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("least")), "node", "left").select("fp", "n", F.coalesce("least", "node").alias("component_id"))
    return join_skewed(prints, of, ["fp"], prints.count()).drop("n")


def _same_key(prints: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Links between the nodes of fingerprints that share an id (rows that repeat an id with another text)."""
    several = prints.groupBy(key).agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select(key)
    seen = prints.join(several, key).select(key, "fp").distinct().join(nodes, "fp")
    least = seen.groupBy(key).agg(F.min("node").alias("v"))
    return seen.join(least, key).select(F.col("node").alias("u"), "v").where("u > v").distinct()


# --- near copies: similarity of the sets of word shingles --------------------------------------


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors (SAMPLES, SAMPLE) that order the shingles anew, and their inverses modulo 2^64."""
    odd = np.random.default_rng(20240611).integers(0, 1 << 63, (SAMPLES, SAMPLE)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    inverse = odd.copy()
    for _ in range(6):
        inverse *= np.uint64(2) - odd * inverse
    return odd, inverse


def sketch_texts(texts: list[bytes], size: int = SHINGLE) -> list:
    """Digest of the word sequence, SimHash of all shingles, and SAMPLES SimHashes of SAMPLE min-wise shingles each (null without words)."""
    odd, inverse = _multipliers()
    whole = np.zeros(len(texts), np.uint64)
    parts = np.zeros((len(texts), SAMPLES), np.uint64)
    has = np.zeros(len(texts), bool)

    def flush(at, h, starts, n):
        has[at] = True
        whole[at] = _majority(h, starts, n)
        for k in range(SAMPLES):
            a, b, c, d = (np.minimum.reduceat(h * odd[k, j], starts) * inverse[k, j] for j in range(SAMPLE))
            parts[at, k] = (a & b & (c | d)) | (c & d & (a | b))  # set in over half of the four

    words = _over_texts(texts, size, flush)
    lists = pa.array([p if x else None for p, x in zip(parts.view(np.int64).tolist(), has.tolist())], pa.list_(pa.int64()))
    return [pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary()), whole.view(np.int64), lists]


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[pa.Array]:
    """Distinct shingle hashes of each text."""
    out = [np.zeros(0, np.int64)] * len(texts)

    def flush(at, h, starts, n):
        for i, x, k in zip(at.tolist(), starts.tolist(), n.tolist()):
            out[i] = np.unique(h[x : x + k]).view(np.int64)

    _over_texts(texts, size, flush)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in out])])
    return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*out, np.zeros(0, np.int64)])))]


def join_skewed(rows: DataFrame, small: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join with ``small``, one row per key, whose ``n`` says how many of ``total`` rows have the key.

    Keys of more than one row in HEAVY are at most HEAVY, so they are broadcast; in the shuffle of the others none is hot.
    """
    heavy = small.where(F.col("n") > max(1, total // HEAVY))
    light = small.where(F.col("n") <= max(1, total // HEAVY))
    near = rows.join(F.broadcast(heavy), keys)
    return near.unionByName(rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys))


def _in_cells(shared: DataFrame, cell_limit: int) -> DataFrame:
    """Pairs (a, b), a > b, of the members ``seq`` of each cell (t, cell, n, least): all of small cells, stars of full ones."""
    small = shared.where(F.col("n") <= cell_limit).groupBy("t", "cell").agg(F.collect_list("seq").alias("m"))
    small = small.select("m", F.explode("m").alias("a")).select("a", F.explode(F.filter("m", lambda b: b < F.col("a"))).alias("b"))
    return small.unionByName(shared.where((F.col("n") > cell_limit) & (F.col("seq") > F.col("least"))).select(F.col("seq").alias("a"), F.col("least").alias("b")))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v), u > v, between the nodes of the pairs whose shingle sets are similar enough. A member of many pairs is spread over 64 keys."""
    salt = F.pmod(F.xxhash64("a"), F.lit(64)).cast("int")
    salted = pairs.distinct().withColumn("salt", salt)
    right = salted.select("b", "salt").distinct().join(sets.toDF("b", "v_node", "v_set"), "b")
    both = salted.join(sets.toDF("a", "u_node", "u_set"), "a").join(right, ["b", "salt"])
    common = F.size(F.array_intersect("u_set", "v_set")).cast("double")
    alike = common >= F.lit(similarity) * (F.size("u_set") + F.size("v_set") - common) - F.lit(1e-9)
    return both.where(alike & (F.col("u_node") != F.col("v_node"))).select(F.greatest("u_node", "v_node").alias("u"), F.least("u_node", "v_node").alias("v")).distinct()


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Places of pairs (a, b) that connect the same of n rows as all of them do; fewer than n."""
    at, label, kept = np.arange(len(a)), np.arange(n), [np.zeros(0, np.int64)]
    while True:
        x, y = label[a[at]], label[b[at]]
        at, x, y = at[x != y], x[x != y], y[x != y]
        if not len(at):
            return np.concatenate(kept)
        larger, first = np.unique(np.maximum(x, y), return_index=True)
        kept.append(at[first])
        to = np.arange(n)
        to[larger] = np.minimum(x, y)[first]
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def _common(rows: tuple[pa.ListArray, pa.ListArray]) -> np.ndarray:
    """How many values each list on one side has in common with each on the other; no list has repeats."""
    held = [(np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy())), x.flatten().to_numpy()) for x in rows]
    both = np.intersect1d(np.unique(held[0][1]), np.unique(held[1][1]))
    parts = []
    for row, value in held:
        known = np.isin(value, both)
        col = np.searchsorted(both, value[known])
        order = np.argsort(col, kind="stable")
        parts.append((row[known][order], col[order]))
    out = np.zeros((len(rows[0]), len(rows[1])), np.float32)
    for lo in range(0, len(both), BLOCK_ROWS):
        strip = []
        for (row, col), x in zip(parts, rows):
            i, j = np.searchsorted(col, [lo, lo + BLOCK_ROWS])
            has = np.zeros((len(x), min(BLOCK_ROWS, len(both) - lo)), np.float32)
            has[row[i:j], col[i:j] - lo] = 1.0
            strip.append(has)
        out += strip[0] @ strip[1].T
    return out


def _block_links(similarity: float):
    """Links (a, b) between the sets (seq, size, tokens, in, many) of two blocks, or within one: of those without members as many as connect the same."""

    def run(table: pa.Table) -> pa.Table:
        sides = [table.filter(pc.equal(table["side"], k)).combine_chunks() for k in (0, 1)]
        alone = not len(sides[1])
        sides = [sides[0], sides[0]] if alone else sides
        first = len(sides[0])
        common = _common(tuple(x["tokens"].combine_chunks() if isinstance(x["tokens"], pa.ChunkedArray) else x["tokens"] for x in sides)).astype(np.float64)
        sizes, many = ([x[c].to_numpy() for x in sides] for c in ("size", "many"))
        known: dict[str, int] = {}
        ins = [np.array([known.setdefault(v, len(known)) for v in x["in"].to_pylist()], np.int64) for x in sides]
        alike = common >= similarity * (sizes[0][:, None] + sizes[1][None, :] - common) - 1e-9
        i, j = np.nonzero(alike & (ins[0][:, None] != ins[1][None, :]))
        if alone:
            i, j = i[i > j], j[i > j]
        wide = many[0][i] | many[1][j]
        place = j if alone else j + first
        bare = np.flatnonzero(~wide)
        kept = np.concatenate([np.flatnonzero(wide), bare[_spanning(i[bare], place[bare], first + (0 if alone else len(sides[1])))]])
        return pa.table([sides[0]["seq"].take(pa.array(i[kept])), sides[1]["seq"].take(pa.array(j[kept]))], names=["a", "b"])

    return run


def _all_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between ``sets`` (seq, size, tokens, in, many) that are alike in their tokens and not ``in`` the same group.

    All of those that a set with members (``many``) has; the others' connect the same sets as all would. Sets meet if a chain of
    rare tokens (prefix filtering) links them, and then in blocks: a task compares two blocks of about BLOCK_ROWS sets and
    BLOCK_TOKENS tokens, whatever the frequency of a token. Blocks of one large group are not compared with each other.
    """
    each = sets.select("seq", "in", "size", F.size("tokens").alias("m"), F.explode("tokens").alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("seq").orderBy("n", "token"))
    needed = F.ceil(F.lit(similarity) * F.col("size") - F.lit(1e-9))
    heads = join_skewed(each, counts, ["token"], each.count()).withColumn("place", place).where(F.col("place") <= F.col("m") - needed + 1)
    heads = materialize(heads.select("seq", "in", "token"), "crowd_heads")
    mixed = heads.groupBy("token").agg(F.count("*").alias("n"), F.min("seq").alias("least"), F.min("in").alias("lo"), F.max("in").alias("hi")).where("lo <> hi")
    chain = join_skewed(heads, mixed.select("token", "n", "least"), ["token"], heads.count()).where("seq > least").select(F.col("seq").alias("u"), F.col("least").alias("v"))
    chains = components(chain.distinct(), "crowd_chains")
    member = chains.toDF("seq", "chain").unionByName(chains.select(F.col("v").alias("seq"), F.col("v").alias("chain")).distinct())
    rows = materialize(sets.join(member, "seq"), "crowd_rows")
    parts = lambda n, tokens: F.ceil(F.greatest(n / BLOCK_ROWS, tokens / BLOCK_TOKENS)).cast("int")
    sizes = rows.groupBy("chain", "in").agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("tokens"))
    sizes = materialize(sizes.withColumn("own", parts(F.col("n"), F.col("tokens"))), "crowd_sizes")
    pools = sizes.where("own = 1").groupBy("chain").agg(parts(F.sum("n"), F.sum("tokens")).alias("pool"))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("string")
    dealt = rows.join(sizes.select("chain", "in", "own"), ["chain", "in"]).join(pools, "chain", "left")
    block = F.when(F.col("own") > 1, F.concat("in", F.lit("/"), number("seq", "own"))).otherwise(F.concat(F.lit("/"), number("in", "pool")))
    dealt = materialize(dealt.select("chain", block.alias("block"), F.when(F.col("own") > 1, F.col("in")).alias("of"), "seq", "size", "tokens", "in", "many"), "crowd_blocks")
    blocks = dealt.select("chain", "block", "of").distinct()
    two = blocks.toDF("chain", "x", "x_of").join(blocks.toDF("chain", "y", "y_of"), "chain").where("x <= y and (x_of is null or y_of is null or x_of <> y_of)").select("chain", "x", "y")
    two = materialize(two, "crowd_block_pairs")
    cols = ["chain", "x", "y", "seq", "size", "tokens", "in", "many"]
    left = dealt.join(two, (dealt["chain"] == two["chain"]) & (dealt["block"] == two["x"])).drop(two["chain"]).select(*cols, F.lit(0).alias("side"))
    right = dealt.join(two, (dealt["chain"] == two["chain"]) & (dealt["block"] == two["y"])).drop(two["chain"]).where("x <> y").select(*cols, F.lit(1).alias("side"))
    return left.unionByName(right).groupBy("chain", "x", "y").applyInArrow(_block_links(similarity), "a binary, b binary")


def crowd_links(sets: DataFrame, similarity: float, limit: int) -> DataFrame | None:
    """Links (u, v) that connect all groups of ``sets`` (seq, shingles, component_id) of which two sets are alike; None if there are none to try.

    Sets are ordered by the rarity of their shingles. Alike sets that share no rare shingle are alike in frequent ones, and those
    make up ``similarity`` of both: sets with the same frequent shingles meet the shortest of them, their template's. The
    templates' shortest sets, also of those that one set alone has, are compared by ``_all_pairs``, and links between them
    are carried on to the members.
    """
    by_seq = sets.select("seq", F.col("seq").alias("node"), "shingles")
    of = sets.select("seq", F.concat(F.lit("c"), F.col("component_id").cast("string")).alias("in"))
    each = materialize(sets.select("seq", F.size("shingles").alias("size"), F.explode("shingles").alias("token")), "crowd_shingles")
    if not each.limit(1).count():
        return None
    known = each.join(each.groupBy("token").agg(F.count("*").alias("n")), "token")
    place = F.row_number().over(Window.partitionBy("seq").orderBy("n", "token"))
    needed = F.ceil(F.lit(similarity) * F.col("size") - F.lit(1e-9))
    ranked = materialize(known.select("seq", "size", "token", "n", (place <= F.col("size") - needed + 1).alias("first")), "crowd_tokens")
    # Members of one group need no more links.
    rare = ranked.where(F.col("first") & (F.col("n") > 1) & (F.col("n") <= limit)).select("seq", "token").join(of, "seq")
    buckets = rare.groupBy("token").agg(F.collect_list(F.struct("seq", "in")).alias("m"))
    pairs = buckets.select("m", F.explode("m").alias("x"))
    pairs = pairs.select(F.col("x.seq").alias("a"), F.explode(F.filter("m", lambda y: (y["seq"] < F.col("x.seq")) & (y["in"] != F.col("x.in")))["seq"]).alias("b"))
    often = ranked.where(F.col("n") > limit).groupBy("seq", "size").agg(F.sort_array(F.collect_list("token")).alias("tokens"), F.collect_list(F.when(F.col("first"), F.col("token"))).alias("heads"))
    often = materialize(often.where(F.size("tokens") >= needed).join(of, "seq").withColumn("sign", F.xxhash64("tokens", F.size("tokens"))), "crowd_often")
    # Only a set that has a shingle among its first ones in common with another group's may have a link.
    heads = often.select("seq", "in", F.explode("heads").alias("token"))
    mixed = heads.groupBy("token").agg(F.count("*").alias("n"), F.min("in").alias("lo"), F.max("in").alias("hi")).where("lo <> hi").select("token", "n")
    some = join_skewed(heads, mixed, ["token"], heads.count()).select("seq").distinct()
    often = materialize(often.join(some, "seq", "left_semi").drop("heads"), "crowd_signs")
    groups = often.groupBy("sign").agg(F.min(F.struct("size", "seq")).alias("least"), F.min_by("tokens", F.struct("size", "seq")).alias("tokens"), F.count("*").alias("n"), F.min("in").alias("lo"), F.max("in").alias("hi"))
    one = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.concat(F.lit("t"), F.hex("least.seq")))
    groups = materialize(groups.select("sign", F.col("least.seq").alias("to"), F.col("least.size").alias("size"), "tokens", "n", one.alias("in")), "crowd_groups")
    members = join_skewed(often.select("seq", "sign", F.col("in").alias("own")), groups.where("n > 1").select("sign", "to", "n"), ["sign"], often.count()).where("seq <> to")
    members = materialize(members.select("seq", "to", "own"), "crowd_members")
    pairs = pairs.unionByName(members.select(F.greatest("seq", "to").alias("a"), F.least("seq", "to").alias("b")))
    links = None
    if groups.limit(1).count():
        found = materialize(_all_pairs(groups.select(F.col("to").alias("seq"), "size", "tokens", "in", (F.col("n") > 1).alias("many")), similarity), "crowd_templates")
        links = found.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        # A template's links with another's shortest set are tried for its members too.
        ends = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).toDF("to", "other")
        wider = members.join(ends, "to").join(groups.select(F.col("to").alias("other"), F.col("in").alias("theirs")), "other").where("own <> theirs")
        pairs = pairs.unionByName(wider.select(F.greatest("seq", "other").alias("a"), F.least("seq", "other").alias("b")))
    new = _verified(materialize(pairs.distinct(), "crowd_pairs"), by_seq, similarity)
    return materialize(new if links is None else new.unionByName(links).distinct(), "crowd_links")


def near_components(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, cell_limit: int = CELL) -> tuple[DataFrame, DataFrame]:
    """(key, seq, n) of every row's word sequence, with n rows alike, and (seq, node, component_id) of each sequence that has an id."""
    sketches = materialize(map_texts(docs, text, [key], "seq binary, fp long, parts array<long>", sketch_texts), "sketches")
    nodes = sketches.groupBy("seq").agg(F.min(key).alias("node"), F.first("fp").alias("fp"), F.first("parts").alias("parts"), F.count("*").alias("n"))
    nodes = materialize(nodes, "sequences")
    texts = nodes.where("node is not null and parts is not null")
    total = max(1, texts.count()) * SAMPLES
    # Candidates: equal cells of the samples' embeddings, and whole-text fingerprints within two bits.
    cells = texts.select("seq", F.posexplode("parts").alias("t", "part")).select("seq", "t", embedding(F.col("part")).alias("cell"))
    sizes = materialize(cells.groupBy("t", "cell").agg(F.count("*").alias("n"), F.min("seq").alias("least")).where("n > 1"), "sample_cells")
    shared = materialize(join_skewed(cells, sizes, ["t", "cell"], total), "sample_members")
    points = materialize(texts.groupBy("fp").agg(F.min("seq").alias("node"), F.count("*").alias("n")), "points")
    same = join_skewed(texts.select("seq", "fp"), points.where("n > 1").withColumnRenamed("node", "least"), ["fp"], total // SAMPLES)
    pairs = _in_cells(shared, cell_limit).unionByName(same.where("seq > least").select(F.col("seq").alias("a"), F.col("least").alias("b")))
    pairs = materialize(pairs.unionByName(links(points.select("node", "fp")).toDF("a", "b")).distinct(), "candidates")
    # Only candidates' texts are fetched, each sequence once.
    wanted = pairs.select(F.col("a").alias("seq")).unionByName(pairs.select(F.col("b").alias("seq"))).distinct().join(texts.select("seq", "node"), "seq")
    fetched = docs.select(F.col(key).alias("node"), F.col(text).alias("__words")).join(wanted.select("node").distinct(), "node")
    sets = map_texts(fetched, "__words", ["node"], "seq binary, shingles array<long>", lambda t: [sketch_digests(t), *shingle_sets(t)])
    sets = materialize(sets.join(wanted, ["node", "seq"]).groupBy("seq").agg(F.first("node").alias("node"), F.first("shingles").alias("shingles")), "sets")
    found = _verified(pairs, sets, similarity).unionByName(_same_key(sketches.select(key, F.col("seq").alias("fp")), nodes.select(F.col("seq").alias("fp"), "node"), key))
    stars = components(found)
    # Full cells whose members fell into several components: a join of these members on their sets.
    of = materialize(_labelled(nodes, stars), "near")
    full = shared.where(F.col("n") > cell_limit).select("t", "cell", "seq")
    if full.limit(1).count():
        told = full.join(of.select("seq", "component_id"), "seq")
        apart = told.groupBy("t", "cell").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).where("a <> b")
        crowd = told.join(apart, ["t", "cell"]).select("seq", "component_id").distinct()
        crowd = materialize(sets.join(crowd, "seq"), "crowd")
        more = crowd_links(crowd, similarity, cell_limit)
        if more is not None:
            node = crowd.select("seq", "node")
            more = more.join(node.toDF("u", "nu"), "u").join(node.toDF("v", "nv"), "v").where("nu <> nv")
            more = more.select(F.greatest("nu", "nv").alias("u"), F.least("nu", "nv").alias("v"))
            of = materialize(_labelled(nodes, components(stars.unionByName(more))), "near")
    return sketches.select(key, "seq"), of


def sketch_digests(texts: list[bytes]) -> pa.Array:
    return pa.array([xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in texts], pa.binary())


def _labelled(nodes: DataFrame, stars: DataFrame) -> DataFrame:
    least = stars.select(F.col("u").alias("node"), F.col("v").alias("least"))
    return nodes.join(least, "node", "left").select("seq", "node", "n", F.coalesce("least", "node").alias("component_id"))


def near_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", **params) -> DataFrame:
    """key and component_id (smallest key of the group of near copies) of every row."""
    rows, of = near_components(docs, text, key, **params)
    return join_skewed(rows, of.select("seq", "n", "component_id"), ["seq"], rows.count()).select(key, "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **params) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, every column as it was. Rows without an id always stay."""
    _, of = near_components(docs, text, key, **params)
    leaders = of.where("node = component_id").select(F.col("node").alias("__key")).distinct()
    rows = docs.select(F.struct("*").alias("__row"), F.col(key).alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    kept = rows.join(leaders, "__key").groupBy("__key").agg(F.min_by("__row", F.xxhash64("__text")).alias("__row")).select("__row.*")
    return kept.unionByName(docs.where(F.col(key).isNull()))
