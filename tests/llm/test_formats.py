import base64
import gzip
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from lanegraph.llm import chat, minhash, packing, queries, warc
from tests.llm.fixtures import DOCS, clashing, documents, frame


# --- MinHash ----------------------------------------------------------------------------------


def shingles(text):
    words = [w for w in (text or "").lower().split() if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_edited_and_next(spark):
    rows = [r for r in documents(5) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    got = {g["doc_id"]: g for g in minhash.compare_edited(clashing(frame(spark, rows)), 5).collect()}
    assert len(got) == len(rows)
    order = sorted(rows)
    by_text = {}
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        g = got[r[0]]
        assert g["n_chars"] == len(text) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert len(g["fingerprint"]) == minhash.BINS and by_text.setdefault(text, g["fingerprint"]) == g["fingerprint"]
        for near, other in ((g["near_edited"], edited), (g["near_next"], after)):
            a, b = shingles(text), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert 0 <= near <= 1 and abs(near - true) < 0.16, (true, near)
    assert minhash.compare_edited(frame(spark, [], DOCS)).count() == 0
    assert minhash.compare_edited(frame(spark, [(1, "a b c d e f g", "en", "s", 0)])).first()["near_next"] == 1.0


def brute_fingerprint(text):
    """The 256 digits from plain bins: the smallest hash of each, empty ones filled along their probe sequence."""
    long = lambda x, seed: xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split("[ \x09-\x0d]+", text.lower()) if w]
    if not words:
        return "0" * 256
    hashes = []
    for i in range(max(1, len(words) - 4)):
        h = 42
        for w in words[i : i + 5]:
            h = long(w, h)
        hashes.append(h)
    order = [*range(128, 256), *range(128)]  # of signed numbers
    least = [min((h for h in hashes if h >> 56 == b), default=None) for b in order]
    rng = np.random.default_rng(17)
    start, stride = rng.integers(0, 256, 256), 2 * rng.integers(0, 128, 256) + 1
    out = ""
    for j, x in enumerate(least):
        t = 0
        while x is None:
            x = least[(int(start[j]) + t * int(stride[j])) % 256]
            t += 1
        out += "0123456789abcdef"[xxhash.xxh64_intdigest(j.to_bytes(4, "little"), long(x, 42)) & 15]
    return out


def test_fingerprint_equals_brute_force(spark):
    rows = [r for r in documents(8, 30) if r[1] is not None]
    for g in minhash.fingerprint(frame(spark, rows).select("text"), key="text").collect():
        assert g["fingerprint"] == brute_fingerprint(g["text"]), g["text"]


def test_one_bucket_or_many_give_the_same(spark):
    docs = frame(spark, documents(6))
    key = lambda g: (str(g["doc_id"]), g["edited_sha256"], g["near_next"])
    assert sorted(map(key, minhash.compare_edited(docs, 1).collect())) == sorted(map(key, minhash.compare_edited(docs, 13).collect()))


def test_no_python_in_plans(spark):
    docs = frame(spark)
    talks = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    for df in (minhash.compare_edited(docs), chat.digest(chat.format_conversations(talks))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_likeness_is_unbiased(spark):
    r = random.Random(3)
    pairs = []
    for i in range(60):
        a = [f"w{r.randrange(10**9)}" for _ in range(400)]
        b = a[:200] + [f"v{r.randrange(10**9)}" for _ in range(200)]
        pairs.append((i, " ".join(a), " ".join(b)))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pairs, "i long, a string, b string").select("a", "b", minhash.likeness(minhash.digits(F.col("a")), minhash.digits(F.col("b"))).alias("n")).collect()
    true = [len(shingles(x["a"]) & shingles(x["b"])) / len(shingles(x["a"]) | shingles(x["b"])) for x in df]
    assert abs(np.mean([x["n"] for x in df]) - np.mean(true)) < 0.02


# --- WARC -------------------------------------------------------------------------------------


def test_normaliser_on_monolithic_stream():
    raws = [warc.record_bytes(i, f"http://x/{i}", b"p" * n, 7 if i == 3 else None) for i, n in enumerate((0, 5, 3_000_000, 9))]
    whole = gzip.compress(b"".join(raws))
    chunks = [whole[i : i + 1000] for i in range(0, len(whole), 1000)]
    made = list(warc.normalise(chunks))
    archive = b"".join(m for *_, m in made)
    assert [zlib.decompress(archive[o : o + n], 31) for o, n, _, _ in made] == raws
    assert gzip.GzipFile(fileobj=io.BytesIO(archive)).read() == b"".join(raws)
    again = list(warc.normalise([archive]))
    assert [m for *_, m in again] == [m for *_, m in made]
    with pytest.raises(ValueError):
        list(warc.normalise([whole[:-20]]))
    with pytest.raises(ValueError):
        list(warc.normalise([gzip.compress(b"hello\r\n\r\n")]))


PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("heavy", [1024, 3, 1])  # all groups broadcast, the larger ones, none
def test_round_trip(spark, monkeypatch, heavy):
    monkeypatch.setattr(warc, "HEAVY", heavy)
    r = random.Random(0)
    rows = [(i, f"http://h/{i}", "é" * r.randrange(5) + str(r.randrange(40))) for i in range(200)]
    rows += [(1000 + i, "u", "error page") for i in range(150)]
    rows += [(500, None, None), (501, "u\r\nX: y", ""), (502, "u", "z" * 3_000_000), (None, "u", "alone"), (None, "u", "é1"), rows[5]]
    pages = clashing(spark.createDataFrame(rows, PAGES)).repartition(3)
    lead, n = {}, {}
    for i, _, h in rows:
        h = h or ""
        n[h] = n.get(h, 0) + 1
        if i is not None:
            lead[h] = max(i, lead.get(h, -1))
    got = sorted(map(tuple, warc.archive_round_trip(pages).collect()), key=str)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = lead.get(h or "") if n[h or ""] > 1 and lead.get(h or "") != i else None
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to))
    assert got == sorted(want, key=str)
    big = {g[0]: g[3] for g in map(tuple, warc.archive_round_trip(pages, min_bytes=10_000).collect())}
    assert set(big.values()) == {"response"}
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_archives_rotate_and_index(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 50_000)
    monkeypatch.setattr(warc, "CHUNK_BYTES", 4_000)
    pages = spark.createDataFrame([(i, "u", str(i) * 3000) for i in range(60)], PAGES)
    members = warc.normalise_archives(warc.write_archives(warc.plan_records(pages)))
    index = warc.sidecar_index(members).orderBy("archive", "offset").collect()
    assert len(index) == 60 and "member" not in members.drop("member").columns
    ends = {}
    for row in index:
        assert row["offset"] == ends.get(row["archive"], 0)
        ends[row["archive"]] = row["offset"] + row["length"]
    assert warc.read_records(members).count() == 60


# --- packing ----------------------------------------------------------------------------------


def test_word_ids_equal_whole_text():
    tokenizers = pytest.importorskip("tokenizers")
    path = packing.vocabulary_path()
    coder, slow = packing.word_ids(path), tokenizers.Tokenizer.from_file(path)
    texts = ["Hello, World!! it's 42 ###x Größe ÉTÉ naïve", "don't ... a b <|endoftext|> İstanbul ΣΑΣ éa", "", " \n ", "x" * 300, "中文 text 12,5%", "Ünü-tz | a"]
    for t in texts:
        assert np.frombuffer(coder.text(t.encode()), np.uint32).tolist() == slow.encode(t, add_special_tokens=False).ids, t


def test_pack_places_every_piece_once(spark):
    rows = documents(9, 120)
    got = packing.pack(clashing(frame(spark, rows)), capacity=64).collect()
    coder = packing.word_ids(packing.vocabulary_path())
    want = []
    for r in rows:
        ids = coder.text((r[1] or "").encode()) + np.array([1], np.uint32).tobytes()
        want += [(r[0], k, lo, min(64, len(ids) // 4 - lo), zlib.crc32(ids[4 * lo : 4 * (lo + 64)])) for k, lo in enumerate(range(0, len(ids) // 4, 64))]
    assert sorted(map(str, want)) == sorted(str((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"])) for g in got)
    by = {}
    for g in got:
        by.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    total = sum(g["length"] for g in got)
    assert len(by) <= 1.15 * -(-total // 64) + 2
    assert packing.pack(frame(spark, [], DOCS)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans(seed):
    rng = np.random.default_rng(seed)
    hist = np.zeros(257, np.int64)
    np.add.at(hist, np.minimum(rng.lognormal(4, 1, rng.integers(1, 4000)).astype(int) + 1, 256), 1)
    plan = packing.plan_packing(hist, 256, 12)
    fill, seen = {}, np.zeros(257, np.int64)
    for length, rank, count, first, offset in plan.runs:
        seen[length] += count
        for k in range(count):
            fill.setdefault(first + k, []).append((offset, length))
    assert (seen == hist).all() and len(fill) == plan.bins
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    ranks = sorted((r[0], r[1], r[2]) for r in plan.runs)
    for (l1, r1, c1), (l2, r2, _) in zip(ranks, ranks[1:]):
        assert r2 == (r1 + c1 if l1 == l2 else 0)
    bound = max(-(-int(hist @ np.arange(257)) // 256), int(hist[129:].sum()))
    assert plan.bins <= 1.06 * bound + 4


def test_best_fit_decreasing_when_all_are_small():
    hist = np.zeros(17, np.int64)
    hist[1], hist[2] = 3, 5
    assert packing.plan_packing(hist, 16).bins == 1
    assert packing.plan_packing(np.zeros(17, np.int64), 16).bins == 0


# --- chat -------------------------------------------------------------------------------------

TALK = "conv_id long, turn long, role string, text string"


def expected(rows):
    talks = {}
    for c, turn, role, text in rows:
        talks.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for c, turns in talks.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[c] = (len(turns), sha(said), len(loss), sha(loss))
    return out


def test_round_trip_of_talks(spark):
    r = random.Random(0)
    nasty = ["</s>", "[INST]", "[/INST]\n", "<role>", "<text>", "\\", "<\\", "\\\\<", "[/TURN]\n", "é", "\n", " ", "$1", "</s>\n"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "to<o>l", "", None]), "".join(r.choice(nasty) for _ in range(r.randrange(6))) or None) for c in range(60) for t in range(r.randrange(1, 7))]
    rows += [(100, None, "user", "a"), (100, 1, "assistant", "b"), (None, 0, "user", "x"), rows[0], (101, 0, "assistant", "z" * 200_000)]
    got = {g["conv_id"]: g for g in chat.digest(chat.format_conversations(clashing(spark.createDataFrame(rows, TALK)))).collect()}
    want = expected(rows)
    assert set(got) == set(want)
    for c, g in got.items():
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == want[c], c
    assert chat.digest(chat.format_conversations(spark.createDataFrame([], TALK))).count() == 0


def test_machine_and_segments(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "[x]"), (2, 0, "assistant", "a"), (3, 0, "user", "u"), (3, 1, "user", "u2"), (4, 0, "user", "u")]
    got = {g["conv_id"]: g for g in chat.format_conversations(spark.createDataFrame(rows, TALK)).collect()}
    assert [got[c]["valid"] for c in (1, 2, 3, 4)] == [True, False, False, False]
    assert [got[c]["first_error"] for c in (1, 2, 3, 4)] == [None, 0, 1, None]
    assert "".join(s["text"] for s in got[1]["segments"]) == got[1]["formatted"]
    assert [s["text"] for s in got[1]["segments"] if s["loss"]] == ["[\\x]"]
    assert "[x" not in got[1]["formatted"]


def test_probe_conversation(spark, tmp_path):
    spark.createDataFrame([(5, 0, "user", "hi"), (5, 1, "assistant", "ho")], TALK).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {g["conv_id"]: g for g in queries.op6_chat(spark, str(tmp_path)).collect()}
    rows = [(-1, 0, "user", queries.PROBE_TEXT), (-1, 1, "assistant", queries.PROBE_TEXT), (5, 0, "user", "hi"), (5, 1, "assistant", "ho")]
    for c, want in expected(rows).items():
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == want
