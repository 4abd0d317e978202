"""Language of words and documents: a linear-chain conditional random field.

A word's emission adds up learned weights of hashed features: byte n-grams of 2 to 4 and affixes of
1 to 3 of its lower-cased core (``<core>``), and membership in a language's lexicon (frequent words
of the training sample that lean to one language). Transitions between neighbouring words are
learned with them, on sequences spliced from spans of different training documents, so that switches
occur. Training maximises the conditional likelihood; its gradient and the marginals of a text come
from forward-backward. Texts are decoded side by side, word by word, with one vector of labels each. Of up to
MATRIX_LABELS labels, texts of more than LONG words are decoded in segments of SEG words instead: the
transfer matrices of all segments are made side by side, joined along each document, then the segments are
filled in. Both give the marginals of one pass over the document, whatever the limits. Words are met in blocks of
CELLS numbers, and only a block's forward vectors are held, so memory does not grow with the square of the labels nor
with the length of a text.

Document: the language with the largest mean marginal over its words, which is also the score.

Learning reads at most about PER_LANGUAGE documents of each language (chosen by a hash of the id). All languages are
learned; a language adds 0.26 MB to the model that tasks receive.
Edge cases: words without a letter are left out; a text without letters, a null one, or any text if
nothing could be learned, is ``und`` with score 0. Ties go to the first language in alphabetical
order. Null languages are not learned. Repeated rows are decoded row by row. Only ``doc_id`` and
``text`` are read for prediction, whatever other columns there are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanegraph.llm.common import crc_mod, map_texts
from lanegraph.llm.features import MARKS, hash_below, live

D = 1 << 16
WIDTH = 28
STRIDE = WIDTH - 3
SEG = 64
PER_LANGUAGE = 120
MATRIX_LABELS = 16
LONG = 1024
CELLS = 1 << 22
#: Words times labels of a training batch, and word features times labels that are added up at a time.
TRAIN_CELLS = 1 << 23
SPAN = (3, 40)
TRAIN_LEN = 40
UND = "und"
_LETTER = re.compile(r"[^\W\d_]")


def core_of(word: bytes) -> bytes:
    """Lower-cased core of a word, empty if it has no letter."""
    core = word.strip(MARKS)
    if core.isalpha():
        return core.lower()
    text = core.decode("utf-8", "replace")
    return text.lower().encode() if _LETTER.search(text) else b""


def feature_ids(cores: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, features) ids below D (D itself stands for none), and the first piece of each core.

    A core is one piece; one of more than WIDTH - 2 bytes is cut into pieces that overlap by three bytes. Each n-gram
    is counted in the piece where it starts, heads in the first and tails in the last, so the whole core is read.
    """
    marked = [b"<" + c + b">" for c in cores]
    pieces = [-(-max(len(m) - WIDTH, 0) // STRIDE) + 1 for m in marked]
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]]).astype(np.int64)
    cut = [m[j * STRIDE : j * STRIDE + WIDTH] for m, k in zip(marked, pieces) for j in range(k)]
    n = len(cut)
    opens, ends = np.zeros(n, bool), np.zeros(n, bool)
    opens[first] = True
    ends[first + np.array(pieces) - 1] = True
    raw = np.frombuffer(b"".join(c.ljust(WIDTH, b"\0") for c in cut), np.uint8).reshape(n, WIDTH).astype(np.uint32)
    size = np.fromiter(map(len, cut), np.int64, n)
    out = []

    def mix(h, kind):
        h = (h ^ np.uint32(kind * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h = h * np.uint32(0xC2B2AE35)
        return (h >> np.uint32(16)).astype(np.int32)

    place = np.arange(WIDTH)
    gram = raw.copy()
    for k in range(2, 5):
        gram = gram[:, :-1] * np.uint32(0x01000193) + raw[:, k - 1 :]
        ids = mix(gram, k)
        at = place[: ids.shape[1]]
        ids[(at + k > size[:, None]) | ((at >= STRIDE) & ~ends[:, None])] = D
        out.append(ids)
    row = np.arange(n)
    letters = size - 1 - opens  # bytes of the core in a piece that has its end
    for k in range(1, 4):
        head = np.zeros(n, np.uint32)
        tail = np.zeros(n, np.uint32)
        for j in range(k):
            head = head * np.uint32(0x01000193) + raw[:, 1 + j]
            tail = tail * np.uint32(0x01000193) + raw[row, np.maximum(size - 2 - j, 0)]
        for ids, has in ((mix(head, 8 + k), opens), (mix(tail, 16 + k), ends)):
            ids[~has | (letters < k)] = D
            out.append(ids[:, None])
    return np.hstack(out), first


def _norm(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(a.sum(axis=-1, keepdims=True), 1e-30)


class Crf:
    """Weights by feature and label, a lexicon with weights, start and transition scores."""

    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels = labels
        self.w = np.zeros((D + 1, k), np.float32)
        self.lexicon: dict[bytes, int] = {}
        self.lex = np.zeros((k + 1, k), np.float32)
        self.trans = np.zeros((k, k), np.float32)

    def emissions(self, cores: list[bytes]) -> np.ndarray:
        e = np.empty((len(cores), len(self.labels)), np.float32)
        for lo in range(0, len(cores), 20_000):
            part = cores[lo : lo + 20_000]
            ids, first = feature_ids(part)
            e[lo : lo + len(part)] = np.add.reduceat(self.w[ids].sum(axis=1), first, axis=0)
        e += self.lex[np.fromiter((self.lexicon.get(c, len(self.labels)) for c in cores), np.int64, len(cores))]
        return e

    def marginals(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Marginals (words, labels) of texts of ``sizes`` words laid end to end with emissions ``e``."""
        out = np.zeros(e.shape, np.float32)
        for rows, _, post in self._decoded(e, np.arange(len(e)), sizes):
            out[rows] = post
        return out

    def sums(self, table: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Summed marginals (texts, labels) of texts of ``sizes`` words ``ids``, whose emissions are rows of ``table``."""
        out = np.zeros((len(sizes), table.shape[1]))
        for _, docs, post in self._decoded(table, ids, sizes):
            out[docs] += post.sum(axis=0, dtype=np.float64) if len(docs) < len(post) else post
        return out

    def _decoded(self, table: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of words, the texts they are in, and their marginals, until every word was met."""
        first = np.cumsum(sizes) - sizes
        long = (sizes > LONG) & (table.shape[1] <= MATRIX_LABELS)
        for d in np.flatnonzero(long).tolist():
            rows = np.arange(first[d], first[d] + sizes[d])
            yield rows, np.array([d]), self._by_segments(table[ids[rows]], sizes[d : d + 1])
        yield from self._by_words(table, ids, first, np.where(long, 0, sizes))

    def _by_words(self, table: np.ndarray, ids: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Forward and backward vectors of all texts side by side, in blocks of words from the last to the first.

        Each block's forward vectors are made anew from the vector before it, which a first pass has kept.
        """
        k = table.shape[1]
        t = np.exp(self.trans - self.trans.max())
        docs = np.argsort(-sizes, kind="stable")[: int((sizes > 0).sum())]
        most = max(1, CELLS // k)
        for lo in range(0, len(docs), most):
            own = docs[lo : lo + most]
            start, length = first[own], sizes[own]
            steps = int(length[0])
            active = np.searchsorted(-length, -np.arange(steps), "left")  # texts longer than s
            met = np.cumsum(active)
            cuts = [0]
            while cuts[-1] < steps:
                before = met[cuts[-1] - 1] if cuts[-1] else 0
                cuts.append(max(cuts[-1] + 1, int(np.searchsorted(met, before + most, "right"))))

            def pot(s: int) -> np.ndarray:
                x = table[ids[start[: active[s]] + s]]
                return np.exp(x - x.max(axis=1, keepdims=True))

            def forward(state: np.ndarray, s: int) -> np.ndarray:
                a = active[s]
                return _norm((state[:a] @ t if s else state[:a]) * pot(s))

            kept = [np.ones((len(own), k), np.float32)]
            for lo_s, hi_s in zip(cuts[:-2], cuts[1:-1]):
                state = kept[-1]
                for s in range(lo_s, hi_s):
                    state = forward(state, s)
                kept.append(state)
            beta = np.ones((len(own), k), np.float32)
            for state, lo_s, hi_s in zip(reversed(kept), reversed(cuts[:-1]), reversed(cuts[1:])):
                alpha = []
                for s in range(lo_s, hi_s):
                    state = forward(state, s)
                    alpha.append(state)
                for s in range(hi_s - 1, lo_s - 1, -1):
                    a = active[s]
                    yield start[:a] + s, own[:a], _norm(alpha.pop() * beta[:a])
                    beta[:a] = _norm((beta[:a] * pot(s)) @ t.T)

    def _by_segments(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``marginals`` by the transfer matrices of segments of SEG words."""
        n, k = e.shape
        out = np.zeros((n, k), np.float32)
        if not n:
            return out
        pot = np.exp(e - e.max(axis=1, keepdims=True))
        t = np.exp(self.trans - self.trans.max())
        docs = np.flatnonzero(sizes)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])[docs]
        count = -(-sizes[docs] // SEG)
        doc = np.repeat(np.arange(len(docs)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = first[doc] + nth * SEG
        length = np.minimum(SEG, sizes[docs][doc] - nth * SEG)
        order = np.argsort(-length, kind="stable")
        start, length, doc, nth = start[order], length[order], doc[order], nth[order]
        active = [int(np.searchsorted(-length, -s)) for s in range(SEG)]  # segments longer than s
        m = len(start)
        # Transfer matrix of each segment: row i is the forward vector after it, from label i before it.
        opening = (nth == 0)[:, None, None]  # nothing precedes a text's first word
        move = np.broadcast_to(np.eye(k, dtype=np.float32), (m, k, k)).copy()
        for s in range(SEG):
            a = active[s]
            if not a:
                break
            x = (move[:a] @ t if s else np.where(opening, move, move @ t)[:a]) * pot[start[:a] + s][:, None, :]
            move[:a] = x / np.maximum(x.sum(axis=(1, 2), keepdims=True), 1e-30)
        at = np.empty((len(docs), int(count.max())), np.int64)
        at[doc, nth] = np.arange(m)
        into = np.empty((m, k), np.float32)  # forward vector before the segment
        back = np.empty((m, k), np.float32)  # backward vector after it
        state = np.ones((len(docs), k), np.float32) / k
        by_count = np.argsort(-count, kind="stable")
        live = [int(np.searchsorted(-count[by_count], -s)) for s in range(at.shape[1])]
        for s in range(at.shape[1]):
            d = by_count[: live[s]]
            g = at[d, s]
            into[g] = state[d]
            state[d] = _norm(np.einsum("ni,nij->nj", state[d], move[g]))
        state = np.ones((len(docs), k), np.float32) / k
        for s in reversed(range(at.shape[1])):
            d = by_count[: live[s]]
            g = at[d, s]
            back[g] = state[d]
            state[d] = _norm(np.einsum("nij,nj->ni", move[g], state[d]))
        alpha = np.empty((n, k), np.float32)
        cur = into
        for s in range(SEG):
            a = active[s]
            if not a:
                break
            cur = _norm((cur[:a] @ t if s else np.where(opening[:, 0], cur, cur @ t)) * pot[start[:a] + s])
            alpha[start[:a] + s] = cur
        beta = back.copy()
        for s in reversed(range(SEG)):
            a = active[s]
            if not a:
                continue
            i = start[:a] + s
            out[i] = _norm(alpha[i] * beta[:a])
            beta[:a] = _norm((beta[:a] * pot[i]) @ t.T)
        return out

    def fit(self, texts: list[tuple[bytes, str]], epochs: int = 14, rate: float = 0.08, decay: float = 1e-5, seed: int = 3) -> "Crf":
        k = len(self.labels)
        index = {name: i for i, name in enumerate(self.labels)}
        rng = np.random.default_rng(seed)
        vocab: dict[bytes, int] = {}
        spans: list[tuple[list[int], int]] = []
        counts = [Counter() for _ in range(k)]
        for text, lang in texts:
            ids = [vocab.setdefault(c, len(vocab)) for c in map(core_of, text.split()) if c]
            counts[index[lang]].update(set(ids))
            lo = 0
            while lo < len(ids):
                hi = lo + int(rng.integers(*SPAN))
                spans.append((ids[lo:hi], index[lang]))
                lo = hi
        rng.shuffle(spans)
        words = np.fromiter((i for s, _ in spans for i in s), np.int64)
        gold = np.fromiter((y for s, y in spans for _ in s), np.int64)
        if not len(words):
            self.__init__([])
            return self
        rows = -(-len(words) // TRAIN_LEN)  # the last one is filled up from the first
        words, gold = np.resize(words, (rows, TRAIN_LEN)), np.resize(gold, (rows, TRAIN_LEN))
        cores = list(vocab)
        for word, i in vocab.items():
            seen = [c[i] for c in counts]
            if sum(seen) >= 4 and max(seen) >= 0.8 * sum(seen):
                self.lexicon[word] = int(np.argmax(seen))
        feats, first = feature_ids(cores)
        pieces = np.diff(np.append(first, len(feats)))
        lex = np.fromiter((self.lexicon.get(c, k) for c in cores), np.int64, len(cores))
        params = [self.w, self.lex, self.trans]
        sums = [np.full_like(p, 1e-6) for p in params]
        batch = max(64, min(-(-rows // 8), TRAIN_CELLS // (TRAIN_LEN * k)))
        for _ in range(epochs):
            order = rng.permutation(rows)
            for lo in range(0, rows, batch):
                r = order[lo : lo + batch]
                used, inv = np.unique(words[r], return_inverse=True)
                inv = inv.reshape(len(r), TRAIN_LEN)
                owner = np.repeat(np.arange(len(used)), pieces[used])
                start = np.cumsum(pieces[used]) - pieces[used]
                own = feats[first[used][owner] + np.arange(len(owner)) - start[owner]]
                part = max(1, TRAIN_CELLS // (own.shape[1] * k))
                seen = np.concatenate([self.w[own[at : at + part]].sum(axis=1) for at in range(0, len(own), part)])
                e_used = np.add.reduceat(seen, start, axis=0) + self.lex[lex[used]]
                e = e_used[inv]
                post, pairs = self._expected(e)
                y = gold[r]
                d = -post
                d[np.arange(len(r))[:, None], np.arange(TRAIN_LEN), y] += 1
                g_word = np.stack([np.bincount(inv.ravel(), d[:, :, j].ravel(), len(used)) for j in range(k)], 1)
                f = own.ravel()
                g_w = np.stack([np.bincount(f, np.repeat(g_word[owner, j], feats.shape[1]), D + 1) for j in range(k)], 1)
                g_w[D] = 0
                g_lex = np.stack([np.bincount(lex[used], g_word[:, j], k + 1) for j in range(k)], 1)
                g_lex[k] = 0
                g_t = np.bincount((y[:, :-1] * k + y[:, 1:]).ravel(), minlength=k * k).reshape(k, k) - pairs
                for p, s, g in zip(params, sums, (g_w, g_lex, g_t)):
                    g = g / len(r) - decay * p
                    s += g * g
                    p += (rate * g / np.sqrt(s)).astype(np.float32)
                self.w[D] = 0
                self.lex[k] = 0
        return self

    def _expected(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of equally long sequences, and the expected transition counts of all of them."""
        b, n, k = e.shape
        pot = np.exp(e - e.max(axis=2, keepdims=True)).astype(np.float64)
        t = np.exp(self.trans.astype(np.float64))
        alpha, beta = np.empty_like(pot), np.ones_like(pot)
        alpha[:, 0] = pot[:, 0] / pot[:, 0].sum(1, keepdims=True)
        for s in range(1, n):
            a = (alpha[:, s - 1] @ t) * pot[:, s]
            alpha[:, s] = a / a.sum(1, keepdims=True)
        pairs = np.zeros((k, k))
        for s in range(n - 2, -1, -1):
            x = beta[:, s + 1] * pot[:, s + 1]
            v = x @ t.T
            pairs += t * ((alpha[:, s] / (alpha[:, s] * v).sum(1, keepdims=True)).T @ x)
            beta[:, s] = v / v.sum(1, keepdims=True)
        post = alpha * beta
        return post / post.sum(2, keepdims=True), pairs


def _encode(crf: Crf, key: str, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emissions of words, which of them the letter words of all texts are, end to end, and how many each text has. Words met before are looked up."""
    fresh_start = lambda: {"index": {}, "rows": [np.zeros((0, len(crf.labels)), np.float32)]}
    kept = live(("crf", key), fresh_start)
    if len(kept["index"]) > min(400_000, 4 * CELLS // len(crf.labels)):
        kept.update(fresh_start())
    index = kept["index"]
    words = [t.split() for t in texts]
    fresh: dict[bytes, None] = {}
    for ws in words:
        fresh.update(dict.fromkeys(w for w in ws if w not in index))
    if fresh:
        new = list(fresh)
        cores = [core_of(w) for w in new]
        lettered = [c for c in cores if c]
        base = sum(map(len, kept["rows"]))
        nth = 0
        for w, c in zip(new, cores):
            index[w] = base + nth if c else -1
            nth += bool(c)
        if lettered:
            kept["rows"].append(crf.emissions(lettered))
            if len(kept["rows"]) > 16:
                kept["rows"] = [np.concatenate(kept["rows"])]
    table = np.concatenate(kept["rows"]) if len(kept["rows"]) > 1 else kept["rows"][0]
    kept["rows"] = [table]
    raw = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.fromiter((index[w] for ws in words for w in ws), np.int64, int(raw.sum()))
    doc = np.repeat(np.arange(len(words)), raw)
    good = ids >= 0
    return table, ids[good], np.bincount(doc[good], minlength=len(words)).astype(np.int64)


def predict(crf: Crf, key: str, texts: list[bytes]) -> list:
    """Language and score of each text."""
    names = np.array([*crf.labels, UND], object)
    if not crf.labels:
        return [pa.array([UND] * len(texts)), np.zeros(len(texts))]
    table, ids, sizes = _encode(crf, key, texts)
    mean = crf.sums(table, ids, sizes) / np.maximum(sizes, 1)[:, None]
    best = mean.argmax(1)
    score = np.where(sizes > 0, mean[np.arange(len(texts)), best], 0.0)
    return [pa.array(names[np.where(sizes > 0, best, len(crf.labels))].tolist(), pa.string()), np.clip(score, 0, 1)]


def label_text(crf: Crf, text: str) -> list[tuple[str, str, float]]:
    """(word, language, probability) of every word with a letter: the labels of a code-switched text."""
    words = [w for w in text.encode().split() if core_of(w)]
    if not words or not crf.labels:
        return []
    post = crf.marginals(crf.emissions([core_of(w) for w in words]), np.array([len(words)]))
    return [(w.decode(), crf.labels[int(p.argmax())], float(p.max())) for w, p in zip(words, post)]


def fit(docs: DataFrame, held_out_mod: int = 4, held_out: int = 2, per_language: int = PER_LANGUAGE) -> Crf:
    """Learn from text and non-null lang of the documents that are not held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(crc_mod("doc_id", held_out_mod), F.lit(-1)) != held_out))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = sizes.select("lang", (F.lit(float(per_language)) / F.col("n")).alias("__share"))
    chosen = rows.select("doc_id", "lang", F.col("text").cast("string").alias("text")).join(F.broadcast(share), "lang")
    sample = chosen.where(hash_below("doc_id", "lang", F.col("__share"))).select("doc_id", "lang", "text").toArrow()
    texts = sorted((str(i), lang, t) for i, lang, t in zip(*(sample[c].to_pylist() for c in ("doc_id", "lang", "text"))))
    return Crf(sorted({lang for _, lang, _ in texts})).fit([(t.encode(), lang) for _, lang, t in texts])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    crf = fit(docs)
    key = f"{zlib.crc32(crf.w.tobytes())}-{zlib.crc32(crf.trans.tobytes())}"
    sent = docs.sparkSession.sparkContext.broadcast(crf)
    return map_texts(docs, "text", ["doc_id"], "lang_pred string, score double", lambda texts: predict(sent.value, key, texts))


def label_words(docs: DataFrame, crf: Crf) -> DataFrame:
    """doc_id and its words with their languages, for code-switched texts."""
    sent = docs.sparkSession.sparkContext.broadcast(crf)
    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("prob", pa.float64())]))

    def of(texts: list[bytes]):
        return [pa.array([[dict(zip(("word", "lang", "prob"), x)) for x in label_text(sent.value, t.decode())] for t in texts], kind)]

    return map_texts(docs, "text", ["doc_id"], "words array<struct<word:string,lang:string,prob:double>>", of)
