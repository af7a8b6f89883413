"""Toxicity: averaged subword-bag embeddings under a linear softmax.

A word is the mean of the vectors of its hashed character n-grams (and of its
own bucket), so a misspelling that was never seen shares most of its vector with
the word it hides. A window of words is the mean of its words; a linear softmax
scores it; a document's score is that of its most toxic window, since one insult
in twenty thousand words would vanish in the document's mean. Vectors and softmax
are trained together in numpy.

Only the fit uses a sample, of at most ``max_pos`` + ``max_neg`` labelled rows, with
their whole texts. Scoring reads every whole text.

Cases: null and empty texts (no words) score 0, as near as makes no difference; null
labels are not learned from; several labels of one doc_id count as several rows;
with no labelled rows every score is 0; other columns are ignored, or pass through
``score`` by ``keep`` (where ``score`` is taken, the new column gets underscores in front).
"""

from __future__ import annotations

import zlib
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import fold, free_name, groups, map_rows, word_of

BUCKETS, DIM, WINDOW, THRESHOLD = 1 << 17, 8, 8, 0.3
#: Chunks whose logits a task knows at most, but for those of a million characters.
KNOWN = 200_000
#: The highest logit of words of which nothing is known (a score of 0.2): few documents are toxic.
UNKNOWN = float(np.log(0.2 / 0.8))


def grams(word: str) -> list[int]:
    """Buckets of the word itself and of its n-grams of 3 to 5 characters."""
    w = f"<{word}>"
    out = [zlib.crc32(w.encode()) % BUCKETS]
    for n in (3, 4, 5):
        out += [zlib.crc32(w[i : i + n].encode()) % BUCKETS for i in range(len(w) - n + 1)]
    return out


#: The usual table of CRC-32, by byte.
_CRC = np.array([zlib.crc32(bytes([k])) ^ zlib.crc32(b"\0") for k in range(256)], np.uint32)


def gram_table(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ``grams`` of many words at once, and the number of the word of each, in no particular order."""
    data = np.frombuffer("".join([f"<{w}>" for w in words]).encode(errors="surrogatepass"), np.uint8)
    start = np.flatnonzero((data & 0xC0) != 0x80)  # of characters
    width = np.diff(start, append=len(data))
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    left = np.repeat(np.cumsum(size), size) - np.arange(len(start))  # characters of the word from each one on
    word = np.repeat(np.arange(len(words)), size)
    crc, at = np.full(len(start), 0xFFFFFFFF, np.uint32), np.arange(len(start))
    found = [np.fromiter((zlib.crc32(f"<{w}>".encode(errors="surrogatepass")) for w in words), np.uint32, len(words))]
    owner = [np.arange(len(words))]
    for n in range(5):  # each character's value goes on by the character n places after it
        some = left[at] > n
        crc, at = crc[some], at[some]
        begin, wide = start[at + n], width[at + n]
        for k in range(int(wide.max(initial=0))):
            on = wide > k
            if on.all():
                crc = _CRC[(crc ^ data[begin + k]) & 0xFF] ^ (crc >> np.uint32(8))
            else:
                crc[on] = _CRC[(crc[on] ^ data[begin[on] + k]) & 0xFF] ^ (crc[on] >> np.uint32(8))
        if n >= 2:
            found.append(~crc)
            owner.append(word[at])
    return np.concatenate(found) % np.uint32(BUCKETS), np.concatenate(owner)


@dataclass
class Model:
    """Logit of each bucket after the softmax layer, and of the empty window."""

    bucket_logit: np.ndarray
    bias: float

    def word_logit(self, chunk: str) -> float:
        word = word_of(chunk)
        return float(self.bucket_logit[grams(word)].mean()) if word else 0.0

    def chunk_logits(self, chunks: list[str], most: int = 1 << 14) -> np.ndarray:
        """``word_logit`` of many chunks, some at a time."""
        out = np.zeros(len(chunks))
        words = [word_of(c) for c in chunks]
        lo = 0
        while lo < len(words):
            hi, size = lo, 0
            while hi < len(words) and (hi == lo or size + len(words[hi]) + 2 <= 8 * most):
                size += len(words[hi]) + 2
                hi += 1
            bucket, owner = gram_table(words[lo:hi])
            total = np.bincount(owner, self.bucket_logit[bucket], hi - lo) / np.bincount(owner, minlength=hi - lo)
            out[lo:hi] = np.where([bool(w) for w in words[lo:hi]], total, 0.0)
            lo = hi
        return out


def windows(logits: np.ndarray, size: int = WINDOW) -> np.ndarray:
    starts = np.arange(0, len(logits), size)
    return np.add.reduceat(logits, starts) / np.diff(np.append(starts, len(logits)))


def fit(texts: list[str], labels: list[int], steps: int = 500, batch: int = 512, seed: int = 7, rate: float = 0.02, decay: float = 1e-5) -> Model:
    """Train on windows for about ``steps`` batches.

    Every window of a toxic document starts out toxic; after the first tenth of
    the batches it teaches by its most toxic window, a clean one by its two most
    toxic windows and two others.
    """
    if not texts or len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 60.0 if labels and labels[0] else -60.0)
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    starts, sizes, toks, owner = (array("q") for _ in range(4))
    at = 0
    for d, text in enumerate(texts):
        words = [w for w in map(word_of, text.split()) if w]
        cuts = list(range(0, len(words), WINDOW))
        for c in cuts:
            win = [vocab.setdefault(w, len(vocab)) for w in words[c : c + WINDOW]]
            toks.extend(win)
            starts.append(at)
            sizes.append(len(win))
            owner.append(d)
            at += len(win)
    buckets, ends = array("i"), array("q", [0])
    for w in vocab:
        buckets.extend(grams(w))
        ends.append(len(buckets))
    ptr, flat = np.array(ends), np.array(buckets)
    del buckets, ends, vocab
    tok, start, size, own, y = np.array(toks), np.array(starts), np.array(sizes), np.array(owner), np.array(labels)
    first = np.searchsorted(own, np.arange(len(texts) + 1))
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    top = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    adam = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, top, bias)]

    def spans(p0, n):
        """Positions p0[i] .. p0[i]+n[i]-1 one after another, and where each run starts."""
        run = np.concatenate([[0], np.cumsum(n)[:-1]])
        return np.repeat(p0 - run, n) + np.arange(n.sum()), run

    step = 0
    while step < steps:
        warm = step >= steps // 10
        u = emb @ (top[:, 1] - top[:, 0])
        word = np.add.reduceat(u[flat], ptr[:-1]) / np.diff(ptr)
        score = np.add.reduceat(word[tok], start) / size
        pick = []
        for d in range(len(texts)):
            lo, hi = first[d], first[d + 1]
            if lo == hi:
                continue
            order = lo + np.argsort(-score[lo:hi])
            if not warm:
                pick += rng.choice(order, min(4, len(order)), replace=False).tolist()
            else:
                pick += order[: 1 if y[d] else 2].tolist() + ([] if y[d] else rng.choice(order, min(2, len(order)), replace=False).tolist())
        pick = rng.permutation(np.array(pick))
        pos = max(1, int(y[own[pick]].sum()))
        weight = np.where(y[own[pick]] == 1, max(1.0, 0.5 * (len(pick) - pos) / pos), 1.0).astype(np.float32)
        for lo in range(0, len(pick), batch):
            win, wt = pick[lo : lo + batch], weight[lo : lo + batch]
            where, run = spans(start[win], size[win])
            uniq, inv = np.unique(tok[where], return_inverse=True)
            gpos, grun = spans(ptr[uniq], np.diff(ptr)[uniq])
            g, glen = flat[gpos], np.diff(ptr)[uniq].astype(np.float32)
            wvec = np.add.reduceat(emb[g], grun, axis=0) / glen[:, None]
            n = size[win].astype(np.float32)
            x = np.add.reduceat(wvec[inv], run, axis=0) / n[:, None]
            z = x @ top + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(win)), y[own[win]]] -= 1
            p *= (wt / wt.sum())[:, None]
            dx = (p @ top.T) / n[:, None]
            dtok = np.repeat(dx, size[win], axis=0)
            dword = np.stack([np.bincount(inv, dtok[:, k], len(uniq)) for k in range(DIM)], 1) / glen[:, None]
            spread = np.repeat(dword, np.diff(ptr)[uniq], axis=0)
            demb = np.stack([np.bincount(g, spread[:, k], BUCKETS) for k in range(DIM)], 1).astype(np.float32)
            step += 1
            demb += decay * emb
            for par, grad, (m, v) in zip((emb, top, bias), (demb, x.T @ p, p.sum(0)), adam):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                par -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    u = top[:, 1] - top[:, 0]
    return Model((emb @ u).astype(np.float32), min(float(bias[1] - bias[0]), UNKNOWN))


def training_rows(docs: DataFrame, labels: DataFrame, max_pos: int, max_neg: int) -> tuple[list[str], list[int]]:
    """A bounded hash sample of either class, read with one broadcast of its ids."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~fold("doc_id", 4, 2) & F.col("doc_id").isNotNull())
    part = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in ((1, max_pos), (0, max_neg))]
    picked = docs.select("doc_id", "text").join(F.broadcast(part[0].union(part[1])), "doc_id")  # at most max_pos + max_neg ids
    rows = picked.select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r[0], r[1] or "", r[2]))
    return [r[1] or "" for r in rows], [r[2] for r in rows]


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, threshold: float | None = None) -> DataFrame:
    """``keep`` columns (doc_id by default) and score; with ``threshold`` only rows scored below it."""
    keep = keep or ["doc_id"]
    name = free_name(keep, "score")
    columns = keep if "text" in keep else [*keep, "text"]
    at = columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value
        logit: dict[str, float] = {}  # of the chunks known so far

        def highest(texts):
            """Logits of some texts; new chunks are looked at together."""
            split = [t.split() for t in texts]
            new = [c for c in set().union(*split) if c not in logit]
            if len(logit) + len(new) > KNOWN:
                logit.clear()
                new = list(set().union(*split))
            logit.update(zip(new, m.chunk_logits(new).tolist()))
            get = logit.__getitem__
            return [m.bias + float(windows(np.fromiter(map(get, words), np.float32, len(words))).max()) if words else -60.0 for words in split]

        def rows(*got):
            texts = [t or "" for t in got[at]]
            for lo, hi in groups(texts):
                for z, *row in zip(highest(texts[lo:hi]), *(c[lo:hi] for c in got[: len(keep)])):
                    s = 1 / (1 + np.exp(-min(60.0, max(-60.0, z))))
                    if threshold is None or s < threshold:
                        yield (*row, float(s))

        return rows

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{name}` double"
    return map_rows(docs.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(columns)]), make, schema)


def train(docs: DataFrame, labels: DataFrame, max_pos: int = 2000, max_neg: int = 3000) -> Model:
    return fit(*training_rows(docs, labels, max_pos, max_neg))
