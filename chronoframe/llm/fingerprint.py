"""Document fingerprints by improved consistent weighted sampling.

A text is a weighted set: its tokens with their counts. For each of ``K`` samples
every term draws two gamma variates and an offset from its own hash, which give
its sample for its weight; the term with the least value wins. Two texts agree in
a sample with the probability of their generalised Jaccard similarity, the sum of
the smaller weights over the sum of the larger ones.

The draws come from one hash per term and sample: 16 bits each for both gammas
(by quantile tables) and the offset. Each winning sample is kept as 16 bits.

Cases: null text is empty; texts without tokens have the all-zero fingerprint and
are alike; equal texts have equal fingerprints; rows that repeat a doc_id follow
one another by text; a null doc_id comes first; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import spark_arrow_schema
from .tokens import mix, token_hashes

K, CHUNK, TERMS = 128, 64, 30_000
ROWS, GATHER = 256, 1024


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of the gamma(2, 1) distribution at the middles of 65536 equal steps."""
    x = np.concatenate([np.geomspace(1e-4, 0.5, 20_000), np.linspace(0.5, 40, 200_000)[1:]])
    return np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + x) * np.exp(-x), x).astype(np.float32)


_GAMMA = _gamma_quantiles()
_LOG_GAMMA = np.log(_GAMMA)
_LOW = np.uint64(0xFFFF)
_SEEDS = mix(np.arange(1, 4096, dtype=np.uint64))


def keys(terms: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """For each term and sample a value that orders terms, with the sample's 16-bit code below it.

    A term of weight 1 has t = 0 whatever its draws, so its code is the same in all samples.
    Rows are made ``ROWS`` at a time, so that what is at hand stays in a core's cache.
    """
    out = np.empty((len(terms), k), np.uint64)
    one = weights == 1
    for some, plain in ((np.flatnonzero(one), True), (np.flatnonzero(~one), False)):
        for lo in range(0, len(some), ROWS):
            rows = some[lo : lo + ROWS]
            term = terms[rows, None]
            h = mix(term ^ _SEEDS[:k])
            r = _GAMMA.take((h & _LOW).view(np.int64))
            log_c = _LOG_GAMMA.take((h >> np.uint64(16) & _LOW).view(np.int64))
            beta = (h >> np.uint64(32) & _LOW).view(np.int64).astype(np.float32)
            beta *= np.float32(1 / 65536)
            if plain:
                code = mix(term) >> np.uint64(48)
                beta = np.subtract(np.float32(1), beta, out=beta)
            else:
                t = np.floor(np.log(weights[rows, None]).astype(np.float32) / r + beta)
                with np.errstate(over="ignore"):
                    code = mix(term + t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
                beta = t - beta + np.float32(1)
            r *= beta
            log_c -= r
            bits = log_c.view(np.uint32)
            bits ^= (bits.view(np.int32) >> 31).view(np.uint32) | np.uint32(1 << 31)  # in the order of the values
            key = bits.astype(np.uint64)
            key <<= np.uint64(16)
            key |= np.maximum(code, np.uint64(1))
            out[rows] = key
    return out


def fingerprints(texts: list[str | None], k: int = K) -> np.ndarray:
    """A row of ``k`` 16-bit codes for each text; zeros for a text without tokens."""
    tok, bounds = token_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    out = np.zeros((len(texts), k), np.uint16)
    if not len(tok):
        return out
    order = np.lexsort((tok, doc))
    doc, tok = doc[order], tok[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tok[1:] != tok[:-1])])
    start = np.flatnonzero(new)
    doc, tok, weight = doc[start], tok[start], np.diff(np.append(start, len(tok)))
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    end = np.append(begin[1:], len(doc))
    lo = 0
    while lo < len(begin):  # texts of about ``TERMS`` terms in all at a time, which share the draws of equal terms
        hi = lo + 1
        while hi < len(begin) and end[hi] - begin[lo] <= TERMS:
            hi += 1
        least = np.full((hi - lo, k), np.iinfo(np.uint64).max)
        for at in range(begin[lo], end[hi - 1], TERMS):  # more than once only for a text with more terms
            some = slice(at, min(end[hi - 1], at + TERMS))
            with np.errstate(over="ignore"):
                _, first, inverse = np.unique(tok[some] + weight[some].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), return_index=True, return_inverse=True)
            made = keys(tok[some][first], weight[some][first], k)
            for n in range(lo, hi):
                for of in range(max(at, begin[n]), min(some.stop, end[n]), GATHER):
                    part = made.take(inverse[of - at : min(of + GATHER, some.stop, end[n]) - at], axis=0).min(0)
                    least[n - lo] = np.minimum(least[n - lo], part)
        out[doc[begin[lo:hi]]] = (least & np.uint64(0xFFFF)).astype(np.uint16)
        lo = hi
    return out


def hexed(codes: np.ndarray) -> str:
    return codes.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1)


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the first ones of another text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, rows_per_bucket: int = 20_000) -> DataFrame:
    """(bucket, tail, doc_id, text): ranges of doc_id, each sorted in a partition of its own.

    The first rows of a range are also sent, as ``tail``, to the range before it
    (those of the first range to the last), so every row's successor is at hand.
    The driver holds the bounds and the least id of each range, nothing else.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    total = docs.count()
    parts = max(1, min(20_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // rows_per_bucket)))
    as_double = docs.select(F.col("doc_id").cast("double").alias("id"))
    bounds = np.unique(as_double.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts)) if parts > 1 else np.empty(0)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.fillna(-np.inf).to_numpy(np.float64), "right"))

    dealt = docs.withColumn("bucket", bucket(F.col("doc_id").cast("double")))
    low = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    least = sorted(tuple(r) for r in as_double.withColumn("bucket", bucket("id")).groupBy("bucket").agg(F.min(F.coalesce("id", F.lit(float("-inf"))))).collect())
    before = {m: least[i - 1][0] for i, (_, m) in enumerate(least)}
    mins = np.array(sorted(before))
    goes = np.array([before[m] for m in mins], np.int64)

    @F.pandas_udf("int")
    def tail(ids: pd.Series) -> pd.Series:
        x = ids.to_numpy(np.float64)
        at = np.minimum(np.searchsorted(mins, x), len(mins) - 1) if len(mins) else np.zeros(len(x), int)
        return pd.Series(np.where(mins[at] == x, goes[at], -1) if len(mins) else np.full(len(x), -1))

    both = dealt.withColumn("_to", F.array("bucket", tail(low))).select(F.posexplode("_to").alias("tail", "bucket"), "doc_id", "text").where("bucket >= 0")
    return both.repartitionByRange(parts, "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "text")


def fingerprint(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = spark_arrow_schema(docs.sparkSession, schema)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        """From rows (doc_id, text); the last one is only the successor of the one before."""
        texts = [r[1] for r in rows]
        edited = [edit(a, b) for a, b in zip(texts, texts[1:])]
        codes = fingerprints(texts + edited, k)
        own, alt = codes[: len(edited)], codes[len(texts) :]
        columns = [
            [r[0] for r in rows[:-1]],
            [len(t) for t in texts[:-1]],
            [hashlib.sha256(t.encode(errors="replace")).hexdigest() for t in edited],
            [hexed(c) for c in own],
            [hexed(c) for c in alt],
            likeness(own, alt),
            likeness(own, codes[1 : len(texts)]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    def run(batches):
        held: list[tuple] = []
        where, closed = None, False
        for b in batches:
            for bucket, late, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != where:
                    held, where, closed = [], bucket, False
                if closed:
                    continue
                held.append((doc_id, text or ""))
                closed = bool(late)
                if len(held) > CHUNK or closed:
                    if len(held) > 1:
                        yield made(held)
                    held = held[-1:]

    return in_order(docs).select("bucket", "tail", "doc_id", "text").mapInArrow(run, schema)
