"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls
back to its character n-grams: at each position the longest n-gram known there
counts, from ``MAX_N`` letters down to one. A text scores the sum over its words.

The fit takes a hash sample of about ``per_lang`` documents of each language;
prediction reads every whole text.

Cases: null text, or text without a letter, is ``und`` with score 0; a null lang
is not learned from; ties go to the alphabetically first language; with no
training rows everything is ``und``; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Rows, fold, map_rows

MAX_N, NONE = 5, "und"


def words_of(chunk: str) -> list[str]:
    """The runs of letters in a chunk, in lower case."""
    w = chunk.lower()
    if w.isalpha():
        return [w]
    return "".join(c if c.isalpha() else " " for c in w).split()


def ngrams(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


@dataclass
class Model:
    """Rows of ``scores`` by word and by n-gram; row 0 is all zeros."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    scores: np.ndarray

    def word(self, w: str) -> np.ndarray:
        known = self.words.get(w)
        if known is not None:
            return self.scores[known]
        spelled, get, found = f"<{w}>", self.grams.get, []
        for i in range(len(spelled) - 1):
            for n in range(MAX_N, 0, -1):
                k = get(spelled[i : i + n])
                if k is not None:
                    found.append(k)
                    break
        # the n-grams of a word overlap: together they count as two observations
        return self.scores[found].sum(0) * (2 / len(spelled)) if found else self.scores[0]

    def chunks(self, many: list[str]) -> np.ndarray:
        """A row for each: the scores, and 1 if there is a letter."""
        out = np.zeros((len(many), len(self.langs) + 1))
        for row, c in zip(out, many):
            parts = words_of(c)
            if parts:
                row[-1] = 1
                for w in parts:
                    row[:-1] += self.word(w)
        return out


def fit(counts: list[tuple[str, int, str, int]]) -> Model:
    """From rows (lang, n, key, count): n = 0 for words, else the n-gram length."""
    langs = sorted({r[0] for r in counts})
    if not langs:
        return Model([], {}, {}, np.zeros((1, 0)))
    place = {x: k for k, x in enumerate(langs)}
    words: dict[str, int] = {}
    grams: dict[str, int] = {}
    rows = [[0.0] * len(langs)]
    length = [-1]
    for lang, n, key, c in counts:
        at = (grams if n else words).setdefault(key, len(rows))
        if at == len(rows):
            rows.append([0.0] * len(langs))
            length.append(n)
        rows[at][place[lang]] += c
    table, length = np.array(rows).reshape(-1, len(langs)), np.array(length)
    for n in range(MAX_N + 1):
        own = length == n
        table[own] = np.log((table[own] + 0.1) / (table[own].sum(0) + 0.1 * (own.sum() + 1)))
    return Model(langs, words, grams, table)


def train(docs: DataFrame, per_lang: int = 1500, min_count: int = 2) -> Model:
    """Counts of a hash sample; keys seen ``min_count`` times, so the model is bounded by the sample."""
    rows = docs.select("doc_id", "text", "lang").where(~fold("doc_id", 3, 1) & F.col("lang").isNotNull())
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_lang)) / F.count(F.lit(1))).alias("_share"))
    shares = {r[0]: r[1] for r in share.collect()}  # one row a language
    if not shares:
        return fit([])
    span = 1 << 30
    pick = F.lit(False)
    for lang, part in sorted(shares.items()):
        pick = pick | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id"), F.lit(span)) < math.ceil(part * span)))

    def make():
        def count(langs, texts):
            said: dict[str, Counter] = {}
            for lang, text in zip(langs, texts):
                said.setdefault(lang, Counter()).update(w for c in (text or "").split() for w in words_of(c))
            for lang, tally in said.items():
                parts: list[dict[str, int]] = [dict(tally)] + [{} for _ in range(MAX_N)]
                for w, k in tally.items():
                    for n in range(1, MAX_N + 1):
                        part = parts[n]
                        for g in ngrams(w, n):
                            part[g] = part.get(g, 0) + k
                for n, part in enumerate(parts):
                    yield from ((lang, n, key, c) for key, c in part.items())

        return count

    tally = map_rows(rows.where(pick).select("lang", "text"), make, "lang string, n int, key string, c long")
    summed = tally.groupBy("lang", "n", "key").agg(F.sum("c").alias("c")).where(F.col("c") >= min_count)
    return fit([tuple(r) for r in summed.collect()])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (posterior probability of the language)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value
        of = Rows(m.chunks, 300_000)

        def rows(ids, texts):
            for doc_id, text in zip(ids, texts):
                at = of.index((text or "").split())
                total = of.matrix[at].sum(0) if len(at) else np.zeros(1)
                if not total[-1] or not m.langs:
                    yield doc_id, NONE, 0.0
                    continue
                best = int(total[:-1].argmax())
                yield doc_id, m.langs[best], float(1 / np.exp(total[:-1] - total[best]).sum())

        return rows

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {id_type}, lang_pred string, score double")
