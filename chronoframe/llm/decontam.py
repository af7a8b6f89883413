"""Benchmark decontamination by spaced seeds.

A seed looks at fixed positions of a run of tokens and ignores the others, so it
still hits where an ignored token was substituted. Every mask is hashed at every
position of the benchmark items and of the documents; equal hashes are joined,
and around each hit the two token sequences are compared along their diagonal.
Of all stretches with the share of equal tokens the one with most of them counts
as contamination if they are enough; what is around it does not matter.

Scale: benchmark hashes and hits are tables and meet in a shuffled join. Before it
document hashes go through a bit for each of 2 ** ``BITS`` groups of hashes, the
only thing that is broadcast (half a megabyte, whatever the benchmark's size);
most positions end there. Documents are not shuffled: what a split's documents are
suspected of is written by split, and each split is read again to be compared.

A token is a run of letters and digits, whatever its case (``tokens``).

Cases: null and empty texts never match; items with fewer than ``MIN_ITEM``
tokens can't be told from chance and are skipped; an item shorter than a mask's
span is matched by the masks that fit; repeated items give a row each; repeated
doc_ids are separate documents; an empty benchmark matches nothing; extra
columns pass through ``clean`` untouched, whatever their names.
"""

from __future__ import annotations

import itertools
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import by_split, fresh_dir, map_rows, materialize, read_part, spark_arrow_schema, store
from .tokens import token_hashes

#: 1: the token counts, 0: it is ignored. Six tokens each, spans of 8 to 13.
MASKS = ("11101011", "1101100101", "11001010011", "1010010011011", "111111")
MIN_ITEM, BITS = 6, 22
_MULT = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) for k in range(64)], np.uint64)


def tokens(text: str | None) -> np.ndarray:
    return token_hashes([text])[0]


def seeds(tok: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each position at which the mask fits."""
    n = len(tok) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, len(mask), np.uint64)
    with np.errstate(over="ignore"):
        for k, c in enumerate(mask):
            if c == "1":
                h += tok[k : k + n] * _MULT[k]
    return h


def stretch(same: np.ndarray, share: float) -> tuple[int, int, int]:
    """The stretch of a diagonal with the most equal tokens of all whose share of them is enough. (from, to, equal)."""
    part = Fraction(share).limit_denominator(10_000)  # whole numbers: a share just met is met
    gain = np.where(same, part.denominator - part.numerator, -part.numerator)
    total, equal = (np.concatenate([[0], np.cumsum(x)]) for x in (gain, same.astype(np.int64)))
    begin = np.searchsorted(-np.minimum.accumulate(total), -total)  # for each end the first start that is not above it
    end = int(np.argmax(equal - equal[begin]))
    begin = int(begin[end])
    inside = np.flatnonzero(same[begin:end])
    return (begin + int(inside[0]), begin + int(inside[-1]) + 1, len(inside)) if len(inside) else (0, 0, 0)


def items(bench: DataFrame, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """number, item_id, tokens, and the item's hashes and their places."""

    def make():
        def rows(ids, texts):
            for item_id, text in zip(ids, texts):
                tok = tokens(text)
                if len(tok) >= MIN_ITEM:
                    h = [seeds(tok, m) for m in masks]
                    yield item_id, tok.tobytes(), np.concatenate(h).view(np.int64).tolist(), np.concatenate([np.arange(len(x)) for x in h]).tolist()

        return rows

    kind = bench.schema["item_id"].dataType.simpleString()
    made = map_rows(bench.select("item_id", "text"), make, f"item_id {kind}, tokens binary, seeds array<long>, places array<int>", 64)
    return materialize(made.withColumn("number", F.monotonically_increasing_id()), "items")


def suspects(rows: DataFrame, known: DataFrame, masks: tuple[str, ...] = MASKS) -> str:
    """Folder by split of (nth, number, item_id, tokens, diagonals): what each document of (text, _split) is to be compared with."""
    spark = rows.sparkSession
    seed = known.select("number", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("number", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place"))
    groups = [r[0] for r in seed.select(F.shiftrightunsigned("seed", 64 - BITS)).distinct().collect()]  # at most 2 ** BITS
    bits = np.zeros(1 << BITS, bool)
    bits[groups] = True
    sent = spark.sparkContext.broadcast(np.packbits(bits))

    def hits(batches):
        bits = np.unpackbits(sent.value).astype(bool)
        for split, lo, texts in numbered(batches):
            run, bounds = token_hashes([t for t, *_ in texts])  # a seed across two texts fails on either diagonal
            for mask in masks:
                h = seeds(run, mask)
                at = np.flatnonzero(bits[h >> np.uint64(64 - BITS)])
                doc = np.searchsorted(bounds, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.full(len(at), split)), pa.array(lo + doc), pa.array((at - bounds[doc]).astype(np.int32))], names=["seed", "split", "nth", "pos"])

    found = rows.select("text", "_split").mapInArrow(hits, "seed long, split long, nth long, pos int").join(seed, "seed")
    each = found.select("split", "nth", "number", (F.col("pos") - F.col("place")).alias("diagonal")).distinct()
    one = each.groupBy("split", "nth", "number").agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals"))
    folder = fresh_dir(spark, "suspects")
    store(one.join(known.select("number", "item_id", "tokens"), "number"), folder, "split", parts=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return folder


def numbered(batches):
    """(split, number of the first row in it, rows) from batches whose last column is the split; some rows at a time."""
    where, nth = None, 0
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            for split, own in itertools.groupby(zip(*(c.to_pylist() for c in b.slice(lo, 512).columns)), lambda r: r[-1]):
                rows = list(own)
                if split != where:
                    where, nth = split, 0
                yield split, nth, rows
                nth += len(rows)


def overlap(tok: np.ndarray, item: np.ndarray, diagonals: list[int], min_equal: int, share: float) -> tuple | None:
    """(doc_from, doc_to, item_from, item_to, equal) of the best stretch of the diagonals, if it is enough."""
    need = min(min_equal, max(MIN_ITEM, int(np.ceil(share * len(item)))))
    best = None
    for d in diagonals:
        p0, q0 = max(0, d), max(0, -d)
        n = min(len(tok) - p0, len(item) - q0)
        if n > 0:
            a, b, equal = stretch(tok[p0 : p0 + n] == item[q0 : q0 + n], share)
            if equal >= need and (best is None or equal > best[4]):
                best = p0 + a, p0 + b, q0 + a, q0 + b, equal
    return best


def _compare(docs: DataFrame, bench: DataFrame, columns: list[str], schema: str, emit, min_equal: int, share: float) -> DataFrame:
    """Rows that ``emit`` makes of each document's columns and the (item_id, overlap) found in it."""
    rows = by_split(docs, "text", *[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(columns)])
    folder, out = suspects(rows, items(bench)), spark_arrow_schema(docs.sparkSession, schema)

    def run(batches):
        where, told = None, {}
        for split, lo, some in numbered(batches):
            if split != where:
                where, told = split, {}
                said = read_part(folder, "split", split, ["nth", "number", "item_id", "tokens", "diagonals"])
                for nth, *r in sorted(zip(*(c.to_pylist() for c in said.columns)), key=lambda r: r[:2]) if said else ():
                    told.setdefault(nth, []).append(r)
            made = []
            for nth, (text, *row, _) in enumerate(some, lo):
                hits = []
                if nth in told:
                    tok = tokens(text)
                    pairs = ((r[1], overlap(tok, np.frombuffer(r[2], np.uint64), r[3], min_equal, share)) for r in told[nth])
                    hits = [(i, o) for i, o in pairs if o]
                made += emit(row, hits)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)

    return rows.mapInArrow(run, schema)


def find(docs: DataFrame, bench: DataFrame, min_equal: int = 13, share: float = 0.8) -> DataFrame:
    """A row for each document and benchmark item that overlap: token spans, equal tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {bench.schema['item_id'].dataType.simpleString()}, doc_from int, doc_to int, item_from int, item_to int, equal int"
    return _compare(docs, bench, ["doc_id"], schema, lambda row, hits: [(row[0], i, *o) for i, o in hits], min_equal, share)


def clean(docs: DataFrame, bench: DataFrame, min_equal: int = 13, share: float = 0.8) -> DataFrame:
    """The documents that overlap no benchmark item, with all their columns."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return _compare(docs, bench, docs.columns, schema, lambda row, hits: [] if hits else [tuple(row)], min_equal, share)
