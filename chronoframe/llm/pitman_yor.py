"""Language-model scores from a hierarchical Pitman-Yor model.

Each word that comes before another is a context with a restaurant of its own
(the start of a text is one, too). All of them share a parent, the word
restaurant; its base measure spells words byte by byte with a hierarchy of
restaurants, one for each context of up to ``ORDER`` bytes, where a context's
parent is the context without its first byte. An unseen word is thus scored by
its spelling, a word after an unseen context by the word restaurant.

Seating is sampled by Gibbs sweeps: given the tables of the others and the
parent's predictive probabilities, each dish's customers are seated anew one after
another by the Chinese-restaurant rule (``restaurants.seat``). A dish's tables are
its customers in the parent. Predictive probabilities are averaged over the sweeps
after burn-in (of a product of averages, each factor by itself). Restaurants in
one task are swept together; between tasks tables and probabilities go to and fro
twice. The discounts follow from the numbers of dishes with one and two customers.

Scale: nothing is sampled, capped or held on the driver, but for the ``hot``
contexts, of which there are a few thousand at most, the 65536 byte pairs and some
sums. Documents are taken in stretches of about ``SUB_BYTES``; the distinct words
and word pairs of a stretch go to buckets by the context's hash, packed, those of
hot contexts by the pair's hash, so no bucket grows with one word. Buckets work on
files of the shared folder, by number; their answers are in the order of what was
asked, so no keys go back. A stretch is read again to be scored, and its answers
have to fit it in number. Spelling restaurants are dealt out by the last two bytes
of their contexts. A task holds one bucket (about ``BUCKET_TOKENS`` tokens' pairs)
or one stretch.

Cases: null text is empty and scores its end token; tokens are split at ASCII
white space only and may have any length; null doc_ids count as the empty string
in the fold; repeated rows are separate documents; no training rows leave all
words unseen; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import brief_shuffles, by_split, exchange, fold, fresh_dir, give_back, materialize, read_part, release, spark_arrow_schema
from .restaurants import STRENGTH, SYMBOLS, Spelling, discount_of, predictive, seat, word_grams
from .tokens import SPACED, distinct, distinct_near, in_order, mix, scan

ORDER, SWEEPS, BURN = 6, 8, 3
SUB_BYTES, BUCKET_TOKENS = 8 << 20, 1_500_000
#: Bytes whose hashes are computed together in a core's cache.
SEGMENT = 1 << 16
BOS, END = np.uint64(0xB05), np.uint64(0x5EED << 20)
_PAIR = np.uint64(0xD1B54A32D192ED03)
#: Successors are known by these bits of their hash.
KEY = np.uint64(~0xFFFF & (1 << 64) - 1)


def pack(a: np.ndarray, rising: bool = False) -> bytes:
    """Bytes of one significance together, so that small numbers compress; of rising numbers the differences."""
    a = np.diff(a, prepend=a.dtype.type(0)) if rising else np.ascontiguousarray(a)
    out = np.empty((a.itemsize, len(a)), np.uint8)
    out[:] = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return out.tobytes()


def unpack(data: bytes, kind, rising: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(size, -1)
    a = np.empty(planes.shape[1], kind)
    each = a.view(np.uint8).reshape(-1, size)
    for k in range(size):
        each[:, k] = planes[k]
    return np.cumsum(a, dtype=kind) if rising else a


def joined(data: bytes, first: np.ndarray, last: np.ndarray, block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``data`` from each first to its last one after another, and their ends; some at a time, for memory."""
    buf, size = np.frombuffer(data, np.uint8), last - first
    ends = np.cumsum(size)
    out, lo = np.empty(int(size.sum()), np.uint8), 0
    while lo < len(size):
        begin = ends[lo] - size[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, begin + block, "right")))
        k = slice(lo, hi)
        if hi == lo + 1:
            out[begin : ends[lo]] = buf[first[lo] : last[lo]]
        else:
            out[begin : ends[hi - 1]] = buf.take(np.arange(begin, ends[hi - 1]) + np.repeat(last[k] - ends[k], size[k]))
        lo = hi
    return out, ends


def stretches(batches, most: int):
    """(split, number in it, rows (doc_id, held_out, lower-cased bytes)) from columns doc_id, held_out, text, _split."""
    rows, size, where, sub = [], 0, None, 0
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            ids, helds, texts, blocks = b.slice(lo, 256).columns
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
            for doc_id, held, text, block in zip(*(c.to_pylist() for c in (ids, helds, texts, blocks))):
                if block != where:
                    if rows:
                        yield where, sub, rows
                    rows, size, where, sub = [], 0, block, 0
                rows.append((doc_id, held, (text or b"").lower()))
                size += len(rows[-1][2])
                if size >= most:
                    yield where, sub, rows
                    rows, size, sub = [], 0, sub + 1
    if rows:
        yield where, sub, rows


class Stretch:
    """Tokens of some texts; their distinct words, and their distinct pairs in the order of buckets."""

    def __init__(self, rows: list[tuple]):
        self.data = b" ".join(r[2] for r in rows) + b" "
        h, start, end = scan(self.data, SPACED, SEGMENT)
        n = np.searchsorted(start, np.cumsum([len(r[2]) + 1 for r in rows]))
        tok = np.insert(h, n, END)
        self.start, self.end = np.insert(start, n, 0), np.insert(end, n, 0)
        self.bounds = np.concatenate([[0], n + np.arange(1, len(rows) + 1)])
        self.learns = np.repeat([not r[1] for r in rows], np.diff(self.bounds))
        del h, start, end
        order, tok = in_order(tok)
        new = np.concatenate([[True], tok[1:] != tok[:-1]])
        self.words, self.first, self.ids = tok[new], order[new], np.empty(len(tok), np.int32)
        self.ids[order] = np.cumsum(new) - 1

    def pair_up(self, shift: np.uint64, hot: np.ndarray) -> Stretch:
        w = len(self.words)
        before = np.empty(len(self.ids), np.int64)
        before[1:] = self.ids[:-1]
        before[self.bounds[:-1]] = w
        bits = w.bit_length()
        before <<= bits
        before |= self.ids
        at, pairs = in_order(before)
        new = np.ones(len(at), bool)
        new[1:] = pairs[1:] != pairs[:-1]
        pair, pairs = np.cumsum(new) - 1, pairs[new]
        context, succ = pairs >> bits, pairs & ((1 << bits) - 1)
        every = np.append(self.words, BOS)
        hashes, often = every[context], np.isin(every, hot)[context]
        other = often | (every == BOS)[context]
        next_ = self.words & KEY
        bucket = hashes.copy()
        bucket[often] = mix(hashes[often] ^ mix(next_[succ[often]]))
        bucket >>= shift
        by = (bucket << np.uint64(1)) | other
        order = np.argsort(by.astype(np.uint16) if int(shift) >= 64 - 15 else by, kind="stable")  # numbers of 16 bits are sorted by digits
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.pair = before
        self.pair[at] = rank[pair]
        self.bucket, self.context, self.succ, self.other = bucket[order], hashes[order], next_[succ[order]], other[order]
        self.new = np.ones(len(order), bool)  # where a context begins
        self.new[1:] = (self.context[1:] != self.context[:-1]) | (self.bucket[1:] != self.bucket[:-1])
        return self

    def messages(self, shift: np.uint64):
        """(bucket, words, their bytes, counts, successors of each, other contexts, successors of each, successors, counts); counts in texts that learn."""
        raw = np.bincount(self.ids[self.learns], minlength=len(self.words)).astype(np.uint32)
        c = np.bincount(self.pair[self.learns], minlength=len(self.succ)).astype(np.uint32)
        at = np.flatnonzero(self.new)
        size = np.diff(np.append(at, len(self.new))).astype(np.uint32)
        owner = self.words >> shift
        shrink = zstandard.ZstdCompressor(level=1).compress
        last = self.end[self.first] + 1  # with a space after each
        text, ends = joined(self.data, self.start[self.first], last)
        text[ends - 1] = 32
        ends = np.concatenate([[0], ends])
        for b in np.union1d(owner, self.bucket):
            w = slice(*(np.searchsorted(owner, b, side) for side in ("left", "right")))
            p = slice(*(np.searchsorted(self.bucket, b, side) for side in ("left", "right")))
            g = slice(*np.searchsorted(at, [p.start, p.stop]))
            words, context, sizes = self.words[w], self.context[at[g]], size[g]
            n = len(context) - int(self.other[at[g]].sum())  # the usual ones, which are words of the bucket, come first
            usual = np.zeros(len(words), np.uint32)
            usual[np.searchsorted(words, context[:n])] = sizes[:n]
            yield int(b), pack(words, True), shrink(text[ends[w.start] : max(ends[w.start], ends[w.stop] - 1)].tobytes()), pack(raw[w]), pack(usual), pack(context[n:]), pack(sizes[n:]), pack(self.succ[p]), pack(c[p])


MESSAGE = "bucket long, block long, sub int, words binary, text binary, raw binary, usual binary, context binary, size binary, succ binary, c binary"
#: What buckets tell one another: by kind, to a bucket, from another.
TOLD = "kind int, bucket long, src long, n0 long, n1 long, n2 long, n3 long, x double, a binary, b binary, c binary"
SEEN, GRAMS, SPELT, PARENT, KEPT, EXTRA, PAIRS, WORDS, HOT, SUMS, MORE_SUMS = range(11)


def told(kind, bucket, src, n0=0, n1=0, n2=0, n3=0, x=0.0, a=b"", b=b"", c=b""):
    return kind, int(bucket), src, int(n0), int(n1), int(n2), int(n3), float(x), a, b, c


class Bucket:
    """What all stretches sent to one bucket: distinct words with counts, distinct pairs with counts."""

    def __init__(self, folder: str, number: int, words: bool = True, pairs: bool = True, text: bool = True):
        names = [f.split()[0] for f in MESSAGE.split(", ")][1:]
        t = read_part(folder, "bucket", number, names)
        rows = sorted(zip(*(t.column(n).to_pylist() for n in names))) if t else []
        self.asked = [(r[0], r[1]) for r in rows]
        if words:
            each = [unpack(r[2], np.uint64, True) for r in rows]
            self.word_bounds = np.cumsum([0, *map(len, each)])
            self.words, first, self.word = distinct(np.concatenate(each) if each else np.empty(0, np.uint64))
            self.raw = np.bincount(self.word, np.concatenate([unpack(r[4], np.uint32) for r in rows]) if rows else None, len(self.words))
        if words and text:
            flat = list(itertools.chain.from_iterable(zstandard.decompress(r[3]).split(b" ") for r, e in zip(rows, each) if len(e)))
            self.text = [flat[i] for i in first.tolist()]
        if pairs:
            context = [np.repeat(np.concatenate([unpack(r[2], np.uint64, True), unpack(r[6], np.uint64)]), np.concatenate([unpack(r[5], np.uint32), unpack(r[7], np.uint32)])) for r in rows]
            self.pair_bounds = np.cumsum([0, *map(len, context)])
            context, succ, c = (np.concatenate(x) if rows else np.empty(0, k) for x, k in ((context, np.uint64), ([unpack(r[8], np.uint64) for r in rows], np.uint64), ([unpack(r[9], np.uint32) for r in rows], np.uint32)))
            with np.errstate(over="ignore"):
                _, first, self.pair = distinct(mix(context * _PAIR + succ))
            self.c = np.bincount(self.pair, c, len(first))
            self.succ = succ[first]
            self.contexts, _, self.context = distinct(context[first])
            del succ, c, context
            self.size = np.bincount(self.context, self.c, len(self.contexts))
            # the distinct successors, how many contexts each has, and whether it occurs twice or more after one
            seen = self.c > 0
            self.next, _, of = distinct(self.succ[seen])
            self.of = np.zeros(len(self.c), np.int64)  # of those pairs only
            self.of[seen] = of
            self.n_contexts = np.bincount(of, minlength=len(self.next))
            self.needed = np.bincount(of, self.c[seen] > 1, len(self.next)) > 0


def gram_groups(words: list[bytes], learned: np.ndarray, groups: int):
    """Distinct grams of the words, how many learned words' places each has, their order by group, the groups' bounds, and the gram of each place."""
    found, counts, places = [np.empty(0, np.uint64)], [np.empty(0)], [np.empty(0, np.int32)]
    total = 0
    for g, word in word_grams(words, ORDER):
        _, first, number = distinct(mix(g))
        found.append(g[first])
        counts.append(np.bincount(number, learned[word], len(first)))
        places.append((number + total).astype(np.int32))
        total += len(first)
    grams, _, number = distinct_near(np.concatenate(found))
    n = np.bincount(number, np.concatenate(counts), len(grams))
    group = (mix((grams >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group.astype(np.uint16) if groups <= 1 << 16 else group, kind="stable")
    return grams, n, order, np.searchsorted(group[order], np.arange(groups + 1)), number.astype(np.int32)[np.concatenate(places)]


def spread(values: np.ndarray, shift: np.uint64):
    """(bucket, slice) of sorted hashes."""
    owner = values >> shift
    for b in np.unique(owner):
        yield int(b), slice(*(np.searchsorted(owner, b, side) for side in ("left", "right")))


class Job:
    """Runs a function of the bucket number in a task for each bucket, and keeps what the buckets tell."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.shift = spark, buckets, np.uint64(64 - (buckets.bit_length() - 1))
        self.schema = spark_arrow_schema(spark, TOLD)

    def run(self, f, tag: str) -> str:
        folder, out = fresh_dir(self.spark, tag), self.schema

        def task(batches):
            for b in batches:
                for number in b.column(0).to_pylist():
                    rows = f(number)
                    while chunk := list(itertools.islice(rows, 32)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*chunk), out)], schema=out)
            rows = chunk = None
            give_back()

        exchange(self.spark.range(0, self.buckets, 1, self.buckets).mapInArrow(task, TOLD), folder, "kind", "bucket", parts=self.buckets)
        return folder

    def sums(self, folder: str) -> dict:
        """Sums by kind and bucket of the few rows that are for the driver: at most two kinds, and the hot contexts."""
        rows = self.spark.read.schema(TOLD).parquet(folder).where(F.col("kind") >= HOT).groupBy("kind", "bucket").agg(*[F.sum(c) for c in ("n0", "n1", "n2", "n3", "x")]).collect()
        return {(r[0], r[1]): r[2:] for r in rows}


def heard(folder: str, kind: int, bucket: int, names=("src", "n0", "a", "b", "c")) -> list[tuple]:
    """In a task: what was told to a bucket, by source."""
    t = read_part(f"{folder}/kind={kind}", "bucket", bucket, list(names))
    return sorted(zip(*(t.column(n).to_pylist() for n in names))) if t else []


def mean_tables(customers, base, rest, discount: float, rng) -> np.ndarray:
    """Tables of dishes whose other tables are given, averaged over the sweeps that count."""
    return np.mean([seat(customers, base, rest, discount, rng) for _ in range(SWEEPS - BURN)], 0)


def score(docs: DataFrame, sub_bytes: int = SUB_BYTES, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    placed = by_split(docs, "doc_id", fold("doc_id", 10, 0).alias("held_out"), "text")

    def frequent(batches):
        """(hash, count) of words and text starts with a 4096th of a stretch, and of all as a null hash."""
        for _, _, rows in stretches(batches, sub_bytes):
            words, n = np.unique(scan(b" ".join(r[2] for r in rows), SPACED, SEGMENT)[0], return_counts=True)
            total = int(n.sum()) + len(rows)
            some = np.flatnonzero(n * 4096 >= total)
            h = [*words[some].view(np.int64).tolist(), int(BOS), int(END), None]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array([*n[some].tolist(), len(rows), len(rows), total], pa.int64())], names=["h", "n"])

    often = materialize(placed.mapInArrow(frequent, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "lm-often")
    tokens = often.where("h IS NULL").first()
    tokens = tokens["n"] if tokens else 0
    buckets = 1 << max(2, min(20, (max(1, tokens) // bucket_tokens).bit_length()))
    hot = np.sort(np.array([r[0] for r in often.where(F.col("h").isNotNull() & (F.col("n") * 2 * buckets >= tokens)).collect()], np.int64).view(np.uint64))  # at most 2 * buckets, and 4096 a stretch
    job = Job(spark, buckets)
    shift, sent_hot = job.shift, spark.sparkContext.broadcast(hot)
    message = spark_arrow_schema(spark, MESSAGE)
    asks = fresh_dir(spark, "lm-asks")

    def ask(batches):
        for block, sub, rows in stretches(batches, sub_bytes):
            it = ((m[0], block, sub, *m[1:]) for m in Stretch(rows).pair_up(shift, sent_hot.value).messages(shift))
            while chunk := list(itertools.islice(it, 32)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*chunk), message)], schema=message)
            it = chunk = rows = None
        give_back()

    exchange(placed.mapInArrow(ask, MESSAGE), asks, "bucket", parts=buckets)

    def first(number):
        """To the words' owners: their contexts here. To the spelling groups: grams. To the driver: sums."""
        s = Bucket(asks, number)
        for b, at in spread(s.next, shift):
            yield told(SEEN, b, number, a=pack(s.next[at], True), b=pack(s.n_contexts[at].astype(np.uint32)), c=pack(s.needed[at].astype(np.uint8)))
        grams, n, order, bounds, _ = gram_groups(s.text, s.raw > 0, buckets)
        for g in range(buckets):
            at = order[bounds[g] : bounds[g + 1]]
            if len(at):
                yield told(GRAMS, g, number, a=pack(grams[at], True), b=pack(n[at].astype(np.uint32)))
        seen = s.c > 0
        for k in np.flatnonzero(np.isin(s.contexts, sent_hot.value)).tolist():
            own = s.context == k
            yield told(HOT, np.searchsorted(sent_hot.value, s.contexts[k]), number, s.c[own].sum(), (own & seen).sum())
        yield told(SUMS, 0, number, s.raw.sum(), (s.raw > 0).sum(), (s.raw == 1).sum(), (s.raw == 2).sum())
        yield told(MORE_SUMS, 0, number, seen.sum(), (s.c == 1).sum(), (s.c == 2).sum())

    one = job.run(first, "lm-first")
    sums = job.sums(one)
    n_all, n_types, ones, twos = (int(x) for x in sums[SUMS, 0][:4])
    n_pairs = int(sums[MORE_SUMS, 0][0])
    d_word, d_pair = discount_of(ones, twos), discount_of(*(float(x) for x in sums[MORE_SUMS, 0][1:3]))
    hot_size, hot_seen = (np.array([float(sums[HOT, k][i]) if (HOT, k) in sums else 0.0 for k in range(len(hot))]) for i in (0, 1))

    def group_grams(number):
        told_here = [(src, unpack(a, np.uint64, True), unpack(b, np.uint32)) for src, _, a, b, _ in heard(one, GRAMS, number)]
        if not told_here:
            return [], np.empty(0, np.uint64), np.empty(0), np.empty(0, np.int64)
        grams, _, inverse = distinct_near(np.concatenate([x[1] for x in told_here]))
        return told_here, grams, np.bincount(inverse, np.concatenate([x[2] for x in told_here]), len(grams)), inverse

    def pairs_of_bytes(batches):
        for b in batches:
            for number in b.column(0).to_pylist():
                _, grams, n, _ = group_grams(number)
                low, c = np.unique(np.unique(grams[n > 0] & np.uint64(0xFFFFFF)) & np.uint64(0xFFFF), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(low.astype(np.int64)), pa.array(c.astype(np.int64))], names=["gram", "n"])

    with brief_shuffles(spark):  # at most 65536 rows
        low = sorted(tuple(r) for r in spark.range(0, buckets, 1, buckets).mapInArrow(pairs_of_bytes, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect())
    short = Spelling(np.array([r[0] for r in low], np.uint64), np.array([r[1] for r in low], np.float64), 0, 1, lambda g: np.full(len(g), 1 / SYMBOLS), SWEEPS, BURN, 11)
    sent_short = spark.sparkContext.broadcast(short.symbol(np.arange(1 << 16, dtype=np.uint64)))

    def spell(number):
        said, grams, n, inverse = group_grams(number)
        dense = sent_short.value
        model = Spelling(grams[n > 0], n[n > 0], 2, ORDER, lambda g: dense[(g & np.uint64(0xFFFF)).astype(np.int64)], SWEEPS, BURN, number)
        chance = model.symbol(grams).astype(np.float32)
        lo = 0
        for src, g, _ in said:
            yield told(SPELT, src, number, a=pack(chance[inverse[lo : lo + len(g)]]))
            lo += len(g)

    spelt = job.run(spell, "lm-spelt")

    def parents(number):
        """Spelling and customers of each word are kept; the words' probabilities go to the buckets that need them."""
        s = Bucket(asks, number, pairs=False)
        grams, _, order, bounds, places = gram_groups(s.text, s.raw > 0, buckets)
        chance = np.ones(len(grams))
        for g, _, a, _, _ in heard(spelt, SPELT, number):
            chance[order[bounds[g] : bounds[g + 1]]] = unpack(a, np.float32)
        log = np.bincount(np.repeat(np.arange(len(s.text)), np.fromiter(map(len, s.text), np.int64, len(s.text)) + 1), np.log10(chance)[places], len(s.words))
        customers = np.zeros(len(s.words))
        said = [(src, np.searchsorted(s.words & KEY, unpack(a, np.uint64, True)), unpack(b, np.uint32), unpack(c, np.uint8)) for src, _, a, b, c in heard(one, SEEN, number)]
        for _, at, n, _ in said:
            customers[at] += n
        base = np.power(10.0, log)
        t = mean_tables(customers, base, n_types - np.minimum(customers, 1), d_word, np.random.default_rng([1, number]))
        p = predictive(customers, t, n_pairs, n_types, d_word, base)
        for src, at, _, need in said:
            yield told(PARENT, src, number, a=pack(p[at[need > 0]]))
        yield told(KEPT, number, number, a=pack(log), b=pack(customers))
        yield told(SUMS, 0, number, x=t.sum())

    two = job.run(parents, "lm-parents")
    for folder in (one, spelt):
        release(spark, folder)
    all_word_tables = float(job.sums(two)[SUMS, 0][4] or 0)

    def contexts(number):
        """Seats the context restaurants. To the words' owners: tables beyond one a dish. To the stretches: their pairs."""
        s = Bucket(asks, number, words=False)
        p = np.zeros(len(s.next))
        place = dict(spread(s.next, shift))
        for src, _, a, _, _ in heard(two, PARENT, number):
            at = place[src]
            p[np.arange(at.start, at.stop)[s.needed[at]]] = unpack(a, np.float64)
        many = np.flatnonzero(s.c > 1)
        base, context = p[s.of[many]], s.context[many]
        t, mean = np.minimum(s.c, 1.0), np.zeros(len(many))
        filled = np.bincount(s.context, t, len(s.contexts))
        is_hot = np.isin(s.contexts, sent_hot.value)
        which = np.searchsorted(sent_hot.value, s.contexts[is_hot])
        beyond = np.zeros(len(s.contexts))  # tables of a hot context in other buckets
        beyond[is_hot] = hot_seen[which] - filled[is_hot]
        single = filled - np.bincount(context, minlength=len(filled))
        rng = np.random.default_rng([2, number])
        for sweep in range(SWEEPS):
            t[many] = seat(s.c[many], base, (filled + beyond)[context] - t[many], d_pair, rng)
            filled = single + np.bincount(context, t[many], len(filled))
            mean += t[many] * (sweep >= BURN) / (SWEEPS - BURN)
        t[many] = mean
        filled = np.bincount(s.context, t, len(s.contexts))
        more = many[mean > 1]
        some = np.bincount(s.of[more], minlength=len(s.next)) > 0
        word, extra = s.next[some], np.bincount(s.of[more], t[more] - 1, len(s.next))[some]
        for b, at in spread(word, shift):
            yield told(EXTRA, b, number, a=pack(word[at], True), b=pack(extra[at]))
        size = s.size.copy()
        size[is_hot] = hot_size[which]
        weight = ((STRENGTH + d_pair * filled) / (STRENGTH + size)).astype(np.float32)
        weight[is_hot] = np.nan  # its tables are in several buckets
        rest = np.maximum(s.c - d_pair * t, 0).astype(np.float32)
        for k, (block, sub) in enumerate(s.asked):
            pair = s.pair[s.pair_bounds[k] : s.pair_bounds[k + 1]]
            context = s.context[pair]
            context = context[np.concatenate([[True], context[1:] != context[:-1]])] if len(context) else context
            yield told(PAIRS, block, number, sub, a=pack(rest[pair]), b=pack(size[context]), c=pack(weight[context]))
        for k, x in zip(which.tolist(), filled[is_hot].tolist()):
            yield told(HOT, k, number, x=x)
        yield told(SUMS, 0, number, x=t.sum())

    three = job.run(contexts, "lm-contexts")
    sums = job.sums(three)
    customers_all = float(sums[SUMS, 0][4] or 0)
    hot_weight = np.array([(STRENGTH + d_pair * float(sums[HOT, k][4] if (HOT, k) in sums else 0)) / (STRENGTH + hot_size[k]) for k in range(len(hot))])

    def owners(number):
        """Seats the word restaurant's dishes again, and tells the stretches of their words."""
        s = Bucket(asks, number, pairs=False, text=False)
        kept = heard(two, KEPT, number)
        log, customers = (unpack(kept[0][2 + k], np.float64).copy() for k in (0, 1)) if kept else (np.empty(0), np.empty(0))
        for _, _, a, b, _ in heard(three, EXTRA, number):
            customers[np.searchsorted(s.words & KEY, unpack(a, np.uint64, True))] += unpack(b, np.float64)
        t = mean_tables(np.round(customers), np.power(10.0, log), all_word_tables - np.minimum(customers, 1), d_word, np.random.default_rng([3, number]))
        own = np.maximum(customers - d_word * t, 0) / (STRENGTH + customers_all)
        with np.errstate(divide="ignore"):  # in logs: a spelling can be below the smallest double
            down = log * np.log(10) + np.log((STRENGTH + d_word * all_word_tables) / (STRENGTH + customers_all))
            p = (np.logaddexp(np.log(own), down) / np.log(10)).astype(np.float32)
        for k, (block, sub) in enumerate(s.asked):
            word = s.word[s.word_bounds[k] : s.word_bounds[k + 1]]
            yield told(WORDS, block, number, sub, a=pack(s.raw[word]), b=pack(p[word]))

    four = job.run(owners, "lm-owners")
    for folder in (asks, two):
        release(spark, folder)
    norm = float(np.log10(n_all + 0.1 * (n_types + 1)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = spark_arrow_schema(spark, schema)

    def run(batches):
        where, pairs, words = None, {}, {}
        for block, sub, rows in stretches(batches, sub_bytes):
            if block != where:
                where, pairs, words = block, {}, {}
                for found, folder, k in ((pairs, three, PAIRS), (words, four, WORDS)):
                    for r in heard(folder, k, block):
                        found.setdefault(r[1], []).append(r[2:])
            s = Stretch(rows).pair_up(shift, sent_hot.value)
            of = np.cumsum(s.new) - 1  # the context of each pair
            asked, said = pairs.pop(sub, []), words.pop(sub, [])
            rest, size, weight = (np.concatenate([unpack(r[k], t) for r in asked] or [np.empty(0)]) for k, t in ((0, np.float32), (1, np.float64), (2, np.float32)))
            raw, log = (np.concatenate([unpack(r[k], t) for r in said] or [np.empty(0)]) for k, t in ((0, np.float64), (1, np.float32)))
            if len(rest) != len(s.succ) or len(size) != s.new.sum() or len(raw) != len(s.words):
                raise RuntimeError("a split of the documents was not the same when it was read again")
            weight = weight.astype(np.float64)
            some = np.flatnonzero(np.isnan(weight))
            weight[some] = hot_weight[np.searchsorted(sent_hot.value, s.context[s.new][some])]
            at = of[s.pair]
            with np.errstate(divide="ignore"):
                own = np.log(rest[s.pair] / (STRENGTH + size[at]))
                p = np.logaddexp(own, np.log(weight[at]) + log[s.ids] * np.log(10)) / np.log(10)
            c = raw[s.ids]
            begin = s.bounds[:-1]
            known, base, mine = (np.add.reduceat(x, begin) for x in ((c > 0).astype(np.int64), np.log10(c + 0.1) - norm, p))
            columns = [[r[0] for r in rows], [r[1] for r in rows], np.diff(s.bounds), known, np.full(len(rows), n_all), base, mine]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, out)], schema=out)
        pairs = words = s = rows = of = asked = said = rest = size = weight = raw = log = at = own = p = c = known = base = mine = columns = None
        give_back()

    return placed.mapInArrow(run, schema)
