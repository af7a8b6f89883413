"""Best-fit packing by bin completion.

Documents become token-id pieces of at most ``cap`` ids. The multiset of piece
lengths is a histogram of at most ``cap`` counts whatever the corpus holds; the
driver solves that histogram and the pieces are dealt to sequences by their rank
among pieces of equal length. The plan (a few thousand patterns) is the only
thing that is broadcast.

Cases: null or empty text is a piece with the end id alone; null, repeated and
missing doc_ids are kept as separate rows; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterable, Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Memo, by_split, fresh_dir, groups, map_rows, materialize, read_part, spark_arrow_schema, store

CAP, END_ID, OPEN = 4096, 1, 50
#: Words and chunks that a worker knows at most, but for those of a million characters.
WORDS, CHUNKS, PARTS = 60_000, 90_000, 350_000
#: Anything but ASCII, Latin letters that are one letter each when lower-cased, and the usual white space; or a special token.
_OTHER = re.compile("[^\t-\r -~À-ÖØ-öø-ÿĀ-įıĲ-ňŊ-ž]|<\\|")
#: Of ASCII texts.
_ODD = re.compile("[\0-\x08\x0e-\x1f\x7f]|<\\|")
#: The tokenizer's own parts of such a text.
_PART = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿā-ž]+|[0-9]|[^\\sa-z0-9ß-öø-ÿā-ž]+")
#: ASCII marks that are never in a token with letters before them; an apostrophe can be.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ODD_SPACE = re.compile("[\x1c-\x1f]")


class WordIds:
    """Token ids of a text, put together from the ids of its chunks.

    The tokenizer drops white space and no token spans it, so the ids of a text
    are those of its white-space-delimited chunks in turn; letters, apart from the
    marks after them, go straight to the BPE model. Texts of ASCII and Latin letters
    alone are lower-cased and taken apart at once, as the tokenizer does it. Other
    texts with the separators that ``str.split`` and the tokenizer see differently
    go through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.bytes_as = {**{b: b for b in plain}, **{b: 256 + k for k, b in enumerate(rest)}}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.parts = Memo(self._part, PARTS)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isalpha():
            return self._whole(word)
        if word.isascii():
            return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        low = "".join(map(str.lower, unicodedata.normalize("NFC", word)))  # letter by letter: a last sigma is like the others
        if not low.isalpha():  # lower-casing can make a combining mark
            return self._whole(word)
        spelled = low.encode().decode("latin-1").translate(self.bytes_as)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """Makes all of them known: letters with marks after them as two words, any other chunk as one."""
        new = [c for c in chunks if c not in self.chunks]
        if len(self.chunks) + len(new) > CHUNKS:
            self.chunks.clear()
            new = list(chunks)
        bare = [c.rstrip(_MARKS) for c in new]
        bare = [w if w.isalpha() and (w.isascii() or "".join(map(str.lower, w)).isalpha()) else c for w, c in zip(bare, new)]
        marks = [c[len(w) :] for w, c in zip(bare, new)]
        bare = [w.lower() if w.isascii() and w.isalpha() else w for w in bare]
        every = {*bare, *marks} - {""}
        need = [w for w in every if w not in self.words]
        if len(self.words) + len(need) > WORDS:
            self.words.clear()
            need = list(every)
        self.words.update(zip(need, map(self._word, need)))
        self.words[""] = b""
        get = self.words.__getitem__
        self.chunks.update(zip(new, map(add, map(get, bare), map(get, marks))))

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of some texts; their new chunks are looked at together."""
        latin = [t.isascii() and not _ODD.search(t) or not _OTHER.search(t) for t in texts]
        split = [[] if plain or _ODD_SPACE.search(t) else t.split() for plain, t in zip(latin, texts)]
        self._learn(set().union(*split))
        of_chunk, of_part = self.chunks.__getitem__, self.parts.__getitem__
        made = []
        for plain, t, chunks in zip(latin, texts, split):
            if plain:
                made.append(b"".join(map(of_part, _PART.findall(t.lower()))))
            else:
                made.append(b"".join(map(of_chunk, chunks)) if chunks else self._whole(t))
        return made

    def _part(self, part: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.bytes_as))]).tobytes()

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


_known: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for all tasks of a worker, which know the words of those before them."""
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path]


def pieces(docs: DataFrame, tokenizer: str, cap: int = CAP, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids as little-endian bytes)."""
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * cap

    def make():
        ids_of = word_ids(tokenizer)

        def rows(doc_ids, texts):
            texts = [t or "" for t in texts]
            made = (x for lo, hi in groups(texts) for x in ids_of.many(texts[lo:hi]))
            for doc_id, ids in zip(doc_ids, made):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    yield (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if keep_ids else []))

        return rows

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return map_rows(docs.select("doc_id", "text"), make, schema)


# --- the solver -----------------------------------------------------------------


def lower_bound(hist: dict[int, int], cap: int) -> int:
    """Martello and Toth's L2: items over half a bin can't meet; small ones fill what is left."""
    if not hist:
        return 0
    size = np.array(sorted(hist), np.int64)
    count = np.array([hist[s] for s in size.tolist()], np.int64)
    mass = np.concatenate([[0], np.cumsum(size * count)])
    number = np.concatenate([[0], np.cumsum(count)])
    half = np.searchsorted(size, cap // 2, "right")
    a = np.concatenate([[0], size[:half]])
    big = np.maximum(np.searchsorted(size, cap - a, "right"), half)
    small = np.searchsorted(size, a, "left")
    room = (number[big] - number[half]) * cap - (mass[big] - mass[half])
    best = number[-1] - number[half] + np.maximum(0, -(-(mass[half] - mass[small] - room) // cap))
    return max(-(-int(mass[-1]) // cap), int(best.max()))


Plan = list[tuple[tuple[int, ...], int]]


def best_fit(hist: dict[int, int], cap: int) -> Plan:
    """Best-fit decreasing: patterns and how often each is used. Equal sequences are filled together."""
    open_: dict[int, list[list]] = {}  # room left: [pattern, how many]
    rooms: list[int] = []  # the keys of open_, rising

    def put(room: int, pattern: tuple, times: int) -> None:
        if times:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append([pattern, times])

    for s in sorted(hist, reverse=True):
        left = hist[s]
        while left:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                each = cap // s
                put(cap - each * s, (s,) * each, left // each)
                put(cap - left % each * s, (s,) * (left % each), min(1, left % each))
                break
            room = rooms[at]
            pattern, times = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            each = room // s
            full = min(times, left // each)
            put(room - each * s, pattern + (s,) * each, full)
            left -= full * each
            if full < times and left:  # fewer than a sequence takes
                put(room - left * s, pattern + (s,) * left, 1)
                full, left = full + 1, 0
            put(room, pattern, times - full)
    return [(pattern, times) for room in rooms for pattern, times in open_[room]]


def dominated(filling: tuple[int, ...], slack: int, spare: list[int]) -> bool:
    """Whether a spare item can take the place of some of the filling's items that fit into it.

    ``spare``: the rising sizes of which an item is left. Sums of items are bits of a number.
    """
    inside, at, sums = filling[::-1], 0, 1
    window = (1 << slack + 1) - 1
    for x in spare:
        while at < len(inside) and inside[at] < x:
            sums |= sums << inside[at]
            at += 1
        if (sums >> x - slack if x >= slack else sums << slack - x) & window:
            return True
    return False


def fillings(hist: dict[int, int], room: int) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of ``room``, those that waste least first."""
    sizes = sorted((s for s in hist if hist[s] and s <= room), reverse=True)
    top = (1 << room + 1) - 1
    reach = [1]  # sums that the sizes from there on can make, as bits; the last is of none
    for s in reversed(sizes):
        sums, n, k = reach[-1], min(hist[s], room // s), 1
        while n:
            k = min(k, n)
            sums |= sums << s * k & top
            n, k = n - k, 2 * k
        reach.append(sums)
    reach.reverse()

    def exactly(i: int, total: int, chosen: tuple) -> Iterator[tuple[int, ...]]:
        while i < len(sizes) and total and reach[i] >> total & 1:
            s = sizes[i]
            if s <= total:
                for k in range(min(hist[s], total // s), 0, -1):
                    yield from exactly(i + 1, total - k * s, chosen + (s,) * k)
            i += 1
        if not total:
            yield chosen

    for total in range(room, -1, -1):
        if reach[0] >> total & 1:
            for f in exactly(0, total, ()):
                used = {s: f.count(s) for s in set(f)}
                if not dominated(f, room - total, [s for s in reversed(sizes) if hist[s] > used.get(s, 0)]):
                    yield f


def solve(hist: dict[int, int], cap: int = CAP, nodes: int = 1000) -> Plan:
    """Patterns and how often each is used; together they hold every item once.

    Bin completion, depth first: the largest item left opens a sequence, its
    undominated fillings are the branches, each used as often as the counts allow
    and then once. A branch is cut where the waste so far, or the lower bound of
    what is left, rules out fewer sequences than the incumbent has; best fit gives
    the first incumbent, and completes each node to the next ones. The search
    ends with proof or after ``nodes`` nodes. It keeps ``OPEN`` nodes to go back to,
    the latest ones, so that memory stays bounded.
    """
    hist = {int(s): int(n) for s, n in hist.items() if n > 0}
    count = lambda plan: sum(n for _, n in plan)
    best = best_fit(hist, cap)
    total, goal, most = sum(s * n for s, n in hist.items()), lower_bound(hist, cap), count(best)

    def branches(left: dict[int, int]) -> Iterator[tuple[tuple[int, ...], int]]:
        top = max(left)
        rest = left | {top: left[top] - 1}
        for f in fillings(rest, cap - top):
            items = (top, *f)
            times = min(left[s] // items.count(s) for s in set(items))
            yield items, times
            if times > 1:
                yield items, 1

    stack = deque([(hist, branches(hist), 0, 0, None)] if hist and most > goal else [], OPEN)  # left, branches, sequences, waste, linked path
    while stack and nodes and most > goal:
        left, todo, n, waste, path = stack[-1]
        items, times = next(todo, ((), 0))
        if not times:
            stack.pop()
            continue
        nodes -= 1
        now = dict(left)
        for s in set(items):
            now[s] -= times * items.count(s)
            if not now[s]:
                del now[s]
        n, waste, path = n + times, waste + times * (cap - sum(items)), ((items, times), path)
        if -(-(total + waste) // cap) >= most or n + lower_bound(now, cap) >= most:
            continue
        rest = best_fit(now, cap)
        if n + count(rest) < most:
            best, most, way = rest, n + count(rest), path
            while way:
                best, way = [way[0], *best], way[1]
        stack.append((now, branches(now), n, waste, path))
    return best


def deal(plan: Iterable[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, per sequence, first sequence, offset) sorted by length and rank."""
    used: dict[int, int] = {}
    rows, seq = [], 0
    for items, times in plan:
        offset = 0
        for s in dict.fromkeys(items):
            k = items.count(s)
            rows.append((s, used.get(s, 0), k, seq, offset))
            used[s] = used.get(s, 0) + k * times
            offset += k * s
        seq += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_pieces(parts: DataFrame, cap: int = CAP) -> DataFrame:
    """Add sequence_id and offset to rows that have a ``length``.

    A row's rank among those of its length is that of its split's first one, which
    a table of counts by split and length gives, and its place in the split: the
    rows themselves are not shuffled.
    """
    spark, columns = parts.sparkSession, parts.columns
    rows = by_split(parts, *[F.col(f"`{c}`") for c in columns])

    def stretches(batches):
        for b in batches:
            split = b.column(b.num_columns - 1).to_numpy()
            for lo, hi in _runs(split):
                yield split[lo], b.slice(lo, hi - lo)

    def count(batches):
        for split, own in itertools.groupby(stretches(batches), lambda x: x[0]):
            n = np.zeros(cap + 1, np.int64)
            for _, b in own:
                n += np.bincount(b.column("length").to_numpy(), minlength=cap + 1)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), split)), pa.array(some), pa.array(n[some])], names=["split", "length", "n"])

    counts = materialize(rows.select("length", "_split").mapInArrow(count, "split long, length long, n long"), "lengths")
    hist = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most cap rows
    dealt = spark.sparkContext.broadcast(deal(solve(hist, cap)))
    before = Window.partitionBy("length").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    firsts = fresh_dir(spark, "ranks")
    store(counts.select("split", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), firsts, "split", parts=int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    out = spark_arrow_schema(spark, schema)

    def place(batches):
        table = dealt.value
        keys = (table[:, 0] << 44) | table[:, 1]
        for split, own in itertools.groupby(stretches(batches), lambda x: x[0]):
            said = read_part(firsts, "split", split, ["length", "first"])
            next_ = np.zeros(cap + 1, np.int64)
            next_[said.column("length").to_numpy()] = said.column("first").to_numpy()
            for _, b in own:
                length = b.column("length").to_numpy().astype(np.int64)
                order = np.argsort(length, kind="stable")
                new = np.concatenate([[True], length[order][1:] != length[order][:-1]])
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.maximum.accumulate(np.where(new, np.arange(len(length)), 0))
                rank += next_[length]
                next_ += np.bincount(length, minlength=cap + 1)
                at = table[np.searchsorted(keys, (length << 44) | rank, "right") - 1]
                nth = rank - at[:, 1]
                made = [pa.array(at[:, 3] + nth // at[:, 2]), pa.array(at[:, 4] + nth % at[:, 2] * length)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], schema=out)

    return rows.mapInArrow(place, schema)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    cut = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return ((a, b) for a, b in zip(cut, cut[1:]) if b > a)


def pack(docs: DataFrame, tokenizer: str, cap: int = CAP, end_id: int = END_ID) -> DataFrame:
    """Each piece of each document with its sequence and its place there."""
    return pack_pieces(pieces(docs, tokenizer, cap, end_id), cap)
