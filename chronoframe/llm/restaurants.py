"""Chinese-restaurant seating for the hierarchical Pitman-Yor model.

``seat`` draws the number of tables that each dish's customers take when they are
seated one after another by the Pitman-Yor rule, given the other tables of the
restaurant and the probability of the dish in the parent restaurant. The draw is
that of the rule at any count, by whichever way is quickest. One by one, for many
dishes at once, while more than ``FEW`` of a block of dishes have customers left,
for ``STEPS`` customers at most. Then as many as there are so far at a time, with
a random number each: a customer opens a table if more than so many have opened
one before, and that is repeated until nothing changes (only earlier customers
count, so one solution is left, that of seating in turn). Where new tables are
rare, the next one who opens a table is drawn: the chance new / (new + a) after a
customers, as a counts up, is that of a coin whose bias is Beta(new, a).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .tokens import distinct_near

STRENGTH, STEPS, FEW, MANY, RARE, SYMBOLS = 1.0, 4096, 128, 1 << 16, 2000, 257
#: Dishes at a time, whose numbers fit a core's cache.
BLOCK = 1 << 14


def seat(customers: np.ndarray, base: np.ndarray, rest: np.ndarray, discount: float, rng: np.random.Generator, strength: float = STRENGTH) -> np.ndarray:
    """Tables of each dish. ``rest``: tables of the other dishes in its restaurant; ``base``: its probability in the parent."""
    customers = np.asarray(customers, np.float64)
    tables = np.minimum(customers, 1.0)
    live = np.flatnonzero(customers > 1)
    live = live[np.argsort((1 << 16) - 1 - np.minimum(customers[live], STEPS).astype(np.uint16), kind="stable")]  # numbers of 16 bits are sorted by digits
    c, own = customers[live], base[live]
    alone = strength + discount * rest[live]
    t, at = np.ones(len(live)), np.ones(len(live))  # at: customers seated so far
    usual = np.flatnonzero((c <= 32) | ~_rarely((alone + discount) * own, 1))
    for lo in range(0, len(usual), BLOCK):
        k = usual[lo : lo + BLOCK]
        t[k], at[k] = _in_turn(c[k], own[k], alone[k], discount, rng)
    left = np.flatnonzero(at < c)
    while len(left):
        new = (alone[left] + discount * t[left]) * own[left]
        rare = _rarely(new, at[left])
        many = left[~rare]
        take = np.cumsum(np.minimum(np.minimum(at[many], MANY), c[many] - at[many]))  # some dishes at a time, for memory and the cores' caches
        parts = np.split(many, np.flatnonzero(np.diff(take // MANY)) + 1) if len(many) else []
        for k, way in (*((x, _by_repetition) for x in parts), (left[rare], _by_waiting)):
            if len(k):
                t[k], at[k] = way(c[k], own[k], alone[k], t[k], at[k], discount, rng)
        left = left[at[left] < c[left]]
    tables[live] = t
    return tables


def _rarely(new: np.ndarray, at) -> np.ndarray:
    """Whether a draw for each new table is less work than one for each customer."""
    return new * np.where(new < 4, 8, RARE) < at


def _in_turn(customers, base, alone, discount, rng):
    """Seats one customer of each dish at a time, while there are many dishes: tables and customers then. Most customers (up to ``STEPS``) come first."""
    step = discount * base
    new = alone * base + step
    less, change, t = new - discount, step - discount, np.ones(len(base))  # less: new - discount * tables
    n = 1
    for m in np.searchsorted(-np.minimum(customers, STEPS), -np.arange(1.0, min(customers[0], STEPS))).tolist():  # dishes with more than n customers
        if m < FEW and n >= 32:
            break
        opens = rng.random(m) * (less[:m] + n) < new[:m]
        t[:m] += opens
        new[:m] += step[:m] * opens
        less[:m] += change[:m] * opens
        n += 1
    return t, np.minimum(customers, n)


def _by_repetition(customers, base, alone, t, at, discount, rng):
    """Seats as many customers more as there are (at most ``MANY``): tables and customers then."""
    take = np.minimum(np.minimum(at, MANY), customers - at).astype(np.int64)
    end = np.cumsum(take)
    first = end - take
    new = (alone + discount * t) * base
    u = rng.random(end[-1])
    # u * (new + customers - discount * tables) < new as a bound on the tables opened by earlier ones
    seated = np.arange(end[-1]) + np.repeat(at - discount * t - first, take)
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = (u * seated - (1 - u) * np.repeat(new, take)) / (u * discount + (1 - u) * np.repeat(discount * base, take))
        bound = np.clip(np.floor(bound), -1, MANY).astype(np.int32)
    opened = np.zeros(len(u), np.int32)
    while True:
        opens = opened > bound
        total = np.cumsum(opens, dtype=np.int32)
        total -= opens
        total -= np.repeat(total[first], take)
        if (total == opened).all():
            return t + np.add.reduceat(opens, first, dtype=np.int64), at + take
        opened = total


def _by_waiting(customers, base, alone, t, at, discount, rng):
    """Seats customers up to the next one who opens a table: tables and customers then."""
    new = (alone + discount * t) * base
    coin = rng.beta(np.maximum(new, 1e-300), at - discount * t)
    with np.errstate(divide="ignore", over="ignore"):
        now = at + np.floor(rng.standard_exponential(len(t)) / -np.log1p(-coin)) + 1
    opens = now <= customers
    return t + opens, np.where(opens, now, customers)


def discount_of(ones: float, twos: float) -> float:
    """The usual estimate from the numbers of dishes with one and two customers."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def predictive(customers, tables, size, all_tables, discount: float, below, strength: float = STRENGTH):
    """The Pitman-Yor rule: probability of a dish given those seated, and of the parent's draw for the rest."""
    return (np.maximum(customers - discount * tables, 0) + (strength + discount * all_tables) * below) / (strength + size)


@dataclass
class Level:
    """Restaurants of one context length: grams are (context, symbol), as big-endian numbers."""

    grams: np.ndarray
    direct: np.ndarray  # customers that do not come from a longer context
    context: np.ndarray | None = None  # index into contexts
    contexts: np.ndarray | None = None
    parent: np.ndarray | None = None  # index of the gram without its first byte, one level down
    chance: np.ndarray | None = None  # averaged predictive probability
    backoff: np.ndarray | None = None  # averaged weight of the parent, by context


class Spelling:
    """Byte-level restaurants for contexts of ``low`` to ``high`` bytes.

    ``grams`` are those of the longest contexts, with their customers; the shorter
    ones follow. ``base`` gives the probability of a gram's last byte below ``low``.
    """

    def __init__(self, grams: np.ndarray, customers: np.ndarray, low: int, high: int, base, sweeps: int, burn: int, seed: int):
        self.low, self.base = low, base
        self.levels: list[Level] = []
        made = [Level(grams, customers.astype(np.float64))]
        for d in range(high - 1, low - 1, -1):
            less, _, made[-1].parent = distinct_near(made[-1].grams & np.uint64((1 << 8 * (d + 1)) - 1))
            made.append(Level(less, np.zeros(len(less))))
        self.levels = made[::-1]
        for lv in self.levels:
            context = lv.grams >> np.uint64(8)
            new = np.ones(len(context), bool)
            new[1:] = context[1:] != context[:-1]
            lv.contexts, lv.context = context[new], np.cumsum(new) - 1
        if len(grams):
            self._gibbs(sweeps, burn, np.random.default_rng(seed))

    def _gibbs(self, sweeps: int, burn: int, rng: np.random.Generator) -> None:
        lv = self.levels
        n = len(lv)
        seats: list = [None] * n
        custom = [x.direct.copy() for x in lv]
        disc = [0.5] * n
        floor = self.base(lv[0].grams)
        for d in range(n - 1, -1, -1):  # to begin with: one table for each dish
            if d + 1 < n:
                custom[d] = lv[d].direct + np.bincount(lv[d + 1].parent, seats[d + 1], len(lv[d].grams))
            seats[d] = np.minimum(custom[d], 1)
            disc[d] = discount_of(float((custom[d] == 1).sum()), float((custom[d] == 2).sum()))
        chance = [np.zeros(len(x.grams)) for x in lv]
        back = [np.zeros(len(x.contexts)) for x in lv]
        for sweep in range(sweeps):
            now: list = [None] * n
            for d, x in enumerate(lv):
                size, filled = (np.bincount(x.context, v, len(x.contexts)) for v in (custom[d], seats[d]))
                now[d] = predictive(custom[d], seats[d], size[x.context], filled[x.context], disc[d], now[d - 1][x.parent] if d else floor)
                if sweep >= burn:
                    chance[d] += now[d] / (sweeps - burn)
                    back[d] += (STRENGTH + disc[d] * filled) / (STRENGTH + size) / (sweeps - burn)
            for d in range(n - 1, -1, -1):
                if d + 1 < n:
                    custom[d] = lv[d].direct + np.bincount(lv[d + 1].parent, seats[d + 1], len(lv[d].grams))
                filled = np.bincount(lv[d].context, seats[d], len(lv[d].contexts))[lv[d].context]
                seats[d] = seat(custom[d], now[d - 1][lv[d].parent] if d else floor, filled - seats[d], disc[d], rng)
        for d, x in enumerate(lv):
            x.chance, x.backoff = chance[d], back[d]

    def symbol(self, grams: np.ndarray) -> np.ndarray:
        """Averaged predictive probability of each gram's last byte after the bytes before it."""
        top = self.levels[-1]
        p, rest = np.empty(len(grams)), np.arange(len(grams))
        if len(top.grams):  # what is known there needs no shorter context
            at = np.minimum(np.searchsorted(top.grams, grams), len(top.grams) - 1)
            p[:] = top.chance[at]
            rest = np.flatnonzero(top.grams[at] != grams)
        p[rest] = self._symbol(grams[rest])
        return p

    def _symbol(self, grams: np.ndarray) -> np.ndarray:
        p = self.base(grams)
        for k, x in enumerate(self.levels):
            if not len(x.grams):
                continue
            g = grams & np.uint64((1 << 8 * (self.low + k + 1)) - 1)
            at = np.minimum(np.searchsorted(x.grams, g), len(x.grams) - 1)
            ctx = g >> np.uint64(8)
            c = np.minimum(np.searchsorted(x.contexts, ctx), len(x.contexts) - 1)
            p = np.where(x.grams[at] == g, x.chance[at], np.where(x.contexts[c] == ctx, x.backoff[c], 1.0) * p)
        return p


def word_grams(words: list[bytes], order: int, chunk: int = 1 << 20):
    """(grams, word): for each byte of each word and its end (a space) the ``order`` bytes before it and it; in chunks."""
    if not words:
        return
    pad = b" " * order
    run = np.frombuffer(pad + pad + (b" " + pad).join(words) + b" ", np.uint8)  # ``order`` bytes more in front
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1 + order
    end = np.cumsum(size)
    first = end - size  # where each word's padding begins
    for lo in range(0, len(run) - order, chunk):
        hi = min(len(run) - order, lo + chunk)
        some = slice(np.searchsorted(first, lo, "right") - 1, np.searchsorted(first, hi - 1, "right"))
        word = np.repeat(np.arange(some.start, some.stop), np.minimum(end[some], hi) - np.maximum(first[some], lo))
        inside = np.arange(lo, hi) - first[word] >= order
        g = np.zeros(hi - lo, np.uint64)
        for k in range(order, -1, -1):
            g <<= np.uint64(8)
            g |= run[lo + order - k : hi + order - k]
        yield g[inside], word[inside]
