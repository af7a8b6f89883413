"""Token hashes of many texts at once, without a Python step per token.

A token is a run of ASCII letters and digits and non-ASCII bytes of the lower-cased
text. Its hash is a polynomial in a random value per byte, taken from prefix sums
modulo 2**64 and normalised by the inverse power at its start, then mixed. Bytes
are taken ``SEGMENT`` at a time, and a token longer than that is summed up segment
by segment, so its length does not matter.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Any byte but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
SEGMENT = 1 << 20
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)])) for b in (np.uint64(_BASE), np.uint64(_INVERSE))]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def in_order(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of numbers in rising order, and the numbers in it; of equal numbers in any order.

    Places are sorted with the numbers, below as many of their upper bits as there is
    room for, which is several times quicker than sorting places by numbers. That is
    done where numbers differ in lower bits alone.
    """
    if not len(a):
        return np.empty(0, np.int64), a
    least, bits = a.min(), (len(a) - 1).bit_length()
    drop = max(0, (int(a.max()) - int(least)).bit_length() + bits - 64)
    key = (a - least).astype(np.uint64)
    key >>= np.uint64(drop)
    key <<= np.uint64(bits)
    key |= np.arange(len(a), dtype=np.uint64)
    key.sort()
    key &= np.uint64((1 << bits) - 1)
    order = key.view(np.int64)
    values = a[order]
    if drop and (values[1:] < values[:-1]).any():
        order = np.argsort(a)
        values = a[order]
    return order, values


def distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each, and at each place the number of its value."""
    order, values = in_order(a)
    new = np.ones(len(a), bool)
    new[1:] = values[1:] != values[:-1]
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    return values[new], order[new], number


def distinct_near(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``distinct`` of numbers many of which differ in their lower bits alone."""
    _, first, number = distinct(mix(a))
    order = np.argsort(a[first])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    first = first[order]
    return a[first], first, rank[number]


def _segment(buf: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the tokens that lie wholly in ``buf``."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = part.take(buf)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(buf))
    with np.errstate(over="ignore"):
        value = _BYTE.take(buf)
        value *= power[: len(buf)]
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        return mix((total[end] - total[start]) * inverse[start]), start, end


def _long(buf: np.ndarray) -> int:
    """The hash of one token, segment by segment."""
    power, _ = _power_tables(SEGMENT)
    step, total = pow(_BASE, SEGMENT, 1 << 64), 0
    with np.errstate(over="ignore"):
        for k, lo in enumerate(range(0, len(buf), SEGMENT)):
            some = buf[lo : lo + SEGMENT]
            total += int((_BYTE[some] * power[: len(some)]).sum(dtype=np.uint64)) * pow(step, k, 1 << 64)
    return int(mix(np.array([total % (1 << 64)], np.uint64))[0])


def scan(data: bytes, part: np.ndarray = _TOKEN, segment: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all tokens of ``data``, of any length; taken ``SEGMENT`` bytes at a time, or ``segment``."""
    buf = np.frombuffer(data, np.uint8)
    found, at = [], 0
    while at < len(buf):
        end = min(len(buf), at + (segment or SEGMENT))
        cut = end
        if end < len(buf):  # after the last byte that is in no token
            for lo in (max(at, end - 1024), at):
                gaps = np.flatnonzero(~part[buf[lo:end]])
                cut = lo + int(gaps[-1]) + 1 if len(gaps) else at
                if cut > at:
                    break
        if cut > at:
            h, s, e = _segment(buf[at:cut], part)
            found.append((h, s + at, e + at))
            at = cut
            continue
        while end < len(buf):  # a token from here on that goes beyond the segment
            gaps = np.flatnonzero(~part[buf[end : end + SEGMENT]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(len(buf), end + SEGMENT)
        found.append((np.array([_long(buf[at:end])], np.uint64), np.array([at]), np.array([end])))
        at = end
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def token_hashes(texts: list[str | bytes | None], part: np.ndarray = _TOKEN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in turn, and where each text's tokens begin (one more entry than texts).

    ``part`` says which bytes belong to tokens. Texts given as bytes are taken as they are.
    """
    found, counts, group, size = [], [], [], 0

    def flush():
        nonlocal group, size
        if group:
            h, start, _ = scan(b"".join(group), part)
            ends = np.cumsum([len(g) for g in group])
            found.append(h)
            counts.extend(np.diff(np.searchsorted(start, ends), prepend=0).tolist())
            group, size = [], 0

    for t in texts:
        data = (t if isinstance(t, bytes) else (t or "").lower().encode(errors="replace")) + b" "
        group.append(data)
        size += len(data)
        if size > 2 * SEGMENT:
            flush()
    flush()
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return (np.concatenate(found) if found else np.empty(0, np.uint64)), bounds
