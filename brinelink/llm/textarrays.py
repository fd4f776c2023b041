"""Words, hashes and sliding minima of many texts at once, as arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_U = np.uint64
#: Bytes of text handled at once, unless one text is larger.
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
_FOLDED = _BYTE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each begins; null counts as empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in slices of about BLOCK_BYTES of text."""
    if not len(batch):
        return
    at = utf8(batch.column(text))[1]
    start = 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(at, at[start] + BLOCK_BYTES, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word (no ASCII white space in it), and the first word of every text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    space = _SPACE[data]
    edge = at[(at > 0) & (at < len(data))]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    before[edge] = True
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[edge - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, at)


def hasher(data: np.ndarray, fold: bool = True) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Function of starts and ends that gives a 64-bit hash of each byte range, A-Z read as a-z if ``fold``."""
    n = len(data)
    if not n:
        return lambda starts, ends: np.zeros(len(starts), np.uint64)
    power = np.full(n, _BASE, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTE)[data] * power, out=sums[1:])
    back = np.full(n, _BASE_INV, np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)

    def hashed(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * back[np.minimum(starts, n - 1)] + (ends - starts).astype(np.uint64))

    return hashed


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte range, A-Z read as a-z if ``fold``."""
    return hasher(data, fold)(starts, ends)


def shingles(word: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row within a text, and the first shingle of every text.

    A text of fewer words but one has one shingle, of all its words.
    """
    counts = np.diff(first)
    full = np.maximum(counts - size + 1, 0)
    n = np.where((counts > 0) & (full == 0), 1, full)
    out_first = np.concatenate([[0], np.cumsum(n)])
    index = np.arange(out_first[-1]) - np.repeat(out_first[:-1], n) + np.repeat(first[:-1], n)
    left = np.repeat(first[1:], n) - index
    padded = np.concatenate([word, np.zeros(size, np.uint64)])
    total = np.zeros(len(index), np.uint64)
    for j in range(size):
        total = mix(total * _U(0x2545F4914F6CDD1D) + np.where(left > j, padded[index + j], _U(0)) + _U(j + 1))
    return total, out_first


def minima(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` neighbours; one result per start."""
    low, width = x, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = span - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def reach(x: np.ndarray, at: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the element at each position stays the smallest: leftmost and rightmost position.

    That is the subtree of a Cartesian tree, up to ``limit`` (a power of two less one) on each side.
    """
    tables, width = [x], 1
    while width * 2 <= limit + 1:
        last = tables[-1]
        tables.append(np.minimum(last[:-width], last[width:]) if len(last) > width else last[:0])
        width *= 2
    value = x[at]
    left, right = at.copy(), at.copy()
    for j in range(len(tables) - 2, -1, -1):
        step, low = 1 << j, tables[j]
        if not len(low):
            continue
        q = left - step
        ok = (q >= 0) & (low[np.clip(q, 0, len(low) - 1)] >= value)
        left = np.where(ok, q, left)
        q = right + 1
        ok = (q < len(low)) & (low[np.clip(q, 0, len(low) - 1)] >= value)
        right = np.where(ok, right + step, right)
    return left, right


def first_minima(x: np.ndarray, span: int) -> np.ndarray:
    """Position of the leftmost minimum of every ``span`` neighbours."""
    low, at, width = x, np.arange(len(x)), 1
    steps = []
    while width * 2 <= span:
        steps.append(width)
        width *= 2
    if span - width:
        steps.append(span - width)
    for s in steps:
        take = low[s:] < low[:-s]
        at = np.where(take, at[s:], at[:-s])
        low = np.where(take, low[s:], low[:-s])
    return at


class Memory:
    """Results for pieces of text, of the last ``limit`` to twice as many different ones."""

    def __init__(self, limit: int):
        self.limit, self.now, self.old = limit, {}, {}

    def results(self, pieces: list[list], code) -> list[list]:
        """The result of each piece of each list; ``code`` adds those of a list of new ones (never None)."""
        if len(self.now) > self.limit:
            self.now, self.old = {}, self.now
        now = self.now
        got = [list(map(now.get, p)) for p in pieces]
        holes = [(g, p, [i for i, v in enumerate(g) if v is None]) for g, p in zip(got, pieces) if None in g]
        new = {p[i] for _, p, at in holes for i in at}
        again = new & self.old.keys()
        now.update((p, self.old[p]) for p in again)
        order = list(new - again)
        if order:
            code(order, now)
        for g, p, at in holes:
            for i in at:
                g[i] = now[p[i]]
        return got
