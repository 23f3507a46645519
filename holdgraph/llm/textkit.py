"""Vectorised text helpers used inside Spark tasks by the tokenising operators.

Texts of one Arrow batch are laid end to end as one array of code points; word
borders, word hashes and look-ups are then array operations over the batch.
Nothing here talks to Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points handled at once; a longer text is a slice of its own. All temporary arrays of a task follow it.
SLICE_CODEPOINTS = 1 << 18

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    r"""Class of every code point, as the tokenizers library's own regex engine
    sees ``\s``, ``\p{L}`` and ``\p{N}``, so that splits agree with it exactly."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    # Planes beyond these hold neither letters, numbers nor white space.
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x34000)])
    every = "".join(map(chr, points))
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        matched = np.ones(len(points), dtype=bool)
        for _, (start, end) in Split(Regex(pattern), "removed").pre_tokenize_str(every):
            matched[start:end] = False
        table[points[matched]] = kind
    return table


@lru_cache(maxsize=4)
def _powers(length: int, base: int) -> np.ndarray:
    out = np.full(length, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below a power of two >= length."""
    size = 1 << max(10, int(length).bit_length())
    return _powers(size, _BASE), _powers(size, _BASE_INVERSE)


def finalise(h: np.ndarray) -> np.ndarray:
    """splitmix64's last step: spreads what is in the high bits over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Spans:
    """64-bit hashes of spans values[start:end] that do not depend on where they stand."""

    def __init__(self, values: np.ndarray, seed: int = 0):
        power, self.inverse = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(finalise(values.astype(np.uint64) + np.uint64(seed + 1)) * power[: len(values)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return finalise(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    return Spans(values, seed).hashes(starts, ends)


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points end to end, and len(texts) + 1 borders."""
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, dtype=np.uint32), bounds


def slices(lengths: Iterable[int], most: int = SLICE_CODEPOINTS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that hold at most so many code points, or one text."""
    start = total = at = 0
    for at, n in enumerate(lengths):
        if at > start and total + n > most:
            yield start, at
            start, total = at, 0
        total += n
    if at >= start:
        yield start, at + 1


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """First row, row after the last, and texts (null: empty) of each slice of a column, made one by one, so
    that a batch of long texts never stands in memory as Python strings."""
    for a, b in slices(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every span, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def _shift(flags: np.ndarray, by: int) -> np.ndarray:
    """flags[i + by], False beyond the end."""
    out = np.zeros_like(flags)
    out[:-by] = flags[by:]
    return out


def _contractions(cp: np.ndarray, at: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of apostrophes at token starts: those that begin 's 't 'm 'd 're 've 'll, and the token lengths.
    last: the end of the text of each position."""
    if not len(at):
        return at, at
    n = len(cp)
    one = np.where(at + 1 < last, cp[np.minimum(at + 1, n - 1)], 0)
    two = np.where(at + 2 < last, cp[np.minimum(at + 2, n - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    hit = short | long
    return at[hit], np.where(short, 2, 3)[hit]


def _with_contractions(cp: np.ndarray, bounds: np.ndarray, start: np.ndarray, token: np.ndarray, where: np.ndarray) -> None:
    at = np.flatnonzero(where)
    if len(at):
        last = bounds[np.searchsorted(bounds, at, side="right")]
        at, size = _contractions(cp, at, last)
        for k in (1, 2):
            start[at[size > k] + k] = False
        after = at + size
        after = after[after < len(cp)]
        after = after[token[after]]
        start[after] = True


def split_words(cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r"""Starts and ends of the tokens that ``'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+``
    finds in each text."""
    if not len(cp):
        none = np.zeros(0, dtype=np.int64)
        return none, none
    kind = char_classes()[cp]
    new = np.empty(len(cp), dtype=bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[bounds[:-1][bounds[:-1] < len(cp)]] = True
    new |= kind == NUMBER
    token = kind != SPACE
    start = new & token
    _with_contractions(cp, bounds, start, token, start & (cp == 39))
    edge = start | (new & ~token)
    edges = np.append(np.flatnonzero(edge), len(cp))
    keep = token[edges[:-1]]
    return edges[:-1][keep], edges[1:][keep]


def split_spaced(cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r"""Starts and ends of the tokens of
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+``: they cover every text."""
    if not len(cp):
        none = np.zeros(0, dtype=np.int64)
        return none, none
    kind = char_classes()[cp]
    n = len(cp)
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    first_here, last_here = first[:-1], first[1:]
    space = kind == SPACE
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= first_here
    # The last white space before something else stands alone, or goes with it if it is U+0020.
    before = space & ~last_here & ~_shift(space, 1)
    start = new | before
    blank = before & (cp == 32)
    taken = np.zeros(n, dtype=bool)
    taken[1:] = blank[:-1]
    start &= ~taken
    token = np.ones(n, dtype=bool)
    _with_contractions(cp, bounds, start, token, start & (cp == 39))
    edges = np.append(np.flatnonzero(start), n)
    return edges[:-1], edges[1:]


class WordTable:
    """What is known of words by their 64-bit hashes: a ragged array of values for each.

    It holds at most ``most`` words and starts afresh beyond that, so a worker's memory is bounded;
    it can be rebuilt from the text at any time.
    """

    def __init__(self, most: int, dtype=np.uint16):
        self.most, self.dtype = most, dtype
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.rows = np.zeros(0, dtype=np.int64)  # of each key
        self.count = 0
        self.offsets = np.zeros(1024, dtype=np.int64)
        self.values = np.zeros(8192, dtype=self.dtype)

    def _append(self, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Adds rows, doubling the room where it doesn't suffice."""
        end = self.offsets[self.count]
        after = self.count + len(lengths)
        if after >= len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros(max(after, len(self.offsets)), dtype=np.int64)])
        if end + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros(max(len(values), len(self.values)), dtype=self.dtype)])
        self.offsets[self.count + 1 : after + 1] = end + np.cumsum(lengths)
        self.values[end : end + len(values)] = values
        rows = np.arange(self.count, after, dtype=np.int64)
        self.count = after
        return rows

    def find(self, hashes: np.ndarray, fill) -> np.ndarray:
        """Rows of the words; fill(positions of one word for each unknown hash) gives
        the values and lengths of new words."""
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if self.count + len(distinct) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == distinct
        rows = np.empty(len(distinct), dtype=np.int64)
        rows[known] = self.rows[at[known]]
        if not known.all():
            fresh = self._append(*fill(where[~known]))
            rows[~known] = fresh
            self.keys = np.insert(self.keys, at[~known], distinct[~known])
            self.rows = np.insert(self.rows, at[~known], fresh)
        return rows[inverse]

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the rows end to end, and their lengths."""
        starts = self.offsets[rows]
        lengths = self.offsets[rows + 1] - starts
        return self.values[ragged_index(starts, lengths)], lengths


def sums_by(values: np.ndarray, owner_bounds: np.ndarray) -> np.ndarray:
    """Sums of values[b[i]:b[i + 1]]; 0 for empty ranges."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[owner_bounds[1:]] - total[owner_bounds[:-1]]
