"""Byte-pair merging of many short sequences at once, as ragged numpy arrays."""

from __future__ import annotations

import json

import numpy as np

from holdgraph.llm.textkit import ragged_index

NO_RANK = np.iinfo(np.int32).max


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others for code points from 256 on, in order."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class RankMerger:
    """Applies a tokenizer's merges to byte sequences.

    All sequences advance together: in each round every sequence merges all places of its own
    lowest-ranked pair (left to right where places overlap), until no pair has a rank. A merge only
    makes pairs of higher rank, so this ends in the same symbols as merging one pair at a time.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list, word_end: str = ""):
        alphabet = byte_alphabet()
        self.byte_ids = np.array([vocabulary[c] for c in alphabet], dtype=np.int64)
        self.last_ids = np.array([vocabulary[c + word_end] for c in alphabet], dtype=np.int64)
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ", 1) for m in merges]
        left = np.array([vocabulary[a] for a, _ in pairs], dtype=np.uint64)
        right = np.array([vocabulary[b] for _, b in pairs], dtype=np.uint64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        self._index(left << np.uint64(20) | right)

    @classmethod
    def from_json(cls, path: str) -> RankMerger:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return cls(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")

    def _index(self, keys: np.ndarray) -> None:
        """An open-addressing table from pair to rank, eight times as large as the pairs."""
        self.bits = max(10, (8 * len(keys)).bit_length())
        size = 1 << self.bits
        self.slot_key = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.slot_rank = np.full(size, NO_RANK, dtype=np.int32)
        for rank, slot in enumerate(self._slot(keys).tolist()):
            while self.slot_rank[slot] != NO_RANK:
                slot = (slot + 1) % size
            self.slot_key[slot], self.slot_rank[slot] = keys[rank], rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(20) | right.astype(np.uint64)
        slot = self._slot(keys).astype(np.int64)
        found = self.slot_key[slot]
        out = np.where(found == keys, self.slot_rank[slot], NO_RANK)
        empty = np.iinfo(np.uint64).max
        open_ = np.flatnonzero((found != keys) & (found != empty))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_rank[slot[open_[hit]]]
            open_ = open_[~hit & (found != empty)]
        return out

    def encode(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words cp[start:end] of code points, end to end, and how many each has."""
        points = cp[ragged_index(starts, ends - starts)]
        data = np.frombuffer(points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        size = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        to = np.concatenate([[0], np.cumsum(size)])[np.cumsum(ends - starts)]
        symbols = self.byte_ids[data]
        symbols[to - 1] = self.last_ids[data[to - 1]]
        return self.merge(symbols, np.diff(to, prepend=0))

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left of sequences laid end to end, and their new lengths."""
        left = lengths.astype(np.int64).copy()
        alive = np.flatnonzero(left > 0)
        lengths = left[alive]
        done_symbols, done_rows = [], []
        while len(alive):
            first = np.cumsum(lengths) - lengths
            rank = np.full(len(symbols), NO_RANK, dtype=np.int32)
            rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
            rank[first + lengths - 1] = NO_RANK
            lowest = np.minimum.reduceat(rank, first)
            merge = (rank == np.repeat(lowest, lengths)) & (rank != NO_RANK)
            at = np.flatnonzero(merge)
            # Of neighbouring places (a run of one symbol) every second one merges.
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = at[1:] != at[:-1] + 1
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            lengths = lengths - np.add.reduceat((~keep).astype(np.int64), first)
            symbols = symbols[keep]
            left[alive] = lengths
            going = (lowest != NO_RANK) & (lengths > 1)
            if not going.all():
                stays = np.repeat(going, lengths)
                done_symbols.append(symbols[~stays])
                done_rows.append(alive[~going])
                symbols, alive, lengths = symbols[stays], alive[going], lengths[going]
        if not done_rows:
            return np.zeros(0, dtype=np.int64), left
        rows = np.concatenate(done_rows)
        sizes = left[rows]
        starts = np.zeros(len(left), dtype=np.int64)
        starts[rows] = np.cumsum(sizes) - sizes
        return np.concatenate(done_symbols)[ragged_index(starts, left)], left
