"""Operator 8: BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the normalised code points cuts each text into chunks whose borders depend on
the content around them alone, so copies and shared passages give the same chunks wherever they
stand. A worker encodes each chunk once and takes the ids of known chunks from a bounded table.
A cut may fall inside a word: the stretch of non-blank characters around it is encoded again as a whole,
and its ids replace those at the chunks' ends, which must agree with the ids of the parts when those are
encoded alone; where they don't, the stretch grows until they do.

Ids of words come from the tokenizer file's merges, applied to all new words of a batch at once.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from holdgraph.llm import textkit
from holdgraph.llm.merges import RankMerger
from holdgraph.llm.session import id_and_text
from holdgraph.llm.textkit import ragged_index, span_hashes

#: Bounds of a worker's tables.
REMEMBERED_WORDS, REMEMBERED_CHUNKS = 500_000, 60_000
#: Code points that decide on a cut; one place in so many is cut; the longest chunk.
WINDOW, ONE_IN, LONGEST = 16, 512, 4096


class WordCoder:
    """Encodes texts as the tokenizers library does with a lower-casing, word-end BPE file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        self.special = [t["content"] for t in whole["added_tokens"]]
        kinds = [whole["normalizer"]["type"], *(x["type"] for x in whole["normalizer"].get("normalizers", []))]
        if set(kinds) - {"Sequence", "NFC", "Replace", "Lowercase"}:
            raise ValueError(f"{path}: a normaliser that isn't known here")
        self.merger = RankMerger.from_json(path)
        size = 1 + max([*whole["model"]["vocab"].values(), *(t["id"] for t in whole["added_tokens"])])
        if size > 1 << 16:
            raise ValueError(f"{path}: ids over 65,535")
        self.strings = [b""] * size
        for token, k in [*whole["model"]["vocab"].items(), *((t["content"], t["id"]) for t in whole["added_tokens"])]:
            self.strings[k] = token.encode()
        self.decimals = [str(k).encode() for k in range(size)]
        self.words = textkit.WordTable(REMEMBERED_WORDS)
        self.chunks = textkit.WordTable(REMEMBERED_CHUNKS)
        self._library = None

    def by_library(self, text: str) -> np.ndarray:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype=np.uint16)

    def normal(self, text: str) -> str:
        """NFC, then lower case character by character (a final sigma too stays a plain one)."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode_spans(self, cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts end to end, and the borders of each text's ids."""
        starts, ends = textkit.split_words(cp, bounds)
        if not len(starts):
            return np.zeros(0, dtype=np.uint16), np.zeros(len(bounds), dtype=np.int64)
        rows = self.words.find(span_hashes(cp, starts, ends), lambda k: self.merger.encode(cp, starts[k], ends[k]))
        ids, lengths = self.words.gather(rows)
        return ids, np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, bounds)]

    def encode_pieces(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_spans(cp[ragged_index(starts, ends - starts)], np.concatenate([[0], np.cumsum(ends - starts)]))

    def encode_chunked(self, cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode_spans, by chunks."""
        n, texts = len(cp), len(bounds) - 1
        if not n:
            return np.zeros(0, dtype=np.uint16), np.zeros(texts + 1, dtype=np.int64)
        cuts = chunk_borders(cp, bounds)
        starts, ends = cuts[:-1], cuts[1:]

        def fill(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ids, at = self.encode_pieces(cp, starts[which], ends[which])
            return ids, np.diff(at)

        rows = self.chunks.find(span_hashes(cp, starts, ends), fill)
        ids, lengths = self.chunks.gather(rows)
        at = np.cumsum(lengths) - lengths

        # Repair: around each cut that parts non-blank characters, the stretch between blanks is encoded anew.
        # What the two chunks have of it must be what those parts give when encoded alone; where it isn't,
        # the stretch grows to both sides, at last to the whole text, until all agree.
        blank = textkit.char_classes()[cp] == textkit.SPACE
        inner = starts[~np.isin(starts, bounds)]
        inner = inner[~blank[inner] & ~blank[inner - 1]]
        edges = np.union1d(np.flatnonzero(blank), bounds)
        text = np.searchsorted(bounds, inner, side="right") - 1
        reach = np.zeros(len(inner), dtype=np.int64)
        while True:
            run_l, run_r = self._stretches(inner, reach, edges, blank, bounds[text], bounds[text + 1])
            # What each chunk has of a stretch at its start and at its end.
            head_end, tail_start = starts.copy(), ends.copy()
            if len(run_l):
                j = np.searchsorted(run_l, starts, side="right") - 1
                inside = (j >= 0) & (run_l[np.maximum(j, 0)] <= starts) & (run_r[np.maximum(j, 0)] > starts)
                head_end[inside] = np.minimum(run_r[j[inside]], ends[inside])
                j = np.searchsorted(run_l, ends, side="left") - 1
                inside = (j >= 0) & (run_r[np.maximum(j, 0)] >= ends)
                tail_start[inside] = np.maximum(run_l[j[inside]], starts[inside])
            tail_start = np.maximum(tail_start, head_end)
            head_ids, head_at = self.encode_pieces(cp, starts, head_end)
            tail_ids, tail_at = self.encode_pieces(cp, tail_start, ends)
            heads, tails = np.diff(head_at), np.diff(tail_at)
            same = heads + tails <= lengths
            for size, part, first in ((heads, head_ids, at), (tails, tail_ids, at + lengths - tails)):
                owner = np.repeat(np.arange(len(starts)), size)
                index = np.clip(ragged_index(first, size), 0, max(0, len(ids) - 1))
                same[owner[same[owner] & (ids[index] != part)] if len(ids) else owner] = False
            if same.all():
                break
            wrong = np.concatenate([starts[~same], ends[~same]])
            reach = np.where(np.isin(inner, wrong), 2 * reach + 1, reach)
        # Splice: the chunks' middles and the stretches, in order of place.
        run_ids, run_at = self.encode_pieces(cp, run_l, run_r)
        place = np.concatenate([head_end, run_l])
        source = np.concatenate([at + heads, len(ids) + run_at[:-1]])
        size = np.concatenate([lengths - heads - tails, np.diff(run_at)])
        is_run = np.concatenate([np.zeros(len(starts), dtype=np.int8), np.ones(len(run_l), dtype=np.int8)])
        order = np.lexsort((is_run, place))
        # A chunk that lies wholly inside a stretch has nothing between, so its place doesn't matter.
        place, source, size = place[order], source[order], size[order]
        out = np.concatenate([ids, run_ids])[ragged_index(source, size)]
        return out, np.concatenate([[0], np.cumsum(size)])[np.searchsorted(place, bounds)]

    @staticmethod
    def _stretches(cuts: np.ndarray, reach: np.ndarray, edges: np.ndarray, blank: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Borders of the stretches around cuts, `reach` blanks wider than to the next, inside texts [lo, hi);
        stretches that overlap are one."""
        if not len(cuts):
            return cuts, cuts
        before = edges[np.maximum(np.searchsorted(edges, cuts, side="right") - 1 - reach, 0)]
        at_blank = (before < len(blank)) & blank[np.minimum(before, len(blank) - 1)]
        left = np.maximum(np.where(at_blank, before + 1, before), lo)
        right = np.minimum(edges[np.minimum(np.searchsorted(edges, cuts, side="left") + reach, len(edges) - 1)], hi)
        order = np.lexsort((right, left))
        left, right = left[order], np.maximum.accumulate(right[order])
        first = np.flatnonzero(np.concatenate([[True], left[1:] >= right[:-1]]))
        return left[first], right[np.append(first[1:], len(left)) - 1]

    def encode(self, texts: list[str], chunked: bool = False) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        for a, b in textkit.slices(map(len, texts)):
            part = texts[a:b]
            odd = {k for k, t in enumerate(part) if any(s in t for s in self.special)}
            cp, bounds = textkit.codepoints(["" if k in odd else self.normal(t) for k, t in enumerate(part)])
            ids, at = (self.encode_chunked if chunked else self.encode_spans)(cp, bounds)
            for k, text in enumerate(part):
                yield self.by_library(text) if k in odd else ids[at[k] : at[k + 1]]

    def encode_column(self, column: pa.Array, chunked: bool = False) -> Iterator[np.ndarray]:
        for _, _, texts in textkit.text_slices(column):
            yield from self.encode(texts, chunked)


def chunk_borders(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where chunks begin, and the end. Texts' borders are among them; else a place is cut where
    the hash of the code points before it says so, and in any case after the longest length."""
    n = len(cp)
    cut = np.zeros(n + 1, dtype=bool)
    if n > WINDOW:
        starts = np.arange(n - WINDOW + 1)
        cut[WINDOW:] = span_hashes(cp, starts, starts + WINDOW, seed=7) % np.uint64(ONE_IN) == 0
        near = (bounds[:-1, None] + np.arange(WINDOW)[None, :]).ravel()
        cut[near[near <= n]] = False
    cut[bounds] = True
    cuts = np.flatnonzero(cut)
    parts = np.maximum(1, -(-np.diff(cuts) // LONGEST))
    return np.append(np.repeat(cuts[:-1], parts) + LONGEST * ragged_index(np.zeros(len(parts), dtype=np.int64), parts), n)


@lru_cache(maxsize=2)
def coder(path: str) -> WordCoder:
    return WordCoder(path)


def encode_documents(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row by row: doc_id, ids (array of int), decoded (the library's decode of the ids: the file
    names no decoder, so the token strings are joined by one space).

    A null text counts as empty and gives no ids and an empty string. Rows with a null or repeated
    id stay rows of their own; other columns are ignored, whatever their names. Texts are never cut.
    """
    docs = id_and_text(docs, id_col, text_col)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(tokenizer_json)
        for batch in batches:
            ids, decoded = [], []
            for one in words.encode_column(batch.column("text"), chunked=True):
                ids.append(one.astype(np.int32))
                decoded.append(b" ".join(map(words.strings.__getitem__, one.tolist())).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.mapInArrow(run, schema)


def digest_documents(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_documents, with digests in place of the ids and the decoded text: doc_id, n_tokens,
    ids_sha256 (decimal ids joined by one space), decoded_sha256. The digests are made where the
    ids are, so that those never leave the Python worker."""
    docs = id_and_text(docs, id_col, text_col)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(tokenizer_json)
        for batch in batches:
            n, a, b = [], [], []
            for one in words.encode_column(batch.column("text"), chunked=True):
                listed = one.tolist()
                n.append(len(listed))
                a.append(hashlib.sha256(b" ".join(map(words.decimals.__getitem__, listed))).hexdigest())
                b.append(hashlib.sha256(b" ".join(map(words.strings.__getitem__, listed))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, schema)
