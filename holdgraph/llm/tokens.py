"""Operator 1: token counts of whole texts under a byte-level BPE vocabulary.

Pre-tokens of a batch are hashed as spans of one code-point array; only those that the worker has
not met yet are merged, all of them together as ragged arrays (``RankMerger``). The job is one
narrow map: no shuffle, no state beyond a bounded table in each worker.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from holdgraph.llm import textkit
from holdgraph.llm.merges import RankMerger
from holdgraph.llm.session import id_and_text

#: Pre-tokens that a worker remembers; a full table starts afresh.
REMEMBERED = 500_000


class TokenCounter:
    def __init__(self, path: str):
        self.merger = RankMerger.from_json(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        if whole["normalizer"] or whole["pre_tokenizer"].get("type") != "ByteLevel" or not whole["pre_tokenizer"]["use_regex"] or whole["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: not a plain byte-level tokenizer")
        self.special = [t["content"] for t in whole["added_tokens"]]
        self.known = textkit.WordTable(REMEMBERED, np.int32)

    def _count(self, texts: list[str]) -> np.ndarray:
        cp, bounds = textkit.codepoints(texts)
        starts, ends = textkit.split_spaced(cp, bounds)
        if not len(starts):
            return np.zeros(len(texts), dtype=np.int64)

        def fill(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            _, left = self.merger.encode(cp, starts[which], ends[which])
            return left, np.ones(len(which), dtype=np.int64)

        rows = self.known.find(textkit.span_hashes(cp, starts, ends), fill)
        return textkit.sums_by(self.known.values[rows], np.searchsorted(starts, bounds))

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. A special token's string is one token and splits its text."""
        parts, owner, extra = [], [], np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            pieces = [text]
            for s in self.special:
                if s in text:
                    pieces = [y for x in pieces for y in x.split(s)]
            extra[k] = len(pieces) - 1
            parts += pieces
            owner += [k] * len(pieces)
        out = extra.astype(np.float64)
        owner = np.array(owner, dtype=np.int64)
        for a, b in textkit.slices(map(len, parts)):
            out += np.bincount(owner[a:b], weights=self._count(parts[a:b]), minlength=len(texts))
        return out.astype(np.int64)


@lru_cache(maxsize=2)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer_json: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row by row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Rows with a null or repeated id stay rows of
    their own; an empty table gives an empty one; other columns are ignored, whatever their names.
    Texts are never cut, whatever their length.
    """
    docs = id_and_text(docs, id_col, text_col)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_json)
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            for a, b, texts in textkit.text_slices(batch.column("text")):
                n[a:b] = counter.count(texts)
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, schema)
