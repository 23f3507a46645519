"""Operator 5: chat formatting by token-level assembly, and reading it back.

Roles and texts are encoded each by itself, so no merge ever crosses a border; turn marks are
reserved ids above the vocabulary, spliced between them; the loss mask is the running sum of +1 at
each start and -1 at each end of an assistant text. So that the decoded form is unambiguous too,
control strings inside roles and texts are escaped reversibly.

Turns are dealt by conversation and sorted; what follows goes through them as a stream, so no task ever
holds a conversation whole, however many turns share one key.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Turn marks; their ids follow the vocabulary's, in this order.
OPEN, SAYS, CLOSE = MARKS = ("<turn>", "<says>", "</turn>")
TRAINED_ROLE = "assistant"
_NONE = object()
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    r"""Doubles every backslash and puts one after the first character of every mark."""
    text = text.replace("\\", "\\\\")
    for mark in MARKS:
        text = text.replace(mark, f"{mark[0]}\\{mark[1:]}")
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@lru_cache(maxsize=2)
def _encoding(ranks_path: str):
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def assemble(turns: list[tuple[str, str]], encode, first_mark: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of one conversation."""
    opening, says, closing = ([first_mark + k] for k in range(3))
    parts, counted = [], []
    for role, text in turns:
        parts += [opening, encode(escape(role)), says, encode(escape(text)), closing]
        counted += [0, 0, 0, int(role == TRAINED_ROLE), 0]
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    ends = np.cumsum(lengths)
    change = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, dtype=np.int64)
    np.add.at(change, ends - lengths, counted)
    np.add.at(change, ends, np.negative(counted))
    ids = np.fromiter((i for p in parts for i in p), dtype=np.int32, count=int(lengths.sum()))
    return ids, np.cumsum(change)[:-1].astype(bool)


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_turns(turns: DataFrame, ranks_path: str) -> DataFrame:
    """conv_id, place (from 0 within the conversation), ids (array of int), loss_mask (array of boolean): one
    row for each turn, its marks included; a conversation is its turns' ids end to end.

    turns has conv_id, turn, role, text; other columns are ignored. Turns go by turn, then role and
    text where turns tie (nulls first); repeated rows are turns of their own. A null role or text
    counts as empty; rows with a null conv_id are one conversation. Texts are never cut. An empty table
    gives an empty one."""
    schema = T.StructType([turns.schema["conv_id"], T.StructField("place", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("loss_mask", T.ArrayType(T.BooleanType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, first = _encoding(ranks_path)
        last, place = _NONE, -1
        for batch in batches:
            places, ids, masks = [], [], []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                place = place + 1 if conv == last else 0
                last = conv
                i, m = assemble([(role or "", text or "")], encoding.encode_ordinary, first)
                places.append(place)
                ids.append(i)
                masks.append(m)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(places, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))], names=schema.names)

    ordered = _in_order(turns.select("conv_id", "turn", "role", "text"), "turn", "role", "text")
    return ordered.mapInArrow(run, schema)


def format_conversations(turns: DataFrame, ranks_path: str) -> DataFrame:
    """conv_id, ids, loss_mask: format_turns with one row for each conversation, for conversations that fit
    into a row."""
    parts = format_turns(turns, ranks_path).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "ids", "loss_mask"))).alias("parts"))
    return parts.select("conv_id", F.flatten("parts.ids").alias("ids"), F.flatten("parts.loss_mask").alias("loss_mask"))


def read_back(formatted: DataFrame, ranks_path: str) -> DataFrame:
    """What ids and masks say, without the input: conv_id, n_turns, turns_sha256 (role, newline, text,
    newline of each turn), loss_chars and loss_sha256 (the text under the mask), formatted_chars (of
    the decoded form with its marks and escapes). formatted: conv_id, place, ids, loss_mask."""
    return _read(_in_order(formatted.select("conv_id", "place", "ids", "loss_mask"), "place"), ranks_path)


def round_trip(turns: DataFrame, ranks_path: str) -> DataFrame:
    """read_back of format_turns in one pass: the ids are read where they are made, in their order, and move
    nowhere."""
    return _read(format_turns(turns, ranks_path), ranks_path)


def _read(ordered: DataFrame, ranks_path: str) -> DataFrame:
    """ordered: the turns of a conversation stand one after another in a partition."""
    schema = T.StructType([ordered.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    key_type = to_arrow_type(schema.fields[0].dataType)
    types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, first = _encoding(ranks_path)
        text = lambda ids: encoding.decode_bytes(ids.tolist()).decode()
        last, state = _NONE, None

        def ended() -> tuple:
            n, turns, chars, loss, formatted = state
            return last, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

        for batch in batches:
            done = []
            for conv, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("loss_mask"), strict=True):
                if conv != last:
                    if state is not None:
                        done.append(ended())
                    last, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy(zero_copy_only=False)
                marks = np.flatnonzero(ids >= first)
                state[4] += sum(len(MARKS[k - first]) for k in ids[marks].tolist())
                for start, says, end in marks.reshape(-1, 3).tolist():
                    role, said = text(ids[start + 1 : says]), text(ids[says + 1 : end])
                    state[0] += 1
                    state[4] += len(role) + len(said)
                    state[1].update(f"{unescape(role)}\n{unescape(said)}\n".encode())
                loss = unescape(text(ids[mask]))
                state[2] += len(loss)
                state[3].update(loss.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * len(types), types, strict=True)], names=schema.names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(ended(), types, strict=True)], names=schema.names)

    return ordered.mapInArrow(run, schema)
