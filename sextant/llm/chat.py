"""Chat formatting by columnar byte assembly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.sample import bytes_of

HEAD, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
_PIECE = 8 << 20
#: Bytes of conversations that are put together at once.
BATCH_BYTES = 64 << 20


def assemble(roles: pa.Array, texts: pa.Array, turns: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """One string per conversation, and how many of its bytes are assistant texts. ``turns`` has the bounds of each in ``roles`` and ``texts``.

    Headers (one per distinct role), the closing mark and the texts lie in one source buffer. Every turn is three segments of it;
    segment lengths add up to offsets in the output, and each output byte's source place is its own place shifted by its segment."""
    coded = pc.fill_null(roles, "unknown").dictionary_encode()
    head = [(HEAD + r + MIDDLE).encode() for r in coded.dictionary.to_pylist()] + [END.encode()]
    kind = coded.indices.to_numpy()
    raw, bounds = bytes_of(texts)
    source = np.concatenate([np.frombuffer(b"".join(head), np.uint8), raw])
    size = np.array([len(h) for h in head])
    at = np.cumsum(size) - size
    length = np.empty((len(kind), 3), np.int64)
    start = np.empty((len(kind), 3), np.int64)
    length[:, 0], start[:, 0] = size[kind], at[kind]
    length[:, 1], start[:, 1] = np.diff(bounds), size.sum() + bounds[:-1]
    length[:, 2], start[:, 2] = size[-1], at[-1]
    length, start = length.ravel(), start.ravel()
    ends = np.concatenate([[0], np.cumsum(length)])
    out = pa.allocate_buffer(int(ends[-1]), resizable=False)
    view = np.frombuffer(out, np.uint8)
    i = 0
    while i < len(length):  # the index of a piece of the output at a time
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + _PIECE, "right")) - 1)
        place = np.arange(ends[i], ends[j]) + np.repeat(start[i:j] - ends[i:j], length[i:j])
        np.take(source, place, out=view[ends[i] : ends[j]])
        i = j
    offsets = ends[turns * 3].astype(np.int64)
    told = pc.equal(coded.dictionary, "assistant").to_numpy(False)
    spoken = np.concatenate([[0], np.cumsum(np.where(told[kind] if len(told) else np.zeros(0, bool), np.diff(bounds), 0))])
    return pa.LargeStringArray.from_buffers(len(turns) - 1, pa.py_buffer(offsets), out), spoken[turns[1:]] - spoken[turns[:-1]]


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        turns = lists.offsets.to_numpy().astype(np.int64)
        rows = lists.values.slice(turns[0], turns[-1] - turns[0])
        turns -= turns[0]
        size = np.concatenate([[0], np.cumsum(sum(pc.fill_null(pc.binary_length(rows.field(c)), 0).to_numpy().astype(np.int64) for c in ("role", "text")))])
        cuts = np.flatnonzero(np.diff(size[turns[1:]] // BATCH_BYTES)) + 1  # a batch of long texts doesn't fit into one string array
        for i, j in zip([0, *cuts], [*cuts, len(batch)]):
            own = rows.slice(turns[i], turns[j] - turns[i])
            text, spoken = assemble(own.field("role"), own.field("text"), turns[i : j + 1] - turns[i])
            n_bytes = pc.binary_length(text).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), text.cast(pa.string()), pa.array(np.diff(turns[i : j + 1])), n_bytes, pa.array(spoken)], ["conv_id", "formatted", "n_turns", "n_bytes", "assistant_bytes"])


def chats(conversations: DataFrame) -> DataFrame:
    """``(conv_id, formatted, n_turns, n_bytes, assistant_bytes)``: each conversation as one string of turns,
    ``<|im_start|>role``, a line break, the text, ``<|im_end|>`` and a line break.

    Turns go by (turn, role, text), nulls first, so ties and repeated rows have one order and all appear. A null role is ``unknown``,
    a null text empty; rows without conv_id form one conversation without an id. A conversation may have up to
    2 GB, the most that a string can. Other columns are not read. An empty table gives no rows."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")
    lists = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return lists.mapInArrow(_format, "conv_id long, formatted string, n_turns long, n_bytes long, assistant_bytes long")
