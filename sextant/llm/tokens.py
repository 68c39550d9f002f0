"""Token counts by a linear longest-match automaton over a word-piece vocabulary."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.sample import bytes_of
from sextant.llm.words import rows_reduce, split_words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"


def read_pieces(path: str) -> list[str]:
    """The text pieces of a sentence-piece model; its control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Automaton:
    """Greedy longest match of words against pieces: those with ``mark`` begin a word, the others continue it.

    A trie node whose string is a piece pops it and fails to the root of continuing pieces. Any other node fails to where its string's
    longest-match pieces lead, and ``popped`` counts these; -1 means that no such pieces exist. So each
    character is read once, and a word's count is the sum of what its failures pop."""

    def __init__(self, pieces: list[str], mark: str = MARK):
        self.mark = mark
        step: list[dict[int, int]] = [{}, {}]  # node 0: root of beginnings, 1: of continuations
        final = {}
        for piece in pieces:
            if not piece:
                continue
            node = 0 if piece.startswith(mark) else 1
            if mark in piece[1:] or (node and mark in piece):
                continue  # spans words
            for ch in map(ord, piece):
                if ch not in step[node]:
                    step[node][ch] = len(step)
                    step.append({})
                node = step[node][ch]
            final[node] = True
        fail, popped = np.full(len(step), -1, np.int64), np.zeros(len(step), np.int64)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for ch, v in step[u].items():
                if v in final:
                    fail[v], popped[v] = 1, 1
                else:
                    z, n = int(fail[u]), int(popped[u])
                    while z >= 0 and ch not in step[z]:
                        n += int(popped[z])
                        z = int(fail[z])
                    if z >= 0:
                        fail[v], popped[v] = step[z][ch], n
                queue.append(v)
        self.fail, self.popped = fail, popped
        edges = [(u << 21 | ch, v) for u, to in enumerate(step) for ch, v in to.items()]
        self.bits = max(4, (2 * len(edges)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        slots = self._slot(np.array([k for k, _ in edges], np.int64)).tolist()
        for (key, v), at in zip(edges, slots):
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.values[at] = key, v

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _go(self, state: np.ndarray, ch: np.ndarray) -> np.ndarray:
        key = state << 21 | ch
        at = self._slot(key)
        out = np.full(len(key), -1, np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            held = self.keys[at[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def counts(self, words: pa.Array) -> np.ndarray:
        """Pieces of each word; -1 for a word that pieces can't spell. All words advance by a character at a time."""
        raw, bounds = bytes_of(words)
        lead = (raw & 0xC0) != 0x80
        place = np.concatenate([[0], np.cumsum(lead)])[bounds]
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.diff(place)
        order = np.argsort(-size, kind="stable")
        start, size = place[:-1][order], size[order]
        state = self._go(np.zeros(len(size), np.int64), np.full(len(size), ord(self.mark), np.int64)) if self.mark else np.zeros(len(size), np.int64)
        count = np.zeros(len(size), np.int64)
        live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        for t, n in enumerate(live):
            at = np.flatnonzero(state[:n] >= 0)
            ch = points[start[at] + t]
            while len(at):
                to = self._go(state[at], ch)
                ok = to >= 0
                state[at[ok]] = to[ok]
                at, ch = at[~ok], ch[~ok]
                count[at] += self.popped[state[at]]
                state[at] = self.fail[state[at]]
                ok = state[at] >= 0
                at, ch = at[ok], ch[ok]
        at = np.flatnonzero(state > 1)
        while len(at):
            count[at] += self.popped[state[at]]
            state[at] = self.fail[state[at]]
            at = at[state[at] > 1]
        out = np.empty(len(size), np.int64)
        out[order] = np.where(state == 1, count, -1)
        return out


def token_counts(docs: DataFrame, pieces: list[str] | None = None, vocabulary: str = VOCABULARY, mark: str = MARK) -> DataFrame:
    """``(doc_id, n_tokens, n_words, n_unknown)`` for every row, from its whole text.

    Words are maximal runs without white space. Each is cut greedily into the longest pieces of the vocabulary; a word that can't be is one
    unknown token. A null or blank text counts 0. Rows without an id and rows that repeat each count. Other columns are not read. An
    empty table gives no rows. The vocabulary is read once on the driver and broadcast; its size doesn't grow with the data."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(read_pieces(vocabulary) if pieces is None else pieces, mark))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, codes, bounds = split_words(batch.column(1), lower=False)
            n = shared.value.counts(words)[codes]
            columns = [rows_reduce(np.add, x, bounds, 0) for x in (np.where(n < 0, 1, n), (n < 0).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0]), pa.array(np.diff(bounds)), pa.array(columns[1])], ["doc_id", "n_tokens", "n_words", "n_unknown"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_tokens long, n_words long, n_unknown long")
