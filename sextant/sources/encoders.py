"""Text encoders, pluggable; their sessions live in the Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS = 8192


class Encoder(Protocol):
    """Makes unit vectors of texts. Instances are sent to executors, so they open files in ``encode``, not before."""

    name: str
    revision: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Words hashed to places, for tests: it knows nothing of meaning."""

    def __init__(self, dim: int = 64):
        self.name, self.revision, self.dim = "hashing", "1", dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(sha256(word.encode()).digest()[:8], "big")
                row[h % self.dim] += 1 if h >> 63 else -1
        return unit(out)


class OnnxEncoder:
    """A transformer in ONNX with its tokenizer file: first-token pooling, unit length. Weights are not part of this repository."""

    def __init__(self, model: str, tokenizer: str, dim: int = 768, revision: str = "", max_tokens: int = MAX_TOKENS, provider: str = "CPUExecutionProvider"):
        self.name, self.revision, self.dim = model, revision, dim
        self.tokenizer, self.max_tokens, self.provider, self._open = tokenizer, max_tokens, provider, None

    def __getstate__(self):
        return self.__dict__ | {"_open": None}

    def encode(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.dim), np.float32)
        if self._open is None:
            import onnxruntime
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(self.tokenizer)
            t.enable_truncation(self.max_tokens)
            t.enable_padding()
            self._open = onnxruntime.InferenceSession(self.name, providers=[self.provider]), t
        session, t = self._open
        coded = t.encode_batch([x or "" for x in texts])
        feed = {"input_ids": np.array([c.ids for c in coded], np.int64), "attention_mask": np.array([c.attention_mask for c in coded], np.int64)}
        wanted = {i.name for i in session.get_inputs()}
        return unit(cls_pool(session.run(None, {k: v for k, v in feed.items() if k in wanted})[0]))


def cls_pool(hidden: np.ndarray) -> np.ndarray:
    return hidden[:, 0]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)).astype(np.float32)


def encoded(texts: DataFrame, encoder: Encoder, key: str = "passage_id", batch: int = 32) -> DataFrame:
    """``(key, vector)`` for every row of ``(key, text)``; a null text counts as empty."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(1).to_pylist()
            parts = [encoder.encode([x or "" for x in t[i : i + batch]]) for i in range(0, len(t), batch)]
            v = np.concatenate(parts) if parts else np.zeros((0, encoder.dim), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * encoder.dim), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], [key, "vector"])

    return texts.select(key, "text").mapInArrow(run, f"{key} {kind}, vector array<float>")


def encode_with(encoder: Encoder) -> Callable[[DataFrame], DataFrame]:
    """For ``apply_delta``."""
    return lambda texts: encoded(texts, encoder)


def query_table(spark, encoder: Encoder, questions: list[str], meta: dict | None = None) -> DataFrame:
    """``(query_id, question, vector)``; with a model's metadata, an encoder of another revision is refused."""
    if meta is not None and meta.get("encoder", {}).get("revision") not in (None, encoder.revision):
        raise ValueError(f"the model was built by revision {meta['encoder']['revision']}, not {encoder.revision}")
    rows = [(i, q, [float(x) for x in v]) for i, (q, v) in enumerate(zip(questions, encoder.encode(list(questions))))]
    return spark.createDataFrame(rows, "query_id long, question string, vector array<float>")


def check_dim(passages: DataFrame, dim: int) -> DataFrame:
    """``passages``, failing at run time on a vector of another size."""
    return passages.withColumn("vector", F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector is not of size {dim}"))))
