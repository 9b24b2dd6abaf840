"""Embeddings of texts by hashed n-grams, and the interface of other providers."""

from __future__ import annotations

from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 64-bit FNV-1a hash.
_OFFSET, _PRIME, _M64 = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


class EmbeddingProvider(Protocol):
    """What turns texts into vectors. ``embed`` runs in the Python workers, a batch at a time."""

    name: str
    dimensions: int

    def embed(self, texts: pd.Series) -> pd.Series: ...


@lru_cache(1 << 18)
def fnv1a(data: bytes) -> int:
    h = _OFFSET
    for byte in data:
        h = ((h ^ byte) * _PRIME) & _M64
    return h


def word_features(word: str) -> list[tuple[bytes, float]]:
    """The word, the byte trigrams of the word between spaces, the byte bigrams of the word."""
    raw = word.encode()
    wide = b" " + raw + b" "
    out = [(raw, 2.0)]
    out += [(wide[i : i + 3], 1.0) for i in range(len(wide) - 2)]
    out += [(raw[i : i + 2], 0.5) for i in range(len(raw) - 1)]
    return out


class NgramProvider:
    """Deterministic vectors of unit length; the zero vector for a text without words."""

    def __init__(self, dimensions: int = 384):
        self.name, self.dimensions = f"ngram-{dimensions}", dimensions

    def vector(self, text: str | None) -> np.ndarray:
        v = np.zeros(self.dimensions, np.float32)
        for word in (text or "").lower().split():
            for feature, weight in word_features(word):
                v[fnv1a(feature) % self.dimensions] += weight
        norm = np.sqrt((v * v).sum())
        return v / norm if norm > 0 else v

    def embed(self, texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: self.vector(t).tolist())


class OnnxProvider:
    """A sentence model: tokens, forward pass, mean over the mask, unit length. The model is loaded once in each worker."""

    def __init__(self, model_path: str, tokenizer_path: str, name: str, dimensions: int = 384, max_tokens: int = 256):
        self.name, self.dimensions, self.max_tokens = name, dimensions, max_tokens
        self.model_path, self.tokenizer_path = model_path, tokenizer_path
        self._loaded = None

    def __getstate__(self):
        return {**self.__dict__, "_loaded": None}

    def _load(self):
        if self._loaded is None:
            import onnxruntime
            from tokenizers import Tokenizer

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            tokenizer = Tokenizer.from_file(self.tokenizer_path)
            tokenizer.enable_truncation(self.max_tokens)
            tokenizer.enable_padding()
            self._loaded = onnxruntime.InferenceSession(self.model_path, options), tokenizer
        return self._loaded

    def embed(self, texts: pd.Series) -> pd.Series:
        session, tokenizer = self._load()
        encoded = tokenizer.encode_batch([t or "" for t in texts])
        mask = np.array([e.attention_mask for e in encoded], np.int64)
        inputs = {"input_ids": np.array([e.ids for e in encoded], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
        hidden = session.run(None, {i.name: inputs[i.name] for i in session.get_inputs()})[0]
        mean = (hidden * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)[:, None]
        unit = mean / np.maximum(np.linalg.norm(mean, axis=1), 1e-12)[:, None]
        return pd.Series(list(unit.astype(np.float32).tolist()), index=texts.index)


# Short names of published models.
MODEL_ALIASES = {
    "minilm": "all-MiniLM-L6-v2",
    "mini": "all-MiniLM-L6-v2",
    "minilm-l6": "all-MiniLM-L6-v2",
    "bge": "bge-small-en-v1.5",
    "bge-small": "bge-small-en-v1.5",
}


def resolve_model(name: str) -> str:
    return MODEL_ALIASES.get(name.lower(), name)


def embed(text: Column | str, provider: EmbeddingProvider) -> Column:
    """The vectors of a text column."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return provider.embed(texts)

    return run(text)


def _fnv_bucket(raw: Column, dimensions: int) -> Column:
    """FNV-1a modulo ``dimensions`` in two limbs of 32 bits, so that nothing overflows."""
    low, mask = F.lit(0xFFFFFFFF).cast("bigint"), F.lit(0xFFFFFFFF).cast("bigint")
    prime_low = 0x1B3

    def step(h: Column, byte: Column) -> Column:
        x = h.lo.bitwiseXOR(byte)
        wide = x * prime_low
        return F.struct(
            (h.hi * prime_low + F.shiftright(wide, 32) + x * 256).bitwiseAND(mask).alias("hi"),
            wide.bitwiseAND(low).alias("lo"),
        )

    start = F.struct(F.lit(_OFFSET >> 32).cast("bigint").alias("hi"), F.lit(_OFFSET & 0xFFFFFFFF).cast("bigint").alias("lo"))
    d = F.lit(dimensions).cast("bigint")
    return F.aggregate(raw, start, step, lambda h: ((h.hi % d) * ((1 << 32) % dimensions) + h.lo % d) % d)


def _byte_array(raw: Column) -> Column:
    """The bytes of a binary column as numbers."""
    digits = F.hex(raw)
    n = F.octet_length(raw)
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"))
    )


def sparse_features(df: DataFrame, key: str, text: str, dimensions: int = 384) -> DataFrame:
    """(key, idx, weight): the n-gram features before scaling, by built-in expressions only."""
    from echolith.functions.text import tokens

    words = df.select(key, F.explode(tokens(F.lower(F.col(text)))).alias("w"))
    raw = words.select(key, _byte_array(F.col("w").cast("binary")).alias("b"))
    wide = F.concat(F.array(F.lit(32).cast("bigint")), F.col("b"), F.array(F.lit(32).cast("bigint")))
    windows = lambda col, n: F.transform(F.sequence(F.lit(1), F.size(col) - (n - 1)), lambda i: F.slice(col, i, n))
    feature = lambda arr, weight: F.struct(arr.alias("f"), F.lit(weight).alias("weight"))
    features = F.concat(
        F.array(feature(F.col("b"), 2.0)),
        F.transform(windows(wide, 3), lambda a: feature(a, 1.0)),
        F.when(F.size("b") >= 2, F.transform(windows(F.col("b"), 2), lambda a: feature(a, 0.5))).otherwise(F.array().cast("array<struct<f:array<bigint>,weight:double>>")),
    )
    return (
        raw.select(key, F.explode(features).alias("x")).select(key, _fnv_bucket(F.col("x.f"), dimensions).alias("idx"), F.col("x.weight").alias("weight"))
        .groupBy(key, "idx").agg(F.sum("weight").alias("weight"))
    )
