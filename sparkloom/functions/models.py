"""Embedders: a strategy object, so that any model can be plugged in, and a deterministic one that needs no files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KNOWN_DIMS = {"small": 384, "base": 768, "large": 1024, "hashed": 64}


def embedding_dim(model: str) -> int:
    """Dimension of a known model; an unknown one is an error, not a guess."""
    if model not in KNOWN_DIMS:
        raise ValueError(f"unknown embedding model {model!r}")
    return KNOWN_DIMS[model]


@dataclass(frozen=True)
class HashedEmbedder:
    """Signed feature hashing of lower-case words, L2-normalised: no model file, equal everywhere."""

    dim: int = 64
    batch: int = 64

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def query(self, text: str) -> list[float]:
        return [float(x) for x in self.encode([text])[0]]


@dataclass
class OnnxEmbedder:
    """A sentence model in ONNX with inputs input_ids and attention_mask: its token vectors are averaged under the mask and
    normalised. tokenizer: the path of its tokenizers JSON file. The session is made once a worker."""

    path: str
    tokenizer: str
    most_tokens: int = 512
    batch: int = 64

    def _loaded(self):
        if self.path not in _SESSIONS:
            import onnxruntime
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(self.tokenizer)
            own.enable_truncation(self.most_tokens)
            own.enable_padding()
            _SESSIONS[self.path] = onnxruntime.InferenceSession(self.path, providers=["CPUExecutionProvider"]), own
        return _SESSIONS[self.path]

    def encode(self, texts: list[str]) -> np.ndarray:
        session, tokenizer = self._loaded()
        own = tokenizer.encode_batch([t or "" for t in texts])
        ids, mask = (np.array([getattr(e, f) for e in own], np.int64) for f in ("ids", "attention_mask"))
        given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        return mean_pooled(session.run(None, {i.name: given[i.name] for i in session.get_inputs()})[0], mask)

    def query(self, text: str) -> list[float]:
        return [float(x) for x in self.encode([text])[0]]


_SESSIONS: dict = {}


def mean_pooled(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token vectors that the mask keeps, L2-normalised; of none it is zero."""
    m = mask[:, :, None].astype(np.float32)
    out = (tokens * m).sum(1) / np.maximum(m.sum(1), 1e-9)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def resolve_backend(model: str, backend: str = "auto") -> str:
    return ("onnx" if model.endswith(".onnx") else "hashed") if backend == "auto" else backend


def embedder_for(model: str = "hashed", backend: str = "auto"):
    """The embedder that settings name. An ONNX model's tokenizer lies beside it as tokenizer.json."""
    if resolve_backend(model, backend) == "hashed":
        return HashedEmbedder(embedding_dim(model))
    return OnnxEmbedder(model, f"{model.rpartition('/')[0] or '.'}/tokenizer.json")


def warm_up(embedder) -> int:
    """Loads what the embedder needs, here; the dimension of its vectors."""
    return len(embedder.query("warm"))


def embed(c: Column | str, embedder) -> Column:
    """Vectors of a text column in Arrow batches; the embedder is set up once a worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = [embedder.encode(list(texts[i : i + embedder.batch])) for i in range(0, len(texts), embedder.batch)]
            yield pd.Series([r.tolist() for part in rows for r in part], index=texts.index)

    return run(F.col(c) if isinstance(c, str) else c)
