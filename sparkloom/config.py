"""Settings: frozen, validated, and read from the first TOML file found."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from .functions.text import check_window


@dataclass(frozen=True)
class Chunking:
    """tokenizer: path of a .tiktoken file to count tokens by; without one a token is a run of non-space."""

    size: int = 1024
    overlap: int = 128
    top_k: int = 5
    tokenizer: str = ""

    def __post_init__(self) -> None:
        check_window(self.size, self.overlap)
        if self.top_k <= 0:
            raise ValueError("top_k must be positive")


@dataclass(frozen=True)
class Embeddings:
    """model: hashed, or for backend onnx the path of a model file; auto is onnx for a path that ends in .onnx, else hashed."""

    model: str = "hashed"
    backend: str = "auto"

    def __post_init__(self) -> None:
        if self.backend not in ("auto", "onnx", "hashed"):
            raise ValueError(f"unknown embedding backend {self.backend!r}")


@dataclass(frozen=True)
class Inference:
    backend: str = "extractive"
    model: str = ""
    api_key: str | None = None

    def key(self) -> str | None:
        """The key set here, else the environment's."""
        return self.api_key or os.environ.get("SPARKLOOM_API_KEY")


@dataclass(frozen=True)
class Storage:
    """path: a folder that all executors share; buckets: how many parts of a new store an update is confined to one of."""

    path: str = "~/.sparkloom/memory"
    buckets: int = 64

    def resolved(self) -> str:
        return os.path.expanduser(self.path)


@dataclass(frozen=True)
class Settings:
    chunking: Chunking = field(default_factory=Chunking)
    embeddings: Embeddings = field(default_factory=Embeddings)
    inference: Inference = field(default_factory=Inference)
    storage: Storage = field(default_factory=Storage)


def settings_from(values: dict) -> Settings:
    parts = {}
    for f in fields(Settings):
        own = values.get(f.name, {})
        kind = type(f.default_factory())
        unknown = set(own) - {x.name for x in fields(kind)}
        if unknown:
            raise ValueError(f"unknown settings in {f.name}: {sorted(unknown)}")
        parts[f.name] = kind(**own)
    return Settings(**parts)


def load_settings(*paths: str | Path) -> Settings:
    """Of sparkloom.toml here and in ~/.sparkloom (or the paths given) the first that exists; files aren't merged."""
    for p in paths or ("sparkloom.toml", Path.home() / ".sparkloom" / "sparkloom.toml"):
        if Path(p).is_file():
            return settings_from(tomllib.loads(Path(p).read_text()))
    return Settings()
