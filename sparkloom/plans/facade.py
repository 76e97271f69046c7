"""The front door: one object with the whole surface, and a tool layer that answers in JSON."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings, load_settings
from ..functions.models import embedder_for
from ..operators import catalog
from ..operators.fusion import search as hybrid
from ..sources.files import fetch_urls, load_path
from .prompt import answer, stream_answer
from .store import Store, as_json, ingest


class Memory:
    def __init__(self, spark: SparkSession, settings: Settings | None = None, embedder=None):
        self.spark, self.settings = spark, settings or load_settings()
        self.store, self.embedder = Store(spark, self.settings.storage.resolved(), self.settings.storage.buckets), embedder or embedder_for(self.settings.embeddings.model, self.settings.embeddings.backend)

    def __enter__(self) -> Memory:
        return self

    def __exit__(self, *_) -> None:
        """The session belongs to the caller; nothing is held open."""

    def add(self, *sources: str, **options) -> DataFrame:
        """Files, folders and URLs; a status row for each document."""
        urls = [s for s in sources if re.match("(?i)https?:", s)]
        paths = [s if re.match("[a-z][a-z0-9+.-]*:/", s) else os.path.abspath(os.path.expanduser(s)) for s in sources if s not in urls]
        parts = [load_path(self.spark, p) for p in paths]
        if urls:
            parts.append(fetch_urls(self.spark.createDataFrame([(u,) for u in urls], "url string")))
        if not parts:
            raise ValueError("no sources")
        parsed = parts[0]
        for p in parts[1:]:
            parsed = parsed.unionByName(p)
        return ingest(self.store, parsed, self.settings, self.embedder, **options)

    def add_frame(self, parsed: DataFrame, **options) -> DataFrame:
        """Rows of (path, text) from anywhere in Spark."""
        return ingest(self.store, parsed, self.settings, self.embedder, **options)

    def search(self, question: str, top_k: int = 0, *, collection: str | None = None, project: str | None = None, layer: str | None = None, **options) -> DataFrame:
        """text, title, path, chunk, score of the best chunks."""
        chunks, documents = self.store.chunks(), self.store.documents()
        only = None
        if collection or project or layer:
            own = documents.filter(catalog.matches(collection=collection, project=project, layer=layer)).select(F.col("id").alias("doc_id"))
            only = chunks.join(own, "doc_id", "left_semi").select("chunk_id")
        hits = hybrid(chunks, self.embedder.query(question), question, top_k=top_k or self.settings.chunking.top_k, only=only, index=self.store.index(), **options)
        texts = chunks.join(F.broadcast(hits), "chunk_id")  # top_k rows
        full = texts.join(documents.select(F.col("id").alias("doc_id"), "title", "path"), "doc_id")
        return full.orderBy(F.desc("score"), F.col("vector_rank").asc_nulls_last(), "keyword_rank", "chunk_id").select("text", "title", "path", F.col("seq").alias("chunk"), "score")

    def ask(self, question: str, top_k: int = 0, history: list[dict] | None = None, **filters) -> dict:
        """The answer and its sources, best first, each path once."""
        hits = [r.asDict() for r in self.search(question, top_k, **filters).collect()]
        sources = list({h["path"]: {"title": h["title"], "path": h["path"]} for h in reversed(hits)}.values())[::-1]
        return {"answer": answer(question, hits, self.settings.inference.backend, history), "sources": sources}

    def stream(self, question: str, top_k: int = 0, history: list[dict] | None = None, **filters) -> Iterator[str]:
        yield from stream_answer(question, [r.asDict() for r in self.search(question, top_k, **filters).collect()], self.settings.inference.backend, history)

    def chat(self) -> Callable[[str], str]:
        """A conversation: each call retrieves by its own question and passes on all that was said."""
        history: list[dict] = []

        def say(question: str) -> str:
            said = self.ask(question, history=history)["answer"]
            history.extend([{"role": "user", "content": question}, {"role": "assistant", "content": said}])
            return said

        return say

    def list(self, **filters) -> DataFrame:
        return catalog.list_documents(self.store.documents(), **filters)

    def collections(self) -> list[str]:
        return [r.collection for r in catalog.collections(self.store.documents()).collect()]

    def stats(self) -> dict:
        own = catalog.store_stats(self.store.documents(), self.store.chunks()).first().asDict()
        return own | {"size_mb": self.store.size_mb(), "path": self.store.path}

    def config(self) -> dict:
        """The settings in force; a key isn't shown."""
        own = asdict(self.settings)
        own["inference"]["api_key"] = "set" if self.settings.inference.key() else None
        return own

    def forget(self, query: str, collection: str | None = None, fuzzy: bool = True) -> str | None:
        return self.store.forget(query, collection, fuzzy)


def _enveloped(f: Callable) -> Callable[..., str]:
    @wraps(f)
    def run(*args, **kwargs) -> str:
        try:
            return as_json(f(*args, **kwargs))
        except Exception as e:
            return as_json({"error": f"{type(e).__name__}: {e}"})

    return run


class Tools:
    """The same surface as JSON strings, errors as {"error": ...}."""

    def __init__(self, memory: Memory):
        m = memory
        rows = lambda df: [r.asDict() for r in df.collect()]
        self.add = _enveloped(lambda *s, **o: rows(m.add(*s, **o)))
        self.search = _enveloped(lambda q, top_k=5, **o: rows(m.search(q, top_k, **o)))
        self.ask = _enveloped(lambda q, top_k=5, **o: m.ask(q, top_k, **o))
        self.list = _enveloped(lambda **o: rows(m.list(**o)))
        self.stats = _enveloped(m.stats)
        self.collections = _enveloped(m.collections)
        self.forget = _enveloped(lambda q, collection=None: {"forgotten": m.forget(q, collection)})
