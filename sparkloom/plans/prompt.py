"""Prompts from ranked chunks, as columns and for one question on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = "Answer from the context blocks alone, cite their titles, and say so where they hold no answer."
NO_CONTEXT = "No relevant context was found."


def context_blocks(hits: DataFrame, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """by, prompt: numbered blocks of each group's chunks in order of rank (1 first); groups hold top_k rows."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), "title", "text")))
    block = lambda s: F.concat(F.lit("--- Context "), s["rank"].cast("string"), F.lit(" ["), s["title"], F.lit("] ---\n"), s["text"])
    return hits.groupBy(by).agg(F.array_join(F.transform(rows, block), "\n\n").alias("prompt"))


def prompt_column(context: Column, question: Column) -> Column:
    return F.when(F.coalesce(context, F.lit("")) == "", F.concat(F.lit(f"{NO_CONTEXT}\n\nQuestion: "), question)).otherwise(F.concat(context, F.lit("\n\nQuestion: "), question))


def messages_column(prompt: Column, history: Column) -> Column:
    """system, then the history, then the prompt: an array of (role, content)."""
    one = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    return F.concat(one("system", F.lit(SYSTEM)), history, one("user", prompt))


def build_prompt(question: str, hits: list[dict]) -> str:
    blocks = [f"--- Context {i} [{h['title']}] ---\n{h['text']}" for i, h in enumerate(hits, 1)]
    return ("\n\n".join(blocks) or NO_CONTEXT) + f"\n\nQuestion: {question}"


def build_messages(question: str, hits: list[dict], history: list[dict] | None = None) -> list[dict]:
    return [{"role": "system", "content": SYSTEM}, *(history or []), {"role": "user", "content": build_prompt(question, hits)}]


def extractive(messages: list[dict]) -> Iterator[str]:
    """An answerer that needs no model: the first line of each context block, word by word."""
    for block in messages[-1]["content"].split("--- Context ")[1:]:
        body = block.split(" ---\n", 1)[1].split("\n\n", 1)[0]
        for w in body.split():
            yield w + " "


ANSWERERS: dict[str, Callable[[list[dict]], Iterator[str]]] = {"extractive": extractive}


def stream_answer(question: str, hits: list[dict], backend: str = "extractive", history: list[dict] | None = None) -> Iterator[str]:
    if backend not in ANSWERERS:
        raise ValueError(f"unknown inference backend {backend!r}")
    yield from ANSWERERS[backend](build_messages(question, hits, history))


def answer(question: str, hits: list[dict], backend: str = "extractive", history: list[dict] | None = None) -> str:
    return "".join(stream_answer(question, hits, backend, history)).strip()
