"""Filters, lookups and statistics over a store's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower


def matches(*, collection: str | None = None, project: str | None = None, layer: str | None = None, tags: str | None = None, tag_mode: str = "exact") -> Column:
    """One predicate over documents; None and '' don't filter. tag_mode exact compares whole tags, substring any part."""
    out = F.lit(True)
    for name, value in (("collection", collection), ("project", project), ("layer", layer)):
        if value:
            out = out & (F.col(name) == value)
    if tags:
        own = F.array_contains(F.split("tags", r"\s*,\s*"), tags) if tag_mode == "exact" else F.contains(ascii_lower("tags"), ascii_lower(F.lit(tags)))
        out = out & own
    return out


def list_documents(documents: DataFrame, **filters) -> DataFrame:
    return documents.filter(matches(**filters)).orderBy(F.desc("added_at"), "id")


def find_document(documents: DataFrame, query: str, **filters) -> DataFrame:
    """The newest document whose path or title holds query, ASCII case aside: one row at most."""
    q = ascii_lower(F.lit(query))
    hit = F.contains(ascii_lower("path"), q) | F.contains(ascii_lower("title"), q)
    return documents.filter(hit & matches(**filters)).orderBy(F.desc("added_at"), "id").limit(1)


def collections(documents: DataFrame) -> DataFrame:
    return documents.select("collection").distinct().orderBy("collection")


def store_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    own = documents.agg(F.count("*").alias("documents"), F.count_distinct("collection").alias("collections"))
    return own.withColumn("chunks", F.lit(chunks.count()))


def first_per_path(hits: DataFrame, *order) -> DataFrame:
    """The best-ranked hit of each path."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(*order))).filter("_n = 1").drop("_n")


def titles(hits: DataFrame) -> DataFrame:
    """The titles among hits, each once."""
    return hits.select("title").distinct()


def term_matches(texts: DataFrame, words: list[str], *, key: str = "path") -> DataFrame:
    """key and the words (ASCII case aside, as given and in that order) that its text holds as substrings."""
    held = lambda t: F.filter(F.array(*[F.when(F.contains(t, F.lit(w.lower())), F.lit(w)) for w in words]), lambda x: x.isNotNull())
    found = F.explode(F.transform(F.array(ascii_lower("text")), held))  # one row each; the folded text is made once
    return texts.select(key, found.alias("words")).filter(F.size("words") > 0)


def upsert(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """existing without the rows of new's keys, and new."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return existing.join(keys.select(key).distinct(), key, "left_anti")


def migrate(documents: DataFrame) -> DataFrame:
    """Documents of an older layout with the metadata columns added."""
    for name in ("collection", "project", "layer", "tags"):
        if name not in documents.columns:
            documents = documents.withColumn(name, F.lit(None).cast("string"))
    return documents.withColumn("collection", F.coalesce("collection", F.lit("default")))
