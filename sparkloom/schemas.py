"""Table schemas of a store and of results."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()


def _struct(*cols: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in cols])


DOCUMENTS = _struct(("id", _S, False), ("path", _S, False), ("title", _S, False), ("source_type", _S, False), ("collection", _S, False), ("project", _S, True), ("layer", _S, True), ("tags", _S, True), ("char_count", _L, False), ("chunk_count", _I, False), ("added_at", T.TimestampType(), False))
CHUNKS = _struct(("chunk_id", _S, False), ("doc_id", _S, False), ("seq", _I, False), ("text", _S, False), ("n_terms", _I, False), ("embedding", T.ArrayType(T.FloatType()), True))
POSTINGS = _struct(("term", _S, False), ("chunk_id", _S, False), ("doc_id", _S, False), ("tf", _I, False), ("length", _I, False))
