"""Schemas of stored tables. Missing strings are empty, never null; vectors are arrays of float of one length."""

from pyspark.sql import types as T


def _s(**cols) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "v": T.ArrayType(T.FloatType(), False), "t": T.TimestampType()}
    return T.StructType([T.StructField(k, kinds[v], k != "id") for k, v in cols.items()])


NOTES = _s(id="s", source_file="s", heading="s", text="s", content_hash="s", session_id="s", project="s", tags="s", chunk_index="i", vector="v")
CODE = _s(id="s", source_file="s", repo_name="s", language="s", chunk_type="s", symbol_name="s", parent_symbol="s", signature="s", text="s", context_header="s", content_hash="s", start_line="i", end_line="i", chunk_index="i", vector="v")
FILE_INDEX = _s(source_file="s", content_hash="s")
REGISTRY = _s(session_id="s", cwd="s", started_at="s", last_transcript_hash="s", markdown_path="s", status="s")
LEDGER = _s(ts="s", model="s", tokens="l", requests="l", cost="d")
SOURCES = _s(source_file="s", rel_path="s", repo_name="s", size="l", content="s", content_hash="s")
#: A chunk of source code before it is embedded.
CODE_CHUNKS = T.StructType([f for f in CODE if f.name in ("language", "chunk_type", "symbol_name", "parent_symbol", "signature", "text", "context_header", "start_line", "end_line", "chunk_index")])
DEFAULT_DIM = 384
