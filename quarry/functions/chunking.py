"""Sentence-aware chunkers: texts are cut in one pass, Arrow batch by batch; normalising stays in the JVM.

A fold in SQL would take each chunk from the text's start again, which is quadratic in its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

# Sentence ends in order of precedence, and how far back one is looked for.
MARKERS, BACK = (". ", "! ", "? ", "\n\n"), 100
# What text.strip takes off.
WHITE = " \t\n\x0b\f\r\xa0"
#: Texts that are cut at once for all sizes.
PART = 200


def spans(text: str, size: int, overlap: int, kind: str) -> list[tuple[int, int]]:
    """Where each chunk of a text begins and ends, before it is cleaned."""
    out, start, n = [], 0, len(text)
    while start + size < n:
        low, end = max(start, start + size - BACK), start + size
        found = [(m, text.rfind(m, low, end)) for m in MARKERS]
        if kind == "index":
            cut = next((at + len(m) for m, at in found if at >= 0), end)
        else:
            last = max(at for _, at in found)
            cut = last + 1 if last >= 0 else end
        out.append((start, cut))
        start = cut - overlap
    return [*out, (start, n)]


def cuts(text: str, size: int, overlap: int, kind: str) -> list[str]:
    """The chunks of a text, not yet cleaned."""
    return [text[low:high] for low, high in spans(text, size, overlap, kind)]


def _cutter(size: int, overlap: int, kind: str):
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else cuts(t, size, overlap, kind))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<string>")


def chunks(column: str, size: int, overlap: int, kind: str) -> Column:
    """kind "index": the first marker in order that occurs, cut after it. "sweep": the last of any, cut after its first character.

    A text of at most ``size`` is one chunk. "index" normalises each chunk (and a blank text is one
    empty chunk); "sweep" expects normalised text and has no chunk of a blank one.
    """
    if size < overlap + BACK:
        raise ValueError("chunk size must be at least the overlap and 100")
    folded = _cutter(size, overlap, kind)(F.col(column))
    cleaned = F.filter(F.transform(folded, T.strip), lambda x: x != "")
    text = F.col(column)
    if kind == "index":
        return F.when(F.length(text) <= size, F.array(T.normalize(text))).otherwise(F.transform(cleaned, T.normalize))
    return F.when(F.length(text) <= size, F.when(T.strip(text) == "", F.array().cast("array<string>")).otherwise(F.array(text))).otherwise(cleaned)


def chunk_table(docs: DataFrame, size: int, overlap: int, kind: str = "index", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """chunk_id, doc_id, chunk_index, chunk. Null texts have no chunk."""
    source = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), (F.col(text_col) if kind == "index" else T.normalize(F.col(text_col))).alias("t"))
    rows = source.select("doc_id", F.posexplode(chunks("t", size, overlap, kind)).alias("chunk_index", "chunk"))
    return rows.select(T.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "doc_id", "chunk_index", "chunk")


def sweep_table(docs: DataFrame, settings: list[tuple[int, int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """chunk_size, chunk_overlap, chunk_id, doc_id, chunk_index, chunk for every (size, overlap), each text read and normalised once."""
    if any(size < overlap + BACK for size, overlap in settings):
        raise ValueError("chunk size must be at least the overlap and 100")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):  # what is cut is several times as large
                part = batch.slice(at, PART)
                made = [[x for x in (c.strip(WHITE) for c in cuts(t, size, overlap, "sweep")) if x] for t in part.column(1).to_pylist() for size, overlap in settings]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), len(settings))))
                which = pa.array(np.tile(np.arange(len(settings), dtype=np.int32), part.num_rows))
                yield pa.RecordBatch.from_arrays([ids, which, pa.array(made, pa.list_(pa.string()))], ["doc_id", "which", "pieces"])

    source = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), T.normalize(F.col(text_col)).alias("t"))
    sizes = F.array(*[F.struct(F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap")) for size, overlap in settings])
    by_size = source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, which int, pieces array<string>")
    rows = by_size.select(F.get(sizes, F.col("which")).alias("s"), "doc_id", F.posexplode("pieces").alias("chunk_index", "chunk")).select("s.*", "doc_id", "chunk_index", "chunk")
    return rows.select("chunk_size", "chunk_overlap", T.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "doc_id", "chunk_index", "chunk")
