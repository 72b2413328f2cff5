"""Overlapping chunks of documents, and halves of chunks whose answer could not be read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import spans
from ..functions.text import strip


def chunks(docs: DataFrame, id_column: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, chunk_no from 1, start, end, chunk_text, keep) of every document; blank chunks are left out, places are in the stripped text.

    `keep` names columns that each chunk keeps.
    """
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_column, *keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple] = []
            for row, value in enumerate(b.column(0).to_pylist()):
                whole, number = (value or "").strip(), 0
                for start, end in spans(whole):
                    if part := whole[start:end].strip():
                        number += 1
                        found.append((row, number, start, end, part))
            rows, *columns = zip(*found, strict=True) if found else [[]] * 5
            new = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int32())) for c in b.columns[1:]), *new], [id_column, *keep, "chunk_no", "start", "end", "chunk_text"])

    return docs.select(text, id_column, *keep).mapInArrow(run, f"{kept}, chunk_no int, start int, end int, chunk_text string")


def halves(chunk: Column, least: int = 2000, radius: int = 800, overlap: int = 100) -> Column:
    """array of the two overlapping halves of a chunk, cut at the line feed nearest before its middle, else after it; short chunks stay whole."""
    n = F.length(chunk)
    middle = F.floor(n / 2).cast("int")
    reach = F.least(F.lit(radius), middle)
    before = F.substring(chunk, middle - reach + 1, reach)
    after = F.substring(chunk, middle + 1, F.least(reach, n - middle))
    last = F.when(F.contains(before, F.lit("\n")), middle - reach + F.length(F.regexp_extract(before, r"(?s)^(.*)\n", 1)))
    first = F.nullif(F.locate("\n", after), F.lit(0)) + middle - 1
    cut = F.coalesce(last, first, middle)
    parts = F.array(strip(F.substring(chunk, F.lit(1), cut)), strip(F.substring(chunk, F.greatest(F.lit(0), cut - overlap) + 1, n)))
    return F.when(n < least, F.array(chunk)).otherwise(F.filter(parts, lambda p: p != ""))
