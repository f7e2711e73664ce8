"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The six ASCII white-space characters of the text contracts.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def bytes_words(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space, A-Z lower-cased; both byte methods are ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of a value's decimal text, modulo ``n``."""
    return F.crc32((F.col(col) if isinstance(col, str) else col).cast("string")) % n


def batches(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def map_arrow(df: DataFrame, fn, ddl: str) -> DataFrame:
    """``mapInArrow`` of a function from one record batch to an iterator of record batches."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                yield from fn(part)

    return df.mapInArrow(run, ddl)


def with_columns_replaced(df: DataFrame, **named: Column) -> DataFrame:
    """The columns of ``df``, in order, with the named ones computed anew."""
    return df.select(*[named[c].alias(c) if c in named else F.col(f"`{c}`") for c in df.columns])


def byte_alphabet() -> dict[str, str]:
    """From the printable characters that stand for bytes in byte-level vocabularies to the bytes, as Latin-1.

    Printable Latin-1 characters stand for themselves, the others follow from 256 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): chr(b) for b in printable} | {chr(256 + i): chr(b) for i, b in enumerate(rest)}
