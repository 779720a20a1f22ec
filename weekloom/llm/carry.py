"""Rows that travel through Arrow as one struct, beside what is measured on them.

A row's columns keep their names, types and values, whatever these are; so a column of the input that has the name of a
measure, or of a column used on the way, does no harm.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ROW = "_row"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def row_of(names: list[str]) -> Column:
    """The columns ``names`` as one struct."""
    return F.struct(*[quoted(c) for c in names]) if names else F.struct(F.lit(None).cast("boolean").alias("_none"))


def measured(docs: DataFrame, text_col: str, fields: list[StructField], measure: Callable[[pa.Array, dict[str, pa.Array]], list[pa.Array]],
             keep: list[str] | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """``_row`` (the columns ``keep``, all by default) and the ``fields`` that ``measure`` makes of each batch of texts.

    ``more``: further columns that are handed to ``measure`` by name. The text is sent once, also if it is kept.
    """
    keep = docs.columns if keep is None else list(keep)
    more = more or {}
    inside = text_col in keep and isinstance(docs.schema[text_col].dataType, StringType)
    asked = docs.select(row_of(keep).alias(ROW), *([] if inside else [quoted(text_col).cast("string").alias("_text")]), *[c.alias(f"_{k}") for k, c in enumerate(more.values())])
    first, given = (1 if inside else 2), list(more)
    place = keep.index(text_col) if inside else None
    names = [ROW, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(place) if inside else batch.column(1)
            got = measure(texts, {name: batch.column(first + k) for k, name in enumerate(given)})
            yield pa.RecordBatch.from_arrays([batch.column(0), *got], names=names)

    return asked.mapInArrow(run, StructType([asked.schema[ROW], *fields]))


def opened(df: DataFrame, keep: list[str], measures: list[str]) -> DataFrame:
    """The kept columns and the measures side by side; a kept column with the name of a measure gives way to it."""
    taken = {m.lower() for m in measures}
    return df.select(*[F.col(ROW)[c].alias(c) for c in keep if c.lower() not in taken], *measures)
