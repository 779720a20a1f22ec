"""Variable-capacity best-fit packing of documents into training sequences.

A document of more tokens than the largest permitted length is cut into pieces of that length and a rest. Pieces are
dealt by hash into shards of about ``shard_tokens`` tokens, and each shard is packed on its own, largest piece first: a
piece goes to the open bin it leaves least room in; if none holds it, a bin opens. At the end each bin shrinks to the
cheapest permitted length that holds its contents, so short leftovers cost a short sequence.

Lengths are chosen jointly. A sequence of c tokens costs ``cost(c)``: a fixed part for the sequence, a part for its tokens
and a part for attention, which grows with the square. So short sequences waste the fixed part and long ones attention.
A bin opens at the length of least cost a token among those that hold the piece and are at least a *floor*; each permitted
length in turn is tried as floor, the shard is packed and shrunk, and the packing of least total cost is kept (ties: the larger
floor). The largest length as floor is plain best-fit with one length and a final shrinking, so a packing is never dearer than
that. Only sizes travel, never texts; waste between shards is at most one partly filled bin of each length a shard.

Defined cases: the tokens of a document are its words and one end token, so a null or empty text has one; pieces are
told apart by row as well as by id, so repeated and null ids are packed like others; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from .bytesplit import Words, steps
from .carry import ROW, measured, quoted
from .scratch import staged

LENGTHS = (256, 512, 1024, 2048, 4096)


def sequence_cost(c: int) -> float:
    """The cost of a sequence of c tokens, in tokens: 192 for the sequence, 1 a token, and c / 4096 a token for attention."""
    return 192 + c + c * c / 4096


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = sequence_cost, floor: int = 0) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size (given largest first), and the final length of each bin, where bins open at ``floor`` at least."""
    lengths = tuple(sorted(lengths))
    largest = lengths[-1]
    opens = {c: min((x for x in lengths if x >= max(c, floor)), key=lambda x: (cost(x) / x, -x)) for c in lengths}
    by_room: list[list[int]] = [[] for _ in range(largest + 1)]
    rooms, used, bins, offsets = 0, [], [], []
    for size in sizes:
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b = len(used)
            room = opens[next(c for c in lengths if c >= size)]
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    final = [min((c for c in lengths if c >= u), key=lambda c: (cost(c), c)) for u in used]
    return bins, offsets, final


def cheapest_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = sequence_cost) -> tuple[list[int], list[int], list[int]]:
    """The best-fit packing of least total cost over all floors."""
    packings = [best_fit(sizes, lengths, cost, floor) for floor in sorted(lengths, reverse=True)]
    return min(packings, key=lambda x: sum(map(cost, x[2])))


def sizes_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row_key, n_tokens): words and one end token."""

    def count(texts: pa.Array, more: dict[str, pa.Array]) -> list[pa.Array]:
        n = [Words(data, off).counts for _, _, data, off in steps(texts)]
        return [pa.array(np.concatenate([*n, np.zeros(0, np.int64)]) + 1, pa.int64())]

    own = docs.select(quoted(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row_key"), quoted(text_col).alias("text"))
    return measured(own, "text", [StructField("n_tokens", LongType())], count, ["id", "row_key"]).select(f"{ROW}.*", "n_tokens")


def packed(sizes: DataFrame, lengths: tuple[int, ...] = LENGTHS, shard_tokens: int = 4_000_000, cost: Callable[[int], float] = sequence_cost) -> DataFrame:
    """From (id, row_key, n_tokens): id, piece, start, n_tokens, bin_id, bin_length, bin_offset."""
    largest = max(lengths)
    sizes = staged(sizes, "sizes")
    n_shards = int(-(-(sizes.agg(F.sum("n_tokens")).first()[0] or 0) // shard_tokens)) or 1
    pieces = sizes.filter("n_tokens > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / largest))))
    pieces = pieces.select(F.col("id").cast("string").alias("id"), "row_key", "piece", (F.col("piece") * largest).alias("start"), F.least(F.lit(largest).cast("long"), F.col("n_tokens") - F.col("piece") * largest).alias("size"), F.pmod(F.xxhash64("id", "row_key", "piece"), F.lit(n_shards)).alias("shard"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "row_key", "piece"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, final = cheapest_fit(pdf["size"].tolist(), lengths, cost)
        return pd.DataFrame({
            "id": pdf["id"], "piece": pdf["piece"], "start": pdf["start"], "n_tokens": pdf["size"],
            "bin_id": [f"{s}-{b}" for s, b in zip(pdf["shard"], bins, strict=True)], "bin_length": [final[b] for b in bins], "bin_offset": offsets,
        })

    out = pieces.groupBy("shard").applyInPandas(pack, "id string, piece long, start long, n_tokens long, bin_id string, bin_length long, bin_offset long")
    return out.withColumn("id", F.col("id").cast("long"))  # a string meanwhile: pandas would turn ids beside a null into floats


def packing_query(spark, sf_dir: str) -> DataFrame:
    return packing_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def packing_stage(spark, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """One row per piece of a document: where it lies in which sequence."""
    return packed(sizes_of(docs, "doc_id", "text")).withColumnRenamed("id", "doc_id")
