"""Segments: blocks of whole texts, written once, that exchange hashes with the rest of the corpus.

Several operators ask of every word window "does it occur elsewhere?". One shuffled row per window would move many
times the input. Here a segment holds some megabytes of whole texts, sends each *distinct* hash once to the bucket
that owns it (packed, a few bytes each), and gets a packed answer back. So a hash that stands in a third of all rows
costs one entry per segment, a bucket holds an even share of the distinct hashes, and a row needs no key of its own:
repeated, null or clashing ids do no harm.

Buckets and partitions follow the bytes of text, not a setting: a bucket owns the hashes of about ``BUCKET_BYTES`` of text
however large the corpus, and both buckets and segments are dealt to partitions by number, so no task gets several by chance.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesplit import LOWER, steps
from .carry import quoted
from .scratch import staged

SCHEMA = "seg long, n_bytes long, ids binary, nulls binary, lens binary, z binary"
#: Stands for a null id: after all others.
NO_ID = np.iinfo(np.int64).max
#: Bytes of text whose distinct hashes are one bucket.
BUCKET_BYTES = 8 << 20
#: Segments of a partition when they are brought together with answers.
SEGMENTS_PER_PART = 2
#: Beyond so many partitions, a partition takes several buckets (one after the other) or more segments.
MOST_PARTS = 1 << 15
_OWN = 30  # bits of a segment's number within its task


class Layout:
    """How many buckets and partitions a staged table of segments takes."""

    def __init__(self, segs: DataFrame):
        own = F.col("seg").bitwiseAND((1 << _OWN) - 1)
        n, size, most = segs.agg(F.count("seg"), F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.max(own), F.lit(0))).first()
        self.buckets = max(1, -(-int(size) // BUCKET_BYTES))
        self.bucket_parts = min(self.buckets, MOST_PARTS)
        self.seg_parts = max(1, min(-(-int(n) // SEGMENTS_PER_PART), MOST_PARTS))
        self.stride = int(most) + 1

    def by_bucket(self, sent: DataFrame):
        """Rows with a ``bucket``, grouped by it, one bucket or a few in a partition."""
        dealt = sent.withColumn("part", F.pmod(F.col("bucket"), F.lit(self.bucket_parts)))
        return dealt.repartitionById(self.bucket_parts, "part").groupBy("part", "bucket")

    def by_segment(self, rows: DataFrame):
        """Rows with a ``seg``, grouped by it; the segments of a task go to neighbouring partitions."""
        number = F.shiftright("seg", _OWN) * F.lit(self.stride) + F.col("seg").bitwiseAND((1 << _OWN) - 1)
        dealt = rows.withColumn("part", F.pmod(number, F.lit(self.seg_parts)).cast("int"))
        return dealt.repartitionById(self.seg_parts, "part").groupBy("part", "seg")


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lower: bool = False, name: str = "segments") -> DataFrame:
    """A staged table of segments: ids, byte lengths and the compressed texts. Null texts count as empty."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = (TaskContext.get().partitionId() << _OWN) - 1
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, off in steps(batch.column(1)):
                seg += 1
                own = ids.slice(a, b - a)
                no_id = np.asarray(own.is_null())
                known = own.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
                data = LOWER[data] if lower else data
                yield pa.RecordBatch.from_pydict({
                    "seg": pa.array([seg], pa.int64()), "n_bytes": pa.array([len(data)], pa.int64()),
                    "ids": [known.tobytes()], "nulls": [no_id.tobytes()],
                    "lens": [np.diff(off).astype(np.int64).tobytes()],
                    "z": [squeeze.compress(np.ascontiguousarray(data).tobytes())],
                })

    return staged(docs.select(quoted(id_col).cast("long").alias("i"), quoted(text_col).cast("string").alias("t")).mapInArrow(pack, SCHEMA), name)


class Segment:
    """One row of ``segments``, unpacked."""

    def __init__(self, row: dict):
        self.seg = row["seg"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], bool)
        self.off = np.concatenate([[0], np.cumsum(np.frombuffer(row["lens"], np.int64))]).astype(np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["z"], max_output_size=int(self.off[-1]) + 1) if self.off[-1] else b"", np.uint8)

    def text(self, k: int) -> bytes:
        return self.data[self.off[k] : self.off[k + 1]].tobytes()

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.nulls)


def each(batches) -> Iterator[Segment]:
    """The segments of Arrow batches (or of a table), one at a time."""
    for batch in batches.to_batches() if isinstance(batches, pa.Table) else batches:
        for k in range(batch.num_rows):
            yield Segment(batch.slice(k, 1).to_pylist()[0])


def planes(x: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of unsigned 64-bit values, all first bytes first: what is mostly zero squeezes well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes, width: int) -> np.ndarray:
    flat = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :width] = flat.T
    return out.view("<u8").ravel()


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The owner of a hash, from its highest 20 bits; monotone in the hash, so sorted hashes are sorted by bucket."""
    return (((h >> np.uint64(44)) * np.uint64(buckets)) >> np.uint64(20)).astype(np.int64)


def cuts(h_sorted: np.ndarray, buckets: int) -> np.ndarray:
    """Offsets of the buckets within sorted hashes."""
    return np.searchsorted(bucket_of(h_sorted, buckets), np.arange(buckets + 1))
