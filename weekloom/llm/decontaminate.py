"""Benchmark decontamination by a prefix-filtered join.

Every benchmark item is cut into windows of 13 consecutive words (a shorter item is one window). The words of a window
are ordered by rarity in the corpus; since containment must be exact, the prefix that two equal windows must share is
one word long: the window's rarest. A document word that is the prefix word of some window fixes, by the word's place in
the window, where the window would have to begin (positional bound) and end (length bound). What passes these bounds
is joined with the table of windows by the prefix word and all the words of the window, as text: a hit is verified word by word.

Documents are not shuffled, and the benchmark is not broadcast. Tasks get filters of a fixed number of bits (Bloom filters of the
prefix words, of their places and of the windows) and a table of 2**20 frequencies; a benchmark too large for them lets more
candidates through to the join, and none is lost. Frequencies are counted over all documents, for all words of the benchmark;
words that share one of the 2**20 places share their count, which can only change which word of a window is its prefix.

Defined cases: null texts have no words and no windows; an item_id that stands in several rows counts once; a benchmark
row with a null item_id has windows (they count as hits and contaminate) but no id to report; repeated and null document
ids do no harm, as rows are told apart by row. Measures take the place of kept columns of their names; the pipeline's
stage returns all columns as they came.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .bytesplit import LOWER, WORD_BYTES, Words, mixed, rolling, steps
from .carry import ROW, measured, opened, quoted
from .scratch import staged

WINDOW = 13
#: Places of the frequency table (as a power of two) and bits of each filter.
CELL_BITS, FILTER_BITS = 20, 1 << 22
PREFIX, PLACED, WHOLE = range(3)
_SPACED = bytes(b if WORD_BYTES[b] else 0x20 for b in LOWER.tolist())  # lower case, all that is not a word as a space


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _bits(kind: int, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash in the filter of its kind; the three filters lie one after the other."""
    two = mixed(h + np.uint64(kind + 1))
    low = np.uint64(size - 1)
    return (two & low).astype(np.int64) + kind * size, ((two >> np.uint64(32)) & low).astype(np.int64) + kind * size


def _has(bits: np.ndarray, kind: int, h: np.ndarray) -> np.ndarray:
    a, b = _bits(kind, h, len(bits) // 3)
    return bits[a] & bits[b]


def _placed(h: np.ndarray, n: np.ndarray | int, place: np.ndarray | int) -> np.ndarray:
    """A prefix word together with the window's length and its place in it."""
    return mixed(h ^ mixed(np.atleast_1d(np.asarray(n * 64 + place, np.uint64))))


def _word_list(raw: bytes) -> list[bytes]:
    return raw.translate(_SPACED).split()


def _batches(source: DataFrame, text_col: str) -> DataFrame:
    return source.select(quoted(text_col).cast("string").alias("t"))


def _benchmark_cells(benchmark: DataFrame, text_col: str) -> np.ndarray:
    """Which of the 2**20 places hold a word of the benchmark."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in steps(batch.column(0)):
                yield pa.RecordBatch.from_pydict({"cell": pa.array(np.unique(_cells(Words(LOWER[data], off, WORD_BYTES).hashes())), pa.int64())})

    used = np.zeros(1 << CELL_BITS, bool)
    used[[r["cell"] for r in _batches(benchmark, text_col).mapInArrow(cells, "cell long").distinct().collect()]] = True  # at most 2**20 rows
    return used


def _frequencies(docs: DataFrame, text_col: str, used: np.ndarray) -> np.ndarray:
    """How often words of each used place occur in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(used))  # 2**17 bytes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.unpackbits(sent.value).astype(bool)
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for _, _, data, off in steps(batch.column(0)):
                cell = _cells(Words(LOWER[data], off, WORD_BYTES).hashes())
                total += np.bincount(cell[own[cell]], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    out = np.zeros(1 << CELL_BITS, np.int64)
    if used.any():
        for r in _batches(docs, text_col).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most 2**20 rows
            out[r["cell"]] = r["n"]
    return out


def benchmark_windows(benchmark: DataFrame, frequency: np.ndarray, id_col: str, text_col: str, width: int = WINDOW) -> DataFrame:
    """(item, w, prefix, n, place, h_prefix, h_placed, h_whole): the windows of every row, with their prefix word and its place."""
    sent = benchmark.sparkSession.sparkContext.broadcast(frequency)  # 2**20 numbers

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            items, rows = batch.column(0).to_pylist(), []
            for a, b, data, off in steps(batch.column(1)):
                w = Words(LOWER[data], off, WORD_BYTES)
                h = w.hashes()
                for d in range(b - a):
                    words, mine = _word_list(data[off[d] : off[d + 1]].tobytes()), h[w.off[d] : w.off[d + 1]]
                    if not words:
                        continue
                    n = min(width, len(words))
                    at = np.arange(len(words) - n + 1)[:, None] + np.arange(n)
                    often = own[_cells(mine)][at]
                    rare = np.where(often == often.min(axis=1, keepdims=True), mine[at], np.uint64(2**64 - 1)).argmin(axis=1)
                    h_prefix = mine[at[:, 0] + rare]
                    h_placed, h_whole = _placed(h_prefix, n, rare), rolling(mine, n)
                    for k in range(len(at)):
                        rows.append((items[a + d], b" ".join(words[k : k + n]).decode(), words[k + rare[k]].decode(), n, int(rare[k]), *(int(x[k].view(np.int64)) for x in (h_prefix, h_placed, h_whole))))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["item", "w", "prefix", "n", "place", "h_prefix", "h_placed", "h_whole"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    asked = benchmark.select(quoted(id_col).cast("string").alias("i"), quoted(text_col).cast("string").alias("t"))
    return asked.mapInArrow(cut, "item string, w string, prefix string, n int, place int, h_prefix long, h_placed long, h_whole long")


def _filters(windows: DataFrame, size: int) -> np.ndarray:
    """The three filters as packed bits; ``size``: bits of each, a power of two from 8 on."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [x for kind in (PREFIX, PLACED, WHOLE) for x in _bits(kind, batch.column(kind).to_numpy().view(np.uint64), size)]
            yield pa.RecordBatch.from_pydict({"bit": pa.array(np.unique(np.concatenate(some)), pa.int64())})

    out = np.zeros(3 * size, bool)
    found = windows.select("h_prefix", "h_placed", "h_whole").mapInArrow(bits, "bit long").distinct().toArrow()  # at most 3 * size numbers
    out[found["bit"].to_numpy()] = True
    return np.packbits(out)


_FOUND = StructField("_found", ArrayType(StructType([StructField("w", StringType()), StructField("prefix", StringType()), StructField("n", IntegerType()), StructField("starts", ArrayType(IntegerType()))])))
_FOUND_ARROW = pa.list_(pa.struct([("w", pa.string()), ("prefix", pa.string()), ("n", pa.int32()), ("starts", pa.list_(pa.int32()))]))


def _candidates(docs: DataFrame, text_col: str, keep: list[str], filters: np.ndarray, shapes: list[tuple[int, int]]) -> DataFrame:
    """_row, n_words and _found: the windows of each document that pass all bounds and filters, with their places."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)  # 3 * FILTER_BITS bits

    def probe(texts: pa.Array, more: dict) -> list[pa.Array]:
        bits = np.unpackbits(sent.value).astype(bool)
        counts, found = [np.zeros(0, np.int64)], []
        for a, b, data, off in steps(texts):
            w = Words(LOWER[data], off, WORD_BYTES)
            h, rolled = w.hashes(), {}
            counts.append(w.counts)
            at = np.flatnonzero(_has(bits, PREFIX, h))
            doc = np.searchsorted(w.off, at, "right") - 1
            low, high = w.off[doc], w.off[doc + 1]
            hits: dict[int, dict] = {}
            for n, place in shapes:
                start = at - place
                ok = np.flatnonzero((start >= low) & (start + n <= high))
                ok = ok[_has(bits, PLACED, _placed(h[at[ok]], n, place))]
                if len(ok):
                    if n not in rolled:
                        rolled[n] = rolling(h, n)
                    ok = ok[_has(bits, WHOLE, rolled[n][start[ok]])]
                for d, s in zip(doc[ok].tolist(), (start[ok] - low[ok]).tolist(), strict=True):
                    hits.setdefault(d, {}).setdefault((n, place), []).append(s)
            for d in range(b - a):
                own: dict[tuple, list] = {}
                if d in hits:
                    words = _word_list(data[off[d] : off[d + 1]].tobytes())
                    for (n, place), places in hits[d].items():
                        for s in places:
                            own.setdefault((b" ".join(words[s : s + n]), words[s + place], n), []).append(s)
                found.append([{"w": x.decode(), "prefix": p.decode(), "n": n, "starts": s} for (x, p, n), s in own.items()])
        return [pa.array(np.concatenate(counts), pa.int64()), pa.array(found, _FOUND_ARROW)]

    return measured(docs, text_col, [StructField("n_words", LongType()), _FOUND], probe, keep)


def _contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str, keep: list[str], item_id: str, item_text: str, filter_bits: int = FILTER_BITS) -> DataFrame:
    """_row, n_words, n_hit, hits, items and contaminated."""
    frequency = _frequencies(docs, text_col, _benchmark_cells(benchmark, item_text))
    windows = staged(benchmark_windows(benchmark, frequency, item_id, item_text), "windows")
    shapes = sorted((r["n"], r["place"]) for r in windows.select("n", "place").distinct().collect())  # at most 13 * 13
    own = staged(_candidates(docs, text_col, keep, _filters(windows, filter_bits), shapes).withColumn("_uid", F.monotonically_increasing_id()), "probed")
    probes = own.filter(F.size("_found") > 0).select("_uid", F.inline("_found"))
    real = staged(probes.join(windows.select("prefix", "w").distinct(), ["prefix", "w"]), "hits")
    ends = real.select("_uid", "n", F.explode("starts").alias("start")).groupBy("_uid").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("hits"))  # of one document
    covered = F.aggregate("hits", F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(F.greatest(a["to"], x["end"]).alias("to"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["to"], x["start"]))).alias("n")))["n"]
    named = real.select("_uid", "prefix", "w").join(windows.filter("item is not null").select("prefix", "w", "item").distinct(), ["prefix", "w"])
    named = named.groupBy("_uid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = staged(ends.join(named, "_uid", "left").select("_uid", covered.alias("n_hit"), "hits", "items"), "found")
    out = own.drop("_found").join(found, "_uid", "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "hits": F.coalesce("hits", F.array().cast(found.schema["hits"].dataType)), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """``keep`` columns (all by default), n_words, n_hit, hits (word ranges of all occurrences), items (ids as strings, sorted) and contaminated."""
    keep = docs.columns if keep is None else keep
    return opened(_contaminated(docs, benchmark, text_col, keep, item_id, item_text, filter_bits), keep, ["n_words", "n_hit", "hits", "items", "contaminated"])


def decontaminate_query(spark, sf_dir: str) -> DataFrame:
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = contamination(docs, bench, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
DECONTAMINATE_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p + 1:p + least(13, len(w))], ' ') AS t
       FROM (SELECT *, unnest(range(len(w) - least(13, len(w)) + 1)) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, unnest(range(len(w) - n + 1)) AS p, w FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
h AS (SELECT doc_id, item_id, p, x.n FROM (SELECT doc_id, n, p, array_to_string(w[p + 1:p + n], ' ') AS t FROM dw) x JOIN bw USING (n, t)),
c AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't contaminated."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _contaminated(docs, bench, "text", docs.columns, "item_id", "text").filter("not contaminated").select(f"{ROW}.*")
