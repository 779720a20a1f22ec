"""Line dedup over overlapping windows of three lines, with DataFrame functions only.

Lines are the pieces between line feeds; lines without a word (only tab to carriage return, and space) are passed over
when windows are formed and are never removed. Every three consecutive worded lines of a document are a window. The
first occurrence of a window stays; every line that any later occurrence covers is removed. Windows are judged on the
input, not on what is left.

Occurrences are ordered by (doc_id, key of the text, copy, line). So where rows share a doc_id, or have none, the row
whose text has the smaller 64-bit key counts as the earlier one, and of rows with the same doc_id and the same text one is
the first copy (by the order in which they were written to the shared folder), and every later copy loses all lines that
its windows cover.

Defined cases: null texts stay null; a text of fewer than three worded lines keeps all; a null doc_id comes after all
others. The measures n_lines and n_removed take the place of columns of these names; the pipeline's stage returns all
columns as they came.

Shuffles: windows travel as 128-bit hashes with a position, never as text; a window that stands in very many documents
is reduced by a map-side minimum, and the join that brings the minimum back is an equi-join Spark can split on skew.
The text moves once, keyed by document, with the sorted positions to remove. They are turned into one mask over the lines,
so the work on a text grows with its lines alone.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .carry import ROW, quoted, row_of
from .scratch import staged

#: Stands for a null id: after all others.
NO_ID = 2**63 - 1
WORDED = "[^\\x20\\x09-\\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _id_and_key(id_col: str, text: Column) -> list[Column]:
    return [F.coalesce(quoted(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_key")]


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(_id, _key, nth, h1, h2, lines): hashes of each window and the indexes of the lines it covers; nth counts from 0."""
    text = quoted(text_col).cast("string")
    d = docs.select(*_id_and_key(id_col, text), _lines(text).alias("_l")).filter(F.size("_l") >= width)
    line = lambda x, i: F.struct(i.alias("i"), F.when(x.rlike(WORDED), F.xxhash64(x)).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))
    d = d.select("_id", "_key", F.filter(F.transform("_l", line), lambda s: s["a"].isNotNull()).alias("_w")).filter(F.size("_w") >= width)
    # the same lines, shifted by one, two, ...: side by side they are the windows
    shifted = [F.slice("_w", j + 1, F.size("_w") - width + 1).alias(f"s{j}") for j in range(width)]
    d = d.select("_id", "_key", F.posexplode(F.arrays_zip(*shifted)).alias("nth", "_z"))
    part = lambda name: [F.col("_z")[f"s{j}"][name] for j in range(width)]
    return d.select("_id", "_key", "nth", F.xxhash64(*part("a")).alias("h1"), F.xxhash64(*part("b")).alias("h2"), F.array(*part("i")).alias("lines"))


def repeated_lines(windows: DataFrame) -> DataFrame:
    """(_id, _key, drop): the sorted line indexes covered by later occurrences, merged per document."""
    place = F.struct("_id", "_key", "nth")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("h1", "h2", "first")
    later = windows.join(first, ["h1", "h2"]).filter(place > F.col("first"))
    return later.select("_id", "_key", F.explode("lines").alias("i")).groupBy("_id", "_key").agg(F.sort_array(F.collect_set("i")).alias("drop"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row as a struct, its id and text key, and whether it is a later copy (none is, until copies are told apart)."""
    return docs.select(row_of(docs.columns).alias(ROW), *_id_and_key(id_col, quoted(text_col).cast("string")), F.lit(False).alias("_again"))


def _told_apart(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """``rows``, with ``_again`` for all but one of the rows that ``copies`` (_id, _key) names; only these are staged."""
    several = staged(rows.join(copies, ["_id", "_key"], "left_semi").withColumn("_n", F.monotonically_increasing_id()), "line-copies")
    one = several.groupBy("_id", "_key").agg(F.min("_n").alias("_first"))
    several = several.join(one, ["_id", "_key"]).withColumn("_again", F.col("_n") > F.col("_first"))
    columns = [ROW, "_id", "_key", "_again"]
    return rows.join(copies, ["_id", "_key"], "left_anti").select(*columns).unionByName(several.select(*columns))


def _mask(drop: Column, n: Column) -> Column:
    """n booleans, false at the sorted positions ``drop``."""
    before = lambda k: F.when(k > 0, F.get(drop, k - 1)).otherwise(-1)
    runs = F.transform(F.sequence(F.lit(0), F.size(drop) - 1), lambda k: F.concat(F.array_repeat(F.lit(True), F.get(drop, k) - before(k) - 1), F.array(F.lit(False))))
    return F.concat(F.flatten(runs), F.array_repeat(F.lit(True), n - F.element_at(drop, -1) - 1))


def _deduped(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """_row, _text (what is kept), n_lines and n_removed."""
    windows = staged(line_windows(docs, id_col, text_col, width), "line-windows")
    gone = repeated_lines(windows)
    rows = _rows(docs, id_col, text_col)
    copies = staged(windows.filter("nth = 0").groupBy("_id", "_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_id", "_key"), "copied-rows")
    if copies.limit(1).count():
        rows = _told_apart(rows, copies)
    both = rows.join(gone, ["_id", "_key"], "left")
    text = F.col(ROW)[text_col].cast("string")
    worded = F.transform(_lines(text), lambda x: ~x.rlike(WORDED))  # a later copy keeps only what no window covers
    mask = F.when(F.col("_again"), worded).when(F.col("drop").isNotNull(), _mask(F.col("drop"), F.size(_lines(text))))
    kept = F.transform(F.filter(F.arrays_zip(_lines(text).alias("x"), mask.alias("m")), lambda z: z["m"]), lambda z: z["x"])
    touched = F.col("_again") | F.col("drop").isNotNull()
    removed = F.when(F.col("_again"), F.size(F.filter(_lines(text), lambda x: x.rlike(WORDED)))).when(F.col("drop").isNotNull(), F.size("drop")).otherwise(0)
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(_lines(text)))
    return both.select(ROW, F.when(touched, F.array_join(kept, "\n")).otherwise(text).alias("_text"), n_lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with the text's repeated lines removed, and two more columns: n_lines and n_removed."""
    out = _deduped(docs, id_col, text_col, width)
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col(ROW)[c].alias(c) for c in names], "n_lines", "n_removed")


def line_dedup_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = without_repeated_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


LINE_DEDUP_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
w AS (SELECT doc_id, i AS i1, lead(i, 1) OVER o AS i2, lead(i, 2) OVER o AS i3, line AS l1, lead(line, 1) OVER o AS l2, lead(line, 2) OVER o AS l3
      FROM x WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, i1) AS nth FROM w WHERE i3 IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest([i1, i2, i3]) AS i FROM k WHERE nth > 1),
kept AS (SELECT x.doc_id, string_agg(x.line, chr(10) ORDER BY x.i) AS t FROM x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i WHERE g.i IS NULL GROUP BY x.doc_id),
n AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.l), 0)::BIGINT AS n_lines, coalesce(n.c, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def line_dedup_stage(spark, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """The documents with repeated lines removed; ``n_chars`` follows the text where the table has it."""
    out, kinds = _deduped(docs, "doc_id", "text", 3), {f.name: f.dataType for f in docs.schema}
    own = {"text": F.col("_text").cast(kinds["text"]).alias("text")}
    if "n_chars" in kinds:
        own["n_chars"] = F.length("_text").cast(kinds["n_chars"]).alias("n_chars")
    return out.select(*[own.get(c, F.col(ROW)[c].alias(c)) for c in docs.columns])
