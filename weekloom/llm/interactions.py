"""Filter interaction audit: what each of several filters removes, in every order in which they can be applied.

Every document has a mask with a bit for each filter that it fails. Documents are counted by part and mask: these cells are
all that the audit needs, so whatever the corpus, a part has at most 2**filters of them. A recursive CTE then starts from
the empty prefix and extends prefixes by every letter that they don't have yet. It carries the bits applied so far, joins
the part's cells at each level, and each new row holds that step's own counts: of k filters, prefixes of one letter come
out of the first level, orders of all k letters out of the last. A prefix is computed once, for all the orders that begin
with it. Beyond the recursion, orders take the rows of their prefixes by an equi-join.

Texts are compared with the whole table by SHA-256. Rows are first counted by (id, text, part, mask) and then by text,
part, mask and labels with partial counts before each shuffle, so thousands of copies of one text are a few rows when
they meet, and no join has a text as its key. Labels are joined by id, which a hot id can skew: Spark may split that join.

Defined cases: a null text is empty; a null part is the empty string, and one with it; rows that share id and text count
one by one, and neither makes the other a copy ("smaller" is strict); a null id comes after all others and takes no label; a
document with several labels counts once, as good (toxic) if any of them says so; an empty table gives no rows; other
columns are not read.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .carry import quoted
from .scratch import staged

LETTERS = "ABCDE"
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Orders of more filters than this are too many to list.
MOST_FILTERS = 7


def failures(text: Column) -> dict[str, Column]:
    """Conditions A to D on one text: short, repetitive, shouting, symbols."""
    words = F.array_remove(F.split(text, BLANKS), "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _bits(conditions: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions.values())])


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """Groups (part, mask, good, toxic, n) of ``rows`` (id, digest, part, mask, good, toxic, n), the copies' masks with ``bit``.

    A copy has the digest of a row with a smaller id. Of a group that shares digest, part, mask and labels only the rows
    with the least id of all that share the digest are no copies.
    """
    own = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    groups = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(own).alias("least"))
    groups = groups.withColumn("first", F.min("least.id").over(W.partitionBy("digest")))
    first = F.when(F.col("first").isNull(), F.col("n")).when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    cells = F.array(F.struct(F.col("mask"), first.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - first).alias("n")))
    return groups.select("part", "good", "toxic", F.inline(cells)).filter("n > 0")


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask of the five filters, and those labelled good and toxic."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    part = F.coalesce(quoted(part_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    rows = docs.select(quoted(id_col).alias("id"), part.alias("part"), digest.alias("digest"), _bits(failures(text)).alias("mask"))
    rows = staged(rows.groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "masks")
    known = labels.groupBy(quoted(id_col).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    labelled = rows.filter("id is not null").join(known, "id", "left").unionByName(rows.filter("id is null"), allowMissingColumns=True)
    labelled = labelled.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    groups = with_copies(labelled, 1 << (len(LETTERS) - 1))
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return groups.groupBy("part", "mask").agg(F.sum("n").alias("n_docs"), count("good"), count("toxic")).withColumnRenamed("n_docs", "n")


def interactions(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order and step, from ``cells`` (part, mask, n, good, toxic); bit k of a mask is the k-th letter's.

    ``kept``, ``removed``, ``redundant`` (fails this filter, removed before), ``unique_fails`` (fails this filter only),
    ``good_lost``, ``toxic_lost`` (removed here), and ``shapley``: what the filter removes, summed over all orders.
    """
    if not 0 < len(set(letters)) == len(letters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} different letters are needed")
    spark, k = cells.sparkSession, len(letters)
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2**k a part
    total = lambda of, where: f"aggregate(c.cells, 0L, (a, x) -> a + if({where}, x.{of}, 0L))"
    fails, passed, before = "x.mask & f.bit <> 0", "x.mask & s.applied = 0", "x.mask & s.applied <> 0"
    levels = spark.sql(
        f"""
        WITH RECURSIVE filters(letter, bit) AS (VALUES {", ".join(f"('{x}', {1 << i})" for i, x in enumerate(letters))}),
        steps(part, filter_order, applied, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
            SELECT part, '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {{by_part}}
            UNION ALL
            SELECT s.part, concat(s.filter_order, f.letter), s.applied | f.bit, s.step + 1,
                {total("n", f"{passed} AND x.mask & f.bit = 0")}, {total("n", f"{passed} AND {fails}")}, {total("n", f"{before} AND {fails}")},
                {total("n", "x.mask = f.bit")}, {total("good", f"{passed} AND {fails}")}, {total("toxic", f"{passed} AND {fails}")}
            FROM steps s JOIN filters f ON s.applied & f.bit = 0 JOIN {{by_part}} c ON c.part = s.part
        )
        SELECT * FROM steps LIMIT ALL
        """,
        by_part=staged(by_part, "cells"),
    )
    levels = staged(levels.filter("step > 0"), "steps")
    orders = levels.filter(F.col("step") == k).select("part", F.col("filter_order").alias("whole"))
    prefixes = orders.withColumn("filter_order", F.explode(F.array(*[F.substring("whole", 1, i + 1) for i in range(k)])))
    out = prefixes.join(levels, ["part", "filter_order"])
    letter = F.substring("filter_order", -1, 1)
    shapley = F.sum("removed").over(W.partitionBy("part", letter)).alias("shapley")
    return out.select(
        "part", F.col("whole").alias("filter_order"), "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley
    )


def interaction_query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return interactions(mask_cells(docs, labels))


INTERACTION_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM t),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (first_id < w.doc_id)::INT AS mask
      FROM w LEFT JOIN g ON g.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT '' AS filter_order, 0 AS applied, 0 AS bit, 0 AS step UNION ALL
      SELECT filter_order || letter, applied | o.bit, f.bit, step + 1 FROM o JOIN f ON (applied | o.bit) & f.bit = 0),
s AS (SELECT w.filter_order, p.step, p.bit, p.applied FROM o w JOIN o p ON w.step = 5 AND p.step > 0 AND p.filter_order = w.filter_order[1:p.step]),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (applied | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & applied <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
