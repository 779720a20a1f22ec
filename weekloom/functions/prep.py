"""Column functions and row rules: normalising, parsing, cleaning, gaps, parity, data-quality rules.

Missing values are NULL throughout; nothing here collects or shuffles unless it says so.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Accented letters and their plain forms, and litres in a US gallon.
ACCENTED = "ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑáàâãäéèêëíìîïóòôõöúùûüçñ"
PLAIN = "AAAAAEEEEIIIIOOOOOUUUUCNaaaaaeeeeiiiiooooouuuucn"
LITRES_PER_GALLON = 3.785411784


def unaccented(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def normalize_label(c: Column) -> Column:
    """Trimmed, upper case, without accents."""
    return F.upper(unaccented(F.trim(c)))


def normalize_name(c: Column) -> Column:
    """Lower case without accents; every run of other characters than letters and digits is one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(unaccented(F.trim(c))), "[^a-z0-9]+", "_"), "^_|_$", "")


def canonical_product(c: Column, generic_as_s500: bool = False) -> Column:
    """'S500', 'S10' or NULL; S500 is tested first. A bare diesel counts as S500 on request."""
    label = normalize_label(c)
    out = F.when(label.rlike("S\\s*-?0*500"), "S500").when(label.rlike("S\\s*-?0*10(?![0-9])"), "S10")
    return out.when(label.rlike("DIESEL"), "S500") if generic_as_s500 else out


def parse_price(c: Column) -> Column:
    """A number from text such as 'R$ 1.234,56'; dots are thousands only if a comma is present. Else NULL."""
    bare = F.regexp_replace(F.trim(c), "(?i)R\\$|\\s", "")
    return F.when(bare.contains(","), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(bare).try_cast("double")


def filter_products(df: DataFrame, col: str, aliases: Sequence[str]) -> DataFrame:
    return df.filter(normalize_label(F.col(col)).isin(*[a.upper() for a in aliases]))


def clean_series(df: DataFrame, keys: Sequence[str], date: str, required: Sequence[str], positive: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Rows with all required values, one per key and date (the first by ``tie``), positive where asked. One shuffle on keys and date."""
    ok = df.dropna(subset=[date, *required])
    for c in positive:
        ok = ok.filter(F.col(c) > 0)
    first = W.partitionBy(*keys, date).orderBy(*(tie or required))
    return ok.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def flag_gap(df: DataFrame, date: str, start: str, end: str, out: str = "in_gap") -> DataFrame:
    return df.withColumn(out, F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def censor_after(df: DataFrame, date: str, col: str, cutoff: str) -> DataFrame:
    """NULL in ``col`` after its last valid date."""
    return df.withColumn(col, F.when(F.col(date) <= F.lit(cutoff).cast("date"), F.col(col)))


def date_window(df: DataFrame, date: str, start: str, end: str) -> DataFrame:
    return df.filter(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def drop_targets_in_gap(df: DataFrame, keys: Sequence[str], date: str, horizon: int, start: str, end: str) -> DataFrame:
    """Rows whose date ``horizon`` rows ahead doesn't fall into the closed gap."""
    ahead = F.lead(date, horizon).over(W.partitionBy(*keys).orderBy(date))
    kept = df.withColumn("_t", ahead).filter(F.col("_t").isNotNull() & ~F.col("_t").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return kept.drop("_t")


def column_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, share of non-null values): one pass, one row per column."""
    one = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("share")) for c in columns])).alias("x")).select("x.*")


def forward_fill(df: DataFrame, keys: Sequence[str], date: str, columns: Sequence[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def keep_covered_columns(df: DataFrame, keys: Sequence[str], date: str, columns: Sequence[str], min_share: float = 0.8) -> DataFrame:
    """Features covered above ``min_share``, forward filled. The number of columns bounds what the driver reads."""
    shares = {r["column"]: r["share"] for r in column_coverage(df, columns).collect()}
    kept = [c for c in columns if (shares[c] or 0) > min_share]
    return forward_fill(df.drop(*[c for c in columns if c not in kept]), keys, date, kept)


def import_parity(df: DataFrame, ulsd: str, brent: str, fx: str, price: str, producer: str) -> DataFrame:
    """parity per litre, crude in local money, and the margin over the producer."""
    return df.withColumns({"parity": F.col(ulsd) / LITRES_PER_GALLON * F.col(fx), "brent_local": F.col(brent) * F.col(fx), "margin": F.col(price) - F.col(producer)})


def row_median(columns: Sequence[str]) -> Column:
    """Median across columns, NULLs ignored; NULL if all are."""
    v = F.sort_array(F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull()))
    n = F.size(v)
    mid = lambda k: F.element_at(v, k.cast("int"))
    return F.when(n > 0, (mid(F.floor((n + 1) / 2)) + mid(F.floor(n / 2) + 1)) / 2)


def observation_rules(df: DataFrame, start: str, end: str, product: str, price: str, stations: str) -> DataFrame:
    """(rule, rows that break it): span of seven days from a Sunday, price in [1, 30], a station, one row per week and product."""
    rules = {
        "span": F.datediff(end, start) != 6, "sunday": F.dayofweek(start) != 1,
        "price": ~F.coalesce(F.col(price).between(1, 30), F.lit(False)), "stations": ~F.coalesce(F.col(stations) >= 1, F.lit(False)),
    }
    by_row = df.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in rules.items()])
    by_row = by_row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])).alias("x")).select("x.*")
    twice = df.groupBy(start, product).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("violations"))
    return by_row.unionByName(twice.select(F.lit("one_row").alias("rule"), "violations"))


def leak_check(spark, columns: Sequence[str]) -> DataFrame:
    """(column, leaks): names that say they hold the same week's value."""
    df = spark.createDataFrame([(c,) for c in columns], "column string")
    return df.withColumn("leaks", F.col("column").rlike("_l0$|_t0$|^target|_now$"))


def leaking_columns(df: DataFrame, columns: Sequence[str], target: str, most: float = 0.95) -> DataFrame:
    """``leak_check`` of the names, and of the values: the share of rows in which a column equals the target, and whether it is above ``most``."""
    share = df.agg(*[F.avg((F.col(c) == F.col(target)).cast("double")).alias(c) for c in columns]).unpivot([], list(columns), "column", "equal_share")
    return leak_check(df.sparkSession, columns).join(share, "column").withColumn("equals_target", F.col("equal_share") > most)


def with_region(df: DataFrame, unit: str, regions: DataFrame, region_unit: str = "unit") -> DataFrame:
    """Joins the region of each unit; Spark broadcasts the table of units while it is small."""
    return df.join(regions.withColumnRenamed(region_unit, unit), unit, "left")
