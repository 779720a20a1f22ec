"""Readers and writers. Schemas are stated, never inferred for contracts; what breaks a rule is returned as rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weekloom.functions.prep import canonical_product, normalize_name, parse_price, row_median
from weekloom.operators.score import weekly_reduce

# Accepted names of the columns (normalised).
DATE_NAMES = ("data", "date", "data_final", "semana", "week")
PRODUCT_NAMES = ("produto", "product", "combustivel")
PRICE_NAMES = ("preco_medio", "preco_medio_revenda", "price", "preco", "revenda")


def day_first(c: Column) -> Column:
    """A date from 31/12/2020, 31-12-2020 or 2020-12-31; else NULL."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in ("dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd")])


def pick(df: DataFrame, given: str | None, names: Sequence[str]) -> str:
    """The column that is given, or the first with an accepted name; an error if there is none."""
    if given:
        return given
    spark = df.sparkSession
    plain = {r["n"]: r["c"] for r in spark.createDataFrame([(c,) for c in df.columns], "c string").select("c", normalize_name(F.col("c")).alias("n")).collect()}  # column names only
    for n in names:
        if n in plain:
            return plain[n]
    raise ValueError(f"no column named any of {list(names)}")


def read_price_csv(spark: SparkSession, path: str, sep: str = ";", date: str | None = None, product: str | None = None, price: str | None = None, weekly: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): (product, date, price) of known products with a date and a positive price, and the lines that have not.

    With ``weekly`` ('mean', 'median' or 'preserve') rows are one a product and week: (product, week_end, price).
    """
    raw = spark.read.csv(path, sep=sep, header=True)
    d, p, v = (pick(raw, g, n) for g, n in ((date, DATE_NAMES), (product, PRODUCT_NAMES), (price, PRICE_NAMES)))
    x = raw.select(canonical_product(F.col(p)).alias("product"), day_first(F.col(d)).alias("date"), parse_price(F.col(v)).alias("price"), F.col(p).alias("raw_product"), F.col(d).alias("raw_date"), F.col(v).alias("raw_price"))
    ok = F.coalesce(F.col("product").isNotNull() & F.col("date").isNotNull() & (F.col("price") > 0), F.lit(False))
    good = x.filter(ok).select("product", "date", "price")
    return weekly_reduce(good, ["product"], "date", "price", weekly) if weekly else good, x.filter(~ok).select("raw_product", "raw_date", "raw_price")


CHART = "chart struct<result array<struct<timestamp array<bigint>, indicators struct<quote array<struct<close array<double>>>>>>>"
VALUES = "value array<struct<VALDATA string, VALVALOR double>>"


def read_series_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(date, value), positive, one a date (the last): 'chart' has parallel arrays of epochs and closes, 'values' a list of records."""
    if kind == "chart":
        r = spark.read.schema(CHART).json(path).select(F.explode("chart.result").alias("r"))
        x = r.select(F.explode(F.arrays_zip(F.col("r.timestamp").alias("t"), F.col("r.indicators.quote")[0]["close"].alias("v"))).alias("x"))
        x = x.select(F.timestamp_seconds("x.t").alias("at"), F.col("x.v").alias("value"))
    else:
        x = spark.read.schema(VALUES).json(path).select(F.explode("value").alias("x")).select(F.try_to_timestamp(F.substring("x.VALDATA", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("at"), F.col("x.VALVALOR").alias("value"))
    x = x.filter(F.col("at").isNotNull() & (F.col("value") > 0))
    return x.groupBy(F.to_date("at").alias("date")).agg(F.max_by("value", F.struct("at", "value")).alias("value"))


def file_profile(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, records, sha256) of the files of a folder; records are lines that aren't blank. Files without a single byte aren't seen."""
    sums = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("records"))
    return sums.join(lines, "file", "left").select("file", "bytes", F.coalesce("records", F.lit(0)).alias("records"), "sha256")


def manifest_violations(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(rule, violations) of files against a manifest (file, records, sha256)."""
    x = found.select("file", F.col("records").alias("n"), F.col("sha256").alias("s")).join(manifest, "file", "full")
    rules = {"record_count": F.col("n") != F.col("records"), "file_sha256": F.col("s") != F.col("sha256"), "undeclared_file": F.col("sha256").isNull(), "missing_file": F.col("s").isNull()}
    return x.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in rules.items()]).unpivot([], list(rules), "rule", "violations")


def read_contract_jsonl(spark: SparkSession, path: str, schema: StructType, ident: str, version_field: str | None = None, version: str | None = None, manifest: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, violations): lines of a closed set of fields. Rules: unreadable, other fields, missing or repeated id, other version and,
    with a manifest (file, records, sha256), the files' record counts and SHA-256, files it doesn't name and files that are missing.

    Records with a repeated id are all left out: none can be trusted to be the right one.
    """
    raw = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    names = F.array(*[F.lit(f.name) for f in schema])
    x = raw.select("value", F.from_json("value", schema).alias("r"), F.json_object_keys("value").alias("keys"))
    fields = F.sort_array("keys") != F.sort_array(names)
    rules = {"unreadable": F.col("keys").isNull(), "fields": F.coalesce(fields, F.lit(False)), "missing_id": F.col("keys").isNotNull() & F.col(f"r.{ident}").isNull()}
    if version_field:
        rules["version"] = F.col("keys").isNotNull() & ~F.col(f"r.{version_field}").cast("string").eqNullSafe(F.lit(version))
    v = x.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in rules.items()]).unpivot([], list(rules), "rule", "violations")
    again = x.filter(F.col(f"r.{ident}").isNotNull()).groupBy(F.col(f"r.{ident}").alias("_again")).count().filter("count > 1").select("_again")
    twice = again.agg(F.count(F.lit(1)).alias("violations")).select(F.lit("repeated_id").alias("rule"), "violations")
    bad = F.lit(False)
    for c in rules.values():
        bad = bad | c
    v = v.unionByName(twice)
    if manifest is not None:
        v = v.unionByName(manifest_violations(file_profile(spark, path), manifest))
    return x.filter(~bad).join(again, F.col(f"r.{ident}") == F.col("_again"), "left_anti").select("r.*"), v


LEDGER = "ledger string, sequence bigint, event string, payload string, previous_hash string, record_hash string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger records with the raw line; lines that don't parse keep it and have NULLs."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.from_json("value", LEDGER).alias("r")).select("r.*", "line")


def read_state_prices(raw: DataFrame, states: DataFrame, state: str, product: str, unit: str, date: str, price: str, stations: str, expected_unit: str = "R$/l") -> tuple[DataFrame, DataFrame]:
    """(rows, violations): (uf, date, price, stations) of the S10 product for all states at once; ``states`` has (name, uf)."""
    label = F.upper(F.trim(F.col(state)))
    x = raw.filter(canonical_product(F.col(product)) == "S10").withColumn("name", label).join(states, "name", "left")
    x = x.select("uf", F.col(date).alias("date"), F.col(price).cast("double").alias("price"), F.col(stations).alias("stations"), F.col(unit).alias("unit"))
    v = x.agg(F.count(F.when(F.col("uf").isNull(), 1)).alias("unknown_state"), F.count(F.when(F.lower("unit") != expected_unit.lower(), 1)).alias("unit"), F.count(F.when(~F.coalesce(F.col("price") > 0, F.lit(False)), 1)).alias("price")).unpivot([], ["unknown_state", "unit", "price"], "rule", "violations")
    twice = x.groupBy("uf", "date").count().filter("count > 1").agg(F.count(F.lit(1)).alias("violations")).select(F.lit("repeated_week").alias("rule"), "violations")
    return x.filter(F.col("uf").isNotNull() & (F.col("price") > 0)).drop("unit"), v.unionByName(twice)


def read_producer(raw: DataFrame, product: str, start: str, regions: Sequence[str], region: str | None = None) -> DataFrame:
    """(date, producer_national, producer_region): the median over regions (a given national column isn't trusted), on the Sunday before."""
    x = raw.filter(canonical_product(F.col(product)) == "S10")
    own = F.col(region).cast("double") if region else F.lit(None).cast("double")
    return x.select(F.date_sub(start, 1).alias("date"), row_median(regions).alias("producer_national"), own.alias("producer_region"))


def formula_safe(c: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a leading apostrophe."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """parquet, json or csv; Spark's committer makes the folder appear whole. CSV quotes all and is safe to open."""
    if fmt == "csv":
        df = df.select(*[formula_safe(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema])
        df.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def source_profile(df: DataFrame, by: Sequence[str], date: str, content: str | None = None) -> DataFrame:
    """Rows, first and last date, and non-null values of each other column, per source; with a ``content`` column also its bytes and the
    fingerprint of all columns (see ``data_fingerprint``). Of files, ``file_profile`` gives bytes and SHA-256."""
    rest = [c for c in df.columns if c not in (*by, date)]
    own = [F.count(F.lit(1)).alias("rows"), F.min(date).alias("first"), F.max(date).alias("last"), *[F.count(c).alias(f"n_{c}") for c in rest]]
    if content:
        own += [F.coalesce(F.sum(F.octet_length(F.col(content)).cast("long")), F.lit(0)).alias("bytes"), _fingerprint([date, *rest]).alias("fingerprint")]
    return df.groupBy(*by).agg(*own)


def _fingerprint(cols: Sequence[str]) -> Column:
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols]), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    return F.sha2(F.concat_ws(":", *[part(i).cast("string") for i in range(4)]), 256)


def data_fingerprint(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(rows, fingerprint) per key: sums of the row hashes' four 32-bit parts, hashed, so no group is ever collected; order doesn't count, repeats do."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), _fingerprint(cols).alias("fingerprint"))
