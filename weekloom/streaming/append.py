"""Hash-chained ledgers as the sink of a stream: each micro-batch is appended once, whatever is replayed.

Under ``path`` lie ``records``, ``heads`` and ``commits``, each with a folder a batch. A batch chains its records to the heads of their
ledgers, writes both, and at last its commit. A batch that is replayed after a crash finds its commit and adds nothing, or finds none and
writes its folders anew; readers take committed batches only. A batch older than the last one committed would start from heads that
have moved on, so it is refused: chains never fork.

Heads are written for the ledgers that a batch touches. Within a batch, a ledger's records are folded in one row, in order.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/{name}")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def committed_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of committed batches."""
    records, commits = _table(spark, path, "records"), _table(spark, path, "commits")
    if records is None or commits is None:
        raise ValueError(f"no batch has been committed under {path}")
    return records.join(commits.select("batch"), "batch", "left_semi")


def append_batch(rows: DataFrame, batch: int, path: str, ledger: str, order: str, content: Sequence[str]) -> bool:
    """Appends the rows as batch number ``batch``; false if it had been committed before.

    A record's hash is that of its content and the hash before it, joined by '|'; NULL ledgers are left out.
    """
    spark = rows.sparkSession
    commits, heads = _table(spark, path, "commits"), _table(spark, path, "heads")
    if commits is not None:
        last, again = commits.agg(F.max("batch"), F.max(F.col("batch") == batch)).first()
        if again:
            return False
        if last is not None and batch < last:
            raise ValueError(f"batch {batch} starts from old heads: batch {last} has been committed")
    own = F.struct(order, *[F.col(c).cast("string").alias(c) for c in content])
    x = rows.filter(F.col(ledger).isNotNull()).groupBy(ledger).agg(F.array_sort(F.collect_list(own)).alias("_own"))
    if commits is not None and heads is not None:
        now = heads.join(commits.select("batch"), "batch", "left_semi").groupBy(ledger)
        x = x.join(now.agg(F.max_by(F.struct("sequence", "record_hash"), "batch").alias("_head")), ledger, "left")
    else:
        x = x.withColumn("_head", F.lit(None).cast("struct<sequence: bigint, record_hash: string>"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    fields = ", ".join([f"`{order}`: {kinds[order]}", *(f"`{c}`: string" for c in content), "previous_hash: string", "record_hash: string"])

    def link(a, r):
        made = F.sha2(F.concat_ws("|", *[F.coalesce(r[c], F.lit("")) for c in content], a["before"]), 256)
        record = F.struct(r[order].alias(order), *[r[c].alias(c) for c in content], F.nullif(a["before"], F.lit("")).alias("previous_hash"), made.alias("record_hash"))
        return F.struct(made.alias("before"), F.concat(a["out"], F.array(record)).alias("out"))

    start = F.struct(F.coalesce("_head.record_hash", F.lit("")).alias("before"), F.array().cast(f"array<struct<{fields}>>").alias("out"))
    x = x.select(ledger, F.coalesce("_head.sequence", F.lit(0)).alias("_n"), F.posexplode(F.aggregate("_own", start, link)["out"]).alias("_i", "_r"))
    x.select(ledger, "_r.*", (F.col("_n") + F.col("_i") + 1).alias("sequence")).write.mode("overwrite").parquet(f"{path}/records/batch={batch}")
    new = spark.read.parquet(f"{path}/records/batch={batch}")
    top = new.groupBy(ledger).agg(F.max_by(F.struct("sequence", "record_hash"), "sequence").alias("_h")).select(ledger, "_h.*")
    top.write.mode("overwrite").parquet(f"{path}/heads/batch={batch}")
    spark.range(1).select(F.lit(new.count()).alias("records")).write.mode("overwrite").parquet(f"{path}/commits/batch={batch}")
    return True


def append_stream(rows: DataFrame, path: str, ledger: str, order: str, content: Sequence[str]) -> StreamingQuery:
    """Appends a stream's micro-batches to the ledgers under ``path`` and returns when all that is there has been taken."""
    q = rows.writeStream.foreachBatch(lambda df, n: append_batch(df, n, path, ledger, order, content) and None)
    q = q.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
