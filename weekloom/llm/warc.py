"""WARC archives: writing with revisit records, and reading with boundary-chain verification.

Writing. Each row becomes one WARC/1.1 record. Spark's text writer puts CR LF CR LF after every row, which is just the
end of a WARC record, so archives are written in parallel by the cluster's own file layer. Payloads that occur again
(equal bytes, at least ``least_bytes``) are written once, by the row with the smallest id; the others become *revisit*
records that refer to it.

Reading. Spark's text reader splits archives at byte ranges, with the magic ``WARC/1.`` as separator, so a task sees
every place where a record *may* begin. It emits (offset, successor offset) for each such candidate: header and content
length say where the next record must begin. Offsets come from prefix sums of piece lengths within a byte range and of
ranges within a file. Pointer jumping from the start of each file then keeps only the records that the chain reaches,
in a logarithmic number of joins over offsets alone; magic inside a payload is never reached. Payloads aren't shuffled
unless a record really holds the magic in its payload or header; only such records are put together from their pieces.
A header that holds the magic (a URL may) ends with the first blank line of the pieces that follow: it is found by running
counts within byte ranges, carried from range to range, and no text is gathered for it before the chain has chosen.

A chain that stops before the end of its file is an error that names the file, unless ``strict`` is false; then the records
before the break are returned.

Defined cases: a null payload is empty; a null url is left out; what is not printable ASCII in a url is percent-encoded as
UTF-8, so no character can end a header line, whatever Unicode calls it; ids that are text are encoded as in a URL's query and
come back as they were; rows that share the
smallest id of equal payloads are all responses; a null id comes after all others; columns other than id, url and payload
are not read. A payload is text (UTF-8) when written; the reader takes any bytes, and header lines that end in CR LF or LF.
An empty table gives an archive without records.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .carry import quoted
from .scratch import scratch_dir, staged

MAGIC, END = "WARC/1.", "\r\n\r\n"
_ENDS = 4


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")


def _printable(value: Column) -> Column:
    """The text with all but printable ASCII percent-encoded."""
    encoded = F.transform(F.split(value, ""), lambda c: F.when(c.rlike("\\A[!-~]\\z"), c).otherwise(F.regexp_replace(F.url_encode(c), "[+]", "%20")))
    return F.when(value.rlike("[^!-~]"), F.array_join(encoded, "")).otherwise(value)


def record_plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """(id, url, payload, bytes, digest, revisit, refers) of each row. Only digests of payloads that repeat are joined back."""
    payload = F.coalesce(quoted(payload_col), F.lit(""))
    own = pages.select(quoted(id_col).alias("id"), quoted(url_col).cast("string").alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    first = own.filter(F.col("bytes") >= least_bytes).groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("d", "first")
    first = staged(first, "repeated-payloads")  # its size is then known, so that Spark broadcasts it only if it is small
    both = own.join(first, F.col("digest") == F.col("d"), "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return both.select("id", "url", "payload", "bytes", "digest", again.alias("revisit"), F.when(again, F.col("first")).alias("refers"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", least_bytes: int = 100) -> None:
    """Writes a record per row to text archives under ``path``."""
    plan = record_plan(pages, id_col, url_col, payload_col, least_bytes)
    revisit = F.col("revisit")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.url_encode(c.cast("string")), F.lit(">"))
    record = F.concat(
        F.lit(f"{MAGIC}1\r\n"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", F.coalesce(urn(F.col("id")), F.lit("<urn:page:>"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", _printable(F.col("url"))),
        _header("WARC-Refers-To", urn(F.col("refers"))),
        _header("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("Content-Type", F.lit("text/html")),
        _header("Content-Length", F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("payload")),
    )
    plan.select(record.alias("value")).write.option("lineSep", END).text(path)


def _pieces(spark, path: str) -> DataFrame:
    """(file, range, nth, value): what lies between two places of the magic; nth orders the pieces of a byte range."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("nth"), "value")


def _carried(rows: DataFrame, order: str, sums: dict[str, Column], last: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with running sums, and last known values, over all rows of their file up to and with themselves.

    Each (file, range) is scanned by itself; one row a range carries on what was before. So no task holds a whole file.
    """
    last = last or {}
    inside = W.partitionBy("file", "range").orderBy(order)
    whole = {**{f"_{k}": F.sum(c) for k, c in sums.items()}, **{f"_{k}": F.max_by(c, F.when(c.isNotNull(), F.col(order))) for k, c in last.items()}}
    before = W.partitionBy("file").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = rows.groupBy("file", "range").agg(*[c.alias(k) for k, c in whole.items()])
    ranges = ranges.select("file", "range", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums], *[F.last(f"_{k}", ignorenulls=True).over(before).alias(f"_{k}") for k in last])
    own = rows.withColumns({**{k: F.sum(c).over(inside) for k, c in sums.items()}, **{k: F.last(c, ignorenulls=True).over(inside) for k, c in last.items()}})
    both = own.join(ranges, ["file", "range"])
    return both.withColumns({**{k: F.col(k) + F.col(f"_{k}") for k in sums}, **{k: F.coalesce(k, f"_{k}") for k in last}}).drop(*[f"_{k}" for k in (*sums, *last)])


def _placed(pieces: DataFrame, **sums: Column) -> DataFrame:
    """A staged table of pieces with ``size``, and ``at``: the offset in the file of the magic before each; and further running sums."""
    placed = _carried(pieces, "nth", {"_to": F.col("size") + len(MAGIC), **sums})
    # the first piece of a file lies before any magic, at offset -len(MAGIC): it is no candidate
    return placed.withColumn("at", F.col("_to") - F.col("size") - 2 * len(MAGIC)).filter("at >= 0").drop("_to")


def _field(head: Column, name: str) -> Column:
    """The value of a header line; only LF ends a line, with or without CR before it."""
    found = F.regexp_extract(head, f"(?i)\\n{name}:[ \\t]*([^\\r\\n]*?)[ \\t]*(?:\\r|\\n|\\z)", 1)
    return F.when(found != "", found)


def _staged_pieces(spark, path: str) -> DataFrame:
    """A staged table of pieces: size, head and length where a blank line ends the header within the piece, digest of a whole payload.

    Without a blank line, ``length`` is what the piece itself says of it.
    """
    p = _pieces(spark, path)
    size, known = F.octet_length("value").cast("long"), F.instr("value", END) > 0
    head = F.when(known, F.substring_index("value", END, 1))
    begin = F.octet_length("head").cast("long") + _ENDS
    p = p.select("file", "range", "nth", "value", size.alias("size"), head.alias("head"))
    p = p.withColumn("begin", begin).withColumn("length", _field(F.coalesce("head", "value"), "Content-Length").try_cast("long"))
    p = p.withColumn("full", F.coalesce(F.col("begin") + F.col("length") + _ENDS == F.col("size"), F.lit(False)))
    body = F.when(F.col("full"), F.col("value").cast("binary").substr(F.col("begin").cast("int") + 1, F.col("length").cast("int")))
    return staged(p.select("file", "range", "nth", "size", "head", "begin", "length", "full", F.sha2(body, 256).alias("digest")), "candidates")


def candidates(pieces: DataFrame) -> DataFrame:
    """(file, range, at, next, length, head, digest, full): every place where a record may begin and where its successor must.

    ``at`` is the offset of the magic; ``next`` is null where no length can be read; ``full`` says that the record is one
    piece, so its payload digest could be taken at once. ``head`` is null where the header goes on beyond the piece.
    """
    # pieces with the same number of headers' ends before them have the same end: the last of them holds it
    placed = _placed(pieces, ended=F.col("begin").isNotNull().cast("long"))
    placed = placed.withColumn("run", F.when(F.col("begin").isNotNull(), F.col("ended") - 1).otherwise(F.col("ended")))
    begin = F.col("at") + len(MAGIC) + F.col("begin")
    closed = placed.filter("begin is not null").withColumn("body", begin)
    columns = ["file", "range", "at", (F.col("body") + F.col("length") + _ENDS).alias("next"), "length", "head", "digest", "full"]
    if not pieces.filter("begin is null and size > 0").limit(1).count():  # a file begins with an empty piece
        return closed.select(*columns)
    open_ = placed.filter("begin is null").withColumn("body", F.lit(None).cast("long"))
    ends = closed.join(open_.select("file", "run").distinct(), ["file", "run"], "left_semi")
    ahead = W.partitionBy("file", "run").orderBy(F.desc("at"))  # the pieces of one header, or of one payload
    joined = open_.unionByName(ends).withColumns({"length": F.last("length", ignorenulls=True).over(ahead), "body": F.max("body").over(ahead)})
    return closed.select(*columns).unionByName(joined.filter("begin is null").select(*columns))


def _contract(table: pa.Table) -> pa.Table:
    """Within one byte range: where the chain that passes a candidate first leaves the range's candidates."""
    table = table.sort_by("at")
    ahead = table["next"].to_pylist()
    out = dict.fromkeys(table["at"].to_pylist())
    for at, following in zip(reversed(list(out)), reversed(ahead), strict=True):
        out[at] = out[following] if following in out else following
    return table.append_column("exit", pa.array(list(out.values()), pa.int64()))


def _follow(table: pa.Table) -> pa.Table:
    """Within one byte range: the candidates that the chain passes, from where it enters."""
    table = table.sort_by("at")
    on, keep = set(), []
    for at, following, entered in zip(table["at"].to_pylist(), table["next"].to_pylist(), table["entered"].to_pylist(), strict=True):
        keep.append(bool(entered) or at in on)
        if keep[-1]:
            on.add(following)
    return table.select(["file", "at"]).filter(pa.array(keep, pa.bool_()))


def reachable(links: DataFrame) -> DataFrame:
    """(file, at) of the records that the chain from each file's start reaches, by pointer jumping.

    ``links`` has (file, range, at, next). Each byte range first contracts its own pointers to where the chain leaves it
    (a range holds a bounded number of bytes). In round k every place reached marks the place 2**k ranges on, and all
    pointers double, so the rounds are the logarithm of a file's byte ranges. At last each range follows the chain from
    where it was entered.
    """
    kind = "file string, range long, at long, next long"
    inner = staged(links.select("file", "range", "at", "next").groupBy("file", "range").applyInArrow(_contract, f"{kind}, exit long"), "contracted")
    jump = inner.filter("exit is not null").select("file", "at", F.col("exit").alias("next"))
    most = inner.groupBy("file").agg(F.count_distinct("range").alias("n")).agg(F.max("n")).first()[0] or 0
    reached = inner.filter("at = 0").select("file", "at")
    for k in range(int(most).bit_length()):
        ahead = reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        reached = staged(reached.unionByName(ahead).distinct(), f"reached-{k}")
        if k + 1 < int(most).bit_length():
            far = jump.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
            jump = staged(jump.join(far, ["file", "next"]).select("file", "at", F.col("far").alias("next")), f"jump-{k}")
    entered = inner.join(reached.withColumn("entered", F.lit(True)), ["file", "at"], "left").select("file", "range", "at", "next", "entered")
    return entered.groupBy("file", "range").applyInArrow(_follow, "file string, at long")


def _put_together(spark, path: str, found: DataFrame, kept: DataFrame, broken: DataFrame) -> DataFrame:
    """(file, at, digest) of the records that hold the magic in their payload, from all their pieces in order.

    Their files are read once more. That scan may split them otherwise than the first one, so its pieces are staged and
    placed anew, and meet the records by their offsets in the file alone.
    """
    starts = kept.select("file", "at", F.col("at").alias("start"))
    mapped = found.select("file", "range", "at").join(starts, ["file", "at"], "left")
    mapped = _carried(mapped, "at", {}, {"owner": F.col("start")})
    parts = mapped.join(broken.select("file", F.col("at").alias("owner")), ["file", "owner"]).select("file", "at", "owner")
    again = _pieces(spark, path).join(broken.select("file").distinct(), "file", "left_semi").withColumn("size", F.octet_length("value").cast("long"))
    text = _placed(staged(again, "pieces")).join(parts, ["file", "at"])
    text = text.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", F.col("value").cast("binary").alias("v")))).alias("p"))  # the pieces of one record
    joined = F.aggregate(F.slice("p", 2, F.size("p")), F.element_at("p", 1)["v"], lambda a, x: F.concat(a, F.lit(MAGIC).cast("binary"), x["v"]))
    whole = broken.select("file", "at", "length").join(text.select("file", F.col("owner").alias("at"), joined.alias("all")), ["file", "at"])
    whole = whole.withColumn("own_head", F.substring_index(F.col("all").cast("string"), END, 1))
    body = F.expr(f"substring(all, cast(octet_length(own_head) + {_ENDS + 1} as int), cast(length as int))")
    return whole.select("file", "at", "own_head", F.sha2(body, 256).alias("own"))


def _unbroken(pieces: DataFrame, kept: DataFrame) -> None:
    """An error if a chain stops before its file does."""
    files = pieces.groupBy("file").agg((F.sum(F.col("size") + len(MAGIC)) - len(MAGIC)).alias("bytes")).filter("bytes > 0")
    reach = kept.groupBy("file").agg(F.when(F.count(F.when(F.col("next").isNull(), 1)) == 0, F.max("next")).alias("reach"), F.max("at").alias("last"))
    bad = files.join(reach, "file", "left").filter(~F.col("reach").eqNullSafe(F.col("bytes")))
    some = [f"{r['file']}: {'no record at its start' if r['last'] is None else 'the record at ' + str(r['last'])}" for r in bad.orderBy("file").limit(5).collect()]
    if some:
        raise ValueError("archives whose chain of records stops before their end: " + "; ".join(some))


def read_warc(spark, path: str, strict: bool = True) -> DataFrame:
    """(file, at, record_type, record_id, url, refers_to, payload_bytes, payload_digest, stated_digest) per record."""
    pieces = _staged_pieces(spark, path)
    found = staged(candidates(pieces), "chain")
    real = reachable(found)
    kept = staged(found.join(real, ["file", "at"], "left_semi"), "records")
    if strict:
        _unbroken(pieces, kept)
    kept = kept.filter("next is not null")
    broken = kept.filter(~F.col("full"))
    if broken.limit(1).count():
        sums = _put_together(spark, path, found, kept, broken)
        kept = kept.join(sums, ["file", "at"], "left").withColumns({"digest": F.coalesce("own", "digest"), "head": F.coalesce("own_head", "head")})
    head = F.col("head")
    urn = lambda x: F.when(x.rlike("^<urn:page:.+>$"), F.try_url_decode(F.regexp_extract(x, "^<urn:page:(.*)>$", 1)))
    return kept.select(
        "file", "at", _field(head, "WARC-Type").alias("record_type"), urn(_field(head, "WARC-Record-ID")).alias("record_id"), _field(head, "WARC-Target-URI").alias("url"),
        urn(_field(head, "WARC-Refers-To")).alias("refers_to"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.regexp_replace(_field(head, "WARC-Payload-Digest"), "^sha256:", "").alias("stated_digest"),
    )


def resolved(records: DataFrame) -> DataFrame:
    """Records with revisits given the length and digest of the response they refer to (its digest must be the stated one).

    Only revisits are joined, with the responses that some revisit names.
    """
    names = records.columns
    revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    named = records.filter(revisit).select(F.col("refers_to").alias("_r"), F.col("stated_digest").alias("_d")).distinct()
    responses = records.filter("record_type = 'response'").join(named, (F.col("record_id") == F.col("_r")) & (F.col("payload_digest") == F.col("_d")))
    responses = responses.groupBy("_r", "_d").agg(F.max("payload_bytes").alias("_n"))
    again = records.filter(revisit).join(responses, (F.col("refers_to") == F.col("_r")) & (F.col("stated_digest") == F.col("_d")), "left")
    again = again.withColumns({"payload_bytes": F.col("_n"), "payload_digest": F.col("_d")}).select(*names)
    return records.filter(~revisit).unionByName(again)


def warc_query(spark, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{scratch_dir(spark)}/weekloom/warc-{uuid.uuid4().hex}"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_warc(pages, path)
    id_type = pages.schema["page_id"].dataType
    out = resolved(staged(read_warc(spark, path), "warc-records"))
    return out.select(F.col("record_id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q),
r AS (SELECT *, payload_bytes >= 100 AND first_id <> page_id AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to FROM r
"""
