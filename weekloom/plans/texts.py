"""Registered queries: text and annotation; each with the SQL that says the same."""
from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.operators import text
from weekloom.plans.queries import PRED, predictions, query, rounded, table

ART = "a AS (SELECT doc_id, text, source, lang, sha256(text) AS sha, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (doc_id * 7 % 2000) AS t FROM documents), o AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-07', TIMESTAMP '2024-04-28', INTERVAL 7 DAY)) AS origin)"


def articles(spark, d):
    """Documents as articles: hours of the first weeks of 2024 by id, so that every document falls into a look-back."""
    return table(spark, d, "documents").select("doc_id", "text", "source", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(doc_id * 7 % 2000 as int))").alias("available"))


def origins(spark):
    return spark.sql("select explode(sequence(date'2024-01-07', date'2024-04-28', interval 7 days)) as origin")


FOLDED = "left(trim(regexp_replace(lower(translate(coalesce({c}, ''), 'ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑáàâãäéèêëíìîïóòôõöúùûüçñ', 'AAAAAEEEEIIIIOOOOOUUUUCNaaaaaeeeeiiiiooooouuuucn')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 3000)"


@query(f"WITH {ART}, h AS (SELECT origin::DATE AS origin, doc_id, t, 'source_' || {FOLDED.format(c='source')} || ' ' || {FOLDED.format(c='lang')} || ' ' || {FOLDED.format(c='text')} AS line, row_number() OVER (PARTITION BY origin, sha ORDER BY t, doc_id) AS i FROM a JOIN o ON t <= origin AND t > origin - INTERVAL 14 DAY), g AS (SELECT origin, row_number() OVER (PARTITION BY origin ORDER BY t, doc_id) AS position, doc_id, line FROM h WHERE i = 1) SELECT origin, position, doc_id AS record, sha256(line) AS line_sha256 FROM g UNION ALL SELECT origin::DATE, 0, NULL, sha256('__no_news__') FROM o WHERE origin::DATE NOT IN (SELECT origin FROM g)")
def tx2_weekly_documents(spark, d):
    x = text.weekly_lines(articles(spark, d), origins(spark), 14, "doc_id", "source", "lang", "text")
    return x.select("origin", F.col("position").cast("long").alias("position"), "record", F.sha2(F.col("line").cast("binary"), 256).alias("line_sha256"))


@query(f"WITH {PRED} SELECT k, date, CASE WHEN actual - origin > 200 THEN 1 WHEN actual - origin < -200 THEN -1 ELSE 0 END AS label FROM r")
def tx3_market_labels(spark, d):
    return predictions(spark, d).select("k", "date", text.market_label("origin", "actual", 200.0).alias("label"))


KINDS = ["click", "error", "purchase", "signup", "view"]
SIGNALS = "w AS (SELECT user_id, date_trunc('week', ts)::DATE AS week, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS u, count(*) FILTER (event_type = 'error') AS d, " + ", ".join(f"count(*) FILTER (event_type = '{c}') AS c_{c}" for c in KINDS) + " FROM events GROUP BY 1, 2)"


def signals(spark, d):
    """Weekly counts of a user's events by direction and by kind."""
    kind = F.when(F.col("event_type") == "purchase", "up").when(F.col("event_type") == "error", "down").otherwise("neutral")
    e = table(spark, d, "events").select("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week"), kind.alias("dir"), "event_type")
    count = lambda c, names: F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), F.count(F.when(F.col(c) == k, 1)).alias("value")) for k in names]))
    return e.groupBy("user_id", "week").agg(F.count(F.lit(1)).alias("n"), count("dir", ("up", "down", "neutral")).alias("directions"), count("event_type", KINDS).alias("categories"))


@query(f"WITH {SIGNALS} SELECT user_id, week, round(ln(1 + n), 6) AS log_count, round(u / n, 6) AS share_up, round(d / n, 6) AS share_down, round((n - u - d) / n, 6) AS share_neutral, round(u / n - d / n, 6) AS balance, {', '.join(f'round(c_{c} / n, 6) AS category_{c}' for c in KINDS)} FROM w")
def tx1_weekly_signal_features(spark, d):
    return rounded(text.weekly_signal_features(signals(spark, d), ["user_id", "week"], "n", "directions", "categories", KINDS))


@query(f"WITH {SIGNALS} SELECT unnest(['negative_count', 'direction_sum']) AS rule, unnest([count(*) FILTER (n - 40 < 0), count(*)]) AS violations FROM w")
def tx1_signal_violations(spark, d):
    """Counts made wrong by 40, so that small ones are negative and none is the sum of its directions."""
    return text.signal_violations(signals(spark, d).withColumn("n", F.col("n") - 40), "n", "directions")


def annotated(spark, d):
    """Labels as two slots: quality by slot 1, toxic turned around by slot 2."""
    x = table(spark, d, "labels").select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("slot"), F.lit("a").alias("annotator"), F.col("quality").cast("string").alias("good")), F.struct(F.lit(2).alias("slot"), F.lit("b").alias("annotator"), (1 - F.col("toxic")).cast("string").alias("good")))).alias("s"))
    return x.select("doc_id", "s.*")


FIELDS = {"relevance": "{x}", "direction": "CASE WHEN doc_id % 3 = 0 THEN 1 - {x} ELSE {x} END", "intensity": "{x} * 2 + doc_id % 2", "horizon": "CASE WHEN doc_id % 7 = {x} THEN 0 ELSE {x} END"}


def fully_annotated(spark, d):
    """``annotated`` with four labels made of each slot's own and with time stamps, some of which can't be read."""
    x = annotated(spark, d).withColumn("g", F.col("good").cast("int"))
    x = x.select("doc_id", "slot", "annotator", *[F.expr(e.format(x="g")).cast("string").alias(c) for c, e in FIELDS.items()])
    return x.withColumn("at", F.when(F.col("doc_id") % 10 == 0, "some day").otherwise(F.concat(F.lit("2024-01-0"), F.col("slot").cast("string"), F.lit(" 12:00:00"))))


SLOTS = "s AS (SELECT doc_id, 1 AS slot, quality AS g FROM labels UNION ALL SELECT doc_id, 2, 1 - toxic FROM labels), x AS (SELECT doc_id, slot, " + ", ".join(f"({e.format(x='g')})::VARCHAR AS {c}" for c, e in FIELDS.items()) + " FROM s)"


@query(f"WITH {SLOTS} SELECT unnest(['duplicate', 'unequal_slots', 'same_annotator', 'timestamp', 'domain_relevance', 'domain_intensity']) AS rule, unnest([(SELECT 2 * count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)), 0, 0, count(*) FILTER (doc_id % 10 = 0), count(*) FILTER (relevance IS NULL), count(*) FILTER (intensity IS NULL OR intensity NOT IN ('0', '1', '2'))]) AS violations FROM x")
def tx6_validate_annotations(spark, d):
    return text.annotation_violations(fully_annotated(spark, d), "doc_id", "slot", "annotator", {"relevance": ["0", "1"], "intensity": ["0", "1", "2"]}, "at")


def _kappa_sql(c: str) -> str:
    return f"SELECT '{c}' AS label, max(n) AS n, round(max(o), 6) AS observed, round((max(o) - coalesce(sum(pa * pb), 0)) / (1 - coalesce(sum(pa * pb), 0)), 6) AS kappa FROM (SELECT (SELECT count(*) FROM p{c}) AS n, (SELECT avg((a = b)::INT::DOUBLE) FROM p{c}) AS o, (SELECT count(*) FROM p{c} WHERE a = l) / (SELECT count(*) FROM p{c}) AS pa, (SELECT count(*) FROM p{c} WHERE b = l) / (SELECT count(*) FROM p{c}) AS pb FROM (SELECT DISTINCT a AS l FROM p{c}))"


@query(f"WITH {SLOTS}, {', '.join(f'p{c} AS (SELECT y.{c} AS a, z.{c} AS b FROM x y JOIN x z ON z.doc_id = y.doc_id AND y.slot = 1 AND z.slot = 2 WHERE y.{c} IS NOT NULL AND z.{c} IS NOT NULL)' for c in FIELDS)} {' UNION ALL '.join(_kappa_sql(c) for c in FIELDS)}")
def tx6_slot_agreement(spark, d):
    return rounded(text.slot_agreement(fully_annotated(spark, d), "doc_id", "slot", list(FIELDS)))


@query("SELECT doc_id, 'good' AS fields FROM labels WHERE quality IS DISTINCT FROM 1 - toxic")
def tx8_disagreements(spark, d):
    x = annotated(spark, d)
    return text.disagreements(x.filter("slot = 1"), x.filter("slot = 2"), "doc_id", ["good"])


@query("SELECT doc_id, slot, good, false AS changed FROM (SELECT doc_id, 1 AS slot, quality::VARCHAR AS good FROM labels UNION ALL SELECT doc_id, 2, (1 - toxic)::VARCHAR FROM labels)")
def tx7_merge_slots(spark, d):
    x = annotated(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "left")
    return text.merge_slots([x.filter("slot = 1"), x.filter("slot = 2")], "doc_id", ["lang"]).select("doc_id", "slot", "good", "changed")


#: Pieces of words that the documents hold, in the place of the terms of fuel news, which they don't.
LEX = {
    "direct": ["nicht", "donde"], "fuel": ["thanedble", "keiteintz"], "sector": ["erition", "ontion"], "cost": ["anedble", "onment"],
    "up": ["thingea", "elle"], "down": ["reingen", "cion"], "policy": ["thwhon", "ouvr"], "context": ["ersh", "chlich"],
    "1w": ["thonly", "avec"], "2w": ["thor", "para"], "4w": ["reou"], "long": ["from"],
}
_FOUND = ", ".join(f"list_filter({terms}, lambda x: contains(t, x)) AS m_{c}" for c, terms in LEX.items())
_POLICY = "CASE WHEN len(m_policy) > 0 THEN 'neutral' ELSE 'uncertain' END"
LEXICON_SQL = f"""
WITH t AS (SELECT doc_id, trim(regexp_replace(lower(translate(coalesce(text, ''), 'ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑáàâãäéèêëíìîïóòôõöúùûüçñ',
  'AAAAAEEEEIIIIOOOOOUUUUCNaaaaaeeeeiiiiooooouuuucn')), '[\\s\\x0B\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS t FROM documents),
m AS (SELECT doc_id, unnest(['supply_cost', 'procurement_risk', 'procurement_risk_calibrated']) AS persona, {_FOUND} FROM t),
r AS (SELECT *, CASE WHEN len(m_direct) > 0 THEN 3 WHEN len(m_fuel) > 0 OR len(m_sector) > 0 AND len(m_cost) > 0 THEN 2
  WHEN persona = 'procurement_risk' THEN (len(m_sector) + len(m_cost) >= 2)::INT
  WHEN persona = 'procurement_risk_calibrated' AND len(m_policy) > 0 THEN 0 ELSE (len(m_sector) + len(m_cost) > 0)::INT END AS relevance FROM m),
d AS (SELECT *, CASE WHEN relevance = 0 THEN 'neutral' WHEN len(m_up) > 0 AND len(m_down) > 0 THEN 'uncertain'
  WHEN persona = 'procurement_risk' AND len(m_context) = 0 THEN {_POLICY} WHEN len(m_up) > 0 THEN 'up' WHEN len(m_down) > 0 THEN 'down'
  ELSE {_POLICY} END AS direction FROM r)
SELECT doc_id, persona, relevance, direction,
  CASE direction WHEN 'neutral' THEN 0 WHEN 'uncertain' THEN 1 ELSE CASE WHEN persona = 'supply_cost' THEN relevance ELSE greatest(1, relevance - 1) END END AS intensity,
  CASE WHEN direction = 'neutral' THEN 'unknown' WHEN len("m_1w") > 0 THEN '1w' WHEN len("m_2w") > 0 THEN '2w' WHEN len("m_4w") > 0 THEN '4w'
    WHEN len("m_long") > 0 THEN 'long' ELSE 'unknown' END AS horizon,
  array_to_string((m_direct || m_fuel || m_sector || m_cost || m_up || m_down)[:6], ',') AS evidence FROM d
"""


@query(LEXICON_SQL)
def tx9_lexicon_label(spark, d):
    """Whole texts, labelled by all three personas."""
    return text.lexicon_label(table(spark, d, "documents").select("doc_id", "text"), "text", terms=LEX).drop("text")


@query("""WITH p AS (SELECT doc_id, source, lang, CASE WHEN n_chars > 1000 THEN 'relevant' ELSE 'control' END AS pool FROM documents),
s AS (SELECT pool, source, lang, count(*) AS m FROM p GROUP BY ALL), q AS (SELECT *, 60 * m / sum(m) OVER (PARTITION BY pool) AS e FROM s),
b AS (SELECT *, floor(e) AS base, row_number() OVER (PARTITION BY pool ORDER BY e - floor(e) DESC, source, lang) AS r FROM q),
t AS (SELECT *, base + (r <= 60 - sum(base) OVER (PARTITION BY pool))::INT AS quota FROM b),
k AS (SELECT p.*, sha256('7:' || doc_id) AS h, quota, row_number() OVER (PARTITION BY p.pool, p.source, p.lang ORDER BY sha256('7:' || doc_id)) AS i FROM p JOIN t ON t.pool = p.pool AND t.source = p.source AND t.lang = p.lang),
d AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY h) AS j FROM k WHERE i <= quota),
z AS (SELECT least(greatest(40, 60 - count(*) FILTER (pool = 'control')), count(*) FILTER (pool = 'relevant')) AS r FROM d)
SELECT substr(h, 1, 16) AS item_id, doc_id, source, lang, pool, unnest([1, 2]) AS slot FROM d, z WHERE j <= CASE WHEN pool = 'relevant' THEN r ELSE 60 - r END""")
def tx5_annotation_batch(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    return text.annotation_batch(x, ["source", "lang"], "doc_id", F.col("n_chars") > 1000, 60, 2 / 3, 2, 7)


@query()
def ml19_text_pressure(spark, d):
    """Whole documents by language and week, against the direction of the mean price."""
    first = F.lit("1995-01-02").cast("date")
    x = table(spark, d, "documents").select("lang", F.date_add(first, F.pmod("doc_id", F.lit(150)).cast("int") * 7).alias("date"), "text").filter("lang is not null and date is not null")
    p = predictions(spark, d).groupBy("date", "target_date").agg(F.avg("origin").alias("a"), F.avg("actual").alias("b"))
    rows = x.select("lang").distinct().join(F.broadcast(p.filter(F.col("date").between(first, F.date_add(first, 149 * 7)))))
    rows = rows.withColumn("label", text.market_label("a", "b", 50.0))
    return rounded(text.text_pressure(rows, ["lang"], text.gram_counts(x, ["lang", "date"], "text"), "label"))
