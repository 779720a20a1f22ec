"""Weekly documents from articles, labels, and double annotation."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.functions.prep import unaccented

from .align import articles_in_lookback
from .learn import known_before, per_series
from .score import cohen_kappa, stratified_sample

# The mark of a week without articles, and the longest part of an article in a document.
NO_NEWS = "__no_news__"
PART_CHARS = 3000
# The terms of fuel news by what they speak of, as plain text; the last four tell when a price would move.
FUEL_NEWS = {
    "direct": ["diesel s10", "diesel", "oleo diesel", "biodiesel"],
    "fuel": ["combustivel", "derivados", "gasoleo", "abastecimento"],
    "sector": [
        "petroleo", "brent", "refino", "refinaria", "petrobras", "barril", "opep", "importacao", "exportacao", "producao", "estoque",
    ],
    "cost": ["dolar", "cambio", "tribut", "imposto", "icms", "pis/cofins", "frete", "logistica"],
    "up": [
        "aumento de preco", "aumento do preco", "alta de preco", "alta do preco", "reajuste", "eleva imposto", "aumento de imposto",
        "aumenta imposto", "corte de producao", "reduz producao", "reducao da producao", "reduz oferta", "reducao da oferta",
        "queda da oferta", "paralisacao", "greve", "interrupcao", "escassez", "embargo", "sancoes", "conflito", "desvalorizacao do real",
        "alta do petroleo", "petroleo sobe", "dolar sobe",
    ],
    "down": [
        "reducao de preco", "reducao do preco", "queda de preco", "queda do preco", "reduz imposto", "reducao de imposto",
        "corte de imposto", "desoneracao", "isencao", "subsidio", "aumenta producao", "aumento da producao", "amplia producao",
        "aumenta oferta", "ampliacao da oferta", "amplia oferta", "alta da oferta", "valorizacao do real", "queda do petroleo",
        "petroleo cai", "dolar cai",
    ],
    "policy": [
        "consulta publica", "audiencia publica", "estudo", "seminario", "debate", "grupo de trabalho", "relatorio", "monitoramento",
        "agenda",
    ],
    "context": ["preco", "imposto", "producao", "oferta", "greve", "reajuste"],
    "1w": ["reajuste", "preco", "imposto", "greve", "paralisacao"],
    "2w": ["oferta", "producao", "estoque", "importacao", "refinaria", "refino"],
    "4w": ["biodiesel", "mistura", "resolucao", "regulament", "lei"],
    "long": ["investimento", "transicao", "plano", "2030", "2050"],
}
HORIZONS = ("1w", "2w", "4w", "long")
PERSONAS = ("supply_cost", "procurement_risk", "procurement_risk_calibrated")


def plain(c: Column) -> Column:
    """Lower case, without accents, white space squeezed, cut to the part length (a feature of weekly documents)."""
    return F.substring(F.trim(F.regexp_replace(F.lower(unaccented(c)), r"\s+", " ")), 1, PART_CHARS)


def weekly_lines(articles: DataFrame, origins: DataFrame, days: int, record: str, source: str, title: str, body: str, available: str = "available", sha: str = "sha", origin: str = "origin") -> DataFrame:
    """(origin, position, record, line): the lines of each origin's document, one an article, numbered in order of time and id.

    An origin without articles has one line, which says so, at position 0. NULL parts count as empty. No task holds a whole document:
    lines are ranked by a window that carries the line's article alone.
    """
    hit = articles_in_lookback(articles, origins, days, available, sha, record, origin)
    part = lambda c: F.coalesce(plain(F.col(c)), F.lit(""))
    line = F.concat_ws(" ", F.concat(F.lit("source_"), part(source)), part(title), part(body))
    place = F.row_number().over(W.partitionBy(origin).orderBy(available, record))
    lines = hit.select(origin, place.alias("position"), F.col(record).alias("record"), line.alias("line"))
    none = origins.select(origin).distinct().join(hit.select(origin).distinct(), origin, "left_anti")
    return lines.unionByName(none.select(origin, F.lit(0).alias("position"), F.lit(None).cast(articles.schema[record].dataType).alias("record"), F.lit(NO_NEWS).alias("line")))


def weekly_documents(articles: DataFrame, origins: DataFrame, days: int, record: str, source: str, title: str, body: str, available: str = "available", sha: str = "sha", origin: str = "origin") -> DataFrame:
    """(origin, n, document): the look-back's articles, one line each in order of time and id; a week without any says so.

    A document is as long as its articles are, at most two parts each, and is put together in one group: for look-backs that fit into a
    task. ``weekly_lines`` gives the same lines without that bound. NULL parts count as empty.
    """
    hit = articles_in_lookback(articles, origins, days, available, sha, record, origin)
    part = lambda c: F.coalesce(plain(F.col(c)), F.lit(""))
    line = F.concat_ws(" ", F.concat(F.lit("source_"), part(source)), part(title), part(body))
    docs = hit.groupBy(origin).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct(F.col(available).alias("a"), F.col(record).alias("r"), line.alias("t")))).alias("_x"))
    docs = docs.select(origin, "n", F.concat_ws("\n", F.transform("_x", lambda x: x["t"])).alias("document"))
    return origins.select(origin).distinct().join(docs, origin, "left").select(origin, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("document", F.lit(NO_NEWS)).alias("document"))


def weekly_signal_features(signals: DataFrame, keys: Sequence[str], count: str, directions: str, categories: str, category_names: Sequence[str]) -> DataFrame:
    """log1p count, shares of directions and categories, balance (positive less negative share); zero counts give zero shares."""
    n = F.col(count)
    share = lambda m, k: F.when(n > 0, F.coalesce(F.col(m)[k], F.lit(0)) / n).otherwise(0.0)
    x = signals.withColumns({"log_count": F.log1p(n), **{f"share_{k}": share(directions, k) for k in ("up", "down", "neutral")}, **{f"category_{k}": share(categories, k) for k in category_names}})
    return x.withColumn("balance", F.col("share_up") - F.col("share_down")).drop(count, directions, categories)


def signal_violations(signals: DataFrame, count: str, directions: str) -> DataFrame:
    """(rule, violations): negative counts, direction counts that don't add up."""
    total = F.aggregate(F.map_values(directions), F.lit(0).cast("long"), lambda a, x: a + x)
    one = signals.agg(F.count(F.when(F.coalesce(F.col(count) < 0, F.lit(True)), 1)).alias("negative_count"), F.count(F.when(F.coalesce(total != F.col(count), F.lit(True)), 1)).alias("direction_sum"))
    return one.unpivot([], ["negative_count", "direction_sum"], "rule", "violations")


def market_label(now: str, later: str, threshold: float) -> Column:
    """-1, 0 or 1 by the coming move; moves of the threshold itself count as 0."""
    d = F.col(later) - F.col(now)
    return F.when(d > threshold, 1).when(d < -threshold, -1).when(d.isNotNull(), 0)


def annotation_batch(df: DataFrame, strata: Sequence[str], ident: str, relevant: Column, n: int, fraction: float, slots: int, seed: int) -> DataFrame:
    """n items, the given share from the relevant pool and the rest from the control pool, once per slot.

    A pool that is too small gives what it has, and the other pool the rest. Item ids are the first 16 digits of sha256('seed:id').
    """
    want = round(n * fraction)
    # each pool is drawn to n at most, ranked, and the quotas are decided from the two pool sizes
    draw = lambda d, s: stratified_sample(d.select(*strata, ident), strata, ident, n, s)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")), 256)
    pools = draw(df.filter(relevant), seed).withColumn("pool", F.lit("relevant")).unionByName(draw(df.filter(~F.coalesce(relevant, F.lit(False))), seed).withColumn("pool", F.lit("control")))
    ranked = pools.withColumns({"_h": order, "_i": F.row_number().over(W.partitionBy("pool").orderBy(order))})  # 2n rows at most
    sizes = ranked.agg(F.count(F.when(F.col("pool") == "relevant", 1)).alias("_r"), F.count(F.when(F.col("pool") == "control", 1)).alias("_c"))
    ranked = ranked.join(F.broadcast(sizes), how="cross")  # one row
    r = F.least(F.greatest(F.lit(want), n - F.col("_c")), F.col("_r"))
    took = ranked.filter(F.when(F.col("pool") == "relevant", F.col("_i") <= r).otherwise(F.col("_i") <= n - r))
    return took.select(F.substring("_h", 1, 16).alias("item_id"), ident, *strata, "pool", F.explode(F.sequence(F.lit(1), F.lit(slots))).alias("slot"))


def annotation_violations(df: DataFrame, item: str, slot: str, annotator: str, labels: dict[str, Sequence[str]], stamp: str | None = None) -> DataFrame:
    """(rule, violations): an item twice in a slot, items not in all slots, one annotator in several slots, labels outside their domain and,
    with a column of time stamps (text), those that can't be read as a time."""
    rules = [df.groupBy(item, slot).count().filter("count > 1").agg(F.count(F.lit(1)).alias("violations")).withColumn("rule", F.lit("duplicate"))]
    slots = df.agg(F.count_distinct(slot).alias("_s"))
    each = df.groupBy(item).agg(F.count_distinct(slot).alias("_n"), (F.count_distinct(annotator) < F.count_distinct(slot)).alias("_same"))
    rules += [each.join(F.broadcast(slots), how="cross").agg(F.count(F.when(F.col("_n") != F.col("_s"), 1)).alias("violations")).withColumn("rule", F.lit("unequal_slots"))]  # one row
    rules += [each.agg(F.count(F.when(F.col("_same"), 1)).alias("violations")).withColumn("rule", F.lit("same_annotator"))]
    rules += [df.agg(F.count(F.when(F.col(c).isNull() | ~F.col(c).isin(*v), 1)).alias("violations")).withColumn("rule", F.lit(f"domain_{c}")) for c, v in labels.items()]
    if stamp:
        rules += [df.agg(F.count(F.when(F.try_to_timestamp(F.col(stamp)).isNull(), 1)).alias("violations")).withColumn("rule", F.lit("timestamp"))]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out.select("rule", "violations")


def slot_agreement(df: DataFrame, item: str, slot: str, labels: Sequence[str]) -> DataFrame:
    """(label, n, observed, kappa) of slot 1 against slot 2; the list of labels is short."""
    one, two = (df.filter(F.col(slot) == s).select(item, *[F.col(c).alias(f"{c}_{s}") for c in labels]) for s in (1, 2))
    both, out = one.join(two, item), None
    for c in labels:
        k = cohen_kappa(both, f"{c}_1", f"{c}_2").withColumn("label", F.lit(c))
        out = k if out is None else out.unionByName(k)
    return out.select("label", "n", "observed", "kappa")


def merge_slots(slots: Sequence[DataFrame], item: str, fixed: Sequence[str]) -> DataFrame:
    """The union of slot tables with ``changed``: whether a source field of the item differs between them."""
    both = slots[0]
    for s in slots[1:]:
        both = both.unionByName(s, allowMissingColumns=True)
    changed = both.groupBy(item).agg((F.size(F.collect_set(F.struct(*fixed))) > 1).alias("changed"))
    return both.join(changed, item)


def disagreements(a: DataFrame, b: DataFrame, item: str, labels: Sequence[str]) -> DataFrame:
    """(item, fields): comma-joined labels that differ (NULLs are equal to each other); an item on one side only differs in all."""
    x = a.select(item, F.lit(1).alias("_a"), *[F.col(c).alias(f"{c}_a") for c in labels]).join(b.select(item, F.lit(1).alias("_b"), *[F.col(c).alias(f"{c}_b") for c in labels]), item, "full")
    alone = F.col("_a").isNull() | F.col("_b").isNull()
    fields = F.concat_ws(",", F.array_compact(F.array(*[F.when(alone | ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")), F.lit(c)) for c in labels])))
    return x.select(item, fields.alias("fields")).filter("fields <> ''")


def lexicon_label(
    df: DataFrame, text: str, personas: Sequence[str] = PERSONAS, terms: dict[str, Sequence[str]] = FUEL_NEWS, most_terms: int = 6
) -> DataFrame:
    """Weak labels of every row by every persona: its columns, persona, relevance (0-3), direction, intensity (0-3), horizon, evidence.

    A term counts if the plain text (lower case, no accents, single spaces) contains it. Relevance is 3 for a direct term, 2 for
    a fuel term or for sector and cost together; a single sector or cost term is worth 1, but ``procurement_risk`` asks for
    two of them and its calibrated form for a text without terms of mere policy. Terms of both directions, or none, are
    uncertain (neutral if the text speaks of mere policy); ``procurement_risk`` also asks for a context term. Only
    ``supply_cost`` gives the full relevance as intensity. Evidence is the first terms found, in the order of the lists.

    A NULL or empty text is irrelevant and has no evidence. Columns with the names of the labels are replaced.
    """
    odd = set(personas) - set(PERSONAS)
    if odd:
        raise ValueError(f"unknown personas: {sorted(odd)}")
    plain = F.trim(F.regexp_replace(F.lower(unaccented(F.coalesce(F.col(text), F.lit("")))), "(?U)\\s+", " "))
    found = [F.filter(F.array(*[F.lit(t) for t in terms[c]]), lambda t: F.contains(F.col("_t"), t)).alias(c) for c in FUEL_NEWS]
    x = df.withColumn("_t", plain).withColumn("_m", F.struct(*found)).drop("_t")
    x = x.withColumn("persona", F.explode(F.array(*[F.lit(p) for p in personas])))
    n = {c: F.size(F.col("_m")[c]) for c in FUEL_NEWS}
    risk, calibrated = F.col("persona") == "procurement_risk", F.col("persona") == "procurement_risk_calibrated"
    indirect, policy = n["sector"] + n["cost"], n["policy"] > 0
    alone = F.when(risk, indirect >= 2).otherwise((indirect > 0) & ~(calibrated & policy)).cast("int")
    relevance = F.when(n["direct"] > 0, 3).when((n["fuel"] > 0) | (n["sector"] > 0) & (n["cost"] > 0), 2).otherwise(alone)
    undecided = F.when(policy, "neutral").otherwise("uncertain")
    direction = (
        F.when(F.col("relevance") == 0, "neutral").when((n["up"] > 0) & (n["down"] > 0), "uncertain")
        .when(risk & (n["context"] == 0), undecided).when(n["up"] > 0, "up").when(n["down"] > 0, "down").otherwise(undecided)
    )
    neutral = F.col("direction") == "neutral"  # an irrelevant text is neutral, too
    sized = F.when(F.col("persona") == "supply_cost", F.col("relevance")).otherwise(F.greatest(F.lit(1), F.col("relevance") - 1))
    intensity = F.when(neutral, 0).when(F.col("direction") == "uncertain", 1).otherwise(sized)
    horizon = F.when(neutral, "unknown")
    for c in HORIZONS:
        horizon = horizon.when(n[c] > 0, c)
    hits = F.array_distinct(F.concat(*[F.col("_m")[c] for c in ("direct", "fuel", "sector", "cost", "up", "down")]))
    x = x.withColumn("relevance", relevance).withColumn("direction", direction)
    labels = {"intensity": intensity, "horizon": horizon.otherwise("unknown"), "evidence": F.concat_ws(",", F.slice(hits, 1, most_terms))}
    return x.withColumns(labels).drop("_m")


def gram_counts(docs: DataFrame, keys: Sequence[str], text: str, n_features: int = 2**14) -> DataFrame:
    """(keys, grams): how often each hashed word and pair of neighbouring words occurs in all texts of a key.

    Words have two characters or more, in lower case without accents. Counts are added up before anything is gathered, so a key
    has ``n_features`` entries at most, however many texts it has. A NULL text has no words.
    """
    flat = F.regexp_replace(F.lower(unaccented(F.col(text))), "_", " ")
    words = F.regexp_extract_all(flat, F.lit("(?U)\\w{2,}"), F.lit(0))
    pairs = F.when(F.size("_w") > 1, F.zip_with(F.slice("_w", 1, F.size("_w") - 1), F.slice("_w", 2, F.size("_w") - 1), lambda a, b: F.concat_ws(" ", a, b)))
    x = docs.select(*keys, words.alias("_w")).filter(F.size("_w") > 0)
    x = x.select(*keys, F.explode(F.concat("_w", F.coalesce(pairs, F.array().cast("array<string>")))).alias("_g"))
    x = x.groupBy(*keys, F.pmod(F.xxhash64("_g"), F.lit(n_features)).cast("int").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    return x.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("gram", "n"))).alias("grams"))


CLASSES = (-1, 0, 1)


def text_pressure(rows: DataFrame, keys: Sequence[str], grams: DataFrame, label: str, n_features: int = 2**14, alpha: float = 1e-4, min_train: int = 52, shrink: float = 0.2, date: str = "date", target_date: str = "target_date") -> DataFrame:
    """(keys, date, p_down, p_neutral, p_up, score, confidence, entropy, predicted, trained): the direction that the week's texts
    point to, by one logistic model a class, learned online along each series.

    ``grams`` is ``gram_counts`` by (keys, date). Before an origin the model learns the labels (-1, 0, 1; NULL is skipped) whose
    target date has come, one step of gradient descent each, on grams of unit length. Probabilities are shrunk to the smoothed
    class shares, which stand alone before ``min_train`` labels. A week without texts has only the intercepts.
    """
    if not 0 < alpha < 0.5:
        raise ValueError("alpha lies between 0 and 0.5")
    x = rows.select(*keys, date, target_date, F.col(label).cast("double").alias("_label")).join(grams, [*keys, date], "left")
    x = x.withColumns({"_i": F.col("grams.gram"), "_n": F.col("grams.n")}).drop("grams")

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        known, labels = known_before(pdf[date], pdf[target_date]), pdf["_label"].to_numpy(float)
        at, size = [], []
        for i, n in zip(pdf["_i"], pdf["_n"]):
            some = i is not None and not np.isscalar(i)
            at.append(np.asarray(i, int) if some else np.zeros(0, int))
            size.append(np.asarray(n, float) / np.linalg.norm(np.asarray(n, float)) if some else np.zeros(0))
        w, b, share, t, done, out = np.zeros((3, n_features)), np.zeros(3), np.ones(3), 0, 0, []
        scale, late = 1.0, alpha**-0.75
        for i in range(len(pdf)):
            while done < known[i]:
                j, done = done, done + 1
                if not np.isfinite(labels[j]):
                    continue
                eta, t = 1 / (alpha * (late + t)), t + 1
                y = np.where(np.array(CLASSES) == labels[j], 1.0, -1.0)
                z = y * (scale * (w[:, at[j]] @ size[j]) + b)
                pull = eta * y / (1 + np.exp(np.clip(z, -700, 700)))
                scale *= 1 - eta * alpha  # the decay of all weights, kept as one factor
                w[:, at[j]] += pull[:, None] / scale * size[j]
                b += pull
                share[CLASSES.index(int(labels[j]))] += 1
            prior = share / share.sum()
            p = prior
            if t >= min_train:
                raw = 1 / (1 + np.exp(np.clip(-(scale * (w[:, at[i]] @ size[i]) + b), -700, 700)))
                p = (1 - shrink) * (raw / raw.sum() if raw.sum() > 0 else np.full(3, 1 / 3)) + shrink * prior
                p = np.maximum(p, 1e-12) / np.maximum(p, 1e-12).sum()
            out.append((*p, p[2] - p[0], p.max(), -(p * np.log(p)).sum() / np.log(3), float(CLASSES[int(p.argmax())]), float(t)))
        return pd.DataFrame(out, columns=PRESSURE)

    return per_series(x, keys, PRESSURE, step, date)


PRESSURE = ["p_down", "p_neutral", "p_up", "score", "confidence", "entropy", "predicted", "trained"]
