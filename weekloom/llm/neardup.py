"""Near-duplicate documents: ProbMinHash over word shingles, banding, verification, classes.

A document is its set of five-word shingles. Every shingle is a Poisson process whose rate is its weight; its arrivals,
drawn from a hash of the shingle, fall on random components, and each component keeps its earliest arrival. A shingle
stops as soon as its next arrival is later than the latest component (early termination). Two documents agree in a
component with a chance equal to their probability Jaccard similarity. Links are judged by the sets, so each distinct shingle
weighs 1, however often it occurs: the probability Jaccard is then the sets' Jaccard, in texts with repeated sentences too.

Exact copies (equal word sequences) are first reduced to one text, so a group of copies costs one row. Texts that share
a band of components are candidates; similarity is verified on the exact shingle sets (Jaccard >= threshold), for pairs
whose set sizes allow it. In each round every text of a band is compared with one of its texts only (first the oldest, then
others by hash), and bands that lie within one component of the links found so far are settled. Rounds go on while they find
many links. Then, in bands that still span several components, all texts are compared in blocks of bounded size, and only
the links across components come out. So no link that could join two components is lost, while a large group of near
copies, or of texts that are nearly similar, emits no pairs.

With 25 bands of 5 components, two texts at 0.8 become candidates with probability 0.99995.

Texts are equal when BLAKE2b of their words is (128 bits). Shingle sets are sets of 32-bit hashes: two different shingles of a
pair of texts fall together with a chance of 2**-32, which moves the similarity of two texts of 20,000 words by less than 1e-5.

Defined cases: a text of one to four words is one shingle; null and wordless texts link to nothing and are classes of
their own; rows with a null id take part, and a class's id is its smallest id (null if it has none; class_row tells such
classes apart); rows are told apart by row, so repeated ids do no harm. Of a class, the stage keeps one of the rows with the
smallest id, in its own columns.
"""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesplit import Words, mixed, rolling, steps, whole
from .carry import ROW, quoted, row_of
from .scratch import staged

SHINGLE, BANDS, ROWS, THRESHOLD = 5, 25, 5, 0.8
WORDED = "[^\\x20\\x09-\\x0D]"
#: Rounds go on while they find a link for one in so many members of bands.
ENOUGH = 100
#: Bounds of a block of texts in the last step.
BLOCK_TEXTS, BLOCK_GRAMS = 1024, 500_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(w: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, shingle hash), sorted by doc; shorter texts are one shingle."""
    h, counts = w.hashes(), w.counts
    doc = w.doc()
    ok = whole(w.off, width, len(h))
    docs, keys = [doc[: len(ok)][ok]], [rolling(h, width)[ok]]
    for short in range(1, width):
        at = np.flatnonzero(counts == short)
        if len(at):
            docs.append(at)
            keys.append(rolling(h, short)[w.off[at]])
    docs, keys = np.concatenate(docs), np.concatenate(keys)
    order = np.lexsort((keys, docs))
    docs, keys = docs[order], keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    return docs[first], keys[first]


def prob_min_hash(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m signatures: the (32-bit hash of the) shingle that arrives first in each component; 0 for no shingle."""
    least = np.full((n_docs, m), np.iinfo(np.uint64).max, np.uint64)
    flat = least.reshape(-1)
    t = np.zeros(len(key))
    own = (key >> np.uint64(32)).astype(np.uint64)
    latest = np.full(n_docs, np.inf)
    step = 0
    while len(key):
        step += 1
        r = mixed(key + np.uint64(step * int(_GOLD) % (1 << 64)))
        t = t - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight
        live = t < latest[doc]
        doc, key, weight, t, own, r = doc[live], key[live], weight[live], t[live], own[live], r[live]
        component = ((mixed(r) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        arrival = (t.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | own
        np.minimum.at(flat, doc * m + component, arrival)
        some = np.unique(doc)
        worst = least[some].max(axis=1)
        full = worst != np.iinfo(np.uint64).max
        # a little above the rounded time, so that rounding to 32 bits never ends a process early
        latest[some[full]] = (worst[full] >> np.uint64(32)).astype(np.uint32).view(np.float32).astype(np.float64) * (1 + 1e-6)
        live = t < latest[doc]
        doc, key, weight, t, own = doc[live], key[live], weight[live], t[live], own[live]
    return np.where(least == np.iinfo(np.uint64).max, 0, least & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _text_keys(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a 128-bit hash of each text's word sequence (its words, joined by one space)."""
    take = w.inside.copy()
    take[w.end[w.end < len(w.data)]] = True  # the byte after a word, if it belongs to the same text, stands for the space
    words = np.where(w.inside, w.data, 32).astype(np.uint8)[take]
    cut = np.concatenate([[0], np.cumsum(take)])[w.byte_off]
    raw = words.tobytes()
    digests = b"".join(blake2b(raw[a:b].strip(b" "), digest_size=16).digest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    keys = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return keys[:, 0].copy(), keys[:, 1].copy()


def signed(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """(row, id, text_hash, k1, k2, bands, n_grams, grams): two keys of the word sequence, band hashes, the shingle set and its size."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in steps(batch.column(3)):
                w, n = Words(data, off), b - a
                doc, key = shingles(w)
                sig = prob_min_hash(doc, key, np.ones(len(key)), n, bands * rows).reshape(n, bands, rows)
                band = np.full((n, bands), _GOLD) * np.arange(1, bands + 1, dtype=np.uint64)
                for k in range(rows):
                    band = mixed(band ^ sig[:, :, k])
                cut = np.searchsorted(doc, np.arange(n + 1))
                none = w.counts == 0
                band_off = np.concatenate([[0], np.cumsum(np.where(none, 0, bands))])
                part = batch.slice(a, n)
                k1, k2 = _text_keys(w)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), part.column(2), pa.array(k1), pa.array(k2),
                    pa.ListArray.from_arrays(pa.array(band_off, pa.int32()), pa.array(band[~none].ravel().view(np.int64))),
                    pa.array(np.diff(cut), pa.int32()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array((key >> np.uint64(16)).astype(np.uint32).view(np.int32))),
                ], names=["row", "id", "text_hash", "k1", "k2", "bands", "n_grams", "grams"])

    asked = docs.select(F.monotonically_increasing_id().alias("row"), quoted(id_col).cast("long").alias("id"), F.xxhash64(quoted(text_col)).alias("text_hash"), quoted(text_col).cast("string").alias("t"))
    return asked.mapInArrow(sign, "row long, id long, text_hash long, k1 long, k2 long, bands array<long>, n_grams int, grams array<int>")


def verified(pairs: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least ``threshold``."""
    one = pairs.join(grams.select(F.col("row").alias("a"), F.col("grams").alias("ga")), "a")
    two = one.join(grams.select(F.col("row").alias("b"), F.col("grams").alias("gb")), "b")
    both = F.size(F.array_intersect("ga", "gb"))
    return two.select("a", "b", both.alias("n"), (F.size("ga") + F.size("gb") - both).alias("u")).filter(F.col("n") >= threshold * F.col("u") - 1e-9).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, component): connected components of (a, b), named by their smallest node.

    Each round hooks every component (at first every node) to its smallest neighbour, follows these pointers to their ends by
    doubling them (pointer jumping), and draws the edges anew between components. A component that has an edge left
    is hooked in this round or the next, so rounds are logarithmic; edges shrink, and no neighbourhood is ever gathered.
    """
    edges = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = None
    while True:
        up = staged(edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("up")), "hooks")
        while True:
            far = up.select(F.col("a").alias("up"), F.col("up").alias("far"))
            jumped = staged(up.join(far, "up").select("a", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved")), "jumps")
            up = jumped.select("a", "up")
            if not jumped.filter("moved").limit(1).count():
                break
        if labels is None:
            labels = up.select(F.col("a").alias("node"), F.col("up").alias("component"))
        else:
            hooked = up.select(F.col("a").alias("component"), "up")
            labels = staged(labels.join(hooked, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        one = edges.join(up, "a").select(F.col("up").alias("a"), "b")
        two = one.join(up.select(F.col("a").alias("b"), F.col("up").alias("to")), "b").select("a", F.col("to").alias("b"))
        edges = staged(two.filter("a <> b").distinct(), "edges")
        if not edges.limit(1).count():
            return labels


def _alike(n, m, threshold: float):
    """Sets of these sizes can have the similarity."""
    return F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9


def _open(named: DataFrame) -> DataFrame:
    """Members of the bands that span several components."""
    bands = named.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("band")
    return staged(named.join(staged(bands, "open-bands"), "band"), "open")


def _star(named: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs of each text with the centre of its band, the oldest in round 0, one by hash in later rounds."""
    order = F.col("a") if k == 0 else F.xxhash64("a", F.lit(k))
    centre = named.groupBy("band").agg(F.min_by(F.struct("a", "n", "component"), order).alias("c"))
    centre = staged(centre, "centres")  # a plain table: Spark can split the texts of a hot band, or broadcast few centres
    pairs = named.join(centre, "band").filter((F.col("component") != F.col("c.component")) & _alike(F.col("n"), F.col("c.n"), threshold))
    return staged(pairs.select(F.greatest("a", "c.a").alias("a"), F.least("a", "c.a").alias("b")).distinct(), "star")


def _rest(named: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """Links between texts of a band that lie in different components, checked in blocks of bounded size.

    A band's texts are dealt into blocks; each pair of blocks is one group, in which the sizes of all intersections come
    from one sparse product. Only links leave the group, never pairs.
    """
    bands = named.groupBy("band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_TEXTS, F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    bands = staged(bands, "blocks")  # its size is then known, and a hot band's texts are dealt before they are shuffled
    dealt = named.join(bands, "band").withColumn("i", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "a", "component", "i", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"))
    full = dealt.join(grams.withColumnRenamed("row", "a"), "a").select("band", "low", "high", "a", "component", "i", "grams")

    def compare(table: pa.Table) -> pa.Table:
        node, component, block = (table[c].to_numpy() for c in ("a", "component", "i"))
        cross = table["low"][0].as_py() != table["high"][0].as_py()
        lists = table["grams"].combine_chunks()
        lens = np.diff(lists.offsets.to_numpy())
        values, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(node)), lens)
        kinds, at, often = np.unique(values, return_inverse=True, return_counts=True)
        shared = often[at] > 1
        of, at = of[shared], (np.cumsum(often > 1) - 1)[at[shared]]
        order = np.argsort(at, kind="stable")
        of, at = of[order], at[order]
        both = np.zeros((len(node), len(node)), np.float32)
        for c in range(0, int((often > 1).sum()), 4096):
            x, y = np.searchsorted(at, [c, c + 4096])
            part = np.zeros((len(node), 4096), np.float32)
            part[of[x:y], at[x:y] - c] = 1
            both += part @ part.T
        ok = both >= threshold * (lens[:, None] + lens[None, :] - both) - 1e-6
        ok &= (component[:, None] != component[None, :]) & (node[:, None] > node[None, :])
        if cross:
            ok &= block[:, None] != block[None, :]
        a, b = np.nonzero(ok)
        return pa.table({"a": pa.array(node[a], pa.int64()), "b": pa.array(node[b], pa.int64())})

    return full.groupBy("band", "low", "high").applyInArrow(compare, "a long, b long").distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(row, id, text_hash, class_row, class_id), one row per input row; class_row names the class, class_id is its smallest id."""
    own = staged(signed(docs, id_col, text_col, bands, rows), "signed")
    texts = own.filter(F.size("bands") > 0).groupBy("k1", "k2").agg(F.min("row").alias("rep"), F.min("id").alias("least_id"), F.first("bands").alias("bands"), F.first("n_grams").alias("n"))
    texts = staged(texts, "texts")
    member = texts.select(F.explode("bands").alias("band"), F.col("rep").alias("a"), "n")
    shared = member.groupBy("band").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("band")
    member = staged(member.join(shared, "band"), "members")
    # always by sort-merge: the sets are large, and the texts with candidates grow with the corpus
    grams = staged(own.select("row", "grams").hint("merge").join(member.select(F.col("a").alias("row")).distinct(), "row", "left_semi"), "grams")
    links, found, named, k = None, None, member.withColumn("component", F.col("a")), 0
    while True:
        named = _open(named)
        new = staged(verified(_star(named, k, threshold), grams, threshold), "links")
        links = new if links is None else links.unionByName(new)
        found = components(links)
        named = named.drop("component").join(found.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
        named, k = staged(named, "named"), k + 1
        if new.count() * ENOUGH <= member.count():
            break
    late = staged(_rest(_open(named), grams, threshold), "late-links")
    if late.limit(1).count():
        found = components(links.unionByName(late))
    placed = texts.select("k1", "k2", "rep", "least_id").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = placed.groupBy("component").agg(F.min("least_id").alias("class_id"))
    placed = placed.select("k1", "k2", "component").join(named, "component")
    lone = F.size("bands") <= 0
    out = own.select("row", "id", "text_hash", "k1", "k2", lone.alias("lone")).join(placed, ["k1", "k2"], "left")
    return out.select("row", "id", "text_hash", F.when(F.col("lone"), F.col("row")).otherwise(F.col("component")).alias("class_row"), F.when(F.col("lone"), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))


def near_dup_query(spark, sf_dir: str) -> DataFrame:
    """One row per document with its class: the smallest doc_id among its near-duplicates."""
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("id").alias("doc_id"), "class_id")


#: All pairs that share a shingle are compared, and classes follow by a transitive closure: for small tables only.
NEAR_DUP_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT w, min(doc_id) AS rep FROM d WHERE len(w) > 0 GROUP BY w),
s AS (SELECT DISTINCT rep, hash(g) AS g FROM (SELECT rep, array_to_string(w[p + 1:p + 5], ' ') AS g FROM (SELECT rep, w, unnest(range(greatest(1, len(w) - 4))) AS p FROM u))),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
l AS (SELECT x.rep AS a, y.rep AS b FROM s x JOIN s y ON x.g = y.g AND x.rep < y.rep GROUP BY x.rep, y.rep
      HAVING count(*) >= 0.8 * ((SELECT n FROM n WHERE n.rep = x.rep) + (SELECT n FROM n WHERE n.rep = y.rep) - count(*)) - 1e-9),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT rep AS node, rep AS seen FROM u UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node AND r.seen < e.b),
c AS (SELECT node, min(seen) AS class_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id FROM d LEFT JOIN u ON u.w = d.w LEFT JOIN c ON c.node = u.rep
"""


def near_dup_stage(spark, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """One document of each class: the one with the smallest doc_id; wordless texts are classes of their own and all stay."""
    last = F.lit(2**63 - 1).cast("long")
    found = near_classes(docs)
    kept = found.groupBy("class_row").agg(F.min(F.struct(F.coalesce("id", last).alias("_i"), F.col("text_hash").alias("_h"))).alias("k")).select("k.*").distinct()
    worded = F.coalesce(F.col("text").cast("string").rlike(WORDED), F.lit(False))
    apart = F.when(worded, F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id())
    keys = [F.coalesce(F.col("doc_id").cast("long"), last).alias("_i"), F.xxhash64("text").alias("_h"), apart.alias("_apart")]
    own = docs.select(row_of(docs.columns).alias(ROW), *keys)
    return own.join(kept, ["_i", "_h"], "left_semi").dropDuplicates(["_i", "_h", "_apart"]).select(f"{ROW}.*")
