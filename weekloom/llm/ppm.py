"""Language-model scores by prediction by partial matching over bytes, beside a word unigram base.

The model is a byte-context trie of depth ``order``: how often each byte follows each context of up to so many bytes in
the training texts, summed over the corpus. A byte that the longest context has seen is coded with method C; otherwise an
escape is coded and the shorter context tries, with the symbols that the longer one has seen excluded (symbol exclusion),
down to the uniform distribution over the symbols that are left. A text is coded from ``order`` start symbols to an end
symbol; the byte 0xFF, which UTF-8 never holds, stands for both. The code length is pretrained, so a document's score
doesn't depend on its neighbours.

The trie grows with the corpus and is neither collected nor broadcast. Each segment sends its distinct grams (a context
and a symbol) with their training counts to the buckets that own them, and gets their log probabilities back. A bucket
owns whole subtrees: all contexts that end in the same three bytes. Only the two lowest orders, which have at most 2**24 leaves
whatever the corpus, are sent to all tasks, for what escapes from the subtrees.

The base adds up log10((c + 0.5) / (N + 0.5 (V + 1))) over the words and the end token. Vocabularies grow with the corpus, so
counts are neither collected nor broadcast: each segment sends its distinct words, once, to the buckets that own
them, and gets their corpus counts back (see ``segments``).

Held out are documents with crc32(id as text) mod 5 = 1; they add to no count. Defined cases: a null text counts as empty
(one end token); a null id has crc32 of the empty text; with no training text, all probabilities are uniform.
"""
from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesplit import Words, mixed
from .scratch import staged
from .segments import Layout, Segment, bucket_of, cuts, each, planes, segments, unplanes

MARK = 0xFF
#: Context bytes of the query's model.
ORDER = 5
#: Contexts that end in the same so many bytes are in one bucket.
STEM = 3
#: Hash that stands for the end token.
END_HASH = np.uint64(0x5851F42D4C957F2D)


def held_out(ids: np.ndarray, nulls: np.ndarray | None = None, folds: int = 5, fold: int = 1) -> np.ndarray:
    nulls = np.zeros(len(ids), bool) if nulls is None else nulls
    return np.array([zlib.crc32(b"" if no else str(int(i)).encode()) % folds == fold for i, no in zip(ids, nulls, strict=True)], bool)


def coded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(three-byte codes, n+1 offsets): two context bytes and a symbol for every byte of each text and its end."""
    n = len(off) - 1
    size = np.diff(off)
    out = np.full(len(data) + 3 * n, MARK, np.uint32)
    out[np.arange(len(data)) + 2 + 3 * np.repeat(np.arange(n), size)] = data
    code = (out[:-2] << 16) | (out[1:-1] << 8) | out[2:] if len(out) else out
    first = np.concatenate([[0], np.cumsum(size + 1)])
    keep = np.arange(first[-1]) + 2 * np.repeat(np.arange(n), size + 1)
    return code[keep], first


def trie_counts(segs: DataFrame) -> DataFrame:
    """(code, n) over the training texts; each task adds up what it reads before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 24, np.uint32)
        for seg in each(batches):
            code, first = coded(seg.data, seg.off)
            train = np.repeat(~held_out(seg.ids, seg.nulls), np.diff(first))
            some, n = np.unique(code[train], return_counts=True)
            if n.size and int(total.max()) + int(n.max()) >= 1 << 32:
                yield _counts(total)
                total[:] = 0
            total[some] += n.astype(np.uint32)
        yield _counts(total)

    return segs.mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _counts(total: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(total)
    return pa.RecordBatch.from_pydict({"code": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})


def log_table(code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 probability of every (context pair, symbol), 2**24 values, from the trie's counts."""
    two = np.zeros(1 << 24, np.float32)
    two[code] = n
    two = two.reshape(256, 256, 256)
    one = two.sum(axis=0, dtype=np.float64)
    zero = one.sum(axis=0)
    seen1, seen0 = one > 0, zero > 0
    left = 256 - seen0.sum()
    rest = 1.0 / left if left else 1.0
    t0, d0 = np.where(seen1, 0, zero).sum(axis=1), (~seen1 & seen0).sum(axis=1)  # by the last byte, its symbols excluded
    with np.errstate(divide="ignore", invalid="ignore"):
        escape0 = np.where(t0 > 0, d0 / (t0 + d0), 1.0)[:, None]
        low = np.where(seen0[None, :], zero[None, :] / (t0 + d0)[:, None], escape0 * rest)  # where the last byte has not seen the symbol
        out = np.empty((256, 256, 256), np.float32)
        for a in range(256):  # the first context byte
            n2, seen2 = two[a], two[a] > 0
            t2, d2 = n2.sum(axis=1, dtype=np.float64), seen2.sum(axis=1)
            t1, d1 = np.where(seen2, 0, one).sum(axis=1), (~seen2 & seen1).sum(axis=1)
            escape2 = np.where(t2 > 0, d2 / (t2 + d2), 1.0)[:, None]
            escape1 = np.where(t1 > 0, d1 / (t1 + d1), 1.0)[:, None]
            middle = np.where(seen1, one / (t1 + d1)[:, None], escape1 * low)
            out[a] = np.log10(np.where(seen2, n2 / (t2 + d2)[:, None], escape2 * middle))
    return out.ravel()


class Trie:
    """The two lowest orders, sent to the tasks as counts; each Python worker lays out the table once."""

    _laid: dict = {}

    def __init__(self, key: str, code: np.ndarray, n: np.ndarray):
        order = np.argsort(code)
        self.key, self.code, self.n = key, code[order], n[order]

    def counts(self, code: np.ndarray) -> np.ndarray:
        if not len(self.code):
            return np.zeros(len(code), np.int64)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.n[at], 0)

    def pairs(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many bytes follow each context pair, and of how many kinds."""
        own = self.code >> 8
        return np.bincount(own, self.n, 1 << 16)[pair], np.bincount(own, minlength=1 << 16)[pair]

    def table(self) -> np.ndarray:
        if self.key not in Trie._laid:
            Trie._laid.clear()
            Trie._laid[self.key] = log_table(self.code, self.n)
        return Trie._laid[self.key]


def grams(data: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, n+1 offsets): the context from its last byte to its first, and the symbol, for every byte of each text and its end."""
    n = len(off) - 1
    size = np.diff(off)
    out = np.full(len(data) + (order + 1) * n, MARK, np.uint8)
    out[np.arange(len(data)) + order + (order + 1) * np.repeat(np.arange(n), size)] = data
    first = np.concatenate([[0], np.cumsum(size + 1)])
    keep = np.arange(first[-1]) + order + order * np.repeat(np.arange(n), size + 1)
    code = np.zeros(len(keep), np.uint64)
    for back in (*range(1, order + 1), 0):
        code <<= np.uint64(8)
        code |= out[keep - back]
    return code, first


def _dealt(kinds: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which distinct grams lie by bucket, and the buckets' offsets."""
    stem = kinds >> np.uint64(8 * (order + 1 - min(order, STEM)))
    bucket = bucket_of(mixed(stem + np.uint64(1)), buckets)
    by = np.argsort(bucket, kind="stable")
    return by, np.searchsorted(bucket[by], np.arange(buckets + 1))


def log_scores(kinds: np.ndarray, count: np.ndarray, order: int, low: Trie) -> np.ndarray:
    """log10 probability of each of the sorted distinct grams, which hold whole subtrees, from their counts."""
    byte = lambda k: ((kinds >> np.uint64(8 * k)) & np.uint64(0xFF)).astype(np.int64)
    pair = (byte(order - 1) << 8) | byte(order)
    code = (pair << 8) | byte(0)
    own2, (t2, d2) = low.counts(code), low.pairs(pair)
    own, total, seen, excluded = {2: own2}, {2: t2}, {2: d2}, {}
    for j in range(STEM, order + 1):
        context = kinds >> np.uint64(8 * (order - j + 1))
        starts = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(kinds) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(kinds))))
        _, first, at = np.unique((context << np.uint64(8)) | (kinds & np.uint64(0xFF)), return_index=True, return_inverse=True)
        n = np.bincount(at, count, len(first))
        first, some = first[n > 0], n[n > 0]
        own[j], total[j] = n[at], np.bincount(of[first], some, len(starts))[of]
        seen[j] = np.bincount(of[first], minlength=len(starts))[of]
        # what the context's symbols count in the next shorter one
        excluded[j] = np.bincount(of[first], own[j - 1][first], len(starts))[of]
    out, entered, open_ = np.zeros(len(kinds)), np.zeros(len(kinds), bool), np.ones(len(kinds), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for j in range(order, 1, -1):
            t, d = total[j], seen[j]
            if j < order:
                t, d = t - excluded[j + 1], d - seen[j + 1]
            if j == 2:
                table = low.table()[code].astype(np.float64)
                out = np.where(open_ & ~entered, table, out)
                open_ &= entered
            found = open_ & (own[j] > 0)
            out = np.where(found, out + np.log10(own[j] / (t + d)), out)
            open_ &= ~found
            out = np.where(open_ & (t > 0), out + np.log10(d / (t + d)), out)
            entered |= seen[j] > 0
        # the table's value is that of the pair's escape and what comes below; the escape is already in
        out = np.where(open_, out + table - np.log10(d2 / (t2 + d2)), out)
    return out.astype(np.float32)


def gram_scores(segs: DataFrame, layout: Layout, order: int, trie) -> DataFrame:
    """(seg, bucket, scores): the log probabilities of each segment's distinct grams, by bucket."""
    buckets = layout.buckets

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg in each(batches):
            code, first = grams(seg.data, seg.off, order)
            train = np.repeat(~held_out(seg.ids, seg.nulls), np.diff(first))
            code = np.sort((code << np.uint64(1)) | train.astype(np.uint64))
            at = np.flatnonzero(np.append(True, code[1:] >> np.uint64(1) != code[:-1] >> np.uint64(1))) if len(code) else np.zeros(0, np.int64)
            kinds, n = code[at] >> np.uint64(1), np.add.reduceat(code & np.uint64(1), at) if len(at) else at.astype(np.uint64)
            by, cut = _dealt(kinds, order, buckets)
            kinds, n = kinds[by], n[by]
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([seg.seg] * len(some), pa.int64()), pa.array([planes(kinds[cut[b] : cut[b + 1]], order + 1) for b in some], pa.binary()), pa.array([planes(n[cut[b] : cut[b + 1]], 4) for b in some], pa.binary())], names=["bucket", "seg", "g", "n"])

    def answer(table: pa.Table) -> pa.Table:
        sent = [unplanes(x, order + 1) for x in table["g"].to_pylist()]
        n = np.concatenate([unplanes(x, 4) for x in table["n"].to_pylist()])
        kinds, at = np.unique(np.concatenate(sent), return_inverse=True)
        value = log_scores(kinds, np.bincount(at, n, len(kinds)), order, trie.value)[at]
        cut = np.cumsum([0, *(len(x) for x in sent)])
        return pa.table({"seg": table["seg"], "bucket": table["bucket"], "scores": pa.array([value[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    return layout.by_bucket(segs.mapInArrow(send, "bucket int, seg long, g binary, n binary")).applyInArrow(answer, "seg long, bucket int, scores binary")


def _words_of(seg: Segment) -> tuple[Words, np.ndarray, np.ndarray]:
    w = Words(seg.data, seg.off)
    h = w.hashes()
    return w, h, np.unique(np.append(h, END_HASH)) if len(seg.ids) else np.zeros(0, np.uint64)


def word_counts(segs: DataFrame, layout: Layout) -> DataFrame:
    """(seg, bucket, counts, total, kinds): the corpus counts of each segment's distinct words, in the order of their hashes."""
    buckets = layout.buckets

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg in each(batches):
            w, h, kinds = _words_of(seg)
            train = ~held_out(seg.ids, seg.nulls)
            n = np.bincount(np.searchsorted(kinds, h[train[w.doc()]]), minlength=len(kinds))
            n[np.searchsorted(kinds, END_HASH)] += train.sum()
            cut = cuts(kinds, buckets)
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([seg.seg] * len(some), pa.int64()), pa.array([kinds[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary()), pa.array([planes(n[cut[b] : cut[b + 1]].astype(np.uint64), 4) for b in some], pa.binary())], names=["bucket", "seg", "h", "n"])

    def answer(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, np.uint64) for x in table["h"].to_pylist()]
        n = np.concatenate([unplanes(x, 4) for x in table["n"].to_pylist()]).astype(np.int64)
        kinds, at = np.unique(np.concatenate(sent), return_inverse=True)
        count = np.zeros(len(kinds), np.int64)
        np.add.at(count, at, n)
        cut = np.cumsum([0, *(len(x) for x in sent)])
        first = [int(count.sum()), int((count > 0).sum())]
        rest = [0] * (len(sent) - 1)
        return pa.table({"seg": table["seg"], "bucket": table["bucket"], "counts": pa.array([planes(count[at[a:b]].astype(np.uint64), 8) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), "total": pa.array([first[0], *rest], pa.int64()), "kinds": pa.array([first[1], *rest], pa.int64())})

    return layout.by_bucket(segs.mapInArrow(send, "bucket int, seg long, h binary, n binary")).applyInArrow(answer, "seg long, bucket int, counts binary, total long, kinds long")


def logs_of(code: np.ndarray, logs: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """The log probability at each place of a segment, from those of its distinct grams by bucket."""
    by_code = np.argsort(code)
    ranked = code[by_code]
    new = np.append(True, ranked[1:] != ranked[:-1])[: len(code)]
    by, _ = _dealt(ranked[new], order, buckets)
    own = np.empty(len(by))
    own[by] = logs
    out = np.empty(len(code))
    out[by_code] = own[np.cumsum(new) - 1]
    return out


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row; ``order``: context bytes, 2 to 6."""
    if not 2 <= order <= 6:
        raise ValueError(f"order is {order}, not 2 to 6")
    spark = docs.sparkSession
    segs = segments(docs, id_col, text_col, lower=True, name="ppm")
    layout = Layout(segs)
    buckets = layout.buckets
    low = trie_counts(segs).toPandas()  # at most 2**24 rows, whatever the corpus
    trie = spark.sparkContext.broadcast(Trie(uuid.uuid4().hex, low["code"].to_numpy(np.uint32), low["n"].to_numpy(np.int64)))
    counts = staged(word_counts(segs, layout), "word-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    floor = np.log10(total + 0.5 * (kinds + 1))
    none = F.lit(None).cast("binary")
    back = counts.select("seg", "bucket", "counts", none.alias("scores")).unionByName(gram_scores(segs, layout, order, trie).withColumn("counts", none))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        got = sorted(zip(right["bucket"].to_pylist(), right["counts"].to_pylist(), right["scores"].to_pylist(), strict=True), key=lambda x: x[0])
        corpus = np.concatenate([np.zeros(0, np.uint64), *(unplanes(x, 8) for _, x, _ in got if x is not None)]).astype(np.int64)
        logs = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(x, np.float32) for _, _, x in got if x is not None)])
        parts = []
        for seg in each(left):
            w, h, own = _words_of(seg)
            n = len(seg.ids)
            at = np.concatenate([np.searchsorted(own, h), np.full(n, np.searchsorted(own, END_HASH))])
            by_doc = np.argsort(np.concatenate([w.doc(), np.arange(n)]), kind="stable")
            c = corpus[at[by_doc]]
            first = w.off[:-1] + np.arange(n)
            code, code_first = grams(seg.data, seg.off, order)
            p = logs_of(code, logs, order, buckets)
            parts.append(pa.table({
                "id": seg.id_array(), "held_out": pa.array(held_out(seg.ids, seg.nulls)), "n_tokens": pa.array(w.counts + 1, pa.int64()),
                "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), first), pa.int64()), "train_tokens": pa.array(np.full(n, total), pa.int64()),
                "base_score": pa.array(np.add.reduceat(np.log10(c + 0.5) - floor, first), pa.float64()),
                "score": pa.array(np.add.reduceat(p, code_first[:-1]), pa.float64()),
            }))
        return pa.concat_tables(parts) if parts else _EMPTY.to_table()

    out = layout.by_segment(segs).cogroup(layout.by_segment(back)).applyInArrow(score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


class _EMPTY:
    @staticmethod
    def to_table() -> pa.Table:
        return pa.table({"id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), **{k: pa.array([], pa.int64()) for k in ("n_tokens", "n_known", "train_tokens")}, **{k: pa.array([], pa.float64()) for k in ("base_score", "score")}})


def lm_query(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), order=ORDER)
