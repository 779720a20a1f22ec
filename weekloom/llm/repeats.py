"""Removal of repeated word passages with fixed-block anchors.

A passage of ``window`` words (50) that stands in two documents holds, in either of them, a whole block of the
document's own grid of ``window // 2`` words (25). So the non-overlapping grid blocks of all documents are the index,
and every rolling window of 25 words probes it. A hit is an anchor: it is extended to both sides by verifying every
50-word window that contains it, and the verified windows merge into maximal exact repeats. A word is removed if a
verified window that covers it also starts in a document with a smaller id; windows are judged on the input.

Hashes travel through segments (see ``segments``): each distinct probe of a segment once, 5 bytes, with a mark if it is
also a grid block there; a probe counts as hit if its bucket got it from two segments (or the segment holds it twice)
and some document has it on its grid. 50-word windows around anchors then travel once per segment with the smallest id
there and a place where they stand, by fingerprints of 128 bits made of two independent hashes of every word; the bucket
answers with the places of those that have a smaller id elsewhere, and nothing more: the segment has the fingerprint itself.
Two different windows have the same fingerprint with a chance of about 2**-128, which is below 1 in 10**11 over all pairs
of the windows of 100 TB of text; the words themselves are not sent a second time.

The text is stored once and shuffled once: verifying and removing are parts of one plan, and meet the segments in the same
exchange.

Defined cases: a null text has no words; a text under 50 words keeps all; rows with the same id never remove each
other's words; a null id comes after all others (equal among nulls).
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesplit import Words, covered, found_twice, rolling, whole
from .scratch import staged
from .segments import Layout, Segment, bucket_of, cuts, each, planes, segments, unplanes

#: Bytes of a probe's hash that travel; with the bucket's share of the bits, false hits are rare, and verified away.
PROBE_BYTES = 5
#: Bytes of a word's place in its segment; a single text has fewer words than 2**32.
PLACE_BYTES = 4


def _probes(seg: Segment, block: int) -> tuple[Words, np.ndarray, np.ndarray]:
    w = Words(seg.data, seg.off)
    h = rolling(w.hashes(), block)
    ok = whole(w.off, block, len(w.start))
    return w, h, ok


def _narrow(h: np.ndarray) -> np.ndarray:
    """The part of a hash that travels beside its bucket: the 40 bits below the highest 20, which choose the bucket."""
    return (h >> np.uint64(4)) & np.uint64((1 << (8 * PROBE_BYTES)) - 1)


def anchors(segs: DataFrame, block: int, layout: Layout) -> DataFrame:
    """(seg, bucket, hits): the probes of a segment that another segment shares, if one of them is a grid block."""
    buckets = layout.buckets

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg in each(batches):
            w, h, ok = _probes(seg, block)
            at = np.flatnonzero(ok)
            on_grid = (at - np.repeat(w.off[:-1], w.counts)[at]) % block == 0
            key = h[at]
            order = np.lexsort((~on_grid, key))
            key, on_grid = key[order], on_grid[order]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            key, on_grid = key[first], on_grid[first]  # a grid block comes first among equals
            cut = cuts(key, buckets)
            rows = []
            for b in np.flatnonzero(np.diff(cut)).tolist():
                k, g = key[cut[b] : cut[b + 1]], on_grid[cut[b] : cut[b + 1]]
                rows.append((b, planes(_narrow(np.concatenate([k[g], k[~g]])), PROBE_BYTES), int(g.sum())))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([seg.seg] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["bucket", "seg", "h", "blocks"])

    def answer(table: pa.Table) -> pa.Table:
        sent = [unplanes(x, PROBE_BYTES) for x in table["h"].to_pylist()]
        size = np.array([len(x) for x in sent])
        n_blocks = table["blocks"].to_numpy()
        key, owner = np.concatenate(sent), np.repeat(np.arange(len(sent)), size)
        grid = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size) < np.repeat(n_blocks, size)
        order = np.argsort(key, kind="stable")
        key, owner, grid = key[order], owner[order], grid[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.diff(np.concatenate([start, [len(key)]]))
        hit = np.repeat((many > 1) & np.logical_or.reduceat(grid, start), many)
        key, owner = key[hit], owner[hit]
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(len(sent) + 1))
        some = np.flatnonzero(np.diff(cut))
        return pa.table({"seg": table["seg"].take(pa.array(some)), "bucket": table["bucket"].take(pa.array(some)), "hits": pa.array([planes(key[order[cut[k] : cut[k + 1]]], PROBE_BYTES) for k in some], pa.binary())})

    return layout.by_bucket(segs.mapInArrow(send, "bucket int, seg long, h binary, blocks long")).applyInArrow(answer, "seg long, bucket int, hits binary")


def _fingerprints(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every window: together its fingerprint."""
    return rolling(w.hashes(), window), rolling(w.hashes(1), window)


def _starts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where runs of equal pairs begin, in sorted pairs."""
    return np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)


def _local_min(one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where each distinct fingerprint, in sorted order, has its smallest id."""
    order = np.lexsort((ids, two, one))
    return order[_starts(one[order], two[order])]


def verified_windows(segs: DataFrame, hits: DataFrame, window: int, layout: Layout) -> DataFrame:
    """(seg, at): places in a segment whose window, around an anchor, has a smaller id elsewhere than anywhere in the segment."""
    block, buckets = window // 2, layout.buckets

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        got = {b: unplanes(x, PROBE_BYTES) for b, x in zip(right["bucket"].to_pylist(), right["hits"].to_pylist(), strict=True)}
        for seg in each(left):
            w, h, ok = _probes(seg, block)
            at = np.flatnonzero(ok)
            key = h[at]
            anchor = found_twice(key)
            order = np.argsort(key, kind="stable")
            cut = cuts(key[order], buckets)
            for b, hit in got.items():
                own = order[cut[b] : cut[b + 1]]
                anchor[own] |= np.isin(_narrow(key[own]), hit)
            mark = np.zeros(len(h) + 1, np.int64)
            mark[1 + at[anchor]] = 1
            seen = np.cumsum(mark)
            one, two = _fingerprints(w, window)
            p = np.flatnonzero(whole(w.off, window, len(w.start)))
            p = p[seen[p + window - block + 1] > seen[p]]  # an anchor begins at p .. p + window - block
            one, two, ids = one[p], two[p], seg.ids[w.doc()[p]]
            first = _local_min(one, two, ids)
            one, two, least, place = one[first], two[first], ids[first].astype(np.uint64), p[first].astype(np.uint64)
            cut = cuts(one, buckets)
            for b in np.flatnonzero(np.diff(cut)).tolist():
                own = slice(cut[b], cut[b + 1])
                rows.append((b, seg.seg, planes(one[own], 8), two[own].tobytes(), planes(least[own], 8), planes(place[own], PLACE_BYTES)))
        columns = zip(("bucket", "seg", "one", "two", "ids", "at"), (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)
        return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(columns)})

    def answer(table: pa.Table) -> pa.Table:
        sent = [unplanes(x, 8) for x in table["one"].to_pylist()]
        one, two = np.concatenate(sent), np.concatenate([np.frombuffer(x, np.uint64) for x in table["two"].to_pylist()])
        owner = np.repeat(np.arange(len(sent)), [len(x) for x in sent])
        ids = np.concatenate([unplanes(x, 8) for x in table["ids"].to_pylist()]).astype(np.int64)
        place = np.concatenate([unplanes(x, PLACE_BYTES) for x in table["at"].to_pylist()])
        order = np.lexsort((two, one))
        one, two, ids = one[order], two[order], ids[order]
        start = _starts(one, two)
        less = order[np.repeat(np.minimum.reduceat(ids, start), np.diff(np.append(start, len(one)))) < ids]
        owner, place = owner[less], place[less]
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
        cut = np.searchsorted(owner, np.arange(len(sent) + 1))
        some = np.flatnonzero(np.diff(cut))
        return pa.table({"seg": table["seg"].take(pa.array(some)), "at": pa.array([planes(place[cut[k] : cut[k + 1]], PLACE_BYTES) for k in some], pa.binary())})

    sent = layout.by_segment(segs).cogroup(layout.by_segment(hits)).applyInArrow(send, "bucket int, seg long, one binary, two binary, ids binary, at binary")
    return layout.by_bucket(sent).applyInArrow(answer, "seg long, at binary")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(id, n_words, n_removed, kept_text), one row per input row; kept words are joined by one space."""
    segs = segments(docs, id_col, text_col, name="repeats")
    layout = Layout(segs)
    hits = staged(anchors(segs, window // 2, layout), "anchors")
    found = verified_windows(segs, hits, window, layout)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"id": [], "n_words": [], "n_removed": [], "kept_text": []}
        places = np.concatenate([np.zeros(0, np.uint64), *(unplanes(x, PLACE_BYTES) for x in right["at"].to_pylist())]).astype(np.int64)
        for seg in each(left):
            w = Words(seg.data, seg.off)
            one, two = _fingerprints(w, window)
            p = np.flatnonzero(whole(w.off, window, len(w.start)))
            own_id = seg.ids[w.doc()[p]]
            # runs of equal fingerprints share their least id, and what was answered for one of them
            order = np.lexsort((two[p], one[p]))
            p, own_id = p[order], own_id[order]
            start = _starts(one[p], two[p])
            elsewhere, again = np.zeros(len(w.start), bool), np.zeros(len(w.start), bool)
            elsewhere[places] = True
            if len(p):
                size = np.diff(np.append(start, len(p)))
                again[p] = np.repeat(np.logical_or.reduceat(elsewhere[p], start), size) | (np.repeat(np.minimum.reduceat(own_id, start), size) < own_id)
            gone = covered(again, window, len(w.start))
            n_gone = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.off])
            for d in range(len(seg.ids)):
                words = seg.text(d).split()
                if n_gone[d]:
                    words = compress(words, ~gone[w.off[d] : w.off[d + 1]])
                out["kept_text"].append(b" ".join(words).decode())
            out["id"].append(seg.id_array())
            out["n_words"].append(w.counts)
            out["n_removed"].append(n_gone)
        return pa.table({"id": pa.chunked_array(out["id"], pa.int64()), "n_words": pa.array(np.concatenate([np.zeros(0, np.int64), *out["n_words"]]), pa.int64()), "n_removed": pa.array(np.concatenate([np.zeros(0, np.int64), *out["n_removed"]]), pa.int64()), "kept_text": pa.array(out["kept_text"], pa.string())})

    back = layout.by_segment(segs).cogroup(layout.by_segment(found))
    return back.applyInArrow(remove, "id long, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)


def repeats_query(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


REPEATS_SQL = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, unnest(range(len(w) - 49)) AS p, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, p, md5(array_to_string(w[p + 1:p + 50], ' ')) AS h FROM k),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS least FROM h),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM m WHERE least < doc_id),
g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)), ' ') END) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
