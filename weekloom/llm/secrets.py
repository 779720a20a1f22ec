"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over lower-cased trigrams is derived: trigrams that every match
must hold (AND), and alternatives (OR). ``trigram_index`` inverts the corpus once, for any set of rules: documents are
dealt into segments, and a segment holds, beside its rows and texts, the sorted list of all trigrams (of UTF-8 bytes, ASCII
letters in lower case) and for each of them its postings, the rows that hold it. The index is a table that can be written
and searched again with other rules. ``search`` looks up the trigrams of each rule's query, intersects and unites postings,
and runs the regular expression on the candidates alone. A rule without a mandatory trigram is run on every text.

The index is partitioned by document, as the texts are, so neither postings nor texts are shuffled, and a hot source or
trigram stays spread over all tasks. A segment has at most 256 rows, so a posting is one byte, and about ``SEGMENT_BYTES``
of text; a longer text is a segment of its own.

Defined cases: a null text counts as empty; every input row gives one output row, whatever its id; matches are leftmost
and do not overlap within a rule; positions are code points, ends exclusive. A kept column named ``spans`` gives way to
the measure of that name.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .bytesplit import LOWER, text_buffers
from .carry import ROW, opened, quoted, row_of
from .scratch import staged

SEGMENT_ROWS, SEGMENT_BYTES = 256, 1 << 20


@dataclass(frozen=True)
class Rule:
    """``size`` is the least length of ``group``; shorter matches are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    size: int = 0
    any_case: bool = False
    compiled: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "compiled", re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0)))


# The three base rules, then the rules that the index adds.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

#: Sets of strings a part of an expression may match exactly are followed up to this size.
EXACT = 64


def _trigrams(s: str):
    """AND of the trigrams of a literal, as UTF-8 bytes; None (no demand) for shorter ones."""
    raw = s.encode()
    got = frozenset(raw[k : k + 3] for k in range(len(raw) - 2))
    return ("and", *sorted(got)) if got else None


def _low(code: int) -> str:
    """A character with ASCII letters in lower case, as in the index."""
    return chr(code + 32 if 0x41 <= code <= 0x5A else code)


def _both(a, b):
    return b if a is None else a if b is None or a == b else ("and", *((a[1:] if a[0] == "and" else (a,)) + (b[1:] if b[0] == "and" else (b,))))


def _either(options):
    options = list(dict.fromkeys(options))
    return None if not options or None in options else options[0] if len(options) == 1 else ("or", *options)


def _exact_query(strings) -> object:
    return _either([_trigrams(s) for s in strings])


def trigram_query(pattern: str):
    """("and"|"or", trigram or query, ...) that every matching text satisfies, or None where nothing is mandatory."""

    def chars(items):
        out: set[str] = set()
        for op, arg in items:
            if op is sre.LITERAL:
                out.add(_low(arg))
            elif op is sre.RANGE and arg[1] - arg[0] < 8:
                out |= {_low(c) for c in range(arg[0], arg[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None

    def sequence(parts):
        """(exact strings or None, query) of a sequence."""
        exact, query = {""}, None
        known = True
        for part in parts:
            own, demand = one(part)
            if own is not None and len(exact) * len(own) <= EXACT:
                exact = {a + b for a in exact for b in own}
            else:
                query = _both(_both(query, _exact_query(exact)), _exact_query(own) if own is not None else demand)
                exact, known = {""}, False
        return (exact, None) if known else (None, _both(query, _exact_query(exact)))

    def one(part):
        op, arg = part
        if op is sre.LITERAL:
            return {_low(arg)}, None
        if op is sre.IN:
            return chars(arg), None
        if op is sre.SUBPATTERN:
            return sequence(arg[3])
        if op is sre.BRANCH:
            options = [sequence(x) for x in arg[1]]
            if all(x[0] is not None for x in options) and sum(len(x[0]) for x in options) <= EXACT:
                return set().union(*(x[0] for x in options)), None
            return None, _either([_exact_query(e) if e is not None else q for e, q in options])
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            exact, query = sequence(body)
            if exact is not None and high == 1 and low == 0:
                return exact | {""}, None
            if exact is not None and low == high and len(exact) ** low <= EXACT:
                return sequence(list(body) * low)
            return None, None if low == 0 else _exact_query(exact) if exact is not None else query
        if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            return {""}, None
        return None, None

    exact, query = sequence(_parser.parse(pattern))
    return _exact_query(exact) if exact is not None else query


def leaves(query) -> set[bytes]:
    """The trigrams of a query."""
    return set() if query is None else {query} if isinstance(query, bytes) else set().union(*(leaves(x) for x in query[1:]))


def inverted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigrams, offsets, postings) of the texts of a segment: which rows hold each of the sorted distinct trigrams."""
    data, off = text_buffers(texts)
    low = LOWER[data].astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.uint32), np.zeros(1, np.uint32), np.zeros(0, np.uint8)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.uint32), np.diff(off))
    pairs = (((low[:-2] << np.uint32(8)) | low[1:-1]) << np.uint32(8) | low[2:]) << np.uint32(8) | row[:-2]
    pairs = np.unique(pairs[row[:-2] == row[2:]])
    trigram = pairs >> np.uint32(8)
    first = np.flatnonzero(np.append(True, trigram[1:] != trigram[:-1])) if len(pairs) else np.zeros(0, np.int64)
    return trigram[first], np.append(first, len(pairs)).astype(np.uint32), (pairs & np.uint32(0xFF)).astype(np.uint8)


_TEXTS = [StructField("texts", ArrayType(StringType())), *(StructField(c, BinaryType()) for c in ("trigrams", "offsets", "postings"))]


def trigram_index(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The index, one row a segment: its rows (the columns ``keep``), its texts, and its trigrams, offsets and postings."""
    keep = docs.columns if keep is None else list(keep)
    asked = docs.select(row_of(keep).alias(ROW), quoted(text_col).cast("string").alias("_text"))

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < batch.num_rows:
                base = ends[a - 1] if a else 0
                b = min(a + SEGMENT_ROWS, max(a + 1, int(np.searchsorted(ends, base + SEGMENT_BYTES, "right"))), batch.num_rows)
                own = texts.slice(a, b - a)
                rows = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(0).slice(a, b - a))
                lists = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), own.cast(pa.string()))
                yield pa.RecordBatch.from_arrays([rows, lists, *(pa.array([x.tobytes()], pa.binary()) for x in inverted(own))], names=["rows", "texts", "trigrams", "offsets", "postings"])
                a = b

    return asked.mapInArrow(invert, StructType([StructField("rows", ArrayType(asked.schema[ROW].dataType)), *_TEXTS]))


class Postings:
    """The inverted part of one segment."""

    def __init__(self, n: int, trigrams: bytes, offsets: bytes, postings: bytes):
        self.n = n
        self.trigrams, self.offsets, self.rows = np.frombuffer(trigrams, np.uint32), np.frombuffer(offsets, np.uint32), np.frombuffer(postings, np.uint8)

    def candidates(self, query) -> np.ndarray:
        """The rows that satisfy a query, as booleans."""
        if query is None:
            return np.ones(self.n, bool)
        if isinstance(query, bytes):
            out, code = np.zeros(self.n, bool), int.from_bytes(query, "big")
            at = int(np.searchsorted(self.trigrams, np.uint32(code)))
            if at < len(self.trigrams) and self.trigrams[at] == code:
                out[self.rows[self.offsets[at] : self.offsets[at + 1]]] = True
            return out
        sets = [self.candidates(x) for x in query[1:]]
        return np.logical_and.reduce(sets) if query[0] == "and" else np.logical_or.reduce(sets)


def spans_of(texts: list[str], index: Postings, rules, queries: dict) -> list[list[tuple[int, int, int]]]:
    """For each text of a segment (start, rule number, end), sorted."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for number, rule in enumerate(rules):
        finditer = _long_runs(rule) or rule.compiled.finditer
        for k in np.flatnonzero(index.candidates(queries[rule.kind])).tolist():
            found[k] += [(m.start(), number, m.end()) for m in finditer(texts[k]) if m.end(rule.group) - m.start(rule.group) >= rule.size]
    return [sorted(x) for x in found]


def _long_runs(rule: Rule):
    """A rule that is one class of characters, repeated: its matches are maximal runs, so the least length can be asked
    of the expression itself, which then skips the many short runs of prose."""
    parts = list(_parser.parse(rule.pattern))
    if len(parts) == 1 and parts[0][0] is sre.MAX_REPEAT and rule.pattern.endswith("]+") and rule.pattern.startswith("[") and not rule.group and rule.size:
        return re.compile(f"{rule.pattern[:-1]}{{{rule.size},}}", rule.compiled.flags & ~re.UNICODE).finditer
    return None


_SPANS = StructField("spans", ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])))


def search(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``_row`` and spans, array of (kind, start, end) by start, then by rule: one row for each row of the index's segments."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                texts = batch.column(1)[k].as_py()
                postings = Postings(len(texts), *(batch.column(c)[k].as_py() for c in (2, 3, 4)))
                found = spans_of(texts, postings, rules, queries)
                spans = pa.array([[{"kind": rules[r].kind, "start": s, "end": e} for s, r, e in x] for x in found], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, spans], names=[ROW, "spans"])

    asked = index.select("rows", "texts", "trigrams", "offsets", "postings")
    return asked.mapInArrow(scan, StructType([StructField(ROW, index.schema["rows"].dataType.elementType), _SPANS]))


def secret_spans(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` columns (all by default) and spans, from an index that is staged first."""
    keep = docs.columns if keep is None else keep
    return opened(search(staged(trigram_index(docs, text_col, keep), "trigrams", "zstd"), rules), keep, ["spans"])


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_query(spark, sf_dir: str) -> DataFrame:
    out = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE_RULES]))
    return out.select("doc_id", *[n(r.kind) for r in BASE_RULES], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def _sql_pattern(rule: Rule) -> str:
    """The pattern with both cases spelt out, as DuckDB's own flag for that would also match letters beyond ASCII."""
    if not rule.any_case:
        return rule.pattern
    return re.sub(r"\\x[0-9A-F]{2}|\[[^]]*\]|[a-z]", lambda m: m.group() if len(m.group()) > 1 else f"[{m.group().upper()}{m.group()}]", rule.pattern)


def _rule_sql(number: int, rule: Rule) -> str:
    pattern = _sql_pattern(rule).replace("'", "''")
    return f"""SELECT doc_id, {number} AS r, '{rule.kind}' AS kind, unnest(range(len(m))) AS k, p, m, g FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS p,
      regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g FROM d WHERE regexp_matches(t, '{pattern}'))
    WHERE len(m) > 0"""


def _secrets_sql() -> str:
    """Places follow from the pieces between the matches of a rule."""
    count = ", ".join(f"coalesce(count(*) FILTER (kind = '{r.kind}'), 0)::BIGINT AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS ({' UNION ALL '.join(_rule_sql(n, r) for n, r in enumerate(RULES))}),
y AS (SELECT doc_id, r, kind, length(array_to_string(p[1:k + 1], '')) + length(array_to_string(m[1:k], '')) AS s, length(m[k + 1]) AS n FROM x
      WHERE length(g[k + 1]) >= CASE r {' '.join(f'WHEN {n} THEN {r.size}' for n, r in enumerate(RULES))} END),
z AS (SELECT doc_id, r, kind, s, kind || ':' || s || ':' || (s + n) AS span FROM y),
a AS (SELECT doc_id, {count}, coalesce(string_agg(span, ',' ORDER BY s, r) FILTER (r < {len(BASE_RULES)}), '') AS base, string_agg(span, ',' ORDER BY s, r) AS spans FROM z GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}' for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""


SECRETS_SQL = _secrets_sql()
