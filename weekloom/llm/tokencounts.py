"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

A text is cut into pre-tokens by the tokenizer's own pattern; every run of ``LEAF`` pre-tokens is a leaf that knows its
characters and tokens, and inner nodes hold sums. An edit replaces [start, end) by other text. Pre-tokens are
matched from left to right and look at most two characters ahead, so only pre-tokens from a few characters before the edit
can change, and once a new boundary falls on an old leaf boundary after the edit, all that follows is as it was.
So only the leaves between these two places are encoded again. If they need no more places than before, they are written
back into them and sums are renewed along their paths; if an insertion makes more leaves, the tree is laid out anew from
all leaves (sums only, nothing else is encoded), so a leaf never holds more than ``LEAF`` pre-tokens and later edits stay
local.

Trees and edits stay with their document's row: nothing is shuffled. The vocabulary file is read once by the driver and
sent to the tasks (its size is that of the file, whatever the corpus).

Defined cases: a null text counts as empty and has no tokens; offsets of edits are in code points, clipped to the text, and
apply in order, each to the text that the one before left; a null edit list, a null edit or a null replacement counts
as none or empty. Columns that have the name of a measure give way to it.
"""
from __future__ import annotations

import base64

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from .carry import ROW, measured, opened, quoted

# Fixed value: the pattern of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF = 16
#: Characters before an edit that may change how they are cut.
CONTEXT = 4
#: Pre-tokens whose counts a worker remembers.
REMEMBER = 1 << 19

_CUT = regex.compile(PATTERN)
_coders: dict[int, Coder] = {}


class Coder:
    """Counts tokens of pre-tokens, each distinct one encoded once."""

    def __init__(self, ranks_file: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def count(self, token: str) -> int:
        n = self.known.get(token)
        if n is None:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            n = self.known[token] = len(self.encoding.encode_ordinary(token))
        return n

    @staticmethod
    def of(raw: bytes) -> Coder:
        key = hash(raw)
        if key not in _coders:
            _coders.clear()
            _coders[key] = Coder(raw)
        return _coders[key]


class TokenTree:
    """Leaves at [size, 2 * size); node k sums 2k and 2k + 1. Two sums: characters and tokens."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self._lay_out(chars, tokens)

    def _lay_out(self, chars: list[int], tokens: list[int]) -> None:
        self.size = 1 << max(0, (len(chars) - 1)).bit_length()
        self.leaves = len(chars)
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.chars[self.size : self.size + len(chars)] = chars
        self.tokens[self.size : self.size + len(tokens)] = tokens
        for k in range(self.size - 1, 0, -1):
            self._renew(k)

    def _renew(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @classmethod
    def build(cls, text: str, coder: Coder) -> TokenTree:
        return cls(*_leaves(_CUT.findall(text), coder))

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def leaf_at(self, char: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds ``char``; the last leaf with characters if none does."""
        char = max(0, min(char, self.chars[1] - 1))
        k, begin = 1, 0
        while k < self.size:
            k *= 2
            if char >= begin + self.chars[k]:
                begin += self.chars[k]
                k += 1
        return k - self.size, begin

    def edit(self, text: str, start: int, end: int, replacement: str, coder: Coder) -> tuple[str, int]:
        """The new text, and how many characters were encoded again; the tree follows."""
        start = max(0, min(start, len(text)))
        end = max(start, min(end, len(text)))
        new = text[:start] + replacement + text[end:]
        shift = len(new) - len(text)
        first, begin = self.leaf_at(start - CONTEXT)
        last, old_begin = self.leaf_at(end)
        old_end = old_begin + self.chars[self.size + last]
        pieces, at, stop = [], begin, start + len(replacement)
        for m in _CUT.finditer(new, begin):
            if at >= stop:
                while old_end + shift < at and last + 1 < self.leaves:
                    last += 1
                    old_end += self.chars[self.size + last]
                if old_end + shift == at and old_end > end:
                    break
            pieces.append(m.group())
            at = m.end()
        else:
            last = self.leaves - 1
        chars, tokens = _leaves(pieces, coder)
        room = last - first + 1
        if len(chars) > room:
            own_chars, own_tokens = self.parts()
            chars, tokens = own_chars[:first] + chars + own_chars[last + 1 :], own_tokens[:first] + tokens + own_tokens[last + 1 :]
            some = [k for k, n in enumerate(chars) if n] or [0]
            self._lay_out([chars[k] for k in some], [tokens[k] for k in some])
            return new, at - begin
        chars += [0] * (room - len(chars))
        tokens += [0] * (room - len(tokens))
        a, b = self.size + first, self.size + last
        self.chars[a : b + 1], self.tokens[a : b + 1] = chars, tokens
        while a > 1:
            a, b = a // 2, b // 2
            for k in range(a, b + 1):
                self._renew(k)
        return new, at - begin

    def parts(self) -> tuple[list[int], list[int]]:
        s = self.size
        return self.chars[s : s + self.leaves], self.tokens[s : s + self.leaves]


def _leaves(pieces: list[str], coder: Coder) -> tuple[list[int], list[int]]:
    get, count = coder.known.get, coder.count
    counts = [get(p) or count(p) for p in pieces]
    sizes = list(map(len, pieces))
    cut = range(0, max(1, len(pieces)), LEAF)
    return [sum(sizes[k : k + LEAF]) for k in cut], [sum(counts[k : k + LEAF]) for k in cut]


_INTS = ArrayType(IntegerType())
TREE = [StructField("leaf_chars", _INTS), StructField("leaf_tokens", _INTS), StructField("n_tokens", LongType())]
_TREE_NAMES = [f.name for f in TREE]


def _sent(spark, vocabulary: str):
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # the file's size


def _tree_arrays(trees: list[TokenTree]) -> list[pa.Array]:
    parts = [t.parts() for t in trees]
    ints = pa.list_(pa.int32())
    return [pa.array([p[0] for p in parts], ints), pa.array([p[1] for p in parts], ints), pa.array([t.n_tokens for t in trees], pa.int64())]


def token_trees(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with leaf_chars, leaf_tokens and n_tokens."""
    raw = _sent(docs.sparkSession, vocabulary)

    def build(texts: pa.Array, more: dict) -> list[pa.Array]:
        coder = Coder.of(raw.value)
        return _tree_arrays([TokenTree.build(t or "", coder) for t in texts.to_pylist()])

    return opened(measured(docs, text_col, TREE, build), docs.columns, _TREE_NAMES)


def edited(trees: DataFrame, text_col: str = "text", edits_col: str = "edits", keep: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns, the new text, its tree and n_tokens, and n_reencoded (characters); edits are array<struct<start,end,text>>."""
    keep = [c for c in trees.columns if c not in (text_col, edits_col, *_TREE_NAMES)] if keep is None else keep
    raw = _sent(trees.sparkSession, vocabulary)

    def apply(texts: pa.Array, more: dict) -> list[pa.Array]:
        coder = Coder.of(raw.value)
        new, grown, again = [], [], []
        for text, edits, chars, tokens in zip(texts.to_pylist(), *(more[c].to_pylist() for c in ("edits", "chars", "tokens")), strict=True):
            tree, n, text = TokenTree(chars or [0], tokens or [0]), 0, text or ""
            for e in edits or ():
                if e is not None:
                    text, once = tree.edit(text, e["start"] or 0, e["end"] or 0, e["text"] or "", coder)
                    n += once
            new.append(text)
            grown.append(tree)
            again.append(n)
        return [pa.array(new, pa.string()), *_tree_arrays(grown), pa.array(again, pa.int64())]

    more = {"edits": quoted(edits_col), "chars": F.col("leaf_chars"), "tokens": F.col("leaf_tokens")}
    out = measured(trees, text_col, [StructField("_new", StringType()), *TREE, StructField("n_reencoded", LongType())], apply, keep, more)
    measures = [*_TREE_NAMES, "n_reencoded"]
    kept = [c for c in keep if c not in (text_col, *measures)]
    return out.select(*[F.col(ROW)[c].alias(c) for c in kept], F.col("_new").alias(text_col), *measures)


def token_count_query(spark, sf_dir: str) -> DataFrame:
    """Counts of every document, and after two edits derived from it: a cut-out and an insertion of its own words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    size = F.length("text")
    cut, put = F.pmod(F.xxhash64("doc_id", F.lit(1)), size + 1).cast("long"), F.pmod(F.xxhash64("doc_id", F.lit(2)), size + 1).cast("long")
    edits = F.array(
        F.struct(cut.alias("start"), (cut + 24).alias("end"), F.lit("").alias("text")),
        F.struct(put.alias("start"), put.alias("end"), F.substring("text", 1, 40).alias("text")),
    )
    trees = token_trees(docs).withColumn("edits", edits).withColumn("n_before", F.col("n_tokens"))
    return edited(trees, keep=["doc_id", "n_before"]).select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_reencoded")
