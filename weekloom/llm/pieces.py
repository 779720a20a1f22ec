"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies, checked against the sentencepiece library.

Encoding. A text is normalised as the model says (by the library's own normaliser: its character map is part of the model
file) and starts as one symbol a character. An agenda holds every adjacent pair of symbols whose concatenation is a piece,
ordered by the piece's score, ties from the left. The best pair is merged, its two new neighbours join the agenda, and
entries that earlier merges made stale are passed over; so a run of n characters takes n log n steps. What is no piece at
the end becomes its UTF-8 bytes if the vocabulary has byte pieces, else the unknown piece (a run of those is one).

Two characters that no piece holds side by side can never be merged, wherever they stand. So a text falls into chunks at
such places (before a word's leading blank, beside a character without longer pieces), each with an agenda of its own; a
worker remembers the ids of short chunks. The cuts are found in the vocabulary, they aren't a rule about blanks.

Decoding. Pieces are put together, the mark of a blank becomes a blank, the dummy blank before the text is taken away, and
runs of byte pieces are read as UTF-8, where every byte that begins no valid character becomes U+FFFD.

Checking. With ``check`` the library encodes the same slices of the Arrow batch and decodes the ids; ``same_as_library`` says
whether both agree in ids and text. The results are those of the agenda in any case.

Everything stays with its row: nothing is shuffled. Memory is bounded by a slice of a batch (or one long text) and by
the chunks remembered. The model file is read once by the driver and sent to the tasks (its size is that of the file).

Defined cases: a null or empty text has no ids, and its decoded text is empty; a null list of ids decodes to null, null ids
within a list are passed over, ids outside the vocabulary are an error; repeated rows are coded row by row. Columns that
have the name of a measure give way to it. Models with symbols that the user defined are refused, as are other types of model.
"""
from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField

from .bytesplit import mixed, steps
from .carry import measured, opened, quoted

BLANK, UNKNOWN_TEXT = "▁", " ⁇ "
#: Chunks that a worker remembers, and their greatest length in characters.
REMEMBER, SHORT = 1 << 18, 48
#: Chunks that are merged at once; their arrays stay within a core's cache.
AT_ONCE = 1 << 13
#: Cost of a pair that is no piece.
NEVER = 1 << 30

_coders: dict[int, PieceCoder] = {}


class PieceCoder:
    """Encodes and decodes with one model."""

    def __init__(self, model: bytes):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n, self.unknown = lib.get_piece_size(), lib.unk_id()
        names = [lib.id_to_piece(i) for i in range(n)]
        if any(lib.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are not supported")
        self.ids = {p: i for i, p in enumerate(names) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))}
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.byte_set = frozenset(self.byte_ids.values())
        self.control = frozenset(i for i in range(n) if lib.is_control(i))
        self.blank_first = frozenset(i for p, i in self.ids.items() if p.startswith(BLANK))
        self.surface = [self._surface(i, p) for i, p in enumerate(names)]
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        self.surface_size = np.array([len(x) for x in self.surface])
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        self.dummy = lib.normalize("a") != "a"
        self._lay_out(n, np.array([-lib.get_score(i) for i in range(n)]))
        self._find_cuts()
        self.known: dict[str, bytes] = {}
        probe = "The quick brown  fox, 3.14 été 中文\n"
        if self.encode(probe).tolist() != lib.encode(probe):
            raise ValueError("not a merge-type vocabulary, or one with symbols defined by the user")

    def _surface(self, i: int, piece: str) -> bytes:
        if self.library.is_control(i):
            return b"\xff"  # no valid UTF-8: such ids are decoded run by run
        if self.library.is_unknown(i):
            return UNKNOWN_TEXT.encode()
        return bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace(BLANK, " ").encode()

    def _lay_out(self, n: int, costs: np.ndarray) -> None:
        """Tables by number: the symbol of each character, and ``cost << 32 | piece`` of each pair of symbols (by open addressing).

        Costs are ranks of scores, equal scores share one. Symbols are piece ids; a character that is no piece is -1.
        """
        pieces = np.array(list(self.ids.values()), np.int64)
        rank = np.zeros(n, np.int64)
        rank[pieces] = np.unique(costs[pieces], return_inverse=True)[1]
        self.cost = {p: int(rank[i]) for p, i in self.ids.items()}
        self.of_code = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_code[ord(p)] = i
        get = self.ids.get
        pairs = [(get(p[:k]), get(p[k:]), i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        left, right, whole = np.array(pairs, np.int64).reshape(-1, 3).T
        key = (left << 32) | right
        self.bits = max(4, int(len(key) * 4).bit_length())
        value = (rank[whole] << 32) | whole
        self.pair_key, self.pair_value = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER << 32, np.int64)
        slot = self._slot(key)
        while len(key):
            first = np.unique(slot, return_index=True)[1]
            first = first[self.pair_key[slot[first]] < 0]
            self.pair_key[slot[first]], self.pair_value[slot[first]] = key[first], value[first]
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, value, slot = key[rest], value[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mixed(key.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``cost << 32 | piece`` of each pair of symbols; the cost is ``NEVER`` where it is none."""
        key = (left.astype(np.int64) << 32) | right  # negative where one of the two is no piece
        slot = self._slot(key)
        there = self.pair_key[slot]
        out = np.where((there == key) & (key >= 0), self.pair_value[slot], NEVER << 32)
        some = np.flatnonzero((there != key) & (there >= 0) & (key >= 0))
        key, slot = key[some], slot[some]
        while len(some):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.pair_key[slot]
            hit = there == key
            out[some[hit]] = self.pair_value[slot[hit]]
            on = ~hit & (there >= 0)
            some, key, slot = some[on], key[on], slot[on]
        return out

    def _find_cuts(self) -> None:
        """``kind`` of each character: 1 within longer pieces, 2 the blank, 0 of no longer piece, a chunk of its own."""
        inner = {ord(c) for p in self.ids if len(p) > 1 for c in p} - {ord(BLANK)}
        self.kind = np.zeros(0x110000, np.uint8)
        self.kind[list(inner)], self.kind[ord(BLANK)] = 1, 2
        self.blank_follows = any(b == BLANK and a != BLANK for p in self.ids for a, b in zip(p, p[1:], strict=False))

    def _chunks(self, texts: list[str]) -> tuple[np.ndarray, pa.Array]:
        """How many chunks each text has, and all chunks: between them stand two characters that are side by side in no piece.

        If blanks follow nothing but blanks in any piece, a chunk ends before them.
        """
        whole = "".join(texts)
        kind = self.kind[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
        raw = np.frombuffer(whole.encode(), np.uint8)
        text_end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        begins = np.ones(len(kind) + 1, bool)
        begins[1:-1] = (kind[1:] == 0) | (kind[:-1] == 0)
        if not self.blank_follows:
            begins[1:-1] |= (kind[1:] == 2) & (kind[:-1] != 2)
        begins[text_end] = True
        byte = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[begins]
        count = np.diff(np.concatenate([[0], (np.cumsum(begins) - 1)[text_end]]))
        return count, pa.Array.from_buffers(pa.large_string(), len(byte) - 1, [None, pa.py_buffer(byte.astype(np.int64)), pa.py_buffer(raw)])

    def short(self, chunks: list[str]) -> list[bytes]:
        """Ids of short chunks, all at once: each round takes the best entry of every chunk's agenda.

        ``symbol`` holds the chunks one after the other, and nothing is moved: ``before`` and ``after`` lead to the neighbours
        of a symbol within its chunk (to the place after all, where none is), and ``entry`` is its entry of the agenda, the
        cost of joining it with the next one and its own place (``NEVER`` where the two aren't a piece). A round merges one
        pair a chunk and looks up its two new neighbours; chunks whose agenda is empty leave.
        """
        code = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        n, end = len(code), np.cumsum(sizes)
        begin = end - sizes
        symbol = np.append(self.of_code[code], np.int32(-1))
        before, after = np.arange(-1, n), np.minimum(np.arange(1, n + 2), n)
        before[begin], after[end - 1] = n, n
        pair = self._pairs(symbol, symbol[after])
        merged = (pair & 0xFFFFFFFF).astype(np.int32)
        entry = (pair >> 32 << 32) | np.arange(n + 1)
        alive = np.ones(n, bool)
        while len(begin):
            best = np.minimum.reduceat(entry, begin)  # the place decides between equal costs
            busy = best < NEVER << 32
            begin, at = begin[busy], best[busy] & 0xFFFFFFFF
            gone = after[at]
            symbol[at] = merged[at]
            alive[gone], entry[gone] = False, NEVER << 32
            after[at] = after[gone]
            before[after[at]] = at
            k = np.concatenate([at, before[at]])
            pair = self._pairs(symbol[k], symbol[after[k]])
            merged[k] = pair & 0xFFFFFFFF
            entry[k] = (pair >> 32 << 32) | k
        chunk = np.repeat(np.arange(len(chunks)), sizes)
        return self._written(chunk[alive], symbol[:-1][alive], code[alive], len(chunks))

    def _written(self, chunk: np.ndarray, symbol: np.ndarray, code: np.ndarray, n: int) -> list[bytes]:
        """The ids of each chunk; what is no piece becomes its bytes or the unknown piece."""
        none = np.flatnonzero(symbol < 0)
        if len(none):
            own = [self._no_piece(chr(c)) for c in code[none].tolist()]
            many = np.ones(len(symbol), np.int64)
            many[none] = [len(x) for x in own]
            chunk, symbol = np.repeat(chunk, many), np.repeat(symbol, many)
            symbol[symbol < 0] = [i for x in own for i in x]
        raw, cut = symbol.astype("<i4").tobytes(), (4 * np.searchsorted(chunk, np.arange(n + 1))).tolist()
        return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def _no_piece(self, character: str) -> list[int]:
        return [self.byte_ids[b] for b in character.encode()] if self.byte_ids else [self.unknown]

    def long(self, chunk: str) -> bytes:
        """The ids of a long chunk. Its agenda is a heap of (cost, place, size)."""
        symbols, cost = list(chunk), self.cost
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(cost[p], k, 2) for k in range(n - 1) if (p := symbols[k] + symbols[k + 1]) in cost]
        heapify(agenda)
        while agenda:
            _, left, size = heappop(agenda)
            right = after[left]
            if not symbols[left] or right >= n or len(symbols[left]) + len(symbols[right]) != size:
                continue  # one of the two has been merged with another since
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            for k in (left, before[left]):
                if k >= 0 and after[k] < n:
                    pair = symbols[k] + symbols[after[k]]
                    if pair in cost:
                        heappush(agenda, (cost[pair], k, len(pair)))
            if after[left] < n:
                before[after[left]] = left
        ids = [[self.ids[s]] if s in self.ids else self._no_piece(s) for s in symbols if s]
        return np.array([i for x in ids for i in x], "<i4").tobytes()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Each chunk is looked up once, those that aren't known yet are merged together."""
        count, chunks = self._chunks(self.library.normalize(texts) if texts else [])
        numbered = chunks.dictionary_encode()
        kinds = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = [self.known.get(c) for c in kinds]
        new = [k for k, x in enumerate(found) if x is None and len(kinds[k]) <= SHORT]
        if new:
            names = [kinds[k] for k in new]
            ids = [x for k in range(0, len(names), AT_ONCE) for x in self.short(names[k : k + AT_ONCE])]
            if len(self.known) + len(new) > REMEMBER:
                self.known = {c: x for c, x in zip(kinds, found, strict=True) if x is not None}
            self.known.update(zip(names, ids, strict=True))
            for k, x in zip(new, ids, strict=True):
                found[k] = x
        found = [self.long(c) if x is None else x for c, x in zip(kinds, found, strict=True)]  # long ones are not remembered
        flat, which = np.frombuffer(b"".join(found), "<i4"), numbered.indices.to_numpy()
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start, many = (np.cumsum(size) - size)[which], size[which]
        end = np.cumsum(many)
        ids = flat[np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - many), many)]
        cut = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(count)])].tolist()
        out = [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        return out if self.byte_ids else [self._one_unknown(x) for x in out]

    def _one_unknown(self, ids: np.ndarray) -> np.ndarray:
        """Each run of unknown pieces as one."""
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[~again]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        if ids and min(ids) < 0:
            raise IndexError("piece id is out of range")
        raw = b"".join(map(self.surface.__getitem__, ids))
        if self.dummy:
            raw = raw[1:] if ids and ids[0] in self.blank_first else raw
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_bytes(ids)

    def decode_all(self, texts: list[np.ndarray]) -> list[str]:
        """As ``decode``, for all texts of a slice: their pieces are put together in one pass."""
        flat = np.concatenate([*texts, np.zeros(0, np.int32)])
        if len(flat) and (flat.min() < 0 or flat.max() >= len(self.surface)):
            raise IndexError("piece id is out of range")
        size = self.surface_size[flat]
        end = np.cumsum(size)
        place = np.repeat(self.surface_start[flat] - (end - size), size)
        place += np.arange(len(place))
        raw = self.surface_bytes[place].tobytes()
        count = np.fromiter(map(len, texts), np.int64, len(texts))
        cut = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(count)])].tolist()
        out = []
        for ids, a, b in zip(texts, cut, cut[1:], strict=False):
            if self.dummy and len(ids) and int(ids[0]) in self.blank_first:
                a += 1
            try:
                out.append(raw[a:b].decode())
            except UnicodeDecodeError:
                out.append(self._decode_bytes(ids.tolist()))
        return out

    def _decode_bytes(self, ids: list[int]) -> str:
        """As ``decode``, for ids with control pieces, or with bytes that are not all valid: run by run."""
        out, run = [], bytearray()
        first = next((k for k, i in enumerate(ids) if i not in self.control), -1) if self.dummy else -1
        for k, i in enumerate([*ids, None]):
            if i in self.byte_set:
                run += self.surface[i]
                continue
            out.extend(_replaced(bytes(run)))
            run.clear()
            if i is not None and i not in self.control:
                piece = self.surface[i].decode()
                out.append(piece[1:] if k == first and i in self.blank_first else piece)
        return "".join(out)

    @staticmethod
    def of(model: bytes) -> PieceCoder:
        key = hash(model)
        if key not in _coders:
            _coders.clear()
            _coders[key] = PieceCoder(model)
        return _coders[key]


def _replaced(raw: bytes) -> Iterator[str]:
    """Characters of a run of bytes; each byte that begins no valid character is U+FFFD."""
    k = 0
    while k < len(raw):
        for size in (1, 2, 3, 4):
            try:
                yield raw[k : k + size].decode()
            except UnicodeDecodeError:
                continue
            k += size
            break
        else:
            yield "�"
            k += 1


_IDS = ArrayType(IntegerType())


def _sent(spark, model: str):
    with open(model, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # the file's size


def _id_lists(parts: list[np.ndarray]) -> pa.Array:
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))


def _coded(docs: DataFrame, model: str, text_col: str, decode: bool, check: bool, keep: list[str]) -> DataFrame:
    """The columns ``keep``, ids, n_tokens, and ``decoded`` and ``same_as_library`` if asked for."""
    raw = _sent(docs.sparkSession, model)
    fields = [StructField("ids", _IDS), StructField("n_tokens", LongType())]
    fields += [StructField("decoded", StringType())] if decode else []
    fields += [StructField("same_as_library", BooleanType())] if check else []

    def code(column: pa.Array, more: dict) -> list[pa.Array]:
        coder = PieceCoder.of(raw.value)
        found, back, same = [], [], []
        for a, b, _, _ in steps(column):
            texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
            own = coder.encode_all(texts)
            lists = [x.tolist() for x in own] if check else []
            texts_back = coder.decode_all(own) if decode else []
            if check:
                theirs = coder.library.encode(texts, num_threads=1)
                agree = [x == y for x, y in zip(lists, theirs, strict=True)]
                if decode:
                    agree = [s and x == y for s, x, y in zip(agree, coder.library.decode(lists, num_threads=1), texts_back, strict=True)]
                same.extend(agree)
            found.extend(own)
            back.extend(texts_back)
        out = [_id_lists(found), pa.array([len(x) for x in found], pa.int64())]
        out += [pa.array(back, pa.string())] if decode else []
        return out + ([pa.array(same, pa.bool_())] if check else [])

    return opened(measured(docs, text_col, fields, code, keep), keep, [f.name for f in fields])


def encoded(docs: DataFrame, model: str, text_col: str = "text", check: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default), ids and n_tokens; with ``check`` also same_as_library."""
    return _coded(docs, model, text_col, False, check, docs.columns if keep is None else keep)


def round_trip(docs: DataFrame, model: str, text_col: str = "text", check: bool = True, keep: list[str] | None = None) -> DataFrame:
    """As ``encoded``, with ``decoded``: the text that the ids stand for."""
    return _coded(docs, model, text_col, True, check, docs.columns if keep is None else keep)


def decoded(rows: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``: the text of a column of ids."""
    raw = _sent(rows.sparkSession, model)
    names = rows.columns

    def decode(column: pa.Array, more: dict) -> list[pa.Array]:
        coder = PieceCoder.of(raw.value)
        lists = more["ids"].to_pylist()
        return [pa.array([None if x is None else coder.decode([i for i in x if i is not None]) for x in lists], pa.string())]

    asked = rows.withColumn("_none", F.lit(None).cast("string"))
    return opened(measured(asked, "_none", [StructField("decoded", StringType())], decode, names, {"ids": quoted(ids_col)}), names, ["decoded"])


def piece_query(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests, with the public vocabulary of 32k pieces."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(
        "doc_id", "n_tokens", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "same_as_library",
    )
