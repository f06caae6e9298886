"""Byte-level BPE encoding and decoding.

Pre-tokenisation without regular expressions: every code point gets a class, the
classes with their look-ahead become transition functions of a small automaton,
and an associative scan over function composition yields the automaton's state at
every position of a whole chunk of documents at once; token pieces start where
the transition says so. The slices are dictionary-encoded, each distinct piece
is merged once (all uncached pieces of a length together, one merge per row and
round) and kept in a bounded cache; ids and byte offsets of a chunk are then
gathered in one go.

Null text is encoded as the empty text (no ids, empty decoded bytes). Repeated
rows give repeated results. Only the id and text columns are read, so other
columns may have any name.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_array, chunks, text_buffers

#: White_Space code points of Unicode, as ranges.
WHITE_SPACE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
               (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: What may follow an apostrophe to form a contraction.
SHORT_CONTRACTIONS, LONG_CONTRACTIONS = ("s", "t", "m", "d"), ("re", "ve", "ll")

LETTER, NUMBER, OTHER, QUOTE2, QUOTE3, SPACE, LAST_BLANK, LAST_SPACE = range(8)
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, AFTER_BLANK, ONE_LEFT, TWO_LEFT = range(8)
CACHED_PIECES = 400_000
LONG_PIECE = 256
NONE = np.iinfo(np.int32).max


@functools.cache
def code_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    for lo, hi in WHITE_SPACE:
        table[lo:hi + 1] = SPACE
    return table


def step(symbol: int, state: int) -> tuple[int, bool]:
    """The automaton: next state, and whether a piece starts at this code point."""
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return START, False
    if symbol in (LETTER, NUMBER, OTHER):
        own = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}[symbol]
        return own, state not in (own, AFTER_BLANK)
    if symbol in (QUOTE2, QUOTE3):
        if state in (IN_OTHERS, AFTER_BLANK):
            return IN_OTHERS, False
        return (ONE_LEFT if symbol == QUOTE2 else TWO_LEFT), True
    if symbol == SPACE:
        return IN_SPACES, state != IN_SPACES
    return (AFTER_BLANK if symbol == LAST_BLANK else START), True


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each symbol, composition table, function x state, symbol x state -> piece starts.

    Symbols 8..15 are 0..7 at the first code point of a document: constant
    functions, so documents don't see each other.
    """
    of = [tuple(step(s % 8, q if s < 8 else START)[0] for q in range(8)) for s in range(16)]
    starts = np.array([[step(s % 8, q if s < 8 else START)[1] for q in range(8)] for s in range(16)])
    ids = {tuple(range(8)): 0}
    todo = list(ids)
    while todo:
        f = todo.pop()
        for g in of:
            h = tuple(g[q] for q in f)
            if h not in ids:
                ids[h] = len(ids)
                todo.append(h)
    functions = np.array(list(ids), np.uint8)
    then = np.array([[ids[tuple(functions[b][functions[a]])] for b in range(len(ids))] for a in range(len(ids))], np.uint16)
    return np.array([ids[f] for f in of], np.uint16), then, functions, starts


def scan(functions: np.ndarray, then: np.ndarray, block: int = 256) -> np.ndarray:
    """Inclusive prefix compositions: blocks in step with each other, then the block totals."""
    n, m = len(functions), len(then)
    flat = then.ravel()
    if n <= block:
        out = functions.copy()
        for k in range(1, n):
            out[k] = flat[int(out[k - 1]) * m + int(out[k])]
        return out
    rows = -(-n // block)
    grid = np.zeros(rows * block, np.uint16)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    for k in range(1, block):
        grid[k] = flat[grid[k - 1].astype(np.int32) * m + grid[k]]
    before = np.zeros(rows, np.uint16)
    before[1:] = scan(grid[-1], then, block)[:-1]
    grid = flat[before.astype(np.int32) * m + grid]
    return np.ascontiguousarray(grid.T).ravel()[:n]


def symbols(cps: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Class with look-ahead of each code point; firsts: index of each non-empty document's first."""
    n = len(cps)
    out = code_classes()[cps]
    last = np.zeros(n, bool)
    last[firsts[1:] - 1] = True
    last[n - 1] = True
    space = out == SPACE
    ends = space & ~last
    ends[:-1] &= ~space[1:]
    out[ends] = np.where(cps[ends] == 0x20, LAST_BLANK, LAST_SPACE)
    quotes = np.flatnonzero((cps == 0x27) & ~last)
    if len(quotes):
        after = cps[quotes + 1]
        two = np.isin(after, [ord(c) for c in SHORT_CONTRACTIONS])
        out[quotes[two]] = QUOTE2
        rest = quotes[~last[quotes + 1]]
        three = np.zeros(len(rest), bool)
        for a, b in LONG_CONTRACTIONS:
            three |= (cps[rest + 1] == ord(a)) & (cps[rest + 2] == ord(b))
        out[rest[three]] = QUOTE3
    out[firsts] += 8
    return out


def piece_starts(cps: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Code point indexes at which pieces start."""
    if not len(cps):
        return np.zeros(0, np.int64)
    of, then, functions, starts = automaton()
    sym = symbols(cps, firsts)
    state = np.zeros(len(cps), np.uint8)
    state[1:] = functions[:, START][scan(of[sym], then)[:-1]]
    return np.flatnonzero(starts.ravel()[sym.astype(np.int16) * 8 + state])


class Vocabulary:
    """Ranks of a ``.tiktoken`` file, the merges they imply, and a bounded cache of merged pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.token_bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.token_bytes[rank] = token
        self.tokens = pa.array(self.token_bytes, pa.binary())
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        order = sorted(pairs)
        self.pairs = pairs
        self.pair_keys = np.array(order, np.int64)
        self.pair_ranks = np.array([pairs[k] for k in order], np.int32)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.counts = np.zeros(0, np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge_rows(self, tok: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """BPE of rows of byte ids padded with -1: (row numbers, id matrix) of the rows done in each round.

        Each round merges the leftmost lowest-ranked pair of every open row, so all
        open rows keep one width.
        """
        out, at = [], np.arange(len(tok))
        rank = self.pair_rank(tok[:, :-1], tok[:, 1:])
        while len(at):
            if tok.shape[1] == 1:
                out.append((at, tok))
                break
            j = rank.argmin(1)
            low = rank[np.arange(len(at)), j]
            open_ = low < NONE
            if not open_.all():
                out.append((at[~open_], tok[~open_]))
                at, tok, rank, j, low = at[open_], tok[open_], rank[open_], j[open_], low[open_]
                if not len(at):
                    break
            n, width = tok.shape
            r, col = np.arange(n), np.arange(width - 1, dtype=np.int32)
            tok = np.take_along_axis(tok, col + (col > j[:, None]), 1)
            tok[r, j] = low
            col = col[:width - 2]
            rank = np.take_along_axis(rank, col + (col >= j[:, None]), 1)
            left, right = np.flatnonzero(j > 0), np.flatnonzero(j < width - 2)
            rank[left, j[left] - 1] = self.pair_rank(tok[left, j[left] - 1], tok[left, j[left]])
            rank[right, j[right]] = self.pair_rank(tok[right, j[right]], tok[right, j[right] + 1])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """BPE of one long piece: a heap of pairs over a linked list."""
        ids = [int(x) for x in self.byte_ids[np.frombuffer(piece, np.uint8)]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := self.pairs.get(r << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            if (h := before[i]) >= 0 and (x := self.pairs.get(ids[h] << 32 | r)) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return np.array([x for x in ids if x >= 0], np.int32)

    def learn(self, pieces: list[bytes]) -> None:
        """Merge pieces that aren't cached and add them to the cache."""
        of, ids, by_width = [], [], {}
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i, (p, size) in enumerate(zip(pieces, sizes.tolist())):
            whole = self.ranks.get(p)
            if whole is None and size <= LONG_PIECE:
                by_width.setdefault(max(8, 1 << (size - 1).bit_length()), []).append(i)
            else:
                ids.append(np.array([whole], np.int32) if whole is not None else self.merge_long(p))
                of.append(np.full(len(ids[-1]), i))
        for width, which in by_width.items():
            rows = np.full((len(which), width), -1, np.int32)
            inside = np.arange(width) < sizes[which][:, None]
            rows[inside] = self.byte_ids[np.frombuffer(b"".join([pieces[i] for i in which]), np.uint8)]
            which = np.array(which)
            for at, tok in self.merge_rows(rows):
                real = tok >= 0
                ids.append(tok[real])
                of.append(np.repeat(which[at], real.sum(1)))
        of = np.concatenate(of)
        base = len(self.counts)
        self.known.update(zip(pieces, range(base, base + len(pieces))))
        self.counts = np.append(self.counts, np.bincount(of, minlength=len(pieces)))
        self.flat = np.append(self.flat, np.concatenate(ids)[np.argsort(of, kind="stable")])

    def ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct pieces: start and count of each in the flat id array, and that array."""
        if len(self.known) > CACHED_PIECES:
            self.forget()
        get = self.known.get
        if missing := [p for p in pieces if p not in self.known]:
            self.learn(missing)
        at = np.fromiter(map(get, pieces), np.int64, len(pieces))
        starts = np.cumsum(self.counts) - self.counts
        return starts[at], self.counts[at], self.flat

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk of UTF-8 documents, and each document's first index among them."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        text = data.tobytes().decode()
        if len(text) == len(data):
            cps, at = data, np.arange(len(data) + 1)
        else:
            cps = np.frombuffer(text.encode("utf-32-le"), "<u4")
            at = np.zeros(len(cps) + 1, np.int64)
            np.cumsum(1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000), out=at[1:])
        filled = offsets[:-1][offsets[1:] > offsets[:-1]]
        starts = at[piece_starts(cps, np.searchsorted(at, filled))]
        pieces = binary_array(data, np.append(starts, len(data))).dictionary_encode()
        own, cuts = text_buffers(pieces.dictionary)
        own, cuts = own.tobytes(), cuts.tolist()
        first, count, flat = self.ids_of([own[a:b] for a, b in zip(cuts, cuts[1:])])
        index = pieces.indices.to_numpy()
        n = count[index]
        ends = np.cumsum(n)
        ids = flat[np.repeat(first[index] - ends + n, n) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[np.searchsorted(starts, offsets)]

    def encode_added(self, data: np.ndarray, offsets: np.ndarray, added: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` with texts split at added tokens (the longest where several start), which have ids of their own."""
        raw, cuts = data.tobytes(), offsets.tolist()
        pattern = re.compile(b"|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)))
        if not pattern.search(raw):
            return self.encode(data, offsets)
        parts, ends, special, after, n_before = [], [0], [], [], [0]
        for a, b in zip(cuts, cuts[1:]):
            for m in pattern.finditer(raw, a, b):
                parts.append(raw[a:m.start()])
                ends.append(ends[-1] + len(parts[-1]))
                special.append(added[m.group()])
                after.append(len(parts))
                a = m.end()
            parts.append(raw[a:b])
            ends.append(ends[-1] + len(parts[-1]))
            n_before.append(len(special))
        ids, first = self.encode(np.frombuffer(b"".join(parts), np.uint8), np.array(ends, np.int64))
        n_before = np.array(n_before)
        docs = np.arange(len(cuts)) + n_before  # index of each text's first part
        return np.insert(ids, first[after], special), first[docs] + n_before

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids, and the byte offset of each id (length ids + 1)."""
        return text_buffers(self.tokens.take(pa.array(ids, pa.int32())))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           offsets: bool = False, decoded: bool = False, added: dict[bytes, int] | None = None) -> DataFrame:
    """Encode whole texts: (id, n_tokens, ids) with ids as packed little-endian uint32.

    ``added`` are tokens that texts are split at first (without ``offsets`` and ``decoded``).
    ``offsets`` adds each token's byte offset in its document (packed the same
    way); ``decoded`` decodes the ids again in the same pass and adds the bytes.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    extra = [f"{c} binary" for c, on in (("offsets", offsets), ("decoded", decoded)) if on]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            for lo, hi in chunks(offs):
                chunk, starts = data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
                ids, first = vocab.encode_added(chunk, starts, added) if added else vocab.encode(chunk, starts)
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)),
                        binary_array(ids.astype("<u4").view(np.uint8), first * 4)]
                if offsets or decoded:
                    out, at = vocab.decode(ids)
                    if offsets:
                        own = at[:-1] - np.repeat(at[first[:-1]], np.diff(first))
                        cols.append(binary_array(own.astype("<u4").view(np.uint8), first * 4))
                    if decoded:
                        cols.append(binary_array(out, at[first]))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = [id_col, "n_tokens", "ids", *(x.split()[0] for x in extra)]
    kind = docs.schema[id_col].dataType.simpleString()
    return src.mapInArrow(run, ", ".join([f"`{id_col}` {kind}", "n_tokens bigint", "ids binary", *extra]))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of packed ids: (id, decoded). Null ids decode to no bytes."""
    src = encoded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.expr("X''")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            for lo, hi in chunks(offs):
                ids = np.frombuffer(data[offs[lo]:offs[hi]].tobytes(), "<u4")
                out, at = vocab.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), binary_array(out, at[(offs[lo:hi + 1] - offs[lo]) // 4])],
                    [id_col, "decoded"])

    return src.mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, decoded binary")
