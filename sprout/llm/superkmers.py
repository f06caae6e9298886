"""Substring dedup by super-k-mer partitioning: words covered by a window of words that occurs again.

1. Texts are normalised (words joined by one space) and packed into stored blocks.
   A window is ``window`` consecutive words of one document; its minimiser is the
   least hash among its ``GRAM``-word grams. Every block reports its minimisers
   once. A window that occurs again has a minimiser that is met at two places, so
   the others are settled here, and no text of theirs is shuffled.
2. A maximal run of consecutive windows with one minimiser is a super-k-mer. It
   travels as one packed string to the bucket of its minimiser, a string once per
   block with its count there. A bucket cuts its strings into windows, sorts them
   and compares neighbours byte by byte, so counts are exact whatever the hashes.
   It answers with one bit a window.
3. A minimiser with more than ``HOT`` strings (a passage inside a third of all
   documents) is cut into single windows instead. They are counted as strings by a
   partial and a final aggregate, so none of its tasks sees the whole group.
4. Every block marks the words of its repeated windows.

Runs are cut at ``RUN`` windows and long texts are worked on in overlapping pieces
of about ``PIECE`` bytes; windows belong to one run and one piece each.

Null and empty texts, and texts of fewer than ``window`` words, have no windows and
stay whole. Rows that repeat a doc_id are rows of their own, so two equal rows lose
their windows both. A null doc_id is a row like any other. Only the id and text
columns are read, so other columns may have any name. An empty table gives an empty
result. Words are maximal runs without space, tab, line feed, vertical tab, form
feed or carriage return.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, discard, store, text_buffers
from .suffixes import letters, powers, release, rows_of

WINDOW, GRAM = 35, 8
BLOCK_BYTES, PIECE, RUN = 2 << 20, 1 << 20, 64
#: Strings of one minimiser that a bucket takes at once.
HOT = 2048
SPACE = 32


def normalised(raw: bytes) -> bytes:
    """Words joined by one space, a stretch of the text at a time."""
    if len(raw) <= PIECE:
        return b" ".join(raw.split())
    out, at = [], 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw) and raw[end - 1] not in b" \t\n\r\x0b\x0c":
            end += 1
        if words := raw[at:end].split():
            out.append(b" ".join(words))
        at = end
    return b" ".join(out)


def pack_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, ids, offs, data): normalised documents packed into blocks; offsets as int64, bytes compressed."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        packer = zstandard.ZstdCompressor(level=1)
        ids, texts, held = [], [], 0

        def block() -> pa.RecordBatch:
            offs = np.cumsum([0, *map(len, texts)]).astype("<i8")
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number]), pa.array([ids], pa.list_(pa.int64())), pa.array([offs.tobytes()], pa.binary()),
                 pa.array([packer.compress(b"".join(texts))], pa.binary())], ["block", "ids", "offs", "data"])

        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            raw, own, offs = memoryview(data), batch.column(0).to_pylist(), offs.tolist()
            for name, a, b in zip(own, offs, offs[1:]):
                text = normalised(bytes(raw[a:b]))
                if held and held + len(text) > BLOCK_BYTES:
                    yield block()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(name)
                texts.append(text)
                held += len(text)
        if texts:
            yield block()

    return src.mapInArrow(run, "block bigint, ids array<bigint>, offs binary, data binary")


def unpack(row: dict) -> tuple[list, np.ndarray, bytes]:
    return row["ids"], np.frombuffer(row["offs"], "<i8"), zstandard.decompress(row["data"])


class Piece:
    """Some whole documents, or a stretch of a long one: word bounds in the block's bytes, window starts as word numbers."""

    def __init__(self, data: np.ndarray, lo: int, cuts: np.ndarray, docs: np.ndarray, window: int):
        """``cuts``: where the piece's documents begin and end, ``docs`` their numbers."""
        edge = np.zeros(cuts[-1] - lo + 1, bool)  # byte after a word
        edge[:-1] = data[lo:cuts[-1]] == SPACE
        edge[cuts[1:] - lo] = np.diff(cuts) > 0
        self.ends = np.flatnonzero(edge) + lo
        own = np.searchsorted(cuts, self.ends - 1, "right") - 1
        first = np.diff(own, prepend=-1) > 0  # a document's first word
        self.starts = np.where(first, cuts[own], np.concatenate([[0], self.ends[:-1] + 1]))
        self.doc, self.data = docs[own], data
        n = len(self.starts)
        at = np.arange(max(0, n - window + 1))
        self.windows = at[own[at + window - 1] == own[at]] if len(at) else at

    def minimisers(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Least gram hash of every window, and the first word it is met at."""
        n, grams = len(self.starts), window - GRAM + 1
        lo = int(self.starts[0])
        text = self.data[lo:int(self.ends[-1])]
        up, down = powers(len(text) + 1)
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(letters()[text] * up[:len(text)], out=sums[1:])
        a, b = self.starts[:n - GRAM + 1] - lo, self.ends[GRAM - 1:] - lo
        h = (sums[b] - sums[a]) * down[a]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        best, width = np.arange(len(h)), 1
        while 2 * width <= grams:
            x, y = best[:-width], best[width:]
            best, width = np.where(h[x] <= h[y], x, y), 2 * width
        x, y = best[self.windows], best[self.windows + grams - width]
        at = np.where(h[x] <= h[y], x, y)
        return h[at].view(np.int64), at

    def runs(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First window and window past the last (as indexes into ``windows``) of every super-k-mer."""
        if not len(value):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.append(True, (value[1:] != value[:-1]) | (np.diff(self.windows) > 1))
        long = np.arange(len(value)) - np.maximum.accumulate(np.where(new, np.arange(len(value)), 0))
        first = np.flatnonzero(new | (long % RUN == 0))
        return first, np.append(first[1:], len(value))

    def bounds(self, first: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the strings that hold the windows first to last - 1."""
        return self.starts[self.windows[first]], self.ends[self.windows[last - 1] + window - 1]


def pieces(data: bytes, offs: np.ndarray, window: int) -> Iterator[Piece]:
    """The block's text in pieces; stretches of a long document overlap by ``window`` - 1 words."""
    raw, doc, n = np.frombuffer(data, np.uint8), 0, len(offs) - 1
    while doc < n:
        if offs[doc + 1] - offs[doc] <= PIECE:
            to = max(doc + 1, int(np.searchsorted(offs, offs[doc] + PIECE, "right")) - 1)
            yield Piece(raw, int(offs[doc]), offs[doc:to + 1], np.arange(doc, to), window)
            doc = to
            continue
        at, stop, size = int(offs[doc]), int(offs[doc + 1]), PIECE
        while True:
            end = data.find(b" ", at + size, stop)
            end = stop if end < 0 else end
            piece = Piece(raw, at, np.array([at, end]), np.array([doc]), window)
            if end < stop and len(piece.starts) < 2 * window:  # giant words
                size *= 2
                continue
            yield piece
            if end == stop:
                break
            at, size = int(piece.starts[len(piece.starts) - window + 1]), PIECE
        doc += 1


def block_minimisers(blocks: DataFrame, window: int) -> DataFrame:
    """(value, block, places, strings): a block's minimisers, at how many places and in how many different strings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            _, offs, data = unpack(row)
            met, held = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
            for piece in pieces(data, offs, window):
                if not len(piece.windows):
                    continue
                value, at = piece.minimisers(window)
                new = np.append(True, (value[1:] != value[:-1]) | (at[1:] != at[:-1]))
                met.append(np.stack([value[new], piece.starts[at[new]]], 1))
                first, last = piece.runs(value)
                a, b = piece.bounds(first, last, window)
                held.append(np.stack([value[first], [hash(data[i:j]) for i, j in zip(a.tolist(), b.tolist())]], 1))
            # a stretch of a long text sees the places of its overlap again; they are one place
            places, strings = np.unique(np.concatenate(met), axis=0)[:, 0], np.unique(np.concatenate(held), axis=0)[:, 0]
            names, n = np.unique(places, return_counts=True)
            several = np.searchsorted(strings, names, "right") - np.searchsorted(strings, names)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), row["block"], np.int64)),
                                              pa.array(n.astype(np.int64)), pa.array(several.astype(np.int64))],
                                             ["value", "block", "places", "strings"])

    return blocks.select("block", "ids", "offs", "data").mapInArrow(run, "value bigint, block bigint, places bigint, strings bigint")


def strings_of(data: bytes, offs: np.ndarray, again: dict[int, bool], window: int) -> Iterator[tuple]:
    """Of each piece: itself, and its runs of repeated minimisers as (first window, last, value, string, hot); hot runs are single windows."""
    names = np.array(sorted(again), np.int64)
    for piece in pieces(data, offs, window):
        if not len(piece.windows):
            continue
        value, _ = piece.minimisers(window)
        first, last = piece.runs(value)
        own = value[first]
        known = names[np.minimum(np.searchsorted(names, own), len(names) - 1)] == own
        out = []
        for f, t in zip(first[known].tolist(), last[known].tolist()):
            v = int(value[f])
            if not again[v]:
                out.append((f, t, v, False))
            else:
                out += [(k, k + 1, v, True) for k in range(f, t)]
        if out:
            a, b = piece.bounds(*np.array([x[:2] for x in out]).T, window)
            yield piece, [(f, t, v, data[i:j], hot) for (f, t, v, hot), i, j in zip(out, a.tolist(), b.tolist())]


def flagged(row: dict) -> dict[int, bool]:
    return {x["value"]: x["hot"] for x in row["again"] or []}


def packed_strings(blocks: DataFrame, window: int) -> DataFrame:
    """(value, block, number, string, n, hot): the distinct strings of repeated minimisers, numbered in order within a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            _, offs, data = unpack(row)
            count: dict[tuple, int] = {}
            for _, runs in strings_of(data, offs, flagged(row), window):
                for *_, v, text, hot in runs:
                    count[v, text, hot] = count.get((v, text, hot), 0) + 1
            values, texts, hots = zip(*count) if count else ((), (), ())
            n = len(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, pa.int64()), pa.array([row["block"]] * n, pa.int64()), pa.array(range(n), pa.int32()),
                 pa.array(texts, pa.binary()), pa.array(count.values(), pa.int64()), pa.array(hots, pa.bool_())],
                ["value", "block", "number", "string", "n", "hot"])

    return blocks.mapInArrow(run, "value bigint, block bigint, number int, string binary, n bigint, hot boolean")


def window_bounds(text: bytes, window: int) -> tuple[list[int], list[int]]:
    """Where the windows of a packed string begin and end."""
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == SPACE)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(text))
    return starts[:len(starts) - window + 1].tolist(), ends[window - 1:].tolist()


def repeated_windows(strings: list[bytes], counts: list[int], window: int) -> dict[bytes, bytes]:
    """One bit a window of every distinct string: whether the window occurs twice or more in them all."""
    total: dict[bytes, int] = {}
    for text, n in zip(strings, counts):
        total[text] = total.get(text, 0) + n
    if len(total) == 1 and next(iter(total.values())) > 1:
        text = strings[0]
        return {text: np.packbits(np.ones(len(window_bounds(text, window)[0]), bool)).tobytes()}
    slices, weight, edges = [], [], [0]
    for text, n in total.items():
        starts, ends = window_bounds(text, window)
        slices += [text[a:b] for a, b in zip(starts, ends)]
        weight += [n] * len(starts)
        edges.append(len(slices))
    order = sorted(range(len(slices)), key=slices.__getitem__)
    again = np.array(weight) > 1
    for x, y in itertools.pairwise(order):
        if slices[x] == slices[y]:
            again[x] = again[y] = True
    return {text: np.packbits(again[a:b]).tobytes() for text, a, b in zip(total, edges, edges[1:])}


def bucket_bits(strings: DataFrame, window: int) -> DataFrame:
    """(block, number, bits) of the strings that travel to the bucket of their minimiser."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(5)))

        out: list[tuple] = []
        for _, group in itertools.groupby(groups(), key=lambda r: r[0]):
            _, block, number, texts, n = zip(*group)
            bits = repeated_windows(texts, n, window)
            out += [(b, k, bits[t]) for b, k, t in zip(block, number, texts)]
            if len(out) > 4096:
                yield answer(out)
                out = []
        yield answer(out)

    return (strings.where("NOT hot").select("value", "block", "number", "string", "n").repartition("value")
            .sortWithinPartitions("value").mapInArrow(run, "block bigint, number int, bits binary"))


def answer(rows: list[tuple]) -> pa.RecordBatch:
    block, number, bits = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(number, pa.int32()), pa.array(bits, pa.binary())],
                                      ["block", "number", "bits"])


def hot_bits(strings: DataFrame) -> DataFrame:
    """(block, number, bits) of the single windows of hot minimisers that occur again."""
    hot = strings.where("hot").select("string", "block", "number", "n")
    again = hot.groupBy("string").agg(F.sum("n").alias("n")).where("n > 1").select("string")
    return (hot.join(apart(again, "string"), "string", "left_semi")
            .select("block", "number", F.lit(b"\x80").alias("bits")))


def marked(piece: Piece, runs: list[tuple], number: dict[tuple, int], bits: dict[int, bytes], window: int) -> np.ndarray:
    """Words of the piece covered by its repeated windows, as a step function's sum."""
    step = np.zeros(len(piece.starts) + 1, np.int32)
    for f, t, v, text, hot in runs:
        if own := bits.get(number.setdefault((v, text, hot), len(number))):
            at = piece.windows[f:t][np.unpackbits(np.frombuffer(own, np.uint8), count=t - f).astype(bool)]
            step[at] += 1
            step[at + window] -= 1
    return np.cumsum(step[:-1]) > 0


def cleaned(blocks: DataFrame, id_col: str, window: int, keep_text: bool) -> DataFrame:
    """A row per document: its words without the marked ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, offs, data = unpack(row)
            bits = {x["number"]: x["bits"] for x in row["answers"] or []}
            gone: list[list[tuple[int, int]]] = [[] for _ in ids]  # byte ranges from a word's start to the next word's
            number: dict[tuple, int] = {}
            for piece, runs in strings_of(data, offs, flagged(row), window) if bits else ():
                cover = marked(piece, runs, number, bits, window)
                if not cover.any():
                    continue
                new = np.append(True, piece.doc[1:] != piece.doc[:-1])
                edge = np.flatnonzero(cover & np.append(True, ~cover[:-1] | new[1:]))
                last = np.flatnonzero(cover & np.append(~cover[1:] | new[1:], True))
                for d, a, b in zip(piece.doc[edge].tolist(), piece.starts[edge].tolist(), piece.ends[last].tolist()):
                    if gone[d] and a <= gone[d][-1][1] + 1:
                        gone[d][-1] = gone[d][-1][0], max(b, gone[d][-1][1])
                    else:
                        gone[d].append((a, b))
            out = []
            for name, spans, a, b in zip(ids, gone, offs.tolist(), offs.tolist()[1:]):
                left, at, removed = [], a, 0
                for x, y in spans:
                    left.append(data[at:x])
                    removed += data.count(b" ", x, y) + 1
                    at = min(y + 1, b)
                text = b"".join([*left, data[at:b]])
                if spans and spans[-1][1] == b and text:
                    text = text[:-1]  # the space before the removed end
                words = data.count(b" ", a, b) + 1 if b > a else 0
                out.append((name, words, removed, hashlib.sha256(text).hexdigest(), *[text] * keep_text))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * keep_text]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                             [id_col, "n_words", "n_removed", "kept_sha256", *["kept"] * keep_text])

    return blocks.mapInArrow(run, f"`{id_col}` bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * keep_text)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                   keep_text: bool = True, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]), one row per row; ``window`` must be over ``GRAM``."""
    if window <= GRAM:
        raise ValueError(f"window must be over {GRAM} words")
    spark = docs.sparkSession
    blocks, _ = store(pack_blocks(docs, id_col, text_col), "kmer-blocks")
    total = Window.partitionBy("value")
    again = (block_minimisers(blocks, window)
             .select("value", "block", F.sum("places").over(total).alias("places"), F.sum("strings").over(total).alias("strings"))
             .where("places > 1").groupBy("block")
             .agg(F.collect_list(F.struct("value", (F.col("strings") > hot).alias("hot"))).alias("again")))
    again, _ = store(again, "kmer-minimisers")
    release(spark)
    with_again = blocks.join(again, "block", "left").select("block", "ids", "offs", "data", "again")
    strings, at_strings = store(packed_strings(with_again.where("again IS NOT NULL"), window), "kmer-strings")
    release(spark)
    bits = bucket_bits(strings, window).unionByName(hot_bits(strings))
    answers, _ = store(bits.groupBy("block").agg(F.collect_list(F.struct("number", "bits")).alias("answers")), "kmer-answers")
    discard(spark, at_strings)
    release(spark)
    return cleaned(with_again.join(answers, "block", "left"), id_col, window, keep_text)
