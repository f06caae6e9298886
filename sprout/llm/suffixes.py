"""Suffix dedup: bytes covered by a fixed-length string that also starts in an earlier document.

Two suffixes tie for ``length`` bytes exactly if they are a repeat to remove.
A full suffix table would be many times the text, so it is built blockwise, by a
difference cover:

1. Documents are packed into stored blocks. Positions whose number modulo
   ``PERIOD`` lies in the difference cover are the cover sample (six of 31). For
   any two positions some shift below the period brings both into the sample, so
   two suffixes that tie for ``length`` bytes have, at one shift, cover suffixes
   that tie for ``length - PERIOD + 1`` bytes. The cover suffixes are bucketed by
   fingerprint, each bucket is sorted in one task, and every cover suffix learns
   whether another block has its like: its rank is shared or not.
2. Only suffixes with a shared cover rank within a period can be in a long tie.
   They are cut out as regions (a fraction of the text).
3. The regions' suffixes go through ``PASSES`` passes. A pass takes one part of
   the suffix buckets, so a pass's share of the suffixes is all that is on disk,
   and one bucket at a time is sorted in a task by the fingerprint of its first
   ``length`` bytes, which gives the smallest document of each tie. Every block
   sends a suffix string once, with its own smallest document, and gets one bit
   back: whether an earlier document has it.

A string held by a third of all documents thus counts once per block. Fingerprints
of the long ties are 64 bits of a polynomial hash; those of the cover sample are
shorter, as a chance tie there only adds a candidate.

Null and empty texts have no bytes. Matches never cross documents. Rows that
repeat a doc_id are the same document: neither is earlier than the other. A null
doc_id comes after all others. Only the id and text columns are read. An empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, store, text_buffers

LENGTH = 50
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
BLOCK_BYTES, BUCKET_BYTES = 2 << 20, 6 << 20
PASSES = 4
LAST = np.iinfo(np.int64).max
BASE = 0x9E3779B97F4A7C15 | 1


@functools.cache
def letters() -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return np.random.default_rng(50).integers(0, 1 << 64, 256, np.uint64)


@functools.lru_cache(maxsize=1)
def powers_up_to(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    up, down = powers_up_to(max(22, n.bit_length()))
    return up[:n], down[:n]


def fingerprints(data: np.ndarray, length: int, at: np.ndarray | None = None) -> np.ndarray:
    """64-bit fingerprints of the strings of ``length`` bytes at positions ``at`` (default: all that fit)."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters()[data] * up, out=sums[1:])
    if at is None:
        n = max(0, len(data) - length + 1)
        h = (sums[length:length + n] - sums[:n]) * down[:n]
    else:
        h = (sums[at + length] - sums[at]) * down[at]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the high bits, so sorting fingerprints also sorts buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def pack_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, ids, offs, data): documents packed into blocks; ids and offsets as int64, bytes compressed."""
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))).alias("id"),
                      F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        packer = zstandard.ZstdCompressor(level=1)
        ids, texts, held = [], [], 0

        def block() -> pa.RecordBatch:
            offs = np.cumsum([0, *map(len, texts)]).astype("<i8")
            cols = [[(part << 32) + number], [np.concatenate(ids).astype("<i8").tobytes()], [offs.tobytes()],
                    [packer.compress(b"".join(texts))], [int(offs[-1])]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))],
                                              ["block", "ids", "offs", "data", "n_bytes"])

        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            raw, own = data.tobytes(), batch.column(0).to_numpy()
            for k, (a, b) in enumerate(zip(offs.tolist(), offs.tolist()[1:])):
                if held and held + b - a > BLOCK_BYTES:
                    yield block()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(own[k:k + 1])
                texts.append(raw[a:b])
                held += b - a
        if texts:
            yield block()

    return src.mapInArrow(run, "block bigint, ids binary, offs binary, data binary, n_bytes bigint")


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets and bytes of a stored block."""
    data = np.frombuffer(zstandard.decompress(row["data"]), np.uint8)
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["offs"], "<i8"), data


def cover_sample(offs: np.ndarray, data: np.ndarray, length: int, buckets: int):
    """Cover positions, their fingerprints' order numbers, distinct fingerprints and which of them two documents of the block have."""
    gram = length - PERIOD + 1
    sizes = np.diff(offs)
    inside = np.arange(len(data)) - np.repeat(offs[:-1], sizes)
    fits = np.isin(np.arange(PERIOD), COVER)[inside % PERIOD] & (inside + gram <= np.repeat(np.where(sizes >= length, sizes, 0), sizes))
    at = np.flatnonzero(fits)
    distinct, number = np.unique(fingerprints(data, gram, at), return_inverse=True)
    doc = np.searchsorted(offs, at, "right") - 1
    low, high = np.full(len(distinct), len(sizes)), np.full(len(distinct), -1)
    np.minimum.at(low, number, doc)
    np.maximum.at(high, number, doc)
    return at, number, distinct, low < high


def sliced(distinct: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted fingerprints."""
    own = bucket_of(distinct, buckets)
    cuts = np.flatnonzero(np.diff(own)) + 1
    edges = [0, *cuts.tolist(), len(distinct)]
    return [(int(own[a]), a, b) for a, b in zip(edges, edges[1:]) if a < b]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def one(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema)], [n for n, _ in schema])


SENT = [("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())]
ANSWER = [("block", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())]


def shared_cover(blocks: DataFrame, length: int, buckets: int) -> DataFrame:
    """(block, bucket, bits): which distinct cover suffixes of a block another block has as well."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            _, offs, data = unpack(row)
            _, _, distinct, _ = cover_sample(offs, data, length, buckets)
            short = distinct.astype("<u4")
            yield one(SENT[:3], [(b, row["block"], short[lo:hi].tobytes()) for b, lo, hi in sliced(distinct, buckets)])

    def sort(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u4") for x in table["keys"].to_pylist()]
        keys = np.concatenate(parts)
        order = np.sort(keys)
        again = np.unique(order[1:][order[1:] == order[:-1]])
        edges = np.cumsum([0, *map(len, parts)])
        found = np.zeros(len(keys), bool)
        if len(again):
            found = again[np.minimum(np.searchsorted(again, keys), len(again) - 1)] == keys
        bits = [np.packbits(found[a:b]).tobytes() for a, b in zip(edges, edges[1:])]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})

    return (blocks.mapInArrow(send, "bucket bigint, block bigint, keys binary")
            .groupBy("bucket").applyInArrow(sort, "block bigint, bucket bigint, bits binary"))


def read_bits(answers: list[dict], slices: list[tuple[int, int, int]], n: int) -> np.ndarray:
    by_bucket = {a["bucket"]: a["bits"] for a in answers or []}
    out = np.zeros(n, bool)
    for b, lo, hi in slices:
        if b in by_bucket:
            out[lo:hi] = np.unpackbits(np.frombuffer(by_bucket[b], np.uint8), count=hi - lo)
    return out


def gathered(answers: DataFrame) -> DataFrame:
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))


REGIONS = [("block", pa.int64()), ("ids", pa.binary()), ("doc", pa.binary()), ("start", pa.binary()), ("offs", pa.binary()),
           ("data", pa.binary()), ("n_windows", pa.int64())]


def regions(blocks: DataFrame, cover: DataFrame, length: int, buckets: int) -> DataFrame:
    """The text whose suffixes have a shared cover rank within a period: (block, ids, doc, start, offs, data)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for row in rows_of(batches):
            ids, offs, data = unpack(row)
            at, number, distinct, several = cover_sample(offs, data, length, buckets)
            hot = at[(several | read_bits(row["answers"], sliced(distinct, buckets), len(distinct)))[number]]
            doc = np.searchsorted(offs, hot, "right") - 1
            step = np.zeros(len(data) + 1, np.int32)
            np.add.at(step, np.maximum(hot - PERIOD + 1, offs[doc]), 1)
            np.add.at(step, hot + 1, -1)
            window = np.cumsum(step[:-1]) > 0
            tail = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(data)) < length  # too near the document's end
            window &= ~tail
            edge = np.flatnonzero(np.diff(np.concatenate([[False], window, [False]]).astype(np.int8)))
            first, last = edge[::2], edge[1::2]  # windows start in [first, last)
            if not len(first):
                continue
            doc = np.searchsorted(offs, first, "right") - 1
            sizes = last - first + length - 1
            own = np.concatenate([[0], np.cumsum(sizes)])
            text = data[np.repeat(first - own[:-1], sizes) + np.arange(own[-1])]
            yield one(REGIONS, [(row["block"], row["ids"], doc.astype("<i4").tobytes(), (first - offs[doc]).astype("<i8").tobytes(),
                                 own.astype("<i8").tobytes(), packer.compress(text.tobytes()), int((last - first).sum()))])

    joined = blocks.join(gathered(cover), "block", "left").select("block", "ids", "offs", "data", "answers")
    return joined.mapInArrow(cut, "block bigint, ids binary, doc binary, start binary, offs binary, data binary, n_windows bigint")


def region_windows(row: dict, length: int) -> tuple[np.ndarray, ...]:
    """Fingerprint, document number and start of every window of a block's regions, and the block's ids."""
    ids, offs, data = unpack(row)
    doc, start = np.frombuffer(row["doc"], "<i4"), np.frombuffer(row["start"], "<i8")
    n = np.diff(offs) - length + 1
    at = np.arange(n.sum()) + np.repeat(offs[:-1] - np.cumsum(n) + n, n)
    return (fingerprints(data, length, at), np.repeat(doc, n), at - np.repeat(offs[:-1], n) + np.repeat(start, n), ids)


def distinct_windows(row: dict, length: int, buckets: int, only: int | None):
    """Windows of a pass (all: None), number of each one's distinct string, those strings, and each string's smallest id."""
    h, doc, start, ids = region_windows(row, length)
    if only is not None:
        mine = bucket_of(h, buckets) % np.uint64(PASSES) == only
        h, doc, start = h[mine], doc[mine], start[mine]
    order = np.argsort(h)
    h = h[order]
    new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    smallest = np.minimum.reduceat(ids[doc[order]], first) if len(first) else np.zeros(0, np.int64)
    return doc, start, ids, number, h[first], smallest


def earlier(table: DataFrame, length: int, buckets: int, only: int) -> DataFrame:
    """One pass: (block, bucket, bits), which of a block's distinct strings an earlier document of another block has."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            *_, strings, smallest = distinct_windows(row, length, buckets, only)
            out = []
            for b, lo, hi in sliced(strings, buckets):
                order = np.argsort(smallest[lo:hi], kind="stable")
                ids, counts = np.unique(smallest[lo:hi], return_counts=True)
                out.append((b, row["block"], strings[lo:hi][order].astype("<u8").tobytes(), ids.astype("<i8").tobytes(),
                            counts.astype("<i4").tobytes()))
            yield one(SENT, out)

    def sort(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u8") for x in t["keys"].to_pylist()]
        ids = [np.repeat(np.frombuffer(i, "<i8"), np.frombuffer(c, "<i4")) for i, c in zip(t["ids"].to_pylist(), t["counts"].to_pylist())]
        keys, own = np.concatenate(parts), np.concatenate(ids)
        order = np.argsort(keys)
        sorted_ = keys[order]
        first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
        least = np.minimum.reduceat(own[order], first)
        before = np.empty(len(keys), bool)
        before[order] = np.repeat(least, np.diff(np.append(first, len(keys)))) < own[order]
        edges = np.cumsum([0, *map(len, parts)])
        bits = [np.packbits(before[a:b]).tobytes() for a, b in zip(edges, edges[1:])]
        return pa.table({"block": t["block"], "bucket": t["bucket"], "bits": pa.array(bits, pa.binary())})

    return (table.mapInArrow(send, "bucket bigint, block bigint, keys binary, ids binary, counts binary")
            .groupBy("bucket").applyInArrow(sort, "block bigint, bucket bigint, bits binary"))


SPANS = [("block", pa.int64()), ("doc", pa.binary()), ("lo", pa.binary()), ("hi", pa.binary())]


def removed_spans(table: DataFrame, answers: DataFrame, length: int, buckets: int) -> DataFrame:
    """(block, doc, lo, hi): maximal removed runs, as packed document numbers and byte ranges."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            doc, start, ids, number, strings, smallest = distinct_windows(row, length, buckets, None)
            bits = np.zeros(len(strings), bool)
            by_bucket = {a["bucket"]: a["bits"] for a in row["answers"] or []}
            for b, lo, hi in sliced(strings, buckets):
                if b in by_bucket:
                    order = np.argsort(smallest[lo:hi], kind="stable")
                    bits[lo + order] = np.unpackbits(np.frombuffer(by_bucket[b], np.uint8), count=hi - lo)
            gone = bits[number] | (ids[doc] > smallest[number])
            doc, start = doc[gone].astype(np.int64), start[gone]  # in document and position order
            if len(doc):
                new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length))
                lo = start[new]
                hi = start[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)] + length
                yield one(SPANS, [(row["block"], doc[new].astype("<i4").tobytes(), lo.astype("<i8").tobytes(), hi.astype("<i8").tobytes())])

    joined = table.join(gathered(answers), "block", "left").select("block", "ids", "doc", "start", "offs", "data", "answers")
    return joined.mapInArrow(mark, "block bigint, doc binary, lo binary, hi binary")


def release(spark: SparkSession) -> None:
    """Let the driver drop its references to finished shuffles, which frees their files on the executors."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                   keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), one row per row. ``length`` must be over ``PERIOD``."""
    if length <= PERIOD:
        raise ValueError(f"length must be over {PERIOD}")
    spark = docs.sparkSession
    blocks, _ = store(pack_blocks(docs, id_col, text_col), "suffix-blocks")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = blocks.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    buckets = PASSES * max(partitions, -(-total // BUCKET_BYTES))
    cover, at_cover = store(shared_cover(blocks, length, 2 * buckets // PASSES), "suffix-cover")
    release(spark)
    part, at_regions = store(regions(blocks, cover, length, 2 * buckets // PASSES), "suffix-regions")
    release(spark)
    answers, at_answers = None, []
    for only in range(PASSES):
        one_pass, path = store(earlier(part, length, 2 * buckets, only), "suffix-pass")
        answers = one_pass if answers is None else answers.unionByName(one_pass)
        at_answers.append(path)
        release(spark)
    spans, _ = store(removed_spans(part, answers, length, 2 * buckets), "suffix-spans")
    discard(spark, at_cover, at_regions, *at_answers)
    release(spark)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                 ("kept_sha256", pa.string()), *[("kept", pa.binary())] * keep_bytes]
        for row in rows_of(batches):
            ids, offs, data = unpack(row)
            of, lo, hi = ((np.frombuffer(row[c] or b"", t)) for c, t in (("doc", "<i4"), ("lo", "<i8"), ("hi", "<i8")))
            raw = data.tobytes()
            out = []
            for k, (a, b) in enumerate(zip(offs.tolist(), offs.tolist()[1:])):
                mine = slice(*np.searchsorted(of, [k, k + 1]))
                left, at = [], 0
                for x, y in zip(lo[mine].tolist(), hi[mine].tolist()):
                    left.append(raw[a + at:a + x])
                    at = y
                left = b"".join([*left, raw[a + at:b]])
                name = None if ids[k] == LAST else int(ids[k])
                out.append((name, b - a, b - a - len(left), mine.stop - mine.start, hashlib.sha256(left).hexdigest(), *[left] * keep_bytes))
            yield one(kinds, out)

    schema = f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_bytes
    return (blocks.select("block", "ids", "offs", "data").join(spans, "block", "left").mapInArrow(finish, schema))
