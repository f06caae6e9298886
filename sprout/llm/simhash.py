"""SimHash near-dedup: byte-position inverted index with count filtering.

Fingerprints are 64-bit SimHashes of word shingles. Two fingerprints that differ
in at most ``max_bits`` (< 8) bits agree in at least ``8 - max_bits`` of their
eight byte positions. The inverted index posts a fingerprint under its bytes at
position subsets, one subset family meeting every set of that many agreeing
positions (a Turan family of triples for four); a pair met in a posting has its
equal positional bytes tallied, stays only with the guaranteed minimum, and is
then verified by its exact bit distance. Posting under single bytes would put
1/256 of all fingerprints in each list; the triples are intersections of three
such lists and lose no pair.

Equal fingerprints are collapsed first, so copies never meet as pairs, and
postings longer than ``BLOCK`` are split into pairs of blocks; links are reduced
to a spanning forest inside each task before the components are found.

Null and empty texts (and texts without words) have fingerprint zero and link
with each other like any other equal fingerprints. Rows that repeat a doc_id
give a row each; the id's component is the smallest any of its rows reaches.
Only the id and text columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, components, discard, local_roots, store, text_buffers

SEED = 42
BLOCK = 512
POSITIONS = 8


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of the ASCII-lower-cased, white-space-split words' shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b - 1], SEED) for a, b in zip(starts, starts[shingle:])], "<u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        part = hashes[lo:lo + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the signed 64-bit form of each row's fingerprint."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            raw, offs = data.tobytes(), offs.tolist()
            fps = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(offs, offs[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return src.mapInArrow(run, "doc_id bigint, fp bigint")


def position_family(agree: int) -> list[tuple[int, ...]]:
    """Position subsets, at least one inside every set of ``agree`` positions.

    Subsets of size ``agree - 1`` by the cyclic three-group rule when agree is 4
    (Turan's construction), else all subsets of size ``agree``.
    """
    if agree != 4:
        return list(itertools.combinations(range(POSITIONS), agree))
    group = [p % 3 for p in range(POSITIONS)]
    family = []
    for t in itertools.combinations(range(POSITIONS), 3):
        sizes = [sum(group[p] == g for p in t) for g in range(3)]
        if 3 in sizes or any(sizes[g] == 2 and sizes[(g + 1) % 3] == 1 for g in range(3)):
            family.append(t)
    return family


def posting_keys(max_bits: int) -> list:
    """Key expressions: subset number in the high bits over the chosen bytes (hashed when over seven)."""
    keys = []
    for k, positions in enumerate(position_family(POSITIONS - max_bits)):
        key = F.lit(k).cast("long")
        for p in positions:
            byte = F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(F.lit(255))
            key = F.shiftleft(key, 8).bitwiseOR(byte) if len(positions) < 7 else F.xxhash64(key, byte)
        keys.append(key)
    return keys


def verified_links(members: list[np.ndarray], agree: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within postings: count filter on equal positional bytes, then bit distance."""
    out_u, out_v = [], []
    for fps in members:
        n = len(fps)
        own = fps.view(np.uint8).reshape(n, 8)
        us, vs = [], []
        for lo in range(0, n, 128):
            equal = np.zeros((min(128, n - lo), n), np.uint8)
            for p in range(POSITIONS):
                equal += own[lo:lo + 128, p, None] == own[None, :, p]
            i, j = np.nonzero(equal >= agree)
            i += lo
            i, j = i[i < j], j[i < j]
            near = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
            us.append(i[near])
            vs.append(j[near])
        root = local_roots(np.concatenate(us), np.concatenate(vs), n)
        linked = np.flatnonzero(root != np.arange(n))
        out_u.append(fps[linked])
        out_v.append(fps[root[linked]])
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(none + out_u), np.concatenate(none + out_v)


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Spanning links (a, b) among distinct fingerprints ``fp``."""
    agree = POSITIONS - max_bits
    posts = fps.select("fp", F.explode(F.array(*posting_keys(max_bits))).alias("key"))
    sizes = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    split = (posts.join(apart(sizes, "key"), "key")
             .withColumn("blocks", F.expr(f"CAST(ceil(n / {BLOCK}) AS INT)"))
             .withColumn("block", F.expr("CAST(pmod(xxhash64(fp), blocks) AS INT)"))
             .select("fp", "key", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"), "block")
             .select("key", F.expr("least(block, other) * 1000003L + greatest(block, other)").alias("cell"), "fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
                held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
                if not len(held[0]):
                    continue
            elif held is None or not len(held[0]):
                return
            key, cell, fp = held
            new = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
            done = len(key) if batch is None else (int(new[-1]) if len(new) else 0)  # the last run may go on
            cuts = np.append(np.append(0, new[new < done]), done)
            runs = [fp[a:b].view(np.uint64) for a, b in zip(cuts, cuts[1:]) if b - a > 1]
            u, v = verified_links(runs, agree, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["a", "b"])
            held = [x[done:] for x in held]

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (split.repartition(n, "key", "cell").sortWithinPartitions("key", "cell")
            .mapInArrow(run, "a bigint, b bigint").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of at most ``max_bits`` bits."""
    spark = docs.sparkSession
    own, _ = store(fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    # An id with several fingerprints joins them; ids, not fingerprints, are the nodes.
    classes, at = store(own.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-classes")
    near = links(classes.select("fp"), max_bits)
    by_id = (near.join(classes.select(F.col("fp").alias("a"), F.col("doc_id").alias("u")), "a")
             .join(classes.select(F.col("fp").alias("b"), F.col("doc_id").alias("v")), "b").select("u", "v"))
    several = (own.join(own.groupBy("doc_id").agg(F.count_distinct("fp").alias("n")).where("n > 1"), "doc_id")
               .join(classes.select("fp", F.col("doc_id").alias("first")), "fp")
               .select(F.col("doc_id").alias("u"), F.col("first").alias("v")))
    found, _ = components(by_id.unionByName(several), "simhash-links")
    joined = (classes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
              .select("fp", F.coalesce("component", "doc_id").alias("component_id")))
    result, _ = store(joined, "simhash-components")
    discard(spark, at)
    return own.join(result, "fp").select("doc_id", "fp", "component_id")
