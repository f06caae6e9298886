"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are tokenised, closed by an end id and cut into pieces of at most
``size`` tokens (only longer ones; the first piece takes the rest). Packing looks
only at piece lengths, so the search works on the histogram of lengths, which
has at most ``size`` entries however many pieces there are: a chromosome is a
set of bin patterns (lengths in a bin) with multiplicities. Crossover injects
whole well-filled bins of one parent, drops the other parent's bins that would
use a length too often, and best-fits the displaced lengths; mutation empties
the worst bins. Islands run as Spark tasks and pass their elites round a ring
between epochs. The best solution becomes a small slot table, and pieces take
the slots of their length by rank; ranks are offsets of hash blocks plus the
rank inside a block, so a length that a third of all pieces have is no hot key.

Null and empty texts are one piece that holds the end id alone. Rows that repeat
a doc_id are packed separately. Ties (pieces of equal length) take slots by
doc_id, piece and digest. Only the id and text columns are read. An empty table
gives an empty result.
"""

from __future__ import annotations

import json
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import store

SIZE, END_ID = 1024, 2
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 6, 2, 6, 8
BLOCK_ROWS = 200_000

Pattern = tuple[int, ...]


def added_tokens(path: str) -> dict[bytes, int]:
    """Added tokens of the tokenizer JSON beside a vocabulary file; none without that file."""
    described = Path(path).with_suffix(".json")
    tokens = json.loads(described.read_text())["added_tokens"] if described.exists() else []
    if odd := [t["content"] for t in tokens if t["single_word"] or t["lstrip"] or t["rstrip"]]:
        raise ValueError(f"added tokens that depend on their surroundings are not supported: {odd}")
    return {t["content"].encode(): t["id"] for t in tokens}


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, keep_ids: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and end id, cut.

    The tokenizer's added tokens (``<|endoftext|>``) are matched in text, as the library does.
    """
    coded = bpe.encode(docs, path, id_col, text_col, added=added_tokens(path)).select(
        F.col(id_col).alias("doc_id"), (F.col("n_tokens") + 1).alias("n"),
        F.concat("ids", F.lit(end_id.to_bytes(4, "little"))).alias("all"))
    first = F.pmod(F.col("n") - 1, F.lit(size)) + 1
    cut = (coded.withColumn("first", first)
           .withColumn("piece", F.explode(F.expr(f"sequence(0, CAST((n - 1) DIV {size} AS INT))")))
           .withColumn("start", F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("first") + (F.col("piece") - 1) * size).cast("long"))
           .withColumn("length", F.when(F.col("piece") == 0, F.col("first")).otherwise(F.lit(size)).cast("long"))
           .withColumn("ids", F.expr("substring(all, CAST(start * 4 + 1 AS INT), CAST(length * 4 AS INT))"))
           .withColumn("ids_crc32", F.crc32("ids")))
    return cut.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids)


class Bins:
    """Bin patterns with multiplicities, indexed by the room left."""

    def __init__(self, size: int):
        self.size, self.rooms = size, np.zeros(size + 1, np.int64)
        self.by_room: dict[int, Counter] = defaultdict(Counter)

    def add(self, pattern: Pattern, n: int) -> None:
        room = self.size - sum(pattern)
        self.by_room[room][pattern] += n
        self.rooms[room] += n

    def best_fit(self, loose: np.ndarray) -> None:
        """Place loose[length] pieces, longest first, each where least room is left; equal lengths together."""
        for length in np.flatnonzero(loose)[::-1].tolist():
            n = int(loose[length])
            while n:
                fits = np.flatnonzero(self.rooms[length:])
                if not len(fits):
                    each = self.size // length
                    if n // each:
                        self.add((length,) * each, n // each)
                    if n % each:
                        self.add((length,) * (n % each), 1)
                    break
                room = length + int(fits[0])
                patterns = self.by_room[room]
                pattern, m = next(iter(patterns.items()))
                take = min(n, m)
                n -= take
                if take == m:
                    del patterns[pattern]
                else:
                    patterns[pattern] -= take
                self.rooms[room] -= take
                self.add(tuple(sorted((*pattern, length), reverse=True)), take)

    def chromosome(self) -> dict[Pattern, int]:
        return {p: n for patterns in self.by_room.values() for p, n in patterns.items() if n}


def fitness(bins: dict[Pattern, int], size: int) -> tuple[int, float]:
    """Fewest bins first, then the squared fill that rewards full bins."""
    return -sum(bins.values()), sum(n * (sum(p) / size) ** 2 for p, n in bins.items())


def keep(bins: list[tuple[Pattern, int]], loose: np.ndarray, into: Bins) -> None:
    """Move as many copies of each pattern as ``loose`` still has pieces for."""
    for pattern, n in bins:
        need = Counter(pattern)
        n = min(n, *(int(loose[s]) // k for s, k in need.items()))
        if n > 0:
            for s, k in need.items():
                loose[s] -= n * k
            into.add(pattern, n)


def crossover(a: dict, b: dict, histogram: np.ndarray, size: int, rng: random.Random) -> dict:
    """Inject well-filled bins of ``b`` into ``a``, drop what they double, best-fit the displaced."""
    out, loose = Bins(size), histogram.copy()
    full = [(p, n) for p, n in b.items() if size - sum(p) <= size // 256]
    injected = [(p, rng.randint(1, n)) for p, n in full if rng.random() < 0.5]
    keep(injected, loose, out)
    room = sorted(a.items(), key=lambda x: (size - sum(x[0]), rng.random()))
    worst = rng.uniform(0, size / 16)  # mutation: bins with more room are emptied
    keep([(p, n) for p, n in room if size - sum(p) <= worst], loose, out)
    out.best_fit(loose)
    return out.chromosome()


def complements_first(histogram: np.ndarray, size: int, rng: random.Random) -> dict:
    """A start: exact pairs and random exact triples of lengths, then best fit."""
    out, loose = Bins(size), histogram.copy()
    loose_pairs = [(s, size - s) for s in range(size // 2, size) if size - s > 0]
    keep([((a, b), int(min(loose[a], loose[b]))) for a, b in loose_pairs if loose[a] and loose[b] and rng.random() < 0.8], loose, out)
    for _ in range(size):
        there = np.flatnonzero(loose)
        if len(there) < 3:
            break
        a, b = int(rng.choice(there)), int(rng.choice(there))
        if 0 < size - a - b and loose[size - a - b]:
            p = tuple(sorted((a, b, size - a - b), reverse=True))
            keep([(p, int(min(loose[s] for s in p)))], loose, out)
    out.best_fit(loose)
    return out.chromosome()


def evolve(start: list[dict], histogram: np.ndarray, size: int, generations: int, population: int, seed: int) -> list[dict]:
    """One island for one epoch; best first. Stops at the volume bound."""
    rng, bound = random.Random(seed), -(-int((histogram * np.arange(size + 1)).sum()) // size)
    people = list(start)
    if not people:
        plain = Bins(size)
        plain.best_fit(histogram)
        people = [plain.chromosome()]
    while len(people) < population and -fitness(people[0], size)[0] > bound:
        people.append(complements_first(histogram, size, rng))
    rank = lambda x: fitness(x, size)
    for _ in range(generations):
        people.sort(key=rank, reverse=True)
        if -rank(people[0])[0] <= bound or len(people) < 2:
            break
        children = []
        for _ in range(population // 2):
            a, b = rng.sample(people, 2)
            children.append(crossover(a, b, histogram, size, rng))
        people = sorted(people + children, key=rank, reverse=True)[:population]
    return people


def search(spark, histogram: dict[int, int], size: int = SIZE, islands: int = ISLANDS, epochs: int = EPOCHS,
           population: int = POPULATION, generations: int = GENERATIONS) -> dict[Pattern, int]:
    """Bin patterns with multiplicities for a histogram of piece lengths."""
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    bound = -(-int((counts * np.arange(size + 1)).sum()) // size)
    elites: list[list[dict]] = [[] for _ in range(islands)]
    for epoch in range(epochs):
        coming = [elites[i] + elites[i - 1][:1] for i in range(islands)]  # a ring: each gets its neighbour's best

        def run(frames):
            for frame in frames:
                for i in frame["id"]:
                    people = evolve(coming[i], counts, size, generations, population, 1000 * epoch + int(i))
                    said = [[[list(p), n] for p, n in x.items()] for x in people[:2]]
                    yield pd.DataFrame({"island": [i], "elites": [json.dumps(said)]})

        rows = spark.range(0, islands, 1, islands).mapInPandas(run, "island bigint, elites string").collect()
        for r in rows:
            elites[r["island"]] = [{tuple(p): n for p, n in x} for x in json.loads(r["elites"])]
        best = max((x for e in elites for x in e), key=lambda x: fitness(x, size))
        if sum(best.values()) <= bound:
            break
    return best


def slots(bins: dict[Pattern, int]) -> list[tuple[int, int, int, int, int]]:
    """(length, from, to, sequence, offset): ranks [from, to) of a length lie in sequences from ``sequence`` on."""
    used, out, sequence = Counter(), [], 0
    for pattern, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length in pattern:
            out.append((length, used[length], used[length] + n, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return out


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, keep_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text", **search_options) -> DataFrame:
    """Pieces with their place: (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)."""
    spark = docs.sparkSession
    cut, _ = store(pieces(docs, path, size, end_id, keep_ids, id_col, text_col), "packing-pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(search(spark, histogram, size, **search_options)) if histogram else []
    blocks = max(64, math.ceil(sum(histogram.values()) / BLOCK_ROWS))
    dealt = cut.withColumn("block", F.expr(f"pmod(xxhash64(doc_id, piece, ids_crc32), {blocks})"))
    before = (dealt.groupBy("length", "block").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).drop("n"))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (dealt.withColumn("r", F.row_number().over(inside) - 1).join(before, ["length", "block"])
              .withColumn("r", F.col("r") + F.col("before")))
    places = spark.createDataFrame(table, "slot_length bigint, lo bigint, hi bigint, first bigint, offset bigint")
    if len(table) < 1_000_000:  # follows the number of patterns, not of pieces
        places = F.broadcast(places)
    return (ranked.join(places, (F.col("length") == F.col("slot_length")) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
            .withColumn("sequence_id", F.col("first") + F.col("r") - F.col("lo"))
            .select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "sequence_id", "offset"))
