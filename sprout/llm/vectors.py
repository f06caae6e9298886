"""Embedding near-dedup by product quantisation.

Vectors are put into coarse inverted lists (spherical k-means) and their
residuals coded per subspace. A vector probes the lists nearest to it; in each
cell the asymmetric distance of a probing vector to the coded members is read
from lookup tables, members that can reach the threshold given their own stored
quantisation error are kept (so the tables lose nothing), and these are reranked
by their exact cosine in double precision. A pair that both of its ends probe is
counted in one cell only.

Centroids and codebooks are fitted on a bounded sample (``TRAIN_ROWS``); every
row is indexed. Recall is that of the probes: a pair is missed only if neither
end's list is among the other's ``PROBES`` nearest.

Equal vectors are one class and never meet as pairs; links are counted and
reduced to a spanning forest inside each cell, and cells are split into blocks
of members and probes, so neither pairs nor a large cell leave a task.

Vectors that are null, empty, zero, or hold null or non-finite components, link
with nothing, and vectors of different lengths don't link with each other. Rows
that repeat a vec_id are separate vectors of one node. Only the id and vector
columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, components, local_roots, store

TRAIN_ROWS, MAX_LISTS, PROBES = 16_384, 4096, 16
SUBSPACES, CODES = 8, 64
MEMBER_BLOCK, PROBE_BLOCK = 512, 2048


def unit(vectors: np.ndarray) -> np.ndarray:
    """Double-precision unit vectors; first scaled by the largest component, so that norms stay finite."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((points[:, None, :] - centres[None]) ** 2).sum(2).argmin(1) if len(points) * len(centres) < 1 << 16 \
        else ((centres ** 2).sum(1) - 2 * points @ centres.T).argmin(1)


def kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(points, centres)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Quantiser:
    """Coarse centroids and residual codebooks for unit vectors of one dimension."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.centres = kmeans(sample, min(lists, len(sample)), rng)
        residuals = sample - self.centres[nearest(sample, self.centres)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [kmeans(residuals[:, c], min(CODES, len(sample)), rng, 6) for c in self.cuts]

    def encode(self, vectors: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual codes, and the length of what they leave out."""
        residuals = vectors - self.centres[lists]
        codes = np.stack([nearest(residuals[:, c], b) for c, b in zip(self.cuts, self.books)], 1)
        for c, b, k in zip(self.cuts, self.books, codes.T):
            residuals[:, c] -= b[k]
        return codes.astype(np.uint8), np.linalg.norm(residuals, axis=1)

    def probes(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists, nearest first."""
        far = (self.centres ** 2).sum(1) - 2 * vectors @ self.centres.T
        n = min(n, far.shape[1])
        some = np.argpartition(far, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.take_along_axis(far, some, 1).argsort(1, kind="stable"), 1)

    def lookup(self, probing: np.ndarray, members: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate cosines of probing vectors (rows) and coded members of list ``members``."""
        out = probing @ self.centres[members][:, None]
        out = np.broadcast_to(out, (len(probing), len(codes))).copy()
        for c, b, k in zip(self.cuts, self.books, codes.T):
            out += (probing[:, c] @ b.T)[:, k]
        return out


def read_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, dim, vec): vec is the packed vector in its own precision, null where it can't link."""
    good = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~F.exists(
        vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    src = table.select(F.col(id_col).cast("long").alias("vec_id"), F.when(good, F.col(vec_col)).alias("v"))
    kind = packed_type(table, vec_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if x is None else np.array(x, kind) for x in batch.column(1).to_pylist()]
            rows = [x if x is not None and x.any() else None for x in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([0 if x is None else len(x) for x in rows], pa.int32()),
                 pa.array([None if x is None else (x + 0).tobytes() for x in rows], pa.binary())],  # -0 is 0
                ["vec_id", "dim", "vec"])

    return src.mapInArrow(run, "vec_id bigint, dim int, vec binary")


def packed_type(table: DataFrame, vec_col: str) -> str:
    return "<f4" if "float" in table.schema[vec_col].dataType.simpleString() else "<f8"


def unpack(col: pa.Array, dim: int, kind: str) -> np.ndarray:
    """Unit vectors of a packed column."""
    return unit(np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, dim))


def cell_links(quantiser: Quantiser, cell: int, threshold: float, m: dict, q: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one cell's members and probing vectors: (ids, added links), spanning (u, v)."""
    ids = np.unique(np.concatenate([m["id"], q["id"]]))
    added, us, vs = np.zeros(len(ids), np.int64), [], []
    mi, qi = np.searchsorted(ids, m["id"]), np.searchsorted(ids, q["id"])
    for lo in range(0, len(qi), 256):
        part = slice(lo, lo + 256)
        near = quantiser.lookup(q["vec"][part], cell, m["codes"])
        i, j = np.nonzero(near >= threshold - m["error"][None] - 1e-9)
        i += lo
        home, mutual = q["list"][i], np.zeros(len(i), bool)
        other = home != cell
        mutual[other] = (m["probes"][j[other]] == home[other, None]).any(1)  # the other end's cell sees this pair too
        mine = np.where(other, ~mutual | (home < cell), q["id"][i] < m["id"][j])
        i, j = i[mine], j[mine]
        for at in range(0, len(i), 1 << 16):
            a, b = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            hit = np.einsum("ij,ij->i", q["vec"][a], m["vec"][b]) >= threshold
            a, b = a[hit], b[hit]
            np.add.at(added, qi[a], m["n"][b])
            np.add.at(added, mi[b], q["n"][a])
            us.append(qi[a])
            vs.append(mi[b])
    none = [np.zeros(0, np.int64)]
    root = local_roots(np.concatenate(none + us), np.concatenate(none + vs), len(ids))
    some = added > 0
    return ids[some], added[some], ids[root[some]]


def near_duplicates(table: DataFrame, threshold: float = 0.9, probes: int = PROBES, id_col: str = "vec_id",
                    vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row."""
    rows, _ = store(read_vectors(table, id_col, vec_col), "vectors")
    # equal vectors: one class; its id is its smallest vec_id
    classes, _ = store(rows.where("vec IS NOT NULL").groupBy("dim", "vec")
                       .agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vector-classes")
    dims = classes.groupBy("dim").agg(F.count("*").alias("n")).collect()
    kind = packed_type(table, vec_col)
    none = table.sparkSession.createDataFrame([], "id bigint, added bigint, root bigint")
    found = [links_of(classes.where(F.col("dim") == d["dim"]), d["dim"], d["n"], kind, threshold, probes) for d in dims]
    links, _ = store(functools.reduce(DataFrame.unionByName, found, none), "vector-links")
    added = links.groupBy("id").agg(F.sum("added").alias("added"))
    classed, _ = store(rows.join(classes, ["dim", "vec"], "left").select("vec_id", "id", "n"), "vector-classed")
    tops, _ = components(links.selectExpr("id AS u", "root AS v").unionByName(
        classed.where("id IS NOT NULL").selectExpr("vec_id AS u", "id AS v")), "vector-components")
    result = (classed.join(apart(added, "id"), "id", "left")
              .join(apart(tops.withColumnRenamed("node", "vec_id"), "vec_id"), "vec_id", "left"))
    component = F.coalesce("component", "vec_id")
    return result.select("vec_id", (F.coalesce("added", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).alias("n_links"),
                         component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def links_of(classes: DataFrame, dim: int, n: int, kind: str, threshold: float, probes: int) -> DataFrame:
    """(id, added, root) of the ``n`` classes of one dimension."""
    draw = F.pmod(F.xxhash64("id", F.lit("pq")), F.lit(1 << 30))
    drawn = classes.where(draw < math.ceil(min(1.0, TRAIN_ROWS / n) * (1 << 30))).orderBy(draw, "id").limit(2 * TRAIN_ROWS)
    sample = [r["vec"] for r in drawn.select("vec").collect()] or [np.ones(dim, kind).tobytes()]
    quantiser = Quantiser(unpack(pa.array(sample, pa.binary()), dim, kind), min(MAX_LISTS, max(1, round(math.sqrt(n)))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A member row in its own list, a probing row in each probed list."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                v = unpack(part.column(1), dim, kind)
                near = quantiser.probes(v, probes)
                codes, error = quantiser.encode(v, near[:, 0])
                own = np.arange(len(v))
                at = np.concatenate([own, np.repeat(own, near.shape[1])])
                member = np.arange(len(at)) < len(v)
                coded = pa.array([c.tobytes() for c in codes], pa.binary())
                probed = pa.array([p.astype("<i4").tobytes() for p in near], pa.binary())
                only = pa.array(np.where(member, at, 0), mask=~member)  # null for probing rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([near[:, 0], near.ravel()]).astype(np.int32)), pa.array(member),
                     *(part.column(k).take(pa.array(at)) for k in range(3)), pa.array(near[at, 0].astype(np.int32)),
                     coded.take(only), pa.array(np.where(member, error[at], 0.0)), probed.take(only)],
                    ["cell", "member", "id", "vec", "n", "list", "codes", "error", "probes"])

    placed = classes.select("id", "vec", "n").mapInArrow(
        place, "cell int, member boolean, id bigint, vec binary, n bigint, list int, codes binary, error double, probes binary")
    # blocks: a member meets every block of its cell's probing rows, and the other way round
    sizes = placed.groupBy("cell").agg(
        F.ceil(F.count_if("member") / MEMBER_BLOCK).cast("int").alias("mblocks"),
        F.ceil(F.count_if(~F.col("member")) / PROBE_BLOCK).cast("int").alias("pblocks")).where("mblocks > 0")
    own = F.expr("CAST(pmod(xxhash64(id), CASE WHEN member THEN mblocks ELSE pblocks END) AS INT)")
    blocks = (placed.join(F.broadcast(sizes), "cell").withColumn("own", own)  # at most MAX_LISTS rows
              .withColumn("other", F.explode(F.expr("sequence(0, CASE WHEN member THEN pblocks ELSE mblocks END - 1)")))
              .withColumn("block", F.expr("CASE WHEN member THEN own * 1000000L + other ELSE other * 1000000L + own END"))
              .select("cell", "block", "member", "id", "n", "vec", "list", "codes", "error", "probes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ends = [t.filter(t["member"]), t.filter(pc.invert(t["member"]))]
            found = [np.zeros(0, np.int64)] * 3
            if all(len(x) for x in ends):
                m, q = ({"id": x["id"].to_numpy(), "n": x["n"].to_numpy(), "list": x["list"].to_numpy(),
                         "vec": unpack(x["vec"], dim, kind), "error": x["error"].to_numpy()} for x in ends)
                m["codes"] = np.frombuffer(b"".join(ends[0]["codes"].to_pylist()), np.uint8).reshape(len(m["id"]), -1)
                m["probes"] = np.frombuffer(b"".join(ends[0]["probes"].to_pylist()), "<i4").reshape(len(m["id"]), -1)
                found = cell_links(quantiser, t["cell"][0].as_py(), threshold, m, q)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["id", "added", "root"])

        now = None
        for batch in batches:
            cell, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1])) + 1
            for a, b in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if now not in (None, (cell[a], block[a])):
                    yield links()
                    held.clear()
                now = cell[a], block[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield links()

    partitions = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (blocks.repartition(partitions, "cell", "block").sortWithinPartitions("cell", "block")
            .mapInArrow(run, "id bigint, added bigint, root bigint"))
