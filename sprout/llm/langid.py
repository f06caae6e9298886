"""Language identification with string kernels.

A text is the set of its character n-grams (n = 1 to 3, letters lower-cased,
every run of other characters one blank). The blended-spectrum presence kernel
of two texts is the number of n-grams they share over the geometric mean of
their sizes. Nystrom landmarks, drawn from the labelled texts of each language,
turn the kernel into finite features; one-versus-rest kernel ridge regression on
them gives a value per language. Scoring is two matrix products per batch:
presence rows times landmark rows, then kernel rows times coefficients.

Presence is kept in ``BUCKETS`` hashed n-grams. The classifier is fitted on every
labelled row; about ``LANDMARKS`` a language, chosen by a hash of the id, span its
features. Normal equations are summed inside the tasks and then, a row each, in the
cluster; only one of landmark size reaches the driver. Scoring reads every whole text
and nothing else.

Whether a text is in one of the learned languages at all is told by its likeness, which
doesn't depend on its size. Scores are linear in the presence of an n-gram, so each n-gram
has a weight per language. A text's mean weight over all n-grams as they occur, for its
best language, over the median of that language's labelled texts, is its likeness. A text
is rejected where that stays below ``LEAST_LIKE`` by more than chance (twice the inverse
root of the number of n-grams): short texts that can't be told are kept.

A null text, or one without a letter, is ``und`` with score 0, and so is every
text when no labelled row exists. Equal texts get equal results; ties go to the
first language in alphabetic order. Null labels aren't learned. Rows that repeat
a doc_id give a row each. Only the named columns are read.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import rank_within
from .common import discard, store, text_buffers

BUCKETS = 1 << 15
GRAMS = (1, 2, 3)
LANDMARKS = 48
RIDGE, FLOOR = 1e-3, 1e-6
BATCH_DOCS, BATCH_BYTES = 64, 1 << 20
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
UNKNOWN = "und"
LEAST_LIKE = 0.4


@functools.cache
def letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for other code points."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        if unicodedata.category(c := chr(cp))[0] == "L":
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def gram_buckets(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of a text's n-grams as they occur; nothing if it has no letter. Long texts go in overlapping parts."""
    cps = np.frombuffer(text.decode().encode("utf-32-le"), "<u4")
    for lo in range(0, len(cps), 1 << 18):
        low = letters()[cps[max(0, lo - 2):lo + (1 << 18)]]
        blank = low == 0
        if blank.all():
            continue
        low = low[~(blank & np.append(False, blank[:-1]))].astype(np.uint64)  # a run of others counts once
        if lo == 0 and low[0]:
            low = np.append(np.uint64(0), low)
        if lo + (1 << 18) >= len(cps) and low[-1]:
            low = np.append(low, np.uint64(0))
        key = np.zeros(len(low), np.uint64)
        for n in GRAMS:
            if len(low) < n:
                break
            key = key[:len(low) - n + 1] * MIX[2] + low[n - 1:] + np.uint64(n)
            mixed = (key ^ (key >> np.uint64(29))) * MIX[n % 2]
            yield mixed >> np.uint64(49)


def mark(text: bytes, row: np.ndarray) -> bool:
    """Set the buckets of a text's n-grams in ``row``; False if it has no letter."""
    found = False
    for buckets in gram_buckets(text):
        row[buckets], found = 1, True
    return found


def mean_weights(text: bytes, weights: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of a text's n-grams, and their mean weight per language."""
    n, total = 0, np.zeros(weights.shape[1])
    for buckets in gram_buckets(text):
        n += len(buckets)
        total += np.bincount(buckets, minlength=BUCKETS) @ weights
    return n, total / max(n, 1)


def presence(raw: bytes, offs: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Presence rows of some texts, and which have a letter."""
    rows = np.zeros((len(offs) - 1, BUCKETS), np.uint8)
    has = np.array([mark(raw[a:b], rows[k]) for k, (a, b) in enumerate(zip(offs, offs[1:]))], bool)
    return rows, has


class Model:
    """Landmarks over their own buckets, and coefficients of kernel values for each language."""

    def __init__(self, languages: list[str], marks: np.ndarray, coefficients: np.ndarray):
        self.languages, self.coefficients = languages, coefficients
        self.used = np.flatnonzero(marks.any(0))
        self.marks = np.packbits(marks[:, self.used], axis=1)
        self.sizes = marks.sum(1, dtype=np.int64)
        self.typical: np.ndarray | None = None  # median mean weight of each language's labelled texts

    @functools.cached_property
    def weights(self) -> np.ndarray:
        return np.unpackbits(self.marks, axis=1, count=len(self.used)).T.astype(np.float32)

    @functools.cached_property
    def gram_weights(self) -> np.ndarray:
        """Buckets x languages: what an n-gram's presence adds to a score, but for the text's own size."""
        out = np.zeros((BUCKETS, len(self.languages)))
        out[self.used] = self.weights.astype(float) @ (self.coefficients / np.sqrt(self.sizes)[:, None])
        return out

    def likeness(self, text: bytes) -> tuple[int, float]:
        """Number of a text's n-grams, and its likeness to its best language."""
        n, mean = mean_weights(text, self.gram_weights)
        return n, float((mean / self.typical).max()) if n else 0.0

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        shared = rows[:, self.used].astype(np.float32) @ self.weights
        return shared / np.sqrt(np.maximum(1, rows.sum(1, dtype=np.int64))[:, None] * self.sizes)

    def values(self, rows: np.ndarray) -> np.ndarray:
        return self.kernel(rows) @ self.coefficients


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def medians(values: DataFrame) -> dict[str, float]:
    """Exact median of ``own`` for each ``lang``, however many values a language has."""
    placed = rank_within(values, ["lang"], ["own"])
    sizes = values.groupBy("lang").agg(F.count("*").alias("n"))
    middle = (F.col("rn") == F.expr("(n + 1) div 2")) | (F.col("rn") == F.expr("n div 2 + 1"))
    return {r["lang"]: r["m"] for r in placed.join(F.broadcast(sizes), "lang").where(middle).groupBy("lang").agg(F.avg("own").alias("m")).collect()}


def fit(docs: DataFrame, fit_rows: int | None = None, landmarks: int = LANDMARKS, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang", typical: bool = False) -> Model | None:
    """Fit on all rows that aren't held out and have a label; None if there are none.

    ``typical`` also takes what the likeness of a text is measured by. A caller can bound
    the fit to about ``fit_rows`` rows a language, chosen by a hash of the id."""
    labelled = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("text").alias("n")).collect() if r["n"]}
    if not counts:
        return None
    languages = sorted(counts)
    draw = F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1 << 30))
    most = {k: min(fit_rows or n, n) for k, n in counts.items()}
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, most[k] / counts[k] * (1 << 30))])
    drawn = labelled.withColumn("draw", draw / share[F.col("lang")]).where("text IS NOT NULL AND draw < 1")

    def mark_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column(2))
            raw, offs = data.tobytes(), offs.tolist()
            for lo in range(0, batch.num_rows, BATCH_DOCS):
                rows, has = presence(raw, offs[lo:lo + BATCH_DOCS + 1])
                part = batch.slice(lo, BATCH_DOCS)
                packed = pa.array([r.tobytes() for r in np.packbits(rows, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed], ["lang", "draw", "marks"]).filter(pa.array(has))

    def marked(rows: DataFrame) -> DataFrame:
        return rows.select("lang", "draw", "text").mapInArrow(mark_rows, "lang string, draw double, marks binary")

    top = F.create_map(*[F.lit(x) for k in languages for x in (k, landmarks / most[k])])
    chosen = marked(drawn.where(F.col("draw") < top[F.col("lang")])).orderBy("lang", "draw", "marks").collect()
    if not chosen:
        chosen = marked(drawn).orderBy("draw", "marks").limit(landmarks).collect()
    if not chosen:
        return None
    marks = np.unpackbits(np.array([np.frombuffer(r["marks"], np.uint8) for r in chosen]), axis=1)
    plain = Model(languages, marks, np.eye(len(chosen)))
    values, vectors = np.linalg.eigh(plain.kernel(marks).astype(float))
    sound = values > FLOOR * values[-1]
    whiten = vectors[:, sound] / np.sqrt(values[sound])  # kernel values -> Nystrom features
    d = whiten.shape[1]

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((d, d + len(languages))), 0
        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            raw, offs, names = data.tobytes(), offs.tolist(), batch.column(0).to_pylist()
            for lo in range(0, batch.num_rows, BATCH_DOCS):
                rows, has = presence(raw, offs[lo:lo + BATCH_DOCS + 1])
                features = plain.kernel(rows[has]) @ whiten
                target = np.array([[x == k for k in languages] for x in names[lo:lo + BATCH_DOCS]], float)[has]
                both += features.T @ np.concatenate([features, target], axis=1)
                n += int(has.sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([r.tobytes() for r in both], pa.binary()),
                                          pa.array([n] * d, pa.int64())], ["i", "sums", "n"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in sorted(t["sums"].to_pylist()))  # in an order of its own
        return pa.table({"i": t["i"][:1], "sums": pa.array([total.tobytes()], pa.binary()), "n": [sum(t["n"].to_pylist())]})

    parts = drawn.select("lang", "text").mapInArrow(normal, "i int, sums binary, n long")
    added = sorted(parts.groupBy("i").applyInArrow(add, "i int, sums binary, n long").collect())
    both, n = np.array([np.frombuffer(r["sums"]) for r in added]), added[0]["n"]
    model = Model(languages, marks, whiten @ np.linalg.solve(both[:, :d] + RIDGE * max(n, 1) * np.eye(d), both[:, d:]))
    if typical:
        weights = model.gram_weights

        def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offs = text_buffers(batch.column(1))
                raw, offs = data.tobytes(), offs.tolist()
                told = [mean_weights(raw[a:b], weights) for a, b in zip(offs, offs[1:])]
                own = [m[languages.index(k)] for k, (_, m) in zip(batch.column(0).to_pylist(), told)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.float64())],
                                                 ["lang", "own"]).filter(pa.array([c > 0 for c, _ in told], pa.bool_()))

        own, path = store(drawn.select("lang", "text").mapInArrow(means, "lang string, own double"), "langid-means")
        middle = medians(own)
        discard(docs.sparkSession, path)
        model.typical = np.array([max(middle.get(k) or 0.0, FLOOR) for k in languages])
    return model


def belonging(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a letter and isn't told to be in no learned language.

    Without a learned language (no labelled row) every text with a letter stays. Null and
    empty texts go; repeated rows are judged alike. All columns pass, whatever their names.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if model is None:
        return rows.where(F.col("text").rlike(r"\p{L}")).select("row.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            raw, offs = data.tobytes(), offs.tolist()
            told = [model.likeness(raw[a:b]) for a, b in zip(offs, offs[1:])]
            keep = [n > 0 and like + 2 / np.sqrt(n) >= LEAST_LIKE for n, like in told]
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["row"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
            carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score), one row per row; ``carry``: columns of the input to pass on unread."""
    src = docs.select(F.col(text_col).alias("__text"), F.col(id_col), *carry)
    known = F.coalesce(F.col("__text"), F.lit(""))
    if model is None:
        return src.select(id_col, *carry, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    names = [id_col, *carry]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + ["lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array(model.languages, object)
        for batch in batches:
            data, offs = text_buffers(batch.column(0))
            raw, offs = data.tobytes(), offs.tolist()
            for lo in range(0, batch.num_rows, BATCH_DOCS):
                rows, has = presence(raw, offs[lo:lo + BATCH_DOCS + 1])
                value = model.values(rows)
                best = value.argmax(1)
                score = np.where(has, np.clip(value.max(1), 0, 1), 0.0)
                part = batch.slice(lo, BATCH_DOCS)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(np.where(has, labels[best], UNKNOWN), pa.string()), pa.array(score, pa.float64())],
                    [*names, "lang_pred", "score"])

    return src.withColumn("__text", known).mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             carry: tuple[str, ...] = ()) -> DataFrame:
    """Fit on the labelled rows that aren't held out, predict all: (doc_id, held_out, lang_pred, score)."""
    found = predict(docs, fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), id_col, text_col, carry)
    return found.select(id_col, *carry, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
