"""Quality rules: text rules and cross-document line frequency.

Each text gets its counts (words, symbols, repeated lines, words inside repeated
three-word windows). The cross-document rule hashes normalised lines, counts the
distinct documents that hold a line on one host, removes lines held by more than
``max_docs`` documents of the host, and rejects a document that keeps fewer than
``min_words`` words or less than ``min_share`` of its words.

The first document (smallest id) of a host with such a line keeps it: the line's
text then stays in the corpus once, so an original whose copies spread on its
host isn't rejected with them.

Null and empty texts have no words and fail the base rules. Lines without a word
are never counted. Rows that repeat a doc_id get a row each but are one
document in the line counts, and share its removed words. A null host counts as a host of its own. Only the id, text and
host columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, store, text_buffers

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line on over MAX_DOCS documents of a host is removed; a document left with less than this is depleted.
MAX_DOCS, LEFT_WORDS, LEFT_SHARE = 20, 25, 0.3
SYMBOLS = b"#*$%&|<>"
NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
#: UTF-8 bytes that don't start a code point.
TAILS = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if (m := len(number)) == n:
        return 0
    if m < 2_000_000:
        windows = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * m + ids[2:]
    order = np.argsort(windows)
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    inside[:-2] = again
    inside[1:-1] |= again
    inside[2:] |= again
    return int(inside.sum())


def counts(text: bytes) -> tuple[list[int], dict[int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; words by hash of normalised line."""
    words = text.split()
    seen, repeats, lines = set(), 0, {}
    for line in text.split(b"\n"):
        if own := line.lower().split():
            repeats += line in seen
            seen.add(line)
            h = xxhash.xxh64_intdigest(b" ".join(own)) - (1 << 63)
            lines[h] = lines.get(h, 0) + len(own)
    chars = sum(map(len, words))
    if not text.isascii():
        chars -= len(text) - len(text.translate(None, TAILS))
    return [len(words), chars, len(text.translate(None, NOT_SYMBOL)), repeats, repeated_words(words)], lines


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts of each text, one row per row, with hashes and word numbers of its distinct lines."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"),
                      F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column(2))
            raw, offs = data.tobytes(), offs.tolist()
            rows = [counts(raw[a:b]) for a, b in zip(offs, offs[1:])]
            table = np.array([x for x, _ in rows], np.int64).reshape(len(rows), 5)
            at = pa.array(np.cumsum([0, *(len(x) for _, x in rows)]), pa.int32())
            hashes = pa.array([h for _, x in rows for h in x], pa.int64())
            sizes = pa.array([n for _, x in rows for n in x.values()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *map(pa.array, table.T),
                 pa.ListArray.from_arrays(at, hashes), pa.ListArray.from_arrays(at, sizes)],
                ["doc_id", "host", *names, "line", "line_words"])

    kind = docs.schema[id_col].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, host string, " + ", ".join(f"{x} bigint" for x in names)
                          + ", line array<bigint>, line_words array<bigint>")


def quality(docs: DataFrame, max_docs: int = MAX_DOCS, min_words: int = LEFT_WORDS, min_share: float = LEFT_SHARE,
            id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts, base_failed, words removed with frequent lines, and kept, one row per row."""
    rows, _ = store(text_counts(docs, id_col, text_col, host_col), "quality-counts")
    lines = rows.select("doc_id", "host", F.explode(F.arrays_zip("line", "line_words")).alias("x")) \
        .select("doc_id", F.xxhash64(F.coalesce("host", F.lit("")), F.col("host").isNull(), "x.line").alias("key"),
                F.col("x.line_words").alias("words"))
    often = (lines.select("doc_id", "key").distinct().groupBy("key")
             .agg(F.count("*").alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") > max_docs))
    removed = (lines.distinct().join(apart(often, "key"), "key").where("doc_id <> first")
               .groupBy("doc_id").agg(F.sum("words").alias("removed")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    return (rows.drop("line", "line_words", "host").join(apart(removed, "doc_id"), "doc_id", "left")
            .withColumn("n_removed_words", F.coalesce("removed", F.lit(0)))
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (left >= min_words) & (left >= min_share * F.col("n_words")))
            .drop("removed"))
