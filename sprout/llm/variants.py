"""Spelling variant grouping by a variable-length gram index.

Words are counted over the corpus. Two words are near if one inserted, deleted or
replaced letter makes them equal; a word's form is its most frequent near word, if
that is frequent enough, and its root is where the forms end.

1. Gram dictionary: grams of the padded words are counted. A gram of more than two
   letters is kept if its prefix is frequent (over 1 / ``SPREAD`` of its length's
   grams), so that short grams with long lists are cut finer, and if it is not rare
   itself (1 / ``KEPT`` of its length's grams at least). So at most ``KEPT`` grams of
   a length are kept, whatever the corpus; the two-letter grams are bounded by the
   square of the alphabet. This bounded table goes to every task.
2. Decomposition: at each position the longest gram of the dictionary that starts
   there, unless an earlier one covers it.
3. Affected grams: for every possible edit of a word, the grams that hold its place,
   those that could grow into a longer gram and those that a longer gram could cover.
   The most over all edits is the word's bound; a near word shares all its other grams
   at least. Grams are at most as long as half a padded word, so one is always left.
4. Lists: of two near words' shared grams the rarest is among the (bound + 1) rarest
   grams of either. Words enter only those grams' lists. The one edit lies on one side
   of a shared gram, so the word up to its end, or from its start, is shared as well
   and is the list's key. Lists over ``BLOCK`` words are split into pairs of blocks.
5. Words that meet are verified by the lengths of their common ends.

Null and empty texts have no words. A null doc_id is an empty name where the damage
draw needs one. Rows that repeat a doc_id count like any others. Long texts are cut
between words into stretches of ``STRETCH`` characters. Only the id and text columns
are read, so other columns may have any name. Ties of frequency go to the smallest
word in code-point order. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, discard, store

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Letters are those of the first two Unicode blocks' ranges, one byte each in Latin-1.
RUNS = re.compile(rb"[a-z\xc0-\xff]+")
BREAK = re.compile("[^A-Za-zÀ-ÿ]")
STRETCH, HELD = 1 << 20, 200_000
SHORT, SPREAD, KEPT = 2, 4096, 1 << 16
BLOCK, PAIRS, WIDTH = 512, 1 << 18, 32


# ---------------------------------------------------------------- words
def stretches(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text):
            cut = BREAK.search(text, end)
            end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def damaged(runs: Counter, name: str, every: int, least: int) -> Iterator[tuple[bytes, int]]:
    """Runs with their counts; those whose hash ``every`` divides lose a letter."""
    seed = zlib.crc32(f"{name}:".encode())
    for run, n in runs.items():
        if every:
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
        if len(run) >= least:
            yield run, n


def flush(held: Counter, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], [name, "n"])


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int = 0,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of every word that is long and frequent enough; ``damage`` k deletes a letter of one run in k."""
    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in stretches(text.as_py() or ""):
                    for word, n in damaged(Counter(RUNS.findall(part.encode("latin-1", "replace").lower())), name, damage, min_length):
                        held[word.decode("latin-1")] += n
                if len(held) > HELD:
                    yield flush(held, "word")
                    held.clear()
        yield flush(held, "word")

    return src.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---------------------------------------------------------------- grams
def padded(word: str) -> str:
    return f"^{word}$"


def gram_counts(words: DataFrame, longest: int) -> DataFrame:
    """(gram, n) over the padded words, for all lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter = Counter()
            for s in map(padded, batch.column(0).to_pylist()):
                for k in range(SHORT, longest + 1):
                    held.update(map("".join, zip(*(s[a:] for a in range(k)))))
            yield flush(held, "gram")

    return words.select("word").mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def gram_dictionary(words: DataFrame, longest: int) -> dict[str, int]:
    """Frequency of every short gram and of the longer grams that are kept (see above); a bounded table."""
    counts, path = store(gram_counts(words, longest).withColumn("size", F.char_length("gram")), "variant-grams")
    total = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    kept = counts.where(F.col("size") == SHORT).select("gram", "n")
    for k in range(SHORT + 1, longest + 1):
        wide = counts.where((F.col("size") == k - 1) & (F.col("n") * SPREAD > total.get(k - 1, 0))).select(F.col("gram").alias("head"))
        long = counts.where((F.col("size") == k) & (F.col("n") * KEPT >= total.get(k, 0)))
        kept = kept.unionByName(long.withColumn("head", F.substring("gram", 1, k - 1)).join(wide, "head", "left_semi").select("gram", "n"))
    out = {r["gram"]: r["n"] for r in kept.collect()}
    discard(words.sparkSession, path)
    return out


class Grams:
    """Decomposition of words by a gram dictionary, and bounds on what an edit does to it."""

    def __init__(self, count: dict[str, int], longest: int):
        self.count, self.longest = count, longest
        long = [g for g in count if len(g) > SHORT]
        #: What a longer gram can begin with, and what it can hold behind its first letter.
        self.heads = {g[:k] for g in long for k in range(1, len(g))}
        self.insides = {g[a:b] for g in long for a in range(1, len(g)) for b in range(a + 1, len(g) + 1)}

    def cut(self, s: str) -> list[tuple[int, int]]:
        """(start, end) of the grams of a padded word."""
        out, reach = [], 0
        for p in range(len(s) - SHORT + 1):
            k = self.longest
            while k > SHORT and (p + k > len(s) or s[p:p + k] not in self.count):
                k -= 1
            if p + k > reach:
                reach = p + k
                out.append((p, reach))
        return out

    def affected(self, s: str, grams: list[tuple[int, int]]) -> int:
        """The most grams that one edit can take away; only those about its place can be."""
        most, reach, last = 0, self.longest, len(s)
        starts = [p for p, _ in grams]
        for i in range(1, last):  # the pads are never edited
            left = next((p for p in range(max(0, i - reach), i) if s[p:i] in self.heads), i)
            right = [next((e for e in range(min(last, a + reach), a, -1) if s[a:e] in self.insides), a) for a in (i, i + 1)]
            about = grams[bisect_left(starts, i - reach):bisect_left(starts, i + reach)]
            held = sum((e <= i and p >= left) or p < i < e or (p >= i and e <= right[0]) for p, e in about)
            most = max(most, held)  # a letter put in before i
            if i < last - 1:
                held = sum((e <= i and p >= left) or p <= i < e or (p > i and e <= right[1]) for p, e in about)
                most = max(most, held)  # letter i deleted or replaced
        return most

    def keys(self, word: str) -> set[int]:
        """The lists a word enters: those of its (bound + 1) rarest grams, of equal ones the first.

        Shared grams left of an edit are all that begin a word, those right of it all that
        end it. So of the rarest shared gram the first shared place has only grams before
        it that aren't shared, in either word.
        """
        s = padded(word)
        grams = self.cut(s)
        rank = sorted(grams, key=lambda g: (self.count.get(s[g[0]:g[1]], 0), s[g[0]:g[1]], g[0]))
        out = set()
        for p, e in rank[:self.affected(s, grams) + 1]:
            if e < len(s):
                out.add(xxhash.xxh64_intdigest(s[:e], 1))
            if p:
                out.add(xxhash.xxh64_intdigest(s[p:], 2))
        return out


def posts(words: DataFrame, grams: Grams) -> DataFrame:
    """(key, word, n): every word under the keys of its lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.fromiter(grams.keys(w), np.uint64) for w in batch.column(0).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            flat = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), batch.column(0).take(at), batch.column(1).take(at)], ["key", "word", "n"])

    return words.mapInArrow(run, "key bigint, word string, n bigint")


# ---------------------------------------------------------------- lists
def one_edit(a: bytes, b: bytes) -> bool:
    """Whether two different words differ by one letter put in, taken out or replaced."""
    low, high = sorted((a, b), key=len)
    k = next((k for k, (x, y) in enumerate(zip(low, high)) if x != y), len(low))
    return low[k:] == high[k + 1:] if len(low) < len(high) else low[k + 1:] == high[k + 1:]


def met(words: list[bytes], edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of near words that share a list; lists are runs between ``edges``."""
    size = np.array([len(w) for w in words])
    fit = size <= WIDTH
    left = np.array([w if f else b"" for w, f in zip(words, fit)], f"S{WIDTH}").view(np.uint8).reshape(-1, WIDTH)
    right = np.array([w[::-1] if f else b"" for w, f in zip(words, fit)], f"S{WIDTH}").view(np.uint8).reshape(-1, WIDTH)
    found, held, n_held = [], [], 0

    def verify() -> None:
        i, j = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        same = abs(size[i] - size[j]) <= 1
        i, j = i[same], j[same]
        wide = ~(fit[i] & fit[j])
        own = [(a, b) for a, b in zip(i[wide].tolist(), j[wide].tolist()) if words[a] != words[b] and one_edit(words[a], words[b])]
        i, j = i[~wide], j[~wide]
        for lo in range(0, len(i), PAIRS):
            a, b = i[lo:lo + PAIRS], j[lo:lo + PAIRS]
            head, tail = ((m[a] != m[b]).argmax(1) for m in (left, right))
            near = (head + tail >= np.maximum(size[a], size[b]) - 1) & (left[a] != left[b]).any(1)
            found.append(np.stack([a[near], b[near]]))
        found.append(np.array(own, np.int64).reshape(-1, 2).T)

    for a, b in itertools.pairwise(edges.tolist()):
        rows = max(1, PAIRS // max(1, b - a))
        for lo in range(a, b - 1, rows):
            i, j = np.arange(lo, min(lo + rows, b - 1)), np.arange(a, b)
            x, y = np.nonzero(i[:, None] < j[None, :])
            held.append((i[x], j[y]))
            n_held += len(x)
            if n_held > PAIRS:
                verify()
                held, n_held = [], 0
    if held:
        verify()
    return np.concatenate([np.zeros((2, 0), np.int64), *found], 1)


def links(posted: DataFrame) -> DataFrame:
    """(word, n, near, near_n): near words, each pair in both directions."""
    sizes = posted.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    blocks = F.expr(f"coalesce(CAST(ceil(size / {BLOCK}) AS INT), 1)")
    split = (posted.join(apart(sizes, "key"), "key", "left").withColumn("blocks", blocks)
             .withColumn("block", F.expr("CAST(pmod(xxhash64(word), blocks) AS INT)"))
             .select("key", "word", "n", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
             .select("key", F.expr("least(block, other) * 1000003L + greatest(block, other)").alias("cell"), "word", "n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                part = pa.Table.from_batches([batch])
                held = part if held is None else pa.concat_tables([held, part])
            if held is None or not held.num_rows:
                continue
            key, cell = (held.column(k).to_numpy() for k in (0, 1))
            new = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
            done = len(key) if batch is None else (int(new[-1]) if len(new) else 0)  # the last list may go on
            if not done:
                continue
            edges = np.append(np.append(0, new[new < done]), done)
            use = np.repeat(np.diff(edges) > 1, np.diff(edges))
            mine = held.slice(0, done).filter(pa.array(use)).combine_chunks()
            held = held.slice(done)
            if mine.num_rows:
                sizes = np.diff(edges)
                i, j = met([w.encode("latin-1") for w in mine.column(2).to_pylist()], np.append(0, np.cumsum(sizes[sizes > 1])))
                both = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
                word, n = mine.column(2).combine_chunks(), mine.column(3).combine_chunks()
                yield pa.RecordBatch.from_arrays([word.take(both[0]), n.take(both[0]), word.take(both[1]), n.take(both[1])],
                                                 ["word", "n", "near", "near_n"])

    return (split.repartition("key", "cell").sortWithinPartitions("key", "cell")
            .mapInArrow(run, "word string, n bigint, near string, near_n bigint"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms, by pointer doubling; counts grow along a chain, so it ends."""
    now, path = store(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after, done = store(now.join(apart(further, "root"), "root", "left")
                            .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        still = after.where("moved").isEmpty()
        discard(now.sparkSession, path)
        now, path = after.select("word", "root"), done
        if still:
            return now


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, damage: int = 0,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word; ``min_length`` must be 4 at least."""
    if min_length < 4:
        raise ValueError("min_length must be 4 or more")
    longest = min(6, (min_length + 2) // 2)
    words, _ = store(word_counts(docs, min_length, min_count, damage, id_col, text_col), "variant-words")
    grams = Grams(gram_dictionary(words, longest), longest)
    posted, at_posts = store(posts(words, grams), "variant-posts")
    # a pair can meet in several lists
    near = links(posted).distinct()
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = (words.join(apart(best, "word"), "word", "left")
             .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                     F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best"))
             .select("word", F.col("best.near").alias("form"), "n", "n_near", (-F.col("best.less")).alias("form_n")))
    known, _ = store(known, "variant-forms")
    discard(docs.sparkSession, at_posts)
    ends = roots(known.where("form IS NOT NULL"))
    return (known.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
