"""Secret scans with multipart credential linking.

Base spans are certain on their own: assignments of eight or more characters,
access ids of sixteen or more, hex runs of thirty-two or more. Weak candidates
are not: identifiers (``user=``, ``client_id:``, short access ids), secrets (mixed
tokens of sixteen or more characters) and endpoints (URLs, ``host=`` values,
host:port pairs) occur in clean text too. They are reported only when
complementary parts co-occur: each part reaches over the text of its scope (a
paragraph, and at most ``REACH`` code points either side of the part), and the
interval join keeps a weak part whose reach meets that of a part of another role
such that the set holds a secret and something that it opens. The join sorts the
parts of a scope and looks at the nearest part of each role before and after, so
its cost follows the number of parts, not of pairs.

Null and empty texts have no spans. Rows that repeat a document (same id and
text) give a row each; rows with one id and different texts are separate
documents. Ties in position are ordered by kind. Only the id and text columns
are read. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_buffers

#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
ASSIGN_WORDS = re.compile(rb"passw|secret|token|api_?key", re.I)

WEAK_ID = re.compile(r"""(?:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.A | re.I)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
ENDPOINT = re.compile(r"""(?:https?|ftps?|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{3,}|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}""", re.A | re.I)
WEAK_HINT = re.compile(rb"[:=]|AKIA|[0-9]")
DIGIT = re.compile(rb"[0-9]")
MIXED = re.compile("[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]")
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
#: What a part stands for in a credential; an assignment and a hex run are secrets, an access id an identifier.
ROLES = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "id", "weak_id": "id", "endpoint": "endpoint"}
REACH = 200
PART = "struct<kind:int,start:bigint,end:bigint,scope:bigint>"


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, sorted."""
    found = []
    if ASSIGN_WORDS.search(raw):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def weak_parts(text: str, raw: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of weak candidates outside the base spans."""
    if not WEAK_HINT.search(raw):
        return []
    found = [(m.start(), 3, m.end()) for m in WEAK_ID.finditer(text)] if b":" in raw or b"=" in raw else []
    if b"AKIA" in raw:
        found += [(m.start(), 3, m.end()) for m in ACCESS.finditer(text) if 8 <= m.end() - m.start() < LEAST_ACCESS]
    if DIGIT.search(raw):
        found += [(m.start(), 4, m.end()) for m in WEAK_SECRET.finditer(text) if all(x.search(m.group()) for x in MIXED)]
    if b":" in raw or b"=" in raw:
        found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    if base and found:
        starts = [s for s, _, _ in base]
        reach, top = [], 0
        for _, _, e in base:
            top = max(top, e)
            reach.append(top)
        found = [x for x in found if (k := bisect.bisect_left(starts, x[2])) == 0 or reach[k - 1] <= x[0]]
    return sorted(set(found))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, base digest columns, base and weak parts with their scopes), one row per row."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def row(raw: bytes) -> tuple:
        text = raw.decode()
        base = base_spans(text, raw)
        weak = weak_parts(text, raw, base)
        parts = []
        if weak:
            breaks = [m.end() for m in re.finditer(r"\n[ \t\r]*\n", text)]
            parts = [(k, s, e, bisect.bisect_right(breaks, s)) for s, k, e in sorted(base + weak)]
        else:
            parts = [(k, s, e, 0) for s, k, e in base]
        said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
        return (hashlib.blake2b(raw, digest_size=16).digest(), *(sum(k == n for _, k, _ in base) for n in range(3)),
                hashlib.sha256(said.encode()).hexdigest(), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("scope", pa.int64())])
        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            raw, offs = data.tobytes(), offs.tolist()
            rows = [row(raw[a:b]) for a, b in zip(offs, offs[1:])]
            cols = list(zip(*rows)) or [[]] * 6
            parts = [[dict(zip(("kind", "start", "end", "scope"), p)) for p in x] for x in cols[5]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[1:4]),
                 pa.array(cols[4], pa.string()), pa.array(parts, pa.list_(part))],
                ["doc_id", "text_key", "n_assign", "n_access", "n_hex", "base_sha256", "parts"])

    kind = docs.schema[id_col].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, text_key binary, n_assign bigint, n_access bigint, n_hex bigint, "
                               f"base_sha256 string, parts array<{PART}>")


def find(docs: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: base counts and digest, ``found`` (array of kind, start, end) and ``spans`` text.

    The interval join runs over exploded parts, dealt by document; rows without
    parts pass through the same shuffle, which moves no text.
    """
    rows = scan(docs, id_col, text_col)
    base = ["doc_id", "text_key", "n_assign", "n_access", "n_hex", "base_sha256"]
    parts = rows.select(*base, F.size("parts").alias("n"), F.explode_outer("parts").alias("p"))
    role = F.expr("CASE WHEN p.kind IN (0, 2, 4) THEN 'secret' WHEN p.kind IN (1, 3) THEN 'id' WHEN p.kind = 5 THEN 'endpoint' END")
    parts = parts.withColumn("role", role).withColumn("lo", F.col("p.start") - reach).withColumn("hi", F.col("p.end") + reach)
    order = Window.partitionBy("doc_id", "text_key", "p.scope").orderBy("p.start", "p.kind", "p.end")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    meets = {}
    for r in ("secret", "id", "endpoint"):
        is_r = F.col("role") == r
        # the reaches meet if the nearest such part on either side does
        meets[r] = (F.coalesce(F.max(F.when(is_r, F.col("hi"))).over(before) >= F.col("lo"), F.lit(False))
                    | F.coalesce(F.min(F.when(is_r, F.col("lo"))).over(after) <= F.col("hi"), F.lit(False)))
    opened = meets["id"] | meets["endpoint"]
    linked = F.when(F.col("role") == "secret", opened).otherwise(meets["secret"])
    kept = (F.col("p.kind") < 3) | linked
    seen = parts.withColumn("kept", F.coalesce(kept, F.lit(False)))
    names = F.array(*map(F.lit, KINDS))
    one = F.struct(F.col("p.start").alias("start"), F.col("p.kind").alias("kind"), F.col("p.end").alias("end"))
    grouped = seen.groupBy(*base, "n").agg(F.count("*").alias("rows"), F.array_sort(F.collect_set(F.when(F.col("kept"), one))).alias("x"))
    found = F.transform("x", lambda s: F.struct(names[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return (grouped.withColumn("found", found)
            .withColumn("spans", F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","))
            .withColumn("copies", F.expr("CAST(rows / greatest(n, 1) AS INT)"))
            .select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "found", "spans",
                    F.explode(F.expr("sequence(1, copies)"))).drop("col"))
