"""Conversation structure repair over a suffix-shared automaton.

A conversation is well formed if its roles' initials read ``(s?(ua)+)?`` and no
message is blank or repeated. Repair keeps (0), re-roles (2), deletes (3, always for
blank and repeated messages) or inserts empty user / assistant messages (2); a
truncated message that stays costs 1. The cheapest edits are wanted, of equal ones
the audit (K, R, D, I in order) that is least in ASCII.

1. Every message becomes one letter: its role's initial and whether it is truncated,
   or that it must go. A conversation's letters are its signature.
2. Cost and audit depend on the signature alone, and cost-to-go on what is left of
   it. So the distinct signatures are sorted from their ends: neighbours share the
   longest possible suffix, and a walk over them with a stack meets every node of the
   suffix-shared automaton once per task. A node has a cost-to-go and a first edit per
   grammar state; nodes of equal letter and equal costs behind it are one registered
   step. An edit letter leads to one node and state only, so the least letter among
   the cheapest edits begins the least audit, and the audit suffix is the link to the
   node behind.
3. Costs and audits are joined back to the conversations, and the messages stream past
   them once more in order for the repaired text.

Conversations are cut and read as sorted streams; besides its messages' digests, sorted
by Spark, a task holds one signature (a byte a message) and no texts.

Null roles and texts are one space. Null turns come first. Messages of one turn are in
the order of their roles, then of their digests. Rows with a null conv_id are one
conversation. A conversation of which all rows are ``gone`` has zeros, an empty audit
and the empty string's hash. A role's initial is its first character (none if empty).
Only the four named columns are read, so other columns may have any name. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import apart, store

SPACES = " \t\n\x0b\f\r"
LEGAL = ("su", "ua", "au")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Grammar states: 0 nothing yet, 1 after the system message, 2 after a user's, 3 after an assistant's.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE = ("user", "user", "assistant", "user")
BATCH = 2048


# ---------------------------------------------------------------- rows
def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults by the hash of ``conv_id:turn``; dropped rows stay as ``gone``, so that no conversation is lost."""
    draw = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20
    own = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                               F.coalesce("text", F.lit(" ")).alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return own.select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                      (F.col("draw") == 0).alias("gone"), F.explode(times).alias("copy")).drop("copy")


def messages(rows: DataFrame, gone: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text, gone, digest): nulls filled, a digest of role and text for order and equality."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    out = F.coalesce(gone, F.lit(False)) if gone else F.lit(False)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), out.alias("gone"),
                       F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, gone, turn, role, digest, fault): each message's first fault (b, d, t or none), without its text."""
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    short = rows.select("conv_id", "gone", "turn", "role", "digest", last.alias("last"))
    seen = Window.partitionBy("conv_id", "digest", "gone").orderBy(F.asc_nulls_first("turn"))
    fault = (F.when(F.col("last") == "", "b").when(F.row_number().over(seen) > 1, "d")
             .when(~F.col("last").isin(".", "!", "?"), "t").otherwise(""))
    return short.withColumn("fault", fault).drop("last")


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature), one row per conversation."""
    counted = ["gaps", "blank", "duplicate", "truncated", "illegal"]

    def facts(conv, group: Iterator[tuple]) -> tuple:
        turns, low, high, before, letters = 0, None, None, None, bytearray()
        n = dict.fromkeys(counted, 0)
        for _, gone, turn, role, fault in group:
            if gone:
                continue
            if turn is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
            initial = role[:1]
            if before is not None and before + initial not in LEGAL:
                n["illegal"] += 1
            before = initial
            if fault in ("b", "d"):
                n["blank" if fault == "b" else "duplicate"] += 1
                letters += b"d"
                continue
            letter = initial if initial in ("s", "u", "a") else "x"
            n["truncated"] += fault == "t"
            letters += (letter.upper() if fault == "t" else letter).encode()
        if turns:
            n["gaps"] = high - low + 1 - turns
        return conv, *n.values(), letters.decode()

    kind, arrow = id_types(rows)
    names = ["conv_id", *counted, "signature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the five columns read: conv_id, gone, turn, role, fault
        found = (facts(conv, group) for conv, group in itertools.groupby(stream(batches, (0, 1, 2, 3, 5)), key=lambda r: r[0]))
        while part := list(itertools.islice(found, BATCH)):
            yield columns(part, names, [arrow, *[pa.int64()] * 5, pa.string()])

    order = ["conv_id", "gone", F.asc_nulls_first("turn"), "role", "digest"]
    return (faults(rows).repartition("conv_id").sortWithinPartitions(*order)
            .mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in counted) + ", signature string"))


def id_types(rows: DataFrame) -> tuple[str, pa.DataType]:
    kind = rows.schema["conv_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def stream(batches: Iterator[pa.RecordBatch], which: tuple[int, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in which))


def columns(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


# ---------------------------------------------------------------- automaton
class Step(NamedTuple):
    """A node's costs above its least, what that least adds to the node behind, and the first edit per state."""

    above: tuple[int, ...]
    added: int
    edits: tuple[tuple[str, int], ...]  # letter, state after it


def closed(costs: list[int], edits: list[tuple[str, int]]) -> Step:
    """With insertions before the node's message; a deletion is least in ASCII, then an insertion."""
    for _ in range(4):
        for q in range(4):
            to = NEXT[q, ROLE[q][0]]
            if (costs[to] + INSERT, "I") < (costs[q], edits[q][0]):
                costs[q], edits[q] = costs[to] + INSERT, ("I", to)
    least = min(costs)
    return Step(tuple(c - least for c in costs), least, tuple(edits))


class Automaton:
    """Nodes for the suffixes of signatures that come sorted from their ends."""

    def __init__(self):
        never = 1 << 30
        self.end = closed([0, never, never, 0], [("", q) for q in range(4)])
        self.steps: dict[tuple, Step] = {}
        self.present = ""  # signature, last letter first
        self.path: list[Step] = [self.end]
        self.least: list[int] = [self.end.added]

    def step(self, letter: str, behind: tuple[int, ...]) -> Step:
        """The registered node of a letter before the given costs."""
        if (letter, behind) in self.steps:
            return self.steps[letter, behind]
        costs, edits = [], []
        initial, extra = letter.lower(), TRUNCATED * letter.isupper()
        for q in range(4):
            ways = [(DELETE + behind[q], "D", q)]
            if letter != "d":
                if (q, initial) in NEXT:
                    ways.append((KEEP + extra + behind[NEXT[q, initial]], "K", NEXT[q, initial]))
                to = NEXT[q, ROLE[q][0]]
                ways.append((REROLE + extra + behind[to], "R", to))
            cost, edit, to = min(ways)
            costs.append(cost)
            edits.append((edit, to))
        return self.steps.setdefault((letter, behind), closed(costs, edits))

    def repair(self, backwards: str) -> tuple[int, str]:
        """Cost and audit of the signature that reads backwards like this."""
        shared = len(os.path.commonprefix([self.present, backwards]))
        del self.path[shared + 1:], self.least[shared + 1:]
        for letter in backwards[shared:]:
            node = self.step(letter, self.path[-1].above)
            self.path.append(node)
            self.least.append(self.least[-1] + node.added)
        self.present = backwards
        audit, at, state = [], len(backwards), 0
        while at or self.path[0].edits[state][0]:
            letter, state = self.path[at].edits[state]
            audit.append(letter)
            at -= letter != "I"
        return self.least[-1] + self.path[-1].above[0], "".join(audit)


def repairs(found: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the distinct signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            rows = [(b[::-1], *automaton.repair(b)) for b in batch.column(0).to_pylist()]
            if rows:
                yield columns(rows, ["signature", "cost", "audit"], [pa.string(), pa.int64(), pa.string()])

    distinct = found.select(F.reverse("signature").alias("backwards")).distinct()
    return (distinct.repartitionByRange("backwards").sortWithinPartitions("backwards")
            .mapInArrow(run, "signature string, cost bigint, audit string"))


# ---------------------------------------------------------------- repaired texts
def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired messages."""
    state = 0
    for letter in audit:
        role, text = (ROLE[state], "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        role = ROLE[state] if letter == "R" else role
        state = NEXT[state, role[0]]
        yield letter, role, text


def in_order(known: DataFrame, rows: DataFrame) -> DataFrame:
    """Every conversation's facts, then its messages in order, in one partition."""
    heads = known.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                         F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"),
                         F.array("gaps", "blank", "duplicate", "truncated", "illegal", "cost").alias("facts"))
    texts = rows.where("NOT gone").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text",
                                          F.lit(None).cast("array<bigint>").alias("facts"))
    return (heads.unionByName(texts).repartition("conv_id")
            .sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "digest"))


def known_repairs(rows: DataFrame) -> DataFrame:
    found, _ = store(signatures(rows), "conversation-signatures")
    done, _ = store(repairs(found), "conversation-repairs")
    return found.join(apart(done, "signature"), "signature").drop("signature")


def repair(conversations: DataFrame, gone: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conversation.

    ``gone`` names a column that marks rows which only keep their conversation in the result.
    """
    rows = messages(conversations, gone)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kind, arrow = id_types(rows)

    def one(conv, group: Iterator[tuple]) -> tuple:
        _, _, audit, numbers = next(group)
        digest, first = hashlib.sha256(), True
        for _, role, text in edited(audit, ((r[1], r[2]) for r in group)):
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        return conv, *numbers, audit, digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_in = stream(batches, (0, 3, 5, 6))
        out = (one(conv, group) for conv, group in itertools.groupby(rows_in, key=lambda r: r[0]))
        while part := list(itertools.islice(out, BATCH)):
            yield columns(part, names, [arrow, *[pa.int64()] * 6, pa.string(), pa.string()])

    return in_order(known_repairs(rows), rows).mapInArrow(
        run, f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in names[1:7]) + ", audit string, repaired_sha256 string")


def repaired_messages(conversations: DataFrame, gone: str | None = None) -> DataFrame:
    """(conv_id, position, edit, role, text): the messages of the repaired conversations."""
    rows = messages(conversations, gone)
    kind, arrow = id_types(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for conv, group in itertools.groupby(stream(batches, (0, 3, 5)), key=lambda r: r[0]):
                audit = next(group)[2]
                for k, message in enumerate(edited(audit, ((r[1], r[2]) for r in group))):
                    yield conv, k, *message

        found = out()
        while part := list(itertools.islice(found, BATCH)):
            yield columns(part, ["conv_id", "position", "edit", "role", "text"], [arrow, pa.int64(), *[pa.string()] * 3])

    return in_order(known_repairs(rows), rows).mapInArrow(run, f"conv_id {kind}, position bigint, edit string, role string, text string")
