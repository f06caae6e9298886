"""Conversation repair, substring dedup and spelling variants against brute force."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from sprout.llm import conversations, superkmers, variants  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    return docs, [(r["doc_id"], r["text"]) for r in docs.collect()]


def similar_texts(n=120):
    """Texts that share passages at different places, with repeats inside a text and periodic stretches."""
    draw = random.Random(12)
    words = [f"w{k}" for k in range(40)]
    passage = [draw.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        own = [draw.choice(words) for _ in range(draw.randrange(80))]
        at = draw.randrange(len(own) + 1)
        rows.append((i, "\t ".join(own[:at] + passage * (i % 4) + own[at:]) + "\n" * (i % 2)))
    return [*rows, (n, " ".join(["again"] * 90)), (n + 1, " ".join(["tick", "tock"] * 70)), (5, rows[7][1])]


# ---------------------------------------------------------------- 11: conversation repair
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, gone string, fault int, kind string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "g", 1, "k") for r in rows], CONVERSATIONS)


def test_repair_equals_all_edits_tried(spark):
    draw = random.Random(11)
    roles = [None, "", "system", "user", "assistant", "user", "assistant", "tool", "User"]
    texts = [None, "", " \n", "a.", "b", "c!\n", "d", "e?", "日本。", "x" * 200_000]
    rows = [(draw.choice([None, *range(60)]), draw.choice([None, 0, 1, 2, 3, 4, 9]), draw.choice(roles), draw.choice(texts)) for _ in range(400)]
    rows += [(1000 + i // 9, i % 9, draw.choice(roles[2:5]), f"t{draw.randrange(6)}.") for i in range(900)]
    rows += [(2000 + c, t, ("user", "assistant")[t % 2], f"said {t}.") for c in range(40) for t in range(6)]  # copies
    assert tuples(conversations.repair(conversations.damage(table(spark, rows)), gone="gone")) == sorted(brute.damaged_conversations(rows), key=str)
    given = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text")
    want = brute.damaged_conversations([tuple(r) for r in given.collect()])
    assert tuples(conversations.repair(conversations.damage(given), gone="gone")) == sorted(want, key=str)


def test_repair_of_one_long_conversation_and_of_none(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"said {t}" + "." * (t % 3 != 0)) for t in range(30_000)]
    got = conversations.repair(table(spark, rows)).collect()
    assert [(r["cost"], r["truncated"], r["illegal"], r["audit"]) for r in got] == [(10_000, 10_000, 0, "K" * 30_000)]
    assert conversations.repair(conversations.damage(table(spark, [])), gone="gone").count() == 0
    assert conversations.repaired_messages(table(spark, [])).count() == 0


def test_repaired_messages_are_well_formed(spark):
    rows = [(1, 0, "assistant", "hello."), (1, 1, "user", "hi"), (1, 2, "user", "hi"), (1, 3, "tool", "ok."), (2, 0, "system", "s.")]
    got = tuples(conversations.repaired_messages(table(spark, rows)))
    roles = {c: "".join(r[3][0] for r in got if r[0] == c) for c in (1, 2)}
    assert roles == {1: "uaua", 2: ""} or roles == {1: "ua", 2: ""}
    facts = {r["conv_id"]: r["cost"] for r in conversations.repair(table(spark, rows)).collect()}
    assert facts == {r[0]: r[6] for r in [(c, *brute.conversation([x[1:] for x in rows if x[0] == c])) for c in (1, 2)]}


# ---------------------------------------------------------------- 12: substring dedup
@pytest.mark.parametrize("window, hot", [(35, 2048), (35, 0), (12, 4), (9, 2048)])
def test_repeated_windows_equal_brute_force(spark, small, window, hot):
    for docs, rows in ((brute.table(spark, similar_texts()), similar_texts()), (brute.table(spark, brute.awkward()), brute.awkward()), small):
        got = tuples(superkmers.remove_repeats(docs, window, hot=hot).drop("kept"))
        assert got == sorted(brute.repeated_words_removed(rows, window), key=str)


def test_repeated_windows_of_a_text_of_millions_of_bytes(spark):
    draw = random.Random(13)
    long = [f"v{draw.randrange(10 ** 6)}" for _ in range(500_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[400_000:400_050])), (3, "y" * 3_000_000 + " " + " ".join(["z" * 50_000] * 40))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in superkmers.remove_repeats(brute.table(spark, rows), 35).collect()}
    assert got == {1: (500_000, 50), 2: (50, 50), 3: (41, 40)}
    assert superkmers.remove_repeats(brute.table(spark, []), 35).count() == 0


def test_pieces_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(superkmers, "PIECE", 700)
    texts = [superkmers.normalised(t.encode()) for _, t in similar_texts(30)] + [b"", b"one", b" ".join(b"%d" % k for k in range(3000))]
    data, offs = b"".join(texts), np.cumsum([0, *map(len, texts)])
    got = []
    for piece in superkmers.pieces(data, offs, 35):
        value, _ = piece.minimisers(35) if len(piece.windows) else (np.zeros(0, np.int64), None)
        first, last = piece.runs(value)
        assert (last - first).sum() == len(piece.windows)
        got += [(int(piece.doc[k]), int(piece.starts[k]), data[piece.starts[k]:piece.ends[k + 34]]) for k in piece.windows]
    want = []
    for d, text in enumerate(texts):
        words, at = text.split(), int(offs[d])
        for k in range(len(words) - 34):
            want.append((d, at, b" ".join(words[k:k + 35])))
            at += len(words[k]) + 1
    assert got == want


# ---------------------------------------------------------------- 13: spelling variants
@pytest.mark.parametrize("length, least, damage, ratio", [(6, 5, 199, 5), (4, 1, 7, 2), (5, 2, 7, 3), (9, 1, 0, 2)])
def test_variants_equal_brute_force(spark, small, length, least, damage, ratio):
    docs, rows = small
    got = tuples(variants.variants(docs, length, least, ratio, damage))
    assert got == sorted(brute.spelling_variants(rows, length, least, damage, ratio), key=str)


def test_variants_of_awkward_texts(spark):
    rows = [*brute.awkward(), (20, "receive " * 60 + "recieve receeve receiv receve " * 8 + "eceive " * 5), (21, "Éclairs éclairs ÷÷×××××× " * 9),
            (22, ("q" * 300_000 + " ") * 5 + ("q" * 299_999 + " ") * 30), (22, "receive")]
    assert tuples(variants.variants(brute.table(spark, rows), damage=199)) == sorted(brute.spelling_variants(rows), key=str)
    assert variants.variants(brute.table(spark, [])).count() == 0


def test_lists_longer_than_a_block_and_chains_of_forms(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", 8)
    draw = random.Random(14)
    words = {"".join(draw.choice("abcd") for _ in range(draw.randrange(6, 9))) for _ in range(700)}
    rows = [(k, f"{w} " * draw.choice([1, 2, 10, 50, 300, 2000])) for k, w in enumerate(sorted(words))]
    got = tuples(variants.variants(brute.table(spark, rows), 6, 1, 2))
    assert got == sorted(brute.spelling_variants(rows, 6, 1, 0, 2), key=str)
    assert any(r[1] and r[2] != r[1] for r in got)


def test_every_affected_gram_is_within_the_bound():
    draw = random.Random(15)
    words = ["".join(draw.choice("aabcde") for _ in range(draw.randrange(6, 11))) for _ in range(400)]
    count = {}
    for w in words:
        s = variants.padded(w)
        for k in (2, 3, 4):
            for a in range(len(s) - k + 1):
                count[s[a:a + k]] = count.get(s[a:a + k], 0) + 1
    grams = variants.Grams({g: n for g, n in count.items() if len(g) == 2 or n > 40 // len(g)}, 4)
    for w in words:
        s = variants.padded(w)
        own = grams.cut(s)
        bound = grams.affected(s, own)
        assert bound < len(own)
        for k in range(len(w)):
            for other in (w[:k] + w[k + 1:], w[:k] + draw.choice("abcde") + w[k + 1:], w[:k] + draw.choice("abcde") + w[k:]):
                o = variants.padded(other)
                theirs = grams.cut(o)
                left = {(a, o[a:b]) for a, b in theirs}
                right = {(len(o) - a, o[a:b]) for a, b in theirs}
                assert sum((a, s[a:b]) in left or (len(s) - a, s[a:b]) in right for a, b in own) >= len(own) - bound
