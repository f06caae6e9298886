"""Registered queries and the pipeline: shape, SQL, and a brute-force run of the stages."""

import collections
import itertools
import os
import random
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sprout.llm import langid, pii, queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "pii_surrogates", "best_fit_packing"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con, sf = duckdb.connect(), "/root/testdata/sf0.01"
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())


def plain_lines(rows):
    """Texts without lines on ten sources or more; texts of nothing else stay."""
    norm = lambda x: re.sub("[ \t\r\f\v]+", " ", x).lower().strip(" ")
    sites = collections.defaultdict(set)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            sites[norm(line)] |= {r["source"]} - {None}
    bad = {x for x, s in sites.items() if x and len(s) >= 10}
    out = {}
    for r in rows:
        every = (r["text"] or "").split("\n")
        left = [x for x in every if norm(x) not in bad]
        out[r["doc_id"]] = r["text"] if r["text"] is None or not any(map(norm, left)) else "\n".join(left)
    return out


def near_kept(texts):
    ids, fps = sorted(texts), {i: brute.simhash(t) for i, t in texts.items()}
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if (fps[a] ^ fps[b]).bit_count() <= 4]
    return set(brute.components(ids, linked).values())


def pieces_of(texts):
    return collections.Counter((i, *p) for i, t in texts.items() for p in brute.pieces(t))


def test_pipeline_run_equals_plain_stages(spark):
    """run() against plain versions: letters, lines, fingerprints, pieces; surrogates are those of the operator."""
    docs = corpus_pipeline.documents(spark, SMALL)
    rows = [r for r in docs.collect() if any(langid.letters()[ord(c)] for c in r["text"] or "")]  # no foreign text there
    texts = plain_lines(rows)
    kept = near_kept(texts)
    assert len(kept) < len(texts)
    left = spark.createDataFrame([(i, t) for i, t in texts.items() if i in kept], "doc_id long, text string")
    final = {r["doc_id"]: r["text"] for r in pii.pseudonymise(left).collect()}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces_of(final)
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        ends = list(itertools.accumulate((n for _, n in sorted(own)), initial=0))
        assert [at for at, _ in sorted(own)] == ends[:-1] and ends[-1] <= 1024


def test_pipeline_stages_keep_columns_and_clashing_names(spark):
    odd = ["1 AS row", "2 AS id", "3 AS later", "4 AS own", "5 AS hash", "6 AS parts", "7 AS n_removed", "8 AS bad"]
    docs = corpus_pipeline.documents(spark, SMALL).selectExpr("*", *odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after, _ = corpus_pipeline.store(stage(spark, docs, SMALL), f"test-{name}")
        assert after.columns == docs.columns
        assert after.where("row <> 1 OR id <> 2 OR later <> 3 OR own <> 4 OR hash <> 5 OR parts <> 6 OR n_removed <> 7 OR bad <> 8").count() == 0
        docs = after
    assert not any("@mail" in w for r in docs.collect() for w in (r["text"] or "").split())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).select("doc_id").distinct().count() == docs.count()


def test_near_dedup_stage_keeps_one_row_of_a_repeated_id(spark):
    rows = brute.awkward()
    left = corpus_pipeline.near_dedup(spark, brute.table(spark, rows), SMALL)
    count = collections.Counter(r["doc_id"] for r in left.collect())
    assert count[4] == 1 and count[5] == 0 and count[None] == 2
    differing = [(40, "zebra " * 60), (40, "apple tree " * 60), (40, "Middle words " * 60), (41, "something else entirely here " * 30)]
    for parts in (1, 4):  # of differing texts under one id the least stays
        left = corpus_pipeline.near_dedup(spark, brute.table(spark, differing).repartition(parts), SMALL)
        assert {r["doc_id"]: r["text"] for r in left.collect()} == {40: differing[2][1], 41: differing[3][1]}
    for name, stage in corpus_pipeline.STAGES:
        docs = brute.table(spark, rows)
        out = stage(spark, docs, SMALL)
        out.collect()
        assert name == "best_fit_packing" or out.columns == docs.columns
        assert stage(spark, brute.table(spark, []), SMALL).count() == 0


FOREIGN = {-10: "Это обычный русский текст о погоде и природе, который никто не размечал. " * 9,
           -11: "这是一个关于天气的普通中文文本。" * 20, -12: "QWxhZGRpbjpvcGVuIHNlc2FtZQ0KZm9vYmFyYmF6" * 30}


def test_language_stage_keeps_clean_documents_of_any_size_and_drops_others(spark):
    docs = corpus_pipeline.documents(spark, SMALL)
    english = "\n".join(r[0] for r in docs.where("lang = 'en' AND text IS NOT NULL").orderBy("doc_id").select("text").collect())
    long = english * (1 + 4_000_000 // len(english))
    draw = random.Random(3)
    junk = " ".join("".join(draw.choice("bcdfghjklmnpqrstvwxyz") for _ in range(draw.randrange(3, 9))) for _ in range(600))
    texts = {-1: "A.", -2: "OK", -3: "Yes, please.", -4: long, -5: "12 - 34", -6: None, -7: junk, -8: ""} | FOREIGN
    added = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    more = docs.unionByName(added, allowMissingColumns=True)
    kept = {r[0] for r in corpus_pipeline.language_id(spark, more, SMALL).select("doc_id").collect()}
    assert {i for i in kept if i < 0} == {-1, -2, -3, -4}
    assert {i for i in kept if i >= 0} == {r["doc_id"] for r in docs.collect() if any(langid.letters()[ord(c)] for c in r["text"] or "")}


def test_language_stage_keeps_an_unlabelled_corpus(spark):
    docs = corpus_pipeline.documents(spark, SMALL).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language_id(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect() if any(langid.letters()[ord(c)] for c in r["text"] or "")}
