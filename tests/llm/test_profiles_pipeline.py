"""Profile search, the pipeline's stages and the numbered queries."""

import re

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from rankscope.llm import log_quality, oracles, queries, records, similar_profiles
from tests.llm import brute


def plain_search(profiles, is_query, k, scale=64):
    whole = {}
    for i, v in profiles:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.setdefault(i, []).append(np.floor(scale * np.array(v, np.float64)).astype(np.int64))
    out = {}
    for q in whole:
        if is_query(q):
            for own in whole[q][:1]:
                scores = sorted((-int(own @ v), i) for i, vs in whole.items() for v in vs if i != q and len(v) == len(own))
                out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def found(spark, profiles, k):
    profiles = [(i, v and [None if x is None else float(x) for x in v]) for i, v in profiles]
    df = spark.createDataFrame(profiles, "profile_id long, profile array<double>").withColumn("rank", F.lit("given"))
    got = {}
    for r in similar_profiles.similar_profiles(df, F.col("profile_id") % 5 == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.profile_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_search_equals_all_products(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), (rng.normal(size=8) * float(rng.choice([0.1, 1, 4]))).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(40)]                       # ties
    rows += [(500, None), (505, [None] * 8), (510, [float("nan")] * 8), (515, [float("inf")] * 8), (520, [0.0] * 8), (525, [1.0, 2.0]), (None, rows[0][1]),
             (530, [float(x) for x in range(8)]), (531, [10.0 * x for x in range(8)])]
    want = plain_search(rows, lambda i: i % 5 == 0, 20)
    assert found(spark, rows, 20) == {q: top for q, top in want.items() if top}


def test_search_for_parallel_profiles_prunes_by_coordinate(spark):
    rng = np.random.default_rng(7)
    base = np.eye(6) * 5
    rows = [(i, (base[i % 6] * (1 + i / 300) + rng.normal(size=6) * 0.05).tolist()) for i in range(300)]
    assert found(spark, rows, 3) == plain_search(rows, lambda i: i % 5 == 0, 3)


def test_search_with_large_components_is_exact(spark):
    """Components up to a billion and products beyond 2^53, ties and neighbours one apart among them."""
    rng = np.random.default_rng(8)
    rows = [(int(i), (rng.integers(-(10 ** 9), 10 ** 9, 4) / 64).tolist()) for i in range(120)]
    rows += [(120 + i, [1e7, 1e7, 1e7 + i / 64, 3.0]) for i in range(40)] + [(160, [1e8, 1.0, 0.0, 0.0]), (165, [3.0, 1.0, 0.0, 0.0])] + [(170, [1e8, 1.0]), (171, [3.0, 1.0])]
    assert found(spark, rows, 7) == {q: top for q, top in plain_search(rows, lambda i: i % 5 == 0, 7).items() if top}
    assert found(spark, [(170, [1e8, 1.0]), (171, [3.0, 1.0])], 7) == {170: [(171, 1228800004096)]}


def test_search_prunes_before_the_shuffle(spark):
    """Queries that no short bucket can serve do not go there; the plan holds a bucket, not a slice, per literal."""
    rows = [(i, [float(1 + 1000 * (i < 40)), float(i % 7) / 9]) for i in range(400)]
    assert found(spark, rows, 3) == plain_search(rows, lambda i: i % 5 == 0, 3)


def test_search_of_traffic_profiles(spark):
    links = spark.createDataFrame([("r", s, d, (s * 7 + d * 3) % 11 * 100) for s in range(6) for d in range(6)], "run_id string, sender int, receiver int, bytes long")
    made = records.traffic_profiles(links, 6)
    rows = [(r.profile_id, list(r.profile)) for r in made.collect()]
    got = {}
    for r in similar_profiles.similar_profiles(made, F.lit(True), 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.profile_id, r.score))
    assert got == plain_search(rows, lambda i: True, 3) and len(got) == 6


def test_search_of_few_or_no_profiles(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5])]
    assert found(spark, rows, 20) == {0: [(1, 2048)]}
    assert found(spark, [], 20) == {}


def test_profiles_of_ranks(spark):
    links = spark.createDataFrame([("r", 0, 1, 30), ("r", 0, 65, 10), ("r", 0, 2, 60), ("r", 1, 0, 5)], "run_id string, sender int, receiver int, bytes long")
    got = {r["rank"]: r.profile for r in records.traffic_profiles(links).collect()}
    assert got[0][1] == 0.4 and got[0][2] == 0.6 and got[1][0] == 1.0 and len(got[0]) == 64


def test_queries_are_registered():
    names = entry.queries()
    assert sum(bool(re.match(r"op\d+_", n)) for n in names) == 13 and "pipeline" in names
    assert set(oracles.ORACLE) <= set(entry.oracle_sql()) <= set(names)


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_against_plain_versions(spark, sf_dir):
    """Each stage on what the one before it kept."""
    docs = queries.table(spark, sf_dir, "documents")
    columns = docs.columns
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    scores = {r.doc_id: r.score for r in queries.op9_log_quality(spark, sf_dir).collect()}
    bad = {r.doc_id for r in queries.table(spark, sf_dir, "labels").filter("quality = 0").collect()}
    good = texts(kept)
    assert kept.columns == columns and set(good) == {i for i, s in scores.items() if s >= log_quality.CUT_SCORE}
    assert len(bad & set(good)) <= 0.1 * len(bad) and len(good) > 0.7 * len(scores)

    lined = corpus_pipeline.line_dedup(spark, kept, sf_dir)
    want = {i: x[0] for i, x in brute.lines(good).items()}
    got = texts(lined)
    assert lined.columns == columns and got == want
    assert lined.filter("n_chars <> char_length(text)").count() == 0

    near = corpus_pipeline.near_dedup(spark, lined, sf_dir)
    single = {i: got[i] for i, (_, _, own) in brute.near(got, 5).items() if own}
    assert near.columns == columns and texts(near) == single

    clean = corpus_pipeline.decontaminate(spark, near, sf_dir)
    known = {r.item_id: r.text for r in queries.table(spark, sf_dir, "benchmark").collect()}
    hits = brute.benchmark(single, known)
    assert clean.columns == columns and set(texts(clean)) == {i for i, (_, hit, _) in hits.items() if not hit}

    pieces = corpus_pipeline.packing(spark, clean, sf_dir)
    sums = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all"))
    assert sums.filter("n <> all").count() == 0 and sums.count() == clean.count()


def odd_documents(spark, rows):
    """Documents with null and repeated ids, odd texts, and columns named like those of the operators."""
    clashing = ["log", "log_id", "features", "score", "held_out", "words", "n_hit", "candidates", "hits", "dropped_keys", "of_log", "component_id", "kept", "row"]
    ddl = "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"{c} string" for c in clashing)
    return spark.createDataFrame([(i, t, "en", len(t or ""), *[f"given {c}" for c in clashing]) for i, t in rows], ddl)


ODD_DOCUMENTS = [(1, None), (2, ""), (3, " \n\n"), (None, "a row without number " * 5), (None, None), (4, "x" * 70_000), (5, "one two three four five six " * 4),
                 (5, "one two three four five six " * 4), (6, "one two three four five six " * 4), (7, "go " * 3000)]


def test_stages_take_odd_rows_and_clashing_columns(spark, sf_dir):
    docs = odd_documents(spark, ODD_DOCUMENTS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        got = out.collect()
        assert all(r.score == "given score" and r.log == "given log" and r.words == "given words" for r in got), name
        if name == "decontaminate":
            assert len(got) == len(ODD_DOCUMENTS)
    near = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in near.collect()) == [(False, i) for i in (1, 2, 3, 4, 5, 5, 7)] + [(True, 0)] * 2
    pieces = corpus_pipeline.packing(spark, docs, sf_dir)
    assert pieces.filter("start = 0").count() == len(ODD_DOCUMENTS)


def test_stages_take_no_documents(spark, sf_dir):
    none = odd_documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0, name
