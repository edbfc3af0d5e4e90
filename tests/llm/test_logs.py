"""The operators over call logs against plain versions, on small logs with every odd case."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankscope.llm import benchmark_calls, log_lengths, log_likelihood, log_quality, near_logs, notices, pack_logs, records, repeated_calls, \
    repeated_passages, words as W
from rankscope.llm.stage import components
from rankscope.llm.tokens import Encoder, tokenizer_file
from tests.llm import brute
from tests.traces import events

CALLS = ["MPI_SEND", "mpi_recv", "MPI_Isend", "MPI_WAIT", "MPI_BARRIER", "réduce", "ÉCHO", "日本"]
ODD = {900: None, 901: "", 902: " \n\t ", 903: "MPI_INIT", 904: "a\x00b\x1cc d　e", 905: "x" * 5000, 906: "GO " * 3000, 907: "\n\n"}


def call_line(rng):
    return " ".join([rng.choice(CALLS), *[str(rng.randrange(40)) for _ in range(5)]])


@pytest.fixture(scope="module")
def logs():
    """Random call logs, copies, near copies, shared passages and lines, and odd texts."""
    rng = random.Random(5)
    shared = [call_line(rng) for _ in range(6)]
    out = {}
    for i in range(60):
        own = [call_line(rng) for _ in range(rng.randrange(1, 30))]
        if i % 3 == 0:
            own[1:1] = shared[rng.randrange(3):]
        out[i * 7 % 300] = rng.choice([" ", "\n", "\t\r\n"]).join(own)
    for i, source in enumerate(list(out)[:20]):
        text = out[source].split(" ")
        for _ in range(i % 4):
            text[rng.randrange(len(text))] = "changed"
        out[400 + i] = " ".join(text).upper() if i % 5 == 0 else " ".join(text)
    return out | ODD


def frame(spark, logs, ddl="log_id long, log string"):
    return spark.createDataFrame(list(logs.items()), ddl).repartition(5)


def clashing(spark, logs, names):
    """The logs with further columns, among them ones named like results."""
    out = frame(spark, logs).withColumn("run_id", F.lit("r"))
    for name in names:
        out = out.withColumn(name, F.lit("given"))
    return out


def by_id(df, *columns):
    return {r["log_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_words_and_fingerprints_follow_the_text(logs):
    column = pa.array(list(logs.values()))
    data, offsets = W.texts(column.slice(3))
    starts, ends, first = W.spans(data, offsets, W.SPACES)
    found = [bytes(data[a:z]).decode() for a, z in zip(starts, ends)]
    assert found == [w for log in list(logs.values())[3:] for w in brute.calls(log)]
    prints = W.fingerprints(data, starts, ends)
    assert len(set(prints.tolist())) == len(set(found)) == len(set(zip(found, prints.tolist())))
    long = np.frombuffer(b"ab" * (3 << 20), np.uint8)
    one, other = (W.fingerprints(x, np.array([0]), np.array([len(x)])) for x in (long, np.append(long[:-1], np.uint8(1))))
    assert one != other


def test_blocks_keep_all_rows(logs):
    batch = pa.RecordBatch.from_arrays([pa.array(list(logs)), pa.array(list(logs.values()))], ["log_id", "log"])
    parts = list(W.blocks(iter([batch]), "log", 2000))
    assert len(parts) > 5 and [i for p in parts for i in p.column(0).to_pylist()] == list(logs)


def test_components_of_chains_stars_and_loops(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (201, 200), (200, 201)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 120)}, 200: 200, 201: 200}


def test_length_histogram(spark, logs):
    coder = Tokenizer.from_file(tokenizer_file())
    lengths = [len(coder.encode(log or "", add_special_tokens=False).ids) for log in logs.values()]
    histogram = log_lengths.log_length_histogram(clashing(spark, logs, ["length"]))
    got = {r.length: r for r in histogram.collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        above = [x for x in lengths if x >= n]
        assert (r.n_logs, r.n_tokens, r.logs_from, r.tokens_from) == (lengths.count(n), n * lengths.count(n), len(above), sum(above))
        assert r.cut_tokens == sum(min(x, n) for x in lengths)
    assert log_lengths.cut_total(histogram, 50) == sum(min(x, 50) for x in lengths)
    for share in (0.01, 0.5, 0.9, 1.0):
        assert log_lengths.length_quantile(histogram, share) == sorted(lengths)[max(0, int(np.ceil(share * len(lengths))) - 1)]
    none = log_lengths.log_length_histogram(frame(spark, {}))
    assert none.count() == 0 and log_lengths.cut_total(none, 5) == 0 and log_lengths.length_quantile(none, 0.5) is None


def test_encoder_equals_the_tokenizer_on_whole_texts(logs):
    odd = [*logs.values(), "ΣΑΣ Σ İI ﬁ Ǆ", "<|endoftext|>x <|startoftext|> foo's it'LL", "é ́e", "a b\x85c"]
    coder, plain = Encoder(tokenizer_file()), Tokenizer.from_file(tokenizer_file())
    ids, begins = coder.encode(pa.array(odd))
    for i, text in enumerate(odd):
        assert ids[begins[i]:begins[i + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_repeated_passages(spark, logs):
    got = repeated_passages.strip_repeated_passages(clashing(spark, logs, ["n_words", "of_log"]))
    assert "run_id" in got.columns and by_id(got, "log", "n_words", "n_removed") == brute.stripped(logs)
    assert any(gone for _, _, gone in brute.stripped(logs).values())


def test_passages_cut_at_odd_places(spark):
    """Windows that overlap, repeat inside a log, and whose seed also stands elsewhere."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(6)}" for _ in range(400)]
    logs = {i: " ".join(base[rng.randrange(300):][:rng.randrange(10, 90)] + base[rng.randrange(300):][:rng.randrange(10, 40)]) for i in range(40)}
    assert by_id(repeated_passages.strip_repeated_passages(frame(spark, logs)), "log", "n_words", "n_removed") == brute.stripped(logs)


def test_repeated_passages_without_numbers_and_with_equal_ones(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(None, text), (5, text), (5, text), (9, text), (9, "short")]
    got = repeated_passages.strip_repeated_passages(spark.createDataFrame(rows, "log_id long, log string")).collect()
    assert sorted((r.log_id or -1, r.n_words, r.n_removed) for r in got) == [(-1, 20, 0), (5, 20, 0), (5, 20, 0), (9, 1, 0), (9, 20, 20)]
    assert repeated_passages.strip_repeated_passages(frame(spark, {})).count() == 0


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, logs, n):
    got = near_logs.near_duplicate_logs(clashing(spark, logs, ["kept"]), n)
    assert got.columns == ["log_id", "n_shingles", "component_id", "kept"]
    assert by_id(got, "n_shingles", "component_id", "kept") == brute.near(logs, n)


@pytest.mark.parametrize("cluster, few, wide", [(4096, 48, 1 << 16), (4096, 200, 1 << 16), (4096, 48, 0), (80, 48, 1 << 16)])
def test_dense_groups_are_whole_however_they_are_compared(spark, monkeypatch, cluster, few, wide):
    """Near copies around one text: in one piece by matrix, pair by pair, by signature first, and cut along all orders."""
    for name, value in (("CLUSTER", cluster), ("FEW", few), ("WIDE", wide)):
        monkeypatch.setattr(near_logs, name, value)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    logs = {}
    for i in range(120):
        text = list(base)
        for _ in range(rng.randrange(0, 7)):
            text[rng.randrange(60)] = f"v{rng.randrange(1000)}"
        logs[i] = " ".join(text)
    want = brute.near(logs, 2)
    assert by_id(near_logs.near_duplicate_logs(frame(spark, logs), 2), "n_shingles", "component_id", "kept") == want
    assert 1 < len({c for _, c, _ in want.values()}) < 120


def test_dense_regions_are_compared_across_all_edges(spark, monkeypatch):
    """All signatures share the first values of one order: coarse links join them all, and neighbours share a piece wherever a stretch or partition ends."""
    monkeypatch.setattr(near_logs, "WINDOW", 4)
    monkeypatch.setattr(near_logs, "CLUSTER", 8)
    rng = np.random.default_rng(8)
    signs = rng.integers(0, 1 << 32, (100, near_logs.HASHES), dtype=np.uint32)
    signs[:, :near_logs.DEPTH + near_logs.DEEPER] = 7
    classes = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(signs)], "rep long, signature binary").repartition(3)
    assert {r.component for r in components(near_logs._coarse_links(classes)).collect()} == {0}
    at = {}
    for r in near_logs._regions(classes).collect():
        if r.piece[:13] == b"\0" + (b"\0\0\0\7" * 3):
            at.setdefault(r.rep, set()).add(bytes(r.piece))
    assert all(at[i] & at[j] for i in range(100) for j in range(i + 1, min(i + 5, 100)))
    assert max(len(p) for p in at.values()) == 2


def test_near_duplicates_without_numbers_and_with_equal_ones(spark):
    rows = [(None, "a b c"), (3, "a b c"), (3, "x y z"), (8, "x y z"), (9, None), (10, "")]
    got = near_logs.near_duplicate_logs(spark.createDataFrame(rows, "log_id long, log string"), 2).collect()
    assert sorted((r.log_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in got) == [
        (-1, 2, -1, True), (3, 2, 3, True), (3, 2, 3, True), (8, 2, 3, False), (9, 0, 9, True), (10, 0, 10, True)]
    assert near_logs.near_duplicate_logs(frame(spark, {}), 2).count() == 0


def test_notices(spark, logs):
    texts = logs | {700: "CC BY cc-by-sa 4.0, All rights reserved. all rights RESERVED", 701: "GNU Lesser General Public License", 702: "general public",
                    703: "Permission is hereby granted, free of charge, to any person", 704: "Licensed under CC BY-NC 4.0.", 705: "public domain"}
    got = notices.scan_notices(clashing(spark, texts, ["labels", "score"]))
    base = by_id(got, "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert base == {i: brute.notices(log, notices.BASE) for i, log in texts.items()}
    labels = by_id(got, "labels", "score")
    assert labels[700][0] == "cc-by,cc-by-sa,reserved" and labels[701] == ("gpl,lgpl", 1.0) and labels[702] == ("", 0.0)
    assert labels[703][0] == "mit" and 0.3 < labels[703][1] < 1 and labels[704] == ("cc-by,cc-by-nc", 1.0) and labels[705][0] == "public-domain"
    assert notices.scan_notices(frame(spark, {})).count() == 0


def test_notices_against_every_place(spark):
    """Labels and scores by trying every notice at every place of texts made of notice words, cut, repeated and overlapping."""
    rng = random.Random(12)
    known = [(label, p, p) for p, label in notices.BASE.items()] + [(label, text, must) for label, (text, must) in notices.TEMPLATES.items()]
    pool = [w for _, text, _ in known for w in text.split()]
    texts = {i: " ".join(rng.choice([rng.choice(known)[1], rng.choice(known)[2], rng.choice(pool), "cc by", "x"]) for _ in range(rng.randrange(1, 25))) for i in range(150)}
    texts |= {200: "permission " * 50 + "permission to use copy modify", 201: "cc by " * 2000, 202: "by cc", 203: None}
    having = {w: sum(w in brute.prose(t) for t in texts.values()) for w in set(pool)}
    idf = {w: np.log((1 + len(texts)) / (1 + n)) + 1e-6 for w, n in having.items()}
    got = by_id(notices.scan_notices(frame(spark, texts)), "labels", "score")
    for i, text in texts.items():
        w, labels, best = brute.prose(text), set(), 0.0
        for label, notice, must in known:
            own, inner = notice.split(), must.split()
            low = next(k for k in range(len(own)) if own[k:k + len(inner)] == inner)
            for at in range(len(w)):
                if w[at:at + len(inner)] == inner:
                    labels.add(label)
                    begin = at - low
                    met = sum(idf[x] for k, x in enumerate(own) if 0 <= begin + k < len(w) and w[begin + k] == x)
                    best = max(best, met / sum(idf[x] for x in own))
        assert got[i][0] == ",".join(sorted(labels)) and got[i][1] == pytest.approx(best), text


def test_benchmark_calls(spark, logs):
    known = {1: list(logs.values())[3], 2: "MPI_Isend 3", 3: None, 4: "", 5: " ".join(brute.prose(list(logs.values())[10])[4:30]), 6: "no such words at all here"}
    bench = frame(spark, known, "benchmark_id long, log string")
    got = benchmark_calls.mark_benchmark_calls(clashing(spark, logs, ["n_hit", "words", "candidates"]), bench)
    want = brute.benchmark(logs, known)
    assert by_id(got, "n_words", "n_hit", "benchmark_ids") == want and any(hit for _, hit, _ in want.values())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    nothing = benchmark_calls.mark_benchmark_calls(frame(spark, logs), bench.limit(0))
    assert nothing.agg(F.max("n_hit")).first()[0] == 0
    assert benchmark_calls.mark_benchmark_calls(frame(spark, {}), bench).count() == 0


def test_benchmark_calls_without_numbers_and_with_equal_ones(spark):
    text = " ".join(f"w{i}" for i in range(14))
    rows = [(None, text), (5, text), (5, text), (5, "other"), (6, text + " " + text)]
    bench = spark.createDataFrame([(1, text), (2, text)], "benchmark_id long, log string")
    got = benchmark_calls.mark_benchmark_calls(spark.createDataFrame(rows, "log_id long, log string"), bench).collect()
    assert sorted((r.log_id or -1, r.n_words, r.n_hit, len(r.benchmark_ids)) for r in got) == [(-1, 14, 14, 2), (5, 1, 0, 0), (5, 14, 14, 2), (5, 14, 14, 2), (6, 28, 28, 2)]


def test_proximity_matches(spark):
    rows = {1: "alpha beta gamma delta", 2: "alpha x beta y gamma delta", 3: "delta gamma", 4: "alpha " + "x " * 20 + "delta"}
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "benchmark_id long, log string")
    exact = benchmark_calls.phrase_matches(frame(spark, rows), bench)
    near = benchmark_calls.phrase_matches(frame(spark, rows), bench, slack=4)
    assert {r.log_id for r in exact.collect()} >= {1} and {1, 2} <= {r.log_id for r in near.collect()} <= {1, 2, 3}


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_repeated_calls(spark, logs, batches):
    got = repeated_calls.drop_repeated_calls(clashing(spark, logs, ["n_lines", "dropped_keys"]), batches)
    assert by_id(got, "log", "n_lines", "n_dropped") == brute.lines(logs)


def test_repeated_calls_without_numbers_and_with_equal_ones(spark):
    line = "MPI_SEND to rank 7"
    rows = [(None, line), (5, line), (5, f" {line.lower()}\t\nshort"), (9, f"{line}\nshort\n{line}")]
    got = repeated_calls.drop_repeated_calls(spark.createDataFrame(rows, "log_id long, log string")).collect()
    assert sorted((r.log_id or -1, r.log, r.n_lines, r.n_dropped) for r in got) == [
        (-1, line, 1, 0), (5, f" {line.lower()}\t\nshort", 2, 0), (5, line, 1, 0), (9, "short", 3, 2)]
    assert repeated_calls.drop_repeated_calls(frame(spark, {})).count() == 0


def test_runs_are_compacted(spark):
    runs = repeated_calls.LineRuns(spark, 2)
    for i in range(7):
        runs.add(spark.createDataFrame([(bytes([k]), 10 * i + k) for k in range(i, i + 3)], "key binary, log_id long"))
        assert len({at for at, _ in runs.runs}) == len(runs.runs) <= 3
    assert {r.key[0]: r.first_log for r in runs.all().collect()} == {0: 0, 1: 1, 2: 2, **{k: 10 * (k - 2) + k for k in range(3, 9)}}


def test_packing(spark, logs):
    coder = Tokenizer.from_file(tokenizer_file())
    whole = {i: np.array([*coder.encode(log or "", add_special_tokens=False).ids, pack_logs.END], "<u4") for i, log in logs.items()}
    pieces = pack_logs.pack_logs(clashing(spark, logs, ["ids"])).collect()
    for i, ids in whole.items():
        own = sorted((p for p in pieces if p.log_id == i), key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in own) == ids.tobytes() and {p.log_tokens for p in own} == {len(ids)}
        assert [p.start for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
    for number in {p.sequence_id for p in pieces}:
        own = sorted((p for p in pieces if p.sequence_id == number), key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
        total = sum(p.length for p in own)
        assert total <= pack_logs.SEQUENCE and total & (total - 1) == 0 and len(own) <= pack_logs.SEGMENTS
    assert pack_logs.pack_logs(frame(spark, {})).count() == 0


@pytest.mark.parametrize("limits", [(64, 4, 40), (64, 64, 63), (32, 2, 31), (16, 3, 5)])
def test_packer_keeps_all_limits(limits):
    rng = random.Random(1)
    packer, placed, sequences = pack_logs.Packer(*limits), {}, []
    sizes = {i: rng.choice([1, 2, 3, rng.randrange(1, 200)]) for i in range(300)}
    for i, n in sizes.items():
        sequences += packer.add(i, n)
        while len(packer.waiting) > 20:
            sequences.append(packer.fill())
    while packer.waiting:
        sequences.append(packer.fill())
    for sequence in sequences:
        total = sum(n for _, _, n in sequence)
        assert total <= limits[0] and len(sequence) <= limits[1] and sum(n - 1 for _, _, n in sequence) <= limits[2] and total & (total - 1) == 0
        for i, start, n in sequence:
            placed.setdefault(i, []).append((start, n))
    for i, n in sizes.items():
        own = sorted(placed[i])
        assert [a for a, _ in own] == np.cumsum([0, *[k for _, k in own]])[:-1].tolist() and sum(k for _, k in own) == n


def test_quality_on_held_out_logs(spark):
    rng = random.Random(4)
    logs, verdicts = {}, []
    for i in range(600):
        good = rng.random() < 0.8
        logs[i] = "\n".join(call_line(rng) for _ in range(rng.randrange(3, 20))) if good else " ".join([rng.choice(["ERROR!!", "abort"])] * rng.randrange(5, 60))
        if rng.random() < 0.6:
            verdicts.append((i, int(good)))
    truth = dict(verdicts)
    known = spark.createDataFrame(verdicts + [(None, 1), (3, None)], "log_id long, healthy int")
    got = by_id(log_quality.score_logs(clashing(spark, logs | ODD, ["score", "features"]), known), "score", "held_out")
    assert set(got) == set(logs | ODD) and all(0 <= s <= 1 for s, _ in got.values())
    assert all(held == (zlib.crc32(str(i).encode()) % 5 == 0) for i, (_, held) in got.items())
    held = [i for i in truth if got[i][1]]
    assert np.mean([(got[i][0] >= log_quality.CUT_SCORE) == truth[i] for i in held]) > 0.95
    assert got[900] == got[900] and got[901][0] == got[900][0]


def test_quality_without_verdicts_or_logs(spark):
    none = spark.createDataFrame([], "log_id long, healthy int")
    assert {s for s, in by_id(log_quality.score_logs(frame(spark, ODD), none), "score").values()} == {0.5}
    assert log_quality.score_logs(frame(spark, {}), none).count() == 0


def test_likelihood(spark, logs):
    got = by_id(log_likelihood.score_likelihood(clashing(spark, logs, ["score", "row", "rest"])), "n_tokens", "n_known", "train_tokens", "base_score", "score", "held_out")
    for i, want in brute.unigram(logs).items():
        assert got[i][:3] == want[:3] and got[i][3] == pytest.approx(want[3], abs=1e-6)
        assert got[i][5] == (zlib.crc32(str(i).encode()) % 7 == 2) and got[i][4] < 0
    assert log_likelihood.score_likelihood(frame(spark, {})).count() == 0


def test_rare_tokens_come_from_the_join(spark, logs, monkeypatch):
    monkeypatch.setattr(log_likelihood, "HEAD", 5)
    got = by_id(log_likelihood.score_likelihood(frame(spark, logs)), "n_tokens", "n_known", "train_tokens", "base_score")
    assert {i: x[:3] for i, x in got.items()} == {i: x[:3] for i, x in brute.unigram(logs).items()}
    assert all(got[i][3] == pytest.approx(x[3], abs=1e-6) for i, x in brute.unigram(logs).items())


def test_the_filter_returns_the_level_of_a_count(spark):
    rng = np.random.default_rng(3)
    grams = rng.integers(0, 1 << 62, 5000, dtype=np.int64)
    times = np.minimum(rng.zipf(1.6, 5000), 10_000)
    table = spark.createDataFrame([(1, int(g), int(t)) for g, t in zip(grams, times)], "n int, gram long, times long")
    model = log_likelihood.count_filter(table)
    level = model.levels(grams.view(np.uint64), 1)
    want = 1 + np.floor(np.log2(times)).astype(int)
    assert (level >= want).all() and (level == want).mean() > 0.98
    assert (model.levels(rng.integers(0, 1 << 62, 5000, dtype=np.int64).view(np.uint64), 1) == 0).mean() > 0.98


def test_a_large_filter_keeps_every_ngram(spark, monkeypatch):
    """More entries than the smallest filter has room for: it grows, and n-grams seen once are still in it."""
    monkeypatch.setattr(log_likelihood, "SLICES", 2)
    grams = np.arange(1_200_000, dtype=np.int64) * 0x9E3779B1 + 7
    table = spark.range(1_200_000).select(F.lit(2).alias("n"), (F.col("id") * 0x9E3779B1 + 7).alias("gram"), F.lit(1).cast("long").alias("times"))
    model = log_likelihood.count_filter(table)
    assert len(model.bits) == 4 and (model.counts(grams.view(np.uint64), 2) >= 1).all()
    assert (model.levels(grams.view(np.uint64) + np.uint64(1), 2) == 0).mean() > 0.98


def test_scores_are_the_same_by_a_filter_in_slices(spark, logs, monkeypatch):
    given = clashing(spark, logs, ["score", "row", "block", "rest"])
    columns = "n_tokens", "n_known", "train_tokens", "base_score", "score", "held_out"
    want = by_id(log_likelihood.score_likelihood(given), *columns)
    monkeypatch.setattr(log_likelihood, "SHARED_SLICES", 0)
    got = log_likelihood.score_likelihood(given)
    assert "log" in got.columns and by_id(got, *columns) == want
    assert log_likelihood.score_likelihood(frame(spark, {})).count() == 0


def test_logs_of_ranks(spark):
    ev = events(spark, [(0, 1.0, 2, 13, 0, 1, 1, 8), (0, 0.5, 1, 14, 1, 0, 1, 4), (1, 61.0, 3, 26, 1, 1)])
    got = {(r.rank_recording, r.slice): r.log for r in records.rank_logs(ev).collect()}
    assert [line.split()[0] for line in got[0, 0].split("\n")] == ["MPI_RECV", "MPI_SEND"] and got[1, 1].startswith("MPI_BARRIER")
    marked = near_logs.near_duplicate_logs(records.rank_logs(ev.unionByName(ev.withColumn("run_id", F.lit("again")))), 2)
    assert marked.groupBy("component_id").count().filter("count = 2").count() == 2
    digest = records.rank_logs(ev).select(F.sha2("log", 256)).first()[0]
    assert digest in {hashlib.sha256(log.encode()).hexdigest() for log in got.values()}
