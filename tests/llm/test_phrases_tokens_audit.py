"""Phrase mining, byte-level encoding and the filter audit against plain versions."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankscope.llm import byte_tokens, call_phrases, filter_audit, records
from rankscope.llm.tokens import tokenizer_file
from tests.llm import brute
from tests.llm.test_logs import ODD, by_id, call_line, clashing, frame
from tests.traces import events

FILE = "byte_bpe_50k.json"
MIXED = ["don't", "'s", "'S", "'", "''", " ", "  ", "\n", "\t", "\r\n", "　", "é", "日本語", "<|endoftext|>", "<|endof", "123", "½", "!!", "...", "a", "the",
         "'re'", "'ve", "'lll", "x" * 700, "\x00", "\x1c", "\x85", "🎉", "👨‍👩‍👧", "Ⅷ", "_", "s", "re", "MPI_Isend", "0"]


def mixed_texts(n, seed=1):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(MIXED) for _ in range(rng.randrange(1, 30))) for _ in range(n)]
    return texts + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x20, 0x3000), rng.randrange(0xE000, 0x110000)]))
                            for _ in range(rng.randrange(1, 60))) for _ in range(n)]


# --- byte-level encoding ------------------------------------------------------

def test_ids_are_the_tokenizers(spark):
    texts = {i: t for i, t in enumerate(mixed_texts(400))} | {1000 + i: log for i, log in ODD.items()}
    plain = Tokenizer.from_file(tokenizer_file(FILE))
    encoded = byte_tokens.encode_logs(clashing(spark, texts, ["ids", "n_tokens"]), FILE)
    got = by_id(encoded, "n_tokens", "ids", "run_id")
    for i, text in texts.items():
        want = plain.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (len(want), np.array(want, "<u4").tobytes(), "r"), text
    back = by_id(byte_tokens.decode_logs(encoded, FILE), "log")
    assert back == {i: (plain.decode(plain.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False),) for i, t in texts.items()}
    assert back == {i: (t or "",) for i, t in texts.items()}


def test_many_runs_of_one_encoder_agree():
    coder, plain = byte_tokens.ByteEncoder(tokenizer_file(FILE)), Tokenizer.from_file(tokenizer_file(FILE))
    texts = mixed_texts(150, 2) + ["ab" * 3000, "x" * 20_000, " " * 3000, "ñandú" * 2000]
    for part in (texts[:40], texts, texts[::-1]):
        ids, begins = coder.encode(pa.array(part))
        for i, text in enumerate(part):
            assert ids[begins[i]:begins[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_compatible_pairs_are_those_that_encode_to_themselves():
    coder = byte_tokens.ByteEncoder(tokenizer_file(FILE))
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 50256, 4000), rng.integers(0, 50256, 4000)
    a[:2000], b[:2000] = rng.integers(0, 900, 2000), rng.integers(0, 900, 2000)  # short tokens join more often
    token = [coder.bytes[e - n:e].tobytes() for e, n in zip(coder.ends, coder.sizes)]
    want = [coder._merged(token[x] + token[y]) == [x, y] for x, y in zip(a, b)]
    assert coder.compatible(a, b).tolist() == want and 100 < sum(want) < 3900


def test_odd_ids_are_decoded(spark):
    rows = [(1, None), (2, b""), (3, np.array([99_999, 64, 50256, 70_000], "<u4").tobytes()), (4, np.array([164, 64], "<u4").tobytes())]
    plain = Tokenizer.from_file(tokenizer_file(FILE))
    got = by_id(byte_tokens.decode_logs(spark.createDataFrame(rows, "log_id long, ids binary"), FILE), "log")
    assert got == {1: ("",), 2: ("",), 3: ("a<|endoftext|>",), 4: (plain.decode([164, 64], skip_special_tokens=False),)}
    assert "�" in got[4][0]


def test_encoding_of_nothing_and_of_rank_logs(spark):
    assert byte_tokens.decode_logs(byte_tokens.encode_logs(frame(spark, {}))).count() == 0
    made = records.rank_logs(events(spark, [(0, 1.0, 2, 13, 0, 1, 1, 8), (0, 1.0, 2, 13, 0, 1, 1, 8), (1, 61.0, 3, 26, 1, 1)]))
    back = byte_tokens.decode_logs(byte_tokens.encode_logs(made))
    assert sorted(back.select(*made.columns).collect()) == sorted(made.collect())


# --- phrases ------------------------------------------------------------------

def plain_phrases(rows, longest=3, at_least=10, share=50, best=2000):
    """``rows`` of (run, log): the whole list by counting every phrase of every piece."""
    counts, total = Counter(), Counter()
    for run, log in rows:
        run = "und" if run is None else run
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (log or "").translate(brute.FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[run] += len(w)
            for n in range(1, longest + 1):
                counts.update((run, tuple(w[i:i + n])) for i in range(len(w) - n + 1))
    found = {key: n for key, n in counts.items() if len(key[1]) > 1 and n >= at_least}
    longer = Counter()
    for (run, p), n in found.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                longer[run, p[i:i + size]] = max(longer[run, p[i:i + size]], n)
    out = {}
    for (run, p), a in found.items():
        if longer[run, p] and 100 * longer[run, p] >= share * a:
            continue
        cuts = [(1_000_000 * a * a // (counts[run, p[:k]] * counts[run, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(run, []).append((-score, -a, " ".join(p).encode(), counts[run, p[:k]], counts[run, p[k:]]))
    return {(run, rank, p.decode(), -a, first, rest, total[run], -score)
            for run, rows in out.items() for rank, (score, a, p, first, rest) in enumerate(sorted(rows)[:best], 1)}


PHRASES = "run_id", "rank", "phrase", "n_phrase", "n_first", "n_rest", "n_words", "score"


def found_phrases(df):
    return {tuple(r[c] for c in PHRASES) for r in df.collect()}


@pytest.fixture(scope="module")
def run_logs():
    rng = random.Random(11)
    common = [call_line(rng) for _ in range(8)]
    out = []
    for i in range(150):
        lines = [rng.choice(common) if rng.random() < 0.6 else call_line(rng) for _ in range(rng.randrange(1, 25))]
        out.append((rng.choice(["a", "b", "", None]), rng.choice([" ", "\n", ". ", "\t,"]).join(lines)))
    out += [("a", out[0][1])] * 30 + [(None, log) for log in ODD.values()]
    return out + [("b", "go " * 900), ("c", "\n\n.,."), ("c", "one two"), ("é", "É é. " * 40), ("w", "x" * 5000 + " y " + "z" * 3000)]


def run_frame(spark, rows):
    return spark.createDataFrame([(*r, "given", "given") for r in rows], "run_id string, log string, phrase string, words string").repartition(5)


@pytest.mark.parametrize("longest, at_least", [(3, 10), (2, 3), (5, 12)])
def test_phrases(spark, run_logs, longest, at_least):
    got = call_phrases.call_phrases(run_frame(spark, run_logs), longest, at_least)
    want = plain_phrases(run_logs, longest, at_least)
    assert found_phrases(got) == want and len(want) > 40


def test_phrases_do_not_depend_on_the_parse(spark, run_logs):
    """Chunks of a few words, chunks cut without triggers, and a crowded table of frequent phrases give the same list."""
    want = plain_phrases(run_logs)
    for shape in ({"trigger": 1}, {"trigger": 10 ** 9}, {"farthest": 3}, {"filter_bits": 1 << 16}):
        assert found_phrases(call_phrases.call_phrases(run_frame(spark, run_logs), **shape)) == want, shape


def test_equal_stretches_share_chunks(spark):
    rng = random.Random(3)
    passage = " ".join(str(rng.randrange(10 ** 6)) for _ in range(2000))
    rows = [("r", f"{' '.join(str(rng.randrange(10 ** 6)) for _ in range(50))} {passage}") for _ in range(40)]
    chunks = call_phrases.parse_chunks(run_frame(spark, rows)).collect()
    held = sum(c.times * (len(c.chunk.split(" ")) - 2) for c in chunks)
    assert held == 40 * 2050 and sum(len(c.chunk.split(" ")) for c in chunks) < 10_000 and max(c.times for c in chunks) == 40


def test_only_the_best_phrases_of_a_run(spark, run_logs):
    got = found_phrases(call_phrases.call_phrases(run_frame(spark, run_logs), best=3))
    assert got == plain_phrases(run_logs, best=3)


def test_phrases_of_nothing_and_of_rank_logs(spark):
    assert call_phrases.call_phrases(spark.createDataFrame([], "run_id string, log string")).count() == 0
    made = records.rank_logs(events(spark, [(i % 2, 0.1 * i, i, 13, i % 2, 1 - i % 2, 1, 8) for i in range(60)]))
    got = call_phrases.call_phrases(made)
    assert found_phrases(got) == plain_phrases([(r.run_id, r.log) for r in made.collect()]) and got.count() > 0


def test_scores_beyond_64_bits(spark):
    """Counts of 3 billion: the products need more than 64 bits."""
    big = 3_000_000_000
    known = spark.createDataFrame([("r", 0, "", 4 * big), ("r", 1, "x", big + 1), ("r", 1, "y", big + 7), ("r", 2, "x y", big)], "run_id string, words int, phrase string, n long")
    chunks = spark.createDataFrame([], "run_id string, chunk string, times long")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(call_phrases, "count_phrases", lambda *a, **k: known.filter(F.col("words").isin(a[1])))
        m.setattr(call_phrases, "parse_chunks", lambda *a, **k: chunks)
        row = call_phrases.call_phrases(spark.createDataFrame([], "run_id string, log string")).first()
    assert row.score == 1_000_000 * big * big // ((big + 1) * (big + 7)) and row.n_phrase == big


# --- filter audit -------------------------------------------------------------

def plain_audit(rows, verdicts):
    """``rows`` of (log_id, run_id, log): every log through every order of the filters."""
    first = {}
    for i, _, log in rows:
        if i is not None:
            first[log or ""] = min(first.get(log or "", i), i)
    good = {i for i, h, _ in verdicts if h == 1}
    bad = {i for i, _, s in verdicts if s == 1}
    judged = []
    for i, run, log in rows:
        text = log or ""
        w = brute.calls(text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and first[text] < i}
        judged.append((run or "", fails, i in good and i is not None, i in bad and i is not None))
    out = {}
    for run in {j[0] for j in judged}:
        mine = [j for j in judged if j[0] == run]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [j for j in left if j[1][f]]
                left = [j for j in left if not j[1][f]]
                failing = sum(j[1][f] for j in mine)
                shapley[f] += len(gone)
                out[run, order, step] = [len(left), len(gone), failing - len(gone), sum(j[1][f] and sum(j[1].values()) == 1 for j in mine),
                                         sum(j[2] for j in gone), sum(j[3] for j in gone)]
        for (r, order, step), counts in out.items():
            if r == run:
                counts.append(shapley[order[step - 1]])
    return {key: tuple(v) for key, v in out.items()}


COUNTS = "kept", "removed", "redundant", "unique_fails", "healthy_lost", "suspect_lost", "shapley"


def test_filter_audit(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "B", "c", f"w{k}", f"v{rng.randrange(400)}", "#"][:rng.randrange(3, 7)]) for k in range(rng.choice([20, 199, 200, 350])))
             for _ in range(30)] + list(ODD.values()) + ["é" * 97 + "ABC", "é" * 96 + "ABC", "x $"]
    rows = [(n * 3 % 101, rng.choice(["a", "b", "", None]), rng.choice(texts)) for n in range(101)]
    rows += [(5, "a", texts[0]), (5, "b", texts[0]), (5, "a", texts[0]), (None, "a", texts[0]), (None, "only", None)]
    verdicts = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 90)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (5000, 1, 1)]
    logs = spark.createDataFrame([(*r, "given", 1) for r in rows], "log_id long, run_id string, log string, A string, cell int").repartition(7)
    audit = filter_audit.audit_filters(logs, spark.createDataFrame(verdicts, "log_id long, healthy int, suspect int"))
    got = {(r.run_id, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in audit.collect()}
    assert got == plain_audit(rows, verdicts) and audit.count() == 600 * 4


def test_order_statistics_add_up():
    tensor = np.random.default_rng(2).integers(0, 1000, (3, 3, *[2] * 5))
    made = filter_audit.order_statistics(tensor, "ABCDE")
    total = tensor[:, 0].reshape(3, -1).sum(axis=1)
    assert (made["kept"][:, :, -1] == tensor[:, 0, 0, 0, 0, 0, 0][:, None]).all()
    assert (made["removed"].sum(axis=2) + made["kept"][:, :, -1] == total[:, None]).all()
    assert (made["shapley"].sum(axis=2) == 120 * (total - tensor[:, 0, 0, 0, 0, 0, 0])[:, None]).all()


def test_audit_of_nothing_and_of_rank_logs(spark):
    none = spark.createDataFrame([], "log_id long, healthy int, suspect int")
    assert filter_audit.audit_filters(spark.createDataFrame([], "log_id long, run_id string, log string"), none).count() == 0
    made = records.rank_logs(events(spark, [(i % 4, 0.1 * i, i, 13, i % 4, 1, 1, 8) for i in range(40)]))
    got = {(r.run_id, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in filter_audit.audit_filters(made, none).collect()}
    assert got == plain_audit([(r.log_id, r.run_id, r.log) for r in made.collect()], [])


def test_copies_of_a_text_do_not_meet(spark):
    """A text in 50,000 rows comes down to one row per run and verdict before it is compared."""
    rows = spark.range(50_000).select(F.col("id").alias("log_id"), F.lit("r").alias("run_id"), F.when(F.col("id") % 10 < 9, "same").otherwise(F.concat(F.lit("own "), "id")).alias("log"))
    none = spark.createDataFrame([], "log_id long, healthy int, suspect int")
    last = filter_audit.audit_filters(rows, none).filter("filter_order = 'EABCD' and step = 1").first()
    assert (last.removed, last.kept) == (44_999, 5_001)
