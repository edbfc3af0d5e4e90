"""A quality classifier for logs, learned from trusted positives and unlabelled logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rankscope.llm import words as W
from rankscope.llm.stage import carried, written

FIRST, LAST = 0x20, 0x7F            # bytes whose shares are features of their own
N_FEATURES = (LAST - FIRST) + 9     # with the share of other bytes, the word statistics and a constant
STEPS, RATE = 400, 0.05
RIDGE, FEW_POSITIVES = 1e-3, 20.0    # weight of the penalty: at least RIDGE, and FEW_POSITIVES over their number
BINS = 400                          # of the raw score, from -0.5 to 1.5, for the choice of the cut
CUT_SCORE, STEEPNESS = 0.3, 10.0    # the score at the cut, and how fast it changes there
LEAST_PRIOR, MOST_PRIOR = 0.05, 0.95


def trained_on(log_id: Column) -> Column:
    """True for logs that may be learned from; the others are held out."""
    return F.crc32(log_id.cast("string")) % 5 != 0


def features(batch: pa.RecordBatch) -> np.ndarray:
    """A row of ``N_FEATURES`` numbers per log, from its text alone: byte shares and word statistics."""
    data, offsets = W.texts(batch.column("log"))
    starts, ends, first = W.spans(data, offsets, W.SPACES)
    words = W.fingerprints(data, starts, ends)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES), np.float32)
    for i in range(n):
        a, z, low, high = first[i], first[i + 1], offsets[i], offsets[i + 1]
        size, count = max(1, high - low), max(1, z - a)
        shares = np.bincount(data[low:high], minlength=256) / size
        out[i, :LAST - FIRST] = np.sqrt(shares[FIRST:LAST])
        own, lengths = words[a:z], ends[a:z] - starts[a:z]
        capitals = upper[ends[a:z]] - upper[starts[a:z]]
        _, times = np.unique(own, return_counts=True)
        out[i, LAST - FIRST:] = (
            np.sqrt(shares[128:].sum()),
            (own[1:] == own[:-1]).sum() / count,          # a word right after itself
            len(times) / count,                           # different words
            times.max(initial=0) / count,                 # share of the commonest word
            lengths.sum() / count / 10,
            ((lengths > 1) & (capitals == lengths)).sum() / count,
            (lengths <= 3).sum() / count,
            np.log1p(z - a) / 10,
            1.0)
    return out


def log_features(logs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``logs`` with ``features``, the numbers of ``features`` as 32-bit floats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.blocks(batches, "log"):
            packed = pa.array([row.tobytes() for row in features(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], packed], [*columns, "features"])
    schema = T.StructType([*[logs.schema[c] for c in columns], T.StructField("features", T.BinaryType())])
    return logs.select(*dict.fromkeys([*columns, "log"])).mapInArrow(run, schema)


def moments(rows: DataFrame) -> dict[str, tuple[float, np.ndarray]]:
    """Row count and sum of outer products of ``features`` for each ``part``.

    Every task adds up its own rows; what reaches the driver is one matrix of ``N_FEATURES`` squared per part.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("features").to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
            parts = np.array(batch.column("part").to_pylist())
            for part in np.unique(parts):
                own = x[parts == part]
                sums[part] = sums.get(part, 0) + own.T @ own
        for part, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part] * total.size), pa.array(np.arange(total.size)), pa.array(total.ravel())],
                                             ["part", "cell", "value"])
    cells = rows.select("part", "features").mapInArrow(run, "part string, cell long, value double") \
                .groupBy("part", "cell").agg(F.sum("value").alias("value")).collect()
    out: dict[str, np.ndarray] = {}
    for part, cell, value in cells:
        out.setdefault(part, np.zeros(N_FEATURES * N_FEATURES))[cell] = value
    return {part: (x[-1], x.reshape(N_FEATURES, N_FEATURES) / x[-1]) for part, x in out.items()}  # the last cell counts rows


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, penalty: float) -> np.ndarray:
    """Weights of the linear score in -1 to 1 with the least non-negative risk.

    With squared loss every risk is a quadratic form of the mean outer products (the last feature is 1): ``prior`` times the
    loss of positives taken as good, and the loss of unlabelled logs taken as bad less ``prior`` times that of positives.
    The last difference estimates the loss on bad logs and cannot be negative; where a step makes it so, the step goes back up.
    """
    mean, scale = unlabelled[-1].copy(), np.sqrt(np.maximum(np.diag(unlabelled) - unlabelled[-1] ** 2, 0))
    mean[-1], used = 0, scale > 1e-6
    inverse = np.where(used, 1 / np.where(used, scale, 1), 0)
    inverse[-1] = 1
    shift = np.diag(inverse)
    shift[:-1, -1] = -mean[:-1] * inverse[:-1]
    p, u = shift @ positive @ shift.T, shift @ unlabelled @ shift.T
    ridge = penalty * np.diag([1.0] * (len(p) - 1) + [0.0])

    def loss(m: np.ndarray, w: np.ndarray, target: float) -> tuple[float, np.ndarray]:
        return (w @ m @ w - 2 * target * (m[-1] @ w) + 1) / 4, (m @ w - target * m[-1]) / 2

    w = np.linalg.solve(u + 4 * ridge + 1e-9 * np.eye(len(p)), 2 * prior * p[-1] - u[-1])
    rate = RATE / max(1.0, np.linalg.eigvalsh(u)[-1] / 20)
    for _ in range(STEPS):
        bad, to_bad = loss(u, w, -1)
        wrong, to_wrong = loss(p, w, -1)
        _, to_good = loss(p, w, 1)
        if bad - prior * wrong >= 0:
            w = w - rate * (prior * to_good + to_bad - prior * to_wrong + ridge @ w)
        else:
            w = w + rate * (to_bad - prior * to_wrong)
    return shift.T @ w


def cut(histogram: dict[str, np.ndarray], prior: float) -> float:
    """The raw score that parts good from bad, among the bins with the least non-negative share of errors.

    A prior that is too high makes bins among the bad ones look free of errors, so the cut lies nearer to the upper end.
    """
    below_p = np.concatenate([[0], np.cumsum(histogram["positive"])]) / max(1, histogram["positive"].sum())
    below_u = np.concatenate([[0], np.cumsum(histogram["unlabelled"])]) / max(1, histogram["unlabelled"].sum())
    errors = prior * below_p + np.maximum(0, (1 - below_u) - prior * (1 - below_p))
    best = np.flatnonzero(errors <= errors.min() + 1e-3)
    return float((best[0] + 3 * best[-1]) / 4 * 2 / BINS - 0.5)


def score_logs(logs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Score logs for quality, having learned from positive and unlabelled logs.

    ``logs`` has ``log_id`` long and ``log`` string; ``verdicts`` has ``log_id`` and ``healthy`` (1 good, 0 bad, null unknown). Learning
    uses only logs of ``trained_on``: the healthy ones are the trusted positives, all logs are the unlabelled ones, and the
    class prior is the share of healthy among the verdicts given. Bad verdicts serve for that share alone. The risk is
    computed over all logs in one pass, from sums that are as large for any input (``moments``).

    Returns the columns of ``logs`` with ``held_out`` and ``score`` (0 to 1, higher: likelier healthy). Every log gets a score, null
    and empty ones that of an empty text. Repeated rows count as often as they stand there; a log with several verdicts is
    healthy if any says so. Without healthy verdicts or logs to learn from every score is 0.5. Columns named like a result are replaced.
    """
    kept = carried(logs, ["score", "held_out", "features"])
    rows = written(log_features(logs, kept), "features")
    learn = rows.filter(trained_on(F.col("log_id"))).select(F.col("log_id").cast("long").alias("log_id"), "features")
    known = verdicts.filter("healthy is not null and log_id is not null").filter(trained_on(F.col("log_id"))) \
                    .groupBy(F.col("log_id").cast("long").alias("log_id")).agg(F.max(F.col("healthy").cast("int")).alias("healthy"))
    share = known.agg(F.avg("healthy")).first()[0]
    good = learn.join(known.filter("healthy = 1"), "log_id").select("features", F.lit("positive").alias("part"))
    parts = good.unionByName(learn.select("features", F.lit("unlabelled").alias("part")))
    sums = moments(parts)
    weights, prior = np.zeros(N_FEATURES), min(max(share or 0.5, LEAST_PRIOR), MOST_PRIOR)
    trained = "positive" in sums and "unlabelled" in sums
    if trained:
        weights = fit(sums["positive"][1], sums["unlabelled"][1], prior, max(RIDGE, FEW_POSITIVES / sums["positive"][0]))

    def raw(rows: DataFrame, names: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.frombuffer(b"".join(batch.column("features").to_pylist()), np.float32).reshape(-1, N_FEATURES)
                value = pa.array((1 + x.astype(np.float64) @ weights) / 2, pa.float64())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], value], [*names, "raw"])
        schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("raw", T.DoubleType())])
        return rows.select(*names, "features").mapInArrow(run, schema)

    score = F.lit(0.5)
    if trained:
        bins = {part: np.zeros(BINS) for part in sums}
        at = F.least(F.greatest(F.floor((F.col("raw") + 0.5) * BINS / 2), F.lit(0)), F.lit(BINS - 1)).cast("int")
        for part, i, n in raw(parts, ["part"]).groupBy("part", at.alias("bin")).count().collect():
            bins[part][i] = n
        score = 1 / (1 + F.exp(-STEEPNESS * (F.col("raw") - cut(bins, prior)) - float(np.log(CUT_SCORE / (1 - CUT_SCORE)))))
    return (raw(rows, kept).select(*kept, score.alias("score"))
            .withColumn("held_out", ~F.coalesce(trained_on(F.col("log_id")), F.lit(True))))
