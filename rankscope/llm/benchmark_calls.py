"""Benchmark passages inside logs, found with a positional index of rare terms. SQL and column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankscope.llm.stage import carried, written

WINDOW = 10
RAREST = 2                # postings of so many terms of a window are intersected before its words are compared
BROADCAST_ROWS = 200_000  # a term table up to this many rows is sent to every executor (about 20 MB), a larger one is shuffled

# The letters that are lower-cased, and all bytes between words (ASCII but letters and digits).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

RESULTS = ["n_words", "n_hit", "benchmark_ids"]


def words_of(text: Column) -> Column:
    """The words of a text: A-Z in lower case, cut at ASCII but letters and digits; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def phrases(benchmarks: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the benchmark logs with the benchmarks that hold them; a shorter log is one window."""
    return (benchmarks.select("benchmark_id", words_of(F.col("log")).alias("words")).filter(F.size("words") > 0)
            .select("benchmark_id", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))).alias("at"))
            .select("benchmark_id", F.slice("words", F.col("at"), F.lit(window)).alias("terms"))
            .groupBy("terms").agg(F.collect_set("benchmark_id").alias("benchmark_ids")))


def _bounded(df: DataFrame) -> DataFrame:
    """A written table, broadcast if its counted rows are few; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def postings(logs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, log_id, text_key, pos)``: every place where a log has one of ``terms``, words counted from 0."""
    return (logs.select("log_id", F.xxhash64("log").alias("text_key"), F.posexplode(words_of(F.col("log"))).alias("pos", "term"))
            .join(terms, "term"))


def rarest_terms(windows: DataFrame, logs: DataFrame, rarest: int = RAREST) -> DataFrame:
    """``(term, phrase, offset, n_rare)``: the ``rarest`` least frequent terms of each window, by the count of all log words.

    A window with a term that no log has is left out: it cannot occur.
    """
    in_windows = windows.select("phrase", F.posexplode("terms").alias("offset", "term"))
    vocabulary = _bounded(written(in_windows.select("term").distinct(), "vocabulary"))
    counts = written(logs.select(F.explode(words_of(F.col("log"))).alias("term")).join(vocabulary, "term")
                     .groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term-counts")
    ranked = (in_windows.join(counts, "term", "left").groupBy("phrase")
              .agg(F.sort_array(F.collect_list(F.struct("n", "term", "offset"))).alias("by_count"))
              .filter(F.col("by_count")[0]["n"].isNotNull())
              .select("phrase", F.slice("by_count", 1, rarest).alias("rare")))
    return ranked.select("phrase", F.size("rare").alias("n_rare"), F.explode("rare").alias("r")) \
                 .select(F.col("r.term").alias("term"), "phrase", F.col("r.offset").alias("offset"), "n_rare")


def phrase_matches(logs: DataFrame, benchmarks: DataFrame, window: int = WINDOW, slack: int = 0) -> DataFrame:
    """Places where the rarest terms of a benchmark window stand at their distances, within ``slack`` words.

    The index holds postings of the rarest terms only. Lists are shifted by each term's offset in the window and
    intersected by log and start. With ``slack`` above 0 starts are compared in buckets of that width, which gives
    proximity matches: the terms stand near each other in any order. Returns ``log_id, text_key, phrase, start``.
    """
    windows = written(phrases(benchmarks, window).withColumn("phrase", F.xxhash64("terms")), "phrases")
    return _starts(logs, windows, slack)


def _starts(logs: DataFrame, windows: DataFrame, slack: int = 0) -> DataFrame:
    rare = written(rarest_terms(windows, logs), "rarest")
    index = written(postings(logs, _bounded(rare.select("term").distinct())), "postings")
    shifted = index.join(_bounded(rare), "term").withColumn("start", F.col("pos") - F.col("offset"))
    if slack:
        shifted = shifted.withColumn("bucket", F.explode(F.array(F.floor(F.col("start") / (2 * slack)),
                                                                 F.floor((F.col("start") + slack) / (2 * slack)) + F.lit(0.5))))
        found = (shifted.groupBy("log_id", "text_key", "phrase", "bucket")
                 .agg(F.count_distinct("offset").alias("met"), F.max("n_rare").alias("n_rare"), F.min("start").alias("start")))
        return found.filter("met = n_rare").select("log_id", "text_key", "phrase", "start").distinct()
    found = (shifted.filter("start >= 0").groupBy("log_id", "text_key", "phrase", "start")
             .agg(F.count(F.lit(1)).alias("met"), F.max("n_rare").alias("n_rare")))
    # Rows that share a log number and text are counted together, so a full set of terms may be met several times.
    return found.filter("met >= n_rare").select("log_id", "text_key", "phrase", "start")


def mark_benchmark_calls(logs: DataFrame, benchmarks: DataFrame, window: int = WINDOW) -> DataFrame:
    """Count the words of each log that lie inside a window of a benchmark log.

    ``logs`` has ``log_id`` long and ``log`` string; ``benchmarks`` has ``benchmark_id`` long and ``log`` string, the
    logs of known benchmark programs that must not be trained on. A window is ``window`` consecutive words of a
    benchmark; a shorter one, but not an empty one, is one window. Candidates come from ``phrase_matches``; each is
    then compared word for word with the log itself, so the result is exact.

    Returns the columns of ``logs`` with ``n_words``, ``n_hit`` (words inside any occurrence) and ``benchmark_ids`` (sorted, those
    with an occurring window). Null has no words. Every row is judged on its own, also where a ``log_id`` repeats or is null.
    No rows give no rows; without benchmarks nothing is hit. Columns named like a result are replaced.
    """
    windows = written(phrases(benchmarks, window).withColumn("phrase", F.xxhash64("terms")), "phrases")
    slim = logs.select(F.col("log_id").cast("long").alias("log_id"), "log")
    candidates = (_starts(slim, windows).join(_bounded(windows), "phrase")
                  .groupBy(F.col("log_id").alias("of_log"), F.col("text_key").alias("of_text"))
                  .agg(F.collect_list(F.struct("start", "terms", "benchmark_ids")).alias("candidates")))
    kept = carried(logs, [*RESULTS, "candidates", "of_log", "of_text", "words", "hits"])
    rows = (logs.select(*kept).join(candidates, F.col("log_id").cast("long").eqNullSafe(F.col("of_log"))
                                    & F.xxhash64("log").eqNullSafe(F.col("of_text")), "left")
            .withColumn("words", words_of(F.col("log")))
            .withColumn("hits", F.filter("candidates", lambda c: F.slice("words", c["start"] + 1, F.size(c["terms"])) == c["terms"])))
    places = F.flatten(F.transform("hits", lambda c: F.sequence(c["start"], c["start"] + F.size(c["terms"]) - 1)))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda c: c["benchmark_ids"]))))
    none = F.array().cast("array<long>")
    return rows.select(*kept, F.size("words").cast("long").alias("n_words"),
                       F.coalesce(F.size(F.array_distinct(places)), F.lit(0)).cast("long").alias("n_hit"),
                       F.coalesce(ids.cast("array<long>"), none).alias("benchmark_ids"))
