"""What one frame of the viewer shows: connections, histogram and latest activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rankscope import functions as fx
from rankscope import schema as S
from rankscope.operators.topology import place_events
from rankscope.operators.traffic import BIN_COLUMNS


def _shown_order():
    return F.struct(F.col("time").alias("shown"), S.order_key().alias("key"))


def frame_connections(active: DataFrame, slots: DataFrame) -> DataFrame:
    """Connections of a frame: collectives per pair of hosts, other calls per pair of ranks."""
    placed = place_events(active.filter(F.col("sender") != F.col("receiver")), slots)
    by_host = fx.visual_category() == "collective"

    def end(name: str):
        return F.when(by_host, F.concat(F.lit("h:"), F.col(f"{name}_host"))) \
                .otherwise(F.concat(F.lit("r:"), F.col(name).cast("string")))

    first = F.min_by(F.struct("sender", "receiver", "sender_host", "receiver_host"), _shown_order())
    out = placed.groupBy("run_id", "call_code", end("sender").alias("from_key"),
                         end("receiver").alias("to_key")) \
        .agg(F.count(F.lit(1)).alias("n"), first.alias("f"))
    return out.select(
        "run_id", fx.call_name().alias("call"), F.col("f.sender").alias("sender"),
        F.col("f.receiver").alias("receiver"), "n",
        (F.col("f.sender_host") == F.col("f.receiver_host")).alias("intra_node"),
        fx.link_weight("n").alias("weight"))


def frame_histogram(active: DataFrame, overall: DataFrame) -> DataFrame:
    """Call by size bin of a frame, for the calls of the whole run's histogram.

    Missing and negative sizes fall in the first bin and placeholders count.
    """
    size = F.greatest(F.coalesce(F.col("bytes"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    counts = active.withColumn("size", size).groupBy("run_id", "call_code").agg(
        *[F.count_if(fx.in_bin("size", i)).alias(c) for i, c in enumerate(BIN_COLUMNS)])
    return (overall.select("run_id", "call", "call_code")
            .join(counts, ["run_id", "call_code"], "left").fillna(0, BIN_COLUMNS)
            .drop("call_code"))


def cell_heat(counts: DataFrame, overall: DataFrame) -> DataFrame:
    """Colour intensity of every histogram cell against the run's largest cell."""
    biggest = overall.groupBy("run_id").agg(F.max(F.greatest(*BIN_COLUMNS)).alias("biggest"))
    out = counts.join(biggest, "run_id")
    cells = F.array(*[F.struct(F.lit(b).alias("bin"), F.col(c).alias("n"),
                               fx.heat(c, F.greatest(F.col("biggest"), F.lit(1).cast("long"))).alias("heat"))
                      for b, c in zip(S.BINS, BIN_COLUMNS)])
    return out.select("run_id", "call", F.inline(cells))


def latest_activity(active: DataFrame, slots: DataFrame) -> DataFrame:
    """Category of the last call, waits and tests aside, that touched each placed rank."""
    touched = (active.filter(~fx.is_completion())
               .withColumn("rank", F.explode(F.array_distinct(F.array("sender", "receiver"))))
               .join(slots.select("run_id", "rank"), ["run_id", "rank"], "left_semi"))
    return (touched.groupBy("run_id", "rank")
            .agg(F.max_by("call_code", _shown_order()).alias("call_code"),
                 F.max("time").alias("time"))
            .select("run_id", "rank", fx.call_name().alias("call"),
                    fx.visual_category().alias("category"), "time"))


# --- highlights ---------------------------------------------------------------

ROOTS_SHOWN, RANKS_SHOWN, LINKS_SHOWN, PAIRS_SHOWN, EXTRA_LINKS = 3, 5, 6, 4, 4


def _issue_priority():
    return F.when(F.col("severity") == "critical", 400) \
            .when(F.col("severity") == "warning", 300).otherwise(200)


def _winner(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Each candidate with the ordinal of the one that wins its key."""
    w = Window.partitionBy("run_id", *keys)
    best = F.max_by("ord", F.struct("priority", -F.col("ord"))).over(w)
    return candidates.withColumn("win", best).withColumn("first_ord", F.min("ord").over(w)) \
                     .filter(F.col("ord") >= F.col("win"))


def rank_highlights(roots: DataFrame, touch: DataFrame, issues: DataFrame | None = None,
                    patterns: DataFrame | None = None) -> DataFrame:
    """Ranks to mark, with the reasons from the strongest one on.

    ``roots`` and ``touch`` are ordered reports; issues and patterns add ranks when they carry
    a ``ranks`` array.
    """
    def rows(df, base, kind, priority, reason, rank="rank", step="position"):
        return df.select("run_id", (F.lit(base).cast("long") + F.col(step)).alias("ord"),
                         F.col(rank).cast("int").alias("rank"), F.lit(kind).alias("kind"),
                         priority.alias("priority"), reason.alias("reason"))

    parts = [rows(roots.filter(F.col("position") <= ROOTS_SHOWN), 10**12, "root", F.lit(120),
                  F.lit("collective_root"), "root"),
             rows(touch.filter(F.col("position") <= RANKS_SHOWN), 3 * 10**12, "top", F.lit(50),
                  F.lit("top_rank"))]
    for df, base, kind, priority in ((issues, 0, "issue", _issue_priority()),
                                     (patterns, 2 * 10**12, "pattern", F.lit(100))):
        if df is not None and "ranks" in df.columns:
            one = df.select("*", F.posexplode("ranks").alias("at", "rank")) \
                    .withColumn("step", F.col("position").cast("long") * 10**6 + F.col("at"))
            parts.append(rows(one, base, kind, priority, F.col("type"), step="step"))
    candidates = parts[0]
    for part in parts[1:]:
        candidates = candidates.unionByName(part)
    won = _winner(candidates.filter(F.col("rank").isNotNull()), ["rank"])
    at_win = F.col("ord") == F.col("win")
    reasons = F.transform(F.array_sort(F.collect_list(F.struct("ord", "reason"))), lambda s: s["reason"])
    return won.groupBy("run_id", "rank").agg(
        F.max(F.when(at_win, F.col("kind"))).alias("kind"),
        F.max(F.when(at_win, F.col("priority"))).alias("priority"), reasons.alias("reasons"))


def link_highlights(top_links: DataFrame, issues: DataFrame | None = None,
                    patterns: DataFrame | None = None) -> DataFrame:
    """Links to mark: at most ten, strongest first, self links left out."""
    zero = F.lit(0).cast("long")

    def rows(df, base, kind, priority, reason, nbytes, step="position"):
        return df.select("run_id", (F.lit(base).cast("long") + F.col(step)).alias("ord"),
                         F.col("sender").cast("int").alias("sender"),
                         F.col("receiver").cast("int").alias("receiver"), F.lit(kind).alias("kind"),
                         priority.alias("priority"), reason.alias("reason"), nbytes.alias("bytes"))

    candidates = rows(top_links.filter(F.col("position") <= LINKS_SHOWN), 10**12, "top", F.lit(100),
                      F.lit("top_link"), F.col("bytes"))
    if issues is not None and "pairs" in issues.columns:
        one = (issues.select("*", F.posexplode("pairs").alias("at", "pair"))
               .filter(F.size("pair") == 2)
               .withColumn("step", F.col("position").cast("long") * 10**6 + F.col("at"))
               .withColumn("sender", F.get("pair", F.lit(0)))
               .withColumn("receiver", F.get("pair", F.lit(1))))
        candidates = candidates.unionByName(
            rows(one, 0, "issue", _issue_priority(), F.col("type"), zero, "step"))
    if patterns is not None and "pairs" in patterns.columns:
        one = (patterns.filter(F.col("type") == "ping_pong")
               .select("*", F.posexplode("pairs").alias("at", "pair"))
               .filter((F.col("at") < PAIRS_SHOWN) & (F.size("pair.ranks") == 2))
               .withColumn("step", F.col("position").cast("long") * 10**6 + F.col("at"))
               .withColumn("sender", F.get("pair.ranks", F.lit(0)))
               .withColumn("receiver", F.get("pair.ranks", F.lit(1))))
        candidates = candidates.unionByName(
            rows(one, 2 * 10**12, "pingpong", F.lit(130), F.lit("ping_pong"),
                 F.coalesce("pair.bytes_total", zero), "step"))
    won = _winner(candidates.filter(F.col("sender") != F.col("receiver")), ["sender", "receiver"])
    at_win = F.col("ord") == F.col("win")
    table = won.groupBy("run_id", "sender", "receiver").agg(
        *[F.max(F.when(at_win, F.col(c))).alias(c) for c in ("kind", "priority", "reason")],
        F.max("bytes").alias("bytes"), F.min("first_ord").alias("first_ord"))
    order = Window.partitionBy("run_id").orderBy(F.col("priority").desc(), F.col("bytes").desc(),
                                                 F.col("first_ord"))
    return (table.withColumn("position", F.row_number().over(order)).drop("first_ord")
            .filter(F.col("position") <= LINKS_SHOWN + EXTRA_LINKS))


def issue_focus(issues: DataFrame, position: int) -> DataFrame:
    """Ranks and links named by one issue of the ordered issue list, as one table.

    Links have a receiver; ranks do not.
    """
    def whole(path: str):
        text = F.get_json_object("metrics", path)
        return F.when(text.rlike(r"^-?\d+$"), text.cast("int"))

    ints = "array<int>"
    ranks = F.col("ranks") if "ranks" in issues.columns else F.lit(None).cast(ints)
    pairs = F.col("pairs") if "pairs" in issues.columns else F.lit(None).cast("array<array<int>>")
    one = issues.filter(F.col("position") == position)
    named = F.array_distinct(F.array_compact(F.concat(
        F.coalesce(ranks, F.array().cast(ints)), F.array(whole("$.root")))))
    rank_rows = one.select("run_id", F.explode(named).alias("sender"), F.lit(None).cast("int").alias("receiver"),
                           F.lit(0).cast("long").alias("bytes"), _issue_priority().alias("priority"),
                           F.col("type").alias("reason"))
    listed = F.transform(F.filter(F.coalesce(pairs, F.array().cast("array<array<int>>")),
                                  lambda p: (F.size(p) == 2) & F.get(p, F.lit(0)).isNotNull()
                                  & F.get(p, F.lit(1)).isNotNull()),
                         lambda p: F.struct(F.get(p, F.lit(0)).alias("sender"),
                                            F.get(p, F.lit(1)).alias("receiver"),
                                            F.lit(0).cast("long").alias("bytes")))
    own = F.struct(whole("$.sender").alias("sender"), whole("$.receiver").alias("receiver"),
                   F.coalesce(F.get_json_object("metrics", "$.bytes").cast("long"),
                              F.lit(0).cast("long")).alias("bytes"))
    links = one.select("run_id", "severity", "type", F.inline(F.concat(listed, F.array(own)))) \
        .filter(F.col("sender").isNotNull() & F.col("receiver").isNotNull()) \
        .groupBy("run_id", "sender", "receiver") \
        .agg(F.min("bytes").alias("bytes"), F.first(_issue_priority()).alias("priority"),
             F.first("type").alias("reason"))
    return rank_rows.unionByName(links)
