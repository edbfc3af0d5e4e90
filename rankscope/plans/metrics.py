"""One row of run-level metrics, assembled only from the groups a question needs."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from rankscope import functions as fx
from rankscope.operators import pairing, topk, traffic

GROUPS = ("totals", "links", "touch", "roots", "barriers", "p2p", "bcast", "reduce")

ZERO_LONG = ["total_events", "canonical_events", "canonical_bytes", "completion_events",
             "barrier_events", "collective_events", "global_collective_events", "small128_events",
             "small1k_events", "pairs_observed", "top_link_bytes", "roots", "root_bytes",
             "top_root_bytes", "barrier_instances", "late_sender_count", "late_receiver_count",
             "late_broadcaster_count", "early_reduce_count"]
ZERO_DOUBLE = ["runtime", "avg_out_peers", "avg_in_peers", "touch_cv", "max_barrier_spread",
               "avg_barrier_spread", "late_sender_time", "late_receiver_time",
               "late_broadcaster_time", "early_reduce_time"]


class Trace:
    """Events and runs with the intermediate tables that several questions share.

    Tables are lazy. With ``share`` the edge table and the totals, which are small next to the
    events, are persisted on first use, so a report reads the events once for each of them
    however many of its sections need them; ``release`` drops them.
    """

    def __init__(self, events: DataFrame, runs: DataFrame, share: bool = False):
        self.events, self.runs, self.share = events, runs, share
        self._tables: dict[str, DataFrame] = {}
        self._persisted: list[str] = []

    def _get(self, name: str, build) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = build()
        return self._tables[name]

    def kept(self, name: str, build) -> DataFrame:
        """A table of at most one row per run, barrier, or link and call, persisted when shared."""
        def persisted() -> DataFrame:
            if not self.share:
                return build()
            self._persisted.append(name)
            return build().persist(StorageLevel.MEMORY_AND_DISK)
        return self._get(name, persisted)

    def release(self) -> None:
        for name in self._persisted:
            self._tables[name].unpersist()

    @property
    def totals(self) -> DataFrame:
        return self.kept("totals", lambda: traffic.trace_totals(self.events))

    @property
    def edges(self) -> DataFrame:
        return self.kept("edges", lambda: traffic.edge_calls(self.events))

    @property
    def links(self) -> DataFrame:
        return self._get("links", lambda: traffic.links_of_edges(self.edges) if self.share
                         else traffic.links(self.events))

    @property
    def pairs(self) -> DataFrame:
        return self._get("pairs", lambda: traffic.pairs_of_links(self.links))

    @property
    def ranks(self) -> DataFrame:
        return self._get("ranks", lambda: traffic.rank_traffic(self.pairs, self.runs))

    @property
    def roots(self) -> DataFrame:
        return self._get("roots", lambda: topk.ordered_roots(
            self.events, self.runs, roots=traffic.roots_of_edges(self.edges) if self.share else None))

    @property
    def spreads(self) -> DataFrame:
        return self.kept("spreads", lambda: pairing.barrier_spreads(self.events, self.runs, self.turns))

    @property
    def turns(self) -> DataFrame | None:
        """All calls that are matched by their turn, numbered once and written down, when the trace is shared."""
        return self._get("turns", lambda: pairing.calls_in_turn(self.events)) if self.share else None

    def group(self, name: str) -> DataFrame:
        return self._get("group_" + name, lambda: getattr(self, "_" + name)())

    def _totals(self) -> DataFrame:
        return self.totals

    def _links(self) -> DataFrame:
        return traffic.link_shape(self.links)

    def _touch(self) -> DataFrame:
        return self.ranks.groupBy("run_id").agg(
            fx.mean("distinct_out_peers").alias("avg_out_peers"),
            fx.mean("distinct_in_peers").alias("avg_in_peers"), fx.cv("touch_bytes").alias("touch_cv"))

    def _roots(self) -> DataFrame:
        return self.roots.groupBy("run_id").agg(
            F.count(F.lit(1)).alias("roots"), F.sum("bytes").alias("root_bytes"),
            F.max("bytes").alias("top_root_bytes"), F.min_by("root", "position").alias("top_root"))

    def _barriers(self) -> DataFrame:
        return pairing.spread_summary(self.spreads)

    def _p2p(self) -> DataFrame:
        return pairing.p2p_lateness(pairing.pair_p2p(self.events, turns=self.turns)).drop("pairs")

    def _bcast(self) -> DataFrame:
        return pairing.late_broadcasters(pairing.pair_bcast(self.events, self.turns))

    def _reduce(self) -> DataFrame:
        return pairing.early_reducers(pairing.pair_reduce(self.events, self.turns))

    def metrics(self, groups=GROUPS) -> DataFrame:
        """One row per run with the requested groups and the ratios they allow."""
        out = self.runs.select("run_id", "total_ranks")
        for name in groups:
            out = out.join(self.group(name), "run_id", "left")
        have = set(out.columns)
        out = out.fillna(0, [c for c in ZERO_LONG if c in have]) \
                 .fillna(0.0, [c for c in ZERO_DOUBLE if c in have])
        n = F.col("total_ranks").cast("long")
        ratios = {
            "small1k_ratio": ("small1k_events", "canonical_events"),
            "completion_ratio": ("completion_events", "canonical_events"),
            "barrier_fraction": ("barrier_events", "total_events"),
            "top_link_share": ("top_link_bytes", "canonical_bytes"),
            "top_root_share": ("top_root_bytes", "root_bytes"),
            "late_sender_ratio": ("late_sender_count", "canonical_events"),
            "late_receiver_ratio": ("late_receiver_count", "canonical_events"),
            "late_broadcaster_ratio": ("late_broadcaster_count", "collective_events"),
            "early_reduce_ratio": ("early_reduce_count", "collective_events"),
            "rel_barrier_spread": ("max_barrier_spread", "runtime"),
        }
        cols = {name: fx.safe_div(a, b) for name, (a, b) in ratios.items() if {a, b} <= have}
        if "pairs_observed" in have:
            cols["pair_density"] = fx.safe_div("pairs_observed", n * F.greatest(n - 1, F.lit(0)))
        return out.withColumns(cols)
