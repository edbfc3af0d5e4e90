"""What patterns and issues say, as one table of templates for the rules and for their SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from rankscope import functions as fx

# A number is %d, %.3f or %.6f; %.1f%% is a share as a percentage.
TEXTS = {
    "dense-communication": "%.3f of all rank pairs exchange data, so most ranks talk to most others.",
    "sparse-communication": "Only %.3f of all rank pairs exchange data, as with fixed neighbours.",
    "small-message-dominated": "Transfers below 1 KB make up %.1f%% of all transfers.",
    "root-concentrated-collectives": "The busiest root handles %.1f%% of the bytes of rooted collectives.",
    "dominant-link": "The busiest link moves %.1f%% of all bytes.",
    "rank-communication-imbalance": "Ranks differ in volume with a coefficient of variation of %.3f.",
    "completion-heavy": "There are %.3f waits and tests per transfer.",
    "barrier-heavy": "Ranks entered barriers %d times.",
    "late_sender": "%d receives waited for their send, %.3f s together.",
    "late_receiver": "%d sends waited for their receive, %.3f s together.",
    "late_broadcaster": "%d ranks were at a broadcast before its root, %.3f s together.",
    "early_reduce_arrival": "%d ranks were at a reduction before its root, %.3f s together.",
    "small_message_pressure": "With %.1f%% of transfers below 1 KB the cost per message may dominate.",
    "rank_traffic_imbalance": "A few ranks carry the volume: coefficient of variation %.3f.",
    "collective_root_bottleneck": "Rooted collectives depend on one rank for %.1f%% of their bytes.",
    "barrier_arrival_skew": "Ranks reach barriers apart from each other, by %.6f s at most and %.6f s on average.",
    "completion_overhead": "Waits and tests outnumber transfers %.3f to one.",
    "link_hotspot": "One pair of ranks accounts for %.1f%% of all bytes.",
}


def said(kind: str, *fields: str) -> tuple:
    """Texts and columns that make up the sentence of ``kind`` with its fields filled in."""
    out, values = [], iter(fields)
    for piece in re.split(r"(%\.1f%%|%\.\df|%d)", TEXTS[kind]):
        if piece == "%.1f%%":
            out.append(fx.percent(next(values)))
        elif piece == "%d":
            out.append(F.col(next(values)).cast("string"))
        elif piece.startswith("%"):
            out.append(fx.fixed(next(values), int(piece[2])))
        elif piece:
            out.append(piece)
    return tuple(out)


def said_sql(kind: str, *values: str) -> str:
    return f"printf('{TEXTS[kind]}', {', '.join(values)})"
