"""Column functions: every one is a built-in expression that stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rankscope import schema as S


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- sizes, scores and ratios ------------------------------------------------

def size_bin(nbytes) -> Column:
    """Label of the size bin; null for negative sizes."""
    n = _col(nbytes)
    out = F.when(n < 0, None)
    for edge, label in zip(S.BIN_EDGES, S.BINS):
        out = out.when(n < edge, label)
    return out.when(n.isNotNull(), S.BINS[-1])


def in_bin(nbytes, i: int) -> Column:
    """True when a non-negative size falls in bin number ``i``."""
    n = _col(nbytes)
    low = 0 if i == 0 else S.BIN_EDGES[i - 1]
    return (n >= low) & (n < S.BIN_EDGES[i]) if i < len(S.BIN_EDGES) else n >= low


def severity(score) -> Column:
    s = _col(score)
    return F.when(s >= 0.85, "critical").when(s >= 0.6, "warning").otherwise("info")


def safe_div(num, den) -> Column:
    """Double quotient, 0 when the denominator is 0 or missing."""
    n, d = _col(num).cast("double"), _col(den).cast("double")
    return F.coalesce(F.try_divide(n, d), F.lit(0.0))


def mean(c) -> Column:
    return F.coalesce(F.avg(_col(c)), F.lit(0.0))


def pstdev(c) -> Column:
    return F.coalesce(F.stddev_pop(_col(c)), F.lit(0.0))


def cv(c) -> Column:
    """Population coefficient of variation, 0 when the mean is 0."""
    return safe_div(pstdev(c), mean(c))


def nbytes(count, type_size) -> Column:
    """Payload size: 0 unless both factors are positive, saturated to a 32-bit int."""
    a, b = _col(count).cast("long"), _col(type_size).cast("long")
    return F.when((a <= 0) | (b <= 0), F.lit(0).cast("long")) \
            .otherwise(F.least(a * b, F.lit(2147483647).cast("long")))


# --- call families and event predicates --------------------------------------

def _values(codes) -> str:
    return ", ".join(map(str, codes))


_FIRST = min(S.CALLS)
_NAMES = "array(" + ", ".join(f"'{S.CALLS[c]}'" for c in sorted(S.CALLS)) + ")"


def call_name(code: str = "call_code") -> Column:
    """Name of a call code, ``UNKNOWN_<n>`` outside the known range."""
    return F.expr(f"coalesce(get({_NAMES}, cast({code} as int) - {_FIRST}), "
                  f"concat('UNKNOWN_', cast({code} as string)))")


def call_code(name: str = "call") -> Column:
    """Code of a call name; the number itself for ``UNKNOWN_<n>``, null for other text."""
    at = f"array_position({_NAMES}, {name})"
    return F.expr(f"cast(if({at} > 0, {at} + {_FIRST - 1}, "
                  f"try_cast(nullif(regexp_extract({name}, '^UNKNOWN_(-?[0-9]+)$', 1), '') as bigint)) as int)")


def is_send_like(code: str = "call_code") -> Column:
    return F.expr(f"{code} in ({_values(S.SEND_LIKE)})")


def is_recv_like(code: str = "call_code") -> Column:
    return F.expr(f"{code} in ({_values(S.RECV_LIKE)})")


def is_completion(code: str = "call_code") -> Column:
    return F.expr(f"{code} in ({_values(S.COMPLETION)})")


def is_sync(code: str = "call_code") -> Column:
    return F.expr(f"{code} in ({_values(S.SYNC)})")


def is_rooted(code: str = "call_code") -> Column:
    return F.expr(f"{code} in ({_values(S.ROOTED)})")


def is_global(code: str = "call_code") -> Column:
    return F.expr(f"{code} in ({_values(S.GLOBAL)})")


def is_collective(code: str = "call_code") -> Column:
    return F.expr(f"{code} in ({_values(S.ROOTED + S.GLOBAL)})")


def is_barrier(code: str = "call_code") -> Column:
    return F.expr(f"{code} = {S.BARRIER}")


_SMALL = f"""case when {{0}} in ({_values(S.COMPLETION)}) then 'completion'
  when {{0}} in ({_values(S.SYNC)}) then 'synchronisation'
  when {{0}} in ({S.BCAST}, {S.REDUCE}, {S.ALLREDUCE}) then 'collective' else 'point-to-point' end"""
_LARGE = f"concat(if({{0}} = {S.SENDRECV}, 'sendrecv_part_', 'collective_part_'), {{1}})"


def small_category(code: str = "call_code") -> Column:
    return F.expr(_SMALL.format(code))


def large_category(code: str = "call_code", part: str = "part") -> Column:
    return F.expr(_LARGE.format(code, part))


def category(code: str = "call_code", part: str = "part") -> Column:
    return F.expr(f"if({part} = 0, {_SMALL.format(code)}, {_LARGE.format(code, part)})")


def visual_category(code: str = "call_code") -> Column:
    """Display family; unlike ``small_category`` a barrier is a collective here."""
    return F.expr(f"""case when {code} in (13, 14, 15, 16, 17, 23) then 'p2p_block'
      when {code} in (18, 19, 20, 21, 22) then 'p2p_nonblock'
      when {code} in ({_values(S.COMPLETION)}) then 'state'
      when {code} in ({_values(S.ROOTED + S.GLOBAL)}, {S.BARRIER}) then 'collective'
      when {code} in ({S.INIT}, {S.FINALIZE}) then 'lifecycle' else 'unknown' end""")


def lingers(code: str = "call_code") -> Column:
    """Calls that stay visible for the longer of the two activity windows."""
    return F.expr(f"{code} in ({_values(S.ROOTED + S.GLOBAL + S.SYNC)})")


def is_real_payload() -> Column:
    return F.expr("bytes > 0 and not synthetic_empty")


def is_canonical_transfer() -> Column:
    """One row per transfer: each kind of call is counted on a single side only."""
    return F.expr(f"""bytes > 0 and not synthetic_empty and (
      call_code in ({_values(S.SEND_LIKE)}) or (call_code = {S.SENDRECV} and part = 1)
      or (sender <> receiver and (call_code in ({S.BCAST}, {S.REDUCE})
          or (call_code = {S.GATHER} and part = 1) or (call_code = {S.SCATTER} and part = 2))))""")


def collective_root(code: str = "call_code") -> Column:
    return F.expr(f"""case when {code} in ({S.BCAST}, {S.SCATTER}) then sender
      when {code} in ({S.REDUCE}, {S.GATHER}) then receiver end""")


# --- text --------------------------------------------------------------------

def cstr(text) -> Column:
    """Text before the first NUL."""
    return F.substring_index(_col(text), "\x00", 1)


def short_call(call) -> Column:
    return F.replace(_col(call), F.lit("MPI_"), F.lit(""))


def _fixed(value: str, digits: int, ties: str = "even") -> str:
    v = f"cast({value} as double)"
    x = f"abs({v})"
    scale = 10 ** digits
    k = f"cast(floor({x} * {scale}D) as double)"
    high = f"({x} * 134217729D - ({x} * 134217729D - {x}))"
    above = f"(({high} * {2 * scale}D - ({k} * 2 + 1)) + ({x} - {high}) * {2 * scale}D)"
    tie = "true" if ties == "up" else f"pmod({k}, 2D) = 1D"
    rounded = f"({k} + if({above} > 0 or ({above} = 0 and {tie}), 1D, 0D)) / {scale}D"
    return (f"if({x} < {10 ** (12 - digits)}D, concat(if({v} < 0, '-', ''), "
            f"format_string('%.{digits}f', {rounded})), format_string('%.{digits}f', {v}))")


def fixed(value: str, digits: int, ties: str = "even") -> Column:
    """Fixed-point text of a double expression, rounded on its exact binary value.

    Spark formats the shortest decimal of a double, which rounds 0.15 up although the stored
    value is below the tie. The sign of ``x * 2 * 10^d - (2k + 1)`` is evaluated without
    rounding error by splitting x into two halves, and exact ties go to the even neighbour or
    up. Values too large for that split have no fraction left to round.
    """
    return F.expr(_fixed(value, digits, ties))


def percent(ratio: str) -> Column:
    """A ratio as a percentage with one digit."""
    return F.expr(f"concat({_fixed(f'{ratio} * 100D', 1)}, '%')")


def format_bytes(n: str) -> Column:
    """Size in 1024 steps up to TB: no digits for bytes, else two, one or none by magnitude.

    A size over a power of two times at most 100 is exact, so halves can be rounded up directly.
    """
    value = f"coalesce(cast({n} as double), 0D)"
    size = f"abs({value})"
    branches = [f"when {size} < 1024 then format_string('%.0f B', floor({size} + 0.5D) * 1D)"]
    for i, unit in enumerate(["KB", "MB", "GB", "TB"], start=1):
        scaled = f"{size} / {1024 ** i}D"
        for limit, digits in ((10, 2), (100, 1), (1024 if unit != "TB" else None, 0)):
            text = f"format_string('%.{digits}f {unit}', floor({scaled} * {10 ** digits} + 0.5D) / {10 ** digits}D)"
            branches.append(f"when {scaled} < {limit} then {text}" if limit else f"else {text}")
    return F.expr(f"concat(if({value} < 0, '-', ''), case {' '.join(branches)} end)")


def format_time(seconds: str) -> Column:
    """Duration in the unit that suits its magnitude."""
    s = f"coalesce(cast({seconds} as double), 0D)"
    steps = [("1e-9D", "", 3, "s"), ("1e-6D", " * 1e9D", 1, "ns"), ("1e-3D", " * 1e6D", 1, "µs"),
             ("1D", " * 1e3D", 2, "ms"), ("60D", "", 3, "s")]
    branches = " ".join(f"when abs({s}) < {edge} then concat({_fixed(f'({s}{factor})', d, 'up')}, ' {unit}')"
                        for edge, factor, d, unit in steps)
    return F.expr(f"case {branches} else concat({_fixed(f'({s} / 60D)', 2, 'up')}, ' min') end")


def heat(n, biggest) -> Column:
    """Colour intensity: 0 for nothing, otherwise the share with a floor of 0.15."""
    return F.when(_col(n) == 0, F.lit(0.0)) \
            .otherwise(F.greatest(F.lit(0.15), safe_div(n, biggest)))


def link_weight(n) -> Column:
    return F.lit(1.0) + F.log10(_col(n))


def expand_hostlist(text) -> Column:
    """Host names of ``prefix[a-b,c]``; only the first bracket counts, zero-padded like ``a``."""
    t = _col(text)
    pattern = r"([^\[\]]+)\[([^\[\]]+)\]"
    prefix, body = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)

    def item(r: Column) -> Column:
        first, last = F.split_part(r, F.lit("-"), F.lit(1)), F.split_part(r, F.lit("-"), F.lit(2))
        low, high = first.cast("long"), last.cast("long")
        numbers = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        padded = F.transform(numbers, lambda i: F.concat(
            prefix, F.lpad(i.cast("string"),
                           F.greatest(F.length(first), F.length(i.cast("string"))), F.lit("0"))))
        return F.when(F.contains(r, F.lit("-")), padded) \
                .otherwise(F.array(F.concat(prefix, r)))

    expanded = F.flatten(F.transform(F.split(body, ","), item))
    return F.when(F.length(body) > 0, expanded).otherwise(F.split(t, ","))


def escape_tag(text) -> Column:
    """Backslash before comma, space and equals sign; line breaks dropped."""
    for old, new in (("\r", ""), ("\n", ""), (",", "\\,"), (" ", "\\ "), ("=", "\\=")):
        text = F.replace(_col(text), F.lit(old), F.lit(new))
    return text


def unescape_tag(text) -> Column:
    # What one replacement leaves is never the pair of a later one.
    for mark in ", =":
        text = F.replace(_col(text), F.lit(f"\\{mark}"), F.lit(mark))
    return text


def to_ms(seconds) -> Column:
    """Whole milliseconds, truncated towards zero."""
    return (_col(seconds) * 1000).cast("long")
