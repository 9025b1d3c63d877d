"""Window building blocks shared by every series operator.

Series layout
-------------
A series is all rows of one ``symbol`` ordered by a unique order key. A plain
``Window.partitionBy('symbol')`` puts a whole symbol into one task, which is a
hot spot when one symbol holds a large share of the rows. ``with_position``
and ``series_blocks`` avoid that:

* ``with_position`` numbers rows per symbol (``pos``, 0-based) and adds the
  series length ``n``. Counting is done per (symbol, time bucket) with a
  partial aggregate; offsets come from that small per-bucket table, and the
  row numbers are taken inside (symbol, bucket) partitions. No task ever
  sees a whole symbol. The bucket should hold many but boundedly many rows:
  a year for daily bars (the default), a day or an hour for intraday data.
* ``series_blocks`` cuts every series into blocks of ``part_rows`` rows
  (``_part``) and copies the ``halo`` rows before each block (and a few rows
  after it) into that block, so every look-back frame of up to ``halo`` rows
  is complete inside one partition. ``own_rows`` drops the copies again.

All rolling operators then use ``series_window()`` =
``partitionBy(symbol, _part).orderBy(_eblk, pos)``, one exchange reused by
all of them (``_eblk`` is the EWM block, monotone in ``pos``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows per series block and the look-back copied in front of each block.
# The halo covers the longest row frame (252) and the EWM block carry (below).
PART_ROWS = 1 << 20
HALO_ROWS = 4096
TAIL_ROWS = 8          # rows copied after a block, for lead() up to 8
BUCKET_DAYS = 366      # bucket for numbering daily rows (~252 bars); pass bucket_days or bucket for denser series

KEY = "symbol"
POS = "pos"
PART = "_part"
OWN = "_own"
EBLK = "_eblk"
# EWM block length shared by all spans 4..50 (see ewm_columns). It is part of
# the window order (eblk, pos) so the per-block running sums need no re-sort.
EWM_BLOCK = 1024


# --------------------------------------------------------------------------
# null-safe arithmetic helpers
# --------------------------------------------------------------------------

def nz(x: Column) -> Column:
    """``nullif(x, 0)``: a zero denominator gives null, never an error."""
    return F.when(x != 0, x)


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip that keeps null (Spark's greatest/least skip nulls)."""
    y = x
    if lo is not None:
        y = F.greatest(y, F.lit(float(lo)))
    if hi is not None:
        y = F.least(y, F.lit(float(hi)))
    return F.when(x.isNotNull(), y)


# --------------------------------------------------------------------------
# positions and blocks
# --------------------------------------------------------------------------

def with_position(df: DataFrame, order: list[str] | None = None, key: str = KEY,
                  time_col: str = "d", bucket_days: int = BUCKET_DAYS,
                  bucket: Column | None = None) -> DataFrame:
    """Add ``pos`` (0-based row number per key in ``order``) and ``n``.

    ``order`` must be unique within a key; its first column is ``time_col``
    (a DATE or TIMESTAMP) which defines the counting buckets. ``bucket`` may
    instead be any column that is non-decreasing in ``order`` (for example
    an id range).
    """
    order = order or [time_col]
    if bucket is None:
        bucket = F.floor(F.unix_date(F.to_date(F.col(time_col))) / F.lit(bucket_days))
    tagged = df.withColumn("_bkt", bucket)
    counts = tagged.groupBy(key, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    wk = Window.partitionBy(key).orderBy("_bkt")
    offsets = (counts
               .withColumn("_off", F.sum("_cnt").over(wk.rowsBetween(Window.unboundedPreceding, -1)))
               .withColumn("n", F.sum("_cnt").over(Window.partitionBy(key)))
               .select(key, "_bkt", F.coalesce("_off", F.lit(0)).alias("_off"), "n"))
    wb = Window.partitionBy(key, "_bkt").orderBy(*order)
    return (tagged.join(offsets, [key, "_bkt"])
            .withColumn(POS, (F.col("_off") + F.row_number().over(wb) - 1).cast("long"))
            .drop("_bkt", "_off"))


def series_blocks(df: DataFrame, part_rows: int = PART_ROWS, halo: int = HALO_ROWS,
                  tail: int = TAIL_ROWS) -> DataFrame:
    """Assign ``_part`` blocks with halo copies; needs ``pos``."""
    own = F.floor(F.col(POS) / part_rows)
    off = F.col(POS) % part_rows
    parts = F.array_compact(F.array(
        own,
        F.when(off >= part_rows - halo, own + 1),
        F.when((off < tail) & (own > 0), own - 1),
    ))
    return (df.withColumn(PART, F.explode(parts))
            .withColumn(OWN, F.col(PART) == own)
            .withColumn(EBLK, F.floor(F.col(POS) / EWM_BLOCK)))


def own_rows(df: DataFrame) -> DataFrame:
    """Drop halo copies made by ``series_blocks``."""
    return df.filter(F.col(OWN)).drop(PART, OWN, EBLK)


_SPECS: dict = {}


def _spec(kind: str, key: str, a=None, b=None):
    """Window specs are JVM objects; build each once per SparkContext."""
    from pyspark import SparkContext
    ck = (id(SparkContext._active_spark_context), kind, key, a, b)
    if ck not in _SPECS:
        w = Window.partitionBy(key, PART).orderBy(EBLK, POS)
        if kind == "rows":
            w = w.rowsBetween(a, b)
        _SPECS[ck] = w
    return _SPECS[ck]


def series_window(key: str = KEY) -> Window:
    return _spec("plain", key)


def R(n: int, key: str = KEY) -> Window:
    """Trailing frame of n rows ending at the current row, at most as many as the halo of a block."""
    _checked(n, HALO_ROWS, "frame")
    return _spec("rows", key, -(n - 1), 0)


def full(n: int, e: Column, agg, key: str = KEY, first_valid: int | None = None) -> Column:
    """Rolling aggregate that is null until n non-null values are in the frame.

    This is pandas ``rolling(n).agg()``: Spark frames are never "short".
    When ``e`` is known to be non-null from position ``first_valid`` on (a
    dense column), the frame is full exactly when pos >= first_valid + n - 1
    and the extra count frame is skipped.
    """
    frame = R(n, key)
    if first_valid is not None:
        return F.when(F.col(POS) >= first_valid + n - 1, agg(e).over(frame))
    return F.when(F.count(e).over(frame) == n, agg(e).over(frame))


def lag(e: Column | str, k: int = 1, key: str = KEY) -> Column:
    return F.lag(e, k).over(series_window(key))


def _checked(k: int, most: int, what: str) -> int:
    if k > most:
        raise ValueError(f"{what} of {k} rows exceeds the {most} rows copied around a block; widen series_blocks")
    return k


def lead(e: Column | str, k: int = 1, key: str = KEY) -> Column:
    """Value ``k`` rows ahead, at most as many as ``series_blocks`` copies after a block."""
    _checked(k, TAIL_ROWS, "lead")
    return F.lead(e, k).over(series_window(key))


# --------------------------------------------------------------------------
# exponentially weighted mean (pandas ewm(span, adjust=False), no UDF)
# --------------------------------------------------------------------------

def ewm_block_rows(span: float) -> int:
    """Power-of-two block length so the dropped history weighs < e^-40 and
    r^-B stays far from overflow; the shared EWM_BLOCK when it fits."""
    r = 1.0 - 2.0 / (span + 1.0)
    if r <= 0:
        return 1
    need = 40.0 / -math.log(r)
    if need <= EWM_BLOCK and -math.log(r) * EWM_BLOCK <= 600:
        return EWM_BLOCK
    b = 1
    while b < need:
        b *= 2
    return b


def _ewm_r(span: float) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def _win(key: str = KEY, frame: str = "", extra_part: str = "") -> str:
    """SQL text of the shared series window (optionally with a row frame)."""
    return (f"OVER (PARTITION BY {key}, {PART}{extra_part} ORDER BY {EBLK}, {POS}"
            + (f" {frame})" if frame else ")"))


def _d(x: float) -> str:
    """A double literal in Spark SQL (plain decimals would be DECIMAL)."""
    return f"{float(x)!r}D"


def full_sql(n: int, e: str, agg: str, first_valid: int | None = None, key: str = KEY) -> str:
    """SQL text of ``full`` (pandas rolling(n)): used where a whole layer of
    expressions is handed to ``selectExpr`` in one call."""
    w = _win(key, f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")
    if first_valid is not None:
        return f"CASE WHEN {POS} >= {first_valid + n - 1} THEN {agg}({e}) {w} END"
    return f"CASE WHEN count({e}) {w} = {n} THEN {agg}({e}) {w} END"


def lag_sql(e: str, k: int = 1, key: str = KEY) -> str:
    return f"lag({e}, {k}) {_win(key)}"


def lead_sql(e: str, k: int = 1, key: str = KEY) -> str:
    _checked(k, TAIL_ROWS, "lead")
    return f"lead({e}, {k}) {_win(key)}"


_OFF = f"CAST({POS} % {EWM_BLOCK} AS DOUBLE)"


def ewm_sums(specs: dict[str, tuple[str, float]], key: str = KEY) -> dict[str, str]:
    """Step 1 of the EWM: running sums inside EWM blocks (``<name>__run``).

    y0 = x0, y_t = a*x_t + (1-a)*y_{t-1}, a = 2/(span+1), r = 1-a. The series
    is cut into blocks of B = EWM_BLOCK rows (they nest inside the
    ``series_blocks`` partitions and halo). Inside a block starting at b0
    y_t = r^(t-b0) * (sum_{b0<=i<=t} w_i x_i r^-(i-b0) + r * y_{b0-1})
    with w_0 = 1 at the series start and w_i = a otherwise; y_{b0-1} is
    carried from the previous block's last row (steps 3-4). Older history
    weighs r^B < e^-40 and is dropped. Inputs (SQL text) must be non-null
    from the series start. All JVM-side window sums, no UDF.
    """
    out = {}
    frame = _win(key, "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", extra_part=f", {EBLK}")
    for name, (x, span) in specs.items():
        if ewm_block_rows(span) != EWM_BLOCK:
            raise ValueError(f"span {span} needs its own block length; use ewm_columns")
        a, r = 2.0 / (span + 1.0), _ewm_r(span)
        out[f"{name}__run"] = (f"sum(({x}) * CASE WHEN {POS} = 0 THEN 1.0D ELSE {_d(a)} END "
                               f"* power({_d(r)}, -{_OFF})) {frame}")
    return out


def ewm_locals(names: list[str], spans: list[float]) -> dict[str, str]:
    return {f"{n}__loc": f"{n}__run * power({_d(_ewm_r(s))}, {_OFF})" for n, s in zip(names, spans)}


def ewm_carries(names: list[str], key: str = KEY) -> dict[str, str]:
    prev = _win(key, "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    end = f"{POS} % {EWM_BLOCK} = {EWM_BLOCK - 1}"
    return {f"{n}__carry": f"coalesce(last(CASE WHEN {end} THEN {n}__loc END, true) {prev}, 0.0D)"
            for n in names}


def ewm_finals(names: list[str], spans: list[float]) -> dict[str, str]:
    return {n: f"{n}__loc + power({_d(_ewm_r(s))}, {_OFF} + 1) * {n}__carry" for n, s in zip(names, spans)}


def layer(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Add SQL-text columns in one ``selectExpr`` (one parse, one plan node
    per window spec) - much cheaper to build than column-by-column calls."""
    return df.selectExpr("*", *[f"{e} AS {k}" for k, e in cols.items()])


def ewm_columns(df: DataFrame, specs: dict[str, tuple[str, float]], key: str = KEY) -> DataFrame:
    """Add EWM columns ``{out: (input_col, span)}`` to a ``series_blocks`` frame.

    Spans 4..50 use the shared block (ewm_sums ... ewm_finals); other spans
    get their own power-of-two block column (one extra sort).
    """
    shared = {o: (f"`{src}`", s) for o, (src, s) in specs.items() if ewm_block_rows(s) == EWM_BLOCK}
    if shared:
        names, spans = list(shared), [s for _, s in shared.values()]
        df = layer(df, ewm_sums(shared, key))
        df = layer(df, ewm_locals(names, spans))
        df = layer(df, ewm_carries(names, key))
        df = layer(df, ewm_finals(names, spans))
        df = df.drop(*[f"{n}__{p}" for n in names for p in ("run", "loc", "carry")])
    for out, (src, span) in specs.items():
        if out in shared:
            continue
        b = ewm_block_rows(span)
        if b > HALO_ROWS // 2:
            raise ValueError(f"span too long for halo: block {b}")
        r = _ewm_r(span)
        a = 1.0 - r
        bcol = f"_eblk{b}"
        off = (F.col(POS) % b).cast("double")
        wblk = (Window.partitionBy(key, PART, bcol).orderBy(EBLK, POS)
                .rowsBetween(Window.unboundedPreceding, 0))
        wt = F.when(F.col(POS) == 0, F.lit(1.0)).otherwise(F.lit(a))
        df = df.withColumn(bcol, F.floor(F.col(POS) / b))
        df = df.withColumn("_run", F.sum(F.col(src) * wt * F.pow(F.lit(r), -off)).over(wblk))
        df = df.withColumn("_loc", F.col("_run") * F.pow(F.lit(r), off))
        wprev = series_window(key).rowsBetween(Window.unboundedPreceding, -1)
        carry = F.coalesce(F.last(F.when((F.col(POS) % b) == b - 1, F.col("_loc")), True).over(wprev),
                           F.lit(0.0))
        df = df.withColumn(out, F.col("_loc") + F.pow(F.lit(r), off + 1) * carry)
        df = df.drop(bcol, "_run", "_loc")
    return df


# --------------------------------------------------------------------------
# as-of join (Spark SQL has no ASOF JOIN)
# --------------------------------------------------------------------------

def asof_join(left: DataFrame, right: DataFrame, by: str, left_t: str, right_t: str,
              value_cols: list[str], direction: str = "backward",
              left_order: list[str] | None = None, right_order: list[str] | None = None, bucket_seconds: int = 86400) -> DataFrame:
    """Attach to each left row the right row nearest in time within ``by``, at any time resolution.

    backward: last right row with right_t <= left_t; forward: first right row with right_t >= left_t; right rows of one
    time go by ``right_order``. Both sides are cut into (by, bucket of ``bucket_seconds``) and united there, and each
    left row takes the last right row of a running frame; rows before their bucket's first right row
    take the one carried in from earlier buckets, by a table of one row per (by, bucket). So a
    key holding most of the rows is as many tasks as it has buckets. Adds the right time as ``_asof_t``.
    Left rows with a null key or time stay, with nulls.
    """
    back = direction == "backward"
    bucket = lambda t: F.floor(F.unix_seconds(F.col(t).cast("timestamp")) / bucket_seconds)
    carry = F.struct(F.col(right_t).alias("_asof_t"), *[F.col(c) for c in value_cols])
    right = right.filter(F.col(by).isNotNull() & F.col(right_t).isNotNull())
    rside = right.select(F.col(by).alias("_by"), bucket(right_t).alias("_bk"), F.col(right_t).alias("_t"), F.lit(0 if back else 1).alias("_side"),
                         F.struct(*[F.col(c) for c in (right_order or value_cols)]).alias("_ro"), carry.alias("_v"))
    lside = left.select(F.col(by).alias("_by"), bucket(left_t).alias("_bk"), F.col(left_t).alias("_t"), F.lit(1 if back else 0).alias("_side"),
                        F.struct("*").alias("_row"))
    # The last (first) right row of every bucket, carried over the buckets after (before) it.
    order = F.struct("_t", "_ro")
    edge = rside.groupBy("_by", "_bk").agg((F.max_by if back else F.min_by)("_v", order).alias("_e"))
    marks = edge.unionByName(lside.filter(F.col("_by").isNotNull() & F.col("_bk").isNotNull()).select("_by", "_bk").distinct()
                             .withColumn("_e", F.lit(None).cast(edge.schema["_e"].dataType)))
    marks = marks.groupBy("_by", "_bk").agg(F.max("_e").alias("_e"))
    over = Window.partitionBy("_by").orderBy("_bk")
    over = over.rowsBetween(Window.unboundedPreceding, -1) if back else over.rowsBetween(1, Window.unboundedFollowing)
    marks = marks.withColumn("_in", (F.last if back else F.first)("_e", True).over(over)).select("_by", "_bk", "_in")
    both = lside.unionByName(rside, allowMissingColumns=True)
    # The order inside one time matters among right rows only: each left row stands behind (before) all of them.
    if back:
        w = Window.partitionBy("_by", "_bk").orderBy("_t", "_side", "_ro").rowsBetween(Window.unboundedPreceding, 0)
        near = F.last("_v", True).over(w)
    else:
        w = Window.partitionBy("_by", "_bk").orderBy(F.desc("_t"), F.desc("_side"), F.desc("_ro")).rowsBetween(Window.unboundedPreceding, 0)
        near = F.last("_v", True).over(w)
    told = both.withColumn("_near", near).filter(F.col("_row").isNotNull())
    told = told.join(marks, ["_by", "_bk"], "left").withColumn("_pick", F.when(
        F.col("_by").isNotNull() & F.col("_t").isNotNull(), F.coalesce("_near", "_in")))
    return told.select("_row.*", *[F.col("_pick")[c].alias(c) for c in value_cols], F.col("_pick._asof_t").alias("_asof_t"))


def neighbour_day(days: DataFrame, by: str, day: str, direction: str, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """``days`` with ``_near``: the next (or previous) day of the same ``by``, null at the end.

    Windows run inside (by, bucket); a bucket's edge row takes the edge of the
    next non-empty bucket from a table of one row per bucket.
    """
    fwd = direction == "next"
    tagged = days.withColumn("_bk", F.floor(F.unix_date(F.col(day)) / bucket_days))
    edge = tagged.groupBy(by, "_bk").agg((F.min if fwd else F.max)(day).alias("_edge"))
    wb, wd = Window.partitionBy(by).orderBy("_bk"), Window.partitionBy(by, "_bk").orderBy(day)
    step = F.lead if fwd else F.lag
    edge = edge.withColumn("_over", step("_edge").over(wb)).select(by, "_bk", "_over")
    near = F.coalesce(F.col("_in"), F.col("_over"))
    return tagged.withColumn("_in", step(day).over(wd)).join(edge, [by, "_bk"]).withColumn("_near", near).drop("_bk", "_in", "_over")


def asof_join_daily(left: DataFrame, right: DataFrame, left_day: str, value_cols: list[str],
                    direction: str = "backward", by: str = KEY, right_day: str = "d") -> DataFrame:
    """As-of join when the right side has at most one row per (by, day).

    Each right row is expanded to the calendar days it answers for
    (backward: [d, next d); forward: (previous d, d]) and the left side is an
    equi-join on (by, day). Left days beyond the last (backward) or before the
    first (forward) right day are moved to it, by one small row per key, so
    the left side is read once. A hot key on the left is an ordinary skewed
    equi-join (AQE splits it), and no task holds a whole key of the right.
    Adds the matched right day as ``_asof_d``.
    """
    r = right.select(by, right_day, *value_cols)
    back = direction == "backward"
    r = neighbour_day(r, by, right_day, "next" if back else "previous")
    if back:
        start, end = F.col(right_day), F.coalesce(F.date_sub("_near", 1), F.col(right_day))
        limit, move = F.max(right_day), F.least
    else:
        start, end = F.coalesce(F.date_add("_near", 1), F.col(right_day)), F.col(right_day)
        limit, move = F.min(right_day), F.greatest
    cal = (r.withColumn("_at", F.explode(F.sequence(start, end)))
           .select(by, "_at", F.col(right_day).alias("_asof_d"), *value_cols))
    limits = right.groupBy(by).agg(limit.alias("_limit"))
    moved = left.join(limits, by, "left").withColumn("_at", F.when(F.col(left_day).isNotNull(),
                                                                   move(F.col(left_day), F.col("_limit")))).drop("_limit")
    return moved.join(cal, [by, "_at"], "left").select(*[F.col(c) for c in left.columns], "_asof_d", *value_cols)


def prefix_sum_min(df: DataFrame, key: str, order: list[str], x: str, init: float = 0.0,
                   time_col: str | None = None, bucket_days: int = 1) -> DataFrame:
    """Running sum S_t = init + sum(x up to t) and the running minimum of S
    (over rows 1..t: ``_min_incl``; over rows 1..t-1: ``_min_excl``) per key.

    Two-level scan, so a key holding a large share of the rows is still cut
    into time buckets: windows run inside (key, bucket); each bucket's total
    and lowest partial sum go to a small per-bucket table whose own running
    sums give every bucket its offset and the minimum before it.
    """
    tc = time_col or order[0]
    b = df.withColumn("_bk", F.floor(F.unix_date(F.to_date(F.col(tc))) / bucket_days))
    wi = Window.partitionBy(key, "_bk").orderBy(*order)
    run = wi.rowsBetween(Window.unboundedPreceding, 0)
    prev = wi.rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("_s_in", F.sum(x).over(run))
    b = b.withColumns({"_m_in": F.min("_s_in").over(run), "_m_in_x": F.min("_s_in").over(prev)})
    per = b.groupBy(key, "_bk").agg(F.sum(x).alias("_tot"), F.min("_s_in").alias("_bmin"))
    wk = Window.partitionBy(key).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_off", F.lit(init) + F.coalesce(F.sum("_tot").over(wk), F.lit(0.0)))
    wk2 = Window.partitionBy(key).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_prevmin", F.min(F.col("_off") + F.col("_bmin")).over(wk2))
    j = b.join(per.select(key, "_bk", "_off", "_prevmin"), [key, "_bk"])
    s = F.col("_off") + F.col("_s_in")
    incl = F.least(F.col("_prevmin"), F.col("_off") + F.col("_m_in"))
    excl = F.least(F.col("_prevmin"), F.col("_off") + F.col("_m_in_x"))
    return (j.withColumns({"_S": s, "_min_incl": incl, "_min_excl": excl})
            .drop("_bk", "_s_in", "_m_in", "_m_in_x", "_off", "_prevmin"))
