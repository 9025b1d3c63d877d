"""Roll a fitted model forward, all symbols of a task at once (family F).

``IndicatorState`` holds what the 52 indicators need of a series and is advanced by
one bar: ring buffers of the last values, running sums of the long windows, the
EWM values, and short rings of derived indicators that are compared with their
own past. Every array has one entry per series, so a bar of a thousand symbols is a few
hundred numpy operations. Feeding a tail bar by bar gives the same values as the
training windows over that tail.

``shortcut_features`` is the other definition of a step, from the last closes,
highs, lows and volumes alone: population deviations, cumulative short returns, a
signal line of 0.85 times MACD. ``forecast_rolling`` takes either.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.operators.indicators import EWMS, FEATURE_COLS
from candela.operators.snapshot import tail_rows

CLIP = 0.15
HISTORY = 300          # bars behind the first step: the longest look-back (252) and a settled EWM
SHORT_HISTORY = 80     # the same for the shortcut features
BAR = ["open", "high", "low", "close", "volume"]
NAN = np.nan


def _nz(x: np.ndarray) -> np.ndarray:
    return np.where(x == 0, NAN, x)


def _or(x: np.ndarray, default: float) -> np.ndarray:
    return np.where(np.isnan(x), default, x)


class Ring:
    """The last ``size`` values of every series; NaN before a series began."""

    def __init__(self, size: int, n: int):
        self.buf, self.at = np.full((size, n), NAN), 0

    def push(self, x: np.ndarray) -> None:
        self.buf[self.at % len(self.buf)] = x
        self.at += 1

    def lag(self, k: int) -> np.ndarray:
        """The value ``k`` pushes before the newest (0: the newest)."""
        return self.buf[(self.at - 1 - k) % len(self.buf)]

    def last(self, w: int) -> np.ndarray:
        """The newest ``w`` values, in no particular order."""
        size = len(self.buf)
        return self.buf if w == size else self.buf[(self.at - 1 - np.arange(w)) % size]

    def mean(self, w: int) -> np.ndarray:
        """NaN while any of the ``w`` values is missing."""
        return self.last(w).sum(0) / w

    def deviation(self, w: int) -> np.ndarray:
        x = self.last(w)
        return np.sqrt(((x - x.sum(0) / w) ** 2).sum(0) / (w - 1))


class RunningMean:
    """Mean of the last ``w`` values from a running sum, fed by a ring of at least that size."""

    def __init__(self, ring: Ring, w: int):
        self.ring, self.w, self.total = ring, w, np.zeros(ring.buf.shape[1])

    def push(self, x: np.ndarray) -> None:
        """Before the ring takes ``x``."""
        old = self.ring.lag(self.w - 1)
        self.total += x - np.where(np.isnan(old), 0.0, old)

    def value(self, age: np.ndarray) -> np.ndarray:
        return np.where(age >= self.w, self.total / self.w, NAN)


class IndicatorState:
    """Indicator state of ``n`` series; ``advance`` adds one bar to each, ``features`` gives the columns of the newest."""

    def __init__(self, n: int):
        self.age = np.zeros(n, np.int64)
        ring = lambda size: Ring(size, n)
        self.close, self.high, self.low, self.volume = ring(252), ring(14), ring(14), ring(50)
        self.typical, self.change, self.gain, self.loss, self.range, self.up, self.down = (
            ring(20), ring(20), ring(21), ring(21), ring(14), ring(14), ring(14))
        self.stoch, self.rsi14, self.atr14, self.macd = ring(3), ring(6), ring(14), ring(4)
        self.s20, self.s50 = ring(6), ring(6)
        self.close_mean = {w: RunningMean(self.close, w) for w in (50, 100)}
        self.volume_mean = RunningMean(self.volume, 50)
        self.ewm = {k: np.full(n, NAN) for k in (*EWMS, "_sig")}
        self.open = np.full(n, NAN)

    def restart(self, which: np.ndarray) -> None:
        """Forget everything of the series in the mask ``which``: their next bar is their first."""
        if not which.any():
            return
        for x in vars(self).values():
            for y in x.values() if isinstance(x, dict) else [x]:
                if isinstance(y, Ring):
                    y.buf[:, which] = NAN
                elif isinstance(y, RunningMean):
                    y.total[which] = 0.0
                else:
                    y[which] = 0 if y is self.age else NAN

    def _smooth(self, name: str, span: int, x: np.ndarray) -> None:
        a, y = 2.0 / (span + 1.0), self.ewm[name]
        self.ewm[name] = np.where(np.isnan(y), x, a * x + (1 - a) * y)

    def _rsi(self, p: int) -> np.ndarray:
        return _or(100 - 100 / (1 + self.gain.mean(p) / _nz(self.loss.mean(p))), 50.0)

    def advance(self, open_: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            before, high1, low1 = (r.lag(0).copy() for r in (self.close, self.high, self.low))
            self.age += 1
            step = close - before
            for mean in self.close_mean.values():
                mean.push(close)
            self.volume_mean.push(volume)
            for r, x in ((self.close, close), (self.high, high), (self.low, low), (self.volume, volume),
                         (self.typical, (high + low + close) / 3), (self.change, np.log(close / _nz(before))),
                         (self.gain, np.where(step > 0, step, 0.0)), (self.loss, np.where(step < 0, -step, 0.0)),
                         (self.range, np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))),
                         (self.up, np.maximum(high - high1, 0)), (self.down, np.maximum(low1 - low, 0))):
                r.push(x)
            self.open = open_
            for name, span in EWMS.items():
                self._smooth(name, span, close)
            macd = (self.ewm["_e12"] - self.ewm["_e26"]) / _nz(close)
            self._smooth("_sig", 9, macd)
            top, bottom = self.high.last(14).max(0), self.low.last(14).min(0)
            for r, x in ((self.macd, macd), (self.rsi14, self._rsi(14)), (self.atr14, self.range.mean(14)),
                         (self.stoch, _or(100 * (close - bottom) / _nz(top - bottom), 50.0)),
                         (self.s20, self.close.mean(20)), (self.s50, self.close_mean[50].value(self.age))):
                r.push(x)

    def features(self) -> dict[str, np.ndarray]:
        """All columns of the newest bar; what a short series leaves undefined is 0."""
        with np.errstate(all="ignore"):
            c, high, low, volume = (r.lag(0) for r in (self.close, self.high, self.low, self.volume))
            back = self.close.lag
            sma = {w: self.close.mean(w) for w in (5, 10)} | {20: self.s20.lag(0), 50: self.s50.lag(0), 100: self.close_mean[100].value(self.age)}
            sd, e = self.close.deviation(20), self.ewm
            upper, lower = sma[20] + 2 * sd, sma[20] - 2 * sd
            vol = {w: self.change.deviation(w) for w in (5, 10, 20)}
            atr, change = self.atr14.lag(0), self.change.lag(0)
            top, bottom = self.high.last(14).max(0), self.low.last(14).min(0)
            mean_tp, v14 = self.typical.mean(20), self.volume.mean(14)
            spread = np.abs(self.typical.last(20) - mean_tp).sum(0) / 20
            whole = self.close.last(252)
            rsi = {p: self._rsi(p) for p in (7, 21)} | {14: self.rsi14.lag(0)}
            out = {
                "lr_1": change, "lr_2": self.change.lag(1), "lr_3": self.change.lag(2),
                **{f"lr_{k}": np.log(c / _nz(back(k))) / k for k in (5, 10, 20)},
                **{f"rsi_{p}": x for p, x in rsi.items()}, "rsi_diff": rsi[14] - rsi[7], "rsi_mom": rsi[14] - self.rsi14.lag(5),
                "macd": self.macd.lag(0), "macd_sig": e["_sig"], "macd_hist": self.macd.lag(0) - e["_sig"],
                "macd_mom": self.macd.lag(0) - self.macd.lag(3),
                "bb_pct": np.clip((c - lower) / _nz(upper - lower), 0, 1), "bb_width": (upper - lower) / _nz(sma[20]),
                **{f"dist_sma{w}": (c - x) / _nz(x) for w, x in sma.items()},
                "dist_ema9": (c - e["_e9"]) / _nz(e["_e9"]), "dist_ema21": (c - e["_e21"]) / _nz(e["_e21"]),
                **{f"vol_{w}d": x for w, x in vol.items()}, "rvol_20": vol[20] * math.sqrt(252), "vol_ratio": vol[10] / _nz(vol[20]),
                "atr_pct": atr / _nz(c), "atr_trend": atr / _nz(self.atr14.mean(14)),
                "stoch_k": self.stoch.lag(0), "stoch_d": self.stoch.mean(3), "stoch_diff": self.stoch.lag(0) - self.stoch.mean(3),
                "willr": _or(-100 * (top - c) / _nz(top - bottom), -50.0),
                "cci": _or(np.clip((self.typical.lag(0) - mean_tp) / (0.015 * _nz(spread)), -300, 300), 0.0),
                "adx_plus": _or(100 * self.up.mean(14) / _nz(atr), 0.0), "adx_minus": _or(100 * self.down.mean(14) / _nz(atr), 0.0),
                **{f"roc_{w}": (c / _nz(back(w)) - 1) * 100 for w in (3, 5, 10, 20)},
                "v_ratio": np.clip(volume / _nz(v14), 0, 10), "v_trend": np.clip(v14 / _nz(self.volume_mean.value(self.age)), 0, 5),
                "pv_corr": np.clip(change * (volume / _nz(v14)), -5, 5),
                "hl_pct": (high - low) / _nz(c), "open_close": (c - self.open) / _nz(c),
                "dist_52w_high": (c - whole.max(0)) / _nz(c), "dist_52w_low": (c - whole.min(0)) / _nz(c),
                "sma20_slope": (sma[20] - self.s20.lag(5)) / _nz(self.s20.lag(5)),
                "sma50_slope": (sma[50] - self.s50.lag(5)) / _nz(self.s50.lag(5)),
            }
            out["adx_diff"] = out["adx_plus"] - out["adx_minus"]
            return {k: np.where(np.isnan(x), 0.0, x) for k, x in out.items()}


class Trained:
    """Steps by the training definitions."""

    def __init__(self, tails: list[dict[str, np.ndarray]]):
        n = len(tails)
        self.state = IndicatorState(n)
        size = [len(t["close"]) for t in tails]
        most = max(size, default=0)
        lined = {c: np.full((most, n), 1.0) for c in BAR}              # shorter tails begin later
        for i, t in enumerate(tails):
            for c in BAR:
                lined[c][most - size[i]:, i] = t[c]
        begins = most - np.array(size)
        for at in range(most):
            if at:
                self.state.restart(begins == at)
            self.state.advance(*(lined[c][at] for c in BAR))

    def features(self) -> dict[str, np.ndarray]:
        return self.state.features()

    def append(self, bar: dict[str, np.ndarray]) -> None:
        self.state.advance(*(bar[c] for c in BAR))

    def last_close(self) -> np.ndarray:
        return self.state.close.lag(0)

    def usual_volume(self) -> np.ndarray:
        return np.nanmean(self.state.volume.last(5), axis=0)


# ------------------------------------------------------------------ shortcut features

def _ratio(a, b, default: float) -> np.ndarray:
    """a / b, ``default`` where b is 0."""
    return np.where(b == 0, default, a / np.where(b == 0, 1.0, b))


def shortcut_features(p: np.ndarray, high: np.ndarray, low: np.ndarray, volume: np.ndarray) -> dict[str, np.ndarray]:
    """The step definitions over (bars, series) matrices of closes, highs, lows and volumes, oldest first.

    Windows longer than the history take all of it. Fixed values: the window lengths, defaults and factors.
    """
    with np.errstate(all="ignore"):
        n, now = len(p), p[-1]
        ago = lambda k, other: p[-1 - k] if n > k else other
        last = lambda x, w: x[-min(w, n):]
        mean = lambda x, w: last(x, w).mean(0)
        one = ago(1, now)
        past = {1: one, 2: ago(2, one)} | {k: ago(k, one) for k in (5, 10, 20)}
        past[3] = ago(3, past[2])
        log_ratio = {k: np.where(x > 0, np.log(now / np.where(x > 0, x, 1.0)), 0.0) for k, x in past.items()}

        moves = np.diff(p, axis=0)

        def rsi(period: int) -> np.ndarray:
            d = moves[-(period + 1):]
            if not len(d):
                return np.full(now.shape, 50.0)
            up, down = np.maximum(d, 0).mean(0), np.maximum(-d, 0).mean(0)
            return np.where(down > 0, 100 - 100 / (1 + up / np.where(down > 0, down, 1.0)), 100.0)

        def ewm(span: int) -> np.ndarray:
            a, y = 2.0 / (span + 1.0), p[0]
            for x in p[1:]:
                y = a * x + (1 - a) * y
            return y

        smooth = {s: ewm(s) for s in (9, 12, 21, 26)}
        macd = _ratio(smooth[12] - smooth[26], now, 0.0)
        signal = 0.85 * macd
        middle = mean(p, 20)
        band = 4 * (last(p, 20).std(0) if min(20, n) > 1 else np.zeros_like(now))
        sma = {w: mean(p, w) for w in (5, 10, 20, 50, 100)}

        # The newest 21 returns, of which a volatility takes the oldest w.
        returns = np.log(p[1:] / np.where(p[:-1] > 0, p[:-1], NAN))[-21:]
        vol = {w: returns[:w].std(0) if len(returns) >= w else np.zeros_like(now) for w in (5, 10, 20)}
        span = max(min(14, n - 1), 0)
        hi, lo, before = high[n - span:], low[n - span:], p[n - span - 1:n - 1]
        true_range = np.maximum(hi - lo, np.maximum(np.abs(hi - before), np.abs(lo - before)))
        atr = true_range.mean(0) if span else np.zeros_like(now)
        top, bottom = last(high, 14).max(0), last(low, 14).min(0)
        stoch = _ratio(100 * (now - bottom), top - bottom, 50.0)

        typical = ((high + low + p) / 3)[n - max(min(20, n - 1), 0):]
        typical_now = (high[-1] + low[-1] + now) / 3
        tp_mean = typical.mean(0) if len(typical) else typical_now
        tp_dev = np.abs(typical - tp_mean).mean(0) if len(typical) else np.zeros_like(now)

        way = max(min(14, n - 2), 0)
        rise, fall = np.maximum(np.diff(high, axis=0)[n - 1 - way:], 0), np.maximum(-np.diff(low, axis=0)[n - 1 - way:], 0)
        direct = lambda x: np.where(atr > 0, _ratio(100 * x.mean(0), atr, 0.0), 0.0) if way else np.zeros_like(now)
        plus, minus = direct(rise), direct(fall)
        ref = {w: p[-w - 1] if n > w else p[0] for w in (3, 5, 10, 20)}
        v14, v50 = mean(volume, 14), mean(volume, 50)
        v_ratio = np.minimum(_ratio(volume[-1], v14, 1.0), 10.0)
        year = last(p, 252)
        older = {w: p[-w - 5:-5].mean(0) if n >= w + 5 else sma[w] for w in (20, 50)}
        r7, r14, r21 = rsi(7), rsi(14), rsi(21)
        return {
            **{f"lr_{k}": log_ratio[k] / (k if k >= 5 else 1) for k in (1, 2, 3, 5, 10, 20)},
            "rsi_7": r7, "rsi_14": r14, "rsi_21": r21, "rsi_diff": r14 - r7, "rsi_mom": r14 - r21,
            "macd": macd, "macd_sig": signal, "macd_hist": macd - signal, "macd_mom": 0.05 * macd,
            "bb_pct": _ratio(now - middle + band / 2, band, 0.5), "bb_width": _ratio(band, middle, 0.0),
            **{f"dist_sma{w}": _ratio(now - x, x, 0.0) for w, x in sma.items()},
            **{f"dist_ema{s}": _ratio(now - smooth[s], smooth[s], 0.0) for s in (9, 21)},
            **{f"vol_{w}d": x for w, x in vol.items()}, "rvol_20": vol[20] * math.sqrt(252), "vol_ratio": _ratio(vol[10], vol[20], 1.0),
            "atr_pct": _ratio(atr, now, 0.0), "atr_trend": np.ones_like(now),
            "stoch_k": stoch, "stoch_d": stoch, "stoch_diff": np.zeros_like(now),
            "willr": _ratio(-100 * (top - now), top - bottom, -50.0),
            "cci": np.clip(_ratio(typical_now - tp_mean, 0.015 * tp_dev, 0.0), -300, 300),
            "adx_plus": plus, "adx_minus": minus, "adx_diff": plus - minus,
            **{f"roc_{w}": _ratio(now - x, x, 0.0) * 100 for w, x in ref.items()},
            "v_ratio": v_ratio, "v_trend": np.minimum(_ratio(v14, v50, 1.0), 5.0), "pv_corr": np.clip(log_ratio[1] * v_ratio, -5, 5),
            "hl_pct": _ratio(high[-1] - low[-1], now, 0.0), "open_close": np.zeros_like(now),
            "dist_52w_high": _ratio(now - year.max(0), now, 0.0), "dist_52w_low": _ratio(now - year.min(0), now, 0.0),
            **{f"sma{w}_slope": _ratio(sma[w] - older[w], older[w], 0.0) for w in (20, 50)},
        }


class Shortcut:
    """Steps by ``shortcut_features``; tails of one length are computed together."""

    def __init__(self, tails: list[dict[str, np.ndarray]]):
        sizes = np.array([len(t["close"]) for t in tails], np.int64)
        self.n = len(tails)
        self.parts = [(at, {c: np.stack([tails[i][c] for i in at], axis=1) for c in BAR})
                      for at in (np.flatnonzero(sizes == s) for s in np.unique(sizes))]

    def _joined(self, of: Callable[[dict], np.ndarray]) -> np.ndarray:
        out = np.empty(self.n)
        for at, m in self.parts:
            out[at] = of(m)
        return out

    def features(self) -> dict[str, np.ndarray]:
        found = [shortcut_features(m["close"], m["high"], m["low"], m["volume"]) for _, m in self.parts]
        out = {}
        for c in FEATURE_COLS:
            out[c] = np.empty(self.n)
            for (at, _), f in zip(self.parts, found):
                out[c][at] = f[c]
        return out

    def append(self, bar: dict[str, np.ndarray]) -> None:
        self.parts = [(at, {c: np.concatenate([m[c], bar[c][None, at]]) for c in BAR}) for at, m in self.parts]

    def last_close(self) -> np.ndarray:
        return self._joined(lambda m: m["close"][-1])

    def usual_volume(self) -> np.ndarray:
        return self._joined(lambda m: m["volume"][-5:].mean(0))


MODES = {"train": (Trained, HISTORY), "ref": (Shortcut, SHORT_HISTORY)}


# ------------------------------------------------------------------ operators

def tails_of(series: DataFrame, history: int) -> DataFrame:
    """(symbol, d, open, ..., volume): the newest ``history`` bars of each symbol as arrays, d the newest day."""
    rows = tail_rows(series.select("symbol", "d", *BAR), history)
    listed = rows.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("d", *BAR))).alias("_b"))     # at most ``history`` bars
    return listed.select("symbol", F.element_at("_b.d", -1).alias("d"), *[F.col(f"_b.{c}").cast("array<double>").alias(c) for c in BAR])


def _tails(b: pa.RecordBatch) -> list[dict[str, np.ndarray]]:
    held = {c: b.column(b.schema.get_field_index(c)) for c in BAR}
    flat = {c: x.values.to_numpy(zero_copy_only=False) for c, x in held.items()}
    edges = held["close"].offsets.to_numpy()
    return [{c: flat[c][lo:hi] for c in BAR} for lo, hi in zip(edges, edges[1:])]


def step_features(series: DataFrame, cols: list[str], mode: str = "train", history: int | None = None) -> DataFrame:
    """(symbol, d, close, <cols>): the features of each symbol's newest bar, from its newest bars alone."""
    kind, usual = MODES[mode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                steps = kind(_tails(b))
                found = steps.features()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(steps.last_close()), *[pa.array(found[c]) for c in cols]],
                                                 ["symbol", "d", "close", *cols])

    tails = tails_of(series, history or usual)
    schema = T.StructType([*tails.schema.fields[:2], *[T.StructField(c, T.DoubleType()) for c in ("close", *cols)]])
    return tails.mapInArrow(run, schema)


def forecast_rolling(series: DataFrame, models: DataFrame, predict: Callable[[np.ndarray, dict[str, list]], np.ndarray], cols: list[str],
                     horizon: int = 14, mode: str = "train", history: int | None = None) -> DataFrame:
    """(symbol, step, d, predicted): any fitted model rolled ``horizon`` calendar days ahead, in one job.

    ``models`` holds one row per symbol; ``predict(features, model)`` gives the next log return of every row of
    ``features`` (series, cols), ``model`` the other columns of ``models`` as lists. Each step takes the features of the newest
    bar and appends the predicted one: return clipped to +-0.15, open = the last close, high +0.5 %, low -0.5 %,
    volume = mean of the last five. Symbols without a model give no rows.
    """
    kind, usual = MODES[mode]
    names = [c for c in models.columns if c != "symbol"]
    tails = tails_of(series, history or usual)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            model = {c: b.column(b.schema.get_field_index(f"_m_{c}")).to_pylist() for c in names}
            steps, out = kind(_tails(b)), []
            for _ in range(horizon):
                found = steps.features()
                change = np.clip(predict(np.column_stack([found[c] for c in cols]), model), -CLIP, CLIP)
                last = steps.last_close().copy()
                close = last * np.exp(change)
                steps.append({"open": last, "high": close * 1.005, "low": close * 0.995, "close": close, "volume": steps.usual_volume()})
                out.append(close)
            made = np.column_stack(out)
            edges = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * horizon)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(edges, pa.array(made.ravel()))], ["symbol", "d", "path"])

    joined = tails.join(models.select("symbol", *[F.col(c).alias(f"_m_{c}") for c in names]), "symbol")
    schema = T.StructType([*tails.schema.fields[:2], T.StructField("path", T.ArrayType(T.DoubleType()))])
    paths = joined.mapInArrow(run, schema).select("symbol", "d", F.posexplode("path").alias("i", "predicted"))
    return paths.select("symbol", (F.col("i") + 1).alias("step"), F.date_add("d", F.col("i") + 1).alias("d"), "predicted")


def linear(features: np.ndarray, model: dict[str, list]) -> np.ndarray:
    """A linear model on robustly scaled features: columns coef, intercept, centre and width."""
    w, centre, width = (np.array(model[c], float) for c in ("coef", "centre", "width"))
    return np.array(model["intercept"], float) + ((features - centre) / width * w).sum(1)
