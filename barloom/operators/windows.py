"""Trailing-window analytics per symbol. Windows count observations, not days; a short window is null."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.asof import latest_values


def by_date():
    return Window.partitionBy("symbol").orderBy("trade_date")


def change_pct(n: int = 1) -> Column:
    """Return over n observations in percent; needs n + 1 of them, and a positive start."""
    start = F.lag("close", n).over(by_date())
    return F.when(start > 0, (F.col("close") / start - 1) * 100)


class Spans:
    """Aggregates over the last n rows of each symbol, for any n, from those over the last 1, 2, 4, 8, ... rows.

    Each doubling joins a row's span to the one that ends where it begins, by ``lag``; a span of n rows is
    joined from the powers of two in n. So a row costs the logarithm of the window, not the window, nothing
    is subtracted (sums stay exact to the last bits), and all stages share one shuffle and one sort."""

    def __init__(self, rows: DataFrame, one: dict[str, Column], joined: dict[str, Callable[[dict[str, Column], dict[str, Column]], Column]]) -> None:
        self.joined, self.rows = joined, rows.select("*", *(c.alias(f"{k}__1") for k, c in one.items()))

    def _at(self, names: list[str], n: int, back: int = 0) -> dict[str, Column]:
        return {k: F.lag(f"{k}__{n}", back).over(by_date()) if back else F.col(f"{k}__{n}") for k in names}

    def grow(self, wanted: dict[str, Iterable[int]]) -> DataFrame:
        """The rows with columns ``name__n`` for each n that is wanted of a name; null where there are fewer rows."""
        parts = {n: [1 << k for k in range(n.bit_length()) if n >> k & 1] for ns in wanted.values() for n in ns}
        top = {k: max((parts[n][-1] for n in ns), default=1) for k, ns in wanted.items()}
        half = 1
        while half < max(top.values(), default=1):
            names = [k for k, t in top.items() if t > half]
            earlier, later = self._at(names, half, half), self._at(names, half)
            self.rows = self.rows.select("*", *(self.joined[k](earlier, later).alias(f"{k}__{2 * half}") for k in names))
            half *= 2
        for step in range(1, max(map(len, parts.values()), default=1)):
            # of a window's powers, greatest last: the span so far, then the next power before it
            more = []
            for n, powers in parts.items():
                names = [k for k, ns in wanted.items() if n in ns]
                if len(powers) > step:
                    done = sum(powers[-step:])
                    so_far = self._at(names, done) if step == 1 else {k: F.col(f"{k}__{n}_{step}") for k in names}
                    name = f"__{n}" if step == len(powers) - 1 else f"__{n}_{step + 1}"
                    more += [self.joined[k](self._at(names, powers[-step - 1], done), so_far).alias(k + name) for k in names]
            self.rows = self.rows.select("*", *more)
        return self.rows


ADD = lambda name: lambda earlier, later: earlier[name] + later[name]
DRAWDOWN = {
    "top": lambda a, z: F.when(a["top"].isNotNull(), F.greatest(a["top"], z["top"])),
    "low": lambda a, z: F.when(a["low"].isNotNull(), F.least(a["low"], z["low"])),
    "fall": lambda a, z: F.when(a["fall"].isNotNull(), F.least(a["fall"], z["fall"], F.coalesce(F.try_divide(z["low"], a["top"]) - 1, F.lit(0.0)) * 100)),
}


def drawdown_of(closes: Column) -> Column:
    """Largest fall in percent from the running peak of an array; never positive."""
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(s: Column, c: Column) -> Column:
        peak = F.greatest(s["peak"], c)
        return F.struct(peak.alias("peak"), F.least(s["worst"], F.coalesce(F.try_divide(c, peak) - 1, F.lit(0.0)) * 100).alias("worst"))

    return F.aggregate(closes, start, step, lambda s: s["worst"])


def panel(bars: DataFrame, windows: tuple[int, ...] = (20, 60, 120, 250), volatility_window: int = 60, drawdowns: tuple[int, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Indicators of every symbol on every date.

    Volatility is the population deviation of the last daily returns, not annualised, from two of them on.
    ``drawdowns`` asks for the largest fall inside the last n observations as well, and ``keep`` for columns of the bars."""
    rows = bars.select("symbol", "trade_date", "close", "volume", *(c for c in keep if c not in ("close", "volume")), *(change_pct(n).alias(f"return_{n}d") for n in (1, *windows)))
    daily = F.col("return_1d") / 100
    returns = {"r": F.coalesce(daily, F.lit(0.0)), "rr": F.coalesce(daily * daily, F.lit(0.0)), "k": daily.isNotNull().cast("long")}
    start = {"close": F.col("close"), "volume": F.col("volume").cast("double"), **returns}
    join = {k: ADD(k) for k in start}
    if drawdowns:
        start |= {"top": F.col("close"), "low": F.col("close"), "fall": F.lit(0.0)}
        join |= DRAWDOWN
    # before the window is full, volatility is that of all rows so far
    so_far = [F.sum(c).over(by_date().rowsBetween(Window.unboundedPreceding, 0)).alias(f"{k}_so_far") for k, c in returns.items()]
    wanted = {"close": windows, "volume": (20,)} | dict.fromkeys(returns, (volatility_window,)) | dict.fromkeys(DRAWDOWN if drawdowns else (), drawdowns)
    spans = Spans(rows.select("*", *so_far), start, join).grow(wanted)
    out = {"return_1d": F.col("return_1d")}
    for n in windows:
        average = F.col(f"close__{n}") / n
        out |= {f"return_{n}d": F.col(f"return_{n}d"), f"ma_{n}": average, f"ma_distance_{n}d": (F.try_divide(F.col("close"), average) - 1) * 100}
    volume = F.col("volume__20") / 20
    ratio = F.try_divide(F.col("volume"), volume)
    total, squares, seen = (F.coalesce(f"{k}__{volatility_window}", f"{k}_so_far") for k in returns)
    variance = squares / seen - (total / seen) * (total / seen)
    out |= {
        "volume_avg_20": volume,
        "volatility_60d": F.when(seen >= 2, F.sqrt(F.greatest(variance, F.lit(0.0))) * 100),
        "volatility_observations": seen,
        "volume_ratio_20d": ratio,
        "volume_state": volume_state(ratio),
    }
    out |= {f"max_drawdown_{n}d": F.col(f"fall__{n}") for n in drawdowns}
    return spans.select("symbol", "trade_date", *keep, *(c.alias(k) for k, c in out.items()))


def volume_state(ratio: Column) -> Column:
    return F.when(ratio.isNull(), "insufficient").when(ratio >= 2, "high").when(ratio <= 0.5, "low").otherwise("normal")


def drawdowns(bars: DataFrame, windows: tuple[int, ...] = (20, 60, 120, 250)) -> DataFrame:
    """Largest fall in percent from a running peak inside the last n observations, on every date."""
    rows = bars.select("symbol", "trade_date", "close")
    spans = Spans(rows, {"top": F.col("close"), "low": F.col("close"), "fall": F.lit(0.0)}, DRAWDOWN).grow(dict.fromkeys(DRAWDOWN, windows))
    return spans.select("symbol", "trade_date", *(F.col(f"fall__{n}").alias(f"max_drawdown_{n}d") for n in windows))


def whole_history(bars: DataFrame) -> DataFrame:
    """Descriptive risk of each symbol over all its bars; volatility is annualised (252 days), from the population deviation."""
    running = F.max("close").over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    rows = bars.select("symbol", "trade_date", "close", "volume", (change_pct(1) / 100).alias("daily"), (F.try_divide(F.col("close"), running) - 1).alias("fall"))
    first, final = F.min_by("close", "trade_date"), F.max_by("close", "trade_date")
    several = F.count("daily") >= 2
    return rows.groupBy("symbol").agg(
        F.count("*").alias("observations"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"),
        first.alias("first_close"), final.alias("last_close"), F.min("close").alias("min_close"), F.max("close").alias("max_close"),
        ((final / first - 1) * 100).alias("total_return_pct"), (F.coalesce(F.avg("daily"), F.lit(0.0)) * 100).alias("mean_daily_return_pct"),
        F.when(several, F.stddev_pop("daily") * 252**0.5 * 100).otherwise(0.0).alias("annualized_volatility_pct"),
        (F.min("fall") * 100).alias("max_drawdown_pct"), F.avg("volume").alias("mean_volume"),
    )


def summary(bars: DataFrame, metrics: DataFrame) -> DataFrame:
    """What a reader is shown: figures to two decimals, and the latest value of each ratio."""
    shown = whole_history(bars).select("symbol", "observations", *(F.round(c, 2).alias(c) for c in ("last_close", "total_return_pct", "annualized_volatility_pct", "max_drawdown_pct")))
    latest = latest_values(metrics)
    wide = latest.groupBy("symbol").pivot("name", ["price_earnings_ratio", "price_to_book_ratio", "dividend_yield_pct"]).agg(F.round(F.first("value"), 2))
    return shown.join(wide, "symbol", "left")
