"""The derived tables of one directory, and the day that screens are run for."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalar import settled
from barloom.functions.session import durable, stored
from barloom.operators import asof, first_screen, second_screen, universe
from barloom.sources import market

Query = Callable[[SparkSession, str], DataFrame]
PLACES, SETTLED = 6, 9  #: digits of floating-point results, and those that sums agree on in any order


def shown(df: DataFrame) -> DataFrame:
    """Doubles rounded to a few digits, as engines add up in different orders; without a negative zero. They are
    settled first, so that what is an exact half but for that noise is rounded as one."""
    return df.select(*((F.round(settled(F.col(c), SETTLED), PLACES) + F.lit(0.0)).alias(c) if kind == "double" else df[c] for c, kind in df.dtypes))


class Panel:
    """Bars of two sources, ratios and symbols. ``recent`` is what screens and versions need of all history: the
    last bars of each symbol up to the day, stored once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def bars(self) -> DataFrame:
        return market.bars(self.spark, self.sf_dir)

    @cached_property
    def second(self) -> DataFrame:
        return market.second_bars(self.bars)

    @cached_property
    def ratios(self) -> DataFrame:
        return market.valuations(self.bars)

    @cached_property
    def symbols(self) -> DataFrame:
        return market.symbols(self.spark, self.sf_dir)

    @cached_property
    def days(self) -> tuple:
        return market.best_dates(self.bars)

    @property
    def day(self):
        return self.days[0]

    @property
    def before(self):
        return self.days[1]

    @cached_property
    def recent(self) -> DataFrame:
        return self.lasting(second_screen.LOOKBACK)

    def at_hand(self) -> Panel:
        """This panel with its bars stored once, for what reads them several times."""
        self.bars = stored(self.bars, "bars")
        return self

    def lasting(self, n: int) -> DataFrame:
        """The last n bars of each symbol up to the day, stored once."""
        return stored(asof.last_bars(self.bars, self.day, n).drop("rn"), "last")

    def last_of_both(self, n: int) -> DataFrame:
        """The bars among the last n of each symbol up to the day (``of_day``) or to the market day before (``of_before``),
        stored once. Only one market day lies between them, so they are among the last n + 1."""
        last = asof.last_bars(self.bars, self.day, n + 1).drop("rn")
        return stored(asof.of_last_bars(last, {"of_day": self.day, "of_before": self.before}, n), "last")

    def required(self, last: DataFrame) -> DataFrame:
        """(symbol, trade_date, target_date) from ``last_of_both``."""
        targets = F.filter(F.array(F.when(F.col("of_day"), F.lit(self.day).cast("date")), F.when(F.col("of_before"), F.lit(self.before).cast("date"))), lambda d: d.isNotNull())
        return last.select("symbol", "trade_date", F.explode(targets).alias("target_date"))

    @cached_property
    def recent_second(self) -> DataFrame:
        return market.second_bars(self.recent)

    @cached_property
    def recent_ratios(self) -> DataFrame:
        return market.valuations(self.recent)

    @cached_property
    def feeds(self) -> dict[str, DataFrame]:
        return market.feeds(self.symbols, self.recent, self.day)

    def members(self) -> DataFrame:
        return universe.members(self.feeds, self.day)

    def eligible(self) -> DataFrame:
        return self.members().where("status = 'active_scan_eligible'").select("symbol", "name")

    def first(self, every: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Metrics, reasons and evaluations of the first screen, of all symbols or the eligible ones.

        The metrics, eight rows a symbol, are stored once for all that reads them."""
        members = self.symbols.select("symbol") if every else self.eligible()
        metrics = durable(first_screen.metrics(members, self.recent, self.recent_ratios, self.day, self.before))
        reasons = first_screen.reasons(metrics)
        return metrics, reasons, first_screen.evaluations(metrics, reasons)
