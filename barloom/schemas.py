"""Schemas of the panel tables. Missing values are null with a status beside them, never zero."""

from __future__ import annotations

BARS = "symbol string, trade_date date, open double, high double, low double, close double, volume long, source string"
METRICS = "symbol string, metric_date date, name string, value double, unit string, source string"
SYMBOLS = "symbol string, name string, market string, currency string, is_active boolean"
MEMBERS = "symbol string, name string, status string, reason string"
OHLCV = ("open", "high", "low", "close", "volume")
VALUATIONS = ("price_earnings_ratio", "price_to_book_ratio", "dividend_yield_pct")
