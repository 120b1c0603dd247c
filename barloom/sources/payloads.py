"""Readers of providers' JSON payloads.

A payload is one row (payload_id, payload) with the text of one response; ``payload_files`` makes such rows of
files, whole. Each reader gives the good rows and the rejected ones with a reason; what the provider's contract
says of the whole response rejects the whole payload (its position is null). All checks of a payload are
made inside its row, so reading shuffles nothing; a payload that doesn't parse is a rejected row, not a failed job.
Columns of the request beside the payload (symbol, month, start_date, end_date) are held against it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalar import COMMON_STOCK, clean_text, first_of, flexible_date, is_common_stock_code, let, roc_date, to_integer, to_number
from barloom.operators.validate import bar_problem, price_class
from barloom.schemas import OHLCV

ZONE = "Asia/Taipei"
# The providers' field names, and the identity that the second provider's payloads have.
DAILY = ("Date", "Code", "Name", "TradeVolume", "TradeValue", "OpeningPrice", "HighestPrice", "LowestPrice", "ClosingPrice", "Change", "Transaction")
RATIOS = {"PEratio": ("price_earnings_ratio", "ratio"), "DividendYield": ("dividend_yield_pct", "%"), "PBratio": ("price_to_book_ratio", "ratio")}
MONTHLY = ("日期", "成交股數", "成交金額", "開盤價", "最高價", "最低價", "收盤價", "漲跌價差", "成交筆數", "註記")
MONTHLY_TITLE = r"^[0-9]{{3}}年[0-9]{{2}}月\s+({codes})\s+(\S.*?)\s+各日成交資訊$"
IDENTITY = {"type": "EQUITY", "exchange": "TWSE", "market": "TSE"}

_CANDLES = "type string, exchange string, market string, symbol string, timeframe string, sort string, data array<struct<date:string,open:double,high:double,low:double,close:double,volume:long,turnover:double,change:double>>"
_QUOTE = "date string, type string, exchange string, market string, symbol string, name string, openPrice double, highPrice double, lowPrice double, closePrice double, previousClose double, week52High double, week52Low double, lastUpdated long, isClose boolean, total struct<tradeVolume:long>"
BAR = ("symbol", "trade_date", "open", "high", "low", "close", "volume", "source")


def payload_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(payload_id, payload) of whole files, without a byte order mark."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("payload_id"), "value")
    return files.select("payload_id", F.regexp_replace("value", "^﻿", "").alias("payload"))


def _split(rows: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    return rows.where("problem is null").select(*keep), rows.where("problem is not null").select("payload_id", "position", "problem")


def _worked_out(rows: DataFrame, keep: list[str], /, **columns: Column) -> DataFrame:
    """``rows`` with columns that are worked out once each: a filter on what is made of them can't be pushed below
    and repeat them."""
    return rows.select(*keep, F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def _parsed(payloads: DataFrame) -> DataFrame:
    """Payloads with ``v``, the parsed JSON, null where it is none."""
    return payloads.withColumn("v", F.try_parse_json("payload"))


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def _at(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _records(payloads: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(payload_id, problem, position, r): a row per record of arrays of objects whose ``fields`` are all text and
    whose codes are there and differ, and a row per payload that isn't such an array."""
    items = _at(F.col("v"), "$", "array<variant>")
    field = lambda i, f: F.try_variant_get(i, f"$.{f}", "variant")
    some = lambda cond: F.exists("items", cond)
    lacking = lambda i: F.array_contains(F.array(*[field(i, f).isNull() for f in fields]), True)
    other = lambda i: F.array_contains(F.array(*[_type(field(i, f)) != "STRING" for f in fields]), True)
    whole = first_of(
        (F.col("v").isNull(), "malformed_json"),
        (F.col("items").isNull() | (F.size("items") == 0), "not_a_record_array"),
        (some(lambda i: ~_type(i).startswith("OBJECT")), "item_not_an_object"),
        (some(lacking), "field_missing"),
        (some(other), "field_not_text"),
        (F.exists("codes", lambda c: c == ""), "code_blank"),
        (F.size(F.array_distinct("codes")) < F.size("codes"), "code_repeated"),
    )
    codes = F.transform(items, lambda i: F.btrim(F.try_variant_get(i, "$.Code", "string")))
    read = _worked_out(_worked_out(_parsed(payloads), ["payload_id", "payload", "v"], items=items, codes=codes), ["payload_id", "payload"], problem=whole)
    schema = "array<struct<" + ",".join(f"`{f}`:string" for f in fields) + ">>"
    records = F.when(F.col("problem").isNull(), F.from_json("payload", schema))
    return read.select("payload_id", F.col("problem").alias("whole"), F.posexplode_outer(records).alias("position", "r")).select("payload_id", "whole", "position", "r.*")


def _unsigned(text: Column) -> Column:
    return F.when(F.btrim(text).rlike("^[0-9]+$"), F.btrim(text).try_cast("long"))


def _decimal(text: Column) -> Column:
    return F.when(F.btrim(text).rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?$"), F.btrim(text).try_cast("double"))


def daily_snapshot(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All-market snapshot: an array of objects of text fields, plain numbers among them. Rows without any trade are
    rejected as unavailable."""
    raw = _records(payloads, DAILY)
    typed = _worked_out(
        raw, ["payload_id", "whole", "position"], symbol=clean_text(F.col("Code")), name=clean_text(F.col("Name")), trade_date=roc_date(F.col("Date")),
        open=_decimal(F.col("OpeningPrice")), high=_decimal(F.col("HighestPrice")), low=_decimal(F.col("LowestPrice")), close=_decimal(F.col("ClosingPrice")), volume=_unsigned(F.col("TradeVolume")), source=F.lit("primary"),
        others=F.struct(_unsigned(F.col("TradeValue")).alias("value"), _unsigned(F.col("Transaction")).alias("trades"), _decimal(F.col("Change")).alias("change")),
    )
    numbers = [F.col(c).isNull() for c in (*OHLCV, "others.value", "others.trades", "others.change")]
    problem = first_of((F.col("whole").isNotNull(), F.col("whole")), (F.col("name").isNull(), "identity_missing"), (F.col("trade_date").isNull(), "date_invalid"), (F.array_contains(F.array(*numbers), True), "number_invalid"), (price_class() == "unavailable", "price_unavailable"), otherwise=bar_problem())
    return _split(typed.withColumn("problem", problem), "symbol", "name", *BAR[1:])


def valuation_snapshot(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ratios of a day, from wide to long; a blank is no row, other text that isn't a number is rejected."""
    raw = _records(payloads, ("Date", "Code", "Name", *RATIOS))
    kinds = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(u).alias("unit"), F.col(c).alias("text")) for c, (n, u) in RATIOS.items()])
    there = F.filter(kinds, lambda k: clean_text(k["text"]).isNotNull())
    rows = raw.select("payload_id", "whole", "position", clean_text(F.col("Code")).alias("symbol"), roc_date(F.col("Date")).alias("metric_date"), F.explode(F.when(F.col("whole").isNotNull(), F.slice(kinds, 1, 1)).otherwise(there)).alias("k"))
    judged = _worked_out(rows, ["payload_id", "whole", "position", "symbol", "metric_date"], name=F.col("k.name"), unit=F.col("k.unit"), value=_decimal(F.col("k.text")), source=F.lit("primary"))
    problem = first_of((F.col("whole").isNotNull(), F.col("whole")), (F.col("metric_date").isNull(), "date_invalid"), (F.col("value").isNull(), "value_invalid"))
    return _split(judged.withColumn("problem", problem), "symbol", "metric_date", "name", "value", "unit", "source")


def _asked(payloads: DataFrame, name: str, kind: str) -> Column:
    """A column of the request, null where it wasn't given."""
    return F.col(name).cast(kind) if name in payloads.columns else F.lit(None).cast(kind)


def _ascending(dates: Column) -> Column:
    n = F.greatest(F.size(dates) - 1, F.lit(0))
    return F.forall(F.zip_with(F.slice(dates, 1, n), F.slice(dates, 2, n), lambda a, b: a < b), lambda x: F.coalesce(x, F.lit(False)))


def monthly_history(payloads: DataFrame, codes: str = COMMON_STOCK) -> tuple[DataFrame, DataFrame]:
    """A month of one symbol: an envelope with rows of ten cells of text by position. The envelope, the names of the
    cells, the title's symbol, each row and the total are checked, and one that is wrong rejects the payload; a row
    of dashes had no trade and is dropped. Rows outside start_date and end_date of the request are left out. ``codes``
    is the form of the code in the title."""
    v = F.col("v")
    text = lambda k: _at(v, f"$.{k}", "string")
    read = _parsed(payloads).select(
        "payload_id", "v", text("stat").alias("stat"), text("date").alias("month_day"), F.btrim(text("title")).alias("title"), _at(v, "$.fields", "array<string>").alias("fields"),
        _at(v, "$.data", "array<array<variant>>").alias("cells"), _at(v, "$.data", "array<array<string>>").alias("data"), _at(v, "$.notes", "array<string>").alias("notes"), _at(v, "$.total", "int").alias("total"),
        _type(F.try_variant_get(v, "$.total", "variant")).alias("total_type"), _asked(payloads, "symbol", "string").alias("asked"), _asked(payloads, "month", "date").alias("month"), _asked(payloads, "start_date", "date").alias("start_date"), _asked(payloads, "end_date", "date").alias("end_date"),
    )
    read = read.withColumn("symbol", F.nullif(F.regexp_extract("title", MONTHLY_TITLE.format(codes=codes), 1), F.lit("")))
    of_month = F.substring("month_day", 1, 6)
    cell = lambda r, k: F.btrim(F.get(r, F.lit(k)))
    grouped = r"^(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)"

    def judged(r: Column, c: Column) -> Column:
        dash = [(cell(r, k) == "--").cast("int") for k in range(3, 7)]
        price = lambda k: let(cell(r, k), lambda t: F.when(t.rlike(grouped + r"(?:\.[0-9]+)?$"), F.replace(t, F.lit(","), F.lit("")).try_cast("double")))
        parts = {"open": price(3), "high": price(4), "low": price(5), "close": price(6), "volume": to_integer(cell(r, 1)), "dashes": sum(dash[1:], dash[0]), "trade_date": F.when(cell(r, 0).rlike("^[0-9]{3}/[0-9]{2}/[0-9]{2}$"), roc_date(cell(r, 0)))}
        whole = F.forall(F.array(*[cell(r, k) for k in (1, 2, 8)]), lambda t: F.coalesce(t.rlike(grouped + "$"), F.lit(False)))
        malformed = (F.size(c) != len(MONTHLY)) | F.exists(c, lambda x: _type(x) != "STRING")
        return let(F.struct(*(v.alias(k) for k, v in parts.items()), whole.alias("whole"), malformed.alias("malformed")), told)

    def told(x: Column) -> Column:
        o, h, lo, cl = (x[k] for k in ("open", "high", "low", "close"))
        problem = first_of(
            (x["malformed"], "row_malformed"),
            (x["trade_date"].isNull(), "date_invalid"),
            (F.date_format(x["trade_date"], "yyyyMM") != of_month, "date_out_of_month"),
            (~x["whole"], "number_invalid"),
            (x["dashes"] == 4, F.lit(None).cast("string")),
            (x["dashes"] > 0, "price_partial"),
            (o.isNull() | h.isNull() | lo.isNull() | cl.isNull(), "number_invalid"),
            (F.least(o, h, lo, cl) <= 0, "price_not_positive"),
            (h < F.greatest(o, lo, cl), "high_not_highest"),
            (lo > F.least(o, h, cl), "low_not_lowest"),
        )
        return F.struct(problem.alias("problem"), *(x[k].alias(k) for k in ("trade_date", "open", "high", "low", "close", "volume")), (x["dashes"] == 4).alias("no_trade"))

    read = _worked_out(read, read.columns, rows=F.zip_with("data", "cells", judged))
    inside = lambda d: F.coalesce(d >= F.col("start_date"), F.lit(True)) & F.coalesce(d <= F.col("end_date"), F.lit(True))
    kept = F.filter("rows", lambda r: ~r["no_trade"] & inside(r["trade_date"]))
    dates = F.transform("rows", lambda r: r["trade_date"])
    whole = first_of(
        (v.isNull(), "malformed_json"),
        ((F.col("stat") != "OK") & (F.col("total") == 0), "no_trading_data"),
        (F.array_contains(F.array(*[F.try_variant_get(v, f"$.{k}", "variant").isNull() for k in ("stat", "date", "title", "fields", "data", "notes", "total")]), True), "field_missing"),
        (F.col("stat") != "OK", "status_not_ok"),
        (F.col("month").isNotNull() & (F.col("month_day") != F.date_format("month", "yyyyMMdd")), "month_mismatch"),
        (~F.col("fields").eqNullSafe(F.array(*[F.lit(f) for f in MONTHLY])), "fields_unknown"),
        (F.col("data").isNull() | F.col("notes").isNull() | (F.col("total_type") != "BIGINT"), "envelope_malformed"),
        (F.col("symbol").isNull() | (F.col("asked").isNotNull() & (F.col("asked") != F.col("symbol"))), "title_mismatch"),
        (F.exists("rows", lambda r: r["problem"].isNotNull()), F.get(F.filter(F.transform("rows", lambda r: r["problem"]), lambda p: p.isNotNull()), F.lit(0))),
        (~_ascending(dates), "dates_not_ascending"),
        (F.col("total") != F.size("data"), "total_mismatch"),
        (F.size(kept) == 0, "no_trading_data"),
    )
    judged_ = _worked_out(read, ["payload_id", "symbol"], problem=whole, kept=kept)
    out = judged_.select("payload_id", "problem", "symbol", F.posexplode_outer(F.when(F.col("problem").isNull(), F.col("kept"))).alias("position", "r"))
    rows = out.select("payload_id", "position", "problem", "symbol", "r.trade_date", "r.open", "r.high", "r.low", "r.close", "r.volume", F.lit("primary").alias("source"))
    return _split(rows, *BAR)


def _identity_problem(payloads: DataFrame) -> Column:
    """Whether the second provider's payload is of the kind and symbol that it has to be."""
    wrong = [~F.btrim(F.coalesce(k, F.lit(""))).eqNullSafe(F.lit(want)) for k, want in IDENTITY.items()]
    own = F.col("asked").isNotNull() & ~F.btrim("symbol").eqNullSafe(F.col("asked"))
    return F.array_contains(F.array(*wrong, own, clean_text(F.col("symbol")).isNull()), True)


def _objects(payloads: DataFrame, schema: str) -> DataFrame:
    asked = [_asked(payloads, n, t).alias(a) for n, t, a in (("symbol", "string", "asked"), ("start_date", "date", "start_date"), ("end_date", "date", "end_date"))]
    return payloads.select("payload_id", F.try_parse_json("payload").isNull().alias("no_json"), F.from_json("payload", schema).alias("p"), *asked).select("payload_id", "no_json", "asked", "start_date", "end_date", "p.*")


def candles(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The second source's candles: one object per symbol with an array of daily bars, in either order. A wrong
    identity, time frame or order, a date that repeats or lies outside the request, or a bad bar rejects the payload."""
    raw = _objects(payloads, _CANDLES)
    day = lambda d: d["date"].try_cast("date")
    prices = lambda d: (d["open"], d["high"], d["low"], d["close"])

    def judged(d: Column) -> Column:
        o, h, lo, c = prices(d)
        return first_of(
            (day(d).isNull(), "date_invalid"),
            ((day(d) < F.col("start_date")) | (day(d) > F.col("end_date")), "date_out_of_range"),
            (o.isNull() | h.isNull() | lo.isNull() | c.isNull(), "number_invalid"),
            (F.least(o, h, lo, c) <= 0, "price_not_positive"),
            ((h < F.greatest(o, lo, c)) | (lo > F.least(o, h, c)), "price_relation"),
            (d["volume"].isNull() | (d["volume"] < 0), "volume_invalid"),
            (d["turnover"].isNull() | (d["turnover"] < 0) | d["change"].isNull(), "number_invalid"),
        )

    problems = F.filter(F.transform("data", judged), lambda p: p.isNotNull())
    days = F.transform("data", day)
    whole = first_of(
        (F.col("no_json"), "malformed_json"),
        (_identity_problem(raw), "identity_mismatch"),
        (~F.col("timeframe").eqNullSafe(F.lit("D")), "timeframe_not_daily"),
        (~F.coalesce(F.col("sort").isin("asc", "desc"), F.lit(False)), "sort_unknown"),
        (F.col("data").isNull(), "data_not_an_array"),
        (F.size("data") == 0, "no_trading_data"),
        (F.size(F.array_distinct(days)) < F.size(days), F.coalesce(F.get(F.filter(problems, lambda p: p == "date_invalid"), F.lit(0)), F.lit("date_repeated"))),
        (F.size(problems) > 0, F.get(problems, F.lit(0))),
    )
    out = _worked_out(raw, ["payload_id", "symbol", "data"], problem=whole).select("payload_id", "problem", "symbol", F.posexplode_outer(F.when(F.col("problem").isNull(), F.col("data"))).alias("position", "d"))
    return _split(out.select("payload_id", "position", "problem", F.btrim("symbol").alias("symbol"), day(F.col("d")).alias("trade_date"), "d.open", "d.high", "d.low", "d.close", "d.volume", F.lit("secondary").alias("source")), *BAR)


def micros_date(micros: Column) -> Column:
    """The exchange's date of a moment in microseconds."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_micros(micros), ZONE))


def quotes(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quotes of a day: of the right identity, prices all there or none, and a last update that falls on the
    quote's own date."""
    raw = _objects(payloads, _QUOTE)
    prices = [F.col(c) for c in ("openPrice", "highPrice", "lowPrice", "closePrice")]
    known = sum((p.isNotNull().cast("int") for p in prices[1:]), prices[0].isNotNull().cast("int"))
    typed = _worked_out(
        raw, ["payload_id", "no_json", "name", "isClose"], symbol=F.btrim("symbol"), foreign=_identity_problem(raw), trade_date=F.col("date").try_cast("date"), **dict(zip(("open", "high", "low", "close"), prices)),
        volume=F.col("total.tradeVolume"), updated_on=micros_date(F.col("lastUpdated")), known=known, source=F.lit("secondary"), position=F.lit(None).cast("int"),
    )
    problem = first_of((F.col("no_json"), "malformed_json"), (F.col("foreign"), "identity_mismatch"), (F.col("trade_date").isNull(), "date_invalid"), (~F.col("updated_on").eqNullSafe(F.col("trade_date")), "timestamp_off_date"), (F.col("known").between(1, 3), "price_partial"), (F.col("known") == 4, bar_problem()))
    return _split(typed.withColumn("problem", problem), "symbol", "name", *BAR[1:])


def judged_yearly_stats(payloads: DataFrame) -> DataFrame:
    """The highest and lowest price of 52 weeks and the last close of every payload, with its problem, null if it has none:
    for what looks at good and rejected ones at once."""
    raw = _objects(payloads, _QUOTE)
    typed = _worked_out(
        raw, ["payload_id", "no_json"], symbol=F.col("symbol"), foreign=_identity_problem(raw), position=F.lit(None).cast("int"), as_of_date=F.col("date").try_cast("date"),
        previous_close=F.col("previousClose"), high_52w=F.col("week52High"), low_52w=F.col("week52Low"),
    )
    some = F.least("previous_close", "high_52w", "low_52w")
    lacking = F.col("previous_close").isNull() | F.col("high_52w").isNull() | F.col("low_52w").isNull()
    problem = first_of((F.col("no_json"), "malformed_json"), (F.col("foreign"), "identity_mismatch"), (F.col("as_of_date").isNull(), "date_invalid"), (lacking | (some <= 0), "price_not_positive"), (F.col("high_52w") < F.col("low_52w"), "high_under_low"))
    return typed.withColumn("problem", problem)


def yearly_stats(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The highest and lowest price of 52 weeks, and the last close."""
    return _split(judged_yearly_stats(payloads), "symbol", "as_of_date", "previous_close", "high_52w", "low_52w")


def identities(raw: DataFrame, codes: str = COMMON_STOCK) -> DataFrame:
    """Listed common stock from text rows (code, name, listing_date): codes not of the form ``codes`` and undated rows are left out."""
    typed = raw.select(clean_text(F.col("code")).alias("symbol"), clean_text(F.col("name")).alias("name"), flexible_date(F.col("listing_date")).alias("listing_date"))
    return typed.where(is_common_stock_code(F.col("symbol"), codes) & F.col("name").isNotNull() & F.col("listing_date").isNotNull())


def delistings(raw: DataFrame, identity: DataFrame, codes: str = COMMON_STOCK) -> DataFrame:
    """Dated delistings of symbols that aren't listed now."""
    typed = raw.select(clean_text(F.col("code")).alias("symbol"), clean_text(F.col("name")).alias("name"), flexible_date(F.col("delisting_date")).alias("delisting_date"))
    return typed.where(is_common_stock_code(F.col("symbol"), codes) & F.col("delisting_date").isNotNull()).join(identity.select("symbol"), "symbol", "left_anti")


def artifacts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Evidence of files as they are: hash and size; the bytes aren't kept."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("payload_sha256"), F.col("length").alias("payload_size_bytes"), F.lit("raw_bytes").alias("hash_basis"))


def payload_evidence(payloads: DataFrame) -> DataFrame:
    """Evidence of what payloads say, whatever their spaces and the order of their keys: hash and size of their
    JSON with sorted keys and no spaces; null where there is no JSON."""
    plain = F.to_json(F.try_parse_json("payload"))
    return payloads.select("payload_id", F.sha2(plain, 256).alias("payload_sha256"), F.octet_length(plain).cast("long").alias("payload_size_bytes"), F.lit("canonical-json-v1").alias("hash_basis"))


def universe_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(market_date, symbol, name, status, reason) of stored universes."""
    raw = spark.read.schema("market_date date, members array<struct<symbol:string,name:string,status:string,reason:string>>").json(path)
    return raw.select("market_date", F.inline("members"))


def listed_common_stock(prices: DataFrame, ratios: DataFrame, codes: str = COMMON_STOCK) -> tuple[DataFrame, DataFrame]:
    """Symbols in both feeds, and those that the feeds name differently; ``codes`` is the form of a common stock's code."""
    both = prices.select("symbol", "name").distinct().join(ratios.select("symbol", F.col("name").alias("other")).distinct(), "symbol").where(is_common_stock_code(F.col("symbol"), codes))
    return both.where("name = other").select("symbol", "name"), both.where("name <> other")
