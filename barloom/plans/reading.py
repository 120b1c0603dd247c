"""Registered queries of readers, sinks and incremental loads: payloads and files are made of the derived tables,
some of them broken, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import scalar
from barloom.functions.session import durable, fresh_folder, stored
from barloom.operators import asof, results, validate, versions
from barloom.plans.panel import Panel, Query, shown
from barloom.schemas import OHLCV
from barloom.sources import market, payloads, sinks
from barloom.streaming import incremental

DAY = F.dayofmonth
LOAD = 100_000  #: files in a batch at most: a load is one batch, however many files it has


def _local(day: Column, sep: str = "") -> Column:
    return F.concat(F.lpad((F.year(day) - 1911).cast("string"), 3, "0"), F.date_format(day, f"{sep}MM{sep}dd"))


def _price(c: str) -> Column:
    return F.format_string("%,.2f", F.col(c))


def _daily_payloads(p: Panel) -> DataFrame:
    """A payload per date: on the 5th a field lacks, on the 6th the text is cut off, on the 7th nothing is in it, on
    the 8th a field is a number, on the 14th a code comes twice, and on the 15th codes are blank; bars without a price
    on the 9th, bars whose high is too low on the 10th, and on the 11th and 12th a number that nothing else looks at is none."""
    day = DAY("trade_date")
    price = lambda c: F.when(day == 9, "0.00").otherwise(F.format_string("%.2f", c))
    cells = {
        "Date": _local(F.col("trade_date")), "Code": F.when(day == 15, " ").otherwise(F.col("symbol")), "Name": F.concat(F.lit(" N"), "symbol"), "TradeVolume": F.format_string("%d", F.col("volume")), "TradeValue": F.when(day == 11, "x").otherwise("0"), "OpeningPrice": price("open"),
        "HighestPrice": F.when(day == 10, "0.01").otherwise(price("high")), "LowestPrice": price("low"), "ClosingPrice": price("close"), "Change": F.when(day == 12, "n/a").when(day != 5, "-0.5"), "Transaction": F.lit("1"),
    }
    record = F.to_json(F.struct(*(c.alias(k) for k, c in cells.items())))
    record = F.when(day == 8, F.replace(record, F.lit('"TradeValue":"0"'), F.lit('"TradeValue":0'))).otherwise(record)
    records = F.collect_list(record)
    records = F.when(day == 14, F.concat(records, F.slice(records, 1, 1))).otherwise(records)
    whole = p.bars.groupBy("trade_date").agg(F.concat(F.lit("["), F.array_join(records, ","), F.lit("]")).alias("text"))
    text = F.when(DAY("trade_date") == 6, F.substring("text", 1, 40)).when(DAY("trade_date") == 7, "[]").otherwise(F.col("text"))
    return whole.select(F.col("trade_date").cast("string").alias("payload_id"), text.alias("payload"))


def snapshot_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(payloads.daily_snapshot(_daily_payloads(Panel(spark, sf_dir)))[0])


def snapshot_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = payloads.daily_snapshot(_daily_payloads(Panel(spark, sf_dir)))[1]
    return bad.groupBy("problem", F.col("position").isNull().alias("whole")).agg(F.count("*").alias("n"))


def _ratio_payloads(p: Panel) -> DataFrame:
    day = DAY("trade_date")
    pe = F.when((F.col("supplier") + day) % 11 == 0, "").when(day == 12, "n/a").otherwise(F.format_string("%.2f", F.floor(F.col("close") * 100 / (1 + F.col("supplier") % 7)) / 100))
    cells = {"Date": _local(F.col("trade_date")), "Code": F.when(day == 13, " ").otherwise(F.col("symbol")), "Name": F.col("symbol"), "PEratio": pe, "DividendYield": F.lit(" "), "PBratio": F.format_string("%.4f", F.col("close") / 50)}
    record = F.to_json(F.struct(*(c.alias(k) for k, c in cells.items())))
    whole = p.bars.groupBy("trade_date").agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("payload"))
    return whole.select(F.col("trade_date").cast("string").alias("payload_id"), "payload")


def snapshot_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(payloads.valuation_snapshot(_ratio_payloads(Panel(spark, sf_dir)))[0])


def snapshot_ratio_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.valuation_snapshot(_ratio_payloads(Panel(spark, sf_dir)))[1].groupBy("problem").agg(F.count("*").alias("n"))


def _month_payloads(p: Panel) -> DataFrame:
    """A payload per symbol and month, one in two spoilt in one of ten ways by symbol and month."""
    month = F.trunc("trade_date", "month").cast("date")
    k = (F.col("supplier") + F.month("trade_date")) % 20
    cell = lambda c: F.when((k == 1) & (F.col("place") == 1), "--").otherwise(_price(c))
    quiet = lambda c: F.when(k == 2, "--").otherwise(cell(c))
    numbered = p.bars.withColumn("month", month).withColumn("place", F.row_number().over(Window.partitionBy("symbol", "month").orderBy("trade_date")))
    day = F.when((k == 3) & (F.col("place") == 1), F.add_months("trade_date", -1)).otherwise(F.col("trade_date"))
    row = F.array(_local(day, "/"), F.format_string("%,d", F.col("volume")), F.when((k == 4) & (F.col("place") == 1), "x").otherwise("1"), quiet("open"), F.when(k == 1, _price("high")).otherwise(quiet("high")), quiet("low"), quiet("close"), F.lit("0"), F.lit("1"), F.lit(""))
    row = F.when(k == 5, F.slice(row, 1, 9)).otherwise(row)
    rows = numbered.groupBy("symbol", "supplier", "month").agg(F.transform(F.array_sort(F.collect_list(F.struct("trade_date", row.alias("row")))), lambda r: r["row"]).alias("data"))
    k = (F.col("supplier") + F.month("month")) % 20
    other = F.when(F.col("symbol") == "9999", "9998").otherwise("9999")
    title = F.concat(F.lpad((F.year("month") - 1911).cast("string"), 3, "0"), F.date_format("month", "年MM月 "), F.when(k == 6, other).otherwise(F.col("symbol")), F.lit(" Name 各日成交資訊"))
    fields = F.array(*[F.lit(f) for f in payloads.MONTHLY])
    body = F.struct(
        F.when(k == 7, "FAILED").otherwise("OK").alias("stat"), F.date_format("month", "yyyyMMdd").alias("date"), title.alias("title"), F.when(k == 8, F.slice(fields, 1, 9)).otherwise(fields).alias("fields"),
        "data", F.array().cast("array<string>").alias("notes"), (F.size("data") + (k == 9).cast("int")).alias("total"),
    )
    return rows.select(F.concat_ws("/", "symbol", F.date_format("month", "yyyy-MM")).alias("payload_id"), "symbol", "month", F.to_json(body).alias("payload"))


def month_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(payloads.monthly_history(_month_payloads(Panel(spark, sf_dir)), market.CODES)[0])


def month_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.monthly_history(_month_payloads(Panel(spark, sf_dir)), market.CODES)[1].select("payload_id", "problem")


def _candle_payloads(p: Panel) -> DataFrame:
    """A payload per symbol and year of the second source, one in two spoilt by symbol and year."""
    year = F.year("trade_date")
    rows = p.second.withColumn("supplier", F.col("symbol").cast("int")).withColumn("year", year)
    bar = F.struct(F.col("trade_date").cast("string").alias("date"), "open", "high", "low", "close", "volume", F.lit(1.0).alias("turnover"), F.lit(0.5).alias("change"))
    grouped = rows.groupBy("symbol", "supplier", "year").agg(F.sort_array(F.collect_list(bar), asc=False).alias("data"))
    k = (F.col("supplier") + F.col("year")) % 16
    first = F.get("data", F.lit(0))
    changed = lambda **c: F.concat(F.array(F.struct(*(c.get(f, first[f]).alias(f) for f in ("date", *OHLCV, "turnover", "change")))), F.slice("data", 2, 1000))
    data = F.when(k == 1, changed(low=F.lit(900.0))).when(k == 2, changed(volume=F.lit(-1).cast("long"))).when(k == 3, changed(date=F.lit("soon"))).when(k == 4, F.concat(F.slice("data", 1, 1), F.col("data"))).when(k == 5, F.slice("data", 1, 0)).when(k == 6, changed(open=F.lit(-5.0))).otherwise(F.col("data"))
    body = F.struct(F.lit("EQUITY").alias("type"), F.when(k == 7, "X").otherwise("TWSE").alias("exchange"), F.lit("TSE").alias("market"), F.col("symbol"), F.when(k == 8, "W").otherwise("D").alias("timeframe"), F.lit("desc").alias("sort"), data.alias("data"))
    text = F.when(k == 9, F.lit("{")).otherwise(F.to_json(body))
    end = F.when(k == 10, F.make_date(F.col("year"), F.lit(1), F.lit(1))).otherwise(F.make_date(F.col("year"), F.lit(12), F.lit(31)))
    return grouped.select(F.concat_ws("/", "symbol", "year").alias("payload_id"), "symbol", F.make_date(F.col("year"), F.lit(1), F.lit(1)).alias("start_date"), end.alias("end_date"), text.alias("payload"))


def candle_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(payloads.candles(_candle_payloads(Panel(spark, sf_dir)))[0])


def candle_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.candles(_candle_payloads(Panel(spark, sf_dir)))[1].select("payload_id", "problem")


def _quote_payloads(p: Panel) -> DataFrame:
    k = (F.col("symbol").cast("int") + F.dayofyear("trade_date")) % 10
    price = lambda c: F.when(k != 1, F.col(c)) if c == "low" else F.col(c)
    noon = F.unix_micros(F.to_utc_timestamp(F.col("trade_date").cast("timestamp"), payloads.ZONE)) + 12 * 3_600_000_000
    body = F.struct(
        F.col("trade_date").cast("string").alias("date"), F.when(k == 2, "FUND").otherwise("EQUITY").alias("type"), F.lit("TWSE").alias("exchange"), F.lit("TSE").alias("market"), F.col("symbol"), F.concat(F.lit("N"), "symbol").alias("name"),
        *(price(c).alias(f"{c}Price") for c in ("open", "high", "low", "close")), F.when(k == 3, noon + 86_400_000_000).otherwise(noon).alias("lastUpdated"), F.struct(F.col("volume").alias("tradeVolume")).alias("total"),
        F.when(k == 4, F.lit(-1.0)).otherwise(F.col("close")).alias("previousClose"), F.when(k == 5, F.lit(0.5)).otherwise(F.col("high")).alias("week52High"), F.col("low").alias("week52Low"),
    )
    return p.second.select(F.concat_ws("/", "symbol", F.col("trade_date").cast("string")).alias("payload_id"), "symbol", F.to_json(body).alias("payload"))


def quote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(payloads.quotes(_quote_payloads(Panel(spark, sf_dir)))[0])


def quote_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.quotes(_quote_payloads(Panel(spark, sf_dir)))[1].groupBy("problem").agg(F.count("*").alias("n"))


def yearly_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads by their problem, in one pass over them, with the extremes of the good ones."""
    judged = payloads.judged_yearly_stats(_quote_payloads(Panel(spark, sf_dir)))
    good = lambda c: F.when(F.col("problem").isNull(), F.col(c))
    rows = judged.select(F.coalesce("problem", F.lit("kept")).alias("problem"), good("high_52w").alias("high"), good("low_52w").alias("low"))
    return shown(rows.groupBy("problem").agg(F.count("*").alias("n"), F.max("high").alias("highest"), F.min("low").alias("lowest")))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities and delistings from text: odd codes, blank names and undated rows are left out."""
    names = Panel(spark, sf_dir).symbols
    k = F.col("supplier")
    code = F.when(k % 9 == 1, F.concat("symbol", F.lit("A"))).otherwise(F.concat(F.lit(" "), "symbol"))
    listed = payloads.identities(names.select(code.alias("code"), F.when(k % 9 == 2, " ").otherwise(F.col("name")).alias("name"), F.when(k % 9 == 3, "").when(k % 2 == 0, "0890103").otherwise("2000-01-03").alias("listing_date")), market.CODES)
    gone = payloads.delistings(names.select(F.col("symbol").alias("code"), "name", F.when(k % 3 != 0, "1100105").alias("delisting_date")), listed, market.CODES)
    both = listed.select("symbol", F.lit("listed").alias("kind"), F.col("listing_date").alias("day"))
    return both.unionByName(gone.select("symbol", F.lit("delisted").alias("kind"), F.col("delisting_date").alias("day")))


def common_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that both feeds name, and whether alike."""
    names = Panel(spark, sf_dir).symbols
    k = F.col("supplier")
    same, other = payloads.listed_common_stock(names.where(k % 5 != 1).select("symbol", "name"), names.where(k % 5 != 2).select("symbol", F.when(k % 4 == 3, "other").otherwise(F.col("name")).alias("name")), market.CODES)
    return same.select("symbol", F.lit(True).alias("alike")).unionByName(other.select("symbol", F.lit(False).alias("alike")))


def payload_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spellings of one payload have one hash; text that is no JSON has none."""
    nations = market.table(spark, sf_dir, "nation")
    k, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    texts = {"tidy": F.concat(F.lit('{"key":'), k, F.lit(',"name":"'), name, F.lit('"}')), "loose": F.concat(F.lit('{ "name" : "'), name, F.lit('",\n "key": '), k, F.lit(" }")), "cut": F.concat(F.lit('{"key":'), k)}
    rows = nations.select(F.inline(F.array(*[F.struct(F.concat(k, F.lit(f"/{n}")).alias("payload_id"), t.alias("payload")) for n, t in texts.items()])))
    return payloads.payload_evidence(rows)


def payload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads written as files, with their evidence, and read back whole."""
    path = fresh_folder(spark, "payloads")
    nations = market.table(spark, sf_dir, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("value"))
    nations.repartition(3).write.text(path)
    files = payloads.artifacts(spark, f"{path}/*.txt").select(F.col("path"), "payload_sha256", "payload_size_bytes")
    texts = payloads.payload_files(spark, f"{path}/*.txt").select(F.sha2("payload", 256).alias("payload_sha256"), F.size(F.split(F.rtrim(F.regexp_replace("payload", "\n$", "")), "\n")).alias("lines"))
    return files.join(texts, "payload_sha256").agg(F.sum("lines").alias("lines"), F.sum("payload_size_bytes").alias("bytes"))


def price_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = DAY("trade_date")
    rows = Panel(spark, sf_dir).bars.select(F.when(day.isin(2, 4), 0.0).otherwise(F.col("open")).alias("open"), *(F.when(day == 2, 0.0).otherwise(F.col(c)).alias(c) for c in ("high", "low", "close")))
    return rows.groupBy(validate.price_class().alias("price_class")).agg(F.count("*").alias("n"))


def payload_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics whose status, value and date don't go together."""
    day = DAY("trade_date")
    rows = Panel(spark, sf_dir).bars.select("symbol", F.when(day % 5 == 0, "missing_source").otherwise("available").alias("status"), F.when(day % 7 != 0, F.col("close")).alias("value"), F.when(day % 11 != 0, F.col("trade_date")).alias("as_of_date"))
    return validate.payload_violations(rows).groupBy("symbol", "status").agg(F.count("*").alias("n"))


def redacted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = market.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    texts = ("token=%d, retry", "no API-Key: %d;", "x&password='%d 7'&y", "Authorization: Bearer a.%d", "order %d failed", "line\nsecret = %d")
    message = F.element_at(F.array(*[F.format_string(t, "k") for t in texts]), (F.col("k") % len(texts) + 1).cast("int"))
    return orders.select("k", scalar.redacted(message, 30).alias("message"), scalar.error_text(F.lit("ReadError"), F.when(F.col("k") % 7 != 0, message), 40).alias("told"))


def clean_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = market.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    texts = ("https://h.example/a?page=%d", "ftp://u:p@h.example/%d", "https://h.example/x?Token=%d", "urn:order:%d", "order/%d", "https://h.example/x?api%%5fkey=%d", "file:///tmp/%d?x-amz-Signature", "s3://u@b/%d", "dataset://d/%d?a=1&key")
    uri = F.element_at(F.array(*[F.format_string(t, "k") for t in texts]), (F.col("k") % len(texts) + 1).cast("int"))
    return orders.select("k", scalar.is_clean_reference(uri).alias("clean"))


def json_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = market.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    texts = ("null", "true", "%d.5", '"a%d\\n"', '{"a":%d}', "", " %d ", "01%d", "nul")
    text = F.element_at(F.array(*[F.format_string(t, "k") if "%d" in t else F.lit(t) for t in texts]), (F.col("k") % len(texts) + 1).cast("int"))
    return shown(orders.select("k", scalar.json_scalar(text).alias("s")).select("k", "s.kind", "s.number", "s.text", "s.truth"))


def _loads(p: Panel) -> tuple[DataFrame, DataFrame]:
    """Two loads of bars: the second writes half of them again and adds days."""
    day = DAY("trade_date")
    light = p.bars.select("symbol", "trade_date", "open", "high", "low", "close", "volume", "source", F.date_format("trade_date", "'m'yyyy").alias("year"))
    return light.where(day <= 20), light.where(day >= 15).withColumn("volume", F.col("volume") + 7)


def upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after three loads: the second repeats rows of itself and writes over the first, and the third moves some
    days of every month to another partition, and others to none."""
    one, two = _loads(Panel(spark, sf_dir).at_hand())
    path, day = fresh_folder(spark, "upserts"), DAY("trade_date")
    again = two.select("*", F.explode(F.when(day == 16, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("turn"))
    again = again.withColumn("volume", F.col("volume") + F.col("turn") - 1)
    moved = one.where(day.isin(4, 9)).withColumn("year", F.when(day == 4, F.concat("year", F.lit("b")))).withColumn("volume", -F.col("volume"))
    for load in (one.withColumn("turn", F.lit(9)), again, moved.withColumn("turn", F.lit(0))):
        sinks.upsert(load, path, ["symbol", "trade_date"], ["turn"], "year")
    return sinks.stored_table(spark, path).select("symbol", "trade_date", "volume", "year")


def insert_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of results that are written once: new, known, or contradicted by the store or their own load."""
    rows = Panel(spark, sf_dir).bars.select("symbol", "trade_date", F.col("supplier").alias("k"))
    day = DAY("trade_date")
    old = rows.where(day % 2 == 0).select("symbol", "trade_date", F.lit("a").alias("payload_sha256"))
    texts = F.when(day % 5 == 0, F.array(F.lit("a"), F.lit("b"))).when(day % 3 == 0, F.array(F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("a")))
    new = rows.select("symbol", "trade_date", F.explode(texts).alias("payload_sha256"))
    fresh, wrong = sinks.insert_once(new, old, ["symbol", "trade_date"])
    mark = lambda t, n: t.groupBy("symbol", F.lit(n).alias("outcome")).agg(F.count("*").alias("n"))
    return mark(fresh, "appended").unionByName(mark(wrong, "conflict"))


def keyed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol's bars of a year from a stored table, by filters that reach the scan."""
    p = Panel(spark, sf_dir)
    table = stored(p.bars.select("symbol", "trade_date", "close", "volume"), "bars")
    return shown(sinks.keyed_read(table, "0003", "1999-01-01", "2001-12-31"))


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as JSON, nulls included, and read back."""
    p = Panel(spark, sf_dir)
    path = fresh_folder(spark, "report")
    sinks.write_report(asof.price_status(p.symbols, p.bars.where("supplier % 7 <> 3"), p.day), path)
    return spark.read.schema("symbol string, latest_date date, observations long, price_status string").json(path)


def universe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's universe written as JSON documents and read back."""
    p = Panel(spark, sf_dir)
    path = fresh_folder(spark, "universe")
    sinks.write_universe(p.members(), p.day, path)
    return payloads.universe_snapshot(spark, path)


def _bar_files(bars: DataFrame, path: str) -> None:
    """Bars as files, as many as the tasks that have them."""
    bars.select("symbol", "trade_date", *OHLCV, "source").write.mode("append").parquet(path)


def backfills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table filled by two incremental loads of files, the second writing over the first; then no file is new."""
    p = Panel(spark, sf_dir).at_hand()
    one, two = _loads(p)
    incoming, table, point = (fresh_folder(spark, n) for n in ("incoming", "backfill", "cursor"))
    for load in (one, two, None):
        if load is not None:
            _bar_files(load, incoming)
        incremental.backfill(spark, incoming, table, point, LOAD).awaitTermination()
    return sinks.stored_table(spark, table).select("symbol", "trade_date", "volume", "source")


def backfill_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which symbols have enough bars, and which ran out of months before."""
    bars = Panel(spark, sf_dir).bars
    return incremental.backfill_state(bars.where("supplier % 4 <> 0 or year(trade_date) < 1997"), 500, 20)


def backfill_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each symbol's backfill stands after three loads of months in disorder: it goes back from the day's month until
    it has bars enough or has taken months enough; some symbols lack a month and wait there."""
    p = Panel(spark, sf_dir).at_hand()
    month = F.month("trade_date")
    bars = p.bars.where((F.col("supplier") % 5 != 2) | (month % 4 != 0))
    names = ("incoming", "backfill", "waiting", "months", "cursor")
    incoming, table, waiting, cursor, point = (fresh_folder(spark, n) for n in names)
    for part in (0, 2, 1):
        _bar_files(bars.where(month % 3 == part), incoming)
        incremental.backfill_by_month(spark, incoming, table, waiting, cursor, point, p.day, 45, 8, LOAD).awaitTermination()
    states = incremental.month_cursors(sinks.stored_table(spark, cursor), p.day, 45, 8)
    held = sinks.stored_table(spark, table).groupBy("symbol").agg(F.count("*").alias("stored"), F.min("trade_date").alias("first_date"))
    return states.join(held, "symbol", "left")


def late_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions for two target dates after late canonical bars came in by a stream, which ran twice from the start."""
    p = Panel(spark, sf_dir)
    last, late = p.last_of_both(60), DAY("trade_date") >= 20
    other = market.second_bars(last)
    made, rows = versions.build(last.where(~late), other, other.where("1 = 0"), p.required(last))
    incoming, store = (fresh_folder(spark, n) for n in ("arrivals", "versions"))
    incremental.store_versions(durable(made), durable(rows), store)
    _bar_files(last.where(late & (F.col("supplier") % 3 != 1)), incoming)
    for _ in range(2):
        incremental.reconcile_arrivals(spark, incoming, store, fresh_folder(spark, "cursor")).awaitTermination()
    return incremental.stored_versions(spark, store)[0].groupBy("symbol", "target_date", "status").agg(F.count("*").alias("versions"), F.sum("canonical").alias("canonical"), F.sum("discrepancies").alias("discrepancies"))


def replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of finished keys after they were computed again with another outcome."""
    p = Panel(spark, sf_dir)
    incoming, table, point = (fresh_folder(spark, n) for n in ("results", "replay", "cursor"))
    one, two = _loads(p)
    schema = "result_id string, symbol string, market_date date, volume long"
    for load in (one, two):
        keyed = load.select("symbol", F.col("trade_date").alias("market_date"), "volume")
        keyed.select(results.result_id("v1").alias("result_id"), "symbol", "market_date", "volume").write.mode("append").parquet(incoming)
        incremental.replay(spark, incoming, schema, table, ["result_id"], point).awaitTermination()
    return spark.read.parquet(table).select("symbol", "market_date", "volume")


ALL: tuple[Query, ...] = (
    snapshot_bars, snapshot_rejects, snapshot_ratios, snapshot_ratio_rejects, month_bars, month_rejects, candle_bars, candle_rejects, quote_rows, quote_rejects, yearly_rows, listings, common_names,
    payload_evidence, payload_files, price_classes, payload_problems, redacted_messages, clean_references, json_scalars, upserts, insert_conflicts, keyed_reads, report_files, universe_files,
    backfills, backfill_states, backfill_months, late_arrivals, replays,
)
