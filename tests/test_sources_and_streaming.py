import datetime as dt
import hashlib
import json

from barloom.functions import scalar
from barloom.operators import versions
from barloom.schemas import BARS
from barloom.sources import payloads, sinks
from barloom.streaming import incremental
from pyspark.sql import functions as F

from tests.test_versions_and_results import D, bars


def texts(spark, *payloads, **asked):
    """Payload rows of values or of texts as they are, with the same request beside each."""
    rows = [(str(k), p if isinstance(p, str) else json.dumps(p, ensure_ascii=False), *asked.values()) for k, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "payload_id string, payload string" + "".join(f", {k} {'string' if k == 'symbol' else 'date'}" for k in asked))


def write(path, value):
    path.write_text(json.dumps(value), encoding="utf-8")
    return str(path)


def day_row(**changes):
    return dict.fromkeys(payloads.DAILY, "0") | {"Date": "1130105", "Code": "1101", "Name": "Cement", "TradeVolume": "1234", "OpeningPrice": "10.5", "HighestPrice": "11", "LowestPrice": "10", "ClosingPrice": "10.75"} | changes


def test_daily_snapshot(spark):
    rows = [day_row(), day_row(Code="1102", OpeningPrice="0", HighestPrice="0", LowestPrice="0", ClosingPrice="0"), day_row(Code="1103", HighestPrice="1"), day_row(Code="1104", Date="1131305"), day_row(Code="1105", Name=" "), *(day_row(Code=str(1106 + k), **{f: v}) for k, (f, v) in enumerate({"TradeValue": "x", "Change": "n/a", "Transaction": "-1", "TradeVolume": "1,234", "ClosingPrice": "1e1"}.items())), day_row(Code="1190", Change="-0.5")]
    good, bad = payloads.daily_snapshot(texts(spark, rows))
    row = good.first()
    assert (row.symbol, row.trade_date, row.open, row.volume) == ("1101", dt.date(2024, 1, 5), 10.5, 1234) and good.count() == 2
    assert {r.position: r.problem for r in bad.collect()} == {1: "price_unavailable", 2: "high_not_highest", 3: "date_invalid", 4: "identity_missing"} | dict.fromkeys(range(5, 10), "number_invalid")
    lacking = {k: v for k, v in day_row().items() if k != "Change"}
    whole = [[day_row(), lacking], [day_row(), day_row(Change=1)], [day_row(), day_row(Change=None)], [day_row(), 5], [], {"a": 1}, '[{"Code": ', "", [day_row(), day_row(Code=" 1101 ")], [day_row(), day_row(Code=" ")], [day_row()]]
    good, bad = payloads.daily_snapshot(texts(spark, *whole))  # one bad record refuses its payload
    assert good.count() == 1
    assert {r.payload_id: (r.position, r.problem) for r in bad.collect()} == {str(k): (None, p) for k, p in enumerate(["field_missing", "field_not_text", "field_not_text", "item_not_an_object", "not_a_record_array", "not_a_record_array", "malformed_json", "malformed_json", "code_repeated", "code_blank"])}


def test_valuation_snapshot(spark):
    rows = [{"Date": "1130105", "Code": "1101", "Name": "C", "PEratio": "", "DividendYield": "4.5", "PBratio": "1.2"}, {"Date": "1130105", "Code": "1102", "Name": "D", "PEratio": "x", "DividendYield": "", "PBratio": ""}]
    good, bad = payloads.valuation_snapshot(texts(spark, rows))
    assert {(r.symbol, r.name, r.value, r.unit) for r in good.collect()} == {("1101", "dividend_yield_pct", 4.5, "%"), ("1101", "price_to_book_ratio", 1.2, "ratio")}
    assert [r.problem for r in bad.collect()] == ["value_invalid"]
    good, bad = payloads.valuation_snapshot(texts(spark, [{k: v for k, v in rows[0].items() if k != "PBratio"}], [], [rows[0], rows[0]]))
    assert good.count() == 0 and sorted(r.problem for r in bad.collect()) == ["code_repeated", "field_missing", "not_a_record_array"]


def month(rows, **changes):
    return {"stat": "OK", "date": "20240101", "title": "113年01月 1101 台泥 各日成交資訊", "fields": list(payloads.MONTHLY), "data": rows, "notes": [], "total": len(rows)} | changes


def test_monthly_history(spark):
    row = lambda day, *p, **c: [*[f"113/01/{day}", "1,000", "9", *(p or ("10", "11", "9", "10")), "0", "1", ""], *c.get("more", [])]
    none = ("--",) * 4
    good, bad = payloads.monthly_history(texts(spark, month([row("02"), row("03", *none), row("05")])))
    assert [(r.symbol, r.trade_date.day, r.volume) for r in good.orderBy("trade_date").collect()] == [("1101", 2, 1000), ("1101", 5, 1000)] and bad.count() == 0
    two = [row("02"), row("05")]
    cases = [
        (month([row("02"), row("04", "10", "--", "9", "10")]), "price_partial"), (month([row("05"), row("02")]), "dates_not_ascending"), (month([row("02"), row("02")]), "dates_not_ascending"), (month(two, total=3), "total_mismatch"), (month(two, total="2"), "envelope_malformed"),
        (month(two, stat="no"), "status_not_ok"), (month([], stat="no"), "no_trading_data"), (month([["113/02/05", *row("05")[1:]]]), "date_out_of_month"), (month([row("30"), ["113/01/32", *row("05")[1:]]]), "date_invalid"), (month(two, fields=list(payloads.MONTHLY)[:9]), "fields_unknown"),
        (month(two, fields=[*payloads.MONTHLY[1:], payloads.MONTHLY[0]]), "fields_unknown"), (month(two, title="1101 of January"), "title_mismatch"), (month([row("02", more=["x"])]), "row_malformed"), (month([[*row("02")[:9], 5]]), "row_malformed"), (month([row("02", "1O", "11", "9", "10")]), "number_invalid"),
        (month([row("02", "10", "11", "9", "10,5")]), "number_invalid"), (month([row("02", "10", "9", "9", "10")]), "high_not_highest"), (month([row("03", *none)]), "no_trading_data"), ({k: v for k, v in month(two).items() if k != "notes"}, "field_missing"), ("{", "malformed_json"),
    ]
    good, bad = payloads.monthly_history(texts(spark, *(p for p, _ in cases)))
    assert good.count() == 0 and {int(r.payload_id): r.problem for r in bad.collect()} == dict(enumerate(want for _, want in cases))
    asked = lambda **c: payloads.monthly_history(texts(spark, month(two), **({"symbol": "1101", "month": dt.date(2024, 1, 1), "start_date": dt.date(2024, 1, 3), "end_date": dt.date(2024, 1, 31)} | c)))
    assert [r.trade_date.day for r in asked()[0].collect()] == [5]
    assert asked(symbol="1102")[1].first().problem == "title_mismatch" and asked(month=dt.date(2024, 2, 1))[1].first().problem == "month_mismatch" and asked(start_date=dt.date(2024, 1, 6))[1].first().problem == "no_trading_data"


def test_second_source(spark):
    bar = lambda day, **c: {"date": f"2024-01-{day:02}", "open": 1.0, "high": 2.0, "low": 1.0, "close": 2.0, "volume": 5, "turnover": 1.0, "change": 0.1} | c
    whole = lambda *bars, **c: {"type": "EQUITY", "exchange": "TWSE", "market": "TSE", "symbol": "1101", "timeframe": "D", "sort": "desc", "data": list(bars)} | c
    good, bad = payloads.candles(texts(spark, whole(bar(3), bar(2), bar(1))))
    assert sorted(r.trade_date.day for r in good.collect()) == [1, 2, 3] and bad.count() == 0
    cases = [
        (whole(bar(3), bar(2), bar(2)), "date_repeated"), (whole(bar(3), bar(1, low=1.5)), "price_relation"), (whole(bar(1, open=0.0)), "price_not_positive"), (whole(bar(1, volume=-1)), "volume_invalid"), (whole(bar(1, volume=None)), "volume_invalid"), (whole(bar(1, turnover=-1.0)), "number_invalid"),
        (whole(bar(1, close=None)), "number_invalid"), (whole(bar(1, date="soon")), "date_invalid"), (whole(), "no_trading_data"), (whole(data=None), "data_not_an_array"), (whole(bar(1), timeframe="W"), "timeframe_not_daily"), (whole(bar(1), sort="up"), "sort_unknown"),
        (whole(bar(1), type="FUND"), "identity_mismatch"), (whole(bar(1), exchange="X"), "identity_mismatch"), (whole(bar(1), market=None), "identity_mismatch"), (whole(bar(1), symbol="1102"), "identity_mismatch"), (whole(bar(9)), "date_out_of_range"), ("nothing", "malformed_json"),
    ]
    good, bad = payloads.candles(texts(spark, *(p for p, _ in cases), symbol="1101", start_date=dt.date(2024, 1, 1), end_date=dt.date(2024, 1, 5)))
    assert good.count() == 0 and {int(r.payload_id): r.problem for r in bad.collect()} == dict(enumerate(want for _, want in cases))
    micros = int(dt.datetime(2024, 1, 4, 17, 0, tzinfo=dt.UTC).timestamp() * 1e6)  # one o'clock on the 5th at the exchange
    quote = {"date": "2024-01-05", "type": "EQUITY", "exchange": "TWSE", "market": "TSE", "symbol": "1101", "name": "C", "openPrice": 1.0, "highPrice": 2.0, "lowPrice": 1.0, "closePrice": 2.0, "lastUpdated": micros, "isClose": True, "total": {"tradeVolume": 7}}
    none = dict.fromkeys(("openPrice", "highPrice", "lowPrice", "closePrice"))
    good, bad = payloads.quotes(texts(spark, quote, quote | none, quote | {"date": "2024-01-04"}, quote | {"lowPrice": None}, quote | {"type": "q"}, quote | {"total": {"tradeVolume": -7}}, symbol="1101"))
    assert sorted((r.open is None, r.volume) for r in good.collect()) == [(False, 7), (True, 7)]
    assert {r.payload_id: r.problem for r in bad.collect()} == {"2": "timestamp_off_date", "3": "price_partial", "4": "identity_mismatch", "5": "volume_invalid"}
    stats = {k: quote[k] for k in ("date", "type", "exchange", "market", "symbol", "name")} | {"previousClose": 1.5, "week52High": 2.0, "week52Low": 1.0}
    good, bad = payloads.yearly_stats(texts(spark, stats, stats | {"week52Low": 3.0}, stats | {"previousClose": 0.0}, stats | {"week52High": None}, stats | {"date": ""}))
    assert good.first().high_52w == 2.0 and {r.payload_id: r.problem for r in bad.collect()} == {"1": "high_under_low", "2": "price_not_positive", "3": "price_not_positive", "4": "date_invalid"}


def test_payloads_of_files_and_their_evidence(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b"\xef\xbb\xbf" + json.dumps([day_row()]).encode())
    (tmp_path / "b.json").write_text(json.dumps([day_row()], indent=2))
    files = payloads.payload_files(spark, str(tmp_path / "*.json"))
    assert payloads.daily_snapshot(files)[0].count() == 2
    plain = json.dumps([day_row()], sort_keys=True, separators=(",", ":")).encode()
    assert {(r.payload_sha256, r.payload_size_bytes) for r in payloads.payload_evidence(files).collect()} == {(hashlib.sha256(plain).hexdigest(), len(plain))}
    assert payloads.payload_evidence(texts(spark, "{")).first().payload_sha256 is None


def test_files_and_listings(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"abc")
    got = payloads.artifacts(spark, str(tmp_path / "f")).first()
    assert (got.payload_sha256, got.payload_size_bytes) == (hashlib.sha256(b"abc").hexdigest(), 3)
    identity = payloads.identities(spark.createDataFrame([("1101", "C", "20000101"), ("11011", "D", "20000101"), ("1102", "E", ""), ("1103", "F", "0890101")], "code string, name string, listing_date string"))
    assert {(r.symbol, str(r.listing_date)) for r in identity.collect()} == {("1101", "2000-01-01"), ("1103", "2000-01-01")}
    gone = payloads.delistings(spark.createDataFrame([("1101", "C", "20200101"), ("1109", "G", "20200101"), ("1110", "H", None)], "code string, name string, delisting_date string"), identity)
    assert [r.symbol for r in gone.collect()] == ["1109"]
    members = payloads.universe_snapshot(spark, write(tmp_path / "u.json", {"market_date": "2024-01-05", "members": [{"symbol": "1101", "name": "C", "status": "inactive", "reason": "x"}]}))
    assert members.first().market_date == dt.date(2024, 1, 5)
    sinks.write_universe(members.drop("market_date"), dt.date(2024, 1, 6), str(tmp_path / "universe"))
    sinks.write_universe(members.drop("market_date").withColumn("reason", F.lit(None).cast("string")), dt.date(2024, 1, 7), str(tmp_path / "universe"))
    assert sorted((str(r.market_date), r.reason) for r in payloads.universe_snapshot(spark, str(tmp_path / "universe")).collect()) == [("2024-01-06", "x"), ("2024-01-07", None)]


def test_scalars(spark):
    col = lambda v: F.lit(v).cast("string")
    row = spark.range(1).select(
        scalar.to_integer(col("5.0")).alias("a"), scalar.to_integer(col("5.5")).alias("b"), scalar.to_number(col("1e400")).alias("c"), scalar.to_number(col("12,34")).alias("d"), scalar.roc_date(col("113/02/30")).alias("e"),
        scalar.redacted(col("failed: api_key=abc123, Authorization: Bearer xyz.1")).alias("f"), scalar.is_clean_reference(col("https://h.example/x?page=1")).alias("g"), scalar.is_clean_reference(col("https://u:p@h.example/x")).alias("h"),
        scalar.is_clean_reference(col("https://h.example/x?Token=1")).alias("i"), scalar.is_clean_reference(col("not an address")).alias("j"), scalar.canonical_json(b=F.lit(None).cast("string"), a=F.lit(1)).alias("k"), scalar.settled(F.lit(-1e-14)).alias("l"),
        scalar.previous_month_start(F.lit("2024-03-31").cast("date")).alias("m"), scalar.to_boolean(col(" Yes ")).alias("n"), scalar.to_integer(col("9007199254740993")).alias("o"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.g, row.h, row.i, row.j, row.k, str(row.l), str(row.m), row.n, row.o) == (5, None, None, None, None, True, False, False, False, '{"a":1,"b":null}', "0.0", "2024-02-01", True, 9007199254740993)
    assert "abc123" not in row.f and "xyz.1" not in row.f


def test_references_redaction_and_json(spark):
    refs = {"ftp://h.example/x": True, "dataset://d/1": True, "s3://bucket/key?part=1": True, "ftp://u@h.example/": False, "https://h.example/?X-Amz-Signature=1": False, "https://h.example/?private%5Fkey=1": False, "https://h.example/?a=1&auth": False, "https://h.example/#token=1": True, "//h.example/x": False, "": False, None: False}
    got = {r.u: r.c for r in spark.createDataFrame([(u,) for u in refs], "u string").select("u", scalar.is_clean_reference(F.col("u")).alias("c")).collect()}
    assert got == refs
    texts_ = {"token=abc": "token=[REDACTED]", "my_token=abc": "my_token=abc", "Private Key : 'a b' rest": "Private Key=[REDACTED] rest", 'password: "x, y";': "password=[REDACTED];", "bearer abc, then": "Bearer [REDACTED], then", "a\nb": "a b"}
    assert {r.m: r.c for r in spark.createDataFrame([(m,) for m in texts_], "m string").select("m", scalar.redacted(F.col("m")).alias("c")).collect()} == texts_
    values = {"null": ("null", None), "1.5": ("number", 1.5), "-2e3": ("number", -2000.0), "true": ("boolean", True), '"a\\"b"': ("string", 'a"b'), "01": (None, None), "[1]": (None, None), "": (None, None), None: (None, None), '"': (None, None)}
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", scalar.json_scalar(F.col("v")).alias("s")).collect()
    assert {r.v: (r.s.kind, next((x for x in (r.s.number, r.s.text, r.s.truth) if x is not None), None)) for r in rows} == values


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "bars")
    months = lambda f, n: f.withColumn("month", F.date_format("trade_date", "'m'yyyyMM")).withColumn("n", F.lit(n))
    key = ["symbol", "trade_date"]
    sinks.upsert(months(bars(spark, [1, 2, 20]), 9), path, key, ["n"], "month")
    twice = months(bars(spark, [2, 3], close=7.0), 1).unionByName(months(bars(spark, [3], close=8.0), 2)).unionByName(months(bars(spark, [3], close=6.0), 0))
    sinks.upsert(twice, path, key, ["n"], "month")  # the last write wins, whatever the first said of its order
    got = {r.trade_date: r.close for r in sinks.keyed_read(sinks.stored_table(spark, path), "0001").collect()}
    assert got == {D(1): 10.0, D(2): 7.0, D(3): 8.0, D(20): 10.0} and "n" not in sinks.stored_table(spark, path).columns
    old = spark.createDataFrame([(1, "x"), (4, "w")], "k int, payload_sha256 string")
    load = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (3, "a"), (3, "b"), (4, "v"), (5, None)], old.schema)
    fresh, conflicts = sinks.insert_once(load, old, ["k"])
    assert sorted(r.k for r in fresh.collect()) == [2, 5] and sorted(r.k for r in conflicts.collect()) == [3, 3, 4]
    fresh, conflicts = sinks.insert_once(load, None, ["k"])
    assert sorted(r.k for r in fresh.collect()) == [1, 2, 4, 5] and sorted(r.k for r in conflicts.collect()) == [3, 3]
    sinks.write_report(old, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_backfill_goes_on_where_it_stopped(spark, tmp_path):
    incoming, table, point = (str(tmp_path / x) for x in ("in", "table", "point"))
    bars(spark, [1, 2]).write.parquet(incoming)
    incremental.backfill(spark, incoming, table, point).awaitTermination()
    bars(spark, [2, 3]).write.mode("append").parquet(incoming)
    incremental.backfill(spark, incoming, table, point).awaitTermination()
    incremental.backfill(spark, incoming, table, point).awaitTermination()
    assert sorted(r.trade_date for r in sinks.stored_table(spark, table).collect()) == [D(1), D(2), D(3)]
    assert {r.source for r in sinks.stored_table(spark, table).collect()} == {"primary"}
    bars(spark, [3], "primary", close=3.0).write.mode("append").parquet(incoming)
    bars(spark, [3], "secondary", close=4.0).write.mode("append").parquet(incoming)
    incremental.backfill(spark, incoming, table, point).awaitTermination()  # a later row wins over its own source's alone
    assert sorted((r.source, r.close) for r in sinks.stored_table(spark, table).where(F.col("trade_date") == F.lit(D(3))).collect()) == [("primary", 3.0), ("secondary", 4.0)]
    assert incremental.backfill_state(sinks.stored_table(spark, table), 4, 1).first().state == "out_of_months" and incremental.backfill_state(sinks.stored_table(spark, table), 3, 1).first().state == "complete"


def test_backfill_stops_at_enough_rows(spark, tmp_path):
    incoming, table = str(tmp_path / "in"), str(tmp_path / "table")
    for k in range(4):  # a file a load, in order
        bars(spark, [3 * k + 1, 3 * k + 2, 3 * k + 3]).coalesce(1).write.mode("append").parquet(incoming)
        bars(spark, [3 * k + 1], symbol="0002").coalesce(1).write.mode("append").parquet(incoming)
        incremental.backfill(spark, incoming, table, str(tmp_path / "p"), per_trigger=2, target_rows=5).awaitTermination()
    assert {r.symbol: r["count"] for r in sinks.stored_table(spark, table).groupBy("symbol").count().collect()} == {"0001": 6, "0002": 4}


def test_backfill_by_month_stops_where_it_should(spark, tmp_path):
    names = ("in", "table", "waiting", "cursor", "point")
    incoming, table, waiting, cursor, point = (str(tmp_path / x) for x in names)
    day = lambda y, m, d: dt.date(y, m, d)

    def month(y, m, days, symbol="0001"):
        rows = [(symbol, day(y, m, d), 1.0, 1.0, 1.0, 1.0, 1, "primary") for d in days]
        spark.createDataFrame(rows, BARS).coalesce(1).write.mode("append").parquet(incoming)

    def run():
        incremental.backfill_by_month(spark, incoming, table, waiting, cursor, point, day(2024, 3, 20), target_rows=6, max_months=3).awaitTermination()
        return {r.symbol: (r.bars, r.months, r.next_month, r.state) for r in incremental.month_cursors(sinks.stored_table(spark, cursor), day(2024, 3, 20), 6, 3).collect()}

    month(2024, 1, [3, 4, 5])  # February lacks: March alone is taken, without the days after the target
    month(2024, 3, [4, 5, 21, 22])
    month(2024, 2, [1, 2], "0002")  # no March: nothing is taken
    assert run() == {"0001": (2, 1, day(2024, 2, 1), "pending")}
    month(2024, 2, [6, 7])
    month(2023, 12, [6, 7])
    month(2024, 3, [1])  # a month that was taken isn't taken again
    month(2024, 3, [6], "0002")
    month(2024, 1, [6], "0002")
    month(2023, 12, [6, 7, 8], "0002")
    assert run() == {"0001": (7, 3, day(2023, 12, 1), "complete"), "0002": (4, 3, day(2023, 12, 1), "out_of_months")}
    month(2023, 12, [1])
    assert run()["0001"] == (7, 3, day(2023, 12, 1), "complete")
    got = sorted(r.trade_date for r in sinks.stored_table(spark, table).where("symbol = '0001'").collect())
    assert got == [day(2024, 1, 3), day(2024, 1, 4), day(2024, 1, 5), day(2024, 2, 6), day(2024, 2, 7), day(2024, 3, 4), day(2024, 3, 5)]


def test_late_bars_open_child_versions_once(spark, tmp_path):
    incoming, store = (str(tmp_path / x) for x in ("in", "store"))
    need = spark.createDataFrame([("0001", D(t), D(k)) for t in (4, 5) for k in range(1, t + 1)], "symbol string, target_date date, trade_date date")
    made, rows = versions.build(bars(spark, range(1, 4)), bars(spark, range(1, 6), "secondary"), bars(spark, [], "secondary"), need)
    others = [bars(spark, range(1, 6), symbol=f"{k:04}") for k in range(2, 40)]
    for n, other in enumerate(others):
        every = other if not n else every.unionByName(other)
    more, more_rows = versions.build(every, every.where("1 = 0"), every.where("1 = 0"), every.select("symbol", "trade_date"), D(5))
    incremental.store_versions(made.unionByName(more), rows.unionByName(more_rows), store)
    bars(spark, [4]).write.parquet(incoming)
    for point in ("p1", "p1", "p2"):  # the last time from the start again
        incremental.reconcile_arrivals(spark, incoming, store, str(tmp_path / point)).awaitTermination()
    got = lambda: sorted((r.target_date, r.status, r.supplemental) for r in incremental.stored_versions(spark, store)[0].where("symbol = '0001'").collect())
    assert got() == [(D(4), "provisional_complete", 1), (D(4), "reconciled_equal", 0), (D(5), "provisional_complete", 2), (D(5), "reconciliation_pending", 1)]
    bars(spark, [5], close=11.0).write.mode("append").parquet(incoming)
    incremental.reconcile_arrivals(spark, incoming, store, str(tmp_path / "p1")).awaitTermination()
    assert got()[-2:] == [(D(5), "reconciled_discrepant", 0), (D(5), "reconciliation_pending", 1)]
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit("0001")), F.lit(incremental.BUCKETS)).cast("int")).first()[0]
    read = incremental.stored_versions(spark, store, [bucket])[1]
    scan = read._jdf.queryExecution().executedPlan().collectLeaves().head()
    read.collect()
    files = lambda t: len({r[0] for r in t.select(F.input_file_name()).collect()})
    assert files(read) < files(incremental.stored_versions(spark, store)[1]) / 5
    assert "PartitionFilters: [" in scan.toString() and "bucket" in scan.toString()


def test_replay_keeps_the_stored_result(spark, tmp_path):
    incoming, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "k int, v string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(incoming)
    incremental.replay(spark, incoming, schema, table, ["k"], str(tmp_path / "p")).awaitTermination()
    spark.createDataFrame([(1, "z"), (3, "c")], schema).write.mode("append").parquet(incoming)
    incremental.replay(spark, incoming, schema, table, ["k"], str(tmp_path / "p")).awaitTermination()
    assert sorted((r.k, r.v) for r in sinks.stored_table(spark, table).collect()) == [(1, "a"), (2, "b"), (3, "c")]
