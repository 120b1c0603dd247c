"""The queries of ``reading`` in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

_MONTHS = """
months AS (SELECT symbol, supplier, date_trunc('month', trade_date) AS month, (supplier + month(min(trade_date))) % 20 AS k FROM b GROUP BY symbol, supplier, date_trunc('month', trade_date)),
month_problems AS (SELECT *, CASE k WHEN 1 THEN 'price_partial' WHEN 2 THEN 'no_trading_data' WHEN 3 THEN 'date_out_of_month' WHEN 4 THEN 'number_invalid' WHEN 5 THEN 'row_malformed' WHEN 6 THEN 'title_mismatch' WHEN 7 THEN 'status_not_ok' WHEN 8 THEN 'fields_unknown' WHEN 9 THEN 'total_mismatch' END AS problem FROM months)"""

_YEARS = """
years AS (SELECT symbol, year(trade_date) AS y, (CAST(symbol AS INT) + year(trade_date)) % 16 AS k, max(trade_date) AS last_date FROM b2 GROUP BY symbol, year(trade_date)),
year_problems AS (SELECT *, CASE k WHEN 1 THEN 'price_relation' WHEN 2 THEN 'volume_invalid' WHEN 3 THEN 'date_invalid' WHEN 4 THEN 'date_repeated' WHEN 5 THEN 'no_trading_data' WHEN 6 THEN 'price_not_positive' WHEN 7 THEN 'identity_mismatch' WHEN 8 THEN 'timeframe_not_daily' WHEN 9 THEN 'malformed_json'
  WHEN 10 THEN CASE WHEN last_date > make_date(y, 1, 1) THEN 'date_out_of_range' END END AS problem FROM years)"""

_QUOTED = "quoted AS (SELECT *, (CAST(symbol AS INT) + dayofyear(trade_date)) % 10 AS k FROM b2)"

_BAR = ("open", "high", "low", "close")


def oracle_sql(with_: Callable[..., str], r: Callable[..., str]) -> dict[str, str]:
    d = "(SELECT d FROM best)"
    bar = r(*_BAR)
    return {
        "snapshot_bars": with_(f"SELECT symbol, 'N' || symbol AS name, trade_date, {bar}, volume, source FROM b WHERE day(trade_date) NOT BETWEEN 5 AND 12 AND day(trade_date) NOT IN (14, 15)"),
        "snapshot_rejects": with_(
            """SELECT problem, whole, n FROM (SELECT 'field_missing' AS problem, true AS whole, count(DISTINCT trade_date) FILTER (day(trade_date) = 5) AS n FROM b UNION ALL SELECT 'malformed_json', true, count(DISTINCT trade_date) FILTER (day(trade_date) = 6) FROM b
            UNION ALL SELECT 'not_a_record_array', true, count(DISTINCT trade_date) FILTER (day(trade_date) = 7) FROM b UNION ALL SELECT 'field_not_text', true, count(DISTINCT trade_date) FILTER (day(trade_date) = 8) FROM b
            UNION ALL SELECT 'code_repeated', true, count(DISTINCT trade_date) FILTER (day(trade_date) = 14) FROM b UNION ALL SELECT 'code_blank', true, count(DISTINCT trade_date) FILTER (day(trade_date) = 15) FROM b
            UNION ALL SELECT 'number_invalid', false, count(*) FILTER (day(trade_date) IN (11, 12)) FROM b UNION ALL SELECT 'price_unavailable', false, count(*) FILTER (day(trade_date) = 9) FROM b UNION ALL SELECT 'high_not_highest', false, count(*) FILTER (day(trade_date) = 10) FROM b) WHERE n > 0"""
        ),
        "snapshot_ratios": with_(
            f"""SELECT symbol, metric_date, name, {r('value')}, unit, source FROM (
              SELECT symbol, trade_date AS metric_date, 'price_earnings_ratio' AS name, floor(close * 100 / (1 + supplier % 7)) / 100 AS value, 'ratio' AS unit, 'primary' AS source FROM b WHERE (supplier + day(trade_date)) % 11 <> 0 AND day(trade_date) NOT IN (12, 13)
              UNION ALL SELECT symbol, trade_date, 'price_to_book_ratio', close / 50, 'ratio', 'primary' FROM b WHERE day(trade_date) <> 13)"""
        ),
        "snapshot_ratio_rejects": with_(
            """SELECT * FROM (SELECT 'code_blank' AS problem, count(DISTINCT trade_date) FILTER (day(trade_date) = 13) AS n FROM b UNION ALL SELECT 'value_invalid', count(*) FILTER (day(trade_date) = 12 AND (supplier + 12) % 11 <> 0) FROM b) WHERE n > 0"""
        ),
        "month_bars": with_(f"SELECT symbol, trade_date, {bar}, volume, source FROM b WHERE (symbol, date_trunc('month', trade_date)) IN (SELECT (symbol, month) FROM month_problems WHERE problem IS NULL)", _MONTHS),
        "month_rejects": with_("SELECT symbol || '/' || strftime(month, '%Y-%m') AS payload_id, problem FROM month_problems WHERE problem IS NOT NULL", _MONTHS),
        "candle_bars": with_(f"SELECT symbol, trade_date, {bar}, volume, source FROM b2 WHERE (symbol, year(trade_date)) IN (SELECT (symbol, y) FROM year_problems WHERE problem IS NULL)", _YEARS),
        "candle_rejects": with_("SELECT symbol || '/' || y AS payload_id, problem FROM year_problems WHERE problem IS NOT NULL", _YEARS),
        "quote_rows": with_(f"SELECT symbol, 'N' || symbol AS name, trade_date, {bar}, volume, source FROM quoted WHERE k NOT IN (1, 2, 3)", _QUOTED),
        "quote_rejects": with_("SELECT CASE k WHEN 1 THEN 'price_partial' WHEN 2 THEN 'identity_mismatch' ELSE 'timestamp_off_date' END AS problem, count(*) AS n FROM quoted WHERE k IN (1, 2, 3) GROUP BY k", _QUOTED),
        "yearly_rows": with_(
            f"""SELECT problem, n, {r('highest', 'lowest')} FROM (SELECT CASE k WHEN 2 THEN 'identity_mismatch' WHEN 4 THEN 'price_not_positive' WHEN 5 THEN 'high_under_low' ELSE 'kept' END AS problem, count(*) AS n, max(CASE WHEN k NOT IN (2, 4, 5) THEN high END) AS highest, min(CASE WHEN k NOT IN (2, 4, 5) THEN low END) AS lowest FROM quoted GROUP BY 1)""", _QUOTED
        ),
        "listings": with_(
            """SELECT symbol, 'listed' AS kind, DATE '2000-01-03' AS day FROM names WHERE supplier % 9 NOT IN (1, 2, 3) UNION ALL SELECT symbol, 'delisted', DATE '2021-01-05' FROM names WHERE supplier % 9 IN (1, 2, 3) AND supplier % 3 <> 0"""
        ),
        "common_names": with_("SELECT symbol, supplier % 4 <> 3 AS alike FROM names WHERE supplier % 5 NOT IN (1, 2)"),
        "payload_evidence": """SELECT n_nationkey || '/' || form AS payload_id, CASE WHEN form <> 'cut' THEN sha256(body) END AS payload_sha256, CASE WHEN form <> 'cut' THEN CAST(strlen(body) AS BIGINT) END AS payload_size_bytes, 'canonical-json-v1' AS hash_basis
            FROM (SELECT n_nationkey, '{"key":' || n_nationkey || ',"name":"' || n_name || '"}' AS body FROM nation), (VALUES ('tidy'), ('loose'), ('cut')) AS f(form)""",
        "payload_files": """SELECT count(*) AS lines, CAST(sum(strlen('{"key":' || n_nationkey || ',"name":"' || n_name || '"}') + 1) AS BIGINT) AS bytes FROM nation""",
        "price_classes": with_("SELECT CASE day(trade_date) WHEN 2 THEN 'unavailable' WHEN 4 THEN 'malformed' ELSE 'available' END AS price_class, count(*) AS n FROM b GROUP BY 1"),
        "payload_problems": with_(
            """SELECT symbol, status, count(*) AS n FROM (SELECT symbol, CASE WHEN day(trade_date) % 5 = 0 THEN 'missing_source' ELSE 'available' END AS status, day(trade_date) % 7 <> 0 AND day(trade_date) % 11 <> 0 AS there FROM b) WHERE (status = 'available') <> there GROUP BY symbol, status"""
        ),
        "redacted_messages": """SELECT k, left(line, 30) AS message, CASE WHEN k % 7 = 0 THEN 'ReadError' ELSE left('ReadError: ' || line, 40) END AS told FROM (
            SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'token=[REDACTED], retry' WHEN 1 THEN 'no API-Key=[REDACTED];' WHEN 2 THEN 'x&password=[REDACTED]&y' WHEN 3 THEN 'Authorization: Bearer [REDACTED]' WHEN 4 THEN 'order ' || o_orderkey || ' failed' ELSE 'line secret=[REDACTED]' END AS line FROM orders)""",
        "clean_references": "SELECT o_orderkey AS k, o_orderkey % 9 IN (0, 3) AS clean FROM orders",
        "json_scalars": f"""SELECT k, kind, {r('number')}, text, truth FROM (SELECT o_orderkey AS k, CASE o_orderkey % 9 WHEN 0 THEN 'null' WHEN 1 THEN 'boolean' WHEN 2 THEN 'number' WHEN 3 THEN 'string' WHEN 6 THEN 'number' END AS kind, CASE o_orderkey % 9 WHEN 2 THEN o_orderkey + 0.5 WHEN 6 THEN CAST(o_orderkey AS DOUBLE) END AS number,
            CASE WHEN o_orderkey % 9 = 3 THEN 'a' || o_orderkey || chr(10) END AS text, CASE WHEN o_orderkey % 9 = 1 THEN true END AS truth FROM orders)""",
        "upserts": with_(
            """SELECT symbol, trade_date, CASE WHEN day(trade_date) IN (4, 9) THEN -volume WHEN day(trade_date) = 16 THEN volume + 8 WHEN day(trade_date) >= 15 THEN volume + 7 ELSE volume END AS volume,
            CASE day(trade_date) WHEN 4 THEN 'm' || year(trade_date) || 'b' WHEN 9 THEN NULL ELSE 'm' || year(trade_date) END AS year FROM b"""
        ),
        "insert_conflicts": with_(
            """SELECT symbol, outcome, CAST(sum(n) AS BIGINT) AS n FROM (SELECT symbol, CASE WHEN day(trade_date) % 5 = 0 OR (day(trade_date) % 3 = 0 AND day(trade_date) % 2 = 0) THEN 'conflict' WHEN day(trade_date) % 2 = 1 THEN 'appended' END AS outcome, CASE WHEN day(trade_date) % 5 = 0 THEN 2 ELSE 1 END AS n FROM b) WHERE outcome IS NOT NULL GROUP BY symbol, outcome"""
        ),
        "keyed_reads": with_(f"SELECT symbol, trade_date, {r('close')}, volume FROM b WHERE symbol = '0003' AND trade_date BETWEEN DATE '1999-01-01' AND DATE '2001-12-31'"),
        "report_files": with_(
            f"""SELECT names.symbol, max(trade_date) AS latest_date, count(trade_date) AS observations, CASE WHEN max(trade_date) IS NULL THEN 'missing_source' WHEN max(trade_date) = {d} THEN 'available' ELSE 'market_date_mismatch' END AS price_status FROM names LEFT JOIN b ON b.symbol = names.symbol AND trade_date <= {d} AND b.supplier % 7 <> 3 GROUP BY names.symbol"""
        ),
        "backfills": with_("SELECT symbol, trade_date, volume + CASE WHEN day(trade_date) >= 15 THEN 7 ELSE 0 END AS volume, source FROM b"),
        "backfill_states": with_(
            """SELECT symbol, bars, months, CASE WHEN bars >= 500 THEN 'complete' WHEN months >= 20 THEN 'out_of_months' ELSE 'pending' END AS state FROM (SELECT symbol, count(*) AS bars, count(DISTINCT date_trunc('month', trade_date)) AS months FROM b WHERE supplier % 4 <> 0 OR year(trade_date) < 1997 GROUP BY symbol)"""
        ),
        "backfill_months": with_(
            f"""SELECT symbol, CAST(sum(bars) AS BIGINT) AS bars, count(*) AS months, CAST(date_trunc('month', {d}) - to_months(CAST(count(*) AS INT)) AS DATE) AS next_month, CASE WHEN sum(bars) >= 45 THEN 'complete' WHEN count(*) >= 8 THEN 'out_of_months' ELSE 'pending' END AS state,
            CAST(sum(bars) AS BIGINT) AS stored, min(first_date) AS first_date FROM taken GROUP BY symbol""",
            f"""monthly AS (SELECT symbol, date_diff('month', date_trunc('month', trade_date), date_trunc('month', {d})) AS back, count(*) AS bars, min(trade_date) AS first_date FROM b WHERE trade_date <= {d} AND (supplier % 5 <> 2 OR month(trade_date) % 4 <> 0) GROUP BY symbol, back),
            taken AS (SELECT * FROM (SELECT *, row_number() OVER w - 1 AS place, coalesce(sum(bars) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM monthly WINDOW w AS (PARTITION BY symbol ORDER BY back)) WHERE back = place AND before < 45 AND place < 8)""",
        ),
        "late_arrivals": with_(
            """SELECT symbol, target_date, status, count(*) AS versions, CAST(sum(canonical) AS BIGINT) AS canonical, CAST(sum(wrong) AS BIGINT) AS discrepancies FROM (
              SELECT symbol, target_date, CASE WHEN late = 0 THEN 'canonical_complete' ELSE 'provisional_complete' END AS status, n - late AS canonical, 0 AS wrong FROM arrivals UNION ALL SELECT symbol, target_date, CASE WHEN wrong > 0 THEN 'reconciled_discrepant' ELSE 'reconciled_equal' END, n, wrong FROM arrivals WHERE late > 0 AND supplier % 3 <> 1) GROUP BY symbol, target_date, status""",
            """arrivals AS (SELECT symbol, supplier, target_date, count(*) AS n, count(*) FILTER (day(trade_date) >= 20) AS late, count(*) FILTER (day(trade_date) IN (27, 28)) AS wrong FROM (SELECT b.*, t.d AS target_date, row_number() OVER (PARTITION BY symbol, t.d ORDER BY trade_date DESC) AS rn FROM b JOIN (SELECT d FROM best UNION ALL SELECT d FROM prior) t ON trade_date <= t.d) WHERE rn <= 60 GROUP BY symbol, supplier, target_date)""",
        ),
        "replays": with_("SELECT symbol, trade_date AS market_date, volume + CASE WHEN day(trade_date) > 20 THEN 7 ELSE 0 END AS volume FROM b"),
    }
