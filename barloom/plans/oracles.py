"""The registered queries in DuckDB SQL, on the same tables."""

from __future__ import annotations

from barloom.plans import reading_sql
from barloom.plans.panel import PLACES, SETTLED

_BARS = """
raw AS (
  SELECT l_suppkey AS supplier, printf('%04d', l_suppkey) AS symbol, CAST(l_shipdate AS DATE) AS trade_date, floor(10000 + 5000 * l_discount + l_extendedprice / 1000) / 100 AS px,
         l_quantity, l_discount, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
), b AS (
  SELECT supplier, symbol, trade_date, first(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount) AS open, max(px) AS high, min(px) AS low,
         last(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume, 'primary' AS source, max(l_discount) AS top_discount
  FROM raw GROUP BY supplier, symbol, trade_date
), b2 AS (
  SELECT symbol, trade_date, open, high + CASE WHEN day(trade_date) = 27 THEN 0.01 ELSE 0.0 END AS high, low, close + CASE WHEN day(trade_date) = 27 THEN 0.01 ELSE 0.0 END AS close,
         volume + CASE WHEN day(trade_date) = 28 THEN 1000 ELSE 0 END AS volume, 'secondary' AS source FROM b WHERE day(trade_date) <> 13
), ratios AS (
  SELECT symbol, trade_date AS metric_date, 'price_earnings_ratio' AS name, close / (1 + supplier % 7) AS value, 'ratio' AS unit, 'primary' AS source FROM b WHERE (supplier + day(trade_date)) % 11 <> 0
  UNION ALL SELECT symbol, trade_date, 'price_to_book_ratio', close / 50, 'ratio', 'primary' FROM b
  UNION ALL SELECT symbol, trade_date, 'dividend_yield_pct', 100 * top_discount, '%', 'primary' FROM b
), names AS (SELECT s_suppkey AS supplier, printf('%04d', s_suppkey) AS symbol, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
best AS (SELECT trade_date AS d FROM b WHERE trade_date >= DATE '2000-06-01' GROUP BY trade_date ORDER BY count(*) DESC, trade_date DESC LIMIT 1),
prior AS (SELECT max(trade_date) AS d FROM b WHERE trade_date < (SELECT d FROM best))"""

_PANEL = """
daily AS (SELECT *, CASE WHEN lag(close) OVER w > 0 THEN close / lag(close) OVER w - 1 END AS r FROM b WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
panel AS (
  SELECT symbol, trade_date, close, volume, r * 100 AS return_1d, (close / lag(close, 20) OVER w - 1) * 100 AS return_20d, (close / lag(close, 60) OVER w - 1) * 100 AS return_60d,
    (close / lag(close, 120) OVER w - 1) * 100 AS return_120d, (close / lag(close, 250) OVER w - 1) * 100 AS return_250d,
    CASE WHEN count(*) OVER w20 = 20 THEN avg(close) OVER w20 END AS ma_20, CASE WHEN count(*) OVER w60 = 60 THEN avg(close) OVER w60 END AS ma_60,
    CASE WHEN count(*) OVER w120 = 120 THEN avg(close) OVER w120 END AS ma_120, CASE WHEN count(*) OVER w250 = 250 THEN avg(close) OVER w250 END AS ma_250,
    CASE WHEN count(*) OVER w20 = 20 THEN avg(volume) OVER w20 END AS volume_avg_20, count(r) OVER w60 AS volatility_observations,
    CASE WHEN count(r) OVER w60 >= 2 THEN stddev_pop(r) OVER w60 * 100 END AS volatility_60d
  FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY trade_date), w20 AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING), w60 AS (PARTITION BY symbol ORDER BY trade_date ROWS 59 PRECEDING),
    w120 AS (PARTITION BY symbol ORDER BY trade_date ROWS 119 PRECEDING), w250 AS (PARTITION BY symbol ORDER BY trade_date ROWS 249 PRECEDING)
), states AS (
  SELECT *, (close / ma_20 - 1) * 100 AS ma_distance_20d, (close / ma_60 - 1) * 100 AS ma_distance_60d, (close / ma_120 - 1) * 100 AS ma_distance_120d, (close / ma_250 - 1) * 100 AS ma_distance_250d,
    volume / volume_avg_20 AS volume_ratio_20d,
    CASE WHEN volume_avg_20 IS NULL THEN 'insufficient' WHEN volume / volume_avg_20 >= 2 THEN 'high' WHEN volume / volume_avg_20 <= 0.5 THEN 'low' ELSE 'normal' END AS volume_state FROM panel
)"""

_UNIVERSE = """
today AS (SELECT b.supplier, b.symbol, name FROM b JOIN names USING (symbol) WHERE trade_date = (SELECT d FROM best)),
told AS (SELECT symbol, name || mark AS name, listing FROM (SELECT symbol, name, CASE WHEN supplier % 43 = 8 THEN (SELECT d FROM best) + 30 ELSE DATE '1990-01-01' END AS listing, unnest(CASE WHEN supplier % 47 = 9 THEN ['', ' B'] WHEN supplier % 7 = 0 THEN ['', ''] ELSE [''] END) AS mark FROM names WHERE supplier % 10 <> 9)),
ident AS (SELECT symbol, min(name) AS name, min(listing) AS listing FROM told GROUP BY symbol),
clash AS (SELECT symbol FROM told GROUP BY symbol HAVING count(DISTINCT name) > 1),
trading AS (SELECT symbol, name || CASE WHEN supplier % 41 = 6 THEN ' X' ELSE '' END AS name, supplier % 29 <> 1 AS price_available FROM today),
valued AS (SELECT symbol, name FROM today WHERE supplier % 31 <> 2),
classed AS (SELECT symbol, CASE WHEN supplier % 13 = 5 THEN 'etf' WHEN supplier % 17 = 3 THEN 'tdr' WHEN supplier % 19 = 7 THEN 'unknown' ELSE 'common_stock' END AS class FROM names WHERE supplier % 37 <> 4),
gone AS (SELECT symbol, name FROM names WHERE supplier % 23 = 11),
keys AS (SELECT symbol FROM ident UNION SELECT symbol FROM trading UNION SELECT symbol FROM valued UNION SELECT symbol FROM classed),
judged AS (
  SELECT k.symbol, coalesce(i.name, t.name, v.name, g.name) AS name,
    CASE WHEN x.symbol IS NOT NULL THEN 'feed_conflict' WHEN i.name <> t.name OR i.name <> v.name OR i.name <> g.name OR t.name <> v.name OR t.name <> g.name OR v.name <> g.name THEN 'identity_conflict'
         WHEN i.listing > (SELECT d FROM best) THEN 'listing_after_day' WHEN g.symbol IS NOT NULL THEN 'delisted' WHEN c.symbol IS NULL THEN 'classification_missing' WHEN class = 'unknown' THEN 'classification_unknown' WHEN class IN ('etf', 'tdr') THEN class
         WHEN i.symbol IS NULL THEN 'identity_missing' WHEN t.symbol IS NULL AND v.symbol IS NULL THEN 'both_feeds_missing' WHEN t.symbol IS NULL THEN 'trading_missing'
         WHEN NOT price_available THEN 'price_unavailable' WHEN v.symbol IS NULL THEN 'valuation_missing' END AS reason
  FROM keys k LEFT JOIN ident i USING (symbol) LEFT JOIN trading t USING (symbol) LEFT JOIN valued v USING (symbol) LEFT JOIN classed c USING (symbol) LEFT JOIN gone g USING (symbol) LEFT JOIN clash x USING (symbol)
), members AS (
  SELECT symbol, name, CASE WHEN reason IS NULL THEN 'active_scan_eligible' WHEN reason = 'delisted' THEN 'inactive' WHEN reason IN ('etf', 'tdr') THEN 'excluded_non_common_equity'
    WHEN reason IN ('both_feeds_missing', 'trading_missing', 'price_unavailable', 'valuation_missing') THEN 'active_scan_unavailable' ELSE 'classification_unresolved' END AS status, reason FROM judged
)"""

# The rules of the first screen.
_RULES = """
rules(code, metric, component, role, op, threshold, class_priority, reason_order) AS (VALUES
  ('price_change_1d_threshold', 'price_change_1d', NULL, 'primary', 'abs_current_gte', 3.0, 10, 10), ('volume_anomaly_high', 'volume_anomaly', NULL, 'primary', 'current_gte', 2.0, 20, 20),
  ('volume_anomaly_low_context', 'volume_anomaly', NULL, 'secondary', 'current_lte', 0.5, 90, 30), ('return_20d_delta_threshold', 'return_20d_change', NULL, 'primary', 'abs_delta_gte', 1.0, 30, 40),
  ('volatility_60d_delta_threshold', 'volatility_regime_change', NULL, 'primary', 'abs_delta_gte', 1.0, 40, 50), ('ma20_distance_delta_threshold', 'ma_distance_change', NULL, 'primary', 'abs_delta_gte', 1.0, 30, 60),
  ('valuation_pe_availability_transition', 'valuation_update', 'pe_ratio', 'primary', 'availability_changed', NULL, 50, 70), ('valuation_pe_relative_change', 'valuation_update', 'pe_ratio', 'primary', 'abs_delta_gte', 10.0, 50, 80),
  ('valuation_pb_availability_transition', 'valuation_update', 'pb_ratio', 'primary', 'availability_changed', NULL, 50, 90), ('valuation_pb_relative_change', 'valuation_update', 'pb_ratio', 'primary', 'abs_delta_gte', 10.0, 50, 100),
  ('valuation_yield_availability_transition', 'valuation_update', 'dividend_yield', 'primary', 'availability_changed', NULL, 50, 110), ('valuation_yield_delta_threshold', 'valuation_update', 'dividend_yield', 'primary', 'abs_delta_gte', 0.5, 50, 120))"""

_FIRST = (
    """
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn FROM b WHERE trade_date <= (SELECT d FROM best)),
capped AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS r FROM ranked WHERE rn <= 62),
inputs AS (
  SELECT symbol, count(*) AS n, max(trade_date) AS latest_date, max(close) FILTER (rn = 1) AS c1, max(close) FILTER (rn = 2) AS c2, max(close) FILTER (rn = 3) AS c3, max(close) FILTER (rn = 21) AS c21, max(close) FILTER (rn = 22) AS c22,
    max(volume) FILTER (rn = 1) AS v1, max(volume) FILTER (rn = 2) AS v2, avg(volume) FILTER (rn BETWEEN 2 AND 21) AS v_now, avg(volume) FILTER (rn BETWEEN 3 AND 22) AS v_then,
    stddev_samp(r) FILTER (rn <= 60) AS s_now, stddev_samp(r) FILTER (rn BETWEEN 2 AND 61) AS s_then, avg(close) FILTER (rn <= 20) AS m_now, avg(close) FILTER (rn BETWEEN 2 AND 21) AS m_then FROM capped GROUP BY symbol
), joined AS (SELECT names.symbol, coalesce(n, 0) AS n, CASE WHEN latest_date IS NULL THEN 'missing_source' WHEN latest_date = (SELECT d FROM best) THEN 'available' ELSE 'market_date_mismatch' END AS ps, inputs.* EXCLUDE (symbol, n) FROM names LEFT JOIN inputs USING (symbol)),
prices AS (
  SELECT symbol, 'price_change_1d' AS metric, n, ps, 3 AS need, (c2 / c3 - 1) * 100 AS then_, (c1 / c2 - 1) * 100 AS now_ FROM joined
  UNION ALL SELECT symbol, 'volume_anomaly', n, ps, 22, v2 / v_then, v1 / v_now FROM joined
  UNION ALL SELECT symbol, 'return_20d_change', n, ps, 22, (c2 / c22 - 1) * 100, (c1 / c21 - 1) * 100 FROM joined
  UNION ALL SELECT symbol, 'volatility_regime_change', n, ps, 62, s_then * sqrt(252) * 100, s_now * sqrt(252) * 100 FROM joined
  UNION ALL SELECT symbol, 'ma_distance_change', n, ps, 21, (c2 / m_then - 1) * 100, (c1 / m_now - 1) * 100 FROM joined
), v_now AS (SELECT symbol, name, arg_max(value, metric_date) AS v FROM ratios WHERE metric_date <= (SELECT d FROM best) GROUP BY symbol, name),
v_then AS (SELECT symbol, name, arg_max(value, metric_date) AS v FROM ratios WHERE metric_date <= (SELECT d FROM prior) GROUP BY symbol, name),
grid AS (SELECT symbol, k.name, component FROM names, (VALUES ('price_earnings_ratio', 'pe_ratio'), ('price_to_book_ratio', 'pb_ratio'), ('dividend_yield_pct', 'dividend_yield')) AS k(name, component)),
sides AS (SELECT grid.symbol, component, a.v AS now_, z.v AS then_, count(a.v) OVER w > 0 AND count(z.v) OVER w > 0 AS two_sided FROM grid LEFT JOIN v_now a USING (symbol, name) LEFT JOIN v_then z USING (symbol, name) WINDOW w AS (PARTITION BY grid.symbol)),
values_ AS (
  SELECT symbol, component, now_, then_, CASE WHEN NOT two_sided OR (now_ IS NULL AND then_ IS NULL) THEN 'valuation_unavailable' WHEN now_ IS NOT NULL AND then_ IS NOT NULL AND component <> 'dividend_yield' AND (now_ <= 0 OR then_ <= 0) THEN 'invalid_denominator' ELSE 'available' END AS status,
    CASE WHEN component = 'dividend_yield' THEN now_ - then_ ELSE (now_ / then_ - 1) * 100 END AS delta FROM sides
), metrics AS (
  SELECT symbol, metric, CAST(NULL AS VARCHAR) AS component, status, CASE WHEN status = 'available' THEN round(then_, 12) END AS previous, CASE WHEN status = 'available' THEN round(now_, 12) END AS current, CASE WHEN status = 'available' THEN round(round(now_, 12) - round(then_, 12), 12) END AS delta
  FROM (SELECT *, CASE WHEN ps <> 'available' THEN ps WHEN n < need THEN 'insufficient_history' ELSE 'available' END AS status FROM prices)
  UNION ALL SELECT symbol, 'valuation_update', component, status, CASE WHEN status = 'available' THEN round(then_, 12) END, CASE WHEN status = 'available' THEN round(now_, 12) END, CASE WHEN status = 'available' THEN round(delta, 12) END FROM values_
),"""
    + _RULES
    + """,
sized AS (
  SELECT m.symbol, r.code, m.metric, m.component, m.previous, m.current, m.delta, r.role, r.op, r.threshold, r.class_priority, r.reason_order,
    CASE op WHEN 'abs_current_gte' THEN abs(current) WHEN 'abs_delta_gte' THEN abs(delta) ELSE current END AS size
  FROM metrics m JOIN rules r ON m.metric = r.metric AND m.component IS NOT DISTINCT FROM r.component WHERE status = 'available'
), reasons AS (
  SELECT *, round(CASE WHEN op = 'availability_changed' THEN 1.0 WHEN op = 'current_lte' THEN CASE WHEN current > 0 THEN threshold / current ELSE 1.0 END ELSE greatest(size, 0.0) / threshold END, 12) AS threshold_multiple
  FROM sized WHERE CASE WHEN op = 'availability_changed' THEN (previous IS NULL) <> (current IS NULL) WHEN op = 'current_lte' THEN current <= threshold ELSE size >= threshold END
), evaluated AS (
  SELECT symbol, CASE WHEN available = n THEN 'clean' WHEN available > 0 THEN 'warning' ELSE 'unavailable' END AS quality, coalesce(primary_reasons, 0) AS primary_reasons, coalesce(secondary_reasons, 0) AS secondary_reasons, class_priority, threshold_multiple, coalesce(codes, '') AS codes
  FROM (SELECT symbol, count(*) AS n, count(*) FILTER (status = 'available') AS available FROM metrics GROUP BY symbol) LEFT JOIN (
    SELECT symbol, count(*) FILTER (role = 'primary') AS primary_reasons, count(*) FILTER (role <> 'primary') AS secondary_reasons, min(class_priority) FILTER (role = 'primary') AS class_priority, max(threshold_multiple) FILTER (role = 'primary') AS threshold_multiple,
      string_agg(code, ',' ORDER BY reason_order) AS codes FROM reasons GROUP BY symbol) USING (symbol)
), candidates AS (
  SELECT *, row_number() OVER (ORDER BY primary_reasons DESC, class_priority, threshold_multiple DESC, symbol) AS rank FROM evaluated WHERE primary_reasons > 0 QUALIFY rank <= 30
)"""
)

_SOURCES = """
latest AS (
  SELECT coalesce(a.symbol, z.symbol) AS symbol, a.d AS left_date, z.d AS right_date, a.v AS l, z.v AS r
  FROM (SELECT symbol, max(trade_date) AS d, arg_max({'open': open, 'high': high, 'low': low, 'close': close, 'volume': volume}, trade_date) AS v FROM b WHERE trade_date <= (SELECT d FROM best) GROUP BY symbol) a
  FULL JOIN (SELECT symbol, max(trade_date) AS d, arg_max({'open': open, 'high': high, 'low': low, 'close': close, 'volume': volume}, trade_date) AS v FROM b2 WHERE trade_date <= (SELECT d FROM best) GROUP BY symbol) z USING (symbol)
), counted AS (SELECT *, CASE WHEN left_date = right_date THEN CAST(l.open <> r.open AS INT) + CAST(l.high <> r.high AS INT) + CAST(l.low <> r.low AS INT) + CAST(l.close <> r.close AS INT) + CAST(l.volume <> r.volume AS INT) ELSE 0 END AS n FROM latest),
outcomes AS (SELECT symbol, left_date, right_date, CAST(n AS BIGINT) AS differences, CASE WHEN left_date IS NULL OR right_date IS NULL THEN 'missing_source' WHEN left_date <> right_date THEN 'market_date_mismatch' WHEN n > 0 THEN 'source_discrepancy' ELSE 'match' END AS outcome FROM counted),
status AS (SELECT names.symbol, max(trade_date) AS latest_date, count(trade_date) AS observations, CASE WHEN max(trade_date) IS NULL THEN 'missing_source' WHEN max(trade_date) = (SELECT d FROM best) THEN 'available' ELSE 'market_date_mismatch' END AS price_status
  FROM names LEFT JOIN b ON b.symbol = names.symbol AND trade_date <= (SELECT d FROM best) GROUP BY names.symbol)"""

_FIELDS = """
paired AS (SELECT a.symbol, a.trade_date, unnest([{'field': 'open', 'l': a.open, 'r': z.open}, {'field': 'high', 'l': a.high, 'r': z.high}, {'field': 'low', 'l': a.low, 'r': z.low}, {'field': 'close', 'l': a.close, 'r': z.close},
  {'field': 'volume', 'l': CAST(a.volume AS DOUBLE), 'r': CAST(z.volume AS DOUBLE)}]) AS f FROM b a JOIN b2 z USING (symbol, trade_date) WHERE a.trade_date <= (SELECT d FROM best)),
differing AS (SELECT symbol, trade_date, f.field AS field, f.l AS left_value, f.r AS right_value, CASE WHEN f.field = 'volume' THEN 'volume_mismatch' ELSE 'price_mismatch' END AS reason, abs(f.r - f.l) AS absolute_difference, abs(f.r - f.l) / abs(f.l) * 100 AS relative_difference_pct FROM paired WHERE f.l <> f.r)"""

_RUNS = """
runs AS (SELECT CAST(trade_date AS VARCHAR) AS run_id, trade_date AS market_date, CASE WHEN day(trade_date) % 2 = 0 THEN 'v2' ELSE 'v1' END AS methodology, CASE WHEN day(trade_date) % 7 = 0 THEN 'failed' WHEN day(trade_date) % 11 = 0 THEN 'open' ELSE 'succeeded' END AS status FROM b GROUP BY trade_date),
picked AS (SELECT *, CAST(trade_date AS VARCHAR) AS run_id, day(trade_date) AS n, (close / open - 1) * 100 AS move FROM b WHERE abs((close / open - 1) * 100) >= 1.5),
marked AS (SELECT *, CASE supplier % 5 WHEN 0 THEN 'canonical_complete' WHEN 1 THEN 'provisional_complete' WHEN 2 THEN 'reconciliation_pending' WHEN 3 THEN 'reconciled_equal' ELSE 'reconciled_discrepant' END AS version_status, n = 17 OR (n = 13 AND supplier % 2 = 0) AS plain FROM picked),
chosen AS (SELECT run_id, symbol, 1 AS rank, CASE WHEN volume > 60 THEN 'warning' ELSE 'clean' END AS quality, version_status, CASE WHEN NOT plain THEN symbol || '-' || version_status END AS version_id, 60 - supplier % 4 AS canonical, supplier % 4 AS supplemental, supplier % 4 AS missing, supplier % 5 AS discrepancies,
  CASE WHEN supplier % 8 < 4 THEN 'secondary' ELSE 'third' END AS supplemental_source, CASE WHEN n = 18 OR (n = 19 AND supplier % 2 = 0) THEN 'failed' WHEN n = 16 AND supplier % 3 = 0 THEN 'open' ELSE 'done' END AS state FROM marked),
why AS (SELECT run_id, symbol, 'first' AS stage, CASE WHEN move > 0 THEN 'rise' ELSE 'fall' END AS code, 'move' AS metric FROM picked UNION ALL SELECT run_id, symbol, 'second', 'heavy', 'volume' FROM picked WHERE volume > 60),
done AS (SELECT * FROM runs WHERE status = 'succeeded')"""

_NEED = """
need AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn FROM b WHERE trade_date <= (SELECT d FROM best)) WHERE rn <= 60),
canon AS (SELECT need.* FROM need WHERE day(trade_date) < 20 OR supplier % 3 = 0),
filler AS (SELECT * FROM b2 WHERE CAST(symbol AS INT) % 19 <> 4),
fill AS (SELECT filler.* FROM filler JOIN need USING (symbol, trade_date) ANTI JOIN canon USING (symbol, trade_date)),
cover AS (SELECT n.symbol, count(*) AS required, count(c.symbol) AS canonical, count(f.symbol) AS supplemental, count(*) - count(c.symbol) AS missing, count(*) - count(c.symbol) - count(f.symbol) AS remaining
  FROM need n LEFT JOIN canon c USING (symbol, trade_date) LEFT JOIN fill f USING (symbol, trade_date) GROUP BY n.symbol),
made AS (SELECT *, CASE WHEN supplemental > 0 THEN 'provisional_complete' ELSE 'canonical_complete' END AS status FROM cover WHERE remaining = 0),
held AS (
  SELECT symbol, trade_date, 'primary' AS provider, 'canonical' AS role, true AS selected, close, volume FROM canon WHERE symbol IN (SELECT symbol FROM made)
  UNION ALL SELECT symbol, trade_date, 'secondary', 'supplemental', true, close, volume FROM fill WHERE symbol IN (SELECT symbol FROM made)
  UNION ALL SELECT f.symbol, f.trade_date, 'secondary', 'validation', false, f.close, f.volume FROM filler f JOIN canon USING (symbol, trade_date) WHERE f.symbol IN (SELECT symbol FROM made)),
hit AS (SELECT f.symbol, f.trade_date, l.open <> f.open OR l.high <> f.high OR l.low <> f.low OR l.close <> f.close OR l.volume <> f.volume AS differs FROM fill f JOIN need l USING (symbol, trade_date) JOIN made USING (symbol) WHERE day(f.trade_date) >= 20 AND status <> 'canonical_complete'),
kids AS (SELECT symbol, count(*) AS moved, count(*) FILTER (differs) AS wrong FROM hit GROUP BY symbol),
children AS (SELECT m.symbol, m.required, m.canonical + moved AS canonical, m.supplemental - moved AS supplemental, m.missing - moved AS missing, m.remaining, CASE WHEN m.supplemental - moved > 0 THEN 'reconciliation_pending' WHEN wrong > 0 THEN 'reconciled_discrepant' ELSE 'reconciled_equal' END AS status, wrong AS discrepancies FROM made m JOIN kids USING (symbol))"""

_TARGETS = """
tneed AS (SELECT * FROM (SELECT b.*, t.d AS target_date, row_number() OVER (PARTITION BY symbol, t.d ORDER BY trade_date DESC) AS rn FROM b JOIN (SELECT d FROM best UNION ALL SELECT d FROM prior) t ON trade_date <= t.d) WHERE rn <= 60),
tall AS (SELECT n.symbol, n.target_date, n.trade_date, day(n.trade_date) < 20 OR n.supplier % 3 = 0 AS canonical, z.symbol IS NOT NULL AS other, day(n.trade_date) >= 25 OR (day(n.trade_date) >= 20 AND n.supplier % 2 = 0) AS late,
    array_to_string(list_filter([CASE WHEN n.open <> z.open THEN 'open' END, CASE WHEN n.high <> z.high THEN 'high' END, CASE WHEN n.low <> z.low THEN 'low' END, CASE WHEN n.close <> z.close THEN 'close' END, CASE WHEN n.volume <> z.volume THEN 'volume' END], lambda x: x IS NOT NULL), ',') AS fields
  FROM tneed n LEFT JOIN (SELECT * FROM b2 WHERE CAST(symbol AS INT) % 19 <> 4) z USING (symbol, trade_date)),
tmade AS (SELECT symbol, target_date, count(*) AS required, count(*) FILTER (canonical) AS canonical, count(*) FILTER (NOT canonical) AS supplemental, count(*) FILTER (NOT canonical) AS missing FROM tall GROUP BY symbol, target_date HAVING bool_and(canonical OR other)),
tfill AS (SELECT tall.* FROM tall JOIN (SELECT symbol, target_date FROM tmade) USING (symbol, target_date) WHERE NOT tall.canonical),
tkids AS (SELECT symbol, target_date, count(*) AS moved, count(*) FILTER (fields <> '') AS wrong, max(trade_date) AS through FROM tfill WHERE late GROUP BY symbol, target_date)"""

_DECIDE = """
need AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn FROM b WHERE trade_date <= (SELECT d FROM best)) WHERE rn <= 60),
canon AS (SELECT * FROM need WHERE day(trade_date) < 20 OR supplier % 3 = 0),
other AS (SELECT b2.* FROM b2 JOIN need USING (symbol, trade_date) WHERE day(b2.trade_date) <> 28 AND (day(b2.trade_date) <> 27 OR CAST(b2.symbol AS INT) % 4 <> 0)),
facts AS (SELECT n.symbol, CAST(n.symbol AS INT) AS k, count(*) FILTER (c.symbol IS NULL) AS missing, count(*) FILTER (c.symbol IS NULL AND o.symbol IS NOT NULL) AS eligible, count(o.symbol) AS other, count(*) FILTER (c.symbol IS NOT NULL AND o.symbol IS NOT NULL) AS overlap,
    count(*) FILTER (c.symbol IS NOT NULL AND o.symbol IS NOT NULL AND (c.open <> o.open OR c.high <> o.high OR c.low <> o.low OR c.close <> o.close OR c.volume <> o.volume)) AS differing
  FROM need n LEFT JOIN canon c USING (symbol, trade_date) LEFT JOIN other o USING (symbol, trade_date) GROUP BY n.symbol),
broken AS (SELECT DISTINCT symbol FROM other WHERE CAST(symbol AS INT) % 17 = 5 AND day(trade_date) = 25),
known AS (
  SELECT *, CASE k % 29 WHEN 9 THEN 'unavailable' WHEN 10 THEN 'symbol_mismatch' WHEN 11 THEN 'market_mismatch' WHEN 12 THEN 'exchange_mismatch' WHEN 13 THEN 'currency_mismatch' WHEN 14 THEN 'security_type_mismatch' ELSE 'verified' END AS identity,
    CASE k % 29 WHEN 9 THEN 'instrument_unavailable' WHEN 10 THEN 'identity_mismatch' WHEN 11 THEN 'market_mismatch' WHEN 12 THEN 'identity_mismatch' WHEN 13 THEN 'currency_mismatch' WHEN 14 THEN 'security_type_mismatch' END AS identity_reason FROM facts
), decided AS (
  SELECT *, CASE WHEN missing = 0 THEN 'not_needed' WHEN k % 8 IN (4, 5) THEN 'failure_not_eligible' WHEN k % 31 = 9 THEN 'unknown_fail_closed' WHEN identity_reason IS NOT NULL THEN identity_reason
    WHEN k % 37 = 12 THEN 'security_boundary_failed' WHEN other = 0 THEN 'insufficient_supplemental_coverage' WHEN k % 23 = 6 THEN 'duplicate_trade_date' WHEN symbol IN (SELECT symbol FROM broken) THEN 'malformed_payload' WHEN differing > 0 THEN 'overlap_discrepancy' END AS refused FROM known
), decisions AS (
  SELECT symbol, coalesce(refused, CASE WHEN eligible < missing THEN 'insufficient_supplemental_coverage' ELSE 'eligible_verified_supplemental' END) AS reason, refused IS NULL AND eligible > 0 AS is_eligible,
    CASE WHEN missing = 0 OR k % 8 IN (4, 5) OR k % 31 = 9 THEN 'not_checked' ELSE identity END AS identity_status, CASE WHEN refused = 'overlap_discrepancy' THEN 'discrepancy' WHEN refused IS NULL AND overlap > 0 THEN 'exact_match' ELSE 'not_applicable' END AS overlap_status, missing,
    CASE WHEN refused IS NULL THEN eligible ELSE 0 END AS eligible_dates, CASE WHEN missing = 0 THEN 0 WHEN refused IS NULL THEN overlap ELSE other END AS rejected_dates,
    CASE WHEN refused IS NULL THEN missing - eligible ELSE missing END AS remaining_dates, coalesce(refused = 'not_needed', eligible >= missing) AS coverage_complete FROM decided
)"""


def _falls(*sizes: int) -> str:
    """Tables fall20, fall60, ... of the largest fall inside the last rows of every date."""
    one = (
        "fall{n} AS (SELECT symbol, trade_date, min(fall) AS fall FROM (SELECT e.symbol, e.trade_date, (j.close / max(j.close) OVER (PARTITION BY e.symbol, e.i ORDER BY j.i) - 1) * 100 AS fall"
        " FROM placed e JOIN placed j ON e.symbol = j.symbol AND j.i BETWEEN e.i - {n} + 1 AND e.i WHERE e.i >= {n}) GROUP BY symbol, trade_date)"
    )
    return "\nplaced AS (SELECT symbol, trade_date, close, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS i FROM b),\n" + ",\n".join(one.format(n=n) for n in sizes)


_RESULTS = """
wide AS (SELECT s.symbol, s.trade_date, s.close AS latest_close, CAST(s.volume AS DOUBLE) AS latest_volume, return_20d, return_60d, return_120d, CASE WHEN volatility_observations >= 60 THEN volatility_60d END AS volatility_60d, f20.fall AS max_drawdown_20d, f60.fall AS max_drawdown_60d, f120.fall AS max_drawdown_120d,
  volume_ratio_20d, nullif(volume_state, 'insufficient') AS volume_anomaly, ma_distance_20d, ma_distance_60d, ma_distance_120d
  FROM states s LEFT JOIN fall20 f20 USING (symbol, trade_date) LEFT JOIN fall60 f60 USING (symbol, trade_date) LEFT JOIN fall120 f120 USING (symbol, trade_date))"""

def _second() -> str:
    """The deep metrics: each state is an aggregate over the last 250 rows, with (1) or without (0) the latest."""
    sides = []
    for s in (0, 1):
        at = lambda k, c="close": f"max({c}) FILTER (rn = {k + s})"  # noqa: B023, E731
        over = lambda f, c, n: f"{f}({c}) FILTER (rn BETWEEN {1 + s} AND {n + s})"  # noqa: B023, E731
        parts = [f"CASE WHEN count(*) - {s} >= {n + 1} THEN ({at(1)} / {at(n + 1)} - 1) * 100 END AS return_{n}d" for n in (20, 60, 120)]
        parts.append(f"CASE WHEN {over('count', 'r', 60)} >= 60 THEN {over('stddev_pop', 'r', 60)} * 100 END AS volatility_60d")
        parts += [f"CASE WHEN count(*) - {s} >= {n} THEN list(close ORDER BY trade_date) FILTER (rn BETWEEN {1 + s} AND {n + s}) END AS max_drawdown_{n}d" for n in (20, 60, 120, 250)]
        parts.append(f"CASE WHEN count(*) - {s} >= 20 THEN {at(1, 'volume')} / {over('avg', 'volume', 20)} END AS volume_ratio_20d")
        parts += [f"CASE WHEN count(*) - {s} >= {n} THEN ({at(1)} / {over('avg', 'close', n)} - 1) * 100 END AS ma_distance_{n}d" for n in (20, 60, 120, 250)]
        sides.append(f"SELECT symbol, {s} AS side, count(*) AS n, max(trade_date) AS latest_date, {over('count', 'r', 60)} AS k, " + ", ".join(parts) + " FROM deep GROUP BY symbol")
    names = ["return_20d", "return_60d", "return_120d", "volatility_60d", *(f"max_drawdown_{n}d" for n in (20, 60, 120, 250)), "volume_ratio_20d", *(f"ma_distance_{n}d" for n in (20, 60, 120, 250))]
    fall = lambda c: f"round(list_min(list_transform({c}, lambda x, i: (x / list_max({c}[1:i]) - 1) * 100)), 12)"
    value = lambda m, t: fall(f"{t}.{m}") if m.startswith("max") else f"round({t}.{m}, 12)"
    need = {m: 20 if m == "volume_ratio_20d" else int(m.rsplit("_", 1)[1][:-1]) + m.startswith("return") for m in names}
    long = " UNION ALL ".join(
        f"SELECT names.symbol, '{m}' AS metric, coalesce(a.n, 0) AS n, a.latest_date, {value(m, 'a')} AS now_, {value(m, 'z')} AS then_, "
        + ("coalesce(a.k, 0)" if m == "volatility_60d" else f"least(coalesce(a.n, 0), {need[m]})")
        + " AS seen FROM names LEFT JOIN (SELECT * FROM states2 WHERE side = 0) a USING (symbol) LEFT JOIN (SELECT * FROM states2 WHERE side = 1) z USING (symbol)"
        for m in names
    )
    return f"""
deep AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS r FROM ranked WHERE rn <= 250),
states2 AS ({' UNION ALL '.join(sides)}),
long2 AS ({long}),
deep_metrics AS (
  SELECT symbol, metric, CAST(NULL AS VARCHAR) AS component, CASE WHEN blocked IS NOT NULL THEN blocked WHEN now_ IS NULL THEN 'insufficient_history' ELSE 'available' END AS status,
    CASE WHEN blocked IS NULL AND now_ IS NOT NULL THEN then_ END AS previous, CASE WHEN blocked IS NULL THEN now_ END AS current, CASE WHEN blocked IS NULL AND now_ IS NOT NULL THEN round(now_ - then_, 12) END AS delta, CAST(CASE WHEN blocked IS NULL THEN seen ELSE n END AS INT) AS observations
  FROM (SELECT *, CASE WHEN latest_date IS NULL THEN 'missing_source' WHEN latest_date <> (SELECT d FROM best) THEN 'market_date_mismatch' END AS blocked FROM long2)
  UNION ALL SELECT g.symbol, CASE g.component WHEN 'pe_ratio' THEN 'valuation_pe_ratio' WHEN 'pb_ratio' THEN 'valuation_pb_ratio' ELSE 'valuation_dividend_yield' END, NULL, CASE WHEN v IS NULL THEN 'valuation_unavailable' ELSE 'available' END,
    CASE WHEN v IS NOT NULL THEN m.previous END, round(v, 12), CASE WHEN v IS NOT NULL THEN m.delta END, CAST(v IS NOT NULL AS INT)
  FROM grid g LEFT JOIN v_now USING (symbol, name) LEFT JOIN metrics m ON m.symbol = g.symbol AND m.component = g.component
)"""


# The rules of the second screen on numbers.
_SECOND_RULES = """
rules2(code, metric, op, threshold, class_priority, reason_order) AS (VALUES
  ('drawdown_change', 'max_drawdown_120d', 'abs_delta_gte', 1.0, 20, 30), ('volatility_regime_change', 'volatility_60d', 'abs_delta_gte', 1.0, 20, 40), ('return_60d_change', 'return_60d', 'abs_delta_gte', 1.0, 30, 50),
  ('return_120d_state', 'return_120d', 'abs_current_gte', 10.0, 40, 60), ('ma_distance_change', 'ma_distance_60d', 'abs_delta_gte', 1.0, 50, 70), ('volume_anomaly', 'volume_ratio_20d', 'current_gte', 2.0, 60, 80)),
kept AS (SELECT c.symbol, c.rank, c.primary_reasons, s.price_status, coalesce(o.outcome, 'missing_source') AS validation_status, FAILING AS failed FROM candidates c JOIN status s USING (symbol) LEFT JOIN outcomes o USING (symbol)),
reasons2 AS (
  SELECT symbol, code, 'research_change' AS kind, class_priority, reason_order, round(greatest(size, 0.0) / threshold, 12) AS threshold_multiple
  FROM (SELECT m.symbol, r.*, CASE op WHEN 'abs_delta_gte' THEN abs(delta) WHEN 'abs_current_gte' THEN abs(current) ELSE current END AS size FROM deep_metrics m JOIN rules2 r USING (metric) WHERE status = 'available' AND m.symbol IN (SELECT symbol FROM kept WHERE NOT failed)) WHERE size >= threshold
  UNION ALL SELECT w.symbol, c.code, 'research_change', 70, c.reason_order, w.threshold_multiple
  FROM (SELECT * FROM reasons WHERE metric = 'valuation_update' AND role = 'primary' QUALIFY row_number() OVER (PARTITION BY symbol, component ORDER BY reason_order) = 1) w
    JOIN (VALUES ('valuation_update_pe', 'valuation_pe_ratio', 'pe_ratio', 90), ('valuation_update_pb', 'valuation_pb_ratio', 'pb_ratio', 100), ('valuation_update_yield', 'valuation_dividend_yield', 'dividend_yield', 110)) AS c(code, deep, component, reason_order) USING (component)
    JOIN deep_metrics m ON m.symbol = w.symbol AND m.metric = c.deep AND m.status = 'available' WHERE abs(w.current - m.current) <= 1e-9 AND w.symbol IN (SELECT symbol FROM kept WHERE NOT failed)
  UNION ALL SELECT symbol, 'source_discrepancy', 'data_quality', 10, 10, 1.0 FROM kept WHERE validation_status = 'source_discrepancy'
  UNION ALL SELECT symbol, 'market_date_mismatch', 'data_quality', 10, 20, 1.0 FROM kept WHERE price_status = 'market_date_mismatch' OR validation_status = 'market_date_mismatch'
), final AS (
  SELECT symbol, quality, CASE WHEN quality IN ('failed', 'blocked') OR q > 0 THEN 'data_quality_candidate' ELSE 'research_candidate' END AS kind, research_reasons, primary_reasons, class_priority, threshold_multiple, rank AS first_rank
  FROM (SELECT k.symbol, k.rank, k.primary_reasons, CASE WHEN failed THEN 'failed' WHEN price_status <> 'available' THEN 'blocked' WHEN validation_status <> 'match' THEN 'warning' ELSE 'clean' END AS quality, count(*) FILTER (kind = 'data_quality') AS q, count(*) FILTER (kind = 'research_change') AS research_reasons,
      coalesce(min(class_priority), 999) AS class_priority, coalesce(max(threshold_multiple), 0.0) AS threshold_multiple FROM kept k LEFT JOIN reasons2 USING (symbol) GROUP BY k.symbol, k.rank, k.primary_reasons, price_status, validation_status, failed)
), ranking AS (SELECT *, CASE WHEN quality = 'failed' THEN 0 WHEN quality = 'blocked' THEN 1 WHEN quality = 'warning' AND kind = 'data_quality_candidate' THEN 2 ELSE 4 END AS quality_group FROM final)"""


def _second_reasons(failing: str = "false") -> str:
    """Reasons and ranking of the candidates, those for which ``failing`` holds having failed."""
    return _SECOND_RULES.replace("FAILING", failing)


_RANKING = """SELECT symbol, quality, kind, research_reasons, primary_reasons, class_priority, {multiple}, CAST(first_rank AS INT) AS first_rank, quality_group,
  CAST(row_number() OVER (ORDER BY quality_group, research_reasons DESC, primary_reasons DESC, class_priority, ranking.threshold_multiple DESC, first_rank, symbol) AS INT) AS final_rank FROM ranking"""


def _with(body: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",".join((_BARS, *parts)) + "\n" + body


def _r(*columns: str) -> str:
    """Columns rounded as the queries round them, without a negative zero."""
    return ", ".join(f"CAST(round(CAST({c} AS DECIMAL(30, {SETTLED})), {PLACES}) AS DOUBLE) AS {c}" for c in columns)


_PANEL_COLUMNS = ("return_1d", "return_20d", "ma_20", "ma_distance_20d", "return_60d", "ma_60", "ma_distance_60d", "return_120d", "ma_120", "ma_distance_120d", "return_250d", "ma_250", "ma_distance_250d", "volume_avg_20", "volatility_60d", "volume_ratio_20d")

_READY = (
    "CASE WHEN n IS NULL THEN 'missing' WHEN supplier % 5 = 2 THEN 'illegal_source' WHEN latest <> {d} THEN 'missing' WHEN n < 62 THEN 'short' ELSE 'ready' END AS readiness FROM names LEFT JOIN (SELECT symbol, count(*) AS n, max(trade_date) AS latest FROM b WHERE supplier % 6 <> 1 AND (supplier % 8 <> 3 OR trade_date >= {d} - 100) AND trade_date <= {d} GROUP BY symbol) USING (symbol)"
)

_UNITS = {
    "latest_close": "TWD", "latest_volume": "shares", "volume_ratio_20d": "ratio", "volume_anomaly": "state",
    **{f"{m}_{n}d": "percentage_points" for m in ("return", "max_drawdown", "ma_distance") for n in (20, 60, 120)}, "volatility_60d": "percentage_points",
}


def oracle_sql() -> dict[str, str]:
    d = "(SELECT d FROM best)"
    out = {
        "bars": _with(f"SELECT symbol, trade_date, {_r('open', 'high', 'low', 'close')}, volume, source FROM b"),
        "valuation_rows": _with(f"SELECT symbol, metric_date, name, {_r('value')}, unit, source FROM ratios"),
        "bar_checks": _with(
            "SELECT problem, count(*) AS n, count(DISTINCT symbol) AS symbols FROM (SELECT symbol, CASE WHEN day(trade_date) = 3 THEN 'price_not_positive' WHEN day(trade_date) = 5 THEN 'high_not_highest' WHEN day(trade_date) = 7 THEN 'high_not_highest' WHEN day(trade_date) = 9 THEN 'volume_invalid' END AS problem FROM b) GROUP BY problem"
        ),
        "repeated_orders": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
        "batch_identity": _with(
            """SELECT batch_id, CASE WHEN (k + y) % 5 = 0 THEN 'symbol_mismatch' WHEN (k + y) % 7 = 0 THEN 'date_out_of_range' WHEN (k + y) % 3 = 0 THEN 'market_date_missing' END AS problem
            FROM (SELECT symbol || '-' || year(trade_date) AS batch_id, min(supplier) AS k, year(min(trade_date)) AS y FROM b GROUP BY 1)"""
        ),
        "source_roles": _with(
            """SELECT symbol, 'canonical' AS role, CASE WHEN supplier % 4 = 0 THEN 'secondary' ELSE 'synthetic_a' END AS source, 'source_not_allowed' AS problem FROM b WHERE supplier % 4 = 0 OR supplier % 9 = 0 GROUP BY ALL
            UNION ALL SELECT DISTINCT symbol, NULL, NULL, 'synthetic_mixed' FROM b WHERE supplier % 9 = 0 AND supplier % 4 <> 0 AND symbol IN (SELECT symbol FROM b2)"""
        ),
        "text_forms": f"""SELECT p_partkey, {_r('number')}, whole, symbol, symbol IS NOT NULL AND p_partkey % 6 <> 1 AND length(symbol) <= 12 AS fits, truth FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 IN (1, 2) THEN NULL ELSE floor(p_retailprice) + 0.25 END AS number,
          CASE p_partkey % 5 WHEN 1 THEN NULL WHEN 2 THEN p_partkey ELSE p_partkey * 1000 END AS whole, CASE p_partkey % 6 WHEN 1 THEN 'P-' || p_partkey WHEN 2 THEN NULL ELSE 'P' || p_partkey END AS symbol, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS truth FROM part)""",
        "local_dates": "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, d AS compact, d AS slashed, d AS flexible, last_day(d) AS month_end, CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE) AS previous_month FROM orders",
        "price_status": _with("SELECT symbol, latest_date, observations, price_status FROM status", _SOURCES),
        "last_bars": _with(
            f"SELECT symbol, trade_date, {_r('close')}, volume, rn, n AS total_observations, n > 20 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM b WHERE trade_date <= {d}) WHERE rn <= 20"
        ),
        "valuations_as_of": _with(f"SELECT symbol, name, {_r('value')}, metric_date, source FROM (SELECT symbol, name, arg_max(value, metric_date) AS value, max(metric_date) AS metric_date, 'primary' AS source FROM ratios WHERE metric_date <= {d} GROUP BY symbol, name)"),
        "validation_runs": _with(
            f"""SELECT symbol, market_date, 'success' AS status, created_at, run_id FROM (SELECT symbol, trade_date AS market_date, k % 3 AS created_at, symbol || '-' || k AS run_id FROM b, (VALUES (1), (2), (3)) AS t(k) WHERE trade_date = {d} AND (supplier + k) % 4 <> 0)
            QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY created_at DESC, run_id DESC) = 1"""
        ),
        "previous_results": _with(
            """SELECT symbol, market_date, methodology, previous_date, previous_any_date, CASE WHEN previous_date IS NOT NULL THEN 'available' WHEN previous_any_date IS NOT NULL THEN 'methodology_incompatible' ELSE 'previous_result_missing' END AS comparison_status
            FROM (SELECT symbol, trade_date AS market_date, CASE WHEN day(trade_date) % 3 = 0 THEN 'v2' ELSE 'v1' END AS methodology, lag(trade_date) OVER (PARTITION BY symbol, CASE WHEN day(trade_date) % 3 = 0 THEN 'v2' ELSE 'v1' END ORDER BY trade_date) AS previous_date, lag(trade_date) OVER (PARTITION BY symbol ORDER BY trade_date) AS previous_any_date FROM b)"""
        ),
        "merged_history": _with(
            f"""SELECT symbol, trade_date, {_r('open', 'high', 'low', 'close')}, volume, conflict FROM (SELECT symbol, trade_date, coalesce(a.open, z.open) AS open, coalesce(a.high, z.high) AS high, coalesce(a.low, z.low) AS low, coalesce(a.close, z.close) AS close, coalesce(a.volume, z.volume) AS volume,
            coalesce(a.open <> z.open OR a.high <> z.high OR a.low <> z.low OR a.close <> z.close OR a.volume <> z.volume, false) AS conflict FROM (SELECT * FROM b WHERE day(trade_date) < 28) a FULL JOIN b2 z USING (symbol, trade_date))"""
        ),
        "source_lists": _with(
            """SELECT symbol, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, coalesce(string_agg(DISTINCT endpoint, ',' ORDER BY endpoint), '') AS endpoints
            FROM (SELECT symbol, source, '/day/' || (supplier % 3) AS endpoint FROM b UNION ALL SELECT symbol, source, NULL FROM b2 WHERE symbol >= '0003' UNION ALL SELECT symbol, source, '/ratios' FROM ratios) GROUP BY symbol"""
        ),
        "market_days": _with(
            f"""SELECT day, state, state = 'on_latest' AS market_day FROM (SELECT trade_date AS day, CASE WHEN day(trade_date) = 1 THEN 'closed' WHEN isodow(trade_date) >= 6 THEN 'weekend' WHEN trade_date < {d} THEN 'before_latest' WHEN trade_date = {d} THEN 'on_latest' ELSE 'after_latest' END AS state FROM b GROUP BY trade_date)"""
        ),
        "latest_dates": _with("SELECT source, max(trade_date) AS latest_date FROM (SELECT source, trade_date FROM b UNION ALL SELECT source, trade_date FROM b2) GROUP BY source"),
        "short_histories": _with(
            f"""SELECT symbol, count(l) AS observations, CASE WHEN count(l) >= 250 THEN 'complete' WHEN count(l) = 0 THEN 'missing' WHEN max(supplier) % 2 = 0 AND max(l) = {d} AND min(l) = min(listed) THEN 'legal_short' ELSE 'incomplete' END AS history_state
            FROM (SELECT symbol, supplier, CASE WHEN trade_date >= {d} - INTERVAL 2 MONTH AND trade_date <= {d} THEN trade_date END AS l, CASE WHEN trade_date >= {d} - INTERVAL 2 MONTH THEN trade_date END AS listed FROM b) GROUP BY symbol"""
        ),
        "readiness": _with(f"SELECT symbol, {_READY.format(d=d)}"),
        "readiness_totals": _with(
            f"""SELECT count(*) AS eligible, count(*) FILTER (readiness IN ('ready', 'short')) AS ready, count(*) FILTER (readiness = 'short') AS short, count(*) FILTER (readiness = 'illegal_source') AS illegal_source,
            count(*) FILTER (readiness IN ('missing', 'illegal_source')) AS missing, count(*) FILTER (readiness IN ('ready', 'short')) = count(*) AS complete FROM (SELECT {_READY.format(d=d)})"""
        ),
        "resolved_days": _with(f"SELECT DISTINCT trade_date AS day, CASE WHEN trade_date >= {d} THEN {d} END AS resolved FROM b"),
        "panel_indicators": _with(f"SELECT symbol, trade_date, {_r(*_PANEL_COLUMNS)}, volatility_observations, volume_state FROM states", _PANEL),
        "panel_drawdowns": _with(
            f"SELECT symbol, trade_date, {_r('max_drawdown_20d', 'max_drawdown_60d', 'max_drawdown_120d')} FROM (SELECT symbol, trade_date, f20.fall AS max_drawdown_20d, f60.fall AS max_drawdown_60d, f120.fall AS max_drawdown_120d FROM b LEFT JOIN fall20 f20 USING (symbol, trade_date) LEFT JOIN fall60 f60 USING (symbol, trade_date) LEFT JOIN fall120 f120 USING (symbol, trade_date))",
            _falls(20, 60, 120),
        ),
        "whole_history_risk": _with(
            f"""SELECT symbol, observations, first_date, last_date, {_r('first_close', 'last_close', 'min_close', 'max_close', 'total_return_pct', 'mean_daily_return_pct', 'annualized_volatility_pct', 'max_drawdown_pct', 'mean_volume')} FROM (
            SELECT symbol, count(*) AS observations, min(trade_date) AS first_date, max(trade_date) AS last_date, arg_min(close, trade_date) AS first_close, arg_max(close, trade_date) AS last_close, min(close) AS min_close, max(close) AS max_close,
              (arg_max(close, trade_date) / arg_min(close, trade_date) - 1) * 100 AS total_return_pct, coalesce(avg(r), 0) * 100 AS mean_daily_return_pct, CASE WHEN count(r) >= 2 THEN stddev_pop(r) * sqrt(252) * 100 ELSE 0 END AS annualized_volatility_pct, min(fall) * 100 AS max_drawdown_pct, avg(volume) AS mean_volume
            FROM (SELECT *, close / max(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS fall FROM daily) GROUP BY symbol)""",
            _PANEL,
        ),
        "research_summary": _with(
            """SELECT symbol, count(*) AS observations, round(arg_max(close, trade_date), 2) AS last_close, round((arg_max(close, trade_date) / arg_min(close, trade_date) - 1) * 100, 2) AS total_return_pct, round(stddev_pop(r) * sqrt(252) * 100, 2) AS annualized_volatility_pct, round(min(fall) * 100, 2) AS max_drawdown_pct,
              max(pe) AS price_earnings_ratio, max(pb) AS price_to_book_ratio, max(dy) AS dividend_yield_pct
            FROM (SELECT *, close / max(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS fall FROM daily) LEFT JOIN (
              SELECT symbol, round(arg_max(value, metric_date) FILTER (name = 'price_earnings_ratio'), 2) AS pe, round(arg_max(value, metric_date) FILTER (name = 'price_to_book_ratio'), 2) AS pb, round(arg_max(value, metric_date) FILTER (name = 'dividend_yield_pct'), 2) AS dy FROM ratios GROUP BY symbol) USING (symbol) GROUP BY symbol""",
            _PANEL,
        ),
        "prior_dates": _with(f"SELECT symbol, count(*) AS n, max(trade_date) AS latest_date, max(trade_date) FILTER (rn = 2) AS prior_date FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn FROM b WHERE trade_date <= {d}) WHERE rn <= 62 GROUP BY symbol"),
        "first_metrics": _with(
            f"""SELECT symbol, metric, component, status, {_r('previous', 'current', 'delta')}, CASE WHEN metric = 'volume_anomaly' OR component IN ('pe_ratio', 'pb_ratio') THEN 'ratio' WHEN metric = 'volatility_regime_change' THEN 'annualized_percent' ELSE 'percent' END AS value_unit,
            CASE WHEN metric = 'volume_anomaly' THEN 'ratio' WHEN component IN ('pe_ratio', 'pb_ratio') THEN 'percent_relative_change' ELSE 'percentage_point' END AS delta_unit FROM metrics""",
            _FIRST,
        ),
        "first_reasons": _with(f"SELECT symbol, code, metric, component, {_r('current')}, role, class_priority, {_r('threshold_multiple')} FROM reasons", _FIRST),
        "first_candidates": _with(f"SELECT symbol, quality, primary_reasons, secondary_reasons, class_priority, {_r('threshold_multiple')}, codes, CAST(rank AS INT) AS rank FROM candidates", _FIRST),
        "first_counts": _with(
            "SELECT (SELECT count(*) FROM members) AS universe_count, count(*) AS screened_count, count(*) FILTER (primary_reasons > 0) AS triggered_count, least(count(*) FILTER (primary_reasons > 0), 30) AS candidate_count, count(*) FILTER (primary_reasons > 0) > 30 AS truncated FROM evaluated WHERE symbol IN (SELECT symbol FROM members WHERE status = 'active_scan_eligible')",
            _UNIVERSE, _FIRST,
        ),
        "input_gaps": _with("SELECT symbol, CASE supplier % 5 WHEN 1 THEN 'duplicate' WHEN 2 THEN 'missing' ELSE 'extra' END AS problem FROM names WHERE supplier % 5 IN (1, 2, 3)"),
        "screening_sources": _with("SELECT symbol, 'primary' AS seen_as, count(*) AS n FROM (SELECT symbol FROM b UNION ALL SELECT symbol FROM b2) GROUP BY symbol"),
        "previous_conflicts": _with(f"SELECT symbol, name, {_r('value')}, CAST(symbol AS INT) % 3 <> 0 AS conflict FROM ratios WHERE metric_date = (SELECT d FROM prior)"),
        "universe_members": _with("SELECT * FROM members", _UNIVERSE),
        "universe_conflicts": _with("SELECT symbol, 'identity' AS feed FROM clash", _UNIVERSE),
        "class_assignments": _with("SELECT symbol, CASE WHEN class IN ('etf', 'tdr') THEN class WHEN i.symbol IS NOT NULL THEN 'common_stock' ELSE coalesce(class, 'unknown') END AS class FROM classed FULL JOIN ident i USING (symbol)", _UNIVERSE),
        "feed_dates": _with(
            f"SELECT coalesce(min(trade_date) = {d} AND max(trade_date) = {d}, false) AS agrees, feed FROM (VALUES ('day', 0), ('week', 6), ('none', -1)) AS f(feed, back) LEFT JOIN b ON back >= 0 AND trade_date BETWEEN {d} - back AND {d} GROUP BY feed"
        ),
        "watchlist": "SELECT 7 AS revision, printf('%04d', s_suppkey) AS symbol, s_name AS name FROM supplier WHERE s_acctbal >= 0",
        "universe_files": _with(f"SELECT {d} AS market_date, symbol, name, status, reason FROM members", _UNIVERSE),
        "universe_counts": _with(
            "SELECT count(*) AS universe_count, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("active_scan_eligible", "active_scan_unavailable", "excluded_non_common_equity", "inactive", "classification_unresolved")) + " FROM members", _UNIVERSE
        ),
        "second_metrics": _with(f"SELECT symbol, metric, component, status, {_r('previous', 'current', 'delta')}, observations FROM deep_metrics", _FIRST, _second()),
        "second_reasons": _with(f"SELECT symbol, code, kind, class_priority, reason_order, {_r('threshold_multiple')} FROM reasons2", _FIRST, _second(), _SOURCES, _second_reasons()),
        "second_ranking": _with(_RANKING.format(multiple=_r("threshold_multiple")), _FIRST, _second(), _SOURCES, _second_reasons()),
        "failed_ranking": _with(_RANKING.format(multiple=_r("threshold_multiple")), _FIRST, _second(), _SOURCES, _second_reasons("c.rank % 4 = 2")),
        "failed_metrics": _with(
            """SELECT metric, status, count(*) AS n, count(current) AS known, CAST(sum(observations) AS BIGINT) AS observations FROM deep_metrics JOIN names USING (symbol) WHERE supplier % 4 <> 2 AND metric NOT LIKE 'valuation%' GROUP BY metric, status
            UNION ALL SELECT metric, 'analysis_failed', count(*), 0, 0 FROM names, (SELECT DISTINCT metric FROM deep_metrics) WHERE supplier % 4 = 2 GROUP BY metric""",
            _FIRST, _second(),
        ),
        "report_reasons": _with(
            """SELECT CAST(row_number() OVER (ORDER BY quality_group, research_reasons DESC, primary_reasons DESC, class_priority, ranking.threshold_multiple DESC, first_rank, symbol) AS INT) AS final_rank, symbol, quality, kind,
            coalesce((SELECT string_agg(code, ',' ORDER BY reason_order, code) FROM reasons2 w WHERE w.symbol = ranking.symbol), '') AS codes, 'Descriptive figures from past prices; no advice.' AS notice FROM ranking""",
            _FIRST, _second(), _SOURCES, _second_reasons(),
        ),
        "report_totals": _with(
            """SELECT (SELECT count(*) FROM names) AS universe_count, screened_count, triggered_count, least(triggered_count, 30) AS candidate_count, triggered_count > 30 AS truncated, supplemental_candidates, canonical, supplemental, missing, discrepancies, research_quality, versions, 30 AS candidate_limit, 'Descriptive figures from past prices; no advice.' AS notice
            FROM (SELECT count(*) AS screened_count, count(*) FILTER (primary_reasons > 0) AS triggered_count FROM evaluated), (
              SELECT count(*) FILTER (supplemental > 0) AS supplemental_candidates, CAST(coalesce(sum(m.canonical), 0) AS BIGINT) AS canonical, CAST(coalesce(sum(supplemental), 0) AS BIGINT) AS supplemental, CAST(coalesce(sum(m.missing), 0) AS BIGINT) AS missing, CAST(0 AS BIGINT) AS discrepancies,
                CASE WHEN coalesce(bool_or(supplemental > 0), false) THEN 'provisional' ELSE 'canonical' END AS research_quality, count(m.symbol) AS versions FROM candidates c LEFT JOIN made m ON m.symbol = c.symbol)""",
            _FIRST, _NEED,
        ),
        "candidate_provenance": _with(
            """SELECT n.symbol, CASE m.status WHEN 'canonical_complete' THEN 'canonical_complete' WHEN 'provisional_complete' THEN 'provisional_mixed' END AS source_status, CASE m.status WHEN 'canonical_complete' THEN 'complete' WHEN 'provisional_complete' THEN 'incomplete' END AS authority,
            CASE m.status WHEN 'canonical_complete' THEN 'not_applicable' WHEN 'provisional_complete' THEN 'pending' END AS reconciliation, CASE WHEN m.status = 'provisional_complete' THEN 'provisional' ELSE 'canonical' END AS research_quality, m.canonical, supplemental, m.missing, CASE WHEN m.symbol IS NOT NULL THEN 0 END AS discrepancies,
            CASE WHEN m.canonical > 0 THEN 'primary' ELSE '' END AS canonical_sources, CASE WHEN supplemental > 0 THEN 'secondary' ELSE '' END AS supplemental_sources, CASE WHEN n.symbol IN (SELECT symbol FROM held WHERE role = 'validation') THEN 'secondary' ELSE '' END AS validation_sources FROM names n LEFT JOIN made m ON m.symbol = n.symbol""",
            _NEED,
        ),
        "result_changes": _with(
            f"""SELECT symbol, metric, change, changes, {_r('greatest')}, last_date FROM (SELECT symbol, metric, change, count(*) AS changes, max(delta) AS greatest, max(trade_date) AS last_date FROM (
              SELECT symbol, metric, trade_date, round(value - before, 12) AS delta, CASE WHEN (value IS NULL AND state IS NULL) <> (before IS NULL AND state_before IS NULL) THEN 'availability_changed' WHEN state <> state_before THEN 'volume_anomaly_state_changed' WHEN abs(round(value - before, 12)) >= CASE WHEN metric = 'volume_ratio_20d' THEN 0.25 ELSE 1.0 END THEN 'metric_changed' END AS change
              FROM (SELECT symbol, metric, trade_date, value, state, lag(value) OVER w AS before, lag(state) OVER w AS state_before, row_number() OVER w AS i FROM ({' UNION ALL '.join(f"SELECT symbol, trade_date, '{m}' AS metric, " + ("CAST(NULL AS DOUBLE) AS value, volume_anomaly AS state" if m == 'volume_anomaly' else f"round({m}, 12) AS value, NULL AS state") + " FROM wide" for m in _UNITS if not m.startswith('latest_'))}) WINDOW w AS (PARTITION BY symbol, metric ORDER BY trade_date)) WHERE i > 1
            ) WHERE change IS NOT NULL GROUP BY symbol, metric, change)""",
            _PANEL, _falls(20, 60, 120), _RESULTS,
        ),
        "daily_results": _with(
            f"""SELECT symbol, metric, status, {_r('value')}, state, unit, as_of_date FROM (SELECT symbol, metric, unit, CASE WHEN price_status <> 'available' THEN price_status WHEN value IS NULL AND state IS NULL THEN 'insufficient_history' ELSE 'available' END AS status, CASE WHEN price_status = 'available' THEN value END AS value, CASE WHEN price_status = 'available' THEN state END AS state,
            CASE WHEN price_status = 'available' AND (value IS NOT NULL OR state IS NOT NULL) THEN {d} END AS as_of_date FROM (
              {' UNION ALL '.join(f"SELECT status.symbol, price_status, '{m}' AS metric, '{u}' AS unit, " + ("CAST(NULL AS DOUBLE) AS value, volume_anomaly AS state" if m == 'volume_anomaly' else f"round({m}, 12) AS value, NULL AS state") + f" FROM status LEFT JOIN wide ON wide.symbol = status.symbol AND wide.trade_date = {d}" for m, u in _UNITS.items())}))""",
            _PANEL, _falls(20, 60, 120), _RESULTS, _SOURCES,
        ),
        "result_ids": _with("SELECT symbol, trade_date AS market_date, 'daily-' || substr(sha256(symbol || '|' || CAST(trade_date AS VARCHAR) || '|v1'), 1, 32) AS result_id FROM b"),
        "discrepancy_changes": _with(
            """SELECT symbol, market_date, added, resolved FROM (SELECT symbol, market_date, array_to_string(list_sort(list_filter(found, lambda x: NOT list_contains(before, x))), ',') AS added, array_to_string(list_sort(list_filter(before, lambda x: NOT list_contains(found, x))), ',') AS resolved
            FROM (SELECT symbol, market_date, found, lag(found) OVER (PARTITION BY symbol ORDER BY market_date) AS before FROM (
              SELECT p.symbol, p.trade_date AS market_date, coalesce(list(field || ':' || reason) FILTER (field IS NOT NULL), CAST([] AS VARCHAR[])) AS found FROM (SELECT DISTINCT symbol, trade_date FROM paired) p LEFT JOIN differing USING (symbol, trade_date) GROUP BY ALL)) WHERE before IS NOT NULL) WHERE added <> '' OR resolved <> ''""",
            _FIELDS,
        ),
        "timestamp_states": _with("SELECT symbol, CASE day(trade_date) WHEN 9 THEN 'missing' WHEN 11 THEN 'mismatch' ELSE 'match' END AS state, count(*) AS n FROM b GROUP BY 1, 2"),
        "rendered_values": _with(r"SELECT DISTINCT CAST(round(close * 100) AS BIGINT) AS cents, regexp_replace(CAST(close AS VARCHAR), '\.0$', '') AS text FROM b"),
        "table_digests": """SELECT count(*) AS "rows", CAST(sum(CAST(CAST('0x' || substr(md5(o_custkey || '|' || o_orderkey), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM orders""",
        "latest_day_outcomes": _with("SELECT * FROM outcomes", _SOURCES),
        "history_differences": _with(f"SELECT symbol, trade_date, field, {_r('left_value', 'right_value')}, reason, {_r('absolute_difference', 'relative_difference_pct')} FROM differing", _FIELDS),
        "history_summary": _with(
            f"""SELECT coalesce(a.symbol, z.symbol) AS symbol, count(*) FILTER (a.symbol IS NOT NULL AND z.symbol IS NOT NULL) AS common_dates, count(*) FILTER (n = 0) AS matched_dates, count(*) FILTER (z.symbol IS NULL) AS left_only_dates, count(*) FILTER (a.symbol IS NULL) AS right_only_dates,
              CAST(coalesce(sum(n), 0) AS BIGINT) AS field_differences, max(a.trade_date) AS left_latest, max(z.trade_date) AS right_latest
            FROM (SELECT a, z, CAST(a.open <> z.open AS INT) + CAST(a.high <> z.high AS INT) + CAST(a.low <> z.low AS INT) + CAST(a.close <> z.close AS INT) + CAST(a.volume <> z.volume AS INT) AS n FROM
              (SELECT * FROM b WHERE day(trade_date) <> 3 AND trade_date <= {d} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) <= 250) a FULL JOIN
              (SELECT * FROM b2 WHERE trade_date <= {d} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) <= 250) z ON a.symbol = z.symbol AND a.trade_date = z.trade_date) GROUP BY 1"""
        ),
        "differences_by_field": _with("SELECT field, count(*) AS differences FROM differing GROUP BY field", _FIELDS),
        "coverage_condition": _with(
            f"""SELECT symbol, least(x, 60) AS left_rows, least(y, 60) AS right_rows, x >= 60 AND y >= 60 AS covered FROM (SELECT symbol, coalesce(a.n, 0) AS x, coalesce(z.n, 0) AS y FROM (SELECT symbol, count(*) AS n FROM b WHERE trade_date <= {d} GROUP BY symbol) a FULL JOIN (SELECT symbol, count(*) AS n FROM b2 WHERE symbol <> '0002' AND trade_date <= {d} GROUP BY symbol) z USING (symbol))"""
        ),
        "version_coverage": _with(f"SELECT symbol, {d} AS target_date, required, canonical, supplemental, missing, remaining, status FROM made", _NEED),
        "version_roles": _with("SELECT symbol, provider, role, selected, count(*) AS n, min(trade_date) AS first_date, max(trade_date) AS last_date FROM held GROUP BY symbol, provider, role, selected", _NEED),
        "version_snapshots": _with(f"SELECT symbol, trade_date, provider, role, {_r('close')}, volume FROM held WHERE selected AND CAST(symbol AS INT) % 2 = 0", _NEED),
        "validation_views": _with(
            """SELECT symbol, CASE WHEN z.symbol IS NULL THEN 'missing_source' WHEN fields <> '' THEN 'source_discrepancy' ELSE 'available' END AS status, CASE WHEN z.symbol IS NOT NULL THEN CASE WHEN fields <> '' THEN 'discrepancy' ELSE 'match' END END AS outcome, CASE WHEN z.symbol IS NOT NULL THEN 'primary' END AS left_provider,
            CASE WHEN z.symbol IS NOT NULL THEN 'secondary' END AS right_provider, coalesce(fields, '') AS fields FROM (SELECT symbol, max(trade_date) AS trade_date FROM canon WHERE symbol IN (SELECT symbol FROM made) GROUP BY symbol) LEFT JOIN (
              SELECT f.symbol, f.trade_date, array_to_string(list_filter([CASE WHEN c.open <> f.open THEN 'open' END, CASE WHEN c.high <> f.high THEN 'high' END, CASE WHEN c.low <> f.low THEN 'low' END, CASE WHEN c.close <> f.close THEN 'close' END, CASE WHEN c.volume <> f.volume THEN 'volume' END], lambda x: x IS NOT NULL), ',') AS fields FROM canon c JOIN filler f USING (symbol, trade_date)) z USING (symbol, trade_date)""",
            _NEED,
        ),
        "versions_of": _with("SELECT symbol, status, supplemental FROM made WHERE status = 'provisional_complete'", _NEED),
        "version_reconciliation": _with(f"SELECT symbol, {d} AS target_date, required, canonical, supplemental, missing, remaining, status, discrepancies FROM children", _NEED),
        "version_leaves": _with(
            f"""SELECT symbol, {d} AS target_date, leaf_state, leaf_state <> 'ambiguous' AS named FROM (SELECT symbol, CASE WHEN whole > 1 OR (whole = 0 AND open > 1) THEN 'ambiguous' WHEN whole = 1 THEN 'complete' ELSE 'open' END AS leaf_state FROM (
              SELECT m.symbol, CAST(m.status = 'canonical_complete' AS INT) * (1 + twice) + CAST(coalesce(c.status LIKE 'reconciled%', false) AS INT) AS whole, CAST(m.status <> 'canonical_complete' AS INT) * (CAST(c.symbol IS NULL AS INT) + twice) + CAST(coalesce(c.status = 'reconciliation_pending', false) AS INT) AS open
              FROM (SELECT *, CAST(CAST(symbol AS INT) % 7 = 2 AS INT) AS twice FROM made) m LEFT JOIN (SELECT * FROM children WHERE CAST(symbol AS INT) % 4 <> 1) c ON c.symbol = m.symbol))""",
            _NEED,
        ),
        "target_reconciliation": _with("SELECT symbol, target_date, required, canonical + moved AS canonical, supplemental - moved AS supplemental, missing - moved AS missing, 0 AS remaining, CASE WHEN supplemental > moved THEN 'reconciliation_pending' WHEN wrong > 0 THEN 'reconciled_discrepant' ELSE 'reconciled_equal' END AS status, wrong AS discrepancies FROM tmade JOIN tkids USING (symbol, target_date)", _TARGETS),
        "reconciliation_dates": _with("SELECT symbol, target_date, trade_date, CASE WHEN NOT late THEN 'pending' WHEN fields <> '' THEN 'discrepant' ELSE 'equal' END AS outcome, CASE WHEN late THEN fields ELSE '' END AS fields, through AS reconciled_through FROM tfill JOIN tkids USING (symbol, target_date)", _TARGETS),
        "version_ids": _with(
            f"""SELECT symbol, target_date, substr(sha256(symbol || '|' || target_date || '|' || provenance), 1, 32) AS version_id, provenance AS provenance_sha256 FROM (
              SELECT symbol, {d} AS target_date, sha256(string_agg(h, ',' ORDER BY h)) AS provenance FROM (
                SELECT symbol, sha256(concat_ws('|', symbol, trade_date, open, high, low, close, volume, provider)) || ':' || role AS h FROM (
                  SELECT symbol, trade_date, open, high, low, close, volume, 'primary' AS provider, 'canonical' AS role FROM canon UNION ALL SELECT symbol, trade_date, open, high, low, close, volume, 'secondary', 'supplemental' FROM fill
                  UNION ALL SELECT f.symbol, f.trade_date, f.open, f.high, f.low, f.close, f.volume, 'secondary', 'validation' FROM filler f JOIN canon USING (symbol, trade_date))) GROUP BY symbol) WHERE symbol IN (SELECT symbol FROM made)""",
            _NEED,
        ),
        "version_ancestry": _with(
            """SELECT version_id, root_id, depth, tips FROM chain JOIN (SELECT root_id, count(*) AS tips FROM chain WHERE version_id NOT IN (SELECT parent_id FROM links WHERE parent_id IS NOT NULL) GROUP BY root_id) USING (root_id)""",
            """links AS (SELECT version_id, CASE WHEN month(month) % 7 = 0 THEN NULL WHEN supplier % 3 = 0 AND month(month) % 5 = 0 THEN lag(version_id, 2) OVER w ELSE lag(version_id) OVER w END AS parent_id
              FROM (SELECT DISTINCT symbol, supplier, date_trunc('month', trade_date) AS month, symbol || '/' || strftime(trade_date, '%Y-%m') AS version_id FROM b) WINDOW w AS (PARTITION BY symbol ORDER BY month)),
            chain AS (SELECT version_id, version_id AS root_id, 0::BIGINT AS depth FROM links WHERE parent_id IS NULL UNION ALL SELECT l.version_id, c.root_id, c.depth + 1 FROM links l JOIN chain c ON l.parent_id = c.version_id)""",
        ),
        "version_lineage": _with("SELECT 0 AS depth, symbol, status FROM children WHERE symbol = (SELECT min(symbol) FROM children) UNION ALL SELECT 1, symbol, status FROM made WHERE symbol = (SELECT min(symbol) FROM children)", _NEED),
        "broken_rows": _with(
            """SELECT problem, count(*) AS n FROM (SELECT DISTINCT symbol, trade_date, CAST(symbol AS INT) % 7 AS k FROM held), (VALUES (1, 'selection_against_role'), (2, 'source_against_role'), (3, 'row_repeated'), (3, 'two_selected')) AS p(n, problem) WHERE k = n GROUP BY problem""", _NEED
        ),
        "broken_versions": _with(
            """SELECT symbol, CASE CAST(symbol AS INT) % 8 WHEN 1 THEN 'missing_count' WHEN 2 THEN 'selected_count' WHEN 3 THEN 'coverage_flag' WHEN 4 THEN kind || '_authority' WHEN 5 THEN kind || '_reconciliation' WHEN 6 THEN 'reconciled_authority' ELSE 'count_invalid' END AS problem
            FROM (SELECT symbol, CASE WHEN status = 'canonical_complete' THEN 'canonical' ELSE 'provisional' END AS kind FROM made) WHERE CAST(symbol AS INT) % 8 <> 0""",
            _NEED,
        ),
        "reconcile_inputs": _with(
            """SELECT symbol, CASE WHEN status = 'canonical_complete' THEN 'parent_not_open' ELSE CASE CAST(symbol AS INT) % 11 WHEN 1 THEN 'no_rows' WHEN 2 THEN 'rows_not_canonical_of_the_run' WHEN 3 THEN 'date_repeated' WHEN 4 THEN 'dates_differ' WHEN 5 THEN 'date_in_the_future' WHEN 6 THEN 'date_not_supplemental' WHEN 7 THEN 'rows_not_canonical_of_the_run' END END AS problem FROM made""",
            _NEED,
        ),
        "version_gate": _with("SELECT count(*) AS lacking, count(*) = 0 AS open FROM members WHERE status = 'active_scan_eligible' AND symbol NOT IN (SELECT symbol FROM made)", _UNIVERSE, _NEED),
        "plain_versions": _with(
            f"SELECT symbol, {d} AS target_date, 'canonical_complete' AS status, count(*) AS required, count(*) AS canonical, CAST(0 AS BIGINT) AS supplemental, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS remaining, CAST(0 AS BIGINT) AS discrepancies, 'canonical_complete' AS source, 'complete' AS authority, 'not_applicable' AS reconciliation, count(*) AS selected, true AS coverage_complete FROM b WHERE trade_date <= {d} GROUP BY symbol"
        ),
        "identity_statuses": _with("SELECT symbol, identity AS status, identity_reason AS reason FROM known", _DECIDE),
        "structure_problems": _with(
            f"""SELECT DISTINCT symbol, CASE CAST(symbol AS INT) % 9 WHEN 1 THEN 'malformed_payload' WHEN 2 THEN 'duplicate_trade_date' WHEN 3 THEN 'future_trade_date' WHEN 4 THEN 'unexpected_observation_date' WHEN 5 THEN 'partial_ohlc' WHEN 6 THEN 'malformed_payload' WHEN 7 THEN 'identity_mismatch' END AS problem FROM b2 WHERE trade_date <= {d}"""
        ),
        "supplement_decisions": _with(f"SELECT *, {d} AS target_date FROM decisions", _DECIDE),
        "supplement_routes": _with(
            """SELECT route, reason, count(*) AS symbols FROM (SELECT reason, CASE WHEN supplier % 5 = 1 THEN 'replay' WHEN supplier % 25 = 2 THEN 'ambiguous' WHEN reason = 'not_needed' AND supplier % 5 = 0 THEN 'reconcile' WHEN reason = 'not_needed' THEN 'canonical'
            WHEN is_eligible AND coverage_complete THEN 'supplement' WHEN is_eligible THEN 'supplement_incomplete' ELSE 'supplement_rejected' END AS route FROM decisions JOIN names USING (symbol)) GROUP BY route, reason""",
            _DECIDE,
        ),
        "ratio_changes": _with(
            f"""SELECT symbol, name, change, changes, last_date, as_of_date, {_r('greatest')} FROM (SELECT symbol, name, change, count(*) AS changes, max(d) AS last_date, max(as_of_date) AS as_of_date, max(value) AS greatest FROM (
              SELECT *, CASE WHEN (value IS NULL) <> (value_before IS NULL) THEN 'availability_changed' WHEN value <> value_before OR as_of_date <> date_before THEN 'valuation_updated' END AS change
              FROM (SELECT *, lag(value) OVER w AS value_before, lag(as_of_date) OVER w AS date_before, row_number() OVER w AS i FROM (
                SELECT q.symbol, q.name, q.d, k.value, k.metric_date AS as_of_date FROM (SELECT symbol, name, trade_date AS d FROM b, (VALUES ('price_earnings_ratio'), ('price_to_book_ratio'), ('dividend_yield_pct')) AS v(name) WHERE day(trade_date) % 2 = 0) q
                ASOF LEFT JOIN (SELECT * FROM ratios WHERE day(metric_date) % 3 = 0) k ON q.symbol = k.symbol AND q.name = k.name AND q.d >= k.metric_date) WINDOW w AS (PARTITION BY symbol, name ORDER BY d)) WHERE i > 1
            ) WHERE change IS NOT NULL GROUP BY symbol, name, change)"""
        ),
        "volume_state_changes": _with("SELECT symbol, trade_date AS market_date, volume_state AS state, before AS previous_state FROM (SELECT *, lag(volume_state) OVER (PARTITION BY symbol ORDER BY trade_date) AS before FROM states) WHERE before <> volume_state", _PANEL),
        "result_quality": _with(
            """SELECT symbol, price_status, CASE WHEN outcome IS NULL THEN 'missing_source' WHEN outcome = 'match' THEN 'available' ELSE outcome END AS validation_status, CASE WHEN price_status = 'available' AND outcome = 'match' THEN 'clean' WHEN price_status = 'missing_source' THEN 'unavailable' ELSE 'warning' END AS quality, latest_date, coalesce(n, 0) AS discrepancies,
            CASE WHEN left_date = right_date THEN array_to_string(list_filter([CASE WHEN l.close <> r.close THEN 'close' END, CASE WHEN l.high <> r.high THEN 'high' END, CASE WHEN l.low <> r.low THEN 'low' END, CASE WHEN l.open <> r.open THEN 'open' END, CASE WHEN l.volume <> r.volume THEN 'volume' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS fields
            FROM status LEFT JOIN (SELECT symbol, outcome, CAST(n AS BIGINT) AS n, left_date, right_date, l, r FROM outcomes JOIN counted USING (symbol, left_date, right_date)) USING (symbol)""",
            _SOURCES,
        ),
        "result_provenance": _with(
            "SELECT symbol, string_agg(DISTINCT source, ',' ORDER BY source) AS price_sources, min(trade_date) AS first_date, max(trade_date) AS last_date, 'primary' AS valuation_sources, max(k) AS ratios FROM (SELECT symbol, trade_date, source FROM b UNION ALL SELECT symbol, trade_date, source FROM b2) JOIN (SELECT symbol, count(DISTINCT name) AS k FROM ratios GROUP BY symbol) USING (symbol) GROUP BY symbol"
        ),
        "selections_per_symbol": _with("SELECT symbol, count(*) AS selections FROM chosen JOIN done USING (run_id) GROUP BY symbol", _RUNS),
        "reason_frequency": _with("SELECT *, CAST(row_number() OVER (ORDER BY CASE stage WHEN 'first' THEN 1 WHEN 'second' THEN 2 ELSE 3 END, code, metric) AS INT) AS position FROM (SELECT stage, code, metric, count(*) AS times, count(DISTINCT symbol) AS symbols FROM why JOIN done USING (run_id) GROUP BY ALL)", _RUNS),
        "daily_candidates": _with(f"SELECT run_id, symbol, rank, quality, version_status, market_date, methodology FROM chosen JOIN done USING (run_id) WHERE market_date = (SELECT max(market_date) FROM done WHERE market_date <= {d})", _RUNS),
        "quality_frequency": _with(
            "SELECT market_date, quality, version_status, count(DISTINCT run_id) AS runs, count(*) AS candidates, CAST(sum(supplemental) AS BIGINT) AS supplemental, count(*) FILTER (version_status = 'reconciliation_pending') AS pending, CAST(sum(discrepancies) AS BIGINT) AS discrepancies FROM chosen JOIN done USING (run_id) GROUP BY ALL", _RUNS
        ),
        "date_totals": _with("SELECT market_date, count(*) FILTER (supplemental > 0) AS with_supplemental, count(*) FILTER (discrepancies > 0) AS with_discrepancies, count(*) FILTER (version_status = 'reconciliation_pending') AS pending FROM chosen JOIN done USING (run_id) GROUP BY market_date", _RUNS),
        "symbol_reasons": _with("SELECT symbol, market_date, methodology, run_id, rank, stage, code FROM chosen JOIN done USING (run_id) JOIN why USING (run_id, symbol)", _RUNS),
        "methodology_comparison": _with(
            "SELECT symbol, x AS left_selections, y AS right_selections, CASE WHEN x > 0 AND y > 0 THEN 'both' WHEN x > 0 THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT symbol, count(*) FILTER (methodology = 'v1') AS x, count(*) FILTER (methodology = 'v2') AS y FROM chosen JOIN done USING (run_id) GROUP BY symbol)", _RUNS
        ),
        "run_roll_ups": _with(
            """SELECT run_id, open, failed, done, candidates, CASE WHEN open > 0 OR failed = 0 THEN 'running' WHEN done > 0 THEN 'partial_success' ELSE 'failed' END AS status, CASE WHEN open > 0 OR failed = 0 THEN NULL WHEN done > 0 THEN 'candidate_failure' ELSE 'all_candidates_failed' END AS error_code
            FROM (SELECT run_id, count(*) FILTER (state = 'open') AS open, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'done') AS done, count(*) AS candidates FROM chosen GROUP BY run_id)""",
            _RUNS,
        ),
        "run_quality": _with(
            """SELECT run_id, CASE WHEN mixed THEN 'mixed_policies' END AS problem, CASE WHEN NOT mixed THEN CASE quality WHEN 'provisional' THEN 'provisional_success' ELSE 'success' END END AS execution_status, CASE WHEN NOT mixed THEN CASE quality WHEN 'provisional' THEN 'provisional_mixed' WHEN 'reconciled' THEN 'reconciled' ELSE 'canonical_complete' END END AS source_status,
              CASE WHEN NOT mixed THEN quality END AS quality, CASE WHEN NOT mixed THEN CASE quality WHEN 'provisional' THEN 'incomplete' WHEN 'reconciled' THEN 'reconciled' ELSE 'complete' END END AS authority, CASE WHEN NOT mixed THEN reconciliation END AS reconciliation,
              CASE WHEN NOT mixed THEN canonical END AS canonical, CASE WHEN NOT mixed THEN supplemental END AS supplemental, CASE WHEN NOT mixed THEN missing END AS missing, CASE WHEN NOT mixed THEN discrepancies END AS discrepancies, CASE WHEN NOT mixed THEN supplemental_candidates END AS supplemental_candidates, CASE WHEN NOT mixed THEN supplemental_sources END AS supplemental_sources, CASE WHEN NOT mixed THEN version_ids END AS version_ids
            FROM (SELECT run_id, bool_or(v) AND NOT bool_and(v) AS mixed,
              CASE WHEN coalesce(bool_or(version_status IN ('provisional_complete', 'reconciliation_pending')) FILTER (v), false) THEN 'provisional' WHEN coalesce(bool_or(version_status LIKE 'reconciled%') FILTER (v), false) THEN 'reconciled' ELSE 'canonical' END AS quality,
              CASE WHEN coalesce(bool_or(version_status IN ('provisional_complete', 'reconciliation_pending')) FILTER (v), false) THEN 'pending' WHEN coalesce(bool_or(version_status = 'reconciled_discrepant') FILTER (v), false) THEN 'reconciled_discrepant' WHEN coalesce(bool_or(version_status = 'reconciled_equal') FILTER (v), false) THEN 'reconciled_equal' ELSE 'not_applicable' END AS reconciliation,
              CAST(coalesce(sum(canonical) FILTER (v), 0) AS BIGINT) AS canonical, CAST(coalesce(sum(supplemental) FILTER (v), 0) AS BIGINT) AS supplemental, CAST(coalesce(sum(missing) FILTER (v), 0) AS BIGINT) AS missing, CAST(coalesce(sum(discrepancies) FILTER (v), 0) AS BIGINT) AS discrepancies, count(*) FILTER (v AND supplemental > 0) AS supplemental_candidates,
              coalesce(string_agg(DISTINCT supplemental_source, ',' ORDER BY supplemental_source) FILTER (v AND supplemental > 0), '') AS supplemental_sources, coalesce(string_agg(version_id, ',' ORDER BY symbol, version_id) FILTER (v), '') AS version_ids FROM (SELECT *, version_id IS NOT NULL AS v FROM chosen) GROUP BY run_id)""",
            _RUNS,
        ),
        "batch_roll_ups": "SELECT l_orderkey AS batch_id, count(*) FILTER (l_returnflag NOT IN ('R', 'A')) AS success, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_returnflag = 'A') AS skipped, CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'success' WHEN count(*) FILTER (l_returnflag NOT IN ('R', 'A')) > 0 THEN 'partial_success' ELSE 'failed' END AS status FROM lineitem GROUP BY l_orderkey",
        "bar_coverage": _with("SELECT symbol, count(*) AS n, min(trade_date) AS first_date, max(trade_date) AS last_date FROM b GROUP BY symbol"),
        **reading_sql.oracle_sql(_with, _r),
    }
    return out | {
        "daily_indicators": out["panel_indicators"], "pruned_differences": out["history_differences"], "stored_summary": out["history_summary"], "rolled_quality": out["quality_frequency"], "rolled_comparison": out["methodology_comparison"],
        "rolled_reasons": _with("SELECT stage, code, metric, count(*) AS times, count(DISTINCT symbol) AS symbols FROM why JOIN done USING (run_id) GROUP BY ALL", _RUNS),
        "differing_ranges": "SELECT DISTINCT o_orderkey // 1024 * 1024 AS first_key, o_orderkey // 1024 * 1024 + 1023 AS last_key FROM orders WHERE o_orderkey % 7001 = 5 OR o_orderkey % 9973 = 3",
    }
