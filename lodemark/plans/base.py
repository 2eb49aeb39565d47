"""SQL of the derived views, for oracles."""

TICKS = """ticks AS (
  SELECT event_type AS symbol, ts, event_id AS seq, value AS price, user_id,
         CASE WHEN regexp_extract(props, '"k": (-?[0-9]+)', 1) <> '' THEN regexp_extract(props, '"k": (-?[0-9]+)', 1)::DOUBLE END AS volume
  FROM events)"""

_OHLCV = """first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY ts, seq) AS close, sum(volume) AS volume, count(*) AS n"""

BARS = f"""{TICKS}, bars AS (
  SELECT symbol, date_trunc('hour', ts) AS ts, {_OHLCV} FROM ticks GROUP BY symbol, date_trunc('hour', ts))"""

DAYS = f"""{TICKS}, days AS (
  SELECT symbol, ts::DATE AS date, {_OHLCV}, max(ts) AS last_ts FROM ticks GROUP BY symbol, ts::DATE)"""

TRADES = """trades AS (
  SELECT l_returnflag AS strategy, o_orderpriority AS regime, l_shipdate AS exit_ts, o_orderdate AS entry_ts, l_orderkey AS orderkey,
         l_linenumber AS line, l_extendedprice * (0.05::DOUBLE - l_discount) AS pnl, l_extendedprice AS notional,
         l_tax * l_extendedprice / 100 AS cost, l_quantity AS volume, date_diff('day', o_orderdate, l_shipdate) AS hold_days
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
