"""DuckDB SQL for the registered queries.

Every piece is a named common table expression; a query names the one it reads, and the
ones below it are added in front. The formulas are written out again here, mostly in
another way than in the package (joins for windows, a series for the normal CDF).
"""

from __future__ import annotations

import re

SYMBOL = "CASE {} % 3 WHEN 0 THEN 'SPXW' WHEN 1 THEN 'NDXP' ELSE 'RUTW' END"
AS_OF = "DATE '2002-01-01'"
R = "0.05"
PDF = "(exp(-0.5*({0})*({0}))/sqrt(2*pi()))"


def ncdf(x: str) -> str:
    """Normal CDF from its power series."""
    z = f"greatest(-15.0, least(15.0, {x}))"
    terms = (
        f"[exp((2*n+1)*ln(abs({z})) - (n+1)*ln(2) - lgamma(n+1.5) + 0.5*ln(pi())) "
        "FOR n IN range(300)]"
    )
    return (
        f"(CASE WHEN ({x}) = 0 THEN 0.5 ELSE 0.5 + sign({x}) * {PDF.format(z)} "
        f"* list_sum({terms}) END)"
    )


def d1(s: str, k: str, t: str, v: str) -> str:
    return f"((ln(({s})/({k})) + ({R} + 0.5*({v})*({v}))*({t})) / (({v})*sqrt({t})))"


TAU = f"(greatest(1, datediff('day', {AS_OF}, expiration))/365.0)"
CALL = "option_type='C'"
LEG = "symbol, expiration, strike, option_type"

CTES: dict[str, str] = {}

CTES["raw_chain"] = f"""
SELECT l_shipdate + to_microseconds((l_orderkey*1000003 + l_partkey*10007 + l_suppkey*101
         + CAST(round(l_extendedprice*100) AS BIGINT)*7919) % 86400000000) AS ts,
       {SYMBOL.format('l_suppkey')} AS symbol,
       {AS_OF} + CAST(7*(l_linenumber-1) AS INTEGER) AS expiration,
       CAST(900 + 5*(l_partkey % 21) AS DOUBLE) AS strike,
       CASE WHEN l_linestatus='O' THEN 'C' ELSE 'P' END AS option_type,
       CASE WHEN l_returnflag<>'R' THEN CAST(10*l_quantity AS BIGINT) END AS oi,
       CAST(floor(l_extendedprice/1000) AS BIGINT) AS volume,
       CASE WHEN l_discount<>0 THEN l_discount + l_tax + CAST(0.10 AS DOUBLE) END AS iv,
       CAST(940 + 10*(l_suppkey % 3) AS DOUBLE) AS underlying_price,
       l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax
FROM lineitem"""

CTES["chain"] = f"""
SELECT *, CASE WHEN l_quantity > 5 THEN last_price - 0.5 END AS bid,
       CASE WHEN l_quantity > 5 THEN last_price + 0.5 END AS ask
FROM (SELECT *, greatest(0.0, CASE WHEN {CALL} THEN underlying_price - strike
                              ELSE strike - underlying_price END) + 2.0 + l_tax*100 AS last_price
      FROM raw_chain)"""

TIES = "ts DESC"

CTES["snap"] = f"""
SELECT * FROM chain
QUALIFY row_number() OVER (PARTITION BY {LEG} ORDER BY {TIES}) = 1"""

CTES["eod"] = f"""
SELECT symbol, expiration, strike, option_type,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS open_interest
FROM (SELECT {SYMBOL.format('l_suppkey')} AS symbol,
             {AS_OF} + CAST(7*(l_linenumber-1) AS INTEGER) AS expiration,
             CAST(900 + 5*(l_partkey % 21) AS DOUBLE) AS strike,
             CASE WHEN l_linestatus='O' THEN 'C' ELSE 'P' END AS option_type, l_quantity
      FROM lineitem WHERE l_returnflag='A')
GROUP BY ALL"""


def filled(source: str) -> str:
    return f"""
SELECT s.* REPLACE (CASE WHEN coalesce(s.oi, 0) = 0 THEN coalesce(e.open_interest, 0)
                    ELSE s.oi END AS oi)
FROM {source} s LEFT JOIN eod e USING ({LEG})"""


CTES["filled"] = filled("snap")

_D1 = d1("underlying_price", "strike", TAU, "iv")
CTES["greeks"] = f"""
SELECT *, CASE WHEN iv > 0 THEN {PDF.format('dd')}/(underlying_price*iv*sqrt(tau)) END AS gamma,
       CASE WHEN iv > 0 THEN {ncdf('dd')} - CASE WHEN {CALL} THEN 0 ELSE 1 END END AS delta
FROM (SELECT *, {TAU} AS tau, CASE WHEN iv > 0 THEN {_D1} END AS dd FROM filled)"""

CTES["spots"] = """
SELECT symbol, arg_max(underlying_price, {'e': expiration, 's': strike, 'o': option_type}) AS spot
FROM greeks WHERE underlying_price IS NOT NULL GROUP BY symbol"""

CTES["g"] = "SELECT * FROM greeks JOIN spots USING (symbol)"


def gex(weight: str) -> str:
    unit = f"coalesce(gamma*{weight}, 0)*100*spot*spot*0.01"
    return f"""
SELECT symbol, max(spot) AS underlying_price, strike,
       coalesce(sum({unit}) FILTER ({CALL}), 0) AS call_gex,
       coalesce(-sum({unit}) FILTER (option_type='P'), 0) AS put_gex,
       coalesce(sum({unit}) FILTER ({CALL}), 0)
         - abs(coalesce(sum({unit}) FILTER (option_type='P'), 0)) AS net_gex
FROM g GROUP BY symbol, strike"""


CTES["gex_oi"] = gex("oi")
CTES["gex_volume"] = gex("volume")
CTES["gex_totals"] = """
SELECT symbol, 'oi' AS weight, max(underlying_price) AS underlying_price,
       sum(net_gex) AS net_total, sum(abs(net_gex)) AS gross_total FROM gex_oi GROUP BY symbol
UNION ALL
SELECT symbol, 'volume', max(underlying_price), sum(net_gex), sum(abs(net_gex))
FROM gex_volume GROUP BY symbol"""


def tops(curve: str, value: str) -> str:
    return f"""
SELECT symbol, 'positive' AS side, rank, strike, {value} FROM
 (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {value} DESC, strike) AS rank FROM {curve})
WHERE rank <= 5
UNION ALL
SELECT symbol, 'negative', rank, strike, {value} FROM
 (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {value}, strike) AS rank FROM {curve})
WHERE rank <= 5"""


CTES["gex_tops"] = tops("gex_oi", "net_gex")

CTES["valid_oi"] = """
SELECT *, CASE WHEN option_type='C' THEN 1.0 ELSE -1.0 END AS sgn, CAST(oi AS DOUBLE) AS w
FROM g WHERE coalesce(oi,0)<>0 AND iv>0 AND strike>0 AND spot>0"""
CTES["valid_volume"] = CTES["valid_oi"].replace("oi", "volume")
CTES["vanna"] = f"""
SELECT symbol, max(spot) AS underlying_price, strike,
       sum(sgn * (-{PDF.format('dd')}*(dd - iv*sqrt(tau))/iv) * w*100*spot*0.01) AS vanna_exposure
FROM valid_oi GROUP BY symbol, strike"""
CTES["charm"] = f"""
SELECT symbol, max(spot) AS underlying_price, strike,
       sum(sgn * (-{PDF.format('dd')}*({R}/(iv*sqrt(tau)) - (dd - iv*sqrt(tau))/(2*tau)))
           * w*100*spot/252.0) AS charm_exposure
FROM valid_oi GROUP BY symbol, strike"""
CTES["vanna_tops"] = tops("vanna", "vanna_exposure")


def zero(valid: str, keys: str = "symbol") -> str:
    dg = d1("s", "strike", "tau", "iv")
    return f"""
SELECT {keys}, CASE WHEN bool_and(isfinite(total)) THEN
       arg_min(s + (-total/nullif(nxt-total,0))*(s_nxt - s), {{'d': abs(s-spot), 'i': i}})
         FILTER (nxt IS NOT NULL AND sign(total) <> sign(nxt)) END AS zero_gamma
FROM (SELECT *, lead(total) OVER (PARTITION BY {keys} ORDER BY i) AS nxt,
             lead(s) OVER (PARTITION BY {keys} ORDER BY i) AS s_nxt
      FROM (SELECT {keys}, spot, i, s, sum(sgn*w*{PDF.format(dg)}/(s*iv*sqrt(tau))*100*s*s*0.01) AS total
            FROM (SELECT v.*, r.i, spot*0.95 + r.i*((spot*1.05 - spot*0.95)/400.0) AS s
                  FROM {valid} v, range(401) r(i))
            GROUP BY ALL))
GROUP BY {keys}"""


CTES["zero_oi"] = zero("valid_oi")
CTES["zero_volume"] = zero("valid_volume")
CTES["zero_both"] = """
SELECT symbol, 'oi' AS weight, zero_gamma FROM zero_oi
UNION ALL SELECT symbol, 'volume', zero_gamma FROM zero_volume"""


def pain(book: str, keys: str) -> str:
    """Strike against strike, as defined; the package uses running sums."""
    return f"""
SELECT {keys}, k AS strike,
       100*sum(CASE WHEN option_type='C' THEN greatest(k - strike, 0)
                    ELSE greatest(strike - k, 0) END * coalesce(oi, 0)) AS pain
FROM {book} JOIN (SELECT DISTINCT {keys}, strike AS k FROM {book}) USING ({keys})
GROUP BY {keys}, k"""


def lowest(curve: str, keys: str) -> str:
    return f"""
SELECT {keys}, strike, pain FROM {curve}
QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY pain, strike) = 1"""


CTES["pain_curve"] = pain("g", "symbol, expiration")
CTES["pain_best"] = lowest("pain_curve", "symbol, expiration")
CTES["pooled"] = """
SELECT * FROM g QUALIFY dense_rank() OVER (PARTITION BY symbol ORDER BY expiration) <= 5"""
CTES["pain_agg_curve"] = pain("pooled", "symbol")
CTES["pain_agg"] = lowest("pain_agg_curve", "symbol")

CTES["wall_sums"] = """
SELECT symbol, option_type, strike, 'oi' AS weight, CAST(sum(oi) AS DOUBLE) AS value
FROM g GROUP BY ALL
UNION ALL
SELECT symbol, option_type, strike, 'volume', CAST(sum(volume) AS DOUBLE) FROM g GROUP BY ALL"""
CTES["wall_ranks"] = """
SELECT *, row_number() OVER (PARTITION BY symbol, weight, option_type ORDER BY value DESC, strike) AS rank
FROM wall_sums WHERE value > 0 QUALIFY rank <= 3"""
CTES["regimes"] = """
SELECT symbol, weight, score, net_gex, c AS call_wall_total, p AS put_wall_total,
       CASE WHEN score > 0.2 THEN 'bullish' WHEN score < -0.2 THEN 'bearish' ELSE 'neutral' END AS label
FROM (SELECT symbol, weight, net_total AS net_gex, c, p,
             greatest(-1, least(1, 0.6*CASE WHEN c+p > 0 THEN (c-p)/(c+p) ELSE 0 END
               + 0.4*CASE WHEN gross_total > 0 THEN net_total/gross_total ELSE 0 END)) AS score
      FROM gex_totals LEFT JOIN
        (SELECT symbol, weight, coalesce(sum(value) FILTER (option_type='C'), 0) AS c,
                coalesce(sum(value) FILTER (option_type='P'), 0) AS p
         FROM wall_ranks GROUP BY ALL) USING (symbol, weight))"""

CTES["pin_rows"] = f"""
SELECT symbol, strike, oi, iv, spot,
       abs(-{PDF.format('x')}*({R}/(iv*sqrt(1/365.0)) - (x - iv*sqrt(1/365.0))/(2/365.0))) AS ch,
       median(iv) OVER (PARTITION BY symbol) AS med
FROM (SELECT *, {d1('spot', 'strike', '1/365.0', 'iv')} AS x FROM g
      WHERE expiration = {AS_OF} AND iv > 0 AND strike > 0)"""
CTES["pins"] = """
SELECT symbol, strike, raw/sum(raw) OVER (PARTITION BY symbol) AS prob, oi, abs_charm, atm_iv
FROM (SELECT symbol, strike, CAST(sum(coalesce(oi,0)) AS BIGINT) AS oi, sum(ch) AS abs_charm, median(iv) AS atm_iv,
             (sum(coalesce(oi,0)) + 0.5*sum(ch))
              * exp(-0.5*pow((strike - any_value(spot))/greatest(1e-4, any_value(spot)*any_value(med)*sqrt(1/365.0)), 2)) AS raw
      FROM pin_rows GROUP BY symbol, strike)"""

CTES["legs"] = f"""
SELECT symbol, expiration, strike, option_type, {TAU} AS tau,
       CASE WHEN bid > 0 AND ask > 0 THEN (bid+ask)/2 WHEN last_price > 0 THEN last_price END AS px
FROM snap"""
CTES["parity"] = f"""
SELECT symbol, median(spot) FILTER (spot > 1 AND spot < 1e6) AS parity_spot
FROM (SELECT e.symbol, e.expiration, p.spot
      FROM (SELECT DISTINCT symbol, expiration FROM legs WHERE px IS NOT NULL
            QUALIFY dense_rank() OVER (PARTITION BY symbol ORDER BY expiration) <= 3) e
      LEFT JOIN (SELECT c.symbol, c.expiration, c.strike*exp(-{R}*c.tau) + c.px - p.px AS spot
                 FROM legs c JOIN legs p USING (symbol, expiration, strike)
                 WHERE c.option_type='C' AND p.option_type='P' AND c.px IS NOT NULL AND p.px IS NOT NULL
                 QUALIFY row_number() OVER (PARTITION BY c.symbol, c.expiration
                                            ORDER BY abs(c.px-p.px), c.strike) = 1) p
      USING (symbol, expiration))
GROUP BY symbol"""

CTES["atm"] = """
SELECT symbol, avg(iv) FILTER (gap = nearest) AS atm_iv
FROM (SELECT *, min(gap) OVER (PARTITION BY symbol) AS nearest
      FROM (SELECT symbol, iv, CASE WHEN iv IS NOT NULL AND
                     expiration = min(expiration) OVER (PARTITION BY symbol)
                     THEN abs(strike-spot) END AS gap FROM g))
GROUP BY symbol"""


def quarter(kind: str, target: float) -> str:
    return f"""
SELECT symbol, expiration, iv FROM g
WHERE option_type='{kind}' AND iv IS NOT NULL AND delta IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY symbol, expiration
                           ORDER BY round(abs(delta - {target}), 12), strike) = 1"""


CTES["call25"] = quarter("C", 0.25)
CTES["put25"] = quarter("P", -0.25)
CTES["skews"] = """
SELECT symbol, expiration, c.iv - p.iv AS skew FROM call25 c JOIN put25 p USING (symbol, expiration)"""
CTES["terms"] = f"""
SELECT symbol, expiration, greatest(0, datediff('day', {AS_OF}, expiration)) AS days_to_expiry,
       n.atm_iv, c.iv AS call_25d_iv, p.iv AS put_25d_iv, c.iv - p.iv AS risk_reversal_25d
FROM (SELECT symbol, expiration, avg(iv) AS atm_iv FROM
        (SELECT * FROM g WHERE iv > 0 QUALIFY row_number() OVER (PARTITION BY symbol, expiration
           ORDER BY abs(strike-spot), strike, option_type) <= 2) GROUP BY ALL) n
LEFT JOIN call25 c USING (symbol, expiration) LEFT JOIN put25 p USING (symbol, expiration)"""

CTES["opens"] = "SELECT symbol, arg_min(underlying_price + 5, ts) AS open_price FROM chain GROUP BY symbol"
CTES["moves"] = f"""
SELECT f.symbol, f.spot AS underlying_price, o.open_price, abs(f.spot - o.open_price) AS realized_move,
       (c.last_price + p.last_price)/sqrt(greatest(1, f.dte)) AS implied_move, f.dte AS implied_dte,
       abs(f.spot - o.open_price)/((c.last_price + p.last_price)/sqrt(greatest(1, f.dte))) AS ratio
FROM (SELECT symbol, spot, expiration, strike, datediff('day', {AS_OF}, expiration) AS dte
      FROM g WHERE last_price IS NOT NULL AND expiration >= {AS_OF}
      QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY expiration, abs(strike-spot), strike) = 1) f
LEFT JOIN g c ON c.symbol=f.symbol AND c.expiration=f.expiration AND c.strike=f.strike AND c.option_type='C'
LEFT JOIN g p ON p.symbol=f.symbol AND p.expiration=f.expiration AND p.strike=f.strike AND p.option_type='P'
LEFT JOIN opens o ON o.symbol=f.symbol"""


# Implied vol by bisection in a recursive query.
def _price(v: str) -> str:
    a = d1("s", "k", "t", v)
    b = f"({a} - ({v})*sqrt(t))"
    call = f"(s*{ncdf(a)} - k*exp(-{R}*t)*{ncdf(b)})"
    return f"({call} - CASE WHEN is_call THEN 0 ELSE s - k*exp(-{R}*t) END)"


CTES["unsolved"] = f"""
SELECT {LEG}, underlying_price AS s, strike AS k, {TAU} AS t, {CALL} AS is_call,
       CASE WHEN last_price > 0 THEN last_price WHEN bid>0 AND ask>0 THEN (bid+ask)/2 ELSE 0 END AS px
FROM filled WHERE iv IS NULL OR iv <= 0 OR iv > 5"""
CTES["bisect"] = f"""
SELECT {LEG}, s, k, t, is_call, px, CAST(0.01 AS DOUBLE) AS lo, CAST(5.0 AS DOUBLE) AS hi, 0 AS step
FROM unsolved
WHERE px > 0 AND px >= greatest(0, CASE WHEN is_call THEN s-k ELSE k-s END)
  AND ({_price('0.01')} - px) * ({_price('5.0')} - px) <= 0
UNION ALL
SELECT {LEG}, s, k, t, is_call, px,
       CASE WHEN {_price('(lo+hi)/2')} < px THEN (lo+hi)/2 ELSE lo END,
       CASE WHEN {_price('(lo+hi)/2')} < px THEN hi ELSE (lo+hi)/2 END, step + 1
FROM bisect WHERE step < 30"""
CTES["solved"] = f"""
SELECT f.symbol, f.expiration, f.strike, f.option_type,
       coalesce((b.lo + b.hi)/2, f.iv) AS iv, b.lo IS NOT NULL AS solved
FROM filled f LEFT JOIN (SELECT * FROM bisect WHERE step = 30) b USING ({LEG})"""

# History: at each grid time the newest row of each contract that is young enough.


def series(every: str, lookback: str) -> str:
    bucket = (
        f"time_bucket(INTERVAL {every}, {{}} - INTERVAL 1 MICROSECOND, TIMESTAMP '1970-01-01')"
        f" + INTERVAL {every}"
    )
    return f"""
SELECT c.*, g.snapshot_ts
FROM (SELECT symbol, expiration, strike, option_type, snapshot_ts
      FROM (SELECT DISTINCT {LEG} FROM chain) JOIN
           (SELECT symbol, unnest(generate_series({bucket.format('min(ts)')}, {bucket.format('max(ts)')},
                   INTERVAL {every})) AS snapshot_ts FROM chain GROUP BY symbol) USING (symbol)) g
ASOF JOIN chain c ON g.symbol = c.symbol AND g.expiration = c.expiration AND g.strike = c.strike
  AND g.option_type = c.option_type AND g.snapshot_ts >= c.ts
WHERE c.ts > g.snapshot_ts - INTERVAL {lookback}"""


CTES["daily"] = series("1 DAY", "2 DAYS")
CTES["hist"] = series("30 DAYS", "60 DAYS")
CTES["live"] = "SELECT * FROM snap WHERE ts > TIMESTAMP '2002-01-01 00:00:00' - INTERVAL 400 DAYS"
CTES["hist_filled"] = filled("hist")
HTAU = "(greatest(1, datediff('day', CAST(snapshot_ts AS DATE), expiration))/365.0)"
CTES["hist_g"] = f"""
SELECT *, {PDF.format('dd')}/(underlying_price*iv*sqrt(tau)) AS gamma, underlying_price AS spot
FROM (SELECT *, {HTAU} AS tau, {d1('underlying_price', 'strike', HTAU, 'iv')} AS dd FROM hist_filled)"""
CTES["hist_gex"] = """
SELECT snapshot_ts, symbol, max(spot) AS underlying_price, sum(c) - sum(abs(p)) AS net_total,
       sum(abs(c - abs(p))) AS gross_total
FROM (SELECT snapshot_ts, symbol, strike, max(spot) AS spot,
             coalesce(sum(coalesce(gamma*oi,0)*spot*spot) FILTER (option_type='C'), 0) AS c,
             coalesce(sum(coalesce(gamma*oi,0)*spot*spot) FILTER (option_type='P'), 0) AS p
      FROM hist_g GROUP BY ALL)
GROUP BY snapshot_ts, symbol"""
CTES["hist_valid"] = """
SELECT *, CASE WHEN option_type='C' THEN 1.0 ELSE -1.0 END AS sgn, CAST(volume AS DOUBLE) AS w
FROM hist_g WHERE coalesce(volume,0)<>0 AND iv>0"""
CTES["hist_zero"] = zero("hist_valid", "snapshot_ts, symbol")
CTES["hist_pain_curve"] = pain("hist_g", "snapshot_ts, symbol, expiration")
CTES["hist_pain"] = lowest("hist_pain_curve", "snapshot_ts, symbol, expiration")
CTES["hist_atm"] = """
SELECT snapshot_ts, symbol, avg(iv) FILTER (gap = nearest) AS atm_iv
FROM (SELECT *, min(gap) OVER (PARTITION BY snapshot_ts, symbol) AS nearest
      FROM (SELECT snapshot_ts, symbol, CASE WHEN iv IS NOT NULL AND
                     expiration = min(expiration) OVER (PARTITION BY snapshot_ts, symbol)
                     THEN abs(strike-spot) END AS gap, iv FROM hist_g))
GROUP BY ALL"""

# Tape.
CTES["ev"] = """
SELECT ts, event_id AS seq, user_id AS instrument_id, event_type, value,
       CAST(props->>'$.k' AS BIGINT) AS k FROM events"""
CONTRACT_SQL = f"""{SYMBOL.format('instrument_id')} AS symbol, DATE '2024-02-02' AS expiration,
       CAST(900 + 5*(instrument_id // 6) AS DOUBLE) AS strike,
       CASE WHEN instrument_id % 2 = 0 THEN 'C' ELSE 'P' END AS option_type"""
CTES["trades"] = f"""
SELECT *, bid + 0.10 AS ask FROM
 (SELECT ts, seq, instrument_id, {CONTRACT_SQL}, value AS price, k + 1 AS size, event_type AS exchange,
         value - CASE seq % 3 WHEN 0 THEN CAST(0.10 AS DOUBLE) WHEN 1 THEN 0.0 ELSE 0.05 END AS bid,
         CASE seq % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS side FROM ev)"""
CTES["quotes"] = """
SELECT instrument_id, ts, seq, value - 0.05 AS bid, value + 0.05 AS ask FROM ev WHERE event_type='view'"""
CTES["prints"] = """
SELECT instrument_id, ts, seq, value AS price, k AS size FROM ev WHERE event_type='purchase'"""
CTES["quoted"] = """
SELECT t.*, q.bid, q.ask FROM prints t ASOF LEFT JOIN quotes q
ON t.instrument_id = q.instrument_id AND t.ts >= q.ts"""
#: Hours as times make many ties; the sequence decides.
CTES["quoted_ties"] = """
SELECT t.instrument_id, date_trunc('hour', t.ts) AS ts, t.seq, t.price, t.size, q.bid, q.ask
FROM (SELECT *, epoch_ms(date_trunc('hour', ts))//3600000*1000000000 + seq AS place FROM prints) t
ASOF LEFT JOIN (SELECT *, epoch_ms(date_trunc('hour', ts))//3600000*1000000000 + seq AS place FROM quotes) q
ON t.instrument_id = q.instrument_id AND t.place >= q.place"""
CTES["sided"] = """
SELECT *, CASE WHEN side <> 0 THEN -side*size*price*100 END AS signed_premium FROM
 (SELECT *, CASE WHEN bid>0 AND ask>0 THEN sign(price - (bid+ask)/2) END AS side FROM quoted)"""
CTES["records"] = """
SELECT instrument_id, ts, seq,
       CASE event_type WHEN 'view' THEN 'quote' WHEN 'purchase' THEN 'trade'
            WHEN 'signup' THEN 'cumulative_volume' ELSE 'open_interest' END AS kind, value, k
FROM ev WHERE event_type <> 'click'"""
CTES["state"] = """
SELECT r.instrument_id, r.ts, r.seq, r.kind, q.bid, q.ask, p.price AS last_price,
       o.k*10 AS oi,
       CASE WHEN v.seq IS NULL AND p.seq IS NULL THEN NULL ELSE coalesce(v.k*10, 0) +
         coalesce((SELECT sum(x.size) FROM prints x WHERE x.instrument_id = r.instrument_id
                   AND x.ts <= r.ts AND (v.ts IS NULL OR x.ts > v.ts)), 0) END AS volume
FROM records r
ASOF LEFT JOIN quotes q ON r.instrument_id=q.instrument_id AND r.ts >= q.ts
ASOF LEFT JOIN prints p ON r.instrument_id=p.instrument_id AND r.ts >= p.ts
ASOF LEFT JOIN (SELECT * FROM records WHERE kind='open_interest') o
  ON r.instrument_id=o.instrument_id AND r.ts >= o.ts
ASOF LEFT JOIN (SELECT * FROM records WHERE kind='cumulative_volume') v
  ON r.instrument_id=v.instrument_id AND r.ts >= v.ts"""
CTES["lr"] = """
SELECT *, side*size AS signed_qty FROM
 (SELECT instrument_id, ts, seq, price, size, mid,
         CAST(CASE WHEN price > mid + 1e-9 THEN 1 WHEN price < mid - 1e-9 THEN -1
              ELSE coalesce(sign(price - prev), 0) END AS INTEGER) AS side
  FROM (SELECT *, (bid+ask)/2 AS mid,
               lag(price) OVER (PARTITION BY instrument_id ORDER BY ts, seq) AS prev FROM trades))"""
CTES["block_events"] = """
SELECT 'BLOCK' AS event_type, ts, symbol, expiration, strike, option_type, side, size, price,
       1 AS legs, exchange AS venues FROM trades WHERE size >= 90"""
CTES["unusual"] = f"""
SELECT 'UOA' AS event_type, max(ts) AS ts, {LEG}, 0 AS side, CAST(sum(size) AS BIGINT) AS size,
       CAST(NULL AS DOUBLE) AS price, count(*) AS legs, '' AS venues
FROM trades GROUP BY {LEG} HAVING sum(size) >= 2000"""
CTES["adv"] = f"""
SELECT {LEG}, avg(size)*20 AS avg_daily_volume FROM trades
WHERE option_type = 'C' GROUP BY {LEG}"""
CTES["unusual_adv"] = f"""
SELECT 'UOA' AS event_type, t.*, 0 AS side, avg_daily_volume
FROM (SELECT max(ts) AS ts, {LEG}, CAST(sum(size) AS BIGINT) AS size, count(*) AS legs
      FROM trades GROUP BY {LEG}) t LEFT JOIN adv USING ({LEG})
WHERE size >= CASE WHEN avg_daily_volume > 0 THEN avg_daily_volume*3.0 ELSE 4000 END"""
# Sweeps by walking each contract's tape row by row.
CTES["numbered"] = """
SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts, seq) AS rn FROM trades"""
CTES["flips"] = """
SELECT *, sum(flip) OVER (PARTITION BY instrument_id ORDER BY rn) AS run FROM
 (SELECT *, CASE WHEN side = lag(side) OVER (PARTITION BY instrument_id ORDER BY rn)
            THEN 0 ELSE 1 END AS flip FROM numbered)"""
CTES["clusters"] = """
SELECT a.instrument_id, a.rn, max(b.rn) AS upto, count(*) AS legs,
       count(DISTINCT b.exchange) AS n_venues,
       string_agg(DISTINCT b.exchange, ',' ORDER BY b.exchange) AS venues,
       CAST(sum(b.size) AS BIGINT) AS size, sum(b.price*b.size)/sum(b.size) AS price
FROM flips a JOIN flips b ON a.instrument_id=b.instrument_id AND a.run=b.run
 AND b.rn >= a.rn AND b.ts <= a.ts + INTERVAL 24 HOURS
WHERE a.side <> 0 GROUP BY a.instrument_id, a.rn"""
CTES["hops"] = """
SELECT n.instrument_id, n.rn, coalesce(legs >= 2 AND n_venues >= 2, false) AS hit,
       CASE WHEN legs >= 2 AND n_venues >= 2 THEN c.upto + 1 ELSE n.rn + 1 END AS nxt
FROM numbered n LEFT JOIN clusters c USING (instrument_id, rn)"""
CTES["walk"] = """
SELECT instrument_id, rn, hit, nxt FROM hops WHERE rn = 1
UNION ALL
SELECT h.instrument_id, h.rn, h.hit, h.nxt FROM walk w JOIN hops h
ON h.instrument_id = w.instrument_id AND h.rn = w.nxt"""
CTES["sweep_events"] = f"""
SELECT 'SWEEP' AS event_type, n.ts, {', '.join('n.' + c for c in LEG.split(', '))}, n.side, c.size,
       c.price, c.legs, c.venues
FROM walk w JOIN clusters c USING (instrument_id, rn) JOIN numbered n USING (instrument_id, rn)
WHERE w.hit"""
CTES["all_events"] = """
SELECT * FROM sweep_events UNION ALL SELECT * FROM block_events UNION ALL SELECT * FROM unusual"""
CTES["premiums"] = """
SELECT symbol, date_trunc('hour', ts) AS ts,
       coalesce(sum(-side*size*price*100) FILTER (option_type='C'), 0) AS call_premium,
       coalesce(sum(-side*size*price*100) FILTER (option_type='P'), 0) AS put_premium
FROM trades WHERE side <> 0 GROUP BY ALL"""
CTES["hiro"] = """
SELECT symbol, ts, c AS call_premium, p AS put_premium, c+p AS net_premium,
       sum(c+p) OVER (PARTITION BY symbol ORDER BY ts) AS cumulative
FROM (SELECT g.symbol, g.ts, coalesce(call_premium, 0) AS c, coalesce(put_premium, 0) AS p
      FROM (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts
            FROM premiums GROUP BY symbol) g LEFT JOIN premiums USING (symbol, ts))"""

# Futures.
CTES["ticks"] = """
SELECT ts, CASE instrument_id % 3 WHEN 0 THEN 'ESM6' WHEN 1 THEN 'NQM6' ELSE 'ESH7-ESM7' END AS symbol,
       seq, 5800 + value/4 AS price, k AS size,
       CASE seq % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 END AS aggressor FROM ev WHERE event_type='click'"""
CTES["bins"] = """
SELECT left(symbol, 2) AS symbol_root, round_even(price/0.25, 0)*0.25 AS price,
       CAST(sum(size) AS BIGINT) AS total,
       CAST(coalesce(sum(size) FILTER (aggressor > 0), 0) AS BIGINT) AS buy,
       CAST(coalesce(sum(size) FILTER (aggressor < 0), 0) AS BIGINT) AS sell
FROM ticks WHERE size > 0 GROUP BY ALL"""
# The value area grown step by step.
CTES["bin_rows"] = """
SELECT *, row_number() OVER (PARTITION BY symbol_root ORDER BY price) AS n,
       sum(total) OVER (PARTITION BY symbol_root) AS whole FROM bins"""
CTES["grow"] = """
SELECT symbol_root, n AS lo, n AS hi, CAST(total AS DOUBLE) AS acc, CAST(whole AS DOUBLE) AS whole, n AS poc
FROM bin_rows QUALIFY row_number() OVER (PARTITION BY symbol_root ORDER BY total DESC, price) = 1
UNION ALL
SELECT g.symbol_root, CASE WHEN up THEN lo ELSE lo - 1 END, CASE WHEN up THEN hi + 1 ELSE hi END,
       acc + CASE WHEN up THEN above ELSE below END, whole, poc
FROM (SELECT g.*, b.total AS above, a.total AS below, coalesce(b.total, -1) >= coalesce(a.total, -1) AS up
      FROM grow g LEFT JOIN bin_rows a ON a.symbol_root=g.symbol_root AND a.n = g.lo - 1
      LEFT JOIN bin_rows b ON b.symbol_root=g.symbol_root AND b.n = g.hi + 1
      WHERE acc < 0.7*g.whole AND (a.n IS NOT NULL OR b.n IS NOT NULL)) g"""
CTES["area"] = """
SELECT f.symbol_root, p.price AS poc, h.price AS vah, l.price AS val, CAST(f.whole AS BIGINT) AS total_volume
FROM (SELECT * FROM grow QUALIFY row_number() OVER (PARTITION BY symbol_root ORDER BY acc DESC) = 1) f
JOIN bin_rows p ON p.symbol_root=f.symbol_root AND p.n=f.poc
JOIN bin_rows h ON h.symbol_root=f.symbol_root AND h.n=f.hi
JOIN bin_rows l ON l.symbol_root=f.symbol_root AND l.n=f.lo"""
CTES["last_ticks"] = """
SELECT left(symbol, 2) AS symbol_root, arg_max(price, {'t': ts, 's': seq}) AS last_price
FROM ticks GROUP BY ALL"""
CTES["newest_underlying"] = """
SELECT symbol, arg_max(underlying_price, ts) AS underlying_price, max(ts) AS ts FROM chain GROUP BY symbol"""
CTES["bases"] = """
SELECT symbol, underlying_price AS spot, last_price AS futures, last_price - underlying_price AS basis,
       (last_price - underlying_price)/underlying_price AS basis_pct
FROM newest_underlying, last_ticks WHERE symbol_root = 'ES'"""
CTES["moments"] = """
SELECT symbol, ts AS snapshot_ts, CASE symbol WHEN 'SPXW' THEN 'ES' WHEN 'NDXP' THEN 'NQ' END AS root
FROM (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM events),
     (SELECT unnest(['SPXW', 'NDXP', 'RUTW']) AS symbol)"""
CTES["fut_at"] = """
SELECT m.symbol, m.snapshot_ts,
       CASE WHEN t.ts > m.snapshot_ts - INTERVAL 2 HOURS THEN t.price END AS futures_price
FROM moments m ASOF LEFT JOIN (SELECT *, left(symbol, 2) AS root FROM ticks) t
ON m.root = t.root AND m.snapshot_ts >= t.ts WHERE m.root IS NOT NULL"""
CTES["carry_in"] = """
SELECT *, CASE WHEN hour(snapshot_ts) % 2 = 0 THEN futures_price - 3 - day(snapshot_ts) END AS parity_spot
FROM fut_at"""
CTES["carried"] = """
SELECT symbol, snapshot_ts, futures_price, parity_spot, basis,
       coalesce(parity_spot, futures_price - basis) AS resolved_spot
FROM (SELECT c.*, coalesce(k.fut - k.par, 0) AS basis FROM carry_in c ASOF LEFT JOIN
       (SELECT symbol, snapshot_ts, futures_price AS fut, parity_spot AS par FROM carry_in
        WHERE futures_price - parity_spot IS NOT NULL) k
      ON c.symbol = k.symbol AND c.snapshot_ts >= k.snapshot_ts)"""

# Metrics.
NONE = "DATE '1970-01-01'"
CTES["metrics"] = f"""
SELECT symbol, CASE weight WHEN 'oi' THEN 'GEX_NET_TOTAL' ELSE 'GEX_NET_TOTAL_VOL' END AS metric_type,
       0.0::DOUBLE AS strike, {NONE} AS expiration, net_total AS value FROM gex_totals
UNION ALL SELECT symbol, 'GEX_LEVEL', strike, {NONE}, net_gex FROM gex_oi
UNION ALL SELECT symbol, 'GEX_LEVEL_VOL', strike, {NONE}, net_gex FROM gex_volume
UNION ALL SELECT symbol, 'VANNA_NET_TOTAL', 0, {NONE}, sum(vanna_exposure) FROM vanna GROUP BY symbol
UNION ALL SELECT symbol, 'VANNA_LEVEL', strike, {NONE}, vanna_exposure FROM vanna
UNION ALL SELECT symbol, 'CHARM_NET_TOTAL', 0, {NONE}, sum(charm_exposure) FROM charm GROUP BY symbol
UNION ALL SELECT symbol, 'CHARM_LEVEL', strike, {NONE}, charm_exposure FROM charm
UNION ALL SELECT symbol, 'MAX_PAIN', strike, expiration, pain FROM pain_best
UNION ALL SELECT symbol, 'MAX_PAIN_AGG', strike, {NONE}, pain FROM pain_agg
UNION ALL SELECT symbol, CASE option_type WHEN 'C' THEN 'CALL' ELSE 'PUT' END || '_WALL_' ||
  CASE weight WHEN 'oi' THEN 'OI' ELSE 'VOL' END, strike, {NONE}, value FROM wall_ranks
UNION ALL SELECT symbol, 'ATM_IV', 0, {NONE}, atm_iv FROM atm WHERE atm_iv IS NOT NULL
UNION ALL SELECT symbol, 'IV_SKEW', 0, expiration, skew FROM skews
UNION ALL SELECT DISTINCT symbol, 'IV_SURFACE', 0, {NONE}, NULL FROM g WHERE iv IS NOT NULL
UNION ALL SELECT symbol, CASE weight WHEN 'oi' THEN 'REGIME_OI' ELSE 'REGIME_VOL' END, 0, {NONE}, score FROM regimes
UNION ALL SELECT symbol, 'IV_TERM_STRUCTURE', 0, expiration, atm_iv FROM terms
UNION ALL SELECT symbol, 'RISK_REVERSAL_25D', 0, expiration, risk_reversal_25d FROM terms
  WHERE risk_reversal_25d IS NOT NULL
UNION ALL SELECT symbol, 'MOVE_TRACKER', 0, {NONE}, NULL FROM moves
UNION ALL SELECT symbol, 'PIN_PROBABILITY', strike, {NONE}, prob FROM pins"""
CTES["flow_metric_rows"] = f"""
SELECT symbol, 'HIRO' AS metric_type, arg_max(cumulative, ts) AS value FROM hiro GROUP BY symbol
UNION ALL SELECT symbol, 'BASIS_SPX_ES', basis FROM bases
UNION ALL SELECT symbol_root, 'VOLUME_PROFILE_ES', poc FROM area WHERE symbol_root = 'ES'"""
CTES["breakdown"] = "SELECT metric_type, count(*) AS rows FROM metrics GROUP BY metric_type"

# Quality.
NOW = "TIMESTAMP '2002-01-01 00:00:00'"
CTES["freshness"] = f"""
SELECT *, CASE WHEN lag_seconds < 120 THEN 'ok' WHEN lag_seconds < 600 THEN 'warn' ELSE 'stale' END AS lag_band
FROM (SELECT name, rows, latest_ts, greatest(0, epoch({NOW}) - epoch(latest_ts)) AS lag_seconds FROM
 (SELECT 'options_chain' AS name, count(*) AS rows, max(ts) AS latest_ts FROM chain
  UNION ALL SELECT 'options_trades', count(*), max(ts) FROM trades
  UNION ALL SELECT 'futures_ticks', count(*), max(ts) FROM ticks
  UNION ALL SELECT 'eod_open_interest', (SELECT count(*) FROM eod),
    (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem WHERE l_returnflag='A')
  UNION ALL SELECT 'computed_metrics', count(*), CASE WHEN count(*) > 0 THEN {NOW} END FROM metrics
  UNION ALL SELECT 'flow_events', count(*), max(ts) FROM all_events
  UNION ALL SELECT 'liquidity_snapshots', count(*), max(ts) FROM raw_books
  UNION ALL SELECT 'alert_events', count(*), max(snapshot_ts) FROM fired))"""


def quality(now: str, window: str) -> str:
    fields = ("bid", "ask", "last_price", "iv", "oi", "volume", "underlying_price")
    pct = ", ".join(f"round(100.0*count({f})/count(*), 1) AS {f}" for f in fields)
    pct += ", round(100.0*count(iv)/count(*), 1) AS gamma, round(100.0*count(iv)/count(*), 1) AS delta"
    return f"""
SELECT symbol, count(*) AS rows_last_hour, max(ts) AS latest_ts, {pct}
FROM (SELECT *, count(*) FILTER (ts > {now} - INTERVAL {window}) OVER (PARTITION BY symbol) AS recent FROM chain)
WHERE recent = 0 OR ts > {now} - INTERVAL {window} GROUP BY symbol"""


CTES["quality_all"] = quality(NOW, "1 HOUR")
CTES["quality_recent"] = quality("TIMESTAMP '2001-06-01 00:00:00'", "900 DAYS")

# Alerts over the history metrics.
CTES["payload"] = """
SELECT symbol, snapshot_ts, atm_iv, lag(atm_iv) OVER (PARTITION BY symbol ORDER BY snapshot_ts) AS before,
       net_total
FROM (SELECT symbol, snapshot_ts, a.atm_iv, h.net_total*100*0.01 AS net_total
      FROM hist_gex h LEFT JOIN hist_atm a USING (symbol, snapshot_ts))"""
CTES["fired"] = """
SELECT 'rule-1' AS rule_id, symbol, snapshot_ts, 'ATM_IV.value gt 0.15' AS matched FROM payload
WHERE symbol='SPXW' AND atm_iv > 0.15
UNION ALL SELECT 'rule-2', symbol, snapshot_ts, 'GEX_NET_TOTAL.value ne 0;ATM_IV.value lt 5' FROM payload
WHERE symbol='NDXP' AND net_total <> 0 AND atm_iv < 5
UNION ALL SELECT 'rule-4', symbol, snapshot_ts, 'ATM_IV.value cross_above 0.17' FROM payload
WHERE symbol='SPXW' AND before <= 0.17 AND atm_iv > 0.17
UNION ALL SELECT 'rule-5', symbol, snapshot_ts, 'ATM_IV.value cross_below 0.17' FROM payload
WHERE symbol='SPXW' AND before >= 0.17 AND atm_iv < 0.17
UNION ALL SELECT 'rule-3', symbol, snapshot_ts, 'MAX_PAIN_AGG.value ge 0' FROM payload
WHERE symbol='RUTW'"""

# Sources and sinks.
CTES["merged"] = f"""
SELECT {LEG}, max(ts) AS ts, arg_max(oi, z) FILTER (oi IS NOT NULL) AS oi,
       arg_max(iv, z) FILTER (iv IS NOT NULL) AS iv, arg_max(bid, z) FILTER (bid IS NOT NULL) AS bid,
       arg_max(volume, z) AS volume
FROM (SELECT *, ts AS z FROM chain)
GROUP BY {LEG}"""

RECURSIVE = {"bisect", "walk", "grow"}


def _needed(name: str, seen: list[str]) -> None:
    if name in seen:
        return
    for other in CTES:
        if other != name and re.search(rf"\b(FROM|JOIN|,)\s+{other}\b", CTES[name]):
            _needed(other, seen)
    seen.append(name)


def select(columns: str, source: str, where: str = "", tail: str = "", needs: str = "") -> str:
    """SQL for ``name[:kind]`` columns: d date, t timestamp, n nullable number, digits to round."""
    out = []
    for spec in columns.split():
        name, _, kind = spec.partition(":")
        if kind == "d":
            out.append(f"strftime({name}, '%Y-%m-%d') AS {name}")
        elif kind == "t":
            out.append(f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f') AS {name}")
        elif kind == "n":
            out.append(f"CAST({name} AS DOUBLE) AS {name}")
        elif kind:
            out.append(f"round(CAST({name} AS DOUBLE), {kind}) + 0.0 AS {name}")
        else:
            out.append(name)
    names: list[str] = []
    _needed(needs or source, names)
    word = "WITH RECURSIVE" if RECURSIVE & set(names) else "WITH"
    parts = ", ".join(f"{n} AS ({CTES[n]})" for n in names)
    cond = f" WHERE {where}" if where else ""
    return f"{word} {parts} SELECT {', '.join(out)} FROM {source}{cond} {tail}"


CTES["resolved"] = f"""
SELECT symbol, expiration, strike, option_type,
       CASE WHEN symbol = 'RUTW' THEN parity_spot ELSE underlying_price END AS underlying_price
FROM snap LEFT JOIN parity USING (symbol)"""
CTES["health"] = """
SELECT symbol, count(*) AS rows, count(bid) AS have_bid, count(iv) AS have_iv, count(gamma) AS have_gamma,
       count(underlying_price) = 0 AS no_underlying,
       count(underlying_price) > 0 AND (count(iv) = 0 OR count(gamma) = 0) AS low_greek_coverage
FROM g GROUP BY symbol"""
CTES["whole_health"] = """
SELECT sum(rows)::BIGINT AS rows, sum(have_bid)::BIGINT AS have_bid, sum(have_iv)::BIGINT AS have_iv, sum(have_gamma)::BIGINT AS have_gamma FROM health"""
CTES["priced"] = f"""
SELECT *, underlying_price*{PDF.format('dd')}*sqrt(tau) AS bs_vega,
       underlying_price*{ncdf('dd')} - strike*exp(-{R}*tau)*{ncdf('(dd - iv*sqrt(tau))')}
       - CASE WHEN {CALL} THEN 0 ELSE underlying_price - strike*exp(-{R}*tau) END AS bs_price
FROM greeks WHERE iv IS NOT NULL
UNION ALL BY NAME
SELECT *, NULL AS bs_vega, greatest(0.0, CASE WHEN {CALL} THEN underlying_price - strike
                           ELSE strike - underlying_price END) AS bs_price
FROM greeks WHERE iv IS NULL"""
CTES["looked_up"] = "SELECT * FROM records JOIN registry USING (instrument_id)"
CTES["misses"] = """
SELECT kind, count(*) AS unmatched FROM records
WHERE instrument_id NOT IN (SELECT instrument_id FROM registry) GROUP BY kind"""
CTES["rooted"] = "SELECT *, left(symbol, 2) AS symbol_root, aggressor AS side FROM ticks"
INSPECTED = (
    "'GEX_NET_TOTAL_VOL','GEX_NET_TOTAL','VANNA_NET_TOTAL','CHARM_NET_TOTAL','MAX_PAIN','ATM_IV',"
    "'MOVE_TRACKER','REGIME_VOL','REGIME_OI','HIRO','BASIS_SPX_ES','VOLUME_PROFILE_ES'"
)
CTES["latest_metric_rows"] = f"""
SELECT * FROM metrics WHERE metric_type IN ({INSPECTED})
QUALIFY row_number() OVER (PARTITION BY symbol, metric_type ORDER BY expiration, strike) = 1"""
CTES["hist_rows"] = f"""
SELECT snapshot_ts AS ts, symbol, 'GEX_NET_TOTAL' AS metric_type, 0.0::DOUBLE AS strike,
       {NONE} AS expiration, net_total AS value FROM hist_gex
UNION ALL SELECT snapshot_ts, symbol, 'ATM_IV', 0, {NONE}, atm_iv FROM hist_atm WHERE atm_iv IS NOT NULL
UNION ALL SELECT snapshot_ts, symbol, 'MAX_PAIN', strike, expiration, pain FROM hist_pain"""
CTES["hist_latest"] = """
SELECT * FROM hist_rows QUALIFY rank() OVER (PARTITION BY symbol, metric_type ORDER BY ts DESC) = 1"""
CTES["served_gex"] = """
SELECT t.symbol, t.net_total, t.underlying_price, z.zero_gamma
FROM gex_totals t LEFT JOIN zero_volume z USING (symbol) WHERE weight = 'volume'"""
CTES["nearest_pain"] = """
SELECT * FROM pain_best QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY expiration) = 1"""
CTES["served_walls"] = """
SELECT symbol, CASE option_type WHEN 'C' THEN 'CALL_WALL_OI' ELSE 'PUT_WALL_OI' END AS metric_type,
       rank, strike, value FROM wall_ranks WHERE weight = 'oi'"""
CTES["served_iv"] = """
SELECT symbol, atm_iv, CAST(expiration AS VARCHAR) AS expiration, skew FROM atm JOIN skews USING (symbol)"""
CTES["dashboard"] = """
SELECT symbol, t.net_total, v.net_total AS net_total_volume, zo.zero_gamma AS zero_oi,
       zv.zero_gamma AS zero_volume, t.underlying_price,
       (SELECT count(*) FROM pain_best p WHERE p.symbol = t.symbol) AS expiries,
       (SELECT count(*) FROM wall_ranks w WHERE w.symbol = t.symbol) AS walls,
       a.strike AS pain_strike, atm.atm_iv, ro.score AS regime_oi, rv.score AS regime_vol, ro.label AS label_oi
FROM (SELECT * FROM gex_totals WHERE weight='oi') t
JOIN (SELECT * FROM gex_totals WHERE weight='volume') v USING (symbol)
LEFT JOIN zero_oi zo USING (symbol) LEFT JOIN zero_volume zv USING (symbol)
LEFT JOIN pain_agg a USING (symbol) LEFT JOIN atm USING (symbol)
LEFT JOIN (SELECT * FROM regimes WHERE weight='oi') ro USING (symbol)
LEFT JOIN (SELECT * FROM regimes WHERE weight='volume') rv USING (symbol)"""
CTES["best_pins"] = """
SELECT *, prob AS probability FROM pins ORDER BY prob DESC, symbol, strike LIMIT 15"""
CTES["served_tops"] = "SELECT symbol, side, rank, strike, net_gex AS value FROM gex_tops"
CTES["served_surface"] = """
SELECT symbol, strftime(expiration, '%Y-%m-%d') AS expiration, strike, option_type, iv, delta FROM g WHERE iv IS NOT NULL"""
CTES["dashboard_lists"] = """
SELECT symbol, 'max_pain' AS part, strftime(expiration, '%Y-%m-%d') AS name, strike, pain AS value FROM pain_best
UNION ALL SELECT symbol, 'walls', CASE option_type WHEN 'C' THEN 'CALL' ELSE 'PUT' END || '_WALL_' ||
  CASE weight WHEN 'oi' THEN 'OI' ELSE 'VOL' END || ' ' || rank, strike, value FROM wall_ranks
UNION ALL SELECT symbol, 'skew', strftime(expiration, '%Y-%m-%d'), 0.0, skew FROM skews"""
CTES["flow_lists"] = """
SELECT symbol, 'HIRO' AS metric_type, ts AS place, NULL::DOUBLE AS price, call_premium AS first, put_premium AS second, cumulative AS total FROM hiro
UNION ALL SELECT symbol_root, 'VOLUME_PROFILE_ES', NULL, price, buy, sell, total FROM bins WHERE symbol_root = 'ES'
UNION ALL SELECT symbol, 'BASIS_SPX_ES', NULL, NULL, spot, futures, basis FROM bases"""
CTES["last_bases"] = """
SELECT symbol, max(snapshot_ts) AS snapshot_ts, arg_max(futures_price - parity_spot, snapshot_ts) AS basis
FROM carry_in WHERE futures_price - parity_spot IS NOT NULL GROUP BY symbol"""
CTES["live_bases"] = """
SELECT symbol, 5000.0 - coalesce(basis, 0) AS underlying_price FROM (SELECT DISTINCT symbol FROM snap) LEFT JOIN last_bases USING (symbol)"""
CTES["parsed"] = """
SELECT event_id, CASE WHEN event_id % 6 IN (0, 4, 5) THEN value END AS shown FROM events"""
CTES["fired_payloads"] = """
SELECT rule_id, symbol, snapshot_ts, atm_iv, net_total, false AS has_curve FROM fired JOIN payload USING (symbol, snapshot_ts)"""
CTES["inspected"] = f"""
SELECT 'table lag' AS section, name, lag_seconds::DOUBLE AS value FROM freshness
UNION ALL SELECT 'metric rows', metric_type, rows FROM breakdown
UNION ALL SELECT 'rules', 'total', 7 UNION ALL SELECT 'rules', 'enabled', 6
UNION ALL (SELECT 'recent alert', rule_id || ' ' || symbol || ' ' || strftime(snapshot_ts, '%Y-%m-%d %H:%M:%S'), NULL
  FROM fired ORDER BY snapshot_ts DESC, rule_id LIMIT 20)
UNION ALL SELECT 'pin', symbol || ' ' || strike::INTEGER, probability FROM best_pins
UNION ALL SELECT field || ' pct', symbol, value FROM (UNPIVOT (SELECT symbol, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("bid", "ask", "last_price", "iv", "delta", "gamma", "oi", "volume", "underlying_price"))}
  FROM quality_all) ON COLUMNS(* EXCLUDE symbol) INTO NAME field VALUE value)"""
_EXTRA = "SELECT symbol, {kind} AS metric_type, {expiration} AS expiration, {strike} AS strike, {field} AS field, {value} AS value FROM {source}"


def _extras() -> str:
    """The numbers beside the value, a row each."""
    parts = []

    def add(kind, source, fields, expiration=NONE, strike="0.0"):
        for field, value in fields.items():
            parts.append(_EXTRA.format(kind=kind, source=source, expiration=expiration, strike=strike, field=f"'{field}'", value=f"CAST({value} AS DOUBLE)"))

    same = lambda *names: {n: n for n in names}
    add("CASE option_type WHEN 'C' THEN 'CALL' ELSE 'PUT' END || '_WALL_' || CASE weight WHEN 'oi' THEN 'OI' ELSE 'VOL' END", "wall_ranks", same("rank"), strike="strike")
    add("'REGIME_' || CASE weight WHEN 'oi' THEN 'OI' ELSE 'VOL' END", "regimes", same("call_wall_total", "put_wall_total", "net_gex"))
    add("'MAX_PAIN_AGG'", "pain_agg", {"window_expiries": "5"}, strike="strike")
    add("'IV_TERM_STRUCTURE'", "terms", same("days_to_expiry", "atm_iv", "call_25d_iv", "put_25d_iv", "risk_reversal_25d"), expiration="expiration")
    add("'RISK_REVERSAL_25D'", "(SELECT * FROM terms WHERE risk_reversal_25d IS NOT NULL)", same("call_25d_iv", "put_25d_iv"), expiration="expiration")
    add("'MOVE_TRACKER'", "moves", same("underlying_price", "implied_move", "implied_dte"))
    for tail, table, zero in (("", "gex_oi", "zero_oi"), ("_VOL", "gex_volume", "zero_volume")):
        levels = same("strike", "call_gex", "put_gex", "net_gex")
        add(f"'GEX_LEVEL{tail}'", f"(SELECT * FROM {table} WHERE net_gex IS NOT NULL)", levels, strike="strike")
        weight = "volume" if tail else "oi"
        totals = f"(SELECT t.symbol, t.underlying_price, z.zero_gamma FROM gex_totals t LEFT JOIN {zero} z USING (symbol) WHERE weight = '{weight}')"
        add(f"'GEX_NET_TOTAL{tail}'", totals, same("underlying_price", "zero_gamma"))
    for name in ("vanna", "charm"):
        add(f"'{name.upper()}_LEVEL'", f"(SELECT * FROM {name} WHERE {name}_exposure IS NOT NULL)", same("strike", f"{name}_exposure"), strike="strike")
        add(f"'{name.upper()}_NET_TOTAL'", f"(SELECT DISTINCT symbol, underlying_price FROM {name})", same("underlying_price"))
    add("'PIN_PROBABILITY'", "pins", same("strike", "prob", "oi", "abs_charm", "atm_iv"), strike="strike")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL"


CTES["extras"] = _extras()
CTES["status"] = """
SELECT symbol, c.n AS chain_rows, m.n AS metric_rows
FROM (SELECT symbol, count(*) AS n FROM chain GROUP BY symbol) c
FULL JOIN (SELECT symbol, count(*) AS n FROM metrics GROUP BY symbol) m USING (symbol)"""
BAND = "CASE WHEN {0} >= 95 THEN 'ok' WHEN {0} >= 50 THEN 'warn' ELSE 'bad' END AS {0}_band"
CTES["quality_banded"] = f"""
SELECT *, {BAND.format('iv')}, {BAND.format('oi')} FROM quality_recent"""
CTES["alarms"] = "SELECT bool_or(gamma = 0 OR underlying_price = 0) AS alarm FROM quality_all"
CTES["fired_listed"] = "SELECT * FROM fired"
CTES["fire_rows"] = """
SELECT rule_id, symbol, snapshot_ts,
       row_number() OVER (PARTITION BY rule_id ORDER BY snapshot_ts) AS n FROM fired"""
CTES["cool_walk"] = """
SELECT rule_id, symbol, snapshot_ts, snapshot_ts AS kept_at, n FROM fire_rows WHERE n = 1
UNION ALL
SELECT f.rule_id, f.symbol, f.snapshot_ts,
       CASE WHEN f.snapshot_ts >= w.kept_at + INTERVAL 200 DAYS THEN f.snapshot_ts ELSE w.kept_at END, f.n
FROM cool_walk w JOIN fire_rows f ON f.rule_id = w.rule_id AND f.n = w.n + 1"""
CTES["cooled"] = "SELECT * FROM cool_walk WHERE kept_at = snapshot_ts"
RECURSIVE.add("cool_walk")


CTES["raw_prints"] = """
SELECT instrument_id, ts, seq + 1 AS seq, value AS price, k AS size, CAST(seq % 5 AS VARCHAR) AS exchange
FROM ev WHERE event_type = 'purchase'"""
CTES["raw_quotes"] = """
SELECT instrument_id, ts, seq + 1 AS seq, round((value + 1.0)*100)/100 AS bid,
       round((value + 0.05)*100)/100 AS ask FROM ev WHERE event_type = 'view'"""
CTES["raw_statistics"] = """
SELECT instrument_id, ts, seq + 1 AS seq,
       CASE event_type WHEN 'signup' THEN 'cumulative_volume' ELSE 'open_interest' END AS kind,
       k*10 AS quantity FROM ev WHERE event_type IN ('signup', 'error')"""
CTES["registry"] = """
SELECT instrument_id, CASE instrument_id % 3 WHEN 0 THEN 'SPXW' ELSE 'NDXP' END AS symbol,
       DATE '2024-02-02' AS expiration, CAST(900 + 5*(seq % 21) AS DOUBLE) AS strike,
       CASE WHEN seq % 4 = 0 THEN 'C' ELSE 'P' END AS option_type
FROM ev WHERE instrument_id % 3 <> 2 AND seq % 4 <> 3
QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) = 1"""
CTES["versions"] = """
SELECT instrument_id, ts AS defined_at, CASE instrument_id % 3 WHEN 0 THEN 'SPXW' ELSE 'NDXP' END AS symbol,
       DATE '2024-02-02' AS expiration, CAST(900 + 5*(seq % 21) AS DOUBLE) AS strike,
       CASE WHEN seq % 4 = 0 THEN 'C' ELSE 'P' END AS option_type
FROM ev WHERE instrument_id % 3 <> 2 AND seq % 4 <> 3"""
CTES["defined_then"] = """
SELECT r.instrument_id, r.ts, r.seq, r.kind, v.symbol, v.expiration, v.strike, v.option_type
FROM records r ASOF JOIN versions v ON r.instrument_id = v.instrument_id AND r.ts >= v.defined_at"""
CTES["futures_then"] = """
SELECT r.instrument_id, r.ts, r.seq, v.symbol, v.expiration, v.parent
FROM records r ASOF JOIN (
  SELECT instrument_id, ts AS defined_at, root || 'M6' AS symbol, DATE '2024-02-02' AS expiration, root || 'M' AS parent
  FROM (SELECT instrument_id, ts, CASE instrument_id % 3 WHEN 0 THEN 'SPXW' WHEN 1 THEN 'NDXP' ELSE 'ES' END AS root FROM ev)) v
ON r.instrument_id = v.instrument_id AND r.ts >= v.defined_at"""
CTES["futures_names"] = """
SELECT DISTINCT instrument_id, root || 'M6' AS symbol, DATE '2024-02-02' AS expiration, root || 'M' AS parent
FROM (SELECT instrument_id, CASE instrument_id % 3 WHEN 0 THEN 'SPXW' WHEN 1 THEN 'NDXP' ELSE 'ES' END AS root
      FROM ev)"""
CTES["raw_books"] = """
SELECT instrument_id, ts, seq + 1 AS seq, round((value + 1.0)*100)/100 AS bid,
       round((value + 0.05)*100)/100 AS ask, 3 AS depth_levels,
       CASE WHEN seq % 2 = 0 THEN 3 ELSE 2 END AS n_asks, 3*k + 3 AS bid_size, 2 AS top_orders
FROM ev WHERE event_type = 'view'"""
CTES["raw_futures"] = """
SELECT n.symbol, c.ts, c.seq + 1 AS seq, c.value AS price, c.k AS size,
       CASE c.seq % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 END AS aggressor, q.bid, q.ask,
       CAST(c.seq % 5 AS VARCHAR) AS venue
FROM (SELECT * FROM ev WHERE event_type = 'click') c JOIN futures_names n USING (instrument_id)
ASOF LEFT JOIN raw_quotes q ON c.instrument_id = q.instrument_id AND c.ts >= q.ts"""
CTES["listing"] = f"""
SELECT {SYMBOL.format('l_suppkey')} AS symbol,
       {AS_OF} + CAST(7*(l_linenumber-1) AS INTEGER) AS expiration,
       CAST(900 + 5*(l_partkey % 21) AS DOUBLE) AS strike,
       CASE l_returnflag WHEN 'A' THEN 'C' WHEN 'N' THEN 'P' END AS option_type,
       l_linestatus, CAST(l_quantity - 5 AS BIGINT) AS open_interest, l_shipdate
FROM lineitem"""
CTES["stubs"] = """
SELECT TIMESTAMP '2002-01-01' AS ts, *, NULL AS oi, NULL AS iv FROM listing WHERE option_type IS NOT NULL"""
CTES["eod_loaded"] = f"""
SELECT *, DATE '2002-01-01' AS oi_date FROM listing
WHERE l_linestatus = 'F' AND open_interest >= 0 AND option_type IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY {LEG} ORDER BY l_shipdate DESC, open_interest DESC) = 1"""
CTES["eod_upserted"] = f"""
SELECT {LEG}, coalesce(n.open_interest, e.open_interest) AS open_interest
FROM eod e FULL JOIN eod_loaded n USING ({LEG})"""
CTES["young"] = "SELECT * FROM chain WHERE ts >= TIMESTAMP '2000-06-01' - INTERVAL 7 DAYS"
CTES["hour_books"] = f"""
SELECT {SYMBOL.format('instrument_id')} AS symbol, date_trunc('hour', ts) AS sampled_at, max(ts) AS ts,
       3 AS depth_levels FROM ev WHERE event_type = 'view' GROUP BY ALL"""
CTES["filed"] = """
SELECT CASE WHEN (seq + 1) % 50 IN (7, 9) THEN 'set aside' ELSE 'sound' END AS status, count(*) AS rows,
       sum(CASE WHEN (seq + 1) % 50 NOT IN (7, 9) THEN k END) AS size
FROM ev WHERE event_type = 'purchase' GROUP BY ALL"""
CTES["streamed_alerts"] = """
SELECT f.*, c.rule_id IS NOT NULL AS kept FROM fired f LEFT JOIN cooled c USING (rule_id, symbol, snapshot_ts)"""


# Records of three kinds to chain rows.
CTES["raw_all"] = """
SELECT instrument_id, ts, seq, 'trade' AS kind, price, size FROM raw_prints
UNION ALL BY NAME SELECT instrument_id, ts, seq, 'quote' AS kind, bid, ask FROM raw_quotes
UNION ALL BY NAME SELECT instrument_id, ts, seq, kind, quantity FROM raw_statistics"""
CTES["raw_running"] = """
SELECT *, coalesce(sum(size) FILTER (kind = 'trade') OVER w, 0) AS traded,
       count(size) FILTER (kind = 'trade') OVER w AS sized
FROM raw_all WINDOW w AS (PARTITION BY instrument_id ORDER BY ts, seq)"""
CTES["ingested"] = """
SELECT instrument_id, ts, seq, kind, last_value(bid IGNORE NULLS) OVER w AS bid, last_value(ask IGNORE NULLS) OVER w AS ask,
       last_value(CASE WHEN kind = 'trade' THEN price END IGNORE NULLS) OVER w AS last_price,
       last_value(CASE WHEN kind = 'open_interest' THEN quantity END IGNORE NULLS) OVER w AS oi,
       CASE WHEN sized > 0 OR last_value(CASE WHEN kind = 'cumulative_volume' THEN quantity END IGNORE NULLS) OVER w IS NOT NULL
            THEN traded + coalesce(last_value(CASE WHEN kind = 'cumulative_volume' THEN quantity - traded END IGNORE NULLS) OVER w, 0)
       END AS volume
FROM raw_running WINDOW w AS (PARTITION BY instrument_id ORDER BY ts, seq)"""

# Stored tables.
CTES["scanned_chain"] = """
SELECT * FROM chain WHERE ts >= TIMESTAMP '1996-03-01' AND ts <= TIMESTAMP '1996-03-20 12:00:00' AND symbol IN ('SPXW', 'RUTW')"""
CTES["scanned_trades"] = """
SELECT * FROM trades WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 12:00:00' AND symbol = 'NDXP'"""
CTES["outrights"] = """
SELECT * FROM rooted WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND symbol NOT LIKE '%-%'"""
CTES["left_days"] = """
SELECT CAST(ts AS DATE) AS day, count(*) AS rows FROM trades
WHERE CAST(ts AS DATE) >= DATE '2024-01-25' - INTERVAL 14 DAYS GROUP BY ALL"""
#: The chain with months as times, written in two batches: many rows share a stored key.
_NEWEST = ", ".join(
    f"arg_max({c}, place) FILTER ({c} IS NOT NULL) AS {c}" for c in ("oi", "volume", "iv", "bid", "last_price")
)
CTES["sunk"] = f"""
SELECT month AS ts, {LEG}, {_NEWEST}
FROM (SELECT *, date_trunc('month', ts) AS month, (volume % 2)*10000000000000000 + epoch_us(ts) AS place FROM chain)
GROUP BY month, {LEG}"""
_PRINT_ID = (
    "sha256(concat_ws('|', 'BLOCK', symbol, CAST(expiration AS VARCHAR), CAST(strike AS VARCHAR), option_type, "
    "epoch_us(hour), seq, exchange, CAST(round(price*1000000) AS BIGINT), side, size))"
)
CTES["stored_events"] = f"""
SELECT {_PRINT_ID} AS event_id, hour AS ts, {LEG}, side, size, price
FROM (SELECT *, date_trunc('hour', ts) AS hour FROM trades) WHERE size >= 90"""
CTES["streamed_tape"] = "SELECT * FROM sided"
CTES["slid"] = f"""
SELECT {LEG}, w AS window_end, CAST(sum(size) AS BIGINT) AS size, count(*) AS legs
FROM (SELECT *, unnest([date_trunc('day', ts) + INTERVAL 1 DAY, date_trunc('day', ts) + INTERVAL 2 DAYS]) AS w FROM trades)
GROUP BY ALL HAVING sum(size) >= 300"""


def with_solved_vol(name: str) -> str:
    """A copy of a piece, and of all below it down to the filled snapshot, on solved vols."""
    needed: list[str] = []
    _needed(name, needed)
    above: list[str] = []
    for piece in needed:  # in the order of their use
        text = CTES[piece]
        if piece == "filled" or any(re.search(rf"\b{p}\b", text) for p in above):
            above.append(piece)
    for piece in above:
        if piece == "filled":
            CTES["filled_f7"] = f"SELECT f.* REPLACE (s.iv AS iv) FROM filled f JOIN solved s USING ({LEG})"
            continue
        text = CTES[piece]
        for other in sorted(above, key=len, reverse=True):
            text = re.sub(rf"\b{other}\b(?!_f7)", f"{other}_f7", text)
        CTES[f"{piece}_f7"] = text
    return f"{name}_f7"


PIPELINE_METRICS = with_solved_vol("metrics")
