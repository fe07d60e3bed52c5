"""DuckDB oracle SQL for every registered query.

Deliberately a different formulation from the Spark jobs: the dense
entity x bucket spine is materialised with ``generate_series``; the EWMA folds
are recursive CTEs over ``row_number`` steps; as-of tiers are range joins over
slot states with direct AVG.  Tables are the pre-registered views
(events, lineitem, orders, part, ...).  Output column names and types match
``outcry.plans.queries``.
"""

from __future__ import annotations

from outcry import bindings as B
from outcry import constants as K
from outcry.plans import queries as Q


def _case(col: str, mapping: dict, default) -> str:
    whens = " ".join(f"WHEN {col} = {_lit(k)} THEN {_lit(v)}" for k, v in mapping.items())
    return f"CASE {whens} ELSE {_lit(default)} END"


def _lit(v) -> str:
    return f"'{v}'" if isinstance(v, str) else str(v)


def initcap(expr: str) -> str:
    return (f"array_to_string(list_transform(string_split(lower({expr}), ' '), "
            f"lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")


def iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%SZ')"


def r1(expr: str, decimals: int) -> str:
    s = float(10 ** decimals)
    return f"(floor(({expr}) * {s}::DOUBLE + 0.5::DOUBLE) / {s}::DOUBLE)"


def d(v: float) -> str:
    return f"{float(v)!r}::DOUBLE"


# ------------------------------------------------------------------ bindings
def _sig(kind: str) -> str:
    if kind in ("ev", "born"):
        return ("SELECT event_id AS signal_id, event_type AS entity_id, "
                "CAST(user_id AS VARCHAR) AS actor_key, ts FROM events")
    if kind == "ontime":  # without the events that the capped streams get late
        return (f"{_sig('ev')} WHERE NOT (event_id % {Q.LATE_EVERY} = 0 AND ts < "
                f"(SELECT date_trunc('second', min(ts)) + INTERVAL {Q.LATE_DAYS} DAY FROM events))")
    if kind == "evk":
        return ("SELECT event_id AS signal_id, json_extract_string(props, '$.k') AS entity_id, "
                "CAST(user_id AS VARCHAR) AS actor_key, ts FROM events")
    return ("SELECT l.l_orderkey * 16 + l.l_linenumber AS signal_id, p.p_brand AS entity_id, "
            "CAST(o.o_custkey AS VARCHAR) AS actor_key, l.l_shipdate AS ts "
            "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
            "JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_returnflag = 'R'")


def _cat(kind: str) -> str:
    kind = "ev" if kind in ("ontime", "born") else kind
    ents = f"SELECT DISTINCT entity_id FROM ({_sig(kind)}) WHERE entity_id IS NOT NULL"
    if kind == "ev":
        return (f"SELECT entity_id, {initcap('entity_id')} AS display_name, "
                f"{_case('entity_id', B.EV_PROVIDER, 'other')} AS provider, "
                f"CAST({_case('entity_id', B.EV_SORT_ORDER, 90)} AS INTEGER) AS sort_order FROM ({ents})")
    if kind == "evk":
        return ("SELECT entity_id, 'Key ' || entity_id AS display_name, "
                "CASE WHEN CAST(entity_id AS INTEGER) % 2 = 0 THEN 'even' ELSE 'odd' END AS provider, "
                f"CAST(trunc(CAST(entity_id AS INTEGER) / 10) AS INTEGER) AS sort_order FROM ({ents})")
    num = "CAST(regexp_extract(entity_id, '(\\d+)$', 1) AS INTEGER)"
    return (f"SELECT entity_id, entity_id AS display_name, "
            f"'group' || CAST(CAST(trunc({num} / 10) AS INTEGER) AS VARCHAR) AS provider, "
            f"{num} AS sort_order FROM ({ents})")


def _born_hours() -> str:
    return _case("c.entity_id", B.EV_BORN_AFTER, 0)


def base_ctes(kind: str = "ev", cap: int = K.RATE_CAP) -> str:
    """sig, cat, counts (entity_id, hour, n, dow, hod), bounds (lo, hi)."""
    unit = "day" if kind == "ret" else "hour"
    hod_expr = "CAST(hour(hour) AS INTEGER)"
    return f"""
sig AS ({_sig(kind)}),
cat AS ({_cat(kind)}),
adm AS (SELECT s.*, date_trunc('{unit}', s.ts) AS hour FROM sig s
        WHERE s.entity_id IN (SELECT entity_id FROM cat)),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY actor_key, hour
                                                      ORDER BY ts, signal_id) AS rl_rank FROM adm)
           WHERE rl_rank <= {cap}),
dd AS (SELECT actor_key, entity_id, hour, min(signal_id) AS signal_id, max(ts) AS created_at
       FROM capped GROUP BY actor_key, entity_id, hour),
seen AS (SELECT entity_id, hour, count(*) AS n, CAST(dayofweek(hour) AS INTEGER) AS dow,
                {hod_expr} AS hod FROM dd GROUP BY entity_id, hour),
bounds AS (SELECT min(hour) AS lo, max(hour) AS hi FROM seen),
birth AS (SELECT c.entity_id, b.lo + to_hours({_born_hours() if kind == 'born' else '0'}) AS since FROM cat c CROSS JOIN bounds b),
counts AS (SELECT s.* FROM seen s JOIN birth f ON f.entity_id = s.entity_id AND s.hour >= f.since)"""


def spine_ctes(kind: str = "ev", hi_expr: str = "b.hi") -> str:
    """spine (entity_id, hour, x, dow, hod, total) over [lo, hi_expr]."""
    step = "INTERVAL 1 DAY" if kind == "ret" else "INTERVAL 1 HOUR"
    return f""",
grid AS (SELECT c.entity_id, unnest(generate_series(c.since, {hi_expr}, {step})) AS hour
         FROM birth c CROSS JOIN bounds b),
tot AS (SELECT hour, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY hour),
spine AS (SELECT g.entity_id, g.hour, coalesce(k.n, 0) AS x,
                 CAST(dayofweek(g.hour) AS INTEGER) AS dow, CAST(hour(g.hour) AS INTEGER) AS hod,
                 coalesce(t.total, 0) AS total
          FROM grid g LEFT JOIN counts k ON k.entity_id = g.entity_id AND k.hour = g.hour
          LEFT JOIN tot t ON t.hour = g.hour)"""


def _alpha(n: str) -> str:
    return f"greatest({d(K.ALPHA_FLOOR)}, {d(K.ALPHA_SCALE)} / sqrt(greatest(CAST({n} AS DOUBLE), 1.0::DOUBLE)))"


def fold_ctes() -> str:
    """fold: slot EWMA state after each spine row (recursive CTE)."""
    a = _alpha("f.n")
    x = "CAST(s.x AS DOUBLE)"
    return f""",
sp AS (SELECT *, row_number() OVER (PARTITION BY entity_id, dow, hod ORDER BY hour) AS k FROM spine),
fold AS (
  SELECT entity_id, dow, hod, k, hour, x, CAST(NULL AS DOUBLE) AS prev_mean,
         CAST(NULL AS DOUBLE) AS prev_std, CAST(0 AS BIGINT) AS prev_n,
         CAST(x AS DOUBLE) AS mean, {d(K.INITIAL_STD)} AS std, CAST(1 AS BIGINT) AS n
  FROM sp WHERE k = 1
  UNION ALL
  SELECT s.entity_id, s.dow, s.hod, s.k, s.hour, s.x, f.mean, f.std, f.n,
         {a} * {x} + (1.0::DOUBLE - {a}) * f.mean,
         sqrt(greatest((1.0::DOUBLE - {a}) * (f.std * f.std + {a} * ({x} - f.mean) * ({x} - f.mean)),
                       {d(K.VARIANCE_FLOOR)})),
         f.n + 1
  FROM fold f JOIN sp s ON s.entity_id = f.entity_id AND s.dow = f.dow AND s.hod = f.hod
                        AND s.k = f.k + 1)"""


def share_ctes() -> str:
    """sfold: share EWMA state after each spine row of an entity (recursive CTE)."""
    a = d(K.SHARE_ALPHA)
    cur = "(CAST(s.x AS DOUBLE) / CAST(s.total AS DOUBLE))"
    return f""",
ss AS (SELECT entity_id, hour, x, total, row_number() OVER (PARTITION BY entity_id ORDER BY hour) AS k
       FROM spine),
sfold AS (
  SELECT entity_id, k, hour, 0.0::DOUBLE AS prev_share, CAST(0 AS BIGINT) AS prev_total,
         CASE WHEN total > 0 THEN CAST(x AS DOUBLE) / CAST(total AS DOUBLE) ELSE 0.0::DOUBLE END AS share,
         CAST(CASE WHEN total > 0 THEN x ELSE 0 END AS BIGINT) AS ltotal
  FROM ss WHERE k = 1
  UNION ALL
  SELECT s.entity_id, s.k, s.hour, f.share, f.ltotal,
         CASE WHEN s.total > 0 THEN
              CASE WHEN f.ltotal > 0 THEN {a} * {cur} + (1.0::DOUBLE - {a}) * f.share ELSE {cur} END
              ELSE f.share END,
         CAST(CASE WHEN s.total > 0 THEN f.ltotal + s.x ELSE f.ltotal END AS BIGINT)
  FROM sfold f JOIN ss s ON s.entity_id = f.entity_id AND s.k = f.k + 1)"""


def tier_hist_ctes() -> str:
    """th: slot/hour/aggregate tiers as of every spine row (range joins)."""
    r9 = lambda e: r1(e, K.TIER_DECIMALS)
    return f""",
fs AS (SELECT *, lead(hour) OVER (PARTITION BY entity_id, dow, hod ORDER BY hour) AS next_hour FROM fold),
hourt AS (SELECT s.entity_id, s.hour, avg(f.mean) AS m, avg(f.std) AS sd, sum(f.n) AS n
          FROM spine s JOIN fs f ON f.entity_id = s.entity_id AND f.hod = s.hod AND f.hour < s.hour
               AND (f.next_hour IS NULL OR f.next_hour >= s.hour)
          GROUP BY s.entity_id, s.hour),
aggt AS (SELECT s.entity_id, s.hour, avg(f.mean) AS m, avg(f.std) AS sd, sum(f.n) AS n
         FROM spine s JOIN fs f ON f.entity_id = s.entity_id AND f.hour < s.hour
              AND (f.next_hour IS NULL OR f.next_hour >= s.hour)
         GROUP BY s.entity_id, s.hour),
th AS (SELECT f.entity_id, f.hour, f.x, f.prev_mean AS slot_mean, f.prev_std AS slot_std,
              CASE WHEN f.prev_n > 0 THEN f.prev_n END AS slot_n,
              CASE WHEN h.n > 0 THEN {r9('h.m')} END AS hour_mean,
              CASE WHEN h.n > 0 THEN {r9('h.sd')} END AS hour_std,
              CASE WHEN h.n > 0 THEN CAST(h.n AS BIGINT) END AS hour_n,
              CASE WHEN a.n > 0 THEN {r9('a.m')} END AS agg_mean,
              CASE WHEN a.n > 0 THEN {r9('a.sd')} END AS agg_std,
              CASE WHEN a.n > 0 THEN CAST(a.n AS BIGINT) END AS agg_n
       FROM fold f LEFT JOIN hourt h ON h.entity_id = f.entity_id AND h.hour = f.hour
       LEFT JOIN aggt a ON a.entity_id = f.entity_id AND a.hour = f.hour)"""


def _band(v: str, cuts) -> str:
    c = [d(x) for x in cuts]
    return (f"(CASE WHEN {v} <= {c[0]} THEN 5 WHEN {v} <= {c[1]} THEN 4 "
            f"WHEN {v} <= {c[2]} THEN 3 WHEN {v} <= {c[3]} THEN 2 ELSE 1 END)")


def score_sql(src: str, extra: str = "") -> str:
    """Scoring over ``src`` with n, total, expected_share and the tier columns."""
    L = K
    labels = ("genius", "smart", "normal", "dumb", "braindead", "unknown")
    conf = lambda n, w: f"least(1.0::DOUBLE, (CAST({n} AS DOUBLE) * {d(w)}) / {d(L.FULL_CONFIDENCE_SAMPLES)})"
    return f"""
r0 AS (SELECT *,
   CASE WHEN slot_n >= 1 THEN 'slot' WHEN hour_n >= 3 THEN 'hour' WHEN agg_n >= 5 THEN 'aggregate'
        ELSE 'none' END AS tier,
   CASE WHEN slot_n >= 1 THEN slot_mean WHEN hour_n >= 3 THEN hour_mean WHEN agg_n >= 5 THEN agg_mean END AS m_r,
   CASE WHEN slot_n >= 1 THEN slot_std WHEN hour_n >= 3 THEN hour_std WHEN agg_n >= 5 THEN agg_std END AS s_r,
   CASE WHEN slot_n >= 1 THEN {conf('slot_n', L.SLOT_WEIGHT)} WHEN hour_n >= 3 THEN {conf('hour_n', L.HOUR_WEIGHT)}
        WHEN agg_n >= 5 THEN {conf('agg_n', L.AGGREGATE_WEIGHT)} ELSE 0.0::DOUBLE END AS confidence,
   CASE WHEN total > 0 THEN CAST(n AS DOUBLE) / CAST(total AS DOUBLE) ELSE 0.0::DOUBLE END AS share_raw,
   coalesce(expected_share, 0.0::DOUBLE) AS exp_raw
 FROM {src}),
r1 AS (SELECT *,
   CASE WHEN m_r IS NULL THEN 0.0::DOUBLE ELSE
     (CAST(n AS DOUBLE) - m_r) / (CASE WHEN s_r > 0.0::DOUBLE THEN s_r
                                       ELSE greatest(m_r * {d(L.Z_FALLBACK_SCALE)}, 1.0::DOUBLE) END) END AS z_raw,
   CASE WHEN m_r IS NULL THEN 0.0::DOUBLE
        WHEN share_raw = 0.0::DOUBLE THEN 0.0::DOUBLE
        WHEN exp_raw <= 0.0::DOUBLE THEN {d(L.D_NO_EXPECTATION)}
        ELSE share_raw / exp_raw END AS d_raw
 FROM r0),
r2 AS (SELECT *,
   CASE WHEN m_r IS NULL THEN 0.0::DOUBLE ELSE
     {r1(f"greatest(1.0::DOUBLE, least(5.0::DOUBLE, {d(L.NEUTRAL_SCORE)} + ({d(L.Z_WEIGHT)} * CAST({_band('z_raw', L.Z_BANDS)} AS DOUBLE) + {d(L.D_WEIGHT)} * CAST({_band('d_raw', L.D_BANDS)} AS DOUBLE) - {d(L.NEUTRAL_SCORE)}) * confidence))", 1)}
   END AS score
 FROM r1),
scored AS (SELECT *,
   CASE WHEN score <= 0.0::DOUBLE THEN '{labels[5]}' WHEN score < 1.5::DOUBLE THEN '{labels[4]}'
        WHEN score < 2.5::DOUBLE THEN '{labels[3]}' WHEN score < 3.5::DOUBLE THEN '{labels[2]}'
        WHEN score < 4.5::DOUBLE THEN '{labels[1]}' ELSE '{labels[0]}' END AS status,
   {r1('m_r', 1)} AS baseline_mean, {r1('z_raw', 2)} AS z_score, {r1('d_raw', 2)} AS disproportionality,
   {r1('share_raw', 3)} AS current_share, {r1('exp_raw', 3)} AS expected_share_out
 FROM r2)"""


def history_sql(kind: str = "ev", cap: int = K.RATE_CAP) -> str:
    return ("WITH RECURSIVE" + base_ctes(kind, cap) + spine_ctes(kind) + fold_ctes() + share_ctes()
            + tier_hist_ctes() + """,
hist AS (SELECT t.*, t.x AS n, sp.total, sf.prev_share AS expected_share
         FROM th t JOIN spine sp ON sp.entity_id = t.entity_id AND sp.hour = t.hour
         JOIN sfold sf ON sf.entity_id = t.entity_id AND sf.hour = t.hour),""" + score_sql("hist") + f"""
SELECT entity_id, {iso('hour')} AS hour, CAST(n AS BIGINT) AS n_signals, CAST(total AS BIGINT) AS total,
       current_share, expected_share_out AS expected_share, tier, confidence, baseline_mean, z_score,
       disproportionality, score, status
FROM scored""")


def snapshot_ctes(kind: str = "ev", lag: int = 1) -> str:
    """snap: the D9 status rows (all STATUS columns) at as_of = last bucket,
    built from folds over [lo, as_of - lag buckets] and direct AVG tiers."""
    unit = f"INTERVAL {lag} DAY" if kind == "ret" else f"INTERVAL {lag} HOUR"
    r9 = lambda e: r1(e, K.TIER_DECIMALS)
    return ("WITH RECURSIVE" + base_ctes(kind) + spine_ctes(kind, f"b.hi - {unit}") + fold_ctes()
            + share_ctes() + f""",
asof_t AS (SELECT hi AS h, CAST(dayofweek(hi) AS INTEGER) AS dw, CAST(hour(hi) AS INTEGER) AS hd FROM bounds),
state AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY entity_id, dow, hod ORDER BY k DESC) = 1),
tiers AS (SELECT st.entity_id,
            max(CASE WHEN st.dow = a.dw AND st.hod = a.hd THEN st.mean END) AS slot_mean,
            max(CASE WHEN st.dow = a.dw AND st.hod = a.hd THEN st.std END) AS slot_std,
            max(CASE WHEN st.dow = a.dw AND st.hod = a.hd THEN st.n END) AS slot_n,
            avg(CASE WHEN st.hod = a.hd THEN st.mean END) AS hm, avg(CASE WHEN st.hod = a.hd THEN st.std END) AS hs,
            sum(CASE WHEN st.hod = a.hd THEN st.n END) AS hn,
            avg(st.mean) AS am, avg(st.std) AS sd_a, sum(st.n) AS an
          FROM state st CROSS JOIN asof_t a GROUP BY st.entity_id),
shares AS (SELECT entity_id, share AS expected_share FROM sfold
           QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY k DESC) = 1),
cur AS (SELECT k.entity_id, k.n FROM counts k JOIN asof_t a ON k.hour = a.h),
curtot AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM cur),
base AS (SELECT c.entity_id, c.display_name, c.provider, c.sort_order,
            CAST(coalesce(cu.n, 0) AS BIGINT) AS n, ct.total,
            t.slot_mean, t.slot_std, CAST(t.slot_n AS BIGINT) AS slot_n,
            CASE WHEN coalesce(t.hn, 0) > 0 THEN {r9('t.hm')} END AS hour_mean,
            CASE WHEN coalesce(t.hn, 0) > 0 THEN {r9('t.hs')} END AS hour_std,
            CASE WHEN coalesce(t.hn, 0) > 0 THEN CAST(t.hn AS BIGINT) END AS hour_n,
            CASE WHEN coalesce(t.an, 0) > 0 THEN {r9('t.am')} END AS agg_mean,
            CASE WHEN coalesce(t.an, 0) > 0 THEN {r9('t.sd_a')} END AS agg_std,
            CASE WHEN coalesce(t.an, 0) > 0 THEN CAST(t.an AS BIGINT) END AS agg_n,
            s.expected_share
         FROM cat c LEFT JOIN cur cu ON cu.entity_id = c.entity_id
         LEFT JOIN tiers t ON t.entity_id = c.entity_id
         LEFT JOIN shares s ON s.entity_id = c.entity_id CROSS JOIN curtot ct),""" + score_sql("base") + f""",
snap AS (SELECT s.entity_id, s.display_name, s.provider, s.sort_order, {iso('a.h')} AS hour,
                s.n AS n_signals, s.total, s.current_share, s.expected_share_out AS expected_share, s.tier,
                s.confidence, s.baseline_mean, s.z_score, s.disproportionality, s.score, s.status
         FROM scored s CROSS JOIN asof_t a)""")


STATUS = ("entity_id, display_name, provider, sort_order, hour, n_signals, total, current_share, "
          "expected_share, tier, confidence, baseline_mean, z_score, disproportionality, score, status")


# ------------------------------------------------------------------ per query
def _ev_with(body: str, kind: str = "ev", cap: int = K.RATE_CAP) -> str:
    return "WITH" + base_ctes(kind, cap) + body


def _partial_cat() -> str:
    return f"pcat AS (SELECT * FROM ({_cat('ev')}) WHERE entity_id <> '{B.EV_LEFT_OUT}')"


def _trend_sql(select: str) -> str:
    return _ev_with(f""",
tr AS (SELECT c.entity_id, unnest(generate_series(b.hi - INTERVAL 23 HOUR, b.hi, INTERVAL 1 HOUR)) AS hour
       FROM cat c CROSS JOIN bounds b),
trend AS (SELECT t.entity_id, CAST(date_diff('hour', b.hi - INTERVAL 23 HOUR, t.hour) AS INTEGER) AS pos,
                 t.hour, CAST(coalesce(k.n, 0) AS BIGINT) AS n
          FROM tr t CROSS JOIN bounds b LEFT JOIN counts k ON k.entity_id = t.entity_id AND k.hour = t.hour)
{select}""")


def _feed() -> str:
    return ("feed AS (SELECT p_partkey AS pos, lower(p_type) || '/' || replace(p_name, ' ', '-') || '-' || "
            "CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 7 = 0 THEN ':free' ELSE '' END AS id, "
            f"p_type || ': ' || {initcap('p_name')} AS name FROM part),\n"
            "parsed AS (SELECT pos, substr(id, 1, instr(id, '/') - 1) AS provider_key, "
            "substr(id, instr(id, '/') + 1) AS slug, "
            "CASE WHEN instr(name, ': ') > 0 THEN substr(name, instr(name, ': ') + 2) ELSE name END AS display_name "
            "FROM feed WHERE instr(id, ':') = 0 AND instr(id, '/') > 0),\n"
            "prov(provider_key, provider, sort_base) AS (VALUES "
            + ", ".join(f"('{k}', '{v}', CAST({b} AS INTEGER))" for k, v, b in B.PART_PROVIDERS) + "),\n"
            "mapped AS (SELECT p.pos, p.provider_key, p.slug, p.display_name, v.provider, v.sort_base "
            "FROM parsed p JOIN prov v ON p.provider_key = v.provider_key),\n"
            "pcatalog AS (SELECT replace(p_name, ' ', '.') || '.' || CAST(p_size AS VARCHAR) AS entity_id, "
            f"{initcap('p_name')} AS display_name, {initcap('p_type')} AS provider, "
            "CAST(p_partkey AS INTEGER) AS sort_order FROM part WHERE p_partkey % 3 = 0),\n"
            "newonly AS (SELECT m.*, regexp_replace(lower(m.slug), '[^a-z0-9]', '', 'g') AS norm FROM mapped m "
            "WHERE regexp_replace(lower(m.slug), '[^a-z0-9]', '', 'g') NOT IN "
            "(SELECT regexp_replace(lower(entity_id), '[^a-z0-9]', '', 'g') FROM pcatalog)),\n"
            "firsts AS (SELECT * FROM newonly QUALIFY row_number() OVER (PARTITION BY norm ORDER BY pos) = 1),\n"
            "added AS (SELECT pos, slug, display_name, provider, CAST(coalesce(sort_base, 9000) + "
            "row_number() OVER (PARTITION BY provider ORDER BY pos) AS INTEGER) AS sort_order FROM firsts)")


def _merge(n: int, mapped: str, catalog: str) -> str:
    """CTE addedN: what a merge of the feed rows ``mapped`` adds to ``catalog``."""
    norm = lambda e: f"regexp_replace(lower({e}), '[^a-z0-9]', '', 'g')"
    return (f"firsts{n} AS (SELECT m.* FROM {mapped} m WHERE {norm('m.slug')} NOT IN (SELECT {norm('entity_id')} FROM {catalog}) "
            f"QUALIFY row_number() OVER (PARTITION BY {norm('m.slug')} ORDER BY pos) = 1), "
            f"added{n} AS (SELECT slug AS entity_id, display_name, provider, CAST(sort_base + "
            f"row_number() OVER (PARTITION BY provider ORDER BY pos) AS INTEGER) AS sort_order FROM firsts{n})")


def _alias_case() -> str:
    from outcry.operators.catalog import glob_to_regex
    whens = []
    for pattern, entity in B.PART_ALIAS_RULES:
        conds = " OR ".join(f"regexp_full_match(id, '{glob_to_regex(alt)}')" for alt in pattern.split("|"))
        whens.append(f"WHEN {conds} THEN '{entity}'")
    return "CASE " + " ".join(whens) + " END"


def _evk_snap(select: str) -> str:
    return snapshot_ctes("evk") + "\n" + select


def _leader(order: str) -> str:
    return _evk_snap(f"SELECT CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS rank, entity_id, "
                     "display_name, n_signals, score, status FROM snap")


def _score_order(direction: str) -> str:
    u = "(score = 0.0)"
    return (f"{u} ASC, score {direction}, CASE WHEN {u} THEN n_signals ELSE 0 END {direction}, "
            "sort_order ASC, entity_id ASC")


def _fmt(expr: str, dp: int) -> str:
    s = f"printf('%.{dp}f', CAST({expr} AS DOUBLE))"
    return f"regexp_replace(regexp_replace({s}, '0+$', ''), '\\.$', '')"


def _digest(kind: str) -> str:
    k = K.TOP_PEERS
    n_txt = "CAST(n_signals AS VARCHAR) || ' signals/hr'"
    score_txt = f"CASE WHEN score > 0 THEN {_fmt('score', 1)} || '/5 (' || status || ')' ELSE 'no score yet' END"
    pre = snapshot_ctes(kind)
    return pre + f""",
top AS (SELECT entity_id AS id, display_name || ' ' || {score_txt} || ' ' || {n_txt} AS line,
               row_number() OVER (ORDER BY CASE WHEN score > 0 THEN score ELSE 99.0 END, sort_order, entity_id) AS rk
        FROM snap WHERE n_signals > 0
        QUALIFY rk <= {k + 1}),
peers AS (SELECT s.entity_id, string_agg(t.line, '; ' ORDER BY t.rk) AS peers
          FROM snap s JOIN (SELECT * FROM top) t ON t.id <> s.entity_id
          GROUP BY s.entity_id)
SELECT s.entity_id,
  CASE WHEN s.score > 0 THEN s.display_name || ': ' || {score_txt.replace('score', 's.score').replace('status', 's.status')}
       ELSE s.display_name || ': no score yet (' || {n_txt.replace('n_signals', 's.n_signals')} || ')' END AS headline,
  CASE WHEN s.score > 0 THEN concat_ws(', ', {n_txt.replace('n_signals', 's.n_signals')},
         CASE WHEN coalesce(s.baseline_mean, 0.0) > 0 THEN 'baseline ~' || {_fmt('coalesce(s.baseline_mean, 0.0)', 1)} END,
         CASE WHEN s.z_score <> 0 THEN 'z=' || {_fmt('s.z_score', 2)} END)
       ELSE 'history too short for a baseline' END AS detail,
  CASE WHEN s.score <= 0 THEN NULL WHEN s.z_score > 1.5 THEN 'busier than its baseline'
       WHEN s.z_score < -0.5 THEN 'calmer than its baseline' END AS flag,
  coalesce((SELECT string_agg(line, '; ' ORDER BY rk) FROM
             (SELECT line, rk FROM top WHERE id <> s.entity_id ORDER BY rk LIMIT {k})), '') AS peers
FROM snap s"""


def oracle_sql() -> dict[str, str]:
    focus, cap_h, cap_d = Q.FOCUS, Q.CAP_HOUR, Q.CAP_DAY
    o: dict[str, str] = {}

    # ---- A
    o["a3_parse_payload"] = (
        "SELECT event_id AS signal_id, nullif(json_extract_string(props, '$.k'), '') AS entity_id, "
        "CASE WHEN nullif(json_extract_string(props, '$.k'), '') IS NULL THEN 'missing_entity' ELSE 'ok' END "
        "AS parse_status FROM events")
    o["a4_actor_key"] = ("SELECT event_id AS signal_id, sha256(coalesce(nullif(CAST(user_id AS VARCHAR), ''), "
                         "'0.0.0.0')) AS actor_key FROM events")
    hour_ts = "date_trunc('hour', ts)"
    o["a5_time_bucket"] = (f"SELECT event_id AS signal_id, {iso(hour_ts)} AS hour, "
                           "CAST(dayofweek(ts) AS INTEGER) AS dow, CAST(hour(ts) AS INTEGER) AS hod FROM events")
    sig = _sig("ev")
    o["a6_known_entities"] = (f"WITH sig AS ({sig}), {_partial_cat()} SELECT signal_id, entity_id, actor_key "
                              "FROM sig WHERE entity_id IN (SELECT entity_id FROM pcat)")
    o["a6_unknown_rejects"] = (f"WITH sig AS ({sig}), {_partial_cat()} SELECT signal_id, entity_id, actor_key "
                               "FROM sig WHERE entity_id IS NOT NULL AND entity_id <> '' "
                               "AND entity_id NOT IN (SELECT entity_id FROM pcat)")
    for key, k, unit in (("a7_rate_cap_hour", cap_h, "hour"), ("a7_rate_cap_day", cap_d, "day")):
        o[key] = (f"WITH sig AS ({sig}), cat AS ({_cat('ev')}), "
                  f"a AS (SELECT *, date_trunc('{unit}', ts) AS b FROM sig WHERE entity_id IN (SELECT entity_id FROM cat)) "
                  f"SELECT signal_id, entity_id, actor_key, {iso('b')} AS bucket FROM a "
                  f"QUALIFY row_number() OVER (PARTITION BY actor_key, b ORDER BY ts, signal_id) <= {k}")
    o["a8_admission_report"] = (
        f"WITH sig AS ({sig}), {_partial_cat()}, "
        "t AS (SELECT s.*, date_trunc('hour', s.ts) AS hour, (s.entity_id IS NULL OR s.entity_id = '') AS missing, "
        "(s.entity_id IN (SELECT entity_id FROM pcat)) AS known FROM sig s), "
        "r AS (SELECT *, coalesce(known, false) AND NOT missing AS ok, row_number() OVER (PARTITION BY actor_key, hour, "
        "(coalesce(known, false) AND NOT missing) ORDER BY ts, signal_id) AS rk FROM t) "
        f"SELECT CASE WHEN missing THEN 'missing_entity' WHEN NOT ok THEN 'unknown_entity' "
        f"WHEN rk > {cap_h} THEN 'rate_limited' ELSE 'accepted' END AS reason, {iso('hour')} AS hour, "
        "count(*) AS n FROM r GROUP BY ALL")
    o["a8_admission_tags"] = (
        f"WITH sig AS ({sig}), {_partial_cat()}, "
        "t AS (SELECT s.*, date_trunc('hour', s.ts) AS hour, (s.entity_id IS NULL OR s.entity_id = '') AS missing, "
        "(s.entity_id IN (SELECT entity_id FROM pcat)) AS known FROM sig s), "
        "r AS (SELECT *, coalesce(known, false) AND NOT missing AS ok, row_number() OVER (PARTITION BY actor_key, hour, "
        "(coalesce(known, false) AND NOT missing) ORDER BY ts, signal_id) AS rk FROM t) "
        f"SELECT signal_id, CASE WHEN missing THEN 'missing_entity' WHEN NOT ok THEN 'unknown_entity' "
        f"WHEN rk > {cap_h} THEN 'rate_limited' ELSE 'accepted' END AS reason FROM r")
    actorless = ("SELECT signal_id, entity_id, CASE WHEN CAST(actor_key AS BIGINT) % 7 <> 0 THEN actor_key END AS actor_key, "
                 f"ts FROM ({sig})")
    for key in ("a8_admission_tags", "a8_admission_report"):
        o[key + "_no_actor"] = o[key].replace(f"sig AS ({sig})", f"sig AS ({actorless})")
    o["a9_dedup"] = _ev_with(f"\nSELECT signal_id, actor_key, entity_id, {iso('hour')} AS hour, "
                             "CAST(dayofweek(hour) AS INTEGER) AS dow, CAST(hour(hour) AS INTEGER) AS hod, "
                             "strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM dd")

    o["a10_signal_sink"] = o["a9_dedup"]

    # ---- B / F5-F7
    o["b1_hourly_counts"] = _ev_with(f"\nSELECT entity_id, {iso('hour')} AS hour, n, dow, hod FROM counts")
    o["b1_hourly_counts_evk"] = _ev_with(f"\nSELECT entity_id, {iso('hour')} AS hour, n, dow, hod FROM counts", "evk")
    o["b2_hourly_totals"] = _ev_with(f"\nSELECT {iso('hour')} AS hour, CAST(sum(n) AS BIGINT) AS total "
                                     "FROM counts GROUP BY hour")
    o["b3_count_at"] = _ev_with(f"\nSELECT '{focus}' AS entity_id, {iso('b.hi')} AS hour, "
                                f"CAST(coalesce((SELECT sum(n) FROM counts k WHERE k.entity_id = '{focus}' "
                                "AND k.hour = b.hi), 0) AS BIGINT) AS n FROM bounds b")
    o["b4_peer_counts"] = _ev_with(f"\nSELECT k.entity_id, {iso('k.hour')} AS hour, k.n FROM counts k, bounds b "
                                   f"WHERE k.entity_id <> '{focus}' AND k.hour = b.hi")
    o["b5_shares"] = _ev_with(f"\nSELECT entity_id, {iso('hour')} AS hour, n, "
                              "CAST(sum(n) OVER (PARTITION BY hour) AS BIGINT) AS total, "
                              "CASE WHEN sum(n) OVER (PARTITION BY hour) > 0 THEN CAST(n AS DOUBLE) / "
                              "CAST(sum(n) OVER (PARTITION BY hour) AS DOUBLE) ELSE 0.0 END AS share FROM counts")
    o["b6_dense_spine"] = ("WITH" + base_ctes("ev") + spine_ctes("ev")
                           + f"\nSELECT entity_id, {iso('hour')} AS hour, CAST(x AS BIGINT) AS n, dow, hod FROM spine")
    o["b6_dense_spine_born"] = ("WITH" + base_ctes("born") + spine_ctes("born")
                                + f"\nSELECT entity_id, {iso('hour')} AS hour, CAST(x AS BIGINT) AS n, dow, hod FROM spine")
    o["b7_trend"] = _trend_sql(f"SELECT entity_id, pos, {iso('hour')} AS hour, n FROM trend")
    o["f5_scaled_trend"] = _trend_sql(f"SELECT entity_id, pos, {iso('hour')} AS hour, n, CAST(n AS DOUBLE) / "
                                      "CAST(greatest(max(n) OVER (PARTITION BY entity_id), 1) AS DOUBLE) AS scaled FROM trend")
    o["f6_has_signal"] = _trend_sql("SELECT entity_id, coalesce(bool_or(n > 0), false) AS has_signal "
                                    "FROM trend GROUP BY entity_id")
    o["f7_local_label"] = _trend_sql(
        f"SELECT entity_id, pos, {iso('hour')} AS hour, "
        f"strftime(timezone('{Q.LOCAL_TZ}', timezone('UTC', hour)), '%-H:%M') AS local_label FROM trend")

    # ---- C
    full = "WITH RECURSIVE" + base_ctes("ev") + spine_ctes("ev") + fold_ctes()
    o["c2_slot_baselines"] = full + f"""
SELECT entity_id, dow, hod, mean, std, n, {iso('hour')} AS last_hour FROM fold
QUALIFY row_number() OVER (PARTITION BY entity_id, dow, hod ORDER BY k DESC) = 1"""
    o["c2_slot_baselines_born"] = o["c2_slot_baselines"].replace(base_ctes("ev"), base_ctes("born"))
    o["c4_apply_hour"] = ("WITH RECURSIVE" + base_ctes("ev") + spine_ctes("ev", "b.hi - INTERVAL 1 HOUR")
                          + fold_ctes() + f"""
SELECT entity_id, dow, hod, mean, std, n, {iso('hour')} AS last_hour FROM fold
QUALIFY row_number() OVER (PARTITION BY entity_id, dow, hod ORDER BY k DESC) = 1""")
    o["c4_close_batches"] = o["c2_slot_baselines"]
    o["c3_slot_history"] = full + f"""
SELECT entity_id, dow, hod, {iso('hour')} AS hour, CAST(x AS BIGINT) AS x, prev_mean, prev_std, prev_n,
       mean, std, n FROM fold"""
    tiers_cols = ("slot_mean, slot_std, slot_n, hour_mean, hour_std, hour_n, agg_mean, agg_std, agg_n")
    o["c3b_tier_history"] = full + tier_hist_ctes() + f"\nSELECT entity_id, {iso('hour')} AS hour, {tiers_cols} FROM th"
    shares = "WITH RECURSIVE" + base_ctes("ev") + spine_ctes("ev") + share_ctes()
    o["c5_share_baselines"] = ("WITH RECURSIVE" + base_ctes("ev") + spine_ctes("ev") + share_ctes() + """,
last AS (SELECT * FROM sfold QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY k DESC) = 1)
SELECT c.entity_id, l.share AS expected_share, l.ltotal AS total FROM cat c LEFT JOIN last l ON l.entity_id = c.entity_id""")
    o["c5b_share_history"] = shares + f"""
SELECT entity_id, {iso('hour')} AS hour, prev_share, prev_total, share, ltotal AS lifetime_total FROM sfold"""
    o["c6_lifetime_totals"] = _ev_with("""
SELECT c.entity_id, CAST(coalesce((SELECT sum(n) FROM counts k WHERE k.entity_id = c.entity_id), 0) AS BIGINT) AS total
FROM cat c""")
    snap_ev = snapshot_ctes("ev")
    o["c9_tiers"] = snap_ev + f"\nSELECT entity_id, {tiers_cols} FROM base"
    o["c7_hour_tier"] = snap_ev + "\nSELECT entity_id, hour_mean, hour_std, hour_n FROM base"
    o["c8_aggregate_tier"] = snap_ev + "\nSELECT entity_id, agg_mean, agg_std, agg_n FROM base"
    o["c10_resolve"] = snap_ev + "\nSELECT entity_id, tier, m_r AS mean, s_r AS std, confidence FROM scored"

    # ---- D
    o["d9_status_snapshot"] = snap_ev + f"\nSELECT {STATUS} FROM snap"
    o["d8_score_entity"] = snap_ev + f"\nSELECT {STATUS} FROM snap WHERE entity_id = '{focus}'"
    o["d10_signal_result"] = snap_ev + f"""
SELECT CASE WHEN entity_id = '{focus}' THEN 'self' ELSE 'peer' END AS role,
       CAST(row_number() OVER (ORDER BY (entity_id = '{focus}') DESC, sort_order, entity_id) - 1 AS BIGINT) AS pos,
       entity_id, display_name, provider, n_signals,
       CASE WHEN entity_id = '{focus}' THEN coalesce(baseline_mean, 0.0) ELSE baseline_mean END AS baseline_mean,
       z_score, current_share, expected_share, disproportionality, score, status FROM snap"""
    o["d11_entity_detail"] = snap_ev + f""",
tr AS (SELECT unnest(generate_series(b.hi - INTERVAL 23 HOUR, b.hi, INTERVAL 1 HOUR)) AS th FROM bounds b)
SELECT s.entity_id, s.display_name, s.provider, s.n_signals, s.baseline_mean, s.z_score, s.score, s.status,
       CAST(date_diff('hour', b.hi - INTERVAL 23 HOUR, t.th) AS INTEGER) AS trend_pos, {iso('t.th')} AS trend_hour,
       CAST(coalesce(k.n, 0) AS BIGINT) AS trend_n
FROM snap s CROSS JOIN tr t CROSS JOIN bounds b
LEFT JOIN counts k ON k.entity_id = s.entity_id AND k.hour = t.th
WHERE s.entity_id = '{focus}'"""
    o["d12_score_history"] = history_sql("ev")
    o["d12_score_history_evk"] = history_sql("evk")
    o["d12_score_history_born"] = history_sql("born")
    o["d9_from_state"] = o["d9_status_snapshot"]
    o["ret_daily_score"] = history_sql("ret")
    o["ret_daily_snapshot"] = snapshot_ctes("ret") + f"\nSELECT {STATUS} FROM snap"

    # ---- E
    o["e1_list_catalog"] = (f"WITH cat AS ({_cat('ev')}) SELECT entity_id, display_name, provider, sort_order, "
                            "CAST(row_number() OVER (ORDER BY sort_order, entity_id) AS BIGINT) AS rank FROM cat")
    feed = "WITH " + _feed() + "\n"
    o["e2_parse_feed"] = feed + "SELECT pos, provider_key, slug, display_name FROM parsed"
    o["e3_map_provider"] = feed + "SELECT pos, provider_key, slug, display_name, provider, sort_base FROM mapped"
    o["e4_norm_key"] = feed + ("SELECT pos, slug, regexp_replace(lower(slug), '[^a-z0-9]', '', 'g') AS norm "
                               "FROM parsed")
    o["e5_new_only"] = feed + "SELECT pos, slug, norm, provider FROM newonly"
    o["e6_first_by_key"] = feed + ("SELECT norm, pos, slug, display_name, provider FROM "
                                   "(SELECT *, regexp_replace(lower(slug), '[^a-z0-9]', '', 'g') AS norm FROM mapped) "
                                   "QUALIFY row_number() OVER (PARTITION BY norm ORDER BY pos) = 1")
    o["e7_sort_order"] = feed + "SELECT pos, slug, display_name, provider, sort_order FROM added"
    o["e8_merge_catalog"] = feed + ("SELECT entity_id, display_name, provider, sort_order, false AS added FROM pcatalog "
                                    "UNION ALL SELECT slug AS entity_id, display_name, provider, sort_order, true AS added "
                                    "FROM added WHERE slug NOT IN (SELECT entity_id FROM pcatalog)")
    def check(expected: str) -> str:
        norm = lambda e: f"regexp_replace(lower({e}), '[^a-z0-9]', '', 'g')"
        return feed.rstrip() + f""", expected AS ({expected}),
missing AS (SELECT entity_id FROM expected WHERE {norm('entity_id')} NOT IN (SELECT {norm('entity_id')} FROM pcatalog))
SELECT k.*, (SELECT count(*) FROM pcatalog) AS catalog_rows,
       (SELECT count(*) FROM pcatalog) >= {Q.CATALOG_MIN_ROWS} AS meets_min, (SELECT count(*) FROM missing) AS missing_rows
FROM (SELECT 'summary' AS kind, CAST(NULL AS VARCHAR) AS entity_id UNION ALL SELECT 'missing', entity_id FROM missing) k"""

    o["e9_catalog_check"] = check("SELECT DISTINCT slug AS entity_id FROM mapped")
    o["e9_catalog_complete"] = check("SELECT DISTINCT upper(entity_id) AS entity_id FROM pcatalog")
    o["e10_resolve_alias"] = feed + (f"SELECT pos, id, entity_id FROM (SELECT pos, id, {_alias_case()} AS entity_id "
                                     "FROM feed) WHERE entity_id IS NOT NULL")

    # ---- F (EVK snapshot)
    o["f1_rank_score_desc"] = _leader(_score_order("DESC"))
    o["f1_rank_score_asc"] = _leader(_score_order("ASC"))
    o["f2_rank_name"] = _leader("lower(display_name) DESC, display_name DESC, sort_order ASC, entity_id ASC")
    o["f2_rank_name_asc"] = _leader("lower(display_name) ASC, display_name ASC, sort_order ASC, entity_id ASC")
    o["f3_search"] = _evk_snap(
        f"SELECT entity_id, display_name, provider, score FROM snap WHERE "
        f"contains(lower(display_name), '{Q.SEARCH}') OR contains(lower(provider), '{Q.SEARCH}') "
        f"OR contains(lower(entity_id), '{Q.SEARCH}')")
    k = K.TOP_PEERS
    o["f4_top_peers"] = _evk_snap(
        "SELECT CAST(row_number() OVER (ORDER BY CASE WHEN score > 0 THEN score ELSE 99.0 END, sort_order, "
        "entity_id) AS BIGINT) AS rank, entity_id, display_name, n_signals, score, status FROM snap "
        f"WHERE n_signals > 0 QUALIFY rank <= {k}")
    o["f4b_first_peers"] = _evk_snap(
        "SELECT CAST(row_number() OVER (ORDER BY sort_order, entity_id) AS BIGINT) AS rank, entity_id, "
        f"display_name, n_signals, score, status FROM snap WHERE n_signals > 0 QUALIFY rank <= {k}")
    for key in ("f4_top_peers", "f4b_first_peers"):
        o[key + "_of"] = o[key].replace("WHERE n_signals > 0 QUALIFY", f"WHERE n_signals > 0 AND entity_id <> '{Q.PEERS_OF}' QUALIFY")
    o["f9_flags"] = _evk_snap(
        "SELECT entity_id, z_score, score, CASE WHEN score <= 0 THEN NULL WHEN z_score > 1.5 THEN "
        "'busier than its baseline' WHEN z_score < -0.5 THEN 'calmer than its baseline' END AS flag FROM snap")
    # ---- G: streams close a bucket once the watermark (2 h on the bucket
    # start) passes its end, so closed buckets are those <= last - 3 h.
    closed = "b.hi - INTERVAL 3 HOUR"
    o["g1_stream_counts"] = _ev_with(f"\nSELECT k.entity_id, {iso('k.hour')} AS hour, k.n FROM counts k, bounds b "
                                     f"WHERE k.hour <= {closed}")
    o["g2_stream_dedup"] = _ev_with(f"\nSELECT actor_key, entity_id, {iso('hour')} AS hour FROM dd")
    o["g3_stream_rate_cap"] = o["a7_rate_cap_hour"].replace(f"sig AS ({sig})", f"sig AS ({_sig('ontime')})")
    o["g6_late_rows"] = (f"SELECT {iso('hour')} AS hour, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS hour FROM ({sig}) "
                         f"WHERE signal_id NOT IN (SELECT signal_id FROM ({_sig('ontime')}))) GROUP BY hour")
    o["g4_capped_close"] = ("WITH RECURSIVE" + base_ctes("ontime", cap_h) + spine_ctes("ontime", closed) + fold_ctes() + f"""
SELECT entity_id, dow, hod, mean, std, n, {iso('hour')} AS last_hour FROM fold
QUALIFY row_number() OVER (PARTITION BY entity_id, dow, hod ORDER BY k DESC) = 1""")
    g4 = "WITH RECURSIVE" + base_ctes("ev") + spine_ctes("ev", closed) + fold_ctes()
    o["g4_hour_close"] = g4 + f"""
SELECT entity_id, dow, hod, mean, std, n, {iso('hour')} AS last_hour FROM fold
QUALIFY row_number() OVER (PARTITION BY entity_id, dow, hod ORDER BY k DESC) = 1"""
    o["c4_apply_hour_shares"] = ("WITH RECURSIVE" + base_ctes("ev") + spine_ctes("ev", "b.hi - INTERVAL 1 HOUR") + share_ctes() + """,
last AS (SELECT * FROM sfold QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY k DESC) = 1)
SELECT c.entity_id, l.share AS expected_share, l.ltotal AS total FROM cat c LEFT JOIN last l ON l.entity_id = c.entity_id""")
    o["g4_share_close"] = ("WITH RECURSIVE" + base_ctes("ev") + spine_ctes("ev", closed) + share_ctes() + """,
last AS (SELECT * FROM sfold QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY k DESC) = 1)
SELECT c.entity_id, l.share AS expected_share, l.ltotal AS total FROM cat c LEFT JOIN last l ON l.entity_id = c.entity_id""")
    o["g5_stream_status"] = snapshot_ctes("ev", lag=3) + f"\nSELECT {STATUS} FROM snap"

    # ---- stored state, history in batches, late repair, streams of A8 and A9
    o["b0d_sink_trend"] = o["b7_trend"]
    o["a11_upsert"] = o["c2_slot_baselines"]
    r9 = lambda e: r1(e, Q.SHARE_DECIMALS)
    o["c5b_share_blocks"] = ("WITH RECURSIVE" + base_ctes("ret") + spine_ctes("ret") + share_ctes() + f"""
SELECT entity_id, {iso('hour')} AS hour, {r9('prev_share')} AS prev_share, prev_total, {r9('share')} AS share,
       ltotal AS lifetime_total FROM sfold""")
    o["j9_state_as_of"] = full + share_ctes() + f"""
SELECT f.entity_id, {iso('f.hour')} AS hour, f.prev_mean AS mean, f.prev_std AS std, nullif(f.prev_n, 0) AS n,
       s.prev_share AS share, s.prev_total AS total
FROM fold f JOIN sfold s ON s.entity_id = f.entity_id AND s.hour = f.hour
JOIN counts k ON k.entity_id = f.entity_id AND k.hour = f.hour"""
    o["d12_history_batches"] = o["d12_score_history"]
    o["ret_history_batches"] = o["ret_daily_score"]
    o["g6_repair"] = history_sql("ev", cap_h)
    o["g2_stream_refresh"] = _ev_with(f"\nSELECT signal_id, actor_key, entity_id, {iso('hour')} AS hour, "
                                      "CAST(dayofweek(hour) AS INTEGER) AS dow, CAST(hour(hour) AS INTEGER) AS hod, "
                                      "strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM dd", "ontime")
    ontime = o["a8_admission_report"].replace(f"sig AS ({sig})", f"sig AS ({_sig('ontime')})")
    newest = f"(SELECT max(date_trunc('hour', ts)) FROM ({sig}) WHERE entity_id <> '{B.EV_LEFT_OUT}')"
    o["g7_stream_rejects"] = (f"SELECT * FROM ({ontime}) WHERE hour <= {iso(newest + ' - INTERVAL 3 HOUR')} UNION ALL "
                              f"SELECT 'late' AS reason, hour, n FROM ({o['g6_late_rows']})")
    births = (f"dcat AS (SELECT c.*, CASE WHEN p.p_size <= {B.FIRST_EDITION_SIZE} THEN TIMESTAMP '{B.FIRST_BIRTH}' "
              "+ to_hours(p.p_size) END AS valid_from FROM pcatalog c JOIN part p ON p.p_partkey = c.sort_order)")
    o["e8_merge_births"] = feed.rstrip() + f", {births}" + f"""
SELECT entity_id, display_name, provider, sort_order, {iso('valid_from')} AS valid_from, false AS added FROM dcat
UNION ALL SELECT slug, display_name, provider, sort_order, NULL, true FROM added WHERE slug NOT IN (SELECT entity_id FROM dcat)"""
    out = "entity_id, display_name, provider, sort_order, {at} AS valid_from, CAST(NULL AS VARCHAR) AS valid_to, CAST({m} AS BIGINT) AS merge_id"
    at = [iso(f"TIMESTAMP '{t}'") for t in B.MERGE_TIMES]
    o["e8_dated_merges"] = feed.rstrip() + f""", {births},
mapped1 AS (SELECT m.* FROM mapped m JOIN part p ON p.p_partkey = m.pos WHERE p.p_size <= {B.FIRST_EDITION_SIZE}),
{_merge(1, 'mapped1', 'pcatalog')}, known1 AS (SELECT entity_id FROM pcatalog UNION ALL SELECT entity_id FROM added1),
{_merge(2, 'mapped', 'known1')}
SELECT {out.format(at=iso('valid_from'), m=0)} FROM dcat
UNION ALL SELECT {out.format(at=at[0], m=1)} FROM added1 WHERE entity_id NOT IN (SELECT entity_id FROM pcatalog)
UNION ALL SELECT {out.format(at=at[1], m=2)} FROM added2 WHERE entity_id NOT IN (SELECT entity_id FROM known1)"""
    fixed = ", ".join(f"('{1 if rules is B.FIRST_RULES else 3} {k}', '{p}', '{e}')"
                      for rules in (B.FIRST_RULES, B.LAST_RULES) for k, (p, e) in enumerate(rules))
    o["e10_rules_table"] = feed.rstrip() + f""",
names AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS w, p_size AS s FROM part WHERE p_size <= {B.FIRST_EDITION_SIZE}),
rules(rule, pattern, entity) AS (
  SELECT '2 ' || p_name || ' ' || printf('%03d', s), '*/' || w || '-*-' || s || t, p_name || ' ' || s
  FROM names, (VALUES (''), (':free')) v(t)
  UNION ALL VALUES {fixed})
SELECT pos, id, min_by(entity, rule) AS entity_id FROM feed JOIN rules ON id GLOB pattern GROUP BY pos, id"""

    o["f8_digest"] = _digest("evk")
    o["f8_digest_ev"] = _digest("ev")
    return o
