"""DuckDB SQL for each registered query (the independent oracle).

The driver registers every parquet table as a view; the stand-in mappings
of ``plans/standins.py`` are repeated here as CTEs.  Literal numbers used in
double arithmetic are cast to DOUBLE (DuckDB reads ``0.5`` as DECIMAL).
Nothing of the Spark side's parsing is imported: the patterns below are written
for the driver's pages alone, which hold four entities and no nested elements.
"""

from __future__ import annotations

import math

from .. import schemas as S

POINT = r"^POINT\(([-0-9.]+) ([-0-9.]+)\)$"

def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def drop_non_text(x: str) -> str:
    return f"regexp_replace({x}, '(?s)<!--.*?-->|<script>.*?</script>|<style>.*?</style>|<!DOCTYPE[^>]*>', '', 'g')"


def decode(x: str) -> str:
    for ref, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        x = f"replace({x}, {q(ref)}, {q(char)})"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def strip_tags(x: str) -> str:
    return decode(f"regexp_replace({x}, '</?[A-Za-z][^>]*>', '', 'g')")


def page_text(x: str) -> str:
    return strip_tags(drop_non_text(x))


def element_pattern(tag: str, cls: str | None) -> tuple[str, int]:
    return (f"(?s)<{tag}[^>]* class=\"{cls}\"[^>]*>(.*?)</{tag}>" if cls else f"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>"), 1


def key_hash(*parts: str) -> str:
    texts = [f"CAST({p} AS VARCHAR)" for p in parts]
    return "sha256(" + " || ".join(f"COALESCE(CAST(length({t}) AS VARCHAR) || ':' || {t}, 'N')" for t in texts) + ")"


def contains_any(x: str, words) -> str:
    return "COALESCE(" + " OR ".join(f"contains(lower({x}), {q(w.lower())})" for w in words) + ", false)"


def local_text(c: str) -> str:
    return f"strftime(timezone('America/Sao_Paulo', timezone('UTC', {c})), '%d/%m/%Y %H:%M')"


def label_case(r: str = "rain_feature", w: str = "wind_feature", n: str = "nlp_risk_score") -> str:
    return (f"CASE WHEN {w} > {S.LABEL_WIND_GT}::DOUBLE THEN 1 WHEN {r} > {S.LABEL_RAIN_GT}::DOUBLE THEN 1 "
            f"WHEN {n} > {S.LABEL_NLP_GT}::DOUBLE THEN 1 "
            f"WHEN {r} * {S.LABEL_W_RAIN}::DOUBLE + {w} * {S.LABEL_W_WIND}::DOUBLE "
            f"+ {n} * {S.LABEL_W_NLP}::DOUBLE > {S.LABEL_CUT}::DOUBLE THEN 1 ELSE 0 END")


def uniform(key: str, stream: int, seed: int = S.SEED) -> str:
    m = 2 ** 31
    h1 = f"((({key}) % {m}) * 1103515245 + {12345 + 7919 * stream + seed}) % {m}"
    h1 = f"xor({h1}, ({h1}) >> 13)"
    h2 = f"(({h1}) * 1664525 + 1013904223) % {m}"
    h2 = f"xor({h2}, ({h2}) >> 16)"
    return f"(CAST({h2} AS DOUBLE) / {float(m)}::DOUBLE)"


RUN = "TIMESTAMP '2026-01-01 00:00:00'"
RUN_TEXT = "'2026-01-01 00:00:00'"

LINEUP = """lineup AS (
  SELECT o_orderkey AS lineup_id, o_custkey AS ship_id,
         CAST(o_orderdate AS DATE) AS data_chegada_prevista,
         o_orderpriority AS terminal, o_orderstatus AS commodity,
         o_totalprice AS quantidade_estimada, o_orderdate AS inserido_em,
         o_totalprice / 10000.0::DOUBLE AS rain_feature,
         CAST(o_orderkey % 100 AS DOUBLE) / 100.0::DOUBLE AS nlp_risk_score
  FROM orders)"""

WEATHER_RAW = """weather_raw AS (
  SELECT event_id, user_id AS loc_id, ts, value AS precip,
         NULLIF(CAST(json_extract_string(props, '$.k') AS DOUBLE), 50.0::DOUBLE) AS windspeed,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) / 2.0::DOUBLE AS humidity
  FROM events)"""

NORMALIZE = """COALESCE(CASE WHEN isnan(precip) THEN NULL ELSE precip END, 0.0::DOUBLE) AS precipitacao_mm,
         CASE WHEN isnan(windspeed) THEN NULL ELSE windspeed END AS velocidade_vento,
         CASE WHEN isnan(humidity) THEN NULL ELSE humidity END AS umidade,
         (COALESCE(CASE WHEN isnan(precip) THEN NULL ELSE precip END > 5.0::DOUBLE, false)
          OR COALESCE(CASE WHEN isnan(windspeed) THEN NULL ELSE windspeed END > 15.0::DOUBLE, false))
           AS alerta_critico"""

WEATHER = WEATHER_RAW + """,
weather AS (
  SELECT event_id, loc_id, ts AS timestamp_leitura, """ + NORMALIZE + """
  FROM weather_raw)"""

LATEST_SHIPS = LINEUP + """,
latest AS (
  SELECT *, """ + local_text("inserido_em") + """ AS data_formatada
  FROM lineup WHERE ship_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY ship_id
                             ORDER BY inserido_em DESC NULLS LAST, lineup_id DESC) = 1)"""


def map_sql(dim_cte: str) -> str:
    lat = f"TRY_CAST(NULLIF(regexp_extract(d.coordenadas, {q(POINT)}, 2), '') AS DOUBLE)"
    lon = f"TRY_CAST(NULLIF(regexp_extract(d.coordenadas, {q(POINT)}, 1), '') AS DOUBLE)"
    alert = "COALESCE(l.alerta_critico, false)"
    popup = ("'<b>' || COALESCE(d.nome_ponto, 'n/d') || '</b><br>Tipo: ' || COALESCE(d.tipo_ponto, 'n/d')"
             " || '<br>Chuva: ' || COALESCE(CAST(l.precipitacao_mm AS VARCHAR), 'n/d')"
             " || 'mm<br>Vento: ' || COALESCE(CAST(l.velocidade_vento AS VARCHAR), 'n/d') || 'km/h'")
    return f"""WITH {WEATHER}, {dim_cte},
latest AS (
  SELECT CAST(loc_id AS VARCHAR) AS loc_id, precipitacao_mm, velocidade_vento, alerta_critico
  FROM weather
  QUALIFY row_number() OVER (PARTITION BY loc_id ORDER BY timestamp_leitura DESC NULLS LAST,
                                                           event_id DESC) = 1)
SELECT d.loc_id, d.nome_ponto, {lat} AS lat, {lon} AS lon, d.tipo_ponto,
       l.precipitacao_mm, l.velocidade_vento, l.alerta_critico,
       CASE WHEN {alert} THEN 'red' ELSE 'blue' END AS color,
       CASE WHEN {alert} THEN 'cloud-showers-heavy' ELSE 'ship' END AS icon,
       {popup} AS popup
FROM dim d LEFT JOIN latest l ON d.loc_id = l.loc_id"""


def _points_cte() -> str:
    from .catalog import STANDIN_POINTS
    rows = ", ".join(f"({q(loc)}, {q(name)}, {q(f'POINT({lon} {lat})')}, 'PONTO')"
                     for loc, name, lat, lon in STANDIN_POINTS)
    return f"dim AS (SELECT * FROM (VALUES {rows}) t(loc_id, nome_ponto, coordenadas, tipo_ponto))"


CUSTOMER_DIM = """dim AS (
  SELECT CAST(c_custkey AS VARCHAR) AS loc_id, c_name AS nome_ponto,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'LINESTRING(0 0,1 1)'
              ELSE 'POINT(-46.' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || ' -23.'
                   || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || ')' END AS coordenadas,
         c_mktsegment AS tipo_ponto
  FROM customer)"""


def elements_sql(tag: str, cls, limit=None) -> str:
    pattern, group = element_pattern(tag, cls)
    arr = f"regexp_extract_all({drop_non_text('html')}, {q(pattern)}, {group})"
    if limit is not None:
        arr = f"list_slice({arr}, 1, {limit})"
    return f"""WITH el AS (SELECT page_id, {arr} AS arr FROM pages),
x AS (SELECT page_id, unnest(range(len(arr))) AS ord, unnest(arr) AS inner_html FROM el)
SELECT page_id, CAST(ord AS INTEGER) AS ord, {strip_tags('inner_html')} AS text FROM x"""


SQL: dict[str, str] = {}

# --- sources and sinks -------------------------------------------------------

SQL["weather_normalize"] = f"""WITH {WEATHER_RAW}
SELECT event_id, CAST(loc_id AS VARCHAR) AS loc_id, ts AS timestamp_leitura, {NORMALIZE}
FROM weather_raw"""

LANDED = WEATHER_RAW + """,
landed AS (SELECT * FROM weather_raw WHERE loc_id % 97 <> 13)"""

SQL["weather_csv_roundtrip"] = f"""WITH {LANDED}
SELECT CAST(loc_id AS VARCHAR) AS loc_id, date_trunc('second', ts) AS timestamp_leitura, {NORMALIZE},
       {RUN} AS inserido_em
FROM landed"""

SQL["weather_rejects"] = """
SELECT DISTINCT CAST(user_id AS VARCHAR) AS loc_id, 'missing columns: precip' AS reason
FROM events WHERE user_id % 97 = 13"""

SQL["append_table"] = f"""WITH {WEATHER}
SELECT event_id, CAST(loc_id AS VARCHAR) AS loc_id, timestamp_leitura, precipitacao_mm, velocidade_vento, umidade,
       alerta_critico FROM weather"""

SQL["table_lifecycle"] = """
SELECT name, 'created' AS created, 'dropped' AS dropped, 'absent' AS again,
       CASE WHEN name = 'fato_clima' THEN (SELECT CAST(count(*) AS BIGINT) FROM events) ELSE 0 END AS rows
FROM (VALUES ('fato_clima'), ('fato_lineup'), ('fato_contingencias_nlp'), ('dim_geografia_rota')) t(name)"""

SQL["ndjson_roundtrip"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS lineup_id, CAST(o_custkey AS VARCHAR) AS ship_id,
       CAST(o_orderdate AS DATE) AS data_chegada_prevista,
       date_trunc('second', o_orderdate) AS data_atracacao_prevista,
       'Esperado' AS status_atual, o_orderpriority AS terminal, o_orderstatus AS commodity,
       o_totalprice AS quantidade_estimada, date_trunc('second', o_orderdate) AS inserido_em
FROM orders"""

SQL["insert_rejects"] = """
SELECT event_type,
       CAST(count(*) FILTER (WHERE NOT (event_type = 'error' AND value > 250)) AS BIGINT) AS accepted,
       CAST(count(*) FILTER (WHERE event_type = 'error' AND value > 250) AS BIGINT) AS rejected
FROM events GROUP BY event_type"""

SQL["scan_project"] = "SELECT event_id, ts, value FROM events"

SQL["load_report"] = "SELECT user_id AS loc_id, CAST(count(*) AS BIGINT) AS rows FROM events GROUP BY user_id"

# --- joins and latest state --------------------------------------------------

SQL["points_join"] = map_sql(_points_cte())
SQL["latest_per_loc_map"] = map_sql(CUSTOMER_DIM)

SQL["latest_per_ship"] = "WITH " + LATEST_SHIPS + " SELECT * FROM latest"

SQL["latest_event"] = "SELECT * FROM events ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 1"

SQL["preview"] = "SELECT * FROM events ORDER BY event_id LIMIT 5"

SQL["flag_max"] = """
WITH e AS (SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN value END AS value FROM events)
SELECT event_id, value, COALESCE(value = (SELECT max(value) FROM e), false) AS is_max FROM e"""

SQL["feature_store_view"] = f"""WITH {WEATHER},
l AS (SELECT o_orderkey AS lineup_id, o_custkey AS ship_id, o_orderpriority AS terminal,
             TIMESTAMP '2024-01-01 01:00:00' + to_days(CAST((o_orderkey // 500) % 29 AS INTEGER)) AS inserido_em FROM orders),
w AS (SELECT timestamp_leitura AS wts, precipitacao_mm AS rain_feature, velocidade_vento AS wind_feature
      FROM weather WHERE event_id % 3 = 0),
n AS (SELECT ts AS nts, value / 500.0::DOUBLE AS score FROM events WHERE event_type = 'error'),
lw AS (SELECT l.*, rain_feature, wind_feature FROM l ASOF LEFT JOIN w ON l.inserido_em >= w.wts)
SELECT lw.lineup_id, ship_id, terminal, inserido_em, rain_feature, wind_feature,
       COALESCE(score, 0.0::DOUBLE) AS nlp_risk_score
FROM lw ASOF LEFT JOIN n ON lw.inserido_em >= n.nts"""

SQL["feature_store"] = """
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
     v AS (SELECT event_id AS view_event_id, user_id, ts AS vts, value AS view_value
           FROM events WHERE event_type = 'view')
SELECT p.event_id, p.user_id, p.ts, v.view_value, v.view_event_id,
       COALESCE((SELECT value FROM events WHERE event_type = 'error'
                 ORDER BY ts DESC, event_id DESC LIMIT 1), 0.0::DOUBLE) AS current_error_value
FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.vts"""

SQL["dedup_readings"] = f"""WITH {WEATHER_RAW},
f AS (SELECT CAST(loc_id AS VARCHAR) AS loc_id, ts AS timestamp_leitura, {NORMALIZE},
             TIMESTAMP '2024-02-01 00:00:00' AS inserido_em FROM weather_raw),
more AS (SELECT * REPLACE (COALESCE(precip, 0.0::DOUBLE) + 1.0::DOUBLE AS precip) FROM weather_raw
         WHERE event_id IN (SELECT event_id FROM events WHERE event_type IN ('click', 'view'))),
a AS (SELECT CAST(loc_id AS VARCHAR) AS loc_id, ts AS timestamp_leitura, {NORMALIZE},
             TIMESTAMP '2024-02-02 00:00:00' AS inserido_em FROM more),
u AS (SELECT * FROM f UNION ALL SELECT * FROM a)
SELECT * FROM u
QUALIFY row_number() OVER (PARTITION BY loc_id, timestamp_leitura ORDER BY inserido_em DESC,
    precipitacao_mm DESC NULLS LAST, velocidade_vento DESC NULLS LAST, umidade DESC NULLS LAST) = 1"""

SQL["union_batches"] = """SELECT event_id, event_type, value FROM events
UNION ALL SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders"""

# --- line-up and pages -------------------------------------------------------

RAW_TEXT = """raw AS (
  SELECT *, 'SHIP-' || CAST(o_orderkey AS VARCHAR) AS ship,
         CASE WHEN o_custkey % 10 <> 3 THEN CAST(o_custkey AS VARCHAR) END AS imo,
         CASE WHEN o_orderstatus = 'P' THEN 'sem data'
              WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d-%m-%Y')
              WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%d/%m/%y')
              WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d.%m.%Y %H:%M')
              ELSE strftime(o_orderdate, '%d/%m/%Y %H:%M') END AS when_text,
         CASE WHEN o_orderpriority = '5-LOW' THEN '10D'
              ELSE translate(format('{:,.2f}', o_totalprice), ',.', '.,') END AS weight
  FROM orders)"""

LINEUP_FIELDS = f"""imo AS ship_id,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS data_chegada_prevista,
       CASE WHEN o_orderstatus = 'P' THEN NULL
            WHEN o_orderstatus = 'F' THEN date_trunc('day', o_orderdate)
            ELSE date_trunc('minute', o_orderdate) END AS data_atracacao_prevista,
       'Esperado' AS status_atual, o_orderpriority AS terminal, o_orderstatus AS commodity,
       CASE WHEN o_orderpriority = '5-LOW' THEN 0.0::DOUBLE ELSE round(o_totalprice, 2) END
         AS quantidade_estimada,
       {RUN} AS inserido_em"""

SQL["lineup_clean"] = f"""WITH {RAW_TEXT}
SELECT {key_hash('ship', 'imo', 'when_text', 'o_orderstatus', 'weight', 'o_orderpriority', RUN_TEXT)} AS lineup_id,
       {LINEUP_FIELDS}
FROM raw WHERE imo IS NOT NULL"""

SQL["html_table_rows"] = "SELECT c_custkey, replace(c_name, '#', '#&') AS c_name, c_nationkey FROM customer"

SQL["page_elements_div_ad"] = elements_sql("div", "ad")
SQL["page_links_first5"] = elements_sql("a", None, 5)

SQL["page_text_hits"] = f"""WITH t AS (SELECT page_id, {page_text('html')} AS t FROM pages)
SELECT page_id, CAST(length(t) AS BIGINT) AS text_chars,
       {contains_any('t', ['license'])} AS has_license,
       {contains_any('t', ['token'])} AS has_token,
       {contains_any('t', ['the '])} AS has_the
FROM t"""


def _contingency_sql(batch: str = "CAST(page_id AS VARCHAR)") -> str:
    from .catalog import STANDIN_RULES as R
    (w1, wt1, m1), (w2, wt2, m2) = R.road_tiers
    link_pat, group = element_pattern(R.link_tag, R.link_class)
    hit = contains_any("text", R.news_words)
    return f"""
WITH base AS (SELECT page_id, {batch} AS batch_id, html FROM pages),
road AS (SELECT batch_id, page_id, lower({page_text('html')}) AS t FROM base),
road_hit AS (
  SELECT batch_id, 0 AS src, page_id, 0 AS ord,
         CASE WHEN {contains_any('t', w1)} THEN {wt1}::DOUBLE
              WHEN {contains_any('t', w2)} THEN {wt2}::DOUBLE ELSE 0.0::DOUBLE END AS weight,
         CASE WHEN {contains_any('t', w1)} THEN {q(m1)}
              WHEN {contains_any('t', w2)} THEN {q(m2)} END AS message
  FROM road),
links AS (SELECT batch_id, page_id,
                 list_slice(regexp_extract_all({drop_non_text('html')}, {q(link_pat)}, {group}),
                            1, {R.headlines_per_page}) AS arr FROM base),
heads AS (SELECT batch_id, page_id, unnest(range(len(arr))) AS ord, unnest(arr) AS inner_html FROM links),
heads2 AS (SELECT batch_id, page_id, ord, {strip_tags('inner_html')} AS text FROM heads),
news_hit AS (
  SELECT batch_id, 1 AS src, page_id, ord,
         CASE WHEN {hit} THEN {R.news_weight}::DOUBLE ELSE 0.0::DOUBLE END AS weight,
         CASE WHEN {hit} THEN {q(R.news_prefix)} || left(text, {R.headline_chars}) || '...' END AS message
  FROM heads2),
alerts AS (SELECT * FROM road_hit UNION ALL SELECT * FROM news_hit),
per AS (SELECT batch_id, sum(weight) AS total, count(message) AS n_alerts,
               string_agg(message, {q(S.TEXT_JOIN)} ORDER BY src, page_id, ord) AS joined
        FROM alerts GROUP BY batch_id)
SELECT {key_hash(q(S.CONTINGENCY_LOC), 'batch_id', RUN_TEXT)} AS cont_id,
       {q(S.CONTINGENCY_LOC)} AS loc_id, {RUN} AS timestamp_leitura,
       CASE WHEN n_alerts > 0 THEN joined ELSE {q(R.default_text)} END AS texto_original,
       {q(S.CONTINGENCY_ENTITY)} AS entidade_evento,
       round(least(total, {R.cap}::DOUBLE), 9) AS score_risco,
       '{{"alertas":' || CAST(n_alerts AS VARCHAR) || '}}' AS json_extraido,
       batch_id
FROM per"""


SQL["contingency_score"] = _contingency_sql()

SQL["contingency_json"] = f"""
SELECT event_id,
       {key_hash('event_id', RUN_TEXT)} AS cont_id,
       'SANTOS_GERAL' AS loc_id, {RUN} AS timestamp_leitura, event_type AS texto_original,
       COALESCE(json_extract_string(props, '$.evento'), 'N/A') AS entidade_evento,
       0.8::DOUBLE AS score_risco, props AS json_extraido,
       json_extract_string(props, '$.k') AS k
FROM events"""

SQL["row_id"] = f"""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS o_custkey,
                  o_orderstatus || '|' || o_orderpriority AS tag FROM orders)
SELECT o_orderkey, o_custkey, {key_hash('o_custkey', 'tag', 'o_orderkey', RUN_TEXT)} AS row_id FROM o"""

SQL["contingency_portuguese"] = f"""
WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders),
m AS (SELECT k, CASE s WHEN 'F' THEN 'Ecovias: Bloqueio detectado no SAI.' WHEN 'O' THEN 'Ecovias: Tráfego lento.' END AS road,
             CASE s WHEN 'F' THEN 0.5::DOUBLE WHEN 'O' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
               + CASE WHEN p IN ('1-URGENT', '2-HIGH') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score,
             CASE p WHEN '1-URGENT' THEN 'G1: ' || left('Paralisação dos portuários ' || k, 40) || '...'
                    WHEN '2-HIGH' THEN 'G1: ' || left('GREVE & protesto no cais, dia ' || k, 40) || '...' END AS news FROM o)
SELECT {key_hash("'SANTOS_LOGISTICA_GERAL'", 'k', RUN_TEXT)} AS cont_id, 'SANTOS_LOGISTICA_GERAL' AS loc_id,
       {RUN} AS timestamp_leitura,
       COALESCE(NULLIF(concat_ws(' | ', road, news), ''), 'Condições normais de acesso.') AS texto_original,
       'Sistema Anchieta-Imigrantes / Porto' AS entidade_evento, round(least(score, 1.0::DOUBLE), 9) AS score_risco,
       '{{"alertas":' || CAST((road IS NOT NULL)::INT + (news IS NOT NULL)::INT AS VARCHAR) || '}}' AS json_extraido,
       k AS batch_id
FROM m"""

SQL["headline_trunc"] = f"""
SELECT doc_id, left(text, 40) || '...' AS headline, CAST(length(text) AS BIGINT) AS text_chars,
       {contains_any('text', ['license'])} AS has_license
FROM documents"""

SQL["local_timestamp"] = f"SELECT event_id, {local_text('ts')} AS local_text FROM events"

# --- reports -----------------------------------------------------------------

SQL["fleet_kpis"] = "WITH " + LATEST_SHIPS + """
SELECT CAST(count(*) AS BIGINT) AS n_ships, round(avg(rain_feature), 6) AS mean_rain_mm,
       round(avg(nlp_risk_score) * 100.0::DOUBLE, 6) AS mean_nlp_risk_pct, max(inserido_em) AS last_update
FROM latest"""

SQL["access_risk_kpi"] = """
WITH n AS (SELECT CAST(event_id AS VARCHAR) AS cont_id, ts, value / 500.0::DOUBLE AS score,
                  event_type AS texto_original FROM events),
top1 AS (SELECT score, texto_original FROM n ORDER BY ts DESC, cont_id DESC LIMIT 1),
s AS (SELECT COALESCE((SELECT score FROM top1), 0.0::DOUBLE) AS score,
             (SELECT texto_original FROM top1) AS texto_original)
SELECT round(score * 100.0::DOUBLE, 6) AS access_risk_pct,
       CASE WHEN score > 0.4::DOUBLE THEN 'alert' WHEN score > 0.0::DOUBLE THEN 'attention'
            ELSE 'normal' END AS tier,
       texto_original
FROM s"""

SQL["volume_by_terminal"] = "WITH " + LATEST_SHIPS + """
SELECT terminal, round(sum(quantidade_estimada), 2) AS total_volume,
       round(avg(rain_feature), 6) AS mean_rain_mm, CAST(count(*) AS BIGINT) AS n_ships
FROM latest GROUP BY terminal"""


SQL["rain_segments"] = "WITH " + LATEST_SHIPS + """
SELECT terminal, floor(rain_feature) AS rain_feature, round(sum(quantidade_estimada), 2) AS volume,
       CAST(count(*) AS BIGINT) AS n_ships
FROM latest GROUP BY terminal, floor(rain_feature)"""

SQL["formatted_kpis"] = "WITH " + LATEST_SHIPS + """
SELECT terminal, printf('%.2f', sum(quantidade_estimada)) AS volume, printf('%.1f mm', avg(rain_feature)) AS rain,
       printf('%.1f%%', CAST(count(*) AS DOUBLE) / 1000.0::DOUBLE * 100.0::DOUBLE) AS share
FROM latest GROUP BY terminal"""


def _top(col: str) -> str:
    return "WITH " + LINEUP + f"""
SELECT {col}, CAST(count(*) AS BIGINT) AS count,
       CAST(row_number() OVER (ORDER BY count(*) DESC, {col} ASC) AS INTEGER) AS rank
FROM lineup WHERE {col} IS NOT NULL GROUP BY {col}
ORDER BY count(*) DESC, {col} ASC LIMIT 5"""


SQL["top_terminals"] = _top("terminal")
SQL["top_ships"] = _top("ship_id")

SQL["arrivals_by_date"] = "WITH " + LINEUP + """
SELECT data_chegada_prevista, CAST(count(*) AS BIGINT) AS count
FROM lineup WHERE data_chegada_prevista IS NOT NULL GROUP BY data_chegada_prevista"""

SQL["class_share"] = """
SELECT quality, CAST(count(*) AS BIGINT) AS count,
       round(CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS share
FROM labels WHERE quality IS NOT NULL GROUP BY quality"""

SQL["describe_weather"] = f"""WITH {WEATHER},
cols AS (SELECT 'precipitacao_mm' AS measure, precipitacao_mm AS v FROM weather
         UNION ALL SELECT 'velocidade_vento', velocidade_vento FROM weather
         UNION ALL SELECT 'umidade', umidade FROM weather),
agg AS (SELECT measure,
               unnest(['count', 'mean', 'std', 'min', 'max', '25%', '50%', '75%']) AS stat,
               unnest([CAST(count(v) AS DOUBLE), avg(v), stddev_samp(v), min(v), max(v),
                       quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.75)]) AS value
        FROM cols GROUP BY measure)
SELECT measure, stat, round(value, 6) AS value FROM agg"""

SQL["rain_histogram"] = f"""WITH {WEATHER},
b AS (SELECT min(precipitacao_mm) AS lo, max(precipitacao_mm) AS hi, count(precipitacao_mm) AS n,
             quantile_cont(precipitacao_mm, 0.75) - quantile_cont(precipitacao_mm, 0.25) AS iqr FROM weather),
k AS (SELECT lo, hi, CAST(ceil((hi - lo) / least((hi - lo) / (log2(n) + 1),
             COALESCE(NULLIF(2 * iqr / pow(n, 1.0::DOUBLE / 3), 0), hi - lo))) AS INTEGER) AS bins FROM b),
w AS (SELECT lo, hi, bins, (hi - lo) / bins::DOUBLE AS width FROM k),
c AS (SELECT CAST(least(floor((x.precipitacao_mm - w.lo) / w.width), w.bins - 1) AS INTEGER) AS bin, count(*) AS n
      FROM weather x, w WHERE x.precipitacao_mm IS NOT NULL GROUP BY 1),
g AS (SELECT CAST(unnest(range(bins)) AS INTEGER) AS bin FROM w)
SELECT g.bin, round(w.lo + g.bin * w.width, 6) AS bin_lo, round(w.lo + (g.bin + 1) * w.width, 6) AS bin_hi,
       CAST(COALESCE(c.n, 0) AS BIGINT) AS count
FROM g CROSS JOIN w LEFT JOIN c ON g.bin = c.bin"""

SQL["rain_kde"] = f"""WITH {WEATHER},
v AS (SELECT precipitacao_mm AS v FROM weather WHERE precipitacao_mm IS NOT NULL),
s AS (SELECT min(v) AS lo, max(v) AS hi, count(v) AS n, stddev_samp(v) * pow(CAST(count(v) AS DOUBLE), -0.2::DOUBLE) AS h
      FROM v),
g AS (SELECT CAST(range AS INTEGER) AS i, lo + range * ((hi - lo) / 199.0::DOUBLE) AS x, n, h FROM range(200), s)
SELECT i, round(x, 6) AS x,
       round(sum(exp(-0.5::DOUBLE * pow((x - v.v) / h, 2))) / (n * h * {math.sqrt(2.0 * math.pi)!r}::DOUBLE), 9) AS density
FROM g, v GROUP BY i, x, n, h"""

LABEL_PRED = "lp AS (SELECT quality AS label, 1 - toxic AS prediction FROM labels)"

SQL["confusion_matrix"] = f"""WITH {LABEL_PRED}, cls AS (SELECT * FROM (VALUES (0), (1)) t(k))
SELECT CAST(a.k AS INTEGER) AS label, CAST(p.k AS INTEGER) AS prediction,
       CAST((SELECT count(*) FROM lp WHERE lp.label = a.k AND lp.prediction = p.k) AS BIGINT) AS count
FROM cls a, cls p"""

SQL["classification_report"] = f"""WITH {LABEL_PRED},
c AS (SELECT CAST(count(*) FILTER (WHERE label = 0 AND prediction = 0) AS DOUBLE) AS c00,
             CAST(count(*) FILTER (WHERE label = 0 AND prediction = 1) AS DOUBLE) AS c01,
             CAST(count(*) FILTER (WHERE label = 1 AND prediction = 0) AS DOUBLE) AS c10,
             CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) AS DOUBLE) AS c11 FROM lp),
k AS (SELECT c00 AS tp0, c00 + c10 AS pred0, c00 + c01 AS true0,
             c11 AS tp1, c01 + c11 AS pred1, c10 + c11 AS true1, c00 + c01 + c10 + c11 AS total FROM c),
m AS (SELECT *, CASE WHEN pred0 > 0 THEN tp0 / pred0 ELSE 0.0::DOUBLE END AS p0,
                CASE WHEN true0 > 0 THEN tp0 / true0 ELSE 0.0::DOUBLE END AS r0,
                CASE WHEN pred1 > 0 THEN tp1 / pred1 ELSE 0.0::DOUBLE END AS p1,
                CASE WHEN true1 > 0 THEN tp1 / true1 ELSE 0.0::DOUBLE END AS r1 FROM k),
f AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2.0::DOUBLE * p0 * r0 / (p0 + r0) ELSE 0.0::DOUBLE END AS f0,
                CASE WHEN p1 + r1 > 0 THEN 2.0::DOUBLE * p1 * r1 / (p1 + r1) ELSE 0.0::DOUBLE END AS f1 FROM m)
SELECT '0' AS row_label, round(p0, 9) AS precision, round(r0, 9) AS recall, round(f0, 9) AS f1_score,
       CAST(true0 AS BIGINT) AS support FROM f
UNION ALL SELECT '1', round(p1, 9), round(r1, 9), round(f1, 9), CAST(true1 AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', NULL, NULL,
                 round(CASE WHEN total > 0 THEN (tp0 + tp1) / total ELSE 0.0::DOUBLE END, 9),
                 CAST(total AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2.0::DOUBLE, 9), round((r0 + r1) / 2.0::DOUBLE, 9),
                 round((f0 + f1) / 2.0::DOUBLE, 9), CAST(total AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg',
                 round(CASE WHEN total > 0 THEN (p0 * true0 + p1 * true1) / total ELSE 0.0::DOUBLE END, 9),
                 round(CASE WHEN total > 0 THEN (r0 * true0 + r1 * true1) / total ELSE 0.0::DOUBLE END, 9),
                 round(CASE WHEN total > 0 THEN (f0 * true0 + f1 * true1) / total ELSE 0.0::DOUBLE END, 9),
                 CAST(total AS BIGINT) FROM f"""

# --- model data --------------------------------------------------------------

SQL["rule_label"] = f"""
WITH f AS (SELECT l_orderkey, l_linenumber, l_discount * 1000.0::DOUBLE AS rain_feature,
                  CASE WHEN l_linenumber <> 6 THEN l_quantity * 1.2::DOUBLE END AS wind_feature, l_tax * 12.5::DOUBLE AS nlp_risk_score,
                  l_extendedprice AS quantidade_estimada FROM lineitem)
SELECT *, {label_case()} AS target_is_delayed FROM f"""


def _synth_cte() -> str:
    cols = []
    for j, name in enumerate(S.MODEL_FEATURES):
        lo, hi = S.SYNTH_RANGES[name]
        cols.append(f"{float(lo)!r}::DOUBLE + {float(hi - lo)!r}::DOUBLE * {uniform('o_orderkey', j)} AS {name}")
    return "synth AS (SELECT o_orderkey, " + ", ".join(cols) + " FROM orders)"


SQL["synth_features"] = f"WITH {_synth_cte()} SELECT *, {label_case()} AS target_is_delayed FROM synth"

SQL["split_stratified"] = f"""WITH {_synth_cte()},
lab AS (SELECT {label_case()} AS target_is_delayed, {uniform('o_orderkey', 97)} AS u FROM synth),
r AS (SELECT *, row_number() OVER (PARTITION BY target_is_delayed ORDER BY u) AS k,
             count(*) OVER (PARTITION BY target_is_delayed) AS n FROM lab)
SELECT CASE WHEN k <= ceil(n * {S.TEST_FRACTION}::DOUBLE) THEN 'test' ELSE 'train' END AS side, target_is_delayed,
       CAST(count(*) AS BIGINT) AS rows FROM r GROUP BY 1, 2"""

SQL["split_hash"] = f"""WITH {_synth_cte()},
lab AS (SELECT *, {label_case()} AS target_is_delayed,
               CASE WHEN {uniform('o_orderkey', 97)} < {S.TEST_FRACTION}::DOUBLE THEN 'test' ELSE 'train' END AS side
        FROM synth)
SELECT side, CAST(count(*) AS BIGINT) AS rows, CAST(sum(target_is_delayed) AS BIGINT) AS positives
FROM lab GROUP BY side"""

# --- line-up pages, streams, cycle -------------------------------------------

SQL["lineup_pages"] = f"""WITH {RAW_TEXT},
n AS (SELECT *, COALESCE(imo, '') AS cell, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM raw)
SELECT {key_hash('o_custkey', 'k', RUN_TEXT)} AS lineup_id, * FROM (
  SELECT o_custkey, k, {LINEUP_FIELDS} FROM (SELECT * REPLACE (cell AS imo) FROM n))"""
SQL["lineup_pages"] = f"SELECT * EXCLUDE (o_custkey, k) FROM ({SQL['lineup_pages']})"
SQL["stream_lineup"] = SQL["lineup_pages"]

SQL["stream_weather"] = SQL["weather_csv_roundtrip"]

SQL["stream_latest"] = f"""WITH {WEATHER}
SELECT CAST(loc_id AS VARCHAR) AS loc_id, timestamp_leitura, precipitacao_mm, velocidade_vento,
       alerta_critico, event_id
FROM weather
QUALIFY row_number() OVER (PARTITION BY loc_id ORDER BY timestamp_leitura DESC NULLS LAST, event_id DESC) = 1"""

SQL["stream_dedup"] = f"""WITH {WEATHER}
SELECT event_id, CASE WHEN event_id % 50 <> 7 THEN CAST(loc_id AS VARCHAR) END AS loc_id, timestamp_leitura,
       precipitacao_mm, velocidade_vento, umidade, alerta_critico
FROM weather WHERE event_id % 50 <> 9
UNION ALL SELECT DISTINCT NULL, CAST(loc_id AS VARCHAR), NULL::TIMESTAMP, NULL, NULL, NULL, NULL
FROM weather WHERE event_id % 50 = 9"""

SQL["stream_contingency"] = _contingency_sql("CASE WHEN page_id % 40 <> 3 THEN CAST(page_id AS VARCHAR) END")

SQL["run_cycle"] = f"""WITH {WEATHER_RAW}
SELECT 'fato_clima' AS table_name, loc_id AS key, at_time, amount, text FROM (
  SELECT CAST(loc_id AS VARCHAR) AS loc_id, date_trunc('second', ts) AS at_time, {NORMALIZE}, precipitacao_mm AS amount,
         CAST(alerta_critico AS VARCHAR) AS text FROM weather_raw)
UNION ALL SELECT 'fato_lineup', lineup_id, data_atracacao_prevista, quantidade_estimada, terminal
FROM ({SQL['lineup_pages']})
UNION ALL SELECT 'fato_contingencias_nlp', cont_id, timestamp_leitura, score_risco, texto_original
FROM ({SQL['contingency_score']})"""

REPEATED = WEATHER + """,
twice AS (SELECT *, TIMESTAMP '2024-02-01 00:00:00' AS inserido_em FROM weather
          UNION ALL SELECT * REPLACE (precipitacao_mm + 1.0::DOUBLE AS precipitacao_mm), TIMESTAMP '2024-02-02 00:00:00'
          FROM weather)"""

SQL["dashboard_ships_sql"] = f"""WITH {REPEATED},
l AS (SELECT CAST(o_orderkey AS VARCHAR) AS lineup_id, CAST(o_custkey AS VARCHAR) AS ship_id, o_orderpriority AS terminal,
             TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(o_orderkey % 29 AS INTEGER)) AS inserido_em FROM orders),
w AS (SELECT timestamp_leitura AS wts, precipitacao_mm AS rain_feature, velocidade_vento AS wind_feature FROM twice
      WHERE event_id % 3 = 0 AND inserido_em = TIMESTAMP '2024-02-02 00:00:00'),
n AS (SELECT ts AS nts, value / 500.0::DOUBLE AS score FROM events),
top AS (SELECT * FROM l WHERE ship_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY ship_id ORDER BY inserido_em DESC, lineup_id DESC) = 1),
lw AS (SELECT top.*, rain_feature, wind_feature FROM top ASOF LEFT JOIN w ON top.inserido_em >= w.wts)
SELECT lw.*, COALESCE(score, 0.0::DOUBLE) AS nlp_risk_score, {local_text('lw.inserido_em')} AS data_formatada
FROM lw ASOF LEFT JOIN n ON lw.inserido_em >= n.nts"""

SQL["dashboard_nlp_sql"] = """
SELECT event_type AS texto_original, value / 500.0::DOUBLE AS score_risco, ts AS timestamp_leitura
FROM events ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC LIMIT 1"""

SQL["dashboard_map_sql"] = f"""WITH {REPEATED}, {CUSTOMER_DIM.strip()},
latest AS (
  SELECT CAST(loc_id AS VARCHAR) AS loc_id, precipitacao_mm, velocidade_vento, alerta_critico
  FROM twice
  QUALIFY row_number() OVER (PARTITION BY loc_id ORDER BY timestamp_leitura DESC NULLS LAST, inserido_em DESC) = 1)
SELECT d.loc_id, d.nome_ponto,
       TRY_CAST(NULLIF(regexp_extract(d.coordenadas, {q(POINT)}, 2), '') AS DOUBLE) AS lat,
       TRY_CAST(NULLIF(regexp_extract(d.coordenadas, {q(POINT)}, 1), '') AS DOUBLE) AS lon,
       d.tipo_ponto, l.precipitacao_mm, l.velocidade_vento, l.alerta_critico
FROM dim d LEFT JOIN latest l ON d.loc_id = l.loc_id"""

# --- the forest --------------------------------------------------------------

SQL["forest_walk"] = """SELECT count(DISTINCT o_custkey) AS ships, 0::BIGINT AS other_probability, 0::BIGINT AS other_class
FROM orders"""

SQL["risk_surface_check"] = """WITH latest AS (SELECT * FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1)
SELECT o_orderpriority AS terminal, 145001::BIGINT * 101 * 51 AS settings, count(*) AS ships, 0::BIGINT AS other_probability
FROM latest GROUP BY o_orderpriority"""
