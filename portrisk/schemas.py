"""Table schemas and the fixed values the results depend on.

Schemas are recovered from the writers and readers of the original project:
weather readings (``fato_clima``), the vessel line-up (``fato_lineup``), the
news/road risk rows (``fato_contingencias_nlp``), the route dimension
(``dim_geografia_rota``) and the model frame.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------

FATO_CLIMA = T.StructType([
    T.StructField("loc_id", T.StringType()),
    T.StructField("timestamp_leitura", T.TimestampType()),
    T.StructField("precipitacao_mm", T.DoubleType()),
    T.StructField("velocidade_vento", T.DoubleType()),
    T.StructField("umidade", T.DoubleType()),
    T.StructField("alerta_critico", T.BooleanType(), nullable=False),
    T.StructField("inserido_em", T.TimestampType()),  # ingest stamp: orders re-fetched readings
])

FATO_LINEUP = T.StructType([
    T.StructField("lineup_id", T.StringType()),
    T.StructField("ship_id", T.StringType()),
    T.StructField("data_chegada_prevista", T.DateType()),
    T.StructField("data_atracacao_prevista", T.TimestampType()),
    T.StructField("status_atual", T.StringType()),
    T.StructField("terminal", T.StringType()),
    T.StructField("commodity", T.StringType()),
    T.StructField("quantidade_estimada", T.DoubleType()),
    T.StructField("inserido_em", T.TimestampType(), nullable=False),
])

FATO_CONTINGENCIAS = T.StructType([
    T.StructField("cont_id", T.StringType()),
    T.StructField("loc_id", T.StringType()),
    T.StructField("timestamp_leitura", T.TimestampType()),
    T.StructField("texto_original", T.StringType()),
    T.StructField("entidade_evento", T.StringType()),
    T.StructField("score_risco", T.DoubleType()),
    T.StructField("json_extraido", T.StringType()),
])

DIM_GEOGRAFIA = T.StructType([
    T.StructField("loc_id", T.StringType()),
    T.StructField("nome_ponto", T.StringType()),
    T.StructField("coordenadas", T.StringType()),
    T.StructField("tipo_ponto", T.StringType()),
])

# Raw weather CSV as landed per location (header row; location from the folder).
WEATHER_CSV = T.StructType([
    T.StructField("datetime", T.StringType()),
    T.StructField("precip", T.DoubleType()),
    T.StructField("windspeed", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()),
])

# Landed pages: one HTML document per row; ``kind`` says which rules apply.
PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("html", T.StringType()),
])

TABLE_SCHEMAS = {
    "fato_clima": FATO_CLIMA,
    "fato_lineup": FATO_LINEUP,
    "fato_contingencias_nlp": FATO_CONTINGENCIAS,
    "dim_geografia_rota": DIM_GEOGRAFIA,
}

# ---------------------------------------------------------------------------
# Fixed values (must equal the original project's for equal results)
# ---------------------------------------------------------------------------

# Monitored points: loc_id, display name, latitude, longitude.
DEFAULT_POINTS = [
    ("PORTO_SANTOS_CANAL", "Canal de Acesso / Porto", -23.9608, -46.3339),
    ("SERRA_ANCHIETA_IMIGRANTES", "Sistema Anchieta-Imigrantes", -23.8919, -46.4961),
    ("AREA_FUNDEIO_SANTOS", "Área de Fundeio", -24.0150, -46.3000),
]

# Weather alert: strictly above these values.
ALERT_RAIN_MM = 5.0
ALERT_WIND_KMH = 15.0

# Line-up header substrings -> output column (later keys win for one column).
LINEUP_HEADER_MAP = [
    ("Navio Ship", "nome_navio"),
    ("Cheg/Arrival d/m/y", "data_chegada_prevista"),
    ("Mercadoria Goods", "commodity"),
    ("Peso Weight", "quantidade_estimada"),
    ("Terminal", "terminal"),
    ("IMO", "ship_id"),
]
LINEUP_STATUS = "Esperado"
LINEUP_COLUMNS = [
    "lineup_id", "ship_id", "data_chegada_prevista", "data_atracacao_prevista",
    "status_atual", "terminal", "commodity", "quantidade_estimada", "inserido_em",
]
# Day-first text formats accepted for arrival dates, tried in this order.
DAYFIRST_FORMATS = [
    "d/M/yyyy HH:mm:ss", "d/M/yyyy HH:mm", "d/M/yyyy",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd",
]

# Road-page tiers (first tier that matches wins) and headline words.
ROAD_TIER_BLOCK = ["bloqueio", "interdição", "fechada", "pare e siga"]
ROAD_TIER_SLOW = ["lentidão", "congestionamento", "tráfego intenso"]
NEWS_STRIKE_WORDS = ["greve", "paralisação", "protesto", "manifestação"]
ROAD_BLOCK_WEIGHT = 0.5
ROAD_SLOW_WEIGHT = 0.2
NEWS_WEIGHT = 0.5
ROAD_BLOCK_TEXT = "Ecovias: Bloqueio detectado no SAI."
ROAD_SLOW_TEXT = "Ecovias: Tráfego lento."
NEWS_PREFIX = "G1: "
HEADLINE_CHARS = 40
HEADLINES_PER_PAGE = 5
NEWS_LINK_TAG = "a"
NEWS_LINK_CLASS = "feed-post-link"
NO_ALERT_TEXT = "Condições normais de acesso."
SCORE_CAP = 1.0
CONTINGENCY_LOC = "SANTOS_LOGISTICA_GERAL"
CONTINGENCY_ENTITY = "Sistema Anchieta-Imigrantes / Porto"
JSON_CONTINGENCY_LOC = "SANTOS_GERAL"
JSON_DEFAULT_SCORE = 0.8
JSON_EVENT_DEFAULT = "N/A"
TEXT_JOIN = " | "

# Dashboard tiers: (strictly above, label), checked top down; else the default.
NEWS_TIERS = [(0.4, "alert"), (0.0, "attention")]
NEWS_TIER_DEFAULT = "normal"
PROBABILITY_TIERS = [(0.7, "high"), (0.4, "moderate")]
PROBABILITY_TIER_DEFAULT = "safe"
LOCAL_TZ = "America/Sao_Paulo"
LOCAL_FORMAT = "dd/MM/yyyy HH:mm"
# Popup of a map point: the text before each of name, kind, rain and wind, and the end.
MAP_POPUP = ("<b>", "</b><br>Tipo: ", "<br>Chuva: ", "mm<br>Vento: ", "km/h")
MAP_MISSING = "n/d"
MAP_ALERT_STYLE = ("red", "cloud-showers-heavy")
MAP_NORMAL_STYLE = ("blue", "ship")

# Delay label rules: hard limits, then a weighted sum against a cut.
LABEL_WIND_GT = 30.0
LABEL_RAIN_GT = 25.0
LABEL_NLP_GT = 0.85
LABEL_W_RAIN = 0.02
LABEL_W_WIND = 0.03
LABEL_W_NLP = 0.4
LABEL_CUT = 0.7

# Model frame and training settings.
MODEL_FEATURES = ["rain_feature", "wind_feature", "nlp_risk_score", "quantidade_estimada"]
MODEL_LABEL = "target_is_delayed"
SYNTH_RANGES = {
    "rain_feature": (0.0, 100.0),
    "wind_feature": (0.0, 60.0),
    "nlp_risk_score": (0.0, 1.0),
    "quantidade_estimada": (10000.0, 150000.0),
}
SEED = 42
RF_TREES = 200
RF_DEPTH = 10
TEST_FRACTION = 0.2
SWEEP_BASE = {"rain_feature": 0.0, "wind_feature": 0.0,
              "nlp_risk_score": 0.0, "quantidade_estimada": 50000.0}
SWEEP_WIND_VALUES = list(range(0, 81, 5))
SCENARIO_RAIN_VALUES = list(range(0, 101, 10))
SCENARIO_WIND_VALUES = list(range(0, 51, 5))
SCENARIO_TONNAGE_VALUES = list(range(5000, 150001, 29000))
# The simulator's sliders: whole numbers from, to.
SCENARIO_SLIDERS = {"quantidade_estimada": (5000, 150000), "rain_feature": (0, 100), "wind_feature": (0, 50)}
# Levels of the registered query: they hold the slider's start value 50,000.
SCENARIO_TONNAGE_LEVELS = list(range(5000, 150001, 5000))
