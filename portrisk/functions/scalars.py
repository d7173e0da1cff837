"""Column -> Column functions.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen; none is a Python UDF.  Raw text is parsed with ``try_*`` functions:
ANSI mode stays on, and a bad cell becomes NULL (or the documented default)
instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

ColumnOrName = Column | str


def _c(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


def nan_to_null(col: ColumnOrName) -> Column:
    """NaN -> NULL for a double column (pandas treats NaN as missing)."""
    return F.nanvl(_c(col).cast("double"), F.lit(None).cast("double"))


def fill_zero(col: ColumnOrName) -> Column:
    """NULL or NaN -> 0.0."""
    return F.coalesce(nan_to_null(col), F.lit(0.0))


def critical_alert(rain: ColumnOrName, wind: ColumnOrName,
                   rain_gt: float = S.ALERT_RAIN_MM,
                   wind_gt: float = S.ALERT_WIND_KMH) -> Column:
    """``rain > rain_gt OR wind > wind_gt``; a NULL/NaN term is false, never NULL."""
    r = F.coalesce(nan_to_null(rain) > F.lit(rain_gt), F.lit(False))
    w = F.coalesce(nan_to_null(wind) > F.lit(wind_gt), F.lit(False))
    return r | w


NUMBER_PATTERN = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"


def parse_br_number(col: ColumnOrName) -> Column:
    """Brazilian number text -> double; drop '.', ',' -> '.', anything but a number -> 0.

    The text must look like a number before the cast, which would also take '10D' or '5f'.
    """
    text = F.trim(_c(col).cast("string"))
    cleaned = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    number = F.when(cleaned.rlike(NUMBER_PATTERN), cleaned.try_cast("double"))
    return F.coalesce(number, F.lit(0.0))


def parse_dayfirst(col: ColumnOrName, formats: Sequence[str] = tuple(S.DAYFIRST_FORMATS)) -> Column:
    """Day-first date/time text -> timestamp; text no format accepts -> NULL.

    Day, month and year may be divided by '/', '-' or '.'; a two-digit year from 69 on is
    of the last century, as POSIX has it.
    """
    text = F.regexp_replace(F.trim(_c(col).cast("string")),
                            r"^(\d{1,2})[-./](\d{1,2})[-./](\d{4}|\d{2})(?!\d)", "$1/$2/$3")
    text = F.regexp_replace(text, r"^(?<d>\d+/\d+/)(?<y>[0-5]\d|6[0-8])(?!\d)", "${d}20${y}")
    text = F.regexp_replace(text, r"^(?<d>\d+/\d+/)(?<y>69|[7-9]\d)(?!\d)", "${d}19${y}")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(fmt)) for fmt in formats])


def format_local(col: ColumnOrName, tz: str = S.LOCAL_TZ, fmt: str = S.LOCAL_FORMAT) -> Column:
    """T4: UTC timestamp -> wall-clock text in ``tz``."""
    return F.date_format(F.from_utc_timestamp(_c(col).cast("timestamp"), tz), fmt)


def date_text(col: ColumnOrName) -> Column:
    """``%Y-%m-%d``."""
    return F.date_format(_c(col), "yyyy-MM-dd")


def timestamp_text(col: ColumnOrName) -> Column:
    """``%Y-%m-%d %H:%M:%S``."""
    return F.date_format(_c(col), "yyyy-MM-dd HH:mm:ss")


def contains_any(col: ColumnOrName, words: Iterable[str]) -> Column:
    """T5: case-folded substring match against any word of the list."""
    low = F.lower(_c(col))
    terms = [F.contains(low, F.lit(w.lower())) for w in words]
    if not terms:
        return F.lit(False)
    out = terms[0]
    for t in terms[1:]:
        out = out | t
    return F.coalesce(out, F.lit(False))


def headline(col: ColumnOrName, n: int = S.HEADLINE_CHARS) -> Column:
    """First ``n`` characters plus '...', always (even for short text)."""
    return F.concat(F.left(_c(col), F.lit(n)), F.lit("..."))


def json_key(col: ColumnOrName, key: str, default: str | None = None) -> Column:
    """Top-level JSON key as text, ``default`` when absent."""
    value = F.get_json_object(_c(col), f"$.{key}")
    return value if default is None else F.coalesce(value, F.lit(default))


_NUM = r"([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"
POINT_PATTERN = r"(?i)^\s*POINT\s*\(\s*" + _NUM + r"\s+" + _NUM + r"\s*\)\s*$"


def point_x(col: ColumnOrName) -> Column:
    """Longitude of a WKT ``POINT(x y)``; other text -> NULL."""
    return F.nullif(F.regexp_extract(_c(col), POINT_PATTERN, 1), F.lit("")).try_cast("double")


def point_y(col: ColumnOrName) -> Column:
    """Latitude of a WKT ``POINT(x y)``; other text -> NULL."""
    return F.nullif(F.regexp_extract(_c(col), POINT_PATTERN, 2), F.lit("")).try_cast("double")


def tier(col: ColumnOrName, thresholds: Sequence[tuple[float, str]], default: str) -> Column:
    """First ``(limit, label)`` with ``value > limit``; NULL or NaN -> ``default``."""
    value = nan_to_null(col)
    out = None
    for limit, label in thresholds:
        cond = value > F.lit(limit)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def news_tier(col: ColumnOrName) -> Column:
    return tier(col, S.NEWS_TIERS, S.NEWS_TIER_DEFAULT)


def probability_tier(col: ColumnOrName) -> Column:
    return tier(col, S.PROBABILITY_TIERS, S.PROBABILITY_TIER_DEFAULT)


def weighted_risk(rain: ColumnOrName, wind: ColumnOrName, nlp: ColumnOrName,
                  weights: tuple[float, float, float] = (S.LABEL_W_RAIN, S.LABEL_W_WIND,
                                                         S.LABEL_W_NLP)) -> Column:
    """``rain*0.02 + wind*0.03 + nlp*0.4`` (left to right, as written)."""
    wr, ww, wn = weights
    return _c(rain) * F.lit(wr) + _c(wind) * F.lit(ww) + _c(nlp) * F.lit(wn)


def delay_label(rain: ColumnOrName = "rain_feature", wind: ColumnOrName = "wind_feature",
                nlp: ColumnOrName = "nlp_risk_score", wind_gt: float = S.LABEL_WIND_GT,
                rain_gt: float = S.LABEL_RAIN_GT, nlp_gt: float = S.LABEL_NLP_GT,
                weights: tuple[float, float, float] = (S.LABEL_W_RAIN, S.LABEL_W_WIND, S.LABEL_W_NLP),
                cut: float = S.LABEL_CUT) -> Column:
    """1 when any hard rule or the weighted sum fires, else 0 (int).

    A comparison with NULL or NaN is not true, so missing inputs fall through
    to 0, as in pandas.  Limits default to the original's.
    """
    r, w, n = nan_to_null(rain), nan_to_null(wind), nan_to_null(nlp)
    return (F.when(w > F.lit(wind_gt), F.lit(1))
            .when(r > F.lit(rain_gt), F.lit(1))
            .when(n > F.lit(nlp_gt), F.lit(1))
            .when(weighted_risk(r, w, n, weights) > F.lit(cut), F.lit(1))
            .otherwise(F.lit(0)))


_FORMATS = {
    ".1f": "%.1f", ".0f": "%.0f", ".2f": "%.2f",
    ".1f mm": "%.1f mm", ".0f%": "%.0f%%", ".1f%": "%.1f%%",
}


def fmt(col: ColumnOrName, pattern: str) -> Column:
    """Presentation text.  ``.2%``/``.1%`` scale by 100 like Python's ``%`` format."""
    if pattern.endswith("%") and pattern[:-1] in (".0", ".1", ".2"):
        digits = pattern[1:-1]
        return F.format_string(f"%.{digits}f%%", _c(col) * F.lit(100.0))
    return F.format_string(_FORMATS.get(pattern, pattern), _c(col))


def row_hash_id(*cols: ColumnOrName) -> Column:
    """P8 with keys: SHA-256 over the keys, stable across retries.

    Each key is written with its length ('N' for NULL), so different keys never give
    the same text, whatever they hold.
    """
    def part(c: ColumnOrName) -> Column:
        text = _c(c).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("N"))
    return F.sha2(F.concat(*[part(c) for c in cols]), 256)
