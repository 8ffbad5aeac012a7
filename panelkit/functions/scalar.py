"""Scalar column functions (JVM-side built-ins only; no Python UDFs).

Covers ISO-prefix dates, calendar parts, safe casts, NaN handling, guarded
ratios and logs, significant-digit rounding and the small string helpers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso_prefix_date(c) -> Column:
    """First 10 characters of an ISO timestamp string as DATE (NULL if bad)."""
    return F.substring(col(c).cast("string"), 1, 10).try_cast("date")


def as_date(c) -> Column:
    """Timestamp/TIMESTAMP_NTZ/date column to DATE."""
    return F.to_date(col(c))


def iso_weekday(d) -> Column:
    """Monday=1 .. Sunday=7."""
    return F.weekday(col(d)) + F.lit(1)


def calendar_columns(d) -> dict[str, Column]:
    """year, month, weekday (Mon=1), is_weekend, year_month, month_label."""
    d = col(d)
    wd = iso_weekday(d)
    return {
        "year": F.year(d),
        "month": F.month(d),
        "weekday": wd,
        "is_weekend": (wd >= 6).cast("int"),
        "year_month": F.date_format(d, "yyyy-MM"),
        "month_label": F.date_format(d, "MMM"),
    }


def safe_double(c) -> Column:
    """Text or number to DOUBLE: bad text -> NULL, NaN -> NULL."""
    x = col(c).try_cast("double")
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def safe_int(c) -> Column:
    """Truncating integer cast that never throws (via double)."""
    return safe_double(c).try_cast("int")


def safe_bool_int(c) -> Column:
    """TRUE/True/T/1 -> 1, FALSE/False/F/0 -> 0, else NULL."""
    s = F.upper(F.trim(col(c).cast("string")))
    return (F.when(s.isin("TRUE", "T", "1"), F.lit(1))
            .when(s.isin("FALSE", "F", "0"), F.lit(0)))


def nan_to_null(c) -> Column:
    x = col(c)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def guarded_ratio(num, den) -> Column:
    """num/den, NULL unless the denominator is present and > 0."""
    d = col(den)
    return F.when(d.isNotNull() & (d > 0), F.try_divide(col(num), d))


def safe_log(c) -> Column:
    """Natural log, NULL for x <= 0 or NULL."""
    x = col(c)
    return F.when(x > 0, F.ln(x))


def signif(c, digits: int) -> Column:
    """Round to ``digits`` significant digits (0 stays 0)."""
    x = col(c)
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def split_last_underscore(c) -> tuple[Column, Column]:
    """'kWh_total_mean' -> ('kWh_total', 'mean')."""
    pat = r"^(.*)_([^_]+)$"
    return F.regexp_extract(col(c), pat, 1), F.regexp_extract(col(c), pat, 2)


def safe_name(c) -> Column:
    """Make a label usable as a column name: non-word characters -> '_'."""
    return F.regexp_replace(col(c), r"[^A-Za-z0-9_]", "_")


def band(c, cuts: list[tuple[float, str]], top: str) -> Column:
    """case_when banding on ``x >= cut`` thresholds, tested in the given order."""
    x = col(c)
    out = None
    for cut, label in cuts:
        out = F.when(x >= cut, F.lit(label)) if out is None else out.when(x >= cut, F.lit(label))
    return out.otherwise(F.lit(top)) if out is not None else F.lit(top)


def recode(c, mapping: dict, default=None) -> Column:
    """Replace labels via an explicit mapping; unmapped values kept (or default)."""
    x = col(c)
    out = None
    for k, v in mapping.items():
        out = F.when(x == k, F.lit(v)) if out is None else out.when(x == k, F.lit(v))
    fallback = x if default is None else F.lit(default)
    return out.otherwise(fallback) if out is not None else fallback


# --- fixed values: rational approximation of the normal quantile (Acklam) ---
_PROBIT_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
             1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_PROBIT_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
             6.680131188771972e+01, -1.328068155288572e+01)
_PROBIT_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
             -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_PROBIT_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
             3.754408661907416e+00)
_PROBIT_LOW = 0.02425
# --- end fixed values ---


def _horner(coefs, x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def probit(p) -> Column:
    """Standard normal quantile as a column expression (relative error
    ~1e-9), so QQ plots need no Python UDF."""
    p = col(p)
    q = p - 0.5
    r = q * q
    central = _horner(_PROBIT_A, r) * q / (_horner(_PROBIT_B, r) * r + 1)
    ql = F.sqrt(-2 * F.ln(p))
    low = _horner(_PROBIT_C, ql) / (_horner(_PROBIT_D, ql) * ql + 1)
    qu = F.sqrt(-2 * F.ln(1 - p))
    high = -_horner(_PROBIT_C, qu) / (_horner(_PROBIT_D, qu) * qu + 1)
    return (F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
            .when(p < _PROBIT_LOW, low).when(p > 1 - _PROBIT_LOW, high).otherwise(central))
