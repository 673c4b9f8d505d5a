"""Unit conversion and limit checks over a small catalogue of units."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The units that others are made of.
POUND, GRAVITY, INCH, GALLON = 0.45359237, 9.80665, 0.0254, 0.003785411784
POUND_FORCE = POUND * GRAVITY
PSI = POUND_FORCE / INCH**2
# Dimension -> spelling -> factor to the dimension's base.
UNITS = {
    "length": {
        "m": 1.0, "米": 1.0, "mm": 0.001, "毫米": 0.001, "cm": 0.01, "厘米": 0.01, "um": 1e-6, "μm": 1e-6, "微米": 1e-6, "丝": 1e-5, "km": 1000.0,
        "in": INCH, "inch": INCH, "英寸": INCH, '"': INCH, "ft": 0.3048, "英尺": 0.3048, "mil": 2.54e-5, "密耳": 2.54e-5, "thou": 2.54e-5,
    },
    "pressure": {
        "pa": 1.0, "帕": 1.0, "kpa": 1000.0, "千帕": 1000.0, "mpa": 1e6, "兆帕": 1e6, "bar": 1e5, "巴": 1e5, "mbar": 100.0,
        "psi": PSI, "psig": PSI, "lbf/in2": PSI, "磅/平方英寸": PSI, "kgf/cm2": 98066.5, "kg/cm2": 98066.5, "公斤/平方厘米": 98066.5, "公斤力/平方厘米": 98066.5,
        "atm": 101325.0, "标准大气压": 101325.0, "mh2o": 9806.65, "米水柱": 9806.65, "mwc": 9806.65, "mmhg": 133.322387415, "毫米汞柱": 133.322387415,
    },
    "flow": {
        "m3/s": 1.0, "m3/h": 1 / 3600, "立方米/小时": 1 / 3600, "立方米/时": 1 / 3600, "l/s": 0.001, "升/秒": 0.001, "l/min": 0.001 / 60, "lpm": 0.001 / 60,
        "升/分": 0.001 / 60, "升/分钟": 0.001 / 60, "l/h": 0.001 / 3600, "升/小时": 0.001 / 3600, "lh": 0.001 / 3600, "ml/h": 1e-6 / 3600, "ml/min": 1e-6 / 60,
        "gpm": GALLON / 60, "usgpm": GALLON / 60, "gal/min": GALLON / 60, "加仑/分钟": GALLON / 60,
    },
    "volume": {"m3": 1.0, "立方米": 1.0, "l": 0.001, "升": 0.001, "ml": 1e-6, "毫升": 1e-6, "gal": GALLON, "加仑": GALLON},
    "mass": {"kg": 1.0, "千克": 1.0, "公斤": 1.0, "g": 0.001, "克": 0.001, "t": 1000.0, "吨": 1000.0, "lb": POUND, "磅": POUND, "oz": POUND / 16, "盎司": POUND / 16},
    "force": {"n": 1.0, "牛": 1.0, "kn": 1000.0, "千牛": 1000.0, "dan": 10.0, "kgf": GRAVITY, "公斤力": GRAVITY, "lbf": POUND_FORCE},
    "torque": {
        "n·m": 1.0, "nm": 1.0, "n.m": 1.0, "n-m": 1.0, "牛·米": 1.0, "牛米": 1.0, "kn·m": 1000.0, "kn.m": 1000.0, "knm": 1000.0,
        "dan·m": 10.0, "dan.m": 10.0, "danm": 10.0, "dan-m": 10.0, "n·cm": 0.01, "kgf·m": GRAVITY, "kgf.m": GRAVITY, "kg·m": GRAVITY, "公斤力·米": GRAVITY,
        "kgf·cm": GRAVITY / 100, "lbf·ft": POUND_FORCE * 0.3048, "ft·lb": POUND_FORCE * 0.3048, "lb·ft": POUND_FORCE * 0.3048, "ft-lb": POUND_FORCE * 0.3048,
        "lbf-ft": POUND_FORCE * 0.3048, "英尺-磅": POUND_FORCE * 0.3048, "英尺磅": POUND_FORCE * 0.3048,
        "lbf·in": POUND_FORCE * INCH, "in·lb": POUND_FORCE * INCH, "in-lb": POUND_FORCE * INCH, "英寸-磅": POUND_FORCE * INCH,
    },
    "power": {"w": 1.0, "瓦": 1.0, "kw": 1000.0, "千瓦": 1000.0, "hp": 745.69987158227022, "英制马力": 745.69987158227022, "ps": 735.49875, "马力": 735.49875},
    "speed": {"m/s": 1.0, "米/秒": 1.0, "ft/s": 0.3048, "英尺/秒": 0.3048, "ft/min": 0.3048 / 60, "m/min": 1 / 60, "km/h": 1 / 3.6},
    "rotation": {"r/min": 1.0, "rpm": 1.0, "转/分": 1.0, "转/分钟": 1.0, "r/s": 60.0, "rad/s": 60 / (2 * math.pi)},
    "time": {"s": 1.0, "秒": 1.0, "min": 60.0, "分钟": 60.0, "h": 3600.0, "小时": 3600.0, "d": 86400.0, "天": 86400.0, "周": 604800.0},
    "share": {"%": 1.0, "‰": 0.1},
    "temperature": {
        "°c": 1.0, "c": 1.0, "摄氏度": 1.0, "degc": 1.0, "celsius": 1.0, "°f": 5 / 9, "f": 5 / 9, "华氏度": 5 / 9, "degf": 5 / 9, "fahrenheit": 5 / 9,
        "k": 1.0, "开": 1.0, "开尔文": 1.0, "kelvin": 1.0,
    },
}
# Kelvin of a scale's zero, by the scale's spellings.
ZERO = {s: 273.15 for s in ("°c", "c", "摄氏度", "degc", "celsius")} | {s: 459.67 * 5 / 9 for s in ("°f", "f", "华氏度", "degf", "fahrenheit")}


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(u, d, float(f), float(ZERO.get(u, 0.0))) for d, us in UNITS.items() for u, f in us.items()]
    return spark.createDataFrame(rows, "unit string, dim string, factor double, zero double")


def unit_key(c: Column) -> Column:
    out = F.lower(F.regexp_replace(c, r"[\s^]+", ""))
    for sign, plain in (("℃", "°c"), ("℉", "°f"), ("º", "°"), ("˚", "°"), ("²", "2"), ("³", "3"), ("*", "·"), ("×", "·"), ("µ", "μ")):
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return out


def convert(rows: DataFrame, value: str, source: str, target: str, difference: Column | None = None) -> DataFrame:
    """rows with converted and error (unknown_unit, dimension_mismatch); equal units need not be known; differences ignore zero points."""
    units = F.broadcast(catalogue(rows.sparkSession))  # a fixed list
    a = units.select(F.col("unit").alias("_u1"), F.col("dim").alias("_d1"), F.col("factor").alias("_f1"), F.col("zero").alias("_z1"))
    b = units.select(F.col("unit").alias("_u2"), F.col("dim").alias("_d2"), F.col("factor").alias("_f2"), F.col("zero").alias("_z2"))
    out = rows.join(a, unit_key(F.col(source)) == F.col("_u1"), "left").join(b, unit_key(F.col(target)) == F.col("_u2"), "left")
    shift = F.lit(True) if difference is None else ~difference
    same = unit_key(F.col(source)) == unit_key(F.col(target))
    full = F.when((F.col("_d1") == "temperature") & shift, (F.col(value) * F.col("_f1") + F.col("_z1") - F.col("_z2")) / F.col("_f2")).otherwise(F.col(value) * F.col("_f1") / F.col("_f2"))
    error = F.when(same, F.lit(None)).when(F.col("_d1").isNull() | F.col("_d2").isNull(), "unknown_unit").when(F.col("_d1") != F.col("_d2"), "dimension_mismatch")
    return out.withColumn("converted", F.when(same, F.col(value)).when(F.col("_d1") == F.col("_d2"), full)).withColumn("error", error).drop(*[f"_{c}{i}" for c in "udfz" for i in "12"])


def check_limits(value: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """verdict (above_max, below_min, at_limit, within, error) and margin to the limit that decides."""
    tol = F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs(value))
    bad = (low.isNull() & high.isNull()) | (low > high) | value.isNull()
    verdict = (
        F.when(F.coalesce(bad, F.lit(False)), "error").when(value > high + tol, "above_max").when(value < low - tol, "below_min")
        .when((F.abs(value - high) <= tol) | (F.abs(value - low) <= tol), "at_limit").otherwise("within")
    )
    margin = F.when(verdict == "above_max", value - high).when(verdict == "below_min", low - value).when(verdict == "within", F.least(high - value, value - low))
    return verdict, F.round(margin, 6)


def shown(c: Column) -> Column:
    """Four significant digits, from 1000 on one decimal, no zeros at the end, never scientific."""
    text = F.format_string("%.1f", c)
    for power in range(2, -10, -1):
        text = F.when(F.abs(c) < 10.0 ** (power + 1), F.format_string(f"%.{3 - power}f", c)).otherwise(text)
    # the smallest magnitude, set last, is tried first
    return F.when(c == 0, "0").otherwise(F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""))
