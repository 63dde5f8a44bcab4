"""Column expressions shared by the operators (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrospark.schemas import SOIL_DRY_VALUE, SOIL_WET_VALUE


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int (null counts as 0, like a SQL CASE WHEN)."""
    return F.when(cond, 1).otherwise(0)


# F3 indicators -------------------------------------------------------------

def is_dry(c: str | Column) -> Column:
    return flag(col(c) == "DRY")


def is_on(c: str | Column) -> Column:
    return flag(col(c) == "ON")


def any_pump_on(p1: str | Column = "pump1", p2: str | Column = "pump2") -> Column:
    return flag((col(p1) == "ON") | (col(p2) == "ON"))


def water_available(c: str | Column = "water") -> Column:
    return flag(col(c) == "AVAILABLE")


# F4 / F5 -------------------------------------------------------------------

def soil_value(c: str | Column) -> Column:
    """DRY -> 600, anything else (WET, null, legacy numbers) -> 300."""
    return F.when(col(c) == "DRY", SOIL_DRY_VALUE).otherwise(SOIL_WET_VALUE)


def combined_dryness(s1: str | Column = "soil1", s2: str | Column = "soil2") -> Column:
    return (is_dry(s1) + is_dry(s2)) / F.lit(2.0)


# F8 / F9 -------------------------------------------------------------------

def pump_map(c: str | Column = "pump") -> Column:
    """ON -> 1, OFF -> 0, other -> null."""
    return F.when(col(c) == "ON", 1).when(col(c) == "OFF", 0)


def plant_health_label(soil: str | Column = "soil", pump01: str | Column = "pump01") -> Column:
    """soil > 800 Poor; < 300 Overwatered; pump == 1 Good; otherwise Moderate."""
    s = col(soil)
    return (F.when(s > 800, "Poor")
            .when(s < 300, "Overwatered")
            .when(col(pump01) == 1, "Good")
            .otherwise("Moderate"))


# Enum normalisation (ingest) ------------------------------------------------

def normalize_enum(c: Column, allowed: list[str], default: str) -> Column:
    """Upper-case (no trimming) and map anything outside ``allowed`` to ``default``."""
    u = F.upper(c.cast("string"))
    return F.when(u.isin(*allowed), u).otherwise(F.lit(default))


def pct(num: Column, den: Column) -> Column:
    return num * F.lit(100.0) / den


def round_d(c: Column, digits: int) -> Column:
    """Round half away from zero on the binary value: ``round(x * 10^d) / 10^d``.

    ``F.round`` rounds the shortest decimal form of the double (9.745 -> 9.75)
    while SQL engines and Python see 9.74499.. -> 9.74; scaling first gives
    the binary-value result in both engines.
    """
    m = F.lit(float(10 ** digits))
    return F.round(c * m, 0) / m


def round_or_zero(c: Column, digits: int = 2) -> Column:
    """Python truthiness: ``round(x, d) if x else 0`` -> null and 0 both give 0."""
    return F.coalesce(round_d(c, digits), F.lit(0.0))


def truthy_or(c: Column, default) -> Column:
    """``x if x else default``: null or exactly 0 take the default."""
    return F.coalesce(F.nullif(c, F.lit(0)), F.lit(default))


def sin_cos(value: Column, period: float, name: str) -> list[Column]:
    ang = F.lit(2.0 * 3.141592653589793) * value / F.lit(float(period))
    return [F.sin(ang).alias(f"{name}_sin"), F.cos(ang).alias(f"{name}_cos")]


def dow_sunday0(ts: Column) -> Column:
    """Weekday with Sunday = 0 (strftime %w)."""
    return F.dayofweek(ts) - 1


def dow_monday0(ts: Column) -> Column:
    """Weekday with Monday = 0 (Python ``weekday()``)."""
    return F.weekday(ts)
