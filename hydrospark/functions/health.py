"""H1-H3 as column expressions over the A11 metrics (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrospark.operators.latest import rank_recommendations


def _penalty(*cases: tuple[Column, int]) -> Column:
    expr = None
    for cond, pts in cases:
        expr = F.when(cond, pts) if expr is None else expr.when(cond, pts)
    return expr.otherwise(0)


def health_score(avg_soil: Column, frequency: Column, duration: Column, stability: Column,
                 temp: Column, humidity: Column) -> Column:
    """H1: 100 minus the rule penalties, clamped to 0..100."""
    score = (F.lit(100)
             - _penalty((avg_soil > 550, 40), (avg_soil > 450, 20), (avg_soil < 250, 30))
             - _penalty((frequency < 0.5, 25), (frequency > 3, 20))
             - _penalty((duration > 300, 15), (duration < 30, 10))
             - _penalty((stability > 150, 15),)
             - _penalty(((temp > 35) | (temp < 10), 20), ((temp > 30) | (temp < 15), 10))
             - _penalty(((humidity < 30) | (humidity > 80), 15),))
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def health_status(score: Column) -> Column:
    """H2: Excellent / Good / Fair / Poor / Critical."""
    return (F.when(score >= 85, "Excellent").when(score >= 70, "Good").when(score >= 50, "Fair")
            .when(score >= 30, "Poor").otherwise("Critical"))


def _rec(priority: str, message: Column, action: str) -> Column:
    return F.struct(F.lit(priority).alias("priority"), message.alias("message"), F.lit(action).alias("action"))


def health_recommendations(avg_soil: Column, frequency: Column, duration: Column, stability: Column,
                           plant: Column) -> Column:
    """H3: rule-triggered recommendations, or one "optimal" note, ordered
    high < medium < low with a stable sort."""
    p = plant.cast("string")
    msg = lambda fmt: F.format_string(fmt, p)
    candidates = F.array(
        F.when(avg_soil > 550, _rec("high", msg("Plant %s soil is consistently dry. Increase watering frequency or duration."),
                                    "Increase watering by 30 seconds per session"))
         .when(avg_soil < 250, _rec("high", msg("Plant %s soil is too wet. Reduce watering to prevent root rot."),
                                    "Reduce watering frequency by 50%")),
        F.when(frequency < 0.5, _rec("medium", msg("Infrequent watering detected for plant %s."),
                                     "Water at least once daily"))
         .when(frequency > 2.5, _rec("medium", msg("Overwatering detected for plant %s."),
                                     "Reduce watering to twice daily maximum")),
        F.when(duration > 300, _rec("low", msg("Watering sessions for plant %s are too long."),
                                    "Reduce watering duration to 2-3 minutes max")),
        F.when(stability > 150, _rec("medium", msg("Plant %s soil moisture fluctuates too much."),
                                     "Maintain more consistent watering schedule")),
    )
    present = F.filter(candidates, lambda r: r.isNotNull())
    optimal = F.array(_rec("low", msg("All parameters are within optimal ranges for plant %s."),
                           "Continue current watering schedule"))
    return rank_recommendations(F.when(F.size(present) > 0, present).otherwise(optimal))
