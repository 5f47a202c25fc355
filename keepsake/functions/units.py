"""Units of measures, told from what a table or column is called."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered; expression, unit, label, how its values are summed up.
UNITS = [
    (r"(?i)\bhrv\b|variability", "ms", "Heart rate variability", "mean"),
    (r"(?i)heart[ _]?rate|\bbpm\b|pulse", "bpm", "Heart rate", "mean"),
    ("(?i)weight", "kg", "Weight", "last"),
    ("(?i)height", "cm", "Height", "last"),
    (r"(?i)step[ _]?count|\bsteps\b", "steps", "Steps", "sum"),
    ("(?i)sleep", "h", "Sleep", "mean"),
    ("(?i)calorie|nutrition|food", "kcal", "Calories", "sum"),
    ("(?i)distance", "m", "Distance", "sum"),
    ("(?i)blood[ _]?pressure", "mmHg", "Blood pressure", "mean"),
    ("(?i)oxygen|spo2", "%", "Blood oxygen", "mean"),
    ("(?i)stress", "", "Stress", "mean"),
    ("(?i)respirat|breathing", "br/min", "Breathing rate", "mean"),
    ("(?i)skin[ _]?temp|temperature", "C", "Skin temperature", "mean"),
    ("(?i)floor", "floors", "Floors climbed", "sum"),
    ("(?i)water|caffeine|hydration", "", "Water", "sum"),
    ("(?i)exercise|workout|activity", "", "Exercise", "count"),
]


def unit_of(name: Column) -> Column:
    """struct(unit, label, agg) of the first rule that fits, null if none does."""
    out = F
    for pattern, unit, label, agg in UNITS:
        out = out.when(name.rlike(pattern), F.struct(F.lit(unit).alias("unit"), F.lit(label).alias("label"), F.lit(agg).alias("agg")))
    return out


def rule_of(name: Column) -> Column:
    """Place of the first rule that fits, null if none does."""
    out = F
    for i, (pattern, *_) in enumerate(UNITS):
        out = out.when(name.rlike(pattern), F.lit(i))
    return out


def rule(place: Column, part: str) -> Column:
    """A rule's unit, label or agg, by its place."""
    at = ("pattern", "unit", "label", "agg").index(part)
    return F.get(F.array(*(F.lit(u[at]) for u in UNITS)), place)


def rule_fits(place: Column, name: Column) -> Column:
    """Whether the rule at this place fits a name."""
    out = F
    for i, (pattern, *_) in enumerate(UNITS):
        out = out.when(place == i, name.rlike(pattern))
    return F.coalesce(out, F.lit(False))
