"""What tables are about, told from their names and columns: sign-ins, health, comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Expressions on names of tables and columns.
LOGIN_TABLE = "(?i)login|logon|sign[- ]?in|session|access log|device information|devices?$|security|push notification"
NOT_LOGIN = "(?i)purchase|transaction|billing|payment|order|subscription|refund|store "
AGENT, DEVICE = "(?i)user agent|browser|client name", "(?i)device name|device type|device model|^model$|platform|os version|hardware"
ADDRESS, TIME = r"(?i)ip address|\bip\b", "(?i)time|date|last seen|when|created"
IDENTIFIER = r"(?i)\bid\b|uuid|guid|udid|serial|token|hash"
HEALTH = {
    "heart": r"(?i)heart[ _]?rate|\bbpm\b|pulse", "steps": r"(?i)step[ _]?count|\bsteps\b|pedometer", "sleep": "(?i)sleep", "weight": "(?i)weight|body composition",
    "oxygen": "(?i)oxygen|spo2", "stress": "(?i)stress", "exercise": "(?i)exercise|workout",
}
COMMENT_TEXT = r"(?i)comment text|^comment$|^text$|^body$"
#: What a column that is no identifier speaks for, and which sets of evidence make sign-ins of a table;
#: `named` is a table named for them.
SPEAKS_FOR = {"agent": AGENT, "device": DEVICE, "address": ADDRESS, "time": TIME}
ENOUGH = [("agent", "time"), ("agent", "address"), ("named", "address"), ("named", "device", "time")]


def _any(columns: Column, pattern: str) -> Column:
    return F.exists(columns, lambda c: c.rlike(pattern))


def topics(tables: DataFrame) -> DataFrame:
    """tables(table_id, source, name, columns array<string>) with logins, comments (booleans) and health (a
    kind or null). A kind goes by the table's name, then by its columns; columns alone only count
    in sources that have a table named for health, so the first pass is over sources."""
    name, cols = F.col("name"), F.col("columns")
    plain = F.filter(cols, lambda c: ~c.rlike(IDENTIFIER))
    evidence = F.array(F.when(name.rlike(LOGIN_TABLE), "named"), *(F.when(_any(plain, p), k) for k, p in SPEAKS_FOR.items()))
    met = F.exists(F.array(*(F.array(*map(F.lit, need)) for need in ENOUGH)), lambda need: F.size(F.array_except(need, F.col("_evidence"))) == 0)
    logins = met & ~name.rlike(NOT_LOGIN)
    by_name = F.coalesce(*(F.when(name.rlike(p), F.lit(k)) for k, p in HEALTH.items()))
    by_column = F.coalesce(*(F.when(_any(cols, p), F.lit(k)) for k, p in HEALTH.items()))
    told = tables.withColumns({"_by_name": by_name, "_by_column": by_column, "_evidence": evidence})
    healthy = told.groupBy("source").agg(F.bool_or(F.col("_by_name").isNotNull()).alias("_healthy"))
    health = F.coalesce("_by_name", F.when(F.col("_healthy"), F.col("_by_column")))
    return told.join(healthy, "source", "left").withColumns({"logins": logins, "health": health, "comments": _any(cols, COMMENT_TEXT)}).drop("_by_name", "_by_column", "_healthy", "_evidence")


def claims(read: list[DataFrame]) -> DataFrame:
    """The paths that any of the views reads."""
    out = read[0].select("path")
    for r in read[1:]:
        out = out.unionByName(r.select("path"))
    return out.distinct()


def key_values(objects: DataFrame, doc: str = "content") -> DataFrame:
    """An object as rows (path, field, value); nested objects give dotted fields of two levels."""
    top = objects.select("path", F.explode(F.try_variant_get(F.try_parse_json(doc), "$", "map<string,variant>")).alias("field", "v"))
    inner = F.try_variant_get("v", F.lit("$"), "map<string,variant>")
    flat = top.where(inner.isNull()).select("path", "field", "v")
    nested = top.where(inner.isNotNull()).select("path", "field", F.explode(inner).alias("k", "w")).select("path", F.concat_ws(".", "field", "k").alias("field"), F.col("w").alias("v"))
    text = F.coalesce(F.try_variant_get("v", F.lit("$"), "string"), F.to_json("v"))
    return flat.unionByName(nested).select("path", "field", text.alias("value"))
