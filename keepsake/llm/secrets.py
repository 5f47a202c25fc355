"""Secrets, with weak candidates reported only where complementary parts of a credential co-occur.

Base spans (the contract's expressions) always stay. Parts are access identifiers, secrets and
endpoints; a weak candidate is reported when, within its scope (SCOPE code points to either side,
from start to start, in the same text), there is a part of another role that shares no character
with it. Candidates are linked first; only of linked secrets that overlap does one stay, the
earliest. The interval join runs on parts, not texts: parts and candidates of a text are put in one
order, in which a running maximum by role tells the nearest complete part of each role, so the
work is that of sorting however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, spans

#: Kinds and expressions of the contract.
KEY = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = rf"""{KEY}["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{14,}+", "hex": r"(?<![0-9a-f])[0-9a-f]{16,}+"}
#: Weak candidates and parts: value assignments of 6 to 11 characters, mixed runs that may be keys,
#: identifiers and endpoints.
WEAK = {
    "weak_assign": rf"""{KEY}["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]{{6,11}}+(?![A-Za-z0-9+/_.=-])""",
    "weak_key": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+",
    "weak_id": r"""(?i:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9_.@+-]{3,}+""",
}
SCHEME = r"(?i:https?|ftp|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|redis|mongodb|amqp|s3)://"
ENDPOINT = rf"""{SCHEME}[^\s"'<>]{{4,}}+|(?i:host|endpoint|server|url)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9_.:/-]{{4,}}+"""
KINDS = [*BASE, *WEAK]
IDENTIFIER, SECRET, PLACE = 0, 1, 2
ROLE = {"assign": SECRET, "access": IDENTIFIER, "hex": SECRET, "weak_assign": SECRET, "weak_key": SECRET, "weak_id": IDENTIFIER}
SCOPE = 400


def parts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _base, _weak (arrays of (s, kind, e)) and _ends (endpoints, of (s, e)) of whole texts. Weak
    candidates overlap no base span, but may overlap each other. A URL ends with its scheme here,
    so what stands in it is beside it."""
    low = F.col("_low")
    keyed = low.rlike("password|passwd|secret|token|api_?key")
    gate = {"assign": keyed, "weak_assign": keyed, "access": F.col("_t").contains("AKIA"), "hex": F.lit(True), "weak_key": F.col("_t").rlike(r"[A-Za-z0-9+/_=-]{20}"), "weak_id": low.rlike("user|login|client|account|access"), "end": low.rlike("://|host|endpoint|server|url")}
    read = docs.select("*", common.text_of(text_col).alias("_t")).select("*", F.lower("_t").alias("_low"))
    patterns = BASE | WEAK | {"end": ENDPOINT}
    found = read.select("*", *(spans.find("_t", p, gate[k], 1).alias(f"_f_{k}") for k, p in patterns.items())).drop("_t", "_low")
    value = rf"""^{KEY}["']?\x20*[:=]\x20*["']?"""

    def listed(k: str) -> Column:
        ok = spans.kept(F.col(f"_f_{k}"), lambda x: F.length(F.regexp_replace(x["m"], value, "")) >= 12 if k == "assign" else F.lit(True))
        return F.transform(ok, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(k)).alias("kind"), x["e"].alias("e")))

    none = "array<struct<s:int,kind:int,e:int>>"
    both = found.select(
        "*",
        F.concat(*(listed(k) for k in BASE)).cast(none).alias("_base"),
        F.concat(*(listed(k) for k in WEAK)).cast(none).alias("_w"),
        F.transform(F.coalesce("_f_end", F.array().cast("array<struct<s:int,e:int,m:string,left:string,right:string>>")), lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.coalesce(F.nullif(F.length(F.regexp_extract(x["m"], f"^{SCHEME}", 0)), F.lit(0)), F.length(x["m"]))).alias("e"))).alias("_ends"),
    ).drop(*(f"_f_{k}" for k in patterns))
    return both.withColumn("_weak", F.transform(spans.free_of(F.col("_w"), F.col("_base")), spans.plain)).drop("_w")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(_row, kind, s, e) of the weak candidates that have a complementary part in scope.
    found: _row (unique), _base, _weak, _ends, in a stored table.

    Each part stands twice in a text's order, for candidates after it (way 0, at its end) and, with signs
    turned, for those before it (way 1, at its start). The greatest start so far of each role is
    that of the nearest part that the candidate doesn't overlap."""
    role = F.array(*(F.lit(ROLE[k]) for k in KINDS))
    span = lambda col: found.select("_row", F.inline(col)).select("_row", "s", "e", "kind", F.get(role, F.col("kind")).alias("role"))
    weak = span("_weak")
    parts_ = weak.unionByName(span("_base")).drop("kind").unionByName(found.select("_row", F.inline("_ends")).withColumn("role", F.lit(PLACE)))
    s, e, none = F.col("s"), F.col("e"), F.lit(None).cast("int")

    def placed(rows: DataFrame, ask: bool, after: Column, before: Column, bounds: tuple[Column, Column]) -> DataFrame:
        kind = F.col("kind") if ask else none
        ways = [F.struct(F.lit(way).alias("way"), pos.alias("pos"), bound.alias("at")) for way, pos, bound in ((0, after, bounds[0]), (1, before, bounds[1]))]
        return rows.select("_row", "s", "e", "role", kind.alias("kind"), F.lit(ask).alias("ask"), F.inline(F.array(*ways)))

    order = placed(parts_, False, e, -s, (s, -s)).unionByName(placed(weak, True, s, -e, (s - scope, -s - scope)))
    w = Window.partitionBy("_row", "way").orderBy("pos", "ask").rowsBetween(Window.unboundedPreceding, 0)
    seen = order.select("*", *(F.max(F.when(~F.col("ask") & (F.col("role") == r), F.col("at"))).over(w).alias(f"r{r}") for r in (IDENTIFIER, SECRET, PLACE)))
    met = F.lit(False)
    for r in (IDENTIFIER, SECRET, PLACE):
        met = met | ((F.col("role") != r) & F.coalesce(F.col(f"r{r}") >= F.col("at"), F.lit(False)))
    return seen.where(F.col("ask") & met).select("_row", "s", "kind", "e").distinct()


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row of docs: id, n_assign, n_access, n_hex long (base spans), base_sha256, spans.

    Null or empty texts have none; ids may repeat or be null, rows are told apart by a number of
    their own; other columns are not read; an empty table gives none. Parts are stored once, so
    texts are read once, and only parts are shuffled."""
    found = common.stash(parts(docs.select(id_col, text_col), text_col).drop(text_col).withColumn("_row", F.monotonically_increasing_id()), "parts")
    ties = linked(found, scope).groupBy("_row").agg(F.collect_list(F.struct("s", "kind", "e")).alias("_linked"))
    secret = lambda x: F.get(F.array(*(F.lit(ROLE[k] == SECRET) for k in KINDS)), x["kind"])
    settled = F.concat(F.filter("_linked", lambda x: ~secret(x)), spans.apart(F.filter("_linked", secret)))
    all_ = found.join(ties, "_row", "left").withColumn("_all", F.concat("_base", F.coalesce(settled, F.array().cast("array<struct<s:int,kind:int,e:int>>"))))
    count = [spans.count("_base", k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    return all_.select(id_col, *count, F.sha2(spans.joined(F.col("_base"), KINDS), 256).alias("base_sha256"), spans.joined(F.col("_all"), KINDS).alias("spans"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
