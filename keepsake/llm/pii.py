"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation
estimates how far each can be trusted, and a span classifier is trained on the outcome.

All of it is DataFrame operations. Base spans (the contract's expressions and checks) always
stay; looser expressions propose further candidates, and the classifier decides on those.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, spans
from .weaklabel import VoteModel, fit_votes, probability

#: Kinds in the order of the contract, and its expressions.
KINDS = ["email", "ip", "card", "phone"]
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    # A run that failed at its first character fails at its later ones: only run starts are tried.
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Proposals beyond the base.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{2,}+)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{2,4}(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
#: Gazetteers: common top-level domains; issuer prefixes of cards.
DOMAINS = r"(?i)(?:\.|dot[\])]?\x20?)(?:com|org|net|edu|gov|info|io|biz|de|fr|es|it|nl|uk|eu|ch|at|us|ca|example|test)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|22|4[4-9]|5)|35|30|36|38)"
#: Context: words before a span that speak for its kind, or against any.
CUES = {
    "email": r"(?i)(?:mail|contact|write\x20to|reach|address|from|to)\W*$",
    "ip": r"(?i)(?:ip|addr|address|host|server|client|from|login)\W*$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|payment|pan)\W*(?:no|number|nr)?\W*$",
    "phone": r"(?i)(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|dial)\W*$",
}
AGAINST = r"(?i)(?:version|isbn|issn|order|sha|md5|hash|invoice|section|page|figure|build|release|id)\W*(?:no|number|nr)?\W*$"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_PARTS = rf"^{BYTE}(?:\.{BYTE}){{3}}$"

VOTERS = ["v_check", "v_gazetteer", "v_cue", "v_edge", "v_shape"]
FEATURES = ["f_length", "f_before", "f_after", "f_digits", "f_marks"]
#: A first guess at the labelers, on which the iterations improve.
BALANCE = 0.5
START = VoteModel(BALANCE, [0.9, 0.75, 0.9, 0.7, 0.75])


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(IP_PARTS)
    d = spans.digits(m)
    if kind == "card":
        return F.length(d).between(14, 19) & F.call_function("luhn_check", d)
    return F.length(d).between(10, 15) if kind == "phone" else F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, F.lit(-1)).when(yes, F.lit(1)).otherwise(F.lit(0)).cast("tinyint")


def _votes(kind: str, m: Column, left: Column, right: Column, base: bool) -> list[Column]:
    d = spans.digits(m)
    n = F.length(m)
    never = F.lit(False)
    checked = {"email": F.lit(base), "ip": F.lit(base), "card": F.length(d).between(14, 19) & F.call_function("luhn_check", d), "phone": F.length(d).between(10, 15)}[kind]
    known = {
        "email": m.rlike(DOMAINS),
        "ip": m.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.") if base else m.rlike("^(?i:[23][0-9a-f]{3}|f[cdef][0-9a-f]{2}):"),
        "card": d.rlike(ISSUERS),
        "phone": m.rlike(r"^\+") | d.rlike("^[2-9]"),
    }[kind]
    usual = {"email": n.between(6, 60), "ip": n.between(7, 39), "card": F.length(d).between(15, 16), "phone": F.length(d).between(10, 13)}[kind]
    glued = left.rlike("[A-Za-z0-9_]$") | right.rlike("^[A-Za-z0-9_]")
    return [
        _vote(checked, ~checked if kind == "card" else never),
        _vote(known, ~known),
        _vote(left.rlike(CUES[kind]), left.rlike(AGAINST)),
        _vote(~glued, glued),
        _vote(usual, ~usual),
    ]


def _side(c: Column) -> Column:
    return F.when(c == "", "none").when(c.rlike(r"[A-Za-z]"), "letter").when(c.rlike("[0-9]"), "digit").when(c.rlike(r"\s"), "space").otherwise("mark")


def _features(kind: str, m: Column, left: Column, right: Column) -> list[Column]:
    d = F.length(spans.digits(m))
    return [
        F.concat(F.lit(f"{kind} length "), F.least(F.length(m), F.lit(40)).cast("string")),
        F.concat(F.lit(f"{kind} before "), _side(F.right(left, F.lit(1)))),
        F.concat(F.lit(f"{kind} after "), _side(right)),
        F.concat(F.lit(f"{kind} digits "), F.least(d, F.lit(20)).cast("string")),
        F.concat(F.lit(f"{kind} marks "), F.least(F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), F.lit(8)).cast("string")),
    ]


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _spans: base spans and proposals (s, kind, e, base, votes, features) of whole texts."""
    any_digit = F.col("_t").rlike("[0-9]")
    where = {"email": F.col("_t").contains("@"), "ip": any_digit, "card": any_digit, "phone": F.col("_t").contains("+")}
    where2 = {"email": F.col("_t").contains("dot") & F.col("_t").rlike(r"[\x20\[(]at\x20?[\])\x20]"), "ip": F.col("_t").rlike("[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"), "card": any_digit, "phone": any_digit}
    names = [f"_{x}_{k}" for x in ("base", "loose") for k in KINDS]
    read = docs.select("*", common.text_of(text_col).alias("_t"))
    found = read.select(
        "*",
        *(spans.find("_t", BASE[k], where[k]).alias(f"_base_{k}") for k in KINDS),
        *(spans.find("_t", LOOSE[k], where2[k]).alias(f"_loose_{k}") for k in KINDS),
    ).drop("_t")

    def described(base: bool, k: str) -> Column:
        col = f"_{'base' if base else 'loose'}_{k}"
        chosen = spans.kept(F.col(col), lambda x: _passes(k, x["m"]) if base or k == "card" else F.lit(True))
        return F.transform(
            chosen,
            lambda x: F.struct(
                x["s"].alias("s"),
                F.lit(KINDS.index(k)).alias("kind"),
                x["e"].alias("e"),
                F.lit(base).alias("base"),
                F.array(*_votes(k, x["m"], x["left"], x["right"], base)).alias("votes"),
                F.array(*_features(k, x["m"], x["left"], x["right"])).alias("features"),
            ),
        )

    nothing = F.array().cast("array<struct<s:int,kind:int,e:int,base:boolean,votes:array<tinyint>,features:array<string>>>")
    some = F.greatest(*(F.size(F.coalesce(F.col(n), F.array())) for n in names)) > 0
    both = found.select("*", F.when(some, F.concat(*(described(True, k) for k in KINDS))).otherwise(nothing).alias("_b"), F.when(some, F.concat(*(described(False, k) for k in KINDS))).otherwise(nothing).alias("_p")).drop(*names)
    return both.withColumn("_spans", F.concat("_b", spans.free_of(F.col("_p"), F.col("_b")))).drop("_b", "_p")


@dataclass
class SpanModel:
    votes: VoteModel
    prior: float
    weights: dict[str, float]


def fit_spans(found: DataFrame, iterations: int = 15, smooth: float = 1.0) -> SpanModel:
    """Votes are counted by pattern, at most 3 ** 5 rows; expectation-maximisation runs on those. The
    classifier is naive Bayes over the features and votes of all spans, each weighed by its
    posterior: one aggregation, whose result has a row for each feature value."""
    rows = found.select(F.explode("_spans").alias("x")).select(*(F.get("x.votes", F.lit(j)).alias(v) for j, v in enumerate(VOTERS)), "x.features")
    rows = common.stash(rows.groupBy(*VOTERS, "features").agg(F.count(F.lit(1)).alias("n")), "spans")
    patterns = common.stash(rows.groupBy(*VOTERS).agg(F.sum("n").alias("n")), "patterns")
    votes = fit_votes(patterns, VOTERS, START, iterations, balance=BALANCE)
    p = probability(votes.score([F.col(v) for v in VOTERS]))
    weighed = rows.select(F.explode(F.concat(_named_votes(F.array(*VOTERS)), "features")).alias("f"), (F.col("n") * p).alias("yes"), (F.col("n") * (1 - p)).alias("no"))
    sums = weighed.groupBy("f").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()
    yes = sum(r["yes"] for r in sums) / max(1, len(VOTERS) + len(FEATURES))
    no = sum(r["no"] for r in sums) / max(1, len(VOTERS) + len(FEATURES))
    weights = {r["f"]: math.log((r["yes"] + smooth) / (yes + 2 * smooth)) - math.log((r["no"] + smooth) / (no + 2 * smooth)) for r in sums}
    return SpanModel(votes, math.log((yes + smooth) / (no + smooth)), weights)


def _named_votes(votes: Column) -> Column:
    return F.transform(votes, lambda v, j: F.concat_ws(" ", F.lit("vote"), j.cast("string"), v.cast("string")))


def decide(found: DataFrame, model: SpanModel, threshold: float = 0.0) -> DataFrame:
    """found with _all: base spans and the proposals whose log odds reach threshold, none overlapping
    another proposal; _base: base spans. Both are arrays of (s, kind, e)."""
    table = F.create_map(*(F.lit(x) for kv in (model.weights or {"": 0.0}).items() for x in kv))
    here = found.withColumn("_base", F.filter("_spans", lambda x: x["base"]))

    def odds(x: Column) -> Column:
        return F.aggregate(F.concat(_named_votes(x["votes"]), x["features"]), F.lit(model.prior), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))

    added = spans.apart(F.filter("_spans", lambda x: ~x["base"] & (odds(x) >= threshold)))
    return here.withColumn("_base", F.transform("_base", spans.plain)).withColumn("_all", F.sort_array(F.concat("_base", added)))


def digest(decided: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns: counts of base spans, the base digest, all spans."""
    count = [spans.count("_base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return decided.select(id_col, *count, F.sha2(spans.joined(F.col("_base"), KINDS), 256).alias("base_sha256"), spans.joined(F.col("_all"), KINDS).alias("spans"))


def redacted(text: Column, found: Column) -> Column:
    """text with each of the sorted spans found (s, kind, e) replaced by its kind's name; overlapping
    spans become one replacement, named by the first."""
    name = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    state = "struct<end:int,from:int,first:boolean>"

    def replaced(xs: Column, cut) -> Column:
        # first: begins where all before have ended; from: the end of what was replaced before
        seen = spans.running(
            xs,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("from"), F.lit(False).alias("first")),
            lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), a["end"].alias("from"), (x["s"] >= a["end"]).alias("first")),
            state,
        )
        parts = lambda r: F.transform(xs, lambda x, i: F.when(F.get(r, i)["first"], F.concat(cut(F.get(r, i)["from"], x["s"]), F.get(name, x["kind"]))).otherwise(F.lit("")))
        return spans.once(seen, lambda r: F.concat(F.array_join(parts(r), ""), cut(F.element_at(r, -1)["end"], F.length(text))))

    return F.when(F.size(found) > 0, spans.once(found, lambda xs: spans.Slices(text).bind(lambda cut: replaced(xs, cut)))).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", iterations: int = 15) -> DataFrame:
    """docs with personal data replaced by <EMAIL>, <IP>, <CARD> and <PHONE> in the text, and n_chars,
    if there, set to the new length. Null texts stay null, other columns and repeated rows stay, an
    empty table gives none. Overlapping spans become one replacement, named by the first. Rows are
    stored with their candidates, so each text is searched once."""
    rest = [c for c in docs.columns if c != text_col]
    whole = docs.select(F.struct(F.lit(0).alias("row"), *rest).alias("doc"), F.col(text_col).alias("text"))
    stored = common.stash(candidates(whole), "candidates")
    found = decide(stored, fit_spans(stored, iterations))
    out = found.select("doc", redacted(F.col("text"), F.col("_all")).alias("text"))
    given = {c: F.col("text") if c == text_col else F.col("doc")[c] for c in docs.columns}
    if "n_chars" in rest:
        given["n_chars"] = F.length("text").cast(dict(docs.dtypes)["n_chars"])
    return out.select(*(v.alias(c) for c, v in given.items()))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", iterations: int = 15) -> DataFrame:
    """Per row of docs the contract's columns. Null or empty texts have no spans, very long ones are read
    whole in time that grows with their length and spans; ids may repeat or be null; other columns are not read. Candidates, small next to texts, are stored between the fit
    and the decisions, so texts are read once."""
    found = common.stash(candidates(docs.select(id_col, text_col), text_col).drop(text_col), "candidates")
    return digest(decide(found, fit_spans(found, iterations)), id_col)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
