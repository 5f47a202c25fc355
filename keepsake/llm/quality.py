"""Quality rules that vote: expectation-maximisation in place of all-must-pass filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .weaklabel import VoteModel, fit_votes, probability

#: Fixed values of the base rules.
SYMBOLS, LEAST_WORDS, MOST_REPEATED = r"[^#*$%&|<>]+", 50, 50

#: Prior share of good documents, for those that no rule speaks about.
BALANCE = 0.6

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_capitals", "n_distinct"]


def counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all but those called like a count, if not given) with the base counts
    and three more (n_lines, n_capitals, n_distinct), over whole texts; a null text counts as none.
    Everything stays within the row: no shuffle.

    Repeated windows: each 3-word window is a 64-bit hash of its words; sorting (hash, position)
    puts equal windows side by side, whatever a text's length, and each repeated window adds the
    words that the one before doesn't cover. Windows are only sorted where some hash repeats.

    Counts come out of a generator of one row, so filters on them aren't rewritten in terms of texts."""
    kept = [c for c in docs.columns if c not in {*COUNTS, *MORE}] if keep is None else keep
    text = common.text_of(text_col)
    own = ["_doc"]
    a = docs.select(F.struct(*kept).alias("_doc"), text.alias("_t"), F.regexp_extract_all(text, F.lit(f"({common.WORD})"), 1).alias("_w"))
    lines = F.filter(F.split("_t", "\n", -1), lambda s: s.rlike(common.WORD))
    windows = F.when(
        F.size("_w") >= 3,
        F.transform(F.slice("_w", 1, F.size("_w") - 2), lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))),
    )
    b = a.select(
        *own,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        F.length(F.regexp_replace("_t", r"[^A-ZÀ-ÖØ-Þ]+", "")).cast("long").alias("n_capitals"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        windows.alias("_h"),
    )
    c = b.select(
        "*",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"),
    ).drop("_l", "_h")
    twice = F.filter(
        "_s",
        lambda x, k: (x["h"] == F.coalesce(F.get("_s", k - 1)["h"], F.bitwise_not(x["h"]))) | (x["h"] == F.coalesce(F.get("_s", k + 1)["h"], F.bitwise_not(x["h"]))),
    )
    d = c.select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("_p")).drop("_s")
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["at"])).alias("n"), p.alias("at")),
        lambda s: s["n"],
    )
    found = F.struct(*COUNTS[:-1], F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), *MORE)
    e = d.select("_doc", F.explode(F.array(found)).alias("_c"))
    return e.select(*(F.col("_doc")[c].alias(c) for c in kept), "_c.*")


def rules() -> dict[str, Column]:
    """Each rule votes against (-1) or for (1) a document, or abstains (0). All but the last only
    know one kind of bad document and say nothing of others; the last judges the text as prose, with
    limits of its own and room to abstain between, and so ties the others' votes together."""
    c = {k: F.col(k) for k in (*COUNTS, *MORE)}
    n = F.greatest(c["n_words"], F.lit(1))
    root = F.sqrt(n)
    against = {
        "v_symbols": c["n_symbols"] * 10 > n,
        "v_capitals": (c["n_capitals"] * 10 > c["word_chars"] * 3) & (n >= 5),
        "v_windows": c["n_repeat_words"] * 100 > n * 40,
        "v_lines": (c["n_dup_lines"] >= 3) & (c["n_dup_lines"] * 2 > c["n_lines"]),
        "v_word_length": (c["word_chars"] * 2 < n * 5) | (c["word_chars"] > n * 12),
        "v_variety": (c["n_distinct"] < root * 3) & (n >= 20),
    }
    prose = (
        (n >= 20) & (c["n_symbols"] * 50 <= n) & (c["n_capitals"] * 10 <= c["word_chars"]) & (c["n_repeat_words"] * 5 <= n)
        & (c["n_distinct"] >= root * 4) & c["word_chars"].between(n * 3, n * 9) & (c["n_dup_lines"] * 3 <= c["n_lines"])
    )
    noise = (n >= 20) & (
        (c["n_symbols"] * 20 > n) | (c["n_capitals"] * 5 > c["word_chars"]) | (c["n_repeat_words"] * 2 > n)
        | (c["n_distinct"] < root * 2.5) | (c["word_chars"] > n * 14)
    )
    one = {k: F.when(bad, F.lit(-1)).otherwise(F.lit(0)) for k, bad in against.items()}
    one["v_prose"] = F.when(prose, F.lit(1)).when(noise, F.lit(-1)).otherwise(F.lit(0))
    return {k: v.cast("tinyint") for k, v in one.items()}


def start_model(voters: int) -> VoteModel:
    """A rule that speaks is mostly right."""
    return VoteModel(BALANCE, [0.9] * voters)


def verdict(counted: DataFrame, threshold: float = 0.5, iterations: int = 12) -> tuple[DataFrame, VoteModel]:
    """What counts() gives, with votes, posterior double, base_failed and kept boolean; and the model."""
    votes = rules()
    voted = counted.withColumns(votes)
    names = list(votes)
    patterns = common.stash(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "votes")
    model = fit_votes(patterns, names, start_model(len(names)), iterations, balance=BALANCE)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    scored = voted.withColumn("posterior", probability(model.score([F.col(v) for v in names]))).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)), model


def score_documents(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, iterations: int = 12) -> tuple[DataFrame, VoteModel]:
    """docs with counts, votes, posterior, base_failed and kept as columns; and the fitted model.

    base_failed: under 50 words, or over half of the words in repeated windows; such documents are
    never kept. The others are kept when their posterior reaches threshold. Rows repeat as they
    are; null texts have no words and fail; an empty table keeps the start model; a column that is
    called like an added one is replaced. Texts are read twice, for the fit and for the verdict."""
    added = {*rules(), "posterior", "base_failed", "kept"}
    return verdict(counts(docs.select(*(c for c in docs.columns if c not in added)), text_col), threshold, iterations)


def kept_documents(docs: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs that score_documents keeps, all their columns as they are. The verdict goes by the text
    alone, so counts are stored under a text's MD5 hash, without the text, and each text is counted
    once. A sieve of the hashes that go lets through most rows that stay; those few that it can't tell
    are found by their hashes, so texts aren't shuffled or stored."""
    key = F.unhex(F.md5(common.text_of(text_col))).alias("_key")
    counted = common.stash(counts(docs.select(key, F.col(text_col).alias("text")), "text", keep=["_key"]), "counts")
    told = common.stash(verdict(counted, **kw)[0].select("_key", "kept").distinct(), "verdicts")
    split = common.sieve(told.where("NOT kept"), "_key")
    in_doubt = common.stash(split(told.where("kept").select("_key"))[0], "in_doubt")
    may, free = split(docs.select(F.struct("*").alias("doc"), key))
    return free.select("doc.*").unionByName(may.join(in_doubt, "_key", "left_semi").select("doc.*"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document. The counts, small numbers, are kept between the fit
    and the verdict, so texts are read once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = common.stash(counts(docs, keep=["doc_id"]), "counts")
    scored, _ = verdict(counted)
    return scored.select("doc_id", *COUNTS, "base_failed", "kept", "posterior")
