"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns documents' columns, but for the last, which
returns the packed pieces. Each decision takes effect on what the stage before kept. A stage begins
by deleting the scratch tables of earlier ones that no DataFrame refers to any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import common, jaccard, mixing, packing, pii, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the voting rules keep.

    A null, empty or wordless text fails the base rule of 50 words and goes; very long texts count
    whole; nulls in other columns and extra columns, whatever their names, go along; repeated rows
    are judged alike and all stay or go; an empty table gives none."""
    common.sweep(spark)
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id. Near copies share 80 % of
    their five-word shingles: a replaced passage of a tenth of the words, or one word in fifty, still is
    a copy.

    Documents are told apart by id and text, so rows with one id and different texts are different
    documents, and rows with one id and one text are copies, of which one stays (equal in all else: any;
    otherwise that with the smallest hash). A null id counts as larger than any other. Documents
    without words (null or empty texts) are nobody's copy: all their rows stay. Very long texts
    count whole; extra columns go along; an empty table gives none. Only documents that may have
    to go are joined with what is decided, so most texts aren't shuffled."""
    common.sweep(spark)
    known = common.free_name(docs.columns, "_own")
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text"))
    with common.batches_of(spark, 1000):
        found = common.stash(jaccard.jaccard_components(docs.select(own.alias("doc_id"), "text"), size=5, percent=80).where("n_shingles > 0"), "found")
    per = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.first("component_id").alias("component_id"))
    # what has to go, and of what only one row stays
    doubt = common.stash(per.where("component_id <> doc_id OR rows > 1").select(F.col("doc_id").alias(known), (F.col("component_id") == F.col("doc_id")).alias("_stays")), "doubt")
    may, free = common.sieve(doubt, known)(docs.withColumn(known, own))
    free = free.unionByName(may.join(doubt, known, "left_anti"))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    twice = may.join(doubt.where("_stays").select(known), known, "left_semi")
    one = twice.groupBy(known).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*rest) if rest else F.lit(0)).alias("r"))
    return free.select(*docs.columns).unionByName(one.select("r.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the kind of it.

    Null texts stay null and empty ones empty; very long texts are read whole; repeated rows come
    out alike, each once; nulls in other columns and extra columns go along (n_chars is the new
    length); an empty table gives none."""
    common.sweep(spark)
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' target weights takes them.

    Null, empty and wordless texts have no size and aren't taken; very long ones count whole; a
    null source is a source of its own; repeated rows are documents of their own, and those that
    tie in the shuffled order follow each other; extra columns go along; an empty table gives none."""
    common.sweep(spark)
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens.

    A null or empty text is one end token; very long ones are cut into pieces; each repeated row is
    packed; ties between bins are settled by content; other columns aren't read; an empty table
    gives none."""
    common.sweep(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("best_fit_packing", packed),
]

#: SQL has neither the tokenizer nor the fitted models; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stash(stage(spark, docs, sf_dir), name)
    return docs
