"""How far sources differ in their words, by joint histograms of counts.

A pair of sources is told by how many terms have which two counts; the divergence is worked out once
for each such combination and multiplied. Cells in which a source lacks the term aren't
listed: they are what the sources' own histograms have more than the cells with both, and what
the language's terms have more than all of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Documents that a term needs, added count, scale of shares, ranks of terms.
LEAST_DOCS, ADDED, SHARE, RANKS = 10, 2, 1_000_000_000, 10
#: Terms are runs of A-Z, a-z and everything beyond ASCII: in UTF-8, of these bytes once A-Z are lower-cased.
TERM = rb"[a-z\x80-\xff]+"
#: Terms that a task remembers before it hands their counts on.
HELD = 250_000


def term_counts(docs: DataFrame, text_col: str = "text", held: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term, of every group, in as many rows
    as tasks handed on. A group also has a row with an empty term, so groups without terms are there.

    Documents are dealt by ranges of group and place: a task has few groups, so few tables of terms, and a
    large group is spread over as many tasks as it has shares of the rows."""
    place = F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id())  # not of the text: copies are spread too
    clean = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in (("lang", "lang"), ("source", "source"))), common.text_of(text_col).cast("binary").alias("text"), place.alias("place")).repartitionByRange("lang", "source", "place").drop("place")

    def count(batches):
        import re
        from collections import Counter

        import pyarrow as pa

        find = re.compile(TERM).findall
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def told():
            while groups:
                (lang, source), (n, with_) = groups.popitem()
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(n)), pa.repeat(source, len(n)), pa.array(n, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([with_[t] for t in n], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )

        size = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if (lang, source) not in groups:
                    groups[lang, source] = (Counter({b"": 0}), Counter())
                n, with_ = groups[lang, source]
                size -= len(n)
                terms = find(text.as_py().lower())
                n.update(terms)
                with_.update(set(terms))
                size += len(n)
                if size >= held:
                    yield from told()
                    size = 0
        yield from told()

    return clean.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def kept_terms(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, total, first): the terms in at least `least` documents of their language, with the
    language's count and whether the row is the term's first; empty terms stay with n 0. One shuffle
    serves the sums and the windows, which run over the sources of one term."""
    per = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = Window.partitionBy("lang", "term")
    all_ = per.select("lang", "source", "term", "n", F.sum("docs").over(of).alias("docs"), F.sum("n").over(of).alias("total"), (F.row_number().over(of.orderBy("source")) == 1).alias("first"))
    return all_.where((F.col("term") == "") | (F.col("docs") >= least)).drop("docs")


def share(n: Column, size: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (size + 2 terms)), exact."""
    over = F.lit(SHARE).cast("decimal(10,0)") * (n + ADDED).cast("decimal(19,0)")
    return F.call_function("div", over, (size + 2 * terms).cast("decimal(19,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so squares fit in a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, text_col: str = "text", least: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value long, rank int).

    Part `pair`: each other source of the language and the divergence over all kept terms. Part `term`: the
    kept terms that the source has more of than its language, ranks to `ranks`. Null lang, source
    and text count as empty; empty, wordless and very long texts are read whole; repeated rows
    are documents of their own; other columns are not read, whatever their names; equal values are
    ranked by item; a language without kept terms has pairs of value 0; an empty table gives none."""
    kept = common.stash(kept_terms(term_counts(docs, text_col), least), "terms")
    own = kept.where("term <> ''")
    langs = own.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("terms"), F.sum("n").alias("lang_size"))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("size")).join(langs, "lang", "left")
    groups = common.stash(groups.na.fill(0, ["terms", "lang_size"]), "groups")
    return _pairs(own, groups).unionByName(_terms(own, groups, ranks))


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    left = groups.select("lang", F.col("source").alias("a"), F.col("size").alias("size_a"), "terms")
    right = groups.select("lang", F.col("source").alias("b"), F.col("size").alias("size_b"))
    pairs = left.join(right, "lang").where("a < b")
    names, zero = ["lang", "a", "b"], F.lit(0).cast("long")

    def own(side: str, c: str) -> DataFrame:
        return kept.select("lang", "term", F.col("source").alias(side), F.col("n").alias(c))

    both = own("a", "x").join(own("b", "y"), ["lang", "term"]).where("a < b").groupBy(*names, "x", "y").agg(F.count(F.lit(1)).alias("m"))
    cell = lambda x, y, m: F.struct(x.alias("x"), y.alias("y"), m.alias("m"))
    x, y, m = F.col("x"), F.col("y"), F.col("m")
    # a term that both have is none that one alone has
    met = both.select(*names, F.inline(F.array(cell(x, y, m), cell(x, zero, -m), cell(zero, y, -m), cell(zero, zero, m))))
    histogram = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    listed = pairs.select(*names)
    one = histogram.select("lang", F.col("source").alias("a"), F.col("n").alias("x"), "m").join(listed, ["lang", "a"]).select(*names, F.inline(F.array(cell(x, zero, m), cell(zero, zero, -m))))
    other = histogram.select("lang", F.col("source").alias("b"), F.col("n").alias("y"), "m").join(listed, ["lang", "b"]).select(*names, F.inline(F.array(cell(zero, y, m), cell(zero, zero, -m))))
    none = pairs.where("terms > 0").select(*names, zero.alias("x"), zero.alias("y"), F.col("terms").alias("m"))
    cells = met.unionByName(one).unionByName(other).unionByName(none).groupBy(*names, "x", "y").agg(F.sum("m").alias("m")).where("m <> 0")
    value = apart(share(x, F.col("size_a"), F.col("terms")), share(y, F.col("size_b"), F.col("terms"))) * m
    summed = cells.join(pairs, names).groupBy(*names).agg(F.sum(value).alias("value"))
    told = pairs.select(*names).join(summed, names, "left").withColumn("value", F.coalesce("value", zero))
    ways = told.select("lang", F.inline(F.array(*(F.struct(F.col(s).alias("source"), F.col(i).alias("item")) for s, i in (("a", "b"), ("b", "a"))))), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return ways.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(kept: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    # many terms have the same two counts: they are judged once
    combos = kept.select("lang", "source", "n", "total").distinct().join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("size"), F.col("terms")), share(F.col("total"), F.col("lang_size"), F.col("terms"))
    judged = combos.select("lang", "source", "n", "total", p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "n", "total", apart(F.col("p"), F.col("q")).alias("value"))
    # only combinations that can hold one of the first ranks meet the terms again
    best = judged.withColumn("place", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "n", "total"))).where(F.col("place") <= ranks)
    least = best.groupBy("lang", "source").agg(F.min("value").alias("least"))
    far = judged.join(least, ["lang", "source"]).where("value >= least").drop("least")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    told = kept.select("lang", "source", F.col("term").alias("item"), "n", "total").join(far, ["lang", "source", "n", "total"])
    return told.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= ranks)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of all documents."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
tok AS (SELECT r, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM tok GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, source, sum(n) AS size FROM cnt GROUP BY ALL),
lsize AS (SELECT lang, count(*) AS v, sum(total) AS size FROM kept GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {SHARE}::HUGEINT * (coalesce(c.n, 0) + {ADDED}) // (coalesce(s.size, 0) + 2 * l.v) AS p,
    1 + {SHARE}::HUGEINT * (k.total + {ADDED}) // (l.size + 2 * l.v) AS q
  FROM grp g JOIN kept k USING (lang) JOIN lsize l USING (lang) LEFT JOIN size s USING (lang, source) LEFT JOIN cnt c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(v.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) v
  ON v.lang = a.lang AND v.source = a.source AND v.item = b.source)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', term, CAST(value AS BIGINT), rank FROM (SELECT lang, source, term, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) AS INTEGER) AS rank
  FROM (SELECT *, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q)) WHERE rank <= {RANKS}"""
