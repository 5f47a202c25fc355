"""Source divergence against plain Python and SQL."""

import re
from collections import Counter, defaultdict

from compare import of_duck, of_spark

from keepsake.llm import divergence
from keepsake.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least=10, ranks=10):
    by, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
        groups[lang].add(source)
        by[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        terms = [t for t, n in df[lang].items() if n >= least]
        size = {s: sum(by[lang, s][t] for t in terms) for s in sources}
        share = lambda n, total: 1 + 10**9 * (n + 2) // (total + 2 * len(terms))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        whole = sum(size.values())
        for s in sources:
            values = [(sum(f(share(by[lang, s][t], size[s]), share(by[lang, o][t], size[o])) for t in terms), o) for o in sources - {s}]
            out += [(lang, s, "pair", o, v, i) for i, (v, o) in enumerate(sorted(values, key=lambda x: (-x[0], x[1].encode())), 1)]
            own = []
            for t in terms:
                if n := by[lang, s][t]:
                    p, q = share(n, size[s]), share(sum(by[lang, o][t] for o in sources), whole)
                    own += [(f(p, q), t)] * (p > q)
            out += [(lang, s, "term", t, v, i) for i, (v, t) in enumerate(sorted(own, key=lambda x: (-x[0], x[1].encode()))[:ranks], 1)]
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_query_gives_rows_of_sql(spark, duck, data):
    assert of_spark(QUERIES["op13_source_divergence"](spark, data)) == of_duck(duck, ORACLES["op13_source_divergence"])


def test_query_as_plain(spark, data, docs):
    assert rows(QUERIES["op13_source_divergence"](spark, data)) == plain([(r.text, r.lang, r.source) for r in docs.select("text", "lang", "source").collect()])


def test_odd_rows_as_plain(spark, odd, none):
    for least in (1, 2, 10):
        assert rows(divergence.divergence(odd, least=least)) == plain([(r.text, r.lang, r.source) for r in odd.collect()], least)
    assert rows(divergence.divergence(none)) == []


def test_full_task_tables_lose_nothing(spark, docs):
    """Counts are the same when a task hands them on after every few terms."""
    summed = lambda held: rows(divergence.term_counts(docs, held=held).groupBy("lang", "source", "term").sum("n", "docs"))
    assert divergence.term_counts(docs, held=50).count() > divergence.term_counts(docs).count() and summed(50) == summed(100_000)


def test_counts_beyond_a_billion_are_exact(spark):
    from pyspark.sql import functions as F

    n, size, terms = 123_456_789_012_345, 987_654_321_098_765, 77_777_777
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(size), F.lit(terms)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 2) // (size + 2 * terms)
