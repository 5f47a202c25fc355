"""Quality counts and verdicts; the mix against its SQL."""

import re
from collections import Counter

from compare import of_duck, of_spark

from keepsake.llm import mixing, quality

WORD = r"[^\x20\x09-\x0D]+"


def counted(t):
    words = re.findall(WORD, t or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_are_those_of_a_plain_count(spark, docs, texts, odd):
    tricky = ["a b c a b c a b c", "a a a a a", "a\n\na\n a\na", "x y z\nx y z\nq", "é 😀 é 😀 é 😀", "a b c d a b c", None, ""]
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(tricky)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    want = texts | {-1 - i: t for i, t in enumerate(tricky)}
    for r in quality.counts(every).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counted(want[r.doc_id]), want[r.doc_id]


def test_verdicts_on_labelled_documents(spark, data, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    scored, model = quality.score_documents(docs)
    rows = {r.doc_id: r for r in scored.collect()}
    assert all(0.5 < a < 1 for a in model.accuracy)
    bad = [i for i, q in labels.items() if q == 0]
    good = [i for i, q in labels.items() if q == 1 and not rows[i].base_failed]
    assert sum(not rows[i].kept for i in bad) >= 0.95 * len(bad)
    assert sum(rows[i].kept for i in good) >= 0.98 * len(good)


def test_quality_odd_tables(odd, none):
    scored, _ = quality.score_documents(odd)
    rows = {r.doc_id: r for r in scored.collect()}
    assert scored.count() == odd.count() and set(odd.columns) <= set(scored.columns)
    assert not rows[3].kept and rows[3].base_failed and rows[3].n_words == 0 and not rows[9].kept and rows[9].n_repeat_words == 60_000
    assert rows[1]["class"] == "x"
    assert quality.score_documents(none)[0].count() == 0


def test_op5_is_its_sql(spark, duck, data):
    assert of_spark(mixing.op5_mix_sources(spark, data)) == of_duck(duck, mixing.OP5_SQL)


def test_mix_of_odd_tables_is_its_sql(spark, odd, none, tmp_path):
    import duckdb

    odd.select("doc_id", "text", "lang", "source", "n_chars").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = of_spark(mixing.op5_mix_sources(spark, str(tmp_path)))
    assert got == of_duck(con, mixing.OP5_SQL)
    assert mixing.mix_documents(none).count() == 0
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns


def test_mix_meets_targets_and_reruns_agree(spark, docs, data):
    one, two = mixing.op5_mix_sources(spark, data).collect(), mixing.op5_mix_sources(spark, data).collect()
    assert sorted(one) == sorted(two)
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, aim, largest = Counter(), {}, Counter()
    for r in one:
        s = source[r.doc_id]
        taken[s] += r.taken
        aim[s] = r.target
        largest[s] = max(largest[s], r["size"])
        assert r.taken <= 3 * r["size"]
    top = max(largest.values())
    assert all(abs(taken[s] - aim[s]) <= 2 * top for s in aim)
    assert abs(sum(taken.values()) - sum(r["size"] for r in one)) <= top


def test_mixed_documents_are_as_often_as_the_plan_says(spark, docs, data):
    times = Counter(r.doc_id for r in mixing.mix_documents(docs).collect())
    assert all(times[r.doc_id] * r["size"] == r.taken for r in mixing.op5_mix_sources(spark, data).collect())


def test_rows_with_one_id_that_the_cut_runs_through(spark, tmp_path):
    """Thirty rows with one id: some are taken once more than the others, as the plan says."""
    rows = [(1, "w " * 9 + f"{i % 2}", "a") for i in range(30)] + [(2, "w " * 40, "b"), (3, "w " * 40, None), (4, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    plan = Counter()
    for r in mixing.op5_mix_sources(spark, str(tmp_path)).collect():
        plan[r.doc_id] += r.taken // r["size"] if r["size"] else 0
    got = Counter(r.doc_id for r in mixing.mix_documents(df).collect())
    assert got == +plan and 0 < got[1] % 30


def test_kept_documents_are_those_scored_so(spark, docs, odd, none, monkeypatch):
    """With a sieve that tells next to nothing too, and with columns called like those that are added."""
    from keepsake.llm import common, quality

    def rows(df):
        return sorted(map(repr, df.collect()))

    want = rows(quality.score_documents(docs)[0].where("kept").select(*docs.columns))
    assert rows(quality.kept_documents(docs)) == want and 0 < len(want) < docs.count()
    extra = odd.unionByName(docs, allowMissingColumns=True).withColumnRenamed("n", "_sieve").withColumnRenamed("votes", "_may")
    told = quality.kept_documents(extra)
    assert told.columns == extra.columns and quality.kept_documents(none).count() == 0
    twice = docs.unionAll(docs)
    assert rows(quality.kept_documents(twice)) == rows(quality.score_documents(twice)[0].where("kept").select(*docs.columns))
    monkeypatch.setattr(common, "sieve", lambda keys, *cols: lambda df, *names: (df, df.where("false")))
    assert rows(quality.kept_documents(docs)) == want
