"""The pipeline's stages against plain versions of what they decide."""

import re
from collections import Counter

import pytest

import corpus_pipeline as cp
from keepsake.llm import pii, quality


@pytest.fixture(scope="module")
def stages(spark, data, docs):
    from keepsake.llm import common

    out, at = [docs], docs
    for name, stage in cp.STAGES:
        at = common.stash(stage(spark, at, data), name)
        out.append(at)
    return out


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "source_mix", "best_fit_packing"]


def test_columns_stay_but_for_the_last(stages, docs):
    assert all(s.columns == docs.columns for s in stages[:-1])


def test_quality_stage(stages):
    before, after = stages[0], stages[1]
    kept = {r.doc_id for r in quality.score_documents(before)[0].where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept and 0 < len(kept) < before.count()


def test_one_document_of_each_group_stays(stages):
    """Groups are those of five-word shingles at 0.8, as near duplicates without a contract of their own take."""
    from test_near import brute

    before, after = stages[1], stages[2]
    first = {c for _, c in brute({r.doc_id: r.text for r in before.collect()}, 80, 5).values()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(first)


def test_rows_with_one_id_and_different_texts_are_different_documents(spark, data):
    words = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(1, words("a")), (1, words("b")), (1, words("a")), (2, words("b") + " more"), (None, words("c")), (None, words("c")), (None, words("d")), (3, words("d")), (4, None), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, (r.text or "-")[0]) for r in cp.near_duplicates(spark, df, data).collect())
    assert got == {(1, "a"): 1, (1, "b"): 1, (None, "c"): 1, (3, "d"): 1, (4, "-"): 2}


def test_no_personal_data_is_left(stages):
    rows = pii.find_pii(stages[3]).collect()
    assert stages[3].count() == stages[2].count()
    assert sum(r.n_email + r.n_card + r.n_phone + r.n_ip for r in rows) == 0


def test_mix_takes_copies_of_what_is_there(stages):
    there = {r.doc_id: r.text for r in stages[3].collect()}
    times = Counter()
    for r in stages[4].collect():
        assert there[r.doc_id] == r.text
        times[r.doc_id] += 1
    assert max(times.values()) <= 3
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    whole, taken = sum(map(size, there.values())), sum(size(there[i]) * n for i, n in times.items())
    assert abs(whole - taken) <= max(map(size, there.values()))


def test_packing_holds_every_copy(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stages[4].collect())
    rows = stages[5].collect()
    assert sum(r.length for r in rows) == want
    loads = Counter()
    for r in rows:
        loads[r.sequence_id] += r.length
    assert max(loads.values()) <= 2048


def test_odd_tables_pass_every_stage(spark, odd, none, data):
    for name, stage in cp.STAGES:
        assert stage(spark, none, data).count() == 0
        got = stage(spark, odd, data)
        assert name == "best_fit_packing" or got.columns == odd.columns
        assert got.count() > 0 or name == "quality_rules"  # they are short or repeat themselves
    kept = cp.near_duplicates(spark, odd, data).collect()
    assert Counter(r.doc_id for r in kept)[1] == 1 and not any(r.doc_id in (2, 7) for r in kept) and {3, 4, 5, 6, 8, 9, None} <= {r.doc_id for r in kept}


def test_the_entry_registers_all(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if re.match(r"op\d+_", k)} and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)
