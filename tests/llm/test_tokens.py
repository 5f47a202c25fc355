"""Token shards, packing and counts against the tokenizers themselves."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keepsake.llm import common, packing, sstable, tokencount, tokens


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def bytes_():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TRICKY = ["", " ", "a.b,c..d ,e", "don't  stop\n\nnow\t", "<|endoftext|> x", "<|startoftext|>", "É é İ ß ﬁ ①", "日本語 text", "😀😀 ok", "x" * 3000, "1234567 12,34.5", "A.B.C. U.S.A.", "\u00a0nbsp\u2003em", "naïve café\r\nline", "'s 've ''", "_a_._b_", "e\u0301 combining", "...,,,", "\x00\x01ctl", "ÀÉÎ ÕÜ"]


def noisy(n=300):
    rnd = random.Random(2)
    alphabet = list("abcXYZ.,'!-_ \n\t09éßÅ") + ["the ", "<|endoftext|>", "日", "😀", "'s", "\u00a0", "don't"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoders_give_the_tokenizers_ids(name, texts):
    own, real = tokens.encoder(name), Tokenizer.from_file(public_tokenizers.path(name))
    every = [*TRICKY, *noisy(), *texts.values()]
    for t, got in zip(every, own.batch(every), strict=True):
        assert list(np.frombuffer(got, "<u2")) == real.encode(t, add_special_tokens=False).ids, t[:100]


def test_shards_hold_all_documents_in_order(spark, data, texts, words):
    want, start = {}, 0
    for i in sorted(texts):
        ids = [*words.encode(texts[i], add_special_tokens=False).ids, 1]
        want[i] = (start, len(ids), crc(ids))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in sstable.op3_token_shards(spark, data).collect()}
    assert got == want


def test_lookup_and_round_trip(spark, texts, words, docs):
    path = common.scratch_path(spark, "test")
    manifest = sstable.write_shards(docs, path, shards=3, block_bytes=512)
    some = sorted(texts)[::17]
    found = sstable.lookup(manifest, path, [*some, 10**9, -5])
    assert found == {i: [[*words.encode(texts[i], add_special_tokens=False).ids, 1]] for i in some}
    back = {r.doc_id: list(r.ids) for r in sstable.read_shards(manifest, path, with_ids=True).collect()}
    assert all(back[i] == [*words.encode(texts[i], add_special_tokens=False).ids, 1] for i in texts)


def test_string_keys_share_prefixes(spark):
    df = spark.createDataFrame([(f"https://example.org/page/{i:05d}", f"text {i}") for i in range(500)] + [(None, "none")], "doc_id string, text string")
    path = common.scratch_path(spark, "test")
    manifest = sstable.write_shards(df, path, shards=2, block_bytes=2048)
    assert list(sstable.lookup(manifest, path, ["https://example.org/page/00250", "https://example.org/page/x"])) == ["https://example.org/page/00250"]
    rows = sstable.read_shards(manifest, path, kind="string").collect()
    assert len(rows) == 501 and [r.doc_id for r in sorted(rows, key=lambda r: r.start)][:2] == [None, "https://example.org/page/00000"]


def test_shards_are_cut_by_size_and_repeated_keys_are_spread(spark, words):
    texts = [(7, f"text number {i} of one key") for i in range(400)] + [(i, f"other {i}") for i in (1, 2, 9)]
    path = common.scratch_path(spark, "test")
    manifest = sstable.write_shards(spark.createDataFrame(texts, "doc_id long, text string"), path, shards=4, block_bytes=256, shard_bytes=1024)
    parts = manifest.orderBy("shard").collect()
    assert len(parts) > 8 and len({r.shard >> 32 for r in parts}) == 4 and sum(r.n_docs for r in parts) == len(texts)
    assert all(a.last_key <= b.first_key for a, b in zip(parts, parts[1:]))
    ids = lambda t: [*words.encode(t, add_special_tokens=False).ids, 1]
    assert sorted(sstable.lookup(manifest, path, [7, 3])[7]) == sorted(ids(t) for i, t in texts if i == 7)
    rows = sorted(sstable.read_shards(manifest, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(i for i, _ in texts) and all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
    assert sorted(list(r.ids) for r in rows) == sorted(ids(t) for _, t in texts)


def test_shards_of_odd_tables(spark, odd, none):
    for df, n in ((odd, odd.count()), (none, 0)):
        path = common.scratch_path(spark, "test")
        rows = sstable.read_shards(sstable.write_shards(df, path), path).collect()
        assert len(rows) == n
        assert sum(r.n_tokens for r in rows) == (max(r.start + r.n_tokens for r in rows) if rows else 0)


def check_packing(rows, texts, tokenizer, capacity=2048):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for p, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (p, at, crc(ids[at : at + r.length]))
            assert p == 0 or r.length == capacity
            at += r.length
        assert at == len(ids) and (len(ids) > capacity or len(by_doc[i]) == 1)
    for held in by_seq.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq), sum(r.length for r in rows)


def test_packing_keeps_every_id(spark, docs, texts, bytes_):
    rows = packing.pack_documents(docs).collect()
    n, total = check_packing(rows, texts, bytes_)
    one = len(packing.best_fit([r.length for r in rows], 2048))
    assert n <= one + 1 and n >= -(-total // 2048)


def test_packing_in_rounds_is_nearly_as_tight(spark, docs):
    items = packing.pieces(docs)
    rows = packing.pack(items, items_per_part=30, fan_in=2, carry=16).collect()
    one = len(packing.best_fit([r.length for r in rows], 2048))
    assert len({r.sequence_id for r in rows}) <= one * 1.03 + 2
    assert len(rows) == items.count()


def test_packing_odd_tables(spark, odd, none, bytes_):
    rows = packing.pack_documents(odd.drop("piece", "length")).collect()
    assert sum(r.doc_id == 1 for r in rows) == 2 and any(r.doc_id is None for r in rows)
    assert sorted(r.length for r in rows if r.doc_id in (3, 4)) == [1, 1]
    assert packing.pack_documents(none).count() == 0
    assert len(packing.pack_documents(odd).collect()) == len(rows)


def test_best_fit_takes_the_tightest_bin():
    assert packing.best_fit([5, 5, 4, 3, 3], 10) == [[0, 1], [2, 3, 4]]
    assert packing.best_fit([], 10) == [] and packing.best_fit([10, 10], 10) == [[0], [1]]


def unigram(pieces, unk):
    from tokenizers import models, pre_tokenizers

    t = Tokenizer(models.Unigram(pieces, unk, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_counts_are_the_tokenizers(spark, texts):
    pieces, unk = tokencount.vocabulary()
    real, own = unigram(pieces, unk), tokencount.Counter(pieces)
    every = [t for t in [*TRICKY, *noisy(), *texts.values()]]
    want = [len(e.ids) for e in real.encode_batch(every, add_special_tokens=False)]
    for t, a, b in zip(every, own.batch(every), want, strict=True):
        assert a == b, (t[:80], a, b)


def test_counts_with_ties(spark):
    rnd = random.Random(8)
    for trial in range(60):
        pieces = [("<unk>", 0.0), ("▁", -2.0)] + [(p, -float(rnd.randint(1, 3))) for p in {"".join(rnd.choice("ab▁") for _ in range(rnd.randint(1, 4))) for _ in range(14)}]
        real, own = unigram_plain(pieces), tokencount.Counter(pieces)
        for _ in range(30):
            t = "".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 14)))
            assert own.batch([t]) == [len(real.encode(t).ids)], (trial, pieces, t)


def unigram_plain(pieces):
    from tokenizers import models, pre_tokenizers

    t = Tokenizer(models.Unigram(pieces, 0))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_counts_of_odd_tables(odd, none):
    rows = tokencount.count_tokens(odd).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}
    assert tokencount.count_tokens(none).count() == 0
