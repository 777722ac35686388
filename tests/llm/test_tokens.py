"""Problems 6, 7 and 8: encoding, token budget, packing."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from benchloom.llm import bpe, p6_budget, p7_encode, p8_pack

pytestmark = pytest.mark.skipif(not os.path.exists(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabulary")
NAME = "byte_bpe_50k"


def public(text):
    """Ids by the public library."""
    import tiktoken

    if "public" not in vars(public):
        public.public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.ranks(f"{bpe.TOKENIZERS}/{NAME}.tiktoken"), special_tokens={})
    return public.public.encode_ordinary(text)


@pytest.fixture(scope="module")
def merge():
    return public


def test_transducer_is_a_minimal_dictionary():
    words = {b"tap": [1], b"taps": [2, 3], b"top": [4], b"tops": [5, 6], b"": [7]}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    for w, ids in words.items():
        assert np.frombuffer(lexicon.get(w), np.int32).tolist() == ids
    assert all(lexicon.get(w) is None for w in (b"t", b"ta", b"topss", b"x"))
    assert len(lexicon) == len(words)
    assert len(lexicon.first) - 1 == 5  # the endings ap(s) and op(s) are shared: root, t, a/o, p, s


TRICKY = " \n\t\r'strevmld_aé²½Ⅷ一二三的，。0 9٣\x1c\x1d\x85 　\xa0<|endoftext|>"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(TRICKY), st.characters(exclude_categories=["Cs", "Cn"]))))
def test_encoder_equals_reference(text):
    encoder = bpe.Encoder(bpe.Lexicon(bpe.build_lexicon(["the cat the cat 一二"] * 3, NAME, bpe.TOKENIZERS)), bpe.merger(NAME, bpe.TOKENIZERS), recent=50)
    assert np.frombuffer(encoder.ids(text), np.int32).tolist() == public(text)
    assert encoder.count(text) == len(public(text))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=0x3400, max_codepoint=0x9FFF), min_size=2, max_size=30), st.text(alphabet="abcé ", max_size=200))
def test_borders_and_merges_are_exact(chinese, other):
    merge = bpe.merger(NAME, bpe.TOKENIZERS)
    parts = bpe.parts_of(chinese, merge.units)
    assert "".join(parts) == chinese
    assert [i for p in parts for i in merge(p.encode())] == merge(chinese.encode()).tolist() == public(chinese)
    word = "".join(other.split()) * 2
    if word:
        assert merge(word.encode()).tolist() == merge._long([bytes([b]) for b in word.encode()]).tolist()
    assert len(parts) >= len(chinese) // 4 or len(chinese) < 8


def test_chinese_documents_use_the_lexicon():
    text = "催化剂的温度为一百度，压力为二百帕。" * 3
    encoder = bpe.Encoder(bpe.Lexicon(bpe.build_lexicon([text] * 2, NAME, bpe.TOKENIZERS)), bpe.merger(NAME, bpe.TOKENIZERS))
    assert all(encoder.lexicon.get(p.encode()) for w in bpe.pretokens(text) for p in bpe.parts_of(w, bpe.merger(NAME, bpe.TOKENIZERS).units))
    assert np.frombuffer(encoder.ids(text), np.int32).tolist() == public(text)


def test_encode_rows(spark, merge):
    rows = [(1, "The catalyst"), (2, ""), (3, None), (4, "a <|endoftext|> b"), (4, "a <|endoftext|> b"), (5, "x" * 50_000 + " 温度" * 2_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in p7_encode.encode(df).collect())
    assert got == sorted((k, merge(t) if t else []) for k, t in rows)
    assert p7_encode.encode(df.limit(0)).collect() == []
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(f"{bpe.TOKENIZERS}/{NAME}.json")
    whole.encode_special_tokens = True
    for _, t in rows[:5]:
        assert whole.encode(t or "", add_special_tokens=False).ids == (merge(t) if t else [])


def test_chunks_keep_tokens(spark, merge):
    texts = ["word's end, (one) two  three\n\nfour 12.5°C 温度为100℃，压力。" * 40, "nocut" * 500, "short", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    from pyspark.sql import functions as F

    for r in df.select("t", p6_budget.chunks(F.col("t"), 64).alias("c")).collect():
        assert "".join(r.c) == r.t
        assert sum(len(merge(c)) for c in r.c) == len(merge(r.t))


def test_budget(spark, merge):
    rows = [
        ("a", "en", "EPO ", "one two three", "A61K9/00|C07D1/1"),
        ("a", "en", "EPO ", "one two three", "C08L1/00"),
        ("b", "en-GB", "epo", "four", "a61k1"),
        ("c", None, None, None, None),
        (None, "en", "epo", "lost", "A61K"),
    ]
    df = spark.createDataFrame(rows, "id string, language string, source string, context string, ipc_codes string")
    got = {(r.language, r.source, r.domain): (r.n_documents, r.n_tokens) for r in p6_budget.token_budget(df).collect()}
    assert got == {("en", "epo", "A61K"): (2, len(merge("one two three")) + 1), ("und", "", None): (1, 0)}
    assert p6_budget.token_budget(df.limit(0)).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=60), st.integers(1, 5), st.integers(100, 400))
def test_best_fit_respects_every_capacity(sizes, most, cost):
    sizes = sorted(sizes, reverse=True)
    for kw in ({}, {"max_items": most}, {"max_cost": max(cost, 400)}):
        bins = p8_pack.best_fit(sizes, 20, **kw)
        for b in set(bins):
            held = [s for s, x in zip(sizes, bins) if x == b]
            assert sum(held) <= 20
            assert len(held) <= kw.get("max_items", 20) or not kw
            assert sum(s * s for s in held) <= kw.get("max_cost", 400)
    plain = p8_pack.best_fit([s for s in sizes if s], 20)
    if plain:
        assert len(set(plain)) <= 11 / 9 * max(1, -(-sum(sizes) // 20)) * 1.5 + 1


def test_best_fit_takes_the_smallest_norm_under_the_default_limits():
    assert p8_pack.best_fit([0] * 50, 20) == [0] * 20 + [1] * 20 + [2] * 10  # no more texts than tokens
    sizes = sorted((i * i % 41 for i in range(200)), reverse=True)
    held, ties = [], 0
    for size, chosen in zip(sizes, p8_pack.best_fit(sizes, 50)):
        norms = {}
        for b, h in enumerate(held):
            new = [*h, size]
            left = (1 - sum(new) / 50, 1 - len(new) / 50, 1 - sum(s * s for s in new) / 2500)
            if min(left) >= 0:
                norms[b] = sum(w * x * x for w, x in zip(p8_pack.WEIGHTS, left))
        if norms:
            ties += len(norms) > 1
            assert norms[chosen] == pytest.approx(min(norms.values()))
        else:
            assert chosen == len(held)
            held.append([])
        held[chosen].append(size)
    assert ties > 20


def test_every_limit_binds(spark):
    containers = spark.createDataFrame([("short", 512, "x")], "container_type string, capacity_tokens int, tokenizer string")
    sizes = spark.range(400).selectExpr("id AS doc_id", "CASE WHEN id < 200 THEN 5 WHEN id < 300 THEN 170 ELSE 400 END AS n_tokens")
    rows = p8_pack.pack_limited(sizes, containers).collect()
    held = {}
    for r in rows:
        held.setdefault(r.container_id, []).append(r.n_tokens)
    limit = p8_pack.limited_cost(512)
    assert len(rows) == 400 and all(sum(h) <= 512 and len(h) <= p8_pack.LIMITED_ITEMS for h in held.values())
    assert all(len(h) == 1 for h in held.values() if 400 in h)  # over the limit alone
    assert all(sum(x * x for x in h) <= limit for h in held.values() if len(h) > 1)
    assert max(map(len, held.values())) == p8_pack.LIMITED_ITEMS and any(sum(h) > 505 for h in held.values())
    got = p8_pack.limited_summary(spark.createDataFrame(rows), containers).first()
    assert got.n_containers == len(held) >= max(got.least_by_tokens, got.least_by_documents, got.least_by_cost)


def test_pack_rows(spark):
    sizes = spark.createDataFrame([(1, 1300), (2, 400), (3, 112), (4, 0), (5, 512), (5, 512)], "doc_id bigint, n_tokens bigint")
    containers = spark.createDataFrame([("short", 512, "x"), ("long", 2048, "x"), ("short", 512, "x")], "container_type string, capacity_tokens int, tokenizer string")
    rows = p8_pack.pack(sizes, containers).collect()
    for kind, cap in (("short", 512), ("long", 2048)):
        of = [r for r in rows if r.container_type == kind]
        fill = {}
        for r in of:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        assert max(fill.values()) <= cap and sum(fill.values()) == 2324
        assert len({(r.doc_id, r.piece) for r in of}) == len(of)
        assert all(sum(r.doc_id == d for r in of) == 1 for d in (2, 3, 4, 5))
    assert len({r.container_id for r in rows if r.container_type == "short"}) == 5
    assert p8_pack.pack(sizes.limit(0), containers).collect() == []
    many = spark.range(3000).selectExpr("id AS doc_id", "pmod(id * 37, 300) + 1 AS n_tokens")
    grouped = p8_pack.pack(many, containers.where("container_type = 'short'"), group=400)
    assert grouped.count() == 3000
    total = many.selectExpr("sum(n_tokens)").first()[0]
    assert grouped.select("container_id").distinct().count() <= 1.02 * -(-total // 512) + 1
