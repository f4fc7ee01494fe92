from __future__ import annotations

import random
import unicodedata
from pathlib import Path

import pytest

from millrace.llm import canonical, mixing, tokens

DOCS = "doc_id long, text string"


def found(spark, rows):
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as form", "2 as raw_hash", "3 as a")
    return {tuple(r) for r in canonical.pairs(df).collect()}


@pytest.mark.parametrize(
    "a, b",
    [
        ("Café au lait", "Café au lait"), ("Ｐｏｒｔ １２", "Port 12"), ("a b", "a b"), ("a b　c", "a b c"), ("soft­ware", "software"), ("﻿x y", "x y"),
        ("раy scale", "pay scale"), ("Οffice", "Office"), ("оﬃce", "office"), ("a\r\nb\rc d", "a\nb\nc\nd"), ("end  \n\n", "end"), ("x  \ny", "x\ny"), ("ﾎﾟｽﾄ ﾃﾞｰﾀ", "ポスト データ"),
        ("co‑op", "co-op"), ("µ Ω", "μ Ω"), ("q̣̇", "q̣̇"), ("ﬁle", "file"), ("йод", "йод"),
    ],
)
def test_texts_that_print_alike(spark, a, b):
    assert found(spark, [(2, a), (1, b)]) == {(1, 2)}


@pytest.mark.parametrize("a, b", [("é", "e"), ("A", "a"), ("m²", "m2"), ("½", "1/2"), ("™", "TM"), ("a b", "ab"), ("a–b", "a-b"), ("й", "и"), ("", " "), ("​", "﻿"), ("a\nb", "a b")])
def test_texts_that_print_differently(spark, a, b):
    assert found(spark, [(1, a), (2, b)]) == set()


def test_copies_nulls_and_empty_tables(spark):
    rows = [(1, "x y"), (2, "x y"), (3, "x y"), (3, "x y"), (4, None), (5, ""), (None, "x  y"), (None, "x y"), (6, "z" * 300_000), (7, "z" * 300_000 + "​")]
    assert found(spark, rows) == {(1, 2), (1, 3), (6, 7)}
    assert found(spark, []) == set()


def test_forms_are_equal_and_stable(spark):
    mapper = canonical.Mapper(canonical.rules(canonical.look_alikes(spark)))
    rnd = random.Random(5)
    signs = "ab рс̧́ﬁ１ｶﾞ\r\n é한Ωµ"
    for _ in range(300):
        t = "".join(rnd.choice(signs) for _ in range(rnd.randrange(12)))
        once = mapper([t])[0]
        assert mapper([once])[0] == once and unicodedata.is_normalized("NFC", once)
    assert mapper(["Город Москва pаy"])[0] == "Город Москва pay" and mapper(["Ωμέγα νόμος vаn"])[0] == "Ωμέγα νόμος van"


def test_order_and_composition_agree_with_the_standard():
    mapper = canonical.Mapper(canonical.rules({}, {}))
    rnd = random.Random(6)
    pool = [chr(c) for c in range(0xA0, 0x30000) if unicodedata.category(chr(c))[0] in "LM"]
    marks = [c for c in pool if unicodedata.combining(c)]
    composed = [c for c in pool if unicodedata.decomposition(c)]
    jamo = [chr(c) for c in (*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3))]
    texts = ["".join(rnd.choice(rnd.choice((pool, marks, composed, jamo, "aeoucAEOUC"))) for _ in range(rnd.randrange(25))) for _ in range(3000)]
    texts += ["", "\u0301", "a", "\u0301\u0327", "가각", "각"]
    assert mapper(texts) == [unicodedata.normalize("NFC", t).rstrip() for t in texts]


def test_look_alike_letters_come_from_a_table(spark):
    alike = canonical.look_alikes(spark)
    assert len(alike) > 120 and {alike[c] for c in "аΑՕᎠꓮ"} == {"a", "A", "O", "D"} and not set("жЖλéñä") & set(alike)
    assert all(a not in "αγ" and len(b) == 1 and b.isascii() for a, b in alike.items())


def test_classes_of_forms(spark):
    rows = [(5, "pay scale"), (3, "раy scale"), (4, "pay scale"), (9, "other"), (8, None), (7, " "), (None, "other"), (9, "other")]
    got = sorted(tuple(r) for r in canonical.classes(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(3, 3, 2), (4, 3, 2), (5, 3, 2), (9, 9, 1), (9, 9, 1)]
    assert canonical.classes(spark.createDataFrame([], DOCS)).count() == 0


needs_files = pytest.mark.skipif(not Path(tokens.DEFAULT_FOLDER).is_dir(), reason="no vocabularies here")


@needs_files
@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_transducer_agrees_with_plain_merging(name):
    tiktoken = pytest.importorskip("tiktoken")
    mine = tokens.encoder(name=name)
    other = tiktoken.Encoding("own", pat_str=mine_pattern(), mergeable_ranks=tokens.load_ranks(name=name), special_tokens={})
    rnd = random.Random(1)
    texts = ["", " ", "<|endoftext|>", "a" * 4000, " " * 500 + "x", "don't WE'LL 12345", "日本語テスト हिन्दी 🚀🚀", "=-" * 700]
    texts += ["".join(rnd.choice("aaeeinst é日क 12\n.-'") for _ in range(rnd.randrange(1, 80))) for _ in range(600)]
    for t in texts:
        ids = mine.encode(t)
        assert ids == other.encode_ordinary(t)
        assert mine.decode(ids) == t


def mine_pattern():
    return tokens._pattern(tokens.DEFAULT_FOLDER, tokens.DEFAULT_NAME)


@needs_files
def test_encoding_of_a_table(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (None, "x"), (1, "hello world")], DOCS).selectExpr("*", "1 as ids", "2 as k", "3 as t")
    got = sorted((tuple(r) for r in tokens.encode(df).collect()), key=str)
    assert sorted((k is None, k or 0, len(i)) for k, i in got) == [(False, 1, 2), (False, 1, 2), (False, 2, 0), (False, 3, 0), (True, 0, 1)]
    marked = {r["doc_id"]: r["ids"] for r in tokens.encode(df, null_ids=(50256,)).collect()}
    assert marked[2] == [50256] and marked[3] == []
    assert tokens.encode(df.limit(0)).count() == 0


@needs_files
def test_streamed_decoding_holds_back_parts_of_a_sign():
    coder = tokens.encoder()
    ids = coder.encode("क🚀é")
    assert "".join(coder.decode_stream(iter(ids))) == "क🚀é" and "�" not in list(coder.decode_stream(ids))
    assert coder.decode(ids[:-1]).endswith("�") or coder.decode(ids[:-1]) == "क🚀"


def test_quotas_fill_up_and_keep_caps():
    plan = {q.source: q.quota for q in mixing.quotas({"a": 1000, "b": 1000, "c": 10}, [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("d", 0.1, 9), (None, 0.5, 1)], 1000)}
    assert plan["c"] == 40 and plan["d"] == 0 and plan["a"] == 600 and plan["b"] == 360
    assert {q.source: q.quota for q in mixing.quotas({}, [("a", 1.0, 1)])} == {"a": 0}


@needs_files
def test_mix(spark):
    rows = [(i, "word " * (5 + i % 7), "big" if i % 3 else "small") for i in range(900)] + [(None, "nothing", None), (901, None, "big"), (902, "", "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as slot", "2 as block", "3 as quota")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, targets, block_tokens=64).cache()
    assert mixed.groupBy("source", "doc_id").count().filter("(source = 'big' and count > 1) or count > 3").count() == 0
    reached = {r["source"]: r for r in mixing.shares(mixed, targets).collect()}
    assert abs(reached["big"]["share"] - 5 / 9) < 0.01 and reached["none"]["tokens"] == 0
    early = {r[0]: r[1] for r in mixed.filter("slot <= 20").groupBy("source").sum("n_tokens").collect()}
    assert abs(early["big"] / sum(early.values()) - 5 / 9) < 0.12
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [{"a": 3429, "b_small": 1, "c": 2570}, {"a": 4179, "b_small": 3, "c": 4818}, {"a": 1}, {"a": 8, "b": 8}, {"a": 1, "b": 2, "c": 1, "d": 29}])
def test_every_block_has_one_slot(spark, blocks):
    plan = [mixing.Quota(s, 0.0, 1, b * 16, b * 16 - 1) for s, b in blocks.items()]
    rows = mixing.schedule(spark, plan, 16).collect()
    assert sorted((r["source"], r["block"]) for r in rows) == [(s, k) for s in sorted(blocks) for k in range(blocks[s])]
    assert len({r["slot"] for r in rows}) == len(rows)


def test_a_small_source_beside_a_million_blocks_loses_none(spark):
    sizes = {"a": 1_000_000, "b": 4, "c": 300_007}
    rows = mixing.schedule(spark, [mixing.Quota(s, 0.0, 1, b * 16, b * 16) for s, b in sizes.items()], 16).cache()
    got = {r["source"]: (r["n"], r["d"], r["hi"]) for r in rows.groupBy("source").agg({"*": "count"}).withColumnRenamed("count(1)", "n").join(
        rows.groupBy("source").agg({"block": "max"}).withColumnRenamed("max(block)", "hi"), "source").join(
        rows.select("source", "block").distinct().groupBy("source").count().withColumnRenamed("count", "d"), "source").collect()}
    assert got == {s: (b, b, b - 1) for s, b in sizes.items()}
    early = {r[0]: r[1] for r in rows.filter("slot < 13000").groupBy("source").count().collect()}
    assert abs(early["c"] / sum(early.values()) - 300_007 / 1_300_011) < 0.002


@needs_files
def test_the_mix_does_not_depend_on_where_rows_lie(spark):
    rows = [(i if i % 11 else None, "word " * (1 + i % 9) + str(i % 50), "ab"[i % 2]) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.7, 3), ("b", 0.3, 1)], "source string, target_share double, max_repeats int")
    got = [sorted(map(str, mixing.mix(d, targets, block_tokens=128).collect())) for d in (df.coalesce(1), df.repartition(7), df.orderBy("text"))]
    assert got[0] == got[1] == got[2] and len(got[0]) > 600


@needs_files
def test_a_source_of_one_block_is_in_the_mix(spark):
    sizes = {"a": 3429, "b_small": 1, "c": 2570}
    rows = [(f"{s}{i}", "word word word word", s) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    targets = spark.createDataFrame([(s, float(n), 1) for s, n in sizes.items()], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, targets, block_tokens=len(tokens.encoder().encode("word word word word"))).cache()
    each = mixed.groupBy().max("n_tokens").first()[0]
    plan = mixing.quotas({s: n * each for s, n in sizes.items()}, [(s, float(n), 1) for s, n in sizes.items()])
    reached = {r["source"]: r["tokens"] for r in mixing.shares(mixed, targets).collect()}
    assert all(q.quota <= reached[q.source] < q.quota + each for q in plan) and reached["b_small"] == each
