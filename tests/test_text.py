"""Trimming, types, tags, dictionaries, selection: literal cases and random ones against sequential code."""

import random
import unicodedata

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kotoba.functions import text as t
from kotoba.functions import unicode as u
from kotoba.functions.stopwords import STOPWORDS, remove_stopwords
from kotoba.operators import dictionary as d
from kotoba.operators import features
from kotoba.schema import POS_LABELS, UnknownLabel, parse_label, postags

BMES = [
    ("", [], []), ("東", [0], ["東"]), ("東", [1], ["東"]), ("東", [2], ["東"]), ("東", [3], ["東"]), ("東京", [0, 3], ["東", "京"]),
    ("東京", [1, 3], ["東", "京"]), ("東京", [0, 1], ["東京"]), ("東京", [4, 5], ["東京"]), ("東京へ", [0, 2, 3], ["東京", "へ"]),
    ("東京へ", [0, 3, 1], ["東", "京", "へ"]), ("あいうえお", [0, 1, 3, 0, 1], ["あい", "う", "えお"]), ("a\0b", [0, 1, 2], ["a\0b"]),
]


def test_spaces_are_those_of_the_language():
    assert len(t.SPACES) == 29 and all(c.isspace() for c in t.SPACES)
    assert {chr(c) for c in range(0x110000) if chr(c).isspace()} == set(t.SPACES)


def test_assemble(spark):
    df = spark.createDataFrame([(x, tags) for x, tags, _ in BMES], "text string, tags array<int>").select("text", "tags", t.chars("text").alias("c"))
    assert [r.w for r in df.select(t.assemble(F.col("c"), F.col("tags")).alias("w")).collect()] == [w for _, _, w in BMES]


PREPROCESS = [("テスト  \t ", "テスト"), ("a b", "a　b"), ("İstanbul", "Istanbul"), ("①②③", "123"), ("ﾊﾝｶｸ", "ハンカク"), ("ｶﾞ", "ガ"), ("　", ""), ("", ""), ("\x1c\x1f", "")]
LOWER = [("ΑΣ", "ας"), ("ΣΑ", "σα"), ("ΑΣB", "ασb"), ("Σ", "σ"), ("ΑΣ.", "ας."), ("ΑΣ'", "ας'"), ("İA", "ia"), ("İ ΑΣ", "i ας")]


def test_preprocess_and_lower(spark):
    df = spark.createDataFrame([(a,) for a, _ in PREPROCESS] + [(None,)], "text string")
    assert [r[0] for r in df.select(u.preprocess("text")).collect()] == [b for _, b in PREPROCESS] + [None]
    df = spark.createDataFrame([(a,) for a, _ in LOWER], "text string")
    assert [r[0] for r in df.select(u.lower("text")).collect()] == [b for _, b in LOWER]


def test_native_trim_equals_normalize_where_nfkc_changes_nothing(spark):
    texts = ["a b ", "İ x\t\n", "東京　", "", "   "]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    assert [r[0] for r in df.select(t.map_spaces(t.strip_end("text"))).collect()] == [u.normalize(x) for x in texts]


def test_char_type(spark):
    cases = {"あ": 0, "ア": 1, "漢": 2, "a": 3, "7": 4, "。": 5, "　": 5, "ー": 5, "𠮷": 5, "ァ": 1, "ヺ": 1, "ヽ": 5}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert [r[0] for r in df.select(t.char_type(F.col("c"))).collect()] == list(cases.values())


def test_alnum():
    assert all(map(u.alnum, ["猫", "Python", "123", "½", "\U00011f02"]))
    assert not any(map(u.alnum, ["", " ", "abc_", "ᾳ", "🙂", "ͅ", "Ᲊ", chr(0x2EBF0)]))


def test_interpreter_is_known():
    u.check_version()
    with pytest.raises(RuntimeError):
        u.check_version("1.0.0")
    assert unicodedata.normalize("NFKC", "ﷺ").count(" ") == 3


def test_force_spans_literals(spark):
    def run(tags, spans):
        df = spark.createDataFrame([(tags, spans)], "tags array<int>, spans array<struct<start:int,length:int>>")
        return df.select(t.force_spans(F.col("tags"), F.col("spans"))).collect()[0][0]

    assert run([0, 3, 3, 1], [(1, 2)]) == [3, 0, 2, 0]
    assert run([1, 3, 3, 2], [(1, 2)]) == [2, 0, 2, 3]
    assert run([3] * 6, [(0, 3), (3, 3)]) == [0, 1, 2, 0, 1, 2]
    assert run([], []) == []
    assert d.force_tags([0, 3, 3, 1], [(1, 2)]) == [3, 0, 2, 0]


def test_dictionary_literals(spark):
    entries = ["", " ", "  ", "東", "Ａ ", "Ｃ＋＋", "(猫)"]
    df = spark.createDataFrame([("AC++(猫)", [1] * 7), ("東", [1])], "text string, tags array<int>")
    made = df.select(t.forced_tags(F.col("tags"), d.find_forced("text", entries)).alias("x"))
    assert [r.x for r in made.collect()] == [[3, 0, 1, 2, 0, 1, 2], [1]]
    assert d.Trie(entries).spans("AC++(猫)") == [(0, 1), (1, 3), (4, 3)]


def test_dictionary_random(spark):
    rng = random.Random(3)
    alphabet = "abＡ.京都*"
    entries = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 5))) for _ in range(12)]
    rows = [(u.normalize("".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 25)))),) for _ in range(300)]
    rows = [(x, [rng.randrange(4) for _ in x]) for (x,) in rows]
    df = spark.createDataFrame(rows, "text string, tags array<int>").select("text", "tags", d.find_spans("text", entries).alias("spans"), t.forced_tags(F.col("tags"), d.find_forced("text", entries)).alias("forced"))
    trie = d.Trie(entries)
    for r in df.collect():
        spans = trie.spans(r.text)
        assert [(s.start, s.length) for s in r.spans] == spans
        assert r.forced == d.force_tags(r.tags, spans)


def test_viterbi_native_agrees_with_the_kernel(spark):
    import numpy as np

    from kotoba.plans.nn import viterbi_batch
    from kotoba.queries import TRANSITIONS

    rng = random.Random(1)
    rows = [[[rng.randrange(-8, 8) / 8 for _ in range(6)] for _ in range(rng.randrange(0, 30))] for _ in range(40)]
    df = spark.createDataFrame([(x,) for x in rows], "e array<array<double>>")
    got = [r[0] for r in df.select(t.viterbi(F.col("e"), TRANSITIONS)).collect()]
    for emissions, path in zip(rows, got, strict=True):
        if emissions:
            assert path == viterbi_batch(np.array([emissions]), np.array([len(emissions)]), np.array(TRANSITIONS))[0]
        else:
            assert path == []


def test_labels(spark):
    assert len(POS_LABELS) == 24 and [r.label for r in postags(spark).orderBy("id").collect()] == list(POS_LABELS)
    for bad in ["", "unknown", "noun", "名次", "名詞 ", "OOV", "url"]:
        with pytest.raises(UnknownLabel):
            parse_label(bad)
        with pytest.raises(UnknownLabel):
            t.take_labels("x", [bad])
    df = spark.createDataFrame([("名詞",), ("noun",)], "label string")
    assert [r[0] for r in df.select(t.try_parse_labels(F.col("label"))).collect()] == [2, None]
    with pytest.raises(PySparkException, match="unknown POS label"):
        df.select(t.parse_labels(F.col("label"))).collect()


def test_selection(spark):
    df = spark.createDataFrame([(["猫", "が", "猫"], ["名詞", "助詞", "名詞"])], "words array<string>, postags array<string>").select(F.struct("words", "postags").alias("x"))
    row = df.select(t.drop_labels("x", ["助詞"]).alias("a"), t.take_labels("x", ["助詞"]).alias("b"), t.drop_labels("x", []).alias("c"), t.take_labels("x", []).alias("d")).collect()[0]
    assert row.a.words == ["猫", "猫"] and row.b.postags == ["助詞"] and row.c.words == ["猫", "が", "猫"] and row.d.words == []


def test_stopwords(spark):
    assert len(STOPWORDS) == 135 == len(set(STOPWORDS))
    df = spark.createDataFrame([(["これ", "猫", "です", "猫"],)], "w array<string>")
    assert df.select(remove_stopwords("w")).collect()[0][0] == ["猫", "猫"]


def test_tokens(spark):
    df = spark.createDataFrame([([" ", "a b", "　"],), (["東京", "\t"],), ([],), (None,)], "w array<string>")
    assert [r[0] for r in df.select(t.normalize_tokens(F.col("w"), strict=False)).collect()] == [["　", "a　b", "　"], None, [], None]
    with pytest.raises(PySparkException, match="token 1 is empty"):
        df.select(t.normalize_tokens(F.col("w"))).collect()


def _found(text, words, at_end):
    """(place, word) of all words of a text, the shorter ones first, by looking at each place."""
    hits = [(i + n - 1 if at_end else i, text[i : i + n]) for n in range(1, 9) for i in range(len(text) - n + 1) if text[i : i + n] in words]
    return sorted(hits, key=lambda x: (x[0], len(x[1])))


@pytest.mark.parametrize("at_end", [True, False])
@pytest.mark.parametrize("lists", [True, False])
def test_candidates_of_all_places_without_a_shuffle(spark, monkeypatch, at_end, lists):
    monkeypatch.setattr(features, "GROUP_CHARS", 7)
    rng = random.Random(at_end)
    texts = [None, "", "a", "東京都東京", "x\0𠮷𠮷", "aaaaaaaaaaaa"] + ["".join(rng.choices("ab東京𠮷", k=rng.randrange(1, 30))) for _ in range(40)]
    words = ["a", "aa", "ab", "ba", "aaaaaaaa", "aaaaaaaaa", "東京", "東京都", "京", "𠮷𠮷", "aa", "\0", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    vocabulary = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "key string, id int")
    search = features.candidate_lists if lists else features.candidates
    got = search(rows, "k", "t", vocabulary, [1, 2, 3, 8, 9], at_end)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    known = {w for w in words if w and len(w) <= 8}
    want = []
    for k, text in enumerate(texts):
        hits = _found(text or "", known, at_end)
        if lists:
            want += [(k, i, [w for p, w in hits if p == i] or ["oov"]) for i in range(len(text or ""))]
        else:
            want += [(k, i, w, len(w)) for i, w in hits]
    assert sorted(map(tuple, got.collect())) == sorted(want)
