"""Every query against its SQL, and those without SQL against plain Python."""

import hashlib

import duckdb
import pytest
from common import SF

from kotoba import queries as q
from kotoba.functions import unicode as u
from kotoba.plans.nn import candidates


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_agrees_with_sql(agree, name):
    agree(q.QUERIES[name], q.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(x for x in q.ORACLE_SQL if x.startswith("rule_")))
def test_rules_agree_with_sql_where_texts_spell_the_special_keys(spark, tmp_path, name):
    texts = ["èquepadghc et", "PAD pad. padpad", "xoovb OOV oov", "paddle the padthe thepad", "repad", None, "", "pad", "oov"]
    rows = [(i, x) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = q.QUERIES[name](spark, str(tmp_path))
    want = duck.execute(f"SELECT {', '.join(found.columns)} FROM ({q.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_every_sql_has_a_query():
    assert set(q.ORACLE_SQL) <= set(q.QUERIES)


def _texts(spark):
    return {r.doc_id: r.text for r in q.texts(spark, SF).collect()}


def _path(text):
    low, n = -1e10, 6
    score, back = [low] * n, []
    score[4] = 0.0
    for c in text:
        emit = [((ord(c) * k) % 16 - 8) / 8 for k in range(1, 7)]
        options = [[score[p] + q.TRANSITIONS[s][p] for p in range(n)] for s in range(n)]
        back.append([o.index(max(o)) for o in options])
        score = [max(o) + e for o, e in zip(options, emit, strict=True)]
    last = [score[p] + q.TRANSITIONS[5][p] for p in range(n)]
    at, path = last.index(max(last)), []
    for b in reversed(back):
        path.append(at)
        at = b[at]
    return path[::-1]


def test_viterbi_over_whole_texts(spark):
    texts = _texts(spark)
    for r in q.viterbi_decode(spark, SF).collect():
        text = texts[r.doc_id]
        if text is None:
            assert r.n is None or r.n == -1
        elif len(text) < 3000:
            assert r.md5 == hashlib.md5("".join(map(str, _path(text))).encode()).hexdigest()


def test_unicode_queries(spark):
    texts = _texts(spark)
    for r in q.preprocess_nfkc(spark, SF).collect():
        assert r.text == (None if texts[r.doc_id] is None else u.normalize(texts[r.doc_id]))
    for r in q.lower_final_sigma(spark, SF).collect():
        assert r.text == (None if texts[r.doc_id] is None else u.lower_kept(texts[r.doc_id]))


def test_candidate_order_and_isalnum(spark):
    for r in q.candidate_order(spark, SF).limit(500).collect():
        want = {ord(c) % 24 for c in r.word} or {0}
        if u.alnum(r.word):
            want = (want - {0}) | {2}
        assert set(r.ids) == want
    # what the slots of a set of eight or thirty-two give, derived by hand
    for ids, noun, want in (
        ([8, 0], False, [8, 0]), ([0, 8], False, [0, 8]), ([0, 8], True, [8, 2]), ([16, 8, 0], False, [16, 8, 0]), ([10, 2], False, [10, 2]), ([23, 1, 9], False, [1, 9, 23]),
        ([17, 9, 1], False, [17, 9, 1]), ([17, 9, 1], True, [17, 2, 9, 1]), (list(range(23, -1, -1)), False, list(range(24))),
    ):
        assert candidates(ids, noun) == want
    assert all(r.alnum == u.alnum(r.word) for r in q.isalnum(spark, SF).limit(500).collect())
