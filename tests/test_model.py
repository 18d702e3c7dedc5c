"""Readers, validation, the network's arithmetic, and the API on a synthetic model."""

import gzip
import hashlib
import json
import math
import pickle

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kotoba import schema as s
from kotoba.plans import nn
from kotoba.plans.api import Segmenter, Tagger
from kotoba.sources import model as m
from kotoba.sources.lines import read_cases, read_lines, write_json
from kotoba.streaming.lines import stream_json, stream_lines


@pytest.fixture(scope="module")
def net():
    return nn.synthetic(1)


@pytest.fixture(scope="module")
def model_dir(tmp_path_factory, net):
    folder = tmp_path_factory.mktemp("model")
    v = net.vocabularies
    (folder / "v.dict").write_bytes(gzip.compress(pickle.dumps([v.uni, v.bi, v.word, v.pos, v.word_tags], protocol=2)))
    body = b""
    for name, w in net.weights.items():
        text = (" ".join(repr(float(x)) for x in w.ravel()) + "\n").encode()
        body += f"#Parameter# {name} {{{','.join(map(str, w.shape[::-1]))}}} {len(text)} ZERO_GRAD\n".encode() + text
    (folder / "v.model").write_bytes(body)
    return folder


def test_vocabularies_round_trip(net, model_dir):
    got = m.read_vocabularies(model_dir / "v.dict")
    assert got == net.vocabularies


def test_pickles_cut_short_or_executable_are_rejected():
    shared = [9, 1, 2]
    data = pickle.dumps([{"oov": 0}, {"oov": 0}, {"oov": 0}, {"名詞": 2, "oov": 0}, {"one": shared, "two": shared, "three": [0]}], protocol=2)
    assert m.unpickle(data).word_tags["two"] == [9, 1, 2]
    for n in range(len(data)):
        with pytest.raises(s.PickleError):
            m.unpickle(data[:n])
    for bad in (b"\x80\x02cpos\ncode\n.", pickle.dumps(print, protocol=2), pickle.dumps([{}] * 4, protocol=2), pickle.dumps([{1: 2}, {}, {}, {}, {}], protocol=2)):
        with pytest.raises(s.PickleError):
            m.unpickle(bad)


def test_a_segmenter_needs_three_vocabularies(net, model_dir):
    v = net.vocabularies
    three = pickle.dumps([v.uni, v.bi, v.word], protocol=2)
    assert m.unpickle(three, tagger=False).word == v.word
    with pytest.raises(s.PickleError):
        m.unpickle(three)
    with pytest.raises(s.PickleError):
        m.unpickle(pickle.dumps([v.uni, v.bi], protocol=2), tagger=False)


def test_digests(model_dir):
    import hashlib

    good = hashlib.sha256((model_dir / "v.dict").read_bytes()).hexdigest()
    m.check_digest(model_dir / "v.dict", good)
    with pytest.raises(s.InvalidVocabulary):
        m.check_digest(model_dir / "v.dict", "0" * 64)


def test_weights_text_and_binary(net, model_dir, tmp_path):
    text = m.read_weights(model_dir / "v.model")
    assert all((text[k] == w).all() for k, w in net.weights.items())
    m.write_binary(tmp_path / "w.bin.gz", net.weights)
    binary = m.read_weights(tmp_path / "w.bin.gz")
    assert all((binary[k] == w).all() for k, w in net.weights.items())
    assert set(m.read_weights(tmp_path / "w.bin.gz", ["/_5", "/_6"])) == {"/_5", "/_6"}


def test_weights_are_packed_whole(net, model_dir, tmp_path):
    digest = hashlib.sha256((model_dir / "v.model").read_bytes()).hexdigest()
    made = m.pack(model_dir / "v.model", tmp_path / "p.bin.gz", b"OTHERS\x00\x01", digest)
    assert made["v.model"] == digest and len(made) == 2
    packed = m.read_weights(tmp_path / "p.bin.gz", magic=b"OTHERS\x00\x01")
    assert len(packed) == 28 and all((packed[k] == w).all() for k, w in net.weights.items())
    with pytest.raises(s.ModelHeader):
        m.read_weights(tmp_path / "p.bin.gz")  # begins with another magic
    with pytest.raises(s.InvalidVocabulary):
        m.pack(model_dir / "v.model", tmp_path / "p.bin.gz", digest="0" * 64)
    text = (model_dir / "v.model").read_bytes()
    (tmp_path / "more.model").write_bytes(text + b"#Parameter# /_99 {1} 2\n1\n")
    with pytest.raises(s.ModelHeader):
        m.pack(tmp_path / "more.model", tmp_path / "p.bin.gz")
    (tmp_path / "less.model").write_bytes(text[text.index(b"#", 1) :] if text.count(b"#Parameter#") else b"")
    with pytest.raises(s.KotobaError):
        m.pack(tmp_path / "less.model", tmp_path / "p.bin.gz")


def test_files_that_cant_be_read(tmp_path):
    with pytest.raises(s.ModelIo):
        m.read_weights(tmp_path / "none.model")
    whole = gzip.compress(b"x" * 1000)
    for damaged in (whole[:-9], whole[:12] + b"\xff" * 8 + whole[20:]):
        (tmp_path / "v.dict").write_bytes(damaged)
        with pytest.raises(s.ModelGzip):
            m.read_vocabularies(tmp_path / "v.dict")


def test_tuples_are_lists_and_frames_are_refused():
    five = [{"a": 0, "oov": 1}, {"oov": 0}, {"oov": 0}, {"x": 0}, {"word": (1, 2, 3, 4)}]
    data = pickle.dumps(five, 2)
    assert b"t" in data and m.unpickle(data).word_tags == {"word": [1, 2, 3, 4]}
    with pytest.raises(s.PickleError):
        m.unpickle(pickle.dumps([{str(i): i for i in range(50)}] * 5, 4))


def test_weight_errors(net, tmp_path):
    def read(data):
        (tmp_path / "x.model").write_bytes(data)
        return m.read_weights(tmp_path / "x.model")

    with pytest.raises(s.ModelHeader):
        read(b"nothing\n")
    with pytest.raises(s.ModelValue):
        read(b"#Parameter# /_6 {2} 4\n1 x\n")
    with pytest.raises(s.ModelValue):
        read(b"#Parameter# /_6 {2} 40\n1 2\n")
    some = dict(net.weights)
    del some["/_6"]
    with pytest.raises(s.ModelMissing):
        nn.Network(net.vocabularies, some, True)
    with pytest.raises(s.ModelShape):
        nn.Network(net.vocabularies, net.weights | {"/_6": np.zeros(7, np.float32)}, True)


def test_label_tables_are_checked(net):
    v = net.vocabularies
    swapped = dict(v.pos) | {"名詞": 3, "空白": 2}
    for pos, tags in ((swapped, v.word_tags), ({k: x for k, x in v.pos.items() if k != "oov"}, v.word_tags), (dict(v.pos) | {"noun": 24}, v.word_tags), (v.pos, {"x": []}), (v.pos, {"x": [24]})):
        with pytest.raises(s.InvalidVocabulary):
            nn.Network(m.Vocabularies(v.uni, v.bi, v.word, pos, tags), net.weights, True)
    with pytest.raises(s.InvalidVocabulary):
        nn.Network(m.Vocabularies({"a": 1}, v.bi, v.word, v.pos, v.word_tags), net.weights, True)


def test_weights_as_table(spark, net):
    some = {k: net.weights[k] for k in ("/_5", "/_6", "/_7")}
    back = m.weights_of(m.weights_table(spark, some), ["/_5", "/_7"])
    assert set(back) == {"/_5", "/_7"} and (back["/_5"] == some["/_5"]).all()
    assert m.vocabulary_table(spark, {"a": 1}).collect()[0].id == 1


def _lstm(xs, wx, wh, b):
    hidden, h, c, out = wh.shape[0], [0.0] * wh.shape[0], [0.0] * wh.shape[0], []
    for x in xs:
        z = [float(b[k]) + sum(float(x[i]) * float(wx[i][k]) for i in range(len(x))) + sum(h[i] * float(wh[i][k]) for i in range(hidden)) for k in range(4 * hidden)]
        sig = lambda v: 1 / (1 + math.exp(-v))
        c = [sig(z[hidden + k] + 1) * c[k] + sig(z[k]) * math.tanh(z[3 * hidden + k]) for k in range(hidden)]
        h = [sig(z[2 * hidden + k]) * math.tanh(c[k]) for k in range(hidden)]
        out.append(list(h))
    return out


def test_lstm_against_scalar_code():
    rng = np.random.default_rng(0)
    sides = [tuple(rng.normal(0, 0.5, x).astype(np.float32) for x in ((5, 12), (3, 12), (12,))) for _ in range(2)]
    lengths = np.array([6, 4, 4, 1])
    x = rng.normal(0, 1, (15, 5)).astype(np.float32)
    got = nn.lstm(x, lengths, *sides)
    one = nn.lstm(x, lengths, sides[0])
    at = 0
    for n in lengths:
        rows = x[at : at + n]
        np.testing.assert_allclose(got[at : at + n, :3], _lstm(rows, *sides[0]), atol=1e-5)
        np.testing.assert_allclose(got[at : at + n, 3:], _lstm(rows[::-1], *sides[1])[::-1], atol=1e-5)
        np.testing.assert_allclose(one[at : at + n], got[at : at + n, :3], atol=1e-6)
        at += n


def test_features_of_places(net):
    x = net.inputs(["a", "東京都a"])[1:]
    v, w = net.vocabularies, net.weights
    np.testing.assert_array_equal(x[0, :32], w["/_0"][1])
    np.testing.assert_array_equal(x[0, 32:64], w["/_0"][v.uni["東"]])
    np.testing.assert_array_equal(x[3, 64:96], w["/_0"][1])
    np.testing.assert_array_equal(x[3, 128:144], w["/_1"][1])
    np.testing.assert_array_equal(x[3, 112:128], w["/_1"][v.bi.get("a<E>", v.bi["oov"])])
    np.testing.assert_array_equal(x[0, 144:152], w["/_3"][6])
    np.testing.assert_allclose(x[0, 168:184], w["/_2"][v.word["東京"]] + w["/_2"][v.word["東京都"]], rtol=1e-6)
    np.testing.assert_allclose(x[2, 184:200], w["/_2"][v.word["京都"]] + w["/_2"][v.word["東京都"]], rtol=1e-6)
    np.testing.assert_allclose(x[3, 184:200], w["/_2"][v.word["oov"]])


def test_batches_do_not_change_results(net):
    texts = ["東京都渋谷区で", "a", "", "pythonで簡単に使えるツールです", "the " * 30]
    whole = net.tags(texts)
    assert whole == [net.tags([t])[0] for t in texts] and [len(x) for x in whole] == [len(t) for t in texts]
    words = [["東京都", "で", "暮らす"], ["a"], [], ["ツール", "です"]]
    assert net.label_ids(words) == [net.label_ids([w])[0] for w in words]


def test_candidates():
    assert nn.candidates([0], True) == [2] and nn.candidates([0], False) == [0] and nn.candidates([9, 1, 2], False) == list({9, 1, 2})


TEXTS = ["Pythonで簡単に使えるツールです", "ＡＢＣとİSTANBUL ", "", "  ", None, "C++ a.b [猫]"]


def test_segmenter(spark, model_dir):
    seg = Segmenter.load(spark, model_dir)
    df = spark.createDataFrame([(x,) for x in TEXTS], "text string")
    rows = [r[0] for r in df.select(seg.words("text")).collect()]
    assert "".join(rows[0]) == TEXTS[0] and "".join(rows[1]) == "ABCとISTANBUL" and rows[2:5] == [[], [], None]
    low = [r[0] for r in df.select(seg.words("text", lower=True)).collect()]
    assert "".join(low[1]) == "abcとistanbul" and [len(x) for x in low[:2]] == [len(x) for x in rows[:2]]
    for parts in (1, 3):
        assert sorted(map(str, (r[0] for r in df.repartition(parts).select(seg.words("text")).collect()))) == sorted(map(str, rows))
    forced = seg.with_words(["Ｃ＋＋", "a.b", "[猫]"])
    assert forced.forced and not seg.forced and "Segmenter" in repr(seg)
    for word in ("C++", "a.b", "[猫]"):
        assert [r[0] for r in spark.createDataFrame([(word,)], "text string").select(forced.words("text")).collect()] == [[word]]
    assert seg.vocabulary_sizes()[0] > 0
    seg.register()
    assert spark.sql("SELECT ja_words('東京') AS w").collect()[0].w == [r for r in df.sparkSession.createDataFrame([("東京",)], "t string").select(seg.words("t")).collect()][0][0]


def test_tagger_in_sql(spark):
    tag = Tagger.synthetic(spark).with_words(["[猫]"])
    tag.register("tg")
    df = spark.createDataFrame([(x,) for x in TEXTS], "text string")
    df.createOrReplaceTempView("some_texts")
    for lower, tail in ((False, ""), (True, "_lower")):
        got = spark.sql(f"""SELECT tg_words{tail}(text) AS w, tg_tagging{tail}(text) AS x, tg_filter{tail}(text, array('名詞', '助詞')) AS f, tg_extract{tail}(text, array('名詞', '助詞')) AS e,
            tg_postagging{tail}(array('東京', 'Python')) AS p FROM some_texts""").collect()  # fmt: skip
        some = ["名詞", "助詞"]
        tokens = spark.createDataFrame([(["東京", "Python"],)], "w array<string>").select(tag.postagging("w", lower)).collect()[0][0]
        want = df.select(tag.words("text", lower).alias("w"), tag.tagging("text", lower).alias("x"), tag.filter("text", some, lower).alias("f"), tag.extract("text", some, lower).alias("e")).collect()
        assert sorted(str(r[:4]) for r in got) == sorted(str(tuple(r)) for r in want) and all(r.p == tokens for r in got)


def test_tagger(spark):
    tag = Tagger.synthetic(spark)
    df = spark.createDataFrame([(x,) for x in TEXTS], "text string")
    rows = df.select(tag.tagging("text").alias("x"), tag.words("text").alias("w"), tag.filter("text", ["名詞"]).alias("f"), tag.extract("text", ["名詞"]).alias("e")).collect()
    for r in rows:
        if r.w is None:
            assert r.x is None
            continue
        assert r.x.words == r.w and len(r.x.postags) == len(r.w) and set(r.x.postags) <= set(s.POS_LABELS)
        assert len(r.f.words) + len(r.e.words) == len(r.w) and set(r.e.postags) <= {"名詞"}
    words = spark.createDataFrame([(["東京", " "],), ([],), (None,), (["猫", "\n\r"],)], "w array<string>")
    got = [r[0] for r in words.select(tag.postagging("w", strict=False)).collect()]
    assert [None if x is None else len(x) for x in got] == [2, 0, None, None]
    with pytest.raises(PySparkException, match="token 1 is empty"):
        words.select(tag.postagging("w")).collect()
    assert tag.postags().count() == 24


def test_lines_and_json(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes("東京 \r\nx\ry\n".encode())
    lines = read_lines(spark, str(tmp_path / "in"))
    assert [r.text for r in lines.collect()] == ["東京 \r", "x\ry"]
    write_json(lines.select(F.split("text", " ").alias("w")), "w", str(tmp_path / "out"))
    assert sorted(json.loads(x) for f in (tmp_path / "out").glob("part*") for x in f.read_text().splitlines()) == [["x\ry"], ["東京", "\r"]]
    (tmp_path / "in/b.txt").write_bytes(b"\xff\xfe\n")
    with pytest.raises(PySparkException, match="INVALID_UTF8"):
        read_lines(spark, str(tmp_path / "in")).collect()
    (tmp_path / "c.jsonl").write_text('{"text": "a", "words": ["a"], "postags": ["名詞"]}\n\n')
    assert [(r.cat, r.text, r.words) for r in read_cases(spark, str(tmp_path / "c.jsonl")).collect()] == [(None, "a", ["a"])]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("東京 タワー\nx\n")
    seg = Segmenter.synthetic(spark)
    query = stream_json(stream_lines(spark, str(tmp_path / "in")), seg.words, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert sorted("".join(json.loads(x)) for f in (tmp_path / "out").glob("part*") for x in f.read_text().splitlines()) == ["x", "東京　タワー"]


def test_features_of_whole_batches_are_those_of_single_places(net):
    v, w = net.vocabularies, net.weights
    lows = sorted(["東京都で使える", "oovpadthe", "a", "渋谷区の東京都民", "𠮷野家🙂the", "ツール", "the of and"], key=len, reverse=True)
    rows = []
    for low in lows:
        uni = [1, *(v.uni.get(c, v.uni["oov"]) for c in low), 1]
        bi = [1, *(v.bi.get(low[i : i + 2] if i + 1 < len(low) else low[i] + "<E>", v.bi["oov"]) for i in range(len(low))), 1]
        kind = [6, *(0 if "ぁ" <= c <= "ゟ" else 1 if "ァ" <= c <= "ヺ" else 2 if "一" <= c <= "龥" else 3 if c.isascii() and c.isalpha() else 4 if c.isascii() and c.isdigit() else 5 for c in low), 6]
        for i in range(len(low)):
            starts = [low[i : i + k] for k in range(1, 9) if i + k <= len(low)]
            ends = [low[i + 1 - k : i + 1] for k in range(1, 9) if k <= i + 1]
            around = [table[ids[i + d]] for table, ids in ((w["/_0"], uni), (w["/_1"], bi), (w["/_3"], kind)) for d in range(3)]
            sums = [sum((w["/_2"][j] for j in [v.word[x] for x in each if x in v.word] or [v.word["oov"]]), np.zeros(16, np.float32)) for each in (starts, ends)]
            rows.append(np.concatenate([*around, *sums]))
    assert np.allclose(net.inputs(lows), np.array(rows), atol=1e-6)


def test_the_made_up_model_of_real_size():
    large = nn.synthetic(3, True, "東京都で", 500)
    assert {"東", "東京", "東京都", "東京都で"} <= set(large.vocabularies.word) and len(large.vocabularies.word) > 500
    assert large.tags(["東京都で", ""])[1] == []


def _ruled():
    from kotoba import queries as q
    from kotoba.plans.rules import rule_network

    return rule_network(q.RULE_WORDS, q.RULE_PARTICLES, q.RULE_PAIRS, q.RULE_AHEAD, q.RULE_MARKS)


def _mixed_texts(seed, n=60):
    import random

    rng = random.Random(seed)
    parts = ["the ", "ation", "東京都", "python", "de la", "para", "qu", "ss", "zé", "猫", ". ", "。", "12", "がす", "x", "𠮷", "İ", "ｶﾞ", "|", "\0", "Σ", " "]
    return [None, "", " ", "a"] + ["".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(n)]


def _sequential(net, words, texts, lower, labels):
    """Words, or words and labels, text by text by the kernels that number nothing."""
    from kotoba.functions.unicode import lower_kept, normalize
    from kotoba.operators.dictionary import Trie, force_tags

    out = []
    for text in texts:
        whole = normalize(text or "")
        low = lower_kept(whole)
        tags = net.tags([low])[0]
        tags = force_tags(tags, Trie(words).spans(whole)) if words else tags
        cut = nn.cut(low if lower else whole, tags) if whole else []
        names = [s.POS_LABELS[k] for k in net.label_ids([cut])[0]]
        out.append(None if text is None else {"words": cut, "postags": names} if labels else cut)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_automata_give_what_the_steps_give(monkeypatch, seed):
    import pyarrow as pa

    from kotoba.plans import api, automata

    monkeypatch.setattr(automata, "PART", 7)
    monkeypatch.setattr(automata, "WARM", 1 + seed)
    monkeypatch.setattr(nn, "INPUTS", 50)
    monkeypatch.setattr(api, "GROUP_CHARS", 90)
    monkeypatch.setattr(nn, "GROUP_WORDS", 30)
    net, texts = _ruled(), _mixed_texts(seed)
    column = pa.array(texts, pa.string())
    for lower in (False, True):
        for words in ((), ("東京", "de la", "the", "xx", "n12", "Ａ ")):
            found = api.segment(net, api.Trie(words) if words else None, column, lower)
            assert found.lists().to_pylist() == _sequential(net, words, texts, lower, False)
            assert api._tagged(net, found).to_pylist() == _sequential(net, words, texts, lower, True)
    assert net._recurs and net._compiled is not None


@pytest.mark.parametrize("part, warm", [(2048, 256), (40, 40), (16, 2)])
def test_networks_whose_states_do_not_recur_go_on_by_steps(monkeypatch, part, warm):
    import pyarrow as pa

    from kotoba.operators.dictionary import Trie
    from kotoba.plans import api, steps

    monkeypatch.setattr(steps, "PART", part)
    monkeypatch.setattr(steps, "WARM", warm)
    net, texts = nn.synthetic(1), _mixed_texts(9, 80)
    words = ("東京", "de la", "ation")
    found = api.segment(net, Trie(words), pa.array(texts, pa.string()), False)
    assert found.lists().to_pylist() == _sequential(net, words, texts, False, False)
    assert api._tagged(net, found).to_pylist() == _sequential(net, words, texts, False, True)
    assert not net._recurs


@pytest.mark.parametrize("wide, rows", [(384, 1024), (5, 12), (1, 3)])
def test_steps_of_some_sequences_at_a_time_give_the_whole_network(monkeypatch, net, wide, rows):
    from kotoba.plans import steps

    monkeypatch.setattr(steps, "WIDE", wide)
    monkeypatch.setattr(steps, "ROWS", rows)
    rng = np.random.default_rng(wide)
    lengths = np.array([1, 40, 3, 3, 17, 1, 9, 200, 2, 3, 17, 5])
    features, x = rng.normal(0, 0.3, (50, 200)).astype(np.float32), rng.integers(0, 50, lengths.sum())
    w, sides = net.weights, net._sides("birnn")
    sorted_by = np.argsort(-lengths, kind="stable")
    each = np.split(x, np.cumsum(lengths)[:-1])
    states = nn.lstm(features[np.concatenate([each[i] for i in sorted_by])], lengths[sorted_by], *sides)
    expected = np.split(states @ w["/_5"] + w["/_6"], np.cumsum(lengths[sorted_by])[:-1])
    found = np.split(steps.scores(features, x, lengths, sides, w["/_5"], w["/_6"]), np.cumsum(lengths)[:-1])
    for k, i in enumerate(sorted_by):
        np.testing.assert_allclose(found[i], expected[k], atol=2e-5)
    size = lengths[sorted_by]
    assert [n for t, count, n in steps.stretches(size) for _ in range(count)] == [int((size > t).sum()) for t in range(size[0])]
    assert all(count * n <= max(n, rows) for _, count, n in steps.stretches(size))


def test_given_tokens_of_slices_and_null_rows():
    import pyarrow as pa

    from kotoba.plans import api

    rows = [["x"], None, [], ["the", " ", "猫", "the"], ["a", "\t", "b"], ["ｶﾞ", "de"]]
    column = pa.array(rows, pa.list_(pa.string())).slice(1)
    net = _ruled()
    got = api._postags(net, column, False, False).to_pylist()
    made = [None if r is None or "\t" in r else api.tokens(r, False) for r in rows[1:]]
    assert got == [x if x is None else [s.POS_LABELS[k] for k in net.label_ids([x])[0]] for x in made]
    with pytest.raises(s.EmptyToken, match="token 1"):
        api._postags(net, column, False, True)


def test_new_words_are_spelt_some_at_a_time(monkeypatch, net):
    words = ["x", "東京都", "a" * 70, "the", "𠮷野家", "ツール", *(f"w{i}" for i in range(60))]
    each = np.concatenate([net.word_vectors([w]) for w in words])
    sizes, whole = [], nn.lstm
    monkeypatch.setattr(nn, "BATCH_CHARS", 50)
    monkeypatch.setattr(nn, "lstm", lambda x, *more: sizes.append(len(x)) or whole(x, *more))
    np.testing.assert_allclose(net.word_vectors(words), each, atol=1e-6)
    assert sorted(n for n in sizes if n > 50) == [70] and len(sizes) > 6
