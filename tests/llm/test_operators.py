"""Operators on the awkward documents, against brute force."""

import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from kotoba.llm import bpe, chat, html, jaccard, licenses, line_dedup, mixing, mtree, quality, rindex, substring_dedup
from kotoba.llm.jaccard import shingle_sets


# --- brute force ------------------------------------------------------------------------------------------------------


def brute_repeats(texts, length=400):
    """Spans and kept bytes of distinct documents."""
    seen = defaultdict(set)
    for d, x in enumerate(texts):
        for i in range(len(x) - length + 1):
            seen[x[i : i + length]].add((d, i))
    out = []
    for x in texts:
        spans = []
        for i in range(len(x) - length + 1):
            if len(seen[x[i : i + length]]) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        edges = [0, *(e for s in spans for e in s), len(x)]
        out.append((spans, b"".join(x[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))))
    return out


def brute_line_dedup(docs):
    """{id: (text, removed lines)} for sorted (id, text)."""
    seen, out = set(), {}
    for i, text in docs:
        lines = (text or "").split("\n")
        worded = [(k, x.strip(" \t\n\x0b\x0c\r")) for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for k in range(len(worded) - 2):
            window = tuple(x for _, x in worded[k : k + 3])
            if window in seen:
                gone |= {n for n, _ in worded[k : k + 3]}
            seen.add(window)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone) if text is not None else None, sorted(gone))
    return out


def shingles(text):
    w = (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    w = [x for x in w if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute_classes(docs):
    """{id: (smallest id reached by links, number of links)} for (id, text)."""
    sets = [(i, shingles(x)) for i, x in docs]
    links = defaultdict(set)
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            n = len(a & b)
            if n and 5 * n >= 4 * (len(a) + len(b) - n):
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i, _ in sets:
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        out[i] = (min(reach), len(links[i]))
    return out


# --- 1 ----------------------------------------------------------------------------------------------------------------


def test_bpe_on_awkward_texts(docs, empty, rows):
    import base64

    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    reference = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in bpe.encode_documents(docs, *bpe.tokenizer()).collect())
    assert got == sorted((str(i), reference.encode_ordinary(x or ""), (x or "").encode()) for i, x in rows)
    assert bpe.encode_documents(empty, *bpe.tokenizer()).count() == 0
    codec = bpe.codec(*bpe.tokenizer())
    rng = random.Random(2)
    bits = ["a", "b", " ", "  ", "\n", "é", "猫", "🙂", "1", "23", "'s", "'ll", "\x85", "\x1c", "\x1f", " ", "　", "ab" * 20, "\t", "!!", "===", "ſ", "'S", "<|endoftext|>"]
    for _ in range(4000):
        x = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert codec.encode(x) == reference.encode_ordinary(x)
        assert codec.decode(codec.encode(x)) == x.encode()


def test_bpe_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    memo = bpe.Memo(lambda x: x * 2)
    assert [memo[x] for x in (1, 2, 3, 4, 1, 5, 6, 1, 7)] == [2, 4, 6, 8, 2, 10, 12, 2, 14]
    assert len(memo) <= 3 and len(memo.old) <= 3


# --- 2 ----------------------------------------------------------------------------------------------------------------


def test_line_dedup(docs, empty, rows):
    unique = sorted({i: x for i, x in rows if i is not None}.items())
    null = [(-1, x) for i, x in rows if i is None]  # a null id comes first
    want = brute_line_dedup(null + unique)
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == set(docs.columns)
    for r in got:
        assert (r.text, r.removed_lines) == want[-1 if r.doc_id is None else r.doc_id]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_names_of_columns_clash(spark):
    """Columns named as our own keep their values."""
    text = "\n".join(["One line here that is long.", "Two lines here that are long.", "Three lines here that are long."])
    row = (text, "en", "s", "mine", "mine", "mine", "mine", "mine", "mine", "mine", True)
    names = ["text", "lang", "source", "__id", "__TH", "__starts", "__source", "__lang", "topic", "weight", "sampled"]
    df = spark.createDataFrame([(i, *row) for i in range(1, 41)], ["doc_id", *names])
    for out in (line_dedup.dedup_lines(df).drop("removed_lines"), mixing.sampled(df), quality.clean_documents(df)):
        assert out.columns == df.columns
        for r in out.collect():
            assert r[4:] == row[3:]
    assert 0 < mixing.sampled(df).count() < 40
    assert {r.topic for r in mixing.mix(df.withColumn("kind", F.lit("legal")), topic="kind").collect()} == {"legal"}
    assert {r.topic for r in mixing.mix(df.withColumn("kind", F.lit("unheard")), topic="kind").collect()} == {"other"}


# --- 3 ----------------------------------------------------------------------------------------------------------------


def test_chat_layouts(spark):
    records = [
        ('{"prompt": "p", "completion": "c"}', [("user", "p"), ("assistant", "c")]),
        ('{"instruction": "i", "input": "x", "output": "o"}', [("user", "i\n\nx"), ("assistant", "o")]),
        ('{"output": "o", "input": "", "instruction": "i"}', [("user", "i"), ("assistant", "o")]),
        ('{"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": null}]}', [("system", "s"), ("user", "")]),
        ('{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}', [("user", "h"), ("assistant", "g")]),
        ('{"system": "", "prompt": "p", "response": "r"}', [("user", "p"), ("assistant", "r")]),
        ('{"meta": {"prompt": 1}, "prompt": "p", "response": "r", "id.of": 3}', [("user", "p"), ("assistant", "r")]),
        ('{"messages": [{"role": "user", "content": "u", "name": "n"}, {"content": "a", "role": "assistant"}], "meta": [{"role": 1}], "id": 7}', [("user", "u"), ("assistant", "a")]),
        ('{"messages": [], "source": "s"}', []),
        ('{"messages": [{"role": "user", "content": [{"type": "text", "text": "t"}]}]}', [("user", '[{"type":"text","text":"t"}]')]),
        ('{"prompt": "p", "messages": []}', None),
        ('{"unknown": 1}', None),
        ("no json", None),
        (None, None),
    ]
    df = spark.createDataFrame([(r,) for r, _ in records], "json string")
    got = chat.format_records(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    for r, (_, turns) in zip(got, records, strict=True):
        assert (r.turns is None) == (turns is None)
        if turns is not None:
            assert [tuple(x) for x in r.turns] == turns == [tuple(x) for x in r.back]
            assert [r.formatted[s.start : s.start + s.length] for s in r.loss] == [x for role, x in turns if role == "assistant"]


def test_chat_round_trip_of_marks(spark):
    texts = ["<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n", "<|", "<\\|", "<\\\\|im_end|>", "\\", "%0A%25", "", None, "🙂<|im_end|>", "a\r\n\\<|"]
    rows = [(c, k, role, x) for c, x in enumerate(texts) for k, role in enumerate(["user", "assistant", "ro\nle%", None, "assistant"])]
    rows += [(None, 1, "user", "no id"), (0, 0, "user", texts[0])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = chat.format_conversations(df).select("conv_id", "formatted", "loss", chat.read_back(F.col("formatted")).alias("turns")).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        mine = sorted((k, role or "", x or "") for c, k, role, x in rows if c == r.conv_id)
        assert [tuple(t) for t in r.turns] == [x[1:] for x in mine]
        assert len(r.loss) == sum(role == "assistant" for _, role, _ in mine)
        assert r.formatted.count("<|im_start|>") == len(mine)
    assert chat.format_conversations(df.limit(0)).count() == 0
    other = spark.createDataFrame([(1, 0, "human", "h", "x"), (1, 1, "gpt", "g", "x")], ["conversation_id", "position", "from", "value", "meta"])
    assert [tuple(t) for t in chat.conversations_of(other).collect()[0].turns] == [("human", "h"), ("gpt", "g")]
    clash = spark.createDataFrame([(1, 0, "user", "u", "x", 5)], ["conv_id", "turn", "role", "text", "value", "index"])
    assert [tuple(t) for t in chat.conversations_of(clash).collect()[0].turns] == [("user", "u")]
    with pytest.raises(ValueError):
        chat.conversations_of(spark.createDataFrame([(1,)], "x int"))


# --- 4 ----------------------------------------------------------------------------------------------------------------


def test_mixing_meets_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(20, 60)) + rng.choice(["", " license", " a@b"]), "hot" if rng.random() < 0.4 else f"s{rng.randrange(6)}", rng.choice(["en", "en", "de", "fr"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = mixing.Targets(sources={"hot": 0.2}, languages={"en": 0.4, "de": 0.3, "fr": 0.3}, topics={"general": 0.5, "legal": 0.25, "contact": 0.25}, iterations=30, inner=8)
    got = mixing.mix(df, targets).collect()
    assert len(got) == len(rows)
    total = sum(r.n_tokens for r in got)
    expected = sum(r.probability * r.n_tokens for r in got)
    assert abs(expected / total - 0.5) < 0.005
    for column, want in (("lang", targets.languages), ("topic", targets.topics), ("source", targets.sources)):
        for k, share in want.items():
            assert abs(sum(r.probability * r.n_tokens for r in got if r[column] == k) / expected - share) < 0.01
    assert abs(sum(r.n_tokens for r in got if r.sampled) / expected - 1) < 0.1


def test_mixing_settles_where_targets_exceed_supply(spark):
    """The production targets on the given table: 10 % of contact asked, far less there, so all of it is taken."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source", "lang")
    got = mixing.mix(df).collect()
    total = sum(r.n_tokens for r in got)
    expected = sum(r.probability * r.n_tokens for r in got)
    assert abs(expected / total - 0.5) < 1e-4
    for column, power in (("source", 0.7), ("lang", None), ("topic", None)):
        supply, held = defaultdict(float), defaultdict(float)
        for r in got:
            supply[r[column]] += r.n_tokens
            held[r[column]] += r.probability * r.n_tokens
        declared = {"lang": mixing.Targets().languages, "topic": mixing.Targets().topics}.get(column)
        shares = {k: v**power if power else declared[k] for k, v in supply.items() if v}
        per_share = {k: held[k] / shares[k] for k in shares if held[k] < supply[k] - 2 * mixing.TOLERANCE * expected}
        assert max(per_share.values()) / min(per_share.values()) < 1.005  # what is not short keeps its proportions
        assert all(held[k] / shares[k] <= max(per_share.values()) * 1.005 for k in shares)
    contact = [r for r in got if r.topic == "contact"]
    assert sum(r.probability * r.n_tokens for r in contact) >= sum(r.n_tokens for r in contact) - 2 * mixing.TOLERANCE * expected


def test_mixing_targets_that_exclude_each_other(spark):
    rows = [(i, "w w w a@b", "only", "en") for i in range(50)] + [(50 + i, "w w w w", "other", "de") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = mixing.Targets(sources={"only": 0.5, "other": 0.5}, languages={"en": 0.9, "de": 0.1}, topics={"general": 0.5, "contact": 0.5})
    with pytest.warns(UserWarning, match="together"):
        got = mixing.mix(df, targets).collect()
    assert all(abs(r.probability - 0.5) < 1e-6 for r in got)


def test_mixing_on_awkward_texts(docs, empty, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 for r in got)
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs.where("text IS NULL OR text = ''")).where("sampled").count() == 0


# --- 5 ----------------------------------------------------------------------------------------------------------------

PROSE = "The town had been there for as long as anyone could remember, and it was the sort of place that people came to in the summer and left in the autumn. " * 2
PAGES = [
    (None, ""),
    ("", ""),
    ("no tags at all, but it is a text that is long enough to be one and has words of the language in it.", None),
    (f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=x>Menu</a></nav><article><h1>Head</h1><p>One &amp; <b>two\n three</b>.<p>Short.</article><footer>&copy; us</footer>", "Head\n\nOne & two three.\n\nShort."),
    (f'<body><div class="sidebar">{PROSE}</div><div class="content"><p>{PROSE}</p><p>Short line.</p><p>{PROSE}</p></div><div id="comments"><p>{PROSE}</p></div><form>{PROSE}</form>', "\n\n".join([" ".join(PROSE.split()), "Short line.", " ".join(PROSE.split())])),
    ('<main><p>a</p><script>var x = "</p><p>no</p>";</script><!-- <p>no</p> --><aside>no</aside><p hidden>no</p><p>b<br>c</main>', "a\n\nb c"),
    ('<article><div class="ad">no</div><ul><li>one</li><li>two</li></ul><p>&lt;p&gt; &#233; &nbsp;x</p><article class="comment">no</article></article>', "one\n\ntwo\n\n<p> é x"),
    ('<div class="cookie-notice">We use cookies</div><article>text<p>1 < 2</article>', "text\n\n1 < 2"),
    ('<body class="has-sidebar"><div class="site-header">no</div><div class="breadcrumbs">no</div><div class="post-content"><h2>a</h2><p>b</p><div class="related-posts">no</div></div><ol class="commentlist"><li>no</li></ol></body>', "a\n\nb"),
    ('<div id="content"><header>no</header><article><header><h1>a</h1></header><section class="body">b</section></article><p>no</p></div>', "a\n\nb"),
    ("<article><p>open <!-- never closed <p>gone</p></article>", "open"),
]


def test_html():
    for page, want in PAGES:
        if want is not None:
            assert html.main_text(page) == want
    assert html.main_text(PAGES[2][0]).startswith("no tags")


def test_html_marked_teasers_are_not_the_page():
    text = " ".join(PROSE.split())
    for marked in ("<article><h3>Read this too</h3></article>", "<main>One line.</main>"):
        assert text in html.main_text(f"<body><div><p>{PROSE}</p><p>{PROSE}</p></div>{marked}</body>")
    assert html.main_text(f"<article><p>{PROSE}</p><p>{PROSE}</p></article><div>{PROSE}</div>") == f"{text}\n\n{text}"


@pytest.mark.parametrize(
    ("inner", "kept"),
    [
        ('<ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul>', ["One", "Two"]),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be so.</p>", ["Let x=2 be so."]),
        ('<div class="share-price">Shares rose by two.</div>', ["Shares rose by two."]),
        ('<div class="notes navigation-systems">Radar helps.</div>', ["Radar helps."]),
        ("<table><tr><th>Year</th><td>1999</td></tr></table>", ["Year", "1999"]),
        ('<p><a href="/x">A paragraph that is a link as a whole.</a></p>', ["A paragraph that is a link as a whole."]),
        ('<div class="share-buttons">no</div><div id="comments-12"><p>no</p></div><p class="cookie_notice">no</p><div class="advert advert--wide">no</div>', []),
        ('<div class="left-sidebar">no</div><div class="relatedPosts">no</div><div class="wp-block-navigation">no</div><form>no</form><footer>no</footer>', []),
    ],
)
def test_html_of_an_article(inner, kept):
    text = " ".join(PROSE.split())
    page = f'<body class="has-comments"><header>no</header><div class="menu">no</div><article><p>{PROSE}</p>{inner}<p>{PROSE}</p></article><footer>no</footer></body>'
    assert html.main_text(page) == "\n\n".join([text, *kept, text])


def test_html_without_article_tags():
    text = " ".join(PROSE.split())
    links = "".join(f'<li><a href="/{i}">Link number {i} of many</a></li>' for i in range(8))
    page = f'<body><ul>{links}</ul><div class="social-media-report"><h2>A heading</h2><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p></div><ul>{links}</ul><div>© someone</div></body>'
    assert html.main_text(page) == f"A heading\n\n{text}\n\nShort one.\n\n{text}"
    decided = [(first, last) for _, first, last in html.classified(page)]
    assert decided.count((html.GOOD, html.GOOD)) == 2 and (html.SHORT, html.GOOD) in decided and (html.SHORT, html.BAD) in decided and decided.count((html.BAD, html.BAD)) == 16


def test_html_operator(spark):
    df = spark.createDataFrame([(i, "u", x, "clash") for i, (x, _) in enumerate(PAGES)] + [(None, None, None, None)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got[None] == "" and all(got[i] == html.main_text(x) for i, (x, _) in enumerate(PAGES))
    assert html.extract(df.limit(0)).count() == 0
    long = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    assert html.main_text(long).count("\n\n") == 49_999


# --- 6 ----------------------------------------------------------------------------------------------------------------


def test_top_k_on_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]  # one very common vector
    rows += [(2000, None), (2001, []), (2002, [float("nan")] * 8), (2003, [None] * 8), (2004, [1.0, 2.0]), (2005, [3.0, 4.0]), (None, [1.0] * 8), rows[3], (50, [0.1] * 8), (2006, [float("inf")] * 8), (2007, [1e3] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    v = df.select("vec_id", mtree.integers(F.col("embedding")).alias("v"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in mtree.top_k(v, v.where("vec_id % 50 = 0"), 5, shard=200, block=8).collect()}
    good = {(i, tuple(int(np.floor(256.0 * y)) for y in x)) for i, x in rows if i is not None and x and all(y is not None and np.isfinite(y) for y in x)}
    want = {}
    for i in sorted({i for i, _ in good if i % 50 == 0}):
        scores = sorted({(-sum(a * b for a, b in zip(q, x, strict=True)), j) for qi, q in good if qi == i for j, x in good if j != i and len(x) == len(q)})
        for k, (score, j) in enumerate(scores[:5]):
            want[i, k + 1] = (j, -score)
    assert got == want
    assert mtree.top_k(v.limit(0), v.limit(0), 5).count() == 0


def test_m_tree_leaves_distances_out():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 400, (20, 16))
    x = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 5, (4000, 16))).astype(np.int64)
    norm2 = int((x**2).sum(axis=1).max())
    shard = mtree.Shard(np.arange(4000), x, norm2)
    for q in range(0, 4000, 400):
        best = sorted(((-int(x[j] @ x[q]), j) for j in range(4000) if j != q))[:5]
        assert shard.top(q, x[q], 5) == [(-s, j) for s, j in best]
    assert shard.computed < 10 * 4000 / 2


def test_top_k_with_huge_numbers(spark):
    """Scores beyond 2^53 are exact; beyond the 64-bit integers they count as the nearest of these."""
    big = 2**30
    df = spark.createDataFrame([(0, [big, 1]), (1, [big, 3]), (2, [big, 2]), (3, [-big, 0]), (50, [big, 2])], "vec_id long, v array<long>")
    got = [(r.vec_id, r.score) for r in mtree.top_k(df, df.where("vec_id = 50"), 4).orderBy("rank").collect()]
    assert got == [(1, 2**60 + 6), (2, 2**60 + 4), (0, 2**60 + 2), (3, -(2**60))]
    rows = [(50, [1e30] * 64), (1, [1e8] * 64), (2, [2e8] * 64), (3, [-1e30] * 64), (4, [0.5] * 64), (100, [0.25] * 64)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", mtree.integers(F.col("embedding")).alias("v"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in mtree.top_k(v, v.where("vec_id % 50 = 0"), 5).collect()}
    most, least = 2**63 - 1, -(2**63)
    assert [got[50, k] for k in range(1, 6)] == [(1, most), (2, most), (4, most), (100, most), (3, least)]
    assert got[100, 1] == (50, most) and got[100, 2] == (2, 64 * 64 * 51_200_000_000) and got[100, 5] == (3, least)


def test_top_k_leaves_cells_out(spark):
    """On clustered vectors most cells, and most of the rest, are never looked at; the result is that of all scores."""
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 400, (12, 16))
    x = np.floor(centres[rng.integers(0, 12, 3000)] + rng.normal(0, 5, (3000, 16))).astype(np.int64)
    norm2 = float((x.astype(float) ** 2).sum(axis=1).max()) + 1
    points = mtree.lifted(x, norm2)
    cells = mtree.Cells({16: mtree.far_first(points, 12)}, {16: 0}, norm2)
    far = np.stack([mtree.distances(points, p) for p in cells.pivots[16]])
    radius = {c: far[c][far.argmin(axis=0) == c].max() for c in range(12)}
    visited = 0
    for q in range(0, 3000, 50):
        scores = x @ x[q]
        fifth = int(np.sort(np.delete(scores, q))[-5])
        visits = cells.may_hold(x[q], 16, fifth, radius)
        visited += len(visits)
        assert set(far.argmin(axis=0)[(scores >= fifth) & (np.arange(3000) != q)]) <= set(visits)
    assert visited < 60 * 12 / 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<long>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in mtree.top_k(df, df.where("vec_id % 50 = 0"), 5, shard=250, block=20).collect()}
    for q in range(0, 3000, 50):
        want = sorted((-int(s), j) for j, s in enumerate(x @ x[q]) if j != q)[:5]
        assert [got[q, k] for k in range(1, 6)] == [(j, -s) for s, j in want]


# --- 7 ----------------------------------------------------------------------------------------------------------------


def test_quality(docs, empty, rows):
    got = quality.score_documents(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[0].n_words == 0 and by[0].base_failed and not by[0].kept
    assert not any(by[i].kept for i in (1, 2, 3, 4, 80, 81, 82, 83)) and all(by[i].kept for i in (10, 20, 40, 84))
    assert by[84].n_lines_failed == 0 and quality.score_documents(empty).count() == 0
    clean = quality.clean_documents(docs)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_lines_are_judged_one_by_one():
    rules = quality.Rules()
    judge = lambda x: quality.verdict(x, x.split(), rules)
    assert judge("Please enable JavaScript to go on.") == "boilerplate"
    assert judge("Alle Rechte vorbehalten.") == judge("Tous droits réservés.") == judge("Todos los derechos reservados.") == "boilerplate"
    assert judge("Home | About | Contact") == "navigation"
    assert judge("bad$$$ worse### worst***.") == "symbols"
    assert judge("THIS IS ALL SHOUTED.") == "shouting"
    assert judge("ha ha ha ha ha ha.") == "repetition"
    assert judge("no mark at the end") == "punctuation"
    assert judge("A sentence ends here.") == ""


# --- 8 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("pieces", [4096, 1])
def test_substring_dedup(docs, empty, rows, monkeypatch, pieces):
    monkeypatch.setattr(substring_dedup, "PIECES", pieces)
    unique = list(dict.fromkeys(rows))
    want = dict(zip(unique, brute_repeats([(x or "").encode() for _, x in unique]), strict=True))
    got = substring_dedup.remove_repeats(docs).collect()
    assert sorted(str((r.doc_id, [list(s) for s in r.spans], bytes(r.kept))) for r in got) == sorted(str((i, [list(s) for s in want[i, x][0]], want[i, x][1])) for i, x in rows)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_windows_at_every_alignment():
    rng = random.Random(8)
    text = lambda n: bytes(rng.randrange(97, 100) for _ in range(n))
    core = text(430)
    strings = [text(rng.randrange(0, 40)) + core[a : a + n] + text(rng.randrange(0, 40)) for a, n in ((0, 430), (5, 400), (3, 401), (11, 399), (0, 410), (20, 410))]
    anchor = core[200:232]
    got = substring_dedup.repeated_windows(strings, [x.index(anchor) for x in strings])
    for k, x in enumerate(strings):
        want = [i for i in range(len(x) - 399) if sum(y[j : j + 400] == x[i : i + 400] for y in strings for j in range(len(y) - 399)) > 1]
        assert got[k].tolist() == want


def test_run_index_streams_matching_statistics():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 4, 60)
    parts = []
    for k in range(8):
        copy = base.copy()
        copy[rng.integers(0, 60)] = 5
        parts += [copy, [100 + k]]
    x = np.concatenate(parts)
    index = rindex.build(x, 61)
    got = index.matching_statistics()
    n = len(x)
    for length in (1, 5, 20):
        at = np.flatnonzero(got >= length)
        group = index.groups(at, length)
        want = [x[i : i + length].tobytes() for i in at]
        assert len(set(group)) == len(set(want)) == len(set(zip(group.tolist(), want, strict=True)))
    for i in range(0, n, 7):
        best = 0
        for j in range(n):
            if i != j:
                m = 0
                while i + m < n and j + m < n and x[i + m] == x[j + m]:
                    m += 1
                best = max(best, m)
        assert got[i] == best
    assert len(index.runs) < n / 2 and index.lengths.sum() == n


def test_long_texts_are_cut_into_chunks(monkeypatch, spark):
    monkeypatch.setattr(substring_dedup, "CHUNK", 1000)
    rng = random.Random(6)
    long = "".join(rng.choice("abcd") for _ in range(3500))
    texts = [(1, long), (2, long[700:2900] + "x"), (3, long[:450])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    places = substring_dedup.piece_places(df.select("doc_id", F.lit(0).cast("long").alias("th"), "text")).collect()
    windows = {(r.doc_id, r["at"] + k) for r in places for k in range(r["len"] - 399)}
    assert windows == {(i, k) for i, x in texts for k in range(len(x) - 399)}


# --- 9 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("params", [jaccard.Params(), jaccard.Params(light=2, block=4)])
def test_jaccard_join(docs, empty, rows, params):
    unique = sorted({i: x for i, x in rows if i is not None}.items())
    want = brute_classes(unique)
    got = jaccard.similar_documents(docs, params).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.class_id, r.n_links) == ((None, 0) if r.doc_id is None else want[r.doc_id])
    assert jaccard.similar_documents(empty).count() == 0


def test_jaccard_links_and_survivors(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(900)]
    docs = []
    for _ in range(5):
        base = [rng.choice(words) for _ in range(rng.randrange(80, 300))]
        for _ in range(rng.choice([3, 40])):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy))
    hot = [rng.choice(words) for _ in range(30)]
    docs += [" ".join(hot + [rng.choice(words) for _ in range(rng.randrange(4, 50))]) for _ in range(150)]
    docs = list(enumerate(docs))
    want = brute_classes(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for params in (jaccard.Params(), jaccard.Params(light=3, block=16)):
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similar_documents(df, params).collect()}
        assert got == want
    assert sorted(r.doc_id for r in jaccard.one_of_each(df.union(df)).collect()) == sorted({c for c, _ in want.values()})


def test_jaccard_drops_no_text_for_its_id(spark):
    """Null and reused ids: nodes are texts, so different texts all stay and links are found under any id."""
    rng = random.Random(12)
    text = lambda: [f"w{rng.randrange(10_000)}" for _ in range(60)]
    near = lambda x: " ".join([*x[:-1], "edit"])
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, " ".join(a)), (None, " ".join(b)), (7, " ".join(c)), (7, " ".join(d)), (8, near(d)), (None, " ".join(e)), (5, near(e)), (6, " ".join(e) + " more")]
    rows += [(None, " ".join(f)), (None, near(f)), (None, " ".join(a)), (None, ""), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {(r.doc_id, r.text) for r in jaccard.one_of_each(df).collect()}
    certain = {(None, " ".join(a)), (None, " ".join(b)), (7, " ".join(c)), (7, " ".join(d)), (5, near(e)), (None, ""), (None, " ")}
    assert certain < kept and len(kept) == len(certain) + 1 == jaccard.one_of_each(df).count()
    assert len(kept & {(None, " ".join(f)), (None, near(f))}) == 1
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.similar_documents(df).collect() if r.doc_id)
    assert got == [(5, 5, 2), (6, 5, 2), (7, 7, 0), (7, 7, 1), (8, 7, 1)]


def test_shingle_sets():
    texts = ["a b c d e f", "a  b\tc\nd e f", "a b", "", None, "a b c d e", "b a", "a b c d e a b c d e"]
    sets, at = shingle_sets(texts, 5)
    found = [frozenset(sets[a:b].tolist()) for a, b in zip(at, at[1:], strict=False)]
    assert [len(x) for x in found] == [len(shingles(x)) for x in texts] and found[0] == found[1] and found[5] < found[0] and found[2] != found[6]


# --- 10 ---------------------------------------------------------------------------------------------------------------


def test_license_scan(spark, docs, empty, rows):
    cases = [
        ("This project is LICENSED under the MIT license!", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("All rights reserved.", "LicenseRef-Proprietary"),
        ("The license of the thing", None), ("", None), (None, None), ("MIT", None), ("licensed under cc by nc 4 0", "CC-BY-NC-4.0"), ("text\nReleased under the MIT License.\nmore text", "MIT"),
        ("word " * 20_000, None),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.matches for r in licenses.scan_licenses(df).collect()}
    for i, (_, want) in enumerate(cases):
        assert (got[i][0].license if got[i] else None) == want
    assert got[8][0].line_no == 1 and got[8][0].dice == 1.0
    assert licenses.scan_licenses(docs).count() == len(rows) and licenses.scan_licenses(empty).count() == 0


def test_notices_within_and_over_lines(spark):
    mit = (Path(__file__).resolve().parents[2] / "licenses" / "MIT.txt").read_text()
    cases = [
        (mit, {"MIT"}), ("Copyright 2020 Foo Inc. Licensed under the Apache License, Version 2.0.", {"Apache-2.0"}),
        ("We wrote this guide for all who care. " * 90 + "It is Released under the MIT License. And so on.", {"MIT"}),
        ("// SPDX-License-Identifier: BSD-2-Clause", {"BSD-2-Clause"}), ("Pictures: Licensed under\nCC BY-NC-SA 4.0.", {"CC-BY-NC-SA-4.0"}),
        ("This library is licensed under the GNU Lesser General Public License, version 2.1.", {"LGPL-2.1"}),
        ("Code is released under the MIT License. Texts are licensed under CC BY-ND 4.0.", {"MIT", "CC-BY-ND-4.0"}),
        ("All rights reserved.", {"LicenseRef-Proprietary"}), ("The licence of the thing is with the software under it.", set()), ("", set()), (None, set()),
        ("Permission is hereby granted", set()),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.matches for r in licenses.scan_notices(df).collect()}
    for i, (_, want) in enumerate(cases):
        assert {m.license for m in got[i]} == want, (i, got[i])
    assert got[0][0].line_no == 2 and got[4][0].line_no == 0


def test_size_bounds_lose_nothing(spark):
    """Lines made of the beginnings of templates, against the coefficient with every template."""
    lines = [" ".join(body.split()[:n]) for _, body in licenses.TEMPLATES for n in range(2, len(body.split()) + 1, 2)]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    for r in got:
        a = set(licenses.template_bigrams(lines[r.doc_id]))
        best = []
        for name, body in licenses.TEMPLATES:
            b = set(licenses.template_bigrams(body))
            best.append((-2 * len(a & b) / (len(a) + len(b)), name))
        dice, name = min(best)
        assert [(m.license, m.dice) for m in r.matches] == ([(name, -dice)] if -dice >= 0.8 else [])


def test_jaccard_tasks_by_brute_force():
    rng = np.random.default_rng(21)
    sketch = rng.integers(0, 4, (40, 64)).astype(np.uint8)
    sketch[1::3] = sketch[::3][: len(sketch[1::3])]
    want = np.array([[((a == b) & (a != 0)).sum() >= 0.4 * max(1, ((a != 0) | (b != 0)).sum()) for b in sketch[25:]] for a in sketch[:25]])
    assert (jaccard.alike(sketch[:25], sketch[25:], 0.4) == want).all()
    left, right = np.arange(25), np.arange(25, 40)
    root = jaccard.roots(want, left, right, 40)
    reach = {i: {i} for i in range(40)}
    for i, j in zip(*np.nonzero(want), strict=True):
        both = reach[i] | reach[j + 25]
        for k in both:
            reach[k] = both
    assert root.tolist() == [min(reach[i]) for i in range(40)]


def test_jaccard_runs_follow_the_recall():
    runs = [jaccard.Params(recall=x).runs() for x in (0.9, 0.99, 0.99999)]
    assert runs == sorted(runs) and runs[0] < runs[-1] and jaccard.Params(depth=5).runs() >= runs[-1]


def test_jaccard_with_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "mine", 7, "x"), (2, text + " more", "mine", 8, "y"), (3, "other words entirely here now", "mine", 9, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __key string, __TH long, class_id string")
    got = sorted(map(tuple, jaccard.one_of_each(df).collect()))
    assert got == [rows[0], rows[2]]
