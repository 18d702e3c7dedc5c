"""The library's queries over the driver's tables, and the SQL that gives the same rows. The documents hold no Japanese,
so every query also reads a few lines that do."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as t
from .functions import unicode as u
from .functions.stopwords import STOPWORDS, remove_stopwords
from .operators import dictionary, features
from .plans.api import Segmenter, Tagger
from .plans.nn import batches, candidates, viterbi_batch
from .plans.rules import rule_network
from .schema import POS_LABELS, postags
from .sources.lines import as_json

Query = Callable[[SparkSession, str], DataFrame]

LINES: tuple[tuple[int, str | None], ...] = (
    (-1, "Pythonで簡単に使えるツールです"),
    (-2, "東京都渋谷区で東京都民が暮らす。"),
    (-3, "ＡＢＣとİSTANBULとPython"),
    (-4, "ΑΣB ΑΣ. ΣΑ"),
    (-5, "アイスクリームとｱｲｽｸﾘｰﾑ　"),
    (-6, "A BCとＡ ＢＣ \t"),
    (-7, "ABABA C++ (猫)"),
    (-8, "𠮷野家🙂"),
    (-9, "\t\n"),
    (-10, ""),
    (-11, None),
    (-12, "これ は ペン です が 猫 も いる です"),
    (-13, "ｶﾞｷﾞﾊﾟｰﾃｨ１２！ か\u3099 e\u0301a\u0301\u0323"),
)
ENTRIES = ("東京", "東京都", "京都", "渋谷区", "ABAB", "C++", "(猫)", "the", "ation", "de la", "Ａ ")
VOCABULARY = ("the", "th", "and", "an", "de", "der", "que", "東京", "東京都", "京都", "都", "で", "アイス")
UNI = "東京都でのとすabcdefghijklmnop .,"
DROP, TAKE = ("名詞", "助詞", "動詞"), ("名詞", "補助記号", "形状詞")
#: What the network with weights set by hand knows.
RULE_WORDS = {"the": "連体詞", "東京": "名詞", "東京都": "代名詞", "京都": None, "で": None, "python": "英単語", "ation": None, "ing": None, "de la": "英単語", "para": "接頭辞"}
RULE_PARTICLES, RULE_PAIRS, RULE_AHEAD, RULE_MARKS = ("de", "と", "of", "und", "で"), ("qu", "ck", "がす", "ss", "en"), "xzé猫", ".,。s"
#: A dyadic table, so that sums are exact in any order: transitions[next][prev].
TRANSITIONS = tuple(tuple(((3 * a + 5 * b) % 8 - 4) / 4 for b in range(6)) for a in range(6))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of the documents and the lines, on all cores."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.unionByName(spark.createDataFrame(list(LINES), "doc_id long, text string"))


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores, where a small input has fewer splits than there are: for steps that take long a row."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def tags_of(characters: Column) -> Column:
    """Tags for checks: from the code points."""
    return F.transform(characters, lambda c: (F.ascii(c) % 4).cast("int"))


def labelled(words: Column) -> Column:
    """Tagged text for checks: a word's label is that of its length."""
    return F.struct(words.alias("words"), F.transform(words, lambda w: t.label_of(F.length(w) % 24)).alias("postags")).cast(t.TAGGED_DDL)


def spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).where("text IS NOT NULL").select("doc_id", "text", t.chars("text").alias("c"))


def digest(words: Column) -> list[Column]:
    return [F.size(words).cast("long").alias("n"), F.md5(F.array_join(words, "|").cast("binary")).alias("md5")]


def rstrip_space_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", t.map_spaces(t.strip_end("text")).alias("text"))


def chartype_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = texts(spark, sf_dir).where("text IS NOT NULL").select(F.posexplode(t.type_counts("text")).alias("char_type", "n"))
    return counts.groupBy("char_type").agg(F.sum("n").alias("n"))


def char_bigrams_end_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir).where("text IS NOT NULL").select(F.explode(features.bigrams("text")).alias("bigram"))
    return rows.groupBy("bigram").agg(F.count("*").alias("n"))


def context_window_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spelled(spark, sf_dir).select(F.transform("c", t.char_type).alias("k"))
    pad = lambda x: F.coalesce(x, F.lit(features.PAD_TYPE))
    around = kinds.select(F.explode(F.transform("k", lambda x, i: F.struct(pad(F.get("k", i - 1)).alias("before"), x.alias("here"), pad(F.get("k", i + 1)).alias("after")))).alias("w"))
    return around.select("w.*").groupBy("before", "here", "after").agg(F.count("*").alias("n"))


def vocab_lookup_oov(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = spark.createDataFrame([(c, i + 2) for i, c in enumerate(UNI)], "key string, id int")
    rows = spelled(spark, sf_dir).select(F.explode("c").alias("ch"))
    return features.look_up(rows, "ch", vocabulary, 0, "id").groupBy("id").agg(F.count("*").alias("n"))


def _candidates(at_end: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        vocabulary = spark.createDataFrame([(w, i) for i, w in enumerate(VOCABULARY)], "key string, id int")
        rows = texts(spark, sf_dir).where("text IS NOT NULL")
        found = features.candidates(rows, "doc_id", "text", vocabulary, [len(w) for w in VOCABULARY], at_end)
        return found.groupBy("word").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))

    return run


def _candidate_lists(at_end: bool) -> Query:
    """How often each list of candidates stands at a place."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        vocabulary = spark.createDataFrame([(w, i) for i, w in enumerate(VOCABULARY)], "key string, id int")
        rows = texts(spark, sf_dir).where("text IS NOT NULL")
        found = features.candidate_lists(rows, "doc_id", "text", vocabulary, [len(w) for w in VOCABULARY], at_end)
        return found.groupBy(F.array_join("words", "|").alias("words")).agg(F.count("*").alias("n"))

    return run


def viterbi_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best paths for emissions from code points, over whole texts, by the batched kernel."""

    def run(column: pa.Array) -> pa.Array:
        values = column.to_pylist()
        out: list[list[int] | None] = [None if x is None else [] for x in values]
        for group in batches([len(x or "") for x in values]):
            lengths = np.array([len(values[i] or "") for i in group])
            if not lengths[0]:
                continue
            points = np.zeros((len(group), lengths[0], 1), np.int64)
            for k, i in enumerate(group):
                points[k, : lengths[k], 0] = [ord(c) for c in values[i] or ""]
            emissions = (points * np.arange(1, 7) % 16 - 8) / 8
            for i, path in zip(group, viterbi_batch(emissions, lengths, np.array(TRANSITIONS)), strict=True):
                out[i] = path if values[i] is not None else None
        return pa.array(out, pa.list_(pa.int32()))

    path = F.arrow_udf(run, "array<int>")(F.col("text"))
    return texts(spark, sf_dir).select("doc_id", path.alias("path")).select("doc_id", F.size("path").alias("n"), F.md5(F.array_join(F.col("path").cast("array<string>"), "").cast("binary")).alias("md5"))


def bmes_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spelled(spark, sf_dir).select("doc_id", "c", tags_of(F.col("c")).alias("tags"))
    return rows.select("doc_id", t.assemble(F.col("c"), F.col("tags")).alias("w")).select("doc_id", *digest(F.col("w")))


def dictionary_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = spelled(spark, sf_dir).select("doc_id", dictionary.find_spans("text", ENTRIES).alias("s"))
    shown = F.array_join(F.transform("s", lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["length"].cast("string"))), ",")
    return spans.select("doc_id", F.size("s").cast("long").alias("n"), shown.alias("spans"))


def _forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spelled(spark, sf_dir).select("doc_id", "c", tags_of(F.col("c")).alias("tags"), dictionary.find_forced("text", ENTRIES).alias("forced"))
    return rows.select("doc_id", "c", t.forced_tags(F.col("tags"), F.col("forced")).alias("tags"))


def force_span_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forced(spark, sf_dir).select("doc_id", F.size("tags").cast("long").alias("n"), F.md5(F.array_join(F.col("tags").cast("array<string>"), "").cast("binary")).alias("md5"))


def dictionary_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forced(spark, sf_dir).select("doc_id", t.assemble(F.col("c"), F.col("tags")).alias("w")).select("doc_id", *digest(F.col("w")))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.split("text", " ").alias("words"))


def _selected(fn: Callable[[Column], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _words(spark, sf_dir).select("doc_id", labelled(F.col("words")).alias("tagged")).select("doc_id", fn(F.col("tagged")).alias("x"))
        return rows.select("doc_id", F.array_join("x.words", " ").alias("words"), F.array_join("x.postags", " ").alias("postags"))

    return run


def postag_empty_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _words(spark, sf_dir).select("doc_id", labelled(F.col("words")).alias("tagged"))
    return rows.select("doc_id", F.size(t.drop_labels("tagged", [])["words"]).alias("n_filtered"), F.size(t.take_labels("tagged", [])["words"]).alias("n_extracted"))


def stopword_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    forced = _words(spark, sf_dir).select("doc_id", remove_stopwords("words").alias("w"))
    return forced.select("doc_id", F.size("w").cast("long").alias("n"), F.array_join("w", " ").alias("words"))


def postag_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postags(spark).select(F.col("id").cast("int").alias("id"), "label")


def postag_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir).select(F.explode("words").alias("label")).unionByName(postags(spark).select("label"))
    known = words.withColumn("id", t.try_parse_labels(F.col("label")))
    return known.groupBy("id").agg(F.count("*").alias("n"))


def argmax_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", t.argmax("embedding").alias("best"))


def token_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("doc_id", F.array_join(t.normalize_tokens(F.col("words"), strict=False), "|").alias("tokens"))


def words_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _words(spark, sf_dir).select("doc_id", F.from_json(F.to_json("words"), "array<string>").alias("w"))
    return rows.select("doc_id", *digest(F.col("w")))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def preprocess_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", u.preprocess("text").alias("text"))


def lower_final_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", u.lower("text").alias("text"))


def isalnum(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.select("word", "n", u.is_alnum("word").alias("alnum"))


def candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate ids of each word, from its code points, in the order in which their vectors are summed."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([candidates([ord(c) % 24 for c in w] or [0], u.alnum(w)) for w in column.to_pylist()], pa.list_(pa.int32()))

    words = _words(spark, sf_dir).select(F.explode("words").alias("word")).distinct()
    return words.select("word", F.arrow_udf(run, "array<int>")(F.col("word")).alias("ids"))


def segment_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by a network with random weights: shows that it runs, not what real words are."""
    rows = texts(spark, sf_dir).select("doc_id", Segmenter.synthetic(spark).with_words(ENTRIES).words("text").alias("w"))
    return rows.select("doc_id", *digest(F.col("w")))


def tag_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir).select("doc_id", Tagger.synthetic(spark).tagging("text").alias("x"))
    return rows.select("doc_id", F.size("x.words").cast("long").alias("n"), F.md5(F.array_join("x.postags", "|").cast("binary")).alias("md5"))


def _by_rules(spark: SparkSession) -> Tagger:
    return Tagger.of(spark, rule_network(RULE_WORDS, RULE_PARTICLES, RULE_PAIRS, RULE_AHEAD, RULE_MARKS))


def _rule_words(lower: bool) -> Query:
    """Words by the network with weights set by hand."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = texts(spark, sf_dir).where("text IS NOT NULL").select("doc_id", _by_rules(spark).words("text", lower).alias("w"))
        return rows.select("doc_id", *digest(F.col("w")))

    return run


def _rule_tagging(lower: bool) -> Query:
    """Words and labels by the network with weights set by hand."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = texts(spark, sf_dir).where("text IS NOT NULL").select("doc_id", _by_rules(spark).tagging("text", lower).alias("x"))
        return rows.select("doc_id", *digest(F.col("x.words")), F.md5(F.array_join("x.postags", "|").cast("binary")).alias("labels_md5"))

    return run


def rule_postagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of given tokens by the network with weights set by hand; null where a token is empty."""
    rows = _words(spark, sf_dir).select("doc_id", _by_rules(spark).postagging("words", strict=False).alias("p"))
    return rows.select("doc_id", F.array_join("p", "|").alias("postags"))


def rule_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted words by the registered SQL function."""
    _by_rules(spark).register("rule")
    texts(spark, sf_dir).where("text IS NOT NULL").createOrReplaceTempView("rule_texts")
    rows = spark.sql("SELECT doc_id, rule_extract(text, array('名詞', '補助記号')) AS x FROM rule_texts")
    return rows.select("doc_id", F.array_join("x.words", "|").alias("words"), F.array_join("x.postags", "|").alias("postags"))


def vocabulary_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    uni, bi, word = _by_rules(spark).vocabulary_sizes()
    return spark.createDataFrame([(uni, bi, word)], "uni int, bi int, word int")


def tagged_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged text to JSON, read again as a case."""
    rows = _words(spark, sf_dir).select("doc_id", as_json(labelled(F.col("words"))).alias("j"))
    read = rows.select("doc_id", F.from_json("j", "words array<string>, postags array<string>").alias("x"))
    return read.select("doc_id", F.array_join("x.words", "|").alias("words"), F.array_join("x.postags", "|").alias("postags"))


QUERIES: dict[str, Query] = {
    "rule_words": _rule_words(False),
    "rule_words_lower": _rule_words(True),
    "rule_tagging": _rule_tagging(False),
    "rule_tagging_lower": _rule_tagging(True),
    "rule_postagging": rule_postagging,
    "rule_sql_functions": rule_sql_functions,
    "vocabulary_sizes": vocabulary_sizes,
    "tagged_json": tagged_json,
    "rstrip_space_map": rstrip_space_map,
    "chartype_histogram": chartype_histogram,
    "char_bigrams_end_marker": char_bigrams_end_marker,
    "context_window_pad": context_window_pad,
    "vocab_lookup_oov": vocab_lookup_oov,
    "word_start_candidates": _candidates(False),
    "word_end_candidates": _candidates(True),
    "word_start_lists": _candidate_lists(False),
    "word_end_lists": _candidate_lists(True),
    "viterbi_decode": viterbi_decode,
    "bmes_assemble": bmes_assemble,
    "dictionary_spans": dictionary_spans,
    "force_span_tags": force_span_tags,
    "dictionary_segment": dictionary_segment,
    "postag_filter": _selected(lambda x: t.drop_labels(x, DROP)),
    "postag_extract": _selected(lambda x: t.take_labels(x, TAKE)),
    "postag_empty_lists": postag_empty_lists,
    "stopword_remove": stopword_remove,
    "postag_labels": postag_labels,
    "postag_parse": postag_parse,
    "argmax_first_wins": argmax_first_wins,
    "token_normalize": token_normalize,
    "words_json": words_json,
    "token_counts": token_counts,
    "preprocess_nfkc": preprocess_nfkc,
    "lower_final_sigma": lower_final_sigma,
    "isalnum": isalnum,
    "candidate_order": candidate_order,
    "segment_synthetic": segment_synthetic,
    "tag_synthetic": tag_synthetic,
}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_LINES = ", ".join(f"({i}, {'NULL' if x is None else _quoted(x)})" for i, x in LINES)
_LABELS = "[" + ", ".join(map(_quoted, POS_LABELS)) + "]"
_TEXTS = f"texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_LINES}) AS v(doc_id, text))"
_CHARS = f"{_TEXTS}, chars AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM texts WHERE text <> '')"
_TYPE = "CASE WHEN unicode(ch) BETWEEN 12352 AND 12447 THEN 0 WHEN unicode(ch) BETWEEN 12449 AND 12538 THEN 1 WHEN unicode(ch) BETWEEN 19968 AND 40869 THEN 2 WHEN unicode(ch) BETWEEN 65 AND 90 OR unicode(ch) BETWEEN 97 AND 122 THEN 3 WHEN unicode(ch) BETWEEN 48 AND 57 THEN 4 ELSE 5 END"
_WORDS = f"{_TEXTS}, words AS (SELECT doc_id, string_split(text, ' ') AS w FROM texts WHERE text IS NOT NULL)"
_PIECES = f"{_CHARS}, pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, {_quoted(dictionary.pattern(ENTRIES))}) AS p FROM texts WHERE text <> '')), spans AS (SELECT doc_id, k, piece, length(piece) AS len, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) - length(piece) AS start FROM pieces), found AS (SELECT * FROM spans WHERE len > 1 OR piece IN ({', '.join(_quoted(w) for w in dictionary.prepare(ENTRIES) if len(w) == 1) or 'NULL'}))"
_FORCED = f"""{_PIECES}, marks AS (
  SELECT doc_id, start + unnest(range(len)) AS pos, unnest(list_transform(range(len), lambda i: CASE WHEN len = 1 THEN 3 WHEN i = 0 THEN 0 WHEN i = len - 1 THEN 2 ELSE 1 END)) AS f FROM found
), placed AS (
  SELECT c.doc_id, c.pos, c.ch, unicode(ch) % 4 AS t, f, lag(f) OVER w AS fb, lead(f) OVER w AS fa FROM chars c LEFT JOIN marks m ON m.doc_id = c.doc_id AND m.pos = c.pos WINDOW w AS (PARTITION BY c.doc_id ORDER BY c.pos)
), after_ AS (
  SELECT *, CASE WHEN fb IN (2, 3) THEN CASE t WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE t END ELSE t END AS a FROM placed
), tags AS (
  SELECT doc_id, pos, ch, coalesce(f, CASE WHEN fa IN (0, 3) THEN CASE a WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE a END ELSE a END) AS tag FROM after_
)"""


def _assembled(tags: str) -> str:
    return f"""begun AS (
  SELECT doc_id, pos, ch, CASE WHEN pos = 0 OR tag = 3 OR lag(tag) OVER (PARTITION BY doc_id ORDER BY pos) IN (2, 3) THEN 1 ELSE 0 END AS b FROM {tags}
), made AS (
  SELECT doc_id, sum(b) AS n, string_agg(CASE WHEN b = 1 AND pos > 0 THEN '|' || ch ELSE ch END, '' ORDER BY pos) AS j FROM begun GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n, md5(coalesce(j, '')) AS md5 FROM texts t LEFT JOIN made USING (doc_id) WHERE text IS NOT NULL"""


def _candidates_sql(at_end: bool) -> str:
    most = max(map(len, VOCABULARY))
    ahead = "".join(f" || coalesce(lead(ch, {k}) OVER w, '')" for k in range(1, most))
    grams = " UNION ALL ".join(f"SELECT pos{f' + {n - 1}' if at_end else ''} AS pos, left(g, {n}) AS word FROM ahead WHERE length(g) >= {n}" for n in sorted({len(w) for w in VOCABULARY}))
    known = ", ".join(map(_quoted, VOCABULARY))
    return f"WITH {_CHARS}, ahead AS (SELECT doc_id, pos, ch{ahead} AS g FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), grams AS ({grams}) SELECT word, count(*) AS n, sum(pos)::BIGINT AS places FROM grams WHERE word IN ({known}) GROUP BY word"


def _lists_sql(at_end: bool) -> str:
    most = max(map(len, VOCABULARY))
    way = "coalesce(lag(ch, {k}) OVER w, '') || " if at_end else " || coalesce(lead(ch, {k}) OVER w, '')"
    more = [way.format(k=k) for k in range(1, most)]
    text = "".join(reversed(more)) + "ch" if at_end else "ch" + "".join(more)
    cut = "right" if at_end else "left"
    each = [f"CASE WHEN length(g) >= {n} AND {cut}(g, {n}) IN ({', '.join(map(_quoted, VOCABULARY))}) THEN {cut}(g, {n}) END" for n in sorted({len(w) for w in VOCABULARY})]
    return f"""WITH {_CHARS}, around AS (SELECT {text} AS g FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
lists AS (SELECT list_filter([{', '.join(each)}], lambda x: x IS NOT NULL) AS l FROM around)
SELECT CASE WHEN len(l) = 0 THEN 'oov' ELSE array_to_string(l, '|') END AS words, count(*) AS n FROM lists GROUP BY 1"""


def _select_sql(condition: str) -> str:
    return f"""WITH {_WORDS}, tagged AS (SELECT doc_id, w, list_transform(w, lambda x: {_LABELS}[length(x) % 24 + 1]) AS p FROM words),
kept AS (SELECT doc_id, list_filter(list_zip(w, p), lambda x: {condition}) AS z FROM tagged)
SELECT doc_id, array_to_string(list_transform(z, lambda x: x[1]), ' ') AS words, array_to_string(list_transform(z, lambda x: x[2]), ' ') AS postags FROM kept"""


_SPACES = "rtrim({}, " + _quoted(t.SPACES) + ")"
_DROP, _TAKE = ("[" + ", ".join(map(_quoted, x)) + "]" for x in (DROP, TAKE))

#: The forms that the texts hold which NFKC changes: wide ASCII, narrow kana with their voice marks, what is not composed.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0xFF61, 0xFFA0)))
_KANA = "。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン\u3099\u309a"
_PLAIN = "".join(map(chr, range(0x21, 0x7F))) + _KANA
_IGNORED = r"[\p{Mn}\p{Me}\p{Cf}\p{Lm}\p{Sk}.:·’'']*"
_SIGMA = r"([\p{Lu}\p{Ll}\p{Lt}]" + _IGNORED + ")Σ(" + _IGNORED + r"(?:[^\p{L}]|$))"


def _normal(x: str) -> str:
    return f"translate(nfc_normalize(translate(rtrim({x}, {_quoted(t.SPACES)}), {_quoted(_WIDE + _NARROW)}, {_quoted(_PLAIN)})), 'İ ', 'I　')"


def _lower(x: str) -> str:
    return f"lower(regexp_replace(replace({x}, 'İ', 'I'), '{_SIGMA}', '\\1ς\\2', 'g'))"


def _alnum(x: str) -> str:
    return rf"regexp_full_match({x}, '[\p{{L}}\p{{N}}]+')"


_LETTERS = f"normal AS (SELECT doc_id, text AS given, {_normal('text')} AS text FROM texts), two AS (SELECT doc_id, text, {_lower('text')} AS low FROM normal WHERE text <> ''), chars AS (SELECT doc_id, unnest(string_split(text, '')) AS cased, unnest(string_split(low, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM two)"


def _rules_sql(lower: bool) -> str:
    """The words by the rules: (doc_id, k, word)."""
    most = max(map(len, RULE_WORDS))
    ahead = "ch" + "".join(f" || coalesce(lead(ch, {k}) OVER w, '')" for k in range(1, most))
    behind = " || ".join(f"coalesce(lag(ch, {k}) OVER w, '')" for k in range(most, 0, -1))
    starts = " OR ".join(f"starts_with(g, {_quoted(x)})" for x in RULE_WORDS)
    ends = " OR ".join(f"suffix(h, {_quoted(x)})" for x in RULE_WORDS)
    pairs, follow = ("(" + ", ".join(map(_quoted, x)) + ")" for x in (RULE_PAIRS, RULE_AHEAD))
    return f"""{_TEXTS}, {_LETTERS}, around AS (
  SELECT doc_id, pos, {'ch' if lower else 'cased'} AS c, {_TYPE} AS k, {ahead} AS g, {behind} AS h, lag(ch) OVER w || ch AS pair, lead(ch) OVER w AS next FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), begun AS (
  SELECT doc_id, pos, c, CASE WHEN pos = 0 OR k <> lag(k) OVER w OR {starts} OR {ends} OR pair IN {pairs} OR next IN {follow} THEN 1 ELSE 0 END AS b FROM around WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), numbered AS (
  SELECT doc_id, pos, c, sum(b) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM begun
), words AS (
  SELECT doc_id, k, string_agg(c, '' ORDER BY pos) AS word FROM numbered GROUP BY doc_id, k
)"""


def _labels_sql(words: str) -> str:
    """The labels by the rules, of (doc_id, k, word)."""
    marked = "right({}, 1) IN (" + ", ".join(map(_quoted, RULE_MARKS)) + ")"
    own = " ".join(f"WHEN {_quoted(w)} THEN {_quoted(label)}" for w, label in RULE_WORDS.items() if label)
    known = ", ".join(_quoted(w) for w, label in RULE_WORDS.items() if label)
    return f"""labels AS (SELECT doc_id, k, word, CASE WHEN {marked.format('lag(word) OVER w')} THEN '接続詞' WHEN {marked.format('word')} THEN '補助記号' WHEN {marked.format('lead(word) OVER w')} THEN '副詞'
  WHEN word IN ({known}) THEN CASE word {own} END WHEN word IN ({', '.join(map(_quoted, RULE_PARTICLES))}) THEN '助詞' WHEN {_alnum('word')} THEN '名詞' ELSE '未知語' END AS label
  FROM {words} WINDOW w AS (PARTITION BY doc_id ORDER BY k))"""


def _rule_words_sql(lower: bool) -> str:
    return f"""WITH {_rules_sql(lower)} SELECT t.doc_id, count(word)::BIGINT AS n, md5(coalesce(string_agg(word, '|' ORDER BY k), '')) AS md5
FROM texts t LEFT JOIN words w ON w.doc_id = t.doc_id WHERE text IS NOT NULL GROUP BY t.doc_id"""


def _rule_tagging_sql(lower: bool) -> str:
    return f"""WITH {_rules_sql(lower)}, {_labels_sql('words')} SELECT t.doc_id, count(word)::BIGINT AS n, md5(coalesce(string_agg(word, '|' ORDER BY k), '')) AS md5,
md5(coalesce(string_agg(label, '|' ORDER BY k), '')) AS labels_md5 FROM texts t LEFT JOIN labels w ON w.doc_id = t.doc_id WHERE text IS NOT NULL GROUP BY t.doc_id"""


ORACLE_SQL: dict[str, str] = {
    "rule_words": _rule_words_sql(False),
    "rule_words_lower": _rule_words_sql(True),
    "rule_tagging": _rule_tagging_sql(False),
    "rule_tagging_lower": _rule_tagging_sql(True),
    "rule_postagging": f"""WITH {_WORDS}, given AS (SELECT doc_id, unnest(w) AS raw, generate_subscripts(w, 1) AS k FROM words),
tokens AS (SELECT doc_id, k, CASE WHEN raw IN (' ', '　') THEN '　' ELSE {_normal('raw')} END AS word FROM given), {_labels_sql('tokens')}
SELECT doc_id, CASE WHEN bool_and(word <> '') THEN string_agg(label, '|' ORDER BY k) END AS postags FROM labels GROUP BY doc_id""",
    "rule_sql_functions": f"""WITH {_rules_sql(False)}, {_labels_sql('words')}, kept AS (SELECT * FROM labels WHERE label IN ('名詞', '補助記号'))
SELECT t.doc_id, coalesce(string_agg(word, '|' ORDER BY k), '') AS words, coalesce(string_agg(label, '|' ORDER BY k), '') AS postags FROM texts t LEFT JOIN kept w ON w.doc_id = t.doc_id WHERE text IS NOT NULL GROUP BY t.doc_id""",
    "vocabulary_sizes": f"SELECT len(list_distinct(string_split({_quoted(RULE_AHEAD + RULE_MARKS)}, '')))::INTEGER + 2 AS uni, {len(RULE_PAIRS)}::INTEGER + 2 AS bi, {len(RULE_WORDS)}::INTEGER + 2 AS word",
    "tagged_json": f"""WITH {_WORDS}, parsed AS (SELECT doc_id, to_json({{'words': w, 'postags': list_transform(w, lambda x: {_LABELS}[length(x) % 24 + 1])}}) AS j FROM words)
SELECT doc_id, array_to_string(j ->> '$.words[*]', '|') AS words, array_to_string(j ->> '$.postags[*]', '|') AS postags FROM parsed""",
    "preprocess_nfkc": f"WITH {_TEXTS} SELECT doc_id, {_normal('text')} AS text FROM texts",
    "lower_final_sigma": f"WITH {_TEXTS} SELECT doc_id, {_lower('text')} AS text FROM texts",
    "isalnum": f"WITH {_WORDS}, each AS (SELECT unnest(w) AS word FROM words) SELECT word, count(*) AS n, {_alnum('word')} AS alnum FROM each GROUP BY word",
    "rstrip_space_map": f"WITH {_TEXTS} SELECT doc_id, translate({_SPACES.format('text')}, 'İ ', 'I　') AS text FROM texts",
    "chartype_histogram": f"WITH {_CHARS} SELECT k::INTEGER AS char_type, count(ch)::BIGINT AS n FROM range(6) r(k) LEFT JOIN (SELECT ch, {_TYPE} AS x FROM chars) ON x = k GROUP BY k",
    "char_bigrams_end_marker": f"WITH {_CHARS}, pairs AS (SELECT ch || coalesce(lead(ch) OVER (PARTITION BY doc_id ORDER BY pos), '<E>') AS bigram FROM chars) SELECT bigram, count(*) AS n FROM pairs GROUP BY bigram",
    "context_window_pad": f"WITH {_CHARS}, kinds AS (SELECT doc_id, pos, {_TYPE} AS k FROM chars), around AS (SELECT lag(k, 1, 6) OVER w AS before, k AS here, lead(k, 1, 6) OVER w AS after FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT before, here, after, count(*) AS n FROM around GROUP BY ALL",
    "vocab_lookup_oov": f"WITH {_CHARS} SELECT CASE WHEN instr({_quoted(UNI)}, ch) > 0 THEN instr({_quoted(UNI)}, ch) + 1 ELSE 0 END::INTEGER AS id, count(*) AS n FROM chars GROUP BY 1",
    "word_start_candidates": _candidates_sql(False),
    "word_end_candidates": _candidates_sql(True),
    "word_start_lists": _lists_sql(False),
    "word_end_lists": _lists_sql(True),
    "bmes_assemble": f"WITH {_CHARS}, tags AS (SELECT doc_id, pos, ch, unicode(ch) % 4 AS tag FROM chars), " + _assembled("tags"),
    "dictionary_spans": f"WITH {_PIECES} SELECT t.doc_id, count(start)::BIGINT AS n, coalesce(string_agg(start || ':' || len, ',' ORDER BY k), '') AS spans FROM texts t LEFT JOIN found f ON f.doc_id = t.doc_id WHERE text IS NOT NULL GROUP BY t.doc_id",
    "force_span_tags": f"WITH {_FORCED} SELECT t.doc_id, count(tag)::BIGINT AS n, md5(coalesce(string_agg(tag::VARCHAR, '' ORDER BY pos), '')) AS md5 FROM texts t LEFT JOIN tags x ON x.doc_id = t.doc_id WHERE text IS NOT NULL GROUP BY t.doc_id",
    "dictionary_segment": f"WITH {_FORCED}, " + _assembled("tags"),
    "postag_filter": _select_sql(f"NOT list_contains({_DROP}, x[2])"),
    "postag_extract": _select_sql(f"list_contains({_TAKE}, x[2])"),
    "postag_empty_lists": f"WITH {_WORDS} SELECT doc_id, len(w)::INTEGER AS n_filtered, 0 AS n_extracted FROM words",
    "stopword_remove": f"WITH {_WORDS}, kept AS (SELECT doc_id, list_filter(w, lambda x: NOT list_contains([{', '.join(map(_quoted, STOPWORDS))}], x)) AS w FROM words) SELECT doc_id, len(w)::BIGINT AS n, array_to_string(w, ' ') AS words FROM kept",
    "postag_labels": f"SELECT unnest(range(24))::INTEGER AS id, unnest({_LABELS}) AS label",
    "postag_parse": f"WITH {_WORDS}, all_ AS (SELECT unnest(w) AS label FROM words UNION ALL SELECT unnest({_LABELS})) SELECT CASE WHEN list_position({_LABELS}, label) > 0 THEN (list_position({_LABELS}, label) - 1)::INTEGER END AS id, count(*) AS n FROM all_ GROUP BY 1",
    "argmax_first_wins": "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS best FROM embeddings",
    "token_normalize": f"WITH {_WORDS}, made AS (SELECT doc_id, list_transform(w, lambda x: CASE WHEN x IN (' ', '　') THEN '　' ELSE translate({_SPACES.format('x')}, 'İ ', 'I　') END) AS m FROM words) SELECT doc_id, CASE WHEN NOT list_contains(m, '') THEN array_to_string(m, '|') END AS tokens FROM made",
    "words_json": f"WITH {_WORDS}, parsed AS (SELECT doc_id, to_json(w) ->> '$[*]' AS p FROM words) SELECT doc_id, len(p)::BIGINT AS n, md5(array_to_string(p, '|')) AS md5 FROM parsed",
    "token_counts": f"WITH {_WORDS}, each AS (SELECT unnest(w) AS word FROM words) SELECT word, count(*) AS n FROM each GROUP BY word",
}
