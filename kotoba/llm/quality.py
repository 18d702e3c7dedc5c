"""Operator 7: line-first quality rules.

Every line is judged on its own by rules on punctuation, navigation, boilerplate, shouting, symbols and repetition.
Lines that fail go; a document that loses too many of its words with them goes as a whole.

Defined results: a null text has no words and fails the base; empty and blank lines are neither judged nor lost;
repeated rows give repeated results; columns other than those named are not read by the scoring, and filtering keeps
them as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import WORD, bounded_batches, per_slice, table, text_or_empty

SYMBOLS = "#*$%&|<>"
SCORED = (
    "doc_id long, text string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_lines_failed long, words_lost long, cleaned string, "
    "failed_rules array<string>"
)


@dataclass(frozen=True)
class Rules:
    """Thresholds and word lists. A line fails by the first rule that holds, in the order of `verdict`."""

    min_words: int = 50  # base: fewer words fail
    max_repeat_percent: int = 50  # base: more words than this in repeated three-word windows fail
    terminal: str = ".!?…:;\"'”’»)]。！？」"  # marks a sentence may end with
    long_line: int = 40  # lines of so many words are prose even without such a mark
    separators: tuple[str, ...] = ("|", "»", "›", "•", "·", "→")
    max_separator_share: float = 0.2  # separators that stand alone, by words of the line
    max_symbol_share: float = 0.3  # words with a character of SYMBOLS
    max_shout_share: float = 0.5  # words of two letters or more that are all capitals
    min_shout_words: int = 4
    max_one_word_share: float = 0.5  # the commonest neighbour pair "w w" in lines of min_shout_words or more
    boilerplate: tuple[str, ...] = field(
        default=(
            "javascript", "lorem ipsum", "cookie policy", "privacy policy", "terms of use", "terms of service", "use cookies", "all rights reserved", "click here", "sign up", "log in", "subscribe to",
            "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies", "hier klicken", "newsletter abonnieren",
            "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "utilise des cookies", "cliquez ici", "abonnez-vous",
            "todos los derechos reservados", "política de privacidad", "condiciones de uso", "utiliza cookies", "haga clic aquí", "suscríbete",
        )
    )
    boilerplate_words: int = 25  # longer lines aren't boilerplate as a whole
    max_lost_share: float = 0.5  # of the words: a document that loses more goes


def verdict(line: str, words: list[str], rules: Rules) -> str:
    """The rule by which a line with words fails, or ''."""
    n = len(words)
    if n <= rules.boilerplate_words:
        low = line.lower()
        if any(x in low for x in rules.boilerplate):
            return "boilerplate"
    alone = sum(w in rules.separators for w in words)
    if alone and alone > rules.max_separator_share * n:
        return "navigation"
    if sum(any(c in w for c in SYMBOLS) for w in words) > rules.max_symbol_share * n:
        return "symbols"
    if n >= rules.min_shout_words:
        if sum(len(w) > 1 and w.isupper() for w in words) > rules.max_shout_share * n:
            return "shouting"
        if sum(a == b for a, b in zip(words, words[1:], strict=False)) > rules.max_one_word_share * (n - 1):
            return "repetition"
    if n < rules.long_line and words[-1][-1] not in rules.terminal:
        return "punctuation"
    return ""


class Scorer:
    def __init__(self, rules: Rules):
        self.rules = rules
        self.words = re.compile(WORD).findall
        self.symbols = re.compile("[" + re.escape(SYMBOLS) + "]").findall

    def base(self, text: str, words: list[str]) -> tuple[int, int, int, int, int]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
        lines = Counter(x for x in text.split("\n") if self.words(x)) if "\n" in text else {}
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        repeated, end = 0, 0
        if len(windows) < len(words) - 2:
            for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)):
                if windows[w] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
        return len(words), sum(map(len, words)), len(self.symbols(text)), sum(lines.values()) - len(lines), repeated

    def lines(self, text: str) -> tuple[int, int, int, str, list[str]]:
        """Lines with words, those that fail, the words lost with them, the text without them, and the rules that failed."""
        total = failed = lost = 0
        kept, why = [], set()
        for line in text.split("\n"):
            words = self.words(line)
            if words:
                total += 1
                if rule := verdict(line, words, self.rules):
                    failed += 1
                    lost += len(words)
                    why.add(rule)
                    continue
            kept.append(line)
        return total, failed, lost, "\n".join(kept), sorted(why)

    def score(self, text: str | None) -> tuple:
        text = text or ""
        base = self.base(text, self.words(text))
        base_failed = base[0] < self.rules.min_words or 100 * base[4] > self.rules.max_repeat_percent * base[0]
        total, failed, lost, cleaned, why = self.lines(text)
        kept = not base_failed and lost <= self.rules.max_lost_share * base[0]
        return *base, base_failed, kept, total, failed, lost, cleaned, why


def score_documents(docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """For each row of docs its id, text, counts, verdicts and the text without the lines that fail."""
    bounded_batches(docs.sparkSession)
    names = [x.split()[0] for x in SCORED.split(", ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = Scorer(rules)
        columns = list(zip(*map(scorer.score, batch.column("text").to_pylist()), strict=True))
        kinds = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), *[pa.int64()] * 3, pa.string(), pa.list_(pa.string())]
        columns = columns or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *map(pa.array, columns, kinds)], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(per_slice(run), SCORED)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts for every document."""
    return score_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_failed", "words_lost"
    )


def _sql(rules: Rules = Rules()) -> str:  # noqa: B008
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    any_of = " OR ".join(f"contains(lower(line), {quoted(x)})" for x in rules.boilerplate)
    separators = ", ".join(map(quoted, rules.separators))
    return rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), worded AS (
  SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), measured AS (
  SELECT doc_id, line, w, len(w) AS n, len(list_filter(w, lambda x: x IN ({separators}))) AS alone,
    len(list_filter(w, lambda x: regexp_matches(x, '[{SYMBOLS}]'))) AS marked, len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS loud,
    len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS twins FROM worded
), judged AS (
  SELECT *, n <= {rules.boilerplate_words} AND ({any_of})
    OR alone > 0 AND alone > {rules.max_separator_share}::DOUBLE * n OR marked > {rules.max_symbol_share}::DOUBLE * n
    OR n >= {rules.min_shout_words} AND (loud > {rules.max_shout_share}::DOUBLE * n OR twins > {rules.max_one_word_share}::DOUBLE * (n - 1))
    OR n < {rules.long_line} AND NOT contains({quoted(rules.terminal)}, right(w[-1], 1)) AS failed FROM measured
), by_line AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (WHERE failed) AS n_lines_failed,
    coalesce(sum(n) FILTER (WHERE failed), 0) AS words_lost FROM judged GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
), windows AS (
  SELECT doc_id, i, word, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS x FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), often AS (
  SELECT doc_id, i, word, CASE WHEN x IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, x) > 1 THEN 1 ELSE 0 END AS r FROM windows
), covered AS (
  SELECT doc_id, word, max(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM often
), by_word AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, sum(c) AS n_repeat_words FROM covered GROUP BY doc_id
), whole AS (
  SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(coalesce(text, ''), '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_lines_failed, 0)::BIGINT AS n_lines_failed, coalesce(words_lost, 0)::BIGINT AS words_lost
  FROM documents d LEFT JOIN by_line l ON l.doc_id = d.doc_id LEFT JOIN by_word w ON w.doc_id = d.doc_id
), based AS (
  SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM whole
)
SELECT *, NOT base_failed AND words_lost <= {rules.max_lost_share}::DOUBLE * n_words AS kept FROM based
"""


OP7_SQL = _sql()


def clean_documents(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:  # noqa: B008
    """The rows of docs whose document the rules keep, with all their columns and the text without the lines that
    fail. All this is a function of the text alone, so rows are judged where they are, without a shuffle."""
    bounded_batches(docs.sparkSession)
    names, schema = docs.columns, docs.schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scored = list(map(Scorer(rules).score, batch.column(text).to_pylist()))
        texts = pa.array([x[10] for x in scored], pa.string())
        whole = pa.RecordBatch.from_arrays([texts if c == text else batch.column(c) for c in names], names)
        return whole.filter(pa.array([x[6] for x in scored], pa.bool_()))

    return docs.mapInArrow(per_slice(run, text), schema)
