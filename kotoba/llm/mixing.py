"""Operator 4: mixing sources to target weights, in DataFrame functions alone.

Iterative proportional fitting (raking) with an upper bound: every cell (source, language, topic) gets a probability
min(1, a_source * b_language * c_topic) such that the tokens expected in the sample are `rate` of all and meet the target
share of each source, each language and each topic. Where there is less than a target asks for, all of it is taken, and
the other targets grow by one factor to fill the budget. Documents are then sampled by the probability of their cell.

A source's factor is exact in every round; those of languages and topics take Newton steps until all margins are met to
TOLERANCE of the budget. Targets that can't be met together end with a warning, the sources' being met. The query
op4_mixing takes the fixed rounds and steps of Targets instead, as OP4_SQL has them, which need not get there.

Sources may be many; languages and topics are declared lists (others count as OTHER). So the factors of languages and
topics are a few numbers in the plan, those of sources are computed where the source's cells are, and each round is one
aggregate of the source table whose result has a row for each pair of language and topic. Documents of a source are
counted by partial sums, so a hot source is a few rows in the shuffle. Weights reach the documents by a join, with a
broadcast only where the counted cells are few, else by a shuffle that splits skew.

Defined results: null sources, languages and texts count as '', OTHER and no tokens; a document without tokens has the
probability of its cell; cells, languages or topics without tokens have no part in the fit, and targets are scaled to what
is there; an empty table gives an empty result; rows with the same id share their fate; extra columns stay, but for
those named as the columns of results, which are replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import WORD, fresh, table, text_or_empty, written

OTHER = "other"
#: Cells up to which their weights are broadcast: some 100 bytes each, so 2 MB at most.
BROADCAST_CELLS = 20_000
#: The largest distance of a margin from its target, as a share of the budget.
TOLERANCE = 1e-5
#: Rounds in which the distance must shrink by a tenth, else the targets can't be met together.
PATIENCE = 20
#: Bound of the factors of languages and topics, for targets that can't be met together.
LARGEST = 1e9
#: Topics by the first pattern that a text holds.
TOPICS: tuple[tuple[str, str], ...] = (("legal", r"(?i)licen[cs]e|copyright|all rights reserved"), ("contact", r"@|https?://"), ("tabular", r" \| "), ("general", r""))


@dataclass(frozen=True)
class Targets:
    """Target shares. Sources not named share what is left in proportion to tokens ** source_power."""

    sources: Mapping[str, float] = field(default_factory=dict)
    source_power: float = 0.7
    languages: Mapping[str, float] = field(default_factory=lambda: {"en": 0.5, "de": 0.17, "fr": 0.17, "es": 0.13, OTHER: 0.03})
    topics: Mapping[str, float] = field(default_factory=lambda: {"general": 0.8, "legal": 0.06, "contact": 0.1, "tabular": 0.04})
    rate: float = 0.5  # tokens expected in the sample, of all
    iterations: int = 12
    inner: int = 4  # steps by which a source's factor settles in each round


def topic_of(text: Column) -> Column:
    out = F.lit(TOPICS[-1][0])
    for name, pattern in reversed(TOPICS[:-1]):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _pick(values: Mapping[str, float], key: Column) -> Column:
    """The number that belongs to a key, of a few."""
    out = F.lit(0.0)
    for name, value in values.items():
        out = F.when(key == name, F.lit(float(value))).otherwise(out)
    return out


#: What marked() adds to documents, by names that these have not.
MARKS = ("source", "lang", "topic", "tokens")


def marked(docs: DataFrame, targets: Targets, names: tuple[str, ...], text: str = "text", source: str = "source", lang: str = "lang", topic: str | None = None, tokens: str | None = None) -> DataFrame:
    """docs with the columns of MARKS under the given names. The topic is that of a column, where one is named, else that
    of TOPICS; a topic that isn't declared counts as OTHER. Tokens are those of a column, or words of the text."""
    body = None if topic and tokens else text_or_empty(text)
    declared = lambda name, values: F.when(F.col(name).isin(*[x for x in values if x != OTHER]), F.col(name)).otherwise(F.lit(OTHER))
    made = (
        F.coalesce(F.col(source).cast("string"), F.lit("")),
        declared(lang, targets.languages),
        declared(topic, targets.topics) if topic else topic_of(body),
        F.coalesce(F.col(tokens), F.lit(0)).cast("long") if tokens else F.regexp_count(body, F.lit(WORD)).cast("long"),
    )
    return docs.select("*", *[x.alias(name) for x, name in zip(made, names, strict=True)])


def _scaled(shares: Mapping[str, float], present: Mapping[str, float]) -> dict[str, float]:
    """Shares of those present, summing up to 1."""
    some = {k: shares.get(k, 0.0) for k, v in present.items() if v > 0}
    total = sum(some.values())
    return {k: v / total for k, v in some.items()} if total else {k: 1 / len(some) for k in some}


def _filled(shares: Mapping[str, float], present: Mapping[str, float], budget: float) -> dict[str, float]:
    """Tokens of each present: its share of the budget or all there is, what is short being shared by the others."""
    left, out = dict(shares), {}
    while left:
        scale = (budget - sum(out.values())) / (sum(left.values()) or 1.0)
        full = [k for k, v in left.items() if v * scale >= present[k]]
        if not full:
            return out | {k: v * scale for k, v in left.items()}
        out |= {k: present[k] if left[k] else 0.0 for k in full}
        left = {k: v for k, v in left.items() if k not in full}
    return out


def _moved(factor: float, target: float, capped: float, loose: float) -> float:
    """A language's or topic's factor after one step, its cells holding capped tokens at their bound and loose ones below
    it. The tokens held are concave in the factor, so neither kind of step leaves the target's side."""
    if target <= 0:
        return 0.0
    if capped + loose > target:
        return factor * target / (capped + loose)
    return min(LARGEST, factor * (target - capped) / loose) if loose > 0 else factor


def cell_weights(rows: DataFrame, targets: Targets, settled: bool = True) -> DataFrame:
    """(source, lang, topic, weight, probability) of every cell of rows (source, lang, topic, tokens); if not settled,
    after the fixed numbers of rounds and steps."""
    cells = rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").cast("double").alias("tokens"))
    # a source has a cell for each declared language and topic at most
    by_source = cells.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("lang", "topic", "tokens"))).alias("cells"), F.sum("tokens").alias("supply"))
    sources = written(by_source, "sources")

    named = dict(targets.sources)
    pairs = sources.select(F.inline("cells")).groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).collect()
    langs, topics = ({k: sum(r["tokens"] for r in pairs if r[by] == k) for k in sorted({r[by] for r in pairs})} for by in ("lang", "topic"))
    budget = sum(langs.values()) * targets.rate
    share_of = _pick(named, F.col("source"))
    is_named = F.col("source").isin(*named) if named else F.lit(False)
    some = F.col("supply") > 0
    free = F.when(some & ~is_named, F.pow("supply", F.lit(targets.source_power))).otherwise(0.0)
    sums = sources.agg(F.sum(F.when(some & is_named, share_of).otherwise(0.0)).alias("named"), F.sum(free).alias("free")).collect()[0]
    given, spare = sums["named"] or 0.0, sums["free"] or 0.0
    rest = max(0.0, 1.0 - given) if spare else 0.0
    share = F.when(some & is_named, share_of / F.lit(given + rest or 1.0)).otherwise(free * F.lit(rest / (spare or 1.0) / (given + rest or 1.0)))
    want_l, want_t = _scaled(targets.languages, langs), _scaled(targets.topics, topics)
    b, c = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0)
    if settled and budget:
        reach = sources.agg(F.sum(F.when(share > 0, F.col("supply"))).alias("t")).collect()[0]["t"] or 0.0
        budget = min(budget, reach, *(sum(present[k] for k, v in want.items() if v) for want, present in ((want_l, langs), (want_t, topics))))
    target = share * F.lit(budget)
    if settled and budget:
        scale = 1.0
        while True:  # of the sources that have more than their targets
            full = F.col("supply") <= target * F.lit(scale)
            got = sources.where(share > 0).agg(F.sum(F.when(full, F.col("supply")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(share)).alias("loose")).collect()[0]
            more = (budget - got["full"]) / (got["loose"] * budget) if got["loose"] else scale
            if more <= scale * (1 + 1e-12):
                break
            scale = more
        target = F.least(target * F.lit(scale), F.col("supply"))

    def factor(b: dict[str, float], c: dict[str, float]) -> Column:
        """A source's factor, given those of languages and topics. Settled: as the tokens held are concave in it and have
        a bend for each cell, Newton's steps from below pass a bend each or end."""
        bc = lambda x: _pick(b, x["lang"]) * _pick(c, x["topic"])
        free = F.aggregate("cells", F.lit(0.0), lambda s, x: s + bc(x) * x["tokens"])
        first = F.when(free > 0, target / free).otherwise(F.lit(0.0))

        def step(a: Column, _: Column) -> Column:
            held = F.aggregate("cells", F.lit(0.0), lambda s, x: s + F.least(F.lit(1.0), a * bc(x)) * x["tokens"])
            return F.coalesce(a * target / F.nullif(held, F.lit(0.0)), F.lit(0.0))

        def newton(a: Column, _: Column) -> Column:
            at_bound = F.aggregate("cells", F.lit(0.0), lambda s, x: s + F.when(a * bc(x) >= 1.0, x["tokens"]).otherwise(0.0))
            slope = F.aggregate("cells", F.lit(0.0), lambda s, x: s + F.when(a * bc(x) >= 1.0, 0.0).otherwise(bc(x) * x["tokens"]))
            return F.when(slope > 0, F.greatest(a, (target - at_bound) / slope)).otherwise(a)

        if settled:
            return F.aggregate(F.sequence(F.lit(1), F.size("cells") + 1), first, newton)
        return F.aggregate(F.sequence(F.lit(1), F.lit(targets.inner)), first, step)

    weight = lambda b, c: F.col("a") * (_pick(b, F.col("lang")) * _pick(c, F.col("topic")))
    best, since = float("inf"), 0
    goal_l, goal_t = (_filled(want, present, budget) if settled and budget else {} for want, present in ((want_l, langs), (want_t, topics)))
    while settled and budget:
        held = sources.select(factor(b, c).alias("a"), "cells").select("a", F.inline("cells"))
        at_bound = weight(b, c) >= 1.0
        now = held.groupBy("lang", "topic").agg(F.sum(F.when(at_bound, F.col("tokens")).otherwise(0.0)).alias("capped"), F.sum(F.when(at_bound, 0.0).otherwise(weight(b, c) * F.col("tokens"))).alias("loose")).collect()
        now = sorted((r["lang"], r["topic"], r["capped"], r["loose"]) for r in now)
        sums = lambda i, k, of: sum(r[of] for r in now if r[i] == k)
        far = max(abs(sums(i, k, 2) + sums(i, k, 3) - v) for i, goal in ((0, goal_l), (1, goal_t)) for k, v in goal.items()) / budget
        if far <= TOLERANCE:
            break
        best, since = (far, 0) if far < best * 0.9 else (best, since + 1)
        if since == PATIENCE:
            warnings.warn(f"mixing: targets can't be met together, a margin is off by {far:.2%} of the budget", stacklevel=2)
            break
        # languages and topics without a goal have no tokens
        moved = {k: _moved(b[k], goal_l.get(k, 0.0), sums(0, k, 2), sums(0, k, 3)) for k in b}
        ratio = {k: moved[k] / b[k] if b[k] else 0.0 for k in b}
        now = [(l, t, capped, loose * ratio[l]) for l, t, capped, loose in now]
        b, c = moved, {k: _moved(c[k], goal_t.get(k, 0.0), sums(1, k, 2), sums(1, k, 3)) for k in c}
    for _ in range(targets.iterations if budget and not settled else 0):
        held = sources.select(factor(b, c).alias("a"), "cells").select("a", F.inline("cells"))
        now = held.groupBy("lang", "topic").agg(F.sum(F.least(F.lit(1.0), weight(b, c)) * F.col("tokens")).alias("m")).collect()
        m = {(r["lang"], r["topic"]): r["m"] for r in sorted(now, key=lambda r: (r["lang"], r["topic"]))}
        sums_l = {x: sum(v for (y, _), v in m.items() if y == x) for x in b}
        steps = {x: want_l.get(x, 0.0) * budget / sums_l[x] if sums_l[x] > 0 else 0.0 for x in b}
        sums_t = {x: sum(v * steps[k] for (k, y), v in m.items() if y == x) for x in c}
        b = {x: b[x] * steps[x] for x in b}
        c = {x: c[x] * (want_t.get(x, 0.0) * budget / sums_t[x] if sums_t[x] > 0 else 0.0) for x in c}
    out = sources.select("source", factor(b, c).alias("a"), F.inline("cells")).select("source", "lang", "topic", weight(b, c).alias("weight"))
    return out.withColumn("probability", F.least(F.lit(1.0), F.col("weight")))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the id alone, alike in every run and on every machine."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def _weighed(docs: DataFrame, targets: Targets, seed: str, doc_id: str, text: str, source: str, lang: str, topic: str | None, tokens: str | None, settled: bool) -> tuple[DataFrame, dict[str, Column]]:
    """docs with columns of our own, and what mix() makes of them."""
    names = fresh(docs, *MARKS, "weight", "probability")
    rows = marked(docs, targets, names[:4], text, source, lang, topic, tokens)
    counted = rows.select(*[F.col(n).alias(m) for n, m in zip(names, MARKS, strict=False)])
    weights = written(cell_weights(counted, targets, settled), "weights").toDF(*names[:3], *names[4:])
    if weights.count() <= BROADCAST_CELLS:
        weights = F.broadcast(weights)
    made = {"topic": F.col(names[2]), "n_tokens": F.col(names[3]), "weight": F.col(names[4]), "probability": F.col(names[5]), "sampled": uniform(F.col(doc_id), seed) < F.col(names[5])}
    return rows.join(weights, list(names[:3]), "left"), made


def mix(docs: DataFrame, targets: Targets = Targets(), seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str | None = None, tokens: str | None = None, settled: bool = True) -> DataFrame:  # noqa: B008
    """docs with topic, n_tokens, weight, probability and sampled, which replace columns of these names. `topic` names a
    column that holds the topics, as a classifier gives them, and `tokens` one with their number; without them the topics are
    those of TOPICS and the tokens words."""
    rows, made = _weighed(docs, targets, seed, doc_id, text, source, lang, topic, tokens, settled)
    return rows.select(*[F.col(c) for c in docs.columns if c not in made], *[x.alias(n) for n, x in made.items()])


def sampled(docs: DataFrame, targets: Targets = Targets(), seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str | None = None, tokens: str | None = None) -> DataFrame:  # noqa: B008
    """The rows of docs that mix() samples, with their own columns alone."""
    rows, made = _weighed(docs, targets, seed, doc_id, text, source, lang, topic, tokens, True)
    return rows.where(made["sampled"]).select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its calibrated probability, as OP4_SQL has it, and whether it is sampled."""
    body = text_or_empty()
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", topic_of(body).alias("topic"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("n_tokens"))
    # written, so the texts are read once for the counts and the result
    out = mix(written(docs, "marks"), topic="topic", tokens="n_tokens", settled=False)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


def _sql(targets: Targets = Targets(), seed: str = "mix") -> str:  # noqa: B008
    langs = ", ".join(f"('{k}', {float(v)!r}::DOUBLE)" for k, v in targets.languages.items())
    topics = ", ".join(f"('{k}', {float(v)!r}::DOUBLE)" for k, v in targets.topics.items())
    known = ", ".join(f"'{x}'" for x in targets.languages if x != OTHER)
    topic = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{name}'" for name, p in TOPICS[:-1])
    steps = []
    for k in range(targets.iterations + 1):
        steps.append(f"x{k} AS MATERIALIZED (SELECT c0.*, w.share * budget AS target, b * c AS bc FROM c0 JOIN b{k} USING (lang) JOIN t{k} USING (topic) JOIN want_source w ON w.k = source, whole)")
        steps.append(f"a{k}_0 AS MATERIALIZED (SELECT source, coalesce(any_value(target) / nullif(sum(bc * tokens), 0), 0) AS a FROM x{k} GROUP BY source)")
        for i in range(targets.inner):
            steps.append(f"a{k}_{i + 1} AS MATERIALIZED (SELECT source, coalesce(any_value(a) * any_value(target) / nullif(sum(least(1.0, a * bc) * tokens), 0), 0) AS a FROM x{k} JOIN a{k}_{i} USING (source) GROUP BY source)")
        if k < targets.iterations:
            steps.append(f"m{k} AS MATERIALIZED (SELECT lang, topic, sum(least(1.0, a * bc) * tokens) AS m FROM x{k} JOIN a{k}_{targets.inner} USING (source) GROUP BY lang, topic)")
            steps.append(f"r{k} AS MATERIALIZED (SELECT lang, coalesce(coalesce(any_value(w.share), 0) * any_value(budget) / nullif(sum(m), 0), 0) AS r FROM m{k} LEFT JOIN want_lang w ON w.k = lang, whole GROUP BY lang)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT lang, b * r AS b FROM b{k} JOIN r{k} USING (lang))")
            steps.append(f"t{k + 1} AS MATERIALIZED (SELECT topic, any_value(c) * coalesce(coalesce(any_value(w.share), 0) * any_value(budget) / nullif(sum(m * r), 0), 0) AS c FROM m{k} JOIN r{k} USING (lang) JOIN t{k} USING (topic) LEFT JOIN want_topic w ON w.k = topic, whole GROUP BY topic)")
    last = targets.iterations
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, lang, coalesce(source, '') AS s, CASE WHEN lang IN ({known}) THEN lang ELSE '{OTHER}' END AS l,
    CASE {topic} ELSE '{TOPICS[-1][0]}' END AS topic, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
  FROM documents
), c0 AS MATERIALIZED (SELECT s AS source, l AS lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
whole AS (SELECT sum(tokens) * {targets.rate} AS budget FROM c0),
b0 AS (SELECT DISTINCT lang, 1.0::DOUBLE AS b FROM c0), t0 AS (SELECT DISTINCT topic, 1.0::DOUBLE AS c FROM c0),
want_source AS MATERIALIZED (SELECT source AS k, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {targets.source_power}) ELSE 0 END / sum(CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {targets.source_power}) ELSE 0 END) OVER () AS share FROM c0 GROUP BY source),
want_lang AS MATERIALIZED (SELECT k, share / sum(share) OVER () AS share FROM (VALUES {langs}) AS v(k, share) WHERE k IN (SELECT lang FROM c0 GROUP BY lang HAVING sum(tokens) > 0)),
want_topic AS MATERIALIZED (SELECT k, share / sum(share) OVER () AS share FROM (VALUES {topics}) AS v(k, share) WHERE k IN (SELECT topic FROM c0 GROUP BY topic HAVING sum(tokens) > 0)),
{', '.join(steps)}, chances AS (SELECT x.source, x.lang, x.topic, least(1.0, a * bc) AS p FROM x{last} x JOIN a{last}_{targets.inner} USING (source))
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(p, 6) AS probability,
  ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / {float(16**13)!r} < p AS sampled
FROM d JOIN chances c ON c.source = d.s AND c.lang = d.l AND c.topic = d.topic
"""


OP4_SQL = _sql()
