"""Rule-based steps as Catalyst expressions: trimming, character types, tag decoding, word assembly, selection."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import POS_LABELS, TAGGED_DDL, parse_label

#: The 29 code points that end-of-text trimming removes.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WIDE_SPACE = "　"
#: Marks where words begin while a text is assembled; a text's own NUL is kept meanwhile as private characters.
CUT, SAVED = "\x00", "\U0010fffe\U0010ffff"
B, M, E, S = range(4)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_end(text: Column | str) -> Column:
    return F.rtrim(_col(text), F.lit(SPACES))


def map_spaces(text: Column | str) -> Column:
    """The dotted capital I becomes I and the ASCII space the wide one; one character each, after NFKC."""
    return F.translate(_col(text), "İ ", "I" + WIDE_SPACE)


def chars(text: Column | str) -> Column:
    """Code points as an array; none for the empty text."""
    t = _col(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ""))


def char_type(ch: Column) -> Column:
    """0 hiragana, 1 katakana, 2 kanji, 3 ASCII letter, 4 ASCII digit, 5 other."""
    code = F.ascii(ch)
    return (
        F.when(code.between(0x3040, 0x309F), 0).when(code.between(0x30A1, 0x30FA), 1).when(code.between(0x4E00, 0x9FA5), 2)
        .when(code.between(65, 90) | code.between(97, 122), 3).when(code.between(48, 57), 4).otherwise(5)
    )


#: The same types as classes of a regular expression, for counting without splitting a text.
TYPE_CLASSES: tuple[str, ...] = ("[぀-ゟ]", "[ァ-ヺ]", "[一-龥]", "[A-Za-z]", "[0-9]")


def type_counts(text: Column | str) -> Column:
    """How many characters of each of the six types a text has."""
    t = _col(text)
    known = [F.regexp_count(t, F.lit(x)).cast("long") for x in TYPE_CLASSES]
    rest = F.length(t).cast("long")
    for x in known:
        rest = rest - x
    return F.array(*known, rest)


def decode_tags(tags: Column) -> Column:
    """Whether a word begins, for each place: at the start, at S, and after E or S."""
    before = F.concat(F.array(F.lit(S)), F.slice(tags, 1, F.greatest(F.size(tags) - 1, F.lit(0))))
    return F.zip_with(tags, F.slice(before, 1, F.size(tags)), lambda t, b: (t == S) | b.isin(E, S))


def assemble(characters: Column, tags: Column) -> Column:
    """The words of a text by its BMES tags. Any other tag continues a word. Marks are put where words begin and the
    text is split there, so the time is linear."""
    marked = F.zip_with(characters, decode_tags(tags), lambda c, new: F.concat(F.when(new, F.lit(CUT)).otherwise(F.lit("")), F.when(c == CUT, F.lit(SAVED)).otherwise(c)))
    words = F.transform(F.split(F.substr(F.array_join(marked, ""), F.lit(2)), CUT), lambda w: F.replace(w, F.lit(SAVED), F.lit(CUT)))
    return F.when(F.size(characters) == 0, F.array().cast("array<string>")).otherwise(words)


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, though fn uses it inside lambdas for every element."""
    return F.transform(F.array(value), fn)[0]


def word_tags(length: Column) -> Column:
    """The tags of one word of a length."""
    return F.when(length == 1, F.array(F.lit(S))).otherwise(F.concat(F.array(F.lit(B)), F.array_repeat(F.lit(M), F.greatest(length - 2, F.lit(0)).cast("int")), F.array(F.lit(E))))


def forced_tags(tags: Column, forced: Column) -> Column:
    """Tags in which places with a forced tag (0 or more; -1: none) have it, and the words next to forced ones end and
    begin there: before one B becomes S and M becomes E, after it M becomes B and E becomes S, the latter first where
    a place lies between two."""

    def repaired(f: Column, t: Column, i: Column) -> Column:
        after = F.when(F.get(f, i - 1).isin(E, S), F.when(t == M, B).when(t == E, S).otherwise(t)).otherwise(t)
        before = F.when(F.get(f, i + 1).isin(B, S), F.when(after == B, S).when(after == M, E).otherwise(after)).otherwise(after)
        return F.when(F.get(f, i) >= 0, F.get(f, i)).otherwise(before)

    return let(forced, lambda f: F.transform(tags, lambda t, i: repaired(f, t, i)))


def force_spans(tags: Column, spans: Column) -> Column:
    """forced_tags() for spans array<struct<start, length>> in order and without overlap."""
    none = lambda n: F.array_repeat(F.lit(-1), n.cast("int"))
    ends = F.transform(spans, lambda s: s["start"] + s["length"])
    before = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
    parts = F.zip_with(spans, before, lambda s, b: F.concat(none(s["start"] - b), word_tags(s["length"])))
    forced = F.concat(F.flatten(parts), none(F.size(tags) - F.element_at(ends, -1)))
    return F.when((F.size(tags) == 0) | (F.size(spans) == 0), tags).otherwise(forced_tags(tags, forced))


def argmax(values: Column | str) -> Column:
    """The place of the greatest value, from 0; the first of equal ones; null for none."""
    v = _col(values)
    return F.when(F.size(v) > 0, F.array_position(v, F.array_max(v)).cast("int") - 1)


def viterbi(emissions: Column, transitions: Sequence[Sequence[float]]) -> Column:
    """The best tag path (array<int>) of emissions array<array<double>>, six states of which 4 begins and 5 ends;
    transitions[next][prev]; the first of equal predecessors wins. For texts of a few hundred characters: longer ones
    go through the batched kernel."""
    low = -1e10
    states = len(transitions)
    first = F.array(*[F.lit(0.0 if k == 4 else low) for k in range(states)])
    pairs = "array<int>"

    def pick(score: Column, row: Sequence[float]) -> Column:
        return F.transform(score, lambda s, i: s + F.element_at(F.array(*map(F.lit, map(float, row))), i + 1))

    def step(acc: Column, obs: Column) -> Column:
        options = [pick(acc["score"], row) for row in transitions]
        best = F.array(*[F.array_max(o) for o in options])
        back = F.array(*[(F.array_position(o, F.array_max(o)) - 1).cast("int") for o in options])
        return F.named_struct(F.lit("score"), F.zip_with(best, obs, lambda a, b: a + b), F.lit("back"), F.concat(acc["back"], F.array(back)))

    def finish(acc: Column) -> Column:
        final = pick(acc["score"], transitions[5])
        last = (F.array_position(final, F.array_max(final)) - 1).cast("int")
        start = F.named_struct(F.lit("at"), last, F.lit("path"), F.array(last))
        traced = F.aggregate(F.reverse(acc["back"]), start, lambda s, b: F.named_struct(F.lit("at"), F.element_at(b, s["at"] + 1), F.lit("path"), F.concat(s["path"], F.array(F.element_at(b, s["at"] + 1)))))
        path = F.reverse(traced["path"])
        return F.slice(path, 2, F.size(path) - 1)

    begin = F.named_struct(F.lit("score"), first, F.lit("back"), F.array().cast(f"array<{pairs}>"))
    return F.when(F.size(emissions) == 0, F.array().cast(pairs)).otherwise(F.aggregate(emissions, begin, step, finish))


def _labels(labels: Iterable[str]) -> Column:
    return F.array(*[F.lit(parse_label(x)) for x in labels]).cast("array<string>")


def _chosen(tagged: Column, keep) -> Column:
    pairs = F.filter(F.arrays_zip(tagged["words"].alias("words"), tagged["postags"].alias("postags")), keep)
    kept = F.struct(F.transform(pairs, lambda p: p["words"]).alias("words"), F.transform(pairs, lambda p: p["postags"]).alias("postags")).cast(TAGGED_DDL)
    return F.when(tagged.isNotNull(), kept)


def drop_labels(tagged: Column | str, labels: Iterable[str]) -> Column:
    """Tagged text without tokens of these labels; with none given, all stay."""
    gone = _labels(labels)
    return _chosen(_col(tagged), lambda p: ~F.array_contains(gone, p["postags"]))


def take_labels(tagged: Column | str, labels: Iterable[str]) -> Column:
    """Tagged text with only tokens of these labels; with none given, none stays."""
    some = _labels(labels)
    return _chosen(_col(tagged), lambda p: F.array_contains(some, p["postags"]))


def label_of(label_id: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, POS_LABELS)), label_id.cast("int") + 1)


def parse_labels(label: Column) -> Column:
    """The id of a label; a string that is none stops the query."""
    known = F.create_map(*[x for i, name in enumerate(POS_LABELS) for x in (F.lit(name), F.lit(i))])
    return F.coalesce(F.try_element_at(known, label), F.raise_error(F.concat(F.lit('unknown POS label: "'), label, F.lit('"'))).cast("int"))


def try_parse_labels(label: Column) -> Column:
    """The id of a label, or null."""
    return F.try_element_at(F.create_map(*[x for i, name in enumerate(POS_LABELS) for x in (F.lit(name), F.lit(i))]), label)


def normalize_tokens(words: Column, strict: bool = True) -> Column:
    """Tokens as they are labelled: a lone space (ASCII or wide) stays as the wide one, others are trimmed at the end
    and mapped. The first that is empty after that stops the query, or, if not strict, makes the list null. Tokens in
    forms that NFKC changes go through the Unicode functions first."""
    made = F.transform(words, lambda w: F.when(w.isin(" ", WIDE_SPACE), F.lit(WIDE_SPACE)).otherwise(map_spaces(strip_end(w))))
    empty = F.array_position(made, F.lit(""))
    if not strict:
        return F.when(empty == 0, made)
    return F.when(empty == 0, made).when(words.isNotNull(), F.raise_error(F.concat(F.lit("token "), (empty - 1).cast("string"), F.lit(" is empty once trimmed"))).cast("array<string>"))
