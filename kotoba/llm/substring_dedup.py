"""Operator 8: every byte covered by a long string that also starts elsewhere, by run-length indexes.

All 400-byte windows of all texts are dealt by their minimiser: the least of the hashes of their 32-byte substrings,
the leftmost if there are several. Equal windows have equal minimisers at equal offsets, so no match is lost.
Neighbouring windows with the same minimiser are one piece of text. Pieces whose minimiser occurs once are done.
Equal pieces are found by their 128-bit hash, with partial aggregates, and are removed at all their places, so a group
of exact copies is one piece from then on. The pieces of a minimiser that differ come together as text, many minimisers
at a time, and are indexed: aligned by the minimiser and read as symbols of eight bytes they make a run-length
compressed Burrows-Wheeler transform with sampled run ends; matching statistics streamed from it show which positions
match elsewhere for 49 symbols, which every window of a match does, the samples show which match each other, and the up
to eight bytes at both ends are then compared exactly. A minimiser with more different pieces than one index should hold (a passage that countless documents
share, with other text around) has the windows of its pieces dealt once more, by the hash of the whole window.

Defined results: a null text counts as empty; texts shorter than the length lose nothing; matches never cross texts; rows
with the same id and text are one document (what repeats is between different places of documents) and get the same
result each; rows with the same id and other texts are told apart by the text's hash; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rindex
from .jaccard import _BYTE, mixed, powers
from .runtime import bounded_batches, per_slice, table, text_or_empty, written

U = np.uint64
LENGTH = 400
GRAM = 32
SYMBOL = 8
#: Different pieces of a minimiser that are indexed together; more are dealt by whole windows.
PIECES = 4_096
#: Bytes of text of one index, about.
INDEX_BYTES = 6 << 20
#: Longer texts are cut into chunks that overlap by all but one byte of a window.
CHUNK = 1 << 26
#: Of the key that finds minimisers the low bits are the place.
PLACE_BITS = 28


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of all substrings of `size` bytes, a power of two."""
    h, m = _BYTE[data], 1
    while m < size:
        h = h[:-m] * U(0x9FB21C651E98DF25 + 2 * m) + h[m:]
        m *= 2
    return mixed(h, 5)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for each i."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(block, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def chunks(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], bytes]]:
    """Texts joined to chunks: the row and the place in its text of each part, and the bytes."""
    for row, text in enumerate(texts):
        if len(text) > CHUNK:
            for start in range(0, len(text) - length + 1, CHUNK - length + 1):
                yield [row], [start], text[start : start + CHUNK]
    rows = [i for i, t in enumerate(texts) if length <= len(t) <= CHUNK]
    if rows:
        yield rows, [0] * len(rows), b"".join(texts[i] for i in rows)


def pieces(rows: list[int], starts: list[int], blob: bytes, sizes: list[int], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The pieces of parts that are joined in blob: part, place in blob, length, offset of the minimiser, its hash."""
    data = np.frombuffer(blob, np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    grams = gram_hashes(data, gram)
    key = (grams >> U(PLACE_BITS) << U(PLACE_BITS)) | np.arange(len(grams), dtype=U)
    place = (sliding_min(key, length - gram + 1) & U((1 << PLACE_BITS) - 1)).astype(np.int64)
    valid = np.zeros(len(data) + 1, np.int8)
    valid[begin[:-1]] += 1
    np.subtract.at(valid, begin[1:] - length + 1, 1)
    valid = np.cumsum(valid)[: len(place)] > 0
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (place[1:] != place[:-1])
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    return np.searchsorted(begin, a, "right") - 1, a, b - a + length, place[a] - a, grams[place[a]].view(np.int64)


PLACES = "anchor long, s1 long, s2 long, doc_id long, th long, at long, len int, off int"


def piece_places(keyed: DataFrame) -> DataFrame:
    """All pieces of each row of (doc_id, th, text): minimiser, 128-bit hash, and place."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        parts: list[list[np.ndarray]] = [[] for _ in range(7)]
        for rows, starts, blob in chunks(texts, LENGTH):
            sizes = [len(texts[r]) for r in rows] if len(rows) > 1 or not starts[0] and len(blob) == len(texts[rows[0]]) else [len(blob)]
            part, at, size, off, anchor = pieces(rows, starts, blob, sizes)
            begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            view = memoryview(blob)
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[i : i + n]) for i, n in zip(at.tolist(), size.tolist(), strict=True)), np.int64).reshape(-1, 2)
            found = (anchor, digest[:, 0], digest[:, 1], np.array(rows)[part], at - begin[part] + np.array(starts)[part], size, off)
            for column, x in zip(parts, found, strict=True):
                column.append(x)
        anchor, s1, s2, row, at, size, off = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in parts)
        take = pa.array(row.astype(np.int64))
        columns = [pa.array(anchor), pa.array(s1), pa.array(s2), batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(at.astype(np.int64)), pa.array(size.astype(np.int32)), pa.array(off.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PLACES.split(", ")])

    return keyed.mapInArrow(per_slice(run), PLACES)


def repeated_windows(texts: list[bytes], offsets: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each text the starts of its windows that stand at another place of these texts too, if equal windows are
    aligned by the offsets."""
    half = length // SYMBOL - 1  # symbols that any window holds whole, whatever its alignment
    lead = [-o % SYMBOL for o in offsets]
    room = [-(-(p + len(t)) // SYMBOL) + 1 for p, t in zip(lead, texts, strict=True)]
    base = np.concatenate([[0], np.cumsum(room)]) * SYMBOL
    data = np.zeros(base[-1] + SYMBOL, np.uint8)
    begin = base[:-1] + np.array(lead)
    end = begin + np.array([len(t) for t in texts])
    for b, t in zip(begin.tolist(), texts, strict=True):
        data[b : b + len(t)] = np.frombuffer(t, np.uint8)
    symbols = data.view(U)
    # symbols that are not all text are unique
    count = np.zeros(len(data) + 1, np.int32)
    np.add.at(count, begin, 1)
    np.subtract.at(count, end, 1)
    whole = np.cumsum(count)[: len(data)].reshape(-1, SYMBOL).min(axis=1) > 0
    dense = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    dense[~whole] = dense.max() + 1 + np.arange((~whole).sum())
    index = rindex.build(dense, max(room))
    at = np.flatnonzero(index.matching_statistics() >= half)
    out = np.zeros(len(data), bool)
    if len(at):
        group = index.groups(at, half)
        owner = np.searchsorted(base, at * SYMBOL, "right") - 1
        for a in range(SYMBOL):  # bytes of the window before the first whole symbol
            start = at * SYMBOL - a
            inside = (start >= begin[owner]) & (start + length <= end[owner])
            s, g = start[inside], group[inside]
            ends = np.zeros((len(s), SYMBOL), np.uint8)
            for k in range(a):
                ends[:, k] = data[s + k]
            for k in range(SYMBOL - a):
                ends[:, a + k] = data[s + a + half * SYMBOL + k]
            value = ends.view(U).ravel()
            order = np.lexsort((value, g))
            same = (g[order][1:] == g[order][:-1]) & (value[order][1:] == value[order][:-1])
            hit = np.zeros(len(s), bool)
            hit[1:] |= same
            hit[:-1] |= same
            out[s[order][hit]] = True
    starts = np.flatnonzero(out)
    cuts = np.searchsorted(starts, base[1:-1])
    return [x - b for x, b in zip(np.split(starts, cuts), begin, strict=True)]


def spans(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """The runs of bytes that windows at the given sorted starts cover."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.diff(starts) > length) + 1
    return list(zip(starts[np.concatenate([[0], new])].tolist(), (starts[np.concatenate([new - 1, [len(starts) - 1]])] + length).tolist(), strict=True))


SPANS = "doc_id long, th long, lo long, hi long"


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of pieces (anchor, off, multi, doc_id, th, at, piece) in order of anchor and place: whole anchors, up to
    INDEX_BYTES at a time."""
    held: list[tuple] = []
    size, last = 0, None

    def done() -> pa.RecordBatch:
        found = repeated_windows([x[6] for x in held], [x[1] for x in held])
        rows = [(x[3], x[4], x[5] + lo, x[5] + hi) for x, starts in zip(held, found, strict=True) if not x[2] for lo, hi in spans(starts)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "th", "lo", "hi"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "off", "multi", "doc_id", "th", "at", "piece")), strict=True):
            if held and (row[0], *row[3:6]) == (held[-1][0], *held[-1][3:6]):
                continue  # a repeated row of the same document
            if row[0] != last and size >= INDEX_BYTES:
                yield done()
                held, size = [], 0
            held.append(row)
            size += len(row[6])
            last = row[0]
    if held:
        yield done()


def window_hashes(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window."""
    data = np.frombuffer(text, np.uint8)
    out = []
    for base, seed in ((0xA0761D6478BD642F, 1), (0xE7037ED1A0B428DB, 2)):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mixed(_BYTE[data], seed) * powers(base, len(data)), dtype=U)])
        back = powers(pow(base, -1, 1 << 64), len(data))
        out.append(mixed((total[length:] - total[:-length]) * back[: len(data) - length + 1], seed).view(np.int64))
    return out[0], out[1]


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(doc_id, th, lo, hi): bytes of documents that repeated windows cover, in any order, overlapping."""
    place = F.struct("doc_id", "th", "at")
    places = piece_places(keyed)
    anchors = places.groupBy("anchor").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x != y").select("anchor")
    met = written(places.join(written(anchors, "anchors"), "anchor"), "pieces")
    sk = ["anchor", "s1", "s2"]
    one = met.groupBy(*sk).agg(F.min(F.struct("doc_id", "th", "at", "len", "off")).alias("x"), F.max(place).alias("y"))
    kinds = written(one.select(*sk, "x.*", F.struct("x.doc_id", "x.th", "x.at").alias("x"), "y").withColumn("multi", ~F.col("x").eqNullSafe(F.col("y"))).drop("x", "y"), "kinds")
    whole = met.join(kinds.where("multi").select(*sk), sk).select("doc_id", "th", F.col("at").alias("lo"), (F.col("at") + F.col("len")).alias("hi"))

    several = written(kinds.groupBy("anchor").agg(F.count("*").alias("c"), F.bool_and("multi").alias("all")).where("c > 1 AND NOT all"), "several")
    differ = kinds.join(several, "anchor").select("doc_id", "th", F.struct("anchor", "at", "len", "off", "multi", (F.col("c") > PIECES).alias("hot")).alias("piece"))
    wanted = written(differ.groupBy("doc_id", "th").agg(F.collect_list("piece").alias("pieces")), "wanted").withColumnsRenamed({"doc_id": "__id", "th": "__th"})
    joined = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))).select("doc_id", "th", "text", "pieces")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, th, text, wants in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("pieces").to_pylist(), strict=True):
            rows += [(p["anchor"], p["off"], p["multi"], p["hot"], doc, th, p["at"], text[p["at"] : p["at"] + p["len"]]) for p in wants]
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["anchor", "off", "multi", "hot", "doc_id", "th", "at", "piece"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    # written, so the texts are joined once for both ways to go on
    some = written(joined.mapInArrow(per_slice(cut), "anchor long, off int, multi boolean, hot boolean, doc_id long, th long, at long, piece binary"), "piece-texts")
    cold = some.where("NOT hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "th", "at").mapInArrow(_indexed, SPANS)
    found = whole.unionByName(cold)
    if several.where(F.col("c") > PIECES).isEmpty():
        return found

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, th, at, multi, piece in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "at", "multi", "piece")), strict=True):
                w1, w2 = window_hashes(piece)
                n = len(w1)
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), pa.array([doc] * n, pa.int64()), pa.array([th] * n, pa.int64()), pa.array(at + np.arange(n)), pa.array([multi] * n)], ["w1", "w2", "doc_id", "th", "at", "multi"])

    dealt = some.where("hot").mapInArrow(windows, "w1 long, w2 long, doc_id long, th long, at long, multi boolean")
    twice = dealt.groupBy("w1", "w2").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.bool_or("multi").alias("m")).where("m OR x != y").select("w1", "w2")
    again = dealt.join(written(twice, "windows"), ["w1", "w2"])
    return found.unionByName(again.select("doc_id", "th", F.col("at").alias("lo"), (F.col("at") + F.lit(LENGTH)).alias("hi")))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans array<struct<lo, hi>> (maximal removed runs of bytes) and kept (the bytes that stay)
    for each row of docs."""
    bounded_batches(docs.sparkSession)
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("th"), text_or_empty(text).alias("text"))
    marks = repeated_spans(keyed).groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    joined = keyed.join(marks, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left").select("doc_id", "text", "spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, runs, kept = [], [], []
        for value, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            merged: list[dict] = []
            for s in found or ():
                if merged and s["lo"] <= merged[-1]["hi"]:
                    merged[-1]["hi"] = max(merged[-1]["hi"], s["hi"])
                else:
                    merged.append(dict(s))
            edges = [0, *(x for s in merged for x in (s["lo"], s["hi"])), len(value)]
            sizes.append(len(value))
            runs.append(merged)
            kept.append(b"".join(value[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True)))
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(per_slice(run), "doc_id long, n_bytes long, spans array<struct<lo:long,hi:long>>, kept binary")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes without those of repeated 400-byte strings: counts and digest, and what is left, as text
    (with U+FFFD where a character was cut)."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["hi"] - x["lo"])
    return out.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.length("kept").cast("long").alias("n_kept"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )
