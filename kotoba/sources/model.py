"""Readers of model files: the pickled vocabularies and the weights, as text or binary. Nothing in them is executed."""

from __future__ import annotations

import gzip
import hashlib
import io
import pickle
import pickletools
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..schema import POS_LABELS, InvalidVocabulary, ModelGzip, ModelHeader, ModelIo, ModelMissing, ModelShape, ModelValue, PickleError

#: The opcodes a vocabulary file may use.
OPCODES = frozenset("PROTO STOP MARK EMPTY_DICT EMPTY_LIST BINPUT LONG_BINPUT BINGET LONG_BINGET BININT BININT1 BININT2 BINUNICODE SHORT_BINUNICODE SETITEM SETITEMS APPEND APPENDS MEMOIZE TUPLE".split())
#: The parameters of the model. None stands for a vocabulary's size.
SEGMENTER_SHAPES: dict[str, tuple[int | None, ...]] = {
    "/_0": (32, None), "/_1": (16, None), "/_2": (16, None), "/_3": (8, 7), "/_5": (6, 100), "/_6": (6,), "/_7": (6, 6),
    "/birnn/vanilla-lstm-builder/_0": (200, 200), "/birnn/vanilla-lstm-builder/_1": (200, 50), "/birnn/vanilla-lstm-builder/_2": (200,),
    "/birnn/vanilla-lstm-builder_1/_0": (200, 200), "/birnn/vanilla-lstm-builder_1/_1": (200, 50), "/birnn/vanilla-lstm-builder_1/_2": (200,),
}
TAGGER_SHAPES: dict[str, tuple[int | None, ...]] = SEGMENTER_SHAPES | {
    "/_4": (16, 24), "/_8": (24, 100), "/_9": (24,),
    "/birnn_1/vanilla-lstm-builder/_0": (200, 64), "/birnn_1/vanilla-lstm-builder/_1": (200, 50), "/birnn_1/vanilla-lstm-builder/_2": (200,),
    "/birnn_1/vanilla-lstm-builder_1/_0": (200, 64), "/birnn_1/vanilla-lstm-builder_1/_1": (200, 50), "/birnn_1/vanilla-lstm-builder_1/_2": (200,),
    "/birnn_2/vanilla-lstm-builder/_0": (64, 32), "/birnn_2/vanilla-lstm-builder/_1": (64, 16), "/birnn_2/vanilla-lstm-builder/_2": (64,),
    "/birnn_2/vanilla-lstm-builder_1/_0": (64, 32), "/birnn_2/vanilla-lstm-builder_1/_1": (64, 16), "/birnn_2/vanilla-lstm-builder_1/_2": (64,),
}
HEADER = re.compile(rb"#(?:Parameter|LookupParameter)# (\S+) \{(\d+(?:,\d+)*)\} (\d+)[^\n]*")
#: Fixed value: a binary file begins with six letters, which its maker chooses, a zero byte and its version.
MAGIC = b"KOTOBA\x00\x01"


@dataclass(frozen=True)
class Vocabularies:
    uni: dict[str, int]
    bi: dict[str, int]
    word: dict[str, int]
    pos: dict[str, int] | None = None
    word_tags: dict[str, list[int]] | None = None


class _Closed(pickle.Unpickler):
    def find_class(self, module, name):  # noqa: ANN001
        raise PickleError(f"{module}.{name} isn't allowed")

    def persistent_load(self, pid):  # noqa: ANN001
        raise PickleError("persistent ids aren't allowed")


def _bytes(path: str | Path) -> bytes:
    try:
        data = Path(path).read_bytes()
    except OSError as error:
        raise ModelIo(error.errno, f"{path}: {error.strerror}") from error
    try:
        return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    except (OSError, EOFError, zlib.error) as error:
        raise ModelGzip(f"{path}: {error}") from error


def unpickle(data: bytes, tagger: bool = True) -> Vocabularies:
    """The vocabularies of a pickled list of five dictionaries; without a tagger the first three will do."""
    try:
        used = {op.name for op, _, _ in pickletools.genops(data)}
        if used - OPCODES:
            raise PickleError(f"opcodes {', '.join(sorted(used - OPCODES))} aren't allowed")
        found = _Closed(io.BytesIO(data)).load()
    except PickleError:
        raise
    except Exception as error:
        raise PickleError(str(error)) from error
    if not isinstance(found, list) or len(found) != 5 and (tagger or len(found) < 3) or not all(isinstance(x, dict) for x in found):
        raise PickleError("not a list of five dictionaries")
    found = found if tagger else found[:3]
    for x in found[:4]:
        if not all(isinstance(k, str) and type(v) is int and v >= 0 for k, v in x.items()):
            raise PickleError("not a dictionary from strings to ids")
    if tagger and not all(isinstance(k, str) and isinstance(v, list | tuple) and all(type(i) is int for i in v) for k, v in found[4].items()):
        raise PickleError("not a dictionary from words to lists of ids")
    if tagger:
        found[4] = {k: list(v) for k, v in found[4].items()}
    return Vocabularies(*found)


def read_vocabularies(path: str | Path, tagger: bool = True) -> Vocabularies:
    return unpickle(_bytes(path), tagger)


def check_digest(path: str | Path, sha256: str) -> None:
    """A file is the one whose digest is known, or the load ends here."""
    got = hashlib.sha256(Path(path).read_bytes()).hexdigest()
    if got != sha256.lower():
        raise InvalidVocabulary(f"{path} has the digest {got}, not {sha256}")


def read_weights(path: str | Path, wanted: Iterable[str] | None = None, magic: bytes = MAGIC) -> dict[str, np.ndarray]:
    """Parameters by name, in the shape that lets a row of inputs be multiplied from the left. Those not wanted are
    passed over. A file that begins with the magic is binary, any other is text."""
    data = _bytes(path)
    binary = data.startswith(magic)
    at, out, names = len(magic) if binary else 0, {}, None if wanted is None else set(wanted)
    while at < len(data):
        end = data.find(b"\n", at)
        head = HEADER.fullmatch(data[at : end if end >= 0 else len(data)])
        if not head or end < 0:
            raise ModelHeader(f"no parameter header at byte {at}")
        name, dims = head[1].decode(), tuple(map(int, head[2].split(b",")))
        count = int(np.prod(dims, dtype=object))
        size = 4 * count if binary else int(head[3])
        body = data[end + 1 : end + 1 + size]
        if len(body) < size:
            raise ModelValue(f"parameter {name} is cut short")
        if names is None or name in names:
            try:
                values = np.frombuffer(body, "<f4") if binary else np.array(body.split(), np.float32)
            except ValueError as error:
                raise ModelValue(f"parameter {name}: {error}") from error
            if len(values) != count:
                raise ModelValue(f"parameter {name} has {len(values)} values, not {count}")
            out[name] = values.reshape(dims[::-1])
        at = end + 1 + size
    return out


def write_binary(path: str | Path, weights: dict[str, np.ndarray], magic: bytes = MAGIC) -> None:
    """The binary form of weights."""
    body = [magic]
    for name, values in weights.items():
        values = np.ascontiguousarray(values, "<f4")
        body.append(f"#Parameter# {name} {{{','.join(map(str, values.shape[::-1]))}}} {values.nbytes}\n".encode() + values.tobytes())
    Path(path).write_bytes(gzip.compress(b"".join(body)))


def pack(source: str | Path, target: str | Path, magic: bytes = MAGIC, digest: str | None = None) -> dict[str, str]:
    """Packs the text form of a whole model's weights into the binary one and returns the SHA-256 of both files. The
    parameters must be exactly those of the model, in their shapes; digest is what the source must have."""
    if digest:
        check_digest(source, digest)
    weights = read_weights(source, magic=magic)
    if extra := set(weights) - set(TAGGER_SHAPES):
        raise ModelHeader(f"unknown parameters: {', '.join(sorted(extra))}")
    check_weights(weights, TAGGER_SHAPES)
    write_binary(target, weights, magic)
    return {Path(p).name: hashlib.sha256(Path(p).read_bytes()).hexdigest() for p in (source, target)}


def check_weights(weights: dict[str, np.ndarray], shapes: dict[str, tuple[int | None, ...]]) -> None:
    for name, want in shapes.items():
        if name not in weights:
            raise ModelMissing(name)
        got = weights[name].shape[::-1]
        if len(got) != len(want) or any(w is not None and g != w for g, w in zip(got, want, strict=True)):
            raise ModelShape(name, got, want)


def check_vocabularies(v: Vocabularies, weights: dict[str, np.ndarray], tagger: bool) -> None:
    for kind, ids, table in (("uni", v.uni, "/_0"), ("bi", v.bi, "/_1"), ("word", v.word, "/_2")):
        if "oov" not in ids:
            raise InvalidVocabulary(f"the {kind} vocabulary has no oov")
        if max(ids.values()) >= len(weights[table]):
            raise InvalidVocabulary(f"an id of the {kind} vocabulary is outside its table")
    if tagger:
        if not v.pos or [k for k, _ in sorted(v.pos.items(), key=lambda x: x[1])] != list(POS_LABELS) or sorted(v.pos.values()) != list(range(len(POS_LABELS))):
            raise InvalidVocabulary("the labels aren't the 24 known ones in their order")
        if v.word_tags is None or any(not ids or min(ids) < 0 or max(ids) >= len(POS_LABELS) for ids in v.word_tags.values()):
            raise InvalidVocabulary("a list of candidate labels is empty or has an unknown id")


def vocabulary_table(spark: SparkSession, ids: dict[str, int]) -> DataFrame:
    """A vocabulary as a dimension table (key, id)."""
    return spark.createDataFrame(list(ids.items()), "key string, id int")


def weights_table(spark: SparkSession, weights: dict[str, np.ndarray]) -> DataFrame:
    """Weights as rows (name, dims, data), to be kept as Parquet."""
    rows = [(name, [int(d) for d in w.shape[::-1]], w.astype(np.float32).ravel().tolist()) for name, w in weights.items()]
    return spark.createDataFrame(rows, "name string, dims array<int>, data array<float>")


def weights_of(table: DataFrame, wanted: Iterable[str] | None = None) -> dict[str, np.ndarray]:
    """Weights from such rows; only those wanted are read."""
    rows = table if wanted is None else table.where(table["name"].isin(*wanted))
    return {r["name"]: np.array(r["data"], np.float32).reshape(r["dims"][::-1]) for r in rows.collect()}
