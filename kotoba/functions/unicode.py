"""Unicode steps that Spark has no function for, as Arrow functions over whole columns."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import SPACES

#: Versions whose normalisation and lower-casing are those of Unicode 15.0.
KNOWN_VERSIONS = ("15.0.0", "15.1.0")
#: Alphanumeric since Unicode 15.1 only.
LATER = range(0x2EBF0, 0x2EE5E)


def check_version(version: str = unicodedata.unidata_version) -> None:
    if version not in KNOWN_VERSIONS:
        raise RuntimeError(f"Unicode {version} isn't one of {', '.join(KNOWN_VERSIONS)}")


def normalize(text: str) -> str:
    """Trim the end, NFKC, then spaces to wide ones."""
    text = text.rstrip(SPACES)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.replace("İ", "I").replace(" ", "　")


def lower_kept(text: str) -> str:
    """Lower case of the same length: the dotted capital I, the one letter whose lower case is longer, becomes i. A final
    sigma depends on the whole text."""
    return text.replace("İ", "I").lower()


def alnum(text: str) -> bool:
    """str.isalnum() of Unicode 15.0."""
    return text.isalnum() and (text.isascii() or not any(ord(c) in LATER for c in text))


def _each(fn):
    def run(column: pa.Array) -> list:
        check_version()
        return [None if x is None else fn(x) for x in column.to_pylist()]

    return run


@F.arrow_udf(T.StringType())
def preprocess(column: pa.Array) -> pa.Array:
    return pa.array(_each(normalize)(column), pa.string())


@F.arrow_udf(T.StringType())
def lower(column: pa.Array) -> pa.Array:
    return pa.array(_each(lower_kept)(column), pa.string())


@F.arrow_udf(T.BooleanType())
def is_alnum(column: pa.Array) -> pa.Array:
    return pa.array(_each(alnum)(column), pa.bool_())
