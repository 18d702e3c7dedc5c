"""Types, part-of-speech labels and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The 24 labels in the order of the model's ids. `oov` (0) and 未知語 (21) are different labels.
POS_LABELS: tuple[str, ...] = (
    "oov", "補助記号", "名詞", "空白", "助詞", "接尾辞", "動詞", "連体詞", "助動詞", "形容詞", "感動詞", "接頭辞",
    "記号", "接続詞", "副詞", "代名詞", "形状詞", "web誤脱", "URL", "英単語", "漢文", "未知語", "言いよどみ", "ローマ字文",
)
POS_ID: dict[str, int] = {label: i for i, label in enumerate(POS_LABELS)}
NOUN = POS_ID["名詞"]

WORDS = T.ArrayType(T.StringType(), containsNull=False)
TAGGED = T.StructType([T.StructField("words", WORDS), T.StructField("postags", WORDS)])
TAGGED_DDL = "struct<words:array<string>,postags:array<string>>"


class KotobaError(Exception):
    """Any error of this library."""


class UnknownLabel(KotobaError, ValueError):
    def __init__(self, label: object):
        super().__init__(f'unknown POS label: "{label}"')
        self.label = label


class EmptyToken(KotobaError, ValueError):
    def __init__(self, index: int):
        super().__init__(f"token {index} is empty once trimmed")
        self.index = index


class InvalidVocabulary(KotobaError, ValueError):
    """Labels, ids or candidate lists that don't fit the model."""


class PickleError(KotobaError, ValueError):
    """A vocabulary file that is cut short, uses an opcode outside the allowed ones or has another shape."""


class ModelIo(KotobaError, OSError):
    """A model file that can't be read."""


class ModelGzip(KotobaError, ValueError):
    """A compressed model file that is cut short or damaged."""


class ModelHeader(KotobaError, ValueError):
    """A parameter header that can't be read."""


class ModelValue(KotobaError, ValueError):
    """Parameter values that can't be read."""


class ModelMissing(KotobaError, KeyError):
    """A parameter the model needs and the file lacks."""


class ModelShape(KotobaError, ValueError):
    def __init__(self, name: str, got: tuple[int, ...], want: tuple[int | None, ...]):
        super().__init__(f"parameter {name} has shape {got}, not {want}")


def parse_label(label: str) -> str:
    """The label itself, if it is one: the comparison is exact."""
    if label not in POS_ID:
        raise UnknownLabel(label)
    return label


def postags(spark: SparkSession) -> DataFrame:
    """The labels as a dimension table (id, label), in order of id."""
    return spark.createDataFrame(list(enumerate(POS_LABELS)), "id tinyint, label string")
