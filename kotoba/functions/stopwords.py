"""The stop-word list and its removal. Nothing is removed unless asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 135 stop words in their usual order. The list is distributed under the MIT licence (licenses/MIT.txt).
STOPWORDS: tuple[str, ...] = tuple(
    "~ 　 あ あっ あり ある あれ い いう いずれ いつ いる う うち え お および おり か かつて から が き くらい けど こ ここ こちら こと この これ ご ごと "
    "さ さらに し しか しかし じゃ す する ず せ せる そう そこ そして その それ それぞれ た たい たく ただ ただし たち ため たら たり だ だけ だっ だろう ち って つ "
    "て てる で でき できる でし でしょう です と とき ところ とも どこ どちら どれ な ない なお なかっ ながら なく なけれ なっ など なに なら なり なる なん なんて "
    "に にて ぬ ね の のみ は ば ぶり へ べき ほか ほとんど ほど ほぼ ま まし ましょう ます ませ また まで まま み も もの や よ よう より ら られ られる る れ れる を ん 及び".split(" ")
)


def remove_stopwords(words: Column | str, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Words that aren't stop words, in order, repeated ones included."""
    known = F.array(*map(F.lit, stopwords))
    return F.filter(words, lambda w: ~F.array_contains(known, w))
