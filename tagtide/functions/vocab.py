"""Greedy longest-match subword splitting against a vocabulary.

A word is cut from the left into the longest pieces found in the vocabulary,
later pieces carrying the continuation marker; a word that cannot be covered,
or is longer than ``max_chars`` where that is given, becomes the unknown piece.

``split_distinct`` cuts every distinct word once, by joins: the substrings of
the words meet the vocabulary, a table of any size, and the longest match at
every place of a word is followed from its beginning.  ``vocab_splitter`` is a
Column function for a vocabulary small enough to broadcast (checked), applied
by an Arrow-batched pandas UDF, one sentence (array of words) per value.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtide.operators.lookup import lookup
from tagtide.session import materialize

# Fixed values of the common subword convention.
CONTINUATION = "##"
UNKNOWN_PIECE = "[UNK]"
MAX_VOCAB = 2_000_000
BROADCAST_PIECES = 500_000    # a vocabulary of at most so many pieces is sent to every task, a larger one is joined by key


def greedy_pieces(word: str, vocab: frozenset, cont: str = CONTINUATION,
                  unk: str = UNKNOWN_PIECE, max_chars: int | None = None) -> list[str]:
    if max_chars is not None and len(word) > max_chars:
        return [unk]
    out, start = [], 0
    while start < len(word):
        end = len(word)
        piece = None
        while start < end:
            cand = word[start:end] if start == 0 else cont + word[start:end]
            if cand in vocab:
                piece = cand
                break
            end -= 1
        if piece is None:
            return [unk]
        out.append(piece)
        start = end
    return out


def vocab_splitter(spark: SparkSession, vocab: Iterable[str] | DataFrame, column: str = "piece",
                   max_vocab: int = MAX_VOCAB, max_chars: int | None = None):
    """A Column function ``words -> array<array<string>>`` (pieces of every word)."""
    if isinstance(vocab, DataFrame):
        n = vocab.count()
        if n > max_vocab:
            raise ValueError(f"vocabulary of {n} entries is above the broadcast bound {max_vocab}")
        entries = [r[0] for r in vocab.select(column).collect()]
    else:
        entries = list(vocab)
        if len(entries) > max_vocab:
            raise ValueError(f"vocabulary of {len(entries)} entries is above the broadcast bound {max_vocab}")
    bc = spark.sparkContext.broadcast(frozenset(entries))

    @F.pandas_udf("array<array<string>>")
    def split_words(words: pd.Series) -> pd.Series:
        v = bc.value
        return words.map(lambda ws: [greedy_pieces(w, v, max_chars=max_chars) for w in ws] if ws is not None else None)

    def apply(words: str | Column) -> Column:
        return split_words(F.col(words) if isinstance(words, str) else words)

    return apply


def affix_vocab(words: DataFrame, column: str = "word", prefix: int = 6, suffix: int = 4) -> DataFrame:
    """piece: the prefixes of the words up to ``prefix`` characters, and marked
    as continuations their proper suffixes up to ``suffix``."""
    w, n = F.col(column), F.length(column)
    heads = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(prefix))), lambda k: F.left(w, k))
    tails = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.least(n - 1, F.lit(suffix))),
                                      lambda k: F.concat(F.lit(CONTINUATION), F.right(w, k))))
    return words.where(n > 0).select(F.explode(F.concat(heads, F.coalesce(tails, F.array().cast("array<string>")))).alias(
        "piece")).distinct()


def longest_matches(words: DataFrame, vocab: DataFrame, cont: str = CONTINUATION,
                    broadcast_pieces: int = BROADCAST_PIECES) -> DataFrame:
    """(word, at, size): the longest piece of ``vocab`` (piece) at every place
    of every word of ``words`` (word, distinct) where one matches.

    Only substrings as long as some piece are looked up: where the words stand,
    in a vocabulary of at most ``broadcast_pieces``.  With a larger one both are
    shuffled; a short piece matches in many words, so that lookup spreads common
    substrings over many tasks."""
    first = F.startswith("piece", F.lit(cont))
    known = materialize(vocab.select("piece").where("piece <> ''").distinct(), "vocab-pieces")
    sizes = known.select(F.when(first, F.length("piece") - len(cont)).alias("inner"), F.length("piece").alias("whole"))
    lengths = sizes.select(F.explode(F.array("inner", "whole")).alias("k")).where("k > 0").distinct()
    lengths = sorted(r[0] for r in lengths.collect())  # as many as the longest piece has characters, at most
    places = words.where(F.length("word") > 0).select(
        "word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("at"))
    fits = F.filter(F.array(*[F.lit(k) for k in lengths]).cast("array<int>"), lambda k: k <= F.length("word") - F.col("at"))
    cut = places.select("word", "at", F.explode(fits).alias("size"))
    text = F.substring("word", F.col("at") + 1, F.col("size"))
    cut = cut.withColumn("piece", F.when(F.col("at") == 0, text).otherwise(F.concat(F.lit(cont), text)))
    if known.count() <= broadcast_pieces:
        found = cut.join(F.broadcast(known), "piece")
    else:
        found = lookup(cut, known, ["piece"], "inner")
    return found.groupBy("word", "at").agg(F.max("size").alias("size"))


def split_distinct(words: DataFrame, vocab: DataFrame, column: str = "word", cont: str = CONTINUATION,
                   unk: str = UNKNOWN_PIECE, max_chars: int | None = None) -> DataFrame:
    """(word, n, pieces): every distinct word, its count and its pieces.

    Counts combine before the shuffle, so a common word is cut once and skews
    nothing.  An empty word has no pieces; null words are left out."""
    counts = materialize(words.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("word")).agg(
        F.count(F.lit(1)).alias("n")), "vocab-words")
    # dealt out by word once: a word's matches are grouped and joined to its count where they are found
    counts = counts.repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    matches = longest_matches(counts.select("word"), vocab, cont).groupBy("word").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "size"))).alias("match"))
    whole = counts.join(matches, "word", "left")
    size = F.length("word")
    # from place to place; -1 once no piece matches
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces"))

    def step(state, _):
        at = state["at"]
        n = F.element_at("match", at)
        text = F.substring("word", at + 1, n)
        piece = F.when(at == 0, text).otherwise(F.concat(F.lit(cont), text))
        lost = F.struct(F.lit(-1).alias("at"), F.array(F.lit(unk)).alias("pieces"))
        onward = F.struct((at + n).alias("at"), F.concat(state["pieces"], F.array(piece)).alias("pieces"))
        return F.when((at < 0) | (at >= size), state).when(n.isNull(), lost).otherwise(onward)

    pieces = F.aggregate(F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")), start, step)["pieces"]
    if max_chars is not None:
        pieces = F.when(size > max_chars, F.array(F.lit(unk))).otherwise(pieces)
    return whole.select("word", "n", pieces.alias("pieces"))
