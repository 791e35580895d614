"""Grounding for very many or very long quotes: an inverted word index instead of a set inside each row.

The row form in ``functions.evidence`` keeps the words of a page and all its quotes in one row. Here pages become an index of (url, word), each
word once, quotes become their words, and the two meet in an equi-join. No row holds a page or a list of quotes, and a page
with a very large number of quotes is a skewed join side that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark import constants as K
from leadspark.functions import evidence as E


def word_index(pages: DataFrame) -> DataFrame:
    """(url, word): the distinct words of each page of (url, content); a page may come in several rows."""
    return pages.select("url", F.explode(F.array_distinct(E.words(F.col("content")))).alias("word")).distinct()


def quote_words(quotes: DataFrame, key: str) -> DataFrame:
    """(key, url, word, n): how often each word stands in each quote of (key, url, evidence)."""
    return quotes.select(key, "url", F.explode(E.words(F.col("evidence"))).alias("word")).groupBy(key, "url", "word").agg(F.count("*").alias("n"))


def grounded_shares(quotes: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(key, share, grounded) of each quote: the share of its words, counted with repeats, that are in the page's index.

    A quote without words (or null) has no share and is not grounded. ``key`` is unique. Words that no quote of the page asks for never reach the join.
    """
    asked = quote_words(quotes, key)
    wanted = index.join(asked.select("url", "word").distinct(), ["url", "word"], "left_semi").withColumn("_found", F.lit(1))
    # the average over the words of a quote, each as often as it stands there
    shares = asked.join(wanted, ["url", "word"], "left").groupBy(key).agg(
        (F.sum(F.when(F.col("_found") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    return quotes.select(key).join(shares, key, "left").select(
        key, "share", F.coalesce(F.col("share") >= K.GROUNDING_MIN_OVERLAP, F.lit(False)).alias("grounded"))
