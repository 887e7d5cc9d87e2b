"""Unknown words corrected to the nearest known form of a dictionary, by what both begin with."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import match_case
from parlance.operators.phrases import MOST_BROADCAST, corrected_texts, words_with_gaps
from parlance.operators.seams import likeness
from parlance.operators.similarity import near_words
from parlance.session import materialize

#: Letters that a word and its form share at the beginning: the most looked for first, and the least.
LONGEST_PREFIX, SHORTEST_PREFIX = 8, 4


def common_letters(left: str, right: str) -> int:
    """The most letters that two words have in common in the same order."""
    row = [0] * (len(right) + 1)
    for a in left:
        before = 0
        for j, b in enumerate(right, 1):
            before, row[j] = row[j], before + 1 if a == b else max(row[j], row[j - 1])
    return row[-1]


def alike(left: str, right: str) -> Column:
    """Twice the letters that two columns of words have in common in the same order, over all letters of both."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([2 * common_letters(x, y) / (len(x) + len(y)) for x, y in zip(a, b)], dtype=float)

    return ratio(left, right)


def known_forms(
    words: DataFrame,
    dictionary: DataFrame,
    least_length: int = 6,
    most_edits: int = 1,
    least_ratio: float = 0.93,
    most_candidates: int | None = None,
    foreign: str = "[A-Za-z]",
    measure: Callable[[str, str], Column] = likeness,
) -> DataFrame:
    """word, form, prefix (shared letters that decided), ratio: the known form that each unknown word most likely is.

    A form of ``dictionary(form)`` may stand for a word of ``words(word)`` if both have ``least_length`` letters, are within
    ``most_edits`` and alike by ``least_ratio``, as ``measure`` says: by matching blocks, or by letters in common. Forms that share the first eight letters with the word come first, then
    those that share seven, down to four (never the whole word); at the first number of letters that has any, the most alike
    form counts, of equals the first. All forms take part; with ``most_candidates`` only the first so many with one beginning.
    Known words, and words or forms with ``foreign`` letters, are left alone. All is in lower case.

    Pairs come from deletions, not from lists of all forms with a beginning, so a frequent beginning costs no more than a
    rare one, and no bound is needed.
    """
    proper = lambda c: (F.length(c) >= least_length) & ~F.col(c).rlike(foreign)
    known = dictionary.select(F.lower("form").alias("term")).distinct()
    forms = known.where(proper("term"))
    unknown = words.select(F.lower("word").alias("word")).distinct().where(proper("word")).join(known.withColumnRenamed("term", "word"), "word", "left_anti")
    near = near_words(unknown, forms, most_edits, 0.0).where("distance > 0")
    near = near.where(F.abs(F.length("word") - F.length("term")) <= F.greatest(F.lit(2), F.floor(F.length("word") / 5)))
    # the most letters shared, then fewer: a form that is out of one list may be in no shorter one
    most = F.least(F.lit(LONGEST_PREFIX), F.length("word") - 1, F.length("term"))
    shared = F.filter(F.sequence(F.lit(SHORTEST_PREFIX), F.greatest(most, F.lit(SHORTEST_PREFIX))), lambda p: (p <= most) & (F.substring("word", F.lit(1), p) == F.substring("term", F.lit(1), p)))
    near = materialize(near.select("word", "term", F.explode(shared).alias("prefix")), "near")
    if most_candidates is not None:
        lists = forms.select("term", F.explode(F.sequence(F.lit(SHORTEST_PREFIX), F.least(F.lit(LONGEST_PREFIX), F.length("term")))).alias("prefix"))
        lists = lists.withColumn("begin", F.substring("term", F.lit(1), F.col("prefix")))
        long = lists.groupBy("begin").agg(F.count("*").alias("n")).where(F.col("n") > most_candidates).select("begin")
        number = F.row_number().over(Window.partitionBy("begin").orderBy("term"))
        beyond = lists.join(long, "begin", "left_semi").withColumn("_n", number).where(F.col("_n") > most_candidates).select("term", "prefix")
        near = near.join(beyond, ["term", "prefix"], "left_anti")
    ratios = near.select("word", "term").distinct().withColumn("ratio", measure("word", "term")).where(F.col("ratio") >= least_ratio)
    near = near.join(ratios, ["word", "term"])
    best = F.min_by(F.struct(F.col("term").alias("form"), "prefix", "ratio"), F.struct((-F.col("prefix")).alias("minus"), (-F.col("ratio")).alias("unlike"), "term"))
    return near.groupBy("word").agg(best.alias("b")).select("word", "b.*")


def spelled_texts(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """id, text and n_edits of ``texts(id, text)`` with the words of ``forms(word, form)`` replaced in the case that they have."""
    words = words_with_gaps(texts).select("id", F.posexplode("words").alias("start", "own")).withColumn("word", F.lower("own"))
    forms = materialize(forms.select("word", "form"), "forms")
    found = words.join(F.broadcast(forms) if forms.count() <= MOST_BROADCAST else forms, "word")
    replacement = match_case(F.col("own"), F.col("form"))
    edits = found.select("id", "start", F.lit(1).alias("length"), replacement.alias("replacement"), (replacement != F.col("own")).alias("changed"))
    return corrected_texts(texts, edits)
