"""Noun lemmas by ending rules and a lemma table."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.config import NOUN_ENDINGS
from reviewmill.functions.text import splice
from reviewmill.session import materialize


def _rewrites(word: Column) -> Column:
    """Every form the ending rules make out of ``word``, in rule order."""
    forms = [
        F.when(
            word.endswith(ending),
            F.concat(F.substring(word, F.lit(1), F.length(word) - len(ending)), F.lit(new)),
        )
        for ending, new in NOUN_ENDINGS
    ]
    return F.filter(F.array(*forms), lambda form: form.isNotNull() & (form != ""))


def _has_ending(word: Column) -> Column:
    """Only such words can differ from their lemma, exceptions aside."""
    return reduce(or_, [word.endswith(ending) for ending, _ in NOUN_ENDINGS])


def lemma_map(words: DataFrame, lemmas: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(word, lemma) for the distinct ``words`` whose lemma differs from the word.

    Candidates are the word itself and its rewrites; the shortest one found in
    ``lemmas`` (column ``lemma``) wins.  Only if none is found, rewrites of the
    rewrites are tried.  ``exceptions`` (word, lemma) go first.
    """
    distinct = words.select("word").distinct()
    staged = distinct.filter(_has_ending(F.col("word"))).withColumn("once", _rewrites(F.col("word")))
    staged = staged.withColumn("twice", F.flatten(F.transform("once", _rewrites)))
    first = F.concat(F.array("word"), F.col("once"))
    tries = F.concat(
        F.transform(first, lambda form: F.struct(F.lit(0).alias("round"), form.alias("form"))),
        F.transform("twice", lambda form: F.struct(F.lit(1).alias("round"), form.alias("form"))),
    )
    long = staged.select("word", F.posexplode(tries).alias("ord", "try"))
    found = long.join(lemmas.select(F.col("lemma").alias("known")).distinct(), F.expr("try.form = known"), "left_semi")
    best = found.groupBy("word").agg(
        F.min(F.struct(F.col("try.round"), F.length("try.form").alias("len"), "ord", F.col("try.form"))).alias("best")
    )
    chosen = best.select("word", F.col("best.form").alias("lemma"))
    if exceptions is not None:
        irregular = exceptions.select("word", F.col("lemma").alias("irregular"))
        chosen = (
            distinct.join(chosen, "word", "left")
            .join(irregular, "word", "left")
            .select("word", F.coalesce("irregular", "lemma").alias("lemma"))
        )
    return chosen.filter(F.col("lemma") != F.col("word"))


def lemmatize(
    df: DataFrame,
    id_col: str,
    tokens_col: str,
    lemmas: DataFrame | None = None,
    exceptions: DataFrame | None = None,
) -> DataFrame:
    """Replace the token array by its lemmas (default table: the corpus vocabulary).

    The rules run once per distinct word.  The resulting map is written out, so
    its real size decides between broadcast and shuffle when it is applied; only the
    places that change come back to their text, keyed by its unique id. Only words with
    one of the endings are looked up, unless there are exceptions.
    ``df`` is read three times: pass a stored table if its tokens are costly.
    """
    words = materialize(df.select(F.explode(tokens_col).alias("word")).distinct(), "words")
    if lemmas is None:
        lemmas = words.select(F.col("word").alias("lemma"))
    changes = materialize(lemma_map(words, lemmas, exceptions), "lemma_map")
    places = df.select(id_col, F.posexplode(tokens_col).alias("__at", "word"))
    if exceptions is None:
        places = places.filter(_has_ending(F.col("word")))
    changed = places.join(changes, "word").groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("__at", "lemma"))).alias("__changes"))
    out = F.when(F.col("__changes").isNull(), F.col(tokens_col)).otherwise(
        splice(F.col(tokens_col), F.col("__changes.__at"), F.col("__changes.lemma"), 1)
    )
    return df.join(changed, id_col, "left").withColumn(tokens_col, out).drop("__changes")
