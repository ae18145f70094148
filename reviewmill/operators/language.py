"""Language detection from character trigram profiles trained in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.session import exploded, materialize, with_once

GRAM = 3
SMOOTHING = 0.5
MIN_CHARS = 10
UNKNOWN = "unknown"
COUNTED, SUMMED = 1_000_000, 100_000  # characters that a task counts or sums together
GAINS_IN_TASKS = 2_000_000  # numbers of a model that every task may hold; a larger model is joined
_BITS = 21  # of a code point
_END = 2**63 - 1  # after every key


def _letters(text: Column) -> Column:
    """Lower-case letters only, one blank between words and at both ends."""
    return F.concat(
        F.lit(" "), F.trim(F.regexp_replace(F.lower(text.cast("string")), r" \P{L}++|[\P{L}&&[^ ]]\P{L}*+", " ")), F.lit(" ")
    )


def _lettered(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """Texts that have letters, and their number of trigrams."""
    lettered = with_once(df.select(*keep, F.col(text_col).alias("__text")), __letters=_letters(F.col("__text"))).filter(F.trim("__letters") != "")
    return lettered.select(*keep, "__letters", (F.length("__letters") - (GRAM - 1)).alias("__n"))


def _gram_rows(lettered: DataFrame, *keep: str) -> DataFrame:
    """One row per trigram."""
    # A look-ahead per position yields overlapping grams in one linear scan.
    grams = F.regexp_extract_all("__letters", F.lit(f"(?=(.{{{GRAM}}}))"), 1)
    return exploded(lettered, grams, "gram", *keep)


def _gram_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Key of the gram at every place of the texts, one after the other (-1: the text ends first), and the size of each.

    Places are those of ``_gram_rows``: UTF-16 units, where half a pair reads as a question mark.
    """
    joined = "".join(texts)
    units = np.frombuffer(joined.encode("utf-16-le"), "<u2").astype(np.int64)
    paired = len(units) > len(joined)
    sizes = np.array([len(t.encode("utf-16-le")) // 2 if paired else len(t) for t in texts], dtype=np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    step = np.ones(len(units) + GRAM, dtype=np.int64)
    points = np.append(units, np.zeros(GRAM, dtype=np.int64))
    if paired:
        high = np.flatnonzero(units >> 10 == 0x36)  # a low one follows, the text being valid
        step[high] = 2
        points[np.flatnonzero(units >> 10 == 0x37)] = ord("?")
        points[high] = 0x10000 + ((units[high] & 0x3FF) << 10) + (units[high + 1] & 0x3FF)
    at = np.arange(len(units))
    keys = np.zeros(len(units), dtype=np.int64)
    for i in range(GRAM):
        keys = (keys << _BITS) | points[at]
        inside = at < ends
        at = np.minimum(at + step[at], len(units))
    return np.where(inside, keys, -1), sizes


def _chunks(batch: pa.RecordBatch, text_col: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` characters, one text at least."""
    ends = np.cumsum(pc.utf8_length(batch.column(text_col)).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), len(ends)]
    for low, high in zip(cuts, cuts[1:]):
        if low < high:
            yield batch.slice(low, high - low)


def language_profiles(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n): trigram counts per language of a labelled table.

    Each task counts the grams of some texts at a time, so only their counts become rows.
    """
    lettered = _lettered(df, text_col, lang_col).select(F.col(lang_col).alias("lang"), "__letters")
    schema = T.StructType([lettered.schema["lang"], T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = (1 << _BITS) - 1
        for batch in batches:
            for part in _chunks(batch, "__letters", COUNTED):
                keys, sizes = _gram_keys(part.column("__letters").to_pylist())
                langs = part.column("lang").dictionary_encode(null_encoding="encode")
                owners = np.repeat(langs.indices.to_numpy(zero_copy_only=False), sizes)
                for owner in range(len(langs.dictionary)):
                    found, n = np.unique(keys[(owners == owner) & (keys >= 0)], return_counts=True)
                    grams = ["".join(chr(key >> _BITS * i & low) for i in reversed(range(GRAM))) for key in found.tolist()]
                    lang = langs.dictionary.take(pa.array([owner] * len(grams), pa.int32()))
                    yield pa.RecordBatch.from_arrays([lang, pa.array(grams, pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return lettered.mapInArrow(counted, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Smoothed trigram log-probabilities: rows (gram, a gain per language) and (lang, missing).

    ``missing`` is the log-probability of an unseen gram, ``gain`` what a seen one adds
    to it, so a text's score is its number of grams times ``missing`` plus the gains
    found. Any number of languages; both tables are written out. Tasks hold the gains of a
    model of up to ``GAINS_IN_TASKS`` numbers, a larger one is joined.
    """

    def __init__(self, profiles: DataFrame, smoothing: float = SMOOTHING):
        profiles = materialize(profiles, "profiles")
        n_grams = profiles.select("gram").distinct().count()
        sizes = profiles.groupBy("lang").agg((F.sum("n") + F.lit(smoothing * n_grams)).alias("size"))
        languages = sizes.select("lang", F.log(F.lit(smoothing) / F.col("size")).alias("missing"))
        self.languages = materialize(languages, "languages")
        # Of the languages that know none of a text's grams only this one can win.
        self.likeliest = self.languages.orderBy(F.desc(F.round("missing", 12)), "lang").first()
        rows = self.languages.filter("lang IS NOT NULL").orderBy("lang").collect()  # one per language
        self.missing = {row["lang"]: row["missing"] for row in rows}
        gain = F.log((F.col("n") + smoothing) / F.lit(smoothing))
        gains = [F.max(F.when(F.col("lang") == name, gain)).alias(f"g{i}") for i, name in enumerate(self.missing)]
        self.table = materialize(profiles.groupBy("gram").agg(*(gains or [F.count("*").alias("n")])), "language_model")
        self.in_tasks = 0 < n_grams * len(self.missing) <= GAINS_IN_TASKS

    def detect(self, df: DataFrame, id_col: str, text_col: str, out: str = "detected_lang") -> DataFrame:
        """(id, detected_lang).  Under ten characters or without letters: unknown.

        Grams meet the model where their text is and their gains are summed there, one
        number per language: the shuffle moves a row per text, no text and no gram, unless
        the model is larger than a broadcast. The largest score wins, between equal scores
        the first language by name.
        """
        texts = df.select(id_col, F.col(text_col).alias("__text"))
        long_enough = F.length(F.trim("__text")) >= MIN_CHARS
        lettered = _lettered(texts.filter(long_enough), "__text", id_col)
        met = self._summed(lettered, id_col) if self.in_tasks else _gram_rows(lettered, id_col, "__n").join(self.table, "gram", "left")
        sums = [F.sum(f"g{i}").alias(f"s{i}") for i in range(len(self.missing))]
        gains = met.groupBy(id_col, "__n").agg(*(sums or [F.count("*").alias("n")]))

        def rated(lang: str, missing: Column, gain: Column) -> Column:
            score = F.round(F.col("__n") * missing + gain, 6)
            return F.struct((-score).alias("cost"), F.lit(lang).cast("string").alias("lang"))

        choices = [F.when(F.col(f"s{i}") > 0, rated(name, F.lit(value), F.col(f"s{i}"))) for i, (name, value) in enumerate(self.missing.items())]
        if self.likeliest is not None:
            choices.append(rated(self.likeliest["lang"], F.lit(self.likeliest["missing"]), F.lit(0.0)))
        if not choices:
            return texts.select(id_col, F.lit(UNKNOWN).alias(out))
        best = gains.groupBy(id_col).agg(F.min(F.array_min(F.array(*choices))).alias("best"))
        detected = best.select(id_col, F.col("best.lang").alias("__lang"))
        return texts.select(id_col).join(detected, id_col, "left").select(
            id_col, F.coalesce("__lang", F.lit(UNKNOWN)).alias(out)
        )

    def _summed(self, lettered: DataFrame, id_col: str) -> DataFrame:
        """(id, __n, a sum of gains per language) of every text, summed in the task that has the text."""
        names = [f"g{i}" for i in range(len(self.missing))]
        rows = self.table.filter(F.length("gram") == GRAM).toPandas()
        keys = np.zeros(len(rows) + 1, dtype=np.int64)
        for i in range(GRAM):
            keys[:-1] = (keys[:-1] << _BITS) | np.array([ord(gram[i]) for gram in rows["gram"]], dtype=np.int64)
        keys[-1] = _END
        order = np.argsort(keys)
        gains = [np.append(rows[name].to_numpy(dtype=float, na_value=0.0), 0.0)[order] for name in names]
        model = lettered.sparkSession.sparkContext.broadcast((keys[order], gains))
        schema = T.StructType([lettered.schema[id_col], lettered.schema["__n"], *[T.StructField(name, T.DoubleType()) for name in names]])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, values = model.value
            for batch in batches:
                for part in _chunks(batch, "__letters", SUMMED):
                    keys, sizes = _gram_keys(part.column("__letters").to_pylist())
                    place = np.searchsorted(known, keys)
                    place[known[place] != keys] = len(known) - 1  # unseen: adds nothing
                    starts = np.cumsum(sizes) - sizes
                    sums = [pa.array(np.add.reduceat(gain[place], starts)) for gain in values]
                    yield pa.RecordBatch.from_arrays([part.column(id_col), part.column("__n"), *sums], names=[id_col, "__n", *names])

        return lettered.select(id_col, "__n", "__letters").mapInArrow(summed, schema)


def language_filter(df: DataFrame, lang_col: str, removed: tuple[str, ...]) -> DataFrame:
    """Drop rows in one of the ``removed`` languages; unknown stays."""
    return df.filter(~F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).isin(*removed)) if removed else df
