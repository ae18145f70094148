"""Benchmark decontamination by winnowing.

Every window of ``span`` words is represented by the least hash of the word k-grams
in it. A window that a document shares with an item has the same least hash on both
sides, so no shared span of ``span`` words is missed. Documents whose fingerprints
may occur in the benchmark (a bitmap of fixed size) hand over the windows they
represent; these meet the items' windows on fingerprint and words, which extends a
hit over all the shared words and leaves no chance to colliding hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.llm.common import table
from reviewmill.session import materialize

SPAN, GRAM = 10, 5
FILTER_BITS = 22  # the bitmap of benchmark fingerprints has 2**22 bits (512 KB), whatever the benchmark's size
COLUMNS = "row_id long, doc_id string, text_hash long, n_words long, start int, len int, mark long, window string"
_B = 0x9E3779B97F4A7C15 | 1
_KIND = np.zeros(256, dtype=bool)
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size, _B, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size, pow(_B, -1, 1 << 64), np.uint64)], dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair, from prefix sums."""
    up, down = _POWERS.get(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return _mixed((prefix[ends] - prefix[starts]) * down[starts])


def split_words(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text's bytes with A-Z lowered, and where its words start and end."""
    raw = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _KIND[raw]
    edge = np.diff(inside)
    return raw.tobytes(), np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _spans(np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1), starts, ends)


def window_marks(hashes: np.ndarray, span: int, gram: int) -> np.ndarray:
    """The fingerprint of each window of ``span`` words: the least hash of its k-grams."""
    n = len(hashes)
    if n < span:
        return np.zeros(0, np.uint64)
    at = np.arange(n - gram + 1)
    grams = _spans(hashes, at, at + gram)
    least = grams[: n - span + 1].copy()
    for k in range(1, span - gram + 1):
        np.minimum(least, grams[k : n - span + 1 + k], out=least)
    return least


def _windows(raw: bytes, starts: np.ndarray, ends: np.ndarray, which: np.ndarray, span: int) -> list[str]:
    words = {}
    for i in which.tolist():
        for k in range(i, i + span):
            if k not in words:
                words[k] = raw[starts[k] : ends[k]]
    return [b" ".join([words[k] for k in range(i, i + span)]).decode(errors="replace") for i in which.tolist()]


def _item_windows(span: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                raw, starts, ends = split_words(text)
                n = min(span, len(starts))
                if n:
                    marks = window_marks(word_hashes(raw, starts, ends), n, min(gram, n)).view(np.int64)
                    out += zip([item] * len(marks), [n] * len(marks), marks.tolist(), _windows(raw, starts, ends, np.arange(len(marks)), n), strict=True)
            yield pd.DataFrame(out, columns=["item_id", "len", "mark", "window"])

    return run


def _document_windows(span: int, gram: int, bitmap: bytes, lengths: list[int]):
    """A row per document (start -1), and one per window whose fingerprint may be the benchmark's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").view(bool)
        low = np.uint64(len(bits) - 1)
        for batch in batches:
            counts = []
            out: list[tuple] = []
            for row, text in zip(batch["row_id"].tolist(), batch["text"], strict=True):
                raw, starts, ends = split_words(text)
                hashes = word_hashes(raw, starts, ends)
                counts.append(len(starts))
                for n in lengths:
                    marks = window_marks(hashes, n, min(gram, n))
                    which = np.flatnonzero(bits[marks & low])
                    if len(which):
                        found = marks[which].view(np.int64).tolist()
                        for s, m, w in zip(which.tolist(), found, _windows(raw, starts, ends, which, n), strict=True):
                            out.append((row, None, 0, 0, s, n, m, w))
                        if len(out) > 20_000:
                            yield pd.DataFrame(out, columns=names)
                            out = []
            if out:
                yield pd.DataFrame(out, columns=names)
            yield batch.drop(columns="text").assign(n_words=counts, start=-1, len=0, mark=0, window=None)

    names = [column.split()[0] for column in COLUMNS.split(", ")]
    return run


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word is hit if it lies in an occurrence of any window of ``span``
    item words; an item with fewer words is one window. Null and empty texts have no
    words and are never hit; items without words hit nothing. Items of one id count
    once; a null item id makes hits but isn't counted. Repeated rows and null ids of
    documents are rows of their own. Empty tables give no hits or no rows.
    """
    tests = items.select(F.col(f"`{item_col}`").cast("string").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    tests = tests.mapInPandas(_item_windows(span, gram), "item_id string, len int, mark long, window string")
    tests = materialize(tests.distinct(), "item_windows")
    lengths = sorted(r.len for r in tests.select("len").distinct().collect())  # at most `span` rows
    low = (1 << FILTER_BITS) - 1
    marks = tests.select(F.col("mark").bitwiseAND(F.lit(low)).alias("bit")).distinct().toPandas()["bit"].to_numpy()  # at most 2**FILTER_BITS rows
    bits = np.zeros(low + 1, np.uint8)
    bits[marks] = 1
    bitmap = np.packbits(bits, bitorder="little").tobytes()

    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(f"`{id_col}`").cast("string").alias("doc_id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"),
    )
    made = rows.mapInPandas(_document_windows(span, gram, bitmap, lengths), COLUMNS)
    made = materialize(made, "document_windows")
    hits = made.filter("start >= 0").join(tests.select("mark", "window", "item_id"), ["mark", "window"]).select("row_id", "start", "len", "item_id")
    hits = materialize(hits.distinct(), "hits")
    words = hits.select("row_id", "start", "len").distinct().select("row_id", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("word"))
    n_hit = words.distinct().groupBy("row_id").agg(F.count("*").alias("n_hit"))
    names = hits.groupBy("row_id").agg(F.array_sort(F.collect_set("item_id")).alias("names"))
    of = n_hit.join(names, "row_id").withColumnRenamed("row_id", "of")
    counted = F.coalesce("n_hit", F.lit(0))
    return made.filter("start < 0").join(of, F.col("row_id") == F.col("of"), "left").select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "text_hash", "n_words", counted.alias("n_hit"), F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("names", ","), F.lit("")), 256).alias("items_sha256"), (counted > 0).alias("contaminated"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
