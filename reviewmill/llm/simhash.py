"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints within ``radius`` bits of each other always meet: every bit position
gets a code of radius + 1 bits, and each non-zero vector v of that length gives a
mask of the positions whose code has odd parity with v. The codes of the at most
``radius`` differing positions don't span the whole space, so some v is orthogonal
to all of them, and under its mask the two fingerprints are equal.

Buckets under a mask are compared pairwise while they are small. In a large bucket
every fingerprint names all fingerprints within half the radius (it can differ from
its partners in unmasked bits only); two within the radius name a common one, and
all that name one are within the radius of each other, so each links to the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewmill.llm.common import connected_components, table
from reviewmill.session import literal_table, materialize

SEED = 42
COMPARED = 2048  # a bucket up to this size is compared pairwise, a larger one by common neighbours
CHUNK = 65_536  # shingles whose bits are counted at once


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z only, and split at \x20\x09-\x0D


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words, repeats included; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")


def simhash(hashes: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half of the hashes; 0 if there are none."""
    n, votes = len(hashes), np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int) -> Column:
    """SimHash as a (signed) long; null texts get 0."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        made = np.fromiter((simhash(shingle_hashes(words_of(t), shingle)) for t in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(made.view(np.int64))

    return fingerprint(text)


def covering_masks(radius: int, tries: int = 200) -> list[int]:
    """2^(radius+1) - 1 masks; two 64-bit values within ``radius`` agree under at least one.

    Any codes of the positions do; of some drawn ones those are taken whose thinnest
    mask has most bits, since a thin mask makes large buckets.
    """
    codes = list(range(1, 2 ** (radius + 1))) * -(-64 // (2 ** (radius + 1) - 1))
    best: list[int] = []
    for seed in range(tries):
        drawn = np.random.default_rng(seed).permutation(codes)[:64].tolist()
        masks = [sum(1 << i for i, code in enumerate(drawn) if (code & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
        best = max(best, masks, key=lambda m: min((x.bit_count() for x in m), default=0))
    return best


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _linked(group: np.ndarray, value: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``radius`` that keep the components of each group; rows of a group stand together.

    Row i is compared with row i - 1, i - 2, ... of its group, unless the two are
    connected already, so a dense group soon needs no comparison and gives few pairs.
    """
    n = len(value)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    place = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    label, rows, lag = np.arange(n), np.flatnonzero(place >= 1), 1
    left, right = [value[:0]], [value[:0]]
    while len(rows):
        open_ = rows[label[rows] != label[rows - lag]]
        near = open_[np.bitwise_count(value[open_] ^ value[open_ - lag]) <= radius]
        left.append(value[near])
        right.append(value[near - lag])
        while len(near):
            a, b = label[near], label[near - lag]
            near = near[a != b]
            a, b = np.maximum(a, b)[a != b], np.minimum(a, b)[a != b]
            np.minimum.at(label, a, b)  # a and b are roots, so this hangs one tree under another
            while (label != label[label]).any():
                label = label[label]
        lag += 1
        rows = rows[place[rows] >= lag]
    return np.concatenate(left), np.concatenate(right)


def _bucket_links(radius: int, compared: int):
    """Sorted (mask, key, fp) rows to links (mask -1); rows of buckets over ``compared`` pass on with their mask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, hot = None, None
        for batch in chain(batches, [None]):
            last = batch is None
            rows = kept if last else batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            if rows is None or not len(rows):
                continue
            mask, key, fp = (rows[c].to_numpy() for c in ("mask", "key", "fp"))
            starts = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            sizes = np.diff(np.r_[starts, len(fp)])
            large = sizes > compared
            large[0] |= hot == (mask[0], key[0])
            done = np.ones(len(starts), dtype=bool)
            done[-1] = last or large[-1]
            hot = (mask[-1], key[-1]) if large[-1] else None
            kept = None if done[-1] else rows.iloc[starts[-1] :]
            bucket = np.repeat(np.arange(len(starts)), sizes)
            wide = large[bucket]
            if wide.any():
                yield pd.DataFrame({"a": fp[wide], "b": fp[wide], "mask": mask[wide]})
            small = (done & ~large & (sizes > 1))[bucket]
            a, b = _linked(bucket[small], fp[small].view(np.uint64), radius)
            if len(a):
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64), "mask": -1})

    return run


def fingerprint_links(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): pairs of the distinct fingerprints ``fp`` within ``radius`` bits that keep its components; not all pairs."""
    if radius % 2:
        raise ValueError("an even radius: two halves of it make up the way between two fingerprints")
    masks = covering_masks(radius)
    free = max(64 - m.bit_count() for m in masks)
    compared = max(COMPARED, sum(comb(free, k) for k in range(radius // 2 + 1)))
    bits = F.array(*[F.lit(_signed(m)) for m in masks])
    keyed = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("mask"))
    key = F.col("fp").bitwiseAND(F.get(bits, F.col("mask")))
    # The key is dealt by, but not sent: it follows from the other two.
    sorted_rows = keyed.repartition("mask", key).select("mask", key.alias("key"), "fp").sortWithinPartitions("mask", "key")
    found = materialize(sorted_rows.mapInPandas(_bucket_links(radius, compared), "a long, b long, mask int"), "links")
    near = found.filter("mask < 0").select("a", "b")
    large = found.filter("mask >= 0").select("mask", F.col("a").alias("fp"))
    if large.isEmpty():
        return near
    single = [(k, i, _signed(1 << i)) for k, m in enumerate(masks) for i in range(64) if not m >> i & 1]
    one = literal_table(prints.sparkSession, single, "mask int, bit int, flip long")
    flips = one.select("mask", F.lit(-1).alias("bit"), F.lit(0).cast("long").alias("flip")).distinct()
    for _ in range(radius // 2):  # the unmasked bits that may be turned; their number depends on the radius alone
        more = one.select(F.col("mask").alias("m"), F.col("bit").alias("next"), F.col("flip").alias("turned"))
        longer = flips.join(more, (F.col("mask") == F.col("m")) & (F.col("next") > F.col("bit")))
        flips = flips.unionByName(longer.select("mask", F.col("next").alias("bit"), F.col("flip").bitwiseXOR(F.col("turned")).alias("flip"))).distinct()
    around = large.join(flips, "mask").select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    least = F.min("fp").over(Window.partitionBy("middle"))
    return near.unionByName(around.select("fp", least.alias("b")).filter("fp <> b").distinct().select(F.col("fp").alias("a"), "b"))


def text_digest(text_col: str) -> Column:
    """SHA-256 of the text, 32 bytes; null as the empty text. Nothing is dropped by a shorter hash."""
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, text_hash, fp (long), fingerprint (hex), component_id, n_links, root.

    ``component_id`` is the smallest id among the documents reachable over links of
    at most ``radius`` differing bits. Documents of one fingerprint are one node, so
    thousands of copies cost one row; ``n_links`` counts the other documents with
    exactly this fingerprint.

    Null, empty and blank texts have fingerprint 0 and are linked like any other.
    Repeated rows stay rows. A null id is ignored by the minimum; a component with
    null ids only has a null component_id; ``root``, a fingerprint, names it. An empty table gives an empty table.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), text_digest(text_col).alias("text_hash"), fingerprint_column(text, shingle).alias("fp")
    )
    rows = materialize(rows, "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "prints")
    links = fingerprint_links(prints.select("fp"), radius)
    roots = connected_components(links)
    of = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "n", "least_id", F.coalesce("root", "fp").alias("root"))
    of = materialize(of, "rooted")
    least = of.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = of.join(least, "root").select(F.col("fp").alias("of_fp"), "component_id", (F.col("n") - 1).alias("n_links"), "root")
    return rows.join(classes, F.col("fp") == F.col("of_fp")).select(
        "doc_id", "text_hash", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links", "root"
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` without near and exact duplicates: of each component of ``near_duplicates`` the smallest id stays.

    A null id comes last, then the text's hash decides; of repeated rows one stays. All null, empty
    and blank texts are one component. Very long texts are hashed whole. Extra columns are carried, whatever their names.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, shingle=shingle, radius=radius)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = found.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    first = materialize(first, "first_of_group")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(f"`{id_col}`").alias("row_id"), text_digest(text_col).alias("row_hash"), row.alias("row"))
    same = F.col("row_id").eqNullSafe(F.col("first_id")) & (F.col("row_hash") == F.col("first_hash"))
    return rows.join(first, same, "left_semi").dropDuplicates(["row_id", "row_hash"]).select("row.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "n_links")
