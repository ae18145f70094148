"""Exact removal of repeated byte strings with a hash-compared suffix sort.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier in
the corpus. Sorting all suffixes would show that, but only suffixes that share their
first ``length`` bytes matter, and those can be brought together first:

1. Every string of ``length`` bytes names the least k-gram hash in it (winnowing), so
   equal strings name equal anchors at equal offsets. The strings of one anchor form
   a stretch of text. Of equal stretches all but the earliest are repeats.
2. Where one anchor hash has different stretches, their strings may still be equal
   in part. The suffixes starting in such stretches are sorted: comparisons find the
   common extension by binary search over prefix polynomial hashes, in a mergesort
   over all groups at once. Neighbours that agree over ``length`` bytes are compared
   byte by byte, so a colliding hash can't remove anything.
3. The covered intervals are merged per document and cut out.

Equal stretches are dropped in chunks before anything is shuffled. An anchor with
many stretches within one chunk (the edge of a very common line) is hot: its strings,
those of all other chunks too, are not gathered under the anchor but grouped by their
own bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.llm.common import table
from reviewmill.session import materialize

LENGTH, GRAM = 100, 32
CHUNK = 1 << 20  # stretches a task holds before it reduces them and sends them on
HOT = 64  # different stretches of one anchor within a chunk
BUFFER = 1 << 21  # bytes of stretches whose suffixes are sorted together
_B = 0x9E3779B97F4A7C15
STRETCH, MARK, LOOSE, COVERED = 0, 1, 2, 3  # kinds of rows
ROWS = "kind byte, route long, print long, doc_id long, place long"
INTERVALS = "kind byte, anchor long, doc_id long, copy int, lo long, n int, off int"


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    up = np.cumprod(np.r_[np.uint64(1), np.full(n, _B, np.uint64)], dtype=np.uint64)
    return up, np.cumprod(np.r_[np.uint64(1), np.full(n, pow(_B, -1, 1 << 64), np.uint64)], dtype=np.uint64)


_UP, _DOWN = powers(1 << 16)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each run of ``gram`` bytes; ``data`` is no longer than the table of powers."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=prefix[1:])
    h = (prefix[gram:] - prefix[:-gram]) * _DOWN[: len(data) - gram + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def stretches(data: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """Anchors of a text: hash, first start of the strings that name it, their number, and its offset from the first.

    A string names its least k-gram hash (by the upper 44 bits), the rightmost of
    equals. Texts are taken in blocks; a stretch cut at a block's end stays right,
    as equal strings still name equal hashes.
    """
    width, size = length - gram + 1, 1 << 15
    found: list[list[np.ndarray]] = []
    for at in range(0, len(data) - length + 1, size):
        grams = gram_hashes(data[at : at + size + length - 1], gram)
        places = np.arange(len(grams), dtype=np.uint64)
        least = (grams & ~np.uint64(0xFFFFF)) | (np.uint64(0xFFFFF) - places)
        have = 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        place = (np.uint64(0xFFFFF) - (least[first] & np.uint64(0xFFFFF))).astype(np.int64)
        found.append([grams[place].view(np.int64), first + at, np.diff(np.r_[first, len(least)]), place - first])
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4


def pack(copy: np.ndarray, lo: np.ndarray, n: np.ndarray, off: np.ndarray) -> np.ndarray:
    """In the order of (copy, lo); texts below 4 GB, fewer than 2**15 texts under one id."""
    return (copy << 48) | (lo << 16) | (n << 8) | off


def _reduced(anchor: np.ndarray, printed: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[pd.DataFrame]:
    """Within a chunk: repeats of a stretch are covered; strings of a hot anchor go loose, with a mark for the others."""
    order = np.lexsort((place, doc, printed, anchor))
    anchor, printed, doc, place = anchor[order], printed[order], doc[order], place[order]
    new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
    first = new_anchor | np.r_[True, printed[1:] != printed[:-1]]
    yield pd.DataFrame({"kind": COVERED, "route": doc[~first], "print": 0, "doc_id": doc[~first], "place": place[~first]})
    anchor, printed, doc, place = anchor[first], printed[first], doc[first], place[first]
    starts = np.flatnonzero(new_anchor[first])
    hot = np.repeat(np.diff(np.r_[starts, len(anchor)]) > HOT, np.diff(np.r_[starts, len(anchor)]))
    yield pd.DataFrame({"kind": MARK, "route": np.unique(anchor[hot]), "print": 0, "doc_id": 0, "place": 0})
    yield pd.DataFrame({"kind": np.where(hot, LOOSE, STRETCH), "route": np.where(hot, printed, anchor), "print": printed, "doc_id": doc, "place": place})


def _anchored(length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch in batches:
            for doc, copy, raw in zip(batch["doc_id"].tolist(), batch["copy"].tolist(), batch["raw"], strict=True):
                anchor, lo, n, off = stretches(np.frombuffer(raw, np.uint8), length, gram)
                if not len(anchor):
                    continue
                ends = (lo + n + length - 1).tolist()
                printed = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(lo.tolist(), ends, strict=True)], np.uint64).view(np.int64)
                held.append((anchor, printed, np.full(len(lo), doc), pack(np.full(len(lo), copy), lo, n, off)))
                count += len(lo)
                if count >= CHUNK:
                    yield from _reduced(*[np.concatenate(x) for x in zip(*held, strict=True)])
                    held, count = [], 0
        if held:
            yield from _reduced(*[np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def _intervals(kind, anchor, doc: np.ndarray, place: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"kind": kind, "anchor": anchor, "doc_id": doc, "copy": place >> 48, "lo": place >> 16 & 0xFFFFFFFF, "n": place >> 8 & 0xFF, "off": place & 0xFF})


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by route, print, doc_id, place: repeats of a stretch are covered, anchors with several stretches go on.

    An anchor that is marked was hot in some chunk, so its stretches of all other chunks go loose as well.
    """
    kept = None
    for batch in _with_end(batches):
        rows = kept if batch is None else batch if kept is None else pd.concat([kept, batch], ignore_index=True)
        if rows is None or not len(rows):
            continue
        last = batch is None
        route = rows["route"].to_numpy()
        cut = len(rows) if last else int(np.searchsorted(route, route[-1]))
        kept = None if last else rows.iloc[cut:]
        kind, route, printed, doc, place = (rows[c].to_numpy()[:cut] for c in ("kind", "route", "print", "doc_id", "place"))
        through = (kind == LOOSE) | (kind == COVERED)
        if through.any():
            yield _intervals(kind[through], 0, doc[through], place[through])
        marked = np.unique(route[kind == MARK])
        plain = kind == STRETCH
        route, printed, doc, place = route[plain], printed[plain], doc[plain], place[plain]
        if not len(route):
            continue
        new = np.r_[True, route[1:] != route[:-1]]
        first = new | np.r_[True, printed[1:] != printed[:-1]]
        if not first.all():
            yield _intervals(COVERED, 0, doc[~first], place[~first])
        group = (np.cumsum(new) - 1)[first]
        hot = np.isin(route[first], marked)
        if hot.any():
            yield _intervals(LOOSE, 0, doc[first][hot], place[first][hot])
        several = (np.bincount(group)[group] > 1) & ~hot
        if several.any():
            yield _intervals(STRETCH, route[first][several], doc[first][several], place[first][several])


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


class Suffixes:
    """Suffixes of a byte buffer, compared over at most ``length`` bytes by prefix hashes."""

    def __init__(self, data: np.ndarray, length: int) -> None:
        self.data, self.length = data, length
        up, self.down = powers(len(data))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.prefix[1:])

    def extension(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the common extension at p and q, by binary search."""
        low, high = np.zeros(len(p), np.int64), np.full(len(p), self.length)
        at_p, at_q, down_p, down_q = self.prefix[p], self.prefix[q], self.down[p], self.down[q]
        for _ in range(self.length.bit_length()):
            middle = (low + high + 1) >> 1
            same = (self.prefix[p + middle] - at_p) * down_p == (self.prefix[q + middle] - at_q) * down_q
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def compare(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Negative, zero or positive as the suffix at p comes before, with or after the one at q."""
        n = self.extension(p, q)
        last = np.minimum(n, self.length - 1)
        return np.where(n >= self.length, 0, self.data[p + last].astype(np.int64) - self.data[q + last])

    def sort(self, suffix: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Stable mergesort within each segment (sorted ids), all segments at once; returns the order.

        A run meets its neighbour: each suffix finds by binary search how many of the
        other run's come before it, which gives its place in the merged run.
        """
        begin = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        size = np.diff(np.r_[begin, len(segment)])
        begin, size = np.repeat(begin, size), np.repeat(size, size)
        order = np.arange(len(suffix))
        width = 1
        while width < size.max(initial=0):
            active = np.flatnonzero(size > width)
            within = active - begin[active]
            run = within // width
            other = run ^ 1
            end = begin[active] + size[active]
            start = np.minimum(begin[active] + other * width, end)
            low, high = start.copy(), np.minimum(start + width, end)
            mine, left = suffix[order[active]], run % 2 == 0
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) >> 1
                c = self.compare(suffix[order[middle]], mine[open_])
                before = (c < 0) | ((c == 0) & ~left[open_])
                low[open_[before]] = middle[before] + 1
                high[open_[~before]] = middle[~before]
            merged = begin[active] + (run & ~1) * width + within % width + (low - start)
            changed = order.copy()
            changed[merged] = order[active]
            order = changed
            width *= 2
        return order


def repeated_starts(data: np.ndarray, suffix: np.ndarray, segment: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes equal an earlier one of their segment over ``length`` bytes.

    Suffixes come in corpus order within sorted segments. Sorted neighbours with a
    common extension of ``length`` are checked byte by byte; a segment in which a hash
    collided is compared by its bytes alone.
    """
    suffixes = Suffixes(data, length)
    order = suffixes.sort(suffix, segment)
    p, q = suffix[order[:-1]], suffix[order[1:]]
    together = segment[order[:-1]] == segment[order[1:]]
    alike = np.zeros(len(p), dtype=bool)
    alike[together] = suffixes.extension(p[together], q[together]) >= length
    repeated = np.zeros(len(suffix), dtype=bool)
    repeated[order[1:][alike]] = True
    wrong = np.zeros(len(p), dtype=bool)
    pairs = np.flatnonzero(alike)
    for at in range(0, len(pairs), 1 << 15):
        some = pairs[at : at + (1 << 15)]
        span = np.arange(length)
        wrong[some] = (data[p[some][:, None] + span] != data[q[some][:, None] + span]).any(axis=1)
    for s in np.unique(segment[order[1:][wrong]]):
        seen = set()
        for i in np.flatnonzero(segment == s).tolist():
            text = data[suffix[i] : suffix[i] + length].tobytes()
            repeated[i] = text in seen
            seen.add(text)
    return repeated


def _merged(doc: np.ndarray, copy: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Runs of consecutive starts as one stretch each."""
    order = np.lexsort((start, copy, doc))
    doc, copy, start = doc[order], copy[order], start[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (start[1:] - start[:-1] > 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    return pd.DataFrame({"doc_id": doc[first], "copy": copy[first], "lo": start[first], "n": start[last] - start[first] + 1})


def _sorted_suffixes(length: int):
    """Stretches sorted by anchor to the repeated starts among their suffixes."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["anchor", "doc_id", "copy", "lo"], kind="stable")
        data = np.frombuffer(b"".join(rows["raw"]), np.uint8)
        n = rows["n"].to_numpy().astype(np.int64)
        at = np.repeat(np.r_[0, np.cumsum(n + length - 1)[:-1]], n)
        step = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        new = np.r_[True, np.diff(rows["anchor"].to_numpy()) != 0]
        # Equal strings have the anchor at one offset, so suffixes meet only those of their offset.
        segment = np.repeat(np.cumsum(new) - 1, n) * 256 + np.repeat(rows["off"].to_numpy().astype(np.int64), n) - step
        order = np.argsort(segment, kind="stable")
        found = order[repeated_starts(data, (at + step)[order], segment[order], length)]
        pick = lambda c: np.repeat(rows[c].to_numpy().astype(np.int64), n)[found]
        return _merged(pick("doc_id"), pick("copy"), pick("lo") + step[found])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in _with_end(batches):
            if batch is not None:
                held.append(batch)
                size += int(batch["n"].sum()) + length * len(batch)
            if held and (batch is None or size >= BUFFER):
                rows = pd.concat(held, ignore_index=True)
                anchor = rows["anchor"].to_numpy()
                cut = len(rows) if batch is None else int(np.flatnonzero(anchor == anchor[-1])[0])
                held = [] if batch is None else [rows.iloc[cut:]]
                size = sum(int(h["n"].sum()) + length * len(h) for h in held)
                if cut:
                    yield solve(rows.iloc[:cut])

    return run


def _cut(length: int, with_kept: bool):
    """Texts with their covered intervals to the counts, the digest and, if wanted, the bytes of what is left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for raw, lows, counts in zip(batch["raw"], batch["lows"], batch["counts"], strict=True):
                removed = spans = 0
                kept = raw
                if lows is not None and len(lows):
                    order = np.argsort(lows, kind="stable")
                    lo, hi = np.asarray(lows)[order], (np.asarray(lows) + np.asarray(counts) + length - 1)[order]
                    reach = np.maximum.accumulate(hi)
                    first = np.flatnonzero(np.r_[True, lo[1:] > reach[:-1]])
                    lo, hi = lo[first], reach[np.r_[first[1:], len(reach)] - 1]
                    removed, spans = int((hi - lo).sum()), len(lo)
                    edges = [0, *np.c_[lo, hi].ravel().tolist(), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            done = batch[["doc_id", "copy"]].copy()
            for k, name in enumerate(("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")):
                done[name] = [x[k] for x in out]
            yield done

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_kept: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes).

    A byte is removed if a string of ``length`` bytes over it also starts earlier: in
    a document of a smaller id, or before in the same. Strings don't cross documents.

    Ids are integers. Several texts under one id come in the order of their hash, and
    documents without an id come last, in that order too. Of rows that repeat id and
    text one is the first and the others repeat it wholly. A null or empty text has
    nothing to remove. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    printed, key = F.xxhash64(text), F.col(f"`{id_col}`").cast("long")
    place = F.coalesce(key, F.lit(1 << 62) + printed.bitwiseAND(F.lit((1 << 61) - 1)))
    base = docs.select(place.alias("doc_id"), printed.alias("text_hash"), text.cast("binary").alias("raw"))

    counts = base.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"))
    shared = materialize(counts.groupBy("doc_id").agg(F.sum("rows").alias("all"), F.collect_list(F.struct("text_hash", "rows")).alias("texts")).filter("all > 1"), "shared_ids")
    again = None
    texts = base.withColumn("copy", F.lit(0))
    if not shared.isEmpty():
        ranked = shared.select("doc_id", F.posexplode(F.array_sort("texts")).alias("copy", "t"))
        ranked = materialize(ranked.select(F.col("doc_id").alias("at"), F.col("t.text_hash").alias("hash"), F.col("copy").alias("rank"), "t.rows"), "copies")
        same = (F.col("doc_id") == F.col("at")) & (F.col("text_hash") == F.col("hash"))
        texts = base.join(ranked, same, "left").withColumn("copy", F.coalesce("rank", F.lit(0))).drop("at", "hash", "rank", "rows")
        again = ranked.filter("rows > 1")
        texts = texts.dropDuplicates(["doc_id", "copy"])

    anchored = texts.select("doc_id", "copy", "raw").mapInPandas(_anchored(length, gram), ROWS)
    found = anchored.repartition("route").sortWithinPartitions("route", "print", "doc_id", "place").mapInPandas(_compared, INTERVALS)
    found = materialize(found, "stretches")
    open_ = found.filter(F.col("kind").isin(STRETCH, LOOSE))
    slice_ = F.substring("raw", F.col("lo") + 1, F.col("n") + F.lit(length - 1)).alias("raw")
    cut = texts.select("doc_id", "copy", "raw").join(open_, ["doc_id", "copy"]).select("kind", "anchor", "doc_id", "copy", "lo", "n", "off", slice_)
    cut = materialize(cut, "open_stretches")
    compared = cut.filter(F.col("kind") == STRETCH).drop("kind").repartition("anchor").sortWithinPartitions("anchor")
    compared = materialize(compared.mapInPandas(_sorted_suffixes(length), "doc_id long, copy int, lo long, n long"), "compared")  # not beside the loose strings: each needs memory

    loose = cut.filter(F.col("kind") == LOOSE).select("doc_id", "copy", "lo", "raw", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("step"))
    loose = loose.select("doc_id", "copy", (F.col("lo") + F.col("step")).alias("lo"), F.unhex(F.md5(F.substring("raw", F.col("step") + 1, F.lit(length)))).alias("string"))
    loose = materialize(loose, "loose_strings")
    where = F.struct("doc_id", "copy", "lo")
    first = loose.groupBy("string").agg(F.min(where).alias("first"), F.count("*").alias("times")).filter("times > 1")
    later = loose.join(first, "string").filter(where > F.col("first")).select("doc_id", "copy", "lo", F.lit(1).cast("long").alias("n"))

    covered = found.filter(F.col("kind") == COVERED).select("doc_id", "copy", "lo", F.col("n").cast("long")).unionByName(compared).unionByName(later)
    of = covered.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("lo", "n")).alias("spans")).select("doc_id", "copy", F.col("spans.lo").alias("lows"), F.col("spans.n").alias("counts"))
    of = materialize(of, "covered")
    joined = texts.select("doc_id", "copy", "raw").join(of, ["doc_id", "copy"], "left")
    done = joined.mapInPandas(_cut(length, with_kept), "doc_id long, copy int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    given = F.when(F.col("doc_id") < 1 << 62, F.col("doc_id"))
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    if again is None:
        return done.select(given.alias("doc_id"), *names)
    done = done.join(again.select(F.col("at").alias("doc_id"), F.col("rank").alias("copy"), "rows"), ["doc_id", "copy"], "left")
    done = done.withColumn("nth", F.explode(F.sequence(F.lit(1), F.coalesce("rows", F.lit(1)))))
    gone = (F.col("nth") > 1) & (F.col("n_bytes") >= length)
    return done.select(
        given.alias("doc_id"), "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_kept=False).drop("kept")
