"""Repeated byte strings across all documents, found with suffix arrays and removed.

A byte goes when some string of LENGTH bytes that covers it also starts earlier: in a
document with a smaller id, or earlier in the same one.

1. Anchors. The window at each start is owned by its least hashed KGRAM, the leftmost of
   equals. Equal windows have equal owners at equal offsets. A run of starts with one owner
   is a context string, keyed by the owner's hash. Keys seen once cannot repeat and go.
2. Equal context strings of a key are collapsed with partial minima: all but the earliest
   occurrence repeat it as a whole. What is left are distinct strings, each with its earliest place.
3. Suffix array, over the distinct strings of keys that have several: two-stage sorting.
   Only suffixes smaller than their successors are sorted directly, to LENGTH bytes. The
   others are induced by scanning the buckets of first bytes in order: a suffix found
   there puts its predecessor, if larger, at the front part of the predecessor's bucket.
   Neighbours with a common prefix of LENGTH bytes are equal windows; all but the earliest repeat it.

Keys with more than CHUNK distinct strings are cut into chunks that meet pair by pair, so
no task holds a whole large group. Work per task is bounded by pieces of texts, not by texts.

Null texts are empty. Documents are identified by id and text: rows that repeat both are one
document and get the same result; documents with one id and different texts come in the
order of a 32-bit hash of the text; a null id comes last. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgate.llm.common import binary_parts, dealt, longs, tiled, whole_groups
from siftgate.plans.scratch import forget, written

LENGTH = 100
KGRAM = 24
PIECE = 1 << 19
CHUNK = 2_000
STRINGS = 4_000
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_AT = np.uint64((1 << 20) - 1)


def _kgram_hashes(b: np.ndarray) -> np.ndarray:
    n = len(b) - KGRAM + 1
    words = np.ndarray((len(b) - 7,), "<u8", np.ascontiguousarray(b), strides=(1,))
    h = words[:n] * _C[0]
    h ^= h >> np.uint64(32)
    h += words[8 : 8 + n] * _C[1]
    h ^= h >> np.uint64(29)
    h += words[16 : 16 + n]
    h *= _C[2]
    h ^= h >> np.uint64(32)
    return h


def context_strings(b: np.ndarray, ends: np.ndarray, length: int = LENGTH):
    """(key, first start, number of starts) of the runs of starts with one owner.

    b holds texts end to end, `ends` their ends; a window lies within one text.
    """
    none = np.empty(0, np.int64)
    if len(b) < length:
        return none, none, none
    h = _kgram_hashes(b)
    low = (h & ~_AT) | np.arange(len(h), dtype=np.uint64)
    width, span = length - KGRAM + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(b) - length + 1], low[width - span :][: len(b) - length + 1])
    valid = np.ones(len(low), bool)
    for e in ends.tolist():
        valid[max(e - length + 1, 0) : e] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none
    owner = (low[at] & _AT).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return h[owner[new]].view(np.int64), at[new], np.diff(np.append(new, len(at)))


def _anchors(length: int):
    def of_piece(raw, ends, start, ord_, th, base):
        """Rows for raw[start:ends[-1]], whose texts end at `ends`; base is the place of `start` in a text."""
        b = raw[start : ends[-1]]
        key, first, n = context_strings(b, ends - start, length)
        if not len(key):
            return None
        digest = xxhash.xxh3_64_intdigest
        data = b.tobytes()
        text = np.array([digest(data[i:j]) for i, j in zip(first.tolist(), (first + n + length - 1).tolist())], np.uint64).view(np.int64)
        doc = np.searchsorted(ends - start, first, "right")
        begins = np.concatenate([[0], ends[:-1] - start])
        at = first - begins[doc] + (base if len(ends) == 1 else 0)
        columns = [key, text, ord_[doc], th[doc], at, n]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["key", "text", "ord", "th", "at", "n"])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, starts, sizes = binary_parts(batch.column("bytes"))
            ord_, th = longs(batch, "ord"), longs(batch, "th")
            i = 0
            while i < len(sizes):
                j, total = i, 0
                while j < len(sizes) and total + sizes[j] <= PIECE:
                    total += sizes[j]
                    j += 1
                if j > i:
                    out = of_piece(raw, starts[i:j] + sizes[i:j], starts[i], ord_[i:j], th[i:j], 0)
                    if out is not None:
                        yield out
                    i = j
                    continue
                for at in range(0, int(sizes[i]) - length + 1, PIECE):
                    end = starts[i] + min(sizes[i], at + PIECE + length - 1)
                    out = of_piece(raw, np.array([end]), starts[i] + at, ord_[i : i + 1], th[i : i + 1], at)
                    if out is not None:
                        yield out
                i += 1

    return run


def two_stage_order(t: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted positions of t in the order of their suffixes, to `depth` bytes at least.

    t ends in `depth` padding bytes. Positions that wanted ones are induced from come along.
    """
    n = len(t)
    step = np.sign(t[1:].astype(np.int16) - t[:-1].astype(np.int16))
    # The next different byte decides: larger makes a suffix smaller than its successor.
    change = np.flatnonzero(step)
    place = np.searchsorted(change, np.arange(n - 1))
    smaller = np.zeros(n, bool)
    inside = place < len(change)
    smaller[:-1][inside] = step[change[place[inside]]] > 0
    needed = wanted.copy()
    front = np.flatnonzero(wanted & ~smaller) + 1
    front = front[front < n]
    while len(front):
        front = front[~needed[front]]
        needed[front] = True
        front = front[~smaller[front]] + 1
        front = front[front < n]
    direct = np.flatnonzero(needed & smaller)
    windows = np.lib.stride_tricks.sliding_window_view(np.append(t, np.zeros(depth, np.uint8)), depth)
    direct = direct[np.argsort(np.ascontiguousarray(windows[direct]).view(f"S{depth}").ravel(), kind="stable")]
    bounds = np.searchsorted(t[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if needed[n - 1]:
        induced[t[n - 1]].append(np.array([n - 1]))
    order = []
    larger = needed & ~smaller
    for c in range(256):
        wave = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        bucket = []
        while len(wave):
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[larger[before] & (t[before] == c)]
        bucket.append(direct[bounds[c] : bounds[c + 1]])
        found = np.concatenate(bucket)
        if not len(found):
            continue
        order.append(found)
        before = found[found > 0] - 1
        before = before[larger[before] & (t[before] > c)]
        if len(before):
            first = t[before]
            by = np.argsort(first, kind="stable")
            cut = np.searchsorted(first[by], np.arange(c + 1, 257))
            for k in np.flatnonzero(np.diff(cut)):
                induced[c + 1 + k].append(before[by[cut[k] : cut[k + 1]]])
    sa = np.concatenate(order) if order else np.empty(0, np.int64)
    return sa[wanted[sa]]


def common_prefixes(t: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix in order with the one before, up to depth; 0 for the first."""
    windows = np.lib.stride_tricks.sliding_window_view(np.append(t, np.zeros(depth, np.uint8)), depth)
    out = np.zeros(len(order), np.int64)
    for i in range(1, len(order), 1 << 15):
        rows = windows[order[i - 1 : i + (1 << 15)]]
        unlike = rows[1:] != rows[:-1]
        some = unlike.any(axis=1)
        out[i : i + len(some)] = np.where(some, unlike.argmax(axis=1), depth)
    return out


def _repeats(length: int):
    def run(batches):
        for table in whole_groups(batches, ["key", "lo", "hi"], STRINGS):
            raw, starts, sizes = binary_parts(table.column("bytes"))
            ord_, th, at, n = (longs(table, c) for c in ("ord", "th", "at", "n"))
            total = int(sizes.sum())
            base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            source = np.repeat(starts - base, sizes) + np.arange(total)
            t = np.append(raw[source], np.zeros(length, np.uint8))
            row = np.repeat(np.arange(len(n)), n)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            begins = base[row] + offset
            wanted = np.zeros(len(t), bool)
            wanted[begins] = True
            order = two_stage_order(t, wanted, length)
            prefix = common_prefixes(t, order, length)
            group = np.cumsum(prefix < length) - 1
            # The place of each start among all: by document, then position; one rank for one place.
            o, h, p = ord_[row], th[row], at[row] + offset
            by = np.lexsort((p, h, o))
            new = (np.diff(o[by]) != 0) | (np.diff(h[by]) != 0) | (np.diff(p[by]) != 0)
            rank = np.empty(len(t), np.int64)
            rank[begins[by]] = np.concatenate([[0], np.cumsum(new)])
            mine = rank[order]
            first = np.minimum.reduceat(mine, np.flatnonzero(np.diff(group, prepend=-1))) if len(mine) else mine
            hit = np.zeros(len(t), bool)
            hit[order] = mine > first[group]
            hit = hit[begins]
            edge = hit & ~np.concatenate([[False], hit[:-1] & (row[1:] == row[:-1])])
            last = hit & ~np.concatenate([hit[1:] & (row[1:] == row[:-1]), [False]])
            e, z = np.flatnonzero(edge), np.flatnonzero(last)
            columns = [o[e], h[e], p[e], p[z]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["ord", "th", "start", "last"])

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    return docs.select(F.col(id_col).alias("id"), order.alias("ord"), F.xxhash64(text).bitwiseAND((1 << 32) - 1).alias("th"), text.alias("bytes"))


def repeated_starts(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Ranges (ord, th, start, last) of starts whose string also starts earlier."""
    anchors = rows.select("ord", "th", "bytes").mapInArrow(_anchors(length), "key long, text long, ord long, th long, at long, n long")
    often = anchors.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    seen = written(anchors.join(often, "key"), "anchors")
    place = F.struct("ord", "th", "at")
    distinct = written(seen.groupBy("key", "text").agg(F.min(place).alias("first"), F.max("n").alias("n")), "strings")
    copies = seen.join(distinct.select("key", "text", "first"), ["key", "text"]).where(place != F.col("first"))
    copied = copies.select("ord", "th", F.col("at").alias("start"), (F.col("at") + F.col("n") - 1).alias("last"))
    several = distinct.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    open_ = distinct.join(several, "key").select("key", "first.*", "n")
    cut = F.substr("bytes", (F.col("at") + 1).cast("int"), (F.col("n") + length - 1).cast("int"))
    strings = open_.join(rows.select("ord", "th", "bytes"), ["ord", "th"]).select("key", "ord", "th", "at", "n", cut.alias("bytes"))
    tiles = dealt(tiled(strings, ["key"], ["ord", "th", "at"], CHUNK), ["key", "lo", "hi"])
    found = tiles.mapInArrow(_repeats(length), "ord long, th long, start long, last long")
    repeats = written(copied.unionByName(found), "repeats")
    forget(seen, distinct)
    return repeats


def _kept(length: int):
    @F.arrow_udf("struct<n_removed: long, n_spans: long, kept: binary>")
    def of(texts: pa.Array, starts: pa.Array, lasts: pa.Array) -> pa.Array:
        removed, spans, kept = [], [], []
        for text, s, e in zip(texts, starts, lasts):
            data = text.as_py()
            if not s.is_valid or not len(s):
                removed.append(0), spans.append(0), kept.append(data)
                continue
            a, z = s.values.to_numpy(zero_copy_only=False), e.values.to_numpy(zero_copy_only=False) + length
            by = np.argsort(a, kind="stable")
            a, reach = a[by], np.maximum.accumulate(z[by])
            new = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
            begin, end = a[new], reach[np.append(new[1:] - 1, len(a) - 1)]
            removed.append(int((end - begin).sum()))
            spans.append(len(new))
            cuts = zip([0, *end.tolist()], [*begin.tolist(), len(data)])
            kept.append(b"".join([data[i:j] for i, j in cuts]))
        return pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["n_removed", "n_spans", "kept"])

    return of


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row (id, n_bytes, n_removed, n_spans, kept) per row of docs; kept is binary."""
    rows = keyed(docs, id_col, text_col)
    ranges = repeated_starts(rows, length).groupBy("ord", "th").agg(F.collect_list(F.struct("start", "last")).alias("r"))
    joined = rows.join(ranges, ["ord", "th"], "left")
    result = joined.withColumn("x", _kept(length)(F.col("bytes"), F.col("r.start"), F.col("r.last")))
    return result.select("id", F.octet_length("bytes").cast("long").alias("n_bytes"), "x.n_removed", "x.n_spans", "x.kept")
