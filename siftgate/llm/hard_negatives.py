"""Hard negatives by score windows, found through an inverted multi-index.

Components are scaled and rounded down to integers; a score is an integer inner product.
An anchor's positives are its best rows of the same label; of each positive it gets the
best rows of other labels whose score lies between `low` and `high` hundredths of the
positive's.

Index. Two codebooks, one for each half of the vectors, are fitted by k-means on at most
SAMPLE_ROWS rows (those of smallest hash). All rows are indexed: dealt to shards by a
hash, and in a shard to the cells (nearest code of the first half, of the second half).
A code's radius is that of its rows in the shard. For an anchor a half's score is at most
the product with the code plus the anchor's length times the radius; a cell's bound is
the sum of its two halves'. From the two sorted lists of half bounds the multi-sequence
algorithm hands out the cells by falling bound, and the search of a window ends when the
next bound is below its lower edge or its worst kept score: then it is certified, so the
result is exact whatever the codebooks are. Cells that lie wholly above all windows are
passed over. A block of anchors takes its cells in rounds of 1, 2, 4 and so on, and the
anchors that ask for a cell in a round meet its rows in one matrix product; scores too
large for exact doubles are taken anchor by anchor.

Anchors, a stated subset, meet all rows in blocks of ANCHORS. A task has one block of
anchors and searches its part of the shards, RUN at least, one after the other, keeping
its best rows, so it returns what one shard would. There are PARTS parts at most, so what
the tasks return grows with the anchors. The products grow with anchors times rows where
bounds pass nothing over, as in vectors without clusters.

Rows without id, label or vector, or with null or non-finite components, take no part; zero
and empty vectors do. Only vectors of one length are compared. Ties go to the smaller id. Rows
with the anchor's own id are no candidates. Repeated rows are candidates each; a repeated
anchor row is one anchor. Scores beyond a long are cut to its range. Other columns are
ignored. Empty tables, anchors without positives and empty windows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftgate.llm.common import each_group, hashed_sample, longs
from siftgate.plans.scratch import forget, written

SAMPLE_ROWS = 4_096
CODES = 8
STEPS = 8
SHARD_ROWS = 4_096
RUN = 4
PARTS = 16
ANCHORS = 16_384
TILE = 1 << 19
SCALE = 256
LONG = np.iinfo(np.int64)


def scaled(column: pa.ChunkedArray | pa.Array, rows: int, scale: float) -> np.ndarray:
    """Rows of equally long lists as whole numbers in doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat.reshape(rows, len(flat) // max(rows, 1)) * scale)


def codebook(x: np.ndarray, codes: int = CODES, steps: int = STEPS, seed: int = 1) -> np.ndarray:
    """At most `codes` means of the rows; one of zeros if there are no rows."""
    x = np.unique(x, axis=0)
    if len(x) <= 1:
        return x if len(x) else np.zeros((1, x.shape[1]))
    means = x[np.random.default_rng(seed).permutation(len(x))[:codes]]
    for _ in range(steps):
        near = nearest_code(x, means)
        sizes = np.bincount(near, minlength=len(means))
        sums = np.zeros_like(means)
        np.add.at(sums, near, x)
        means = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], means)
    return means


def nearest_code(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    return ((means**2).sum(axis=1)[None, :] - 2 * (x @ means.T)).argmin(axis=1)


def products(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows with a vector, as longs."""
    if not x.size:
        return np.zeros(len(x), np.int64)
    if float(np.abs(x).max()) * float(np.abs(a).max()) * len(a) < 2**52:
        return (x @ a).astype(np.int64)
    whole = [int(v) for v in a]
    sums = [sum(int(u) * v for u, v in zip(row, whole)) for row in x.tolist()]
    return np.array([min(max(s, LONG.min), LONG.max) for s in sums], np.int64)


class Cells:
    """A shard's rows in the cells of two codebooks."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        half = x.shape[1] // 2
        self.halves, self.books = (slice(0, half), slice(half, None)), books
        codes = [nearest_code(x[:, h], b) for h, b in zip(self.halves, books)]
        self.radii = []
        for h, b, code in zip(self.halves, books, codes):
            radius = np.full(len(b), -np.inf)
            np.maximum.at(radius, code, np.sqrt(((x[:, h] - b[code]) ** 2).sum(axis=1)))
            self.radii.append(radius)
        cell = codes[0] * len(books[1]) + codes[1]
        most = [np.abs(v).max(initial=0) for v in (x, *(b[code] for b, code in zip(books, codes)))]
        self.reach = float(np.nan_to_num(most, nan=np.inf, posinf=np.inf).max())
        order = np.argsort(cell, kind="stable")
        self.x, self.ids, self.labels = x[order], ids[order], labels[order]
        self.starts = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1))

    def by_bound(self, a: np.ndarray) -> Iterator[tuple[float, float, slice]]:
        """(most, least, rows) of the cells that hold rows, by the most that a row's product with a can be."""
        tops, floors, orders = [], [], []
        for h, book, radius in zip(self.halves, self.books, self.radii):
            length = np.sqrt((a[h] ** 2).sum())
            center, spread = book @ a[h], length * radius
            slack = 1e-9 * (length * np.sqrt((book**2).sum(axis=1)) + np.abs(spread)) + 1e-3
            used = np.flatnonzero(radius >= 0)
            top, low = (np.nan_to_num(v[used], nan=w) for v, w in ((center + spread + slack, np.inf), (center - spread - slack, -np.inf)))
            order = np.argsort(-top, kind="stable")
            tops.append(top[order].tolist()), floors.append(low[order].tolist()), orders.append(used[order].tolist())
        heap, seen = [(-(tops[0][0] + tops[1][0]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heappop(heap)
            cell = orders[0][i] * len(self.books[1]) + orders[1][j]
            s, e = self.starts[cell], self.starts[cell + 1]
            if e > s:
                yield -bound, floors[0][i] + floors[1][j], slice(s, e)
            for step in ((i + 1, j), (i, j + 1)):
                if step[0] < len(tops[0]) and step[1] < len(tops[1]) and step not in seen:
                    seen.add(step)
                    heappush(heap, (-(tops[0][step[0]] + tops[1][step[1]]), *step))


class Sequences:
    """The multi-sequence algorithm for many anchors: each call hands out the next cell of some, by falling bound."""

    def __init__(self, cells: Cells, a: np.ndarray):
        self.tops, self.floors, self.orders = [], [], []
        for h, book, radius in zip(cells.halves, cells.books, cells.radii):
            used = np.flatnonzero(radius >= 0)
            length = np.sqrt((a[:, h] ** 2).sum(axis=1))[:, None]
            center, spread = a[:, h] @ book[used].T, length * radius[used]
            slack = 1e-9 * (length * np.sqrt((book[used] ** 2).sum(axis=1)) + spread) + 1e-3
            order = np.argsort(-(center + spread + slack), axis=1, kind="stable")
            self.tops.append(np.take_along_axis(center + spread + slack, order, 1))
            self.floors.append(np.take_along_axis(center - spread - slack, order, 1))
            self.orders.append(used[order])
        self.width = len(cells.books[1])
        # Of each code of the first list, the code of the second that comes next and their bound, past the end -inf.
        self.at = np.zeros(self.tops[0].shape, np.int64)
        self.tops[1] = np.pad(self.tops[1], ((0, 0), (0, 1)), constant_values=-np.inf)
        self.sums = self.tops[0] + self.tops[1][:, :1]

    def next(self, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(most, least, cell) of these anchors; most is -inf if there are no more cells."""
        i = self.sums[who].argmax(axis=1)
        j = np.minimum(self.at[who, i], self.floors[1].shape[1] - 1)
        most, least = self.sums[who, i], self.floors[0][who, i] + self.floors[1][who, j]
        self.at[who, i], self.sums[who, i] = j + 1, self.tops[0][who, i] + self.tops[1][who, j + 1]
        return most, least, self.orders[0][who, i] * self.width + self.orders[1][who, j]


class Best:
    """The k best rows seen whose score is from lo to hi."""

    def __init__(self, k: int, lo: int = LONG.min, hi: int = LONG.max):
        self.k, self.lo, self.hi = k, lo, hi
        self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64)
        self.need = lo if lo <= hi else LONG.max

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        good = (score >= self.need) & (score <= self.hi)
        if not good.any():
            return
        score, ids = np.concatenate([self.score, score[good]]), np.concatenate([self.id, ids[good]])
        top = np.lexsort((ids, ~score))[: self.k]  # ~ turns the order of longs without overflow
        self.score, self.id = score[top], ids[top]
        if len(top) == self.k:
            self.need = max(self.lo, int(self.score[-1]))


class Windows:
    """A `Best` for each place of each anchor, in arrays."""

    def __init__(self, k: int, lo: np.ndarray, hi: np.ndarray):
        self.k, self.lo, self.hi = k, lo, hi
        self.score, self.id = (np.full((*lo.shape, k), v, np.int64) for v in (LONG.min, LONG.max))
        self.found = np.zeros(lo.shape, np.int64)
        self.need = np.where(lo <= hi, lo, LONG.max)

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        for place in range(self.lo.shape[1]):
            need, last = self.need[anchor, place], self.id[anchor, place, -1]
            better = (score > need) | (score == need) & ((ids < last) | (self.found[anchor, place] < self.k))
            good = np.flatnonzero(better & (score <= self.hi[anchor, place]) & (self.lo[anchor, place] <= score))
            if len(good):
                self._keep(place, anchor[good], score[good], ids[good])

    def _keep(self, place: int, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        who = np.unique(anchor)
        row, slot = np.nonzero(np.arange(self.k) < self.found[who, place][:, None])
        anchor = np.concatenate([who[row], anchor])
        score = np.concatenate([self.score[who[row], place, slot], score])
        ids = np.concatenate([self.id[who[row], place, slot], ids])
        order = np.lexsort((ids, ~score, anchor))
        slot = np.arange(len(order)) - np.searchsorted(anchor[order], anchor[order])
        order, slot = order[slot < self.k], slot[slot < self.k]
        self.score[anchor[order], place, slot], self.id[anchor[order], place, slot] = score[order], ids[order]
        np.maximum.at(self.found, (anchor[order], place), slot + 1)
        full = who[self.found[who, place] == self.k]
        self.need[full, place] = np.maximum(self.lo[full, place], self.score[full, place, -1])

    def one(self, anchor: int) -> list[Best]:
        """An anchor's windows."""
        out = []
        for place, n in enumerate(self.found[anchor]):
            w = Best(self.k, int(self.lo[anchor, place]), int(self.hi[anchor, place]))
            w.score, w.id, w.need = self.score[anchor, place, :n], self.id[anchor, place, :n], int(self.need[anchor, place])
            out.append(w)
        return out

    def put(self, anchor: int, windows: list[Best]) -> None:
        for place, w in enumerate(windows):
            n = len(w.id)
            self.score[anchor, place, :n], self.id[anchor, place, :n] = w.score, w.id
            self.found[anchor, place], self.need[anchor, place] = n, w.need


def search(cells: Cells, a: np.ndarray, own: int, wanted: Callable[[np.ndarray], np.ndarray], windows: list[Best]) -> int:
    """Fills the windows with the shard's rows of the wanted labels; returns how many cells it read."""
    read, most = 0, max((w.hi for w in windows), default=LONG.min)
    for bound, least, rows in cells.by_bound(a):
        # Scores are cut to the range of longs, so are their bounds.
        if max(bound, LONG.min) < min((w.need for w in windows), default=LONG.max):
            break
        if min(least, LONG.max) > most:
            continue
        read += 1
        take = wanted(cells.labels[rows]) & (cells.ids[rows] != own)
        score, ids = products(cells.x[rows], a)[take], cells.ids[rows][take]
        for w in windows:
            w.add(score, ids)
    return read


def search_block(cells: Cells, a: np.ndarray, own: np.ndarray, label: np.ndarray, same: bool, windows: Windows) -> None:
    """`search` for a block of anchors, for rows of the anchor's label or of all others."""
    size = np.abs(a).max(axis=1, initial=0)
    exact = size < 2**52 / max(cells.reach * a.shape[1], 1.0)
    for i in np.flatnonzero(~exact):
        found = windows.one(i)
        search(cells, a[i], own[i], lambda v: (v == label[i]) == same, found)
        windows.put(i, found)
    who = np.flatnonzero(exact)
    if not len(who):
        return
    # Whole numbers below the edge, so that sums in any order are exact.
    small = float(size[who].max()) * cells.reach * a.shape[1] < 2**24
    edge, kind = (2**24, np.float32) if small else (2**52, np.float64)
    x, b = cells.x.astype(kind), a.astype(kind)

    def meet(anchors: np.ndarray, rows: slice) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        step = max(1, TILE // (rows.stop - rows.start))
        for s in range(0, len(anchors), step):
            m = anchors[s : s + step]
            score = b[m] @ x[rows].T
            least = np.clip(windows.need[m].min(axis=1), -edge, edge).astype(kind)
            i, j = np.divmod(np.flatnonzero(score >= least[:, None]), score.shape[1])
            ids = cells.ids[rows][j]
            good = ((cells.labels[rows][j] == label[m[i]]) == same) & (ids != own[m[i]])
            yield m[i[good]], score[i[good], j[good]].astype(np.int64), ids[good]

    sequences, most, many = Sequences(cells, a), windows.hi.max(axis=1), 1
    while len(who):
        asked = []
        for _ in range(many):
            bound, least, cell = sequences.next(who)
            go = (bound >= windows.need[who].min(axis=1)) & (bound > -np.inf)
            asked.append((who[go & (least <= most[who])], cell[go & (least <= most[who])]))
            who = who[go]
        anchors, cell = (np.concatenate(v) for v in zip(*asked))
        order = np.argsort(cell, kind="stable")
        anchors, cell = anchors[order], cell[order]
        held, n = [], 0
        for c in np.unique(cell):
            s, e = np.searchsorted(cell, [c, c + 1])
            if cells.starts[c + 1] == cells.starts[c]:
                continue
            for found in meet(anchors[s:e], slice(cells.starts[c], cells.starts[c + 1])):
                held.append(found)
                n += len(found[0])
                if n > TILE:
                    windows.add(*(np.concatenate(v) for v in zip(*held)))
                    held, n = [], 0
        if held:
            windows.add(*(np.concatenate(v) for v in zip(*held)))
        many *= 2


KEYS = ["dim", "part", "block"]
_POSITIVE = "anchor_id long, q long, positive_id long, positive_score long"
_NEGATIVE = "anchor_id long, q long, place long, positive_id long, positive_score long, negative_id long, negative_score long"


def _edges(scores: list[list[int]], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows' edges, anchors by places; no score lies in those that fill up."""
    shape = (len(scores), max(map(len, scores), default=0))
    lo, hi = np.full(shape, LONG.max), np.full(shape, LONG.min)
    for i, row in enumerate(scores):
        for place, s in enumerate(row):
            least, most = -(-low * s // 100), high * s // 100
            if max(least, LONG.min) <= min(most, LONG.max):
                lo[i, place], hi[i, place] = max(least, LONG.min), min(most, LONG.max)
    return lo, hi


def _task(books: dict[int, tuple[np.ndarray, np.ndarray]], scale: float, k: int, low: int, high: int, mining: bool):
    def asked(table: pa.Table) -> tuple[pa.Table, Windows]:
        if mining:
            return table, Windows(k, *_edges(table.column("scores").to_pylist(), low, high))
        return table, Windows(k, *(np.full((table.num_rows, 1), v) for v in (LONG.min, LONG.max)))

    def results(anchors: pa.Table, windows: Windows) -> Iterator[pa.RecordBatch]:
        step = max(1, 20_000 // max(1, windows.lo.shape[1] * k))
        for start in range(0, anchors.num_rows, step):
            some = anchors.slice(start, step)
            i, place, slot = np.nonzero(np.arange(k) < windows.found[start : start + step, :, None])
            out = [longs(some, "id")[i], longs(some, "q")[i]]
            if mining:
                width = windows.lo.shape[1]
                lists = [np.array([v + [0] * (width - len(v)) for v in some.column(c).to_pylist()], np.int64) for c in ("positives", "scores")]
                out += [place, *(v[i, place] for v in lists)]
            out += [v[start + i, place, slot] for v in (windows.id, windows.score)]
            names = [f.split()[0] for f in (_NEGATIVE if mining else _POSITIVE).split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    def run(batches):
        current, block = None, None
        for table in each_group(batches, [*KEYS, "shard"]):
            key = tuple(int(longs(table, c)[0]) for c in KEYS)
            if key != current:
                if block:
                    yield from results(*block)
                current, block = key, None
            x = scaled(table.column("v"), table.num_rows, scale)
            if longs(table, "shard")[0] < 0:
                block, a = asked(table.drop_columns(["v"])), x
            elif block:
                cells = Cells(x, longs(table, "id"), longs(table, "label"), books[key[0]])
                search_block(cells, a, longs(block[0], "id"), longs(block[0], "label"), not mining, block[1])
        if block:
            yield from results(*block)

    return run


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double") * scale) < float("inf"), F.lit(False)))
    usable = F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False))
    rows = vectors.where(usable).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"),
        F.size(v).cast("long").alias("dim"), F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    )
    rows = written(rows, "vectors")
    sizes = {r["dim"]: (r["n"], r["asks"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("asks")).collect()}
    some = hashed_sample(rows.select("id", "v", "dim"), ["id", "v"], SAMPLE_ROWS).toArrow()
    books = {}
    for dim in sizes:
        of = some.filter(pa.compute.equal(some.column("dim"), dim))
        x = scaled(of.column("v"), of.num_rows, scale) if of.num_rows else np.empty((0, dim))
        books[dim] = (codebook(x[:, : dim // 2]), codebook(x[:, dim // 2 :]))

    shards = max([-(-n // SHARD_ROWS) for n, _ in sizes.values()], default=1)
    parts = min(-(-shards // RUN), PARTS)
    blocks = max([1, *(-(-a // ANCHORS) for _, a in sizes.values())])
    zero = F.lit(0).cast("long")
    every = lambda n: F.explode(F.sequence(zero, F.lit(n - 1).cast("long")))
    shard = F.pmod(F.xxhash64("id", "v", "label"), F.lit(shards))
    none = F.lit(None).cast("array<long>")
    data = rows.select("id", "label", "v", "dim", shard.alias("shard"), zero.alias("q"), none.alias("positives"), none.alias("scores"))
    data = data.withColumn("part", F.pmod("shard", F.lit(parts).cast("long"))).withColumn("block", every(blocks))
    anchors = rows.where("asks").dropDuplicates(["id", "label", "v"]).withColumn("q", F.xxhash64("label", "v")).drop("asks")
    anchors = written(anchors, "anchors")

    def meet(asked: DataFrame, k: int, mining: bool, schema: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id", "q"), F.lit(blocks))
        asked = asked.withColumns({"shard": F.lit(-1).cast("long"), "block": block}).withColumn("part", every(parts))
        dealt = data.unionByName(asked).repartition(*KEYS).sortWithinPartitions(*KEYS, "shard")
        return dealt.mapInArrow(_task(books, scale, k, low, high, mining), schema)

    first = meet(anchors.withColumns({"positives": none, "scores": none}), positives, False, _POSITIVE)
    order = W.partitionBy("anchor_id", "q").orderBy(F.col("positive_score").desc(), "positive_id")
    near = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    lists = near.groupBy("anchor_id", "q").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    lists = lists.select(F.col("anchor_id").alias("id"), "q", F.col("p.positive_id").alias("positives"), F.col("p.positive_score").alias("scores"))
    asked = written(anchors.join(lists, ["id", "q"]), "anchors")
    forget(anchors)
    second = meet(asked, negatives, True, _NEGATIVE)
    order = W.partitionBy("anchor_id", "q", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
