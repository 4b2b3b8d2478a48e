"""The trie of all prefixes of conversations, held in minimal-perfect-hash node tables.

A node is a distinct sequence of first turns (role, text); the root is the empty one. Its
digest is the sum modulo 2^64, taken twice, of mixed hashes of (place, turn), so digests
along a conversation are running sums and a conversation of any length may be cut into
pieces. Rows are range-partitioned on (conversation, place) into pieces of about
PIECE_ROWS rows; one conversation or one first turn with a third of all rows is no larger
a task than any other. What a cut conversation carries from piece to piece is one row per
piece, summed up on the driver.

A piece is a shard of the trie. Its task enumerates the distinct digests, gives each a
slot by a minimal perfect hash whose slots keep the digests they stand for (`PerfectHash`),
scatters counts into flat arrays over the slots and sends one row per slot on. Shards'
rows of one node are summed with a partial sum per task. Then each node's own worth
(a leaf, tokens saved) goes to the one shard of its smallest member, is scattered to its
slot, and is accumulated through the array of parent slots, deepest depth first; the sums
over the shards are the sums over the whole subtree, as each node's worth was put in one
shard and reached all its ancestors there.

Rows without a conversation id take no part. A null role or text is an empty one. Turns come
in the order of `turn`, null first; ties in the order of the hex MD5 of the turn. Repeated
rows are turns of their own. Texts of any length are hashed once, natively, and move no
further. Other columns are ignored. An empty table has no members, thus no root and no rows.
Two different prefixes with one 128-bit digest would raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgate.llm.common import each_group, longs
from siftgate.plans.joins import lookup_join
from siftgate.plans.scratch import forget, written

PIECE_ROWS = 200_000
FAMILY = 20
SHARED_TURNS = 4
WORD = r"[^\x20\x09-\x0D]+"
# Children of parents with more of them find their parent's row by a checked broadcast.
MANY_CHILDREN = 1_000


def _mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash, on unsigned arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0 to n-1, one for each of n distinct 128-bit keys and none left over.

    Keys alone in their place of a level's bit array stay there, the others go on to the next
    level. A key's slot is the number of bits set before its own. `keys` holds each slot's key.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.keys = np.empty((len(a), 2), np.uint64)
        left, used = np.arange(len(a)), 0
        while len(left):
            size = max(64, 2 * len(left))
            at = self._place(a[left], b[left], len(self.levels), size)
            bits = np.bincount(at, minlength=size) == 1
            rank = used - 1 + np.cumsum(bits)
            alone = bits[at]
            slots = rank[at[alone]]
            self.keys[slots, 0], self.keys[slots, 1] = a[left[alone]], b[left[alone]]
            self.levels.append((bits, rank))
            used += int(alone.sum())
            left = left[~alone]

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mix(a ^ _mix(b + np.uint64(level + 1))) % np.uint64(size)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that the table does not hold."""
        out = np.full(len(a), -1)
        left = np.arange(len(a))
        for level, (bits, rank) in enumerate(self.levels):
            at = self._place(a[left], b[left], level, len(bits))
            here = bits[at]
            out[left[here]] = rank[at[here]]
            left = left[~here]
        known = out >= 0
        same = (self.keys[out[known], 0] == a[known]) & (self.keys[out[known], 1] == b[known])
        out[np.flatnonzero(known)[~same]] = -1
        return out


def _unsigned(table: pa.Table, name: str) -> np.ndarray:
    return longs(table, name).view(np.uint64)


def _ranged(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    keys_ = [F.col(k).asc_nulls_first() for k in keys]
    return df.repartitionByRange(max(1, -(-rows // PIECE_ROWS)), *keys_).sortWithinPartitions(*keys_)


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the piece and the place of each row among the piece's rows of its conversation."""
    piece, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        c = longs(batch, "c")
        starts = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1])
        sizes = np.diff(np.append(starts, len(c)))
        place = np.arange(1, len(c) + 1) - np.repeat(starts, sizes)
        if c[0] == last:
            place[: sizes[0]] += count
        last, count = c[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.select(["c", "key", "words"]).columns, pa.array(np.full(len(c), piece)), pa.array(place)], ["c", "key", "words", "piece", "i"]
        )


def turns(conversations: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """Rows (c, i, key, words): each conversation's turns numbered from 1; key is the turn's MD5."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role_col, text_col))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    # `row` only spreads repeated rows over pieces; their order among each other is of no effect.
    base = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), key.alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"),
    )
    base = written(base, "turns")
    ranged = _ranged(base, base.count(), "c", "turn", "key", "row").select("c", "key", "words")
    local = written(ranged.mapInArrow(_numbered, "c long, key binary, words long, piece long, i long"), "numbered")
    forget(base)
    last = F.max(F.struct("c", "i")).alias("last")
    edges = sorted(local.groupBy("piece").agg(F.min("c").alias("lo"), last).collect())  # one row per piece
    before, c, n = [], None, 0
    for e in edges:
        before.append((e.piece, e.lo, n if e.lo == c else 0))
        c, n = e.last.c, e.last.i + (n if e.lo == c == e.last.c else 0)
    moved = local.sparkSession.createDataFrame([x for x in before if x[2]], "piece long, c long, before long")
    out = local.join(F.broadcast(moved), ["piece", "c"], "left")
    return out.select("c", (F.col("i") + F.coalesce("before", F.lit(0))).alias("i"), "key", "words")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations of a family share their first turns: (c, d, key, words, last) and all ids (c, turnless).

    Of turns(): conversation c gets the first h turns of conversation c - c % FAMILY, all if there
    are fewer, then its own after its first h; h = crc32(c) % SHARED_TURNS.
    """
    sizes = rows.groupBy("c").agg(F.max("i").alias("n"))
    sizes = sizes.withColumns({"h": F.crc32(F.col("c").cast("string").cast("binary")) % SHARED_TURNS, "donor": F.col("c") - F.col("c") % FAMILY})
    donors = sizes.select(F.col("c").alias("donor"), F.col("n").alias("donor_n"))
    k = F.least("h", F.coalesce("donor_n", F.lit(0)))
    convs = written(sizes.join(donors, "donor", "left").select("c", "n", "h", "donor", k.alias("k")), "conversations")
    own = lookup_join(rows, convs.select("c", "n", "h", "k"), ["c"], "inner", salt_by=["i"]).where(F.col("i") > F.col("h"))
    own = own.select("c", (F.col("i") - F.col("h") + F.col("k")).alias("d"), "key", "words", (F.col("i") == F.col("n")).alias("last"))
    heads = rows.where(F.col("i") < SHARED_TURNS).withColumnRenamed("c", "donor").join(convs, "donor").where(F.col("i") <= F.col("k"))
    heads = heads.select("c", F.col("i").alias("d"), "key", "words", ((F.col("i") == F.col("k")) & (F.col("n") <= F.col("h"))).alias("last"))
    return own.union(heads), convs.select("c", ((F.col("k") == 0) & (F.col("n") <= F.col("h"))).alias("turnless"))


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the piece and the running digests of each conversation within the piece."""
    piece, last, carry = TaskContext.get().partitionId(), None, np.zeros(2, np.uint64)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        c, d = longs(batch, "c"), longs(batch, "d").astype(np.uint64)
        key = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint64).reshape(n, 2)
        starts = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1])
        sizes = np.diff(np.append(starts, n))
        out = []
        for j in (0, 1):
            h = _mix(key[:, j] ^ _mix(key[:, 1 - j] + d * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j)))
            run = np.cumsum(h)
            run -= np.repeat(run[starts] - h[starts], sizes)
            if c[0] == last:
                run[: sizes[0]] += carry[j]
            out.append(run)
        last, carry = c[-1], np.array([out[0][-1], out[1][-1]])
        pairs = [pa.array(x.view(np.int64)) for x in (*out, np.ascontiguousarray(key[:, 0]), np.ascontiguousarray(key[:, 1]))]
        columns = [pa.array(np.full(n, piece)), *batch.select(["c", "d", "words", "last"]).columns, *pairs]
        yield pa.RecordBatch.from_arrays(columns, ["piece", "c", "d", "words", "last", "p1", "p2", "k1", "k2"])


SHARD = "piece long, p1 long, p2 long, q1 long, q2 long, k1 long, k2 long, depth long, words long, n long, low long, ends string"


def _shards(before: dict[int, tuple[int, int, int]]):
    """A piece's rows to one row per slot. `before`: the conversation that a piece goes on with, its digests so far."""

    def run(batches):
        for table in each_group(batches, ["piece"]):
            piece = int(longs(table, "piece")[0])
            c, d, words = (longs(table, x) for x in ("c", "d", "words"))
            p = np.stack([_unsigned(table, "p1"), _unsigned(table, "p2")], axis=1).copy()
            q = np.zeros_like(p)
            conv, *sofar = before.get(piece, (None, 0, 0))
            sofar = np.array(sofar, np.int64).view(np.uint64)
            if conv is not None:
                p[c == conv] += sofar
            q[1:][c[1:] == c[:-1]] = p[:-1][c[1:] == c[:-1]]
            if c[0] == conv:
                q[0] = sofar
            order = np.lexsort((np.arange(len(c)), p[:, 1], p[:, 0]))
            new = np.ones(len(order), bool)
            new[1:] = (p[order[1:]] != p[order[:-1]]).any(axis=1)
            first = order[new]
            table_of = PerfectHash(p[first, 0], p[first, 1])
            slot = table_of.slots(p[:, 0], p[:, 1])
            size = len(first)
            at = np.empty(size, np.int64)
            at[slot[first]] = first  # the row with the smallest id, as rows are sorted by it
            k1, k2 = longs(table, "k1"), longs(table, "k2")
            checked = [q[:, 0], q[:, 1], k1, k2, d]
            if any((x != x[at[slot]]).any() for x in checked):
                raise ValueError("two prefixes with one digest")
            ending = np.flatnonzero(table.column("last").to_numpy())
            ending = ending[np.argsort(slot[ending], kind="stable")]
            cut = np.searchsorted(slot[ending], np.arange(size + 1))
            ends = [",".join(map(str, c[ending[s:e]].tolist())) if e > s else None for s, e in zip(cut[:-1], cut[1:])]
            columns = [np.full(size, piece), *(x[at].view(np.int64) for x in (p[:, 0].copy(), p[:, 1].copy(), q[:, 0].copy(), q[:, 1].copy()))]
            columns += [k1[at], k2[at], d[at], words[at], np.bincount(slot, minlength=size), c[at]]
            yield from pa.table([*map(pa.array, columns), pa.array(ends, pa.string())], names=[f.split()[0] for f in SHARD.split(", ")]).to_batches(20_000)

    return run


def _accumulate(after: dict[int, tuple[int, int, int, int]]):
    """Slots (depth set) and worths (depth null) of a shard to the sums over each slot's subtree."""

    def run(batches):
        for table in each_group(batches, ["piece"]):
            piece = int(longs(table, "piece")[0])
            own = table.filter(table.column("is_slot"))
            a, b, depth = _unsigned(own, "p1"), _unsigned(own, "p2"), longs(own, "depth")
            node = PerfectHash(a, b)
            slot = node.slots(a, b)
            level = np.empty(len(a), np.int64)
            level[slot] = depth
            parent = np.empty(len(a), np.int64)
            parent[slot] = node.slots(_unsigned(own, "q1"), _unsigned(own, "q2"))
            sums = np.zeros((len(a), 2), np.int64)
            worth = table.filter(pa.compute.invert(table.column("is_slot")))
            at = node.slots(_unsigned(worth, "p1"), _unsigned(worth, "p2"))
            if (at < 0).any():
                raise ValueError("a node is not in the shard of its smallest member")
            np.add.at(sums, at, np.stack([longs(worth, "leaf"), longs(worth, "saved")], axis=1))
            if piece in after:
                p1, p2, *rest = after[piece]
                sums[node.slots(*(np.array([x], np.int64).view(np.uint64) for x in (p1, p2)))[0]] += rest
            order = np.argsort(-level, kind="stable")
            cut = np.flatnonzero(np.diff(level[order])) + 1
            for at in np.split(order, cut):
                up = at[parent[at] >= 0]
                np.add.at(sums, parent[up], sums[up])
            some = np.flatnonzero(sums.any(axis=1))
            keys = node.keys[some].view(np.int64)
            columns = [keys[:, 0].copy(), keys[:, 1].copy(), sums[some, 0], sums[some, 1]]
            yield from pa.table(list(map(pa.array, columns)), names=["p1", "p2", "leaves", "saved"]).to_batches(20_000)

    return run


def _digest_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of ids of one node after another to the hash of their list."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, text in zip(zip(longs(batch, "p1").tolist(), longs(batch, "p2").tolist()), batch.column("ends")):
            if k == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            state.update(text.as_buffer())
        if done:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*done))), ["p1", "p2", "sha"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], ["p1", "p2", "sha"])


def prefix_trie(paths: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per node of the trie of paths (c, d, key, words, last), d from 1 without gaps.

    ids (c, turnless) lists all members; the turnless ones end at the root. Returns conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = paths.sparkSession
    paths = written(paths, "paths")
    ranged = _ranged(paths, paths.count(), "c", "d")
    local = written(ranged.mapInArrow(_sums, "piece long, c long, d long, words long, last boolean, p1 long, p2 long, k1 long, k2 long"), "sums")
    forget(paths)
    tail = F.max(F.struct("c", "d", "p1", "p2")).alias("t")
    edges = sorted(local.groupBy("piece").agg(F.min("c").alias("lo"), tail).collect())  # one row per piece
    before, last_of, sofar, c = {}, {}, (0, 0), None
    for e in edges:
        goes_on = e.lo == c
        if goes_on:
            before[e.piece] = (c, *sofar)
        own = (e.t.p1, e.t.p2)
        if goes_on and e.t.c == c:
            own = tuple(int(x) for x in (np.array(own, np.int64).view(np.uint64) + np.array(sofar, np.int64).view(np.uint64)).view(np.int64))
        c, sofar = e.t.c, own
        last_of[e.piece] = own
    sorted_ = local.repartition("piece").sortWithinPartitions("piece", "c", "d")
    shards = written(sorted_.mapInArrow(_shards(before), SHARD), "shards")
    forget(local)

    same = F.xxhash64("q1", "q2", "k1", "k2", "depth")
    nodes = shards.groupBy("p1", "p2").agg(
        F.min("low").alias("conv_id"), F.min("depth").alias("depth"), F.sum("n").alias("n_convs"), F.min("words").alias("words"),
        F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("piece").alias("piece"), F.min(same).alias("v"), F.max(same).alias("w"),
    )
    clash = F.when(F.col("v") != F.col("w"), F.raise_error(F.lit("two prefixes with one digest")).cast("long")).otherwise(F.col("n_convs"))
    nodes = written(nodes.withColumn("n_convs", clash).drop("v", "w"), "nodes")
    kids = nodes.groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes_ = nodes.join(kids, ["p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes_ = nodes_.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    old, nodes = nodes, written(nodes_, "nodes")
    forget(old)

    # What later pieces of a cut conversation add to its last row of a piece.
    at_lo = spark.createDataFrame([(e.piece, e.lo) for e in edges if e.piece in before], "piece long, conv_id long")
    worth = nodes.join(F.broadcast(at_lo), ["piece", "conv_id"]).groupBy("piece").agg(F.sum("leaf"), F.sum("saved"))
    worth = {r[0]: (r[1], r[2]) for r in worth.collect()}  # at most one row per piece
    # Unless another conversation brings the row above the cut into the piece, with all above it.
    cuts = spark.createDataFrame([(k, *v[1:]) for k, v in before.items()], "piece long, p1 long, p2 long")
    whole = {r.piece for r in shards.join(F.broadcast(cuts), ["piece", "p1", "p2"]).select("piece").collect()}
    after, carry = {}, (0, 0)
    for e, following in zip(reversed(edges), [None, *reversed(edges)]):
        if following is None or following.piece not in before or following.piece in whole:
            carry = (0, 0)
        else:
            more = worth.get(following.piece, (0, 0))
            inherited = carry if following.t.c == following.lo else (0, 0)
            carry = (more[0] + inherited[0], more[1] + inherited[1])
        if any(carry):
            after[e.piece] = (*last_of[e.piece], *carry)
    slots = shards.select("piece", "p1", "p2", "q1", "q2", "depth", F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"), F.lit(True).alias("is_slot"))
    worths = nodes.where("leaf > 0 OR saved > 0").select("piece", "p1", "p2", "q1", "q2", "depth", "leaf", "saved", F.lit(False).alias("is_slot"))
    by_piece = slots.union(worths).repartition("piece").sortWithinPartitions("piece")
    totals = by_piece.mapInArrow(_accumulate(after), "p1 long, p2 long, leaves long, saved long")
    totals = totals.groupBy("p1", "p2").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    chunks = shards.where("ends IS NOT NULL").select("p1", "p2", "piece", "ends").repartition("p1", "p2").sortWithinPartitions("p1", "p2", "piece")
    hashed = chunks.mapInArrow(_digest_ends, "p1 long, p2 long, sha string")

    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    root_kids = nodes.where("depth = 1").select("p1", "p2")
    many = parents.where(F.col("n_children") > MANY_CHILDREN).drop("n_children")
    below = nodes.where("depth > 1").select("p1", "p2", "q1", "q2")
    marked = lookup_join(below, many, ["q1", "q2"], "left", salt_by=["p1"])
    few = marked.where("parent_conv_id IS NULL").drop("parent_conv_id").join(parents.where(F.col("n_children") <= MANY_CHILDREN).drop("n_children"), ["q1", "q2"])
    low = ids.agg(F.min("c"), F.count("*"), F.count_if("turnless")).first()
    above = marked.where("parent_conv_id IS NOT NULL").select("p1", "p2", "parent_conv_id").union(few.select("p1", "p2", "parent_conv_id"))
    above = above.union(root_kids.withColumn("parent_conv_id", F.lit(low[0]).cast("long")))

    out = nodes.join(totals, ["p1", "p2"]).join(hashed, ["p1", "p2"], "left").join(above, ["p1", "p2"])
    empty = hashlib.sha256().hexdigest()
    out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(empty)).alias("ends_sha256"))
    if not low[1]:
        return out
    out = written(out, "trie")
    top = out.where("depth = 1").agg(F.count("*"), F.sum("n_leaves"), F.sum("saved_tokens")).first()
    zero = F.lit(0).cast("long")
    ended = ids.where("turnless").select(zero.alias("p1"), zero.alias("p2"), F.col("c").alias("piece"), F.col("c").cast("string").alias("ends"))
    packed = _ranged(ended, low[2], "piece").mapInArrow(_packed, "p1 long, p2 long, piece long, ends string")
    sha = packed.repartition(1).sortWithinPartitions("piece").mapInArrow(_digest_ends, "p1 long, p2 long, sha string").first()
    root = (low[0], 0, None, low[1], top[0], max(top[1] or 0, 1), top[2] or 0, sha.sha if sha else empty)
    return out.union(spark.createDataFrame([root], out.schema))


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of ids to one row per batch."""
    for batch in batches:
        if batch.num_rows:
            ends = ",".join(batch.column("ends").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.slice(0, 1).select(["p1", "p2", "piece"]).columns, pa.array([ends])], ["p1", "p2", "piece", "ends"])
