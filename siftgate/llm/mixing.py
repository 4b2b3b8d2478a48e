"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents are laid end to end in id order and packed into blocks of
BLOCK_WORDS words or one less: as many blocks as that takes, at least LEAST_BLOCKS or as
many as the source has words, so small sources have shorter ones and meet their targets. A source's target, in words, is its weight's share of the total, at most
CAP times its size; the excess goes to the others by weight until none is above.
Targets become slots of one block, one at least. The slots of all sources are dealt over the output
shards by a pseudorandom permutation of all slots: the source counts of a shard are thus a
multinomial draw given the totals, so small sources meet their targets too, which
independent draws per shard would miss by a fifth where a source has only some 30 slots.
A source's k-th slot takes block perm(k mod blocks) of pass k div blocks, with a
permutation of its own for each source and pass. So no block is taken more than CAP times,
and blocks and slots meet in a join on (source, block index).

Permutations are swap-or-not networks on integers: stateless, the same for each run, for
any size, and the same in SQL.

Null texts have size 0, as have texts without words; they take no part (taken 0). A null
source is a source of its own, the last. Ids may be null (laid last) or repeat: each row
is a document. No documents, or no words: no slots. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftgate.plans.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
LEAST_BLOCKS = 64
WEIGHTS = (5, 2, 1)
CAP = 3
CHUNK = 1 << 15
MAX_TASKS = 100_000
ROUNDS = 8
P = 2_147_483_647


def round_keys(rounds: int = ROUNDS, seed: int = 42) -> list[tuple[int, ...]]:
    """Six numbers below P for each round, from a linear congruence."""
    x, keys = seed, []
    for _ in range(rounds):
        row = []
        for _ in range(6):
            x = (x * 48271 + 11) % P
            row.append(x)
        keys.append(tuple(row))
    return keys


def permuted(df: DataFrame, out: str, x: str, n: str, seed: Column) -> DataFrame:
    """Adds `out`: the place of x (0 <= x < n) in the permutation of 0..n-1 named by seed.

    Each round pairs x with key - x (mod n) and swaps the pair when a hash of its larger member is odd.
    """
    keys = F.array(*[F.array(*[F.lit(k).cast("long") for k in row]) for row in round_keys()])
    size, start = F.col(n), F.col(x).cast("long")
    own = seed.cast("long") % P

    def swap(v: Column, k: Column) -> Column:
        key = ((own * k[0] + k[1]) % P * P + (own * k[1] + k[0]) % P) % size
        other = F.pmod(key - v, size)
        mixed = (F.greatest(v, other) % P * k[2] + own * k[3] + k[4]) % P
        return F.when((mixed * mixed + k[5]) % P % 2 == 1, other).otherwise(v)

    return df.withColumn(out, F.aggregate(keys, start, swap))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: rank, source_size, target, blocks, short, longer, slots, first_slot, all_slots.

    The first `longer` blocks of a source have short + 1 words, the others `short`.

    With sources in order of what they can take per unit of weight, a source is full when
    its limit is below the level that what is left would give it; the level of the first one
    that is not full is the level of all that are not.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    limited = ranked.withColumns({"weight": weight.cast("long"), "limit": F.col("source_size") * cap})
    order = W.orderBy(F.col("limit") / F.col("weight"), "rank")
    filled = limited.withColumn(
        "level",
        (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
    )
    open_level = F.max(F.when(F.col("limit") > F.col("level") * F.col("weight"), F.col("level"))).over(W.partitionBy())
    target = F.least(F.col("limit").cast("double"), F.coalesce(open_level * F.col("weight"), F.lit(0.0)))
    size = F.col("source_size")
    blocks = F.greatest(F.ceil(size / block_words), F.least(size, F.lit(LEAST_BLOCKS))).cast("long")
    some = F.greatest(F.floor(F.col("target") * F.col("blocks") / size + 0.5), F.lit(1)).cast("long")
    slotted = filled.withColumn("target", target).withColumn("blocks", blocks).withColumns(
        {
            "short": F.expr("CASE WHEN blocks > 0 THEN source_size div blocks END"),
            "longer": F.expr("CASE WHEN blocks > 0 THEN source_size % blocks END"),
            "slots": F.when((F.col("target") > 0) & (size > 0), some).otherwise(0),
        }
    )
    before = W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    return slotted.select(
        "source",
        "rank",
        "source_size",
        "target",
        "blocks",
        "short",
        "longer",
        "slots",
        F.coalesce(F.sum("slots").over(before), F.lit(0)).alias("first_slot"),
        F.sum("slots").over(W.partitionBy()).alias("all_slots"),
    )


def laid_out(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """sized with its source's columns and `start`, the words of the source before the row.

    Rows are range-partitioned by (source, id), so a large source is cut into pieces; sums
    run within pieces and over the pieces' totals. Rows equal in all that counts are
    interchangeable.
    """
    order = [F.col("source").asc_nulls_last(), F.col("id").asc_nulls_last(), F.col("size").asc()]
    pieces = written(sized.repartitionByRange(*order).withColumn("piece", F.spark_partition_id()), "pieces")
    totals = pieces.groupBy("source", "piece").agg(F.sum("size").alias("total"))
    before = W.partitionBy("source").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(F.col("source").alias("s"), F.col("piece").alias("p"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("source", "piece").orderBy(F.col("id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, 0)
    running = pieces.withColumn("upto", F.sum("size").over(within))
    placed = running.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("piece") == F.col("p")))
    placed = placed.withColumn("start", F.col("base") + F.col("upto") - F.col("size")).drop("s", "p", "piece", "base", "upto")
    known = targets.withColumnRenamed("source", "s")
    return placed.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def slot_draws(targets: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix: one row (rank, block, pass, shard, slot) per slot."""
    chunks = targets.where("slots > 0").withColumn("chunk", F.explode(F.expr(f"sequence(0L, (slots - 1) div {CHUNK})")))
    drawn = targets.agg(F.max("all_slots")).head()[0] or 0  # one number: how many tasks draw
    spread = chunks.repartition(max(1, min(-(-drawn // CHUNK), MAX_TASKS)), "rank", "chunk")
    each = spread.withColumn("k", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(slots, (chunk + 1) * {CHUNK}) - 1)")))
    each = each.withColumns({"pass": F.expr("k div blocks"), "r": F.expr("k % blocks"), "u": F.expr("first_slot + k")})
    taken = permuted(each, "block", "r", "blocks", F.col("rank") * 64 + F.col("pass") + 1)
    dealt = permuted(taken, "at", "u", "all_slots", F.lit(0).cast("long"))
    return dealt.select("rank", "block", "pass", F.expr(f"at div {shard_slots}").alias("shard"), F.expr(f"at % {shard_slots}").alias("slot"))


def _block_of(word: str) -> str:
    """SQL for the block that a source's word is in."""
    return f"IF({word} < longer * (short + 1), ({word}) div (short + 1), longer + ({word} - longer * (short + 1)) div short)"


def block_parts(placed: DataFrame) -> DataFrame:
    """One row per document with words and block that it reaches into, with the words it has there."""
    some = placed.where("size > 0")
    parts = some.withColumn("block", F.explode(F.expr(f"sequence({_block_of('start')}, {_block_of('start + size - 1')})")))
    parts = parts.withColumns({"begin": F.expr("block * short + least(block, longer)"), "end": F.expr("(block + 1) * short + least(block + 1, longer)")})
    first = F.greatest("start", "begin")
    words = F.least(F.col("start") + F.col("size"), "end") - first
    return parts.withColumns({"from": first - F.col("start"), "words": words})


def mix(sized: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed documents, slots, parts with `times`) of rows (id, source, size, ...)."""
    targets = written(source_targets(sized, block_words=block_words), "targets")
    placed = laid_out(sized, targets)
    slots = slot_draws(targets, shard_slots)
    times = slots.groupBy("rank", "block").agg(F.count("*").alias("times"), F.min("shard").alias("first_shard"))
    # The hint: from the few rows of targets Spark would guess that the slots are few, and broadcast them.
    parts = block_parts(placed).join(times.hint("merge"), ["rank", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    return placed, slots, parts


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    return written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *keep), "sizes")


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: id, size, source_size, target of its source, words taken, the first shard with any."""
    placed, _, parts = mix(sizes(docs, id_col, text_col, source_col))
    own = ["id", "size", "source_size", "target"]
    some = parts.groupBy("rank", "start").agg(*[F.first(c).alias(c) for c in own], F.sum(F.col("times") * F.col("words")).alias("taken"), F.min("first_shard").alias("first_shard"))
    rest = placed.where("size = 0").select(*own, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_shard"))
    return some.select(*own, "taken", "first_shard").unionByName(rest)


def packed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixed output itself: (shard, slot, source, block, text) with a block's words space-joined."""
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    placed, slots, _ = mix(sizes(numbered, id_col, text_col, source_col, ("__row",)), block_words)
    words = numbered.select("__row", F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)).alias("all"))
    parts = block_parts(placed).join(words, "__row")
    piece = F.slice(F.col("all"), (F.col("from") + 1).cast("int"), F.col("words").cast("int"))
    texts = (
        parts.groupBy("rank", "block")
        .agg(F.first("source").alias("source"), F.array_sort(F.collect_list(F.struct("start", piece.alias("piece")))).alias("p"))
        .withColumn("text", F.array_join(F.flatten(F.col("p.piece")), " "))
    )
    return slots.hint("merge").join(texts, ["rank", "block"]).select("shard", "slot", "source", "block", "text")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars") -> DataFrame:
    """docs as the mix takes them, with the columns of docs.

    A document comes once for each time that any of its blocks is taken; a copy whose
    blocks are all taken has the whole text, another has the taken blocks' words, space-joined.
    Documents without words, or with no block taken, go.
    """
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    _, _, parts = mix(sizes(numbered, id_col, text_col, source_col, ("__row",)))
    part = F.struct("from", "times", "words")
    drawn = parts.groupBy("__row").agg(
        F.array_sort(F.collect_list(part)).alias("__parts"),
        F.max("times").alias("__most"),
        F.min("times").alias("__least"),
    )
    copies = drawn.where("__most > 0").withColumn("__copy", F.explode(F.expr("sequence(1L, __most)")))
    joined = numbered.join(copies, "__row")
    # Bound as one value: inside a lambda a column's expression would be evaluated for every word.
    bound = F.struct(
        F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)).alias("words"),
        F.flatten(F.transform("__parts", lambda p: F.array_repeat(p["times"], p["words"].cast("int")))).alias("times"),
        F.col("__copy").alias("copy"),
    )

    def taken(x: Column) -> Column:
        return F.array_join(F.filter(x["words"], lambda w, i: F.get(x["times"], i) >= x["copy"]), " ")

    part_text = F.get(F.transform(F.array(bound), taken), F.lit(0))
    text = F.when(F.col("__copy") <= F.col("__least"), F.col(text_col)).otherwise(part_text)
    out = joined.withColumn(text_col, text)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)
