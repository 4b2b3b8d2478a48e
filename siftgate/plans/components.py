"""Connected components of a table of links, and spanning forests inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgate.plans.joins import large_join
from siftgate.plans.scratch import forget, written


def spanning_forest(near, n: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect whatever `near` connects among positions 0..n-1.

    near(lo, hi) gives the links of positions lo..hi-1 with all positions as a boolean
    matrix. Only links between parts not yet connected are listed, so there are fewer than n.
    """
    root = np.arange(n)
    left, right = [], []
    for lo in range(0, n, block):
        hit = near(lo, min(n, lo + block))
        while True:
            apart = hit & (root[lo : lo + len(hit)][:, None] != root[None, :])
            rows = np.flatnonzero(apart.any(axis=1))
            if not len(rows):
                break
            for i, j in zip(rows + lo, apart[rows].argmax(axis=1)):
                a, b = sorted((root[i], root[j]))
                if a != b:
                    root[root == b] = a
                    left.append(i)
                    right.append(j)
    return np.array(left, np.int64), np.array(right, np.int64)


def few_links(keys: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) among the positions of equal keys, which lie side by side; near(i, j) tells for arrays of pairs.

    All groups at once, and all links of each: for groups of a few members.
    """
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    i = np.arange(len(keys))
    step = 1
    while len(i := i[i + step < len(keys)]) and len(i := i[keys[i] == keys[i + step]]):
        hit = near(i, i + step)
        left.append(i[hit])
        right.append(i[hit] + step)
        step += 1
    return np.concatenate(left), np.concatenate(right)


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to (node, root) for all linked nodes: root is the smallest node that a node reaches.

    Each round every node points its larger neighbours, then all its neighbours, at the
    smallest node around it. Both steps are partial minima per node, so a node with very many
    links is no large task; rounds are written, so a lost executor costs no earlier round.
    """

    def around(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.min("b").alias("least"))

    def sorted_pairs(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now, seen = written(sorted_pairs(links), "links"), None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        seen = mark
        both = now.union(now.select("b", "a"))
        larger = large_join(both, around(both), "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()
        pulled = large_join(larger, around(larger), "a")
        every = pulled.select("a", F.col("least").alias("b")).union(pulled.select("b", "least"))
        old, now = now, written(sorted_pairs(every), "links")
        forget(old)
