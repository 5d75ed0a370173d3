"""Connected components: each task joins its own links, then alternating large-star and small-star rounds join the tasks'."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, ship

#: Links that a task joins by itself, about.
LINKS = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star forest of the links a-b: (node, smallest node of its component)."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: a.size], at[a.size :]
    label = np.arange(names.size)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(names.size)
    return names[other], names[label[other]]


def _state(edges: DataFrame):
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _joined(batches):
    """The spanning star forest of a task's links, slimmed whenever it has doubled."""
    own, held, limit = [], 0, LINKS
    for x in batches:
        own.append((x.column("a").to_numpy(), x.column("b").to_numpy()))
        held += x.num_rows
        if held > limit:
            own = [forest(*map(np.concatenate, zip(*own, strict=True)))]
            held = own[0][0].size
            limit = max(LINKS, 2 * held)
    if own:
        a, b = forest(*map(np.concatenate, zip(*own, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def stars(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b): every linked node a that is not its component's smallest, with that smallest b.

    edges: (a, b) longs.  The links are read by as many tasks as their number asks for (LINKS to each), and each
    task hands on one link a node at most; a single task's are the components already.  Otherwise each round
    lowers labels along stars; the minimum of a node's neighbours is combined before the shuffle, so a hub of many
    links is met as one row per task.  Lineage is cut every round.  Raises if most_rounds do not settle.
    """
    ship(edges.sparkSession)
    links = cut(edges.filter("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), small=True)
    tasks = max(1, -(-links.count() // LINKS))
    now = cut(links.coalesce(tasks).mapInArrow(lean(_joined), "a long, b long"))
    if tasks == 1:
        return now
    now = cut(now.distinct())
    state = _state(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, _state(now)
        if state == before:
            return now
    raise RuntimeError("components did not settle")
