"""Best-fit packing by patterns: non-negative least squares over the length histogram.

Documents become pieces of at most `capacity` tokens.  Only the histogram of piece lengths (at most
`capacity` rows) comes to the driver.  There, patterns of up to four lengths that fill a sequence
are enumerated, their repeat counts are fitted to the histogram by non-negative least squares and
rounded down, and the residual is packed best-fit decreasing, again as repeated patterns.  Every
piece then finds its place from its rank among the pieces of its length: ranks are counted in
buckets and carried over by per-bucket offsets, so no length has to fit into one task.

Defined results: a null text is empty (its piece is the end id alone); a null doc_id is kept;
repeated rows are packed each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import cut, lean, ship, shuffle_partitions, table, tokenizer_path

CAPACITY, END_ID = 2048, 0
#: Lengths, taken at quantiles of the histogram, that may be a pattern's second and third member.
INNER3, INNER4, NNLS_ROUNDS = 24, 10, 150


def _pieces(path, capacity, end_id, with_ids):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        enc = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows, docs, ids = [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    whole = enc.packed(text) + int(end_id).to_bytes(4, "little")
                    for k, lo in enumerate(range(0, len(whole), 4 * capacity)):
                        own = whole[lo : lo + 4 * capacity]
                        docs.append(i)
                        rows.append((k, lo // 4, len(own) // 4, zlib.crc32(own)))
                        if with_ids:
                            ids.append(own)
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                out = [part.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])]
                yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * with_ids, names)

    return run


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids as little-endian uint32]) of every document."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(lean(_pieces(path or tokenizer_path(), capacity, end_id, with_ids)), schema)


def patterns(count: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to four lengths (0: none), largest first, that fill a sequence exactly."""
    lengths = np.flatnonzero(count)
    lengths = lengths[lengths > 0]
    if not lengths.size:
        return np.empty((0, 4), np.int64)
    cum = np.cumsum(count[lengths])

    def inner(k):
        return np.unique(lengths[np.minimum(np.searchsorted(cum, (np.arange(k) + 0.5) / k * cum[-1]), lengths.size - 1)])

    def fill(head):
        rest = capacity - head.sum(1)
        ok = (rest > 0) & (rest <= capacity)
        head, rest = head[ok], rest[ok]
        ok = count[rest] > 0
        return np.column_stack([head[ok], rest[ok]])

    a, b, c = lengths[:, None], inner(INNER3), inner(INNER4)
    two = fill(a)
    three = fill(np.column_stack([np.repeat(lengths, b.size), np.tile(b, lengths.size)]))
    pairs = np.array([(x, y) for i, x in enumerate(c) for y in c[i:]]).reshape(-1, 2)
    four = fill(np.column_stack([np.repeat(lengths, len(pairs)), np.tile(pairs, (lengths.size, 1))]))
    wide = [np.pad(x, ((0, 0), (0, 4 - x.shape[1]))) for x in (two, three, four)]
    return np.unique(-np.sort(-np.concatenate(wide), axis=1), axis=0)


def fit(rows: np.ndarray, count: np.ndarray, rounds: int = NNLS_ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared error of the covered histogram.

    Multiplicative updates keep x non-negative and never raise the error.
    """
    if not len(rows):
        return np.empty(0)
    target = count.astype(float).copy()
    target[0] = 0

    def up(v):  # what the histogram's bins say to each pattern
        v = v.copy()
        v[0] = 0
        return v[rows].sum(1)

    def down(x):
        return np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), minlength=count.size)

    want = up(target)
    x = np.minimum.reduce([np.where(r > 0, count[r] / np.maximum(1, np.bincount(rows.ravel(), minlength=count.size)[r]), np.inf) for r in rows.T])
    x = np.maximum(x, 1e-9)
    for _ in range(rounds):
        got = down(x)
        got[0] = 0
        x = x * want / np.maximum(up(got), 1e-12)
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (lengths of a sequence, how many sequences)."""
    open_: dict[int, list] = {}
    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n:
            cap = next((c for c in range(size, capacity) if open_.get(c)), None)
            if cap is None:
                each = capacity // size
                full, rest = divmod(n, each)
                for k, contents in ((full, (size,) * each), (1, (size,) * rest)):
                    if k and contents:
                        open_.setdefault(capacity - size * len(contents), []).append((contents, k))
                n = 0
            else:
                contents, k = open_[cap].pop()
                if k > n:
                    open_[cap].append((contents, k - n))
                    k = n
                open_.setdefault(cap - size, []).append((contents + (size,), k))
                n -= k
    return [g for groups in open_.values() for g in groups]


def plan(count: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """All sequences as (lengths, repeats) for a histogram of piece lengths."""
    left, made = count.astype(np.int64).copy(), []
    rows = patterns(count * (np.arange(count.size) < capacity), capacity)
    x = fit(rows, count)
    for i in np.argsort(-x, kind="stable"):
        k = int(x[i])
        if k < 1:
            break
        own, many = np.unique(rows[i][rows[i] > 0], return_counts=True)
        k = int(min(k, (left[own] // many).min()))
        if k:
            left[own] -= k * many
            made.append((tuple(int(v) for v in rows[i] if v), k))
    return made + best_fit(left, capacity)


def _slots(groups, capacity):
    """For each length: first ranks of its slots, and the slots' first sequence and offset."""
    slots: dict[int, list] = {}
    base = 0
    for lengths, repeats in groups:
        at = 0
        for n in lengths:
            slots.setdefault(n, []).append((repeats, base, at))
            at += n
        base += repeats
    out = {}
    for n, own in slots.items():
        own = np.array(own, np.int64)
        out[n] = (np.concatenate([[0], np.cumsum(own[:, 0])[:-1]]), own[:, 1], own[:, 2])
    return out


def _place(slots):
    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.empty(length.size, np.int64), np.empty(length.size, np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                first, base, at = slots[int(n)]
                k = np.searchsorted(first, rank[own], side="right") - 1
                seq[own], off[own] = base[k] + rank[own] - first[k], at[k]
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(seq), pa.array(off)], [*keep, "sequence_id", "offset"])

    return run


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows of pieces() with sequence_id and offset; gapless, no sequence over capacity."""
    spark = made.sparkSession
    ship(spark)
    made = cut(made)
    count = np.zeros(capacity + 1, np.int64)
    for r in made.groupBy("length").count().collect():  # one row a length
        count[r["length"]] = r["count"]
    slots = _slots(plan(count, capacity), capacity)
    buckets = shuffle_partitions(spark)
    made = made.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = made.groupBy("_b", "length").count()
    carried = F.sum("count").over(Window.partitionBy("length").orderBy("_b")) - F.col("count")
    before = before.select("_b", "length", carried.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_b", "length").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = made.withColumn("rank", own.cast("long") - 1).join(before, ["_b", "length"])
    cols = [c for c in made.columns if c != "_b"]
    ranked = ranked.select(*cols, (F.col("rank") + F.col("_before")).alias("rank"))
    schema = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in cols)
    return ranked.mapInArrow(_place(slots), schema + ", sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the place of every piece of every document."""
    return pack(pieces(table(spark, sf_dir, "documents")))
