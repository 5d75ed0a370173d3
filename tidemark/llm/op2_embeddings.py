"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated at random and split into blocks of few dimensions.  A cosine of at least t
means a squared distance of at most 2 - 2t, so in some block the squared distance is at most that
block's proportional share.  Each block is range-joined under its share: a grid over two of its
coordinates deals the vectors into cells, and a vector also visits the later cells that its radius
reaches.  Candidates within the block's share are verified exactly, in the first block that has them.

Equal vectors of a label are one node with a multiplicity.  A cell with very many vectors is split
into tiles that are compared two by two, so a hot cell is spread over tasks.  Tasks give link counts
by node and a spanning forest of their links, never the pairs.

Defined results: null labels, null or zero vectors and vectors with null or non-finite components link
with nothing; neither do vectors of different lengths; null vec_ids are kept and never name a component
unless no other member has an id; repeated rows count as vectors of their own; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ship, table
from .components import forest, stars

COSINE, BLOCK = 0.93, 8
#: A tile's vectors; more where needed so that at most HOT cells are split (their list is broadcast).
TILE, HOT = 4096, 100_000
_GRID, _SLACK = float(1 << 20), 1e-5


def _prepare(batches):
    for b in batches:
        keys, vecs, labels = [], [], []
        for v, label in zip(b.column("embedding"), b.column("label").to_pylist(), strict=True):
            x = None
            if label is not None and v.is_valid and not v.values.null_count and len(v.values):
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                if not np.isfinite(x).all() or not x.any():
                    x = None
            raw = None if x is None else (x + 0.0).tobytes()
            keys.append(None if x is None else hashlib.blake2b(raw + str(label).encode(), digest_size=16).digest())
            vecs.append(raw)
            labels.append(label)
        yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), pa.array(labels, pa.int64()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["vec_id", "label", "key", "vec"])


def _rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _rotated(x: np.ndarray) -> np.ndarray:
    """Whole-number coordinates of the rotated unit vectors: sums over a block are exact."""
    largest = np.abs(x).max(1, keepdims=True)
    unit = x / largest
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    return np.rint(unit @ _rotation(x.shape[1]) * _GRID)


def _spans(d: int) -> list[tuple[int, int]]:
    return [(lo, min(lo + BLOCK, d)) for lo in range(0, d, BLOCK)]


def _share(d: int, lo: int, hi: int, cosine: float) -> float:
    return (2 - 2 * cosine) * (hi - lo) / d + _SLACK


def _deal(cosine):
    def run(batches):
        for b in batches:
            ids, labels, many = (b.column(c).to_numpy() for c in ("node", "label", "m"))
            vecs = b.column("vec").to_pylist()
            dims = np.array([len(v) // 8 for v in vecs], np.int64)
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                c = _rotated(np.frombuffer(b"".join(vecs[i] for i in own), np.float64).reshape(-1, d))
                for k, (lo, hi) in enumerate(_spans(d)):
                    radius = np.sqrt(_share(d, lo, hi, cosine)) * _GRID
                    width = 2 * radius
                    axes = [c[:, lo], c[:, min(lo + 1, hi - 1)]]
                    cell = [np.floor(a / width).astype(np.int64) for a in axes]
                    near = [(a - g * width, (g + 1) * width - a) for a, g in zip(axes, cell, strict=True)]
                    # home, then the later cells within reach: right, the two right corners, up
                    moves = [(0, 0), (1, -1), (1, 0), (1, 1), (0, 1)]
                    for dx, dy in moves:
                        ok = np.ones(own.size, bool)
                        for s, (below, above) in zip((dx, dy), near, strict=True):
                            if s:
                                ok &= (above if s > 0 else below) <= radius
                        at = own[ok]
                        if not at.size:
                            continue
                        names = [f"{la}:{d}:{k}:{x}:{y}" for la, x, y in zip(labels[at].tolist(), (cell[0][ok] + dx).tolist(), (cell[1][ok] + dy).tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.full(at.size, k, np.int32)), pa.array(np.full(at.size, (dx, dy) == (0, 0))), pa.array(ids[at]), pa.array(many[at]), pa.array([vecs[i] for i in at], pa.binary())], ["cell", "block", "home", "node", "m", "vec"])

    return run


def _compare(x, y, cx, cy, spans, k, cosine, upper):
    """Index pairs of x and y linked, found first in block k."""
    d = x.shape[1]
    lo, hi = spans[k]
    a, b = cx[:, lo:hi], cy[:, lo:hi]
    gap = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    i, j = np.nonzero(gap <= _share(d, lo, hi, cosine) * _GRID**2)
    if upper is not None:
        ok = j + upper > i
        i, j = i[ok], j[ok]
    for own in spans[:k]:
        if not i.size:
            break
        s, e = own
        diff = cx[i, s:e] - cy[j, s:e]
        ok = (diff * diff).sum(1) > _share(d, s, e, cosine) * _GRID**2
        i, j = i[ok], j[ok]
    if i.size:
        ok = np.einsum("ij,ij->i", x[i], y[j]) / (np.sqrt(np.einsum("ij,ij->i", x[i], x[i])) * np.sqrt(np.einsum("ij,ij->i", y[j], y[j]))) >= cosine
        i, j = i[ok], j[ok]
    return i, j


def _link(cosine, step=1024):
    def run(key, rows):
        ti, tj = key[1].as_py(), key[2].as_py()
        block = rows.column("block")[0].as_py()
        home = rows.column("home").to_numpy(zero_copy_only=False)
        tile, nodes, m = (rows.column(c).to_numpy() for c in ("tile", "node", "m"))
        x = np.frombuffer(b"".join(rows.column("vec").to_pylist()), np.float64).reshape(len(nodes), -1)
        order = np.lexsort((nodes, ~home))
        home, tile, nodes, m, x = home[order], tile[order], nodes[order], m[order], x[order]
        x = x / np.abs(x).max(1, keepdims=True)
        c, spans = _rotated(x), _spans(x.shape[1])
        left = np.flatnonzero(home & (tile == ti))
        right = np.flatnonzero(home & (tile == tj)) if ti != tj else np.concatenate([left, np.flatnonzero(~home)])
        links, pa_, pb_, kept = np.zeros(len(nodes), np.int64), [], [], 0
        for s in range(0, left.size, step):
            ls = left[s : s + step]
            for t in range(0 if ti != tj else s, right.size, step):
                rs = right[t : t + step]
                i, j = _compare(x[ls], x[rs], c[ls], c[rs], spans, block, cosine, t - s if ti == tj else None)
                i, j = ls[i], rs[j]
                np.add.at(links, i, m[j])
                np.add.at(links, j, m[i])
                pa_.append(nodes[i])
                pb_.append(nodes[j])
                kept += i.size
                if kept > 1_000_000:
                    a, b = forest(np.concatenate(pa_), np.concatenate(pb_))
                    pa_, pb_, kept = [a], [b], a.size
        some = np.flatnonzero(links)
        a, b = forest(np.concatenate(pa_), np.concatenate(pb_)) if kept else (np.empty(0, np.int64),) * 2
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.table({"a": pa.concat_arrays([pa.array(nodes[some]), pa.array(a, pa.int64())]), "b": pa.concat_arrays([none(some.size), pa.array(b, pa.int64())]), "n": pa.concat_arrays([pa.array(links[some]), none(a.size)])})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id) of rows of (vec_id, embedding, label)."""
    ship(vectors.sparkSession)
    rows = cut(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("long")).mapInArrow(_prepare, "vec_id long, label long, key binary, vec binary"))
    nodes = cut(rows.filter("key is not null").groupBy("key").agg(F.min("vec").alias("vec"), F.min("label").alias("label"), F.count("*").alias("m"), F.min("vec_id").alias("low")))
    nodes = nodes.withColumn("node", F.monotonically_increasing_id())  # over written partitions: stable
    dealt = nodes.select("node", "label", "m", "vec").mapInArrow(_deal(cosine), "cell string, block int, home boolean, node long, m long, vec binary")
    sizes = dealt.select("cell", "home").groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("own"))
    sizes = cut(sizes.filter(F.col("own") > TILE))
    total = sizes.agg(F.sum("own")).first()[0] or 0
    tile = max(TILE, -(-total // HOT))
    # at most HOT cells hold over total / HOT vectors
    hot = sizes.filter(F.col("own") > tile).select("cell", F.ceil(F.col("own") / tile).cast("int").alias("tiles"))
    tiles = F.coalesce("tiles", F.lit(1))
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    every = F.sequence(F.lit(0), tiles - 1)
    # a home vector meets its own tile and every other tile; a guest meets every tile
    met = F.transform(every, lambda t: F.when(F.col("home"), F.struct(F.least(t, own).alias("i"), F.greatest(t, own).alias("j"))).otherwise(F.struct(t.alias("i"), t.alias("j"))))
    spread = dealt.join(F.broadcast(hot), "cell", "left").withColumns({"tile": own, "met": F.explode(met)})
    spread = spread.select("cell", F.col("met.i").alias("i"), F.col("met.j").alias("j"), "block", "home", "tile", "node", "m", "vec")
    found = cut(spread.groupBy("cell", "i", "j").applyInArrow(_link(cosine), "a long, b long, n long"))
    links = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    joined = stars(found.filter("b is not null").select("a", "b"))
    named = nodes.select("node", "key", "m", "low").join(joined.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    named = named.join(links.withColumnRenamed("a", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "root").select("key", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.filter("key is not null").select("vec_id", "key").join(named, "key").select("vec_id", "n_links", "component_id")
    return linked.unionByName(rows.filter("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: links and component of every vector."""
    done = near_duplicates(table(spark, sf_dir, "embeddings"))
    return done.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
