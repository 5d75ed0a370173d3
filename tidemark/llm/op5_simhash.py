"""SimHash near-duplicates through vantage-point trees.

Every text gets a 64-bit fingerprint of its 3-word shingles.  Equal fingerprints are one node.  A
vantage-point tree fitted on a bounded sample of fingerprints deals the nodes into shards: a node
lives in one leaf and, where the triangle inequality lets a partner within the radius lie beyond a
boundary, also visits the leaves on the far side.  Each shard grows its own tree in the same way
down to small blocks, whose pairs are compared exactly.  Only a spanning forest of each block's links
leaves it, so a group of k close nodes gives at most k edges.

Defined results: null and wordless texts have fingerprint zero, linked like any other; a null doc_id
is kept and never names a component unless no other member has an id; repeated rows are repeated;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, lean, ship, table
from .components import forest, stars

RADIUS, SHINGLE, SEED = 2, 3, 42
#: Fingerprints that fit a leaf of the shared tree; about so many nodes are meant for a shard; leaves of the shared
#: tree at most (its sample is a MB a 2**14 leaves); nodes of a block; nodes dealt out at a time.
SAMPLE, SHARD, LEAVES, BLOCK, DEALT = 8, 8192, 1 << 17, 128, 1 << 18


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 hashes of a text's shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    n = len(words)
    if n <= SHINGLE:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = [xxh64_intdigest(a + b" " + b + b" " + c, SEED) for a, b, c in zip(words, words[1:], words[2:], strict=False)]
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):
        block = np.array(hashes[lo : lo + 65536], "<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((2 * ones > len(hashes)).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def _fingerprints(batches):
    for b in batches:
        prints = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
        keep = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(prints.view(np.int64))], [*keep, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, k, fp long); k is a hash of the text that tells rows of one doc_id apart."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("k"), "text")
    return rows.mapInArrow(lean(_fingerprints), f"doc_id {kind}, k long, fp long")


def grow(sample: np.ndarray, leaves: int) -> tuple | int:
    """A tree of (vantage point, radius, inner, outer) over the sample; leaves are numbered."""
    rng, numbers = np.random.default_rng(5), iter(range(1 << 30))

    def node(own, want):
        if want <= 1 or own.size < 4:
            return next(numbers)
        v = own[rng.integers(own.size)]
        d = np.bitwise_count(own ^ v)
        t = int(np.median(d))
        inner = d <= t
        if inner.all() or not inner.any():
            return next(numbers)
        return (v, t, node(own[inner], want // 2), node(own[~inner], want - want // 2))

    return node(sample, leaves)


def _gathered(batches):
    """Fingerprints of several batches at a time: a large tree is walked once for all of them."""
    own, n = [], 0
    for b in batches:
        own.append(b.column("fp").to_numpy().view(np.uint64))
        n += own[-1].size
        if n >= DEALT:
            yield np.concatenate(own)
            own, n = [], 0
    if n:
        yield np.concatenate(own)


def _deal(tree, radius):
    def run(batches):
        for fps in _gathered(batches):
            out = []

            def down(node, at, home, fps=fps, out=out):
                if not at.size:
                    return
                if not isinstance(node, tuple):
                    out.append((np.full(at.size, node, np.int32), fps[at], home))
                    return
                v, t, inner, outer = node
                d = np.bitwise_count(fps[at] ^ v).astype(np.int64)
                down(inner, at[(home & (d <= t)) | (~home & (d - radius <= t))], home[(home & (d <= t)) | (~home & (d - radius <= t))])
                stay = (home & (d > t)) | (~home & (d + radius > t))
                cross = home & (d <= t) & (d + radius > t)  # an inner node looks for partners outside
                down(outer, np.concatenate([at[stay], at[cross]]), np.concatenate([home[stay], np.zeros(int(cross.sum()), bool)]))

            down(tree.value, np.arange(fps.size), np.ones(fps.size, bool))
            cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int32), np.empty(0, np.uint64), np.empty(0, bool)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1].view(np.int64)), pa.array(cols[2])], ["shard", "fp", "home"])

    return run


def pairs(home: np.ndarray, guests: np.ndarray, radius: int, rng=None):
    """Yields linked (a, b) arrays: home nodes with one another and with guests."""
    rng = rng or np.random.default_rng(7)
    work = [(home, guests)]
    while work:
        h, g = work.pop()
        if not h.size or h.size + g.size < 2:
            continue
        if h.size > BLOCK:
            for _ in range(4):
                v = h[rng.integers(h.size)]
                d = np.bitwise_count(h ^ v).astype(np.int64)
                t = int(np.median(d))
                if (d > t).any():
                    break
                t -= 1
                if (d <= t).any():
                    break
            inner = d <= t
            if inner.any() and not inner.all():
                e = np.bitwise_count(g ^ v).astype(np.int64)
                work.append((h[inner], g[e - radius <= t]))
                work.append((h[~inner], np.concatenate([g[e + radius > t], h[inner & (d + radius > t)]])))
                continue
        everyone = np.concatenate([h, g])
        for lo in range(0, everyone.size, 4096):
            other = everyone[lo : lo + 4096]
            for k in range(0, h.size, 1024):
                i, j = np.nonzero(np.bitwise_count(h[k : k + 1024, None] ^ other[None, :]) <= radius)
                ok = (j + lo) > (i + k)
                if ok.any():
                    yield h[k : k + 1024][i[ok]], other[j[ok]]


def closest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links a-b between fingerprints, of those of the fewest differing bits."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: a.size], at[a.size :]
    order = np.lexsort((y, x, np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))))
    x, y = x[order], y[order]
    label, kept = np.arange(names.size), [np.empty(0, np.int64)]
    while (live := np.flatnonzero(label[x] != label[y])).size:
        best = np.full(names.size, x.size)  # the closest link that leaves each tree
        np.minimum.at(best, label[x[live]], live)
        np.minimum.at(best, label[y[live]], live)
        kept.append(np.unique(best[best < x.size]))
        node, low = forest(label[x[kept[-1]]], label[y[kept[-1]]])
        to = np.arange(names.size)
        to[node] = low
        label = to[label]
    own = np.unique(np.concatenate(kept))
    return names[x[own]], names[y[own]]


def _link(radius, slim=forest):
    def run(key, rows):
        fps, home = rows.column("fp").to_numpy().view(np.uint64), rows.column("home").to_numpy(zero_copy_only=False)
        out_a, out_b, kept = [], [], 0
        for a, b in pairs(np.unique(fps[home]), np.unique(fps[~home]), radius):
            out_a.append(a.view(np.int64))
            out_b.append(b.view(np.int64))
            kept += a.size
            if kept > 2_000_000:
                a, b = slim(np.concatenate(out_a), np.concatenate(out_b))
                out_a, out_b, kept = [a], [b], a.size
        a, b = slim(np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.empty(0, np.int64),) * 2
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def links(nodes: DataFrame, radius: int = RADIUS, slim=forest) -> DataFrame:
    """(a, b): links that join distinct fingerprints into their components.  nodes: (fp), distinct.
    slim: what a shard hands on of its links: `forest` names each component's smallest, `closest` keeps real links."""
    ship(nodes.sparkSession)
    n = nodes.count()
    leaves = min(LEAVES, -(-n // SHARD))
    # hashes below a bound: a sample by proportion, without a sort of all nodes
    share = nodes.filter(F.abs(F.xxhash64("fp") % F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLE * leaves / max(n, 1))))
    sample = np.sort(np.array(share.toPandas().fp if leaves > 1 else [], np.int64)).view(np.uint64)
    tree = nodes.sparkSession.sparkContext.broadcast(grow(sample, leaves))
    dealt = nodes.mapInArrow(lean(_deal(tree, radius)), "shard int, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(lean(_link(radius, slim)), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, k, fp, root, component_id): root names the component, component_id is the smallest
    doc_id reachable over links of `radius` bits."""
    rows = cut(fingerprints(docs))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), small=True)
    joined = stars(links(nodes.select("fp"), radius))
    named = nodes.join(joined.select(F.col("a").alias("fp"), "b"), "fp", "left").select("fp", "low", F.coalesce("b", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(named.join(lowest, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "k", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents, all columns, of which one of each component stays: that of the smallest doc_id
    (a null one only where no member has an id), of equal rows one.  found: (doc_id, k, root) of docs."""
    low = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"), "k")).alias("low"))
    low = low.select(F.col("low.n").alias("_n"), F.col("low.d").alias("_d"), F.col("low.k").alias("_k"))
    keyed = docs.withColumns({"_n": F.col("doc_id").isNull(), "_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "_k": F.xxhash64("text")})
    stay = keyed.join(low, ["_n", "_d", "_k"], "left_semi")
    first = F.row_number().over(Window.partitionBy("_n", "_d", "_k").orderBy("_d"))
    return stay.withColumn("_first", first).filter("_first = 1").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: fingerprint and component of every document."""
    done = near_duplicates(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
