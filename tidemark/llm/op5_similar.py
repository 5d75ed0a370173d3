"""SimHash near-duplicates held against a Jaccard similarity of 5-word shingle sets, and an exact join for the rest.

A shingle is the upper 48 bits of its XXH64.  Texts of one set of shingles (by a 128-bit hash of the sorted
set) are one node.  Nodes get the SimHash fingerprints of op5_simhash, whose vantage-point trees find those
within REACH bits: a spanning forest of the closest links, and for equal fingerprints a link to one of them.
Such a link stands if the whole sets are SIMILAR.  Close fingerprints neither imply that similarity nor
follow from it, so what SimHash has not joined goes through an exact prefix join:

Shingles have one order, in which those that are common in a bounded sample come last.
Of two sets of similarity SIMILAR or more, each holds one of the other's first n - ceil(SIMILAR n) + 1
shingles in that order among its own, so a node is dealt out by these only, and nodes that meet in none need
no test.  A pair that meets is left out only where it cannot be similar: by the sizes, by what can still be
shared behind the first common shingle, and by the sketches, in which each shingle flips one bit (sets
differ in at least as many shingles as their sketches in bits).  All other pairs are held against the whole
sets, so the links are exact.

Only shingles that nodes of several components hold are dealt out.  To be spared the pairs within a group, the
first round holds each node of a shingle against one that they all have in common.  Later rounds leave out the shingles whose nodes are all in one component, and test each
node's most promising partners in other components, more each round, until no candidate between two
components is left untested.  So a component is what the true links make it, and no partner is capped.
A shingle of very many nodes is split into blocks, and each pair of blocks is handled by itself; a set with
very many partners is copied for every SHARE of them.

Defined results are those of op5_simhash.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, ship
from .components import stars
from .op5_simhash import SEED, closest, fingerprint, links

SHINGLE, SIMILAR, SKETCH = 5, 0.8, 1024
#: Bytes of a shingle's hash that are kept.
WIDTH = 6
#: Bits that fingerprints of a SimHash link differ in at most.  A wider reach links more, and each fingerprint visits more shards.
REACH = 3
#: Texts whose shingles are counted for the order, how many must hold one that is common, common ones at most.
SAMPLE, COMMON, MOST_COMMON = 2048, 3, 65536
#: Partners of a node in the join's second round (its first has one of each shingle), and how many times more in each further one.
NEAREST, MORE = 16, 8
#: Nodes whose texts are found by a broadcast at most; pairs of one text that one copy of its set serves; links held by a task before they are slimmed; pairs handled at a
#: time; nodes of a shingle in a block; places that shingles are dealt to at least; rows meant for a place.
SMALL, SHARE, HELD, STEP, BLOCK, PLACES, PLACE = 32768, 512, 1 << 17, 1 << 16, 4096, 1024, 1 << 15
_LIMIT = Fraction(str(SIMILAR))


def shingle_hashes(text: str | None):
    """Arrays of the hashes of a text's shingles, repeats included, a block at a time."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()
    drop = np.uint64(64 - 8 * WIDTH)
    if 0 < len(words) < SHINGLE:
        yield np.array([xxh64_intdigest(b" ".join(words), SEED)], "<u8") >> drop
    for lo in range(0, len(words) - SHINGLE + 1, 16384):
        own = words[lo : lo + 16384 + SHINGLE - 1]
        yield np.array([xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(own[i:] for i in range(SHINGLE)), strict=False)], "<u8") >> drop


def distinct(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(np.concatenate([*shingle_hashes(text), np.empty(0, "<u8")]))


def least_shared(n):
    """Shingles that a set of n has in common with any similar one, at least."""
    return -(-n * _LIMIT.numerator // _LIMIT.denominator)


def sketch(own: np.ndarray) -> bytes:
    """Bits, each set where an odd number of the hashes falls: SKETCH of them, or a power of 2 from the set's size on."""
    bits = max(SKETCH, 1 << int(own.size).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(raw: bytes, size: int) -> bytes:
    """The sketch of fewer bytes that the same set has."""
    own = np.frombuffer(raw, np.uint8)
    while own.size > size:
        own = own[: own.size // 2] ^ own[own.size // 2 :]
    return own.tobytes()


def prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles that a set is dealt out by, in order.  common: sorted hashes, with their ranks from 1."""
    many = own.size - least_shared(own.size) + 1 if own.size else 0
    if not common.size:
        return own[:many]
    at = np.minimum(np.searchsorted(common, own), common.size - 1)
    level = np.where(common[at] == own, rank[at], 0)
    return own[np.argsort(level, kind="stable")[:many]]


def packed(hashes: np.ndarray) -> bytes:
    """WIDTH bytes a hash."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    own = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    own[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return own.reshape(-1).view("<u8")


def pack_set(own: np.ndarray) -> bytes:
    """A sorted set, byte by byte, so that the upper bytes compress."""
    planes = own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_set(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return unpacked(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(WIDTH, -1).T).tobytes())


def _parts(batches, rows=256):
    """Batches of few rows, so that little is held at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def _sets(batches):
    done = set()  # equal rows of a task are one
    for b in _parts(batches):
        nodes, own = [], []
        for node, text in zip(b.column("node").to_pylist(), b.column("text").to_pylist(), strict=True):
            if node not in done:
                done.add(node)
                nodes.append(node)
                own.append(pack_set(distinct(text)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(own, pa.binary())], ["node", "own"])


def _hashes(batches):
    for b in _parts(batches):
        for text in b.column("text").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(distinct(text).view(np.int64))], ["token"])


def _prints(common):
    def run(batches):
        from xxhash import xxh3_128_digest

        for b in _parts(batches):
            same, size, bits, first, fp = [], [], [], [], []
            for t in b.column("text").to_pylist():
                own = distinct(t)
                same.append(xxh3_128_digest(own.tobytes(), SEED))
                size.append(own.size)
                bits.append(sketch(own))
                first.append(packed(prefix(own, *common.value)))
                fp.append(fingerprint(t))
            keep = [c for c in b.schema.names if c != "text"]
            made = [pa.array(same, pa.binary()), pa.array(size, pa.int32()), pa.array(bits, pa.binary()), pa.array(first, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], [*keep, "same", "size", "sketch", "first", "fp"])

    return run


def _tokens(batches):
    """A row for each shingle that a node is dealt out by, with its place in the prefix and its node's root."""
    for b in _parts(batches):
        node, size = b.column("node").to_numpy(), b.column("size").to_numpy()
        first = b.column("first").to_pylist()
        many = np.array([len(x) // WIDTH for x in first], np.int64)
        pos = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        cols = [unpacked(b"".join(first)).view(np.int64), np.repeat(node, many), np.repeat(size, many).astype(np.int32), pos.astype(np.int32)]
        root = b.column("root").take(pa.array(np.repeat(np.arange(b.num_rows), many)))
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), root], ["token", "node", "size", "pos", "root"])


def common_shingles(keyed: DataFrame):
    """(sorted hashes, ranks) of the shingles that are common in a sample of the texts, the rarest first.

    They only order the shingles: any list gives the same links.
    """
    every = max(1, keyed.count() // SAMPLE)
    some = keyed.filter(F.pmod("k", F.lit(every)) == 0).select("text").limit(2 * SAMPLE)
    seen = some.mapInArrow(lean(_hashes), "token long").groupBy("token").count().filter(F.col("count") >= COMMON)
    top = [r.token for r in seen.orderBy(F.desc("count"), "token").limit(MOST_COMMON).collect()]
    own = np.array(top, np.int64).view(np.uint64)
    order = np.argsort(own)
    return own[order], (own.size - np.arange(own.size))[order]


def nearest(i: np.ndarray, j: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
    """Places of the links that are among the `most` of least weight of either end."""
    m = i.size
    end, link = np.concatenate([i, j]), np.tile(np.arange(m), 2)
    order = np.lexsort((link, d[link], end))
    first = np.r_[True, end[order][1:] != end[order][:-1]]
    rank = np.arange(2 * m) - np.maximum.accumulate(np.where(first, np.arange(2 * m), 0))
    return np.unique(link[order[rank < most]])


def pairs_of(size, pos, part, mine, theirs, step=256):
    """Index pairs of one shingle's rows, each once, between parts, that sizes and places allow: within
    `mine` (theirs none), or of `mine` with `theirs`."""
    p, q = _LIMIT.numerator, _LIMIT.denominator
    _, at, count = np.unique(part[mine], return_inverse=True, return_counts=True)
    own = mine[np.lexsort((at, count[at]))]  # the largest part last: its rows need no test among themselves
    other = own if theirs is None else theirs
    for lo in range(0, own.size, step):
        h = own[lo : lo + step, None]
        if theirs is None and part[own[lo]] == part[own[-1]]:
            return
        for k in range(lo if theirs is None else 0, other.size, 4096):
            o = other[None, k : k + 4096]
            small, large = np.minimum(size[h], size[o]), np.maximum(size[h], size[o])
            shared = 1 + np.minimum(size[h] - pos[h], size[o] - pos[o]) - 1
            ok = (part[h] != part[o]) & (q * small >= p * large) & ((p + q) * shared >= p * (small + large))
            if theirs is None:
                ok &= (np.arange(lo, lo + h.size)[:, None]) < (np.arange(k, k + o.size)[None, :])
            i, j = np.nonzero(ok)
            if i.size:
                yield own[lo + i], other[k + j]


def _apart(sketches):
    """A function of places a, b in a list of sketches: in how many bits theirs differ, folded to the smaller one."""
    length = np.array([len(x) for x in sketches], np.int64)
    levels, at = {}, np.zeros(length.size, np.int64)
    for n in np.unique(length).tolist():
        own = np.flatnonzero(length >= n)
        at[own] = np.arange(own.size)
        levels[n] = (at.copy(), np.frombuffer(b"".join(folded(sketches[k], n) for k in own), "<u8").reshape(own.size, -1))

    def run(a, b):
        least, out = np.minimum(length[a], length[b]), np.zeros(a.size, np.int64)
        for n in np.unique(least).tolist():
            k, (of, bits) = np.flatnonzero(least == n), levels[n]
            for lo in range(0, k.size, max(1, (1 << 23) // n)):
                x = k[lo : lo + max(1, (1 << 23) // n)]
                out[x] = np.bitwise_count(bits[of[a[x]]] ^ bits[of[b[x]]]).sum(1, dtype=np.int64)
        return out

    return run


def _candidates(most):
    """Of each node of a place the nearest candidates in other parts; a row of -1 and the place tells that there are more."""

    def run(key, rows):
        token, node, part = (rows.column(c).to_numpy() for c in ("token", "node", "part"))
        size, pos, side = (rows.column(c).to_numpy().astype(np.int64) for c in ("size", "pos", "side"))
        apart = _apart(rows.column("sketch").to_pylist())
        order = np.lexsort((side, rows.column("block").to_numpy(), token))
        block = rows.column("block").to_numpy()[order]
        edge = np.flatnonzero(np.r_[True, (token[order][1:] != token[order][:-1]) | (block[1:] != block[:-1]), True])
        p, q = _LIMIT.numerator, _LIMIT.denominator
        own, held, limit, more = [(np.empty(0, np.int64),) * 3], 0, HELD, False

        def slim():
            nonlocal more
            a, b, d = (np.concatenate(x) for x in zip(*own, strict=True))
            names = np.stack([a, b], axis=1)
            _, once = np.unique(names, axis=0, return_index=True)
            a, b, d = a[once], b[once], d[once]
            keep = nearest(a, b, d, most)
            more = more or keep.size < a.size
            return [(a[keep], b[keep], d[keep])]

        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            at = order[lo:hi]
            mine, theirs = at[side[at] == 0], at[side[at] == 1]
            for i, j in pairs_of(size, pos, part, mine, theirs if theirs.size else None):
                for k in range(0, i.size, STEP):
                    a, b = i[k : k + STEP], j[k : k + STEP]
                    both, d = size[a] + size[b], apart(a, b)
                    ok = (p + q) * d <= (q - p) * both
                    a, b, d = a[ok], b[ok], d[ok] * 4096 // both[ok]
                    own.append((np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), d))
                    held += a.size
                    if held > limit:
                        own = slim()
                        held = own[0][0].size
                        limit = max(limit, 2 * held)
        columns, place = slim()[0], key[0].as_py()
        return pa.table({n: pa.array(np.r_[x, [y] * more].astype(np.int64)) for n, x, y in zip("abd", columns, (-1, place, 0), strict=True)})

    return run


def _judge(least):
    """Which sets of a bundle are alike to that of its head."""

    def run(key, rows):
        head = key[0].as_py()
        sets = dict(zip(rows.column("node").to_pylist(), rows.column("own").to_pylist(), strict=True))
        mine = unpack_set(sets.pop(head))
        alike = []
        for blob in sets.values():
            own = unpack_set(blob)
            shared = np.intersect1d(mine, own, assume_unique=True).size
            alike.append(shared >= least * (mine.size + own.size - shared))
        cols = [pa.array([head] * len(sets), pa.int64()), pa.array(list(sets), pa.int64()), pa.array(alike, pa.bool_())]
        return pa.table(dict(zip(("a", "b", "alike"), cols, strict=True)))

    return run


def judged(pairs: DataFrame, sets: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(a, b, alike): whether the sets of a pair have that Jaccard similarity; two empty ones have.

    The partners of a text go where a copy of its set is, SHARE of them to each, so that no text is hot.
    """
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(SHARE)).alias("n"))
    heads = shares.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("s"), F.col("a").alias("node"))
    others = pairs.join(shares, "a").select("a", F.pmod(F.xxhash64("b"), F.col("n")).alias("s"), F.col("b").alias("node"))
    filled = others.select("a", "s").distinct()  # a share that nobody is dealt to needs no copy
    rows = others.unionByName(heads.join(filled, ["a", "s"], "left_semi")).join(sets, "node")
    return rows.groupBy("a", "s").applyInArrow(lean(_judge(Fraction(str(least)))), "a long, b long, alike boolean")


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, d) of the pairs of different parts whose sizes and sketches do not rule out that they are similar; d: how
    far the sketches are apart for their size."""
    p, q = _LIMIT.numerator, _LIMIT.denominator
    for n in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("size", "sketch", "part"))), n)

    def keep(batches):
        for x in _parts(batches, 2048):
            m, n = (x.column(f"size_{n}").to_numpy().astype(np.int64) for n in "ab")
            d = _apart(x.column("sketch_a").to_pylist() + x.column("sketch_b").to_pylist())(np.arange(m.size), m.size + np.arange(m.size))
            ok = ((p + q) * d <= (q - p) * (m + n)) & (q * np.minimum(m, n) >= p * np.maximum(m, n))
            far = pa.array(d * 4096 // np.maximum(m + n, 1))
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), far], ["a", "b", "d"]).filter(pa.array(ok))

    return pairs.filter("part_a <> part_b").select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(lean(keep), "a long, b long, d long")


def close_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes, a < b, that SimHash links: of a spanning forest of the closest fingerprints, and one node of
    each fingerprint with its others.  nodes: (node, fp)."""
    prints = cut(nodes.groupBy("fp").agg(F.min("node").alias("head")), small=True)
    near = links(prints.select("fp"), REACH, closest)
    for n in "ab":
        near = near.join(prints.select(F.col("fp").alias(n), F.col("head").alias(f"head_{n}")), n)
    equal = nodes.join(prints, "fp").filter("head < node").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return near.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b")).unionByName(equal).distinct()


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, k, root): root names the component of a row's text; k as in op5_simhash."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("k"), F.xxhash64("doc_id", "text").alias("own"), "text")
    common = spark.sparkContext.broadcast(common_shingles(keyed))
    made = keyed.mapInArrow(lean(_prints(common)), f"doc_id {kind}, k long, own long, same binary, size int, sketch binary, first binary, fp long")
    rows = cut(made)
    nodes = cut(rows.groupBy("same").agg(F.min_by(F.struct("own", "size", "sketch", "first", "fp"), "own").alias("x")).select("same", "x.*"))
    nodes = nodes.withColumn("node", F.monotonically_increasing_id())  # over written partitions: stable
    tests = []

    def sets_of(pairs, of):
        """The sets of the nodes of pairs."""
        want = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        want = cut(of.select("node", "own").join(want, "node"))
        want = F.broadcast(want) if want.count() <= SMALL else want
        texts = keyed.select("own", "text").join(want, "own").select("node", "text")
        return cut(texts.mapInArrow(lean(_sets), "node long, own binary"))

    def settled(chosen, of, joined=None):
        """(node, root) of the components by the links among the chosen pairs and what the rounds before have joined."""
        tests.append(cut(judged(chosen, sets_of(chosen, of))))
        alike = tests[-1].filter("alike").select("a", "b")
        alike = alike if joined is None else alike.unionByName(joined.select(F.col("node").alias("a"), F.col("root").alias("b")))
        return stars(alike).select(F.col("a").alias("node"), F.col("b").alias("root"))

    def untested(pairs):
        return pairs.join(reduce(DataFrame.unionByName, tests).select("a", "b"), ["a", "b"], "left_anti")

    def in_parts(of, joined):
        return of.join(joined, "node", "left").withColumn("part", F.coalesce("root", "node"))

    # SimHash, its links held against the sets
    chosen = cut(possible(close_pairs(nodes.select("node", "fp")), nodes.withColumn("part", F.col("node")))).select("a", "b")
    joined = settled(chosen, nodes)
    # the rest
    dealt = nodes.select("node", "size", "first").join(joined, "node", "left").mapInArrow(lean(_tokens), "token long, node long, size int, pos int, root long")
    #: Nodes of a shingle in order of size: where the next one is too large for one before, no pair goes across.
    by_size = Window.partitionBy("token").orderBy("size")
    gap = F.col("size") * _LIMIT.numerator > F.lag("size").over(by_size) * _LIMIT.denominator
    runs = dealt.withColumn("gap", F.when(gap, 1).otherwise(0)).withColumn("run", F.sum("gap").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    run, part = Window.partitionBy("token", "run"), F.coalesce("root", "node")
    shared = runs.withColumns({"met": F.count("*").over(run), "low": F.min(part).over(run), "high": F.max(part).over(run)}).filter("low < high")
    #: Rows of shingles (and runs of sizes) that nodes of several components are dealt out by.
    places = cut(shared.select(F.xxhash64("token", "run").alias("token"), "node", "size", "pos", "met"))
    busy = cut(nodes.join(places.select("node").distinct(), "node").select("node", "own", "size", "sketch"))
    many = max(PLACES, places.count() // PLACE)

    def candidates(joined, parts, open_places, most):
        kept = places
        if open_places is None:
            #: Shingles all of whose nodes are in one component need no more tests.
            roots = joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct())
            linked = places.select("token", "node", "met").join(roots, "node").groupBy("token", "root").agg(F.count("*").alias("n"), F.first("met").alias("met"))
            kept = places.join(linked.filter("n = met").select("token"), "token", "left_anti")
        kept = kept.withColumn("blocks", F.ceil(F.col("met") / F.lit(BLOCK)))
        one = kept.filter("blocks = 1").select("token", F.lit(0).cast("long").alias("block"), F.lit(0).alias("side"), "node", "size", "pos")
        #: Each pair of blocks (low, high) is a block of its own; the higher one's rows are its side 1.
        many_blocks = kept.filter("blocks > 1").withColumn("own_block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        many_blocks = many_blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        low, high = F.least("own_block", "other"), F.greatest("own_block", "other")
        kept = one.unionByName(many_blocks.select("token", (low * F.col("blocks") + high).alias("block"), F.when(F.col("own_block") > F.col("other"), 1).otherwise(0).alias("side"), "node", "size", "pos"))
        kept = kept.withColumn("place", F.pmod(F.xxhash64("token", "block"), F.lit(many)))
        kept = kept if open_places is None else kept.join(open_places, "place", "left_semi")
        return cut(kept.join(parts.select("node", "part", "sketch"), "node").groupBy("place").applyInArrow(lean(_candidates(most)), "a long, b long, d long").distinct())

    heads = places.groupBy("token").agg(F.min("node").alias("head"))
    met = places.join(heads, "token").select(F.col("head").alias("a"), F.col("node").alias("b")).filter("a < b").distinct()
    chosen = cut(untested(possible(met, in_parts(busy, joined)).select("a", "b")))
    most, pending, open_places = 0, None, None
    rank = F.row_number().over(Window.partitionBy("node").orderBy("d", "a", "b"))
    while True:
        joined = settled(chosen, busy, joined)
        parts = in_parts(busy, joined)
        pool = pending
        if open_places is None or not open_places.isEmpty():
            most = most * MORE if most else NEAREST
            found = candidates(joined, parts, open_places, most)
            open_places = found.filter("a < 0").select(F.col("b").alias("place"))
            found = found.filter("a >= 0")
            pool = found if pool is None else pool.unionByName(found).dropDuplicates(["a", "b"])
        fresh = possible(untested(pool.select("a", "b")), parts)
        ends = fresh.withColumn("node", F.explode(F.array("a", "b"))).withColumn("rank", rank)
        first = cut(ends.groupBy("a", "b").agg(F.first("d").alias("d"), F.min("rank").alias("rank")))
        chosen, pending = first.filter(F.col("rank") <= most).select("a", "b"), first.filter(F.col("rank") > most).select("a", "b", "d")
        if chosen.isEmpty() and open_places.isEmpty():
            break
    named = nodes.join(joined, "node", "left").select("same", F.coalesce("root", "node").alias("root"))
    return rows.select("doc_id", "k", "same").join(named, "same").select("doc_id", "k", "root")
