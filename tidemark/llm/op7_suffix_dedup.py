"""Removal of long repeats through run-length indexes.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id.  The
50-byte windows of a text are routed by content: each belongs to the anchor with the smallest hash
among the short grams inside it, so equal windows have equal anchors and a run of neighbouring windows
with one anchor forms a span.  Documents live in slices.

1. Every slice tells the anchor's bucket the hashes of its anchors and spans, with the smallest document
   that has them (equal spans are combined before anything moves).
2. A bucket answers: a span seen in a smaller document elsewhere is a repeat whole; anchors with several
   different spans need their bytes.
3. These spans' bytes go to the buckets.  There they are indexed (rindex.RunIndex), with a tag after the
   anchor that keeps matches to spans of the same anchor, and streamed through the index: where the
   matching statistics cover a window, the index row tells the smallest document that has the match, and
   a smaller one than the span's own makes the window a repeat.
4. The slices cut the repeats out of their texts.

The texts are shuffled once; what else moves is a dozen bytes for about every fifteenth byte of text.

Defined results: a null text is empty; null doc_ids count as larger than all others and as equal to one
another; rows of one doc_id do not count against each other; repeated rows stay; extra columns are kept
only if named; an empty table gives no rows; texts of any length are processed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, ship, shuffle_partitions, table
from .rindex import RunIndex

WINDOW, GRAM = 50, 20
#: Bytes handled at a time while hashing; bytes of spans indexed at a time; streams side by side.
STEP, INDEXED, STREAMS = 1 << 16, 1 << 19, 2048
#: Entries judged at a time; bytes of text meant for a slice at most; bytes hashed at once from which a text is cut, and its stretches.
ANSWERED, SLICE = 1 << 17, 1 << 24
LONG, STRETCH = 1 << 24, 1 << 23
_BASE = 0x9E3779B97F4A7C15
_BIG = np.iinfo(np.int64).max
_TAG, _TAGS = 257, 3  # three digits to the base 256, written as symbols from 257 on


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, tuple] = {}
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def _powers(n: int):
    size = 1 << max(12, int(n).bit_length())
    if size not in _POWERS:
        if len(_POWERS) > 4:
            _POWERS.clear()
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size + 1, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[size] = tuple(both)
    return _POWERS[size]


def _spans(raw: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """Spans of a buffer of documents that end at `ends`: anchor hash, span hash, document, first window
    start, last window start, anchor position (all in the buffer)."""
    n, reach = raw.size, window - gram + 1
    if n < window:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 4
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[raw] * up[:n], out=sums[1:])
    grams = _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    low = np.uint64((1 << 24) - 1)
    m = (grams & ~low) | np.arange(grams.size, dtype=np.uint64)
    width = 1
    while width * 2 <= reach:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if reach > width:
        m = np.minimum(m[: m.size - (reach - width)], m[reach - width :])
    at = (m & low).astype(np.int64)
    new = np.flatnonzero(at[1:] != at[:-1]) + 1
    # windows that begin too late in their document end its last span; the next document begins anew
    lasts = ends - window
    begins = np.concatenate([[0], ends[:-1]])
    real = lasts >= begins
    cuts = np.unique(np.concatenate([new, begins[real], lasts[real] + 1]))
    cuts = cuts[cuts < at.size]
    doc = np.searchsorted(ends, cuts, side="right")
    doc = np.minimum(doc, ends.size - 1)
    stop = np.concatenate([cuts[1:], [at.size]]) - 1
    ok = cuts <= lasts[doc]
    a, z, doc = cuts[ok], stop[ok], doc[ok]
    over = z + window
    anchor = at[a]
    h = _mix(grams[anchor] ^ np.uint64(_BASE)) >> np.uint64(16)  # smallest hashes are not even: mix again
    c = _mix((sums[over] - sums[a]) * down[a] + (over - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(8)
    return h, c, doc, a, z, anchor


class Slice:
    """The documents of a slice in order of doc_id, their spans, and the distinct spans (entries)."""

    def __init__(self, ids: list, texts: list, buckets: int, window: int, gram: int):
        keys = np.array([_BIG if i is None else i for i in ids], np.int64)
        self.rows = np.argsort(keys, kind="stable")
        self.keys = keys[self.rows]
        self.raw = [(texts[r] or "").encode("utf-8", "surrogatepass") for r in self.rows]
        parts, lo = [], 0
        while lo < len(self.raw):
            hi, size = lo, 0
            while hi < len(self.raw) and (hi == lo or size + len(self.raw[hi]) <= STEP):
                size += len(self.raw[hi])
                hi += 1
            if size >= LONG:
                parts += self._long(lo, window, gram)
            else:
                ends = np.cumsum([len(x) for x in self.raw[lo:hi]])
                h, c, doc, a, z, p = _spans(np.frombuffer(b"".join(self.raw[lo:hi]), np.uint8), ends, window, gram)
                base = np.concatenate([[0], ends[:-1]])[doc] if doc.size else doc
                parts.append((h, c, doc + lo, a - base, z - base, p - base))
            lo = hi
        h, c, doc, a, z, p = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 4
        order = np.lexsort((doc, c, h))
        self.h, self.c, self.doc, self.a, self.z, self.p = (x[order] for x in (h, c, doc, a, z, p))
        first = np.ones(self.h.size, bool)
        first[1:] = (self.h[1:] != self.h[:-1]) | (self.c[1:] != self.c[:-1])
        self.first = np.flatnonzero(first)
        self.entry = np.cumsum(first) - 1
        self.bucket = ((self.h[self.first] * np.uint64(buckets)) >> np.uint64(48)).astype(np.int64)
        self.bounds = np.searchsorted(self.bucket, np.arange(buckets + 1))
        self.ids = self.keys[self.doc[self.first]] if self.h.size else np.empty(0, np.int64)

    def _long(self, d: int, window: int, gram: int):
        """A document beyond LONG bytes, in overlapping stretches whose windows do not overlap."""
        raw, out, step = self.raw[d], [], STRETCH
        for at in range(0, max(1, len(raw) - window + 1), step):
            part = np.frombuffer(raw[at : at + step + window - 1], np.uint8)
            h, c, doc, a, z, p = _spans(part, np.array([part.size]), window, gram)
            out.append((h, c, doc + d, a + at, z + at, p + at))
        return out


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).reshape(-1).view("<u8")


def _zip(*raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _unzip(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompressobj().decompress(blob)


_ASK = "slice int, bucket int, kind int, n int, blob binary"


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.table({n: pa.array(c, pa.binary() if n == "blob" else pa.int32()) for n, c in zip(("slice", "bucket", "kind", "n", "blob"), cols, strict=True)})


def _tell(buckets, window, gram):
    """Step 1."""

    def run(key, docs):
        s = Slice(docs.column("_id").to_pylist(), docs.column("text").to_pylist(), buckets, window, gram)
        out = []
        for b in np.unique(s.bucket):
            lo, hi = s.bounds[b], s.bounds[b + 1]
            h = s.h[s.first[lo:hi]]
            steps = np.diff(h, prepend=np.uint64(0))
            ids = s.ids[lo:hi].view(np.uint64)
            out.append((key[0].as_py(), int(b), 0, int(hi - lo), _zip(_planes(steps), _planes(s.c[s.first[lo:hi]]), _planes(ids))))
        return _rows(out)

    return run


def _judge(h, c, i):
    """Flags of entries (anchor, span, smallest document), all of an anchor at once."""
    order = np.lexsort((i, c, h))
    h, c, i = h[order], c[order], i[order]
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
    firsts = np.flatnonzero(new_c)
    whole = i > i[firsts][np.cumsum(new_c) - 1]
    group = np.cumsum(new_h) - 1
    kinds = np.bincount(group[firsts])
    starts = np.flatnonzero(new_h)
    differ = np.minimum.reduceat(i, starts) < np.maximum.reduceat(i, starts)
    flags = np.zeros(h.size, np.uint8)
    flags[order] = np.where(whole, 1, np.where((kinds > 1)[group] & differ[group], 2, 0))
    return flags


def _answer(key, asked):
    """Step 2: for each entry 1 (a repeat whole), 2 (bytes needed) or 0."""
    slices, sizes = asked.column("slice").to_pylist(), asked.column("n").to_pylist()
    hs, cs, ids = [], [], []
    for n, blob in zip(sizes, asked.column("blob").to_pylist(), strict=True):
        raw = _unzip(blob)
        hs.append(np.cumsum(_from_planes(raw, n)))
        cs.append(_from_planes(raw[8 * n :], n))
        ids.append(_from_planes(raw[16 * n :], n).view(np.int64))
    h, c, i = np.concatenate(hs), np.concatenate(cs), np.concatenate(ids)
    del hs, cs, ids
    flags = np.zeros(h.size, np.uint8)
    part = (h >> np.uint64(8)) % np.uint64(-(-h.size // ANSWERED))
    for k in range(-(-h.size // ANSWERED)):
        own = np.flatnonzero(part == k)
        if own.size:
            flags[own] = _judge(h[own], c[own], i[own])
    out, at = [], 0
    for s, n in zip(slices, sizes, strict=True):
        own = flags[at : at + n]
        at += n
        if own.any():
            out.append((s, key[0].as_py(), 1, n, _zip(own.tobytes())))
    return _rows(out)


def _flags(s: Slice, said: pa.Table) -> np.ndarray:
    flags = np.zeros(s.first.size, np.uint8)
    for b, kind, n, blob in zip(*(said.column(c).to_pylist() for c in ("bucket", "kind", "n", "blob")), strict=True):
        if kind == 1:
            flags[s.bounds[b] : s.bounds[b] + n] = np.frombuffer(_unzip(blob), np.uint8)
    return flags


def _send(buckets, window, gram):
    """Step 3, sending: the bytes of the entries asked for."""

    def run(key, docs, said):
        if not docs.num_rows or not said.num_rows:
            return _rows([])
        s = Slice(docs.column("_id").to_pylist(), docs.column("text").to_pylist(), buckets, window, gram)
        flags, out = _flags(s, said), []
        for b in np.unique(s.bucket[flags == 2]):
            e = np.arange(s.bounds[b], s.bounds[b + 1])
            e = e[flags[e] == 2]
            o = s.first[e]
            size = s.z[o] + window - s.a[o]
            text = b"".join(s.raw[d][x : x + n] for d, x, n in zip(s.doc[o].tolist(), s.a[o].tolist(), size.tolist(), strict=True))
            cols = (e - s.bounds[b], s.h[o], s.ids[e].view(np.uint64), size, s.p[o] - s.a[o])
            out.append((key[0].as_py(), int(b), 2, int(e.size), _zip(*map(_planes, cols), text)))
        return _rows(out)

    return run


def repeated_windows(h, ids, sizes, anchors, text: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Bit i of an entry: its window i is also in a span of the same anchor and a smaller document.

    h, ids, sizes, anchors: of the spans, whose bytes follow one another in `text`.
    """
    begins = np.cumsum(sizes) - sizes
    masks = np.zeros(h.size, np.uint64)
    group = np.unique(h, return_inverse=True)[1].reshape(-1)
    for own in _batches(group, sizes):
        masks[own] = _indexed(own, group[own] - group[own].min(), begins, ids, sizes, anchors, text, window, gram)
    return masks


def _batches(group: np.ndarray, sizes: np.ndarray):
    """Whole groups, about INDEXED bytes at a time."""
    order = np.argsort(group, kind="stable")
    total = np.cumsum(sizes[order])
    lo = 0
    while lo < order.size:
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + INDEXED, side="right"))
        hi = max(hi, lo + 1)
        while hi < order.size and group[order[hi]] == group[order[hi - 1]]:
            hi += 1
        yield order[lo:hi]
        lo = hi


def _indexed(own, tag, begins, ids, sizes, anchors, text, window, gram):
    """Window bits of the spans `own`: one index over them, through which each of them is streamed."""
    if tag.max() >= 1 << (8 * _TAGS):
        raise ValueError("more anchors than tags can name")
    width = int(sizes[own].max()) + _TAGS

    def tagged(at):
        """Rows of symbols, right-aligned, with the tag right after the anchor gram; -1 before them."""
        spans, tags = own[at], tag[at]
        n = sizes[spans][:, None]
        col = np.arange(width)[None, :] - (width - n - _TAGS)
        cut = (anchors[spans] + gram)[:, None]
        source = np.where(col < cut, col, np.maximum(col - _TAGS, 0))
        sym = text[np.clip(begins[spans][:, None] + source, 0, text.size - 1)].astype(np.int16) + 1
        digit = col - cut
        named = (_TAG + ((tags[:, None] >> (8 * np.clip(digit, 0, _TAGS - 1))) & 255)).astype(np.int16)
        sym = np.where((digit >= 0) & (digit < _TAGS), named, sym)
        return np.where(col < 0, np.int16(-1), sym)

    parts = [np.arange(i, min(i + STREAMS, own.size)) for i in range(0, own.size, STREAMS)]
    rows = np.concatenate([np.pad(tagged(at), ((0, 0), (0, 1))) for at in parts])
    whole = rows >= 0
    values = np.repeat(ids[own], whole.sum(1))
    index = RunIndex(rows[whole], width + 1, window + _TAGS, values)
    del rows, whole, values
    bits = np.zeros(own.size, np.uint64)
    for at in parts:
        rows = tagged(at)
        size, place = index.matching_statistics(np.where(rows < 0, 1023, rows))
        first = width - sizes[own[at]] - _TAGS
        for w in range(window - gram + 1):
            k = np.flatnonzero(w <= sizes[own[at]] - window)
            col = first[k] + w
            hit = k[(size[k, col] >= window + _TAGS) & (index.least(place[k, col]) < ids[own[at[k]]])]
            bits[at[hit]] |= np.uint64(1 << w)
    return bits


def _match(window, gram):
    """Step 3, matching: window bits of every span sent."""

    def run(key, sent):
        slices, sizes = sent.column("slice").to_pylist(), sent.column("n").to_pylist()
        cols, texts = [[] for _ in range(5)], []
        for n, blob in zip(sizes, sent.column("blob").to_pylist(), strict=True):
            raw = _unzip(blob)
            for k in range(5):
                cols[k].append(_from_planes(raw[8 * k * n : 8 * (k + 1) * n], n))
            texts.append(np.frombuffer(raw, np.uint8, offset=40 * n))
        at, h, ids, size, anchor = (np.concatenate(x) for x in cols)
        masks = repeated_windows(h, ids.view(np.int64), size.astype(np.int64), anchor.astype(np.int64), np.concatenate(texts), window, gram)
        out, lo = [], 0
        for s, n in zip(slices, sizes, strict=True):
            some = np.flatnonzero(masks[lo : lo + n])
            if some.size:
                out.append((s, key[0].as_py(), 3, int(some.size), _zip(_planes(at[lo : lo + n][some]), _planes(masks[lo : lo + n][some]))))
            lo += n
        return _rows(out)

    return run


def _runs(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of intervals; touching ones are one."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    at = np.flatnonzero(new)
    return list(zip(s[at].tolist(), e[np.concatenate([at[1:], [s.size]]) - 1].tolist(), strict=True))


def _whole_chars(runs: list, raw: bytes) -> list[tuple[int, int]]:
    """The runs without the parts of characters at their edges."""
    out = []
    for x, y in runs:
        while x < y and raw[x] & 0xC0 == 0x80:
            x += 1
        while y > x and y < len(raw) and raw[y] & 0xC0 == 0x80:
            y -= 1
        if x < y:
            out.append((x, y))
    return out


def _finish(buckets, window, gram, keep, whole_chars):
    """Step 4."""

    def run(key, docs, said):
        s = Slice(docs.column("_id").to_pylist(), docs.column("text").to_pylist(), buckets, window, gram)
        flags = _flags(s, said)
        masks = np.zeros(s.first.size, np.uint64)
        for b, kind, n, blob in zip(*(said.column(c).to_pylist() for c in ("bucket", "kind", "n", "blob")), strict=True):
            if kind == 3:
                raw = _unzip(blob)
                masks[s.bounds[b] + _from_planes(raw, n).astype(np.int64)] = _from_planes(raw[8 * n :], n)
        later = s.keys[s.doc] > s.ids[s.entry] if s.h.size else np.empty(0, bool)
        whole = later | (flags[s.entry] == 1)
        doc, lo, hi = [s.doc[whole]], [s.a[whole]], [s.z[whole] + window]
        part = np.flatnonzero(~whole & (masks[s.entry] != 0)) if s.h.size else np.empty(0, np.int64)
        for w in range(window - gram + 1):
            hit = part[(masks[s.entry[part]] >> np.uint64(w)) & np.uint64(1) == 1]
            doc.append(s.doc[hit])
            lo.append(s.a[hit] + w)
            hi.append(s.a[hit] + w + window)
        doc, lo, hi = map(np.concatenate, (doc, lo, hi))
        order = np.argsort(doc, kind="stable")
        doc, lo, hi = doc[order], lo[order], hi[order]
        cut = np.searchsorted(doc, np.arange(len(s.raw) + 1))
        removed, kept = [None] * len(s.raw), [None] * len(s.raw)
        for d, raw in enumerate(s.raw):
            a, z = cut[d], cut[d + 1]
            runs = _runs(lo[a:z], hi[a:z]) if z > a else []
            runs = _whole_chars(runs, raw) if whole_chars else runs
            removed[s.rows[d]] = [{"start": x, "end": y} for x, y in runs]
            edges = [0, *(v for r in runs for v in r), len(raw)]
            kept[s.rows[d]] = b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({**{c: docs.column(c) for c in keep}, "removed": pa.array(removed, span), "kept": pa.array(kept, pa.binary())})

    return run


def deduplicate(docs: DataFrame, *keep: str, window: int = WINDOW, gram: int = GRAM, whole_chars: bool = False) -> DataFrame:
    """The kept columns (doc_id if none is named), removed array<struct<start, end>> in bytes, kept binary.

    whole_chars: removed runs give up the parts of characters at their edges, so that what is kept is
    text again.
    """
    spark = docs.sparkSession
    ship(spark)
    keep = keep or ("doc_id",)
    # as many slices as the texts need, whatever the session's number of partitions
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    slices = max(2 * shuffle_partitions(spark), -(-total // SLICE))
    parts = buckets = -(-slices // 2)
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]), F.col("doc_id").cast("long").alias("_id"))
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64("_id", "text"), F.lit(slices)).cast("int")).repartition(parts, "_slice")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    kept = T.StructType([*(docs.schema[c] for c in keep), T.StructField("removed", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])
    by_slice = rows.groupBy("_slice")
    said = by_slice.applyInArrow(lean(_tell(buckets, window, gram)), _ASK).groupBy("bucket").applyInArrow(lean(_answer), _ASK)
    sent = by_slice.cogroup(said.groupBy("slice")).applyInArrow(lean(_send(buckets, window, gram)), _ASK)
    found = sent.groupBy("bucket").applyInArrow(lean(_match(window, gram)), _ASK)
    all_said = said.unionByName(found)
    return by_slice.cogroup(all_said.groupBy("slice")).applyInArrow(lean(_finish(buckets, window, gram, keep, whole_chars)), kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: sizes and digests of every document without its repeats."""
    done = deduplicate(table(spark, sf_dir, "documents"), "doc_id")
    cut = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return done.select("doc_id", (F.octet_length("kept") + cut).cast("long").alias("n_bytes"), cut.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
