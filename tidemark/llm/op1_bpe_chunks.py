"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash over 32 characters says so, so that copies and shared passages
fall into equal chunks.  Chunks met more than once are encoded once, at one place of occurrence;
their ids travel back to every text that holds them, the remaining stretches are encoded in place,
and every join of two stretches is repaired: a window of words around it is encoded anew and widened
until it agrees with the ids on both sides.

Defined results: a null text is the empty text (no ids, empty decoding); a null doc_id is kept (the
smallest long stands for it on the way, so that id comes back null too);
repeated rows give repeated results; extra columns are ignored; an empty table gives no rows.
Texts of any length are processed whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import ship, shuffle_partitions, table, tokenizer_path

WINDOW, MASK, SMALLEST, LARGEST = 32, 1023, 256, 16384
#: Words of a generation of the encoder's memo: joins need memory beside it.
WORDS = 40_000
#: Stands for a null doc_id between the steps.
NO_ID = -(1 << 63)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def chunk_ends(text: str) -> list[int]:
    """Ends of the content-defined chunks of a text, in characters; the last is its length."""
    n = len(text)
    if n <= SMALLEST:
        return [n] if n else []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h = (points * _MULT) ^ (points << np.uint64(17))
    width = 1
    while width < WINDOW:  # windows of 2, 4, ... characters by doubling
        h = (h[:-width] * _MULT + h[width:]) if h.size > width else h[:0]
        width *= 2
    hits = np.flatnonzero(((h ^ (h >> np.uint64(29))) >> np.uint64(20)) & np.uint64(MASK) == 0) + WINDOW
    ends, last = [], 0
    for p in hits.tolist():
        if p - last < SMALLEST:
            continue
        while p - last > LARGEST:
            last += LARGEST
            ends.append(last)
        if p - last >= SMALLEST and p < n:
            ends.append(p)
            last = p
    while n - last > LARGEST:
        last += LARGEST
        ends.append(last)
    ends.append(n)
    return ends


def _small(batches, rows: int = 1024):
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
        pa.default_memory_pool().release_unused()


def _press(batches):
    """Texts as zstd frames: a third less to shuffle than what the engine's own codec makes of them."""
    for b in _small(batches):
        pack = zstandard.ZstdCompressor(level=3, write_content_size=True)
        z = [pack.compress(t.encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("d"), b.column("k"), pa.array(z, pa.binary())], ["d", "k", "z"])


def _texts(b) -> list[str]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(z).decode("utf-8", "surrogatepass") if z != _EMPTY else "" for z in b.column("z").to_pylist()]


_EMPTY = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(b"")


def _chunks(batches):
    """Chunks of the texts; of equal rows, which meet in one task, only one's, so that no row's list holds them again."""
    seen = set()
    for b in _small(batches):
        docs, keys, hashes, starts, ends = [], [], [], [], []
        for d, k, text in zip(b.column("d").to_pylist(), b.column("k").to_pylist(), _texts(b), strict=True):
            if (row := hash((d, k))) in seen:  # a chance match costs reuse, nothing else
                continue
            seen.add(row)
            last = 0
            for e in chunk_ends(text):
                docs.append(d)
                keys.append(k)
                hashes.append(hashlib.blake2b(text[last:e].encode("utf-8", "surrogatepass"), digest_size=12).digest())
                starts.append(last)
                ends.append(e)
                last = e
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(hashes, pa.binary()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["d", "k", "h", "s", "e"])


def _encode_chunks(path):
    def run(batches):
        enc = encoder(path, WORDS)
        for b in _small(batches):
            hashes, ids = [], []
            for text, at in zip(_texts(b), b.column("at").to_pylist(), strict=True):
                for x in at or ():
                    hashes.append(x["h"])
                    ids.append(_pack(enc.packed(text[x["s"] : x["e"]])))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(ids, pa.binary())], ["h", "ids"])

    return run


def _pack(ids: bytes) -> bytes:
    """Two bytes an id where all fit; the first byte says how many."""
    a = np.frombuffer(ids, "<u4")
    return b"\x02" + a.astype("<u2").tobytes() if not a.size or a.max() < 65536 else b"\x04" + ids


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if packed[0] == 2 else "<u4", offset=1).astype("<u4")


def _outer(text: str, a: int, b: int, side: int) -> str:
    """The outermost whole word of text[a:b] on the side away from the cut; empty if none is whole."""
    words = text[a:b].split()
    whole = len(words) > 1 or (words and text[b - 1 if side > 0 else a].isspace())
    return words[0 if side > 0 else -1] if whole else ""


def repair(enc, text: str, at: int, lo: int, hi: int, left: np.ndarray, right: np.ndarray):
    """Join the ids of text[lo:at] and text[at:hi]: (final ids, ids still open, where these start).

    A window of words around the cut is encoded alone.  It stands if both sides' ids are found at
    its ends and its outer words have the same ids in the window and in the side; else it doubles,
    at last to all of text[lo:hi].
    """
    reach = 48
    while True:
        a, b = max(lo, at - reach), min(hi, at + reach)
        if a > lo:
            a = next((i for i in range(a, at) if text[i].isspace()), lo)
        if b < hi:
            b = next((i for i in range(b, at, -1) if text[i - 1].isspace()), hi)
        if a == lo and b == hi:
            return left[:0], enc.encode(text[lo:hi]), lo
        old_l, old_r, new = enc.encode(text[a:at]), enc.encode(text[at:b]), enc.encode(text[a:b])
        n, m, ok = old_l.size, old_r.size, True
        if a > lo:
            first = enc.encode(_outer(text, a, at, 1))
            ok = 0 < first.size and n <= left.size and np.array_equal(left[left.size - n :], old_l) and np.array_equal(new[: first.size], first) and np.array_equal(old_l[: first.size], first)
        if ok and b < hi:
            last = enc.encode(_outer(text, at, b, -1))
            ok = 0 < last.size and m <= right.size and np.array_equal(right[:m], old_r) and np.array_equal(new[new.size - last.size :], last) and np.array_equal(old_r[m - last.size :], last)
        if ok and b < hi:
            return np.concatenate([left[: left.size - n] if a > lo else left[:0], new]), right[m:], b
        if ok:
            return left[: left.size - n], new, a
        reach *= 2


def encode_with(enc, text: str, known: list) -> np.ndarray:
    """Ids of a text; known: (start, end, ids) of its reused chunks, by start."""
    parts, last = [], 0
    for s, e, ids in known:
        if s > last:
            parts.append((last, s, enc.encode(text[last:s])))
        if s >= last:
            parts.append((s, e, ids))
            last = e
    if last < len(text):
        parts.append((last, len(text), enc.encode(text[last:])))
    if not parts:
        return np.empty(0, "<u4")
    done, (lo, _, cur) = [], parts[0]
    for s, e, ids in parts[1:]:
        final, cur, lo = repair(enc, text, s, lo, e, cur, ids)
        done.append(final)
    return np.concatenate([*done, cur])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *(x.size for x in arrays)]).astype(np.int32)
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _encode_docs(path, decoded):
    def run(batches):
        enc = encoder(path, WORDS)
        for part in _small(batches, 256):
            ids = []
            for text, known in zip(_texts(part), part.column("known").to_pylist(), strict=True):
                chunks = sorted({(x["s"], x["e"]): x["ids"] for x in known or ()}.items())
                ids.append(encode_with(enc, text, [(s, e, _unpack(i)) for (s, e), i in chunks]))
            doc_id = [None if d == NO_ID else d for d in part.column("d").to_pylist()]
            texts = [pa.array([enc.decode(x) for x in ids], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), _lists(ids), *texts], ["doc_id", "ids", *["decoded"] * decoded])

    return run


def encode(docs: DataFrame, path: str | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>[, decoded: what decode() gives for the ids]) of each row's whole text.

    The texts are shuffled once, by row; chunk hashes, and the ids of shared chunks only, travel
    beside them.  A hash with very many occurrences is met by a map-side combine where it is
    counted and by a join that the engine may split where its ids are dealt out.
    """
    ship(docs.sparkSession)
    path = path or tokenizer_path()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.xxhash64("text")).mapInArrow(_press, "d long, k long, z binary")
    # all readers below take all three columns, so that one exchange serves them
    dealt = rows.repartition(shuffle_partitions(docs.sparkSession), "d", "k")
    occ = dealt.mapInArrow(_chunks, "d long, k long, h binary, s int, e int")
    shared = occ.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("d", "k", "s", "e")).alias("at")).filter("n > 1")
    places = shared.groupBy("at.d", "at.k").agg(F.collect_list(F.struct("h", "at.s", "at.e")).alias("at"))
    # left: an inner join's null checks would go below the exchange and make it another one
    once = dealt.join(places, ["d", "k"], "left").mapInArrow(_encode_chunks(path), "h binary, ids binary")
    once = once.groupBy("h").agg(F.min("ids").alias("ids"))
    known = occ.join(once, "h").groupBy("d", "k").agg(F.collect_list(F.struct("s", "e", "ids")).alias("known"))
    return dealt.join(known, ["d", "k"], "left").mapInArrow(_encode_docs(path, decoded), "doc_id long, ids array<int>" + ", decoded string" * decoded)


def _decode(path):
    def run(batches):
        enc = encoder(path, WORDS)
        for b in batches:
            flat, offs = b.column("ids").flatten().to_numpy(zero_copy_only=False), b.column("ids").offsets.to_numpy()
            offs = offs - offs[0]
            for lo in range(0, b.num_rows, 512):
                hi = min(lo + 512, b.num_rows)
                texts = [enc.decode(flat[offs[i] : offs[i + 1]]) for i in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("ids").slice(lo, hi - lo), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of rows of (doc_id, ids array<int>)."""
    ship(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path or tokenizer_path()), f"doc_id {kind}, ids array<int>, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: digests of every document's ids and of their decoding."""
    done = encode(table(spark, sf_dir, "documents"), decoded=True)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
