"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import inspect
import io
import os
import time
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"
#: Seconds between two returns of a worker's unused memory; partitions, a core, that a small table is cut in at most.
GIVE_BACK, FILES = 1.0, 4


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer file; every node has the package installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application (a few dozen kB)."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark"), "tidemark_pkg.zip")
    with open(path, "wb") as f:
        f.write(buffer.getvalue())
    sc.addPyFile(path)
    sc._tidemark_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of this machine's own only in local mode and where none is named."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="tidemark-ckpt")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, small: bool = False) -> DataFrame:
    """Cut lineage: materialise df in the shared checkpoint folder.

    small: rows of few bytes, in FILES partitions a core at most.  Every partition, an empty one too, is a file, for
    whose mode Hadoop starts a process from the executor on local folders.
    """
    checkpoint_dir(df.sparkSession)
    df = df.coalesce(FILES * max(1, df.sparkSession.sparkContext.defaultParallelism)) if small else df
    return df.checkpoint(eager=True)


_given = [0.0]


def give_back(now: bool = False) -> None:
    """Returns what the allocators of a Python worker hold unused, every GIVE_BACK seconds or at once.

    Workers live on between tasks, and Arrow's pool alone keeps some 100 MB of the largest batches.
    """
    if not now and time.monotonic() - _given[0] < GIVE_BACK:
        return
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
    _given[0] = time.monotonic()


def lean(run):
    """run, a function of batches, of (key, rows) or of (key, rows, others), that gives its worker's unused memory back."""
    if inspect.isgeneratorfunction(run):

        def over_batches(batches):
            for x in run(batches):
                yield x
                del x
                give_back()
            give_back(now=True)

        return over_batches
    if len(inspect.signature(run).parameters) == 2:

        def over_group(key, rows):
            out = run(key, rows)
            give_back()
            return out

        return over_group

    def over_groups(key, rows, others):
        out = run(key, rows, others)
        give_back()
        return out

    return over_groups


def lower_ascii(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_running(df: DataFrame, **sizes) -> DataFrame:
    """Adds, for each name, the exclusive running sums of the array<bigint> column named there.

    Sums go in blocks, so that long arrays stay cheap.  Every array that a lambda reads is a column of
    an earlier projection which the optimizer keeps apart (it is read more than once), so nothing is
    evaluated again for each element.
    """
    block, zero = 128, F.lit(0).cast("long")
    none = F.array().cast("array<bigint>")

    def over(source, one):
        c = F.col(source)
        return F.when(c.isNull() | (F.size(c) == 0), none).otherwise(one(c))

    def sums(c):
        last = F.ceil(F.size(c) / F.lit(block)).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(c, b * block + 1, block), zero, lambda a, x: a + x))

    def before(c):
        return F.transform(c, lambda _, b: F.aggregate(F.slice(c, F.lit(1), b), zero, lambda a, x: a + x))

    def final(own):
        def one(c):
            at = lambda i: F.floor(i / F.lit(block)).cast("int")
            return F.when(F.col(own).isNull(), none).otherwise(F.transform(c, lambda _, i: F.get(F.col(own), at(i)) + F.aggregate(F.slice(c, at(i) * block + 1, i % block), zero, lambda a, x: a + x)))

        return one

    df = df.withColumns({f"_o_{n}": over(s, sums) for n, s in sizes.items()})
    df = df.withColumns({f"_b_{n}": over(f"_o_{n}", before) for n in sizes})
    df = df.withColumns({n: over(s, final(f"_b_{n}")) for n, s in sizes.items()})
    return df.drop(*(f"_{x}_{n}" for x in "ob" for n in sizes))
