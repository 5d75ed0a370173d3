import glob

from pyspark.sql import functions as F

from tidemark.llm import components, op5_simhash


def _left(batches):
    """MB that this worker could still give back."""
    import ctypes
    import re
    import time

    import pyarrow as pa

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", f.read()))) / 1024

    for b in batches:
        before = held()
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
        time.sleep(0.3)  # so that every worker gets one
        yield pa.RecordBatch.from_arrays([pa.array([before - held()] * b.num_rows)], ["mb"])


def test_workers_give_back_what_large_batches_took(spark):
    docs = spark.range(0, 40_000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" w"), 1500)).alias("text"))
    assert op5_simhash.fingerprints(docs).agg(F.count("fp")).first()[0] == 40_000
    assert max(r.mb for r in spark.range(0, 4, 1, 4).mapInArrow(_left, "mb double").collect()) < 15


def test_links_are_cut_in_few_files(spark):
    edges = spark.range(0, 300, 1, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/**/part-*", recursive=True))
    assert {r.b for r in components.stars(edges).collect()} == {0}
    assert len(set(glob.glob(f"{folder}/**/part-*", recursive=True)) - before) <= 40
