"""What Python workers keep between their tasks."""

import gc
import os
import time
from pathlib import Path

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lexgrove.llm import common, packing


def test_pipeline_packing_leaves_nothing_in_its_workers(spark):
    """Workers go on with other stages, whose tasks need the memory of the tokenizer and its words."""
    docs = spark.createDataFrame([(i, f"one text of some words {i}") for i in range(40)], "doc_id long, text string").repartition(4)
    assert len({r["doc_id"] for r in corpus_pipeline.harmonic_packing(spark, docs, "").collect()}) == 40

    def held(batches):
        for _ in batches:
            time.sleep(0.3)  # so that each worker gets a task
        yield pa.record_batch({"n": pa.array([sum(isinstance(x, packing.Encoder) and x.most == 60_000_000 for x in gc.get_objects())])})

    assert {r["n"] for r in spark.range(0, 16, 1, 16).mapInArrow(held, "n long").collect()} == {0}


def test_freed_memory_goes_back():
    """A worker lives on after a large task; what it freed must be there for other processes."""
    resident = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6
    arrays = [np.ones(12_000) for _ in range(1000)]  # 96 MB, in pieces that come from the heap
    few = arrays[::50]
    del arrays
    before = resident()
    assert common.tidy(lambda key, rows: rows)((1,), few) is few
    assert resident() < before - 50
