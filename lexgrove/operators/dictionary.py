"""Values of words that a whole corpus decides, brought back to the places where documents hold them.

Documents are read in bundles. A bundle is one row: its distinct words, and in a blob its documents in numbers of those words. Only a
bundle's distinct words meet the corpus's table, so a token isn't shuffled, and a frequent word is one row for each bundle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.operators import annotations as A
from lexgrove.sources.workspace import stored

LEARNT = "_learnt"


def numbers(words: Iterable[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The number of each word among the distinct ones, in the order of their first place; and those."""
    index: dict[bytes, int] = {}
    at = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32)
    return at, list(index)


def bundled(docs: DataFrame, learnt: Column, run: Callable[[pa.RecordBatch, A.Annotated, np.ndarray], tuple[pa.Array, np.ndarray, int, pa.Table]]) -> DataFrame:
    """chunk, words, counts, docs, blob as a stored table. run: gets documents, their annotations and whether each is learnt from; gives
    their distinct words, a count for each, a number of documents, and a table that `looked_up` gets back."""

    def one(batch: pa.RecordBatch, x: A.Annotated) -> Iterable[pa.Array]:
        words, counts, n, table = run(batch, x, np.array(batch.column(LEARNT).fill_null(False), bool))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as writer:
            writer.write_table(table)
        ends = pa.array([0, len(words)], pa.int32())
        return pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())), pa.array([n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())

    rows = A.mapped(docs.withColumn(LEARNT, learnt), one, "words array<string>, counts array<long>, docs long, blob binary", LEARNT)
    return stored(rows.withColumn("chunk", F.monotonically_increasing_id()))


def counted(bundles: DataFrame) -> DataFrame:
    """word, n: the sum of its counts, of the words with one."""
    pairs = bundles.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    return pairs.filter("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def looked_up(bundles: DataFrame, values: DataFrame, run: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, missing: float = 0) -> DataFrame:
    """What `run` makes of each bundle's table and the values of its words; `missing` where values (word, value) has none."""
    places = bundles.select(F.col("chunk").alias("bundle"), F.posexplode("words").alias("place", "word"))
    found = places.join(values.select("word", "value"), "word").select("bundle", "place", "value")
    sizes = bundles.select("chunk", "blob", F.size("words").alias("n_words"))

    def meet(key: tuple, bundle: pa.Table, found: pa.Table) -> pa.Table:
        out = np.full(bundle["n_words"][0].as_py(), missing, found.schema.field("value").type.to_pandas_dtype())
        out[np.array(found["place"], np.int64)] = np.array(found["value"])
        return run(pa.ipc.open_stream(bundle["blob"][0].as_py()).read_all(), out)

    return sizes.groupBy("chunk").cogroup(found.groupBy("bundle")).applyInArrow(meet, schema)
