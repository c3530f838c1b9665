"""Pairs within buckets without listing them.

A bucket of up to ``block`` rows is solved in one call. A larger one is dealt
into slots, and each pair of slots is solved on its own, so that no task ever
holds more than two slots of a bucket however hot it is. Solvers report
forests of links and counts, not pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a bucket that are solved at once.
BLOCK = 1024


class Split:
    """Rows of one bucket, or of two of its slots; ``crossing`` says that only pairs from different slots count."""

    def __init__(self, batch: pa.Table):
        self.batch = batch
        i, j = batch.column("i")[0].as_py(), batch.column("j")[0].as_py()
        self.crossing = i != j
        self.slot = self.column("s")
        self.bucket = batch.column("bucket")[0].as_py()

    def __len__(self) -> int:
        return self.batch.num_rows

    def column(self, name: str) -> np.ndarray:
        return self.batch.column(name).to_numpy()

    def raw(self, name: str) -> pa.Array:
        x = self.batch.column(name)
        return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x

    def counted(self, adjacent: np.ndarray) -> np.ndarray:
        """``adjacent`` without the diagonal, and without pairs that another block counts."""
        np.fill_diagonal(adjacent, False)
        if self.crossing:
            adjacent &= self.slot[:, None] != self.slot[None, :]
        return adjacent


def forest(adjacent: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the smallest row of its component."""
    n = len(adjacent)
    roots = np.arange(n)
    while True:
        near = np.minimum(roots, np.where(adjacent, roots[None, :], n).min(1, initial=n))
        near = near[near]
        if (near == roots).all():
            return roots
        roots = near


def union(block: Split, column: str, linked: Callable, as_type=None) -> np.ndarray:
    """Component roots of a block's rows under ``linked(x, y)``, which compares two arrays all against all."""
    x = block.column(column)
    x = x.view(as_type) if as_type is not None else x
    return forest(block.counted(linked(x, x)))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream sorted by ``keys``; holds one group and one batch at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def bucket_blocks(rows: DataFrame, solve: Callable[[Split], pa.RecordBatch], schema: str, block: int = BLOCK, payload: DataFrame | None = None) -> DataFrame:
    """Apply ``solve`` to the buckets of ``rows (bucket, node, ...)`` that hold two rows or more.

    ``payload (node, ...)`` has one row for each node: wide columns that rows get only after they are dealt out.
    """
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1").select("bucket", F.ceil(F.col("_n") / block).cast("int").alias("_k"))
    dealt = (rows.join(sizes, "bucket")
             .withColumn("s", F.when(F.col("_k") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.col("_k")).cast("int")))
             .withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
             .withColumn("i", F.least("s", "_t")).withColumn("j", F.greatest("s", "_t")).drop("_t", "_k"))
    if payload is not None:
        dealt = dealt.join(payload, "node")

    def run(batches):
        for group in groups(batches, ["bucket", "i", "j"]):
            if group.num_rows > 1:
                out = solve(Split(group))
                if out.num_rows:
                    yield out

    return dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, schema)
