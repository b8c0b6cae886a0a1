"""What is left of a contraction once it fits one task with ease: solved there instead of in dozens of small jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Links of a remainder: some 2 MB of ids.
REMAINDER = 50_000


def in_one_task(df: DataFrame, solve: Callable[..., tuple[np.ndarray, ...]], schema: str) -> DataFrame:
    """``solve`` over the columns of ``df``, 64-bit integers of which the caller has counted :data:`REMAINDER` rows at most."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if kept:
            whole = pa.Table.from_batches(kept)
            out = solve(*(whole.column(i).to_numpy() for i in range(whole.num_columns)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    return df.coalesce(1).mapInArrow(run, schema)


def component_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its component) of every end: roots hook onto smaller ones, then paths are halved."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        nearer = label.copy()
        np.minimum.at(nearer, label[x], low)
        np.minimum.at(nearer, label[y], low)
        while not np.array_equal(shorter := nearer[nearer], nearer):
            nearer = shorter
        if np.array_equal(nearer, label):
            return ids, ids[label]
        label = nearer
