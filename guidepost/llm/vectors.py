"""What the vector operators share: whole-number components, exact distances and sums
over groups that leave a task as one row per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components beyond this size count as this size, so squares and their sums fit a long.
LIMIT = 2**25
#: Rows that one step inside a task works on.
STEP_ROWS = 4096


def usable(v: Column) -> Column:
    """Is the array of doubles there, not empty, and without null or non-finite components?"""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) > 0) & fine, F.lit(False))


def whole(v: Column, scale: int) -> Column:
    """floor(scale * x) of each component; all floors go down."""
    top = float(LIMIT)
    return F.transform(v, lambda x: F.floor(F.least(F.greatest(x * float(scale), F.lit(-top)), F.lit(top))).cast("int"))


def matrix(col: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column without nulls, all of one length, as 64-bit numbers."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, STEP_ROWS):
            yield batch.slice(lo, STEP_ROWS)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``x`` to its row of ``y``."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def pairwise(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all of ``c``, in whole numbers."""
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


class GroupSums:
    """Counts and componentwise sums of a fixed number of groups."""

    def __init__(self, groups: int, width: int):
        self.n = np.zeros(groups, np.int64)
        self.total = np.zeros((groups, width), np.int64)

    def add(self, group: np.ndarray, x: np.ndarray) -> None:
        if not len(group):
            return
        order = np.argsort(group, kind="stable")
        own = group[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        self.total[own[first]] += np.add.reduceat(x[order], first, axis=0)
        self.n += np.bincount(group, minlength=len(self.n))

    def batch(self) -> pa.RecordBatch:
        used = np.flatnonzero(self.n)
        sums = self.total[used]
        ends = pa.array(np.arange(len(used) + 1, dtype=np.int32) * self.total.shape[1])
        return pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(self.n[used]), pa.ListArray.from_arrays(ends, pa.array(sums.reshape(-1)))], names=["g", "n", "total"])


def group_sums(df: DataFrame, groups: int, width: int, of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums by group over all rows. ``of`` gives group and numbers of a batch.

    Each task returns at most one row per group, and what reaches the driver is
    ``groups`` times ``width`` numbers, whatever the size of the table."""

    def run(batches):
        sums = GroupSums(groups, width)
        for rows in slices(batches):
            sums.add(*of(rows))
        yield sums.batch()

    part = df.mapInArrow(run, "g int, n long, total array<long>").select("g", "n", F.posexplode("total").alias("at", "x"))
    n, total = np.zeros(groups, np.int64), np.zeros((groups, width), np.int64)
    for r in part.groupBy("g", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
        n[r["g"]] = r["n"]
        total[r["g"], r["at"]] = r["x"]
    return n, total


def moved(entries: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floor of its group's mean; groups without rows stay."""
    return np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], entries)
