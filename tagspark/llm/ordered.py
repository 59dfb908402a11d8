"""Places and running sums over a whole ordered table, for any size of a group.

Rows are dealt out by ranges of their sort key, so one key's rows may lie over many tasks. What a task
needs of the tasks before it is one row each: these few rows, as many as there are tasks, pass the driver.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark.llm.common import in_batches, keep

#: Sums are taken modulo 2^62, so that two of them can be added as longs.
MASK = (1 << 62) - 1


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, by: list, out: str, name: str) -> DataFrame:
    """``df`` with the column ``out``: each row's place, from 0 without gaps, in the order of ``by``.

    Written to the shared folder; rows that are equal in ``by`` keep one order from then on. An empty table stays empty.
    """
    rows = df.repartitionByRange(partitions(df), *by).sortWithinPartitions(*by) if by else df
    rows = keep(rows.withColumn("at__", F.monotonically_increasing_id()), name)
    part = F.shiftright("at__", 33)
    sizes = sorted(rows.groupBy(part.alias("p")).count().collect())
    begins = zip([r[0] for r in sizes], accumulate([r[1] for r in sizes], initial=0), strict=False)
    offsets = F.broadcast(df.sparkSession.createDataFrame(list(begins), "part__ long, offset__ long"))  # a row for each task
    placed = rows.withColumn("part__", part).join(offsets, "part__")
    return placed.select(*df.columns, (F.col("offset__") + F.col("at__").bitwiseAND(F.lit((1 << 33) - 1))).alias(out))


def running_sums(df: DataFrame, key: str, order: list[str], lanes: list[str], name: str) -> DataFrame:
    """``df`` with each of ``lanes`` (longs from 0) replaced by its sum over the rows of the same ``key`` (a long,
    not null) up to this one in ``order``, modulo 2^62. Written to the shared folder."""
    wide = df.select("*", F.lit(0).alias("part__"), F.lit(0).cast("long").alias("seq__"))
    own, names, types = df.columns, wide.columns, wide.schema

    def run(batches):
        part, seq, last, carry = TaskContext.get().partitionId(), 0, None, [0] * len(lanes)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key).to_numpy()
            new = np.r_[last is None or keys[0] != last, keys[1:] != keys[:-1]]
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: goes on from the batch before
            columns = {c: batch.column(c) for c in own}
            for i, lane in enumerate(lanes):
                with np.errstate(over="ignore"):
                    total = np.r_[np.uint64(0), np.cumsum(batch.column(lane).to_numpy().astype(np.uint64), dtype=np.uint64)]
                    sums = total[1:] - np.where(start >= 0, total[np.maximum(start, 0)], np.uint64(0))
                    sums = (sums + np.where(start < 0, np.uint64(carry[i]), np.uint64(0))) & np.uint64(MASK)
                carry[i] = int(sums[-1])
                columns[lane] = pa.array(sums.astype(np.int64))
            last = keys[-1]
            columns["part__"], columns["seq__"] = pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n))
            seq += n
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    by = [key, *order]
    rows = keep(in_batches(df.repartitionByRange(partitions(df), *by).sortWithinPartitions(*by), run, types), name)
    ends = rows.groupBy("part__").agg(F.min(key).alias("first"), F.max(key).alias("last"), *(F.max_by(c, "seq__").alias(f"end_{i}") for i, c in enumerate(lanes)))
    before, adds = None, []
    for r in sorted(ends.collect()):  # a row for each task
        tail = [r[f"end_{i}"] for i in range(len(lanes))]
        if before is not None and before[0] == r["first"]:
            adds.append((r["part__"], r["first"], *before[1]))
            if r["first"] == r["last"]:
                tail = [(x + y) & MASK for x, y in zip(tail, before[1], strict=True)]
        before = (r["last"], tail)
    if adds:
        extra = ", ".join(f"add_{i} long" for i in range(len(lanes)))
        more = F.broadcast(df.sparkSession.createDataFrame(adds, f"part__ int, {key} long, {extra}"))
        rows = rows.join(more, ["part__", key], "left")
        for i, lane in enumerate(lanes):
            rows = rows.withColumn(lane, (F.col(lane) + F.coalesce(f"add_{i}", F.lit(0).cast("long"))).bitwiseAND(F.lit(MASK)))
    return rows.select(*df.columns)
