"""Rounds of a fit over packs that stay where they are.

A pack is a bundle of arrays that never changes; it has a state (what the fit
holds of the pack's own terms or tokens), which each round replaces.  A round is
one job: every pack gets the small global value of the round before (counts per
document), makes its new state and its part of the new global value, and the
parts are added up as a tree.  Packs and states are kept in memory (spilling to
disk); every ``KEEP_EVERY`` rounds the states are written, which bounds what a
lost executor costs and how long the lineage gets.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
from pyspark import StorageLevel, cloudpickle
from pyspark.core.rdd import RDD
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir

MOST_GLOBAL = 1 << 20      # numbers of the global value (8 MB): more is left to joins
PACK_ROWS = 1 << 18        # rows of a pack, on average, at most
FILE_PACKS = 16
KEEP_EVERY = 10

# The workers' functions go by value: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def pack_count(df: DataFrame, rows: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PACK_ROWS))


def _one_by_one(rdd: RDD) -> RDD:
    """The RDD with each element pickled by itself, which lets two of them be zipped as they are."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


class Rounds:
    """``packs``: a DataFrame, one row a pack; ``load(row)`` gives ``(pack, first state)``."""

    def __init__(self, packs: DataFrame, load: Callable):
        ensure_checkpoint_dir(packs.sparkSession)
        self.level = StorageLevel.MEMORY_AND_DISK
        loaded = packs.rdd.map(load)
        self.packs = _one_by_one(loaded.map(lambda x: x[0])).persist(self.level)
        self.states = _one_by_one(loaded.map(lambda x: (x[1], None)))
        self.number = 0

    def round(self, step: Callable, value) -> np.ndarray:
        """``step(pack, state, value)`` gives the pack's ``(new state, part)``; returns the sum of the parts."""
        held = self.packs.context.broadcast(value)
        old, self.number = self.states, self.number + 1
        self.states = _one_by_one(self.packs.zip(old).map(lambda x: step(x[0], x[1][0], held.value))).persist(self.level)
        if self.number % KEEP_EVERY == 0:
            self.states.checkpoint()
        total = self.states.map(lambda x: x[1]).treeReduce(np.add)
        if old.is_cached:
            old.unpersist()
        return total

    def result(self, make: Callable, schema: str) -> DataFrame:
        """``make(pack, state)``, a tuple of ``schema``, of every pack."""
        rows = self.packs.zip(self.states).map(lambda x: make(x[0], x[1][0]))
        return rows.toDF(schema)

    def end(self) -> None:
        self.packs.unpersist()
        if self.states.is_cached:
            self.states.unpersist()
