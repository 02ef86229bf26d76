"""Exact clip evidence as a stream: the names of a site's reads are its state.

Spark keeps the state in its RocksDB store (``spark.sql.streaming.stateStore.providerClass``
must name it), so a query that is stopped or loses executors goes on from its
checkpoint with the same counts.  A site's names are dealt over ``shards`` groups by
their hash; each group counts its own names exactly, so a site with a large share
of all reads is that many tasks, and its count is the sum of its groups' last rows.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..params import FindFlanks
from ..plans.flanks import SITE, clips

KEYS = [*SITE, "orient", "shard"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Names(StatefulProcessor):
    """Distinct names and rows of one group; with ``keep_ms`` the group closes so long after its last event."""

    def __init__(self, event: str | None, keep_ms: int):
        self.event, self.keep_ms = event, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = handle.getMapState("names", "name string", "n long")
        self.totals = handle.getValueState("totals", "names long, reads long, last_ms long")

    def _row(self, key, names: int, reads: int, closed: bool) -> pd.DataFrame:
        return pd.DataFrame([(*key, names, reads, closed)], columns=[*KEYS, "softclip_count", "reads", "closed"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (the names of Spark's interface)
        held = self.totals.get() if self.totals.exists() else (0, 0, -1)
        names, reads, last = int(held[0]), int(held[1]), int(held[2])
        for part in rows:
            for name, n in part["read_name"].value_counts().items():
                before = self.names.getValue((name,))[0] if self.names.containsKey((name,)) else 0
                names += not before
                self.names.updateValue((name,), (int(before + n),))
                reads += int(n)
            if self.event:
                last = max(last, int(part[self.event].max().timestamp() * 1000))
        self.totals.update((names, reads, last))
        if self.event:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.keep_ms)
        yield self._row(key, names, reads, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names, reads, _ = self.totals.get()
        self.names.clear()
        self.totals.clear()
        yield self._row(key, int(names), int(reads), True)

    def close(self) -> None:
        pass


def exact_site_counts(alignments: DataFrame, p: FindFlanks = FindFlanks(), shards: int = 1, event: str | None = None, delay: str = "10 minutes", keep: datetime.timedelta = datetime.timedelta(hours=1)) -> DataFrame:
    """(sample, contig, pos, orient, shard, softclip_count, reads, closed) for update output: a row of each group whenever it grows.

    ``softclip_count`` is the number of distinct read names so far, exactly as the batch
    plan has it; null names count as the empty one.  With ``event``, a timestamp column
    of ``alignments``, rows later than ``delay`` are left out, and a group is
    closed, its state given up, ``keep`` after its last event (``closed``); what
    comes for it then begins anew.  Without it state is kept for good.
    """
    rows = clips(alignments.withWatermark(event, delay), p, (event,)) if event else clips(alignments, p)
    name = F.coalesce("read_name", F.lit(""))
    rows = rows.select(*SITE, "orient", F.pmod(F.xxhash64(name), F.lit(shards)).cast("int").alias("shard"), name.alias("read_name"), *([event] if event else []))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in KEYS) + ", softclip_count long, reads long, closed boolean"
    return rows.groupBy(*KEYS).transformWithStateInPandas(_Names(event, int(keep.total_seconds() * 1000)), schema, "Update", "EventTime" if event else "None")


def latest_counts(updates: DataFrame, batch: str = "batch") -> DataFrame:
    """(sample, contig, pos, orient, softclip_count, reads): each site's counts from written update rows, with the number of their batch."""
    last = updates.groupBy(*KEYS).agg(F.max_by(F.struct("softclip_count", "reads"), batch).alias("_l"))
    return last.groupBy(*SITE, "orient").agg(F.sum("_l.softclip_count").alias("softclip_count"), F.sum("_l.reads").alias("reads"))
