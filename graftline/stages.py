"""Stages that are computed once.

A stage is known by a key: a digest of its name, its parameters and the keys of what
it is made from, down to the names, sizes and times of the input files.  Its table lies in a
folder of that key, which counts only when Spark has committed it; so a run that was
broken off goes on where it stopped, a second run computes nothing, and a changed
parameter or file computes anew just what depends on it.
"""

from __future__ import annotations

import hashlib
import json
import logging
import time
from collections.abc import Callable
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("graftline")

#: Part of every key; a new number makes all stages of older code count for nothing.
VERSION = 1


class Stages:
    """The stages in one folder of any store that Spark reaches; ``computed`` and ``found`` name what this run did."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.computed: list[str] = []
        self.found: list[str] = []

    def _at(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def files_key(self, *paths: str) -> str:
        """A digest of the names, sizes and times of files, and of all files in folders."""
        rows = []
        for path in paths:
            fs, place = self._at(path)
            todo = [fs.getFileStatus(place)]
            while todo:
                status = todo.pop()
                if status.isDirectory():
                    todo += list(fs.listStatus(status.getPath()))
                else:
                    rows.append([status.getPath().toString(), status.getLen(), status.getModificationTime()])
        return hashlib.sha256(json.dumps(sorted(rows)).encode()).hexdigest()

    def key(self, name: str, after: list[str], params: object = None) -> str:
        own = asdict(params) if is_dataclass(params) else params
        return hashlib.sha256(json.dumps([VERSION, name, after, own], sort_keys=True).encode()).hexdigest()[:24]

    def done(self, name: str, key: str) -> bool:
        fs, place = self._at(f"{self.folder}/{name}/{key}/_SUCCESS")
        return fs.exists(place)

    def table(self, name: str, key: str, build: Callable[[], DataFrame], facts: dict | None = None) -> DataFrame:
        """The stage's table: read if it is there, else built and written, with its manifest; tables of its other keys go then."""
        path = f"{self.folder}/{name}/{key}"
        if self.done(name, key):
            self.found.append(name)
        else:
            began, seen = time.perf_counter(), Observation()
            build().observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("compression", "zstd").parquet(path)
            rows, took = seen.get["rows"], time.perf_counter() - began
            log.info("%s: %d rows in %.1f s", name, rows, took)
            self._write(f"{path}/_manifest.json", {"stage": name, "key": key, "rows": rows, "seconds": round(took, 3), **(facts or {})})
            self._only(name, key)
            self.computed.append(name)
        return self.spark.read.parquet(path)

    def once(self, name: str, key: str, act: Callable[[], None]) -> None:
        """Do something that leaves its result elsewhere, unless it was done under this key."""
        if self.done(name, key):
            self.found.append(name)
            return
        act()
        self._write(f"{self.folder}/{name}/{key}/_SUCCESS", {})
        self._only(name, key)
        self.computed.append(name)

    def _write(self, path: str, content: dict) -> None:
        fs, place = self._at(path)
        out = fs.create(place, True)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()

    def _only(self, name: str, key: str) -> None:
        fs, place = self._at(f"{self.folder}/{name}")
        for status in fs.listStatus(place):
            if status.getPath().getName() != key:
                fs.delete(status.getPath(), True)
