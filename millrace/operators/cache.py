"""Results that outlive a run: computed once, kept by key until they expire."""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.sources.stores import store


class ResultCache:
    """A table of results by key under a folder, a subfolder a run.

    A run's results are written beside the table and appear by one rename, so that a reader
    sees all of a run or nothing, and a run that fails leaves nothing (on stores without
    renames of folders that is only as good as theirs). The name of a subfolder tells when
    it expires: reading passes over those that have, without opening them, and ``sweep``
    removes them. Runs at the same time may compute a key twice; either result is taken.

    ``ttl`` in seconds; ``clock`` gives the time (tests turn it)."""

    def __init__(self, spark: SparkSession, path: str, ttl: float = 120.0, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.ttl, self.clock = spark, path.rstrip("/"), ttl, clock
        #: Rows that the last call computed, and distinct keys that it asked for.
        self.computed = self.asked = 0

    def _runs(self) -> list[tuple[str, float]]:
        from pyarrow.fs import FileSelector, FileType

        system, root = store(self.path)
        names = [i.base_name for i in system.get_file_info(FileSelector(root, allow_not_found=True)) if i.type == FileType.Directory]
        return sorted((n, int(n.split("-")[1]) / 1000) for n in names if n.startswith("until-"))

    def live(self, schema) -> DataFrame:
        """(_key, results) that have not expired, one row a key."""
        now = self.clock()
        folders = [f"{self.path}/{n}" for n, until in self._runs() if until > now]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders).dropDuplicates(["_key"])

    def sweep(self) -> int:
        """Remove expired runs, and what failed runs have left; how many went."""
        from pyarrow.fs import FileSelector

        system, root = store(self.path)
        now = self.clock()
        gone = [posixpath.join(root, n) for n, until in self._runs() if until <= now]
        gone += [i.path for i in system.get_file_info(FileSelector(posixpath.join(root, "_staged"), allow_not_found=True))]
        for folder in gone:
            system.delete_dir(folder)
        return len(gone)

    def apply(self, rows: DataFrame, key: Column, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows with what ``compute`` gives for their keys.

        ``compute`` gets one row of each key that the table lacks, with the key as ``_key``,
        and returns one row a key: ``_key`` and columns that the rows do not have. Rows of a
        null key get nulls and are not computed. A key with a third of all rows is computed
        once and joined as a skewed key."""
        keyed = rows.select("*", key.alias("_key"))
        shape = compute(keyed.where("false"))
        extra = [c for c in shape.columns if c not in keyed.columns]
        schema = shape.select("_key", *extra).schema
        known = self.live(schema)
        first = keyed.where("_key is not null").groupBy("_key").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("r"))
        met, new = Observation(), Observation()
        missing = first.observe(met, F.count(F.lit(1)).alias("n")).join(known.select("_key"), "_key", "left_anti").select("r.*", "_key")
        results = compute(missing).select("_key", *extra).observe(new, F.count(F.lit(1)).alias("n"))
        staged, name = f"{self.path}/_staged/{uuid.uuid4().hex}", f"until-{int((self.clock() + self.ttl) * 1000)}-{uuid.uuid4().hex}"
        results.write.parquet(staged)
        self.asked, self.computed = met.get["n"], new.get["n"]
        system, root = store(self.path)
        source = store(staged)[1]
        if self.computed:
            system.move(source, posixpath.join(root, name))
            added = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
            known = known.unionByName(added)
        else:
            system.delete_dir(source)
        return keyed.join(known, "_key", "left").drop("_key")
