"""Points (series, ts_ms, value) stored by bucket of series and span of time, with compaction of what small writes leave.

A write is a folder of its own and counts once its `_SUCCESS` is there; files are cut by (bucket, span) and sorted by series
and time, so a scan opens only the spans it asks for and Parquet leaves out the row groups of other series. A compaction
writes those (bucket, span) parts anew that several writes have a share in, beside the old ones, and then a manifest of which
folder holds which part. The manifest is written last: a compaction that fails changes nothing, a reader sees either
all of it or none, and older versions can be read until `vacuum`. Any number may write and read at a time; one compacts.

All points stay, those of equal times and repeated ones too; of equal times the lesser value comes first, null before all.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Files

#: Milliseconds of a span, and buckets of series: a store must keep what it was begun with.
SPAN, BUCKETS = 86_400_000, 16
_POINTS = "series string, ts_ms long, value float"
_PARTS = "place string, bucket int, span long"
_ORDER = ("bucket", "span", "series", "ts_ms", "value")


class SeriesStore:
    def __init__(self, spark: SparkSession, path: str, span_ms: int = SPAN, buckets: int = BUCKETS):
        self.spark, self.path, self.span_ms, self.buckets = spark, path.rstrip("/"), span_ms, buckets

    def _bucket(self, series: Column) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(series), F.lit(self.buckets)), F.lit(0)).cast("int")

    def _span(self) -> Column:
        return F.expr(f"ts_ms div {self.span_ms}L - if(ts_ms % {self.span_ms}L < 0, 1L, 0L)")

    def _write(self, points: DataFrame, place: str) -> None:
        """A part larger than a task should write is split, so a series with most of the points is no task's alone."""
        points.hint("rebalance", "bucket", "span").sortWithinPartitions(*_ORDER).write.mode("overwrite").partitionBy("bucket", "span").parquet(f"{self.path}/parts/place={place}")

    def record(self, points: DataFrame) -> None:
        """Adds (series, ts_ms, value) rows; those without a time are left out. Durable when it returns."""
        own = points.select(F.col("series").cast("string").alias("series"), F.col("ts_ms").cast("long").alias("ts_ms"), F.col("value").cast("float").alias("value")).where("ts_ms is not null")
        self._write(own.withColumn("bucket", self._bucket(F.col("series"))).withColumn("span", self._span()), f"write-{uuid.uuid4().hex}")

    def versions(self) -> list[int]:
        files = Files(self.spark, self.path)
        return sorted(int(n) for n in files.names("versions") if files.exists(f"versions/{n}/_SUCCESS"))

    def _writes(self) -> list[str]:
        """The writes that are complete."""
        files = Files(self.spark, self.path)
        return sorted(n.split("=", 1)[1] for n in files.names("parts") if n.startswith("place=write-") and files.exists(f"parts/{n}/_SUCCESS"))

    def _manifest(self, version: int | None) -> tuple[DataFrame, list[str]]:
        """The (place, bucket, span) parts that a version knows, and the writes it has not seen."""
        versions = self.versions()
        version = versions[-1] if version is None and versions else version
        there = self._writes()
        if version is None:
            return self.spark.createDataFrame([], _PARTS), there
        rows = self.spark.read.schema(_PARTS).parquet(f"{self.path}/versions/{version}")
        seen = {r.place for r in rows.where("bucket is null").select("place").collect()}  # as many as writes that are there
        return rows.where("bucket is not null"), [place for place in there if place not in seen]

    def _read(self, places: list[str]) -> DataFrame:
        """(series, ts_ms, value, place, bucket, span) of whole places."""
        if not places:
            return self.spark.createDataFrame([], f"{_POINTS}, {_PARTS}")
        return self.spark.read.schema(f"{_POINTS}, {_PARTS}").option("basePath", f"{self.path}/parts").parquet(*(f"{self.path}/parts/place={p}" for p in places))

    def points(self, series: Sequence[str], start_ms: int, end_ms: int, version: int | None = None) -> DataFrame:
        """(series, ts_ms, value) with both ends included; of an older version, only what that version had seen."""
        parts, fresh = self._manifest(version)
        fresh = fresh if version is None else []
        if not series:
            return self.spark.createDataFrame([], _POINTS)
        asked = reduce(Column.__or__, (F.col("bucket") == self._bucket(F.lit(s)) for s in series)) & F.col("span").between(start_ms // self.span_ms, end_ms // self.span_ms)
        # One row for each folder that the scan opens.
        paths = [f"{self.path}/parts/place={r.place}/bucket={r.bucket}/span={r.span}" for r in parts.where(asked).distinct().collect()]
        known = self.spark.read.schema(_POINTS).parquet(*paths) if paths else self.spark.createDataFrame([], _POINTS)
        new = self._read(fresh).where(asked).select("series", "ts_ms", "value")
        return (known.union(new) if fresh else known).where(F.col("series").isin(list(series)) & F.col("ts_ms").between(start_ms, end_ms))

    def scan(self, series: str, start_ms: int, end_ms: int, version: int | None = None) -> DataFrame:
        """(ts_ms, value) of one series in time order."""
        return self.points([series], start_ms, end_ms, version).select("ts_ms", "value").orderBy("ts_ms", "value")

    def compact(self, least: int = 2) -> int:
        """Makes one part of each (bucket, span) that `least` folders or more share; returns the new version.

        Writes that come meanwhile wait for the next compaction and are read as they are.
        """
        versions = self.versions()
        version = max(versions, default=0) + 1
        known, fresh = self._manifest(versions[-1] if versions else None)
        merged, part = f"merged-{version}", ["bucket", "span"]
        live = known.union(self._read(fresh).select("place", *part).distinct())
        several = live.groupBy(*part).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*part)
        places = sorted(r.place for r in live.join(several, part, "left_semi").select("place").distinct().collect())
        if places:
            # Parts of these places that are not live any more have been merged before.
            held = self._read(places).join(live.join(several, part, "left_semi"), ["place", *part], "left_semi")
            self._write(held.select("series", "ts_ms", "value", *part), merged)
        seen = self.spark.createDataFrame([(p, None, None) for p in self._seen(versions) + fresh], _PARTS)
        kept = live.join(several, part, "left_anti").select("place", *part)
        rows = kept.union(several.select(F.lit(merged).alias("place"), *part)).union(seen)
        rows.repartitionByRange("bucket", "span").sortWithinPartitions(*part).write.mode("overwrite").parquet(f"{self.path}/versions/{version}")
        return version

    def _seen(self, versions: list[int]) -> list[str]:
        """The writes that the last version has seen and that are still there."""
        return sorted(set(self._writes()) - set(self._manifest(versions[-1])[1])) if versions else []

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes what only versions before the last `keep` read, and those versions; returns the folders."""
        versions, files = self.versions(), Files(self.spark, self.path)
        if not versions:
            return []
        kept = versions[-keep:]
        read = {r.place for v in kept for r in self._manifest(v)[0].select("place").distinct().collect()}
        merged = [n.split("=", 1)[1] for n in files.names("parts") if n.startswith("place=merged-")]
        mine = [*self._seen(versions), *(n for n in merged if int(n.split("-")[1]) <= versions[-1])]
        gone = [f"parts/place={p}" for p in mine if p not in read] + [f"versions/{v}" for v in versions if v not in kept]
        for place in sorted(gone, key=lambda p: not p.startswith("versions/")):  # no version names a folder that has gone
            files.delete(place)
        return gone
