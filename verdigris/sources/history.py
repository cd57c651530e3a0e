"""A score history in numbered versions, which writers that race or repeat themselves leave right.

Each entry is a file of its own, named by its version.  A writer reads the versions that there are, decides on what it
has read, writes its entry beside them and gives it the next number, which can be given only once: by a hard link on a
local disk, by a rename that does not overwrite elsewhere.  Who comes second reads again and decides anew.  An entry of a
run that is there already is not written again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import baselines
from .suites import HISTORY

#: Digits of a version in its file's name, and tries of one writer.
DIGITS, TRIES = 12, 100


class History:
    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.spark, self.path = spark, path
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        self._fs = self._path("versions").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def _names(self) -> list[str]:
        folder = self._path("versions")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def entries(self, upto: int | None = None) -> DataFrame:
        """The entries with their versions as ``position``, from 1; up to a version if one is named."""
        names = [n for n in self._names() if n.endswith(".json") and (upto is None or int(n[:DIGITS]) <= upto)]
        if not names:
            return self.spark.createDataFrame([], HISTORY + ", position bigint")
        rows = self.spark.read.schema(HISTORY).json(f"{self.path}/versions")
        rows = rows.withColumn("position", F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long"))
        return rows if upto is None else rows.where(F.col("position") <= upto)

    def version(self) -> int:
        names = [n for n in self._names() if n.endswith(".json")]
        return int(names[-1][:DIGITS]) if names else 0

    def _claim(self, version: int, text: str) -> bool:
        """Whether this writer's entry has become the version."""
        name, draft = self._path(f"versions/{version:0{DIGITS}d}.json"), self._path(f"drafts/{uuid.uuid4()}.json")
        self._fs.mkdirs(name.getParent())
        out = self._fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                try:
                    self._jvm.java.nio.file.Files.createLink(local(name), local(draft))
                    return True
                except Exception as e:
                    if "FileAlreadyExists" in str(e):
                        return False
                    raise
            return self._fs.rename(draft, name)
        finally:
            self._fs.delete(draft, False)

    def append(self, entry: dict, wanted: Callable[[Row | None], bool] = lambda last: True) -> int | None:
        """The version that the entry has become; None if ``wanted``, which gets the latest entry, did not want it, or if
        the run (``run_id``) has an entry."""
        for _ in range(TRIES):
            seen = self.version()
            rows = self.entries(seen)
            if entry.get("run_id") is not None and not rows.where(F.col("run_id") == entry["run_id"]).isEmpty():
                return None
            if not wanted(baselines.latest(rows).first()):
                return None
            if self._claim(seen + 1, json.dumps(entry)):
                return seen + 1
        raise RuntimeError(f"no version of {self.path} was free in {TRIES} tries")

    def append_if_improved(self, entry: dict, threshold: float = 0.0) -> int | None:
        """Appends the first entry, and then those whose score is above the latest by more than the threshold."""
        return self.append(entry, lambda last: last is None or last["score"] is None or entry["score"] - last["score"] > threshold)
