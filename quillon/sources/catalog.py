"""A catalogue of data sets: a folder of Parquet tables and a log of numbered versions.

Each change is one small file, named by the next free version and written only if that doesn't exist yet. Where another writer was faster, the change is made again on
top of theirs, so two savers get two ids. (That holds where the file system creates files exclusively, as HDFS does; a local one leaves a moment between looking and writing.)
Every `COMPACT` versions one file sums up all before it. A damaged file is passed over and listed by `damaged()`: what it said is lost, all else stays; if nothing is readable, the catalogue is empty.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A version: entries that are added and ids that go; a summary has all entries that are there, and the largest id that went.
_ENTRY = "struct<id: bigint, name: string, columns: array<string>, row_count: bigint, uploaded_at: timestamp, path: string>"
VERSION = f"struct<added: array<{_ENTRY}>, gone: array<bigint>>"
COMPACT = 100


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _files(self) -> dict[int, list[str]]:
        """Names of the log's files by version."""
        folder = self._path(f"{self.root}/log")
        out: dict[int, list[str]] = {}
        if self._fs.exists(folder):
            for f in self._fs.listStatus(folder):
                if m := re.fullmatch(r"(\d{20})\.(json|summary)", f.getPath().getName()):
                    out.setdefault(int(m[1]), []).append(m[0])
        return out

    def _read(self, names: list[str]) -> DataFrame:
        """(version, summary, said): said is null where the file is damaged."""
        if not names:
            return self.spark.createDataFrame([], f"version bigint, summary boolean, said {VERSION}")
        text = self.spark.read.option("wholetext", True).text([f"{self.root}/log/{n}" for n in names])
        name = F.col("_metadata.file_name")
        said = F.from_json("value", VERSION, {"mode": "PERMISSIVE"})
        return text.select(F.substring(name, 1, 20).cast("bigint").alias("version"), name.endswith("summary").alias("summary"), F.when(said["added"].isNotNull() & said["gone"].isNotNull(), said).alias("said"))

    def _log(self) -> DataFrame:
        """The newest readable summary and the versions after it."""
        files = self._files()
        sums = [v for v, names in files.items() if any(n.endswith("summary") for n in names)]
        for at in [*sorted(sums, reverse=True), None]:
            names = [n for v, found in files.items() for n in found if (at is None or v > at or v == at and n.endswith("summary")) and (n.endswith("json") or v == at)]
            log = self._read(names)
            if at is None or not log.where("summary and said is null").head(1):
                return log
        raise AssertionError

    def damaged(self) -> list[str]:
        """Files of the log that can't be read."""
        names = sorted(n for found in self._files().values() for n in found)
        bad = self._read(names).where("said is null").select("version", "summary").collect()
        return sorted(f"{r['version']:020d}.{'summary' if r['summary'] else 'json'}" for r in bad)

    def _create(self, name: str, said: dict) -> bool:
        """Writes a file of the log unless it exists."""
        try:
            out = self._fs.create(self._path(f"{self.root}/log/{name}"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        try:
            out.write(bytearray(json.dumps(said), "utf-8"))
        finally:
            out.close()
        return True

    def _commit(self, said) -> int:
        """Adds a version. said: makes it from the largest id so far, anew if another writer was faster; returns its first id."""
        while True:
            version = max(self._files(), default=0) + 1
            most = self._log().select(F.array_max(F.concat("said.added.id", "said.gone")).alias("id")).agg(F.max("id")).first()[0] or 0
            now = said(most)
            if self._create(f"{version:020d}.json", now):
                if version % COMPACT == 0:
                    self._compact(version)
                return (now["added"] and now["added"][0]["id"]) or now["gone"][0]

    def _compact(self, version: int) -> None:
        rows = self.list().withColumn("uploaded_at", F.date_format("uploaded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).collect()
        gone = [r[0] for r in self._log().select(F.explode("said.gone")).agg(F.max("col")).collect() if r[0] is not None]  # the largest, so that no id comes again
        self._create(f"{version:020d}.summary", {"added": [r.asDict() for r in rows], "gone": gone})

    def list(self) -> DataFrame:
        """Data sets that haven't been deleted."""
        log = self._log().where("said is not null")
        return log.select(F.inline("said.added")).join(log.select(F.explode("said.gone").alias("id")), "id", "left_anti")

    def save(self, df: DataFrame, name: str) -> int:
        """Writes df and adds it to the catalogue; returns its id, the time in milliseconds, or the next one that is free."""
        now = time.time()
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(path)
        rows = self.spark.read.parquet(path).count()
        entry = {"name": name, "columns": df.columns, "row_count": rows, "uploaded_at": datetime.fromtimestamp(now, UTC).isoformat(), "path": path}
        return self._commit(lambda most: {"added": [{"id": max(int(now * 1000), most + 1)} | entry], "gone": []})

    def load(self, id_: int) -> DataFrame:
        found = self.list().where(F.col("id") == id_).select("path").first()
        if found is None:
            raise KeyError(id_)
        return self.spark.read.parquet(found["path"])

    def delete(self, id_: int) -> None:
        self._commit(lambda most: {"added": [], "gone": [id_]})
