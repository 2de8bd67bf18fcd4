"""Secrets in texts, by an incremental ledger of blobs.

A blob is a distinct text, named by its SHA-256. The ledger holds which (blob, rule version) pairs have been scanned and
what was found. A scan hashes all rows, drops pairs that the ledger has, scans one row for each blob that is left and
appends to the ledger; findings are then joined back to every path. Rows with equal texts are scanned once, however
many there are; findings are narrow, so a text that a third of all rows share is one row on one side of a join.

Runs that update one ledger at the same time may scan a blob twice; its findings are read once.

A null text is the empty blob and has no findings. Repeated rows all get their findings. Offsets count code points, ends are exclusive.
Other columns are ignored. Empty input gives empty output.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.shared import scratch, table

#: Fixed patterns: the base kinds, and kinds added to them. (kind, pattern, group that must be long, its least length)
RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
    ("pem", re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"), 0, 0),
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 0),
    ("bearer", re.compile(r"[Bb]earer [A-Za-z0-9._~+/-]{20,}=*"), 0, 0),
)
BASE = ("assign", "access", "hex")
#: Changes whenever RULES does: findings of another version aren't used.
VERSION = "2"
#: Blobs or rows up to which a table of them is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 200_000

_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
FINDINGS = "array<struct<start:bigint,ord:int,stop:bigint,kind:string>>"


def scan(text: str) -> list[dict]:
    """All findings of a text, by start and then in the rules' order."""
    found = []
    for n, (kind, pattern, group, least) in enumerate(RULES):
        if kind == "assign" and not _KEYWORD.search(text) or kind == "access" and "AKIA" not in text or kind == "pem" and "-----BEGIN" not in text or kind == "jwt" and "eyJ" not in text or kind == "bearer" and "earer " not in text:
            continue
        found += [{"start": m.start(), "ord": n, "stop": m.end(), "kind": kind} for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda f: (f["start"], f["ord"]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("ord", pa.int32()), ("stop", pa.int64()), ("kind", pa.string())]))
    for batch in batches:
        yield pa.record_batch([batch.column("blob"), pa.array([scan(t) for t in batch.column("text").to_pylist()], kind)], names=["blob", "findings"])


class Ledger:
    """Parquet at a path: (blob, version, findings), one row for each pair that has been scanned."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "ledger")

    def read(self) -> DataFrame:
        schema = f"blob string, version string, findings {FINDINGS}"
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(self.path) if there else self.spark.createDataFrame([], schema)

    def findings(self) -> DataFrame:
        """(blob, findings) of this version's blobs that have any; runs at the same time may have written a blob twice."""
        return self.read().where((F.col("version") == VERSION) & (F.size("findings") > 0)).select("blob", "findings").dropDuplicates(["blob"])

    def update(self, rows: DataFrame, versions: DataFrame) -> None:
        """Scans what is new. rows: (path, text); versions: (path, blob) of the same rows, already written."""
        seen = self.read().where(F.col("version") == VERSION).select("blob")
        new = table(versions.groupBy("blob").agg(F.min("path").alias("path")).join(seen, "blob", "left_anti").select(F.col("blob").alias("new_blob"), F.col("path").alias("new_path")), "unseen")
        here = rows.select("path", blob(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        kept = unseen(here, versions, new)
        found = kept.select("blob", "text").mapInArrow(_scan, f"blob string, findings {FINDINGS}")
        hits = found.where(F.size("findings") > 0).dropDuplicates(["blob"])
        new.select(F.col("new_blob").alias("blob")).join(hits, "blob", "left").select("blob", F.lit(VERSION).alias("version"), F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings")).write.mode("append").parquet(self.path)


def unseen(here: DataFrame, versions: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of here (path, blob, text) that new (new_path, new_blob) has. Texts aren't shuffled where what is new is little, as in later runs, or what isn't, as in a
    first one; which is found from headers. A path may have many blobs, and be null: rows are told apart by both."""
    same = [F.col("path").eqNullSafe(F.col("new_path")), F.col("blob") == F.col("new_blob")]
    if new.count() <= BROADCAST_ROWS:
        return here.join(F.broadcast(new), same, "left_semi")
    spare = table(versions.join(new, same, "left_anti").select(F.col("blob").alias("spare_blob"), F.col("path").alias("spare")).distinct(), "spare")
    if spare.count() <= BROADCAST_ROWS:
        return here.join(F.broadcast(spare), F.col("path").eqNullSafe(F.col("spare")) & (F.col("blob") == F.col("spare_blob")), "left_anti")
    return here.join(new, same, "left_semi")


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def find_secrets(rows: DataFrame, ledger: Ledger, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob, findings) of every row, after bringing the ledger up to date."""
    rows = rows.select(F.col(path).alias("path"), F.col(text).alias("text"))
    versions = table(rows.select("path", blob(F.col("text")).alias("blob")), "versions")
    ledger.update(rows, versions)
    return versions.join(ledger.findings(), "blob", "left").select(F.col("path").alias(path), "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans."""
    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    only = lambda *k: F.filter("findings", lambda s: s["kind"].isin(*k))
    return found.select("doc_id", *(F.size(only(k)).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(listed(only(*BASE)), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))
