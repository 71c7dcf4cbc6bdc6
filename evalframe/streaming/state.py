"""Keyed state of a stream as a table that stays as small as its keys.

Rows lie in buckets. A batch rewrites the buckets it touches below its own number, then writes
a commit: which batch holds the current rows of each bucket, and a few values of the stream.
The commit is the only pointer, so a batch that died halfway left nothing that is read, and a
batch that runs again starts from the commit before it and writes the same folders. Folders that
neither of the two newest commits name are removed.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
#: Name of the bucket column of rows that are written.
BUCKET = "bucket"


@dataclass(frozen=True)
class Commit:
    """What is current after a batch: the batch that wrote each bucket, and the stream's values."""

    batch: int = -1
    written: dict[str, int] = field(default_factory=dict)
    values: dict[str, int | None] = field(default_factory=dict)


def hashed(keys: Sequence[str], buckets: int = BUCKETS):
    """Bucket of a row by the hash of its keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string").alias(BUCKET)


class StateTable:
    """One folder of buckets and commits, shared by driver and executors."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._at("").getFileSystem(conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        if not self._files.exists(at):
            return []
        return [status.getPath().getName() for status in self._files.listStatus(at)]

    def _commits(self) -> list[int]:
        return sorted(int(name.removesuffix(".json")) for name in self._names("commits") if name.endswith(".json") and name[0] != ".")

    def commit(self, before: int | None = None) -> Commit:
        """The newest commit, or the newest one of a batch below ``before``."""
        known = [batch for batch in self._commits() if before is None or batch < before]
        if not known:
            return Commit()
        stream = self._files.open(self._at(f"commits/{known[-1]}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        told = json.loads(text)
        return Commit(known[-1], told["written"], told["values"])

    def rows(self, commit: Commit, schema: StructType, buckets: Sequence[str] | None = None) -> DataFrame:
        """Current rows of the given buckets, or of all."""
        paths = [
            f"{self.path}/rows/batch={batch}/{BUCKET}={bucket}"
            for bucket, batch in commit.written.items() if buckets is None or bucket in buckets
        ]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def write(self, batch: int, rows: DataFrame, touched: Sequence[str], values: dict[str, int | None]) -> None:
        """Replace the touched buckets by ``rows``, commit, and remove what no commit needs.

        ``rows`` hold the bucket column and are all that is left of the touched buckets.
        """
        before = self.commit(batch)
        folder = f"rows/batch={batch}"
        rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        filled = {name.partition("=")[2] for name in self._names(folder) if name.startswith(f"{BUCKET}=")}
        current = {bucket: at for bucket, at in before.written.items() if bucket not in touched} | dict.fromkeys(sorted(filled), batch)
        out = self._files.create(self._at(f"commits/{batch}.json"), True)
        try:
            out.write(bytearray(json.dumps({"written": current, "values": values}).encode()))
        finally:
            out.close()
        self._remove_old(batch, [before.written, current], before.batch)

    def _remove_old(self, batch: int, needed: list[dict[str, int]], previous: int) -> None:
        named = {(at, bucket) for commit in needed for bucket, at in commit.items()}
        for folder in self._names("rows"):
            at = int(folder.partition("=")[2])
            buckets = [name.partition("=")[2] for name in self._names(f"rows/{folder}") if name.startswith(f"{BUCKET}=")]
            left = [bucket for bucket in buckets if (at, bucket) in named]
            if not left and at != batch:
                self._files.delete(self._at(f"rows/{folder}"), True)
                continue
            for bucket in set(buckets) - set(left):
                self._files.delete(self._at(f"rows/{folder}/{BUCKET}={bucket}"), True)
        for at in self._commits():
            if at < previous:
                self._files.delete(self._at(f"commits/{at}.json"), False)


def buckets_of(rows: DataFrame) -> list[str]:
    """The buckets that occur in ``rows``, which has the bucket column."""
    return [r[0] for r in rows.select(BUCKET).distinct().collect()]
