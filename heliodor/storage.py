"""What stored tables share: the folder that a cluster shares, files, and a log of commits."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names, or the warehouse.

    Only a session that runs in this process alone, as in tests, gets a temporary folder of this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        sc.setCheckpointDir(named or (tempfile.mkdtemp(prefix="heliodor-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_heliodor"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def source_mark(spark: SparkSession, path: str) -> str:
    """A digest of a path and of the names, sizes and times of its files: it changes when they do."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(where)]
    return hashlib.md5(repr((path, sorted(found))).encode()).hexdigest()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder: a cut that keeps columns prunable. by: a column whose values are read alone."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/heliodor-{name}-{uuid.uuid4().hex}"
    (df.repartition(by).write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path(self.path).getFileSystem(self._conf)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(self.at(name) if name else self.path))

    def names(self, name: str = "") -> list[str]:
        where = self._path(self.at(name) if name else self.path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def size(self, name: str = "") -> int:
        return self.fs.getContentSummary(self._path(self.at(name) if name else self.path)).getLength()

    def modified(self, name: str) -> float:
        """Seconds since 1970 at which a file or folder was changed."""
        return self.fs.getFileStatus(self._path(self.at(name))).getModificationTime() / 1000

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._path(self.at(name) if name else self.path), True)

    def read_text(self, name: str) -> str:
        stream = self.fs.open(self._path(self.at(name)))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create_text(self, name: str, text: str) -> bool:
        """Make a whole file, or none: False if the name is taken. Of several writers one alone gets True."""
        target, part = self.at(name), self.at(f"_{uuid.uuid4().hex}")
        out = self.fs.create(self._path(part), False)
        try:
            out.write(text.encode())
        finally:
            out.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                os.link(_local(part), _local(target))
            else:
                jvm = self.spark._jvm
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self._conf).rename(self._path(part), self._path(target), none)
        except Exception:
            if not self.exists(name):
                raise
            return False
        finally:
            self.fs.delete(self._path(part), False)
        return True


def _local(path: str) -> str:
    return urlparse(path).path if path.startswith("file:") else path


class Conflict(RuntimeError):
    """Another writer made the version that this one was about to make."""


class CommitLog:
    """Versions of a small state as numbered files, each made once: readers see whole versions, and of two writers one has to try again."""

    def __init__(self, spark: SparkSession, root: str):
        self.folder = Folder(spark, f"{root.rstrip('/')}/_log")

    def version(self) -> int:
        """The last version's number, -1 if there is none."""
        return max((int(n[:-5]) for n in self.folder.names() if n.endswith(".json") and n[:-5].isdigit()), default=-1)

    def read(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return json.loads(self.folder.read_text(f"{version:020d}.json")) if version >= 0 else {}

    def commit(self, state: dict, after: int) -> int:
        if not self.folder.create_text(f"{after + 1:020d}.json", json.dumps(state)):
            raise Conflict(f"version {after + 1} of {self.folder.path} is made already")
        return after + 1

    def update(self, change, tries: int = 20) -> dict:
        """Commit change(state), again on the newer state if another writer was first; change may return None to leave it."""
        for _ in range(tries):
            at = self.version()
            state = change(self.read(at))
            if state is None:
                return self.read(at)
            try:
                self.commit(state, at)
                return state
            except Conflict:
                continue
        raise Conflict(f"{tries} tries at {self.folder.path}")
