"""A store of points (or any keyed rows): a log of delta files over Parquet, merged when read.

An upsert writes its own rows alone, dealt to buckets of a hash of the key, and a delete writes
keys. A commit log names the files that are live, in their order, so a reader sees whole
upserts, two writers cannot make one version, and files of a writer that was lost are
never read. A reader takes the last row of a key: keys of the deltas are few, so the base is
joined against them and never sorted. compact() makes one base of all.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from heliodor.storage import CommitLog, Folder

#: Deltas over which an upsert compacts.
MOST_DELTAS = 16


def collection_name(base: str, suffix: str | None = None) -> str:
    return f"{base}_{suffix}" if suffix else base


class PointStore:
    def __init__(self, spark: SparkSession, root: str, name: str, key: str = "id", buckets: int = 16):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.path = f"{root.rstrip('/')}/{name}"
        self.folder, self.log = Folder(spark, self.path), CommitLog(spark, self.path)

    # The collection

    def create(self, schema: StructType | str, dims: dict[str, int] | None = None) -> None:
        """An empty collection with fixed columns; dims: the length that each vector column's values must have."""
        if isinstance(schema, str):
            schema = self.spark.createDataFrame([], schema).schema
        if self.key not in schema.fieldNames():
            raise ValueError(f"no key {self.key} among the columns")
        self.log.commit({"schema": json.loads(schema.json()), "fixed": True, "dims": dims or {}, "key": self.key, "buckets": self.buckets, "files": [], "batches": {}}, -1)

    def exists(self) -> bool:
        return self.log.version() >= 0

    def schema(self) -> StructType:
        return StructType.fromJson(self.log.read()["schema"])

    def drop(self) -> None:
        self.folder.delete()

    # Writing

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _checked(self, rows: DataFrame, state: dict) -> tuple[DataFrame, StructType]:
        """The rows with the collection's columns and types, and its schema, with new columns where it is not fixed."""
        old = StructType.fromJson(state["schema"]) if state else StructType([])
        known = {f.name: f for f in old}
        new = [StructField(f.name, f.dataType, True) for f in rows.schema if f.name not in known]
        if state.get("fixed") and new:
            raise ValueError(f"no columns {[f.name for f in new]} in {self.path}")
        for f in rows.schema:
            if f.name in known and f.dataType.simpleString() != known[f.name].dataType.simpleString():
                raise ValueError(f"{f.name} is {f.dataType.simpleString()}, not {known[f.name].dataType.simpleString()}")
        for name, n in state.get("dims", {}).items():
            if name in rows.columns:
                wrong = F.raise_error(F.concat(F.lit(f"{name} has not {n} numbers but "), F.size(name).cast("string")))
                rows = rows.withColumn(name, F.when(F.col(name).isNull() | (F.size(name) == n), F.col(name)).otherwise(wrong.cast(known[name].dataType)))
        schema = StructType([*old, *new])
        return rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema)), schema

    def _last(self, rows: DataFrame, order: str | None) -> DataFrame:
        """One row of each key: the greatest by the order, and of equals by a hash of the row, so that the choice is the same each time."""
        by = ([F.col(order).desc_nulls_last()] if order else []) + [F.xxhash64(F.to_json(F.struct(*rows.columns))).desc()]
        return rows.withColumn("__n", F.row_number().over(Window.partitionBy(self.key).orderBy(*by))).where("__n = 1").drop("__n")

    def _write(self, rows: DataFrame, buckets: int) -> str:
        name = f"data-{uuid.uuid4().hex}"
        rows.withColumn("__bucket", self._bucket(buckets)).repartition("__bucket").sortWithinPartitions("__bucket", self.key).write.partitionBy("__bucket").parquet(self.folder.at(name))
        return name

    def _commit(self, name: str, schema: StructType, batch: tuple[str, int] | None) -> bool:
        """Name a written delta in the log; False, and nothing is changed, if the batch was there before."""
        done = False

        def change(state: dict) -> dict | None:
            nonlocal done
            if batch and state.get("batches", {}).get(batch[0], -1) >= batch[1]:
                return None
            done = True
            state = state or {"fixed": False, "dims": {}, "key": self.key, "buckets": self.buckets, "files": [], "batches": {}}
            known = {f["name"] for f in state.get("schema", {"fields": []})["fields"]}
            fields = state.get("schema", {"fields": []})["fields"] + [f for f in json.loads(schema.json())["fields"] if f["name"] not in known]
            return state | {"schema": {"type": "struct", "fields": fields}, "files": [*state["files"], name], "batches": state["batches"] | ({batch[0]: batch[1]} if batch else {})}

        self.log.update(change)
        if not done:
            self.folder.delete(name)
        return done

    def upsert(self, rows: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> bool:
        """Rows replace those with their key; of rows with one key the last by order holds. Rows without a key are left out.

        batch: a writer's name and its batch's number; a number that is not above the writer's last changes nothing (False)."""
        state = self.log.read()
        if batch and state.get("batches", {}).get(batch[0], -1) >= batch[1]:
            return False
        rows, schema = self._checked(rows, state)
        rows = self._last(rows.where(F.col(self.key).isNotNull()), order)
        name = self._write(rows.withColumn("__deleted", F.lit(False)), state.get("buckets", self.buckets))
        done = self._commit(name, schema, batch)
        if done and len(self.log.read()["files"]) > MOST_DELTAS:
            self.compact()
        return done

    def append_new(self, rows: DataFrame) -> DataFrame:
        """Only rows whose key is absent; returns them as stored."""
        self.upsert(self.missing(rows))
        return self.read().join(rows.select(self.key).distinct(), self.key, "left_semi")

    def delete(self, ids: DataFrame | None = None, where: Column | None = None) -> None:
        """Delete the rows with these keys, and those that the condition holds for."""
        state = self.log.read()
        gone = None if ids is None else ids.select(self.key).distinct()
        if where is not None:
            met = self.read().where(where).select(self.key)
            gone = met if gone is None else gone.unionByName(met).distinct()
        if gone is None:
            return
        schema = StructType.fromJson(state["schema"])
        rows = gone.where(F.col(self.key).isNotNull()).select(*(F.col(f.name) if f.name == self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
        self._commit(self._write(rows.withColumn("__deleted", F.lit(True)), state["buckets"]), schema, None)

    def compact(self) -> None:
        """One base in place of all files. Deltas that are added meanwhile stay; if another writer compacts first, nothing is changed."""
        version = self.log.version()
        state = self.log.read(version)
        merged = state.get("files", [])
        if len(merged) < 2:
            return
        name = self._write(self.read(version).withColumn("__deleted", F.lit(False)), state["buckets"])
        done = False

        def change(now: dict) -> dict | None:
            nonlocal done
            if now["files"][: len(merged)] != merged:
                return None
            done = True
            return now | {"files": [name, *now["files"][len(merged) :]]}

        self.log.update(change)
        if not done:
            self.folder.delete(name)

    def vacuum(self, seconds: float = 3600, versions: int = 2) -> None:
        """Delete files that none of the last versions names and that are older; writers that are at work have younger ones."""
        last = self.log.version()
        kept = {f for v in range(max(0, last - versions + 1), last + 1) for f in self.log.read(v)["files"]}
        for name in self.folder.names():
            if name.startswith("data-") and name not in kept and self.folder.modified(name) <= time.time() - seconds:
                self.folder.delete(name)

    # Reading

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The live rows, of the last version or an earlier one; buckets: those of some keys' hashes alone."""
        state = self.log.read(version)
        if not state:
            raise ValueError(f"no collection at {self.path}")
        schema = StructType.fromJson(state["schema"])
        stored = StructType([*schema, StructField("__deleted", BooleanType()), StructField("__bucket", IntegerType())])
        files = []
        for nth, name in enumerate(state["files"]):
            part = self.spark.read.schema(stored).parquet(self.folder.at(name)).withColumn("__nth", F.lit(nth))
            files.append(part if buckets is None else part.where(F.col("__bucket").isin(buckets)))
        if not files:
            return self.spark.createDataFrame([], schema)
        base, deltas = files[0].drop("__bucket"), files[1:]
        if not deltas:
            return base.where("NOT __deleted").select(*schema.fieldNames())
        every = deltas[0]
        for more in deltas[1:]:
            every = every.unionByName(more)
        every = every.drop("__bucket")
        if len(deltas) > 1:
            last = Window.partitionBy(self.key).orderBy(F.col("__nth").desc())
            every = every.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
        old = base.join(every.select(self.key), self.key, "left_anti")
        return old.unionByName(every).where("NOT __deleted").select(*schema.fieldNames())

    def _near(self, ids: DataFrame) -> DataFrame:
        """The store's keys in the buckets that the ids fall into."""
        n = self.log.read()["buckets"]
        wanted = [r[0] for r in ids.select(self._bucket(n).alias("b")).distinct().collect()]  # as many as there are buckets, at most
        return self.read(buckets=wanted).select(self.key)

    def existing(self, ids: DataFrame) -> DataFrame:
        return ids.join(self._near(ids), self.key, "left_semi") if self.exists() else ids.where(F.lit(False))

    def missing(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._near(rows), self.key, "left_anti") if self.exists() else rows

    def scroll(self, where: Column, limit: int = 100, order: str | None = None) -> DataFrame:
        """The first rows that the condition holds for, by order and then key."""
        return self.read().where(where).orderBy(*([order] if order else []), self.key).limit(limit)


def upsert_rows(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The upsert as one expression: rows of `new`, last by order, over those of `old`."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col("__new").desc(), F.col(order).desc())
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")
