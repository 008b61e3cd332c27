"""Parquet tables whose changes show all at once: files of a change go to a folder of their own, one manifest names what holds.

A manifest is a small JSON file ``manifests/<version>.json`` that lists, for each partition, the folders with its
files.  A change writes new folders first and then renames its manifest into place, which a file system does whole
or not at all, and not where that version is there already: of two writers with one base the second gets a
``Conflict``.  A job that dies before the rename leaves folders that no manifest names, so readers see the old state
whole; ``expire`` removes them.  Readers take one manifest and are not disturbed by later changes.

What the driver holds is the list of partitions, whose number the caller chooses (hash buckets, days).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.proxy import Model, over
from ..plans.registry import query
from ..plans.shared import materialize, release, shared_dir
from .tables import _NEW, _OLD, _sides, merged

_AT = "_at"


class Conflict(Exception):
    """Another change was published on the same base."""


class Snapshots:
    """A table of ``schema`` at ``path``, partitioned by the value of ``partition`` (as text), versions from 1; version 0 is empty."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, partition: Column):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _file(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    @property
    def _files(self):
        return self._file().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, *parts: str) -> list[str]:
        """Names in a folder; none where it isn't there."""
        folder = self._file(*parts)
        return [s.getPath().getName() for s in self._files.listStatus(folder)] if self._files.exists(folder) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default of the latest."""
        known = self.versions()
        version = version if version is not None else max(known, default=0)
        if version == 0:
            return {"version": 0, "parts": {}, "batches": {}}
        if version not in known:
            raise ValueError(f"no version {version} at {self.path}")
        stream = self._files.open(self._file("manifests", f"{version:020}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, parts: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, or of some partitions of it: only their files are listed and read."""
        held = self.manifest(version)["parts"]
        wanted = held if parts is None else [p for p in dict.fromkeys(parts) if p in held]
        folders = [f"{self.path}/data/{folder}/{_AT}={p}" for p in wanted for folder in held[p]]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def parts_of(self, df: DataFrame) -> list[str]:
        """The partitions that rows fall in; no more than the table's partitions come to the driver."""
        return [r[0] for r in df.select(self.partition.cast("string").alias(_AT)).distinct().collect()]

    def commit(self, df: DataFrame | None, base: dict | None = None, append: bool = False, drop: Iterable[str] = (), batch: tuple[str, int] | None = None) -> int:
        """Publish a version: the partitions of ``df`` replaced (or added to), those in ``drop`` gone.  Gives its number.

        ``base`` is the manifest that ``df`` was made from, by default the latest; ``batch`` is a writer's name and
        the number of its batch: one that was published already changes nothing.
        """
        base = self.manifest() if base is None else base
        if batch and base["batches"].get(batch[0], -1) >= batch[1]:
            return base["version"]
        held = {p: folders for p, folders in base["parts"].items() if p not in set(drop)}
        if df is not None:
            folder = uuid.uuid4().hex
            placed = df.select(*self.schema.fieldNames(), self.partition.cast("string").alias(_AT))
            placed.write.partitionBy(_AT).option("compression", "zstd").parquet(f"{self.path}/data/{folder}")
            for name in self._names("data", folder):
                if name.startswith(f"{_AT}="):
                    part = name[len(_AT) + 1 :]
                    held[part] = [*(held.get(part, []) if append else []), folder]
        version = base["version"] + 1
        self._publish({"version": version, "parts": held, "batches": base["batches"] | ({batch[0]: batch[1]} if batch else {})})
        return version

    def _publish(self, manifest: dict) -> None:
        """Write a manifest beside the others, then rename it into place unless that version is there."""
        jvm, files = self.spark._jvm, self._files
        draft, final = self._file("manifests", f".{uuid.uuid4().hex}"), self._file("manifests", f"{manifest['version']:020}.json")
        out = files.create(draft, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        keep = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), files.getConf()).rename(draft, final, keep)
        except Exception as e:
            files.delete(draft, False)
            if files.exists(final):
                raise Conflict(f"version {manifest['version']} of {self.path} is there already") from e
            raise

    def upsert(self, new: DataFrame, keys: list[str], policy: dict[str, str] | None = None, order: str | None = None, batch: tuple[str, int] | None = None) -> int:
        """Publish ``new`` merged by key into the partitions that it falls in; the partition must follow from the key.

        ``policy`` says for each further column what a conflict keeps (see ``merged``; by default the new value), ``order``
        which of the new rows of one key is the latest (by default any).
        """
        base = self.manifest()
        if batch and base["batches"].get(batch[0], -1) >= batch[1]:
            return base["version"]
        rest = [c for c in self.schema.fieldNames() if c not in keys]
        rules = policy or {c: "new" for c in rest}
        if order:
            latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
            new = new.withColumn("_latest", latest).where("_latest = 1")
        else:
            new = new.dropDuplicates(keys)
        new = materialize(new.select(*keys, *rest), "new")
        version = self.commit(merged(self.read(self.parts_of(new), base["version"]), new, keys, rules), base, batch=batch)
        release(new)
        return version

    def expire(self, keep: int = 7) -> None:
        """Forget all versions but the latest ``keep``, and remove the folders that none of these names.  No writer may be at work."""
        known = self.versions()
        for version in known[:-keep]:
            self._files.delete(self._file("manifests", f"{version:020}.json"), False)
        named = {f for v in known[-keep:] for folders in self.manifest(v)["parts"].values() for f in folders}
        for folder in self._names("data"):
            if folder not in named:
                self._files.delete(self._file("data", folder), True)


def by_hash(keys: list[str], parts: int = 64) -> Column:
    """A partition that follows from the key: one of ``parts`` hash buckets."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def upsert_stream(stream: DataFrame, table: Callable[[SparkSession], Snapshots], keys: list[str], checkpoint: str, policy: dict[str, str] | None = None, order: str | None = None) -> StreamingQuery:
    """Every micro-batch is one version of the table.  A batch that runs again after a failure is published once:
    the manifest holds the number of the last one."""

    def store(batch: DataFrame, number: int) -> None:
        table(batch.sparkSession).upsert(batch, keys, policy, order, (checkpoint, number))

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@query("s06b_snapshot_upsert", over("articles", f"SELECT id, url, CASE WHEN {_NEW} THEN title || ' (updated)' ELSE title END AS title, CASE WHEN {_OLD} THEN source ELSE 'new' END AS source, CASE WHEN {_NEW} THEN 'new' ELSE 'old' END AS summary FROM articles WHERE {_OLD} OR {_NEW}"))
def s06b(m: Model) -> DataFrame:
    old, new = _sides(m)
    table = Snapshots(m.spark, f"{shared_dir(m.spark)}/articles", "url string, id long, title string, source string, summary string", by_hash(["url"], 16))
    table.upsert(old, ["url"])
    table.upsert(new, ["url"], {"id": "old", "title": "new", "source": "old", "summary": "new"})
    return table.read().select("id", "url", "title", "source", "summary")


@query("s06c_pinned_reader", over("articles", f"SELECT 'before' AS state, count(*) AS n FROM articles WHERE {_OLD} UNION ALL SELECT 'after', count(*) FROM articles WHERE {_OLD} OR {_NEW}"))
def s06c(m: Model) -> DataFrame:
    old, new = _sides(m)
    table = Snapshots(m.spark, f"{shared_dir(m.spark)}/articles", "url string, id long", by_hash(["url"], 16))
    first = table.upsert(old, ["url"])
    pinned = table.read(version=first)
    table.upsert(new, ["url"])
    n = F.count(F.lit(1)).alias("n")
    return pinned.agg(n).select(F.lit("before").alias("state"), "n").unionByName(table.read().agg(n).select(F.lit("after").alias("state"), "n"))
