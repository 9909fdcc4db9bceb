"""The insights store: keyed upserts, lookups, deletes and appended analyses.

The operators are plain DataFrame functions; ``StoreTable`` keeps a table in buckets of versioned Parquet folders,
so readers of the old version are not disturbed and a retried write replaces only its own version.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.functions import urls
from storelens.operators.ranking import first_per_key, limit_per_key
from storelens.operators.registry import operator
from storelens.session import stage

STAMPS = ("created_at", "updated_at")


def empty_to_null(df: DataFrame, name: str) -> Column:
    """Empty lists and maps become NULL."""
    kind = df.schema[name].dataType
    column = F.col(name)
    return F.when(F.size(column) > 0, column) if isinstance(kind, (T.ArrayType, T.MapType)) else column


@operator("upsert_insights")
def upsert_insights(
    current: DataFrame, batch: DataFrame, now: Column | None = None, *, key: str = "site", order=("updated_at",)
) -> DataFrame:
    """Current rows with the batch applied by key.

    Columns the batch has overwrite, also with NULL; columns it lacks keep their value.  ``created_at``
    stays, ``updated_at`` becomes ``now``.  Of several batch rows per key the last by ``order`` counts.
    """
    now = F.current_timestamp() if now is None else now
    order = [F.col(c).desc() for c in order if c in batch.columns]
    latest = first_per_key(batch, [key], order) if order else batch
    supplied = [c for c in latest.columns if c != key and c not in STAMPS]
    new = latest.select(key, *[empty_to_null(latest, c).alias(c) for c in supplied], F.lit(True).alias("_new"))
    n, c = new.alias("n"), current.withColumn("_old", F.lit(True)).alias("c")
    joined = c.join(n, key, "full_outer")
    is_new, is_old = F.col("n._new").isNotNull(), F.col("c._old").isNotNull()
    columns = [key, *[x for x in current.columns if x != key and x not in STAMPS]]
    columns += [x for x in supplied if x not in columns]

    def merged(name):
        if name not in supplied:
            return F.col(f"c.{name}").alias(name)
        if name not in current.columns:
            return F.col(f"n.{name}").alias(name)
        return F.when(is_new, F.col(f"n.{name}")).otherwise(F.col(f"c.{name}")).alias(name)

    created = F.when(is_old, F.col("c.created_at")).otherwise(now).alias("created_at")
    updated = F.when(is_new, now).otherwise(F.col("c.updated_at")).alias("updated_at")
    return joined.select(key, *[merged(x) for x in columns if x != key], created, updated)


@operator("lookup_insights")
def lookup_insights(store: DataFrame, site: str | DataFrame) -> DataFrame:
    """Records of one site (pushed down to the scan) or of a key table; missing lists and maps read as empty."""
    if isinstance(site, DataFrame):
        found = store.join(site.select("site"), "site", "left_semi")
    else:
        found = store.filter(F.col("site") == urls.site_of(F.lit(site)))
    filled = []
    for field in found.schema:
        column = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            column = F.coalesce(column, F.array().cast(field.dataType))
        elif isinstance(field.dataType, T.MapType):
            column = F.coalesce(column, F.create_map().cast(field.dataType))
        filled.append(column.alias(field.name))
    return found.select(*filled)


@operator("list_stores")
def list_stores(store: DataFrame) -> DataFrame:
    """The five listing columns of every store."""
    return store.select(F.xxhash64("site").alias("store_id"), "site", "brand_name", *STAMPS)


@operator("delete_insights")
def delete_insights(current: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, keys that were there)."""
    gone = keys.select("site").distinct()
    return current.join(gone, "site", "left_anti"), gone.join(current.select("site"), "site", "left_semi")


@operator("append_analysis")
def analysis_rows(analyses: DataFrame, now: Column | None = None) -> DataFrame:
    """Analysis rows to append, with missing fields filled and a hash id."""
    now = F.current_timestamp() if now is None else now
    defaults = {
        "original_brand": F.lit(""), "original_url": F.lit(""),
        "competitors_found": F.lit(0).cast("bigint"), "competitors_analyzed": F.lit(0).cast("bigint"),
    }
    out = analyses
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in analyses.columns else value)
    out = out.withColumn("created_at", now).withColumn("updated_at", now)
    return out.withColumn("analysis_id", F.xxhash64("site", F.unix_micros("created_at")))


@operator("lookup_analysis")
def lookup_analysis(analyses: DataFrame, site: str | None = None) -> DataFrame:
    """The latest analysis per site, or of one site."""
    found = analyses if site is None else analyses.filter(F.col("site") == urls.site_of(F.lit(site)))
    return limit_per_key(found, ["site"], [F.col("created_at").desc(), F.col("analysis_id").desc()], 1)


def to_text_columns(df: DataFrame) -> DataFrame:
    """Lists, maps and structs as JSON text, for a relational sink."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    )


def from_text_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The typed form of ``to_text_columns`` output."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[F.from_json(f.name, f.dataType).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
          for f in schema]
    )


def complete_folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers n of the folders ``name=n`` below a path whose write has finished."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    folders = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith(f"{name}=")]
    done = [p for p in folders if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def by_bucket(rows: DataFrame) -> DataFrame:
    """Rows brought together by ``bucket`` for a partitioned write; adaptive execution joins small buckets and splits large ones."""
    return rows.sparkSession.sql("SELECT /*+ REBALANCE(bucket) */ * FROM {rows}", rows=rows)


class AnalysisLog:
    """Appended rows as Parquet folders ``run=NAME``, one per job; repeating a job rewrites only its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, rows: DataFrame, run: str) -> DataFrame:
        """Write the rows of a run and return them as written."""
        folder = f"{self.path}/run={run}"
        rows.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def append_once(self, run: str, rows) -> DataFrame:
        """The rows of a run: as they were written if it is complete, else ``rows()``, written now."""
        folder = f"{self.path}/run={run}"
        done = self.spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
        if done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            return self.spark.read.parquet(folder)
        return self.append(rows(), run)

    def read(self) -> DataFrame:
        """All rows appended so far."""
        return self.spark.read.option("basePath", self.path).parquet(self.path).drop("run")


class Versions:
    """Whole tables as Parquet folders ``version=N``; the highest complete one is current."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        return complete_folders(self.spark, self.path, "version")

    def folder(self, version: int) -> str:
        return f"{self.path}/version={version:020d}"

    def write(self, rows: DataFrame, version: int, *, partition_by: tuple = ()) -> int:
        rows.write.mode("overwrite").partitionBy(*partition_by).parquet(self.folder(version))
        return version


class StoreTable(Versions):
    """A keyed table in hash buckets: a version rewrites the buckets it touches and points to earlier ones for the others.

    Folder ``version=N`` holds the rewritten buckets and a manifest that names, for every bucket with rows, the version whose
    folder has them, and the table's schema. A version exists once its manifest does, so a writer that
    is lost leaves nothing behind that readers see, and one that is repeated replaces only its own folder. The newest ``keep``
    versions can be read; bucket folders that none of them names are removed after a write.
    """

    MANIFEST = "_manifest.json"

    def __init__(self, spark: SparkSession, path: str, *, key: str = "site", buckets: int = 256, keep: int = 3):
        super().__init__(spark, path)
        self.key, self.buckets, self.keep = key, buckets, max(keep, 1)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path(self.path))]
        found = (int(n.split("=")[1]) for n in names if n.startswith("version="))
        return sorted(v for v in found if fs.exists(self._path(f"{self.folder(v)}/{self.MANIFEST}")))

    def manifest(self, version: int) -> dict:
        stream = self._fs().open(self._path(f"{self.folder(version)}/{self.MANIFEST}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _before(self, version: int | None) -> dict | None:
        known = [v for v in self.versions() if version is None or v < version]
        return self.manifest(known[-1]) if known else None

    def _rows(self, manifest: dict, buckets=None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        names = [b for b in manifest["buckets"] if buckets is None or int(b) in buckets]
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder(manifest['buckets'][b])}/bucket={b}" for b in names])

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, before: int | None = None) -> DataFrame | None:
        """Current rows, or those of the last version below ``before``; None when there is none."""
        manifest = self._before(before)
        return None if manifest is None else self._rows(manifest)

    def lookup(self, site: str) -> DataFrame | None:
        """Record of one key, read from its bucket only."""
        manifest = self._before(None)
        if manifest is None:
            return None
        own = self.spark.range(1).select(self.bucket(urls.site_of(F.lit(site)))).first()[0]
        return lookup_insights(self._rows(manifest, {own}), site)

    def _touched(self, keys: DataFrame) -> set[int]:
        return {r[0] for r in keys.select(self.bucket(F.col(self.key))).distinct().collect()}  # at most ``buckets`` values

    def _commit(self, rows: DataFrame, touched: set[int], base: dict | None, version: int) -> int:
        """Write the touched buckets' rows and the manifest, which makes them the version; clear what no kept version names."""
        fs, folder = self._fs(), self.folder(version)
        fs.delete(self._path(f"{folder}/{self.MANIFEST}"), False)  # a repeated write is not read half done
        by_bucket(rows.withColumn("bucket", self.bucket(F.col(self.key)))).write.mode("overwrite").partitionBy("bucket").parquet(folder)
        names = [s.getPath().getName() for s in fs.listStatus(self._path(folder))]
        held = {b: v for b, v in (base or {"buckets": {}})["buckets"].items() if int(b) not in touched}
        held |= {n.split("=")[1]: version for n in names if n.startswith("bucket=")}
        content = json.dumps({"schema": rows.schema.jsonValue(), "buckets": held})
        part, whole = self._path(f"{folder}/{self.MANIFEST}.part"), self._path(f"{folder}/{self.MANIFEST}")
        out = fs.create(part, True)
        out.write(content.encode())
        out.close()
        if not fs.rename(part, whole):
            raise OSError(f"could not name {whole.toString()}")
        self._clear()
        return version

    def _clear(self) -> None:
        fs, versions = self._fs(), self.versions()
        kept = [self.manifest(v) for v in versions[-self.keep :]]
        named = {(int(v), int(b)) for m in kept for b, v in m["buckets"].items()}
        for version in versions[: -self.keep]:
            folder = self._path(self.folder(version))
            fs.delete(self._path(f"{self.folder(version)}/{self.MANIFEST}"), False)
            self._drop_unnamed(folder, version, named)
        for status in fs.listStatus(self._path(self.path)):  # folders of versions that are no longer listed
            name = status.getPath().getName()
            number = int(name.split("=")[1]) if name.startswith("version=") else None
            if number is not None and number < versions[-1] and number not in versions[-self.keep :]:
                self._drop_unnamed(status.getPath(), number, named)

    def _drop_unnamed(self, folder, version: int, named: set) -> None:
        fs = self._fs()
        if not fs.exists(folder):
            return
        buckets = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("bucket=")]
        gone = [p for p in buckets if (version, int(p.getName().split("=")[1])) not in named]
        for path in gone:
            fs.delete(path, True)
        if len(gone) == len(buckets):
            fs.delete(folder, True)

    def upsert(self, batch: DataFrame, now: Column | None = None, *, version: int | None = None) -> int:
        """Apply a batch by key: only the buckets of its keys are read and written."""
        base = self._before(version)
        version = (self.versions() or [0])[-1] + 1 if version is None else version
        touched = self._touched(batch)
        if base is None:
            stamp = F.current_timestamp()
            current = batch.limit(0).withColumn("created_at", stamp).withColumn("updated_at", stamp)
        else:
            current = self._rows(base, touched)
        return self._commit(upsert_insights(current, batch, now, key=self.key), touched, base, version)

    def replace(self, rows: DataFrame, keys: DataFrame, *, version: int | None = None) -> int:
        """Make ``rows`` all that the keys have, for tables with any number of rows per key.

        A key without rows loses those it had; rows of other keys are not taken. Only the keys' buckets are read and written.
        """
        base = self._before(version)
        version = (self.versions() or [0])[-1] + 1 if version is None else version
        own = keys.select(self.key).distinct()
        touched, new = self._touched(own), rows.join(own, self.key, "left_semi")
        if base is not None:
            new = self._rows(base, touched).join(own, self.key, "left_anti").unionByName(new, allowMissingColumns=True)
        return self._commit(new, touched, base, version)

    def delete(self, keys: DataFrame) -> DataFrame | None:
        """Drop the keys' rows; returns the keys that were there. Only their buckets are read and written."""
        base = self._before(None)
        if base is None:
            return None
        touched = self._touched(keys)
        remaining, removed = delete_insights(self._rows(base, touched), keys)
        removed = stage(removed, "removed")  # its rows may be cleared with the old version
        self._commit(remaining, touched, base, self.versions()[-1] + 1)
        return removed
