"""Files a run reads and keeps: lists of books, plans, caches, manifests, settings."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLAN = "document string, idx int, before string, after string"
CACHE = "key string, value string"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one in local mode where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioflow-"))
        found = spark.sparkContext.getCheckpointDir()
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to path to its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def kept(spark: SparkSession, make: Callable[[], DataFrame], path: str | None = None) -> DataFrame:
    """The table at path; where none was written to its end, what make gives is, once. Without a path it goes to the shared folder."""
    path = path or shared_path(spark, "kept")
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def book_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """ord, path and content of a folder's own files of a kind; ord is the order of names without case. Folders inside aren't opened.

    Only names are sorted: contents are read after, where they are.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)
    order = Window.orderBy(F.lower(F.element_at(F.split("path", "/"), -1)), "path")
    names = files.select("path").withColumn("ord", F.row_number().over(order) - 1)
    return files.select("path", "content").join(names, "path").select("ord", "path", "content")


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """Changes as JSON lines; a null or missing after deletes."""
    return spark.read.schema(PLAN).json(path)


def write_plan(plan: DataFrame, path: str) -> None:
    """One ordered part for each range of documents; a plan that is there is not overwritten."""
    plan.repartitionByRange("document").sortWithinPartitions("document", "idx").write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached answers; unreadable lines and a missing file are misses."""
    try:
        return spark.read.schema(CACHE).option("mode", "PERMISSIVE").json(path).where("key is not null and value is not null")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE)


def add_to_cache(new: DataFrame, path: str) -> None:
    """Appends one value for each key that the cache doesn't have; of several the smallest."""
    found = new.where("value is not null").groupBy("key").agg(F.min("value").alias("value"))
    found.join(read_cache(new.sparkSession, path), "key", "left_anti").write.mode("append").json(path)


def settings_key(settings: dict) -> str:
    """The same for equal settings in any order; a range of pages is none of them, so runs of parts meet in one store."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def cache_identity(**parts: str | int | bytes) -> str:
    """One name for what a recogniser's results depend on: contents (as bytes) by their hash, settings as they are."""
    plain = {k: hashlib.sha256(v).hexdigest() if isinstance(v, bytes) else v for k, v in parts.items()}
    return json.dumps(plain, sort_keys=True, ensure_ascii=False)


MANIFEST = "version int, source string, page_count int, settings string, generation string, status string, output string"


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The last state of a project; None of a new one."""
    try:
        row = spark.read.schema("at long, " + MANIFEST).json(path).where("at is not null").orderBy(F.desc("at")).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return row.asDict() if row else None


def write_manifest(spark: SparkSession, path: str, **state) -> None:
    """Appends a project's state: what isn't told stays as it was."""
    last = read_manifest(spark, path) or {"at": -1, "version": 1, "generation": "initial"}
    row = last | state | {"at": last["at"] + 1}
    schema = "at long, " + MANIFEST
    spark.createDataFrame([tuple(row.get(c.split()[0]) for c in schema.split(", "))], schema).coalesce(1).write.mode("append").json(path)


def checked_settings(kind: type, found: dict):
    """A dataclass from a loaded JSON object: values of another type than the default's, and unknown names, are left out."""
    default = kind()
    good = {f.name: found[f.name] for f in fields(kind) if f.name in found and type(found[f.name]) is type(getattr(default, f.name))}
    return kind(**good)


def plain_schema(node, dropped: frozenset = frozenset({"minimum", "maximum", "minLength", "maxLength", "maxItems"})):
    """A JSON schema without the keywords that some judges don't take."""
    if isinstance(node, dict):
        return {k: plain_schema(v, dropped) for k, v in node.items() if k not in dropped}
    return [plain_schema(x, dropped) for x in node] if isinstance(node, list) else node
