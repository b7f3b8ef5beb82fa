"""Files dropped for references: read once, and again when their content changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from marginalia.operators.assignment import preferred_files

FILES = "path string, modificationTime timestamp, length long, content binary"
MANIFEST = "paper string, key string, name string, kind string, hash string, batch long"


def dropped(files: DataFrame) -> DataFrame:
    """``(paper, kind, name, hash, at)`` of binary files below ``.../<paper>/<academic or web>/``, in batch or as a stream; other files give no row."""
    parts = F.split(F.regexp_replace("path", r"/+$", ""), "/")
    kind = F.element_at(parts, -2)
    return files.where(F.size(parts) >= 3).where(kind.isin("academic", "web")).select(
        F.element_at(parts, -3).alias("paper"), kind.alias("kind"), F.element_at(parts, -1).alias("name"), F.sha2("content", 256).alias("hash"), F.col("modificationTime").alias("at"))


def outcomes(files: DataFrame, references: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(paper, key, name, kind, hash)`` of references ``(paper, key, ord, title)`` whose file is new or has other content than manifest ``(paper, key, hash)`` has.

    Files are assigned by name, an academic one before one from the web. Of a
    name that occurs again the latest file counts.
    """
    latest = files.groupBy("paper", "kind", "name").agg(F.max_by("hash", F.struct("at", "hash")).alias("hash"))
    folder = lambda kind: latest.where(F.col("kind") == kind)
    got = preferred_files(folder("academic"), folder("web"), references).join(latest, ["paper", "kind", "name"])
    known = manifest.select("paper", "key", F.col("hash").alias("__hash"))
    return got.join(known, ["paper", "key"], "left").where(~F.col("hash").eqNullSafe(F.col("__hash"))).select("paper", "key", "name", "kind", "hash")


class Manifest:
    """What was read last for each reference: a row a reading, in a folder for each batch, so that a batch that runs again replaces its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self, before: int | None = None) -> DataFrame:
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], MANIFEST)
        return rows if before is None else rows.where(F.col("batch") < before)

    def latest(self, before: int | None = None) -> DataFrame:
        last = F.max_by(F.struct("name", "kind", "hash", "batch"), "batch").alias("x")
        return self.rows(before).groupBy("paper", "key").agg(last).select("paper", "key", "x.*")

    def add(self, read: DataFrame, batch: int) -> None:
        rows = read.select("paper", "key", "name", "kind", "hash", F.lit(batch).cast("long").alias("batch"))
        rows.write.mode("overwrite").parquet(f"{self.path.rstrip('/')}/reading={batch}")


def ingest(files: DataFrame, references: DataFrame, manifest: Manifest, batch: int) -> None:
    """One batch: what is new or changed goes into the manifest. The papers that have a file here are those looked at."""
    seen = dropped(files)
    known = manifest.latest(before=batch)
    # files of earlier batches still take part in the assignment, under the content that was read then
    earlier = known.join(seen.select("paper").distinct(), "paper", "left_semi").select("paper", "kind", "name", "hash", F.lit(None).cast("timestamp").alias("at"))
    manifest.add(outcomes(seen.unionByName(earlier), references, known), batch)


def ingest_stream(spark: SparkSession, folder: str, references: DataFrame, manifest: Manifest, checkpoint: str) -> DataStreamWriter:
    """A stream over files below folder; start it with any trigger.

    The source reads a path once, so a file with other content has to arrive
    under a path of its own, such as in a folder a day; what it holds is compared
    with the manifest, whatever its path.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(folder)
    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: ingest(rows, references, manifest, batch))


def source_type(name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(suffix == "pdf", "pdf").when(suffix.isin("md", "markdown"), "markdown").otherwise("tex")


def source_states(now: DataFrame, before: DataFrame) -> DataFrame:
    """``(paper, compatible, reason, changed)`` of papers ``(paper, source_file, source_hash, bib_hash)`` against what was analysed before.

    A paper without an earlier manifest is a first run; another kind of source
    isn't compatible; changed says whether the manuscript or its bibliography
    has other content.
    """
    old = before.select("paper", F.col("source_type").alias("__type"), F.col("source_hash").alias("__hash"), F.col("bib_hash").alias("__bib"), F.lit(True).alias("__seen"))
    kind, was = source_type(F.col("source_file")), F.coalesce("__type", F.lit(""))
    other = (was != "") & (was != kind)
    reason = F.when(F.col("__seen").isNull(), "first_run").when(other, F.concat(F.lit("source_type_changed:"), was, F.lit("→"), kind)).otherwise("ok")
    same = F.col("source_hash").eqNullSafe(F.col("__hash")) & F.coalesce("bib_hash", F.lit("")).eqNullSafe(F.coalesce("__bib", F.lit("")))
    return now.join(old, "paper", "left").select("paper", (~F.coalesce(other, F.lit(False))).alias("compatible"), reason.alias("reason"), (~same).alias("changed"))


def split_by_hash(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """rows with ``cached``: whether the cache ``(hash)`` has their content; rows without a hash are new."""
    known = cache.select("hash").where("hash <> ''").distinct().withColumn("cached", F.lit(True))
    return rows.join(known, "hash", "left").select(*rows.columns, F.coalesce("cached", F.lit(False)).alias("cached"))


def purged(cache: DataFrame, model: str | None = None, version: str | None = None) -> DataFrame:
    """The cache without the rows of a model, of a version, or of both."""
    gone = F.lit(False)
    for name, value in (("model", model), ("version", version)):
        if value is not None:
            gone = gone | F.col(name).eqNullSafe(F.lit(value))
    return cache.where(~gone)
