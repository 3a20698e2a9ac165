"""Table, JSON, log and shard readers and writers."""

from __future__ import annotations

import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import conform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once a row.  A projection's expressions are written again into each filter
    and column that reads them, as often as these name them; what ``explode`` returns is not."""
    for name, column in columns.items():
        df = df.withColumn(name, F.explode(F.array(column)))
    return df


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and held in the session's checkpoint folder, so that lineage ends there.  The folder is
    what ``spark.checkpoint.dir`` names; only ``local[...]`` masters may go without."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(where or f"file://{tempfile.mkdtemp(prefix='larkspur-')}")
    return df.checkpoint()


def typed_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table with additive migrations applied."""
    return conform(spark.read.option("mergeSchema", "true").parquet(path), schema)


PLACE = "id string, displayName struct<text:string>, formattedAddress string, websiteUri string, location struct<latitude:double,longitude:double>, primaryType string, rating double, userRatingCount long, priceLevel string, businessStatus string"


def places(spark: SparkSession, path: str) -> DataFrame:
    """Normalised rows of a fixture: {"places": [...]} or a bare list; a place without a name has its id."""
    wrapped = spark.read.schema(f"places array<struct<{PLACE.replace(' struct', ':struct').replace(' string', ':string').replace(' double', ':double').replace(' long', ':long')}>>, {PLACE}").option("multiLine", "true").json(path)
    nested = wrapped.where("places IS NOT NULL").select(F.inline("places"))
    bare = wrapped.where("id IS NOT NULL").drop("places")
    rows = nested.unionByName(bare)
    return rows.select(
        F.col("id").alias("place_id"), F.coalesce("displayName.text", "id").alias("name"), F.col("formattedAddress").alias("address"), F.col("websiteUri").alias("website_url"),
        F.col("location.latitude").alias("lat"), F.col("location.longitude").alias("lng"), F.col("primaryType").alias("primary_type"), "rating", F.col("userRatingCount").alias("user_rating_count"),
        F.col("priceLevel").alias("price_level"), F.col("businessStatus").alias("business_status"),
    ).dropDuplicates(["place_id"])


def newest_marked_lines(spark: SparkSession, folder: str, marker: str, files: int = 5) -> DataFrame:
    """The last line with a marker in each of the newest log files."""
    lines = spark.read.text(f"{folder}/*").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    newest = lines.groupBy("file").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "file").limit(files).select("file")
    return lines.join(F.broadcast(newest), "file").where(F.col("value").contains(marker)).groupBy("file").agg(F.max_by("value", F.struct("b", "n")).alias("line"))


def write_shards(rows: DataFrame, path: str, key: str = "restaurant_id", order: tuple[str, ...] = ("id",)) -> None:
    """One folder a key, of gzip JSON in a fixed order; keys that are not in ``rows`` keep theirs."""
    spread = rows.repartition(key).sortWithinPartitions(key, *order)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").partitionBy(key).json(path)


def read_shard(spark: SparkSession, path: str, schema: T.StructType, key: str, value) -> DataFrame:
    """One key's rows; only its folder is read."""
    return spark.read.schema(schema).json(path).where(F.col(key) == value)


def manifest(rows: DataFrame, key: str = "restaurant_id") -> DataFrame:
    """One row: rows, keys and a digest of the content that does not depend on any order."""
    whole = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)])
    return rows.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.sum(F.pmod(whole, F.lit(1_000_000_007))).alias("digest"))


def parity(before: DataFrame, after: DataFrame, id_col: str, parents: DataFrame, fk: str) -> dict[str, int]:
    """Violations to look at before a write: repeated ids, dangling references, rows that differ."""
    return {
        "repeated_ids": after.groupBy(id_col).count().where("count > 1").count(),
        "dangling": after.join(parents.select(F.col("id").alias(fk)), fk, "left_anti").count(),
        "lost": before.exceptAll(after).count(),
        "gained": after.exceptAll(before).count(),
    }


def read_snapshot(spark: SparkSession, schema: T.StructType, *paths: str) -> DataFrame:
    """The JSON rows at the first of the paths that exists: a plain snapshot, else its compressed forms."""
    for path in paths:
        try:
            return spark.read.schema(schema).json(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"no snapshot: {', '.join(paths)}")


def read_shards(spark: SparkSession, path: str, schema: T.StructType, key: str, keys: list, snapshot: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, failed) of several shards.  A key without a shard has its rows of ``snapshot``; a shard with a broken
    row fails as a whole, is named in ``failed`` and takes nothing from the others."""
    wanted = spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(key, schema[key].dataType)]))
    columns = [f.name for f in schema.fields]
    body = T.StructType([*(f for f in schema.fields if f.name != key), T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.option("basePath", path).text(path).where(F.col(key).isin(keys)).where(F.trim("value") != "")
    held = lines.select(F.col(key).cast(schema[key].dataType).alias(key), F.from_json("value", body, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("row")).select(key, "row.*")
    marks = held.groupBy(key).agg(F.max(F.col("_corrupt_record").isNotNull()).alias("broken"))
    failed = marks.where("broken").select(key)
    rows = held.select(*columns).join(failed, key, "left_anti").select(*columns)
    if snapshot is not None:
        missing = wanted.join(marks.select(key), key, "left_anti")
        rows = rows.unionByName(snapshot.select(*columns).join(missing, key, "left_semi").select(*columns))
    return rows, failed
