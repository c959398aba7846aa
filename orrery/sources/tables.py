"""Inputs: the inspection role tables, JSON decisions, manifests and latest-artifact lookup."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The types and results that the order columns stand for.
TYPES = {"1-URGENT": "COMPLAINT", "2-HIGH": "CANVASS RE-INSPECTION", "3-MEDIUM": "CANVASS", "4-NOT SPECIFIED": "OTHER", "5-LOW": "LICENSE"}
RESULTS = {"F": "Fail", "O": "No Entry", "P": "Pass w/ Conditions"}
INSPECTED = ("Fail", "Pass w/ Conditions", "Pass")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(column: str, names: dict[str, str]):
    out = F.when(F.lit(False), F.lit(""))
    for key, value in names.items():
        out = out.when(F.col(column) == key, value)
    return out


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dated, typed record per order, from the orders alone."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("inspection_id"),
        F.col("o_custkey").alias("establishment_id"),
        F.col("o_orderdate").cast("date").alias("d"),
        _mapped("o_orderpriority", TYPES).alias("kind"),
        _mapped("o_orderstatus", RESULTS).alias("results"),
        F.concat(F.lit("NAME "), (F.col("o_orderkey") % 3).cast("string")).alias("name"),
        (F.col("o_totalprice") / 500000).alias("score"),
    )


def inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with their severity flags, label and group.

    The flags aggregate the order's lines before the join, so the join is one to one.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("inspection_id")).agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("priority"), F.bool_or(F.col("l_returnflag") == "A").alias("foundation"), F.count("*").alias("entries")
    )
    places = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("establishment_id"), F.col("c_nationkey").alias("area"))
    rows = records(spark, sf_dir).join(lines, "inspection_id", "left").join(places, "establishment_id", "left")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("priority", "foundation")}
    return rows.withColumns(flags | {"entries": F.coalesce("entries", F.lit(0)), "label": F.coalesce("priority", F.lit(False)).cast("int")})


def decisions(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Human decisions from a JSON array file, every field a string."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    return spark.read.schema(schema).option("multiLine", True).json(path)


def append_staged(rows: DataFrame, path: str, key: str) -> None:
    """Append records to a staged JSON-lines log; an id that is there already is refused."""
    spark = rows.sparkSession
    try:
        known = spark.read.schema(rows.schema).json(path)
    except Exception as e:  # nothing staged yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], rows.schema)
    if not rows.join(known, key, "left_semi").isEmpty() or rows.count() != rows.select(key).distinct().count():
        raise ValueError(f"{key} is already staged")
    rows.write.mode("append").json(path)


def pending(staged: DataFrame, applied: DataFrame, key: str) -> DataFrame:
    """Staged records that no applied record answers."""
    return staged.join(applied.select(key).distinct(), key, "left_anti")


def records_as_text(records: DataFrame, columns: list[str]) -> DataFrame:
    """Raw layer: every column a string, nested values compact JSON, missing ones null."""
    kinds = {f.name: f.dataType for f in records.schema.fields}
    nested = (T.StructType, T.ArrayType, T.MapType)
    pick = lambda c: F.lit(None).cast("string") if c not in kinds else F.to_json(c) if isinstance(kinds[c], nested) else F.col(c).cast("string")
    return records.select(*(pick(c).alias(c) for c in columns))


def latest(spark: SparkSession, folder: str, prefix: str) -> str | None:
    """The path of the last artifact by name, listed through the cluster's file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{prefix}*.parquet")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(str(x.getPath()) for x in found or [])
    return names[-1] if names else None


def manifest(df: DataFrame) -> str:
    """Row count, schema and content digest of a table, as JSON.

    The digest is SHA-256 over a sum, free of order, of every row's SHA-256: 16 bits of it at a
    time, so the sums are exact; a map-side combined aggregate gives them.
    """
    row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring("_h", 4 * i + 1, 4), 16, 10).cast("long")).alias(f"s{i}") for i in range(16)]
    got = df.select(row.alias("_h")).agg(F.count("*").alias("n"), *parts).first()
    digest = hashlib.sha256(",".join(str(got[f"s{i}"] or 0) for i in range(16)).encode()).hexdigest()
    return json.dumps({"row_count": got["n"], "sha256": digest, "schema": dict(df.dtypes)}, sort_keys=True)


def write_manifest(df: DataFrame, path: str) -> str:
    """Write a table's manifest beside it (``path`` + ``.manifest``) and return it."""
    text = manifest(df)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(path + ".manifest")
    return text


def fields(records: list[dict]) -> list[str]:
    """All field names of raw records, in order of first sight: a record may lack some."""
    seen: dict[str, None] = {}
    for r in records:
        seen.update(dict.fromkeys(r))
    return list(seen)


def write_table(df: DataFrame, path: str, keys: list[str]) -> None:
    """The declared total order, then a zstd Parquet folder that must not exist yet."""
    df.orderBy(*keys).write.option("compression", "zstd").parquet(path)
