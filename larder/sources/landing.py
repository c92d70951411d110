"""The landing folder of JSON pages: newest folder, reading, unnesting, and normalization into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.warehouse import LOAD, PARENT, ROW


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified) of all files below a folder, without their content."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return listed.select("path", F.col("modificationTime").alias("modified"))


def newest_folder(listed: DataFrame) -> str | None:
    """The folder of the newest file (of equals the first path); None without files."""
    row = listed.agg(F.min_by("path", F.struct(-F.unix_micros("modified"), "path")).alias("path")).first()
    return row.path.rsplit("/", 1)[0] if row and row.path else None


def read_pages(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """All JSON documents below a folder, with their file as `_file`."""
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(folder).select("*", F.col("_metadata.file_path").alias("_file"))


def write_pages(pages: DataFrame, folder: str) -> None:
    """One file for each page, as `read_pages` takes them."""
    pages.write.mode("overwrite").option("maxRecordsPerFile", 1).json(folder)


def unnest(pages: DataFrame, items: str = "_embedded.products") -> DataFrame:
    """One row for each listed item: its fields, `_file` and `_pos`."""
    return pages.select("_file", F.posexplode(items).alias("_pos", "_item")).select("_file", "_pos", "_item.*")


def with_load_time(rows: DataFrame, column: str = "load_timestamp") -> DataFrame:
    return rows.withColumn(column, F.current_timestamp())


def flat_columns(kind: T.StructType, path: tuple[str, ...] = ()) -> tuple[list[tuple[tuple[str, ...], T.DataType]], list[tuple[tuple[str, ...], T.ArrayType]]]:
    """Paths to the plain values and to the lists of a struct."""
    plain, lists = [], []
    for f in kind.fields:
        at = (*path, f.name)
        if isinstance(f.dataType, T.StructType):
            p, l = flat_columns(f.dataType, at)
            plain += p
            lists += l
        elif isinstance(f.dataType, T.ArrayType):
            lists.append((at, f.dataType))
        else:
            plain.append((at, f.dataType))
    return plain, lists


def reached(path: tuple[str, ...]) -> Column:
    return F.col(".".join(f"`{p}`" for p in path))


def normalize(items: DataFrame, table: str, load_id: str) -> dict[str, DataFrame]:
    """A parent table and a child table for every list, at any depth.

    Structs become columns a__b. Rows get a key (_dlt_id), a hash of load, file and position, so that a rerun gives equal
    keys; rows of lists also the key of their parent (_dlt_parent_id) and their place (_dlt_list_idx); roots the load.
    """
    out: dict[str, DataFrame] = {}
    key = lambda *parts: F.substring(F.sha2(F.concat_ws("/", *parts), 256), 1, 20)
    root = items.withColumn("_key", key(F.lit(load_id), F.col("_file"), F.col("_pos").cast("string"))).withColumn("_load", F.lit(load_id))

    def add(rows: DataFrame, name: str, kind: T.StructType, fixed: list[Column]) -> None:
        plain, lists = flat_columns(kind)
        out[name] = rows.select(*(reached(("_v", *p)).alias("__".join(p)) for p, _ in plain), *fixed)
        for p, of in lists:
            child = f"{name}__{'__'.join(p)}"
            below = rows.select(F.col("_key").alias("_parent"), F.posexplode(reached(("_v", *p))).alias("_idx", "_v"))
            below = below.withColumn("_key", key(F.col("_parent"), F.lit("__".join(p)), F.col("_idx").cast("string")))
            inner = of.elementType if isinstance(of.elementType, T.StructType) else T.StructType([T.StructField("value", of.elementType)])
            if not isinstance(of.elementType, T.StructType):
                below = below.withColumn("_v", F.struct(F.col("_v").alias("value")))
            add(below, child, inner, [F.col("_parent").alias(PARENT), F.col("_idx").cast("long").alias("_dlt_list_idx"), F.col("_key").alias(ROW)])

    own = [f for f in items.schema.fields if f.name not in ("_file", "_pos")]
    add(root.withColumn("_v", F.struct(*(F.col(f"`{f.name}`") for f in own))), table, T.StructType(own), [F.col("_key").alias(ROW), F.col("_load").alias(LOAD)])
    return out


def load_row(spark: SparkSession, load_id: str, schema_name: str, inserted_at: str, schema_hash: str = "") -> DataFrame:
    """The row of the table of loads; inserted_at is a text in UTC."""
    row = spark.createDataFrame([(load_id, schema_name, 0, inserted_at, schema_hash)], "load_id string, schema_name string, status long, inserted_at string, schema_version_hash string")
    return row.withColumn("inserted_at", F.to_timestamp("inserted_at"))
