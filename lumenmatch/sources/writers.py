"""Writers: dictionary seeding, keyed inserts, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.routing import audited
from ..schemas import KEYS, TABLES
from .keyed import insert_absent


def seed_dictionary(names: DataFrame, path: str) -> None:
    """Write the distinct names; seeding again does not repeat any."""
    names.select("name").where(F.col("name").isNotNull()).distinct().write.mode("overwrite").parquet(path)


def insert_rows(spark: SparkSession, table: str, rows: DataFrame, database: str = "default") -> None:
    """Append rows whose key the table lacks, with audit columns; columns are picked by the table's schema."""
    name, keys = f"{database}.{table}", KEYS.get(table)
    target = spark.table(name)
    id_col = TABLES[table].split(" ", 1)[0]
    rows = audited(rows).withColumn(id_col, F.xxhash64(*(keys or sorted(set(rows.columns) & set(target.columns)))))
    if keys:
        insert_absent(spark, name, rows, keys)
        return
    picked = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema]
    rows.select(*picked).write.mode("append").insertInto(name)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_snippets(snips: DataFrame, path: str) -> None:
    """Snippets by region, their pixels as a binary column."""
    snips.write.mode("overwrite").partitionBy("region").parquet(path)
