"""Column inventory of a catalog, and JDBC tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas that hold no user tables.
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "sys", "mysql", "performance_schema")

INVENTORY = "db string, table string, object_type string, column string, sql_type string"

JDBC_URLS = {
    "postgresql": "jdbc:postgresql://{host}:{port}/{db}",
    "mysql": "jdbc:mysql://{host}:{port}/{db}",
    "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={db};trustServerCertificate=true",
    "sqlite": "jdbc:sqlite:{path}",
}


def list_databases(spark: SparkSession) -> list[str]:
    return [d.name for d in spark.catalog.listDatabases() if d.name not in SYSTEM_SCHEMAS]


def column_inventory(spark: SparkSession, databases: Iterable[str] | None = None, views: bool = True) -> DataFrame:
    """One row per column of the catalog's tables (and views); metadata only."""
    rows = []
    for db in databases or list_databases(spark):
        for t in spark.catalog.listTables(db):
            kind = "view" if t.tableType in ("VIEW", "TEMPORARY") else "table"
            if kind == "view" and not views:
                continue
            name = t.name if t.isTemporary else f"`{db}`.`{t.name}`"
            rows += [(db, t.name, kind, c.name, c.dataType) for c in spark.catalog.listColumns(name)]
    return spark.createDataFrame(rows, INVENTORY)


def frame_inventory(spark: SparkSession, tables: dict[str, DataFrame], db: str | None = None) -> DataFrame:
    """The same inventory for named DataFrames."""
    rows = [
        (db, name, "table", f.name, f.dataType.simpleString())
        for name, df in tables.items()
        for f in df.schema
    ]
    return spark.createDataFrame(rows, INVENTORY)


def jdbc_url(kind: str, **where: str) -> str:
    return JDBC_URLS[kind].format(**where)


def jdbc_table(
    spark: SparkSession, url: str, table: str, partition_column: str | None = None,
    lower: int | None = None, upper: int | None = None, partitions: int = 1, **options: str,
) -> DataFrame:
    """A database table; with a partition column the read is split over tasks."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", lower).option("upperBound", upper)
            .option("numPartitions", partitions)
        )
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def jdbc_inventory(spark: SparkSession, url: str, db: str, **options: str) -> DataFrame:
    """Inventory of a remote database from its information schema."""
    columns = jdbc_table(
        spark, url,
        "(select c.table_schema, c.table_name, t.table_type, c.column_name, c.data_type "
        "from information_schema.columns c join information_schema.tables t "
        "on c.table_schema = t.table_schema and c.table_name = t.table_name) q",
        **options,
    )
    return columns.where(~F.lower("table_schema").isin(*SYSTEM_SCHEMAS)).select(
        F.lit(db).alias("db"), F.col("table_name").alias("table"),
        F.when(F.upper("table_type").contains("VIEW"), "view").otherwise("table").alias("object_type"),
        F.col("column_name").alias("column"), F.col("data_type").alias("sql_type"),
    )
