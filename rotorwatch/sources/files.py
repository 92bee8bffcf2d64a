"""Readers of landed files. Schemas are explicit: no inference pass over the data."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rotorwatch import schemas as S
from rotorwatch.operators.ingest import coerce, with_ingest_audit


def _with_text(schema: T.StructType, *columns: str) -> T.StructType:
    """The schema with some columns read as text, to be parsed with care afterwards."""
    return T.StructType([
        T.StructField(f.name, T.StringType() if f.name in columns else f.dataType) for f in schema
    ])


def _csv_stream(
    spark: SparkSession, folder: str, schema: T.StructType, parse: dict[str, str],
    name_glob: str | None, files_per_trigger: int | None,
) -> DataFrame:
    reader = spark.readStream.schema(_with_text(schema, *parse)).option("header", True)
    # the file source watches a folder: the glob picks the files where it holds several tables
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return coerce(with_ingest_audit(reader.csv(folder)), parse)


def stream_sensor_readings(
    spark: SparkSession, folder: str, name_glob: str | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """New telemetry CSV files as they land, stamped with ingestion time and source file."""
    return _csv_stream(spark, folder, S.SENSOR_READINGS, {"timestamp": "timestamp"}, name_glob,
                       files_per_trigger)


def stream_maintenance_logs(
    spark: SparkSession, folder: str, name_glob: str | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """New work-order CSV files as they land."""
    parse = {"timestamp": "timestamp", "first_time_fix": "boolean"}
    return _csv_stream(spark, folder, S.MAINTENANCE_LOGS, parse, name_glob, files_per_trigger)


def read_asset_metadata(spark: SparkSession, path: str) -> DataFrame:
    dates = {"manufacture_date": "date", "installation_date": "date"}
    rows = spark.read.schema(_with_text(S.ASSET_METADATA, *dates)).option("header", True).csv(path)
    return coerce(rows, dates)


def read_production_output(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.PRODUCTION_OUTPUT).option("header", True).csv(path)


def read_manuals(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files as whole documents, named by their file name without the ending."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "")
    return files.select(stem.alias("manual_name"), F.col("value").alias("text"))


def landing_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Landed files with their size; the contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        .select(
            F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"),
            F.col("length").alias("size_bytes"),
            F.round(F.col("length") / 1024, 1).alias("size_kb"),
        )
    )


def missing_tables(spark: SparkSession, names: list[str]) -> list[str]:
    return [name for name in names if not spark.catalog.tableExists(name)]


def require_tables(spark: SparkSession, names: list[str]) -> None:
    """Stop with the names of all missing input tables."""
    missing = missing_tables(spark, names)
    if missing:
        raise LookupError("missing input tables: " + ", ".join(missing))


def set_tags(spark: SparkSession, table: str, **tags: str) -> None:
    pairs = ", ".join(f"'{key}' = '{value}'" for key, value in tags.items())
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({pairs})")


def tables_with_tag(spark: SparkSession, key: str, value: str) -> list[str]:
    """Names of the catalog tables that carry the tag. Reads table properties, never data."""
    tagged = []
    for table in spark.catalog.listTables():
        if table.tableType == "TEMPORARY":
            continue
        properties = spark.sql(f"SHOW TBLPROPERTIES {table.name}").collect()
        if any(row["key"] == key and row["value"] == value for row in properties):
            tagged.append(table.name)
    return sorted(tagged)
