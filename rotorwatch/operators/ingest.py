"""Stamping and typing of landed rows."""

from pyspark.sql import DataFrame, functions as F


def with_ingest_audit(df: DataFrame) -> DataFrame:
    """Stamp each row with the time of ingestion and the file it came from."""
    return df.withColumns(
        {"ingestion_time": F.current_timestamp(), "source_file": F.col("_metadata.file_path")}
    )


def coerce(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Parse text columns to the named types; text that does not parse becomes NULL.

    So a bad value reaches the quality gates and is counted there, instead of failing the job.
    """
    parsed = {}
    for name, kind in spec.items():
        text = F.col(name).cast("string")
        if kind == "timestamp":
            parsed[name] = F.try_to_timestamp(text)
        elif kind == "date":
            parsed[name] = F.to_date(F.try_to_timestamp(text))
        else:
            parsed[name] = F.trim(text).try_cast(kind)
    return df.withColumns(parsed)
