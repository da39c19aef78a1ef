"""Delimited text and Parquet with survey null rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def scan_delimited(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", blank_as_null: bool = True,
    multi_line: bool = True, timestamp_format: str = "yyyy-MM-dd HH:mm:ss",
) -> DataFrame:
    """Header file with ``NA`` for null and a declared schema.

    With ``blank_as_null=False`` a blank text cell stays an empty string; blank
    numbers are null either way. A quoted cell may hold line breaks: with ``multi_line`` each
    file is one task, which suits exports of many files; a file without such cells can be split
    with ``multi_line=False``. A row that does not fit the schema fails the query.
    """
    options = {
        "header": True, "sep": sep, "escape": '"', "multiLine": multi_line, "timestampFormat": timestamp_format, "mode": "FAILFAST",
    }
    if blank_as_null:
        # quoted blanks are null too
        return spark.read.schema(schema).csv(path, nullValue="NA", emptyValue="", **options).select(
            *[
                F.nullif(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
                for f in schema.fields
            ]
        )
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.schema(text).csv(path, **options)
    cells = []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            cells.append(F.when(c == "NA", None).otherwise(F.coalesce(c, F.lit(""))).alias(f.name))
        else:
            # blanks and NA are null; what is left must be a value of the type
            cells.append(F.nullif(F.nullif(F.trim(c), F.lit("NA")), F.lit("")).cast(f.dataType).alias(f.name))
    return raw.select(*cells)


def zoned_timestamp(text: Column | str, zone: str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """The instant that a local time written as text names in ``zone``; text of another form gives null."""
    return F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(pattern)), zone)


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    """Header file with ``NA`` for null, no row names; folders are created as needed."""
    df.write.mode("overwrite").csv(path, header=True, sep=sep, nullValue="NA", emptyValue="", escape='"')


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
