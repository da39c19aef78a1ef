"""Scans and sinks, over files Spark writes from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from gleanframe.plans.registry import query
from gleanframe.session import scratch_path
from gleanframe.sources.files import scan_delimited, write_delimited, write_parquet, zoned_timestamp
from gleanframe.sources.standins import table

PART_SCHEMA = T.StructType(
    [
        T.StructField("p_partkey", T.LongType()),
        T.StructField("p_name", T.StringType()),
        T.StructField("p_brand", T.StringType()),
        T.StructField("p_type", T.StringType()),
        T.StructField("p_size", T.IntegerType()),
        T.StructField("p_retailprice", T.DoubleType()),
    ]
)


def _parts_with_gaps(spark, sf):
    part = table(spark, sf, "part")
    return part.select(
        "p_partkey",
        F.when(F.col("p_size") == 8, F.concat("p_name", F.lit('\n"second" line, of one cell')))
        .when(F.col("p_size") != 7, F.col("p_name")).alias("p_name"),
        "p_brand",
        F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_type")).alias("p_type"),
        F.when(F.col("p_size") != 9, F.col("p_size")).alias("p_size"),
        "p_retailprice",
    )


GAPS = """
SELECT p_partkey, CASE WHEN p_size = 8 THEN p_name || chr(10) || '"second" line, of one cell' WHEN p_size <> 7 THEN p_name END AS p_name, p_brand, {type} AS p_type,
       CASE WHEN p_size <> 9 THEN p_size END AS p_size, p_retailprice FROM part"""


@query("scan_csv_na", GAPS.format(type="nullif(p_type, 'PROMO')"))
def scan_csv_na(spark, sf):
    path = scratch_path(spark, "parts-csv")
    write_delimited(_parts_with_gaps(spark, sf), path)
    return scan_delimited(spark, path, PART_SCHEMA)


@query("scan_tsv_keep_blank", GAPS.format(type="CASE WHEN p_type = 'PROMO' THEN '' ELSE p_type END"))
def scan_tsv_keep_blank(spark, sf):
    path = scratch_path(spark, "parts-tsv")
    write_delimited(_parts_with_gaps(spark, sf), path, sep="\t")
    return scan_delimited(spark, path, PART_SCHEMA, sep="\t", blank_as_null=False)


@query("sink_roundtrip", """
SELECT p_brand, p_type, count(*) AS n, round(sum(p_retailprice), 4) AS value FROM part GROUP BY 1, 2""")
def sink_roundtrip(spark, sf):
    result = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 4).alias("value")
    )
    path = scratch_path(spark, "report")
    write_parquet(result, path)
    write_delimited(spark.read.parquet(path), path + "-csv")
    return scan_delimited(spark, path + "-csv", result.schema)


@query("scan_timestamp_zone", """
SELECT event_id, CAST(timezone('UTC', timezone('Europe/Paris', date_trunc('second', ts))) AS VARCHAR) AS instant FROM events""")
def scan_timestamp_zone(spark, sf):
    path = scratch_path(spark, "events-csv")
    written = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("local"))
    write_delimited(written, path)
    back = scan_delimited(spark, path, written.schema)
    return back.select("event_id", F.date_format(zoned_timestamp("local", "Europe/Paris"), "yyyy-MM-dd HH:mm:ss").alias("instant"))
