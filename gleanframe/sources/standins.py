"""Views over the test tables that play the part of survey inputs.

Each view joins only the tables its requested columns come from, so a query over
names and answers scans three columns of the fact table and never sees suppliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanframe.session import dealt, hashed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ANSWER = "CASE WHEN l_returnflag = 'R' THEN 'Unsustainable' ELSE 'Sustainable' END"

_FROM = {
    "answer": ("lineitem", ANSWER),
    "range_pct": ("lineitem", "l_quantity"),
    "line": ("lineitem", "l_linenumber"),
    "id": ("orders", "o_custkey"),
    "presence": ("orders", "o_orderpriority"),
    "status": ("orders", "o_orderstatus"),
    "name": ("part", "p_brand"),
    "life_form": ("part", "p_type"),
    "area": ("nation", "n_name"),
    "zone": ("region", "r_name"),
}


def n_mentions(spark: SparkSession, sf_dir: str) -> int:
    """Number of mention rows, which a Parquet file states without being read."""
    return table(spark, sf_dir, "lineitem").count()


def mentions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Mention rows: line items seen as citations of a brand by a customer."""
    need = {_FROM[c][0] for c in columns}
    df = table(spark, sf_dir, "lineitem")
    if "orders" in need:
        rows = n_mentions(spark, sf_dir)
        orders = dealt(table(spark, sf_dir, "orders"), rows, "o_orderkey")
        df = dealt(df, rows, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if "part" in need:
        df = df.join(hashed(table(spark, sf_dir, "part")), F.col("l_partkey") == F.col("p_partkey"))
    if need & {"nation", "region"}:
        places = table(spark, sf_dir, "supplier").join(
            table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
        )
        if "region" in need:
            places = places.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        df = df.join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    return df.select(*[F.expr(_FROM[c][1]).alias(c) for c in columns])


def mentions_nullable(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The same with unknown presence and life form."""
    holes = {"presence": "4-NOT SPECIFIED", "life_form": "PROMO"}
    df = mentions(spark, sf_dir, *columns)
    return df.select(*[F.nullif(F.col(c), F.lit(holes[c])).alias(c) if c in holes else F.col(c) for c in columns])


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas with their zone."""
    return table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_name").alias("area"), F.col("r_name").alias("zone"))


# The category lists of the profile view.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
BALANCE_BANDS = ("debt", "low", "middle", "high")
ORDER_BANDS = ("few orders", "some orders", "many orders")
PROFILE_VARIABLES = ("segment", "region", "balance_band", "order_band")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per respondent: customers with banded balance and order count."""
    n_orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    balance, n = F.col("c_acctbal"), F.coalesce("n", F.lit(0))
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(n_orders, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("c_custkey").alias("id"),
            F.col("c_mktsegment").alias("segment"),
            F.col("r_name").alias("region"),
            F.when(balance < 0, "debt").when(balance < 3000, "low").when(balance < 6000, "middle")
            .otherwise("high").alias("balance_band"),
            F.when(n < 8, "few orders").when(n < 12, "some orders").otherwise("many orders").alias("order_band"),
        )
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal rules: groups of brands that meet a condition at a nation, in a region or overall.

    Their places are written with accents and hyphens, those of the mentions without.
    """
    tax, qty = F.col("l_tax"), F.col("l_quantity")
    # no other line item meets a test below; told here, so that they are left out before the joins
    tested = ((tax == 0.08) & (qty >= 49)) | ((tax == 0.0) & qty.isin(1, 2, 3, 4))
    base = (
        table(spark, sf_dir, "lineitem").filter(tested)
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    brand = lambda digit: F.col("p_brand").startswith(f"Brand#{digit}")
    written = lambda place: F.translate(place, "E ", "É-")
    tests = [
        ((tax == 0.08) & (qty >= 49) & brand(1), "Département", written("n_name"), "Protection départementale", "Protection", "PD"),
        ((tax == 0.0) & (qty == 1) & brand(2), "Région", written("r_name"), "Protection régionale", "Protection", "PR"),
        ((tax == 0.0) & (qty == 2) & brand(3), "État", F.lit("France"), "Protection nationale", "Protection", "PN"),
        ((tax == 0.0) & (qty == 3) & brand(4), "État", F.lit("France"), "Réglementation", "Réglementation", "REGL"),
        ((tax == 0.0) & (qty == 4), "État", F.lit("France"), "Liste rouge", "Listes rouges", "LRN"),
    ]
    rule = F.explode(
        F.array_compact(
            F.array(
                *[
                    F.when(
                        test,
                        F.struct(
                            F.lit(level).alias("level"), place.alias("place"), F.lit(label).alias("status_label"),
                            F.lit(group).alias("grouping"), F.lit(code).alias("status_code"),
                        ),
                    )
                    for test, level, place, label, group, code in tests
                ]
            )
        )
    )
    return base.select(F.col("p_brand").alias("name"), rule.alias("r")).select("name", "r.*").distinct()


def label_list(spark: SparkSession, sf_dir: str, condition) -> DataFrame:
    """Names of the parts that meet a condition."""
    return (
        table(spark, sf_dir, "part").filter(condition)
        .select(F.concat_ws(" ", "p_brand", "p_name").alias("label")).distinct()
    )


#: Parcels are unit squares laid in rows of this width.
GRID_WIDTH = 64


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square polygons on a grid, one per customer, keyed by market segment."""
    from gleanframe.operators.geo import square

    k = F.col("c_custkey")
    x, y = (k % GRID_WIDTH).cast("double") * 10.0, F.floor(k / GRID_WIDTH).cast("double") * 10.0
    return table(spark, sf_dir, "customer").select(
        k.alias("parcel"), F.col("c_mktsegment").alias("owner"), square(x, y, 10.0).alias("rings")
    )


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parcels, every third one cut into a lower and an upper half, so that corners meet edges of neighbours."""
    from gleanframe.operators.geo import rectangle

    k = F.col("c_custkey")
    x, y = (k % GRID_WIDTH).cast("double") * 10.0, F.floor(k / GRID_WIDTH).cast("double") * 10.0
    shapes = F.when(k % 3 == 0, F.array(rectangle(x, y, 10.0, 5.0), rectangle(x, y + 5.0, 10.0, 5.0))).otherwise(F.array(rectangle(x, y, 10.0, 10.0)))
    return table(spark, sf_dir, "customer").select(k.alias("parcel"), F.col("c_mktsegment").alias("owner"), F.explode(shapes).alias("rings"))
