"""Policy view over a star schema: one row per line item, dimensions on demand.

Every dimension is joined by its primary key with a left join, so a join can
neither drop nor repeat a policy row.  That makes it exact to leave out the
dimensions whose columns nobody asked for: a loss ratio by gender reads one table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _claims() -> Column:
    paid = F.col("l_extendedprice") * F.col("l_discount") * 60 / 100
    return F.when(F.col("l_returnflag") == "R", paid).otherwise(F.lit(0.0))


# Table schemas, declared so that opening a table starts no job: fixed values.
_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
}

# column -> (dimension it needs, expression)
_COLUMNS: dict[str, tuple[str, object]] = {
    "PolicyID": ("lineitem", lambda: F.col("l_orderkey")),
    "LineNumber": ("lineitem", lambda: F.col("l_linenumber")),
    "PartKey": ("lineitem", lambda: F.col("l_partkey")),
    "TransactionMonth": ("lineitem", lambda: F.col("l_shipdate")),
    "TotalPremium": ("lineitem", lambda: F.col("l_extendedprice") / 100),
    "TotalClaims": ("lineitem", _claims),
    "SumInsured": ("part", lambda: F.col("p_retailprice") * F.col("l_quantity")),
    "CalculatedPremiumPerTerm": ("orders", lambda: F.col("o_totalprice")),
    "CustomValueEstimate": (
        "customer",
        lambda: F.when(F.col("l_partkey") % 10 != 0, F.col("c_acctbal")),
    ),
    "RegistrationYear": ("orders", lambda: F.year("o_orderdate")),
    "Cylinders": ("part", lambda: F.col("p_size")),
    "Province": ("nation", lambda: F.col("n_name")),
    "Country": ("region", lambda: F.col("r_name")),
    "PostalCode": ("lineitem", lambda: F.col("l_suppkey").cast("string")),
    "VehicleType": ("part", lambda: F.col("p_type")),
    "make": ("part", lambda: F.col("p_brand")),
    "Gender": ("lineitem", lambda: F.col("l_linestatus")),
    "Bank": (
        "customer",
        lambda: F.when(F.col("o_custkey") % 7 != 0, F.col("c_mktsegment")),
    ),
}

POLICY_COLUMNS = list(_COLUMNS)

# dimension -> the dimension it hangs on
_PARENT = {"customer": "orders", "nation": "customer", "region": "nation"}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read.schema(_SCHEMAS[name]) if name in _SCHEMAS else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def policy_view(
    spark: SparkSession, folder: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """The policy table with the requested columns (all of them by default)."""
    wanted = list(columns) if columns is not None else POLICY_COLUMNS
    unknown = [c for c in wanted if c not in _COLUMNS]
    if unknown:
        raise ValueError(f"Columns not found: {unknown}")

    needed = {_COLUMNS[c][0] for c in wanted}
    for child in ("region", "nation", "customer"):
        if child in needed:
            needed.add(_PARENT[child])

    rows = read_table(spark, folder, "lineitem")
    if "orders" in needed:
        # Enrich the orders side first: it is narrower than the line items, so
        # the wide fact table is shuffled once, on its order key.
        orders = read_table(spark, folder, "orders")
        if "customer" in needed:
            customer = read_table(spark, folder, "customer")
            orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        if "nation" in needed:
            nation = read_table(spark, folder, "nation")
            orders = orders.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        if "region" in needed:
            region = read_table(spark, folder, "region")
            orders = orders.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if "part" in needed:
        part = read_table(spark, folder, "part")
        rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.select(*[_COLUMNS[c][1]().alias(c) for c in wanted])
