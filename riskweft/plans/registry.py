"""Registry pairing each query with the SQL an independent engine can run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with its oracle when it can be written in SQL."""

    def register(run: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"Query {name} is registered twice")
        REGISTRY[name] = Entry(run, sql)
        return run

    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named columns; the oracle rounds the same way."""
    return df.select(
        *[
            F.round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c)
            for c in df.columns
        ]
    )


def r(column: str | Column, digits: int, name: str | None = None) -> Column:
    out = F.round(F.col(column) if isinstance(column, str) else column, digits)
    return out.alias(name or column)


# The policy view in SQL, for the oracle side.
POLICY = """
policy AS (
  SELECT l_orderkey AS PolicyID, l_linenumber AS LineNumber, l_partkey AS PartKey,
         l_shipdate AS TransactionMonth,
         l_extendedprice / 100 AS TotalPremium,
         CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_discount * 60 / 100
              ELSE 0 END AS TotalClaims,
         p_retailprice * l_quantity AS SumInsured,
         o_totalprice AS CalculatedPremiumPerTerm,
         CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE c_acctbal END AS CustomValueEstimate,
         CAST(year(o_orderdate) AS INTEGER) AS RegistrationYear,
         p_size AS Cylinders, n_name AS Province, r_name AS Country,
         CAST(l_suppkey AS VARCHAR) AS PostalCode, p_type AS VehicleType,
         p_brand AS make, l_linestatus AS Gender,
         CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS Bank
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)"""


def policy_sql(body: str, *ctes: str) -> str:
    """``WITH policy AS (...), more... body``."""
    return "WITH " + ",\n".join([POLICY.strip(), *[c.strip() for c in ctes]]) + "\n" + body
