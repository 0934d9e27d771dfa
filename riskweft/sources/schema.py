"""The expected policy schema and its validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Column names of a policy file, by group: fixed values, compared case-sensitively.
POLICY_SCHEMA_COLUMNS = (
    # policy
    "UnderwrittenCoverID", "PolicyID", "TransactionMonth",
    # client
    "IsVATRegistered", "Citizenship", "LegalType", "Title", "Language", "Bank", "AccountType",
    "MaritalStatus", "Gender",
    # location
    "Country", "Province", "PostalCode", "MainCrestaZone", "SubCrestaZone",
    # vehicle
    "ItemType", "mmcode", "VehicleType", "RegistrationYear", "make", "Model", "Cylinders",
    "cubiccapacity", "kilowatts", "bodytype", "NumberOfDoors", "VehicleIntroDate",
    "CustomValueEstimate", "AlarmImmobiliser", "TrackingDevice", "CapitalOutstanding",
    "NewVehicle", "WrittenOff", "Rebuilt", "Converted", "CrossBorder", "NumberOfVehiclesInFleet",
    # plan
    "SumInsured", "TermFrequency", "CalculatedPremiumPerTerm", "ExcessSelected", "CoverCategory",
    "CoverType", "CoverGroup", "Section", "Product", "StatutoryClass", "StatutoryRiskType",
    # money
    "TotalPremium", "TotalClaims",
)


def validate_schema(
    df: DataFrame, expected: tuple[str, ...] = POLICY_SCHEMA_COLUMNS, strict: bool = False
) -> DataFrame:
    """One row: missing and extra columns, the share of expected ones present, and the rows read.

    ``empty_columns`` are expected columns that are there but hold no value at all.

    Extra columns are always allowed; ``strict`` raises when any is missing.
    """
    missing = [c for c in expected if c not in df.columns]
    if strict and missing:
        raise ValueError(f"Schema validation failed in strict mode. Missing columns: {missing}")
    present = [c for c in expected if c in df.columns]
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count(F.col(c)).alias(f"__n{i}") for i, c in enumerate(present)],
    )
    empty = [F.when(F.col(f"__n{i}") == 0, F.lit(c)) for i, c in enumerate(present)]
    return counts.select(
        F.lit(not missing).alias("is_valid"),
        F.array(*[F.lit(c) for c in missing]).cast("array<string>").alias("missing_columns"),
        F.array(*[F.lit(c) for c in df.columns if c not in expected])
        .cast("array<string>")
        .alias("extra_columns"),
        F.lit(len(set(df.columns))).cast("long").alias("total_columns"),
        F.lit(len(expected)).cast("long").alias("expected_columns"),
        F.lit((len(expected) - len(missing)) / len(expected) * 100).alias("match_percentage"),
        F.array_compact(F.array(*empty)).cast("array<string>").alias("empty_columns"),
        F.col("__rows").alias("rows"),
    )
