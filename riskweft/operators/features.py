"""Derived policy features."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from riskweft.operators.metrics import CLAIMS, PREMIUM, has_claim
from riskweft.operators.quantiles import quantile_values

# feature -> columns it needs, in the order features are built
FEATURES: dict[str, tuple[str, ...]] = {
    "VehicleAge": ("RegistrationYear",),
    "HasClaim": (CLAIMS,),
    "LossRatio": (CLAIMS, PREMIUM),
    "PremiumPerSumInsured": (PREMIUM, "SumInsured"),
    "ClaimFrequency": ("HasClaim", "PolicyID"),
    "AvgClaimAmount": (CLAIMS, "PolicyID"),
    "IsHighValue": ("SumInsured",),
    "TransactionYear": ("TransactionMonth",),
    "TransactionQuarter": ("TransactionMonth",),
    "VehicleAgeGroup": ("VehicleAge",),
}

# Right-closed bins (after, up to and including, label): fixed values.
AGE_GROUPS = (
    (-1, 3, "New (0-3)"),
    (3, 7, "Mid (4-7)"),
    (7, 12, "Old (8-12)"),
    (12, 100, "Very Old (13+)"),
)


def vehicle_age(as_of_year: int, column: str = "RegistrationYear") -> Column:
    year = F.col(column)
    return F.when(year.isNotNull(), F.greatest(F.lit(as_of_year) - year, F.lit(0)))


def age_group(column: str = "VehicleAge") -> Column:
    age = F.col(column)
    out = None
    for low, high, label in AGE_GROUPS:
        inside = (age > low) & (age <= high)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def derive_features(
    df: DataFrame,
    features: Sequence[str] | None = None,
    as_of_year: int | None = None,
    accuracy: int | None = None,
) -> DataFrame:
    """Add the requested features; one whose inputs are missing is skipped.

    ``as_of_year`` defaults to the current year.  Existing columns of the same name
    are replaced.
    """
    wanted = set(features) if features else set(FEATURES)
    unknown = wanted - set(FEATURES)
    if unknown:
        raise ValueError(f"Unknown features: {sorted(unknown)}")
    year = as_of_year if as_of_year is not None else date.today().year
    have = set(df.columns)
    build = []
    for name, inputs in FEATURES.items():
        if name in wanted and have.issuperset(inputs):
            build.append(name)
            have.add(name)

    out = df
    row_wise = {
        "VehicleAge": lambda: vehicle_age(year),
        "HasClaim": lambda: has_claim().cast("int"),
        "LossRatio": lambda: F.try_divide(CLAIMS, PREMIUM),
        "PremiumPerSumInsured": lambda: F.try_divide(PREMIUM, "SumInsured"),
        "TransactionYear": lambda: F.year("TransactionMonth"),
        "TransactionQuarter": lambda: F.quarter("TransactionMonth"),
    }
    added = {n: make() for n, make in row_wise.items() if n in build}
    if "IsHighValue" in build:
        cut = quantile_values(df, {"SumInsured": [0.75]}, accuracy)["SumInsured", 0.75]
        high = F.lit(False) if cut is None else F.coalesce(F.col("SumInsured") > cut, F.lit(False))
        added["IsHighValue"] = high.cast("int")
    if added:
        out = out.withColumns(added)
    if "VehicleAgeGroup" in build:
        out = out.withColumn("VehicleAgeGroup", age_group())
    return _per_policy(out, [n for n in ("ClaimFrequency", "AvgClaimAmount") if n in build])


def _per_policy(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Averages per policy joined back, both from one aggregation.

    Aggregate and join rather than a window: the aggregate combines before its
    shuffle and AQE splits a hot policy's join partition, while a window would hold
    all rows of a policy in one task.
    """
    if not names:
        return df
    source = {"ClaimFrequency": "HasClaim", "AvgClaimAmount": CLAIMS}
    averages = (
        df.dropna(subset=["PolicyID"])
        .groupBy(F.col("PolicyID").alias("__policy"))
        .agg(*[F.avg(source[n]).alias(n) for n in names])
    )
    return df.drop(*names).join(averages, F.col("PolicyID") == F.col("__policy"), "left").drop(
        "__policy"
    )
