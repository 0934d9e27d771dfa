import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskweft.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        master="local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def policies(spark):
    """1000 policies from a hash of the row number, with planted nulls and extremes."""
    return spark.sql(
        """
        SELECT CAST(id % 400 AS INT) AS PolicyID, CAST(id AS INT) AS LineNo,
               timestamp_ntz'2014-02-01' + make_dt_interval(CAST(id AS INT)) AS TransactionMonth,
               CASE WHEN id % 20 = 3 THEN NULL WHEN id % 100 = 7 THEN 50000D
                    ELSE 100 + pmod(xxhash64(id, 1), 40000) / 100D END AS TotalPremium,
               CASE WHEN pmod(xxhash64(id, 2), 10) < 7 THEN 0D
                    ELSE pmod(xxhash64(id, 3), 300000) / 100D END AS TotalClaims,
               CAST(10000 + pmod(xxhash64(id, 4), 90000) AS DOUBLE) AS SumInsured,
               CAST(2000 + pmod(xxhash64(id, 5), 15) AS INT) AS RegistrationYear,
               CASE WHEN id % 33 = 5 THEN NULL ELSE
                 element_at(array('Gauteng', 'Western Cape', 'Limpopo', 'Free State'),
                            CAST(1 + pmod(xxhash64(id, 6), 4) AS INT)) END AS Province,
               element_at(array('Sedan', 'Truck', 'Bus'),
                          CAST(1 + pmod(xxhash64(id, 7), 3) AS INT)) AS VehicleType,
               IF(pmod(xxhash64(id, 8), 2) = 0, 'Male', 'Female') AS Gender
        FROM range(1000)
        """
    ).cache()
