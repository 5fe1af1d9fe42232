"""Given tables are read against their declared columns."""

import pytest
from pyspark.sql import functions as F

from piste.sources import driver
from tests.conftest import SF_SMALL


def test_every_given_table_meets_its_declaration(spark):
    for name in driver.DRIVER_TABLES:
        assert driver.read_table(spark, SF_SMALL, name).columns


def test_missing_and_mistyped_columns_are_errors(spark):
    nation = driver.read_table(spark, SF_SMALL, "nation")
    assert driver.checked(nation.withColumn("more", F.lit(1)), "nation").columns[-1] == "more"
    with pytest.raises(ValueError, match="n_regionkey is missing"):
        driver.checked(nation.drop("n_regionkey"), "nation")
    with pytest.raises(ValueError, match="n_name is int"):
        driver.checked(nation.withColumn("n_name", F.lit(1)), "nation")
