import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from candela.session import BASE_CONF, checkpoint_dir, ship_package
    b = (SparkSession.builder.master("local[4]").appName("candela-tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g"))
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF0001
