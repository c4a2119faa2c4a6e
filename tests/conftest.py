import os
import sys

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablescope.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("work")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def messy_sales(spark):
    """Five untidy sales rows with every kind of defect; rows 4 and 5 are equal."""
    names = ["Order_ID", "Order_Date", "Customer", "Province", "Product_Code", "Product",
             "Quantity", "Unit_Price_USD", "Discount_Pct", "Tax_Pct", "Total_Amount_USD", "Status"]
    numbers = {"Quantity", "Discount_Pct"}
    schema = T.StructType([
        T.StructField(n, T.LongType() if n in numbers else T.StringType()) for n in names])
    rows = [
        ("ORD-1001", "2026-01-10", "پارس‌ صنعت", "تهران", "P-104", "فروسیلیس",
         10, "1,250.50", 0, "10%", "12505 USD", "تکمیل‌ شده"),
        ("ORD-1002", "2026-02-14", "پارس صنعت ", "اصفهانن", "P-105", "کک متالورژی",
         20, "800", 5, "10%", "16000 USD", "لغو شده"),
        ("ORD-1003", "1405/02/31", "فولاد جنوب", "اصفهان", "P-104", "فروسیلیس",
         30, "2,000", 10, "9%", "60000 USD", "در انتظار پرداخت"),
        ("ORD-1004", "2026-04-02", "فولاد جنوب", "تهران", "P-106", "بنتونیت",
         40, "1500", 0, "10%", "60000 USD", "تکمیل شده"),
        ("ORD-1004", "2026-04-02", "فولاد جنوب", "تهران", "P-106", "بنتونیت",
         40, "1500", 0, "10%", "60000 USD", "تکمیل شده"),
    ]
    return spark.createDataFrame(rows, schema)
