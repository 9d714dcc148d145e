import os
import sys
import tempfile
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = os.environ.get("KOLEKTA_TEST_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from kolekta.session import build_session
    s = build_session("local[4]", 4, app="kolekta-tests")
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    """A fresh local folder for tests that write (tests run on one machine)."""
    return tempfile.mkdtemp(prefix="kolekta-test-")


def invoices(spark, rows, cols=("invoice_id", "aging_category", "status_tagih", "region", "invoice_status", "nilai_m")):
    """Canonical invoice DataFrame from a few tuples; other columns null."""
    from kolekta import schemas
    from pyspark.sql import functions as F
    data = [tuple(Decimal(str(v)) if c == "nilai_m" and v is not None else v for c, v in zip(cols, r)) for r in rows]
    types = {f.name: f.dataType.simpleString() for f in schemas.INVOICE.fields}
    df = spark.createDataFrame(data, ", ".join(f"{c} {types[c]}" for c in cols))
    return schemas.conform(df).withColumn("invoice_id", F.col("invoice_id"))
