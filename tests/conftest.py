import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tallyloom.session import local_session

    return local_session(8, "tests")


@pytest.fixture(scope="session")
def sf():
    return SF


def make(spark, pdf, schema=None):
    """Spark rows of a pandas frame, nulls as nulls."""
    import pandas as pd

    rows = [tuple(None if v is None or v is pd.NaT or v != v else v for v in r)
            for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, schema or list(pdf.columns))
