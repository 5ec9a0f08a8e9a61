import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from chronoloom.session import session

    s = session("tests", "local[4]", spark__sql__shuffle__partitions="2", spark__default__parallelism="2", spark__driver__memory="3g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make(spark):
    """A TimeSeries of {key: (labels, [(ts, value)…])}; options of a series may follow."""
    from chronoloom.model import CATALOG, TimeSeries, series_row

    def build(spec):
        rows, cat = [], []
        for key, (labels, samples, *options) in spec.items():
            rows += [(key, t, float(v)) for t, v in samples]
            cat.append(series_row(key, labels, **(options[0] if options else {})))
        return TimeSeries(spark.createDataFrame(rows, "series_key string, ts long, value double"), spark.createDataFrame(cat, CATALOG))

    return build


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
