"""One local session for all tests."""

import datetime
import decimal
import math
import os
import sys
from pathlib import Path

import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # Python workers import the package, too
os.environ["TZ"] = "UTC"

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from wattmill.session import build_session

    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """A value as text, times to the microsecond; numbers that aren't whole stay."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or value is pd.NA or value != value:
        return "~"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(str, map(plain, value))) + "]"
    if isinstance(value, (decimal.Decimal, float)):
        value = float(value)
        return str(int(value)) if math.isfinite(value) and value == int(value) else value
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value).replace(" 00:00:00", "")
    return str(value)


def near(a, b) -> bool:
    """Equal, or numbers (a whole one among them, perhaps) within a relative 1e-9."""
    if a == b:
        return True
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-9)
    except ValueError:
        return False


def same(left, right) -> None:
    """Two pandas frames hold the same rows in any order: texts, times and whole numbers exactly, others within a relative 1e-9."""
    assert sorted(left.columns) == sorted(right.columns)
    columns = sorted(left.columns)
    rows = [[tuple(plain(v) for v in r) for r in f[columns].astype(object).itertuples(index=False, name=None)] for f in (left, right)]
    assert len(rows[0]) == len(rows[1]), (len(rows[0]), len(rows[1]))
    number = [any(isinstance(r[k], float) for side in rows for r in side) for k in range(len(columns))]
    coarse = lambda v: f"{float(v):.6g}" if v != "~" else v
    order = lambda r: ([v for v, n in zip(r, number) if not n], [coarse(v) for v, n in zip(r, number) if n])
    for a, b in zip(sorted(rows[0], key=order), sorted(rows[1], key=order)):
        odd = {c: (x, y) for c, x, y, n in zip(columns, a, b, number) if not (near(x, y) if n else x == y)}
        assert not odd, odd
