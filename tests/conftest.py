import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from erario.session import get_spark

    s = get_spark(master="local[4]", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="erario-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture()
def tmp_root():
    return tempfile.mkdtemp(prefix="erario-test-")


def land(root, run, source, municipio, year, month, status, body, name="body.json"):
    """Write one landed response file in the payload layout."""
    d = os.path.join(root, f"run={run}", f"source={source}", f"municipio_id={municipio}",
                     f"year={year}", f"month={month:02d}", f"http_status={status}")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "w", encoding="utf-8") as f:
        f.write(body)
