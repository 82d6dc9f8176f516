import tempfile

import pytest


@pytest.fixture(scope="session")
def lake(spark):
    """The session with a shared folder, as a cluster names one."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='run-')}")
    return spark
