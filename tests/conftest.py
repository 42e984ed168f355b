import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from corpusforge.session import get_spark
    s = get_spark("local[4]", app="corpusforge-tests", shuffle_partitions=8,
                  conf={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="cf-test-ckpt-")})
    yield s
    s.stop()
