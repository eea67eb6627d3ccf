import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from codecensus.session import local_session

    s = local_session("4", 4, "tests")
    s.sparkContext.setLogLevel("OFF")
    # Fixtures hold a handful of rows: compiling the large rule expressions costs far more
    # than interpreting them. Queries and benchmarks run with code generation as usual.
    s.conf.set("spark.sql.codegen.wholeStage", "false")
    s.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    s.conf.set("spark.sql.adaptive.enabled", "false")
    s.conf.set("spark.sql.shuffle.partitions", "2")
    return s
