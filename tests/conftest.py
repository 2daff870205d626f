import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from furrow.session import session

    shared = tmp_path_factory.mktemp("shared")
    s = session("local[8]", 8, spark__ui__enabled="false", spark__driver__memory="4g", spark__checkpoint__dir=f"file://{shared}", spark__ui__showConsoleProgress="false", spark__sql__execution__arrow__pyspark__enabled="true")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
