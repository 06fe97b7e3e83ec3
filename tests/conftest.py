import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from blockloom.session import session

    folder = tempfile.mkdtemp(prefix="blockloom-test-")
    s = session(
        "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__checkpoint__dir=f"file://{folder}/checkpoints",
        spark__sql__warehouse__dir=f"{folder}/warehouse", spark__driver__memory="4g",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
