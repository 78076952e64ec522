import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from corpusloom.session import build_session

    s = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions=4, spark__driver__memory="3g", spark__checkpoint__dir="file://" + str(tmp_path_factory.mktemp("shared")), spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse"))
    )
    yield s
    s.stop()
