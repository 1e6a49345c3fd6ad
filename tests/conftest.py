import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dbgauge.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "dbgauge-tests",
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def write(tmp_path):
    """Write text files below a new folder and return its path."""

    def _write(**files):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        for name, text in files.items():
            data = text if isinstance(text, bytes) else text.encode()
            (folder / name.replace("__", ".")).write_bytes(data)
        return str(folder)

    return _write


def rows(frame):
    return [row.asDict(recursive=True) for row in frame.collect()]
