import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from treeline.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "treeline-tests", spark__sql__shuffle__partitions="3")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def corpus(spark):
    """Builds a corpus table from ``{path: bytes | str | None}`` or ``[(repo, path, content)]``."""

    def build(files, repo="r"):
        rows = [(repo, p, c) for p, c in files.items()] if isinstance(files, dict) else files
        data = [(r, p, len(_bytes(c) or b""), _bytes(c)) for r, p, c in rows]
        return spark.createDataFrame(data, "repo_id string, path string, size bigint, content binary")

    return build


def _bytes(content):
    return content.encode() if isinstance(content, str) else content


PROJECT = {
    "README.md": "README.md\n\n",
    "file_1.txt": "file_1.txt\n\n",
    "file_2.txt": "file_2.txt\n\n",
    "folder_1/file_3.txt": "folder_1/file_3.txt\n\n",
    "folder_2/file_4.txt": "folder_2/file_4.txt\n\n",
}


@pytest.fixture(scope="session")
def project(corpus):
    return corpus(PROJECT)
