import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from doclens.session import local_session

    return local_session("tests", 8)


@pytest.fixture
def docs(spark):
    """A small corpus with a long document, an empty one and an unlabelled one."""
    rows = [
        (1, "The cat sat. The cat ran!", ["pets", "en"], "train"),
        (2, "Cocoa 1,000.5 tonnes, the price fell", ["cocoa"], "train"),
        (3, "", [], "train"),
        (5, "the the the dog", ["pets"], "test"),
        (6, "grain price rose. " * 80, ["grain", "cocoa"], "train"),
        (10, "unseen words only", [], "test"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, topics array<string>, split string")
