import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[2]), str(Path(__file__).parent)]


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
