import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
sys.path.insert(0, ROOT)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sparkmart.session import session

    found = session(cores=4, shuffle_partitions=4, memory="4g")
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


@pytest.fixture(scope="session")
def shop(spark):
    from sparkmart.plans import Graph
    from sparkmart.sources import Source
    from sparkmart.sources.fixture import shop

    made = shop(spark)
    cached = {n: made.table(n).cache() for n in made.make}
    return Graph(Source({n: (lambda n=n: cached[n]) for n in cached}), spark)


@pytest.fixture(scope="session")
def data():
    return DATA
