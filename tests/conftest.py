import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def graph(spark):
    """A graph from a text such as ``A>B:2 B>C`` (directed) or ``A-B C-D`` and further labels."""
    from loomgraph.model import Graph

    def build(text: str, labels=()):
        directed = ">" in text
        rows = []
        for token in text.split():
            ends, _, weight = token.partition(":")
            a, b = ends.split(">" if directed else "-")
            rows.append((a, b, float(weight or 1)))
        return Graph.from_list(spark, rows, directed=directed, labels=list(labels))

    return build


def by_label(g, df, value):
    return {r[0]: r[1] for r in g.labelled(df).select("label", value).collect()}
