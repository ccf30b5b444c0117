import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """Scratch folder of the operators, as a cluster would name it."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (id, text) or full rows, with a column whose name clashes with results."""

    def make(rows, **more):
        full = [(r + (None,) * (5 - len(r))) + ("x",) for r in rows]
        return spark.createDataFrame(full, DOCS + ", score string").repartition(3)

    return make
