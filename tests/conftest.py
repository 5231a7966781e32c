import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from shroud.session import get_session

    s = get_session(master="local[*]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def detect_texts(spark):
    """Run the detect plan once over a list of texts; returns {text_index: [entity rows]}."""
    from shroud.plans.detect import detect

    def run(texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        out = {i: [] for i in range(len(texts))}
        for r in detect(df).orderBy("doc_id", "start").collect():
            out[r.doc_id].append(r)
        return out

    return run
