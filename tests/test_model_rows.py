from pathlib import Path

import pytest

from ledgerline import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the generated tables are not here")


def test_models_see_whole_embeddings(spark):
    rows = core._training_rows(spark, SF).collect()
    assert rows and all(len(r.f) == 64 for r in rows)
