import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]
CLASH = "component_id string, row string, id string, score string, copies string, kept string, blob string, spans string, mix_shard string, size string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text, source), with further columns whose names the operators use themselves."""

    def make(rows, clash=True):
        full = [(i, t, "en", s, None if t is None else len(t), *(["x"] * 10 if clash else [])) for i, t, s in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint" + (f", {CLASH}" if clash else ""))

    return make


