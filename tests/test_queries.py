"""Every query of the library against its SQL."""

import pytest
from support import SF, same

from pixelframe.plans.queries import ORACLE_SQL, QUERIES

needs_data = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(SF))
    if name in ORACLE_SQL:
        same(got, duck, ORACLE_SQL[name])
    else:
        assert got.count() >= 0


def test_entry_imports_without_the_training_data_operators():
    import subprocess
    import sys
    from pathlib import Path

    code = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name in ('corpus_pipeline', 'pixelframe.llm'):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert not any(k.startswith('op') or k == 'pipeline' for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
