import importlib
import subprocess
import sys

from conftest import ROOT


def test_queries_and_sql_have_the_same_names():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 34


def test_flagship(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0


def test_core_stands_alone(tmp_path):
    """Without the training-data subpackage and the pipeline the entry module still has its own queries."""
    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('graftline.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert 'cluster_summary' in q and not any(x.startswith('op') or x == 'pipeline' for x in q), list(q)\n"
        "e.oracle_sql()\n"
        "assert not any(m.startswith('graftline.llm') for m in sys.modules)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
