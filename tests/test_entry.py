import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_flagship_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_text_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name == "sylvan.llm" or name.startswith("sylvan.llm."):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.llm_queries is None and e.corpus_pipeline is None
assert "pipeline" not in e.queries() and not any(q.startswith("op") for q in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
import sylvan.__main__, sylvan.streaming.recluster, sylvan.sources.graph_files
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_a_module_that_the_subpackage_misses_is_an_error():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "sylvan.llm.common":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import importlib.util
if importlib.util.find_spec("sylvan.llm") is not None:
    try:
        import __spark_entry__
    except ModuleNotFoundError as e:
        assert e.name == "sylvan.llm.common"
    else:
        raise AssertionError("imported")
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_workers_find_the_package_from_elsewhere(tmp_path):
    """A session started in another folder, without PYTHONPATH, runs queries with Python workers."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.queries()["path_unit_dendrogram"](spark, "").count() == 999
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=240)
