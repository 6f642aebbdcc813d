"""Plans carry the package's functions with them."""

import os
import shutil
import subprocess
import sys

from pyspark.cloudpickle import cloudpickle

from spindrift.functions import text as tx
from spindrift.operators import rewards as rw


def test_functions_run_where_the_package_is_not_installed(tmp_path):
    job = {"score": rw.score_temporal, "fold": tx.fold_text}
    (tmp_path / "job.bin").write_bytes(cloudpickle.dumps(job))
    code = (
        "import pickle, sys; job = pickle.load(open('job.bin', 'rb')); "
        "assert 'spindrift' not in sys.modules; "
        "print(job['fold'](' A  B '), job['score']({'ground_truth': {'time': [1, 3]}, 'response': '<answer>1 to 3</answer>'})['overall'])"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert out.stdout.split() == ["a", "b", "1.0"]


def test_llm_is_optional_and_not_imported_by_the_library():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, '.'); import spindrift.plans.catalog as c; "
        "import spindrift.operators.build, spindrift.streaming.scoring, spindrift.sources.sinks; "
        "assert not any(m.startswith('spindrift.llm') for m in sys.modules); print(len(c.queries()))"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert int(out.stdout) > 100


def test_entry_works_without_the_optional_folders(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/spindrift", tmp_path / "spindrift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    for names in (["__spark_entry__.py", "corpus_pipeline.py"], ["__spark_entry__.py"]):
        for name in ("__spark_entry__.py", "corpus_pipeline.py"):
            (tmp_path / name).unlink(missing_ok=True)
        for name in names:
            if os.path.exists(f"{root}/{name}"):
                shutil.copy(f"{root}/{name}", tmp_path / name)
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
        n, sql, optional = map(int, out.stdout.split())
        assert n > 100 and sql > 100 and optional == 0
