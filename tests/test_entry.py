"""The entry points without the corpus operators."""

import subprocess
import sys
from pathlib import Path

from stepfall.jobs import JOBS_BY_NAME

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') for k in e.queries()))"


def _shown(before):
    got = subprocess.run([sys.executable, "-c", before + SHOW], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True)
    return [int(n) for n in got.stdout.split()]


def test_a_missing_library_costs_the_corpus_queries_only():
    assert _shown("import sys; sys.modules['tiktoken'] = None; ") == [len(JOBS_BY_NAME), len(JOBS_BY_NAME), 0]


def test_a_missing_folder_costs_the_corpus_queries_only():
    for name in ("stepfall.llm", "corpus_pipeline"):
        assert _shown(f"import sys; sys.modules['{name}'] = None; ") == [len(JOBS_BY_NAME), len(JOBS_BY_NAME), 0]
