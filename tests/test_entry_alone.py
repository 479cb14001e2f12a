"""The library and its driver contract work without the training-data part."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
for name in {missing!r}:
    sys.modules[name] = None
import __spark_entry__ as e
assert "landed_price" in e.queries() and not any(k.startswith("op") or k == "pipeline" for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_imports_without_training_data_operators():
    for missing in (["corpus_pipeline"], ["ratecard.llm"], ["corpus_pipeline", "ratecard.llm"]):
        subprocess.run([sys.executable, "-c", CODE.format(missing=missing)], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_training_data_operators():
    for p in (ROOT / "ratecard").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
