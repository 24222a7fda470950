import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_imports_without_the_text_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT / "stopwise", tmp_path / "stopwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'copy_assessment' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert "state" in df.columns and df.count() > 0
