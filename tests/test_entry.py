import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["pos", "id", "image", "brand", "brand_label", "title", "price", "liked"]


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_llm_folders(tmp_path):
    """The rest imports and registers its queries when the llm folders and the pipeline are gone."""
    (tmp_path / "millrace").mkdir()
    for p in (ROOT / "millrace").iterdir():
        if p.name != "llm":
            (tmp_path / "millrace" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; assert 'feed' in e.queries() and not any(n.startswith('op') for n in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True)
