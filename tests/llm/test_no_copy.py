"""All queries of the subpackage work where the workers cannot import the package."""

import os
import subprocess
import sys
from pathlib import Path

from askgrid.llm import registry

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(registry.__file__).resolve().parents[2]


def test_executors_need_no_copy_of_the_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
        "from askgrid.llm import registry\n"
        "from askgrid.session import local_session\n"
        "spark = local_session(4)\n"
        "failed = []\n"
        "for name, query in registry.all_queries().items():\n"
        "    try:\n"
        f"        query(spark, {FOLDER!r}).write.format('noop').mode('overwrite').save()\n"
        "    except Exception as error:\n"
        "        failed.append((name, str(error)[-300:]))\n"
        "assert not failed, failed\n"
    )
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=environment, timeout=900, capture_output=True)
    assert done.returncode == 0, done.stderr[-2000:]
