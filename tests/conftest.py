"""One session and one demo tree for all tests."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TREE = {
    "README.md": "# demo\n",
    "script": "#!/usr/bin/env python3\nimport os\n",
    ".gitignore": "*.log\nsecret.txt\nignored/\n",
    "app.log": "x\n",
    "secret.txt": "x\n",
    ".env": "KEY=1\n",
    ".env.example": "KEY=\n",
    "package-lock.json": "{}\n",
    "node_modules/x.js": "var a;\n",
    "logo.png": "\x00\x01",
    "big.py": "x = 1\n" * 300_000,
    "pyapp/__init__.py": 'from .core import Engine\n\n__all__ = ["Engine"]\n',
    "pyapp/core.py": "from .helpers import render\n\nLENGTH = 3\n\n\nclass Engine:\n    def run(self):\n        return self.step()\n\n    def step(self):\n        return render(1)\n\n    def noisy(self):\n        total = len([1])\n        return len([total])\n",
    "pyapp/helpers.py": "from .utils import fmt\n\n\ndef render(x):\n    return fmt(x)\n",
    "pyapp/utils.py": 'PREFIX = "a"\n\n\ndef fmt(x):\n    return PREFIX\n',
    "pyapp/cycle_a.py": "from .cycle_b import bee\n\n\ndef aye():\n    return bee()\n",
    "pyapp/cycle_b.py": "from .cycle_a import aye\n\n\ndef bee():\n    return aye()\n",
    "pyapp/tests/test_core.py": "from pyapp.core import Engine\nfrom pyapp.helpers import render\n\n\ndef test_run():\n    engine = Engine()\n    assert engine.run() == render(1)\n",
    "web/helper.ts": "export function helper(x: number) {\n  return x;\n}\n",
    "web/index.ts": "import { helper } from './helper';\n\nexport interface Options {\n  a: string;\n}\n\nexport class Runner {\n  name = 'x';\n  run() {\n    return helper(1);\n  }\n}\n\nexport function main() {\n  const runner = new Runner();\n  return runner.run();\n}\n",
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tree(tmp_path_factory) -> str:
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text.encode())
    (root / "link.py").symlink_to(root / "script")
    return str(root)


@pytest.fixture(scope="session")
def index(spark, tree):
    from graphloom.plans.engine import Engine

    return Engine(spark).index(tree, "demo")
