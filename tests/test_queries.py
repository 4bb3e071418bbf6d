"""Every query of the catalog against its SQL, at the smallest size."""

import os

import duckdb
import pytest

from weft.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = ordered(df.select(*cols).collect())
    if name not in catalog.ORACLES:
        assert got
        return
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == cols
    want = ordered(duck.sql(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLES[name]})").fetchall())
    assert got == want


def run_in_copy(tmp_path, code, *gone):
    """Runs code in a copy of the repository without the paths in ``gone``."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here, copy = Path(__file__).resolve().parents[1], tmp_path / "copy"
    shutil.copytree(here, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache"))
    for g in gone:
        shutil.rmtree(copy / g) if (copy / g).is_dir() else (copy / g).unlink()
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout


CORE = "import __spark_entry__ as e; from weft.plans import catalog; q, o = e.queries(), e.oracle_sql(); assert set(catalog.QUERIES) <= set(q) and set(catalog.ORACLES) <= set(o); print(len(set(q) - set(catalog.QUERIES)))"


def test_entry_without_llm(tmp_path):
    """Both folders and the pipeline really deleted: the rest imports, and tests are found."""
    code = CORE + "; import subprocess, sys; r = subprocess.run([sys.executable, '-m', 'pytest', 'tests', '-q', '--collect-only'], capture_output=True, text=True); assert r.returncode == 0 and 'tests/llm' not in r.stdout, r.stdout[-2000:]"
    assert run_in_copy(tmp_path, code, "weft/llm", "tests/llm", "corpus_pipeline.py").split() == ["0"]


def test_entry_without_a_package(tmp_path):
    """Where a package that one operator needs is missing, the queries are there all the same."""
    block = "import sys; sys.modules.update(dict.fromkeys(('tokenizers', 'public_tokenizers', 'regex', 'xxhash')))\n"
    block = "import sys\nfor m in ('tokenizers', 'public_tokenizers', 'regex'): sys.modules[m] = None\n"
    assert int(run_in_copy(tmp_path, block + CORE)) >= 0
