import os
import subprocess
import sys

import duckdb
import pytest

import pagewright.plans.parts  # noqa: F401  (registers its queries and SQL)
from pagewright.plans.catalogue import QUERIES
from pagewright.plans.oracles import SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.execute(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
    return c


def plain(rows):
    return sorted(str(tuple(float(v) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    names = ", ".join(f'"{c}"' for c in df.columns)
    assert plain(df.collect()) == plain(duck.execute(f"select {names} from ({SQL[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_lossless(spark, sf_dir):
    assert QUERIES["allocate_chunks"](spark, sf_dir).where("not lossless").count() == 0


def test_greedy_matches_are_one_to_one(spark, sf_dir):
    df = QUERIES["rect_line_match_greedy"](spark, sf_dir)
    assert df.count() == df.select("doc_id", "page", "order").distinct().count() == df.select("doc_id", "page", "rect_no").distinct().count()


@pytest.mark.parametrize("gone", [("corpus_pipeline.py",), ()])
def test_entry_works_without_the_llm_folders(tmp_path, gone):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in os.listdir(repo):
        if name not in (*gone, ".git", "pagewright", "tests"):
            os.symlink(f"{repo}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "pagewright")
    for name in os.listdir(f"{repo}/pagewright"):
        if name != "llm":
            os.symlink(f"{repo}/pagewright/{name}", tmp_path / "pagewright" / name)
    os.remove(tmp_path / "__spark_entry__.py")
    with open(f"{repo}/__spark_entry__.py") as f:
        (tmp_path / "__spark_entry__.py").write_text(f.read())
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(n for n in q if n.startswith('op') or n == 'pipeline'), set(e.oracle_sql()) <= set(q))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert out.stdout.split(" ", 1)[1].strip() == "[] True", out.stderr
