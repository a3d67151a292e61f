"""Registered queries: SQL twins, the pipeline's stages, and independence of the rest."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from brinefield.llm import queries

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def con():
    sys.path.insert(0, str(ROOT / "tests"))
    from parity import connect
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, con, name):
    from parity import compare
    assert compare(queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()) == ""


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    from brinefield.llm import exact_dedup, jaccard_join, mixing, toxicity
    from brinefield.llm.common import documents, labels
    from brinefield.runtime import cut
    docs = documents(spark, SF)
    kept = docs
    for name, stage in cp.STAGES:
        out = cut(stage(spark, kept, SF))
        ids = Counter(r.doc_id for r in out.select("doc_id").collect())
        if name == "toxicity":
            want = Counter(r.doc_id for r in toxicity.verdicts(kept, labels(spark, SF)).filter("score < 0.5").collect())
        elif name == "exact_dedup":
            want = Counter(r.doc_id for r in exact_dedup.exact_groups(kept).filter("kept").collect())
        elif name == "jaccard_join":
            want = Counter(r.doc_id for r in jaccard_join.near_copies(kept, 5, 80).filter("doc_id = component_id").collect())
        else:
            want = Counter({r.doc_id: r.copies for r in mixing.mix(kept).collect() if r.copies} if name == "mix" else Counter(r.doc_id for r in kept.select("doc_id").collect()))
        assert ids == want, name
        if name != "byte_bpe":
            assert out.columns == docs.columns
        kept = out
    assert kept.columns == ["doc_id", "n_tokens", "ids", "offsets", "decoded_sha256"]


def test_the_rest_imports_without_this_package(tmp_path):
    import shutil
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not [n for n in q if n.startswith('op')] and 'pipeline' not in q; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=copy).returncode == 0
