"""Each stage of the pipeline against brute force on its own input."""

import re

import pytest

import corpus_pipeline
from lexgrid.llm import leaks, secrets
from tests.llm.test_pages import check_packed
from tests.llm.test_setjoin import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Documents with odd rows added, then what each stage returns, written and read again."""
    at = tmp_path_factory.mktemp("stages")
    real = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, "the of and with that erthe thing ering " * 12, None, None, None), (900_001, None, None, "src1", 0), (900_002, "", "en", "src1", 0), (900_003, "12 34 !!", "en", "src1", 8), (0, real.filter("doc_id = 0").first().text, "fr", "src0", 1)]
    frame = real.unionByName(spark.createDataFrame(odd, real.schema))
    out = [frame]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{at}/{k}")
        out.append(spark.read.parquet(f"{at}/{k}"))
    return [f.collect() for f in out]


def test_columns(stages):
    assert all(rows[0].__fields__ == stages[0][0].__fields__ for rows in stages[:-1])


def test_languages(stages):
    gone = [r for r in stages[0] if r not in stages[1]]
    assert {r.doc_id for r in gone} == {900_001, 900_002, 900_003}


def test_copies(stages):
    groups = {}
    rows = [(k, r.text) for k, r in enumerate(stages[1])]
    for k, _, c in brute(rows, 5, 80, 100):
        groups.setdefault(c, []).append(stages[1][k].doc_id)
    want = sorted((min((d for d in g if d is not None), default=None) for g in groups.values()), key=str)
    assert sorted((r.doc_id for r in stages[2]), key=str) == want and len(want) < len(rows)


def test_leaks(spark, stages):
    items = [leaks.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda r: any(re.search(rb"\b" + b" ".join(w) + rb"\b", b" ".join(leaks.words_of(r.text))) for w in items)
    gone = {r.doc_id for r in stages[2]} - {r.doc_id for r in stages[3]}
    assert {r.doc_id for r in stages[2] if holds(r)} <= gone and len(gone) <= 0.2 * len(stages[2])
    assert not any(holds(r) for r in stages[3])


def test_secrets(stages):
    owners = {}
    for r in stages[3]:
        for f in secrets.findings(r.text):
            owners.setdefault(f["secret"], set()).add(r.source or "")
    live = {r.doc_id for r in stages[3] if any(f["looks_live"] and len(owners[f["secret"]]) == 1 for f in secrets.findings(r.text))}
    assert sorted((r.doc_id for r in stages[4]), key=str) == sorted((r.doc_id for r in stages[3] if r.doc_id not in live), key=str)


def test_packed(stages):
    assert {r.doc_id for r in stages[5]} == {r.doc_id for r in stages[4]}
    n = check_packed(stages[5], 2048)
    assert n <= 1.05 * -(-sum(r.length for r in stages[5]) // 2048) + 1


def test_run(spark):
    assert corpus_pipeline.ORACLE_SQL is None and corpus_pipeline.run(spark, SF).count() > 0


def test_leaks_are_fitted_on_every_row(spark, monkeypatch):
    import numpy as np

    seen = []

    def look(rows, bench, *_):
        seen.append(rows.count())
        return np.zeros((len(bench.vocabulary), 1), np.float32)

    monkeypatch.setattr(leaks, "latent_basis", look)
    docs = spark.range(1300).selectExpr("id as doc_id", "concat('the of ', id) as text")
    assert corpus_pipeline.drop_leaks(spark, docs, SF).count() == 1300 and seen == [1300]
