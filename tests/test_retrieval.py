"""Retrieval, graphs, metrics and tests of significance on hand-made rows."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrid.operators import experiment, graph, metrics, retrieval
from lexgrid.sources import tables
from lexgrid.streaming.ingest import ingest_new


def test_dense(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CHUNK", 7)
    monkeypatch.setattr(retrieval, "QUERIES", 3)
    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 8)).round(2)
    v[5] = v[4]
    v[9] = 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    got = {}
    for r in retrieval.dense_topk(rows.filter("id < 8").withColumnRenamed("id", "query_id"), rows, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
    sims = np.round(unit @ unit.T, 12)
    for q in range(8):
        assert [i for _, i in sorted(got[q])] == np.lexsort((np.arange(60), -sims[q]))[:5].tolist()


def test_bm25_and_fusion(spark):
    pool = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (1, 12, 0.7, 3)], "query_id int, id int, sim double, rank int")
    texts = spark.createDataFrame([(10, "none here"), (11, "tax law tax"), (12, "")], "id int, text string")
    lex = retrieval.bm25_pool(pool, spark.createDataFrame([(1, "Tax tax LAW absent")], "query_id int, text string"), texts)
    got = {r.id: r.bm25 for r in lex.collect()}
    avg, idf = 5 / 3, math.log(1 + 2.5 / 1.5)
    want = sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * 3 / avg)) for tf in (2, 1))
    assert got[10] == got[12] == 0.0 and abs(got[11] - want) < 1e-8
    fused = retrieval.fuse(pool, lex, 3).orderBy("rank").collect()
    assert [r.id for r in fused] == [10, 11, 12]  # 10 and 11 tie at 1/60 + 1/61: the smaller id
    assert abs(fused[0].fused - (1 / 60 + 1 / 61)) < 1e-9


def test_graph(spark):
    refs = spark.createDataFrame([(1, 2, "1"), (1, 2, "2"), (1, 2, "2"), (2, 3, None), (3, 4, None), (4, 99, None), (5, 5, None)], "src int, dst int, ayat string")
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "id int")
    e = graph.build_edges(refs, nodes, "ayat")
    assert e.count() == 5 and graph.build_edges(e.withColumnRenamed("attr", "ayat"), nodes, "ayat").count() == 5
    assert {r.id: r.degree for r in graph.degrees(e).collect()} == {1: 2, 2: 3, 3: 2, 4: 1, 5: 2}
    got = {(r.seed, r.dst): r.hop for r in graph.expand(nodes.filter("id in (1, 5)"), e, 2).collect()}
    assert got == {(1, 2): 1, (1, 3): 2}
    assert [r.id for r in graph.orphans(nodes, e).collect()] == [6]
    assert graph.graph_stats(nodes, e).first().asDict() == {"n_vertices": 6, "n_isolated": 1, "n_edges": 5, "n_pairs": 4, "n_sources": 4, "n_targets": 4}
    assert [r.copies for r in graph.duplicate_keys(e, "src", "dst").collect()] == [2]
    stubs = graph.with_stubs(spark.createDataFrame([(1, "t")], "id int, title string"), nodes.filter("id < 3"))
    assert {(r.id, r.title) for r in stubs.collect()} == {(1, "t"), (2, None)}


def test_rerank(spark):
    seeds = spark.createDataFrame([(1, 10, 0.8), (1, 11, 0.5)], "query_id int, id int, sim double")
    reach = spark.createDataFrame([(10, 11, 1), (10, 12, 2), (11, 10, 1), (11, 12, 1)], "seed int, dst int, hop int")
    degree = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "id int, degree int")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    emb = spark.createDataFrame([(12, [1.0, 1.0])], "id int, vector array<double>")
    c = retrieval.graph_candidates(seeds, reach, degree, q, emb)
    got = {r.id: (r.sim, r.boost) for r in c.collect()}
    assert abs(got[12][0] - 0.5**0.5) < 1e-9 and abs(got[12][1] - (0.4 + 0.5) / (1 + math.log(4))) < 1e-12 and abs(got[10][1] - 0.5 / (1 + math.log(2))) < 1e-12
    ranked = retrieval.rerank(c, [0.0, 1.0], 2).collect()
    assert [r.id for r in sorted(ranked, key=lambda r: r["rank"]) if r.alpha == 0.0] == [10, 12]


def test_rerank_sorts_one_alpha_at_a_time(spark, tmp_path):
    """More alphas make more tasks, not larger ones: no candidate is repeated for all alphas before a sort."""
    n = 4000
    spark.range(n).selectExpr("id % 8 AS query_id", "id", "double(id % 97) AS sim", "double(id % 89) AS boost").coalesce(1).write.parquet(str(tmp_path / "c"))
    alphas = [0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.75, 1.0]
    out = retrieval.rerank(spark.read.parquet(str(tmp_path / "c")), alphas, 5)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.alpha, r.query_id, r["rank"]): r.id for r in out.collect()}
    for a in alphas:
        for q in range(8):
            want = sorted(range(q, n, 8), key=lambda i: (-round(i % 97 + a * (i % 89), 9), i))[:5]
            assert [got[a, q, k] for k in range(1, 6)] == want
    assert len(got) == 9 * 8 * 5


@pytest.mark.parametrize(
    "gold, hits, want",
    [
        (["a", "b"], ["a", "x", "b"], {"mrr": 1, "recall_1": 0.5, "recall_3": 1, "precision_1": 1, "precision_3": 2 / 3, "precision_5": 2 / 3, "hit_1": 1}),
        (["a"], ["x", "a"], {"mrr": 0.5, "recall_1": 0, "hit_1": 0, "hit_3": 1, "precision_20": 0.5}), ([], ["a"], {"mrr": 0, "recall_1": 0, "precision_1": 0, "hit_1": 0}), (["a"], [], {"mrr": 0, "recall_5": 0, "precision_5": 0}),
        (["a", "b"], ["a", "a", "x"], {"recall_3": 0.5, "precision_3": 2 / 3}), (["z"], ["a", "b"], {"mrr": 0, "hit_20": 0}), (["a", "a"], ["a"], {"recall_1": 1}),
    ],
)
def test_metrics(spark, gold, hits, want):
    r = spark.createDataFrame([(1, h, k) for k, h in enumerate(hits, 1)], "query_id int, id string, rank int")
    g = spark.createDataFrame([(1, x) for x in gold], "query_id int, id string")
    row = metrics.score_rows(r, g, spark.createDataFrame([(1,)], "query_id int")).first()
    assert {k: round(row[k], 9) for k in want} == {k: round(v, 9) for k, v in want.items()}


def test_gold_by_groups(spark):
    """As by pairs: ids of several groups, repeated rows, groups of one, null groups, and queries that are no rows of their group."""
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 2, 3, None])) for i in range(40)] + [(i, rng.randrange(1, 4)) for i in range(0, 40, 3)] + [(7, 2), (7, 2), (90, 9), (None, 1)]
    asked = [(i, g) for i, g in rows if i is not None and (i % 4 == 0 or i == 90)] + [(200, 1), (201, 8), (202, None)]
    pairs = [(q, i) for q, g in asked for i, h in rows if g is not None and g == h and i is not None and q != i]
    hits = [(q, rng.choice([*range(40), 90, 999]), k) for q in {q for q, _ in asked} for k in range(1, 22)] + [(4, 4, 22)]
    r, p = spark.createDataFrame(hits, "query_id long, id long, rank int"), spark.createDataFrame(pairs, "query_id long, id long")
    g = metrics.Groups(spark.createDataFrame(asked, "query_id long, group int"), spark.createDataFrame(rows, "id long, group int"))
    questions = r.select("query_id")
    want, got = (sorted(tuple(x) for x in metrics.score_rows(r, own, questions).collect()) for own in (p, g))
    assert got == want and len(got) == len({q for q, _ in asked}) and sum(x[1] for x in got) > 0
    runs = r.groupBy("query_id").agg(F.sort_array(F.collect_list("id")).alias("retrieved")).select(F.lit("s").alias("system"), "query_id", F.lit(0.5).alias("latency_s"), "retrieved")
    want, got = (sorted(tuple(x) for x in metrics.per_question(runs, own).collect()) for own in (p, g))
    assert got == want


def test_gold_pairs_are_never_made(spark, tmp_path):
    """No join of the metrics makes more rows than the hits and the rows that it reads, however large a label is."""
    from lexgrid.plans import catalog

    n = 3000
    spark.range(n).selectExpr("id AS vec_id", "array(float(id % 7), float(1)) AS embedding", "1 AS label").write.parquet(str(tmp_path / "embeddings.parquet"))
    hits = spark.range(0, n, 50).selectExpr("id AS query_id", "id + 1 AS id", "1 AS rank")
    out = metrics.score_rows(hits, catalog.gold(spark, str(tmp_path)), hits.select("query_id"))
    assert {(r.mrr, r.recall_1) for r in out.collect()} == {(1.0, 1 / (n - 1))}
    made = []

    def walk(p):
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(p.plan())
        if "Join" in p.nodeName():
            made.append(p.metrics().apply("numOutputRows").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(out._jdf.queryExecution().executedPlan())
    assert made and max(made) <= n, made


def test_best_alpha(spark):
    rows = [(0.0, 0.5, 0.1), (0.1, 0.6, 0.2), (0.2, 0.6, 0.2), (0.3, 0.6000000001, 0.1)]
    assert metrics.best_alpha(spark.createDataFrame(rows, "alpha double, recall_5 double, mrr double")).first().alpha == 0.1


def test_paired(spark):
    nan = float("nan")
    rows = [("m", "single", 0.0, 1.0), ("m", "single", 0.0, 1.0), ("m", "single", 0.0, 1.0), ("m", "multi", 0.5, 0.5), ("m", "multi", nan, 1.0), ("same", "single", 1.0, 1.0), ("same", "single", 0.5, 0.5)]
    got = {(r.metric, r.slice): r for r in metrics.paired_report(spark.createDataFrame(rows, "metric string, slice string, a double, b double")).collect()}
    assert set(got) == {("m", "all"), ("m", "single"), ("m", "multi"), ("same", "all"), ("same", "single")}
    r = got["m", "all"]
    assert (r.n, r.wins_b, r.wins_a, r.ties) == (4, 3, 0, 1) and r.mean_delta == 0.75 and r.median_delta == 1.0 and r.w_stat == 0.0
    assert round(r.wilcoxon_p, 4) == 0.0833
    assert got["same", "all"].wilcoxon_p == got["same", "all"].t_p == 1.0 and math.isnan(got["same", "all"].w_stat) and math.isnan(got["same", "all"].t_stat)


@pytest.mark.parametrize("t, df, p", [(2.228, 10, 0.05), (12.706, 1, 0.05), (1.96, 1e6, 0.05), (0.0, 5, 1.0), (2.776, 4, 0.05), (4.604, 4, 0.01)])
def test_student(t, df, p):
    assert abs(metrics.student_p(t, df) - p) < 2e-4


def test_split(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(1000)] + [(5000 + i, "c") for i in range(5)], "id long, s string")
    got = experiment.stratified_split(rows, "id", "s", 0.3, 7)
    assert {(r.s, r.split): r["count"] for r in got.groupBy("s", "split").count().collect()} == {("a", "dev"): 150, ("a", "test"): 350, ("b", "dev"): 150, ("b", "test"): 350, ("c", "dev"): 2, ("c", "test"): 3}
    assert sorted(got.collect()) == sorted(experiment.stratified_split(rows.repartition(7), "id", "s", 0.3, 7).collect())


def test_runs_and_validation(spark):
    log = spark.createDataFrame([("x", 1, 1, "a"), ("x", 1, 2, "b"), ("y", 1, 1, "c")], "system string, id int, pos int, answer string")
    assert {(r.system, r.id, r.answer) for r in experiment.latest_runs(log, ["system", "id"], F.col("pos")).collect()} == {("x", 1, "b"), ("y", 1, "c")}
    assert [r.id for r in experiment.to_run(spark.createDataFrame([("x", 1), ("x", 2)], "system string, id int"), log, ["system", "id"]).collect()] == [2]
    gold = spark.createDataFrame([(1, "a::1"), (1, "a::2"), (1, "a::3"), (2, "a::1O"), (2, "a::9")], "question int, id string")
    store = spark.createDataFrame([("a::1", "x" * 20), ("a::2", "Cukup jelas."), ("a::3", "y" * 20), ("a::1O", "z" * 20)], "id string, text string")
    have = spark.createDataFrame([("a::1",), ("a::2",), ("a::1O",)], "id string")
    assert {r.id: r.state for r in experiment.validate_gold(gold, store, have).collect()} == {"a::1": "ok", "a::2": "trivial", "a::3": "missing_graph", "a::1O": "suspicious", "a::9": "missing_store"}


def test_models(spark):
    rows = spark.createDataFrame([("a" * 9000,), ("b",), (None,)], "text string")

    def model(texts):
        if any(len(t) > 1000 for t in texts):
            raise ValueError("too long")
        return [[float(len(t))] for t in texts]

    assert sorted(r.embedding[0] for r in experiment.embed(rows, "text", model).collect()) == [0.0, 1.0, 750.0]
    assert experiment.generate(rows, "text").filter("answer is not null").count() == 0
    out = experiment.evaluate(rows, lambda q: experiment.generate(q, "text", lambda p: (p or "")[:1]), "s").collect()
    assert {r.answer for r in out} == {"a", "b", ""} and {r.system for r in out} == {"s"}


def test_contexts(spark):
    hits = spark.createDataFrame([(1, 2, "graph", "R", "2", "t2"), (1, 1, "vector", "Q", "1", "t1")], "query_id int, rank int, source string, regulation_id string, article_number string, text string")
    c = retrieval.format_contexts(hits)
    assert c.first().context == "[VECTOR] Q — Pasal 1\nt1\n\n---\n\n[GRAPH] R — Pasal 2\nt2"
    assert retrieval.build_prompts(c.withColumn("question", F.lit("why?"))).first().prompt.endswith("Pertanyaan: why?\n\nJawaban:")


def test_sources(spark, tmp_path):
    (tmp_path / "meta.json").write_text(json.dumps([{"regulation_number": "PP 1/2020", "title": "old"}, {"regulation_number": "PP 1 2020", "title": "new"}, {"title": "none"}]))
    assert [(r.file_key, r.title) for r in tables.read_metadata(spark, str(tmp_path / "meta.json")).collect()] == [("PP 1 2020", "new")]
    (tmp_path / "eval.jsonl").write_text('{"id": "q1", "question": "x", "gold_article_ids": ["a"], "level": 3}\n\n{"id": "q2", "question": "y"}\n')
    items = {r.id: r for r in tables.read_eval_items(spark, str(tmp_path / "eval.jsonl")).collect()}
    assert items["q1"].extra == {"level": "3"} and items["q1"].gold_article_ids == ["a"] and items["q2"].extra == {}
    (tmp_path / "split.json").write_text(json.dumps({"seed": 1, "dev_frac": 0.5, "dev": ["a"], "test": ["b", "c"]}))
    assert {(r.id, r.split) for r in tables.read_split(spark, str(tmp_path / "split.json")).collect()} == {("a", "dev"), ("b", "test"), ("c", "test")}
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.html").write_bytes("<p>é</p>".encode("latin-1"))
    (tmp_path / "files" / "b.pdf").write_bytes(b"x" * 200)
    (tmp_path / "files" / "c.pdf").write_bytes(b"bad")
    (tmp_path / "files" / "d.doc").write_bytes(b"no")
    files = tables.read_files(spark, str(tmp_path / "files"))
    assert {r.name for r in files.collect()} == {"a.html", "b.pdf", "c.pdf"}
    assert [r.text for r in tables.html_texts(files.filter("name like '%.html'")).collect()] == ["é"]
    texts = tables.pdf_texts(files.filter("name like '%.pdf'"), lambda d: [d.decode(), "y" * 50]).collect()
    assert [(r.name, len(r.text)) for r in texts] == [("b.pdf", 251)]
    for write, kind in ((tables.write_json, "json"), (tables.write_csv, "csv"), (tables.write_new, "parquet")):
        write(spark.range(5), str(tmp_path / kind))
    tables.append_runs(spark.range(2), str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 7 and spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 5


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "id long, text string")
    rows.write.parquet(str(tmp_path / "in"))
    go = lambda: ingest_new(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "store"), "id", str(tmp_path / "ck"), lambda d: d).awaitTermination()
    go()
    rows.filter("id < 3").unionByName(spark.createDataFrame([(77, "n"), (77, "n")], rows.schema)).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [*range(10), 77]


def test_property_expand(spark):
    rng = random.Random(4)
    links = {(rng.randrange(25), rng.randrange(25)) for _ in range(40)}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for s in (0, 5, 9):
        seen, front = {s: 0}, {s}
        for hop in (1, 2, 3):
            front = {y for x in front for y in near.get(x, ())} - seen.keys()
            seen.update(dict.fromkeys(front, hop))
        want.update({(s, d): h for d, h in seen.items() if h})
    e = spark.createDataFrame([(a, b, "") for a, b in links], "src int, dst int, attr string")
    got = {(r.seed, r.dst): r.hop for r in graph.expand(spark.createDataFrame([(0,), (5,), (9,)], "id int"), e, 3).collect()}
    assert got == want
