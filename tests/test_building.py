"""Graph building, stores, saved pages and the evaluation flow on hand-made rows."""

import html
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lexgrid.functions import text as X
from lexgrid.operators import corpus, experiment, graph, metrics, retrieval
from lexgrid.plans import catalog
from lexgrid.sources import tables


def test_unescape(spark):
    given = ["", "plain", "a & b", "&amp;&lt;b&gt;", "&eacute;t&#233; &#x41;&#X42;", "&#8217;&nbsp;x", "&nosuch; &#xD800; &#0; &#99999999;", "&amp;amp;", "x&copy", "&#150;&#146;s", "&NotEqualTilde;&fjlig;"]
    got = [r.t for r in spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g string").orderBy("i").select(X.unescape(F.col("g")).alias("t")).collect()]
    assert got == [html.unescape(g) for g in given]
    assert spark.sql("SELECT CAST(NULL AS STRING) AS g").select(X.unescape(F.col("g")).alias("t")).first().t is None


def test_html_text_decodes(spark):
    page = "<html><head><title>t</title></head><body><p>Caf&eacute; &#8217;x&#8217;</p><script>&amp;</script><p>b</p></body></html>"
    assert spark.createDataFrame([(page,)], "h string").select(X.html_text(F.col("h")).alias("t")).first().t == "Café ’x’\nb"


def test_html_text_query_keeps_cut_references(spark, tmp_path):
    """As its SQL has it: a reference that a title's end cut stays; the function itself decodes it, as browsers do."""
    pages = [(0, "<html><body><h1>a&amp;&amp</h1><p>b &copy; &lt;&quot</p></body></html>"), (1, "<p>&am</p>&amp;lt;"), (2, "<p>&amp</p>&ltx;&#39;&#39</p>"), (3, "")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(catalog.SQL["html_text"]).fetchall()
    assert sorted(tuple(r) for r in catalog.html_text(spark, str(tmp_path)).collect()) == sorted(want)
    assert spark.createDataFrame([(pages[0][1],)], "h string").select(X.html_text(F.col("h")).alias("t")).first().t == 'a&&\nb © <"'


def test_stubs_keep_rows_whole(spark):
    rows = spark.createDataFrame([("r", "old", None, 1), ("r", None, "new", 2), ("q", "t", "c", 1)], "id string, title string, category string, pos int")
    got = {r.id: (r.title, r.category) for r in graph.with_stubs(rows, spark.createDataFrame([("r",), ("s",), ("s",)], "id string"), order="pos").collect()}
    assert got == {"r": (None, "new"), "q": ("t", "c"), "s": (None, None)}


def test_graph_of_all_kinds(spark):
    regs = spark.createDataFrame([("R1", "x"), ("R2", "y")], "id string, title string")
    amends = spark.createDataFrame([("R2", "R9", "repeals"), ("R2", "R9", "repeals"), ("R2", "R1", "amends")], "src string, dst string, action string")
    arts = spark.createDataFrame([("R1::1", "R1"), ("R1::2", "R1"), ("R3::1", "R3")], "id string, regulation_id string")
    full = graph.with_stubs(regs, amends.select(F.col("dst").alias("id")), arts.select(F.col("regulation_id").alias("id")))
    intra = spark.createDataFrame([("R1::1", "R1::2", None), ("R1::1", "R1::2", "3"), ("R1::1", "R1::8", None)], "src string, dst string, ayat string")
    cross = spark.createDataFrame([("R3::1", "R1::1", "1"), ("R3::1", "R1::1", "1")], "src string, dst string, ayat string")
    refs = graph.reference_edges(intra, cross, arts)
    terms = spark.createDataFrame([("R1::1", "Pajak"), ("R3::1", "Pajak"), ("R3::1", "pajak"), ("gone", "x")], "src string, term string")
    concepts, defines = graph.define_edges(terms, arts)
    belongs = graph.belongs_to(arts, full)
    counts = {r.what: r.n for r in graph.graph_counts(full, arts, concepts, belongs, refs, graph.amend_edges(amends, full), defines).collect()}
    assert counts == {"regulations": 4, "articles": 3, "concepts": 2, "belongs_to": 3, "references": 3, "amends": 2, "defines": 3, "orphan_articles": 0, "defining_articles": 2, "stub_regulations": 2}
    assert graph.resolution(intra.unionByName(cross), arts).first().asDict() == {"attempted": 4, "resolved": 3, "unresolved": 1}
    assert [tuple(r) for r in graph.top_targets(refs, 1).collect()] == [("R1::2", 2)]


def test_store_steps(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, t string")
    stored = spark.createDataFrame([(1, "a"), (2, "old"), (9, "z")], "id int, t string")
    counts, none = corpus.migrate(rows, stored, "id", "t")
    assert {r.state: r.n for r in counts.collect()} == {"changed": 1, "missing": 1} and none is None
    done = corpus.migrate(rows, stored, "id", "t", dry_run=False)[1]
    assert sorted(map(tuple, done.collect())) == [(1, "a"), (2, "b"), (3, "c"), (9, "z")] and corpus.migrate(rows, done, "id", "t")[0].count() == 0
    assert [r.id for r in corpus.graph_diff(rows, stored, "id", "t").collect()] == [2]
    assert [r.id for r in corpus.lookup(rows, spark.createDataFrame([(3,), (3,), (7,)], "id int"), "id").collect()] == [3]


def test_write_new_swaps(spark, tmp_path):
    at = str(tmp_path / "t")
    tables.write_new(spark.range(3), at)
    tables.write_new(spark.read.parquet(at).withColumn("id", F.col("id") + 10), at)  # reads what it replaces
    assert sorted(r.id for r in spark.read.parquet(at).collect()) == [10, 11, 12]
    with pytest.raises(Exception):
        tables.write_new(spark.range(3).select(F.raise_error(F.lit("broken")).alias("id")), at)
    assert spark.read.parquet(at).count() == 3
    tables.wipe(spark, at)
    assert not (tmp_path / "t").exists()


def test_split_file(spark, tmp_path):
    split = spark.createDataFrame([("b", "dev"), ("a", "dev"), ("c", "test")], "id string, split string")
    tables.write_split(split, str(tmp_path / "s"), 7, 0.5)
    assert sorted(map(tuple, tables.read_split(spark, str(tmp_path / "s")).collect())) == [("a", "dev"), ("b", "dev"), ("c", "test")]
    items = spark.createDataFrame([("a", ["x", "y"]), ("c", ["y"]), ("d", [])], "id string, gold array<string>")
    assert [r.id for r in experiment.in_split(items, split, "dev").collect()] == ["a"] and experiment.in_split(items, split, "all").count() == 3
    assert sorted(r.id for r in experiment.gold_ids(items, "gold").collect()) == ["x", "y"]


def test_cards(spark):
    card = lambda num, desc: f"<div class='row jdih-search'><h5 class='item'><a href='/dok/{num}'>{num}</a></h5><p class='item'>{desc}</p><div class='search-label item'>PAJAK</div><ul class='search-meta'><li>Ditetapkan:&nbsp;1 Mei</li></ul></div>"
    page = "<html>" + card("PMK 18 TAHUN 2026", "Tentang A &amp; B") + card("PP 1", "") + "</html>"
    got = tables.parse_cards(spark.createDataFrame([(page,), ("<p>none</p>",), (None,)], "h string"), "h", "https://host.example/").collect()
    assert [tuple(r) for r in got] == [("PMK 18 TAHUN 2026", "Tentang A & B", "2026", "PAJAK", "1 Mei", None, "https://host.example/dok/PMK 18 TAHUN 2026")]


def test_sorted_files_and_articles(spark, tmp_path):
    for n in ("b.html", "a.htm", "c.txt", "d.pdf"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.name for r in tables.read_files(spark, str(tmp_path), limit=2).orderBy("name").collect()] == ["a.htm", "b.html"]
    rows = [{"regulation_id": "R", "article_number": n, "content": c} for n, c in (("2", "short"), ("1", "long enough to be a usable body"), ("2", "a much longer body of an article"))]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps(rows))
    assert [(r.id, r.content) for r in tables.read_canonical_articles(spark, str(tmp_path / "j")).collect()] == [("R::2", rows[2]["content"]), ("R::1", rows[1]["content"])]


def test_seed_modes(spark):
    pool = spark.createDataFrame([(1, i, 1 - i / 10, i) for i in range(1, 7)], "query_id int, id int, sim double, rank int")
    lexical = spark.createDataFrame([(1, i, s) for i, s in ((6, 9.0), (5, 8.0), (3, 7.0), (4, 6.0), (1, 5.0), (2, 0.0))], "query_id int, id int, bm25 double")
    assert {r.id for r in retrieval.seeds("dense", pool, lambda p: lexical, 2).collect()} == {1, 2}
    hybrid = {r.id: r.sim for r in retrieval.seeds("hybrid", pool, lambda p: lexical, 2).collect()}
    assert hybrid == {1: 0.9, 3: pytest.approx(0.7)}  # by rank in both, but with the dense similarity
    with pytest.raises(ValueError):
        retrieval.seeds("other", pool, lambda p: lexical, 2)


def test_per_question(spark):
    runs = spark.createDataFrame([("a", 1, 0.5, ["x", "y"]), ("b", 1, 0.1, ["z"]), ("b", 2, None, [])], "system string, query_id int, latency_s double, retrieved array<string>")
    gold = spark.createDataFrame([(1, "y"), (1, "w")], "query_id int, id string")
    scores = spark.createDataFrame([("b", 1, 0.7)], "system string, query_id int, faith double")
    got = {(r.system, r.query_id): r for r in metrics.per_question(runs, gold, scores).collect()}
    assert got["a", 1].mrr == 0.5 and got["a", 1].recall_3 == 0.5 and got["a", 1].n_retrieved == 2 and got["a", 1].n_gold == 2 and got["a", 1].judge_faith is None
    assert got["b", 1].judge_faith == 0.7 and got["b", 2].n_gold == 0 and got["b", 2].mrr == 0.0 and len(got) == 3


def test_dense_over_many_parts(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(200)]
    corpus_ = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = corpus_.filter("id < 9").withColumnRenamed("id", "query_id")
    want = sorted(map(tuple, retrieval.dense_topk(queries, corpus_, 3).collect()))
    monkeypatch.setattr(retrieval, "CHUNK", 10)
    monkeypatch.setattr(retrieval, "QUERIES", 2)
    assert sorted(map(tuple, retrieval.dense_topk(queries, corpus_, 3).collect())) == want and len(want) == 27
