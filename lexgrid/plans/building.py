"""Queries that build the whole graph from regulation texts, and their SQL, which knows the texts' making and no pattern.

Each supplier is a regulation and each line number of its lines an article, whose text is composed of numbers. So the texts have
as many rows as the tables give, and SQL states the edges without reading a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.functions import extract as E
from lexgrid.functions import text as X
from lexgrid.operators import corpus, graph
from lexgrid.scratch import Scratch


def table(spark, sf_dir, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regulations(spark, sf_dir) -> DataFrame:
    """(id, title): every third amends another, some of them one that isn't there; every fifth repeals one that isn't."""
    k = F.col("s_suppkey")
    amended = F.concat(F.lit("Perubahan atas Undang-Undang Nomor "), (2 * k).cast("string"), F.lit(" Tahun 2020"))
    repealed = F.concat(F.lit("Pencabutan Peraturan Pemerintah Nomor "), (k + 5).cast("string"), F.lit(" Tahun 1999"))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("UU "), k.cast("string"), F.lit(" TAHUN 2020")).alias("id"), F.when(k % 3 == 0, amended).when(k % 5 == 0, repealed).otherwise(F.concat(F.lit("Tentang urusan "), k.cast("string"))).alias("title")
    )


def articles(spark, sf_dir) -> DataFrame:
    """(id, regulation_id, article_number, content): the first article of each defines two terms, all refer to one of their own and one of the next regulation."""
    own = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber").distinct()
    s, n = F.col("l_suppkey"), F.col("l_linenumber")
    terms = F.concat(F.lit("Dalam undang-undang ini yang dimaksud dengan: 1. Pokok "), F.element_at(F.split(F.lit("A B C D E F G"), " "), (s % 7 + 1).cast("int")), F.lit(" adalah satu. 2. Umum adalah dua. "))
    refs = F.concat(
        F.lit("Sesuai Pasal "), (n % 7 + 1).cast("string"), F.lit(" ayat (2) dan Pasal "), n.cast("string"), F.lit(" serta Pasal "), (n % 3 + 1).cast("string"),
        F.lit(" Undang-Undang Nomor "), (s + n).cast("string"), F.lit(" Tahun 2020."),
    )
    rows = own.select(F.concat(F.lit("UU "), s.cast("string"), F.lit(" TAHUN 2020")).alias("regulation_id"), n.cast("string").alias("article_number"), F.concat(F.when(n == 1, terms).otherwise(""), refs).alias("content"))
    return rows.withColumn("id", X.article_id(F.col("regulation_id"), F.col("article_number")))


OWN = """s AS (SELECT s_suppkey AS k, 'UU ' || s_suppkey || ' TAHUN 2020' AS id FROM supplier),
a AS (SELECT DISTINCT l_suppkey AS s, l_linenumber AS n, 'UU ' || l_suppkey || ' TAHUN 2020' AS regulation_id, 'UU ' || l_suppkey || ' TAHUN 2020::' || l_linenumber AS id FROM lineitem),
refs AS (SELECT id AS src, regulation_id || '::' || (n % 7 + 1) AS dst, '2' AS ayat FROM a WHERE n % 7 + 1 <> n UNION ALL SELECT id, 'UU ' || (s + n) || ' TAHUN 2020::' || (n % 3 + 1), '' FROM a),
links AS (SELECT DISTINCT src, dst, ayat AS attr FROM refs WHERE dst IN (SELECT id FROM a)),
am AS (SELECT id AS src, CASE WHEN k % 3 = 0 THEN 'UU ' || (2 * k) || ' TAHUN 2020' ELSE 'PP ' || (k + 5) || ' TAHUN 1999' END AS dst, CASE WHEN k % 3 = 0 THEN 'amends' ELSE 'repeals' END AS attr FROM s WHERE (k % 3 = 0 OR k % 5 = 0)),
regs AS (SELECT id FROM s UNION SELECT dst FROM am UNION SELECT regulation_id FROM a),
de AS (SELECT id AS src, unnest(['Pokok ' || chr((65 + s % 7)::INT), 'Umum']) AS dst FROM a WHERE n = 1)"""


def _intra(rows: DataFrame) -> DataFrame:
    found = E.intra_references(rows, "id", "content", "article_number")
    return found.select(F.col("id").alias("src"), F.concat(F.regexp_extract("id", "^(.*)::", 1), F.lit("::"), "article_number").alias("dst"), "ayat")


def _cross(rows: DataFrame) -> DataFrame:
    found = E.cross_references(rows, "id", "content", "regulation_id")
    return found.select(F.col("id").alias("src"), X.article_id(F.col("regulation_id"), F.col("article_number")).alias("dst"), "ayat")


def parts(spark, sf_dir) -> dict[str, DataFrame]:
    """Vertices and edges of every kind; articles are read from a written table, as all edges come from it."""
    rows = Scratch(spark).keep(articles(spark, sf_dir))
    own = regulations(spark, sf_dir)
    amends = E.amendments(own.withColumnRenamed("id", "src"), "src", "title").select("src", F.col("regulation_id").alias("dst"), "action")
    regs = graph.with_stubs(own, amends.select(F.col("dst").alias("id")), rows.select(F.col("regulation_id").alias("id")))
    terms = E.definitions(rows.filter(X.is_definitional(F.col("article_number"), F.col("content"))), "id", "content").select(F.col("id").alias("src"), "term")
    concepts, defines = graph.define_edges(terms, rows)
    return {
        "articles": rows, "regulations": regs, "concepts": concepts, "belongs_to": graph.belongs_to(rows, regs), "references": graph.reference_edges(_intra(rows), _cross(rows), rows),
        "amends": graph.amend_edges(amends, regs), "defines": defines, "intra": _intra(rows), "cross": _cross(rows),
    }


SQL: dict[str, str] = {}


def graph_vertices(spark, sf_dir):
    p = parts(spark, sf_dir)
    kinds = [p["regulations"].select(F.lit("regulation").alias("kind"), "id", F.col("title").isNull().alias("stub")), p["articles"].select(F.lit("article").alias("kind"), "id", F.lit(False).alias("stub")), p["concepts"].select(F.lit("concept").alias("kind"), "id", F.lit(False).alias("stub"))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


SQL["graph_vertices"] = f"WITH {OWN} SELECT 'regulation' AS kind, id, id NOT IN (SELECT id FROM s) AS stub FROM regs UNION ALL SELECT 'article', id, false FROM a UNION ALL SELECT DISTINCT 'concept', dst, false FROM de"


def graph_belongs_to(spark, sf_dir):
    return parts(spark, sf_dir)["belongs_to"]


SQL["graph_belongs_to"] = f"WITH {OWN} SELECT id AS src, regulation_id AS dst FROM a"


def graph_references(spark, sf_dir):
    return parts(spark, sf_dir)["references"]


SQL["graph_references"] = f"WITH {OWN} SELECT src, dst, attr FROM links"


def graph_amends(spark, sf_dir):
    return parts(spark, sf_dir)["amends"]


SQL["graph_amends"] = f"WITH {OWN} SELECT DISTINCT src, dst, attr FROM am"


def graph_defines(spark, sf_dir):
    return parts(spark, sf_dir)["defines"]


SQL["graph_defines"] = f"WITH {OWN} SELECT DISTINCT src, dst FROM de"


def graph_counts(spark, sf_dir):
    p = parts(spark, sf_dir)
    return graph.graph_counts(*(p[k] for k in ("regulations", "articles", "concepts", "belongs_to", "references", "amends", "defines")))


SQL["graph_counts"] = f"""WITH {OWN} SELECT 'regulations' AS what, count(*) AS n FROM regs UNION ALL SELECT 'articles', count(*) FROM a UNION ALL SELECT 'concepts', count(DISTINCT dst) FROM de UNION ALL SELECT 'belongs_to', count(*) FROM a
UNION ALL SELECT 'references', count(*) FROM links UNION ALL SELECT 'amends', count(*) FROM (SELECT DISTINCT * FROM am) UNION ALL SELECT 'defines', count(*) FROM (SELECT DISTINCT * FROM de)
UNION ALL SELECT 'orphan_articles', count(*) FROM a WHERE id NOT IN (SELECT src FROM links UNION SELECT dst FROM links UNION SELECT src FROM de)
UNION ALL SELECT 'defining_articles', count(DISTINCT src) FROM de UNION ALL SELECT 'stub_regulations', count(*) FROM regs WHERE id NOT IN (SELECT regulation_id FROM a)"""


def graph_tops(spark, sf_dir):
    """The three lists of ten."""
    p = parts(spark, sf_dir)
    lists = [graph.top_targets(p[k]).select(F.lit(k).alias("list"), "id", "degree") for k in ("references", "defines", "amends")]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


SQL["graph_tops"] = f"WITH {OWN} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS list, dst AS id, count(*) AS degree FROM (SELECT DISTINCT * FROM {t}) GROUP BY 2 ORDER BY degree DESC, id LIMIT 10)" for k, t in (("references", "links"), ("defines", "de"), ("amends", "am")))


def reference_resolution(spark, sf_dir):
    p = parts(spark, sf_dir)
    return graph.resolution(p["intra"].unionByName(p["cross"]), p["articles"])


SQL["reference_resolution"] = f"WITH {OWN}, d AS (SELECT DISTINCT * FROM refs) SELECT count(*) AS attempted, count(*) FILTER (dst IN (SELECT id FROM a)) AS resolved, count(*) FILTER (dst NOT IN (SELECT id FROM a)) AS unresolved FROM d"


def definition_counters(spark, sf_dir):
    """The parse counters of whole texts: articles, references of both kinds, terms and amendments."""
    p = parts(spark, sf_dir)
    n = lambda what, f: f.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return n("articles", p["articles"]).unionByName(n("intra_refs", p["intra"])).unionByName(n("cross_refs", p["cross"])).unionByName(n("definitions", p["defines"])).unionByName(n("amends", p["amends"]))


SQL["definition_counters"] = f"WITH {OWN} SELECT 'articles' AS what, count(*) AS n FROM a UNION ALL SELECT 'intra_refs', count(*) FROM a WHERE n % 7 + 1 <> n UNION ALL SELECT 'cross_refs', count(*) FROM a UNION ALL SELECT 'definitions', count(*) FROM de UNION ALL SELECT 'amends', count(*) FROM am"


def references_json(spark, sf_dir):
    """References to JSON and back."""
    rows = parts(spark, sf_dir)["intra"].groupBy("src").agg(F.sort_array(F.collect_list(F.struct(F.regexp_extract("dst", "::(.*)$", 1).alias("article"), "ayat"))).alias("refs"))
    coded = rows.select("src", X.references_json(F.col("refs")).alias("json"))
    return coded.select("src", "json", F.size(X.references_of(F.col("json"))).cast("long").alias("n"))


SQL["references_json"] = f"""WITH {OWN} SELECT id AS src, '[{{"article":"' || (n % 7 + 1) || '","ayat":"2"}}]' AS json, 1::BIGINT AS n FROM a WHERE n % 7 + 1 <> n"""


# --- stores

def point_lookup(spark, sf_dir):
    """The documents of the labelled ids of low quality."""
    wanted = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    return corpus.lookup(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), wanted, "doc_id")


SQL["point_lookup"] = "SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)"

_STORED = "st AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 3 <> 0)"


def _stored(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(F.col("doc_id") % 3 != 0)
    return docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("text"), F.lit("!"))).otherwise(F.col("text")).alias("text"))


def graph_diff(spark, sf_dir):
    return corpus.graph_diff(table(spark, sf_dir, "documents"), _stored(spark, sf_dir), "doc_id", "text")


SQL["graph_diff"] = f"WITH {_STORED} SELECT doc_id FROM documents d JOIN st USING (doc_id) WHERE d.text <> st.text"


def migration_dry_run(spark, sf_dir):
    return corpus.migrate(table(spark, sf_dir, "documents").select("doc_id", "text"), _stored(spark, sf_dir), "doc_id", "text")[0]


SQL["migration_dry_run"] = f"WITH {_STORED} SELECT CASE WHEN st.doc_id IS NULL THEN 'missing' ELSE 'changed' END AS state, count(*) AS n FROM documents d LEFT JOIN st USING (doc_id) WHERE st.doc_id IS NULL OR st.text IS DISTINCT FROM d.text GROUP BY 1"


def migration(spark, sf_dir):
    _, done = corpus.migrate(table(spark, sf_dir, "documents").select("doc_id", "text"), _stored(spark, sf_dir), "doc_id", "text", dry_run=False)
    return done.select("doc_id", F.md5("text").alias("text_md5"))


SQL["migration"] = "SELECT doc_id, md5(text) AS text_md5 FROM documents"


def sorted_files(spark, sf_dir):
    """The first hundred pages by path, then id: a sorted scan with a limit, which is the feature."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"://[^/]*(/[^?#]*)", 1).alias("path"))
    return rows.orderBy("path", "page_id").limit(100)


SQL["sorted_files"] = "SELECT page_id, regexp_extract(url, '://[^/]*(/[^?#]*)', 1) AS path FROM pages ORDER BY path, page_id LIMIT 100"


def metadata_join(spark, sf_dir):
    """Files with the metadata of their normalised key, of which the last record counts, and the number of files without any."""
    files = table(spark, sf_dir, "customer").select("c_custkey", X.normalise_key(F.concat(F.lit("uu_"), (F.col("c_custkey") % 400).cast("string"), F.lit("tahun-2020"))).alias("file_key"))
    meta = table(spark, sf_dir, "supplier").select(X.normalise_key(F.concat(F.lit("UU/"), (F.col("s_suppkey") % 90).cast("string"), F.lit(" Tahun 2020"))).alias("file_key"), "s_suppkey")
    found, none = corpus.with_metadata(files, corpus.last_by_key(meta.withColumn("pos", F.col("s_suppkey")), "file_key", "pos").drop("pos"), "file_key")
    counted = none.agg(F.count("*").alias("s_suppkey")).select(F.lit(-1).cast("long").alias("c_custkey"), F.col("s_suppkey").cast("long").alias("s_suppkey"))
    return found.select("c_custkey", F.col("s_suppkey").cast("long").alias("s_suppkey")).unionByName(counted)


SQL["metadata_join"] = """WITH m AS (SELECT s_suppkey % 90 AS k, max(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1)
SELECT c_custkey, s_suppkey FROM customer JOIN m ON m.k = c_custkey % 400 UNION ALL SELECT -1, count(*) FROM customer WHERE c_custkey % 400 NOT IN (SELECT k FROM m)"""


def scalar_checks(spark, sf_dir):
    """Score from distance, numbers from text, and pages that are images alone."""
    rows = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lit("n/a")).when(F.col("o_orderkey") % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("o_totalprice").cast("string"))
    pages_ = F.array(F.repeat(F.lit("x"), (F.col("o_orderkey") % 120).cast("int")), F.lit("y"))
    score = X.as_score(text)
    return rows.select("o_orderkey", F.round(X.score_of(F.col("o_orderkey") % 100 / 100.0), 6).alias("score"), F.isnan(score).alias("no_number"), F.round(F.when(~F.isnan(score), score), 2).alias("number"), X.is_image_only(pages_).alias("image_only"))


SQL["scalar_checks"] = """SELECT o_orderkey, round(1 - o_orderkey % 100 / 100.0::DOUBLE, 6) AS score, (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) AS no_number,
CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN round(o_totalprice::DOUBLE, 2) END AS number, (o_orderkey % 120 + 1) / 2.0 < 50 AS image_only FROM orders"""

QUERIES = {
    f.__name__: f
    for f in (
        graph_vertices, graph_belongs_to, graph_references, graph_amends, graph_defines, graph_counts, graph_tops, reference_resolution, definition_counters, references_json,
        point_lookup, graph_diff, migration_dry_run, migration, sorted_files, metadata_join, scalar_checks,
    )
}
