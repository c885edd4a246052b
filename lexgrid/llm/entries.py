"""The operators' queries, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrid.llm.licenses import scan_licenses

    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    joined = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrid.llm.quality import score_quality

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("content_share") >= F.col("least_share"))).alias("kept"), F.round("content_share", 6).alias("content_share"),
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrid.llm.pages import extract_pages

    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.col("n_chars").cast("long"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrid.llm.leaks import leak_pairs

    return leak_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    from lexgrid.llm.tokens import count_tokens

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrid.llm.secrets import scan_secrets, span_text

    def of(field: str, value: str) -> F.Column:
        return F.size(F.filter("findings", lambda f: f[field] == value)).cast("long").alias(f"n_{value}")

    base = F.filter("findings", lambda f: f["base"])
    return scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(of("kind", k) for k in ("assign", "access", "hex")),
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("findings")).alias("spans"),
        *(of("verdict", v) for v in ("live", "shared", "example")),
        *(F.coalesce(F.array_max(F.transform("findings", lambda f: f[n])), F.lit(0)).cast("long").alias(f"most_{n[2:]}") for n in ("n_repos", "n_owners")),  # noqa: B023
    )


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrid.llm.setjoin import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrid.llm.urls import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrid.llm.language import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    from lexgrid.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary))


QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_quality_rules, op3_html_extraction, op4_decontamination, op5_token_counts, op6_secret_scan, op7_ngram_jaccard_join, op8_url_filter, op9_language_id, op10_packing)
}
#: DuckDB's SQL for what SQL can express; the tests hold the other queries against brute force.
ORACLES: dict[str, str] = {
    "op8_url_filter": r"""
WITH a AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw, rest FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM b),
d AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM c),
e AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1 WHEN rule IS NOT NULL THEN 0 END AS bad,
 list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda s: regexp_replace(regexp_replace(s, '^[0-9a-fA-F]{8,}(\.|$)', '{h}\1'), '[0-9]+', '{n}', 'g')) AS segs FROM d),
paths AS (SELECT host, segs, count(*) AS n, count(bad) AS labels, coalesce(sum(bad), 0) AS blocks FROM e GROUP BY ALL),
steps AS (SELECT host, segs, n, unnest(segs) AS seg, generate_subscripts(segs, 1) AS d FROM paths),
named AS (SELECT *, array_to_string(segs[1:d - 1], '/') AS parent FROM steps),
wide AS (SELECT host, d, parent FROM (SELECT host, d, parent, seg, sum(n) AS n FROM named GROUP BY ALL) GROUP BY ALL HAVING count(*) >= 12 AND count(*) >= 0.3 * sum(n)),
shown AS (SELECT s.host, s.segs, '/' || string_agg(CASE WHEN w.host IS NULL THEN s.seg ELSE '*' END, '/' ORDER BY s.d) AS template FROM named s LEFT JOIN wide w ON w.host = s.host AND w.d = s.d AND w.parent = s.parent GROUP BY 1, 2),
sums AS (SELECT p.host, template, sum(n) AS n, sum(labels) AS labels, sum(blocks) AS blocks, regexp_extract(template, '^(/[^/]*)', 1) AS branch, regexp_replace(template, '^/[^/]*', '/*') AS tail FROM paths p JOIN shown USING (host, segs) GROUP BY ALL),
tails AS (SELECT host, tail, sum(labels) AS l, sum(blocks) AS b FROM sums GROUP BY ALL),
branches AS (SELECT host, branch, sum(n) AS bn, sum(labels) AS bl, sum(blocks) AS bb FROM sums GROUP BY ALL),
hosts AS (SELECT host, sum(bn) AS hn, sum(bl) AS hl, sum(bb) AS hb FROM branches GROUP BY ALL),
main AS (SELECT s.*, bn FROM sums s JOIN branches USING (host, branch) WHERE 20 * n >= bn),
built AS (SELECT host, branch, md5(string_agg(tail, chr(10) ORDER BY tail)) AS sig, count(*) AS kinds, sum(n) AS inside FROM main GROUP BY ALL HAVING count(*) >= 2),
members AS (SELECT * FROM main JOIN built USING (host, branch)),
pools AS (SELECT host, sig, sum(bn) AS pn, sum(inside) AS pin FROM (SELECT DISTINCT host, branch, sig, bn, inside FROM members) GROUP BY ALL),
shares AS (SELECT host, sig, tail, sum(n) AS pt FROM members GROUP BY ALL),
each AS (SELECT host, branch, kinds, pn - pin AS more, bn - inside AS own_more, bn::DOUBLE AS own, (pn - bn)::DOUBLE AS rest, pow(sqrt((pn - bn)::DOUBLE / bn) * n - sqrt(bn::DOUBLE / (pn - bn)) * (pt - n), 2) / pt AS term
 FROM members JOIN shares USING (host, sig, tail) JOIN pools USING (host, sig) WHERE pn > bn),
tested AS (SELECT host, branch, sum(term) + any_value(CASE WHEN more > 0 THEN pow(sqrt(rest / own) * own_more - sqrt(own / rest) * (more - own_more), 2) / more ELSE 0 END) AS chi, any_value(kinds) - 1 + any_value((more > 0)::INT) AS free FROM each GROUP BY ALL),
mine AS (SELECT m.* FROM members m JOIN tested USING (host, branch) WHERE chi <= free + 1.96 * sqrt(2 * free)),
inherited AS (SELECT host, template, al, ab FROM mine JOIN (SELECT host, sig, tail, sum(labels) AS al, sum(blocks) AS ab FROM mine GROUP BY ALL) USING (host, sig, tail)),
rates AS (SELECT *, CASE WHEN labels >= 8 AND l - labels >= 8 THEN abs(blocks / labels - (b - blocks) / (l - labels)) <= 1.96 * sqrt(b / l * (1 - b / l) * (1 / labels + 1 / (l - labels))) ELSE false END AS alike
 FROM (SELECT host, branch, template, labels::DOUBLE AS labels, blocks::DOUBLE AS blocks, l::DOUBLE AS l, b::DOUBLE AS b FROM sums JOIN tails USING (host, tail))),
counted AS (SELECT r.host, r.branch, r.template, CASE WHEN alike THEN l WHEN al IS NOT NULL AND labels < 8 THEN al ELSE labels END AS k, CASE WHEN alike THEN b WHEN al IS NOT NULL AND labels < 8 THEN ab ELSE blocks END AS x
 FROM rates r LEFT JOIN inherited i ON i.host = r.host AND i.template = r.template),
judged AS (SELECT host, template, round(CASE WHEN k > 0 THEN (x + 2) / (k + 4) WHEN bl > 0 THEN (bb + 2) / (bn + 4) WHEN hl > 0 THEN (hb + 2) / (hn + 4) ELSE 0.5 END::DOUBLE, 6) AS purity
 FROM counted JOIN branches USING (host, branch) JOIN hosts USING (host))
SELECT page_id, e.host, path, rule, CASE WHEN bad IS NOT NULL THEN CASE bad WHEN 1 THEN 'block' ELSE 'allow' END WHEN purity >= 0.8 THEN 'block' ELSE 'allow' END AS verdict, s.template, purity
FROM e JOIN shown s ON s.host = e.host AND s.segs = e.segs JOIN judged j ON j.host = s.host AND j.template = s.template""",
}
