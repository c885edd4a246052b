"""Text functions, extraction and deduplication on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from lexgrid.functions import extract as E
from lexgrid.functions import text as X
from lexgrid.functions.vector import cosine
from lexgrid.operators import corpus


def apply(spark, f, *values):
    kinds = ["string" if isinstance(v, str) or v is None else "array<string>" for v in values]
    row = spark.createDataFrame([values], ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    return row.select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("r")).first().r


@pytest.mark.parametrize(
    "raw, want",
    [("01_PMK_010_2011_1", "01 PMK 010 2011"), ("01/PMK.010/2011", "01 PMK 010 2011"), ("PP 7TAHUN 1977", "PP 7 TAHUN 1977"), ("PMK 18 TAHUN 2026", "PMK 18 TAHUN 2026"), ("a b c d 2026", "A B C D 2026"), ("a b c 12", "A B C 12"), ("", "")],
)
def test_normalise_key(spark, raw, want):
    assert apply(spark, X.normalise_key, raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Peraturan Pemerintah Pengganti Undang-Undang", "PERPU"), ("Peraturan Pemerintah", "PP"), ("Peraturan Menteri Keuangan", "PMK"), ("Keputusan Menteri Keuangan", "PMK"), ("Undang-Undang", "UU"), ("Perppu", "PP"),
        ("PERPU", "PERPU"), ("kmk", "KMK"), ("Peraturan\nPemerintah", "PP"), ("Menteri\nKeuangan", "MENTERI\nKEUANGAN"), ("Surat", "SURAT"),
    ],
)
def test_regulation_type(spark, raw, want):
    assert apply(spark, X.regulation_type, raw) == want


@pytest.mark.parametrize("text, want", [("Ayat (7) tentang batas waktu", True), ("Cukup   jelas", True), ("huruf c serta d", True), ("ANGKA 11 memuat", True), ("  ayat(1)", True), ("Setiap wajib lapor", False), ("Angka", False), ("", False)])
def test_elucidation(spark, text, want):
    assert apply(spark, X.is_elucidation, text) is want


def test_scalars(spark):
    assert apply(spark, X.article_number, " 1oA ") == "10A"
    assert apply(spark, X.clean_space, " a \t b\n\n\n\nc ") == "a b\n\nc"
    assert apply(spark, X.date_text, "Ditetapkan: 1 Mei ") == "1 Mei"
    assert apply(spark, X.safe_basename, "01/PMK é-1") == "01_PMK_é-1"
    assert apply(spark, X.article_text, "", " raw ") == "raw" and apply(spark, X.article_text, None, None) == ""
    assert tuple(apply(spark, X.regulation_parts, "pp 7 tahun 1977")) == ("PP", 7, 1977) and tuple(apply(spark, X.regulation_parts, "99/PMK.03/2018")) == ("UNKNOWN", 0, 0)
    assert [apply(spark, X.is_verified, n) for n in ("DRAFT x", " draft", None, "ok")] == [False, False, True, True]
    assert apply(spark, X.is_suspect_id, "PP 1::1O") and apply(spark, X.is_suspect_id, "PP 1::XO") and not apply(spark, X.is_suspect_id, "PO 1::10")
    assert apply(spark, X.is_image_only, ["a" * 49, "b" * 50]) and not apply(spark, X.is_image_only, ["a" * 50]) and apply(spark, X.is_image_only, [])
    assert apply(spark, X.file_extension, "text/html; charset=x", "x.pdf") == ".html" and apply(spark, X.file_extension, None, "X.HTM") == ".html" and apply(spark, X.file_extension, "odd/type", "x") == ".bin"
    assert apply(spark, X.links, "'/api/download/a.pdf' \"/API/download/b\" /api/download/a.pdf") == ["/api/download/a.pdf", "/API/download/b"]
    assert apply(spark, X.tokens, "Ab-1 é2") == ["ab", "1", "2"]
    import math

    assert math.isnan(apply(spark, X.as_score, "x")) and math.isnan(apply(spark, X.as_score, None)) and apply(spark, X.as_score, "0.5") == 0.5
    assert apply(spark, X.html_text, "<html><head><title>t</title></head><body><p>a &amp;lt; b</p><script>x</script><p>c</p></body></html>") == "a &lt; b\nc"


def test_decode(spark):
    rows = spark.createDataFrame([(bytearray("é".encode()),), (bytearray("é".encode("latin-1")),)], "data binary")
    assert [r.t for r in rows.select(X.decode_page(F.col("data")).alias("t")).collect()] == ["é", "é"]


def test_cosine(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = row.select(cosine(F.col("a"), F.col("b")).alias("x"), cosine(F.col("a"), F.col("z")).alias("y")).first()
    assert abs(r.x - 0.5**0.5) < 1e-9 and r.y == 0.0


def test_split_articles(spark):
    docs = spark.createDataFrame([(1, "p\nPasal 1\nPasal 2\na\nPasal 3b \n"), (2, "Pasal 1\nx"), (3, "")], "id int, t string")
    got = [(r.id, r.article_number, r.body) for r in E.split_articles(docs, "id", "t").orderBy("id", "pos").collect()]
    assert got == [(1, "1", "Pasal 2\na"), (1, "3B", "")]  # the second of adjacent headers and one on the first line aren't headers


def refs(spark, text, own="9", reg="PP 1 TAHUN 2020"):
    d = spark.createDataFrame([(1, text, own, reg)], "id int, t string, own string, reg string")
    return {(r.article_number, r.ayat) for r in E.intra_references(d, "id", "t", "own").collect()}, {(r.regulation_id, r.article_number, r.ayat) for r in E.cross_references(d, "id", "t", "reg").collect()}


def test_references(spark):
    assert refs(spark, "Pasal 4 ayat (1), Pasal 4 ayat (2), Pasal 4 ayat (1), Pasal 9 dan pasal 1O") == ({("4", "1"), ("4", "2"), ("10", None)}, set())
    assert refs(spark, "Pasal 3 Undang-Undang Nomor 8 Tahun 1983") == (set(), {("UU 8 TAHUN 1983", "3", None)})
    assert refs(spark, "Pasal 3 PP Nomor 1 Tahun 2020") == (set(), set())  # the own regulation: dropped by both
    assert refs(spark, "Pasal 3 PMK Nomor 99/PMK.03/2018") == ({("3", None)}, set())  # legacy numbers are taken for the own regulation's
    assert refs(spark, "Pasal Pasal 2 PP Nomor 5 Tahun 2001 7") == (set(), {("PP 5 TAHUN 2001", "2", None)})
    assert refs(spark, "Pasal 2 ayat (3)") == ({("2", "3")}, set())


def test_amendments(spark):
    titles = ["Perubahan Kedua atas Undang-Undang Nomor 7 Tahun 1983", "Pencabutan PMK Nomor 240/PMK.06/2016", "Perubahan atas nama", "Tentang Perubahan atas PP Nomor 1 Tahun 2000"]
    got = {r.id: (r.regulation_id, r.action) for r in E.amendments(spark.createDataFrame(list(enumerate(titles)), "id int, title string"), "id", "title").collect()}
    assert got == {0: ("UU 7 TAHUN 1983", "amends"), 1: ("PMK 240 TAHUN 2016", "repeals")}


def test_definitions(spark):
    text = "yang dimaksud dengan:\n1. Pajak adalah x.\n2. Wajib Pajak, yang selanjutnya disebut WP, adalah y; a. Kas yang selanjutnya disingkat K adalah z. 3. PAJAK adalah w. 4. F1 adalah v."
    got = [r.term for r in E.definitions(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").orderBy("pos").collect()]
    assert got == ["Pajak", "Wajib Pajak", "Kas"]


def test_dedup(spark):
    long_, short = "(1) " + "y" * 500, "(1) " + "x" * 50
    rows = [(0, "a", long_), (1, "a", "Cukup jelas."), (2, "b", short), (3, "b", long_), (4, "c", "Cukup jelas."), (5, "c", "Ayat (1) " + "z" * 80), (6, "d", ""), (7, "d", "   "), (8, "e", short), (9, "e", short), (10, "f", None)]
    frame = spark.createDataFrame(rows, "pos long, id string, content string")
    body = X.article_text(F.col("content"), F.lit(None).cast("string"))
    got = {r.id: (r.pos, r.first_pos) for r in corpus.dedup_articles(frame, "id", body, F.col("pos")).collect()}
    assert got == {"a": (0, 0), "b": (3, 2), "c": (5, 4), "d": (7, 6), "e": (8, 8), "f": (10, 10)}
    audit = corpus.dedup_audit(frame, "id", body, F.col("pos")).first()
    assert (audit.groups, audit.multi, audit.selectable, audit.all_trivial, audit.changed_vs_last) == (6, 5, 3, 2, 2)
    two = spark.createDataFrame([(0, "a", "p" * 301), (1, "a", "q" * 301), (2, "b", "p" * 301), (3, "b", "p" * 301)], "pos long, id string, content string")
    assert [r.id for r in corpus.collision_audit(two, "id", F.col("content")).collect()] == ["a"]


def test_files(spark):
    files = spark.createDataFrame([("k", "x_1.pdf"), ("k", "x.html"), ("k", "x.pdf"), ("m", "b.html"), ("m", "a_2.html")], "k string, n string")
    assert {r.file_key: r.file_name for r in corpus.best_files(files, F.col("k"), F.col("n")).collect()} == {"k": "x.pdf", "m": "b.html"}


def test_store(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, t string")
    old = spark.createDataFrame([(1, "a"), (2, "x"), (9, "z")], "id int, t string")
    assert {(r.id, r.state) for r in corpus.store_diff(new, old, "id", "t").collect()} == {(2, "changed"), (3, "missing")}
    done = corpus.upsert(old, new, "id")
    assert {(r.id, r.t) for r in done.collect()} == {(1, "a"), (2, "b"), (3, None), (9, "z")} and corpus.store_diff(new, done, "id", "t").count() == 0
