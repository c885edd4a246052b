"""One row to many: articles, references, amendments and definitions of regulation texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrid.functions.text import article_number, regulation_type, strip

#: The patterns of article headers, references, titles and definitions.
HEADER = r"(?i)\n[ \t]*Pasal[ \t]+([0-9]+[A-Z]?)[ \t]*\n"
TYPES = (
    r"(Peraturan\s+Pemerintah\s+Pengganti\s+Undang-Undang|Peraturan\s+Pemerintah|Peraturan\s+Menteri\s+Keuangan"
    r"|Undang-Undang|Keputusan\s+Menteri\s+Keuangan|PERPU|Perppu|PP|PMK|UU|KMK)"
)
INTRA = r"(?i)\bPasal\s+([0-9]+[A-Z]?)(?:\s+ayat\s+\(([0-9]+)\))?"
CROSS = INTRA + r"\s+" + TYPES + r"(?:\s+Republik\s+Indonesia)?\s+Nomor\s+([0-9]+)(?:/[^\s,;.()\n]+)?\s+[Tt]ahun\s+([0-9]{4})"
AMENDS = r"(?i)^\s*(Perubahan(?:\s+(?:Kedua|Ketiga|Keempat|Kelima|Keenam|Ketujuh|Kedelapan|Kesembilan|Kesepuluh))?\s+atas|Pencabutan(?:\s+atas)?)\s+"
TITLE_REFERENCE = r"(?i)\b" + TYPES + r"\s+Nomor\s+([0-9]+)(?:\s*/[^\s,;()]*?/([0-9]{4})|\s+[Tt]ahun\s+([0-9]{4}))"
DEFINITION = (
    r"(?i)(?:^|[\n.;:])\s*(?:[a-zA-Z]\.|[0-9]+\.)\s+([^.;,\n]{2,100}?)"
    r"(?:,\s*(?:yang\s+)?selanjutnya\s+(?:disebut(?:\s+juga)?|disingkat)\s+[^.,;\n]{1,80}?\s*,?"
    r"|\s+yang\s+selanjutnya\s+(?:disebut(?:\s+juga)?|disingkat)\s+[^.,;\n]{1,80}?\s*,?)?\s+adalah\b"
)
#: Java and RE2 take \s for ASCII only; with this the no-break space counts, as it does in the texts.
UNICODE = "(?U)"


def every(text: Column, pattern: str, *groups: int) -> Column:
    """An array of structs g1, g2, ... of all matches; a group that takes no part is null."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(UNICODE + pattern), F.lit(g)), lambda x: F.nullif(x, F.lit(""))).alias(f"g{k}") for k, g in enumerate(groups, 1)]
    return F.arrays_zip(*found)


def split_articles(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, article_number, body): what stands before the first header goes. The same pattern
    splits and extracts, so that numbers and bodies align."""
    numbers = F.regexp_extract_all(text_col, F.lit(HEADER), F.lit(1))
    bodies = F.split(text_col, HEADER)
    parts = F.arrays_zip(numbers.alias("n"), F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0))).alias("b"))
    return docs.select(id_col, F.posexplode(parts).alias("pos", "x")).select(id_col, "pos", article_number(F.col("x.n")).alias("article_number"), F.col("x.b").alias("body"))


def first_seen(frame: DataFrame, *keys: str) -> DataFrame:
    """Of equal keys the smallest pos stays; keys include the row's own."""
    return frame.groupBy(*keys).agg(F.min("pos").alias("pos"))


def cross_references(docs: DataFrame, id_col: str, text_col: str, regulation_col: str) -> DataFrame:
    """(id, regulation_id, article_number, ayat, pos), without references to the own regulation."""
    found = docs.select(id_col, F.col(regulation_col).alias("_own"), F.posexplode(every(F.col(text_col), CROSS, 1, 2, 3, 4, 5)).alias("pos", "x"))
    target = F.concat_ws(" ", regulation_type(F.col("x.g3")), F.col("x.g4"), F.lit("TAHUN"), F.col("x.g5"))
    named = found.select(id_col, "_own", "pos", target.alias("regulation_id"), article_number(F.col("x.g1")).alias("article_number"), F.col("x.g2").alias("ayat"))
    return first_seen(named.filter(F.upper("regulation_id") != F.upper("_own")), id_col, "regulation_id", "article_number", "ayat")


def intra_references(docs: DataFrame, id_col: str, text_col: str, number_col: str) -> DataFrame:
    """(id, article_number, ayat, pos), without the article itself. References to other regulations are taken
    out first; the mark in their place joins no words, so nothing new arises."""
    rest = F.regexp_replace(text_col, UNICODE + CROSS, "§")
    found = docs.select(id_col, F.col(number_col).alias("_own"), F.posexplode(every(rest, INTRA, 1, 2)).alias("pos", "x"))
    named = found.select(id_col, "_own", "pos", article_number(F.col("x.g1")).alias("article_number"), F.col("x.g2").alias("ayat"))
    return first_seen(named.filter(F.col("article_number") != article_number(F.col("_own"))), id_col, "article_number", "ayat")


def amendments(docs: DataFrame, id_col: str, title_col: str) -> DataFrame:
    """(id, regulation_id, action): at most one of each title."""
    action = F.regexp_extract(title_col, UNICODE + AMENDS, 1)
    rest = F.regexp_replace(title_col, UNICODE + AMENDS, "")
    part = lambda g: F.nullif(F.regexp_extract(rest, UNICODE + TITLE_REFERENCE, g), F.lit(""))
    target = F.concat_ws(" ", regulation_type(part(1)), part(2), F.lit("TAHUN"), F.coalesce(part(3), part(4)))
    return docs.filter((action != "") & part(1).isNotNull()).select(id_col, target.alias("regulation_id"), F.when(F.lower(action).startswith("pencabutan"), "repeals").otherwise("amends").alias("action"))


def definitions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, pos): terms of three characters or more with a letter; of spellings that differ in
    case alone the first stays."""
    flat = F.regexp_replace(text_col, r"(?U)\s+", " ")
    found = docs.select(id_col, F.posexplode(F.regexp_extract_all(flat, F.lit(UNICODE + DEFINITION), F.lit(1))).alias("pos", "term")).withColumn("term", strip(F.col("term")))
    fit = found.filter((F.length("term") >= 3) & F.col("term").rlike(r"\p{L}"))
    w = Window.partitionBy(id_col, F.lower("term")).orderBy("pos")
    return fit.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
