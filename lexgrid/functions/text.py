"""Text functions of the corpus, Column to Column."""

from __future__ import annotations

import html.entities
import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords of regulation types, the first that is contained wins.
REGULATION_TYPES = [
    ("pengganti", "PERPU"), ("pemerintah", "PP"), ("menteri keuangan", "PMK"), ("undang", "UU"), ("keputusan", "KMK"),
    ("perpu", "PERPU"), ("pp", "PP"), ("pmk", "PMK"), ("uu", "UU"), ("kmk", "KMK"),
]
#: How an elucidation opens, what a suspect id looks like, and lengths.
ELUCIDATION = r"(?iU)^\s*(Ayat\s*\(|Huruf\s|Angka\s|Cukup\s+jelas)"
SUSPECT_ID = r"::[^:]*[0-9]?O[0-9]?"
USABLE_LENGTH, COLLISION_LENGTH, FINGERPRINT_LENGTH, IMAGE_LENGTH, INPUT_LENGTH = 15, 300, 200, 50, 6000
#: Date labels and file endings.
DATE_LABELS = ["Ditetapkan: ", "Diundangkan: ", "Ditetapkan:", "Diundangkan:"]
CONTENT_TYPES = {
    "application/pdf": ".pdf", "text/html": ".html", "application/msword": ".doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx", "application/zip": ".zip", "text/plain": ".txt",
}
ENDINGS = [(".pdf", ".pdf"), (".html", ".html"), (".htm", ".html"), (".docx", ".docx"), (".doc", ".doc"), (".txt", ".txt")]
DOWNLOAD_LINK = r"(?i)/api/download/[^\"'<>\s]+"


def strip(c: Column) -> Column:
    """All Unicode white space at either end goes."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalise_key(c: Column) -> Column:
    """Separators become single spaces, a digit and a letter part, upper case; a last token of one or two
    digits goes if at least five tokens are there."""
    spaced = F.regexp_replace(F.regexp_replace(c, r"(?U)[\s_/.\-~]+", " "), "([0-9])([A-Za-z])", "$1 $2")
    tokens = F.split(F.upper(F.trim(spaced)), " ")
    copy = (F.size(tokens) >= 5) & F.element_at(tokens, -1).rlike("^[0-9]{1,2}$")
    return F.array_join(F.when(copy, F.slice(tokens, F.lit(1), F.size(tokens) - 1)).otherwise(tokens), " ")


def article_number(c: Column) -> Column:
    return F.translate(F.upper(strip(c)), "O", "0")


def clean_space(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def regulation_type(c: Column) -> Column:
    low = F.lower(strip(c))
    return reduce(lambda rest, kc: F.when(low.contains(kc[0]), kc[1]).otherwise(rest), reversed(REGULATION_TYPES), F.upper(c))


def regulation_parts(c: Column) -> Column:
    """A struct of type, number and year; UNKNOWN, 0, 0 for other shapes."""
    pattern = r"(?iU)^(\w+)\s+([0-9]+)\s+TAHUN\s+([0-9]{4})$"
    fits = c.rlike(pattern)
    part = lambda k: F.regexp_extract(c, pattern, k)
    return F.struct(
        F.when(fits, F.upper(part(1))).otherwise("UNKNOWN").alias("type"),
        F.when(fits, part(2).try_cast("long")).otherwise(0).alias("number"), F.when(fits, part(3).try_cast("long")).otherwise(0).alias("year"),
    )


def title_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"TAHUN\s+([0-9]{4})", 1), F.lit(""))


def date_text(c: Column) -> Column:
    return strip(reduce(lambda x, label: F.replace(x, F.lit(label), F.lit("")), DATE_LABELS, c))


def safe_basename(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^\w\-]", "_")


def article_id(regulation: Column, number: Column) -> Column:
    return F.concat_ws("::", regulation, number)


def article_text(content: Column, raw: Column) -> Column:
    empty = F.lit("")
    return strip(F.coalesce(F.nullif(content, empty), F.nullif(raw, empty), empty))


def is_elucidation(text: Column) -> Column:
    return text.rlike(ELUCIDATION)


def is_usable(text: Column) -> Column:
    return (F.length(text) >= USABLE_LENGTH) & ~is_elucidation(text)


def is_definitional(number: Column, content: Column) -> Column:
    return (F.upper(number) == "1") & F.lower(content).contains("yang dimaksud dengan")


def is_image_only(page_texts: Column) -> Column:
    """Fewer than 50 characters a page."""
    total = F.aggregate(page_texts, F.lit(0), lambda n, t: n + F.length(t))
    return total / F.greatest(F.size(page_texts), F.lit(1)) < IMAGE_LENGTH


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def is_verified(notes: Column) -> Column:
    return ~F.upper(F.regexp_replace(F.coalesce(notes, F.lit("")), r"(?U)^\s+", "")).startswith("DRAFT")


def is_suspect_id(c: Column) -> Column:
    return c.rlike(SUSPECT_ID)


def fingerprint(c: Column) -> Column:
    return F.substring(c, 1, FINGERPRINT_LENGTH)


def model_input(c: Column, length: int = INPUT_LENGTH) -> Column:
    return F.substring(c, 1, length)


def score_of(distance: Column) -> Column:
    return 1 - distance


def as_score(c: Column) -> Column:
    """Null and what isn't a number become NaN."""
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(float("nan")))


def file_extension(content_type: Column, url: Column) -> Column:
    """By content type without its parameters, else by the url's ending, else .bin."""
    kind = F.lower(strip(F.substring_index(content_type, ";", 1)))
    by_type = reduce(lambda rest, kv: F.when(kind == kv[0], kv[1]).otherwise(rest), CONTENT_TYPES.items(), F.lit(None).cast("string"))
    by_end = reduce(lambda rest, kv: F.when(F.lower(url).endswith(kv[0]), kv[1]).otherwise(rest), reversed(ENDINGS), F.lit(".bin"))
    return F.coalesce(by_type, by_end)


def links(html: Column, pattern: str = DOWNLOAD_LINK, group: int = 0) -> Column:
    """All matches, each once, in the order in which they are first seen."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(group)))


#: The named character references of HTML, as the standard library has them: with and without the semicolon where both are known.
_NAMED = json.dumps(html.entities.html5)
#: What browsers take the control characters 128 to 159 for.
_WINDOWS = {i: bytes([i]).decode("cp1252") for i in range(128, 160) if bytes([i]).decode("cp1252", "ignore")}
_REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"


def unescape(c: Column, ended: bool = False) -> Column:
    """All character references decoded, decimal, hexadecimal and named; others stay as they are. The text is cut at
    its references, which are looked up in one constant map, and joined again; a text without any is left alone.
    ``ended``: those without a semicolon stay too."""
    reference = _REFERENCE.replace(";?", ";") if ended else _REFERENCE
    names = F.from_json(F.lit(_NAMED), "map<string,string>")
    old = F.create_map(*(F.lit(x) for kv in _WINDOWS.items() for x in kv))

    def decoded(ref: Column) -> Column:
        body = F.rtrim(ref, F.lit(";"))
        code = F.when(ref.rlike("^#[xX]"), F.conv(F.substring(body, 3, 10), 16, 10)).otherwise(F.substring(body, 2, 12)).try_cast("long")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.when(ref.startswith("#"), F.coalesce(F.element_at(old, code), char)).otherwise(F.coalesce(F.element_at(names, ref), F.concat(F.lit("&"), ref)))

    refs = F.transform(F.regexp_extract_all(c, F.lit(reference), F.lit(1)), decoded)
    pieces = F.split(c, reference, -1)
    joined = F.array_join(F.zip_with(pieces, refs, lambda piece, ref: F.concat(piece, F.coalesce(ref, F.lit("")))), "")
    return F.when(c.contains("&"), joined).otherwise(c)


def html_text(page: Column, ended: bool = False) -> Column:
    """The text nodes one a line, without script, style and head, in built-in functions. ``ended`` as in :func:`unescape`."""
    bare = F.regexp_replace(page, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<!doctype[^>]*>", "")
    return unescape(F.regexp_replace(F.regexp_replace(bare, r"(<[^>]*>)+", "\n"), r"^\n+|\n+$", ""), ended)


def references_json(c: Column) -> Column:
    return F.to_json(c)


def references_of(c: Column) -> Column:
    """References from their JSON; null and broken texts have none."""
    found = F.from_json(c, "array<struct<article:string,ayat:string>>")
    return F.coalesce(found, F.array().cast("array<struct<article:string,ayat:string>>"))


def decode_page(data: Column) -> Column:
    """Bytes as UTF-8 if they are that, else as ISO-8859-1, which takes any bytes."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.decode(data, "ISO-8859-1"))
