"""A small corpus of regulation texts, as VALUES that Spark and DuckDB both read."""

from __future__ import annotations

NBSP = " "
#: regulation id, title, article number, text
ARTICLES = [
    ("PP 1 TAHUN 2020", "Perubahan atas Peraturan Pemerintah Nomor 9 Tahun 2015", "4", "Sesuai Pasal 4 dan Pasal 5 ayat (1) serta Pasal 10O, juga pasal 7a."),
    ("UU 31 TAHUN 2017", "Pencabutan Peraturan Menteri Keuangan Nomor 52/PMK.07/2014", "2", "Pasal 3 Undang-Undang Nomor 8 Tahun 1983 dan Pasal 3 ayat (2) Peraturan Menteri Keuangan Republik Indonesia Nomor 99/PMK Tahun 2018; lihat Pasal 3."),
    ("PMK 44 TAHUN 2022", "Perubahan Kedua atas PMK Nomor 61 Tahun 2019", "1", f"Dalam ini, yang dimaksud dengan: 1. Pajak Pusat adalah pungutan. 2. Wajib{NBSP}Pajak, yang selanjutnya disebut WP, adalah orang. 3. pajak pusat adalah lagi. 4. F1 adalah x. 5. Kas Negara yang selanjutnya disingkat KN, adalah kas."),
    ("UU 13TAHUN2003", "Tentang Ketenagakerjaan", "9", "Pasal 9 UU Nomor 13 Tahun 2003 dan Pasal 8 Perppu Nomor 2 Tahun 2022 dan Pasal 6 Keputusan Menteri Keuangan Nomor 5 Tahun 1999 dan Pasal 1 KMK Nomor 4 Tahun 2001."),
    ("PP 23 TAHUN 1991", "Pencabutan atas UU Nomor 8 Tahun 1983 dan lainnya", "3", "Pasal 2 PP Nomor 23 Tahun 1991 dan Pasal 2 Peraturan\nPemerintah Nomor 24 Tahun 1992. Pasal 2 ayat (1) dan Pasal 2 ayat (1)."),
    ("KMK 5 TAHUN 1999", "Perubahan atas ketentuan umum", "1", "Tidak ada apa-apa di sini."),
    ("UNKNOWN", "", "12", ""),
]
#: id, whole text of a regulation
REGULATIONS = [
    (1, "Pembukaan\nPasal 1\nIsi satu.\n Pasal  2A \nIsi dua\nlagi.\nPasal 3\nPasal 4\nIsi empat."),
    (2, "Pasal 1\nTanpa pembukaan.\npasal 12b\n"),
    (3, "Tidak ada pasal. Lihat Pasal 4 di atas."),
    (4, "x\nPasal 1O\ny\n\tPasal\t7\t\nz"),
]
#: raw keys, types, dates and notes for the scalar functions
KEYS = [
    ("01_PMK_010_2011_1", "Peraturan Pemerintah", "Ditetapkan: 1 Mei 2020", "DRAFT: x"), ("01/PMK.010/2011", "Peraturan Menteri Keuangan", "Diundangkan:2 Juni 2021", " draft"),
    ("PP 7TAHUN 1977", "Keputusan Menteri Keuangan", f"Ditetapkan:{NBSP}3", "checked"), ("PMK 18 TAHUN 2026", "Perppu", "4 Juli", None), ("a b c d 12", "Undang-Undang", " 5 ", ""),
    ("a-b~c.d/123", "Peraturan\nPemerintah Pengganti Undang-Undang", "6", "  Draft"), ("x y 9", "Surat Edaran", "", "ok DRAFT"), ("  UU__3 ", "KMK", "7", "verified"),
]


def _quote(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def values_sql(rows: list[tuple], *names: str) -> str:
    """A SELECT that DuckDB reads; the texts have no backslash, so that both engines' literals agree."""
    body = ", ".join("(" + ", ".join(map(_quote, r)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(names)}))"
