import re
import unicodedata

from lumenfold.functions import text


def by_decomposition(s):
    return re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", s.lower()))


def test_folding_is_unicode_decomposition(spark):
    words = ["Crème Brûlée", "Ångström", "Việt Nam", "Ελλάδα ΰ ἄνθρωπος", "Ёлка Йод Їжак", "e\u0301cole", "Łódź ø đ ß Æ", "İstanbul", "ǖ ǭ ȱ ḗ ṩ ẫ", "日本 한국", "", "plain"]
    rows = spark.createDataFrame([(w,) for w in [*words, None]], "w string").select("w", text.folded("w").alias("f")).collect()
    hangul = {"日本 한국"}  # composed of letters, not of a letter and marks: left as it is
    assert all(r.f == (r.w if r.w in hangul or r.w is None else by_decomposition(r.w)) for r in rows)
    assert {r.w: r.f for r in rows}["Łódź ø đ ß Æ"] == "łodz ø đ ß æ"
