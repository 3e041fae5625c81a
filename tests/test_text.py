from __future__ import annotations

import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from deskgauge.constants import PATTERN_DIGIPASS, PATTERN_SECURITY
from deskgauge.functions import text as X


def apply(spark, texts, function):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()]


def base_letters(text):
    return "".join(c for c in unicodedata.normalize("NFD", text)
                   if unicodedata.category(c) != "Mn")


def test_strip_accents_of_every_letter(spark):
    # Runs of code points, so that all planes are covered in few rows.
    letters = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    letters += [chr(c) for c in range(0xE0100, 0xE01F0)]
    texts = ["a".join(letters[i:i + 50]) for i in range(0, len(letters), 50)]
    assert apply(spark, texts, X.strip_accents) == [base_letters(t) for t in texts]


def test_accent_tables_leave_no_letter_out():
    letters, _, several = X._accent_tables()
    known = set(letters) | set(several)
    for code in range(0x80, sys.maxunicode + 1):
        letter = chr(code)
        if 0xD800 <= code < 0xE000 or "가" <= letter <= "힣":
            continue
        assert (base_letters(letter) != letter) == (letter in known), hex(code)


def test_strip_accents_keeps_null_and_ascii(spark):
    assert apply(spark, [None, "", "Müller-Lüdenscheidt", "O'Neil"], X.strip_accents) == [
        None, "", "Muller-Ludenscheidt", "O'Neil"]


@pytest.mark.parametrize("text, expected", [
    ("jean-pierre o'neil d'ARC", "Jean-Pierre O'Neil D'Arc"), ("élodie", "Élodie"),
    ("3a b2c", "3A B2C"), ("", ""), (None, None), ("ΟΔΥΣΣΕΥΣ'ΣΑΣ", "ΟΔΥΣΣΕΥΣ'ΣΑΣ".title()),
])
def test_title_case(spark, text, expected):
    assert apply(spark, [text], X.title_case) == [expected]


def test_title_case_agrees_with_python(spark):
    rng = random.Random(7)
    alphabet = "aAbBéÉßñÑçœŒæÆüÜοςΣıİǆ'- .0123ªº中ﬁ́ŉ_"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    assert apply(spark, texts, X.title_case) == [t.title() for t in texts]


def test_tags_and_greeting(spark):
    assert apply(spark, ["<p>Bonjour, <b>vol</b></p>", "a < b"], X.strip_tags) == [
        "Bonjour, vol", "a < b"]
    assert apply(spark, ["Bonjour, vol", "BONJOUR"], X.strip_greeting) == [" vol", ""]


@pytest.mark.parametrize("text, expected", [
    ("PIRATÉ", True), ("pirate", True), ("Antivirus", True), ("vol", True), ("vols", True),
    ("envol", False), ("McAfee", True), (None, False), ("rien", False),
])
def test_security_pattern(spark, text, expected):
    assert apply(spark, [text], lambda c: X.matches(c, PATTERN_SECURITY)) == [expected]


def test_carriage_returns_are_ordinary_characters(spark):
    assert apply(spark, ["Bonjour\r\nvol"], X.strip_greeting) == ["\nvol"]
    assert apply(spark, ["vol\r", "vol\n", "vol\nx"],
                 lambda c: X.matches(c, PATTERN_SECURITY)) == [True, True, False]
    assert apply(spark, ["rdv:01\r02\r2024"], X.rdv_date_text) == ["01\r02\r2024"]


def test_digipass_pattern(spark):
    assert apply(spark, ["BIG-IP", "bigip", "VPN", "ip"],
                 lambda c: X.matches(c, PATTERN_DIGIPASS)) == [True, True, True, False]


def test_sentinels_and_blanks(spark):
    assert apply(spark, ["N/A", "a <NA> b", "N/A ", None], X.sentinel_to_null) == [
        None, None, "N/A ", None]
    assert apply(spark, ["", " \t\n", "  ", "a", " a ", "\n a"], X.blank_to_null) == [
        None, None, None, "a", " a ", "\n a"]


def test_display_location(spark):
    assert apply(spark, ["CNR SIEGE SOCIAL", "ailleurs", None], X.display_location) == [
        "DM Siege", "ailleurs", "Pas de location"]


@pytest.mark.parametrize("note, expected", [
    ("#tagp# rdv:26/02/2021", "26/02/2021"), ("#tagp# rdv: 26/02/2021", None),
    ("rdv:1/2/2021 puis:03-04-2021", "03-04-2021"), ("rien", None), (None, None),
])
def test_rdv_date_text(spark, note, expected):
    assert apply(spark, [note], X.rdv_date_text) == [expected]


def test_literals_are_quoted(spark):
    text = "l'a\\b"
    assert spark.range(1).select(F.expr(X.sql_text(text)).alias("v")).collect()[0]["v"] == text
