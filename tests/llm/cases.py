"""Small tables with every awkward row, and helpers shared by the tests of this folder."""

import os
import sys

LONG = " ".join(f"w{i * i % 9973}" for i in range(60_000))
SF = "/root/testdata/sf0.001"
HAVE_SF = os.path.isdir(SF)
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, key long, component long, sketch string, "
          "severity string, grade string, mix_pass int, part int, tail int, k int, h int, url string, size int, held_out int, score string")

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog again and again", "en", "a"),  # an exact copy
    (3, "THE QUICK brown fox jumps over the lazy dog again and AGAIN", "en", None),  # equal in lower case
    (4, None, None, None),
    (5, "", "en", "b"),
    (6, " \t\n ", "en", "b"),
    (7, "one", "en", "b"),
    (8, "one two three", "fr", "b"),
    (9, "...!!! 123 ###", "fr", "c"),
    (10, LONG, "en", "a"),
    (11, LONG + " tail", "en", "a"),
    (11, LONG + " tail", "en", "a"),  # a repeated row
    (12, "été à la plage où ça va très bien aujourd'hui même l'été", "fr", "c"),
    (None, "a text without a number", "en", "c"),
    (None, None, None, None),
    (13, "Released under the MIT License. All rights reserved. CC BY 4.0", "en", "c"),
    (14, "x" * 300_000, "en", "a"),
    (15, "Ünïcödé 日本語 😀 " * 40, "de", "d"),
]


def awkward(spark, rows=TEXTS):
    """Documents with nulls, empty and long texts, copies, repeated rows and columns of clashing names."""
    full = [(d, t, lang, s, None if t is None else len(t)) + (7, 7, 7, "x", "x", "x", 7, 7, 7, 7, 7, "x", 7, 7, "x") for d, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})
