"""Codes and texts against tables worked out by hand, and against plain versions on random input."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from scanweft.functions import texts
from scanweft.functions.codes import candidates, pad13


def values(spark, kind, given, column):
    table = spark.createDataFrame([(i, x) for i, x in enumerate(given)], f"i int, x {kind}")
    return [r[0] for r in table.orderBy("i").select(column(F.col("x"))).collect()]


def plain_candidates(raw):
    d = "".join(c for c in raw or "" if c in "0123456789")
    if not d:
        return []
    tries = []
    if len(d) == 14:
        tries += [d.lstrip("0").rjust(13, "0"), d[1:]]
    return list(dict.fromkeys([*tries, d.rjust(13, "0")]))


def test_candidates_table(spark):
    table = {"": [], "abc": [], None: [], "12345678": ["0000012345678"], "012345678905": ["0012345678905"], "4-710-0000-00017": ["4710000000017"], "04710000000017": ["4710000000017", "04710000000017"], "14710000000017": ["14710000000017", "4710000000017"], "1234567890123456": ["1234567890123456"], "１２３": []}
    assert values(spark, "string", table, candidates) == list(table.values())


def test_candidates_of_random_codes(spark):
    rng = random.Random(3)
    given = ["".join(rng.choice("00123456789- x") for _ in range(rng.randint(0, 20))) for _ in range(5000)]
    assert values(spark, "string", given, candidates) == [plain_candidates(g) for g in given]


def test_padding_keeps_long_codes(spark):
    assert values(spark, "string", ["", "1", "12345678901234"], pad13) == ["0" * 13, "0" * 12 + "1", "12345678901234"]


def test_clean_leaf(spark):
    table = {"aBubble": "Bubble", "a珍珠": "珍珠", "c（x": "（x", "b9": "9", "apple": "apple", "dX": "dX", "a": "a", "CAKE": "AKE", "p(1)": "(1)", "": "", None: None}
    assert values(spark, "string", table, texts.clean_leaf) == list(table.values())


def test_price_table(spark):
    table = [(0.0, "—"), (-1.0, "—"), (float("nan"), "—"), (None, "—"), (1.005, "$1.00"), (0.125, "$0.13"), (2.675, "$2.67"), (1234.5, "$1234.50"), (0.375, "$0.38"), (1e-9, "$0.00"), (123456.785, "$123456.79")]
    assert values(spark, "double", [x for x, _ in table], texts.price_text) == [s for _, s in table]


def test_prices_are_exact(spark):
    rng = random.Random(7)
    given = [round(rng.uniform(0, 3000), rng.randint(0, 4)) or 1.0 for _ in range(4000)] + [k / 8 for k in range(1, 2000)] + [k / 200 for k in range(1, 2000)]
    want = ["$" + str(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP)) for x in given]
    assert values(spark, "double", given, texts.price_text) == want


def test_terms(spark):
    table = {"": [], "   ": [], "　": [], None: [], " Red  red　BOLT ": ["red", "bolt"], "a b﻿c\td": ["a", "b", "c", "d"], "100% _x": ["100%", "_x"], "a\x85b": ["a\x85b"]}
    assert values(spark, "string", table, texts.terms) == list(table.values())


def test_lengths_and_labels(spark):
    assert values(spark, "string", ["", "ab", "é珍", "😀a"], texts.utf16_length) == [0, 2, 2, 3]
    assert values(spark, "string", ["a", "b", "c", "?", "z", None], texts.layer_label) == ["件（最小單位）", "中層包裝", "箱", "—", "—", "—"]
    assert values(spark, "string", ["a", "?", "z", None], texts.layer_label_in_list) == ["件（最小單位）", "—", "", ""]
    assert values(spark, "string", ["a", "b", "c", "?", None], texts.price_label) == ["件價（a）", "中層價（b）", "箱價（c）", "單價", "單價"]
    assert values(spark, "int", [None, 0, 3], texts.badge) == [None, None, "熱銷 TOP 3"]
    assert values(spark, "int", [None, 0, 3, 1500], texts.rank_or_last) == [999, 999, 3, 1500]
    assert values(spark, "array<string>", [None, [], [""], [None, "2"], ["1", "2"]], texts.first_barcode) == ["無條碼"] * 4 + ["1"]
    assert values(spark, "long", [0, 1_700_000_000_000], texts.local_time) == ["1/1 00:00", "11/14 22:13"]


@pytest.mark.parametrize(("name", "desc", "want"), [("A", "B", "a b"), ("A", None, "a "), (None, None, " ")])
def test_haystack(spark, name, desc, want):
    assert spark.range(1).select(texts.haystack(F.lit(name).cast("string"), F.lit(desc).cast("string"))).first()[0] == want
