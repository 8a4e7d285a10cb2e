"""Text rules: white space as browsers see it, lengths in UTF-16 units, leaf names, prices and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
WHITE = r"\t\n\x0B\f\r    -     　﻿"

# Labels of packaging layers, on a card and of prices, and other texts shown.
LAYER_LABELS = {"a": "件（最小單位）", "b": "中層包裝", "c": "箱", "?": "—"}
PRICE_LABELS = {"a": "件價（a）", "b": "中層價（b）", "c": "箱價（c）"}
PRICE_LABEL_ELSE = "單價"
NO_LABEL = "—"
NO_PRICE = "—"
NO_BARCODE = "無條碼"
BEST_SELLER = "熱銷 TOP "
BEST_SELLER_SHORT = "TOP "
MANY_ITEMS = "⚠️ 一碼多品項"
UNKNOWN_CODE = "❓ 不在資料庫"

UNRANKED = 999


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def normal_query(query: Column) -> Column:
    """A search as it is matched: trimmed, lower case; null gives ''."""
    return F.lower(trimmed(F.coalesce(query, F.lit(""))))


def terms(query: Column) -> Column:
    """The distinct terms of a search, none for an empty one."""
    q = normal_query(query)
    return F.when(q == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(q, f"[{WHITE}]+")))


def haystack(name: Column, desc: Column) -> Column:
    """What a search looks in. A missing part is empty."""
    return F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(desc, F.lit(""))))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def clean_leaf(leaf: Column) -> Column:
    """Without a one-letter layer prefix before a capital, a digit, a CJK character or an opening bracket."""
    return F.regexp_replace(leaf, r"^[abcpABCP](?=[A-Z0-9一-鿿（(])", "")


def price_text(price: Column) -> Column:
    """$ and two decimals, the exact binary value rounded with ties up; no price if null, NaN or not positive.

    Only odd multiples of 1/8 are ties at two decimals: format_string rounds those up, and format_number
    rounds the exact value of all others.
    """
    tie = F.pmod(price * F.lit(8.0), F.lit(2.0)) == 1.0
    shown = F.when(tie, F.format_string("%.2f", price)).otherwise(F.call_function("format_number", price, F.lit("0.00")))
    real = price.isNotNull() & ~F.isnan(price)
    return F.when(real & (price > 0), F.concat(F.lit("$"), shown)).otherwise(F.lit(NO_PRICE))


def _label(value: Column, labels: dict[str, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for k, label in reversed(labels.items()):
        out = F.when(value == k, label).otherwise(out)
    return out


def layer_label(layer: Column) -> Column:
    """On a card."""
    return _label(layer, LAYER_LABELS, NO_LABEL)


def layer_label_in_list(layer: Column) -> Column:
    """In a list of results, where an unknown layer shows nothing."""
    return _label(layer, LAYER_LABELS, "")


def price_label(layer: Column) -> Column:
    return _label(layer, PRICE_LABELS, PRICE_LABEL_ELSE)


def rank_or_last(rank: Column) -> Column:
    return F.coalesce(F.nullif(rank, F.lit(0)), F.lit(UNRANKED))


def badge(rank: Column, prefix: str = BEST_SELLER) -> Column:
    """The best-seller badge, null if unranked."""
    return F.when(F.coalesce(rank, F.lit(0)) != 0, F.concat(F.lit(prefix), rank.cast("string")))


def first_barcode(codes: Column) -> Column:
    return F.coalesce(F.nullif(F.get(codes, F.lit(0)), F.lit("")), F.lit(NO_BARCODE))


def local_time(t_ms: Column) -> Column:
    """M/d HH:mm in the session's time zone."""
    return F.date_format(F.timestamp_millis(t_ms), "M/d HH:mm")
