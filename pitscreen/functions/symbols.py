"""Ticker normalisation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed patterns of the vendor's identifiers.
PLACEHOLDER = r"^[0-9]{7}[A-Z]$"
INTERNAL_ID = r"^\d{6,}[A-Z]?$"
US_PLAIN = r"^[A-Z.\-/]+$"


def listing_root(vendor_id: Column) -> Column:
    """'AAPL UW Equity' -> 'AAPL'; placeholder codes and one-word ids -> null."""
    parts = F.split(F.trim(F.regexp_replace(vendor_id, " Equity", "")), r"\s+")
    root = F.get(parts, F.lit(0))
    return F.when((F.size(parts) >= 2) & ~F.rlike(root, F.lit(PLACEHOLDER)), root)


def price_symbol(vendor_id: Column, market: str) -> Column:
    root = listing_root(vendor_id)
    return F.concat(root, F.lit(".T")) if market == "japan" else root


def plain_symbol(vendor_id: Column, market: str) -> Column:
    """Mechanical mapping for ids no table resolves; internal ids -> null."""
    head = F.get(F.split(F.trim(vendor_id), r"\s+"), F.lit(0))
    internal = F.rlike(head, F.lit(INTERNAL_ID))
    if market == "japan":
        usable, out = F.rlike(head, F.lit(r"^\d+$")), F.concat(head, F.lit(".T"))
    else:
        usable, out = F.rlike(head, F.lit(US_PLAIN)), F.replace(head, F.lit("/"), F.lit("-"))
    return F.when(~internal & usable, out)


def member_symbol(raw: Column) -> Column:
    return F.upper(F.replace(F.trim(raw), F.lit("."), F.lit("-")))
