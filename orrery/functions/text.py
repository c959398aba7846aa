"""Normalisers and text classifiers as pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Trailing legal forms, unit markers, directions and street suffixes.
LEGAL_FORMS = ["LLC", "L L C", "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LP", "LLP", "PC", "PLLC", "DBA"]
UNIT_MARKERS = ["SUITE", "STE", "APARTMENT", "APT", "UNIT", "ROOM", "RM", "FLOOR", "FL", "BUILDING", "BLDG", "BASEMENT", "BSMT", "SPACE", "SPC", "REAR", "LL"]
SUFFIXES = ["ST", "STREET", "AVE", "AVENUE", "BLVD", "BOULEVARD", "RD", "ROAD", "DR", "DRIVE", "PL", "PLACE", "CT", "COURT", "PKWY", "LN", "LANE"]
FOLDED_FROM = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED_TO = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
BOUNDS = (41.60, 42.10, -87.95, -87.50)


def collapsed(c: Column) -> Column:
    """Upper case, ends trimmed, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.upper(c), r"\s+", " "))


def name_key(c: Column) -> Column:
    """A comparable name: folded, upper case, marks as spaces, legal forms and THE dropped.

    Null stays null; a name that would vanish keeps its unstripped form.
    """
    s = F.upper(F.translate(c, FOLDED_FROM, FOLDED_TO))
    s = F.regexp_replace(F.regexp_replace(s, "'S\\b", "S"), "&", " AND ")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "[^A-Z0-9]+", " "), " +", " "))
    cut = F.regexp_replace(F.regexp_replace(s, f"( ({'|'.join(LEGAL_FORMS)}))+$", ""), "^(THE )+", "")
    return F.when(cut == "", s).otherwise(cut)


def zip_key(c: Column) -> Column:
    digits = F.substring(F.regexp_replace(c, "[^0-9]", ""), 1, 5)
    return F.when((F.length(digits) == 5) & (digits != "00000"), digits)


def licence_key(c: Column) -> Column:
    return F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("0"))


def units(c: Column) -> Column:
    """The distinct unit values of an address, sorted and joined by a space."""
    found = F.regexp_extract_all(F.upper(c), F.lit(rf"\b(?:{'|'.join(UNIT_MARKERS)})\b\.?\s*([A-Z0-9][A-Z0-9\-]*)"), F.lit(1))
    return F.array_join(F.array_sort(F.array_distinct(found)), " ")


def address_key(address: Column, zip_: Column) -> Column:
    """``house|street|zip`` with unit, suffix and ordinal endings left out; null without a house.

    Ranges and fractions of a house number go; a leading direction is one letter.
    """
    s = collapsed(F.translate(address, FOLDED_FROM, FOLDED_TO))
    s = F.trim(F.regexp_replace(s, rf" (?:{'|'.join(UNIT_MARKERS)})\b\.?\s*(?:[A-Z0-9][A-Z0-9\-]*)?", ""))
    house = F.regexp_extract(s, r"^([0-9]+)(?:-[0-9]+)?(?: 1/2)? ", 1)
    street = F.regexp_replace(s, r"^[0-9]+(?:-[0-9]+)?(?: 1/2)? +", "")
    street = F.regexp_replace(street, r"^(N|S|E|W)(?:ORTH|OUTH|AST|EST)?\.? ", "$1 ")
    street = F.regexp_replace(F.regexp_replace(street, r"\b([0-9]+)(?:ST|ND|RD|TH)\b", "$1"), rf" (?:{'|'.join(SUFFIXES)})\.?$", "")
    return F.when(house != "", F.concat_ws("|", house, F.trim(street), F.coalesce(zip_key(zip_), F.lit(""))))


def geo_key(lat: Column, lon: Column) -> Column:
    """The raw coordinate pair if it reads as numbers inside the bounds, else a reason."""
    y, x = lat.try_cast("double"), lon.try_cast("double")
    low, high, west, east = BOUNDS
    return F.when(lat.isNull() | lon.isNull(), "missing").when(y.isNull() | x.isNull(), "unreadable").when(~(y.between(low, high) & x.between(west, east)), "outside").otherwise(F.concat_ws(",", lat, lon))


def entries(text: Column) -> Column:
    """The non-empty trimmed entries of a text that separates them by ``|``."""
    return F.filter(F.transform(F.split(text, r"\|"), lambda e: F.trim(e)), lambda e: e != "")


def severity(text: Column, foundation: str, priority: str, narrative: str) -> Column:
    """foundation / priority / none, looking at chunks that are not narrative only."""
    chunks = F.filter(F.split(text, r"[.;|]"), lambda c: ~c.rlike(narrative))
    return F.when(F.exists(chunks, lambda c: c.rlike(foundation)), "foundation").when(F.exists(chunks, lambda c: c.rlike(priority)), "priority").otherwise("none")


def evidence(text: Column, marker: str) -> Column:
    """Up to 30 characters before and 60 after the first marker."""
    return F.regexp_extract(text, f"(?s)(.{{0,30}}{marker}.{{0,60}})", 1)


def signature(*parts: Column) -> Column:
    """SHA-256 of the parts joined by the unit separator; null counts as empty."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
