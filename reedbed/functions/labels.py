"""Vegetation labels and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The classes, and the labels that stand for one of them.
CLASSES = ("barren", "herbs", "populus", "tamarix")
HERB_LABELS = ("herbs", "alhagi", "salicornia", "halocnemum", "phragmites")
CROP_LABELS = ("agri", "agric", "agriculture", "agricultural")


def canonical_label(label: Column) -> Column:
    """Lower case, trimmed, known synonyms merged; other labels stay as they are."""
    low = F.lower(F.trim(label))
    return (
        F.when(low == "tamairx", "tamarix")
        .when(low.isin(*HERB_LABELS), "herbs")
        .when(low.isin(*CROP_LABELS), "agriculture")
        .otherwise(low)
    )


def blank_to_null(label: Column) -> Column:
    """Lower case and trimmed; blank becomes null."""
    low = F.lower(F.trim(label))
    return F.when(low != "", low)


def named_class(label: Column) -> Column:
    """The class that a label names in whatever case, with blanks, synonyms or up to two wrong letters; else null.

    A misspelling must have at least five letters, so that place-holders such as 'none' or 'n/a' name no class.
    """
    low = F.lower(F.regexp_replace(label, r"[\s ]+", ""))
    spelled = [(c, c) for c in CLASSES] + [("bare", "barren")] + [(h, "herbs") for h in HERB_LABELS[1:]]
    exact = F.when(low.isNull(), F.lit(None).cast("string"))
    for name, cls in spelled:
        exact = exact.when(low == name, cls)
    for name, cls in spelled:
        if len(name) >= 5:
            exact = exact.when((F.length(low) >= 5) & (F.length(low) <= 12) & (F.levenshtein(low, F.lit(name)) <= 2), cls)
    return exact


def location_code(lat: Column, lon: Column) -> Column:
    """L_<lat>_<lon> with six decimals; null unless both are finite."""
    finite = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) < float("inf")) & (F.abs(lon) < float("inf"))
    return F.when(finite, F.format_string("L_%.6f_%.6f", F.round(lat, 6), F.round(lon, 6)))


def canonical_id(raw: Column) -> Column:
    """Trimmed; blank becomes null; a number with or without the prefix L or L_ becomes its integer text."""
    t = F.trim(raw)
    bare = F.regexp_replace(t, "^L_?([0-9]+)$", "$1")
    return F.when(t == "", None).when(bare.rlike("^[0-9]+$"), F.regexp_replace(bare, "^0+(?=[0-9])", "")).otherwise(bare)


def scope_token(path: Column) -> Column:
    """low, mid or kon if the path holds it as a delimited token (lower counts as low), else unknown."""
    low = F.lower(path)
    at = lambda word: low.rlike(f"(^|[^a-z0-9])({word})([^a-z0-9]|$)")
    return F.when(at("low|lower"), "low").when(at("mid"), "mid").when(at("kon"), "kon").otherwise("unknown")


def source_tag(path: Column) -> Column:
    """File name without its extension, runs of other characters than letters and digits as one underscore."""
    base = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return F.regexp_replace(base, "[^A-Za-z0-9]+", "_")
