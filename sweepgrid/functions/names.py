"""File and folder names: sort keys, eye tokens, clean names, run numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that name an eye, and words that carry no name.
RIGHT_WORDS = ("OD", "RIGHT", "R")
LEFT_WORDS = ("OS", "LEFT", "L")
NOISE_WORDS = ("Radial", "Primary", "Secondary", "OD", "OS")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def numeric_first_key(name: Column) -> list[Column]:
    """Sort key: names that are whole numbers first, by value however long; the others by name."""
    whole = F.regexp_like(name, F.lit(r"^\s*[+-]?\d+\s*$"))
    digits = F.regexp_extract(name, r"^\s*[+-]?0*(\d*)\s*$", 1)
    sign = F.when(F.contains(name, F.lit("-")), -1).otherwise(1)
    # Of numbers of one sign the longer is the larger, of one length the later in text order; below 0 the other way round.
    size = F.when(whole, sign * F.length(digits))
    flipped = F.translate(digits, "0123456789", "9876543210")
    return [(~whole).cast("int"), size, F.when(whole, F.when(sign < 0, flipped).otherwise(digits)), name]

def eye_token(name: Column) -> Column:
    """OD or OS by the first word that names an eye; null without one."""
    words = F.filter(F.split(F.upper(name), r"[-_\s]+"), lambda w: w.isin(*RIGHT_WORDS, *LEFT_WORDS))
    first = F.get(words, F.lit(0))
    return F.when(first.isin(*RIGHT_WORDS), "OD").when(first.isNotNull(), "OS")


#: What a name is read as, the first that fits: a date or a time, a size, or whatever stands between blanks and dashes.
NAME_PARTS = r"(\b\d{2}-\d{2}-\d{4}\b|\b\d{2}-\d{2}\b|\b\d+\s*[mM][mM]\b|[^\s\-–—]+)"


def clean_base(name: Column) -> Column:
    """The parts of a folder name that say something: no dates, times and noise words; sizes are written closely."""
    parts = F.regexp_extract_all(name, F.lit(NAME_PARTS))
    dated = lambda p: F.regexp_like(p, F.lit(r"^\d{2}-\d{2}(-\d{4})?$"))
    said = F.filter(parts, lambda p: ~dated(p) & ~F.lower(p).isin(*(w.lower() for w in NOISE_WORDS)))
    size = F.transform(said, lambda p: F.when(F.regexp_like(p, F.lit(r"^\d+\s*[mM][mM]$")), F.concat(F.regexp_extract(p, r"^(\d+)", 1), F.lit("mm"))).otherwise(p))
    return F.regexp_replace(F.array_join(size, " "), " ?_ ?", "_")


def volume_prefix(folder: Column, parent: Column) -> Column:
    return F.concat(clean_base(folder), F.lit("_"), F.coalesce(eye_token(folder), eye_token(parent), F.lit("UNK")), F.lit("_EYE_VOL"))


def run_number(file_name: Column) -> Column:
    """The two-digit run number of an exported volume, 0 without one."""
    return F.coalesce(F.regexp_extract(file_name, r"_r(\d{2})\.nrrd$", 1).try_cast("int"), F.lit(0))


def run_suffix(highest: Column) -> Column:
    return F.format_string("r%02d", F.coalesce(highest, F.lit(0)) + 1)


def slice_name(base: str, i: Column, ext: str = ".tif") -> Column:
    return F.format_string(f"{base}_%04d{ext}", i)


def volume_name(base: str, voxel_mm: Column) -> Column:
    return F.format_string(f"{base}_%.3fmm.nrrd", voxel_mm)


def sha1_12(content: Column) -> Column:
    return F.coalesce(F.substring(F.sha1(content), 1, 12), F.lit(""))


def patch_label(mode: str, size: Column) -> Column:
    """The name of a patch by its mode: geodesic and plane in mm, area in mm2, angle in degrees."""
    form = {"geodesic": "geodesic_%.1fmm", "area": "area_%.0fmm2", "angle": "cap_%.0fdeg", "plane": "plane_%.1fmm"}[mode]
    return F.format_string(form, size.cast("double"))
