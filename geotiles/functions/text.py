"""Text, number and label functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)"


def sqlite_real(col: Column) -> Column:
    """CAST(text AS REAL) as SQLite does it: longest numeric prefix, else 0; null stays null."""
    s = F.regexp_extract(col.cast("string"), _NUMBER, 1)
    return F.when(col.isNotNull(), F.when(s == "", F.lit(0.0)).otherwise(s.cast("double")))


def filled(col: Column) -> Column:
    """An empty string counts as absent."""
    return F.coalesce(col, F.lit("")) != ""


#: What counts as white space in texts (ASCII blanks, the no-break, typographic and ideographic spaces, line ends, the byte order mark).
BLANKS = "[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"


def clean_text(col: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col.cast("string"), BLANKS, " "))


def first_text(*cols: Column) -> Column:
    """First value that is not blank after cleaning."""
    return F.coalesce(*[F.when(clean_text(c) != "", clean_text(c)) for c in cols])


#: Words that are classes, not names (compared in lower case, spaces as underscores).
GENERIC = frozenset("""
yes no true false unknown none generator tower line plant substation transformer mast antenna station airport aerodrome runway taxiway
terminal apron pharmacy fuel charging_station hospital clinic police fire_station fire_hydrant defibrillator fire_extinguisher shelter
railway_station train_station subway_station bus_station ferry_terminal townhall courthouse prison bunker checkpoint communications_tower
protected_area nature_reserve restaurant cafe bar fast_food pub shop retail commercial tourism attraction hotel transport emergency
government energy communications protected industrial military operational consumer 0 1
""".split())


def is_label(col: Column, generic: frozenset[str] = GENERIC) -> Column:
    """At least two characters and no generic word."""
    said = F.replace(F.lower(clean_text(col)), F.lit(" "), F.lit("_"))
    return F.coalesce((F.length(clean_text(col)) >= 2) & ~said.isin(*sorted(generic)), F.lit(False))


def first_label(*cols: Column, generic: frozenset[str] = GENERIC) -> Column:
    return F.coalesce(*[F.when(is_label(c, generic), clean_text(c)) for c in cols])


def title_case(col: Column) -> Column:
    """Cleaned, underscores as spaces, the first of every run of ASCII letters and digits raised, the rest left as it is."""
    runs = F.regexp_extract_all(F.replace(clean_text(col), F.lit("_"), F.lit(" ")), F.lit("([A-Za-z0-9]+|[^A-Za-z0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[a-z]"), F.concat(
        F.upper(F.substring(r, 1, 1)), F.call_function("substring", r, F.lit(2)))).otherwise(r)), "")


def designators(ref: Column) -> Column:
    """Runway designators of a ref such as ``rwy 09L/27R``: an array, upper case, in order."""
    parts = F.split(F.upper(F.coalesce(ref, F.lit(""))), r"[/;]")
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^\s*RWY\s*", "")))
    return F.filter(clean, lambda p: p != "")


def expected_heading(designator: Column) -> Column:
    """Ten times the runway number, 36 as 0; null if the designator is not a number with L, C, R or T."""
    n = F.regexp_extract(designator, r"^(\d{1,2})[LCRT]?$", 1)
    return F.when(n != "", F.when(n.cast("int") == 36, 0.0).otherwise(n.cast("int") * 10.0))


def elevation_m(col: Column) -> Column:
    """Metres of a number, ``100``, ``100 m`` or ``330 ft``; null otherwise."""
    s = F.trim(col.cast("string"))
    number = F.regexp_extract(s, r"(?i)^(-?\d+(?:\.\d+)?)\s*(m|ft)?$", 1)
    unit = F.lower(F.regexp_extract(s, r"(?i)^(-?\d+(?:\.\d+)?)\s*(m|ft)?$", 2))
    value = F.when(number != "", number.cast("double"))
    return F.when(unit == "ft", value * 0.3048).otherwise(value)


def building_height(height: Column, levels: Column, default: float = 9.0) -> Column:
    """Leading number of height (comma as point), else 3 m a level, in (0, 500]; else the default."""
    h = F.replace(F.regexp_extract(height.cast("string"), r"^\s*([+-]?\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit("."))
    h = F.when(h != "", h.cast("double"))
    whole = F.regexp_extract(levels.cast("string"), r"^\s*([+-]?\d+(?:\.\d+)?)\s*$", 1)
    lv = F.when(whole != "", whole.cast("double"))
    return F.when(h > 0, F.least(h, F.lit(500.0))).when(lv > 0, F.least(lv * 3, F.lit(500.0))).otherwise(F.lit(default))


def natural_key(col: Column) -> Column:
    """Sort key: leading number, then the rest."""
    n = F.regexp_extract(col, r"^(\d+)", 1)
    return F.struct(F.when(n != "", n.cast("int")).alias("number"), F.regexp_replace(col, r"^\d+", "").alias("suffix"))


def admin_codes(col: Column) -> Column:
    """A JSON array, or one code, as an array."""
    return F.when(col.startswith("["), F.from_json(col, "array<string>")).when(filled(col), F.array(col)).otherwise(
        F.array().cast("array<string>"))
