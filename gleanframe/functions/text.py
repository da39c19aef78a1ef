"""Text cleaning as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accented letters and their plain forms, position by position.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
# Letters that become two.
DIGRAPHS = {"œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "ß": "ss"}

# The departments reported together under one label.
PARIS_REGION = (
    "Essonne", "Hauts-de-Seine", "Paris", "Seine-Saint-Denis",
    "Seine-et-Marne", "Val-d'Oise", "Val-de-Marne", "Yvelines",
)
PARIS_REGION_LABEL = "Ile-de-France"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_accents(x: Column | str, also: str = "", to: str = "") -> Column:
    """Plain letters for accented ones; ``also``/``to`` ride along in the same pass."""
    out = F.translate(_col(x), ACCENTED + also, PLAIN + to)
    for letter, pair in DIGRAPHS.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return out


def accent_blind(x: Column | str) -> Column:
    """Text that compares, joins and groups without regard to accents, in any script and any normal form."""
    return F.collate(_col(x), "UNICODE_AI")


def normalise_name(x: Column | str) -> Column:
    """Place names for joining: hyphens and apostrophes to blanks, no accents."""
    return strip_accents(x, "-'", "  ")


def fuse_places(x: Column | str, members=PARIS_REGION, label: str = PARIS_REGION_LABEL) -> Column:
    """Give a set of places one common label."""
    x = _col(x)
    return F.when(x.isin(list(members)), label).otherwise(x)


def replace_first(x: Column | str, pattern: str, replacement: str = "") -> Column:
    """Replace only the first match (Spark's ``regexp_replace`` takes them all)."""
    return F.regexp_replace(_col(x), f"(?s)^(.*?)(?:{pattern})", f"$1{replacement}")


def remove_parenthesis(x: Column | str, trim: bool = True) -> Column:
    """Drop everything from the first ``(`` to the last ``)``."""
    out = F.regexp_replace(_col(x), r"\(.*\)", "")
    return F.trim(out) if trim else out


def remove_code(x: Column | str) -> Column:
    """Drop the first bracketed area code, e.g. ``Place (2B)``."""
    x = _col(x)
    return F.trim(F.when(x.contains("("), replace_first(x, r"\s*\([0-9AB]+\)")).otherwise(x))


def extract(x: Column | str, pattern: str, group: int = 0) -> Column:
    """First match, or null (Spark gives an empty string)."""
    return F.nullif(F.regexp_extract(_col(x), pattern, group), F.lit(""))


def sentence_case(x: Column | str) -> Column:
    """First letter upper, the rest lower."""
    x = _col(x)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))


def squeeze(x: Column | str, char: str = "_") -> Column:
    """Runs of one character become a single one."""
    return F.regexp_replace(_col(x), f"{char}{{2,}}", char)


def replace_chain(x: Column | str, rules) -> Column:
    """Apply pattern replacements one after the other."""
    out = _col(x)
    for pattern, replacement in rules:
        out = F.regexp_replace(out, pattern, replacement)
    return out
