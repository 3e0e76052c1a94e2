"""Names and loose numbers."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Letters that decompose into one ASCII letter or digit and marks, and that; then letters with a stroke, which don't decompose.
DECOMPOSED = {c: d[0] for c in map(chr, range(0x80, 0x2100)) for d in [[x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x)]] if len(d) == 1 and d[0].isascii() and d[0].isalnum()}
STROKED = {"ø": "o", "đ": "d", "ħ": "h", "ł": "l", "ı": "i", "ŧ": "t", "ŋ": "n", "ĸ": "k"}
MARKED, PLAIN = ("".join(x) for x in zip(*(DECOMPOSED | STROKED).items(), strict=True))
LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ĳ": "ij", "ﬁ": "fi", "ﬂ": "fl"}
PARTICLES = ("de", "da", "do", "dos", "van", "von", "der", "den", "la", "le", "el", "di", "du")


def fold(name: Column) -> Column:
    """Lower case without marks and ligatures."""
    out = F.translate(F.lower(name), MARKED, PLAIN)
    for ligature, letters in LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    return out


def normalize_name(name: Column) -> Column:
    """Folded alphanumeric tokens, one blank between."""
    return F.trim(F.regexp_replace(fold(name), "[^a-z0-9]+", " "))


def significant_tokens(name: Column) -> Column:
    tokens = F.split(normalize_name(name), " ")
    return F.filter(tokens, lambda t: (F.length(t) >= 2) & ~t.isin(*PARTICLES))


def compatible(a: Column, b: Column) -> Column:
    """Equal after normalising, or sharing a significant token."""
    return (normalize_name(a) == normalize_name(b)) | F.arrays_overlap(significant_tokens(a), significant_tokens(b))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's ratio: twice the matching letters by all letters, matches found longest block first."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def trailing_number(value: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(value, F.lit(r"(\d+)\s*$"), F.lit(1)), F.lit(1)).try_cast("int")


def loose_number(value: Column) -> Column:
    """'55%', ' 1.5 ' and the like; null for the rest."""
    return F.regexp_replace(F.trim(value), "%$", "").try_cast("double")


def season_label(season: Column) -> Column:
    return F.concat(season.cast("string"), F.lit("-"), F.lpad((F.pmod(season + 1, F.lit(100))).cast("string"), 2, "0"))


def canonical_json(columns: dict[str, Column]) -> Column:
    """An object with sorted keys, no blanks and explicit nulls: the same text, hence the same digest, for the same values."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})
