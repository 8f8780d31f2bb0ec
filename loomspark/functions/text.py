"""Column functions on text that keep to built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode words: Java's ``\w`` is ASCII only, so the class is spelled out
TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-cased words of a text; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def strip(text: Column) -> Column:
    """White space off both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def bigrams(words: Column) -> Column:
    """Adjacent pairs of an array of words, joined by a space."""
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def ngrams(words: Column, k: int) -> Column:
    """Runs of k words, joined by a space."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>"))


def truthy(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """Similarity of two arrays as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def chunks(text: Column, size: int, overlap: int = 0) -> Column:
    """Pieces of ``size`` code points that start every ``size - overlap`` (or ``size``, if that is not positive)."""
    step = size - overlap if overlap < size else size
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def front_matter_removed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---.*?\n---\n", "")


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def short_label(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def numbered_personas(text: Column) -> Column:
    """What stands after ``Persona 1:`` and the like, one a line."""
    return F.regexp_extract_all(text, F.lit(r"Persona \d+:\s*(.+)"), F.lit(1))


def hash_unit(seed: str, key: Column) -> Column:
    """A number in [0, 1) fixed by seed and key; SQL engines with MD5 agree on it."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def fixed(value: Column, digits: int) -> Column:
    """A number of up to 15 digits with so many decimals, rounded as C does it: by its exact binary value, halves to even."""
    return F.call_function("format_number", value.cast("double"), F.lit("0" + "." * bool(digits) + "0" * digits))


def chart_number(value: Column, whole: bool) -> Column:
    """As charts show it: whole numbers from 10,000 on in thousands with one decimal and ``k``; others with two."""
    if not whole:
        return fixed(value, 2)
    return F.when(value >= 10_000, F.concat(fixed(value / 1000, 1), F.lit("k"))).otherwise(value.cast("long").cast("string"))
