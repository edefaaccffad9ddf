"""Name and id keys, as Column functions.

Species names come with spaces or underscores, in any case and with trailing words; each key below is
one way to call two of them equal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def underscore_key(c: Column | str) -> Column:
    """Space and underscore alike, case-blind; not trimmed."""
    return F.lower(F.translate(_col(c), " ", "_"))


def squeezed_key(c: Column | str) -> Column:
    """Of a stored name: lower case without underscores; spaces stay."""
    return F.replace(F.lower(_col(c)), F.lit("_"), F.lit(""))


def squeezed_query(c: Column | str) -> Column:
    """Of a name asked for: trimmed, lower case, without spaces and underscores."""
    return F.translate(F.lower(F.trim(_col(c))), " _", "")


def binomial_key(c: Column | str) -> Column:
    """First two parts of the cleaned name, which folds subspecies and authors into the species."""
    clean = F.translate(F.lower(F.trim(_col(c))), " ", "_")
    parts = F.array_remove(F.split(clean, "_"), "")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 1, 2), "_")).otherwise(clean)


def lower_key(c: Column | str) -> Column:
    return F.lower(_col(c))


def capitalised(c: Column) -> Column:
    """First letter upper, the rest kept."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**31 - 1))


def display_name(c: Column | str, lower: bool = False) -> Column:
    """Underscores as spaces, first letter upper; ``lower`` also lowers the rest."""
    spaced = F.translate(_col(c), "_", " ")
    return capitalised(F.lower(spaced) if lower else spaced)


def folder_name(c: Column | str) -> Column:
    """Folder to "Genus epithet": of exactly two parts the genus is capitalised and the epithet
    lowered; other names have their underscores replaced and start with a capital."""
    parts = F.split(_col(c), "_")
    two = F.concat_ws(" ", F.initcap(F.get(parts, 0)), F.lower(F.get(parts, 1)))
    spaced = F.lower(F.translate(_col(c), "_", " "))
    return F.when(F.size(parts) == 2, two).otherwise(capitalised(spaced))


def image_id(path: Column | str) -> Column:
    """File stem of a path."""
    name = F.substring_index(_col(path), "/", -1)
    return F.when(F.instr(name, ".") > 1, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def parent_folder(path: Column | str) -> Column:
    return F.get(F.reverse(F.split(_col(path), "/")), F.lit(1))
