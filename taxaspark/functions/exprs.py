"""Column expressions: predicates, scores, text clean-up and labels. All of them native."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields that an all-field search looks at, in order.
SEARCH_FIELDS = ("class_dv", "family", "species", "sex", "life_stage", "source_db", "kingdom", "phylum", "class", "order", "common_name")
RANK_FIELDS = ("family", "class", "order", "phylum", "kingdom")
#: Half a box's height in metres, and metres in a degree of latitude.
BOX_METRES, DEGREE_METRES = 50_000, 111_100
#: Labels of trait and conservation codes.
VOLTINISM = {"u": "Univoltine", "b": "Bivoltine", "m": "Multivoltine", "na": "Unknown"}
DIAPAUSE = {"l": "Larva", "p": "Pupa", "pl": "Pupa or Larva", "a": "Adult", "na": "No diapause or data unavailable"}
OVIPOSITION = {"s": "Solitary", "g": "Gregarious", "sc": "Scattered", "na": "Unknown"}
RED_LIST = {
    "NE": "Not Evaluated", "DD": "Data Deficient", "LC": "Least Concern", "NT": "Near Threatened", "VU": "Vulnerable",
    "EN": "Endangered", "CR": "Critically Endangered", "EW": "Extinct in the Wild", "EX": "Extinct",
}


def spaced(name: str) -> Column:
    return F.translate(F.col(f"`{name}`"), "_", " ")


def field_match(name: str, query: str) -> Column:
    """Case-blind substring, underscores as spaces on both sides; % in the query is a wildcard."""
    pattern = "%" + query.replace("_", " ").replace("\\", "\\\\") + "%"
    return spaced(name).ilike(pattern)


def any_field_match(query: str, fields: Iterable[str] = SEARCH_FIELDS) -> Column:
    return reduce(or_, [F.coalesce(field_match(f, query), F.lit(False)) for f in fields])


def bbox(lat0: float, lat1: float, lon0: float, lon1: float) -> Column:
    return F.col("lat").between(lat0, lat1) & F.col("lon").between(lon0, lon1)


def parse_coordinate(text: Column) -> Column:
    """Struct (lat, lon) of two plain numbers parted by a comma, semicolon or spaces; null if the text
    is something else or the numbers are out of range."""
    words = F.split(F.trim(text), r"\s*[,;]\s*|\s+", -1)
    plain = F.forall(words, lambda w: w.rlike(r"^[-+]?\d+(\.\d+)?$"))
    lat, lon = (F.get(words, F.lit(k)).try_cast("double") for k in (0, 1))
    return F.when((F.size(words) == 2) & plain & lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def coordinate_box(lat: Column, lon: Column) -> Column:
    """Struct (lat0, lat1, lon0, lon1) around a point."""
    up = F.lit(BOX_METRES / DEGREE_METRES)
    side = up / F.greatest(F.cos(F.radians(lat)), F.lit(0.01))
    return F.struct((lat - up).alias("lat0"), (lat + up).alias("lat1"), (lon - side).alias("lon0"), (lon + side).alias("lon1"))


def near_point(text: str) -> Column:
    """Whether lat and lon lie in the box around a point given as text; false if it is none."""
    point = parse_coordinate(F.lit(text))
    box = coordinate_box(point["lat"], point["lon"])
    return F.coalesce(F.col("lat").between(box["lat0"], box["lat1"]) & F.col("lon").between(box["lon0"], box["lon1"]), F.lit(False))


def location_filter(place: str) -> Column:
    """Up to three characters: country code, or country or state by equality; longer: a case-blind
    substring of any place column."""
    place = place.strip()
    if len(place) <= 3:
        up = place.upper()
        return (F.col("countryCode") == up) | (F.upper("level0Name") == up) | (F.upper("stateProvince") == up)
    fields = ("level0Name", "countryCode", "stateProvince", "level1Name", "locality", "verbatimLocality", "continent")
    return reduce(or_, [F.coalesce(F.lower(f).contains(place.lower()), F.lit(False)) for f in fields])


def trait_filter(**affinities: str) -> Column:
    """All of the given equalities; none given matches nothing."""
    return reduce(and_, [F.col(k) == v for k, v in affinities.items()]) if affinities else F.lit(False)


def not_blank(c: Column) -> Column:
    return F.length(F.trim(c)) > 0


def has_coordinates() -> Column:
    return F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")


def matched_fields(fields: Iterable[str], fallback: str, prefix: str = "hit_") -> Column:
    """Names of the fields whose flag is true, in order; the fallback alone if none is."""
    found = F.array_compact(F.array(*[F.when(F.col(f"`{prefix}{f}`"), F.lit(f)) for f in fields]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(fallback)))


def fields_containing(fields: Iterable[str], query: str) -> Column:
    q = query.replace("_", " ").lower()
    return F.array_compact(F.array(*[F.when(F.lower(spaced(f)).contains(q), F.lit(f)) for f in fields]))


def token_matched_fields(fields: Iterable[str], query: str) -> Column:
    """Fields that hold any white-space token of the query, case-blind."""
    tokens = query.lower().split()
    hit = lambda f: reduce(or_, [F.lower(F.col(f"`{f}`")).contains(t) for t in tokens], F.lit(False))
    return F.array_compact(F.array(*[F.when(hit(f), F.lit(f)) for f in fields]))


def relevance(species: Column, matched: Column, query: str) -> Column:
    """From 1 for the whole name down to 0.7 for a match elsewhere."""
    name, q = F.lower(F.translate(species, "_", " ")), query.strip().lower()
    ranks = F.array(*map(F.lit, RANK_FIELDS))
    return (
        F.when(name == q, 1.0)
        .when(name.startswith(q.replace("_", " ")), 0.95)
        .when(F.array_contains(matched, "species"), 0.9)
        .when(F.array_contains(matched, "common_name"), 0.85)
        .when(F.arrays_overlap(matched, ranks), 0.8)
        .otherwise(0.7)
    )


def match_percent(value: Column, distance: bool = False) -> Column:
    """Whole percent from 0 to 100 of a score, or of a distance turned round."""
    share = F.greatest(F.lit(0.0), 1 - value) if distance else value
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(100 * share).cast("int")))


def month_presence(months: Iterable[str]) -> Column:
    """Map of month to whether its column says "present"."""
    months = list(months)
    return F.map_from_arrays(F.array(*map(F.lit, months)), F.array(*[F.coalesce(F.lower(F.col(m)) == "present", F.lit(False)) for m in months]))


def all_absent(months: Column) -> Column:
    return F.forall(F.map_values(months), lambda x: ~x)


def code_label(c: Column, labels: dict[str, str], default: str | None = None) -> Column:
    """A code's label; for others the default, else the label of "na", else "Unknown"."""
    default = default or labels.get("na", "Unknown")
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    upper = next(iter(labels)).isupper()
    key = F.upper(F.trim(c)) if upper else F.lower(F.trim(c))
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def family_list(c: Column) -> Column:
    """Comma-parted names, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def sentence_case(c: Column) -> Column:
    low = F.lower(c)
    return F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 2**31 - 1))


def title_case(c: Column) -> Column:
    """Each word parted by spaces starts with a capital, the rest in lower case."""
    return F.initcap(c)


def author_case(c: Column) -> Column:
    """Each word and each part between hyphens starts with a capital."""
    return F.array_join(F.transform(F.split(c, "-"), F.initcap), "-")


#: Named references.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "))


def decode_entities(c: Column) -> Column:
    """Named references of the usual six, and numeric ones; the ampersand's own comes last."""
    for name, plain in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(plain))
    point = lambda x: F.when(F.lower(F.substring(x, 3, 1)) == "x", F.conv(F.substring(x, 4, 9), 16, 10)).otherwise(F.substring(x, 3, 9)).try_cast("int")
    # chr() folds at 256, so the code point is written out as UTF-8
    parts = F.split(c, r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", -1)
    refs = F.regexp_extract_all(c, F.lit(r"(&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6}));"), F.lit(1))
    decoded = F.transform(refs, lambda x: code_point(point(x)))
    joined = F.array_join(F.flatten(F.zip_with(parts, decoded, lambda p, d: F.array(p, F.coalesce(d, F.lit(""))))), "")
    return F.replace(F.when(F.size(refs) > 0, joined).otherwise(c), F.lit("&amp;"), F.lit("&"))


def code_point(n: Column) -> Column:
    """The character of a code point, by way of its four UTF-32 bytes."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def doi_url(c: Column) -> Column:
    return F.when(c.rlike("(?i)^https?://"), c).otherwise(F.concat(F.lit("https://doi.org/"), c))


def gene_type_label(c: Column) -> Column:
    """Mixed case is kept; else hyphens and underscores part words in title case."""
    mixed = c.rlike("[a-z]") & c.rlike("[A-Z]")
    return F.when(mixed, c).otherwise(F.initcap(F.translate(c, "-_", "  ")))


def gene_category(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.contains("protein"), "protein").when(low.contains("rna"), "rna").when(low.contains("pseudo"), "pseudo").otherwise("other")


def highlight(c: Column, query: str, matched: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The query's literal matches, case-blind, wrapped; only where ``matched``."""
    if not query.strip():
        return c
    quoted = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", query.strip())
    marked = F.regexp_replace(c, F.lit(f"(?i)({quoted})"), F.lit(f"{before}$1{after}"))
    return F.when(matched, marked).otherwise(c)


def rounded_score(c: Column) -> Column:
    return F.round(c, 4)


def non_null_summary(columns: Iterable[str]) -> Column:
    """"name: value" lines of the columns that aren't null."""
    return F.concat_ws("\n", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns])
