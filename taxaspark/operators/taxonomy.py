"""Traits and taxonomy: decoding raw trait tables, matching ranks, species profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark.functions import exprs, keys

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
RANKS = ("kingdom", "phylum", "class", "order", "family", "genus", "species")
TAXON_TEXT = (*RANKS, "authorship", "vernacularName")
#: Fixed value: what a profile text ends with.
CLOSING = "Please provide a brief overview of the species based on the above information."
AFFINITIES = ("CanopyAffinity", "EdgeAffinity", "MoistureAffinity", "DisturbanceAffinity")


def cleaned(c: Column) -> Column:
    """Null for "NA", "null" and the empty text, as they are written here."""
    text = c.cast("string")
    return F.when(text.isin("NA", "null", ""), None).otherwise(text)


def decoded_int(c: Column) -> Column:
    """Whole number of digits only; null otherwise."""
    text = cleaned(c)
    return F.when(text.rlike(r"^[-+]?[0-9]+$"), text.try_cast("int"))


def presence(c: Column) -> Column:
    """0 Absent, 1 Present, other numbers Unknown, none null."""
    n = decoded_int(c)
    return F.when(n.isNull(), None).when(n == 0, "Absent").when(n == 1, "Present").otherwise("Unknown")


def decode_traits(df: DataFrame, doubles: list[str] = (), ints: list[str] = (), months: list[str] = MONTHS, rename: dict[str, str] | None = None) -> DataFrame:
    """Typed traits: the named columns as double, int or presence, all others as cleaned text."""
    rename = rename or {}

    def of(name: str) -> Column:
        c = F.col(f"`{name}`")
        made = cleaned(c).try_cast("double") if name in doubles else decoded_int(c) if name in ints else presence(c) if name in months else cleaned(c)
        return made.alias(rename.get(name, name))

    return df.select(*[of(c) for c in df.columns])


def with_trait_labels(df: DataFrame) -> DataFrame:
    """Adds readable labels of the code columns, flight months as a map and host families as a list."""
    made = {f"{c}Label": exprs.code_label(F.col(c), labels) for c, labels in (("Voltinism", exprs.VOLTINISM), ("DiapauseStage", exprs.DIAPAUSE), ("OvipositionStyle", exprs.OVIPOSITION)) if c in df.columns}
    if all(m in df.columns for m in MONTHS):
        made["flightMonths"] = exprs.month_presence(MONTHS)
        made["neverFlies"] = exprs.all_absent(exprs.month_presence(MONTHS))
    if "PrimaryHostPlantFamily" in df.columns:
        made["hostFamilies"] = exprs.family_list(F.col("PrimaryHostPlantFamily"))
    return df.withColumns(made)


def traits_of(df: DataFrame, name: str, column: str = "species") -> DataFrame:
    """First row of a species, as stored; :func:`decode_traits` types it."""
    return df.filter(keys.lower_key(column) == name.lower()).orderBy(*df.columns).limit(1)


def taxonomy_record(df: DataFrame) -> DataFrame:
    """Defaults of missing fields: empty text, status "Accepted" (first letter upper), red list
    "Unknown"."""
    status = F.coalesce(exprs.sentence_case(F.col("taxonomicStatus")), F.lit("Accepted"))
    return df.select("key", *[F.coalesce(c, F.lit("")).alias(c) for c in TAXON_TEXT], F.coalesce("redlistCategory", F.lit("Unknown")).alias("redlistCategory"), status.alias("taxonomicStatus"))


def classify(taxonomy: DataFrame, name: str, rank: str | None = None) -> DataFrame:
    """Records that have ``name`` at a rank, with the rank: (matchedCategory, key, ...).

    Of several ranks that match the finest counts; ``rank`` restricts it to one.
    """
    wanted = name.replace("_", " ").strip().lower()
    chosen = [rank] if rank else list(reversed(RANKS))
    hit = F.coalesce(*[F.when(F.lower(F.translate(r, "_", " ")) == wanted, F.lit(r)) for r in chosen])
    return taxonomy.withColumn("matchedCategory", hit).filter("matchedCategory is not null").select("matchedCategory", *taxonomy.columns)


def species_profile(taxonomy: DataFrame, traits: DataFrame, red_list: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """Taxonomy with optional traits and red-list category (by key, else "Unknown").

    Species without taxonomy give no row. Without ``name``: all species.
    """
    rows = taxonomy if name is None else taxonomy.filter(keys.lower_key("species") == name.replace("_", " ").strip().lower())
    if red_list is not None:
        own = red_list.groupBy("key").agg(F.min("category").alias("_category"))
        rows = rows.drop("redlistCategory").join(own, "key", "left").withColumn("redlistCategory", F.coalesce("_category", F.lit("Unknown"))).drop("_category")
    other = traits.select(keys.lower_key("species").alias("_key"), *[c for c in traits.columns if c != "species" and c not in rows.columns])
    return rows.join(other, keys.lower_key(rows["species"]) == F.col("_key"), "left").drop("_key")


def profile_text(taxonomy: list[str], traits: list[str]) -> Column:
    """Bullet lines of the fields that aren't null or empty, under two headings, and a closing line. A
    side without such a field has no heading either."""

    def part(heading: str, columns: list[str]) -> Column:
        lines = [F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"- {c.capitalize()}: "), F.col(c).cast("string"))) for c in columns]
        text = F.concat_ws("\n", *lines)
        return F.when(text != "", F.concat(F.lit(f"{heading}\n"), text))

    return F.concat_ws("\n\n", part("Taxonomy Information:", taxonomy), part("Traits Information:", traits), F.lit(CLOSING))
