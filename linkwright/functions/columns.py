"""Normalisers and identifiers as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkwright.functions.constants import COUNTRIES, SKILLS


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def name(c: Column) -> Column:
    """White space collapsed and trimmed, case kept; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def email(c: Column) -> Column:
    return F.lower(F.trim(c))


def title_case(c: Column) -> Column:
    """Each run of letters capitalised, as Python's str.title() does."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2), F.length(w))))), "")


def skill(c: Column) -> Column:
    """The canonical name of a known spelling, else title case; blank is null."""
    key = F.lower(F.trim(c))
    return F.when(key == "", None).otherwise(F.coalesce(literal_map(SKILLS)[key], title_case(key)))


def phone(c: Column, region: str = "IN") -> Column:
    """E.164, or null: Indian mobile and US/Canadian numbers, and others by their length.

    Of numbers without a country code only those of the default region are read.
    """
    plain = F.regexp_replace(c, r"[\s().-]", "")
    bare = F.regexp_replace(plain, "^0", "")
    india, north_america, other = r"^\+91[6-9][0-9]{9}$", r"^\+1[2-9][0-9]{2}[2-9][0-9]{6}$", r"^\+(?!91|1)[1-9][0-9]{7,14}$"
    # exchange 555 is unassigned in most area codes' plans when the area code is 555 as well
    home = {"IN": F.when(bare.rlike(r"^[6-9][0-9]{9}$"), F.concat(F.lit("+91"), bare)), "US": F.when(plain.rlike(r"^1?[2-9][0-9]{2}[2-9][0-9]{6}$"), F.concat(F.lit("+1"), F.right(plain, F.lit(10))))}[region]
    good = plain.rlike(india) | plain.rlike(other) | plain.rlike(north_america) & ~plain.rlike(r"^\+1555")
    return F.when(plain.startswith("+"), F.when(good, plain)).otherwise(home)


def iso_countries(spark) -> dict[str, str]:
    """Lower-cased names, alpha-2 and alpha-3 codes of the JVM's countries, with the aliases on top."""
    locale = spark._jvm.java.util.Locale
    found: dict[str, str] = {}
    for code in locale.getISOCountries():
        it = locale("", code)
        found |= {it.getDisplayCountry(locale.ENGLISH).lower(): code, it.getISO3Country().lower(): code, code.lower(): code}
    return found | COUNTRIES


def country(c: Column, known: dict[str, str]) -> Column:
    return literal_map(known)[F.lower(F.trim(c))]


def location(c: Column, known: dict[str, str]) -> Column:
    """city, region and country of comma-separated text."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda p: p != "")
    n = F.size(parts)
    last = country(F.get(parts, n - 1), known)
    region = F.when((n == 2) & last.isNull(), F.get(parts, F.lit(1))).when(n > 2, F.array_join(F.slice(parts, F.lit(2), F.when(last.isNull(), n - 1).otherwise(n - 2)), ", "))
    return F.struct(F.get(parts, F.lit(0)).alias("city"), region.alias("region"), F.when(n > 1, last).alias("country"))


def year_month(c: Column) -> Column:
    """YYYY-MM of the usual spellings; a year alone is its January."""
    t = F.trim(c)
    formats = ["MMM yyyy", "MMMM yyyy", "yyyy-MM", "MM/yyyy", "yyyy-MM-dd", "yyyy"]
    return F.coalesce(*[F.date_format(F.try_to_timestamp(t, F.lit(f)), "yyyy-MM") for f in formats])


def username(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def uuid5_oid(key: Column) -> Column:
    """Version-5 UUID of the key in the OID name space."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8129dad11d180b400c04fd430c8")), F.encode(key, "UTF-8")))
    variant = F.substr(F.lit("89ab"), F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4 + 1, F.lit(1))
    cut = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("5"), cut(14, 3)), F.concat(variant, cut(18, 3)), cut(21, 12))


def two_digits(c: Column) -> Column:
    """Text with two decimals, rounded as the double is, not as its shortest spelling: 0.725 is below the middle."""
    return F.format_number(c, 2)


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def noisy_or(confidences: Column) -> Column:
    """1 - prod(1 - c) over an array, in its order."""
    return F.lit(1.0) - F.aggregate(confidences, F.lit(1.0), lambda a, c: a * (1.0 - clamp(c)))
