"""Names, tags and clocks as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and the letters without them.
_MARKED, _PLAIN = "àáâãäåāçèéêëēìíîïīñòóôõöōùúûüūýÿ", "aaaaaaaceeeeeiiiiinoooooouuuuuyy"


def fold(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(text), _MARKED, _PLAIN)


def fold_name(text: Column) -> Column:
    """A name to compare by: folded, saint and mount shortened, other signs as one space."""
    out = F.regexp_replace(F.regexp_replace(fold(text), r"\bsaint\b", "st"), r"\bmount\b", "mt")
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def tags(text: Column) -> Column:
    """A map of "key"=>"value" text; escapes are kept, the first of repeated keys wins."""
    keys = F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]|\\.)*)"\s*=>'), 1)
    values = F.regexp_extract_all(text, F.lit(r'=>\s*"((?:[^"\\]|\\.)*)"'), 1)
    both = F.struct(keys.alias("keys"), F.arrays_zip(keys.alias("key"), values.alias("value")).alias("pairs"))
    # bound once: inside the filter the keys would be extracted again for each pair
    first = F.transform(F.array(both), lambda b: F.filter(b["pairs"], lambda x, i: F.array_position(b["keys"], x["key"]) == i + 1))
    return F.map_from_entries(F.get(first, F.lit(0)))


def match_service(tag_map: Column, rules: list[tuple[str, dict[str, list[str]]]], excludes: dict[str, dict[str, list[str]]], unless: dict[str, tuple[str, str, str]] | None = None) -> Column:
    """The first service of which any tag rule holds and no exclusion does; null if none.

    ``unless`` (service: key, value, other): key=value is no match for the service where the
    tag ``other`` says something that is not in the service's rule for it, as a clinic of
    another kind of healthcare is no general practice.
    """
    # as an element of an array the map is made once, not in each place that asks for a tag
    return F.get(F.transform(F.array(tag_map), lambda tags: _first_service(tags, rules, excludes, unless)), F.lit(0))


def _first_service(tag_map: Column, rules: list[tuple[str, dict[str, list[str]]]], excludes: dict[str, dict[str, list[str]]], unless: dict[str, tuple[str, str, str]] | None) -> Column:
    has = lambda key, values: F.coalesce(F.try_element_at(tag_map, F.lit(key)).isin(values), F.lit(False))
    out = F.lit(None).cast("string")
    for service, need in reversed(rules):
        match = F.lit(False)
        for key, values in need.items():
            holds = has(key, values)
            if unless and service in unless and unless[service][0] == key:
                _, value, other = unless[service]
                said = F.try_element_at(tag_map, F.lit(other))
                elsewhere = F.coalesce((said != "") & ~said.isin(need.get(other, [])), F.lit(False))
                holds = holds & ~(has(key, [value]) & elsewhere)
            match = match | holds
        for key, values in excludes.get(service, {}).items():
            match = match & ~has(key, values)
        out = F.when(match, service).otherwise(out)
    return out


def years(name: Column) -> tuple[Column, Column]:
    """First and last year of a range such as "Years 7-13", null without one."""
    p = r"(\d+)\s*(?:-|to)\s*(\d+)"
    at = lambda i: F.nullif(F.regexp_extract(name, p, i), F.lit("")).cast("int")
    return at(1), at(2)


def blank(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def code(text: Column) -> Column:
    """A code without a trailing .0"""
    return F.regexp_replace(text, r"\.0$", "")


def initials(text: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), "")


def number_in(text: Column) -> Column:
    """The least of the last numbers in the parts that "/" divides."""
    parts = F.transform(F.split(text, "/"), lambda p: F.nullif(F.regexp_extract(p, r"(\d+)\D*$", 1), F.lit("")).cast("int"))
    return F.array_min(F.array_compact(parts))


def clock(text: Column) -> Column:
    """A printed time as minutes; hours before 7 are in the afternoon."""
    h = F.regexp_extract(text, r"^(\d+)[:.](\d+)", 1).cast("int")
    m = F.regexp_extract(text, r"^(\d+)[:.](\d+)", 2).cast("int")
    return (h + F.when(h < 7, 12).otherwise(0)) * 60 + m


def breaks_class(value: Column, breaks: list[float]) -> Column:
    """Index of the first break at or above the value, the number of breaks beyond the last."""
    out = F.when(value.isNull(), None)
    for k, b in enumerate(breaks):
        out = out.when(value <= b, k)
    return out.otherwise(len(breaks))


def iso_day(text: Column) -> Column:
    """The first ten characters of a text that begins like 2024-01-31, else null."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(text, 1, 10))


def choice(said: Column, known: list[str], fallback: str) -> tuple[Column, Column]:
    """A choice and the number it names: "one:12" is one of number 12; a text that isn't known is the fallback."""
    number = F.nullif(F.regexp_extract(said, "^one:([0-9]+)$", 1), F.lit("")).cast("long")
    return F.when(number.isNotNull(), "one").when(said.isin(known), said).otherwise(fallback), number
