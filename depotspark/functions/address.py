"""Taiwanese addresses: prefix repair, splitting, road and village tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from depotspark import reference_values as R
from depotspark.functions.text import strip

CITY = "^(" + "|".join(R.CITIES) + ")"
_COUNTY_OF = dict(R.TOWNSHIPS)
_DISTRICT_OF = {town: city + district for town, city, district in R.OLD_TOWNSHIPS}


def _any_of(names) -> str:
    return "^(" + "|".join(sorted(names, key=len, reverse=True)) + ")"


TOWNSHIP, OLD_TOWNSHIP = _any_of(_COUNTY_OF), _any_of(_DISTRICT_OF)


def _map(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])


def let(value: Column, body) -> Column:
    """Evaluates value once and hands it to body as a variable, so that long chains of steps stay short expressions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _prefix(a: Column, names) -> Column:
    return F.regexp_extract(a, "^(" + "|".join(names) + ")", 1)


def _from(a: Column, prefix: Column) -> Column:
    return a.substr(F.length(prefix) + 1, F.length(a))


def _replace_prefix(a: Column, pattern: str, names: dict[str, str], keep: bool = False) -> Column:
    """A known prefix becomes its full name (keep: stands behind it), unless a current city is there already."""
    def of(p: Column) -> Column:
        return F.when((p == "") | a.rlike(CITY), a).otherwise(F.concat(F.element_at(_map(names), p), a if keep else _from(a, p)))

    return let(F.regexp_extract(a, pattern, 1), of)


def starts_like_address(a: Column) -> Column:
    prefixes = "^(" + "|".join([*R.OLD_COUNTIES, *R.CITY_ABBREVIATIONS, *R.OLD_COUNTY_ABBREVIATIONS]) + ")"
    return a.rlike(CITY) | a.rlike(prefixes) | a.rlike(TOWNSHIP) | a.rlike(OLD_TOWNSHIP)


def strip_postal(a: Column) -> Column:
    return let(F.regexp_replace(a, R.POSTAL, ""), lambda rest: F.when(starts_like_address(rest), rest).otherwise(a))


def old_county(a: Column) -> Column:
    """Old county and its township become municipality and district."""
    def of(county: Column) -> Column:
        def town_of(rest: Column) -> Column:
            def new(town: Column) -> Column:
                district = F.coalesce(F.try_element_at(_map(R.RENAMED_TOWNSHIPS), town), F.concat(town.substr(F.lit(1), F.length(town) - 1), F.lit("區")))
                return F.concat(F.element_at(_map(R.OLD_COUNTIES), county), F.when(town == "", rest).otherwise(F.concat(district, _from(rest, town))))

            return let(F.regexp_extract(rest, R.OLD_TOWN, 0), new)

        return F.when(county == "", a).otherwise(let(_from(a, county), town_of))

    return let(_prefix(a, R.OLD_COUNTIES), of)


def normalize(addr: Column) -> Column:
    """Postal code, abbreviated city, abbreviated and full old county, old township, unique township: in this order."""
    steps = [
        strip_postal,
        lambda a: _replace_prefix(a, "^(" + "|".join(R.CITY_ABBREVIATIONS) + ")", R.CITY_ABBREVIATIONS),
        lambda a: _replace_prefix(a, "^(" + "|".join(R.OLD_COUNTY_ABBREVIATIONS) + ")", R.OLD_COUNTY_ABBREVIATIONS),
        old_county,
        lambda a: _replace_prefix(a, OLD_TOWNSHIP, _DISTRICT_OF),
        lambda a: _replace_prefix(a, TOWNSHIP, _COUNTY_OF, keep=True),
    ]
    for step in steps:
        addr = let(addr, step)
    return addr


def city(a: Column) -> Column:
    return F.nullif(F.regexp_extract(a, CITY, 1), F.lit(""))


def after_city(a: Column) -> Column:
    return F.regexp_replace(a, CITY, "")


def district(a: Column) -> Column:
    """Known special names first: the general pattern would stop inside them."""
    pattern = "^(" + "|".join(R.SPECIAL_DISTRICTS) + "|" + R.DISTRICT + ")"
    return F.nullif(F.regexp_extract(after_city(a), pattern, 1), F.lit(""))


def rest(a: Column) -> Column:
    """What follows city and district; empty for null."""
    return let(F.coalesce(a, F.lit("")), lambda x: let(F.coalesce(district(x), F.lit("")), lambda d: _from(after_city(x), d)))


def canonical(c: Column) -> Column:
    return F.translate(c, "臺", "台")


def village(r: Column) -> Column:
    return canonical(F.nullif(F.regexp_extract(strip(r), R.VILLAGE, 1), F.lit("")))


def road(r: Column) -> Column:
    """Last road token behind a leading village, without its section."""
    found = F.regexp_extract_all(F.regexp_replace(strip(r), R.VILLAGE, ""), F.lit(R.ROAD), F.lit(1))
    return canonical(F.nullif(F.regexp_replace(F.get(F.reverse(found), F.lit(0)), R.SECTION, ""), F.lit("")))


def split_region(region: Column) -> tuple[Column, Column]:
    """(city, district) of a region; blank: both 未知; no known city: (region, 未知)."""
    blank = region.isNull() | (strip(region) == "")
    c = city(region)
    d = F.when(after_city(region) == "", F.lit("未知")).otherwise(after_city(region))
    unknown = F.lit("未知")
    return F.when(blank, unknown).otherwise(F.coalesce(c, region)), F.when(blank | c.isNull(), unknown).otherwise(d)
