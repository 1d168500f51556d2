"""Survey answers: recoding, backfill, privacy-safe keys, rules, classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from soundfield import config as C


def recode(value: Column, mapping: dict[str, str]) -> Column:
    """Replace known values, keep the others."""
    pairs = [F.lit(v) for item in mapping.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)


def normalise_name(value: Column) -> Column:
    return F.lower(F.trim(value))


def dedup_key(contributor: Column, collector: Column) -> Column:
    """Contributor where there is one, else the collector."""
    trimmed = F.trim(contributor)
    return F.coalesce(F.when(trimmed != "", trimmed), collector)


def is_construction(sound_class: Column) -> Column:
    return F.coalesce(sound_class.rlike("(?i)construction"), F.lit(False))


def construction_backfill(declared: Column, sound_class: Column) -> Column:
    return F.coalesce(declared, F.when(is_construction(sound_class), "yes").otherwise("no"))


def offset_for(collector: Column, offsets: dict[str, float]) -> Column:
    if not offsets:
        return F.lit(0.0)
    pairs = [F.lit(v) for item in offsets.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), collector), F.lit(0.0))


def is_roadside(distance_band: Column) -> Column:
    """Unanchored match on the band text, as published."""
    return F.coalesce(distance_band.rlike(C.ROADSIDE_PATTERN), F.lit(False))


def strata(hour: Column, distance_band: Column, site: Column, major_sites=C.MAJOR_SITES) -> Column:
    """Names of every stratum a row belongs to; strata overlap."""
    day = (hour >= 6) & (hour < 21)
    road = is_roadside(distance_band)
    return F.array_compact(F.array(
        F.lit("all"),
        F.when(day & road, "roadside_day"),
        F.when(day & road & site.isin(*major_sites), "roadside_day_major"),
        F.when(~day, "night_all"),
    ))


def road_class(highway: Column) -> Column:
    """major or minor, from the first tag of a list of highway tags."""
    first = F.try_element_at(highway, F.lit(1))
    return F.when(first.isin(*C.MAJOR_HIGHWAYS), "major").otherwise("minor")


@dataclass(frozen=True)
class Rule:
    """What an answer must satisfy. `kind`: text, integer, decimal or choice."""

    field: str
    kind: str = "text"
    required: bool = False
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()


def violations(rules: list[Rule]) -> Column:
    """Array of `field:problem` for one row of text answers.

    A blank answer only breaks a `required` rule. A decimal comma counts as a point.
    """
    found = []
    for rule in rules:
        text = F.trim(F.col(rule.field).cast("string"))
        blank = text.isNull() | (text == "")
        if rule.required:
            found.append(F.when(blank, f"{rule.field}:required"))
        if rule.kind in ("integer", "decimal"):
            number = F.replace(text, F.lit(","), F.lit(".")).try_cast("double")
            bad = number.isNull()
            if rule.kind == "integer":
                bad = text.try_cast("bigint").isNull()
            outside = F.lit(False)
            if rule.low is not None:
                outside = outside | (number < rule.low)
            if rule.high is not None:
                outside = outside | (number > rule.high)
            found.append(F.when(~blank, F.when(bad, f"{rule.field}:type").when(outside, f"{rule.field}:range")))
        elif rule.kind == "choice":
            found.append(F.when(~blank & ~text.isin(*rule.choices), f"{rule.field}:choice"))
    return F.array_compact(F.array(*found))


# fixed value: names that mark a new urban development
DEVELOPMENT_PATTERN = (
    "khu đô thị|khu do thi|vinhomes|ocean park|ecopark|gamuda|ciputra|splendora|smart city|"
    "times? city|royal city|new city|garden city|starlake|an khánh|thanh hà"
)


def is_development(name: Column) -> Column:
    return F.coalesce(name.rlike("(?iu)" + DEVELOPMENT_PATTERN), F.lit(False))


def unit_kind(name: Column, ward_prefix: str = "Phường") -> Column:
    """Kind of an administrative unit from the prefix of its name."""
    return F.when(name.startswith(ward_prefix), "phuong").otherwise("xa")
