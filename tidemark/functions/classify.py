"""Classifications by ordered rules and maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severity words and their four levels, with ranks.
SEVERITY = {"low": "low", "warning": "low", "moderate": "medium", "medium": "medium", "elevated": "high", "high": "high", "critical": "critical", "severe": "critical", "extreme": "critical"}
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "unknown": 0}

#: Codes of event families.
ROOT_CATEGORY = {15: "posture", 18: "conflict.assault", 19: "conflict.armed", 20: "conflict.mass_violence"}
TACTICAL_ROOTS = (15, 18, 19, 20)

#: Baseline credibility of source types.
CREDIBILITY = {"rss": 0.60, "telegram": 0.40, "gdelt": 0.50, "dataset": 0.80, "notebooklm": 0.60, "unknown": 0.30}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mapped(value: Column | str, pairs: dict, default) -> Column:
    """Value of a literal map, or a default for keys that it lacks."""
    made = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.try_element_at(made, _col(value)), F.lit(default))


def severity(word: Column | str) -> Column:
    return mapped(F.lower(F.trim(_col(word))), SEVERITY, "unknown")


def severity_rank(word: Column | str) -> Column:
    return mapped(severity(word), SEVERITY_RANK, 0)


def category(dotted: Column | str) -> Column:
    """The first dotted segment; "other" if there is none."""
    first = F.lower(F.trim(F.get(F.split(F.coalesce(_col(dotted), F.lit("")), r"\."), F.lit(0))))
    return F.when(first != "", first).otherwise("other")


def theme_match(themes: Column | str, exact: Sequence[str], prefixes: Sequence[str] = ()) -> Column:
    """Whether an element of a ;-separated list is one of exact, or a prefix with an underscore after it."""
    parts = F.filter(F.split(F.coalesce(_col(themes), F.lit("")), ";"), lambda x: x != "")

    def hit(x: Column) -> Column:
        found = x.isin(*exact) if exact else F.lit(False)
        for prefix in prefixes:
            found = found | (x == prefix) | x.startswith(prefix + "_")
        return found

    return F.exists(parts, hit)


def first_rule(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """The label of the first rule that holds."""
    out = F.lit(default).cast("string")
    for condition, label in reversed(list(rules)):
        out = F.when(condition, label).otherwise(out)
    return out


def region(lat: Column | str, lon: Column | str, boxes: Sequence[tuple[str, float, float, float, float]], default: str = "unknown") -> Column:
    """The first box (name, south, west, north, east) that holds a point."""
    from .geo import in_bbox

    return first_rule([(in_bbox(lat, lon, *box), name) for name, *box in boxes], default)


def in_ranges(number: Column | str, ranges: Sequence[tuple[int, int, str]], default: str | None = None) -> Column:
    """The label of the first range (low, high, label) with the number in it."""
    return first_rule([(_col(number).between(low, high), label) for low, high, label in ranges], default)


def name_prefix(name: Column | str, rules: Sequence[tuple[str, str]], default: str = "other") -> Column:
    """The label of the first prefix that a name begins with and that ends at a word's end."""
    text = F.upper(F.trim(_col(name)))
    return first_rule([(text.rlike(rf"^{prefix}(\b|[0-9-])"), label) for prefix, label in rules], default)


#: Callsign prefixes of military flights.
MILITARY_CALLSIGNS = ("RCH", "EVAC", "DUKE", "VALOR", "REACH", "FORGE", "COBRA", "HAWK", "VIPER", "RAPTOR", "REAPER", "SIGINT", "FORTE", "NCHO", "TOPCAT", "RRR", "IAM", "GAF", "FAF", "CNV", "RFR")


def military_callsign(callsign: Column | str, prefixes: Sequence[str] = MILITARY_CALLSIGNS) -> Column:
    return F.coalesce(F.upper(F.trim(_col(callsign))).rlike("^(?:" + "|".join(prefixes) + ")"), F.lit(False))


def known_code(code: Column | str, codes: Sequence[str], fallback: str = "other.unclassified") -> Column:
    """A code that the codebook has, else the fallback."""
    return F.when(_col(code).isin(*codes), _col(code)).otherwise(fallback)


#: Names by which a country is searched, by its code or, without one, its name.
SEARCH_NAMES = {"ESH": ["Western Sahara", "Sahrawi"], "PSE": ["Palestine", "Palestinian Territories", "Gaza", "West Bank"], "USA": ["United States", "USA", "US"], "N. Cyprus": ["Northern Cyprus", "TRNC"], "Somaliland": ["Somaliland"]}


def search_names(code: Column | str, name: Column | str) -> Column:
    made = F.create_map(*[x for k, v in SEARCH_NAMES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    return F.coalesce(F.try_element_at(made, F.coalesce(_col(code), F.lit(""))), F.try_element_at(made, F.coalesce(_col(name), F.lit(""))), none)


#: White space, as at the ends of texts and between words.
_SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def content_junk(text: Column | str) -> Column:
    """Why a text is junk, by the first rule that holds; null if it isn't. Embedded data URIs count
    against the text's length, and the other rules look at what is left without them."""
    edges = F.lit(_SPACES)
    raw = F.coalesce(_col(text), F.lit(""))
    # each step is worked out once a row, and later ones only for texts that get there
    bare = F.when(F.contains(raw, F.lit(";base64,")), F.regexp_replace(raw, rf"data:[^,{_SPACES}]*;base64,[A-Za-z0-9+/=]+", "")).otherwise(raw)

    def judge(t: Column) -> Column:
        prose, n_raw = F.btrim(t["bare"], edges), F.length(F.btrim(t["raw"], edges))
        n = F.length(prose)
        few = F.size(F.split(prose, f"[{_SPACES}]+", 8)) < 8
        rest = F.when(few, "too_few_words").when((n >= 200) & ~prose.rlike(r"[.!?;:\n]"), "low_prose")
        return F.when(n_raw == 0, "empty").when(F.length(t["raw"]) - F.length(t["bare"]) > 0.25 * n_raw, "base64_heavy").when(n < 40, "too_short").otherwise(rest)

    return F.transform(F.array(F.struct(raw.alias("raw"), bare.alias("bare"))), judge)[0]


def survey_class(text: Column | str, notebook: Column | None = None) -> Column:
    """The corpus survey's class, whose thresholds differ from content_junk's; notebook: whether an
    item comes from a notebook, whose single sentences are prose."""
    raw = F.coalesce(_col(text), F.lit(""))
    n = F.length(F.btrim(raw, F.lit(_SPACES)))
    encoded = F.length(raw) - F.length(F.regexp_replace(raw, r"base64,[A-Za-z0-9+/=]+", ""))
    sentences = F.regexp_count(raw, F.lit("[.!?]"))
    plain = F.lit(True) if notebook is None else ~F.coalesce(notebook, F.lit(False))
    return first_rule([(n < 30, "EMPTY"), (encoded > 0.30 * n, "IMAGE_HEAVY"), (plain & (n >= 200) & (sentences <= 1), "LOW_PROSE")], "ok")


def shifted_level(level: Column | str, mentions: Column | str) -> Column:
    """A level from 1 to 5 moved by the number of mentions: above 30 up two, above 15 up one, below 2 down one."""
    m = _col(mentions)
    step = F.when(m > 30, 2).when(m > 15, 1).when(m < 2, -1).otherwise(0)
    return F.least(F.greatest(_col(level) + step, F.lit(1)), F.lit(5))


def credibility(provider: Column | str, kind: Column | str, overrides: dict[str, float], baselines: dict[str, float] = CREDIBILITY) -> Column:
    """A provider's own value, else its type's; an unknown type is an error."""
    base = F.try_element_at(F.create_map(*[F.lit(x) for p in baselines.items() for x in p]), _col(kind))
    own = F.try_element_at(F.create_map(*[F.lit(x) for p in overrides.items() for x in p]), _col(provider)) if overrides else F.lit(None).cast("double")
    return F.coalesce(own, base, F.raise_error(F.concat(F.lit("unknown source type: "), F.coalesce(_col(kind), F.lit("null")))).cast("double"))


def possible_explosion(frp: Column | str, brightness: Column | str) -> Column:
    return F.coalesce((_col(frp) > 80) & (_col(brightness) > 380), F.lit(False))


#: Legacy entity types and their present names.
ENTITY_TYPES = {"person": "PERSON", "organization": "ORGANIZATION", "location": "LOCATION", "military_unit": "MILITARY_UNIT", "weapon_system": "WEAPON_SYSTEM", "vessel": "VESSEL", "aircraft": "AIRCRAFT", "satellite": "SATELLITE"}


#: The canonical entity types.
CANONICAL_ENTITY_TYPES = ("ORGANIZATION", "COUNTRY", "LOCATION", "PERSON", "REGION", "WEAPON_SYSTEM", "MILITARY_UNIT", "POLICY", "TREATY", "CONCEPT", "VESSEL", "AIRCRAFT", "SATELLITE")


def known_entity_type(kind: Column | str, present: Sequence[str] = CANONICAL_ENTITY_TYPES) -> Column:
    """The canonical name of a legacy or canonical type; null for anything else, so that such rows can be set aside."""
    made = F.create_map(*[F.lit(x) for pair in ENTITY_TYPES.items() for x in pair])
    return F.when(_col(kind).isin(*present), _col(kind)).otherwise(F.try_element_at(made, _col(kind)))


def entity_type(kind: Column | str, present: Sequence[str] = CANONICAL_ENTITY_TYPES) -> Column:
    """As ``known_entity_type``, but an unknown type ends the job; for small curated tables only."""
    unknown = F.raise_error(F.concat(F.lit("unknown entity type: "), F.coalesce(_col(kind), F.lit("null")))).cast("string")
    return F.coalesce(known_entity_type(kind, present), unknown)


def source_tier(name: Column | str, tiers: Sequence[tuple[str, Sequence[str]]], default: str = "tier3") -> Column:
    """The first tier one of whose marks is in the name."""

    def any_of(marks: Sequence[str]) -> Column:
        found = F.lit(False)
        for mark in marks:
            found = found | F.lower(_col(name)).contains(mark)
        return found

    return first_rule([(any_of(marks), tier) for tier, marks in tiers], default)


#: Types that may be written as a source, and the providers of datasets.
WRITE_TYPES = ("rss", "telegram", "gdelt", "notebooklm", "dataset")
DATASET_PROVIDERS = {
    "firms": "firms.modaps.eosdis.nasa.gov", "usgs": "usgs.gov", "ucdp": "ucdp.uu.se", "ofac": "ofac.treasury.gov", "hapi": "hapi.humdata.org", "noaa_nhc": "nhc.noaa.gov", "portwatch": "portwatch.imf.org",
    "eonet": "eonet.gsfc.nasa.gov", "gdacs": "gdacs.org",
}


def provenance(source_type: Column | str, provider: Column | str, published_at: Column | str) -> Column:
    """What is written of a row's source: source_type, provider, published_at (null where it is empty), and fault: why the
    row may not be written (``source_type``, ``provider``), else null. Credibility is for readers and not written."""
    kind, name, at = _col(source_type), _col(provider), _col(published_at)
    fault = F.when(~F.coalesce(kind.isin(*WRITE_TYPES), F.lit(False)), "source_type").when(F.coalesce(name, F.lit("")) == "", "provider")
    return F.struct(kind.alias("source_type"), name.alias("provider"), F.nullif(at, F.lit("")).alias("published_at"), fault.alias("fault"))


def dataset_provider(source: Column | str) -> Column:
    """The provider of a known dataset; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in DATASET_PROVIDERS.items() for x in pair]), _col(source))
