"""Affiliations: segments, countries, institutions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.rules import COUNTRY_WORDS, DEPARTMENT_STARTS, GENERIC_NAMES, INSTITUTION_WORDS

UNKNOWN = "Unknown"
EMAIL = r"\b[\w.+-]+@[\w.-]+\.\w+\.?"
# Rewrites before a country is looked for, in order.
COUNTRY_REWRITES = [
    (r"(?iU)people'?s\s+republic\s+of\s+china|p\.\s?r\.\s?china", "China"),
    (r"(?iU)republic\s+of\s+china", "Taiwan"),
    (r"(?iU)new\s+south\s+wales", "NSW, Australia"),
    (r"(?iU)new\s+england", "NewEngland"),
    (r"(?U)(?<![\w.])UK(?![\w.])(?!\s*[.;,]?\s*$)", "U-K"),
]


def segments(affil: Column) -> Column:
    """An affiliation's institutions: e-mail addresses and the last point go, semicolons part."""
    clean = F.trim(F.rtrim(F.trim(F.regexp_replace(F.coalesce(affil, F.lit("")), EMAIL, "")), F.lit(".")))
    return F.filter(F.transform(F.split(clean, ";"), lambda p: F.trim(p)), lambda s: s != "")


def attributed_segments(affil: Column, surname: Column) -> Column:
    """``segments``, but of blocks marked "(Surname, Surname)" only those that name ``surname``, else the first."""
    clean = F.trim(F.rtrim(F.trim(F.regexp_replace(F.coalesce(affil, F.lit("")), EMAIL, "")), F.lit(".")))
    marked = F.rlike(clean, F.lit(r"\([A-Z][a-zA-Z'\-]+(?:,\s*[A-Z][a-zA-Z'\-]+)*\)"))
    blocks = F.transform(F.split(clean, r";\s*|,\s+and\s+(?=[A-Z][^,;]*\()"), lambda p: F.trim(p))
    quoted = F.concat(F.lit(r"(?U)\b\Q"), surname, F.lit(r"\E\b"))
    own = F.filter(blocks, lambda b: F.contains(b, F.lit("(")) & F.rlike(b, quoted))
    mine = F.when((F.coalesce(surname, F.lit("")) != "") & (F.size(own) > 0), own).otherwise(F.slice(blocks, 1, 1))
    return F.when(marked, mine).otherwise(segments(affil))


def cleaned(segment: Column) -> Column:
    for pattern, put in COUNTRY_REWRITES:
        segment = F.regexp_replace(segment, pattern, put)
    return segment


class Gazetteer:
    """Country names and hints (cities, institutions), each with the spellings that stand for it.

    Rows are (iso2, display name, names, hints), lists joined by "; ".  The table has one row a country.
    """

    def __init__(self, rows: list[tuple[str, str, str | None, str | None]]):
        if len(rows) > 1000:
            raise ValueError("one row a country is expected")
        split = lambda t: [x.strip() for x in (t or "").split(";") if x.strip()]
        self.iso = {r[0].upper(): r[1] for r in rows if r[0]}
        self.names = {v.lower(): r[1] for r in reversed(rows) for v in [r[1], *split(r[2])]}
        self.hints = {v.lower(): r[1] for r in reversed(rows) for v in split(r[3])}
        listed = {v.lower(): r[1] for r in reversed(rows) for v in split(r[2])}
        self.passes = (("affil_country_name", listed or self.names), ("affil_city_hint", self.hints))

    @staticmethod
    def last(segment: Column, spellings: dict[str, str]) -> Column:
        """The country whose spelling starts last in the segment; null if none occurs."""
        if not spellings:
            return F.lit(None).cast("string")
        longest = sorted(spellings, key=lambda v: (-len(v), v))
        any_ = "|".join(re.escape(v).replace(r"\ ", " ") for v in longest)
        found = F.lower(F.regexp_extract(cleaned(segment), rf"(?iUs)^.*(?<!\w)({any_})(?!\w)", 1))
        table = F.create_map(*[F.lit(x) for pair in spellings.items() for x in pair])
        return F.element_at(table, F.nullif(found, F.lit("")))

    def resolve(self, affils: Column) -> Column:
        """struct(country, source) of an author: names in any segment go before hints, earlier segments before later."""
        lines = F.flatten(F.transform(F.coalesce(affils, F.array().cast("array<string>")), lambda a: F.filter(F.split(F.regexp_replace(F.coalesce(a, F.lit("")), r"\S+@\S+", " "), r";\s*"), lambda s: F.trim(s) != "")))
        first = lambda table: F.get(F.filter(F.transform(lines, lambda s: self.last(F.trim(s), table)), lambda c: c.isNotNull()), F.lit(0))
        (by_name, names), (by_hint, hints) = self.passes
        name, hint = first(names), first(hints)
        source = F.when(F.size(lines) == 0, "no_affiliation").when(name.isNotNull(), by_name).when(hint.isNotNull(), by_hint).otherwise("affil_unresolved")
        return F.struct(F.coalesce(name, hint, F.lit(UNKNOWN)).alias("country"), source.alias("source"))

    def display(self, code: Column) -> Column:
        """An ISO code or any spelling as the display name; what isn't known stays."""
        iso = F.create_map(*[F.lit(x) for pair in self.iso.items() for x in pair])
        names = F.create_map(*[F.lit(x) for pair in self.names.items() for x in pair])
        return F.coalesce(F.element_at(iso, F.upper(code)), F.element_at(names, F.lower(code)), code)


def enrich_countries(records: DataFrame, gazetteer: Gazetteer) -> DataFrame:
    """Country and source for every author and, from the first author alone, for the record; all countries sorted."""

    def placed(a: Column) -> Column:
        got = gazetteer.resolve(a["affils"])
        copied = (a["affil_source"] == "propagated") & (got["country"] != UNKNOWN)
        return a.withField("country", got["country"]).withField("country_source", F.when(copied, F.concat(got["source"], F.lit("_propagated"))).otherwise(got["source"]))

    out = records.withColumn("authors", F.transform("authors", placed))
    none = F.coalesce(F.size("authors"), F.lit(0)) <= 0
    known = F.filter(F.transform("authors", lambda a: a["country"]), lambda c: c.isNotNull() & (c != "") & (c != UNKNOWN))
    return out.withColumns({
        "country": F.when(none, UNKNOWN).otherwise(F.get("authors", F.lit(0))["country"]),
        "country_source": F.when(none, "no_authors").otherwise(F.get("authors", F.lit(0))["country_source"]),
        "countries_all": F.when(none, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(known))),
    })


def fallback_institution(segment: Column) -> Column:
    """The best-scoring part between commas: departments lose 2, institutions gain 2, length gains up to 1."""
    parts = F.filter(F.transform(F.split(segment, ","), lambda p: F.trim(p)), lambda p: p != "")
    lower = lambda p: F.lower(p)
    bare = lambda p: F.btrim(F.lower(p), F.lit("."))
    out = lambda p: (F.length(p) < 5) | bare(p).isin(COUNTRY_WORDS) | F.rlike(bare(p), F.lit(r"^[0-9\s\-]+$")) | F.contains(p, F.lit("@"))
    starts = "^(" + "|".join(map(re.escape, DEPARTMENT_STARTS)) + ")"
    has = "(" + "|".join(map(re.escape, INSTITUTION_WORDS)) + ")"

    def scored(p: Column, i: Column) -> Column:
        score = F.when(F.rlike(lower(p), F.lit(starts)), -2.0).otherwise(0.0) + F.when(F.rlike(lower(p), F.lit(has)), 2.0).otherwise(0.0) + F.least(F.length(p) / 40, F.lit(1.0))
        return F.struct(score.alias("score"), (-i).alias("ix"), p.alias("name"))

    best = F.array_max(F.transform(F.filter(parts, lambda p: ~out(p)), scored))
    generic = F.rtrim(F.btrim(F.lower(best["name"]), F.lit(".")), F.lit(",")).isin(GENERIC_NAMES)
    return F.when((best["score"] > -1) & ~generic, F.trim(F.rtrim(best["name"], F.lit("."))))


def external_country(insts: Column, countries: Column, affiliation: Column, generic: list[str]) -> Column:
    """The country of an author for whom an external source gives several.

    A single one is it; else that of the institution named earliest in what the author wrote (all its
    telling words must occur); else the commonest of the institutions', first met; else the first.
    """
    text = F.lower(F.coalesce(affiliation, F.lit("")))
    words = lambda x: F.filter(F.regexp_extract_all(F.lower(x["name"]), F.lit("([a-z]{4,})"), 1), lambda t: ~t.isin(generic))
    usable = F.filter(insts, lambda x: x["name"].isNotNull() & x["cc"].isNotNull() & (F.size(words(x)) > 0) & F.forall(words(x), lambda t: F.contains(text, t)))
    placed = F.transform(usable, lambda x, i: F.struct(F.array_min(F.transform(words(x), lambda t: F.instr(text, t))).alias("at"), i.alias("i"), x["cc"].alias("cc")))
    named = F.array_min(placed)["cc"]
    codes = F.filter(F.transform(insts, lambda x: x["cc"]), lambda c: c.isNotNull())
    modal = F.array_max(F.transform(codes, lambda c, i: F.struct(F.size(F.filter(codes, lambda d: d == c)).alias("n"), (-i).alias("i"), c.alias("cc"))))["cc"]
    single = F.size(F.array_distinct(countries)) <= 1
    return F.when(single, F.get(countries, F.lit(0))).otherwise(F.coalesce(named, modal, F.get(countries, F.lit(0))))


def text_overrides(country: Column, source: Column, external: Column) -> Column:
    """The affiliation names a country outright that differs from the external one (but not within Greater China)."""
    china = ["China", "Hong Kong", "Taiwan", "Macau", "Macao"]
    outright = source.isin("affil_country_name", "affil_country_name_propagated")
    return F.coalesce((country != UNKNOWN) & (country != "") & outright & (country != F.coalesce(external, F.lit(""))) & ~(country.isin(china) & F.coalesce(external, F.lit("")).isin(china)), F.lit(False))


def prefer_external(records: DataFrame, gazetteer: Gazetteer, generic: list[str]) -> DataFrame:
    """Authors' countries from an external source where it has one, but where the affiliation names another outright.

    The record's country is its first author's; ``country_source`` says which source it is.
    """

    def chosen(a: Column) -> Column:
        text = F.array_join(F.coalesce(a["affils"], F.array().cast("array<string>")), "; ")
        code = external_country(F.coalesce(a["oa_insts"], F.array().cast("array<struct<ror: string, name: string, cc: string>>")), F.coalesce(a["oa_countries"], F.array().cast("array<string>")), text, generic)
        name = gazetteer.display(code)
        use = code.isNotNull() & ~text_overrides(a["country"], a["country_source"], name)
        placed = a.withField("oa_country_name", name)
        return F.when(use, placed.withField("country", name).withField("country_source", F.lit("external"))).otherwise(placed)

    out = records.withColumn("authors", F.transform("authors", lambda a: chosen(a).dropFields("oa_insts")))
    first = F.get("authors", F.lit(0))
    known = F.filter(F.transform("authors", lambda a: a["country"]), lambda c: c.isNotNull() & (c != "") & (c != UNKNOWN))
    return out.withColumns({
        "country": F.coalesce(first["country"], F.col("country")),
        "country_source": F.coalesce(first["country_source"], F.col("country_source")),
        "countries_all": F.coalesce(F.array_sort(F.array_distinct(known)), F.array().cast("array<string>")),
    })
