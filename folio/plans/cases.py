"""Inputs and outcomes that queries deal to the rows of whole tables: row k gets case k modulo their number.

The queries run the operators on the inputs; the SQL beside them has the outcomes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from folio.functions.places import Gazetteer
from folio.schemas import RECORD

#: (fields of a record, kept, rule).
SCREENING = [
    ({"title": "LASIK in pilots", "abstract": "flight", "journal": "Aviation Medicine", "has_abstract": True}, True, "keep"),
    ({"title": "Excimer of polymers", "abstract": "", "journal": "Polymer Letters"}, False, "screen.stoplist_journal.polymer"),
    ({"title": "Something", "abstract": "nothing here", "journal": "Cornea"}, False, "content.no_procedure_signal"),
    ({"title": "Excimer outcomes", "abstract": "visual acuity", "journal": "General Letters"}, True, "screen.non_ophth_journal_no_disease_term"),
    ({"title": "Phototherapeutic keratectomy", "abstract": "excimer cornea", "journal": "Cornea"}, False, "content.ptk_only"),
    ({"title": "Erratum", "pub_types": ["Published Erratum"]}, False, "content.notice_not_publication"),
    ({"title": "LASIK", "abstract": "myopia", "journal": "Cornea"}, True, "keep"),
    ({"title": "Wound", "abstract": "", "journal": "Letters", "mesh": ["Rhinoplasty"]}, False, "screen.stoplist_mesh.rhinoplasty"),
]
#: (title, abstract, families joined).
FAMILY_CASES = [
    ("a smile on the face", "", ""),
    ("SMILE outcomes", "", "Lenticule extraction"),
    ("smile", "lenticule", "Lenticule extraction"),
    ("flex cars", "", ""),
    ("PRK and LASIK", "", "LASIK|Surface ablation"),
]
#: Spellings of a few countries, and affiliations with the country and the source of each.
GAZETTEER = Gazetteer([
    ("CH", "Switzerland", "Switzerland; Schweiz; Suisse", "Zurich; Basel"),
    ("GB", "United Kingdom", "United Kingdom; UK; England", "London; Moorfields"),
    ("CN", "China", "China", "Beijing; Wenzhou"),
    ("TW", "Taiwan", "Taiwan", "Taipei"),
    ("AU", "Australia", "Australia", "Sydney"),
    ("KR", "Korea", "Korea; South Korea", "Seoul"),
])
COUNTRY_CASES = [
    ("Univ. Hospital, Zurich, Switzerland", "Switzerland", "affil_country_name"),
    ("Moorfields; Univ, Basel, Switzerland", "Switzerland", "affil_country_name"),
    ("Sydney, New South Wales", "Australia", "affil_country_name"),
    ("Beijing, People's Republic of China", "China", "affil_country_name"),
    ("Taipei, Republic of China", "Taiwan", "affil_country_name"),
    ("LF UK, Seoul", "Korea", "affil_city_hint"),
    ("London, UK", "United Kingdom", "affil_country_name"),
    ("Dept of Eye, x@y.uk", "Unknown", "affil_unresolved"),
    ("", "Unknown", "no_affiliation"),
    ("Fukuoka", "Unknown", "affil_unresolved"),
]
#: (code or name, display name).
DISPLAY_CASES = [("ch", "Switzerland"), ("Schweiz", "Switzerland"), ("Mars", "Mars"), ("GB", "United Kingdom")]
#: (keyword, normal form).
SYNONYMS = [("kxl", "canon")]
KEYWORD_CASES = [("KXL", "canon"), ("Myopia", "myopia"), ("Dry Eyes", "dry eye"), ("uva uva", "uva"), ("Lenses", "lens"), ("queratocono", "keratoconus"), ("naïve terms", "naive term"), ("", None), (" Dry -  eyes. ", "dry-eye")]
#: (last, forename, initials; compared surname, initials, form, first forename, display name).
NAME_CASES = [
    ("Spörl", "Theo Günter", "TG", "spoerl", "tg", "theo günter", "theo", "Spörl TG"),
    ("Spoerl", "D P S", "DP", "spoerl", "dps", ".dps", "", "Spoerl DPS"),
    ("O'Brart", None, "AB", "obrart", "ab", ".ab", "", "O'Brart A"),
    ("Sinha-Roy", "", None, "sinharoy", "", ".", "", "Sinha-Roy"),
    ("Łą", "anna-maria k.", "", "a", "ak", "anna-maria k.", "annamaria", "Łą AK"),
    ("Zhang", "Lei Min", None, "zhang", "lm", "lei min", "lei", "Zhang LM"),
    ("", "x", None, "", "x", ".x", "", "Unknown"),
]
#: (forename, forename, whether they say the same).
FORENAME_CASES = [("theo g", "theo günter", True), ("theo", "theo günter", False), ("theo g.", "theo g", True), ("anna b", "anna c", False), ("li hua", "li h", True)]
#: (affiliation, institution key).
PLACE_CASES = [("Dept, Wenzhou Medical University, China", "wenzhou"), ("University of Bern", "bern"), ("nothing", None), ("The Noor Clinic", "noor")]
#: (affiliation, surname; segments joined, the first one's institution).
SEGMENT_CASES = [
    ("Unit A (Roth), Bern; Unit B (Adler, Koch), Basel.", "Adler", "Unit B (Adler, Koch), Basel", "Koch)"),
    ("Department of Eyes, University of Bern, Switzerland; Rome", None, "Department of Eyes, University of Bern, Switzerland|Rome", "University of Bern"),
    ("Department of Ophthalmology", None, "Department of Ophthalmology", None),
    ("", None, "", None),
]
#: (institutions with codes, codes, affiliation; country code).
EXTERNAL_CASES = [
    ([("Queen Hospital", "GB"), ("Sydney Eye Clinic", "AU")], ["AU", "GB"], "Queen hospital, then Sydney", "GB"),
    ([("X", "AU"), ("Y", "GB"), ("Z", "GB")], ["AU", "GB"], "", "GB"),
    ([], ["CH"], "", "CH"),
]
#: (parsed country, its source, external country; whether the text overrules it).
OVERRIDE_CASES = [("China", "affil_country_name", "Taiwan", False), ("Korea", "affil_country_name", "China", True), ("Korea", "affil_city_hint", "China", False)]
#: (title, headings, arms that a record answers to).
ARM_CASES = [
    ("Corneal collagen cross-linking", [], "corneal_cxl_phrase|collagen_cxl_phrase"),
    ("Crosslinking of polymers", [], "bare_crosslink+disease"),
    ("CXL, epi-off", ["Corneal Cross-Linking"], "CXL_abbrev|epi_on_off|mesh_CXL"),
    ("Riboflavin and\nUV-A light", [], "riboflavin_uv"),
    ("Nothing of it", [], "none_in_text"),
]


def dealt(keys: DataFrame, key: str, cases: list[tuple], schema: str) -> DataFrame:
    """(key, ``schema``'s fields): each row's case.  The cases are literals, so nothing is joined."""
    kind = _parse_datatype_string(schema)
    rows = F.array(*[literal(dict(zip(kind.names, case, strict=True)), kind) for case in cases])
    return keys.select(key, F.get(rows, F.pmod(F.col(key), F.lit(len(cases))).cast("int")).alias("_c")).select(key, "_c.*")


def literal(value, kind) -> Column:
    """A Python value as a column of a type."""
    if kind.typeName() == "struct":
        return F.struct(*[literal((value or {}).get(f.name), f.dataType).alias(f.name) for f in kind.fields])
    if kind.typeName() == "array":
        if value is None:
            return F.lit(None).cast(kind)
        names = kind.elementType.names if kind.elementType.typeName() == "struct" else None
        return F.array(*[literal(dict(zip(names, v, strict=True)) if names and isinstance(v, tuple) else v, kind.elementType) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


def records(keys: DataFrame, key: str, cases: list[dict]) -> DataFrame:
    """Records whose fields are those of their case; the key is rec_seq and pmid."""
    kind = _parse_datatype_string(RECORD)
    rows = dealt(keys, key, [tuple({**c}.get(n) for n in kind.names) for c in cases], RECORD)
    return rows.withColumns({"rec_seq": F.col(key).cast("long"), "pmid": F.col(key).cast("string")}).select(*kind.names)


def outcome(key: str, values: list) -> str:
    """SQL for the outcome of a key's case."""
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {show(v)}" for i, v in enumerate(values)) + " END"
