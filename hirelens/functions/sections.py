"""Sections of a job description by their headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelens.functions.text import col, let

RESPONSIBILITIES = "responsibilities"
REQUIRED = "required_competencies_and_certifications"
PREFERRED = "preferred_competencies_and_qualifications"
#: Headings of each section.
HEADINGS = {
    RESPONSIBILITIES: ("responsibilities", "job responsibilities", "key responsibilities", "what you will be working on"),
    REQUIRED: ("required competencies and certifications", "required competencies", "requirements", "required qualifications", "minimum qualifications"),
    PREFERRED: ("preferred competencies and qualifications", "preferred competencies", "preferred qualifications", "preferred requirements", "good to have"),
}
_LONGEST_FIRST = sorted((h for hs in HEADINGS.values() for h in hs), key=lambda h: -len(h))
_PATTERN = r"(?iu)(?<![\p{L}\p{N}_])(?:" + "|".join(_LONGEST_FIRST) + r")(?![\p{L}\p{N}_])\s*:?"


def _section(heading: Column) -> Column:
    # text after "preferred requirements" belongs to the requirements that this heading ends with
    required = (*HEADINGS[REQUIRED], "preferred requirements")
    of = lambda name: F.when(name.isin(*HEADINGS[RESPONSIBILITIES]), RESPONSIBILITIES).when(name.isin(*required), REQUIRED).otherwise(PREFERRED)
    return let(F.trim(F.regexp_replace(F.lower(heading), r"\s*:?$", "")), of)


def extract_sections(text: str | Column) -> Column:
    """map<section, text>; the last of equal sections holds, empty ones are left out."""
    strip = lambda x: F.regexp_replace(x, r"^[ :\-\n\t]+|[ :\-\n\t]+$", "")

    def found(flat: Column) -> Column:
        heads = F.regexp_extract_all(flat, F.lit(_PATTERN), F.lit(0))
        bodies = F.slice(F.split(flat, _PATTERN, -1), F.lit(2), F.lit(1 << 20))
        return F.filter(F.zip_with(heads, bodies, lambda h, b: F.struct(_section(h).alias("key"), strip(b).alias("value"))), lambda e: e["value"] != "")

    def last(rows: Column) -> Column:
        later = lambda e, i: F.exists(F.slice(rows, i + 2, F.greatest(F.size(rows), F.lit(1))), lambda x: x["key"] == e["key"])
        return F.map_from_entries(F.filter(rows, lambda e, i: ~later(e, i)))

    flat = F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)\s+", " "))
    return let(let(flat, found), last)


def sections_of_listing(payload: str | Column, text: str | Column) -> Column:
    """Stored sections of the payload if it has an object of them, else those of the text."""
    kept = F.from_json(F.get_json_object(col(payload), "$.structured_sections"), "map<string,string>")
    return F.coalesce(F.map_filter(kept, lambda _, v: v.isNotNull()), extract_sections(text))
