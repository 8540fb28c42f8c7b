"""Role families of job titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelens.functions.text import col, let

#: Families in order of priority, each with its title phrases.
FAMILIES: dict[str, tuple[str, tuple[str, ...]]] = {
    "ai_ml_engineer": ("AI / ML Engineer", ("ai engineer", "artificial intelligence engineer", "machine learning engineer", "ml engineer", "genai engineer", "generative ai engineer", "llm engineer", "nlp engineer", "deep learning engineer", "prompt engineer", "computer vision engineer")),
    "data_scientist": ("Data Scientist", ("data scientist", "applied scientist", "research scientist", "decision scientist")),
    "data_engineer": ("Data Engineer", ("data engineer", "big data engineer", "etl engineer", "analytics engineer", "bi engineer", "business intelligence engineer")),
    "data_analyst": ("Data Analyst", ("data analyst", "business intelligence analyst", "bi analyst", "analytics analyst", "reporting analyst")),
    "robotics": ("Robotics", ("robotics engineer", "robotics software engineer", "robotics systems engineer", "robotics control engineer", "robotics controls engineer", "robotics perception engineer", "robotics researcher", "robotics scientist", "autonomy engineer", "autonomous systems engineer", "mechatronics engineer", "motion planning engineer", "robot perception engineer", "robot control engineer", "ros engineer")),
    "software_engineer": ("Software Engineer", ("software engineer", "software developer", "backend engineer", "backend developer", "front end engineer", "frontend engineer", "full stack engineer", "fullstack engineer", "application developer", "mobile developer")),
    "cloud_devops_engineer": ("Cloud / DevOps Engineer", ("devops engineer", "site reliability engineer", "sre", "platform engineer", "cloud engineer", "infrastructure engineer", "systems engineer")),
    "cybersecurity": ("Cybersecurity", ("cybersecurity", "cyber security", "security engineer", "security analyst", "soc analyst", "information security", "penetration tester")),
    "product_manager": ("Product Manager", ("product manager", "product owner", "technical product manager", "associate product manager")),
    "business_analyst": ("Business Analyst", ("business analyst", "systems analyst", "functional analyst", "process analyst")),
    "ux_product_design": ("UX / Product Design", ("ux designer", "ui designer", "product designer", "user experience designer", "user interface designer")),
    "quality_engineer": ("Quality Engineer", ("qa engineer", "quality engineer", "test engineer", "automation tester")),
    "project_program_manager": ("Project / Program Manager", ("project manager", "program manager", "programme manager", "delivery manager", "scrum master")),
}
OTHER, OTHER_LABEL, CUSTOM = "other", "Other / Uncategorized", "custom:"
#: Words of custom labels that are not just capitalised.
ACRONYMS = {"ai": "AI", "api": "API", "bi": "BI", "crm": "CRM", "devops": "DevOps", "llm": "LLM", "ml": "ML", "nlp": "NLP", "qa": "QA", "sre": "SRE", "ui": "UI", "ux": "UX"}


def normalize_title(title: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(title)), r"[^a-z0-9+#.]", " "), r"\s+", " "))


def _family(fid: str, label: str, confidence: float, phrase: Column) -> Column:
    return F.struct(F.lit(fid).alias("id"), F.lit(label).alias("label"), F.lit(confidence).alias("confidence"), phrase.cast("string").alias("phrase"))


def classify_title(title: str | Column) -> Column:
    """struct<id, label, confidence, phrase>: the first phrase, by priority, that is in the title as whole words."""
    padded = F.concat(F.lit(" "), F.coalesce(normalize_title(title), F.lit("")), F.lit(" "))
    known = F.array(*[F.struct(F.lit(f" {phrase} ").alias("key"), _family(fid, label, 0.95, F.lit(phrase)).alias("family")) for fid, (label, phrases) in FAMILIES.items() for phrase in phrases])
    found = let(padded, lambda t: F.get(F.filter(known, lambda k: F.contains(t, k["key"])), F.lit(0))["family"])
    return F.coalesce(found, _family(OTHER, OTHER_LABEL, 0.0, F.lit(None)))


def custom_family_id(name: str | Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(name))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    slug = F.regexp_replace(F.substring(slug, 1, 120), "_+$", "")
    return F.when(slug != "", F.concat(F.lit(CUSTOM), slug))


def custom_family_label(fid: str | Column) -> Column:
    """The label of a valid custom id; null for others."""
    slug = F.substring(col(fid), len(CUSTOM) + 1, 1000)
    word = lambda w: F.coalesce(*[F.when(w == k, v) for k, v in ACRONYMS.items()], F.initcap(w))
    label = F.array_join(F.transform(F.filter(F.split(slug, "_"), lambda w: w != ""), word), " ")
    return F.when(col(fid).startswith(CUSTOM) & slug.rlike("^[a-z0-9]+(_[a-z0-9]+)*$"), label)


def resolve_family(fid: str | Column, title: str | Column) -> Column:
    """The stored family if it is known or a valid custom one, else the title's."""
    stored = F.when(F.lit(False), _family(OTHER, OTHER_LABEL, 1.0, F.lit(None)))
    for known, (label, _) in FAMILIES.items():
        stored = stored.when(col(fid) == known, _family(known, label, 1.0, F.lit(None)))
    stored = stored.when(col(fid) == OTHER, _family(OTHER, OTHER_LABEL, 1.0, F.lit(None)))
    label = custom_family_label(fid)
    custom = F.struct(col(fid).alias("id"), label.alias("label"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("phrase"))
    return F.coalesce(stored, F.when(label.isNotNull(), custom), classify_title(title))
