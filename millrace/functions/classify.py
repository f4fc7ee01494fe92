"""Ordered rules: the first one that matches decides."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import clean

FLAGS = "(?iu)"


@dataclass(frozen=True)
class Rule:
    """A name with the beginnings of words and the whole words that stand for it; a blank inside is any blank or hyphen."""

    name: str
    begins: tuple[str, ...] = ()
    whole: tuple[str, ...] = ()

    def pattern(self) -> str:
        """One regular expression that needs no look-around, so that other engines read it alike."""
        spaced = lambda words: "|".join(w.replace(" ", "[ -]") for w in words)
        parts = [rf"\b({spaced(self.begins)})"] if self.begins else []
        return "|".join(parts + ([rf"\b({spaced(self.whole)})\b"] if self.whole else []))


#: (slug, name) of the categories in the order in which they are shown (fixed values).
CATEGORIES: tuple[tuple[str, str], ...] = (
    ("healthcare", "Healthcare & Nursing"), ("education", "Education & Training"), ("workday", "Workday"), ("data-engineering", "Data Engineering"), ("data-analytics", "Data Analytics"),
    ("data-science", "Data Science & ML"), ("software", "Software Engineering"), ("it-ops", "IT & Infrastructure"), ("engineering", "Engineering & Technical"), ("science", "Science & Research"),
    ("skilled-trades", "Skilled Trades & Maintenance"), ("manufacturing", "Manufacturing & Production"), ("construction", "Construction & Facilities"), ("transport", "Transportation & Logistics"),
    ("food-hospitality", "Food Service & Hospitality"), ("retail-customer", "Retail & Customer Service"), ("sales", "Sales & Business Development"), ("marketing", "Marketing & Communications"),
    ("finance", "Finance & Accounting"), ("legal", "Legal & Compliance"), ("hr", "Human Resources"), ("social-services", "Social Services & Nonprofit"),
    ("security", "Security & Protective Services"), ("admin", "Administrative & Office"), ("management", "Management & Operations"), ("other", "Other"),
)

#: Narrow fields before broad ones: nearly every title can hold "manager". A default; callers bring their own.
CATEGORY_RULES: tuple[Rule, ...] = (
    Rule("healthcare", ("nurs", "medic", "clinic", "physician", "surg", "dental", "dentist", "pharm", "therap", "patient", "caregiv", "hospice", "paramedic", "veterin", "radiolog", "sonograph", "ultrasound", "psych", "health", "behavior tech", "direct support"), ("rn", "lpn", "cna", "emt", "dsp")),
    Rule("education", ("teach", "tutor", "professor", "lectur", "instructor", "educat", "school", "childcare", "kindergarten", "preschool", "librar", "curricul", "academic", "admission"), ("dean", "coach")),
    Rule("workday", (), ("workday",)),
    Rule("data-engineering", ("data engineer", "analytics engineer", "data architect", "data warehous", "data platform", "data pipeline", "data quality", "data governance", "data steward", "big data", "database engineer", "database developer", "databricks", "snowflake", "hadoop", "kafka"), ("etl", "elt", "dbt", "pyspark")),
    Rule("data-analytics", ("data analy", "analytics", "business intelligence", "business analyst", "reporting analyst", "insights analyst", "tableau"), ("bi", "power bi")),
    Rule("data-science", ("data scien", "machine learning", "deep learning", "artificial intelligence", "computer vision", "applied scien", "decision scien", "quantitative", "biostatis", "statistician"), ("ml", "ai", "nlp", "mlops")),
    Rule("manufacturing", ("cnc", "toolmak"), ("plc programmer", "laser programmer")),
    Rule("software", ("software", "developer", "programmer", "full stack", "fullstack", "frontend", "backend", "front end engineer", "back end engineer", "devops", "site reliab", "platform engineer", "cloud engineer", "test engineer", "firmware", "embedded", "android", "solutions architect"), ("sre", "ios", "qa engineer")),
    Rule("it-ops", ("it support", "it manager", "it director", "helpdesk", "help desk", "service desk", "desktop support", "technical support", "system administrat", "systems administrat", "network", "database administrat", "infrastructure", "cyber", "infosec", "information security", "salesforce"), ("sap", "erp", "dba", "noc", "soc")),
    Rule("engineering", ("engineer", "mechanical", "electrical", "civil", "chemical", "structural", "aerospace", "drafter", "survey", "architect", "geolog"), ("cad",)),
    Rule("science", ("scientist", "research", "laborator", "chemist", "biolog", "toxicolog", "epidemiolog"), ("lab",)),
    Rule("skilled-trades", ("technician", "mechanic", "electrician", "plumb", "weld", "machinist", "mainten", "millwright", "pipefit", "locksmith", "automotive", "diesel", "repair", "install", "field service", "apprentice", "journeyman"), ("hvac",)),
    Rule("manufacturing", ("production", "manufactur", "assembl", "machine operator", "fabricat", "packag", "quality control", "quality assurance", "extrusion", "molding", "plant operator"), ("qc",)),
    Rule("construction", ("construct", "carpent", "mason", "roof", "painter", "concrete", "excavat", "landscap", "groundskeep", "janitor", "custod", "housekeep", "facilit", "laborer", "superintend")),
    Rule("transport", ("driver", "truck", "deliver", "courier", "chauffeur", "warehous", "logistic", "supply chain", "shipping", "receiving", "dispatch", "freight", "fleet", "transport", "forklift", "picker", "packer", "flight", "inventor"), ("cdl", "pilot")),
    Rule("food-hospitality", ("cook", "chef", "kitchen", "culinar", "baker", "barista", "bartend", "server", "waiter", "waitress", "dishwash", "restaurant", "food", "cater", "hotel", "hospitalit", "front desk", "concierge", "banquet", "crew member", "menu"), ("host", "hostess")),
    Rule("retail-customer", ("cashier", "retail", "store", "sales associate", "customer", "call center", "contact center", "client service", "guest service", "teller", "stocker", "merchandis", "team member", "shift lead")),
    Rule("sales", ("sales", "account executive", "account manager", "business development", "territor", "real estate", "broker", "leasing", "financial advis", "insurance agent", "enrollment"), ("bdr", "sdr")),
    Rule("marketing", ("marketing", "brand", "content", "social media", "communications", "public relations", "copywrit", "creative", "graphic", "designer", "photograph", "videograph", "editor", "journalis", "pricing"), ("seo", "ux", "ui", "pr")),
    Rule("finance", ("accountan", "accounting", "bookkeep", "payroll", "financ", "controller", "treasur", "audit", "tax", "billing", "credit", "collection", "underwrit", "actuar", "budget", "claims", "bank", "mortgage", "loan")),
    Rule("legal", ("attorney", "lawyer", "legal", "paralegal", "counsel", "complian", "regulator", "litigat", "contracts", "privacy", "risk manage")),
    Rule("hr", ("human resources", "recruit", "talent", "people operations", "staffing", "onboarding", "benefits", "compensation", "employee relations", "training and development"), ("hr",)),
    Rule("social-services", ("social work", "case manag", "case work", "counsel", "volunteer", "nonprofit", "communit", "outreach", "advoca", "chaplain", "pastor", "youth")),
    Rule("security", ("security", "guard", "surveillance", "loss prevention", "police", "firefight", "correctional", "safety")),
    Rule("admin", ("administrat", "executive assistant", "receptionist", "secretar", "office manager", "office assistant", "data entry", "schedul", "coordinat", "clerical", "clerk", "records")),
    Rule("management", ("manage", "director", "supervis", "president", "chief", "executive", "operations", "leadership"), ("ceo", "cfo", "cto", "coo", "head of", "principal")),
)

#: Levels from junior to senior (fixed values), and their rules, the strongest sign first.
LEVELS = ("INTERNSHIP", "ENTRY", "MID", "SENIOR", "LEAD", "MANAGER", "DIRECTOR", "EXECUTIVE", "UNKNOWN")
LEVEL_RULES: tuple[Rule, ...] = (
    Rule("EXECUTIVE", (), ("chief", "ceo", "cfo", "cto", "coo", "cio", "ciso", "president", "vice president", "vp", "svp", "evp", "executive director", "partner", "owner", "founder")),
    Rule("DIRECTOR", (), ("director", "head of", "dean")),
    Rule("MANAGER", (), ("manager", "supervisor", "superintendent", "foreman", "gm")),
    Rule("LEAD", (), ("lead", "leader", "principal", "staff engineer", "architect")),
    Rule("SENIOR", (), ("senior", "sr", "experienced", "advanced", "expert", "iii", "iv", "level 3", "level 4")),
    Rule("INTERNSHIP", (), ("intern", "internship", "co op", "coop", "trainee", "apprentice", "student", "fellow", "fellowship", "resident", "residency")),
    Rule("ENTRY", (), ("entry", "junior", "jr", "assistant", "associate", "graduate", "new grad", "helper", "aide", "attendant", "i", "level 1")),
)

# Words of feeds for a level.
SOURCE_LEVELS = {
    "entry level": "ENTRY", "entry": "ENTRY", "junior": "ENTRY", "associate": "ENTRY", "0-1 year": "ENTRY", "1-3 years": "MID", "mid-level": "MID", "mid level": "MID", "intermediate": "MID",
    "experienced": "SENIOR", "mid-senior level": "SENIOR", "senior": "SENIOR", "senior level": "SENIOR", "lead": "LEAD", "management": "MANAGER", "manager": "MANAGER", "director": "DIRECTOR",
    "executive": "EXECUTIVE", "internship": "INTERNSHIP", "intern": "INTERNSHIP",
}


def first_match(text: Column, rules: Sequence[Rule]) -> Column:
    """The name of the first rule that is found, null if none is."""
    chain = None
    for rule in rules:
        found = text.rlike(FLAGS + rule.pattern())
        chain = F.when(found, rule.name) if chain is None else chain.when(found, rule.name)
    return F.lit(None).cast("string") if chain is None else chain


def category(title: Column, department: Column, rules: Sequence[Rule] = CATEGORY_RULES, other: str = "other") -> Column:
    """By the title; by the department only where no rule matches a title that says something."""
    by_title = first_match(title, rules)
    return F.coalesce(by_title, F.when(clean(title).isNotNull(), first_match(department, rules)), F.lit(other))


def level(title: Column, stated: Column, rules: Sequence[Rule] = LEVEL_RULES) -> Column:
    """What the source states, else by the title, else UNKNOWN."""
    known = F.create_map(*[F.lit(x) for pair in SOURCE_LEVELS.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(clean(stated))), first_match(title, rules), F.lit("UNKNOWN"))


def categories(spark: SparkSession) -> DataFrame:
    """(slug, name, sort_order): the category dimension."""
    return spark.createDataFrame([(s, n, i) for i, (s, n) in enumerate(CATEGORIES, 1)], "slug string, name string, sort_order int")


def sql_chain(column: str, rules: Sequence[Rule]) -> str:
    """The same rules as ANSI SQL with regexp_matches, for a second engine."""
    arms = " ".join(f"WHEN regexp_matches({column}, '(?i){r.pattern()}') THEN '{r.name}'" for r in rules)
    return f"CASE {arms} END"
