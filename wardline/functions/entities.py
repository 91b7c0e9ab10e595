"""Extracted entities: which are kept, what they measure, and the record each becomes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import resources
from wardline.functions.clinical import SIG_HINT, parse_dosage
from wardline.functions.fhir import bound

#: Entity class to record type and resource type; other classes are attributes and become no record.
RECORDS = {
    "medication": ("medication", "MedicationRequest"), "condition": ("condition", "Condition"), "lab_result": ("observation", "Observation"),
    "vital": ("observation", "Observation"), "procedure": ("procedure", "Procedure"), "allergy": ("allergy", "AllergyIntolerance"),
    "encounter": ("encounter", "Encounter"), "imaging_result": ("diagnostic_report", "DiagnosticReport"), "family_history": ("family_history", "FamilyMemberHistory"),
    "assessment_plan": ("document", "DocumentReference"), "social_history": ("observation", "Observation"), "immunization": ("immunization", "Immunization"),
}
#: Names of vaccines, as whole words.
VACCINES = r"vaccin\w*|immuni[sz]\w*|booster|covid(-?19)?|sars[-\s]?cov[-\s]?2|influenza|flu(\s?shot|\svaccine)?|tdap|dtap|dtp|td|mmr|pneumococcal|prevnar|pneumovax|ppsv\d*|pcv\d*|shingles|zoster|shingrix|zostavax|hepatitis\s?[ab]|hep\s?[ab]|hpv|gardasil|varicella|chickenpox|tetanus|meningococcal|menactra|menveo|bexsero|menquadfi|rotavirus|rotateq|rotarix|hib|comirnaty|spikevax|moderna|pfizer|biontech|janssen|novavax|polio|ipv|opv|rsv\svaccine|arexvy|abrysvo"
#: Names of laboratory panels, which are orders rather than results.
PANELS = ["cbc", "cbc with differential", "complete blood count", "cmp", "comprehensive metabolic panel", "bmp", "basic metabolic panel", "metabolic panel", "lipid panel", "lipid profile", "hepatic panel", "liver panel", "liver function tests", "lft", "lfts", "thyroid panel", "urinalysis", "ua", "fit", "fecal immunochemical test", "a1c", "hemoglobin a1c"]
#: Words that tell a procedure was done, or is only planned.
PERFORMED = ["s/p", "status post", "status-post", "underwent", "performed", "post-op", "postop", "h/o", "history of", "removed", "resection", "excision", "completed", "done on", "biopsy", "status: completed"]
PLANNED = ["recommend", "consider", "due for", "due ", "screening option", "options include", "should ", "plan to", "planned", "schedule", "offered", "candidate for", "discuss", "advise", "elective pending", "to be done", "will need", "needs ", "differential"]
DONE_STATUSES = ["completed", "performed", "done", "historical", "resolved", "finished"]
#: Measurement words that name no analyte, tokens that name no drug, and labels of lifestyle entries.
UNIT_WORDS = ["mg", "mcg", "ug", "g", "kg", "lb", "lbs", "oz", "ml", "l", "dl", "mmhg", "bpm", "mm", "cm", "m", "in", "ft", "iu", "meq", "mmol", "mol", "ng", "pg", "u", "units", "unit", "kcal", "cal", "bmi", "f", "c", "percent", "pct"]
NO_DRUGS = ["ppi", "ppis", "ldn", "nsaid", "nsaids", "ssri", "ssris", "snri", "snris", "ace", "acei", "aceis", "arb", "arbs", "tca", "tcas", "maoi", "maois", "bb", "ccb", "dmard", "dmards", "otc", "prn", "ic", "go", "iv", "po", "im", "sq", "bid", "tid", "qid", "qhs", "qd", "tab", "tabs", "cap", "caps", "rx", "med", "meds", "drug", "drugs"]
LIFESTYLE = ["exercise", "diet", "alcohol", "tobacco", "smoking", "smoke", "caffeine", "sleep", "drugs", "substance", "activity", "nutrition", "recreational drugs", "physical activity"]
#: Verbs that open advice rather than history.
DIRECTIVES = ["avoid", "increase", "decrease", "reduce", "stop", "quit", "limit", "continue", "maintain", "start", "begin", "recommend", "recommended", "consider", "discuss", "encourage", "advise", "advised", "counsel", "cut", "eliminate", "abstain", "minimize", "follow"]
#: Words and phrases of occupations, hobbies and food, which are no measurements.
OCCUPATION = ["occupation", "accountant", "attorney", "lawyer", "analyst", "engineer", "manager", "consultant", "teacher", "professor", "developer", "programmer", "technician", "administrator", "executive", "director", "clerk", "cashier", "secretary", "salesman", "saleswoman", "salesperson", "electrician", "plumber", "carpenter", "mechanic", "chef", "waiter", "waitress", "pilot", "architect", "scientist", "researcher", "contractor", "realtor", "banker", "broker", "designer", "writer", "editor", "journalist", "retired", "unemployed", "homemaker", "student", "employed", "businessman", "businesswoman", "business"]
OCCUPATION_PHRASES = ["works as", "occupation is", "job title", "self employed", "employed as", "business owner", "stay at home"]
HOBBY = ["tennis", "golf", "golfer", "soccer", "basketball", "baseball", "football", "hockey", "yoga", "pilates", "crossfit", "marathon", "triathlon", "skiing", "snowboarding", "surfing", "gardening", "fishing", "hunting", "athlete", "weightlifting", "bodybuilding", "jogging", "cycling", "avid", "player", "hobby", "hobbies"]
HOBBY_PHRASES = ["weight lifting", "weight training", "lifts weights", "plays tennis", "plays golf", "works out", "tennis player", "martial arts", "rock climbing"]
FOOD = ["diet", "fodmap", "vegetarian", "vegan", "pescatarian", "keto", "ketogenic", "paleo", "spicy", "coffee", "snacks", "snacking", "food", "foods"]
FOOD_PHRASES = ["low fodmap", "gluten free", "dairy free", "low carb", "low fat", "acidic foods", "acidic food", "spicy foods", "fatty foods", "intermittent fasting", "food preference", "food preferences", "small frequent meals", "balanced diet"]
#: Words of substance use, words that make it a status, and how long commentary without one is.
SUBSTANCE = ["smoke", "smoking", "smoker", "smokes", "tobacco", "cigarette", "cigarettes", "cigar", "cigars", "vape", "vapes", "vaping", "nicotine", "marijuana", "cannabis"]
SUBSTANCE_STATUS = ["former", "never", "current", "currently", "non", "ex", "active", "social", "occasional", "occasionally", "heavy", "light", "daily", "denies", "denied", "quit", "none", "history", "past", "prior", "pack", "packs", "ppd", "year", "years", "use", "used", "status"]
COMMENTARY_WORDS = 4
#: Supplements, letters and digits only.
SUPPLEMENTS = ["b1", "b2", "b3", "b5", "b6", "b7", "b9", "b12", "bcomplex", "thiamine", "riboflavin", "niacin", "biotin", "folate", "folicacid", "cobalamin", "cyanocobalamin", "d2", "d3", "k1", "k2", "ascorbicacid", "iron", "ferroussulfate", "ironsulfate", "magnesium", "magnesiumoxide", "zinc", "calcium", "potassium", "selenium", "chromium", "iodine", "coq10", "coenzymeq10", "omega3", "omega6", "fishoil", "melatonin", "probiotic", "multivitamin", "glucosamine", "creatine"]
#: Attributes that name who did something, in the order they are tried.
PROVIDER_KEYS = ["provider", "performer", "performed_by", "ordering_provider", "ordered_by", "rendering_provider", "attending", "attending_provider", "physician", "doctor", "provider_name"]
#: Words of interpretation, and their codes.
INTERPRETATIONS = {"critical high": "HH", "critical low": "LL", "abnormal": "A", "normal": "N", "positive": "POS", "negative": "NEG", "high": "H", "low": "L", "wnl": "N"}

RANGE = r"\(?\s*(\d+(?:\.\d+)?)\s*(?:-|–|—|to)\s*(\d+(?:\.\d+)?)\s*\)?"
WORD_FLAG = r"(?i)(?:^|\s)(critical high|critical low|abnormal|normal|positive|negative|high|low|wnl)(?:\s|$)"
LETTER_FLAG = r"(?i)(?:^|\s)(HH|LL|H|L)\s*$"
VALUE = r"(?<![A-Za-z\d.])(\d+(?:\.\d+)?)\s*(%|[A-Za-zµ][A-Za-z0-9µ%/.\-]*)?"


def _some(s: Column) -> Column:
    return F.nullif(F.trim(s), F.lit(""))


def _any(s: Column, words: list[str]) -> Column:
    """Whether one of some words is in a text; one pattern, so the text is made and searched once."""
    return F.coalesce(s.rlike("|".join(map(re.escape, words))), F.lit(False))


def parse_lab(s: Column) -> Column:
    """struct(analyte, value, unit, ref_low, ref_high, interpretation) of text like ``Glucose 95 mg/dL (70-99) H``.

    The range goes first, then a flag in words, else a letter flag at the end,
    then the value with its unit; the analyte is what stands before the value.
    """
    codes = F.create_map(*[F.lit(x) for kv in INTERPRETATIONS.items() for x in kv])
    part = lambda x, pattern, i: _some(F.regexp_extract(x, pattern, i))
    without_word = rf"^(.*?){WORD_FLAG.replace('(?i)', '(?i:') + ')'}"

    def measured(x: Column) -> Column:
        """Of text without range and flag: what stands before the value, the value, its unit."""
        value = part(x["rest"], VALUE, 1)
        before = F.when(value.isNotNull(), F.regexp_replace(F.left(s, F.position(value, s) - 1), r"[,;:\-\s]+$", "")).otherwise(s)
        unit = F.when(value.isNotNull(), _some(F.regexp_replace(F.regexp_extract(x["rest"], VALUE, 2), r"[.,;:]+$", "")))
        return F.struct(_some(before).alias("analyte"), value.try_cast("double").alias("value"), unit.alias("unit"), x["low"].alias("ref_low"), x["high"].alias("ref_high"), x["mark"].alias("interpretation"))

    def lettered(x: Column) -> Column:
        letter = F.when(x["word"].isNull(), F.upper(part(x["rest"], LETTER_FLAG, 1)))
        rest = F.when(x["word"].isNotNull(), F.regexp_replace(x["rest"], without_word, "$1 ")).when(letter.isNotNull(), F.regexp_replace(x["rest"], LETTER_FLAG, "")).otherwise(x["rest"])
        return F.struct(rest.alias("rest"), x["low"].alias("low"), x["high"].alias("high"), F.coalesce(codes[x["word"]], letter).alias("mark"))

    without_range = lambda low: F.when(low.isNotNull(), F.regexp_replace(s, rf"^(.*?){RANGE}", "$1 ")).otherwise(s)
    ranged = bound(part(s, RANGE, 1), lambda low: F.struct(without_range(low).alias("rest"), low.try_cast("double").alias("low"), F.when(low.isNotNull(), part(s, RANGE, 2)).try_cast("double").alias("high")))
    worded = lambda x: F.struct(x["rest"].alias("rest"), x["low"].alias("low"), x["high"].alias("high"), F.lower(part(x["rest"], WORD_FLAG, 1)).alias("word"))
    return bound(bound(bound(ranged, worded), lettered), measured)


def is_panel(s: Column) -> Column:
    return F.lower(F.trim(s)).isin(*PANELS)


def is_vaccine(s: Column) -> Column:
    return F.coalesce(s.rlike(rf"(?i)\b({VACCINES})\b"), F.lit(False))


LABEL = r"(?s)^\s*([A-Za-z][A-Za-z /]*?)\s*:\s*(.*)$"


def _label(text: Column) -> Column:
    return F.lower(_some(F.regexp_extract(text, LABEL, 1)))


def _is_lifestyle(text: Column) -> Column:
    return F.coalesce(_label(text).isin(*LIFESTYLE), F.lit(False))


def entity_class(cls: Column, text: Column) -> Column:
    """The class after reclassification: vaccines among drugs and procedures, lifestyle labels among measurements."""
    return F.when(cls.isin("medication", "procedure") & is_vaccine(text), "immunization").when(cls.isin("observation", "lab_result", "vital") & _is_lifestyle(text), "social_history").otherwise(cls)


def is_directive(text: Column) -> Column:
    """Advice: what stands after a label, or else the text, opens with such a verb."""
    said = F.when(_label(text).isNotNull(), F.regexp_extract(text, LABEL, 2)).otherwise(text)
    first = F.lower(F.regexp_replace(F.substring_index(F.trim(said), " ", 1), "[^A-Za-z]", ""))
    return F.coalesce(first.isin(*DIRECTIVES), F.lit(False))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def _has_word(plain: Column, words: list[str]) -> Column:
    return F.arrays_overlap(F.split(plain, " "), F.array(*[F.lit(w) for w in words]))


def is_lifestyle_noise(text: Column) -> Column:
    """Occupation, hobby or food told without a number."""
    plain = _plain(text)
    padded = F.concat(F.lit(" "), plain, F.lit(" "))
    phrases = [f" {p} " for p in OCCUPATION_PHRASES + HOBBY_PHRASES + FOOD_PHRASES]
    return ~F.coalesce(text.rlike(r"\d"), F.lit(False)) & (_has_word(plain, OCCUPATION + HOBBY + FOOD) | _any(padded, phrases))


def is_substance_commentary(text: Column) -> Column:
    """Four words or more about substance use with neither a status nor a number."""
    plain = _plain(text)
    return ~F.coalesce(text.rlike(r"\d"), F.lit(False)) & _has_word(plain, SUBSTANCE) & ~_has_word(plain, SUBSTANCE_STATUS) & (F.size(F.split(plain, " ")) >= COMMENTARY_WORDS)


def procedure_happened(text: Column, context: Column, status: Column) -> Column:
    """Whether a procedure was done: not if words plan or advise it; else by a year, status, words or a surgical name."""
    whole = F.concat_ws(" ", text, context, status)
    around = F.lower(whole)
    surgical = F.coalesce(text.rlike(r"(?i)\w+(ectomy|otomy|ostomy|oplasty|plasty)\b"), F.lit(False))
    done = F.coalesce(F.lower(status).isin(*DONE_STATUSES), F.lit(False)) | _any(around, PERFORMED) | whole.rlike(r"\b(?:19|20)\d{2}\b") | surgical
    return done & ~_any(around, PLANNED)


def is_fragment(text: Column) -> Column:
    """A value without an analyte: a digit or inch mark, and no words but units; blank text too."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z]+)"))
    named = F.exists(words, lambda w: ~F.lower(w).isin(*UNIT_WORDS))
    return _some(text).isNull() | (~named & text.rlike("[\\d'\"]"))


def is_drug_name(text: Column) -> Column:
    """A supplement, or three letters or more that are neither an abbreviation nor one letter with digits."""
    low, plain = F.lower(F.trim(text)), F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
    supplement = plain.isin(*SUPPLEMENTS) | plain.startswith("vitamin")
    return ~low.isin(*NO_DRUGS) & (supplement | (~low.rlike(r"^[a-z]\d+$") & (F.length(F.regexp_replace(low, "[^a-z]", "")) >= 3)))


def is_placeholder(text: Column) -> Column:
    """Holds what de-identification left."""
    return text.rlike(r"\[[A-Z][A-Z0-9_]+\]")


def kept(cls: Column, text: Column, context: Column, status: Column) -> Column:
    """Whether an entity of its class after reclassification becomes a record."""
    measured = ~is_lifestyle_noise(text) & ~is_substance_commentary(text) & ~is_fragment(text)
    fine = (
        F.when(cls == "procedure", procedure_happened(text, context, status))
        .when(cls.isin("observation", "lab_result", "vital"), measured)
        .when(cls == "medication", is_drug_name(text))
        .when(cls == "social_history", ~is_directive(text))
        .otherwise(True)
    )
    return F.coalesce(fine, F.lit(True)) & _some(text).isNotNull() & ~is_placeholder(text)


def to_records(entities: DataFrame, carry: tuple[str, ...] = (), told: bool = False, resource: bool = True) -> DataFrame:
    """Kept entities (doc_id, pos, entity_class, text, context, status) as record rows with their resource as JSON.

    ``attributes`` (map of text) and ``provider`` are used where the columns are
    there; ``carry`` names further columns to keep. ``told`` adds what a choice
    between encounters or drugs needs, without reading the JSON again: the names
    of the fields of their resource (``filled``) and what an encounter's says of
    the visit (``visit_text``). Without ``resource`` the JSON and the text
    shown are left out.
    """
    # Exploded, the class is told once; a filter would else be pushed below and tell it again wherever it names it.
    rows = entities.withColumn("_given", F.col("entity_class")).withColumn("entity_class", F.explode(F.array(entity_class(F.col("entity_class"), F.col("text")))))
    rows = rows.filter(F.col("entity_class").isin(*RECORDS) & kept(F.col("entity_class"), F.col("text"), F.col("context"), F.col("status")))
    pick = lambda i: F.create_map(*[F.lit(x) for k, v in RECORDS.items() for x in (k, v[i])])[F.col("entity_class")]
    none = F.lit(None).cast("map<string,string>")
    given = F.col("attributes") if "attributes" in entities.columns else none
    given = F.map_concat(F.coalesce(given, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.when(F.col("status").isNotNull() & ~F.map_contains_key(F.coalesce(given, F.create_map(F.lit(""), F.lit(""))), F.lit("status")), F.create_map(F.lit("status"), F.col("status"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    cls = F.col("entity_class")
    # A measurement that turned out to be lifestyle is labelled as such.
    label = F.create_map(F.lit("category"), _label(F.col("text")), F.lit("value"), F.coalesce(_some(F.regexp_extract("text", LABEL, 2)), F.col("text")))
    moved = (cls == "social_history") & (F.col("_given") != "social_history")
    attrs = F.when(moved, F.map_concat(F.map_filter("_attrs", lambda k, v: ~k.isin("category", "value")), label)).otherwise(F.col("_attrs"))
    rows = rows.withColumn("_attrs", given).withColumn("_attrs", attrs)
    # Only results are read as results, and only drugs as sigs, where something of one is said.
    sig = F.concat_ws(" ", "text", F.try_element_at("_attrs", F.lit("dosage")), F.try_element_at("_attrs", F.lit("frequency")))
    rows = rows.withColumn("_lab", F.when(cls == "lab_result", parse_lab(F.col("text")))).withColumn("_sig", F.when((cls == "medication") & sig.rlike(SIG_HINT), bound(sig, parse_dosage)))
    order = (cls == "lab_result") & is_panel(F.col("text")) & F.col("_lab.value").isNull()
    rows = rows.withColumn("record_type", F.when(order, "service_request").otherwise(pick(0))).withColumn("fhir_resource_type", F.when(order, "ServiceRequest").otherwise(pick(1)))
    provider = F.col("provider") if "provider" in entities.columns else F.lit(None).cast("string")
    who = F.coalesce(resources.attr(F.col("_attrs"), *PROVIDER_KEYS), provider)
    text, attrs = F.col("text"), F.col("_attrs")
    shown = [resources.display(cls, text, attrs).alias("display_text"), F.lit("ai_extracted").alias("source_format"), F.lit(True).alias("ai_extracted"), resources.build(F.col("fhir_resource_type"), cls, text, attrs, who, F.col("_lab"), F.col("_sig")).alias("resource_json")] if resource else []
    more = [F.when(cls == "encounter", resources.filled(resources.visit_fields(text, attrs, who))).when(cls == "medication", resources.filled(resources.drug_fields(text, attrs, who, F.col("_sig")))).alias("filled"), F.when(cls == "encounter", resources.visit_text(text, attrs)).alias("visit_text")] if told else []
    return rows.select("doc_id", "pos", "entity_class", "record_type", "fhir_resource_type", *shown, *carry, *more)


#: Fields a resource must have besides its type.
REQUIRED = {"Condition": ["code"], "Observation": ["status", "code"], "MedicationRequest": ["status", "intent"], "Procedure": ["status"], "Encounter": ["status", "class"], "Immunization": ["status", "vaccineCode"], "DiagnosticReport": ["status", "code"], "DocumentReference": ["status"]}


def missing_fields(resource_json: Column) -> Column:
    """Required fields a resource lacks, as an array; it informs and never blocks."""
    kind = F.get_json_object(resource_json, "$.resourceType")
    out = F.array().cast("array<string>")
    for name, fields in REQUIRED.items():
        lacking = F.array(*[F.when(F.get_json_object(resource_json, f"$.{f}").isNull(), F.lit(f)) for f in fields])
        out = F.when(kind == name, F.filter(lacking, lambda x: x.isNotNull())).otherwise(out)
    return out
