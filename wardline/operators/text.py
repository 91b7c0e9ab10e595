"""Documents to sections, chunks, entities: the text side of extraction.

Work is per document and rows are documents, so everything runs as narrow
maps; model calls are injected functions with deterministic defaults.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.fhir import bound

SECTION_TYPES = ["medications", "labs", "vitals", "procedures", "allergies", "imaging", "social_history", "family_history", "assessment_plan", "review_of_systems", "physical_exam", "history_of_present_illness", "problems", "clinical_note", "other"]
ESCALATED = ["labs", "vitals", "procedures", "allergies", "imaging", "social_history", "family_history", "assessment_plan", "review_of_systems", "physical_exam", "other", "clinical_note"]
MAX_CHARS, OVERLAP, SMALL_DOCUMENT, SUBSTANTIVE = 2000, 200, 3000, 40
CODED, UNCODED = 0.9, 0.5

Anchors = Callable[[str], list[tuple[str, str]]]


def heading_anchors(text: str) -> list[tuple[str, str]]:
    """Default section finder: lines ``Name:`` whose name is a section type in words."""
    found = []
    for line in text.split("\n"):
        name = line.strip().rstrip(":").lower().replace(" ", "_")
        if line.strip().endswith(":") and name in SECTION_TYPES:
            found.append((name, line))
    return found


def sections_of(text: str, anchors: list[tuple[str, str]]) -> list[tuple[str, str, int, int]]:
    """(type, title, start, end) covering the whole text: anchors are looked for onward, else anywhere, else dropped."""
    places, onward = [], 0
    for kind, anchor in anchors:
        at = text.find(anchor, onward) if anchor else -1
        at = text.find(anchor) if anchor and at < 0 else at
        if at >= 0:
            places.append((at, kind if kind in SECTION_TYPES else "other", anchor))
            onward = at + len(anchor)
    if not places:
        return [("other", "Full Document", 0, len(text))]
    places.sort(key=lambda p: p[0])
    ends = [p[0] for p in places[1:]] + [len(text)]
    lead = [("other", "Preamble", 0, places[0][0])] if places[0][0] else []
    return lead + [(kind, title, at, end) for (at, kind, title), end in zip(places, ends, strict=True)]


def split_section(text: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Chunks of whole paragraphs (sentences where there is but one), each starting with the end of the one before."""
    if len(text) <= most:
        return [text]
    parts, glue = text.split("\n\n"), "\n\n"
    if len(parts) == 1:
        parts, glue = text.replace(". ", ".\n").split("\n"), " "
    chunks, now = [], ""
    for part in parts:
        longer = f"{now}{glue}{part}" if now else part
        if now and len(longer) > most:
            chunks.append(now)
            longer = f"{now[-overlap:]}{glue}{part}"
        now = longer
    return chunks + ([now] if now else [])


def packed_chunks(text: str, anchors: Anchors, most: int = MAX_CHARS, small: int = SMALL_DOCUMENT) -> list[tuple[str, str]]:
    """(section type, chunk): sections split, then small chunks packed across sections under the first one's type."""
    cut = [("other", "Full Document", 0, len(text))] if len(text) < small else sections_of(text, anchors(text))
    out: list[list[str]] = []
    for kind, _, a, b in cut:
        for chunk in split_section(text[a:b], most):
            if out and out[-1][1] and len(out[-1][1]) + len(chunk) + 1 <= most:
                out[-1][1] += "\n" + chunk
            else:
                out.append([kind, chunk])
    return [(k, c) for k, c in out if c]


def chunk_documents(docs: DataFrame, anchors: Anchors = heading_anchors, most: int = MAX_CHARS) -> DataFrame:
    """(doc_id, chunk_no, section_type, chunk) of whole documents (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, kind, chunk) for d, t in zip(b.doc_id, b.text, strict=True) if t for i, (kind, chunk) in enumerate(packed_chunks(t, anchors, most))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "section_type", "chunk"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk_no int, section_type string, chunk string")


def find_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Dictionary entities: places where a term's words stand in a text, one row each (doc_id, label, term, code, pos).

    ``terms`` has term, label, code; each word of a text meets only terms that
    begin with it. Spark broadcasts them where they are small enough.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
    placed = docs.select("doc_id", words.alias("words")).select("doc_id", "words", F.posexplode("words").alias("pos", "word"))
    t = terms.withColumn("parts", F.split("term", " ")).withColumn("head", F.get("parts", F.lit(0)))
    hit = placed.join(t, F.col("word") == F.col("head"))
    return hit.filter(F.slice("words", F.col("pos") + 1, F.size("parts")) == F.col("parts")).select("doc_id", "label", "term", "code", "pos")


def assertion(before: Column, after: Column) -> Column:
    """struct(negated, family, historical, hypothetical) from the words around an entity in its sentence."""
    said = lambda c, p: F.coalesce(c.rlike(rf"(?i)\b({p})\b"), F.lit(False))
    return F.struct(
        (said(before, "no|not|denies|denied|without|negative for|never|ruled out") | said(after, "ruled out|was negative")).alias("negated"),
        said(before, "mother|father|mom|dad|brother|sister|aunt|uncle|grandmother|grandfather|family history of").alias("family"),
        said(before, "history of|previous|prior|past").alias("historical"),
        said(before, "if|should|rule out|in case of|may develop|risk of").alias("hypothetical"),
    )


def disposition(label: Column, a: Column) -> Column:
    """Entity class an asserted span becomes; null drops it: hypothetical, negated; a relative's condition is family history."""
    condition = F.when(a["family"], "family_history").when(~a["negated"], "condition")
    kind = F.when(label == "DISEASE", condition).when((label == "CHEMICAL") & ~a["negated"], "medication")
    return F.when(~a["hypothetical"], kind)


def entity_status(a: Column) -> Column:
    return F.when(a["historical"], "historical").otherwise("active")


def escalate(section_type: Column, mean_confidence: Column, chars: Column, threshold: float = 0.7) -> Column:
    """Whether a section goes to the injected model: by type, low confidence, or text in which nothing was found."""
    return section_type.isin(*ESCALATED) | F.coalesce(mean_confidence < threshold, F.lit(False)) | (mean_confidence.isNull() & (chars >= SUBSTANTIVE))


def section_confidence(spans: DataFrame, by: list[str]) -> DataFrame:
    """Mean confidence of the spans of each section: coded ones count 0.9, others 0.5."""
    return spans.groupBy(*by).agg(F.avg(F.when(F.col("code").isNotNull(), CODED).otherwise(UNCODED)).alias("mean_confidence"))


def collect_chunks(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities of the chunks that came back, with their section, and per document how many chunks did not.

    ``results`` has doc_id, chunk_no, section_type, error (null or blank: none)
    and entities, an array of structs (null: the call itself failed).
    """
    failed = F.col("entities").isNull() | (F.coalesce(F.trim("error"), F.lit("")) != "")
    counts = results.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count_if(failed).alias("n_failed"))
    found = results.filter(~failed).select("doc_id", "chunk_no", F.col("section_type").alias("source_section"), F.posexplode("entities").alias("pos", "entity"))
    return found.select("doc_id", "chunk_no", "pos", "source_section", "entity.*"), counts


def _fact_parts() -> dict[str, Column]:
    """Aggregates over a document's entities from which its facts are drawn."""
    first = lambda x, test: F.min_by(x, F.when(test & x.isNotNull(), F.struct("pos", x.alias("x"))))
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    who = F.coalesce(some(F.col("name")), some(F.col("text")))
    return {"met": first(F.col("entity_date"), F.col("entity_class") == "encounter"), "visit": F.max("visit_date"), "document_provider": first(who, F.col("entity_class") == "provider")}


def document_facts(entities: DataFrame) -> DataFrame:
    """(doc_id, document_date, document_provider): the first dated encounter's date, else the visit's; the first provider named.

    ``entities`` has doc_id, pos, entity_class, text, name, entity_date, visit_date.
    """
    parts = _fact_parts()
    return entities.groupBy("doc_id").agg(F.coalesce(parts["met"], parts["visit"]).alias("document_date"), parts["document_provider"].alias("document_provider"))


def with_document_date(entities: DataFrame) -> DataFrame:
    """Entities with the ``document_date`` that ``document_facts`` has of them, in place."""
    parts, doc = _fact_parts(), Window.partitionBy("doc_id")
    return entities.withColumn("document_date", F.coalesce(parts["met"].over(doc), parts["visit"].over(doc)))


def sentence_spans(sections: DataFrame, terms: DataFrame) -> DataFrame:
    """Dictionary spans of sections (doc_id, section_no, section_type, text) with the words around them in their sentence."""
    cut = sections.select("doc_id", "section_no", "section_type", F.posexplode(F.split("text", r"[.!?\n]+")).alias("sentence_no", "text"))
    keyed = cut.withColumn("words", F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " "))
    t = terms.withColumn("parts", F.split("term", " ")).withColumn("head", F.get("parts", F.lit(0)))
    placed = keyed.select("*", F.posexplode("words").alias("pos", "word")).join(t, F.col("word") == F.col("head"))
    hit = placed.filter(F.slice("words", F.col("pos") + 1, F.size("parts")) == F.col("parts"))
    end = F.col("pos") + F.size("parts")
    before = F.array_join(F.slice("words", F.lit(1), F.col("pos")), " ")
    after = F.array_join(F.slice("words", end + 1, F.size("words")), " ")
    return hit.select("doc_id", "section_no", "section_type", "sentence_no", "pos", "label", "term", "code", before.alias("before"), after.alias("after"))


def hybrid(sections: DataFrame, terms: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Entities (doc_id, section_no, source_section, sentence_no, pos, entity_class, text, code, status, confidence, origin) of sections.

    The dictionary goes first. Sections it leaves in doubt (``escalate``) are
    also given to ``model``, an injected function of sections that returns
    doc_id, section_no, sentence_no, pos, entity_class, text, status and
    confidence.
    """
    spans = sentence_spans(sections, terms).withColumn("a", assertion(F.col("before"), F.col("after")))
    local = spans.withColumn("entity_class", disposition(F.col("label"), F.col("a"))).filter("entity_class IS NOT NULL")
    confidence = F.when(F.col("code").isNotNull(), CODED).otherwise(UNCODED)
    cols = ["doc_id", "section_no", "source_section", "sentence_no", "pos", "entity_class", "text", "code", "status", "confidence", "origin"]
    local = local.select("doc_id", "section_no", F.col("section_type").alias("source_section"), "sentence_no", "pos", "entity_class", F.col("term").alias("text"), "code", entity_status(F.col("a")).alias("status"), confidence.alias("confidence"), F.lit("dictionary").alias("origin"))
    if model is None:
        return local
    # Both sides grow with the sections, however few bytes their columns seem to have: never broadcast.
    mean = section_confidence(spans, ["doc_id", "section_no"]).hint("merge")
    asked = sections.join(mean, ["doc_id", "section_no"], "left").filter(escalate(F.col("section_type"), F.col("mean_confidence"), F.length("text"))).drop("mean_confidence")
    kinds = sections.select("doc_id", "section_no", F.col("section_type").alias("source_section")).hint("merge")
    told = model(asked).join(kinds, ["doc_id", "section_no"]).withColumns({"code": F.lit(None).cast("string"), "origin": F.lit("model")})
    return local.select(*cols).unionByName(told.select(*cols))


#: What marks an encounter as a piece of the document's frame, names of places, and words of a visit.
CHROME = ["mychart", "after visit summary", "avs", "date of visit", "todays visit", "today visit", "visit summary", "patient instructions", "clinical summary", "discharge instructions", "printed on"]
PLACES = ["group", "clinic", "hospital", "medical center", "med center", "associates", "physicians", "health system", "healthcare", "practice", "department", "institute", "gastroenterology", "cardiology", "dermatology", "orthopedics", "radiology", "oncology", "urology", "neurology", "pediatrics", "ophthalmology"]
VISIT_WORDS = ["visit", "follow", "followup", "consult", "consultation", "exam", "examination", "admission", "encounter", "appointment", "telehealth", "office", "established"]
PLACE_WORDS = 7


def plain_text(text: Column) -> Column:
    """Lower case without apostrophes; whatever else is no letter or digit is one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "['\u2019]", ""), "[^a-z0-9]+", " "))


def is_chrome(text: Column) -> Column:
    """Whether an encounter's text is the document's frame, or names a place and no visit."""
    holds = lambda plain, words: plain.rlike("|".join(words))

    def framed(plain: Column) -> Column:
        words = F.split(plain, " ")
        return holds(plain, CHROME) | ((F.size(words) <= PLACE_WORDS) & ~F.arrays_overlap(words, F.array(*map(F.lit, VISIT_WORDS))) & holds(plain, PLACES))

    return bound(plain_text(text), framed)


def visit_key(day: Column, chrome: Column, met: Column = None) -> Column:
    """What encounters of a document are one visit by; null for those that go.

    Without a dated encounter, or with one day, all are one visit. With several
    days each is one, and of those without a date the document's frame goes and
    every other stands alone.
    """
    seen = day if met is None else F.when(met, day)
    doc = Window.partitionBy("doc_id")
    several = F.coalesce(F.min(seen).over(doc) < F.max(seen).over(doc), F.lit(False))
    return F.when(~several, "").when(day.isNotNull(), day.cast("string")).when(~chrome, F.concat(F.lit("#"), F.col("pos").cast("string")))


def confirm(entities: DataFrame, facts: DataFrame | None = None, automatic: bool = True, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records of extracted entities and what refers to what: the tail of an upload.

    ``entities`` is what ``entities.to_records`` takes, with ``entity_date`` and
    a ``pos`` that is one row's in its document; ``facts`` is
    ``document_facts``, and without it they are drawn from the entities, which
    then have what that takes. Each record gets its own date or its document's.
    The automatic way also drops repeats inside a document (encounters by visit,
    drugs by code or name, others by class and text) and links records to the
    document's first encounter; the manual one leaves both to the person who
    confirms. Repeats are told by columns beside the resources, so a resource is
    built once, of a record that is kept, and where it is asked for. All is by
    document: entities that are dealt out by ``doc_id`` are not shuffled again.
    With ``store`` what is kept is written there, and references are drawn from
    that.
    """
    from wardline.functions.entities import to_records
    from wardline.operators.review import document_references

    codes = [c for c in ("code_value",) if c in entities.columns]
    if facts is None:
        rows = to_records(with_document_date(entities), carry=("entity_date", "document_date", "text", *codes), told=automatic)
    else:
        rows = to_records(entities, carry=("entity_date", "text", *codes), told=automatic).join(facts.select("doc_id", "document_date"), "doc_id", "left")
    rows = rows.withColumn("effective_date", F.coalesce("entity_date", "document_date")).withColumn("id", F.xxhash64("doc_id", "pos"))
    if automatic:
        met = F.col("record_type") == "encounter"
        has = lambda field: F.array_contains("filled", field)
        points = lambda *pairs: reduce(lambda x, p: x + F.when(p[0], p[1]).otherwise(0), pairs, F.lit(0))
        rows = rows.withColumn("_chrome", met & is_chrome(F.concat_ws(" ", "text", "visit_text")))
        worth = points((~F.col("_chrome"), 1000), (has("participant"), 100), (F.col("effective_date").isNotNull(), 50), (has("text"), 10), (has("reasonCode"), 10), (has("type"), 5), (has("serviceProvider"), 3))
        key = F.when(met, visit_key(F.to_date("effective_date"), F.col("_chrome"), met)).otherwise(entity_key(F.col("text")))
        rows = rows.withColumn("_worth", F.when(met, worth + F.size("filled"))).withColumn("_key", key).filter(~met | F.col("_key").isNotNull())
        order = Window.partitionBy("doc_id", "entity_class", "_key").orderBy(F.desc("_worth"), "pos")
        rows = rows.withColumn("_place", F.row_number().over(order)).filter("_place = 1")
        # Nothing but a drug becomes a drug, so the others need not be read to compare drugs.
        drugs = to_records(entities.filter("entity_class = 'medication'"), carry=("text", *codes), told=True, resource=False).filter("record_type = 'medication'")
        lesser = lesser_medications(first_entities(drugs))
        # It grows with the documents, however few bytes its columns seem to have: never broadcast.
        rows = rows.join(lesser.hint("merge"), "doc_id", "left")
        outdone = (F.col("record_type") == "medication") & F.array_contains("lesser", F.col("pos").cast("long"))
        rows = rows.filter(~F.coalesce(outdone, F.lit(False))).drop("lesser", "_place", "_key", "_worth", "_chrome", "filled", "visit_text")
        first = F.min(F.when(met, F.struct("pos", "id"))).over(Window.partitionBy("doc_id"))
        rows = rows.withColumn("linked_encounter_id", F.when(~met, first["id"]))
    else:
        rows = rows.withColumn("linked_encounter_id", F.lit(None).cast("long"))
    rows = rows.drop("entity_date", "document_date", "text", *codes)
    if store:
        rows.write.parquet(store)
        rows = entities.sparkSession.read.parquet(store)
    return rows, document_references(rows)


def lesser_medications(rows: DataFrame) -> DataFrame:
    """(doc_id, lesser): the places of the drug records of a document that another one of the same drug outdoes, which ``best_medications`` leaves out.

    ``rows`` has doc_id, pos, text, the names of the resource's fields
    (``filled``) and, where there are codes, code_value. Documents of one drug
    are left out.
    """
    code = F.col("code_value") if "code_value" in rows.columns else F.lit(None).cast("string")
    score = F.size("filled") + F.when(F.array_contains("filled", "dosageInstruction"), 10).otherwise(0) + F.when(code.isNotNull(), 100).otherwise(0)
    one = F.struct(F.col("pos").cast("long").alias("pos"), plain_text(F.col("text")).alias("name"), score.cast("double").alias("score"), code.alias("code"))
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("drugs")).filter("size(drugs) > 1")
    fold = _drug_fold(losers=True)
    return lists.select("doc_id", fold("drugs.pos", "drugs.name", "drugs.score", "drugs.code").alias("lesser"))


def entity_key(text: Column) -> Column:
    """Entity text without parenthesised groups and dates, in lower case."""
    x = F.regexp_replace(text, r"\([^)]*\)|\[[^\]]*\]", " ")
    x = F.regexp_replace(x, r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}[/-]\d{4}|(?:19|20)\d{2}-\d{1,2}-\d{1,2}|(?:19|20)\d{2})\b", " ")
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def first_entities(entities: DataFrame) -> DataFrame:
    """The first of each (doc_id, entity_class, key) by pos."""
    order = Window.partitionBy("doc_id", "entity_class", entity_key(F.col("text"))).orderBy("pos")
    return entities.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")


def best_encounters(encounters: DataFrame) -> DataFrame:
    """One encounter per document and visit (``visit_key``): the most informative, then the earliest.

    ``encounters`` has doc_id, pos, effective_date, provider, boilerplate and n_fields.
    """
    score = F.when(F.col("boilerplate"), 0).otherwise(1000) + F.when(F.col("provider").isNotNull(), 100).otherwise(0) + F.when(F.col("effective_date").isNotNull(), 50).otherwise(0) + F.col("n_fields")
    rows = encounters.withColumn("score", score).withColumn("_key", visit_key(F.to_date("effective_date"), F.col("boilerplate"))).filter("_key IS NOT NULL")
    order = Window.partitionBy("doc_id", "_key").orderBy(F.desc("score"), "pos")
    return rows.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place", "_key")


def best_medications(meds: DataFrame, alike: float = 90.0, sorted_alike: float = 80.0, length_floor: float = 0.6) -> DataFrame:
    """One row per drug of a document: coded ones by code in a window, the others by name.

    Names are walked in order: one that is like the name of a drug kept so far
    is that drug, and the better record of both (then the earlier) stays. The
    walk is a fold over the names of a document; documents of a batch go to
    Python together. ``pos`` is one row's in its document.
    """
    score = F.when(F.col("code_value").isNotNull(), 100).otherwise(0) + F.col("n_fields")
    order = Window.partitionBy("doc_id", "code_value").orderBy(F.desc("score"), "pos")
    scored = meds.withColumn("score", score)
    coded = scored.filter("code_value IS NOT NULL").withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")
    uncoded = scored.filter("code_value IS NULL")
    names = uncoded.select("doc_id", F.col("pos").cast("long").alias("pos"), plain_text(F.col("text")).alias("name"), F.col("score").cast("double").alias("score"))
    lists = names.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "score"))).alias("drugs"))
    fold = _drug_fold(alike, sorted_alike, length_floor)
    none = F.transform("drugs", lambda d: F.lit(None).cast("string"))
    stays = lists.select("doc_id", F.explode(fold("drugs.pos", "drugs.name", "drugs.score", none)).alias("_stays"))
    left = uncoded.join(stays, (uncoded["doc_id"] == stays["doc_id"]) & (uncoded["pos"] == stays["_stays"]), "left_semi")
    return coded.unionByName(left)


@lru_cache(maxsize=100_000)
def same_drug(a: str, b: str, alike: float, sorted_alike: float, length_floor: float) -> bool:
    from wardline.functions.similarity import token_set_ratio, token_sort_ratio

    if not a or not b or a == b:
        return bool(a) and a == b
    short, long = sorted((len(a), len(b)))
    return short / long >= length_floor and token_set_ratio(a, b) >= alike and token_sort_ratio(a, b) >= sorted_alike


def _drug_fold(alike: float = 90.0, sorted_alike: float = 80.0, length_floor: float = 0.6, losers: bool = False):
    """Of the drugs of each document, in order: the places of those that stay, or of the others. Coded drugs are one by code, others by name."""

    def walk(rows: list[tuple]) -> list[tuple]:
        left: list[tuple] = []
        known: dict[str, int] = {}
        for row in rows:
            if row[3] is not None:
                i = known.setdefault(row[3], len(left))
                i = None if i == len(left) else i
            else:
                i = next((i for i, s in enumerate(left) if s[3] is None and same_drug(s[1], row[1], alike, sorted_alike, length_floor)), None)
            if i is None:
                left.append(row)
            elif row[2] > left[i][2]:
                left[i] = row
        return left

    @F.pandas_udf("array<long>")
    def fold(places: pd.Series, names: pd.Series, scores: pd.Series, codes: pd.Series) -> pd.Series:
        out = []
        for doc in zip(places, names, scores, codes, strict=True):
            rows = list(zip(*doc, strict=True))
            stay = {int(r[0]) for r in walk(rows)}
            out.append([int(r[0]) for r in rows if (int(r[0]) in stay) != losers])
        return pd.Series(out)

    return fold


def precision_recall(predicted: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 (4 places) of boolean predictions against boolean truths on one id, overall or by columns."""
    rows = truth.join(predicted, "id")
    g = rows.groupBy(*(by or [])).agg(F.count_if(F.col("predicted") & F.col("actual")).alias("tp"), F.count_if(F.col("predicted") & ~F.col("actual")).alias("fp"), F.count_if(~F.col("predicted") & F.col("actual")).alias("fn"))
    share = lambda a, b: F.when(b > 0, F.bround(a / b, 4)).otherwise(F.lit(0.0))
    g = g.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return g.withColumn("f1", share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
