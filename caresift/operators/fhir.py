"""Inspection of FHIR R4 bundles, with an optional pack of German profile rules.

An explicit JSON null counts as an absent field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caresift.functions.hl7 import computed_once
from caresift.operators.findings import AD, FINDING, RS, TC, TN, finding, gather, nothing, reports

CODING = "array<struct<system:string,code:string,display:string>>"
CONCEPT = f"struct<coding:{CODING},text:string>"
REFERENCE = "struct<reference:string>"
VALUES = ("valueQuantity", "valueString", "valueBoolean", "valueCodeableConcept", "valueRatio", "valueInteger", "valueRange", "valueSampledData", "valueTime", "valueDateTime", "valuePeriod", "valueAttachment")
#: Only what the rules read; fields of free shape stay JSON text.
RESOURCE = (
    "struct<resourceType:string,id:string,code:" + CONCEPT + ",category:array<" + CONCEPT + ">,bodySite:array<" + CONCEPT + ">,effectiveDateTime:string,effectivePeriod:string,performedDateTime:string,performedPeriod:string,"
    f"subject:{REFERENCE},encounter:{REFERENCE},contained:array<struct<id:string>>,basedOn:string,method:string,device:string,dataAbsentReason:string,component:string,dosage:string,"
    + ",".join(f"{v}:string" for v in VALUES)
    + f",dosageInstruction:array<struct<timing:struct<repeat:string,event:string>>>,extension:array<struct<url:string>>,identifier:array<struct<system:string>>,medicationCodeableConcept:{CONCEPT},medication:struct<concept:{CONCEPT}>>"
)
BUNDLE = f"struct<resourceType:string,id:string,type:string,entry:array<struct<fullUrl:string,resource:{RESOURCE}>>>"

#: Code systems, categories, keywords and codes that the rules compare with.
SPECIFIC_SYSTEMS = (
    "http://loinc.org", "http://snomed.info/sct", "http://www.nlm.nih.gov/research/umls/rxnorm", "http://hl7.org/fhir/sid/icd-10", "http://hl7.org/fhir/sid/icd-10-cm",
    "http://fhir.de/CodeSystem/dimdi/icd-10-gm", "http://fhir.de/CodeSystem/bfarm/icd-10-gm", "http://www.whocc.no/atc",
)
INTERVAL_CATEGORIES = ("procedure", "survey")
AGGREGATE_WORDS = ("mean", "average", "avg", "durchschnitt")
GENERIC_CATEGORIES = ("laboratory", "vital-signs", "procedure", "medication", "diagnosis")
LAB_WORDS = ("hemoglobin", "troponin", "lactate", "glucose", "creatinine", "hematocrit", "erythrocyt", "leukocyt", "platelet", "hba1c", "hbg", "wbc", "rbc", "plt", "hgb", "cbc", "panel", "differential")
CONTINUOUS_PROCEDURES = ("182777000", "385763009", "386473003")
ICD10GM_SYSTEMS = ("http://fhir.de/CodeSystem/bfarm/icd-10-gm", "http://fhir.de/CodeSystem/dimdi/icd-10-gm")
CERTAINTY_EXTENSION = "http://fhir.de/StructureDefinition/icd-10-gm-diagnosesicherheit"
KVID_SYSTEMS = ("http://fhir.de/sid/gkv/kvid-10", "http://fhir.de/NamingSystem/gkv/kvid-10", "http://fhir.de/sid/pkv/kvid-10", "http://fhir.de/NamingSystem/pkv/pkvid")
ATC_SYSTEM, UCUM_SYSTEM = "http://www.whocc.no/atc", "http://unitsofmeasure.org"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _list(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _truthy(c: Column) -> Column:
    return ~_text(c).isin("", "{}", "[]", "false", "0", "null")


def _codings(concept: Column) -> Column:
    return _list(concept["coding"], CODING)


def _any_word(codings: Column, words: tuple[str, ...]) -> Column:
    return F.exists(codings, lambda c: F.lower(_text(c["display"])).rlike("|".join(words)))


def _text_only(concept: Column) -> Column:
    return (F.size(_codings(concept)) == 0) & (_text(concept["text"]) != "")


def _unknown_system(concept: Column) -> Column:
    codings = _codings(concept)
    return F.exists(codings, lambda c: _text(c["code"]) != "") & ~F.exists(codings, lambda c: _text(c["system"]).isin(*SPECIFIC_SYSTEMS))


def _narrowing(concept: Column, where: Column, name: Column) -> list[tuple[Column, Column]]:
    return [
        (F.coalesce(_text_only(concept), F.lit(False)), finding("TN-CC-01", TN, "warning", where, F.concat(name, F.lit(" has text but no coding: "), F.left(_text(concept["text"]), F.lit(50))))),
        (F.coalesce(_unknown_system(concept), F.lit(False)), finding("TN-SYSTEM", TN, "info", where, F.concat(name, F.lit(" is coded in "), F.array_join(F.array_sort(F.array_distinct(F.transform(_codings(concept), lambda c: _text(c["system"])))), ", ")))),
    ]


def addresses(entries: Column) -> Column:
    """What references can resolve to: full URLs, and Type/id where the full URL isn't a urn."""

    def own(e: Column) -> Column:
        url, kind, name = _text(e["fullUrl"]), _text(e["resource"]["resourceType"]), _text(e["resource"]["id"])
        return F.array_compact(F.array(F.when(url != "", url), F.when(~F.startswith(url, F.lit("urn:")) & (kind != "") & (name != ""), F.concat_ws("/", kind, name))))

    return F.array_distinct(F.flatten(F.transform(entries, own)))


def _severed(r: Column, known: Column, where: Column) -> list[tuple[Column, Column]]:
    out = []
    for name in ("subject", "encounter"):
        ref = _text(r[name]["reference"])
        held = F.filter(F.transform(_list(r["contained"], "array<struct<id:string>>"), lambda c: c["id"]), lambda i: i != "")
        inside = F.coalesce(F.array_contains(held, F.substring(ref, 2, 1 << 20)), F.lit(False))
        lost = F.when(ref == "", False).when(ref.rlike("^https?://"), False).when(F.startswith(ref, F.lit("#")), ~inside).otherwise(~F.coalesce(F.array_contains(known, ref), F.lit(False)))
        out.append((lost, finding("RS-BUNDLE-01", RS, "critical", where, F.concat(F.lit(f"{name} reference doesn't resolve: "), ref))))
    return out


def _observation(r: Column, known: Column, where: Column) -> Column:
    codings = _codings(r["code"])
    category = F.coalesce(F.get(F.flatten(F.transform(_list(r["category"], f"array<{CONCEPT}>"), lambda c: F.transform(_codings(c), lambda x: _text(x["code"])))), F.lit(0)), F.lit(""))
    point = r["effectiveDateTime"].isNotNull() & r["effectivePeriod"].isNull()
    interval = category.isin(*INTERVAL_CATEGORIES)
    narrowed = _text_only(r["code"]) | _unknown_system(r["code"])
    lab = category == "laboratory"
    valued = F.coalesce(*[r[v] for v in VALUES]).isNotNull()
    return gather(
        (point & interval, finding("TC-CATEGORY", TC, "warning", where, F.concat(F.lit("a point in time for category "), category))),
        (point & ~interval & _any_word(codings, AGGREGATE_WORDS), finding("TC-AGGREGATE", TC, "warning", where, F.lit("an aggregate at a point in time"))),
        *_narrowing(r["code"], where, F.lit("Observation.code")),
        (~F.coalesce(narrowed, F.lit(False)) & category.isin(*GENERIC_CATEGORIES) & _any_word(codings, LAB_WORDS), finding("TN-CATEGORY", TN, "info", where, F.concat(F.lit("generic category "), category))),
        *_severed(r, known, where),
        (lab & r["basedOn"].isNull(), finding("RS-LAB-ORDER", RS, "info", where, F.lit("laboratory value without its order"))),
        (lab & r["method"].isNull() & r["device"].isNull(), finding("AD-LAB-METHOD", AD, "info", where, F.lit("laboratory value without method and device"))),
        (~valued & ~_truthy(r["dataAbsentReason"]) & ~_truthy(r["component"]), finding("AD-VAL-01", AD, "critical", where, F.lit("neither value nor reason for its absence"))),
    )


def _procedure(r: Column, where: Column) -> Column:
    code = _text(F.get(_codings(r["code"]), F.lit(0))["code"])
    point = r["performedDateTime"].isNotNull() & r["performedPeriod"].isNull()
    long = code.isin(*CONTINUOUS_PROCEDURES)
    return gather((point & long, finding("TC-PROCEDURE", TC, "critical", where, F.lit("continuous procedure at a point in time"))), (point & ~long, finding("TC-PROCEDURE", TC, "warning", where, F.lit("procedure at a point in time"))))


def _request(r: Column, where: Column) -> Column:
    doses = F.coalesce(r["dosageInstruction"], F.array().cast("array<struct<timing:struct<repeat:string,event:string>>>"))
    made = F.transform(doses, lambda d, i: F.when(_truthy(d["timing"]["repeat"]) & _text(d["timing"]["event"]).isin("", "[]"), finding("TC-PERIOD-01", TC, "warning", where, F.concat(F.lit("dosageInstruction "), i.cast("string"), F.lit(" repeats without times")))))
    return F.array_compact(made)


def _condition(r: Column, known: Column, where: Column) -> Column:
    sites = F.transform(_list(r["bodySite"], f"array<{CONCEPT}>"), lambda c, i: gather(*_narrowing(c, where, F.concat(F.lit("Condition.bodySite "), i.cast("string")))))
    return F.concat(gather(*_severed(r, known, where), *_narrowing(r["code"], where, F.lit("Condition.code"))), F.flatten(sites))


def resource_findings(r: Column, known: Column) -> Column:
    kind = _text(r["resourceType"])
    where = F.concat_ws("/", kind, F.coalesce(r["id"], F.lit("?")))
    dosage = gather((r["dosage"].isNull(), finding("AD-DOSAGE", AD, "critical", where, F.lit("administration without dosage"))))
    return F.when(kind == "Observation", _observation(r, known, where)).when(kind == "Condition", _condition(r, known, where)).when(kind == "Procedure", _procedure(r, where)).when(kind == "MedicationRequest", _request(r, where)).when(kind == "MedicationAdministration", dosage).otherwise(nothing())


def german_findings(r: Column) -> Column:
    """Diagnostic certainty, UCUM units, ATC codes and insurance numbers."""
    kind = _text(r["resourceType"])
    where = F.concat_ws("/", kind, F.coalesce(r["id"], F.lit("?")))
    certain = F.exists(_list(r["extension"], "array<struct<url:string>>"), lambda e: _text(e["url"]) == CERTAINTY_EXTENSION)
    icd = F.exists(_codings(r["code"]), lambda c: _text(c["system"]).isin(*ICD10GM_SYSTEMS))
    unit = _text(F.get_json_object(r["valueQuantity"], "$.system"))
    drug = _codings(F.coalesce(r["medicationCodeableConcept"], r["medication"]["concept"]))
    numbers = _list(r["identifier"], "array<struct<system:string>>")
    return (
        F.when(kind == "Condition", gather((icd & ~certain, finding("DE-CERTAINTY", AD, "warning", where, F.lit("diagnosis without its certainty")))))
        .when(kind == "Observation", gather((_truthy(r["valueQuantity"]) & (unit != UCUM_SYSTEM), finding("DE-UCUM", TN, "info", where, F.concat(F.lit("unit system "), F.when(unit == "", F.lit("missing")).otherwise(unit))))))
        .when(kind == "MedicationAdministration", gather(((F.size(drug) > 0) & ~F.exists(drug, lambda c: _text(c["system"]) == ATC_SYSTEM), finding("DE-ATC", TN, "info", where, F.lit("coded drug without ATC code")))))
        .when(kind == "Patient", gather((~F.exists(numbers, lambda i: _text(i["system"]).isin(*KVID_SYSTEMS)), finding("DE-KVID", AD, "info", where, F.lit("patient without insurance number")))))
        .otherwise(nothing())
    )


def parse(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with ``bundle``, rejected rows with ``reason``): JSON whose resourceType is Bundle goes on."""
    read = computed_once(df, {"bundle": F.from_json(F.col(text), BUNDLE)})
    fits = F.coalesce(F.col("bundle.resourceType") == "Bundle", F.lit(False))
    reason = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").when(F.col("bundle.resourceType").isNull(), "not JSON with a resourceType").otherwise("not a Bundle")
    return read.where(fits), read.where(~fits).withColumn("reason", reason).drop("bundle")


def inspect(bundles: DataFrame, german: bool = False) -> DataFrame:
    """Rows of ``parse`` with message_type, control_id, total_segments, findings and the report columns."""
    rows = computed_once(bundles, {"__entries": F.coalesce(F.col("bundle.entry"), F.array().cast(f"array<struct<fullUrl:string,resource:{RESOURCE}>>"))})
    rows = computed_once(rows, {"__known": addresses(F.col("__entries"))})
    every = F.flatten(F.transform("__entries", lambda e: resource_findings(e["resource"], F.col("__known"))))
    if german:
        every = F.concat(every, F.flatten(F.transform("__entries", lambda e: german_findings(e["resource"]))))
    named = computed_once(rows, {"message_type": F.concat(F.lit("Bundle/"), F.coalesce("bundle.type", F.lit("unknown"))), "control_id": F.coalesce("bundle.id", F.lit("no-id")), "total_segments": F.size("__entries"), "findings": every.cast(f"array<{FINDING}>")})
    return reports(named.drop("__entries", "__known", "bundle"))


def dangling(bundles: DataFrame) -> DataFrame:
    """bundle_id, reference: literal relative references without a target in their bundle, as an anti-join for very large ones."""
    entries = bundles.select(F.col("bundle.id").alias("bundle_id"), F.explode("bundle.entry").alias("e"))
    refs = entries.select("bundle_id", F.explode(F.array("e.resource.subject.reference", "e.resource.encounter.reference")).alias("reference")).where("reference is not null and reference <> '' and reference not rlike '^(https?://|#)'")
    known = bundles.select(F.col("bundle.id").alias("bundle_id"), F.explode(addresses(F.col("bundle.entry"))).alias("reference"))
    return refs.join(known, ["bundle_id", "reference"], "left_anti")


def against_manifest(reported: DataFrame, manifest: DataFrame) -> DataFrame:
    """Bundles whose totals differ from the expected ones, or that are on one side only."""
    m = manifest.select("control_id", F.col("expected_total_losses").alias("want"), F.col("severities.critical").alias("want_critical"), F.col("severities.warning").alias("want_warning"), F.col("severities.info").alias("want_info"))
    rows = reported.select("control_id", "total_losses", "n_critical", "n_warning", "n_info").join(m, "control_id", "full_outer")
    same = F.col("total_losses").eqNullSafe(F.col("want")) & F.col("n_critical").eqNullSafe(F.col("want_critical")) & F.col("n_warning").eqNullSafe(F.col("want_warning")) & F.col("n_info").eqNullSafe(F.col("want_info"))
    return rows.where(~same)
