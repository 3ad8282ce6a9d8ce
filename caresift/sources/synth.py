"""Clinical messages derived from the relational tables by integer arithmetic, so that SQL can tell what is in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caresift.sources.files import tasks

#: Jobs that need a "now" take this one.
AS_OF = "2024-02-15 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _join(sep: str, *parts):
    return F.concat_ws(sep, *[F.lit(p) if isinstance(p, str) else p for p in parts])


def oru_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """receipt_id, received_ts, text: an order is a message, its lines are OBX segments."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    obx3 = F.when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("^part "), part, F.lit("^"))).otherwise(F.concat(part, F.lit("^part^LN")))
    kind = F.when(F.col("l_partkey") % 2 == 0, "NM").otherwise("ST")
    producer = F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(supp)
    obx = _join("|", "OBX", F.col("l_linenumber").cast("string"), kind, obx3, "", F.col("l_quantity").cast("int").cast("string"), "", "", "", "", "", "F", "", "", "", producer, "")
    said = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", obx.alias("obx")).alias("line"))
    grouped = said.groupBy("o_orderkey").agg(F.array_sort(F.collect_list("line")).alias("__lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    key, cust, day = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyyMMdd")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 9 == 0, "ORM^O01").otherwise("ORU^R01")
    msh = _join("|", "MSH", "^~\\&", F.concat(F.lit("APP"), (c % 5).cast("string")), F.concat(F.lit("FAC"), (c % 2).cast("string")), "HUB", "HUB", day, "", kind, F.concat(F.lit("M"), key), "P", "2.5")
    pid = _join("|", "PID", "1", "", F.concat(F.lit("P"), cust, F.lit("^^^HOSP^MR")))
    pv1 = F.concat(F.lit("PV1|1|I|W1^R1^B1"), F.repeat(F.lit("|"), 16), F.when(c % 3 == 0, F.concat(F.lit("V"), cust)).otherwise(""))
    orc = _join("|", "ORC", "RE", F.when(k % 4 == 0, " ").otherwise(key))
    obr4 = F.when(c % 6 == 0, "^panel^").otherwise("24323-8^panel^LN")
    obr = _join("|", "OBR", "1", key, "", obr4, "", "", F.concat(day, F.lit("0800")), F.when(k % 5 == 0, F.concat(day, F.lit("0900"))).otherwise(F.concat(day, F.lit("0800"))))
    rxa = F.when(k % 10 == 0, F.concat(F.lit("RXA|0|1|20240101|20240101|CVX|"), F.when(k % 20 == 0, "").otherwise("5"), F.lit("|ml\r"))).otherwise("")
    body = F.coalesce(F.array_join(F.transform("__lines", lambda x: x["obx"]), "\r"), F.lit(""))
    text = F.concat(msh, F.lit("\r"), pid, F.lit("\r"), pv1, F.lit("\r"), orc, F.lit("\r"), rxa, obr, F.lit("\r"), body, F.lit("\r"))
    return orders.join(grouped, "o_orderkey", "left").select(k.alias("receipt_id"), F.col("o_orderdate").cast("timestamp").alias("received_ts"), text.alias("text"))


def adt_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """receipt_id, received_ts, text: the events of a user on a day are one patient's stay of A01, A02 ..., A03."""
    return _adt(spark, sf_dir, False)


def adt_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as a patient's messages of all kinds, with retro events, repeats and blanks."""
    return _adt(spark, sf_dir, True)


def _adt(spark: SparkSession, sf_dir: str, full: bool) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"), "user_id", "event_type")
    day = F.date_format("ts", "yyyyMMdd")
    patient = F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("") if full else F.concat(F.lit("D"), day))
    e = e.withColumn("patient", patient)
    order = Window.partitionBy("patient").orderBy("ts", "event_id")
    e = e.withColumns({"n": F.row_number().over(order), "last": F.lead("event_id").over(order).isNull(), "before": F.lag("event_id").over(order), "before_ts": F.lag("ts").over(order), "before_type": F.lag("event_type").over(order)})
    if full:
        named = {"click": "A02", "purchase": "A01", "error": "A12", "signup": "A03", "view": "A04"}
        kind = lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in named.items()])
        trigger, target = kind(F.col("event_type")), kind(F.col("before_type"))
        trigger = F.when(F.col("event_id") % 17 == 0, "A08").when((trigger == "A12") & (F.col("event_id") % 3 == 0), "A11").when((trigger == "A12") & (F.col("event_id") % 3 == 1), "A13").otherwise(trigger)
    else:
        trigger = F.when(F.col("n") == 1, "A01").when(F.col("last"), "A03").otherwise("A02")
        target = F.lit("A01")
    stamp = lambda c: F.date_format(c, "yyyyMMddHHmmss")
    number = lambda c: F.concat(F.lit("E"), c.cast("string"))
    moved = F.when(F.col("event_id") % 23 == 0, "").otherwise(stamp(F.col("ts"))) if full else stamp(F.col("ts"))
    ward = F.concat(F.lit("W"), (F.col("event_id") % 5).cast("string"), F.lit("^R1^B"), (F.col("event_id") % 3).cast("string"))
    msh = _join("|", "MSH", "^~\\&", "ADTAPP", "HOSP", "HUB", "HUB", stamp(F.col("ts")), "", F.concat(F.lit("ADT^"), trigger), number(F.col("event_id")), "P", "2.5")
    evn = _join("|", "EVN", trigger, stamp(F.col("ts")), "", "", "", moved)
    pid = _join("|", "PID", "1", "", F.concat(F.col("patient"), F.lit("^^^HOSP^MR")))
    pv1 = _join("|", "PV1", "1", F.when(F.col("event_id") % 4 == 0, "O").otherwise("I"), ward)
    zbe = _join("|", "ZBE", "", moved)
    text = F.concat_ws("\r", msh, evn, pid, pv1, zbe)
    if full:
        action = F.when(trigger == "A08", "UPDATES").otherwise("CANCELS")
        zst = _join("|", "ZST", action, number(F.col("before")), F.concat(F.lit("ADT^"), target), stamp(F.col("before_ts")))
        text = F.when(trigger.isin("A08", "A11", "A12", "A13") & F.col("before").isNotNull(), F.concat_ws("\r", text, zst)).otherwise(text)
    return e.select(F.col("event_id").alias("receipt_id"), F.col("ts").alias("received_ts"), text.alias("text"))


#: Short histories, one a patient: (trigger, seconds of the movement or None, seconds of arrival, reference) for each message,
#: where a reference is (action, message it means, its type, seconds it says).
_STAY = [("A01", 0, 0, None), ("A02", 3600, 3600, None), ("A03", 7200, 7230, None)]
HISTORIES = [
    [*_STAY, ("A11", 10800, 10800, ("CANCELS", 0, "A01", 0))],
    [*_STAY, ("A12", 10800, 10800, ("CANCELS", 1, "A02", 3600))],
    [*_STAY, ("A13", 10800, 10800, ("CANCELS", 2, "A03", 7200))],
    [*_STAY, ("A08", -600, 10800, ("UPDATES", 0, "A01", 0))],
    [*_STAY, ("A08", 1800, 10800, ("UPDATES", 1, "A02", 3600))],
    [*_STAY, ("A08", 9000, 10800, ("UPDATES", 2, "A03", 7200))],
    [*_STAY, ("A02", 1800, 10800, None)],
    [*_STAY, ("A02", 3600, 10800, None)],
    [*_STAY, ("A02", 9000, 10800, None)],
    [("A01", 0, 0, None), ("A12", 5400, 5400, ("CANCELS", 2, "A02", 7200)), ("A02", 7200, 9000, None)],
    [("A01", 0, 0, None), ("A11", 3600, 3600, ("CANCELS", 9, "A01", 0))],
    [("A04", 0, 0, None), ("A01", 3600, 3600, None)],
    [("A04", 0, 0, None)],
    [("A01", 0, 0, None), ("A11", 3600, 3600, None)],
    [("A01", 0, 0, None), ("A11", 3600, 3600, ("UPDATES", 0, "A01", 0))],
    [("A01", 0, 0, None), ("A12", 3600, 3600, ("CANCELS", 0, "A01", 0))],
    [("A01", 0, 0, None), ("A11", 3600, 3600, ("CANCELS", 0, "A01", None))],
    [("A03", 0, 0, None)],
    [("A01", 0, 0, None), ("A02", None, 1800, None), ("A02", 3600, 3600, None)],
    [("A01", 0, 0, None), ("A02", None, 1200, None), ("A02", None, 2400, None), ("A02", 3600, 3600, None)],
    [("A01", 0, 0, None), ("A02", None, 1800, None)],
    [("A04", 0, 0, None), ("A01", 28800, 28800, None), ("A02", 32400, 32400, None)],
    [("A01", 0, 0, None)],  # without a patient
    [("A01", 0, 0, None), ("A11", 3600, 3600, ("CANCELS", 0, "A01", 0)), ("A11", 7200, 7200, ("CANCELS", 0, "A01", 0))],
    [("A01", 0, 0, None), ("A02", 0, 3600, None), ("A03", 3600, 7200, None)],
    [("A01", 0, 0, None), ("A01", 28800, 28800, None)],  # two visits at once
]
LONELY = 22  #: the history whose messages name no patient


DAY = 86_400
#: Histories whose messages come in two parts: what a first run sees arrived within half a day, the rest days later.
LATE_HISTORIES = [
    [("A01", 0, 0, None), ("A02", None, 1800, None), ("A02", 3600, 3600, None)],
    [("A01", 0, 0, None), ("A02", None, 1800, None), ("A02", 3600, 3600, None), ("A12", DAY, DAY, ("CANCELS", 2, "A02", 3600))],
    [("A01", 0, 0, None), ("A02", None, 1800, None), ("A02", 3600, 3600, None), ("A08", 5400, DAY, ("UPDATES", 2, "A02", 3600))],
    [("A01", 0, 0, None), ("A02", None, 1800, None), ("A02", 7200, DAY, None)],
    [("A01", 0, 0, None), ("A02", None, 1800, None), ("A02", 3600, 3600, None), ("A11", DAY, DAY, ("CANCELS", 0, "A01", 0))],
    [("A01", 0, 0, None), ("A02", None, 1800, None), ("A02", 3600, 3600, None), ("A12", DAY, DAY, ("CANCELS", 2, "A02", 3600)), ("A03", DAY + 3600, DAY + 3600, None)],
    [("A04", 0, 0, None), ("A02", None, 1800, None), ("A01", 3600, 3600, None)],
    [("A01", 0, 0, None), ("A02", None, 1200, None), ("A02", 3600, 3600, None), ("A02", None, 5000, None), ("A02", 7200, 7200, None), ("A12", DAY, DAY, ("CANCELS", 2, "A02", 3600))],
    [("A01", 0, 0, None), ("A12", 3600, 3600, ("CANCELS", 2, "A02", 5400)), ("A02", 5400, 9 * DAY, None)],
    [("A04", 0, 0, None), ("A03", 2 * DAY, 2 * DAY, None)],
    [("A04", 0, 0, None), ("A01", 21000, 21000, None)],
    [("A01", 0, 0, None), ("A11", 3600, 3600, ("CANCELS", 9, "A01", 0))],
    [("A01", 0, 0, None), ("A02", None, 1800, None), ("A02", 3600, 3600, None)],  # messages that name two patients
    [("A01", 0, 0, None)],  # an identifier that can't be read
]
#: How PID-3 of some of them differs, after the patient's name and with it.
LATE_IDS = {12: ("^^^HOSP^MR~T", "^^^HOSP^MR"), 13: ("^^^HOSP^PI", None)}
HALF_DAY = DAY // 2


def adt_histories(spark: SparkSession, sf_dir: str, scripts: list = HISTORIES, arrived: int | None = None, since: int | None = None) -> DataFrame:
    """receipt_id, received_ts, text: each event is the patient ``S<event_id>`` with history number event_id mod their count.

    ``arrived``: only what arrived in so many seconds of each history; ``since``: only what arrived later than that.
    """
    from itertools import chain

    e = table(spark, sf_dir, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("t"))
    e = e.repartition(tasks(spark), "event_id")  # before a few bytes become long messages: a small file is one task
    kind = "array<struct<i:int,trigger:string,at:int,arrival:int,action:string,of:int,kind:string,said:int>>"
    none = (None, None, None, None)
    arrays = [F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("i", "trigger", "at", "arrival", "action", "of", "kind", "said"), (i, g, at, arrival, *(ref or none)), strict=True)]) for i, (g, at, arrival, ref) in enumerate(h)]).cast(kind) for h in scripts]
    own = F.element_at(F.create_map(*chain.from_iterable((F.lit(n), x) for n, x in enumerate(arrays))), F.col("history"))
    rows = e.withColumn("history", (F.col("event_id") % len(scripts)).cast("int")).select("event_id", "t", "history", F.explode(own).alias("m"))
    rows = rows if arrived is None else rows.where(F.col("m.arrival") < arrived)
    rows = rows if since is None else rows.where(F.col("m.arrival") >= since)
    stamp = lambda seconds: F.coalesce(F.date_format(F.timestamp_seconds(F.unix_timestamp("t") + seconds), "yyyyMMddHHmmss"), F.lit(""))
    name, i = F.col("event_id").cast("string"), F.col("m.i")
    number = lambda n: F.concat(F.lit("S"), name, F.lit("-"), n.cast("string"))
    place = F.concat(F.lit("W"), ((F.col("event_id") + i) % 4).cast("string"), F.lit("^R"), i.cast("string"), F.lit("^B"), (F.col("event_id") % 3).cast("string"))
    msh = _join("|", "MSH", "^~\\&", "ADTAPP", "HOSP", "HUB", "HUB", stamp(F.col("m.arrival")), "", F.concat(F.lit("ADT^"), F.col("m.trigger")), number(i), "P", "2.5")
    evn = _join("|", "EVN", F.col("m.trigger"), stamp(F.col("m.arrival")), "", "", "", stamp(F.col("m.at")))
    own = F.concat(F.lit("S"), name, F.lit("^^^HOSP^MR"))
    if scripts is LATE_HISTORIES:
        for n, (more, end) in LATE_IDS.items():
            own = F.when(F.col("history") == n, F.concat(F.lit("S"), name, F.lit(more), *([name, F.lit(end)] if end else []))).otherwise(own)
    pid = _join("|", "PID", "1", "", F.when(F.col("history") == LONELY, "").otherwise(own))
    pv1 = F.concat(F.lit("PV1|1|I|"), place, F.repeat(F.lit("|"), 16), F.when(F.col("history") < 12, F.concat(F.lit("V"), name)).when(F.col("history") == 25, F.concat(F.lit("V"), number(i))).otherwise(""))
    zbe = _join("|", "ZBE", "", stamp(F.col("m.at")))
    zst = F.when(F.col("m.action").isNotNull(), _join("|", "ZST", F.col("m.action"), number(F.col("m.of")), F.concat(F.lit("ADT^"), F.col("m.kind")), stamp(F.col("m.said"))))
    text = F.concat_ws("\r", msh, evn, pid, pv1, zbe, zst)
    return rows.select((F.col("event_id") * 10 + i).cast("long").alias("receipt_id"), F.timestamp_seconds(F.unix_timestamp("t") + F.col("m.arrival")).alias("received_ts"), text.alias("text"))


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bundle_key, text: a customer's Patient, and an Observation, Condition, Procedure, MedicationRequest and
    MedicationAdministration of each of the customer's orders, as FHIR JSON."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    k, c = F.col("k"), F.col("c")
    name = k.cast("string")
    ref = lambda bad: F.struct(F.when(bad, F.concat(F.lit("Patient/x"), name)).otherwise(F.concat(F.lit("Patient/"), c.cast("string"))).alias("reference"))
    coding = lambda system, code, show: F.array(F.struct(F.lit(system).alias("system"), F.lit(code).alias("code"), F.lit(show).alias("display")))
    concept = lambda gone, value, text: F.struct(F.when(~gone, value).alias("coding"), F.when(gone, F.lit(text)).alias("text"))
    lab = F.array(F.struct(coding("http://terminology.hl7.org/CodeSystem/observation-category", "laboratory", "lab").alias("coding")))
    entry = lambda **f: F.to_json(F.struct(F.struct(*[v.alias(n) for n, v in f.items()]).alias("resource")))
    resources = F.array(
        entry(resourceType=F.lit("Observation"), id=name, code=concept(k % 7 == 0, coding("http://loinc.org", "718-7", "hemoglobin"), "free text"), category=F.when(k % 2 == 0, lab), subject=ref(k % 5 == 0), basedOn=F.when(k % 4 == 0, F.array(ref(F.lit(False)))), valueQuantity=F.when(k % 3 != 0, F.struct(F.lit(1.5).alias("value"), F.lit(UCUM).alias("system")))),
        entry(resourceType=F.lit("Condition"), id=name, code=concept(F.lit(False), coding("http://fhir.de/CodeSystem/bfarm/icd-10-gm", "E11", "x"), ""), subject=ref(k % 11 == 0)),
        entry(resourceType=F.lit("Procedure"), id=name, code=concept(F.lit(False), F.when(k % 10 == 0, coding("http://snomed.info/sct", "386473003", "x")).otherwise(coding("http://snomed.info/sct", "1", "x")), ""), performedDateTime=F.when(k % 6 != 0, F.lit("2024-01-01"))),
        entry(resourceType=F.lit("MedicationRequest"), id=name, dosageInstruction=F.array(F.struct(F.struct(F.struct(F.lit(2).alias("frequency")).alias("repeat"), F.when(k % 8 == 0, F.array(F.lit("2024-01-01"))).alias("event")).alias("timing")))),
        entry(resourceType=F.lit("MedicationAdministration"), id=name, dosage=F.when(k % 9 != 0, F.struct(F.lit("5 mg").alias("text")))),
    )
    grouped = o.select("c", F.explode(resources).alias("e")).groupBy("c").agg(F.array_sort(F.collect_list("e")).alias("entries"))
    patient = entry(resourceType=F.lit("Patient"), id=c.cast("string"), identifier=F.when(c % 2 == 0, F.array(F.struct(F.lit("http://fhir.de/sid/gkv/kvid-10").alias("system")))))
    text = F.concat(F.lit('{"resourceType":"Bundle","type":"transaction","id":"B'), c.cast("string"), F.lit('","entry":['), F.concat_ws(",", patient, F.array_join("entries", ",")), F.lit("]}"))
    return grouped.select(c.alias("bundle_key"), text.alias("text"))


def rare_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bundle_key, text: a customer's Patient, Observation, Condition and MedicationAdministration with what ``bundles`` never has:
    intervals and means at a point in time, own code systems, contained references, body sites, certainty, units and drugs."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"))
    k = F.col("c")
    name = lambda p: F.concat(F.lit(p), k.cast("string"))
    coding = lambda system, code, show: F.array(F.struct(system.alias("system"), F.lit(code).alias("code"), show.alias("display")))
    own, loinc = F.lit("http://example.org/own"), F.lit("http://loinc.org")
    entry = lambda **f: F.to_json(F.struct(F.struct(*[v.alias(n) for n, v in f.items()]).alias("resource")))
    kind = F.array(F.struct(F.lit("http://terminology.hl7.org/CodeSystem/observation-category").alias("system"), F.when(k % 2 == 0, "procedure").otherwise("exam").alias("code")))
    unit = F.when(k % 7 < 3, F.lit(UCUM)).when(k % 7 < 5, F.lit("http://example.org/units"))
    sites = F.array_compact(F.array(F.when(k % 4 == 1, F.struct(F.lit(None).cast("array<struct<system:string,code:string,display:string>>").alias("coding"), F.lit("arm").alias("text"))), F.when(k % 6 == 0, F.struct(coding(own, "17", F.lit("leg")).alias("coding"), F.lit("leg").alias("text")))))
    resources = F.concat_ws(
        ",",
        entry(resourceType=F.lit("Patient"), id=name("p"), identifier=F.when(k % 2 == 0, F.array(F.struct(F.lit("http://fhir.de/sid/gkv/kvid-10").alias("system"))))),
        entry(resourceType=F.lit("Observation"), id=name("a"), code=F.struct(coding(F.when(k % 5 == 0, own).otherwise(loinc), "1", F.when(k % 3 == 0, "Average pressure").otherwise("pressure")).alias("coding")), category=F.array(F.struct(kind.alias("coding"))), effectiveDateTime=F.lit("2024-01-01"), subject=F.struct(F.lit("#p1").alias("reference")), contained=F.when(k % 4 != 0, F.array(F.struct(F.lit("p1").alias("id")))), valueQuantity=F.struct(F.lit(1.5).alias("value"), unit.alias("system"))),
        entry(resourceType=F.lit("Condition"), id=name("b"), code=F.struct(coding(F.lit("http://fhir.de/CodeSystem/bfarm/icd-10-gm"), "E11", F.lit("x")).alias("coding")), extension=F.when(k % 3 == 0, F.array(F.struct(F.lit("http://fhir.de/StructureDefinition/icd-10-gm-diagnosesicherheit").alias("url")))), bodySite=sites, encounter=F.when(k % 9 == 0, F.struct(F.lit("Encounter/none").alias("reference"))), subject=F.struct(F.concat(F.lit("Patient/p"), k.cast("string")).alias("reference"))),
        entry(resourceType=F.lit("MedicationAdministration"), id=name("m"), medicationCodeableConcept=F.struct(coding(F.when(k % 2 == 0, F.lit("http://fhir.de/CodeSystem/ifa/pzn")).otherwise(F.lit("http://www.whocc.no/atc")), "N02", F.lit("x")).alias("coding")), dosage=F.struct(F.lit("5 mg").alias("text"))),
    )
    text = F.concat(F.lit('{"resourceType":"Bundle","type":"collection","id":"R'), k.cast("string"), F.lit('","entry":['), resources, F.lit("]}"))
    return c.select(k.alias("bundle_key"), text.alias("text"))


UCUM = "http://unitsofmeasure.org"
