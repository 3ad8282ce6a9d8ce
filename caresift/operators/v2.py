"""Inspection of HL7 v2 messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caresift.functions import hl7
from caresift.operators.findings import AD, FINDING, RS, TC, TN, finding, gather, nothing, reports

#: OBX-2 types of measured numbers.
NUMERIC = ("NM", "NA", "SN", "NR")


def _obr(f: Column, own: Column) -> Column:
    start, end, text = hl7.field(f, 7), hl7.field(f, 8), hl7.degraded_text(hl7.field(f, 4))
    where = F.concat(F.lit("OBR/"), own)
    return gather(
        ((start != "") & (end != "") & (start != end), finding("TC-OBR-01", TC, "warning", where, F.concat(F.lit("interval "), start, F.lit(" to "), end, F.lit(" becomes one point in time")))),
        (text.isNotNull(), finding("TN-CE-01", TN, "warning", where, F.concat(F.lit("OBR-4 has text without code and system: "), F.left(text, F.lit(50))))),
    )


def _obx(f: Column, obr: Column) -> Column:
    number = F.coalesce(F.get(f, F.lit(1)), F.lit("?"))
    where = F.concat(F.lit("OBX/"), F.when(F.coalesce(obr, F.lit("")) == "", F.lit("?")).otherwise(obr), F.lit(".OBX"), number)
    kind, text = F.upper(hl7.strip(hl7.field(f, 2))), hl7.degraded_text(hl7.field(f, 3))
    return gather(
        (text.isNotNull(), finding("TN-CE-01", TN, "warning", where, F.concat(F.lit("OBX-3 has text without code and system: "), F.left(text, F.lit(50))))),
        (kind.isin(*NUMERIC) & (hl7.field(f, 15) == "") & (hl7.field(f, 16) == ""), finding("AD-OBX-01", AD, "critical", where, F.concat(kind, F.lit(" value without producer and observer")))),
    )


def _orc(f: Column) -> Column:
    order = hl7.strip(hl7.field(f, 2))
    return gather((order != "", finding("RS-ORC-01", RS, "critical", F.concat(F.lit("ORC/"), order), F.lit("placer order refers to another system"))))


def _pv1(f: Column) -> Column:
    visit = hl7.field(f, 19)
    return gather((visit != "", finding("RS-PV1-19", RS, "warning", F.concat(F.lit("PV1/"), visit), F.lit("visit number without an encounter in the target"))))


def _rxa(f: Column) -> Column:
    return gather(((hl7.field(f, 6) == "") | (hl7.field(f, 7) == ""), finding("AD-RXA-67", AD, "critical", F.lit("RXA"), F.lit("dose or unit is missing"))))


def findings(segs: Column) -> Column:
    """All findings of a message's segments, in segment order, then rule order.  OBX rows know the last OBR before them.

    Segments that no rule reads are left out first, as every step copies what was found before.
    """

    def step(state: Column, seg: Column) -> Column:
        f, kind = seg["fields"], seg["type"]
        own = F.coalesce(F.get(f, F.lit(2)), F.lit("?"))
        found = F.when(kind == "OBX", _obx(f, state["obr"])).when(kind == "OBR", _obr(f, own)).when(kind == "ORC", _orc(f)).when(kind == "PV1", _pv1(f)).when(kind == "RXA", _rxa(f)).otherwise(nothing())
        return F.struct(F.when(kind == "OBR", own).otherwise(state["obr"]).alias("obr"), F.concat(state["found"], found).alias("found"))

    start = F.struct(F.lit(None).cast("string").alias("obr"), nothing().alias("found"))
    return F.aggregate(F.filter(segs, lambda s: s["type"].isin("OBX", "OBR", "ORC", "PV1", "RXA")), start, step, lambda state: state["found"])


def inspect(msgs: DataFrame, text: str = "text") -> DataFrame:
    """``msgs`` with message_type, control_id, tenant_id, total_segments, findings and the report columns.

    A null text has no segments and no findings.
    """
    parsed = hl7.computed_once(msgs, {"__segs": hl7.segments(F.col(text))})
    named = hl7.computed_once(parsed, {"message_type": hl7.message_type(F.col("__segs")), "control_id": hl7.control_id(F.col("__segs")), "tenant_id": hl7.tenant(F.coalesce(F.col(text), F.lit(""))), "total_segments": F.size("__segs"), "findings": findings(F.col("__segs")).cast(f"array<{FINDING}>")})
    return reports(named.drop("__segs"))
