import json

from caresift.operators import fhir

LAB = [{"coding": [{"system": "s", "code": "laboratory"}]}]
LOINC = {"coding": [{"system": "http://loinc.org", "code": "1", "display": "x"}]}


def findings(spark, *resources, german=False, **more):
    text = json.dumps({"resourceType": "Bundle", "type": "batch", "entry": [{"resource": r} | more for r in resources]})
    rows = fhir.inspect(fhir.parse(spark.createDataFrame([(text,)], "text string"))[0], german).collect()
    return [(f["rule_id"], f["severity"], f["location"]) for f in rows[0]["findings"]]


def observation(**more):
    return {"resourceType": "Observation", "id": "1", "code": LOINC, "valueInteger": 1} | more


def test_observations(spark):
    assert findings(spark, observation()) == []
    assert findings(spark, observation(effectiveDateTime="2024", category=[{"coding": [{"code": "survey"}]}])) == [("TC-CATEGORY", "warning", "Observation/1")]
    assert findings(spark, observation(effectiveDateTime="2024", effectivePeriod={"start": "2024"}, category=[{"coding": [{"code": "survey"}]}])) == []
    assert findings(spark, observation(effectiveDateTime="2024", code={"coding": [{"system": "http://loinc.org", "code": "1", "display": "Mean of x"}]})) == [("TC-AGGREGATE", "warning", "Observation/1")]
    assert findings(spark, observation(code={"text": "free"})) == [("TN-CC-01", "warning", "Observation/1")]
    assert findings(spark, observation(code={"coding": [{"system": "http://own", "code": "1"}]})) == [("TN-SYSTEM", "info", "Observation/1")]
    assert findings(spark, observation(category=LAB)) == [("RS-LAB-ORDER", "info", "Observation/1"), ("AD-LAB-METHOD", "info", "Observation/1")]
    assert findings(spark, observation(category=LAB, basedOn=[{"reference": "x"}], device={"display": "d"})) == []
    assert findings(spark, observation(valueInteger=None)) == [("AD-VAL-01", "critical", "Observation/1")]
    assert findings(spark, observation(valueInteger=None, dataAbsentReason={"text": "t"})) == []


def test_references(spark):
    lost = [("RS-BUNDLE-01", "critical", "Observation/1")]
    for reference in ("Patient/9", "#p"):
        assert findings(spark, observation(subject={"reference": reference})) == lost
    for subject in ({"reference": "http://far/Patient/9"}, {"identifier": {"value": "9"}}, {}, None):
        assert findings(spark, observation(subject=subject)) == []
    assert findings(spark, observation(subject={"reference": "#p"}, contained=[{"id": "p"}])) == []
    assert findings(spark, observation(subject={"reference": "Observation/1"})) == []
    assert findings(spark, observation(encounter={"reference": "Encounter/1"})) == lost


def test_other_resources(spark):
    condition = {"resourceType": "Condition", "id": "2", "code": LOINC, "bodySite": [{"text": "arm"}, LOINC, {"coding": [{"system": "own", "code": "1"}]}]}
    assert findings(spark, condition) == [("TN-CC-01", "warning", "Condition/2"), ("TN-SYSTEM", "info", "Condition/2")]
    assert findings(spark, {"resourceType": "Procedure", "performedDateTime": "2024"}) == [("TC-PROCEDURE", "warning", "Procedure/?")]
    assert findings(spark, {"resourceType": "Procedure", "id": "3", "performedDateTime": "2024", "code": {"coding": [{"code": "182777000"}]}}) == [("TC-PROCEDURE", "critical", "Procedure/3")]
    doses = [{"timing": {"repeat": {"frequency": 1}}}, {"timing": {"repeat": {"frequency": 1}, "event": ["2024"]}}, {"timing": {"repeat": {}}}]
    assert findings(spark, {"resourceType": "MedicationRequest", "id": "4", "dosageInstruction": doses}) == [("TC-PERIOD-01", "warning", "MedicationRequest/4")]
    assert findings(spark, {"resourceType": "MedicationAdministration", "id": "5"}) == [("AD-DOSAGE", "critical", "MedicationAdministration/5")]


def test_german_pack(spark):
    icd = {"coding": [{"system": "http://fhir.de/CodeSystem/bfarm/icd-10-gm", "code": "E11"}]}
    assert findings(spark, {"resourceType": "Condition", "id": "1", "code": icd}, german=True) == [("DE-CERTAINTY", "warning", "Condition/1")]
    certain = [{"url": "http://fhir.de/StructureDefinition/icd-10-gm-diagnosesicherheit"}]
    assert findings(spark, {"resourceType": "Condition", "id": "1", "code": icd, "extension": certain}, german=True) == []
    for unit, rules in (({"value": 1}, ["DE-UCUM"]), ({"value": 1, "system": "own"}, ["DE-UCUM"]), ({"value": 1, "system": "http://unitsofmeasure.org"}, [])):
        assert [f[0] for f in findings(spark, observation(valueInteger=None, valueQuantity=unit), german=True)] == rules
    drug = lambda system: {"resourceType": "MedicationAdministration", "id": "6", "dosage": {"text": "x"}, "medicationCodeableConcept": {"coding": [{"system": system, "code": "1"}]}}
    assert [f[0] for f in findings(spark, drug("own"), german=True)] == ["DE-ATC"] and findings(spark, drug("http://www.whocc.no/atc"), german=True) == []
    assert [f[0] for f in findings(spark, {"resourceType": "Patient", "id": "7"}, german=True)] == ["DE-KVID"]


def test_rejected(spark):
    texts = [None, "", "  ", "no JSON", "[]", '{"resourceType":"Patient"}', '{"resourceType":null}', '{"resourceType":"Bundle"}', '{"resourceType":"Bundle","entry":null}']
    fits, rejected = fhir.parse(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert fits.count() == 2 and sorted(x["reason"] for x in rejected.collect()) == ["empty"] * 3 + ["not JSON with a resourceType"] * 3 + ["not a Bundle"]
    assert [x["total_losses"] for x in fhir.inspect(fits, True).collect()] == [0, 0]
