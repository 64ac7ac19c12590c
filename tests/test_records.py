"""Decision records, the assertions over them with a record that fails each, reports, output checks, identity and the budget."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docketry.operators import chunking, identity, outputs, records
from docketry.operators.nested import nest
from docketry.plans.classify import classify
from docketry.rules import identity as ir
from docketry.rules import outputs as orules

TEXTS = [
    "Sensor gateway with Cortex-A53 processor.\nWi-Fi is optional. Secure boot is supported.\nNo AI accelerator is included in the export configuration.", "A SmartNIC with Ethernet and MACsec and TLS offload.", "A cable.", None,
]


@pytest.fixture(scope="module")
def made(spark):
    """Records with memos of TEXTS; the third and fourth have nothing to decide."""
    docs = spark.createDataFrame([(i, t, "ai_accelerator" if i == 0 else None, f"T{i}", None) for i, t in enumerate(TEXTS)], "doc_id long, text string, backend string, title string, file_name string")
    c = classify(docs)
    facts = spark.createDataFrame(
        [(0, 1, "part_number", "SX1", None, "part SX1", "x", "high"), (0, 2, "Part-Number", "sx1 ", None, "again SX1", "x", "low"), (0, 3, "manufacturer", "Maker", None, "by Maker", "x", "high")],
        "doc_id long, fact_ord long, name string, value string, unit string, snippet string, category string, confidence string",
    )
    scores = spark.createDataFrame([(i, 0.9) for i in range(4)], "doc_id long, confidence double")
    prior = spark.createDataFrame([(0, "9A012")], "doc_id long, code string")
    current = spark.createDataFrame([("3A001", "current")], "code string, verification_status string")
    return records.review_report(records.decision_records(docs, c.evidence, c.signals, c.ranked, c.candidates, facts, scores, prior, current)).cache()


def codes(df):
    return {(r.doc_id, r.code) for r in records.semantic_checks(df).where("NOT passed").collect()}


def test_a_record_holds_all_that_was_decided(made):
    r = made.where("doc_id = 0").first()
    assert (r.form.value, r.profile.profile, r.scope, r.confidence) == ("gateway", "sensor_gateway", "configuration_specific", 0.85)
    assert r.form.evidence_ids and {p.path_key for p in r.paths} >= {"component_electronics", "sensor_industrial"}
    assert all(p.missing == [n.requirement for n in p.requirements if not n.evidence_ids] and len(p.questions) == len(p.missing) for p in r.paths)
    assert ("9A012", "withdrawn") in {(t.code, t.to_status) for t in r.transitions} and {t.proposed for t in r.resolution} >= {"ai_accelerator"}
    assert {c.key for c in r.capabilities} >= {"platform_integrity", "secure_boot"} and r.eligible == []
    bare = made.where("doc_id = 3").first()
    assert bare.form.value == "unknown" and bare.paths == bare.evidence == bare.questions == [] and bare.abstention


def test_the_report_merges_spellings_and_passes_its_checks(made):
    memo = made.where("doc_id = 0").first().memo
    assert memo.count("**Part Number**") == 1 and "“part SX1”; “again SX1”" in memo and "- Manufacturer: Maker" in memo
    order = [memo.index(s) for s in orules.SECTIONS[1]]
    assert order == sorted(order)
    assert codes(made.where("doc_id IN (0, 1)")) <= {(0, "OPEN_PATH_MISSING_EVIDENCE_COMPLETE"), (1, "OPEN_PATH_MISSING_EVIDENCE_COMPLETE")}
    verdict = records.run_verdicts(records.semantic_checks(made.withColumn("memo", F.lit("none")))).where("doc_id = 0").first()
    assert not verdict.valid and "MEMO_PROFILE_MATCHES_CANONICAL" in verdict.failures and verdict.failures == sorted(verdict.failures)


def _set(column, **fields):
    """A change of fields in each struct of an array column."""
    return {column: F.transform(column, lambda x: _changed(x, fields))}


def _more(column, **fields):
    """A copy of the first struct with other fields, appended."""
    first = F.slice(column, 1, 1)
    return {column: F.concat(column, F.transform(first, lambda x: _changed(x, fields)))}


def _changed(x, fields):
    for k, v in fields.items():
        x = x.withField(k, v)
    return x


def _tampered():
    none = F.array().cast("array<string>")
    lit = F.lit
    return [
        ("MEMO_PROFILE_MATCHES_CANONICAL", 0, {"memo": F.replace("memo", lit("product profile: "), lit("product profile: un"))}), ("CROSS_ENTITY_EVIDENCE_USED", 0, _set("evidence", entity=lit("entity:9"))),
        ("BACKEND_PROFILE_DIVERGENCE_EXPLAINED", 0, {"resolution": F.slice("resolution", 1, 0)}), ("MEMO_CANDIDATE_MEMBERSHIP", 0, {"memo": F.concat("memo", lit(" 9X999"))}),
        ("CANDIDATE_SET_DIFFERENCE_EXPLAINED", 0, {"transitions": F.filter("transitions", lambda t: t["to_status"] != "withdrawn")}), ("MEMO_REFERENCES_CLOSED_ADVANCED_PATH", 0, {"memo": F.concat("memo", lit(" Advanced computing"))}),
        ("MEMO_REFERENCES_CLOSED_SECURITY_PATH", 0, {"memo": F.concat("memo", lit(" Category 5 Part 2")), "paths": F.filter("paths", lambda p: p["path_key"] != "category_5_part_2_security")}), ("MEMO_CAPABILITY_POLARITY_CONSISTENT", 1, {"memo": F.concat("memo", lit(" does not affirm crypto"))}),
        ("CAPABILITY_EXCLUSIVITY_CONTRADICTION", 1, _more("capabilities", key=lit("device_integrity_only"), presence=lit("present"))), ("UNSUPPORTED_CAPABILITY", 0, _set("capabilities", presence=lit("present"), evidence_ids=none)),
        ("NETWORK_PRODUCT_FORM_UNRESOLVED", 1, {"form": F.col("form").withField("value", lit("unknown"))}), ("CAPABILITY_PROFILE_PROMOTED_TO_PRODUCT", 1, {"profile": F.col("profile").withField("profile", lit("encryption_or_crypto_device"))}),
        ("NETWORK_PATH_MISSING", 1, {"paths": F.filter("paths", lambda p: p["path_key"] != "networking_telecom")}), ("MANUFACTURER_HAS_SOURCE_PROVENANCE", 0, _set("facts", snippet=lit("nothing"))),
        ("FACT_PROVENANCE_UNSUPPORTED", 0, _set("facts", snippet=lit("nothing"))), ("MATERIAL_EVIDENCE_OMITTED", 0, {"memo": F.replace("memo", lit("ev_"), lit("id_"))}),
        ("OPEN_PATH_MISSING_EVIDENCE_COMPLETE", 0, _set("paths", missing=none)), ("MISSING_EVIDENCE_EXCLUDES_SATISFIED_REQUIREMENTS", 0, _set("paths", missing=F.array(lit("component function in exported product"), lit("exported product function")))),
        ("CANDIDATE_BLOCKERS_COMPLETE", 0, _set("blocked", blockers=none)), ("DECISIVE_NEGATIVE_EVIDENCE_RENDERED", 0, {"memo": lit("Canonical product profile: sensor_gateway")}),
        ("BLOCKED_HYPOTHESES_NOT_ELIGIBLE", 0, {"eligible": F.col("blocked")}),
    ]


@pytest.mark.parametrize("place", range(21))
def test_a_tampered_record_fails_its_check(made, place):
    code, doc, change = _tampered()[place]
    own = made.where(f"doc_id = {doc}")
    assert (doc, code) not in codes(own) and (doc, code) in codes(own.withColumns(change))


def test_nest_gathers_by_one_exchange(spark):
    parent = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, p string")
    child = spark.createDataFrame([(1, 2, "y"), (1, 1, "x"), (9, 1, "gone")], "k long, n long, v string")
    df = nest("k", parent, one=child, two=child.limit(0))
    found = {r.k: (r.p, [tuple(x) for x in r.one], r.two) for r in df.collect()}
    assert found == {1: ("a", [(1, "x"), (2, "y")], []), 2: (None, [], []), 3: ("c", [], [])}
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_claims_are_held_against_their_own_run(spark):
    memo = "\n".join(orules.SECTIONS[1]) + "\n"
    runs = spark.createDataFrame([(1, "Sheet", "Runs at  3 GSPS on JESD204B", memo), (2, "Sheet", None, None)], "run_id long, title string, text string, markdown string")
    facts = spark.createDataFrame([(1, i, "sample_rate", str(i), "GSPS", f"line {i}", "It counts.", "x") for i in range(8)], "run_id long, fact_ord long, name string, value string, unit string, snippet string, importance string, category string")
    good = (1, 1, ["Sample Rate: 3 GSPS", "Criteria require review"], ["runs AT 3 gsps", "Line 4"], ["Is 3 GSPS reached over JESD204B?"])
    bad = (1, 2, ["Sample Rate: 9 GSPS", "Part number: X", "Document type: Y"], ["another run's words"], ["Is 12.5 Gbps reached?"])
    candidates = spark.createDataFrame([good, bad, (2, 1, [], [], [])], "run_id long, cand_ord long, claims array<string>, cited array<string>, questions array<string>")
    found = [(r.run_id, r.code, r.place, r.detail) for r in outputs.output_checks(runs, facts, candidates).collect()]
    assert sorted(f for f in found if f[0] == 1) == sorted([
        (1, "IDENTITY_DOMINATED", 2, "Sample Rate: 9 GSPS, Part number: X, Document type: Y"), (1, "FACT_UNGROUNDED", 2, "Sample Rate: 9 GSPS"), (1, "FACT_UNGROUNDED", 2, "Part number: X"), (1, "FACT_UNGROUNDED", 2, "Document type: Y"),
        (1, "CITATION_UNGROUNDED", 2, "another run's words"), (1, "QUESTION_UNGROUNDED", 2, "12.5 gbps"),
    ])
    assert {f[1] for f in found if f[0] == 2} == {"FEW_FACTS", "MALFORMED_MEMO"}


def test_identity_is_told_apart_from_legal_lines_and_document_numbers(spark):
    texts = ["ADS1299 converter", "ADCONEX copyright\nXCZU19EG FPGA", "UG1085A and DS891 only", "DS891 Overview of Zynq UltraScale+ MPSoC, XCZU7EV", "x" * 3000 + " AFE7444", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in identity.extract_identity(docs).collect():
        found.setdefault(r.doc_id, {})[r["name"]] = r.value
    assert found[0]["part_number"] == "ADS1299" and found[1]["part_number"] == "XCZU19EG" and 2 not in found and found[4]["part_number"] == "AFE7444" and 5 not in found
    assert (found[3]["part_number"], found[3]["document_number"], found[3]["document_type"]) == ("Not a single part number - family overview", "DS891", "Product Specification")


def test_a_match_counts_by_its_surroundings(spark):
    texts = ["HBM2 stacked memory", "human-body model HBM at 2 kV", "Pulse-width modulation", "SEL after heavy ion tests", "SEL mask of a register under radiation", "ECC and ECDSA", "ECC in cache", "Unlike SAR, the device has SAR", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r["name"], r.value) for r in identity.context_facts(docs).collect()}
    assert found == {(0, "memory_type", "HBM"), (3, "seu_or_sel", "SEL"), (5, "cryptographic_algorithm", "ECC"), (6, "memory_integrity", "ECC-protected cache")}


def test_the_budget_keeps_head_headings_and_tail(spark):
    long = "".join(f"word{i} " for i in range(3_000))
    long = long[:9_000] + " Secure Boot " + long[9_000:9_500] + " USB " + long[9_500:]
    docs = spark.createDataFrame([(1, "short"), (2, long), (3, None), (4, long * 40)], "doc_id long, text string")
    found = {r.doc_id: r.text for r in chunking.budget_text(docs, 6_000).collect()}
    assert found[1] == "short" and found[3] == "" and all(len(t) <= 6_000 for t in found.values())
    assert found[2].startswith(long[:2_000] + ir.EXCERPT) and found[2].count(ir.EXCERPT) == 1 and found[2].endswith(long[-750:]) and "Secure Boot" in found[2]
