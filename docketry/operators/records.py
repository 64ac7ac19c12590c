"""Decision records: all that a run decided in one nested row, the named assertions over it, and its report.

``decision_records`` gathers evidence, profiles, candidates and facts of a
document by one exchange; forms, capabilities, paths, requirements, gates,
transitions and limitations are then array expressions of that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import text as tx
from docketry.operators.facts import display_name
from docketry.operators.nested import each, nest
from docketry.operators.profiles import rule_table
from docketry.rules import decision as dr
from docketry.rules import records as rules

POSITIVE = ("present", "ambiguous")


def _literals(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _chosen(key: Column, pairs, default: Column) -> Column:
    """The value of the key among (key, column) pairs."""
    made = F.coalesce(*[F.when(key == k, v) for k, v in pairs]) if pairs else default
    return F.coalesce(made, default)


def _ids(evidence: Column) -> Column:
    return F.transform(evidence, lambda e: e["id"])


def _forms(text: Column) -> tuple[Column, Column]:
    """The first form whose wording occurs, and the words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.coalesce(*[F.when(low.rlike(p), F.struct(F.lit(f).alias("form"), F.regexp_extract(low, p, 0).alias("words"))) for f, p in dr.FORMS])
    return F.coalesce(found["form"], F.lit("unknown")), found["words"]


def gathered(docs: DataFrame, evidence: DataFrame, signals: DataFrame, ranked: DataFrame, candidates: DataFrame, facts: DataFrame, scores: DataFrame, prior: DataFrame, regulations: DataFrame) -> DataFrame:
    """One row a document with the arrays that its decision is made of; see decision_records for the columns."""
    form, words = _forms(F.col("text"))
    backend = F.col("backend") if "backend" in docs.columns else F.lit(None).cast("string")
    more = [c for c in docs.columns if c not in ("doc_id", "text", "backend")]
    parent = docs.select("doc_id", *more, form.alias("form"), words.alias("words"), backend.alias("backend"))
    quote = F.lower("quote")
    met = F.array_compact(F.array(*[F.when(tx.contains_any(quote, ks), F.lit(r)) for r, ks in dr.KEYWORDS]))
    own = F.concat(F.lit("entity:"), F.col("doc_id").cast("string"))
    entity = F.coalesce("entity", own) if "entity" in evidence.columns else own
    quotes = evidence.select("doc_id", "start", "signal", F.col("evidence_id").alias("id"), "quote", quote.alias("low"), "polarity", "scope", "terms", F.when(F.col("polarity") == "present", met).otherwise(_literals(())).alias("met"), entity.alias("entity"))
    spark = docs.sparkSession
    aliases = rule_table(spark, list(dr.ALIASES), "path_key string, canonical string")
    current = regulations.where("verification_status = 'current'").select("code").distinct().withColumn("current", F.lit(True))
    proposed = candidates.join(F.broadcast(aliases), "path_key", "left").join(current, "code", "left")
    proposed = proposed.select("doc_id", "ordinal", "code", F.coalesce("canonical", "path_key").alias("path_key"), F.coalesce("current", F.lit(False)).alias("current"))
    return nest(
        "doc_id", parent, evidence=quotes, signals=signals.select("doc_id", "signal", "evidence_ids"), ranked=ranked.select("doc_id", "rank", "profile", "score"), candidates=proposed,
        facts=facts.select("doc_id", "fact_ord", "name", "value", "unit", "snippet", "category", "confidence", _same(F.col("name"), F.col("value"), F.col("unit")).alias("same")), scores=scores.select("doc_id", "confidence"), prior=prior.select("doc_id", "code").distinct(),
    )


def _capabilities(evidence: Column) -> Column:
    """Keys in the order of first evidence, each alias a key of its own; sub-capabilities of platform security after it."""

    def capability(key: Column, presence: Column, ids: Column) -> Column:
        weight = F.when(key.isin(*rules.UNRESOLVED_KEYS), "unresolved").otherwise("unknown")
        return F.struct(key.alias("key"), presence.alias("presence"), weight.alias("significance"), ids.alias("evidence_ids"))

    def of(signal: Column) -> Column:
        own = F.filter(evidence, lambda e: e["signal"] == signal)
        has = lambda p: F.exists(own, lambda e: e["polarity"] == p)
        presence = F.when(has("present"), "present").when(has("ambiguous"), "configuration_dependent").when(has("absent"), "absent").otherwise("unknown")
        keys = _chosen(signal, [(s, _literals(ks)) for s, ks in rules.CAPABILITY_KEYS], F.array(signal))
        main = F.transform(keys, lambda k: capability(k, presence, _ids(own)))
        naming = lambda t: F.filter(own, lambda e: e["low"].contains(t))
        some = [(k, naming(t)) for k, t in rules.INTEGRITY_TERMS]
        sub = F.array_compact(F.array(*[F.when((signal == "platform_security") & (F.size(es) > 0), capability(F.lit(k), F.lit("present"), _ids(es))) for k, es in some]))
        return F.concat(main, sub)

    return F.flatten(F.transform(F.array_distinct(F.transform(evidence, lambda e: e["signal"])), of))


def _integrity_only(capabilities: Column) -> Column:
    """The capabilities, with device_integrity_only where platform integrity is all there is."""
    network = F.exists(capabilities, lambda c: c["key"].isin(*rules.NETWORK_CRYPTO_KEYS) & c["presence"].isin("present", "configuration_dependent"))
    platform = F.filter(capabilities, lambda c: (c["key"] == "platform_integrity") & (c["presence"] == "present"))
    more = F.transform(F.slice(platform, 1, 1), lambda c: F.struct(F.lit("device_integrity_only").alias("key"), F.lit("present").alias("presence"), F.lit("unknown").alias("significance"), c["evidence_ids"].alias("evidence_ids")))
    return F.when(network, capabilities).otherwise(F.concat(capabilities, more))


def _paths(evidence: Column, form: Column) -> Column:
    """The open paths in fixed order, each with its requirements, what is missing and the questions."""
    extra = _chosen(form, [(f, _literals(rs)) for f, rs in dr.FORM_REQUIREMENTS], _literals(()))

    def path(key: str, title: str, signals: tuple[str, ...], required: tuple[str, ...]) -> Column:
        triggers = F.flatten(F.transform(_literals(signals), lambda s: F.filter(evidence, lambda e: (e["signal"] == s) & e["polarity"].isin(*POSITIVE))))
        if key == "sensor_industrial":
            triggers = F.when((F.size(triggers) == 0) & (form == "gateway"), F.filter(evidence, lambda e: e["low"].contains("gateway"))).otherwise(triggers)
        return F.struct(F.lit(key).alias("key"), F.lit(title).alias("title"), triggers.alias("triggers"), F.array_distinct(F.concat(_literals(required), extra)).alias("required"))

    def told(p: Column) -> Column:
        needs = F.transform(p["required"], lambda r: F.struct(r.alias("requirement"), _ids(F.filter(evidence, lambda e: F.array_contains(e["met"], r))).alias("evidence_ids")))
        kind = F.when(F.forall(p["triggers"], lambda e: e["polarity"] == "ambiguous"), "configuration_dependent").otherwise("direct_positive")
        missing = F.transform(F.filter(needs, lambda n: F.size(n["evidence_ids"]) == 0), lambda n: n["requirement"])
        return F.struct(
            p["key"].alias("path_key"), p["title"].alias("title"), kind.alias("trigger_type"), F.array_distinct(_ids(p["triggers"])).alias("evidence_ids"), needs.alias("requirements"), missing.alias("missing"),
            F.transform(missing, lambda r: F.concat(F.lit("Provide or confirm "), r, F.lit("."))).alias("questions"),
        )

    opened = F.filter(F.array(*[path(*c) for c in dr.CANONICAL]), lambda p: F.size(p["triggers"]) > 0)
    return F.transform(opened, told)


def _gated(candidates: Column, paths: Column) -> Column:
    """Each candidate with its path's evidence, rejections, blockers and status."""

    def gate(c: Column) -> Column:
        path = F.get(F.filter(paths, lambda p: p["path_key"] == c["path_key"]), F.lit(0))
        closed = path.isNull()
        unmet = F.transform(F.coalesce(path["missing"], _literals(())), lambda r: F.concat(F.replace(r, F.lit(" "), F.lit("_")), F.lit("_unknown")))
        blockers = F.concat(F.array_compact(F.array(F.when(closed, F.lit("no_positive_path_trigger_evidence")), F.when(~c["current"], F.lit(rules.NO_TEXT)))), F.array_distinct(unmet))
        rejections = F.when(closed, _literals(("review_path_not_open",))).otherwise(_literals(()))
        status = F.when(closed, "rejected").when(F.size(blockers) > 0, "blocked").otherwise("eligible")
        return F.struct(c["code"].alias("code"), c["path_key"].alias("path_key"), path["title"].alias("title"), status.alias("status"), rejections.alias("rejections"), blockers.alias("blockers"), F.coalesce(path["evidence_ids"], _literals(())).alias("evidence_ids"))

    return F.transform(candidates, gate)


def decision_records(docs: DataFrame, evidence: DataFrame, signals: DataFrame, ranked: DataFrame, candidates: DataFrame, facts: DataFrame, scores: DataFrame, prior: DataFrame, regulations: DataFrame) -> DataFrame:
    """One nested row a document: form, profile, components, resolution, optional, capabilities, scope, paths, eligible, blocked, rejected, transitions, limitations, missing, questions, flags, confidence, abstention, provenance; and evidence and facts.

    docs(doc_id, text[, backend]: the profile a provider proposed; further columns are kept), evidence as of source_evidence([entity]),
    signals(doc_id, signal, evidence_ids), ranked(doc_id, rank, profile, score), candidates(doc_id, ordinal, code,
    path_key), facts, scores(doc_id, confidence), prior(doc_id, code), regulations(code, verification_status).
    """
    rows = gathered(docs, evidence, signals, ranked, candidates, facts, scores, prior, regulations)
    ev, none = F.col("evidence"), _literals(())
    named = F.when(F.col("words").isNotNull(), _ids(F.filter(ev, lambda e: e["low"].contains(F.col("words"))))).otherwise(none)
    known = F.col("words").isNotNull()
    primary, score = F.col("ranked")[0]["profile"], F.get(F.col("scores.confidence"), F.lit(0))
    rows = rows.withColumns({"named": named, "primary": primary, "score": score, "capabilities": _capabilities(ev), "paths": _paths(ev, F.col("form"))})
    profile = _chosen(F.col("form"), [(f, F.lit(p)) for f, p in dr.FORM_PROFILES], F.col("primary"))
    support = F.when(F.size("named") > 0, F.col("named")).otherwise(F.flatten("signals.evidence_ids"))
    rows = rows.withColumns({"canonical": profile, "support": support, "capabilities": _integrity_only(F.col("capabilities")), "gated": _gated(F.col("candidates"), F.col("paths"))})

    def resolved(stage: str, proposed: str, status: str, reason: str) -> Column:
        made = F.struct(F.lit(stage).alias("stage"), F.col(proposed).alias("proposed"), F.col("canonical").alias("canonical"), F.lit(status).alias("status"), F.lit(reason).alias("reason"))
        return F.when(F.col(proposed).isNotNull() & (F.col(proposed) != F.col("canonical")), made)

    resolution = F.array_compact(F.array(resolved("provider_extraction", "backend", "overridden", rules.OVERRIDDEN), resolved("component_profile_heuristics", "primary", "reclassified_as_component", rules.RECLASSIFIED)))
    components = F.filter(F.col("ranked.profile"), lambda p: p.isin(*rules.COMPONENT_PROFILES) & (p != F.col("canonical")))
    optional = each(ev, lambda e: F.when(e["polarity"] == "ambiguous", F.struct(e["signal"].alias("capability"), e["id"].alias("evidence_id"), e["scope"].alias("scope"))))
    codes = F.col("candidates.code")
    gone = each("prior", lambda p: F.when(~F.array_contains(codes, p["code"]), F.struct(p["code"].alias("code"), F.lit("backend_local_rules").alias("from_stage"), F.lit("withdrawn").alias("to_status"), _literals(("not_reproposed_by_canonical_path_rules",)).alias("reasons"))))
    now = F.transform("gated", lambda g: F.struct(g["code"].alias("code"), F.lit("deterministic_candidate_rules").alias("from_stage"), g["status"].alias("to_status"), F.concat(g["rejections"], g["blockers"]).alias("reasons")))
    stuck = F.filter("gated", lambda g: (g["status"] == "blocked") & F.array_contains(g["blockers"], rules.NO_TEXT))
    limited = F.struct(F.lit(rules.LIMITATION).alias("code"), F.array_sort(F.col("paths.path_key")).alias("paths"), F.transform(stuck, lambda g: g["code"]).alias("candidates"))
    missing = F.array_distinct(F.flatten("paths.missing"))
    flags = F.array_compact(F.array(F.when(F.size(missing) > 0, F.lit("missing_key_specs")), F.when(F.size("candidates") > 1, F.lit("multiple_plausible_eccns")), F.lit("requires_engineering_confirmation")))
    status = lambda s: F.filter("gated", lambda g: g["status"] == s)
    sure = F.when(known, rules.FORM_SURE).otherwise(rules.FORM_UNSURE)
    return rows.select(
        "doc_id", *[c for c in docs.columns if c not in ("doc_id", "text", "backend")], "backend", F.concat(F.lit("entity:"), F.col("doc_id").cast("string")).alias("entity"), F.struct(F.col("form").alias("value"), sure.alias("confidence"), F.col("named").alias("evidence_ids"), F.when(known, "resolved").otherwise("unknown").alias("status")).alias("form"),
        F.struct(F.col("canonical").alias("profile"), F.when(known, F.lit(rules.FORM_SURE)).otherwise(F.col("score")).alias("confidence"), F.col("support").alias("evidence_ids")).alias("profile"), components.alias("components"), resolution.alias("resolution"),
        optional.alias("optional"), "capabilities", F.when(F.exists(ev, lambda e: e["scope"] == "current_configuration"), "configuration_specific").otherwise("mixed_or_unspecified").alias("scope"), "paths",
        *[status(s).alias(s) for s in ("eligible", "blocked", "rejected")], F.concat(gone, now).alias("transitions"), F.when(F.size(stuck) > 0, F.array(limited)).otherwise(F.array().cast("array<struct<code:string,paths:array<string>,candidates:array<string>>>")).alias("limitations"),
        missing.alias("missing"), F.array_distinct(F.flatten("paths.questions")).alias("questions"), flags.alias("flags"), F.least(F.col("score"), F.lit(rules.MOST_CONFIDENCE)).alias("confidence"), F.when(F.size("paths") == 0, rules.ABSTENTION).alias("abstention"),
        F.flatten(F.transform("paths", lambda p: F.transform(p["evidence_ids"], lambda i: F.struct(i.alias("evidence_id"), p["path_key"].alias("path_key"))))).alias("provenance"), "evidence", "facts", F.col("prior.code").alias("prior"),
    )


def semantic_checks(records: DataFrame) -> DataFrame:
    """(doc_id, code, passed, path, details): 21 assertions over each record and the memo in its column memo; a failed one blocks the run."""
    memo, low = F.col("memo"), F.lower("memo")
    profile, form, evidence, caps, paths, facts = F.col("profile.profile"), F.col("form.value"), F.col("evidence"), F.col("capabilities"), F.col("paths"), F.col("facts")
    keys, none = F.array_sort(F.col("paths.path_key")), _literals(())
    stated = F.regexp_extract(memo, r"(?i)Canonical product profile:\s*([^\n]+)", 1)
    foreign = each(evidence, lambda e: F.when(e["entity"] != F.col("entity"), e["id"]))
    known_codes = F.concat(F.col("eligible.code"), F.col("blocked.code"), F.col("rejected.code"))
    unexpected = F.array_except(tx.find_codes(memo), known_codes)
    unexplained = F.array_sort(F.array_except(F.col("prior"), F.col("transitions.code")))
    has = lambda names, states: F.exists(caps, lambda c: c["key"].isin(*names) & c["presence"].isin(*states))
    some = ("present", "configuration_dependent")
    bare = each(caps, lambda c: F.when((c["presence"] == "present") & (F.size(c["evidence_ids"]) == 0), c["key"]))
    network = form.isin(*rules.NETWORK_FORMS)
    card = F.exists(evidence, lambda e: e["low"].contains("network interface card") | e["low"].contains("smartnic"))
    told = lambda f: F.lower(F.coalesce(f["snippet"], F.lit(""))).contains(F.lower(F.coalesce(f["value"], F.lit(""))))
    makers = F.filter(facts, lambda f: f["name"] == "manufacturer")
    identity = each(facts, lambda f: F.when(f["name"].isin(*rules.IDENTITY_FACTS) & f["confidence"].isin("high", "medium") & ~told(f), f["name"]))
    omitted = F.array_sort(F.array_distinct(each(evidence, lambda e: F.when(e["polarity"].isin("present", "ambiguous", "absent") & ~memo.contains(e["id"]), e["id"]))))
    whole = each(paths, lambda p: F.when(F.size(p["missing"]) == 0, p["path_key"]))
    twice = F.flatten(F.transform(paths, lambda p: each(p["requirements"], lambda r: F.when((F.size(r["evidence_ids"]) > 0) & F.array_contains(p["missing"], r["requirement"]), r["requirement"]))))

    def gap(b: Column) -> Column:
        lacks = lambda p: F.exists(p["missing"], lambda r: ~F.array_contains(b["blockers"], F.concat(F.replace(r, F.lit(" "), F.lit("_")), F.lit("_unknown"))))
        return F.when(F.exists(paths, lambda p: (p["path_key"] == b["path_key"]) & lacks(p)), b["code"])

    gaps = each("blocked", gap)
    decisive = F.array_distinct(F.concat(F.flatten("paths.evidence_ids"), each(evidence, lambda e: F.when(e["polarity"] == "absent", e["id"]))))
    shown = F.filter(evidence, lambda e: memo.contains(e["id"]) | memo.contains(e["quote"]))
    unshown = F.array_sort(F.array_except(decisive, _ids(shown)))
    explained = F.exists("resolution", lambda r: (r["proposed"] == F.col("backend")) & (r["canonical"] == profile))
    one = lambda *cs: F.array_compact(F.array(*[c.cast("string") for c in cs]))
    checks = (
        ("MEMO_PROFILE_MATCHES_CANONICAL", stated == profile, "memo.profile", one(stated, profile)),
        ("CROSS_ENTITY_EVIDENCE_USED", F.size(foreign) == 0, "decision.sourceFacts", foreign),
        ("BACKEND_PROFILE_DIVERGENCE_EXPLAINED", F.col("backend").isNull() | (F.col("backend") == profile) | explained, "decision.profileResolutionRecords", one(F.col("backend"), profile)),
        ("MEMO_CANDIDATE_MEMBERSHIP", F.size(unexpected) == 0, "memo.candidates", unexpected),
        ("CANDIDATE_SET_DIFFERENCE_EXPLAINED", F.size(unexplained) == 0, "decision.candidateTransitions", unexplained),
        ("MEMO_REFERENCES_CLOSED_ADVANCED_PATH", ~low.contains("advanced comput") | F.array_contains(keys, "advanced_computing"), "memo.recommendation", keys),
        ("MEMO_REFERENCES_CLOSED_SECURITY_PATH", ~low.contains("category 5 part 2") | F.array_contains(keys, "category_5_part_2_security"), "memo.recommendation", keys),
        ("MEMO_CAPABILITY_POLARITY_CONSISTENT", ~(has(("transport_security",), some) & low.rlike(r"does not affirm (?:network )?crypt")), "memo.capabilities", none),
        ("CAPABILITY_EXCLUSIVITY_CONTRADICTION", ~(has(("device_integrity_only",), ("present",)) & has(rules.NETWORK_CRYPTO_KEYS, some)), "decision.capabilities", none),
        ("UNSUPPORTED_CAPABILITY", F.size(bare) == 0, "decision.capabilities", bare),
        ("NETWORK_PRODUCT_FORM_UNRESOLVED", ~(card & (form == "unknown")), "decision.exportedProductForm", one(form)),
        ("CAPABILITY_PROFILE_PROMOTED_TO_PRODUCT", ~(network & (profile == "encryption_or_crypto_device")), "decision.productLevelProfile", one(form, profile)),
        ("NETWORK_PATH_MISSING", ~(network & has(("networking", "high_speed_ethernet"), some) & ~F.array_contains(keys, "networking_telecom")), "decision.openReviewPaths", keys),
        ("MANUFACTURER_HAS_SOURCE_PROVENANCE", F.forall(makers, told), "facts.manufacturer", F.transform(makers, lambda f: f["value"])),
        ("FACT_PROVENANCE_UNSUPPORTED", F.size(identity) == 0, "facts.identity", identity),
        ("MATERIAL_EVIDENCE_OMITTED", F.size(omitted) == 0, "memo.sourceFacts", omitted),
        ("OPEN_PATH_MISSING_EVIDENCE_COMPLETE", F.size(whole) == 0, "decision.openReviewPaths", whole),
        ("MISSING_EVIDENCE_EXCLUDES_SATISFIED_REQUIREMENTS", F.size(twice) == 0, "decision.openReviewPaths", twice),
        ("CANDIDATE_BLOCKERS_COMPLETE", F.size(gaps) == 0, "decision.candidates", gaps),
        ("DECISIVE_NEGATIVE_EVIDENCE_RENDERED", F.size(unshown) == 0, "memo.sourceEvidence", unshown),
        ("BLOCKED_HYPOTHESES_NOT_ELIGIBLE", ~F.arrays_overlap("eligible.code", "blocked.code"), "decision.candidates", none),
    )
    rows = records.withColumn("memo", F.coalesce("memo", F.lit("")))
    made = [F.struct(F.lit(code).alias("code"), F.coalesce(passed, F.lit(False)).alias("passed"), F.lit(path).alias("path"), details.alias("details")) for code, passed, path, details in checks]
    return rows.select("doc_id", F.inline(F.array(*made)))


def run_verdicts(checks: DataFrame) -> DataFrame:
    """(doc_id, valid, failures): a run is valid if all of its checks passed; failures in the order of their names."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("code"))))
    return checks.groupBy("doc_id").agg(F.bool_and("passed").alias("valid"), failed.alias("failures"))


def _lines(rows: Column, otherwise: str | Column) -> Column:
    return F.when(F.size(rows) > 0, F.array_join(rows, "\n")).otherwise(F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def _same(name: Column, value: Column, unit: Column) -> Column:
    """Facts that are one line of a report: by normalised name, value and unit."""
    return F.concat_ws("\u001f", F.regexp_replace(F.lower(name), "[^a-z0-9]+", ""), F.lower(F.trim(value)), F.coalesce(unit, F.lit("\u001e")))


def _fact_lines(facts: Column) -> Column:
    """A line for each group of same facts, in the order of first facts, with all of its sources."""

    def told(f: Column, quotes: Column) -> Column:
        unit = F.when(F.coalesce(f["unit"], F.lit("")) != "", F.concat(F.lit(" "), f["unit"])).otherwise("")
        direct = F.when(F.exists(quotes, lambda q: F.lower(q).contains(F.lower(f["value"]))), "direct").otherwise("inferred")
        sources = F.array_join(F.transform(quotes, lambda q: F.concat(F.lit("“"), q, F.lit("”"))), "; ")
        return F.concat(F.lit("- **"), display_name(f["name"]), F.lit("**: "), f["value"], unit, F.lit("\n  - Source: "), sources, F.lit("\n  - Confidence: "), f["confidence"], F.lit("; support: "), direct)

    def line(key: Column) -> Column:
        # one element, so that the group is gathered once
        return F.transform(F.array(F.filter(facts, lambda f: f["same"] == key)), lambda group: told(group[0], F.array_distinct(F.transform(group, lambda x: x["snippet"]))))[0]

    return F.transform(F.array_distinct(F.transform(facts, lambda f: f["same"])), line)


def _spaced(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def review_report(records: DataFrame) -> DataFrame:
    """The records with the column memo: Markdown in fixed section order, under the columns title and file_name.  Equal facts in other spelling are one line."""
    facts, evidence, paths = F.col("facts"), F.col("evidence"), F.col("paths")
    maker = F.get(each(facts, lambda f: F.when((f["name"] == "manufacturer") & F.lower(f["snippet"]).contains(F.lower(f["value"])), f["value"])), F.lit(0))
    source = F.filter(facts, lambda f: ~f["category"].isin("profile_detection", "normalized_technical_signal") & ~f["name"].startswith("heuristic_signal_") & (f["name"] != "manufacturer"))
    scope = lambda e: F.coalesce(e["scope"], F.lit("unspecified"))
    seen = F.transform(evidence, lambda e: F.concat(F.lit("- **"), _spaced(e["signal"]), F.lit("**: "), F.array_join(e["terms"], ", "), F.lit("\n  - Evidence ID: `"), e["id"], F.lit("`; polarity: "), e["polarity"], F.lit("; configuration scope: "), scope(e), F.lit("; support: direct\n  - Exact quote: “"), e["quote"], F.lit("”")))
    denied = each(evidence, lambda e: F.when(e["polarity"] == "absent", F.concat(F.lit("- **"), _spaced(e["signal"]), F.lit("**: absent\n  - Exact quote: “"), e["quote"], F.lit("”\n  - Source location: source document; configuration scope: "), scope(e))))
    caps = F.transform("capabilities", lambda c: F.concat(F.lit("- **"), _spaced(c["key"]), F.lit("**: "), c["presence"], F.lit("; implementation unknown; user accessibility unknown; classification significance "), c["significance"], F.lit(".")))
    bullets = lambda rows: F.array_join(F.transform(rows, lambda x: F.concat(F.lit("  - "), x)), "\n")
    opened = F.transform(paths, lambda p: F.concat(F.lit("### "), p["title"], F.lit("\n- Status: open\n- Why opened: Opened by "), F.size(p["evidence_ids"]).cast("string"), F.lit(" normalized source evidence record(s).\n- Triggering evidence IDs: "), F.array_join(p["evidence_ids"], ", "), F.lit("\n- Missing evidence:\n"), bullets(p["missing"])))
    able = F.transform("eligible", lambda g: F.concat(F.lit("### "), g["code"], F.lit(" — "), g["title"], F.lit("\n- Status: eligible\n- Triggering evidence IDs: "), F.array_join(g["evidence_ids"], ", ")))

    def held(g: Column) -> Column:
        missing = F.coalesce(F.get(F.filter(paths, lambda p: p["path_key"] == g["path_key"]), F.lit(0))["missing"], _literals(()))
        ids = F.when(F.size(g["evidence_ids"]) > 0, F.array_join(g["evidence_ids"], ", ")).otherwise("none")
        return F.concat(F.lit("### "), g["code"], F.lit(" — "), g["title"], F.lit("\n- Status: specific candidate not yet supportable\n- Positive path evidence IDs: "), ids, F.lit("\n- Blocking reasons:\n"), bullets(g["blockers"]), F.lit("\n- Missing evidence:\n"), bullets(missing))

    resolved = F.transform("resolution", lambda r: F.concat(F.lit("- "), r["stage"], F.lit(" proposed `"), r["proposed"], F.lit("`; canonical decision uses `"), r["canonical"], F.lit("` because "), r["reason"]))
    limits = F.transform("limitations", lambda x: F.lit(f"- {rules.LIMITATION_TEXT} (Severity: blocking; resolution owner: system.)"))
    advice = F.transform(paths, lambda p: F.concat(F.lit("- Continue qualified review of the "), F.lower(p["title"]), F.lit(".")))
    model = F.concat(
        F.lit("- File: "), F.coalesce("file_name", F.lit("Not recorded")), F.lit("\n- Manufacturer: "), F.coalesce(maker, F.lit("unknown")), F.lit("\n- Exported product form: "), F.col("form.value"), F.lit("\n- Canonical product profile: "), F.coalesce("profile.profile", F.lit("unknown")),
        F.lit("\n- Configuration scope: "), F.col("scope"), F.lit("\n- Human review required: yes\n\n### Profile resolution\n"), _lines(resolved, "- Provider and canonical profile agree, or no provider profile was supplied."),
        F.lit("\n\n### Installed component profiles\n"), _lines(F.transform("components", lambda p: F.concat(F.lit("- "), p, F.lit(" (installed_component)"))), "- None established from the supplied evidence."),
    )
    bodies = {
        "Document and canonical product model": model, "Extracted source facts": _lines(F.concat(_fact_lines(source), seen), "- No material source facts were established."), "Decisive negative source evidence": _lines(denied, "- No decisive negative source evidence was used in this decision."),
        "Capability assessment": _lines(caps, "- No material capabilities were established."), "Open review paths": _lines(opened, f"- {rules.ABSTENTION}"), "Eligible candidate ECCNs": _lines(able, "- No specific ECCN candidate is currently eligible."),
        "Specific candidates not yet supportable": _lines(F.transform("blocked", held), "- None."), "System limitations": _lines(limits, "- No blocking platform limitation was recorded."), "Reviewer questions": _lines(F.transform("questions", lambda q: F.concat(F.lit("- "), q)), "- Confirm whether additional technical evidence is available."),
        "ECCN review recommendation": _lines(advice, F.concat(F.lit("- Abstain: "), F.coalesce("abstention", F.lit("insufficient source evidence")))), "Review state": F.lit("- Classification memo draft for qualified human review.\n- Internal precedent is not regulatory authority."),
    }
    memo = F.concat(F.lit("# Classification Memo Draft — "), F.coalesce("title", F.lit("")), *[x for name, body in bodies.items() for x in (F.lit(f"\n\n## {name}\n"), body)], F.lit("\n"))
    return records.withColumn("memo", memo)
