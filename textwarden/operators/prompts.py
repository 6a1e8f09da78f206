"""Prompt guard: prompt-injection and jailbreak detection, decision cascade, policies and fallbacks.

Detection reads a text three ways, each only where the earlier ones found nothing: as written, with conversation
boundaries removed, and in its de-obfuscated readings. Everything is a projection over the row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden import fixed_values as fv
from textwarden.functions import presence
from textwarden.functions import text as tx
from textwarden.functions.regex import any_of, first_rule, has_literals, let, matched_text, pick, unicode_words
from textwarden.operators.barrier import pin
from textwarden.operators.pii import mask_pii
from textwarden.operators.views import with_views

VERDICT = "struct<detected:boolean,confidence:double,reason:string,rule:string,matched_sample:string>"
# Short names that every pattern asks for as whole words.
NAMES = fv.JAILBREAK_LITERALS[0][0]


@dataclass(frozen=True)
class Detector:
    """Ordered patterns with the literals each needs, and how a hit is reported."""

    prefix: str
    patterns: tuple[str, ...]
    literals: tuple
    confidence: tuple[float, ...]
    reason: str
    flags: str = "sm"
    delimiter: bool = False

    def rule_ids(self) -> list[str]:
        numbered = [f"{self.prefix}_rule_{number}" for number in range(1, len(self.patterns) + 1)]
        return [*numbered[:-1], "pi_delimiter_escape"] if self.delimiter else numbered


INJECTION = Detector(
    prefix="pi",
    patterns=(*fv.INJECTION_PATTERNS, fv.DELIMITER_PATTERN),
    literals=(*fv.INJECTION_LITERALS, fv.DELIMITER_LITERALS),
    confidence=(*[fv.INJECTION_CONFIDENCE] * len(fv.INJECTION_PATTERNS), fv.DELIMITER_CONFIDENCE),
    reason=fv.INJECTION_REASON,
    delimiter=True,
)
JAILBREAK = Detector(
    prefix="jb",
    patterns=fv.JAILBREAK_PATTERNS,
    literals=fv.JAILBREAK_LITERALS,
    confidence=(fv.JAILBREAK_CONFIDENCE,) * len(fv.JAILBREAK_PATTERNS),
    reason=fv.JAILBREAK_REASON,
)
SDK_INJECTION = Detector(
    prefix="pi",
    patterns=fv.INJECTION_PATTERNS[: fv.SDK_INJECTION_COUNT],
    literals=fv.INJECTION_LITERALS[: fv.SDK_INJECTION_COUNT],
    confidence=(fv.INJECTION_CONFIDENCE,) * fv.SDK_INJECTION_COUNT,
    reason=fv.INJECTION_REASON,
    flags="",
)
SDK_JAILBREAK = Detector(
    prefix="jb",
    patterns=(*fv.JAILBREAK_PATTERNS[:8], fv.SDK_JAILBREAK_RULE_9, *fv.JAILBREAK_PATTERNS[9:]),
    literals=fv.JAILBREAK_LITERALS,
    confidence=(fv.JAILBREAK_CONFIDENCE,) * len(fv.JAILBREAK_PATTERNS),
    reason=fv.JAILBREAK_REASON,
    flags="",
)


def _java_patterns(detector: Detector) -> list[str]:
    compiled = [unicode_words(pattern, detector.flags) for pattern in detector.patterns]
    if detector.delimiter:
        compiled[-1] = unicode_words(detector.patterns[-1])
    return compiled


def facts(label: Column, text: Column) -> Column:
    """A reading with what every rule asks of it: lower-cased text, odd-folding letters, letters beyond ASCII."""
    return F.struct(
        label.cast("string").alias("label"),
        text.alias("text"),
        F.lower(text).alias("lowered"),
        any_of([F.contains(text, F.lit(letter)) for letter in presence.FOLDING_LETTERS]).alias("folds_oddly"),
        (F.octet_length(text) != F.length(text)).alias("beyond_ascii"),
    )


def asked_words(detector: Detector) -> list[str]:
    """Words of which a text has to hold one before any rule can match: of each rule, its least usual group of literals."""

    def unusual(group: Sequence[str]) -> tuple:
        shortest = len(min(group, key=len))
        return group == NAMES or shortest > 3, shortest, sum(map(len, group)) / len(group)

    return sorted({word for groups in detector.literals for word in max(groups, key=unusual)})


def _readings_to_scan(views: str, found: str, asked: Column) -> Column:
    """Facts of the readings that rules of an asked detector (a bit each) may match in; no rule matches any other."""
    paired = F.zip_with(views, found, lambda reading, bits: F.struct(reading.alias("reading"), bits.bitwiseAND(asked).alias("bits")))
    return F.transform(
        F.filter(paired, lambda pair: pair["bits"] > 0),
        lambda pair: F.struct(facts(pair["reading"]["label"], pair["reading"]["text"]).alias("reading"), pair["bits"].alias("bits")),
    )


def rule_number(reading: Column, detector: Detector) -> Column:
    """1-based number of the first pattern that matches. Literals are looked up before a pattern is tried."""
    text, lowered = reading["text"], reading["lowered"]
    conditions = []
    for pattern, literals in zip(_java_patterns(detector), detector.literals):
        in_ascii = any(word.isascii() for group in literals for word in group)
        present = has_literals(lowered, literals)
        possible = reading["folds_oddly"] | present if in_ascii else reading["beyond_ascii"] & present
        conditions.append(possible & text.rlike(pattern))
    return first_rule(conditions)


def verdict(text: Column, number: Column, detector: Detector, label: Column) -> Column:
    """Verdict struct for a numbered hit in ``text``; NULL without a number. The label names the reading, if any."""
    sample = matched_text(text, _java_patterns(detector), number)
    reason = F.concat(F.lit(detector.reason), F.substring(sample, 1, 40), F.lit("...)"))
    if detector.delimiter:
        is_delimiter = number == len(detector.patterns)
        reason = F.when(is_delimiter, fv.DELIMITER_REASON).otherwise(reason)
        sample = F.when(is_delimiter, text).otherwise(sample)
    reason = F.concat(reason, F.coalesce(F.concat(F.lit(" [via "), label, F.lit("]")), F.lit("")))
    return F.when(
        number.isNotNull(),
        F.struct(
            F.lit(True).alias("detected"),
            pick(detector.confidence, number).alias("confidence"),
            reason.alias("reason"),
            pick(detector.rule_ids(), number).alias("rule"),
            F.substring(sample, 1, 80).alias("matched_sample"),
        ),
    ).cast(VERDICT)


def _clean(reason: str) -> Column:
    return F.struct(
        F.lit(False).alias("detected"),
        F.lit(0.0).alias("confidence"),
        F.lit(reason).alias("reason"),
        F.lit("").alias("rule"),
        F.lit("").alias("matched_sample"),
    ).cast(VERDICT)


def _oversize(text: Column) -> Column:
    length = F.length(text)
    return F.when(
        length > fv.MAX_PROMPT_CHARS,
        F.struct(
            F.lit(True).alias("detected"),
            F.lit(fv.OVERSIZE_CONFIDENCE).alias("confidence"),
            F.concat(
                F.lit("Prompt exceeds max length ("), length.cast("string"),
                F.lit(f" > {fv.MAX_PROMPT_CHARS}) — possible DoS/obfuscation"),
            ).alias("reason"),
            F.lit("pi_oversize").alias("rule"),
            F.substring(text, 1, 80).alias("matched_sample"),
        ),
    ).cast(VERDICT)


def _joined_turns(clean: Column, glue: str) -> Column:
    whole = F.replace(F.replace(clean, F.lit(fv.TURN_SEPARATOR), F.lit(glue)), F.lit(fv.TURN_MARK), F.lit(glue))
    return F.when(F.contains(clean, F.lit(fv.TURN_MARK)), whole)


_HIT = "struct<label:string,text:string,number:int>"


def _first_reading_hit(readings: Column, detector: Detector) -> Column:
    """First reading that a pattern matches, as struct(label, text, number); readings after it are not looked at."""

    def look(found: Column, reading: Column) -> Column:
        def judged(number: Column) -> Column:
            hit = F.struct(reading["label"].alias("label"), reading["text"].alias("text"), number.alias("number"))
            return F.when(number.isNotNull(), hit.cast(_HIT))

        return F.when(found.isNotNull(), found).otherwise(let(rule_number(reading, detector), judged))

    return F.aggregate(readings, F.lit(None).cast(_HIT), look)


def _hit_verdict(hit: Column, detector: Detector) -> Column:
    return verdict(hit["text"], hit["number"], detector, hit["label"])


def detect(
    df: DataFrame,
    text: str,
    injection: str | None = "injection",
    jailbreak: str | None = "jailbreak",
    deep: bool = True,
    profile: str = "gateway",
    strict_reference: bool = False,
) -> DataFrame:
    """Add a verdict struct per detector (``None`` leaves a detector out).

    Texts of every length are scanned; one over the size limit gets the oversize verdict when nothing else is found.
    With ``strict_reference=True`` its size alone decides and it is not scanned for injections. ``deep=False`` stops
    before the de-obfuscated readings.
    """
    sdk = profile == "sdk"
    wanted = {
        name: detector
        for name, detector in (
            (injection, SDK_INJECTION if sdk else INJECTION), (jailbreak, SDK_JAILBREAK if sdk else JAILBREAK)
        )
        if name
    }
    kept = df.columns
    df = df.withColumn("_clean", F.col(text) if sdk else tx.strip(F.col(text)))
    clean = F.col("_clean")
    blank = F.coalesce(clean == "", F.lit(True))
    forms = [F.struct(F.lit(None).cast("string").alias("label"), clean.alias("text"))]
    if not sdk:
        forms += [
            F.struct(F.lit(label).alias("label"), _joined_turns(clean, glue).alias("text"))
            for label, glue in zip(fv.BOUNDARY_LABELS, ("", " "))
        ]
    written = F.filter(F.array(*forms), lambda form: form["text"].isNotNull())
    patterns = [presence.rules_pattern(detector.patterns) for detector in wanted.values()]
    bit = {name: 1 << place for place, name in enumerate(wanted)}

    def hits(readings: str) -> dict[str, Column]:
        """First hit of each detector among the readings that its rules may match in."""
        own = {name: F.filter(readings, lambda pair: pair["bits"].bitwiseAND(bit[name]) > 0) for name in wanted}  # noqa: B023
        return {name: _first_reading_hit(F.transform(own[name], lambda pair: pair["reading"]), detector) for name, detector in wanted.items()}

    df = pin(df, {"_written": written})
    df = df.withColumn("_found", presence.found_in(F.transform("_written", lambda form: form["text"]), *patterns))
    df = pin(df, {"_written": _readings_to_scan("_written", "_found", F.lit(sum(bit.values())))})
    df = pin(df, {f"_{name}_plain": hit for name, hit in hits("_written").items()})
    found = {name: _hit_verdict(F.col(f"_{name}_plain"), detector) for name, detector in wanted.items()}
    is_open = {name: F.col(f"_{name}_plain").isNull() & ~blank for name in wanted}
    oversize = _oversize(F.col(text)) if not sdk else F.lit(None).cast(VERDICT)
    if injection in found and strict_reference:
        found[injection] = F.coalesce(oversize, found[injection])
        if not sdk:
            is_open[injection] = is_open[injection] & (F.length(text) <= fv.MAX_PROMPT_CHARS)
    if deep:
        df = df.withColumn("_probe", F.when(any_of(list(is_open.values())), clean))
        df = with_views(df, "_probe", "_views", profile=profile)
        df = df.withColumn("_found", presence.found_in(F.transform("_views", lambda reading: reading["text"]), *patterns))
        asked = sum((F.when(is_open[name], bit[name]).otherwise(0) for name in wanted), F.lit(0))
        df = pin(df, {"_views": _readings_to_scan("_views", "_found", asked)})
        for (name, hit), detector in zip(hits("_views").items(), wanted.values(), strict=True):
            df = df.withColumn(f"_{name}_hit", F.when(is_open[name], hit))
            found[name] = F.coalesce(found[name], _hit_verdict(F.col(f"_{name}_hit"), detector))
    if injection in found and not strict_reference:
        found[injection] = F.coalesce(found[injection], oversize)
    reasons = {injection: "clean prompt", jailbreak: "safe prompt"}
    result = {
        name: F.when(blank, _clean("")).otherwise(F.coalesce(column, _clean(reasons[name])))
        for name, column in found.items()
    }
    return pin(df, result).select(*kept, *result)


@dataclass(frozen=True)
class GuardPolicy:
    """Switches and threshold of the guard; each may also be a column, for per-route policies."""

    prompt_injection: bool | Column = True
    jailbreak: bool | Column = True
    pii_masking: bool | Column = True
    threshold: float | Column = fv.SENSITIVITY_THRESHOLD


def _as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _blocks(found: Column, threshold: Column) -> Column:
    return found["detected"] & (found["confidence"] >= threshold)


def decide(
    df: DataFrame, text: str, policy: GuardPolicy = GuardPolicy(), out: str = "decision", deep: bool = True,
    strict_reference: bool = False,
) -> DataFrame:
    """Add the guard decision: injection blocks, then jailbreak, then personal data is masked, else it passes."""
    kept = df.columns
    df = detect(df, text, "_injection", "_jailbreak", deep=deep, strict_reference=strict_reference)
    df = mask_pii(df, text, out="_pii")
    threshold = _as_column(policy.threshold)
    masking = _as_column(policy.pii_masking) & F.col("_pii.has_pii")

    def outcome(allowed, sanitized, threat, risk, confidence, reason) -> Column:
        return F.struct(
            F.lit(allowed).alias("allowed"), sanitized.alias("sanitized_prompt"), F.lit(threat).alias("threat_type"),
            F.lit(risk).alias("risk_level"), _as_column(confidence).cast("double").alias("confidence"),
            _as_column(reason).alias("reason"),
        )

    types = F.concat(
        F.lit("Masked sensitive PII entities: ['"),
        F.array_join(F.transform(F.col("_pii.entities"), lambda entity: entity["type"]), "', '"),
        F.lit("']"),
    )
    decision = (
        F.when(
            _as_column(policy.prompt_injection) & _blocks(F.col("_injection"), threshold),
            outcome(False, F.col(text), "PROMPT_INJECTION", "CRITICAL", F.col("_injection.confidence"),
                    F.col("_injection.reason")),
        )
        .when(
            _as_column(policy.jailbreak) & _blocks(F.col("_jailbreak"), threshold),
            outcome(False, F.col(text), "JAILBREAK", "HIGH", F.col("_jailbreak.confidence"),
                    F.col("_jailbreak.reason")),
        )
        .when(masking, outcome(True, F.col("_pii.sanitized_text"), "PII_DETECTED", "MEDIUM", 0.9, types))
        .otherwise(outcome(True, F.col(text), "NONE", "LOW", 0.0, "request passed guardrails"))
    )
    return pin(df, {out: decision}).select(*kept, out)


def risk_level(score: Column) -> Column:
    """Level of a 0 to 100 risk score."""
    chain = None
    for bound, level in fv.RISK_LEVELS:
        chain = F.when(score >= bound, level) if chain is None else chain.when(score >= bound, level)
    return chain.otherwise("LOW")


def fallback_judgement(df: DataFrame, text: str, out: str = "judgement", deep: bool = True) -> DataFrame:
    """Add the deterministic judge verdict: injection, else jailbreak, else benign with a low score."""
    kept = df.columns
    df = detect(df, text, "_injection", "_jailbreak", deep=deep)
    blank = F.coalesce(tx.strip(F.col(text)) == "", F.lit(True))

    def judged(threat: bool, category: str, confidence, reasoning, score, action: str) -> Column:
        return F.struct(
            F.lit(threat).alias("is_threat"), F.lit(category).alias("threat_category"),
            _as_column(confidence).cast("double").alias("confidence"), _as_column(reasoning).alias("reasoning"),
            _as_column(score).cast("int").alias("risk_score"), F.lit(fv.JUDGE_INTENT[category]).alias("attack_intent"),
            F.lit(action).alias("suggested_action"), F.lit(fv.JUDGE_STANDARD_CODE[category]).alias("standard_code"),
            F.lit("fallback").alias("source"),
        )

    def threat(name: str, category: str) -> Column:
        found = F.col(name)
        return judged(
            True, category, found["confidence"],
            F.concat(F.lit("Local fallback (regex heuristic): "), found["reason"]),
            F.round(found["confidence"] * 100), "BLOCK",
        )

    empty = judged(False, "NONE", 0.0, "Empty input", 0, "PASS")
    benign = judged(
        False, "NONE", fv.JUDGE_BENIGN_CONFIDENCE,
        "Local fallback (regex heuristic): no known pattern matched. NOTE: this is signature-based, not semantic "
        "judgment — synonym/paraphrase/foreign-language attacks are not covered by this layer.",
        fv.JUDGE_BENIGN_SCORE, "PASS",
    )
    result = (
        F.when(blank, empty)
        .when(F.col("_injection.detected"), threat("_injection", "PROMPT_INJECTION"))
        .when(F.col("_jailbreak.detected"), threat("_jailbreak", "JAILBREAK"))
        .otherwise(benign)
    )
    return df.withColumn(out, result).select(*kept, out)


def with_fallback(
    requests: DataFrame, verdicts: DataFrame, key: str, fallback_action: str = "BLOCK"
) -> DataFrame:
    """Left-join verdicts (key, allowed, threat_type) to requests; a missing verdict follows the fallback action."""
    answered = verdicts.select(key, F.col("allowed").alias("_allowed"), F.col("threat_type").alias("_threat"))
    joined = requests.join(answered, key, "left")
    missing = F.col("_allowed").isNull()
    return joined.withColumns(
        {
            "allowed": F.coalesce(F.col("_allowed"), F.lit(fallback_action == "ALLOW")),
            "threat_type": F.when(missing, "GUARD_UNAVAILABLE").otherwise(F.col("_threat")),
            "status": F.when(missing & F.lit(fallback_action != "ALLOW"), 502)
            .when(~F.coalesce(F.col("_allowed"), F.lit(True)), 403)
            .otherwise(200),
        }
    ).drop("_allowed", "_threat")


def sdk_decide(df: DataFrame, text: str, out: str = "decision", deep: bool = True) -> DataFrame:
    """In-process cascade: request signatures, injection and jailbreak block in turn; otherwise data is masked."""
    from textwarden.operators.requests import scan_texts

    kept = df.columns
    df = scan_texts(df, text, out="_scan", profile="sdk")
    df = detect(df, text, "_injection", "_jailbreak", deep=deep, profile="sdk")
    df = mask_pii(df, text, out="_pii", profile="sdk")
    found, injection, jailbreak = F.col("_scan"), F.col("_injection"), F.col("_jailbreak")
    blocked = found["blocked"] | injection["detected"] | jailbreak["detected"]
    result = F.struct(
        blocked.alias("is_blocked"),
        F.when(found["blocked"], found["threat_type"]).when(injection["detected"], "PROMPT_INJECTION")
        .when(jailbreak["detected"], "JAILBREAK").otherwise("NONE").alias("threat_category"),
        F.when(found["blocked"], found["standard_code"])
        .when(injection["detected"], fv.JUDGE_STANDARD_CODE["PROMPT_INJECTION"])
        .when(jailbreak["detected"], fv.JUDGE_STANDARD_CODE["JAILBREAK"]).otherwise("").alias("standard_code"),
        F.when(found["blocked"], 1.0).when(injection["detected"], injection["confidence"])
        .when(jailbreak["detected"], jailbreak["confidence"]).otherwise(0.0).alias("confidence"),
        F.when(~blocked, F.col("_pii.sanitized_text")).alias("masked_text"),
        (~blocked & F.col("_pii.has_pii")).alias("has_pii"),
    )
    return df.withColumn(out, result).select(*kept, out)
