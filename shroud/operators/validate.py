"""Candidate validation (VAL-01..18): row-level Column rules, no joins.

Input rows carry the features cut at extraction (``left30``, ``left10``, ``left20``,
``right5``, ``ip_tail``, ``context``, ``in_first_line``) and the sweep results
(``protected``, ``section``, ``ip_url_line``). Output adds ``confidence``,
``reject_reason`` (null when approved) and the shifted ``start``/``end``/``value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.spans import has_any
from ..functions.steps import Field, Step, on_rows
from .recognizers import company_trim, street_suffix

KNOWN_TYPES = ["ADDRESS", "DOB", "COMPANY", "PERSON", "IP_ADDRESS", "SSN", "PHONE", "EMAIL", "CREDIT_CARD", "URL"]


def is_structured(t: Column) -> Column:
    """VAL-01: structured types are auto-approved and protect their spans."""
    return t.isin(*R.STRUCTURED_TYPES)


def ip_rejected(left20: Column, ip_tail: Column, url_before: Column) -> Column:
    """VAL-03 (version word right before) or VAL-04 (``://`` on the line up to 20 chars after)."""
    return (F.lower(left20).rlike(R.IP_VERSION_PREFIX) | (F.instr(ip_tail, "://") > 0)
            | F.coalesce(url_before, F.lit(False)))


def birth_word(ctx: Column) -> Column:
    """VAL-15: a birth keyword as a whole word in the lower-cased paragraph context."""
    words = "|".join(w.replace(".", r"\.") for w in R.DATE_BIRTH_WORDS)
    return F.lower(ctx).rlike(r"\b(?:" + words + r")\b")


def stages(whole_word_denylist: bool = False) -> list[Step]:
    """VAL-02..16 and the shifted spans as steps: each sets some fields from those set before (short-line PERSON
    duplicates are handled by the plan). One copy of the rules for candidate rows and for candidates in an array."""

    def low(c: Field) -> Column:
        return F.lower(c("_pv"))

    def tech(c: Field) -> Column:
        if whole_word_denylist:
            return low(c).rlike(r"\b(?:" + "|".join(R.TECH_DENYLIST) + r")\b")
        return has_any(low(c), R.TECH_DENYLIST)

    def person_score(c: Field) -> Column:
        return (
            F.when(c("left30").rlike(R.PERSON_LEFT_LABEL), F.lit(R.PERSON_SCORES["label_ctx"]))
            .when((c("section") == "HEADER") & c("in_first_line"), F.lit(R.PERSON_SCORES["header"]))
            .when(c("score") > 0.8, c("score"))
            .otherwise(F.lit(0.0))
        )

    def person_reason(c: Field) -> Column:
        right5 = F.substring(F.concat(c("_street"), c("right5")), 1, 5)
        return (
            F.when(c("section").isin(*R.SUPPRESSED_SECTIONS), "suppressed_section")
            .when(tech(c), "tech_denylist")
            .when(low(c).isin(*R.FIELD_DENYLIST), "field_name")
            .when(F.ltrim(right5).startswith(":"), "label_colon")
        )

    def company_reason(c: Field) -> Column:
        v = c("value")
        return (
            F.when(~v.rlike(r"^\p{Lu}"), "company_lowercase")
            .when(~v.rlike(R.COMPANY_SUFFIX_CHECK), "company_no_suffix")
            .when(v.rlike(R.COMPANY_REJECT), "company_institution")
        )

    def address_reason(c: Field) -> Column:
        return (
            F.when(F.substring(c("left10"), -1, 1).isin(".", "#"), "address_prefix")
            .when(c("left10").rlike(R.ADDRESS_HEADING_NUMBER), "address_heading_number")
        )

    def reason(c: Field) -> Column:
        t, sc = c("type"), c("score")
        low_score = F.when(sc < R.AMBIGUOUS_MIN, "low_score")
        return (
            F.when((t == "IP_ADDRESS") & F.lower(c("left20")).rlike(R.IP_VERSION_PREFIX), "ip_version")
            # IPv4 only: the full IPv6 form has no such guard
            .when((c("recognizer") == "ipv4_regex") & ip_rejected(c("left20"), c("ip_tail"), c("ip_url_line")), "ip_in_url")
            .when(is_structured(t) & (sc < R.STRUCTURED_MIN), "low_score")
            .when(is_structured(t), F.lit(None))
            .when(c("protected"), "protected_overlap")
            # CAND-16 short-line names skip the PERSON validators: only their own section rule
            .when(c("recognizer") == "person_short_line",
                  F.when(c("section").isin(*R.SUPPRESSED_SECTIONS), "suppressed_section"))
            .when(t == "PERSON", F.coalesce(person_reason(c), F.when(person_score(c) < R.AMBIGUOUS_MIN, "low_score")))
            .when(t.isin("COMPANY", "ORG"), F.coalesce(company_reason(c), low_score))
            .when(t == "ADDRESS", F.coalesce(address_reason(c), low_score))
            .when(t.isin("DATE", "DATE_TIME"), F.when(~birth_word(c("context")), "no_birth_keyword"))
            .when(t == "LOCATION", "location")
            .when(~t.isin(*KNOWN_TYPES), "unknown_type")
            .otherwise(low_score)
        )

    def confidence(c: Field) -> Column:
        return (F.when(c("recognizer") == "person_short_line", c("score")).when(c("type") == "PERSON", person_score(c))
                .when(c("type").isin("DATE", "DATE_TIME"), F.lit(R.DATE_SCORE)).otherwise(c("score")).cast("double"))

    return [
        {"_street": lambda c: F.when(c("type") == "PERSON", street_suffix(c("value"))).otherwise(F.lit(""))},
        {"_pv": lambda c: F.substring(c("value"), F.lit(1), F.length(c("value")) - F.length(c("_street")))},
        {"reject_reason": reason, "confidence": confidence,
         "_trim": lambda c: F.when(c("type").isin("COMPANY", "ORG"), company_trim(c("value"))).otherwise(F.lit(0))},
        {"value": lambda c: F.substring(c("_pv"), c("_trim") + 1, F.length(c("_pv")))},
        {"start": lambda c: (c("start") + c("_trim")).cast("int"),
         "end": lambda c: (c("start") + c("_trim") + F.length(c("value"))).cast("int"),
         "type": lambda c: F.when(c("type") == "ORG", "COMPANY").when(c("type").isin("DATE", "DATE_TIME"), "DOB").otherwise(c("type"))},
    ]


def dob_stages() -> list[Step]:
    """VAL-17: a DOB span grows back over an ordinal day (``14th ``) found in the 10 chars before."""

    def ordinal(c: Field) -> Column:
        pre = F.regexp_extract(c("left10"), R.DOB_ORDINAL_PREFIX, 1)
        return F.when((c("type") == "DOB") & c("reject_reason").isNull(), F.coalesce(pre, F.lit(""))).otherwise(F.lit(""))

    return [{"_pre": ordinal},
            {"start": lambda c: (c("start") - F.length(c("_pre"))).cast("int"), "value": lambda c: F.concat(c("_pre"), c("value"))}]


TEMPORARY = ["_street", "_pv", "_trim", "_pre"]


def validate(c: DataFrame, whole_word_denylist: bool = False) -> DataFrame:
    """VAL-02..16 on candidate rows."""
    return on_rows(c, stages(whole_word_denylist), TEMPORARY)


def extend_dob(c: DataFrame) -> DataFrame:
    """VAL-17 on candidate rows."""
    return on_rows(c, dob_stages(), TEMPORARY)
