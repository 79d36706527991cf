"""The rule engine: ordered gates over findings, and combinators that turn what passes into a band.

A gate is a condition on one finding. The first that holds decides: ``held`` means that the finding
could not be evaluated (it blocks a claim of absence), ``ruled out`` that it was read and is not the
measure. Conditions are SQL over the columns of a finding; they are data, so a run can be decided
again from stored columns alone, without a clock, a network or a random number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    name: str
    outcome: str  # held, ruled out; "ruled out*" is held where the section is in a language whose wording is not covered
    reason: str
    condition: str


#: Languages in which the starred gates can only hold a finding (fixed values).
UNCOVERED = ("ru", "mn", "lo")

#: The gates in their order. The columns they read are those of ``FINDING_COLUMNS``.
GATES = (
    Gate("G01", "ruled out", "declares what is the case", "duty_force = 'declares'"),
    Gate("G02", "ruled out", "states no amount", "measure_kind = 'amount' and amount is null and not set_elsewhere"),
    Gate("G03", "ruled out", "not a condition of this measure", "measure_kind = 'condition' and not condition_fits"),
    Gate("G04", "ruled out", "confidence limited to an office", "duty_act = 'confide' and scoped_to_office"),
    Gate("G05", "ruled out", "forbids the act it should require", "prohibits and measure_kind = 'require'"),
    Gate("G06", "held", "names no party it binds", "duty_bearer is null"),
    Gate("G07", "ruled out", "does not state what makes it this measure", "defining_words is null and must_define"),
    Gate("G08", "ruled out*", "states no retention period", "measure_kind = 'retention' and stated_period is null"),
    Gate("G09", "held", "summarises provisions elsewhere", "is_outline"),
    Gate("G10", "held", "decides a proceeding", "is_decision"),
    Gate("G11", "held", "published about the law", "instrument_kind = 'publication'"),
    Gate("G12", "held", "defines a term", "defines_a_term"),
    Gate("G13", "ruled out", "the second reading found no words", "confirmed = false"),
    Gate("G14", "held", "wording only in English", "must_define and language in ('ru', 'mn', 'lo')"),
    Gate("G15", "ruled out", "words do not say the measure", "must_define and not defining_fits"),
    Gate("G16", "ruled out", "names no bank", "measure = 'bank-account' and not words_name_bank"),
    Gate("G17", "ruled out", "names no restriction", "measure = 'residual' and not words_restrict"),
    Gate("G18", "ruled out", "names no standard", "measure = 'payment-standard' and not words_name_standard"),
    Gate("G19", "ruled out", "no electronic delivery", "measure = 'transmission' and not words_electronic"),
    Gate("G20", "ruled out", "ordinary merger review", "measure = 'screening' and words_merger"),
    Gate("G21", "ruled out", "content outside the indicator", "measure = 'content' and words_excluded_content"),
    Gate("G22", "ruled out", "ordinary eligibility ground", "measure = 'procurement' and words_eligibility"),
    Gate("G23", "ruled out", "names no place of presence", "measure_kind = 'presence' and place_words is null"),
    Gate("G24", "ruled out", "does not bind the patentee", "measure = 'patent' and duty_bearer <> 'patentee'"),
    Gate("G25", "ruled out", "never names the subject", "subject_required and subject_words is null"),
    Gate("G26", "ruled out", "subject words name the party", "subject_required and subject_words = duty_bearer"),
    Gate("G27", "held", "subject only in English", "subject_required and language in ('ru', 'mn', 'lo')"),
    Gate("G28", "ruled out", "another subject", "subject_required and not subject_fits"),
    Gate("G29", "ruled out", "another class of goods", "carried_subject and not carried_fits"),
    Gate("G30", "ruled out*", "instrument names no such subject", "subject_in_instrument = false"),
    Gate("G31", "held", "states no proportion", "proportional and proportion is null"),
    Gate("G32", "ruled out*", "limits everyone's holding", "proportional and not names_foreign"),
    Gate("G33", "ruled out*", "names no foreign party", "foreign_only and not names_foreign"),
    Gate("G34", "ruled out*", "scoped to a public contract", "measure = 'joint-venture' and scoped_to_tender"),
    Gate("G35", "ruled out", "a presence abroad", "measure_kind = 'presence' and place_abroad"),
    Gate("G36", "ruled out", "licence terms only", "measure = 'patent' and licence_terms"),
    Gate("G37", "ruled out", "holding in a foreign company", "proportional and held_abroad"),
    Gate("G38", "ruled out", "a proportion to reach", "proportional and is_floor"),
    Gate("G39", "ruled out", "a copy for inspection", "locational and for_inspection"),
    Gate("G40", "ruled out", "a condition that only names where data go", "crosses_border and condition_is_place"),
    Gate("G41", "ruled out", "a list item under an empowering stem", "inherits_a_power"),
    Gate("G42", "ruled out", "empowers another instrument", "empowers and imposing_words is null"),
    Gate("G43", "ruled out", "imposing words are the empowering ones", "empowers and imposing_words = prescribing_words"),
    Gate("G44", "ruled out", "names no place for data", "locational and place_words is null"),
    Gate("G45", "ruled out", "a place but no data", "locational and located_data is null"),
    Gate("G46", "ruled out", "never calls it information", "locational and information_words is null"),
    Gate("G47", "ruled out", "never says data must be there", "locational and keeping_words is null"),
    Gate("G48", "ruled out", "party and data are the same words", "locational and located_data = duty_bearer"),
    Gate("G49", "ruled out*", "the thing is not information", "locational and not information_fits"),
    Gate("G50", "ruled out*", "a place that is no jurisdiction", "locational and not place_is_jurisdiction"),
    Gate("G51", "ruled out", "only points at other rules", "is_pointer"),
    Gate("G52", "ruled out", "nothing crosses the border", "crosses_border and border_words is null"),
    Gate("G53", "ruled out", "appoints no one", "appoints and role_words is null"),
    Gate("G54", "ruled out", "an officer for something else", "appoints and not role_fits"),
    Gate("G55", "ruled out", "the duty falls on the State", "bearer_kind = 'state' and not binds_state"),
    Gate("G56", "ruled out", "the power is not the State's", "binds_state and bearer_kind <> 'state'"),
    Gate("G57", "ruled out", "amends without the words inserted", "amends_another_act and not inserts_words"),
    Gate("G58", "ruled out", "the instrument is advisory", "bindingness = 'advisory'"),
    Gate("G59", "ruled out", "permits rather than requires", "duty_force = 'permits' and not may_permit"),
    Gate("G60", "ruled out", "a ceiling, not a minimum", "measure_kind = 'retention' and stops_keeping"),
    Gate("G61", "held", "authorisation not stated", "measure = 'access' and authorisation in ('unstated', 'court')"),
    Gate("G62", "held", "no exchange rate", "measure_kind = 'amount' and amount is not null and usd is null"),
)


def decided(findings: DataFrame, gates: tuple[Gate, ...] = GATES) -> DataFrame:
    """``gate``, ``outcome`` and ``reason`` of the first gate that holds; all null for a finding that passes."""
    first = F.coalesce(*[F.when(F.coalesce(F.expr(g.condition), F.lit(False)), F.lit(i)) for i, g in enumerate(gates)])
    uncovered = F.col("language").isin(*UNCOVERED)
    table = F.array(*[F.struct(F.lit(g.name).alias("gate"), F.lit(g.outcome).alias("outcome"), F.lit(g.reason).alias("reason")) for g in gates])
    hit = F.when(F.col("_gate").isNotNull(), F.element_at(table, F.col("_gate") + 1))
    starred = hit["outcome"] == "ruled out*"
    outcome = F.when(starred & uncovered, "held").when(starred, "ruled out").otherwise(hit["outcome"])
    # exploded, so that the conditions stand in the plan once and not in each column that reads the gate
    return findings.select("*", F.explode(F.array(first)).alias("_gate")).withColumns({"gate": hit["gate"], "outcome": outcome, "reason": hit["reason"]}).drop("_gate")


# Combinators: each gives the ordinal of a band from the findings of one cell (an aggregate column).


def present(is_measure: Column) -> Column:
    return F.when(F.count_if(is_measure) > 0, 1).otherwise(2)


def absent(is_measure: Column, bands: int) -> Column:
    return F.when(F.count_if(is_measure) > 0, bands).otherwise(1)


def escalating(severe: Column, lesser_measure: Column) -> Column:
    """Severe or several lesser measures: 1; one lesser: 2; none: 3. ``lesser_measure`` is null for other findings."""
    n = F.count_distinct(lesser_measure)
    return F.when((F.count_if(severe) > 0) | (n > 1), 1).when(n == 1, 2).otherwise(3)


def escalating_by_reach(wide: Column, narrow_measure: Column) -> Column:
    return escalating(wide, narrow_measure)


def scope_scaled(broad: Column, narrow_scope: Column, bands: int, two_promote: bool = True) -> Column:
    n = F.count_distinct(narrow_scope)
    top = (F.count_if(broad) > 0) | (n > 1 if two_promote else F.lit(False))
    return F.when(top, 1).when(n > 0, 2).otherwise(bands)


def both_or_one(a: Column, b: Column) -> Column:
    has_a, has_b = F.coalesce(F.bool_or(a), F.lit(False)), F.coalesce(F.bool_or(b), F.lit(False))
    return F.when(has_a & has_b, 3).when(has_a | has_b, 2).otherwise(1)


def equity_ladder(ban: Column, minority: Column, controlling: Column) -> Column:
    return F.when(F.bool_or(ban), 1).when(F.bool_or(minority), 2).when(F.bool_or(controlling), 3).otherwise(4)


def count_ladder(measure: Column, bands: int = 4) -> Column:
    n = F.count_distinct(measure)
    return F.when(n >= bands, 1).otherwise(bands - n)


def firm_threshold(usd: Column, firm: Column, limit: float = 200.0) -> Column:
    """The least firm figure (or the least of all): below the limit 2, else 3; none: 1."""
    least = F.coalesce(F.min(F.when(firm, usd)), F.min(usd))
    return F.when(least.isNull(), 1).when(least < limit, 2).otherwise(3)


def absence_allowed(witness: Column, held: Column, asked: Column) -> Column:
    """A missing protection may be claimed only with a governing witness, nothing held, and something asked."""
    return F.coalesce(F.bool_or(witness), F.lit(False)) & (F.count_if(held) == 0) & (F.count_if(asked) > 0)
