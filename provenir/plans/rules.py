"""Gates and combinators over findings that are derived from the documents, and export rows with their gates."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import rules as R

#: Words of the derived findings, by column: what doc_id modulo the first number picks (beyond the list: null).
_CHOICES = {
    "duty_force": (11, ("requires", "requires", "permits", "requires", "requires", "declares", "requires", "requires", "requires", "requires", "requires")),
    "measure_kind": (7, ("amount", "condition", "require", "retention", "presence", "other", "other")),
    "measure": (13, ("bank-account", "residual", "payment-standard", "transmission", "screening", "content", "procurement", "patent", "joint-venture", "access", "other", "other", "other")),
    "duty_act": (5, ("confide", "keep", "keep", "send", "send")),
    "duty_bearer": (17, ("operator", "patentee", "bank", "provider", "operator", "data", "operator", "carrier", "operator", "agency", "operator", "holder", "operator", "operator", "bank", "operator")),
    "bearer_kind": (6, ("private", "private", "private", "state", "private", "private")),
    "bindingness": (9, ("binding", "binding", "binding", "binding", "advisory", "binding", "binding", "binding", "binding")),
    "instrument_kind": (19, ("act", "act", "regulation", "act", "publication", "act", "rule", "act", "act", "notice", "act", "act", "act", "act", "act", "act", "act", "act", "act")),
    "authorisation": (4, ("none", "court", "unstated", "none")),
    "stated_period": (3, ("five years", "one year")),
    "place_words": (4, ("in the territory", "in the country", "at the office")),
    "located_data": (5, ("personal data", "records", "data", "accounts")),
    "information_words": (6, ("information", "data", "records", "accounts", "data")),
    "keeping_words": (5, ("kept", "stored", "held", "kept")),
    "subject_words": (8, ("telecommunications", "operator", "payments", "media", "data", "trade", "goods")),
    "border_words": (3, ("abroad", "outside the country")),
    "role_words": (4, ("an officer", "a representative", "a manager")),
    "defining_words": (5, ("shall", "must", "prohibited", "limited")),
    "imposing_words": (4, ("shall pay", "as prescribed", "must file")),
    "prescribing_words": (3, ("as prescribed", "by order", "by notice")),
}
#: Boolean columns: true where the doc_id leaves this remainder.
_FLAGS = {
    name: (k, r)
    for k, r, names in (
        (23, 3, "set_elsewhere scoped_to_office prohibits is_outline is_decision defines_a_term"),
        (29, 5, "words_merger words_excluded_content words_eligibility scoped_to_tender licence_terms held_abroad is_floor for_inspection"),
        (31, 7, "condition_is_place inherits_a_power empowers is_pointer stops_keeping place_abroad carried_subject"),
        (3, 1, "must_define subject_required proportional names_foreign locational"),
        (4, 2, "foreign_only crosses_border appoints binds_state amends_another_act"),
        (2, 0, "condition_fits defining_fits words_name_bank words_restrict words_name_standard words_electronic subject_fits carried_fits information_fits place_is_jurisdiction role_fits inserts_words may_permit"),
    )
    for name in names.split()
}


def _findings_sql() -> list[str]:
    out = ["doc_id", "source", "lang as language"]
    for name, (k, words) in _CHOICES.items():
        out.append(f"case doc_id % {k} " + " ".join(f"when {i} then '{w}'" for i, w in enumerate(words)) + f" end as {name}")
    for i, (name, (k, r)) in enumerate(_FLAGS.items()):
        out.append(f"((doc_id + {i}) % {k} = {r}) as {name}")
    out += [
        "case when doc_id % 5 = 0 then null else cast(doc_id % 500 as double) end as amount",
        "case when doc_id % 6 = 0 then null else cast(doc_id % 500 as double) * 1.5 end as usd",
        "case when doc_id % 3 = 0 then null else cast(doc_id % 100 as double) end as proportion",
        "case doc_id % 10 when 0 then false when 1 then true end as confirmed",
        "case doc_id % 12 when 0 then false else true end as subject_in_instrument",
    ]
    return out


def findings(t):
    return t("documents").selectExpr(*_findings_sql())


_F = "f AS (SELECT " + ", ".join(_findings_sql()) + " FROM documents)"


def _gates_sql() -> str:
    def pick(what):
        return "CASE " + " ".join(f"WHEN coalesce({g.condition}, false) THEN '{what(g)}'" for g in R.GATES) + " END"

    outcome = pick(lambda g: g.outcome)
    return f"WITH {_F} SELECT doc_id, {pick(lambda g: g.name)} AS gate, CASE WHEN {outcome} = 'ruled out*' THEN CASE WHEN language IN ('ru', 'mn', 'lo') THEN 'held' ELSE 'ruled out' END ELSE {outcome} END AS outcome FROM f"


@query("g_ordered_gates", _gates_sql())
def gates(t):
    return R.decided(findings(t)).select("doc_id", "gate", "outcome")


@query("g_gate_counts", f"SELECT gate, outcome, count(*) AS n FROM ({_gates_sql()}) GROUP BY ALL")
def gate_counts(t):
    return R.decided(findings(t)).groupBy("gate", "outcome").agg(F.count("*").alias("n"))


for _g in R.GATES:

    def _one(t, g=_g):
        return findings(t).where(F.coalesce(F.expr(g.condition), F.lit(False))).select("doc_id", F.lit(g.outcome).alias("outcome"))

    _one.__doc__ = f"Findings of which the gate alone says: {_g.reason}."
    query(f"{_g.name.lower()}_" + re.sub(r"[^a-z]+", "_", _g.reason.lower()).strip("_")[:40], f"WITH {_F} SELECT doc_id, '{_g.outcome}' AS outcome FROM f WHERE coalesce({_g.condition}, false)")(_one)


def _banded(name: str, column, sql: str) -> None:
    query(name, f"WITH {_F} SELECT source, language, CAST({sql} AS INTEGER) AS band FROM f GROUP BY source, language")(lambda t: findings(t).groupBy("source", "language").agg(column().cast("int").alias("band")))


_eq = lambda c, v: F.col(c) == v
_banded("b01_present", lambda: R.present(_eq("measure", "patent")), "CASE WHEN count(*) FILTER (measure = 'patent') > 0 THEN 1 ELSE 2 END")
_banded("b02_absent", lambda: R.absent(_eq("measure", "patent"), 4), "CASE WHEN count(*) FILTER (measure = 'patent') > 0 THEN 4 ELSE 1 END")
_banded("b03_escalating", lambda: R.escalating(_eq("measure", "access") & _eq("duty_force", "permits"), F.when(_eq("bearer_kind", "state"), F.col("measure"))), "CASE WHEN count(*) FILTER (measure = 'access' AND duty_force = 'permits') > 0 OR count(DISTINCT CASE WHEN bearer_kind = 'state' THEN measure END) > 1 THEN 1 WHEN count(DISTINCT CASE WHEN bearer_kind = 'state' THEN measure END) = 1 THEN 2 ELSE 3 END")
_banded("b04_escalating_by_reach", lambda: R.escalating_by_reach(_eq("measure", "content") & F.col("crosses_border"), F.when(F.col("is_outline"), F.col("measure"))), "CASE WHEN count(*) FILTER (measure = 'content' AND crosses_border) > 0 OR count(DISTINCT CASE WHEN is_outline THEN measure END) > 1 THEN 1 WHEN count(DISTINCT CASE WHEN is_outline THEN measure END) = 1 THEN 2 ELSE 3 END")
_banded("b05_scope_scaled", lambda: R.scope_scaled(_eq("duty_act", "confide") & F.col("is_floor"), F.when(F.col("is_pointer"), F.col("subject_words")), 4), "CASE WHEN count(*) FILTER (duty_act = 'confide' AND is_floor) > 0 OR count(DISTINCT CASE WHEN is_pointer THEN subject_words END) > 1 THEN 1 WHEN count(DISTINCT CASE WHEN is_pointer THEN subject_words END) > 0 THEN 2 ELSE 4 END")
_banded("b06_both_or_one", lambda: R.both_or_one(_eq("measure", "patent"), _eq("measure", "screening")), "CASE WHEN bool_or(measure = 'patent') AND bool_or(measure = 'screening') THEN 3 WHEN bool_or(measure = 'patent') OR bool_or(measure = 'screening') THEN 2 ELSE 1 END")
_banded("b07_equity_ladder", lambda: R.equity_ladder(F.col("proportion") == 0, F.col("proportion") < 3, F.col("proportion") < 30), "CASE WHEN bool_or(proportion = 0) THEN 1 WHEN bool_or(proportion < 3) THEN 2 WHEN bool_or(proportion < 30) THEN 3 ELSE 4 END")
_banded("b08_count_ladder", lambda: R.count_ladder(F.when(F.col("is_decision"), F.col("measure"))), "CASE WHEN count(DISTINCT CASE WHEN is_decision THEN measure END) >= 4 THEN 1 ELSE 4 - count(DISTINCT CASE WHEN is_decision THEN measure END) END")
_banded("b09_firm_threshold", lambda: R.firm_threshold(F.col("usd"), F.col("foreign_only")), "CASE WHEN coalesce(min(usd) FILTER (foreign_only), min(usd)) IS NULL THEN 1 WHEN coalesce(min(usd) FILTER (foreign_only), min(usd)) < 200 THEN 2 ELSE 3 END")


@query("b10_rederivation", "SELECT doc_id FROM documents WHERE doc_id % 97 = 0")
def b10(t):
    """Decide again from what is stored and compare with the record: the cells that are changed here come out, and no others."""
    record = R.decided(findings(t)).select("doc_id", F.when(F.col("doc_id") % 97 == 0, "changed").otherwise(F.col("outcome")).alias("recorded"))
    again = R.decided(findings(t)).select("doc_id", "outcome")
    return again.join(record, "doc_id").where(~F.col("outcome").eqNullSafe(F.col("recorded"))).select("doc_id")


@query("b_absence_guard", f"WITH {_F}, d AS ({_gates_sql().replace('WITH ' + _F, '').strip()}) SELECT source, coalesce(bool_or(instrument_kind = 'act' AND outcome IS NULL), false) AND count(*) FILTER (outcome = 'held') = 0 AND count(*) > 0 AS allowed FROM f JOIN d USING (doc_id) GROUP BY source")
def absence_guard(t):
    d = R.decided(findings(t))
    return d.groupBy("source").agg(R.absence_allowed((F.col("instrument_kind") == "act") & F.col("outcome").isNull(), F.col("outcome") == "held", F.lit(True)).alias("allowed"))


@query("v03_same_finding_once", f"WITH {_F} SELECT min(doc_id) AS doc_id, source, measure, lower(defining_words) AS quote_key FROM f WHERE defining_words IS NOT NULL GROUP BY source, measure, lower(defining_words)")
def v03(t):
    return findings(t).where("defining_words is not null").groupBy("source", "measure", F.lower("defining_words").alias("quote_key")).agg(F.min("doc_id").alias("doc_id"))


@query("v04_refiled", f"WITH {_F} SELECT doc_id, CASE WHEN measure = 'access' AND keeping_words IS NOT NULL THEN 'storage' WHEN measure = 'transmission' AND prohibits THEN 'condition' ELSE measure END AS measure FROM f")
def v04(t):
    refiled = F.when((F.col("measure") == "access") & F.col("keeping_words").isNotNull(), "storage").when((F.col("measure") == "transmission") & F.col("prohibits"), "condition").otherwise(F.col("measure"))
    return findings(t).select("doc_id", refiled.alias("measure"))


@query("z01_export_rows", f"""WITH {_F}, d AS ({_gates_sql().replace('WITH ' + _F, '').strip()}), c AS (SELECT source, count(*) FILTER (outcome IS NULL) AS hits, count(*) FILTER (outcome = 'held') AS held FROM f JOIN d USING (doc_id) GROUP BY source)
SELECT source, doc_id, 'restricted' AS state FROM f JOIN d USING (doc_id) WHERE outcome IS NULL UNION ALL SELECT source, NULL, CASE WHEN held > 0 THEN 'unresolved' ELSE 'no-restriction' END FROM c WHERE hits = 0""")
def z01(t):
    """One row for each basis of a restricted cell; any other cell gives one row all the same."""
    d = R.decided(findings(t))
    basis = d.where("outcome is null").select("source", "doc_id", F.lit("restricted").alias("state"))
    cells = d.groupBy("source").agg(F.count_if(F.col("outcome").isNull()).alias("hits"), F.count_if(F.col("outcome") == "held").alias("held")).where("hits = 0")
    return basis.unionByName(cells.select("source", F.lit(None).cast("long").alias("doc_id"), F.when(F.col("held") > 0, "unresolved").otherwise("no-restriction").alias("state")))


@query("z04_verification_gates", """
WITH g AS (SELECT doc_id, unnest(['quote-in-source', 'one-measure', 'in-force', 'official-host', 'score-recorded']) AS gate, unnest([contains(text, substr(text, 10, 20)), length(source) > 0, coalesce(toxic, 0) = 0, lang IN ('en', 'de', 'fr'), quality IS NOT NULL]) AS passed FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, gate, passed FROM g""")
def z04(t):
    d = t("documents").join(t("labels"), "doc_id", "left")
    checks = {
        "quote-in-source": F.contains(F.col("text"), F.substring("text", 10, 20)),
        "one-measure": F.char_length("source") > 0,
        "in-force": F.coalesce("toxic", F.lit(0)) == 0,
        "official-host": F.col("lang").isin("en", "de", "fr"),
        "score-recorded": F.col("quality").isNotNull(),
    }
    return d.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), v.alias("passed")) for k, v in checks.items()])).alias("g")).select("doc_id", "g.*")


@query("p21_export_blocked", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 0 THEN 'held' ELSE 'cleared' END AS row_state FROM labels")
def p21(t):
    return t("labels").select("doc_id", F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 0, "held").otherwise("cleared").alias("row_state"))


@query("p22_export_projection", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, concat_ws('; ', o_orderpriority, CASE WHEN o_totalprice > 200000 THEN 'large' END, CASE WHEN o_orderstatus = 'F' THEN 'closed' END) AS notes FROM orders")
def p22(t):
    notes = F.concat_ws("; ", "o_orderpriority", F.when(F.col("o_totalprice") > 200000, "large"), F.when(F.col("o_orderstatus") == "F", "closed"))
    return t("orders").select("o_orderkey", F.year("o_orderdate").alias("year"), notes.alias("notes"))
