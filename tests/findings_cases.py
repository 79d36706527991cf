"""Cases of gates on words, frameworks, rejections, coerced answers and export gates, with results worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenir.operators import findings as D
from provenir.operators import rules as R

def literal(t, rows: list[tuple], schema: str):
    return t("region").sparkSession.createDataFrame(rows, schema)


CASES: dict = {}


def query(name: str, sql: str):
    """Keep a case's function and the rows (as SQL values) that must come out."""

    def register(f):
        CASES[name] = (f, sql)
        return f

    return register


_MEASURES = [
    *[{"measure": m, "measure_kind": "other"} for m in "plain bank-account residual payment-standard transmission screening content procurement patent joint-venture access".split()],
    *[{"measure": m, "measure_kind": m} for m in "amount condition require retention presence".split()],
    {"measure": "defined", "defines": "that something is kept secret", "must_say": "secret"},
    {"measure": "telecoms", "subject": "telecom"},
    {"measure": "equity", "proportional": True},
    {"measure": "foreign-borne", "foreign_only": True},
    {"measure": "local", "locational": True},
    {"measure": "cross", "crosses_border": True},
    {"measure": "officer", "appoints": True},
    {"measure": "power", "binds_state": True},
    {"measure": "licence", "may_permit": True},
]
_BASE = {
    "language": "en", "heading": "Duties", "quote": "An operator must notify the Minister of any change", "instrument_kind": "act", "bindingness": "binding", "measure": "plain",
    "duty_force": "requires", "duty_bearer": "operator", "bearer_kind": "private", "duty_act": "notify",
}
_KEPT = {"measure": "local", "place_words": "in the territory", "located_data": "customer data", "keeping_words": "kept", "quote": "Customer data must be kept in the territory"}

#: (gate that decides, its outcome, what the reading states beside ``_BASE``)
_CASES: list[tuple[str | None, str | None, dict]] = [
    (None, None, {}),
    ("G01", "ruled out", {"duty_force": "declares"}),
    ("G02", "ruled out", {"measure": "amount"}),
    (None, None, {"measure": "amount", "quote": "A fee must be paid as prescribed"}),
    ("G03", "ruled out", {"measure": "condition", "condition_words": "a fee"}),
    (None, None, {"measure": "condition", "condition_words": "a minimum paid-up capital"}),
    ("G04", "ruled out", {"duty_act": "confide", "quote": "What is learnt by virtue of this Act must stay secret"}),
    (None, None, {"duty_act": "confide", "quote": "A bank must keep what its customers say secret"}),
    ("G05", "ruled out", {"measure": "require", "quote": "No person shall use encryption"}),
    ("G06", "held", {"duty_bearer": None}),
    ("G07", "ruled out", {"measure": "defined"}),
    ("G08", "ruled out", {"measure": "retention"}),
    ("G08", "held", {"measure": "retention", "language": "ru"}),
    ("G09", "held", {"heading": "Simplified outline of this Part"}),
    ("G10", "held", {"quote": "The respondent must pay the costs"}),
    ("G11", "held", {"instrument_kind": "publication"}),
    ("G12", "held", {"quote": "Operator means a person who must hold a licence"}),
    ("G13", "ruled out", {"confirmed": False}),
    ("G14", "held", {"measure": "defined", "defining_words": "секрет", "language": "ru"}),
    ("G15", "ruled out", {"measure": "defined", "defining_words": "a notice"}),
    (None, None, {"measure": "defined", "defining_words": "must be kept Secret"}),
    ("G16", "ruled out", {"measure": "bank-account", "quote": "An operator must keep an account"}),
    (None, None, {"measure": "bank-account", "quote": "An operator must keep an account with a local Bank."}),
    ("G17", "ruled out", {"measure": "residual", "quote": "An operator is encouraged to report"}),
    ("G18", "ruled out", {"measure": "payment-standard", "quote": "An operator must use the national scheme"}),
    (None, None, {"measure": "payment-standard", "quote": "An operator must meet the national payment standard"}),
    ("G19", "ruled out", {"measure": "transmission", "quote": "An operator must deliver it by hand"}),
    ("G20", "ruled out", {"measure": "screening", "quote": "An acquirer must notify a merger"}),
    (None, None, {"measure": "screening", "quote": "A foreign acquirer must notify a merger"}),
    ("G21", "ruled out", {"measure": "content", "quote": "An operator must remove political advertising"}),
    ("G22", "ruled out", {"measure": "procurement", "quote": "An operator must lodge a bid security"}),
    ("G23", "ruled out", {"measure": "presence"}),
    ("G24", "ruled out", {"measure": "patent"}),
    ("G25", "ruled out", {"measure": "telecoms"}),
    ("G26", "ruled out", {"measure": "telecoms", "subject_words": "operator"}),
    ("G27", "held", {"measure": "telecoms", "subject_words": "харилцаа", "language": "mn"}),
    ("G28", "ruled out", {"measure": "telecoms", "subject_words": "payments"}),
    (None, None, {"measure": "telecoms", "subject_words": "Telecommunications networks"}),
    ("G29", "ruled out", {"quote": "An importer must mark goods of this class"}),
    ("G30", "ruled out", {"subject_in_instrument": False}),
    ("G30", "held", {"subject_in_instrument": False, "language": "lo"}),
    ("G31", "held", {"measure": "equity"}),
    ("G32", "ruled out", {"measure": "equity", "proportion": 30.0}),
    ("G33", "ruled out", {"measure": "foreign-borne"}),
    (None, None, {"measure": "foreign-borne", "duty_bearer": "foreign operator"}),
    ("G34", "ruled out", {"measure": "joint-venture", "quote": "A tenderer must form a joint venture"}),
    ("G35", "ruled out", {"measure": "presence", "place_words": "a seat abroad"}),
    (None, None, {"measure": "presence", "place_words": "an office in the capital"}),
    ("G36", "ruled out", {"measure": "patent", "duty_bearer": "patentee", "quote": "The patentee must not raise royalties"}),
    ("G37", "ruled out", {"measure": "equity", "proportion": 20.0, "duty_bearer": "board", "subject_words": "stake in a foreign company", "held_words": "a foreign company"}),
    ("G38", "ruled out", {"measure": "equity", "proportion": 51.0, "duty_bearer": "foreign investor", "quote": "A foreign investor must hold at least 51 per cent"}),
    (None, None, {"measure": "equity", "proportion": 49.0, "duty_bearer": "foreign investor", "quote": "A foreign investor must not hold over 49 per cent"}),
    ("G39", "ruled out", _KEPT | {"quote": "A copy of the data must be kept in the territory for inspection"}),
    ("G40", "ruled out", {"measure": "cross", "condition_words": "outside the country", "border_words": "outside the country"}),
    ("G41", "ruled out", {"stem": "The Minister may by order prescribe"}),
    ("G42", "ruled out", {"quote": "The Minister may make regulations on operators"}),
    ("G43", "ruled out", {"quote": "The Minister may prescribe fees", "imposing_words": "may prescribe", "prescribing_words": "may prescribe"}),
    (None, None, {"quote": "Operators must pay fees that the Minister may prescribe", "imposing_words": "must pay", "prescribing_words": "may prescribe"}),
    ("G44", "ruled out", {"measure": "local"}),
    ("G45", "ruled out", _KEPT | {"located_data": None}),
    ("G46", "ruled out", _KEPT | {"located_data": "the machine", "quote": "The machine must be kept in the territory"}),
    ("G47", "ruled out", _KEPT | {"keeping_words": None}),
    ("G48", "ruled out", _KEPT | {"duty_bearer": "customer data"}),
    ("G49", "ruled out", _KEPT | {"located_data": "the machine", "quote": "The machine and its records must be kept in the territory"}),
    ("G49", "held", _KEPT | {"located_data": "the machine", "quote": "The machine and its records must be kept in the territory", "language": "lo"}),
    ("G50", "ruled out", _KEPT | {"place_words": "at the office"}),
    (None, None, _KEPT),
    ("G51", "ruled out", {"quote": "An operator must comply with the rules made for it"}),
    ("G52", "ruled out", {"measure": "cross"}),
    ("G53", "ruled out", {"measure": "officer"}),
    ("G54", "ruled out", {"measure": "officer", "role_words": "a company secretary"}),
    (None, None, {"measure": "officer", "role_words": "a data protection officer"}),
    ("G55", "ruled out", {"bearer_kind": "state"}),
    ("G56", "ruled out", {"measure": "power"}),
    (None, None, {"measure": "power", "bearer_kind": "state"}),
    ("G57", "ruled out", {"quote": "Section 3 of that Act is amended"}),
    (None, None, {"quote": "Section 3 of that Act is amended: insert what operators must do"}),
    ("G58", "ruled out", {"bindingness": "advisory"}),
    ("G59", "ruled out", {"duty_force": "permits"}),
    (None, None, {"measure": "licence", "duty_force": "permits"}),
    ("G60", "ruled out", {"measure": "retention", "stated_period": "one year", "quote": "Records must be kept no longer than one year"}),
    (None, None, {"measure": "retention", "stated_period": "one year", "quote": "Records must be kept for one year"}),
    ("G61", "held", {"measure": "access", "authorisation": "court"}),
    ("G62", "held", {"measure": "amount", "amount": 100.0}),
    (None, None, {"measure": "amount", "amount": 100.0, "usd": 150.0}),
]
_FLAGS = "locational crosses_border appoints proportional foreign_only binds_state may_permit".split()
_TEXTS = "measure measure_kind defines must_say subject".split()


def measures(t):
    rows = [tuple(m.get(c) for c in _TEXTS) + tuple(m.get(c, False) for c in _FLAGS) for m in _MEASURES]
    return literal(t, rows, ", ".join([f"{c} string" for c in _TEXTS] + [f"{c} boolean" for c in _FLAGS]))


def readings(t):
    """The cases as readings, numbered from 1."""
    other = {"amount": "double", "usd": "double", "proportion": "double", "confirmed": "boolean", "subject_in_instrument": "boolean"}
    rows = [(i + 1, *[({**_BASE, **said}).get(c) for c in [*D.WORDINGS, *other]]) for i, (_, _, said) in enumerate(_CASES)]
    return literal(t, rows, "id int, " + ", ".join([f"{c} string" for c in D.WORDINGS] + [f"{c} {k}" for c, k in other.items()]))


def _sql(v: str | None) -> str:
    return "NULL" if v is None else f"'{v}'"


@query("g_gates_on_words", "SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, {_sql(g)}, {_sql(o)})" for i, (g, o, _) in enumerate(_CASES)) + ") v(id, gate, outcome)")
def gates_on_words(t):
    """Each of the gates decides a provision by its words; near misses pass."""
    return R.decided(D.judged(readings(t), measures(t))).select("id", "gate", "outcome")


@query("b08_framework_decision", """SELECT * FROM (VALUES
('a', 'restricted', 3, 'across sectors: Data Act, Privacy Act'), ('b', 'restricted', 2, 'limited in reach or subject: Bank Data Rules'), ('c', 'restricted', 2, 'scored without regard to reach: Consumer Act'),
('d', 'unresolved', NULL, 'about another subject: Cyber Act'), ('e', 'unresolved', NULL, '2 could not be read'), ('f', 'no-restriction', 1, 'none of 4 examined'), ('g', 'restricted', 2, 'limited in reach or subject: Data Act'),
('h', 'no-restriction', 1, 'none of 5 examined'), ('i', 'restricted', 3, 'dedicated, across sectors: Cyber Act')) v(cell, state, ordinal, reason)""")
def b08_framework(t):
    cells = [("a", 3, False, "data|privacy", None, 1, 4), ("b", 3, False, "data", None, 0, 4), ("c", 2, False, None, None, 0, 4), ("d", 3, False, "data", None, 3, 4), ("e", 3, False, None, None, 2, 4), ("f", 3, False, None, None, 0, 4), ("g", 3, True, None, None, 0, 4), ("h", 3, False, None, None, 0, 5), ("i", 3, True, None, "privacy", 0, 4)]
    found = [
        ("a", 2, "Privacy Act", True, False, True, True, "binding", True),
        ("a", 1, "Data Act", True, None, False, None, "binding", True),
        ("a", 3, "Bank Data Rules", True, True, False, None, "binding", False),
        ("b", 1, "Bank Data Rules", True, True, None, None, None, False),
        ("b", 2, "Data Guide", True, True, None, None, "advisory", True),
        ("c", 1, "Consumer Act", True, True, None, None, "binding", False),
        ("d", 1, "Cyber Act", True, True, None, None, "binding", True),
        ("e", 1, "Data Act", False, None, None, None, "binding", True),
        ("f", 1, "Data Guide", True, True, None, None, "advisory", True),
        ("g", 1, "Data Act", True, True, True, None, "binding", True),
        ("h", 1, "Data Act", True, False, True, False, "binding", True),
        ("i", 1, "Cyber Act", True, True, True, True, "binding", True),
        ("i", 2, "Privacy Act", True, True, True, True, "binding", True),
    ]
    c = literal(t, cells, "cell string, bands int, needs_dedicated boolean, must string, must_not string, unread int, examined int")
    return D.frameworks_decided(c, literal(t, found, "cell string, place int, title string, establishes boolean, shown boolean, dedicated boolean, dedicated_shown boolean, binding string, across_sectors boolean"))


_TEXT = "Part 1. The operator must keep its data in the territory for five years."
_GOOD = {
    "section_id": 7, "quote": "must keep its data", "section_text": _TEXT, "doc_text": _TEXT, "start": 21, "stop": 39, "url": "https://laws.example.org/act#s1", "hosts": ["example.org"], "status": "in-force",
    "status_basis": "register", "last_amended": "2020", "timeframe_basis": "gazette", "notes": "Measure: local", "rationale": "“must keep its data” binds operators", "state": "restricted", "band": 2, "score": 0.5, "recomputed": True,
}
_FRAME = {"quote": "the  operator must", "framework_text": _TEXT, "framework_verified": True, "url": "http://www.moj.gov.xx/a", "hosts": [], "status": "in-force", "status_basis": "register", "state": "restricted", "band": 1, "score": 0.0}
#: (gates that a row fails, gates that it is put to, the row)
_EXPORTS = [
    ("", 10, _GOOD),
    ("quote-in-source offsets-resolve", 10, _GOOD | {"quote": "may keep its data"}),
    ("offsets-resolve", 10, _GOOD | {"start": 22}),
    ("offsets-resolve", 10, _GOOD | {"start": None}),
    ("", 10, _GOOD | {"quote": "the operator must keep its data ... for five years", "start": 8, "stop": 71}),
    ("pinpoint-citation official-host", 10, _GOOD | {"url": "https://notexample.org/act"}),
    ("in-force", 10, _GOOD | {"status_basis": None}),
    ("in-force", 10, _GOOD | {"status": "repealed"}),
    ("timeframe-evidenced", 10, _GOOD | {"timeframe_basis": " "}),
    ("", 10, _GOOD | {"last_amended": None, "timeframe_basis": None}),
    ("one-measure", 10, _GOOD | {"notes": "Measure: a; Measure: b"}),
    ("quote-leads", 10, _GOOD | {"rationale": "It binds operators: “must keep its data”"}),
    ("score-recorded score-recomputes", 10, _GOOD | {"score": None, "recomputed": False}),
    ("", 5, _FRAME),
    ("framework-quote-verified quote-in-source", 5, _FRAME | {"quote": "the operator may", "framework_verified": None}),
    ("official-host score-recorded", 2, {"state": "no-restriction"}),
    ("", 0, {"state": "unresolved"}),
]
_EXPORT_SCHEMA = (
    "row_id int, section_id int, quote string, section_text string, doc_text string, start int, stop int, url string, hosts array<string>, status string, status_basis string, last_amended string, timeframe_basis string, notes string, "
    "rationale string, state string, band int, score double, recomputed boolean, framework_text string, framework_verified boolean"
)


@query("z04_export_gates", "SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, '{', '.join(sorted(f.split()))}', {n})" for i, (f, n, _) in enumerate(_EXPORTS) if n) + ") v(row_id, failed, gates)")
def z04_export(t):
    """All eleven gates on export rows that cite provisions, frameworks, or nothing."""
    names = [c.split()[0] for c in _EXPORT_SCHEMA.split(", ")][1:]
    rows = literal(t, [(i + 1, *[r.get(c) for c in names]) for i, (_, _, r) in enumerate(_EXPORTS)], _EXPORT_SCHEMA)
    failed = F.array_join(F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("gate")))), ", ")
    return D.verified(rows).groupBy("row_id").agg(failed.alias("failed"), F.count("*").cast("int").alias("gates"))


_READING = {
    "allowed": True, "text": "1. The operator must keep personal data – in the territory.", "heading": "Data kept by banks", "quote": "must keep personal data", "measure": "local", "gloss": "a requirement that data stay in the economy",
    "name": "data localisation", "scope_stated": True, "sector_scope": "all",
}
_REJECTIONS: list[tuple[str | None, dict]] = [
    (None, {}),
    ("not asked", {"allowed": False}),
    ("quote not in the provision", {"quote": "may keep personal data"}),
    ("quote not in the provision", {"quote": None}),
    ("no measure named", {"measure": None}),
    (None, {"duty_bearer": "The Operator"}),
    (None, {"duty_bearer": "banks"}),
    ("party not in the provision", {"duty_bearer": "a carrier"}),
    (None, {"duty_act": "xy"}),
    (None, {"duty_act": "must ... data"}),
    ("act not in the provision", {"duty_act": "data ... must"}),
    (None, {"place_words": "data - in the   territory"}),
    ("place not in the provision", {"place_words": "in"}),
    ("exception not in the provision", {"exception_words": "unless consent is given"}),
    ("data not in the provision", {"located_data": "health records"}),
    ("information not in the provision", {"information_words": "accounts"}),
    ("keeping not in the provision", {"keeping_words": "stored"}),
    ("authority not in the provision", {"authorising_words": "a warrant"}),
    ("position not in the provision", {"role_words": "data officer"}),
    ("repeats the catalogue", {"defining_words": "Data stay in the economy"}),
    (None, {"defining_words": "data stay in the economy", "name": "personal data"}),
    ("measure not in the provision", {"defining_words": "kept here"}),
    ("border not in the provision", {"border_words": "abroad"}),
    ("requirement not in the provision", {"imposing_words": "shall"}),
    ("empowerment not in the provision", {"prescribing_words": "may prescribe"}),
    ("reach not stated", {"scope_stated": None}),
    ("no sector named", {"sector_scope": "specific"}),
    (None, {"sector_scope": "specific", "sector": "banking"}),
    ("target not in the provision", {"target_words": "foreign firms"}),
    ("condition not in the provision", {"condition_words": "with consent"}),
    ("party not in the provision", {"duty_bearer": "a carrier", "condition_words": "with consent"}),
]


@query("v01_rejections", "SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, {_sql(r)})" for i, (r, _) in enumerate(_REJECTIONS)) + ") v(id, rejection)")
def v01(t):
    """Why a reading does not count, by the first reason that holds."""
    kinds = {"allowed": "boolean", "scope_stated": "boolean"}
    names = ["allowed", "text", "heading", "quote", "measure", "gloss", "name", "scope_stated", "sector_scope", "sector", *[c for c, _ in D.CLAIMS if c[0] != "="]]
    rows = [(i + 1, *[(_READING | said).get(c) for c in names]) for i, (_, said) in enumerate(_REJECTIONS)]
    return D.rejected(literal(t, rows, "id int, " + ", ".join(f"{c} {kinds.get(c, 'string')}" for c in names))).select("id", "rejection")


@query("v02_answers_coerced", """SELECT * FROM (VALUES (1, false, '7.5', 'must keep', 'access', NULL), (2, false, '6.1', 'must keep', 'storage', NULL), (3, false, '9.9', 'must keep', NULL, NULL), (4, true, NULL, NULL, NULL, NULL), (5, true, NULL, NULL, NULL, NULL),
(6, false, '6.1', 'x', NULL, 'duty_force, mandatory, bearer'), (7, true, NULL, NULL, NULL, NULL)) v(id, unreadable, indicator, quote, measure, missing)""")
def v02_coerced(t):
    facts = '"duty_force": "requires", "mandatory": true, "bearer": "organisation"'
    rows = [
        (1, '{"indicator": "7.3", "quote": "must keep", "measure": " access ", ' + facts + "}"),
        (2, '{"indicator": "6.1", "quote": " must keep ", "measure": "storage", ' + facts + "}"),
        (3, '{"indicator": "9.9", "quote": "must keep", "measure": "storage", ' + facts + "}"),
        (4, '{"indicator": "6.1", "quote": " N/A ", "measure": "storage", ' + facts + "}"),
        (5, "not an object"),
        (6, '{"indicator": "6.1", "quote": "x", "measure": "none", "duty_force": "suggests"}'),
        (7, None),
    ]
    known = literal(t, [("7.5", "access"), ("6.1", "storage"), ("6.2", "storage")], "indicator string, measure string")
    return D.coerced(literal(t, rows, "id int, answer string"), known)
