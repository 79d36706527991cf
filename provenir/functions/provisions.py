"""Measures and provisions that exercise every gate: what queries plant in the given texts (fixed values)."""

from __future__ import annotations

#: What the measures ask of a provision; what is not named is null or false.
MEASURES = [
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
#: What a planted provision states unless it says otherwise.
BASE = {
    "language": "en", "heading": "Duties", "quote": "An operator must notify the Minister of any change", "instrument_kind": "act", "bindingness": "binding", "measure": "plain",
    "duty_force": "requires", "duty_bearer": "operator", "bearer_kind": "private", "duty_act": "notify",
}
KEPT = {"measure": "local", "place_words": "in the territory", "located_data": "customer data", "keeping_words": "kept", "quote": "Customer data must be kept in the territory"}
#: What each planted provision states beside ``BASE``: one or more for each gate, and near misses.
PROVISIONS: list[dict] = [
    {},
    {"duty_force": "declares"},
    {"measure": "amount"},
    {"measure": "amount", "quote": "A fee must be paid as prescribed"},
    {"measure": "condition", "condition_words": "a fee"},
    {"measure": "condition", "condition_words": "a minimum paid-up capital"},
    {"duty_act": "confide", "quote": "What is learnt by virtue of this Act must stay secret"},
    {"duty_act": "confide", "quote": "A bank must keep what its customers say secret"},
    {"measure": "require", "quote": "No person shall use encryption"},
    {"duty_bearer": None},
    {"measure": "defined"},
    {"measure": "retention"},
    {"measure": "retention", "language": "ru"},
    {"heading": "Simplified outline of this Part"},
    {"quote": "The respondent must pay the costs"},
    {"instrument_kind": "publication"},
    {"quote": "Operator means a person who must hold a licence"},
    {"confirmed": False},
    {"measure": "defined", "defining_words": "секрет", "language": "ru"},
    {"measure": "defined", "defining_words": "a notice"},
    {"measure": "defined", "defining_words": "must be kept Secret"},
    {"measure": "bank-account", "quote": "An operator must keep an account"},
    {"measure": "bank-account", "quote": "An operator must keep an account with a local Bank."},
    {"measure": "residual", "quote": "An operator is encouraged to report"},
    {"measure": "payment-standard", "quote": "An operator must use the national scheme"},
    {"measure": "payment-standard", "quote": "An operator must meet the national payment standard"},
    {"measure": "transmission", "quote": "An operator must deliver it by hand"},
    {"measure": "screening", "quote": "An acquirer must notify a merger"},
    {"measure": "screening", "quote": "A foreign acquirer must notify a merger"},
    {"measure": "content", "quote": "An operator must remove political advertising"},
    {"measure": "procurement", "quote": "An operator must lodge a bid security"},
    {"measure": "presence"},
    {"measure": "patent"},
    {"measure": "telecoms"},
    {"measure": "telecoms", "subject_words": "operator"},
    {"measure": "telecoms", "subject_words": "харилцаа", "language": "mn"},
    {"measure": "telecoms", "subject_words": "payments"},
    {"measure": "telecoms", "subject_words": "Telecommunications networks"},
    {"quote": "An importer must mark goods of this class"},
    {"subject_in_instrument": False},
    {"subject_in_instrument": False, "language": "lo"},
    {"measure": "equity"},
    {"measure": "equity", "proportion": 30.0},
    {"measure": "foreign-borne"},
    {"measure": "foreign-borne", "duty_bearer": "foreign operator"},
    {"measure": "joint-venture", "quote": "A tenderer must form a joint venture"},
    {"measure": "presence", "place_words": "a seat abroad"},
    {"measure": "presence", "place_words": "an office in the capital"},
    {"measure": "patent", "duty_bearer": "patentee", "quote": "The patentee must not raise royalties"},
    {"measure": "equity", "proportion": 20.0, "duty_bearer": "board", "subject_words": "stake in a foreign company", "held_words": "a foreign company"},
    {"measure": "equity", "proportion": 51.0, "duty_bearer": "foreign investor", "quote": "A foreign investor must hold at least 51 per cent"},
    {"measure": "equity", "proportion": 49.0, "duty_bearer": "foreign investor", "quote": "A foreign investor must not hold over 49 per cent"},
    KEPT | {"quote": "A copy of the data must be kept in the territory for inspection"},
    {"measure": "cross", "condition_words": "outside the country", "border_words": "outside the country"},
    {"stem": "The Minister may by order prescribe"},
    {"quote": "The Minister may make regulations on operators"},
    {"quote": "The Minister may prescribe fees", "imposing_words": "may prescribe", "prescribing_words": "may prescribe"},
    {"quote": "Operators must pay fees that the Minister may prescribe", "imposing_words": "must pay", "prescribing_words": "may prescribe"},
    {"measure": "local"},
    KEPT | {"located_data": None},
    KEPT | {"located_data": "the machine", "quote": "The machine must be kept in the territory"},
    KEPT | {"keeping_words": None},
    KEPT | {"duty_bearer": "customer data"},
    KEPT | {"located_data": "the machine", "quote": "The machine and its records must be kept in the territory"},
    KEPT | {"located_data": "the machine", "quote": "The machine and its records must be kept in the territory", "language": "lo"},
    KEPT | {"place_words": "at the office"},
    KEPT,
    {"quote": "An operator must comply with the rules made for it"},
    {"measure": "cross"},
    {"measure": "officer"},
    {"measure": "officer", "role_words": "a company secretary"},
    {"measure": "officer", "role_words": "a data protection officer"},
    {"bearer_kind": "state"},
    {"measure": "power"},
    {"measure": "power", "bearer_kind": "state"},
    {"quote": "Section 3 of that Act is amended"},
    {"quote": "Section 3 of that Act is amended: insert what operators must do"},
    {"bindingness": "advisory"},
    {"duty_force": "permits"},
    {"measure": "licence", "duty_force": "permits"},
    {"measure": "retention", "stated_period": "one year", "quote": "Records must be kept no longer than one year"},
    {"measure": "retention", "stated_period": "one year", "quote": "Records must be kept for one year"},
    {"measure": "access", "authorisation": "court"},
    {"measure": "amount", "amount": 100.0},
    {"measure": "amount", "amount": 100.0, "usd": 150.0},
]
