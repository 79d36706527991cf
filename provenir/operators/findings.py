"""Readings turned into findings that the gates can judge; frameworks decided; export rows verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import passages as P
from ..functions.lexicon import says
from ..functions.text import quote_key

#: What a reading of a provision states in words, each a string column; ``judged`` reads them.
WORDINGS = (
    "language heading quote instrument_kind bindingness measure duty_force duty_bearer bearer_kind duty_act defining_words subject_words place_words located_data "
    "keeping_words border_words role_words imposing_words prescribing_words condition_words held_words stem stated_period authorisation"
).split()


def worded(readings: DataFrame) -> DataFrame:
    """``readings`` with the columns that the gates read in their wordings alone, whatever the measure."""
    words = F.concat_ws(" ", "quote", "defining_words")
    flags = {
        "set_elsewhere": says("quote", "elsewhere"),
        "condition_fits": says("condition_words", "condition"),
        "scoped_to_office": says("quote", "office"),
        "prohibits": says("quote", "prohibition"),
        "is_outline": says("heading", "outline"),
        "is_decision": says("quote", "decision"),
        "defines_a_term": says("quote", "definition"),
        "words_name_bank": says(words, "bank"),
        "words_restrict": says(words, "restriction"),
        "words_name_standard": says(words, "standard"),
        "words_electronic": says(words, "electronic"),
        "words_merger": says(words, "merger") & ~says(words, "foreign"),
        "words_excluded_content": says(words, "excluded content"),
        "words_eligibility": says(words, "eligibility"),
        "place_abroad": says("place_words", "foreign") | F.coalesce(F.lower("place_words").contains("abroad"), F.lit(False)),
        "carried_subject": F.coalesce(F.lower("quote").contains("goods of this class"), F.lit(False)),
        "names_foreign": says(F.concat_ws(" ", "duty_bearer", "defining_words", "subject_words", "quote"), "foreign"),
        "scoped_to_tender": says("quote", "tender"),
        "licence_terms": says("quote", "licence terms"),
        "held_abroad": says("held_words", "foreign") & ~says("duty_bearer", "foreign"),
        "is_floor": says("quote", "floor"),
        "for_inspection": says("quote", "inspection"),
        "condition_is_place": F.coalesce(says("condition_words", "place") & (F.lower("condition_words") == F.lower("border_words")), F.lit(False)),
        "inherits_a_power": says("stem", "empowering"),
        "empowers": says("quote", "empowering"),
        "information_words": F.when(says(F.concat_ws(" ", "located_data", "quote"), "information"), F.col("located_data")),
        "information_fits": says("located_data", "information"),
        "place_is_jurisdiction": says("place_words", "place"),
        "is_pointer": says("quote", "pointing"),
        "role_fits": says("role_words", "data officer"),
        "amends_another_act": F.coalesce(F.lower("quote").rlike(r"(?:^|[^a-z])(?:is|are) amended(?:[^a-z]|$)"), F.lit(False)),
        "inserts_words": says("quote", "inserting"),
        "stops_keeping": says("quote", "cease"),
    }
    return readings.withColumns(flags)


def judged(readings: DataFrame, measures: DataFrame) -> DataFrame:
    """``readings`` with the columns that the gates read, found in their wordings and in what their measure asks.

    ``measures`` is a dimension of some hundred rows: measure, measure_kind, defines, must_say (a
    pattern of what the defining words have to say), subject (a pattern), and booleans locational,
    crosses_border, appoints, proportional, foreign_only, binds_state, may_permit. Readings without a
    column ``measure`` are held to every measure; their words are searched once.
    """
    d = worded(readings)
    if "measure" in readings.columns:
        d = d.join(F.broadcast(measures), "measure", "left")
    else:  # exploded behind the words: a join with many rows would search the words again for each of them
        every = measures.agg(F.collect_list(F.struct(*measures.columns)).alias("_asked"))
        d = d.crossJoin(F.broadcast(every)).withColumn("_asked", F.explode("_asked")).select("*", "_asked.*").drop("_asked")
    subject, named = F.lower("subject_words"), F.lower("defining_words")
    flags = {
        "must_define": F.col("defines").isNotNull(),
        "defining_fits": F.coalesce(F.rlike(named, F.col("must_say")), F.col("must_say").isNull()),
        "subject_required": F.col("subject").isNotNull(),
        "subject_fits": F.coalesce(F.rlike(subject, F.col("subject")), F.lit(False)),
        "carried_fits": F.coalesce(F.rlike(F.lower("heading"), F.col("subject")), F.lit(False)),
    }
    return d.withColumns(flags)


#: Answers that mean that nothing was stated (fixed values).
NOTHING = r"(?i)^\s*(?:null|none|nil|n/?a|-+|\(none\)|unknown|unspecified|not (?:stated|specified|applicable|mentioned))?\.?\s*$"
#: What each wording of a reading is said to state, in the order in which they are asked; "=" marks steps of their own.
CLAIMS = (
    ("duty_bearer", "party"), ("duty_act", "act"), ("place_words", "place"), ("exception_words", "exception"), ("located_data", "data"), ("information_words", "information"), ("keeping_words", "keeping"),
    ("authorising_words", "authority"), ("role_words", "position"), ("=echo", ""), ("defining_words", "measure"), ("border_words", "border"), ("imposing_words", "requirement"), ("prescribing_words", "empowerment"),
    ("=scope", ""), ("target_words", "target"), ("condition_words", "condition"),
)


def coerced(answers: DataFrame, measures: DataFrame) -> DataFrame:
    """(id, answer) as readings: id, unreadable, indicator, quote, measure, missing.

    ``measures``: a small dimension of (indicator, measure). A measure of one indicator only names its
    indicator, whatever the answer says; a measure that the indicator does not have is null.
    ``missing`` lists the facts that a reading must state and this one does not.
    """
    schema = "indicator string, quote string, measure string, duty_force string, mandatory boolean, bearer string"
    d = answers.select("id", F.from_json("answer", schema).alias("a")).select("id", "a.*")
    d = d.withColumns({c: F.when(~F.col(c).rlike(NOTHING), F.trim(c)) for c in ("indicator", "quote", "measure")})
    has = measures.groupBy("measure").agg(F.collect_set("indicator").alias("owners"))
    d = d.join(F.broadcast(has), "measure", "left")
    readable = F.col("indicator").isNotNull() & F.col("quote").isNotNull()
    filed = F.when(F.size("owners") == 1, F.col("owners")[0]).otherwise(F.col("indicator"))
    facts = {"duty_force": ("requires", "forbids", "permits", "declares"), "bearer": ("government", "organisation", "individual")}
    stated = {"duty_force": F.col("duty_force").isin(*facts["duty_force"]), "mandatory": F.col("mandatory").isNotNull(), "bearer": F.col("bearer").isin(*facts["bearer"])}
    missing = F.concat_ws(", ", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(c)) for c, ok in stated.items()])
    d = d.select("id", readable.alias("ok"), filed.alias("indicator"), "quote", "measure", "owners", missing.alias("missing"))
    known = F.when(F.array_contains("owners", F.col("indicator")), F.col("measure"))
    return d.select("id", (~F.col("ok")).alias("unreadable"), *[F.when(F.col("ok"), c).alias(n) for n, c in (("indicator", F.col("indicator")), ("quote", F.col("quote")), ("measure", known), ("missing", F.nullif("missing", F.lit(""))))])


def rejected(readings: DataFrame) -> DataFrame:
    """``readings`` with ``rejection``: the first reason for which a reading does not count, else null.

    Columns: allowed (whether the indicator was asked), text and heading of the provision, quote,
    measure, gloss (the catalogue's description of the measure), name (a pattern of its name),
    scope_stated, sector_scope, sector, and the wordings of ``CLAIMS``. Words count if the provision,
    its heading or (but for the party) the quote holds them; a null wording claims nothing. Words that
    only repeat the catalogue are no words of the provision, unless the quote names the measure.
    """
    text, heading, quote = (P.folded(F.coalesce(c, F.lit(""))) for c in ("text", "heading", "quote"))
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    said, gloss = plain("defining_words"), plain("gloss")
    echo = (F.char_length(said) >= 15) & (F.char_length(gloss) >= 15) & (F.contains(gloss, said) | F.contains(said, gloss))
    named = F.coalesce(F.rlike(F.lower("quote"), F.col("name")), F.lit(False))
    reasons = [
        F.when(~F.coalesce("allowed", F.lit(False)), "not asked"),
        F.when(P.quote_span(F.col("text"), F.col("quote")).isNull(), "quote not in the provision"),
        F.when(F.col("measure").isNull(), "no measure named"),
    ]
    for column, what in CLAIMS:
        if column == "=echo":
            reasons.append(F.when(echo & ~named, "repeats the catalogue"))
        elif column == "=scope":
            reasons.append(F.when(~F.coalesce("scope_stated", F.lit(False)), "reach not stated"))
            reasons.append(F.when((F.col("sector_scope") == "specific") & F.col("sector").isNull(), "no sector named"))
        else:
            held = P.phrase_in(text, F.col(column)) | P.phrase_in(heading, F.col(column))
            if column != "duty_bearer":
                held = held | P.phrase_in(quote, F.col(column))
            claimed = F.col(column).isNotNull()
            if column == "duty_act":  # an act of one or two letters says nothing that could be looked for
                claimed = F.char_length(F.trim(column)) >= P.FRAGMENT
            if column == "defining_words":  # by now an echo is one whose quote names the measure
                claimed = claimed & ~F.coalesce(echo, F.lit(False))
            reasons.append(F.when(claimed & ~held, f"{what} not in the provision"))
    return readings.withColumn("rejection", F.coalesce(*reasons))


def frameworks_decided(cells: DataFrame, found: DataFrame) -> DataFrame:
    """What the frameworks found for each cell make of it: state, ordinal of the band, reason.

    ``cells``: cell, bands, needs_dedicated, must, must_not (patterns of titles or null), unread,
    examined. ``found``: cell, place, title, establishes, shown, dedicated, dedicated_shown, binding,
    across_sectors. A claim counts unless it was looked for and not shown, and only if it is law;
    one named for another subject is no evidence of absence.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    dedicated = yes("dedicated") & yes("dedicated_shown")
    claimed = yes("establishes") & (F.coalesce("shown", F.lit(True)) | dedicated) & ~F.col("binding").eqNullSafe("advisory")
    low = F.lower("title")
    on_subject = F.coalesce(F.rlike(low, F.col("must")), F.lit(True)) & ~F.coalesce(F.rlike(low, F.col("must_not")), F.lit(False))
    clears = yes("across_sectors") & (~yes("needs_dedicated") | dedicated)
    d = cells.join(found, "cell", "left").withColumn("rank", F.when(claimed & on_subject & clears, 1).when(claimed & on_subject, 2).when(claimed, 3))

    def titles(rank: int) -> Column:
        named = F.sort_array(F.collect_list(F.when(F.col("rank") == rank, F.struct("place", "title"))))
        return F.array_join(F.transform(named, lambda x: x["title"]), ", ")

    keys = ["cell", "bands", "needs_dedicated", "unread", "examined"]
    g = d.groupBy(*keys).agg(F.min("rank").alias("best"), *[titles(i).alias(f"t{i}") for i in (1, 2, 3)])
    middle = F.when(F.col("bands") > 2, F.col("bands") - 1).otherwise(F.col("bands"))
    best = F.col("best")
    unread = best.isNull() & (F.col("unread") > 0)
    ordinal = F.when(best == 1, F.col("bands")).when(best == 2, middle).when(best.isNull() & ~unread, F.lit(1))
    reason = (
        F.when((best == 1) & yes("needs_dedicated"), F.concat(F.lit("dedicated, across sectors: "), "t1"))
        .when(best == 1, F.concat(F.lit("across sectors: "), "t1"))
        .when((best == 2) & (F.col("bands") > 2), F.concat(F.lit("limited in reach or subject: "), "t2"))
        .when(best == 2, F.concat(F.lit("scored without regard to reach: "), "t2"))
        .when(best == 3, F.concat(F.lit("about another subject: "), "t3"))
        .when(unread, F.concat(F.col("unread").cast("string"), F.lit(" could not be read")))
        .otherwise(F.concat(F.lit("none of "), F.col("examined").cast("string"), F.lit(" examined")))
    )
    state = F.when(best <= 2, "restricted").when((best == 3) | unread, "unresolved").otherwise("no-restriction")
    return g.select("cell", state.alias("state"), ordinal.alias("ordinal"), reason.alias("reason"))


def official(url: Column, hosts: Column) -> Column:
    """Whether a URL's host is a known one, a part of one, or a government's."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    known = F.exists(hosts, lambda h: (host == h) | host.endswith(F.concat(F.lit("."), h)))
    return F.coalesce(known | host.rlike(r"(?:^|\.)gov(?:\.[a-z]{2})?$"), F.lit(False))


def verified(rows: DataFrame) -> DataFrame:
    """(row_id, gate, passed): each gate that applies to an export row.

    A row that cites a provision is held to its quote, its place, its link and its standing; a row
    for a framework to that instrument's text; any row to its host and its score. ``recomputed`` is
    null where the score was not derived again.
    """
    has = lambda c: F.col(c).isNotNull()
    cites, quote = has("section_id"), F.col("quote")
    framework = ~cites & has("framework_text") & has("quote")
    at = F.col("doc_text").substr(F.col("start") + 1, F.col("stop") - F.col("start"))
    answered = ~F.col("state").eqNullSafe("unresolved")
    elided = quote.rlike(r"\.\.\.|…")
    checks = [
        (cites | framework, "quote-in-source", P.quote_span(F.when(cites, F.col("section_text")).otherwise(F.col("framework_text")), quote).isNotNull()),
        (cites, "offsets-resolve", F.when(elided, P.quote_span(at, quote).isNotNull()).otherwise(quote_key(at) == quote_key(quote))),
        (cites, "pinpoint-citation", F.col("url").contains("#")),
        (cites | framework, "in-force", (F.col("status") == "in-force") & has("status_basis")),
        (cites, "timeframe-evidenced", ~has("last_amended") | (F.trim(F.col("timeframe_basis")) != "")),
        (cites, "one-measure", F.size(F.split(F.coalesce("notes", F.lit("")), "Measure: ")) <= 2),
        (framework, "framework-quote-verified", F.col("framework_verified")),
        (cites, "quote-leads", F.col("rationale").rlike(r'^\s*["“]')),
        (has("url") | answered, "official-host", official(F.col("url"), F.col("hosts"))),
        (answered, "score-recorded", has("band") & has("score")),
        (has("recomputed"), "score-recomputes", F.col("recomputed")),
    ]
    gates = F.array(*[F.when(applies, F.struct(F.lit(gate).alias("gate"), F.coalesce(passed, F.lit(False)).alias("passed"))) for applies, gate, passed in checks])
    return rows.select("row_id", F.explode(F.filter(gates, lambda g: g.isNotNull())).alias("g")).select("row_id", "g.*")
