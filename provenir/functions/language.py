"""The language of a text: what it states, its script, its letters, its function words, or null.

Scripts and letters are looked at only where a text has any beyond Latin; words are cut once and
those that are no function word of any language are dropped before languages are compared.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scripts that settle the language, in the order in which they are asked.
SCRIPTS = {
    "hi": "ऀ-ॿ", "zh": "一-鿿㐀-䶿", "ja": "぀-ゟ゠-ヿ", "ko": "가-힯ᄀ-ᇿ", "th": "฀-๿", "lo": "຀-໿", "my": "က-႟",
    "km": "ក-៿", "ar": "؀-ۿ", "bn": "ঀ-৿", "ta": "஀-௿", "si": "඀-෿", "ka": "Ⴀ-ჿ", "hy": "԰-֏",
}
# The Cyrillic script, its languages, and letters that only some of them have.
CYRILLIC, CYRILLIC_LANGUAGES, KAZAKH, MONGOLIAN = "Ѐ-ӿ", ("ru", "mn", "kk"), "[әғқңұһіӘҒҚҢҰҺІ]", "[өүӨҮ]"
# The function words that legal drafting in each language cannot do without.
FUNCTION_WORDS = {
    "en": "the of and to in any shall for or by that this under with is be may not person section".split(),
    "ms": "yang dan atau dengan kepada bagi adalah tidak ini itu hendaklah seksyen mana-mana di dalam oleh pada akta boleh tersebut".split(),
    "id": "yang dan atau dengan kepada bagi adalah tidak ini itu wajib pasal dalam oleh pada undang-undang dapat dimaksud ayat setiap".split(),
    "vi": "của và các trong được có không này cho theo về điều khoản người hoặc với là quy định phải".split(),
    "pt": "de da do que não para com uma por os as no na artigo ser pode deve dos das este".split(),
    "es": "de la que el en los del las por con para una artículo ser no se su al este deberá".split(),
    "fr": "de la le les des et à en du un une que pour dans par article est qui sur aux".split(),
    "tet": "no ba iha ho mak nia atu ne husi artigu tenke bele katak hotu ida".split(),
}
#: A script needs more characters than this; Latin text so many letters and words, a share, and a lead over the next language (fixed values).
SOME, MIN_LETTERS, MIN_WORDS, MIN_SHARE, MIN_LEAD = 3, 40, 8, 0.06, 0.015


def bound(value: Column, f) -> Column:
    """f(value), the value being worked out once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _length(runs: Column, ranges: str) -> Column:
    """Characters in the runs of one script."""
    return F.aggregate(F.filter(runs, lambda r: r.rlike(f"^[{ranges}]")), F.lit(0), lambda n, r: n + F.char_length(r))


def _held(tokens: Column, words: list[str]) -> Column:
    """How many of the tokens are among some words."""
    return F.size(F.filter(tokens, lambda w: w.isin(*words)))


def _by_script(text: Column, latin: Column, candidates: Column | None) -> Column:
    """The language that a script or its letters settle."""
    runs = F.regexp_extract_all(text, F.lit("|".join(f"[{r}]+" for r in (*SCRIPTS.values(), CYRILLIC))), F.lit(0))

    def settled(own: Column) -> Column:
        found = [F.when((n > SOME) & (n > latin), F.lit(lang)) for lang, n in ((lang, _length(own, ranges)) for lang, ranges in SCRIPTS.items())]
        n = _length(own, CYRILLIC)
        pool = F.array().cast("array<string>") if candidates is None else F.filter(F.coalesce(candidates, F.array().cast("array<string>")), lambda c: c.isin(*CYRILLIC_LANGUAGES))
        declared = F.when(F.size(pool) == 1, pool[0]).when((F.size(pool) == 0) | F.array_contains(pool, "ru"), "ru")
        cyrillic = F.when(text.rlike(KAZAKH), "kk").when(text.rlike(MONGOLIAN), "mn").otherwise(declared)
        # a text that is mostly Cyrillic is not asked for Latin words, whatever comes of it
        return F.coalesce(*found, F.when((n > SOME) & (n > latin), F.coalesce(cyrillic, F.lit("?"))))

    return bound(runs, settled)


def _by_words(text: Column, candidates: Column | None, words: dict[str, list[str]]) -> Column:
    """The language whose function words are clearly the most frequent."""
    every = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}-]+"), F.lit(0))
    known = sorted({w for own in words.values() for w in own})

    def scored(tokens: Column) -> Column:
        def best(hits: Column) -> Column:
            shares = F.array(*[F.struct((_held(hits, own) / F.size(tokens)).alias("share"), F.lit(lang).alias("lang")) for lang, own in words.items()])
            pool = shares if candidates is None else F.filter(shares, lambda s: F.array_contains(candidates, s["lang"]))

            def clear(ranked: Column) -> Column:
                lead = (F.size(ranked) < 2) | (ranked[0]["share"] - F.get(ranked, F.lit(1))["share"] >= MIN_LEAD)
                return F.when((F.size(ranked) > 0) & (F.get(ranked, F.lit(0))["share"] >= MIN_SHARE) & lead, F.get(ranked, F.lit(0))["lang"])

            return bound(F.sort_array(pool, asc=False), clear)

        return F.when(F.size(tokens) >= MIN_WORDS, bound(F.filter(tokens, lambda w: w.isin(*known)), best))

    return bound(every, scored)


def detected(text: Column, stated: Column | None = None, candidates: list[str] | Column | None = None, words: dict[str, list[str]] | None = None) -> Column:
    """The language of a text, or null where nothing says.

    In order: what the document states; a script that outnumbers Latin letters; for Cyrillic the
    letters that only one language has, then the candidates, then Russian; for Latin text of forty
    letters and eight words the language whose function words make six hundredths of them and lead
    by a hundredth and a half. ``candidates`` (a list or a column of arrays; null or empty: all)
    narrows the last two. Null texts have no language unless one is stated.
    """
    if isinstance(candidates, list):
        candidates = F.array(*map(F.lit, candidates)) if candidates else None
    words = words or FUNCTION_WORDS
    body = F.coalesce(text, F.lit(""))
    own = candidates
    if candidates is not None:
        own = F.when(F.size(F.coalesce(candidates, F.array().cast("array<string>"))) > 0, candidates).otherwise(F.array(*map(F.lit, [*words, *CYRILLIC_LANGUAGES])))

    def by_letters(latin: Column) -> Column:
        beyond = body.rlike("[" + "".join(SCRIPTS.values()) + CYRILLIC + "]")
        script = F.when(beyond, _by_script(body, latin, candidates))

        def decided(s: Column) -> Column:
            return F.when(s == "?", F.lit(None).cast("string")).when(s.isNotNull(), s).when(latin >= MIN_LETTERS, _by_words(body, own, words))

        return bound(script, decided)

    found = bound(F.char_length(F.regexp_replace(body, "[^A-Za-z]+", "")), by_letters)
    if stated is None:
        return found
    return F.when(stated.rlike("(?i)^[a-z]{2,3}(-|$)"), F.split_part(F.lower(stated), F.lit("-"), F.lit(1))).otherwise(found)
