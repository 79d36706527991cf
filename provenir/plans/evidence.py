"""Quotes in their sources, slips, scripts, charsets, links and wordings, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import approximate as A
from ..functions import passages as P
from ..operators import phrases as H
from ..sources import pages as S
from ..streaming.events import shared_folder


def _passages(t) -> DataFrame:
    """(doc_id, item_id, text, passage) of every document that holds a benchmark passage."""
    hits = H.phrase_hits(t("documents"), t("benchmark")).select("doc_id", "item_id")
    return hits.join(t("documents").select("doc_id", "text"), "doc_id").join(t("benchmark").select("item_id", F.col("text").alias("passage")), "item_id")


_WHERE = "SELECT doc_id, item_id, strpos(d.text, b.text) - 1 AS start, strpos(d.text, b.text) - 1 + length(b.text) AS stop FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) > 60"


@query("t06_quote_spans", _WHERE)
def t06(t):
    """Passages quoted in lower case, with other blanks and in quotation marks, found where they stand."""
    quote = F.concat(F.lit("“"), F.regexp_replace(F.lower("passage"), " ", " \n"), F.lit("”"))
    d = _passages(t).where(F.char_length("passage") > 60).select("doc_id", "item_id", P.quote_span(F.col("text"), quote).alias("s"))
    return d.select("doc_id", "item_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


def _slipped(c: str) -> F.Column:
    """A wording without its 15th and with another 40th character."""
    return F.concat(F.substring(c, 1, 14), F.substring(c, 16, 24), F.lit("#"), F.expr(f"substring({c}, 41)"))


@query("t07_near_quotes", _WHERE)
def t07(t):
    """Passages quoted with two slips, found where they stand."""
    d = _passages(t).where(F.char_length("passage") > 60).select("doc_id", "item_id", A.near_span_any("text", _slipped("passage")).alias("s"))
    return d.select("doc_id", "item_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


@query("t09_passages_with_slips", "SELECT doc_id, item_id, 2 AS edits FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) > 60")
def t09(t):
    """Every benchmark passage is given two slips; which documents hold it within three edits, and with how many."""
    slipped = t("benchmark").where(F.char_length("text") > 60).select("item_id", _slipped("text").alias("text"))
    return H.approximate_hits(t("documents"), slipped, 3).select("doc_id", "item_id", "edits")


@query("t01_composed", "SELECT doc_id, md5(nfc_normalize(replace(text, 'e', 'e' || chr(769)))) AS composed FROM documents")
def t01(t):
    """Texts whose letters e carry an accent of their own, composed."""
    return t("documents").select("doc_id", F.md5(P.nfc(F.replace("text", F.lit("e"), F.lit("e\u0301")))).alias("composed"))


@query("t02_thai_marks", """
WITH a AS (SELECT doc_id, replace(translate(text, 'aeiou', 'ซ ้ํา'), 'ํา', 'ำ') AS x FROM documents), b AS (SELECT doc_id, regexp_replace(x, '([฀-๿]) ([ัิ-ฺ็-๎])', '\\1\\2', 'g') AS x FROM a)
SELECT doc_id, md5(regexp_replace(x, '([฀-๿]) ([ัิ-ฺ็-๎])', '\\1\\2', 'g')) AS joined FROM b""")
def t02(t):
    """Vowels written as Thai letters, marks and blanks: the vowel AM in one piece, marks on their letters."""
    thai = F.translate("text", "aeiou", "ซ ้ํา")
    return t("documents").select("doc_id", F.md5(P.marks_rejoined(P.am_folded(thai))).alias("joined"))


@query("r05_json_in_prose", """SELECT conv_id, turn, '{"turn": ' || turn || ', "by": {"role": "' || role || '}"}}' AS object FROM conversations""")
def r05(t):
    """The first balanced object in a turn that has one in its midst."""
    own = F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit(', "by": {"role": "'), "role", F.lit('}"}}'))
    prose = F.concat("text", F.lit(" {not an object} "), own, F.lit(" } "), "text")
    return t("conversations").select("conv_id", "turn", P.json_in(prose).alias("object"))


@query("s10_charsets", """SELECT page_id, CASE WHEN contains(url, 'example.net') THEN 'utf-16be' WHEN contains(url, 'example.org') AND regexp_matches(html, '[\u0080-\u00FF]') THEN 'iso-8859-1' ELSE 'utf-8' END AS charset FROM pages""")
def s10(t):
    """Pages served in three encodings, under headers that are right, wrong and absent."""
    net, org = F.col("url").contains("example.net"), F.col("url").contains("example.org")
    body = F.when(net, F.encode("html", "UTF-16")).when(org, F.encode("html", "ISO-8859-1")).otherwise(F.encode("html", "UTF-8"))
    header = F.when(net, "windows-1251").when(org, "ISO-8859-1").when(F.col("url").startswith("https"), "windows-1251")
    return t("pages").select("page_id", P.charset(body, header, F.lit("text/html")).alias("charset"))


@query("s22_running_headers", "SELECT source AS doc, 'Collected writings of the house of ' || source AS header FROM documents GROUP BY source HAVING count(*) > 3")
def s22(t):
    """Each source as one long work whose pages are its documents, under a header of two lines."""
    lines = F.concat(F.array(F.lit("Collected writings"), F.concat(F.lit("of the  house of "), "source"), F.concat(F.lit("page "), "doc_id")), F.split("text", "\n"))
    return S.running_headers(t("documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(lines).alias("i", "line")))


@query("p11_links_worth_opening", r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>[^<]*</a>')) AS link FROM pages), l AS (SELECT page_id, lower(regexp_extract(link, 'href="([^"]*)"', 1)) AS path, lower(regexp_extract(link, '>([^<]*)<', 1)) AS words FROM a)
SELECT page_id, count(*) AS links, count(*) FILTER (regexp_matches(path || ' ' || words, '\b(legislat\w*|legal|regulat\w*|licen[cs]\w*|regist\w*|(instrument|document|gazette|code|guideline|standard|act|rule|order|determination|direction|directive|circular|notice)s?|statut\w*|polic(y|ies)|complian\w*|enforce\w*)\b')
  AND NOT regexp_matches(path, '\b(news|media|press|(event|career|video|podcast)s?|vacanc(y|ies)|contact|about-us|search|login|subscribe|rss|calendar|galler(y|ies))\b')) AS opens FROM l GROUP BY page_id""")
def p11(t):
    """The links of each page, and how many of them may lead to law."""
    link = F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="[^"]*"[^>]*>[^<]*</a>'), F.lit(0)))
    links = t("pages").select("page_id", link.alias("a")).select("page_id", F.regexp_extract("a", 'href="([^"]*)"', 1).alias("path"), F.regexp_extract("a", ">([^<]*)<", 1).alias("words"))
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_if(P.worth_opening(F.col("path"), F.col("words"))).alias("opens"))


@query("p12_standing", """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'in-force' WHEN 'F' THEN 'repealed' END AS standing FROM orders""")
def p12(t):
    """Orders listed under headings that say what they are; the heading of the third list says both."""
    heading = F.concat(F.when(F.col("o_orderstatus") == "O", "Register of  current").when(F.col("o_orderstatus") == "F", "Archived").otherwise("Existing and past"), F.lit("\n orders of "), F.year("o_orderdate").cast("string"))
    return t("orders").select("o_orderkey", P.standing(heading).alias("standing"))


@query("t04_phrases", "WITH p AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\p{M}\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) AS p FROM documents) SELECT doc_id, CASE WHEN length(replace(p, ' ', '')) >= 3 THEN md5(p) END AS phrase FROM p")
def t04(t):
    return t("documents").select("doc_id", F.md5(P.phrase(F.col("text"))).alias("phrase"))


@query("d03_ago", """
WITH m AS (SELECT event_id, ts, CAST(round(date_diff('second', ts, TIMESTAMP '2024-01-31 00:00:00') / 60.0) AS BIGINT) AS m FROM events), h AS (SELECT *, CAST(round(m / 60.0) AS BIGINT) AS h, CAST(round(round(m / 60.0) / 24.0) AS BIGINT) AS d FROM m)
SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%H:%M') AS clock, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || ' min ago' WHEN h = 1 THEN '1 hour ago' WHEN h < 24 THEN h || ' hours ago' WHEN d = 1 THEN 'yesterday' WHEN d < 30 THEN d || ' days ago' END AS ago FROM h""")
def d03(t):
    """The clock in a named zone, and how long ago an event was."""
    minutes = F.round((F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 60).cast("long")
    return t("events").select("event_id", F.date_format(F.from_utc_timestamp("ts", "Asia/Bangkok"), "HH:mm").alias("clock"), P.ago(minutes).alias("ago"))


@query("s33_csv_rows", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM labels")
def s33(t):
    """Every field quoted, ids as text, lines that end in CR LF; written, then read back."""
    d = t("labels").select("doc_id", "quality", "toxic")
    fields = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in d.columns]
    path = shared_folder(d.sparkSession)
    d.select(F.concat(F.concat_ws(",", *fields), F.lit("\r")).alias("value")).write.text(path)
    return d.sparkSession.read.schema("doc_id string, quality string, toxic string").option("escape", '"').csv(path)


@query("p14_may_govern", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE length(text) > 0 AND toxic = 0")
def p14(t):
    """An instrument governs if it was read and is no publication; here what is marked toxic is only published."""
    kind = F.when(F.col("toxic") == 1, "publication").otherwise("act")
    return P.may_govern(t("documents").join(t("labels"), "doc_id").select("doc_id", (F.char_length("text") > 0).alias("was_read"), kind.alias("kind"))).select("doc_id")


@query("p15_read_in_full", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) % 2 = 0 AND count(*) FILTER (contains(text, '***')) = 0")
def p15(t):
    """A conversation is read in full if every turn has its answer and none is unreadable."""
    each = t("conversations").groupBy("conv_id").agg(F.when(F.count(F.lit(1)) % 2 == 1, "unanswered").alias("failure"), F.count_if(F.contains("text", F.lit("***"))).alias("unreadable"))
    return P.read_in_full(each).select("conv_id")


@query("p17_exceptions", """
SELECT doc_id, CASE WHEN quality = 0 AND toxic = 1 THEN 'government data' WHEN quality = 1 AND contains(lower(text), 'licen') THEN 'asked in its own pillar' WHEN quality = 0 AND length(split_part(text, chr(10), 1)) > 0 AND lang <> 'en' THEN 'within the stated exception' END AS reason
FROM documents JOIN labels USING (doc_id)""")
def p17(t):
    """Which stated exception takes a document out."""
    d = t("documents").join(t("labels"), "doc_id")
    exception = F.when(F.col("quality") == 0, F.lit("Excludes government data and small firms")).otherwise(F.lit("Licences are covered under Pillar 5"))
    reason = P.excepted(exception, F.col("toxic") == 1, F.col("text"), F.col("lang") != "en", F.when(F.col("quality") == 0, F.split_part("text", F.lit("\n"), F.lit(1))), "(?i)licen")
    return d.select("doc_id", reason.alias("reason"))
