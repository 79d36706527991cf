"""Text scalars over documents, pages and titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import language as G
from ..functions import money as M
from ..functions import passages as Q
from ..functions import text as T

_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}\\p{M}]+'), lambda w: length(w) >= 3)"


@query("t03_tokens", f"SELECT doc_id, len({_WORDS}) AS n, array_to_string(list_distinct({_WORDS}).list_sort()[1:5], ' ') AS some FROM documents")
def t03(t):
    w = T.tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(w).cast("long").alias("n"), F.array_join(F.slice(F.array_sort(F.array_distinct(w)), 1, 5), " ").alias("some"))


@query("t05_quote_key", "SELECT doc_id, md5(trim(regexp_replace(lower(translate(text, '‘’‚‛“”„‟‐‑‒–—− ', '''''''''\"\"\"\"------ ')), '[\\s]+', ' ', 'g'))) AS key FROM documents")
def t05(t):
    return t("documents").select("doc_id", F.md5(T.quote_key(F.col("text"))).alias("key"))


#: German is read in the given tables beside the languages of the register.
WORDS = {**G.FUNCTION_WORDS, "de": "der die das und ist von den nicht mit ein zu auf für im des dem eine werden nach sich".split()}


def _language_sql(table: str, key: str) -> str:
    return f"""
WITH f(lang, words) AS (VALUES
  ('en', ['the','of','and','to','in','any','shall','for','or','by','that','this','under','with','is','be','may','not','person','section']),
  ('ms', ['yang','dan','atau','dengan','kepada','bagi','adalah','tidak','ini','itu','hendaklah','seksyen','mana-mana','di','dalam','oleh','pada','akta','boleh','tersebut']),
  ('id', ['yang','dan','atau','dengan','kepada','bagi','adalah','tidak','ini','itu','wajib','pasal','dalam','oleh','pada','undang-undang','dapat','dimaksud','ayat','setiap']),
  ('vi', ['của','và','các','trong','được','có','không','này','cho','theo','về','điều','khoản','người','hoặc','với','là','quy','định','phải']),
  ('pt', ['de','da','do','que','não','para','com','uma','por','os','as','no','na','artigo','ser','pode','deve','dos','das','este']),
  ('es', ['de','la','que','el','en','los','del','las','por','con','para','una','artículo','ser','no','se','su','al','este','deberá']),
  ('fr', ['de','la','le','les','des','et','à','en','du','un','une','que','pour','dans','par','article','est','qui','sur','aux']),
  ('tet', ['no','ba','iha','ho','mak','nia','atu','ne','husi','artigu','tenke','bele','katak','hotu','ida']),
  ('de', ['der','die','das','und','ist','von','den','nicht','mit','ein','zu','auf','für','im','des','dem','eine','werden','nach','sich'])),
t AS (SELECT {key}, text, length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS latin, length(regexp_replace(text, '[^\u0E00-\u0E7F]+', '', 'g')) AS thai, length(regexp_replace(text, '[^\u0400-\u04FF]+', '', 'g')) AS cyrillic FROM {table}),
w AS (SELECT {key}, unnest(string_split_regex(regexp_replace(lower(text), '[^\\p{{L}}\\s-]+', ' ', 'g'), '\\s+')) AS word FROM t WHERE latin >= 40),
n AS (SELECT {key}, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL HAVING count(*) >= 8),
s AS (SELECT {key}, lang, count(*) / any_value(n) AS share FROM w JOIN n USING ({key}) JOIN (SELECT lang, unnest(words) AS word FROM f) USING (word) GROUP BY {key}, lang),
b AS (SELECT {key}, lang, share, coalesce(lead(share) OVER (PARTITION BY {key} ORDER BY share DESC), 0) AS second, row_number() OVER (PARTITION BY {key} ORDER BY share DESC, lang) AS r FROM s)
SELECT {key}, CASE WHEN thai > 3 AND thai > latin THEN 'th' WHEN cyrillic > 3 AND cyrillic > latin THEN 'ru' WHEN share >= 0.06 AND share - second >= 0.015 THEN lang END AS lang
FROM t LEFT JOIN b ON r = 1 AND {" AND ".join(f"b.{k.strip()} = t.{k.strip()}" for k in key.split(","))}""".replace(f"SELECT {key}, CASE", "SELECT " + ", ".join(f"t.{k.strip()}" for k in key.split(",")) + ", CASE")


@query("t10_language", _language_sql("documents", "doc_id"))
def t10(t):
    return t("documents").select("doc_id", G.detected(F.col("text"), words=WORDS).alias("lang"))


@query("t10_turn_language", _language_sql("conversations", "conv_id, turn"))
def t10_turns(t):
    return t("conversations").select("conv_id", "turn", G.detected(F.col("text"), words=WORDS).alias("lang"))


@query("t13_url_key", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://(www\\.)?', ''), '[?#].*$', ''), '/+$', '') AS key FROM pages")
def t13(t):
    return t("pages").select("page_id", T.url_key(F.col("url")).alias("key"))


@query("t13_title_key", "SELECT p_partkey, regexp_replace(trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g')), '^(the|a|an) ', '') AS key FROM part")
def t13b(t):
    return t("part").select("p_partkey", T.title_key(F.col("p_name")).alias("key"))


@query("t14_stems", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split_regex(lower(p_name), '[^\\p{L}\\p{N}\\p{M}]+'), lambda w: length(w) >= 3), lambda w: w[1:5]))), ' ') AS stems FROM part")
def t14(t):
    return t("part").select("p_partkey", F.array_join(F.array_sort(T.stems(F.col("p_name"))), " ").alias("stems"))


@query("r01_jaccard_of_turns", """
WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}\\p{M}]+'), lambda w: length(w) >= 3)) AS w FROM conversations)
SELECT a.conv_id, a.turn, round(len(list_intersect(a.w, b.w)) / greatest(len(list_distinct(list_concat(a.w, b.w))), 1), 6) AS likeness FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def r01(t):
    w = t("conversations").select("conv_id", "turn", F.array_distinct(T.tokens(F.col("text"))).alias("w"))
    b = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return w.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("w"), F.col("v")), 6).alias("likeness"))


@query("r04_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def r04(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("u01_url_parts", "SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_matches(lower(url), '\\.pdf([?#]|$)') AS is_pdf, url LIKE '%#%' AS has_anchor FROM pages")
def u01(t):
    return t("pages").select("page_id", T.host(F.col("url")).alias("host"), F.lower("url").rlike(r"\.pdf([?#]|$)").alias("is_pdf"), F.col("url").contains("#").alias("has_anchor"))


@query("u02_request_key", "SELECT doc_id, sha256('{\"doc\":' || doc_id || ',\"lang\":\"' || lang || '\"}') AS key FROM documents")
def u02(t):
    """The memo's key: the hash of a canonical request."""
    return t("documents").select("doc_id", F.sha2(F.to_json(F.struct(F.col("doc_id").alias("doc"), "lang")), 256).alias("key"))


@query("d01_timeframe", "SELECT o_orderkey, 'Since ' || strftime(o_orderdate, '%B %Y') AS since FROM orders")
def d01(t):
    return t("orders").select("o_orderkey", F.concat(F.lit("Since "), F.date_format("o_orderdate", "MMMM yyyy")).alias("since"))


@query("d02_dates", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def d02(t):
    shown = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "dd-MM-yyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "d MMMM yyyy"))
    return t("orders").select("o_orderkey", T.any_date(shown).cast("string").alias("day"))


@query("m01_money", "SELECT c_custkey, round(abs(c_acctbal), 2) AS amount FROM customer")
def m01(t):
    said = F.concat(F.lit("a deposit of USD "), F.format_number(F.abs(F.col("c_acctbal")), 2), F.lit(" is due"))
    return t("customer").select("c_custkey", F.round(T.money(said), 2).alias("amount"))


@query("m02_to_usd", "SELECT o_orderkey, round(CAST(o_totalprice AS DOUBLE) * CASE o_orderkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.1::DOUBLE END, 4) AS usd FROM orders")
def m02(t):
    """Without a rate for its currency an amount stays unknown."""
    o = t("orders").withColumn("currency", F.when(F.col("o_orderkey") % 3 == 0, "USD").when(F.col("o_orderkey") % 3 == 1, "EUR").otherwise("XXX"))
    rate = F.create_map(F.lit("USD"), F.lit(1.0), F.lit("EUR"), F.lit(1.1))
    return o.select("o_orderkey", F.round(F.col("o_totalprice").cast("double") * F.try_element_at(rate, F.col("currency")), 4).alias("usd"))


@query("m04_confidence_ladder", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 0.9::DOUBLE WHEN quality = 1 THEN 0.75::DOUBLE WHEN quality = 0 AND toxic = 0 THEN 0.5::DOUBLE WHEN quality = 0 THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END AS confidence FROM documents LEFT JOIN labels USING (doc_id)")
def m04(t):
    q, x = F.col("quality"), F.col("toxic")
    ladder = F.when((q == 1) & (x == 0), 0.9).when(q == 1, 0.75).when((q == 0) & (x == 0), 0.5).when(q == 0, 0.4).otherwise(0.2)
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left").select("doc_id", ladder.alias("confidence"))


@query("p05_outline_headings", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)^(summary|outline|contents|the )')")
def p05(t):
    return t("documents").where(F.col("text").rlike("(?i)^(summary|outline|contents|the )")).select("doc_id")


@query("p09_kind_from_words", "SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' THEN 'act' WHEN p_type LIKE '%STEEL%' THEN 'regulation' WHEN p_type LIKE '%BRASS%' THEN 'rule' ELSE 'notice' END AS kind FROM part")
def p09(t):
    k = F.col("p_type")
    return t("part").select("p_partkey", F.when(k.startswith("PROMO"), "act").when(k.contains("STEEL"), "regulation").when(k.contains("BRASS"), "rule").otherwise("notice").alias("kind"))


@query("p13_official_host", "SELECT page_id, regexp_matches(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '(^|\\.)example\\.(org|net)$') AS official FROM pages")
def p13(t):
    return t("pages").select("page_id", T.host(F.col("url")).rlike(r"(^|\.)example\.(org|net)$").alias("official"))


@query("p16_reasons", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'repealed' WHEN n_chars < 300 THEN 'fragment' END AS reason FROM documents LEFT JOIN labels USING (doc_id)")
def p16(t):
    d = t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id", "left")
    return d.select("doc_id", F.when(F.col("toxic") == 1, "repealed").when(F.col("n_chars") < 300, "fragment").alias("reason"))


@query("p24_quote_snapshot", "SELECT doc_id, substr(text, CAST(greatest(p - 50, 1) AS INTEGER), 100) AS shown, CAST(p - greatest(p - 50, 1) AS BIGINT) AS inside FROM (SELECT doc_id, text, strpos(text, 'tion') AS p FROM documents) WHERE p > 0")
def p24(t):
    p = F.locate("tion", "text")
    start = F.greatest(p - 50, F.lit(1))
    return t("documents").where(p > 0).select("doc_id", F.substring("text", start, F.lit(100)).alias("shown"), (p - start).cast("long").alias("inside"))


@query("t08_quote_containment", """
SELECT doc_id, item_id, strpos(substr(d.text, strpos(d.text, left(b.text, 30)) + 30), right(b.text, 30)) > 0 AS matched, strpos(substr(d.text, strpos(d.text, right(b.text, 30)) + 30), left(b.text, 30)) > 0 AS reversed
FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) >= 80""")
def t08(t):
    """Passages quoted by their beginning and end with a gap between, and the other way round: fragments have to follow each other."""
    from .evidence import _passages

    d = _passages(t).where(F.char_length("passage") >= 80)
    first, last = F.left("passage", F.lit(30)), F.right("passage", F.lit(30))
    held = lambda a, b: Q.quote_span(F.col("text"), F.concat(a, F.lit(" … "), b)).isNotNull()
    return d.select("doc_id", "item_id", held(first, last).alias("matched"), held(last, first).alias("reversed"))


@query("z05_offset_audit", "SELECT conv_id, turn FROM conversations WHERE conv_id % 5 = 0 AND turn = 0")
def z05(t):
    """Sections whose offsets do not give their own text back: those that are moved here, and no others."""
    from ..operators import ledger as L

    s = L.with_offsets(t("conversations"), "conv_id", "turn", "text")
    parts = s.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("whole"))
    s = s.withColumn("char_start", F.col("char_start") + F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0), 1).otherwise(0))
    return s.join(parts, "conv_id").where(~F.substring(F.col("whole"), F.col("char_start").cast("int") + 1, F.char_length("text")).eqNullSafe(F.col("text"))).select("conv_id", "turn")


@query("m01_sums_in_wordings", """
SELECT doc_id, CAST(n_chars AS DOUBLE) AS amount, CASE lang WHEN 'en' THEN 'AUD' WHEN 'fr' THEN 'MYR' WHEN 'es' THEN 'INR' ELSE 'THB' END AS currency, lang = 'en' AS assumed FROM documents WHERE n_chars >= 1000
UNION ALL SELECT doc_id, NULL, NULL, NULL FROM documents WHERE n_chars < 1000""")
def m01_wordings(t):
    """The length of each document as a sum in a wording of its first words: grouped by commas, blanks, lakhs and in Thai digits; short ones state two sums."""
    n = F.col("n_chars")
    lead = F.regexp_replace(F.substring("text", 1, 40), "[0-9$]", "")
    thai = F.translate(F.format_number(n, 0), "0123456789", "๐๑๒๓๔๕๖๗๘๙")
    crowded = F.when(n >= 100000, F.concat(F.floor(n / 100000).cast("string"), F.lit(","), F.lpad(F.floor(n / 1000 % 100).cast("string"), 2, "0"), F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0"))).otherwise(F.format_number(n, 0))
    wording = F.when(F.col("lang") == "en", F.concat(F.lit(" not exceeding $"), F.format_number(n, 0))).when(F.col("lang") == "fr", F.concat(F.lit(" of RM "), F.replace(F.format_number(n, 0), F.lit(","), F.lit(" ")))).when(F.col("lang") == "es", F.concat(F.lit(" of "), crowded, F.lit(" rupees"))).otherwise(F.concat(F.lit(" "), thai, F.lit(" บาท")))
    text = F.concat(lead, wording, F.when(n < 1000, " or US$7.25 under section 12").otherwise(" under section 12"))
    return t("documents").select("doc_id", M.money(text, F.when(F.col("lang") == "en", "AUS").otherwise("MYS")).alias("m")).select("doc_id", "m.amount", "m.currency", "m.assumed")


@query("m01_sums_in_texts")
def m01_texts(t):
    """The lines of all documents that state one sum (no twin in SQL; tests hold the grammar against cases)."""
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.select("doc_id", "line", M.money(F.col("text"), F.lit("AUS")).alias("m")).select("doc_id", "line", "m.amount", "m.currency", "m.assumed").where("amount is not null")
