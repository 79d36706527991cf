"""Parsing queries over raw pages and long texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..sources import flight as W
from ..sources import furniture as U
from ..sources import pages as P


@query("s17_sections")
def s17(t):
    """Sections of every page with offsets; parsing is not expressible in SQL."""
    return P.parsed(t("pages"))


@query("s17_offsets_resolve", "SELECT DISTINCT page_id % 7 AS residue, 0 AS ordinal FROM pages WHERE page_id % 7 = 0")
def s17b(t):
    """Sections whose offsets do not give their own length are those that are moved here (first ones, of every seventh page), and no others."""
    s = P.parsed(t("pages")).where("unread is null")
    moved = s.withColumn("char_end", F.col("char_end") + F.when((F.col("page_id") % 7 == 0) & (F.col("ordinal") == 0), 1).otherwise(0))
    return moved.where(F.col("char_end") - F.col("char_start") != F.char_length("text")).select((F.col("page_id") % 7).alias("residue"), "ordinal").distinct()


@query("s16_read_xor_unread", "SELECT page_id FROM pages WHERE page_id % 11 = 0 OR page_id % 13 = 0")
def s16(t):
    """Pages that are both read and unread, or neither: those that are made so here, and no others."""
    s = P.parsed(t("pages")).groupBy("page_id").agg(F.count_if(F.col("unread").isNull()).alias("read"), F.count_if(F.col("unread").isNotNull()).alias("unread"))
    faulty = s.where("page_id % 13 != 0").withColumns({c: F.when(F.col("page_id") % 11 == 0, 1).otherwise(F.col(c)) for c in ("read", "unread")})
    return t("pages").select("page_id").join(faulty, "page_id", "left").where("(read > 0) = (unread > 0) or read is null").select("page_id")


@query("s06_robots", """
WITH u AS (SELECT DISTINCT regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) AS path FROM pages)
SELECT host, path, NOT (starts_with(path, '/en') AND NOT starts_with(path, '/en/1')) AND NOT regexp_matches(path, '^.*\\.html$') OR starts_with(path, '/en/1') AND NOT (regexp_matches(path, '^.*\\.html$') AND 7 > 5) AS allowed FROM u""")
def s06(t):
    """The longest fitting rule decides; the rules here close /en but for /en/1, and all .html files."""
    u = t("pages").select(F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/?#:]+)", 1).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/?#]+(/[^?#]*)", 1).alias("path")).distinct()
    body = "User-agent: *\nDisallow: /en\nAllow: /en/1\nDisallow: /*.html$\nCrawl-delay: 5"
    return P.permitted(u, P.robots_rules(u.select("host").distinct().withColumn("body", F.lit(body))))


@query("w15_windows")
def w15(t):
    """Overlapping windows of long texts; the step depends on the text, so SQL cannot express it."""
    return P.windowed(t("documents"), size=4000, overlap=500)


@query("s26_greedy_packing", """
WITH RECURSIVE o AS (SELECT conv_id, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
r AS (SELECT conv_id, k, n AS used, 0 AS bin FROM o WHERE k = 1 UNION ALL SELECT o.conv_id, o.k, CASE WHEN r.used + o.n > 400 THEN o.n ELSE r.used + o.n END, r.bin + CASE WHEN r.used + o.n > 400 THEN 1 ELSE 0 END FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = r.k + 1)
SELECT conv_id, CAST(max(bin) + 1 AS INTEGER) AS bins FROM r GROUP BY conv_id""")
def s26(t):
    parts = t("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.char_length("text").cast("long").alias("n")))), lambda x: x["n"]).alias("sizes"))
    return parts.select("conv_id", (F.array_max(P.greedy_bins(F.col("sizes"), 400)) + 1).alias("bins"))


@query("s19_link_share", "SELECT page_id, CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs FROM pages")
def s19(t):
    return t("pages").select("page_id", F.regexp_count("html", F.lit("<a ")).cast("long").alias("links"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


@query("s21_page_furniture", """
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)', 1)) AS line FROM pages)
SELECT line, count(DISTINCT page_id) AS pages FROM l GROUP BY line HAVING count(DISTINCT page_id) >= 3""")
def s21(t):
    """Lines that stand on many pages are furniture."""
    lines = t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)'), F.lit(1))).alias("line"))
    return lines.groupBy("line").agg(F.count_distinct("page_id").alias("pages")).where("pages >= 3")


@query("s23_text_quality", "SELECT doc_id, length(regexp_replace(text, '[^\\x01-\\x08\\x0E-\\x1F]', '', 'g')) AS control_chars, round(length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / greatest(length(text), 1), 4) AS letters FROM documents")
def s23(t):
    return t("documents").select("doc_id", F.char_length(F.regexp_replace("text", r"[^\x01-\x08\x0E-\x1F]", "")).cast("long").alias("control_chars"), F.round(F.char_length(F.regexp_replace("text", r"[^\p{L}]", "")) / F.greatest(F.char_length("text"), F.lit(1)), 4).alias("letters"))


@query("s08_soft_blocks", "SELECT page_id FROM pages WHERE length(html) < 2000 AND regexp_matches(html, '(?i)captcha|access denied|casino')")
def s08(t):
    return t("pages").where((F.char_length("html") < 2000) & F.col("html").rlike("(?i)captcha|access denied|casino")).select("page_id")


@query("s18_streamed_markup", "SELECT page_id, md5(CASE WHEN starts_with(url, 'https') THEN '<article>' || url || ' 😀 \"é\"</article>' ELSE html END) AS body FROM pages")
def s18(t):
    """Pages under https served with their article as a streamed payload in two pieces, put together again; others as they are."""
    own = F.concat(F.lit("<article>"), "url", F.lit(' 😀 "é"</article>'))
    stream = F.concat(F.lit('0:["$","div"]\n1a:T'), F.lower(F.hex(F.char_length(own) + 1)), F.lit(","), own, F.lit("\n2:T3,abc"))
    piece = lambda s: F.concat(F.lit("<script>self.__next_f.push([1,"), F.substring(F.to_json(F.struct(s.alias("x"))), 6, 1 << 30), F.lit("</script>"))
    # {"x":"..."} without what stands before the string; its closing brace gives way to the end of the call
    pushed = lambda s: F.regexp_replace(piece(s), r"\}</script>$", "])</script>")
    html = F.when(F.col("url").startswith("https"), F.concat("html", pushed(F.substring(stream, 1, 25)), pushed(F.substring(stream, 26, 1 << 30)))).otherwise(F.col("html"))
    return W.served_or_streamed(t("pages").select("page_id", html.alias("html"))).select("page_id", F.md5("body").alias("body"))


@query("s21_without_furniture", r"""
WITH l AS (SELECT source, doc_id, unnest(list_concat(['Collected writings of ' || source, 'Volume ' || doc_id], string_split(text, chr(10)), ['- ' || doc_id || ' -', doc_id::VARCHAR])) AS line, generate_subscripts(list_concat(['', ''], string_split(text, chr(10)), ['', '']), 1) - 1 AS i FROM documents),
z AS (SELECT source, doc_id, count(*) AS n FROM l GROUP BY ALL), p AS (SELECT source, count(*) AS pages FROM z GROUP BY source),
k AS (SELECT l.*, CASE WHEN n >= 6 AND (i < 2 OR i >= n - 2) AND length(line) <= 120 AND NOT regexp_matches(line, '^\s*\d+[A-Z]{0,2}\.[^\d]') AND NOT regexp_matches(line, '^\s*[‘''"]?\d+\.\d+[A-Z]{0,2}(\s|$)')
    AND (length(trim(regexp_replace(regexp_replace(line, '[^A-Za-z ]+', ' ', 'g'), '\s+', ' ', 'g'))) >= 4 OR regexp_matches(trim(line), '(?i)^(page\s+)?[ivxlcdm0-9]+(\s*(of|/)\s*[ivxlcdm0-9]+)?$'))
    THEN lower(trim(regexp_replace(regexp_replace(line, '[^A-Za-z ]+', ' ', 'g'), '\s+', ' ', 'g'))) END AS key FROM l JOIN z USING (source, doc_id)),
g AS (SELECT source, key FROM k JOIN p USING (source) WHERE key IS NOT NULL GROUP BY source, key, pages HAVING pages >= 4 AND count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) >= pages * CASE WHEN key = '' THEN 0.6 ELSE 0.15 END)
SELECT k.doc_id, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY i)) AS body FROM k LEFT JOIN g ON g.source = k.source AND g.key = k.key WHERE g.key IS NULL GROUP BY k.doc_id""")
def s21_left(t):
    """Each source as one work whose pages are its documents, with two lines of head and two of foot; what is left of the pages."""
    head = F.array(F.concat(F.lit("Collected writings of "), "source"), F.concat(F.lit("Volume "), "doc_id"))
    foot = F.array(F.concat(F.lit("- "), "doc_id", F.lit(" -")), F.col("doc_id").cast("string"))
    lines = t("documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.concat(head, F.split("text", "\n"), foot)).alias("i", "line"))
    left = U.without_furniture(lines).groupBy(F.col("page").alias("doc_id")).agg(F.count(F.lit(1)).alias("lines"), F.array_sort(F.collect_list(F.struct("i", "line"))).alias("own"))
    return left.select("doc_id", "lines", F.md5(F.array_join(F.transform("own", lambda x: x["line"]), "\n")).alias("body"))
