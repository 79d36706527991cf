"""Languages by statement, script, letters and function words, against a plain version of the rule."""

import random
import re

from pyspark.sql import functions as F

from provenir.functions import language as G


def plain(text, stated=None, candidates=None):
    if stated and re.match(r"(?i)[a-z]{2,3}(-|$)", stated):
        return stated.lower().split("-")[0]
    text = text or ""
    latin = len(re.findall("[A-Za-z]", text))
    for lang, ranges in G.SCRIPTS.items():
        n = len(re.findall(f"[{ranges}]", text))
        if n > 3 and n > latin:
            return lang
    n = len(re.findall(f"[{G.CYRILLIC}]", text))
    if n > 3 and n > latin:
        if re.search(G.KAZAKH, text):
            return "kk"
        if re.search(G.MONGOLIAN, text):
            return "mn"
        pool = [c for c in candidates or [] if c in ("ru", "mn", "kk")]
        return pool[0] if len(pool) == 1 else "ru" if not pool or "ru" in pool else None
    if latin < 40:
        return None
    words = re.findall(r"(?:[^\W\d_]|-)+", text.lower())
    if len(words) < 8:
        return None
    pool = [c for c in (candidates or G.FUNCTION_WORDS) if c in G.FUNCTION_WORDS]
    shares = sorted(((sum(w in G.FUNCTION_WORDS[c] for w in words) / len(words), c) for c in pool), reverse=True)
    if not shares or shares[0][0] < 0.06 or len(shares) > 1 and shares[0][0] - shares[1][0] < 0.015:
        return None
    return shares[0][1]


CASES = [
    ("the law of the land is in force and the court is bound by this section", None, None, "en"),
    ("Seksyen ini hendaklah dibaca dengan akta yang boleh dikuatkuasakan oleh mana-mana pihak", None, ["ms", "en"], "ms"),
    ("yang dan atau dengan kepada bagi adalah tidak ini itu serta lain lain perkara berkenaan", None, None, None),  # Malay or Indonesian: not told
    ("yang dan atau dengan kepada bagi adalah tidak ini itu serta lain lain perkara berkenaan", None, ["id", "en"], "id"),
    ("ผู้ใดฝ่าฝืนต้องระวางโทษ ABC", None, None, "th"),
    ("An Act about the company 中文有限公司 which shall be read with any other Act of this place", None, None, "en"),
    ("Закон о персональных данных", None, None, "ru"),
    ("Закон о персональных данных", None, ["mn", "en"], "mn"),
    ("Закон о персональных данных", None, ["mn", "kk"], None),
    ("Хүний хувийн мэдээлэл хамгаалах тухай", None, ["ru"], "mn"),
    ("Қазақстан Республикасының заңы", None, ["ru", "mn"], "kk"),
    ("too short", None, None, None),
    ("नियम अधिनियम धारा", None, None, "hi"),
    ("too short", "HI-IN", None, "hi"),
    ("too short", "hindi", None, None),
    ("the law of the land is in force and the court is bound by this section", None, ["xx"], None),
    ("the law of the land is in force and the court is bound by this section", None, [], "en"),
    ("", None, None, None),
    (None, None, None, None),
    (None, "fr", None, "fr"),
]


def test_cases_and_random_texts(spark):
    rnd = random.Random(8)
    words = [w for own in G.FUNCTION_WORDS.values() for w in own] + ["xyz", "licence", "мир", "өдөр", "ไทย", "日本", "かな", "12", "mana-mana", "-", "É", " ", "𝒳"]
    rows = [(t, s, c) for t, s, c, _ in CASES]
    for _ in range(400):
        own = rnd.sample(words, 6)
        rows.append((" ".join(rnd.choice(own + ["abcdefgh"] * rnd.randint(0, 9)) for _ in range(rnd.randint(0, 40))), rnd.choice([None, None, "en-GB"]) if rnd.random() < 0.1 else None, rnd.choice([None, None, [], ["en", "ms"], ["mn", "ru"], ["kk"]])))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, s string, c array<string>")
    got = {r.i: r.lang for r in df.select("i", G.detected(F.col("t"), F.col("s"), F.col("c")).alias("lang")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[3] for c in CASES]
    assert [got[i] for i in range(len(rows))] == [plain(*r) for r in rows]
    assert sum(v is not None for v in got.values()) > 100


def test_a_list_of_candidates_and_other_words(spark):
    df = spark.createDataFrame([("der Staat und die Bürger mit den Rechten von der alten Verfassung",)], "t string")
    german = {**G.FUNCTION_WORDS, "de": ["der", "die", "und", "mit", "den", "von"]}
    assert df.select(G.detected(F.col("t"), words=german)).first()[0] == "de"
    assert df.select(G.detected(F.col("t"), candidates=["en", "fr"], words=german)).first()[0] is None
