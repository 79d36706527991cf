"""What words say: predicates over the wordings of a provision, by lists of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English words, and stems of the other languages whose provisions are read.
WORDS = {
    "foreign": r"foreign(?:er|ers|-owned)?|non-?residents?|non-?citizens?|non-?nationals?|overseas|aliens?",
    "nationality": r"foreign(?:er|ers)?|nationals?|citizens?|citizenship|nationality|non-?residents?|residents?",
    "place": r"territory|territories|country|countries|jurisdiction|republic|kingdom|state|within the borders|abroad|overseas",
    "information": r"information|data|databases?|records?|accounts?|books|registers?|documents?|particulars|files?",
    "frontier": r"imports?|imported|exports?|exported|cross-border|customs|frontier|abroad|enters?|leaves?|brought into|sent out of",
    "floor": r"at least|not less than|no less than|a minimum of|or more",
    "duration": r"(?:[0-9]+|one|two|three|five|six|seven|ten)(?: \([0-9]+\))? (?:days?|weeks?|months?|years?)",
    "bank": r"banks?|banking|credit institutions?",
    "restriction": r"prohibit(?:s|ed)?|limit(?:s|ed)?|restrict(?:s|ed)?|requires?|required|must|shall|may not",
    "standard": r"standards?|requirements?|specifications?|protocols?",
    "electronic": r"electronic|electronically|online|digital|telecommunications?",
    "merger": r"merger|mergers|concentrations?|substantial lessening of competition|dominant position",
    "excluded content": r"elections?|political|criminal procedure|children|minors|age-restricted",
    "eligibility": r"bid security|conformity|eligible bidders?|eligibility|insolvent|bankrupt",
    "tender": r"tender|tenders|tenderer|procurement|bid|bidders?",
    "licence terms": r"licence|licensee|license|sublicence|royalt(?:y|ies)",
    "inspection": r"inspection|inspect|perusal|open to the public",
    "office": r"by virtue of this act|under this act|exercise of (?:his|her|their|an|any) (?:office|functions)",
    "elsewhere": r"prescribed|(?:set|fixed|specified|determined) (?:by|in) (?:the )?(?:minister|regulations?|order|notice)",
    "outline": r"outline|simplified outline|summary|overview",
    "decision": r"the (?:respondent|appellant|applicant|plaintiff|defendant)|the (?:court|tribunal) (?:finds|orders|held)",
    "definition": r"means|has the meaning|has the same meaning",
    "empowering": r"may (?:by (?:order|notice|regulations?) )?(?:prescribe|require by|make regulations|make rules)",
    "pointing": r"comply with (?:the|any) (?:rules|requirements|regulations|codes?) (?:made|issued|set|in force)",
    "cease": r"cease to retain|destroy|no longer than|not longer than|erase|delete",
    "inserting": r"insert|substitute|add the words|omit",
    "data officer": r"data protection|privacy|information security|personal data|information officer",
    "condition": r"capital|roll-?out|coverage|performance|obligation to (?:cover|perform)|foreign operators?",
    "prohibition": r"(?:shall|must|may) not|prohibited|no person (?:may|shall)",
}
#: Stems in languages that are not matched by whole words.
STEMS = {
    "foreign": "иностранн|нерезидент|гадаад|ต่างด้าว|ต่างชาติ|ຕ່າງປະເທດ",
    "place": "территори|за рубеж|нутаг дэвсгэр|ราชอาณาจักร|ດິນແດນ|ສປປ",
    "information": "информаци|сведени|данны|мэдээл|өгөгдөл|ข้อมูล|เอกสาร|ຂໍ້ມູນ|ເອກະສານ",
    "duration": "[0-9]+ ?(?:лет|год|месяц|жил|сар|ปี|เดือน|ປີ|ເດືອນ)",
}


def pattern(kind: str) -> str:
    """The pattern of a kind of words in a lower-case text; a word ends where no letter a to z follows."""
    whole = f"(?:^|[^a-z])(?:{WORDS[kind]})(?:[^a-z]|$)"
    return f"{whole}|{STEMS[kind]}" if kind in STEMS else whole


def says(c: Column | str, kind: str) -> Column:
    """Whether a wording holds words of a kind; a null wording says nothing."""
    return F.coalesce(F.lower(c).rlike(pattern(kind)), F.lit(False))
