"""What a question's subject has to be about: domains as phrases, and which question asks for which.

A phrase is matched whole, whatever its case; a star at an end lets letters, digits and underscores follow or go before.
"""

from __future__ import annotations

# The words that name each domain.
DOMAINS = {
    "online service": ["internet", "online", "on-line", "web*", "cyber*", "ecommerce", "e-commerce", "digital service*", "digital platform*", "digital identity*", "platform*", "social media", "search engine*", "enduser", "endusers", "end-user", "end-users", "intermediary", "intermediaries"],
    "online material": ["content", "material", "online", "on-line", "internet", "web*", "post", "posts", "posting", "publication", "intermediary", "intermediaries", "platform*", "enduser", "endusers", "end-user", "end-users", "social media", "computer resource", "computer resources", "computer system", "computer systems", "computer data"],
    "procurement": ["procure*", "tender*", "bid*", "public contract*", "government contract*", "supply to the government", "supply to the state", "commonwealth contract*", "*จัดซื้อจัดจ้าง*", "*ประกวดราคา*", "*เสนอราคา*"],
    "secrets": ["trade secret*", "source code*", "algorithm*", "confidential information", "confidential business information", "proprietary information", "encrypt*", "cryptograph*", "know-how", "*ความลับทางการค้า*", "*รหัสต้นฉบับ*"],
    "patent": ["patent*", "invention*", "utility model*", "*สิทธิบัตร*", "*การประดิษฐ์*"],
    "copyright": ["copyright*", "author*", "literary", "artistic", "musical", "cinematograph*", "performer*", "work*", "broadcast*", "infring*", "*ลิขสิทธิ์*"],
    "communications": ["telecom*", "communication*", "broadcast*", "carriage service*", "carrier*", "spectrum", "radiocommunication*", "postal", "media", "network facilit*", "network service*", "applications service*", "*โทรคมนาคม*", "*คลื่นความถี่*"],
    "radio equipment": ["radio", "radiocommunication*", "electromagnetic", "emc", "emi", "interference", "telecom*", "communication equipment", "communications equipment", "wireless", "spectrum", "electrical", "electronic equipment", "electronic product*", "product", "products", "goods", "articles", "equipment", "apparatus", "appliance", "appliances"],
    "advertising medium": ["internet", "online", "on-line", "web*", "ecommerce", "e-commerce", "platform*", "social media", "electronic media", "search engine*", "broadcast*", "television", "radio", "cable", "multimedia", "telecom*", "communications", "content code", "content service*", "content provider*"],
    "technical standard": ["standard*", "specification*", "technical regulation*", "code of practice", "conformity", "*มาตรฐาน*"],
    "encryption": ["encrypt*", "cryptograph*", "cipher*", "key length", "algorithm*", "aes", "des", "rsa", "ecc", "fips", "iso", "iec", "itu"],
    "data": ["data", "information", "record", "records", "database", "databases", "document", "documents", "file", "files", "*ข้อมูล*", "*สารสนเทศ*"],
    "accreditation body": ["accredit*", "certif*", "conformity assessment*", "inspection bod*", "inspecting bod*", "standard-sett*", "standard sett*", "standard bod*", "standards bod*", "regulat*"],
}
# The domain that an indicator's subject has to be of, and those of measures, which go before.
OF_INDICATOR = {
    "2.1": "procurement", "2.2": "secrets", "2.3": "procurement", "4.01": "patent", "4.1": "secrets", "4.2": "patent", "4.3": "patent", "4.5": "copyright", "4.6": "copyright", "4.9": "secrets",
    "5.1": "communications", "5.2": "communications", "5.4": "communications", "5.5": "communications", "5.7": "communications", "6.4": "data", "9.3": "advertising medium", "11.1": "technical standard", "11.2": "radio equipment", "11.4": "encryption",
}
OF_MEASURE = {"user-identity": "online service", "user-monitoring": "online service", "content-removal": "online material", "foreign-exclusion-from-standards": "accreditation body"}
# Indicators whose domain is a sector, and measures whose instrument's title may name the domain.
SECTORS = {"4.01", "4.2", "4.3", "5.1", "5.2", "5.4", "5.5", "9.3", "11.2"}
TITLE_CARRIES = {"user-identity", "user-monitoring", "content-removal"}
