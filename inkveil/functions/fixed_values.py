"""Values that decide what is found and how it looks.

Everything in this module is a FIXED VALUE: patterns, scores, word lists,
window sizes and formats that other systems must share to obtain the same
results.  Nothing here is logic.
"""

# --------------------------------------------------------------------------
# FIXED VALUES - categories
# --------------------------------------------------------------------------
CATEGORY_OF_LABEL = {
    "PERSON": "PERSON",
    "ORG": "ORGANIZATION",
    "EMAIL_ADDRESS": "EMAIL",
    "PHONE_NUMBER": "PHONE",
    "US_SSN": "SSN",
    "CREDIT_CARD": "CREDIT_CARD",
    "IP_ADDRESS": "IP_ADDRESS",
    "DATE_OF_BIRTH": "DATE_OF_BIRTH",
    "LOCATION": "ADDRESS",
    "GPE": "ADDRESS",
}
MIN_SCORE = 0.5

# --------------------------------------------------------------------------
# FIXED VALUES - patterns (matched case-insensitively, Unicode classes)
# --------------------------------------------------------------------------
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"

PHONE_INDIA = r"(?:\+\s*91|091|\b91)[\s\-]*(?:\(?\d{2,4}\)?[\s\-]*)?\d{3,5}[\s\-]?\d{4,5}\b"
PHONE_STD = r"\b0\d{2,4}[\s\-]\d{6,8}\b"
PHONE_MOBILE = r"(?<!\d)[6-9]\d{9}(?!\d)"
PHONE_TOLL_FREE = r"\b1800[\s\-]?\d{3}[\s\-]?\d{3,4}\b"
PHONE_INTERNATIONAL = r"\+\d{1,3}[\s\-]?\(?\d{1,4}\)?[\s\-]?\d{3,4}[\s\-]?\d{3,4}\b"
PHONE_US = r"(?<!\d)\(?\d{3}\)?[\s\.\-]\d{3}[\s\.\-]\d{4}(?!\d)"

SSN = r"\b\d{3}-\d{2}-\d{4}\b"

CREDIT_CARD = r"(?<!\d)(?:\d{4}[\s\-]){3}\d{1,4}|(?:\d{4}[\s\-]){2}\d{4,6}|\d{13,19}(?!\d)"

IP_ADDRESS = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"

MONTH_NAMES = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
    "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
)
DATE = (
    r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4}\b"
    r"|\b\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}\b"
    rf"|\b(?:{MONTH_NAMES})[\s,]+\d{{1,2}}[,\s]+\d{{4}}\b"
    rf"|\b\d{{1,2}}\s+(?:{MONTH_NAMES})[,\s]+\d{{4}}\b"
    r"|\b\d{2}-[A-Za-z]{3}-\d{4}\b"
)
BIRTH_KEYWORDS = (
    "date of birth", "dob", "born on", "born", "birth date",
    "date of incorporation", "age as on", "age:", "aged",
)
BIRTH_KEYWORD_PIECES = ("birth", "dob", "born", "date of incorporation", "age as on", "age:", "aged")
BIRTH_KEYWORD_REACH = 120

LEGAL_SUFFIX = (
    r"Private\s+Limited|Pvt\.?\s*Ltd\.?|Public\s+Limited|\bLimited\b|\bLtd\.?|\bLLP\b|\bInc\.?|\bCorp\.?"
    r"|\bCorporation\b|\bEnterprises\b|\bIndustries\b|\bTechnologies\b|\bSolutions\b|\bServices\b"
    r"|\bHoldings\b|\bGroup\b|\bAssociates\b|\bConsultants\b|\bVentures\b|\bInternational\b"
)
LEGAL_SUFFIX_PIECES = (
    "limited", "pvt", "ltd", "llp", "inc", "corp", "enterprises", "industries", "technologies", "solutions",
    "services", "holdings", "group", "associates", "consultants", "ventures", "international",
)
ORGANIZATION = rf"\b[A-Z][A-Za-z&\-.]*(?:\s+[A-Z][A-Za-z&\-.]*){{0,5}}\s+(?:{LEGAL_SUFFIX})"

PIN_CODE = r"(?:pin(?:\s*code)?|postal(?:\s*code)?)\s*[:\-]?\s*[1-9]\d{5}|\b[1-9]\d{5}\b"

STREET_ENDING = (
    "Road|Street|Marg|Path|Lane|Avenue|Nagar|Colony|Vihar|Enclave|Industrial Area|Complex|Tower|Towers"
)
STREET_PIECES = (
    "floor", "plot", "survey", "khasra", "gat", "house", "flat", "shop", "unit", "wing", "sector", "phase",
    "block", "road", "street", "marg", "path", "lane", "avenue", "nagar", "colony", "vihar", "enclave",
    "industrial area", "complex", "tower",
)
STREET_HINT = (
    r"\bfloor\b|[A-Z\d]\s+floor|\b(?:plot|survey|khasra|gat|house|flat|shop|unit|sector|phase|block)"
    rf"|[A-Z\d]\s*[-–]?\s*wing\b|(?:{STREET_ENDING})\b"
)
STREET = (
    r"\b(?:\d{1,2}(?:st|nd|rd|th)?\s+Floor|[A-Z\d]+\s+Floor|Floor\s+[A-Z\d]+"
    r"|(?:Plot|Survey|Khasra|Gat|House|Flat|Shop|Unit)\s*(?:No\.?|Number|#)?\s*[\w\d/]+(?:\s*,\s*[\w\s]+)?"
    r"|[A-Z\d]\s*[-–]?\s*Wing\b"
    r"|(?:Sector|Phase|Block)\s*[-–]?\s*[A-Z\d]+"
    rf"|[A-Z][\w.\s]{{1,30}}?(?:{STREET_ENDING})\b)"
)

NAME_WORDS = r"[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){1,3}"
DESIGNATION = (
    r"Company\s+Secretary|Compliance\s+Officer|Managing\s+Director|Chief\s+Executive"
    r"|Technical\s+Director|Whole-Time\s+Director"
)
PERSON_CONTACT = rf"(?<=Contact\sPerson:\s){NAME_WORDS}"
PERSON_LABEL = rf"(?<=(?:Name|Promoter|Director):\s){NAME_WORDS}"
PERSON_DESIGNATION = rf"\b{NAME_WORDS}(?=\s+(?:{DESIGNATION}))"

# --------------------------------------------------------------------------
# FIXED VALUES - context words and how far they reach
# --------------------------------------------------------------------------
EMAIL_CONTEXT = ("email", "e-mail", "mail", "contact", "reach", "write to")
PHONE_CONTEXT = (
    "phone", "mobile", "cell", "contact", "tel", "telephone", "call", "reach",
    "whatsapp", "number", "fax", "helpline",
)
SSN_CONTEXT = ("ssn", "social security", "social security number", "tin", "tax id")
CARD_CONTEXT = (
    "card", "credit", "debit", "visa", "mastercard", "amex", "rupay", "payment",
    "card number", "pan", "cvv",
)
IP_CONTEXT = (
    "ip", "ip address", "ipv4", "host", "server", "address", "network", "subnet",
    "client", "source ip", "destination",
)
ORGANIZATION_CONTEXT = (
    "company", "organization", "firm", "incorporated", "registered", "promoter",
    "director", "subsidiary", "associate", "partner", "issued by", "managed by", "owned by",
)
ADDRESS_CONTEXT = (
    "address", "located", "registered office", "corporate office", "correspondence",
    "premises", "situated", "residing", "resident", "road", "street", "nagar", "colony",
    "floor", "plot", "wing", "sector", "phase", "block", "pin", "pincode", "postal",
)
CONTEXT_BOOST = 0.35
CONTEXT_TOKENS_BEFORE = 5
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has",
    "have", "he", "her", "his", "in", "is", "it", "its", "me", "my", "of", "on", "or",
    "our", "she", "so", "that", "the", "their", "there", "these", "they", "this", "those",
    "to", "us", "was", "we", "were", "with", "you", "your",
)
DICTIONARY_SCORE = 0.85
VALIDATED_SCORE = 1.0

# --------------------------------------------------------------------------
# FIXED VALUES - validators and filters
# --------------------------------------------------------------------------
SSN_IMPOSSIBLE_AREAS = ("000", "666")
CARD_MIN_DIGITS, CARD_MAX_DIGITS = 13, 19
PERSON_TITLE_WORDS = (
    "Company", "Secretary", "Compliance", "Officer", "Managing", "Director", "Chief",
    "Executive", "Technical", "Whole", "Time", "Financial", "Corporate", "General",
    "Manager", "Legal", "Counsel", "Head", "Lead", "Senior", "Partner", "Auditor",
    "Advocate", "Contact", "Person", "Name", "Promoter", "Key", "Management",
    "Personnel", "Our", "The",
)
NOT_A_NAME_TERMS = (
    "SEBI", "NSE", "BSE", "RBI", "MCA", "NCLT", "NCLAT",
    "RERA", "GSTIN", "PAN", "CIN", "DIN", "LLPIN", "GIN",
    "Rs", "INR", "USD", "EUR", "GBP",
    "Schedule", "Annexure", "Exhibit", "Section", "Chapter", "Clause", "Regulation",
    "Rule", "Table", "Figure", "Page", "Para",
    "FY", "Q[1-4]", "H[12]",
    "IPO", "OFS", "SME", "DRHP", "RHP",
)
FIELD_LABEL_TERMS = ("Email", "Phone", "Fax", "Website", "Contact")
ACRONYM_MAX_LENGTH = 6

# (pattern, reason), first hit wins
SUSPECT_VALUES = (
    (r"^(?:SEBI|NSE|BSE|RBI|MCA|RERA|NCLT|CIN|DIN|LLPIN)$", "Regulatory/legal abbreviation"),
    (r"^(?:Pvt\.?|Ltd\.?|LLP|Inc\.?|Corp\.?)$", "Legal entity suffix"),
    (r"(?i)^(?:Schedule|Annexure|Exhibit|Section|Clause|Chapter)\s+\w+$", "Document structure reference"),
    (r"^\d+(?:\.\d+)?$", "Numeric value"),
    (r"^(?:FY|Q[1-4]|H[12])\d{2,4}$", "Fiscal period"),
)

# --------------------------------------------------------------------------
# FIXED VALUES - files
# --------------------------------------------------------------------------
DOCX_SUFFIX = ".docx"
DOCX_MAX_BYTES = 25 * 1024 * 1024
DOCX_MAGIC_HEX = "504B0304"
DOCX_MAX_UNPACKED = 256 * 1024 * 1024

# --------------------------------------------------------------------------
# FIXED VALUES - logs and reports
# --------------------------------------------------------------------------
LOG_CONTEXT_CHARS = 80
LOG_PREVIEW_CHARS = 40
REPORT_ERROR_ROWS = 20
MASK = "[REDACTED]"

# --------------------------------------------------------------------------
# FIXED VALUES - formats of replacements (the word lists are this library's own)
# --------------------------------------------------------------------------
SAFE_MAIL_DOMAINS = ("example.com", "example.org", "example.net")
KNOWN_STD_CODES = ("020", "022", "011", "040", "080", "044", "033")
DEFAULT_STD_CODE = "020"
BIRTH_AGE_MIN, BIRTH_AGE_MAX = 18, 80
BIRTH_DATE_FORMAT = "dd/MM/yyyy"

FIRST_NAMES = (
    "Ada", "Alan", "Alma", "Amir", "Anna", "Arlo", "Asha", "Axel", "Beth", "Boris", "Carla", "Cyrus",
    "Dana", "Derek", "Edith", "Emil", "Fiona", "Frank", "Gita", "Gregor", "Hana", "Hugo", "Ines", "Ivan",
    "Jana", "Jonas", "Kira", "Kofi", "Lena", "Lionel", "Maya", "Milan", "Nadia", "Niels", "Olga", "Oscar",
    "Paula", "Pedro", "Quentin", "Rosa", "Ruben", "Sara", "Stefan", "Tara", "Tomas", "Uma", "Victor", "Wanda",
)
LAST_NAMES = (
    "Abbott", "Almeida", "Bauer", "Bell", "Carver", "Costa", "Dalton", "Dubois", "Eriksen", "Ellis", "Falk",
    "Ferrara", "Garner", "Grant", "Hale", "Horvat", "Ibsen", "Irwin", "Jansen", "Joyce", "Keller", "Klein",
    "Lambert", "Lund", "Marsh", "Moreau", "Nash", "Novak", "Olsen", "Ortiz", "Palmer", "Petrov", "Quinn",
    "Ramos", "Reed", "Sato", "Stone", "Tanaka", "Torres", "Ueda", "Vance", "Vogel", "Walsh", "Weber", "Xavier",
    "Yates", "Young", "Zeller",
)
COMPANY_STEMS = (
    "Amber", "Birch", "Cedar", "Copper", "Delta", "Ember", "Falcon", "Granite", "Harbor", "Indigo", "Juniper",
    "Kestrel", "Lagoon", "Maple", "Nimbus", "Onyx", "Prairie", "Quartz", "Ridge", "Summit", "Tundra", "Umber",
    "Vertex", "Willow",
)
COMPANY_NOUNS = ("Analytics", "Bakery", "Foods", "Freight", "Glass", "Labs", "Metals", "Motors", "Paper", "Textiles")
COMPANY_ENDINGS = ("LLC", "Inc", "Ltd", "PLC", "and Sons", "Group")
STREET_STEMS = (
    "Acorn", "Briar", "Clover", "Dune", "Elm", "Fern", "Grove", "Hazel", "Iris", "Jasmine", "Larch", "Meadow",
    "Nettle", "Oak", "Poplar", "Rowan", "Sage", "Thistle", "Violet", "Yarrow",
)
STREET_KINDS = ("Street", "Road", "Lane", "Avenue", "Court", "Drive")
TOWNS = (
    "Ashford", "Brookfield", "Clearwater", "Dunmore", "Eastvale", "Fairview", "Glenwood", "Highbury",
    "Kingsport", "Lakeside", "Millbrook", "Northfield", "Oakmont", "Pinehurst", "Riverton", "Westbrook",
)
