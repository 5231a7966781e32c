"""Detection and pseudonymization rules.

FIXED VALUES -- patterns, scores, keyword lists, heading names and replacement pools below
must equal the behaviour being reproduced, so they are written out plainly and together.
Patterns are in Java regex syntax (Spark's engine); the only dialect changes are
``(?md)`` for Python's MULTILINE (``\\n``-only line ends), ``\\z`` for Python's ``\\Z`` and
the COMPANY prefix rewritten with mandatory separators (the original form backtracks
exponentially; both find the same companies, see README).
"""

# ----------------------------------------------------------------- FIXED VALUES: structured

EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
EMAIL_SCORE = 0.99

_EXT = r"(?:\s*(?:ext\.?|x|extension)\s*\d{1,5})?"
PHONE_PATTERNS = [
    # (recognizer, pattern, base score, digit-count rule)
    ("indian_phone", r"(?<!\d)(?:\+?91[\s\-.]?)?(?:\(?0?\)?[\s\-.]?)?[6-9]\d{9}" + _EXT + r"(?!\d)", 0.90, True),
    ("us_phone", r"(?<!\d)(?:\+?1[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}" + _EXT + r"(?!\d)", 0.90, True),
    ("indian_landline", r"(?<!\d)0\d{2,4}[\s\-.]?\d{4}[\s\-.]?\d{4}" + _EXT + r"(?!\d)", 0.88, True),
    ("dotted_phone", r"\b(?:\+?\d{1,3}\.)?\d{3,5}\.\d{4,5}\b", 0.85, False),
]
PHONE_KEYWORDS = ["phone", "mobile", "cell", "tel", "telephone", "contact", "call", "fax", "reach", "dial", "whatsapp"]
PHONE_BOOST = 0.08

SSN_DASHED = r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b"
SSN_NODASH = r"\b(?!000|666|9\d{2})\d{3}(?!00)\d{2}(?!0000)\d{4}\b"
SSN_GROUPED = r"\b\d{4}\s\d{4}\s\d{4}\b"
SSN_KEYWORDS = ["ssn", "social security", "ss#", "ss #", "tax id", "taxpayer", "social security number",
                "aadhaar", "national id"]
SSN_SCORES = {"dashed": 0.92, "dashed_kw": 0.99, "nodash_kw": 0.85, "grouped": 0.95}

CARD_PATTERNS = [
    ("visa", r"\b4\d{3}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b"),
    ("mastercard", r"\b5[1-5]\d{2}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b"),
    ("amex", r"\b3[47]\d{2}[\s\-]?\d{6}[\s\-]?\d{5}\b"),
    ("discover", r"\b6(?:011|5\d{2})[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b"),
    ("generic16", r"\b\d{4}[\s\-]\d{4}[\s\-]\d{4}[\s\-]\d{4}\b"),
]
CARD_KEYWORDS = ["card", "credit", "debit", "visa", "mastercard", "amex", "american express", "discover",
                 "payment", "card number", "cc"]
CARD_SCORES = {"base": 0.95, "kw": 0.99}

IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
IPV6 = r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"
IP_SCORES = {"v4": 0.95, "v6": 0.93}
# word list of the dormant rules, word boundary of the active validator ("server 10.0.0.2" is an IP)
IP_VERSION_PREFIX = r"(?i)\b(?:version|v|ver|release|build|revision)\s*\.?\s*$"

URL = (r"(?i)(?:https?://|www\.)[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+"
       r"|(?:linkedin\.com|github\.com|gitlab\.com|bitbucket\.org)[/A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]*")
URL_SCORE = 0.99

# substrings every match needs (pre-filters; lower-case where the pattern ignores case)
URL_GUARD = ["://", "www.", "linkedin.com", "github.com", "gitlab.com", "bitbucket.org"]
TITLE_GUARD = ["Mr", "Ms", "Dr", "Prof"]
COMPANY_GUARD = ["Ltd", "Limited", "LLP", "L.L.P", "LLC", "L.L.C", "Inc", "Corp", "Technologies", "Solutions",
                 "Systems", "Industries", "Enterprises", "Services", "Group", "Holdings", "Partners", "Associates"]
STREET_GUARD = ["St", "Ave", "Boulevard", "Blvd", "Dr", "Lane", "Ln", "Road", "Rd", "Way", "Court", "Ct", "Cir",
                "Pl", "Ter", "Trail", "Trl", "Parkway", "Pkwy"]

STRUCTURED_TYPES = ["URL", "EMAIL", "PHONE", "SSN", "CREDIT_CARD", "IP_ADDRESS"]
STRUCTURED_MIN = 0.85
AMBIGUOUS_MIN = 0.80

# ----------------------------------------------------------------- FIXED VALUES: contextual

PERSON_LABELS = ["Full\\s+Name", "Name", "Contact", "Candidate", "Customer", "Employee", "Applicant", "Client",
                 "Patient", "Witness", "Author", "Sender", "Recipient"]
PERSON_LABEL = (r"(?<pre>(?md:^)[ \t]*(?:" + "|".join(PERSON_LABELS) + r")\s*[:]\s*)"
                r"(?<val>[A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){1,3})")
PERSON_HEADER = r"^[A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){1,3}$"
PERSON_TITLE = r"\b(?:Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Prof\.?)[ \t]+[A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){1,2}\b"
PERSON_SHORT_LINE = r"(?<pre>(?md:^)[ \t]*)(?<val>[A-Z][a-z]{1,15}(?:[ \t]+[A-Z][a-z]{1,15}){1,2})(?=[ \t]*(?md:$))"
PERSON_SCORES = {"label": 0.97, "header": 0.95, "title": 0.92, "short_line": 0.85, "label_ctx": 0.99}
SHORT_LINE_MAX = 60
SUPPRESSED_SECTIONS = ["SKILLS", "TECHNICAL_SKILLS", "PROJECTS", "TRAINING", "CERTIFICATIONS", "ACHIEVEMENTS",
                       "EDUCATION"]

COMPANY_SUFFIXES = (r"Pvt\.?[ \t]+Ltd\.?|Private[ \t]+Limited|Ltd\.?|Limited|LLP|L\.L\.P\.?|LLC|L\.L\.C\.?|"
                    r"Inc\.?|Incorporated|Corp\.?|Corporation|Co\.?[ \t]+Ltd\.?|Technologies|Solutions|Systems|"
                    r"Industries|Enterprises|Services|Group|Holdings|Partners|Associates")
COMPANY = (r"\b[A-Z][A-Za-z&'\-]*(?:[ \t]+[A-Z][A-Za-z&'\-]*){0,4}[ \t]+(?:" + COMPANY_SUFFIXES + r")\b")
COMPANY_SCORE = 0.90
COMPANY_SUFFIX_CHECK = (r"\b(Pvt\.? Ltd\.?|Private Limited|Ltd\.?|Limited|LLP|L\.L\.P\.?|LLC|L\.L\.C\.?|"
                        r"Inc\.?|Incorporated|Corp\.?|Corporation|Co\.? Ltd\.?|"
                        r"Technologies|Solutions|Systems|Industries|Enterprises|Services|Group|Holdings|Partners|"
                        r"Associates)\b")
COMPANY_CONTEXT_WORDS = ["employed", "by", "at", "for", "with", "from", "of", "the", "a", "an", "vendor", "contract",
                         "held", "consulting", "engagement", "working", "works", "worked", "joined", "joining",
                         "hired", "founded", "managed", "managing", "led", "leading", "in", "to", "and", "or", "on",
                         "as"]
COMPANY_REJECT = r"(?i)\b(?:University|College)\b"

ADDRESS_STREET = (
    r"\b\d{1,5}[A-Za-z]?[ \t]+(?:[A-Z][a-z]+[ \t]*){1,4}"
    r"(?:Street|St\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Drive|Dr\.?|"
    r"Lane|Ln\.?|Road|Rd\.?|Way|Court|Ct\.?|Circle|Cir\.?|"
    r"Place|Pl\.?|Terrace|Ter\.?|Trail|Trl\.?|Parkway|Pkwy\.?)"
    r"(?:[ \t]*,?[ \t]*(?:Suite|Ste\.?|Apt\.?|Unit|#)[ \t]*\d+)?"
    r"(?:[ \t]*,[ \t]*(?![A-Z]{1,2}\d)(?![A-Z]{2}[ \t]+\d)(?:[A-Za-z][A-Za-z ]*[A-Za-z]))*"
    r"(?:[ \t]*,?[ \t]*[A-Z]{1,2}\d[A-Z\d]?[ \t]+\d[A-Z]{2})?"
    r"(?:[ \t]*,?[ \t]*[A-Z]{2}[ \t]+\d{5}(?:-\d{4})?)?"
    r"(?:[ \t]*,?[ \t]*\d{6})?"
    r"(?:[ \t]*,[ \t]*[A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+)*)?"
)
ADDRESS_PO_BOX = r"(?i)\bP\.?O\.?[ \t]*Box[ \t]+\d+(?:[ \t]*,[ \t]*[A-Za-z][A-Za-z \t]*)*"
ADDRESS_PIN = r"(?i)(?:PIN|Pincode|Postal[ \t]+Code|ZIP)[ \t]*[:.]?[ \t]*\d{6}\b"
ADDRESS_LABEL = (r"(?is)(?<pre>(?:Address|Mailing[ \t]+Address|Home[ \t]+Address|Residence|Residential[ \t]+Address)"
                 r"[ \t]*[:.][ \t]*)(?<val>.+?)(?=\n\n|\n[A-Z]|\z)")
ADDRESS_SCORES = {"pattern": 0.88, "label": 0.92}
ADDRESS_LABEL_LEN = (10, 300)

_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_MON = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DOB_PATTERNS = [
    ("dob_mdy", r"\b(?:0[1-9]|1[0-2])[/\-](?:0[1-9]|[12]\d|3[01])[/\-](?:19|20)\d{2}\b"),
    ("dob_iso", r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b"),
    ("dob_month_day", r"(?i)\b(?:" + _MONTHS + r")[ \t]+\d{1,2}(?:st|nd|rd|th)?,?[ \t]+(?:19|20)\d{2}\b"),
    ("dob_ordinal", r"(?i)\b\d{1,2}(?:st|nd|rd|th)[ \t]+(?:" + _MONTHS + "|" + _MON + r"),?[ \t]+(?:19|20)\d{2}\b"),
    ("dob_day_month", r"(?i)\b\d{1,2}[ \t]+(?:" + _MONTHS + r"),?[ \t]+(?:19|20)\d{2}\b"),
]
DOB_KEYWORDS = ["dob", "d.o.b", "date of birth", "birth date", "birthdate", "born", "born on", "birthday"]
DOB_SCORE = 0.93
DATE_BIRTH_WORDS = ["dob", "d.o.b", "birth", "born", "birthday", "birthdate"]
DATE_SCORE = 0.90
DOB_ORDINAL_PREFIX = r"(?i)(\d{1,2}(?:st|nd|rd|th)\s+)$"

# ----------------------------------------------------------------- FIXED VALUES: validation

PERSON_STREET_SUFFIX = (r"(?i)(\s+(?:Boulevard|Blvd\.?|Street|St\.?|Avenue|Ave\.?|Drive|Dr\.?|Lane|Ln\.?|Road|Rd\.?|"
                        r"Way|Court|Ct\.?|Circle|Cir\.?|Place|Pl\.?|Terrace|Ter\.?))$")
TECH_DENYLIST = ["gemini", "react", "node", "java", "python", "spring", "docker", "aws"]
FIELD_DENYLIST = ["email", "mobile", "phone", "github", "linkedin", "address", "date"]
PERSON_LEFT_LABEL = r"(?i)(?:Name|Contact|Candidate|Applicant|Employee|Client|Patient|Witness)[ \t]*[:]\s*$"
ADDRESS_HEADING_NUMBER = r"(?:^|\n)\d+\.\d+\s*$"
IP_VERSION_WINDOW = 20
IP_URL_LOOKAHEAD = 20
KEYWORD_WINDOW = 60
DOB_WINDOW = 80

# ----------------------------------------------------------------- FIXED VALUES: sections

HEADING = r"(?md)^[ \t]*([A-Z][A-Z &/\-]+[A-Z])[ \t]*:?[ \t]*$"
URL_LINE = r"://[^\n]*"
SECTION_NAMES = {
    "contact": "CONTACT", "contact information": "CONTACT", "contact details": "CONTACT",
    "personal information": "CONTACT", "personal details": "CONTACT",
    "summary": "SUMMARY", "professional summary": "SUMMARY", "profile": "SUMMARY", "objective": "SUMMARY",
    "career objective": "SUMMARY", "about me": "SUMMARY", "about": "SUMMARY",
    "skills": "SKILLS", "technical skills": "SKILLS", "technologies": "SKILLS", "tech stack": "SKILLS",
    "core competencies": "SKILLS", "competencies": "SKILLS", "tools": "SKILLS", "tools & technologies": "SKILLS",
    "experience": "EXPERIENCE", "work experience": "EXPERIENCE", "professional experience": "EXPERIENCE",
    "employment history": "EXPERIENCE", "work history": "EXPERIENCE",
    "projects": "PROJECTS", "personal projects": "PROJECTS", "academic projects": "PROJECTS",
    "key projects": "PROJECTS",
    "education": "EDUCATION", "academic background": "EDUCATION", "qualifications": "EDUCATION",
    "academic qualifications": "EDUCATION",
    "training": "TRAINING", "courses": "TRAINING", "professional development": "TRAINING",
    "certifications": "CERTIFICATIONS", "certificates": "CERTIFICATIONS",
    "professional certifications": "CERTIFICATIONS", "licenses": "CERTIFICATIONS",
    "achievements": "ACHIEVEMENTS", "awards": "ACHIEVEMENTS", "honors": "ACHIEVEMENTS",
    "accomplishments": "ACHIEVEMENTS",
    "publications": "PUBLICATIONS", "research": "PUBLICATIONS",
    "references": "REFERENCES",
}

# ----------------------------------------------------------------- FIXED VALUES: replacements

FIRST_NAMES = ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Charles", "Joseph", "Thomas",
               "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen"]
LAST_NAMES = ["Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis", "Rodriguez", "Martinez",
              "Hernandez", "Lopez", "Gonzalez", "Wilson", "Anderson", "Thomas", "Taylor", "Moore", "Jackson", "Martin"]
EMAIL_NAMES = ["alex", "taylor", "jordan", "casey", "morgan", "riley", "sam", "jamie"]
EMAIL_DOMAINS = ["example.com", "test.org", "sample.net", "demo.io"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
          "November", "December"]
SHORT_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
TEST_NETS = ["192.0.2", "198.51.100", "203.0.113"]
COMPANY_PREFIXES = ["Acme", "Globex", "Initech", "Soylent", "Massive", "Apex", "Zenith", "Quantum"]
COMPANY_SUFFIX_POOL = ["Corp", "Inc", "LLC", "Ltd", "Solutions", "Technologies", "Enterprises"]
DOB_YEARS = (1950, 2005)
DOB_DAYS = (1, 28)
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
LOW_CONFIDENCE = 0.70
