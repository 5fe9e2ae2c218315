"""Fixed values for document quality rules."""


def word(options: str) -> str:
    """Options between non-word characters, written so that every regex engine agrees."""
    return rf"(?:^|[^A-Za-z0-9_])(?:{options})(?:$|[^A-Za-z0-9_])"


BULLET = r"^[ \t]*(?:[\-*•▪▸►]|[0-9]+\.)[ \t]+"
HEADING = r"^[ \t]*[A-Z][A-Z &/'\-]{3,}[ \t]*:?[ \t]*$"
DATE_LINE = r"^[ \t]*(?:[A-Za-z]{3,9}\.?[ \t]+[0-9]{4}|[0-9]{1,2}/[0-9]{4}|[0-9]{4})[ \t]*[-–—][ \t]*(?:[Pp]resent|[Cc]urrent|.+)$"
CURRENT = r"(?i)" + word("present|current|now|to date|ongoing")

# Openers that describe presence, and verbs that describe work.
WEAK_OPENERS = [
    "responsible for", "helped", "helped with", "helped to", "assisted", "assisted with", "worked on", "worked with",
    "participated in", "involved in", "contributed to", "in charge of", "tasked with", "duties included", "role involved",
    "responsibilities included",
]
STRONG_VERBS = (
    "built shipped designed launched deployed scaled led managed drove delivered owned created developed engineered "
    "architected rebuilt reduced increased grew doubled tripled cut saved generated closed won mentored hired rolled "
    "migrated consolidated modernised modernized automated instrumented productionised productionized open-sourced "
    "authored published presented negotiated partnered enabled unblocked fixed optimised optimized restructured "
    "refactored translated consulted advised"
).split()
BASE_VERBS = (
    "build lead manage own drive deliver develop design create maintain support run oversee handle coordinate collaborate "
    "partner work write author review analyse analyze report monitor track test deploy automate optimise optimize improve "
    "reduce increase ensure provide produce present train mentor hold serve act help contribute participate facilitate "
    "administer implement integrate configure troubleshoot resolve investigate define plan set"
).split()
IRREGULAR_PAST = (
    "led built held ran wrote drove grew made kept set cut put spent taught brought won took gave began chose found met "
    "sent sold spoke rebuilt oversaw drew rose became left dealt"
).split()

# Repetition, numbers, scope.
REPEAT_STOP_WORDS = (
    "the and for with from that this into over across using their them were was has had have via per out not all new end "
    "its data team work time year years more than both"
).split()
LINE_SHAPES = [
    ("action-metric-outcome", r"(?i)^[a-z0-9_]+e?d?[ \t].*[0-9]+%?.*(?:resulting|leading|achieving|producing)"),
    ("action-using-tool", r"(?i)^[a-z0-9_]+e?d?[ \t].*(?:using|via|through|applying|employing)[ \t]"),
    ("action-by-purpose", r"(?i)^[a-z0-9_]+e?d?[ \t].*(?:by|for)[ \t]"),
    ("metric-first", r"^[0-9]"),
]
SCALE = r"(?i)" + word("[0-9]|million|billion|thousand|k|m|x|x[0-9]+|first|only|sole|all|every") + "|%|[0-9]"
METRICS = [
    r"[0-9]+(?:\.[0-9]+)?[ ]*%",
    r"(?i)[£$€¥] ?[0-9][0-9.,]*[ ]*(?:k|m|bn|b|million|billion|thousand)?",
    r"(?i)[0-9][0-9,]{2,}[ ]*(?:users|customers|clients|accounts|records|requests|transactions|orders|deals|leads|hours|queries|api calls|downloads|installs)",
    r"(?i)(?:by|to|from|of|over|under|above|below)[ ]+[0-9]+(?:\.[0-9]+)?[ ]*(?:%|x|times|fold)",
    r"(?i)[0-9]+(?:\.[0-9]+)?[ ]*[x×][ ]+(?:faster|slower|more|less|increase|reduction|improvement|growth|uplift)",
    r"(?i)[0-9]+(?:\.[0-9]+)?[ ]*(?:ms|s|seconds|minutes|hours|days|weeks|months|years)(?:$|[^A-Za-z0-9_])",
]
SCOPE = (
    r"(?i)team of [0-9]+|[0-9]+[ ]+(?:engineers|analysts|developers|people|reports|consultants|staff)"
    r"|[£$€] ?[0-9][0-9,.]* ?(?:k|m|bn|b|million|billion)?"
    r"|[0-9]+[ ]+(?:stakeholder|client|customer|country|countries|office|market|team|service|system|application)s?"
    r"|(?:managed|led|mentored|trained|supervised)[ ]+[0-9]+"
)
BIG_STAT = (
    r"(?i)[0-9]{2,3}%|(?:gbp|usd|eur|\$|£|€)? ?[0-9]+(?:\.[0-9]+)?[ ]*(?:m\+?|b\+?|k\+?|tb|gb|million|billion|thousand)(?:$|[^A-Za-z0-9_])|[0-9]{5,}"
)

# Language.
PRONOUNS = r"(?:^|[^A-Za-z])(?:I|I'm|I've|[Mm]y|[Mm]e|[Mm]ine|[Ww]e|[Oo]ur|[Oo]urs|[Uu]s)(?:[^A-Za-z]|$)"
DUTY_RULES = [
    ("passive voice", r"(?i)" + word(r"(?:was|were|been|being)[ ]+(?:[a-z]+ly[ ]+)?[a-z]+(?:ed|en)")),
    ("responsible for", r"(?i)" + word(r"responsible[ ]+for")),
    ("tasked with", r"(?i)" + word(r"tasked[ ]+with")),
    ("duties included", r"(?i)" + word(r"duties[ ]+(?:included|involved)")),
    ("in charge of", r"(?i)" + word(r"in[ ]+charge[ ]+of")),
    ("involved in", r"(?i)" + word(r"involved[ ]+in")),
    ("helped", r"(?i)" + word(r"helped[ ]+(?:to[ ]+)?[a-z]+")),
    ("assisted with", r"(?i)" + word(r"assisted[ ]+(?:with|in)")),
]

# Format.
DATE_FORMATS = [
    ("MM/YYYY", r"(?:^|[^A-Za-z0-9_])(?:0[1-9]|1[0-2])/[0-9]{4}(?:$|[^A-Za-z0-9_])"),
    ("Month YYYY", r"(?:^|[^A-Za-z0-9_])(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?[ ]+[0-9]{4}(?:$|[^A-Za-z0-9_])"),
    ("YYYY-MM", r"(?:^|[^A-Za-z0-9_])[0-9]{4}-(?:0[1-9]|1[0-2])(?:$|[^A-Za-z0-9_])"),
    ("MM-YYYY", r"(?:^|[^A-Za-z0-9_])(?:0[1-9]|1[0-2])-[0-9]{4}(?:$|[^A-Za-z0-9_])"),
]
STANDARD_HEADINGS = [
    ("experience", r"(?im)^[ \t]*(?:PROFESSIONAL[ ]+|WORK[ ]+|RELEVANT[ ]+)?(?:EXPERIENCE|EMPLOYMENT(?:[ ]+HISTORY)?|CAREER[ ]+HISTORY)[ \t]*:?[ \t]*$"),
    ("summary", r"(?im)^(?:(?:PROFESSIONAL[ ]+)?SUMMARY|PROFILE)[ \t]*:?[ \t]*$"),
    ("education", r"(?im)^EDUCATION[ \t]*:?[ \t]*$"),
    ("skills", r"(?im)^(?:(?:TECHNICAL[ ]+)?SKILLS|TECHNICAL PROFICIENCIES|CORE COMPETENCIES)[ \t]*:?[ \t]*$"),
]
SECTION_WORDS = [
    ("summary", r"(?i)" + word("summary|profile|about me|personal statement|career objective")),
    ("experience", r"(?i)" + word("experience|employment|work history|professional experience|career history")),
    ("education", r"(?i)" + word("education|academic background|qualifications|degrees")),
    ("skills", r"(?i)" + word("skills|technical skills|core competenc(?:y|ies)|technologies|tech stack")),
]
#: Lower-case strings of which every match of a pattern holds one.
DATE_NEEDLES = {"MM/YYYY": ["/"], "Month YYYY": ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"], "YYYY-MM": ["-"], "MM-YYYY": ["-"]}
HEADING_NEEDLES = {"experience": ["experience", "employment", "career"], "summary": ["summary", "profile"], "education": ["education"], "skills": ["skills", "technical proficiencies", "core competencies"]}
SECTION_NEEDLES = {"summary": ["summary", "profile", "about me", "personal statement", "career objective"], "experience": ["experience", "employment", "work history", "career history"],
                   "education": ["education", "academic background", "qualifications", "degrees"], "skills": ["skills", "core competenc", "technologies", "tech stack"]}
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?[0-9]{1,3}[ .\-]?)?\(?[0-9]{2,4}\)?[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}"
PROFILE = r"(?i)linkedin\.com/in/[A-Za-z0-9\-_.]+"
_CITIES = ("London|Manchester|Birmingham|Leeds|Bristol|Liverpool|Edinburgh|Glasgow|Cardiff|Belfast|Dublin|New York|San Francisco"
           "|Boston|Seattle|Austin|Chicago|Los Angeles|Toronto|Berlin|Paris|Amsterdam|Remote|Hybrid|United Kingdom")
_SHORT_PLACES = "UK|USA|US|EU|Europe"
PLACES = r"(?i)" + word(f"{_CITIES}|{_SHORT_PLACES}")
#: The same in parts, with the strings that their matches hold: any of them found is PLACES found.
PLACE_PARTS = [(r"(?i)" + word(_CITIES), _CITIES.lower().split("|")), (r"(?i)" + word(_SHORT_PLACES), ["uk", "us", "eu"])]

# Consistency.
UK_CLASS = r"(?i)" + word("First Class Honours|Second Class Honours|Upper Second|Lower Second|Third Class|Distinction|Merit|Pass")
GPA = r"(?i)(?:^|[^0-9.])[0-9]{1,2}\.[0-9]{1,2}[ ]*/[ ]*(?:4\.0{0,2}|5\.0{0,2})|GPA[: ]+[0-9]{1,2}\.[0-9]{1,2}"
CERT_DOMAINS = [
    ("security", r"(?i)CISSP|Security\+|CompTIA Security|CEH|CISM|CISA|OSCP|GIAC"),
    ("cloud", r"(?i)AWS Certified|Azure (?:Administrator|Solutions|Developer|AZ-[0-9])|Google Cloud|GCP Certified|Professional Cloud|Solutions Architect"),
    ("data", r"(?i)Data Analyst|Data Engineer|Data Scientist|Databricks|Snowflake|Microsoft Certified:[ ]*Data|Google Data Analytics"),
    ("ml", r"(?i)Machine Learning|Deep Learning|TensorFlow Developer|Azure AI Engineer|AI Engineer Associate"),
    ("project", r"(?i)PMP|PMI|PRINCE2|CAPM|Agile|Scrum Master|CSM|PSM|Certified ScrumMaster|ITIL"),
    ("business", r"(?i)CBAP|Business Analysis Professional|Six Sigma|Lean Six Sigma"),
    ("crm", r"(?i)Salesforce (?:Admin|Administrator|Developer|Architect)|HubSpot Certified"),
    ("finance", r"(?i)CFA|FRM|ACCA|CIMA|Series [0-9]"),
]
PROJECT_LINK = r"(?i)https?://|www\.|github\.com|gitlab\.com|bitbucket\.org|live[ ]*demo|source[ ]*code|repo(?:sitory)?|\.(?:io|dev|app)/|↗"
GENERIC_PROJECT = r"(?i)" + word(r"to-?do[ ]*(?:list|app|application)?|calculator|weather[ ]*app(?:lication)?|notes?[ ]*app")
REPO_HANDLE = r"(?i)github\.com/([A-Za-z0-9][A-Za-z0-9\-]{0,38})"
NOT_HANDLES = ["orgs", "sponsors", "features", "about", "pricing", "topics"]

# Generated-prose tells.
PARTICIPIAL_TAILS = r"(?i),[ \t\r\n]+(?:enabling|ensuring|allowing|providing|delivering|driving|leveraging|facilitating|streamlining|empowering)(?:$|[^A-Za-z0-9_])"
TRICOLON = r"[A-Za-z0-9_]+, [A-Za-z0-9_]+,? and [A-Za-z0-9_]+"
STOCK_PHRASES = [
    "fast-paced environment", "proven track record", "results-driven", "dynamic professional", "cross-functional teams",
    "high-quality (?:solutions|products|results)", "make a difference", "wealth of experience", "passionate about",
    "seamless", "cutting-edge", "meticulous", "honed my skills",
]
PASSIVE = r"(?i)(?:^|[^A-Za-z0-9_])(?:was|were|been|being|is|are)[ \t]+[A-Za-z0-9_]+(?:ed|en)(?:$|[^A-Za-z0-9_])"

# Words that read as filler (a lexicon; callers pass their own for other languages).
FILLER_WORDS = [
    "very", "really", "just", "basically", "actually", "literally", "essentially", "absolutely", "totally", "simply",
    "honestly", "definitely", "certainly", "obviously", "clearly", "quite", "somewhat", "arguably",
]

# Placeholders that must never leave the house.
PLACEHOLDERS = [
    r"(?i)\[[ ]*(?:fill[ _\-]*in|insert|add|your|tbd|todo|number|metric|percent|amount|value|placeholder|company[ _\-]*name|role[ _\-]*title|x+|[0-9]*[ ]*%)[^\]]*\]",
    r"(?:^|[^A-Za-z0-9_])(TBD|TODO)(?:$|[^A-Za-z0-9_])",
    r"<[A-Z][A-Z_]{2,}>",
    r"(?i)\[[ ]*(?:job|role)[ ]*title[ ]*\]|\[[ ]*(?:degree|school|university|institution)[ ]*name[ ]*\]|\[[ ]*dates?[ ]*\]|\[[^\]]{0,40}if[ ]+applicable[^\]]*\]",
    r"\{\{[^}\n]+\}\}",
]

# Line types in test order.
LINE_TYPES = [
    ("leadership", r"(?i)led|managed|directed|oversaw|supervised"),
    ("achievement", r"(?i)improved|increased|reduced|optimized|enhanced"),
    ("technical", r"(?i)developed|built|created|designed|implemented"),
    ("collaboration", r"(?i)collaborated|worked with|partnered"),
    ("quantified", r"(?i)[0-9]+%|\$[0-9]+|[0-9]+x"),
]

# Noise in lines.
FILLER_LINE = (
    r"(?i)^(?:demonstrated|applied|utilised|utilized|leveraged)[ ]+[^.]{0,120}(?:across (?:cross-functional|multiple) projects"
    r"|contributing to continuous process improvement|driving (?:measurable )?(?:results|success)|ensuring (?:timely )?(?:project )?(?:completion|success))"
)
TAIL = r"(?i),[ ]*(?:with|using|through|via|by|and|including|incorporating|applying|leveraging)[ ]+([^.;,]{2,70})[ ]*\.?[ ]*$"
STANDARD_TAIL = r"(?i),[ ]*(?:with|using|including|per|to|under|and)[ ]+(?:ISO|IEC|DIN|ANSI|ASTM|ASME|IPC|NFPA|OSHA|SAE|MIL|BS|AS|EN|UL|API)[ \-]?[A-Z]?[ \-]?[0-9]{2,5}(?:[:\-][0-9]{2,4})?[ ]*\.?[ ]*$"
PERCENTAGE = r"(?i),?[ ]*(?:by[ ]+(?:about[ ]+|around[ ]+|roughly[ ]+|nearly[ ]+|over[ ]+|up[ ]+to[ ]+)?)?[0-9]{1,3}(?:[.,][0-9]+)?[ ]*(?:%|per ?cent)"
CONCRETE = r"[0-9]|[a-z][A-Z]|[A-Z][a-z]+ [A-Z][a-z]+|(?i:aws|azure|sql|python|java|kubernetes|docker|terraform|kafka|spark|salesforce|sap|jira|llm)"
LOOKING = r"(?i)(?:looking (?:for|to)|seeking|open to (?:new )?(?:opportunit|role|position)|aspir(?:e|ing) to)"

# Display casing and opener repair.
CASING = {
    "sql": "SQL", "aws": "AWS", "gcp": "GCP", "api": "API", "rest": "REST", "html": "HTML", "css": "CSS", "json": "JSON",
    "xml": "XML", "etl": "ETL", "ml": "ML", "ai": "AI", "nlp": "NLP", "llm": "LLM", "gpu": "GPU", "cpu": "CPU", "ui": "UI",
    "ux": "UX", "http": "HTTP", "ssh": "SSH", "tcp": "TCP", "dns": "DNS", "vpn": "VPN", "cdn": "CDN", "iam": "IAM",
    "jwt": "JWT", "ci/cd": "CI/CD", "ios": "iOS", "npm": "npm", "jquery": "jQuery", "grpc": "gRPC", "oauth": "OAuth",
}
GERUND_PAST = {
    "developing": "Developed", "managing": "Managed", "building": "Built", "creating": "Created", "leading": "Led",
    "designing": "Designed", "implementing": "Implemented", "maintaining": "Maintained", "delivering": "Delivered",
    "improving": "Improved", "supporting": "Supported", "coordinating": "Coordinated", "overseeing": "Oversaw",
    "driving": "Drove", "running": "Ran", "writing": "Wrote", "testing": "Tested", "deploying": "Deployed",
    "migrating": "Migrated", "optimising": "Optimised", "optimizing": "Optimized", "automating": "Automated",
    "analysing": "Analysed", "analyzing": "Analyzed", "ensuring": "Ensured", "establishing": "Established",
    "mentoring": "Mentored", "collaborating": "Collaborated", "executing": "Executed", "defining": "Defined",
    "launching": "Launched", "architecting": "Architected", "reviewing": "Reviewed", "monitoring": "Monitored",
    "documenting": "Documented",
}
WEAK_PREFIX = r"(?i)^((?:[\-*•][ ]*|[0-9]+\.[ ]+)?)(?:responsible for|tasked with|in charge of|duties included|worked on|helped with|assisted with|assisted in)[ ]+([a-z]+ing)(?=$|[^A-Za-z0-9_])"
