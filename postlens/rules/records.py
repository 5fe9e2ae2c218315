"""Fixed values for structured records, places and people."""

from postlens.rules.quality import word

# Date shapes, in the order they are tried.
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
SOFT_ITEMS = [
    "collaboration", "communication", "teamwork", "leadership", "problem-solving", "initiative", "ownership", "passion",
    "dedication", "motivation", "self-starter", "interpersonal", "proactive", "detail-oriented",
]

# The pairs of skill groups that merge first, and the line budget.
GROUP_MERGES = [
    ("Frameworks & Libraries", "Programming Languages", "Languages & Frameworks"),
    ("Databases", "Data & AI", "Data & Databases"),
    ("Security", "Support & Platforms", "Support & Security"),
    ("Architecture & Systems", "Cloud & DevOps", "Cloud & Architecture"),
]
MAX_GROUPS = 6

# Names under which profiles store the same thing, first non-empty wins.
EXPERIENCE_FIELDS = ["professional_experience", "professionalExperience", "work_experience", "workExperience"]
ROLE_FIELDS = {
    "company": ["company", "companyName", "company_name", "immutable_fields.company_name.value"],
    "title": ["title", "jobTitle", "job_title", "immutable_fields.job_title.value"],
    "start": ["startDate", "start_date", "immutable_fields.employment_dates.start_date.value"],
    "end": ["endDate", "end_date", "immutable_fields.employment_dates.end_date.value"],
}
BULLET_FIELDS = [
    "bullets", "description", "descriptions", "responsibilities", "achievements", "accomplishments", "highlights", "points",
    "details", "duties", "summary", "text", "content",
]

# Cue words of education lines and header fields.
INSTITUTION = r"(?i)" + word("University|College|Institute|School|Academy")
DEGREE = r"(?i)" + word(r"Bachelor|Master|PhD|Doctor|Associate|Diploma|Certificate|B\.?S\.?|M\.?S\.?|B\.?A\.?|M\.?A\.?|M\.?B\.?A\.?")
COMPANY_SUFFIX = r"(?i)(?:^|[^A-Za-z])(?:inc|llc|ltd|limited|plc|gmbh|ag|sa|bv|nv|oy|ab|as|pty|co|corp|corporation|company|group|holdings|partners|llp|lp)\.?$"
PLACE_TAIL = r"^[A-Z][A-Za-z.' \-]{1,28}(?:,[ ]*[A-Z][A-Za-z.' \-]{1,28}){0,2}$"
TITLE_WORD = r"(?i)" + word(
    "engineer|developer|analyst|manager|director|architect|scientist|consultant|specialist|administrator|designer|lead|officer"
    "|associate|assistant|coordinator|supervisor|technician|advisor|strategist|researcher|programmer|intern|president|head|chief"
    "|partner|controller|accountant|nurse|teacher|editor|writer|recruiter|planner")
EMPLOYMENT_TYPE = (
    r"(?i)[ ]*\([ ]*(contract|contractor|part[ -]?time|full[ -]?time|freelance|temporary|temp|fixed[ -]?term|interim|internship"
    r"|intern|placement|seasonal|maternity cover|parental cover|secondment|consultant|consultancy|permanent|perm|remote|hybrid|on[ -]?site)[ ]*\)"
)

# Location cleaning.
LOCATION_PREFIX = r"(?i)^(?:locations?|based *in|located *in|office *in|work *location|job *location|position *location|role *location)[ :,]*"
RELOCATION = r"(?i) *\|? *(?:open +to +relocation|willing +to +relocate|relocation +available) *"
WORK_MODE_BRACKET = r"(?i)[(\[] *(?:fully +)?(?:remote|hybrid|on-?site|virtual|in-?office|wfh|flexible)[^)\]]*[)\]]"
WORK_MODE = r"(?i)(^|[^A-Za-z0-9_])(?:fully +)?(?:remote|hybrid|on-?site|wfh|virtual|work *from *home|in-?office|flexible)(?=$|[^A-Za-z0-9_])"
NOT_PLACES = (
    r"(?i)^ *(?:n/?a|tbd|tba|to be (?:determined|confirmed|advised)|unknown|unspecified|not specified|none|null|undefined|nil"
    r"|no location|location|anywhere|flexible|any|confidential|undisclosed|various|multiple|other|remote|hybrid|on-?site|wfh"
    r"|virtual|work from home|full[- ]?time|part[- ]?time|contract|permanent|temporary) *$"
)
REGIONS = [
    "latin america", "south america", "north america", "central america", "americas", "emea", "apac", "apj", "anz", "eu",
    "europe", "western europe", "eastern europe", "middle east", "africa", "asia", "asia pacific", "asia-pacific", "oceania",
    "nordics", "benelux", "dach", "iberia", "global", "worldwide", "international", "multiple locations", "various locations",
    "united states and canada", "us/canada",
]

# States and provinces by code, and the codes that are countries too.
US_STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut",
    "DE": "Delaware", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana",
    "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts",
    "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada",
    "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota",
    "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina",
    "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "DC": "District of Columbia",
}
STATE_ALSO_COUNTRY = [
    "AL", "AR", "AZ", "CA", "CO", "DE", "GA", "ID", "IL", "IN", "KY", "LA", "MA", "MD", "ME", "MN", "MO", "MS", "MT", "NC",
    "NE", "PA", "SC", "SD", "TN", "VA",
]
CA_PROVINCES = {
    "ON": "Ontario", "QC": "Quebec", "BC": "British Columbia", "AB": "Alberta", "MB": "Manitoba", "SK": "Saskatchewan",
    "NS": "Nova Scotia", "NB": "New Brunswick", "NL": "Newfoundland and Labrador", "PE": "Prince Edward Island",
}

# Countries that print on letter paper, and those that write American English.
LETTER_COUNTRIES = ["US", "CA", "MX", "PH", "CL", "CO", "CR", "DO", "EC", "GT", "HN", "NI", "PA", "PE", "PR", "SV", "VE"]
US_ENGLISH_COUNTRIES = [
    "US", "CA", "MX", "PH", "JP", "KR", "CN", "TW", "IL", "AR", "BO", "BR", "CL", "CO", "CR", "CU", "DO", "EC", "GT", "HN", "NI",
    "PA", "PE", "PR", "PY", "SV", "UY", "VE",
]

# Addresses. Sources from most to least deliberate, with their bonus.
ADDRESS = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}"
ADDRESS_SOURCES = [("mailto", 3), ("json-ld", 2), ("meta", 1), ("page-text", 0)]
BLOCKED_LOCAL = (
    r"^(?:noreply|no-reply|donotreply|do-not-reply|postmaster|abuse|privacy|legal|compliance|dpo|gdpr|security|support|help|billing"
    r"|sales|marketing|press|media|info|webmaster|admin|unsubscribe|bounce|mailer-daemon)$"
)
BLOCKED_DOMAIN = (
    r"(?:sentry|datadog|example|test|localhost|resend\.dev|schema\.org|w3\.org|googleapis|gstatic|cloudfront|linkedin\.com|indeed\.com"
    r"|greenhouse\.io|lever\.co|workday|myworkdayjobs|ashbyhq|smartrecruiters)"
)
PURPOSE_LOCAL = r"accommodat|accessib|(?:^|[^a-z0-9_])ada(?:$|[^a-z0-9_])|disabilit|eeo|affirmative|reasonable[-_.]?adjust"
ROLE_LOCAL = r"accommodat|accessib|disabilit|apply|application|support|help|admin|info|contact|enquir|inquir|general|no[-_.]?reply|do[-_.]?not"
RECRUITING_LOCAL = r"^(?:careers?|jobs?|recruit(?:ing|ment)?|talent|talentacquisition|ta|hiring|hr|people|apply|applications?|resumes?|cv)$"
PERSONAL_DOMAIN = r"@(?:gmail|yahoo|hotmail|outlook|icloud|proton|protonmail|aol|live|gmx)\."

# Short and misspelt names of cities, and local names, with the names that gazetteers list.
CITY_SHORT_NAMES = {
    "nyc": "New York", "sf": "San Francisco", "la": "Los Angeles", "dc": "Washington", "philly": "Philadelphia", "chi": "Chicago",
    "atl": "Atlanta", "dtw": "Detroit", "hou": "Houston", "dfw": "Dallas", "msp": "Minneapolis", "pdx": "Portland",
    "slc": "Salt Lake City", "kc": "Kansas City", "nola": "New Orleans", "lv": "Las Vegas", "san fran": "San Francisco",
    "hk": "Hong Kong", "bkk": "Bangkok", "kl": "Kuala Lumpur", "secundrabad": "Secunderabad", "new york city": "New York",
}
CITY_LOCAL_NAMES = {
    "münchen": "Munich", "zürich": "Zurich", "genève": "Geneva", "bruxelles": "Brussels", "köln": "Cologne", "wien": "Vienna",
    "roma": "Rome", "milano": "Milan", "firenze": "Florence", "napoli": "Naples", "torino": "Turin", "genova": "Genoa",
    "venezia": "Venice", "lisboa": "Lisbon", "москва": "Moscow", "praha": "Prague", "warszawa": "Warsaw", "kraków": "Krakow",
    "gdańsk": "Gdansk", "wrocław": "Wroclaw", "łódź": "Lodz", "poznań": "Poznan", "bucureşti": "Bucharest", "athina": "Athens",
    "baile átha cliath": "Dublin", "corcaigh": "Cork",
}

# Disciplines of a title, first match wins.
DISCIPLINES = [
    ("data", r"data scien|machine learning|" + word("ml|ai") + r"|analytics|data engineer|bi(?:$|[^a-z0-9_])|business intelligence"),
    ("engineering", r"engineer|developer|software|devops|platform|sre(?:$|[^a-z0-9_])|backend|frontend|full.?stack|infrastructur|cloud|security|qa(?:$|[^a-z0-9_])|test automation"),
    ("product", r"product manager|product owner|" + word("product")),
    ("delivery", r"project manager|programme|program manager|delivery|scrum|agile|pmo(?:$|[^a-z0-9_])"),
    ("design", r"design|" + word("ux|ui") + r"|creative"),
    ("marketing", r"market|brand|content|seo(?:$|[^a-z0-9_])|communications|" + word("pr")),
    ("sales", r"sales|account exec|business development|partnerships|revenue|customer success"),
    ("finance", r"finance|account(?:ant|ing)|audit|tax(?:$|[^a-z0-9_])|treasury|controller"),
    ("legal", r"legal|counsel|solicitor|paralegal|compliance"),
    ("healthcare", r"nurse|nursing|clinical|physician|doctor|healthcare|medical|pharmac"),
    ("operations", r"operations|logistics|supply chain|warehouse|procurement|facilities"),
    ("support", r"support|service desk|helpdesk|customer service"),
    ("hr", word("hr") + r"|human resources|people ops|people partner|talent|recruit"),
]
# Fields of a title; role shapes come before fields, the first match wins.
ROLE_SHAPES = [
    ("design", word("designer") + r"|product design|user experience design|interaction design"),
    ("product", r"product manager|product owner|head of product|product lead"),
    ("delivery", r"project manager|programme manager|program manager|delivery manager|scrum master|agile coach|" + word("pmo")),
]
FIELDS = [
    ("operations", r"security guard|security officer|door supervisor|concierge"),
    ("ml", r"machine learning|deep learning|computer vision|artificial intelligence|" + word("ml|mlops|nlp|ai")),
    ("data-science", r"data scien|statistic|quantitative|econometric"),
    ("data-eng", r"data engineer|etl(?:$|[^a-z0-9_])|data platform|data warehouse|databricks|" + word("spark")),
    ("analytics", r"analytics|business intelligence|data analyst|business analyst|tableau|power bi|looker|" + word("bi")),
    ("security", r"security|infosec|appsec|cyber|penetration test|pentest|soc analyst|cryptograph"),
    ("devops", r"devops|devsecops|site reliability|platform engineer|infrastructure|kubernetes|terraform|cloud engineer|(?:^|[^ ]|(?:^|[^n]|(?:^|[^g])n|(?:^|[^i])gn|(?:^|[^s])ign|(?:^|[^e])sign|(?:^|[^d])esign) )systems engineer|" + word("sre")),
    ("cloud", r"cloud architect|solutions architect|" + word("aws|azure|gcp")),
    ("qa", r"quality assurance|test engineer|automation test|tester|" + word("qa|sdet")),
    ("mobile", r"android|mobile (?:developer|engineer)|flutter|react native|swift|kotlin|" + word("ios")),
    ("frontend", r"front.?end|(?:^|[^a-z0-9_])ui engineer|react|angular|vue(?:$|[^a-z0-9_])|javascript developer|web developer"),
    ("backend", r"back.?end|(?:^|[^a-z0-9_])api(?:$|[^a-z0-9_]) ?engineer|microservice|(?:^|[^a-z0-9_])(?:go|python) developer|\.net|c#|" + word("java|golang|node|ruby|php|scala|rust")),
    ("embedded", r"embedded|firmware|hardware engineer|electronic engineer|" + word("fpga|rtos")),
    ("games", r"game (?:developer|engineer|programmer)|unreal|unity developer"),
    ("dba", r"database administrator|sql server|postgres|oracle dba|" + word("dba")),
    ("it-support", r"help ?desk|service desk|(?:^|[^a-z0-9_])it support|desktop support|system administrator|sysadmin|network engineer|(?:^|[^a-z0-9_])it technician"),
    ("erp", r"dynamics 365|salesforce (?:developer|consultant|administrator)|servicenow|workday (?:consultant|integration)|netsuite|" + word("sap|erp")),
    ("solutions", r"solutions engineer|sales engineer|presales|pre.?sales|technical account manager|customer engineer"),
    ("tech-writing", r"technical writer|documentation engineer|content engineer"),
    ("product", r"product manager|product owner|" + word("product")),
    ("design", r"product design|user experience|interaction design|" + word("ux|ui|designer")),
    ("delivery", r"project manager|programme manager|program manager|delivery manager|scrum master|agile coach|" + word("pmo")),
    ("engineering", r"software engineer|developer|programmer|engineer|software"),
    ("marketing", r"market|brand|content strategist|communications|" + word("seo")),
    ("sales", r"sales|account exec|business development|partnerships|customer success"),
    ("finance", r"financ(?:e|ial)|account(?:ant|ing)|audit|treasury|controller|" + word("tax")),
    ("legal", r"legal|counsel|solicitor|paralegal|compliance|data protection|" + word("gdpr")),
    ("healthcare", r"nurse|nursing|clinical|physician|doctor|healthcare|medical|pharmac"),
    ("operations", r"operations|logistics|supply chain|warehouse|procurement|facilities"),
    ("hr", r"human resources|people operations|" + word("hr")),
]
RECRUITING = r"talent|recruit|sourc|hiring"
RECRUITING_WORDS = r"talent acquisition|talent|recruit(?:ing|ment|er)?|sourcer|sourcing|hiring|partner|specialist|manager|lead|head of|senior|principal"
TITLE_TIERS = [
    ["technical recruiter", "talent acquisition partner", "talent acquisition specialist", "recruiting manager", "recruiter"],
    ["talent acquisition", "talent partner", "people partner", "head of talent"],
    ["head of people", "hr manager", "people operations", "hr business partner"],
]
FUNCTION_TITLES = {
    "data": ["Head of Data", "Data Science Manager", "Analytics Manager"],
    "engineering": ["Engineering Manager", "Head of Engineering", "VP Engineering"],
    "product": ["Head of Product", "Product Director"],
    "delivery": ["Head of Delivery", "Programme Director", "PMO Manager"],
    "design": ["Head of Design", "Design Director"],
    "marketing": ["Head of Marketing", "Marketing Director"],
    "sales": ["Sales Director", "Head of Sales"],
    "finance": ["Finance Director", "Head of Finance"],
    "legal": ["Head of Legal", "General Counsel"],
    "healthcare": ["Clinical Manager", "Head of Nursing", "Medical Director"],
    "operations": ["Head of Operations", "Operations Manager"],
    "support": ["Head of Customer Support", "Support Manager"],
}
COMPANY_WORDS = (
    "ltd limited llc inc incorporated plc gmbh bv nv ab oy as sa srl spa pty corp corporation co company group holdings "
    "international global technologies technology solutions services consulting"
).split()

# Send policy.
SEND_BURST, SEND_GAP_DAYS, SEND_WINDOW_MAX, SEND_WINDOW_DAYS = 3, 5, 6, 30

# Reference fields of a posting.
CONTACT_NAMES = [
    r"(?:^|[^A-Za-z0-9_])(?:[Cc]ontact|[Rr]each out to|[Ee]mail|[Ss]end (?:your )?(?:cv|CV|resume|application) to|[Qq]uestions to)[ \t\n]+([A-Z][a-z]+(?:[ ]+[A-Z][a-z]+){0,2})(?:$|[^A-Za-z0-9_])",
    r"(?:^|[^A-Za-z0-9_])([A-Z][a-z]+(?:[ ]+[A-Z][a-z]+){0,2}),?[ ]+(?:Talent Acquisition|Technical Recruiter|Recruiter|Hiring Manager|People Partner)(?:$|[^A-Za-z0-9_])",
    r"(?:^|[^A-Za-z0-9_])(?:Recruiter|Hiring Manager|Talent Acquisition(?: Partner| Specialist)?)[ ]*[:\-][ ]*([A-Z][a-z]+(?:[ ]+[A-Z][a-z]+){0,2})(?:$|[^A-Za-z0-9_])",
]
DEPARTMENTS = [
    r"(?:^|[^A-Za-z0-9_])(?:department|team|function|business unit|org)[ ]*[:\-][ ]*([A-Z][A-Za-z &/'\-]{2,40})",
    r"(?:^|[^A-Za-z0-9_])part of (?:the|our)[ ]+([A-Z][A-Za-z &/'\-]{2,40})[ ]+(?:team|department|organisation|organization)",
    r"(?:^|[^A-Za-z0-9_])join (?:the|our)[ ]+([A-Z][A-Za-z &/'\-]{2,40})[ ]+team(?:$|[^A-Za-z0-9_])",
]
OFFICES = [
    r"(?:^|[^A-Za-z0-9_])(?:[Ll]ocation|[Oo]ffice|[Ww]ork location|[Bb]ased in|[Cc]ity)[ ]*[:\-][ ]*([A-Z][A-Za-z .'\-]{2,40}(?:,[ ]*[A-Z][A-Za-z .'\-]{2,40}){0,2})",
    r"(?:^|[^A-Za-z0-9_])(?:based in|located in|role is based in)[ ]+([A-Z][A-Za-z .'\-]{2,40}(?:,[ ]*[A-Z][A-Za-z .'\-]{2,40}){0,1})",
]
