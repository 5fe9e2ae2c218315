"""Fixed values for pages and postings: platform hosts, id shapes, page cues."""

# Platform and the host fragments that identify it, first match wins.
PLATFORM_HOSTS = [
    ("greenhouse", ["greenhouse.io"]),
    ("workday", ["workday.com", "myworkdayjobs.com", "myworkdaysite.com"]),
    ("smartrecruiters", ["smartrecruiters.com"]),
    ("workable", ["workable.com"]),
    ("icims", ["icims.com", "icims.eu"]),
    ("taleo", ["taleo.net"]),
    ("teamtailor", ["teamtailor.com"]),
    ("bamboohr", ["bamboohr.com"]),
    ("recruitee", ["recruitee.com"]),
    ("jazzhr", ["jazzhr.com", "applytojob.com", "theresumator.com"]),
    ("jobvite", ["jobvite.com"]),
    ("successfactors", ["successfactors.com", "successfactors.eu", "sapsf.com", "sapsf.eu"]),
    ("personio", ["personio.com", "personio.de"]),
    ("eightfold", ["eightfold.ai"]),
    ("avature", ["avature.net"]),
    ("cornerstone", ["csod.com", "cornerstoneondemand.com"]),
    ("brassring", ["brassring.com", "kenexa.com"]),
    ("ultipro", ["ultipro.com", "ukg.com"]),
    ("adp", ["adp.com", "myadp.com"]),
    ("breezy", ["breezy.hr"]),
    ("dover", ["dover.com", "dover.io", "app.dover.io"]),
    ("pinpoint", ["pinpointhq.com"]),
    ("zohorecruit", ["zohorecruit.com"]),
    ("occupop", ["occupop.com"]),
    ("bullhorn", ["bullhorn.com", "bullhornstaffing.com", "bullhorncdn.com"]),
    ("oracle", ["oraclecloud.com", "oracle.com"]),
    ("dayforce", ["dayforcehcm.com"]),
    ("freshteam", ["freshteam.com"]),
    ("gusto", ["jobs.gusto.com"]),
    ("paylocity", ["recruiting.paylocity.com", "paylocity.com"]),
    ("comeet", ["comeet.co", "comeet.com"]),
    ("polymer", ["jobs.polymer.co", "polymer.co"]),
    ("linkedin", ["linkedin.com"]),
]

# Where each platform's url carries the requisition id.
PLATFORM_JOB_IDS = [
    r"(?i)greenhouse\.io/[^/]+/jobs/(\d{5,})",
    r"(?i)myworkdayjobs?\.com/.*?[_-](R-?\d{4,})",
    r"(?i)smartrecruiters\.com/[^/]+/(\d{6,})",
    r"(?i)workable\.com/[^/]+/j/([A-Z0-9]{6,})",
    r"(?i)icims\.com/jobs/(\d{4,})",
    r"(?i)taleo\.net/.*?[?&]job=(\d+)",
    r"(?i)teamtailor\.com/jobs/(\d{4,})",
    r"(?i)bamboohr\.com/(?:careers|jobs)/(\d+)",
    r"(?i)recruitee\.com/o/([a-z0-9-]+)",
    r"(?i)applytojob\.com/apply/([A-Za-z0-9]+)",
    r"(?i)jobvite\.com/.*?/job/([A-Za-z0-9]{6,})",
    r"(?i)(?:successfactors|sapsf)\.[a-z]+/.*?[?&]jobId=(\d+)",
    r"(?i)personio\.[a-z]+/job/(\d+)",
    r"(?i)eightfold\.ai/careers\?.*?[?&]pid=(\d+)",
    r"(?i)avature\.net/.*?/(?:job|careers)/(\d+)",
    r"(?i)csod\.com/.*?/requisition/(\d+)",
    r"(?i)brassring\.com/.*?[?&]jobId=(\d+)",
    r"(?i)ultipro\.com/.*?/JobBoard/.*?/OpportunityDetail\?opportunityId=([0-9a-f-]+)",
    r"(?i)adp\.com/.*?/job/([A-Za-z0-9_-]+)",
    r"(?i)breezy\.hr/p/([0-9a-f]+)",
    r"(?i)dover\.(?:com|io)/.*?/([0-9a-f-]{8,})",
    r"(?i)pinpointhq\.com/(?:jobs|postings)/(\d+)",
    r"(?i)zohorecruit\.com/.*?/([A-Za-z0-9_]+)$",
    r"(?i)occupop\.com/.*?/(\d{4,})",
    r"(?i)bullhorn[a-z]*\.com/.*?/(\d{5,})",
    r"(?i)oraclecloud\.com/.*?/job/(\d+)",
    r"(?i)dayforcehcm\.com/.*?/Posting/(?:View|Apply|Detail)/(\d+)",
    r"(?i)freshteam\.com/jobs/([A-Za-z0-9_-]+)",
    r"(?i)jobs\.gusto\.com/postings/([^/]+)",
    r"(?i)paylocity\.com/Recruiting/Jobs/[^/]+/(\d+)",
    r"(?i)comeet\.co/jobs/[^/]+/([A-Za-z0-9._-]+)",
    r"(?i)jobs\.polymer\.co/[^/]+/(\d+)",
    r"(?i)linkedin\.com/jobs/view/(\d{6,})",
]

# Id shapes shared by many sites, tried after the platform's own.
GENERIC_JOB_IDS = [
    r"(?i)/jobs?/(\d{5,})",
    r"(?i)[?&](?:jobId|job_id|requisitionId|gh_jid|pid)=([A-Za-z0-9_-]{3,})",
]

# Ids labelled in the posting's text.
TEXT_JOB_IDS = [
    r"(?i)(?:^|[^A-Za-z0-9_])(?:job|requisition|req|posting|vacancy|reference|ref)[ \t\n]*(?:id|number|no\.?|#)?[ \t\n]*[:#][ \t\n]*([A-Za-z0-9][A-Za-z0-9_\-]{2,24})(?:$|[^A-Za-z0-9_])",
    r"(?i)(?:^|[^A-Za-z0-9_])(?:job|req)[ \t\n]*(?:id|code)[ \t\n]*([A-Za-z0-9][A-Za-z0-9_\-]{2,24})(?:$|[^A-Za-z0-9_])",
    r"(?:^|[^A-Za-z0-9_])(R-?\d{4,10})(?:$|[^A-Za-z0-9_])",
    r"(?:^|[^A-Za-z0-9_])(JR-?\d{4,10})(?:$|[^A-Za-z0-9_])",
]

# Path tails that belong to the application flow, not to the posting.
APPLY_TAILS = [
    "apply", "apply-now", "applynow", "application", "applications",
    "submit", "submission", "candidate", "candidates", "register",
    "registration", "login", "signin", "sign-in", "signup", "sign-up",
    "create-account", "createaccount", "new", "start", "form",
]

# Page-class cues.
APPLY_URL_WORDS = [
    "apply", "application", "applications", "candidate", "submit", "register",
    "signup", "sign-up", "createaccount", "create-account",
]
THANK_YOU_URLS = [
    "/thank-you", "/thankyou", "/thanks", "/application-submitted",
    "/application-complete", "/application-success", "/submitted", "/success",
    "/confirmation", "/confirmed", "/complete", "/applied", "/finished",
]
THANK_YOU_TEXTS = [
    "thank you for applying", "thanks for applying", "application submitted",
    "application received", "successfully submitted", "application complete",
    "we have received your application", "your application has been submitted",
    "you have successfully applied", "thank you for your interest",
    "thanks for your interest", "we will review your application",
    "our team will review", "we appreciate your interest",
]
LISTING_URLS = ["/job/", "/jobs/", "/position/", "/apply", "/careers/"]
LISTING_WORDS = ["responsibilities", "requirements", "qualifications"]

# What application pages call themselves; never a job title.
PAGE_LABELS = [
    "apply", "apply now", "application", "application form", "apply for this job",
    "submit", "submit application", "career", "careers", "job", "jobs",
    "login", "log in", "sign in", "signin", "sign up", "signup", "register",
    "create account", "candidate portal", "thank you", "home", "untitled",
]

# Page furniture at the start of a title.
TITLE_FURNITURE = (
    "careers?|jobs?|job|vacanc(?:y|ies)|openings?|apply|application|hiring|we are hiring|join us|home"
    "|current openings|job details?|job description|job posting|greenhouse|workday|lever"
    "|smartrecruiters|linkedin|indeed|glassdoor"
)

# Boilerplate sections, each ending where its last group begins.
BOILERPLATE = [
    r"(?is)equal\s+opportunity\s+employer.*?(\n\n|\n[a-z]|\z)",
    r"(?is)we\s+are\s+an?\s+(?:equal|inclusive).*?(\n\n|\n[a-z]|\z)",
    r"(?is)benefits\s*(?:include)?[:\s].*?(\n\n(?:requirements|qualifications|about|\z))",
    r"(?is)salary\s*(?:range)?[:\s].*?(\n\n|\z)",
    r"(?is)how\s+to\s+apply.*(\z)",
    r"(?is)apply\s+now.*(\z)",
    r"(?is)about\s+(?:us|our\s+company|the\s+company).*?(\n\n(?:requirements|role|position|responsibilities)|\z)",
]

# Structure cues.
BULLET_MARK = r"(?:^|\n)[ \t\r\n]*[-•●○◦▪▸►][ \t\r\n]*[^ \t\r\n]|(?:^|\n)[ \t\r\n]*[0-9]+[.)][ \t\r\n]*[^ \t\r\n]"
SECTION_CUES = (
    "requirements|qualifications|skills|responsibilities|experience|about|what we|you will"
    "|your role|key|must have|nice to have"
)
NARRATIVE_CUES = "you['’]?ll|you will|we['’]?re looking|we are seeking|your role|join our|be responsible"

# Posting section headings.
POSTING_HEADINGS = [
    ("requirements", "requirements|what we need|what you need|must have"),
    ("responsibilities", "responsibilities|duties|what you['’]?ll do|your role|job duties"),
    ("qualifications", "qualifications|who you are|ideal candidate|about you"),
    ("skills", "skills|technical skills|required skills|key skills|core competencies"),
    ("about", "about (?:the role|this role|the position)|overview|summary"),
]

# Elements dropped before text is read.
DROPPED_TAGS = ["nav", "header", "footer", "script", "style", "noscript"]
DROPPED_CLASSES = ["nav", "header", "footer", "menu", "sidebar", "advertisement"]
DROPPED_ROLES = ["navigation", "banner", "contentinfo"]

# JSON paths of a posting in each platform's API response.
API_PATHS = {
    "greenhouse": {
        "title": "$.title", "description": "$.content", "location": "$.location.name",
        "company": "$.company_name", "job_id": "$.requisition_id",
    },
    "workday": {
        "title": "$.jobPostingInfo.title", "description": "$.jobPostingInfo.jobDescription",
        "location": "$.jobPostingInfo.location", "company": "$.hiringOrganization.name",
        "job_id": "$.jobPostingInfo.jobReqId",
    },
}

# Places in page text, tried in this order.
LOCATION_PATTERNS = [
    ("label", r"(?i)(?:Location|Office|Based in|Work from|Headquarters)[: \t\n]+([A-Za-z \t\n,]+?)(?:\n|\.|\||\z)"),
    ("remote", r"(?i)(?:^|[^A-Za-z0-9_])(Remote(?:[ \t\n]*(?:[-–|,][ \t\n]*)?[A-Za-z \t\n,]+)?)"),
    ("city_state_us", r"(?:^|[^A-Za-z0-9_])([A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+)*,[ \t]*[A-Z]{2},[ \t]*(?:USA|US|United States))(?:$|[^A-Za-z0-9_])"),
    ("city_code", r"(?:^|[^A-Za-z0-9_])([A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+)*,[ \t]*[A-Z]{2})(?:$|[^A-Za-z0-9_])"),
    ("city_country", r"(?i)(?:^|[^A-Za-z0-9_])([A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+)*,[ \t]*(?:United States|USA|UK|United Kingdom|Canada|Australia|Germany|France|Ireland|Netherlands|Singapore|India))(?:$|[^A-Za-z0-9_])"),
]

# Country rank when one city name exists in several countries.
COUNTRY_PRIORITY = [
    "US", "GB", "IE", "CA", "AU", "NZ", "DE", "FR", "NL", "ES", "IT", "PT",
    "CH", "SE", "NO", "DK", "FI", "BE", "AT", "PL", "CZ", "IN", "SG", "AE",
    "IL", "JP", "KR", "TW", "PH", "MY", "ID", "TH", "CN", "MX", "BR", "AR",
    "CL", "CO", "PE", "ZA", "EG", "KE", "NG", "TZ", "TR", "RU", "UA", "HK",
]

# Queue columns and the header fragments that name them, in test order.
QUEUE_HEADERS = [
    ("job_url", ["url"]),
    ("candidate_name", ["name", "candidate"]),
    ("email", ["email"]),
    ("phone", ["phone"]),
    ("priority", ["priority"]),
    ("notes", ["notes"]),
]
