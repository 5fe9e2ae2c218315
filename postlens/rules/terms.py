"""Fixed values for term extraction. Word lists are plain text in their natural order."""

# Words never counted as terms.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will "
    "would could should may might must can this that these those it its you your we our they their who what which "
    "when where why how all each every both few more most other some such no not only own same so than too very "
    "just also now here there then if about into through during before after above below between under again "
    "further once any"
).split()

# Posting words that are not skills.
NOISE_WORDS = (
    "remote hybrid office work team culture apply application bonus salary benefits perks hiring career job position "
    "role opportunity company organization employer employee candidate reimbursement accommodations accommodation "
    "discriminate privacy visa sponsorship relocation looking seeking required requirements preferred ability able "
    "etc including include includes new well based using within across strong excellent good ensure ensuring provide "
    "providing support help helping develop developing build building create understand understanding knowledge "
    "skills skill must shall ideally highly plus nice have having get getting make making take taking use used uses "
    "per via like want wants wanted join joining joined lead leading leverage please review name status process "
    "personal fully human go match tools businesses hackers profile keywords operations the and for with our you your "
    "this that these those are was were been being has had does did doing would should could may might can will need "
    "needs from into over under about after before between through during above below such each every both few more "
    "most other some any all only own same than too very just also now here there then when where why how what which "
    "who whom passionate dynamic innovative fast-paced collaborative driven motivated team-player hands-on scale grow "
    "growth impact mission vision values diverse inclusive equal"
).split()

# Weight of a document that names a section, first match in this order.
SECTION_WEIGHTS = [
    ("responsibilities", 1.2), ("what you'll do", 1.2), ("your role", 1.2), ("requirements", 1.4),
    ("qualifications", 1.4), ("what you bring", 1.4), ("must have", 1.4), ("required", 1.3), ("preferred", 1.0),
    ("nice to have", 0.9), ("bonus", 0.8), ("benefits", 0.3), ("about us", 0.4), ("about the company", 0.4),
    ("who we are", 0.4), ("perks", 0.3), ("legal", 0.2), ("equal opportunity", 0.1),
]

# Score factor of each category a term belongs to.
CATEGORY_BOOST = {
    "programming_language": 1.4, "cloud_devops": 1.3, "security_tool": 1.3, "data_tool": 1.2, "crm_tool": 1.2,
    "hard_skill": 1.1, "soft_skill": 1.0,
}

# Return-on-effort tiers.
ROI_HIGH = [
    "python", "java", "javascript", "typescript", "c++", "c#", "go", "rust", "kotlin", "swift", "scala", "ruby", "php",
    "r", "matlab", "sql", "nosql", "tensorflow", "pytorch", "keras", "pandas", "numpy", "scikit-learn", "spark",
    "hadoop", "kafka", "airflow", "aws", "azure", "gcp", "kubernetes", "docker", "terraform", "jenkins", "ci/cd",
    "circleci", "github actions", "ansible", "devops", "cloud security", "cloud architecture", "aws cloudwatch",
    "aws cloudtrail", "aws security hub", "aws codepipeline", "aws codedeploy", "serverless",
    "container orchestration", "disaster recovery", "hybrid cloud", "automation", "compliance", "yaml", "json",
    "bash", "powershell", "postgresql", "mysql", "mongodb", "redis", "elasticsearch", "cassandra", "dynamodb",
    "snowflake", "redshift", "bigquery", "react", "angular", "vue", "node.js", "django", "flask", "spring", "express",
    "fastapi", "graphql", "rest api", "machine learning", "deep learning", "nlp", "computer vision", "etl",
    "data pipeline", "data warehouse",
]
ROI_MEDIUM = [
    "agile", "scrum", "kanban", "stakeholder management", "project management", "product management",
    "cross-functional", "strategic planning", "roadmap", "sprint planning", "backlog", "jira", "confluence",
    "a/b testing", "user research", "analytics", "kpi", "metrics", "optimization", "scalability",
]
ROI_LOW = [
    "communication", "collaboration", "teamwork", "leadership", "mentoring", "mentorship", "problem-solving",
    "critical thinking", "attention to detail", "time management", "adaptability", "flexibility", "innovative",
    "empathy", "prioritisation", "conflict resolution", "creative thinking", "decision-making", "initiative",
    "roadmap planning", "negotiation", "coaching", "facilitation", "delegation", "accountability",
    "strategic thinking", "relationship building", "influence", "change management", "risk management",
    "process improvement", "analytical thinking", "organisational skills", "customer focus", "client management",
    "vendor management", "resource management", "budget management", "capacity planning", "incident management",
    "crisis management", "quality assurance", "continuous improvement", "knowledge sharing", "pair programming",
    "code review", "technical writing", "documentation", "cross-team collaboration", "stakeholder engagement",
    "requirements gathering", "user research", "design thinking", "data-driven decision making", "presentation",
    "active listening", "emotional intelligence", "cross-functional", "stakeholder management",
]
ROI_TIERS = [("high", ROI_HIGH), ("medium", ROI_MEDIUM), ("low", ROI_LOW)]
ROI_STOP_WORDS = (
    "a an the and or but in on at to for of with by from as is was are were been be have has had this that it you "
    "your we our they their will would work working job position role team company required requirements experience "
    "years ability able looking seeking candidate must"
).split()

# The bounded soft-skill vocabulary.
SOFT_SKILLS = [
    "communication", "written communication", "verbal communication", "interpersonal", "presentation",
    "public speaking", "active listening", "negotiation", "influencing", "storytelling", "leadership", "mentoring",
    "coaching", "team management", "people management", "delegation", "stakeholder management", "collaboration",
    "teamwork", "cross-functional", "relationship building", "analytical", "critical thinking", "problem solving",
    "troubleshooting", "decision making", "judgement", "attention to detail", "detail-oriented", "accuracy",
    "consistent", "consistency", "thorough", "methodical", "organisation", "organisational", "time management",
    "prioritisation", "multitasking", "planning", "self-motivated", "proactive", "initiative", "independent",
    "autonomous", "reliable", "dependable", "accountable", "adaptable", "flexible", "resilient",
    "work under pressure", "fast-paced", "continuous improvement mindset", "willingness to learn",
    "follow instructions", "following procedures", "process changes", "customer service", "customer focus", "empathy",
    "patience", "conflict resolution", "creativity", "innovation", "curiosity", "work ethic", "integrity",
    "professionalism", "punctual", "punctuality", "written", "verbal", "documentation skills", "reporting skills",
]

# Nouns that end a skill phrase.
SKILL_HEADS = (
    "analysis analyses analytics assessment assessments assurance audit audits auditing automation accounting "
    "administration architecture assembly benchmarking bookkeeping budgeting calibration care coding compliance "
    "configuration construction control controls costing counselling databases design development diagnostics "
    "dispensing documentation drafting drawings engineering estimating evaluation fabrication finishing flow "
    "forecasting governance grinding handling imaging implementation improvement inspection installation "
    "instrumentation integration inventory layout licensing logistics machining maintenance management manufacturing "
    "mapping marketing measurement methodologies methods metrology migration modelling modeling monitoring "
    "negotiation onboarding operations optimisation optimization packaging payroll planning practices preparation "
    "prevention pricing procedures processing procurement programming protocols prototyping provisioning purchasing "
    "qualification reconciliation recruitment reporting reports research resolution review reviews safety sampling "
    "scheduling sourcing specifications standards sterilisation strategy studies study support surveying systems "
    "techniques testing tooling training troubleshooting underwriting validation verification welding workflow "
    "writing software hardware tools equipment machinery instruments"
).split()

# Words that cannot open or close a skill phrase.
EDGE_WORDS = (
    "a an the and or but of in on at to for with by from as is are was were be been have has had this that these those "
    "it you your we our they their will would can could should may might must all any both each other such own same "
    "than then more most some very across through including include includes using use strong excellent good great "
    "proven demonstrated solid relevant related similar comparable ability able experience years year knowledge "
    "understanding familiar familiarity proficiency proficient expertise skills skill work working role position job "
    "team company business new existing multiple various well high highly plus essential desirable preferred required "
    "requirements e g i etc via per ideally preferably complete accurate accurately safely ensuring administer "
    "escalate liaise one two three four five six seven eight nine ten several many few numerous"
).split()

# Words that end the walk to the left of a head noun.
BOUNDARY_WORDS = (
    "lead leads leading carry carries carrying out support supports supporting ensure ensures ensuring produce "
    "produces producing revise revises revising drive drives driving own owns owning contribute contributes "
    "contributing maintain maintains maintaining develop develops developing create creates creating build builds "
    "building manage manages managing perform performs performing conduct conducts conducting execute executes "
    "executing deliver delivers delivering provide provides providing present presents presenting prepare prepares "
    "preparing establish establishes identify identifies identifying implement implements implementing join joins "
    "joining apply applies assist assists assisting help helps helping oversee oversees overseeing coordinate "
    "coordinates monitor monitors track tracks handle handles run runs running operate operates operating adherence "
    "compliance approach degree discipline defined given applicable appropriate suitable key core critical daily "
    "overall general ideally preferably complete completes completing accurate accurately administer administers "
    "escalate liaise local direct safely"
).split()

# Heads that are a skill by themselves.
STANDALONE_HEADS = (
    "documentation machining welding drafting prototyping troubleshooting forecasting budgeting purchasing procurement "
    "scheduling bookkeeping payroll metrology surveying automation calibration fabrication underwriting recruitment "
    "analytics logistics sourcing programming estimating"
).split()

# Skill-shaped phrases that name the workplace.
NOT_A_SKILL = [
    "production environment", "work environment", "fast paced environment", "team environment", "our team", "the team",
    "the role", "the business", "the company", "our company", "related discipline", "related field", "degree",
    "bachelors degree", "masters degree",
]

# Cues that name a skill outright, and shapes that need no list.
SKILL_CUE = (
    r"(?i)(?:experience (?:with|in|using|of)|proficien(?:cy|t) (?:with|in)|knowledge of|familiar(?:ity)? with|skilled in"
    r"|expertise (?:with|in)|competen(?:t|cy) (?:with|in)|background in|trained in|certified in|working knowledge of"
    r"|hands[- ]on (?:experience )?(?:with|in)?|ability to (?:use|operate|run)|use of|using)[ \t]+([^.;:\n]{2,120})"
)
SKILL_SHAPES = [
    r"(?:^|[^A-Za-z0-9_])([A-Z][a-z]+[A-Z][A-Za-z]*)(?![A-Za-z0-9_])",
    r"(?:^|[^A-Za-z0-9_])([A-Z]{2,}(?:-[A-Z0-9]+)*[ -]?[0-9]{3,}(?:[:-][0-9]+)?)(?![A-Za-z0-9_])",
    r"(?:^|[^A-Za-z0-9_])([A-Z]{2,}(?:/[A-Z]{2,})+|[A-Z]{3,})(?![A-Za-z0-9_])",
]

# Grammar words that slip into keyword lists, and short terms that are skills.
JUNK_WORDS = (
    "est based strong ability able working work related relevant experience experienced skills skill opportunity role "
    "position job candidate candidates team teams company business good great excellent strongly preferred required "
    "requirements responsibilities plus etc years year new well high must ideal ideally you your our we they this that "
    "with and for the"
).split()
SHORT_SKILLS = ["ai", "ml", "bi", "qa", "ux", "ui", "go", "r", "c"]

# Phrases that are requirements, not skills.
JUNK_PATTERNS = [
    r"(?:^|[^a-z0-9_])[0-9]+[ ]*\+?[ ]*(?:years?|yrs?)(?:$|[^a-z0-9_])",
    r"(?:^|[^a-z0-9_])years?[ ]+(?:of[ ]+)?experience(?:$|[^a-z0-9_])",
    r"^(?:oracle +|aws +|azure +|google +)?certifications?$",
    r"^my[a-z]+support$",
    r"(?:^|[^a-z0-9_])(?:must[- ]have|nice[- ]to[- ]have|preferred|required|desirable|a plus|bonus)(?:$|[^a-z0-9_])",
    r"(?:^|[^a-z0-9_])(?:degree|bachelor|master|bsc|msc|phd)(?:$|[^a-z0-9_])",
    r"(?:^|[^a-z0-9_])(?:full[- ]?time|part[- ]?time|permanent|contract|hybrid|remote|on[- ]?site)(?:$|[^a-z0-9_])",
    r"(?:^|[^a-z0-9_])(?:salary|benefits|equal opportunity|visa|sponsorship)(?:$|[^a-z0-9_])",
    r"^(?:strong|excellent|good|proven|demonstrated|solid|deep)(?:$|[^a-z0-9_])",
    r"^(?:ability|experience|knowledge|understanding|familiarity)(?:$|[^a-z0-9_])",
    r"^[^a-z0-9_]*$",
]
