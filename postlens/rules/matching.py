"""Fixed values for matching postings and CVs."""

# Score bands and confidence floors (score, keywords, density).
COVERAGE_BANDS = [(85, "strong"), (70, "good"), (50, "moderate")]
THRESHOLD_STATUS = [(85, "excellent"), (75, "good"), (60, "close")]
CONFIDENCE_FLOORS = [("HIGH", 90, 15, 2.0), ("MEDIUM", 80, 10, 1.5), ("LOW", 70, 5, 1.0)]
PRIORITY_WEIGHTS = {"high": 3, "medium": 2, "low": 1}

# Title words that carry no signal.
TITLE_STOP_WORDS = (
    "and or the a an of for to in at with & - / senior junior staff lead principal head i ii iii iv"
).split()

# Qualification sections, types and weights.
REQUIRED_HEADINGS = (
    r"required[ \t\n]*qualifications?|minimum[ \t\n]*qualifications?|must[ \t\n]*have|requirements?|required[ \t\n]*skills?"
    r"|what[ \t\n]*you['’]?ll?[ \t\n]*need|essential[ \t\n]*criteria"
)
PREFERRED_HEADINGS = (
    r"preferred[ \t\n]*qualifications?|nice[ \t\n]*to[ \t\n]*have|bonus|preferred[ \t\n]*skills?|plus|desirable|advantageous"
)
QUALIFICATION_TYPES = [  # later ones win
    ("experience_years", r"[0-9]+\+?[ \t]*(?:years?|yrs?)"),
    ("education", r"bachelor|master|phd|degree|diploma"),
    ("certification", r"certif|certified|cpa|pmp|cissp"),
    ("soft_skill", r"communication|teamwork|leadership|collaborate|mentor|interpersonal|stakeholder|problem.?solving"
                   r"|critical.?thinking|adaptability|flexibility|empathy|prioriti[sz]ation|time.?management"
                   r"|conflict.?resolution|creative.?thinking|decision.?making|initiative|roadmap|negotiation|coaching"
                   r"|facilitation|delegation|accountability|strategic.?thinking|relationship.?building"
                   r"|change.?management|continuous.?improvement|analytical|attention.?to.?detail|cross.?functional"
                   r"|presentation|active.?listening|emotional.?intelligence|risk.?management|process.?improvement"
                   r"|customer.?focus|client.?management|vendor.?management|resource.?management|budget.?management"
                   r"|incident.?management|quality.?assurance|requirements.?gathering|user.?research|design.?thinking"
                   r"|data.?driven"),
]
QUALIFICATION_WEIGHTS = {
    "education": 1.2, "experience_years": 1.5, "technical_skill": 1.3, "certification": 1.1, "soft_skill": 0.8,
    "domain_knowledge": 1.2, "tool_proficiency": 1.0,
}
KNOWN_SKILLS = [
    "python", "java", "javascript", "typescript", "c++", "c#", "go", "rust", "kotlin", "swift", "scala", "ruby", "php", "r",
    "react", "angular", "vue", "node.js", "django", "flask", "spring", "express", "fastapi", ".net",
    "aws", "azure", "gcp", "kubernetes", "docker", "terraform", "jenkins", "ci/cd",
    "sql", "postgresql", "mysql", "mongodb", "redis", "elasticsearch", "dynamodb", "snowflake",
    "machine learning", "deep learning", "tensorflow", "pytorch", "pandas", "spark", "hadoop", "kafka",
    "agile", "scrum", "jira", "git", "graphql", "rest api", "microservices",
]
QUALIFICATION_CUES = [
    r"(?:experience[ \t]*(?:with|in)|proficiency[ \t]*in|knowledge[ \t]*of)[ \t]*([^,.;]+)",
    r"(?:strong|solid|proven)[ \t]*([^,.;]+)",
]
LONG_WORD_EXCLUDED = ["with", "have", "and", "the", "for", "from", "that", "this", "will", "your", "must", "should"]
HIGH_LEVERAGE_TYPES = ["experience_years", "education", "certification", "technical_skill"]

# Stated years of experience.
YEARS_STATED = (
    r"(?i)([0-9]{1,2})[ \t\n]*\+?[ \t\n]*(?:-[ \t\n]*[0-9]{1,2}[ \t\n]*)?years?[ \t\n]*(?:of[ \t\n]+)?"
    r"(?:relevant[ \t\n]+|professional[ \t\n]+|industry[ \t\n]+|hands[- ]on[ \t\n]+)?(?:experience|background)"
)
CALENDAR_YEARS = r"(19[89][0-9]|20[0-4][0-9])"

# Requirement shapes and terms close to each other.
REQUIREMENT_PATTERNS = [
    r"(?:^|\n)[ \t]*[•\-*][ \t]*([^\n]{8,160})",
    r"(?i)(?:^|[^A-Za-z0-9_])([0-9]+\+?[ \t]*years?[^.\n]{2,120})",
    r"(?i)(?:must have|required|requirements?|you have|you bring)[ \t]*[:\-][ \t]*([^\n]{10,200})",
    r"(?i)(?:experience (?:with|in|of|using))[ \t]+([^\n.,;]{4,80})",
    r"(?i)(?:strong|deep|proven|hands-on)[ \t]+(?:knowledge|experience|background)[ \t]+(?:of|in|with)[ \t]+([^\n.,;]{4,80})",
]
ADJACENT_TERMS = {
    "kubernetes": ["docker", "containers", "ecs", "fargate", "helm"],
    "aws": ["gcp", "azure", "cloud", "ec2", "lambda", "s3"],
    "gcp": ["aws", "azure", "cloud", "gke", "bigquery"],
    "azure": ["aws", "gcp", "cloud"],
    "react": ["vue", "svelte", "angular", "next.js", "remix", "frontend"],
    "vue": ["react", "svelte", "angular", "frontend"],
    "typescript": ["javascript", "flow", "node"],
    "python": ["ruby", "go", "java", "scripting"],
    "go": ["rust", "c++", "java"],
    "rust": ["go", "c++"],
    "rag": ["llm", "embeddings", "vector", "semantic search", "retrieval"],
    "llm": ["gpt", "claude", "transformers", "fine-tuning", "prompt engineering"],
    "pytorch": ["tensorflow", "jax", "numpy"],
    "tensorflow": ["pytorch", "jax", "keras"],
    "sql": ["postgres", "mysql", "snowflake", "bigquery", "queries"],
    "spark": ["hadoop", "flink", "beam", "data pipelines"],
    "kafka": ["rabbitmq", "pubsub", "sqs", "event streaming"],
    "graphql": ["rest", "grpc", "apis"],
    "terraform": ["cloudformation", "pulumi", "ansible", "iac"],
    "ci/cd": ["github actions", "jenkins", "circleci", "gitlab ci", "pipelines"],
    "agile": ["scrum", "kanban", "sprints"],
    "scrum": ["agile", "kanban", "sprints"],
}

# Opening hooks in a posting, first match wins; group 1 is the capture.
HOOK_PATTERNS = [
    ("team", r"(?:^|[^A-Za-z0-9_])join(?:ing)?[ \t\n]+(?:our|the)[ \t\n]+([A-Z][A-Za-z0-9_\- ]{3,60}?)[ \t\n]+(?:team|squad|pod|guild)(?:$|[^A-Za-z0-9_])"),
    ("team-prefix", r"(?:^|[^A-Za-z0-9_])(?:our|the)[ \t\n]+([A-Z][A-Za-z0-9_\- ]{3,60}?)[ \t\n]+(?:team|squad|pod|guild)[ \t\n]+is(?:$|[^A-Za-z0-9_])"),
    ("product", r"(?:^|[^A-Za-z0-9_])(?:building|launching|scaling|growing)[ \t\n]+([A-Z][A-Za-z0-9_\- ]{3,60})"),
    ("mission", r"(?i)(?:^|[^A-Za-z0-9_])(?:our mission|we are on a mission)[ \t\n]+(?:is[ \t\n]+)?to[ \t\n]+([^.\n]{15,140})"),
    ("challenge", r"(?i)(?:^|[^A-Za-z0-9_])(?:you ?will|you'?ll|the role will)[ \t\n]+([^.\n]{20,160})"),
    ("milestone", r"(?i)(?:^|[^A-Za-z0-9_])(?:recently|just)[ \t\n]+((?:raised|launched|shipped|acquired|hired|opened)[ \t\n]+[^.\n]{6,120})"),
]
#: Lower-case strings of which every match of a hook pattern, in the order above, holds one.
HOOK_NEEDLES = dict(zip([p for _, p in HOOK_PATTERNS], [["join"], ["team", "squad", "pod", "guild"], ["building", "launching", "scaling", "growing"], ["mission"],
                                                        ["will", "'ll", "youll"], ["recently", "just"]]))
STACK_PATTERN = r"(?:^|[^A-Za-z0-9_])((?:[A-Z][a-zA-Z0-9.+#]{1,18}|[a-z]{3,12})(?:,[ \t\n]+[A-Za-z0-9.+#]{2,18}){2,4}(?:,?[ \t\n]+and[ \t\n]+[A-Za-z0-9.+#]{2,18}))"

# Spellings of one thing; the posting's longest wins.
SYNONYM_GROUPS = [
    ["rag pipeline", "rag pipelines", "retrieval pipeline", "retrieval workflow", "retrieval workflows"],
    ["llm", "large language model", "large language models", "llms"],
    ["ml", "machine learning"],
    ["ci/cd", "ci cd", "continuous integration", "continuous deployment"],
    ["kubernetes", "k8s"],
    ["aws", "amazon web services"],
    ["gcp", "google cloud", "google cloud platform"],
    ["azure", "microsoft azure"],
    ["rest api", "rest apis", "restful api", "restful apis", "rest endpoint", "rest endpoints"],
    ["graphql", "graph ql"],
    ["grpc", "g rpc"],
    ["postgres", "postgresql"],
    ["typescript", "ts "],
    ["javascript", "js "],
    ["react.js", "react", "reactjs"],
    ["next.js", "nextjs", "next js"],
    ["node.js", "nodejs", "node js"],
    ["frontend", "front end", "front-end"],
    ["backend", "back end", "back-end"],
    ["fullstack", "full stack", "full-stack"],
    ["devops", "dev ops"],
    ["mlops", "ml ops"],
    ["llmops", "llm ops"],
    ["stakeholder management", "stakeholder engagement", "managing stakeholders"],
    ["user research", "user interviews", "customer research"],
    ["product discovery", "discovery work"],
    ["a/b test", "ab test", "split test"],
    ["observability", "observable", "observable systems", "monitoring and tracing"],
]

# Which lines could carry a term of each category.
CARRIER_PATTERNS = {
    "technical": r"built|developed|designed|implemented|created|deployed|engineered|architected",
    "methodology": r"led|managed|drove|directed|coordinated|organised|planned",
    "domain": r"improved|reduced|increased|achieved|delivered|optimised|enhanced",
    "soft_skill": r"led|managed|collaborated|coordinated|mentored|coached|facilitated|presented|resolved|negotiated"
                  r"|prioritised|drove|improved|reduced|increased|delivered|achieved|established|implemented|supported"
                  r"|partnered|engaged|communicated|trained|guided|oversaw|directed|planned|reviewed|analysed",
    "tool": r"using|with|through|via|implementing|deploying|applying",
}

# Words too common to tell one line from another.
STEM_STOP_WORDS = (
    "the and for with that this from into across their them they were was are has had have been which while after before "
    "over under through every each more than then when where what who whom its it a an of in on to by at as is be or so "
    "up out all"
).split()
BACK_REFERENCE = r"(?i)^[ \t]*[-•*]?[ \t]*(?:on top of that|additionally|also|separately|in addition|this |these |that work|building on|alongside this)"
SOFT_TERM = (
    r"communication|collaboration|leadership|teamwork|mentoring|problem.?solving|critical.?thinking|adaptability|stakeholder"
    r"|cross.?functional|empathy|prioriti|time.?management|conflict|creative|decision|initiative|negotiation|coaching"
    r"|facilitation|delegation|strategic|relationship|change.?management|continuous.?improvement|analytical"
    r"|attention.?to.?detail|presentation|design.?thinking|data.?driven|requirements.?gathering|process.?improvement"
    r"|customer.?focus|client.?management|vendor.?management|resource.?management|budget.?management|quality.?assurance"
    r"|incident.?management|knowledge.?sharing|risk.?management"
)

# Fixed values of the qualification match: the long words compared, and the pieces of evidence shown.
QUALIFICATION_WORDS = 8
EVIDENCE_SHOWN = 2

# Fixed values of the gates: the experience heading, and degrees as postings and CVs write them.
EXPERIENCE_START = r"(?i)(?:^|\n)[ \t]*(?:PROFESSIONAL[ ]+|WORK[ ]+|RELEVANT[ ]+)?(?:EXPERIENCE|EMPLOYMENT(?:[ ]+HISTORY)?|CAREER[ ]+HISTORY)[ \t]*:?[ \t]*\n"
DEGREE_ASKED = r"(?i)(?:^|[^A-Za-z0-9_])(?:bachelor|master|degree|bsc|msc|phd)(?:$|[^A-Za-z0-9_])"
DEGREE_NAMED = r"(?i)(?:^|[^A-Za-z0-9_])(?:bachelor|master|bsc|msc|phd|b\.?a|m\.?a|b\.?eng|m\.?eng)(?:$|[^A-Za-z0-9_])"
