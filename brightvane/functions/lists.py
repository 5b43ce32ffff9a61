"""Word lists, patterns and tables that results depend on. Kept together and in natural order."""

# Phrases of vendor marketing.
PROMOTIONAL = (
    "request a demo", "book a demo", "start free trial", "get started free",
    "talk to sales", "sign up today", "our platform helps", "trusted by",
    "schedule a demo", "contact sales", "see pricing", "watch the demo",
)

# Tells of vendor marketing within a passage.
MARKETING_TELLS = (
    "awarded", "highlighted by", "named to", "recognized as", "recognised as",
    "ranked #", "#1 ai", "our platform", "our ai employee", "we help businesses",
    "join us", "we're looking for", "we are looking for", "you'll be", "the role",
    "reply to get", "text us", "% off your",
)

# Phrases of page furniture.
FURNITURE = (
    "watch a demo", "watch demo", "book a demo", "request a demo", "schedule a demo",
    "get started", "start free", "sign up", "log in", "learn more", "read more",
    "see how it works", "talk to sales", "contact sales", "get pricing",
    "integrates with the tools", "works with your systems", "trusted by",
    "all rights reserved", "privacy policy", "terms of service", "cookie",
    "skip to content", "back to top", "share this", "subscribe",
    "follow us", "download the", "view all", "explore our", "browse",
)

# Function words of almost any English sentence.
FUNCTION_WORDS = (
    "the", "and", "of", "to", "a", "in", "is", "that", "for", "it", "with", "on",
    "as", "are", "was", "at", "be", "by", "this", "from", "or", "an", "we", "you",
    "they", "has", "have", "their", "its", "but", "not", "can", "will", "more",
)

# Patterns.
# the white space first, which is rarer than what precedes it
SENTENCE_BREAK = r"(?U)\s(?<=[.!?]\s)\s*+(?-U)(?=[A-Z\"'“(])"
TERMINAL = r"[.!?][\"'”’)]?\s*$"
HEADING = r"^[A-Z0-9][A-Za-z0-9 &/,'’-]{0,60}$"
NUMBER = (
    r"(?i)(?<![\w.])"
    r"(\$?\d[\d,]*\.?\d*\s?(?:%|percent|x|bn|billion|million|k\b|hours?|minutes?|days?|"
    r"seconds?|customers?|businesses?|dealerships?|locations?|leads?|calls?)?)"
)
GROUPED_NUMBER = r"^\$?\d{1,3}(?:,\d{3})+(?:\.\d+)?\s?\D*$"
QUOTED = r"[“\"]([^”\"]{25,400})[”\"]"
ATTRIBUTION = (
    r"(?:said|says|according to|explained|noted|told|adds|added)\s+"
    r"([A-Z][a-zA-Z.'-]+(?:\s+[A-Z][a-zA-Z.'-]+){0,3})"
)
BOILERPLATE = (
    r"(?i)(cookie policy|accept all cookies|privacy policy|terms of service|"
    r"all rights reserved|subscribe to our newsletter|skip to (main )?content)"
)

# Query parameters that never change what a URL names (compared in lower case, so the two mixed-case ones never match).
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "utm_id", "utm_source_platform", "utm_creative_format", "utm_marketing_tactic",
    "gclid", "gclsrc", "dclid", "fbclid", "msclkid", "mc_cid", "mc_eid",
    "igshid", "ref", "ref_src", "referrer", "source", "spm", "yclid",
    "_hsenc", "_hsmi", "hsCtaTracking", "vero_id", "wickedid", "sc_cid",
    "campaign_id", "ad_id", "adgroupid", "cmpid", "amp", "at_medium",
    "device", "m_bt", "matchtype", "network", "creative", "keyword",
    "placement", "adposition", "gad_source", "gad_campaignid", "gbraid",
    "wbraid", "srsltid", "mkt_tok", "trk", "trkCampaign", "sfmc_id",
    "s_kwcid", "ef_id", "gclid_src", "li_fat_id", "twclid", "ttclid",
    "epik", "irclickid", "rdt_cid",
)
INDEX_FILES = ("/index.html", "/index.htm", "/index.php", "/default.aspx")
TWO_PART_SUFFIXES = ("co.uk", "com.au", "co.nz", "co.jp", "com.br", "co.za")

# Directories that republish company data without reporting.
AGGREGATORS = (
    "startupintros.com", "unifygtm.com", "crunchbase.com", "pitchbook.com",
    "zoominfo.com", "owler.com", "leadiq.com", "rocketreach.co", "apollo.io",
    "growjo.com", "cbinsights.com", "tracxn.com", "craft.co", "comparably.com",
    "glassdoor.com", "builtin.com", "clearbit.com", "similarweb.com",
    "g2.com", "capterra.com", "getlatka.com", "wellfound.com",
)

# Score components in order with their weights, and points of risk factors.
WEIGHTS = {"market_relevance": 0.25, "speaker_relevance": 0.20, "evidence_strength": 0.20, "freshness": 0.15, "novelty": 0.10, "business_impact": 0.10}
RISK_POINTS = {
    "weak_sourcing": 18, "unverified_numbers": 16, "competitor_claims": 14, "sensitive_claims": 14, "promotional_source": 10,
    "overused_narrative": 10, "no_original_insight": 10, "generic_tone": 8, "missing_publication_date": 6,
}
UNKNOWN_RISK_POINTS = 8

# Hype phrases, and markers of opinion and of the future, in drafts.
BANNED = (
    "game-changer", "game changer", "revolutionize", "revolutionise", "unlock",
    "in today's fast-paced", "the future of", "10x", "let that sink in",
    "here's the kicker", "paradigm shift", "supercharge", "seismic shift",
)
OPINION = (
    "i think", "i believe", "my view", "in my experience", "the way i see it",
    "should", "must", "needs to", "i'd argue", "we should", "the real question",
    "here's the thing", "worth asking", "my read",
)
FUTURE = ("will ", "going to ", "expect ", "predict", "by 2026", "by 2027", "soon")
AUDIT_STOPWORDS = (
    "that", "this", "with", "from", "they", "them", "their", "there", "these",
    "those", "have", "has", "had", "been", "being", "which", "when", "what",
    "your", "you", "our", "and", "but", "for", "not", "are", "were", "was",
    "into", "than", "then", "also", "just", "more", "most", "much", "only",
    "over", "such", "some", "same", "still", "even", "here", "will", "would",
    "could", "should", "about", "after", "before", "because", "while", "where",
    "every", "each", "both", "many", "make", "makes", "made", "does", "doing",
)

# Sentence markers, and phrases, of the extraction scores.
PROBLEM_MARKERS = (
    "problem", "struggle", "challenge", "fail", "miss", "lose", "lost", "can't",
    "cannot", "difficult", "friction", "bottleneck", "pain point", "wait",
    "delay", "shortage", "churn", "drop off", "abandon", "never",
)
CLAIM_MARKERS = (
    "percent", "%", "according to", "found that", "reported", "survey", "study",
    "data shows", "research", "announced", "launched", "grew", "increase",
    "decrease", "average", "median", "respondents",
)
FAMILIAR = (
    "ai is transforming", "the future of work", "game changer", "game-changer",
    "revolutionizing", "revolutionising", "in today's fast-paced",
    "artificial intelligence is changing", "unlock the power",
)
EVIDENCE_WORDS = ("ai", "customer", "business", "lead", "revenue", "appointment", "call")
MONEY = ("revenue", "profit", "cost", "roi", "booked", "conversion", "close rate", "lost sales", "pipeline", "churn")
SCALE = ("thousands of", "millions", "industry-wide", "nationwide", "across the industry", "every business")
MISSED = ("missed call", "unanswered", "lost lead", "no follow")
AGENT = ("ai employee", "ai agent", "agentic")
SMALL_BUSINESS = ("local business", "small business", "smb")
RESPONSE = ("missed call", "lead response", "speed to lead", "follow-up", "follow up")
FOUNDER = ("founder", "ceo", "co-founder", "started the company")
OPERATOR = (
    "local business", "small business", "dealership", "home services",
    "medspa", "front desk", "lead", "revenue", "appointment", "customer follow",
    "staffing", "receptionist",
)
DEEP_TECH = ("benchmark", "parameter count", "training run", "gpu cluster", "model weights", "arxiv", "inference cost per token")
CORE_INDUSTRIES = ("Automotive", "Home services", "Aesthetics & medspa", "Healthcare", "Retail")

# Places that are no conversations.
NO_CONVERSATION_DOMAINS = (
    "job-boards.greenhouse.io", "boards.greenhouse.io",
    "lever.co", "workday.com", "myworkdayjobs.com", "indeed.com",
    "glassdoor.com", "ziprecruiter.com",
)
NO_CONVERSATION_PATHS = (
    "/jobs/", "/job/", "/careers", "/pricing", "/legal", "/privacy", "/terms",
    "/login", "/signup", "/demo", "/product/", "/solutions/", "/integrations",
    "/press-kit", "/newsroom", "/company/", "/school/", "/showcase/",
)
SOCIAL_HOSTS = ("linkedin.com", "x.com", "twitter.com")
POST_MARKERS = ("/posts/", "/pulse/", "/status/", "/feed/update/")

# Channels that come first in an interleaving.
CHANNEL_PRIORITY = ("first_party", "manual", "youtube", "web_search", "rss")

# Marks of style in voice examples, and of decisions and actions in meetings.
HYPE = ("game-changer", "game changer", "revolutionize", "revolutionise", "unlock", "leverage", "paradigm", "disrupt", "10x", "supercharge")
CONTRAST = (r"\bisn'?t\b[^.]{0,60}\bit'?s\b", r"\bnot\b[^.]{0,50}\bbut\b", r"\bless\b[^.]{0,40}\bmore\b", r"\bdon'?t\b[^.]{0,50}\bdo\b")
CALLS = (r"what (are|do) you", r"let me know", r"curious (what|how)", r"agree\?", r"how (are|do) you", r"tell me", r"drop a", r"reply", r"thoughts")
STORIES = ("a customer", "one of our customers", "a dealership", "a shop owner", "a business owner", "we worked with", "last week i", "i talked to", "i met", "a client")
FIGURE = r"\b\d[\d,.]*\s?%?\b"
PERSONAL_TYPES = ("linkedin_post", "interview", "podcast", "press_quote", "keynote", "earnings_or_investor_comment")
COMMERCIAL_THEMES = ("Revenue ownership by AI", "Speed to lead", "Customer reactivation", "AI cost and measurable ROI")
ASSUMPTIONS = (
    "Direct", "Clear", "Commercially focused", "Optimistic about AI", "Grounded in business outcomes",
    "Focused on local-business problems", "Uses short paragraphs", "Avoids generic AI hype", "Prefers measurable impact",
    "Connects product capability to revenue or customer outcomes",
)
DECISIONS = ("we'll ", "we will ", "let's ", "we're going to ", "decision is", "we've decided", "we should ", "agreed")
ACTIONS = ("i'll ", "i will ", "can you ", "please ", "take that", "by friday", "by monday", "next week", "action item", "owns ", "will own", "follow up")
SPEAKER = r"^\s*([A-Z][\w .'-]{1,40}?)\s*:\s*(.+)$"
META_LINE = r"(?i)^\s*(\[|https?://|#\d|\*\*(sources?|evidence|verification|pre-production|rules)|-\s*(source|evidence|on-screen)\b|\|)"
SKIPPED_LINKS = r"(?i)(/privacy|/terms|/legal|/cookie|/login|/signin|/sign-in|/signup|/sign-up|/demo|/pricing|/contact|/careers/apply|\.pdf$|\.zip$|/cdn-cgi/|#)"
DROPPED_TAGS = ("script", "style", "noscript", "nav", "header", "footer", "form", "aside", "iframe", "svg", "button")
DROPPED_CLASSES = ("cookie-banner", "newsletter-signup", "breadcrumbs")
BLOCK_TAGS = ("h1", "h2", "h3", "p", "li", "blockquote", "td")
ARTICLE_TYPES = ("Article", "NewsArticle", "BlogPosting", "Report", "WebPage", "TechArticle")

# Errors of a model's provider that trying again cannot mend, and those of a spent allowance
PERMANENT_ERRORS = ("api key", "authentication", "invalid_api_key", "incorrect api key", "insufficient_quota", "exceeded your current quota", "billing", "account is not active", "permission")
SPENT_ALLOWANCE = ("requests per day", "rpd", "requests per min", "rpm", "tokens per min", "tpm", "rate limit reached", "rate_limit_exceeded")

# The figures and the quoted passages of a draft that its evidence must hold
AUDIT_NUMBER = r"(\b\d[\d,.]*%?\b)"
AUDIT_QUOTE = r"[“\"]([^”\"]{20,})[”\"]"
