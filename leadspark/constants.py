"""Fixed values. Results are only right when these match exactly, so they are
kept together here as plain text."""

# --- fixed values: URLs -----------------------------------------------------
TRACKING_PARAMS = [
    "fbclid", "gclid", "dclid", "msclkid", "yclid", "mc_cid", "mc_eid", "igshid",
    "ref", "ref_src", "ref_url", "referrer", "source", "src", "trk", "trkinfo",
    "trackingid", "lipi", "original_referer", "originalsubdomain", "si", "share_id",
    "_ga", "_gl", "spm", "cmpid", "sh", "rdt", "context", "sort", "mibextid", "rcm",
]
TRACKING_PREFIXES = ["utm_", "pk_", "hsa_", "mtm_", "at_"]
JUNK_SUBSTRINGS = [
    "duckduckgo.com", "google.com/search", "bing.com/search", "youtube.com", "youtu.be",
    "facebook.com/login", "accounts.google.com", "play.google.com", "apps.apple.com",
]
JUNK_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "webp", "svg", "mp4", "zip", "exe"]
HTTPS_ONLY_HOSTS = [
    "linkedin.com", "reddit.com", "quora.com", "facebook.com", "x.com", "twitter.com",
    "naukri.com", "indeed.com", "github.com", "medium.com",
]
PLATFORM_NEEDLES = [
    ("linkedin.com", "linkedin"),
    ("reddit.com", "reddit"),
    ("quora.com", "quora"),
    ("facebook.com", "facebook"),
    ("twitter.com", "x"),
    ("x.com", "x"),
    ("naukri.com", "job_portal"),
    ("indeed.", "job_portal"),
    ("monster", "job_portal"),
    ("foundit.in", "job_portal"),
    ("shine.com", "job_portal"),
    ("apna.co", "job_portal"),
    ("workindia", "job_portal"),
    ("glassdoor", "job_portal"),
    ("timesjobs", "job_portal"),
    ("practicalmachinist.com", "forum"),
    ("cnczone.com", "forum"),
    ("eng-tips.com", "forum"),
    ("github.com", "github"),
]
STRICT_HOST_NEEDLES = [
    "linkedin.com", "facebook.com", "instagram.com", "quora.com", "x.com", "twitter.com",
    "indeed.com", "glassdoor.",
]
WALL_PATH_RX = r"(?iu)authwall|/login|/signin|/checkpoint|/uas/login|captcha"

# --- fixed values: strings --------------------------------------------------
# The characters counted as white space, written as a regex class body.
WS = (r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                             0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PLACEHOLDERS = ["", "n/a", "na", "nan", "none", "null", "unknown", "not mentioned", "-"]
EMAIL_TRIM_CHARS = " .,;:()<>[]\"'"
MAX_EVIDENCE_CHARS = 600
MAX_SLUG_CHARS = 60
MAX_MESSAGE_CHARS = 700
MAX_FACT_QUOTE_CHARS = 300
MAX_PROMPT_CHARS = 45_000
MAX_PROMPT_CHARS_LEGACY = 30_000
MAX_PAGE_CHARS = 60_000
MAX_REASON_CHARS = 60
SNIPPET_NOTE = ("NOTE: The page could not be opened (login wall / blocked). The content below is ONLY the "
                "search-engine title and snippet for this URL. Extract only what it explicitly states.")
PROMPT_HEADING, PROMPT_HEADING_LEGACY = "----- PAGE CONTENT -----", "----- PAGE CONTENT (markdown) -----"
PROMPT_END = "----- END -----"
FACT_RECRUITER, FACT_ROLE = "Recruiter: ", "Role we are hiring for: "
FACT_EXTRA = "Extra details to mention if relevant: "
FACT_NAME, FACT_SKILLS = "Candidate name: ", "Candidate's stated role / skills: "
FACT_PLACE, FACT_WORDS, FACT_NO_PLATFORM = "Where they showed interest: on ", " — their words: \"", "a public page"

# --- fixed values: contacts -------------------------------------------------
EMAIL_RX = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE_RX = (r"(?<![\p{Nd}/+])(?:\+|00)?\p{Nd}(?:[" + WS + r"().-]?\p{Nd}){8,15}(?![\p{Nd}/])")
CONTACT_BEFORE, CONTACT_AFTER = 160, 60
THREAD_LINE_RX = r"(?md)^(?:POST|COMMENT) by (.+?): (.*)$"
SIGNAL_RX = (
    r"(?iu)interested|my cv|resume|(?<![\p{L}\p{N}_])cv(?![\p{L}\p{N}_])"
    r"|looking for (?:a )?(?:job|opportunit)|open to work|years? (?:of )?experience"
    r"|(?<![\p{L}\p{N}_])(?:i am|iam|i'm)(?![\p{L}\p{N}_])"
    r"|(?<![\p{L}\p{N}_])my (?:name|number|mail|email)|whatsapp|contact"
    r"|@[\p{L}\p{N}_]+\.[\p{L}\p{N}_]+|\+?\p{Nd}[\p{Nd}" + WS + r"-]{8,}\p{Nd}"
)
GROUNDING_MIN_OVERLAP = 0.6
MIN_SNIPPET_CHARS = 40

# --- fixed values: pages ----------------------------------------------------
DROP_TAGS = ["script", "style", "nav", "footer", "header", "form", "aside", "noscript", "svg", "iframe"]
WALL_PHRASES_RX = (
    r"(?iu)authwall|sign in to view|join linkedin|log in to continue|login to continue"
    r"|please enable javascript|verify you are human|are you a robot|captcha"
    r"|access denied|cf-browser-verification|checking your browser"
    r"|you've been blocked|request blocked|unusual traffic"
)
THREAD_KEY_CHARS = 200
THREAD_HEADING = "## Post and comments"
MIN_USEFUL_CHARS = 250
PARSE_ERROR = "HTML parsing failed: "
WALL_SCAN_CHARS = 3000
WALL_MAX_CHARS = 1200
WALL_MAX_CHARS_LEGACY = 4000
BLOCKED_STATUSES = [401, 403, 407, 429, 999]
BLOCKED_STATUSES_LEGACY = [401, 403, 429, 999]
ROBOTS_ERROR = "disallowed by robots.txt"
WALL_ERROR = "login wall / bot check / empty page"

# --- fixed values: states ---------------------------------------------------
LEDGER_STATUSES = ["ok", "snippet", "walled", "failed", "robots", "quota", "pending"]
RETRYABLE_STATUSES = ["robots", "quota"]
OUTREACH_STATUSES = ["new", "drafted", "sent", "replied", "not_interested"]
POSTED_ON_PAGE, SHARED_IN_REPLY = "posted_on_page", "shared_in_reply"
