"""The rule registry: patterns, keywords, path rules, reputation, and the constant sets of the policies.

Everything in this module is a fixed value: results are only right if they are exactly these.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

HIGH, MEDIUM = "HIGH_SENSITIVE", "MEDIUM_SENSITIVE"


@dataclass(frozen=True)
class Rule:
    """A candidate pattern.  ``guard`` is a cheap pattern that any text with a match also has; alternatives without
    special characters are looked for as plain strings.  ``digits`` says that any match holds :data:`FOUR_DIGITS`, which
    is tested once for all such rules.

    ``validator`` is the name of one of this library's or, for rules of one's own, a function from a Column of
    matched values to a boolean Column.
    """

    name: str
    entity: str
    pattern: str
    category: str
    keywords: tuple[str, ...]
    validator: str | Callable | None = None
    strong: bool = False
    guard: str | None = None
    digits: bool = False


FOUR_DIGITS = r"\d[ \-]?\d[ \-]?\d[ \-]?\d"

#: In order; the position decides ties.
RULES: tuple[Rule, ...] = (
    Rule("password_in_config", "PASSWORD", r"(?i)(password|passwd|pwd|secret)\s*[:=]\s*\S+", HIGH, ("password", "secret", "pwd"), guard=r"(?i)passw|pwd|secret"),
    Rule("bank_account", "BANK_ACCOUNT", r"\b\d{9,18}\b", HIGH, ("account", "bank", "beneficiary", "ifsc", "branch"), guard=r"\d{9}", digits=True),
    Rule("credit_card", "CREDIT_CARD", r"\b(?:\d[ \-]?){13,16}\b", HIGH, ("card", "visa", "mastercard", "amex", "cvv", "payment", "debit", "credit"), "luhn", guard=r"\d(?:[ \-]?\d){12}", digits=True),
    Rule("upi_id", "UPI_ID", r"(?i)\b[a-zA-Z0-9.\-_]{2,256}@(oksbi|okhdfcbank|okicici|okaxis|ybl|ibl|paytm|axl)\b", HIGH, ("upi", "vpa", "pay", "bhim", "gpay", "phonepe"), "upi", guard="@"),
    Rule("aadhaar_number", "AADHAAR", r"[2-9]\d{3}\s?\d{4}\s?\d{4}", HIGH, ("aadhaar", "uidai", "aadhar"), "verhoeff", guard=r"\d{4}\s?\d{4}", digits=True),
    Rule("passport_india", "PASSPORT", r"[A-PR-WY][1-9]\d{7}", HIGH, ("passport", "travel", "visa"), guard=r"\d{8}", digits=True),
    Rule("aws_access_key", "AWS_ACCESS_KEY", r"\bAKIA[0-9A-Z]{16}\b", HIGH, ("aws", "amazon", "access", "key"), "aws", True, "AKIA"),
    Rule("google_api_key", "GOOGLE_API_KEY", r"\bAIza[0-9A-Za-z_-]{35}\b", HIGH, ("google", "api", "key"), "google", True, "AIza"),
    Rule("github_token", "GITHUB_TOKEN", r"\b(?:ghp_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{20,})\b", HIGH, ("github", "gh", "token", "pat"), "github", True, "ghp_|github_pat_"),
    Rule("openai_api_key", "OPENAI_API_KEY", r"\bsk-[A-Za-z0-9_-]{20,}\b", HIGH, ("openai", "api", "key"), "openai", True, "sk-"),
    Rule("stripe_key", "STRIPE_KEY", r"\b(?:sk_live|pk_live)_[A-Za-z0-9]{16,}\b", HIGH, ("stripe", "payment", "key"), "stripe", True, "k_live_"),
    Rule("jwt_token", "JWT_TOKEN", r"\beyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", HIGH, ("jwt", "token", "auth", "bearer"), "jwt", True, "eyJ"),
    Rule("ssh_private_key", "SSH_PRIVATE_KEY", r"-----BEGIN [^\n]{0,10}PRIVATE KEY-----", HIGH, (), "ssh", True, "-----BEGIN "),
    Rule("recovery_code", "RECOVERY_CODE", r"\b[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{4}\b", HIGH, ("recovery", "backup", "mfa", "2fa"), guard=r"[A-Z0-9]-[A-Z0-9]"),
    Rule("email_address", "EMAIL", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", MEDIUM, ("email", "mail", "contact"), guard="@"),
    Rule("indian_phone", "PHONE_NUMBER", r"(\+91|0)?[6-9]\d{9}", MEDIUM, ("phone", "mobile", "contact", "call"), guard=r"\d{10}", digits=True),
    Rule("pan_card", "PAN_CARD", r"[A-Z]{5}[0-9]{4}[A-Z]", MEDIUM, ("pan", "income tax"), "pan", guard=r"[A-Z][0-9]{4}[A-Z]", digits=True),
    Rule("ifsc_code", "IFSC_CODE", r"[A-Z]{4}0[A-Z0-9]{6}", MEDIUM, ("ifsc", "bank", "branch"), guard=r"[A-Z]{4}0"),
    Rule("driving_licence", "DRIVING_LICENCE", r"[A-Z]{2}[0-9]{2}[A-Z]{2}[0-9]{11}", MEDIUM, ("driving", "licence", "dl", "rto"), guard=r"[0-9]{11}", digits=True),
    Rule("voter_id", "VOTER_ID", r"[A-Z]{3}[0-9]{7}", MEDIUM, ("voter", "epic", "election"), guard=r"[A-Z][0-9]{7}", digits=True),
    Rule("vehicle_registration", "VEHICLE_REGISTRATION", r"[A-Z]{2}[0-9]{2}[A-Z]{1,2}[0-9]{4}", MEDIUM, ("vehicle", "rc", "registration", "car", "bike"), guard=r"[A-Z][0-9]{4}", digits=True),
)

#: Files that hold credentials by their path: (pattern, entity); the first that is found counts.
PATH_RULES = (
    (r"\.env$", "ENV_FILE"),
    (r"\.ssh/(id_rsa|id_ed25519)", "SSH_PRIVATE_KEY_FILE"),
    (r"\.git-credentials", "GIT_CREDENTIALS"),
    (r"\.aws/credentials", "AWS_CREDENTIALS"),
    (r"\.docker/config\.json", "DOCKER_CONFIG"),
    (r"\.kube/config", "KUBERNETES_CONFIG"),
    (r"Login Data$", "BROWSER_CREDENTIALS"),
    (r"Cookies$", "BROWSER_COOKIES"),
)
#: Paths with one of these parts give no finding of the rules at all.
SUPPRESSED_PATH_PARTS = ("library/", "applications/", "caches/", "logs/", "node_modules/", "package-lock", "npm", "browser")

#: Reputation of a path: in each group the first pattern found counts; groups are summed.
POSITIVE_REPUTATION = (
    (r"(?i)(^|[\\/])\.aws[\\/]credentials$", 40),
    (r"(?i)(^|[\\/])\.kube[\\/]config$", 40),
    (r"(?i)(^|[\\/])credentials(?:\.[^\\/]*)?$", 30),
    (r"(?i)(^|[\\/])secrets\.ya?ml$", 30),
    (r"(?i)(^|[\\/])\.env(?:\.[^\\/]*)?$", 25),
    (r"(?i)(^|[\\/])(?:config|.*\.config|.*config\.(?:json|ya?ml|txt))$", 20),
)
NEGATIVE_REPUTATION = (
    (r"(?i)(^|[\\/])node_modules([\\/]|$)", -60),
    (r"(?i)(^|[\\/])(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml)$", -60),
    (r"(?i)(^|[\\/])(?:\.next|dist|build|out|coverage|\.cache|vendor)([\\/]|$)", -50),
)
APPLICATION_DATA = (
    (r"(?i)(^|[\\/])(?:google[\\/]chrome|chrome|chromium)([\\/]|$)", -60),
    (r"(?i)(^|[\\/])(?:microsoft[\\/]edge|edge)([\\/]|$)", -60),
    (r"(?i)(^|[\\/])firefox([\\/]|$)", -60),
    (r"(?i)(^|[\\/])leveldb([\\/]|$)", -60),
    (r"(?i)(^|[\\/])extension storage([\\/]|$)", -60),
    (r"(?i)(^|[\\/]).*telemetry.*$", -60),
    (r"(?i)(^|[\\/])library[\\/]application support([\\/]|$)", -60),
    (r"(?i)(^|[\\/])appdata[\\/](?:local|roaming)[\\/](?:google|microsoft|code)([\\/]|$)", -60),
)

#: Parts of a score.
REGEX_SCORE, ENTROPY_SCORE, VALIDATOR_SCORE, KEYWORD_SCORE, ASSIGNMENT_SCORE = 30, 25, 25, 20, 15
STRONG_SCORE, PUBLISH_SCORE = 90, 60
CONTEXT_CHARS = 60
#: An assignment: a word, a sign, a value.
ASSIGNMENT = r"\w\s*[:=]\s*\S"

#: Severity of a category; any other is MEDIUM.
SEVERITY = {"HIGH_SENSITIVE": "CRITICAL", "MEDIUM_SENSITIVE": "HIGH", "CREDENTIAL_STORE": "CRITICAL", "HIGH_ENTROPY_SECRET": "HIGH"}

#: Validators.
PAN_HOLDERS = "PCHABGJLEFT"
UPI_PROVIDERS = ("oksbi", "okhdfcbank", "okicici", "okaxis", "ybl", "ibl", "paytm", "axl")
NPM_SCOPES = ("@swc", "@babel", "@types", "@next", "@eslint", "@react", "@angular", "@vue", "@vite")
NPM_PACKAGE = r"@[a-z0-9][a-z0-9._-]*/[a-z0-9][a-z0-9._-]*"
SHAPES = {
    "aws": r"AKIA[0-9A-Z]{16}",
    "google": r"AIza[0-9A-Za-z_-]{35}",
    "github": r"ghp_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{20,}",
    "openai": r"sk-[A-Za-z0-9_-]{20,}",
    "stripe": r"(?:sk_live|pk_live)_[A-Za-z0-9]{16,}",
    "ssh": r"-----BEGIN [^\n]{0,10}PRIVATE KEY-----",
}

#: Entropy detector.
ENTROPY_THRESHOLDS = {"hex": 4.0, "base64": 4.8, "alphanumeric": 4.2}
ENTROPY_KEYWORDS = ("key", "secret", "token", "password")
ENTROPY_KEYWORD_BOOST = 0.3
ENTROPY_MARGINS = ((1.5, 0.90), (0.8, 0.75), (0.2, 0.60))
TOKEN_MIN, TOKEN_MAX = 16, 80
TOKEN_STRIPPED = ".,;()[]{}!<>?'\""
HEX_TOKEN = r"[0-9a-fA-F]+"
BASE64_TOKEN = r"[a-zA-Z0-9+/]+={0,2}"
TOKEN_EXCLUSIONS = (
    r"(?i)^(https?://|git://|ssh://|github\.com|www\.)",
    r"(?i)github\.com/",
    r"^([a-zA-Z]:\\|/|\\)([\w.\-]+[\\/])+[\w.\-]+$",
    r"(?i)\.(js|ts|json|md|html|css|txt|yml|yaml|xml|csv|png|jpg|jpeg|gif|svg|exe|dll|so|dylib|zip|tar|gz)$",
    r"(?i)^@?[a-z0-9\-_]+/[a-z0-9\-_.]+$",
    r"^[a-z0-9\-_]+$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
)
ASSET_EXTENSIONS = (".js", ".css", ".woff", ".woff2", ".png", ".jpg", ".jpeg", ".svg", ".map")
BUILD_HINTS = ("build", "asset", "font", "manifest", "chunk", "webpack", "turbopack", "buildid", "moduleid", "chunkid", "contenthash", "webpack_require")
GENERATED_ID = r"[A-Za-z0-9_-]{16,}"
GENERATED_DIRECTORIES = (".next", "dist", "build", "out", "coverage", ".turbo", ".cache")
GENERATED_FILES = ("build-manifest.json", "next-font-manifest.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "telemetry-core.json", "thirdpartynotices.txt", "nls.keys.json", "nls.messages.json")
GENERATED_NAME_PARTS = ("manifest", "font", "chunk", "asset", "bundle", "telemetry")

#: Decoders.
BASE64_RUN = r"[A-Za-z0-9+/]{20,}={0,2}"
HEX_RUN = r"(?:[0-9a-fA-F]{2}){10,}"
ROT13_HINT = r"(?i)\b(rot13|rot-13|rot_13|caesar\s*13|caesar-13)\b"
PRINTABLE_SHARE = 0.9

#: File policy.
MAX_FILE_BYTES = 50 * 1024 * 1024
SCANNED_EXTENSIONS = (".txt", ".env", ".json", ".yaml", ".yml", ".config", ".sqlite", ".db", ".sqlite3")
OWN_HOME = ".veilscan"
EXCLUDED_COMPONENTS = ("node_modules", ".git", ".cache", ".next", ".turbo", ".venv", "venv", "pycache", "__pycache__", "dist", "build", "out", "coverage", "vendor", OWN_HOME)
EXCLUDED_FILES = (
    "build-manifest.json",
    "desktop.ini",
    "events.db",
    "events.db-journal",
    "events.db-shm",
    "events.db-wal",
    "findings.db",
    "findings.db-journal",
    "findings.db-shm",
    "findings.db-wal",
    "honeycomb_manifest.enc",
    "honeycomb_manifest.json",
    "manifest.enc",
    "next-font-manifest.json",
    "nls.keys.json",
    "nls.messages.json",
    "package-lock.json",
    "pnpm-lock.yaml",
    "scanner.db",
    "scanner.db-journal",
    "scanner.db-shm",
    "scanner.db-wal",
    "telemetry-core.json",
    "thirdpartynotices.txt",
    "thumbs.db",
    "yarn.lock",
    "package.json",
)
EXCLUDED_APPS = (
    "android studio.app",
    "chrome.app",
    "cursor.app",
    "firefox.app",
    "google chrome.app",
    "safari.app",
    "visual studio code.app",
    "xcode.app",
)
EXCLUDED_PATH_PARTS = (
    "c:/windows", "c:/program files", "c:/program files (x86)", "c:/programdata", "c:/programdata/microsoft", "c:/$recycle.bin",
    "appdata/local/temp", "appdata/roaming/code", "appdata/local/google", ".local/share/opencode", ".config/opencode",
    "library/caches", "library/application support", "google/chrome", "chromium", "microsoft/edge", "leveldb",
    "extension storage", "code cache", "cache_data",
)
DISTRIBUTION_EXTENSIONS = (".app", ".dmg", ".pkg")
OWN_TABLES = ("findings", "honeycomb_alerts")

#: File kinds by their first bytes, in order; ``zip`` is told apart by the extension.
MAGICS = (
    (b"\x4D\x5A", "SKIP"),
    (b"\x25\x50\x44\x46", "pdf_parser"),
    (b"\x50\x4B\x03\x04", "zip"),
    (b"\x53\x51\x4C\x69", "sqlite_parser"),
    (b"\xFF\xD8\xFF", "exif_parser"),
    (b"\x89\x50\x4E\x47", "exif_parser"),
    (b"\x52\x61\x72\x21", "archive_parser"),
    (b"\x37\x7A\xBC\xAF", "archive_parser"),
    (b"\x1F\x8B", "archive_parser"),
    (b"-----BEG", "text_parser"),
)
OFFICE_EXTENSIONS = (".docx", ".xlsx", ".pptx")
CONTROL_SHARE = 0.3

#: Honeytokens: place below the home folder, kind.
DEPLOYMENTS = (
    ("Documents/credentials.txt", "GENERIC_API_KEY"),
    ("Desktop/.env", "ENV_FILE"),
    (".ssh/backup_key", "SSH_PRIVATE_KEY"),
    (".app_config.json", "JSON_CREDENTIALS"),
    ("Downloads/api_keys.txt", "MIXED_API_KEYS"),
    ("Documents/dev/secrets.env", "ENV_FILE"),
)
#: What a file event means: (kind, incident).
INCIDENTS = {"modified": "FILE_MODIFIED", "deleted": "TOKEN_ACCESSED", "moved": "TOKEN_ACCESSED", "moved_to": "TOKEN_ACCESSED", "opened": "FILE_OPEN"}
CORRELATION_SECONDS = 5
SYSMON_LOOKBACK = 100
