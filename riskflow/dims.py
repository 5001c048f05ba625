"""Word lists, weights, messages and seed indicators.

Everything in this module is a constant that results depend on. Rules that use
them live in ``functions`` and ``operators``.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values: engines
URL_ENGINE = "url_engine"
TEXT_ENGINE = "nlp_engine"
MALWARE_ENGINE = "malware_engine"
VISUAL_ENGINE = "visual_engine"
SENDER_ENGINE = "sender_engine"
HEADER_ENGINE = "header_analysis_engine"
ATTACHMENT_ENGINE = "attachment_behavior_engine"

RELIABILITY = {
    "url_engine": 0.90,
    "malware_engine": 1.00,
    "nlp_engine": 0.80,
    "visual_engine": 0.90,
    "sender_engine": 0.60,
}
DEFAULT_RELIABILITY = 0.75
MALWARE_FLAGS = ["MALWARE", "malware_detected", "vt_malicious", "vt_suspicious"]

CLASSES = ["Safe", "Suspicious", "Deceptive", "Phishing", "Malware"]
FEEDBACK_SOURCES = ["url", "file", "share", "gmail", "unknown"]
HISTORY_SOURCES = ["url", "file", "share", "gmail", "accessibility_guard", "demo", "unknown"]

# name, safe, suspicious, deceptive, phishing upper bounds, malware needs a signal
PROFILES = [
    ("default", 20.0, 45.0, 70.0, 90.0, True),
    ("strict", 15.0, 35.0, 55.0, 80.0, True),
    ("enterprise", 10.0, 30.0, 50.0, 75.0, True),
]

# ---------------------------------------------------------------- fixed values: URL rules
SUSPICIOUS_TLDS = ["xyz", "top", "cc", "tk", "ml", "ga", "cf", "gq"]
SHORTENERS = ["bit.ly", "tinyurl.com", "t.co", "goo.gl", "is.gd", "cli.gs"]
URL_KEYWORDS = ["login", "verify", "secure", "account", "banking", "update"]
BLOCKED_SCHEMES = ["javascript", "data", "file", "vbscript", "about"]

# ---------------------------------------------------------------- fixed values: text rules
# One pattern list per category; each pattern has one outer capture group.
TEXT_CATEGORIES = {
    "urgency": [
        r"\b(act(?:ing)?\s+now|action\s+required|urgent(?:ly)?|urgency|immediate(?:ly)?|asap"
        r"|time\s+is\s+running\s+out|(?:within\s+)?24\s+hours)\b",
    ],
    "credential_request": [
        r"\b(password(?:s)?|passcode(?:s)?|log[\s-]?in(?:s)?|logging[\s-]?in"
        r"|verif(?:y|ying|ication(?:\s+of)?)\s+(?:your\s+)?(?:account|identity|credentials?)"
        r"|ssn|social\s+security(?:\s+number)?)\b",
        r"\b((?:share|enter|send|provide|give|submit|reply\s+with|input|type|forward)\s+"
        r"(?:your\s+|the\s+)?(?:otp|one[\s-]?time\s+(?:code|password|passcode)))\b",
    ],
    "account_suspension": [
        r"\b(suspend(?:ed|ing)?|suspension(?:s)?|lock(?:ed|ing)?|block(?:ed|ing)?"
        r"|unauthori[zs]ed\s+access|clos(?:e|ed|ing|ure(?:\s+of)?)\s+(?:your\s+)?account"
        r"|deactivat(?:e|ed|ing|ion)|restrict(?:ed|ing|ion)?)\b",
    ],
    "prize_lottery": [
        r"\b(giveaway(?:s)?|lotter(?:y|ies)|win(?:ner|ners|ning)?|claim\s+(?:your\s+)?prize"
        r"|free\s+gift(?:s)?|selected\s+to\s+win)\b",
    ],
    "unusual_payment": [
        r"\b(gift\s+card(?:s)?|wire\s+transfer(?:s)?|western\s+union|bitcoin|crypto|usdt"
        r"|apple\s+pay|cash\s*app)\b",
    ],
}
OTP_DISCLAIMER = (
    r"\b(?:do\s*n['o]?t|never|should\s+not|not\s+to)\s+"
    r"(?:share|disclose|give|reveal|tell|forward)\b"
)
OTP_WORDS = ["otp", "one-time", "one time"]
OTP_VERBS = ["share", "disclose", "give", "tell", "forward"]

# ---------------------------------------------------------------- fixed values: header rules
SPF_FAIL = ["fail", "softfail", "hardfail"]
DKIM_FAIL = ["fail", "hardfail"]
DMARC_FAIL = ["fail", "reject", "quarantine"]

# ---------------------------------------------------------------- fixed values: attachment rules
SAFE_DOC_EXT = [
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "jpg", "jpeg", "png", "gif", "bmp",
    "tiff", "tif", "txt", "csv", "rtf", "mp3", "mp4", "wav",
]
DANGEROUS_EXT = [
    "exe", "dll", "scr", "bat", "cmd", "msi", "vbs", "vbe", "js", "jse", "wsf", "wsh", "ps1",
    "psm1", "psd1", "pif", "com", "hta", "cpl", "jar", "apk", "dmg", "iso", "img", "bin", "reg",
    "inf", "diagcab", "iqy", "slk", "sh", "bash", "py", "pyw", "rb", "pl",
]
EXECUTABLE_EXT = [
    "exe", "dll", "scr", "bat", "cmd", "msi", "com", "pif", "cpl", "hta", "apk", "dmg", "iso",
    "img", "bin",
]
SCRIPT_EXT = [
    "js", "jse", "vbs", "vbe", "wsf", "wsh", "ps1", "psm1", "psd1", "sh", "bash", "py", "pyw",
    "rb", "pl",
]
EVASION_EXT = [
    "scr", "pif", "hta", "cpl", "wsf", "vbs", "vbe", "jse", "cmd", "ps1", "iso", "img", "iqy",
    "slk", "diagcab", "reg", "inf", "lnk",
]
ARCHIVE_EXT = ["zip", "tar", "gz", "bz2", "xz", "7z", "rar", "tgz", "tbz2", "iso", "img", "cab"]
OFFICE_EXT = [
    "docx", "xlsx", "pptx", "docm", "xlsm", "pptm", "dotm", "xltm", "xlam", "ppam",
]
MACRO_EXT = ["docm", "xlsm", "pptm", "dotm", "xltm", "xlam", "ppam"]
LURE_WORDS = [
    "payment", "remittance", "invoice", "receipt", "statement", "swift", "wire", "ach", "fedex",
    "dhl", "usps", "payroll", "overdue", "salary",
]
ATTACHMENT_WEIGHTS = {
    "EXECUTABLE_ATTACHMENT": 50.0,
    "SCRIPT_ATTACHMENT": 45.0,
    "DOUBLE_EXTENSION": 40.0,
    "MACRO_PRESENT": 40.0,
    "ARCHIVE_EXPANSION_ANOMALY": 40.0,
    "EMBEDDED_SCRIPT": 35.0,
    "ATTACHMENT_TYPE_MISMATCH": 35.0,
    "ARCHIVE_DEPTH_ANOMALY": 35.0,
    "SUSPICIOUS_ARCHIVE": 30.0,
    "SUSPICIOUS_EXTENSION": 25.0,
    "NESTED_ARCHIVE": 20.0,
    "SUSPICIOUS_FILENAME": 15.0,
}
DEFAULT_ATTACHMENT_WEIGHT = 20.0
ATTACHMENT_SCORE_CAP = 85.0
STRONG_ATTACHMENT_FLAGS = [
    "EXECUTABLE_ATTACHMENT", "MACRO_PRESENT", "DOUBLE_EXTENSION", "ATTACHMENT_TYPE_MISMATCH",
    "ARCHIVE_EXPANSION_ANOMALY",
]
MAX_UNPACKED_BYTES = 50 * 1024 * 1024
MAX_EXPANSION_RATIO = 50.0
OLE_MACRO_MARKERS = [
    "_VBA_PROJECT", "VBA\x00", "dir\x00", "AutoOpen", "Auto_Open", "Document_Open", "Workbook_Open",
]

# Leading bytes (hex), offset (0-based), extension, mime. Public file signatures.
FILE_SIGNATURES = [
    ("FFD8FF", 0, "jpg", "image/jpeg"),
    ("89504E470D0A1A0A", 0, "png", "image/png"),
    ("474946", 0, "gif", "image/gif"),
    ("57454250", 8, "webp", "image/webp"),
    ("49492A00", 0, "tif", "image/tiff"),
    ("4D4D002A", 0, "tif", "image/tiff"),
    ("424D", 0, "bmp", "image/bmp"),
    ("38425053", 0, "psd", "image/vnd.adobe.photoshop"),
    ("00000100", 0, "ico", "image/x-icon"),
    ("667479706D7034", 4, "mp4", "video/mp4"),
    ("6674797069736F6D", 4, "mp4", "video/mp4"),
    ("1A45DFA3", 0, "mkv", "video/x-matroska"),
    ("41564920", 8, "avi", "video/x-msvideo"),
    ("464C56", 0, "flv", "video/x-flv"),
    ("494433", 0, "mp3", "audio/mpeg"),
    ("FFFB", 0, "mp3", "audio/mpeg"),
    ("4F676753", 0, "ogg", "audio/ogg"),
    ("664C6143", 0, "flac", "audio/x-flac"),
    ("57415645", 8, "wav", "audio/x-wav"),
    ("504B0304", 0, "zip", "application/zip"),
    ("504B0506", 0, "zip", "application/zip"),
    ("504B0708", 0, "zip", "application/zip"),
    ("7573746172", 257, "tar", "application/x-tar"),
    ("526172211A07", 0, "rar", "application/x-rar-compressed"),
    ("1F8B08", 0, "gz", "application/gzip"),
    ("425A68", 0, "bz2", "application/x-bzip2"),
    ("377ABCAF271C", 0, "7z", "application/x-7z-compressed"),
    ("FD377A585A00", 0, "xz", "application/x-xz"),
    ("25504446", 0, "pdf", "application/pdf"),
    ("4D5A", 0, "exe", "application/x-msdownload"),
    ("7F454C46", 0, "elf", "application/x-executable"),
    ("7B5C727466", 0, "rtf", "application/rtf"),
    ("D0CF11E0A1B11AE1", 0, "doc", "application/msword"),
    ("53514C69", 0, "sqlite", "application/x-sqlite3"),
]
EXT_ALIASES = {"jpg": "jpeg", "jpeg": "jpg", "htm": "html", "html": "htm"}

# ---------------------------------------------------------------- fixed values: image rules
CREDENTIAL_PHRASES = [
    "login", "sign in", "password", "username", "verify account", "enter credentials",
]
IMAGE_URL = (
    r"(?:http[s]?://|www\.)(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
)

# ---------------------------------------------------------------- fixed values: explanations
FLAG_REASONS = {
    "vt_malicious": "VirusTotal identified this content as malicious.",
    "vt_suspicious": "VirusTotal identified this content as suspicious.",
    "extension_mismatch": "The file extension does not match its true type.",
    "first_time_sender": "This is the first time receiving a message from this sender.",
    "out_of_character_link": "The sender included a link that is unusual for them.",
    "out_of_character_file": "The sender attached a file that is unusual for them.",
    "ip_based_host": "The URL uses an IP address instead of a standard domain name, which is often used in evasion tactics.",
    "at_symbol_present": "The URL contains an '@' symbol, which can hide the actual destination.",
    "suspicious_tld": "The URL uses a Top-Level Domain (TLD) commonly associated with spam or malicious activity.",
    "url_shortener": "The URL uses a shortening service, which hides the true destination.",
    "url_length_anomaly": "The URL is unusually long.",
    "path_length_anomaly": "The URL path is unusually complex or long.",
    "subdomain_depth_anomaly": "The URL contains an unusually high number of subdomains.",
    "suspicious_keywords": "Suspicious keywords were found in the URL.",
    "double_slash_redirect": "The URL contains a double slash redirect anomaly.",
    "http_without_https": "The URL uses insecure HTTP instead of HTTPS.",
    "non_standard_port": "The URL uses a non-standard network port.",
    "https_in_hostname": "The URL tries to appear secure by including 'https' in the domain itself.",
    "high_shannon_entropy": "The URL looks randomly generated.",
    "high_digit_ratio": "The URL contains a suspiciously high number of digits.",
    "special_char_overload": "The URL contains an unusual amount of special characters.",
    "base64_obfuscation": "The URL appears to contain Base64 encoded (hidden) data.",
    "newly_registered_domain": "The domain is newly registered, which is common for short-lived malicious sites.",
    "qr_code_detected": "A QR code was detected in the attached image.",
    "ocr_text_extracted": "Text was extracted from the image for analysis.",
    "visual_phishing_detected": "Visual analysis detected potential phishing markers.",
    "visual_credential_prompt": "The image contains elements that prompt for credentials or passwords.",
    "ATTACHMENT_TYPE_MISMATCH": "The attachment extension does not match its true detected file type.",
    "SUSPICIOUS_EXTENSION": "The attachment uses a high-risk or suspicious file extension.",
    "DOUBLE_EXTENSION": "The attachment uses a deceptive double file extension to conceal its true format.",
    "EXECUTABLE_ATTACHMENT": "The attachment is an executable binary or executable file format.",
    "SCRIPT_ATTACHMENT": "The attachment contains an executable script file capable of executing commands.",
    "MACRO_PRESENT": "The Office document attachment contains embedded VBA macros.",
    "EMBEDDED_SCRIPT": "The attachment contains embedded scripts or executable objects.",
    "NESTED_ARCHIVE": "The attachment archive contains one or more nested archives.",
    "SUSPICIOUS_ARCHIVE": "The attachment archive exhibits suspicious structural characteristics or payloads.",
    "ARCHIVE_DEPTH_ANOMALY": "The archive structure exceeds safe nesting depth limits.",
    "ARCHIVE_EXPANSION_ANOMALY": "The archive exhibits an unusually large compression expansion ratio.",
    "SUSPICIOUS_FILENAME": "The attachment filename matches deceptive phishing or malware lure patterns.",
    "known_malicious_url": "The URL is flagged on active global cybersecurity threat intelligence feeds.",
    "urlhaus_malicious": "URLhaus threat intelligence confirmed this URL distributes active malware.",
    "openphish_phishing": "OpenPhish threat intelligence confirmed this site is an active phishing portal.",
    "malwarebazaar_verified": "The binary hash matches verified malware in the global MalwareBazaar registry.",
    "whitelisted_trusted_domain": "The domain is verified on global top trusted website whitelists.",
}
ACTIONS = {
    "Safe": "Proceed with normal caution.",
    "Suspicious": "Exercise caution. Do not share sensitive information unless you are certain of the source.",
    "Deceptive": "Do not trust this content. Avoid clicking links or downloading attachments.",
    "Phishing": "Do not click any links or provide credentials. Report and delete this message.",
    "Malware": "Do not open or execute file/link. Isolate and permanently delete the content immediately.",
}
ACTION_NO_MALWARE_SCAN = "Proceed with caution. Malware scanning was unavailable for this file."
REASON_HYPHENS = "The URL contains an unusual number of hyphens, often used to spoof domains."
REASON_NO_MALWARE_SCAN = (
    "Malware scan unavailable: Anti-malware engine could not complete analysis."
)
REASON_CLEAN = "No suspicious indicators were found."
REASON_AGGREGATE = (
    "Assessed based on aggregate engine analysis without specific discrete flags."
)
REASON_LOW_CONFIDENCE = (
    "Note: The confidence of this scan is low due to missing or failed engine analyses."
)
REASON_NO_ENGINE = "No detection engines successfully analyzed this input."

# ---------------------------------------------------------------- fixed values: offline triage
TRIAGE_TLDS = [
    "xyz", "top", "work", "ru", "click", "buzz", "club", "info", "live", "loan", "vip", "cc",
    "cfd", "gq", "tk", "ml", "ga", "cf", "country", "stream", "download", "racing", "win", "bid",
    "date", "faith",
]
TRIAGE_URL_WORDS = [
    "login", "verify", "account", "secure", "banking", "update", "suspend", "confirm", "password",
    "wallet", "billing", "support", "auth", "signin", "security-alert", "recover", "webscr",
    "ebayisapi", "credential", "security", "access", "validate", "reactivate", "unauthorized",
    "locked",
]
TRIAGE_URGENCY = [
    "account has been suspended", "account has been locked", "account suspended",
    "unauthorized activity", "verify your identity immediately", "verify immediately",
    "action required", "urgent notice", "within 24 hours", "security alert",
    "permanently deactivated", "access denied", "suspicious sign-in", "locked due to",
    "confirm your identity", "immediate verification",
]
TRIAGE_HARVEST = [
    "verify your identity", "verify identity", "confirm your identity", "identity verification",
    "enter your password", "confirm your password", "provide your pin", "enter otp",
    "verification code", "social security", "credit card details", "billing information",
    "update payment method", "seed phrase", "private key",
]
TRIAGE_DANGEROUS_EXT = [
    "exe", "apk", "bat", "vbs", "cmd", "scr", "ps1", "sh", "msi", "hta", "iso", "com", "pif",
    "jar", "reg", "cpl",
]
TRIAGE_MACRO_EXT = ["docm", "xlsm", "pptm", "dotm", "xltm"]
TRIAGE_DOC_EXT = ["pdf", "doc", "docx", "xls", "xlsx", "jpg", "png", "txt"]
TRIAGE_REASONS = {
    "ip_based_host": "The URL uses a raw IP address instead of a recognized domain name, a common evasion tactic.",
    "at_symbol_present": "The URL contains an '@' symbol used to obscure the true browser destination.",
    "suspicious_tld": "The URL uses a Top-Level Domain (TLD) heavily associated with deceptive spam or malware.",
    "suspicious_keywords": "High-risk credential harvesting keywords (e.g., login, verify, account) were detected in the URL path.",
    "subdomain_depth_anomaly": "Excessive subdomain nesting detected, often used to bypass reputation filters.",
    "http_without_https": "The URL transmits unencrypted data via HTTP instead of secure HTTPS.",
    "high_shannon_entropy": "The hostname appears algorithmically generated with high randomness entropy.",
    "high_digit_ratio": "The domain name comprises an abnormally high density of numerical digits.",
    "urgency_and_fear_cues": "Aggressive urgency or psychological fear tactics detected ('account suspended', 'unauthorized activity').",
    "credential_harvesting_intent": "Explicit demands to input passwords, PINs, or verify identity detected.",
    "embedded_suspicious_url": "Message contains an unverified, deceptive link directing outside legitimate infrastructure.",
    "dangerous_executable_extension": "File payload uses an executable or script format known to deliver malicious code.",
    "double_extension_anomaly": "Deceptive double extension detected attempting to disguise an executable as a document.",
    "macro_enabled_document": "Document contains macro execution capabilities frequently leveraged in targeted attacks.",
    "suspicious_sender_tld": "Sender email domain originates from a high-risk or disposable top-level domain.",
    "sender_impersonation_mismatch": "Sender infrastructure mimics bank, security, or corporate verification alerts.",
}
TRIAGE_ACTIONS = {
    "Malware": "CRITICAL THREAT: Do not click any links, open attachments, or input passwords. Quarantine immediately.",
    "Phishing": "CRITICAL THREAT: Do not click any links, open attachments, or input passwords. Quarantine immediately.",
    "Deceptive": "WARNING: High likelihood of phishing or deceptive spoofing. Avoid interacting with this message or link.",
    "Suspicious": "CAUTION: Suspicious indicators detected. Exercise heightened vigilance before proceeding.",
    # the product name of the source text is left out here
    "Safe": "Clean content: No high-risk threats detected by the offline check.",
}
TRIAGE_REASON_CLEAN = (
    "No malicious indicators, known threat patterns, or suspicious redirects detected."
)
TRIAGE_REASON_OTHER = "Suspicious structural characteristics detected."
TRIAGE_WARNING = "Limited offline check - cloud engines were not used"

# ---------------------------------------------------------------- fixed values: extraction, redaction
MAIL_URL = r"(?i)https?://[^\s<>\"']+"
MAIL_URL_TAIL = r"[.,;!)\]}]+$"
TRIAGE_URL = r"(?i)https?://[^\s<>\"{}|\\^`]+"
SCREEN_TLDS = [
    "com", "org", "net", "edu", "gov", "io", "xyz", "top", "cc", "tk", "ml", "ga", "cf", "gq",
    "app", "dev", "me", "info", "biz", "site", "online", "live", "link", "co", "in", "uk", "ru",
    "cn", "de", "jp", "us", "tech", "club", "vip", "shop",
]
SCREEN_PHRASES = [
    "account suspended", "account locked", "account is locked", "account is suspended",
    "verify your account", "verify account", "unauthorized transaction", "unauthorized activity",
    "urgent action required", "security alert", "confirm your identity", "confirm identity",
    "password reset", "claim your reward", "won a prize", "free crypto", "wire transfer",
    "bank account blocked", "unusual activity",
]
REDACT_SECRET = (
    r"(?i)\b(password|passcode|otp|one[- ]time code|verification code|login code|security code"
    r"|auth(?:entication)? code|pin|cvv|cvc|token|api key)\b\s*"
    r"(?:is\s+|[:=]\s*|\s*(?=\d{3,}))[^\s,;]+"
)
REDACT_URL = r"(?i)\b(?:https?://|www\.)[^\s<>]+"
REDACT_EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
REDACT_PHONE = r"(?<!\w)(?:\+?\d[\d ().-]{6,}\d)(?!\w)"
REDACT_TOKEN = r"\b[A-Za-z0-9_+/=-]{32,}\b"
REDACT_DIGITS = r"\b\d{4,8}\b"
UUID_PATTERN = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
)

# Blocks that are not reachable world-wide, and the parts of them that are.
CLOSED_BLOCKS = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/3", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "4000::/2", "8000::/2", "c000::/3",
    "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "ff00::/8",
]
OPEN_BLOCKS = [
    "192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48",
    "2001:20::/28", "2001:30::/28",
]

# ---------------------------------------------------------------- fixed values: seed indicators
# sha256, signature, file type, antivirus name, detection percent, source
SEED_HASHES = [
    ("275a021bbfb6489e54d471899f7db9d1663fc695ec2fe2a2c4538aabf651fd0f", "EICAR-Standard-AV-Test", "com", "Win.Test.EICAR_HDB-1", 100.0, "Standard-Benchmark"),
    ("ed01845f04478418121a9e8048b518f7004f5dd309e5445427370ac1b0f83f1b", "WannaCry.Ransomware", "exe", "Win.Ransomware.Wannacryptor", 98.5, "MalwareBazaar"),
    ("4f76239bc7a61d76fb5a0f6bf3b6ff8fb6f28448e894c770c8041c2c01824987", "Emotet.BankingTrojan", "dll", "Win.Trojan.Emotet", 96.0, "MalwareBazaar"),
    ("2161b96d92582736166e4a2c0bc59a4358a9cc373ea8536bc7390974e5088258", "Locky.Ransomware", "exe", "Win.Ransomware.Locky", 97.2, "MalwareBazaar"),
    ("5c341392fa97c2e08eefb22a07c393bcda0e90c52bb888a7db3cfa78ba8bc4d1", "AgentTesla.Keylogger", "exe", "Win.Spyware.AgentTesla", 94.8, "MalwareBazaar"),
    ("0c04218ebf9ef2bf8e27c9b83b9f485dbbc0d9c445653457a44fbc40d4f2b057", "RedLine.Stealer", "exe", "Win.Trojan.RedLine", 95.0, "MalwareBazaar"),
    ("b56950293d9e4a3b72bf89d3d3a04217f0f62446f7e8a9f074d2cb3788755018", "AsyncRAT", "exe", "Win.Trojan.AsyncRAT", 93.4, "MalwareBazaar"),
    ("0d01d4a0349a7c29eec011d87e076644eb98ef36fb5d8004f981e4b971a93863", "Mirai.Botnet", "elf", "Linux.Trojan.Mirai", 92.1, "MalwareBazaar"),
    ("b7833e8b7c7b453e16c87cf0cfd17c9d9685a0df8d0d6fefbe60144f2ef4ee48", "Mimikatz.CredentialDump", "exe", "Win.Tool.Mimikatz", 96.5, "MalwareBazaar"),
]
SEED_DOMAINS = [
    "google.com", "accounts.google.com", "mail.google.com", "youtube.com", "microsoft.com",
    "login.microsoftonline.com", "apple.com", "appleid.apple.com", "github.com", "amazon.com",
    "wikipedia.org", "cloudflare.com", "twitter.com", "x.com", "linkedin.com", "netflix.com",
    "paypal.com", "chase.com", "bankofamerica.com", "wellsfargo.com", "dropbox.com", "yahoo.com",
    "bing.com", "duckduckgo.com", "reddit.com", "spotify.com", "instagram.com", "whatsapp.com",
    "telegram.org", "adobe.com", "zoom.us", "slack.com", "salesforce.com", "gitlab.com",
    "bitbucket.org", "docker.com", "python.org", "pypi.org",
]

# Literals that occur in any match of the category: at least one entry with all of its
# parts. A cheap test that spares most texts the regular expressions.
TEXT_STEMS = {
    "urgency": [
        ["act", "now"], ["action", "required"], ["urgen"], ["immediate"], ["asap"],
        ["time", "running"], ["24", "hours"],
    ],
    "credential_request": [
        ["password"], ["passcode"], ["log", "in"], ["logging"], ["verif"], ["ssn"],
        ["social", "security"], ["otp"], ["one", "time"],
    ],
    "account_suspension": [
        ["suspen"], ["lock"], ["unauthori", "access"], ["clos", "account"], ["deactivat"],
        ["restrict"],
    ],
    "prize_lottery": [["giveaway"], ["lotter"], ["win"], ["claim", "prize"], ["free", "gift"]],
    "unusual_payment": [
        ["gift", "card"], ["wire", "transfer"], ["western", "union"], ["bitcoin"], ["crypto"],
        ["usdt"], ["apple", "pay"], ["cash", "app"],
    ],
}
