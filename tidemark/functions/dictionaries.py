"""Dictionaries of the retrieval domain. All are defaults of parameters."""

from __future__ import annotations

# Fixed values.
SYNONYMS = {
    "linux": ["linux", "ubuntu", "debian", "kernel", "fedora", "redhat"],
    "security": ["security", "vulnerability", "cve", "patch", "exploit", "advisory"],
    "bug": ["bug", "defect", "issue", "error", "crash", "regression"],
    "fix": ["fix", "patch", "resolve", "resolved", "hotfix", "bugfix"],
    "update": ["update", "upgrade", "release", "version", "changelog"],
    "critical": ["critical", "severe", "high", "urgent", "important", "major"],
    "python": ["python", "pip", "pypi", "cpython"],
    "chrome": ["chrome", "chromium", "browser", "google"],
    "windows": ["windows", "microsoft", "win11", "win10"],
    "macos": ["macos", "mac", "apple", "osx"],
    "community": ["community", "reddit", "users", "developers", "feedback"],
    "reaction": ["reaction", "response", "feedback", "opinion", "sentiment"],
    "release": ["release", "version", "changelog", "notes", "published"],
    "cve": ["cve", "vulnerability", "exploit", "advisory", "nvd"],
    "nodejs": ["nodejs", "node", "npm", "javascript"],
    "grafana": ["grafana", "monitoring", "dashboard", "metrics"],
    "ansible": ["ansible", "automation", "devops", "playbook"],
    "vscode": ["vscode", "editor", "ide", "microsoft"],
}
#: Order matters: later phrases rewrite earlier replacements.
EXPANSIONS = [
    ("bugs", "bug fixes resolved defects errors"),
    ("latest", "latest version release notes changelog"),
    ("critical", "critical security vulnerability patch"),
    ("update", "software update release changelog"),
    ("security", "security vulnerability CVE patch advisory"),
    ("fix", "bug fix resolved patch hotfix"),
    ("today", "latest recent published today"),
    ("feel", "sentiment feedback reaction community opinion"),
    ("reaction", "community sentiment feedback opinion"),
    ("negative", "negative community reaction complaint"),
    ("notes", "release notes changelog version update"),
    ("new", "new release version update changelog"),
    ("patch", "patch security fix hotfix update"),
]
SHORT_EXPANSIONS = [
    ("latest update", "software update changelog bug fixes features"),
    ("latest ver", "latest version release notes changelog"),
    ("bugs", "bug fixes defects resolved issues"),
    ("fixes", "bug fixes patches resolved defects"),
    ("slow", "performance regression slowdown latency"),
    ("crash", "crash memory error failure"),
    ("security", "security vulnerability CVE patch"),
    ("negative", "negative sentiment community reaction complaints"),
    ("feel", "sentiment opinion community reaction"),
]
GENERIC_SUFFIX = " software update changelog"
QUESTIONS = [
    (1, "Any critical Linux security patches today", "security", ["linux", "security", "patch", "vulnerability", "kernel"]),
    (2, "CVE vulnerabilities in Python latest version", "security", ["python", "cve", "vulnerability", "security", "patch"]),
    (3, "Critical security updates published today", "security", ["security", "critical", "update", "patch", "vulnerability"]),
    (4, "Windows security patch this week", "security", ["windows", "security", "patch", "microsoft", "update"]),
    (5, "Any new CVE for nodejs", "security", ["nodejs", "cve", "vulnerability", "security", "npm"]),
    (6, "What bugs were fixed in the latest Python update", "bugs", ["python", "bug", "fix", "update", "resolved", "defect"]),
    (7, "Chrome browser crash fix latest version", "bugs", ["chrome", "crash", "fix", "bug", "browser"]),
    (8, "VSCode debugger bug fixed", "bugs", ["vscode", "debugger", "bug", "fix", "resolved"]),
    (9, "Latest Grafana release notes", "releases", ["grafana", "release", "notes", "version", "monitoring"]),
    (10, "Ansible new version what changed", "releases", ["ansible", "version", "release", "changelog", "update"]),
    (11, "Python 3.13 release notes", "releases", ["python", "release", "notes", "version", "changelog"]),
    (12, "How do users feel about latest MacOS update", "community", ["macos", "update", "users", "community", "reaction"]),
    (13, "Community reaction to Windows 11 update", "community", ["windows", "update", "community", "reaction", "feedback"]),
    (14, "Which software releases got negative feedback", "community", ["software", "release", "negative", "feedback", "community"]),
    (15, "Any critical software updates today", "general", ["software", "update", "critical", "release", "security"]),
]
#: First match wins.
CATEGORIES = [
    ("security", ["cve", "vulnerability", "security", "patch", "exploit", "hack"]),
    ("bugs", ["bug", "crash", "broken", "error", "fix", "issue", "not working"]),
    ("releases", ["release", "version", "changelog", "update", "upgrade"]),
    ("community", ["community", "opinion", "feel", "think", "anyone", "users"]),
]
QUERY_TYPES = [
    ("version", ["latest version", "what version", "current version", "which version", "version of"]),
    ("bug", ["broken", "crash", "fail", "issue", "unstable", "doesnt load", "not working", "error", "bug", "freeze", "slow", "dead", "missing", "disappeared"]),
    ("opinion", ["done", "money pit", "frustrated", "sick of", "tired of", "switched", "gave up", "moved on", "worth it", "recommend", "should i", "is it good", "how rough", "thoughts on", "opinion", "experience with"]),
]
AGENTS = [
    ("CodingAgent", ["code", "function", "bug", "implement", "python"]),
    ("CustomerSupportAgent", ["order", "refund", "support", "ticket"]),
    ("WorkflowAgent", ["automate", "workflow", "trigger", "zapier"]),
    ("BrowserAgent", ["browse", "website", "navigate", "scrape"]),
    ("CrewAgent", ["analyze", "team", "complex", "multiple"]),
]
SUBREDDITS = [
    (["ios", "iphone", "ipad", "siri", "apple", "macos"], ["applehelp", "ios", "apple"]),
    (["linux", "ubuntu", "fedora", "debian", "grub", "kernel"], ["linuxquestions", "linux", "Ubuntu"]),
    (["chrome", "firefox", "edge", "browser"], ["chrome", "firefox", "MicrosoftEdge"]),
    (["windows", "microsoft", "win11"], ["windows", "techsupport", "sysadmin"]),
]
OTHER_SUBREDDITS = ["techsupport", "sysadmin", "software"]
SECURITY_WORDS = ["cve", "vulnerability", "exploit", "security", "patch", "advisory", "malware", "virus", "breach", "attack", "threat", "zero-day"]
DEFECT_WORDS = ["fix", "bug", "error", "issue", "broken", "crash", "fail", "defect", "problem"]
USABILITY_WORDS = ["update", "new", "release", "feature", "improve", "upgrade", "version", "launch"]
# Words of a topical title.
TOPIC_WORDS = ["update", "version", "broken", "fix", "install", "upgrade", "crash", "not working", "after update", "latest", "error", "bug", "fail", "issue", "stopped", "missing", "slow"]
TIER1 = ["vendor_releases", "releases", "apple_rss", "cisa_kev", "circl_cve", "nvd", "cve"]
TIER2 = ["vendor_reddit", "reddit_live", "reddit_search", "google_news", "github"]
FEEDS = ["apple_rss", "cisa_kev", "circl_cve"]
PHRASE_VENDORS = [
    ("g6 bullet", "Ubiquiti"), ("home assistant", "homeassistant"), ("home-assistant", "homeassistant"), ("hassio", "homeassistant"), ("microsoft edge", "MicrosoftEdge"),
    ("ace step", "comfyui"), ("ace-step", "comfyui"), ("comfy ui", "comfyui"), ("comfyui", "comfyui"), ("stable diffusion", "comfyui"), ("gguf", "comfyui"), ("proxmox ve", "Proxmox"),
    ("synology nas", "Synology"), ("synology", "Synology"), ("nas stopped", "Synology"), ("nas unreachable", "Synology"), ("pfsense ce", "pfsense"), ("voip issues", "pfsense"),
    ("money pit", "openclaw"), ("openclaw", "openclaw"), ("open claw", "openclaw"), ("t-mobile", "tmobile"), ("neovim", "neovim"), ("nvim", "neovim"), ("ollama", "ollama"),
]
ALIAS_VENDORS = [
    ("ios", "ios"), ("iphone", "ios"), ("ipad", "ios"), ("siri", "ios"), ("icloud", "ios"), ("apple id", "ios"), ("find my", "ios"),
    ("macos", "macos"), ("mac", "macos"), ("macbook", "macos"), ("tahoe", "macos"),
    ("firefox", "firefox"), ("ff", "firefox"), ("chrome", "chrome"), ("chromium", "chrome"), ("edge", "MicrosoftEdge"), ("microsoft edge", "MicrosoftEdge"),
    ("windows", "windows"), ("win11", "windows"), ("win10", "windows"), ("linux", "linux"), ("ubuntu", "ubuntu"), ("debian", "debian"), ("fedora", "fedora"), ("kernel", "linux"),
    ("android", "android"), ("pixel", "android"), ("orcaslicer", "orcaslicer"), ("tapo", "tapo"), ("truenas", "truenas"), ("aws", "aws"), ("spotify", "spotify"),
    ("tinder", "tinder"), ("otbr", "homeassistant"), ("neovim", "neovim"), ("nvim", "neovim"), ("microsoftedge", "MicrosoftEdge"),
]
SUBREDDIT_VENDORS = [
    ("comfyui", "comfyui"), ("ubiquiti", "Ubiquiti"), ("openclaw", "openclaw"), ("ollama", "ollama"), ("homeassistant", "homeassistant"), ("home assistant", "homeassistant"),
    ("hass", "homeassistant"), ("ha", "homeassistant"), ("hassio", "homeassistant"), ("applehelp", "ios"), ("linuxquestions", "linux"), ("sysadmin", "linux"), ("selfhosted", "linux"),
    ("homelab", "linux"), ("fedora", "linux"), ("linux", "linux"), ("ubuntu", "ubuntu"),
]
#: First one found in the question wins.
RELATIVE_DATES = [
    ("yesterday", 1), ("last night", 1), ("today", 0), ("just now", 0), ("this week", 7), ("last week", 7), ("past week", 7), ("this month", 30), ("last month", 30), ("past month", 30),
    ("recently", 14), ("recent", 14), ("latest", 0), ("just", 7), ("still", 30), ("anymore", 30), ("now", 0), ("currently", 0), ("current", 0), ("after update", 14), ("after the update", 14),
]
MONTHS = [
    ("january", 1), ("jan", 1), ("february", 2), ("feb", 2), ("march", 3), ("mar", 3), ("april", 4), ("apr", 4), ("may", 5), ("june", 6), ("jun", 6), ("july", 7), ("jul", 7),
    ("august", 8), ("aug", 8), ("september", 9), ("sep", 9), ("october", 10), ("oct", 10), ("november", 11), ("nov", 11), ("december", 12), ("dec", 12),
]
# Names of the makers that a vendor stands for.
CANONICAL = {"linux": ["torvalds", "linux kernel"], "ios": ["apple", "ios"], "macos": ["apple", "macos"], "firefox": ["mozilla", "firefox"], "chrome": ["google", "chrome"]}

# Words that never name a vendor by likeness.
VENDOR_STOP_WORDS = """
version text firmware updater arrow maybe server desktop downloads core config plugins software update
latest release new fix bug issue error crash install upgrade support help question problem using
after before when how why what where which can will does did has have been some many most all
any get set run use make take need want know think see look try back first last next same
other good bad big small free open automattic trash dead broken terrible stupid awful great
performance behavior recent patch stable unstable security releases fixed bugs community reaction
feedback negative positive versions offline execute tasks fail fails failing upgrade upgrading upgraded
issues problems task turning turns
""".split()
# Communities and products that hint at a vendor, where nothing in the question names one.
COMMUNITY_HINTS = {
    "microsoftedge": "MicrosoftEdge", "androidquestions": "android", "androiddev": "android", "homenetworking": "linux", "homelab": "linux", "aws": "aws", "neovim": "neovim",
    "linuxquestions": "linux", "sysadmin": "linux", "selfhosted": "linux", "applehelp": "ios", "homeassistant": "homeassistant", "home assistant": "homeassistant",
    "hass": "homeassistant", "ha": "homeassistant", "hassio": "homeassistant", "fedora": "fedora", "debian": "debian", "ubuntu": "ubuntu", "chrome": "chrome", "firefox": "firefox",
    "openclaw": "openclaw", "comfyui": "comfyui", "ollama": "ollama", "ollama.ai": "ollama", "ubiquiti": "Ubiquiti", "unifi": "Ubiquiti", "g6": "Ubiquiti", "g6 bullet": "Ubiquiti",
    "bullet": "Ubiquiti", "udr": "Ubiquiti", "udm": "Ubiquiti", "uap": "Ubiquiti", "edgerouter": "Ubiquiti", "proxmox": "Proxmox", "pfsense": "pfsense", "synology": "Synology",
    "truenas": "TrueNAS", "opnsense": "OPNsense", "nginx": "nginx", "apache": "apache", "docker": "docker", "comfy": "comfyui", "gguf": "comfyui", "ace-step": "comfyui",
    "acestep": "comfyui", "queue": "comfyui", "wan2": "comfyui", "flux": "comfyui", "ace step": "comfyui", "wan 2": "comfyui", "nvidia": "nvidia", "nvidia drivers": "nvidia",
    "zigbee": "homeassistant", "z2m": "homeassistant", "vscode": "vscode", "vs code": "vscode", "wordpress": "Wordpress", "wp": "Wordpress", "git": "git", "github": "github", "python": "python",
}
# The communities of a vendor; any other vendor has one of its own name.
VENDOR_COMMUNITIES = {
    "linux": ["linux", "linuxquestions", "Fedora", "Ubuntu", "debian"], "ollama": ["ollama", "LocalLLaMA", "openclaw"], "comfyui": ["comfyui"], "openclaw": ["openclaw"], "Ubiquiti": ["Ubiquiti"],
    "ios": ["applehelp", "ios", "apple"], "macos": ["MacOS", "applehelp"], "windows": ["windows", "techsupport"], "chrome": ["chrome", "chromium"], "homeassistant": ["homeassistant"],
}
# Rules of the feeds.
NEWS_SUFFIX = " software update security"
NEWS_NEGATIVE = ["vulnerability", "breach", "hack", "exploit", "critical", "attack"]
RSS_PRODUCTS = ["ios", "macos", "iphone", "ipad", "siri", "apple", "security", "watchos"]
RSS_NEGATIVE = ["security", "vulnerability", "fix", "patch"]
SEARCH_NEGATIVE = ["broken", "fix", "issue", "bug", "error", "fail"]
POST_NEGATIVE = ["broken", "fix", "bug", "error", "fail", "crash", "issue", "unstable"]
CODE_HOST_STOP = ["what", "when", "where", "which", "latest", "update", "release", "version", "security", "patch", "bug", "fix"]
DROPPED_CONTEXT = ["exploit", "vulnerability"]
# Replacements where no model answers; "today" becomes the run's date.
DATED_EXPANSIONS = [("bugs", "bug fixes resolved defects"), ("latest", "latest version release notes"), ("critical", "critical security vulnerability patch"), ("update", "software update release changelog")]
RETRY_SUFFIX = " software update release"
# Request rules.
LIGHT_STATES = ["ON", "OFF"]
ROOMS = ["living", "bedroom", "kitchen", "bathroom", "office", "garage"]
LEAST_PASSWORD = 8
