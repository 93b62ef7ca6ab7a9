"""Small rows of the feeds' shapes, for queries whose vocabulary the test tables lack."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

#: vendor, brand, name, number, notes, date, tags, security, is_cve
RELEASES = [
    ("linux", "torvalds", "linux kernel", "6.9.1", "security patch for the scheduler", "20260410", "linux kernel security", 1, 0),
    ("linux", "torvalds", "linux kernel", "6.8.9", "bug fixes resolved", "20260301", "linux kernel bug", 0, 0),
    ("linux", "openCryptoki", "openCryptoki", "3.2", "token library update", "20260409", "linux crypto", 0, 0),
    ("linux", "linux", "linux-firmware", "2026.1", "new firmware", "20260211", "linux firmware", 0, 0),
    ("linux", "nvd", "CVE-2026-1001", "1", "vulnerability in linux patch handling", "20260412", "linux cve", 1, 1),
    ("python", "python", "python", "3.13.2", "bug fix release of cpython", "20260405", "python release", 0, 0),
    ("python", "pypi", "pip", "26.0", "upgrade notes", "20260329", "python pip", 0, 0),
    ("chrome", "google", "chrome", "140.1", "critical security update of the browser", "20260411", "chrome browser security", 1, 0),
    ("grafana", "grafana", "grafana", "12.0", "dashboard release with metrics", "20260330", "grafana monitoring", 0, 0),
    ("ios", "apple", "ios", "26.4", "update of the community app", "20260320", "ios apple", 0, 0),
    ("windows", "microsoft", "windows", "11.25", "security patch and update", "20260407", "windows microsoft security", 1, 0),
    ("ansible", "ansible", "ansible", "12.1", "automation release changelog", "20260318", "ansible devops", 0, 0),
]
#: post_id, title, subreddit, score, positive, created, num_comments, description, comment, comment_score, sentiment, divergence
POSTS = [
    ("p1", "Linux kernel update broke my desktop", "linux", 45, 0.2, "2026-04-10T08:00:00", 12, "desktop does not load after the update", "wait for the next kernel", 31, "Negative", 0.61),
    ("p2", "Is the new python release stable?", "Python", 8, 0.8, "2026-04-09T10:00:00", 3, "asking about 3.13", "works well here", 9, "Positive", 0.22),
    ("p3", "Chrome crash fix in the latest version", "chrome", 21, 0.6, "2026-04-11T12:00:00", 7, "the crash is fixed", "confirmed fixed", 14, "Positive", 0.35),
    ("p4", "ubuntu security patch today", "Ubuntu", 3, 0.4, "2026-04-12T09:30:00", 1, "patch is out", "", 0, "Neutral", 0.10),
    ("p5", "Ollama model connection broken?", "ollama", 17, 0.1, "2026-04-08T07:15:00", 22, "model does not answer", "restart the server", 55, "Negative", 0.72),
    ("p6", "GGUF nodes in comfyui", "comfyui", 11, 0.7, "2026-04-05T16:20:00", 5, "install nodes", "run the installer", 12, "Positive", 0.31),
    ("p7", "windows update community reaction", "windows", 5, 0.3, "2026-04-07T20:00:00", 9, "users are not amused", "rolled back", 7, "Negative", 0.44),
    ("p8", "fedora upgrade error", "Fedora", 2, 0.5, "2026-03-30T11:00:00", 0, "error while upgrading", "", 0, "Negative", 0.05),
    ("p9", "macos feedback thread", "MacOS", 30, 0.9, "2026-04-02T13:00:00", 40, "feedback of users", "nice release", 18, "Positive", 0.53),
    ("p10", "how to search linux logs", "linuxquestions", 6, 0.6, "2026-04-06T18:45:00", 2, "journal of the kernel", "use the journal", 4, "Neutral", 0.12),
]
#: title, url, created, description, score
CVES = [
    ("CVE-2026-1001 in linux", "https://nvd.example.org/vuln/CVE-2026-1001", "2026-04-12T00:00:00", "A vulnerability in the linux kernel allows an exploit of the scheduler. " * 4, 9),
    ("CVE-2026-0950 in python", "https://nvd.example.org/vuln/CVE-2026-0950", "2026-04-01T00:00:00", "pip resolves a path that it should not.", 5),
    ("linux driver advisory", "https://adv.example.org/77", "2026-03-11T00:00:00", "Advisory without an identifier.", 3),
    ("CVE-2025-9999 in linux tools", "https://nvd.example.org/vuln/CVE-2025-9999", "2025-12-11T00:00:00", "Old entry.", 2),
    ("CVE-2026-0100 in linux modules", "https://nvd.example.org/vuln/CVE-2026-0100", "2026-01-15T00:00:00", "Module entry.", 1),
    ("CVE-2026-2000 in chrome", "https://nvd.example.org/vuln/CVE-2026-2000", "2026-04-11T00:00:00", "Browser entry of the linux build.", 8),
]
#: vendor, product, name, description, cve, added, action
KEV = [
    ("Linux", "Kernel", "Linux Kernel Use After Free", "The kernel contains a security vulnerability", "CVE-2026-1001", "2026-04-12", "Apply the patch"),
    ("Google", "Chrome", "Chrome Type Confusion", "A critical browser vulnerability", "CVE-2026-2000", "2026-04-11", "Update the browser"),
    ("Microsoft", "Windows", "Windows Privilege Escalation", "A windows security patch is needed", "CVE-2026-0777", "2026-02-01", "Apply the update"),
    ("Python", "pip", "pip Path Traversal", "The latest python version is affected", "CVE-2026-0950", "2026-04-02", "Upgrade pip"),
]
#: title, link, published, source
NEWS = [
    ("Critical kernel flaw under attack", "https://news.example.com/1", "Sun, 12 Apr 2026 08:00:00 GMT", "Daily"),
    ("Python turns thirty-five", "https://news.example.com/2", "Sat, 11 Apr 2026 09:00:00 GMT", "Weekly"),
    ("Browser breach reported", "https://news.example.com/3", "Fri, 10 Apr 2026 10:00:00 GMT", "Daily"),
    ("macOS 26 released", "https://news.example.com/4", "Thu, 09 Apr 2026 11:00:00 GMT", "Apple News"),
    ("iPad security patch", "https://news.example.com/5", "Wed, 08 Apr 2026 12:00:00 GMT", "Apple News"),
    ("Garden show opens", "https://news.example.com/6", "Tue, 07 Apr 2026 13:00:00 GMT", "Local"),
]
#: title, link, updated, summary
ATOM = [
    ("CVE-2026-3001", "https://feed.example.org/CVE-2026-3001", "2026-04-12T01:02:03Z", "python parser vulnerability"),
    ("CVE-2026-3002", "https://feed.example.org/CVE-2026-3002", "2026-04-11T01:02:03Z", "windows service security"),
    ("CVE-2026-3003", "https://feed.example.org/CVE-2026-3003", "2026-04-10T01:02:03Z", "printer driver"),
]
#: owner, name, updated, release, published
REPOSITORIES = [
    ("torvalds", "linux", "2026-04-12", "v6.9.1", "2026-04-10"), ("friends", "linux-tools", "2026-04-11", "v2.0", "2026-03-01"), ("others", "linux-old", "2025-01-01", "v0.1", "2024-01-01"),
    ("python", "python-docs", "2026-04-10", "v3.13", "2026-04-05"), ("grafana", "grafana", "2026-04-09", "v12.0", "2026-03-30"), ("ansible", "ansible", "2026-04-08", "v12.1", "2026-03-18"),
]
#: id, query, question, title, category, ground_truth, gt
QUESTION_RECORDS = [
    ("1", "what broke", None, None, "bugs", "the kernel", None), ("2", None, " is it stable? ", None, None, "  ", "yes"), ("3", None, None, "latest version", "releases", None, None),
    ("4", " ", None, None, "general", None, "x"), ("5", None, None, None, "bugs", "y", None),
]
#: page, title
PAGES = [(1, "Is linux stable?"), (1, "Chrome crash after update?"), (2, "Which python version?"), (2, "Is linux stable?"), (2, "Opinions on macos")]
#: verdicts of a manual review, as recorded
VERDICTS = ["CORRECT"] * 16 + ["NOT FOUND"] * 3 + ["HALLUCINATION"]
#: id, raw reply, has a reference answer
REPLIES = [
    (1, '```json\n{"relevance": 2}\n```', 1), (2, '{"relevance": 7}', 0), (3, "no braces here", 1), (4, '{"relevance": -1}', 1), (5, '{"relevance": 1.4}', 1), (6, '{"relevance": "high"}', 0), (7, 'I say {"relevance": 1} twice', 0),
    (8, '{"faithfulness": 0.8, "answer_relevance": 1.7, "correctness": 0.5}', 1), (9, '{"faithfulness": -3, "answer_relevance": 0.25, "correctness": 0.5}', 0), (10, '{"faithfulness": "x", "correctness": null}', 1),
]
#: task, attempt, agent, score, output
AGENT_RUNS = [
    (1, 1, "ResearchAgent", 4.0, "first"), (1, 2, "ResearchAgent", 7.5, "second"), (1, 3, "ResearchAgent", 9.0, "third"), (2, 1, "CodingAgent", 6.0, "done"), (3, 1, "CrewAgent", 2.0, "a"), (3, 2, "CrewAgent", 3.0, "b"),
    (3, 3, "CrewAgent", 5.0, "c"), (3, 4, "CrewAgent", 9.0, "never run"), (3, 1, "BrowserAgent", 8.0, "x" * 500),
]
#: id, kind, payload
REQUESTS = [
    (1, "sensor", '{"room_id": "room-101", "light_state": "ON", "lux": 450, "timestamp": "2026-03-27T10:00:00Z"}'), (2, "sensor", '{"room_id": "room-101", "light_state": "DIM", "lux": 1, "timestamp": "t"}'),
    (3, "sensor", '{"light_state": "ON", "lux": 1, "timestamp": "t"}'), (4, "sensor", '{"room_id": "r", "light_state": "ON", "timestamp": "t"}'), (5, "room", '{"room": "kitchen", "date": "2026-03-27", "onSeconds": 14400}'),
    (6, "room", '{"room": "attic", "date": "2026-03-27", "onSeconds": 1}'), (7, "room", '{"room": "office", "date": "2026-03-27"}'), (8, "user", '{"email": "a@b.c", "password": "long enough"}'), (9, "user", '{"email": "a.b.c", "password": "long enough"}'),
    (10, "user", '{"email": "a@b.c", "password": "short"}'), (11, "user", '{"email": "a@b.c"}'),
]
#: systems' latencies: system, query, seconds
LATENCIES = [("full", 1, 13.5), ("full", 2, 14.25), ("single", 1, 12.0), ("single", 2, 12.5), ("single", 3, None), ("raw", 1, 2.25)]
#: specifications of model providers
SPECS = ["ollama:llama3.1", "openai:gpt-x", "llama3.1", "unknown:thing:1", "anthropic:m", ":x", "mock"]
#: names of backends; a specification without one of them is a model of the first
BACKENDS = ["ollama", "openai", "anthropic", "mock"]


def inline(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def text(spark: SparkSession, *values: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "value string")


def releases_json() -> str:
    out: dict[str, list] = {}
    for k, (vendor, brand, name, number, notes, day, tags, secure, cve) in enumerate(RELEASES):
        kind = {"securityType": ["SECURITY"] if secure else []}
        listed = notes.split(" ", 1) if k % 2 else notes  # notes are a text or a list of texts
        out.setdefault(vendor, []).append(
            {"versionSearchTags": tags.split(), "versionProductName": name, "versionProductBrand": brand, "versionNumber": number, "versionReleaseNotes": listed, "versionReleaseDate": day, "isCve": bool(cve), "classification": kind, "versionUrl": f"https://r.example.com/{name}/{number}"}
        )
    return json.dumps(out)


def posts_json() -> str:
    rows = []
    for post_id, title, sub, score, positive, created, n, body, comment, votes, _, _ in POSTS:
        comments = [{"id": f"{post_id}c", "body": comment, "score": votes, "author": "u"}, {"id": "d", "body": "[deleted]", "score": 99, "author": "v"}]
        rows.append({"title": title, "subreddit": sub, "url": f"https://p.example.com/{post_id}", "score": score, "created_utc": created, "num_comments": n, "author_description": body, "comments": comments, "metadata": {"predicted": {"positiveScore": positive}}})
    return json.dumps({"data": rows})


def analyzed_json() -> str:
    rows = [{"post_id": p[0], "title": p[1], "subreddit": p[2], "score": p[3], "num_comments": p[6], "title_sentiment": {"label": p[10].lower()}, "metrics": {"sentiment_divergence": p[11]}} for p in POSTS]
    return json.dumps({"all_analyzed_posts": rows})


def kev_json() -> str:
    names = ("vendorProject", "product", "vulnerabilityName", "shortDescription", "cveID", "dateAdded", "requiredAction")
    return json.dumps({"vulnerabilities": [dict(zip(names, r)) for r in KEV]})


def rss() -> str:
    items = "".join(f"<item><title>{t}</title><link>{u}</link><pubDate>{p}</pubDate><source>{s}</source></item>" for t, u, p, s in NEWS)
    return f"<rss><channel><title>feed</title>{items}</channel></rss>"


def atom() -> str:
    entries = "".join(f'<entry><title>{t}</title><link href="{u}"/><updated>{d}</updated><summary>{s}</summary></entry>' for t, u, d, s in ATOM)
    return f"<feed>{entries}</feed>"
