"""The default rule base."""

from __future__ import annotations

# Rule ids, patterns and their order must equal those of existing rule bases, so that feature columns and
# first-match categories agree.  kind: content = equal after stripping quotes, regex = search in an argument's content,
# callee = search in a call's name.
RULES = [
    ("IG-001", "regex", r"^(os|fs|path|crypto)$"),
    ("IG-002", "content", "dns"),
    ("IG-003", "callee", r"os\.(hostname|userInfo|homedir|tmpdir|platform|arch|cpus|networkInterfaces)$"),
    ("IG-004", "callee", r"dns\.(lookup|resolve|getServers|reverse)$"),
    ("IG-005", "callee", r"fs\.(readFile|readdir|stat|access)$"),
    ("IG-006", "regex", r"^(tasklist|ps\s+aux)$"),
    ("IG-007", "regex", r"^(hostname|whoami|pwd|id|uname)$"),
    ("IG-008", "regex", r"^(ls|dir)( -[a-zA-Z]+)?$"),
    ("IG-009", "regex", r"^(/[a-zA-Z0-9_.-]+)+\.(json|conf|cfg|ini)$"),
    ("IG-010", "regex", r"process\.env"),
    ("IG-011", "regex", r"^(env|printenv)$"),
    ("DT-001", "regex", r"^(net|http|https|tls|dgram)$"),
    ("DT-002", "callee", r"\.(connect|request|createConnection)$"),
    ("DT-003", "callee", r"\.(pipe|write|send)$"),
    ("DT-004", "regex", r"https?://[^\s/$.?#].[^\s]*"),
    ("DT-006", "regex", r"(-X\s+POST|--data)"),
    ("DT-007", "regex", r"/(etc|home|root)/[^\s]*"),
    ("DT-008", "regex", r"\.(oast\.(site|fun|live|pro|online|me)|oastify\.com|burpcollaborator\.net|canarytokens\.com|webhook\.site|pipedream\.net|grabify\.link|webhook-test\.com|bxss\.in|xsshunter|xss8\.uk|x1\.pe|ply\.gg|ghostfiles\.eu|filebin\.net|transfer\.sh|xss\.report|mtsrc-test\.|ipv6\.1433\.eu\.org)"),
    ("DT-009", "regex", r"(ifconfig\.me|ipinfo\.io|icanhazip\.com)"),
    ("DT-010", "callee", r"https\.(request|get)$"),
    ("DT-011", "callee", r"http\.(request|get)$"),
    ("DT-012", "callee", r"net\.(connect|createConnection)$"),
    ("DT-013", "regex", r"^((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$"),
    ("IG-013", "callee", r"(localStorage|sessionStorage)\.(getItem|setItem)"),
    ("IG-014", "content", "dotenv"),
    ("DT-014", "regex", r"^(444[0-9]|[5-9][0-9]{3}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])$"),
    ("DT-016", "regex", r"^(nmap|ping|telnet|netstat)$"),
    ("DT-017", "callee", r"(axios|fetch)\.(get|post|put|delete)$"),
    ("DT-018", "regex", r"(googleapis\.com|sheets|spreadsheet|oss-cn-|amazonaws\.com|cloudfront\.net|metadata\.google\.internal|169\.254\.169\.254|169\.254\.169\.253)"),
    ("DT-020", "callee", r"\.(setHeader|headers)$"),
    ("DT-030", "regex", r"(ngrok-free\.app|ngrok\.io|localtunnel\.me|serveo\.net)"),
    ("DT-032", "content", "dgram"),
    ("IG-012", "content", "zlib"),
    ("DE-001", "callee", r"(JSON|Buffer)\."),
    ("DE-002", "regex", r"(base64|hex|utf8|ascii)"),
    ("DE-003", "callee", r"_0x[0-9a-f]{4,6}"),
    ("DE-004", "callee", r"^(atob|btoa)$"),
    ("DE-005", "regex", r"(BEGIN PRIVATE KEY|iam\.gserviceaccount\.com|[A-Za-z0-9]{32,})"),
    ("DE-006", "regex", r"^[A-Za-z0-9+/]{100,}={0,2}$"),
    ("DE-007", "regex", r"_0x[0-9a-f]{4,6}"),
    ("PE-001", "content", "child_process"),
    ("PE-002", "callee", r"(spawn|exec|fork)$"),
    ("PE-003", "regex", r"^(/usr/bin/)?(bash|sh|zsh|cmd|powershell)$"),
    ("PE-004", "regex", r"^(curl|wget|nc|netcat)$"),
    ("PE-005", "regex", r"^chmod$"),
    ("PE-006", "regex", r"^nohup$"),
    ("PE-007", "callee", r"process\.(exit|kill|abort)"),
    ("PE-008", "regex", r"\$\([^)]+\)"),
    ("PE-009", "callee", r"^(eval|Function)$"),
    ("PE-010", "callee", r"document\.(createElement|appendChild)"),
    ("PE-011", "regex", r"powershell.*-e"),
    ("PE-012", "regex", r"pm2\s+(start|delete|restart|list)"),
    ("PE-013", "regex", r"https?://[^\s]*\.(js|bxss\.in)"),
    ("PE-014", "regex", r"https?://[^\s]*\.(exe|bin|sh|bat|msi)$"),
    ("PE-015", "regex", r"^(nslookup|dig|host)$"),
    ("PE-016", "content", "sudo"),
    ("SP-001", "regex", r"/(tmp|temp)/"),
    ("SP-002", "regex", r"-[sS]+(L|l)?\b"),
    ("SP-003", "regex", r"^(777|666|755)$"),
    ("SP-004", "regex", r"(>/dev/null|2>&1)"),
]

# Category names of rule files and their short codes; any other category counts as SP.
CATEGORIES = {
    "INFORMATION_GATHERING": "IG",
    "DATA_TRANSMISSION": "DT",
    "DATA_ENCODING": "DE",
    "PAYLOAD_EXECUTION": "PE",
    "SPECIAL_PATTERNS": "SP",
}
# Fixed value: a key of one rule's pattern that rule files hold and that no match looks at.
UNUSED = {"DE-007": {"ex_content_regex": r"(_0x[0-9a-f]{4,6}|\+|\[)"}}
_NAMES = {v: k for k, v in CATEGORIES.items()}
_FIELDS = {"content": ("ARGUMENT", "content"), "regex": ("ARGUMENT", "content_regex"), "callee": ("CALL", "callee_name_regex")}


def default_rules() -> list[dict]:
    """The rule base as the records of a rule file."""
    out = []
    for rule_id, kind, pattern in RULES:
        node_type, field = _FIELDS[kind]
        out.append({"rule_id": rule_id, "name": rule_id, "category": _NAMES[rule_id[:2]], "pattern": {"node_type": node_type, field: pattern} | UNUSED.get(rule_id, {})})
    return out
