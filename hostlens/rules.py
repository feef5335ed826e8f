"""Rule data: pattern lists, port labels, tag keywords, severities.

Everything in the FIXED VALUES block below must equal the values of the
artifact toolkit whose results this engine reproduces; they decide which rows
match a rule.  They are plain data, kept in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference behaviour exactly)
# ---------------------------------------------------------------------------

# Artifact categoriser: lower-cased path substrings, first matching category wins.
BODYFILE_PATH_MARKERS = ["bodyfile.txt", "bodyfile.yaml"]
LIVE_RESPONSE_PATH_MARKERS = [
    "live_response/", "/live_response",
    "process/", "/process",
    "network/", "/network",
    "system/", "/system",
    "user/", "/user",
    "hardware/", "/hardware",
    "software/", "/software",
    "disk/", "/disk",
    "memory/", "/memory",
    "storage/", "/storage",
    "containers/", "/containers",
    "vms/", "/vms",
    "packages/", "/packages",
]
HASH_PATH_MARKERS = [
    "hash_executables/", "hash_running_processes/",
    "_hash.txt", ".md5", ".sha1", ".sha256",
    "/hash/", "hashes/",
    "hash_executables.yaml", "hash_running_processes.yaml",
]
LOG_PATH_MARKERS = [
    "/var/log/", "/var/adm/",
    "logs/", "/logs",
    "files/logs/",
    ".log", "_log",
    "syslog", "messages", "auth", "secure", "audit",
    "dmesg", "journal",
    "var_log.yaml", "var_adm.yaml", "journal.yaml",
    "apache.yaml", "nginx.yaml", "tomcat.yaml",
]
# YAML under files/ that is not matched above: log-like words send it to logs.
FILES_YAML_LOG_WORDS = ["log", "journal", "syslog", "messages", "auth", "secure"]
CONFIG_PATH_MARKERS = [
    "/etc/", "config/", "/config",
    ".conf", ".cfg", ".yaml", ".yml", ".ini",
    "crontab", "sudoers", "passwd", "shadow", "group",
    "files/system/etc.yaml",
]

# Log files with these suffixes are never opened as text.
BINARY_LOG_SUFFIXES = [".gz", ".bz2", ".xz", ".db", ".sqlite"]

# Detector rule values.
PROCESS_TEMP_DIRS = ["/tmp/", "/var/tmp/", "/dev/shm/", "/dev/mqueue/"]
SUSPICIOUS_TOOL_NAMES = [
    "nc", "ncat", "netcat", "socat",
    "meterpreter", "beacon", "cobalt",
    "mimikatz", "lazagne", "linpeas",
]
ENCODED_COMMAND_MARKERS = ["base64", "| bash", "| sh", "eval ", "exec("]
SUSPICIOUS_PORTS = {
    4444: "Metasploit default",
    5555: "Common backdoor",
    6666: "IRC/Backdoor",
    6667: "IRC",
    8080: "Alternative HTTP",
    31337: "Elite/Backdoor",
}
SYSTEM_SETUID_ALLOWLIST = [
    "/usr/bin/sudo", "/usr/bin/passwd", "/usr/bin/su",
    "/usr/bin/ping", "/usr/bin/mount", "/usr/bin/umount",
]
FILE_TEMP_DIRS = ["/tmp/", "/var/tmp/", "/dev/shm/"]
HIDDEN_PATH_MARKER = "/."
HIDDEN_PATH_EXCLUDES = [".git", ".ssh", ".config", ".local", ".cache"]
SUSPICIOUS_LOCATION_MARKERS = ["/tmp/", "/var/tmp/", "/dev/shm/", "/."]

# Security tags: tag -> lower-case substrings, in dictionary order.
SECURITY_TAGS = {
    "lateral_movement": ["ssh", "rdp", "psexec", "wmic", "winrm", "smbexec"],
    "persistence": ["cron", "systemd", "rc.local", "init.d", "bashrc", "profile"],
    "privilege_escalation": ["sudo", "su ", "setuid", "setgid", "capabilities"],
    "credential_access": ["passwd", "shadow", "mimikatz", "keylog", "dump"],
    "defense_evasion": ["hidden", "deleted", "rootkit", "ld_preload", "ptrace"],
    "exfiltration": ["curl", "wget", "nc ", "netcat", "base64", "encode"],
    "execution": ["bash", "python", "perl", "php", "ruby", "node"],
    "discovery": ["whoami", "id ", "uname", "ifconfig", "netstat", "ps "],
}

# Severity order, lowest first.
SEVERITY_ORDER = ["info", "low", "medium", "high", "critical"]
SEVERITY_MARK = {
    "critical": "🔴",
    "high": "🟠",
    "medium": "🟡",
    "low": "🟢",
    "info": "🔵",
}

# Chunking and retrieval defaults.
CHUNK_SIZE = 1500
CHUNK_OVERLAP = 200
CONTEXT_TOKEN_BUDGET = 4000
SUMMARY_TOKEN_BUDGET = 3000
CHARS_PER_TOKEN = 4
HITS_PER_QUERY = 5
HITS_FOR_CONTEXT = 10

# Detector output texts.  ``{name}`` fields are filled from row columns.
DETECTOR_TEXT = {
    "proc_suspicious_path": {
        "id": "proc_{pid}_suspicious_path",
        "title": "Process running from suspicious location",
        "description": "Process PID {pid} is running from a temporary or suspicious directory",
        "evidence": "PID: {pid}, User: {user}, Command: {command}",
        "explanation": "Programs are seldom installed where everyone may write",
        "steps": ["Look at the binary: ls -la {first_token}", "Look at parents and children: pstree -p {pid}",
                  "Look at what it has open: lsof -p {pid}"],
    },
    "proc_known_suspicious": {
        "id": "proc_{pid}_known_suspicious",
        "title": "Known suspicious tool detected: {exe}",
        "description": "Process {exe} is commonly used in attacks",
    },
    "proc_encoded_cmd": {
        "id": "proc_{pid}_encoded_cmd",
        "title": "Process with potential encoded/obfuscated command",
        "description": "Command line contains encoding or shell execution patterns",
        "explanation": "Encoded arguments hide what a command does",
    },
    "net_port": {
        "id": "net_{local_port}_{remote_port}",
        "title": "Connection to suspicious port {remote_port}",
        "description": "Connection to port {remote_port} ({label})",
        "evidence": "{protocol} {local_address}:{local_port} -> {remote_address}:{remote_port}",
    },
    "net_listen": {
        "id": "net_listen_{local_port}",
        "title": "Suspicious service listening on port {local_port}",
        "description": "Service listening on known malicious port",
    },
    "fs_suid": {
        "id": "fs_suid_{inode}",
        "title": "Non-standard SUID binary: {filename}",
        "description": "SUID binary found at unexpected location: {name}",
        "evidence": "Mode: {mode}, Size: {size}, Owner: {uid}",
        "steps": ["Look at the file: ls -la {name}", "Find out its type: file {name}", "Read its texts: strings {name} | head -50"],
    },
    "fs_tmpexec": {
        "id": "fs_tmpexec_{inode}",
        "title": "Executable in temporary directory",
        "description": "Executable found in world-writable directory",
    },
    "fs_hidden": {
        "id": "fs_hidden_{inode}",
        "title": "Hidden executable: {filename}",
        "description": "Hidden executable file found at {name}",
    },
    "user_system_shell": {
        "id": "user_{username}_system_shell",
        "title": "System account with login shell: {username}",
        "description": "System user {username} (UID {uid}) has a valid login shell",
    },
    "user_uid0": {
        "id": "user_{username}_uid0",
        "title": "Non-root user with UID 0: {username}",
        "description": "User {username} has UID 0, equivalent to root privileges",
    },
}

# Which log lines parse, and into what: syslog lines (time, host, process, pid, message) and lines that
# begin with an ISO time.
SYSLOG_PATTERN = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?\s*:\s*(.*)$"
ISO_PATTERN = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\s+(.*)$"

# Text formats of chunks and reports (headings, section titles, footers).
FORMATS = {
    "bodyfile_header": "# Bodyfile Analysis: {title}\n",
    "bodyfile_titles": {"executables": "Executables", "setuid": "Setuid",
                        "suspicious_locations": "Suspicious_Locations"},
    "process_header": "# Running Processes: {title}\n\n",
    "process_titles": {"all": "All", "root": "Root", "high_cpu": "High Cpu", "high_mem": "High Mem"},
    "network_header": "# Network Connections: {title}\n\n",
    "network_titles": {"listening": "Listening", "established": "Established", "all": "All"},
    "users_header": "# User Accounts\n\n## Regular Users\n",
    "users_system_header": "\n## System Users with Valid Shells\n",
    "users_no_shell": "  ⚠️ No valid login shell\n",
    "users_keywords": "\n\nSearch words: users, accounts, logins, passwd",
    "timeline_header": "# Timeline Events: {hour}\n\n",
    "log_header": "# Log File: {source}\n\n",
    "log_unknown_time": "[Unknown Time] ",
    "summary_setuid_title": "\n### SUID/SGID Files (Potential Privilege Escalation)\n",
    "summary_nobin_title": "\n### Processes Without Binary on Disk\n",
    "summary_listen_title": "\n### Listening Services\n",
    "report_header": "# Anomaly Detection Report\n\n",
    "report_sections": {"critical": "## 🔴 Critical Anomalies\n\n", "high": "## 🟠 High Severity Anomalies\n\n",
                        "medium": "## 🟡 Medium Severity Anomalies\n\n"},
    "context_header": "--- Source: {source} ({artifact_type}) [relevance: {score}] ---\n",
}

# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------

# Follow-up suggestions, in our own words, keyed by words of the question (first group that matches).
FOLLOWUP_SUGGESTIONS = [
    (["ssh"], [
        "Which SSH logins failed, from where and for whom?",
        "Whose keys may log in, and since when?",
        "Does the SSH server's configuration differ from the default?",
    ]),
    (["process", "pid"], [
        "Which sockets does this process hold?",
        "Which process started it, and what did it start itself?",
        "Which files changed while it ran?",
    ]),
    (["network", "connection"], [
        "Which programs talk to addresses outside?",
        "Which services wait for connections?",
        "Do any of the remote addresses appear in the indicators?",
    ]),
]
FOLLOWUP_DEFAULT = [
    "Which findings have the highest severity?",
    "Which files changed last?",
    "What would start again after a reboot?",
]

# Rows of one text block; a longer group makes several blocks.
SEGMENT_ROWS = 1000


def severity_rank(severity: str) -> int:
    return SEVERITY_ORDER.index(severity)


def categorizer_rules() -> list[tuple[str, list[str]]]:
    """Ordered (category, markers) list used by the path categoriser."""
    return [
        ("bodyfile", BODYFILE_PATH_MARKERS),
        ("live_response", LIVE_RESPONSE_PATH_MARKERS),
        ("hash", HASH_PATH_MARKERS),
        ("logs", LOG_PATH_MARKERS),
    ]
