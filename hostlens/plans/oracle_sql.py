"""DuckDB oracle SQL for the registered queries.

Each statement computes the expected result straight from the driver tables:
it does not write and re-parse artifact lines, so it checks the parsers
rather than repeating them.  Fixed rule lists come from ``hostlens.rules``.
"""

from __future__ import annotations

from .. import rules


def q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def vc(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"


def host(key: str) -> str:
    return f"('uac-node' || {vc(f'{key} % 8')})"


def contains_any(col: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(n)})" for n in needles) + ")"


_FIELD = __import__("re").compile(r"\{([A-Za-z_][A-Za-z0-9_]*)\}")


def tmpl(template: str, **exprs: str) -> str:
    """SQL text of a ``{field}`` template from ``rules`` (fields are SQL expressions;
    NULL prints as 'None' like the report texts)."""
    out, pos = [], 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            out.append(q(template[pos:m.start()]))
        out.append(f"coalesce(CAST({exprs[m.group(1)]} AS VARCHAR), 'None')")
        pos = m.end()
    if pos < len(template):
        out.append(q(template[pos:]))
    return "(" + " || ".join(out or ["''"]) + ")"


T = rules.DETECTOR_TEXT
FMT = rules.FORMATS


def case_map(col: str, mapping: dict) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items()) + " END"


def tags_sql(text_col: str) -> str:
    low = f"lower({text_col})"
    parts = [f"CASE WHEN {contains_any(low, words)} THEN {q(tag)} END" for tag, words in rules.SECURITY_TAGS.items()]
    return "concat_ws(',', " + ", ".join(parts) + ")"


# ---------------------------------------------------------------------------
# Logs from events (expected parse)
# ---------------------------------------------------------------------------
LOG_EXPECTED = f"""
SELECT {host('user_id')} AS collection_id,
  CASE event_type WHEN 'error' THEN '/var/log/auth.log' WHEN 'signup' THEN '/var/log/secure'
       WHEN 'click' THEN '/var/log/cron' WHEN 'view' THEN '/var/log/app/access.log'
       ELSE '/var/log/app/orders.log' END AS source_file,
  event_id AS line_no,
  CASE WHEN event_type IN ('error','signup','click') THEN 'syslog'
       WHEN event_type = 'view' AND event_id % 10 = 0 THEN 'unknown' ELSE 'generic' END AS log_type,
  CASE WHEN event_type IN ('error','signup','click','purchase') THEN date_trunc('second', ts)
       WHEN event_id % 10 = 0 THEN NULL ELSE ts END AS ts_parsed,
  CASE WHEN event_type IN ('error','signup','click') THEN 'node' || {vc('user_id')} END AS hostname,
  CASE event_type WHEN 'error' THEN 'sshd' WHEN 'signup' THEN 'sudo' WHEN 'click' THEN 'CRON' END AS process,
  CASE WHEN event_type IN ('error','signup') THEN event_id END AS pid,
  CASE event_type
    WHEN 'error' THEN 'Failed password for user' || {vc('user_id')} || ' from 10.' || {vc('user_id % 256')}
         || '.' || {vc('event_id % 256')} || ' port 22 ssh2'
    WHEN 'signup' THEN 'user' || {vc('user_id')} || ' : TTY=pts/' || {vc('event_id % 5')} || ' ; PWD=/home/user'
         || {vc('user_id')} || ' ; USER=root ; COMMAND=/bin/bash'
    WHEN 'click' THEN '(user' || {vc('user_id')} || ') CMD (/tmp/job' || {vc('event_id % 10')} || '.sh | bash)'
    WHEN 'view' THEN CASE WHEN event_id % 10 = 0 THEN 'kernel audit: type=1400 msg=view' || {vc('event_id')}
         ELSE 'view item=' || {vc('event_id')} || ' user=' || {vc('user_id')} END
    ELSE 'purchase order=' || {vc('event_id')} || ' cents=' || {vc('CAST(round(value * 100) AS BIGINT)')}
  END AS message
FROM events
"""

LOG_PARSE = f"""
SELECT collection_id, source_file, line_no, log_type,
  strftime(ts_parsed, '%Y-%m-%d %H:%M:%S.%f') AS ts_text, hostname, process, pid, message
FROM ({LOG_EXPECTED})
"""

TIMELINE_HOURLY = f"""
WITH ev AS (
  SELECT collection_id, ts_parsed AS t, source_file, line_no, message,
         strftime(ts_parsed, '%Y-%m-%d %H:00') AS hour
  FROM ({LOG_EXPECTED}) WHERE ts_parsed IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY collection_id, hour ORDER BY t, source_file, line_no) AS rn FROM ev
), agg AS (
  SELECT collection_id, hour, (rn - 1) // {rules.SEGMENT_ROWS} AS segment,
    {tmpl(FMT['timeline_header'], hour='hour')} ||
    string_agg('[' || strftime(t, '%H:%M:%S') || '] [log] ' || message
               || chr(10) || '  Source: ' || source_file || chr(10), '' ORDER BY t, source_file, line_no) AS content
  FROM ranked GROUP BY collection_id, hour, segment
), cnt AS (SELECT collection_id, hour, count(*) AS event_count, min(t) AS first_t FROM ev GROUP BY collection_id, hour)
SELECT collection_id, hour, CAST(segment AS INTEGER) AS segment, event_count, strftime(first_t, '%Y-%m-%d %H:%M:%S.%f') AS first_event,
       content, {tags_sql('content')} || CASE WHEN {tags_sql('content')} = '' THEN '' ELSE ',' END || 'timeline' AS tags
FROM agg JOIN cnt USING (collection_id, hour)
"""


def lst(values) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + "]"


# ---------------------------------------------------------------------------
# File metadata from lineitem
# ---------------------------------------------------------------------------
_BODY_DIRS_SQL = ("['/usr/bin/', '/tmp/', '/home/u' || CAST(l_suppkey AS VARCHAR) || '/.cache/', '/var/tmp/', "
                  "'/dev/shm/', '/opt/.hidden/', '/etc/', '/usr/sbin/']")
_SETUID_NAMES = ["/usr/bin/sudo", "/usr/bin/passwd", "/usr/bin/su", "/usr/bin/ping", "/usr/bin/mount", "/usr/bin/umount"]
_BODY_MODES = ["-rwxr-xr-x", "-rw-r--r--", "drwxr-xr-x", "-rwsr-xr-x", "-rw-------", "srwxrwxrwx", "-rwxr-sr-x"]

BODY_EXPECTED = f"""
SELECT {host('l_suppkey')} AS collection_id, ((l_orderkey * 8 + l_linenumber) * 2097152 + l_partkey % 2097152) * 1024 + l_suppkey % 1024 AS line_no,
  CASE WHEN l_linenumber % 4 = 0 THEN '0' ELSE md5({vc('l_orderkey * 10 + l_linenumber')}) END AS md5,
  nm AS name, {vc('l_orderkey * 10 + l_linenumber')} AS inode, md AS mode,
  CAST(CASE WHEN l_orderkey % 97 = 0 THEN 0 ELSE l_suppkey END AS BIGINT) AS uid,
  CAST(l_partkey % 100 AS BIGINT) AS gid,
  CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE round(l_extendedprice) END AS BIGINT) AS size,
  CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE mt + l_linenumber * 3600 END AS BIGINT) AS atime,
  CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE mt END AS BIGINT) AS mtime,
  CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE mt + 60 END AS BIGINT) AS ctime,
  CAST(CASE WHEN l_linenumber = 7 OR l_linenumber % 3 = 0 THEN 0 WHEN l_linenumber % 3 = 1 THEN mt ELSE mt - 86400 END AS BIGINT) AS crtime
FROM (
  SELECT *, CAST(l_shipdate::DATE - DATE '1970-01-01' AS BIGINT) * 86400 + l_orderkey % 86400 AS mt,
    CASE WHEN l_partkey % 97 = 0 THEN list_element({lst(_SETUID_NAMES)}, CAST(l_orderkey % 6 + 1 AS INTEGER))
         ELSE list_element({_BODY_DIRS_SQL}, CAST(l_partkey % 8 + 1 AS INTEGER)) || 'f' || {vc('l_partkey')} || '_' || {vc('l_linenumber')} END AS nm,
    list_element({lst(_BODY_MODES)}, CAST(l_orderkey % 7 + 1 AS INTEGER)) AS md
  FROM lineitem
) WHERE NOT (l_orderkey % 50 = 0 AND l_linenumber = 1)
"""

BODYFILE_PARSE = f"""
SELECT *, contains(mode, 'x') AS is_executable, contains(lower(mode), 's') AS is_setuid,
  starts_with(mode, 'd') AS is_directory,
  regexp_extract(name, '[^/]*$') AS filename, regexp_replace(name, '/[^/]*$', '') AS parent_dir,
  CASE WHEN mtime > 0 THEN strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(mtime), '%Y-%m-%dT%H:%M:%S') END AS mtime_iso
FROM ({BODY_EXPECTED})
"""

BODYFILE_GLOB = f"""
SELECT collection_id, line_no, name FROM ({BODY_EXPECTED})
WHERE regexp_matches(name, '^/home/u.*/\\.cache/f1[^0-4].*_[1-3]$')
"""

BODYFILE_TIME_RANGE = f"""
SELECT collection_id, line_no, name, mtime FROM ({BODY_EXPECTED})
WHERE mtime > 0 AND mtime BETWEEN epoch(TIMESTAMP '1995-01-01 00:00:00') AND epoch(TIMESTAMP '1996-12-31 23:59:59')
"""

BODYFILE_SELECTIONS = f"""
WITH b AS ({BODY_EXPECTED})
SELECT collection_id, 'executables' AS selection, count(*) AS n FROM b
  WHERE contains(mode, 'x') AND NOT starts_with(mode, 'd') GROUP BY 1
UNION ALL SELECT collection_id, 'setuid', count(*) FROM b WHERE contains(lower(mode), 's') GROUP BY 1
UNION ALL SELECT collection_id, 'directories', count(*) FROM b WHERE starts_with(mode, 'd') GROUP BY 1
UNION ALL SELECT collection_id, 'with_hash', count(*) FROM b WHERE md5 NOT IN ('0', '') GROUP BY 1
UNION ALL SELECT collection_id, 'suspicious_locations', count(*) FROM b
  WHERE {contains_any('name', rules.SUSPICIOUS_LOCATION_MARKERS)} GROUP BY 1
"""

# ---------------------------------------------------------------------------
# Processes from events
# ---------------------------------------------------------------------------
PROC_BASE = f"""
SELECT *, user_id % 3 AS k,
  CASE event_type
    WHEN 'view' THEN '/usr/bin/f' || {vc('(event_id % 250) * 8')} || '_' || {vc('event_id % 7 + 1')} || ' --serve'
    WHEN 'error' THEN '/tmp/.x/run' || {vc('user_id')} || '  --once'
    WHEN 'click' THEN '/usr/bin/python3 -c exec(open(''/tmp/p' || {vc('event_id % 10')} || '.py'').read())'
    WHEN 'purchase' THEN 'nc -lvp ' || {vc('event_id % 3 + 4444')}
    ELSE 'bash -c echo ' || substr(md5({vc('event_id')}), 1, 12) || ' | base64 -d | sh' END AS cmd,
  CASE WHEN user_id % 10 = 0 THEN 'root' ELSE 'u' || {vc('user_id')} END AS usr,
  CASE WHEN event_id % 4 = 0 THEN '?' ELSE 'pts/' || {vc('event_id % 4')} END AS tty_,
  strftime(ts, '%H:%M') AS start_, '0:' || lpad({vc('event_id % 60')}, 2, '0') AS time_
FROM events
"""

PROC_EXPECTED = f"""
WITH p AS ({PROC_BASE})
SELECT {host('user_id')} AS collection_id, 'live_response/process/ps_auxwww.txt' AS source_file,
  event_id + 1 AS line_no, event_id AS pid, CAST(NULL AS BIGINT) AS ppid, usr AS user,
  ((event_id % 400) // 10 * 10 + event_id % 10) / 10.0 AS cpu,
  ((user_id % 80) // 10 * 10 + user_id % 10) / 10.0 AS mem,
  CAST((event_id * 37) % 900000 AS BIGINT) AS vsz, CAST((event_id * 11) % 90000 AS BIGINT) AS rss,
  tty_ AS tty, 'Ss' AS stat, start_ AS start, time_ AS time, cmd AS command
FROM p WHERE k = 0 AND event_id % 101 <> 0 AND event_id % 103 <> 0 AND event_id % 107 <> 0
UNION ALL
SELECT {host('user_id')}, 'live_response/process/ps_-ef.txt', event_id + 1, event_id,
  CASE WHEN event_id % 5 = 0 THEN 1 ELSE event_id - 1 END, usr, NULL, NULL, NULL, NULL,
  tty_, NULL, start_, time_, regexp_replace(cmd, ' +', ' ', 'g')
FROM p WHERE k = 1 AND event_id % 103 <> 0
UNION ALL
SELECT {host('user_id')}, 'live_response/process/ps_-o_pid_args.txt', event_id + 1, event_id + 1,
  NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, regexp_replace(cmd, ' +', ' ', 'g')
FROM p WHERE k = 2
"""

PROCESS_PARSE = f"""
SELECT *, regexp_extract(string_split(command, ' ')[1], '[^/]*$') AS executable_name FROM ({PROC_EXPECTED})
"""

# ---------------------------------------------------------------------------
# Connections from lineitem
# ---------------------------------------------------------------------------
_PORTS = "[4444, 5555, 6666, 6667, 8080, 31337]"
CONN_EXPECTED = f"""
SELECT {host('l_suppkey')} AS collection_id, 'live_response/network/netstat_-tunap.txt' AS source_file,
  ((l_orderkey * 8 + l_linenumber) * 2097152 + l_partkey % 2097152) * 1024 + l_suppkey % 1024 AS line_no, proto AS protocol,
  CASE WHEN v6 AND l_orderkey % 5 = 0 THEN '::' WHEN v6 THEN 'fe80::' || {vc('l_suppkey % 100')}
       ELSE '10.' || {vc('l_suppkey % 256')} || '.' || {vc('l_partkey % 256')} || '.' || {vc('l_orderkey % 256')} END AS local_address,
  CAST(lport AS INTEGER) AS local_port,
  CASE WHEN lis AND v6 THEN '::' WHEN lis THEN '0.0.0.0'
       ELSE '172.16.' || {vc('l_partkey % 256')} || '.' || {vc('l_suppkey % 256')} END AS remote_address,
  CAST(CASE WHEN lis THEN 0 ELSE rport END AS INTEGER) AS remote_port,
  CASE WHEN starts_with(proto, 'tcp') THEN st WHEN l_orderkey % 9 = 0 THEN '-' END AS state,
  CAST(CASE WHEN l_orderkey % 9 <> 0 THEN l_orderkey END AS INTEGER) AS pid,
  CASE WHEN l_orderkey % 9 <> 0 THEN 'prog' || {vc('l_suppkey % 20')} END AS program
FROM (
  SELECT *, ends_with(proto, '6') AS v6, (NOT starts_with(proto, 'tcp') OR st = 'LISTEN') AS lis
  FROM (
    SELECT *, list_element(['tcp', 'tcp6', 'udp', 'udp6', 'unix', 'tcp'], CAST(l_linenumber % 6 + 1 AS INTEGER)) AS proto,
      CASE WHEN l_partkey % 13 = 0 THEN list_element({_PORTS}, CAST(l_orderkey % 6 + 1 AS INTEGER))
           ELSE (l_orderkey * 7 + l_partkey) % 65536 END AS lport,
      CASE WHEN l_partkey % 11 = 0 THEN list_element({_PORTS}, CAST(l_suppkey % 6 + 1 AS INTEGER))
           ELSE (l_orderkey + l_partkey * 3) % 65536 END AS rport,
      list_element(['LISTEN', 'ESTABLISHED', 'TIME_WAIT', 'CLOSE_WAIT'], CAST(l_orderkey % 4 + 1 AS INTEGER)) AS st
    FROM lineitem))
WHERE proto <> 'unix'
"""

NETSTAT_PARSE = CONN_EXPECTED

# ---------------------------------------------------------------------------
# Users from customer
# ---------------------------------------------------------------------------
USER_EXPECTED = f"""
SELECT {host('c_custkey')} AS collection_id, 'live_response/user/etc_passwd.txt' AS source_file,
  c_custkey AS line_no,
  CASE WHEN c_custkey = 0 THEN 'root' ELSE 'cust' || {vc('c_custkey')} END AS username,
  CAST(CASE WHEN c_custkey % 43 = 0 OR c_custkey % 500 = 7 THEN 0 ELSE c_custkey % 2000 END AS BIGINT) AS uid,
  CAST(c_nationkey AS BIGINT) AS gid, c_mktsegment AS gecos, '/home/cust' || {vc('c_custkey')} AS home,
  list_element(['/bin/bash', '/usr/sbin/nologin', '/bin/false', '/bin/sh', '/bin/zsh'], CAST(c_nationkey % 5 + 1 AS INTEGER)) AS shell,
  CASE WHEN c_custkey % 43 = 0 THEN false WHEN c_custkey % 500 = 7 THEN true ELSE c_custkey % 2000 < 1000 END AS is_system_user
FROM customer WHERE c_custkey % 37 <> 0 AND c_custkey % 41 <> 0
"""

PASSWD_PARSE = f"""
SELECT *, NOT (contains(shell, '/nologin') OR contains(shell, '/false')) AS has_valid_shell FROM ({USER_EXPECTED})
"""

HASH_CLASSIFY = f"""
SELECT {host('doc_id')} AS collection_id, 'hash_executables/hash_executables.md5' AS source_file, doc_id AS line_no,
  '/data/' || source || '/doc ' || {vc('doc_id')} || '.txt' AS filepath,
  CASE WHEN lang = 'en' THEN md5(text) END AS md5,
  CASE WHEN lang = 'de' THEN sha1(text) END AS sha1,
  CASE WHEN lang = 'fr' THEN sha256(text) END AS sha256
FROM documents
"""

# ---------------------------------------------------------------------------
# Member paths from pages
# ---------------------------------------------------------------------------
_PATH_DIRS = ["bodyfile/", "live_response/process/", "live_response/network/", "hash_executables/",
              "[root]/var/log/", "files/logs/", "[root]/etc/", "files/system/", "chkrootkit/", "misc/",
              "files/applications/", "live_response/user/"]
_PATH_SUFFIXES = [".txt", ".log", ".yaml", ".conf", "", ".md5", "_passwd", ".yml"]


def _category_sql(p: str) -> str:
    low = f"lower({p})"
    yaml = f"(ends_with({low}, '.yaml') OR ends_with({low}, '.yml'))"
    files_yaml = f"(contains({low}, 'files/') AND {yaml})"
    return f"""CASE
      WHEN {contains_any(low, rules.BODYFILE_PATH_MARKERS)} THEN 'bodyfile'
      WHEN {contains_any(low, rules.LIVE_RESPONSE_PATH_MARKERS)} THEN 'live_response'
      WHEN {contains_any(low, rules.HASH_PATH_MARKERS)} THEN 'hash'
      WHEN {contains_any(low, rules.LOG_PATH_MARKERS)} THEN 'logs'
      WHEN {files_yaml} AND {contains_any(low, rules.FILES_YAML_LOG_WORDS)} THEN 'logs'
      WHEN {files_yaml} THEN 'live_response'
      WHEN {contains_any(low, rules.CONFIG_PATH_MARKERS)} THEN 'config'
      ELSE 'unknown' END"""


def _live_kind_sql(p: str) -> str:
    n = f"lower(regexp_extract({p}, '[^/]*$'))"
    return f"""CASE
      WHEN ends_with({n}, '.yaml') OR ends_with({n}, '.yml') THEN 'yaml'
      WHEN contains({n}, 'ps_') OR starts_with({n}, 'ps') THEN
        CASE WHEN contains({n}, 'aux') THEN 'ps_aux' WHEN contains({n}, 'ef') THEN 'ps_ef' ELSE 'ps_generic' END
      WHEN contains({n}, 'netstat') OR contains({n}, 'ss_') THEN 'netstat'
      WHEN contains({n}, 'passwd') OR contains({n}, 'user') THEN 'passwd'
      ELSE 'raw' END"""


ARTIFACT_CATEGORISE = f"""
SELECT collection_id, page_id, relative_path, category,
  CASE WHEN category = 'live_response' THEN {_live_kind_sql('relative_path')} END AS live_kind
FROM (
  SELECT *, {_category_sql('relative_path')} AS category
  FROM (
    SELECT {host('page_id')} AS collection_id, page_id,
      'uac-node' || {vc('page_id % 8')} || '-linux-20240101000000/'
        || list_element({lst(_PATH_DIRS)}, CAST(page_id % 12 + 1 AS INTEGER))
        || regexp_extract(url, '//([^/?#]+)', 1)
        || list_element({lst(_PATH_SUFFIXES)}, CAST(page_id % 8 + 1 AS INTEGER)) AS relative_path
    FROM pages))
"""


def ts_sql(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def epoch_ts(expr: str) -> str:
    return f"(TIMESTAMP '1970-01-01 00:00:00' + to_seconds({expr}))"


# ---------------------------------------------------------------------------
# Timeline
# ---------------------------------------------------------------------------
TIMELINE_EXPECTED = f"""
SELECT collection_id, {epoch_ts('mtime')} AS t, 'File Modified' AS timestamp_desc, 'bodyfile' AS source,
  'filesystem' AS source_type, 'File modified: ' || name AS message, name AS artifact_path,
  CAST(NULL AS VARCHAR) AS hostname, CAST(NULL AS BIGINT) AS pid,
  md5 AS extra_md5, {vc('size')} AS extra_size, mode AS extra_mode
FROM ({BODY_EXPECTED}) WHERE mtime > 0
UNION ALL
SELECT collection_id, {epoch_ts('crtime')}, 'File Created', 'bodyfile', 'filesystem', 'File created: ' || name, name,
  NULL, NULL, NULL, NULL, NULL
FROM ({BODY_EXPECTED}) WHERE crtime > 0 AND (mtime <= 0 OR crtime <> mtime)
UNION ALL
SELECT collection_id, ts_parsed, 'Log Entry', regexp_extract(source_file, '[^/]*$'), 'log', message, source_file,
  hostname, pid, NULL, NULL, NULL
FROM ({LOG_EXPECTED}) WHERE ts_parsed IS NOT NULL
"""

TIMELINE_UNION = f"""
SELECT collection_id, {ts_sql('t')} AS ts, timestamp_desc, source, source_type, message, artifact_path, hostname, pid,
  extra_md5, extra_size, extra_mode
FROM ({TIMELINE_EXPECTED})
"""

TIMESKETCH_ROWS = f"""
SELECT collection_id,
  CASE WHEN microsecond(t) % 1000000 = 0 THEN strftime(t, '%Y-%m-%dT%H:%M:%S') ELSE strftime(t, '%Y-%m-%dT%H:%M:%S.%f') END AS datetime,
  timestamp_desc, message, source_type AS source_short, source AS source_long, 'uac:' || source_type AS data_type,
  extra_md5 AS md5, extra_size AS size, extra_mode AS mode
FROM ({TIMELINE_EXPECTED})
"""

# ---------------------------------------------------------------------------
# Detectors
# ---------------------------------------------------------------------------
_ANOM_COLS = ("collection_id, anomaly_id, anomaly_type, severity, score, title, description, source_artifact, "
              "artifact_path, ts, username, process_name, mitre_technique, evidence_count, evidence_raw, steps")

PROC_DETECT = f"""
WITH e AS (SELECT *, regexp_extract(string_split(command, ' ')[1], '[^/]*$') AS exe,
                  string_split(command, ' ')[1] AS tok FROM ({PROC_EXPECTED}))
SELECT collection_id, {tmpl(T['proc_suspicious_path']['id'], pid='pid')} AS anomaly_id, 'suspicious_process' AS anomaly_type,
  'high' AS severity, CAST(0.8 AS DOUBLE) AS score, {tmpl(T['proc_suspicious_path']['title'])} AS title,
  {tmpl(T['proc_suspicious_path']['description'], pid='pid')} AS description,
  'process_list' AS source_artifact, CAST(NULL AS VARCHAR) AS artifact_path, CAST(NULL AS VARCHAR) AS ts,
  user AS username, exe AS process_name, CAST(NULL AS VARCHAR) AS mitre_technique, 1 AS evidence_count,
  {tmpl(T['proc_suspicious_path']['evidence'], pid='pid', user='user', command='command')} AS evidence_raw,
  {' || \' | \' || '.join(tmpl(x, first_token='tok', pid='pid') for x in T['proc_suspicious_path']['steps'])} AS steps
FROM e WHERE command <> '' AND {contains_any('command', rules.PROCESS_TEMP_DIRS)}
UNION ALL
SELECT collection_id, {tmpl(T['proc_known_suspicious']['id'], pid='pid')}, 'suspicious_process', 'critical', CAST(0.95 AS DOUBLE),
  {tmpl(T['proc_known_suspicious']['title'], exe='exe')}, {tmpl(T['proc_known_suspicious']['description'], exe='exe')}, 'process_list',
  NULL, NULL, user, exe, 'T1059', 0, NULL, ''
FROM e WHERE lower(exe) IN {tuple(rules.SUSPICIOUS_TOOL_NAMES)}
UNION ALL
SELECT collection_id, {tmpl(T['proc_encoded_cmd']['id'], pid='pid')}, 'suspicious_process', 'high', CAST(0.85 AS DOUBLE),
  {tmpl(T['proc_encoded_cmd']['title'])}, {tmpl(T['proc_encoded_cmd']['description'])},
  'process_list', NULL, NULL, NULL, exe, NULL, 1, command, ''
FROM e WHERE command <> '' AND {contains_any('lower(command)', rules.ENCODED_COMMAND_MARKERS)}
"""

DETECT_PROCESS = PROC_DETECT

_PORT_LABEL = "CASE " + " ".join(f"WHEN {{c}} = {p} THEN {q(l)}" for p, l in rules.SUSPICIOUS_PORTS.items()) + " END"
_PORT_LIST = "(" + ", ".join(str(p) for p in rules.SUSPICIOUS_PORTS) + ")"

NET_DETECT = f"""
SELECT collection_id, {tmpl(T['net_port']['id'], local_port='local_port', remote_port='remote_port')} AS anomaly_id,
  'unusual_network' AS anomaly_type, 'high' AS severity, CAST(0.85 AS DOUBLE) AS score,
  {tmpl(T['net_port']['title'], remote_port='remote_port')} AS title,
  {tmpl(T['net_port']['description'], remote_port='remote_port', label=_PORT_LABEL.format(c='remote_port'))} AS description,
  'network_connections' AS source_artifact, CAST(NULL AS VARCHAR) AS artifact_path, CAST(NULL AS VARCHAR) AS ts,
  CAST(NULL AS VARCHAR) AS username, CAST(NULL AS VARCHAR) AS process_name, 'T1571' AS mitre_technique,
  1 AS evidence_count,
  {tmpl(T['net_port']['evidence'], protocol='protocol', local_address='local_address', local_port='local_port',
         remote_address='remote_address', remote_port='remote_port')} AS evidence_raw, '' AS steps
FROM ({CONN_EXPECTED}) WHERE remote_port <> 0 AND remote_port IN {_PORT_LIST}
UNION ALL
SELECT collection_id, {tmpl(T['net_listen']['id'], local_port='local_port')}, 'persistence_mechanism', 'critical', CAST(0.9 AS DOUBLE),
  {tmpl(T['net_listen']['title'], local_port='local_port')}, {tmpl(T['net_listen']['description'])},
  'network_connections', NULL, NULL, NULL, program, NULL, 0, NULL, ''
FROM ({CONN_EXPECTED}) WHERE upper(state) = 'LISTEN' AND local_port IN {_PORT_LIST}
"""

DETECT_NETWORK = NET_DETECT

FILE_DETECT = f"""
WITH b AS (SELECT *, regexp_extract(name, '[^/]*$') AS fname,
                  CASE WHEN mtime > 0 THEN {ts_sql(epoch_ts('mtime'))} END AS mts FROM ({BODY_EXPECTED}))
SELECT collection_id, {tmpl(T['fs_suid']['id'], inode='inode')} AS anomaly_id, 'privilege_escalation' AS anomaly_type, 'high' AS severity,
  CAST(0.8 AS DOUBLE) AS score, {tmpl(T['fs_suid']['title'], filename='fname')} AS title,
  {tmpl(T['fs_suid']['description'], name='name')} AS description, 'bodyfile' AS source_artifact,
  name AS artifact_path, mts AS ts, CAST(NULL AS VARCHAR) AS username, CAST(NULL AS VARCHAR) AS process_name,
  'T1548.001' AS mitre_technique, 1 AS evidence_count,
  {tmpl(T['fs_suid']['evidence'], mode='mode', size='size', uid='uid')} AS evidence_raw,
  {' || \' | \' || '.join(tmpl(x, name='name') for x in T['fs_suid']['steps'])} AS steps
FROM b WHERE contains(lower(mode), 's') AND name NOT IN {tuple(rules.SYSTEM_SETUID_ALLOWLIST)}
UNION ALL
SELECT collection_id, {tmpl(T['fs_tmpexec']['id'], inode='inode')}, 'suspicious_process', 'medium', CAST(0.7 AS DOUBLE),
  {tmpl(T['fs_tmpexec']['title'])}, {tmpl(T['fs_tmpexec']['description'])}, 'bodyfile', name, mts, NULL, NULL, NULL, 0, NULL, ''
FROM b WHERE contains(mode, 'x') AND NOT starts_with(mode, 'd') AND {contains_any('name', rules.FILE_TEMP_DIRS)}
UNION ALL
SELECT collection_id, {tmpl(T['fs_hidden']['id'], inode='inode')}, 'hidden_file', 'medium', CAST(0.6 AS DOUBLE),
  {tmpl(T['fs_hidden']['title'], filename='fname')}, {tmpl(T['fs_hidden']['description'], name='name')},
  'bodyfile', name, NULL, NULL, NULL, NULL, 0, NULL, ''
FROM b WHERE contains(name, '/.') AND NOT {contains_any('name', rules.HIDDEN_PATH_EXCLUDES)} AND contains(mode, 'x')
"""

DETECT_FILES = FILE_DETECT

USER_DETECT = f"""
WITH u AS (SELECT *, NOT (contains(shell, '/nologin') OR contains(shell, '/false')) AS valid_shell FROM ({USER_EXPECTED}))
SELECT collection_id, {tmpl(T['user_system_shell']['id'], username='username')} AS anomaly_id, 'suspicious_user' AS anomaly_type,
  'medium' AS severity, CAST(0.6 AS DOUBLE) AS score, {tmpl(T['user_system_shell']['title'], username='username')} AS title,
  {tmpl(T['user_system_shell']['description'], username='username', uid='uid')} AS description,
  'passwd' AS source_artifact, CAST(NULL AS VARCHAR) AS artifact_path, CAST(NULL AS VARCHAR) AS ts,
  username, CAST(NULL AS VARCHAR) AS process_name, CAST(NULL AS VARCHAR) AS mitre_technique, 0 AS evidence_count,
  CAST(NULL AS VARCHAR) AS evidence_raw, '' AS steps
FROM u WHERE is_system_user AND valid_shell AND uid <> 0
UNION ALL
SELECT collection_id, {tmpl(T['user_uid0']['id'], username='username')}, 'privilege_escalation', 'critical', CAST(0.95 AS DOUBLE),
  {tmpl(T['user_uid0']['title'], username='username')}, {tmpl(T['user_uid0']['description'], username='username')},
  'passwd', NULL, NULL, username, NULL, 'T1136', 0, NULL, ''
FROM u WHERE uid = 0 AND username <> 'root'
"""

DETECT_USERS = USER_DETECT

ALL_DETECT = f"""
SELECT {_ANOM_COLS} FROM ({PROC_DETECT}) UNION ALL SELECT {_ANOM_COLS} FROM ({NET_DETECT})
UNION ALL SELECT {_ANOM_COLS} FROM ({FILE_DETECT}) UNION ALL SELECT {_ANOM_COLS} FROM ({USER_DETECT})
"""

ANOMALIES_RANKED = f"""
SELECT *, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END
  AS severity_rank
FROM ({ALL_DETECT}) WHERE severity IN ('high', 'critical')
"""

ANOMALY_COUNTS = f"""
SELECT collection_id, count(*) FILTER (WHERE severity = 'critical') AS critical,
  count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium,
  count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'info') AS info,
  count(*) AS total
FROM ({ALL_DETECT}) GROUP BY collection_id
"""

ALLOWLIST_ANTI = f"""
SELECT collection_id, line_no, name, mode FROM ({BODY_EXPECTED})
WHERE contains(lower(mode), 's') AND name NOT IN {tuple(rules.SYSTEM_SETUID_ALLOWLIST)}
"""

HIDDEN_PROCESS_ANTI = f"""
SELECT c.collection_id, 'net_hidden_' || {vc('c.pid')} AS anomaly_id, 'rootkit_indicator' AS anomaly_type,
  'Connection owned by unlisted PID ' || {vc('c.pid')} AS title, c.program AS process_name, c.line_no
FROM ({CONN_EXPECTED}) c
WHERE c.pid IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM ({PROC_EXPECTED}) p WHERE p.collection_id = c.collection_id AND p.pid = c.pid)
"""

_BIN = f"""
WITH p AS (SELECT *, CASE WHEN starts_with(string_split(command, ' ')[1], '/') THEN string_split(command, ' ')[1] END
                  AS binary_path FROM ({PROC_EXPECTED})),
bk AS (SELECT collection_id, name, min(CASE WHEN md5 NOT IN ('0', '') THEN md5 END) AS h
       FROM ({BODY_EXPECTED}) GROUP BY collection_id, name)
SELECT p.*, CASE WHEN p.binary_path IS NOT NULL THEN bk.name IS NOT NULL END AS binary_exists, bk.h AS binary_hash
FROM p LEFT JOIN bk ON p.collection_id = bk.collection_id AND p.binary_path = bk.name
"""

PROCESS_BINARY_JOIN = f"""
SELECT collection_id, source_file, line_no, pid, binary_path, binary_exists, binary_hash FROM ({_BIN})
"""

DELETED_BINARIES = f"""
SELECT collection_id, 'proc_' || {vc('pid')} || '_deleted_binary' AS anomaly_id, 'deleted_binary' AS anomaly_type,
  'high' AS severity, 'Binary not on disk: ' || binary_path AS title, binary_path AS artifact_path, user AS username
FROM ({_BIN}) WHERE binary_exists = false
"""

PROCESS_CONN_JOIN = f"""
SELECT p.collection_id, p.source_file, p.line_no, p.pid, c.line_no AS conn_line_no, c.protocol, c.local_port,
  c.remote_address, c.remote_port, c.state
FROM ({PROC_EXPECTED}) p LEFT JOIN ({CONN_EXPECTED}) c ON p.collection_id = c.collection_id AND p.pid = c.pid
"""

PROCESS_PARENT = f"""
WITH p AS ({PROC_EXPECTED}),
par AS (SELECT collection_id, pid, first(command ORDER BY source_file, line_no) AS parent_command
        FROM p WHERE pid IS NOT NULL GROUP BY collection_id, pid)
SELECT p.collection_id, p.source_file, p.line_no, p.pid, p.ppid, par.parent_command
FROM p LEFT JOIN par ON p.collection_id = par.collection_id AND p.ppid = par.pid
"""

PROCESS_ANCESTRY = f"""
WITH RECURSIVE lst AS ({PROC_EXPECTED}),
one AS (SELECT collection_id, pid, first(ppid ORDER BY source_file, line_no) AS ppid FROM lst WHERE pid IS NOT NULL GROUP BY collection_id, pid),
up AS (SELECT a.collection_id, a.pid, b.pid AS up
       FROM one a LEFT JOIN one b ON b.collection_id = a.collection_id AND b.pid = a.ppid AND b.pid <> a.pid AND b.pid <> 0),
walk AS (
  SELECT collection_id, pid, up AS next, [pid] AS path FROM up
  UNION ALL
  SELECT w.collection_id, w.pid, up.up, list_prepend(up.pid, w.path)
  FROM walk w JOIN up ON up.collection_id = w.collection_id AND up.pid = w.next WHERE NOT list_contains(w.path, up.pid)
)
SELECT up.collection_id, up.pid, w.path[1] AS root_pid, CAST(len(w.path) - 1 AS BIGINT) AS depth, coalesce(array_to_string(w.path, '>'), '') AS path
FROM up LEFT JOIN walk w ON w.collection_id = up.collection_id AND w.pid = up.pid AND w.next IS NULL
"""

EVENTS_AROUND_PIVOT = """
SELECT a.user_id, a.event_id AS pivot_id, b.event_id, epoch_us(b.ts) - epoch_us(a.ts) AS delta_us
FROM events a JOIN events b ON a.user_id = b.user_id
  AND b.ts BETWEEN a.ts - INTERVAL 300 SECOND AND a.ts + INTERVAL 300 SECOND AND b.event_id <> a.event_id
WHERE a.event_type = 'error'
"""

LOGIN_BURST = """
SELECT s.user_id, s.event_id, count(*) AS failures, strftime(s.ts, '%Y-%m-%d %H:%M:%S.%f') AS ts
FROM events s JOIN events e ON e.user_id = s.user_id AND e.event_type = 'error'
  AND e.ts >= s.ts - INTERVAL 1 DAY AND e.ts < s.ts
WHERE s.event_type = 'signup'
GROUP BY s.user_id, s.event_id, s.ts HAVING count(*) >= 3
"""


# ---------------------------------------------------------------------------
# Documents: tags and chunks
# ---------------------------------------------------------------------------
SECURITY_TAGS = f"SELECT doc_id, {tags_sql('text')} AS tags FROM documents"

_WS = r"[\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def py_strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{_WS}+|{_WS}+$', '', 'g')"


def _last_pos(text: str, s: str, ch: str, size: int) -> str:
    p = f"strpos(reverse(substr({text}, {s} + 1, {size})), {ch})"
    return f"(CASE WHEN {p} > 0 THEN {s} + {size} - {p} ELSE -1 END)"


def _chunk_end(text: str, n: str, s: str, size: int = rules.CHUNK_SIZE) -> str:
    half = size // 2
    nl = _last_pos(text, s, "chr(10)", size)
    sp = _last_pos(text, s, "' '", size)
    return (f"(CASE WHEN {s} + {size} >= {n} THEN {s} + {size} WHEN {nl} > {s} + {half} THEN {nl} + 1 "
            f"WHEN {sp} > {s} + {half} THEN {sp} + 1 ELSE {s} + {size} END)")


def chunks_sql(source: str, id_col: str, text_col: str, size: int = rules.CHUNK_SIZE,
               overlap: int = rules.CHUNK_OVERLAP) -> str:
    """(id, ordinal, content) of the overlapping split of ``text_col`` (recursive CTE)."""
    return f"""
WITH RECURSIVE d AS (SELECT {id_col} AS id, {text_col} AS text, length({text_col}) AS n FROM ({source})),
w(id, s, e) AS (
  SELECT id, 0, {_chunk_end('text', 'n', '0', size)} FROM d WHERE n > {size}
  UNION ALL
  SELECT w.id, w.e - {overlap}, {_chunk_end('d.text', 'd.n', f'(w.e - {overlap})', size)}
  FROM w JOIN d ON w.id = d.id WHERE w.e - {overlap} < d.n
),
pieces AS (
  SELECT w.id, w.s, {py_strip_sql('substr(d.text, w.s + 1, w.e - w.s)')} AS content, false AS short
  FROM w JOIN d ON w.id = d.id
  UNION ALL SELECT id, 0, text, true FROM d WHERE n <= {size}
)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS BIGINT) AS ordinal, content
FROM pieces WHERE short OR content <> ''
"""


CHUNK_DOCUMENTS = f"""
SELECT id AS doc_id, ordinal, 'doc_' || substr(md5(content), 1, 8) || '_' || {vc('ordinal')} AS chunk_id,
  CAST(length(content) AS BIGINT) AS n_chars, md5(content) AS content_md5
FROM ({chunks_sql('SELECT * FROM documents', 'doc_id', 'text')})
"""

# ---------------------------------------------------------------------------
# Retrieval on embeddings
# ---------------------------------------------------------------------------
_CENTROIDS = """
WITH u AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
whole AS (SELECT label, 0 AS variant, i, avg(CAST(v AS DOUBLE)) AS m FROM u GROUP BY label, i),
folds AS (SELECT label, CAST(vec_id % 3 + 1 AS INTEGER) AS variant, i, avg(CAST(v AS DOUBLE)) AS m FROM u
          GROUP BY label, vec_id % 3 + 1, i),
c AS (SELECT label, variant, list(m ORDER BY i) AS q FROM (SELECT * FROM whole UNION ALL SELECT * FROM folds)
      GROUP BY label, variant)
"""


def _hits_sql(k: int, variants: str) -> str:
    return f"""{_CENTROIDS},
dist AS (
  SELECT c.label, c.variant, e.vec_id,
    list_reduce(list_transform(range(1, len(e.embedding) + 1),
                               lambda i: (CAST(e.embedding[i] AS DOUBLE) - c.q[i]) * (CAST(e.embedding[i] AS DOUBLE) - c.q[i])),
                lambda a, b: a + b) AS distance
  FROM c JOIN embeddings e ON e.label = c.label WHERE c.variant IN ({variants})
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label, variant ORDER BY distance, vec_id) AS rnk FROM dist)
SELECT label, variant, rnk, vec_id, distance, greatest(0.0, 1 - distance) AS score FROM ranked WHERE rnk <= {k}
"""


VECTOR_TOPK = f"""
SELECT label, CAST(rnk AS BIGINT) AS rank, vec_id, round(distance, 6) AS distance, round(score, 4) AS score
FROM ({_hits_sql(rules.HITS_PER_QUERY, '0')})
"""

VECTOR_TOPK_ALL = f"""
WITH dist AS (
  SELECT q.vec_id AS query_id, e.vec_id,
    list_reduce(list_transform(range(1, len(e.embedding) + 1),
                               lambda i: (CAST(e.embedding[i] AS DOUBLE) - q.embedding[i]) * (CAST(e.embedding[i] AS DOUBLE) - q.embedding[i])),
                lambda a, b: a + b) AS distance
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rnk FROM dist)
SELECT query_id, CAST(rnk AS BIGINT) AS rank, vec_id, round(distance, 6) AS distance, round(greatest(0.0, 1 - distance), 4) AS score
FROM ranked WHERE rnk <= {rules.HITS_PER_QUERY}
"""

_CTX_HITS = f"""
SELECT h.*, d.text, d.source, d.lang FROM ({_hits_sql(rules.HITS_FOR_CONTEXT, '0')}) h
JOIN documents d ON d.doc_id = h.vec_id
"""

CONTEXT_PACK = f"""
WITH t AS (SELECT *, CAST(floor(length(text) / 4) AS BIGINT) AS tok FROM ({_CTX_HITS})),
r AS (SELECT *, sum(tok) OVER (PARTITION BY label ORDER BY rnk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
      FROM t)
SELECT label, count(*) AS n_used, sum(tok) AS tokens_used,
  string_agg('--- Source: ' || coalesce(source, 'unknown') || ' (' || coalesce(lang, 'unknown') || ') [relevance: '
             || CAST(CAST(CAST(score AS DECIMAL(20, 4)) AS DECIMAL(20, 2)) AS VARCHAR) || '] ---' || chr(10) || text
             || chr(10), chr(10) ORDER BY rnk) AS context
FROM r WHERE run <= {rules.CONTEXT_TOKEN_BUDGET} GROUP BY label
"""

MULTI_QUERY_DEDUP = f"""
WITH h AS (SELECT h.*, d.text FROM ({_hits_sql(rules.HITS_PER_QUERY, '0, 1, 2, 3')}) h JOIN documents d ON d.doc_id = h.vec_id),
f AS (SELECT *, row_number() OVER (PARTITION BY label, md5(text) ORDER BY variant, rnk) AS first_seen FROM h)
SELECT label, row_number() OVER (PARTITION BY label ORDER BY distance, variant, rnk) AS place, variant,
  CAST(rnk AS BIGINT) AS rank, vec_id, round(score, 4) AS score, md5(text) AS content_md5
FROM f WHERE first_seen = 1
"""

# ---------------------------------------------------------------------------
# Indicators
# ---------------------------------------------------------------------------
from ..operators import ioc as _ioc  # noqa: E402  (the patterns; the matching below is DuckDB's own)

_P = {k: v.replace("'", "''") for k, v in _ioc.IOC_PATTERNS.items()}


def _found(kind: str) -> str:
    return f"SELECT unnest(regexp_extract_all(text, '{_P[kind]}')) AS v, id FROM t"


IOC_EXTRACT = f"""
WITH t AS (
  SELECT doc_id AS id, text FROM documents
  UNION ALL SELECT page_id, concat_ws(chr(10), url, html) FROM pages
  UNION ALL SELECT conv_id, text FROM conversations
), m AS (
  SELECT 'email' AS kind, v AS value, id FROM ({_found('email')})
  UNION ALL SELECT 'ipv4', rtrim(v, '.'), id FROM ({_found('ipv4')}) WHERE regexp_matches(rtrim(v, '.'), '{_ioc.IPV4_WHOLE}')
  UNION ALL SELECT CASE length(v) WHEN 64 THEN 'sha256' WHEN 40 THEN 'sha1' ELSE 'md5' END, lower(v), id
    FROM ({_found('hash')}) WHERE regexp_matches(v, '{_ioc.HASH_WHOLE}')
  UNION ALL SELECT 'path', v, id FROM ({_found('path')})
  UNION ALL SELECT 'url', v, id FROM ({_found('url')})
  UNION ALL SELECT 'domain', lower(regexp_extract(v, '{_ioc.DOMAIN_FROM_URL}', 1)), id FROM ({_found('url')})
  UNION ALL SELECT 'user', regexp_extract(v, '{_ioc.NAME_AFTER['user']}', 1), id FROM ({_found('user')})
  UNION ALL SELECT 'command', regexp_extract(v, '{_ioc.NAME_AFTER['command']}', 1), id FROM ({_found('command')})
  UNION ALL SELECT 'cron', v, id FROM ({_found('cron')})
)
SELECT kind, value, count(*) AS occurrences, min(id) AS first_id, max(id) AS last_id
FROM m WHERE value <> '' GROUP BY kind, value
"""

# ---------------------------------------------------------------------------
# Answers and prompts
# ---------------------------------------------------------------------------
_ANSWERS = f"""
SELECT conv_id, turn, '# Findings' || chr(10) || '## Executive Summary' || chr(10) || text || chr(10)
  || '## Immediate Actions' || chr(10) || '1. Isolate host ' || {vc('conv_id')} || chr(10)
  || '2) Collect memory of turn ' || {vc('turn')} || chr(10) || chr(10) || '- Rotate keys' || chr(10)
  || '## Notes' || chr(10) || 'Reviewed.' AS answer
FROM conversations WHERE role = 'assistant'
"""


def _section_sql(name: str) -> str:
    low = name.lower()
    return f"""
l AS (SELECT conv_id, turn, unnest(string_split(answer, chr(10))) AS line,
             generate_subscripts(string_split(answer, chr(10)), 1) AS i FROM a),
f AS (SELECT *, contains(lower(line), '{low}') AND contains(line, '#') AS head FROM l),
st AS (SELECT conv_id, turn, min(i) FILTER (WHERE head) AS h FROM f GROUP BY conv_id, turn),
en AS (SELECT f.conv_id, f.turn, min(f.i) FILTER (WHERE f.i > st.h AND starts_with(f.line, '#') AND NOT f.head) AS e
       FROM f JOIN st ON f.conv_id = st.conv_id AND f.turn = st.turn GROUP BY f.conv_id, f.turn),
sec AS (SELECT st.conv_id, st.turn,
          CASE WHEN st.h IS NULL THEN '' ELSE {py_strip_sql("coalesce(string_agg(f.line, chr(10) ORDER BY f.i) FILTER (WHERE f.i > st.h AND (en.e IS NULL OR f.i < en.e) AND NOT f.head), '')")} END AS body
        FROM st JOIN en ON st.conv_id = en.conv_id AND st.turn = en.turn
        JOIN f ON f.conv_id = st.conv_id AND f.turn = st.turn
        GROUP BY st.conv_id, st.turn, st.h)"""


ANSWER_SECTIONS = f"""
WITH a AS ({_ANSWERS}),
s1 AS (WITH {_section_sql('Executive Summary')} SELECT * FROM sec),
s2 AS (WITH {_section_sql('Immediate')} SELECT * FROM sec)
SELECT s1.conv_id, s1.turn, s1.body AS summary,
  array_to_string(list_transform(
    list_filter(list_transform(string_split(s2.body, chr(10)), lambda x: {py_strip_sql('x')}),
                lambda x: x <> '' AND NOT starts_with(x, '#')),
    lambda x: regexp_replace(x, '^[0-9.\\-) ]+', '')), ' | ') AS actions
FROM s1 JOIN s2 ON s1.conv_id = s2.conv_id AND s1.turn = s2.turn
"""


def _prompt_sql() -> str:
    from ..operators.prompts import TEMPLATES
    return q(TEMPLATES["query"])


PROMPT_TABLE = f"""
SELECT label, 'query' AS template,
  replace(replace({_prompt_sql()}, '{{query}}', 'Which records are closest to label ' || {vc('label')} || '?'),
          '{{context}}', context) AS prompt
FROM ({CONTEXT_PACK})
"""


def _followups_sql(col: str) -> str:
    low = f"lower({col})"
    parts = []
    for words, sugg in rules.FOLLOWUP_SUGGESTIONS:
        cond = " OR ".join(f"contains({low}, {q(w)})" for w in words)
        parts.append(f"WHEN {cond} THEN {q(' | '.join(sugg))}")
    return "CASE " + " ".join(parts) + f" ELSE {q(' | '.join(rules.FOLLOWUP_DEFAULT))} END"


FOLLOWUP_QUESTIONS = f"""
SELECT conv_id, turn, {_followups_sql('text')} AS suggestions FROM conversations WHERE role = 'user'
"""

# ---------------------------------------------------------------------------
# Process ranking, summary, per-file logs
# ---------------------------------------------------------------------------
TOP_CPU = f"""
WITH p AS ({PROC_EXPECTED})
SELECT collection_id, grp, CAST(rank AS BIGINT) AS rank, pid, value FROM (
  SELECT collection_id, 'high_cpu' AS grp, pid, cpu AS value,
    row_number() OVER (PARTITION BY collection_id ORDER BY cpu DESC, source_file, line_no) AS rank FROM p WHERE cpu > 10
  UNION ALL
  SELECT collection_id, 'high_mem', pid, mem,
    row_number() OVER (PARTITION BY collection_id ORDER BY mem DESC, source_file, line_no) FROM p WHERE mem > 5
) WHERE rank <= 50
"""

COLLECTION_SUMMARY = f"""
WITH b AS (SELECT collection_id, count(*) AS total_files,
             count(*) FILTER (WHERE contains(mode, 'x') AND NOT starts_with(mode, 'd')) AS executable_files,
             count(*) FILTER (WHERE contains(lower(mode), 's')) AS setuid_files,
             count(*) FILTER (WHERE mtime > 0) + count(*) FILTER (WHERE crtime > 0 AND (mtime <= 0 OR crtime <> mtime)) AS fe
           FROM ({BODY_EXPECTED}) GROUP BY collection_id),
p AS (SELECT collection_id, count(*) AS processes FROM ({PROC_EXPECTED}) GROUP BY collection_id),
c AS (SELECT collection_id, count(*) AS network_connections FROM ({CONN_EXPECTED}) GROUP BY collection_id),
u AS (SELECT collection_id, count(*) AS users FROM ({USER_EXPECTED}) GROUP BY collection_id),
l AS (SELECT collection_id, count(*) AS log_entries, count(ts_parsed) AS le FROM ({LOG_EXPECTED}) GROUP BY collection_id),
h AS (SELECT collection_id, count(*) AS hash_entries FROM ({HASH_CLASSIFY}) GROUP BY collection_id)
SELECT collection_id, coalesce(hash_entries, 0) AS hash_entries,
  coalesce(total_files, 0) AS total_files, coalesce(executable_files, 0) AS executable_files,
  coalesce(setuid_files, 0) AS setuid_files, coalesce(processes, 0) AS processes,
  coalesce(network_connections, 0) AS network_connections, coalesce(users, 0) AS users,
  coalesce(log_entries, 0) AS log_entries, coalesce(le, 0) + coalesce(fe, 0) AS timeline_events
FROM b FULL JOIN p USING (collection_id) FULL JOIN c USING (collection_id) FULL JOIN u USING (collection_id)
  FULL JOIN l USING (collection_id) FULL JOIN h USING (collection_id)
"""

TIMELINE_RANGE = f"""
SELECT collection_id, strftime(ts_parsed, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, source_file, line_no, message
FROM ({LOG_EXPECTED}) WHERE ts_parsed BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-09 12:00:00'
"""

LOGS_BY_SOURCE = f"""
WITH g AS (SELECT collection_id, regexp_extract(source_file, '[^/]*$') AS source, source_file, line_no,
             CASE WHEN ts_parsed IS NOT NULL THEN '[' || strftime(ts_parsed, '%Y-%m-%d %H:%M:%S') || '] '
                  ELSE {q(FMT['log_unknown_time'])} END || message || chr(10) AS line FROM ({LOG_EXPECTED})),
r AS (SELECT *, row_number() OVER (PARTITION BY collection_id, source ORDER BY source_file, line_no) AS rn FROM g)
SELECT collection_id, source, CAST((rn - 1) // {rules.SEGMENT_ROWS} AS INTEGER) AS segment, any_value(total) AS entry_count,
  {tmpl(FMT['log_header'], source='source')} || string_agg(line, '' ORDER BY source_file, line_no) AS content
FROM (SELECT *, count(*) OVER (PARTITION BY collection_id, source) AS total FROM r) GROUP BY collection_id, source, (rn - 1) // {rules.SEGMENT_ROWS}
"""


STREAM_HOURLY = f"""
SELECT collection_id, strftime(date_trunc('hour', ts_parsed), '%Y-%m-%d %H:%M:%S.%f') AS hour_start,
  count(*) AS event_count
FROM ({LOG_EXPECTED}) WHERE ts_parsed IS NOT NULL GROUP BY collection_id, date_trunc('hour', ts_parsed)
"""


_CRON_MARKERS = rules.PROCESS_TEMP_DIRS + rules.ENCODED_COMMAND_MARKERS

SUSPICIOUS_CRON = f"""
SELECT collection_id, 'log_' || {vc('line_no')} || '_suspicious_cron' AS anomaly_id, 'suspicious_cron' AS anomaly_type,
  'high' AS severity, message AS description, source_file AS artifact_path
FROM ({LOG_EXPECTED})
WHERE contains(lower(coalesce(process, '')), 'cron') AND {contains_any("lower(coalesce(message, ''))", _CRON_MARKERS)}
"""

PRIVILEGE_CHANGES = f"""
SELECT collection_id, 'log_' || {vc('line_no')} || '_priv_change' AS anomaly_id, 'privilege_escalation' AS anomaly_type,
  'medium' AS severity, message AS description, source_file AS artifact_path
FROM ({LOG_EXPECTED})
WHERE (lower(coalesce(process, '')) = 'sudo' AND contains(coalesce(message, ''), 'USER=root'))
   OR (lower(coalesce(process, '')) = 'su' AND contains(lower(coalesce(message, '')), 'root'))
"""

_ENABLED = ["suspicious_process", "unusual_network", "privilege_escalation", "hidden_file", "suspicious_user",
            "persistence_mechanism", "deleted_binary", "suspicious_cron", "rootkit_indicator", "unauthorized_access"]

DETECTOR_CONFIG = f"""
SELECT collection_id, anomaly_type, count(*) AS n FROM ({ALL_DETECT})
WHERE anomaly_type IN {tuple(_ENABLED)}
  AND score * CASE anomaly_type WHEN 'suspicious_user' THEN 1.5 WHEN 'hidden_file' THEN 0.5 ELSE 1.0 END >= 0.7
GROUP BY collection_id, anomaly_type
"""


def _iso_sql(t: str) -> str:
    return (f"CASE WHEN {t} IS NULL THEN NULL WHEN microsecond({t}) % 1000000 = 0 "
            f"THEN strftime({t}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({t}, '%Y-%m-%dT%H:%M:%S.%f') END")


HOST_SUMMARY_CHUNKS = f"""
WITH hosts AS (SELECT {host('user_id')} AS collection_id, max(ts) AS ct FROM events GROUP BY 1),
b AS ({BODY_EXPECTED}), p AS ({PROC_EXPECTED}), c AS ({CONN_EXPECTED}), u AS ({USER_EXPECTED}),
l AS ({LOG_EXPECTED}), bin AS ({_BIN}),
cnt AS (
  SELECT h.collection_id,
    (SELECT count(*) FROM b WHERE b.collection_id = h.collection_id) AS n_files,
    (SELECT count(*) FROM b WHERE b.collection_id = h.collection_id AND contains(mode, 'x') AND NOT starts_with(mode, 'd')) AS n_exec,
    (SELECT count(*) FROM b WHERE b.collection_id = h.collection_id AND contains(lower(mode), 's')) AS n_suid,
    (SELECT count(*) FROM p WHERE p.collection_id = h.collection_id) AS n_proc,
    (SELECT count(*) FROM c WHERE c.collection_id = h.collection_id) AS n_conn,
    (SELECT count(*) FROM u WHERE u.collection_id = h.collection_id) AS n_users,
    (SELECT count(*) FROM l WHERE l.collection_id = h.collection_id) AS n_logs,
    (SELECT count(*) FROM l WHERE l.collection_id = h.collection_id AND ts_parsed IS NOT NULL)
      + (SELECT count(*) FILTER (WHERE mtime > 0) + count(*) FILTER (WHERE crtime > 0 AND (mtime <= 0 OR crtime <> mtime))
         FROM b WHERE b.collection_id = h.collection_id) AS n_events
  FROM hosts h
),
suid AS (SELECT collection_id, string_agg('- ' || name || ' (' || mode || ')' || chr(10), '' ORDER BY line_no) AS t
         FROM (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY line_no) AS rn FROM b
               WHERE contains(lower(mode), 's')) WHERE rn <= 10 GROUP BY collection_id),
nobin AS (SELECT collection_id, string_agg('- PID ' || {vc('pid')} || ': ' || coalesce(command, '') || chr(10), ''
                                       ORDER BY source_file, line_no) AS t
          FROM (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY source_file, line_no) AS rn FROM bin
                WHERE binary_exists = false) WHERE rn <= 10 GROUP BY collection_id),
lis AS (SELECT collection_id, string_agg('- ' || protocol || ' ' || local_address || ':' || {vc('local_port')}
                 || CASE WHEN coalesce(program, '') <> '' THEN ' (' || program || ')' ELSE '' END || chr(10), ''
                 ORDER BY line_no) AS t
        FROM (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY line_no) AS rn FROM c
              WHERE upper(state) = 'LISTEN') WHERE rn <= 15 GROUP BY collection_id),
txt AS (
  SELECT h.collection_id,
    '# System Analysis Summary' || chr(10) || chr(10) || '## System Information' || chr(10)
    || '- Hostname: ' || h.collection_id || chr(10) || '- OS Type: linux' || chr(10)
    || '- Collection Time: ' || {_iso_sql('h.ct')} || chr(10) || chr(10) || '## Artifact Counts' || chr(10)
    || '- Total Files: ' || {vc('n_files')} || chr(10) || '- Executable Files: ' || {vc('n_exec')} || chr(10)
    || '- SUID/SGID Files: ' || {vc('n_suid')} || chr(10) || '- Running Processes: ' || {vc('n_proc')} || chr(10)
    || '- Network Connections: ' || {vc('n_conn')} || chr(10) || '- User Accounts: ' || {vc('n_users')} || chr(10)
    || '- Log Entries: ' || {vc('n_logs')} || chr(10) || '- Timeline Events: ' || {vc('n_events')} || chr(10) || chr(10)
    || '## Key Findings Preview' || chr(10)
    || coalesce({q(FMT['summary_setuid_title'])} || suid.t, '')
    || coalesce({q(FMT['summary_nobin_title'])} || nobin.t, '')
    || coalesce({q(FMT['summary_listen_title'])} || lis.t, '') AS content
  FROM hosts h JOIN cnt USING (collection_id) LEFT JOIN suid USING (collection_id)
    LEFT JOIN nobin USING (collection_id) LEFT JOIN lis USING (collection_id)
)
SELECT collection_id, 'summary_' || substr(md5(content), 1, 8) || '_0' AS chunk_id,
  CAST(length(content) AS INTEGER) AS n_chars, md5(content) AS content_md5
FROM txt
"""


def _tags_with(content: str, extra: str) -> str:
    """Security tags of ``content`` then the producer's extra tags, comma-joined."""
    return f"concat_ws(',', NULLIF({tags_sql(content)}, ''), {extra})"


_FILE_BLOCKS = f"""
SELECT collection_id, grp, grank, (rn - 1) // {rules.SEGMENT_ROWS} AS segment, any_value(total) AS n,
  {tmpl(FMT['bodyfile_header'], title=case_map('grp', FMT['bodyfile_titles']))}
  || string_agg(line, '' ORDER BY line_no) AS text
FROM (
  SELECT *, row_number() OVER (PARTITION BY collection_id, grp ORDER BY line_no) AS rn,
    count(*) OVER (PARTITION BY collection_id, grp) AS total FROM (
    SELECT b.*, g.grp, g.grank,
      '- ' || name || chr(10) || '  Mode: ' || mode || ', Size: ' || {vc('size')} || ', UID: ' || {vc('uid')}
      || ', GID: ' || {vc('gid')} || chr(10)
      || CASE WHEN md5 NOT IN ('', '0') THEN '  MD5: ' || md5 || chr(10) ELSE '' END
      || CASE WHEN mtime > 0 THEN '  Modified: ' || strftime({epoch_ts('mtime')}, '%Y-%m-%dT%H:%M:%S') || chr(10)
              ELSE '' END AS line
    FROM ({BODY_EXPECTED}) b,
      (VALUES ('executables', 0), ('setuid', 1), ('suspicious_locations', 2)) g(grp, grank)
    WHERE (g.grp = 'executables' AND contains(mode, 'x') AND NOT starts_with(mode, 'd'))
       OR (g.grp = 'setuid' AND contains(lower(mode), 's'))
       OR (g.grp = 'suspicious_locations' AND {contains_any('name', rules.SUSPICIOUS_LOCATION_MARKERS)})))
GROUP BY collection_id, grp, grank, segment
"""

_PROC_BLOCKS = f"""
SELECT collection_id, grp, grank, (rn - 1) // {rules.SEGMENT_ROWS} AS segment, any_value(total) AS n,
  {tmpl(FMT['process_header'], title=case_map('grp', FMT['process_titles']))}
  || string_agg(line, '' ORDER BY k, source_file, line_no) AS text
FROM (
  SELECT *, row_number() OVER (PARTITION BY collection_id, grp ORDER BY k, source_file, line_no) AS rn,
    count(*) OVER (PARTITION BY collection_id, grp) AS total FROM (
    SELECT p.*, g.grp, g.grank,
      CASE g.grp WHEN 'high_cpu' THEN -cpu WHEN 'high_mem' THEN -mem ELSE 0.0 END AS k,
      'PID: ' || {vc('pid')}
      || CASE WHEN ppid IS NOT NULL AND ppid <> 0 THEN ', PPID: ' || {vc('ppid')} ELSE '' END
      || CASE WHEN coalesce(user, '') <> '' THEN ', User: ' || user ELSE '' END
      || CASE WHEN cpu IS NOT NULL AND cpu <> 0 THEN ', CPU: ' || {vc('cpu')} || '%' ELSE '' END
      || CASE WHEN mem IS NOT NULL AND mem <> 0 THEN ', MEM: ' || {vc('mem')} || '%' ELSE '' END
      || chr(10) || 'Command: ' || coalesce(command, '') || chr(10) || chr(10) AS line
    FROM ({PROC_EXPECTED}) p,
      (VALUES ('all', 0), ('root', 1), ('high_cpu', 2), ('high_mem', 3)) g(grp, grank)
    WHERE g.grp = 'all' OR (g.grp = 'root' AND user = 'root') OR (g.grp = 'high_cpu' AND cpu > 10)
       OR (g.grp = 'high_mem' AND mem > 5)))
GROUP BY collection_id, grp, grank, segment
"""

_NET_BLOCKS = f"""
SELECT collection_id, grp, grank, (rn - 1) // {rules.SEGMENT_ROWS} AS segment, any_value(total) AS n,
  {tmpl(FMT['network_header'], title=case_map('grp', FMT['network_titles']))}
  || string_agg(line, '' ORDER BY line_no) AS text
FROM (
  SELECT *, row_number() OVER (PARTITION BY collection_id, grp ORDER BY line_no) AS rn,
    count(*) OVER (PARTITION BY collection_id, grp) AS total FROM (
    SELECT c.*, g.grp, g.grank,
      upper(protocol) || ' ' || local_address || ':' || {vc('local_port')}
      || CASE WHEN coalesce(remote_address, '') <> '' THEN ' -> ' || remote_address || ':' || coalesce({vc('remote_port')}, 'None') ELSE '' END
      || CASE WHEN coalesce(state, '') <> '' THEN ' [' || state || ']' ELSE '' END
      || CASE WHEN pid IS NOT NULL AND pid <> 0 THEN ' PID:' || {vc('pid')} ELSE '' END
      || CASE WHEN coalesce(program, '') <> '' THEN ' (' || program || ')' ELSE '' END || chr(10) AS line
    FROM ({CONN_EXPECTED}) c, (VALUES ('listening', 0), ('established', 1), ('all', 2)) g(grp, grank)
    WHERE g.grp = 'all' OR (g.grp = 'listening' AND upper(state) = 'LISTEN')
       OR (g.grp = 'established' AND upper(state) = 'ESTABLISHED')))
GROUP BY collection_id, grp, grank, segment
"""

_USER_BLOCKS = f"""
SELECT collection_id, 'users' AS grp, 0 AS grank, segment, count(*) AS n,
  {q(FMT['users_header'])}
  || coalesce(string_agg(CASE WHEN NOT is_system_user THEN entry
                              || CASE WHEN NOT valid THEN {q(FMT['users_no_shell'])} ELSE '' END END,
                         '' ORDER BY line_no), '')
  || {q(FMT['users_system_header'])}
  || coalesce(string_agg(CASE WHEN is_system_user AND valid THEN entry END, '' ORDER BY line_no), '')
  || {q(FMT['users_keywords'])}
  AS text
FROM (SELECT *, NOT (contains(shell, '/nologin') OR contains(shell, '/false')) AS valid,
        '- ' || username || ' (UID: ' || {vc('uid')} || ')' || chr(10) || '  Home: ' || coalesce(home, 'None')
        || ', Shell: ' || coalesce(shell, 'None') || chr(10) AS entry,
        (row_number() OVER (PARTITION BY collection_id ORDER BY source_file, line_no) - 1) // {rules.SEGMENT_ROWS} AS segment
      FROM ({USER_EXPECTED}))
GROUP BY collection_id, segment
"""


def _split_blocks(blocks: str) -> str:
    """Chunks of block texts: (collection_id, grp, grank, n, ordinal, content)."""
    return f"""
WITH blk AS (SELECT *, row_number() OVER (ORDER BY collection_id, grp, segment) AS bid FROM ({blocks})),
pcs AS ({chunks_sql('SELECT bid, text FROM blk', 'bid', 'text')})
SELECT blk.collection_id, blk.grp, blk.grank, blk.segment, blk.n, pcs.ordinal, pcs.content
FROM blk JOIN pcs ON pcs.id = blk.bid
"""


def _chunk_rows(kind_rank: int, artifact: str, source: str, prefix: str, extra: str, body: str) -> str:
    return f"""
SELECT collection_id, CAST({kind_rank} AS INTEGER) AS kind_rank, CAST(grank AS INTEGER) AS group_rank,
  CAST(segment AS INTEGER) AS segment, {prefix} || '_' || substr(md5(content), 1, 8) || '_' || {vc('ordinal')} AS chunk_id,
  CAST(ordinal AS INTEGER) AS ordinal, '{artifact}' AS artifact_type, {source} AS source,
  CAST(length(content) AS INTEGER) AS n_chars, {_tags_with('content', extra)} AS tags
FROM ({body})
"""


_LOG_FILE_TEXT = LOGS_BY_SOURCE
_LOG_FILE_ORDER = f"""
SELECT collection_id, source,
  CAST(row_number() OVER (PARTITION BY collection_id ORDER BY ff, fl) - 1 AS INTEGER) AS grank
FROM (SELECT collection_id, regexp_extract(source_file, '[^/]*$') AS source,
        first(source_file ORDER BY source_file, line_no) AS ff, first(line_no ORDER BY source_file, line_no) AS fl
      FROM ({LOG_EXPECTED}) GROUP BY 1, 2)
"""

ARTIFACT_CHUNKS = " UNION ALL ".join([
    _chunk_rows(0, "bodyfile", "'bodyfile.txt'", "'bodyfile_' || grp", "grp", _split_blocks(_FILE_BLOCKS)),
    _chunk_rows(1, "process", "'ps_output'", "'proc_' || grp", "'process', grp", _split_blocks(_PROC_BLOCKS)),
    _chunk_rows(2, "network", "'netstat_output'", "'net_' || grp", "'network', grp", _split_blocks(_NET_BLOCKS)),
    _chunk_rows(3, "user", "'passwd'", "'users'", "'user', 'account', 'passwd'",
                f"SELECT collection_id, grank, segment, 0 AS ordinal, text AS content FROM ({_USER_BLOCKS})"),
    _chunk_rows(4, "timeline", "'timeline'", "'timeline_' || hour", "'timeline'",
                f"SELECT collection_id, hour, 0 AS grank, segment, 0 AS ordinal, content FROM ({TIMELINE_HOURLY})"),
    _chunk_rows(5, "log", "source", "'log_' || source", "'log', replace(source, '.', '_')", f"""
SELECT blk.collection_id, blk.source, blk.grank, blk.segment, pcs.ordinal, pcs.content
FROM (SELECT t.*, o.grank, row_number() OVER (ORDER BY t.collection_id, t.source, t.segment) AS bid FROM ({_LOG_FILE_TEXT}) t
      JOIN ({_LOG_FILE_ORDER}) o ON o.collection_id = t.collection_id AND o.source = t.source) blk
JOIN ({chunks_sql(f"SELECT row_number() OVER (ORDER BY collection_id, source, segment) AS bid, content FROM ({_LOG_FILE_TEXT})", 'bid', 'content')}) pcs
  ON pcs.id = blk.bid"""),
])
