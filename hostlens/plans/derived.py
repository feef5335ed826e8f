"""Artifact text derived from the driver tables.

The driver tables hold no forensic text, so each registered query first writes
artifact lines (syslog, ps, netstat, passwd, bodyfile, hash lists, paths) from
table columns with Column expressions, then parses them with the engine's
operators.  The oracle SQL computes the expected parsed columns straight from
the base tables, so the check does not reuse the parser.

Every builder returns a lines frame ``(collection_id, source_file, line_no,
line)``; files whose first line is a header get one header row per
(collection, file) at ``line_no = 0``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import fence

N_HOSTS = 8
LINE_COLS = ["collection_id", "source_file", "line_no", "line"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  The single-file ones are read by one task, so in a local session (tests, the bench)
    the rows of this fixture layer are dealt to all cores; on a cluster they are left as they are."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def host_of(key: str) -> Column:
    """Collection id of a derived row: one of N_HOSTS hosts, keyed by a table column."""
    return F.concat(F.lit("uac-node"), F.pmod(F.col(key), F.lit(N_HOSTS)).cast("string"))


def s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _with_headers(body: DataFrame, base: DataFrame, host_key: str, source_file: Column, header: Column) -> DataFrame:
    """Add one header line per (collection, file), computed from the base table's
    key column alone (a tiny distinct), not from the built lines."""
    heads = (base.select(host_of(host_key).alias("collection_id"), source_file.alias("source_file"),
                         header.alias("line")).distinct()
             .select("collection_id", "source_file", F.lit(0).cast("bigint").alias("line_no"), "line"))
    return body.unionByName(heads)


# ---------------------------------------------------------------------------
# Logs from events
# ---------------------------------------------------------------------------
LOG_FILE_BY_EVENT = {
    "error": "/var/log/auth.log",
    "signup": "/var/log/secure",
    "click": "/var/log/cron",
    "view": "/var/log/app/access.log",
    "purchase": "/var/log/app/orders.log",
}


def lineitem_line_no() -> Column:
    """Line number of a lineitem-derived line: file order by (orderkey, linenumber),
    ties (the table repeats those pairs) broken by part and supplier key."""
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
    return (((ok * 8 + ln) * 2097152 + F.pmod(F.col("l_partkey"), F.lit(2097152))) * 1024
            + F.pmod(F.col("l_suppkey"), F.lit(1024))).cast("bigint")


def _case(col: str, mapping: dict, default=None) -> Column:
    out = None
    for k, v in mapping.items():
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(F.col(col) == k, v) if out is None else out.when(F.col(col) == k, v)
    return out.otherwise(default if default is not None else F.lit(None))


def event_log_lines(events: DataFrame) -> DataFrame:
    """Syslog lines (error/signup/click), ISO lines (view/purchase), some plain lines."""
    ts = F.col("ts")
    uid, eid = s("user_id"), s("event_id")
    day = F.lpad(F.dayofmonth(ts).cast("string"), 2, " ")
    head = F.concat(F.date_format(ts, "MMM"), F.lit(" "), day, F.lit(" "), F.date_format(ts, "HH:mm:ss"),
                    F.lit(" node"), uid, F.lit(" "))
    err = F.concat(head, F.lit("sshd["), eid, F.lit("]: Failed password for user"), uid, F.lit(" from 10."),
                   s(F.col("user_id") % 256), F.lit("."), s(F.col("event_id") % 256), F.lit(" port 22 ssh2"))
    sup = F.concat(head, F.lit("sudo["), eid, F.lit("]: user"), uid, F.lit(" : TTY=pts/"), s(F.col("event_id") % 5),
                   F.lit(" ; PWD=/home/user"), uid, F.lit(" ; USER=root ; COMMAND=/bin/bash"))
    clk = F.concat(head, F.lit("CRON: (user"), uid, F.lit(") CMD (/tmp/job"), s(F.col("event_id") % 10),
                   F.lit(".sh | bash)"))
    view = F.when(
        F.col("event_id") % 10 == 0,
        F.concat(F.lit("kernel audit: type=1400 msg=view"), eid),
    ).otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z view item="), eid,
                         F.lit(" user="), uid))
    pur = F.concat(F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00 purchase order="),
                   eid, F.lit(" cents="), s(F.round(F.col("value") * 100).cast("bigint")))
    line = _case("event_type", {"error": err, "signup": sup, "click": clk, "view": view, "purchase": pur})
    return fence(events.select(
        host_of("user_id").alias("collection_id"),
        _case("event_type", LOG_FILE_BY_EVENT).alias("source_file"),
        F.col("event_id").cast("bigint").alias("line_no"),
        line.alias("line"),
    ))


# ---------------------------------------------------------------------------
# Process listings from events
# ---------------------------------------------------------------------------
PS_FILES = ["live_response/process/ps_auxwww.txt", "live_response/process/ps_-ef.txt",
            "live_response/process/ps_-o_pid_args.txt"]
PS_AUX_HEADER = "USER       PID %CPU %MEM    VSZ   RSS TTY      STAT START   TIME COMMAND"
PS_EF_HEADER = "UID        PID  PPID  C STIME TTY          TIME CMD"
PS_GENERIC_HEADER = "  PID COMMAND"


def process_command() -> Column:
    e = F.col("event_id")
    return _case("event_type", {
        "view": F.concat(F.lit("/usr/bin/f"), s((e % 250) * 8), F.lit("_"), s(e % 7 + 1), F.lit(" --serve")),
        "error": F.concat(F.lit("/tmp/.x/run"), s("user_id"), F.lit("  --once")),
        "click": F.concat(F.lit("/usr/bin/python3 -c exec(open('/tmp/p"), s(e % 10), F.lit(".py').read())")),
        "purchase": F.concat(F.lit("nc -lvp "), s(e % 3 + 4444)),
        "signup": F.concat(F.lit("bash -c echo "), F.substring(F.md5(s(e)), 1, 12), F.lit(" | base64 -d | sh")),
    })


def process_lines(events: DataFrame) -> DataFrame:
    """ps aux / ps -ef / generic ps files; the file is picked by user_id mod 3."""
    e = F.col("event_id")
    user = F.when(F.col("user_id") % 10 == 0, F.lit("root")).otherwise(F.concat(F.lit("u"), s("user_id")))
    cpu = F.when(e % 101 == 0, F.lit("1.2.3")).otherwise(
        F.concat(s(F.floor((e % 400) / 10)), F.lit("."), s(e % 10)))
    mem = F.concat(s(F.floor((F.col("user_id") % 80) / 10)), F.lit("."), s(F.col("user_id") % 10))
    pid = F.when(e % 103 == 0, F.concat(F.lit("p"), s(e))).otherwise(s(e))
    tty = F.when(e % 4 == 0, F.lit("?")).otherwise(F.concat(F.lit("pts/"), s(e % 4)))
    start = F.date_format("ts", "HH:mm")
    tim = F.concat(F.lit("0:"), F.lpad(s(e % 60), 2, "0"))
    cmd = process_command()
    aux_fields = [user, pid, cpu, mem, s((e * 37) % 900000), s((e * 11) % 90000), tty, F.lit("Ss"), start, tim]
    aux = F.when(e % 107 == 0, F.concat_ws("   ", *aux_fields)).otherwise(F.concat_ws("   ", *aux_fields, cmd))
    ppid = F.when(e % 5 == 0, F.lit("1")).otherwise(s(e - 1))
    ef = F.concat_ws(" ", user, pid, ppid, F.lit("0"), start, tty, tim, cmd)
    generic = F.concat(s(e + 1), F.lit(" "), cmd)
    kind = F.col("user_id") % 3
    body = events.select(
        host_of("user_id").alias("collection_id"),
        F.element_at(F.array(*[F.lit(f) for f in PS_FILES]), (kind + 1).cast("int")).alias("source_file"),
        (e + 1).cast("bigint").alias("line_no"),
        F.when(kind == 0, aux).when(kind == 1, ef).otherwise(generic).alias("line"),
    )
    header = F.when(kind == 0, F.lit(PS_AUX_HEADER)).when(kind == 1, F.lit(PS_EF_HEADER)).otherwise(
        F.lit(PS_GENERIC_HEADER))
    file_ = F.element_at(F.array(*[F.lit(f) for f in PS_FILES]), (kind + 1).cast("int"))
    # a reader of one kind of file builds the lines of that kind only
    return fence(_with_headers(body, events, "user_id", file_, header), LINE_COLS, keep=("collection_id", "source_file"))


# ---------------------------------------------------------------------------
# Network connections from lineitem
# ---------------------------------------------------------------------------
NETSTAT_FILE = "live_response/network/netstat_-tunap.txt"
NETSTAT_HEADER = "Proto Recv-Q Send-Q Local Address           Foreign Address         State       PID/Program name"
WATCH_PORTS = [4444, 5555, 6666, 6667, 8080, 31337]


def netstat_lines(lineitem: DataFrame) -> DataFrame:
    ok, pk, sk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    ports = F.array(*[F.lit(p) for p in WATCH_PORTS])
    proto = F.element_at(F.array(*[F.lit(p) for p in ["tcp", "tcp6", "udp", "udp6", "unix", "tcp"]]),
                         (ln % 6 + 1).cast("int"))
    lport = F.when(pk % 13 == 0, F.element_at(ports, (ok % 6 + 1).cast("int"))).otherwise((ok * 7 + pk) % 65536)
    rport = F.when(pk % 11 == 0, F.element_at(ports, (sk % 6 + 1).cast("int"))).otherwise((ok + pk * 3) % 65536)
    v6 = proto.endswith("6")
    is_tcp = proto.startswith("tcp")
    state = F.element_at(F.array(*[F.lit(x) for x in ["LISTEN", "ESTABLISHED", "TIME_WAIT", "CLOSE_WAIT"]]),
                         (ok % 4 + 1).cast("int"))
    listen = ~is_tcp | (state == "LISTEN")
    local = F.when(v6 & (ok % 5 == 0), F.concat(F.lit(":::"), s(lport))).when(
        v6, F.concat(F.lit("[fe80::"), s(sk % 100), F.lit("]:"), s(lport))).otherwise(
        F.concat(F.lit("10."), s(sk % 256), F.lit("."), s(pk % 256), F.lit("."), s(ok % 256), F.lit(":"), s(lport)))
    remote = F.when(listen & v6, F.lit(":::*")).when(listen, F.lit("0.0.0.0:*")).otherwise(
        F.concat(F.lit("172.16."), s(pk % 256), F.lit("."), s(sk % 256), F.lit(":"), s(rport)))
    pidprog = F.when(ok % 9 == 0, F.lit("-")).otherwise(F.concat(s(ok), F.lit("/prog"), s(sk % 20)))
    inet = F.concat_ws("  ", proto, F.lit("0"), F.lit("0"), local, remote,
                       F.when(is_tcp, state), pidprog)
    unix = F.concat(F.lit("unix  2      [ ACC ]     STREAM     LISTENING     "), s(ok), F.lit("    /run/s"), s(pk), F.lit(".sock"))
    body = lineitem.select(
        host_of("l_suppkey").alias("collection_id"),
        F.lit(NETSTAT_FILE).alias("source_file"),
        lineitem_line_no().alias("line_no"),
        F.when(proto == "unix", unix).otherwise(inet).alias("line"),
    )
    return fence(_with_headers(body, lineitem, "l_suppkey", F.lit(NETSTAT_FILE), F.lit(NETSTAT_HEADER)), LINE_COLS)


# ---------------------------------------------------------------------------
# Accounts from customer
# ---------------------------------------------------------------------------
PASSWD_FILE = "live_response/user/etc_passwd.txt"
SHELLS = ["/bin/bash", "/usr/sbin/nologin", "/bin/false", "/bin/sh", "/bin/zsh"]


def passwd_lines(customer: DataFrame) -> DataFrame:
    ck = F.col("c_custkey")
    name = F.when(ck == 0, F.lit("root")).otherwise(F.concat(F.lit("cust"), s(ck)))
    uid = F.when(ck % 43 == 0, F.concat(F.lit("u"), s(ck))).when(ck % 500 == 7, F.lit("0")).otherwise(s(ck % 2000))
    shell = F.element_at(F.array(*[F.lit(x) for x in SHELLS]), (F.col("c_nationkey") % 5 + 1).cast("int"))
    fields = [name, F.lit("x"), uid, s("c_nationkey"), s("c_mktsegment"), F.concat(F.lit("/home/cust"), s(ck))]
    full = F.concat_ws(":", *fields, shell)
    line = F.when(ck % 37 == 0, F.concat_ws(":", *fields)).when(ck % 41 == 0, F.concat(F.lit("# "), full)).otherwise(full)
    return fence(customer.select(host_of("c_custkey").alias("collection_id"), F.lit(PASSWD_FILE).alias("source_file"),
                                 ck.cast("bigint").alias("line_no"), line.alias("line")))


# ---------------------------------------------------------------------------
# File metadata from lineitem
# ---------------------------------------------------------------------------
BODYFILE_FILE = "bodyfile/bodyfile.txt"
BODY_DIRS = ["/usr/bin/", "/tmp/", "/home/u{s}/.cache/", "/var/tmp/", "/dev/shm/", "/opt/.hidden/", "/etc/", "/usr/sbin/"]
BODY_MODES = ["-rwxr-xr-x", "-rw-r--r--", "drwxr-xr-x", "-rwsr-xr-x", "-rw-------", "srwxrwxrwx", "-rwxr-sr-x"]
SETUID_NAMES = ["/usr/bin/sudo", "/usr/bin/passwd", "/usr/bin/su", "/usr/bin/ping", "/usr/bin/mount", "/usr/bin/umount"]


def bodyfile_lines(lineitem: DataFrame) -> DataFrame:
    ok, pk, sk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    dirs = F.array(*[F.lit(d) if "{s}" not in d else F.concat(F.lit("/home/u"), s(sk), F.lit("/.cache/"))
                     for d in BODY_DIRS])
    name = F.when(pk % 97 == 0, F.element_at(F.array(*[F.lit(x) for x in SETUID_NAMES]), (ok % 6 + 1).cast("int"))
                  ).otherwise(F.concat(F.element_at(dirs, (pk % 8 + 1).cast("int")), F.lit("f"), s(pk), F.lit("_"), s(ln)))
    mode = F.element_at(F.array(*[F.lit(m) for m in BODY_MODES]), (ok % 7 + 1).cast("int"))
    md5 = F.when(ln % 4 == 0, F.lit("0")).otherwise(F.md5(s(ok * 10 + ln)))
    uid = F.when(ok % 97 == 0, F.concat(F.lit("x"), s(sk))).otherwise(s(sk))
    mtime = F.unix_date(F.to_date("l_shipdate")).cast("bigint") * 86400 + ok % 86400
    crtime = F.when(ln % 3 == 0, F.lit(0).cast("bigint")).when(ln % 3 == 1, mtime).otherwise(mtime - 86400)
    head = [md5, name, s(ok * 10 + ln), mode, uid, s(pk % 100)]
    full = F.concat_ws("|", *head, s(F.round("l_extendedprice").cast("bigint")), s(mtime + ln * 3600), s(mtime),
                       s(mtime + 60), s(crtime))
    line = F.when(ln == 7, F.concat_ws("|", *head)).when((ok % 50 == 0) & (ln == 1), F.concat(F.lit("# "), full)).otherwise(full)
    return fence(lineitem.select(host_of("l_suppkey").alias("collection_id"), F.lit(BODYFILE_FILE).alias("source_file"),
                                 lineitem_line_no().alias("line_no"), line.alias("line")))


# ---------------------------------------------------------------------------
# Hash lists from documents
# ---------------------------------------------------------------------------
HASH_FILE = "hash_executables/hash_executables.md5"


def hash_lines(documents: DataFrame) -> DataFrame:
    t = F.col("text")
    h = F.when(F.col("lang") == "en", F.md5(t)).when(F.col("lang") == "de", F.sha1(t)).when(
        F.col("lang") == "fr", F.sha2(t, 256)).otherwise(F.substring(F.md5(t), 1, 20))
    sep = F.when(F.col("doc_id") % 2 == 0, F.lit("|")).otherwise(F.lit("  "))
    path = F.concat(F.lit("/data/"), F.col("source"), F.lit("/doc "), s("doc_id"), F.lit(".txt"))
    return fence(documents.select(host_of("doc_id").alias("collection_id"), F.lit(HASH_FILE).alias("source_file"),
                                  F.col("doc_id").cast("bigint").alias("line_no"), F.concat(h, sep, path).alias("line")))


# ---------------------------------------------------------------------------
# Archive member paths from pages
# ---------------------------------------------------------------------------
PATH_DIRS = ["bodyfile/", "live_response/process/", "live_response/network/", "hash_executables/",
             "[root]/var/log/", "files/logs/", "[root]/etc/", "files/system/", "chkrootkit/", "misc/",
             "files/applications/", "live_response/user/"]
PATH_SUFFIXES = [".txt", ".log", ".yaml", ".conf", "", ".md5", "_passwd", ".yml"]


def member_paths(pages: DataFrame) -> DataFrame:
    """(collection_id, relative_path): one archive member per page."""
    pid = F.col("page_id")
    host = F.regexp_extract("url", r"//([^/?#]+)", 1)
    d = F.element_at(F.array(*[F.lit(x) for x in PATH_DIRS]), (pid % len(PATH_DIRS) + 1).cast("int"))
    suf = F.element_at(F.array(*[F.lit(x) for x in PATH_SUFFIXES]), (pid % len(PATH_SUFFIXES) + 1).cast("int"))
    coll = F.concat(F.lit("uac-node"), s(pid % N_HOSTS), F.lit("-linux-20240101000000"))
    return pages.select(host_of("page_id").alias("collection_id"), pid.alias("page_id"),
                        F.concat(coll, F.lit("/"), d, host, suf).alias("relative_path"))
