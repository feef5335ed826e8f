"""Rule-based detectors: table rows -> ``anomalies`` rows.

Each table is scanned once: every rule becomes a ``when(condition, rank)``
candidate, the ranks of a row are exploded, and the texts are built for matches
only, and only those that the query asks for.  No join, no shuffle -- detectors run as one narrow stage per table (and unchanged on a
streaming frame), except the hidden-file rule whose "first 10 per collection"
is a window group limit.

Ordering of the report is a column (``ord``) reproducing the reference order:
processes, network, files, users; severity desc and score desc on top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.columns import base_name, contains_any, exe_name, fence, fill, first_token, severity_rank

T = rules.DETECTOR_TEXT

EVIDENCE_TYPE = "array<struct<artifact_type:string,artifact_path:string,raw_data:string,explanation:string>>"
ANOMALY_COLS = [
    "collection_id", "anomaly_id", "anomaly_type", "severity", "score", "title", "description",
    "source_artifact", "artifact_path", "timestamp", "username", "process_name", "mitre_technique",
    "evidence", "investigation_steps", "ord",
]

_REGISTRY: dict[str, callable] = {}


def register_detector(name: str, fn) -> None:
    """Add a user detector: ``fn(tables: dict[str, DataFrame]) -> anomalies frame``; ``detect_all`` runs it
    with the tables it was given.  ``None`` takes the detector out again."""
    if fn is None:
        _REGISTRY.pop(name, None)
    else:
        _REGISTRY[name] = fn


def _lit(v, t="string"):
    return F.lit(v).cast(t)


def _evidence(artifact_type: str, raw: Column | None = None, path: Column | None = None,
              explanation: str | None = None) -> Column:
    return F.array(F.struct(
        F.lit(artifact_type).alias("artifact_type"),
        (path if path is not None else _lit(None)).alias("artifact_path"),
        (raw if raw is not None else _lit(None)).alias("raw_data"),
        _lit(explanation).alias("explanation"),
    ))


def _cand(rule_rank: int, cond: Column, *, anomaly_id, anomaly_type, severity, score, title, description,
          source_artifact, artifact_path=None, timestamp=None, username=None, process_name=None,
          mitre=None, evidence=None, steps=None) -> tuple[int, Column, dict[str, Column]]:
    return rule_rank, cond, {
        "anomaly_id": anomaly_id,
        "anomaly_type": F.lit(anomaly_type),
        "severity": F.lit(severity),
        "score": F.lit(float(score)),
        "title": title if isinstance(title, Column) else F.lit(title),
        "description": description if isinstance(description, Column) else F.lit(description),
        "source_artifact": F.lit(source_artifact),
        "artifact_path": artifact_path if artifact_path is not None else _lit(None),
        "timestamp": timestamp if timestamp is not None else _lit(None, "timestamp"),
        "username": username if username is not None else _lit(None),
        "process_name": process_name if process_name is not None else _lit(None),
        "mitre_technique": _lit(mitre),
        "evidence": evidence if evidence is not None else F.array().cast(EVIDENCE_TYPE),
        "investigation_steps": steps if steps is not None else F.array().cast("array<string>"),
    }


def _explode(df: DataFrame, cands: list[tuple[int, Column, dict[str, Column]]], group_rank: int,
             line_first: bool = True) -> DataFrame:
    """Keep the matching candidates of each row and emit one anomaly per match."""
    # a filter over the array would run interpreted: empty ranks are dropped after the explode
    ranks = F.array(*[F.when(cond, F.lit(rank)) for rank, cond, _ in cands])
    out = df.select("*", F.explode(ranks).alias("_rule")).where(F.col("_rule").isNotNull())
    rule = F.col("_rule")

    def of_rule(name: str) -> Column:
        value = F.when(rule == cands[0][0], cands[0][2][name])
        for rank, _, fields in cands[1:]:
            value = value.when(rule == rank, fields[name])
        return value.alias(name)

    if line_first:
        ord_ = F.struct(F.lit(group_rank).alias("g"), F.lit(0).alias("r0"), F.col("source_file").alias("f"),
                        F.col("line_no").alias("n"), rule.alias("r"))
    else:
        ord_ = F.struct(F.lit(group_rank).alias("g"), rule.alias("r0"), F.col("source_file").alias("f"),
                        F.col("line_no").alias("n"), F.lit(0).alias("r"))
    return out.select("collection_id", *[of_rule(c) for c in ANOMALY_COLS[1:-1]], ord_.alias("ord"))


def detect_processes(processes: DataFrame) -> DataFrame:
    """DET-P1..P3 over ``processes``."""
    # executable name and first token feed several rules and texts: compute once (fenced)
    cmd0 = F.coalesce(F.col("command"), F.lit(""))
    processes = fence(processes.select("collection_id", "source_file", "line_no", "pid", "user",
                                       cmd0.alias("_cmd"), exe_name(cmd0).alias("_exe"),
                                       first_token(cmd0).alias("_tok")))
    cmd, exe, tok = F.col("_cmd"), F.col("_exe"), F.col("_tok")
    pid = F.col("pid")
    p1, p2, p3 = T["proc_suspicious_path"], T["proc_known_suspicious"], T["proc_encoded_cmd"]
    cands = [
        _cand(0, (cmd != "") & contains_any(cmd, rules.PROCESS_TEMP_DIRS),
              anomaly_id=fill(p1["id"], pid=pid), anomaly_type="suspicious_process", severity="high", score=0.8,
              title=p1["title"], description=fill(p1["description"], pid=pid), source_artifact="process_list",
              evidence=_evidence("process", fill(p1["evidence"], pid=pid, user=F.col("user"), command=cmd),
                                 explanation=p1["explanation"]),
              process_name=exe, username=F.col("user"),
              steps=F.array(*[fill(s, first_token=tok, pid=pid) for s in p1["steps"]])),
        _cand(1, F.lower(exe).isin(rules.SUSPICIOUS_TOOL_NAMES),
              anomaly_id=fill(p2["id"], pid=pid), anomaly_type="suspicious_process", severity="critical", score=0.95,
              title=fill(p2["title"], exe=exe), description=fill(p2["description"], exe=exe),
              source_artifact="process_list", process_name=exe, username=F.col("user"), mitre="T1059"),
        _cand(2, (cmd != "") & contains_any(F.lower(cmd), rules.ENCODED_COMMAND_MARKERS),
              anomaly_id=fill(p3["id"], pid=pid), anomaly_type="suspicious_process", severity="high", score=0.85,
              title=p3["title"], description=p3["description"], source_artifact="process_list",
              evidence=_evidence("process", cmd, explanation=p3["explanation"]),
              process_name=exe),
    ]
    return _explode(processes, cands, 0)


def _port_label(port: Column) -> Column:
    m = F.create_map(*[x for k, v in rules.SUSPICIOUS_PORTS.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, port.cast("int"))


def detect_network(conns: DataFrame) -> DataFrame:
    """DET-N1 / N2 over ``connections`` (port list is a 6-entry literal map: no join)."""
    rp, lp = F.col("remote_port"), F.col("local_port")
    ports = list(rules.SUSPICIOUS_PORTS)
    listening = F.coalesce(F.upper(F.col("state")) == "LISTEN", F.lit(False))
    n1, n2 = T["net_port"], T["net_listen"]
    cands = [
        _cand(0, rp.isNotNull() & (rp != 0) & rp.isin(ports),
              anomaly_id=fill(n1["id"], local_port=lp, remote_port=rp), anomaly_type="unusual_network",
              severity="high", score=0.85, title=fill(n1["title"], remote_port=rp),
              description=fill(n1["description"], remote_port=rp, label=_port_label(rp)),
              source_artifact="network_connections",
              evidence=_evidence("network", fill(n1["evidence"], protocol=F.col("protocol"),
                                                 local_address=F.col("local_address"), local_port=lp,
                                                 remote_address=F.col("remote_address"), remote_port=rp)),
              mitre="T1571"),
        _cand(1, listening & lp.isin(ports),
              anomaly_id=fill(n2["id"], local_port=lp), anomaly_type="persistence_mechanism", severity="critical",
              score=0.9, title=fill(n2["title"], local_port=lp), description=n2["description"],
              source_artifact="network_connections", process_name=F.col("program")),
    ]
    return _explode(conns, cands, 1)


def detect_files(bodyfile: DataFrame, hidden_limit: int | None = None) -> DataFrame:
    """DET-F1..F3 over ``bodyfile``: one narrow pass.  With ``hidden_limit``, F3 keeps only the first
    rows per collection."""
    name, mode = F.col("name"), F.col("mode")
    is_exec = mode.contains("x")
    is_dir = mode.startswith("d")
    is_setuid = F.lower(mode).contains("s")
    fname = base_name(name)
    mts = F.when(F.col("mtime") > 0, F.timestamp_seconds("mtime"))
    f1, f2, f3 = T["fs_suid"], T["fs_tmpexec"], T["fs_hidden"]
    cands = [
        _cand(0, is_setuid & ~name.isin(rules.SYSTEM_SETUID_ALLOWLIST),
              anomaly_id=fill(f1["id"], inode=F.col("inode")), anomaly_type="privilege_escalation", severity="high",
              score=0.8, title=fill(f1["title"], filename=fname), description=fill(f1["description"], name=name),
              source_artifact="bodyfile", artifact_path=name, timestamp=mts,
              evidence=_evidence("file", fill(f1["evidence"], mode=mode, size=F.col("size"), uid=F.col("uid")), path=name),
              mitre="T1548.001", steps=F.array(*[fill(s, name=name) for s in f1["steps"]])),
        _cand(1, is_exec & ~is_dir & contains_any(name, rules.FILE_TEMP_DIRS),
              anomaly_id=fill(f2["id"], inode=F.col("inode")), anomaly_type="suspicious_process", severity="medium",
              score=0.7, title=f2["title"], description=f2["description"], source_artifact="bodyfile",
              artifact_path=name, timestamp=mts),
    ]
    hidden_cond = name.contains(rules.HIDDEN_PATH_MARKER) & ~contains_any(name, rules.HIDDEN_PATH_EXCLUDES) & is_exec
    cands.append(
        _cand(2, hidden_cond, anomaly_id=fill(f3["id"], inode=F.col("inode")), anomaly_type="hidden_file",
              severity="medium", score=0.6, title=fill(f3["title"], filename=fname),
              description=fill(f3["description"], name=name), source_artifact="bodyfile", artifact_path=name))
    found = _explode(bodyfile, cands, 2, line_first=False)
    if hidden_limit is None:
        return found
    w = Window.partitionBy("collection_id").orderBy(F.col("ord.f"), F.col("ord.n"))
    first = (found.where(F.col("ord.r0") == 2).withColumn("_rn", F.row_number().over(w))
             .where(F.col("_rn") <= hidden_limit).drop("_rn"))
    return found.where(F.col("ord.r0") != 2).unionByName(first)


def detect_users(users: DataFrame) -> DataFrame:
    """DET-U1 / U2 over ``users``."""
    u, uid = F.col("username"), F.col("uid")
    u1, u2 = T["user_system_shell"], T["user_uid0"]
    cands = [
        _cand(0, F.col("is_system_user") & F.col("has_valid_shell") & (uid != 0),
              anomaly_id=fill(u1["id"], username=u), anomaly_type="suspicious_user", severity="medium", score=0.6,
              title=fill(u1["title"], username=u), description=fill(u1["description"], username=u, uid=uid),
              source_artifact="passwd", username=u),
        _cand(1, (uid == 0) & (u != "root"),
              anomaly_id=fill(u2["id"], username=u), anomaly_type="privilege_escalation", severity="critical",
              score=0.95, title=fill(u2["title"], username=u), description=fill(u2["description"], username=u),
              source_artifact="passwd", username=u, mitre="T1136"),
    ]
    return _explode(users, cands, 3)


def detect_all(processes=None, connections=None, bodyfile=None, users=None, extra: list[DataFrame] | None = None,
               threshold: str = "low") -> DataFrame:
    """DET-ALL: union of the detectors (SET-1), severity threshold (FIL-12).

    Sorting is left to ``rank_anomalies`` so the union stays a narrow plan.
    """
    parts = []
    if processes is not None:
        parts.append(detect_processes(processes))
    if connections is not None:
        parts.append(detect_network(connections))
    if bodyfile is not None:
        parts.append(detect_files(bodyfile))
    if users is not None:
        parts.append(detect_users(users))
    parts.extend(extra or [])
    tables = {"processes": processes, "connections": connections, "bodyfile": bodyfile, "users": users}
    parts.extend(fn({k: t for k, t in tables.items() if t is not None}) for fn in _REGISTRY.values())
    out = parts[0].select(*ANOMALY_COLS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*ANOMALY_COLS))
    return filter_severity(out, threshold)


def filter_severity(anomalies: DataFrame, threshold: str) -> DataFrame:
    """FIL-12: keep rows at or above the threshold (info < low < medium < high < critical)."""
    return anomalies.where(severity_rank("severity") >= rules.severity_rank(threshold))


def rank_anomalies(anomalies: DataFrame) -> DataFrame:
    """SRT-1: severity desc, score desc, detector order; global range-partitioned sort."""
    return anomalies.withColumn("severity_rank", severity_rank("severity")).orderBy(
        "collection_id", F.col("severity_rank").desc(), F.col("score").desc(), "ord")


def severity_counts(anomalies: DataFrame) -> DataFrame:
    """AGG-2: per collection, count per severity (zero-filled) and total."""
    sev = F.col("severity")
    return anomalies.groupBy("collection_id").agg(
        *[F.count_if(sev == s).alias(s) for s in ["critical", "high", "medium", "low", "info"]],
        F.count(F.lit(1)).alias("total"),
    )


def severity_subset(anomalies: DataFrame, severity: str) -> DataFrame:
    """FIL-13: anomalies of one severity."""
    return anomalies.where(F.col("severity") == severity)


def anomaly_rows(anomalies: DataFrame) -> DataFrame:
    """PRJ-3: flat projection with the evidence count (SNK-6 columns and more)."""
    return anomalies.select(
        "collection_id", "anomaly_id", F.col("anomaly_type").alias("type"), "severity", "score", "title",
        "description", "source_artifact", "artifact_path", F.size("evidence").alias("evidence_count"),
        "timestamp", "username", "process_name", "mitre_technique", "investigation_steps",
    )


DEFAULT_ENABLED = ["suspicious_process", "unusual_network", "privilege_escalation", "hidden_file", "suspicious_user",
                   "persistence_mechanism", "deleted_binary", "suspicious_cron", "rootkit_indicator",
                   "unauthorized_access"]


def apply_detector_config(anomalies: DataFrame, enabled: list[str] | None = None, score_threshold: float = 0.7,
                          weights: dict[str, float] | None = None) -> DataFrame:
    """DET-X6: keep enabled anomaly types whose weighted score reaches the threshold.

    ``weights`` (type -> factor, default 1.0) is a literal map, so the config is
    applied in the same narrow stage as the detectors -- no join.
    """
    enabled = enabled or DEFAULT_ENABLED
    w = F.lit(1.0)
    if weights:
        w = F.coalesce(F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]),
                                    F.col("anomaly_type")), F.lit(1.0))
    return anomalies.where(F.col("anomaly_type").isin(enabled) & (F.col("score") * w >= score_threshold))
