"""Prompt table and answer post-processing (PRM-1..4).

The engine stops at a prompt table: a batch-inference job can read it and
write answers back; answers are then split into sections here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.columns import PY_STRIP_REGEX, col_

# Our own template texts; ``{name}`` fields are replaced by columns, unknown
# fields are left as they are.
TEMPLATES = {
    "query": (
        "You are assisting a forensic investigation of a Unix host.\n"
        "Answer the question using only the evidence below and cite the sources.\n\n"
        "Question: {query}\n\nEvidence:\n{context}\n\nAnswer:"
    ),
    "incident_summary": (
        "Summarise the incident for an executive audience.\n\n"
        "Findings:\n{analysis_results}\n\nAnomalies:\n{anomalies}\n\nIndicators:\n{iocs}\n\n"
        "Write sections '# Executive Summary', '# Timeline', '# Immediate Actions'."
    ),
    "anomaly_review": (
        "Review these detector findings and rate how likely each is malicious.\n\n{anomalies}\n\nContext:\n{context}"
    ),
    "timeline_review": "Explain what happened in this time window.\n\n{context}\n\nFocus: {query}",
    "process_review": (
        "Below is a process listing of one host. Point out processes that do not fit the host's role: odd paths, parents, "
        "owners or resource use. Give pid, reason and a next step for each.\n\nProcesses:\n{process_data}"
    ),
    "network_review": (
        "Below are a host's sockets. Name connections and listeners that deserve attention, with address, port, owning "
        "process and the reason.\n\nSockets:\n{network_data}"
    ),
    "lateral_movement": (
        "Look for signs that an intruder moved between hosts: remote logins, shared keys, copied tools, unusual sessions. "
        "Order what you find by time.\n\nAccounts:\n{user_data}\n\nSockets:\n{network_data}\n\nLogs:\n{context}"
    ),
    "persistence": (
        "Look for ways by which code starts again after a reboot or login: scheduled jobs, services, profile files, keys, "
        "set-id files. Say what starts, when and as whom.\n\nFiles:\n{file_data}\n\nContext:\n{context}"
    ),
    "ioc_extraction": "List every indicator of compromise in the text below, one per line as kind:value.\n\n{context}",
}


def fill_template(template: str, **fields) -> Column:
    """Replace ``{name}`` fields with column values (``replace`` chain, unknown fields kept)."""
    out = F.lit(template)
    for k, v in fields.items():
        v = v if isinstance(v, Column) else F.col(v)
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def prompt_table(df: DataFrame, template: str, key_cols: list[str], **fields) -> DataFrame:
    """PRM-1: one prompt per row of ``df``."""
    return df.select(*key_cols, F.lit(template).alias("template"),
                     fill_template(TEMPLATES[template], **fields).alias("prompt"))


def extract_section(text, section: str) -> Column:
    """PRM-3: lines after the first line that names ``section`` and holds '#',
    up to the next line starting with '#'; later heading lines naming the
    section are skipped; result stripped."""
    lines = F.split(col_(text), "\n", -1)
    sec = section.lower()
    is_head = F.transform(lines, lambda x: F.lower(x).contains(sec) & x.contains("#"))
    start = F.array_position(is_head, True).cast("int")
    # after the heading: stop at the first line starting with '#' that is not itself a heading of the section
    rest = F.slice(lines, start + 1, F.greatest(F.size(lines) - start, F.lit(0)))
    rest_head = F.slice(is_head, start + 1, F.greatest(F.size(lines) - start, F.lit(0)))
    stops = F.zip_with(rest, rest_head, lambda x, h: x.startswith("#") & ~h)
    stop = F.array_position(stops, True).cast("int")
    body = F.when(stop > 0, F.slice(F.zip_with(rest, rest_head, lambda x, h: F.struct(x.alias("l"), h.alias("h"))),
                                    1, stop - 1)).otherwise(
        F.zip_with(rest, rest_head, lambda x, h: F.struct(x.alias("l"), h.alias("h"))))
    kept = F.transform(F.filter(body, lambda s: ~s["h"]), lambda s: s["l"])
    joined = F.array_join(kept, "\n")
    return F.when(start > 0, F.regexp_replace(joined, PY_STRIP_REGEX, "")).otherwise(F.lit(""))


def action_items(section_text) -> Column:
    """Action list from a section: non-blank lines not starting with '#', stripped,
    leading digits and '.-) ' removed."""
    lines = F.transform(F.split(col_(section_text), "\n", -1), lambda x: F.regexp_replace(x, PY_STRIP_REGEX, ""))
    kept = F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))
    return F.transform(kept, lambda x: F.regexp_replace(x, r"^[0-9.\-) ]+", ""))


def followups(question) -> Column:
    """PRM-4: three follow-up questions chosen by the first keyword group found."""
    q = F.lower(col_(question))
    out = None
    for words, suggestions in rules.FOLLOWUP_SUGGESTIONS:
        cond = F.lit(False)
        for w in words:
            cond = cond | q.contains(w)
        arr = F.array(*[F.lit(s) for s in suggestions])
        out = F.when(cond, arr) if out is None else out.when(cond, arr)
    return out.otherwise(F.array(*[F.lit(s) for s in rules.FOLLOWUP_DEFAULT]))


SUMMARY_QUESTION = "overview of the system, incidents and suspicious activity"


def incident_prompts(hits: DataFrame, anomalies: DataFrame, text_col: str, source_col: str, type_col: str,
                     order_cols: list, most: int = 20) -> DataFrame:
    """PRM-2: one incident-summary prompt per collection.

    ``hits`` are the collection's best chunks for ``SUMMARY_QUESTION``; they are packed into the summary's
    token budget.  The ``most`` highest ranked anomalies are listed as ``- [severity] title`` lines (a top
    list: the window's group limit keeps the rest out of the shuffle).
    """
    from pyspark.sql import Window

    from ..functions.columns import severity_rank
    from .retrieval import pack_context

    context = pack_context(hits, ["collection_id"], text_col, source_col, type_col, order_cols, rules.SUMMARY_TOKEN_BUDGET)
    w = Window.partitionBy("collection_id").orderBy(F.col("_s").desc(), F.col("score").desc(), "ord")
    first = (anomalies.select("collection_id", "severity", "title", "score", "ord", severity_rank("severity").alias("_s"))
             .withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most))
    line = F.concat(F.lit("- ["), F.col("severity"), F.lit("] "), F.col("title"))
    lists = first.groupBy("collection_id").agg(F.array_sort(F.collect_list(F.struct("_n", line.alias("t")))).alias("_l")).select(
        "collection_id", F.array_join(F.transform("_l", lambda x: x["t"]), "\n").alias("anomalies"))
    both = context.select("collection_id", "context").join(lists, "collection_id", "full_outer")
    return prompt_table(both, "incident_summary", ["collection_id"], analysis_results=F.col("context"),
                        anomalies=F.coalesce("anomalies", F.lit("none found")), iocs=F.lit("as named in the anomalies"))
