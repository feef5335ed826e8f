"""Command-level workflows: the reference's user commands as Spark jobs.

Each function takes parsed tables (``plans.collection.parse_archives`` /
``read_tables``) for any number of collections and returns DataFrames or
writes outputs; nothing is collected to the driver.

    parse     -> structured_summary / parse_counts
    analyze   -> anomaly_outputs (ranked rows, counts, report rows)
    index     -> chunk_store (chunks + embeddings written as Parquet)
    query     -> query_prompts (retrieval over the store -> prompt table)
    timeline  -> timeline_view (external CSV preferred, range filter, plot rows)
    export    -> export (jsonl | json | csv | markdown)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..operators import chunks as ch
from ..operators import detectors as det
from ..operators import enrich as en
from ..operators import prompts as pr
from ..operators import retrieval as ret
from ..operators import timeline as tl
from ..sinks import writers as w
from ..sources import structured as st


def structured_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """``parse``: per collection the structured JSON summary (COMPOSE-1)."""
    return w.structured_data(tables)


def parse_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``parse``: row counts per (collection, table) (SNK-10)."""
    return w.parse_summary(tables)


def all_anomalies(tables: dict[str, DataFrame], threshold: str = "low", with_joins: bool = True) -> DataFrame:
    """Every detector over the parsed tables, at or above ``threshold``."""
    extra = []
    if with_joins:
        extra = [
            en.detect_deleted_binaries(en.with_binary_info(tables["processes"], tables["bodyfile"], tables.get("hashes"))),
            en.detect_hidden_processes(tables["connections"], tables["processes"]),
            en.detect_suspicious_cron(tables["logs"]),
            en.detect_privilege_changes(tables["logs"]),
            en.detect_login_bursts(tables["logs"]),
        ]
    return det.detect_all(tables["processes"], tables["connections"], tables["bodyfile"], tables["users"],
                          extra=extra, threshold=threshold)


def anomaly_outputs(tables: dict[str, DataFrame], threshold: str = "low") -> dict[str, DataFrame]:
    """``analyze --anomalies``: ranked anomalies, severity counts and report rows."""
    a = all_anomalies(tables, threshold)
    counts = det.severity_counts(a)
    return {
        "anomalies": det.rank_anomalies(a),
        "counts": counts,
        "report_rows": w.anomaly_report_rows(a, counts, tables.get("collections")),
    }


def build_chunks(tables: dict[str, DataFrame]) -> DataFrame:
    """All chunk producers in the reference order (SET-2)."""
    logs, bf, pr_ = tables["logs"], tables["bodyfile"], tables["processes"]
    timeline = tables.get("timeline")
    if timeline is None:
        timeline = tl.merge_timeline(tl.bodyfile_events(bf), tl.log_events(logs), sort=False)
    return ch.all_chunks(
        ch.file_chunks(bf),
        ch.process_chunks(pr_),
        ch.network_chunks(tables["connections"]),
        ch.user_chunks(tables["users"]),
        ch.timeline_chunks(tl.hourly_buckets(timeline)),
        ch.log_chunks(tl.logs_by_file(logs)),
        ch.summary_chunks(tables["collections"], bf, pr_, tables["connections"], tables["users"], logs, timeline,
                          en.with_binary_info(pr_, bf)),
    )


def chunk_store(tables: dict[str, DataFrame], path: str, embed_fn=None, dim: int = 0) -> DataFrame:
    """``index``: chunks with embeddings written to a Parquet store (RET-1/2).

    ``embed_fn(list[str]) -> list[list[float]]`` runs in Arrow batches on the
    executors; without it the built-in hashed TF-IDF embedding is used.
    """
    chunks = build_chunks(tables)
    if embed_fn is not None:
        emb = ret.embed_with(chunks, "content", embed_fn, dim)
    else:
        emb, _ = ret.hashing_embeddings(chunks, "content")
    ret.write_store(emb, path, mode="overwrite")
    return emb


def query_prompts(store: DataFrame, questions: DataFrame, embed_queries, budget: int = rules.CONTEXT_TOKEN_BUDGET,
                  k: int = rules.HITS_PER_QUERY) -> DataFrame:
    """``query``: questions (``collection_id, query_id, variant_no, text``) -> prompt table.

    ``embed_queries(questions) -> questions + embedding`` must use the same
    embedding as the store.  Retrieval is scoped to the question's collection;
    hits of all variants are deduplicated by content hash (first hit wins),
    ordered by score and packed into ``budget`` tokens (RET-5, SET-3, WIN-2).
    """
    qv = embed_queries(questions)
    corpus = store.select("collection_id", F.col("chunk_id").alias("id"), "embedding")
    hits = ret.knn(corpus, qv.select("collection_id", "query_id", "variant_no", "embedding"), "collection_id", k=k,
                   id_col="id", query_cols=["collection_id", "query_id", "variant_no"])
    # chunk ids repeat across hosts: the collection is part of the key
    docs = store.select("collection_id", F.col("chunk_id").alias("id"), "content", "source", "artifact_type")
    joined = hits.join(docs, ["collection_id", "id"])
    uniq = ret.dedup_hits(joined, ["collection_id", "query_id"], "content", ["variant_no", "rank"])
    packed = ret.pack_context(uniq, ["collection_id", "query_id"], "content", "source", "artifact_type",
                              [F.col("score").desc(), "variant_no", "rank"], budget)
    q0 = questions.where(F.col("variant_no") == 0).select("collection_id", "query_id", F.col("text").alias("question"))
    return pr.prompt_table(packed.join(q0, ["collection_id", "query_id"]), "query", ["collection_id", "query_id"],
                           query=F.col("question"), context=F.col("context"))


def incident_prompts(store: DataFrame, overview_queries: DataFrame, anomalies: DataFrame, k: int = rules.HITS_FOR_CONTEXT) -> DataFrame:
    """``summary``: incident-summary prompts (PRM-2); ``overview_queries`` is ``collection_id, embedding`` of
    ``prompts.SUMMARY_QUESTION``."""
    corpus = store.select("collection_id", F.col("chunk_id").alias("id"), "embedding")
    hits = ret.knn(corpus, overview_queries.select("collection_id", "embedding"), "collection_id", k=k, id_col="id",
                   query_cols=["collection_id"])
    docs = store.select("collection_id", F.col("chunk_id").alias("id"), "content", "source", "artifact_type")
    return pr.incident_prompts(hits.join(docs, ["collection_id", "id"]), anomalies, "content", "source", "artifact_type", ["rank"])


def timeline_view(tables: dict[str, DataFrame], external_csv: DataFrame | None = None, start=None, end=None,
                  max_events: int | None = None) -> DataFrame:
    """``timeline``: external super-timeline where a collection has one, else the
    internal timeline (TL-5), inclusive range filter (FIL-7), plot rows (SNK-9)."""
    internal = tables["timeline"]
    t = tl.prefer_external(st.l2t_timeline(external_csv), internal) if external_csv is not None else internal
    return w.timeline_plot_table(tl.filter_range(t, start, end), max_events)


def export(tables: dict[str, DataFrame], fmt: str, path: str) -> None:
    """``export``: jsonl (Timesketch timeline), json (structured summary), csv
    (bodyfile with ISO times) or markdown (header + chunks)."""
    if fmt == "jsonl":
        w.write_timesketch_jsonl(tables["timeline"], path)
    elif fmt == "json":
        structured_summary(tables).select("collection_id", F.col("json").alias("value")).write.mode(
            "overwrite").partitionBy("collection_id").text(path)
    elif fmt == "csv":
        w.write_bodyfile_csv(tables["bodyfile"], path)
    elif fmt == "markdown":
        rows = w.markdown_export(build_chunks(tables), tables["collections"])
        (rows.orderBy("collection_id", "seq").select("collection_id", "text")
         .write.mode("overwrite").partitionBy("collection_id").text(path))
    else:
        raise ValueError(f"unknown export format {fmt!r}")
