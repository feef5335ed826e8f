"""Indicator extraction (IOC-1) and indicator matching (JOIN-7).

Patterns stay inside the regex subset on which Java regex and RE2 agree (no
look-around, no ``\\b``, ASCII classes).  Boundaries are kept without
look-around: an address or a hash is cut out as the whole run of characters that
it may consist of, and the run must then be one as a whole, so neither part of a
longer digit string nor an address with an octet over 255 counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IOC_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"[0-9A-Za-z_][0-9A-Za-z_.]*",
    "hash": r"[0-9A-Za-z_]{32,}",
    "url": r"https?://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+",
    "path": r"/(?:etc|tmp|var|usr|home|root|dev|opt|bin|sbin)/[A-Za-z0-9._/-]+",
    "user": r"(?:user|User|USER|for)[=: ]+[a-z_][a-z0-9_-]*",
    "command": r"COMMAND=[^ \n]+",
    "cron": r"(?:[0-9*/,-]+ +){4}[0-9*/,-]+ +/[A-Za-z0-9._/-]+",
}
IPV4_WHOLE = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
HASH_WHOLE = "^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"
NAME_AFTER = {"user": "[=: ]+([a-z_][a-z0-9_-]*)$", "command": "=(.*)$"}
DOMAIN_FROM_URL = r"^https?://([A-Za-z0-9.-]+)"


def _tagger(kind: str):
    def tag(v):
        return F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    return tag


def _named(m, kind: str):
    return F.transform(m, lambda v: F.struct(F.lit(kind).alias("kind"), F.regexp_extract(v, NAME_AFTER[kind], 1).alias("value")))


def extract_iocs(df: DataFrame, text_col: str, id_col: str, kinds: list[str] | None = None) -> DataFrame:
    """Rows ``(kind, value, id)`` for every indicator occurrence in ``text_col``.

    Hashes are typed by length (md5 / sha1 / sha256); URLs also yield their
    domain.  One projection builds all match arrays, one ``explode`` emits them.
    """
    kinds = kinds or list(IOC_PATTERNS)
    arrays = []
    for k in kinds:
        m = F.regexp_extract_all(F.col(text_col), F.lit(IOC_PATTERNS[k]), 0)
        if k == "hash":
            m = F.transform(F.filter(m, lambda v: v.rlike(HASH_WHOLE)), lambda v: F.struct(
                F.when(F.length(v) == 64, "sha256").when(F.length(v) == 40, "sha1").otherwise("md5").alias("kind"),
                F.lower(v).alias("value")))
        elif k == "ipv4":
            m = F.filter(F.transform(m, lambda v: F.rtrim(v, F.lit("."))), lambda v: v.rlike(IPV4_WHOLE))
            m = F.transform(m, _tagger(k))
        elif k in NAME_AFTER:
            m = _named(m, k)
        else:
            m = F.transform(m, _tagger(k))
        arrays.append(m)
        if k == "url":
            arrays.append(F.transform(
                F.regexp_extract_all(F.col(text_col), F.lit(IOC_PATTERNS["url"]), 0),
                lambda v: F.struct(F.lit("domain").alias("kind"),
                                   F.lower(F.regexp_extract(v, DOMAIN_FROM_URL, 1)).alias("value"))))
    allm = F.flatten(F.array(*arrays))
    return df.select(F.col(id_col).alias("id"), F.explode(allm).alias("m")).select(
        F.col("m.kind").alias("kind"), F.col("m.value").alias("value"), "id").where(F.col("value") != "")


def ioc_summary(iocs: DataFrame) -> DataFrame:
    """Per (kind, value): occurrences, distinct sources, first and last source id.

    Partial aggregation runs map-side, so a value that appears in a third of
    all rows is combined before the shuffle.
    """
    return iocs.groupBy("kind", "value").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
