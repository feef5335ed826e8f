"""Scalar Column functions (JVM-side, codegen friendly).

Every helper takes and returns ``pyspark.sql.Column`` objects so it can be
used inside ``select`` / ``where`` on batch and streaming frames alike.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules

# Characters Python's ``str.strip()`` removes (ASCII blanks, the file/group/
# record/unit separators and the Unicode space characters).
_PY_SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PY_STRIP_REGEX = rf"^[{_PY_SPACE}]+|[{_PY_SPACE}]+$"
# Java's Unicode whitespace class (?U)\s is White_Space, i.e. Python's set minus
# the four separators \x1c-\x1f, which are added; much faster than listing ranges.
PY_BLANKS_REGEX = r"(?U)[\s\x1c-\x1f]+"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same set as literal characters, for ``btrim`` (no regex on the hot path).
PY_SPACE_CHARS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                  + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(c) -> Column:
    """Python ``str.strip()`` with no arguments (character-set trim, no regex)."""
    return F.btrim(col_(c), F.lit(PY_SPACE_CHARS))


def is_digits(c) -> Column:
    """``str.isdigit()`` for ASCII digits: non-empty and only 0-9 (no regex)."""
    c = col_(c)
    return (F.length(c) > 0) & (F.length(F.translate(c, "0123456789", "")) == 0)


def py_split_ws(c, max_parts: int = -1) -> Column:
    """Python ``str.split(None, max_parts - 1)`` for an already stripped string.

    An empty string gives an empty array (as in Python).
    """
    c = col_(c)
    parts = F.split(c, PY_BLANKS_REGEX, max_parts)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(parts)


def part(arr: Column, i: int) -> Column:
    """0-based array element, NULL when absent (never fails under ANSI)."""
    return F.get(arr, i)


def digits_or(c, default) -> Column:
    """``int(x) if x.isdigit() else default`` (ASCII digits)."""
    c = col_(c)
    default_col = default if isinstance(default, Column) else F.lit(default)
    return F.when(is_digits(c), c.try_cast("bigint")).otherwise(default_col.cast("bigint"))


def epoch_to_ts(c) -> Column:
    """Epoch seconds to TIMESTAMP, NULL when the value is 0 or negative."""
    c = col_(c)
    return F.when(c > 0, F.timestamp_seconds(c))


def iso_text(ts) -> Column:
    """ISO-8601 text of a timestamp (seconds, fraction only when non-zero)."""
    ts = col_(ts)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(ts, "SSSSSS")
    return F.when(ts.isNull(), F.lit(None).cast("string")).when(
        frac == "000000", whole).otherwise(F.concat(whole, F.lit("."), frac))


def base_name(path) -> Column:
    """``pathlib.Path(p).name``: last component, trailing slashes ignored."""
    p = col_(path)
    trimmed = F.when(p.endswith("/"), F.regexp_replace(p, "/+$", "")).otherwise(p)
    return F.substring_index(trimmed, "/", -1)


def parent_dir(path) -> Column:
    """``str(pathlib.Path(p).parent)``: '.' for a bare name, '/' for top level."""
    p = col_(path)
    # regexes only for the rare trailing-slash case; the rest is string functions
    trimmed = F.when(~p.endswith("/"), p).when(p.rlike("^/+$"), F.lit("/")).otherwise(F.regexp_replace(p, "/+$", ""))
    last = F.substring_index(trimmed, "/", -1)
    head = F.substring(trimmed, F.lit(1), F.length(trimmed) - F.length(last) - 1)
    return (
        F.when(trimmed == "/", F.lit("/"))
        .when(~trimmed.contains("/"), F.lit("."))
        .when(head == "", F.lit("/"))
        .otherwise(head)
    )


def exe_name(command) -> Column:
    """Executable name: first blank-separated token after its last '/'; '' if blank."""
    tokens = py_split_ws(py_strip(command))
    first = F.coalesce(part(tokens, 0), F.lit(""))
    return F.coalesce(F.element_at(F.split(first, "/"), -1), F.lit(""))


def first_token(command) -> Column:
    tokens = py_split_ws(py_strip(command))
    return F.coalesce(part(tokens, 0), F.lit(""))


def contains_any(c, needles: list[str]) -> Column:
    """True when any of the literal substrings occurs in ``c``."""
    c = col_(c)
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def token_estimate(c) -> Column:
    """Rough token count: floor(chars / 4)."""
    return F.floor(F.length(col_(c)) / rules.CHARS_PER_TOKEN).cast("bigint")


def hash_kind(c) -> Column:
    n = F.length(col_(c))
    return F.when(n == 32, "md5").when(n == 40, "sha1").when(n == 64, "sha256")


def severity_rank(c) -> Column:
    m = F.create_map(*[x for i, s in enumerate(rules.SEVERITY_ORDER) for x in (F.lit(s), F.lit(i))])
    return F.element_at(m, col_(c))


def title_case(c) -> Column:
    """Python ``str.title()`` for ASCII words separated by any non-letter."""
    # initcap only splits on blanks; Python also capitalises after '_' etc.
    # Group names are short fixed words, so a word-boundary rewrite is enough.
    c = col_(c)
    return F.regexp_replace(F.initcap(F.regexp_replace(c, "([^A-Za-z])", "$1 ")), "([^A-Za-z]) ", "$1")


def _split_last_colon(s: Column):
    """(head, tail) around the last ':' using string functions only."""
    tail = F.substring_index(s, ":", -1)
    head = F.substring(s, F.lit(1), F.length(s) - F.length(tail) - 1)
    return head, tail


def addr_port_text(c) -> Column:
    """Address/port split used for netstat text lines.

    '' or '*:*' -> ('*', 0); '[v6]:n...' -> (v6, n); otherwise split at the last
    ':' (non-digit port -> 0); no ':' -> (text, 0).  Only the bracket form
    needs a regex, and it is evaluated only for values starting with '['.
    """
    s = col_(c)
    head, tail = _split_last_colon(s)
    bracket = r"^\[([^\]]+)\]:([0-9]+)"
    is_br = s.startswith("[") & s.rlike(bracket)
    star = s.isNull() | (s == "") | (s == "*:*")
    addr = (
        F.when(star, F.lit("*"))
        .when(is_br, F.regexp_extract(s, bracket, 1))
        .when(s.contains(":"), head)
        .otherwise(s)
    )
    port = (
        F.when(star, F.lit(0))
        .when(is_br, F.regexp_extract(s, bracket, 2).try_cast("int"))
        .when(s.contains(":") & is_digits(tail), tail.try_cast("int"))
        .otherwise(F.lit(0))
    )
    return F.struct(addr.alias("address"), port.cast("int").alias("port"))


def addr_port_plain(c) -> Column:
    """Address/port split used for YAML text output: last ':' only."""
    s = col_(c)
    head, tail = _split_last_colon(s)
    addr = F.when(s.contains(":"), head).otherwise(s)
    port = F.when(s.contains(":") & is_digits(tail), tail.try_cast("int")).otherwise(F.lit(0))
    return F.struct(addr.alias("address"), port.cast("int").alias("port"))


def glob_to_regex(pattern: str) -> str:
    """Translate an fnmatch-style glob into an anchored Java regex.

    ``*`` matches any run (also across '/'), ``?`` one character, ``[seq]`` and
    ``[!seq]`` character sets; everything else is literal.  Case-sensitive.
    """
    out = []
    i, n = 0, len(pattern)
    while i < n:
        ch = pattern[i]
        i += 1
        if ch == "*":
            while i < n and pattern[i] == "*":
                i += 1
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            j = i
            if j < n and pattern[j] == "!":
                j += 1
            if j < n and pattern[j] == "]":
                j += 1
            while j < n and pattern[j] != "]":
                j += 1
            if j >= n:
                out.append(r"\[")
            else:
                body = pattern[i:j]
                i = j + 1
                neg = body.startswith("!")
                if neg:
                    body = body[1:]
                body = body.replace("\\", "\\\\").replace("[", r"\[").replace("&&", r"&\&")
                if body.startswith("^"):
                    body = "\\" + body
                out.append("[" + ("^" if neg else "") + body + "]")
        else:
            out.append(re.escape(ch) if not ch.isalnum() else ch)
    return "(?s)^" + "".join(out) + "$"


_GROUP_SEP = "\u0001"


def regex_groups(c, regex: str, n_groups: int) -> Column:
    """Array of the ``n_groups`` capture groups of an anchored regex, NULL on no match.

    One ``rlike`` plus one ``regexp_replace`` instead of a regex run per group;
    the last group keeps any separator character it contains (split limit).
    """
    c = col_(c)
    template = _GROUP_SEP.join(f"${i}" for i in range(1, n_groups + 1))
    return F.when(c.rlike(regex), F.split(F.regexp_replace(c, regex, template), _GROUP_SEP, n_groups))


_FIELD = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)\}")


def fill(template: str, **fields) -> Column:
    """Fill ``{name}`` fields of a text template from Columns.

    A NULL value prints as ``None`` (Python f-string behaviour of the report
    texts); numbers print in their plain string form.
    """
    parts: list[Column] = []
    pos = 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        v = fields[m.group(1)]
        v = v if isinstance(v, Column) else F.col(v)
        parts.append(F.coalesce(v.cast("string"), F.lit("None")))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")


def fence(df, cols: list[str] | None = None, keep: tuple[str, ...] = ()):
    """Return ``df`` behind a ``Generate`` node (``inline`` of a one-element array).

    Filters on the outputs of a Generate are not pushed below it, so later
    predicates on parsed columns cannot inline (and re-run) the regex
    projections that produced them.  One row in, one row out.  Columns of ``keep``
    go round the node: predicates on them are pushed below it.
    """
    cols = cols or df.columns
    fenced = df.select(*keep, F.inline(F.array(F.struct(*[F.col(c) for c in cols if c not in keep]))))
    return fenced.select(*cols) if keep else fenced
