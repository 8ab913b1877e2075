"""Scalar text functions: normalisation, redaction, canonical URLs, token estimates, anchor terms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeworks.functions.arrow import arrow_function

_CJK = r"[\x{4e00}-\x{9fff}]"


def token_estimate(text: Column) -> Column:
    """Ideographs plus a third of the other characters, rounded up."""
    t = F.coalesce(text, F.lit(""))
    other = F.length(F.regexp_replace(t, _CJK, ""))
    return (F.length(t) - other) + F.ceil(other / 3.0)


def collapse(text: Column) -> Column:
    """Lower-cased text with white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def strip_marks(text: Column) -> Column:
    """Lower-cased text without white space, punctuation and underscores; letters of every script stay."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\s\W_]+", "")


def letters_and_digits(text: Column) -> Column:
    """Lower-cased text without anything but letters and numbers of every script; unlike ``strip_marks`` it drops combining marks and keeps all numbers."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed a single time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bigrams(text: Column) -> Column:
    """Distinct two-character pieces; a shorter text is its own piece, an empty one has none.

    The text is cut into characters once: taking each piece from the text itself would cost its square.
    """

    def pairs(chars: Column) -> Column:
        n = F.size(chars)
        joined = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1)))
        return F.when(n == 0, F.array().cast("array<string>")).when(n < 2, chars).otherwise(F.array_distinct(joined))

    return once(F.filter(F.split(text, ""), lambda c: c != ""), pairs)


def anchor_terms(text: Column) -> Column:
    """Latin terms of two or more characters and bigrams of ideograph runs, sorted."""
    latin = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9_.=-]+"), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit(_CJK + "{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_sort(F.array_distinct(F.concat(latin, pairs)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def html_escape(text: Column) -> Column:
    """The five characters that markup reserves; ampersands first."""
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


#: What is redacted, in this order.
REDACTIONS = (
    (r"[\x00-\x1f\x7f]+", " "),
    (r"(?i)\b(api[_-]?key|access[_-]?token|token|password|secret)\b\s*[:=]\s*([^\s,;]+)", "$1=[REDACTED]"),
    (r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{8,}", "Bearer [REDACTED]"),
    (r"\bsk-[A-Za-z0-9_-]{8,}\b", "[REDACTED_API_KEY]"),
    (r"(?<![A-Za-z0-9])[A-Za-z]:[\\/](?:[^<>:\"|?*\s]+[\\/]?)+", "[LOCAL_PATH]"),
    (r"(?<![A-Za-z0-9])/(?:Users|home|tmp|var/tmp)/[^\s,;]+", "[LOCAL_PATH]"),
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[REDACTED_EMAIL]"),
)


def redact(text: Column, most: int = 4000) -> Column:
    """Text without credentials, local paths and addresses, cut to ``most`` characters; empty becomes null."""
    out = text
    for i, (pattern, with_) in enumerate(REDACTIONS):
        out = F.regexp_replace(out, pattern, with_)
        if i == 0:
            out = F.trim(out)
    return F.nullif(F.substring(out, 1, most), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Public http(s) address without query and fragment, or null.

    Null for user info, other ports than 80 and 443, local names and IP literals.
    """
    raw = F.trim(url)
    pattern = r"^([A-Za-z]+)://([^/?#]*)([^?#]*)"
    scheme, authority, path = (F.regexp_extract(raw, pattern, i) for i in (1, 2, 3))
    host = F.lower(F.regexp_extract(authority, r"^(.*?)(?::\d+)?$", 1))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    ok = (
        F.lower(scheme).isin("http", "https")
        & ~F.contains(authority, F.lit("@"))
        & port.isin("", "80", "443")
        & (host != "")
        & (host != "localhost")
        & ~F.endswith(host, F.lit(".localhost"))
        & ~F.endswith(host, F.lit(".local"))
        & ~F.rlike(host, F.lit(r"^\[|^\d+(\.\d+){3}$"))
    )
    default = ((F.lower(scheme) == "http") & (port == "80")) | ((F.lower(scheme) == "https") & (port == "443")) | (port == "")
    return F.when(ok, F.concat(F.lower(scheme), F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path)))


def source_allowed(host: Column, allow: list[str], deny: list[str]) -> Column:
    """Whether a host is one of, or below, an allowed domain and no denied one; an empty list allows all."""

    def within(domains: list[str]) -> Column:
        hit = F.lit(False)
        for d in domains:
            hit = hit | (host == d) | F.endswith(host, F.lit(f".{d}"))
        return hit

    return ~within(deny) & (within(allow) if allow else F.lit(True))


@arrow_function("string")
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no function for; whole Arrow batches at a time."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@arrow_function("string")
def casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.casefold())


def version_family(text: Column) -> Column:
    """Normal form of a version family name, or null: compatibility form, case folded, dashes for spaces, limited alphabet."""
    name = F.regexp_replace(F.trim(casefold(nfkc(text))), r"(?U)[\s-]+", "-")
    return F.when(F.length(name).between(1, 120) & F.rlike(name, F.lit(r"(?U)^\w[\w.-]*$")), name)
