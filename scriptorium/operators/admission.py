"""Rules that decide whether a file is taken in, as columns: the cheap ones see names and sizes, the last the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.config import AdmissionConfig

#: Suffixes and names of files with keys.
SECRET_SUFFIXES = (".env", ".key", ".pem", ".p12", ".pfx", ".crt", ".der", ".kdbx")
SECRET_NAMES = (r"^\.env(\..+)?$", r"(?i)^credentials?", r"(?i)^secrets?", r"(?i)_rsa$", r"(?i)\.(key|pem|crt|p12|pfx)$")
#: Patterns of secrets in texts, in the order in which they are tried.
SECRET_TEXTS = (
    ("api_key", r"sk-[A-Za-z0-9]{16,}"),
    ("aws_access_key", r"AKIA[0-9A-Z]{16}"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("password", r"(?i)(password|passwd|pwd)\s*[:=]\s*\S+"),
    ("key_assignment", r"(?i)(api[_-]?key|secret|token)\s*[:=]\s*['\"]?[A-Za-z0-9_\-]{16,}"),
)
#: The ends of the words of these kinds and the sign after them, which a text must hold for their patterns to be tried: searches that
#: ignore case try several words at each place, and take most of the time of an ingest.
ASSIGNED, ASSIGNMENT = ("password", "key_assignment"), r"[wWrReE][dDyYtTnN]\s*[:=]"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last dot and what follows, in lower case; empty for names like ``.env`` and ``a.``"""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def secret_name(path: Column) -> Column:
    """The rule that a file's name breaks, or null."""
    hit = F.lit(False)
    for pattern in SECRET_NAMES:
        hit = hit | file_name(path).rlike(pattern)
    return F.when(suffix(path).isin(*SECRET_SUFFIXES), "secret_suffix").when(hit, "secret_name")


def size_rule(size: Column, config: AdmissionConfig) -> Column:
    return F.when(size == 0, "empty_file").when(size < config.min_bytes, "too_small").when(size > config.max_bytes, "too_large")


def secret_text(text: Column) -> Column:
    """The first kind of secret found in a text, or null."""
    found, assigned = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for kind, pattern in SECRET_TEXTS:
        if kind in ASSIGNED:
            assigned = assigned.when(text.rlike(pattern), kind)
        else:
            found = found.when(text.rlike(pattern), kind)
    return found.when(text.rlike(ASSIGNMENT), assigned)
