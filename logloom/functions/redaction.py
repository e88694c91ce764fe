"""Masking of secrets. Text that is masked already stays as it is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Detector:
    name: str
    kind: str
    pattern: str  # group 1, if there is one, is kept before the mark

    @property
    def mark(self) -> str:
        return f"[REDACTED:{self.kind.upper()}]"


# The names of detectors, the kinds of what they mask, and the names of secrets by kind.
SECRETS = {
    "api_key": r"(?:[a-z0-9]+[_-])*(?:api_?key|access_?key|secret_?key)",
    "token": r"(?:[a-z0-9]+[_-])*(?:token|client_?secret)",
    "password": r"(?:[a-z0-9]+[_-])*(?:password|passwd|pwd)",
    "private_key": r"(?:[a-z0-9]+[_-])*private_?key",
}
_OPEN = r"(?!\[REDACTED:)"

#: In this order: what an earlier detector masked, a later one doesn't see. The patterns are our own.
DETECTORS = [
    Detector("pem_private_key", "private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    Detector("url_userinfo", "url_credential", rf"([a-z][a-z0-9+.-]*://){_OPEN}[^\s/:@]+:[^\s/@]+(?=@)"),
    Detector("windows_user_profile", "local_path", r"(?i)\b[A-Z]:[\\/]+Users[\\/]+[^\s\"'<>|]+"),
    Detector("unix_home_directory", "local_path", r"(?<![\w./-])(?:/home|/Users|/data/data/com\.termux/files/home)/[^\s\"'<>|:,;]+"),
    Detector("ssh_account", "account", rf"(\bssh\s+(?:[^\s@]+\s+)*){_OPEN}[A-Za-z0-9._-]+(?=@)"),
    Detector("authorization_header", "token", rf"(?i)(\b(?:proxy-)?authorization\s*:\s*(?:bearer|basic|token)\s+){_OPEN}[A-Za-z0-9._~+/=-]+"),
    *[Detector("json_sensitive_field", kind, rf'(?i)("{names}"\s*:\s*"){_OPEN}[^"\\]+(?=")') for kind, names in SECRETS.items()],
    *[Detector("sensitive_command_option", kind, rf"(?i)((?<!\S)--{names}(?:\s+|=)){_OPEN}[^\s\"'-][^\s\"']*") for kind, names in SECRETS.items()],
    Detector("sensitive_assignment", "token", r"(?i)(\b(?:access_|refresh_|auth_)?token\s*[=:]\s*[\"'])[^\"'\[\]\s]{6,}(?=[\"'])"),
    *[Detector("sensitive_assignment", kind, rf"(?i)(\b{names}\s*[=:]\s*[\"']?){_OPEN}[^\"'\[\]\s,;]{{4,}}") for kind, names in SECRETS.items()],
    Detector("known_api_key_format", "api_key", r"\b(?:sk-(?:ant-)?[A-Za-z0-9_-]{16,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,})\b"),
    Detector("known_token_format", "token", r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)"),
]
#: What is masked already, by whatever wrote the text.
EXISTING = "existing_marker"
KINDS = ("api_key", "token", "password", "private_key", "url_credential", "local_path", "account")


def redact(c: Column, detectors: list[Detector] = DETECTORS) -> Column:
    for d in detectors:
        grouped = "(" in d.pattern.replace("(?", "").replace(r"\(", "")
        c = F.regexp_replace(c, d.pattern, ("$1" if grouped else "") + d.mark)
    return c


def masked(c: Column, detectors: list[Detector] = DETECTORS) -> Column:
    """struct<text, redactions>: the masked text, and array<struct<detector, type, n>> of the
    detectors that mask something in it, and of the marks that it has already.

    Each detector sees what those before it left. The text on the way is bound once a step, as the
    one element of an array, so that the expression grows by a step with each detector and no
    replacement is done twice.
    """
    entry = lambda name, kind, n: F.struct(F.lit(name).alias("detector"), F.lit(kind).alias("type"), n.alias("n"))
    found = F.array(*(entry(EXISTING, kind, marks_left(c, kind)) for kind in KINDS)) if detectors is DETECTORS else F.array().cast("array<struct<detector:string,type:string,n:int>>")
    steps = F.array(F.struct(c.alias("text"), found.alias("found")))
    def step(d: Detector):
        return lambda s: F.struct(redact(s["text"], [d]).alias("text"), F.array_append(s["found"], entry(d.name, d.kind, F.regexp_count(s["text"], F.lit(d.pattern)))).alias("found"))

    for d in detectors:
        steps = F.transform(steps, step(d))
    last = F.transform(steps, lambda s: F.struct(s["text"].alias("text"), F.filter(s["found"], lambda x: x["n"] > 0).alias("redactions")))
    return F.element_at(last, 1)


def redactions(c: Column, detectors: list[Detector] = DETECTORS) -> Column:
    """array<struct<detector, type, n>> as of masked."""
    return masked(c, detectors)["redactions"]


def marks_left(c: Column, kind: str) -> Column:
    """How many marks of a kind a text still holds, after cuts."""
    return F.regexp_count(c, F.lit(rf"\[REDACTED:{kind.upper()}\]"))


def redact_parts(parts: Column) -> Column:
    """The same for content, array<struct<kind, text, source_type>>; adds each part's redactions."""
    both = F.transform(parts, lambda p: F.struct(p["kind"].alias("kind"), masked(p["text"]).alias("m"), p["source_type"].alias("source_type")))
    return F.transform(both, lambda p: F.struct(p["kind"].alias("kind"), p["m"]["text"].alias("text"), p["source_type"].alias("source_type"), p["m"]["redactions"].alias("redactions")))


def assert_masked(is_masked: Column, value: Column) -> Column:
    """The value; a row that isn't masked stops the job."""
    return F.when(F.coalesce(is_masked, F.lit(False)), value).otherwise(F.raise_error(F.lit("a row isn't masked")))


def kept_redactions(found: Column, text: Column) -> Column:
    """Of a list of redactions (type, detector), in order, as many of each type as the text still
    has marks of it."""
    def of(kind: str) -> Column:
        return F.slice(F.filter(found, lambda r: r["type"] == kind), F.lit(1), marks_left(text, kind))

    return F.flatten(F.array(*map(of, KINDS)))
