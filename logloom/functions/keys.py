"""Keys, digests and text helpers as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL; a null part counts as empty."""
    return F.sha2(F.concat_ws("\0", *map(text_of, parts)), 256)


def prefixed_id(prefix: str, *parts: Column) -> Column:
    """A deterministic id such as msg_<digest>."""
    return F.concat(F.lit(f"{prefix}_"), digest(*parts))


def short_key(root: Column, length: int = 16) -> Column:
    """The first hex digits of the digest of a path without regard to case."""
    return F.substring(F.sha2(F.lower(root), 256), 1, length)


def content_text(parts: Column, joint: str = "\n") -> Column:
    """The texts of array<struct<kind, text, ...>>, joined."""
    return F.array_join(F.transform(parts, lambda p: p["text"]), joint)


def content_digest(parts: Column) -> Column:
    """Digest over (kind, text) of every part, in order."""
    return F.sha2(F.array_join(F.transform(parts, lambda p: F.concat_ws("\0", text_of(p["kind"]), text_of(p["text"]))), "\1"), 256)


def limit_text(c: Column, n: int) -> Column:
    """At most n characters; a longer text ends in an ellipsis."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit(ELLIPSIS))).otherwise(c)


def preview(c: Column, n: int = 500) -> Column:
    """The first n characters."""
    return F.substring(c, 1, n)


def stripped(c: Column) -> Column:
    """Without white space at both ends, by Unicode's notion of it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalized(c: Column) -> Column:
    """White space runs as one space, none at the ends, lower case."""
    return F.lower(stripped(F.regexp_replace(c, r"(?U)\s+", " ")))


def topic_key(c: Column, most: int = 120) -> Column:
    """A normalized text with underscores; beyond `most` characters cut, with a digest's head."""
    key = F.regexp_replace(normalized(c), " ", "_")
    return F.when(F.length(key) <= most, key).otherwise(F.concat(F.substring(key, 1, most - 17), F.lit("_"), F.substring(F.sha2(key, 256), 1, 16)))


def safe_filename(c: Column, most: int = 80) -> Column:
    """An id as a file name: other characters become underscores, and the changed or long ones get
    a digest's head."""
    safe = F.regexp_replace(c, r"[^A-Za-z0-9_-]", "_")
    return F.when((safe == c) & (F.length(c) <= most), c).otherwise(F.concat(F.substring(safe, 1, most - 17), F.lit("_"), F.substring(F.sha2(c, 256), 1, 16)))


def sentences(c: Column) -> Column:
    """Sentences of a text, cut after Western and CJK full stops and at line ends, without bullets
    and outer white space; empty ones left out."""
    cut = F.split(F.regexp_replace(c, r"([.!?。！？])\s*", "$1\n"), r"\n+")
    bare = F.transform(cut, lambda s: stripped(F.regexp_replace(s, r"^\s*(?:[-*+]|\d+[.)])\s+", "")))
    return F.filter(bare, lambda s: s != "")


def merged_ids(first: Column, second: Column) -> Column:
    """Distinct ids of both arrays in the order first seen."""
    return F.array_distinct(F.concat(first, second))


def iso_instant(c: Column) -> Column:
    """An ISO-8601 date and time as an instant; a naive one is UTC, any other text null."""
    whole = c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?$")
    zoned = F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), c).otherwise(F.concat(c, F.lit("Z")))
    return F.when(whole, F.try_to_timestamp(zoned))


def event_time(millis: Column, record: Column, fallback: Column | None = None) -> tuple[Column, Column]:
    """(instant, its source): the event's own milliseconds, else the record's time, else the
    fallback such as the file's time, else null."""
    own = F.timestamp_millis(millis)
    instant = F.coalesce(own, record) if fallback is None else F.coalesce(own, record, fallback)
    source = F.when(own.isNotNull(), "event").when(record.isNotNull(), "record")
    if fallback is not None:
        source = source.when(fallback.isNotNull(), "file")
    return instant, source.otherwise("unknown")


def is_stale(at: Column, now: Column, minutes: int = 10) -> Column:
    return now - at > F.make_dt_interval(mins=F.lit(minutes))


def local_time(at: Column, zone: str = "Asia/Tokyo", pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), pattern)


def label(c: Column, names: dict[str, str], unknown: str = "unknown") -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.lit(unknown))


def safe_path(c: Column) -> Column:
    """Whether a text is a relative path with forward slashes that stays inside its root."""
    return F.coalesce((c != "") & ~c.rlike(r"[\\\x00-\x1f:]") & ~c.rlike(r"^/") & ~c.rlike(r"(^|/)\.{0,2}(/|$)"), F.lit(False))


def safe_identifier(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"), F.lit(False))


def sum_of_hex(c: Column) -> Column:
    """An aggregate: the sum modulo 2**256 of 64-digit hexadecimal numbers, as such a number; nulls
    are passed over, and no row gives zero. Eight sums of 32 bits merge in any order; carries are
    taken once at the end. A sum may have 2**31 rows."""
    limbs = [F.coalesce(F.sum(F.conv(F.substring(c, 57 - 8 * k, 8), 16, 10).cast("long")), F.lit(0).cast("long")) for k in range(8)]  # lowest first
    text, carry = [], F.lit(0).cast("long")
    for limb in limbs:
        total = limb + carry
        text.insert(0, F.lpad(F.lower(F.hex(F.pmod(total, F.lit(1 << 32)))), 8, "0"))
        carry = F.shiftright(total, 32)
    return F.concat(*text)
