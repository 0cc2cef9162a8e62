"""Column functions on text: tokens, identity, trims, excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed value: the URL namespace of version-5 UUIDs
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: fixed values: what marks a question as Spanish
SPANISH_MARKERS = ("¿", "¡", " el ", " la ", " los ", " las ", " de ", " en ", " que ")
ELLIPSIS = "…"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text) -> Column:
    """Lower-cased runs of letters and digits of more than one character."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(r"[\p{L}\p{Nd}]{2,}"), F.lit(0))


def trim_all(text) -> Column:
    """Trims Unicode white space, which ``trim`` alone does not."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def rune_length(text) -> Column:
    return F.length(_col(text))


def tail(text, n: int) -> Column:
    """The last n characters."""
    return F.lit("") if n <= 0 else F.right(_col(text), F.lit(n))


def sha256_hex(text) -> Column:
    return F.sha2(_col(text), 256)


def uuid5(name) -> Column:
    """Version-5 UUID in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(_col(name), "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def document_id(path, content_hash) -> Column:
    """Identity of a version of a file: its path and the hash of its content."""
    return uuid5(F.concat(_col(path), F.lit("|"), _col(content_hash)))


def chunk_id(doc_id, index) -> Column:
    return uuid5(F.concat(_col(doc_id), F.lit("-"), _col(index).cast("string")))


def cache_key(prefix: str, content_hash) -> Column:
    h = _col(content_hash)
    return h if not prefix else F.sha2(F.concat(F.lit(f"{prefix}:"), h), 256)


def section_key(path) -> Column:
    return F.array_join(F.coalesce(_col(path), F.array().cast("array<string>")), "|")


def section_label(path) -> Column:
    return F.array_join(F.coalesce(_col(path), F.array().cast("array<string>")), " > ")


def language_name(text) -> Column:
    """Spanish if the text holds a marker, else English."""
    t = F.lower(F.coalesce(_col(text), F.lit("")))
    has = F.lit(False)
    for m in SPANISH_MARKERS:
        has = has | F.contains(t, F.lit(m))
    return F.when(has, "Spanish").otherwise("English")


def excerpt(text, most: int = 200) -> Column:
    """At most ``most`` bytes: cut there, or at the last space if that is among
    the last 49 bytes, with an ellipsis. A cut inside a character drops it."""
    t = F.coalesce(_col(text), F.lit(""))
    cut = F.make_valid_utf8(F.substring(F.encode(t, "UTF-8"), 1, most).cast("string"))
    cut = F.regexp_replace(cut, "�+$", "")
    words = F.regexp_replace(cut, r"(?s) [^ ]*$", "")
    short = F.when(F.contains(cut, F.lit(" ")) & (F.octet_length(words) > most - 50) & (F.octet_length(words) > 0), words).otherwise(cut)
    return F.when(F.octet_length(t) <= most, t).otherwise(F.concat(short, F.lit(ELLIPSIS)))
