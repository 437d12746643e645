"""Text, date and identifier functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.binding import bind

# The code points that count as white space, as a regex class body.
SPACE_CLASS = r"\t\n\x0B\f\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACES = "".join(
    map(chr, [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# Byte limits of prompts and embedding inputs, character limit of a message.
PROMPT_BYTES = 12000
EMBED_BYTES = 8000
MESSAGE_CHARS = 3800

TAG = "<[^>]*>"


def trim_space(text: Column) -> Column:
    """Trim every Unicode white-space character, not only blanks."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return F.coalesce(trim_space(text), F.lit("")) == ""


def strip_html(text: Column) -> Column:
    """Tags become a blank, white space collapses. Entities and scripts stay."""
    untagged = F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, TAG, " ")).otherwise(text)
    # the Unicode \\s is exactly SPACES, and matches faster than the spelled-out class
    return F.trim(F.regexp_replace(untagged, r"(?U)\s+", " "))


def to_plain_text(text: Column) -> Column:
    """Tags vanish, then the four entities are decoded once.

    ``&amp;`` goes last, so the result of one decoding is never decoded again.
    """
    out = F.regexp_replace(text, TAG, "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def escape_html(text: Column, quotes: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    if quotes:
        pairs.append(('"', "&quot;"))
    for char, entity in pairs:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def truncate_bytes(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes plus an ellipsis, never cutting through a character."""
    raw = text.cast("binary")

    def splits(size: int) -> Column:
        following = F.hex(F.substring(raw, size + 1, 1))
        return following.between("80", "BF")  # a UTF-8 continuation byte

    size = F.lit(max(limit - 3, 0))
    for candidate in (limit - 2, limit - 1, limit):
        size = F.when(~splits(max(candidate, 0)), F.lit(max(candidate, 0))).otherwise(size)
    cut = F.substring(raw, F.lit(1), size).cast("string")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(cut, F.lit("...")))


def split_message(text: Column, limit: int = MESSAGE_CHARS) -> Column:
    """One piece if the *bytes* fit, else pieces of ``limit`` *characters*."""
    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % limit), F.lit(0))
    return F.when(F.octet_length(text) <= limit, F.array(text)).otherwise(pieces)


def format_summary(summary: Column, takeaways: Column) -> Column:
    lines = F.array_join(F.transform(takeaways, lambda t: F.concat(F.lit("• "), F.coalesce(t, F.lit("")))), "\n")
    with_takeaways = F.concat(summary, F.lit("\n\n💡 Key Takeaways:\n"), lines)
    return trim_space(F.when(F.size(takeaways) > 0, with_takeaways).otherwise(summary))


# The summarising instruction; ``publication`` is the caller's title.
INSTRUCTION = """Read the article below for the readers of {publication} and answer with one JSON object of three fields:
- three_line_summary: what it says, in three short sentences.
- key_takeaways: a list of two things a reader can put to use.
- quality_score: a whole number between 1 and 10, where 1 means empty and 10 means thorough.

Article Title: """


def build_prompt(title: Column, content: Column, publication: str = "the daily digest") -> Column:
    return F.concat(
        F.lit(INSTRUCTION.format(publication=publication)), title,
        F.lit("\nArticle Content:\n"), truncate_bytes(content, PROMPT_BYTES), F.lit("\n"),
    )


def digest_date(when: Column) -> Column:
    return F.date_format(when, "EEEE, dd MMM yyyy")


def day_start(when: Column) -> Column:
    return F.date_trunc("DAY", when)


# Zone names of the mail date format, as offsets.
ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}
DATE_PATTERNS = (
    "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yy HH:mm:ss Z",
    "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy",
)


def parse_feed_date(text: Column) -> Column:
    """Mail-style or ISO dates to a timestamp; anything else is null."""
    offsets = F.create_map(*[F.lit(v) for pair in ZONES.items() for v in pair])

    def with_offset(bare: Column) -> Column:
        offset = F.try_element_at(offsets, F.upper(F.regexp_extract(bare, r"\s([A-Za-z]{1,4})$", 1)))
        numeric = F.regexp_replace(bare, r"([+-]\d\d):(\d\d)$", "$1$2")
        return F.coalesce(F.concat(F.regexp_replace(bare, r"[A-Za-z]{1,4}$", ""), offset), numeric)

    def read(bare: Column) -> Column:
        mail = bind(with_offset(bare), lambda m: F.coalesce(*[F.try_to_timestamp(m, F.lit(p)) for p in DATE_PATTERNS]))
        return F.when(bare.rlike(r"^\d{4}-"), bare.try_cast("timestamp")).otherwise(mail)

    return bind(F.regexp_replace(trim_space(text), r"^[A-Za-z]+,?\s+(?=\d)", ""), read)


UUID_TEXT = r"^(?:(?:urn:uuid:)?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\{[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\}|[0-9a-f]{32})$"


def _dashed(hex32: Column) -> Column:
    parts = [F.substring(hex32, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def is_uuid(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(UUID_TEXT), F.lit(False))


def canonical_uuid(text: Column) -> Column:
    """The dashed lower-case form of any accepted spelling; null when it is no UUID."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(text), "^urn:uuid:", ""), "[{}-]", "")
    return F.when(is_uuid(text), _dashed(digits))


def uuid_from(text: Column) -> Column:
    """An id that a retried task computes again, unlike a random one."""
    return _dashed(F.md5(text.cast("binary")))
