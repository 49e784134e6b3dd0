"""Scalar expressions: token estimates, text shaping, safe parsing. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of the report vocabulary (fixed values).
SEVERITIES = ["致命", "严重", "一般", "提示"]
#: What a reply may conclude, and the titles of the report's blocks in their order with the conclusion of each.
CONCLUSIONS = ["维持", "反驳", "待确认"]
BLOCKS = {"维持": "维持", "待确认": "待确认", "已被反驳": "反驳"}
TITLES = list(BLOCKS)
PENDING, NO_REASON, NO_ANSWER = "待确认", "（无结论）", "多次补问后仍无结论"


def ascii_chars(text: Column) -> Column:
    """Number of ASCII characters."""
    return F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")).cast("long")


def token_estimate(ascii_total: Column, char_total: Column) -> Column:
    """A quarter of the ASCII characters, rounded half to even once, plus every other character."""
    return (F.bround(ascii_total / F.lit(4.0), 0) + (char_total - ascii_total)).cast("long")


def line_count(text: Column) -> Column:
    """Lines of a text; a final line break does not begin another line and an empty text has none."""
    breaks = F.regexp_count(text, F.lit(r"\r\n|\r|\n"))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(
        breaks + F.when(text.rlike(r"[\r\n]\z"), F.lit(0)).otherwise(F.lit(1))
    ).cast("long")


def lines(text: Column) -> Column:
    """Lines of a text as an array, without the empty piece after a final line break."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def collapse_blanks(text: Column) -> Column:
    """Runs of ASCII white space become one blank; none is left at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "), r"^ | \z", "")


def digest(text: Column, width: int = 60) -> Column:
    """The text itself, or its first ``width`` characters and its length."""
    short = F.concat(F.left(text, F.lit(width)), F.lit("…（共 "), F.length(text).cast("string"), F.lit(" 字）"))
    return F.when(F.length(text) <= width, text).otherwise(short)


def indented(text: Column, by: int = 4) -> Column:
    """Every line moved right; an empty or null text is one blank line."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^", " " * by)


def source_link(root: str, file: Column, line: Column) -> Column:
    """Markdown link to a line of a file."""
    at = F.concat(file, F.lit(":"), line.cast("string"))
    return F.concat(F.lit("["), at, F.lit(f"]({root}/"), file, F.lit("#L"), line.cast("string"), F.lit(")"))


def csv_items(text: Column) -> Column:
    """Trimmed, non-empty items of a comma-separated list."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def scrubbed_url(url: Column) -> Column:
    """A URL without scheme, credentials and final slashes."""
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^[^/@]*@", ""), r"/+\z", "")


def expanded(template: Column, values: dict[str, Column]) -> Column:
    """``${NAME}`` and ``${NAME:-default}`` replaced: a blank or null value gives the default, else nothing."""
    out = template
    for name, value in values.items():
        given = F.nullif(F.trim(value), F.lit(""))
        fallback = F.regexp_extract(out, r"\$\{" + name + r":-([^}]*)\}", 1)
        whole = F.regexp_extract(out, r"\$\{" + name + r"(?::-[^}]*)?\}", 0)
        out = F.when(whole == "", out).otherwise(F.replace(out, whole, F.coalesce(given, fallback)))
    return out


def json_candidates(text: Column) -> list[Column]:
    """What may be the JSON in a model's reply, in order: as it is, without a fence, the outermost braces; then each
    of them without trailing commas."""
    clean = F.regexp_replace(text, r"^[\x{FEFF}\s]+|\s+\z", "")
    fence = F.nullif(F.regexp_extract(clean, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(clean, r"(?s)\{.*\}", 0), F.lit(""))
    first = [clean, fence, braces]
    return first + [F.regexp_replace(c, r",\s*([}\]])", "$1") for c in first]


def extracted_variant(text: Column) -> Column:
    """The first candidate that parses, as a variant; each is parsed once and only where those before it failed."""
    return F.coalesce(*[F.try_parse_json(c) for c in json_candidates(text)])


def extracted_json(text: Column) -> Column:
    """The first candidate that parses, as JSON text; null if none does."""
    return F.to_json(extracted_variant(text))


def ranked(value: Column, order: list[str]) -> Column:
    """Position of a value in a closed list; null outside it."""
    out = F.lit(None).cast("int")
    for i, v in reversed(list(enumerate(order))):
        out = F.when(value == v, F.lit(i)).otherwise(out)
    return out


def bar(share: Column, width: int = 20) -> Column:
    """A bar of full blocks for a share between 0 and 1."""
    return F.repeat(F.lit("█"), F.bround(share * width, 0).cast("int"))


def blank_free(value: Column) -> Column:
    """Null for null and blank strings."""
    return F.when(F.trim(value) != "", value)


def worker_count(asked: Column, items: Column, most: int = 4) -> Column:
    """Workers of a run: as many as asked for, else one for each item, ``most`` at most and one at least."""
    return F.when(asked > 0, asked).otherwise(F.greatest(F.least(items, F.lit(most)), F.lit(1)))


def names_before(text: Column, mark: str) -> Column:
    """Identifiers that stand before a mark, white space between them allowed: calls where the mark is a bracket."""
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)[ \t\n]*" + mark), F.lit(1))


def line_heads(text: Column) -> Column:
    """The runs of letters that begin lines."""
    return F.regexp_extract_all(text, F.lit("(?m)^([A-Za-z]+)"), F.lit(1))


def json_field(text: Column, field: str, kind: str) -> Column:
    """One field of a JSON object as ``kind``; null where it is absent, of another type, or there is no JSON."""
    return F.from_json(text, f"`{field}` {kind}")[field]


def whole_number(text: Column) -> Column:
    """A text as a long; null where it is none."""
    return text.try_cast("bigint")
