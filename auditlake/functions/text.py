"""Column functions on text: names, tokens, lines, fences, paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode text processing counts it, and word characters.
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
WORD = r"[\p{L}\p{N}_]+"
SPACES = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Trim white space on both ends."""
    return F.btrim(_col(c), F.lit(SPACES))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def replace_each(text: Column, pattern: str, group: int, by: Callable[[Column], Column]) -> Column:
    """Every match replaced by what ``by`` makes of one of its groups."""

    def replaced(t: Column) -> Column:
        pieces = F.split(t, pattern, -1)
        made = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), by)
        joined = F.array_join(F.zip_with(pieces, made, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(t.rlike(pattern), joined).otherwise(t)

    return once(text, replaced)


def character(digits: Column, base: int) -> Column:
    """Character of a code point in decimal or hexadecimal digits; what is none gives the replacement character."""
    code = F.conv(digits, base, 10).cast("bigint")
    fine = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(fine, code).otherwise(F.lit(0xFFFD).cast("bigint"))), 8, "0")), "UTF-32")


def normalize_name(c: str | Column) -> Column:
    """Concept-name slug: lower case, ``&`` spelled out, words joined by single hyphens."""
    slug = F.replace(F.lower(_col(c)), F.lit("&"), F.lit("and"))
    slug = F.regexp_replace(slug, rf"[^a-z0-9{SPACE}\-]", "")
    slug = F.regexp_replace(slug, rf"[{SPACE}\-]+", "-")
    slug = F.btrim(slug, F.lit("-"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("concept"))


def tokens(c: str | Column) -> Column:
    """All lower-cased words of a text, in order and with repeats."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(f"({WORD})"), F.lit(1))


def lines(c: str | Column) -> Column:
    """Lines of a text; a final line break adds no line, and an empty text has none."""
    text = F.regexp_replace(_col(c), "\r\n?", "\n")
    empty = F.array().cast("array<string>")
    return F.when(_col(c) == "", empty).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1))


def line_count(c: str | Column) -> Column:
    """Number of lines without building the array of lines."""
    text = F.regexp_replace(_col(c), "\r\n?", "\n")
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    open_end = F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)
    return breaks + open_end


def local_name(c: str | Column) -> Column:
    """Last path segment of an IRI, then what follows its last ``#``."""
    return F.substring_index(F.substring_index(_col(c), "/", -1), "#", -1)


def strip_fence(c: str | Column) -> Column:
    """Body of a text that is one fenced code block; any other text only trimmed."""
    whole = strip(c)
    pattern = r"(?s)^```[^\n]*\n(?:(.*)\n)?[ \t]*```$"
    return F.when(whole.rlike(pattern), strip(F.regexp_extract(whole, pattern, 1))).otherwise(whole)


def table_name(path: str | Column) -> Column:
    """Table name of a data file: its stem with ``-`` and ``.`` as underscores, lower case."""
    base = F.substring_index(_col(path), "/", -1)
    stem = F.regexp_replace(base, r"^(\.*[^.].*)\.[^.]*$", "$1")
    return F.lower(F.translate(stem, "-.", "__"))


def clean_header(names: str | Column) -> Column:
    """Header cells trimmed, blank ones dropped."""
    return F.filter(F.transform(_col(names), strip), lambda n: n != "")


def encode_list(c: str | Column) -> Column:
    """Array as JSON text."""
    return F.to_json(_col(c))


def decode_list(c: str | Column) -> Column:
    """JSON text as an array of strings; anything else gives an empty array."""
    empty = F.array().cast("array<string>")
    return F.coalesce(F.from_json(_col(c), "array<string>"), empty)


def numbered_line(position: str | Column, line: str | Column) -> Column:
    """``position: line`` with a zero-based position."""
    return F.concat(_col(position).cast("string"), F.lit(": "), _col(line))


def global_line(chunk_start: str | Column, relative: str | Column) -> Column:
    """Line number in the file of a zero-based line of a chunk."""
    return _col(chunk_start) + _col(relative)


def relative_path(path: str | Column, base: str) -> Column:
    """Path below ``base`` made relative; other paths unchanged."""
    root = base.rstrip("/") + "/"
    return F.when(F.startswith(_col(path), F.lit(root)), F.substring(_col(path), len(root) + 1, 2**31 - 1)).otherwise(
        _col(path)
    )


def fixed(value: Column, digits: int = 2) -> Column:
    """Fixed-decimal text of a non-negative number, rounded on its exact binary value, ties to even.

    Spark's own formatting rounds the shortest decimal form half up, which differs where
    that form ends in a 5 just past the last digit. There the remainder of the division
    that yields the number, taken exactly, tells on which side of the tie it lies.
    """
    x = value.cast("double")
    scale = 10 ** (digits + 1)
    m = F.round(x * scale)
    tie = (F.pmod(m.cast("bigint"), F.lit(10)) == 5) & (x == m / scale)
    upper = x * 134217729.0
    high = upper - (upper - x)
    product = x * scale
    rest = (m - product) - ((high * scale - product) + (x - high) * scale)
    down, up = (m - 5) / scale, (m + 5) / scale
    even = F.pmod(F.floor(m / 10), F.lit(2)) == 0
    settled = F.when(rest > 0, down).when(rest < 0, up).when(even, down).otherwise(up)
    return F.format_string(f"%.{digits}f", F.when(tie, settled).otherwise(x))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` of ``whole`` as fixed-decimal text with a percent sign; 0 for an empty whole."""
    share = F.when(whole > 0, part / whole * F.lit(100.0)).otherwise(F.lit(0.0))
    return F.concat(fixed(share, digits), F.lit("%"))


def fenced_blocks(c: str | Column, language: str = "mermaid") -> Column:
    """Non-blank bodies of all fenced blocks of one language, in order."""
    found = F.regexp_extract_all(_col(c), F.lit(rf"(?s)```{language}\s*\n(.*?)\n\s*```"), F.lit(1))
    return F.filter(F.transform(found, strip), lambda b: b != "")


def url_base64(c: str | Column) -> Column:
    """URL-safe base64 of the UTF-8 text, on one line."""
    raw = F.base64(F.encode(_col(c), "UTF-8"))
    return F.translate(F.regexp_replace(raw, r"[\r\n]", ""), "+/", "-_")


def chunk_word_limit(total_words: int, chunks: Column) -> Column:
    """Words allowed per chunk: an equal share, at least 50."""
    return F.greatest(F.lit(50).cast("bigint"), F.floor(F.lit(total_words) / chunks))


def name_parts(c: str | Column) -> Column:
    """Distinct lower-case words of an identifier written in camel, dot, dash or snake case."""
    spaced = F.regexp_replace(_col(c), r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(spaced), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))))
