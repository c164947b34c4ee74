"""Scalar rules of the engine as Column expressions: one place for every pattern and bound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that queries leave out. The index holds all words.
STOP_WORDS = (
    "a an the is are was were be been have has had do does did will would can could should may might shall i you he she it we they "
    "what which who when where why how in on at to for of with by from and or but not no nor"
).split()

#: Bounds of the search and of cleaning. Lengths are bytes.
SHORT, PREFIX, PREFIX_EXTRA, ONE_EDIT = 3, 3, 2, 7
HEADER_LINES, FOOTER_LINES, REPEATS, ZONE_SHARE = 10, 5, 3, (4, 5)
SLUG_DROPS = ".()"


#: Extensions of the files that are taken in, and their kinds.
EXTENSIONS = {"pdf": "pdf", "docx": "office", "doc": "office", "pptx": "office", "ppt": "office", "txt": "text"}


def text(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def slug(stem: Column | str) -> Column:
    """Lower case, blanks as hyphens, dots and parentheses dropped."""
    return F.translate(F.replace(F.lower(text(stem)), F.lit(" "), F.lit("-")), SLUG_DROPS, "")


def kind_of(path: Column | str) -> Column:
    """Kind of a source by the extension of its file name, whatever the case; null for others."""
    ext = F.lower(F.regexp_extract(text(path), r"\.([^./\\]+)$", 1))
    out = F.lit(None).cast("string")
    for kind in sorted(set(EXTENSIONS.values())):
        out = F.when(ext.isin(*[e for e, k in EXTENSIONS.items() if k == kind]), kind).otherwise(out)
    return out


def normal_line(line: Column | str) -> Column:
    """Runs of Unicode white space become one blank; ends are trimmed, letters lower-cased."""
    return F.lower(F.trim(F.regexp_replace(text(line), r"(?U)\s+", " ")))


def is_page_marker(normal: Column | str) -> Column:
    return text(normal).rlike(r"^page [0-9]+( of [0-9]+)?$")


def is_contents_row(line: Column | str) -> Column:
    return text(line).contains(".....")


def in_zone(at: Column, lines: Column) -> Column:
    """Whether a line, counted from 0, is among the first or last of its page."""
    return (at < HEADER_LINES) | (at + FOOTER_LINES >= lines)


def within_typo(word: Column, term: Column) -> Column:
    """Few enough edits by character: one for terms up to ONE_EDIT bytes, two for longer ones, none under four bytes."""
    size = F.octet_length(term)
    most = F.when(size <= ONE_EDIT, 1).otherwise(2)
    near = F.abs(F.octet_length(word) - size) <= most
    return (size > SHORT) & near & (F.call_function("levenshtein", word, term, most) >= 0)  # -1 as soon as it has more


def matches(word: Column, term: Column) -> Column:
    """Whether an indexed word answers a query term: equal for one or two bytes, prefix for three, else part or typo."""
    size = F.octet_length(term)
    return (
        F.when(size < PREFIX, word == term)
        .when(size == PREFIX, word.startswith(term) & (F.octet_length(word) <= PREFIX + PREFIX_EXTRA))
        .otherwise(word.contains(term) | within_typo(word, term))
    )


def score(freq: Column, tokens: Column) -> Column:
    """Occurrences per thousand words, rounded down."""
    return F.floor(freq * 1000 / F.greatest(tokens, F.lit(1))).cast("long")


def pages_start(pages: str) -> Column:
    """First page of a column of ranges such as `3-8`; null if it isn't a number."""
    return F.expr(f"try_cast(trim(split_part({pages}, '-', 1)) AS INT)")


def header_field(block: Column | str, name: str) -> Column:
    """Value of the first line `name: value` of a header block; null without one, empty if it has no value."""
    return F.trim(F.get(F.regexp_extract_all(text(block), F.lit(rf"(?m)^{name}: (.*)$"), F.lit(1)), F.lit(0)))


def query_terms(query: str) -> list[str]:
    """Terms of a query: lower-cased, cut at what is no letter or digit, without stop words; repeated terms stay."""
    import regex  # only where queries are parsed

    return [t for t in regex.findall(r"[\p{Alphabetic}\p{N}]+", query.lower()) if t not in STOP_WORDS]


def safe_name(name: str) -> bool:
    """Whether a name may be part of a path: not empty, no slash, backslash or two dots."""
    return bool(name) and not any(x in name for x in ("/", "\\", ".."))
