"""Cell texts, headings and labels. Columns in, Columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import collapse_ws, first_match, let, reusable, text_of, trim_ws
from .numbers import is_numeric_cell

# What headings, stamps, units and totals look like.
STATEMENTS = (
    r"(?i)statement\s+of\s+financial\s+position",
    r"(?i)balance\s+sheet",
    r"(?i)statement\s+of\s+(comprehensive\s+)?income",
    r"(?i)income\s+statement",
    r"(?i)profit\s+and\s+loss",
    r"(?i)statement\s+of\s+cash\s*flows?",
    r"(?i)cash\s*flow\s+statement",
    r"(?i)statement\s+of\s+changes\s+in\s+equity",
    r"(?i)statement\s+of\s+value\s+added",
)
NOTES = r"(?i)notes?\s+to\s+(the\s+)?(financial\s+statements|accounts)"
FRONT = (
    r"(?i)corporate\s+information",
    r"(?i)notice\s+of\s+(annual\s+general\s+)?meeting",
    r"(?i)chairman'?s?\s+(statement|report|review)",
    r"(?i)report\s+of\s+the\s+directors",
    r"(?i)(independent\s+)?auditors?'?\s+report",
    r"(?i)managing\s+director'?s?\s+(review|report)",
    r"(?i)five\s+year\s+(financial\s+)?summary",
)
NOTE_HEADINGS = (
    r"(?i)^note\s*(\d{1,2}(?:\.\d{1,2})?)\s*[.:—–-]?\s*(.{2,90})$",
    r"^(\d{1,2}(?:\.\d{1,2})?)\.\s+(\S.{1,89})$",
    r"^(\d{1,2}(?:\.\d{1,2})?)\s+([A-Z][^\d].{1,88})$",
)
UNITS = (
    r"(?iu)(GH[¢C₵]|US\s*\$|\$|£|€)\s*['’]?\s*0{3}(?:'?0{3})?",
    r"(?iu)(GH[¢C₵]|US\s*\$|\$|£|€)\s*(thousands?|millions?|billions?)",
    r"(?iu)in\s+(thousands?|millions?|billions?)\s+of\s+([A-Za-z¢₵$£€ ]{2,24})",
    r"(?iu)\(\s*(GH[¢C₵]|US\$|\$|£|€)\s*['’]?0{3}\s*\)",
    r"(?iu)amounts?\s+in\s+(GH[¢C₵]|US\$|\$|£|€)\s*['’]?0{3}",
)
CURRENCY = r"(?iu)GH[¢C₵]|₵|\bGHS\b|\bUSD\b|US\$|\$|£|€|\bNGN\b"
STAMPS = (
    (r"^[\w.+-]+@[\w-]+(\.[\w-]+)+$", "email"),
    (r"(?i)^downloaded\b.*$", "download-stamp"),
    (r"(?i)^(https?:\/\/|www\.)[\w./?=&%#-]+$", "source-url"),
    (r"(?i)^(page\s+)?\d{1,4}(\s+of\s+\d{1,4})?$", "page-number"),
    (r"(?i)^(©|\(c\)\s)\s*\d{4}.*$", "copyright"),
)
#: Words that a heading's title does not end with, and how long a heading, its title and its number may be.
CONNECTIVES = ("the", "of", "and", "to", "a", "in", "for", "is", "are", "was", "were")
MAX_HEADING, MAX_TITLE_WORDS, MIN_TITLE, MAX_NOTE = 110, 12, 2, 99
#: What a printed currency is called.
CURRENCY_NAMES = ((r"GH|₵", "GHS"), (r"US|\$", "USD"), (r"^£$", "GBP"), (r"^€$", "EUR"), (r"^NGN$", "NGN"))
PERIODS = (r"(?i)(?:year|period)\s+ended\s+([\w\s]{4,30}(?:19|20)\d{2})", r"(?i)as at\s+([\w\s]{4,30}(?:19|20)\d{2})")
COMPANY, COMPANY_CHARS = r"(?i)\b(limited|ltd|plc|company|group)\b", 80
#: Three readings of "total", each for its own check.
TOTAL_IN_TABLE = r"(?i)\b(total|sub-?total|net\s+(assets|liabilities|position|cash)|aggregate|sum)\b"
TOTAL_LABEL = r"(?i)^\s*(total|sub-?total|net\b|grand\s+total)"
TOTAL_LIVE = r"(?i)^\s*(total|sub-?total|net\s|gross\s|balance\s+(at|as)\b|closing\b|profit\s+for\b)"
DATES = (
    (r"^\d{4}-\d{2}-\d{2}$", ("yyyy-MM-dd",)),
    (r"^\d{1,2}\/\d{1,2}\/\d{4}$", ("d/M/yyyy",)),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ("d-M-yyyy",)),
    (r"^\d{1,2}[- ][A-Za-z]{3,9}[- ]\d{4}$", ("d MMM yyyy", "d MMMM yyyy")),
    (r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$", ("MMM d yyyy", "MMMM d yyyy")),
)
FILE_KINDS = (
    (r"_data\.csv$", "machine csv (tidy/long)"),
    (r"_review\.csv$", "analyst csv (wide, faithful)"),
    (r"_notes\.(csv|xlsx)$", "notes-only export"),
    (r"\.csv$", "csv"),
    (r"\.xlsx?$", "excel workbook"),
    (r"\.json$", "json"),
    (r"\.txt$", "text"),
    (r"\.pdf$", "pdf"),
)


def normalise_key(value: Column) -> Column:
    """The form in which headers are compared."""
    return F.trim(F.regexp_replace(F.lower(text_of(value)), "[^a-z0-9]+", " "))


def clean_cell(value: Column, trim: bool = True, collapse: bool = True, strip_invisible: bool = True) -> Column:
    s = text_of(value)
    if strip_invisible:
        s = F.regexp_replace(F.replace(s, F.lit(" "), F.lit(" ")), r"[\x{AD}\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]", "")
    if collapse:
        s = collapse_ws(s)
    return trim_ws(s) if trim else s


def to_snake(value: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(trim_ws(text_of(value)), "['\"]", ""), "[^A-Za-z0-9]+", "_")
    return F.lower(F.regexp_replace(F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1_$2"), "^_+|_+$", ""))


def row_key(cells: list[Column], ignore_case: bool = False, ignore_whitespace: bool = False, loose: bool = False) -> Column:
    """The key that rows are compared by; loose comes after blanks are collapsed and makes the case option moot."""

    def one(c: Column) -> Column:
        s = text_of(c)
        if ignore_whitespace:
            s = trim_ws(collapse_ws(s))
        if loose:
            return normalise_key(s)
        return F.lower(s) if ignore_case else s

    return F.array_join(F.array(*[one(c) for c in cells]), "\u0001")


def similarity(a: Column, b: Column) -> Column:
    """Of two headers: Jaccard of their tokens, plus a half if one holds the other; 1 at most."""
    tokens = lambda k: F.array_distinct(F.filter(F.split(k, " "), lambda t: t != ""))

    def of(k: Column) -> Column:
        ka, kb = k["a"], k["b"]
        shared = F.size(F.array_intersect(tokens(ka), tokens(kb)))
        jaccard = shared / F.greatest(F.size(F.array_union(tokens(ka), tokens(kb))), F.lit(1))
        return F.when((ka == "") | (kb == ""), 0.0).when(ka == kb, 1.0).otherwise(F.least(F.lit(1.0), jaccard + F.when(ka.contains(kb) | kb.contains(ka), 0.5).otherwise(0.0)))

    return let(F.struct(normalise_key(a).alias("a"), normalise_key(b).alias("b")), of)


def norm_furniture(text: Column) -> Column:
    return trim_ws(collapse_ws(F.regexp_replace(F.lower(text_of(text)), r"\d", "#")))


def furniture_key(center: Column, x: Column, text: Column, bucket: float = 14.0) -> Column:
    """Text and about where it stands on its page."""
    at = lambda v: F.floor(v / bucket + 0.5).cast("string")
    return F.concat_ws("|", at(center), at(x), norm_furniture(text))


def stamp_kind(text: Column) -> Column:
    return first_match(trim_ws(text_of(text)), STAMPS)


def section_for(text: Column) -> Column:
    return first_match(text_of(text), [(NOTES, "notes"), *[(p, "statements") for p in STATEMENTS], *[(p, "front") for p in FRONT]])


def detect_units(text: Column) -> Column:
    s, found = text_of(text), F.lit(None).cast("string")
    for p in reversed(UNITS):
        found = F.when(s.rlike(p), trim_ws(collapse_ws(F.regexp_extract(s, p, 0)))).otherwise(found)
    return found


def detect_currency(text: Column) -> Column:
    return first_match(F.upper(F.regexp_extract(text_of(text), CURRENCY, 0)), CURRENCY_NAMES)


def note_heading(text: Column) -> Column:
    """struct(number, title) of a note's heading, or null: not a data row, not a sentence, not a number above 99."""
    return _headed(collapse_ws(trim_ws(text_of(text))))


def _is_title(title: Column) -> Column:
    """Words enough and no more, not a figure, and not broken off at a connective."""
    last = F.lower(F.regexp_extract(title, r"(\w+)$", 1))
    return (F.length(title) >= MIN_TITLE) & (F.size(F.split(title, " ")) <= MAX_TITLE_WORDS) & ~last.isin(*CONNECTIVES) & ~is_numeric_cell(title)


def _heading(text: Column) -> Column:
    """Each form reads a number and a title, or nothing; the first that reads a good title counts."""
    read = lambda p: F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).alias("number"), F.regexp_replace(trim_ws(F.regexp_extract(text, p, 2)), "[.:;,]+$", "").alias("title")))
    good = lambda h: h.isNotNull() & (h["number"].try_cast("double") <= MAX_NOTE) & _is_title(h["title"])
    return F.when((text != "") & (F.length(text) <= MAX_HEADING), F.get(F.filter(F.array(*[read(p) for p in NOTE_HEADINGS]), good), F.lit(0)))


_headed = reusable(_heading)


def period_label(text: Column) -> Column:
    found = F.array(*[F.nullif(trim_ws(F.regexp_extract(text_of(text), p, 1)), F.lit("")) for p in PERIODS])
    return F.get(F.array_compact(found), F.lit(0))


def is_company(text: Column) -> Column:
    return text_of(text).rlike(COMPANY) & (F.length(text) < COMPANY_CHARS)


def looks_like_date(value: Column) -> Column:
    """One of five forms and a day that the calendar has."""
    s = trim_ws(text_of(value))
    words = F.replace(F.replace(s, F.lit("-"), F.lit(" ")), F.lit(","), F.lit(""))
    found = F.lit(False)
    for p, forms in DATES:
        # Month names are parsed in title case, without the marks around them.
        source = F.initcap(F.lower(words)) if "MMM" in forms[0] else s
        for form in forms:
            found = found | (s.rlike(p) & F.try_to_timestamp(source, F.lit(form)).isNotNull())
    return found


def is_total(label: Column, kind: str = TOTAL_IN_TABLE) -> Column:
    return text_of(label).rlike(kind)


def escape_html(value: Column) -> Column:
    s = text_of(value)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def filename_base(name: Column) -> Column:
    s = F.regexp_replace(F.when(text_of(name) == "", "export").otherwise(text_of(name)), r"\.[^.]+$", "")
    s = F.regexp_replace(F.regexp_replace(s, "(?i)[^a-z0-9_-]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "export").otherwise(s)


def content_size(text: Column) -> Column:
    return F.octet_length(text_of(text)).cast("long")


def kind_from_name(name: Column) -> Column:
    return F.coalesce(first_match(F.lower(text_of(name)), FILE_KINDS), F.lit("file"))


def markup_text(html: Column) -> Column:
    """Text of markup: tags out, blanks collapsed."""
    return trim_ws(collapse_ws(F.regexp_replace(text_of(html), "<[^>]+>", " ")))

