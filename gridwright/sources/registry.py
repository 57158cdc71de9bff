"""Which reader takes a file: by extension, then by content type; the highest priority wins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Extractor:
    id: str
    extensions: tuple[str, ...]
    mimes: tuple[str, ...] = ()
    priority: int = 0
    read: Callable | None = None

    def accepts(self, name: str, mime: str = "") -> bool:
        ext = name.rpartition(".")[2].lower() if "." in name else ""
        if ext in self.extensions:
            return True
        return any(mime.lower().startswith(m[:-1]) if m.endswith("/*") else mime.lower() == m for m in self.mimes)


_found: dict[str, Extractor] = {}


def register(extractor: Extractor) -> Callable[[], None]:
    _found[extractor.id] = extractor
    return lambda: _found.pop(extractor.id, None)


def unregister(id: str) -> None:
    _found.pop(id, None)


def extractors() -> list[Extractor]:
    return sorted(_found.values(), key=lambda e: -e.priority)


def _takes(e: Extractor, name: str, mime: str) -> bool:
    try:
        return e.accepts(name, mime)
    except Exception:  # an extractor that cannot tell does not take the file
        return False


def pick(name: str, mime: str = "") -> Extractor | None:
    return next(iter(pick_all(name, mime)), None)


def pick_all(name: str, mime: str = "") -> list[Extractor]:
    return [e for e in extractors() if _takes(e, name, mime)]


def extract(spark, path: str, mime: str = "", **options):
    """What the file's, or folder's, reader makes of it: for all kinds tables, headers and cells in long form. A path that no reader takes is an error, not an empty result."""
    e = pick(path, mime)
    if e is None:
        raise ValueError(f"no extractor takes {path}")
    if e.read is None:
        raise ValueError(f"{e.id} has no reader: give one that tells words and where they stand (sources.optical)")
    return e.read(spark, path, **options)


def use_reader(id: str, read: Callable) -> None:
    """Gives a registered extractor its reader, as for pdf-text and image, whose words come from outside."""
    e = _found[id]
    _found[id] = Extractor(e.id, e.extensions, e.mimes, e.priority, read)


def _html(spark, path: str):
    from .html import document_tables

    pages = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.decode("content", "UTF-8").alias("html"))
    return document_tables(pages, "file")


def _workbooks(spark, path: str):
    from .workbooks import sheet_cells, sheet_tables, skipped_sheets

    cells = sheet_cells(spark, path)
    return sheet_tables(cells) | {"skipped": skipped_sheets(cells)}


def _word(spark, path: str):
    from .workbooks import word_tables

    return word_tables(spark, path)


def _words(read: Callable, origin: str) -> Callable:
    """A reader of positioned words as an extractor's."""

    def run(spark, path: str, **options):
        from gridwright.operators.extract.pages import extract_optical, extract_tables

        from .optical import read_words

        files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), "content")
        words = read_words(files, read)
        return extract_tables(words, **options) if origin == "pdf-text" else extract_optical(words, origin=origin, **options)

    return run


def words_reader(read: Callable, origin: str = "pdf-text") -> Callable:
    """read(name, content) -> (page, text, x, y, x1, y1, conf) tuples, as what use_reader takes. origin: pdf-text for a text layer, else optical."""
    return _words(read, origin)


BUILTIN = (
    Extractor("pdf-text", ("pdf",), ("application/pdf",), 50),
    Extractor("xlsx", ("xlsx", "xlsm", "xls", "ods"), ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-excel"), 40, _workbooks),
    Extractor("docx", ("docx",), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",), 40, _word),
    Extractor("html", ("html", "htm", "xhtml"), ("text/html", "application/xhtml+xml"), 30, _html),
    Extractor("image", ("png", "jpg", "jpeg", "webp", "gif", "bmp", "tif", "tiff"), ("image/*",), 20),
)
for _e in BUILTIN:
    register(_e)


def classify_file(name: Column) -> Column:
    """struct(kind, label, ext) of a file offered: what the intake calls it."""
    ext = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext == "pdf", "pdf").when(ext.isin("xlsx", "xls"), "xlsx").when(ext.isin("docx", "doc"), "docx").when(ext == "csv", "csv").when(ext.isin("png", "jpg", "jpeg", "webp", "gif", "bmp", "tif", "tiff"), "image").otherwise("unknown")
    label = F.when(kind == "pdf", "PDF").when(kind == "xlsx", "Workbook").when(kind == "docx", "Word").when(kind == "csv", "CSV").when(kind == "image", "Image").otherwise("Unsupported")
    return F.struct(kind.alias("kind"), label.alias("label"), ext.alias("ext"))
