"""Which kind of document a file is, by extension, media type and text layer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kartoteka.functions import normal, rx
from kartoteka.schema import API_EXTENSIONS, IMAGE_EXTENSIONS, Settings

# Media types by extension, and the first bytes that tell a type.
MIME = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "tiff": "image/tiff",
}
MAGIC = (("25504446", "application/pdf"), ("FFD8FF", "image/jpeg"), ("89504E47", "image/png"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"))
OTHER = "application/octet-stream"


def extension(name: Column) -> Column:
    """The last suffix in lower case without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]+)$", 1))


def mime_by_extension(ext: Column) -> Column:
    out = F.when(F.lit(False), F.lit(OTHER))
    for e, m in MIME.items():
        out = out.when(ext == e, F.lit(m))
    return out.otherwise(F.lit(OTHER))


def mime(content: Column, ext: Column) -> Column:
    """By the content's first bytes, else by extension; a zip container with the extension docx is a document."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.when(head.startswith("504B0304") & (ext == "docx"), F.lit(MIME["docx"]))
    for bytes_, m in MAGIC:
        out = out.when(head.startswith(bytes_), F.lit(m))
    return out.otherwise(mime_by_extension(ext))


def text_layer(pages: Column, least: int = 50) -> Column:
    """Whether the first three pages of a PDF have `least` characters of text; null pages, of an unreadable file, have none."""
    some = F.aggregate(F.slice(pages, 1, 3), F.lit(0), lambda n, p: n + F.coalesce(F.length(F.trim(p)), F.lit(0)))
    return F.coalesce(some, F.lit(0)) >= least


def kind(ext: Column, mime: Column, has_text: Column) -> Column:
    """docx, image, pdf_text, pdf_scan or unsupported, whatever the case of the media type; the order of the rules is their precedence."""
    mime = F.lower(mime)
    return (
        F.when((ext == "docx") | mime.contains("wordprocessingml"), F.lit("docx"))
        .when(ext.isin(*IMAGE_EXTENSIONS) | mime.startswith("image/"), F.lit("image"))
        .when((ext == "pdf") | (mime == "application/pdf"), F.when(has_text, F.lit("pdf_text")).otherwise(F.lit("pdf_scan")))
        .otherwise(F.lit("unsupported"))
    )


def upload_code(name: Column, size: Column, extensions: tuple[str, ...] = API_EXTENSIONS, largest_mb: int | None = Settings.max_upload_mb) -> Column:
    """400 for a missing name or another extension, 413 for too large a file, null for one that may come in.

    A service's form has WEB_EXTENSIONS and no bound of its own: largest_mb is None.
    """
    bad = F.coalesce(name == "", F.lit(True)) | ~F.coalesce(extension(name).isin(*extensions), F.lit(False))
    out = F.when(bad, F.lit(400))
    return out if largest_mb is None else out.when(size > largest_mb * 2**20, F.lit(413))


def safe_name(name: Column) -> Column:
    """A name of ASCII letters, digits, dots, dashes and underscores that stays within a folder; accents are dropped.

    Folders and white space become underscores, and dots and underscores at the ends go, so nothing may be left.
    """
    plain = F.regexp_replace(normal.decomposed(name), r"[^\x00-\x7f]", "")
    joined = F.array_join(F.filter(F.split(F.regexp_replace(plain, "/", " "), r"[\s\x1c-\x1f]+"), lambda x: x != ""), "_")
    return F.regexp_replace(F.regexp_replace(joined, r"[^A-Za-z0-9_.-]", ""), r"^[._]+|[._]+$", "")


def stored_name(name: Column, document_id: Column) -> Column:
    """The safe name with the id before its suffix, so that files of one name don't meet."""

    def stored(safe: Column) -> Column:
        suffix = F.regexp_extract(safe, r"[^.](\.[^.]*)$", 1)
        return F.concat(F.left(safe, F.length(safe) - F.length(suffix)), F.lit("_"), document_id, suffix)

    return rx.let(safe_name(name), stored)
