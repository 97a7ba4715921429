"""File sources (§2.1): ranges of pages, kinds by leading bytes, decoding, names, size tiers, OCR need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Leading bytes by kind. Fixed values of the formats.
MAGIC = {"pdf": "255044462D", "zip": "504B0304", "png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "47494638", "ole": "D0CF11E0A1B11AE1", "rtf": "7B5C727466", "tiff": "49492A00"}


def resolve_page_range(total: int, start: int | None = None, end: int | None = None) -> tuple[int, int]:
    """The pages asked for, first and last; an error where they are no pages of the document."""
    first, last = 1 if start is None else start, total if end is None else end
    if first < 1 or last > total or first > last:
        raise ValueError(f"pages {first} to {last} of {total}")
    return first, last


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, checksum, size, content: any files, through Spark's binary reader."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", kind_of(F.col("content")).alias("kind"), F.sha2("content", 256).alias("checksum"), F.col("length").alias("size"), "content")


def kind_of(content: Column) -> Column:
    """The kind that the leading bytes show; null for none of the known."""
    head = F.hex(F.substring(content, 1, 8))
    found = F.when(F.startswith(head, F.lit(MAGIC["pdf"])), "pdf")
    for kind, magic in list(MAGIC.items())[1:]:
        found = found.when(F.startswith(head, F.lit(magic)), kind)
    return found


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 where valid, its mark dropped, else Latin-1."""
    utf8 = F.when(F.is_valid_utf8(F.decode(content, "ISO-8859-1")) & F.try_validate_utf8(content.cast("string")).isNotNull(), content.cast("string"))
    return F.regexp_replace(F.coalesce(utf8, F.decode(content, "ISO-8859-1")), "^\\x{FEFF}", "")


def text_lines(text: Column) -> Column:
    """Lines that are not blank."""
    return F.filter(F.split(text, "\\R"), lambda x: F.trim(x) != "")


def rtf_text(text: Column) -> Column:
    """RTF without control words, escapes and braces."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\\'[0-9a-fA-F]{2}", ""), r"\\[a-zA-Z]+-?[0-9]* ?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[{}\\]", " "), r"\s+", " "))


def display_name(name: Column, extension: str = ".pdf", limit: int = 150) -> Column:
    """A file name that is safe to show: base name, no NUL, control characters as blanks, reserved ones as `_`."""
    base = F.element_at(F.split(F.regexp_replace(F.coalesce(name, F.lit("")), r"\x00", ""), r"[/\\]"), -1)
    safe = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"[\x01-\x1F\x7F]", " "), r'[<>:"|?*]', "_"), r"\s+", " "))
    stem = F.when(F.endswith(F.lower(safe), F.lit(extension)), F.substring(safe, F.lit(1), F.length(safe) - len(extension))).otherwise(safe)
    return F.concat(F.substring(F.coalesce(F.nullif(stem, F.lit("")), F.lit("document")), 1, limit - len(extension)), F.lit(extension))


def size_tier(size: Column) -> Column:
    mib = 1024 * 1024
    return F.when(size < 10 * mib, "small").when(size < 50 * mib, "medium").when(size <= 100 * mib, "large").otherwise("very_large")


def suspicious_ratio(text: Column) -> Column:
    """Share of replacement, control and private-use characters."""
    bad = F.length(F.regexp_replace(text, "[^\\x{FFFD}\\x00-\\x08\\x0E-\\x1F\\x{E000}-\\x{F8FF}]", ""))
    return F.when(F.length(text) > 0, bad / F.length(text)).otherwise(F.lit(0.0))


def ocr_reasons(chars: Column, words: Column, coverage: Column, suspicious: Column, images: Column) -> Column:
    """Why a page needs OCR, in order; none if it has text enough, and only blank_page if it has nothing at all."""
    blank = (chars == 0) & (images == 0)
    rules = F.array(F.when(chars < 40, "few_characters"), F.when(words < 8, "few_words"), F.when((coverage < 0.002) & (chars < 200), "low_coverage"), F.when(suspicious > 0.15, "bad_glyphs"), F.when((images > 0.6) & (chars < 200), "image_page"))
    return F.when(blank, F.array(F.lit("blank_page"))).otherwise(F.filter(rules, lambda x: x.isNotNull()))
