"""Labels of pages, sections and documents as Column builders (SC-20, SC-21)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapsed

# Words and signs of labels, what separates headings and words of a file name, and the longest title.
PAGE_WORDS = {"en": (("page", "pages"), ("p.", "pp.")), "hi": (("पृष्ठ", "पृष्ठ"), ("पृ.", "पृ."))}
HEADINGS, SECTION, UNKNOWN = " > ", "§ ", "(unknown document)"
NAME_SEPARATORS, TITLE_CHARS = r"[\s_\-.]+", 120


def pages_label(start: Column, end: Column, language: Column, short: bool = False) -> Column:
    """SC-20: "page 2", "pages 2–3", or "p. 2", "pp. 2–3" where short; in Hindi where the language is hi; empty without a page."""
    one = end.isNull() | (end == start)
    span = F.when(one, start.cast("string")).otherwise(F.concat_ws("–", start.cast("string"), end.cast("string")))
    word = lambda lang: F.when(one, PAGE_WORDS[lang][short][0]).otherwise(PAGE_WORDS[lang][short][1])
    return F.when(start.isNull(), "").otherwise(F.concat_ws(" ", F.when(language == "hi", word("hi")).otherwise(word("en")), span))


def section_of(headings: Column) -> Column:
    """SC-20: a heading path as one line; null without headings."""
    return F.nullif(F.array_join(F.filter(F.transform(headings, collapsed), lambda h: h != ""), HEADINGS), F.lit(""))


def section_label(section: Column, short: bool = True) -> Column:
    """SC-20: "§ 4.2.1 Hotels", the last heading of a path, or all of it where not short; empty without a section."""
    parts = F.filter(F.transform(F.split(F.coalesce(section, F.lit("")), HEADINGS), lambda p: F.trim(p)), lambda p: p != "")
    shown = F.slice(parts, -1, 1) if short else parts
    return F.when(F.size(parts) == 0, "").otherwise(F.concat(F.lit(SECTION), F.array_join(shown, HEADINGS)))


def reference_label(filename: Column, title: Column, web: Column, start: Column, end: Column, section: Column, language: Column, short: bool = True) -> Column:
    """SC-20: a document with its page, else its section; a page of the web with its title."""
    site = F.concat_ws(" — ", F.concat(F.lit("web: "), F.coalesce(filename, F.lit(""))), F.nullif(collapsed(F.coalesce(title, F.lit(""))), F.lit("")))
    return F.when(web, site).otherwise(document_place(filename, start, end, section_label(section, short), language, short))


def document_place(filename: Column, start: Column, end: Column, shown_section: Column, language: Column, short: bool = True) -> Column:
    """SC-20: a document with its page, else its section as it is shown."""
    where = F.coalesce(F.nullif(pages_label(start, end, language, short), F.lit("")), F.nullif(shown_section, F.lit("")))
    return F.concat_ws(", ", F.coalesce(F.nullif(filename, F.lit("")), F.lit(UNKNOWN)), where)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def document_label(filename: Column, title: Column) -> Column:
    """SC-21: a file's name without extension and separators, then the title where it adds words to it."""
    stem = F.regexp_replace(F.regexp_extract(F.coalesce(filename, F.lit("")), r"([^/]*)\z", 1), r"(?<=.)\.[^.]*\z", "")
    name = F.trim(F.regexp_replace(stem, NAME_SEPARATORS, " "))
    adds = F.size(F.array_except(_words(F.regexp_replace(title, NAME_SEPARATORS, " ")), _words(name))) > 0
    return F.when(F.coalesce(title, F.lit("")) == "", name).when(name == "", title).when(adds, F.concat_ws(": ", name, title)).otherwise(name)


def split_document_label(label: Column) -> Column:
    """SC-21: struct<name, title> of a document label; the title is empty if there is none."""
    parts = F.split(label, ": ", 2)
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("name"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("title"))


def document_title(items: Column) -> Column:
    """SC-21: the first title among a document's items (array<struct<text, label, level, page>> in order), else the first heading on its first page; null if it is too long."""
    page = F.array_min(F.transform(items, lambda i: i["page"]))
    titles = F.filter(items, lambda i: i["label"] == "title")
    of = F.when(F.size(titles) > 0, titles).otherwise(F.filter(items, lambda i: i["level"].isNotNull() & i["page"].eqNullSafe(page)))
    first = F.get(F.filter(F.transform(of, lambda i: collapsed(i["text"])), lambda t: t != ""), F.lit(0))
    return F.when(F.length(first) <= TITLE_CHARS, first)
