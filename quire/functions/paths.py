"""Paths inside a book: hrefs resolved against a document, without a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quire.functions.text import any_of, external_url

_OUTSIDE = ("data:", "mailto:", "tel:", "blob:", "javascript:", "//")


def file_of(href: Column) -> Column:
    return F.substring_index(href, "#", 1)


def fragment_of(href: Column) -> Column:
    """What follows the first ``#``, null if there is none."""
    return F.when(href.contains("#"), F.regexp_extract(href, r"(?s)^[^#]*#(.*)$", 1))


def folder_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def normalised(path: Column) -> Column:
    """A relative POSIX path without ``.``, empty parts, and ``..`` where a part precedes it."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    done = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "..") & F.coalesce(F.try_element_at(acc, F.lit(-1)) != "..", F.lit(False)), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, p)),
    )
    joined = F.array_join(done, "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def resolved(document: Column, href: Column) -> Column:
    """An href as a path inside the book; null if it is empty, external, or leaves the book."""
    value = F.trim(href)
    low = F.lower(value)
    outside = (value == "") | any_of(low.startswith(p) for p in _OUTSIDE) | value.contains("://")
    folder = folder_of(document)
    whole = F.when(value.startswith("/"), F.ltrim(value, F.lit("/"))).when(folder == "", value).otherwise(F.concat(folder, F.lit("/"), value))
    path = normalised(whole)
    return F.when(~outside & ~path.startswith("../"), path)


def content_path(document: Column, url: Column) -> Column:
    """A relative URL as a path under ``content/``; external ones stay."""
    folder = folder_of(document)
    whole = F.when(folder == "", url).otherwise(F.concat(folder, F.lit("/"), url))
    stays = (url == "") | external_url(url) | url.startswith("content/")
    return F.when(stays, url).otherwise(F.concat(F.lit("content/"), normalised(whole)))


def unsafe_member(name: Column) -> Column:
    """An archive member that would be written outside its folder."""
    return name.startswith("/") | name.startswith("\\") | name.rlike(r"^[A-Za-z]:") | F.array_contains(F.split(name, r"[/\\]"), "..")


def numbered_names(name: Column, nth: Column, sep: str = "-") -> Column:
    """A name that occurs again gets its number before the first dot."""
    return F.when(nth == 1, name).otherwise(
        F.concat(F.regexp_extract(name, r"^([^.]*)", 1), F.lit(sep), nth.cast("string"), F.regexp_extract(name, r"^[^.]*(.*)$", 1))
    )
