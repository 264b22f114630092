"""File-path and address expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from faultgauge import constants as C
from faultgauge.functions.lexical import SPACE


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.element_at(pairs, key)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the last path part; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.][\s\S]*\.([^.]*)\z", 1))


def language(path: Column) -> Column:
    return F.coalesce(_lookup(C.LANGUAGE_BY_EXTENSION, extension(path)), F.lit("generic"))


def display_language(path: Column) -> Column:
    ext = F.lower(F.element_at(F.split(path, r"\.", -1), -1))
    return F.coalesce(_lookup(C.DISPLAY_LANGUAGE, ext), F.upper(ext))


def is_supported(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(C.SUPPORTED_EXTENSIONS) + r")\z")


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise("(root)")


def short_name(name: Column) -> Column:
    return F.coalesce(F.nullif(F.element_at(F.split(name, "/", -1), -1), F.lit("")), F.lit("Unknown"))


def repository_parts(url: Column) -> Column:
    """Path parts of a repository address given in full, without protocol, or as owner/name."""
    text = F.regexp_replace(F.regexp_replace(url, rf"^{SPACE}++|{SPACE}++\z", ""), r"[\t\r\n]", "")
    full = (
        F.when(text.startswith("http"), text)
        .when(text.contains("github.com"), F.concat(F.lit("https://"), text))
        .otherwise(F.concat(F.lit("https://github.com/"), text))
    )
    rest = F.regexp_replace(F.regexp_replace(full, r"^[a-zA-Z][a-zA-Z0-9+.\-]*:", ""), r"^//[^/?#]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^?#]*", 0), r";[^/]*\z", "")
    return F.filter(F.split(path, "/", -1), lambda part: part != "")
