"""Scalar columns on addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def document_url(base: Column, page_id: Column) -> Column:
    """No id: the base; a page_id parameter becomes pageId; else pageId is added."""
    added = F.concat(base, F.when(F.contains(base, F.lit("?")), "&").otherwise("?"), F.lit("pageId="), page_id)
    replaced = F.concat(F.regexp_extract(base, r"(?s)^(.*?)page_id=[^&]*", 1), F.lit("pageId="), page_id, F.regexp_extract(base, r"(?s)^.*?page_id=[^&]*(.*)$", 1))
    return F.when(F.coalesce(page_id, F.lit("")) == "", base).when(F.contains(base, F.lit("page_id=")), replaced).otherwise(added)


def base_url(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def absolute_url(src: Column, base: Column) -> Column:
    """A relative address against an origin without path."""
    return (
        F.when(F.rlike(src, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), src)
        .when(F.startswith(src, F.lit("//")), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), src))
        .when(F.startswith(src, F.lit("/")), F.concat(base, src))
        .otherwise(F.concat(base, F.lit("/"), src))
    )
