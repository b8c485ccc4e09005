"""Nested source documents to compact records, and filter states to links and back."""

from __future__ import annotations

import json
from collections.abc import Mapping
from urllib.parse import parse_qs, quote, unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm_doi, tail

#: The fields of a source's work that records are made from.
AUTHORS = "array<struct<author:struct<id:string,display_name:string,orcid:string>,author_position:string,institutions:array<struct<display_name:string>>>>"
CONCEPTS = "array<struct<display_name:string,level:int,score:double>>"
WORK = (
    "id string, doi string, title string, display_name string, publication_year int, publication_date string, type string, cited_by_count bigint, "
    f"authorships {AUTHORS}, concepts {CONCEPTS}"
)


def compact_record(doc: Column, venue: Column, concepts: int = 8) -> Column:
    """A struct of id, doi, title, year, date, venue, type, cited_by_count, authors and concepts from a JSON document.

    Identifiers lose what stands before their last slash; the title falls back to the display name; a missing count is 0,
    missing lists are empty; authors without a name go; of the concepts the first ones stay.
    """
    author = lambda a: F.struct(
        tail(a["author"]["id"]).alias("id"),
        a["author"]["display_name"].alias("name"),
        a["author"]["orcid"].alias("orcid"),
        a["author_position"].alias("position"),
        F.filter(F.transform(F.coalesce(a["institutions"], F.array().cast("array<struct<display_name:string>>")), lambda i: i["display_name"]), lambda x: x.isNotNull()).alias("institutions"),
    )
    no_authors, no_concepts = (F.array().cast(t) for t in (AUTHORS, CONCEPTS))
    named = lambda w: F.filter(F.coalesce(w["authorships"], no_authors), lambda a: a["author"]["display_name"].isNotNull())
    kept = lambda w: F.slice(F.coalesce(w["concepts"], no_concepts), 1, concepts)
    record = lambda w: F.struct(
        tail(w["id"]).alias("id"),
        norm_doi(w["doi"]).alias("doi"),
        F.coalesce(w["title"], w["display_name"], F.lit("")).alias("title"),
        w["publication_year"].alias("year"),
        w["publication_date"].alias("date"),
        venue.alias("venue"),
        w["type"].alias("type"),
        F.coalesce(w["cited_by_count"], F.lit(0)).alias("cited_by_count"),
        F.transform(named(w), author).alias("authors"),
        F.transform(kept(w), lambda c: F.struct(c["display_name"].alias("name"), c["level"].alias("level"), c["score"].alias("score"))).alias("concepts"),
    )
    return F.get(F.transform(F.array(F.from_json(doc, WORK)), record), F.lit(0))  # a bound variable: parsed once, not once for each field


def link_of_filter(state: Mapping) -> str:
    """A filter state as the part of a link after #: keys in order, lists and pairs as JSON, empty ones left out."""
    return "#" + "&".join(f"{k}={quote(json.dumps(v), safe='')}" for k, v in sorted(state.items()) if v not in (None, "", [], ()))


def filter_of_link(link: str) -> dict:
    """The state of a link. Unknown text around # is ignored; a value that is no JSON is taken as text."""
    out = {}
    for k, values in parse_qs(link.rpartition("#")[2], keep_blank_values=True).items():
        try:
            v = json.loads(values[-1])
        except ValueError:
            v = unquote(values[-1])
        out[k] = tuple(v) if k == "years" and isinstance(v, list) else v
    return out
