"""Schemas of the record types, and required-column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


PAPER = T.StructType([*_strings("paper_id", "venue_key"), T.StructField("year", T.IntegerType()), *_strings("track", "title"), T.StructField("authors", T.ArrayType(T.StringType())), *_strings("doi", "official_url", "source_kind", "pdf_url")])
AFFILIATION = T.StructType(_strings("institution_id", "institution_name", "country_code", "institution_type"))
DIAGNOSTIC = T.StructType(_strings("stage", "outcome", "detail"))
RECONCILED = T.StructType([T.StructField("paper", PAPER), *_strings("openalex_id", "match_method"), T.StructField("affiliations", T.ArrayType(AFFILIATION)), T.StructField("diagnostics", T.ArrayType(DIAGNOSTIC))])
SEARCH_RESULT = T.StructType([*_strings("title", "url", "snippet", "published_at"), T.StructField("source_rank", T.IntegerType()), *_strings("query")])
MQM_ERROR = T.StructType(_strings("span", "category", "severity", "explanation"))
MQM_JUDGMENT = T.StructType([*_strings("kind", "segment_id", "direction", "candidate_model", "request_id"), T.StructField("result", T.StructType([T.StructField("errors", T.ArrayType(MQM_ERROR)), *_strings("summary")]))])
#: Columns of the review queue, in file order.
QUEUE = ("review_id", "venue", "paper_id", "track", "title", "authors", "official_url", "pdf_url", "openalex_id", "match_method", "affiliations_json", "system_signal", "priority", "priority_reason", "review_status", "confidence", "failure_codes", "review_note", "add_to_regression")


def require_columns(frame: DataFrame, *names: str) -> DataFrame:
    """The frame itself; raises where a column is missing."""
    if missing := [n for n in names if n not in frame.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return frame


def require_exact_header(frame: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The frame itself; raises unless its columns are exactly `names`, in order."""
    if tuple(frame.columns) != tuple(names):
        raise ValueError(f"unexpected header: {frame.columns}")
    return frame
