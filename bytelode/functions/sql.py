"""The search functions for SQL: temporary functions over expressions, no Python at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

_L = "decode({}, 'ISO-8859-1')"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REGEX = r"concat(r'(?=\Q', replace({}, r'\E', r'\E\\E\Q'), r'\E)')"


def _count(text: str, pattern: str) -> str:
    return f"CASE WHEN text IS NULL OR pattern IS NULL THEN NULL WHEN contains(pattern, X'00') THEN 0 ELSE CAST(regexp_count({text}, {_REGEX.format(pattern)}) AS BIGINT) END"


#: Pieces whose lengths are added up one by one; longer lists are added up by runs of so many.
_RUN = 256


def _starts(lengths: str) -> str:
    """Where pieces of these lengths begin when they follow one another."""
    adds = lambda values, value: f"aggregate({values}, array(0L), (s, x) -> array_append(s, s[size(s) - 1] + {value}))"
    runs = f"transform(sequence(0, (size(v) - 1) div {_RUN}), b -> {adds(f'slice(v, b * {_RUN} + 1, {_RUN})', 'x')})"
    placed = "flatten(transform(r, (run, k) -> transform(slice(run, 1, size(run) - 1), y -> y + o[k])))"
    return f"transform(array({lengths}), v -> transform(array({runs}), r -> transform(array({adds('r', 'x[size(x) - 1]')}), o -> {placed})[0])[0])[0]"


def places(text: str, pattern: str, apart: int | None = None) -> str:
    """SQL for the places, as ARRAY<BIGINT> in order, of one byte text in another that is not empty and has no byte 0.

    The text is split where the pattern begins, and the pieces' lengths add up to the places; with `apart`, the size of a
    pattern that cannot overlap itself, it is split at the pattern, which needs no look-ahead. A text without it is not split.
    """
    if apart is None:
        starts = _starts(f"transform(split({text}, {_REGEX.format(pattern)}, -1), p -> CAST(length(p) AS BIGINT))")
        found = f"transform(array({starts}), at -> if(startswith({text}, {pattern}), at, slice(at, 2, size(at) - 1)))[0]"
    else:
        quoted = _REGEX.format(pattern).replace("(?=", "(?:")
        starts = _starts(f"transform(split({text}, {quoted}, -1), p -> length(p) + {apart}L)")
        found = f"transform(array({starts}), at -> transform(slice(at, 2, size(at) - 1), y -> y - {apart}L))[0]"
    return f"if(contains({text}, {pattern}), {found}, CAST(array() AS ARRAY<BIGINT>))"


def _locate(text: str, pattern: str) -> str:
    none = "CAST(array() AS ARRAY<BIGINT>)"
    return f"CASE WHEN {text} IS NULL OR {pattern} IS NULL THEN NULL WHEN {pattern} = '' THEN sequence(0L, CAST(length({text}) AS BIGINT)) WHEN contains({pattern}, decode(X'00', 'ISO-8859-1')) THEN {none} ELSE {places(text, pattern)} END"


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session and returns their names."""
    text, pattern = _L.format("text"), _L.format("pattern")
    plain = f"struct({text} AS t, {pattern} AS p)"
    folded = f"struct({_FOLD.format(text)} AS t, {_FOLD.format(pattern)} AS p)"
    size = "((octet_length(text) + 1L) * 9 DIV 8) * 8 + 2048 + ((octet_length(text) + 1L) DIV 512 + 1) * 72 + (octet_length(text) DIV greatest(step, 1L) + 1) * 8"
    functions = {
        "bytes_count(text BINARY, pattern BINARY) RETURNS BIGINT": _count(text, pattern),
        "bytes_count_ci(text BINARY, pattern BINARY) RETURNS BIGINT": _count(_FOLD.format(text), _FOLD.format(pattern)),
        "bytes_contains(text BINARY, pattern BINARY) RETURNS BOOLEAN": "contains(text, pattern) AND NOT contains(pattern, X'00')",
        "bytes_contains_ci(text BINARY, pattern BINARY) RETURNS BOOLEAN": f"contains({_FOLD.format(text)}, {_FOLD.format(pattern)}) AND NOT contains(pattern, X'00')",
        "bytes_locate(text BINARY, pattern BINARY) RETURNS ARRAY<BIGINT>": f"transform(array({plain}), x -> {_locate('x.t', 'x.p')})[0]",
        "bytes_locate_ci(text BINARY, pattern BINARY) RETURNS ARRAY<BIGINT>": f"transform(array({folded}), x -> {_locate('x.t', 'x.p')})[0]",
        "bytes_text_len(text BINARY) RETURNS BIGINT": "CAST(octet_length(text) AS BIGINT)",
        "bytes_sample_step(step BIGINT) RETURNS BIGINT": "greatest(step, 1L)",
        "bytes_index_size(text BINARY, step BIGINT) RETURNS BIGINT": size,
        "bytes_index_ratio(text BINARY, step BIGINT) RETURNS DOUBLE": f"CASE WHEN octet_length(text) = 0 THEN 0D ELSE ({size}) * (1D / octet_length(text)) END",
    }
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in functions]
