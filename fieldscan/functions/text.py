"""Small text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldscan.functions.fold import gather_sql

# Fixed value: the characters a whitespace split treats as blank.
BLANK = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def leaf_name(path: Column) -> Column:
    """Last dotted segment without list indices or edge digits."""
    last = F.element_at(F.split(path, r"\."), -1)
    return F.regexp_replace(last, r"^[\[\]0-9]+|[\[\]0-9]+$", "")


def name_words(name: Column) -> Column:
    """Lower-case words of a snake / kebab / camel / Pascal name, single-spaced."""
    # Where names are split.
    s = F.regexp_replace(name, r"([A-Z]+)([A-Z][a-z])", r"$1 $2")
    s = F.regexp_replace(s, r"([a-z0-9])([A-Z])", r"$1 $2")
    s = F.regexp_replace(s, r"[^a-zA-Z0-9]+", " ")
    return F.lower(F.trim(s))


def schema_path(path: Column, strict: bool = False) -> Column:
    """Path as a schema lists it. ``strict`` keeps list indices as dotted segments."""
    if strict:
        dotted = F.regexp_replace(F.regexp_replace(path, r"\[", "."), r"\]", "")
        return F.regexp_replace(dotted, r"^\.+|\.+$", "")
    return F.regexp_replace(path, r"\[[0-9]+\]", "")


def scan_example(snippet: Column) -> Column:
    """Scan results show at most 50 characters of a snippet."""
    return F.when(
        F.length(snippet) > 50, F.concat(F.substring(snippet, 1, 47), F.lit("..."))
    ).otherwise(snippet)


def has_words(value: Column, n: int) -> Column:
    """At least ``n`` blank-separated words and at least one space."""
    rx = rf"^[{BLANK}]*(?:[^{BLANK}]+[{BLANK}]+){{{n - 1}}}[^{BLANK}]"
    return value.rlike(rx) & value.contains(" ")


def is_blank(value: Column) -> Column:
    return value.rlike(rf"^[{BLANK}]*$")


def plain_text(value: Column) -> Column:
    """ASCII shadow of a text, one character per code point.

    Letters and digits beyond ASCII become ``_`` (still a word character) and
    anything else beyond ASCII a space, so ``\\b`` and character classes mean the
    same in every regex engine while offsets stay those of the original text.
    """
    marks = F.regexp_replace(value, r"[^\x00-\x7F\p{L}\p{N}]", " ")
    return F.when(F.octet_length(value) == F.length(value), value).otherwise(
        F.regexp_replace(marks, r"[^\x00-\x7F]", "_")
    )


def quoted(text: str) -> str:
    """A Python string as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_sql(text: str, regex: str) -> str:
    """SQL for all matches of ``regex`` in column ``text`` as
    ``array<struct<start:int, hit:string>>`` (0-based).

    ``start`` is the running sum of the gaps and matches before it; a lone match needs no sum. Each ``transform(array(x), v -> ...)[0]`` names a value that is used
    more than once.
    """
    rx = quoted(regex)
    kind = "struct<start:int,hit:string>"
    pairs = f"slice(zip_with(transform(split({text}, {rx}, -1), g -> length(g)), hits, (g, h) -> named_struct('gap', g, 'hit', h)), 1, size(hits))"
    placed = "array(named_struct('start', s.at + x.gap, 'hit', x.hit))"
    folded = gather_sql("ps", {"at": "0"}, kind, lambda state: state(placed, at="s.at + x.gap + length(x.hit)"))
    one = f"array(struct(regexp_instr({text}, {rx}) - 1 AS start, hits[0] AS hit))"
    return f"""transform(array(regexp_extract_all({text}, {rx}, 0)), hits -> CASE size(hits)
        WHEN 0 THEN cast(array() AS array<{kind}>) WHEN 1 THEN {one} ELSE transform(array({pairs}), ps -> {folded})[0] END)[0]"""


def match_spans(text: str, regex: str) -> Column:
    """``spans_sql`` as a column."""
    return F.expr(spans_sql(text, regex))


def qualified_name(cluster: Column, schema_id: Column, qualifier: Column, path: Column) -> Column:
    """Catalog name of a schema field: ``cluster:.:id:namespace.record.path``."""
    return F.format_string("%s:.:%s:%s.%s", cluster, schema_id.cast("string"), qualifier, path)


def subject_of(topic: Column) -> Column:
    return F.concat(topic, F.lit("-value"))


def trigger_table(topic: Column) -> Column:
    return F.concat(topic, F.lit("-scan-triggers"))


def result_table(topic: Column) -> Column:
    return F.concat(topic, F.lit("-scan-results"))
