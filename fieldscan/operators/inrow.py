"""Detection inside one message as a single expression: no generator, no shuffle.

The same layers as ``detect``, over the array of a message's fields. Every ``_let`` names a
value that is used more than once.
"""

from __future__ import annotations

import json

from fieldscan.functions.dictionary import FREE_TEXT_MIN_WORDS, FREE_TEXT_NAMES
from fieldscan.functions.names import NAME_HIT, keyword_lookup, longest_keyword
from fieldscan.functions.patterns import NO_HITS, PATTERNS, Pattern, hint_sql, hit_parts
from fieldscan.functions.taxonomy import clamp_layer_value
from fieldscan.functions.text import BLANK, quoted
from fieldscan.functions.tree import leaves_sql
from fieldscan.operators.detect import DETECTION
from fieldscan.operators.entities import gazetteer_patterns

DETECTIONS = f"array<{DETECTION}>"
LEVELS = 4
_JSON_VALUE = "try_variant_get(try_parse_json(l.json), '$', 'string')"


def let(name: str, value: str, use: str) -> str:
    """``use``, an expression of ``name``, with ``value`` worked out once."""
    # [0] would work out the type of ``use`` anew for each row.
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def json_tree(message: str) -> str:
    """A JSON message as VARIANT (last of equal keys), null if it is none."""
    return f"try_parse_json(if({message} RLIKE '^[ \\\\t\\\\r\\\\n]*\\\\{{', {message}, NULL))"


def folded_fields_sql(tree: str) -> str:
    """``fields_sql`` by the fold alone: slower, but nested less deeply, for use in SQL functions,
    whose expressions Spark resolves a level at a time."""
    text = f"try_variant_get({tree}, '$', 'string')"
    leaf = f"named_struct('field_path', substring(l.under, 2), 'value', {_JSON_VALUE})"
    leaves = let("tree", text, f"CASE WHEN tree IS NOT NULL THEN {leaves_sql('tree')} END")
    return f"filter(transform({leaves}, l -> {leaf}), l -> l.value IS NOT NULL)"


def fields_sql(tree: str) -> str:
    """Fields (field_path, value) of a VARIANT record, as an array; null for null.

    A few levels are taken apart as maps and lists; a container below them is folded.
    """
    rows = "array(named_struct('path', '', 'v', tree))"
    below = """coalesce(
        transform(map_entries(try_variant_get(n.v, '$', 'map<string,variant>')), e -> named_struct('path', concat(n.path, '.', e.key), 'v', e.value)),
        transform(try_variant_get(n.v, '$', 'array<variant>'), (x, i) -> named_struct('path', concat(n.path, '[', i, ']'), 'v', x)), array(n))"""
    for _ in range(LEVELS):
        rows = f"flatten(transform({rows}, n -> {below}))"
    field = "named_struct('field_path', substring({}, 2), 'value', {})"
    deep = f"transform({leaves_sql('text')}, l -> {field.format('concat(n.path, l.under)', _JSON_VALUE)})"
    is_container = "left(text, 1) IN ('{', '[') AND coalesce(try_variant_get(n.v, '$', 'array<variant>') IS NOT NULL OR try_variant_get(n.v, '$', 'map<string,variant>') IS NOT NULL, false)"
    leaf = let("text", "try_variant_get(n.v, '$', 'string')", f"CASE WHEN {is_container} THEN {deep} ELSE array({field.format('n.path', 'text')}) END")
    return let("tree", tree, f"CASE WHEN tree IS NOT NULL THEN filter(flatten(transform({rows}, n -> {leaf})), f -> f.value IS NOT NULL) END")


def leaf_sql(path: str) -> str:
    return f"regexp_replace(element_at(split({path}, '\\\\.'), -1), '^[\\\\[\\\\]0-9]+|[\\\\[\\\\]0-9]+$', '')"


def words_sql(leaf: str) -> str:
    parted = f"regexp_replace({leaf}, '([A-Z]+)([A-Z][a-z])', '$1 $2')"
    parted = f"regexp_replace({parted}, '([a-z0-9])([A-Z])', '$1 $2')"
    return f"lower(trim(regexp_replace({parted}, '[^a-zA-Z0-9]+', ' ')))"


def names_sql(dictionary=None) -> str:
    """Layer-1 hits of ``words``."""
    lookup = f"from_json({quoted(json.dumps(keyword_lookup(dictionary)))}, 'map<string,array<{NAME_HIT}>>')"
    any_keyword = "(?:^| )(?:" + "|".join(keyword_lookup(dictionary)) + ")(?: |$)"
    nothing = f"cast(array() AS array<{NAME_HIT}>)"
    runs = f"""flatten(transform(sequence(1, size(split(words, ' '))), i -> transform(
        sequence(1, least({longest_keyword(dictionary)}, size(split(words, ' ')) - i + 1)), n -> array_join(slice(split(words, ' '), i, n), ' '))))"""
    found = f"sort_array(array_distinct(flatten(transform({runs}, w -> coalesce(try_element_at({lookup}, w), {nothing})))))"
    return f"CASE WHEN words RLIKE {quoted(any_keyword)} THEN {found} ELSE {nothing} END"


def _plain_sql(value: str) -> str:
    marks = f"regexp_replace({value}, '[^\\\\x00-\\\\x7F\\\\p{{L}}\\\\p{{N}}]', ' ')"
    return f"if(octet_length({value}) = length({value}), {value}, regexp_replace({marks}, '[^\\\\x00-\\\\x7F]', '_'))"


def _free_sql() -> str:
    names = "(?:^| )(?:" + "|".join(FREE_TEXT_NAMES) + ")(?: |$)"
    many = f"^[{BLANK}]*(?:[^{BLANK}]+[{BLANK}]+){{{FREE_TEXT_MIN_WORDS - 1}}}[^{BLANK}]"
    return f"CASE WHEN words RLIKE {quoted(names)} THEN true WHEN size(names) > 0 THEN false ELSE f.value RLIKE {quoted(many)} AND contains(f.value, ' ') END"


def _hits_sql(patterns: list[Pattern], wanted: str, language: str) -> str:
    """Detections in ``f.value``, cheap tests first: literals and digits, then gates, then the scans."""
    nothing = f"cast(array() AS {DETECTIONS})"
    parts = hit_parts(tuple(patterns), language, (), "gated.")
    if parts is None:
        return nothing
    hints, gates, found = parts
    hinted = ", ".join(f"'{c}', {wanted} AND {hint_sql('f.value', h) if h else 'f.value IS NOT NULL'}" for h, c in hints.items())
    tests = ", ".join(f"'{c}', hinted.{hints[h]}" + (f" AND plain RLIKE {quoted(g)}" if g else "") for (h, g), c in gates.items())
    any_of = lambda holder, names: " OR ".join(f"{holder}.{c}" for c in names)
    snippet = "if(plain = f.value, h.hit, substring(f.value, h.start + 1, h.stop - h.start))"
    row = f"named_struct('entity_type', h.entity_type, 'tag', h.tag, 'score', round(h.score, 4), 'start', h.start, 'end', h.stop, 'text_snippet', {snippet}, 'layer', h.layer, 'source', h.source)"
    listed = f"cast(transform(CASE WHEN {any_of('gated', gates.values())} THEN {found} ELSE {NO_HITS} END, h -> {row}) AS {DETECTIONS})"
    scanned = let("plain", _plain_sql("f.value"), let("gated", f"named_struct({tests})", listed))
    return let("hinted", f"named_struct({hinted})", f"CASE WHEN {any_of('hinted', hints.values())} THEN {scanned} ELSE {nothing} END")


def detections_sql(
    depth: str, patterns=None, phrases=None, language: str = "en", dictionary=None, layer3_free_text_only: bool = False
) -> str:
    """``named_struct(field_path, is_free_text, es)`` of a field ``f``: its detections, layer by
    layer, to the depth that the SQL ``depth`` gives."""
    snippet = "substring(f.value, 1, 80)"
    name = f"named_struct('entity_type', h.entity_type, 'tag', h.tag, 'score', h.score, 'start', 0, 'end', length(f.value), 'text_snippet', {snippet}, 'layer', 1, 'source', 'field_name')"
    lists = [f"cast(transform(names, h -> {name}) AS {DETECTIONS})"]
    lists.append(_hits_sql(PATTERNS if patterns is None else patterns, f"{depth} >= 2", language))
    wanted = f"{depth} >= 3" + (" AND free" if layer3_free_text_only else "")
    lists.append(_hits_sql(gazetteer_patterns() if phrases is None else phrases, wanted, language))
    row = f"named_struct('field_path', f.field_path, 'is_free_text', free, 'es', filter(concat({', '.join(lists)}), e -> e.tag IS NOT NULL))"
    return let("words", words_sql(leaf_sql("f.field_path")), let("names", names_sql(dictionary), let("free", _free_sql(), row)))


def message_sql(tree: str, max_layer: int | None = 3, exclude_names: tuple[str, ...] = (), **options) -> str:
    """All fields of a VARIANT record that hold something, with their detections, as one array."""
    fields = fields_sql(tree)
    if exclude_names:
        fields = f"filter({fields}, f -> NOT {leaf_sql('f.field_path')} IN ({', '.join(map(quoted, exclude_names))}))"
    return f"filter(transform({fields}, f -> {detections_sql(str(clamp_layer_value(max_layer)), **options)}), x -> size(x.es) > 0)"


def best_sql(es: str) -> str:
    """The best detection of each tag in a list; the first of equals wins."""
    ranked = f"sort_array(transform({es}, (e, i) -> named_struct('down', -e.score, 'rank', i, 'e', e)))"
    return let("r", ranked, "transform(array_distinct(transform(r, x -> x.e.tag)), t -> filter(r, x -> x.e.tag = t)[0].e)")
