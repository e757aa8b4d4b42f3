"""What each query must return, as SQL over the same tables for another engine."""

from __future__ import annotations

import re

from fieldscan.functions.dictionary import FREE_TEXT_MIN_WORDS, FREE_TEXT_NAMES
from fieldscan.functions.names import keyword_rows
from fieldscan.functions.patterns import CONTEXT_BOOST, CONTEXT_WORDS, PATTERNS, Pattern
from fieldscan.functions.taxonomy import ALERT_TAGS, ENTITY_TAG, TAG_PRIORITY, TAGS
from fieldscan.functions.text import BLANK
from fieldscan.operators.entities import gazetteer_patterns
from workload.inputs import KINDS, LOST, TAGGED


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def flat(kind: str) -> str:
    """SELECT of (msg_id, topic, event_time, field_path, value) of a kind."""
    name, msg_id, topic, _, time, leaves = KINDS[kind]
    rows = [
        f"SELECT {msg_id} AS msg_id, {topic} AS topic, {time or 'NULL::TIMESTAMP'} AS event_time, "
        f"{q(path)} AS field_path, {sql} AS value FROM {name}"
        for path, sql in leaves.items()
    ]
    return "SELECT * FROM (" + "\nUNION ALL ".join(rows) + ") WHERE value IS NOT NULL"


def words(name: str) -> str:
    s = f"regexp_replace({name}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    s = f"regexp_replace({s}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"lower(trim(regexp_replace({s}, '[^a-zA-Z0-9]+', ' ', 'g')))"


def leaf(path: str) -> str:
    return f"regexp_replace(string_split({path}, '.')[-1], '^[\\[\\]0-9]+|[\\[\\]0-9]+$', '', 'g')"


def plain(value: str) -> str:
    marks = f"regexp_replace({value}, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', ' ', 'g')"
    return f"regexp_replace({marks}, '[^\\x00-\\x7F]', '_', 'g')"


def dictionary() -> str:
    rows = ", ".join(
        f"({o}, {q(e)}, {q(t)}, {s}::DOUBLE, {k}, {q(kw)}, {q(run)})" for o, e, t, s, k, kw, run in keyword_rows()
    )
    return f"(VALUES {rows}) AS d(ord, entity_type, tag, score, kw_ord, keyword, run)"


def many_words(value: str) -> str:
    rx = f"^[{BLANK}]*(?:[^{BLANK}]+[{BLANK}]+){{{FREE_TEXT_MIN_WORDS - 1}}}[^{BLANK}]"
    return f"(regexp_matches({value}, {q(rx)}) AND contains({value}, ' '))"


def is_free(words_: str, value: str, hits: str) -> str:
    names = "(?:^| )(?:" + "|".join(FREE_TEXT_NAMES) + ")(?: |$)"
    return f"CASE WHEN regexp_matches({words_}, {q(names)}) THEN true WHEN {hits} THEN false ELSE {many_words(value)} END"


def luhn(hit: str) -> str:
    digits = f"regexp_replace({hit}, '[^0-9]', '', 'g')"
    one = f"substr({digits}, (length({digits}) - j + 1)::INT, 1)::INT"
    total = (
        f"list_sum(list_transform(range(1, length({digits}) + 1), lambda j: "
        f"CASE WHEN j % 2 = 0 THEN CASE WHEN {one} > 4 THEN {one} * 2 - 9 ELSE {one} * 2 END ELSE {one} END))"
    )
    return f"({total} % 10 = 0)"


def row_hits(p: Pattern, order: int) -> str:
    """Every match of one pattern row, with the score its context gives it."""
    rx = q(p.regex)
    score = f"{p.score}::DOUBLE"
    if p.context:
        before = "string_split(translate(left(plain, start::INT), chr(9) || chr(10) || chr(13), '   '), ' ')"
        cue = f"regexp_matches(lower(array_to_string({before}[-{CONTEXT_WORDS + 1}:], ' ')), {q('|'.join(p.context))})"
        score = f"CASE WHEN {cue} THEN {round(min(1.0, p.score + CONTEXT_BOOST), 4)}::DOUBLE ELSE {score} END"
    check = f"WHERE {luhn('hit')}" if p.check == "luhn" else ""
    return f"""
      SELECT msg_id, topic, event_time, field_path, value, {q(p.entity_type)} AS entity_type, {q(ENTITY_TAG[p.entity_type])} AS tag,
             {score} AS score, start, start + length(hit) AS "end", hit, {p.layer} AS layer,
             {q(p.source)} AS source, {order} AS ord
      FROM (SELECT *, ms[j] AS hit,
                   coalesce(list_sum(list_transform(gaps[1:j], lambda g: length(g))), 0)
                   + coalesce(list_sum(list_transform(ms[1:j-1], lambda g: length(g))), 0) AS start
            FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS j
                  FROM (SELECT *, regexp_extract_all(plain, {rx}) AS ms, string_split_regex(plain, {rx}) AS gaps
                        FROM plains WHERE regexp_matches(plain, {rx})))) {check}"""


# Best first, a hit stays if it overlaps none that stays: a fold over each field's ranked hits.
_RANKED = """list({'start': start, 'stop': "end", 'ord': ord} ORDER BY score DESC, length(hit) DESC, start, ord)"""
APART = f"""
      SELECT h.* FROM hits h JOIN (
        SELECT msg_id, field_path, entity_type, layer, unnest(list_reduce(list_transform(hs, lambda x: [x]), lambda kept, x:
          CASE WHEN len(list_filter(kept, lambda k: k.start < x[1].stop AND x[1].start < k.stop)) = 0 THEN list_concat(kept, x) ELSE kept END)) AS k
        FROM (SELECT msg_id, field_path, entity_type, layer, {_RANKED} AS hs FROM hits GROUP BY ALL)) s
      ON s.msg_id = h.msg_id AND s.field_path = h.field_path AND s.entity_type = h.entity_type AND s.layer = h.layer
        AND s.k.start = h.start AND s.k.stop = h."end" AND s.k.ord = h.ord"""


def detections(
    kind: str, layers: int = 2, source: str | None = None, only: list[str] | None = None, patterns: list[Pattern] | None = None,
    phrases: list[Pattern] | None = None,
) -> str:
    """CTE list ending in ``det``: every detection with its rank in its field."""
    own = PATTERNS if patterns is None else patterns
    rows = [p for p in own if only is None or p.entity_type in only] if layers >= 2 else []
    matches = [row_hits(p, i) for some in (rows, (gazetteer_patterns() if phrases is None else phrases) if layers >= 3 else []) for i, p in enumerate(some)]
    l1 = f"""
      SELECT f.msg_id, f.topic, f.event_time, f.field_path, f.value, n.entity_type, n.tag, n.score, 0 AS start,
             length(f.value) AS "end", f.value AS hit, 1 AS layer, 'field_name' AS source, n.ord
      FROM named f JOIN names n ON n.field_path = f.field_path"""
    every = "\nUNION ALL BY NAME ".join([l1, *([APART] if matches else [])])
    hits = f"hits AS ({' UNION ALL '.join(matches)})," if matches else ""
    return f"""
    flat AS ({source or flat(kind)}),
    named AS (SELECT *, {words(leaf('field_path'))} AS words FROM flat),
    paths AS (SELECT DISTINCT field_path, words FROM named),
    names AS (SELECT p.field_path, d.entity_type, d.tag, d.score, d.ord
              FROM paths p JOIN {dictionary()} ON contains(' ' || p.words || ' ', ' ' || d.run || ' ')
              GROUP BY ALL),
    plains AS (SELECT msg_id, topic, event_time, field_path, value, {plain('value')} AS plain FROM flat),
    {hits}
    found AS ({every}),
    det AS (SELECT x.*, row_number() OVER (PARTITION BY x.msg_id, x.field_path
                     ORDER BY layer, -score, CASE WHEN layer = 1 THEN ord ELSE start END, ord) - 1 AS rank,
                   CASE WHEN layer = 1 THEN substring(x.value, 1, 80)
                        ELSE substring(x.value, (start + 1)::INT, ("end" - start)::INT) END AS text_snippet
            FROM found x),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY msg_id, field_path, tag ORDER BY score DESC, rank) AS place FROM det)
             WHERE place = 1)"""


def example(snippet: str) -> str:
    return f"CASE WHEN length({snippet}) > 50 THEN substring({snippet}, 1, 47) || '...' ELSE {snippet} END"


def tier(score: str) -> str:
    return f"CASE WHEN {score} >= 0.85 THEN 'HIGH' WHEN {score} >= 0.60 THEN 'MEDIUM' ELSE 'LOW' END"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def det_list(kind: str, layers: int = 2, where: str = "true") -> str:
    return f"""WITH {detections(kind, layers)}
    SELECT msg_id, topic, d.field_path, entity_type, tag, round(score, 4) AS score, start AS span_start, "end" AS span_end,
           text_snippet, layer, source, rank,
           {is_free('n.words', 'n.value', 'EXISTS (SELECT 1 FROM names h WHERE h.field_path = d.field_path)')} AS is_free_text
    FROM det d JOIN (SELECT msg_id AS m, field_path AS p, words, value FROM named) n ON n.m = d.msg_id AND n.p = d.field_path
    WHERE {where}"""


SUMMARY = """
    summary AS (SELECT msg_id, topic, list_sort(list_distinct(list(tag))) AS tags,
                       list_sort(list_distinct(list(entity_type))) AS entities FROM det GROUP BY msg_id, topic)"""


def primary(tags: str) -> str:
    ranked = " ".join(f"WHEN list_contains({tags}, {q(t)}) THEN {q(t)}" for t in TAG_PRIORITY)
    return f"CASE {ranked} END"


def triggers() -> str:
    return """
    messages AS (SELECT cast(event_id AS VARCHAR) AS msg_id, event_type AS topic, ts AS event_time FROM events),
    triggers AS (
      SELECT DISTINCT 'scheduled' AS trigger_type, event_type AS source_topic,
             time_bucket(INTERVAL '60 minutes', ts) + INTERVAL '60 minutes' AS triggered_at FROM events
      UNION ALL
      SELECT 'manual', 'click', min(ts) FROM events GROUP BY user_id),
    scanned AS (SELECT m.*, t.* FROM triggers t JOIN messages m ON m.topic = t.source_topic
                AND m.event_time BETWEEN t.triggered_at - INTERVAL '2 minutes' AND t.triggered_at)"""


def registry_ctes() -> str:
    """schemas and fields as ``inputs.registry`` builds them."""
    leaves = list(KINDS["customers"][5])

    def paths(names: list[str]) -> list[str]:
        out = []
        for name in names:
            parts = re.sub(r"\[\d+\]", "", name).split(".")
            out += [".".join(parts[: i + 1]) for i in range(len(parts))]
        return sorted(set(out))

    kept = [p for p in leaves if p not in LOST]
    full = ", ".join(f"({q(p)})" for p in paths(leaves))
    lost = ", ".join(f"({q(p)})" for p in paths(kept))
    tagged = ", ".join(f"({q(p)}, {q(t)})" for p, ts in TAGGED.items() for t in ts)
    return f"""
    schemas AS (SELECT c_mktsegment || '-value' AS subject, v AS version, length(c_mktsegment) * 10 + v AS id,
                       CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'JSON' ELSE 'AVRO' END AS schema_type
                FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'), (VALUES (1), (2)) AS vs(v)),
    fields AS (SELECT subject, version, p AS field_path FROM schemas, (VALUES {full}) AS ps(p)
               WHERE schema_type = 'AVRO' AND NOT (subject = 'FURNITURE-value' AND version = 2)
               UNION ALL SELECT subject, version, p FROM schemas, (VALUES {lost}) AS ps(p)
               WHERE subject = 'FURNITURE-value' AND version = 2),
    tagged AS (SELECT 'FURNITURE-value' AS subject, 2 AS version, p AS field_path, t AS tag
               FROM (VALUES {tagged}) AS ts(p, t) WHERE EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'FURNITURE'))"""


def recommendations() -> str:
    """``recs``: after a layer-1 scan, then a layer-2 scan of the customer topics."""
    return f"""{detections('customers', 2)},
    wave2 AS (SELECT topic, field_path, tag, confidence, entity_type, layer, source FROM (
                SELECT topic, field_path, tag, score AS confidence, entity_type, layer, source,
                       row_number() OVER (PARTITION BY topic, field_path, tag ORDER BY score DESC, layer, source, entity_type) AS p2
                FROM best) WHERE p2 = 1),
    recs AS (SELECT topic, topic || '-value' AS subject, field_path, tag AS proposed_tag, entity_type,
                    round(confidence, 4) AS confidence, {tier('confidence')} AS confidence_tier, layer, source, 'PENDING' AS status
             FROM wave2)"""


def validated(status: str = "STAGED") -> str:
    """``checked``: staged rows (confidence ≥ 0.85) with the reason they fail."""
    return f"""{recommendations()}, {registry_ctes()},
    latest AS (SELECT subject, max(version) AS version FROM schemas GROUP BY subject),
    checked AS (
      SELECT r.*, l.version, s.id AS version_id, regexp_replace(r.field_path, '\\[[0-9]+\\]', '', 'g') AS clean_path,
             CASE WHEN l.version IS NULL THEN 'could not resolve schema version in SR'
                  WHEN NOT EXISTS (SELECT 1 FROM fields f WHERE f.subject = r.subject AND f.version = l.version)
                    THEN 'could not fetch/parse SR schema'
                  WHEN NOT EXISTS (SELECT 1 FROM fields f WHERE f.subject = r.subject AND f.version = l.version
                       AND f.field_path = regexp_replace(r.field_path, '\\[[0-9]+\\]', '', 'g'))
                    THEN 'field not in current SR schema' END AS reason
      FROM recs r LEFT JOIN latest l USING (subject) LEFT JOIN schemas s ON s.subject = r.subject AND s.version = l.version
      WHERE r.confidence >= 0.85)"""


ALERTS = ", ".join(q(t) for t in ALERT_TAGS)
TAG_FLAGS = ", ".join(f"max((tag = {q(t)})::INT) AS {q(t)[1:-1]}" for t in TAGS)
