"""Leaves of a JSON container as one expression, at any depth.

The text is cut into tokens and folded with a stack of the containers that are open. The
fold puts out where a leaf's token is and not the token, which may be long.
"""

from __future__ import annotations

from fieldscan.functions.fold import gather_sql
from fieldscan.functions.text import quoted

# Names with their colon, strings, brackets, and numbers and words; commas say nothing.
_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*:)?|[\[\]{}]|[^\s\[\]{}:,"]+'
_OPEN = "array<struct<path:string,i:int>>"
_PATH = "CASE WHEN top IS NULL THEN '' WHEN top.i >= 0 THEN concat(top.path, '[', top.i, ']') ELSE concat(top.path, '.', s.key) END"
# The stack once a value has begun: a list goes on to its next place.
_ON = f"""CASE WHEN top IS NULL OR top.i < 0 THEN s.open
    ELSE concat(slice(s.open, 1, size(s.open) - 1), array(named_struct('path', top.path, 'i', top.i + 1))) END"""
_QUOTED = "rtrim(':', x.t)"
_NAME = f"if(contains(x.t, '\\\\'), try_variant_get(try_parse_json({_QUOTED}), '$', 'string'), substring(trim({_QUOTED}), 2, length(trim({_QUOTED})) - 2))"


def leaves_sql(text: str) -> str:
    """SQL for the leaves of JSON text, in order: the path under it (``.name`` or ``[0]`` per
    level) and the leaf as JSON. Empty containers have none."""

    def step(state) -> str:
        opens = f"concat({_ON}, array(named_struct('path', {_PATH}, 'i', if(x.t = '[', 0, -1))))"
        return f"""transform(array(try_element_at(s.open, -1)), top -> CASE
            WHEN x.t IN ('{{', '[') THEN {state(open=opens)}
            WHEN x.t IN ('}}', ']') THEN {state(open="slice(s.open, 1, size(s.open) - 1)")}
            WHEN endswith(x.t, ':') THEN {state(key=_NAME)}
            ELSE {state(f"array(named_struct('under', {_PATH}, 'i', x.i))", open=_ON)} END)[0]"""

    folded = gather_sql("xs", {"open": f"cast(array() AS {_OPEN})", "key": "cast(null AS string)"}, "struct<under:string,i:int>", step)
    numbered = "transform(ts, (t, i) -> named_struct('t', t, 'i', i))"
    leaves = f"transform({folded}, l -> named_struct('under', l.under, 'json', ts[l.i]))"
    return f"transform(array(regexp_extract_all({text}, {quoted(_TOKEN)}, 0)), ts -> transform(array({numbered}), xs -> {leaves})[0])[0]"
