"""Layer 2 as expressions: a pattern table and the spans its rows find."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscan.functions.fold import gather_sql
from fieldscan.functions.taxonomy import DEFAULT_TAG, ENTITY_TAG
from fieldscan.functions.text import plain_text, quoted, spans_sql

# Fixed value: ISO country codes accepted in positions 5-6 of a bank code.
SWIFT_COUNTRIES = """
AD AE AF AG AL AM AO AR AT AU AZ BA BB BD BE BF BG BH BI BJ BN BO BR BS BT BW BY BZ
CA CD CF CG CH CI CL CM CN CO CR CU CV CY CZ DE DJ DK DM DO DZ EC EE EG ER ES ET FI FJ
FM FR GA GB GD GE GH GM GN GQ GR GT GW GY HN HR HT HU ID IE IL IN IQ IR IS IT JM JO JP
KE KG KH KI KM KN KP KR KW KZ LA LB LC LI LK LR LS LT LU LV LY MA MC MD ME MG MH MK
ML MM MN MR MT MU MV MW MX MY MZ NA NE NG NI NL NO NP NR NZ OM PA PE PG PH PK PL PT
PW PY QA RO RS RU RW SA SB SC SD SE SG SI SK SL SM SN SO SR SS ST SV SY SZ TC TD TG TH
TJ TL TM TN TO TR TT TV TZ UA UG US UY UZ VA VC VE VN VU WS XK YE ZA ZM ZW
""".split()

# Words that make a run of digits a bank account.
BANK_WORDS = ["account", "acct", "bank", "iban", "routing", "deposit", "checking", "savings"]

CONTEXT_BOOST = 0.35
CONTEXT_WORDS = 5
# Context is first looked for in so many characters before a hit.
_NEAR = 256


@dataclass(frozen=True)
class Pattern:
    """One detector row.

    ``hint`` and ``gate`` are cheap tests that must hold before the scan. ``hint``
    reads the original text: ``"digit"`` wants an ASCII digit, ``"capitals"`` six
    ASCII capitals in a row, ``"A|B"`` one of the literals. ``gate`` is a regex over the plain text. Without them a row scans
    every text.
    """

    entity_type: str
    regex: str
    score: float
    hint: str | None = None
    gate: str | None = None
    context: tuple[str, ...] = ()
    check: str | None = None
    language: str = "en"
    layer: int = 2
    source: str = "regex"


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_HINT_REGEX = {"digit": "[0-9]", "capitals": "[A-Z]{6}"}

# Detector patterns and scores. Every regex stays inside the
# subset that java.util.regex and RE2 read alike.
PATTERNS = [
    Pattern("IBAN_CODE", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}([A-Z0-9]?){0,16}\b", 0.95, "digit", "[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}"),
    Pattern("SWIFT_CODE", r"\b[A-Z]{4}(?:" + "|".join(SWIFT_COUNTRIES) + r")[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", 0.90, "capitals", "[A-Z]{6}[A-Z0-9]{2}"),
    Pattern("CRYPTO_WALLET", r"\b0x[a-fA-F0-9]{40}\b", 0.90, "digit", "(?:0x|bc1|[13])[a-zA-Z0-9]{25}"),
    Pattern("CRYPTO_WALLET", r"\b(bc1|[13])[a-zA-HJ-NP-Z0-9]{25,62}\b", 0.85, "digit", "(?:0x|bc1|[13])[a-zA-Z0-9]{25}"),
    Pattern("NATIONAL_PROVIDER_ID", r"\b[12][0-9]{9}\b", 0.55, "digit", "[12][0-9]{9}"),
    Pattern("DEA_NUMBER", r"\b[A-Z]{2}[0-9]{7}\b", 0.75, "digit", "[A-Z]{2}[0-9]{7}"),
    Pattern("HEALTH_INSURANCE", r"\b[1-9][A-Z0-9]{10}\b", 0.65, "digit", "[1-9][A-Z0-9]{10}|[A-Z]{2}[0-9]{6}"),
    Pattern("HEALTH_INSURANCE", r"\b[A-Z]{2,4}[0-9]{6,12}\b", 0.50, "digit", "[1-9][A-Z0-9]{10}|[A-Z]{2}[0-9]{6}"),
    Pattern("BANK_ACCOUNT", r"\b[0-9]{8,17}\b", 0.15, "digit", "[0-9]{8}", context=tuple(BANK_WORDS)),
    Pattern("US_BANK_ROUTING", r"\b0[0-9]{8}\b|\b[1-9][0-9]{8}\b", 0.60, "digit", "[0-9]{9}"),
    # General detectors and secrets: our own specification.
    Pattern("EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}\b", 1.0, "@"),
    Pattern("PHONE_NUMBER", r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])|\([0-9]{3}\) ?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b", 0.40, "digit", "[0-9]{3}[ .-][0-9]{4}", context=("phone", "telephone", "cell", "mobile", "call", "fax")),
    Pattern("US_SSN", r"\b[0-9]{3}[- .][0-9]{2}[- .][0-9]{4}\b", 0.50, "digit", "[0-9][- .][0-9]{2}[- .][0-9]{4}", context=("social", "security", "ssn", "ssns")),
    Pattern("CREDIT_CARD", r"\b[3-6][0-9]{3}[- ]?[0-9]{3,4}[- ]?[0-9]{3,4}[- ]?[0-9]{3,5}\b", 1.0, "digit", "[3-6][0-9]{3}[- ]?[0-9]{3}", check="luhn"),
    Pattern("IP_ADDRESS", rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", 0.60, "digit", r"[0-9]\.[0-9]{1,3}\.[0-9]", context=("ip", "ipv4", "ipv6")),
    Pattern("AWS_ACCESS_KEY", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", 0.95, "AKIA|ASIA"),
    Pattern("JWT_TOKEN", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]{2,}", 0.95, "eyJ"),
    Pattern("PRIVATE_KEY", r"-----BEGIN (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----", 0.95, "-----BEGIN"),
    Pattern("CONNECTION_STRING", r"\b(?:postgres|postgresql|mysql|mariadb|mongodb|mongodb\+srv|redis|amqp|amqps|sqlserver|oracle)://[^ \t\n\r\"'<>]+", 0.90, "://"),
    Pattern("API_KEY", r"\b(?:sk|pk|rk|ak)[-_](?:live[-_]|test[-_])?[A-Za-z0-9]{16,}\b", 0.90, "sk|pk|rk|ak", "[spra]k[-_][a-zA-Z0-9]{4}"),
    Pattern("ACCESS_TOKEN", r"\bgh[pousr]_[A-Za-z0-9]{36}\b", 0.95, "ghp|gho|ghu|ghs|ghr|earer|token"),
    Pattern("ACCESS_TOKEN", r"\b[Bb]earer [A-Za-z0-9._~+/-]{20,}", 0.80, "ghp|gho|ghu|ghs|ghr|earer|token"),
    Pattern("ACCESS_TOKEN", r"\b(?:[a-z]+_)?token ?[=:] ?[\"']?[A-Za-z0-9._-]{20,}", 0.75, "ghp|gho|ghu|ghs|ghr|earer|token"),
    Pattern("SECRET_KEY", r"\b(?:[a-z]+_)?secret(?:_key)? ?[=:] ?[\"']?[A-Za-z0-9/+=_-]{16,}", 0.75, "secret"),
    Pattern("PASSWORD", r"\b(?:password|passwd|pwd) ?[=:] ?[\"']?[^ \t\n\r\"']{4,}", 0.75, "passw|pwd"),
]

HIT = "struct<down:double,start:int,ord:int,stop:int,hit:string,entity_type:string,tag:string,score:double,layer:int,source:string>"
NO_HITS = f"cast(array() AS array<{HIT}>)"


def by_entity(patterns: list[Pattern], language: str) -> list[list[tuple[int, Pattern]]]:
    """Numbered rows of one entity type and layer together, in table order."""
    groups: dict[tuple[str, int], list[tuple[int, Pattern]]] = {}
    for i, p in enumerate(patterns):
        if p.language == language:
            groups.setdefault((p.entity_type, p.layer), []).append((i, p))
    return list(groups.values())


def context_sql(text: str, start: str) -> str:
    """The five words before a hit, however long they are.

    They nearly always lie in the last few characters; the whole text before the hit is
    only cut into words where those hold fewer.
    """

    def words(x: str) -> str:
        return f"substring_index(translate({x}, '\\t\\n\\r', '   '), ' ', -{CONTEXT_WORDS + 1})"

    near = words(f"substring({text}, greatest({start} - {_NEAR - 1}, 1), least({start}, {_NEAR}))")
    every = words(f"substring({text}, 1, {start})")
    return f"lower(transform(array({near}), w -> if({start} <= {_NEAR} OR length(w) < {_NEAR}, w, {every}))[0])"


def hint_sql(value: str, hint: str) -> str:
    if hint in _HINT_REGEX:
        return f"{value} RLIKE {quoted(_HINT_REGEX[hint])}"
    return "(" + " OR ".join(f"contains({value}, {quoted(w)})" for w in hint.split("|")) + ")"


def row_sql(text: str, p: Pattern, order: int, tag: str) -> str:
    """Hits of one row in a plain text column."""
    spans = spans_sql(text, p.regex)
    if p.check == "luhn":
        spans = f"filter({spans}, m -> luhn_check(regexp_replace(m.hit, '[^0-9]', '')))"

    def hit(score: str) -> str:
        return f"""struct(-{score} AS down, m.start AS start, {order} AS ord, m.start + length(m.hit) AS stop,
            m.hit AS hit, {quoted(p.entity_type)} AS entity_type, {quoted(tag)} AS tag, {score} AS score,
            {p.layer} AS layer, {quoted(p.source)} AS source)"""

    if not p.context:
        return f"transform({spans}, m -> {hit(f'{p.score}D')})"
    high = round(min(1.0, p.score + CONTEXT_BOOST), 4)
    score = f"if({context_sql(text, 'm.start')} RLIKE {quoted('|'.join(p.context))}, {high}D, {p.score}D)"
    return f"transform({spans}, m -> transform(array({score}), score -> {hit('score')})[0])"


def apart_sql(hits: str) -> str:
    """``hits`` of one entity type, best first, each only if no hit that stays overlaps it.

    Better is the higher score, then the longer hit, then the earlier one, then the
    earlier row. So of a chain in which A is better than B and B better than C, where only
    neighbours overlap, A and C stay. Hits are sorted by place and swept once into groups
    that hang together; only a group is gone through best first.
    """
    none = f"cast(array() AS array<{HIT}>)"
    rank = "named_struct('down', -h.score, 'short', h.start - h.stop, 'start', h.start, 'ord', h.ord, 'hit', h)"
    free = "NOT exists(kept, k -> k.start < r.hit.stop AND r.hit.start < k.stop)"

    def best(group: str) -> str:
        fold = f"aggregate(sort_array(transform({group}, h -> {rank})), {none}, (kept, r) -> if({free}, concat(kept, array(r.hit)), kept))"
        return f"if(size({group}) < 2, {group}, {fold})"

    def sweep(state) -> str:
        joins = state(reach="greatest(s.reach, x.hit.stop)", group="concat(s.group, array(x.hit))")
        return f"if(x.start < s.reach, {joins}, {state(best('s.group'), reach='x.hit.stop', group='array(x.hit)')})"

    swept = gather_sql("xs", {"reach": "-1", "group": none}, HIT, sweep, best("e.group"))
    placed = "sort_array(transform(hs, h -> named_struct('start', h.start, 'hit', h)))"
    return f"transform(array({hits}), hs -> if(size(hs) < 2, hs, transform(array({placed}), xs -> {swept})[0]))[0]"


@lru_cache(maxsize=64)
def hit_parts(
    patterns: tuple[Pattern, ...], language: str, tags: tuple[tuple[str, str], ...], holder: str = ""
) -> tuple[dict, dict, str] | None:
    """Column names of hints and of gates, and the SQL that gathers all hits. Texts only,
    so they are made once for a table of rows. ``holder`` names a struct whose fields the
    gates are, for use in a lambda."""
    groups = by_entity(list(patterns), language)
    if not groups:
        return None
    rows = [p for g in groups for _, p in g]
    hints = {h: f"_hint{i}" for i, h in enumerate(dict.fromkeys(p.hint for p in rows))}
    gates = {k: f"_gate{i}" for i, k in enumerate(dict.fromkeys((p.hint, p.gate) for p in rows))}
    extra, parts = dict(tags), []
    for group in groups:
        entity = group[0][1].entity_type
        tag = extra.get(entity, ENTITY_TAG.get(entity, DEFAULT_TAG))
        # Taking hits out of a text costs far more than a look whether there is one, and so does
        # looking at rows of one entity type together.
        own = [f"CASE WHEN {holder}{gates[p.hint, p.gate]} THEN {row_sql('plain', p, i, tag)} ELSE {NO_HITS} END" for i, p in group]
        passed = " OR ".join(f"{holder}{gates[p.hint, p.gate]} AND plain RLIKE {quoted(p.regex)}" for _, p in group)
        every = row_sql("plain", group[0][1], group[0][0], tag) if len(own) == 1 else apart_sql(f"concat({', '.join(own)})")
        parts.append(f"CASE WHEN {passed} THEN {every} ELSE {NO_HITS} END")
    return hints, gates, f"sort_array(concat({', '.join([NO_HITS, *parts])}))"


def with_pattern_hits(
    df: DataFrame, value: str = "value", out: str = "hits", patterns=None, language: str = "en", wanted: Column | None = None, extra_tags=None
) -> DataFrame:
    """Add ``out``: all hits of ``value``, best score first, then by position; and
    ``plain``, the text they were found in (null where no test passed).

    Tests run from cheap to dear, each its own column: literals and digits in the
    original text, then one short regex per distinct gate, and only then the scan,
    one per row, behind the row's own tests. Most texts of most tables stop at the first.
    """
    parts = hit_parts(tuple(PATTERNS if patterns is None else patterns), language, tuple(sorted((extra_tags or {}).items())))
    if parts is None:
        return df.withColumn("plain", F.lit(None).cast("string")).withColumn(out, F.expr(NO_HITS))
    hints, gates, found = parts
    keep = [c for c in df.columns if c != "plain"]
    first = {c: F.expr(hint_sql(value, h) if h else f"{value} IS NOT NULL") for h, c in hints.items()}
    if wanted is not None:
        first = {c: wanted & test for c, test in first.items()}
    hinted = df.select(*keep, *[test.alias(c) for c, test in first.items()])
    texts = hinted.select(
        "*", F.when(F.expr(" OR ".join(hints.values())), plain_text(F.col(value))).alias("plain")
    )
    gated = texts.select(
        *keep,
        "plain",
        *[
            F.expr(f"{hints[h]} AND plain RLIKE {quoted(g)}" if g else hints[h]).alias(c)
            for (h, g), c in gates.items()
        ],
    )
    return gated.select(*keep, "plain", F.when(F.expr(" OR ".join(gates.values())), F.expr(found)).otherwise(F.expr(NO_HITS)).alias(out))
