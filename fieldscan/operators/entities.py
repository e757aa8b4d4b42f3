"""Layer 3: entity recognizers that plug into ``detect``."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscan.functions.dictionary import (
    GAZETTEER_SCORE,
    NER_THRESHOLD,
    gazetteer_phrases,
    ner_labels,
)
from fieldscan.functions.fold import gather_sql
from fieldscan.functions.patterns import Pattern
from fieldscan.functions.taxonomy import literal_map, tag_of
from fieldscan.functions.text import is_blank, match_spans, plain_text
from fieldscan.operators.members import bloom_bits, maybe_in

# Marks that a phrase may have before its first and after its last word.
EDGE = 16
# What automata may take in every task, in one part of them, and roughly per character.
AUTOMATON_BYTES = 64 << 20
PART_BYTES = 16 << 20
NODE_BYTES = 40
TEXTS_AT_ONCE = 500
SPAN = "struct<label:string,start:int,end:int,score:double>"


def gazetteer_patterns(phrases: list[tuple[str, str]] | None = None, score: float = GAZETTEER_SCORE) -> list[Pattern]:
    """Phrases (phrase, label) as layer-3 pattern rows, one scan per entity type.

    ``gazetteer`` does the same by a join with a table of phrases.
    """
    phrases = gazetteer_phrases() if phrases is None else phrases
    labels = ner_labels()
    by_entity: dict[str, list[str]] = {}
    for phrase, label in phrases:
        if label in labels:
            by_entity.setdefault(labels[label], []).append(phrase)
    return [
        Pattern(
            entity,
            r"\b(?:" + "|".join(re.escape(p).replace(r"\ ", " ") for p in sorted(ps, key=lambda p: (-len(p), p))) + r")\b",
            score,
            # The longest word of a phrase occurs wherever the phrase does.
            hint="|".join(dict.fromkeys(max(p.split(), key=len) for p in ps)),
            layer=3,
            source="ai_model",
        )
        for entity, ps in by_entity.items()
    ]


def known_phrases(phrases: DataFrame) -> DataFrame:
    """Phrases that are looked for: ``core, lead, tail, entity_type, score``.

    The core goes from a phrase's first to its last word character; lead and tail are the
    marks around it ("C++" has the tail "++"). Phrases without a word character, with a
    lead or tail of over 16 characters, or of an unknown label are left out (see ``rejected_phrases``).
    Of a phrase that comes twice for an entity type, the best score counts.
    """
    rows = _parted(phrases).where(_fits())
    return rows.groupBy("core", "lead", "tail", "entity_type").agg(F.max("score").alias("score"))


def rejected_phrases(phrases: DataFrame) -> DataFrame:
    """The rows of ``phrases`` that ``gazetteer`` does not look for."""
    return _parted(phrases).where(~_fits()).select(*phrases.columns)


def _parted(phrases: DataFrame) -> DataFrame:
    rows = phrases.select("*", F.trim("phrase").alias("_text")).withColumn("_plain", plain_text(F.col("_text")))
    rows = rows.withColumn("_lead", F.length(F.regexp_extract("_plain", "^[^A-Za-z0-9_]*", 0)))
    rows = rows.withColumn("_tail", F.length(F.regexp_extract("_plain", "[^A-Za-z0-9_]*$", 0)))
    size = F.length("_text") - F.col("_lead") - F.col("_tail")
    return rows.select(
        *phrases.columns, F.substring("_text", F.col("_lead") + 1, size).alias("core"), F.substring("_text", F.lit(1), F.col("_lead")).alias("lead"),
        F.substring("_text", F.length("_text") - F.col("_tail") + 1, F.col("_tail")).alias("tail"),
        F.try_element_at(literal_map(ner_labels()), F.col("label")).alias("entity_type"),
    )


def _fits() -> Column:
    edges = (F.length("lead") <= EDGE) & (F.length("tail") <= EDGE)
    return F.coalesce((F.length("core") > 0) & edges & F.col("entity_type").isNotNull(), F.lit(False))


def _automaton(table: pa.Table) -> pa.Table:
    """One part's phrases as a serialised automaton of their cores."""
    found: dict[str, list] = {}
    for row in table.to_pylist():
        found.setdefault(row["core"], []).append((row["lead"], row["tail"], row["entity_type"], row["score"]))
    machine = ahocorasick.Automaton()
    for core, ends in found.items():
        machine.add_word(core, (len(core), ends))
    machine.make_automaton()
    return pa.table({"part": table.column("part")[:1], "data": pa.array([pickle.dumps(machine)], pa.binary())})


def automata(known: DataFrame, most_bytes: int = AUTOMATON_BYTES) -> list[bytes] | None:
    """Aho-Corasick automata over ``known`` phrases, made in tasks of bounded size; None if
    they would take more than ``most_bytes``, which is checked before anything is fetched."""
    chars = known.agg(F.sum(F.length("core"))).first()[0] or 0
    if chars * NODE_BYTES > most_bytes:
        return None
    parts = max(1, -(-chars * NODE_BYTES // PART_BYTES))
    dealt = known.withColumn("part", F.pmod(F.xxhash64("core"), F.lit(parts)).cast("int"))
    return [bytes(r["data"]) for r in dealt.groupBy("part").applyInArrow(_automaton, "part int, data binary").collect()]


def _is_word(plain: str, at: int) -> bool:
    return 0 <= at < len(plain) and (plain[at].isalnum() or plain[at] == "_")


def phrase_spans(machines: list, value: str, plain: str) -> list[dict]:
    """Phrases in a text, between word borders; of overlapping ones of one entity type the
    leftmost, then the longest. ``plain`` tells word characters."""
    hits: dict[tuple[str, int, int], float] = {}
    for machine in machines:
        for last, (size, ends) in machine.iter(value):
            start = last + 1 - size
            if _is_word(plain, start - 1) or _is_word(plain, last + 1):
                continue
            for lead, tail, entity, score in ends:
                a, b = start - len(lead), last + 1 + len(tail)
                if value[max(0, a) : start] == lead and value[last + 1 : b] == tail:
                    hits[entity, a, b] = max(score, hits.get((entity, a, b), score))
    kept, end = [], {}
    for (entity, a, b), score in sorted(hits.items(), key=lambda h: (h[0][1], -h[0][2], h[0][0])):
        if a >= end.get(entity, 0):
            end[entity] = b
            kept.append({"entity_type": entity, "start": a, "end": b, "score": score})
    return kept


def phrase_recognizer(phrases: DataFrame, most_bytes: int = AUTOMATON_BYTES) -> Callable[[Column], Column] | None:
    """The phrases as a recognizer for ``detect``: one pass over each text, no shuffle. None
    if their automata are too large to be sent to every task (see ``gazetteer``)."""
    data = automata(known_phrases(phrases), most_bytes)
    if data is None:
        return None
    shared = phrases.sparkSession.sparkContext.broadcast(data)

    kind = pa.list_(pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    @F.arrow_udf("array<struct<entity_type:string,start:int,end:int,score:double>>")
    def spans(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        # Texts become Python strings one at a time; hits go on in small lists.
        machines = [pickle.loads(x) for x in shared.value]
        for values, plains in batches:
            for at in range(0, len(values), TEXTS_AT_ONCE):
                pairs = zip(values.slice(at, TEXTS_AT_ONCE), plains.slice(at, TEXTS_AT_ONCE))
                yield pa.array([phrase_spans(machines, v.as_py(), p.as_py()) if v.is_valid else None for v, p in pairs], kind)

    def recognize(value: Column) -> Column:
        return F.transform(
            spans(value, plain_text(value)),
            lambda s: F.struct(
                s["entity_type"].alias("entity_type"), tag_of(s["entity_type"]).alias("tag"), F.round(s["score"], 4).alias("score"), s["start"].alias("start"),
                s["end"].alias("end"), F.substring(value, s["start"] + 1, s["end"] - s["start"]).alias("text_snippet"), F.lit(3).alias("layer"), F.lit("ai_model").alias("source"),
            ),
        )

    return recognize


def gazetteer(flat: DataFrame, phrases: DataFrame, ids: list[str], most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Detections of a phrase table of any size ``phrases(phrase, label, score)``, as rows like
    those of ``explode_detections``; ``rank`` counts a field's hits by place.

    A phrase is looked for as it is written, letter case and all, between word borders
    (see ``known_phrases``); of overlapping phrases of one entity type the leftmost, then the
    longest. Phrases whose automata take at most ``most_bytes`` are looked for in the row;
    a larger table is joined: texts' words that begin no phrase are ruled out by a Bloom
    filter first, and only runs of words from the others are shuffled.
    """
    recognizer = phrase_recognizer(phrases, most_bytes)
    place = F.struct("start", "end", "entity_type")
    if recognizer is not None:
        found = flat.select(*ids, "field_path", F.posexplode(recognizer(F.col("value"))).alias("rank", "d"))
        return found.select(*ids, "field_path", "d.*", "rank")
    hits = _joined(flat, known_phrases(phrases), ids)
    spans = F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("down"), "score", "text_snippet")))
    lists = hits.groupBy("field", "entity_type").agg(spans.alias("hits"))
    # Leftmost, then longest: a hit stays if it starts where the last one that stayed has ended.
    kind = "struct<start:int,down:int,score:double,text_snippet:string>"
    kept = gather_sql("hits", {"end": "-1"}, kind, lambda state: f"if(x.start >= s.end, {state('array(x)', end='-x.down')}, s)")
    rows = lists.select("field.*", "entity_type", F.explode(F.expr(kept)).alias("h")).select(
        *ids, "field_path", "entity_type", tag_of(F.col("entity_type")).alias("tag"), F.round("h.score", 4).alias("score"), "h.start",
        (-F.col("h.down")).alias("end"), "h.text_snippet", F.lit(3).alias("layer"), F.lit("ai_model").alias("source"),
    )
    every = F.array_sort(F.collect_list(F.struct(place.alias("place"), "tag", "score", "text_snippet", "layer", "source")))
    fields = rows.groupBy(*ids, "field_path").agg(every.alias("every"))
    return fields.select(*ids, "field_path", F.posexplode("every").alias("rank", "d")).select(
        *ids, "field_path", "d.place.entity_type", "d.tag", "d.score", "d.place.start", "d.place.end", "d.text_snippet", "d.layer", "d.source", "rank"
    )


def _joined(flat: DataFrame, known: DataFrame, ids: list[str]) -> DataFrame:
    """``field, entity_type, start, end, score, text_snippet`` of phrases by a join with runs of words."""
    word = "[A-Za-z0-9_]+"
    known = known.withColumn("words", match_spans("core", r"[\p{L}\p{N}_]+"))
    # How many words phrases have is a handful of numbers, however many phrases there are.
    sizes = known.agg(F.array_sort(F.collect_set(F.size("words")))).scalar()
    first = known.select(F.xxhash64(F.get("words", F.lit(0))["hit"]).alias("key"))
    begins = maybe_in(flat.sparkSession, bloom_bits(first.distinct(), "key"))
    texts = flat.select(F.struct(*ids, "field_path").alias("field"), "value", plain_text(F.col("value")).alias("plain"))
    texts = texts.select("field", "value", match_spans("plain", word).alias("w"), sizes.alias("sizes"))
    texts = texts.withColumn("begins", begins(F.transform("w", lambda x: F.xxhash64(F.substring(F.col("value"), x["start"] + 1, F.length(x["hit"]))))))

    def run(start: Column, last: Column) -> Column:
        end = last["start"] + F.length(last["hit"])
        cut = lambda a, b: F.substring(F.col("value"), a + 1, b - a)
        return F.struct(
            start.alias("start"), end.alias("end"), cut(start, end).alias("core"), cut(F.greatest(start - EDGE, F.lit(0)), start).alias("before"), cut(end, end + EDGE).alias("after")
        )

    def runs_from(first_: Column, i: Column) -> Column:
        here = F.when(F.get("begins", i), F.col("sizes")).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(here, lambda n: n + i <= F.size("w")), lambda n: run(first_["start"], F.get("w", i + n - 1)))

    runs = texts.select("field", F.inline(F.flatten(F.transform("w", runs_from))))
    hits = runs.join(known.drop("words"), "core").where(F.endswith("before", "lead") & F.startswith("after", "tail"))
    lead, tail = F.length("lead"), F.length("tail")
    return hits.select(
        "field", "entity_type", (F.col("start") - lead).alias("start"), (F.col("end") + tail).alias("end"), "score", F.concat("lead", "core", "tail").alias("text_snippet")
    )


def predictor(
    load: Callable[[], Callable[[list[str]], list[list[dict]]]],
    threshold: float = NER_THRESHOLD,
    entities: list[str] | None = None,
    labels: dict[str, str] | None = None,
) -> Callable[[Column], Column]:
    """A model as a recognizer for ``detect``.

    ``load()`` runs once per Python worker and returns ``predict(texts)``, which
    gives for each text a list of ``{label, start, end, score}``. Texts go over in
    Arrow batches. Blank texts are skipped; labels outside the map, scores under
    the threshold and entity types not asked for are dropped.
    """
    known = ner_labels() if labels is None else labels

    @F.pandas_udf(f"array<{SPAN}>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load()
        for texts in batches:
            asked = texts.notna()
            found = iter(predict(texts[asked].tolist()) if asked.any() else [])
            yield pd.Series([
                [{k: hit[k] for k in ("label", "start", "end", "score")} for hit in next(found)] if a else None
                for a in asked
            ])

    def recognize(value: Column) -> Column:
        hits = F.filter(spans(F.when(~is_blank(value), value)), lambda s: s["score"] >= threshold)
        typed = F.transform(
            hits,
            lambda s: F.struct(
                F.try_element_at(literal_map(known), s["label"]).alias("entity_type"), s["start"], s["end"], s["score"]
            ),
        )
        wanted = F.filter(
            typed,
            lambda s: s["entity_type"].isNotNull() & (s["entity_type"].isin(*entities) if entities else F.lit(True)),
        )
        return F.transform(
            wanted,
            lambda s: F.struct(
                s["entity_type"].alias("entity_type"),
                tag_of(s["entity_type"]).alias("tag"),
                F.round(s["score"], 4).alias("score"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.substring(value, s["start"] + 1, s["end"] - s["start"]).alias("text_snippet"),
                F.lit(3).alias("layer"),
                F.lit("ai_model").alias("source"),
            ),
        )

    return recognize


def available(loaders: dict[str, Callable[[], Callable]]) -> tuple[list[Callable[[Column], Column]], list[str]]:
    """(recognizers that load here, names of those that do not): a missing model
    lowers coverage and never stops the job."""
    ready, missing = [], []
    for name, load in loaders.items():
        try:
            load()
        except Exception:
            missing.append(name)
        else:
            ready.append(predictor(load))
    return ready, missing


def filter_entities(detections: DataFrame, entities: list[str] | None = None, threshold: float = NER_THRESHOLD) -> DataFrame:
    """Detections at or over a score, of the entity types asked for."""
    kept = detections.where(F.col("score") >= threshold)
    return kept.where(F.col("entity_type").isin(*entities)) if entities else kept
