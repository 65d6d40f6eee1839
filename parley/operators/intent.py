"""Opening intent from a weighted lexicon, and the pilot counts behind one."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from parley.functions.numbers import rounded
from parley.functions.spans import opening_of, parts_of, text_found
from parley.functions.text import normal_name

# Weight of a lexicon entry by its list, and the scoring limits.
NAME_WEIGHTS = {
    "skills": 3.0, "tools": 3.0, "agent_names": 2.5, "nodes": 2.5,
    "purposes": 2.0, "event_type_hints": 1.5,
}
KEYWORD, OPENING_BONUS, NEGATIVE = 1.0, 0.5, -2.0
OPENING_CHARS = 800
MIN_SCORE = 2.0
UNKNOWN = "unknown"
PILOT_SESSIONS, PILOT_TERMS = 200, 30

# which structured-hit list answers a lexicon list
HIT_LIST = {"event_type_hints": "event_types"}

Lexicon = Mapping[str, Mapping[str, list[str]]]


def _norm(s: str | None) -> str:
    return re.sub("[^a-z0-9]+", "_", (s or "").lower()).strip("_")


def lexicon_terms(lexicon: Lexicon) -> list[tuple[int, int, str, str, float]]:
    """(term number, intent number, list, text, weight), the long form."""
    rows: list[tuple[int, int, str, str, float]] = []

    def put(intent: int, kind: str, term: str, weight: float) -> None:
        rows.append((len(rows), intent, kind, term, weight))

    for i, (name, spec) in enumerate(lexicon.items()):
        if name == UNKNOWN:
            continue
        for kind, weight in NAME_WEIGHTS.items():
            for term in spec.get(kind) or []:
                put(i, kind, _norm(term), weight)
        for term in spec.get("keywords") or []:
            if term:
                put(i, "keywords", term.lower(), KEYWORD)
                put(i, "opening", term.lower(), OPENING_BONUS)
        for term in spec.get("negative_keywords") or []:
            put(i, "negative_keywords", (term or "").lower(), NEGATIVE)
    return rows


#: Terms of one test that are written out.
WRITTEN_TERMS = 64
#: Between the items of a list held in one literal; no term or name has it.
SEPARATOR = "\x01"


def _listed(items: list) -> Column:
    """A list as one literal, which the planner folds once however long it is."""
    return F.split(F.lit(SEPARATOR.join(map(str, items))), SEPARATOR)


def _found(terms: list[tuple[int, str]], value: Column, test) -> Column:
    """Numbers of the terms for which ``test(value, term)`` holds, as an array.

    A few terms are written out, which compiles; more go through one literal list,
    with ``value`` computed once a row. Both give the same.
    """
    if not terms:
        return F.array().cast("array<int>")
    if len(terms) <= WRITTEN_TERMS:
        return F.array_compact(F.array(*[F.when(test(value, F.lit(t)), F.lit(n)) for n, t in terms]))
    numbers, texts = _listed([n for n, _ in terms]).cast("array<int>"), _listed([t for _, t in terms])
    hits = F.transform(F.array(value), lambda v: F.array_compact(F.zip_with(numbers, texts, lambda n, t: F.when(test(v, t), n))))
    return F.get(hits, F.lit(0))


#: Terms from which on they are looked up by gram, and sent to every executor at most.
INDEXED_TERMS, BROADCAST_TERMS = 256, 1_000_000
#: Characters of a gram, at most, and letters a gram is reckoned to have: grams are to outnumber the terms by far.
LONGEST_GRAM, LETTERS, SPARE = 6, 26, 8


def gram_length(terms: int, most: int = LONGEST_GRAM) -> int:
    return next((q for q in range(2, most) if LETTERS ** q >= SPARE * terms), most)


def term_index(terms: list[tuple[int, str]], q: int) -> list[tuple[str, int, str]]:
    """(gram, number, term): each term under the one of its grams that the fewest terms have."""
    grams = {t: sorted({t[i:i + q] for i in range(len(t) - q + 1)}) for _, t in terms}
    common = Counter(g for own in grams.values() for g in own)
    return [(min(grams[t], key=lambda g: (common[g], g)), n, t) for n, t in terms]


def _grams(text: Column, q: int) -> Column:
    """The distinct grams of a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1)))


def _in_text(rows: DataFrame, key: str, value: str, terms: list[tuple[int, str]], most: int = LONGEST_GRAM) -> DataFrame:
    """(key, n): terms that the text ``value`` of a row holds.

    Of many terms only those are compared that share their rarest gram with the text, so the
    work grows with the text and with what it shares, not with the number of terms. Terms
    shorter than a gram go by shorter ones.
    """
    if len(terms) <= INDEXED_TERMS or most < 1:
        # the arrays are built in their own projection, where shared parts are computed once;
        # an inner explode would add a filter that computes them a second time
        return rows.select(key, _found(terms, F.col(value), F.contains).alias("_n")).select(key, F.explode_outer("_n").alias("n"))
    q = gram_length(len(terms), most)
    index = rows.sparkSession.createDataFrame(term_index([(n, t) for n, t in terms if len(t) >= q], q), "gram string, n int, term string")
    index = F.broadcast(index) if len(terms) <= BROADCAST_TERMS else index
    shared = rows.select(key, value, F.explode(_grams(F.col(value), q)).alias("gram")).join(index, "gram")
    rest = _in_text(rows, key, value, [(n, t) for n, t in terms if len(t) < q], q - 1)
    return shared.where(F.contains(value, "term")).select(key, "n").unionByName(rest)


def term_hits(text: DataFrame, hits: DataFrame, lexicon: Lexicon, key: str = "session_id") -> DataFrame:
    """(key, terms): which lexicon terms a session shows, each once.

    ``text`` has (key, part, searchable_text), any number of parts, see ``functions.spans``;
    ``hits`` one row per key with ``structured_hits``. Rows are matched where they are and
    only term numbers are shuffled, combined on the map side; the set per
    session is no larger than the lexicon.
    """
    rows = lexicon_terms(lexicon)

    def pick(*kinds: str) -> list[tuple[int, str]]:
        return [(n, t) for n, _, kind, t, _ in rows if kind in kinds]

    parts = parts_of(text, key).select(key, "part", "last", F.lower("searchable_text").alias("_low"))
    alone = (F.col("part") == 0) & F.col("last")
    head = lambda t: F.substring(t, 1, OPENING_CHARS)
    # the opening of a text in one part is at hand; of others the first parts make it up
    openings = parts.where(alone).select(key, head(F.col("_low")).alias("_opening")).unionByName(
        parts.where(~alone).groupBy(key).agg(opening_of(F.col("_low"), OPENING_CHARS).alias("_opening")))
    found = [_in_text(openings, key, "_opening", pick("opening")), _in_text(parts, key, "_low", pick("keywords", "negative_keywords", "agent_names"))]
    broken = [(n, t) for n, t in pick("keywords", "negative_keywords") if "\n" in t]
    if broken:  # terms that hold line breaks may lie over parts
        over = parts.where(~alone).groupBy(key).agg(F.array_compact(F.array(*[F.when(text_found(t, F.col("_low")), F.lit(n)) for n, t in broken])).alias("_n"))
        found.append(over.select(key, F.explode("_n").alias("n")))
    fields = {f.name for f in hits.schema["structured_hits"].dataType.fields}
    named = [F.array().cast("array<int>")]
    for kind in NAME_WEIGHTS:
        field = HIT_LIST.get(kind, kind)
        if field in fields and pick(kind):
            names = F.transform(F.coalesce(f"structured_hits.{field}", F.array().cast("array<string>")), normal_name)
            named.append(_found(pick(kind), names, F.array_contains))
    found.append(hits.select(key, F.concat(*named).alias("_n")).select(key, F.explode_outer("_n").alias("n")))
    return reduce(DataFrame.unionByName, found).groupBy(key).agg(F.collect_set("n").alias("terms"))


def classify_intent(text: DataFrame, hits: DataFrame, lexicon: Lexicon, key: str = "session_id",
                    digits: int | None = 4) -> DataFrame:
    """(key, opening_intent_class, opening_intent_score) for every row of ``hits``.

    The best intent needs a score of 2, ties go to the one listed first; the
    confidence is its share of all positive scores.
    """
    rows = lexicon_terms(lexicon)
    names = list(lexicon)
    intents = sorted({i for _, i, _, _, _ in rows})
    found = term_hits(text, hits, lexicon, key)
    if not intents:
        return found.select(key, F.lit(UNKNOWN).alias("opening_intent_class"),
                            F.lit(0.0).alias("opening_intent_score"))

    intent_of, weight_of = _listed([i for _, i, _, _, _ in rows]).cast("array<int>"), _listed([w for _, _, _, _, w in rows]).cast("array<double>")
    # one row per term shown, one sum per intent; both groups stay where the key is
    shown = found.select(key, F.explode_outer("terms").alias("n")).select(
        key, F.get(intent_of, F.col("n")).alias("intent"), F.coalesce(F.get(weight_of, F.col("n")), F.lit(0.0)).alias("weight"))
    per_intent = shown.groupBy(key, "intent").agg(F.sum("weight").alias("score"))
    scored = per_intent.groupBy(key).agg(
        F.max(F.struct("score", (-F.col("intent")).alias("order"))).alias("_best"),
        F.sum(F.greatest(F.col("score"), F.lit(0.0))).alias("_all"))
    scored = scored.withColumn("_name", F.get(_listed(names), -F.col("_best.order")))
    best = F.greatest(F.col("_best.score"), F.lit(0.0))
    known = best >= MIN_SCORE
    share = F.when(F.col("_all") > 0, best / F.col("_all")).otherwise(0.0)
    return scored.select(
        key,
        F.when(known, F.col("_name")).otherwise(UNKNOWN).alias("opening_intent_class"),
        F.when(known, rounded(share, digits)).otherwise(share).alias("opening_intent_score"),
    )


def with_intent(fv: DataFrame, text: DataFrame, lexicon: Lexicon, key: str = "session_id") -> DataFrame:
    """Feature rows with their intent columns replaced by the scored ones."""
    scored = classify_intent(text, fv.select(key, "structured_hits"), lexicon, key)
    return fv.drop("opening_intent_class", "opening_intent_score").join(scored, key, "left")


def pilot_terms(pilot: DataFrame, k: int = PILOT_TERMS) -> DataFrame:
    """The most frequent tool and skill names of a pilot sample."""
    def tagged(kind: str, tag: str) -> Column:
        return F.transform(f"structured_hits.{kind}", lambda n: F.concat(F.lit(tag + ":"), n))

    return (
        pilot.select(F.explode(F.concat(tagged("tools", "tool"), tagged("skills", "skill"))).alias("term"))
        .groupBy("term").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "term").limit(k)
    )
