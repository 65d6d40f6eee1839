"""The reports a study runs: cohorts, exploration, evaluation, quick results, audit."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from parley.functions.events import DISPLAY_TYPES, complete
from parley.functions.predicates import cohort_filter, traffic_split
from parley.operators import artifacts, cohort as C, eventlog, sampling
from parley.operators.digest import digests, label_samples
from parley.operators.intent import Lexicon, with_intent
from parley.operators.matching import TURN_TOLERANCE, exploration_manifest
from parley.operators.ordering import large_keys
from parley.operators.primitives import SESSION_ROWS, primitives, session_rollup
from parley.operators.scope import cohorts, events_for
from parley.operators.signals import Scorer, enrich, hypothesis_flags, with_signals
from parley.operators.vectors import embed
from parley.plans.feature_store import FeatureStore
from parley.session import stage


@dataclass
class StudyCohorts:
    features: DataFrame   # one row per session and cohort
    stats: DataFrame      # raw and filtered counts per cohort
    events: DataFrame     # cleaned events of the sessions in scope
    text: DataFrame       # (session_id, part, last, searchable_text, pieces)


# Measures of a session without events.
NO_EVENTS = {
    "session_outcome": "unknown", "outcome_bucket": "other", "length_bucket": "short", "agent_path": "",
    "opening_text": "", "opening_intent_class": "unknown",
}


def _fill(fv: DataFrame) -> DataFrame:
    return fv.fillna(0).fillna(False).fillna(NO_EVENTS)


def _labels(study: Mapping[str, Any]) -> tuple[str, ...]:
    return ("before", "after") if study.get("study_type") == "comparative" else ("all",)


def _n_eval(study: Mapping[str, Any]) -> int | None:
    n = study.get("n_eval", "all")
    return None if n in (None, "all") else int(n)


def build_cohorts(s: DataFrame, ev: DataFrame, study: Mapping[str, Any], lexicon: Lexicon, price: DataFrame,
                  vec_dim: int | None = None, encoder: Callable[[Column], Column] | None = None,
                  store: FeatureStore | None = None) -> StudyCohorts:
    """Scope, clean, measure, classify, filter and sample the sessions of a study.

    Intent is scored before filtering, so a filter and the sample's strata see
    it. ``n_eval`` sessions per cohort are drawn from those that pass the filters.
    Opening vectors are added after filtering, and only when ``vec_dim`` is given. With a
    ``store``, only sessions whose log has changed since they were stored are read whole and
    measured; its signature should name the lexicon and the prices.
    """
    raw = cohorts(s, study).select("session_id", "cohort")
    n = _n_eval(study)
    raw = stage(raw)
    share = events_for(complete(ev), raw)

    def measure(part: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        # read and cleaned once, then kept
        clean = stage(eventlog.dedupe_session_end(part))
        large = large_keys(clean, ["session_id"], SESSION_ROWS)
        text = eventlog.session_text(clean, large=large)
        return with_intent(primitives(clean, price, large=large), text, lexicon), clean, text

    if store is None:
        fv, clean, text = measure(share)
    else:
        store.refresh(share, lambda part: measure(part)[0], whole=False)
        fv = store.read()
        if fv is None:  # no session in scope has events
            fv = measure(share)[0]
        clean = eventlog.dedupe_session_end(share)
        text = eventlog.session_text(clean)
    rows = _fill(raw.join(fv, "session_id", "left"))
    split = (study.get("traffic_split") or {}).get("value")
    kept = rows.where(traffic_split(split) & cohort_filter(study.get("cohort_filters")))
    if n is not None:
        kept = stage(kept)  # sampling reads it several times
        kept = reduce(DataFrame.unionByName, [
            sampling.stratified_sample(kept.where(F.col("cohort") == label), n, sampling.stratum())
            for label in _labels(study)])
    if vec_dim:
        kept = embed(kept, dim=vec_dim, encoder=encoder)
    kept = stage(kept)
    return StudyCohorts(kept, C.cohort_stats(raw, kept), clean, text)


def explore(features: DataFrame, ev: DataFrame, lines: DataFrame, study: Mapping[str, Any],
            vec: str = "embedding_opening") -> dict[str, DataFrame]:
    """The sessions to look at, a digest of each, and the extreme ones among them."""
    manifest = stage(exploration_manifest(
        features, study.get("study_type", "single"), int(study.get("n_explore") or sampling.N_EXPLORE),
        int(study.get("pairing_turn_tolerance") or TURN_TOLERANCE), vec=vec))
    ids = manifest.select("session_id").distinct()
    own = features.join(ids, "session_id", "left_semi").dropDuplicates(["session_id"])
    made = digests(events_for(ev, ids), own.drop("cohort"), events_for(lines, ids))
    made = made.join(label_samples(manifest, ids), "session_id", "left")
    return {"manifest": manifest, "digests": made, "extremes": sampling.extreme_sessions(made)}


def evaluate(features: DataFrame, plan: Mapping[str, Any], study: Mapping[str, Any],
             text: DataFrame | None = None, ev: DataFrame | None = None, lines: DataFrame | None = None,
             vec: str | None = None, scorers: Mapping[str, Scorer] | None = None) -> dict[str, DataFrame]:
    """Aspects, hypotheses, per-session values, sizes and the two summary tables."""
    comparative = study.get("study_type") == "comparative"
    min_support = int(study.get("min_support") or C.MIN_SUPPORT)
    alpha = float(study.get("significance_level") or C.ALPHA)
    aspects: Sequence[Mapping] = plan.get("aspects") or []
    hypotheses: Sequence[Mapping] = plan.get("hypotheses") or []
    # several results read the signals; the scans behind them run once
    signalled = stage(with_signals(features, plan, text, ev, lines, scorers))
    medians = {"turn_count": C.cohort_median(features).scalar()}
    values = signalled.withColumns(C.aspect_columns(aspects, signalled))
    values = stage(hypothesis_flags(enrich(values, medians), hypotheses, medians))
    sizes = features.groupBy("cohort").agg(F.count("*").alias("size"))
    out: dict[str, DataFrame] = {"values": values, "sizes": sizes}
    if aspects:
        out["aspects"] = C.aspect_results(signalled, aspects, comparative, alpha)
        out["aspect_table"] = artifacts.aspect_table(out["aspects"], comparative)
    if hypotheses:
        out["hypotheses"] = C.hypothesis_results(
            features.select("session_id", "cohort"), values, hypotheses, comparative, min_support, alpha)
        out["hypothesis_table"] = artifacts.hypothesis_table(out["hypotheses"], comparative)
        out["counter_examples"] = sampling.all_counter_examples(values, [h["id"] for h in hypotheses], vec=vec)
    return out


def quick_results(ev: DataFrame, s: DataFrame, study: Mapping[str, Any]) -> DataFrame:
    """Four aspects before and after straight from the event log.

    The log carries the index's internal ids, which the scope scan reads along.
    Each session is measured once and then counted in every cohort it is in.
    """
    ids = cohorts(s, study).groupBy(F.col("internal_id").alias("session_id")).agg(
        F.sort_array(F.collect_set("cohort")).alias("cohorts"))
    per_session = session_rollup(ev.join(ids, "session_id"), ["cohorts"])
    rollup = per_session.withColumn("cohort", F.explode("cohorts"))
    return C.compare_cohorts(C.cohort_rollup(rollup, _labels(study)))


def audit_events(ev: DataFrame, types: Sequence[str] | None = None, dedup: bool = True,
                 include_debug: bool = True) -> dict[str, DataFrame]:
    """Event counts per session and the histogram of the counted types."""
    types = list(types or DISPLAY_TYPES)
    base = ev if include_debug else eventlog.drop_debug(ev)
    shown = eventlog.only_types(base, types)
    return {
        "counts": eventlog.event_counts(ev, include_debug, dedup, types),
        "histogram": eventlog.type_histogram(eventlog.dedupe_session_end(shown) if dedup else shown),
    }
