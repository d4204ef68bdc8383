"""The whole scoring of a corpus: one scan of lines to nested scorecards, by chunk, by transcript and by skill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import detectors, history, justify, scoring
from ..operators.features import clamp, line_features, transcript_features
from .config import Settings

RUN_COLUMNS = {"skill": "string", "model": "string", "timestamp": "string", "rubric": "string", "weights": "map<string,double>"}
VERSION = "1.0.0"


def skill_history(past: DataFrame, settings: Settings) -> DataFrame:
    """(skill, run_id, ts, composite_cents) of runs before -> one row a skill: what consistency is judged by.

    Sums are combined before the shuffle and the last runs are limited before it, so a skill's whole history is in no task.
    """
    cents = F.col("composite_cents")
    known = past.where(cents.isNotNull())
    all_runs = known.groupBy("skill").agg(
        F.count("*").alias("past_runs"),
        F.avg(cents / 100.0).alias("past_average"),
        F.stddev_pop(cents / 100.0).alias("past_sigma"),
        (F.max_by("composite_cents", F.struct("ts", "run_id")) / 100.0).alias("past_latest"),
    )
    if settings.collapse is None:
        return all_runs
    c = settings.collapse
    last = history.last_runs(known, c["window"]).groupBy("skill").agg(
        F.count("*").alias("window_runs"), F.count_if(cents >= c["top_threshold"] * 100).alias("window_top"), F.stddev_pop(cents / 100.0).alias("window_sigma")
    )
    collapsed = (F.col("window_runs") >= c["min_samples"]) & (F.col("window_top") / F.col("window_runs") >= c["top_bucket_fraction"]) & (F.col("window_sigma") < c["max_std_dev"])
    joined = all_runs.join(last, "skill").withColumn("collapsed", collapsed)
    return joined.withColumn("collapse_reason", F.when(F.col("collapsed"), justify.collapse_reason(c)))


def consistency(settings: Settings) -> Column:
    sigma = F.col("past_sigma")
    score = F.when(sigma > 2.5, 5).when(sigma > 1.5, 6).when(sigma > 0.8, 7).otherwise(9)
    if settings.collapse is not None:
        score = score - F.when(F.col("collapsed"), settings.collapse["consistency_dock"]).otherwise(0)
    return F.when(F.coalesce("past_runs", F.lit(0)) > 0, clamp(score)).otherwise(5)


def model_baseline(model: Column, baselines: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in baselines.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, model), F.lit(float(baselines.get("default", 1.0))))


def scores(
    lines: DataFrame, runs: DataFrame | None = None, turns: DataFrame | None = None, past: DataFrame | None = None, settings: Settings | None = None, notes: bool = False
) -> DataFrame:
    """One row a transcript with its seven scores, flags, bonuses, composites and grade.

    ``lines``: transcript_id, line_no, text.  ``runs``: transcript_id and any of RUN_COLUMNS.  ``turns``: transcript_id,
    turn_no, role, text.  ``past``: the scored runs before (skill, run_id, ts, composite_cents); without it, and for
    skills that it doesn't hold, consistency is neutral.  ``notes`` adds every text of a scorecard.
    """
    settings = settings or Settings()
    features = transcript_features(line_features(lines, settings.slow_ms), notes)
    features = features.withColumns({"n_incomplete": F.col("n_unfinished"), "privilege_dock": detectors.privilege_dock(F.col("grants")), "least_privilege": detectors.privilege_texts(F.col("grants"))})
    if runs is not None:
        told = [F.col(c) if c in runs.columns else F.lit(None).cast(t).alias(c) for c, t in RUN_COLUMNS.items()]
        features = features.join(runs.select("transcript_id", *told), "transcript_id", "left")
    else:
        features = features.withColumns({c: F.lit(None).cast(t) for c, t in RUN_COLUMNS.items()})
    if past is not None:
        features = features.join(skill_history(past, settings), "skill", "left")
    else:
        none = {"past_runs": "long", "past_average": "double", "past_sigma": "double", "past_latest": "double", "collapsed": "boolean", "collapse_reason": "string"}
        features = features.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    flip = F.lit(False)
    if turns is not None and settings.check_pushback:
        features = features.join(detectors.sycophancy(detectors.pushbacks(turns), settings.least_pushbacks).withColumnRenamed("score", "pushback_score"), "transcript_id", "left")
        flip = F.coalesce(F.col("flips") > 0, F.lit(False)) & F.lit(settings.flip_flag)

    unsupported = F.col("is_claim") & ~F.col("has_receipt") & F.lit(settings.check_success)
    baseline = model_baseline(F.col("model"), settings.baselines)
    dims = {
        "correctness": scoring.correctness(settings.success_dock, unsupported),
        "completeness": scoring.completeness(),
        "adherence": scoring.adherence(),
        "actionability": scoring.actionability(),
        "efficiency": scoring.efficiency(baseline, F.col("n_slow") if settings.slow_ms is not None else None),
        "safety": scoring.safety(F.col("privilege_dock")),
        "consistency": consistency(settings),
    }
    flags = F.concat(detectors.red_flags(), F.array_compact(F.array(F.when(flip, F.lit(detectors.FLIP_FLAG)), F.when(unsupported & F.lit(settings.success_flag), F.lit(detectors.SUCCESS_FLAG)))))
    scored = features.withColumns({**dims, "red_flags": flags, "bonuses": detectors.bonuses(), "tokenizer_baseline": baseline, "unsupported": unsupported})
    weights = {d: F.coalesce(F.try_element_at("weights", F.lit(d)), F.lit(w)).cast("decimal(10,6)") for d, w in settings.weights.items()}
    scored = scored.withColumns({f"weight_{d}": w for d, w in weights.items()})
    scored = scored.withColumn("raw_cents", scoring.weighted_cents())
    scored = scored.withColumn("composite_cents", scoring.adjusted_cents(F.col("raw_cents"), F.size("red_flags"), F.size("bonuses")))
    extremes = dict(zip(("best_dim", "worst_dim"), scoring.extremes(), strict=True))
    scored = scored.withColumns({"grade": scoring.grade(F.col("composite_cents")), "recommendations": scoring.recommendations(), "critical": scoring.critical(), **extremes})
    own = ["transcript_id", *RUN_COLUMNS, "n_lines", *scoring.DIMENSIONS, "red_flags", "bonuses", "raw_cents", "composite_cents", "grade", "best_dim", "worst_dim", "recommendations", "critical"]
    if not notes:
        return scored.select(own)
    return _with_texts(scored, settings, baseline).select(*own, *NOTES)


TEXTS = [f"why_{d}" for d in scoring.DIMENSIONS]
NOTES = [*TEXTS, *[f"weight_{d}" for d in scoring.DIMENSIONS], "critical_issues", "one_liner", "summary", "tokenizer_baseline", "tool_durations_ms", "least_privilege", "unverified_success", "sycophancy", "collapsed", "collapse_reason", "collapse_stats"]


def _with_texts(scored: DataFrame, settings: Settings, baseline: Column) -> DataFrame:
    full = scored.withColumn("unverified_success", F.when(F.col("unsupported"), detectors.success_texts(F.col("claims"))))
    withheld = ~F.col("has_receipt") & (scoring.correctness_found(settings.success_dock, F.col("unsupported")) >= 10)
    why = {
        "correctness": justify.correctness(F.try_element_at("unverified_success", F.lit(1))["claim"], withheld),
        "completeness": justify.completeness(),
        "adherence": justify.adherence(F.col("rubric").isNotNull()),
        "actionability": justify.actionability(),
        "efficiency": justify.efficiency(baseline, settings.slow_ms),
        "safety": justify.safety(),
        "consistency": justify.consistency(settings.collapse),
    }
    full = full.withColumns({f"why_{d}": w for d, w in why.items()})
    stats = F.lit(None).cast("string")
    if settings.collapse is not None and "window_runs" in full.columns:
        c = settings.collapse
        enough = F.col("window_runs") >= c["min_samples"]
        share = F.when(enough, F.round(F.col("window_top") / F.col("window_runs"), 4)).otherwise(0.0)
        stats = F.when(
            F.col("window_runs").isNotNull(),
            F.struct(F.col("window_runs").alias("window"), F.lit(c["min_samples"]).alias("min_samples"), F.lit(c["top_threshold"]).alias("top_threshold"), share.alias("top_bucket_fraction"), F.lit(c["max_std_dev"]).alias("max_std_dev"), F.when(enough, F.round("window_sigma", 4)).otherwise(0.0).alias("std_dev")),
        )
    pushed = F.lit(None).cast("string")
    if "pushbacks" in full.columns:
        signals = F.struct("flips", "held", F.col("legitimate").alias("legitimate_updates")).alias("signals")
        pushed = F.when(F.col("pushbacks").isNotNull(), F.struct(F.col("pushback_score").alias("score"), (F.col("flips") > 0).alias("flipped"), F.col("stance").alias("stance_consistency"), "pushbacks", "rationale", signals))
    collapsed = F.coalesce(F.col("collapsed"), F.lit(False)) if settings.collapse is not None else F.lit(None).cast("boolean")
    reason = F.col("collapse_reason") if "collapse_reason" in full.columns else F.lit(None).cast("string")
    skill = F.coalesce("skill", F.lit("unknown"))
    return full.withColumns(
        {"one_liner": justify.one_liner(skill), "summary": justify.summary(), "critical_issues": justify.critical_issues(), "tool_durations_ms": F.transform("durations", lambda d: d.cast("long")), "sycophancy": pushed, "collapse_stats": stats, "collapsed": collapsed, "collapse_reason": reason}
    )


def scorecards(scored: DataFrame) -> DataFrame:
    """transcript_id and card: the nested document of a scored transcript (with notes); what isn't there is null."""

    def dimension(d: str) -> Column:
        fields = [
            F.col(d).cast("decimal(3,1)").alias("score"),
            F.col(f"weight_{d}").cast("double").alias("weight"),
            F.round(F.col(d) * F.col(f"weight_{d}"), 2).cast("double").alias("weighted"),
            F.col(f"why_{d}").alias("justification"),
        ]
        more = {
            "correctness": ["unverified_success"],
            "efficiency": ["tool_durations_ms"],
            "safety": ["least_privilege"],
            "consistency": [F.col("collapsed").alias("verifier_collapse"), F.col("collapse_reason").alias("verifier_collapse_reason"), F.col("collapse_stats").alias("verifier_collapse_stats")],
        }
        return F.struct(*fields, *more.get(d, [])).alias(d)

    cents, raw = F.col("composite_cents"), F.col("raw_cents")
    deduction, bonus = F.least(F.size("red_flags") * 0.5, F.lit(2.0)), F.least(F.size("bonuses") * 0.25, F.lit(1.0))
    card = F.struct(
        F.lit(VERSION).alias("schemaVersion"),
        F.coalesce("skill", F.lit("unknown")).alias("skill"),
        F.col("timestamp"),
        (cents / 100).cast("double").alias("composite_score"),
        (raw / 100).cast("double").alias("raw_composite"),
        "grade",
        scoring.grade(cents, 2).alias("grade_label"),
        F.struct(*[dimension(d) for d in scoring.DIMENSIONS]).alias("dimensions"),
        "red_flags",
        "bonuses",
        F.struct(deduction.alias("deduction"), bonus.alias("bonus")).alias("adjustments"),
        "summary",
        "one_liner",
        "critical_issues",
        "recommendations",
        F.coalesce("rubric", F.lit("default")).alias("rubric_used"),
        F.col("n_lines").alias("transcript_lines"),
        "model",
        "tokenizer_baseline",
        F.when(F.col("weights").isNotNull(), "rubric").otherwise("config").alias("weights_source"),
        F.col("collapsed").alias("verifier_collapse"),
        "least_privilege",
        "unverified_success",
        "sycophancy",
    )
    return scored.select("transcript_id", card.alias("card"))


def documents_of(scored: DataFrame) -> DataFrame:
    """transcript_id, scorecard: the document as JSON text, without what is null."""
    return scorecards(scored).select("transcript_id", F.to_json("card").alias("scorecard"))


def persist(cards: DataFrame, path: str) -> None:
    """Add scorecards (run_id, skill, ...) to a store of one folder a skill; run_id keeps runs of one second apart."""
    cards.withColumn("skill", F.coalesce("skill", F.lit("unknown"))).write.partitionBy("skill").mode("append").parquet(path)
