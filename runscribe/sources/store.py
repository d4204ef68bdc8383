"""A store of scorecards as JSON documents: bad ones set aside, runs by skill, the newest of all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import violations
from ..operators.scoring import DIMENSIONS, GRADES

_DIMS = ", ".join(f"{d}: struct<score: double, weight: double, weighted: double, justification: string>" for d in DIMENSIONS)
#: What is read of a document; other fields stay in its text.
CARD = (
    "struct<schemaVersion: string, skill: string, timestamp: string, composite_score: double, raw_composite: double, grade: string, grade_label: string,"
    f" dimensions: struct<{_DIMS}>, red_flags: array<string>, bonuses: array<string>, adjustments: struct<deduction: double, bonus: double>, summary: string,"
    " one_liner: string, critical_issues: array<string>, recommendations: array<string>, rubric_used: string, transcript_lines: bigint, model: string,"
    " tokenizer_baseline: double, weights_source: string, verifier_collapse: boolean, llm_usage: struct<input_tokens: bigint, output_tokens: bigint>>"
)
# The fields that every document has.
REQUIRED = ["schemaVersion", "skill", "timestamp", "composite_score", "raw_composite", "grade", "grade_label", "dimensions", "red_flags", "bonuses", "adjustments", "summary", "one_liner", "critical_issues", "recommendations", "rubric_used", "transcript_lines"]

_TEXT, _NAME, _TEXTS, _FLAG, _MAYBE = {"type": "string"}, {"type": "string", "minLength": 1}, {"type": "array", "items": {"type": "string"}}, {"type": "boolean"}, {"type": ["string", "null"]}


def _within(low: float, high: float, kind: str | list[str] = "number") -> dict:
    return {"type": kind, "minimum": low, "maximum": high}


def _findings(first: str, **more: dict) -> dict:
    return {"type": "array", "items": {"type": "object", "required": [first, "issue", "remediation"], "properties": {first: _TEXT, "issue": _TEXT, "remediation": _TEXT, **more}}}


# The shape of a document.
CARD_SCHEMA = {
    "type": "object",
    "required": [f for f in REQUIRED if f != "raw_composite"],
    "properties": {
        "schemaVersion": {"type": "string", "pattern": r"^1\.\d+\.\d+$"}, "skill": _NAME, "timestamp": {"type": "string", "format": "date-time"}, "composite_score": _within(0, 10), "raw_composite": _within(0, 10),
        "grade": {"type": "string", "enum": [g for _, g, _ in GRADES]}, "grade_label": _NAME,
        "dimensions": {"type": "object", "required": DIMENSIONS, "additionalProperties": False, "properties": {d: {"$ref": "#/$defs/dimension"} for d in DIMENSIONS}},
        "red_flags": _TEXTS, "bonuses": _TEXTS,
        "adjustments": {"type": "object", "required": ["deduction", "bonus"], "additionalProperties": False, "properties": {"deduction": _within(0, 2), "bonus": _within(0, 1)}},
        "summary": _TEXT, "one_liner": _TEXT, "critical_issues": _TEXTS, "recommendations": _TEXTS, "rubric_used": _NAME, "transcript_lines": {"type": "integer", "minimum": 0}, "model": _MAYBE,
        "tokenizer_baseline": {"type": "number", "exclusiveMinimum": 0}, "weights_source": {"type": "string", "enum": ["config", "rubric"]}, "verifier_collapse": _FLAG, "self_preference_risk": _FLAG,
        "same_family_guard": {"type": "object", "properties": {"executing_family": _MAYBE, "judge_family": _MAYBE, "judge_model": _MAYBE, "auto_preferred": _FLAG, "preferred_model": _MAYBE}},
        "sycophancy": {"type": "object", "properties": {"score": _within(0, 1, ["number", "null"]), "flipped": _FLAG, "stance_consistency": _within(0, 1, ["number", "null"]), "pushbacks": {"type": "integer", "minimum": 0}, "rationale": _TEXT, "signals": {"type": "object"}}},
        "least_privilege": _findings("target", severity={"type": "string", "enum": ["low", "medium", "high"]}), "unverified_success": _findings("claim"),
    },
    "$defs": {
        "dimension": {
            "type": "object",
            "required": ["score", "weight", "weighted", "justification"],
            "properties": {
                "score": _within(1, 10, "integer"), "weight": _within(0, 1), "weighted": _within(0, 10), "justification": _NAME, "llm_score": _within(1, 10, ["integer", "null"]), "llm_justification": _MAYBE,
                "verifier_collapse": _FLAG, "verifier_collapse_reason": _TEXT, "verifier_collapse_stats": {"type": "object"},
            },
        }
    },
}


def document_files(spark: SparkSession, path: str) -> DataFrame:
    """file, value: the JSON files of a folder, a file a row."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), "value")


def cards_of(documents: DataFrame) -> DataFrame:
    """(…, value) with ``card``, null where the text is no JSON object."""
    v = F.try_parse_json("value")
    return documents.withColumn("card", F.when(F.schema_of_variant(v).startswith("OBJECT"), F.from_json("value", CARD)))


def quarantined(documents: DataFrame) -> DataFrame:
    """The documents that are no JSON object; every other operator leaves them out."""
    return cards_of(documents).where("card IS NULL").drop("card")


def problems(documents: DataFrame, schema: dict | None = None) -> DataFrame:
    """file, path, rule: what each document breaks of a JSON schema, CARD_SCHEMA if none is given."""
    found = violations(F.try_parse_json("value"), CARD_SCHEMA if schema is None else schema)
    return documents.select("file", F.explode(found).alias("p")).select("file", "p.*")


def runs_of(documents: DataFrame) -> DataFrame:
    """skill, run_id (file), ts (as text, which orders it), composite_cents, grade, the dimensions, flag and bonus counts and n_lines of each run."""
    good = cards_of(documents).where("card IS NOT NULL")
    dims = [F.col(f"card.dimensions.{d}.score").alias(d) for d in DIMENSIONS]
    return good.select(
        "card.skill", F.col("file").alias("run_id"), F.coalesce("card.timestamp", F.lit("")).alias("ts"), F.round(F.col("card.composite_score") * 100).cast("long").alias("composite_cents"), "card.grade", *dims,
        F.coalesce(F.size("card.red_flags"), F.lit(0)).alias("n_flags"), F.coalesce(F.size("card.bonuses"), F.lit(0)).alias("n_bonuses"), F.col("card.transcript_lines").alias("n_lines"),
    )


def newest(documents: DataFrame) -> DataFrame:
    """The document whose file name is the last, as one row of file and card."""
    return cards_of(documents).agg(F.max_by(F.struct("file", "card"), "file").alias("last")).select("last.*")
