"""An optional second opinion: prompts from transcripts, any client a caller brings, answers read leniently.  Nothing calls a service by itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import truncated_transcript
from .scoring import DIMENSIONS


def criteria_text(criteria: Column, most: int = 600) -> Column:
    """A line for each dimension that a rubric (map of dimension to text) speaks of, each cut to ``most`` characters."""
    rows = []
    for d in DIMENSIONS:
        text = F.regexp_replace(F.try_element_at(criteria, F.lit(d)), r"(?U)^\s+|\s+$", "")
        short = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(" ..."))).otherwise(text)
        rows.append(F.when(text != "", F.concat(F.lit(f"- {d}: "), short)))
    held = F.array_compact(F.array(*rows))
    return F.when(F.size(held) > 0, F.array_join(held, "\n")).otherwise("(no per-dimension criteria provided)")


def prompts(lines: DataFrame, runs: DataFrame, most: int = 16_000) -> DataFrame:
    """transcript_id, prompt.  ``runs``: transcript_id, rubric, criteria (map).  A transcript is one prompt, so its lines meet in one row."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("line_no", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    whole = lines.groupBy("transcript_id").agg(F.array_join(ordered, "\n").alias("whole")).join(runs, "transcript_id", "left")
    prompt = F.concat(
        F.lit("Rubric: "), F.coalesce("rubric", F.lit("default")), F.lit(f"\nDimensions: {', '.join(DIMENSIONS)}\n\nPer-dimension criteria:\n"), criteria_text(F.col("criteria")),
        F.lit("\n\n---BEGIN TRANSCRIPT---\n"), truncated_transcript(F.col("whole"), most), F.lit("\n---END TRANSCRIPT---\n\nReturn only the JSON object."),
    )
    return whole.select("transcript_id", prompt.alias("prompt"))


USAGE = "struct<input_tokens:bigint,output_tokens:bigint>"


def answers(asked: DataFrame, client: Callable[[str], str | tuple[str, int, int]]) -> DataFrame:
    """transcript_id, answer, llm_usage: what ``client`` says to each prompt, and the tokens it took if it tells them beside the answer.

    Both are null where it fails, which leaves the other scores as they are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ask(prompt: str) -> tuple[str | None, dict | None]:
            try:
                said = client(prompt)
            except Exception:  # noqa: BLE001  (a client may fail in any way)
                return None, None
            return (said, None) if isinstance(said, str) else (said[0], {"input_tokens": int(said[1]), "output_tokens": int(said[2])})

        for batch in batches:
            said = [ask(p) for p in batch["prompt"]]
            yield pd.DataFrame({"transcript_id": batch["transcript_id"], "answer": pd.Series([a for a, _ in said], dtype=object), "llm_usage": pd.Series([u for _, u in said], dtype=object)})

    kind = asked.schema["transcript_id"].dataType.simpleString()
    return asked.select("transcript_id", "prompt").mapInPandas(run, f"transcript_id {kind}, answer string, llm_usage {USAGE}")


def merged(cards: DataFrame, opinions: DataFrame, key: str = "transcript_id") -> DataFrame:
    """(key, card) with what a second opinion adds: (key, answer, and any of llm_usage and guard, as same_family_guard gives it).

    A dimension gets llm_score and llm_justification where the answer has a number for it; no score of the card changes.  Usage and the
    guard stand at the top level.  A card without an opinion, or whose answer is no JSON object, stays as it is.
    Opinions grow with the cards, so neither side is broadcast.
    """
    held = [c for c in ("llm_usage", "guard") if c in opinions.columns]
    told = opinions.select(F.col(key).alias("_key"), parsed(F.col("answer")).alias("_said"), *[F.col(c).alias(f"_{c}") for c in held])
    kept = lambda at, fields, new: [F.col(f"{at}.{f}").alias(f) for f in fields if f not in new]
    shape = cards.schema["card"].dataType
    dimensions = []
    for d in DIMENSIONS:  # the struct is built anew: a chain of withField would copy the card into itself again and again
        own = F.try_element_at(F.filter("_said", lambda e: e["dim"] == F.lit(d)), F.lit(1))  # noqa: B023
        new = ("llm_score", "llm_justification")
        dimensions.append(F.struct(*kept(f"card.dimensions.{d}", shape["dimensions"].dataType[d].dataType.names, new), *[own[f].alias(f) for f in new]).alias(d))
    others = kept("card.dimensions", shape["dimensions"].dataType.names, DIMENSIONS)
    added = {"dimensions": F.struct(*dimensions, *others)}
    if "llm_usage" in held:
        added["llm_usage"] = F.col("_llm_usage")
    if "guard" in held:
        detail = F.struct(*[F.col(f"_guard.{f}").alias(f) for f in ("executing_family", "judge_family", "judge_model", "auto_preferred", "preferred_model")])
        added |= {"self_preference_risk": F.col("_guard.self_preference_risk"), "same_family_guard": F.when(F.col("_guard").isNotNull(), detail)}
    names = [*shape.names, *[n for n in added if n not in shape.names]]
    card = F.struct(*[added[n].alias(n) if n in added else F.col(f"card.{n}").alias(n) for n in names])
    return cards.join(told.hint("merge"), F.col(key).eqNullSafe(F.col("_key")), "left").select(*[card.alias("card") if c == "card" else F.col(c) for c in cards.columns])


def parsed(answer: Column) -> Column:
    """llm_score and llm_justification by dimension: from the outermost braces of an answer, with or without a comma too many.

    Scores are rounded and kept within 1 to 10; a dimension without a number is left out; no JSON object gives null.
    """
    braces = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    repaired = F.regexp_replace(braces, r",(\s*[}\]])", "$1")
    v = F.coalesce(F.try_parse_json(braces), F.try_parse_json(repaired))
    entries = []
    for d in DIMENSIONS:
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{d}.score", "variant"))
        number = F.when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(v, f"$.{d}.score", "double"))
        why = F.regexp_replace(F.coalesce(F.try_variant_get(v, f"$.{d}.justification", "string"), F.lit("")), r"(?U)^\s+|\s+$", "")
        entries.append(F.when(number.isNotNull(), F.struct(F.lit(d).alias("dim"), F.greatest(F.lit(1), F.least(F.lit(10), F.bround(number, 0).cast("int"))).alias("llm_score"), why.alias("llm_justification"))))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array_compact(F.array(*entries)))


# The least soft budget in tokens, and how far the hard limit lies above it.
LEAST_BUDGET, CEILING = 20_000, 1.25


def budget(asked: Column, most_answer: Column) -> Column:
    """soft and hard token limits of a call: the soft one at least LEAST_BUDGET, the hard one above it; without a budget only ``most_answer``."""
    soft = F.when(F.coalesce(asked, F.lit(0)) != 0, F.greatest(asked.cast("long"), F.lit(LEAST_BUDGET).cast("long")))
    hard = F.greatest(most_answer.cast("long"), F.floor(soft * CEILING))
    return F.struct(soft.alias("soft"), F.coalesce(hard, most_answer.cast("long")).alias("hard"))


def cache_time(force_short: Column, allow_long: Column) -> Column:
    """How long a prompt is kept: the switch for short comes before that for long; both off is short."""

    def on(switch: Column) -> Column:
        return ~F.trim(F.coalesce(switch, F.lit(""))).isin("", "0", "false", "False")

    return F.when(on(force_short), "5m").when(on(allow_long), "1h").otherwise("5m")
