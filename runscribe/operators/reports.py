"""Scorecards as documents and texts: explanations, comparisons, findings as lint results, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scoring import DIMENSIONS

# The format's name and what stands at the end of a text that is cut.
EXPLAIN_VERSION = "explain.v1"
FOOTER_URL = "\n\n_Output truncated to {limit} chars to fit GitHub's PR comment limit. See full report at {url}._\n"
FOOTER = "\n\n_Output truncated to {limit} chars to fit GitHub's PR comment limit. Re-run with `--max-evidence-chars=0` for the full report._\n"


def cut(text: Column, most: int, url: str | None = None) -> Column:
    """At most ``most`` characters, footer included, if something goes; 0 keeps all."""
    if not most:
        return text
    footer = FOOTER_URL.format(limit=most, url=url) if url else FOOTER.format(limit=most)
    body = F.regexp_replace(F.left(text, F.lit(max(0, most - len(footer)))), r"(?U)\s+$", "")
    return F.when(F.length(text) > most, F.concat(body, F.lit(footer))).otherwise(text)


def short(text: Column, most: int = 140) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def truncated_transcript(text: Column, most: int = 16_000) -> Column:
    """Head and tail of a text over ``most`` characters, with the number of those left out between."""
    half, n = most // 2, F.length(text)
    mark = F.concat(F.lit("\n\n... ["), (n - most).cast("string"), F.lit(f" chars elided to stay under the {most}-char transcript budget] ...\n\n"))
    return F.when(n <= most, text).otherwise(F.concat(F.left(text, F.lit(half)), mark, F.right(text, F.lit(half))))


def has_opinion(cards: DataFrame) -> bool:
    """Whether the cards may hold a second opinion."""
    return "llm_score" in cards.schema["card"].dataType["dimensions"].dataType[DIMENSIONS[0]].dataType.names


def dimension_entries(card: str = "card", opinion: bool = False) -> Column:
    """The dimensions of a card in canonical order, as an array with their names."""
    c, fields = f"{card}.dimensions", ["score", "weight", "weighted", "justification", *(["llm_score", "llm_justification"] if opinion else [])]
    return F.array(*[F.struct(F.lit(d).alias("name"), *[F.col(f"{c}.{d}.{f}").alias(f) for f in fields]) for d in DIMENSIONS])


# The texts around a collapse and a second opinion.
COLLAPSED = "The consistency dimension was docked because the rolling window of recent scorecards for this skill shows the judge/verifier has flatlined at the top of the scale, a failure mode distinct from low score variance."
NO_REASON = "Verifier collapse detected over the recent scorecard window."
UNSAID = "_(no justification recorded)_"


def collapse_callout(cards: DataFrame, card: str = "card") -> Column:
    """Why and on what figures a history counts as collapsed; null if it doesn't."""
    told = isinstance(cards.schema[card].dataType["dimensions"].dataType["consistency"].dataType["verifier_collapse_stats"].dataType, StructType)
    at = f"{card}.dimensions.consistency.verifier_collapse"
    figure = lambda f: F.lit("?") if not told else F.coalesce(F.col(f"{at}_stats.{f}").cast("string"), F.lit("?"))
    stats = F.concat(
        F.lit("\n- **Stats:** window n="), figure("window"), F.lit(", top_bucket_fraction="), figure("top_bucket_fraction"), F.lit(" (threshold "), figure("max_std_dev"), F.lit(" for std_dev, actual "), figure("std_dev"),
        F.lit("; top_threshold="), figure("top_threshold"), F.lit(")"),
    )
    reason = F.coalesce(F.nullif(f"{at}_reason", F.lit("")), F.lit(NO_REASON))
    return F.when(F.col(f"{card}.verifier_collapse"), F.concat(F.lit(f"## ⚠️ Verifier collapse detected\n\n{COLLAPSED}\n\n- **Reason:** "), reason, F.when(F.col(f"{at}_stats").isNotNull(), stats).otherwise("") if told else F.lit("")))


def opinion_overlay(card: str = "card") -> Column:
    """A line for each dimension with a second opinion; null without any."""
    said = F.filter(dimension_entries(card, opinion=True), lambda e: e["llm_score"].isNotNull())
    line = lambda e: F.concat(F.lit("- **"), e["name"], F.lit("**: "), e["llm_score"].cast("string"), F.lit("/10 — "), F.coalesce(F.nullif(e["llm_justification"], F.lit("")), F.lit(UNSAID)))
    return F.when(F.size(said) > 0, F.concat(F.lit("### LLM second opinion\n\n"), F.array_join(F.transform(said, line), "\n")))


def ordered_dimensions(scores: DataFrame, key: str) -> DataFrame:
    """(key, dim, place, score) -> key, dimensions: the canonical ones in their order, then all others by place."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for i, d in enumerate(DIMENSIONS) for x in (d, i)])[F.col("dim")], F.lit(len(DIMENSIONS)))
    rows = F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "place", F.struct(F.col("dim").alias("name"), "score").alias("entry"))))
    return scores.groupBy(key).agg(F.transform(rows, lambda r: r["entry"]).alias("dimensions"))


def evidence(card: str = "card") -> Column:
    return F.struct(F.col(f"{card}.transcript_lines").alias("transcript_lines"), F.size(f"{card}.red_flags").alias("red_flag_count"), F.size(f"{card}.bonuses").alias("bonus_count"))


def explain_documents(cards: DataFrame, key: str = "transcript_id") -> DataFrame:
    """key, document: the stable projection of a scorecard as JSON text; null fields are absent."""
    c = lambda f: F.col(f"card.{f}")
    names = {"rubric": "rubric_used", "composite": "composite_score"}
    head = ["skill", "timestamp", "rubric", "model", "tokenizer_baseline", "composite", "raw_composite", "grade", "grade_label", "summary", "one_liner"]
    adjustments = F.struct(c("adjustments.deduction").alias("deduction"), c("adjustments.bonus").alias("bonus"), c("red_flags").alias("red_flags"), c("bonuses").alias("bonuses"))
    fields = [F.lit(EXPLAIN_VERSION).alias("format_version"), *[c(names.get(f, f)).alias(f) for f in head], dimension_entries(opinion=has_opinion(cards)).alias("dimensions"), adjustments.alias("adjustments")]
    fields += [c("critical_issues").alias("critical_issues"), c("recommendations").alias("recommendations"), evidence().alias("evidence"), c("verifier_collapse").alias("verifier_collapse")]
    return cards.select(key, F.to_json(F.struct(*fields)).alias("document"))


def explain_markdown(cards: DataFrame, key: str = "transcript_id", most: int = 4000, url: str | None = None) -> DataFrame:
    """key, markdown: heading, collapse, a row a dimension, adjustments, critical issues, recommendations and evidence, cut to ``most``."""
    c = lambda f: F.col(f"card.{f}")

    def number(x: Column) -> Column:
        return F.regexp_replace(F.format_string("%.2f", x.cast("double")), r"(\.\d)0$", "$1")

    def bullets(title: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"## {title}\n\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")))

    head = F.concat(
        F.lit("# Scorecard — `"), c("skill"), F.lit("`\n\n**Composite:** "), number(c("composite_score")), F.lit("/10 — **Grade:** "), c("grade"), F.lit(" ("), c("grade_label"), F.lit(")  \n**Rubric:** `"), c("rubric_used"),
        F.lit("` · **Model:** `"), F.coalesce(c("model"), F.lit("_unknown_")), F.lit("` · **Timestamp:** `"), F.coalesce(c("timestamp"), F.lit("?")), F.lit("`\n\n> "), c("one_liner"), F.lit("\n\n_"), c("summary"), F.lit("_"),
    )
    row = lambda e: F.concat(
        F.lit("| "), e["name"], F.lit(" | "), number(e["score"]), F.lit("/10 | "), number(e["weight"]), F.lit(" | "), number(e["weighted"]), F.lit(" | "), short(F.replace(e["justification"], F.lit("|"), F.lit("\\|"))), F.lit(" |")
    )
    table = F.concat(F.lit("## Per-dimension breakdown\n\n| Dimension | Score | Weight | Weighted | Justification |\n|-----------|-------|--------|----------|---------------|\n"), F.array_join(F.transform(dimension_entries(), row), "\n"))
    lines = F.array_compact(
        F.array(
            F.when(F.size(c("red_flags")) > 0, F.concat(F.lit("- **Red flags** (−"), number(c("adjustments.deduction")), F.lit("): "), F.array_join(c("red_flags"), ", "))),
            F.when(F.size(c("bonuses")) > 0, F.concat(F.lit("- **Bonuses** (+"), number(c("adjustments.bonus")), F.lit("): "), F.array_join(c("bonuses"), ", "))),
        )
    )
    adjusted = F.when(F.size(lines) > 0, F.concat(F.lit("## Adjustments\n\n"), F.array_join(lines, "\n")))
    seen = F.format_string("## Evidence\n\n- %d transcript lines analysed\n- %d red-flag patterns matched\n- %d bonus signals matched", c("transcript_lines"), F.size(c("red_flags")), F.size(c("bonuses")))
    overlay = opinion_overlay() if has_opinion(cards) else F.lit(None).cast("string")
    text = F.concat(F.concat_ws("\n\n", head, collapse_callout(cards), table, overlay, adjusted, bullets("Critical issues", c("critical_issues")), bullets("Recommendations", c("recommendations")), seen), F.lit("\n"))
    return cards.select(key, cut(text, most, url).alias("markdown"))


def strengths_and_weaknesses(cards: DataFrame, key: str = "transcript_id", n: int = 3) -> DataFrame:
    """key, strengths, weaknesses: the n highest and lowest dimensions, ties in canonical order."""
    def ranked(sign: int) -> Column:
        rows = F.array(*[F.struct((sign * F.col(f"card.dimensions.{d}.score")).alias("s"), F.lit(i).alias("o"), F.lit(d).alias("d")) for i, d in enumerate(DIMENSIONS)])
        return F.transform(F.slice(F.array_sort(rows), 1, n), lambda r: r["d"])

    return cards.select(key, ranked(-1).alias("strengths"), ranked(1).alias("weaknesses"))


def comparison_text(pairs: DataFrame) -> Column:
    """A table of two runs (a_ and b_ columns, notes; see history.narrative)."""
    c = F.col
    rows = []
    for d in DIMENSIONS:
        x, y = c(f"a_{d}").cast("int"), c(f"b_{d}").cast("int")
        shown = [F.lpad(F.coalesce(v, F.lit("-")), 5, " ") for v in (x.cast("string"), y.cast("string"), F.format_string("%+d", F.when(x.isNotNull() & y.isNotNull(), y - x)))]
        known = x.isNotNull() & y.isNotNull()
        shown[2] = F.when(known, shown[2]).otherwise(F.lpad(F.lit("-"), 5, " "))
        rows.append(F.concat_ws(" ", F.rpad(F.lit(d), 15, " "), *shown))
    heads = [F.concat(F.lit(f"run {s.upper()}: "), c(f"{s}_ts").cast("string"), F.format_string("  composite %.2f / %s", (c(f"{s}_composite_cents") / 100).cast("double"), c(f"{s}_grade"))) for s in ("a", "b")]
    rule = F.lit("─" * 37)
    told = F.array_join(F.transform("notes", lambda t: F.concat(F.lit("  - "), t)), "\n")
    return F.concat_ws("\n", *heads, F.lit(""), F.lit(f"{'dimension':<15} {'A':>5} {'B':>5} {'Δ':>5}"), rule, *rows, rule, F.lit(""), F.lit("narrative:"), told)


def delta_texts(changes: DataFrame) -> DataFrame:
    """skill, delta_text: a table of two runs (see history.against), dimensions in order, the composite last, and how it moved."""
    c = F.col
    order = F.create_map(*[F.lit(x) for i, d in enumerate([*DIMENSIONS, "composite"]) for x in (d, i)])[c("dim")]
    arrow = F.when(c("delta") > 0.05, "↑").when(c("delta") < -0.05, "↓").otherwise("→")

    def shown(v: Column) -> Column:
        return F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(F.format_string("%.1f", v))

    row = F.format_string("%-15s %7s  %7s  %+6.1f %s", "dim", shown(c("before")), shown(c("after")), "delta", arrow)
    last = F.format_string("%-15s %7.2f  %7.2f  %+6.2f %s", "dim", "before", "after", "delta", arrow)
    rows = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.when(c("dim") == "composite", last).otherwise(row).alias("t")))), lambda x: x["t"])
    moved = F.max(F.when(c("dim") == "composite", c("delta")))
    word = F.when(moved > 0.05, F.format_string("IMPROVED (+%.2f)", moved)).when(moved < -0.05, F.format_string("REGRESSED (%+.2f)", moved)).otherwise("FLAT")
    head = f"{'dimension':<15} {'before':>7}  {'after':>7}  {'delta':>7}"
    out = changes.groupBy("skill").agg(rows.alias("rows"), word.alias("word"))
    return out.select("skill", F.concat_ws("\n", F.lit(head), F.lit("─" * 45), F.array_join("rows", "\n"), F.lit("─" * 45), "word").alias("delta_text"))


def report_documents(hist: DataFrame, averages: DataFrame, last: int) -> DataFrame:
    """skill, scores (the last runs, oldest first), averages: one row a skill."""
    from .history import last_runs

    run = F.struct("run_id", (F.col("composite_cents") / 100).cast("double").alias("composite_score"), *DIMENSIONS)
    rows = last_runs(hist, last).groupBy("skill").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("ts"), F.col("run_id").alias("r"), run.alias("run")))), lambda x: x["run"]).alias("scores"))
    means = averages.where("skill IS NOT NULL").select("skill", F.struct(F.col("runs").alias("count"), F.round(F.col("avg_cents") / 100, 2).alias("composite_avg"), *[F.round(f"avg_{d}", 2).alias(d) for d in DIMENSIONS]).alias("averages"))
    return rows.join(means, "skill")


def sarif(findings: DataFrame, tool: str, rules: list[tuple[str, str, str]], score: Column | None = None) -> DataFrame:
    """(manifest, case_name, case_index, rule, message) -> manifest, log: one SARIF 2.1.0 log a manifest, results in order of cases.

    ``rules``: (id, name, short text).  A manifest's findings are one document.
    """
    listed = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"), F.struct(F.lit(t).alias("text")).alias("shortDescription"), F.struct(F.lit("warning").alias("level")).alias("defaultConfiguration")) for i, n, t in sorted(rules)])
    place = F.array(
        F.struct(
            F.struct(F.struct(F.col("manifest").alias("uri")).alias("artifactLocation")).alias("physicalLocation"),
            F.array(F.struct(F.col("case_name").alias("name"), F.lit("object").alias("kind"), F.concat(F.lit("cases["), F.col("case_index").cast("string"), F.lit("]")).alias("fullyQualifiedName"))).alias("logicalLocations"),
        )
    )
    result = F.struct(F.col("rule").alias("ruleId"), F.lit("warning").alias("level"), F.struct(F.concat(F.lit("["), F.col("case_name"), F.lit("] "), F.col("message")).alias("text")).alias("message"), place.alias("locations"))
    results = F.transform(F.sort_array(F.collect_list(F.struct("case_index", "rule", result.alias("r")))), lambda x: x["r"])
    grouped = findings.groupBy("manifest").agg(results.alias("results"), F.count_distinct("case_name").alias("flagged"))
    driver = F.struct(F.lit(tool).alias("name"), listed.alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), "results", F.struct("manifest", F.col("flagged").alias("flagged_cases")).alias("properties"))
    log = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return grouped.select("manifest", "flagged", F.to_json(log).alias("log"))


def score_bar(score: Column, full: str = "#", empty: str = "-") -> Column:
    """A bar of ten cells for a score of 0 to 10; halves go to the even neighbour."""
    filled = F.greatest(F.lit(0), F.least(F.lit(10), F.bround(score, 0).cast("int")))
    return F.concat(F.repeat(F.lit(full), filled), F.repeat(F.lit(empty), 10 - filled))


def averages_card(averages: DataFrame, dimensions: list[str]) -> DataFrame:
    """skill, card: a line a dimension with its bar, from columns avg_<dimension>; a null skill is all of them."""
    rows = [F.concat(F.rpad(F.lit(d), 15, " "), score_bar(F.col(f"avg_{d}"))) for d in dimensions]
    head = F.concat(F.coalesce("skill", F.lit("all skills")), F.lit(", "), F.col("runs").cast("string"), F.lit(" runs"))
    return averages.select("skill", F.concat_ws("\n", head, *rows).alias("card"))


def radar(dimensions: list[str], radius: float = 1.0) -> list[Column]:
    """x and y of each dimension's point, the first straight up, in turn."""
    import math

    out = []
    for i, d in enumerate(dimensions):
        angle = -math.pi / 2 + 2 * math.pi * i / len(dimensions)
        out += [F.round(F.col(d) / 10.0 * radius * math.cos(angle), 6).alias(f"x{i}"), F.round(F.col(d) / 10.0 * radius * math.sin(angle), 6).alias(f"y{i}")]
    return out


def trend_line(hist: DataFrame, last: int, width: float = 320.0, height: float = 60.0) -> DataFrame:
    """skill, points: "x,y" of the last runs' composites, oldest first, evenly spaced over a box of width by height."""
    from .history import last_runs

    runs = F.sort_array(F.collect_list(F.struct((-F.col("recency")).alias("at"), F.col("composite_cents").alias("c"))))
    rows = last_runs(hist, last).groupBy("skill").agg(runs.alias("runs"))
    step = F.when(F.size("runs") > 1, width / (F.size("runs") - 1)).otherwise(0.0)
    point = lambda r, i: F.format_string("%.1f,%.1f", i * step, F.lit(height) - r["c"].cast("double") / 1000 * height)
    return rows.select("skill", F.array_join(F.transform("runs", point), " ").alias("points"))
