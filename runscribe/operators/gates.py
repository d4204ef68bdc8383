"""Gates, bounds and hygiene rules as filters and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import has, java
from .scoring import DIMENSIONS, GRADES

RANKS = {g: len(GRADES) - 1 - i for i, (_, g, _) in enumerate(GRADES)}


def auto_gate(runs: DataFrame, lists: DataFrame, enabled: Column | None = None) -> DataFrame:
    """Runs whose skill is on the ``always`` list and not on ``never``; a null switch counts as on."""
    on = F.lit(True) if enabled is None else F.coalesce(enabled, F.lit(True))
    never = lists.where("list = 'never'").select("skill")
    always = lists.where("list = 'always'").select("skill")
    return runs.where(on).join(never, "skill", "left_anti").join(always, "skill", "left_semi")


def threshold_gate(hist: DataFrame, cents: int) -> DataFrame:
    return hist.where(F.col("composite_cents") < cents)


def grade_rank(grade: Column) -> Column:
    return F.coalesce(F.create_map(*[x for g, r in RANKS.items() for x in (F.lit(g), F.lit(r))])[grade], F.lit(-1))


def bound_violations(cases: DataFrame, scores: DataFrame) -> DataFrame:
    """(name, lows, highs: maps of dim to bound) against (name, dim, score): bounds that don't hold; a missing dimension is 0."""
    bounds = cases.select("name", F.explode("lows").alias("dim", "bound"), F.lit("min").alias("kind")).union(cases.select("name", F.explode("highs"), F.lit("max")))
    got = F.coalesce("score", F.lit(0.0))
    broken = F.when(F.col("kind") == "min", got < F.col("bound")).otherwise(got > F.col("bound"))
    return bounds.join(scores, ["name", "dim"], "left").where(broken).select("name", "dim", "kind", "bound", got.alias("score"))


def regressions(cases: DataFrame, cards: DataFrame) -> DataFrame:
    """(name, low, high, grade_min, lows, highs) against (name, composite_cents, grade, the dimensions) -> name, passed, errors in order.

    A case without a scorecard has composite 0, grade F and dimensions of 0.  ``grade_min`` compares ranks.
    """
    c = F.col
    dims = DIMENSIONS
    met = cases.join(cards.select("name", (c("composite_cents") / 100).cast("double").alias("composite"), c("grade").alias("got_grade"), F.create_map(*[x for d in dims for x in (F.lit(d), c(d).cast("double"))]).alias("got")), "name", "left")
    composite, got_grade = F.coalesce("composite", F.lit(0.0)), F.coalesce("got_grade", F.lit("F"))

    def of(dim: Column) -> Column:
        return F.coalesce(F.try_element_at("got", dim), F.lit(0.0))

    def shown(x: Column) -> Column:
        return F.format_string("%.2f", x.cast("double"))

    def sides(bounds: str, below: bool) -> Column:
        entries = F.array_sort(F.map_entries(F.coalesce(bounds, F.expr("CAST(map() AS map<string,double>)"))))
        broken = F.filter(entries, lambda e: of(e["key"]) < e["value"] if below else of(e["key"]) > e["value"])
        word = " < expected_min " if below else " > expected_max "
        return F.transform(broken, lambda e: F.concat(F.lit("dimension "), e["key"], F.lit("="), shown(of(e["key"])), F.lit(word), shown(e["value"])))

    first = F.array_compact(
        F.array(
            F.when(composite < c("low"), F.concat(F.lit("composite "), shown(composite), F.lit(" < expected_min "), shown(c("low")))),
            F.when(composite > c("high"), F.concat(F.lit("composite "), shown(composite), F.lit(" > expected_max "), shown(c("high")))),
            F.when(grade_rank(got_grade) < grade_rank(c("grade_min")), F.concat(F.lit("grade "), got_grade, F.lit(" below expected_min "), c("grade_min"))),
        )
    )
    errors = F.concat(first, sides("lows", True), sides("highs", False))
    return met.select("name", (F.size(errors) == 0).alias("passed"), errors.alias("errors"))


def ci_gate(cards: DataFrame, threshold: str | None = None) -> DataFrame:
    """(skill, composite_cents, grade, one_liner) -> skill, message, output, status (1 below the threshold).  A threshold that is no number gates nothing."""
    try:
        bound = float(threshold) if threshold and str(threshold).strip() else None
    except ValueError:
        bound = None
    composite = (F.col("composite_cents") / 100).cast("double")
    shown = F.format_string("%.2f", composite)
    message = F.concat("skill", F.lit(" -> "), shown, F.lit("/10 ("), F.col("grade"), F.lit(") — "), F.coalesce("one_liner", F.lit("")))
    status = F.lit(0) if bound is None else F.when(composite < bound, 1).otherwise(0)
    return cards.select("skill", message.alias("message"), F.concat(F.lit("composite="), shown, F.lit("\ngrade="), F.col("grade")).alias("output"), status.alias("status"))


def finished(runs: DataFrame, event: str = "event") -> DataFrame:
    """Runs that may be scored: those that ended with a failure of the service are left out."""
    return runs.where(F.coalesce(F.col(event), F.lit("")) != "StopFailure")


def hygiene(cases: DataFrame) -> DataFrame:
    """(name, low, high, grade_min, grade_max) -> findings of cases without bounds or with brittle ones."""
    no_spec = F.coalesce("low", "high").isNull() & F.coalesce("grade_min", "grade_max").isNull()
    brittle = (F.col("low") == F.col("high")) | (F.col("high") - F.col("low") < 0.5) | (F.col("grade_min") == F.col("grade_max"))
    rules = F.array_compact(F.array(F.when(no_spec, F.lit("VBL001")), F.when(F.coalesce(brittle, F.lit(False)), F.lit("VBL003"))))
    return cases.select("name", F.explode(rules).alias("rule"))


def hygiene_score(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """1 - flagged / all, to four places; 1 without cases."""
    flagged = findings.agg(F.count_distinct("name").alias("flagged"))
    return cases.agg(F.count("*").alias("cases")).crossJoin(flagged).select("cases", "flagged", F.coalesce(F.round(1 - F.col("flagged") / F.nullif("cases", F.lit(0)), 4), F.lit(1.0)).alias("score"))


def hygiene_status(scores: DataFrame, least: float = 0.85) -> DataFrame:
    """cases, flagged, score -> with status: 0 from ``least`` on, else 1."""
    return scores.withColumn("status", F.when(F.col("score") >= least, 0).otherwise(1))


def rewrite_lint(lines: DataFrame) -> DataFrame:
    """(source_id, line_no, text) -> rule and first line: undisclosed rewrites, no source, flipped errors, secrets; comments don't count."""
    code = lines.where(~F.regexp_replace("text", r"^\s+", "").startswith("#"))
    t = F.col("text")

    def first(name: str) -> Column:
        return F.min(F.when(has(t, name), F.col("line_no"))).alias(name)

    names = ["rewritten_output", "rewrite_note", "rewrite_source", "error_true", "error_false", "suppressed", "secret_sk", "secret_akia", "secret_aiza", "secret_ghp", "secret_pem"]
    at = code.groupBy("source_id").agg(*[first(n) for n in names])
    c = F.col
    rules = [F.when(c("rewritten_output").isNotNull() & c("rewrite_note").isNull(), F.struct(F.lit("F1").alias("rule"), c("rewritten_output").alias("line_no")))]
    rules.append(F.when(c("rewritten_output").isNotNull() & c("rewrite_source").isNull(), F.struct(F.lit("F2").alias("rule"), c("rewritten_output").alias("line_no"))))
    rules.append(F.when(c("error_true").isNotNull() & c("error_false").isNotNull() & c("suppressed").isNull(), F.struct(F.lit("F3").alias("rule"), c("error_false").alias("line_no"))))
    rules += [F.when(c(n).isNotNull(), F.struct(F.lit("F4").alias("rule"), c(n).alias("line_no"))) for n in names if n.startswith("secret")]
    return at.select("source_id", F.explode(F.array_compact(F.array(*rules))).alias("f")).select("source_id", "f.rule", "f.line_no")


def lint_status(lines: DataFrame, findings: DataFrame) -> DataFrame:
    """source_id, n_findings, status of each source of ``lines``: 0 without findings, 1 with, 2 where it has no text at all."""
    sources = lines.groupBy("source_id").agg(F.max(F.col("text").isNotNull()).alias("there"))
    found = findings.groupBy("source_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return sources.join(found, "source_id", "left").select("source_id", n.alias("n_findings"), F.when(~F.col("there"), 2).when(n > 0, 1).otherwise(0).alias("status"))


# What a model costs that no table names, dollars a million tokens, and what is said of a card without usage.
DEFAULT_RATE = {"input": 10.0, "output": 30.0}
NO_USAGE = "No llm_usage block: heuristics only (zero LLM cost)."


def cost(usage: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """(…, model, input_tokens, output_tokens) with model_used, input_usd, output_usd, total_usd and status.

    Prices are (model, input, output), dollars a million tokens.  A model without a row costs the ``default`` row, and where
    there is none DEFAULT_RATE; a side without a rate is free.  The total is the sum of both sides, rounded once.  Negative or
    missing tokens have no cost and status 2, all others 0.  Every usage row stays; of prices that repeat a model the highest counts.
    """
    joined = usage.withColumn("_all", F.lit(1))
    if prices is None:
        joined = joined.withColumns({"_priced": F.lit(None).cast("string"), "_own": F.lit(None).cast("struct<input:double,output:double>"), "_rest": F.lit(None).cast("struct<input:double,output:double>")})
    else:
        rates = F.struct(*[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in DEFAULT_RATE])
        table = prices.groupBy("model").agg(F.max(rates).alias("_own"))
        default = table.where("model = 'default'").select(F.lit(1).alias("_all"), F.col("_own").alias("_rest"))  # one row at most
        joined = joined.join(table.where("model <> 'default'").withColumnRenamed("model", "_priced"), F.col("model") == F.col("_priced"), "left").join(default, "_all", "left")
    fits = (F.col("input_tokens") >= 0) & (F.col("output_tokens") >= 0)
    sides = {s: F.when(fits, F.col(f"{s}_tokens") / 1_000_000 * F.coalesce(f"_own.{s}", f"_rest.{s}", F.lit(rate))) for s, rate in DEFAULT_RATE.items()}
    return joined.select(
        *usage.columns,
        F.coalesce("_priced", F.lit("default")).alias("model_used"),
        *[F.round(v, 6).alias(f"{s}_usd") for s, v in sides.items()],
        F.round(sides["input"] + sides["output"], 6).alias("total_usd"),
        F.when(F.coalesce(fits, F.lit(False)), 0).otherwise(2).alias("status"),
    )


def pinned_dimensions(cases: DataFrame) -> DataFrame:
    """(name, lows, highs) -> one VBL003 finding a dimension whose two bounds are equal."""
    bounds = cases.select("name", "highs", F.explode("lows").alias("dim", "low"))
    return bounds.where(F.col("low") == F.try_element_at("highs", F.col("dim"))).select("name", F.lit("VBL003").alias("rule"), "dim")


def hygiene_files(cases: DataFrame, files: DataFrame, suffixes: dict[str, list[str]]) -> DataFrame:
    """(name, transcript, adapter) against (path, lines that aren't blank) -> VBL002 of bad paths or suffixes, VBL004 of empty files."""
    path, known = F.col("transcript"), F.col("lines").isNotNull()
    allowed = F.create_map(*[x for a, s in suffixes.items() for x in (F.lit(a), F.array(*map(F.lit, s)))])[F.col("adapter")]
    suffix = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    outside = path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)")
    problem = F.coalesce(path, F.lit("")).eqNullSafe("") | outside | ~known | F.coalesce(~F.array_contains(allowed, suffix), F.lit(False))
    rules = F.array_compact(F.array(F.when(problem, F.lit("VBL002")), F.when(F.col("lines") == 0, F.lit("VBL004"))))
    return cases.join(files, path == F.col("path"), "left").select("name", F.explode(rules).alias("rule"))


def capabilities(declared: Column) -> Column:
    """``resource:mode`` entries of a comma list in lower case; malformed or unknown ones don't count."""
    tokens = F.transform(F.split(F.lower(F.coalesce(declared, F.lit(""))), ","), lambda t: F.regexp_replace(t, r"\s+", ""))
    return F.filter(tokens, lambda t: t.rlike("^(bash|fs|net|exec):(read|write|none)$"))


def missing_capabilities(declared: Column, required: Column) -> Column:
    return F.array_except(capabilities(required), capabilities(declared))


def capability_rationale(declared: Column, required: Column) -> Column:
    """Which of three cases holds: none declared, some missing, or all there."""
    have, missing = capabilities(declared), missing_capabilities(declared, required)
    return (
        F.when(F.size(have) == 0, "no capabilities declared; declare the expected ones explicitly")
        .when(F.size(missing) > 0, F.concat(F.lit("declared "), F.size(have).cast("string"), F.lit(" capabilities but missing required: "), F.array_join(missing, ",")))
        .otherwise(F.concat(F.lit("capabilities OK ("), F.array_join(have, ","), F.lit(")")))
    )


def collapse_gate(collapsed: Column, mode: str = "warn") -> Column:
    """``pass``, or for a collapsed history what ``mode`` says: warn, fail, or (off) pass."""
    return F.when(F.coalesce(collapsed, F.lit(False)) & F.lit(mode != "off"), F.lit(mode)).otherwise("pass")


def cost_of_scorecards(cards: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """(skill, model, llm_usage: struct of input_tokens and output_tokens, or null) -> cost; without usage nothing was spent, whatever the model."""
    used = F.col("llm_usage").isNotNull()
    usage = cards.select(
        "skill", F.coalesce(F.nullif("model", F.lit("")), F.lit("default")).alias("model"), F.coalesce("llm_usage.input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("llm_usage.output_tokens", F.lit(0)).alias("output_tokens"), used.alias("has_usage")
    )
    rationale = F.when(~F.col("has_usage"), NO_USAGE).alias("rationale")
    return cost(usage, prices).select("skill", "model", "model_used", "has_usage", F.when(F.col("has_usage"), F.col("total_usd")).otherwise(0.0).alias("total_usd"), rationale, "status")
