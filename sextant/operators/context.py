"""Passages as context for a language model: gates, headers, budgets, primers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.text import SPACE, missing_names, refusal

TOKEN_BUDGET, CHARS_PER_TOKEN = 3000, 4
#: Least score of the best hit and largest share of hits that aren't verified.
GATES = {"augment": (0.30, 0.30), "knowledge": (0.15, 1.0), "constrain": (0.0, 1.0)}
_ASKS = {
    "augment": "The passages come first: build on them, cite them, and where your own knowledge differs follow them.",
    "knowledge": "Use the passages for what they cover; fill in around them from general knowledge.",
    "constrain": "Use nothing but the passages. Where they don't cover the question, decline to answer.",
}


def suppressed(mode: Column | str, top1_score: Column | str = "top1_score", drift_fraction: Column | str = "drift_fraction") -> Column:
    """Whether the mode's gate holds the passages back."""
    mode, top, drift = (F.col(x) if isinstance(x, str) else x for x in (mode, top1_score, drift_fraction))
    out = F.lit(False)
    for name, (least, most) in GATES.items():
        out = F.when(mode == name, (top < least) | (drift > most)).otherwise(out)
    return out


def mode_header(mode: str) -> str:
    return f"<!-- mode: {mode} -->\n> **{mode.capitalize()}.** {_ASKS[mode]}"


def suppression_note(mode: str, top1_score: Column | str = "top1_score", drift_fraction: Column | str = "drift_fraction") -> Column:
    return F.format_string(f"*(held back in mode {mode}: best score %.3f, share drifted %.2f)*", top1_score, drift_fraction)


def anchor() -> Column:
    return F.format_string("%s:%d+%d", "source_file", "char_offset", "char_length")


def within_budget(rows: DataFrame, size: Column, budget: int | Column, by: list[str], order: list[Column | str]) -> DataFrame:
    """The leading rows of each group whose sizes sum to at most ``budget``; the first always stays."""
    w = Window.partitionBy(*by).orderBy(*order)
    used = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used_", used).withColumn("at_", F.row_number().over(w)).where((F.col("at_") == 1) | (F.col("used_") <= budget)).drop("used_", "at_")


def joined_text(by: list[str], order: str, text: str, sep: str) -> Column:
    """Aggregate: texts in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), sep)


def rendered(hits: DataFrame, budget_chars: int = TOKEN_BUDGET * CHARS_PER_TOKEN) -> DataFrame:
    """Verified hits with a text, each as a ``block`` of ``n_chars``, as far as the budget of their query goes. Who needs the sizes only
    doesn't have the blocks sent to where the hits of a query meet."""
    block = F.concat(F.lit("<!-- "), anchor(), F.format_string(" score=%.3f ", "score"), F.col("drift_status"), F.lit(" -->\n"), F.col("text"), F.lit("\n"))
    rows = hits.where("drift_status <> 'missing' and text <> ''").withColumn("block", block).withColumn("n_chars", F.length("block"))
    return within_budget(rows, F.col("n_chars"), budget_chars, ["query_id"], ["rank"])


def contexts(hits: DataFrame, metrics: DataFrame, questions: DataFrame, mode: str = "augment", budget_chars: int = TOKEN_BUDGET * CHARS_PER_TOKEN) -> DataFrame:
    """``(query_id, suppressed, n_passages, missing_names, context)`` for each of ``questions`` (``query_id``, ``question``).

    Names are looked for in the passages that the budget lets through, as only these are read."""
    bodies = rendered(hits, budget_chars).groupBy("query_id").agg(F.count("*").alias("n"), joined_text([], "rank", "block", "\n").alias("body"), joined_text([], "rank", "text", "\n").alias("seen"))
    rows = questions.join(metrics, "query_id", "left").join(bodies, "query_id", "left").fillna(0.0, ["top1_score", "drift_fraction"])
    held = suppressed(F.lit(mode))
    missing = F.when(held, F.array().cast("array<string>")).otherwise(missing_names("question", "seen"))
    rows = rows.withColumn("suppressed", held).withColumn("missing_names", missing)
    body = F.when(F.col("suppressed"), suppression_note(mode)).otherwise(F.concat(refusal("missing_names"), F.coalesce("body", F.lit(""))))
    n = F.when(F.col("suppressed"), 0).otherwise(F.coalesce("n", F.lit(0)))
    return rows.select("query_id", "suppressed", n.cast("long").alias("n_passages"), "missing_names", F.concat(F.lit(mode_header(mode) + "\n\n"), body).alias("context"))


def blocks_at_most(budget_chars: int = TOKEN_BUDGET * CHARS_PER_TOKEN) -> int:
    """How many questions a budget may have blocks of: none is shorter than its header, over a hundred characters."""
    return budget_chars // 100 + 1


def question_blocks(hits: DataFrame, metrics: DataFrame, questions: DataFrame, mode: str = "augment", budget_chars: int = TOKEN_BUDGET * CHARS_PER_TOKEN) -> DataFrame:
    """``(query_id, drifted, missing_names, block)``: one block per question with its metrics, in order of ``query_id``, as far as one
    budget for all goes; the first always stays."""
    text = F.regexp_replace(F.regexp_replace("text", f"^{SPACE}|{SPACE}$", ""), "\n", "\n> ")
    quote = F.concat(F.lit("> **"), anchor(), F.format_string("** score %.3f, ", "score"), F.col("drift_status"), F.lit("\n>\n> "), text)
    rows = hits.where("drift_status <> 'missing' and text <> ''").withColumn("quote", quote)
    bodies = rows.groupBy("query_id").agg(joined_text([], "rank", "quote", "\n\n").alias("body"), joined_text([], "rank", "text", "\n").alias("seen"))
    rows = questions.join(metrics, "query_id", "left").join(bodies, "query_id", "left").fillna(0.0)
    held = F.col("body").isNull() | suppressed(F.lit(mode))
    missing = F.when(held, F.array().cast("array<string>")).otherwise(missing_names("question", "seen"))
    note = F.when(F.col("body").isNull(), F.lit("*(no passage found)*")).when(suppressed(F.lit(mode)), suppression_note(mode))
    rows = rows.withColumn("missing_names", missing)
    head = F.format_string(f"<!-- question %d, mode={mode} top1_score=%.3f gap=%.3f source_diversity=%.2f drift_fraction=%.2f missing=%s -->\n## %s\n\n", "query_id", "top1_score", "top1_top2_gap", "source_diversity", "drift_fraction", F.when(F.size("missing_names") > 0, F.array_join("missing_names", ",")).otherwise("-"), F.coalesce("question", F.lit("")))
    block = F.concat(head, F.coalesce(note, F.concat(refusal("missing_names"), F.col("body"))))
    rows = rows.select("query_id", (F.col("drift_fraction") > 0).alias("drifted"), "missing_names", block.alias("block"))
    rows = rows.orderBy("query_id").limit(blocks_at_most(budget_chars))
    return within_budget(rows, F.length("block"), budget_chars, [], ["query_id"])


def structure(passages: DataFrame, budget_chars: int = 800 * CHARS_PER_TOKEN) -> DataFrame:
    """``(place, source_file, n_passages)``: files by passages, as many lines as fit. Only so many are sorted."""
    counts = passages.groupBy("source_file").agg(F.count("*").alias("n_passages"))
    fits = budget_chars // 10 + 1  # no line is shorter than ten characters
    top = counts.orderBy(F.desc("n_passages"), "source_file").limit(fits)
    place = F.row_number().over(Window.orderBy(F.desc("n_passages"), "source_file"))
    line = F.format_string("- `%s`: %d passages", "source_file", "n_passages")
    rows = within_budget(top.withColumn("place", place), F.length(line), budget_chars, [], ["place"])
    return rows.select("place", "source_file", "n_passages")


def primer(hits: DataFrame, budget_chars: int) -> DataFrame:
    """Hits of each query whose texts fit its budget: for landscape (hits of the centroid) and evidence sections."""
    rows = hits.where("drift_status <> 'missing' and text <> ''")
    return within_budget(rows, F.length("text"), budget_chars, ["query_id"], ["rank"])


def evidence_budget(questions: int, budget_chars: int = 1600 * CHARS_PER_TOKEN) -> int:
    """What each of so many questions may use."""
    return max(200, budget_chars // max(1, questions))
