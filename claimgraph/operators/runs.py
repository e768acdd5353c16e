"""Run roll-ups (H10-H12) and the run-event log in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ["run_completed", "run_failed", "run_cancelled"]
REOPEN = ["run_retried", "run_resumed"]
MOVES = ["agent_started", "run_paused"]


def run_summary(runs: DataFrame, pubs: DataFrame, audits: DataFrame, reviews: DataFrame, verification: DataFrame | None = None) -> DataFrame:
    """One row per run: papers, independent journals, D/E candidates, accepted reviews, and whether it is ready.

    ``verification`` (run_id, reported) adds by how many papers the run's own report is off.
    """
    p = pubs.groupBy("run_id").agg(F.count("*").alias("papers"), F.count_distinct("journal").alias("journals"))
    a = audits.groupBy("run_id").agg(F.count_if(F.col("class").isin("D", "E")).alias("novel"))
    r = reviews.groupBy("run_id").agg(F.count_if("accepted").alias("accepted"))
    out = runs.join(p, "run_id", "left").join(a, "run_id", "left").join(r, "run_id", "left").fillna(0, ["papers", "journals", "novel", "accepted"])
    if verification is not None:
        reported = verification.groupBy("run_id").agg(F.max("reported").alias("reported"))
        out = out.join(reported, "run_id", "left").withColumn("count_discrepancy", F.col("reported") - F.col("papers"))
    return out.withColumns({"degraded": F.col("papers") < 10, "ready": (F.col("papers") >= 10) & (F.col("accepted") > 0)})


def eval_metrics(scores: DataFrame) -> DataFrame:
    """Outcome counts, sessions, gate catch rate (where the truth isn't D or E) and judge agreement; null without cases."""
    bad = ~F.col("ground_truth").isin("D", "E")
    return scores.agg(
        F.count("*").alias("n"),
        F.count_distinct("session_id").alias("sessions"),
        F.count_if(F.col("outcome") == "caught").alias("caught"),
        F.round(F.count_if(bad & (F.col("outcome") == "caught")) / F.nullif(F.count_if(bad), F.lit(0)), 4).alias("catch_rate"),
        F.round(F.count_if(F.col("original_label") == F.col("ground_truth")) / F.nullif(F.count("*"), F.lit(0)), 4).alias("agreement"),
    )


def replace_scores(table: DataFrame, new: DataFrame, subject_type: str) -> DataFrame:
    """The table with one subject type's slice replaced; doing it twice changes nothing more."""
    return table.where(F.col("subject_type") != subject_type).unionByName(new.where(F.col("subject_type") == subject_type))


def write_scores(new: DataFrame, path: str) -> None:
    """H12 at rest: partitions by subject type, only those in ``new`` overwritten."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("subject_type").parquet(path)


def sequence_events(events: DataFrame) -> DataFrame:
    """Gap-free seq from 0 per run in arrival order."""
    return events.withColumn("seq", (F.row_number().over(Window.partitionBy("run_id").orderBy("created_at", "arrival")) - 1).cast("long"))


def replay(events: DataFrame, after: int, run: str | None = None) -> DataFrame:
    """R2: events after a sequence number, each (run, seq) once."""
    rows = events.where(F.col("seq") > after).dropDuplicates(["run_id", "seq"])
    return rows.where(F.col("run_id") == run) if run else rows


def agent_of(events: DataFrame) -> Column:
    """The events' agent; their step where the log has no column for it."""
    return F.col("agent") if "agent" in events.columns else F.col("step_id") if "step_id" in events.columns else F.lit(None).cast("string")


def run_status(events: DataFrame) -> DataFrame:
    """Status per run: the first terminal event of the last attempt, else paused or running by its last start or pause, else running.

    The agent is that of the last start or pause; the first error is kept.
    """
    by = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumns({"attempt": F.sum(F.col("event_type").isin(REOPEN).cast("int")).over(by), "agent_": agent_of(events)})
    ends, moves = F.col("event_type").isin(TERMINAL), F.col("event_type").isin(MOVES)
    per = rows.groupBy("run_id", "attempt").agg(
        F.min_by("event_type", F.when(ends, F.col("seq"))).alias("end"),
        F.max_by("event_type", F.when(moves, F.col("seq"))).alias("move"),
        F.max_by("agent_", F.when(moves, F.col("seq"))).alias("agent"),
        F.max(F.when(moves, F.col("seq"))).alias("move_seq"),
        F.max("seq").alias("last_seq"),
        F.min(F.when(F.col("event_type") == "run_failed", F.col("seq"))).alias("error"),
    )
    last = per.groupBy("run_id").agg(F.max_by(F.struct("end", "move"), "attempt").alias("x"), F.max("attempt").alias("attempts"), F.max("last_seq").alias("last_seq"), F.max_by("agent", "move_seq").alias("current_agent"), F.min("error").alias("first_error_seq"))
    end, move = F.col("x.end"), F.col("x.move")
    status = F.when(end == "run_completed", "completed").when(end == "run_failed", "failed").when(end == "run_cancelled", "cancelled").when(move == "run_paused", "paused").otherwise("running")
    return last.select("run_id", status.alias("status"), "current_agent", "attempts", "last_seq", "first_error_seq")


def shortened(text: Column, most: int = 800) -> Column:
    """A summary, trimmed, with dots after its first ``most`` characters."""
    text = F.trim(text)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def pair_steps(events: DataFrame) -> DataFrame:
    """Each start with the next completion of the same step before another start; lone completions go.

    The agent comes from the start; the error flag and the summary (800 characters and dots) from the completion, where the log has them.
    """
    steps = events.where(F.col("event_type").isin("agent_started", "agent_completed") & F.col("step_id").isNotNull())
    ahead = Window.partitionBy("run_id", "step_id").orderBy("seq")
    nxt = lambda c: F.lead(c).over(ahead)
    more = {f"next_{c}": nxt(c) for c in ("is_error", "summary") if c in events.columns}
    rows = steps.withColumns({"agent_": agent_of(events), "next_type": nxt("event_type"), "end_seq": nxt("seq"), "ended_at": nxt("created_at")} | more)
    rows = rows.where("event_type = 'agent_started' and next_type = 'agent_completed'")
    error = F.coalesce("next_is_error", F.lit(False)) if "next_is_error" in more else F.lit(False)
    short = shortened(F.col("next_summary") if "next_summary" in more else F.lit(None).cast("string"))
    return rows.select("run_id", "step_id", F.col("agent_").alias("agent"), F.col("seq").alias("start_seq"), "end_seq", (F.unix_micros("ended_at") - F.unix_micros("created_at")).alias("duration_us"), error.alias("is_error"), short.alias("summary"))


def tokens_of(events: DataFrame) -> Column:
    """Tokens of an event: its total, else those in and out where the log has them."""
    tokens = F.col("tokens") if "tokens" in events.columns else F.lit(None).cast("long")
    if {"tokens_in", "tokens_out"} <= set(events.columns):
        parts = F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))
        tokens = F.coalesce(tokens, F.when(F.coalesce("tokens_in", "tokens_out").isNotNull(), parts))
    return tokens


def usage_totals(events: DataFrame, budget: int = 2_000_000, cumulative: bool = False) -> DataFrame:
    """Calls and tokens per run, and the first event at which the running total passes the budget.

    ``tokens`` may be left out where tokens_in and tokens_out are there. A ``cumulative`` source reports totals: its last record counts.
    """
    rows = events.withColumn("t_", tokens_of(events))
    by = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    running = F.last("t_", ignorenulls=True).over(by) if cumulative else F.sum(F.coalesce("t_", F.lit(0))).over(by)
    total = F.max_by("t_", F.when(F.col("t_").isNotNull(), F.col("seq"))) if cumulative else F.sum("t_")
    return rows.withColumn("running", running).groupBy("run_id").agg(F.count("t_").alias("calls"), total.alias("total"), F.min(F.when(F.col("running") > budget, F.col("seq"))).alias("exhausted_at"))


def stalled_runs(events: DataFrame, idle: int = 600, total: int = 3600) -> DataFrame:
    """Longest silence and length of each run, with flags beyond the limits (seconds)."""
    gap = F.unix_seconds("created_at") - F.unix_seconds(F.lag("created_at").over(Window.partitionBy("run_id").orderBy("seq")))
    per = events.withColumn("gap", gap).groupBy("run_id").agg(F.max("gap").alias("longest_gap"), (F.unix_seconds(F.max("created_at")) - F.unix_seconds(F.min("created_at"))).alias("length"))
    return per.select("run_id", "longest_gap", "length", (F.coalesce("longest_gap", F.lit(0)) > idle).alias("stalled"), (F.col("length") > total).alias("overlong"))


def interventions(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Human decisions of each run in order, with their number."""
    per = decisions.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "decision"))).alias("list"), F.count("*").alias("n"))
    return runs.join(per, "run_id", "left").select("run_id", F.coalesce("n", F.lit(0)).alias("n"), F.transform(F.coalesce("list", F.array()), lambda x: x["decision"]).alias("decisions"))
