"""Reporting datasets over summaries and exceptions, for all vendors at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom import config

MONEY = "decimal(18,2)"


def reason_label(reason: Column) -> Column:
    out = reason
    for name, label in config.REASON_LABELS.items():
        out = F.when(reason == name, label).otherwise(out)
    return out


def days_between(start: Column, now: Column) -> Column:
    """Whole elapsed days of 24 hours, rounded down."""
    return F.floor((F.unix_micros(now) - F.unix_micros(start)) / 86_400_000_000)


def percent(part: Column, whole: Column, digits: int) -> Column:
    value = F.round((part * 100).cast(MONEY) / F.nullif(whole, F.lit(0)).cast(MONEY), digits)
    return F.coalesce(value.cast("double"), F.lit(0.0))


def latest_runs(summaries: DataFrame) -> DataFrame:
    """Runs at their vendor's latest time; ties stay, runs without a vendor go."""
    newest = Window.partitionBy("vendor_id").orderBy(F.col("run_ts").desc())
    return summaries.where("vendor_id is not null").withColumn("_r", F.rank().over(newest)).where("_r = 1").drop("_r")


def last_run(summaries: DataFrame) -> DataFrame:
    """One run per vendor: the latest, and of ties the greatest statement id."""
    newest = Window.partitionBy("vendor_id").orderBy(F.col("run_ts").desc(), F.col("statement_id").desc())
    return summaries.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")


def open_only(exceptions: DataFrame) -> DataFrame:
    return exceptions.where("exception_status = 'OPEN'")


def open_in_latest(exceptions: DataFrame, summaries: DataFrame) -> DataFrame:
    return open_only(exceptions).join(latest_runs(summaries).select("statement_id"), "statement_id")


def kpis(summaries: DataFrame, exceptions: DataFrame, review: DataFrame) -> DataFrame:
    runs = latest_runs(summaries).agg(
        F.coalesce(F.sum("total_invoice_count"), F.lit(0)).alias("total_invoices"),
        F.coalesce(F.sum("matched_count"), F.lit(0)).alias("auto_reconciled"),
        F.coalesce(F.sum("statement_total"), F.lit(0)).cast("double").alias("statement_total"),
        F.count_distinct("vendor_id").alias("vendor_count"),
    )
    opened = open_in_latest(exceptions, summaries).agg(F.count("*").alias("open_exceptions"))
    pending = review.agg(F.count_if(F.col("review_status") == "PENDING_REVIEW").alias("pending_review_count"))
    return runs.join(opened).join(pending).withColumn(  # one row each
        "match_rate", percent(F.col("auto_reconciled"), F.col("total_invoices"), 1)
    )


def live_counts(runs: DataFrame, exceptions: DataFrame) -> DataFrame:
    """``runs`` with the count of exceptions open now, and the status that follows."""
    opened = open_only(exceptions).groupBy("statement_id").agg(F.count("*").alias("live"))
    live = F.coalesce("live", F.lit(0))
    return runs.join(opened, "statement_id", "left").withColumn("exception_count", live).withColumn(
        "overall_status", F.when(live == 0, "RECONCILED").otherwise("EXCEPTIONS_PRESENT")
    ).drop("live")


def recent_runs(summaries: DataFrame, exceptions: DataFrame, n: int) -> DataFrame:
    """The ``n`` latest runs (a top-k report)."""
    runs = latest_runs(summaries).orderBy(F.col("run_ts").desc(), F.col("statement_id").desc()).limit(n)
    return live_counts(runs, exceptions)


def reason_breakdown(exceptions: DataFrame) -> DataFrame:
    return open_only(exceptions).groupBy("statement_id", reason_label(F.col("exception_reason")).alias("label")).agg(F.count("*").alias("n"))


def orphans(exceptions: DataFrame, summaries: DataFrame) -> DataFrame:
    """Open exceptions whose statement has no summary."""
    return open_only(exceptions).join(summaries.select("statement_id"), "statement_id", "left_anti")


def file_title(source_file: Column) -> Column:
    """Display name of a file: no extension, separators as blanks, capitalised words."""
    stem = F.regexp_replace(F.element_at(F.split(source_file, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.initcap(F.translate(stem, "_-", "  "))


def breakdown(rows: DataFrame, key: str, label: Column) -> DataFrame:
    """Counts of each label as ``label:n``, in order, comma-joined, for every ``key``."""
    counts = rows.groupBy(key, label.alias("_label")).agg(F.count("*").alias("_n"))
    return counts.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "_label", "_n"))), ",").alias("breakdown"))


def exceptions_only_vendors(exceptions: DataFrame, summaries: DataFrame) -> DataFrame:
    """Orphan exceptions by source file, shaped like vendor cards."""
    source = F.coalesce(F.nullif(F.col("source_file"), F.lit("")), F.lit("Unknown source"))
    return orphans(exceptions, summaries).groupBy(source.alias("source_file")).agg(F.count("*").alias("exception_count")).select(
        file_title(F.col("source_file")).alias("vendor_name"), "source_file", "exception_count",
        F.lit("EXCEPTIONS_PRESENT").alias("overall_status"), F.lit(True).alias("exceptions_only"),
    )


def vendor_summaries(summaries: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Every vendor's last run with its open exceptions, and the vendors that have exceptions only."""
    columns = ["vendor_name", "statement_id", "total_invoice_count", "matched_count", "exception_count", "overall_status", "exceptions_only"]
    last = last_run(summaries).select("vendor_id", "statement_id", "total_invoice_count", "matched_count", "overall_status")
    opened = open_only(exceptions).groupBy("statement_id").agg(F.count("*").alias("exception_count"))
    normal = last.join(opened, "statement_id", "left").select(
        F.col("vendor_id").alias("vendor_name"), "statement_id", "total_invoice_count", "matched_count",
        F.coalesce("exception_count", F.lit(0)).alias("exception_count"), "overall_status", F.lit(False).alias("exceptions_only"),
    )
    only = exceptions_only_vendors(exceptions, summaries).select(
        "vendor_name", F.lit(None).cast("string").alias("statement_id"), F.lit(0).cast("long").alias("total_invoice_count"),
        F.lit(0).cast("long").alias("matched_count"), "exception_count", "overall_status", "exceptions_only",
    )
    return normal.select(*columns).unionByName(only.select(*columns))


def vendor_cards(summaries: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Every vendor's last run with its open exceptions by reason, ordered by name (null as empty)."""
    opened = breakdown(open_only(exceptions), "statement_id", reason_label(F.col("exception_reason")))
    cards = vendor_summaries(summaries, exceptions).join(opened, "statement_id", "left")
    return cards.withColumnRenamed("breakdown", "reason_breakdown").orderBy(F.coalesce("vendor_name", F.lit("")))


def of_file_title(exceptions: DataFrame, title: Column) -> DataFrame:
    """Exceptions whose file has the display name ``title``."""
    return exceptions.where(file_title(F.col("source_file")) == title)


def open_list(exceptions: DataFrame, silver: DataFrame, now: Column, reason: str | None = None) -> DataFrame:
    """Open exceptions with the line's invoice date and repair order, and their age; ``reason`` is missing, mismatch or anything for all."""
    chosen = {"missing": "Invoice Missing", "mismatch": "Amount Mismatch"}.get(reason or "")
    rows = open_only(exceptions)
    if chosen:
        rows = rows.where(F.col("exception_reason") == chosen)
    lines = silver.select("statement_id", "seq", "invoice_date", "ro_number")
    return rows.join(lines, ["statement_id", "seq"], "left").select(
        "exception_id", "statement_id", "vendor_id", "invoice_number", "exception_reason", "invoice_date", "ro_number", "escalation_status",
        days_between(F.col("date_raised"), now).alias("days_open"),
    )


def exception_counts(exceptions: DataFrame) -> DataFrame:
    """Total, resolved and progress (percent, half to even) per statement."""
    out = exceptions.groupBy("statement_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("exception_status") != "OPEN").alias("resolved")
    )
    return out.withColumn("progress_percent", F.bround((F.col("resolved") * 100).cast(MONEY) / F.col("total").cast(MONEY), 0).cast("int"))


def aging(exceptions: DataFrame, now: Column) -> DataFrame:
    """Oldest open exception of each vendor."""
    out = open_only(exceptions).groupBy("vendor_id").agg(F.min("date_raised").alias("oldest"), F.count("*").alias("open_count"),
                                                         F.count_if(F.col("escalation_status") == "ESCALATED").alias("escalated_count"))
    return out.withColumn("oldest_days", days_between(F.col("oldest"), now))


def age_badge(days: Column) -> Column:
    return F.when(days < 7, "fresh").when(days <= 14, "aging").otherwise("overdue")


def confidence_badge(score: Column) -> Column:
    return F.when(score >= 0.95, "high").when(score >= 0.80, "medium").otherwise("low")


def vendor_match_rate(summaries: DataFrame) -> DataFrame:
    """Match rate over all runs of a vendor, with a warning below 90 percent."""
    out = summaries.groupBy("vendor_id").agg(F.sum("matched_count").alias("matched"), F.sum("total_invoice_count").alias("total"))
    rate = percent(F.col("matched"), F.col("total"), 1)
    return out.withColumn("match_rate", rate).withColumn("warn", F.col("matched") * 100 < F.col("total") * 90)


def explain_candidates(exceptions: DataFrame, per_statement: int) -> DataFrame:
    """The first open exceptions of each statement up to a cap (the feature), and how many are skipped."""
    rows = open_only(exceptions)
    order = Window.partitionBy("statement_id").orderBy("exception_reason", F.col("invoice_number").asc_nulls_first(), "exception_id")
    every = Window.partitionBy("statement_id")
    return (
        rows.withColumn("_k", F.row_number().over(order)).withColumn("_n", F.count("*").over(every)).where(F.col("_k") <= per_statement)
        .select("statement_id", "exception_id", "exception_reason", F.greatest(F.lit(0), F.col("_n") - per_statement).alias("skipped"))
    )


def top_matched(matched: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest matched amounts of each statement (a top-k report)."""
    order = Window.partitionBy("statement_id").orderBy(F.col("statement_amount").desc(), "seq")
    return matched.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(
        "statement_id", "rank", "invoice_number", F.col("statement_amount").cast("double").alias("statement_amount")
    )


def exception_suggestions(silver: DataFrame) -> DataFrame:
    """Two invoices to drop and one to change, from the ten largest of each statement that has three."""
    usable = silver.where("invoice_number is not null and outstanding_amount is not null")
    order = Window.partitionBy("statement_id").orderBy(F.col("outstanding_amount").desc(), "seq")
    every = Window.partitionBy("statement_id")
    ranked = usable.withColumn("rank", F.row_number().over(order)).withColumn("_n", F.count("*").over(every))
    changed = F.round(F.col("outstanding_amount") * F.lit("0.85").cast("decimal(3,2)"), 2).cast("double")
    return ranked.where("_n >= 3 and rank <= 3").select(
        "statement_id", "rank", "invoice_number", F.when(F.col("rank") <= 2, "missing").otherwise("mismatch").alias("role"),
        F.when(F.col("rank") == 3, changed).alias("suggested_amount"),
    )


def vendor_names(statements: DataFrame, intake_log: DataFrame, summaries: DataFrame) -> DataFrame:
    """Vendor name of each statement: of the intake log, or else of its summary."""
    a = intake_log.select("statement_id", F.nullif(F.col("vendor_name"), F.lit("")).alias("a"))
    b = summaries.select("statement_id", F.nullif(F.col("vendor_id"), F.lit("")).alias("b"))
    return statements.join(a, "statement_id", "left").join(b, "statement_id", "left").select(
        "statement_id", F.coalesce("a", "b").alias("vendor_name")
    )


def bulk_preview(exceptions: DataFrame, summaries: DataFrame, threshold: float) -> DataFrame:
    """Open exceptions of latest runs and orphans that a bulk approval would accept, by vendor."""
    sure = F.col("match_confidence") >= threshold
    live = open_in_latest(exceptions, summaries).where(sure).select("vendor_id", "exception_id")
    lone = orphans(exceptions, summaries).where(sure).select("vendor_id", "exception_id")
    return live.unionByName(lone).groupBy("vendor_id").agg(F.count_distinct("exception_id").alias("n"))


def statement_report(summaries: DataFrame, matched: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Summary of every statement beside its matched and exception totals."""
    m = matched.groupBy("statement_id").agg(F.sum("statement_amount").cast("double").alias("matched_amount"), F.count_if(F.col("level") == 2).alias("second_level"))
    e = exceptions.groupBy("statement_id").agg(F.count("*").alias("raised"), F.count_if(F.col("exception_status") == "OPEN").alias("open"))
    return summaries.join(m, "statement_id", "left").join(e, "statement_id", "left").select(
        "statement_id", "total_invoice_count", "matched_count", F.coalesce("matched_amount", F.lit(0.0)).alias("matched_amount"),
        F.coalesce("second_level", F.lit(0)).alias("second_level"), F.coalesce("raised", F.lit(0)).alias("raised"), F.coalesce("open", F.lit(0)).alias("open"),
    )


def report_rows(matched: DataFrame, exceptions: DataFrame) -> DataFrame:
    """The rows of every statement's report by section and place: matched by number, exceptions by status, reason and number."""
    columns = ["section", "statement_id", "invoice_number", "statement_amount", "erp_amount", "detail"]
    a = matched.withColumn("section", F.lit("matched")).withColumn("detail", F.concat(F.lit("L"), "level")).withColumn("_key", F.struct(F.lit("").alias("s"), F.lit("").alias("r")))
    b = exceptions.withColumn("section", F.lit("exception")).withColumn("detail", F.concat_ws(":", "exception_status", "exception_reason"))
    b = b.withColumn("_key", F.struct(F.col("exception_status").alias("s"), F.col("exception_reason").alias("r")))
    rows = a.select(*columns, "_key", "seq").unionByName(b.select(*columns, "_key", "seq"))
    order = Window.partitionBy("statement_id", "section").orderBy("_key", F.col("invoice_number").asc_nulls_first(), "seq")
    return rows.withColumn("place", F.row_number().over(order)).select("place", *columns)


def report_sections(summaries: DataFrame, matched: DataFrame, exceptions: DataFrame, log: DataFrame) -> DataFrame:
    """Every statement's whole report as one dataset: summary, intake, matched, exception and audit rows by section and place.

    ``log``: kind, statement_id, detail, ts. The newest intake event is the intake row, all other events are the audit section.
    """
    rows = report_rows(matched, exceptions).select("statement_id", "section", "place", F.concat_ws("|", "invoice_number", "detail").alias("text"))
    summary = summaries.select("statement_id", F.lit("summary").alias("section"), F.lit(1).alias("place"), F.concat_ws("|", "overall_status", "matched_count", "exception_count").alias("text"))
    intake = log.where("kind = 'INTAKE'").groupBy("statement_id").agg(F.max_by("detail", F.struct("ts", "detail")).alias("text"))
    intake = intake.select("statement_id", F.lit("intake").alias("section"), F.lit(1).alias("place"), "text")
    order = Window.partitionBy("statement_id").orderBy("ts", "kind", "detail")
    audit = log.where("kind <> 'INTAKE'").select("statement_id", F.lit("audit").alias("section"), F.row_number().over(order).alias("place"), F.concat_ws("|", "kind", "detail").alias("text"))
    return summary.unionByName(intake).unionByName(rows).unionByName(audit)


def review_files(review: DataFrame) -> DataFrame:
    """Files with pending review rows, their number and their categories; rows without a file are one group."""
    counts = review.where("review_status = 'PENDING_REVIEW'").groupBy("source_file", "rejection_category").agg(F.count("*").alias("n"))
    return counts.groupBy("source_file").agg(
        F.sum("n").alias("pending_count"),
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "rejection_category", "n"))), ",").alias("category_breakdown"),
    )


def review_vendors(review: DataFrame, group: str) -> DataFrame:
    """Pending review rows by group and category."""
    return review.where("review_status = 'PENDING_REVIEW'").groupBy(group, "rejection_category").agg(F.count("*").alias("n"))
