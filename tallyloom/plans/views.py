"""The datasets that queries share, built once per query from the fixture sources."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import gold, matching, medallion, quality, reports
from tallyloom.sources import fixtures
from tallyloom.sources.tables import settle


def now() -> Column:
    """The fixed time that ages are counted to."""
    return F.lit("2002-01-01 00:00:00").cast("timestamp")


class Views:
    """Lazy DataFrames over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def lines(self) -> DataFrame:
        return fixtures.statement_lines(self.spark, self.sf_dir)

    @cached_property
    def ledger(self) -> DataFrame:
        return fixtures.ledger_rows(self.spark, self.sf_dir)

    @cached_property
    def raw(self) -> DataFrame:
        return fixtures.extracted_rows(self.spark, self.sf_dir)

    @cached_property
    def jobs(self) -> DataFrame:
        return fixtures.jobs(self.spark, self.sf_dir)

    @cached_property
    def routed(self) -> DataFrame:
        return quality.route(self.raw)

    @cached_property
    def review(self) -> DataFrame:
        return quality.review_queue(self.routed)

    @cached_property
    def bronze(self) -> DataFrame:
        return medallion.bronze_rows(self.routed.where("route = 'VALID'"))

    @cached_property
    def silver(self) -> DataFrame:
        return medallion.silver_statement(self.bronze)

    @cached_property
    def decisions(self) -> DataFrame:
        """The matcher writes them once, as summaries and exceptions both build on them."""
        return matching.match(self.lines, self.ledger)

    @cached_property
    def silver_decisions(self) -> DataFrame:
        """The matcher over what intake let through: extracted rows, routed, Bronze, Silver."""
        return matching.match(self.silver, self.ledger)

    @cached_property
    def matched(self) -> DataFrame:
        return gold.matched_invoices(self.decisions)

    @cached_property
    def all_summaries(self) -> DataFrame:
        start = F.to_timestamp(F.concat("statement_period", F.lit("-01")))
        tied = F.split_part("statement_id", F.lit("-"), F.lit(2)).cast("int") % 5 == 0
        return gold.summaries(self.decisions).withColumn("run_ts", F.when(tied, F.date_trunc("quarter", start)).otherwise(start))

    @cached_property
    def summaries(self) -> DataFrame:
        """Runs that reached a summary: all but those of June."""
        return self.all_summaries.where(~F.col("statement_id").endswith("06"))

    @cached_property
    def raised(self) -> DataFrame:
        """Written once, as exceptions and their events all build on it."""
        columns = ["exception_id", "statement_id", "vendor_id", "seq", "invoice_number", "statement_amount", "erp_amount",
                   "exception_reason", "match_confidence"]
        skipped = gold.skip_exceptions(quality.skipped(self.raw)).withColumn("erp_amount", F.lit(None).cast("decimal(18,2)"))
        both = gold.match_exceptions(self.decisions).select(*columns).unionByName(skipped.select(*columns))
        month = F.right("statement_id", F.lit(6))
        start = F.unix_timestamp(F.concat(month, F.lit("01")), "yyyyMMdd")
        both = both.withColumn(
            "source_file", F.when(F.col("seq") % 97 != 0, F.concat(F.lower("vendor_id"), F.lit("_"), month, F.lit(".pdf")))
        ).withColumn("date_raised", F.timestamp_seconds(start + (F.col("seq") % 40) * 3600))
        return settle(both, "raised")

    @cached_property
    def exceptions(self) -> DataFrame:
        day = F.expr("interval 1 day")
        first = self.raised.where("seq % 7 = 0").select(
            "exception_id", F.lit("DISPUTED").alias("disposition_status"), (F.col("date_raised") + day).alias("ts"), F.lit(0).alias("event_seq")
        )
        second = self.raised.where("seq % 14 = 0").select(
            "exception_id", F.lit("ACCEPTED").alias("disposition_status"), (F.col("date_raised") + day + day).alias("ts"), F.lit(1).alias("event_seq")
        )
        up = self.raised.where("seq % 11 = 0").select("exception_id", (F.col("date_raised") + day).alias("ts"), F.lit(0).alias("event_seq"))
        return gold.current_state(self.raised, first.unionByName(second), up)

    @cached_property
    def latest(self) -> DataFrame:
        return reports.latest_runs(self.summaries)
