"""Quality rules with host verdicts (DataFrame operations only).

Each document gets word, symbol and repetition statistics and is held against a
few rules. Failures of each rule are then counted per host, the host's failure
rate is shrunk towards the corpus by a beta prior fitted to all hosts, rule by
rule, and the verdict on the host is joined back to its documents. A host is
rejected if one of its shrunk rates is above ``HOST_LIMIT``, or above
``HOST_LEAST`` and ``HOST_TIMES`` as high as the corpus rate. Hosts that do not
differ beyond chance all get the corpus rate, so none of them is rejected alone.

A host may hold any share of the rows: counts are folded before they are
shuffled, and the join back deals every host over ``SALTS`` tasks.

Defined cases: a null or empty text has no words and fails the base rules, a
null host is the host "", a very long text stays in its row, an empty table gives
an empty result, repeated rows are judged one by one. Extra columns, also of
clashing names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import SPACE_CLASS, settle, table, text_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Symbols per hundred words, and repeated lines per hundred lines, that fail a document at host level.
MAX_SYMBOL_PERCENT = 25
MAX_DUP_LINE_PERCENT = 30
#: Shrunken failure rate above which a host is rejected.
HOST_LIMIT = 0.6
#: A shrunken rate from which a host is rejected if it is so many times the corpus rate.
HOST_LEAST, HOST_TIMES = 0.2, 3.0
#: Tasks that one host's documents are dealt to when verdicts are joined back.
SALTS = 32
#: Weight of the prior, in documents, where the hosts' rates do not differ beyond chance.
STRONG_PRIOR = 1e6

_SYMBOLS = "#*$%&|<>"


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    Windows of three words are compared by a 64-bit hash inside one text. A text
    without a repeated window stops after one sort of longs; only the others sort
    (hash, position) pairs. Everything stays in the row: nothing is exploded.
    """
    text = text_of(text_col)
    base = docs.withColumn("_text", text).withColumn(
        "_words", F.filter(F.split("_text", f"{SPACE_CLASS}+"), lambda w: w != "")
    )
    base = base.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    base = base.select(
        *docs.columns,
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", f"{SPACE_CLASS}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", f"[^{_SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    starts = F.when(F.size("_words") >= 3, F.sequence(F.lit(0), F.size("_words") - 3)).otherwise(
        F.array().cast("array<int>")
    )
    hashed = F.transform(
        starts, lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    )
    base = base.withColumn("_hashes", hashed).drop("_words").withColumn("_sorted", F.sort_array("_hashes"))
    base = base.withColumn(
        "_twice", F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_sorted") - 1)),
                           lambda i: F.get("_sorted", i) == F.get("_sorted", i - 1))
    )
    pairs = F.when(
        F.coalesce("_twice", F.lit(False)),
        F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    base = base.withColumn("_pairs", pairs).drop("_hashes", "_sorted", "_twice")
    repeated = F.filter(
        "_pairs",
        lambda p, i: F.coalesce(F.get("_pairs", i - 1)["h"] == p["h"], F.lit(False))
        | F.coalesce(F.get("_pairs", i + 1)["h"] == p["h"], F.lit(False)),
    )
    covered = F.flatten(F.transform(repeated, lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2)))
    return base.withColumn(
        "n_repeat_words", F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long")
    ).drop("_pairs")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rules() -> dict[str, Column]:
    """The rules that a document can fail, each counted by host."""
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeat": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
        "symbol": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words"),
        "line": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"),
    }


def host_verdicts(judged: DataFrame, names: list[str], host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per ``host`` of ``judged`` (host, a boolean for each of ``names``): shrunk rates and the verdict.

    Each rule's prior Beta(mean * weight, (1 - mean) * weight) is fitted by moments:
    the spread of the hosts' rates, less what chance alone explains, gives the weight.
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in names])
    overall = hosts.agg(
        F.sum("n").alias("total"), F.count("*").alias("hosts"),
        *[c for r in names for c in (
            (F.sum(r) / F.sum("n")).alias(f"{r}_mean"), F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_squares"))],
    )
    priors = []
    for r in names:
        mean = F.col(f"{r}_mean")
        chance, spread = mean * (1 - mean), F.col(f"{r}_squares") / F.col("total") - mean * mean
        excess = spread - chance * F.col("hosts") / F.col("total")
        weight = F.when(excess > 0, F.least(F.lit(STRONG_PRIOR), F.greatest(F.lit(1.0), (chance - spread) / excess)))
        priors += [mean, F.coalesce(weight, F.lit(STRONG_PRIOR)).alias(f"{r}_weight")]
    joined = hosts.crossJoin(F.broadcast(overall.select(*priors)))  # one row
    rates = {r: (F.col(r) + F.col(f"{r}_mean") * F.col(f"{r}_weight")) / (F.col("n") + F.col(f"{r}_weight")) for r in names}
    failed = F.lit(False)
    for r, rate in rates.items():
        failed = failed | (rate > host_limit) | ((rate > HOST_LEAST) & (rate > HOST_TIMES * F.col(f"{r}_mean")))
    return joined.select("host", *[F.round(rate, 6).alias(f"{r}_rate") for r, rate in rates.items()], failed.alias("host_failed"))


def judge(
    docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
    host_limit: float = HOST_LIMIT,
) -> DataFrame:
    """Statistics, base verdict, the host's shrunk rates and verdict, and ``kept`` of every document."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col), F.lit("")).alias("host"),
        F.col(text_col).alias("text"),
    )
    named = rules()
    stats = text_statistics(rows).drop("text").withColumn("base_failed", base_failed())
    stats = settle(stats.withColumns(named).withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))), "hosts")
    verdicts = settle(host_verdicts(stats, list(named), host_limit), "verdicts")
    salted = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
    return stats.join(salted, ["host", "salt"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"),
        "host", *[f"{r}_rate" for r in named], "host_failed",
    )


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


_SPLIT = r"'[\x20\x09-\x0D]+'"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text
           FROM documents),
w0 AS (SELECT rid, list_filter(string_split_regex(text, {_SPLIT}), lambda x: x <> '') AS words FROM d),
w AS (SELECT rid, generate_subscripts(words, 1) AS pos, unnest(words) AS word FROM w0),
g AS (SELECT rid, pos, [word, lead(word) OVER o, lead(word, 2) OVER o] AS win, lead(word, 2) OVER o AS third
      FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
t AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, win) AS c FROM g WHERE third IS NOT NULL),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT rid, unnest([pos, pos + 1, pos + 2]) AS p FROM t WHERE c > 1) GROUP BY rid),
l0 AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
s AS (
  SELECT d.rid, doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, {_SPLIT}, '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^{_SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w0 USING (rid) JOIN l0 USING (rid) LEFT JOIN rep USING (rid)),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s),
f AS (SELECT *, n_words < {MIN_WORDS} AS short, 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS repeat,
             100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words AS symbol, 100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines AS line FROM j),
u AS (SELECT host, rule, CAST(failed AS BIGINT) AS failed FROM f UNPIVOT (failed FOR rule IN (short, repeat, symbol, line))),
h AS (SELECT host, rule, count(*) AS n, sum(failed) AS bad FROM u GROUP BY host, rule),
m AS (SELECT rule, sum(n) AS total, count(*) AS hosts, sum(bad) / sum(n) AS mean, sum(bad * bad / n) AS squares FROM h GROUP BY rule),
v AS (SELECT rule, mean, mean * (1 - mean) AS chance, squares / total - mean * mean AS spread,
             squares / total - mean * mean - mean * (1 - mean) * hosts / total AS excess FROM m),
p AS (SELECT rule, mean, CASE WHEN excess > 0 THEN least({STRONG_PRIOR}, greatest(1.0, (chance - spread) / excess))
                              ELSE {STRONG_PRIOR} END AS weight FROM v),
s1 AS (SELECT host, rule, mean, (bad + mean * weight) / (n + weight) AS rate FROM h JOIN p USING (rule)),
verdict AS (SELECT host, {", ".join(f"max(round(rate, 6)) FILTER (rule = '{r}') AS {r}_rate" for r in ("short", "repeat", "symbol", "line"))},
                   bool_or(rate > {HOST_LIMIT} OR (rate > {HOST_LEAST} AND rate > {HOST_TIMES} * mean)) AS host_failed FROM s1 GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failed AS kept, host, short_rate, repeat_rate, symbol_rate, line_rate, host_failed
FROM f JOIN verdict USING (host)"""

QUERIES = {"op7_host_rules": op7_host_rules}
ORACLES = {"op7_host_rules": SQL}
