"""Secret scan with character Markov models (DataFrame operations only).

Three base patterns find assignments, access keys and long hex strings. Two
first-order Markov chains over the characters of identifiers then judge the other
long runs of such characters that hold a letter and a digit: one is trained on labelled random strings, one on
labelled ordinary identifiers, and a run whose log-likelihood ratio is above
``THRESHOLD`` is a secret too (kind ``random``). Samples are labelled by the base
patterns: what they find in all texts is random if it holds a letter and a digit; runs of at
least ``SAMPLE_LENGTH`` characters in the rest of about ``ORDINARY_DOCS`` texts, chosen
by hash, are ordinary unless a letter stands beside a digit.

A span's place follows from the lengths of the texts between matches, summed in
blocks of about the square root of their number, so a row with very many matches
stays near linear. Scoring and search stay in the row; training shuffles one row for
each pair of characters and task. Ratios are whole thousandths of a nat, so sums do
not depend on their order. The table of ratios has a fixed number of cells.

Defined cases: a null text is empty and has no spans; null ids, repeated rows and
rows that share an id are kept, one result row each; spans of different base kinds
may overlap, and added ones lie in what assignments, then access keys, then hex
strings leave; without samples of a class its chain is uniform; a very long text is
scanned whole in its row; an empty table gives an empty result; other columns, also
of clashing names, pass through ``scan`` untouched.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import settle, table, text_of

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")

#: The base patterns; a value's, a key's and a hex string's least length.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
VALUE_LENGTH = 8
#: Lower-case words one of which every assignment holds.
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")

SYMBOLS = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/_=-"
_CLASS = "[A-Za-z0-9+/_=-]"
#: Shortest run that is judged, and shortest run that teaches what is ordinary.
RUN_LENGTH, SAMPLE_LENGTH = 16, 8
#: What an unlabelled secret holds, so that it does not teach what is ordinary: a letter beside a digit.
_ADJACENT = "[A-Za-z][0-9]|[0-9][A-Za-z]"
#: Pseudo-count of each pair of characters, and the log-likelihood ratio from which a run is random, in nats.
SMOOTHING, THRESHOLD = 1.0, 12.0
_SCALE = 1000
#: Texts whose runs teach what is ordinary (expected number where the table has more); random samples come from all texts.
ORDINARY_DOCS = 10_000
_RUNS, _SAMPLES = f"{_CLASS}{{{RUN_LENGTH},}}", f"{_CLASS}{{{SAMPLE_LENGTH},}}"


def _once(value: Column) -> Column:
    """``value``, computed where it stands: the optimizer copies no expression that numbers rows into filters and later columns."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _none() -> Column:
    return F.array().cast("array<string>")


def _holds(text: Column, kind: str) -> Column:
    """Whether a base kind matches anywhere; plain substrings rule out most texts before the pattern is tried."""
    if kind == "hex":
        return text.rlike(HEX)
    if kind == "access":
        return text.contains("AKIA") & text.rlike(ACCESS)
    low, named = F.lower(text), F.lit(False)
    for cue in CUES:
        named = named | low.contains(cue)
    return named & text.rlike(ASSIGN)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def _placed(df: DataFrame, hits: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with the places of matches in the columns ``hits`` (name: text column and pattern) as array<struct<start, end, value>>.

    Each step is a column of its own: a lambda that held the step's expression would
    compute it again for every match.
    """
    none = F.array().cast("array<int>")

    def width(h: str) -> Column:
        return F.ceil(F.sqrt(F.size(f"{h}_steps"))).cast("int")

    def gaps(h: str) -> Column:
        text, pattern = hits[h]
        return F.when(F.size(h) > 0, F.transform(F.slice(F.split(text, pattern), F.lit(1), F.size(h)), F.length)).otherwise(none)

    def blocks(h: str) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(f"{h}_steps") - 1) / width(h)).cast("int"))
        sums = F.transform(numbers, lambda b: _total(F.slice(f"{h}_steps", b * width(h) + 1, width(h))))
        return F.when(F.size(f"{h}_steps") > 0, sums).otherwise(none)

    def starts(h: str) -> Column:
        def start(gap: Column, k: Column) -> Column:
            whole = _total(F.slice(f"{h}_blocks", F.lit(1), F.floor(k / width(h)).cast("int")))
            return gap + whole + _total(F.slice(f"{h}_steps", k - k % width(h) + 1, k % width(h)))

        return F.when(F.size(f"{h}_blocks") > 0, F.transform(f"{h}_gaps", start)).otherwise(none)

    def spans(h: str) -> Column:
        return F.zip_with(f"{h}_starts", h, lambda s, x: F.struct(s.alias("start"), (s + F.length(x)).alias("end"), x.alias("value")))

    df = df.select("*", *[_once(gaps(h)).alias(f"{h}_gaps") for h in hits])
    df = df.select("*", *[_once(F.zip_with(f"{h}_gaps", h, lambda g, x: g + F.length(x))).alias(f"{h}_steps") for h in hits])
    df = df.select("*", *[_once(blocks(h)).alias(f"{h}_blocks") for h in hits])
    df = df.select("*", *[_once(starts(h)).alias(f"{h}_starts") for h in hits])
    return df.withColumns({h: _once(spans(h)) for h in hits})


def _assigned(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 1)


def _long_enough(match: Column) -> Column:
    return F.length(_assigned(match)) >= VALUE_LENGTH


def _mixed(value: Column) -> Column:
    """Holds a letter and a digit, as random strings of some length do."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def _blanked(text: Column, pattern: str, wanted=None) -> Column:
    """``text`` with the wanted matches as blanks of the same length."""

    def blank(h: Column) -> Column:
        blanks = F.repeat(F.lit(" "), F.length(h))
        return blanks if wanted is None else F.when(wanted(h), blanks).otherwise(h)

    parts = F.zip_with(F.split(text, pattern), _matches(text, pattern), lambda g, h: F.concat(g, F.coalesce(blank(h), F.lit(""))))
    return F.array_join(parts, "")


_PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}


def _searched(df: DataFrame, text: str, mark: str) -> DataFrame:
    """``df`` with the matches of each base kind in ``text`` and with what they leave of it (``{mark}_rest``)."""
    df = df.withColumns({f"{mark}_has_{k}": _once(_holds(F.col(text), k)) for k in BASE_KINDS})
    df = df.withColumns({f"{mark}_{k}": _once(F.when(F.col(f"{mark}_has_{k}"), _matches(F.col(text), p)).otherwise(_none())) for k, p in _PATTERNS.items()})
    rest = F.col(text)
    for k, p in _PATTERNS.items():
        df = df.withColumn(f"{mark}_rest", _once(F.when(F.col(f"{mark}_has_{k}"), _blanked(rest, p, _long_enough if k == "assign" else None)).otherwise(rest)))
        rest = F.col(f"{mark}_rest")
    return df


def _sampled(docs: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """About ``limit`` of the texts, by a hash of id and text; all of them if there are no more. Equal rows count once."""
    n = docs.count()
    rows = docs.select(text_of(text_col).alias("t"), F.xxhash64(id_col, text_col).alias("h"))
    if n > limit:
        rows = rows.where(F.pmod("h", F.lit(1 << 30)) < (limit << 30) // n).dropDuplicates(["h"])
    return rows.select("t")


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ordinary_docs: int = ORDINARY_DOCS) -> DataFrame:
    """(value, label) as the base patterns label them: 1 random, from all texts; 0 ordinary, from about ``ordinary_docs`` texts."""
    found = _searched(docs.select(text_of(text_col).alias("t")), "t", "x")
    assigned = F.transform(F.filter("x_assign", _long_enough), _assigned)
    random = found.select(F.explode(F.concat(assigned, "x_access", "x_hex")).alias("value"), F.lit(1).alias("label"))
    rest = _searched(_sampled(docs, id_col, text_col, ordinary_docs), "t", "x").select("x_rest")
    ordinary = rest.select(F.explode(_matches(F.col("x_rest"), _SAMPLES)).alias("value"), F.lit(0).alias("label")).where(~F.col("value").rlike(_ADJACENT))
    return random.where(_mixed(F.col("value"))).unionByName(ordinary)


def _codes(value: Column) -> Column:
    """Numbers of a run's characters among ``SYMBOLS``; other characters (a point in an assigned value) have none and count as the last."""
    by_ascii = F.lit([SYMBOLS.find(chr(k)) if chr(k) in SYMBOLS else len(SYMBOLS) - 1 for k in range(128)])
    return F.transform(F.slice(F.split(value, ""), F.lit(1), F.length(value)), lambda c: F.coalesce(F.get(by_ascii, F.ascii(c)), F.lit(len(SYMBOLS) - 1)))


def _pairs(codes: Column) -> Column:
    """Cells of the pairs of neighbours."""
    return F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes)), lambda a, b: a * len(SYMBOLS) + b)


def train(labelled: DataFrame) -> DataFrame:
    """One row with ``ratios``: for each pair of characters the log-likelihood ratio, in whole thousandths of a nat.

    ``labelled``: value, label. Counts are folded before they are shuffled.
    """
    k = len(SYMBOLS)
    coded = labelled.where(F.length("value") > 1).withColumn("codes", _once(_codes(F.col("value"))))
    cells = coded.select("label", F.explode(_pairs(F.col("codes"))).alias("cell"))
    counts = settle(cells.groupBy("cell").agg(F.count_if(F.col("label") == 1).alias("random"), F.count_if(F.col("label") == 0).alias("ordinary")), "pair-counts")
    grid = labelled.sparkSession.range(k * k).select(F.col("id").cast("int").alias("cell")).join(counts, "cell", "left").fillna(0)
    row = grid.groupBy(F.floor(F.col("cell") / k).cast("int").alias("first")).agg(F.sum("random").alias("all_random"), F.sum("ordinary").alias("all_ordinary"))
    chance = grid.withColumn("first", F.floor(F.col("cell") / k).cast("int")).join(row, "first")

    def of(name: str) -> Column:
        return (F.col(name) + SMOOTHING) / (F.col(f"all_{name}") + SMOOTHING * k)

    ratio = chance.select("cell", F.round(F.log(of("random") / of("ordinary")) * _SCALE).cast("long").alias("ratio"))
    ordered = F.sort_array(F.collect_list(F.struct("cell", "ratio")))  # a fixed number of cells
    return ratio.agg(F.transform(ordered, lambda x: x["ratio"]).alias("ratios"))


def _score(value: Column, ratios: Column) -> Column:
    return F.aggregate(_pairs(_codes(value)), F.lit(0).cast("long"), lambda acc, cell: acc + F.get(ratios, cell))


def _ranked(found: Column, rank: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), rank, x["end"].alias("end"), x["value"].alias("value")))


_SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def scan(docs: DataFrame, model: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, str]:
    """``docs`` and the name of an added column: spans (start, rank, end, value) by start and then kind (``KINDS[rank]``).

    ``model``: the one row of ``train``.
    """
    mark = next(m for m in ("secrets", *(f"secrets{k}" for k in range(99))) if not any(c.lower().startswith(m) for c in docs.columns))
    text, rest, hits = f"{mark}_text", f"{mark}_rest", [f"{mark}_{kind}" for kind in KINDS]
    df = docs.withColumn(text, text_of(text_col)).crossJoin(F.broadcast(model.select(F.col("ratios").alias(f"{mark}_ratios"))))  # one row
    df = _searched(df, text, mark)
    df = df.withColumn(hits[-1], _once(F.when(F.col(rest).rlike(_RUNS), _matches(F.col(rest), _RUNS)).otherwise(_none())))
    df = _placed(df, {**{f"{mark}_{k}": (text, p) for k, p in _PATTERNS.items()}, hits[-1]: (rest, _RUNS)})
    tests = {"assign": lambda x: _long_enough(x["value"]), "random": lambda x: _mixed(x["value"]) & (_score(x["value"], F.col(f"{mark}_ratios")) > round(threshold * _SCALE))}
    kept = []
    for kind, h in zip(KINDS, hits, strict=True):
        rank = F.lit(KINDS.index(kind)).alias("rank")
        found = F.filter(h, tests[kind]) if kind in tests else F.col(h)
        kept.append(_ranked(found, rank))
    return df.select(*docs.columns, _once(F.sort_array(F.concat(*kept)).cast(_SPAN)).alias(mark)), mark


def spelled(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _number(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("long")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, spans = scan(docs, train(samples(docs)))
    base = F.filter(spans, lambda s: s["rank"] < len(BASE_KINDS))
    return found.select(
        "doc_id", *[_number(spans, kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col(spans)).alias("spans"),
        _number(spans, "random").alias("n_random"),
    )


def _sql_hits(pattern: str) -> str:
    return f"regexp_extract_all(t, $${pattern}$$)"


def _sql_blank(pattern: str, wanted: str) -> str:
    """The text with the wanted matches as blanks."""
    gaps = f"string_split_regex(t, $${pattern}$$)"
    return (f"list_reduce(list_transform(list_zip({gaps}, {_sql_hits(pattern)}), "
            f"lambda z: z[1] || CASE WHEN z[2] IS NULL THEN '' WHEN {wanted} THEN repeat(' ', length(z[2])) ELSE z[2] END), lambda a, b: a || b)")


def _sql_place(kind: str, pattern: str, source: str) -> str:
    return f"""SELECT rid, '{kind}' AS kind, {KINDS.index(kind)} AS rank, value, sum(length(gap) + length(value)) OVER (PARTITION BY rid ORDER BY k) - length(value) AS a FROM
      (SELECT rid, unnest(hits) AS value, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS k FROM
        (SELECT rid, {_sql_hits(pattern)} AS hits, string_split_regex(t, $${pattern}$$) AS gaps FROM {source}))"""


_SQL_PAIR = f"""SELECT label, coalesce(nullif(strpos('{SYMBOLS}', value[i]), 0), {len(SYMBOLS)}) - 1 AS a, coalesce(nullif(strpos('{SYMBOLS}', value[i + 1]), 0), {len(SYMBOLS)}) - 1 AS b
  FROM (SELECT label, value, unnest(range(1, length(value))) AS i FROM s)"""
_SQL_ASSIGNED = f"regexp_extract(value, $${ASSIGN}$$, 1)"
#: For tables of at most ``ORDINARY_DOCS`` rows, which all teach.
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
r1 AS (SELECT rid, {_sql_blank(ASSIGN, f"length(regexp_extract(z[2], $${ASSIGN}$$, 1)) >= {VALUE_LENGTH}")} AS t FROM d),
r2 AS (SELECT rid, {_sql_blank(ACCESS, 'true')} AS t FROM r1),
rest AS MATERIALIZED (SELECT rid, {_sql_blank(HEX, 'true')} AS t FROM r2),
base AS MATERIALIZED (SELECT * FROM ({_sql_place('assign', ASSIGN, 'd')}) WHERE length({_SQL_ASSIGNED}) >= {VALUE_LENGTH}
  UNION ALL {_sql_place('access', ACCESS, 'd')} UNION ALL {_sql_place('hex', HEX, 'd')}),
s AS (SELECT 1 AS label, value FROM (SELECT CASE kind WHEN 'assign' THEN {_SQL_ASSIGNED} ELSE value END AS value FROM base)
      WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
      UNION ALL SELECT 0, value FROM (SELECT unnest({_sql_hits(_SAMPLES)}) AS value FROM rest) WHERE NOT regexp_matches(value, '{_ADJACENT}')),
c AS (SELECT a, b, count(*) FILTER (label = 1) AS r, count(*) FILTER (label = 0) AS o FROM ({_SQL_PAIR}) GROUP BY a, b),
g AS (SELECT x.a, y.b, coalesce(r, 0) AS r, coalesce(o, 0) AS o FROM (SELECT unnest(range({len(SYMBOLS)})) AS a) x, (SELECT unnest(range({len(SYMBOLS)})) AS b) y LEFT JOIN c ON c.a = x.a AND c.b = y.b),
m AS MATERIALIZED (SELECT a, b, CAST(round(ln(((r + {SMOOTHING}) / (sum(r) OVER w + {SMOOTHING * len(SYMBOLS)})) / ((o + {SMOOTHING}) / (sum(o) OVER w + {SMOOTHING * len(SYMBOLS)}))) * {_SCALE}) AS BIGINT) AS ratio
      FROM g WINDOW w AS (PARTITION BY a)),
u AS (SELECT * FROM ({_sql_place('random', _RUNS, 'rest')}) WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')),
v AS (SELECT rid, a AS place, unnest(range(1, length(value))) AS i, value FROM u),
k AS (SELECT rid, place, sum(ratio) AS score FROM v JOIN m ON m.a = strpos('{SYMBOLS}', value[i]) - 1 AND m.b = strpos('{SYMBOLS}', value[i + 1]) - 1 GROUP BY rid, place),
spans AS (SELECT rid, kind, rank, a, a + length(value) AS z FROM base
          UNION ALL SELECT u.rid, kind, rank, a, a + length(value) FROM u JOIN k ON k.rid = u.rid AND k.place = u.a WHERE score > {round(THRESHOLD * _SCALE)}),
j AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, count(*) FILTER (rank = 3) AS n_random,
             string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) FILTER (rank < 3) AS b, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) AS spans FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_random, 0) AS n_random FROM d LEFT JOIN j USING (rid)"""

QUERIES = {"op13_secret_scan": op13_secret_scan}
ORACLES = {"op13_secret_scan": SQL}
