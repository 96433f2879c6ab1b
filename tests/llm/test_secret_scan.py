"""Secret scan against a plain version, SQL, and strings that should or should not be found."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from compare import of_duck, of_spark
from tallyloom.llm import secret_scan as ss

SCHEMA = "doc_id long, text string, lang string, SECRETS string, secrets0_text string, t string"
#: The base patterns as the contract states them.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
SYMBOLS = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/_=-"
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")


def base(text):
    out = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= 32]


def blanked(text):
    for pattern, least in ((ASSIGN, lambda m: len(m[2]) >= 8), (ACCESS, lambda m: len(m[0]) >= 16), (HEX, lambda m: len(m[0]) >= 32)):
        text = pattern.sub(lambda m, least=least: " " * len(m[0]) if least(m) else m[0], text)
    return text


def mixed(value):
    return bool(re.search("[0-9]", value) and re.search("[A-Za-z]", value))


def pairs(value):
    codes = [SYMBOLS.find(c) if c in SYMBOLS else 66 for c in value]
    return list(zip(codes, codes[1:], strict=False))


def ratios(texts):
    counts = Counter(), Counter()
    for text in texts:
        for *_, value in base(text):
            if mixed(value):
                counts[1].update(pairs(value))
        for m in RUN.finditer(blanked(text)):
            if len(m[0]) >= 8 and not re.search("[A-Za-z][0-9]|[0-9][A-Za-z]", m[0]):
                counts[0].update(pairs(m[0]))
    rows = [Counter(), Counter()]
    for label in (0, 1):
        for (a, _), n in counts[label].items():
            rows[label][a] += n

    def p(label, a, b):
        return (counts[label][a, b] + 1) / (rows[label][a] + 67)

    return {(a, b): round(math.log(p(1, a, b) / p(0, a, b)) * 1000) for a in range(67) for b in range(67)}


def plain(texts, model=None):
    texts = [t or "" for t in texts]
    table = model or ratios(texts)
    out = []
    for text in texts:
        spans = [s[:3] for s in base(text)]
        for m in RUN.finditer(blanked(text)):
            if len(m[0]) >= 16 and mixed(m[0]) and sum(table[c] for c in pairs(m[0])) > 12_000:
                spans.append(("random", m.start(), m.end()))
        spans.sort(key=lambda s: (s[1], ss.KINDS.index(s[0]), s[2]))
        out.append(spans)
    return out


def spelled(spans):
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def random_key(rng, n=40, alphabet=string.ascii_letters + string.digits):
    return "".join(rng.choice(alphabet) for _ in range(n))


RNG = random.Random(13)
WORDS = "the quick brown fox jumps over fence_posts getUserName reconciliation statement-line invoiceNumber identifier_of_document documentation".split()
TEXTS = [
    None, "", " \n\t", "password=short token=secret:abcdefghij", 'PassWord" :  "Abcdefgh1" tail', "api_key='x' apikey:abcdefgh API_KEY = abc.def/ghi", "token==abcdefgh token: =b",
    "AKIA1 AKIAAKIA12345 AKIAABCDEFGHIJKL AKIAABCDEFGHIJKLabc", "0123456789abcdef0123456789abcde", "0123456789abcdef0123456789abcdef", "x0123456789abcdef0123456789abcdefABC",
    "é😀 secret: 0123456789abcdef0123456789abcdef 日本 token='Zm9vYmFyYmF6'", "0123456789abcdef0123456789abcdeapi_key=0123456789", "passwordpassword=abcdefgh=", "ſecret=abcdefgh Key toKen=abcdefgh",
    "1234567890123456789012 2024-01-02-03-04-05-06", "a" * 3_000 + "1", " token=abcdefgh" * 3_000, "token=a " * 500, "word " * 30_000 + "token=abcdefgh",
] + [f"{' '.join(RNG.choices(WORDS, k=60))} token = {random_key(RNG)} {' '.join(RNG.choices(WORDS, k=30))}" for _ in range(60)]
STRAY = [random_key(random.Random(k), 24 + k % 30) for k in range(40)]
TEXTS += [f"{' '.join(RNG.choices(WORDS, k=20))} {key} {' '.join(RNG.choices(WORDS, k=5))}" for key in STRAY] + ["same 0123456789abcdef0123456789abcdef"] * 5


@pytest.fixture(scope="module")
def awkward(spark):
    ids = [None if k % 11 == 3 else k // 2 for k in range(len(TEXTS))]
    return spark.createDataFrame([(i, t, "en", str(k), "x", "y") for k, (i, t) in enumerate(zip(ids, TEXTS, strict=True))], SCHEMA).repartition(5)


def test_spans_equal_a_plain_version(awkward):
    found, name = ss.scan(awkward, ss.train(ss.samples(awkward)))
    assert found.columns == [*awkward.columns, "secrets1"] and name == "secrets1"
    rows = found.select(F.col("SECRETS").cast("int").alias("k"), ss.spelled(F.col(name)).alias("s"), "text", F.transform(name, lambda x: x["value"]).alias("v"), name).collect()
    assert {r["k"]: r["s"] for r in rows} == {k: spelled(s) for k, s in enumerate(plain(TEXTS))}
    for r in rows:
        assert all(r["text"][x["start"] : x["end"]] == x["value"] for x in r[name])


def test_random_strings_are_found_and_identifiers_are_not(awkward):
    found, name = ss.scan(awkward, ss.train(ss.samples(awkward)))
    values = {x["value"] for r in found.select(name).collect() for x in r[0] if ss.KINDS[x["rank"]] == "random"}
    assert len(values & set(STRAY)) >= 0.9 * len(STRAY)
    assert not any(w in v for v in values - set(STRAY) for w in WORDS)


def test_empty_tables_and_models(spark, awkward):
    empty = spark.createDataFrame([], SCHEMA)
    model = ss.train(ss.samples(empty))
    assert len(model.first()["ratios"]) == 67 * 67 and set(model.first()["ratios"]) == {0}
    assert ss.scan(empty, model)[0].count() == 0
    assert ss.scan(awkward, model)[0].where(F.exists("secrets1", lambda x: x["rank"] == 3)).count() == 0


def test_labelled_samples_of_ones_own(spark):
    rng = random.Random(2)
    labelled = [(random_key(rng, 32), 1) for _ in range(200)] + [(w, 0) for w in WORDS * 50] + [("release-2024-build-17_final", 0)] * 50
    model = ss.train(spark.createDataFrame(labelled, "value string, label int"))
    docs = spark.createDataFrame([(1, f"release-2024-build-17_final {random_key(rng, 40)} identifier_of_document")], "doc_id long, text string")
    spans = ss.scan(docs, model, threshold=5.0)[0].first()["secrets"]
    assert [(x["rank"], x["start"], x["end"]) for x in spans] == [(3, 28, 68)]


def test_sampled_texts_are_bounded_and_random_samples_are_not(spark):
    docs = spark.createDataFrame([(k, f"identifier_{k} token=Abcdefgh{k}") for k in range(2_000)] + [(9_999, "identifiercopy")] * 1_000, "doc_id long, text string")
    by_label = dict(ss.samples(docs, ordinary_docs=300).groupBy("label").count().collect())
    assert by_label[1] == 2_000 and 100 < by_label[0] < 500


def test_places_of_many_matches(spark):
    texts = [" ".join("ab"[: 1 + (k * 7) % 2] + "x" * (k % 5) for k in range(n)) for n in (0, 1, 2, 3, 4, 5, 9, 10, 17, 100, 5_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("h", ss._matches(F.col("t"), "x+"))
    for r in ss._placed(df, {"h": ("t", "x+")}).select("t", "h").collect():
        assert [(x["start"], x["end"], x["value"]) for x in r["h"]] == [(m.start(), m.end(), m[0]) for m in re.finditer("x+", r["t"])]


def test_query_equals_sql_and_the_plain_version(spark, sf_dir, duck):
    found = ss.op13_secret_scan(spark, sf_dir)
    rows = {r["doc_id"]: r for r in found.collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for (i, _), spans in zip(texts.items(), plain(texts.values()), strict=True):
        only = spelled([s for s in spans if s[0] != "random"])
        counts = Counter(s[0] for s in spans)
        assert rows[i]["spans"] == spelled(spans) and rows[i]["base_sha256"] == hashlib.sha256(only.encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in ss.KINDS] == [counts[k] for k in ss.KINDS]
    assert of_spark(found) == of_duck(duck, ss.SQL)


def test_no_python_on_the_main_path(spark, sf_dir):
    plan = ss.op13_secret_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
