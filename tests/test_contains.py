"""The contains join against nested loops."""

from __future__ import annotations

import random

import numpy as np
from helpers import final_plan, plan
from pyspark.sql import functions as F

from noteflow.operators import contains, records
from noteflow.plans import driver_queries


def brute(texts, keys):
    return sorted({(t.lower(), k.lower()) for t in texts if t is not None for k in keys if k and k.lower() in t.lower()})


def frames(spark, texts, keys):
    return spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(k,) for k in keys], "key string")


def answers(df):
    return sorted(tuple(r) for r in df.select("text", "key").collect())


def test_against_nested_loops(spark):
    draw = random.Random(3)
    word = lambda n: "".join(draw.choice("abÄc ") for _ in range(n))
    texts = [word(draw.randint(0, 25)) for _ in range(300)]
    keys = [word(draw.randint(1, 7)) for _ in range(80)] + [texts[5], texts[5] + "z"]
    for gram in (1, 3, 6):
        assert answers(contains.contained_keys(*frames(spark, texts, keys), gram)) == brute(texts, keys)


def test_awkward_rows(spark):
    texts = [None, "", "a", "COPD exacerbation", "copd exacerbation", "x" * 50_000 + "copd"]
    keys = [None, "", "copd", "COPD", "a", "none of these", "exacerbation and more"]
    assert answers(contains.contained_keys(*frames(spark, texts, keys))) == brute(texts, keys)
    assert answers(contains.contained_keys(*frames(spark, texts, []))) == []
    assert answers(contains.contained_keys(*frames(spark, [], keys))) == []


def test_highest_rate_then_name_and_every_row_stays(spark):
    rows = spark.createDataFrame(
        [(1, "Acute Sepsis with COPD", "n"), (2, "sepsis", None), (3, None, None), (4, "fracture", "x"), (2, "sepsis", None)], "id int, diagnosis string, name string"
    )
    rates = spark.createDataFrame([("sepsis", 20), ("COPD", 22), ("Acute Sepsis", 22), ("sepsis", 3), ("fracture", None)], "dx_key string, rate_pct int")
    found = records.with_rate_from(rows, rates)
    assert sorted(map(tuple, found.select("id", "dx_key", "rate_pct", "name").collect()), key=repr) == sorted(
        [(1, "Acute Sepsis", 22, "n"), (2, "sepsis", 20, None), (2, "sepsis", 20, None), (3, None, None, None), (4, None, None, "x")], key=repr
    )


def test_table_of_the_fixed_rates_equals_the_chain(spark, sf_dir):
    from noteflow.functions import rules

    curated = driver_queries.curated(spark, sf_dir)
    rates = spark.createDataFrame(list(rules.READMISSION_RATES), "dx_key string, rate_pct int")
    columns = ["file_name", "dx_key", "rate_pct"]
    by_table = records.with_rate_from(curated, rates).select(columns)
    assert sorted(by_table.collect(), key=repr) == sorted(records.with_readmission_rate(curated).select(columns).collect(), key=repr)


def test_a_large_key_table_meets_no_nested_loop(spark):
    texts = spark.range(20_000).selectExpr("concat('patient PAT-', id * 7, ' ward ', id % 13) AS text")
    keys = spark.range(100_000).selectExpr("concat('PAT-', id + 100000) AS key")
    found = contains.contained_keys(texts, keys)
    assert "NestedLoop" not in plan(found) and "NestedLoop" not in final_plan(found) and "Cartesian" not in final_plan(found)
    numbers = {f"pat-{n}" for n in range(100_000, 200_000)}
    assert found.count() == sum(f"pat-{i * 7}"[: 4 + n] in numbers for i in range(20_000) for n in [6] if len(str(i * 7)) >= 6)


def test_nothing_that_grows_passes_through_the_driver(spark, monkeypatch):
    """Keys and texts made of a narrow column look small to the planner, which would send them to every executor."""
    frames_ = []
    keep = contains.written
    monkeypatch.setattr(contains, "written", lambda df, name: frames_.append(df) or keep(df, name))
    numbers = spark.range(30_000).select((F.col("id") * 3).alias("id"))
    rows = numbers.select("id", F.concat(F.lit("PAT-"), F.col("id") + 100_000, F.lit(" sepsis")).alias("diagnosis"))
    rates = numbers.select(F.concat(F.lit("PAT-"), F.col("id") * 2 + 100_000).alias("dx_key"), (F.col("id") % 31).cast("int").alias("rate_pct"))
    found = records.with_rate_from(rows, rates)
    assert all("Broadcast" not in final_plan(df) for df in (*frames_, found))
    assert found.where("dx_key IS NOT NULL").count() == 15_000 and found.count() == 30_000


def test_grams_nobody_wants_stay_in_their_task(spark):
    texts = spark.range(200).selectExpr("concat('ward ', id, ' has many other words in it') AS text")
    bitmap = contains._bitmap(spark.createDataFrame([("ward 1",), ("nobody",)], "gram string"))
    held = contains._held(texts, contains._grams(F.col("text"), F.lit(6)), bitmap)
    assert np.unpackbits(bitmap).sum() == 2
    assert {r.gram for r in held.collect()} == {"ward 1"} and held.count() == 111
