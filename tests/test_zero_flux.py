"""Queries over events against their SQL where some fluxes are 0, so that errors are infinite."""

import glob
import math
import os
import shutil

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_catalogue import SF, rows

from lumenfold.config import EngineConfig
from lumenfold.operators import harmonics, jobs, stats
from lumenfold.plans import catalogue

NAMES = [
    "alias_windows",
    "axis_limits",
    "best_period",
    "chi2_band",
    "chi2_fitted",
    "chi2_level",
    "chi2_reduced",
    "local_background",
    "ls_topk",
    "refit_m0_amp",
    "refit_m0_amp_bounded",
    "resid_autocorr",
    "slope_fitted",
    "slope_penalty",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("zero"))
    for p in glob.glob(f"{SF}/*.parquet"):
        if not p.endswith("events.parquet"):
            shutil.copy(p, d)
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.withColumn("value", F.when(F.col("event_id") % 41 == 0, 0.0).otherwise(F.col("value"))).coalesce(1).write.parquet(f"{d}/events.parquet")
    return d


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{files}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, folder, duck, name):
    got, want = catalogue.QUERIES[name](spark, folder), duck.sql(catalogue.SQL[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_nothing_weighs(spark):
    """A band all of whose errors are infinite fails nothing: its means are NaN, as 0 / 0 is."""
    x = spark.createDataFrame([("a", "g", 0.1 * i, 20.0 + i % 3, math.inf, 0.3 * i, i) for i in range(5)], "source_id string, band string, phi double, mag double, emag double, h double, ord long")
    got = stats.weighted_mean_rms(x).first()
    assert got["n"] == 5 and math.isnan(got["m0"]) and math.isnan(got["rms"])
    assert stats.refit(x).first()["amp"] is None
    assert math.isnan(harmonics.wls_first_order(x).first()["m0"])


def test_injection(spark):
    """A point of infinite error changes no trial's success."""
    t = np.sort(np.random.default_rng(1).uniform(0, 30, 61))
    data = [("a", "g", float(t[i]), 15 + math.cos(6 * t[i]), math.inf if i == 30 else 0.01, i) for i in range(61)]
    d = spark.createDataFrame(data, "source_id string, band string, t double, mag double, emag double, ord long")
    got = jobs.injection_recovery(d, [("T1", [1.0, 0.4], [0.2, 1.1])], EngineConfig(m_max=5, pmax=6.0), periods=20, repeats=2).collect()
    assert len(got) == 40 and sum(abs(r["rel_err"] or 9) < 0.01 for r in got) > 30
