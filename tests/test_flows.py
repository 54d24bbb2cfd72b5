"""The standard jobs end to end on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus import codes, papers, raw_codebook, raw_papers

from sedge import flows
from sedge.sources import provenance, tables


def test_prepare_literature(spark, tmp_path):
    report = flows.prepare_literature(raw_papers(spark), raw_codebook(spark), ["row"], str(tmp_path)).first().asDict()
    assert report["matched"] == 2 and report["unmatched_count"] == 1 and report["title_mismatches"] == 0
    back, long = tables.read_literature(spark, str(tmp_path))
    assert back.count() == 3 and long.count() == 9
    assert spark.read.csv(str(tmp_path / "papers_coded.csv"), header=True).count() == 3


def test_analyze_literature(spark, tmp_path):
    tables.write_tables({"papers.csv": papers(spark), "codes_long.csv": codes(spark)}, str(tmp_path / "in"))
    written = flows.analyze_literature(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log"))
    assert len(written) == 9
    top = spark.read.csv(written["lit_top_codes"], header=True).collect()
    assert {(r["dimension"], r["code"], r["papers"]) for r in top} >= {("barriers", "cost", "2")}
    log = provenance.read_run_log(spark, str(tmp_path / "log")).first()
    assert json.loads(log["payload"])["papers"] == 4


def sensor_csv(path, n=300):
    rng = np.random.default_rng(0)
    lines = [" row; time ;Temperature (°C);Stiring;Pressure (bar)"]
    for i in range(n):
        t, s = rng.uniform(20, 250), rng.uniform(0, 5)
        y = 0.01 * t + 0.5 * s
        lines.append(";".join([str(i), f"00:{i // 60 % 60:02d}:{i % 60:02d}", f"{t:.3f}".replace(".", ","), f"{s:.3f}", f"{y:.4f}"]))
    path.write_text("\n".join(lines), encoding="utf-8")


def test_sensor_from_csv_to_sweep(spark, tmp_path):
    sensor_csv(tmp_path / "raw.csv")
    raw = tables.read_raw(spark, str(tmp_path / "raw.csv")).withColumn("row", F.col("row").cast("long"))
    done = flows.prepare_sensor(raw, ["time", "temperature", "stiring"], "pressure", ["row"], ["row"], str(tmp_path / "splits"))
    assert done.features == ["time_s", "Temperature (°C)", "Stiring"] and done.df.count() == 300
    trained = flows.train_and_sweep(done, ["row"], str(tmp_path / "out"), points=6, enabled=["linreg"])
    assert trained.leaderboard.first()["r2_val"] > 0.999
    swept = spark.read.csv(str(tmp_path / "out" / "scenario_results_oneway_linreg"), header=True, inferSchema=True)
    assert swept.count() == 18 and {"co2_v1", "mci_pca", "co2_assumed"} <= set(swept.columns)
    with pytest.raises(ValueError):
        flows.prepare_sensor(raw.limit(0), ["time"], "pressure", ["row"], ["row"], str(tmp_path / "none"))


def test_keywords_from_config(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"note": "x", "keywords": ["algae"]}, indent=1))
    (tmp_path / "e.json").write_text(json.dumps({"keywords": []}))
    assert tables.read_keywords(spark, str(tmp_path / "c.json")) == ["algae"]
    assert len(tables.read_keywords(spark, str(tmp_path / "e.json"))) == 8
    assert tables.read_keywords(spark, str(tmp_path / "none.json"))[0] == "bioeconomy"
