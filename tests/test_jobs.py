"""The jobs against their SQL, on growing copies of the tables, and from the command line."""

import json
import os
import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobs import registry, sky_catalog, text_survey
from skyframe.config import BackgroundConfig, DedupConfig, DetectConfig
from skyframe.operators import dedup, detect
from skyframe.plans import pipeline
from skyframe.sources import views
from skyframe.streaming import zones

from .conftest import DATA, canonical

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CAT = "id long, brick string, ra double, dec double, npix int"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, duck, name):
    got, want = canonical(registry.QUERIES[name](spark, DATA).toPandas()), canonical(duck.sql(registry.ORACLES[name]).df())
    assert got == want and len(want[1]) > 10


def command(module, *args):
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-m", module, *args], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stderr


def config(folder, **values):
    path = str(folder / "config.json")
    with open(path, "w") as f:
        json.dump(values, f)
    return path


# ---------------------------------------------------------------- survey


def test_survey_edges(spark, tmp_path):
    """Nulls, empty texts, rows without a place, an empty table, other columns, and the same output again."""
    rng = np.random.default_rng(5)
    rows = [(i, ["a", None, ""][i % 3], " ".join("x" * int(n) for n in rng.integers(1, 9, 40))) for i in range(900)]
    rows += [(i, "a", "y" * 60 + " z") for i in range(400, 430)] * 40 + [(None, "a", "gone"), (-4, "b", "gone"), (7, "c", None), (8, "c", ""), (9, "c", " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("brick", F.lit("x")).withColumn("word", F.lit("x"))
    docs.write.parquet(f"{tmp_path}/documents")
    c = config(tmp_path, block=4, tile=16, mesh=8)
    n = text_survey.run(spark, f"{tmp_path}/documents", f"{tmp_path}/out", c)
    first = text_survey.written(spark, f"{tmp_path}/out").collect()
    hit = [r for r in first if r.source == "a" and r.longest == 32 and 400 <= r.first_doc <= 416 <= r.last_doc <= 429]
    assert n == len(first) and len(hit) == 1 and {r.source for r in first} <= {"a", "(none)"}
    assert text_survey.run(spark, f"{tmp_path}/documents", f"{tmp_path}/out", c) == n
    assert sorted(map(str, text_survey.written(spark, f"{tmp_path}/out").collect())) == sorted(map(str, first))
    text_survey.run(spark, f"{tmp_path}/documents", f"{tmp_path}/whole", config(tmp_path, block=4, tile=4096, mesh=8))
    assert sorted(map(str, text_survey.written(spark, f"{tmp_path}/whole").collect())) == sorted(map(str, first))
    docs.limit(0).write.parquet(f"{tmp_path}/none")
    assert text_survey.run(spark, f"{tmp_path}/none", f"{tmp_path}/out", c) == 0 and text_survey.written(spark, f"{tmp_path}/out").count() == 0
    with pytest.raises(ValueError, match="unknown"):
        text_survey.run(spark, DATA, f"{tmp_path}/x", config(tmp_path, blok=3))


def test_survey_from_the_command_line(spark, duck, tmp_path):
    said = command("jobs.text_survey", "--documents", f"{DATA}/documents.parquet", "--out", f"{tmp_path}/out", "--shared", f"{tmp_path}/shared")
    assert "200 documents" in said and f"wrote {tmp_path}/out" in said
    got = text_survey.written(spark, f"{tmp_path}/out").withColumn("peak_snr", F.floor(F.col("peak_snr") * 1e6 + 0.5) / 1e6).toPandas()
    assert canonical(got) == canonical(duck.sql(registry.ORACLES["job1_text_survey"]).df())
    assert any(x.startswith("source=") for x in os.listdir(f"{tmp_path}/out"))


def test_survey_counts_words_from_bytes(spark):
    """Every separator, code points of one to four bytes, texts without words and nulls, in batches that start anywhere."""
    import pyarrow as pa

    texts = ["a bb\tccc\n\x0bd\x0c\re", None, "", "   ", "é\u00a0x 漢字 😀😀😀 " + "z" * 40, "end", "start", "\x08\x0e\x1f ok"]
    bricks = ["p", "p", "q", "q", "p", "q", "q", "q"]
    batch = pa.record_batch({"brick": ["x", *bricks], "row": pa.array([9, 0, 0, 0, 0, 0, 1, 1, 1], pa.int32()), "text": ["not seen", *texts]}).slice(1)
    got = text_survey.word_counts(batch, 32).to_pylist()
    want = {}
    for b, r, x in zip(bricks, [0, 0, 0, 0, 0, 1, 1, 1], texts):
        for w in filter(None, re.split(r"[\x20\x09-\x0D]+", x or "")):
            k = (b, r, min(len(w), 32) - 1)
            want[k] = want.get(k, 0) + 1
    assert {(g["brick"], g["row"], g["col"]): g["v"] for g in got} == want and len(got) == len(want)
    docs = spark.createDataFrame([(i, "s", x) for i, x in enumerate(texts)], "doc_id long, source string, text string")
    sparse = text_survey.spectrogram(docs, 4, 1 << 22).collect()  # too many columns to count in one array
    assert sum(r.v for r in sparse) == sum(want.values()) and max(r.col for r in sparse) == 39


def test_survey_shuffles_no_empty_pixels(spark, tmp_path, monkeypatch):
    """What is filtered comes from the words alone; the image is made where it is filtered."""
    monkeypatch.setattr(text_survey.pipeline, "filtered", None)
    assert text_survey.run(spark, f"{DATA}/documents.parquet", f"{tmp_path}/out", config(tmp_path, block=4)) > 0


@pytest.mark.parametrize("mesh, rows, sigma, thresh", [(8, 8, 1.0, 2.0), (8, 20, 3.0, 1.0), (5, 16, 2.5, 1.5), (8, 64, 1.0, -1.0), (64, 16, 1.0, 2.0)])
def test_strips_find_the_mask_of_the_whole_image(spark, mesh, rows, sigma, thresh):
    rng, n, m = np.random.default_rng(2), 93, 21
    px = rng.poisson(3.0, (2, n, m)).astype(float)
    px[0, 30:70] = 0  # strips without a pixel, beside bright ones
    px[0, 28:30, 5:9], px[1, 46:51, 3:6], px[1, -1, -4:] = 60, 40, 50
    cells = [(f"b{b}", r, c, float(px[b, r, c])) for b in range(2) for r in range(n) for c in range(m)]
    whole = spark.createDataFrame(cells, "brick string, row int, col int, v double")
    bcfg, dcfg = BackgroundConfig(mesh, 3.0), DetectConfig(sigma, thresh, 3)
    want = {(r.brick, r.row, r.col): r.snr for r in detect.mask(pipeline.filtered(whole, bcfg, dcfg), thresh).collect()}
    rows_ = pipeline.masked_strips(whole.where("v > 0"), n, m, bcfg, dcfg, rows).collect()
    got = {(r.brick, r.row, r.col): r.snr for r in rows_}
    assert len(rows_) == len(got) and got.keys() == want.keys() and len(got) > 20
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


# ---------------------------------------------------------------- catalog


def fates(rows):
    return {r.id: r.gone for r in rows.collect()}


def whole(cat, cfg):
    gone = {r.id for r in dedup.removed(cat, cfg).collect()}
    return {r.id: r.id in gone for r in cat.select("id").collect()}


def test_catalog_over_growing_input(spark, tmp_path):
    """Each run takes only new files; after each the catalog is that of one run over all that has come."""
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    src, out, mark = f"{tmp_path}/orders", f"{tmp_path}/out", f"{tmp_path}/mark"
    c, cfg, taken = config(tmp_path, files_per_batch=1), DedupConfig(), orders.limit(0)
    for k in range(3):
        part = orders.where(F.pmod(F.xxhash64("o_orderkey"), F.lit(3)) == k)
        part.coalesce(1 + k % 2).write.mode("append").parquet(src)
        assert sky_catalog.run(spark, src, out, mark, c) == part.count()
        taken = taken.unionByName(part)
        assert fates(sky_catalog.stored(spark, out)) == whole(views.sky_of(taken), cfg)
        before = sorted(map(str, sky_catalog.stored(spark, out).collect()))
        assert sky_catalog.run(spark, src, out, mark, c) == 0
        assert sorted(map(str, sky_catalog.stored(spark, out).collect())) == before
    assert zones.catalog(spark, out, views.sky_of(orders).schema).count() == 14_825


def test_catalog_from_the_command_line(spark, duck, tmp_path):
    args = ("--orders", f"{DATA}/orders.parquet", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark", "--shared", f"{tmp_path}/shared")
    assert "1500 new rows" in command("jobs.sky_catalog", *args) and "0 new rows" in command("jobs.sky_catalog", *args)
    assert sky_catalog.stored(spark, f"{tmp_path}/out").count() == 1500


def test_a_batch_touches_its_zones_only(spark, tmp_path):
    rng, path, cfg = np.random.default_rng(2), f"{tmp_path}/cat", DedupConfig(1.0, True)
    rows = [(i, f"b{i % 3}", 10 + rng.random() * 0.02, rng.random() * 0.5, int(rng.integers(5, 9))) for i in range(600)]
    cat = spark.createDataFrame(rows, CAT)
    zones.create(spark, path, cat.schema)
    assert len(zones.merge(cat, path, 0, cfg)["zones_written"]) == 10
    more = spark.createDataFrame([(1000 + i, "b0", r[2], r[3], 4) for i, r in enumerate(rows) if 0.2 <= r[3] < 0.25], CAT)
    told = zones.merge(more, path, 1, cfg)
    assert told["zones_read"] == [3, 4, 5] and told["zones_written"] == [4] and os.listdir(f"{path}/batch=1") and sorted(x for x in os.listdir(f"{path}/batch=1") if x[0] == "z") == ["zone=4"]
    plan = zones.versions(spark, path, cat.schema).where(F.col("zone").isin([3, 4, 5]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [zone" in plan and "zone#" in plan
    want = whole(cat.unionByName(more), cfg)
    assert fates(zones.newest(zones.versions(spark, path, cat.schema))) == want
    assert zones.merge(more, path, 1, cfg) == told  # a batch that runs again
    assert fates(zones.newest(zones.versions(spark, path, cat.schema))) == want
    assert zones.merge(more, path, 2, cfg)["new"] == 0 and fates(zones.newest(zones.versions(spark, path, cat.schema))) == want  # known ids
    assert zones.merge(more.limit(0), path, 3, cfg)["zones_read"] == []


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival(spark, tmp_path, seed):
    """Chains across several zones, sources without a position, repeated rows; rows go and come back."""
    rng, path, cfg, t = np.random.default_rng(seed), f"{tmp_path}/cat", DedupConfig(1.0, False), 0.7 / 3600
    rows = [(i, f"b{rng.integers(4)}", 10 + rng.random() * t, -0.001 + i * t, int(rng.integers(5, 30))) for i in range(120)]
    rows += [(200 + i, "b1", None, None, 5) for i in range(3)] + [(300 + i, f"b{i % 2}", 20 + rng.random() * 0.002, rng.random() * 0.002, int(rng.integers(5, 30))) for i in range(80)]
    order = rng.permutation(len(rows))
    cat = spark.createDataFrame(rows, CAT)
    zones.create(spark, path, cat.schema)
    for k, part in enumerate(np.array_split(order, 4)):
        some = [rows[i] for i in part]
        zones.merge(spark.createDataFrame(some + some[:3], CAT), path, k, cfg, 0.003)
    stored = zones.newest(zones.versions(spark, path, cat.schema))
    assert stored.count() == len(rows) and fates(stored) == whole(cat, cfg)


def test_a_batch_over_all_zones_tells_no_components_apart(spark, tmp_path, monkeypatch):
    """A crowded sky, whole at first and then with more; the second batch reads all zones too."""
    rng, path, cfg = np.random.default_rng(4), f"{tmp_path}/cat", DedupConfig(1.0, False)
    rows = [(i, f"b{rng.integers(5)}", 10 + rng.random() * 0.01, rng.random() * 0.02, int(rng.integers(5, 45))) for i in range(6000)]
    cat = spark.createDataFrame(rows, CAT)
    zones.create(spark, path, cat.schema)
    monkeypatch.setattr(zones, "decisions", None)
    for k, part in enumerate((cat.where("id % 3 > 0"), cat.where("id % 3 = 0"))):
        assert zones.merge(part, path, k, cfg, 0.005)["new"] == part.count()
    assert fates(zones.newest(zones.versions(spark, path, cat.schema))) == whole(cat, cfg)
