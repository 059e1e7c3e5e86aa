import json
import os
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mixframe.catalog.tables import column
from mixframe.config import TableConfig
from mixframe.model import Mixture
from mixframe.operators import metrics, scoring
from mixframe.operators.custom import custom_scorer
from mixframe.operators.network import Coder, CoderSpec
from mixframe.plans.evaluation import evaluate_rows
from mixframe.plans.prediction import predict_dataset, write_run
from mixframe.plans.training import start_model
from mixframe.session import cut, ensure_checkpoint_dir, scratch_path
from mixframe.sinks import predictions
from mixframe.streaming import jobs

MODEL = Mixture([0.4, 0.6], [[0.0, 0.0], [1.0, 1.0]], [[1.0, 2.0], [1.0, 1.0]])


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    return spark.createDataFrame([(i, rng.normal(size=2).tolist()) for i in range(100)], "id long, z_mu array<double>").cache()


@pytest.fixture(scope="module")
def predicted(rows):
    return scoring.predict(rows, MODEL, ["id"], z_sigma=None, z=None).cache()


def files(path, suffix):
    return [f for f in os.listdir(path) if f.startswith("part-") and f.endswith(suffix)]


def test_files_are_split_and_compressed(predicted, tmp_path):
    path = str(tmp_path / "p")
    predictions.write_predictions(predicted.coalesce(1), path, "JSON", rows_per_file=30)
    assert len(files(path, ".json.gz")) == 4
    with pytest.raises(ValueError):
        predictions.write_predictions(predicted, path, "xml")
    with pytest.raises(Exception, match="already exists"):
        predictions.write_predictions(predicted, path, "json")


def test_rows_of_one_task_are_dealt_out(predicted, tmp_path):
    path = str(tmp_path / "dealt")
    kept = predicted.coalesce(1)
    predictions.write_predictions(kept, path, "json", rows_per_file=max(1, kept.count() // 4))
    tasks = {os.path.basename(f).split("-")[1] for f in files(path, ".json.gz")}
    assert len(tasks) >= 4 and predicted.sparkSession.read.json(path).count() == kept.count()


def test_csv_and_text(spark, predicted, tmp_path):
    predictions.write_predictions(predicted, str(tmp_path / "c"), "csv", compression="none")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    first = back.filter("id = 0").first()
    assert json.loads(first.gamma) == predicted.filter("id = 0").first().gamma
    predictions.write_predictions(predicted, str(tmp_path / "t"), "text")
    record = json.loads(spark.read.text(str(tmp_path / "t")).first().value)
    assert set(record) == {"id", "z_mu", "gamma", "assignments"}


def test_sample_and_metrics(spark, predicted, tmp_path):
    predictions.write_sample(predicted, str(tmp_path / "s"), ["id"], 3)
    assert len(files(tmp_path / "s", ".json")) == 1
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "s")).collect()) == [0, 1, 2]
    plan = predictions.sample(predicted, ["id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    record = metrics.separation(MODEL.to_table(spark))
    path = predictions.write_metrics(record, str(tmp_path / "m"), stamp="20240102_030405")
    assert path.endswith("eval_metric_20240102_030405.json") and spark.read.json(path).count() == 1
    for step in (1, 2):
        predictions.scalar_log(step, record, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log")).orderBy("step").collect()
    assert [(r.step, r.name) for r in log] == [(1, "separation"), (2, "separation")]


def test_model_round_trip(spark, tmp_path):
    predictions.write_model(MODEL.to_table(spark), str(tmp_path / "model"))
    assert np.allclose(Mixture.from_table(spark.read.parquet(str(tmp_path / "model"))).variances, MODEL.variances)


def test_flatten(spark):
    df = spark.createDataFrame([([1.5], bytearray(b"caf\xc3\xa9"), [7], [1.0, 2.0])], "p array<double>, t binary, id array<long>, v array<double>")
    flat = predictions.flatten_record(df, ["id"], {"id": 1, "p": 1})
    assert flat.columns == ["id", "p", "t", "v"] and list(flat.first()) == [7, 1.5, "café", [1.0, 2.0]]


def test_checkpoint_folder(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    assert cut(spark.range(3)).count() == 3


def stream_of(spark, rows, path, parts):
    """Files of ``parts`` equal slices, read one file at a time in order."""
    for i in range(parts):
        rows.filter(F.col("id") % parts == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_rescales_each_micro_batch(spark, rows, tmp_path):
    stream = stream_of(spark, rows, str(tmp_path / "in"), 4)
    out = str(tmp_path / "out")
    for _ in range(2):  # a second start finds nothing new
        jobs.score_stream(stream, MODEL, out, str(tmp_path / "state"), ["id"]).awaitTermination()
    back = spark.read.parquet(out)
    assert back.count() == 100 and back.select("batch").distinct().count() == 4
    part = rows.join(back.select("id", "batch"), "id")
    expected = scoring.predict(part, MODEL, ["id"], z_sigma=None, z=None, batch_col="batch")
    a, b = ([r.gamma for r in d.orderBy("id").collect()] for d in (back, expected))
    assert np.allclose(a, b)


def test_stream_metrics_equal_batch_metrics(spark, rows, tmp_path):
    stream = stream_of(spark, rows, str(tmp_path / "in"), 3)
    both = lambda d: d.select(F.col("z_mu").alias("x"), F.transform("z_mu", lambda v: v * 0.5).alias("xhat"))
    jobs.metrics_stream(both(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = jobs.running_metrics(spark, str(tmp_path / "out")).first()
    assert np.allclose(list(found), list(metrics.reconstruction_metrics(both(rows)).first()))


def test_stream_pools_a_fraction(spark, rows, tmp_path):
    stream = stream_of(spark, rows, str(tmp_path / "in"), 1)
    pool = str(tmp_path / "pool")
    jobs.init_stream(stream, pool, str(tmp_path / "model"), str(tmp_path / "state"), 12 / 256, 2, start_model(2, 2)).awaitTermination()
    assert spark.read.parquet(pool).count() == 12


def test_stream_initialises_once(spark, rows, tmp_path):
    stream = stream_of(spark, rows, str(tmp_path / "in"), 4)
    model, pool = str(tmp_path / "model"), str(tmp_path / "pool")
    assert jobs.fitted_model(spark, model) is None
    jobs.init_stream(
        stream, pool, model, str(tmp_path / "state"), init_steps=1.5, k=2, start=start_model(2, 2), max_iter=3
    ).awaitTermination()
    assert spark.read.parquet(pool).count() == 50
    assert jobs.fitted_model(spark, model).k == 2


CONFIG = TableConfig.from_dict(
    {"idCols": ["id"], "labelCols": ["y"], "featureColumns": [column("id", "INTEGER"), column("y", "INTEGER"), column("v", "FLOAT", [64])]}
)


def test_custom_scorer(spark):
    df = spark.range(50).select("id", F.lit(1).alias("y"), F.array_repeat(F.col("id").cast("float"), 64).alias("v"))

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        assert list(batch.columns) == ["v"]
        return pd.DataFrame({"total": batch["v"].map(sum)})

    out = custom_scorer(score, "total double")(df.repartition(3), CONFIG)
    assert out.columns == ["id", "total"] and {r.id: r.total for r in out.collect()} == {i: 64.0 * i for i in range(50)}
    with pytest.raises(Exception, match="one row for each input row"):
        custom_scorer(lambda b: b.head(0).assign(total=0.0), "total double")(df, CONFIG).collect()


def test_custom_scorer_keeps_large_ids_beside_nulls(spark):
    rows = [(9007199254740993, 1, [1.0] * 64), (None, 1, [2.0] * 64)]
    df = spark.createDataFrame(rows, "id bigint, y int, v array<float>").coalesce(1)
    out = custom_scorer(lambda b: pd.DataFrame({"n": b["v"].map(len)}), "n bigint")(df, CONFIG)
    assert [tuple(r) for r in out.collect()] == [(9007199254740993, 64), (None, 64)]


def test_prediction_and_evaluation_of_a_dataset(spark, folder, tmp_path):
    source = spark.read.parquet(f"{folder}/embeddings.parquet")
    source.selectExpr("vec_id id", "label y", "embedding v").write.parquet(str(tmp_path / "train"))
    config = TableConfig(CONFIG.columns, CONFIG.ids, CONFIG.labels, paths={"train": str(tmp_path / "train")})
    spec = CoderSpec((12, 12, 1), (2, 3), (3, 3), (2, 2), 4)
    rng = np.random.default_rng(0)
    coder = Coder(spec, {n: rng.normal(size=s) * 0.3 for n, s in spec.weight_shapes().items()})
    model = start_model(3, 4)
    out = predict_dataset(spark, config, coder, model, (8, 8), interp=(12, 12)).cache()
    assert out.columns == ["id", "z_mu", "z_sigma", "z", "gamma", "assignments"] and out.count() == source.count()
    batched = predict_dataset(spark, config, coder, model, (8, 8), interp=(12, 12), batches=True)
    assert batched.columns == out.columns and batched.count() == source.count()
    write_run(out, config, str(tmp_path / "run"), "json", samples=5)
    assert spark.read.json(str(tmp_path / "run/prediction")).count() == source.count()
    assert spark.read.json(str(tmp_path / "run/sample")).count() == 5
    rows = spark.read.parquet(str(tmp_path / "train"))
    for batches in (False, True):
        record = evaluate_rows(rows, config, coder, model, (8, 8), interp=(12, 12), batches=batches).first().asDict()
        assert set(record) == {
            "mean_absolute_error", "mean_squared_error", "mean_cosine_distance", "simple_silhouette", "loss",
            "separation", "calinski_harabasz",
        } and all(v is not None for v in record.values())


def test_index_column(spark):
    df = spark.createDataFrame([(30,), (10,), (20,)], "id long")
    assert sorted(map(tuple, predictions.with_index(df, "id").collect())) == [(0, 10), (1, 20), (2, 30)]
    named = df.withColumnRenamed("id", "index")
    assert sorted(r[0] for r in predictions.with_index(named, "index").collect()) == [10, 20, 30]


class FakeContext:
    """The three calls the checkpoint folder needs; the setting itself is fixed once a real session runs."""

    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def fake(master, settings):
    conf = SimpleNamespace(get=lambda key, default=None: settings.get(key, default))
    return SimpleNamespace(conf=conf, sparkContext=FakeContext(master))


def test_checkpoint_folder_of_a_cluster():
    named = fake("spark://host:7077", {"spark.checkpoint.dir": "/shared/x"})
    assert ensure_checkpoint_dir(named) == "/shared/x" and named.sparkContext.folder == "/shared/x"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(fake("spark://host:7077", {}))
    assert ensure_checkpoint_dir(fake("local[2]", {})).startswith("/")
