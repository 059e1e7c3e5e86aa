import numpy as np
import pytest
from pyspark.sql import functions as F

from mixframe.catalog.tables import column
from mixframe.config import FeatureSpec, TableConfig
from mixframe.functions import features, hashing
from mixframe.operators import frames


def one(df, col):
    return df.select(col.alias("v")).first().v


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], "b", ["a", "b", "b", "z"], 2.5)],
                                 "id long, v array<float>, w string, l array<string>, s double")


def test_numeric_checks_length_and_nulls(spark, row):
    spec = FeatureSpec.from_dict(column("v", "FLOAT", [4]))
    assert row.select(features.numeric(spec)).first().v == [1.0, 2.0, 3.0, 4.0]
    for bad in ([1.0, 2.0, 3.0], [1.0, None, 3.0, 4.0], None):
        df = spark.createDataFrame([(bad,)], "v array<float>")
        with pytest.raises(Exception, match="expected 4 values"):
            df.select(features.numeric(spec)).collect()


def test_vocabulary(spark, row):
    assert one(row, features.vocab_indicator("w", ["a", "b"])) == [0.0, 1.0]
    assert one(row, features.vocab_indicator(F.lit("zzz"), ["a", "b"])) == [0.0, 0.0]
    assert one(row, features.vocab_indicator(F.lit(None).cast("string"), ["a"])) == [0.0]
    assert one(row, features.vocab_indicator("l", ["a", "b"], many=True)) == [1.0, 2.0]
    assert one(row, features.vocab_indicator(F.lit(None).cast("array<string>"), ["a"], many=True)) == [0.0]
    with pytest.raises(ValueError):
        features.vocab_indicator("w", [])


def test_frames(row):
    assert one(row, features.pad("v", 1, 2)) == [0.0, 1.0, 2.0, 3.0, 4.0, 0.0, 0.0]
    assert one(row, features.pad("v", 0, 0)) == [1.0, 2.0, 3.0, 4.0]
    assert one(row, features.frame_rows("v", 2, 2)) == [[1.0, 2.0], [3.0, 4.0]]
    assert one(row, features.scalar_plane("s", 1, 3)) == [2.5, 2.5, 2.5]
    assert one(row, features.stack_channels([F.col("v"), features.scalar_plane("s", 2, 2)])) == [1, 2.5, 2, 2.5, 3, 2.5, 4, 2.5]
    assert one(row, features.cast_float("v", "INTEGER")) == [1, 2, 3, 4]
    with pytest.raises(Exception, match="expected 6 values"):
        row.select(features.to_frame("v", 2, 3)).collect()


def test_bilinear_against_a_loop(spark):
    rng = np.random.default_rng(0)
    image = rng.normal(size=(5, 7, 2))
    df = spark.createDataFrame([(image.ravel().tolist(),)], "v array<double>")
    for target in ((5, 7), (3, 4), (9, 13), (1, 1)):
        out = np.array(one(df, features.resize_bilinear("v", (5, 7), target, 2))).reshape(*target, 2)
        for y in range(target[0]):
            for x in range(target[1]):
                sy, sx = y * 5 / target[0], x * 7 / target[1]
                y0, x0 = int(sy), int(sx)
                y1, x1 = min(y0 + 1, 4), min(x0 + 1, 6)
                top = image[y0, x0] * (1 - (sx - x0)) + image[y0, x1] * (sx - x0)
                low = image[y1, x0] * (1 - (sx - x0)) + image[y1, x1] * (sx - x0)
                assert np.allclose(out[y, x], top * (1 - (sy - y0)) + low * (sy - y0))


def test_noise_is_stable_and_normal(spark):
    df = spark.range(500).withColumn("v", F.array_repeat(F.lit(0.0), 40))
    noisy = lambda d, seed: {r.id: r.n for r in d.select("id", hashing.add_noise("v", "id", 1.0, seed).alias("n")).collect()}
    first = noisy(df, 1)
    assert first == noisy(df.repartition(7), 1)
    assert first != noisy(df, 2)
    values = np.concatenate(list(first.values()))
    assert abs(values.mean()) < 0.03 and abs(values.std() - 1) < 0.03


def test_reparameterize_uses_a_log_variance(spark):
    df = spark.range(4000).select("id", F.array(F.lit(3.0)).alias("m"), F.array(F.lit(float(np.log(4.0)))).alias("s"))
    values = np.array([r.z[0] for r in df.select(hashing.reparameterize("m", "s", "id").alias("z")).collect()])
    assert abs(values.mean() - 3) < 0.15 and abs(values.std() - 2) < 0.1


def test_hash_is_capped(row):
    assert 0 <= one(row, hashing.hash_bucket("w", 10**9)) < 10000
    with pytest.raises(ValueError):
        hashing.hash_bucket("w", 0)


def test_embedding_lookup(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "bucket int, vec array<double>")
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "id long, b int")
    out = {r.id: r.v for r in frames.bucket_embedding(rows, "b", table, 2, "v").collect()}
    assert out == {1: [1.0, 2.0], 2: [3.0, 4.0], 3: None}
    with pytest.raises(Exception, match="no vector for bucket 9"):
        frames.bucket_embedding(spark.createDataFrame([(9,)], "b int"), "b", table, 2, "v").collect()
    lists = spark.createDataFrame([(1, [0, 1, 1]), (2, [])], "id long, b array<int>")
    means = {r.id: r.v for r in frames.bucket_embedding_mean(lists, "b", table, 2, "v").collect()}
    assert np.allclose(means[1], [7 / 3, 10 / 3]) and means[2] == [0.0, 0.0]


def test_series_cube(spark):
    config = TableConfig.from_dict(
        {
            "idCols": ["index"],
            "labelCols": ["label"],
            "featureColumns": [column("index", "INTEGER"), column("label", "INTEGER"),
                               *[column(f"s{i}", "FLOAT", [128]) for i in (2, 0, 1)]],
        }
    )
    df = spark.range(3).select(
        F.col("id").alias("index"), F.lit(1).alias("label"),
        *[F.array_repeat(F.lit(float(i + 1)), 128).alias(f"s{i}") for i in range(3)])
    out = frames.to_cube(df, config, (12, 12), (8, 8), (28, 28))
    cube = np.array(out.first().x).reshape(28, 28, 3)
    assert frames.channel_count(config) == 3
    assert np.allclose(cube[14, 14], [1, 2, 3]) and np.allclose(cube[0, 0], 0)
    with pytest.raises(ValueError):
        frames.assemble_features(df, TableConfig.from_dict({"featureColumns": [
            column("index", "INTEGER", kind="fcHashEmbedding", hashSize=4, embeddingSize=2)]}))


def test_pooled_embeddings_need_no_id(spark):
    vectors = spark.createDataFrame([(b, [float(b), 1.0]) for b in range(6)], "bucket int, vec array<double>")
    rows = [(1, [0]), (1, [4]), (None, [3]), (2, []), (3, None), (4, [2, None, 5, 5])]
    df = spark.createDataFrame(rows, "id int, b array<int>")
    out = frames.bucket_embedding_mean(df, "b", vectors, 2, "v")
    assert [tuple(r.v) for r in out.collect()] == [(0.0, 1.0), (4.0, 1.0), (3.0, 1.0), (0.0, 0.0), (0.0, 0.0), (4.0, 1.0)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="no vector for bucket 9"):
        frames.bucket_embedding_mean(spark.createDataFrame([([9],)], "b array<int>"), "b", vectors, 2, "v").collect()


def test_composite_ids_draw_apart(spark):
    df = spark.createDataFrame([(1, 1, [0.0], [0.0]), (1, 2, [0.0], [0.0])], "a int, b int, m array<double>, s array<double>")
    drawn = [r.z for r in df.select(hashing.reparameterize("m", "s", ["a", "b"]).alias("z")).collect()]
    assert drawn[0] != drawn[1]
