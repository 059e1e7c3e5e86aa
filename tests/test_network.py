import numpy as np
import pytest
from pyspark.sql import functions as F

from mixframe.operators.network import Coder, CoderSpec, convolve, decode, deconvolve, elu, encode

RNG = np.random.default_rng(5)


def weights(spec, scale=0.2):
    return {name: RNG.normal(size=shape) * scale for name, shape in spec.weight_shapes().items()}


@pytest.mark.parametrize("size,kernel,stride,same", [(8, 3, 2, True), (7, 3, 2, False), (9, 5, 2, True), (6, 1, 1, True), (7, 3, 3, True)])
def test_convolution_against_a_loop(size, kernel, stride, same):
    x, k, b = RNG.normal(size=(2, size, size, 3)), RNG.normal(size=(kernel, kernel, 3, 4)), RNG.normal(size=4)
    out = convolve(x, k, b, stride, same)
    side = -(-size // stride) if same else -(-(size - kernel + 1) // stride)
    before = max((side - 1) * stride + kernel - size, 0) // 2 if same else 0
    assert out.shape == (2, side, side, 4)
    for h in range(side):
        for w in range(side):
            total = b.copy()
            for i in range(kernel):
                for j in range(kernel):
                    y, z = h * stride + i - before, w * stride + j - before
                    if 0 <= y < size and 0 <= z < size:
                        total = total + x[0, y, z] @ k[i, j]
            assert np.allclose(out[0, h, w], total)


@pytest.mark.parametrize("size,kernel,stride,same", [(8, 3, 2, True), (7, 3, 2, False), (8, 5, 2, True), (6, 2, 2, True)])
def test_transposed_convolution_is_the_adjoint(size, kernel, stride, same):
    x = RNG.normal(size=(1, size, size, 2))
    k = RNG.normal(size=(kernel, kernel, 2, 3))
    y = convolve(x, k, np.zeros(3), stride, same)
    g = RNG.normal(size=y.shape)
    back = deconvolve(g, k, np.zeros(2), stride, same)
    assert back.shape == x.shape and np.isclose((y * g).sum(), (x * back).sum())


def test_transposed_with_stride_above_kernel():
    out = deconvolve(np.ones((1, 2, 2, 1)), np.ones((1, 1, 1, 1)), np.zeros(1), 3, True)
    assert out.shape == (1, 6, 6, 1) and out.sum() == 4


@pytest.mark.parametrize("channels,activation", [(1, "ELU"), (9, "RELU")])
def test_shapes_of_the_usual_networks(channels, activation):
    spec = CoderSpec((28, 28, channels), (32, 64, 128), (5, 5, 3), (2, 2, 2), 8, activation, activate_output=channels == 1)
    assert not spec.last_same and spec.encoded_shape() == (3, 3, 128)
    coder = Coder(spec, weights(spec, 0.02))
    x = RNG.normal(size=(2, 28 * 28 * channels))
    mu, sigma = coder.encode_rows(x)
    assert mu.shape == sigma.shape == (2, 8)
    out = coder.decode_rows(mu)
    assert out.shape == x.shape
    assert (out >= (-1 if activation == "ELU" else -np.inf)).all()


def test_elu():
    assert np.allclose(elu(np.array([-1.0, 0.0, 2.0])), [np.exp(-1) - 1, 0, 2])


def test_spec_checks():
    with pytest.raises(ValueError):
        CoderSpec((8, 8, 1), (), (), (), 2)
    with pytest.raises(ValueError):
        CoderSpec((8, 8, 1), (2,), (3, 3), (2,), 2)
    with pytest.raises(ValueError):
        CoderSpec((8, 8, 1), (2,), (3,), (2,), 2, "TANH")
    spec = CoderSpec((8, 8, 1), (2,), (3,), (2,), 2)
    with pytest.raises(ValueError, match="missing"):
        Coder(spec, {})
    with pytest.raises(ValueError, match="shape"):
        Coder(spec, weights(spec) | {"mu_bias": np.zeros(3)})


def test_weights_round_trip_and_batches_agree(spark, tmp_path):
    spec = CoderSpec((8, 8, 2), (3, 4), (3, 3), (2, 2), 5)
    coder = Coder(spec, weights(spec))
    np.savez(tmp_path / "w.npz", **coder.weights)
    from_file, from_table = Coder.from_npz(spec, str(tmp_path / "w.npz")), Coder.from_table(spec, coder.to_table(spark))
    x = RNG.normal(size=(40, 128))
    expected = coder.encode_rows(x)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, x array<double>").repartition(3)
    for c in (from_file, from_table):
        out = encode(df, c).orderBy("id").collect()
        assert np.allclose([r.z_mu for r in out], expected[0]) and np.allclose([r.z_sigma for r in out], expected[1])
    back = decode(encode(df, coder), coder).orderBy("id").collect()
    assert np.allclose([r.xhat for r in back], coder.decode_rows(expected[0]))
    assert encode(df.filter("id < 0"), coder).count() == 0
    with pytest.raises(Exception, match="every vector must hold 128"):
        encode(df.select("id", F.slice("x", 1, 5).alias("x")), coder).collect()
