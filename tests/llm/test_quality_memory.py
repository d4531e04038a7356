import tracemalloc

import numpy as np

from lodemap.llm import quality


def test_risks_of_a_sample_make_no_copy_in_double_precision():
    x = np.random.default_rng(1).random((4_000, quality.WIDTH), np.float32)
    w = np.linspace(-1, 1, quality.WIDTH)
    tracemalloc.start()
    got = quality._risk_as_0(x, w, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes / 2
    z = x.astype(np.float64) @ w + 0.5
    s = quality._sigmoid(z)
    assert np.allclose(got, np.concatenate([[len(x), quality._softplus(z).sum()], s @ x, [s.sum()]]))
    assert quality._risk_as_0(x[:0], w, 0.5).tolist() == [0] * (quality.WIDTH + 3)
