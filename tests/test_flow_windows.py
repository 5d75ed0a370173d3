import numpy as np

from tidemark.operators import kernels as k

rng = np.random.default_rng(2)


def test_windows_are_the_reference_defaults():
    y, x = rng.standard_normal(300), rng.standard_normal(300)
    assert np.array_equal(k.granger(y, x), k.granger(y, x, 240), equal_nan=True)
    assert not np.array_equal(k.granger(y, x), k.granger(y, x, 60), equal_nan=True)
    out = k.copula(y, np.abs(x), rng.standard_normal(300))
    assert np.isnan(out[:58]).all() and np.isfinite(out[58:]).all()
