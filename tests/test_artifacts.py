import numpy as np
import pytest

from tidemark.artifacts import load_artifact, save_artifact
from tidemark.functions.scaling import Standard
from tidemark.operators.detectors.linear import Components
from tidemark.operators.detectors.mixture import Mixture


def test_parts_come_back_as_they_were(spark, tmp_path):
    scaler = Standard(np.array([1.0, 2.0]), np.array([0.5, 3.0]))
    axes = Components(np.zeros(3), np.arange(6.0).reshape(3, 2), np.array([2.0, 1.0]), 4.5)
    mix = Mixture(np.array([1.0]), np.ones((1, 2)), np.ones((1, 2)), 7, False)
    save_artifact(spark, str(tmp_path / "a"), 3, scaler=scaler, axes=axes, mix=mix, threshold=0.25)
    found = load_artifact(spark, str(tmp_path / "a"), 3, scaler=Standard, axes=Components, mix=Mixture, threshold=float)
    for name, part in (("scaler", scaler), ("axes", axes), ("mix", mix)):
        for field, value in vars(part).items():
            got = getattr(found[name], field)
            assert type(got) is type(value) and np.array_equal(got, value)
    assert found["threshold"] == 0.25
    with pytest.raises(ValueError):
        load_artifact(spark, str(tmp_path / "a"), 3, other=float)
