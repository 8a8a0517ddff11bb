"""Models of the reference's size, and stopping with patience."""

import inspect

from pairloom.plans import models


def test_stopping_waits():
    losses = [5.0, 4.0, 4.5, 3.0, *[3.5] * 25]
    assert models._stopped(losses, 25) == 4 and models._stopped(losses[:-1], 25) is None and models._stopped(losses, 2) == 4


def test_sizes_of_the_reference(spark):
    size = {k: p.default for k, p in inspect.signature(models.fit_boosted).parameters.items()}
    assert (size["depth"], size["rounds"], size["step"], size["patience"]) == (7, 2500, 0.02, 25)
    assert inspect.signature(models.stacked).parameters["k"].default == 10
    b = models.bases()
    assert [b[x].getNumTrees() for x in ("gini", "entropy", "extra_gini", "extra_entropy")] == [100] * 4
    assert (b["boosted"].getMaxIter(), b["boosted"].getMaxDepth(), b["boosted"].getStepSize()) == (50, 6, 0.05)
