"""Properties of the NumPy helpers."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spikeloom.functions import kernels

numbers = st.lists(st.floats(-100, 100, allow_nan=False), min_size=1, max_size=40)


@given(numbers, numbers)
@settings(max_examples=60, deadline=None)
def test_ks_is_symmetric_and_bounded(a, b):
    d = kernels.ks_statistic(np.array(a), np.array(b))
    assert 0 <= d <= 1 and d == kernels.ks_statistic(np.array(b), np.array(a))


def test_scores_are_centred_and_uncorrelated():
    x = np.random.default_rng(0).normal(size=(200, 6)) @ np.random.default_rng(1).normal(size=(6, 6))
    s = kernels.scores(x, 4)
    cov = np.cov(s.T)
    assert np.allclose(s.mean(axis=0), 0) and np.allclose(cov - np.diag(np.diag(cov)), 0, atol=1e-9)
    assert np.allclose(np.cov(kernels.scores(x, 4, whiten=True).T), np.eye(4))


@given(st.lists(st.floats(0, 10), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_monotone_fit(y):
    fit = kernels.monotone(np.array(y), np.ones(len(y)))
    assert (np.diff(fit) >= -1e-9).all() and np.isclose(fit.sum(), np.sum(y))


def test_split_finds_a_dip_and_no_more():
    rng = np.random.default_rng(2)
    cut = kernels.split_1d(np.concatenate([rng.normal(0, 1, 300), rng.normal(8, 1, 300)]))
    assert cut is not None and 2 < cut < 6
    assert kernels.split_1d(rng.normal(0, 1, 600)) is None


def test_mixture_and_votes():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.3, (80, 2)), rng.normal(5, 0.3, (80, 2))])
    labels = kernels.best_mixture(x, 4, 0)
    assert len(set(labels[:80])) == 1 and len(set(labels[80:])) == 1 and labels[0] != labels[-1]
    assert (labels == kernels.best_mixture(x, 4, 0)).all()
    noisy = labels.copy()
    noisy[3] = 1 - noisy[3]
    assert (kernels.knn_vote(x, noisy, 9) == labels).all()
    far = np.concatenate([x, [[40.0, 40.0]]])
    assert kernels.local_outlier_factor(far, 10).argmax() == 160


def test_exponential_rate():
    centres = (np.arange(100) + 0.5) * 0.001
    assert abs(kernels.exponential_rate(centres, 40 * np.exp(-40 * centres)) - 40) < 1e-6
    assert kernels.exponential_rate(centres, np.full(100, np.nan)) is None


def test_weighted_kmeans():
    label = kernels.weighted_kmeans_1d(np.array([0.0, 1.0, 10.0, 11.0]), np.array([1.0, 5.0, 2.0, 2.0]), 2)
    assert label.tolist() == [0, 0, 1, 1]


def test_parts_of_a_line():
    for groups in (1, 2, 3, 5):
        rng = np.random.default_rng(groups)
        x = np.concatenate([rng.normal(7 * i, 1, 150) for i in range(groups)])
        part = kernels.parts_1d(x)
        assert part.max() + 1 == groups
        assert np.mean(part == np.repeat(np.arange(groups), 150)) > 0.98
    assert kernels.parts_1d(np.random.default_rng(0).exponential(size=400)).max() == 0


def test_guided_split_takes_a_forced_number_that_comes_out():
    rng = np.random.default_rng(6)
    shapes = np.array([[0.0, 0, 0], [9, 0, 0], [18, 0, 0]])
    truth = np.repeat([0, 1, 2], 120)
    x = shapes[truth] + rng.normal(size=(360, 3))
    wrong = truth.copy()
    wrong[::10] = (wrong[::10] + 1) % 3  # a guide with mistakes
    assert (kernels.guided_split(x, wrong, 0, 3) == truth).mean() > 0.98 or (2 - kernels.guided_split(x, wrong, 0, 3) == truth).mean() > 0.98
    assert (kernels.guided_split(x[:120], wrong[:120], 0, 2) == np.searchsorted(np.unique(wrong[:120]), wrong[:120])).all()  # one group only: the guide stays
