"""Weights of the clause features keep their signs, so what is negated or reported never speaks for toxicity."""

import numpy as np
import pytest

from skaldic.llm import toxicity


@pytest.mark.parametrize("seed", range(20))
def test_signs(seed):
    rng = np.random.default_rng(seed)
    x = np.log1p(rng.poisson(rng.uniform(0, 2, 6), (200, 6)))
    y = (x @ rng.normal(size=6) + rng.normal(size=200) > 0).astype(float)
    beta = toxicity.fit_signed(x, y)
    assert (beta[:-1] * toxicity.SIGNS >= 0).all()
    free = np.flatnonzero(beta[:-1])
    assert np.allclose(beta[np.r_[free, 6]], toxicity.fit_logistic(x[:, free], y, ridge=1e-5))


def test_unbounded_fit_that_keeps_to_the_signs_stays():
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (500, 6))
    y = (rng.uniform(size=500) < 1 / (1 + np.exp(-(x * toxicity.SIGNS * 3).sum(1)))).astype(float)
    assert np.allclose(toxicity.fit_signed(x, y), toxicity.fit_logistic(x, y, ridge=1e-5))


def test_negated_insult_never_scores_over_an_empty_text():
    scanner = toxicity.Scanner({"idiot ": 2.0, "moron ": 1.0})
    rng = np.random.default_rng(2)
    texts = ["you are not an idiot", "he is not an idiot.", "they said you are an idiot", "nobody is a moron, never an idiot"]
    for beta in (np.r_[rng.uniform(0, 5, 6) * toxicity.SIGNS, -3] for _ in range(20)):
        score = lambda t: scanner.features(t) @ beta[:-1] + beta[-1]
        assert score("you are an idiot") >= score("")
        for t in texts[:2]:
            assert score(t) <= score("")
