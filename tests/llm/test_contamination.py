"""Outliers among rows of which a third is junk."""

import numpy as np
import pytest

pytest.importorskip("textloom.llm")


@pytest.mark.parametrize("share", [0.3, 1 / 3, 0.4])
def test_a_third_of_a_group_may_be_junk_copies(spark, share):
    from textloom.llm.quality_rules import robust_outliers

    rng = np.random.default_rng(8)
    rows = [(i, "en", "a", int(n), int(n * rng.uniform(4.5, 5.5)), int(rng.integers(0, 2)), 10, 0, 0) for i, n in enumerate(rng.integers(100, 400, 600))]
    junk = [(1000 + i, "en", "a", 200, 1000, 200, 10, 0, 0) for i in range(round(600 * share / (1 - share)))]
    df = spark.createDataFrame(rows + junk, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    found = {r.doc_id: r.outlier for r in robust_outliers(spark, df).collect()}
    assert all(found[r[0]] for r in junk) and sum(found[r[0]] for r in rows) <= 2


def test_determinants_against_many_random_starts(spark):
    """The estimate's determinant is as low as the lowest of 200 random starts, each concentrated until it stands still."""
    from textloom.llm.common import Scratch
    from textloom.llm.quality_rules import DIM, VECTOR, chi2_cdf, chi2_quantile, mcd_estimates

    support, n = 0.53, 150
    floors = np.array([f for _, f in VECTOR.values()])
    scale = support / chi2_cdf(chi2_quantile(support, DIM), DIM + 2)
    rng = np.random.default_rng(3)
    groups = {}
    for g, (junk, shift) in enumerate([(0.0, 0), (0.2, 4), (0.4, 6), (0.33, 8)]):
        x = rng.normal(size=(n, DIM)) @ rng.normal(scale=0.6, size=(DIM, DIM))
        x[: int(junk * n)] = rng.normal(scale=1.5, size=(int(junk * n), DIM)) + shift
        groups[f"g{g}"] = x
    rows = [(g, *map(float, r)) for g, x in groups.items() for r in x]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"x{i} double" for i in range(DIM)))
    scratch = Scratch(spark)
    found = {r.g: r["size"] for r in mcd_estimates(scratch, scratch.keep(df), support, 100).collect()}

    def moments(x):
        return x.mean(0), np.cov(x.T, bias=True) * scale + np.diag(floors**2)

    def concentrated(x, at):
        last = np.inf
        while True:
            m, cov = moments(x[at])
            size = np.linalg.slogdet(cov)[1]
            if len(at) > DIM + 1:  # the start itself is no estimate
                if size >= last - 1e-9:
                    return min(size, last)
                last = size
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
            at = np.argsort(d, kind="stable")[: int(np.ceil(support * n))]

    for g, x in groups.items():
        lowest = min(concentrated(x, rng.choice(n, DIM + 1, replace=False)) for _ in range(200))
        assert found[g] <= lowest + 0.1, (g, found[g], lowest)
