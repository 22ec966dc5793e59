"""The registered searches cover the whole job of the reference."""

from itertools import product

from panelspark.plans import q_ml


def test_walk_forward_has_the_whole_grid_and_four_purged_folds():
    got = {(c["C"], c["l1_ratio"]) for c in q_ml.CANDIDATES}
    assert got == set(product((0.01, 0.1, 1.0, 10.0, 100.0), (0.0, 0.1, 0.3, 0.5, 1.0)))
    assert len({c["candidate"] for c in q_ml.CANDIDATES}) == 25
    assert [f["fold"] for f in q_ml.FOLDS] == [1, 2, 3, 4]
    for f in q_ml.FOLDS:
        (y, m), (v, w) = (map(int, f[x].split("-")[:2]) for x in ("train_end", "val_start"))
        assert 12 * v + w == 12 * y + m + 2  # one whole month between


def test_families_are_of_full_size(spark):
    made = {k: make(1000) for k, make in q_ml.families().items()}
    assert made["forest"].getNumTrees() == 500
    assert made["boosted"].getClassifier().getMaxIter() == 100
    assert made["logistic"].getMaxIter() == 5000


def test_robustness_has_three_windows_and_all_families(spark, monkeypatch):
    seen = []

    class Stop(Exception):
        pass

    def compare(tr, va, numeric, categorical, models):
        seen.append(sorted(models))
        raise Stop

    monkeypatch.setattr(q_ml.ml, "compare_families", compare)
    try:
        q_ml.m14(spark, "/root/testdata/sf0.001")
    except Stop:
        pass
    assert seen == [["boosted", "forest", "logistic"]]
    assert len({w["window"] for w in q_ml.WINDOWS}) == len({w["train"] for w in q_ml.WINDOWS}) == 3
