"""The daily run killed after each step in turn: the rerun gives the same report and repeats no finished step."""

import glob

import pytest

from tessera.operators import ml as ML
from tessera.plans import daily as D
from tessera.plans import steps as ST
from tests.helpers import rows

SF = "/root/testdata/sf0.001"
STEPS = ["events", "catalog", "train", "report"]


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("daily"))
    return base, rows(D.daily_run(spark, SF, base, num_trees=3, max_depth=4))


def run(spark, base):
    return rows(D.daily_run(spark, SF, base, num_trees=3, max_depth=4).filter("section != 'ml_metrics' OR metric = 'accuracy'"))


@pytest.mark.parametrize(("step", "when"), [*((s, "after") for s in STEPS), ("train", "in")])
def test_killed_run_resumes(spark, tmp_path, monkeypatch, whole, step, when):
    real, ran = ST.Steps.run, []

    def killed(self, name, work, after=(), **inputs):
        def half(out):
            work(out)
            raise KeyboardInterrupt
        got = real(self, name, half if when == "in" and name == step else work, after, **inputs)
        if name == step:
            raise KeyboardInterrupt
        return got

    monkeypatch.setattr(ST.Steps, "run", killed)
    with pytest.raises(KeyboardInterrupt):
        run(spark, str(tmp_path))
    monkeypatch.undo()

    def noted(self, name, work, after=(), **inputs):
        return real(self, name, lambda out: (ran.append(name), work(out))[1], after, **inputs)

    monkeypatch.setattr(ST.Steps, "run", noted)
    trained = len(glob.glob(f"{tmp_path}/train/*"))
    got = run(spark, str(tmp_path))
    assert ran == STEPS[STEPS.index(step) + (when == "after"):]
    assert len(glob.glob(f"{tmp_path}/train/*")) == trained + ("train" in ran)
    ran.clear()
    assert run(spark, str(tmp_path)) == got and ran == []
    want = [r for r in whole[1] if "ml_metrics" not in r or "accuracy" in r]
    assert len(got) == len(want) and [r for r in got if "ml_metrics" not in r] == [r for r in want if "ml_metrics" not in r]


def test_other_parameters_train_again(spark, whole, monkeypatch):
    base, calls, real = whole[0], [], ML.train
    monkeypatch.setattr(ML, "train", lambda *a, **k: (calls.append(k["num_trees"]), real(*a, **k))[1])
    D.daily_run(spark, SF, base, num_trees=3, max_depth=4)
    assert calls == []
    D.daily_run(spark, SF, base, num_trees=2, max_depth=4)
    assert calls == [2]
