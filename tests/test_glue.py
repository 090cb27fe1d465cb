import json

import pytest

from calibrant import cli, config, report
from calibrant.errors import ConfigError


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"top_k": 64, "ratio": {"mode": "fixed"}}))
    c = config.load(str(p), {"selection.budgets": "256,512", "clip": "0.1"})
    assert (c.top_k, c.ratio.mode, c.selection.budgets, c.clip) == (64, "fixed", (256, 512), 0.1)
    for bad in ({"nope": "1"}, {"top_k": "7"}, {"ratio.mode": "odd"}, {"ratio.nope": "1"}):
        with pytest.raises(ConfigError):
            config.load(None, bad)


def test_cli(capsys):
    assert cli.main(["list"]) == 0 and "agg20_correlate" in capsys.readouterr().out
    assert cli.main(["config", "clip=0.3"]) == 0 and json.loads(capsys.readouterr().out)["clip"] == 0.3


def test_advice():
    assert "use two" in report.scale_advice(150, 70, 0.01)[1] and "smaller" in report.scale_advice(150, 80, 0.01)[1]  # 72 hours are the limit
    assert "smaller" in report.scale_advice(500, 250, 0.2)[1]


def test_experiment_matrix_and_guards(spark):
    import json

    import pytest

    from calibrant.errors import StateError
    from calibrant.operators import calibration
    from calibrant.sources import files

    m = files.experiment_matrix(spark, {"lr": [0.1, 0.2], "l2.mode": ["a", "b", "c"]}, {"l2": {"x": 1}}).collect()
    assert len(m) == 6 and m[0]["name"] == "lr=0.1-mode=a" and json.loads(m[5]["config"]) == {"l2": {"mode": "c", "x": 1}, "lr": 0.2}
    ok = spark.createDataFrame([(1, "false")], "step int, `rollout/weight_sync_poisoned` string")
    assert files.stop_if_poisoned(ok).count() == 1
    with pytest.raises(StateError):
        files.stop_if_poisoned(ok.union(spark.createDataFrame([(2, "True")], ok.schema)))
    assert calibration.fits(40, 40, 96, True, 512, 2048, 4096) == [] and len(calibration.fits(60, 40, 96, True, 4000, 2048, 4096)) == 2
    rows = spark.createDataFrame([([1, 2] * 20,), ([1, 2, 3, 4],)], "ids array<int>")
    assert calibration.suggested_config(calibration.loop_report(rows, "ids", 4), 7) == "l2:\n  rollout:\n    loop_periods:\n    - 2\n    - 4\n    - 6\n    - 8\n    eos_token_id: 7\n"
