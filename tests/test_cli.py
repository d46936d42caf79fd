from tests.helpers import SF
from tremorlab.__main__ import main


def test_list_sql_and_run(spark, tmp_path, capsys):
    main(["list"])
    main(["sql", "panel_bars"])
    assert "base_rate_scorecard" in capsys.readouterr().out
    main(["run", "panel_bars", "--data", SF, "--out", str(tmp_path / "o"), "--master", "local[4]"])
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0
