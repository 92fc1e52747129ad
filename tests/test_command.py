"""The command line."""

from __future__ import annotations

import json

import pytest

from retrix.__main__ import main


def test_list(capsys):
    assert main(["list"]) == 0
    assert "hybrid_rrf" in capsys.readouterr().out


def test_run(spark, data, capsys, tmp_path):
    assert main(["run", "collection_info", data]) == 0
    assert json.loads(capsys.readouterr().out)["dimension"] == 64
    assert main(["run", "collection_info", data, "--out", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert main(["run", "collection_info", data, "--explain"]) == 0


def test_unknown(data):
    with pytest.raises(SystemExit):
        main(["run", "nothing", data])
