from datetime import datetime

import pytest

from tidemark.functions import features as fx
from tidemark.sources import artifacts


def test_history_and_copies(tmp_path):
    folder = str(tmp_path / "model")
    assert artifacts.history(folder) == [] and artifacts.keep_copy(folder, datetime(2024, 1, 2)) is None
    for i in range(5):
        artifacts.remember(folder, {"run": i}, keep=3)
    assert [r["run"] for r in artifacts.history(folder)] == [2, 3, 4]
    copy = artifacts.keep_copy(folder, datetime(2024, 1, 2))
    assert copy.name == "model-20240102-000000" and (copy / "history.json").exists()
    (tmp_path / "model" / "history.json").write_text("{broken")
    assert artifacts.remember(folder, {"run": 9}) == [{"run": 9}]


def test_lineage():
    found = artifacts.lineage(fx.NAMES)
    assert len(found) == 97 and found["return_4h_3"]["expression"].startswith("CASE") and found["rsi_1h"]["block"] == "momentum"
    with pytest.raises(ValueError):
        artifacts.lineage(["none"])
