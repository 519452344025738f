"""Files of settings."""

import pytest

from weft import __main__ as command
from weft.sources import settings


def test_parse():
    assert settings.parse("# of tests\n\nweft.fixpoint.rounds = 7\n! old\na=b=c\nweft.fixpoint.rounds=8\nempty =\n") == {"weft.fixpoint.rounds": "8", "a": "b=c", "empty": ""}
    for wrong in ("no sign", "= 3"):
        with pytest.raises(ValueError, match="line 1"):
            settings.parse(wrong)


def test_order(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv(settings.VARIABLE, raising=False)
    assert settings.find() == {}
    (tmp_path / settings.DEFAULT).write_text("from = folder")
    assert settings.find() == {"from": "folder"}
    (tmp_path / "two").write_text("from = environment")
    monkeypatch.setenv(settings.VARIABLE, str(tmp_path / "two"))
    assert settings.find() == {"from": "environment"}
    (tmp_path / "three").write_text("from = call")
    assert settings.find(str(tmp_path / "three")) == {"from": "call"}
    with pytest.raises(OSError):
        settings.find(str(tmp_path / "four"))


def test_applied(spark):
    got = settings.apply(spark.builder, {"weft.fixpoint.rounds": "9"}).getOrCreate()
    assert got.conf.get("weft.fixpoint.rounds") == "9"
    got.conf.unset("weft.fixpoint.rounds")


def test_missing_file_ends_the_command(tmp_path, capsys):
    question = tmp_path / "q"
    question.write_text("")
    assert command.main(["-p", str(tmp_path / "none"), str(question)]) == 1
    assert capsys.readouterr().err.startswith("settings: ")
