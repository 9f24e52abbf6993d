from sparkloom.__main__ import main
from sparkloom.sources import Tables, write_table

from .conftest import DATA


def test_commands(spark, tmp_path, capsys):
    t = Tables(spark, f"{DATA}/sf0.001")
    for name in ("nation", "region"):
        write_table(getattr(t, name).repartition(3), str(tmp_path / f"db/{name}.parquet"))
    db, copy = str(tmp_path / "db"), str(tmp_path / "copy")
    assert main(["integrity-check", db]) == 0
    assert main(["schema-dump", db]) == 0 and "CREATE TABLE nation" in capsys.readouterr().out
    assert main(["backup", db, copy]) == 0 and main(["vacuum", db]) == 0 and main(["restore", db, copy]) == 0
    assert spark.read.parquet(f"{db}/nation.parquet").count() == 25
    assert main(["analyze", db]) == 0 and main(["query", db, "SELECT count(*) AS n FROM nation"]) == 0
    assert "n_nationkey" in capsys.readouterr().out
