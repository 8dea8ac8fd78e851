import json

from millrace.cli import main


def test_generate_load_build_status(spark, tmp_path, capsys):
    out, root = str(tmp_path / "gen"), str(tmp_path / "lake")
    assert main(["generate", "--out", out]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["corrupt"] == 4
    assert main(["check", f"{out}/events"]) == 0
    checked = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (checked["checked"], checked["corrupt_skipped"], checked["by_schema_version"]) == (4243, 4, {"1": 2138, "2": 2105})
    assert main(["load", f"{out}/events", f"{out}/manifest", root]) == 0
    assert main(["build", root, "--as-of", "2026-03-04 00:00:00"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"windows": 523, "broken": 0}
    assert main(["status", root, "--out", f"{out}/status.html"]) == 0
    assert main(["contracts"]) == 0
