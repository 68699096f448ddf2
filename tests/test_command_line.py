import json

from linkwright.__main__ import main


def test_exit_codes_and_results(spark, tmp_path, capsys):
    head = "name,email,phone,current_company,title,github_url,location\n"
    (tmp_path / "r.csv").write_text(head + "Ann Lee,ann@x.y,9876543210,Co,Engineer,,\nAnn Lee,ann@x.y,,Co,,,\nBo,bo@x.y,,,,,\n")
    (tmp_path / "c.json").write_text(json.dumps({"fields": [{"path": "who", "from": "full_name.value"}]}))
    out = f"file://{tmp_path}/out"
    code = main(["--csv", f"file://{tmp_path}/r.csv", "--config", f"file://{tmp_path}/c.json", "--out", out])
    assert code == 0, capsys.readouterr().err
    assert sorted(r.who for r in spark.read.json(f"{out}/candidates").collect()) == ["Ann Lee", "Bo"]
    assert spark.read.json(f"{out}/run_metadata").first().asDict() == {"processed": 3, "merged": 2, "warnings": 0}
    assert main([]) == 2
    (tmp_path / "bad.json").write_text("{")
    assert main(["--csv", f"file://{tmp_path}/r.csv", "--config", f"file://{tmp_path}/bad.json", "--out", out]) == 2
