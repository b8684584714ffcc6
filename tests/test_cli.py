import json

from sluice import cli
from tests.test_dom import LISTING
from tests.test_extract import CONFIG


def test_commands(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("SLUICE_DATA", str(tmp_path / "data"))
    pages = str(tmp_path / "pages")
    spark.createDataFrame([("https://s.com/", LISTING)], "url string, html string").write.parquet(pages)
    (tmp_path / "c.json").write_text(json.dumps(CONFIG))

    def said(*argv: str) -> str:
        assert cli.main(["--pages", pages, *argv]) == 0
        return capsys.readouterr().out.strip()

    source = said("init", "--config", str(tmp_path / "c.json"))
    assert "Product number 1" in said("preview", source)
    assert "added: 5" in said("extract", source)
    assert said("extract", source).endswith("No changes detected") and said("diff", source) == "No changes detected"
    assert len(json.loads(said("export", source))) == 5 and said("export", source, "--format", "csv").startswith("title,url")
    assert "completed" in said("sources") and said("schedule", source, "--cron", "daily")
    assert '"page_type": "list"' in said("scan", "https://s.com/") and json.loads(said("doctor"))["sources"] == 1
    assert cli.main(["schedule", source, "--cron", "nope"]) == 1 and cli.main(["crawl", "nope"]) == 1 and cli.main(["schedule", source, "--disable"]) == 0
    assert "True" in said("configs", source) and "False" in said("configs", source, "--deactivate") and "https://s.com/" in said("crawl", "https://s.com/")
    answers = iter(["title,price", "Mine", "2", "daily"])
    monkeypatch.setattr("builtins.input", lambda _: next(answers))
    made = said("init", "--url", "https://s.com/").splitlines()[-1]
    config = cli.Catalog(spark, str(tmp_path / "data")).active_config(made)
    assert config.name == "Mine" and [f.name for f in config.fields] == ["title", "price"] and "Mine" in said("sources")
