"""JSON of orders and reports, whole and broken."""

import json

from effortlens.sources.documents import order_repos, read_reports


def test_repositories_of_orders(spark):
    repos = [
        {"full_name": "Org/App", "id": 7, "owner": {"login": "boss"}, "html_url": "u", "stars": 3, "private": True},
        {"fullName": "org/app", "id": 8},
        {"full_name": "", "fullName": " a/b/c ", "owner": "x", "name": "n", "cloneUrl": "k"},
        {"full_name": "alone"}, {"id": 1}, "text", None, 5,
    ]
    rows = spark.createDataFrame([(1, json.dumps(repos)), (2, json.dumps([{"full_name": "org/app"}])), (3, None), (4, "{}"), (5, "no json"), (6, "[]")], "order_id long, selected_repos string")
    found = {(r["order_id"], r["full_name"]): r for r in order_repos(rows).collect()}
    assert set(found) == {(1, "Org/App"), (1, "a/b/c"), (1, "alone"), (2, "org/app")}
    row = found[1, "Org/App"]
    assert (row["owner"], row["name"], row["external_id"], row["url"], row["stars"], row["is_private"]) == ("boss", "App", "7", "u", 3, True)
    assert (found[1, "a/b/c"]["owner"], found[1, "a/b/c"]["name"], found[1, "a/b/c"]["clone_url"]) == ("x", "n", "k")
    assert (found[1, "alone"]["owner"], found[1, "alone"]["name"]) == ("", "alone")
    assert (found[2, "org/app"]["owner"], found[2, "org/app"]["name"], found[2, "org/app"]["stars"]) == ("org", "app", None)


def test_reports_skip_broken_files(spark, tmp_path):
    for name, text in {"a": '{"run": "r1",\n "n": 3}', "b": "{broken", "c": '{"run": null}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = read_reports(spark, str(tmp_path), "run string, n long").collect()
    assert {(r["file"].rsplit("/", 1)[-1], r["run"], r["n"]) for r in rows} == {("a.json", "r1", 3), ("c.json", None, None)}
