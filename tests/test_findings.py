"""Findings of the third review: what failed before is held by a small case."""

from collections import Counter
from datetime import date, timedelta

import duckdb

from effortlens.operators import accuracy, clusters, diffs, identity, patterns, projection, spread
from effortlens.plans import registry
from effortlens.sources.documents import order_repos
from tests.compare import SF, duck_rows, spark_rows


def test_tracked_jobs_agree_to_the_millisecond(spark):
    found = {tuple(r) for r in registry.QUERIES["stream_tracked_jobs"](spark, SF).select("job_id", "kind", "step", "at_ms").collect()}
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
        wanted = con.execute(f"SELECT job_id, kind, step, at_ms FROM ({registry.ORACLE['stream_tracked_jobs']})").fetchall()
    assert found == set(wanted)


def test_greedy_groups_sql_takes_the_login_of_the_first_row(spark, tmp_path):
    # 4 and 5 share an e-mail; only 5 has a login, which it shares with 10
    duckdb.sql(f"COPY (SELECT * FROM (VALUES (4::BIGINT, 1), (5, 1), (10, 2)) t(c_custkey, c_nationkey)) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    columns, rows = spark_rows(registry.QUERIES["greedy_groups"](spark, str(tmp_path)))
    assert (columns, rows) == duck_rows(registry.ORACLE["greedy_groups"], tmp_path)
    assert rows == [("p2@Firm1.example", "4", "1"), ("p5@Firm2.example", "10", "1")]


def test_values_of_few_large_groups_are_not_gathered_by_group(spark):
    values = spark.range(1000).selectExpr("id % 3 AS author", "id AS cents")
    found = accuracy.percentiles(values, ["author"], "cents", {"median": 0.5})
    assert {tuple(r) for r in found.collect()} == {(0, 499.5), (1, 499.0), (2, 500.0)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") >= 2


def test_small_calendars_are_read_in_one_pass_across_batches(spark):
    rows = [(i % 7 if i % 7 else None, i % 3, date(1996, 1, 1) + timedelta(days=i * 5 % 23), i * 37 % 900) for i in range(200)]
    commits = spark.createDataFrame(rows, "repo long, email int, day date, cents long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        placed = spread.placed_days(commits, ("repo", "email"))
        found = sorted((str(r["repo"]), r["email"], r["entry_day"], r["day"], r["cents"]) for r in placed.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = []
    for key in {r[:2] for r in rows}:
        sums = Counter()
        for *own, day, cents in rows:
            if tuple(own) == key:
                sums[day] += cents
        wanted += [(str(key[0]), key[1], *p) for p in spread.place(sorted(sums.items()))]
    assert found == sorted(wanted)
    assert "FlatMapGroupsInPandas" not in placed._jdf.queryExecution().optimizedPlan().toString()


def test_moved_files_are_paired_in_one_pass_and_texts_made_after_the_shuffle(spark):
    lines = lambda sign, n, mark: "".join(f"{sign}text {mark} {i}\n" for i in range(n))
    rows = [(s, no, "f", lines("-", 12, s) if no < 2 else lines("+", 12 + no, s), 12 * (no < 2), (12 + no) * (no > 1)) for s in (1, 2, 3) for no in range(4)]
    files = spark.createDataFrame(rows, "sha long, file_no int, filename string, diff string, deleted int, added int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        pairs = patterns.move_pairs(files, ["sha"])
        assert sorted(map(tuple, pairs.collect())) == [(s, a, b, 1.0) for s in (1, 2, 3) for a, b in ((0, 2), (1, 3))]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_a_long_chain_of_matches_needs_few_rounds(spark):
    chain = spark.range(3000).selectExpr("id AS a", "id + 1 AS b")
    assert {tuple(r) for r in identity.match_groups(chain, max_rounds=4).collect()} == {(k, 0) for k in range(3001)}


def test_keys_of_few_bytes_of_names_are_made_by_many_tasks(spark):
    names = spark.range(40).selectExpr("'' AS scope", "concat('ann ', md5(string(id))) AS name")
    plan = identity.near_names(names, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 4, true" in plan


def test_clusters_of_many_small_commits_are_merged_in_one_pass_across_batches(spark):
    rows = [(s, k, f"src/d{(s + k) % 4}/e{k % 3}/f{k}.py", 1, 0) for s in range(9) for k in range(3 + s * 4)]
    files = spark.createDataFrame(rows, "sha long, file_no int, filename string, added long, deleted long")
    whole = Counter(map(tuple, clusters.clusters(files).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        found = clusters.clusters(files)
        assert Counter(map(tuple, found.collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r[3] * n for r, n in whole.items()) == len(rows)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_compared_only_where_their_numbers_leave_it_open(spark):
    same = "".join(f"-a {i}\n+a {i} \n" for i in range(6))
    rows = [("f", same), ("f", same + "+b\n"), ("f", "-a 1\n+a 1 \n" * 8), ("f", "+++x\n---y\n+z\r+w\n+-v\n"), ("f", None)]
    found = diffs.file_features(spark.createDataFrame(rows, "filename string, diff string"))
    assert [(r["added"], r["deleted"], "formatting_only" in (r["tags"] or [])) for r in found.collect()] == [(6, 6, True), (7, 6, True), (8, 8, False), (2, 0, False), (None, None, False)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN ((((added" in plan


def test_aliases_come_out_of_one_pass_over_the_orders(spark):
    orders = spark.createDataFrame([(1, 0, '[{"email": " A@x ", "id": 7}]', '{"g": {"primary": {"email": "b@x", "login": "l"}, "merged_from": [{"email": "c@x", "login": "m"}]}, "h": null}')], "order_id long, workspace long, developers string, mapping string")
    found = projection.extract_aliases(orders)
    assert sorted(tuple(r) for r in found.select("email", "name", "username", "provider_id", "source").collect()) == [
        ("a@x", "a@x", None, "7", "primary"), ("b@x", "b@x", "l", None, "primary"), ("c@x", "m", "m", None, "merged_from"),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "get_json_object" not in plan


def test_elements_of_orders_are_parsed_once(spark):
    orders = spark.createDataFrame([(1, '[{"full_name": "o/r", "owner": {"login": "boss"}, "stars": "3"}]')], "order_id long, selected_repos string")
    found = order_repos(orders)
    assert [(r["owner"], r["name"], r["stars"]) for r in found.collect()] == [("boss", "r", 3)]
    assert "get_json_object(element" not in found._jdf.queryExecution().optimizedPlan().toString()
