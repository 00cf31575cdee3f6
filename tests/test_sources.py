import gzip
import json
import os
from types import SimpleNamespace

import pytest

from corpusweave import session
from corpusweave.sources import lines, tables
from corpusweave.streaming import ingest


def write(path, text, compress=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    opener = gzip.open if compress else open
    with opener(path, "wt", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def test_read_code_json(spark, tmp_path):
    rows = [json.dumps({"repo_name": "a/b", "content": "x\ny"}), "{broken", json.dumps({"repo_name": "c/d", "content": "z"})]
    write(f"{tmp_path}/java.000.json.gz", "\n".join(rows), True)
    write(f"{tmp_path}/python.001.json.gz", rows[0], True)
    found = {(r.lang, r.line_id.rsplit(":", 1)[1], r.repo_name, r.content) for r in lines.read_code_json(spark, str(tmp_path)).collect()}
    assert {f[0] for f in found} == {"java", "python"}
    assert {f[1:] for f in found if f[0].startswith("java")} == {("0", "a/b", "x\ny"), ("2", "c/d", "z")}


def test_line_numbers_over_many_blocks(spark, tmp_path):
    path = write(f"{tmp_path}/big.txt", "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        numbered = lines.read_lines(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(numbered) == 5000
    assert all(r.value.split(" ")[1] == str(r.line_no) for r in numbered)


def test_zip_lines_cuts_the_longer(spark, tmp_path):
    a = lines.read_lines(spark, write(f"{tmp_path}/a/a.txt", "1\n2\n3\n"))
    b = lines.read_lines(spark, write(f"{tmp_path}/b/b.txt", "x\ny\n"))
    assert {(r.source, r.target) for r in lines.zip_lines(a, b).collect()} == {("1", "x"), ("2", "y")}


def test_reports_and_unit_tests(spark, tmp_path):
    head = "TARGET_CLASS,MutationScore,LineCoverage,BranchCoverage\n"
    write(f"{tmp_path}/r/one/stats.csv", head + "CLASS_a,0.5,1,1\n,0.1,1,1\n")
    write(f"{tmp_path}/r/two/stats.csv", head + "CLASS_b,0.95,1,1\n")
    reports = {(r.TARGET_CLASS, r.folder) for r in lines.read_reports(spark, f"{tmp_path}/r/*/*.csv").collect()}
    assert reports == {("CLASS_a", "one"), ("CLASS_b", "two")}
    tests = [
        {"TARGET_CLASS": "a", "tests_strings": "t", "python_translated_tests": "assert x"},
        {"TARGET_CLASS": "b", "tests_strings": "missing", "python_translated_tests": "assert x"},
        {"TARGET_CLASS": "c", "tests_strings": "t", "python_translated_tests": "try assert x"},
    ]
    path = write(f"{tmp_path}/tests.json", "\n".join(map(json.dumps, tests)) + "\n{bad")
    assert [r.TARGET_CLASS for r in lines.read_unit_tests(spark, path).collect()] == ["a"]


def test_text_vectors(spark, tmp_path):
    path = write(f"{tmp_path}/v.txt", "4 2\na 1 2\nb 1\na 3 4\nb 5 6\nc x y\n")
    found = {r.word: r.vector for r in lines.read_text_vectors(spark, path, 2).collect()}
    assert found == {"a": [1.0, 2.0], "b": [5.0, 6.0]}


def test_read_vocab_skips_and_closes_gaps(spark, tmp_path):
    path = write(f"{tmp_path}/vocab", "w1 9\nbad\n<pad> 8\nq\u2028r 7\nw2 6\nw1 5\nw3 x\nw4 2\n")
    assert {(r.token, r.id, r["count"]) for r in lines.read_vocab(spark, path).collect()} == {("w1", 514, 9), ("w2", 515, 6), ("w4", 516, 2)}


def test_retrieval_dump(spark):
    dump = "[[array(['int x ;', 'int </s>'], dtype='<U9')]] [[array([\"a b\", 'c'], dtype='<U9'), array(['n', 'm'])]]"
    df = spark.createDataFrame([(1, dump)], "id int, d string")
    assert [(r.source, r.prefix) for r in lines.parse_retrieval_dump(df, "id", "d").orderBy("pos").collect()] == [("int x ;", "int"), ("a b", "c")]


def test_datastore_folder_is_pruned(spark, tmp_path):
    df = spark.createDataFrame([(1, "a_b"), (2, "c_d")], "v int, language_pair string")
    tables.write_datastore(df, f"{tmp_path}/store")
    one = tables.read_datastore(spark, f"{tmp_path}/store", "a_b")
    assert [r.v for r in one.collect()] == [1]
    assert "PartitionFilters: [isnotnull(language_pair" in one._jdf.queryExecution().executedPlan().toString()


def test_stream_runs_twice_without_repeats(spark, tmp_path):
    schema, source = "id long, text string", f"{tmp_path}/in"
    for part, values in enumerate((["a", "b", "a"], ["b", "c"])):
        rows = [(part * 10 + i, v) for i, v in enumerate(values)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        for _ in range(2):  # the second run finds nothing new
            ingest.ingest_distinct(spark, source, f"{tmp_path}/out", f"{tmp_path}/log", schema, "text", "id")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.text for r in out.collect()) == ["a", "b", "c"]


def test_ingest_distinct_keeps_one_of_rows_delivered_twice(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name in ("one", "two"):
        (source / f"{name}.json").write_text('{"id": 1, "text": "a"}\n{"id": 2, "text": "b"}\n{"id": 3, "text": "a"}\n')
    ingest.ingest_distinct(spark, str(source), f"{tmp_path}/out", f"{tmp_path}/log", "id int, text string", "text", "id")
    assert sorted((r.id, r.text) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "a"), (2, "b")]


def test_ingest_distinct_reads_only_new_rows(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    read = []
    for batch in range(3):
        lines_ = [{"id": 10 * batch + i, "lang": "en" if i % 2 else None, "text": f"t{(batch * 3 + i) % 12}" if i else None} for i in range(6)]
        (source / f"{batch}.json").write_text("".join(json.dumps(x) + "\n" for x in lines_))
        ingest.ingest_distinct(spark, str(source), f"{tmp_path}/out", f"{tmp_path}/log", "id int, lang string, text string", "text", "id", ["lang"])
        for log in sorted((tmp_path / "log" / "commits").glob("[0-9]*"))[-1:]:
            read.append(log.name)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    expected = {}
    for batch in range(3):
        for i in range(6):
            expected.setdefault(("en" if i % 2 else None, f"t{(batch * 3 + i) % 12}" if i else None), 10 * batch + i)
    assert {(r.lang, r.text): r.id for r in rows} == expected and len(rows) == len(expected)
    assert len(set(read)) == 3 and (tmp_path / "log" / "state").exists()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ingest.ROCKS


def test_end_rows_of_a_dump_need_both_parts(spark):
    df = spark.createDataFrame([(1, "[[array(['src a', 'pre b'], dtype)], [[array(['alone'], dtype)]")], "n int, dump string")
    every = {(r.pos, r.source, r.prefix) for r in lines.parse_retrieval_dump(df, "n", "dump").collect()}
    assert every == {(0, "src a", "pre b"), (1, "alone", "")}
    assert {r.source for r in lines.parse_retrieval_dump(df, "n", "dump", need_both=True).collect()} == {"src a"}


def fake_session(setting, master):
    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: made[0] if made else None, setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: setting)), made


def test_checkpoint_folder_of_the_session_wins():
    fake, made = fake_session("/shared", "yarn")
    assert session.checkpoint_root(fake) == "/shared" and made == ["/shared"]


def test_no_local_checkpoint_folder_on_a_cluster():
    fake, made = fake_session(None, "spark://host:7077")
    with pytest.raises(ValueError):
        session.checkpoint_root(fake)
    assert not made


@pytest.mark.parametrize("n,small", [(10, True), (2_000_000, False)])
def test_hint_only_below_the_size_limit(spark, n, small):
    hinted = session.hint_if_small(spark.range(n))
    assert ("ResolvedHint" in hinted._jdf.queryExecution().analyzed().toString()) is small
