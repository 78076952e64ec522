import gzip
import io
import json
import sqlite3
import tarfile
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom import prepare as P
from corpusloom import records as R
from corpusloom.operators import dedup, extract, packing
from corpusloom.sources import readers, sinks
from corpusloom.sources.detect import detect_format


def texts(spark, path, **options):
    records, issues = readers.read_records(spark, [str(path)], **options)
    return [r.text for r in records.orderBy("ord").collect()], [(r.kind, r.message) for r in issues.collect()]


def write(path, data):
    (path.write_bytes if isinstance(data, bytes) else path.write_text)(data)
    return path


def test_formats(tmp_path):
    cases = {"hf://x": "huggingface", "https://a/b.jsonl?x=1": "http-jsonl", "http://a/b.txt": "http-text", "a.tar.gz": "archive", "a.TSV": "csv", "a.yml": "yaml", "a.db": "sqlite", "a.arrow": "arrow", "a.npy": "pretokenized", "a.py": "text", "a": "text"}
    assert {p: detect_format(p) for p in cases} == cases
    assert detect_format(str(tmp_path)) == "directory"


def test_jsonl(spark, tmp_path):
    lines = ['{"text": "hello world"}', "", "{broken", '{"text": null}', '{"n": 3}', '{"prompt": "A", "completion": "B"}', '{"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}', '"bare"']
    got, issues = texts(spark, write(tmp_path / "a.jsonl", "\n".join(lines)), text_key="text")
    assert got == ["hello world\n", "A\nB\n", "<|user|>\nhi\n<|assistant|>\nyo\n", "bare\n"]
    assert len(issues) == 1 and issues[0][0] == "warning" and "line 3" in issues[0][1]
    records, _ = readers.read_records(spark, [str(tmp_path / "a.jsonl")])
    assert [(r.line, r.mode) for r in records.orderBy("ord").collect()] == [(1, "generative"), (6, "completion"), (7, "chat"), (8, "generative")]


def test_text_recovery_and_binary(spark, tmp_path):
    got, issues = texts(spark, write(tmp_path / "a.txt", b"hello\xffworld"))
    assert got == ["hello�world\n"] and issues[0][0] == "warning"
    got, issues = texts(spark, write(tmp_path / "b.txt", b"a\x00b"))
    assert got == [] and "Binary" in issues[0][1]


@pytest.mark.parametrize("data,want", [([{"text": "a"}, {"text": "b"}], ["a\n", "b\n"]), ({"data": [{"text": "a"}]}, ["a\n"]), ({"text": "a"}, ["a\n"]), ([1, "x"], ["1\n", "x\n"])])
def test_json(spark, tmp_path, data, want):
    assert texts(spark, write(tmp_path / "a.json", json.dumps(data)))[0] == want


def test_yaml_xml(spark, tmp_path):
    assert texts(spark, write(tmp_path / "a.yaml", "- text: x\n- content: y\n"))[0] == ["x\n", "y\n"]
    assert texts(spark, write(tmp_path / "b.yml", "text: x\n"))[0] == ["x\n"]
    assert texts(spark, write(tmp_path / "a.xml", "<a>x<b>y</b></a>"))[0] == ["x y\n", "y\n"]
    assert texts(spark, write(tmp_path / "bad.xml", "<a>"))[1][0][0] == "error"


@pytest.mark.parametrize("sep,name", [(",", "a.csv"), ("\t", "a.tsv")])
def test_csv(spark, tmp_path, sep, name):
    rows = [["title", "content", "label"], ["t1", '"two\nlines"', "1"], ["", "", ""], ["t2", "c2", "2"]]
    got, _ = texts(spark, write(tmp_path / name, "\n".join(sep.join(r) for r in rows) + "\n"))
    assert got == ["two\nlines\n", "\n", "c2\n"] or got == ["two\nlines\n", "c2\n"]


def test_sqlite(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "a.db")
    db.executescript("create table t(id integer, content text); insert into t values (1, 'one'), (2, null), (3, 'three'); create table n(a integer); insert into n values (1);")
    db.close()
    records, _ = readers.read_records(spark, [str(tmp_path / "a.db")])
    assert [(r.text, r.table, r.mode) for r in records.orderBy("ord").collect()] == [("one\n", "t", None), ("three\n", "t", None)]


def test_arrow_and_parquet(spark, tmp_path):
    table = pa.table({"text": ["a", None, "c"], "label": [1, 2, 3]})
    with pa.OSFile(str(tmp_path / "f.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write(table)
    with pa.OSFile(str(tmp_path / "s.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write(table)
    pq.write_table(table, tmp_path / "p.parquet")
    pq.write_table(table.select(["label"]), tmp_path / "none.parquet")
    for name in ("f.arrow", "s.arrow", "p.parquet"):
        assert texts(spark, tmp_path / name)[0] == ["a\n", "c\n"]
    assert "No usable" in texts(spark, tmp_path / "none.parquet")[1][0][1]
    messages = pa.table({"messages": [json.dumps([{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}])]})
    pq.write_table(messages, tmp_path / "m.parquet")
    records, _ = readers.read_records(spark, [str(tmp_path / "m.parquet")])
    assert [(r.text, r.mode) for r in records.collect()] == [("<|user|>\nq\n<|assistant|>\na\n", "chat")]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.jsonl", '{"text": "one"}\n\n{"text": "two"}\n')
        z.writestr("y.csv", "a,b\n1,2\n")
        z.writestr("z.png", b"\x89PNG")
    assert texts(spark, tmp_path / "a.zip")[0] == ["one\n", "two\n", "a,b\n1,2\n"]
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        for name, data in (("m/x.txt", b"tar text"), ("m/p.png", b"not really")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    assert sorted(texts(spark, tmp_path / "b.tar.gz")[0]) == ["not really\n", "tar text\n"]
    assert texts(spark, tmp_path / "b.tar.gz", code_only=True)[0] == []
    write(tmp_path / "c.gz", gzip.compress(b"plain"))
    assert texts(spark, tmp_path / "c.gz")[1][0][0] == "error"


def test_folder_http_hub_and_missing(spark, tmp_path):
    write(tmp_path / "b.txt", "bee")
    write(tmp_path / "a.py", "ay = 1")
    write(tmp_path / "t.bin", b"1")
    records, issues = readers.read_records(spark, [str(tmp_path)])
    assert [r.text for r in records.orderBy("ord").collect()] == ["ay = 1\n", "bee\n"] and issues.count() == 1
    assert readers.read_records(spark, [str(tmp_path)], code_only=True)[0].count() == 1
    pages = {"http://h/a.jsonl?q=1": b'{"text": "x"}\n', "http://h/b": b"page"}
    records, issues = readers.read_records(spark, [*pages, "http://h/none", "hf://name", str(tmp_path / "gone.txt")], fetch=pages.__getitem__)
    assert sorted(r.text for r in records.collect()) == ["page\n", "x\n"]
    assert {r.kind for r in issues.collect()} == {"warning", "error"}
    assert readers.read_records(spark, [])[0].count() == 0


def test_messages_in_any_form():
    turns = [{"role": "user", "content": "q"}, "x", {"role": "critic", "content": None, "value": "v"}]
    want = "<|user|>\nq\n<|critic|>\nv"
    for value in (turns, json.dumps(turns), str(turns), {"messages": turns}):
        assert extract.render_messages(value) == want
    assert extract.render_messages("no list") == "no list"


def test_instruct_rows(spark):
    row = {"instruction": "i", "input": "n", "output": None, "response": "r"}
    assert extract.text_of_row(row) == "i\nn"
    assert extract.text_of_row({"instruction": "i", "response": "r"}) == "<|user|>\ni\n<|assistant|>\nr"
    assert extract.text_of_row({"b_text": "same", "a_text": "same"}) == "same" and extract.text_of_row({"n": 1}) is None
    df = spark.createDataFrame([("i", "n", None, "r"), ("i", "", "o", "r")], "instruction string, input string, output string, response string")
    assert [r.t for r in df.select(extract.extract_text(df).alias("t")).collect()] == ["i\nn", "<|user|>\ni\n<|assistant|>\no"]


def test_column_rules_agree_with_row_rules(spark):
    df = spark.createDataFrame([("x", "longer title", 3), (None, "t", 1), ("  ", None, 2)], "body string, title string, n int")
    rows = [r.asDict() for r in df.collect()]
    got = [r.t for r in df.select(extract.extract_text(df).alias("t")).collect()]
    assert got == [extract.text_of_row(r) or "" for r in rows]


def test_sinks(spark, tmp_path):
    write(tmp_path / "a.jsonl", '{"text": "one"}\n{"text": "two"}\n')
    records, _ = readers.read_records(spark, [str(tmp_path / "a.jsonl")])
    sinks.write_jsonl(records, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert sorted((r.text, r.metadata.line) for r in back.collect()) == [("one\n", 1), ("two\n", 2)]
    sinks.write_txt(records, str(tmp_path / "txt"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "txt")).collect()) == ["one", "two"]
    assert [r.value for r in sinks.first_column_text(spark.createDataFrame([(1, "x"), (None, "y")], "n int, s string")).collect()] == ["1", ""]


def test_metric_log(spark, tmp_path):
    from corpusloom.operators import metrics_log

    path = tmp_path / "m.jsonl"
    log = sinks.MetricLog(str(path))
    log.append(99, loss=float("nan"), nested={"value": float("inf")})
    with open(path, "a") as f:
        f.write("\nbroken\n")
    assert [(r["step"], r["loss"], r["nested"]) for r in log.tail()] == [(99, None, {"value": None})]
    sinks.MetricLog(str(path), reset=True).append(0, loss=1.0)
    assert len(list(tmp_path.glob("*.bak"))) == 1
    write(path, '{"step": 1, "loss": NaN}\n\nbroken\n{"step": 2, "loss": 0.5}\n')
    rows = metrics_log.parse_log(spark.read.text(str(path)), "step int, loss double").orderBy("_line").collect()
    assert [(r.step, r.loss) for r in rows] == [(1, None), (2, 0.5)]


def test_inspect_and_prepare(spark, tmp_path):
    write(tmp_path / "chat.jsonl", json.dumps({"messages": [{"role": "user", "content": "What is it?"}, {"role": "assistant", "content": "It is a test."}]}) + "\n")
    seen = readers.inspect(spark, [str(tmp_path / "chat.jsonl")])
    assert seen["records"] == 1 and seen["formats"] == {"jsonl": 1} and seen["fields"] == {"messages": 1}
    out = tmp_path / "packed"
    said = P.prepare(spark, [str(tmp_path / "chat.jsonl")], str(out), seq_len=64, val_fraction=0.0)
    assert said["mixed"] >= 1 and said["all_masked"] == 0 and said["all_unmasked"] == 0
    for name in ("train.bin", "train.labels.bin", "val.bin", "packing.manifest.json"):
        assert (out / name).exists()
    labels = packing.read_shards(spark, str(out)).first().labels
    assert 0 < sum(y != -100 for y in labels) < 64


def test_cli(spark, tmp_path, capsys):
    from corpusloom import cli

    write(tmp_path / "a.jsonl", "".join(json.dumps({"text": t}) + "\n" for t in ("alpha beta gamma delta", "alpha beta gamma delta", "short")))
    src = str(tmp_path / "a.jsonl")
    assert cli.main(["clean-dataset", src, "--out", str(tmp_path / "clean")]) == 0
    assert spark.read.json(str(tmp_path / "clean")).count() == 1
    assert cli.main(["validate-dataset", src]) == 0 and cli.main(["validate-dataset", str(tmp_path / "gone.jsonl")]) == 1
    assert cli.main(["train-tokenizer", src, "--out", str(tmp_path / "bpe.json"), "--vocab-size", "280"]) == 0
    assert cli.main(["tokenizer-report", src, "--tokenizer", str(tmp_path / "bpe.json")]) == 0
    assert cli.main(["convert-dataset", src, "--to", "txt", "--out", str(tmp_path / "txt")]) == 0
    assert "unique_tokens" in capsys.readouterr().out


def test_order_keys_hold_every_long(spark):
    numbers = [0, 9, 10, 10**12, 10**12 + 1, 117 << 33, (117 << 33) + 1, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    keys = [r.k for r in df.select(R.order_key(F.lit("a"), F.col("n")).alias("k")).collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(numbers)


def test_repeats_beyond_partition_117_leave_one_row(spark):
    rows = spark.range(0, 400, 1, 200).select(R.order_key(F.lit("s"), F.monotonically_increasing_id()).alias("ord"), F.lit("one text").alias("text"))
    assert dedup.exact_dedup(rows).count() == 1


def test_file_urls_and_plain_paths_give_equal_rows(spark, tmp_path):
    write(tmp_path / "a.txt", "one")
    write(tmp_path / "b.jsonl", '{"text": "two"}\n{"text": "three"}')
    write(tmp_path / "c.csv", "text\nfour")
    read = lambda p: sorted((r.ord, r.text) for r in readers.read_records(spark, [p])[0].collect())
    assert read(str(tmp_path)) == read("file://" + str(tmp_path)) and len(read(str(tmp_path))) == 4


def test_unknown_schemes_are_errors(spark):
    with pytest.raises(ValueError):
        readers.read_found(spark, ["nowhere://host/a.txt"])


def test_line_numbers_of_split_files(spark, tmp_path):
    write(tmp_path / "a.jsonl", "".join(json.dumps({"text": f"line {i} " + "x" * 50}) + "\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
    try:
        got = readers.read_records(spark, [str(tmp_path / "a.jsonl")])[0].orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.line for r in got] == list(range(1, 2001)) and got[1999].text.startswith("line 1999 ")


def test_registry():
    from corpusloom.registry import TRANSFORMS, Registry

    assert TRANSFORMS.get("Clean-Dataset") is TRANSFORMS.get("clean") and "near_dedup" in TRANSFORMS.names()
    r = Registry("thing")
    r.add("one", lambda: 1, "uno")
    assert r.make("UNO") == 1
    with pytest.raises(ValueError):
        r.add("uno", int)
    with pytest.raises(KeyError):
        r.get("two")


def test_cli_spellings_and_the_whole_chain(spark, tmp_path, capsys):
    from corpusloom import cli

    src = write(tmp_path / "a.jsonl", "".join(json.dumps({"text": f"document number {i} is about rivers and boats"}) + "\n" for i in range(30)))
    log = write(tmp_path / "log.jsonl", '{"run_id": 1, "step": 1, "event": "eval", "val_loss": 2.0}\n{"run_id": 1, "step": 2, "event": "eval", "val_loss": 1.0}\n')
    assert cli.main(["auto-train", "--input", str(src), "--name", "x", "--vocab-size", "290", "--seq-len", "32", "--packed-dir", str(tmp_path / "packed"), "--no-train", "--no-progress"]) == 0
    config = json.loads((tmp_path / "packed" / "config.json").read_text())
    assert config["packed"]["train_tokens"] > 0 and (tmp_path / "packed" / "train.bin").stat().st_size > 0
    capsys.readouterr()
    assert cli.main(["evaluate", str(log)]) == 0
    assert json.loads(capsys.readouterr().out)[0]["mean_loss"] == 1.5
    assert cli.main(["benchmark-tokenizer", "--input", str(src), "--limit", "10", "--add-bos"]) == 0
    assert json.loads(capsys.readouterr().out)["records"] == 10
    assert cli.main(["params"]) == 0 and cli.main(["tokenizer-status"]) == 0
    capsys.readouterr()
    assert cli.main(["clean-dataset", "--input", str(src), "--text-column", "text", "--language", "en", "--max-records", "5", "--out", str(tmp_path / "clean")]) == 0
    assert spark.read.text(str(tmp_path / "clean")).count() == 5
