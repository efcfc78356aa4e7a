"""Files in and out, and the command line."""

import csv

import pytest

from graphloom.__main__ import main
from graphloom.model import Config
from graphloom.sources import sinks, text


def put(path, content):
    path.write_bytes(content.encode())
    return str(path)


def test_edges(spark, tmp_path):
    p = put(tmp_path / "e", "a b\n1 \t5 2.5\r\n\n   \n\r\nlone\nx y z\nx y 3abc extra\nx x -1e1\n# note\n")
    got = [(r["u_name"], r["v_name"], r["weight"]) for r in text.read_edges(spark, p).orderBy("line").collect()]
    assert got == [("a", "b", 1.0), ("1", "5", 2.5), ("lone", "", 1.0), ("x", "y", 1.0), ("x", "y", 3.0), ("x", "x", -10.0), ("#", "note", 1.0)]
    named = text.read_edges(spark, p)
    nodes = text.name_nodes(named)
    assert [r["name"] for r in nodes.orderBy("node").collect()] == ["a", "b", "1", "5", "lone", "", "x", "y", "#", "note"]
    assert text.encode(named, nodes).count() == 7


def test_vectors(spark, tmp_path):
    p = put(tmp_path / "v", "\na 1 2\r\nb 3 4 5\nc 1 x\na 7\t8\nd\ne 1 2 x\n")
    assert {r["name"]: r["z"] for r in text.read_vectors(spark, p).collect()} == {"a": [7.0, 8.0], "e": [1.0, 2.0]}
    with pytest.raises(ValueError):
        text.read_vectors(spark, put(tmp_path / "none", "\n"))
    with pytest.raises(ValueError):
        text.read_vectors(spark, put(tmp_path / "pointer", "version https://git-lfs.github.com/spec/v1\noid sha256:00\nsize 5\n"))
    assert {tuple(r) for r in text.read_labels(spark, put(tmp_path / "l", "a 1\r\nb x")).collect()} == {("a", 1), ("b", None)}


def test_run_names_and_log(tmp_path):
    assert sinks.run_folder("net", Config(gamma=1.0, sampling=0.3), 7) == "net_MGA_cosine_gkmeans_bin7_gamma1_samp0.3"
    assert sinks.run_folder("net", Config(g=3, gamma=0.1234567), 2).endswith("_gnokk2m_bin2_gamma0.123457_samp0.3")
    assert [sinks.claim_run(tmp_path / "r") for _ in range(3)] == [1, 2, 3]
    (tmp_path / "r" / "9.txt").touch()
    (tmp_path / "r" / "note.txt").touch()
    assert sinks.claim_run(tmp_path / "r") == 10


def test_partition_lines_sort_as_strings(spark, tmp_path):
    nodes = spark.createDataFrame([(0, "2"), (1, "10"), (2, "a")], "node long, name string")
    part = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "node long, community long")
    assert [r["value"] for r in sinks.partition_lines(part, nodes).collect()] == ["10 0", "2 1", "a 1"]
    sinks.write_partition(part, nodes, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def test_command_line(spark, tmp_path):
    net = tmp_path / "data" / "toy"
    net.mkdir(parents=True)
    put(net / "network.dat", "".join(f"n{a} n{b}\n" for g in (range(4), range(4, 8)) for a in g for b in g if a < b) + "n3 n4\n")
    put(net / "embedding.dat", "".join(f"n{i} {1 if i < 4 else -1} {0.1 * i}\n" for i in range(8)))
    out = tmp_path / "out"
    for _ in range(2):
        assert main(["--network", "toy", "--output", str(out), "--data", str(tmp_path / "data"), "--g", "2"]) == 0
    folder = out / "toy_MGA_cosine_gnog_bin5_gamma1_samp0.3"
    lines = (folder / "1.txt").read_text().splitlines()
    assert lines == (folder / "2.txt").read_text().splitlines() and [x.split()[0] for x in lines] == [f"n{i}" for i in range(8)]
    assert len({x.split()[1] for x in lines}) == 2
    log = list(csv.DictReader((out / "summary.csv").open()))
    assert [r["Idx"] for r in log] == ["1", "2"] and tuple(log[0]) == sinks.LOG_COLUMNS and log[0]["Bin_Method"] == "nog"
    with pytest.raises(SystemExit):
        main(["--network", "toy", "--output", str(out), "--g", "9"])
