import io

from linestrata.__main__ import main, parser, run, to_config
from linestrata.plans.config import MinerConfig
from linestrata.plans.miner import mine
from linestrata.sources.text import chunk_lines, from_dataframe, read_lines


def test_files_are_read_in_order(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\n\ntwo\r\n")
    (tmp_path / "b.log").write_text("three")
    found = read_lines(spark, [str(tmp_path / "*.log"), str(tmp_path / "a.log"), str(tmp_path / "none.log")])
    values = [r["value"] for r in found.orderBy("line_id").collect()]
    assert values == ["one", "", "two\r", "three", "one", "", "two\r"]
    assert read_lines(spark, [str(tmp_path / "none")]).count() == 0


def test_long_lines_in_chunks(spark):
    df = from_dataframe(spark.createDataFrame([(1, "abcdef"), (2, ""), (3, "abc")], "i int, v string"), "v", "i")
    rows = [tuple(r) for r in chunk_lines(df, 3).select("line_id.line_id", "value").orderBy("line_id", "value").collect()]
    assert rows == [(1, ""), (1, "abc"), (1, "def"), (2, ""), (3, ""), (3, "abc")]
    assert mine(df, MinerConfig(support=1, max_line_bytes=3)).line_count == 6


def test_command_line(spark, tmp_path):
    (tmp_path / "x.log").write_text("pump p0 stopped\npump p1 stopped\npump p2 has stopped\npump p0 running\n")
    out = io.StringIO()
    args = parser().parse_args([f"--input={tmp_path}/x.log", "-s", "75%", f"--outliers={tmp_path}/out", "--debug"])
    assert run(spark, to_config(args), out) == 0
    assert out.getvalue() == "pump *{1,2} stopped \nSupport : 3\n\n"
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()] == ["pump p0 running"]


def test_progress_is_logged(spark, tmp_path, caplog, monkeypatch):
    from linestrata.plans import progress

    (tmp_path / "x.log").write_text("pump p0 stopped\npump p1 stopped\n")
    caplog.set_level("INFO", "linestrata")
    for level in (2, 3):
        caplog.clear()
        args = parser().parse_args([f"--input={tmp_path}/x.log", "-s", "2", f"--debug={level}"])
        assert run(spark, to_config(args), io.StringIO()) == 0
        ends = [r.getMessage().split(":")[0] for r in caplog.records if "tasks of stage" not in r.getMessage()]
        assert ends[:6] == ["reading", "vocabulary", "frequent words", "candidates", "clusters", "report"]
        assert "2 lines, 2 support" in caplog.text and "4 words" in caplog.text and "2 df_upto_1" in caplog.text
    caplog.clear()
    slow = progress.Progress(spark, 3, seconds=0.05)
    with slow.phase("slow"):
        spark.sparkContext.parallelize(range(2), 2).foreach(lambda x: __import__("time").sleep(0.5))
    assert "slow: 0 of 2 tasks" in caplog.text


def test_one_scan_for_many_files(spark, tmp_path):
    for k in range(20):
        (tmp_path / f"f {k:02}.log").write_text(f"line {k}\nagain\n")
    lines = read_lines(spark, [str(tmp_path / "*.log")])
    assert [r["value"] for r in lines.orderBy("line_id").collect()][::2] == [f"line {k}" for k in range(20)]
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_chunks_inside_characters(spark):
    df = from_dataframe(spark.createDataFrame([(1, "aé日🎉b")], "i int, v string"), "v", "i")
    cut = lambda n: [r["value"] for r in chunk_lines(df, n).orderBy("line_id").collect()]
    assert cut(2) == ["a\ufffd", "\ufffd\ufffd", "\ufffd\ufffd", "\ufffd", "\ufffd\ufffd", "b"]
    assert cut(6) == ["aé日", "🎉b"] and cut(11) == ["aé日🎉b", ""]


def test_command_line_errors(capsys):
    assert main(["--support=5"]) == 1
    assert main(["--input=x"]) == 1
    assert main(["--input=x", "--support=3", "--syslog=nosuch"]) == 1
    assert "support" in capsys.readouterr().err


def test_facilities():
    from linestrata.functions.facilities import FACILITIES, facility_number

    assert len(FACILITIES) == 23
    assert facility_number("KERN") == 0 and facility_number("local7") == 23
    assert facility_number("ntp") == facility_number("log_alert") == facility_number("local2") == 18
    assert facility_number("nosuch") is None


def test_defaults():
    from linestrata.plans.config import DEFAULT_SEPARATOR, MAX_TOKENS

    a = to_config(parser().parse_args(["--input=x", "--input=y", "-s", "-7", "--outputmode", "--weightf=2"]))
    assert (a.inputs, a.support, a.separator, a.outputmode, a.weightf) == (("x", "y"), 7, DEFAULT_SEPARATOR, 1, 2)
    assert MAX_TOKENS == 512
