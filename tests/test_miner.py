"""Hand-made cases, random logs against the model, and properties."""

import random
import re

import model
import pytest

from linestrata.functions.words import replace_repeatedly
from linestrata.operators.tokenize import tokenize
from linestrata.plans.config import ConfigError, MinerConfig
from linestrata.plans.miner import mine
from linestrata.streaming import label_stream


def log(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_id long, value string")


def run(spark, lines, **options):
    m = mine(log(spark, lines), MinerConfig(**options))
    return {r["pattern"]: r["support"] for r in m.report.collect()}, sorted(r["line_id"] for r in m.outliers.collect())


PUMPS = ["pump p0 stopped", "pump p1 stopped", "pump p2 has stopped", "pump p0 running"]
VALVES = ["valve v0 leaking"] * 2 + ["valve v1 leaking"] * 2
RACKS = ["rack 7:4:1 ready", "rack 7:4:2 ready", "rack 7:4:2 ready"]
RULE = {"wfilter": ":", "wsearch": "[0-9]+", "wreplace": "N"}


@pytest.mark.parametrize(
    ("line", "options", "expected"),
    [
        ("a b ", {}, ["a", "b"]),
        ("  a", {}, ["", "a"]),
        ("   ", {}, [""]),
        ("", {}, []),
        (None, {}, []),
        ("a\tb", {}, ["a\tb"]),
        ("a b\r", {}, ["a", "b\r"]),
        ("a,,", {"separator": ","}, ["a", ""]),
        (" ".join(map(str, range(600))), {}, [str(i) for i in range(512)]),
        ("abc", {"byteoffset": 3}, []),
        ("abcd", {"byteoffset": 3}, ["d"]),
        ("éa b", {"byteoffset": 2}, ["a", "b"]),
        ("aébc d", {"byteoffset": 2}, ["\ufffdbc", "d"]),
        ("日x", {"byteoffset": 1}, ["\ufffd\ufffdx"]),
        ("x1y", {"separator": "[[:digit:]]"}, ["x", "y"]),
    ],
)
def test_tokenizer(spark, line, options, expected):
    assert tokenize(log(spark, [line]), MinerConfig(support=1, **options)).first()["tokens"] == expected


def test_filter_and_template(spark):
    line = "Mon 03 07:15 node7 cron<88>: nightly job went well"
    one = lambda **o: tokenize(log(spark, [line, "other"]), MinerConfig(support=1, lfilter=r"(cron<[0-9]+>:.*)", **o)).orderBy("line_id").collect()
    assert [r["tokens"] for r in one(template="$1")] == [["cron<88>:", "nightly", "job", "went", "well"], []]
    assert one(template="X $0")[0]["tokens"] == ["X", *line.split(" ")]
    assert one(template="$7")[0]["tokens"] == [""]
    assert one(template=("a", " $1"))[0]["tokens"][:2] == ["a", "cron<88>:"]


@pytest.mark.parametrize(
    ("lines", "options", "patterns", "outliers"),
    [
        (PUMPS, {"support": 3}, {"pump *{1,2} stopped ": 3}, [3]),
        (PUMPS, {"support": 2}, {"pump *{1,2} stopped ": 2}, [0, 3]),
        (PUMPS, {"support": 2, "aggrsup": True}, {"pump *{1,2} stopped ": 3, "pump p0 *{1,1}": 2}, [0]),
        (PUMPS, {"rsupport": 75}, {"pump *{1,2} stopped ": 3}, [3]),
        (PUMPS, {"support": 9}, {}, []),
        ([" a b", "a b"], {"support": 2}, {"*{0,1} a b ": 2}, []),
        (VALVES, {"support": 2, "wweight": 0.7}, {"valve (v0|v1) leaking ": 4}, []),
        (VALVES, {"support": 2, "wweight": 0.6}, {"valve v0 leaking ": 2, "valve v1 leaking ": 2}, []),
        (VALVES, {"support": 2, "wweight": 0.6, "weightf": 2}, {"valve (v0|v1) leaking ": 4}, []),
        (["a b", "a b", "a c"], {"support": 2, "wweight": 0.9}, {"a b ": 2}, [2]),
        (["a b", "a b", "a c"], {"support": 2, "wweight": 0.9, "detailtoken": True}, {"a (b) ": 2}, [2]),
        (RACKS, {"support": 3, **RULE}, {"rack N:N:N ready ": 3}, [0, 1, 2]),
        (RACKS, {"support": 3, "replace_mode": "global", **RULE}, {"rack N:N:N ready ": 3}, [0, 1, 2]),
        (RACKS, {"support": 2, **RULE}, {"rack 7:4:2 ready ": 2}, [0]),
        (RACKS, {"support": 3, "outliers_use_derived": True, **RULE}, {"rack N:N:N ready ": 3}, []),
        ([], {"support": 1}, {}, []),
    ],
)
def test_cases(spark, lines, options, patterns, outliers):
    assert run(spark, lines, **options) == (patterns, outliers)


@pytest.mark.parametrize(
    ("word", "search", "replacement", "expected"),
    [
        ("7:4:12/3", "[0-9]+", "N", "N:N:N/N"),
        ("user:bob", ":.+", ":NAME", "user:NAME"),
        ("up-down", "[A-Za-z0-9]+", "N", "N-down"),
        ("1234", "[0-9]{2}", "1", "1"),
        ("aaa", "a", "", ""),
    ],
)
def test_replacement(word, search, replacement, expected):
    assert replace_repeatedly(word, re.compile(search), replacement) == expected


def test_support_arithmetic(spark):
    from linestrata.operators.vocabulary import relative_support

    assert relative_support(20_000, 0.1) == 20
    assert relative_support(4, 10) == 0
    assert mine(log(spark, PUMPS), MinerConfig(support=-5, rsupport=50)).support == 5
    assert len(run(spark, PUMPS, rsupport=10)[0]) == 4  # a support of 0 lets everything pass


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"support": 1, "rsupport": 101},
        {"support": 1, "separator": "x*"},
        {"support": 1, "separator": "("},
        {"support": 1, "byteoffset": -1},
        {"support": 1, "wtablesize": 0},
        {"support": 1, "initseed": 0},
        {"support": 1, "wfilter": "a"},
        {"support": 1, "wweight": 2},
        {"support": 1, "weightf": 3},
        {"support": 1, "outputmode": 2},
        {"support": 1, "debug": 4},
        {"support": 1, "cluster_sketch_size": 5, "aggrsup": True},
        {"support": 1, "lfilter": "a", "template": "$100"},
        {"support": 1, "lfilter": "a", "template": "${1}"},
    ],
)
def test_rejected_options(options):
    with pytest.raises((ConfigError, ValueError)):
        MinerConfig(**options)


def random_log(rnd):
    words = "abcdef"
    shapes = [[rnd.choice(words) for _ in range(rnd.randint(1, 4))] for _ in range(3)]
    lines = []
    for _ in range(rnd.randint(6, 25)):
        t = list(rnd.choice(shapes))
        for _ in range(rnd.randint(0, 2)):
            t.insert(rnd.randint(0, len(t)), rnd.choice("uvwxyz") + str(rnd.randint(0, 9)))
        lines.append((" " if rnd.random() < 0.1 else "") + " ".join(t))
    return lines


@pytest.mark.parametrize("seed", range(5))
def test_random_logs(spark, seed):
    """200 random logs, 40 at a time: each is a log of its own, mined together under disjoint words."""
    rnd = random.Random(seed)
    logs = [random_log(rnd) for _ in range(40)]
    support = rnd.randint(2, 4)
    marked = lambda n, line: re.sub(r"[^ ]+", lambda m: f"{n}_{m[0]}", line)
    lines = [marked(n, line) for n, group in enumerate(logs) for line in group]
    for options in ({"aggrsup": seed % 2 == 0}, {"wweight": (0.5, 0.7, 0.9)[seed % 3], "weightf": 1 + seed % 2, "aggrsup": seed % 5 == 0}):
        expected = model.mine(lines, support, **options)
        assert run(spark, lines, support=support, **options) == (expected["patterns"], expected["outliers"])


@pytest.mark.parametrize("inline", [20_000, 0])
def test_words_inside_the_expression_or_joined(spark, inline):
    lines = random_log(random.Random(77)) + RACKS * 2 + ["", " ", "a  b"]
    expected = model.mine(lines, 2, aggrsup=True, derive=lambda t: re.sub("[0-9]+", "N", t) if ":" in t else None)
    got = run(spark, lines, support=2, aggrsup=True, inline_words=inline, outliers_use_derived=False, **RULE)
    assert got == (expected["patterns"], expected["outliers"])


@pytest.mark.parametrize("inline", [20_000, 0])
def test_equal_lines_of_one_id_stay_apart(spark, inline):
    rows = [(None, "a b c")] * 3 + [(7, "a b c"), (7, "a b c"), (7, "x"), (7, None)]
    m = mine(spark.createDataFrame(rows, "line_id long, value string"), MinerConfig(support=2, inline_words=inline))
    assert [(r["words"], r["own_support"]) for r in m.candidates.collect()] == [(["a", "b", "c"], 5)]
    assert sorted(r["value"] or "" for r in m.outliers.collect()) == ["", "x"]


@pytest.mark.parametrize("inline", [20_000, 0])
def test_no_word_is_frequent(spark, inline):
    m = mine(log(spark, ["\0 a", "\0"]), MinerConfig(support=3, inline_words=inline))
    assert [r["k"] for r in m.reduced.collect()] == [0, 0] and m.clusters.count() == 0
    m = mine(log(spark, ["a\nb c", "a\nb d"]), MinerConfig(support=2, inline_words=inline))
    assert [r["words"] for r in m.candidates.collect()] == [["a\nb"]]


@pytest.mark.parametrize("seed", range(2))
def test_lines_that_all_start_alike(spark, seed):
    """Blocking by the first words would compare all with all."""
    rnd = random.Random(seed)
    lines = ["sys main " + line.strip() for _ in range(15) for line in random_log(rnd)]
    for options in ({"aggrsup": True}, {"aggrsup": True, "wweight": 0.6}, {"wweight": 0.6, "weightf": 2}):
        expected = model.mine(lines, 3, **options)
        assert run(spark, lines, support=3, **options) == (expected["patterns"], expected["outliers"])


def test_a_scan_without_splits_is_dealt_out(spark, tmp_path):
    log(spark, PUMPS * 10).coalesce(1).write.parquet(str(tmp_path / "x"))
    m = mine(spark.read.parquet(str(tmp_path / "x")), MinerConfig(support=20))
    assert m.lines.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert m.line_count == 40


def test_properties(spark):
    lines = random_log(random.Random(5)) * 2
    plain, outliers = run(spark, lines, support=4)
    assert run(spark, lines, support=4, word_sketch_size=7)[0] == plain
    assert run(spark, lines, support=4, cluster_sketch_size=5)[0] == plain
    shuffled = lines[:]
    random.Random(6).shuffle(shuffled)
    assert run(spark, shuffled, support=4)[0] == plain
    assert run(spark, lines * 2, support=8)[0] == {p: 2 * n for p, n in plain.items()}
    joined = run(spark, lines, support=4, wweight=0.8)[0]
    assert sum(joined.values()) == sum(plain.values())
    m = mine(log(spark, lines), MinerConfig(support=4, aggrsup=True))
    assert all(r["support"] >= r["own_support"] for r in m.rolled.collect())
    assert sum(plain.values()) + len(outliers) == len(lines)
    stats = mine(log(spark, lines), MinerConfig(support=4, wweight=0.8)).stats()
    assert stats["clusters"] == len(plain) and stats["lines"] == len(lines)


def test_report_order(spark):
    lines = ["a b"] * 3 + ["c"] * 2 + ["d e"] * 3
    shown = [r["pattern"] for r in mine(log(spark, lines), MinerConfig(support=2)).report.collect()]
    assert shown == ["d e ", "a b ", "c "]
    shown = [r["pattern"] for r in mine(log(spark, lines), MinerConfig(support=2, outputmode=1)).report.collect()]
    assert shown == ["c ", "d e ", "a b "]


def test_no_python_on_the_default_path(spark):
    m = mine(log(spark, PUMPS), MinerConfig(support=2, aggrsup=True, wweight=0.5))
    for df in (m.vocabulary, m.reduced, m.candidates, m.final, m.outliers):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_lines_are_labelled_as_a_stream(spark, tmp_path):
    m = mine(log(spark, PUMPS), MinerConfig(support=3))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("pump p9 stopped\nsomething else\n")
    m.clusters.write.parquet(str(tmp_path / "patterns"))
    lines = spark.readStream.text(str(tmp_path / "in")).selectExpr("0L AS line_id", "value")
    labelled = label_stream(lines, ["pump", "stopped"], spark.read.parquet(str(tmp_path / "patterns")), m.config)
    q = labelled.writeStream.format("memory").queryName("labelled").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["value"]: r["words"] for r in spark.table("labelled").collect()} == {"pump p9 stopped": ["pump", "stopped"], "something else": None}


@pytest.fixture
def no_small_sides(spark):
    """The optimizer takes no side of a join for small by itself, as it does with large input."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def joins_of(df, kind):
    return {line.split("Join")[0].split()[-1] for line in plan_of(df).splitlines() if kind in line and "Join" in line}


ODD_WORDS = ["a b  a", " a b", "", " ", "b ééééééééé a:1", "a:2 a:3 ééééééééé", "q r s", "a\nb x", "a\nb y", None] + RACKS


@pytest.mark.parametrize("derived", [False, True])
def test_words_of_a_table_need_no_shuffle(spark, no_small_sides, derived):
    found = []
    for options in ({}, {"inline_words": 0}, {"inline_words": 0, "table_bytes": 0}):
        with mine(log(spark, ODD_WORDS * 2), MinerConfig(support=3, **options, **(RULE if derived else {}))) as m:
            shuffles = plan_of(m.reduced).count("Exchange hashpartitioning")
            assert (shuffles > 0) == ("table_bytes" in options)
            found.append(sorted(map(repr, m.reduced.select("line_id", "value", "words", "gaps", "tail", "k").collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 2 * len(ODD_WORDS)


def test_a_table_of_many_words(spark):
    lines = [f"w{n} once{n} v{n * 7919 % 5000}" for n in range(5000)] * 2
    m = mine(log(spark, lines), MinerConfig(support=3, inline_words=0))
    assert m.reduced.where("k > 0").count() == 0
    m = mine(log(spark, lines + [f"w{n} x{n}" for n in range(5000)]), MinerConfig(support=3, inline_words=0))
    assert m.frequent_words.count() == 5000 and m.reduced.where("k = 1 and words[0] like 'w%'").count() == 15000


@pytest.mark.parametrize("options", [{}, {"aggrsup": True}, {"wweight": 0.5}, {"cluster_sketch_size": 50}])
def test_only_sequences_of_several_lines_meet(spark, monkeypatch, options):
    """With many words, lines with a sequence of their own are candidates without a shuffle."""
    from linestrata.operators import candidates as c

    lines = random_log(random.Random(5)) + [f"one{n} pump two{n} three" for n in range(30)] + [f"one{n} two{n}" for n in range(30)] * 2 + PUMPS * 3 + ["", " "]
    expected = model.mine(lines, 3, **{k: x for k, x in options.items() if k != "cluster_sketch_size"})
    plain = mine(log(spark, lines), MinerConfig(support=3, **options))
    listed = sorted(map(repr, plain.candidates.collect()))
    shaped, shapes = [], c.shapes
    monkeypatch.setattr(c, "shapes", lambda *a: shaped.append(shapes(*a)) or shaped[-1])
    m = mine(log(spark, lines), MinerConfig(support=3, inline_words=0, **options))
    assert sorted(map(repr, m.candidates.collect())) == listed
    if not options:
        shared = m.reduced.where("k > 0").groupBy("words").count().where("count > 1").count()
        assert shaped[0].select("words").distinct().count() == shared < len(listed)
    assert run(spark, lines, support=3, inline_words=0, **options) == (expected["patterns"], expected["outliers"])
    if not options:  # clusters don't need the other candidates
        assert shaped[-1].groupBy("words").sum("n").where("`sum(n)` < 3").count() == 0


@pytest.mark.parametrize("inline", [20_000, 0])
def test_lines_dont_move_to_meet_patterns(spark, no_small_sides, inline):
    m = mine(log(spark, PUMPS * 5), MinerConfig(support=10, inline_words=inline))
    assert joins_of(m.outliers, "LeftAnti") == {"BroadcastHash"}
    assert {r["value"] for r in m.outliers.collect()} == {"pump p0 stopped", "pump p0 running"}


@pytest.mark.parametrize("keys", [4_000_000, 0])
@pytest.mark.parametrize("sketch", ["word_sketch_size", "cluster_sketch_size"])
def test_rows_of_one_slot_stay_where_they_are(spark, no_small_sides, monkeypatch, keys, sketch):
    """Words of every line, all in one slot, would all come to one task."""
    from linestrata.operators import vocabulary as v

    monkeypatch.setattr(v, "MAX_KEYS", keys)
    lines = [f"every line has {n % 3} u{n}" for n in range(60)]
    plain = mine(log(spark, lines), MinerConfig(support=10))
    for size in (1, 1000):
        m = mine(log(spark, lines), MinerConfig(support=10, **{sketch: size}))
        frame = m.vocabulary if sketch == "word_sketch_size" else m.candidates
        assert ("BroadcastHash" in joins_of(frame, "LeftSemi")) == bool(keys)
        assert sorted(map(tuple, m.frequent_words.collect())) == sorted(map(tuple, plain.frequent_words.collect()))
        assert sorted(map(repr, m.clusters.collect())) == sorted(map(repr, plain.clusters.collect()))
