"""The pipeline's stages, each against what its own input asks for."""

import pytest
from conftest import DATA

import corpus_pipeline as p
from linestrata.llm import decontaminate, linededup, packing, quality, similar


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    d = f"{DATA}/{'sf0.001'}"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = [docs]
    for name, stage in p.STAGES:
        stage(spark, out[-1], d).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns(done):
    assert all(df.columns == done[0].columns for df in done[:5])


def brute_groups(rows, similarity):
    """Smallest ids of the components of documents whose shingle sets are this similar."""
    rows = sorted(rows)
    sets = [set(similar.shingle_set((t or "").encode()).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return {rows[g][0] for g in group}


def test_stages(spark, done):
    docs, good, lines, single, clean, packed = done
    assert ids(good) == ids(quality.compression_bands(docs).where("kept"))
    state = linededup.line_dedup(good).collect()
    assert {(r["doc_id"], r["text"]) for r in lines.collect()} == {(r["doc_id"], r["text"]) for r in state if not r["n_removed"] or r["n_removed"] < r["n_lines"]}
    least, exact, most = (brute_groups([tuple(r) for r in lines.select("doc_id", "text").collect()], x) for x in (0.74, 0.8, 0.86))
    assert least <= ids(single) <= most and len(ids(single) ^ exact) <= 0.01 * len(exact)
    benchmark = spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet")
    hit = {r["doc_id"]: r["n_hit"] / r["n_words"] for r in decontaminate.contamination(single, benchmark).collect() if r["n_hit"]}
    assert ids(clean) == {i for i in ids(single) if hit.get(i, 0) <= 0.5}
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    assert all((r["text"] == before[r["doc_id"]]) == (r["doc_id"] not in hit) for r in clean.collect())
    assert ids(packed) == ids(clean)
    pieces = packing.pieces(clean, packing.ranks_file(), 1024).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed.collect()) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in pieces)


def test_run(spark, done):
    got = p.run(spark, f"{DATA}/sf0.001")
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, got.collect())) == sorted(map(key, done[-1].collect()))


def test_awkward_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, extra columns of clashing names."""
    import random

    from linestrata.sources import shared

    rnd = random.Random(5)
    words = [r["text"] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").where("text is not null and n_chars > 2000").limit(3).collect()]
    text = words[0]
    long = "\n".join(" ".join(rnd.sample(text.split(), 30)) for _ in range(3000))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, None), (4, ""), (5, " \n "), (6, words[1]), (7, words[2] + " the end"), (8, long), (None, words[2])]
    df = spark.createDataFrame([(i, t, "de", "s", 1, "?", 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, salt string, node int")
    for frame, name in ((df, "full"), (df.limit(0), "empty")):
        (tmp_path / name).mkdir()
        frame.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    before = shared.made_folders()
    docs = spark.read.parquet(str(tmp_path / "full" / "documents.parquet"))
    for k, (_, stage) in enumerate(p.STAGES[:4]):
        docs = stage(spark, docs, str(tmp_path / "full"))
        assert docs.columns == df.columns
        assert {(r["lang"], r["salt"], r["node"]) for r in docs.collect()} <= {("de", "?", 7)}
    single = ids(docs)
    shared.drop_folders(spark, *[f for f in shared.made_folders() if f not in before])
    got = p.run(spark, str(tmp_path / "full"))
    assert ids(got) == single and not {3, 4, 5} & single
    assert len(shared.made_folders()) == len(before) + 1  # only the result is left
    by = got.groupBy("sequence_id").sum("length").collect()
    assert all(r[1] <= 1024 for r in by)
    assert p.run(spark, str(tmp_path / "empty")).count() == 0


def test_components(spark):
    import random

    from linestrata.llm.components import components

    rnd = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(1000, 100 + k) for k in range(200)] + [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(60)] + [(5, 5), (3, 2)]
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()
    assert len(got) == len(want) and {r["node"]: r["root"] for r in got} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
