"""Each corpus operator against brute force, on text with the awkward cases."""

import hashlib
import random
import zlib
from array import array
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import DATA, duck, rows_of

from linestrata.llm import chatformat, decontaminate, linededup, lmscore, packing, quality, queries, sharding, simhash, similar, suffixdedup, tokencount

SF = "sf0.001"
#: Columns whose names operators use for themselves.
CLASHING = ["body", "fp", "salt", "shard", "start", "lines", "gone", "id", "bucket", "place", "kept", "length", "words"]


def base_rows():
    rnd = random.Random(11)
    words = [w + x for w in ("al", "be", "ga", "de", "é") for x in ("n", "r", "st", "")]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = "\n".join(text(12) for _ in range(5))
    rows = [(i, "\n".join(text(rnd.randint(3, 15)) for _ in range(rnd.randint(1, 8)))) for i in range(60)]
    rows += [(100 + i, text(5) + "\n" + shared + "\n" + text(6)) for i in range(12)]
    copied = rows[7][1] + text(40)
    rows += [(200 + i, copied) for i in range(10)]
    for i in range(25):
        t = copied.split(" ")
        t[rnd.randrange(len(t))] = "changed"
        rows.append((300 + i, " ".join(t)))
    rows += [(400, None), (401, ""), (402, "   \n\n "), (403, "Ab"), (404, "one two"), (405, text(9000)), (406, "x" * 5000), (407, "tab\tand　wide <|endoftext|> </s> [INST] end"), (408, "a\n\nb\n\nc\n\n\nd"), (409, "a\n\nb\n\nc\n\n\nd")]
    rows += [(500, "same row here " * 30), (500, "same row here " * 30), (None, "no id " + text(30)), (None, copied)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return base_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["?" if c != "gone" else None for c in CLASHING]) for r in rows], f"doc_id long, text string, {extra}").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def same(got, want):
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def encoded(text):
    return (text or "").encode()


# ---------------------------------------------------------------- 1


def brute_lines(rows, run):
    groups = defaultdict(list)
    docs = sorted({r for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, xx(r[1])))
    for d, (_, t) in enumerate(docs):
        lines = [(p, x) for p, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\v\f\r")] if t is not None else []
        for i in range(len(lines) - run + 1):
            groups[tuple(x for _, x in lines[i : i + run])].append((d, i, [p for p, _ in lines[i : i + run]]))
    gone = defaultdict(set)
    for places in groups.values():
        for d, _, ps in sorted(places)[1:]:
            gone[docs[d]].update(ps)
    return gone


def xx(text):
    return xxhash.xxh64_intdigest(encoded(text), 42) - (1 << 64) * (xxhash.xxh64_intdigest(encoded(text), 42) >> 63) if text is not None else 42


@pytest.mark.parametrize("run", [1, 2, 3])
def test_line_dedup(docs, rows, run):
    gone = brute_lines(rows, run)
    want = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = None if r[1] is None else "\n".join(x for p, x in enumerate(lines) if p not in gone[r])
        n = sum(bool(x.strip(" \t\n\v\f\r")) for x in lines)
        want.append((r[0], kept, n, len(gone[r]), sum(p - 1 not in gone[r] for p in gone[r])))
    same(linededup.line_dedup(docs, run).collect(), want)


def test_line_dedup_of_very_common_lines(spark):
    rnd = random.Random(4)
    line = lambda: " ".join(rnd.choice("abcdefgh") for _ in range(9))
    passage = [line() for _ in range(4)]
    rows = [(i, "\n".join([line(), "everywhere", *(passage if i % 2 else [line()]), "everywhere", line(), line()])) for i in range(400)]
    gone = brute_lines(rows, 3)
    got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i, t]) for i, t in rows}
    assert sum(r["n_removed"] for r in got) >= 199 * 4


def test_line_dedup_keeps_columns_and_drops_emptied(docs, rows):
    out = linededup.without_repeated_runs(docs)
    assert out.columns == docs.columns
    gone = brute_lines(rows, linededup.RUN)
    keeps = [r for r in rows if not gone[r] or any(x.strip() and p not in gone[r] for p, x in enumerate(r[1].split("\n")))]
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r[0] for r in keeps)


def test_line_dedup_is_native(docs):
    plan = linededup.line_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- 2


def brute_fingerprint(text, k):
    w = encoded(text).lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprint_of_a_long_text():
    rnd = random.Random(6)
    text = " ".join(f"w{rnd.randrange(5000)}" for _ in range(2 * simhash.SLICE + 77))
    assert simhash.fingerprint(encoded(text)) == brute_fingerprint(text, 3)
    words = encoded(text).split()
    sets = np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 5]), 42) for i in range(len(words) - 4)], np.uint64))
    assert (similar.shingle_set(encoded(text)) == sets).all()
    assert similar.fingerprint(sets) == sum(1 << b for b in range(64) if int((sets >> np.uint64(b) & np.uint64(1)).sum()) * 2 > len(sets))


@pytest.mark.parametrize("limit", [512, 4])
def test_near_duplicates(docs, rows, limit):
    fps = [brute_fingerprint(t, 3) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    same(simhash.near_duplicates(docs, shard_limit=limit).collect(), [(r[0], f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, group)])
    if limit == 512:
        kept = simhash.one_of_each(docs)
        assert kept.columns == docs.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter(least[g] for g in set(group))


def test_bk_tree_finds_all_within_the_radius():
    rnd = random.Random(2)
    centre = rnd.getrandbits(64)
    values = [rnd.getrandbits(64) for _ in range(200)] + [centre ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 5))) for _ in range(200)]
    tree = simhash.BKTree(4)
    for v in values:
        tree.add(v)
    for v in values[::7]:
        assert sorted(tree.search(v)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 4]


def test_shards_hold_every_near_pair(spark):
    rnd = random.Random(3)
    values = {simhash._signed(rnd.getrandbits(64)) for _ in range(50)}
    values |= {simhash._signed(7 ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4)))) for _ in range(400)}
    met = defaultdict(set)
    for mask, part, fp in simhash.shards(spark.createDataFrame([(v,) for v in values], "fp long"), 3, 20).collect():
        met[mask, part].add(fp)
    assert max(map(len, met.values())) <= 20
    together = {(a, b) for s in met.values() for a in s for b in s}
    assert all((a, b) in together for a in values for b in values if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3)


@pytest.mark.parametrize("limit", [1024, 8])
def test_similar_documents(spark, limit):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(2000)]
    rows, group = [], []
    for g in range(60):  # copies with one word in a hundred changed, against nothing in common
        base = [rnd.choice(words) for _ in range(200)]
        for _ in range(40 if g == 0 else rnd.choice([1, 2, 4])):
            t = list(base)
            t[rnd.randrange(200)] = "changed"
            rows.append((len(rows), " ".join(t)))
            group.append(g)
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n"), (len(rows) + 3, "few words"), (len(rows) + 4, "Few  WORDS"), (None, rows[0][1]), rows[3]]
    df = spark.createDataFrame([(*r, "?") for r in rows], "doc_id long, text string, sketch string").repartition(3)
    out = similar.one_of_each(df, shard_limit=limit)
    want = [group.index(g) for g in range(60)] + [len(group), len(group) + 3]
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(want)


def test_similar_documents_at_the_threshold(spark):
    text = lambda g, n: " ".join(f"g{g}w{k}" for k in range(n + 4))  # noqa: E731  # n shingles
    rows, want = [], []
    for g, (n, m) in enumerate([(5, 4), (20, 16), (100, 80), (1000, 800), (100, 79), (1000, 798)] * 10):
        rows += [(2 * g, text(g, n)), (2 * g + 1, text(g, m))]
        want += [2 * g] if 10 * m >= 8 * n else [2 * g, 2 * g + 1]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in similar.one_of_each(df).collect()) == want


@pytest.mark.parametrize("limit", [512, 6])
def test_similar_documents_recall(spark, limit, capsys):
    """Every pair of similarity 0.8 or more of a whole table, by band of similarity."""
    rnd = random.Random(limit)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(2000)]
    made = []
    for _ in range(150):  # beside the table's documents, copies with a few words changed
        base = [rnd.choice(words) for _ in range(rnd.choice([60, 200, 600]))]
        for changes in (0, rnd.randint(1, len(base) // 40)):
            t = list(base)
            for _ in range(changes):
                t[rnd.randrange(len(t))] = "changed"
            made.append((10_000 + len(made), " ".join(t)))
    df = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    df = df.unionByName(spark.createDataFrame(made, "doc_id long, text string").repartition(3))
    rows = df.collect()
    sets = {r["doc_id"]: set(similar.shingle_set(encoded(r["text"])).tolist()) for r in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for held in holders.values() if len(held) < 400 for k, a in enumerate(held) for b in held[k + 1 :])
    alike = {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in common.items()}
    got = {r["doc_id"]: r["class_id"] for r in similar.classes(df, shard_limit=limit).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.01)):
        found = [got[a] == got[b] for (a, b), x in alike.items() if low <= x < high]
        with capsys.disabled():
            print(f" similarity {low} to {min(high, 1)}: {sum(found)} of {len(found)} pairs together")
        assert len(found) > 5 and all(found)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), x in alike.items():
        if x >= 0.8:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    empty = [i for i, s in sets.items() if not s]
    assert {i: c for i, c in got.items() if i not in empty} == {i: root(i) for i in sets if i not in empty}


def test_similarity_estimate():
    rnd = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        a = np.unique(rnd.integers(0, 2**64, 3000, dtype=np.uint64))
        n = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.concatenate([a[rnd.permutation(len(a))[:n]], rnd.integers(0, 2**64, len(a) - n, dtype=np.uint64)]))
        sa, sb = (np.frombuffer(similar.sketch(x), np.uint8) for x in (a, b))
        assert abs(similar.estimates(sa, sb[None])[0] - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.08


# ---------------------------------------------------------------- 3


def test_quality_counts(docs, rows):
    got = {}
    for r in quality.compression_bands(docs).collect():
        got.setdefault((r["doc_id"], r["n_words"], r["word_chars"]), []).append(r)
    for i, t in rows:
        w = (t or "").translate(str.maketrans({c: " " for c in "\t\n\v\f\r"})).split(" ")
        w = [x for x in w if x]
        r = got[i, len(w), sum(map(len, w))].pop()
        assert r["n_symbols"] == sum((t or "").count(c) for c in "#*$%&|<>")
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\v\f\r")]
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {p for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        assert r["n_repeat_words"] == len(hit)
        assert r["base_failed"] == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_quality_against_labels(spark):
    d = f"{DATA}/sf0.01"
    got = queries.QUERIES["op3_compression_bands"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    passed = got[~got.base_failed]
    good, bad = passed[passed.quality == 1], passed[passed.quality == 0]
    assert good.kept.mean() > 0.995 and bad.kept.mean() < 0.6


def test_quality_rejects_both_ends(spark):
    rnd = random.Random(1)
    repetitive = " ".join(f"{a}{b} go" for a in "abcdefghij" for b in range(10)) * 2
    noise = " ".join("".join(chr(rnd.randint(33, 126)) for _ in range(9)) for _ in range(900))
    df = spark.createDataFrame([(1, " ".join(["ab cd"] * 10 + [str(i) for i in range(2)] * 9) + repetitive), (2, noise)], "doc_id long, text string")
    assert {r["doc_id"] for r in quality.compression_bands(df).collect() if r["kept"]} == set()


def test_quality_judges_the_end_of_a_text(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    fine = prose(1100)
    lines = "\n".join(f"item {k} of the list" for k in range(60))
    df = spark.createDataFrame([(1, fine), (2, fine[: -len(fine) % 2048 - 1700] + " " + lines[:1500])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.compression_bands(df).collect()}
    bands = quality.Bands()
    import zstandard

    for i, t in df.collect():
        body, size = t.encode(), bands.chunk_bytes
        parts = [body[k : k + size] for k in range(0, len(body) - size + 1, size)] + ([body[-size:]] if len(body) % size else [])
        ratio = lambda x: len(x) / len(zstandard.ZstdCompressor(level=bands.level).compress(x))
        ratios = [ratio(x) for x in parts]
        odd = sum(not bands.chunk_low <= x <= bands.chunk_high for x in ratios) / len(ratios)
        low, high = bands.limits(len(body))
        assert got[i]["odd_chunk_share"] == pytest.approx(odd) and got[i]["ratio"] == pytest.approx(ratio(body))
        assert max(ratios) == ratios[-1] or i == 1  # the repetitive end is a chunk
        assert not got[i]["base_failed"] and got[i]["kept"] == (low <= ratio(body) <= high and odd < bands.chunk_share and max(ratios) <= bands.chunk_extreme)


def test_keep_good(docs):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    want = Counter(r["doc_id"] for r in quality.compression_bands(docs).where("kept").collect())
    assert Counter(r["doc_id"] for r in kept.collect()) == want


# ---------------------------------------------------------------- 4


def test_sharding(docs, rows):
    out = sharding.assign_shards(docs, [1.0] * 8).toPandas()
    assert sorted(out["size"]) == sorted(len(encoded(t)) + 16 for _, t in rows)
    assert sorted(out.text_crc32) == sorted(zlib.crc32(encoded(t)) for _, t in rows)
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert ((out.grown_shard == out.shard) | (out.grown_shard == 8)).all()
    grown = sharding.assign_shards(docs, [1.0] * 9).toPandas()
    key = ["doc_id", "text_crc32"]
    assert rows_of(out[[*key, "grown_shard"]].rename(columns={"grown_shard": "shard"})) == rows_of(grown[[*key, "shard"]])


def test_sharding_of_crowded_keys(spark):
    """A third of all rows without an id, a third of one id and text."""
    rows = [(k, f"text {k}") for k in range(400)] + [(None, f"none {k % 150}") for k in range(400)] + [(77, "same")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    plain = sharding.assign_shards(df, [1.0] * 4).toPandas()
    out = sharding.assign_shards(df, [1.0] * 4, hot_rows=50).toPandas()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    columns = ["doc_id", "size", "text_crc32", "shard", "grown_shard"]
    assert rows_of(out[columns]) == rows_of(plain[columns])
    assert len(out) == 1200
    one = sharding.assign_shards(df.where("doc_id = 77"), [1.0] * 4, hot_rows=50).toPandas()
    assert one["shard"].nunique() == 1 and sorted(one.slot) == list(range(401))


def test_sharding_follows_weights(spark):
    df = spark.range(20000).selectExpr("id AS doc_id", "'x' AS text")
    n = sharding.assign_shards(df, [1.0, 2.0, 0.0, 5.0]).groupBy("shard").count().toPandas().set_index("shard")["count"]
    assert 2 not in n.index and abs(n[3] / 20000 - 5 / 8) < 0.02 and abs(n[1] / 20000 - 2 / 8) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous_choice(df.doc_id, [0.0])


# ---------------------------------------------------------------- 5


def test_chat_round_trip(spark):
    import public_tokenizers

    file = public_tokenizers.path("byte_bpe_50k.json")
    encoder = chatformat.ChatEncoder(file)
    rnd = random.Random(5)
    parts = ["[INST]", "[/INST]", "</s>", "<s>", "<|endoftext|>", "\\", "[", "<", "a", " ", "\n", "é", "🎉", "日", "/", ">", "  the", "INST]", "\t", "́"]
    rows, n = [], 0
    for c in range(300):
        turns = [(rnd.choice(["user", "assistant", "system", "[INST]"]), "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))) for _ in range(rnd.randint(1, 5))]
        done = chatformat.format_conversation(turns, encoder)
        assert chatformat.parse(done["formatted"]) == turns
        loss = chatformat.unescape(chatformat.masked_text(done["formatted"], done["offsets"], done["loss_mask"]))
        assert loss == "".join(t for r, t in turns if r == "assistant")
        rows += [(c, i, r, t, "x") for i, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", None, "x"), (None, 1, None, "y", "x"), (None, None, "assistant", "first", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string").repartition(5)
    whole = chatformat.conversation_digests(df, file)
    same(chatformat.conversation_digests(df, file, segment_chars=5).collect(), [tuple(r) for r in whole.collect()])
    by = defaultdict(list)
    for c, t, r, x, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        by[c].append((r or "", x or ""))
    got = {r["conv_id"]: r for r in whole.collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chatformat.conversation_digests(df.limit(0), file).count() == 0


# ---------------------------------------------------------------- 6


def test_language_model_learns(spark):
    rnd = random.Random(4)
    grammar = lambda n: " ".join(f"s{(k := rnd.randrange(12))} v{k} o{k}" for _ in range(n))  # noqa: E731, F841
    rows = [(i, grammar(60)) for i in range(400)]
    held = [grammar(60) for _ in range(20)]
    mixed = []
    for t in held:
        w = t.split()
        rnd.shuffle(w)
        mixed.append(" ".join(w))
    train = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    vocabulary, model = lmscore.fit(lmscore.id_and_bytes(train))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(held + mixed)] + [(99, None), (98, " \n")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lmscore.score(df, vocabulary, model).collect()}
    good = np.mean([got[i]["mean_log_prob"] for i in range(20)])
    bad = np.mean([got[i]["mean_log_prob"] for i in range(20, 40)])
    assert good > bad + 0.5 and good > np.log(1 / 36) + 0.5  # better than the unigram model
    assert got[99]["n_tokens"] == 0 and got[99]["log_prob"] == 0 and got[99]["mean_log_prob"] is None
    assert got[0]["log_prob"] == pytest.approx(got[0]["mean_log_prob"] * got[0]["n_tokens"])


def test_language_model_sums_to_one():
    model = lmscore.Model.unigram(np.arange(lmscore.SIZE))
    around = np.full((lmscore.SIZE, 4), 7)
    assert np.exp(model.log_probs(around, np.arange(lmscore.SIZE))).sum() == pytest.approx(1, abs=1e-4)


def test_language_model_words_of_a_bucket(spark):
    bucket = lambda w: zlib.crc32(w.encode()) % (lmscore.SIZE - lmscore.KNOWN)
    twice, once, unseen = [w for w in (f"rare{i}" for i in range(20_000)) if bucket(w) == 7][:3]
    often = " ".join(f"w{i}" for i in range(lmscore.KNOWN))
    rows = [(0, often), (1, often), (2, often), (3, twice), (4, twice), (5, once), (6, "w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    vocabulary, model = lmscore.fit(lmscore.id_and_bytes(df))
    new = spark.createDataFrame([(3, twice), (5, once), (7, unseen), (8, f"{once}  {once}"), (9, "w1")], "doc_id long, text string")
    got = {r["doc_id"]: r["log_prob"] for r in lmscore.score(new, vocabulary, model).collect()}
    assert got[3] - got[5] == pytest.approx(np.log(2)) and got[5] - got[7] == pytest.approx(np.log(2))
    around = np.full((1, 4), lmscore.PAD)
    alone = model.log_probs(around, np.array([lmscore.KNOWN + 7]))[0]
    assert got[5] == pytest.approx(alone + np.log(1 / 3.5), abs=1e-5)
    assert got[9] == pytest.approx(model.log_probs(around, np.array([vocabulary[b"w1"]]))[0], abs=1e-5)
    every = {r["doc_id"]: r["log_prob"] for r in lmscore.pseudo_likelihood(df).collect()}
    assert every[3] == pytest.approx(every[4]) and every[3] - every[5] == pytest.approx(np.log(2))


def test_language_model_trains_on_every_word(rows, monkeypatch):
    trained = Counter()
    monkeypatch.setattr(lmscore.Model, "step", lambda self, around, target, memory: trained.update(target.tolist()))
    known = {w: i for i, w in enumerate(sorted({w for _, t in rows for w in lmscore.words_of(encoded(t))})[: lmscore.KNOWN])}
    sent = SimpleNamespace(value=(known, lmscore.Model.unigram(np.ones(lmscore.SIZE)).flatten()))
    list(lmscore._train(sent)(iter([pa.RecordBatch.from_pydict({"body": [encoded(t) for _, t in rows]})])))
    vocabulary = lmscore.Vocabulary(known)
    assert trained == Counter(vocabulary[w] for _, t in rows for w in lmscore.words_of(encoded(t)))


def test_language_model_remembers_places(spark):
    """Rare words between the same neighbours elsewhere, against a plain count."""
    bucket = lambda w: zlib.crc32(w.encode()) % (lmscore.SIZE - lmscore.KNOWN)
    a, b, c = [w for w in (f"rare{i}" for i in range(20_000)) if bucket(w) == 7][:3]
    other = next(w for w in (f"odd{i}" for i in range(100)) if bucket(w) != 7)
    often = " ".join(f"w{i}" for i in range(lmscore.KNOWN))
    rows = [(i, often) for i in range(8)]
    texts = [f"w1 w2 {a} w3 w4", f"w1 w2 {a} w3 w4", f"w1 w2 {b} w3 w4 {a} w5 w6", f"w1 w2 {other} w3 w4", f"{a} w1", f"w9 w2 {c} w3 w4", "w1"]
    rows += [(10 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    vocabulary, model = lmscore.fit(lmscore.id_and_bytes(df))
    plain = {r["doc_id"]: r["log_prob"] for r in lmscore.score(df, vocabulary, model).collect()}
    got = {r["doc_id"]: r["log_prob"] for r in lmscore.score(df, vocabulary, model, trained=True).collect()}
    n = Counter(w for _, t in rows for w in t.split())
    size = sum(k for w, k in n.items() if bucket(w) == 7 and not w.startswith("w")) + lmscore.UNSEEN
    counted = Counter()
    for _, t in rows:
        w = t.split()
        counted.update((*w[i - 2 : i], *w[i + 1 : i + 3], bucket(w[i]), w[i]) for i in range(2, len(w) - 2) if w[i][0] != "w")
    for i, t in rows:
        w, gain = t.split(), 0.0
        for k in range(2, len(w) - 2):
            if w[k][0] == "w":
                continue
            place = (*w[k - 2 : k], *w[k + 1 : k + 3], bucket(w[k]))
            same, others = counted[*place, w[k]] - 1, sum(x for p, x in counted.items() if p[:5] == place) - 1
            gain += np.log((n[w[k]] + same * size) / (1 + others) / n[w[k]])
        assert got[i] - plain[i] == pytest.approx(gain, abs=1e-6)
    assert got[10] == pytest.approx(got[11]) and got[13] == pytest.approx(plain[13])


def test_language_model_counts_sent_or_joined(spark, rows, monkeypatch):
    df = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "doc_id long, text string").repartition(2)
    sent = None
    for rare, cached in ((1_000_000, 0), (0, 1 << 18), (0, 5)):
        monkeypatch.setattr(lmscore, "RARE", rare)
        monkeypatch.setattr(lmscore, "CACHED", cached)
        monkeypatch.setattr(lmscore, "KNOWN", 3072)
        vocabulary, _ = lmscore.fit(lmscore.id_and_bytes(df), rounds=1)
        words = sorted({w for _, t in rows for w in lmscore.words_of(encoded(t))})
        few = lmscore.Vocabulary({w: i for i, w in enumerate(words[:4])} | {w: v for w, v in vocabulary.items() if v > lmscore.NUMBER})
        few.counted, few.logs, few.buckets = vocabulary.counted, vocabulary.logs, np.full(1024, 50.0)
        got = {r["doc_id"]: r["log_prob"] for r in lmscore.score(df, few, lmscore.Model.unigram(np.ones(lmscore.SIZE))).collect()}
        assert sent is None or got == pytest.approx(sent)
        sent = got


def test_language_model_against_plain_loops():
    rng = np.random.default_rng(3)
    model = lmscore.Model.unigram(rng.integers(1, 50, lmscore.SIZE))
    for k in ("class_embed", "shift"):
        model.arrays[k] += rng.normal(0, 0.2, lmscore.SHAPES[k]).astype(np.float32)
    ids = rng.integers(0, lmscore.SIZE, 9)
    sequence = np.concatenate([[lmscore.PAD] * 2, ids, [lmscore.PAD] * 2])
    (around, target), = lmscore.slices(sequence, np.flatnonzero(sequence != lmscore.PAD))
    got = model.log_probs(around, target)
    m = {k: v.astype(np.float64) for k, v in model.arrays.items()}
    softmax = lambda x: x - np.log(np.exp(x).sum())
    for i, t in enumerate(ids):
        near = [sequence[2 + i + k] for k in (-2, -1, 1, 2)]
        h = np.tanh(sum(m["embed"][w] * m["scale"][k] for k, w in enumerate(near)) + m["shift"])
        c, p = divmod(int(t), 64)
        want = softmax(h @ m["to_class"] + m["class_bias"])[c] + softmax((h + m["class_embed"][c]) @ m["to_place"] + m["place_bias"][c])[p]
        assert got[i] == pytest.approx(want, abs=1e-4)
    # one step from an empty memory moves every parameter against its gradient, whose size the memory holds
    before, memory = model.copy(), {k: np.zeros(s, np.float32) for k, s in lmscore.SHAPES.items()}
    model.step(around, target, memory)
    for name, shape in lmscore.SHAPES.items():
        used = np.flatnonzero(memory[name].ravel() > 1e-6)
        for at in rng.choice(used, min(6, len(used)), replace=False):
            moved = [before.copy(), before.copy()]
            for one, step in zip(moved, (1e-2, -1e-2)):
                one.arrays[name].reshape(-1)[at] += step
            slope = -(moved[0].log_probs(around, target).mean() - moved[1].log_probs(around, target).mean()) / 2e-2
            assert np.sqrt(memory[name].ravel()[at]) == pytest.approx(abs(slope), rel=0.05, abs=2e-4)
            assert (model.arrays[name].ravel()[at] < before.arrays[name].ravel()[at]) == (slope > 0)


def test_language_model_rows(docs, rows, empty):
    got = lmscore.pseudo_likelihood(docs).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, len(encoded(t).split())) for i, t in rows)
    assert lmscore.pseudo_likelihood(empty).count() == 0


# ---------------------------------------------------------------- 7


def test_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [array("I", [*library.encode(t or "", add_special_tokens=False).ids, 2]).tobytes() for _, t in rows]
    out = packing.pack_documents(docs, packing.ranks_file(), group_docs=50).toPandas()
    want = []
    for (i, _), x in zip(rows, ids):
        n = len(x) // 4
        size = n if n <= 1024 else n % 1024 or 1024
        at, piece = 0, 0
        while at < n:
            want.append((i, piece, at, size, zlib.crc32(x[4 * at : 4 * (at + size)])))
            at, piece, size = at + size, piece + 1, 1024
    have = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()]
    assert Counter(have) == Counter(want)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024
    assert out.sequence_id.nunique() <= sum(len(x) // 4 for x in ids) / 1024 * 1.15 + 4


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_respects_every_capacity(rule):
    lengths = np.random.default_rng(1).integers(1, 101, 500)
    capacity = packing.Capacity(tokens=200, documents=4, attention=15000, weights=(1.0, 1.0, 1.0), rule=rule)
    bins, offsets = packing.pack(lengths, capacity)
    for b in set(bins):
        own = lengths[bins == b]
        assert own.sum() <= 200 and len(own) <= 4 and (own**2).sum() <= 15000
        own = own[np.argsort(offsets[bins == b])]
        assert list(np.sort(offsets[bins == b])) == list(np.cumsum(own) - own)
    with pytest.raises(ValueError):
        packing.pack(np.array([201]), capacity)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_against_plain_best_fit(rule):
    """Each piece, longest first, in the open bin of the best score; every capacity turns some bin down."""
    lengths = np.random.default_rng(5).integers(1, 101, 300)
    capacity = packing.Capacity(tokens=140, documents=3, attention=11000, weights=(1.0, 0.5, 0.7), rule=rule)
    caps = (140.0, 3.0, 11000.0)
    scale = [w / c for w, c in zip(capacity.weights, caps)]
    bins, refused = [], Counter()
    for size in sorted(lengths.tolist(), reverse=True):
        demand = (size, 1, size * size)
        best = None
        for b in bins:
            over = [k for k in range(3) if b["left"][k] < demand[k]]
            refused.update(over if len(over) == 1 else ())
            if over:
                continue
            if rule == "dot":
                score = -sum(x * d * f * f for x, d, f in zip(b["left"], demand, scale))
            else:
                score = sum(((x - d) * f) ** 2 for x, d, f in zip(b["left"], demand, scale))
            if best is None or score < best[0] - 1e-12:
                best = (score, b)
        if best is None:
            best = (0, {"left": list(caps), "own": []})
            bins.append(best[1])
        best[1]["own"].append(size)
        best[1]["left"] = [x - d for x, d in zip(best[1]["left"], demand)]
    assert set(refused) == {0, 1, 2}
    placed, _ = packing.pack(lengths, capacity)
    got = sorted(sorted(lengths[placed == b].tolist()) for b in set(placed.tolist()))
    assert abs(len(got) - len(bins)) <= 1  # ties may fall either way
    assert sum(x in [sorted(b["own"]) for b in bins] for x in got) > 0.6 * len(got)


def test_packing_encodes_like_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.ByteLevelEncoder(packing.ranks_file())
    rnd = random.Random(1)
    parts = [" ", "\n", "a", "th", "é", "the", "日", "\t", ".", "1", "  ", "ing", "<s>", "🎉", "<|endoftext|>", "'s", "　", "\x85", "\x1c", "\r", "!!", "x.y"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert list(array("I", own.encode(t))) == library.encode(t, add_special_tokens=False).ids
    letters = "abcXYZéßñøłжд日ªⅣ²٣'’s"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 7))) + "".join(rnd.choice(packing.TRAILING + "<>|'") for _ in range(rnd.randint(0, 3))) for _ in range(4000)]
    texts = [t + rnd.choice([" ", "\n", ""]) + u for t, u in zip(texts, reversed(texts))]
    assert own.encode_all(texts) == [array("I", library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    words = ["\n" + t if rnd.random() < 0.3 else t for t in texts if " " not in t and "\n" not in t]
    own._learn(words)
    assert all(list(array("I", own.known[w])) == library.encode(w if w[0] == "\n" else " " + w, add_special_tokens=False).ids for w in words if w in own.known)
    assert len(own.known) > 1000


# ---------------------------------------------------------------- 8


def test_token_counts(docs, rows):
    import public_tokenizers
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=file)
    want = [(i, len(encoded(t)), n := len(library.encode(t or "")), n > 4096) for i, t in rows]
    same(tokencount.token_counts(docs, file).collect(), want)
    own = tokencount.MergeCounter(file)
    rnd = random.Random(1)
    parts = [" ", "\n", "a", "b", "th", "é", "▁", "the", "日", "\t", ".", "1", "  ", "ing", "<s>", "🎉", "\x00"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert own.count(t) == len(library.encode(t))


# ---------------------------------------------------------------- 9


def brute_repeats(rows, length):
    docs = sorted({r for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len({r[0] for r in docs}) >= len(docs) - 1
    seen, out = set(), {}
    for r in docs:
        b = encoded(r[1])
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[r] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"large_bucket": 3, "sort_rows": 40}, {"length": 40, "gram": 8}])
def test_repeated_bytes(spark, rows, options):
    rows = [r for r in rows if r[0] is not None or r[1].startswith("no id")]
    rnd = random.Random(8)
    stem = "".join(rnd.choice("abcd efé") for _ in range(300))
    for k in range(60):
        t = list(stem)
        for _ in range(rnd.randint(0, 4)):
            t[rnd.randrange(300)] = rnd.choice("xyz")
        rows.append((600 + k, "".join(t[rnd.randrange(100) :])))
    rows += [(700, "a" * 500), (701, "a" * 300 + "b"), (702, "ab" * 300)]
    df = spark.createDataFrame([(*r, "?") for r in rows], "doc_id long, text string, bucket string").repartition(3)
    want = brute_repeats(rows, options.get("length", 100))
    same(suffixdedup.repeated_bytes(df, **options).collect(), [(r[0], *want[r]) for r in rows])


def test_repeated_bytes_of_many_equal_rows(spark):
    rnd = random.Random(8)
    stem = "".join(rnd.choice("abcdefgh ") for _ in range(260))
    changed = stem[:130] + "#" + stem[131:]
    rows = [(1, stem)] * 150 + [(None, changed)] * 150 + [(2, changed[100:])] * 3
    want = brute_repeats(rows, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(suffixdedup.repeated_bytes(df, sort_rows=10).collect(), [(r[0], *want[r]) for r in rows])


def test_repeated_bytes_across_segments(spark):
    """A text longer than a segment, with a passage that lies on the border of two."""
    rnd = random.Random(12)
    noise = lambda n: "".join(rnd.choices("abcdefghijklmnop", k=n))
    passage = "#" + noise(298) + "#"
    edge = suffixdedup.SEGMENT
    text = noise(1000) + "1" + passage + "2" + noise(edge - 1302 - 151) + "3" + passage + "4" + noise(5000) + "5" + passage
    assert text.index("3#") + 1 == edge - 150
    rows = [(1, text), (2, "6" + passage + "7"), (3, passage[:120]), (4, passage[:99])]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixdedup.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (len(text), 600, 2), 2: (302, 300, 1), 3: (120, 120, 1), 4: (99, 0, 0)}


def test_suffix_ranks():
    rnd = np.random.default_rng(3)
    rows = rnd.integers(97, 99, (60, 64)).astype(np.uint8)
    rows[30:40] = rows[:10]
    for c, rank in suffixdedup.sample_ranks(rows).items():
        order = sorted(range(60), key=lambda i: rows[i, c:].tobytes())
        assert all(rank[a] <= rank[b] and (rank[a] == rank[b]) == (rows[a, c:].tobytes() == rows[b, c:].tobytes()) for a, b in zip(order, order[1:]))
    period, cover = suffixdedup.PERIOD, suffixdedup.COVER
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


# ---------------------------------------------------------------- 10


def plain_words(text):
    import re

    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in encoded(text)))


def brute_hits(text, items):
    w = plain_words(text)
    hit, found = set(), set()
    for name, item in items:
        v = plain_words(item)
        n = min(8, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2


@pytest.mark.parametrize("shard", [2_000_000, 30])
def test_contamination(spark, docs, rows, shard):
    rnd = random.Random(9)
    items = [(i, " ".join((rows[rnd.randrange(60)][1] or "").split()[: rnd.randint(3, 40)])) for i in range(30)]
    items += [(30, None), (31, ""), (32, "An, BER"), (33, "aln"), (34, items[0][1]), (35, "aln aln aln aln aln aln aln aln aln")]
    got = decontaminate.contamination(docs, spark.createDataFrame([(*i, 1) for i in items], "item_id int, text string, state int"), max_shard_words=shard)
    same(got.collect(), [(i, *brute_hits(t, items)) for i, t in rows])


def test_leaks_are_cut_out(spark):
    item = "one two three four five six seven eight nine"
    df = spark.createDataFrame([(1, "Clean text, all of it"), (2, "before it. ONE two; three four five six\nseven eight nine! after " + "more " * 9), (3, item), (4, None)], "doc_id long, text string")
    out = {r[0]: r[1] for r in decontaminate.remove_leaks(df, spark.createDataFrame([(1, item)], "item_id int, text string")).collect()}
    assert out == {1: "Clean text, all of it", 2: "before it. ! after " + "more " * 9, 4: None}
    items = spark.createDataFrame([(k, w) for k, w in enumerate([item, "nothing", "all of it", "one two"])], "item_id int, text string")
    cut = lambda n: sorted(map(repr, decontaminate.remove_leaks(df, items, max_shard_words=n).collect()))
    assert cut(1) == cut(4) == cut(1000)


def test_automaton_against_substrings():
    rnd = random.Random(6)
    for _ in range(50):
        items = [(str(i), [bytes([rnd.choice(b"abc")]) for _ in range(rnd.randint(1, 12))]) for i in range(4)]
        automaton = decontaminate.SuffixAutomaton(items, window=3)
        words = [bytes([rnd.choice(b"abcd")]) for _ in range(40)]
        spans, found = automaton.scan(words)
        want, names = set(), set()
        for name, v in items:
            n = min(3, len(v))
            for i in range(len(words) - n + 1):
                if any(words[i : i + n] == v[k : k + n] for k in range(len(v) - n + 1)):
                    want.add((i, i + n))
                    names.add(name)
        assert set(spans) == want and found == names


# ---------------------------------------------------------------- all


def test_empty_tables(spark, empty):
    import public_tokenizers

    items = spark.createDataFrame([], "item_id int, text string")
    frames = [
        linededup.line_dedup(empty),
        linededup.without_repeated_runs(empty),
        simhash.near_duplicates(empty),
        simhash.one_of_each(empty),
        similar.one_of_each(empty),
        quality.compression_bands(empty),
        quality.keep_good(empty),
        sharding.assign_shards(empty, [1.0, 1.0]),
        packing.pack_documents(empty, packing.ranks_file()),
        tokencount.token_counts(empty, public_tokenizers.path("piece_bpe_32k.model")),
        suffixdedup.repeated_bytes(empty),
        decontaminate.contamination(empty, items),
        decontaminate.remove_leaks(empty, items),
    ]
    assert all(f.count() == 0 for f in frames)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_sql(spark, name):
    got = queries.QUERIES[name](spark, f"{DATA}/{SF}").toPandas()
    assert rows_of(got) == rows_of(duck(SF).execute(queries.ORACLES[name]).to_arrow_table().to_pandas())
