import numpy as np
import pytest
from plain import SCHEMA, components, corpus, repeated_bytes, repeated_words, words
from pyspark.sql import functions as F

from granary.llm import blockdedup, common, neardup, suffixdedup
from granary.llm.common import connected_components, word_hashes, word_spans


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, width, percent):
    rows = corpus()
    want = components(rows, width, percent)
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), width, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_in_a_large_group(spark, monkeypatch):
    """Many copies of one text, each with its own edits: links between copies must not depend on a centre."""
    import random

    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "GROUP", 8)
    rng, rows = random.Random(4), []
    base = words(rng, 120).split()
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 5, 7])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w), None, None, None, None, None, None))
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(rows, 3, 85)


def test_scratch_tables_have_few_files(spark, monkeypatch, tmp_path):
    """Many near-empty shuffle partitions; every file of a table costs the executors a few forks."""
    monkeypatch.setattr(common, "scratch_dir", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(common, "CORE_FILES", 1)
    rows, held = corpus(), {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = neardup.near_duplicates(docs, 3, 85).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = components(rows, 3, 85)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    files = {d.name: len(list(d.glob("part-*.parquet"))) for d in (tmp_path / "granary").iterdir()}
    assert len(files) > 10 and max(files.values()) <= spark.sparkContext.defaultParallelism, files


def test_rows_that_share_an_id_keep_the_links_of_all_their_texts(spark):
    import random

    rng = random.Random(9)
    a, b = words(rng, 40), words(rng, 60)
    rows = [(1, a), (1, b), (2, b), (3, b), (4, a), (4, a)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((r[0], 1) for r in rows)
    many = [(rng.randrange(40), r[1]) for r in corpus(6) if r[0] is not None]
    want = components([(i, t) for i, (_, t) in enumerate(many)], 3, 85)
    parent = {i: i for i in range(40)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, _) in enumerate(many):
        x, y = root(d), root(many[want[i][1]][0])
        parent[max(x, y)] = min(x, y)
    top = {d: min(e for j, (e, _) in enumerate(many) if want[j][0] and root(e) == root(d)) for d in {d for i, (d, _) in enumerate(many) if want[i][0]}}
    got = neardup.near_duplicates(spark.createDataFrame(many, "doc_id long, text string").repartition(4), 3, 85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted((d, want[i][0], top[d] if want[i][0] else d) for i, (d, _) in enumerate(many))


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    multiply, add = neardup._constants(400)
    a, b = rng.integers(0, 1 << 63, 3000).astype(np.uint64), rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    x, y = np.unique(np.concatenate([a, b[:500]])), np.unique(np.concatenate([a[:2500], b[500:]]))
    rx, ry = neardup.registers(x, multiply, add), neardup.registers(y, multiply, add)
    assert (np.maximum(rx, ry) == neardup.registers(np.union1d(x, y), multiply, add)).all()
    grid = np.linspace(0.01, 1, 200)
    counts = [np.array([v.sum()]) for v in (rx > ry, rx < ry, rx == ry)]
    best = grid[neardup.likelihood(*counts, np.array([float(len(x))]), np.array([float(len(y))]), grid).argmax()]
    assert abs(best - len(np.intersect1d(x, y)) / len(np.union1d(x, y))) < 0.08


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], ["a", "b"])
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


@pytest.mark.parametrize(("window", "gram", "hot"), [(400, 128, 50_000), (60, 20, 50_000), (60, 20, 2), (400, 64, 3)])
def test_suffix_dedup_against_brute_force(spark, window, gram, hot):
    rows = corpus(2)
    got = suffixdedup.remove_repeated_bytes(spark.createDataFrame(rows, SCHEMA).repartition(3), window, gram, hot, parts=8).collect()
    key = lambda x: str(x)
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got], key=key) == sorted([(r[0], *w) for r, w in zip(rows, repeated_bytes(rows, window))], key=key)


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    """Every anchor of a long text comes once, with the windows on both sides of a cut."""
    import random

    rng = random.Random(11)
    raw = [words(rng, 900).encode(), b"x" * 2500, words(rng, 3).encode(), b"ab " * 900]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])

    def found(chunk):
        monkeypatch.setattr(suffixdedup, "CHUNK", chunk)
        return [(int(i + r), *map(int, x)) for i, (row, *rest) in suffixdedup.row_anchors(data, ends, 400, 128) for r, x in zip(row, zip(*rest))]

    whole = found(1 << 21)
    assert found(700) == whole and found(300) == whole


def test_repeats_beside_the_cuts_of_a_long_text(spark):
    """Passages whose windows start just after the first cut and just before the second."""
    import random

    rng = random.Random(12)
    cut, one, two = suffixdedup.CHUNK, words(rng, 200)[:400], words(rng, 200)[:400]
    fill = rng.randbytes(cut + 1000).hex()
    long = fill[:cut] + one + fill[cut : 2 * cut - 401] + two + fill[2 * cut - 401 :]
    assert long.index(one) == cut and long.index(two) == 2 * cut - 1 and len(long) > 2 * cut
    rows = [(1, long), (2, "<" + one + ">"), (3, "<" + two + ">")]
    got = suffixdedup.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in got} == {1: (800, 2), 2: (400, 1), 3: (400, 1)}


#: Two 128-grams whose hashes are 0x4607a26b73933e and 0x4607a26b706188: alike but for their low 22 bits, and lower than most.
ALIKE = (
    "gjelzmjtqxmekzjmsrnxzsnhsqsvgncxvzmohaepbbksejacixtrczhenkyqscdaidqnznyouxcjewnwzkysgblkxqobfbgxachiazdvcmhgjqmuynhgxdnmalqevnhx",
    "phljxxigakyhxqkintxjxqnjiwgaotstckokisapqjbeacusdxcrtfcdtsnmbtddadknqkmcsuzuvvwwteyaxgvcmrbqkhnokklcelcjihwwokxlvdqzowucyqppggpr",
)


def test_repeat_whose_smallest_grams_nearly_tie(spark):
    """A string has the same anchor in a long text as in a short one, though the long one has more places to tell apart."""
    import random

    rng = random.Random(0)
    fill = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    a, b = (int(suffixdedup.gram_hashes(np.frombuffer(x.encode(), np.uint8), 128)[0]) for x in ALIKE)
    assert a > b and a >> 22 == b >> 22
    passage = fill(40) + ALIKE[0] + fill(40) + ALIKE[1] + fill(64)
    rows = [(1, fill(2_200_000) + passage), (2, passage)]
    got = suffixdedup.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in got} == {1: (400, 1), 2: (400, 1)}


def test_suffix_groups_of_many(monkeypatch):
    """The sweep over classes of a large group equals pairwise comparison."""
    import random

    rng = random.Random(9)
    gram = b"G" * 8
    suffixes = {}
    for _ in range(60):
        right, left = gram + bytes(rng.choice(b"ab") for _ in range(12)), bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12)))
        suffixes.setdefault((right, left), []).append((len(suffixes), 0, 100))
    order = sorted(suffixes)
    rights, lefts, owners = [k[0] for k in order], [k[1] for k in order], [suffixes[k] for k in order]
    lcps = [0, *[suffixdedup.common(a, b, 0) for a, b in zip(rights, rights[1:])]]

    def windows(few):
        monkeypatch.setattr(suffixdedup, "FEW", few)
        return {(k, s) for k, _, a, b in suffixdedup.resolve(rights, lefts, lcps, owners, 20) for s in range(a, b + 1)}

    assert windows(1000) == windows(0)


def test_loser_tree_merges_runs():
    import random

    rng = random.Random(2)
    runs, every = [], []
    for r in range(5):
        texts = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 8))) for _ in range(20)})
        every += texts
        runs.append(suffixdedup.Run(suffixdedup.front_code([(t, t[::-1], [(r, 0, i)]) for i, t in enumerate(texts)])))
    out = list(suffixdedup.merge(runs))
    assert [x[1] for x in out] == sorted(every) and all(x[2] == x[1][::-1] for x in out)
    assert [x[0] for x in out[1:]] == [suffixdedup.common(a[1], b[1], 0) for a, b in zip(out, out[1:])]


@pytest.mark.parametrize("window", [50, 7])
def test_block_dedup_against_brute_force(spark, window):
    rows = corpus(3)
    got = blockdedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4), window).collect()
    key = lambda x: str(x)
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got], key=key) == sorted([(r[0], *w) for r, w in zip(rows, repeated_words(rows, window))], key=key)


def test_texts_that_share_an_id(spark):
    import random

    t = words(random.Random(1), 80)
    rows = [(1, t), (5, "x y " + t), (5, "other text of five words")]
    got = {(r["n_words"], r["n_removed"]) for r in blockdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(80, 0), (82, 80), (5, 0)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert neardup.near_duplicates(none).count() == 0
    assert suffixdedup.remove_repeated_bytes(none).count() == 0
    assert blockdedup.remove_repeats(none).count() == 0


def test_words_follow_the_contract():
    import re

    texts = [" a\x0bb\tc ", "", "é ü", "x", "  ", "tail is one"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([0, *map(len, raw)])
    starts, stops, cut = word_spans(data, ends)
    whole = data.tobytes()
    got = [[whole[s:t].decode() for s, t in zip(starts[a:b], stops[a:b])] for a, b in zip(cut, cut[1:])]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    one, _ = word_hashes(np.frombuffer(b"Ab aB ab", np.uint8), np.array([0, 8]), True)
    assert len(set(one.tolist())) == 1


def test_sets_stream_past_their_classes(spark):
    docs = spark.createDataFrame([(i, f"a b c d {i}") for i in range(8)], "doc_id long, text string")
    wanted = docs.select(F.col("doc_id").alias("cid"), F.col("doc_id").alias("rep"), F.xxhash64("text").alias("th"))
    sets = neardup.full_sets(docs, wanted, 3, "doc_id", "text")
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort " not in plan
    got = {r["cid"]: len(r["codes"]) // 8 for r in sets.collect()}
    assert got == dict.fromkeys(range(8), 3)
