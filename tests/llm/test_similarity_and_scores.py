"""Similarity joins, classifiers, mixing and the pipeline against brute-force versions."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernlog.llm import common, components, embeddings, jaccard, mixing, quality, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t, width=5):
    w = WORD.findall((t or "").translate(LOW))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def classes(nodes, linked):
    """Smallest node reachable, by repeated relaxation."""
    name = {n: n for n in nodes}
    while True:
        before = dict(name)
        for a, b in linked:
            name[a] = name[b] = min(name[a], name[b])
        if name == before:
            return name


def brute_similar(texts, percent=80):
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    pairs = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return sets, classes(sets, pairs)


def check_similar(docs_of, texts):
    sets, name = brute_similar(texts)
    got = {r.doc_id: r for r in jaccard.similar_documents(docs_of(texts)).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), name[i]) for i, s in sets.items()}


def test_similar_documents(docs_of, prose):
    check_similar(docs_of, [*prose, None, "", " \n", "one two", "ONE two", "two one"])


def test_similar_documents_in_a_large_loose_family(docs_of):
    """Copies of one text with edits around the threshold: many pairs just above and just below it."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for _ in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(90)] = f"x{rng.randrange(30)}"
        texts.append(" ".join(words[rng.randrange(6) : 90 - rng.randrange(6)]))
    check_similar(docs_of, texts)


def test_matrix_opens_exactly_the_similar_pairs():
    rng = np.random.default_rng(2)
    universe = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = [np.sort(rng.choice(universe, rng.integers(20, 30), replace=False)) for _ in range(80)] + [np.sort(universe[:n]) for n in range(20, 60)]

    def group(which):
        n = np.array([len(sets[i]) for i in which])
        raw = np.concatenate([which, np.array(which) % 7, n]).astype(np.int64).tobytes() + np.concatenate([sets[i] for i in which]).tobytes()
        return jaccard._Group(raw, len(which))

    some = jaccard._Group(group([3, 5, 90]).only(np.array([0, 2])), 2)
    assert some.docs.tolist() == [3, 90] and some.tokens.tolist() == [*sets[3].tolist(), *sets[90].tolist()]
    one, two = list(range(0, 120, 2)), list(range(1, 120, 2))
    found = {(one[i], two[j]) for a, b in jaccard.open_groups(group(one), group(two), 60) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in one for j in two if i % 7 != j % 7 and 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}
    assert found == want and want


@pytest.mark.parametrize(("buckets", "deal"), [(7, 200), (5000, 10**6)])
def test_prune_counts_tokens_of_other_groups(buckets, deal, monkeypatch):
    """Whatever the buckets are, every set's tokens that occur in another group are counted, with at most a row for each entry."""
    monkeypatch.setattr(jaccard, "DEAL_ENTRIES", deal)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 3000, rng.integers(1, 60))).astype(np.uint64) for _ in range(80)]
    sets = [common.mixed(s) for s in sets]
    comp = np.arange(80) // 2

    def chunks():
        for a in range(0, 80, 16):
            part = sets[a : a + 16]
            yield np.arange(a, a + 16), comp[a : a + 16], np.concatenate([[0], np.cumsum([len(s) for s in part])]), np.concatenate(part)

    batches = list(jaccard._packed(chunks(), buckets))
    table = pa.Table.from_batches(batches)
    assert table.num_rows <= sum(map(len, sets)) and (buckets < 100 or table.num_rows > 500)
    hits = collections.Counter()
    for b in set(table.column("bucket").to_pylist()):
        out = jaccard._counted(table.filter(pa.array([x == b for x in table.column("bucket").to_pylist()])))
        for d, n in zip(out.column("doc").to_pylist(), out.column("hits").to_pylist(), strict=True):
            hits[d] += n
    for i, s in enumerate(sets):
        other = set().union(*(sets[j].tolist() for j in range(80) if comp[j] != comp[i]))
        assert hits[i] == sum(t in other for t in s.tolist())


def test_matrix_finds_links_between_groups(spark, monkeypatch):
    """Sets with one common part and edits, each a component of its own, in groups that cut families apart."""
    rng = np.random.default_rng(5)
    rows, sets = [], []
    for f in range(12):
        base = common.mixed(np.arange(1000 * f, 1000 * f + 60).astype(np.uint64))
        for _ in range(12):
            s = np.unique(np.concatenate([rng.choice(base, 60 - rng.integers(0, 10), replace=False), common.mixed(rng.integers(10**6, 2 * 10**6, rng.integers(0, 9)).astype(np.uint64))]))
            rows.append((len(sets), len(sets), len(s), s.view(np.int64).tolist()))
            sets.append(set(s.tolist()))
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    table = spark.createDataFrame(rows, "doc long, comp long, n long, tokens array<long>")
    known = classes(range(len(sets)), near)
    for group, asking in ((jaccard.GROUP_TOKENS, jaccard.ASKING), (1, 3)):  # then every set is a group, and all links come from asking
        monkeypatch.setattr(jaccard, "GROUP_TOKENS", group)
        monkeypatch.setattr(jaccard, "ASKING", asking)
        links = [tuple(r) for r in jaccard.matrix_links(table, 80, True).collect()]
        assert len(near) > 100 and len(links) > 20 and classes(range(len(sets)), links) == known
        first = [tuple(r) for r in jaccard.matrix_links(table, 80, False).collect()]
        assert first and all(known[a] == known[b] for a, b in first)


def test_spread_join_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    left = spark.range(30_000).select(F.when(F.col("id") < 15_000, F.lit(7)).otherwise(F.col("id")).cast("long").alias("k"), "id")
    right = left.where("k % 2 = 1").groupBy("k").agg(F.count(F.lit(1)).alias("w"), F.max("id").alias("m"))
    for how, n in (("inner", 15_000 + 7_500), ("left", 30_000)):
        got = common.spread_join(left, right, ["k"], right.count(), 30_000, "w", how)
        assert got.count() == n and got.where("m is not null").count() == 22_500 and got.columns == ["k", "id", "m"]


def test_sets_are_not_moved_or_written_again(spark, monkeypatch):
    """What a matrix looks up is worked out once, and sets get their components and drop out without a copy of all."""
    rng = np.random.default_rng(4)
    core = rng.integers(1, 1 << 60, 40)
    rows = [(i, i, 44, i, sorted({*core.tolist(), *rng.integers(1, 1 << 60, 4).tolist()})) for i in range(12)]
    table = spark.createDataFrame([(a, c, n, f, t) for a, c, n, f, t in rows], "doc long, comp long, n long, family long, tokens array<long>")
    plans, stored = [], jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, name, *a: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or stored(df, name, *a))
    linked = spark.createDataFrame([(0, 1), (2, 3)], "a long, b long")
    apart = jaccard._apart(table, linked, 80)
    assert {(r.doc, r.comp) for r in apart.collect()} == {(i, i - 1 if i in (1, 3) else i) for i in range(12)}
    found = jaccard.matrix_links(apart, 80, True)
    parent = list(range(12))
    for a, b in [(0, 1), (2, 3), *[(r.a, r.b) for r in found.collect()]]:
        x, y = parent[a], parent[b]
        parent = [min(x, y) if p in (x, y) else p for p in parent]
    assert set(parent) == {0}
    assert "found" in {n for n, _ in plans} and "grouped" not in {n for n, _ in plans}
    assert all("collect_list" not in p for n, p in plans if n != "found")


def test_scratch_tables_are_removed(spark, docs_of, prose):
    left = len(common._LEFT)
    assert jaccard.similar_documents(docs_of(prose)).count() == len(prose) and len(common._LEFT) == left + 1


def test_similar_edge_cases(edge, none):
    got = jaccard.similar_documents(edge).collect()
    assert len(got) == edge.count()
    named = {(r.doc_id, r.component_id) for r in got}
    assert (None, None) in named and (5, 4) in named and (10, 10) in named and (0, 0) in named
    assert jaccard.similar_documents(none).count() == 0
    left = jaccard.distinct_documents(edge)
    assert left.columns == edge.columns
    assert collections.Counter(r.doc_id for r in left.collect()) == collections.Counter(r.doc_id for r in edge.collect() if r.doc_id != 5)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes({n for e in edges for n in e}, edges)
    assert got == {n: c for n, c in want.items() if n in got} and all(want[n] == n for n in set(want) - set(got))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        v = rng.normal(size=24) if i % 3 or not rows else np.array(rows[rng.integers(len(rows))][1]) * rng.uniform(0.1, 9) + rng.normal(size=24) * rng.choice([0, 0.2, 0.45, 0.5])
        rows.append((1000 - i, v.tolist()))
    odd = [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] + [1.0] * 23), (2004, [None] + [1.0] * 23), (2005, [float("inf")] * 24), (None, rows[0][1]), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, rows[0][1])]
    table = spark.createDataFrame([(*r, 0, 1, 2) for r in rows + odd], "vec_id long, embedding array<double>, label int, n long, rep int")
    got = embeddings.near_vectors(table, block=64).collect()
    real = {i: np.array(v) / np.linalg.norm(v) for i, v in [*rows, *odd[-3:]]}
    links = [(a, b) for a in real for b in real if a < b and len(real[a]) == len(real[b]) and real[a] @ real[b] >= 0.9]
    count = collections.Counter(x for p in links for x in p)
    name = classes({r[0] for r in rows + odd if r[0] is not None}, links)
    assert len(got) == len(rows + odd) and len(links) > 100
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
        else:
            assert (r.n_links, r.component_id, r.kept) == (count[r.vec_id], name[r.vec_id], name[r.vec_id] == r.vec_id)
    assert embeddings.near_vectors(table.limit(0)).count() == 0


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 16)) * rng.choice([1e-9, 1, 1e9], (200, 1))
    x[100:] = x[:100] + rng.normal(size=(100, 16)) * np.abs(x[:100]).max(1, keepdims=True) * 0.2
    q, step, error, norm = embeddings.quantised(x)
    assert q.dtype == np.int8
    block = embeddings.Quantised(np.zeros(400, np.int64).tobytes() + np.concatenate([step, error, norm]).tobytes() + q.tobytes(), 200, 16)
    unit = embeddings.unit_vectors(x)
    assert (np.abs(unit @ unit.T - (block.q @ block.q.T) * block.step[:, None] * block.step) <= block.error[:, None] * block.norm + block.norm[:, None] * block.error + block.error[:, None] * block.error).all()
    for threshold in (0.9, 0.5, 0.0, -0.3):
        judged = {(i, j): s for a, b, sure in embeddings.judged_pairs(block, block, True, threshold) for i, j, s in zip(a, b, sure, strict=True)}
        for i in range(200):
            for j in range(i + 1, 200):
                near = unit[i] @ unit[j] >= threshold
                assert not near or (i, j) in judged
                assert near or not judged.get((i, j))
    assert 0 < len(judged)


def labelled(spark, docs_of, texts, name, values):
    other = "toxic" if name == "quality" else "quality"
    rows = [(i, v, 0) for i, v in enumerate(values)] + [(None, 1, 0), (0, None, 0)]
    return docs_of(texts), spark.createDataFrame(rows, f"doc_id long, {name} int, {other} int")


def test_quality(spark, docs_of, edge, none, prose):
    rng = random.Random(2)
    texts, values = [], []
    for i in range(400):
        t = rng.choice(prose)
        bad = i % 3 == 0
        texts.append(rng.choice([t.upper() + "!!", " ".join(f"{w}$$$" for w in t.split()), "spam spam " * 30]) if bad else t)
        values.append(int(not bad))
    docs, labels = labelled(spark, docs_of, texts, "quality", values)
    got = quality.score_quality(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    right = [r.predicted == values[r.doc_id] for r in got if r.held_out and len(texts[r.doc_id]) > 60]
    assert sum(right) / len(right) > 0.95
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}
    assert quality.score_quality(edge, labels).count() == edge.count() and quality.score_quality(none, labels).count() == 0
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_isotonic():
    rates = quality.isotonic(np.array([0, 3, 1, 0, 4, 0]), np.array([2, 4, 4, 0, 4, 0]))
    assert (np.diff(rates) >= 0).all() and rates[0] == 0 and rates[1] == rates[2] == 0.5 and rates[-1] == 1


def test_toxicity(spark, docs_of, edge, none, prose):
    rng = random.Random(6)
    texts, values = [], []
    for i in range(600):
        words = rng.choice(prose).lower().split()
        if i % 4 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["grumblefluff", "zortwad", "Quizzlemuck"]))
        texts.append(" ".join(words))
        values.append(int(i % 4 == 0))
    docs, labels = labelled(spark, docs_of, texts, "toxic", values)
    got = toxicity.score_toxicity(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    right = [r.predicted == values[r.doc_id] for r in got if r.held_out]
    assert sum(right) / len(right) > 0.97
    assert toxicity.score_toxicity(edge, labels).count() == edge.count() and toxicity.score_toxicity(none, labels).count() == 0
    assert max(r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()) < 0.5


def test_word_features_stay_within_words():
    feature, owner = toxicity.word_features([b"abc", b"x", "é".encode()])
    assert collections.Counter(owner.tolist()) == {0: 3 + 2 + 1, 1: 1, 2: 1}
    text, _ = toxicity.text_features(pa.array(["abc abc", "", None, "x"]))
    assert collections.Counter(text.tolist()) == {0: 6, 3: 1}


def test_mixing(spark, docs_of, edge, none, prose):
    rng = random.Random(8)
    texts = [rng.choice(prose) for _ in range(3000)]
    sources = [rng.choices(["big", "mid", "small", None], [60, 30, 8, 2])[0] for _ in texts]
    docs = docs_of(texts, sources=sources)
    got = mixing.mix_sources(docs)
    drawn = got.collect()
    assert [c for c in got.columns if not c.startswith("mix_")] == [c for c in docs.columns if c != "mix_tokens"]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": texts, "source": sources}))
    want = con.execute(mixing.SQL)
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in names) for r in drawn) == sorted(want.fetchall())
    total = sum(len(WORD.findall(t)) + 1 for t in texts)
    by = collections.Counter()
    for r in drawn:
        by[r.source] += r.mix_tokens
    assert abs(sum(by.values()) - total) < 0.02 * total
    p = np.array(list(by.values())) / sum(by.values())
    assert -(p * np.log(p)).sum() >= (mixing.TARGET_ENTROPY - 0.02) * np.log(4) or max(r.mix_epoch for r in drawn) >= 3
    assert mixing.mix_sources(edge).count() > 0 and mixing.mix_sources(none).count() == 0


def test_pipeline(spark, tmp_path, docs_of, prose):
    import corpus_pipeline as pipeline

    rng = random.Random(9)
    texts = [*prose, *(f"{rng.choice(prose)} mail me at a{i}@mail.example.com" for i in range(20)), *("JUNK JUNK!! $$$ " * rng.randint(5, 30) for _ in range(60)), None, ""]
    docs = docs_of(texts, sources=[rng.choice("aab") for _ in texts]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    values = [(i, int("JUNK" not in (t or "")), 0) for i, t in enumerate(texts)]
    spark.createDataFrame(values, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]
    table, seen = docs, []
    for _, stage in pipeline.STAGES[:-1]:
        table = common.stored(stage(spark, table, str(tmp_path)), "t")
        assert table.columns == docs.columns
        seen.append(table.collect())
    assert not any("JUNK" in (r.text or "") for r in seen[0]) and len(seen[0]) >= len(prose)
    first = {r.doc_id: r.text for r in seen[0]}
    order = sorted(first)
    _, name = brute_similar([first[i] for i in order])
    assert sorted(r.doc_id for r in seen[1]) == [i for k, i in enumerate(order) if name[k] == k]
    assert not any("@" in (r.text or "") for r in seen[2]) and len(seen[2]) == len(seen[1])
    assert {r.doc_id for r in seen[3]} <= {r.doc_id for r in seen[2]}
    packed = pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in packed if r.start == 0) == collections.Counter(r.doc_id for r in seen[3])
