"""Operators over a whole corpus against brute force: near duplicates, repeated strings, pieces."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from skyloom.llm import gru, ngram_join, piece_lattice, suffix_dedup
from skyloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(400)]
    base = [rng.choices(vocabulary, k=90) for _ in range(12)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    for k in range(120):
        ws = list(base[k % 12])
        for _ in range(rng.choice([0, 0, 1, 2, 4, 20])):
            ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
        rows.append((k, " ".join(ws) + ("\n" + passage if k % 7 == 0 else "")))
    rows += [(200, None), (201, ""), (202, "a b"), (203, "a  b"), (204, "x" * 3000), (None, rows[0][1]), (5, rows[5][1]), (5, "another text " * 9), (205, rows[3][1] + " ")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, class_id string, k int")


def shingles(text):
    ws = WORD.findall(text or "")
    return frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])


def groups(rows):
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        u = len(sets[a] | sets[b])
        if u == 0 or 5 * len(sets[a] & sets[b]) >= 4 * u:
            links[a] += 1
            links[b] += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(rows))], links


def test_ngram_join_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    root, links = groups(rows)
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min(x for x in (least.get(r), d) if x is not None) if d is not None or r in least else None
    want = sorted(((d, least[r], n) for (d, _), r, n in zip(rows, root, links, strict=True)), key=str)
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(frame(spark, rows)).collect()), key=str)
    assert got == want
    monkeypatch.setattr(ngram_join, "BLOCK", 5)  # groups over several blocks
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(frame(spark, rows)).collect()), key=str) == want


def test_keep_one(spark):
    rows = corpus()
    root, _ = groups(rows)
    kept = ngram_join.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "class_id", "k"]
    assert kept.count() == len(set(root))
    assert ngram_join.ngram_join(frame(spark, rows).limit(0)).count() == 0


def test_a_large_component_by_its_buckets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(12)
    ws = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(26):  # a chain: neighbours are similar, far ones aren't
        rows.append((k, " ".join(ws)))
        ws = ws[2:] + [f"n{k}a", f"n{k}b"]
    rows += [(100 + k, " ".join(rng.choices(["a", "b", "c"], k=1) + [f"c{j}" for j in range(80)])) for k in range(8)]
    root, links = groups(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(frame(spark, rows)).collect()}
    assert got == {d: (rows[r][0], n) for (d, _), r, n in zip(rows, root, links, strict=True)}


def test_hot_keys_by_broadcast(spark):
    from skyloom.llm.common import skew_join

    rows = spark.range(4000).selectExpr("IF(id < 3000, 'hot', concat('k', id % 700)) AS key", "id")
    sizes = rows.groupBy("key").count().withColumnRenamed("count", "n").withColumn("more", __import__("pyspark.sql.functions", fromlist=["x"]).length("key"))
    got = skew_join(rows, sizes, "key", 4000)
    assert got.columns == ["key", "id", "more"] and got.count() == 4000 and got.filter("key = 'hot'").count() == 3000
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()


def test_labels_name_every_partition(spark):
    from skyloom.llm.common import labels

    for n in (1, 7, 211):
        found = spark.createDataFrame([(x,) for x in labels(n).tolist()], "x int").selectExpr(f"pmod(hash(x), {n}) AS p").collect()
        assert [r["p"] for r in found] == list(range(n))


def test_recall_of_the_bands():
    rng = np.random.default_rng(6)
    found = total = 0
    for share in (0.8, 0.83, 0.86, 0.9):  # similarity of two sets of 900 hashes
        common = round(900 * 2 * share / (1 + share))
        for _ in range(60):
            h = rng.integers(0, 1 << 63, 1800 - common).astype(np.uint64)
            sets = np.concatenate([np.sort(h[:900]), np.sort(h[900 - common :])])
            bands = ngram_join.band_hashes(sets, np.array([0, 900, 1800]))
            found, total = found + bool((bands[0] == bands[1]).any()), total + 1
    assert found / total > 0.98


def test_tiles_equal_sets(monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 3)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = [np.sort(np.unique(np.where(rng.random(60) < 0.08, rng.integers(0, 1 << 60, 60).astype(np.uint64), base))) for _ in range(11)]
    links, _ = ngram_join._verify_group(np.zeros(11, int), np.ones(11, np.int64), sets)
    want = [sum(5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    assert links.tolist() == want


def test_components(spark):
    rng = random.Random(0)
    edges = [(f"n{rng.randrange(60):03}", f"n{rng.randrange(60):03}") for _ in range(45)] + [(f"p{k:03}", f"p{k + 1:03}") for k in range(20)] + [("p000", "p000"), (None, "p000")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if a and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("block", [1 << 17, 7])
def test_build_sorts_all_suffixes(tmp_path, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(1)
    for k in range(100):
        strings = [bytes(rng.choices(b"ab", k=rng.randint(1, 12))) for _ in range(rng.randint(1, 12))]
        width = max(map(len, strings))
        right = np.array([[0] * (width - len(s)) + [c + 1 for c in s] for s in strings], np.uint8)
        prefixes, owners, lengths = suffix_dedup.build(right, np.array([len(s) for s in strings]), str(tmp_path) if k % 2 else "none://memory")
        found = [strings[o][len(strings[o]) - n :] for o, n in zip(owners, lengths, strict=True)]
        assert found == sorted(found)
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert prefixes[1:].tolist() == [common(a, b) for a, b in itertools.pairwise(found)]
    assert not list(tmp_path.iterdir())


def removed(rows):
    first = {}
    for d, t in sorted(((d, t) for d, t in rows if d is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49 if d is not None else 0):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        out.append((d, len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [10**6, 2])
def test_repeated_strings_equal_brute_force(spark, hot):
    rows = corpus(5)
    assert sorted(map(tuple, suffix_dedup.removed_spans(frame(spark, rows), hot).collect()), key=str) == removed(rows)


def test_without_repeats(spark):
    df = frame(spark, corpus(5)).withColumn("n_chars", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0).cast("long"))
    out = suffix_dedup.without_repeats(df)
    assert out.columns == df.columns and out.count() == df.count() and all(len(r["text"] or "") == r["n_chars"] for r in out.collect())
    assert suffix_dedup.removed_spans(df.limit(0)).count() == 0


def best(text, pieces):
    s, score, back = " " + text if text else "", [0.0], [None]
    for end in range(1, len(s) + 1):
        top = None
        for start in range(max(0, end - pieces.longest), end):
            p = pieces.normal.get(s[start:end].replace(" ", "▁")) if "▁" not in s[start:end] else None
            if p is None and end - start > 1:
                continue
            value = score[start] + (p[1] if p else pieces.unknown)
            if top is None or value > top[0]:
                top = (value, start, p[0] if p else -1 - ord(s[start]))
        score.append(top[0])
        back.append(top)
    out, end = [], len(s)
    while end:
        out.append(back[end][2])
        end = back[end][1]
    return [x for i in out[::-1] for x in piece_lattice._spell(i, pieces.byte_ids)]


def test_pieces_equal_brute_force_and_round_trip(spark):
    import sentencepiece

    pieces = piece_lattice.load_pieces()
    model = sentencepiece.SentencePieceProcessor(model_file=piece_lattice.MODEL)
    texts = ["hello  world\n\tx %%% né ñ", "", None, " a", "  b  ", "x" * 200, "漢字🙂 \x00 z", "The theatre, don't (stop)!", "a b", "hello", "a▁b c", "▁", " ▁▁ x▁", "don▁'t▁ ▁"]
    rows = [*enumerate(texts), (0, texts[0]), (None, "word")]
    df = frame(spark, rows).selectExpr("*", "1 AS ids")
    encoded = piece_lattice.encode(df)
    got = sorted(((r["doc_id"], tuple(r["ids"]), r["n_pieces"], r["round_trip"]) for r in encoded.collect()), key=str)
    want = sorted(((d, tuple(best(t, pieces) if t else ()), len(best(t, pieces)) if t else 0, True) for d, t in rows), key=str)
    assert got == want
    assert all(model.decode(list(ids)) == (texts[d] or "") for d, ids, _, _ in got if d is not None and not (texts[d] or " ").startswith(" "))
    assert sorted(((r["doc_id"], r["text"]) for r in piece_lattice.decode(encoded).collect()), key=str) == sorted(((d, t or "") for d, t in rows), key=str)
    assert piece_lattice.encode(df.limit(0)).count() == 0


def test_long_runs_equal_brute_force(spark):
    pieces = piece_lattice.load_pieces()
    rng = random.Random(3)
    runs = ["".join(rng.choices("0123456789,.", k=6000)), "-=" * 1500 + "-" * 3001, "".join(rng.choices("etaoinshrdlu", k=5000)), "".join(rng.choices("漢字é🙂x", k=4000)), "x" * 255, "x" * 256, "x" * 257, "ab" * 128 + "▁" * 300 + "yz" * 400, "\n" * 300 + " " * 700 + "a"]
    texts = [*runs, "a few words " + runs[0] + " and more", runs[2] + runs[1], " ".join(runs)]
    rows = [*enumerate(texts), (0, texts[0])]
    got = sorted((r["doc_id"], tuple(r["ids"]), r["n_pieces"], r["round_trip"]) for r in piece_lattice.encode(frame(spark, rows)).collect())
    want = [(d, tuple(best(t, pieces)), len(best(t, pieces)), True) for d, t in rows]
    assert got == sorted(want)
    assert [tuple(r["ids"]) for r in piece_lattice.encode(frame(spark, rows[:1])).collect()] == [want[0][1]]  # no other unit


def test_the_lattice_is_folded_once(spark):
    pieces = piece_lattice.load_pieces()
    units = ["▁there", "antion", "x" * 256, "漢字é", "...", "▁▁"]
    paths = piece_lattice.encode_units(spark.createDataFrame([(k % 2, u) for k, u in enumerate(units)], "own int, unit string"), pieces, "own")
    starts = piece_lattice.prefixes(pieces)
    assert {r["unit"]: r["ids"] for r in paths.collect()} == {u: piece_lattice.long_path(u, pieces, starts) for u in units}
    plan = paths._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and "transform(" not in plan and "concat(" not in plan  # no second walk, no copy of the edges


def test_words_are_cut_by_few_letters_and_once(monkeypatch):
    rng = random.Random(6)
    kinds = ["ab9.,\n\t-Z", "ab.éß漢́ -\x80", "aZ.é 𝐀🙂𞤀"]
    ws = ["".join(rng.choices(k, k=rng.randint(1, 9))) for k in kinds for _ in range(2000)]
    want = [piece_lattice.units("▁" + w.replace(" ", "▁")) for w in ws]
    used = []
    pattern = piece_lattice._pattern
    monkeypatch.setattr(piece_lattice, "_pattern", lambda *last: used.append(pattern(*last)) or used[-1])
    assert [piece_lattice.word_units(w) for w in ws] == want
    assert len(set(used)) == 3 and all(len(p.pattern) < 150 for p in used[:1000])  # ASCII words by ASCII letters
    cut = []
    monkeypatch.setattr(piece_lattice, "word_units", lambda w: cut.append(w) or [w])
    found = piece_lattice._Words({"a": b"1", "b": b"22"}, {"b"}, b"")
    assert [found[w] for w in "aabab"] == [b"1", b"1", b"22", b"1", b"22"] and cut == ["a", "b"] and found.wrong == {"b"}


def documents(spark, rows):
    return frame(spark, rows).selectExpr("doc_id", "text", "'en' AS lang", "IF(doc_id % 3 = 0, 's', 't') AS source", "CAST(length(text) AS LONG) AS n_chars")


def written(spark, path, rows, toxic=()):
    docs = documents(spark, rows)
    docs.write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame([(d, 1, int(d in toxic)) for d, _ in rows if d is not None] or [(-1, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    return docs


def test_pipeline_stages_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    rows = [(d, t if d is None or d % 6 else f"{t} zzot kwyx {rng.randint(0, 99)} zzot") for d, t in corpus()]
    toxic = {d for d, t in rows if t and "zzot" in t}
    docs = written(spark, tmp_path, rows, toxic)
    assert len(corpus_pipeline.STAGES) == 5
    previous, sizes = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, previous, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns, name
            out = spark.createDataFrame(out.collect(), docs.schema)
            sizes.append(out.count())
        if name == "toxicity":
            model = gru.fit_toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
            left = [(d, t) for d, t in rows if model.scores(*gru._join([(t or "").encode()]))[0] < gru.THRESHOLD]
            assert sorted(map(str, left)) == sorted(str((r["doc_id"], r["text"])) for r in out.collect()) and 0 < len(left) < len(rows)
        if name == "ngram_jaccard_join":
            left = [(r["doc_id"], r["text"]) for r in previous.collect()]
            assert out.count() == len(set(groups(left)[0]))
        if name == "suffix_array_dedup":
            left = [(r["doc_id"], r["text"]) for r in previous.collect()]
            assert sorted((str(d), n - gone) for d, n, gone, *_ in removed(left)) == sorted((str(r["doc_id"]), len((r["text"] or "").encode())) for r in out.collect())
        if name == "mix_to_target_weights":
            texts = {r["text"] for r in previous.collect()}
            assert {r["text"] for r in out.collect()} <= texts
        previous = out
    assert out.filter("round_trip").count() == out.count() == sizes[3]
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, out.collect()))


AWKWARD = {
    "short": [(k, "ab " * (k % 9)) for k in range(40)],
    "null": [(k, None) for k in range(12)],
    "no id": [(None, "the same text " * 8)] * 6 + [(None, f"the same text {k} " * 9) for k in range(6)],
    "one": [(7, "just one document with some words in it " * 4)],
    "none": [],
    "chunk of shorts": [(1, "x" * 200), (2, "y" * 10), (3, None), (4, "x" * 120)],
}


@pytest.mark.parametrize("name", AWKWARD)
@pytest.mark.parametrize("partitions", [1, 37])
def test_awkward_tables_through_all_stages(spark, tmp_path, name, partitions):
    import corpus_pipeline

    rows = AWKWARD[name]
    docs = written(spark, tmp_path, rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert sorted(map(tuple, suffix_dedup.removed_spans(docs).collect()), key=str) == removed(rows)
        if partitions == 1:
            assert corpus_pipeline.run(spark, str(tmp_path)).count() <= 3 * len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stages_keep_columns_with_clashing_names(spark, tmp_path):
    import corpus_pipeline

    rows = corpus()[:60] + [(None, None), (3, "a b"), (3, "a b")]
    docs = written_with_more(spark, tmp_path, rows)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names and out.count() > 0, name
        assert all(r["a.b"] == r["doc_id"] and r["ids"] == {"a": 1} and r["score"] == 1.5 for r in out.collect())
    assert corpus_pipeline.STAGES[4][1](spark, docs, "").count() == len(rows)


def written_with_more(spark, path, rows):
    docs = written(spark, path, rows)
    return docs.selectExpr(
        "*", "1.5D AS score", "2 AS predicted", "false AS held_out", "9 AS chunk", "'r' AS rows", "7L AS size", "0D AS target", "1L AS taken", "'k' AS k", "'t' AS root",
        "map('a', 1) AS ids", "doc_id AS `a.b`", "array(1) AS `__row`", "'h' AS text_hash", "4 AS `__copy`", "5 AS `__size`",
    )
