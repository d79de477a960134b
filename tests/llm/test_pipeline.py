"""The pipeline on a small table against plain Python, stage by stage."""

import random
import re
from collections import defaultdict

import pytest

from test_operators import brute_jaccard, brute_repeats

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, severity string"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r = random.Random(9)
    w = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(900)]
    bad = [f"vile{x}" for x in "abcdef"]
    passage = " ".join(r.choices(w, k=60))
    rows, labels = [], []
    for i in range(90):
        text = r.choices(w, k=r.randint(30, 90))
        toxic = i % 5 == 0
        if toxic:
            for b in r.sample(bad, 4):
                text.insert(r.randrange(len(text)), b)
        labels.append((i, 1, int(toxic)))
        rows.append([i, " ".join(text)])
    for i in range(90, 120):  # copies, near copies, shared passages
        base = rows[r.choice([k for k in range(90) if k % 5])][1]
        kind = i % 3
        rows.append([i, base.upper() if kind == 0 else base + " more" if kind == 1 else " ".join(r.choices(w, k=20)) + " " + passage + " " + " ".join(r.choices(w, k=20))])
    rows += [[120, ""], [121, None], [122, " "], [123, rows[1][1]], [123, rows[1][1]], [None, "a text without an id " + rows[2][1]], [124, "word " * 30_000], [125, "Word " * 30_000]]
    rows = [(d, t, "en", "s", len(t or ""), "x") for d, t in rows]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, {i for i, _, t in labels if t}


def texts(rows):
    return sorted((repr((r[0], r[1])) for r in rows))


def test_stages(spark, table):
    path, rows, toxic = table
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "ngram_jaccard", "suffix_dedup", "packing"]
    own = {}
    for name, stage in corpus_pipeline.STAGES:
        own[name] = docs
        docs = corpus_pipeline.shared.stored(stage(spark, docs, path), "test")
        if name != "packing":
            assert docs.columns == own[name].columns
    got = {name: [tuple(r) for r in own[name].collect()] for name in own}

    # Toxic documents go, clean ones stay.
    expected = [r for r in rows if r[0] not in toxic]
    assert texts(got["exact_dedup"]) == texts(expected)

    # Of equal texts (A-Z as a-z) the largest id stays.
    key = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for r in expected:
        groups[key(r[1])].append(r)
    expected = [max(g, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")) for g in groups.values()]
    assert {(r[0], key(r[1])) for r in got["ngram_jaccard"]} == {(r[0], key(r[1])) for r in expected} and len(got["ngram_jaccard"]) == len(expected)

    # Of each class the least id stays; rows without words all do.
    classes = brute_jaccard(got["ngram_jaccard"], 5, 80)
    expected = [r for r, (d, n, c, _) in zip(got["ngram_jaccard"], classes) if n == 0 or d == c]
    assert texts(got["suffix_dedup"]) == texts(expected) and len(expected) < len(classes)

    # Repeated passages are cut, but for the first; n_chars follows.
    assert len({r[0] for r in expected}) == len(expected)
    ids = {-1 if r[0] is None else r[0]: r for r in expected}
    cut = brute_repeats([(d, r[1]) for d, r in ids.items()], corpus_pipeline.PASSAGE_BYTES)
    left = {-1 if r[0] is None else r[0]: r for r in got["packing"]}
    assert {d: r[1] for d, r in left.items()} == {d: kept.decode("utf-8", "ignore") if gone else ids[d][1] for d, (kept, _, gone, _) in cut.items()}
    assert any(gone for _, _, gone, _ in cut.values()) and all(r[4] == len(r[1] or "") for r in left.values())

    # Every document is packed, each piece once and without gaps.
    packed = docs.collect()
    assert {r.doc_id for r in packed} == {r[0] for r in got["packing"]}
    by = defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        assert [o for o, _ in sorted(items)] == [sum(n for _, n in sorted(items)[:i]) for i in range(len(items))] and sum(n for _, n in items) <= 4096
    assert all(re.fullmatch(r"[a-z_]+", name) for name in stages)


def test_run_gives_the_last_stage(spark, table):
    assert {r.doc_id for r in corpus_pipeline.run(spark, table[0]).select("doc_id").distinct().collect()} >= {121, None}


def test_an_empty_table(spark, table, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{table[0]}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
