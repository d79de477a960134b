"""The operators against brute force, the libraries and round trips, with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import chat, exact, jaccard, nearest, packing, pieces, quality, repeats, shared, token_files, toxicity
from pyspark.sql import functions as F

MORSE = ["".join("ab"[(i.bit_count() + k) % 2] for i in range(1024)) for k in (0, 1)]  # no rolling sum tells them apart
ODD = [*MORSE, "", None, " ", "a", "A", "a  b \n c\t d", "中文 é è ▁ x", "<s> </s> <|endoftext|>", "x" * 5000, "ab " * 3000, "don't Stop, me"]


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(5)
    w = ["".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(1, 8))) for _ in range(400)]
    base = [random.choices(w, k=120) for _ in range(12)]
    rows = [(i, t, "a") for i, t in enumerate(ODD)]
    for i in range(160):  # near copies of few texts, some of them much alike
        t = list(base[i % 4] if i < 120 else base[i % 12])
        for _ in range(random.choice((0, 0, 1, 2, 5, 9))):
            t[random.randrange(len(t))] = random.choice(w)
        rows.append((100 + i, " ".join(t), "b"))
    rows += [rows[20], (None, "null id " + rows[30][1], "c"), (None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, bucket string").repartition(3), rows


def brute_jaccard(rows, n_words, percent):
    """(doc_id, n_shingles, component_id, n_links) of each row, from all pairs."""
    sets = []
    for _, t, *_ in rows:
        x = re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        sets.append({tuple(x[k : k + n_words]) for k in range(max(1, len(x) - n_words + 1))} if x else set())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for k in range(i):
            if x and sets[k] and 100 * len(x & sets[k]) >= percent * len(x | sets[k]):
                parent[top(i)] = top(k)
                links[i], links[k] = links[i] + 1, links[k] + 1
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), 1 << 60), -1 if r[0] is None else r[0])
    return [(r[0], len(sets[i]), None if least[top(i)] == -1 else least[top(i)], links[i]) for i, r in enumerate(rows)]


def test_jaccard_is_that_of_all_pairs(docs, monkeypatch):
    df, rows = docs
    more = [(900, rows[40][1].upper(), "d"), (901, rows[40][1].replace(" ", "  "), "d"), (902, "z " + " ".join(f"l{i}" for i in range(90)), "d"), (903, " ".join(f"l{i}" for i in range(90)), "d"), (904, "É é", "d"), (905, "é é", "d")]
    more += [(920 + i, " ".join(f"c{j}" for j in range(40)) + " " + " ".join(f"u{i}x{j}" for j in range(45 + i % 9)), "e") for i in range(40)]  # a common passage in texts that aren't alike
    df = df.union(df.sparkSession.createDataFrame(more, df.schema))
    for (n_words, percent), block, lists in (((4, 85), 256, 1024), ((2, 60), 7, 5)):  # small blocks: classes and salts
        monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
        monkeypatch.setattr(jaccard, "LIST_SETS", lists)
        expected = brute_jaccard(rows + more, n_words, percent)
        assert max(e[3] for e in expected) > 20
        assert sorted(map(repr, map(tuple, jaccard.jaccard_classes(df, n_words, percent).collect()))) == sorted(map(repr, expected))


def many_sets(n, seed=3):
    r = np.random.default_rng(seed)
    base = [r.integers(1, 1 << 60, size=k, dtype=np.uint64) for k in (60, 90, 130, 200)]
    return [np.unique(np.concatenate([b[r.random(len(b)) > r.choice((0.0, 0.03, 0.1, 0.3))], r.integers(1, 1 << 60, size=int(r.integers(0, 9)), dtype=np.uint64)])) for b in (base[i % 4] for i in range(n))]


def test_long_lists_skip_and_derive(monkeypatch):
    sets = many_sets(220)
    n = np.array([len(x) for x in sets])
    pos = np.arange(len(sets)) % 7
    group = np.array([i % 4 if i < 160 else i for i in range(len(sets))])
    maps = np.stack([np.frombuffer(jaccard.bitmaps(x, np.array([0, len(x)]))[0], np.uint64) for x in sets])
    expected = set()
    for i in range(len(sets)):
        for k in range(i):
            need = -(-80 * (n[i] + n[k]) // 180)
            differ = int(np.bitwise_count(maps[i] ^ maps[k]).sum())
            if group[i] != group[k] and 1 + min(n[i] - pos[i] - 1, n[k] - pos[k] - 1) >= need and differ <= n[i] + n[k] - 2 * need and 100 * min(n[i], n[k]) >= 80 * max(n[i], n[k]):
                expected.add((k, i))
    rows = np.arange(len(sets))
    whole, work = jaccard.Side(rows, n, pos, group, maps), []
    a, b, _ = jaccard.list_pairs(whole, whole, 80, work)
    assert {tuple(sorted((int(whole.row[x]), int(whole.row[y])))) for x, y in zip(a, b)} == expected and expected
    assert sum(work) < 0.5 * len(sets) ** 2  # bitmaps read, of all that could be
    _, a, b, _ = jaccard.short_pairs(np.array([0]), np.array([len(sets)]), n, pos, group, maps, 80)
    assert {tuple(sorted((int(x), int(y)))) for x, y in zip(a, b)} == expected


def test_overlaps_follow_from_those_of_a_similar_set():
    sets = many_sets(60)
    expected = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    work = []
    assert (jaccard.overlaps(sets, 0, work) == expected).all() and (jaccard.overlaps(sets, 25) == expected[:25, 25:]).all()
    assert sum(work) < 0.6 * sum(map(len, sets))  # index lists read, of all shingles of all sets


def test_equal_hashes_mean_equal_words():
    buf = np.frombuffer("".join(MORSE).encode(), np.uint8)
    for n in (64, 128, 256, 512, 1024):
        assert len(set(shared.hash_ranges(buf, np.array([0, 1024]), np.array([n, n])).tolist())) == 2
    w = shared.window_hashes(buf, 32)
    same = defaultdict(set)
    for i in range(len(w)):
        same[int(w[i])].add(buf[i : i + 32].tobytes())
    assert all(len(x) == 1 for x in same.values())


def test_near_dedup_leaves_one_row_of_each_class(spark):
    t = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(1, t[0], "x"), (5, t[0] + " z", "x"), (5, t[1], "x"), (7, t[1], "y"), (3, t[2], "x"), (3, t[2] + " z", "x"), (4, t[3], "x"), (4, t[3], "y"), (None, t[1] + " odd", "x"), (8, "", "x"), (8, None, "x")]
    got = jaccard.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, s string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [rows[0], rows[5], rows[7], rows[8], rows[9], rows[10]]))
    some = [(5, t[0], "x"), (5, t[1], "x"), (9, t[0] + " z", "x"), (1, t[1], "x")]
    got = jaccard.near_dedup(spark.createDataFrame(some, "doc_id long, text string, s string")).collect()
    assert sorted(map(tuple, got)) == [(1, t[1], "x"), (5, t[0], "x")]


def test_near_dedup_keeps_strange_columns(spark):
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(1, t, 7, {"a": 1}, "x"), (1, t, 7, {"a": 2}, "x"), (2, t + " z", 8, {}, "y"), (3, "other words here", 9, None, "z")]
    got = jaccard.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, `id` int, `key` map<string,int>, `row` string"))
    assert got.columns == ["doc_id", "text", "id", "key", "row"] and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [rows[1], rows[3]]))


def brute_repeats(rows, length):
    """What is left of each text, and how much went: rows of one id count as one text each, in the order of ids."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        out[d] = (bytes(x for x, g in zip(b, gone) if not g), len(b), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1])))
    return out


def test_repeats_are_those_of_all_windows(docs):
    df, rows = docs
    rows = list({r[0]: r for r in rows if r[0] is not None}.values())
    table = df.sparkSession.createDataFrame(rows, "doc_id long, text string, kind string")
    for length in (100, 40):
        expected = {d: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, (kept, n, gone, spans) in brute_repeats([r[:2] for r in rows], length).items()}
        assert {r[0]: tuple(r[1:]) for r in repeats.remove_repeats(table, length, stats=True).collect()} == expected
    left = repeats.remove_repeats(table)
    assert left.columns == table.columns
    assert {r.doc_id: r.text for r in left.collect()} == {d: kept.decode("utf-8", "ignore") if gone else dict((r[0], r[1]) for r in rows)[d] for d, (kept, _, gone, _) in brute_repeats([r[:2] for r in rows], 100).items()}


def test_windows_are_told_apart_by_bytes_whatever_their_hash():
    r = np.random.default_rng(2)
    length = 50
    side = length - repeats.GRAM
    width = 2 * side + repeats.GRAM
    seen = r.integers(0, 2, (60, width)).astype(np.uint8)
    seen[30:, : width // 2 + 14] = seen[:30, : width // 2 + 14]  # half of them repeat part of an earlier one
    seen[50:] = seen[20:30]
    left, right = np.full(60, side, np.uint16), np.full(60, side, np.uint16)
    group = np.zeros(60, np.int64)  # as if all strings had one hash
    whole = repeats.repeated_whole(seen, left, right, group)
    assert sorted(whole.tolist()) == [i for i in range(60) if any((seen[i] == seen[k]).all() for k in range(i))]
    own, shift = repeats.equal_windows(seen, left, right, group, length)
    expected, known = set(), set()
    for i in range(60):
        for s in range(side + 1):
            w = (s, seen[i, s : s + length].tobytes())
            if w in known:
                expected.add((i, s))
            known.add(w)
    assert set(zip(own.tolist(), shift.tolist())) == expected and len(expected) > 100


def test_exact_copies(docs):
    df, rows = docs
    left = exact.exact_dedup(df)
    key = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[key(t)].append(d)
    got = {key(r.text): r.doc_id for r in left.collect()}
    assert left.columns == df.columns and left.count() == len(groups)
    assert got == {k: max((x for x in v if x is not None), default=None) for k, v in groups.items()}


def test_exact_dedup_keeps_strange_columns(spark):
    rows = [(1, "Same", 7, {"a": 1}, "x"), (5, "same", 8, {"a": 2}, "y"), (5, "SAME", 9, {"a": 3}, "z"), (5, "same", 8, {"a": 2}, "y"), (None, "same", 1, None, "n"), (None, "alone", 2, {}, "n"), (3, None, 3, None, "e"), (2, "", 4, None, "e")]
    got = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, `full` int, `prefix` map<string,int>, `length` string"))
    assert got.columns == ["doc_id", "text", "full", "prefix", "length"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [rows[1], rows[5], rows[6]]))


CONTROL = ["a<|endoftext|>b", "<|endoftext|>", "  <|endoftext|>  <|startoftext|>x <|endoftext|>'s", "<|endof", "text|>", "<|ENDOFTEXT|> <|startoftext|>", "x<|endoftext|><|endoftext|>y"]


@pytest.fixture(scope="module")
def control(docs):
    df, rows = docs
    more = [(2000 + i, t, "c") for i, t in enumerate(CONTROL)]
    return df.union(df.sparkSession.createDataFrame(more, df.schema)), rows + more


def test_token_files_read_back(spark, control, tmp_path):
    from tokenizers import Tokenizer

    df, rows = control
    path = str(tmp_path / "tokens")
    token_files.write_tokens(df, path, segment_ids=2000)
    t = Tokenizer.from_file(shared.tokenizer_path("byte_bpe_50k.json"))
    got = token_files.read_tokens(spark, path, ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: -1 if d is None else d)
    texts, at = {r[0]: r[1] or "" for r in rows if r[0] is not None}, 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert r.start == at and len(ids) == r.n_tokens and zlib.crc32(r.ids) == r.ids_crc32
        if r.doc_id is not None:
            assert ids.tolist() == t.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        at += r.n_tokens


def test_blocks_decode_alone_and_notice_damage():
    ids = np.random.default_rng(1).integers(0, 50_000, 3 * token_files.BLOCK + 77).astype(np.uint32)
    ids[: token_files.BLOCK] = 5
    body = token_files.encode(ids)
    assert (token_files.decode(body) == ids).all()
    for only in ([1], [3, 0]):
        expected = np.concatenate([ids[b * token_files.BLOCK : (b + 1) * token_files.BLOCK] for b in only])
        assert (token_files.decode(body, np.array(only)) == expected).all()
    parts = shared.unpack(body[4:])
    for i in (4, 6):  # a lane's state, a word
        damaged = [x.copy() for x in parts]
        damaged[i][len(damaged[i]) // 2] ^= damaged[i].dtype.type(1 << 13)
        with pytest.raises(ValueError, match="damaged"):
            token_files.decode(token_files.MAGIC + shared.pack(*damaged))
    with pytest.raises(ValueError):
        token_files.decode(b"nope" + body[4:])
    assert len(token_files.decode(token_files.encode(np.zeros(0, np.uint32)))) == 0


def test_pieces_are_the_librarys(docs):
    df, rows = docs
    m = pieces.piece_model("piece_bpe_32k.model").library
    got = {r.doc_id: r for r in pieces.encode_pieces(df).collect() if r.doc_id is not None}
    for d, t, _ in rows:
        if d is not None:
            ids = m.encode(t or "", add_bos=True, add_eos=True)
            assert np.frombuffer(got[d].ids, "<u4").tolist() == ids and got[d].decoded == m.decode(ids)


def test_long_parts_merge_as_the_library_does():
    m = pieces.piece_model("piece_bpe_32k.model")
    r = random.Random(4)
    texts = ["x" * 5001, "=-" * 900, "the" * 700 + "ing" * 500, "中文字符测试" * 99, "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(900))]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(pieces.LONG - 3, 1500))) for letters in ("ab", "aeiont", "lanoi", "thequickbrownfox", "ABCabc019+/", "aab█") for _ in range(12)]
    ids, off = m.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == m.library.encode(t, add_bos=True, add_eos=True), t[:40]


def test_packing_places_every_piece_once(spark, control):
    from tokenizers import Tokenizer

    df, rows = control
    got = packing.best_fit_pack(df, capacity=64).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 64
    t = Tokenizer.from_file(shared.tokenizer_path("word_bpe_49k.json"))
    expected = []
    for d, text, _ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        expected += [(d, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)]
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    # Pieces of over half a sequence need one each, however full the rest is.
    total = sum(r.length for r in got)
    assert len(by) <= max(-(-total // 64), sum(r.length > 32 for r in got)) * 1.02 + 2


def test_nearest_are_those_of_all_products(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 8))
    x[40:90] = x[40]  # a vector that many rows share
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (350, [float("nan")] * 8), (351, [None] * 8)]
    q = nearest.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    z = np.floor(256 * x).astype(np.int64)
    expected = []
    for i in range(0, 300, 50):
        s = z @ z[i]
        best = sorted((-int(s[j]), j) for j in range(300) if j != i)[:5]
        expected += [(i, k + 1, j, -v) for k, (v, j) in enumerate(best)]
    assert sorted(map(tuple, nearest.top_k(q, F.col("id") % 50 == 0).collect())) == expected


def test_clustered_vectors_are_pruned_and_nothing_is_lost():
    r = np.random.default_rng(1)
    z = np.floor(256 * ((r.normal(size=(30, 16)) * 3)[r.integers(0, 30, 6000)] + r.normal(size=(6000, 16)) * 0.05)).astype(np.int64)
    ids, top = np.arange(6000), float((z.astype(float) ** 2).sum(1).max())
    pivots = nearest.choose_pivots(z[:1000], top)
    d = nearest._distances(z, (z.astype(float) ** 2).sum(1), top, pivots)
    p = d.argmin(1)
    order = np.lexsort((d[ids, p], p))
    blocks = []
    for pivot in range(len(pivots)):
        own = order[p[order] == pivot]
        blocks += [(pivot, float(d[s[0], pivot]), float(d[s[-1], pivot]), shared.pack(ids[s], z[s])) for s in (own[k : k + 40] for k in range(0, len(own), 40))]
    own, work = ids[::50], []
    known = nearest.thresholds(ids[:1000], z[:1000], own, z[own], 5)
    best = nearest.search(blocks, own, z[own], known, pivots, top, 5, work)
    for i, q in enumerate(own):
        s = z @ z[q]
        assert list(zip(-best.score[i], best.id[i])) == sorted((-int(s[j]), j) for j in ids if j != q)[:5]
    assert sum(work) < 0.4 * len(own) * len(ids)


def test_queries_in_chunks(spark):
    x = np.random.default_rng(3).integers(-3, 4, (90, 4)).astype(float) / 256  # many ties
    q = nearest.quantised(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    z = np.floor(256 * x).astype(np.int64)
    expected = [(i, k + 1, j, -v) for i in range(0, 90, 5) for k, (v, j) in enumerate(sorted((-int(s), j) for j, s in enumerate(z @ z[i]) if j != i)[:5])]
    assert sorted(map(tuple, nearest.top_k(q, F.col("id") % 5 == 0, chunk=4).collect())) == expected


def test_chats_come_back(spark):
    rows = [(1, 0, "user", "[INST] </s> & &lt; <s>"), (1, 1, "user", None), (1, 2, "assistant", "[+] ok]"), (1, 2, "assistant", "[+] ok]"), (2, None, None, ""), (3, 5, "a] b", "x")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("t", chat.read_turns(F.col("formatted"))).collect()
    turns = {r.conv_id: [tuple(t) for t in r.t] for r in got}
    assert turns == {1: [("user", "[INST] </s> & &lt; <s>"), ("user", ""), ("assistant", "[+] ok]"), ("assistant", "[+] ok]")], 2: [("", "")], 3: [("a] b", "x")]}


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    for f in (jaccard.jaccard_classes, jaccard.near_dedup, repeats.remove_repeats, exact.exact_dedup, pieces.encode_pieces, packing.best_fit_pack):
        assert f(none).count() == 0
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(none, quality.fit(none, labels)).count() == 0
    assert none.select(toxicity.severity(spark, toxicity.fit(none, labels), F.col("text"))).count() == 0
    token_files.write_tokens(none, str(tmp_path / "t"))
    assert token_files.read_tokens(spark, str(tmp_path / "t")).count() == 0
    vectors = nearest.quantised(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert nearest.top_k(vectors, F.col("id") % 2 == 0).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    sf = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_quality_of_held_out_rows(spark, labelled):
    q = quality.op1_quality(spark, "/root/testdata/sf0.01").join(labelled[1], "doc_id", "left").collect()
    assert len(q) == labelled[0].count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in q)
    held = [r for r in q if r.held_out and r.quality is not None]
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    bad = [r for r in held if r.quality == 0]
    assert sum(not r.predicted for r in bad) >= 0.8 * len(bad)


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, labels.filter(~held))
    rows = docs.join(labels.filter(held), "doc_id").select("toxic", toxicity.severity(spark, model, F.col("text")).alias("s")).collect()
    toxic, clean = [r.s for r in rows if r.toxic], [r.s for r in rows if not r.toxic]
    assert sum(s >= toxicity.THRESHOLD for s in toxic) >= 0.85 * len(toxic) and sum(s >= toxicity.THRESHOLD for s in clean) <= 0.01 * len(clean)
    assert (np.diff(model.cuts) > 0).all() and len(model.weights) == len(model.vocabulary) > 0


def test_classifiers_take_odd_rows(spark, labelled):
    docs, labels = labelled
    odd = [(i, t, "s", 1.0) for i, t in enumerate(ODD)] + [(2, "", "s", 1.0), (None, "no id", "s", 1.0), (7, "word " * 200_000, "s", 1.0)]
    table = spark.createDataFrame(odd, "doc_id long, text string, severity string, score double")
    scores = quality.score(table, quality.fit(docs, labels)).collect()
    assert len(scores) == len(odd) and all(0 <= r.score <= 1 for r in scores) and len({r.score for r in scores if r.doc_id in (2, 3)}) == 1
    graded = table.withColumn("s", toxicity.severity(spark, toxicity.fit(docs, labels), F.col("text"))).collect()
    assert [tuple(r)[:4] for r in graded] == odd and all(0 <= r.s <= 3 for r in graded)
    strange = labels.union(spark.createDataFrame([(None, 1, 1), (1, None, None), (-5, 0, 1)], labels.schema))  # null ids and labels, labels without a row
    again = docs.union(docs.limit(50))  # repeated rows
    model, same = toxicity.fit(docs, labels), toxicity.fit(again, strange)
    assert (model.vocabulary == same.vocabulary).all() and np.allclose(model.weights, same.weights)
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(table, none).collect()} == {0.5}


def test_portions_of_a_bucket_hold_whole_groups(monkeypatch):
    monkeypatch.setattr(repeats, "PORTION", 500)
    r = np.random.default_rng(5)
    gram = shared.mix(r.integers(0, 40, 900).astype(np.uint64))
    blobs = [shared.pack(gram[i : i + 100], np.arange(i, i + 100)) for i in range(0, 900, 100)]
    parts = list(repeats._portions(blobs, 3))
    assert len(parts) > 1 and sorted(np.concatenate([x[1] for x in parts]).tolist()) == list(range(900))
    seen = [set(x[0].tolist()) for x in parts]
    assert sum(map(len, seen)) == len(set(gram.tolist())) and all((gram[x[1]] == x[0]).all() for x in parts)
