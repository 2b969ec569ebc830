"""The ten operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rasterloom.llm import chat, exact_dedup, gif, langid, licenses, mixing, near, quality, segments, simhash, windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in river stone light house winter garden letter signal paper mountain copper market island".split()
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    base = [sentence(rng, int(n)) for n in rng.integers(1, 120, 40)]
    out = [(i, t, "en", f"src{i % 7}", len(t)) for i, t in enumerate(base)]
    out += [(100 + i, base[i] + " ", "en", "src1", 0) for i in range(10)]  # copies but for white space
    out += [(200 + i, " ".join([*base[i].split()[:-1], "changed"]), None, None, 0) for i in range(20)]  # near copies
    out += [(300, None, "fr", "src2", 0), (301, "", "fr", "src2", 0), (302, " \t\n", None, None, None), (303, "é" * 9000, "fr", "src3", 0), (304, sentence(rng, 4000), "en", "src1", 0)]
    out += [(None, base[0], "en", "src0", 0), (5, base[5], "en", "src5", 0), (5, base[5], "en", "src5", 0)]  # no id; repeated rows
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def key(doc_id):
    return (doc_id is None, doc_id or 0)


# exact dedup


def test_exact_dedup(spark, docs, rows, empty, tmp_path):
    for digest in (exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 1)):  # the second clashes often
        path = f"file://{tmp_path}/{id(digest)}"
        docs.withColumn("file", F.lit(1)).write.parquet(path)  # a column of a clashing name
        got = exact_dedup.dedup_folder(spark, path, digest).collect()
        groups = {}
        for i, t, *_ in rows:
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", t or ""), []).append((-len(t or ""), key(i), i))
        want = Counter((min(g)[2], len(g)) for g in groups.values() for _ in g)
        assert Counter((r.keep_id, r.group_size) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.keep_one(spark, docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.keep_one(spark, empty).count() == 0


def test_exact_dedup_of_later_arrivals(spark, tmp_path):
    first = [(1, "a b"), (2, "c"), (3, None), (4, "long  text here")]
    second = [(5, "ab"), (6, "a  b"), (7, "d"), (8, ""), (None, "c"), (12, "c"), (9, "e"), (10, "e ")]
    for digest in (exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 0)):  # all clash
        folder = f"file://{tmp_path}/{id(digest)}"
        by = lambda rows: Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows)
        one = exact_dedup.arrive(spark.createDataFrame(first, "doc_id long, text string"), folder, digest).collect()
        assert by(one) == Counter([(i, i, 1, True) for i in range(1, 5)])
        exact_dedup.stream_state(spark, folder)  # started again without arrivals: nothing changes
        two = exact_dedup.arrive(spark.createDataFrame(second, "doc_id long, text string").repartition(4), folder, digest, files=1).collect()
        got = by(two)
        # the longest original, 6, takes the place of 1; 3 and 2 stay from the first arrival
        assert got == Counter([(5, 6, 3, False), (6, 6, 3, True), (7, 7, 1, True), (8, 3, 2, False), (None, 2, 3, False), (12, 2, 3, False), (9, 10, 2, False), (10, 10, 2, True)])


def test_exact_dedup_goes_on_after_a_stop(spark, tmp_path, docs, rows):
    folder = f"file://{tmp_path}/state"
    located = exact_dedup.located(docs)
    exact_dedup.entries(located, exact_dedup.sha256).repartition(6).write.parquet(f"{folder}/entries/a")
    written, real = [], exact_dedup.STATE_STORE
    stream = lambda: exact_dedup.stream_state(spark, folder, 1)
    from pyspark.errors import StreamingQueryException
    from pyspark.sql import DataFrameWriter

    save = DataFrameWriter.parquet

    def fails(self, path, *a, **k):
        if "/state/batch=" in path:
            written.append(path)
            if len(written) == 3:
                raise RuntimeError("lost")
        return save(self, path, *a, **k)

    DataFrameWriter.parquet = fails
    try:
        with pytest.raises(StreamingQueryException):
            stream()
        stream()
    finally:
        DataFrameWriter.parquet = save
    assert len(written) > 6 and exact_dedup.STATE_STORE is real
    got = Counter(r.group_size for r in exact_dedup.latest_state(spark, folder).collect())
    assert got == Counter(Counter(re.sub(r"[\x20\x09-\x0D]+", "", t or "") for _, t, *_ in rows).values())
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != exact_dedup.STATE_STORE["spark.sql.streaming.stateStore.providerClass"]


# SimHash


def brute_print(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < 4 else [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids):
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and find(i) != find(j):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), (True, 0)), key(d))
    return [least[find(i)] for i in range(len(prints))]


def test_near_duplicates(docs, rows, empty):
    prints = [brute_print(t) for _, t, *_ in rows]
    want = Counter((r[0], p, c) for r, p, c in zip(rows, prints, brute_components(prints, [r[0] for r in rows])))
    got = Counter((r.doc_id, r.fp & ((1 << 64) - 1), key(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for _, _, c in want})
    assert simhash.near_duplicates(empty).count() == 0


def test_masks_cover_and_blocks_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    masks = [m & ((1 << 64) - 1) for m in simhash.masks()]
    for _ in range(3000):
        diff = sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 5)), replace=False))
        assert any(not diff & m for m in masks)
    base = int(rng.integers(0, 1 << 62)) | 1 << 63
    prints = sorted({base ^ sum(1 << int(b) for b in rng.choice(12, int(rng.integers(0, 6)), replace=False)) for _ in range(300)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    monkeypatch.setattr(simhash, "BLOCK", 16)
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    got = [roots.get(p, p) for p in signed]
    want = brute_components(prints, list(range(len(prints))))
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def brute_similar(rows, least=0.8):
    """The ids that stay under exact five-word similarity."""
    sets = []
    for r in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
                root[find(i)] = find(j)
    least_id = {}
    for i, r in enumerate(rows):
        least_id[find(i)] = min(least_id.get(find(i), (True, 0)), key(r[0]))
    return Counter(None if none else i for none, i in least_id.values())


def test_similar_texts_meet_beyond_the_radius(spark, docs, rows, empty, monkeypatch):
    rng = np.random.default_rng(11)
    more = list(rows)
    for i in range(60):  # copies with a few words changed, similarity 0.6 to 1
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        more.append((1000 + 2 * i, " ".join(base), "en", "src1", 0))
        for at in rng.integers(0, 200, int(rng.integers(1, 9))):
            base[at] = "changed"
        more.append((1001 + 2 * i, " ".join(base), "en", "src1", 0))
    want = brute_similar(more)
    frame = spark.createDataFrame(more, SCHEMA).repartition(3)
    far = [(a[1], b[1]) for a, b in zip(more[len(rows) :: 2], more[len(rows) + 1 :: 2]) if a[0] in want and b[0] not in want]
    assert any((simhash.fingerprint(a.encode(), 5) ^ simhash.fingerprint(b.encode(), 5)).bit_count() > simhash.RADIUS for a, b in far)
    for at in rng.integers(0, 200, 30).tolist():  # a large cluster: copies of one text, some of which the first one does not reach
        base = [f"v{x}" for x in range(200)]
        base[at : at + 14] = ["other"] * 14
        more.append((3000 + len(more), " ".join(base[: 200 - at % 20]), "en", "src1", 0))
    want, frame = brute_similar(more), spark.createDataFrame(more, SCHEMA).repartition(3)
    for block in (near.BLOCK, 900):
        monkeypatch.setattr(near, "BLOCK", block)
        kept = near.keep_one(frame)
        assert kept.columns == frame.columns and Counter(r.doc_id for r in kept.collect()) == want
    assert near.keep_one(empty).count() == 0


def test_pipeline_drops_pairs_of_similarity_0_8(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()) == brute_similar(rows)


# windows


def test_repeated_windows(docs, rows, empty):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), (True, 0)), key(i))
    want = Counter()
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < key(i):
                gone[k : k + 13] = [True] * 13
        want[i, len(w), sum(gone), " ".join(a for a, g in zip(w, gone) if not g)] += 1
    got = windows.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))
    assert windows.remove_repeats(empty).count() == 0


def test_windows_in_ranges_of_hashes(spark, monkeypatch):
    rng = np.random.default_rng(17)
    texts = [(int(i), " ".join(rng.choice(WORDS[:3], int(rng.integers(0, 80)))), 1, "x") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, hashes int, grp string").repartition(3)  # clashing columns
    pick = lambda df: Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())
    want = pick(windows.remove_repeats(docs, 4))
    few = windows._answer(7)
    monkeypatch.setattr(windows, "AT_ONCE", 50)
    monkeypatch.setattr(windows, "HOLD", 1)
    monkeypatch.setattr(windows, "BUCKET_BYTES", 100)
    assert pick(windows.remove_repeats(docs, 4)) == want and few


def test_window_hashes_are_polynomials():
    h = np.random.default_rng(1).integers(0, 1 << 63, 40).astype(np.uint64)
    for size in (1, 2, 5, 13, 16):
        want = [sum(int(h[i + k]) * pow(windows.BASES[0], size - 1 - k, 1 << 64) for k in range(size)) % (1 << 64) for i in range(40 - size + 1)]
        assert windows.window_hashes(h, size, windows.BASES[0]).tolist() == want


# mixing


def brute_share(budget, children):
    """Water-filling: children (name, capacity, weight)."""
    got, left, now = {}, dict((n, (c, w)) for n, c, w in children), budget
    while left:
        level = now / sum(w for _, w in left.values())
        full = [n for n, (c, w) in left.items() if c <= w * level]
        if not full:
            return got | {n: min(c, int(w * level)) for n, (c, w) in left.items()}
        for n in full:
            got[n] = left.pop(n)[0]
            now -= got[n]
    return got


def test_mixing(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 3)
    mix = mixing.Mix({"lang": F.col("lang"), "source": F.col("source")}, {"lang": {"en": 1, "fr": 4}}, 0.7, 2)
    leaves = Counter()
    for i, t, lang, source, _ in rows:
        leaves[lang or "~", source or "~"] += len(words(t))
    leaves = {k: n for k, n in leaves.items() if n}
    total = int(sum(leaves.values()) * 0.7)
    langs = brute_share(total, [(x, 2 * sum(n for k, n in leaves.items() if k[0] == x), {"fr": 4}.get(x, 1)) for x in {k[0] for k in leaves}])
    want = {}
    for x, b in langs.items():
        want |= {(x, s): q for s, q in brute_share(b, [(k[1], 2 * n, 1) for k, n in leaves.items() if k[0] == x]).items()}
    got = Counter()
    for r in mixing.mixed(docs, mix).collect():
        d = r.asDict()
        got[d["__loom_lang"], d["__loom_source"]] += d["__loom_full"] * d["__loom_tokens"] + d["__loom_prefix"]
        assert d["__loom_prefix"] <= d["__loom_tokens"]
    for k, q in want.items():
        assert abs(got[k] - q) <= 2, (k, got[k], q)  # rows that share an id share what is left
    assert mixing.drawn(docs, mix).columns == docs.columns
    assert mixing.drawn(empty, mix).count() == 0


def brute_quota(leaves, mix, budget):
    """Water-filling down the tree over usable leaves; leaves: (names, tokens)."""
    def weight(level, name):
        return (mix.weights.get(level) or {}).get(name, 1)

    levels = list(mix.levels)
    usable = {k: n * mix.max_epochs for k, n in leaves.items() if n and all(weight(x, v) > 0 for x, v in zip(levels, k))}
    got = {(): min(budget, sum(usable.values()))}
    for depth, level in enumerate(levels):
        below = {}
        for parent, b in got.items():
            children = {k[depth] for k in usable if k[:depth] == parent}
            caps = [(c, sum(n for k, n in usable.items() if k[: depth + 1] == (*parent, c)), weight(level, c)) for c in children]
            below |= {(*parent, c): q for c, q in brute_share(b, caps).items()}
        got = below
    return {k: got.get(k, 0) for k in leaves}


@pytest.mark.parametrize("few", [1, 256])
def test_mixing_spends_what_zero_weights_leave(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW", few)
    rng = np.random.default_rng(23)
    rows, k = [], 0
    for a in "ABC":
        for b in "xyz":
            for c in "123":
                for _ in range(int(rng.integers(0, 12))):
                    rows.append((k, " ".join(["w"] * int(rng.integers(0, 40))), a, b, c))
                    k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, a string, b string, c string")
    weights = {"a": {"A": 2, "B": 3, "C": 0}, "b": {"x": 0, "y": 1, "z": 5}, "c": {"1": 4, "2": 0, "3": None}}
    mix = mixing.Mix({n: F.col(n) for n in "abc"}, weights, 0.9, 1, 3)
    plain = mixing.Mix(mix.levels, {x: {n: 1 if w is None else w for n, w in m.items()} for x, m in weights.items()}, 0.9, 1, 3)
    leaves = Counter()
    for _, t, *leaf in rows:
        leaves[tuple(leaf)] += len(t.split())
    want = brute_quota(leaves, plain, int(sum(leaves.values()) * 0.9))
    got, hashed = Counter(), {}
    for r in mixing.mixed(docs, mix).collect():
        got[r.a, r.b, r.c] += r["__loom_full"] * r["__loom_tokens"] + r["__loom_prefix"]
        hashed.setdefault((r.a, r.b, r.c), []).append((r["__loom_hash"], r.doc_id, r["__loom_tokens"], r["__loom_prefix"]))
    assert {k: got[k] for k in want} == want
    assert sum(want.values()) > 0 and all(want[k] == 0 for k in want if k[0] == "C" or k[1] == "x" or k[2] == "2")
    for own in hashed.values():  # the last epoch is a prefix in the order of the hashes
        taken = [p / n for _, _, n, p in sorted(x for x in own if x[2])]
        assert taken == sorted(taken, reverse=True) and sum(0 < p < 1 for p in taken) <= 1


def test_mixing_of_ties_and_long_texts(spark):
    """Equal sources share alike, to a token; a text of most tokens is cut; a table's own column of a clashing name stays; ids of any kind will do."""
    rows = [("a", "w " * 60_000, "x", 1), ("b", "w " * 100, "x", 2), ("c", None, "x", 3), ("d", "w " * 500, "y", 4), ("e", "w " * 500, "z", 5), (None, " ", None, 6)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, rest int")
    mix = mixing.Mix({"source": F.col("source")}, {}, 0.01, 1, 2)
    got = {r.doc_id: r for r in mixing.mixed(docs, mix).collect()}
    asked = int(61_100 * 0.01)
    by = Counter()
    for r in got.values():
        by[r.source] += r["__loom_full"] * r["__loom_tokens"] + r["__loom_prefix"]
    assert by["x"] == by["y"] == by["z"] == asked // 3 and by[None] == 0 and {r.rest for r in got.values()} == set(range(1, 7))
    assert sum(len(r.text.split()) for r in mixing.drawn(docs, mix).collect()) == 3 * (asked // 3)
    with pytest.raises(ValueError):
        mixing.Mix({"tokens": F.col("source")})


def test_mixing_order_does_not_depend_on_the_size(spark):
    mix = mixing.Mix({"lang": F.col("lang")}, {}, 0.5, 1, 9)
    rows = [(i, "a b c", "en") for i in range(400)]
    orders = []
    for n in (300, 400):
        got = mixing.mixed(spark.createDataFrame(rows[:n], "doc_id long, text string, lang string"), mix).filter("doc_id < 300").collect()
        orders.append([r.doc_id for r in sorted(got, key=lambda r: r["__loom_hash"])])
    assert orders[0] == orders[1]


def test_drawn_cuts_the_last_document(spark, docs):
    mix = mixing.Mix({"lang": F.col("lang"), "source": F.col("source")}, {"lang": {"en": 1, "fr": 4}}, 0.7, 2)
    want, texts = Counter(), {}
    for r in mixing.mixed(docs, mix).collect():
        want[r["__loom_lang"], r["__loom_source"]] += r["__loom_full"] * r["__loom_tokens"] + r["__loom_prefix"]
        texts.setdefault(r.doc_id, set()).add(r.text)
    got, cuts = Counter(), 0
    for r in mixing.drawn(docs, mix).collect():
        got[r.lang or "~", r.source or "~"] += len(words(r.text))
        assert any(t.startswith(r.text) for t in texts[r.doc_id])
        if r.text not in texts[r.doc_id]:
            cuts += 1
            assert r.n_chars == len(r.text)
    assert got == +want and cuts


# licences


def test_licenses(spark, empty):
    mit = licenses.KNOWN["MIT"]
    texts = ["Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ;"), mit.replace("software", "programme"), "Released under the MIT Licence!", None, "", mit + " and more"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, license long")
    got = [r["__loom_license"] for r in licenses.scan(docs).orderBy("doc_id").collect()]
    assert got == ["MIT", None, "MIT-line", None, None, None]
    assert licenses.scan(empty).count() == 0


def test_licenses_as_published(spark):
    mit, bsd = licenses.KNOWN["MIT"], licenses.KNOWN["BSD-2-Clause"]
    texts = [mit.replace('"Software"', "\u201cSoftware\u201d").replace('"AS IS"', "\u201cAS IS\u201d"), mit.replace(" free of", "\u00a0free of"), "\ufeff" + mit]
    heads = ["Copyright (c) <year> <copyright holders>", "Copyright (c) Microsoft Corporation.", "Copyright: 2020 A", "\u00a9 A", "MIT License\n\nCopyright (c) 2021 A B", "The MIT License (MIT)\r\n\r\nCopyright \u00a9 A"]
    texts += [f"{head}\n\n{mit}" for head in heads]
    texts.append(mit.replace("OR COPYRIGHT HOLDERS", "OR\nCOPYRIGHT HOLDERS"))  # wrapped within a sentence
    want = ["MIT"] * len(texts)
    texts += ["BSD 3-Clause License\n\nCopyright (c) 2020, A\nAll rights reserved.\n\n" + licenses.KNOWN["BSD-3-Clause"], bsd.replace("1. ", "* ").replace("2. ", "* "), mit + " and more"]
    want += ["BSD-3-Clause", "BSD-2-Clause", None]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert [r["__loom_license"] for r in licenses.scan(docs).orderBy("doc_id").collect()] == want


def test_licenses_by_line_and_digest(spark):
    apache = "/usr/share/common-licenses/Apache-2.0"
    texts = [
        "licence licence", "text\nReleased under the MIT Licence!\r\n# Licensed under CC BY-NC 4.0\nReleased under the MIT License", "Copyright 2020 A\rReleased under the MIT License.",
        "x" * 300_000, None, "sub-licence, sub licence; copyright holder's", "Copyright (c) Jane Doe\n\n" + licenses.KNOWN["ISC"],
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] * 2, "doc_id long, text string, license string")  # repeated rows
    got = licenses.scan(docs).withColumn("c", licenses.canonical(F.col("text"))).orderBy("doc_id").collect()
    assert len(got) == 2 * len(texts) and got[::2] == got[1::2]
    got = got[::2]
    assert got[0].c == "license license" and got[5].c == "sublicense sublicense copyright owners"
    assert got[1]["__loom_notices"] == ["MIT-line", "CC-BY-NC-4.0-line", "MIT-line"] and got[1]["__loom_license"] is None
    assert got[2]["__loom_license"] == "MIT-line" and got[6]["__loom_license"] == "ISC" and got[4]["__loom_notices"] == []
    assert licenses.marks(["licensed under cc", "the software is free"]) == ["software", "under"] and licenses.marks(["license"]) == [""]
    two = {"b": "one text", "a": "One, text"}
    assert [r["__loom_license"] for r in licenses.scan(spark.createDataFrame([("one text!",)], "text string"), two).collect()] == ["a"]  # a tie
    if os.path.exists(apache):
        body = open(apache).read()
        found = licenses.scan(spark.createDataFrame([(body,), (body.replace("\n", "\r\n"),), (body[: body.index("APPENDIX")],), (body[:5000],)], "text string")).collect()
        assert [r["__loom_license"] for r in found] == ["Apache-2.0"] * 3 + [None]


# GIF


def test_lzw_round_trips():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 255, 256, 257, 4000, 60_000):
        for top in (1, 3, 256):
            data = rng.integers(0, top, n).astype(np.uint8).tobytes()
            assert gif.lzw_decode(gif.lzw_encode(data)) == data
    data = rng.integers(0, 4, 30_000).astype(np.uint8).tobytes()
    assert gif.lzw_decode(gif.lzw_encode(data, 2), 2) == data


def test_known_gif_disposal_and_transparency():
    # a published 10 x 10 sample: its code stream, four colours
    stream = bytes([0x8C, 0x2D, 0x99, 0x87, 0x2A, 0x1C, 0xDC, 0x33, 0xA0, 0x02, 0x75, 0xEC, 0x95, 0xFA, 0xA8, 0xDE, 0x60, 0x8C, 0x04, 0x91, 0x4C, 0x01])
    pixels = np.frombuffer(gif.lzw_decode(stream, 2), np.uint8).reshape(10, 10)
    assert pixels[0].tolist() == [1] * 5 + [2] * 5 and pixels[9].tolist() == [2] * 5 + [1] * 5 and pixels[4].tolist() == [1, 1, 1, 0, 0, 0, 0, 2, 2, 2]
    whole, dot = np.full((4, 4), 3), np.array([[9, 5], [5, 9]])
    frames = [gif.Frame(whole, gif.PALETTE, delay=3, disposal=1), gif.Frame(dot, gif.PALETTE, 1, 1, 4, 3, 9), gif.Frame(dot, gif.PALETTE, 0, 0, 5, 2), gif.Frame(dot, gif.PALETTE, 2, 2, 6, 0)]
    read = gif.decode(gif.encode(frames, 4, 4))
    assert [f.time for f in read] == [0, 3, 7, 12]
    rgb = lambda f: f.canvas[..., :3]
    assert (rgb(read[1])[1, 1] == gif.PALETTE[3]).all() and (rgb(read[1])[1, 2] == gif.PALETTE[5]).all()
    assert (rgb(read[2])[1, 2] == gif.PALETTE[3]).all() and (rgb(read[2])[0, 0] == gif.PALETTE[9]).all()  # restored
    assert read[3].canvas[0, 0, 3] == 0 and read[3].canvas[3, 3, 3] == 255  # cleared


def test_stored(spark, docs, rows, empty):
    got = gif.stored(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        pay = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and sum(r.histogram) == len(pay)
    assert gif.stored(empty).count() == 0
    odd = spark.createDataFrame([(None, None, "x"), (7, "a", "y"), (7, "a", "y")], "doc_id long, text string, media string")  # a clashing column
    assert Counter((r.doc_id, r.n_bytes) for r in gif.stored(odd).collect()) == Counter([(None, 0), (7, 1), (7, 1)])


def test_long_payloads_use_all_rules():
    rng = np.random.default_rng(6)
    lines = [sentence(rng, 30) for _ in range(4)]
    text = "\n".join(lines[int(k)] for k in rng.integers(0, 4, 900)).encode() * 2
    payload = gif.padded(text)
    frames = gif.decode(gif.store(payload))
    assert gif.taken_back(frames)[0] == payload and len(frames) > 4
    assert {f.disposal for f in frames} == {1, 2, 3} and [f.time for f in frames] == [10 * k for k in range(len(frames))]
    assert any((f.pixels == gif.CLEAR).any() for f in frames)  # some pixels are left as the canvas shows them
    assert gif.taken_back(frames)[1].tolist() == sum(np.bincount((gif.PALETTE[f, 0] >> 6) * 16 + (gif.PALETTE[f, 1] >> 6) * 4 + (gif.PALETTE[f, 2] >> 6), minlength=64) for f in [np.frombuffer(payload, np.uint8)]).tolist()


def test_uncleared_tables_and_broken_streams():
    codes = [256, *([65] * 3), *[66 + k % 50 for k in range(5000)], 258, 259, 257]  # the table fills and is not cleared
    widths, free = [9], 258
    for k in range(1, len(codes)):
        widths.append(min(12, max(9, free.bit_length())))
        free = min(4096, free + (k > 1)) if k < len(codes) else free
    place = np.arange(len(codes)) - 1
    packed = gif._pack(np.array(codes), np.where(place < gif.FULL, gif._widths(8)[np.clip(place, 0, gif.FULL - 1)], 12))
    want = b"A" * 3 + bytes(66 + k % 50 for k in range(5000)) + b"AA" + b"AA"
    assert gif.lzw_decode(packed) == want and gif.lzw_decode(packed, most=10)[:10] == want[:10]
    with pytest.raises(ValueError):
        gif.lzw_decode(gif._pack(np.array([256, 65, 300, 257]), np.array([9, 9, 9, 9])))


def test_timed_frames(spark, empty):
    whole, dot = np.full((4, 4), 3), np.array([[9, 5], [5, 9]])
    frames = [gif.Frame(whole, gif.PALETTE, delay=3, disposal=1), gif.Frame(dot, gif.PALETTE, 1, 1, 4, 3, 9), gif.Frame(dot, gif.PALETTE, 0, 0, 5, 2)]
    good = gif.encode(frames, 4, 4)
    huge = good[:6] + b"\xff\xff\xff\xff" + good[10:]
    cells = [(1, good), (2, good[:-1]), (3, b"junk"), (4, None), (5, b""), (6, huge), (7, good), (7, good)]  # 2: without its end; 7: repeated
    df = spark.createDataFrame([(k, c, f"x{k}", "y") for k, c in cells], "doc_id int, media binary, frames string, error string")
    got = gif.timed(df).orderBy("doc_id", "__loom_number").collect()
    by = {k: [(r["__loom_number"], r["__loom_time"], r["__loom_disposal"], r["__loom_transparent"], r["__loom_error"]) for r in got if r.doc_id == k] for k, _ in cells}
    plain = [(0, 0, 1, None, None), (1, 3, 3, 9, None), (2, 7, 2, None, None)]
    assert by[1] == plain and sorted(by[2], key=str) == sorted([(None, None, None, None, "cut off"), *plain], key=str)
    assert by[3] == [(None, None, None, None, "not a GIF")] and by[4] == by[5] == [(None,) * 5] and by[6] == [(None, None, None, None, "screen too large")]
    assert by[7] == sorted(plain * 2)
    one = [r for r in got if r.doc_id == 1][1]
    screen = np.frombuffer(one["__loom_rgba"], np.uint8).reshape(4, 4, 4)
    assert (screen[1, 2, :3] == gif.PALETTE[5]).all() and (screen[1, 1, :3] == gif.PALETTE[3]).all() and sum(one["__loom_histogram"]) == 16
    assert one.frames == "x1" and one.error == "y"
    assert gif.timed(empty.select(F.lit(None).cast("binary").alias("media"))).count() == 0


# chat


def brute_rotations(turns):
    """Each speaker's whole rendering and the spans of its mask."""
    convs, out = {}, {}
    for c, n, role, text in turns:
        convs.setdefault(c, []).append((n is not None, n or 0, role or "unknown", (text or "").replace("<|", "< |")))
    for c, own in convs.items():
        own.sort()
        for speaker in {r for _, _, r, _ in own} - {"system"}:
            whole, mask = "", []
            for _, _, role, text in own:
                name = "assistant" if role == speaker else role if role == "system" else f"user name={role}"
                whole += f"<|im_start|>{name}\n"
                start = len(whole)
                whole += f"{text}<|im_end|>\n"
                if role == speaker:
                    mask.append((start, len(whole) - 1))
            out[c, speaker] = whole, mask
    return out


@pytest.mark.parametrize("part", [1, 3, 256])
def test_rotations(spark, part):
    rng = np.random.default_rng(3)
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", "yes <|x"), (2, None, None, "alone"), (3, 300, "ann", "late"), (3, 1, "bob", "soon"), (None, 1, "ann", "no dialogue"), (7, 1, "system", "aside")]
    turns += [(4, int(rng.integers(0, 9)), f"s{rng.integers(0, 3)}", sentence(rng, int(rng.integers(0, 6)))) for _ in range(300)] + [(4, None, "s1", "same")] * 20  # one long dialogue, ties, repeated rows
    turns.append((5, 1, "é🙂", "long " * 50_000))
    docs = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn int, role string, text string, part int, offset string").repartition(5)  # clashing names
    got = chat.rotations(docs, part=part).orderBy("conv_id", "speaker", "part").collect()
    whole, masks = {}, {}
    for r in got:
        key = r.conv_id, r.speaker
        assert len(whole.get(key, "")) == r.offset and 0 < r.n_turns <= part
        whole[key] = whole.get(key, "") + r.text
        masks.setdefault(key, []).extend((m.start + r.offset, m.end + r.offset) for m in r.mask)
    want = brute_rotations(turns)
    assert whole == {k: w for k, (w, _) in want.items()} and masks == {k: m for k, (_, m) in want.items()}
    assert chat.rotations(docs.filter("false")).count() == 0


# languages and quality


def test_letters():
    assert not any(map(langid.has_letter, ["½ ² Ⅷ ①", "12 34!", "", "_"])) and all(map(langid.has_letter, ["½a", "é", "日", "ª"]))


def brute_mixture(docs, text):
    """Languages and shares from plain counts: em over all, then sets by falling share under the penalty."""
    from math import log

    def grams(t):
        b = [c if c >= 128 or 97 <= c <= 122 else 32 for c in f" {t.lower()} ".encode()]
        return Counter((((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761) % (1 << 32)) >> 17 for i in range(len(b) - 2) if b[i + 1] != 32 or b[i + 2] != 32)

    counts = {}
    for t, lang in docs:
        if t is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(t))
    names, own = sorted(counts), grams(text)
    like = {n: {g: (counts[n][g] + 0.5) / (sum(counts[n].values()) + 0.5 * (1 << 15)) for g in own} for n in names}

    def em(chosen):
        share = {n: 1 / len(chosen) for n in chosen}
        for _ in range(25 if len(chosen) > 1 else 0):
            new = {n: sum(c * share[n] * like[n][g] / sum(share[m] * like[m][g] for m in chosen) for g, c in own.items()) / sum(own.values()) for n in chosen}
            moved = max(abs(new[n] - share[n]) for n in chosen)
            share = new
            if moved < 1e-4:
                break
        return share, sum(c * log(sum(share[n] * like[n][g] for n in chosen)) for g, c in own.items())

    order = sorted(names, key=lambda n: (-em(names)[0][n], n))
    best = None
    for k in range(1, len(order) + 1):
        share, value = em(order[:k])
        value -= 2.0 * log(max(2, sum(own.values()))) * (k - 1)
        if best is not None and value <= best[1]:
            break
        best = share, value
    return sorted(best[0].items(), key=lambda x: (-x[1], x[0]))


def test_mixtures_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    words_of = {n: ["".join(rng.choice(list(a), int(rng.integers(2, 7)))) for _ in range(40)] for n, a in {"aa": "abcdefgh", "bb": "defghijk", "cc": "éèhijklm"}.items()}
    text = lambda n, k: " ".join(rng.choice(words_of[n], k))
    train = [(text(n, 60), n) for n in words_of for _ in range(3)] + [(None, "aa"), ("zz", None)] + [("same", "aa")] * 2
    model = langid.learn(spark.createDataFrame(train, "text string, lang string").repartition(3))
    for t in [text("aa", 20), text("aa", 20) + " " + text("bb", 15), text("cc", 3), text("bb", 40) + " " + text("cc", 9) + " " + text("aa", 30), "x", "Ab 12"]:
        got, want = langid.mixture(model, t), brute_mixture(train, t)
        assert [n for n, _ in got] == [n for n, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-6)


def test_languages_of_odd_tables(spark):
    model = langid.learn(spark.createDataFrame([("ab ab ba " * 9, "p"), ("xy xy yx " * 9, "q")], "text string, lang string"))
    rows = [(1, "ab ba", "r", 0.5), (1, "ab ba", "r", 0.5), (None, None, None, None), (2, "xy " * 60_000, "x", 1.0), (3, "mm", "y", 0.0)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double"), model).collect()  # clashing names
    assert Counter((r.doc_id, r.lang_pred) for r in got) == Counter([(1, "p"), (1, "p"), (None, "und"), (2, "q"), (3, "p")])  # 3: a tie
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    assert langid.learn(spark.createDataFrame([], "text string, lang string")).names == []


def test_languages(spark):
    rng = np.random.default_rng(9)
    alphabets = {"aa": "abcdefgh", "bb": "mnopqrst", "cc": "éèêuvwx"}
    text = lambda a, n: " ".join("".join(rng.choice(list(alphabets[a]), 5)) for _ in range(n))
    train = spark.createDataFrame([(text(a, 200), a) for a in alphabets for _ in range(4)] + [(None, "aa"), ("x", None)], "text string, lang string")
    model = langid.learn(train)
    assert model.names == ["aa", "bb", "cc"]
    mixed = langid.mixture(model, text("aa", 60) + " " + text("bb", 30))
    assert [n for n, _ in mixed] == ["aa", "bb"] and 0.55 < mixed[0][1] < 0.78
    assert [n for n, _ in langid.mixture(model, text("cc", 40))] == ["cc"]
    docs = spark.createDataFrame([(1, None), (2, "12 34!"), (3, ""), (4, text("bb", 9))], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()} == {1: "und", 2: "und", 3: "und", 4: "bb"}
    none = langid.learn(train.filter("false"))
    assert langid.identify(docs, none).filter("lang_pred != 'und'").count() == 0


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(3)
    v, w = rng.random(40), rng.integers(1, 9, 40).astype(float)
    got = quality.isotonic(v, w)
    assert (np.diff(got) >= -1e-12).all()
    want = [max(min(np.average(v[a : b + 1], weights=w[a : b + 1]) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(got, want)


def test_quality_equals_a_direct_solve(spark):
    rng = np.random.default_rng(8)
    texts = [(i, " ".join(w + "*" * int(rng.integers(0, 2) * (i % 3 == 0)) for w in sentence(rng, int(rng.integers(5, 60))).split())) for i in range(300)]
    labels = [(i, int(i % 3 > 0) if rng.random() < 0.9 else int(rng.integers(0, 2))) for i, _ in texts]
    bucket = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = quality.train(*quality.labelled(quality.with_statistics(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), ["doc_id"]), spark.createDataFrame(labels, "doc_id long, quality int"), bucket))
    x, y = np.array([quality.statistics(t.encode()) for _, t in texts]), np.array([v for _, v in labels], float)
    part = np.array([zlib.crc32(str(i).encode()) % 5 for i, _ in texts])
    fit = (part > 0) & (part < 4)
    mean, scale = x[fit].mean(0), x[fit].std(0) + 1e-6
    z = quality.fourier((x - mean) / scale)
    pen = np.full(z.shape[1], quality.RIDGE * fit.sum())
    pen[-1] = 1e-9 * fit.sum()
    w = np.linalg.lstsq(np.vstack([z[fit], np.diag(np.sqrt(pen))]), np.concatenate([y[fit], np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale) and np.allclose(z @ w, model.raw(x), atol=1e-6)
    raw = model.raw(x[part == 4])
    bins = np.clip(((raw - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS).astype(int), 0, quality.BINS - 1)
    seen = np.unique(bins)
    v, n = np.array([y[part == 4][bins == b].mean() for b in seen]), np.array([(bins == b).sum() for b in seen], float)
    want = [max(min(np.average(v[a : b + 1], weights=n[a : b + 1]) for b in range(i, len(v))) for a in range(i + 1)) for i in range(len(v))]
    assert np.allclose(model.value, want)


def test_sums_leave_few_rows_for_the_driver(spark):
    from rasterloom.llm import common

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        one = np.ones(3).tobytes()
        parts = spark.range(0, 300, 1, 300).select(F.lit("k").alias("key"), F.col("id").cast("int").alias("task"), F.lit(bytearray(one)).alias("data"))
        assert common.packed_sum(parts).count() <= 32
        assert common.summed(parts)["k"].tolist() == [300.0] * 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_quality_learns_and_copes(spark, docs, rows, empty):
    rng = np.random.default_rng(5)
    texts = [(i, sentence(rng, 40) if i % 4 else " ".join(w + "***" for w in sentence(rng, 40).split())) for i in range(400)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in texts] + [(None, 1), (3, None)], "doc_id long, quality int")
    stats = quality.with_statistics(d, ["doc_id"])
    bucket = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = quality.train(*quality.labelled(stats, labels, bucket))
    got = {r.doc_id: r.score for r in quality.scores(stats, model, ["doc_id"]).collect()}
    assert all((got[i] >= 0.3) == bool(i % 4) for i, _ in texts)
    assert quality.accepted(docs, model).columns == docs.columns
    assert quality.with_statistics(docs, ["doc_id"]).count() == len(rows)
    blank = quality.train(*quality.labelled(stats.filter("false"), labels, bucket))
    assert {r.score for r in quality.scores(stats, blank, ["doc_id"]).collect()} == {0.5}
    assert quality.accepted(empty, model).count() == 0


# SentencePiece


def lattice(model, text):
    whole, out = "▁" + text.replace(" ", "▁"), {}

    def go(i, ids, lp):
        if i == len(whole):
            out[tuple(ids)] = lp
        for j in range(i + 1, len(whole) + 1):
            k = model.ids.get(whole[i:j])
            if k is not None:
                go(j, [*ids, k], lp + model.log_p[k])
            elif j == i + 1:
                raw = whole[i].encode()
                go(j, [*ids, *[model.byte_ids[b] for b in raw]], lp + model.byte_log_p * len(raw))

    go(0, [], 0.0)
    z = np.logaddexp.reduce(list(out.values()))
    return {k: v - z for k, v in out.items()}


def test_samples_have_the_lattice_probabilities():
    model = segments.load(PIECES, 0.3)  # flat, so that many paths come out
    want, n = lattice(model, "the of"), 4000
    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, n).tolist()
    first, second, total = Counter(), Counter(), Counter()
    for own in segments.sample_batch(model, keys, ["the of"] * n, 3):
        assert len({tuple(i.tolist()) for i, _ in own}) == 3
        assert own[0][1].perturbed >= own[1][1].perturbed >= own[2][1].perturbed
        first[tuple(own[0][0].tolist())] += 1
        second[tuple(own[1][0].tolist())] += 1
        for ids, s in own:
            assert abs(want[tuple(ids.tolist())] - s.log_p) < 1e-9
            total[tuple(ids.tolist())] += 1 / s.inclusion / n
    p = {k: np.exp(v) for k, v in want.items()}
    for k in sorted(p, key=p.get)[-6:]:
        q = sum(p[i] * p[k] / (1 - p[i]) for i in p if i != k)
        assert abs(first[k] / n - p[k]) < 4 * np.sqrt(p[k] / n) + 1e-3
        assert abs(second[k] / n - q) < 4 * np.sqrt(q / n) + 1e-3
        assert abs(total[k] - 1) < 0.25


def test_lone_letters_have_all_their_segmentations():
    model = segments.load(PIECES)
    want = lattice(model, "t")
    assert len(want) == 2  # one of them with a probability of about 1e-13
    (own,) = segments.sample_batch(model, [5], ["t"], 3)
    assert {tuple(i.tolist()) for i, _ in own} == set(want) and all(abs(want[tuple(i.tolist())] - s.log_p) < 1e-6 and s.inclusion == 1 for i, s in own)


def test_decoding_gives_texts_back(spark):
    texts = ["the river", "a ▁ b▁", " two  spaces ", "tab\tline\n", "", None, "日本 ½ 🙂", "▁▁", "word " * 30_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = segments.sampled(docs, PIECES, 2).select("doc_id", F.explode("samples").alias("s")).select("doc_id", "s.ids", "s.exact")
    got = segments.decoded(rows.withColumn("text", F.lit("clash")), PIECES).collect()
    assert len(got) >= 2 * len(texts) - 4 and all(r["__loom_text"] == (texts[r.doc_id] or "") and r.exact and r.text == "clash" for r in got)
    none = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r["__loom_text"] for r in segments.decoded(none, PIECES).collect()] == [None, ""]
    assert segments.decoded(none.filter("false"), PIECES).count() == 0


def test_parts_with_equal_hashes_are_told_apart(monkeypatch):
    model = segments.load(PIECES)
    want = [[i.tolist() for i, _ in own] for own in segments.sample_batch(model, [1, 2], ["the house", "a river"], 2)]
    tried, real = [], np.add.reduceat

    def weak(a, starts, *more):
        out = real(a, starts, *more)
        if a.dtype == np.uint64 and not tried:  # the first time all parts hash alike
            tried.append(1)
            out = out * np.uint64(0)
        return out

    class Add:
        reduceat = staticmethod(weak)
        def __getattr__(self, name):
            return getattr(np_add, name)
        def __call__(self, *a, **k):
            return np_add(*a, **k)

    np_add = np.add
    monkeypatch.setattr(segments.np, "add", Add())
    got = [[i.tolist() for i, _ in own] for own in segments.sample_batch(model, [1, 2], ["the house", "a river"], 2)]
    assert tried and got == want


def test_samples_of_rows(docs, rows, empty):
    got = segments.sampled(docs, PIECES, 2).collect()
    assert len(got) == len(rows)
    assert all(s.exact for r in got for s in r.samples)
    by = {}
    for r in got:
        assert by.setdefault(r.doc_id, r.samples) == r.samples or r.doc_id is None  # repeated rows, other batches: the same
    assert len(by[301]) == 1 and by[301][0].ids == []
    again = {r.doc_id: r.samples for r in segments.sampled(docs.repartition(5).filter("doc_id < 30"), PIECES, 2).collect()}
    assert all(by[i] == s for i, s in again.items())
    assert segments.sampled(empty, PIECES).count() == 0


# pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    low = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 0").collect()}
    for (name, stage), check in zip(corpus_pipeline.STAGES, ("quality", "exact", "near", "mix", "encode")):
        before, out = docs, stage(spark, docs, sf_dir).cache()
        if check != "encode":
            assert out.columns == before.columns, name
        a, b = Counter(r.doc_id for r in before.select("doc_id").collect()), Counter(r.doc_id for r in out.select("doc_id").collect())
        if check == "quality":
            assert b.keys() < a.keys() and len(b.keys() & low) < 0.3 * len(low)
        elif check == "exact":
            texts = {re.sub(r"[\x20\x09-\x0D]+", "", r.text or "") for r in before.collect()}
            assert sum(b.values()) == len(texts)
        elif check == "near":
            assert b == brute_similar([(r.doc_id, r.text) for r in before.collect()])
        elif check == "mix":
            assert 0.5 * sum(a.values()) < sum(b.values()) <= 2 * sum(a.values()) and max(b.values()) <= 2
        else:
            assert out.filter("not exact").count() == 0 and b.keys() == a.keys()
        docs = out


def test_pipeline_of_odd_rows(spark, docs, rows, empty, sf_dir, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, columns with clashing names; and no rows at all."""
    import corpus_pipeline

    odd = docs.unionByName(spark.createDataFrame([(None, None, None, None, None)] * 2, SCHEMA)).withColumns({"file": F.lit("x"), "fp": F.lit(1), "node": F.lit(None).cast("string"), "digest": F.col("text")})
    for name, stage in corpus_pipeline.STAGES:
        path, none = f"file://{tmp_path}/{name.replace(' ', '-')}", empty if name == corpus_pipeline.STAGES[0][0] else none  # noqa: F821
        out, none = stage(spark, odd, sf_dir), stage(spark, none, sf_dir)
        out.write.parquet(path)
        assert none.count() == 0 and (out.columns == odd.columns or name == corpus_pipeline.STAGES[-1][0])
        odd = spark.read.parquet(path)
        assert odd.count() > 0


def test_run_leaves_only_what_its_result_reads(spark, sf_dir):
    import corpus_pipeline
    from rasterloom.llm import common

    made = []
    real, common._delete = common._delete, lambda s, folder: (made.append(folder), real(s, folder))[1]
    try:
        out = corpus_pipeline.run(spark, sf_dir)
    finally:
        common._delete = real
    assert out.count() > 0 and len(made) > 20 and not common._MADE
    assert {f.rsplit("/", 1)[0] for f in out.inputFiles()}.isdisjoint(made)
