"""Each registered query on the smallest tables: its contract's columns against brute force, its SQL where it has one."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import pytest
import xxhash

from rasterloom.llm import queries, segments


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{name}')")
    return c


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("select doc_id, text from documents").fetchall())


def run(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir).collect()


def held_out(doc_id, n, left):
    return zlib.crc32(str(doc_id).encode()) % n == left


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, con, sf_dir, name):
    frame = queries.QUERIES[name](spark, sf_dir)
    got, want = frame.toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    plain = lambda f: sorted(tuple(map(str, r)) for r in f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_op1(spark, sf_dir, texts):
    got = run(spark, sf_dir, "op1_segments")
    model = segments.load(f"{queries.TOKENIZERS}/piece_bpe_32k.model")
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == texts.keys()
    for i, own in by.items():
        own.sort(key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(len(own))) and len({tuple(r.ids) for r in own}) == len(own)
        assert all(a.perturbed >= b.perturbed for a, b in zip(own, own[1:])) and all(0 < r.inclusion <= 1 and r.n_pieces == len(r.ids) for r in own)
        assert all(segments.decode(model, r.ids) == (texts[i] or "") for r in own)
        if len(re.findall(r"\w\w", texts[i] or "")) > 3:
            assert len(own) == 2


def test_op3(spark, con, sf_dir, texts):
    got = {r.doc_id: r for r in run(spark, sf_dir, "op3_quality")}
    labels = dict(con.execute("select doc_id, quality from labels where quality is not null").fetchall())
    assert got.keys() == texts.keys()
    assert all(r.held_out is held_out(i, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    known = [(r.predicted, labels[i]) for i, r in got.items() if r.held_out and i in labels]
    assert known and sum(p == q for p, q in known) >= 0.85 * len(known)
    same = {}
    for i, r in got.items():
        assert same.setdefault(texts[i] or "", r.score) == r.score  # nothing but the text counts


def test_op5(spark, sf_dir, texts):
    got = {r.doc_id: r for r in run(spark, sf_dir, "op5_gif")}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        raw = (texts[i] or "").encode()
        pay = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
        classes = Counter((c >> 5) * 36 >> 6 << 4 | (c >> 2 & 7) * 36 >> 6 << 2 | (c & 3) for c in pay)
        assert r.histogram == [classes[k] for k in range(64)] and r.feature == ",".join(map(str, r.histogram))
        assert r.n_frames == -(-len(pay) // 192 // 64) and r.shown_for == 10 * r.n_frames and len(r.media_sha256) == 64 and r.media_bytes > 0


def test_op6(spark, sf_dir, texts):
    got = {r.doc_id: r for r in run(spark, sf_dir, "op6_simhash")}
    prints = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        own = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own)) if own else 0
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_op8(spark, con, sf_dir, texts):
    got = {r.doc_id: r for r in run(spark, sf_dir, "op8_languages")}
    langs = dict(con.execute("select doc_id, lang from documents").fetchall())
    learned = {v for i, v in langs.items() if v is not None and not held_out(i, 4, 2)}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        letters = any(c.isalpha() for c in texts[i] or "")
        assert r.held_out is held_out(i, 4, 2) and 0 <= r.score <= 1 and (r.lang_pred in learned if letters else r.lang_pred == "und")
    known = [(r.lang_pred, langs[i]) for i, r in got.items() if r.held_out and langs[i] and r.lang_pred != "und"]
    assert known and sum(p == q for p, q in known) >= 0.95 * len(known)


def test_op9(spark, sf_dir, texts):
    groups = {}
    for i, t in texts.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", t or ""), []).append((-len(t or ""), i))
    want = {i: (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(body.encode()).hexdigest()) for body, g in groups.items() for _, i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in run(spark, sf_dir, "op9_exact_dedup")} == want


def test_op10(spark, sf_dir, texts):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    want = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, sf_dir, "op10_windows")} == want
