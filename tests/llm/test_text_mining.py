"""Toxic spans, collocations and periodic runs against plain Python, and the toxicity model on held-out labels."""

import hashlib
import itertools
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from tallystone.llm import collocations, periodic_runs, queries, toxic_spans

DOC = "doc_id long, text string, lang string, source string, n long, phrase string, w string, score double"


def documents(spark, rows):
    """Rows (doc_id, text, lang); further columns have the names that operators use within."""
    return spark.createDataFrame([(i, t, g, "s", 5, "x", "y", 0.5) for i, t, g in rows], DOC)


# periodic runs


def brute_runs(s, least=24, times=3):
    out = set()
    for q in range(1, len(s) // times + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, times * q) and not any(all(s[k] == s[k + d] for k in range(i, i + n - d)) for d in range(1, q)):
                out.add((i, n, q))
            i = max(j, i + 1)
    return sorted(out)


def periodic(rng, n, letters):
    s = []
    while len(s) < n:
        if rng.random() < 0.5:
            r = [rng.choice(letters) for _ in range(rng.randrange(1, 14))]
            s += r * rng.randrange(1, 9) + r[: rng.randrange(len(r))]
        else:
            s += [rng.choice(letters) for _ in range(rng.randrange(10))]
    return s[:n]


@pytest.mark.parametrize(("least", "times"), [(24, 3), (1, 2), (6, 3), (9, 4)])
def test_runs(least, times):
    rng = random.Random(least)
    for _ in range(250):
        s = periodic(rng, rng.randrange(130), range(rng.choice([1, 2, 3, 7])))
        assert periodic_runs.find_runs(s, least, times) == brute_runs(s, least, times), s


def test_runs_of_words_whose_hashes_agree(monkeypatch):
    """Equal hashes of different words: the words themselves decide."""
    monkeypatch.setattr(periodic_runs.Extensions, "same", lambda *_: True)
    rng = random.Random(2)
    for _ in range(60):
        s = periodic(rng, 70, range(3))
        assert periodic_runs.find_runs(s, 6, 3) == brute_runs(s, 6, 3)


def test_narrowed_texts_keep_their_runs(spark):
    rng = random.Random(3)
    texts = [" ".join(periodic(rng, rng.randrange(400), ["a", "b", "A", "é"][: rng.choice([2, 4])])) for _ in range(80)]
    far = [f"w{i}" for i in range(60)]
    texts += [" ".join(far + [f"x{i}" for i in range(300)] + far), " ".join(far * 4), None, "", " \t\n\x0b", "a " * 23, "a " * 40, "a " * 24, "long " * 30_000]
    rows = documents(spark, [(i, t, "en") for i, t in enumerate(texts)] + [(None, "b " * 30, None), (None, "b " * 30, None)])
    for r in periodic_runs.periodic_runs(rows).collect():
        words = (r.text or "").encode().split()
        found = r[periodic_runs.FOUND]
        want = brute_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        assert [tuple(x) for x in found.runs] == want and found.n_words == len(words)
        drop = {k for a, n, q in want for k in range(a + q, a + n)}
        assert found.collapsed.encode() == b" ".join(w for k, w in enumerate(words) if k not in drop)
    assert periodic_runs.periodic_runs(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(rows, times=1)


def test_runs_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc" if i % 2 else "abcdefghij") for _ in range(rng.randrange(200))), "en") for i in range(150)] + [(1000, None, None), (1001, " ", None)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for i, text, _ in rows:
        w = (text or "").split()
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            planted += 1
        runs, r = brute_runs(w), got[i]
        assert r.n_runs == len(runs)
        if runs:
            best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (*best, 1000 * best[1] // best[2])
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
        drop = {k for a, n, q in runs for k in range(a + q, a + n)}
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in drop).encode()).hexdigest()
    assert planted > 5


# collocations


def brute_phrases(rows, longest=4):
    f, n = {}, Counter()
    for _, text, lang in rows:
        own = f.setdefault(lang or "und", Counter())
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in regex.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in regex.split(r"[\x20\x09]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def brute_mine(rows, least, inside, top):
    out = []
    counts, n = brute_phrases(rows)
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= inside * a for q, b in found.items()):
                continue
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((score, a, " ".join(p), left, right))
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, left, right, n[lang], score) for i, (score, a, p, left, right) in enumerate(kept[:top], 1)]
    return sorted(out)


def phrase_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["New", "york", "über", "été", "the", "of", "a|b", "x y", "of", "the", *(f"r{i}" for i in range(300))]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words[:10] if rng.random() < 0.7 else words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r", "!? "]) for _ in range(rng.randrange(60)))
        rows.append((i, text, rng.choice(["en", "en", "de", None])))
    return [*rows, (n, None, "en"), (n, "", "fr"), (n, "new york " * 40, "en"), (n, "  ... ", "und"), (None, "spam spam spam spam spam", "en")]


@pytest.mark.parametrize(("least", "inside"), [(5, 80), (3, 50), (300, 80)])
def test_mine(spark, monkeypatch, least, inside):
    monkeypatch.setattr(collocations, "BUFFER", 500)
    monkeypatch.setattr(collocations, "WAITING", 300)
    monkeypatch.setattr(collocations, "HELD", 400)
    rows = phrase_rows(least)
    got = sorted(tuple(r) for r in collocations.mine(spark, documents(spark, rows).repartition(5), least=least, inside=inside, top=25).collect())
    assert got == brute_mine(rows, least, inside, 25) and (got or least == 300)


def test_mine_through_a_full_sketch(spark, monkeypatch):
    """Cells that nearly all overflow let rare phrases through, which their exact counts then stop."""
    monkeypatch.setattr(collocations, "LEAST_BITS", 16)
    monkeypatch.setattr(collocations, "cells", lambda keys, row, bits: (keys % np.uint64(50)).astype(np.uint32))
    rows = phrase_rows(9, 60)
    assert sorted(tuple(r) for r in collocations.mine(spark, documents(spark, rows), least=4).collect()) == brute_mine(rows, 4, 80, 2000)


def test_phrases_of_one_key(spark, monkeypatch):
    """Two phrases under one 64-bit key are told apart by the second hash."""
    monkeypatch.setattr(collocations.Chunk, "keys", lambda self, n: (self.words % np.uint64(3))[: max(0, len(self.words) - n + 1)] + np.uint64(n))
    rows = phrase_rows(10, 40)
    assert sorted(tuple(r) for r in collocations.mine(spark, documents(spark, rows), least=3).collect()) == brute_mine(rows, 3, 80, 2000)


def test_mine_nothing(spark):
    assert collocations.mine(spark, documents(spark, [])).count() == 0
    assert collocations.mine(spark, documents(spark, [(1, None, None), (2, "one", "en")]), least=1).count() == 0
    assert collocations.width_bits(0) == 16 and collocations.width_bits(1 << 50) == collocations.MOST_BITS


# toxicity


def test_marginals():
    """Against sums over all taggings, with texts of one word and blocks of many."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 6, 11):
        unary, steps, begins = rng.normal(size=n) * 2, rng.normal(size=3), np.arange(n) % 5 == 0
        weight, total, single, pair = np.array([[0, steps[0]], [steps[1], steps[2]]]), 0.0, np.zeros(n), np.zeros((n, 3))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(unary @ y + sum(weight[y[i - 1], y[i]] for i in range(n) if not begins[i]))
            total += w
            single += w * np.array(y)
            for i in range(n):
                if not begins[i] and (y[i - 1], y[i]) != (0, 0):
                    pair[i, [(0, 1), (1, 0), (1, 1)].index((y[i - 1], y[i]))] += w
        p, pairs = toxic_spans.marginals(unary, begins, steps)
        assert np.allclose(p, single / total) and np.allclose(pairs, pair / total)
    # one long text, word by word
    n = 1000
    unary, steps = rng.normal(size=n) * 3, np.array([-1.0, 0.5, 1.5])
    t = np.exp(np.array([[0, steps[0]], [steps[1], steps[2]]]))
    emit = np.column_stack([np.ones(n), np.exp(unary)])
    f, b = np.zeros((n, 2)), np.ones((n, 2))
    f[0] = emit[0] / emit[0].sum()
    for i in range(1, n):
        f[i] = (f[i - 1] @ t) * emit[i]
        f[i] /= f[i].sum()
        b[n - 1 - i] = t @ (emit[n - i] * b[n - i])
        b[n - 1 - i] /= b[n - 1 - i].sum()
    want = f * b
    assert np.allclose(toxic_spans.marginals(unary, np.arange(n) == 0, steps)[0], want[:, 1] / want.sum(1))


def toxic_rows(seed, n=400):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter") for b in ("na", "su", "vo", "ri", "pel")]
    bad = ["idiota", "Grumpfel", "zwackel", "zwackon"]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(plain, k=rng.randrange(3, 60))
        toxic = i % 5 == 0
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", "", ".", "!"])
        rows.append((i, " ".join(w), rng.choice(["en", None])))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxic_spans(spark):
    rows, labels = toxic_rows(1)
    odd = [(5000, None, None), (5001, "", None), (5002, "...", None), (None, "lona IDIOTA suvo", None), (5003, "é lona zwackelmann, idiota suri", None), (5004, "kana " * 40_000 + "idiota", None), (3, "kana", "en")]
    known = spark.createDataFrame([*labels, (1, 1, None), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int").where("doc_id is null or doc_id < 250")
    out = toxic_spans.score(spark, documents(spark, rows + odd), known)
    assert out.columns == [*DOC.replace(" long", "").replace(" string", "").replace(" double", "").split(", "), toxic_spans.FOUND]
    got = {(r.doc_id, r.text): r[toxic_spans.FOUND] for r in out.collect()}
    truth = {i: t for i, _, t in labels}
    for i, text, _ in rows:
        found = got[(i, text)]
        assert (found.score >= toxic_spans.TOXIC) == bool(truth[i]), (i, text, found)
        assert all(text[s.start : s.end].lower() in ("idiota", "grumpfel", "zwackel", "zwackon") or " " in text[s.start : s.end] for s in found.spans)
    for i, text, _ in odd[:3]:
        assert got[(i, text)].score < 0.5 and got[(i, text)].spans == []
    assert got[(None, odd[3][1])].score >= 0.7 and got[odd[5][:2]].score >= 0.7
    spans = [odd[4][1][s.start : s.end] for s in got[odd[4][:2]].spans]
    assert "idiota" in " ".join(spans) and "zwackelmann" in " ".join(spans)  # a beginning that only toxic texts have
    again = {(r.doc_id, r.text): r[toxic_spans.FOUND].score for r in toxic_spans.score(spark, documents(spark, rows + odd).repartition(7), known.repartition(3)).collect()}
    assert all(abs(again[k] - got[k].score) < 1e-9 for k in again)


def test_scores_without_labels(spark):
    docs = documents(spark, [(1, "a b", "en"), (2, None, None)])
    for labels in ([], [(1, 1, 1)], [(1, 1, 0), (7, 1, 1)]):
        found = toxic_spans.score(spark, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).select(f"{toxic_spans.FOUND}.*").collect()
        assert [(r.score, r.spans) for r in found] == [(0.0, [])] * 2
    assert toxic_spans.score(spark, documents(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_open_words_teach_nothing():
    buckets = np.arange(4)[:, None].repeat(toxic_spans._KINDS, 1).astype(np.int32)
    model = toxic_spans.fit(buckets, np.array([True, False, True, False]), np.array([1, -1, 0, 0]))
    assert abs(model.weights[1]) < 1e-3 < model.weights[0] and model.weights[2] < 0


def test_tag_of_split_batches():
    rows, labels = toxic_rows(3, 200)
    texts = [t for _, t, _ in rows]
    flat = [(toxic_spans.features(d, a, b), s) for d, _, a, b, s in toxic_spans._flat(pa.array(texts))]
    starts = flat[0][1]
    begins = np.zeros(starts[-1], bool)
    begins[starts[:-1]] = True
    model = toxic_spans.learnt(flat[0][0], begins, np.repeat(np.arange(200), np.diff(starts)), np.array([bool(t) for _, _, t in labels]))
    whole = toxic_spans.tag(pa.array(texts), model)
    parts = pa.concat_arrays([toxic_spans.tag(pa.array(texts[i : i + 7]), model) for i in range(0, 200, 7)])
    assert np.allclose(whole.field("score").to_numpy(), parts.field("score").to_numpy())
    assert [len(x) for x in whole.field("spans").to_pylist()] == [len(x) for x in parts.field("spans").to_pylist()]
    assert toxic_spans.tag(pa.array([], pa.string()), model).to_pylist() == []


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op11_toxicity(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    right = Counter((r.toxic, r.predicted) for r in rows)
    assert right[(0, 1)] == 0 and right[(1, 1)] >= 0.7 * (right[(1, 0)] + right[(1, 1)])
