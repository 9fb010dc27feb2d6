"""Each operator against plain Python, on rows made for their edges: nulls, empty and long texts, ties, repeats, no rows."""

import hashlib
import base64
import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tallystone.llm import _words, decontamination, embedding_dedup, html_extraction, line_dedup, mixing, ngram_join, quality, suffix_dedup, token_counts, warc
from tallystone.llm._shared import Scratch, components, told_apart

DOC = "doc_id long, text string, lang string, source string, n_chars long, node string, mark string, id string, a string, n_lines string, n_dropped string"


def documents(spark, rows):
    """Rows (doc_id, text, source); further columns have the names that operators use within."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z", "w", "l", "d") for i, t, s in rows], DOC)


def split(text):
    return (text or "").encode().lower().split()


def closure(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def near_copies(seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(60)}" for _ in range(120)]
    rows = [(0, None, "s0"), (1, "", "s0"), (2, " \t\n", None), (3, "one", "s1"), (4, "One", "s1"), (5, "one two", "s1"), (6, "é É", "s1"), (7, "a b c d", "s1"), (8, "a b c e", "s1")]
    for i in range(10, 60):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(w), f"s{i % 3}"))
    rows += [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 80))), "s2") for i in range(60, 90)]
    rows += [(90, rows[20][1], "s0"), (91, rows[20][1].upper(), "s0"), (92, " ".join(f"long{k}" for k in range(30_000)), "s0"), (93, " ".join(f"long{k}" for k in range(29_900)), "s0"), (94, "same " * 300, "s0"), (95, "same " * 400, "s0")]
    return rows


# words


def test_word_hashes():
    texts = ["A b a", "", None, "a", "\x0bx\x1fy z", "É é", "ab", "ba", " a"]
    seen = {}
    for row, data, off in _words.spans(pa.array(texts)):
        hashes, begins = _words.word_hashes(data, off)
        for i in range(len(off) - 1):
            words, found = split(texts[row + i]), hashes[begins[i] : begins[i + 1]].tolist()
            assert len(words) == len(found)
            for w, h in zip(words, found, strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    want = closure({x for p in links for x in p}, links)
    got = components(Scratch(spark, "t"), spark.createDataFrame(links, "a long, b long"), "c").collect()
    assert {r.node: r.root for r in got} == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in links)} and len(got) == len({r.node for r in got})
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long"), "c").count() == 0


def test_two_things_under_one_key(spark):
    rows = [(1, 5, 10), (1, 5, 11), (2, 6, 12), (1, 7, 13), (1, 7, 14), (None, 8, 15), (None, 9, 16)]
    df = spark.createDataFrame(rows, "node long, twin long, doc_id long")
    got = {r.doc_id: r.node for r in told_apart(Scratch(spark, "test"), df, "node", "twin").collect()}
    assert got[10] == got[11] and got[13] == got[14] and len({got[10], got[12], got[13]}) == 3
    assert got[12] == 2 and got[15] is None and got[16] is None and len(got) == len(rows)
    assert {r.node for r in told_apart(Scratch(spark, "test"), df.where("doc_id < 13"), "node", "twin").collect()} == {1, 2}
    assert told_apart(Scratch(spark, "test"), df.limit(0), "node", "twin").count() == 0


# 1


def test_line_dedup(spark):
    rows = [(i, f"menu\n own {i}\n\nmenu \r", "s") for i in range(6)] + [(6, "own", "s"), (7, None, "s"), (8, "", "s"), (9, "menu\nx", None), (10, "menu\nrare", "t"), (10, "menu\nrare", "t")]
    got = line_dedup.drop_boilerplate(spark, documents(spark, rows), counts=True)
    assert got.columns[:-2] == documents(spark, []).columns and {r.n_lines for r in got.collect()} == {"l"}
    long = line_dedup.drop_boilerplate(spark, documents(spark, [(i, f"menu\n{i} " + "word " * 200_000 + "\nx" * 50_000, "s") for i in range(5)]), counts=True).collect()
    assert all(r.text == f"{r.doc_id} " + "word " * 200_000 and r[line_dedup.DROPPED] == 50_001 for r in long)
    want = [(i, f" own {i}\n", 4, 2) for i in range(6)] + [(6, "own", 1, 0), (7, None, 0, 0), (8, "", 1, 0), (9, "menu\nx", 2, 0), (10, "menu\nrare", 2, 0), (10, "menu\nrare", 2, 0)]
    assert sorted((r.doc_id, r.text, r[line_dedup.LINES], r[line_dedup.DROPPED]) for r in got.collect()) == sorted(want, key=lambda x: x[0])
    assert line_dedup.drop_boilerplate(spark, documents(spark, [])).count() == 0


# 2


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>x"), (2, "http://a/2", "<p>x"), (3, None, None), (4, "u", ""), (5, "é", "é" * 50_000), (5, "é", "é" * 50_000), (None, "n", "<p>x"), (6, "v", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("address", F.lit("clash"))
    folder = f"file://{tmp_path}/a"
    warc.write(pages, folder)
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read(spark, folder).collect()), key=str)
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(0, "revisit", 2, 4, sha("<p>x")), (1, "revisit", 2, 4, sha("<p>x")), (2, "response", None, 4, sha("<p>x")), (3, "revisit", 4, 0, sha("")), (4, "response", None, 0, sha("")), (5, "response", None, 100_000, sha("é" * 50_000)), (5, "revisit", 5, 100_000, sha("é" * 50_000)), (6, "response", None, 5, sha("other"))]
    assert got == sorted(want, key=str)
    assert spark.read.parquet(f"{folder}/payloads").count() == 4
    texts = {(i or 0, u): (h or "").encode() for i, u, h in rows}
    for r in warc.records(spark, folder).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and len(rest) == int(fields[b"Content-Length"]) + 4
        if fields[b"WARC-Type"] == b"response":
            assert rest.partition(b"\r\n\r\n")[2][:-4] == next(h for (i, _), h in texts.items() if i == (r.page_id or 0))
    warc.write(pages, folder, least_bytes=5)
    assert {r.record_type for r in warc.read(spark, folder).where("payload_bytes < 5").collect()} == {"response"}
    warc.write(pages.limit(0), folder)
    assert warc.read(spark, folder).count() == 0


def test_warc_keeps_urls(spark, tmp_path):
    rows = [(1, "http://a/\nb", "x"), (2, "", "y"), (3, None, "z\r\n\r\nz\r\n"), (4, "http://é/?a=%20 b ", "\r\n\r\n"), (5, "\r\n", "w")]
    folder = f"file://{tmp_path}/a"
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = warc.read(spark, folder)
    assert sorted((r.page_id, r.url, r.payload_bytes) for r in got.collect()) == [(i, u, len(h)) for i, u, h in rows]
    assert sorted((r.page_id, bytes(r.p).decode()) for r in warc.records(spark, folder).select("page_id", warc.payload_of(F.col("record")).alias("p")).collect()) == [(i, h) for i, _, h in rows]


def test_warc_length(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    warc.write(spark.createDataFrame([(1, "u", "<p>x")], "page_id long, url string, html string"), folder)
    assert warc.read(spark, folder).count() == 1
    bad = [(r.page_id, r.address, bytes(r.warc_header), bytes(r.http_header) + b"x") for r in spark.read.parquet(f"{folder}/records").collect()]
    spark.createDataFrame(bad, "page_id long, address string, warc_header binary, http_header binary").write.mode("overwrite").parquet(f"{folder}/records")
    with pytest.raises(Exception, match="record of another length"):
        warc.read(spark, folder).select("payload_digest").collect()


def test_warc_notices_damage(spark, tmp_path):
    folder = f"file://{tmp_path}/b"
    warc.write(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), folder)
    spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.lit(b"y")).write.parquet(f"{folder}/other")
    spark.read.parquet(f"{folder}/other").write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read(spark, folder).collect()


# 3


def brute_sainte_lague(votes, seats, caps):
    won = [0] * len(votes)
    for _ in range(min(seats, sum(caps))):
        i = max((i for i in range(len(votes)) if won[i] < caps[i] and votes[i] > 0), key=lambda i: (votes[i] / (2 * won[i] + 1), -i), default=None)
        if i is None:
            break
        won[i] += 1
    return won


def test_sainte_lague():
    rng = random.Random(5)
    for _ in range(200):
        votes = [rng.choice([0, rng.randrange(1, 1000)]) for _ in range(rng.randrange(1, 7))]
        caps = [rng.randrange(0, 40) for _ in votes]
        seats = rng.randrange(0, 80)
        assert mixing.sainte_lague(votes, seats, caps) == brute_sainte_lague(votes, seats, [c if v else 0 for v, c in zip(votes, caps, strict=True)])


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    got = mixing.targets([10, 1000, 1000], [1, 1, 1])
    assert got[0] == 30 and abs(got[1] - 990) < 1e-9 and abs(sum(got) - 2010) < 1e-9
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 2]) == [0, 0]


def test_taken():
    for sizes, quota in itertools.product(([5, 0, 100, 33, 7], [1], [0, 0], [64]), range(0, 14)):
        s = np.array(sizes)
        words = min(quota * 29, 3 * s.sum())
        got = mixing.taken(s, words, 32, 9)
        assert (got <= 3 * s).all() and (got >= 0).all() and got.sum() == words


def test_small_sources_come_near_their_targets(spark, monkeypatch):
    """Sources of 1 to 500 words, many of 40, and shards of few words."""
    monkeypatch.setattr(mixing, "SHARD_ROWS", 3)
    rows = [(i, "w " * 7, "a") for i in range(10)] + [(100 + i, "w " * 200, "b") for i in range(20)] + [(1000 + i, "w " * 40, f"s{i}") for i in range(60)]
    rows += [(2000 + i, "w " * n, f"t{n}") for i, n in enumerate((1, 2, 3, 33, 64, 500))] + [(3000, "", "empty"), (3001, None, None)]
    found = mixing.mix(spark, documents(spark, rows)).toPandas()
    assert len(found) == len(rows) and (found["taken"] <= 3 * found["size"]).all()
    by = found.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by["taken"] - by["target"]).abs() <= 0.5).all()


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["b", "a", "é", "Z", None])) for i in range(3000)] + [(None, "x y z", "a"), (None, None, "a"), (7, "x " * 50_000, "b")]
    first = mixing.mix(spark, documents(spark, rows)).collect()
    again = mixing.mix(spark, documents(spark, rows[::-1]).repartition(7)).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, first)) == sorted(map(key, again)) and len(first) == len(rows)
    sizes = {s: sum(len(split(t)) for _, t, x in rows if x == s) for s in ("Z", "a", "b", "é", None)}
    want = mixing.targets(list(sizes.values()), [1, 2, 3, 1, 2])
    for (s, n), t in zip(sizes.items(), want, strict=True):
        own = [r for r in first if r.source == s]
        assert {r.source_size for r in own} == {n} and {r.target for r in own} == {t}
        assert abs(sum(r.taken for r in own) - t) <= 0.5
    assert all(r.taken <= 3 * r.size for r in first)
    assert mixing.mix(spark, documents(spark, [])).count() == 0


M64 = (1 << 64) - 1


def brute_mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def brute_mix(rows):
    """The mix word by word: hashes by the xxhash library, seats by quotients, and every word's own block."""
    h = lambda data, seed: xxhash.xxh64_intdigest(data, seed)
    sized = []
    for i, t, s in rows:
        tag = 42
        for part in (None if i is None else i.to_bytes(8, "little", signed=True), None if t is None else t.encode(), mixing.SEED.to_bytes(4, "little")):
            tag = tag if part is None else h(part, tag)
        sized.append((i, s, len(split(t)), tag - (1 << 64) * (tag >> 63)))
    names = sorted({s for _, s, _, _ in sized}, key=lambda s: (s is None, s))
    sizes = [sum(n for _, s, n, _ in sized if s == x) for x in names]
    goal = mixing.targets(sizes, mixing.cycle_weights(names))
    cells = []
    for at, s in enumerate(names):
        own = [r for r in sized if r[1] == s]
        parts = min(mixing.MAX_SHARDS, -(-len(own) // mixing.SHARD_ROWS))
        held = {}
        for r in own:
            k = h(r[3].to_bytes(8, "little", signed=True), 42)
            held.setdefault((k - (1 << 64) * (k >> 63)) % parts, []).append(r)
        cells.append(held)
    blocks = lambda own: -(-sum(r[2] for r in own) // mixing.BLOCK)
    won = brute_sainte_lague(goal, round(sum(goal) / mixing.BLOCK), [3 * sum(blocks(x) for x in held.values()) for held in cells])
    out = []
    for at, (held, seats) in enumerate(zip(cells, won, strict=True)):
        keys = sorted(held)
        votes = [sum(r[2] for r in held[k]) for k in keys]
        quotas = [min(q * mixing.BLOCK, 3 * v) for q, v in zip(brute_sainte_lague(votes, seats, [3 * blocks(held[k]) for k in keys]), votes, strict=True)]
        while sum(quotas) != round(goal[at]):  # a word at a time, at the largest shard that can
            up = sum(quotas) < round(goal[at])
            i = min((i for i in range(len(keys)) if (quotas[i] < 3 * votes[i] if up else quotas[i])), key=lambda i: (-votes[i], i))
            quotas[i] += 1 if up else -1
        for k, vote, quota in zip(keys, votes, quotas, strict=True):
            seed = (mixing.SEED + (at << 32) + k) * 0x9E3779B97F4A7C15 & M64
            every, more = divmod(quota, vote) if vote else (0, 0)
            chosen = [b * mixing.BLOCK + w for b in sorted(range(blocks(held[k])), key=lambda b: brute_mixed(b + seed & M64)) for w in range(mixing.BLOCK) if b * mixing.BLOCK + w < vote][:more]
            first, place = set(chosen), 0
            for i, s, size, _ in sorted(held[k], key=lambda r: (r[3], r[0] or 0, r[2])):
                out.append((i, s, size, sizes[at], goal[at], sum(every + (place + w in first) for w in range(size))))
                place += size
    return sorted(out, key=str)


def test_mix_word_by_word(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 40)
    rng = random.Random(12)
    rows = [(i, rng.choice([None, "", "x y", "w " * rng.randrange(90)]), rng.choice(["b", "a", "é", "Z", None])) for i in range(300)] + [(None, "x y z", "a"), (None, None, "a"), (7, "x " * 3000, "b"), (8, "q " * 70, "b"), (8, "q " * 70, "b")]
    assert sorted((tuple(r) for r in mixing.mix(spark, documents(spark, rows)).collect()), key=str) == brute_mix(rows)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted((tuple(r) for r in mixing.mix(spark, docs).collect()), key=str) == brute_mix([(r.doc_id, r.text, r.source) for r in docs.collect()])


# 4


def brute_score(text, model):
    """Latent score of a text, word by word."""
    data = (text or "").encode()
    codes = lambda b: brute_mixed((b + 32 if 65 <= b < 91 else b) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & M64)
    span = lambda w: brute_mixed(sum(codes(b) * pow(_words._BASE, i, 1 << 64) for i, b in enumerate(w)) + len(w) & M64)
    hashed = {}
    score = 0.0
    found = re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", data)
    for k in (0, *quality.PREFIXES):
        counts = {}
        for w in found:
            w = w[:k] if k else w
            if (w, k) not in hashed:
                hashed[w, k] = (span(w) ^ (k << 60 & M64)) >> 64 - quality.BITS
            counts[hashed[w, k]] = counts.get(hashed[w, k], 0) + 1
        length = sum((1 + np.log(n)) ** 2 for n in counts.values()) ** 0.5
        score += sum(model.weights[i] * (1 + np.log(n)) / length for i, n in counts.items())
    plain, last = re.findall(rb"[^\x20\x09-\x0D]+", data), None
    letter = lambda b: b >= 128 or chr(b).isalnum()
    for w in plain:
        mark = 0 if letter(w[-1]) else w[-1]
        shape = ((mark * 2 + (len(w) > 1 and not letter(w[-2]))) * 2 + (len(w) > 1 and 65 <= w[1] < 91)) * 2 + (last is not None and w.lower() == last.lower())
        score += model.weights[(1 << quality.BITS) + shape] / len(plain)
        last = w
    return score


def test_scores_word_by_word(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    odd = documents(spark, [(900, None, "s"), (901, "", "s"), (902, "É ÉA aB.. aB.. x!", "s")]).select("doc_id", "text")
    docs = docs.select("doc_id", "text").union(odd)
    ratings = quality.ratings_of(labels)
    model = quality.train(docs, ratings)
    for r in quality.score(spark, docs, ratings).collect():
        if len(r.text or "") < 4000:
            tails = 1 / (1 + np.exp(model.thresholds - brute_score(r.text, model)))
            q = r["__tallystone_quality"]
            assert abs(q.expected_grade - tails.sum()) < 1e-4 and abs(q.tail_probability - tails[1]) < 1e-4 and q.keep == (q.tail_probability >= 0.5)


def test_one_text_of_a_rated_id(spark):
    rows = [(i, "good words here", "s") if i % 2 else (i, "bad%%% stuff%%%", "s") for i in range(40)] + [(i, "other text of this id", "s") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    models = [quality.train(documents(spark, x).repartition(n), quality.ratings_of(labels)) for x, n in ((rows, 3), (rows[::-1], 7))]
    assert (models[0].weights == models[1].weights).all() and (models[0].thresholds == models[1].thresholds).all()


def test_gradient():
    rng = np.random.default_rng(0)
    row = np.repeat(np.arange(30), 4)
    args = (rng.integers(0, 12, 120), rng.random(120), row, rng.integers(0, 3, 30), 2, 1e-2)
    x = rng.normal(size=14)
    _, g = quality._loss(x, *args)
    for i in range(len(x)):
        e = np.zeros(14)
        e[i] = 1e-6
        assert abs((quality._loss(x + e, *args)[0] - quality._loss(x - e, *args)[0]) / 2e-6 - g[i]) < 1e-6


def test_classifier_on_held_out_ratings(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    ratings = quality.ratings_of(labels)
    found = quality.score(spark, docs, ratings.where("pmod(hash(doc_id), 4) < 3")).join(ratings.where("pmod(hash(doc_id), 4) = 3"), "doc_id")
    kept = {r.grade: r.kept for r in found.groupBy("grade").agg(F.avg(F.col("__tallystone_quality.keep").cast("int")).alias("kept")).collect()}
    assert kept[2] > 0.99 and kept[1] < 0.05 and kept[0] < 0.1


def test_classifier_edges(spark):
    rows = [(i, "good words here", "s") if i % 2 else (i, "bad%%% stuff%%%", "s") for i in range(40)] + [(None, None, "s"), (100, "", "s"), (1, "good words here", "s"), (101, "word " * 100_000, None)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (31, None, None), (31, 1, 0), (31, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(spark, documents(spark, rows), quality.ratings_of(labels).withColumn("text", F.lit(1)))
    assert got.count() == len(rows)
    assert {r.doc_id: r["__tallystone_quality"].keep for r in got.where("doc_id < 40").collect()} == {i: bool(i % 2) for i in range(40)}
    none = quality.score(spark, documents(spark, rows), quality.ratings_of(labels.limit(0)))
    assert none.where("__tallystone_quality.keep").count() == len(rows)
    assert quality.select(spark, documents(spark, []), labels).count() == 0


# 5


def test_embedding_dedup(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + rng.normal(size=16) * (0.02 if i < 700 else 0.35)).tolist(), i % 3 if i % 40 else 1) for i in range(900)]
    rows += [(1000 + i, base[0].tolist(), 1) for i in range(3)] + [(1003, (base[0] * 2).tolist(), 1), (1004, base[0].tolist(), None)]
    rows += [(1010, None, 1), (1011, [0.0] * 16, 1), (1012, [float("nan")] * 16, 1), (1013, [None] * 16, 1), (1014, [], 1), (1015, [1.0, 2.0], 1), (1016, [2.0, 4.0], 1), (1017, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("clash"))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark, df).collect()}
    links, hits = set(), 0
    for (i, x, p), (j, y, q) in itertools.combinations([r for r in rows if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])], 2):
        if p == q and len(x) == len(y) and np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
            links.add((i, j))
    want = closure([r[0] for r in rows], links)
    count = {i: 0 for i in want}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert len(got) == len(rows) and all(got[i].n_links <= count[i] for i in count)  # no false link
    hits = sum(got[i].n_links for i in count)
    assert hits >= 0.97 * sum(count.values())
    assert sum(got[i].component_id == want[i] for i in want) >= 0.99 * len(want)
    assert all(got[i].kept == (got[i].component_id == i) for i in want)
    assert [(got[i].n_links, got[i].component_id) for i in (1004, 1010, 1011, 1012, 1013, 1014, 1017)] == [(0, i) for i in (1004, 1010, 1011, 1012, 1013, 1014, 1017)]
    assert got[1015].n_links == 1
    assert embedding_dedup.near_duplicates(spark, df.limit(0)).count() == 0


def test_embedding_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=24)
    rows = [(i, (x + rng.normal(size=24) * 0.05).tolist(), 0) for i in range(300)] + [(300 + i, rng.normal(size=24).tolist(), 0) for i in range(50)]
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i].n_links == 299 and got[i].component_id == 0 for i in range(300)) and all(got[i].n_links == 0 for i in range(300, 350))


def test_embedding_magnitudes(spark):
    rows = [(1, [1e-200, 0.0], 0), (2, [1.0, 10.0], 0), (3, [1e200, 2e200], 1), (4, [2e200, 4e200], 1), (5, [1e-310, 2e-310], 1), (6, [1.7e308, 1.7e308], 2), (7, [1.7e308, -1.7e308], 2)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (0, 6), 7: (0, 7)}


def test_embedding_split_lists(spark, monkeypatch):
    """Lists of two and three pivots give what whole lists give."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 12))
    rows = [(i, (base[i % 12] + rng.normal(size=12) * 0.15).tolist(), i % 2) for i in range(600)] + [(700 + i, [1.0 + i / 9, 1.0], 0) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = sorted(map(tuple, embedding_dedup.near_duplicates(spark, df).collect()))
    assert sum(r[1] for r in want) > 1000
    for split in (20, 1):
        monkeypatch.setattr(embedding_dedup, "SPLIT", split)
        assert sorted(map(tuple, embedding_dedup.near_duplicates(spark, df).collect())) == want


# 6


def brute_contamination(rows, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = find(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t, _ in rows:
        w, hit, held = find(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    hit |= set(range(k, k + n))
                    held |= found - {None}
        ids = sorted(map(str, held))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("items", [[], [(1, None), (2, ""), (3, "...")], [(1, "alpha"), (2, "k1 k2 k3 k4 k5 k6 k7"), (10, " ".join(f"w{i}" for i in range(30))), (10, " ".join(f"w{i}" for i in range(30))), (9, "É é w1"), (None, "only null item words here now"), (11, " ".join(f"w{i}" for i in range(5, 15)))]])
def test_contamination(spark, items):
    rows = [(1, None, "s"), (2, "", "s"), (3, "ALPHA, beta alpha", "s"), (4, "x " * 20 + " ".join(f"W{i}!" for i in range(3, 28)) + " y", "s"), (4, "k1 k2 k3 k4 k5 k6 k7 k7 k1", "s"), (5, "É É w1 É é w1", "s"), (6, "only null item words here now", "s"), (None, "alpha", "s"), (7, " ".join(f"w{i}" for i in range(9)), "s"), (8, "alpha", "s"), (8, "alpha", "s"), (9, "z " * 30_000 + " ".join(f"w{i}" for i in range(30)), "s"), (12, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w0 w1 w2 w3 w4 w5 w6 w7 w8 w9", "s")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("mark", F.lit(1))
    got = decontamination.contamination(spark, documents(spark, rows), bench).drop("mark").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_contamination(rows, items)
    bad = {str(x[0]) for x in brute_contamination(rows, items) if x[5]}
    kept = decontamination.clean(spark, documents(spark, rows), bench)
    assert kept.columns == documents(spark, []).columns
    if items and items[0][1]:
        assert {str(r.doc_id) for r in kept.collect()} == {str(r[0]) for r in rows} - bad | {"4"} & (bad if any(x[0] == 4 and not x[5] for x in brute_contamination(rows, items)) else set())
    assert decontamination.contamination(spark, documents(spark, []), bench).count() == 0


def test_item_ids_with_commas(spark):
    items = [("a,b", "one two"), ("a", "three four"), ("b", "three four"), ("", "five six"), (None, "seven eight"), ("c", "alpha")]
    rows = [(1, "one two three four", "s"), (2, "three four", "s"), (3, "five six", "s"), (4, "seven eight", "s"), (5, "five six alpha seven eight", "s")]
    got = decontamination.contamination(spark, documents(spark, rows), spark.createDataFrame(items, "item_id string, text string")).drop("mark").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_contamination(rows, items)


# 7


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_ngram_join(spark, n, percent):
    rows = near_copies()
    sets = {}
    for i, t, _ in rows:
        w = split(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = closure(sets, links)
    got = ngram_join.join(spark, documents(spark, rows), n, percent).collect()
    degree = collections.Counter(x for link in links for x in link)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == {i: (len(sets[i]), want[i], degree[i]) for i in sets} and len(got) == len(rows)
    kept = ngram_join.one_of_each(spark, documents(spark, rows), n, percent)
    assert kept.columns == documents(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if not sets[i] or want[i] == i)


def test_ngram_join_edges(spark):
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (1, "other text of the same id", "s"), (None, "a b c d e f", "s"), (None, "null only", "s"), (2, "null only", "s"), (None, "alone", "s"), (None, None, "s")]
    got = ngram_join.join(spark, documents(spark, rows), 3, 90).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted([("1", 4, "1")] * 2 + [("1", 4, "1"), ("None", 4, "1"), ("None", 1, "2"), ("2", 1, "2"), ("None", 1, "None"), ("None", 0, "None")])
    assert sorted(r.n_links for r in got) == [0, 0, 0, 1, 1, 2, 2, 2]
    kept = sorted((str(r.doc_id), str(r.text)) for r in ngram_join.one_of_each(spark, documents(spark, rows), 3, 90).collect())
    assert [k for k in kept if k[1] == "a b c d e f"] == [("1", "a b c d e f")] and ("2", "null only") in kept and ("None", "None") in kept
    assert ngram_join.join(spark, documents(spark, []), 3, 90).count() == 0


@pytest.mark.parametrize(("crowd", "long", "seed"), [(2, 16, 1), (3, 2, 2), (4, 1, 3)])
def test_groups_that_share_lists(spark, monkeypatch, crowd, long, seed):
    """Small groups around sets that share some of their shingles, in both directions, at sizes where few shared lists decide."""
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "LONG", long)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(seed)
    pools = [[f"p{k}w{i}" for i in range(40)] for k in range(4)]
    sets, rows = {}, []
    for i in range(90):
        k = rng.randrange(4)
        w = set(rng.sample(pools[k], rng.randrange(28, 40))) | set(rng.sample(pools[(k + 1) % 4], rng.randrange(0, 9)))
        sets[i] = w
        rows.append((i, " ".join(sorted(w, key=lambda x: rng.random())), "s"))
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert 10 < len(links) < 1500
    want = closure(sets, links)
    got = ngram_join.join(spark, documents(spark, rows), 1, 80).collect()
    degree = collections.Counter(x for link in links for x in link)
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_links for r in got} == {i: degree[i] for i in sets}


def test_sets_under_one_key(spark, monkeypatch):
    """Keys of four bits: sets share them by the dozen and are told apart by their second hash."""
    real = ngram_join._node
    monkeypatch.setattr(ngram_join, "_node", lambda x, kind=0: real(x, kind) if kind else real(x) % 16)
    test_ngram_join(spark, 3, 90)


def test_blocks_and_crowds(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "CROWD", 3)
    test_ngram_join(spark, 3, 90)


def test_lists_split_between_groups(spark, monkeypatch):
    """Two sets that link share five merged lists: in two the one's group is a crowd, in two the other's, in one neither."""
    monkeypatch.setattr(ngram_join, "CROWD", 3)
    vocabulary = [f"v{k}" for k in range(1000)]
    _, data, off = next(_words.spans(pa.array(vocabulary)))
    hashes = np.concatenate(_words.shingle_hashes(*_words.word_hashes(data, off), 1))
    v = [vocabulary[k] for k in np.argsort(hashes)]  # in the order of lists, as no word is frequent
    own, both, rest = v[:10], v[10:15], v[15:100]
    x, y = both + rest, own + both + rest
    sets = [x, y] + [both[:2] + rest[:9] + v[100 + 100 * k : 179 + 100 * k] for k in (0, 1)] + [own + both[2:4] + v[300 + 100 * k : 388 + 100 * k] for k in (0, 1)]
    assert len(x) * 10 == len(y) * 9
    rows = [(i, " ".join(w), "s") for i, w in enumerate(sets)]
    got = ngram_join.join(spark, documents(spark, rows), 1, 90).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5}


def test_divide_skip():
    rng = np.random.default_rng(2)
    held = rng.random((30, 50)) < rng.random((30, 1))
    lists = [np.flatnonzero(h) for h in held]
    begins = np.append(0, np.cumsum([len(x) for x in lists]))
    codes = np.arange(30)
    for need in range(1, 31):
        found, count = ngram_join.divide_skip(np.concatenate(lists), begins, 50, codes, need, np.ones(50, bool))
        want = np.flatnonzero(held.sum(0) >= need)
        assert found.tolist() == want.tolist() and count.tolist() == held.sum(0)[want].tolist()


# 8


def brute_passages(rows, least):
    held = {}
    texts = {}
    for i, t, _ in rows:
        w = split(t)
        texts.setdefault((i, t), w)
        for k in range(len(w) - least + 1):
            held.setdefault(tuple(w[k : k + least]), set()).add((i, t))
    out = set()
    for (i, t), w in texts.items():
        at = [k for k in range(len(w) - least + 1) if len(held[tuple(w[k : k + least])]) > 1]
        while at:
            n = 1
            while n < len(at) and at[n] <= at[n - 1] + least:
                n += 1
            out.add((i, at[0], at[n - 1] + least - at[0]))
            at = at[n:]
    return out


def test_passages(spark):
    rng = random.Random(8)
    phrase = [f"p{k}" for k in range(60)]
    new = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(i, " ".join(new(rng.randrange(80)) + phrase[: 49 + i % 12] + new(30)), "s") for i in range(30)]
    rows += [(100, " ".join(phrase + new(5) + phrase), "s"), (101, "same " * 200, "s"), (102, "SAME " * 120, "s"), (103, "solo " * 200, "s"), (104, None, "s"), (105, "", "s"), (106, " ".join(new(20_000) + phrase), "s"), (107, " ".join(phrase[:50]), "s"), (108, " ".join(phrase[:50]), "s"), (108, " ".join(phrase[:50]), "s"), (109, " ".join(new(300)), "s")]
    got = suffix_dedup.passages(spark, documents(spark, rows)).collect()
    # equal words in other case are different texts; in the brute force too
    assert {(r.doc_id, r.first_word, r.n_words) for r in got} == brute_passages(rows, 50)
    assert all(r.other_doc_id != r.doc_id for r in got) and len(got) == len({tuple(r) for r in got})
    assert suffix_dedup.passages(spark, documents(spark, [])).count() == 0
    nulls = suffix_dedup.passages(spark, documents(spark, [(None, " ".join(phrase), "s"), (1, " ".join(phrase), "s")])).collect()
    assert {(r.doc_id, r.n_words) for r in nulls} == {(None, 60), (1, 60)}


@pytest.mark.parametrize(("group", "chunk"), [(4096, 1 << 15), (0, 1), (3, 7)])
def test_passages_among_few_words(spark, monkeypatch, group, chunk):
    """Few words, so that runs have many likes that agree to the left or to the right only; hot runs and cut chunks."""
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rng = random.Random(11)
    stock = [[f"v{rng.randrange(6)}" for _ in range(40)] for _ in range(4)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randrange(1, 5)):
            a = rng.randrange(30)
            w += rng.choice(stock)[a : a + rng.randrange(3, 25)] + [f"v{rng.randrange(9)}" for _ in range(rng.randrange(3))]
        rows.append((i, " ".join(w), "s"))
    for least, gram in ((12, 4), (9, 3), (7, 7)):
        got = suffix_dedup.passages(spark, documents(spark, rows), least, gram).collect()
        want = brute_passages(rows, least)
        assert {(r.doc_id, r.first_word, r.n_words) for r in got} == want and len(got) == len(want) > 100
        texts = {i: split(t) for i, t, _ in rows}
        for r in got:
            first = texts[r.doc_id][r.first_word : r.first_word + least]
            assert r.other_doc_id != r.doc_id and any(texts[r.other_doc_id][k : k + least] == first for k in range(len(texts[r.other_doc_id])))


# 9

PAGES = [
    ("<p>a &amp; b&nbsp;<b>c<i>d</b> x<br>y<p>z", "a & b cd x y\n\nz"),
    ('<div id="main"><p>Hello</p><div class="ad-slot">buy</div><ul><li><a href=x>l</a><li>two</ul></div><footer>f', "Hello\n\ntwo"),
    ('<nav>n</nav><article><h1>T</h1><p>x<p>y<div class="comments"><p>c</div><aside>q</aside><p>a < b && c &lt;d&gt; <artic', "T\n\nx\n\ny\n\na < b && c <d>"),
    ('<body><header>h</header><main><header>own</header><p>q</main><script>x="</p>"', "own\n\nq"),
    ("", ""), (None, ""), ("plain &eacute; &#233; &#xe9; text", "plain é é é text"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
    ("<p>1<!-- <p>no --><p>2<style>p{}</style><p>3<textarea>q</textarea>4<form>f</form>", "1\n\n2\n\n3 4"),
    ('<title>t</title><p title="a>b">in</p><p hidden>no</p><div role="navigation">no</div><div class="cookieNotice">no</div>', "in"),
    ("<head><title>x</title><body><p>y", "y"),
    ("<p>cut <a hre", "cut"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_extract(page, text):
    assert html_extraction.extract(page) == text


def wrapper_of(*pages):
    both = html_extraction.structure(html_extraction.slots(pages[0]))
    for page in pages[1:]:
        both = html_extraction.align(both, html_extraction.structure(html_extraction.slots(page)))
    return both


def test_wrapper():
    a, b = "<div><p>one<p>two</div><div class=end>same</div>", "<div><h2>t</h2><p>x</div><div class=end>same</div>"
    assert html_extraction.expression(wrapper_of(a, b)) == "<div>(<h2>#constant</>)?(<p>#text</>)+</><div.end>#constant</>"
    both = html_extraction.Wrapper(wrapper_of(a, b, b, b, b))
    assert [both.says(p) for p in (("div", "h2"), ("div.end",), ("div", "p"))] == [html_extraction.CONSTANT, html_extraction.CONSTANT, html_extraction.KEEP]


def test_groups_of_several_tags():
    lists = ["<dl>" + "".join(f"<dt>t{i}{k}<dd>d{i}{k}" for k in range(i)) + "</dl>" for i in (3, 1, 2)]
    assert html_extraction.expression(wrapper_of(*lists)) == "<dl>(<dt>#text</><dd>#text</>)+</>"
    news = ["".join(f"<h2>h{i}{k}</h2>" + f"<p>p{i}{k}</p>" * n for k, n in enumerate(x)) for i, x in enumerate([(1, 2, 1), (1,), (3, 1)])]
    assert html_extraction.expression(wrapper_of(*news)) == "(<h2>#text</>(<p>#text</>)+)+"


def test_main_text(spark):
    pages = [(i, f"http://Host.example/{i}", f"<div><p>text {i}</p></div><div class=line>printed daily</div>") for i in range(5)]
    pages += [(10, None, "<p>no host"), (11, "not a url", "<p>x"), (12, "http://host.example/", None), (12, "http://host.example/", None), (None, "http://u@other.example:80/p", "<p>o")] + [(20 + i, f"https://s.example/{i}", h) for i, (h, _) in enumerate(PAGES)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = html_extraction.main_text(spark, df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {r.page_id: r.text for r in got.collect()}
    assert [found[i] for i in range(5)] == [f"text {i}" for i in range(5)]
    assert found[10] == "no host" and found[11] == "x" and found[12] == "" and found[None] == "o"
    assert got.count() == len(pages) and all(r.n_chars == len(r.text) for r in got.collect())
    assert html_extraction.main_text(spark, df.limit(0)).count() == 0


def main_texts(spark, pages):
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    return [r.text for r in sorted(html_extraction.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r.page_id)]


def test_wrapper_inside_main(spark):
    pages = [f"<main><div class=strip>all the news</div><p>text {i}<ul class=more><li><a href=x>see {i}a</a><li><a href=y>see {i}b</a></ul></main>" for i in range(4)]
    assert main_texts(spark, pages) == [f"text {i}" for i in range(4)]
    refs = "<main><p>own<ul class=refs><li><a href=x>source a</a><li><a href=y>source b</a></ul></main>"
    assert main_texts(spark, [refs] + [f"<main><p>text {i}</main>" for i in range(4)])[0] == "own\n\nsource a\n\nsource b"


def test_copies_and_links_outside_main(spark):
    copy = "<div><h1>Head</h1><div class=body>only text</div></div>"
    assert main_texts(spark, [copy] * 4) == ["Head\n\nonly text"] * 4
    pages = [f"<div class=post><p>text {i}</p></div>" for i in range(4)]
    assert main_texts(spark, pages + [copy] * 3)[4:] == ["Head\n\nonly text"] * 3
    pages = [f"<div class=post><h2><a href=x>Title {i}</a></h2><div class=body>text {i}</div></div>" for i in range(4)]
    assert main_texts(spark, pages) == [f"Title {i}\n\ntext {i}" for i in range(4)]


def test_deep_wide_and_repeated_pages(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert html_extraction.extract(deep) == "deep" and main_texts(spark, [deep, deep.replace("deep", "low"), deep])[1] == "low"
    pages = ["<body>" + "".join(f"<div class=x{'abcdefghij'[i]}{''.join('abcdefghij'[int(c)] for c in str(k))}><p>text {i} {k}</p></div>" for k in range(3000)) + "<div class=sidebar>menu</div>" for i in range(4)]
    wrapper = wrapper_of(*pages)
    nodes = [wrapper]
    for n in nodes:
        nodes += n[7]
    assert len(nodes) < html_extraction.WIDTH
    assert main_texts(spark, pages)[2] == "\n\n".join(f"text 2 {k}" for k in range(3000))
    copy = '<div class="post"><p>all there is</p></div>'
    assert main_texts(spark, [copy] * 3) == ["all there is"] * 3
    assert html_extraction.extract("<p>" + "word " * 500_000) == " ".join(["word"] * 500_000)


def test_words_of_classes_are_evidence_only(spark):
    assert html_extraction.extract('<article><p>a</p><section id="discussion"><p>Results <p>more</section></article>') == "a\n\nResults\n\nmore"
    assert html_extraction.extract('<article><div data-id="comments"><p>text</div></article>') == "text"
    assert html_extraction.extract('<article title="x class=ad"><p>text</article>') == "text"
    remarks = "".join(f"<div class=c><b>u{k}</b><p>I think {k}</div>" for k in range(3))
    assert html_extraction.extract(f"<article><p>a</p><section id=discussion>{remarks}</section></article>") == "a"
    assert html_extraction.extract(f"<p>a</p><div class=comments>{remarks * 9}</div>") == "a"
    # the host's body, whatever its name
    assert main_texts(spark, [f"<div class=widget-body><p>long text of page {i}</p></div><div class=ad>buy {i}</div>" for i in range(4)]) == [f"long text of page {i}" for i in range(4)]


INSIDE = [
    ("<h1>Dish {i}</h1><h2>Ingredients</h2><ul><li>egg {i}<li>milk {i}</ul><h2>Method</h2><p>stir {i}", "Dish {i}|Ingredients|egg {i}|milk {i}|Method|stir {i}"),
    ("<h2>Abstract</h2><p>stir {i}</p><h2>Body {i}</h2><p>q {i}<p>r {i}<h2>Conclusion</h2><p>end {i}", "Abstract|stir {i}|Body {i}|q {i}|r {i}|Conclusion|end {i}"),
    ("<table><tr><th>Name<th>Price<tr><td>tea {i}<td>{i} cents</table>", "Name|Price|tea {i}|{i} cents"),
    ("<h1>T {i}</h1><section class='market-share'><h3>Head {i}</h3><p>p {i}</section>", "T {i}|Head {i}|p {i}"),
    ("<h1>T {i}</h1><section id=tasting-menu-notes><p>p {i}</section>", "T {i}|p {i}"),
    ("<h1>T {i}</h1><p>text {i}<div class=editor-comment><p>p {i}</div>", "T {i}|text {i}|p {i}"),
    ("<h1>T {i}</h1><p>text {i}</p><h2>Sources</h2><ul><li><a href=a>one {i}</a><li><a href=b>two {i}</a></ul>", "T {i}|text {i}|Sources|one {i}|two {i}"),
    ("<h1>T {i}</h1><p>text {i}</p><ul class=refs><li><a href=a>one {i}</a><li><a href=b>two {i}</a></ul>", "T {i}|text {i}|one {i}|two {i}"),
    ("<p>text {i}</p><div class=usercomments><div><b>me</b><p>I say {i}</div><div><b>you</b><p>no {i}</div></div>", "text {i}"),
    ("<p>text {i}</p><div class=responses><div><b>me</b><p>I say {i}</div><div><b>you</b><p>no {i}</div></div>", "text {i}"),
    ("<h3>Sections</h3><ul><li><a href=a>Home</a><li><a href=b>About</a></ul><h1>T {i}</h1><p>text {i}</p><div class=strip>Buy now</div><div class='inline-ad'>get {i}</div>", "T {i}|text {i}"),
    ("<h1>T {i}</h1><p>text {i}<div class=share-buttons>Share this</div><div class='cookie-notice'><h3>Cookies</h3>We use them</div>", "T {i}|text {i}"),
]


@pytest.mark.parametrize(("page", "text"), INSIDE)
def test_structure_decides_inside_articles(spark, page, text):
    pages = [f"<header>Daily</header><article>{page.format(i=i)}</article><footer>end</footer>" for i in range(6)]
    assert main_texts(spark, pages) == [text.format(i=i).replace("|", "\n\n") for i in range(6)]


def random_site(rng, article):
    """Pages of one random template, and their main texts."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    line = lambda: " ".join(word() for _ in range(rng.randrange(4, 20)))
    box, lead, foot, links = word(), line(), line(), [word() for _ in range(4)]
    out = []
    for _ in range(8):
        blocks, body = [line()], []
        body.append(f"<h1>{blocks[0]}</h1>")
        for _ in range(rng.randrange(1, 6)):
            kind = rng.randrange(3)
            new = [line() for _ in range(rng.randrange(1, 4))]
            body.append(["".join(f"<p>{x}</p>" for x in new), "<ul>" + "".join(f"<li>{x}" for x in new) + "</ul>", "<dl>" + "".join(f"<dt>{x}<dd>{x}" for x in new) + "</dl>"][kind])
            blocks += [y for x in new for y in ([x, x] if kind == 2 else [x])]
        tag = "article" if article else "div"
        menu = "".join(f"<li><a href=x>{x}</a>" for x in links)
        remarks = "".join(f"<div class=one><b>{word()}</b><p>{line()}</div>" for _ in range(rng.randrange(4)))
        out.append((f"<body><div class={word() if rng.random() < 0.1 else 'zz'}><ul>{menu}</ul></div><div class=lead>{lead}</div><{tag} class=q{box}>{''.join(body)}</{tag}><div class=comments>{remarks}</div><p class=end>{foot}</p>", "\n\n".join(blocks)))
    return out


def test_random_sites(spark):
    rng = random.Random(9)
    sites = [random_site(rng, k % 2) for k in range(24)]
    rows = [(100 * k + i, f"http://h{k}.example/{i}", page) for k, site in enumerate(sites) for i, (page, _) in enumerate(site)]
    got = {r.page_id: r.text for r in html_extraction.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == {100 * k + i: text for k, site in enumerate(sites) for i, (_, text) in enumerate(site)}
    # without their wrappers pages keep what is the host's own
    assert all(html_extraction.extract(page) != text for page, text in sites[0])


# 10


def brute_pieces(word, start, inside):
    n, known = 0, start
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in known), 0)
        if not k:
            return 1
        word, n, known = word[k:], n + 1, inside
    return n


def test_automaton():
    rng = random.Random(4)
    for trial in range(60):
        make = lambda: {bytes(rng.choice(b"ab ") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))}
        start = make()
        inside = make() if trial % 2 else None
        a = token_counts.Automaton(start, inside)
        for _ in range(100):
            w = bytes(rng.choice(b"ab ") for _ in range(rng.randrange(1, 14)))
            assert a.count(w) == brute_pieces(w, start, start if inside is None else inside), (start, inside, w)


def test_token_counts(spark):
    pieces = set(token_counts.read_pieces(token_counts.VOCABULARY))
    rows = [(1, "Hello  wörld\n", "s"), (2, None, "s"), (3, "", "s"), (None, "x" * 30_000 + " y", "s"), (5, "a b", "s"), (5, "a b", "s")]
    got = token_counts.count_tokens(spark, documents(spark, rows)).collect()
    want = [(i, len((t or "").split()), sum(brute_pieces(b" " + w, pieces, pieces) if len(w) < 100 else -1 for w in (t or "").encode().split())) for i, t, _ in rows if i]
    assert sorted(tuple(r) for r in got if r.doc_id) == sorted(want) and next(r for r in got if r.doc_id is None).n_words == 2
    assert token_counts.count_tokens(spark, documents(spark, [])).count() == 0
