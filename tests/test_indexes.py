"""Stored indexes, answers, ledgers and document states: each against an exact scan or a plain count, with restarts between."""

import http.server
import json
import math
import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallystone.functions import json_text as js
from tallystone.functions.text import two_places
from tallystone.operators import extraction as ex
from tallystone.operators import monitoring
from tallystone.operators import relational as rel
from tallystone.operators import retrieval as ret
from tallystone.schema import GATES
from tallystone.sources import answers, changelog, filters, postings, store, vectors
from tallystone.sources.shared import exists
from tallystone.streaming import documents, ledger

UNIT = "project_id int, unit int, kind string, text string"


def corpus(seed, n=700):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [(rng.randrange(2), i, rng.choice(["EL", "MOM"]), " ".join(rng.choices(words, [1 / (1 + k) for k in range(60)], k=rng.randrange(1, 40)))) for i in range(n)]
    # few units are about the rare words, so most blocks can't matter
    rows += [(0, n + i, "EL", "rare " * 9 + f"w{i}") for i in range(12)]
    return [*rows, (0, 9000, "EL", None), (1, 9001, None, "  "), (1, 9002, None, "W1 w1 Only")]


# postings


def test_postings_equal_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "UNITS", 16)
    monkeypatch.setattr(postings, "FIRST_BLOCKS", 1)
    units = spark.createDataFrame(corpus(1), UNIT)
    path = str(tmp_path / "index")
    for part in ("unit % 3 = 0", "unit % 3 = 1", "unit % 2 = 0", "true", "unit < 0"):
        postings.append(spark, path, units.where(part))
    asked = spark.createDataFrame([(1, 0, "rare"), (2, 0, "w0 w0 W1 w59"), (3, 1, "w30 only"), (4, 1, "nowhere"), (5, 9, "w1"), (6, 0, ""), (7, 0, None)], "query_id int, project_id int, text string")
    search = postings.Search(spark, path, asked, k=5)
    plain = ret.bm25_batch(units, asked, "project_id", "unit")
    best = sorted((r.query_id, -round(r.score, 9), r.unit) for r in plain.collect())
    want = [x for i, x in enumerate(best) if sum(y[0] == x[0] for y in best[:i]) < 5]
    got = sorted((r.query_id, -round(r.score, 9), r.unit) for r in search.hits.collect())
    assert [(q, u) for q, _, u in got] == [(q, u) for q, _, u in want] and all(math.isclose(a[1], b[1], abs_tol=2e-9) for a, b in zip(got, want, strict=True))
    # the query for rare words leaves most blocks unread
    assert search.read.where("query_id = 1").count() * 2 < search.bounds.where("query_id = 2").count()
    only = postings.Search(spark, path, asked, k=5, kinds=["MOM"]).hits
    assert {r.kind for r in only.collect()} == {"MOM"} and only.where("query_id = 2").count() == 5


def test_statistics_add_up(spark, tmp_path):
    units = spark.createDataFrame(corpus(2, 120), UNIT)
    once, often = str(tmp_path / "once"), str(tmp_path / "often")
    postings.append(spark, once, units)
    for i in range(4):
        postings.append(spark, often, units.where(f"unit % 4 >= {i}"))  # what is given again counts once
    a, b = ([tuple(round(x, 9) for x in r) for r in postings.statistics(spark, p).orderBy("project_id").select("project_id", "n", "words", "n_terms", "avgdl", "eps").collect()] for p in (once, often))
    assert a == b and len(a) == 2
    # an append that is cut short leaves rows that nothing reads
    spark.read.parquet(f"{often}/sizes").where("n > 0").withColumn("gen", F.lit("lost")).write.mode("append").partitionBy("gen").parquet(f"{often}/sizes")
    assert [tuple(round(x, 9) for x in r) for r in postings.statistics(spark, often).orderBy("project_id").select("project_id", "n", "words", "n_terms", "avgdl", "eps").collect()] == b


def test_postings_plan_reads_no_texts(spark, tmp_path):
    path = str(tmp_path / "index")
    postings.append(spark, path, spark.createDataFrame(corpus(3, 60), UNIT))
    search = postings.Search(spark, path, spark.createDataFrame([(1, 0, "w0")], "query_id int, project_id int, text string"))
    plan = search.hits._jdf.queryExecution().toString()
    assert "PartitionFilters: [gen" in plan.replace("PartitionFilters: [isnotnull(gen", "PartitionFilters: [gen") or "bucket" in plan.split("PartitionFilters")[1]
    assert "text" not in [c for f in ("postings", "terms", "sizes", "shape", "units") for c in spark.read.parquet(f"{path}/{f}").columns]
    with pytest.raises(ValueError):
        postings.Search(spark, str(tmp_path / "none"), spark.createDataFrame([(1, 0, "w0")], "query_id int, project_id int, text string"))


def test_a_project_with_most_texts_is_dealt_over_tasks(spark, tmp_path):
    rows = spark.range(20_000).select(F.lit(1).alias("project_id"), F.lit("the").alias("t"), F.lit(5).alias("bucket"), F.col("id").alias("b"))
    sizes = [r["count"] for r in postings._dealt(rows, 640, "project_id", "t", "b").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2300 and sum(sizes) == 20_000
    units = spark.createDataFrame([(1, i, "EL", f"the the w{i % 300}") for i in range(900)] + [(2, 5000, "EL", "the end"), (None, 5001, "EL", "the none")], UNIT)
    path = str(tmp_path / "index")
    postings.append(spark, path, units)
    held = spark.read.parquet(f"{path}/postings")
    assert {tuple(r) for r in held.where("t = 'the'").groupBy("project_id").agg(F.sum("n"), F.sum(F.size("entries")), F.countDistinct("block")).collect()} == {(1, 900, 900, 8), (2, 1, 1, 1)}
    # a task writes its own few buckets
    assert len(spark.read.parquet(f"{path}/terms").inputFiles()) <= 64 + 4 and len(held.inputFiles()) <= 64 + 4


def test_a_search_takes_its_words_rows_only(spark, tmp_path):
    path = str(tmp_path / "index")
    postings.append(spark, path, spark.createDataFrame(corpus(3, 60), UNIT))
    asked = spark.createDataFrame([(1, 0, "w0 w1")], "query_id int, project_id int, text string")
    search = postings.Search(spark, path, asked)
    assert {r.t for r in search.postings.select("t").distinct().collect()} == {"w0", "w1"}


# vectors


def test_vector_lists(spark, tmp_path):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    rows = [(i % 2, i, "ab"[i % 3 == 0], [c + rng.gauss(0, 0.15) for c in centres[rng.randrange(20)]]) for i in range(1500)] + [(0, 5000, "a", None)]
    held = spark.createDataFrame(rows, "by int, unit int, kind string, embedding array<float>")
    path = str(tmp_path / "index")
    vectors.fit(spark, path, held, lists=24)
    for part in ("unit < 900", "unit >= 900"):
        vectors.append(spark, path, held.where(part))
    asked = held.where("unit % 100 = 0 and embedding is not null").select(F.col("unit").alias("query_id"), "by", F.col("embedding").alias("vector"))

    def plain(**limits):
        units = held.where("embedding is not null").where(" and ".join(limits.values()) or "true")
        return sorted((r.query_id, r.rank, r.unit) for r in ret.dense_batch(units, asked, "by", "unit", 10).collect())

    sure = vectors.Search(spark, path, asked, probes=2)
    assert sorted((r.query_id, r.rank, r.unit) for r in sure.hits.collect()) == plain()
    assert sure.opened.count() < 24 * asked.count()  # lists that can't matter stay closed
    quick = vectors.Search(spark, path, asked, probes=4, certify=False)
    want = {(q, u) for q, _, u in plain()}
    assert len(want & {(r.query_id, r.unit) for r in quick.hits.collect()}) >= 0.95 * len(want)
    assert quick.opened.count() == 4 * asked.count()
    few = vectors.Search(spark, path, asked, probes=2, kinds=["b"], where=F.col("unit") > 100)
    assert sorted((r.query_id, r.rank, r.unit) for r in few.hits.collect()) == plain(a="kind = 'b'", b="unit > 100")


def test_nearest_of_a_group_keeps_ties_and_floors():
    import pyarrow as pa

    x = [[0.0, float(i // 40)] for i in range(200)] + [[None, 1.0]]
    table = pa.table({"unit": list(range(len(x) - 1, -1, -1)), "kind": ["a"] * len(x), "embedding": pa.array(x, pa.list_(pa.float32()))})
    asked = pa.table({"query_id": [1, 2], "vector": pa.array([[0.0, 0.0], [0.0, 4.0]], pa.list_(pa.float32())), "floor": pa.array([None, 0.5], pa.float64())})
    got = vectors._nearest(5)(table, asked).to_pylist()
    # forty equal vectors: the five smallest units are among them, and no more than five of each distance
    assert [r["unit"] for r in got if r["query_id"] == 1] == [161, 162, 163, 164, 165] and {r["distance"] for r in got} == {0.0}
    assert [r["unit"] for r in got if r["query_id"] == 2] == [1, 2, 3, 4, 5]
    assert len(vectors._nearest(5)(table.slice(0, 0), asked)) == 0


def test_lists_and_queries_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP", 16)
    rng = random.Random(9)
    held = spark.createDataFrame([(i % 2, i, "a", [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)], "by int, unit int, kind string, embedding array<float>")
    path = str(tmp_path / "index")
    vectors.fit(spark, path, held, lists=3)
    vectors.append(spark, path, held)
    asked = held.where("unit % 10 = 0").select(F.col("unit").alias("query_id"), "by", F.col("embedding").alias("vector"))
    search = vectors.Search(spark, path, asked, probes=1)
    want = sorted((r.query_id, r.rank, r.unit) for r in ret.dense_batch(held, asked, "by", "unit", 10).collect())
    assert sorted((r.query_id, r.rank, r.unit) for r in search.hits.collect()) == want
    # distances are made by groups, not by a row for each pair
    assert "FlatMapCoGroupsInArrow" in search.hits._jdf.queryExecution().toString()


# ids


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_dense_ids_lose_nothing(spark, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rows = spark.range(60_000).select((F.hash("id") % 7).alias("k"), F.col("id").alias("v"), F.repeat(F.lit("x"), 900).alias("wide"))
        got = store.with_ids(rows, spark.createDataFrame([], "id long"), ["k"]).select("id", "k", "v").toPandas().sort_values("id")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got["id"].tolist() == list(range(1, 60_001)) and got["k"].is_monotonic_increasing and got["v"].nunique() == 60_000


def test_dense_ids_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, None), (None, None), ("a", {"x": 1}), ("a", {"x": 1})], "k string, m map<string,int>")
    got = store.with_ids(rows, spark.createDataFrame([(5,)], "id long"), ["k"]).orderBy("id").collect()
    assert [(r.id, r.k) for r in got] == [(6, None), (7, None), (8, "a"), (9, "a")]
    assert store.with_ids(rows.limit(0), rows.limit(0).select(F.lit(1).alias("id")), ["k"]).count() == 0


# answers


def test_answers_ask_nothing_twice(spark, tmp_path):
    path, log = str(tmp_path / "answers"), str(tmp_path / "log")

    def connect(bad):
        def client(prompt):
            with open(log, "a") as f:
                f.write(prompt + "\n")
            if bad and prompt in ("p3", "p7"):
                raise OSError("line is down")
            return prompt.upper()

        return lambda: client

    rows = spark.createDataFrame([(f"p{i % 10}", i) for i in range(30)] + [(None, 99)], "prompt string, i int")
    assert answers.ask(spark, path, rows.where("i % 10 < 4"), "prompt", connect(True), batch=2) == 4
    assert answers.ask(spark, path, rows, "prompt", connect(True), batch=2) == 7  # six new ones, and what failed
    found = {r.prompt: (r.payload, r.payload_error) for r in answers.answered(spark, path, rows, "prompt").collect()}
    assert found["p3"] == (None, "line is down") and found["p5"] == ("P5", None) and found[None] == (None, None)
    assert answers.ask(spark, path, rows, "prompt", connect(False)) == 2
    assert answers.ask(spark, path, rows, "prompt", connect(False)) == 0
    assert Counter(open(log).read().split()) == Counter({**{f"p{i}": 1 for i in range(10)}, "p3": 3, "p7": 2})
    assert answers.answered(spark, path, rows, "prompt").where("payload is null").count() == 1


def test_answers_after_a_killed_run(spark, tmp_path, monkeypatch):
    """A run that ends between two batches has settled the first."""
    path = str(tmp_path / "answers")
    rows = spark.createDataFrame([(f"p{i}",) for i in range(40)], "prompt string")
    asker, runs = answers._asker, []

    def once(*args):
        runs.append(1)
        if len(runs) > 1:
            raise KeyboardInterrupt
        return asker(*args)

    monkeypatch.setattr(answers, "_asker", once)
    with pytest.raises(KeyboardInterrupt):
        answers.ask(spark, path, rows, "prompt", lambda: str.upper, batch=20)
    done = answers.stored(spark, path).where("answer is not null").count()
    monkeypatch.setattr(answers, "_asker", asker)
    assert 0 < done < 40 and answers.ask(spark, path, rows, "prompt", lambda: str.upper, batch=20) == 40 - done


def test_answers_late_and_unreachable(spark, tmp_path):
    def slow():
        import time

        return lambda p: time.sleep(1.5) or p if p == "slow" else p

    def none():
        raise OSError("no route")

    rows = spark.createDataFrame([("slow",), ("fast",)], "prompt string").coalesce(1)
    answers.ask(spark, str(tmp_path / "a"), rows, "prompt", slow, timeout=0.4)
    assert {r.prompt: (r.payload, r.payload_error) for r in answers.answered(spark, str(tmp_path / "a"), rows, "prompt").collect()} == {"slow": (None, "no answer in 0.4 s"), "fast": ("fast", None)}
    answers.ask(spark, str(tmp_path / "b"), rows, "prompt", none)
    assert [r.error for r in answers.stored(spark, str(tmp_path / "b")).collect()] == ["no route"] * 2


def test_http_client(spark, tmp_path):
    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(500 if asked["prompt"] == "break" else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"response": f"{asked['model']}: {asked['prompt']}"} if asked["prompt"] else {}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = spark.createDataFrame([("hello",), ("break",), ("",)], "prompt string")
    answers.ask(spark, str(tmp_path / "a"), rows, "prompt", answers.http_client(f"http://127.0.0.1:{server.server_port}/", "m", 5))
    server.shutdown()
    found = {r.prompt: (r.payload, r.payload_error) for r in answers.answered(spark, str(tmp_path / "a"), rows, "prompt").collect()}
    assert found["hello"] == ("m: hello", None) and found[""] == ("", None) and "500" in found["break"][1]


# ledger


OUT = "project_id int, item_type string, reference_id int, email string, subject string"


def mailbox(log, bad=()):
    def connect():
        def send(row):
            if row["email"] in bad:
                raise ConnectionError("refused")
            with open(log, "a") as f:
                f.write(f"{row['reference_id']} {row['email']}\n")

        return send

    return connect


def test_alerts_go_out_once(spark, tmp_path):
    path, log = str(tmp_path / "ledger"), str(tmp_path / "log")
    first = spark.createDataFrame([(1, "NEW_REQUEST", i, f"m{i % 3}", "s") for i in range(6)] + [(1, "NEW_REQUEST", 0, "m0", "again"), (None, None, None, "m9", None)], OUT)
    ledger.send_batch(first, 0, path, mailbox(log, {"m2"}))
    ledger.send_batch(first, 0, path, mailbox(log))  # the same batch again
    ledger.send_batch(first.where("reference_id > 3").union(spark.createDataFrame([(1, "NEW_REQUEST", 50, "m1", "s")], OUT)), 1, path, mailbox(log))
    lines = Counter(open(log).read().split("\n")[:-1])
    assert set(lines.values()) == {1} and len(lines) == 6
    found = ledger.ledger(spark, path)
    assert found.count() == 8 and {r.error for r in found.where("not sent").collect()} == {"refused"} and found.where("not sent").count() == 2
    ledger.send_batch(first, 2, path, mailbox(log), retry=True)
    assert ledger.ledger(spark, path).where("sent").count() == 8 and ledger.unconfirmed(spark, path).count() == 0


def test_the_ledger_grows_with_items_and_people(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "PEOPLE", 8)
    kinds = "project_id int, item_type string, reference_id int, requires_escalation boolean, risk_score double"
    items = spark.createDataFrame([(i % 2, "NEW_REQUEST", i, True, 0.1) for i in range(40)] * 2 + [(None, "NEW_REQUEST", 7, True, 0.1), (1, "ACTIVITY", 8, True, 0.1)], kinds)
    crowd = [(p, f"m{i}", "PROJECT_LEAD") for p in range(2) for i in range(20)] * 2 + [(0, None, "PROJECT_LEAD"), (0, "x", "ADMIN")]
    people = spark.createDataFrame(crowd, "project_id int, email string, role string")
    path, log = str(tmp_path / "ledger"), str(tmp_path / "log")
    lines = lambda: Counter(open(log).read().split("\n")[:-1])
    for number, part in enumerate(("project_id = 0", "true", "true")):
        about, person = ledger.send_alerts(items.where(part), people, number, path, mailbox(log, {"m3"}))
    want = {f"{i} m{j}" for i in range(40) for j in range(20) if j != 3} | {f"{i} None" for i in range(0, 40, 2)}
    assert lines() == Counter(want)
    # 820 alerts: an item has a row for each of the three sets of its project, whose people are stored once
    assert spark.read.parquet(f"{path}/items").count() == 120 and spark.read.parquet(f"{path}/sets").select(F.explode("people")).count() <= 41
    found = ledger.entries(spark, path, about, person)
    assert found.columns == ["project_id", "item_type", "reference_id", "email", "role", "subject", "batch", "sent", "error"]
    assert found.count() == 820 and found.where("error = 'refused' and not sent").count() == found.where("email = 'm3'").count() == 40
    plain = ledger.ledger(spark, path)
    keys = found.select(F.sha2(F.to_json(F.struct(*ledger.KEY), {"ignoreNullFields": "false"}), 256).alias("key"))
    assert plain.join(keys, "key").count() == plain.count() == 820
    # one more person: who has an alert gets no second one
    more = people.unionByName(spark.createDataFrame([(1, "m10x", "PROJECT_LEAD")], people.schema))
    ledger.send_alerts(items, more, 3, path, mailbox(log, {"m3"}))
    want |= {f"{i} m10x" for i in range(1, 40, 2)}
    assert lines() == Counter(want) and ledger.ledger(spark, path).count() == 840
    # a retry, by rows, of those that failed, and another for who fails again
    outbox = monitoring.alerts(items, more).drop("role")
    ledger.send_batch(outbox.where("reference_id < 30"), 4, path, mailbox(log), retry=True)
    ledger.send_batch(outbox, 5, path, mailbox(log, {"m3"}), retry=True)
    assert lines() == Counter(want | {f"{i} m3" for i in range(30)})
    ledger.send_batch(outbox, 6, path, mailbox(log), retry=True)
    want |= {f"{i} m3" for i in range(40)}
    assert lines() == Counter(want) and ledger.ledger(spark, path).where("sent").count() == 840
    assert ledger.entries(spark, path, about, person).where("sent and batch < 4000").count() == 840


def test_a_key_of_one_column(spark, tmp_path):
    path, log = str(tmp_path / "ledger"), str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "NEW_REQUEST", i, f"m{i % 2}", "s") for i in range(6)], OUT)
    for number in range(2):
        ledger.send_batch(rows, number, path, mailbox(log), key=("email",))
    assert len(open(log).read().split("\n")[:-1]) == 2
    assert {json.loads(r.alert)["email"] for r in ledger.ledger(spark, path).where("sent").collect()} == {"m0", "m1"}


def test_a_batch_that_died_is_not_sent_again(spark, tmp_path, monkeypatch):
    path, log = str(tmp_path / "ledger"), str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "NEW_REQUEST", i, "m", "s") for i in range(3)], OUT)
    with monkeypatch.context() as m:
        m.setattr(ledger, "deliver", lambda *_: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            ledger.send_batch(rows, 0, path, mailbox(log))
    ledger.send_batch(rows, 0, path, mailbox(log))
    assert ledger.unconfirmed(spark, path).count() == 3 and not exists(spark, log)


def test_delivery_of_a_stream(spark, tmp_path):
    path, log, source = str(tmp_path / "ledger"), str(tmp_path / "log"), str(tmp_path / "in")
    for part in range(2):
        spark.createDataFrame([(1, "NEW_REQUEST", i, "m", "s") for i in range(part, part + 3)], OUT).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(OUT).parquet(source)
        ledger.start_delivery(stream, path, str(tmp_path / "cp"), mailbox(log)).awaitTermination(120)
    # a lost checkpoint replays everything
    ledger.start_delivery(spark.readStream.schema(OUT).parquet(source), path, str(tmp_path / "cp2"), mailbox(log)).awaitTermination(120)
    assert sorted(open(log).read().split()) == sorted("0 m 1 m 2 m 3 m".split())


# documents


def test_document_states_over_restarts(spark, tmp_path):
    landed, states, cp = (str(tmp_path / x) for x in ("landed", "states", "cp"))
    kind = "project_id bigint, document_id bigint, document_name string, document_type string, uploaded_by bigint, content binary"
    rows = [(1, 1, "a.txt", "EL", 7, b"one"), (1, 2, "b.TXT", "EL", 7, b""), (2, 3, "c.docx", "EL", 7, b"no zip"), (2, 4, "d.pdf", "EL", 7, b"%PDF"), (2, 5, ".txt", "EL", 7, None)]
    documents.land(spark.createDataFrame(rows, kind), landed)
    documents.start_documents(spark, landed, states, cp).awaitTermination(120)
    first = {r.document_id: r for r in documents.final_states(spark.read.parquet(states)).collect()}
    assert {i: r.processing_status for i, r in first.items()} == {1: "COMPLETED", 2: "COMPLETED", 3: "FAILED", 4: "FAILED", 5: "FAILED"}
    assert first[4].error_message == "Unsupported file format" and all(r.storage_key.startswith(f"{r.project_id}/") for r in first.values())
    # restart: what has failed comes again with better bytes, what was completed comes again and is left alone
    again = [(1, 1, "a.txt", "EL", 7, b"changed", first[1].storage_key), (2, 4, "d.pdf", "EL", 7, b"p1|p2", first[4].storage_key)]
    more = spark.createDataFrame(again, kind + ", key string")
    documents.land(more.drop("key").join(more.select("document_id", "key"), "document_id"), landed, F.col("key"))
    documents.start_documents(spark, landed, states, cp, {".pdf": lambda b: [(i, t.decode()) for i, t in enumerate(b.split(b"|"), 1)]}).awaitTermination(120)
    held = spark.read.parquet(states)
    last = {r.document_id: (r.processing_status, r.n_pages) for r in documents.final_states(held).collect()}
    assert last[4] == ("COMPLETED", 2) and last[1] == ("COMPLETED", 1) and last[3][0] == "FAILED"
    steps = [(r.step, r.processing_status) for r in held.where("document_id = 4").select("step", "processing_status").distinct().orderBy("step").collect()]
    assert steps == [(1, "UPLOADED"), (2, "PARSING"), (3, "FAILED"), (4, "UPLOADED"), (5, "PARSING"), (6, "COMPLETED")]
    assert held.where("document_id = 1 and text is not null").first().text == "one"


def test_uploads_that_are_refused(spark):
    rows = spark.createDataFrame([("a.txt", "EL"), ("a.md", "EL"), ("a.pdf", ""), ("a.pdf", None), (None, "EL")], "document_name string, document_type string")
    users = spark.createDataFrame([(1, "PROJECT_LEAD", True), (2, "PROJECT_LEAD", False)], "id int, role string, is_active boolean")
    got = [r.error_message for r in documents.accept(rows.coalesce(1), rel.allowed(users, 1, GATES["upload_document"])).collect()]
    assert got == [None, "Unsupported file format", "Document type is required", "Document type is required", "Unsupported file format"]
    assert {r.error_message for r in documents.accept(rows, rel.allowed(users, 2, GATES["upload_document"])).collect()} == {"not allowed"}


# scores, texts and gates


def test_two_places_as_c_prints_them(spark):
    rng = random.Random(5)
    xs = [0.125, 0.845, 1.005, 2.675, 0.375, 0.005, 0.015, -1.005, -0.125, 0.0, 1.0, 4.125, 4.135, 5000.125, 5000.135, 999999.995, 1e-9]
    xs += [rng.randrange(1, 4000) / 1000 for _ in range(500)] + [rng.random() * 10 for _ in range(200)] + [rng.randrange(10**6) / 1000 for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [(r.x, r.t) for r in df.select("x", two_places(F.col("x")).alias("t")).collect()] == [(x, f"{x:.2f}") for x in xs]


def test_a_model_that_fails_keeps_the_order(spark):
    def load():
        def score(queries, texts):
            if "bad" in " ".join(queries):
                raise RuntimeError
            return [float(len(t)) for t in texts]

        return score

    df = spark.createDataFrame([("good", "aaa"), ("bad", "b"), ("good", "c"), (None, None)], "q string, t string").coalesce(1)
    assert [r[0] for r in df.select(ret.model_scorer(load)(F.col("q"), F.col("t"))).collect()] == [3.0, None, 1.0, 0.0]
    never = ret.model_scorer(lambda: (_ for _ in ()).throw(OSError("no model")))
    assert [r[0] for r in df.select(never(F.col("q"), F.col("t"))).collect()] == [None] * 4


def test_gates(spark):
    users = spark.createDataFrame([(1, "ADMIN", True), (2, "ADMIN", False), (3, "PMO_REVIEWER", None), (4, None, True)], "id int, role string, is_active boolean")
    may = {(r.user_id, r.action) for r in rel.permissions(users, GATES).collect()}
    assert {a for u, a in may if u == 3} == {"resolve_item"} and {u for u, _ in may} == {1, 3} and (1, "resolve_item") not in may
    tries = spark.createDataFrame([(1, "create_user"), (1, "resolve_item"), (2, "create_user"), (3, "resolve_item"), (4, "create_user"), (5, "x"), (1, None)], "user_id int, action string")
    got = {(r.user_id, r.action): r.error for r in rel.refused(tries, users, GATES).collect()}
    assert got == {(1, "create_user"): None, (1, "resolve_item"): "not permitted", (2, "create_user"): "inactive user", (3, "resolve_item"): None, (4, "create_user"): "not permitted", (5, "x"): "unknown user", (1, None): "not permitted"}


# change logs and newest rows


def test_change_log(spark, tmp_path):
    rng = random.Random(6)
    log = changelog.ChangeLog(spark, str(tmp_path / "log"))
    kind = "id int, status string, note string"
    truth = {i: ("OPEN", None) for i in range(200)}
    log.create(spark.createDataFrame([(i, *v) for i, v in truth.items()], kind))
    assert log.compact() == []
    for step in range(5):
        changed = {i: (f"S{step}", rng.choice([None, "n"])) for i in rng.sample(range(210), 3 if step == 3 else 25)}
        truth |= changed
        log.append(spark.createDataFrame([(i, *v) for i, v in changed.items()], kind))
        assert {r.id: (r.status, r.note) for r in log.read().collect()} == truth
        if step in (1, 3):
            touched = log.compact()
            assert {r.id: (r.status, r.note) for r in log.read().collect()} == truth
    assert len(touched) < changelog.BUCKETS  # what did not change was left alone


def test_a_compaction_that_was_cut_short(spark, tmp_path, monkeypatch):
    log = changelog.ChangeLog(spark, str(tmp_path / "log"))
    log.create(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    log.append(spark.createDataFrame([(1, "c")], "id int, v string"))
    kept = str(tmp_path / "log" / "log")
    with monkeypatch.context() as m:
        real = changelog.remove
        m.setattr(changelog, "remove", lambda s, p: (_ for _ in ()).throw(OSError) if p == kept else real(s, p))
        with pytest.raises(OSError):
            log.compact()
    assert sorted(map(tuple, log.read().collect())) == [(1, "c"), (2, "b")]
    log.append(spark.createDataFrame([(1, "d")], "id int, v string"))
    log.compact()
    assert sorted(map(tuple, log.read().collect())) == [(1, "d"), (2, "b")] and not exists(spark, kept)


def test_newest_rows_after_random_appends(spark, tmp_path):
    rng = random.Random(7)
    kind = "project_id int, id int, at int"
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.randrange(50)) for i in range(300)]
    state = changelog.Recent(spark, str(tmp_path / "recent"), "project_id", 5, F.desc("at"), F.desc("id"))
    rng.shuffle(rows)
    for i in range(0, 300, 75):
        state.append(spark.createDataFrame(rows[i : i + 75], kind))
    state.append(spark.createDataFrame(rows[:75], kind))  # again
    want = {p: [i for _, i in sorted(((a, i) for q, i, a in rows if q == p), reverse=True)[:5]] for p in (1, 2, None)}
    got = state.read().orderBy("project_id", "rn").collect()
    assert {p: [r.id for r in got if r.project_id == p] for p in want} == want
    # as a stream, over two runs
    other, source = changelog.Recent(spark, str(tmp_path / "streamed"), "project_id", 5, F.desc("at"), F.desc("id")), str(tmp_path / "in")
    for i in (0, 150):
        spark.createDataFrame(rows[i : i + 150], kind).coalesce(1).write.mode("append").parquet(source)
        other.follow(spark.readStream.schema(kind).parquet(source), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(map(str, other.read().collect())) == sorted(map(str, state.read().collect()))


# payloads


def test_variant_payloads(spark):
    cases = ['{"k": "v", "n": 5, "l": [{"a": 1}, {"b": null}, 7]}', '{"k": null, "l": {}}', "{}", None, "no json", 'x {"k": NaN} y', '{"l": null}', '[1]', '{"k": {"x": 1}}']
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").coalesce(1).select("i", js.payload(F.col("t")).alias("p"))
    got = [tuple(r) for r in df.select(js.field(F.col("p"), "k", "d"), js.field(F.col("p"), "n", None)).collect()]
    assert got == [("v", "5"), (None, None), ("d", None), ("d", None), ("d", None), ("NaN", None), ("d", None), ("d", None), ('{"x":1}', None)]
    rows = ex.variant_rows(df, "p", {"l": {"a": "x", "b": "y"}, "none": {"a": "z"}}, ["i"])
    assert [(r.i, r.list, r.pos, r.fields) for r in rows.collect()] == [(0, "l", 0, {"a": "1", "b": "y"}), (0, "l", 1, {"a": "x", "b": None}), (0, "l", 2, {"a": "x", "b": "y"})]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") <= 1 and plan.count("_constants_as_text_all") <= 1


# filters


def test_insert_if_absent_by_filters(spark, tmp_path):
    path = str(tmp_path / "store")
    kind = "project_id int, chunk_id string, text string"
    batch = lambda a, b, t: spark.createDataFrame([(i % 3, f"c{i}", t) for i in range(a, b)], kind)
    assert filters.append(spark, path, batch(0, 600, "one").union(batch(0, 50, "one"))) == (0, 600)
    asked, n = filters.append(spark, path, batch(600, 1200, "two"))
    assert n == 600 and asked < 20  # new keys hardly meet the store
    asked, n = filters.append(spark, path, batch(900, 1500, "three").union(spark.createDataFrame([(None, "x", "t"), (1, None, "t")], kind)))
    assert n == 300 and 300 <= asked < 320
    held = spark.read.parquet(path)
    assert held.count() == 1500 and {(r.text, r.n) for r in held.groupBy("text").agg(F.count("*").alias("n")).collect()} == {("one", 600), ("two", 600), ("three", 300)}
    assert filters.append(spark, path, batch(0, 1500, "again")) == (1500, 0) and filters.append(spark, path, batch(0, 0, "")) == (0, 0)
    # the same key in another project is another key
    assert filters.append(spark, path, spark.createDataFrame([(7, "c1", "other")], kind))[1] == 1


def test_filters_of_an_older_store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, f"c{i}", "old") for i in range(100)], "project_id int, chunk_id string, text string")
    store.append(spark, path, rows)
    assert filters.append(spark, path, rows.limit(40).withColumn("text", F.lit("new")))[1] == 0
    assert spark.read.parquet(path).where("text = 'old'").count() == 100


def test_alerts_of_one_project_are_dealt_over_tasks(spark):
    items = spark.createDataFrame([(1, "NEW_REQUEST", i, True, 0.1) for i in range(300)], "project_id int, item_type string, reference_id int, requires_escalation boolean, risk_score double").coalesce(1)
    people = spark.createDataFrame([(1, f"m{i}", "PROJECT_LEAD") for i in range(20)], "project_id int, email string, role string")
    out = monitoring.alerts(items, people)
    sizes = [r["count"] for r in out.withColumn("at", F.spark_partition_id()).groupBy("at").count().collect()]
    assert sum(sizes) == 6000 and out.distinct().count() == 6000
    assert len(sizes) == 4 and max(sizes) < 3500


def test_an_item_meets_people_in_lists(spark, monkeypatch):
    monkeypatch.setattr(monitoring, "PEOPLE", 8)
    kinds = "project_id int, item_type string, reference_id int, requires_escalation boolean, risk_score double, item_name string, reasoning string"
    items = spark.createDataFrame([(i % 3 or None, "NEW_REQUEST", i, True, 0.1, f"n{i}", None) for i in range(30)] * 2, kinds)
    people = spark.createDataFrame([(p, f"m{i % 15}", "PROJECT_LEAD") for p in (1, 2, 3, None) for i in range(20)] + [(1, None, "ENGAGEMENT_MANAGER"), (2, "x", "ADMIN")], "project_id int, email string, role string")
    out = monitoring.alerts(items, people)
    assert out.columns == ["project_id", "item_type", "reference_id", "email", "role", "subject", "body"]
    mails = Counter([*(f"m{i % 15}" for i in range(20))])
    want = Counter({(i % 3, i, m): 2 * n for i in range(30) if i % 3 for m, n in mails.items()}) + Counter({(1, i, None): 2 for i in range(1, 30, 3)})
    assert Counter((r.project_id, r.reference_id, r.email) for r in out.collect()) == want
    assert {r.body.split("\n")[2] for r in out.where("reference_id = 4").collect()} == {"Item: n4"}
    # the join makes a row for an item and a list, not for each alert
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate inline") < plan.index("ShuffledHashJoin")


def test_a_model_gets_few_prompts_at_once(spark):
    def model(prompts):
        if len(prompts) > 256:
            raise ValueError("too many at once")
        return [json.dumps({"scope_items": [{"name": p[-3:]}]}) for p in prompts]

    rows = spark.createDataFrame([(i, f"{i:03}") for i in range(700)], "id int, text string").coalesce(1)
    got = ex.scope_rows(ex.extract_scope(rows, model), ["id"])["scope_items"].collect()
    assert sorted((r.id, r.name) for r in got) == [(i, f"{i:03}") for i in range(700)]


def test_statistics_are_made_in_one_pass(spark):
    units = spark.createDataFrame(corpus(5, 40), UNIT)
    plan = ret.bm25(units, "rare w1", "project_id", "unit")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2  # the texts themselves; statistics are read
    blank = spark.createDataFrame([(3, 1, "EL", " "), (3, 2, "EL", None)], UNIT)
    assert ret.term_statistics(blank, "project_id").count() == 0


def test_a_frame_holds_many_documents():
    import pandas as pd

    class Held(dict):
        def getValue(self, key):  # noqa: N802
            return self.get(key)

        def updateValue(self, key, value):  # noqa: N802
            self[key] = value

    machine = documents.DocumentMachine({".txt": lambda b: [(1, b.decode())]})
    machine.status = Held()
    rows = pd.DataFrame([(1, i, f"{i}.txt", f"1/{i}", b"text", 3) for i in range(300)], columns=["project_id", "document_id", "document_name", "storage_key", "content", "shard"])
    frames = list(machine.handleInputRows((3,), iter([rows]), None))
    assert len(frames) == 1 and len(frames[0]) == 900 and set(machine.status.values()) == {("COMPLETED", 3)}
    assert not list(machine.handleInputRows((3,), iter([rows]), None))  # nothing twice
