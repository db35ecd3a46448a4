import socket
import struct

import pytest
from pyspark.sql import functions as F

from flowtide.plans import training
from flowtide.schemas import DETECTIONS, LABELLED_FLOWS, col, conform
from flowtide.sources import pcap, readers, sinks
from flowtide.streaming import packets


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_header_and_types(spark, tmp_path):
    p = write(tmp_path / "f.csv", " Source IP, Destination Port ,Flow Duration,Label\n 1.1.1.1 ,80.0,10,BENIGN\n"
                                  ",x,oops,DDoS\n2.2.2.2,22,Infinity,DDoS\n")
    rows = readers.read_flows(spark, p).collect()
    assert [(r.src_ip, r.dst_ip, r.dst_port) for r in rows] == [
        ("1.1.1.1", "Unknown", 80), ("Unknown", "Unknown", 0), ("2.2.2.2", "Unknown", 22)]
    assert [r["Flow Duration"] for r in rows] == [10.0, None, float("inf")]
    assert readers.read_flows(spark, p, max_rows=2).count() == 2


@pytest.mark.parametrize("text", ["", "A,B\n"])
def test_empty_input_is_an_error(spark, tmp_path, text):
    with pytest.raises(readers.EmptyInput):
        readers.read_flows(spark, write(tmp_path / "e.csv", text))


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(readers.EmptyInput):
        readers.read_flows(spark, str(tmp_path / "none.csv"))


def test_labelled_files_merge_and_bad_ones_are_skipped(spark, tmp_path):
    a = write(tmp_path / "a.csv", "x, y, Label\n1,2,Web Attack � XSS\n")
    b = write(tmp_path / "b.csv", "y,Label\n5,BENIGN\n")
    c = write(tmp_path / "c.csv", "y\n5\n")
    got = readers.read_labelled(spark, [a, b, c, str(tmp_path / "none.csv")]).orderBy("y").collect()
    assert [(r.x, r.y, r.Label) for r in got] == [(1.0, 2.0, "Web Attack / XSS"), (None, 5.0, "BENIGN")]
    with pytest.raises(readers.EmptyInput):
        readers.read_labelled(spark, [c])


def test_every_line_is_a_row_or_a_reject(spark, tmp_path):
    a = write(tmp_path / "a b.csv", "x, y, Label\n1,2,BENIGN\n3,4\n5,6,DDoS,7\n")
    c = write(tmp_path / "c.csv", "y\n5\n\"6,7\n")
    empty, gone = write(tmp_path / "empty.csv", ""), str(tmp_path / "none.csv")
    rows, rejects = readers.scan_labelled(spark, [a, c, empty, gone, c])
    assert [tuple(r) for r in rows.collect()] == [(1.0, 2.0, "BENIGN")]
    got = sorted((r.file.rsplit("/", 1)[1].replace("%20", " "), r.reason, r.line or "") for r in rejects.collect())
    assert got == sorted([("a b.csv", "does not fit the header", "3,4"), ("a b.csv", "does not fit the header", "5,6,DDoS,7"), ("none.csv", "missing", ""),
                          ("empty.csv", "empty", ""), *[("c.csv", "no column Label", v) for v in ("5", '"6,7') * 2]])


def test_folder_of_labelled_files(spark, tmp_path):
    for i in range(3):
        write(tmp_path / f"{i}.csv", f"x,Label\n{i},BENIGN\n")
    write(tmp_path / "other.csv", "y,Label\n9,DDoS\n")
    write(tmp_path / "empty.csv", "")
    got = readers.read_labelled_folder(spark, str(tmp_path)).orderBy("x").collect()
    assert sorted((r.x, r.y, r.Label) for r in got if r.x is not None) == [(float(i), None, "BENIGN") for i in range(3)]
    assert [(r.y, r.Label) for r in got if r.x is None] == [(9.0, "DDoS")]


def test_exporter_features(spark):
    df = spark.createDataFrame([(" 1.1.1.1", None, "80.0", "443", "6", "x", "9")],
                               "src_ip string, dst_ip string, src_port string, dst_port string, protocol string, "
                               "flow_byts_s string, tot_fwd_pkts string")
    r = readers.exporter_features(df).first()
    assert (r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.protocol, r.flow_byts_s, r.tot_fwd_pkts) == (
        "1.1.1.1", "", 80, 443, 6, 0.0, 9.0)


def test_sidecar_scaler_order_wins(spark, tmp_path):
    path = str(tmp_path / "sidecar")
    readers.write_sidecar(spark, path, ["b", "a"], "random_forest", "1.0", ["BENIGN", "Web � X"], {"a": [0, 1], "b": [0, 1]})
    meta = readers.read_sidecar(spark, path)
    assert meta["feature_names"] == ["a", "b"] and meta["classes"] == ["BENIGN", "Web / X"]
    assert readers.read_json(spark, str(tmp_path / "nothing")) == {}


def test_conform_purge_and_labelled_schema(spark, tmp_path):
    df = conform(spark.createDataFrame([("7", 1)], "id string, prediction int"), DETECTIONS)
    row = df.first()
    assert (row.id, row.severity, row.is_whitelisted) == (7, "", False) and df.columns == DETECTIONS.fieldNames()
    path = str(tmp_path / "purged")
    df.write.parquet(path)
    sinks.purge(spark, path, DETECTIONS)
    assert spark.read.parquet(path).count() == 0
    assert len(LABELLED_FLOWS) == 71


def frame(src, dst, sport, dport, payload, flags=2, proto=6, vlan=False):
    head = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, flags, 512, 0, 0) if proto == 6 else struct.pack(
        ">HHHH", sport, dport, 8 + len(payload), 0)
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(head) + len(payload), 0, 0, 64, proto, 0,
                     socket.inet_aton(src), socket.inet_aton(dst))
    tag = b"\x81\x00\x00\x05" if vlan else b""
    return b"\0" * 12 + tag + b"\x08\x00" + ip + head + payload


def classic(frames, order="<", ticks=10**6):
    magic = {("<", 10**6): b"\xd4\xc3\xb2\xa1", (">", 10**9): b"\xa1\xb2\x3c\x4d"}[order, ticks]
    out = magic + struct.pack(order + "HHIIII", 2, 4, 0, 0, 65535, 1)
    for t, f in frames:
        out += struct.pack(order + "IIII", int(t), round(t % 1 * ticks), len(f), len(f)) + f
    return out


def blocks(frames):
    def block(kind, body):
        size = 12 + len(body) + (-len(body)) % 4
        return struct.pack("<II", kind, size) + body + b"\0" * ((-len(body)) % 4) + struct.pack("<I", size)
    out = block(0x0A0D0D0A, b"\x4d\x3c\x2b\x1a" + struct.pack("<HHq", 1, 0, -1))
    out += block(1, struct.pack("<HHI", 1, 0, 65535) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0))
    for t, f in frames:
        ns = round(t * 10**9)
        out += block(6, struct.pack("<IIIII", 0, ns >> 32, ns & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


def test_many_captures_become_flows(spark, tmp_path):
    talk = [(100.0, frame("1.1.1.1", "2.2.2.2", 5, 80, b"hello")), (100.5, frame("2.2.2.2", "1.1.1.1", 80, 5, b"", 18)),
            (100.75, frame("1.1.1.1", "2.2.2.2", 5, 80, b"abc", vlan=True)), (101.0, b"\0" * 20)]
    (tmp_path / "a.pcap").write_bytes(classic(talk))
    (tmp_path / "b.pcap").write_bytes(classic([(7.25, frame("3.3.3.3", "4.4.4.4", 9, 53, b"q", proto=17))], ">", 10**9))
    (tmp_path / "c.pcapng").write_bytes(blocks([(8.5, frame("5.5.5.5", "6.6.6.6", 1, 2, b"zz"))]))
    (tmp_path / "empty.pcap").write_bytes(b"")
    (tmp_path / "cut.pcap").write_bytes(classic(talk)[:60])
    rows = pcap.read_packets(spark, str(tmp_path))
    assert rows.filter("src_ip IN ('1.1.1.1', '2.2.2.2')").count() >= 3
    whole = rows.filter("file NOT LIKE '%cut.pcap'")
    got = packets.flows(whole, order=["file", "packet_no"]).orderBy("flow_start").collect()
    assert [(r.src_ip, r.dst_port, r.protocol, r["Total Fwd Packets"], r["Total Length of Fwd Packets"])
            for r in got] == [("3.3.3.3", 53, 17, 1.0, 1.0), ("5.5.5.5", 2, 6, 1.0, 2.0), ("1.1.1.1", 80, 6, 2.0, 8.0)]
    assert got[2]["Flow Duration"] == 750_000.0 and got[2]["Total Backward Packets"] == 1.0
    assert [r.ts_us for r in whole.orderBy("ts_us").limit(2).collect()] == [7_250_000, 8_500_000]


def labelled(spark, n=600):
    return spark.range(n).selectExpr(
        "CAST(id % 50 AS DOUBLE) AS `Flow Duration`", "CAST(id AS DOUBLE) AS `Flow Bytes/s`",
        "CAST(id % 7 AS DOUBLE) AS `Fwd Header Length.1`", "4D AS Fixed",
        "CASE WHEN id % 50 > 40 THEN 'DDoS' WHEN id % 50 > 25 THEN 'PortScan' ELSE 'BENIGN' END AS Label")


def test_boosting_under_one_softmax(spark, tmp_path):
    """Better held-out log loss than one binary model per class with as many rounds; same answers after a round trip."""
    import numpy as np
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.feature import VectorAssembler
    from flowtide.plans import boosting
    from flowtide.plans.models import ml_scorer
    df = spark.range(1500).selectExpr(
        "CAST(xxhash64(id, 1) % 100 AS DOUBLE) AS x0", "CAST(xxhash64(id, 2) % 100 AS DOUBLE) AS x1", "CAST(id AS DOUBLE) AS x2", "id",
        "abs(xxhash64(id, 3)) % 10 AS noise").selectExpr(
        "*", "CAST(CASE WHEN noise = 0 THEN id % 3 WHEN x0 > 20 THEN 0 WHEN x1 > x0 THEN 1 ELSE 2 END AS DOUBLE) AS y")
    train, test = df.filter("id % 4 <> 0"), df.filter("id % 4 = 0")
    model = training.train_boosted(train, ["x0", "x1", "x2"], rounds=10, depth=3, rate=0.3)
    rest = OneVsRest(classifier=GBTClassifier(maxIter=10, maxDepth=3, stepSize=0.3, seed=1), labelCol="y", featuresCol="features")
    into = VectorAssembler(inputCols=["x0", "x1", "x2"], outputCol="features")
    other = ml_scorer(rest.fit(into.transform(train)))(into.transform(test))
    loss = lambda scored: scored.agg(F.avg(-F.log(F.greatest(F.get("probability", F.col("y").cast("int")), F.lit(1e-9))))).first()[0]
    assert loss(model.score(test)) < loss(other)
    model.save(spark, str(tmp_path / "boosted"))
    again = boosting.BoostedTrees.load(spark, str(tmp_path / "boosted"))
    rows = np.array([[r.x0, r.x1, r.x2] for r in test.collect()])
    assert np.array_equal(again.predict(rows), model.predict(rows)) and np.allclose(model.predict(rows).sum(axis=1), 1)
    assert len(model.rounds) == 10 and len(model.rounds[0]) == 3


def test_boosting_by_hand(spark):
    """One round, one cut: the tree of a class cuts where its members end, and leaves hold -rate * G / (H + 1)."""
    from flowtide.plans import boosting
    df = spark.range(40).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(id >= 30 AS DOUBLE) AS y")
    model = boosting.train(df.repartition(3), ["a"], 2, rounds=1, depth=1, rate=0.5)
    tree = model.rounds[0][1]
    assert model.cuts[0][tree.cut[0]] == pytest.approx(29, abs=1) and tree.feature[0] == 0
    low, high = (df.filter(f"a <= {model.cuts[0][tree.cut[0]]}"), df.filter(f"a > {model.cuts[0][tree.cut[0]]}"))
    for node, side in ((1, low), (2, high)):
        n, hits = side.count(), side.filter("y = 1").count()
        assert tree.value[node] == pytest.approx(-0.5 * (0.5 * n - hits) / (0.5 * n + 1))


def test_train_save_load_evaluate(spark, tmp_path):
    df = labelled(spark)
    out = str(tmp_path / "models")
    p, models, matrices = training.train_and_compare(df.union(df), out, trees=5, rounds=2, forest_depth=5, boost_depth=3)
    assert p.classes == ["BENIGN", "DDoS", "PortScan"] and "Fixed" not in p.features
    assert p.train.count() + p.test.count() == 600 and p.test.count() == 120
    assert matrices.groupBy("model").agg(F.sum("n").alias("n")).filter("n <> 120").count() == 0
    stored = readers.read_json(spark, f"{out}/evaluation")
    assert stored["random_forest"]["accuracy"] > 0.9 and len(stored["boosted"]["confusion_matrix"]) == 3
    again = training.load_model(spark, f"{out}/random_forest", "forest", 3)
    assert again.features == p.features and again.classes == p.classes
    binary = df.withColumn("Label", F.when(F.col("Label") == "BENIGN", 0).otherwise(2))
    row = training.evaluate_registered(again, binary).first()
    assert row["accuracy"] > 0.9 and 0.9 < row["roc_auc"] <= 1.0 and row["tn"] + row["fp"] + row["fn"] + row["tp"] == 600
    with pytest.raises(ValueError):
        training.evaluate_registered(again, df.drop("Label"))
    shares = models["boosted"].score(p.test).select(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)).collect()
    assert all(abs(r[0] - 1) < 1e-9 for r in shares)


def test_scaler_is_population_based(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    s = training.fit_scaler(df, ["a", "b"])
    assert s["a"][1] == pytest.approx(1.2472, abs=1e-4) and s["b"] == (5.0, 1.0)


def test_macro_windows_are_reproducible_and_distinct(spark):
    pool = labelled(spark).withColumn("rid", col("Flow Bytes/s"))
    features = ["Flow Duration", "Flow Bytes/s"]
    a, b = (training.macro_windows(x, features, ["rid"], per_class=40) for x in (pool, pool.repartition(3)))
    assert a.count() == 120
    assert a.exceptAll(b).count() == 0
    sizes = a.groupBy("Label").agg(F.max("member_count").alias("hi"), F.count_if(F.col("member_count") == 1).alias("ones"))
    got = {r.Label: (r.hi, r.ones) for r in sizes.collect()}
    assert got["BENIGN"][0] <= 12 and got["BENIGN"][1] >= 25 and 30 < got["DDoS"][0] <= 60


def test_scratch_is_cleared(spark):
    from flowtide.session import clear_scratch, durable
    stored = durable(spark.range(5).toDF("id"), "probe")
    assert stored.count() == 5
    assert clear_scratch(spark) and not clear_scratch(spark)


def test_boosting_makes_one_pass_a_level_and_reports_score_once(spark, monkeypatch):
    from flowtide.plans import boosting, training
    passes, sums = [], boosting._sums
    monkeypatch.setattr(boosting, "_sums", lambda *args: passes.append(args[3]) or sums(*args))
    df = spark.range(400).selectExpr("CAST(id % 20 AS DOUBLE) AS a", "CAST(id AS DOUBLE) AS b", "IF(id % 20 > 9, 'DDoS', 'BENIGN') AS Label")
    _, _, matrices = training.train_and_compare(df, trees=2, rounds=2, forest_depth=2, boost_depth=2)
    # The leaves below the second cuts come from the sums of the nodes above.
    assert passes and max(passes) == 1
    # Reports read stored cells, not the rows that were scored.
    assert all("/matrices-" in f for f in matrices.inputFiles())
    assert sum(r.n for r in matrices.filter("model = 'boosted'").collect()) == 80


@pytest.mark.parametrize("subsample", [1.0, 0.7])
def test_boosting_with_stored_margins(spark, subsample):
    from flowtide.plans import boosting
    df = spark.range(300).selectExpr("CAST(id % 30 AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b", "CAST(id % 30 > 14 AS INT) + CAST(id % 30 > 22 AS INT) AS y")
    model = boosting.train(df, ["a", "b"], 3, rounds=boosting.STORED_ROUNDS + 2, depth=2, rate=0.3, subsample=subsample)
    assert len(model.rounds) == boosting.STORED_ROUNDS + 2
    scored = model.score(df.selectExpr("a AS x0", "b AS x1", "y")).collect()
    assert all(len(r.probability) == 3 and abs(sum(r.probability) - 1) < 1e-9 and max(range(3), key=lambda k: r.probability[k]) == r.y for r in scored)


def test_first_lines_of_many_files_sort_no_lines(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    for i in range(40):
        (tmp_path / f"f {i}.csv").write_text(f"h{i},Label\n" + "".join(f"{n},x\n" for n in range(i * 50)))
    plans, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    got = readers._first_lines(spark, [str(tmp_path / f"f {i}.csv") for i in range(40)])
    assert sorted(got.values()) == sorted(f"h{i},Label" for i in range(40)) and len(got) == 40
    assert plans and not any("Sort" in p for p in plans)


def test_compared_models_have_their_full_size(spark, tmp_path, monkeypatch):
    """The registered comparison asks for 150 trees of any depth and 150 rounds of depth 6, and reports on all held-out rows."""
    from flowtide.catalog import training as queries
    asked, forest, boosted = [], training.train_forest, training.train_boosted
    monkeypatch.setattr(training, "train_forest", lambda df, features, trees=150, depth=training.MAX_TREE_DEPTH, *rest, **more: (
        asked.append((trees, depth)) or forest(df, features, 3, 4, *rest, **more)))
    monkeypatch.setattr(training, "train_boosted", lambda df, features, rounds=150, depth=6, *rest, **more: (
        asked.append((rounds, depth)) or boosted(df, features, 3, 2, *rest, **more)))
    spark.range(400).selectExpr("id AS l_orderkey", "CAST(id % 7 AS INT) AS l_linenumber", "id % 9 AS l_suppkey", "id % 11 AS l_partkey",
                                "'A' AS l_returnflag", "'O' AS l_linestatus", "CAST(1 + id % 50 AS DOUBLE) AS l_quantity",
                                "CAST(1000 + id AS DOUBLE) AS l_extendedprice", "(id % 11) / 100D AS l_discount",
                                "(id % 9) / 100D AS l_tax").write.parquet(str(tmp_path / "lineitem.parquet"))
    report = queries.compare(spark, str(tmp_path)).collect()
    assert asked == [(150, 30), (150, 6)]
    assert {m: sum(r.support for r in report if r.model == m) for m in ("random_forest", "boosted")} == {"random_forest": 80, "boosted": 80}


@pytest.mark.parametrize("subsample", [1.0, 0.7])
def test_boosting_in_one_task_grows_the_trees_of_the_passes(spark, monkeypatch, subsample):
    """Few rows go to one task, which makes no job for a level; above the limit, replaced margins are removed."""
    import numpy as np
    from flowtide.plans import boosting
    jobs, sums, removed, remove = [], boosting._sums, [], boosting.remove_folder
    monkeypatch.setattr(boosting, "_sums", lambda *args: jobs.append(len(args[0].rounds)) or sums(*args))
    monkeypatch.setattr(boosting, "remove_folder", lambda *args: removed.append(remove(*args)) or removed[-1])
    df = spark.range(600).selectExpr("CAST(xxhash64(id, 1) % 50 AS DOUBLE) AS a", "CAST(xxhash64(id, 2) % 9 AS DOUBLE) AS b", "id").selectExpr(
        "a", "b", "CAST(IF(id % 11 = 0, id % 3, IF(a > 10, 2, IF(b > a, 1, 0))) AS INT) AS y")
    rounds, models = 2 * boosting.STORED_ROUNDS + 1, []
    for cells in (0, boosting.ONE_TASK_CELLS):
        jobs.clear()
        monkeypatch.setattr(boosting, "ONE_TASK_CELLS", cells)
        models.append(boosting.train(df.repartition(3), ["a", "b"], 3, rounds, 3, 0.3, subsample=subsample))
        assert max(jobs) == (boosting.STORED_ROUNDS - 1 if cells else rounds - 1)
    assert removed == [True, True]
    assert [len(m.rounds) for m in models] == [rounds, rounds]
    for one, other in zip(*(sum(m.rounds, []) for m in models), strict=True):
        assert np.array_equal(one.feature, other.feature) and np.array_equal(one.cut, other.cut) and np.allclose(one.value, other.value)


def test_deep_forest_is_the_same_with_kept_nodes(spark, monkeypatch):
    df = spark.range(500).selectExpr("CAST(xxhash64(id, 1) % 50 AS DOUBLE) AS a", "CAST(xxhash64(id, 2) % 9 AS DOUBLE) AS b",
                                     "CAST(id % 7 > 3 AS DOUBLE) AS y").repartition(1)
    kept = training.train_forest(df, ["a", "b"], trees=3, depth=12).stages[-1]
    monkeypatch.setattr(training, "SHALLOW", 12)
    walked = training.train_forest(df, ["a", "b"], trees=3, depth=12).stages[-1]
    assert kept.getCacheNodeIds() and not walked.getCacheNodeIds()
    assert kept.toDebugString.split("\n", 1)[1] == walked.toDebugString.split("\n", 1)[1]
