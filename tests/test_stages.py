import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lumirank.operators import rank as RK, ranking_metrics as R, retrieve as RT, sampling as SA
from lumirank.operators.ordering import top_k
from lumirank.plans import jobs as J
from lumirank.sources import clicklog as CL, relations as RL, tabular as TB, tfrecord as TF
from lumirank.sources.synthetic import synthetic_splits

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(11)
    items = np.round(rng.normal(size=(90, 6)), 1)
    items[40:50] = items[10:20]                                  # copies: equal scores
    users = np.round(rng.normal(size=(37, 6)), 1)
    mk = lambda a, k: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(a)], f"{k} long, embedding array<float>")
    return users, items, mk(users, "request_id"), mk(items, "item_id")


def small_blocks(monkeypatch):
    monkeypatch.setattr(RT, "USER_BLOCK", 10)
    monkeypatch.setattr(RT, "ITEM_BLOCK", 16)
    monkeypatch.setattr(RT, "CELL_SCORES", 60)
    monkeypatch.setattr(RT, "NEIGHBOURS", 9)


def scores(users, items):
    return np.round(users.astype(np.float32).astype(float) @ items.astype(np.float32).astype(float).T, 9)


@pytest.mark.parametrize("k", [1, 5, 90, 200])
def test_blocked_top_k_equals_brute_force(vecs, monkeypatch, k):
    small_blocks(monkeypatch)
    users, items, u, i = vecs
    s = scores(users, items)
    want = [(r, int(c), n + 1) for r in range(len(users)) for n, c in enumerate(sorted(range(90), key=lambda c: (-s[r, c], c))[:k])]
    assert rows(RT.exact_top_k(u, i, k), "request_id", "item_id", "rank") == sorted(want)


def test_all_items_metrics_equal_candidate_metrics(spark, vecs, monkeypatch):
    small_blocks(monkeypatch)
    users, items, u, i = vecs
    s = scores(users, items)
    pos = [(r, (r * 5 + d) % 90) for r in range(30) for d in (0, 3, 40)[: r % 4]]
    p = spark.createDataFrame(pos, "request_id long, item_id long")
    full = spark.createDataFrame([(r, c, float(s[r, c]), float((r, c) in set(pos))) for r in range(37) for c in range(90)],
                                 "request_id long, item_id long, score double, label double")
    a = RT.all_items_per_request(u, p, i, [5, 20], hot_rows=2)
    b = R.per_request(full, [5, 20])
    key = lambda d: [tuple(np.round(r, 9)) for r in rows(d, *b.columns)]
    assert key(a) == key(b)


def test_blocks_out_of_reach_are_not_visited(spark, monkeypatch):
    """Items in clusters: each user meets few of the blocks, and the results are still those of all items."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8)) * 10
    items = np.concatenate([c + rng.normal(size=(30, 8)) * 0.1 for c in centres]).astype(np.float32)
    users = (centres[rng.integers(0, 20, 50)] / 10).astype(np.float32)
    mk = lambda a, k: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(a)], f"{k} long, embedding array<float>")
    monkeypatch.setattr(RT, "NEIGHBOURS", 15)
    visits, route = [], RT._route
    monkeypatch.setattr(RT, "_route", lambda *a: visits.append(route(*a)) or visits[-1])
    s = np.round(users.astype(float) @ items.astype(float).T, 9)
    want = [(r, c) for r in range(50) for c in sorted(range(600), key=lambda c: (-s[r, c], c))[:5]]
    assert rows(RT.exact_top_k(mk(users, "request_id"), mk(items, "item_id"), 5), "request_id", "item_id") == sorted(want)
    assert sum(v.count() for v in visits) < 0.3 * 50 * 40              # 40 blocks
    p = spark.createDataFrame([(r, want[r * 5 + 2][1]) for r in range(50)], "request_id long, item_id long")
    got = RT.positive_places(mk(users, "request_id"), p, mk(items, "item_id"))
    places = {(r.request_id, r.item_id): (r.higher, r.tied, r.tied_before) for r in got.collect()}
    assert places == {(r, c): (int((s[r] > s[r, c]).sum()), int((s[r] == s[r, c]).sum()) - 1, int((s[r, :c] == s[r, c]).sum())) for r, c in [(r, want[r * 5 + 2][1]) for r in range(50)]}
    assert visits[-1].count() < 0.3 * 50 * 40
    none = spark.createDataFrame([], "item_id long, embedding array<float>")
    assert RT.exact_top_k(mk(users, "request_id"), none, 5).isEmpty() and RT.positive_places(mk(users, "request_id"), p, none).isEmpty()


def test_row_cap_example(spark):
    """Five items, three requests: top 2 and Recall@1 as stated."""
    u = spark.createDataFrame([(r, [1.0]) for r in range(3)], "request_id long, embedding array<float>")
    i = spark.createDataFrame([(x, [float(x)]) for x in range(1, 6)], "item_id long, embedding array<float>")
    top = RT.exact_top_k(u, i, 2)
    assert {tuple(r.item_id for r in top.filter(F.col("request_id") == q).orderBy("rank").collect()) for q in range(3)} == {(5, 4)}
    p = spark.createDataFrame([(r, 5) for r in range(3)], "request_id long, item_id long")
    assert R.averages(RT.all_items_per_request(u, p, i, [1]), [1]).first().recall_1 == 1.0


def test_assembly_keeps_positives_and_fills(spark):
    scored = spark.createDataFrame([(1, i, 1.0 - i / 10, i) for i in range(1, 6)], "request_id long, item_id long, score double, rank long")
    pos = spark.createDataFrame([(1, 2), (1, 99)], "request_id long, item_id long")
    assert rows(RT.assemble_candidates(scored, pos, 4)) == [(1, 1, 0.9, 0), (1, 2, 0.8, 1), (1, 3, 0.7, 0), (1, 99, 0.0, 1)]
    assert rows(RT.assemble_candidates(scored, pos, 1), "item_id", "label") == [(2, 1), (99, 1)]
    assert rows(RT.assemble_candidates(scored, pos, 2, inject_positives=False), "item_id", "label") == [(1, 0), (2, 1)]


def test_uniform_negatives(spark):
    d = spark.range(300).select(F.col("id").alias("row"), (F.col("id") % 20).alias("item_id"))
    n = SA.uniform(d, d, 5, "row")
    assert rows(n) == rows(SA.uniform(d, d, 5, "row"))
    assert n.filter("neg_item = item_id").isEmpty() and n.filter("neg_item > 19").isEmpty()
    assert n.groupBy("row").count().filter("count <> 5").isEmpty()
    two = SA.uniform(d.filter("item_id < 2"), d.filter("item_id < 2").select("item_id"), 6, "row", hash_of=lambda r, j: F.when(j == 5, 1 - r % 20).otherwise(r % 20))
    assert two.groupBy("row").count().filter("count <> 6").isEmpty()      # one valid draw fills all places
    lone = SA.uniform(d.filter("item_id = 3"), d.filter("item_id = 3"), 2, "row")
    assert lone.count() == 0                                     # never padded with the own positive


def test_weighted_negatives_follow_counts(spark):
    pool = spark.createDataFrame([(i,) for i in range(50)], "item_id long")
    pop = spark.createDataFrame([(0, 1000)], "item_id long, popularity long")      # the rest weigh 1
    d = spark.range(2000).select(F.col("id").alias("row"), F.lit(-1).cast("long").alias("item_id"))
    n = SA.weighted(d, pool, pop, 1, "row", alpha=1.0)
    share = n.filter("neg_item = 0").count() / n.count()
    assert abs(share - 1000 / 1049) < 0.02
    assert SA.weighted(d, pool, pop, 1, "row", alpha=0.0).groupBy("neg_item").count().count() == 50


def test_hard_negatives_fall_back_and_repeat(spark):
    c = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "request_id long, item_id long")
    r = spark.createDataFrame([(1, 1, 10), (2, 2, 20), (3, 9, 5)], "row long, request_id long, item_id long")
    pool = spark.createDataFrame([(i,) for i in range(100, 140)], "item_id long")
    got = SA.hard(r, c, pool, 3, "row")
    by = {k: [x.neg_item for x in got.filter(F.col("row") == k).collect()] for k in (1, 2, 3)}
    assert by[1] == [11, 11, 11]                                 # only one other candidate
    assert all(100 <= x < 140 for x in by[2] + by[3]) and len(by[2]) == len(by[3]) == 3


def test_in_batch_never_self(spark):
    d = spark.range(103).select(F.col("id").alias("row"), (F.col("id") * 3).alias("item_id"))
    n = SA.in_batch(d, ["row"], "row", 10, 4)
    assert n.filter("row = neg_row").isEmpty() and n.count() == 412
    assert n.filter("floor(row / 10) <> floor(neg_row / 10)").isEmpty()


def test_candidates_dropped_are_counted(spark):
    c = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (1, 3, 0.0)], "request_id long, item_id long, label double")
    pool = spark.createDataFrame([("1",)], "item_id string")
    assert tuple(RK.dropped_candidates(c, pool).first()) == (1, 2, 1)
    assert rows(RK.valid_candidates(c, pool), "item_id") == [(1,)]


def test_routing_and_scenes(spark):
    d = spark.createDataFrame([("a", 0.1, 0.9), ("q", 0.2, 0.8)], "v string, x double, y double")
    assert rows(d.select(RK.scene_score(F.col("v"), {"a": 2}, F.array("x", "y"), default=1, shift=1))) == [(0.2,), (0.9,)]
    assert rows(d.select(RK.route_scores("device", F.lit(True), F.col("x"), F.col("y")))) == [(0.8,), (0.9,)]
    with pytest.raises(ValueError):
        RK.route_scores("edge", F.lit(True), F.col("x"), F.col("y"))
    assert RK.group_flag(d, "nope") is None


def test_stage_relation_round_trip(spark, tmp_path):
    c = spark.createDataFrame([(1, 2, 0.25, 1)], "request_id long, item_id long, score double, label int")
    RL.StageRelation("retrieval", c, c.select("request_id"), {"Recall@1": 0.5}, {"lazy": True}).save(RL.stage_path(str(tmp_path), "retrieval", "valid"))
    got = RL.load_stages(spark, str(tmp_path), "retrieval", test=False)["valid"]
    assert got.metrics == {"Recall@1": 0.5} and got.metadata == {"lazy": True}
    assert [f.dataType.simpleString() for f in got.candidates.schema] == ["bigint", "bigint", "float", "tinyint"]
    with pytest.raises(ValueError, match="pickle"):
        RL.StageRelation.load(spark, str(tmp_path / "x.pkl"))
    with pytest.raises(ValueError):
        RL.stage_path(str(tmp_path), "../up", "valid")


def test_pool_cache_is_rebuilt_on_change(spark, tmp_path):
    src = f"{tmp_path}/train.parquet"
    mk = lambda n: spark.createDataFrame([(i, f"b{i}") for i in range(n)], "item_id long, b string")
    mk(3).write.parquet(src)
    pool = lambda: J.item_pools(spark, {"train": src}, str(tmp_path), "item_id", ["b"], kinds=["train"])["train"]
    assert pool().count() == 3
    before = RL.read_json(spark, f"{tmp_path}/item_pool_train.parquet.fingerprint.json")["key"]
    assert pool().count() == 3
    mk(5).write.mode("overwrite").parquet(src)
    assert pool().count() == 5
    assert RL.read_json(spark, f"{tmp_path}/item_pool_train.parquet.fingerprint.json")["key"] != before


def test_a_rebuild_that_dies_leaves_the_old_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    RL.cached_table(spark, path, "k", lambda: spark.range(10))
    broken = lambda: spark.range(10).selectExpr("id", "CASE WHEN id = 7 THEN raise_error('stop') ELSE id END AS more")
    with pytest.raises(Exception, match="stop"):
        RL.cached_table(spark, path, "k", broken, ["id", "more"])
    assert RL.cached_table(spark, path, "k", lambda: None, ["id"]).count() == 10
    assert RL.cached_table(spark, path, "k2", lambda: spark.range(4)).count() == 4


def test_statistics_cache_policies(spark, tmp_path):
    p, calls = f"{tmp_path}/s.json", []
    build = lambda: calls.append(1) or {"rows": 3}
    with pytest.raises(FileNotFoundError):
        RL.statistics_cache(spark, p, "k", "strict", build, ["rows"])
    RL.statistics_cache(spark, p, "k", "prefer", build, ["rows"])
    RL.statistics_cache(spark, p, "k", "prefer", build, ["rows"])
    assert len(calls) == 1
    RL.statistics_cache(spark, p, "k", "refresh", build, ["rows"])
    RL.statistics_cache(spark, p, "other", "prefer", build, ["rows"])
    RL.statistics_cache(spark, p, "other", "prefer", build, ["rows", "more"])
    assert len(calls) == 4


def test_tfrecord_round_trip(spark, tmp_path):
    p = f"{tmp_path}/t"
    d = spark.createDataFrame([(i, i / 4, f"s{i}é", [i, -i], b"\x00\x01") for i in range(50)], "a long, f float, s string, q array<long>, b binary").repartition(3)
    TF.write_tfrecord(d, p, {"q": 3})
    got = TF.read_tfrecord(spark, p, "a long, f float, s string, q array<long>, b binary, missing long", verify=True, defaults={"missing": -1})
    assert sorted((r.a, r.f, r.s, tuple(r.q), bytes(r.b), r.missing) for r in got.collect()) == [
        (i, i / 4, f"s{i}é", (i, -i, 0), b"\x00\x01", -1) for i in range(50)]
    TF.write_tfrecord(d.filter("a < 5"), p, compression="none")
    assert TF.read_tfrecord(spark, p, "a long").count() == 5
    with pytest.raises(FileNotFoundError):
        TF.list_files(f"{tmp_path}/none")
    with pytest.raises(Exception, match="missing"):
        TF.write_tfrecord(spark.createDataFrame([(None,)], "a long"), f"{tmp_path}/u")


def test_tfrecord_checksum():
    # published check values of CRC-32C
    unmask = lambda m: ((((m - 0xA282EAD8) & 0xFFFFFFFF) << 15) | (((m - 0xA282EAD8) & 0xFFFFFFFF) >> 17)) & 0xFFFFFFFF
    parts = [b"123456789", b"", bytes(32), b"\xff" * 32]
    size = np.array([len(x) for x in parts])
    got = [unmask(int(m)) for m in TF.masked_crcs(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size)]
    assert got == [0xE3069283, 0x00000000, 0x8A9136AA, 0x62A8AB43]


def test_tfrecord_damage_is_found(spark, tmp_path):
    p = f"{tmp_path}/t"
    TF.write_tfrecord(spark.range(5).coalesce(1), p, compression="none")
    f = TF.list_files(p)[0]
    raw = bytearray(open(f, "rb").read())
    raw[14] ^= 1
    open(f, "wb").write(raw)
    with pytest.raises(Exception, match="checksum"):
        TF.read_tfrecord(spark, p, "id long", verify=True).collect()
    open(f, "wb").write(raw[:-3])
    with pytest.raises(Exception, match="cut inside"):
        TF.read_tfrecord(spark, p, "id long").collect()


def test_click_log(spark, tmp_path):
    a, b, c = CL.BETWEEN, CL.AFTER_FIELD, CL.AFTER_ID
    t = lambda f, i, v="1.0": f"{f}{b}{i}{c}{v}"
    (tmp_path / "sk").write_text("\n".join([
        ",".join(["s1", "1", "0", "k", "3", a.join([t("101", 5), t("101", 6), t("508", 7, "2.5")])]),
        ",".join(["s2", "0", "1", "k", "1", t("101", 5)]),
        ",".join(["s3", "0", "0", "k", "1", a.join(t("205", i) for i in range(40))])]) + "\n")
    (tmp_path / "co").write_text(",".join(["k", "1", t("101", 9)]) + "\n")
    sk, co = CL.read_skeleton(spark, str(tmp_path / "sk")), CL.read_bundles(spark, str(tmp_path / "co"))
    got = {r["sample"]: r for r in CL.convert(sk, co, ["101", "205"], ["508"]).collect()}
    assert set(got) == {"s1", "s3"}                              # a purchase without a click is dropped
    assert got["s1"]["101"] == "9" and got["s1"]["D508"] == "2.5" and got["s1"]["205"] == "0"
    assert len(got["s3"]["205"].split("^")) == 40
    capped = {r["sample"]: r for r in CL.convert(sk, co, ["101", "205"], ["508"], max_values=31).collect()}
    assert capped["s3"]["205"].split("^") == [str(i) for i in range(31)]
    with pytest.raises(Exception, match="no feature bundle"):
        CL.convert(sk, co.filter("bundle = 'z'"), ["101"], []).collect()


def test_csv_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,z\n1,a,2.5\n2,b,3.5\n")
    got = TB.read_csv(spark, str(tmp_path / "a.csv"), "z double, x long")
    assert rows(got) == [(2.5, 1), (3.5, 2)] and got.dtypes == [("z", "double"), ("x", "bigint")]
    with pytest.raises(ValueError):
        TB.read_csv(spark, str(tmp_path / "a.csv"), "q long")


def test_split_sink_counts_rows(spark, tmp_path):
    assert TB.write_split(spark.range(7), f"{tmp_path}/s", expected=7) == 7
    with pytest.raises(RuntimeError, match="8 were expected"):
        TB.write_split(spark.range(7), f"{tmp_path}/s", expected=8)
    with pytest.raises(ValueError):
        TB.read_split(spark, str(tmp_path), "s", "npz")


def test_synthetic(spark):
    s = synthetic_splits(spark)
    assert {k: d.count() for k, d in s.items()} == {"train": 96, "valid": 24, "test": 24}
    assert s["train"].filter("label = 1").count() == 24 and s["test"].filter("label <> 1").isEmpty()
    hit = s["train"].filter("label = 1").filter(~F.array_contains(F.split("clicked_item_seq", ","), F.col("cand_item_id").cast("string")))
    assert hit.isEmpty()


def test_three_stage_funnel(spark):
    n = 24
    v = spark.range(n).select(F.col("id"), F.array(*[F.sin(F.col("id") * (j + 1)) for j in range(4)]).cast("array<float>").alias("embedding"))
    req = v.filter("id < 12").withColumnRenamed("id", "request_id")
    pos = req.select("request_id", ((F.col("request_id") * 5) % n).alias("item_id"))
    items = v.withColumnRenamed("id", "item_id").withColumn("kind", F.col("item_id") % 3)
    out = J.three_stages(req, pos, items, F.col("score") + F.col("kind"), F.col("score") - F.col("kind"), ["kind"], (8, 5, 3), [1, 3],
                         popularity=items.select("item_id", (F.col("item_id") % 7).alias("popularity")))
    size = lambda d: {r["count"] for r in d.groupBy("request_id").count().collect()}
    assert size(out["retrieved"]) == {8} and size(out["preranked"]) == {5} and size(out["reranked"]) == {3}
    assert out["retrieved"].filter("label = 1").count() == 12
    long = {(r.stage, r.metric): r.value for r in out["metrics"].collect()}
    assert {stage for stage, _ in long} == {"retrieval", "preranking", "reranking"}
    assert 0 <= long["retrieval", "hit_rate_1"] <= long["retrieval", "hit_rate_3"] <= 1 and ("retrieval", "popularity_recall_3") in long


def test_top_k_with_fewer_rows(spark):
    d = spark.createDataFrame([(1, 1, 0.5)], "request_id long, item_id long, score double")
    assert top_k(d, ["request_id"], [F.desc("score")], 10).count() == 1


@pytest.mark.parametrize("kind", ["linear_scorer", "fm_scorer"])
def test_scorers_learn_and_an_unregularised_fit_keeps_the_label_rate(spark, kind):
    from lumirank.operators import classification as C, models as M
    d = spark.range(2000).selectExpr("id AS request_id", "id AS item_id", "concat('b', id % 7) AS brand", "concat('t', id % 300) AS kind",
                                     "cast(id % 11 AS double) AS x", "cast(((id * 7919) % 100 < CASE WHEN id % 7 < 2 THEN 80 ELSE 15 END) AS double) AS label")
    options = {"reg": 0.0, "max_iter": 50} if kind == "linear_scorer" else {"max_iter": 60}
    out = getattr(M, kind)(d, ["brand", "kind"], ["x"], **options)(d).cache()
    assert C.auc(out).first()["auc"] > 0.75
    if kind == "linear_scorer":
        r = out.selectExpr("avg(score) AS s", "avg(label) AS y").first()
        assert abs(r.s - r.y) < 1e-3


def test_compaction_keeps_ids_past_the_declared_size(spark):
    d = spark.createDataFrame([(1, 7), (2, 5_000), (3, 90_000)], "k long, code long")
    out = J.compact_dataset({"train": d}, ["code"], {"code": 1_000})
    assert rows(out["tables"]["train"], "k", "code") == [(1, 1), (2, 2), (3, 3)]


def test_leakage_table_writes_numbers_in_plain_digits(spark):
    s = spark.createDataFrame([(12_500_000, 900, 900 / 12_500_000)], "checks long, hits long, hit_rate double")
    e = spark.createDataFrame([], "request_id string, sequence_column string, positive_item string")
    got = J.leakage_table({"summary": s, "examples": e, "conditioned_columns": ["label"]})
    assert rows(got.filter("part = 'summary'"), "name", "value") == [("checks", "12500000.0"), ("hit_rate", "7.2e-05"), ("hits", "900.0")]
    small = J.leakage_table({"summary": s.withColumn("hit_rate", F.lit(0.0005)), "examples": e, "conditioned_columns": ["label"]})
    assert rows(small.filter("name = 'hit_rate'"), "value") == [("0.0005",)]


def test_fit_summary_takes_a_small_gain_of_many_rows_for_a_gain(spark):
    from lumirank.operators.classification import auc
    from lumirank.plans import stage_queries as Q
    def weak(d):
        u = F.pmod(F.xxhash64("request_id", "item_id", "line_no"), F.lit(1_000_003)) / 1_000_003.0
        return lambda x: x.withColumn("score", u + F.col("label") * SHIFT)
    found = {}
    for SHIFT in (0.006, -0.1):
        d = Q.V.with_features(spark, SF, Q.V.lines(spark, SF))
        found[SHIFT] = (auc(weak(d)(d)).first()["auc"], Q._fit_summary(spark, SF, weak).first().ranks_better)
    assert 0.5 < found[0.006][0] < 0.505 and found[0.006][1] and not found[-0.1][1]


def test_retrieval_metrics_count_no_places(spark, monkeypatch):
    """No metric reads the positives' scores, so the query gives the same figures without a second visit of all items."""
    from lumirank.plans import catalog, views as V
    sf = "/root/testdata/sf0.001"
    req, items, pos = V.vectors(spark, sf, "request_id"), V.vectors(spark, sf), V.vector_positives(spark, sf)
    top = RT.exact_top_k(req, items, 20)
    whole = {(r.request_id, r.item_id, r.label) for r in RT.retrieve_candidates(req, pos, items, 20, scored=top).collect()}
    assert {(r.request_id, r.item_id, r.label) for r in RT.assemble_candidates(top, pos, 20).collect()} == whole

    def counted(*_, **__):
        raise AssertionError("places are counted")
    monkeypatch.setattr(RT, "positive_places", counted)
    assert catalog.QUERIES["c5_retrieval_metrics"](spark, sf).first()["requests"] == items.count()
