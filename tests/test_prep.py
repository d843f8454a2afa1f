import duckdb
import pytest
from conftest import rows
from pyspark.sql import functions as F, types as T

from lumirank import config, schema as S
from lumirank.functions import numeric as N, text as TX, vectors as VX
from lumirank.operators import audit as AU, filters as FL, pools as PO, remap as RM, scaling as SC, stats as ST, vocab as VO
from lumirank.plans import catalog, jobs as J
from lumirank.sources.synthetic import synthetic_splits


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def ints(*v):
    return F.array(*[F.lit(x) for x in v]).cast("array<int>")


def test_padding_examples(spark):
    assert one(spark, TX.pad(ints(1, 2), 4, 0, "pre")) == [0, 0, 1, 2]
    assert one(spark, TX.pad(ints(3, 4, 5, 6, 7), 4, 0, "pre")) == [4, 5, 6, 7]
    assert one(spark, TX.pad(ints(3, 4, 5, 6, 7), 4, 0, "post")) == [3, 4, 5, 6]
    assert one(spark, TX.pad(ints(1), 3, 9, "post")) == [1, 9, 9]
    assert one(spark, TX.pad(F.lit(None).cast("array<int>"), 2, 0, "pre")) == [0, 0]
    with pytest.raises(ValueError):
        TX.pad(ints(1), 2, 0, "middle")


def test_fixed_width_cleans_nulls(spark):
    c = F.array(F.lit(1.0), F.lit(None).cast("double"), F.lit(float("nan")), F.lit(4.0))
    assert one(spark, TX.fixed_width_ints(c, 5)) == [1, 0, 0, 4, 0]


def test_effective_length(spark):
    f = lambda *t: one(spark, TX.effective_length(F.array(*[F.lit(x) for x in t])))
    assert (f("1", "2", "0", "0"), f("0", "3", "0"), f("0", "0"), f("5", " 0 ")) == (2, 2, 0, 1)


def test_split_is_literal(spark):
    assert one(spark, TX.tokens(F.lit("a^b^^c"), "^")) == ["a", "b", "", "c"]
    assert one(spark, TX.tokens(F.lit("a.b|c"), "|")) == ["a.b", "c"]


def test_parse_sequences(spark):
    assert sorted(one(spark, TX.parse_sequence(F.lit(" [1, 2.0, \"x\"] ")))) == ["1", "2", "x"]
    assert sorted(one(spark, TX.parse_sequence(F.lit("[1; 2 oops")))) == ["2", "[1", "oops"]
    assert sorted(one(spark, TX.parse_sequence(F.lit("3,3;4 5")))) == ["3", "4", "5"]
    assert one(spark, TX.normalize_id(F.lit(5.0))) == "5"


def test_log_square_and_calendar(spark):
    assert one(spark, N.log_square_bucket(F.lit(1.9))) == 1
    assert one(spark, N.log_square_bucket(F.lit(100))) == 21
    assert one(spark, N.coded_weekday(F.lit("14102100"))) == 2      # a Tuesday
    assert one(spark, N.coded_hour(F.lit("14102123"))) == 23
    assert one(spark, N.coded_weekend(F.lit("14102500"))) == 1


def test_k_max_keeps_order(spark):
    assert one(spark, VX.k_max(F.array(*[F.lit(float(x)) for x in (1, 9, 3, 9, 2)]), 3)) == [9.0, 3.0, 9.0]


def test_k_max_places_of_equal_and_missing_values(spark):
    places = lambda *x: one(spark, VX.k_max_places(F.array(*[F.lit(v).cast("float") for v in x]), 3))
    assert places(1, 9, 3, 9, 9, 9) == [2, 4, 5]
    assert places(None, 2, float("nan"), 5, 4) == [3, 4, 5]
    assert places(None, -0.0, 0.0) == [1, 2, 3]
    assert one(spark, VX.k_max(F.array(*[F.lit(v).cast("float") for v in (None, 7, 1, 7)]), 2)) == [7.0, 7.0]


def test_k_max_query_equals_its_sql_on_ties_and_repeated_ids(spark, tmp_path):
    nan = float("nan")
    v = [(1, [5.0, 5.0, 1.0, 5.0, 5.0, 5.0]), (2, [1.0, None, nan, 2.0, 0.0]), (2, [9.0, 9.0, 0.5]), (3, [None, 1.0]), (4, []), (5, None), (None, [2.0, 2.0, 3.0, 2.0, 2.0])]
    spark.createDataFrame([(i, x, 0) for i, x in v], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = dict(con.execute(catalog.SQL["t6_k_max_values"]).fetchall())
    got = dict(catalog.QUERIES["t6_k_max_values"](spark, str(tmp_path)).collect())
    assert got == want and want[1] == "1^2^4^5"


def test_stable_id(spark):
    assert one(spark, N.stable_id(F.lit(""))) == -1
    assert one(spark, N.stable_id(F.lit("x"))) >= 0


def words(spark, *w):
    return spark.createDataFrame([(x,) for x in w], "t string")


def vocab_of(df):
    return {r.token: r.idx for r in df.collect()}


def test_vocabulary_order_and_specials(spark):
    v = VO.build_vocab(VO.token_counts(words(spark, "b", "b", "a", "a", "c", "", "", ""), "t"))
    assert vocab_of(v) == {"a": 1, "b": 2, "c": 3, "__PAD__": 0, "__OOV__": 4}
    assert vocab_of(VO.build_vocab(VO.token_counts(words(spark, "b", "b", "a"), "t"), min_freq=2)) == {"b": 1, "__PAD__": 0, "__OOV__": 2}
    assert vocab_of(VO.build_vocab(VO.token_counts(words(spark, "7", "3", "3"), "t"), remap=False)) == {"7": 7, "3": 3, "__PAD__": 0, "__OOV__": 8}


def test_shared_vocabulary_moves_oov(spark):
    a = VO.build_vocab(VO.token_counts(words(spark, "x", "y", "x"), "t"))
    b = VO.build_vocab(VO.token_counts(words(spark, "y", "z", "z", "w"), "t"))
    assert vocab_of(VO.merge_vocab(a, b)) == {"__PAD__": 0, "x": 1, "y": 2, "z": 3, "w": 4, "__OOV__": 5}
    assert vocab_of(VO.merge_vocab(a, a)) == vocab_of(a)
    p, q = (VO.build_vocab(VO.token_counts(words(spark, *w), "t"), remap=False) for w in (["3", "5"], ["5", "9"]))
    assert vocab_of(VO.merge_vocab(p, q, remap=False)) == {"__PAD__": 0, "3": 3, "5": 5, "9": 9, "__OOV__": 10}


def test_sequence_na_is_padding_but_category_na_is_unknown(spark):
    v = VO.build_vocab(VO.token_counts(words(spark, "a", "b", "a"), "t"))
    d = spark.createDataFrame([(1, "a^^q^b"), (2, ""), (3, None)], "k long, s string")
    got = {r.k: list(r.s) for r in VO.encode_sequence(d, "s", v, 3, "^", "pre").collect()}
    assert got == {1: [0, 3, 2], 2: [0, 0, 0], 3: [0, 0, 0]}
    c = VO.encode_category(words(spark, "", "a", "zz"), "t", v)
    assert rows(c) == [(1,), (3,), (3,)]


def test_encode_then_decode(spark):
    w = words(spark, "p", "q", "r", "p")
    v = VO.build_vocab(VO.token_counts(w, "t"))
    back = VO.decode(VO.encode_category(w, "t", v, "c"), "c", v, "u")
    assert back.filter("t <> u").isEmpty()


def test_dtype_allow_list():
    assert S.resolve_dtype("np.int32") == T.IntegerType()
    assert S.resolve_dtype("uint64") == T.DecimalType(20, 0)
    for bad in ("object", "eval", "int128"):
        with pytest.raises(ValueError):
            S.resolve_dtype(bad)


def test_feature_expansion():
    specs = S.expand_features([{"name": ["a", "b"], "type": "sparse"}, {"name": "s", "type": "seq", "dtype": "int", "max_len": 3},
                               {"name": "d", "type": "dense", "dtype": "float", "feature_group": "drop"}], {"b": "a"})
    assert [s.name for s in specs] == ["a", "b", "s", "d"]
    assert specs[1].share_embedding == "a" and specs[2].dtype == "str" and not specs[3].active


def test_groups(spark, tmp_path):
    g = S.FeatureGroups.assign(["price", "hist_click", "gps_loc", "x"], explicit={"x": "drop"}, fg3_patterns=["gps"], fg2_patterns=["hist", "loc"])
    assert g.assigned == {"price": "FG1", "hist_click": "FG2", "gps_loc": "FG3", "x": "Drop"}
    assert g.cloud() == ["price", "hist_click"] and g.user() == ["hist_click", "gps_loc"] and g.item() == ["price"]
    g.save(spark, str(tmp_path / "g.csv"))
    assert S.FeatureGroups.load(spark, str(tmp_path / "g.csv")).assigned == g.assigned
    with pytest.raises(ValueError):
        S.FeatureGroups.assign(["a"], explicit={"a": "FG9"})


def test_feature_map_round_trip(spark, tmp_path):
    fm = S.FeatureMap("d", ["y"], {"a": {"type": "categorical", "vocab_size": 5, "source": "user"}, "m": {"type": "meta"}, "n": {"type": "numeric", "source": "item"}})
    fm.save(spark, str(tmp_path / "f.json"))
    back = S.FeatureMap.load(spark, str(tmp_path / "f.json"))
    assert back == fm and back.role() == ["a", "n"] and back.role(source="item") == ["n"]
    assert back.select(drop=["n"], override={"a": {"vocab_size": 9}}).features["a"]["vocab_size"] == 9
    assert back.resized({"a": 2}).features["a"]["vocab_size"] == 2


def test_unsafe_shares_and_completeness():
    specs = {"a": {"type": "categorical", "vocab_size": 5}, "b": {"type": "categorical", "vocab_size": 9, "share_embedding": "a"},
             "c": {"type": "categorical", "vocab_size": 3, "share_embedding": "a"}, "d": {"type": "categorical", "vocab_size": 3, "share_embedding": "zz"}}
    out = S.drop_unsafe_shares(specs)
    assert [n for n, s in out.items() if "share_embedding" in s] == ["c"]
    assert S.is_complete(out) and not S.is_complete({"s": {"type": "seq", "vocab_size": 4}})


def test_config(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"seed": 1, "datasets": {"d1": {"label_col": "y", "data_root": "/r"}}}')
    cfg = config.load_config(spark, str(p), "d1")
    assert cfg["seed"] == 1 and config.split_paths(cfg)["valid"] == "/r/valid.csv"
    with pytest.raises(KeyError):
        config.load_config(spark, str(p), "d2")
    with pytest.raises(ValueError):
        config.validate_config(cfg)
    for bad in ("../x", "a/b", "", ".hid", "a..b"):
        with pytest.raises(ValueError):
            config.validate_identifier(bad)
    assert config.negative_config({"num_negatives": 2, "diversity_num_negatives": 5}) == {"num_negatives": 5, "hybrid": False, "full_rows": False}
    assert config.negative_config({"num_negatives": 2, "hybrid": True})["full_rows"]
    assert config.vocab_scan_splits({"train", "train_positive", "test"}) == ("train_positive",)
    with pytest.raises(ValueError):
        config.vocab_scan_splits({"valid", "test"})


def test_missing_columns_are_errors(spark):
    d = spark.range(2).withColumnRenamed("id", "a")
    with pytest.raises(ValueError, match="request_id"):
        S.require_columns(d, ["a", "request_id"])
    with pytest.raises(ValueError):
        S.preprocess(d, [], [], ["impression_id"])
    with pytest.raises(ValueError):
        PO.build_pool([d], "a", ["brand"])


def test_null_item_stops_the_job(spark):
    d = spark.createDataFrame([(1, "x"), (None, "y")], "item_id long, b string")
    with pytest.raises(Exception, match="null item id"):
        PO.build_pool([d], "item_id", ["b"]).collect()


def test_pool_precedence(spark):
    s = {n: spark.createDataFrame(v, "item_id long, b string") for n, v in
         {"train": [(1, "t"), (3, "t")], "valid": [(1, "v"), (2, "v")], "test": [(2, "s"), (4, "s")]}.items()}
    assert rows(PO.pool_for("full", s, "item_id", ["b"])) == [(1, "v"), (2, "v"), (3, "t"), (4, "s")]
    assert rows(PO.negatives_pool(s, "item_id", ["b"], "full"), "item_id") == [(1,), (3,)]
    c = PO.coverage(s["train"], s["test"], "item_id").first()
    assert (c.data_items, c.covered_items, c.missing_items, c.coverage_pct) == (2, 0, 2, 0.0)
    assert PO.coverage(s["train"].limit(0), s["test"], "item_id").first().coverage_pct == 100.0


def test_exact_split_counts(spark):
    d = spark.range(103)
    for mode in ("sequential", "random"):
        n = dict(rows(FL.split_train_test(d, ["id"], 0.2, 10, mode, 3, ["id"]).groupBy("split").count()))
        assert n == {"test": 20, "valid": 10, "train": 73}
    tail = FL.split_train_test(d, ["id"], 5).filter("split = 'test'")
    assert rows(tail, "id") == [(i,) for i in range(98, 103)]


def test_id_checks(spark):
    d = spark.createDataFrame([(-3,), (2,), (9,)], "i long")
    assert rows(d.select(FL.sanitize_id(F.col("i"), 5).alias("x"))) == [(0,), (2,), (4,)]
    with pytest.raises(ValueError):
        FL.check_ids(d, {"i": 5})


def test_scalers(spark):
    d = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    f = SC.fit_scaler(d, ["a", "b"], "StandardScaler")
    assert f == {"a": (2.0, 1.0), "b": (5.0, 1.0)}
    assert SC.fit_scaler(d, ["a"], "MinMaxScaler") == {"a": (1.0, 2.0)}
    with pytest.raises(NotImplementedError):
        SC.fit_scaler(d, ["a"], "Other")


def test_narrowing(spark):
    d = spark.createDataFrame([(1, 300, 70000, 1.5), (-5, 2, 3, 2.5)], "a long, b long, c long, d double")
    assert [f.dataType.simpleString() for f in SC.narrow_types(d, d.columns).schema] == ["tinyint", "smallint", "int", "float"]


def test_nearest_rank_percentiles(spark):
    freq = spark.createDataFrame([("s", str(i), n) for i, n in enumerate([1, 1, 2, 3, 10])], "side string, id string, n long")
    r = ST.side_stats(freq).first()
    assert (r.unique_ids, r.total_events, r.min, r.max, r.p50, r.p90, r.p99) == (5, 17, 1, 10, 2, 10, 10)


def test_label_distribution_odd_values(spark):
    d = spark.createDataFrame([("1",), ("0",), ("-2",), (None,), ("x",), ("inf",), ("0.5",)], "y string")
    r = ST.label_distribution(d, "y").first()
    assert (r["count"], r.missing_count, r.non_numeric_count, r.non_finite_count) == (4, 1, 1, 1)
    assert (r.zero_count, r.one_count, r.negative_count_lt0, r.non_binary_count) == (1, 1, 1, 2)


def test_remap_unknown_and_validation(spark):
    t = spark.createDataFrame([("f", 10, 1), ("f", 20, 2)], "feature string, old_id long, new_id long")
    d = spark.createDataFrame([(1, 10, [20, 0, 11]), (2, 15, []), (3, None, None)], "k long, f long, s array<long>")
    out = RM.remap_frame(d, ["f", "s"], t, {"s": "f"})
    assert {r.k: (r.f, list(r.s)) for r in out.collect()} == {1: (1, [2, 0, 0]), 2: (0, []), 3: (0, [])}
    for bad in ([("", 1, 1)], [("f", -1, 1)], [("f", 1, None)], [("f", 1, 1), ("f", 1, 2)]):
        with pytest.raises(ValueError):
            RM.check_remap(spark.createDataFrame(bad, t.schema))
    assert rows(RM.unmap(spark.createDataFrame([(0,), (1,), (9,)], "c long"), "c", t, "f", "o"), "o") == [(0,), (10,), (20,)]


def test_small_vocabularies_are_kept(spark):
    used = spark.createDataFrame([("big", i) for i in range(1, 11)] + [("small", 1)], "feature string, id long")
    got = {r.feature: r.prune for r in RM.pruning_decisions(used, {"big": 1000, "small": 50}).collect()}
    assert got == {"big": 1, "small": 0}


def test_conditioned_columns_and_neutral_values(spark):
    cols = ["request_id", "user_id", "label", "brand", "age", "ctx", "impression_id"]
    bad = AU.conditioned_columns(cols, ["item_id", "brand"], ["item_id", "impression_id"], ["label"], S.FeatureGroups({"ctx": "FG1", "age": "FG3"}))
    assert bad == ["label", "brand", "ctx", "impression_id"]
    d = spark.createDataFrame([(1, 2.5, [4, 5])], "a long, b double, s array<int>")
    r = AU.neutralize(d, ["a", "b", "s"], {"b": {"type": "numeric"}, "s": {"type": "sequence", "max_len": 3, "padding_idx": 0}}).first()
    assert (r.a, r.b, list(r.s)) == (0, 0.0, [0, 0, 0])


def test_leakage(spark):
    users = spark.createDataFrame([(1, ["5", "6"]), (2, ["7"]), (3, ["9"])], "request_id long, h array<string>")
    c = spark.createDataFrame([(1, 6, 1.0), (1, 5, 1.0), (2, 8, 1.0), (3, 9, 0.0)], "request_id long, item_id long, label double")
    s = AU.leakage_summary(AU.sequence_leakage(users, c, ["h"])).first()
    assert (s.checks, s.hits, s.hit_rate) == (2, 1, 0.5)


def test_fit_sees_train_only(spark):
    """A token of the holdout stays unknown, and holdout item filters come from train labels."""
    s = {"train": spark.createDataFrame([(1, 1.0, "a", 10), (2, 1.0, "a", 10), (3, 0.0, "b", 11)], "id long, y double, c string, item long"),
         "valid": spark.createDataFrame([(4, 1.0, "zzz", 10), (5, 1.0, "a", 11), (6, 0.0, "a", 10)], "id long, y double, c string, item long")}
    out, enc = J.prepare(s, [S.FeatureSpec("c")], "y", "id", "item", ["item"], train_head_count=2)
    assert rows(out["valid"], "id", "c") == [(4, 2)]          # train kept only item 10: vocabulary {a}
    assert enc.feature_map("d", ["y"]).features["c"]["vocab_size"] == 3


def test_prepare_synthetic(spark, tmp_path):
    specs = S.expand_features([{"name": ["cand_category", "cand_brand"], "dtype": "int"}, {"name": "clicked_item_seq", "type": "sequence", "splitter": ",", "max_len": 4, "padding": "pre", "share_embedding": "cand_item_id"},
                               {"name": "user_age_level", "type": "numeric", "dtype": "float", "normalizer": "MinMaxScaler"}])
    specs = [S.FeatureSpec("cand_item_id", dtype="int"), *specs]
    tables, enc = J.prepare(synthetic_splits(spark), specs, "label", "impression_id", "cand_item_id", positive_holdout=True)
    fm = J.write_prepared(tables, enc, str(tmp_path), "synthetic", "label")
    assert {s: spark.read.parquet(f"{tmp_path}/{s}.parquet").count() for s in tables} == {"train": 96, "valid": 24, "test": 24}
    v = spark.read.parquet(f"{tmp_path}/valid.parquet")
    assert v.filter(F.size("clicked_item_seq") != 4).isEmpty() and v.filter("label <> 1").isEmpty()
    assert fm.features["clicked_item_seq"]["share_embedding"] == "cand_item_id"
    assert "user_age_level" in fm.features and v.agg(F.max("user_age_level")).first()[0] == 1.0


def test_sequences_of_rows_that_share_a_key_stay_apart(spark):
    v = VO.build_vocab(VO.token_counts(words(spark, "a", "a", "a", "b", "b", "c"), "t"))
    d = spark.createDataFrame([(1, "a^b"), (1, "c"), (1, "a^b"), (2, None)], "r long, s string")
    got = sorted((r.r, tuple(r.s)) for r in VO.encode_sequence(d, "s", v, 3).collect())
    assert got == [(1, (1, 2, 0)), (1, (1, 2, 0)), (1, (3, 0, 0)), (2, (0, 0, 0))]
    t = spark.createDataFrame([("s", 10, 1), ("s", 20, 2)], "feature string, old_id long, new_id long")
    d = spark.createDataFrame([(1, [10, 20]), (1, [20]), (1, [10, 20])], "r long, s array<long>")
    assert sorted(tuple(r.s) for r in RM.remap_sequence(d, "s", t).collect()) == [(1, 2), (1, 2), (2,)]


def test_meta_ids_of_holdouts_stay_distinct(spark):
    s = {n: spark.createDataFrame([(i, f"r{k}", 1.0, "a") for i, k in enumerate(ks)], "id long, req string, y double, item string")
         for n, ks in (("train", (1, 1, 5)), ("valid", (2, 3, 2)), ("test", (3, 9)))}
    out, _ = J.prepare(s, [S.FeatureSpec("req", "meta"), S.FeatureSpec("item")], "y", "id", "item")
    codes = {n: [r[0] for r in out[n].orderBy("id").select("req").collect()] for n in out}
    assert codes == {"train": [1, 1, 2], "valid": [3, 4, 3], "test": [4, 5]}


def test_rare_items_leave_the_holdouts_only(spark):
    f = lambda *items: spark.createDataFrame([(i, 1.0, x) for i, x in enumerate(items)], "id long, y double, item string")
    out, _ = J.prepare({"train": f("a", "a", "b"), "valid": f("a", "b")}, [S.FeatureSpec("item")], "y", "id", "item", min_item_count_eval=2)
    assert out["train"].count() == 3 and out["valid"].count() == 1


def test_pair_distance_is_exact_below_the_cap_and_distinct_above(spark):
    from lumirank.operators import sampling as SA
    d = spark.createDataFrame([(i, [x]) for i, x in enumerate((0.0, 1.0, 10.0))], "k long, v array<double>")
    r = SA.pair_distance(d, "k", "v", 100).first()
    assert (r.pairs, round(r.mean_distance, 3)) == (3, 6.667)
    powers = spark.createDataFrame([(i, [float(2 ** i)]) for i in range(30)], "k long, v array<double>")   # every pair has its own distance
    for n in (7, 200, 435):
        r = SA.pair_distance(powers, "k", "v", n, seed=3).first()
        assert r.pairs == n
    assert abs(r.mean_distance - sum(2 ** a - 2 ** b for a in range(30) for b in range(a)) / 435) < 1e-3


def test_history_pooling_keeps_every_row(spark):
    from lumirank.operators import retrieve as RT
    h = spark.createDataFrame([(1, [5, 6]), (2, []), (3, None), (4, [9])], "k long, h array<long>")
    v = spark.createDataFrame([(5, [1.0, 2.0]), (6, [3.0, 6.0]), (9, [0.0, 0.0])], "i long, v array<double>")
    assert {r.k: r.v for r in RT.mean_pool(h, "k", "h", v, "i", "v", 2).collect()} == {1: [2.0, 4.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [0.0, 0.0]}


def test_one_pass_fit_equals_single_columns(spark):
    import random
    from lumirank.operators import vocab as VO
    rnd = random.Random(3)
    data = [(rnd.choice(["a", "b", "c", "", None, "7"]), "^".join(rnd.choice(["x", "y", "", "z", "w"]) for _ in range(rnd.randint(0, 6))), rnd.randint(1, 5)) for _ in range(300)]
    df = spark.createDataFrame(data, "cat string, seq string, num int")
    columns = {"cat": None, "seq": "^", "num": None}
    rules = {"cat": {"max_features": 3}, "seq": {"min_freq": 20, "na_value": "y"}, "num": {"remap": False}}
    got = VO.build_vocabs(VO.stacked_counts(df, columns), rules)
    for c, sp in columns.items():
        want, oov = VO.build_sized_vocab(VO.token_counts(df, c, sp), **rules[c])
        assert sorted(map(tuple, got[c][0].collect())) == sorted(map(tuple, want.collect())) and got[c][1] == oov
    none = VO.build_vocabs(VO.stacked_counts(df.limit(0), columns), rules)
    assert {c: (sorted(map(tuple, v.collect())), n) for c, (v, n) in none.items()} == {c: ([("__OOV__", 1), ("__PAD__", 0)], 1) for c in columns}


def _jobs(spark, run):
    """Spark jobs that a call starts."""
    import uuid
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "counted")
    try:
        run()
        return len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_fit_runs_as_many_jobs_for_many_columns(spark):
    from lumirank.plans import jobs as J
    from lumirank.schema import FeatureSpec
    wide = spark.range(200).selectExpr("id", *[f"cast(id % {k + 2} as string) AS c{k}" for k in range(12)])
    three = _jobs(spark, lambda: J.fit(wide, [FeatureSpec(f"c{k}") for k in range(3)]))
    twelve = _jobs(spark, lambda: J.fit(wide, [FeatureSpec(f"c{k}") for k in range(12)]))
    assert twelve == three <= 12


def test_long_sequences_travel_as_digests(spark):
    from lumirank.operators import remap as RM, vocab as VO
    ids = list(range(5_000))
    df = spark.createDataFrame([(1, ids), (2, ids), (3, None), (4, []), (5, [7, None, 7])], "k long, s array<bigint>")
    table = spark.createDataFrame([("s", i, i + 1) for i in range(0, 5_000, 2)], "feature string, old_id long, new_id long")
    got = {r.k: r.s for r in RM.remap_sequence(df, "s", table).collect()}
    want = [i + 1 if i % 2 == 0 else 0 for i in ids]
    assert got == {1: want, 2: want, 3: [], 4: [], 5: [0, 0, 0]}
    text = spark.createDataFrame([(i, "^".join(map(str, ids[i % 2:]))) for i in range(6)], "k long, s string")
    v = spark.createDataFrame([("__PAD__", 0), ("4999", 1), ("__OOV__", 2)], "token string, idx long")
    enc = VO.encode_sequence(text, "s", v, 3, "^", "pre")
    assert [r.s for r in enc.collect()] == [[2, 2, 1]] * 6
    # neither lookup groups or joins by the sequence itself
    for plan in (enc._jdf.queryExecution().optimizedPlan().toString(), RM.remap_sequence(df, "s", table)._jdf.queryExecution().optimizedPlan().toString()):
        groups = [x for x in plan.splitlines() if "Aggregate" in x]
        assert groups and all("__key" in x.split("]")[0] for x in groups)


@pytest.mark.parametrize("most", [1, 3, 7, 20, 40, 1000])
def test_a_cut_vocabulary_sorts_few_tokens(spark, most):
    import random
    from lumirank.operators import vocab as VO
    rnd = random.Random(most)
    data = [(f"t{k}", rnd.choice([1, 1, 1, 2, 5, 9])) for k in range(60)] + [("", 4)]
    counts = spark.createDataFrame(data, "token string, count long").repartition(3)
    first = sorted(data, key=lambda r: (-r[1], r[0]))[:most]
    cut = VO.cut_counts(counts, most)
    assert set(first) <= set(map(tuple, cut.collect())) and cut.count() <= 2 * most
    got, oov = VO.build_sized_vocab(counts, most)
    want = [t for t, _ in first if t]
    assert {r.token: r.idx for r in got.collect()} == {**{t: i for i, t in enumerate(want, 1)}, "__PAD__": 0, "__OOV__": len(want) + 1} and oov == len(want) + 1
