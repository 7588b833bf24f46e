import numpy as np
import pytest
from pyspark.sql import functions as F

from polysem.functions import losses as fl
from polysem.functions import vectors as fv
from polysem import session
from polysem.operators import joins, neighbors, similarity, tsne, vector_table
from polysem.plans import catalog
from polysem.session import cut, fresh_path
from polysem.sources import readers, writers

WORDS = [("apple", 0), ("apple", 1), ("bank", 0), ("bank", 1), ("bank", 2), ("day", 0)]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = [(w, s, rng.normal(size=5).tolist()) for w, s in WORDS]
    return cut(spark.createDataFrame(rows, "word string, sense int, vec array<float>"))


@pytest.fixture(scope="module")
def arrays(table):
    return {f"{r['word']}_{r['sense']}": np.array(r["vec"], float) for r in table.collect()}


def cos(a, b):
    return a @ b / np.linalg.norm(a) / np.linalg.norm(b)


def test_vector_functions_of_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "z array<float>, v array<float>")
    z, v = F.col("z"), F.col("v")
    r = df.select(
        fv.cosine(z, v).alias("c"), fv.angle(z, v).alias("a"), fv.normalize(z).alias("n"), fv.set_length(z, 2).alias("s"),
        fv.norm(v).alias("l"), fv.limit_length(v, 2.5).alias("m"), fv.angle(v, v).alias("same"), fv.between(z, v, 0.5).alias("b"),
    ).first()
    assert (r["c"], r["a"], r["n"], r["s"], r["l"]) == (0.0, -1.0, [0, 0], [0, 0], 5.0)
    assert r["m"] == [1.5, 2.0] and r["same"] == 0.0 and r["b"] == [1.5, 2.0]


def test_losses_of_large_scores(spark):
    r = spark.range(1).select(
        fl.minus_log_sigmoid(F.lit(-800.0)).alias("a"), fl.minus_log_sigmoid(F.lit(800.0)).alias("b"),
        fl.log_softmax(F.lit(700.0), F.array(F.lit(-700.0), F.lit(699.0))).alias("c"),
    ).first()
    assert r["a"] == 800.0 and r["b"] == 0.0 and np.isclose(r["c"], -np.log(1 + np.exp(-1)))


def test_search_terms(spark, table):
    def parse(*terms):
        df = spark.createDataFrame([(t,) for t in terms], "term string")
        return sorted((r["term"], r["word"], r["sense"]) for r in neighbors.parse_search_terms(df, table).collect())

    assert parse("apple", "bank_2") == [("apple", "apple", 0), ("apple", "apple", 1), ("bank_2", "bank", 2)]
    for bad in ("a_b_c", "nothing", "apple_7", "apple_x"):
        with pytest.raises(Exception, match="wrong search entry|not in vocabulary"):
            parse(bad)


@pytest.mark.parametrize("cosine", [True, False])
@pytest.mark.parametrize("rows", [4096, 2])  # one cell, or several
def test_top_k(table, arrays, cosine, rows, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", rows)
    queries = neighbors.keyed(table).select(F.col("key").alias("query"), "vec")
    got = neighbors.top_k_neighbors(table.repartition(3), queries, 2, 5, cosine).collect()
    assert len(got) == 6 * 3
    for q, vec in arrays.items():
        unit = vec / np.linalg.norm(vec)
        sims = {k: (cos(vec, v) if cosine else unit @ v) for k, v in arrays.items()}
        want = sorted(sims, key=lambda k: (-sims[k], k))[:3]
        mine = sorted((r["rank"], r["key"], r["sim"]) for r in got if r["query"] == q)
        assert [m[1] for m in mine] == want and np.allclose([m[2] for m in mine], [sims[k] for k in want])


def test_top_k_with_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 500)
    rows = [(f"w{i:04d}", 0, [1.0, 0.0]) for i in range(3000)] + [("x", 0, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "word string, sense int, vec array<float>").repartition(4)
    query = spark.createDataFrame([("q", [2.0, 0.0])], "query string, vec array<float>")
    got = neighbors.top_k_neighbors(table, query, 2, 2).orderBy("rank").collect()
    assert [r["key"] for r in got] == ["w0000_0", "w0001_0", "w0002_0"]


def test_report_hides_senses_of_one_sense_words(spark, table):
    terms = spark.createDataFrame([("day",), ("apple",), ("day_0",)], "term string")
    got = neighbors.neighbors_report(table, terms, 5, 5).collect()
    assert {r["query"] for r in got if r["term"] == "day"} == {"day"}
    assert {r["query"] for r in got if r["term"] == "day_0"} == {"day_0"}
    assert {r["other"] for r in got if r["part"] == "neighbor" and r["term"] == "day"} == {
        "day", "apple_0", "apple_1", "bank_0", "bank_1", "bank_2"}
    assert sum(r["part"] == "senses" for r in got) == 4


def test_words_with_separators(spark):
    """Cleaning keeps separators inside a word, so keys are cut at the last one."""
    rows = [("foo_bar", 0, [1.0, 0.1]), ("foo_bar_1", 0, [0.9, 0.3]), ("a_b_c", 0, [0.8, 0.5]), ("a_b_c", 1, [0.1, 1.0]), ("day", 0, [1.0, 0.0])]
    table = cut(spark.createDataFrame(rows, "word string, sense int, vec array<float>"))

    def parse(*terms):
        df = spark.createDataFrame([(t,) for t in terms], "term string")
        return sorted((r["term"], r["word"], r["sense"]) for r in neighbors.parse_search_terms(df, table).collect())

    assert parse("foo_bar", "foo_bar_0", "a_b_c", "a_b_c_1") == [
        ("a_b_c", "a_b_c", 0), ("a_b_c", "a_b_c", 1), ("a_b_c_1", "a_b_c", 1), ("foo_bar", "foo_bar", 0), ("foo_bar_0", "foo_bar", 0)]
    assert parse("foo_bar_1") == [("foo_bar_1", "foo_bar_1", 0)]  # a word of its own
    for bad in ("foo_bar_2", "foo", "a_b", "_0"):
        with pytest.raises(Exception, match="not in vocabulary"):
            parse(bad)

    terms = spark.createDataFrame([("day",), ("a_b_c",)], "term string")
    report = neighbors.neighbors_report(table, terms, 4, 2).collect()
    near = [(r["rank"], r["other"]) for r in report if r["term"] == "day" and r["part"] == "neighbor"]
    assert sorted(near) == [(1, "day"), (2, "foo_bar"), (3, "foo_bar_1"), (4, "a_b_c_0"), (5, "a_b_c_1")]
    assert sorted(r["rank"] for r in report if r["part"] == "senses") == [0, 0, 1, 1]

    queries = neighbors.keyed(table).select(F.col("key").alias("query"), "vec")
    per_word = neighbors.neighbors_per_word(neighbors.top_k_neighbors(table, queries, 1, 2))
    path = fresh_path(spark, "lists")
    writers.write_neighbor_lists(per_word, path)
    lines = [r["value"].split("\t") for r in spark.read.text(f"{path}/per_word").collect()]
    assert {w for w, _ in lines} == {"foo_bar", "foo_bar_1", "a_b_c", "day"}
    every = [r["value"] for r in spark.read.text(f"{path}/all").collect()]
    assert sorted(every) == sorted({k for _, k in lines})

    vocab = spark.createDataFrame([("foo_bar", 0, 1), ("a_b_c", 1, 2), ("x_1_2", 2, 3)], "word string, word_id int, n_senses int")
    writers.write_word_index(vocab, f"{path}/index")
    assert sorted(map(tuple, readers.read_word_index(spark, f"{path}/index").collect())) == sorted(map(tuple, vocab.collect()))


@pytest.mark.parametrize("name", [
    "negative_samples", "filter_oov", "join_vocab", "write_tagged_corpus", "avg_sim", "contextual_similarity", "loss_per_prediction",
])
def test_results_do_not_depend_on_what_is_broadcast(spark, monkeypatch, name):
    run = lambda: sorted(map(str, catalog.queries()[name](spark, "/root/testdata/sf0.001").collect()))
    small = run()
    monkeypatch.setattr(session, "BROADCAST_LIMIT", 0)
    assert run() == small and small


def test_a_hot_word_is_split_over_tasks(spark, monkeypatch):
    """A word with a third of all tokens: with both sides shuffled, Spark splits it."""
    monkeypatch.setattr(session, "BROADCAST_LIMIT", 0)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        facts = spark.range(0, 300_000, 1, 16).select(
            F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).alias("word_id")
        )
        words = cut(spark.range(1000).select(F.col("id").alias("word_id"), F.hash("id").alias("h")))
        met = joins.lookup_join(facts, words, ["word_id"], 1000, 16)
        sizes = [r["n"] for r in met.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 300_000 and max(sizes) < 100_000  # the word alone has more
    finally:
        for k in conf:
            spark.conf.set(k, old[k]) if k in old else spark.conf.unset(k)


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_pair_similarity(spark, table, arrays):
    pairs = spark.createDataFrame([(1, "Apple", "BANK"), (2, "day", "day")], "id bigint, word1 string, word2 string")
    got = {r["id"]: r["score"] for r in similarity.pair_similarity_job(pairs, table, 3, 5).collect()}
    grid = [cos(arrays[f"apple_{i}"], arrays[f"bank_{j}"]) for i in range(2) for j in range(3)]
    assert np.isclose(got[1], np.mean(grid)) and np.isclose(got[2], 1.0)
    lower = pairs.select("id", F.lower("word1").alias("word1"), F.lower("word2").alias("word2"))
    best = {r["id"]: r["score"] for r in similarity.max_sim(similarity.with_senses(lower, table, 3, 5)).collect()}
    assert np.isclose(best[1], max(grid))
    with pytest.raises(Exception, match="not in vocabulary"):
        similarity.pair_similarity_job(pairs.withColumn("word2", F.lit("nope")), table, 3, 5).collect()


def test_similarity_in_context(spark, table, arrays):
    outputs = table.where("sense = 0")
    pairs = spark.createDataFrame(
        [(1, "bank", "apple", "day unknown Day day", "bank"), (2, "bank", "nope", "day", "day"), (3, "apple", "bank", "", "unknown")],
        "id bigint, word1 string, word2 string, context1 string, context2 string",
    )
    got = {r["id"]: r for r in similarity.contextual_similarity(pairs, table, outputs, 6, 5).collect()}
    assert set(got) == {1, 3}

    def best(word, n, context):
        scores = [sum(-np.log1p(np.exp(-arrays[f"{word}_{s}"] @ arrays[f"{c}_0"])) for c in context) for s in range(n)]
        return int(np.argmax(scores))

    a, b = best("bank", 3, ["day", "day"]), best("apple", 2, ["bank"])
    assert (got[1]["sense1"], got[1]["sense2"]) == (a, b)
    assert np.isclose(got[1]["score"], 10 * cos(arrays[f"bank_{a}"], arrays[f"apple_{b}"]))
    assert (got[3]["sense1"], got[3]["sense2"]) == (0, 0)  # nothing known around: the first sense


def test_blocks_do_not_change_products(spark, monkeypatch):
    monkeypatch.setattr(vector_table, "n_blocks", lambda rows, block_rows=0: 4)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(23, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, vec array<double>")
    got = vector_table.gram_matrix(df, "id", "vec", 23).toPandas()
    full = np.full((23, 23), np.nan)
    full[got["i"], got["j"]] = got["value"]
    assert len(got) == 23 * 23 and np.allclose(full, m @ m.T)
    c = vector_table.pairwise_cosine(df, "id", "vec", 23).where("i = j").agg(F.max("value")).first()[0]
    assert c == 0.0


def plain_gradient(p, y):
    num = 1 / (1 + np.square(y[:, None] - y[None]).sum(-1))
    np.fill_diagonal(num, 0)
    q = np.maximum(num / num.sum(), 1e-100)
    l = (p - q) * num
    return 4 * (np.diag(l.sum(1)) - l) @ y, (p[p > 0] * np.log(p[p > 0] / q[p > 0])).sum()


def test_map_gradient_and_fit(spark, monkeypatch):
    monkeypatch.setattr(tsne, "n_blocks", lambda rows, block_rows=0: 3)
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.normal(size=(8, 3)), rng.normal(size=(8, 3)) + 8))
    raw = np.exp(-np.square(x[:, None] - x[None]).sum(-1) / 4)
    rows = [(i, j, float(raw[i, j])) for i in range(16) for j in range(16)]
    affinity = cut(tsne.affinities(spark.createDataFrame(rows, "i bigint, j bigint, p double")))
    p = np.zeros((16, 16))
    for r in affinity.collect():
        p[r["i"], r["j"]] = r["p"]
    assert np.isclose(p.sum(), 1) and np.allclose(p, p.T) and not p.diagonal().any()
    y = rng.normal(size=(16, 2))
    coords = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "i bigint, y array<double>")
    want, _ = plain_gradient(p, y)
    got = np.zeros((16, 2))
    for r in tsne.gradient(affinity, coords, 16).collect():
        got[r["i"]] = r["grad"]
    assert np.allclose(got, want)

    def divergence(steps):
        fitted = np.zeros((16, 2))
        for r in tsne.fit(affinity, 16, max_iter=steps).collect():
            fitted[r["i"]] = r["y"]
        assert steps == 0 or np.allclose(fitted.mean(0), 0, atol=1e-9)
        return plain_gradient(p, fitted)[1]

    # so few points need small steps, and the exaggerated start has another aim
    monkeypatch.setattr(tsne, "LEARNING_RATE", 10.0)
    monkeypatch.setattr(tsne, "EXAGGERATION", 1.0)
    assert divergence(6) < divergence(0)


def test_readers(spark):
    def file(name, *lines):
        path = fresh_path(spark, name)
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
        return path

    vectors = readers.read_sense_vectors(spark, file("v", "a 0 1.0 2.0 ", "a 1 3.0 4.5 ", "b 0 0.0 1e-3 ")).orderBy("line_no").collect()
    assert [(r["word"], r["sense"], r["vec"][0]) for r in vectors] == [("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 0.0)]
    with pytest.raises(Exception, match="another width"):
        readers.read_sense_vectors(spark, file("v", "a 0 1.0 2.0", "b 0 1.0")).collect()
    pair = readers.read_word_pairs(spark, file("p", "x,y,7.5", '"q",z')).orderBy("id").collect()
    assert [(r["id"], r["word1"], r["word2"]) for r in pair] == [(0, "x", "y"), (1, '"q"', "z")]
    ctx = readers.read_context_pairs(spark, file("c", 'a\tb\tsome "quoted\tmore text\textra')).first()
    assert (ctx["context1"], ctx["context2"]) == ('some "quoted', "more text")
    series = readers.read_series(spark, file("s", "1.5", "-2", "3e2")).orderBy("idx").collect()
    assert [r["x"] for r in series] == [1.5, -2.0, 300.0]
    assert {r["word"] for r in readers.read_eval_words(spark, file("w", "a", "b", "a")).collect()} == {"a", "b"}
    assert readers.read_corpus(spark, file("t", "one two", "three")).count() == 2


def test_correlation(spark):
    x = spark.createDataFrame([(i, float(i)) for i in range(5)], "idx bigint, x double")
    y = spark.createDataFrame([(i, float(-2 * i)) for i in range(5)], "idx bigint, y double")
    assert np.isclose(similarity.pearson_correlation(similarity.zip_series(x, y)).first()["r"], -1.0)
