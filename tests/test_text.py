import pytest
from pyspark.sql import functions as F

from polysem.functions import text as tx
from polysem.operators import corpus, vocabulary

TEXT = "Hello,  World!\t 42 (don't) a-b Été. --x--\r\nsecond line\rthird\n\nlast "


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, ""), (3, "123 !!!")], "doc_id bigint, text string")


def test_lines_and_tokens(docs):
    lines = corpus.sentences(docs).where("doc_id = 1").orderBy("line").collect()
    assert [r["text"] for r in lines][1:] == ["second line", "third", "", "last "]
    raw = corpus.tokenize(corpus.sentences(docs)).where("doc_id = 1 and line = 0").orderBy("raw_pos")
    assert [r["raw"] for r in raw.collect()][:3] == ["Hello,", "", "World!\t"]


def test_one_pass_words_equal_token_by_token(docs):
    lines = corpus.sentences(docs)
    one_pass = corpus.word_sentences(lines).select("doc_id", "line", F.posexplode("words").alias("pos", "word"))
    tokens = corpus.clean_tokens(corpus.tokenize(lines))
    got = [r["word"] for r in one_pass.orderBy("doc_id", "line", "pos").collect()]
    want = [r["word"] for r in tokens.orderBy("doc_id", "line", "raw_pos").collect()]
    assert got == want
    assert got[:6] == ["hello", "world", "don't", "a-b", "été", "x"]


def test_both_encodings_agree_and_close_gaps(spark, lines):
    words = corpus.word_sentences(lines)
    vocab, n = vocabulary.build_vocab(vocabulary.word_count(words), 15, [])
    assert 0 < n < 5
    a = {(r["doc_id"], tuple(r["ids"])) for r in corpus.encode(words, vocab, n).collect()}
    b = {(r["doc_id"], tuple(r["ids"])) for r in corpus.encode_by_join(words, vocab, n).collect()}
    assert a == b and a


def test_codes_round_trip(spark):
    df = spark.range(5).select(corpus.pack(F.col("id"), F.col("id") % 3).alias("c"), "id")
    for r in df.select("id", corpus.word_of(F.col("c")).alias("w"), corpus.sense_of(F.col("c")).alias("s")).collect():
        assert (r["w"], r["s"]) == (r["id"], r["id"] % 3)


def test_tagged_text(spark, lines):
    words = corpus.word_sentences(lines)
    vocab, n = vocabulary.build_vocab(vocabulary.word_count(words), 1, [15])
    cuts = vocabulary.sense_cuts(vocab, 2)
    coded = corpus.random_senses(corpus.encode(words, vocab, n), cuts, 42)
    text = {r["doc_id"]: r["text"] for r in corpus.tagged(coded, vocab, n).collect()}
    plain = {r["doc_id"]: r["text"] for r in lines.collect()}
    for doc, tagged in text.items():
        assert [t.split("_")[0] for t in tagged.split(" ")] == plain[doc].split(" ")
    assert tx.KEY_SEPARATOR == "_"


def test_sense_number_follows_thresholds(spark, lines):
    words = corpus.word_sentences(lines)
    for thresholds in ([10, 20], [20, 10]):  # the last threshold reached counts
        vocab, _ = vocabulary.build_vocab(vocabulary.word_count(words), 1, thresholds)
        cuts = vocabulary.sense_cuts(vocab, 3)
        got = vocab.withColumn("by_id", corpus.sense_number(F.col("word_id"), cuts)).collect()
        for r in got:
            reached = [i + 2 for i, t in enumerate(thresholds) if r["cn"] >= t]
            assert r["n_senses"] == r["by_id"] == (reached[-1] if reached else 1)


def test_eval_words_stay(spark, lines):
    counts = vocabulary.word_count(corpus.word_sentences(lines))
    rare = counts.orderBy("cn", "word").first()
    words = spark.createDataFrame([(rare["word"],), ("never",)], "word string")
    vocab, n = vocabulary.build_vocab(counts, 10_000, [], words)
    assert n == 1 and vocab.first()["word"] == rare["word"]


def test_histogram(spark, lines):
    counts = vocabulary.word_count(corpus.word_sentences(lines))
    cn = [r["cn"] for r in counts.collect()]
    for r in vocabulary.accumulated_count_histogram(counts).collect():
        assert r["n_at_least"] == sum(c >= r["cn"] for c in cn)
