"""One runnable query per operator, over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polysem.functions import losses as fl
from polysem.functions import text as tx
from polysem.functions import vectors as fv
from polysem.functions.hashing import uniform
from polysem.operators import (
    corpus, model, neighbors, objective, ordering, pairs, sampling, score_table, senses, similarity, tsne, vector_table, vocabulary,
)
from polysem.operators.kernels import Objective
from polysem.plans import training
from polysem.session import cut, fresh_path, spread, stored
from polysem.sources import readers, writers

SEED, MIN_COUNT, THRESHOLDS = 42, 5, [50, 200]
WINDOW, N_NEG, DIM, CHUNKS, TOP = 2, 3, 8, 20, 10
TOKENS_PER_BUCKET = 25_000
# Models that average_parameters is the mean of.
BUCKETS = 8
EMBEDDING_DIM = 64
# Room for the places within one item, so that packed ids do not collide.
PLACES = 1 << 32
# Entries of the test model are uniform in +-1: with the tiny entries of a
# fresh model every loss would be the same.
MODEL_SCALE = 2.0 * DIM
RARE, MAX_SQUARE, ALPHA, GAMMA, DECAY = 0.2, 2.5, 0.1, 0.9, 0.1


def _dims(df: DataFrame, *keys: str, vec: str = "vec", digits: int = 6, name: str = "x") -> DataFrame:
    """A vector column as rows (keys, k, x)."""
    rows = df.select(*keys, F.posexplode(vec).alias("k", "x"))
    return rows.select(*keys, "k", F.round(F.col("x").cast("double"), digits).alias(name))


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _int_list(items: Column) -> Column:
    return F.array_join(items.cast("array<string>"), " ")


class Inputs:
    """The tables and what the queries derive from them, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def scratch(self, name: str) -> str:
        return fresh_path(self.spark, name)

    # text
    @cached_property
    def lines(self) -> DataFrame:
        return corpus.sentences(spread(self.table("documents").select("doc_id", "text"), "doc_id"))

    @cached_property
    def tokens(self) -> DataFrame:
        return corpus.clean_tokens(corpus.tokenize(self.lines))

    @cached_property
    def words(self) -> DataFrame:
        return corpus.word_sentences(self.lines)

    @cached_property
    def counts(self) -> DataFrame:
        return vocabulary.word_count(self.words)

    @cached_property
    def benchmark_words(self) -> DataFrame:
        flat = F.regexp_replace("text", tx.LINE_BREAK, " ")
        return self.table("benchmark").select("item_id", tx.words(flat).alias("words"))

    @cached_property
    def eval_words(self) -> DataFrame:
        return self.benchmark_words.select(F.explode("words").alias("word")).distinct()

    # vocabulary and sentences
    @cached_property
    def _vocab(self) -> tuple[DataFrame, int]:
        return vocabulary.build_vocab(self.counts, MIN_COUNT, THRESHOLDS)

    @property
    def vocab(self) -> DataFrame:
        return self._vocab[0]

    @property
    def vocab_rows(self) -> int:
        return self._vocab[1]

    @cached_property
    def cuts(self) -> list[int]:
        return vocabulary.sense_cuts(self.vocab, len(THRESHOLDS) + 1)

    @cached_property
    def encoded(self) -> DataFrame:
        return corpus.encode(self.words, self.vocab, self.vocab_rows)

    @cached_property
    def coded(self) -> DataFrame:
        return corpus.random_senses(self.encoded, self.cuts, SEED)

    @cached_property
    def unigram(self) -> DataFrame:
        return vocabulary.unigram_distribution(self.vocab)

    def draw(self, coded: DataFrame) -> DataFrame:
        return sampling.with_negatives(coded, self.unigram, self.vocab_rows, N_NEG, self.cuts, True, SEED)

    @cached_property
    def with_negatives(self) -> DataFrame:
        """Drawn again wherever it is read, which costs less than to store it; for what reads
        it twice because the model does not fit in memory, it is stored."""
        noisy = self.draw(self.coded)
        return noisy if objective.fits_in_memory(self.model_rows, DIM, self.model) else stored(noisy, "negatives")

    @cached_property
    def repeated(self) -> DataFrame | None:
        """The doc_id of documents that occur several times, if there are any."""
        several = self.table("documents").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
        return several if several.take(1) else None

    @cached_property
    def buckets(self) -> int:
        """Groups of sentences of bounded size, however large the corpus is."""
        tokens = self.vocab.agg(F.sum("cn")).first()[0] or 0
        return max(1, -(-tokens // TOKENS_PER_BUCKET))

    def objective(self, **changes) -> Objective:
        return Objective(**{"window": WINDOW, "n_neg": N_NEG, "cuts": tuple(self.cuts), **changes})

    # model
    @cached_property
    def model(self) -> DataFrame:
        return model.init_random(self.vocab, DIM, SEED, True, MODEL_SCALE, MODEL_SCALE)

    @property
    def model_rows(self) -> int:
        """Input rows of every sense of every word, and an output row of every word."""
        return 2 * self.vocab_rows + sum(self.cuts)

    @cached_property
    def inputs(self) -> DataFrame:
        return writers.named_rows(self.model, self.vocab, objective.INPUT).select("word", "sense", "vec")

    @cached_property
    def outputs(self) -> DataFrame:
        return writers.named_rows(self.model, self.vocab, objective.OUTPUT).select("word", "sense", "vec")

    @cached_property
    def assigned(self) -> DataFrame:
        return score_table.assign_senses(self.with_negatives, self.model, self.objective(), self.model_rows, DIM)

    @cached_property
    def probs(self) -> DataFrame:
        counts = objective.token_sense_counts(self.assigned)
        return senses.update_sense_probs(senses.uniform_sense_probs(self.vocab), counts)

    # word pairs
    @cached_property
    def word_pairs(self) -> DataFrame:
        following = F.arrays_zip(
            F.slice("words", 1, F.size("words") - 1).alias("word1"), F.slice("words", 2, F.size("words")).alias("word2")
        )
        some = self.benchmark_words.where(F.size("words") > 1)
        pair = some.select("item_id", F.posexplode(following).alias("pos", "p"))
        return pair.select((F.col("item_id") * PLACES + F.col("pos")).alias("id"), "p.word1", "p.word2")

    @cached_property
    def known_pairs(self) -> DataFrame:
        known = self.vocab.select("word")
        first = self.word_pairs.join(known.withColumnRenamed("word", "word1"), "word1", "left_semi")
        return first.join(known.withColumnRenamed("word", "word2"), "word2", "left_semi").select("id", "word1", "word2")

    @cached_property
    def context_pairs(self) -> DataFrame:
        flat = F.regexp_replace("text", tx.LINE_BREAK, " ")
        turns = self.table("conversations").select("conv_id", "turn", tx.words(flat).alias("words"))
        turns = turns.where(F.size("words") > 0)
        nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("next"))
        return turns.join(nxt, ["conv_id", "turn"]).select(
            (F.col("conv_id") * PLACES + F.col("turn")).alias("id"),
            F.element_at("words", 1).alias("word1"), F.element_at("next", 1).alias("word2"),
            F.array_join("words", " ").alias("context1"), F.array_join("next", " ").alias("context2"),
        )

    @cached_property
    def pair_scores(self) -> DataFrame:
        return similarity.pair_similarity_job(self.known_pairs, self.inputs, self.model_rows, DIM)

    # embeddings
    @cached_property
    def vectors(self) -> DataFrame:
        """Every embedding is a word with one stored sense, its label."""
        word = F.concat(F.lit("v"), F.col("vec_id").cast("string"))
        return self.table("embeddings").select("vec_id", word.alias("word"), F.col("label").alias("sense"), F.col("embedding").alias("vec"))

    @cached_property
    def vector_rows(self) -> int:
        return self.table("embeddings").count()

    @cached_property
    def two(self) -> DataFrame:
        a = self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("a"))
        b = self.table("embeddings").select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("b"))
        return a.join(b, "id")

    @cached_property
    def eval_queries(self) -> DataFrame:
        keyed = neighbors.keyed(self.inputs.join(self.eval_words, "word", "left_semi"))
        return keyed.select(F.col("key").alias("query"), "vec")

    @cached_property
    def eval_neighbors(self) -> DataFrame:
        return neighbors.top_k_neighbors(self.inputs, self.eval_queries, TOP, DIM)

    # series
    @cached_property
    def daily(self) -> DataFrame:
        """A loss-like history: mean event value per day."""
        days = self.table("events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("loss"))
        numbered, _ = ordering.number_rows(days, "day", column="it")
        return numbered.select(F.col("it").cast("int"), "loss")

    # map
    @cached_property
    def affinity(self) -> tsne.Cosines:
        return tsne.Cosines(self.table("embeddings"), "vec_id", "embedding", self.vector_rows)

    @cached_property
    def coords(self) -> DataFrame:
        points = self.table("embeddings").select(F.col("vec_id").alias("i"))
        tiny = tsne.init_coords(points, 2, SEED)
        return tiny.select("i", fv.scale(F.col("y"), 1 / tsne.INIT_SCALE).alias("y"))

    @cached_property
    def map_gradient(self) -> DataFrame:
        return tsne.gradient(self.affinity, self.coords, self.vector_rows)


Query = Callable[[Inputs], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# --- sources ----------------------------------------------------------------------


@query
def scan_sentences(t: Inputs) -> DataFrame:
    return t.lines


@query
def corpus_preview(t: Inputs) -> DataFrame:
    n = t.lines.agg(F.count("*").alias("n")).scalar()
    return t.lines.orderBy("doc_id", "line").limit(2).withColumn("n_lines", n)


@query
def scan_eval_words(t: Inputs) -> DataFrame:
    path = t.scratch("eval_words")
    t.benchmark_words.select(F.explode("words").alias("value")).write.text(path)
    return readers.read_eval_words(t.spark, path)


@query
def scan_sense_vectors(t: Inputs) -> DataFrame:
    path = t.scratch("vectors")
    writers.write_sense_vectors(t.vectors.select("word", "sense", "vec"), path)
    read = readers.read_sense_vectors(t.spark, path)
    return _dims(read.join(neighbors.senses_of_words(read), "word"), "word", "sense", "n_senses")


@query
def scan_word_pairs(t: Inputs) -> DataFrame:
    path = t.scratch("pairs")
    t.word_pairs.select(F.concat_ws(",", "word1", "word2", "id").alias("value")).write.text(path)
    return readers.read_word_pairs(t.spark, path).groupBy("word1", "word2").agg(F.count("*").alias("n"))


@query
def scan_context_pairs(t: Inputs) -> DataFrame:
    path = t.scratch("context_pairs")
    fields = ["word1", "word2", "context1", "context2"]
    t.context_pairs.select(F.concat_ws("\t", *fields).alias("value")).write.text(path)
    return readers.read_context_pairs(t.spark, path).groupBy(*fields).agg(F.count("*").alias("n"))


@query
def scan_series(t: Inputs) -> DataFrame:
    path = t.scratch("series")
    t.table("documents").orderBy("doc_id").select(F.col("n_chars").cast("string").alias("value")).write.text(path)
    return readers.read_series(t.spark, path)


# --- sinks ------------------------------------------------------------------------


@query
def write_word_index(t: Inputs) -> DataFrame:
    path = t.scratch("word_index")
    writers.write_word_index(t.vocab, path)
    return t.spark.read.text(path)


@query
def write_sense_vectors(t: Inputs) -> DataFrame:
    path = t.scratch("vectors")
    writers.write_sense_vectors(t.inputs, path)
    return _dims(readers.read_sense_vectors(t.spark, path), "word", "sense")


@query
def write_w2v_text(t: Inputs) -> DataFrame:
    path = t.scratch("w2v")
    writers.write_w2v_text(t.inputs, DIM, path)
    parts = F.split("value", " ")
    lines = t.spark.read.text(path).select(F.element_at(parts, 1).alias("key"), F.slice(parts, 2, DIM).cast("array<float>").alias("vec"))
    return _dims(lines, "key")


@query
def write_flat_model(t: Inputs) -> DataFrame:
    index_path, vectors_path = t.scratch("flat_index"), t.scratch("flat_vectors")
    writers.write_flat_model(t.inputs, index_path, vectors_path)
    parts = F.split("value", " ")
    index = t.spark.read.text(index_path).select(parts[0].alias("key"), parts[1].cast("bigint").alias("idx"))
    rows = readers.numbered_lines(t.spark, vectors_path)[0]
    rows = rows.select(F.col("line_no").alias("idx"), parts.cast("array<float>").alias("vec"))
    return _dims(index.join(rows, "idx"), "key", "idx")


@query
def write_history(t: Inputs) -> DataFrame:
    path = t.scratch("history")
    loss = F.when(F.col("it") % 2 == 1, F.col("loss"))
    writers.write_history(t.daily.select("it", loss.alias("vali_loss"), F.lit(None).cast("double").alias("vali_adjust")), path)
    return _rounded(readers.read_history(t.spark, path), "vali_loss")


@query
def write_tagged_corpus(t: Inputs) -> DataFrame:
    path = t.scratch("tagged")
    writers.write_tagged_corpus(corpus.tagged(t.coded, t.vocab, t.vocab_rows, t.repeated), path)
    return t.spark.read.text(path)


@query
def write_neighbor_lists(t: Inputs) -> DataFrame:
    path = t.scratch("neighbors")
    writers.write_neighbor_lists(neighbors.neighbors_per_word(t.eval_neighbors), path)
    parts = F.split("value", "\t", -1)
    return t.spark.read.text(f"{path}/per_word").select(parts[0].alias("query_word"), parts[1].alias("value"))


@query
def write_scores(t: Inputs) -> DataFrame:
    path = t.scratch("scores")
    writers.write_scores(t.pair_scores, path)
    return _rounded(t.spark.read.schema("id bigint, score double").csv(path), "score")


# --- text -------------------------------------------------------------------------


@query
def tokenize(t: Inputs) -> DataFrame:
    return corpus.tokenize(t.lines)


@query
def clean_tokens(t: Inputs) -> DataFrame:
    return t.tokens


@query
def filter_oov(t: Inputs) -> DataFrame:
    return t.encoded.select("doc_id", "line", F.posexplode("ids").alias("pos", "word_id"))


@query
def drop_empty_sentences(t: Inputs) -> DataFrame:
    return t.encoded.select("doc_id", "line", F.size("ids").cast("bigint").alias("n_tokens"))


@query
def encode_word_sense(t: Inputs) -> DataFrame:
    return t.coded.select("doc_id", "line", F.posexplode("codes").alias("pos", "code"))


@query
def decode_word_sense(t: Inputs) -> DataFrame:
    codes = t.coded.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    word, sense = corpus.word_of(F.col("code")), corpus.sense_of(F.col("code"))
    return codes.select("code", word.alias("word_id"), sense.alias("sense"), corpus.pack(word, F.lit(0)).alias("first_code"), "n")


@query
def vocab_predicate(t: Inputs) -> DataFrame:
    return vocabulary.vocab_predicate(t.counts, MIN_COUNT, t.eval_words)


@query
def parse_search_term(t: Inputs) -> DataFrame:
    words = t.inputs.select(F.col("word").alias("term")).distinct()
    terms = words.union(neighbors.keyed(t.inputs).select("key"))
    return neighbors.parse_search_terms(terms, t.inputs).select("term", "word", "sense")


# --- sampling ---------------------------------------------------------------------


@query
def train_validation_split(t: Inputs) -> DataFrame:
    ratio = sampling.validation_ratio(t.lines.count(), 0.1, 200_000)
    train, held_out = sampling.split_train_validation(t.lines, ratio, SEED)
    marked = train.withColumn("is_validation", F.lit(False)).union(held_out.withColumn("is_validation", F.lit(True)))
    return marked.select("doc_id", "line", "is_validation")


@query
def chunk_split(t: Inputs) -> DataFrame:
    return t.lines.select("doc_id", "line", sampling.chunk_of(CHUNKS, SEED).alias("chunk"))


@query
def init_senses(t: Inputs) -> DataFrame:
    tokens = t.coded.select("doc_id", "line", F.posexplode("codes").alias("pos", "code"))
    word, sense = corpus.word_of(F.col("code")), corpus.sense_of(F.col("code"))
    return tokens.select("doc_id", "line", "pos", word.alias("word_id"), sense.alias("sense"))


@query
def unigram_distribution(t: Inputs) -> DataFrame:
    return _rounded(t.unigram.select("word_id", "p", "hi"), "p", "hi", digits=9)


@query
def negative_samples(t: Inputs) -> DataFrame:
    drawn = sampling.negative_samples(t.encoded, t.unigram, t.vocab_rows, N_NEG, SEED)
    rows = drawn.select("doc_id", "line", F.posexplode("neg_ids").alias("pos", "n"))
    return rows.select("doc_id", "line", "pos", _int_list(F.col("n")).alias("neg_ids"))


@query
def negative_sense(t: Inputs) -> DataFrame:
    drawn = sampling.negative_samples(t.encoded, t.unigram, t.vocab_rows, N_NEG, SEED)
    codes = sampling.negative_senses(F.col("neg_ids"), t.cuts, False, SEED)
    counted = drawn.select(F.explode(F.flatten(codes)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return counted.select(corpus.word_of(F.col("code")).alias("word_id"), corpus.sense_of(F.col("code")).alias("sense"), "n")


@query
def categorical_sample(t: Inputs) -> DataFrame:
    weights = t.table("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return sampling.categorical_sample(weights, "user_id", "event_type", "n", uniform(SEED, "category", F.col("user_id")))


@query
def vocab_sample(t: Inputs) -> DataFrame:
    return sampling.vocab_sample(t.vocab, t.vocab_rows, 50, SEED)


# --- aggregations -----------------------------------------------------------------


@query
def word_count(t: Inputs) -> DataFrame:
    return t.counts


@query
def count_of_counts(t: Inputs) -> DataFrame:
    return vocabulary.count_of_counts(t.counts).orderBy("cn")


@query
def accumulated_count_histogram(t: Inputs) -> DataFrame:
    return vocabulary.accumulated_count_histogram(t.counts)


@query
def build_vocab(t: Inputs) -> DataFrame:
    return vocabulary.build_vocab(t.counts, MIN_COUNT, THRESHOLDS, t.eval_words)[0].select("word", "cn", "word_id")


@query
def vocab_totals(t: Inputs) -> DataFrame:
    return vocabulary.vocab_totals(t.counts, t.vocab)


@query
def senses_per_word(t: Inputs) -> DataFrame:
    kept = vocabulary.vocab_predicate(t.counts, MIN_COUNT)
    return kept.withColumn("n_senses", vocabulary.senses_for_count(F.col("cn"), THRESHOLDS))


@query
def sense_count_histogram(t: Inputs) -> DataFrame:
    return vocabulary.sense_count_histogram(senses_per_word(t))


@query
def parameter_count(t: Inputs) -> DataFrame:
    return vocabulary.parameter_count(senses_per_word(t), DIM)


@query
def token_sense_counts(t: Inputs) -> DataFrame:
    return objective.token_sense_counts(t.assigned)


@query
def adjust_rate(t: Inputs) -> DataFrame:
    return _rounded(objective.adjust_rate(t.assigned), "adjust_rate")


@query
def loss_per_prediction(t: Inputs) -> DataFrame:
    total = objective.corpus_loss(t.with_negatives, t.model, t.objective(), t.model_rows, DIM)
    return _rounded(objective.loss_per_prediction(total), "loss_per_prediction")


@query
def average_parameters(t: Inputs) -> DataFrame:
    """Gradients at fixed parameters add up whatever the groups, so these stay of bounded size."""
    updates = objective.bucket_gradients(t.with_negatives, t.model, t.objective(), max(t.buckets, BUCKETS), SEED)
    return _dims(model.average_parameters(t.model, updates, BUCKETS, DIM), "mat", "word_id", "sense", digits=4)


# --- joins ------------------------------------------------------------------------


@query
def join_vocab(t: Inputs) -> DataFrame:
    encoded = corpus.encode_by_join(t.words, t.vocab, t.vocab_rows)
    return encoded.select("doc_id", "line", F.posexplode("ids").alias("pos", "word_id"))


@query
def join_eval_words(t: Inputs) -> DataFrame:
    return t.counts.join(t.eval_words, "word", "left_semi")


@query
def skipgram_pairs(t: Inputs) -> DataFrame:
    all_pairs = pairs.skipgram_pairs(t.encoded, WINDOW)
    distance = F.sum(F.abs(F.col("pos") - F.col("ctx_pos")))
    return all_pairs.groupBy("word_id", "ctx_id").agg(F.count("*").alias("n_pairs"), distance.alias("distance"))


@query
def expand_senses(t: Inputs) -> DataFrame:
    tokens = t.encoded.select(F.explode("ids").alias("word_id"))
    tokens = tokens.withColumn("n_senses", corpus.sense_number(F.col("word_id"), t.cuts))
    return pairs.expand_senses(tokens).groupBy("word_id", "sense").agg(F.count("*").alias("n_tokens"))


@query
def lookup_embeddings(t: Inputs) -> DataFrame:
    """Input rows of all tokens, and their output rows, of which a word has one."""
    tokens = cut(t.coded.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n")))  # read twice
    outputs = tokens.groupBy(objective.output_code(F.col("code"), t.objective()).cast("bigint").alias("code")).agg(F.sum("n").alias("n"))
    codes = tokens.withColumn("mat", F.lit(objective.INPUT)).unionByName(outputs.withColumn("mat", F.lit(objective.OUTPUT)))
    return _dims(codes.join(objective.with_codes(t.model), ["mat", "code"]), "mat", "code", "n")


@query
def cross_similarity(t: Inputs) -> DataFrame:
    first = t.vectors.groupBy("sense").agg(F.min_by(F.struct("word", "vec"), "vec_id").alias("f"))
    queries = first.select(tx.sense_key(F.col("f.word"), F.col("sense")).alias("query"), "f.vec")
    return _rounded(neighbors.cross_similarity(t.vectors, queries, EMBEDDING_DIM), "sim")


@query
def zip_series(t: Inputs) -> DataFrame:
    labels = t.table("labels").select("doc_id", F.col("quality").cast("double").alias("y"))
    chars = t.table("documents").select("doc_id", F.col("n_chars").cast("double").alias("x"))
    chars = chars.join(labels.select("doc_id"), "doc_id", "left_semi")
    x, _ = ordering.number_rows(chars, "doc_id", column="idx")
    y, _ = ordering.number_rows(labels, "doc_id", column="idx")
    return similarity.zip_series(x, y)


# --- windows ----------------------------------------------------------------------


@query
def context_window(t: Inputs) -> DataFrame:
    return pairs.context_window(t.encoded, WINDOW).select(
        "doc_id", "line", "pos", "word_id",
        F.when(F.size("context") > 0, _int_list(F.col("context"))).alias("context"),
    )


@query
def sort_word_index(t: Inputs) -> DataFrame:
    return t.vocab.select("word_id", "word").orderBy("word_id")


@query
def top_k_neighbors(t: Inputs) -> DataFrame:
    queries = neighbors.keyed(t.vectors).select(F.col("key").alias("query"), "vec")
    return _rounded(neighbors.top_k_neighbors(t.vectors, queries, TOP, EMBEDDING_DIM), "sim")


@query
def distinct_neighbors(t: Inputs) -> DataFrame:
    return neighbors.distinct_neighbors(t.eval_neighbors)


# --- vector expressions -----------------------------------------------------------


def _value(df: DataFrame, value: Column) -> DataFrame:
    return df.select("id", F.round(value, 6).alias("value"))


@query
def vec_dot(t: Inputs) -> DataFrame:
    return _value(t.two, fv.dot(F.col("a"), F.col("b")))


@query
def vec_norm(t: Inputs) -> DataFrame:
    return _value(t.table("embeddings").withColumnRenamed("vec_id", "id"), fv.norm(F.col("embedding")))


@query
def vec_distance(t: Inputs) -> DataFrame:
    return _value(t.two, fv.distance(F.col("a"), F.col("b")))


@query
def vec_cosine(t: Inputs) -> DataFrame:
    return _value(t.two, fv.cosine(F.col("a"), F.col("b")))


@query
def vec_angle(t: Inputs) -> DataFrame:
    return _value(t.two, fv.angle(F.col("a"), F.col("b")))


def _embedding_dims(t: Inputs, vec: Column) -> DataFrame:
    return _dims(t.table("embeddings").select(F.col("vec_id").alias("id"), vec.alias("vec")), "id")


@query
def vec_normalize(t: Inputs) -> DataFrame:
    return _embedding_dims(t, fv.normalize(F.col("embedding")))


@query
def vec_limit_length(t: Inputs) -> DataFrame:
    longer = fv.scale(F.col("embedding"), 1 + F.col("vec_id") % 5)
    return _embedding_dims(t, fv.limit_length(longer, 2.5))


@query
def vec_set_length(t: Inputs) -> DataFrame:
    return _embedding_dims(t, fv.set_length(F.col("embedding"), 3.0))


@query
def vec_between(t: Inputs) -> DataFrame:
    return _dims(t.two.select("id", fv.between(F.col("a"), F.col("b"), 0.25).alias("vec")), "id")


@query
def vec_elementwise(t: Inputs) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    parts = F.arrays_zip(
        fv.add(a, b).alias("plus"), fv.subtract(a, b).alias("minus"), fv.multiply(a, b).alias("times"), fv.scale(a, 2.5).alias("scaled")
    )
    rows = t.two.select("id", F.posexplode(parts).alias("k", "p")).select("id", "k", "p.*")
    return _rounded(rows, "plus", "minus", "times", "scaled")


@query
def sigmoid(t: Inputs) -> DataFrame:
    return _value(t.two, fl.sigmoid(10 * fv.dot(F.col("a"), F.col("b"))))


@query
def log_softmax(t: Inputs) -> DataFrame:
    scores = t.two.select("id", fv.dot(F.col("a"), F.col("b")).alias("x"), F.col("a").cast("array<double>").alias("others"))
    x, others = F.col("x"), F.col("others")
    rows = scores.select(
        "id", fl.log_softmax(x, others).alias("log_p"), fl.softmax_slope(x, others).alias("dx"),
        F.posexplode(fl.softmax_slopes_of_others(x, others)).alias("k", "dy"),
    )
    return _rounded(rows, "log_p", "dx", "dy")


# --- vector tables ----------------------------------------------------------------


@query
def vector_sum(t: Inputs) -> DataFrame:
    return _dims(vector_table.vector_sum(t.table("embeddings"), ["label"], "embedding", EMBEDDING_DIM), "label")


@query
def vector_mean(t: Inputs) -> DataFrame:
    return _dims(vector_table.vector_mean(t.table("embeddings"), ["label"], "embedding", EMBEDDING_DIM), "label")


@query
def center_vectors(t: Inputs) -> DataFrame:
    rows = t.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return _dims(vector_table.center_vectors(rows, "vec", EMBEDDING_DIM), "id")


@query
def pairwise_cosine(t: Inputs) -> DataFrame:
    return _rounded(vector_table.pairwise_cosine(t.table("embeddings"), "vec_id", "embedding", t.vector_rows), "value")


@query
def gram_matrix(t: Inputs) -> DataFrame:
    return _rounded(vector_table.gram_matrix(t.table("embeddings"), "vec_id", "embedding", t.vector_rows), "value")


# --- model ------------------------------------------------------------------------


@query
def init_random(t: Inputs) -> DataFrame:
    return _dims(model.init_random(t.vocab, DIM, SEED), "mat", "word_id", "sense", digits=7)


@query
def init_zero(t: Inputs) -> DataFrame:
    zero = model.init_zero(t.vocab, DIM)
    return zero.select("mat", "word_id", "sense", F.size("vec").alias("width"), fv.total(F.col("vec")).alias("total"))


@query
def init_from_model(t: Inputs) -> DataFrame:
    """The stored model has the first two senses and lacks every third word."""
    path = t.scratch("stored")
    rows = writers.named_rows(t.model, t.vocab, objective.INPUT)
    known = rows.where((F.col("word_id") % 3 != 2) & (F.col("sense") < 2))
    writers.write_sense_vectors(known, path, "word_id", "sense")
    stored = cut(readers.read_sense_vectors(t.spark, path))
    model.check_stored(t.vocab, stored, DIM)
    started = model.init_from_vectors(t.vocab, stored, objective.INPUT, DIM, SEED)
    return _dims(started, "word_id", "sense")


# --- objective --------------------------------------------------------------------


def _per_word_sense(losses: DataFrame, *extra: Column) -> DataFrame:
    grouped = losses.groupBy(F.col("in_code").alias("code")).agg(
        F.count("*").alias("n_pairs"), *extra, F.round(F.sum("loss"), 4).alias("loss"), F.round(F.max("loss"), 6).alias("worst")
    )
    word, sense = corpus.word_of(F.col("code")), corpus.sense_of(F.col("code"))
    return grouped.select(word.alias("word_id"), sense.alias("sense"), *[c for c in grouped.columns if c != "code"])


@query
def sgns_pair_loss(t: Inputs) -> DataFrame:
    losses = score_table.pair_loss(t.with_negatives, t.model, t.objective(), t.model_rows, DIM, t.repeated)
    return _per_word_sense(losses, F.sum("n_pred").alias("n_pred"))


@query
def softmax_pair_loss(t: Inputs) -> DataFrame:
    losses = score_table.pair_loss(t.with_negatives, t.model, t.objective(softmax=True), t.model_rows, DIM, t.repeated)
    return _per_word_sense(losses)


@query
def sentence_loss(t: Inputs) -> DataFrame:
    losses = score_table.sentence_loss(t.with_negatives, t.model, t.objective(), t.model_rows, DIM)
    return _rounded(losses, "loss", digits=4)


@query
def assign_senses(t: Inputs) -> DataFrame:
    tokens = t.assigned.select("doc_id", "line", F.posexplode("codes").alias("pos", "code"))
    word, sense = corpus.word_of(F.col("code")), corpus.sense_of(F.col("code"))
    several = corpus.sense_number(word, t.cuts) > 1
    return tokens.where(several).select("doc_id", "line", "pos", word.alias("word_id"), sense.alias("sense"))


@query
def assign_senses_sweeps(t: Inputs) -> DataFrame:
    """Outputs with senses of their own: positions depend on each other."""
    two_sided = model.init_random(t.vocab, DIM, SEED, False, MODEL_SCALE, MODEL_SCALE)
    noisy = sampling.with_negatives(t.coded, t.unigram, t.vocab_rows, N_NEG, t.cuts, False, SEED)
    assigned = objective.assign_senses(noisy, two_sided, t.objective(one_sense_output=False), t.buckets, SEED)
    return assigned.select("doc_id", "line", _int_list(F.col("codes")).alias("codes"), "n_adjust")


def _gradient_rows(grads: DataFrame) -> DataFrame:
    word, sense = corpus.word_of(F.col("code")), corpus.sense_of(F.col("code"))
    rows = grads.select("mat", word.alias("word_id"), sense.alias("sense"), "vec")
    return _dims(rows, "mat", "word_id", "sense", digits=4, name="g")


@query
def sgns_gradient(t: Inputs) -> DataFrame:
    return _gradient_rows(objective.sgns_gradient(t.with_negatives, t.model, t.objective(), t.model_rows, DIM))


@query
def softmax_gradient(t: Inputs) -> DataFrame:
    grads = score_table.softmax_gradient(t.with_negatives, t.model, t.objective(softmax=True), t.model_rows, DIM, t.repeated)
    return _gradient_rows(grads)


def _epoch(t: Inputs, softmax: bool, batch: int = 1) -> DataFrame:
    start = model.init_random(t.vocab, DIM, SEED)
    updates = cut(
        objective.sgd_epoch(t.coded, start, t.objective(softmax=softmax), t.buckets, SEED, 0.05, batch, t.draw)
    )
    summary = updates.where(F.col("mat") == objective.SUMMARY).agg(
        F.sum("loss").alias("loss"), F.sum("n_pred").alias("n_pred"), F.sum("n_tokens").alias("n_tokens")
    )
    trained = model.average_parameters(start, updates, t.buckets, DIM)
    length = F.sum(fv.squared_norm(F.col("vec")))
    totals = trained.groupBy("mat").agg(F.count("*").alias("n_rows"), length.alias("square"))
    return totals.select(
        "mat", "n_rows", F.round("square", 6).alias("square"),
        *[summary.select(c).scalar().alias(c) for c in ("loss", "n_pred", "n_tokens")],
    )


@query
def sgd_epoch_sigmoid(t: Inputs) -> DataFrame:
    return _epoch(t, softmax=False)


@query
def sgd_epoch_softmax(t: Inputs) -> DataFrame:
    return _epoch(t, softmax=True)


@query
def weight_decay(t: Inputs) -> DataFrame:
    chunk = sampling.chunk_of(CHUNKS, SEED)
    share = t.lines.agg(F.avg((chunk == 0).cast("double"))).first()[0]
    return _dims(model.weight_decay(t.model, DECAY, share), "mat", "word_id", "sense")


@query
def limit_norm(t: Inputs) -> DataFrame:
    return _dims(model.limit_norm(t.model, MAX_SQUARE), "mat", "word_id", "sense", "limited")


@query
def update_sense_probs(t: Inputs) -> DataFrame:
    return _rounded(t.probs, "prob")


@query
def reset_rare_senses(t: Inputs) -> DataFrame:
    plan = cut(senses.reset_plan(t.probs, RARE, SEED))
    changed = senses.reset_rare_senses(t.model, plan, DIM, SEED).where(F.col("mat") == objective.INPUT)
    joined = changed.join(plan, ["word_id", "sense"])
    return _dims(joined, "word_id", "sense", "donor", "is_reset")


@query
def learning_rate_schedule(t: Inputs) -> DataFrame:
    alpha = F.greatest(F.lit(ALPHA) * F.pow(F.lit(GAMMA), F.col("it")), F.lit(training.ALPHA_FLOOR * ALPHA))
    return t.daily.select("it", F.round(alpha, 9).alias("alpha"))


@query
def validate_model(t: Inputs) -> DataFrame:
    """The held-out sentences under their best senses."""
    ratio = sampling.validation_ratio(t.lines.count(), 0.1, 200_000)
    _, held_out = sampling.split_train_validation(t.with_negatives, ratio, SEED)
    held_out = stored(held_out, "held_out")
    assigned = cut(score_table.assign_senses(held_out, t.model, t.objective(), t.model_rows, DIM))
    again = assigned.select("doc_id", "line", "codes").join(held_out.select("doc_id", "line", "negs"), ["doc_id", "line"])
    total = objective.corpus_loss(cut(again), t.model, t.objective(), t.model_rows, DIM)
    result = objective.loss_per_prediction(total).withColumn("adjust_rate", objective.adjust_rate(assigned).select("adjust_rate").scalar())
    return _rounded(result, "loss_per_prediction", "adjust_rate")


@query
def early_stop(t: Inputs) -> DataFrame:
    before = t.daily.select((F.col("it") + 1).alias("it"), F.col("loss").alias("before"))
    rows = t.daily.join(before, "it", "left")
    stop = rows.where(F.col("loss") > F.col("before")).agg(F.min("it").alias("it")).scalar()
    last = F.coalesce(stop, F.col("it") + 1)
    kept = rows.select("it", F.round("loss", 6).alias("vali_loss"), (F.col("it") < last).alias("is_saved"), last.alias("last"))
    return kept.where(F.col("it") <= F.col("last")).drop("last")


def _settings(**changes) -> training.Settings:
    values = {
        "min_count": MIN_COUNT, "thresholds": tuple(THRESHOLDS), "window": WINDOW, "n_neg": N_NEG, "dim": DIM,
        "chunks": 2, "epochs": 1, "alpha": 0.05, "validate_every": 2, "tokens_per_bucket": TOKENS_PER_BUCKET, "seed": SEED,
    }
    return training.Settings(**{**values, **changes})


def _fit_report(t: Inputs, fitted: training.Fit) -> DataFrame:
    """What a run did, iteration by iteration; its losses depend on the order of SGD and
    are checked in the tests."""
    table = fitted.history_table(t.spark).select("it", "alpha", "n_sentences", "n_tokens", "saved")
    return _rounded(table, "alpha", digits=9)


@query
def fit_one_sense(t: Inputs) -> DataFrame:
    return _fit_report(t, training.fit_one_sense(t.lines, _settings()))


@query
def fit_multi_sense(t: Inputs) -> DataFrame:
    first = training.fit_one_sense(t.lines, _settings())
    path = t.scratch("one_sense")
    training.save(first, path)
    settings = _settings()
    return _fit_report(t, training.fit_multi_sense(t.lines, settings, training.stored_start(t.spark, path, settings)))


@query
def resume_fit(t: Inputs) -> DataFrame:
    settings = _settings(chunks=1, validate_every=1)
    first, second, third = t.scratch("first"), t.scratch("second"), t.scratch("third")
    training.run_stages(t.lines, settings, "1_0", first, second)
    return _fit_report(t, training.run_stages(t.lines, settings, "R1_0", third, second, resume_from=first))


# --- queries on vectors -----------------------------------------------------------


@query
def get_vector(t: Inputs) -> DataFrame:
    keys = t.eval_queries.select(F.col("query").alias("key"))
    return _dims(neighbors.get_vector(t.inputs, keys), "key")


@query
def sense_similarity_matrix(t: Inputs) -> DataFrame:
    return _rounded(neighbors.sense_similarity_matrix(t.inputs), "sim")


@query
def neighbors_report(t: Inputs) -> DataFrame:
    terms = t.vocab.join(t.eval_words, "word", "left_semi").select(F.col("word").alias("term"))
    return _rounded(neighbors.neighbors_report(t.inputs, terms, TOP, DIM), "sim")


@query
def avg_sim(t: Inputs) -> DataFrame:
    joined = similarity.with_senses(t.known_pairs, t.inputs, t.model_rows, DIM)
    return _rounded(similarity.avg_sim(joined), "score")


@query
def max_sim(t: Inputs) -> DataFrame:
    joined = similarity.with_senses(t.known_pairs, t.inputs, t.model_rows, DIM)
    return _rounded(similarity.max_sim(joined), "score")


@query
def pair_similarity_job(t: Inputs) -> DataFrame:
    """Words written in capitals where they are plain letters."""
    capitals = F.when(F.col("word1").rlike("^[a-z]+$"), F.upper("word1")).otherwise(F.col("word1"))
    written = t.known_pairs.withColumn("word1", capitals)
    return _rounded(similarity.pair_similarity_job(written, t.inputs, t.model_rows, DIM), "score")


@query
def disambiguate_in_context(t: Inputs) -> DataFrame:
    parts = []
    for side in (1, 2):
        occurrence = t.context_pairs.select("id", F.col(f"word{side}").alias("word"), F.col(f"context{side}").alias("context"))
        chosen = similarity.disambiguate_in_context(occurrence, t.inputs, t.outputs, t.model_rows, DIM)
        parts.append(chosen.select("id", F.lit(side).alias("side"), "word", "sense"))
    return parts[0].union(parts[1])


@query
def contextual_similarity(t: Inputs) -> DataFrame:
    return _rounded(similarity.contextual_similarity(t.context_pairs, t.inputs, t.outputs, t.model_rows, DIM), "score")


@query
def pearson_correlation(t: Inputs) -> DataFrame:
    labels = t.table("labels").select("doc_id", F.col("quality").cast("double").alias("y"))
    both = t.table("documents").select("doc_id", F.col("n_chars").cast("double").alias("x")).join(labels, "doc_id")
    return _rounded(similarity.pearson_correlation(both), "r")


@query
def evaluate_similarity(t: Inputs) -> DataFrame:
    """The rating of a pair is here the difference of the word lengths."""
    rated = t.pair_scores.withColumn("rating", F.abs(F.length("word1") - F.length("word2")).cast("double"))
    return rated.agg(F.round(F.corr("score", "rating"), 6).alias("r"), F.count("*").alias("n_pairs"))


# --- map --------------------------------------------------------------------------


@query
def tsne_affinity(t: Inputs) -> DataFrame:
    return _rounded(t.affinity.table(), "p", digits=9)


@query
def tsne_similarity(t: Inputs) -> DataFrame:
    return _rounded(_rounded(tsne.similarity(t.coords, t.vector_rows), "num"), "q", digits=9)


@query
def tsne_gradient(t: Inputs) -> DataFrame:
    return _dims(t.map_gradient, "i", vec="grad", digits=9, name="g")


@query
def tsne_update(t: Inputs) -> DataFrame:
    inc = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda k: uniform(SEED, "inc", F.col("i"), k) - 0.5)
    state = tsne.start_state(t.coords, 2).withColumn("inc", inc)
    moved = tsne.update(state, t.map_gradient, tsne.FIRST_MOMENTUM)
    rows = moved.select("i", F.posexplode(F.arrays_zip("y", "inc", "gain")).alias("k", "s")).select("i", "k", "s.*")
    return _rounded(rows, "y", "inc")


@query
def tsne_fit(t: Inputs) -> DataFrame:
    return _dims(tsne.fit(t.affinity, t.vector_rows, seed=SEED), "i", vec="y", name="y", digits=9)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Inputs(spark, sf_dir))) for name, f in QUERIES.items()}
