"""Training: corpus -> vocabulary -> one-sense model -> multi-sense model.

The driver loops over iterations and holds numbers only (learning rate, losses,
counts). Corpus, model, probabilities and updates are tables; each iteration
cuts its lineage into the shared folder.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polysem.operators import corpus, model, objective, sampling, senses, vocabulary
from polysem.operators.kernels import Objective
from polysem.plans.manifest import Manifest, State
from polysem.session import cut, spread, stored
from polysem.sources import readers, writers

# Fixed values.
ALPHA_FLOOR = 1e-4


@dataclass(frozen=True)
class Settings:
    min_count: int = 200
    thresholds: tuple[int, ...] = (2000, 10000)
    window: int = 5
    n_neg: int = 10
    dim: int = 200
    chunks: int = 20
    epochs: int = 5
    alpha: float = 0.1
    gamma: float = 0.9
    seed: int = 42
    validation_ratio: float = 0.1
    max_validation: int = 200_000
    validate_every: int = 5
    max_squared_norm: float = 15.0
    min_prob: float = 0.02
    weight_decay: float = 0.1
    one_sense_output: bool = True
    softmax: bool = False
    # Tokens per bucket of one SGD pass; one bucket is one task and one of the
    # models that are averaged. With its negatives a bucket touches at most
    # (1 + n_neg) rows per token and matrix.
    tokens_per_bucket: int = 100_000
    # Number of buckets; 0 derives it from tokens_per_bucket.
    buckets: int = 0
    # Pairs per SGD step; 1 is plain sequential SGD.
    batch: int = 1
    # Rows of the unigram distribution etc. follow the vocabulary, not these.


@dataclass
class Fit:
    """A trained model and what is needed to use or resume it."""

    settings: Settings
    vocab: DataFrame
    vocab_rows: int
    cuts: list[int]
    model: DataFrame
    probs: DataFrame | None
    history: list[dict] = field(default_factory=list)

    def history_table(self, spark: SparkSession) -> DataFrame:
        schema = (
            "it int, alpha double, n_sentences bigint, train_loss double, n_tokens bigint, vali_loss double, vali_adjust double, "
            "n_limited bigint, n_reset bigint, saved boolean"
        )
        names = [part.split()[0] for part in schema.split(", ")]
        return spark.createDataFrame([tuple(h.get(n) for n in names) for h in self.history], schema)

    def vectors(self, mat: int = objective.INPUT) -> DataFrame:
        return writers.named_rows(self.model, self.vocab, mat).select("word", "sense", "vec")


def learning_rate(alpha0: float, gamma: float, iteration: int) -> float:
    """Falls after every iteration, down to a floor."""
    return max(alpha0 * gamma**iteration, ALPHA_FLOOR * alpha0)


def must_stop(losses: list[float]) -> bool:
    """The last validation was worse than the one before, or no number at all."""
    if losses and math.isnan(losses[-1]):
        return True
    return len(losses) > 1 and losses[-1] > losses[-2]


@dataclass(frozen=True)
class Stage:
    epochs: int
    resume: bool


def parse_epochs(spec: str) -> tuple[Stage, Stage]:
    """'5_10': epochs with one sense, then with several. An R before a number
    continues from the stored model of that stage; then the other stage must be
    absent (multi-sense resumed) or start anew (one-sense resumed)."""
    parts = spec.split("_")
    if len(parts) != 2:
        raise ValueError(f"{spec}: must be two parts separated by _")
    one, many = (Stage(int(p.removeprefix("R")), p.startswith("R")) for p in parts)
    if one.resume and (one.epochs <= 0 or many.resume):
        raise ValueError(f"{spec}: only one stage can be resumed and it needs epochs")
    if many.resume and (one.epochs != 0 or many.epochs <= 0):
        raise ValueError(f"{spec}: a resumed multi-sense stage must be the only one and needs epochs")
    return one, many


class _Corpus:
    """Encoded training and validation sets of one fit."""

    def __init__(self, lines: DataFrame, s: Settings, one_sense: bool, eval_words: DataFrame | None):
        n = lines.count()
        ratio = sampling.validation_ratio(n, s.validation_ratio, s.max_validation)
        words = corpus.word_sentences(lines)
        train, held_out = sampling.split_train_validation(words, ratio, s.seed)
        counts = vocabulary.word_count(train)
        thresholds = [] if one_sense else list(s.thresholds)
        self.vocab, self.vocab_rows = vocabulary.build_vocab(counts, s.min_count, thresholds, eval_words)
        if self.vocab_rows == 0:
            raise ValueError("the vocabulary is empty: min_count may be too large")
        self.cuts = vocabulary.sense_cuts(self.vocab, len(thresholds) + 1)
        self.unigram = cut(vocabulary.unigram_distribution(self.vocab))
        self.objective = Objective(s.window, s.n_neg, tuple(self.cuts), s.one_sense_output, s.softmax)

        def coded(part: DataFrame) -> DataFrame:
            encoded = corpus.encode(part, self.vocab, self.vocab_rows)
            return corpus.random_senses(encoded, self.cuts, s.seed)

        chunked = coded(train).withColumn("chunk", sampling.chunk_of(s.chunks, s.seed))
        table = stored(chunked, "corpus", "chunk")
        sizes = table.groupBy("chunk").agg(F.count("*").alias("n"), F.sum(F.size("codes")).alias("t")).collect()
        self.sentences = {r["chunk"]: r["n"] for r in sizes}
        self.tokens = {r["chunk"]: r["t"] for r in sizes}
        self.chunks = {c: table.where(F.col("chunk") == c).drop("chunk") for c in range(s.chunks)}
        self.held_out = cut(self.with_negatives(coded(held_out), s, "vali"))
        vali = self.held_out.agg(F.count("*").alias("n"), F.sum(F.size("codes")).alias("t")).first()
        self.vali_sentences, self.vali_tokens = vali["n"], vali["t"] or 0

    def with_negatives(self, coded: DataFrame, s: Settings, purpose: str) -> DataFrame:
        return sampling.with_negatives(
            coded, self.unigram, self.vocab_rows, s.n_neg, self.cuts, s.one_sense_output, s.seed, purpose
        )


def bucket_count(tokens: int, s: Settings) -> int:
    """Enough buckets to keep each one small. As it is the number of averaged
    models too, it follows the corpus and the settings and not the cluster."""
    return s.buckets or max(math.ceil(tokens / s.tokens_per_bucket), 1)


def fit(
    lines: DataFrame, s: Settings, one_sense: bool, initial: Callable[[DataFrame], DataFrame] | None = None,
    eval_words: DataFrame | None = None, on_save: Callable[[Fit], None] | None = None, manifest: str | None = None,
) -> Fit:
    """Train one stage on lines (doc_id, line, text). `initial(vocab)` gives the
    starting model; without it the start is random. With `manifest`, a folder, every
    iteration leaves there what is needed to go on after it, and a run that finds
    such a folder of the same settings goes on where that one ended."""
    lines = spread(lines, "doc_id", "line")
    data = _Corpus(lines, s, one_sense, eval_words)
    log = Manifest(lines.sparkSession, manifest, f"{s} one_sense={one_sense}") if manifest else None
    state = log.last() if log else State()
    if state.it >= 0:
        params, probs = log.table(state.model), log.table(state.probs) if state.probs else None
        data.chunks.update({c: log.table(p) for c, p in state.chunks.items()})
        data.held_out = log.table(state.held_out) if state.held_out else data.held_out
    else:
        params = cut(initial(data.vocab) if initial else model.init_random(data.vocab, s.dim, s.seed, s.one_sense_output))
        probs = None if one_sense else cut(senses.uniform_sense_probs(data.vocab))
    result = Fit(s, data.vocab, data.vocab_rows, data.cuts, params, probs, state.history)
    if state.best:
        result.model, result.probs = log.table(state.best), log.table(state.best_probs) if state.best_probs else None
    all_sentences = sum(data.sentences.values())
    losses = state.losses
    iterations = s.epochs * s.chunks
    for it in range(state.it + 1, iterations):
        if must_stop(losses):
            break
        chunk = it % s.chunks
        row = {"it": it, "alpha": learning_rate(s.alpha, s.gamma, it), "saved": False}
        n_tokens, n_sentences = data.tokens.get(chunk, 0), data.sentences.get(chunk, 0)
        row["n_sentences"] = n_sentences
        buckets = bucket_count(n_tokens, s)
        if not one_sense:
            # negatives are drawn where they are read: stored, they are several times the corpus
            noisy = data.with_negatives(data.chunks[chunk], s, f"assign{it}")
            assigned = cut(objective.assign_senses(noisy, params, data.objective, buckets, s.seed))
            data.chunks[chunk] = assigned.select("doc_id", "line", "codes")
            counts = objective.token_sense_counts(assigned)
            probs = senses.update_sense_probs(probs, counts)
            plan = cut(senses.reset_plan(probs, s.min_prob, s.seed + it))
            probs = plan.select("word_id", "sense", "prob")
            row["n_reset"] = plan.where("is_reset").count()
            params = senses.reset_rare_senses(params, plan, s.dim, s.seed + it, s.one_sense_output)
            params = cut(params) if row["n_reset"] else params
        draw = partial(data.with_negatives, s=s, purpose=f"train{it}")
        updates = cut(
            objective.sgd_epoch(data.chunks[chunk], params, data.objective, buckets, s.seed + it, row["alpha"], s.batch, draw)
        )
        seen = updates.where(F.col("mat") == objective.SUMMARY).agg(
            (F.sum("loss") / F.sum("n_pred")).alias("loss"), F.sum("n_tokens").alias("n")
        ).first()
        row["train_loss"], row["n_tokens"] = seen["loss"], seen["n"]
        params = model.average_parameters(params, updates, buckets, s.dim)
        params = model.weight_decay(params, s.weight_decay, n_sentences / max(all_sentences, 1))
        limited = cut(model.limit_norm(params, s.max_squared_norm))
        row["n_limited"] = limited.where("limited").count()
        params = model.as_floats(limited)
        if (it + 1) % s.validate_every == 0 or it + 1 == iterations:
            row["vali_loss"], row["vali_adjust"] = validate(data, params, s, one_sense)
            losses.append(row["vali_loss"])
            row["saved"] = not must_stop(losses)
        if log:
            params, probs = _remember(log, state, it, params, probs, data, chunk, row, one_sense)
        if row["saved"]:
            result.model, result.probs = params, probs
        result.history.append(row)
        if row["saved"] and on_save is not None:
            on_save(result)
        if log:
            log.record(state)
    return result


def _remember(
    log: Manifest, state: State, it: int, params: DataFrame, probs: DataFrame | None, data: _Corpus, chunk: int, row: dict,
    one_sense: bool,
) -> tuple[DataFrame, DataFrame | None]:
    """Write what iteration `it` made, tell `state` where, and read it back."""
    folder = log.folder(it)
    state.it, state.model = it, log.write(params, f"{folder}/model")
    if not one_sense:
        state.probs = log.write(probs, f"{folder}/probs")
        state.chunks[chunk] = log.write(data.chunks[chunk], f"{folder}/codes")
        data.chunks[chunk], probs = log.table(state.chunks[chunk]), log.table(state.probs)
        if "vali_loss" in row:
            state.held_out = log.write(data.held_out, f"{folder}/held_out")
    if row["saved"]:
        state.best, state.best_probs = state.model, state.probs
    return log.table(state.model), probs


def validate(data: _Corpus, params: DataFrame, s: Settings, one_sense: bool) -> tuple[float, float]:
    """Loss per prediction of the held-out set under its best senses, and how
    many sweeps per sentence changed a sense. Its negatives never change."""
    buckets = bucket_count(data.vali_tokens, s)
    rate = 0.0
    if not one_sense:
        assigned = cut(objective.assign_senses(data.held_out, params, data.objective, buckets, s.seed))
        rate = objective.adjust_rate(assigned).first()["adjust_rate"] or 0.0
        negs = data.held_out.select("doc_id", "line", "negs")
        data.held_out = cut(assigned.select("doc_id", "line", "codes").join(negs, ["doc_id", "line"]))
    losses = objective.sentence_loss(data.held_out, params, data.objective, buckets, s.seed)
    loss = objective.loss_per_prediction(losses).first()["loss_per_prediction"]
    return (float("nan") if loss is None else loss), rate


# --- stages and stored models ----------------------------------------------------


def save(result: Fit, path: str) -> None:
    """Write a model folder: word index, both matrices, the input vectors as
    word2vec text, and the history."""
    spark = result.model.sparkSession
    writers.write_word_index(result.vocab, f"{path}/word_index")
    for mat, name in ((objective.INPUT, "input"), (objective.OUTPUT, "output")):
        rows = writers.named_rows(result.model, result.vocab, mat)
        writers.write_sense_vectors(rows, f"{path}/{name}", "word_id", "sense")
    writers.write_w2v_text(result.vectors(), result.settings.dim, f"{path}/w2v")
    writers.write_history(result.history_table(spark), f"{path}/history")


def saver(path: str) -> Callable[[Fit], None]:
    """Saves a model that validated well in a folder of its own while training
    goes on. A folder counts once it is listed in `index`, after all of it is
    written, so an interrupted save leaves the one before in force."""

    def write(result: Fit) -> None:
        it = result.history[-1]["it"]
        folder = f"{path}/it{it:05d}-{uuid.uuid4().hex[:8]}"
        save(result, folder)
        row = [(it, folder)]
        result.model.sparkSession.createDataFrame(row, "it int, folder string").write.mode("append").parquet(f"{path}/index")

    return write


def last_saved(spark: SparkSession, path: str) -> str:
    """The folder of the last complete save under `path`."""
    return spark.read.parquet(f"{path}/index").orderBy(F.desc("it")).first()["folder"]


def stored_start(spark: SparkSession, path: str, s: Settings) -> Callable[[DataFrame], DataFrame]:
    """The initial model read from a model folder."""

    def initial(vocab: DataFrame) -> DataFrame:
        parts = []
        for mat, name in ((objective.INPUT, "input"), (objective.OUTPUT, "output")):
            rows = cut(readers.read_sense_vectors(spark, f"{path}/{name}"))
            model.check_stored(vocab, rows, s.dim)
            one = mat == objective.OUTPUT and s.one_sense_output
            parts.append(model.init_from_vectors(vocab, rows, mat, s.dim, s.seed, one_sense=one))
        return parts[0].unionByName(parts[1])

    return initial


def fit_one_sense(lines: DataFrame, s: Settings, eval_words: DataFrame | None = None) -> Fit:
    return fit(lines, s, one_sense=True, eval_words=eval_words)


def fit_multi_sense(
    lines: DataFrame, s: Settings, start: Callable[[DataFrame], DataFrame], eval_words: DataFrame | None = None
) -> Fit:
    return fit(lines, s, one_sense=False, initial=start, eval_words=eval_words)


def run_stages(
    lines: DataFrame, s: Settings, spec: str, one_sense_path: str, multi_sense_path: str,
    eval_words: DataFrame | None = None, resume_from: str | None = None, resumable: bool = False,
) -> Fit | None:
    """Both stages as `spec` says. Results go to new folders, and while a stage
    runs, every model that validated well to a folder under `<path>_saved`;
    `resume_from` is the stored model a resumed stage starts from (after a
    failure `last_saved` of that path). With `resumable` a stage that was killed goes on at
    the same iteration when the call is repeated (manifest in `<path>_run`). A multi-sense stage that is
    not resumed starts from the one-sense model at `one_sense_path`."""
    spark = lines.sparkSession
    one, many = parse_epochs(spec)
    if (one.resume or many.resume) and resume_from is None:
        raise ValueError(f"{spec}: which stored model to resume?")
    result = None
    if one.epochs:
        start = stored_start(spark, resume_from, s) if one.resume else None
        result = fit(lines, replace(s, epochs=one.epochs), True, start, eval_words, saver(f"{one_sense_path}_saved"), f"{one_sense_path}_run" if resumable else None)
        save(result, one_sense_path)
    if many.epochs:
        start = stored_start(spark, resume_from if many.resume else one_sense_path, s)
        result = fit(lines, replace(s, epochs=many.epochs), False, start, eval_words, saver(f"{multi_sense_path}_saved"), f"{multi_sense_path}_run" if resumable else None)
        save(result, multi_sense_path)
    return result
