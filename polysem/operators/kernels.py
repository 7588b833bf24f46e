"""NumPy kernels for one bucket of sentences.

Spark partitions the corpus into buckets of bounded size and brings each bucket
the model rows it touches; the functions here only do the arithmetic that is
sequential (SGD, in-place sweeps) or too dense to explode into rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from polysem.operators.corpus import ENCODE

# Fixed values.
MAX_SWEEPS = 10
# Times alpha: how often one row may be hit on values from before a step. With
# squared lengths up to 15 the score slope stays below 2.
STEP_LIMIT = 0.5
# Tokens evaluated at a time: bounds the memory of gathered vectors.
BLOCK = 8192
# Bytes of the row copies of buckets that are trained side by side (more than those at once only for
# one bucket), and the steps that are
# laid out at a time.
SIDE_BYTES = 1 << 28
STEPS = 2048


@dataclass(frozen=True)
class Objective:
    """What is being optimised."""

    window: int = 5
    n_neg: int = 5
    cuts: tuple[int, ...] = ()  # words with at least 2, 3, ... senses
    one_sense_output: bool = True
    softmax: bool = False

    def sense_numbers(self, words: np.ndarray) -> np.ndarray:
        n = np.ones(len(words), dtype=np.int64)
        for bound in self.cuts:
            n += words < bound
        return n

    def output_codes(self, codes: np.ndarray) -> np.ndarray:
        return codes // ENCODE * ENCODE if self.one_sense_output else codes


class Rows:
    """Model rows of one matrix, addressed by word-sense code. Vectors stay as they are
    stored, FLOAT or DOUBLE; `take` gives them as DOUBLE."""

    def __init__(self, codes: np.ndarray, vectors: np.ndarray):
        order = np.argsort(codes, kind="stable")
        self.codes, self.vectors = codes[order], vectors[order]
        self.first = self._first_rows()

    def _first_rows(self) -> np.ndarray | None:
        """The first row of every word and the end, if there are all words and all senses up
        to the last of each; then a code's row is known without a search."""
        words = self.codes // ENCODE
        if not len(words) or words[0] != 0 or words[-1] >= len(words):
            return None
        first = np.searchsorted(words, np.arange(words[-1] + 2)).astype(np.int32)
        whole = (self.codes == words * ENCODE + np.arange(len(words)) - first[words]).all() and (np.diff(first) > 0).all()
        return first if whole else None

    def take(self, at: np.ndarray) -> np.ndarray:
        return self.vectors.take(at, 0).astype(np.float64, copy=False)

    def index(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            if codes.size:
                raise ValueError(f"no model row for code {codes.flat[0]}")
            return np.zeros(codes.shape, dtype=np.int64)
        if self.first is None:
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        else:
            words = np.clip(codes // ENCODE, 0, len(self.first) - 2)
            at = np.clip(self.first[words] + (codes - words * ENCODE), 0, len(self.codes) - 1)
        missing = self.codes[at] != codes
        if missing.any():
            raise ValueError(f"no model row for code {codes[missing].flat[0]}")
        return at


def rows_of(table: pa.Table, mat: int, dtype=np.float64) -> Rows:
    """`dtype` None: as they are stored."""
    chosen = table.filter(pc.equal(table["mat"], mat)).combine_chunks()
    vectors = chosen["vec"].combine_chunks().flatten().to_numpy()
    vectors = vectors if dtype is None else vectors.astype(dtype)
    return Rows(chosen["code"].to_numpy(), vectors.reshape(chosen.num_rows, len(vectors) // max(chosen.num_rows, 1)))


class Bucket:
    """Sentences of one bucket in key order, flattened to arrays; with a column `bucket`,
    those of several buckets one after the other."""

    def __init__(self, table: pa.Table, objective: Objective):
        keys = [c for c in ("bucket", "doc_id", "line") if c in table.column_names]
        table = table.sort_by([(c, "ascending") for c in keys]).combine_chunks()
        lists = table["codes"].combine_chunks()
        self.table, self.objective = table, objective
        lengths = lists.value_lengths().to_numpy()
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        self.codes = lists.flatten().to_numpy().copy()
        self.n = len(self.codes)
        self.sentence = np.repeat(np.arange(len(lengths)), lengths)
        negs = table["negs"].combine_chunks().flatten().flatten().to_numpy()
        # a vocabulary of one word has no negatives, whatever was asked for
        self.negs = negs.reshape(self.n, len(negs) // max(self.n, 1))
        self.predictions = 1 if objective.softmax else 1 + self.negs.shape[1]

    @property
    def parts(self) -> list[tuple[int, int]]:
        """First and last + 1 token of each bucket."""
        if "bucket" not in self.table.column_names:
            return [(0, self.n)]
        numbers = self.table["bucket"].to_numpy()
        first = np.flatnonzero(np.diff(numbers, prepend=-1))
        ends = self.starts[np.append(first, len(numbers))]
        return [(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def output_codes(self) -> np.ndarray:
        return self.objective.output_codes(self.codes)

    def pos(self) -> np.ndarray:
        return np.arange(self.n) - self.starts[self.sentence]

    def offsets(self):
        w = self.objective.window
        return [d for d in range(-w, w + 1) if d]

    def neighbours(self, at: np.ndarray, d: int):
        """Of the positions `at` those with a neighbour at distance d, as a mask."""
        j = at + d
        inside = (j >= 0) & (j < self.n)
        inside[inside] = self.sentence[at[inside]] == self.sentence[j[inside]]
        return inside, j[inside]

    def lists(self, flat: np.ndarray, kind) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.starts, pa.int32()), pa.array(flat, kind))


def softplus(x: np.ndarray) -> np.ndarray:
    """-log(sigmoid(-x))"""
    return np.log1p(np.exp(-np.abs(x))) + np.maximum(x, 0.0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def pair_scores(v, u, negatives):
    x = np.einsum("md,md->m", v, u)
    y = np.einsum("md,mkd->mk", v, negatives)
    return x, y


def target_scores(v, rows):
    """Scores of the context rows, which are the first, and of the negatives."""
    scores = np.einsum("md,mkd->mk", v, rows)
    return scores[:, 0], scores[:, 1:]


def target_rows(bucket: Bucket, outputs: Rows) -> np.ndarray:
    """For every position its output row as a context, then those of its negatives."""
    return np.column_stack((outputs.index(bucket.output_codes()), outputs.index(bucket.negs)))


def blocks(bucket: Bucket, outputs: Rows, targets: np.ndarray, at: np.ndarray):
    """The ascending positions `at` piece by piece: (first and end within `at`, the first
    position around them, the vectors of the targets of all positions around them). Every
    vector is fetched once for all the distances at which it is met."""
    w = bucket.objective.window
    for a in range(0, bucket.n, BLOCK):
        first, end = np.searchsorted(at, (a, a + BLOCK))
        if first < end:
            lo = max(int(at[first]) - w, 0)
            yield first, end, lo, outputs.take(targets[lo : int(at[end - 1]) + w + 1])


def pair_loss(x: np.ndarray, y: np.ndarray, softmax: bool) -> np.ndarray:
    if not softmax:
        return softplus(-x) + softplus(y).sum(axis=1)
    scores = np.column_stack((x, y))
    top = scores.max(axis=1)
    return top + np.log(np.exp(scores - top[:, None]).sum(axis=1)) - x


def pair_losses(bucket: Bucket, inputs: Rows, outputs: Rows, at: np.ndarray, in_codes: np.ndarray):
    """Yield (positions in `at`, context positions, losses) over all pairs whose
    centre is in `at`, centre k having input code in_codes[k]."""
    in_at = inputs.index(in_codes)
    for first, end, lo, rows in blocks(bucket, outputs, target_rows(bucket, outputs), at):
        here, v = at[first:end], inputs.take(in_at[first:end])
        for d in bucket.offsets():
            inside, j = bucket.neighbours(here, d)
            k = np.flatnonzero(inside)
            x, y = target_scores(v.take(k, 0), rows.take(j - lo, 0))
            yield first + k, j, pair_loss(x, y, bucket.objective.softmax)


def position_losses(bucket: Bucket, inputs: Rows, outputs: Rows, at: np.ndarray, in_codes: np.ndarray):
    """Loss and number of predictions of every position in `at`."""
    loss, count = np.zeros(len(at)), np.zeros(len(at), dtype=np.int64)
    for k, _, values in pair_losses(bucket, inputs, outputs, at, in_codes):
        loss[k] += values
        count[k] += bucket.predictions
    return loss, count


def best_senses(bucket: Bucket, inputs: Rows, outputs: Rows) -> np.ndarray:
    """For every position the sense with the smallest loss, the lowest on ties;
    a position without any comparable loss keeps its sense."""
    words = bucket.codes // ENCODE
    n_senses = bucket.objective.sense_numbers(words)
    chosen = bucket.codes.copy()
    several = np.flatnonzero(n_senses > 1)
    for first, end, lo, rows in blocks(bucket, outputs, target_rows(bucket, outputs), several):
        at = several[first:end]
        having = [np.flatnonzero(n_senses[at] > s) for s in range(int(n_senses[at].max()))]
        codes = [words[at[k]] * ENCODE + s for s, k in enumerate(having)]
        vectors = [inputs.take(inputs.index(c)) for c in codes]
        losses = [np.zeros(len(k)) for k in having]
        for d in bucket.offsets():
            inside, j = bucket.neighbours(at, d)
            around, here = rows.take(j - lo, 0), np.flatnonzero(inside)
            for s, k in enumerate(having):
                # the senses of a word are gone through side by side, so what is around it is fetched once
                met = np.flatnonzero(inside[k])
                near = around if len(met) == len(here) else around.take(np.searchsorted(here, k[met]), 0)
                x, y = target_scores(vectors[s].take(met, 0), near)
                losses[s][met] += pair_loss(x, y, bucket.objective.softmax)
        best = np.full(len(at), np.inf)
        for k, candidate, loss in zip(having, codes, losses, strict=True):
            better = loss < best[k]
            best[k[better]] = loss[better]
            chosen[at[k[better]]] = candidate[better]
    return chosen


def sweep_senses(bucket: Bucket, inputs: Rows, outputs: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Assign senses until nothing changes. Returns the codes and, per
    sentence, the number of sweeps that changed something."""
    objective = bucket.objective
    n_sentences = len(bucket.starts) - 1
    sweeps = np.zeros(n_sentences, dtype=np.int64)
    if objective.one_sense_output:
        # Outputs do not depend on senses, so positions are independent and the
        # first sweep is already the fixed point.
        chosen = best_senses(bucket, inputs, outputs)
        np.maximum.at(sweeps, bucket.sentence, (chosen != bucket.codes).astype(np.int64))
        return chosen, sweeps
    codes = bucket.codes.copy()
    n_senses = objective.sense_numbers(codes // ENCODE)
    neg_at = outputs.index(bucket.negs)
    out_at = outputs.index(objective.output_codes(codes))
    lengths = np.diff(bucket.starts)
    active = np.arange(n_sentences)
    # A position needs a look only if an output around it changed since the last.
    stale = n_senses > 1
    for _ in range(MAX_SWEEPS):
        changed = np.zeros(n_sentences, dtype=bool)
        # Position after position, each for all sentences at once: sentences do
        # not depend on each other, positions of one sentence do.
        for t in range(int(lengths[active].max(initial=0))):
            active_here = active[lengths[active] > t]
            at = bucket.starts[active_here] + t
            at = at[stale[at]]
            if not len(at):
                continue
            stale[at] = False
            chosen = _best_here(bucket, inputs, outputs, at, codes[at], n_senses[at], out_at, neg_at)
            moved = chosen != codes[at]
            if moved.any():
                codes[at[moved]] = chosen[moved]
                out_at[at[moved]] = outputs.index(objective.output_codes(chosen[moved]))
                changed[bucket.sentence[at[moved]]] = True
                for d in bucket.offsets():
                    near = bucket.neighbours(at[moved], d)[1]
                    stale[near] = n_senses[near] > 1
        active = np.flatnonzero(changed)
        sweeps[active] += 1
        if not len(active):
            break
    return codes, sweeps


def _best_here(bucket, inputs, outputs, at, current, n_senses, out_at, neg_at):
    """Best codes of the positions `at` under the outputs as they are now."""
    best, chosen, words = np.full(len(at), np.inf), current.copy(), current // ENCODE
    for sense in range(int(n_senses.max())):
        k = np.flatnonzero(n_senses > sense)
        candidate = words[k] * ENCODE + sense
        v = inputs.take(inputs.index(candidate))
        loss = np.zeros(len(k))
        for d in bucket.offsets():
            inside, j = bucket.neighbours(at[k], d)
            if len(j):
                x, y = pair_scores(v[inside], outputs.take(out_at[j]), outputs.take(neg_at[j]))
                loss[inside] += pair_loss(x, y, bucket.objective.softmax)
        better = loss < best[k]
        best[k[better]] = loss[better]
        chosen[k[better]] = candidate[better]
    return chosen


def segments(at: np.ndarray):
    """Order that brings equal rows together, where each starts, how many."""
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return order, ordered[first], first, np.diff(np.append(first, len(at)))


def segment_sums(values: np.ndarray, first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows. Most segments are short, so the k-th rows of
    all segments are added at once, and only long segments one by one."""
    sums = values[first]
    k, longer = 1, np.flatnonzero(times > 1)
    while len(longer) and k < 4:
        sums[longer] += values[first[longer] + k]
        k += 1
        longer = longer[times[longer] > k]
    for q in longer:
        sums[q] += values[first[q] + k : first[q] + times[q]].sum(axis=0)
    return sums


def scatter_add(target: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """target[at] += values, adding up repeated rows."""
    width = target.shape[1]
    places = (at[:, None] * width + np.arange(width)).ravel()
    np.add.at(target.reshape(-1, copy=False), places, values.ravel())


def pair_slopes(x: np.ndarray, y: np.ndarray, softmax: bool):
    """Derivatives of the pair loss with respect to the scores."""
    if not softmax:
        return sigmoid(x) - 1.0, sigmoid(y)
    scores = np.column_stack((x, y))
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    share = e / e.sum(axis=1, keepdims=True)
    return share[:, 0] - 1.0, share[:, 1:]


def no_gradient(rows: Rows) -> np.ndarray:
    return np.zeros(rows.vectors.shape)


def gradients(bucket: Bucket, inputs: Rows, outputs: Rows):
    """Loss and gradients of all pairs of the bucket at fixed parameters."""
    d_in, d_out = no_gradient(inputs), no_gradient(outputs)
    return *add_gradients(bucket, inputs, outputs, d_in, d_out), d_in, d_out


def add_gradients(bucket: Bucket, inputs: Rows, outputs: Rows, d_in: np.ndarray, d_out: np.ndarray) -> tuple[float, int]:
    """Add the gradients of all pairs of the bucket; returns loss and predictions."""
    in_at, targets = inputs.index(bucket.codes), target_rows(bucket, outputs)
    loss, n = 0.0, 0
    for first, end, lo, rows in blocks(bucket, outputs, targets, np.arange(bucket.n)):
        at, v = np.arange(first, end), inputs.take(in_at[first:end])
        to_inputs, to_outputs = np.zeros(v.shape), np.zeros(rows.shape)
        for d in bucket.offsets():
            inside, j = bucket.neighbours(at, d)
            k, near = np.flatnonzero(inside), j - lo
            centre, around = v.take(k, 0), rows.take(near, 0)
            x, y = target_scores(centre, around)
            slopes = np.column_stack(pair_slopes(x, y, bucket.objective.softmax))
            # a position is met once at each distance
            to_inputs[k] += np.einsum("mk,mkd->md", slopes, around)
            to_outputs[near] += slopes[:, :, None] * centre[:, None, :]
            loss += pair_loss(x, y, bucket.objective.softmax).sum()
            n += len(j) * bucket.predictions
        scatter_add(d_in, in_at[first:end], to_inputs)
        scatter_add(d_out, targets[lo : lo + len(rows)].ravel(), to_outputs.reshape(-1, v.shape[1]))
    return loss, n


def sgd_sequential(bucket: Bucket, inputs: Rows, outputs: Rows, alpha: float) -> tuple[float, int]:
    """One pass of plain SGD, pair after pair, updating rows in place."""
    objective, w = bucket.objective, bucket.objective.window
    V, U = inputs.vectors, outputs.vectors
    in_at = inputs.index(bucket.codes)
    targets = np.column_stack((outputs.index(bucket.output_codes()), outputs.index(bucket.negs)))
    ordered = np.sort(targets, axis=1)
    repeated = (ordered[:, 1:] == ordered[:, :-1]).any(axis=1)
    wanted = np.zeros(targets.shape[1])
    wanted[0] = alpha
    exp, outer = np.exp, np.multiply.outer
    targets, repeated, in_at = list(targets), repeated.tolist(), in_at.tolist()
    loss, n = 0.0, 0
    for s in range(len(bucket.starts) - 1):
        a, b = int(bucket.starts[s]), int(bucket.starts[s + 1])
        scores = []
        for i in range(a, b):
            v = V[in_at[i]]
            for j in range(max(a, i - w), min(b, i + w + 1)):
                if j == i:
                    continue
                at = targets[j]
                if objective.softmax:
                    scores.append(_softmax_step(v, U, at, alpha))
                elif repeated[j]:
                    scores.append(_repeated_step(v, U, at, alpha))
                else:
                    rows = U.take(at, 0)
                    x = rows.dot(v)
                    g = exp(-x)
                    g += 1.0
                    g = wanted - alpha / g
                    change = g.dot(rows)
                    rows += outer(g, v)
                    U[at] = rows
                    v += change
                    scores.append(x)
        if scores:
            x = np.array(scores)
            loss += pair_loss(x[:, 0], x[:, 1:], objective.softmax).sum()
            n += len(scores) * bucket.predictions
    return loss, n


def sgd_of_buckets(bucket: Bucket, inputs: Rows, outputs: Rows, alpha: float, batch: int = 1):
    """SGD of every bucket of `bucket.parts` from the same rows: loss, predictions, and
    the changes of the rows added up over the buckets."""
    d_in, d_out = no_gradient(inputs), no_gradient(outputs)
    return *add_sgd(bucket, inputs, outputs, d_in, d_out, alpha, batch), d_in, d_out


def add_sgd(bucket: Bucket, inputs: Rows, outputs: Rows, d_in: np.ndarray, d_out: np.ndarray, alpha: float, batch: int = 1):
    """Add the changes of the buckets; returns loss and predictions. With batch 1 buckets
    take their pairs in turn, side by side, as many as SIDE_BYTES of their rows allow."""
    in_at, targets = inputs.index(bucket.codes), np.column_stack((outputs.index(bucket.output_codes()), outputs.index(bucket.negs)))
    loss, n = 0.0, 0
    parts = [p for p in bucket.parts if p[1] > p[0]]
    row_bytes = 8 * inputs.vectors.shape[1] + 24
    while parts:
        room, side = SIDE_BYTES, []
        while parts and (not side or room > 0) and (batch == 1 or not side):
            a, b = parts.pop()
            side.append((a, b))
            room -= (len(np.unique(in_at[a:b])) + len(np.unique(targets[a:b]))) * row_bytes
        at = np.concatenate([np.arange(a, b) for a, b in side])
        part = np.repeat(np.arange(len(side)), [b - a for a, b in side])
        v_rows, v_at = _own_rows(part, in_at[at], len(inputs.codes))
        u_rows, u_at = _own_rows(np.repeat(part, targets.shape[1]), targets[at].ravel(), len(outputs.codes))
        u_at = u_at.reshape(len(at), -1)
        V, U = inputs.take(v_rows), outputs.take(u_rows)
        pairs = _ordered_pairs(bucket, at)
        if batch == 1:
            more = _sgd_side_by_side(V, U, v_at, u_at, part, pairs, alpha, bucket.objective.softmax)
        else:
            V, U = V.astype(np.float32), U.astype(np.float32)
            more = _sgd_in_batches(V, U, v_at, u_at, _by_place(bucket, at, pairs), alpha, batch, bucket.objective.softmax)
        loss, n = loss + more, n + len(pairs[0]) * bucket.predictions
        V -= inputs.take(v_rows)
        scatter_add(d_in, v_rows, V)
        U -= outputs.take(u_rows)
        scatter_add(d_out, u_rows, U)
    return loss, n


def _own_rows(part: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Every part has a copy of the rows it touches: the row behind each copy, and the
    copy that stands for each entry."""
    copies, at = np.unique(part * n_rows + rows, return_inverse=True)
    return copies % n_rows, at.ravel()


def _ordered_pairs(bucket: Bucket, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, context) as places in `at`, whole sentences, in order of centre and context."""
    i, which = np.nonzero(np.column_stack([bucket.neighbours(at, d)[0] for d in bucket.offsets()]))
    return i, i + np.array(bucket.offsets()).take(which)


def _sgd_side_by_side(V, U, v_at, u_at, part, pairs, alpha: float, softmax: bool) -> float:
    """Plain SGD, pair after pair in each part; the k-th pairs of all parts, which share
    no rows, are one step. Returns the loss."""
    i, j = pairs
    first = np.searchsorted(part[i], np.arange(part[-1] + 1))
    counts = np.diff(np.append(first, len(i)))
    order = np.argsort(-counts, kind="stable")
    first, counts = first[order], counts[order]
    ordered = np.sort(u_at, axis=1)
    repeated = (ordered[:, 1:] == ordered[:, :-1]).any(axis=1)
    wanted = np.zeros(u_at.shape[1])
    wanted[0] = alpha
    loss = 0.0
    for start in range(0, int(counts[0]), STEPS):
        steps = np.arange(start, min(start + STEPS, int(counts[0])))
        valid = steps[:, None] < counts[None, : int((counts > start).sum())]
        widths = valid.sum(axis=1)
        place = np.where(valid, first[: valid.shape[1]] + steps[:, None], first[: valid.shape[1]])
        here, there = v_at[i[place]], u_at[j[place]]
        twice = repeated[j[place]] & valid
        any_twice = twice.any(axis=1).tolist()
        scores = np.zeros(there.shape)
        for s, k in enumerate(widths.tolist()):
            v_row, u_row = here[s, :k], there[s, :k]
            if softmax:
                scores[s, :k] = _softmax_steps(V, U, v_row, u_row, alpha)
                continue
            if any_twice[s]:
                for r in np.flatnonzero(twice[s]):
                    scores[s, r] = _repeated_step(V[here[s, r]], U, there[s, r], alpha)
                once = np.flatnonzero(~twice[s, :k])
                v_row, u_row = v_row[once], u_row[once]
            v, rows = V.take(v_row, 0), U.take(u_row, 0)
            x = np.matmul(rows, v[:, :, None])[:, :, 0]
            g = np.exp(-x)
            g += 1.0
            g = wanted - alpha / g
            V[v_row] = v + np.matmul(g[:, None, :], rows)[:, 0]
            rows += g[:, :, None] * v[:, None, :]
            U[u_row] = rows
            if any_twice[s]:
                scores[s, once] = x
            else:
                scores[s, :k] = x
        flat = scores[valid]
        loss += pair_loss(flat[:, 0], flat[:, 1:], softmax).sum()
    return loss


def _softmax_steps(V, U, v_row, u_row, alpha: float) -> np.ndarray:
    """`_softmax_step` for pairs that share no rows."""
    v = V.take(v_row, 0)
    scores = np.matmul(U.take(u_row, 0), v[:, :, None])[:, :, 0]
    gx, gy = pair_slopes(scores[:, 0], scores[:, 1:], True)
    slopes = alpha * np.column_stack((gx, gy))
    for k in range(u_row.shape[1]):
        u = U.take(u_row[:, k], 0)
        slope = slopes[:, k : k + 1]
        u -= slope * v
        U[u_row[:, k]] = u
        v -= slope * u
    V[v_row] = v
    return scores


def _repeated_step(v, U, at, alpha):
    """A pair in which an output row occurs twice: target after target."""
    step, scores = np.zeros_like(v), np.empty(len(at))
    for k, row in enumerate(at):
        u = U[row]
        scores[k] = u @ v
        g = alpha * ((k == 0) - sigmoid(scores[k]))
        step += g * u
        u += g * v
    v += step
    return scores


def _softmax_step(v, U, at, alpha):
    """Slopes are fixed by the scores before the step; rows then change in turn."""
    scores = U[at] @ v
    gx, gy = pair_slopes(scores[:1], scores[None, 1:], True)
    for row, slope in zip(at, np.concatenate((gx, gy[0])), strict=True):
        u = U[row]
        u -= alpha * slope * v
        v -= alpha * slope * u
    return scores


def sgd_batched(bucket: Bucket, inputs: Rows, outputs: Rows, alpha: float, batch: int) -> tuple[float, int]:
    """SGD in mini-batches of pairs taken side by side from many sentences, so
    that the pairs of a batch rarely share rows. Where a row is hit more than
    STEP_LIMIT / alpha times, the batch is done in several steps: sums from one
    old value would otherwise overshoot. Every gradient counts in full."""
    V, U = inputs.vectors.astype(np.float32), outputs.vectors.astype(np.float32)
    in_at = inputs.index(bucket.codes)
    targets = np.column_stack((outputs.index(bucket.output_codes()), outputs.index(bucket.negs)))
    at = np.arange(bucket.n)
    pairs = _by_place(bucket, at, _ordered_pairs(bucket, at))
    loss = _sgd_in_batches(V, U, in_at, targets, pairs, alpha, batch, bucket.objective.softmax)
    inputs.vectors, outputs.vectors = V.astype(np.float64), U.astype(np.float64)
    return loss, len(pairs[0]) * bucket.predictions


def _by_place(bucket: Bucket, at: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the first positions of all sentences, then of the second ones, and so on."""
    i, j = pairs
    order = np.lexsort((bucket.sentence[at[i]], j - i, bucket.pos()[at[i]]))
    return i[order], j[order]


def _sgd_in_batches(V, U, in_at, targets, pairs, alpha: float, batch: int, softmax: bool) -> float:
    i, j = pairs
    limit = max(1, int(STEP_LIMIT / alpha))
    width = targets.shape[1]
    loss = 0.0
    for first in range(0, len(i), batch):
        for here, there in steps_of(in_at[i[first : first + batch]], targets[j[first : first + batch]], limit):
            v, rows = V.take(here, 0), U.take(there, 0)
            scores = np.einsum("md,mkd->mk", v, rows)
            gx, gy = pair_slopes(scores[:, 0], scores[:, 1:], softmax)
            steps = -alpha * np.column_stack((gx, gy)).astype(np.float32)
            loss += float(pair_loss(scores[:, 0], scores[:, 1:], softmax).sum())
            _add_rows(V, here, np.arange(len(here)), np.einsum("mk,mkd->md", steps, rows), None)
            flat = there.ravel()
            _add_rows(U, flat, np.arange(len(flat)) // width, v, steps.ravel())
    return loss


def _earlier(rows: np.ndarray) -> np.ndarray:
    """How many equal entries stand before each one."""
    order, _, first, times = segments(rows)
    out = np.empty(len(rows), np.int64)
    out[order] = np.arange(len(rows)) - np.repeat(first, times)
    return out


def steps_of(here: np.ndarray, there: np.ndarray, limit: int):
    """The pairs of a batch in steps in which no row occurs more than `limit`
    times, unless within one pair."""
    while len(here):
        late = (_earlier(here) >= limit) | (_earlier(there.ravel()).reshape(there.shape) >= limit).any(axis=1)
        late[0] = False
        yield here[~late], there[~late]
        here, there = here[late], there[late]


def _add_rows(target, at, source, values, factors):
    """target[at[r]] += factors[r] * values[source[r]], repeated rows added up."""
    order, rows, first, times = segments(at)
    added = values[source[order]]
    if factors is not None:
        added *= factors[order, None]
    target[rows] += segment_sums(added, first, times)
