"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the embedding of the word itself, if the fit knew it, and the mean embedding of
its character trigrams. Windows of ``WINDOW`` words that overlap by half run through a gated
recurrent unit in both directions; attention pools the states of a window into one logit. A
text scores as its most toxic window, and the fit looks at it the same way: in each epoch every
labelled text is represented by the window that scores highest at that time.

What a window adds per word is one row of a table with the input's share of all gates, so that
scoring a word costs a lookup and a small product per direction.
"""

import io
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled texts of each kind that a model is fitted on, at most; those of smallest hashed id.
MAX_LABELS = 2000
#: Characters of a text the fit looks at, at most; longer ones are left out of the fit.
MAX_CHARACTERS = 40_000
WINDOW = 32
STRIDE = WINDOW // 2
_WORDS, _TRIGRAMS = 20_000, 4096
_WORD_SIZE, _CHARACTER_SIZE, _HIDDEN, _ATTENTION = 12, 8, 12, 8
_BATCH = 1024
_LONG = 4_000_000
_WORD = re.compile(r"\w+")


def words_of(text: str) -> Iterator[str] | list[str]:
    """Words in lower case; of a very long text one after the other."""
    low = text.lower()
    return _WORD.findall(low) if len(low) < _LONG else (m.group() for m in _WORD.finditer(low))


def _trigrams(word: str) -> list[int]:
    marked = f"<{word}>"
    return [
        zlib.crc32(marked[i : i + 3].encode("utf-8", "surrogatepass")) % _TRIGRAMS
        for i in range(len(marked) - 2)
    ]


def window_starts(words: int) -> np.ndarray:
    """Starts of the windows over a text; the last one ends with the text."""
    last = max(0, words - WINDOW)
    return np.append(np.arange(0, last, STRIDE), last)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Words:
    """Numbers words as they come, with what the network takes in of each."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.numbers, self.fresh = vocabulary, {}, []
        self.known = np.zeros(0, np.int64)
        self.grams = np.zeros(0, np.int64)
        self.ends = np.zeros(0, np.int64)

    def ids(self, words) -> np.ndarray:
        numbers, fresh = self.numbers, self.fresh

        def number(word: str) -> int:
            at = numbers.get(word)
            if at is None:
                at = numbers[word] = len(numbers)
                fresh.append(word)
            return at

        return np.fromiter(map(number, words), np.int32)

    def learn(self) -> slice:
        """Take in the words met since the last call; their numbers."""
        start = len(self.known)
        grams = [_trigrams(w) for w in self.fresh]
        counts = np.fromiter(map(len, grams), np.int64, len(grams))
        self.known = np.append(self.known, [self.vocabulary.get(w, 0) for w in self.fresh]).astype(np.int64)
        base = self.ends[-1] if len(self.ends) else 0
        self.ends = np.append(self.ends, base + np.cumsum(counts)).astype(np.int64)
        self.grams = np.append(self.grams, [g for one in grams for g in one]).astype(np.int64)
        self.fresh = []
        return slice(start, len(self.known))

    def grams_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All trigrams of the words, and how many each word has."""
        starts = np.append(0, self.ends)[numbers]
        counts = self.ends[numbers] - starts
        first = np.cumsum(counts) - counts
        at = np.arange(counts.sum()) - np.repeat(first, counts) + np.repeat(starts, counts)
        return self.grams[at], counts


class Network:
    """The parameters, the forward pass and its gradients."""

    def __init__(self, vocabulary: Sequence[str], parameters: dict[str, np.ndarray] | None = None):
        self.vocabulary = list(vocabulary)
        self.p = parameters or self._start()

    def _start(self) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(17)
        size, h = _WORD_SIZE + _CHARACTER_SIZE, _HIDDEN
        shapes = {
            "word": (len(self.vocabulary) + 1, _WORD_SIZE),
            "gram": (_TRIGRAMS, _CHARACTER_SIZE),
            **{f"in_{d}": (size, 3 * h) for d in "fb"},
            **{f"own_{d}": (h, 3 * h) for d in "fb"},
            **{f"bias_{d}": (3 * h,) for d in "fb"},
            "look": (2 * h, _ATTENTION),
            "focus": (_ATTENTION,),
            "out": (2 * h,),
            "intercept": (1,),
        }
        drawn = {}
        for name, shape in shapes.items():
            scale = 0.3 if name in ("word", "gram") else 1 / np.sqrt(shape[0])
            flat = name.startswith("bias") or name == "intercept"
            drawn[name] = (0 if flat else scale) * rng.standard_normal(shape)
        return {k: v.astype(np.float32) for k, v in drawn.items()}

    def taken_in(self, words: Words, numbers: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """The input vector of each of the words."""
        grams, counts = words.grams_of(numbers)
        first = np.cumsum(counts) - counts
        letters = np.add.reduceat(self.p["gram"][grams], first) / counts[:, None]
        known = words.known[numbers] if known is None else known
        return np.concatenate([self.p["word"][known], letters.astype(np.float32)], axis=1)

    def table(self, words: Words, numbers: np.ndarray) -> np.ndarray:
        """The input's share of the gates in both directions, a row for each of the words."""
        if not len(numbers):
            return np.zeros((0, 6 * _HIDDEN), np.float32)
        taken = self.taken_in(words, numbers)
        return np.concatenate(
            [taken @ self.p[f"in_{d}"] + self.p[f"bias_{d}"] for d in "fb"], axis=1
        )

    def _states(self, shares, own, mask, backward, trace=None):
        """All states of one direction; ``shares(t)`` is the input's share at place t."""
        h = _HIDDEN
        state = np.zeros((shares(0).shape[0], h), np.float32)
        states = np.empty((len(state), mask.shape[1], h), np.float32)
        full = mask.all()
        for t in range(mask.shape[1])[:: -1 if backward else 1]:
            share, pulled = shares(t), state @ own
            gates = _sigmoid(share[:, : 2 * h] + pulled[:, : 2 * h])
            update, reset = gates[:, :h], gates[:, h:]
            new = np.tanh(share[:, 2 * h :] + reset * pulled[:, 2 * h :])
            after = new + update * (state - new)
            if not full:
                after = np.where(mask[:, t, None], after, state)
            if trace is not None:
                trace.append((t, state, update, reset, new, pulled[:, 2 * h :]))
            state = states[:, t] = after
        return states

    def _pooled(self, states, mask):
        looked = np.tanh(states @ self.p["look"])
        weight = looked @ self.p["focus"]
        weight = np.where(mask, weight, -1e9)
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = np.einsum("bl,blh->bh", weight, states)
        return looked, weight, pooled, pooled @ self.p["out"] + self.p["intercept"][0]

    def logits(self, table: np.ndarray, windows: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """One logit per window; ``windows`` has rows of ``table``, by word and place."""
        h, out = _HIDDEN, []
        for start in range(0, len(windows), _BATCH):
            ids, here = windows[start : start + _BATCH], mask[start : start + _BATCH]
            gathered = table[ids.T]
            states = [
                self._states(
                    lambda t, s=side: gathered[t][:, 3 * h * s : 3 * h * (s + 1)],
                    self.p[f"own_{d}"], here, d == "b",
                )
                for side, d in enumerate("fb")
            ]
            out.append(self._pooled(np.concatenate(states, axis=2), here)[-1])
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def gradients(self, words: Words, windows, mask, known, labels) -> tuple[float, dict]:
        """Mean log loss of the windows, and its gradient in every parameter."""
        p, h, n = self.p, _HIDDEN, len(windows)
        flat = windows.ravel()
        taken = self.taken_in(words, flat, known.ravel())
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        traces, states = {}, []
        for d in "fb":
            share = (taken @ p[f"in_{d}"] + p[f"bias_{d}"]).reshape(n, -1, 3 * h)
            traces[d] = []
            states.append(
                self._states(lambda t, s=share: s[:, t], p[f"own_{d}"], mask, d == "b", traces[d])
            )
        both = np.concatenate(states, axis=2)
        looked, weight, pooled, logit = self._pooled(both, mask)
        chance = _sigmoid(logit)
        loss = float(np.mean(np.logaddexp(0, logit) - labels * logit))
        d_logit = (chance - labels).astype(np.float32) / n
        grads["intercept"][0] = d_logit.sum()
        grads["out"] = pooled.T @ d_logit
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = np.einsum("blh,bh->bl", both, d_pooled)
        d_both = weight[:, :, None] * d_pooled[:, None, :]
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        grads["focus"] = np.einsum("bl,bla->a", d_score, looked)
        d_look = d_score[:, :, None] * p["focus"] * (1 - looked**2)
        grads["look"] = np.einsum("blh,bla->ha", both, d_look)
        d_both = d_both + d_look @ p["look"].T
        d_taken = np.zeros_like(taken)
        for side, d in enumerate("fb"):
            own, d_states = p[f"own_{d}"], d_both[:, :, h * side : h * (side + 1)]
            carried = np.zeros((n, h), np.float32)
            d_share = np.zeros((n, mask.shape[1], 3 * h), np.float32)
            for t, before, update, reset, new, pulled in reversed(traces[d]):
                d_after = carried + d_states[:, t]
                d_state = np.where(mask[:, t, None], d_after, 0)
                d_update = d_state * (before - new) * update * (1 - update)
                d_new = d_state * (1 - update) * (1 - new**2)
                d_reset = d_new * pulled * reset * (1 - reset)
                d_pulled = np.concatenate([d_update, d_reset, d_new * reset], axis=1)
                d_share[:, t] = np.concatenate([d_update, d_reset, d_new], axis=1)
                grads[f"own_{d}"] += before.T @ d_pulled
                carried = (d_after - d_state) + d_state * update + d_pulled @ own.T
            d_share = d_share.reshape(len(flat), -1)
            grads[f"in_{d}"] = taken.T @ d_share
            grads[f"bias_{d}"] = d_share.sum(axis=0)
            d_taken += d_share @ p[f"in_{d}"].T
        np.add.at(grads["word"], known.ravel(), d_taken[:, :_WORD_SIZE])
        grams, counts = words.grams_of(flat)
        d_letters = d_taken[:, _WORD_SIZE:] / counts[:, None]
        np.add.at(grads["gram"], grams, np.repeat(d_letters, counts, axis=0))
        return loss, grads

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        vocabulary = np.frombuffer("\n".join(self.vocabulary).encode("utf-8", "surrogatepass"), np.uint8)
        np.savez(held, vocabulary=vocabulary, **self.p)
        return held.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> "Network":
        with np.load(io.BytesIO(data)) as held:
            arrays = dict(held)
        text = arrays.pop("vocabulary").tobytes().decode("utf-8", "surrogatepass")
        return cls(text.split("\n") if text else [], arrays)


class _Texts:
    """Word numbers of texts, one behind the other, and windows over them."""

    def __init__(self, ids: list[np.ndarray]):
        sizes = [len(i) for i in ids]
        # a text without words gets one window with one masked place
        self.ids = np.concatenate([*ids, np.zeros(WINDOW, np.int32)])
        offsets = np.cumsum([0, *sizes])
        starts = [window_starts(n) for n in sizes]
        self.owner = np.repeat(np.arange(len(ids)), [len(s) for s in starts])
        self.start = np.concatenate([s + o for s, o in zip(starts, offsets)]) if ids else np.zeros(0, int)
        self.size = np.minimum(WINDOW, np.array(sizes, int))[self.owner] if ids else np.zeros(0, int)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.arange(WINDOW)
        mask = place < self.size[chosen][:, None]
        at = self.start[chosen][:, None] + place
        return np.where(mask, self.ids[np.minimum(at, len(self.ids) - 1)], 0), mask

    def logits(self, network: Network, table: np.ndarray) -> np.ndarray:
        """One logit per window; a window without words has none and gets minus infinity."""
        out = np.full(len(self.start), -np.inf, np.float32)
        for wanted in (self.size == WINDOW, (self.size < WINDOW) & (self.size > 0)):
            places = np.flatnonzero(wanted)
            for part in range(0, len(places), 16 * _BATCH):
                chosen = places[part : part + 16 * _BATCH]
                out[chosen] = network.logits(table, *self.windows(chosen))
        return out


def _highest(owner: np.ndarray, logits: np.ndarray, count: int) -> np.ndarray:
    """The window with the highest logit of each text; of equal ones the first."""
    order = np.lexsort((np.arange(len(owner)), -logits, owner))
    return order[np.searchsorted(owner[order], np.arange(count))]


def trained(
    texts: Sequence[str], labels: Sequence[int], epochs: int = 12, steps: int = 500, batch: int = 48
) -> Network:
    """A network fitted to texts in a given order; the same input gives the same network.

    Few texts are gone through more than ``epochs`` times, for about ``steps`` steps. Of many
    a tenth is set aside, and the epoch that does best on it is kept.
    """
    split = [list(words_of(t)) for t in texts]
    spread = Counter(w for words in split for w in set(words))
    common = sorted((w for w, n in spread.items() if n >= 5), key=lambda w: (-spread[w], w))
    network = Network(common[:_WORDS])
    words = Words({w: i for i, w in enumerate(network.vocabulary, 1)})
    held = _Texts([words.ids(s) for s in split])
    words.learn()
    labels = np.array(labels, np.float32)
    base = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.01
    network.p["intercept"][0] = np.log(base / (1 - base))
    usable = np.array([i for i, s in enumerate(split) if s], int)
    if len(set(labels[usable].tolist())) < 2:
        network.p["out"][:] = 0
        return network
    rng = np.random.default_rng(5)
    rng.shuffle(usable)
    checked, fitted = np.split(usable, [len(usable) // 10 if len(usable) > 1000 else 0])
    epochs = max(epochs, -(-steps * batch // len(fitted)))
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.p.items()}
    best, least, step = None, np.inf, 0
    everything = np.arange(len(words.numbers))
    for epoch in range(epochs + 1):
        logits = held.logits(network, network.table(words, everything))
        first = _highest(held.owner, logits, len(labels))
        if len(checked):
            z = logits[first[checked]]
            loss = float(np.mean(np.logaddexp(0, z) - labels[checked] * z))
        else:
            loss = -epoch
        if loss < least:
            least, best = loss, {k: v.copy() for k, v in network.p.items()}
        if epoch == epochs:
            break
        order = rng.permutation(fitted)
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            windows, mask = held.windows(first[some])
            # now and then a word must be told by its letters alone
            known = np.where(rng.random(windows.shape) < 0.2, 0, words.known[windows])
            _, grads = network.gradients(words, windows, mask, known, labels[some])
            step += 1
            for name, grad in grads.items():
                m, v = moment[name]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                network.p[name] -= rate * m / (np.sqrt(v) + 1e-7)
    network.p = best
    return network


class Scorer:
    """Scores texts in any number, keeping the table rows of words met so far."""

    _KEPT = 200_000
    _TOGETHER = 400_000

    def __init__(self, network: Network):
        self.network = network
        self.known = {w: i for i, w in enumerate(network.vocabulary, 1)}
        self._forget()

    def _forget(self) -> None:
        self.words = Words(self.known)
        self.table = np.zeros((0, 6 * _HIDDEN), np.float32)

    def _scored(self, ids: list[np.ndarray]) -> np.ndarray:
        new = self.words.learn()
        more = self.network.table(self.words, np.arange(new.start, new.stop))
        self.table = np.concatenate([self.table, more])
        held = _Texts(ids)
        logits = held.logits(self.network, self.table).astype(np.float64)
        out = logits[_highest(held.owner, logits, len(ids))]
        if len(self.table) > self._KEPT:
            self._forget()
        # no words: what the network says before it has seen any
        out = np.where(np.isfinite(out), out, float(self.network.p["intercept"][0]))
        return 1 / (1 + np.exp(-out))

    def __call__(self, texts: Sequence[str | None]) -> np.ndarray:
        out, ids, size = [], [], 0
        for text in texts:
            ids.append(self.words.ids(words_of(text or "")))
            size += len(ids[-1])
            if size >= self._TOGETHER:
                out.append(self._scored(ids))
                ids, size = [], 0
        out.append(self._scored(ids) if ids else np.zeros(0))
        return np.concatenate(out)


def training_rows(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """``(doc_id, text, toxic)`` of the texts that may be learnt from, bounded in number and size.

    Every fifth document by crc32 of its id is held out. Null ids and labels other than 0 and 1
    are left out; of differing labels of a document the larger counts, of differing texts the
    smallest. Texts over ``MAX_CHARACTERS`` are not learnt from.
    """
    known = (
        labels.where(
            "doc_id IS NOT NULL AND toxic IN (0, 1) AND crc32(CAST(doc_id AS STRING)) % 5 <> 0"
        )
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    first = [
        known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
        for kind in (0, 1)
    ]
    chosen = first[0].unionAll(first[1]).withColumnRenamed("doc_id", "known_id")
    return (
        docs.select("doc_id", "text")
        .where(F.length("text") <= MAX_CHARACTERS)
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("known_id"))  # 2 * max_labels rows
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
        .select("doc_id", "text", "toxic")
    )


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Network:
    """A network for ``labels.toxic``, fitted in one task on a bounded sample.

    Only texts and labels are looked at. Without labels of both kinds every text scores as the
    share of toxic labels, 0.01 if there are none. Reruns agree: the sample goes by hashes, the
    draws by fixed seeds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(
            ((r["doc_id"], r["text"], r["toxic"]) for b in batches for r in b.to_pylist()),
            key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0])),
        )
        network = trained([r[1] for r in rows], [r[2] for r in rows])
        yield pa.record_batch({"network": pa.array([network.to_bytes()], pa.binary())})

    sample = training_rows(docs, labels, max_labels).coalesce(1)
    found = sample.mapInArrow(run, "network binary").first()  # an empty sample may have no task
    return Network.from_bytes(found["network"]) if found else trained([], [])


def score_column(spark, network: Network, text: Column) -> Column:
    """The score of a text, 0 to 1; higher means more toxic. Null and empty texts have one too.

    Every word of a text is in a window. The network, of bounded size, is broadcast.
    """
    sent = spark.sparkContext.broadcast(network.to_bytes())

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(Network.from_bytes(sent.value))
        for texts in batches:
            yield pd.Series(scorer(texts.tolist()))

    return score(text)
