"""Scoring of whole documents by a gated recurrent language model, in numpy.

Counting is exact and distributed: every training token is counted. The most frequent
``VOCAB`` words are predicted by a class-factored softmax, p(class | state) * p(word |
class, state); every other word falls, by its spelling, into one of ``SHAPES`` further
classes, p(class | state) * p(word | class), the latter from the smoothed counts. So each
text has a proper probability whatever words it has.

The network is trained by truncated backpropagation on every training text. A hash of id
and text deals them out to rounds and, in a round, to shards of ``SHARD`` tokens about, each
read in the order of the hash; so how the table is partitioned plays no part. All shards of
a round start alike and their weights are averaged by the tokens they have seen. Documents
are scored whole: many in lock step, in windows, with the state carried from window to
window. The probability of a class of unseen words is that of any one of them: the smoothed
counts leave each unseen word the whole of what is left to its class.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Cut, gathered, in_blocks, small_batches, texts

#: Words with outputs of their own, words of a class, and spelling classes of the others.
VOCAB, CLASS, SHAPES = 4096, 64, 24
#: Size of the state; steps of a window in training and in scoring; pieces of texts trained side by side, and their tokens at most.
STATE, STEPS, WINDOW, LANES, SEGMENT = 16, 16, 32, 512, 512
#: Tokens that a step of training averages, at least, and those of a shard, about.
UPDATE, SHARD = 2048, 2_000_000
#: Rows of states that the softmax works on at a time, so that they stay in the processor's cache.
ROWS = 4096
#: Words whose counts every worker knows; those of rarer ones are joined. At 30 bytes a word this is 6 MB.
HEAD = 200_000
#: Rounds of training; each takes its share of the texts, all of them together every text. The rate of the first.
ROUNDS, RATE = 2, 0.02
#: Weights that one task adds up.
FAN = 16
SMOOTH = 0.1
#: States are within -1 and 1, so outputs stay far from this; it keeps exp() finite whatever happens.
TOP = np.float32(80)
#: The end of a text is counted under this name, which no word has.
END = b""


def shape(word: bytes) -> int:
    """The spelling class: by the first character beyond ASCII, else by length; and by whether the word ends in a letter or digit."""
    closed = not word[-1:].isalnum() and word[-1:] < b"\x80"
    if word.isascii():
        return min((len(word) - 1) // 4, 3) * 2 + closed
    first = next(c for c in word.decode(errors="replace") if c > "\x7f")
    return 8 + ord(first) % 8 * 2 + closed


@dataclass
class Lexicon:
    """Counts that the model is built on: of the head words, most frequent first, and of the spelling classes."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int
    shape_tokens: np.ndarray
    shape_words: np.ndarray

    @property
    def vocab(self) -> int:
        return min(VOCAB, len(self.words))

    @property
    def classes(self) -> int:
        return -(-self.vocab // CLASS) + SHAPES


class _Ids(dict):
    """Word numbers: of head words their rank; of others HEAD plus the spelling class."""

    def __init__(self, lexicon: Lexicon):
        super().__init__((w, i) for i, w in enumerate(lexicon.words))
        own = (shape(w) for w in lexicon.words[lexicon.vocab :])
        beyond = np.fromiter(own, np.int32, len(lexicon.words) - lexicon.vocab)
        #: Of a rank, or HEAD plus a spelling class: the word's number in the network.
        self.network = np.zeros(HEAD + SHAPES, np.int32)
        self.network[: lexicon.vocab] = np.arange(lexicon.vocab)
        self.network[lexicon.vocab : len(lexicon.words)] = lexicon.vocab + beyond
        self.network[HEAD:] = lexicon.vocab + np.arange(SHAPES)

    def __missing__(self, word: bytes) -> int:
        return HEAD + shape(word)

    def of(self, text: bytes) -> tuple[np.ndarray, list[bytes]]:
        """The numbers of a text's words and its end, and those words that are beyond the head."""
        ids, rest = [], []
        for piece in pieces(text):
            words = piece.lower().split()
            own = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
            ids.append(own)
            rest += [words[i] for i in np.flatnonzero(own >= HEAD)]
        ids.append(np.array([self[END]], np.int32))
        return np.concatenate(ids), rest


def pieces(text: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """A long text in pieces that end where a word does, so that its words are never all held as objects."""
    at = 0
    while len(text) - at > size:
        gap = _SPACE.search(text, at + size)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _kept(lexicon: Lexicon) -> _Ids:
    """The word numbers of a lexicon, made once in a worker."""
    if not hasattr(lexicon, "ids"):
        lexicon.ids = _Ids(lexicon)
    return lexicon.ids


def count_tokens(docs: DataFrame) -> DataFrame:
    """Of texts: word (lower-cased, '' for ends), n. Each partition sums up before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in in_blocks(batches):
            for x in texts(batch):
                for piece in pieces(x):
                    found.update(piece.lower().split())
            found[END] += batch.num_rows
            if len(found) > 600_000:
                yield rows()
                found.clear()
        yield rows()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _shapes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, words = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    for batch in batches:
        cls = np.fromiter(map(shape, batch.column("word").cast(pa.binary()).to_pylist()), np.int64, batch.num_rows)
        tokens += np.bincount(cls, batch.column("n").to_numpy(), SHAPES).astype(np.int64)
        words += np.bincount(cls, minlength=SHAPES)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHAPES)), pa.array(tokens), pa.array(words)], names=["shape", "tokens", "words"])


def _packed(counts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """Words and counts on the driver, most frequent first. They come as a few byte strings, not as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = b"\n".join(batch.column("word").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([words], pa.binary()), pa.array([batch.column("n").to_numpy().tobytes()], pa.binary())], names=["words", "counts"])

    parts = counts.mapInArrow(run, "words binary, counts binary").collect()
    words = [w for p in parts for w in bytes(p["words"]).split(b"\n")]
    n = np.concatenate([np.frombuffer(bytes(p["counts"]), np.int64) for p in parts])
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    return [words[i] for i in order], n[order]


def build_lexicon(counts: DataFrame) -> tuple[Lexicon, int]:
    """The lexicon, and the count from which on words are in its head. What is collected is bounded by HEAD."""
    per_n = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    total = per_n.agg(F.sum(F.col("n") * F.col("words")), F.sum("words")).first()
    tokens, distinct = int(total[0] or 0), int(total[1] or 0)
    # Words of the largest counts, as long as they and the end fit; there are at most HEAD distinct counts among them.
    seen, least = 0, None
    for r in per_n.orderBy(F.desc("n")).limit(HEAD).collect():
        if seen + r["words"] >= HEAD:
            break
        seen, least = seen + r["words"], r["n"]
    words, n = _packed(counts.filter(F.col("n") >= least)) if least is not None else ([], np.zeros(0, np.int64))
    if END in words[VOCAB:]:  # the end is always predicted by the network
        i = words.index(END)
        words.insert(0, words.pop(i))
        n = np.concatenate([n[i : i + 1], np.delete(n, i)])
    shape_tokens, shape_words = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    top = set(words[:VOCAB])
    below = counts.filter(F.col("n") < least) if least is not None else counts
    for r in below.filter("word <> ''").mapInArrow(_shapes_of, "shape long, tokens long, words long").groupBy("shape").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect():
        shape_tokens[r["shape"]], shape_words[r["shape"]] = r["tokens"], r["words"]
    for w, k in zip(words, n.tolist(), strict=True):
        if w not in top:
            shape_tokens[shape(w)] += k
            shape_words[shape(w)] += 1
    if END not in words:  # it is rarer than the head's words, or there are no training texts
        ends = counts.filter("word = ''").first()
        words, n = [END, *words], np.concatenate([np.array([ends["n"] if ends else 0], np.int64), n])
    return Lexicon(words, n, tokens, distinct, shape_tokens, shape_words), least or 0


class Network:
    """Weights: input to gates by word (E), state to gates (U), state to classes (Wc, bc), state to the words of a class (Wo, bo; the last class is filled up with words of no mass). ``trained`` counts the tokens of training."""

    names = ("E", "U", "Wc", "bc", "Wo", "bo")

    def __init__(self, lexicon: Lexicon, seed: int = 5):
        rng, v = np.random.default_rng(seed), lexicon.vocab
        k = self.n_word_classes = lexicon.classes - SHAPES
        self.v, self.start, self.trained = v, lexicon.words.index(END), 0
        count = lexicon.counts[:v].astype(np.float64) + SMOOTH
        word_mass = np.add.reduceat(count, np.arange(0, v, CLASS))
        mass = np.concatenate([word_mass, lexicon.shape_tokens + SMOOTH])
        self.class_of = np.concatenate([np.arange(v) // CLASS, k + np.arange(SHAPES)]).astype(np.int16)  # short numbers are sorted by radix
        scale = lambda *size: (rng.standard_normal(size) * 0.1).astype(np.float32)
        self.E, self.U = scale(v + SHAPES, 3 * STATE), scale(STATE, 3 * STATE)
        self.Wc, self.bc = np.zeros((len(mass), STATE), np.float32), np.log(mass / mass.sum()).astype(np.float32)
        self.Wo, self.bo = np.zeros((k, STATE, CLASS), np.float32), np.full((k, CLASS), -1e4, np.float32)
        self.bo.reshape(-1)[:v] = np.log(count / word_mass[np.arange(v) // CLASS])

    def copy(self) -> Network:
        out = Network.__new__(Network)
        out.__dict__.update({k: v.copy() if k in self.names else v for k, v in self.__dict__.items()})
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).reshape(-1) for k in self.names])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in self.names:
            x = getattr(self, k)
            setattr(self, k, flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """From gate inputs ``x`` and states ``h``, a column each: the new states, both gates (update, reset), what the reset gate lets through, and the candidate."""
        hu = self.U.T @ h
        gates, through = hu[: 2 * STATE], hu[2 * STATE :]
        gates += x[: 2 * STATE]
        np.exp(np.negative(gates, out=gates), out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        c = gates[STATE:] * through
        c += x[2 * STATE :]
        np.tanh(c, out=c)
        new = c - h
        new *= gates[:STATE]
        new += h
        return new, gates, through, c

    def outputs(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Weights to classes and to words, the biases as a last row for states with a last column of ones, so each logit is made and sent back in one product; and whether no output can be beyond TOP, as states are within -1 and 1."""
        of_class, of_word = np.concatenate([self.Wc.T, self.bc[None]]), np.concatenate([self.Wo, self.bo[:, None]], 1)
        return of_class, of_word, max(float(np.abs(w).sum(-2).max()) for w in (of_class, np.where(of_word > -1e3, of_word, 0))) < TOP

    def log_probs(self, states: np.ndarray, target: np.ndarray, grads: dict | None = None, outputs: tuple | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of targets (word number, or vocab + spelling class) in these states.

        With ``grads`` also the gradient of their negative sum for the states; weights' gradients are added there. ``outputs``: those of these weights, if made before.
        """
        out, outputs = np.empty(len(target), np.float32), outputs or self.outputs()
        d = None if grads is None else np.empty_like(states)
        for i in range(0, len(target), ROWS):
            part = slice(i, i + ROWS)
            self._log_probs(states[part], target[part], grads, outputs, out[part], None if d is None else d[part])
        return out, d

    def _log_probs(self, states: np.ndarray, target: np.ndarray, grads: dict | None, outputs: tuple, out: np.ndarray, d_out: np.ndarray | None) -> None:
        cls = self.class_of[target]
        order = np.argsort(cls, kind="stable")
        cls, states, target = cls[order], states[order], target[order]
        edges = np.searchsorted(cls, np.arange(self.n_word_classes + 1, dtype=cls.dtype)).tolist()
        ranges = [(k, a, b) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
        n = edges[-1]

        ones = np.ones((len(states), STATE + 1), np.float32)
        ones[:, :STATE] = states
        of_class, of_word, bounded = outputs

        def softmax(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Log probabilities of ``at``; ``logits`` become what the softmax sends back, with gradients."""
            rows = np.arange(len(at))
            if not bounded:
                np.minimum(logits, TOP, out=logits)
            own = logits[rows, at]
            total = np.exp(logits, out=logits).sum(1)
            if grads is not None:
                logits *= np.reciprocal(total)[:, None]
                logits[rows, at] -= 1
            return own - np.log(total)

        e = ones @ of_class
        found = softmax(e, cls)
        if grads is not None:
            back = e.T @ ones
            grads["Wc"] += back[:, :STATE]
            grads["bc"] += back[:, STATE]
            d = e @ self.Wc
        e = np.empty((n, CLASS), np.float32)
        for k, a, b in ranges:
            np.matmul(ones[a:b], of_word[k], out=e[a:b])
        found[:n] += softmax(e, target[:n] - cls[:n] * CLASS)
        out[order] = found
        if grads is not None:
            for k, a, b in ranges:
                back = ones[a:b].T @ e[a:b]
                grads["Wo"][k] += back[:STATE]
                grads["bo"][k] += back[STATE]
                d[a:b] += e[a:b] @ self.Wo[k].T
            d_out[order] = d


def _zeros(net: Network) -> dict[str, np.ndarray]:
    return {k: np.zeros_like(getattr(net, k)) for k in net.names}


def _update(net: Network, grads: dict[str, np.ndarray], tokens: int, state: dict, rate: float) -> None:
    """One step of Adam on the mean gradient, its length clipped at 1."""
    norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())) / tokens
    scale = min(1.0, 1.0 / (norm + 1e-9)) / tokens
    state["t"] = state.get("t", 0) + 1
    fix = math.sqrt(1 - 0.99 ** state["t"]) / (1 - 0.9 ** state["t"])
    for k, g in grads.items():
        m1, m2 = state.setdefault(k, (np.zeros_like(g), np.zeros_like(g)))
        g *= np.float32(scale)
        m1 += np.float32(0.1) * (g - m1)
        g *= g
        g -= m2
        g *= np.float32(0.01)
        m2 += g
        root = np.sqrt(m2, out=g)
        root += np.float32(1e-5)
        np.divide(m1, root, out=root)
        root *= np.float32(rate * fix)
        getattr(net, k).__isub__(root)


def _segments(ids: list[np.ndarray], start: int, most: int) -> tuple[np.ndarray, ...]:
    """Texts as one array, with the token before each (``start`` before a text), and the begins and lengths of segments of ``most`` tokens at most, the longest first."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate(ids)
    begins = lengths.cumsum() - lengths
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[begins] = start
    n = -(-lengths // most)
    own = np.repeat(np.arange(len(ids)), n)
    offset = (np.arange(len(own)) - np.repeat(n.cumsum() - n, n)) * most
    size = np.minimum(lengths[own] - offset, most)
    order = np.argsort(-size, kind="stable")
    return flat, before, (begins[own] + offset)[order], size[order], own[order]


def _turned(x: np.ndarray) -> np.ndarray:
    """With the last two axes exchanged, in order in memory."""
    return np.ascontiguousarray(x.swapaxes(-1, -2))


def train(net: Network, ids: list[np.ndarray], state: dict, rate: float = 0.01) -> int:
    """One pass over texts by truncated backpropagation, with Adam; returns the tokens seen. Segments of a text are trained apart."""
    seen, pending, grads = 0, 0, _zeros(net)
    flat, before, starts, lengths, _ = _segments(ids, net.start, SEGMENT)
    for lane in range(0, len(starts), LANES):
        start, size = starts[lane : lane + LANES], lengths[lane : lane + LANES]
        h = np.zeros((STATE, len(size)), np.float32)
        for t0 in range(0, int(size[0]), STEPS):
            n, steps = int(np.searchsorted(-size, -t0, side="left")), min(STEPS, int(size[0]) - t0)
            time = t0 + np.arange(steps)[:, None]
            at = np.minimum(start[:n] + time, len(flat) - 1)
            word = before[at]
            # Time comes first, then what a state is made of, so each step works on whole rows. A token is predicted from the state that has read the one before it.
            states = np.empty((steps + 1, STATE, n), np.float32)
            states[0] = h[:, :n]
            trace = []
            for t in range(steps):
                states[t + 1], *kept = net.step(_turned(net.E[word[t]]), states[t])
                trace.append(kept)
            h = states[-1]
            rows = np.flatnonzero((time < size[:n]).reshape(-1))
            d = np.zeros((steps * n, STATE), np.float32)
            d[rows] = net.log_probs(_turned(states[1:]).reshape(-1, STATE)[rows], flat[at].reshape(-1)[rows], grads)[1]
            d = _turned(d.reshape(steps, n, STATE))
            up, dh = np.empty((steps, 3 * STATE, n), np.float32), np.zeros((STATE, n), np.float32)
            dx = np.empty_like(up)
            for t in range(steps - 1, -1, -1):
                gates, through, c = trace[t]
                z, r = gates[:STATE], gates[STATE:]
                dh += d[t]
                both = dx[t]
                np.multiply(dh, c - states[t], out=both[:STATE])
                dc = np.multiply(dh, z, out=both[2 * STATE :])
                c *= c
                dc *= np.subtract(1, c, out=c)
                np.multiply(dc, through, out=both[STATE : 2 * STATE])
                rest = 1 - gates
                both[: 2 * STATE] *= gates
                both[: 2 * STATE] *= rest
                up[t] = both
                up[t, 2 * STATE :] *= r
                dh *= rest[:STATE]
                dh += net.U @ up[t]
            grads["U"] += np.matmul(states[:-1], up.transpose(0, 2, 1)).sum(0)
            word = word.reshape(-1)
            by = np.argsort(word, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(word[by]) != 0])
            grads["E"][word[by][first]] += np.add.reduceat(_turned(dx).reshape(-1, 3 * STATE)[by], first)
            pending += len(rows)
            seen += len(rows)
            if pending >= UPDATE:
                _update(net, grads, pending, state, rate)
                grads, pending = _zeros(net), 0
    if pending:
        _update(net, grads, pending, state, rate)
    return seen


def score_ids(net: Network, ids: list[np.ndarray]) -> np.ndarray:
    """Natural log probabilities of whole texts, all windows, with the state carried on."""
    out = np.zeros(len(ids))
    flat, before, start, size, order = _segments(ids, net.start, 1 << 62)
    h, outputs = np.zeros((STATE, len(ids)), np.float32), net.outputs()
    for t0 in range(0, int(size[0]), WINDOW):
        n, steps = int(np.searchsorted(-size, -t0, side="left")), min(WINDOW, int(size[0]) - t0)
        time = t0 + np.arange(steps)[:, None]
        # A text that has ended takes any token; its states are not used.
        at = np.minimum(start[:n] + time, len(flat) - 1)
        states, h = np.empty((steps, STATE, n), np.float32), h[:, :n]
        for t in range(steps):
            h = states[t] = net.step(_turned(net.E[before[at[t]]]), h)[0]
        live = time < size[:n]
        found = net.log_probs(_turned(states)[live], flat[at[live]], outputs=outputs)[0]
        out[order[:n]] += np.bincount(np.broadcast_to(np.arange(n), (steps, n))[live], found, n)
    return out


def _in_chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Of rows (shard, ids) in order: (shard, the numbers of its texts, ``limit`` bytes about), cut alike however the rows were sent."""
    shard, held, size = None, [], 0
    for batch in in_blocks(batches, "ids", limit):
        for own, x in zip(batch.column("shard").to_pylist(), texts(batch, "ids"), strict=True):
            if held and (own != shard or size + len(x) > limit):
                yield shard, held
                held, size = [], 0
            shard = own
            held.append(np.frombuffer(x, np.int16))
            size += len(x)
    if held:
        yield shard, held


def fit(docs: DataFrame, lexicon: Lexicon, seed: int = 5, rounds: int = ROUNDS) -> Network:
    """Train on texts (ids: their words' numbers in the network, 2 bytes each; h), every one once: round r takes those with h modulo ``rounds`` = r, dealt to shards by h. All shards of a round start alike; weights are averaged."""
    net, sc = Network(lexicon, seed), docs.sparkSession.sparkContext
    shards = max(1, round(lexicon.tokens / SHARD))
    for turn in range(rounds):
        now = sc.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch], now=now, turn=turn) -> Iterator[pa.RecordBatch]:
            at, mine, adam, seen = None, None, {}, 0

            def done() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([mine.flat().tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["shard", "weights", "seen"])

            for shard, held in _in_chunks(batches, 8 << 18):
                if shard != at:
                    if at is not None:
                        yield done()
                    at, mine, adam, seen = shard, now.value.copy(), {}, 0
                seen += train(mine, held, adam, RATE / (1 + turn))
            if at is not None:
                yield done()

        def mean(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("shard")
            seen, total = int(pdf["seen"].sum()), np.zeros(len(pdf["weights"].iloc[0]) // 4)
            for x, n in zip(pdf["weights"], pdf["seen"], strict=True):
                total += np.frombuffer(x, np.float32) * (n / seen)
            return pd.DataFrame({"shard": [int(key[0])], "weights": [total.astype(np.float32).tobytes()], "seen": [seen]})

        mixed, schema = F.shiftright(F.xxhash64("h"), 1), "shard long, weights binary, seen long"
        dealt = docs.filter(F.pmod("h", F.lit(rounds)) == turn).select(F.pmod(mixed, F.lit(shards)).cast("int").alias("shard"), "h", "ids")
        means, left = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h", "ids").select("shard", "ids").mapInArrow(run, schema), shards
        while left > 1:  # a tree: no task adds more than FAN weights, 1 MB each, and the driver gets one
            means = means.groupBy(F.floor(F.col("shard") / FAN).alias("g")).applyInPandas(mean, schema)
            left = -(-left // FAN)
        rows = means.collect()
        if rows:
            net.load(np.frombuffer(bytes(rows[0]["weights"]), np.float32))
            net.trained += rows[0]["seen"]
    return net


def score_documents(documents: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", seed: int = 5) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, train_tokens, base_score, score; learning from the rows that ``training`` admits.

    Tokens are words (other than ASCII white space, A-Z lower-cased) and one end a text;
    null is the empty text, which is one end. ``base_score`` is the smoothed unigram
    log10 probability, ``score`` the network's. Rows are scored one by one, so repeated
    rows have rows of their own; extra columns are ignored. Without training rows all
    words are unknown to both. An empty table gives an empty result. However the table is
    partitioned, counts are equal and scores differ by rounding alone.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), training.alias("training"), F.xxhash64(doc_id, text).alias("h"))
    counts = Cut(count_tokens(docs.filter("training"))).df
    lexicon, least = build_lexicon(counts)
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(lexicon)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, ids_of = known.value, _kept(known.value)
        norm = math.log10(lex.tokens + SMOOTH * (lex.distinct + 1))
        shape_norm = np.log10(lex.shape_tokens + SMOOTH * (lex.shape_words + 1))
        # By rank, and 0 for words beyond the head: log count, whether it is known; and what a word adds to its spelling class.
        log_c, seen = np.zeros(HEAD + SHAPES), np.zeros(HEAD + SHAPES, np.int64)
        log_c[: len(lex.counts)], seen[: len(lex.counts)] = np.log10(lex.counts + SMOOTH), lex.counts > 0
        more = np.where(ids_of.network >= lex.vocab, log_c - shape_norm[np.maximum(ids_of.network - lex.vocab, 0)], 0.0)
        for batch in gathered(batches, limit=16 << 20):
            ids, rest = zip(*map(ids_of.of, texts(batch)), strict=True)
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            starts, flat = n.cumsum() - n, np.concatenate(ids)
            base = np.add.reduceat(log_c[flat], starts) - n * norm
            cols = [*(batch.column(c) for c in ("doc_id", "training", "h")), pa.array(n), pa.array(np.add.reduceat(seen[flat], starts)), pa.array(base), pa.array(np.add.reduceat(more[flat], starts))]
            cols += [pa.array([ids_of.network[i].astype(np.int16).tobytes() for i in ids], pa.binary()), pa.array(rest, pa.list_(pa.binary())).cast(pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "training", "h", "n", "known", "base", "model", "ids", "rest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = f"doc_id {kind}, n long, known long, base double, model double"
    # Words are numbered once, for training and scoring.
    numbered = docs.mapInArrow(read, f"doc_id {kind}, training boolean, h long, n long, known long, base double, model double, ids binary, rest array<string>")
    scored = Cut(numbered.withColumn("row", F.monotonically_increasing_id())).df
    model = sc.broadcast(fit(scored.filter("training").select("h", "ids"), lexicon, seed))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "ids", 10 << 20):
            found = score_ids(model.value, [np.frombuffer(x, np.int16) for x in texts(batch, "ids")]) / math.log(10)
            cols = [batch.column(c) for c in ("doc_id", "n", "known", "base")] + [pa.array(batch.column("model").to_numpy() + found), batch.column("row")]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "known", "base", "model", "row"])

    found = Cut(scored.select("doc_id", "n", "known", "base", "model", "row", "ids").mapInArrow(score, f"{numbers}, row long")).df
    rare = scored.select("row", F.explode("rest").alias("word"))
    # Words beyond the head: their exact counts are joined, and what they add is summed up by row.
    c = F.coalesce("n", F.lit(0))
    added = rare.join(counts.filter(F.col("n") < least) if least else counts, "word", "left").groupBy("row").agg(F.sum(F.log10(c + SMOOTH)).alias("more"), F.sum((c > 0).cast("long")).alias("more_known"))
    out = found.join(added, "row", "left")
    more, more_known = F.coalesce("more", F.lit(0.0)), F.coalesce("more_known", F.lit(0))
    return out.select("doc_id", F.col("n").alias("n_tokens"), (F.col("known") + more_known).alias("n_known"), F.lit(lexicon.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))
