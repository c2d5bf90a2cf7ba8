"""Log-bilinear language model, trained with noise-contrastive estimation, and scores of all texts.

Words are counted over all training documents with Spark. Those with at least
``MODEL_COUNT`` tokens (the more, the more data; at most ``MODEL_WORDS``) have
vectors of their own; all others share a symbol by their last two characters, and
the end of a text is a symbol. A history of ``ORDER`` symbols predicts a vector,
h = sum over positions i of C_i r(w_i). The next symbol's class follows from
exp(h a_c + bias), the word within the class from exp(h q_w + bias); a class is a
run of words of like frequency, so the sums that normalise both are short. A word
without a vector has its smoothed share of its symbol's tokens. So the model
covers every word, known or not, and sums to one.

Training reads every training token: each task goes through its documents in
minibatches with sampled noise (classes by their frequency; words of the same
class by theirs), all tasks begin with the same vectors, and Spark averages what
they end with, weighted by tokens (``ROUNDS`` times). Scoring takes many tokens
at once in matrix products.

The commonest words' counts are broadcast (a bounded number of short words); rare
or long ones meet their counts in a join, where no key is frequent.

Defined cases: a null or empty text is its end token alone; texts of any length are
scored as a whole; repeated rows count and are scored each by itself; null ids
are training documents (their remainder is undefined) and are scored; without
training documents all counts are 0 and the symbols' model is uniform; extra
columns play no part.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import as_bytes, map_texts, materialize
from quadrille.llm.quality import bucket

FOLDS, HELD_OUT = 5, 1
#: Words with vectors: how many tokens they need, and how many words there may be.
MODEL_COUNT, MODEL_WORDS = 30, 1 << 15
#: Symbols that words without a vector share, by their last characters.
ENDINGS = 32
#: Commonest words whose counts are broadcast, and the longest of them in bytes.
HEAD_WORDS, HEAD_BYTES = 100_000, 64
#: Symbols of a history, and components of a vector.
ORDER, SIZE = 2, 24
#: Noise for a minibatch's classes, and for each word within its class.
NOISE, WORD_NOISE = 32, 2
BATCH, RATE, ROUNDS = 1024, 0.15, 1
#: A task with fewer tokens goes through them again, but so often at most.
LEAST_TOKENS, MOST_PASSES = 200_000, 20
#: Tokens that are scored at once.
SCORED_TOKENS = 1 << 15
#: Of these, rows of class sums at once, few enough for a processor's cache.
SCORED_ROWS = 1 << 10
#: Numbers of a block in which vectors are averaged.
BLOCK = 1 << 14
SEED = 8
#: Distinct words that a task counts before it passes them on.
COUNTED_WORDS = 500_000


def ending(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word.decode("utf-8", "replace")[-2:].encode(), SEED) % ENDINGS


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z and the six ASCII white-space characters only


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) over all texts (column text); each task sums before the shuffle."""

    def run(batches):
        counts: Counter[bytes] = Counter()

        def out():
            keys = pa.array(list(counts), pa.binary())
            return pa.RecordBatch.from_arrays([keys, pa.array(counts.values(), pa.int64())], ["word", "c"])

        for batch in batches:
            for x in as_bytes(batch.column(0)):
                counts.update(words_of(x))
            if len(counts) >= COUNTED_WORDS:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return train.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_limit(counts: DataFrame) -> int:
    """The least count of which at most HEAD_WORDS words have as much.

    From a histogram with a bounded number of buckets, so that no task sends
    its own commonest words.
    """
    rows = counts.groupBy(bucket(F.col("c")).cast("long").alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()
    seen, limit = 0, 1 << 62
    for row in sorted(rows, key=lambda r: -r.b):
        seen += row.n
        if seen > HEAD_WORDS:
            break
        limit = row.least
    return limit


class Layout:
    """Symbols and classes of a model with so many words: the end, the words by falling frequency, the shared symbols.

    Classes are numbered likewise: the end's, those of the words, those of the shared symbols.
    """

    def __init__(self, words: int):
        self.words, self.width = words, max(1, round(words**0.5))
        self.groups = -(-words // self.width)
        self.symbols = 1 + words + ENDINGS
        self.classes = 1 + self.groups + ENDINGS

    def class_of(self, symbol: np.ndarray) -> np.ndarray:
        return np.where(symbol == 0, 0, np.where(symbol <= self.words, 1 + (symbol - 1) // self.width, symbol - self.words + self.groups))

    def bounds(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first word of a class of words and the one behind its last, counted from 0."""
        return (group - 1) * self.width, np.minimum(group * self.width, self.words)


class Model:
    """Parameters as float32: history vectors R, position matrices C, classes A and a, words Q and q."""

    NAMES = ("R", "C", "A", "a", "Q", "q")

    def __init__(self, layout: Layout, counts: np.ndarray):
        """``counts`` of all symbols; the biases begin as their logarithms, so the model begins as unigrams."""
        rng = np.random.default_rng(SEED)
        self.layout, self.counts = layout, counts
        n = layout.symbols
        self.by_class = np.bincount(layout.class_of(np.arange(n)), counts + 0.5, layout.classes)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.R, self.A, self.Q = small(n, SIZE), small(layout.classes, SIZE), small(layout.words, SIZE)
        self.C = np.stack([np.eye(SIZE, dtype=np.float32) / (i + 1) for i in range(ORDER)])
        self.a = np.log(self.by_class / self.by_class.sum()).astype(np.float32)
        self.q = np.log(counts[1 : layout.words + 1] + 0.5).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).reshape(-1) for k in self.NAMES])

    def fill(self, flat: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def trainer(self, rng: np.random.Generator):
        """A function that takes a minibatch of (history symbols, next symbol) by noise-contrastive estimation."""
        layout, words = self.layout, self.layout.words
        classes = np.cumsum(self.by_class) / self.by_class.sum()
        class_shift = np.log(NOISE * self.by_class / self.by_class.sum()).astype(np.float32)
        upto = np.append(0, np.cumsum(self.counts[1 : words + 1] + 0.5))
        in_class = layout.class_of(np.arange(1, words + 1))
        share = (self.counts[1 : words + 1] + 0.5) / self.by_class[in_class] if words else np.zeros(0)
        # The noise's logarithm, and what makes a class's word biases, as they begin, logarithms of shares.
        word_shift = (np.log(WORD_NOISE * share + 1e-30) + np.log(self.by_class[in_class])).astype(np.float32)
        seen = {k: np.full(getattr(self, k).shape[:1], 1e-6, np.float32) for k in self.NAMES}  # mean squares by row

        def sigmoid(x: np.ndarray) -> np.ndarray:
            """In the place of x."""
            np.clip(x, -30, 30, out=x)
            np.exp(np.negative(x, out=x), out=x)
            x += 1
            return np.reciprocal(x, out=x)

        def step(name: str, slope: np.ndarray) -> None:
            """Raise a small parameter by its slopes, less the more it moved before."""
            p, s = getattr(self, name), seen[name]
            s += (slope * slope).reshape(len(s), -1).mean(axis=1)
            p += (RATE / np.sqrt(s)).reshape(-1, *[1] * (p.ndim - 1)) * slope

        def step_rows(rows: np.ndarray, **slopes: np.ndarray) -> None:
            """The same for these rows of parameters, where a row may be named often."""
            order = np.argsort(rows.astype(np.uint16), kind="stable")  # symbols are fewer, and short integers sort faster
            rows = rows[order]
            first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            rows = rows[first]
            for name, slope in slopes.items():
                p, s = getattr(self, name), seen[name]
                slope = np.add.reduceat(slope.take(order, axis=0), first, axis=0)
                if p.ndim > 1:
                    s[rows] = now = s[rows] + np.einsum("ij,ij->i", slope, slope) / SIZE
                    slope *= (RATE / np.sqrt(now))[:, None]
                else:
                    s[rows] = now = s[rows] + slope * slope
                    slope *= RATE / np.sqrt(now)
                p[rows] += slope

        def train(history: np.ndarray, target: np.ndarray) -> None:
            n = len(target)
            before = [self.R.take(history[:, i], axis=0) for i in range(ORDER)]
            h = sum(r @ c for r, c in zip(before, self.C))
            group = layout.class_of(target)
            noise = np.minimum(np.searchsorted(classes, rng.random(NOISE)), layout.classes - 1)
            own, of_noise = self.A.take(group, axis=0), self.A[noise]
            up = (1 - sigmoid(np.einsum("bd,bd->b", h, own) + self.a[group] - class_shift[group])) / n
            down = sigmoid(h @ of_noise.T + (self.a[noise] - class_shift[noise])) / -n
            back = up[:, None] * own + down @ of_noise
            at = np.flatnonzero((target >= 1) & (target <= words))
            if len(at):
                word = target[at] - 1
                low, high = layout.bounds(group[at])
                draws = upto[low][:, None] + rng.random((len(at), WORD_NOISE)) * (upto[high] - upto[low])[:, None]
                other = np.clip(np.searchsorted(upto, draws, "right") - 1, low[:, None], high[:, None] - 1)
                mine, own, others = h.take(at, axis=0), self.Q.take(word, axis=0), self.Q.take(other, axis=0)
                gain = (1 - sigmoid(np.einsum("bd,bd->b", mine, own) + self.q[word] - word_shift[word])) / n
                loss = sigmoid(np.einsum("bd,bkd->bk", mine, others) + self.q[other] - word_shift[other]) / -n
                back[at] += gain[:, None] * own + np.einsum("bk,bkd->bd", loss, others)
                pulls = np.concatenate([gain[:, None], loss], axis=1)  # the word, then its noise
                step_rows(np.concatenate([word[:, None], other], axis=1).reshape(-1), Q=(pulls[:, :, None] * mine[:, None, :]).reshape(-1, SIZE), q=pulls.reshape(-1))
            step_rows(np.concatenate([group, noise]), A=np.concatenate([up[:, None] * h, down.T @ h]), a=np.concatenate([up, down.sum(axis=0)]))
            turned = [back @ c.T for c in self.C]
            step("C", np.stack([r.T @ back for r in before]))
            step_rows(history.T.reshape(-1), R=np.concatenate(turned))

        return train

    def scorer(self):
        """A function from (history symbols, next symbol) to normalised log10-probabilities of the symbols."""
        moved = [self.R @ c for c in self.C]
        layout = self.layout

        def log_sum(x: np.ndarray) -> np.ndarray:
            """In the place of x."""
            top = x.max(axis=1)
            x -= top[:, None]
            return np.log(np.exp(x, out=x).sum(axis=1)) + top

        def score(history: np.ndarray, target: np.ndarray) -> np.ndarray:
            h = sum(m[history[:, i]] for i, m in enumerate(moved))
            group = layout.class_of(target)
            out = np.zeros(len(h))
            for s in range(0, len(h), SCORED_ROWS):
                logits = h[s : s + SCORED_ROWS] @ self.A.T
                logits += self.a
                out[s : s + SCORED_ROWS] = logits[np.arange(len(logits)), group[s : s + SCORED_ROWS]] - log_sum(logits)
            at = np.flatnonzero((target >= 1) & (target <= layout.words))
            at = at[np.argsort(group[at], kind="stable")]
            if len(at):
                cuts = np.flatnonzero(np.diff(group[at])) + 1
                for part in np.split(at, cuts):
                    low, high = (int(x) for x in layout.bounds(group[part[0]]))
                    logits = h[part] @ self.Q[low:high].T
                    logits += self.q[low:high]
                    out[part] += logits[np.arange(len(part)), target[part] - 1 - low] - log_sum(logits)
            return out / np.log(10)

        return score


def histories(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(history, next) of each symbol of a text that ends with the end's; before a text there are ends."""
    padded = np.concatenate([np.zeros(ORDER, np.int64), symbols])
    return np.stack([padded[ORDER - 1 - i : len(padded) - 1 - i] for i in range(ORDER)], axis=1), symbols


def trained(train: DataFrame, own, model: Model) -> Model:
    """``model`` after ROUNDS passes over all training texts; ``own`` is a broadcast of the words' symbols."""
    spark = train.sparkSession
    size = len(model.flat())

    for number in range(ROUNDS):
        sent = spark.sparkContext.broadcast((model.layout, model.counts, model.flat()))

        def run(batches, sent=sent, number=number):
            layout, counts, flat = sent.value
            mine = Model(layout, counts)
            mine.fill(flat)
            train_on = mine.trainer(np.random.default_rng([SEED, number]))
            symbols_of = reader(own.value)
            waiting: list[np.ndarray] = []
            size = tokens = 0
            kept: list[np.ndarray] | None = []  # all of a small task's texts

            def flush(texts: list[np.ndarray]) -> None:
                pairs = [histories(x) for x in texts]
                history, target = (np.concatenate(x) for x in zip(*pairs))
                order = np.random.default_rng(SEED).permutation(len(target))
                for at in range(0, len(order), BATCH):
                    train_on(history[order[at : at + BATCH]], target[order[at : at + BATCH]])

            for batch in batches:
                for x in as_bytes(batch.column(0)):
                    found = symbols_of(words_of(x))
                    waiting.append(found)
                    size += len(found)
                    tokens += len(found)
                    if kept is not None:
                        kept.append(found)
                    if size >= 64 * BATCH:
                        flush(waiting)
                        waiting, size = [], 0
                if tokens >= LEAST_TOKENS:
                    kept = None
            if waiting:
                flush(waiting)
            if kept:
                for _ in range(min(MOST_PASSES, -(-LEAST_TOKENS // tokens)) - 1):
                    flush(kept)
            if tokens:
                after = mine.flat().astype(np.float32)
                starts = range(0, len(after), BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(starts)), pa.int32()), pa.array([tokens] * len(starts), pa.int64()), pa.array([after[s : s + BLOCK].tobytes() for s in starts], pa.binary())], ["block", "tokens", "part"])

        def merge(batches):
            """Rows come sorted by block; one block's sum is held."""
            now, total, weight = None, None, 0
            for batch in batches:
                for block, tokens, part in zip(*(c.to_pylist() for c in batch.columns)):
                    part = np.frombuffer(part, np.float32).astype(np.float64) * tokens
                    if block != now:
                        if now is not None:
                            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], ["block", "part"])
                        now, total, weight = block, part, tokens
                    else:
                        total, weight = total + part, weight + tokens
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], ["block", "part"])

        parts = train.select("text").mapInArrow(run, "block int, tokens long, part binary")
        rows = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, part binary").collect()  # of the model's size
        if rows:
            model.fill(np.concatenate([np.frombuffer(r.part, np.float32) for r in sorted(rows, key=lambda r: r.block)])[:size])
        sent.destroy()
    return model


def reader(own: dict[bytes, int]):
    """A function from words to their symbols and the end's; it keeps those of words that it has met."""
    words_in = len(own)

    class Known(dict):
        def __missing__(self, word: bytes) -> int:
            found = self[word] = own.get(word) or 1 + words_in + ending(word)
            return found

    known = Known()

    def symbols_of(words: list[bytes]) -> np.ndarray:
        found = np.zeros(len(words) + 1, np.int64)
        found[:-1] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if len(known) > COUNTED_WORDS:
            known.clear()
        return found

    return symbols_of


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``.

    The end counts as a token of its own, apart from all words.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    train = picked.where(~F.col("held_out"))
    counts = materialize(word_counts(train))
    n_docs = train.count()
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, vocabulary = tokens + n_docs, distinct + (n_docs > 0)

    # The head, commonest first; ties go to the smaller word.
    top = counts.where((F.col("c") >= head_limit(counts)) & (F.octet_length("word") <= HEAD_BYTES)).toPandas()
    head = dict(sorted(zip(map(bytes, top["word"]), top["c"].astype(int).tolist()), key=lambda x: (-x[1], x[0])))
    own = {w: i + 1 for i, w in enumerate([w for w, c in head.items() if c >= MODEL_COUNT][:MODEL_WORDS])}
    layout = Layout(len(own))
    symbols = spark.sparkContext.broadcast(own)

    # Tokens and types of the shared symbols, over all words: a row for each symbol.
    def by_symbol(batches):
        mine = symbols.value
        for batch in batches:
            words = as_bytes(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([mine.get(w) or 1 + len(mine) + ending(w) for w in words], pa.int32()), batch.column(1)], ["symbol", "c"])

    shared = counts.mapInArrow(by_symbol, "symbol int, c long").groupBy("symbol").agg(F.sum("c").alias("c"), F.count("*").alias("types")).collect()
    tokens_of, share_log = np.zeros(layout.symbols), np.zeros(layout.symbols)  # log10 of what a share of a symbol's tokens is divided by
    tokens_of[0] = n_docs
    share_log[1 + layout.words :] = np.log10(0.5)
    for row in shared:
        tokens_of[row.symbol] = row.c
        if row.symbol > layout.words:
            share_log[row.symbol] = np.log10(row.c + 0.5 * (row.types + 1))
    fitted = trained(train, symbols, Model(layout, tokens_of))
    base_log = float(np.log10(total + 0.5 * (vocabulary + 1)))
    model = spark.sparkContext.broadcast((head, fitted, share_log))

    def make():
        head, fitted, share_log = model.value
        mine = symbols.value
        score_of, own_words = fitted.scorer(), fitted.layout.words
        end_base = float(np.log10(n_docs + 0.5))
        # For each word met: its number, by which: symbol, log10(c + 0.5) or 0 for a rare one, whether it's in the head.
        number: dict[bytes, int] = {}
        kind, log, common = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)

        def meet(new: list[bytes]) -> None:
            nonlocal number, kind, log, common
            at, need = len(number), len(number) + len(new)
            if need > len(kind):
                size = max(need, 2 * len(kind), 1 << 16)
                kind, log, common = (np.resize(x, size) for x in (kind, log, common))
            c = np.array([head.get(w, -1) for w in new], np.float64)
            kind[at:need] = [mine.get(w) or 1 + own_words + ending(w) for w in new]
            common[at:need] = c >= 0
            log[at:need] = np.where(c >= 0, np.log10(np.maximum(c, 0) + 0.5), 0.0)
            number.update(zip(new, range(at, need)))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal number
            n_tokens, n_head, base, within, rare_words, rare_counts = [], [], [], [], [], []
            texts = [words_of(x) for x in as_bytes(batch.column(2))]
            if len(number) > COUNTED_WORDS:
                number = {}
            meet(list(set().union(*texts).difference(number)))
            sequences = []
            for words in texts:
                at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                seq, logs, is_common = kind[at], log[at], common[at]
                sequences.append(np.append(seq, 0))
                within.append(float(np.where(seq > own_words, logs - share_log[seq], 0.0).sum()))
                n_tokens.append(len(words) + 1)
                n_head.append(int(is_common.sum()) + (n_docs > 0))
                base.append(float(logs.sum()) + end_base - base_log * (len(words) + 1))
                rare = Counter([words[i] for i in np.flatnonzero(~is_common).tolist()])
                rare_words.append(list(rare))
                rare_counts.append(list(rare.values()))
            # All tokens of the slice together, in parts of bounded size.
            score = np.zeros(len(texts))
            of_text = np.repeat(np.arange(len(texts)), n_tokens)
            flat = np.concatenate([np.append(np.zeros(ORDER, np.int64), x) for x in sequences]) if sequences else np.zeros(0, np.int64)
            places = np.arange(len(of_text)) + ORDER * (of_text + 1)
            for at in range(0, len(of_text), SCORED_TOKENS):
                here = places[at : at + SCORED_TOKENS]
                found = score_of(np.stack([flat[here - 1 - i] for i in range(ORDER)], axis=1), flat[here])
                score += np.bincount(of_text[at : at + SCORED_TOKENS], found, len(texts))
            score += within
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_head, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(rare_words, pa.list_(pa.binary())), pa.array(rare_counts, pa.list_(pa.int64()))],
                ["doc_id", "held_out", "n_tokens", "n_head", "base", "own_score", "words", "times"],
            )

        return each

    scored = map_texts(picked, make, "doc_id long, held_out boolean, n_tokens long, n_head long, base double, own_score double, words array<binary>, times array<long>")
    # Numbers of rows hold once they are written.
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()))
    spread = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    more = spread.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("n_rare"))
    joined = scored.drop("words", "times").join(more, "row", "left")
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"), (F.col("own_score") + F.coalesce("logs", F.lit(0.0))).alias("score"))


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    """Every document's scores by the counts and by the model."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
