"""Toxicity by class-conditional Kneser-Ney models of the letters inside words."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import append_columns, kept, place_of, release, text_slices, without
from .labelled import Logistic, class_share, id_remainder, training_documents, training_sample

#: Symbols of a letter group; a symbol has BITS bits.
ORDER, BITS = 8, 6
DISCOUNT = 0.75
#: Observations that the shared backoff counts for in each class.
BACKOFF = 4.0
#: Letters added to a word's own when its log ratio is divided by its length, so that short words need more evidence.
STIFF = 6.0
COUNTS = ["ordinary_0", "toxic_0", "ordinary_1", "toxic_1"]
#: Labelled documents of each class on which the score is calibrated; the letter groups are learnt from all.
PER_CLASS = 6000
#: Ratios are kept as whole numbers.
SCALE = 1e6
THRESHOLD = 0.3
MODULUS, HELD_OUT = 4, 2
#: Rows of a model (12 bytes each) that are broadcast; a larger one is joined with the letter groups of the texts.
BROADCAST_ROWS = 4_000_000
#: Without a broadcast: bytes of text judged together, and letter groups that a task holds.
CHUNK = 16 << 20
HELD_GRAMS = 500_000
#: Words whose ratio a task remembers; it may pass this by those of one slice of texts.
REMEMBERED = 50_000

#: ASCII letters in lower case, digits as one, other ASCII as a space; bytes of other letters as they are.
FOLD = bytes(b if b >= 128 else ord("0") if chr(b).isdigit() else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
#: Symbols: 0 the end of a word, letters, the digit, first bytes and 32 kinds of later bytes of other letters.
SYMBOL = np.array([1 + b - 97 if 97 <= b <= 122 else 27 if b == ord("0") else 0 if b < 128 else 28 if b >= 192 else 29 + (b & 31) for b in range(256)], np.int64)
LOW = np.array([(1 << BITS * k) - 1 for k in range(ORDER + 1)], np.int64)
#: In place of a group's last symbol: any that was not seen after the others.
OTHER = int(LOW[1])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(groups, letters): the last ORDER symbols up to each letter of the words and to their ends, packed into longs.

    What lies before a word is the end symbol. Groups are in the words' order, ``letters`` + 1 for each word.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = SYMBOL[np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)]
    end = np.flatnonzero(x == 0)
    size = np.diff(end)
    since = np.arange(len(x) - 1) - np.repeat(end[:-1], size)  # letters of the word before each place from 1 on
    gram = x[1:].copy()
    for k in range(1, ORDER):
        at = np.flatnonzero(since >= k)
        gram[at] |= x[at + 1 - k] << BITS * k
    return gram, size - 1


def gram_counts(training: DataFrame) -> DataFrame:
    """(gram, ordinary_0, toxic_0, ordinary_1, toxic_1): how often each letter group stands in the labelled documents, per fold."""

    def count(batches):
        held: list[Counter] = [Counter() for _ in COUNTS]

        def rows():
            grams, ns, kinds = [], [], []
            for k, words in enumerate(held):
                if words:
                    g, letters = word_grams(list(words))
                    grams.append(g)
                    ns.append(np.repeat(np.fromiter(words.values(), np.int64, len(words)), letters + 1))
                    kinds.append(np.full(len(g), k))
                    words.clear()
            if grams:
                kind, n = np.concatenate(kinds), np.concatenate(ns)
                gram, at = np.unique(np.concatenate(grams), return_inverse=True)
                counts = [np.bincount(at[kind == k], n[kind == k], len(gram)).astype(np.int64) for k in range(len(COUNTS))]
                yield pa.RecordBatch.from_arrays([pa.array(gram), *map(pa.array, counts)], names=["gram", *COUNTS])

        for b in (part for whole in batches for part in text_slices(whole, 0)):
            for t, label, fold in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column("label").to_pylist(), b.column("fold").to_pylist()):
                held[fold * 2 + label].update(words_of(t or b""))
            if sum(map(len, held)) > REMEMBERED:
                yield from rows()
        yield from rows()
        release()

    schema = "gram long, " + ", ".join(f"{c} long" for c in COUNTS)
    return training.mapInArrow(count, schema).groupBy("gram").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _last_three(counts: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per model, the triples of last symbols, sorted, with the Kneser-Ney probability of the third: at most 2**18 of them."""
    folds = [F.col(f"ordinary_{k}") + F.col(f"toxic_{k}") for k in (0, 1)]
    seen = [*folds, folds[0] + folds[1]]
    four = counts.groupBy(F.col("gram").bitwiseAND(int(LOW[4])).alias("gram")).agg(*[F.max((m > 0).cast("int")).alias(f"m{i}") for i, m in enumerate(seen)])
    got = four.groupBy(F.col("gram").bitwiseAND(int(LOW[3])).alias("gram")).agg(*[F.sum(f"m{i}").alias(f"m{i}") for i in range(3)]).toArrow().sort_by("gram")
    gram, out = got.column("gram").to_numpy(), []
    for i in range(3):
        n = got.column(f"m{i}").to_numpy().astype(np.float64)
        out.append((gram[n > 0], _shared(gram[n > 0], n[n > 0], 3, None)))
    return out


def _shared(gram: np.ndarray, count: np.ndarray, order: int, three: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Interpolated Kneser-Ney probability of the last symbol of each group after the ones before it, classes pooled."""
    if order == 1:
        return count / count.sum()
    if order == 3 and three is not None:
        return three[1][np.searchsorted(three[0], gram)]
    _, ctx = np.unique(gram >> BITS, return_inverse=True)
    total, kinds = np.bincount(ctx, count), np.bincount(ctx)
    shorter, at = np.unique(gram & LOW[order - 1], return_inverse=True)
    below = _shared(shorter, np.bincount(at).astype(np.float64), order - 1, three)[at]  # continuation counts
    return (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds[ctx] * below) / total[ctx]


def _log_ratios(gram: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray, three) -> tuple[np.ndarray, np.ndarray]:
    """log p(symbol | symbols before, toxic) - log p(symbol | symbols before, ordinary) of each group, and of any group unseen after its context.

    Both classes back off to one distribution, from the pooled continuation counts of shorter groups, so that a rare
    group that one class happens to hold moves the ratio little. For an unseen group that distribution cancels out, and
    the weights that the classes give it are left; after an unseen context they are equal, and the ratio is 0.
    """
    shorter, at = np.unique(gram & LOW[ORDER - 1], return_inverse=True)
    below = _shared(shorter, np.bincount(at).astype(np.float64), ORDER - 1, three)[at]
    _, ctx = np.unique(gram >> BITS, return_inverse=True)

    def of(count):
        total, kinds = np.bincount(ctx, count)[ctx] + BACKOFF, DISCOUNT * np.bincount(ctx, count > 0)[ctx] + BACKOFF
        return np.log((np.maximum(count - DISCOUNT, 0) + kinds * below) / total), np.log(kinds / total)

    return tuple(t - o for t, o in zip(of(toxic), of(ordinary)))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, m0, m1, m2): the log ratios of the groups seen, and per context that of all others, in units of 1 / SCALE.

    Models 0 and 1 know one fold, model 2 both. The row of a context's other groups has OTHER as its last symbol. A
    group without a row stands after a context without one, and has ratio 0. Groups lie by the three symbols before
    their last: a task holds all groups of its contexts, and all that end like one of them in four symbols or more.
    """
    three = _last_three(counts)
    parts = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), counts.count() // HELD_GRAMS)

    def ratios(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches).sort_by("gram")
        gram = rows.column("gram").to_numpy()
        o0, t0, o1, t1 = (rows.column(c).to_numpy().astype(np.float64) for c in COUNTS)
        start = np.flatnonzero(np.r_[True, gram[1:] >> BITS != gram[:-1] >> BITS])
        at = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(gram)]))
        unseen, each = np.zeros((3, len(start)), np.int32), []
        for m, (o, t) in enumerate(((o0, t0), (o1, t1), (o0 + o1, t0 + t1))):
            has = o + t > 0
            seen, rest = (np.round(x * SCALE).astype(np.int32) for x in _log_ratios(gram[has], o[has], t[has], three[m])) if has.any() else (0, 0)
            unseen[m, at[has]] = rest
            each.append(unseen[m, at])
            each[m][has] = seen
        key = np.r_[gram, gram[start] | OTHER]
        yield from pa.Table.from_arrays([pa.array(key), *(pa.array(np.r_[e, u]) for e, u in zip(each, unseen))], names=["gram", "m0", "m1", "m2"]).to_batches(10_000)
        del batches, rows, gram, at, each, key
        release()

    return counts.repartition(parts, F.shiftright("gram", BITS).bitwiseAND(int(LOW[3]))).mapInArrow(ratios, "gram long, m0 int, m1 int, m2 int")


class Ratios:
    """Log ratios by letter group, in sorted arrays."""

    def __init__(self, gram: np.ndarray, ratio: np.ndarray):
        order = np.argsort(gram)
        self.gram, self.ratio = gram[order], ratio[order]

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log ratio of each word, its end included, and its letters."""
        gram, letters = word_grams(words)
        ratio = np.zeros(len(gram), np.int64)
        if len(self.gram):
            for key in (gram | OTHER, gram):
                at = np.minimum(np.searchsorted(self.gram, key), len(self.gram) - 1)
                ratio = np.where(self.gram[at] == key, self.ratio[at], ratio)
        ends = np.cumsum(letters + 1)
        return np.add.reduceat(ratio, np.r_[0, ends[:-1]]) / SCALE if len(words) else np.zeros(0), letters

    def judge(self):
        """A function from texts to their features; it remembers words."""
        place: dict[bytes, int] = {}
        known = [np.zeros((0, 2))]

        def features(texts: list[bytes]) -> np.ndarray:
            if len(place) > REMEMBERED:
                place.clear()
                known[:] = [np.zeros((0, 2))]
            words = [words_of(t) for t in texts]
            fresh = sorted(set().union(*words).difference(place))
            if fresh:
                place.update(zip(fresh, range(len(place), len(place) + len(fresh))))
                known[:] = [np.concatenate([known[0], np.stack(self.of_words(fresh), axis=1)])]
            at = np.fromiter((place[w] for ws in words for w in ws), np.int64)
            cuts = np.cumsum([len(w) for w in words])[:-1]
            return np.array([_features(x[:, 0], x[:, 1]) for x in np.split(known[0][at], cuts)]).reshape(len(texts), 3)

        return features


def _features(ratio: np.ndarray, letters: np.ndarray) -> tuple[float, float, float]:
    """Length-normalised log ratio of the text, of its worst word, and the mean of that of its three worst words."""
    if not len(ratio):
        return 0.0, 0.0, 0.0
    by_word = ratio / (letters + STIFF)
    worst = np.partition(by_word, max(0, len(by_word) - 3))[-3:]
    return ratio.sum() / (letters + 1).sum(), worst.max(), np.maximum(worst, 0).sum() / 3


def judged(docs: DataFrame, ratios: DataFrame, rows: int, fields: list[T.StructField], compute, text_col: str = "text", model: int = 2, most: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with ``fields``, which ``compute`` gives from the features of the texts under a model of ``rows`` rows.

    A model of at most ``most`` rows is broadcast, and nothing is shuffled; a larger one is joined with the texts.
    """
    if rows > most:
        return joined(docs, ratios, fields, compute, text_col, model)
    got = ratios.select("gram", f"m{model}").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(Ratios(got.column(0).to_numpy(), got.column(1).to_numpy()))
    del got
    release()  # the broadcast has a copy in a file; the driver's Python needs none

    def factory():
        features = shared.value.judge()
        return lambda texts: compute(features(texts))

    return append_columns(docs, text_col, fields, factory)


def joined(docs: DataFrame, ratios: DataFrame, fields: list[T.StructField], compute, text_col: str = "text", model: int = 2) -> DataFrame:
    """The same without a broadcast, for models of any size.

    Rows are dealt by a hash of their place in the table, so that rows that repeat part too, into chunks of about CHUNK
    bytes; a chunk is joined with the ratios of its own letter groups, so that no task holds the model.
    """
    given = without(docs, [f.name for f in fields])
    at = place_of(given, text_col)
    docs = given.toDF(*[f"c{i}" for i in range(len(given.columns))])
    text_col = f"c{at}"
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The place is kept before it is used twice: a row recomputed may be numbered anew.
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(parts, size // CHUNK)))
    dealt = kept(docs.withColumn("chunk", chunk), "dealt").repartition("chunk")
    names = docs.columns

    def distinct(batches):
        held: dict[int, set] = {}

        def rows():
            for chunk, words in held.items():
                gram = np.unique(word_grams(sorted(words))[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), chunk)), pa.array(gram)], names=["chunk", "gram"])
            held.clear()

        for b in (part for whole in batches for part in text_slices(whole, at)):
            for t, chunk in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column("chunk").to_pylist()):
                held.setdefault(chunk, set()).update(words_of(t or b""))
            if sum(map(len, held.values())) > REMEMBERED:
                yield from rows()
        yield from rows()
        release()

    grams = dealt.mapInArrow(distinct, "chunk long, gram long").distinct()
    r = ratios.select(F.col("gram").alias("of"), F.col(f"m{model}").alias("ratio"))
    # A text asks for its groups and for the others of their contexts; only those with a row come back.
    asked = grams.unionByName(grams.select("chunk", F.col("gram").bitwiseOR(OTHER).alias("gram"))).distinct()
    known = asked.join(r, F.col("gram") == F.col("of")).select("chunk", "gram", "ratio")
    arrow = to_arrow_schema(T.StructType(fields))

    def judge(rows: pa.Table, known: pa.Table) -> pa.Table:
        features = Ratios(known.column("gram").to_numpy(), known.column("ratio").to_numpy()).judge()
        x = features([t or b"" for t in rows.column(at).cast(pa.binary()).to_pylist()])
        return pa.table([*(rows.column(n) for n in names), *(pa.array(c, type=f.type) for c, f in zip(compute(x), arrow))], names=[*names, *arrow.names])

    return dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(judge, T.StructType([*docs.schema.fields, *fields])).toDF(*given.columns, *arrow.names)


class ToxicityModel:
    """Log ratios learnt from all training documents, a table of so many rows, and the calibration of the features."""

    def __init__(self, ratios: DataFrame, rows: int, calibration: Logistic):
        self.ratios, self.rows, self.calibration = ratios, rows, calibration


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """A model from every labelled document that is not held out.

    Its three numbers are calibrated on ``per_class`` documents a class, each half judged by what the other fold
    teaches. Without labels of both classes every score is the share of toxic labels (one half without any).
    """
    share = class_share(labels, "toxic", MODULUS, HELD_OUT)
    counts = kept(gram_counts(training_documents(docs, labels, "toxic", MODULUS, HELD_OUT)), "counts")
    ratios = kept(log_ratios(counts), "ratios")
    rows = ratios.count()
    sample = training_sample(docs, labels, "toxic", MODULUS, HELD_OUT, per_class)
    fields = [T.StructField(c, T.DoubleType()) for c in "abc"]
    halves = [judged(sample.where(F.col("fold") == 1 - m), ratios, rows, fields, lambda x: list(x.T), model=m).select("doc_id", "label", *"abc").toArrow() for m in (0, 1)]
    got = pa.concat_tables(halves).sort_by([(c, "ascending") for c in ("doc_id", "a", "b", "c")])
    x = np.stack([got.column(c).to_numpy() for c in "abc"], axis=1)
    return ToxicityModel(ratios, rows, Logistic(x, got.column("label").to_numpy(), share))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, from 0 to 1; null and empty texts score like a text without words."""
    calibration = model.calibration
    return judged(docs, model.ratios, model.rows, [T.StructField(out, T.DoubleType())], lambda x: [calibration(x)], text_col)


def predictions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; repeated rows have equal results.

    Null and empty texts score like a text without words; an empty table gives no rows; labels of ids that are not in
    ``docs`` teach nothing; a null id is not held out by a remainder and its ``held_out`` is null.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = score(d, train(d, labels))
    return scored.select("doc_id", (id_remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
