"""Language-model scores from a subword lattice.

Pieces and their order come from an existing subword vocabulary; their first scores follow
its ranks. One round of expectation-maximisation over all training words re-weights them
(``rounds``). A word's probability is the sum over all its segmentations into pieces, by a
forward recursion in log space; segments don't cross blanks, so a document's marginal
probability is the product over its words and one end piece, and each distinct word of the
corpus is scored once.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuskit.llm.common import blank_words, prepare, residue, rows_of, stored

#: So many frequent training words (of at most ``HEAD_BYTES``) are sent to every task; the
#: other words of a document are joined.
HEAD, HEAD_BYTES = 200_000, 64
#: Distinct words that a task holds before it passes its counts on.
HELD_WORDS = 1 << 20
#: Words of at most so many letters keep their arcs between the two passes of a round.
HELD_LETTERS = 1 << 12
#: Words of at most so many letters are swept together, up to so many letters of them at once.
MODERATE, HELD_AT_ONCE = 128, 1 << 18
SMOOTHING = 0.1
START = "▁"
LOG10 = math.log(10)


def first_scores(model_file: str) -> dict[str, float]:
    """Log scores by piece from the vocabulary's ranks (Zipf's law); control pieces left out."""
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=model_file)
    ranks = {model.id_to_piece(i): i for i in range(model.get_piece_size())
             if not (model.is_control(i) or model.is_unknown(i))}
    weights = {p: 1 / (r + 10) for p, r in ranks.items()}
    weights["</s>"] = 1 / 10
    total = math.log(sum(weights.values()))
    return {p: math.log(w) - total for p, w in weights.items()}


class Lattice:
    """Sums over all segmentations of a word; memory grows with its length times the longest piece at most."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        #: A score for each piece and None for each proper beginning of one, so a search knows when to stop.
        self.reach: dict[str, float | None] = {p[:n]: None for p in scores if not p.startswith("<0x")
                                               for n in range(1, len(p))}
        self.reach.update((p, s) for p, s in scores.items() if not p.startswith("<0x"))
        self.byte = {bytes([b]): f"<0x{b:02X}>" for b in range(256)}
        # the same beginnings as a table (node, letter) -> node, sorted, for many words at once
        self.pieces = ["", *self.reach]
        node = {p: i for i, p in enumerate(self.pieces)}
        keys = np.array([node[p[:-1]] << 21 | ord(p[-1]) for p in self.reach], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = np.append(keys[order], -1), np.append(order + 1, 0)
        self.node_score = np.array([np.nan] + [np.nan if x is None else x for x in self.reach.values()])

    def spelled(self, letter: str) -> tuple[str, ...]:
        """The byte pieces of a character that is no piece."""
        return tuple(self.byte[bytes([b])] for b in letter.encode())

    def arcs(self, word: str, start: int) -> list[tuple[int, float, str | None]]:
        """(end, log score, piece) of what can begin at ``start``; the piece is None for spelled bytes."""
        reach, out, alone = self.reach, [], True
        for end in range(start + 1, len(word) + 1):
            piece = word[start:end]
            score = reach.get(piece, 0.0)
            if score is None:
                continue
            if score == 0.0 and piece not in reach:
                break
            out.append((end, score, piece))
            alone = alone and end != start + 1
        if alone:
            out.append((start + 1, sum([self.scores[p] for p in self.spelled(word[start])]), None))
        return out

    @staticmethod
    def _add(terms: list[float]) -> float:
        if len(terms) == 1:
            return terms[0]
        top = max(terms)
        return top + math.log(sum([math.exp(t - top) for t in terms]))

    def log_probability(self, word: str) -> float:
        """The forward recursion; sums that the longest piece has left behind are let go."""
        word, reach, waiting = START + word, self.reach, {0: [0.0]}
        n = len(word)
        for start in range(n):
            here, alone = self._add(waiting.pop(start)), True
            for end in range(start + 1, n + 1):
                piece = word[start:end]
                if piece not in reach:
                    break
                score = reach[piece]
                if score is not None:
                    alone = alone and end != start + 1
                    if end in waiting:
                        waiting[end].append(here + score)
                    else:
                        waiting[end] = [here + score]
            if alone:
                score = sum([self.scores[p] for p in self.spelled(word[start])])
                waiting.setdefault(start + 1, []).append(here + score)
        return self._add(waiting[n])

    def expect(self, word: str, times: float, counts: dict[str, float]) -> None:
        """Add the expected number of each piece in ``times`` occurrences.

        Two passes over the positions, forward and backward; a long word's arcs are found again
        in the second one and not held.
        """
        word = START + word
        n, at = len(word), partial(self.arcs, word)
        if n <= HELD_LETTERS:
            at = [at(i) for i in range(n)].__getitem__
        alpha, waiting = array("d", [0.0]) * (n + 1), {0: [0.0]}
        for start in range(n):
            here = alpha[start] = self._add(waiting.pop(start))
            for end, score, _ in at(start):
                waiting.setdefault(end, []).append(here + score)
        alpha[n] = whole = self._add(waiting[n])
        beta, exp = array("d", [0.0]) * (n + 1), math.exp
        for start in range(n - 1, -1, -1):
            terms, here = [], alpha[start] - whole
            for end, score, piece in at(start):
                rest = score + beta[end]
                terms.append(rest)
                share = times * exp(here + rest)
                for p in (piece,) if piece else self.spelled(word[start]):
                    counts[p] = counts.get(p, 0.0) + share
            beta[start] = self._add(terms)


    def _graph(self, words: list[str]):
        """All arcs of all words as arrays, and the slots: a word of n letters has n + 1 in a row.

        Of each arc its (start slot, end slot, score, node, letter); node 0 is a character spelled
        in bytes. Beginnings are followed letter by letter, all positions at once.
        """
        n = np.array([len(START + w) for w in words])
        codes = np.frombuffer("".join(START + w for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
        of, first = np.repeat(np.arange(len(words)), n), np.cumsum(n) - n
        room, slot = (first + n)[of] - np.arange(len(codes)), np.arange(len(codes)) + of
        at, node, arcs, bare, length = np.arange(len(codes)), np.zeros(len(codes), np.int64), [], None, 0
        while len(at):
            key = node << 21 | codes[at + length]
            i = np.searchsorted(self.keys[:-1], key)
            hit = self.keys[i] == key
            at, node, length = at[hit], self.child[i[hit]], length + 1
            piece = ~np.isnan(self.node_score[node])
            arcs.append((slot[at[piece]], slot[at[piece]] + length, self.node_score[node[piece]], node[piece]))
            if bare is None:
                bare = np.ones(len(codes), bool)
                bare[at[piece]] = False
            more = room[at] > length
            at, node = at[more], node[more]
        bare = np.flatnonzero(bare)
        letters, which = np.unique(codes[bare], return_inverse=True)
        own = np.array([sum([self.scores[p] for p in self.spelled(chr(c))]) for c in letters])
        arcs.append((slot[bare], slot[bare] + 1, own[which], np.zeros(len(bare), np.int64)))
        start, end, score, node = (np.concatenate(x) for x in zip(*arcs))
        letter = np.concatenate([np.zeros(len(start) - len(bare), np.int64), codes[bare]])
        slots = first + np.arange(len(words))
        place = np.arange(len(codes) + len(words)) - np.repeat(slots, n + 1)
        return start, end, score, node, letter, slots, n, place

    @staticmethod
    def _sweep(sums: np.ndarray, into, from_, score, step) -> None:
        """sums[into] = log of the sum of exp(sums[from_] + score), one ``step`` after the other."""
        order = np.lexsort((into, step))
        into, from_, score, step = into[order], from_[order], score[order], step[order]
        bounds = np.flatnonzero(np.diff(step, prepend=step[0] - 1))
        for lo, hi in zip(bounds, np.append(bounds[1:], len(step))):
            slots, terms = into[lo:hi], sums[from_[lo:hi]] + score[lo:hi]
            runs = np.flatnonzero(np.diff(slots, prepend=-1))
            top = np.maximum.reduceat(terms, runs)
            run = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(slots))))
            sums[slots[runs]] = top + np.log(np.add.reduceat(np.exp(terms - top[run]), runs))

    def log_probabilities(self, words: list[str]) -> list[float]:
        """As ``log_probability``, for many words of moderate length together."""
        if not words:
            return []
        start, end, score, _, _, slots, n, place = self._graph(words)
        alpha = np.zeros(len(place))
        self._sweep(alpha, end, start, score, place[end])
        return alpha[slots + n].tolist()

    def expect_all(self, words: list[str], times: list[int], counts: dict[str, float]) -> None:
        """As ``expect``, for many words of moderate length together."""
        if not words:
            return
        start, end, score, node, letter, slots, n, place = self._graph(words)
        alpha, beta = np.zeros(len(place)), np.zeros(len(place))
        self._sweep(alpha, end, start, score, place[end])
        self._sweep(beta, start, end, score, -place[start])
        word = np.searchsorted(slots, start, side="right") - 1
        share = np.array(times, float)[word] * np.exp(alpha[start] + score + beta[end] - alpha[slots + n][word])
        whole = np.bincount(node, share, len(self.pieces))
        for i in np.flatnonzero(whole[1:]) + 1:
            counts[self.pieces[i]] = counts.get(self.pieces[i], 0.0) + float(whole[i])
        letters, which = np.unique(letter[node == 0], return_inverse=True)
        for c, x in zip(letters, np.bincount(which, share[node == 0], len(letters))):
            for p in self.spelled(chr(c)):
                counts[p] = counts.get(p, 0.0) + float(x)


def _held(batches, letters: int = HELD_AT_ONCE):
    """(short words, their counts, long words, their counts): the rows of several batches together."""
    short, long_, size = ([], []), ([], []), 0
    for rows in rows_of(batches, "token", "c"):
        for token, c in rows:
            word = token.decode()
            side = short if len(word) <= MODERATE else long_
            side[0].append(word)
            side[1].append(c)
            size += len(word) + 1
            if size > letters:
                yield *short, *long_
                short, long_, size = ([], []), ([], []), 0
    yield *short, *long_


def word_counts(docs: DataFrame, text: str, trains: str) -> DataFrame:
    """(token, c): how often each word of any text occurs in the training texts."""
    def count(batches):
        train, others = Counter(), set()

        def out():
            rows = [*train.items(), *((w, 0) for w in others if w not in train)]
            for at in range(0, len(rows), 50_000):
                words, n = zip(*rows[at:at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())],
                                                 names=["token", "c"])
            train.clear()
            others.clear()

        for batch in batches:
            for t, learn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (train if learn else others).update(blank_words(t))
                if len(train) + len(others) > HELD_WORDS:
                    yield from out()
        yield from out()

    part = docs.select(text, trains).mapInArrow(count, "token binary, c bigint")
    return part.groupBy("token").agg(F.sum("c").alias("c"))


def reweighted(words: DataFrame, scores: dict[str, float], ends: int) -> dict[str, float]:
    """One round of expectation-maximisation; what reaches the driver is one number per piece."""
    def expected(batches):
        model, counts = Lattice(scores), {}
        for words_, times, long_, long_times in _held(batches):
            model.expect_all(words_, times, counts)
            for w, c in zip(long_, long_times):
                model.expect(w, c, counts)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.float64())],
                                         names=["piece", "n"])
    found = {r["piece"]: r["n"] for r in words.filter("c > 0").mapInArrow(expected, "piece string, n double")
             .groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    found["</s>"] = float(ends)
    total = math.log(sum(found.values()) + SMOOTHING * len(scores))
    return {p: math.log(found.get(p, 0.0) + SMOOTHING) - total for p in scores}


def score_texts(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text",
                held_out: tuple[int, int] = (7, 2), rounds: int = 1, head: int = HEAD) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows whose crc32(key) leaves remainder ``held_out[1]`` modulo ``held_out[0]`` teach
    nothing. Null and empty texts consist of the end alone. Rows with equal or null keys
    stay apart. Words and their counts are spread over the cluster; the driver sees the
    vocabulary's weights and ``head`` frequent words.
    """
    spark = prepare(docs.sparkSession)
    modulus, rest = held_out
    docs = docs.select(F.col(key), F.col(text), (residue(F.col(key), modulus) == rest).alias("held_out"))
    words = stored(word_counts(docs.withColumn("_train", ~F.col("held_out")), text, "_train"), "words")
    ends = docs.filter(~F.col("held_out")).count()
    sums = words.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = sums[0] + ends, sums[1] + (ends > 0)
    scores = first_scores(model_file)
    for _ in range(rounds):
        scores = reweighted(words, scores, ends)
    end_score = scores["</s>"] / LOG10

    def scored(batches):
        model = Lattice(scores)
        for short, times, long_, long_times in _held(batches):
            tokens, counts = short + long_, times + long_times
            lattice = model.log_probabilities(short) + [model.log_probability(w) for w in long_]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.encode() for w in tokens], pa.binary()), pa.array([c > 0 for c in counts], pa.bool_()),
                 pa.array([math.log10(c + 1) for c in counts], pa.float64()),
                 pa.array([x / LOG10 for x in lattice], pa.float64()),
                 pa.array(counts, pa.int64())], names=["token", "known", "base", "lattice", "c"])

    weights = stored(words.mapInArrow(scored, "token binary, known boolean, base double, lattice double, c bigint"),
                     "word-scores")
    frequent = (weights.filter((F.col("c") > 1) & (F.octet_length("token") <= HEAD_BYTES))
                .orderBy(F.desc("c"), "token").limit(head).select("token", "base", "lattice"))
    known = spark.sparkContext.broadcast({bytes(r[0]): (r[1], r[2]) for r in frequent.toLocalIterator()})

    def summed(batches):
        table = known.value
        for batch in batches:
            n, sure, base, lattice, rare, times = [], [], [], [], [], []
            for t in batch.column(1).to_pylist():
                words_, k, b, s, r, m = blank_words(t), 0, 0.0, 0.0, [], []
                for w, c in Counter(words_).items():
                    hit = table.get(w)
                    if hit is None:
                        r.append(w)
                        m.append(c)
                    else:
                        k += c
                        b += c * hit[0]
                        s += c * hit[1]
                n.append(len(words_) + 1)
                for side, v in ((sure, k), (base, b), (lattice, s), (rare, r), (times, m)):
                    side.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sure, pa.int64()),
                 pa.array(base, pa.float64()), pa.array(lattice, pa.float64()), pa.array(rare, pa.list_(pa.binary())),
                 pa.array(times, pa.list_(pa.int64()))],
                names=[key, "held_out", "n_tokens", "sure", "b", "s", "rare", "times"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text, "held_out").mapInArrow(
        summed, f"`{key}` {kind}, held_out boolean, n_tokens bigint, sure bigint, b double, s double, "
                "rare array<binary>, times array<bigint>")
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "text-sums")
    rare = (rows.select(F.col("_row").alias("_of"), F.explode(F.arrays_zip("rare", "times")).alias("m"))
            .select("_of", F.col("m.rare").alias("token"), F.col("m.times").alias("times"))
            .join(weights.select("token", "known", "base", "lattice"), "token")
            .groupBy("_of").agg(F.sum(F.when(F.col("known"), F.col("times")).otherwise(0)).alias("k2"),
                                F.sum(F.col("times") * F.col("base")).alias("b2"),
                                F.sum(F.col("times") * F.col("lattice")).alias("s2")))
    out = rows.drop("rare", "times").join(rare, F.col("_row") == F.col("_of"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        key, "held_out", "n_tokens",
        (F.col("sure") + zero("k2") + F.lit(int(ends > 0))).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("b") + zero("b2") + F.lit(math.log10(ends + 1))
         - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        (F.col("s") + zero("s2") + F.lit(end_score)).alias("score"))
