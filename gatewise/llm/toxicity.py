"""Toxicity by a weighted finite-state grammar over clauses.

Every word of a clause is read as a symbol: an insult, a threat, a target, a negation, a reporting verb, or other. Small
transducers rewrite the symbols from left to right and are composed into one machine:

- negation:   an insult or threat up to ``REACH`` words behind a negation becomes a denied one;
- reported:   behind a reporting verb of the clause, or between quotation marks, it becomes a reported one;
- target:     an insult up to ``REACH`` words behind a target, or a target as near behind an insult, is aimed.

The composed machine turns each clause into matched patterns (plain, aimed, denied, reported, threat). A pattern's
strength is the weight of the word that set it off; a clause counts once for each kind of pattern, with its strongest match.
A document is scored by the sums of its clauses' strengths, weighted by a small logistic model.

Closed classes are word lists below. Insults are learned from labelled rows: a word, or the beginning of 4 to 8 bytes
that related words share, weighs the lower bound of its log odds between toxic and other texts. It must be found
next to several different words: what is only ever seen in the same place belongs to a passage that was copied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewise.llm.common import _BASE, _BYTE, _Powers, list_array, query, slices, table, window_hash

# ---- symbols ------------------------------------------------------------------------------------------------

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, AIMED, DENIED, REPORTED, AIM_BACK = range(11)
SYMBOLS = 11
#: Patterns that a clause can hold.
KINDS = (INSULT, AIMED, DENIED, REPORTED, THREAT)

# Closed word classes of English, German, French and Spanish, lower case.
NEGATIONS = "not never no nobody isn't aren't don't nicht kein keine keinen nie niemals pas jamais aucun aucune ne nunca jamás tampoco ningún ninguna"
REPORTS = "said says called calls wrote quoted claimed alleged according sagte sagt nannte schrieb behauptete laut dit disait appelait écrit selon dijo dice llamó escribió según"
TARGETS = "you your you're yourself they them he she du dich dir euch ihr sie tu toi vous vos eux ils elle usted ustedes ellos vosotros"
THREATS = "kill hurt destroy beat stab shoot burn crush töten schlagen vernichten umbringen tuer frapper brûler détruire matar golpear destruir quemar"
QUOTES = '"“”„«»'

REACH = 3

# ---- transducers --------------------------------------------------------------------------------------------


class Transducer:
    """A letter-to-letter transducer: ``step[state, symbol]`` is the next state, ``tell[state, symbol]`` the symbol put
    out. A clause begins in state 0."""

    def __init__(self, states: int):
        self.step = np.tile(np.arange(states)[:, None], (1, SYMBOLS))
        self.tell = np.tile(np.arange(SYMBOLS), (states, 1))

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one puts out. A state is a pair of states."""
        n, m = len(self.step), len(other.step)
        out = Transducer(n * m)
        read = np.repeat(self.tell, m, axis=0)
        second = np.tile(np.arange(m), n)[:, None]
        out.step = np.repeat(self.step, m, axis=0) * m + other.step[second, read]
        out.tell = other.tell[second, read]
        return out


def within_reach(triggers: tuple[int, ...], rewrites: dict[int, int]) -> Transducer:
    """Rewrites symbols up to ``REACH`` symbols behind a trigger; the state is how far it still reaches."""
    t = Transducer(REACH + 1)
    t.step[:] = np.maximum(np.arange(REACH + 1) - 1, 0)[:, None]
    t.step[:, list(triggers)] = REACH
    for a, b in rewrites.items():
        t.tell[1:, a] = b
    return t


def reported_speech() -> Transducer:
    """0: own words; 1: behind a reporting verb, to the end of the clause; 2: between quotation marks."""
    t = Transducer(3)
    t.step[0, REPORT] = 1
    t.step[0, QUOTE] = t.step[1, QUOTE] = 2
    t.step[2, QUOTE] = 0
    for a in (INSULT, THREAT, AIMED):
        t.tell[1:, a] = REPORTED
    return t


def aimed_back() -> Transducer:
    """A target near behind an insult turns that insult into an aimed one; told at the target."""
    return within_reach((INSULT,), {TARGET: AIM_BACK})


def grammar() -> Transducer:
    parts = [
        within_reach((NEGATION,), {INSULT: DENIED, THREAT: DENIED}),
        reported_speech(),
        aimed_back(),
        within_reach((TARGET, AIM_BACK), {INSULT: AIMED}),
    ]
    machine = parts[0]
    for part in parts[1:]:
        machine = machine.then(part)
    return machine


# ---- words --------------------------------------------------------------------------------------------------

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(48, 58), 39, *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?\n|"]] = True
STEMS = (4, 5, 6, 7, 8)
_WHOLE = np.uint64(0xA5A5F00D5EED1234)


def lowered(column: pa.Array) -> pa.Array:
    """Lower case, and curly quotation marks, which are letters to a byte-wise reader, as plain ones."""
    return pc.replace_substring_regex(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")), f"[{QUOTES}]", '"')


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first of each text) of runs of letters, digits and apostrophes."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def entries(powers: _Powers, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, their entry): beginnings of each length, short to long, then whole words."""
    coded = _BYTE[data]
    for size in STEMS:
        at = np.flatnonzero(ends - starts > size)
        yield at, window_hash(coded, starts[at], starts[at] + size, powers)
    yield np.arange(len(starts)), window_hash(coded, starts, ends, powers) ^ _WHOLE


def word_entries(words: str) -> np.ndarray:
    data = np.frombuffer(words.encode(), np.uint8)
    starts, ends, _ = spans(data, np.array([0, len(data)]))
    return np.sort(window_hash(_BYTE[data], starts, ends, _Powers(_BASE)) ^ _WHOLE)


def _among(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Place in the sorted ``keys`` of each one of ``found``, or -1."""
    if not len(keys):
        return np.full(len(found), -1)
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    return np.where(keys[at] == found, at, -1)


# ---- model --------------------------------------------------------------------------------------------------

#: Labelled rows that training sees at most, and entries of the lexicon at most.
TRAIN_ROWS, LEXICON = 24_000, 60_000
LEAST_DOCS, LEAST_PLACES, LEAST_WEIGHT, CAUTION = 3, 3, 0.5, 1.0
THRESHOLD = 0.3
_FILTER = 1 << 20


def log_odds(p: np.ndarray, n: np.ndarray, toxic: float, other: float) -> np.ndarray:
    """Lower bound of an entry's log odds from the texts of both labels that hold it."""
    p, n = p + 0.5, n + 0.5
    return np.log(p / (toxic + 1)) - np.log(n / (other + 1)) - CAUTION * np.sqrt(1 / p + 1 / n)


class Lexicon:
    """Entries with their counts and weights, and a bitmap in front of them."""

    def __init__(self, keys: np.ndarray, p: np.ndarray, n: np.ndarray, toxic: int, other: int):
        order = np.argsort(keys)
        self.keys, self.p, self.n = keys[order], p[order].astype(float), n[order].astype(float)
        self.toxic, self.other = toxic, other
        self.maybe = np.zeros(_FILTER, bool)
        self.maybe[(self.keys & np.uint64(_FILTER - 1)).astype(np.int64)] = True
        self.weight = log_odds(self.p, self.n, toxic, other)

    def place(self, found: np.ndarray) -> np.ndarray:
        out = np.full(len(found), -1)
        may = np.flatnonzero(self.maybe[(found & np.uint64(_FILTER - 1)).astype(np.int64)])
        out[may] = _among(self.keys, found[may])
        return out

    def weights(self, label: float | None) -> np.ndarray:
        """Weights as a text of this label would find them if it had not been counted itself."""
        if label is None:
            return self.weight
        one = label == 1
        return log_odds(np.maximum(self.p - one, 0), np.maximum(self.n - (not one), 0), self.toxic - one, self.other - (not one))


class Matcher:
    """Runs the grammar over the clauses that hold an insult or a threat; others match nothing."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.machine, self.powers = lexicon, grammar(), _Powers(_BASE)
        self.closed = [(s, word_entries(w)) for s, w in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS))]

    def strengths(self, data: np.ndarray, offsets: np.ndarray, labels: list | None = None) -> np.ndarray:
        """Per text: for each kind of pattern the sum of its clauses' strengths, and the number of words."""
        starts, ends, first = spans(data, offsets)
        n = len(offsets) - 1
        owner = np.repeat(np.arange(n), np.diff(first))
        weight, symbol = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
        tables = {None: self.lexicon.weight} if labels is None else {y: self.lexicon.weights(y) for y in set(labels)}
        mine = None if labels is None else np.array([y == 1 for y in labels])
        for at, keys in entries(self.powers, data, starts, ends):
            place = self.lexicon.place(keys)
            hit = place >= 0
            at, place = at[hit], place[hit]
            if labels is None:
                w = tables[None][place]
            else:
                w = np.where(mine[owner[at]], tables.get(1.0, self.lexicon.weight)[place], tables.get(0.0, self.lexicon.weight)[place])
            np.maximum.at(weight, at, w)
        symbol[weight > 0] = INSULT
        for s, known in self.closed:
            symbol[_among(known, keys) >= 0] = s  # the last entries are the whole words
        weight[symbol == THREAT] = 1.0
        out = np.zeros((n, len(KINDS) + 1))
        out[:, -1] = np.diff(first)
        stops = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_STOP[data], out=stops[1:])
        quotes = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == 34, out=quotes[1:])
        clause = stops[starts] + owner
        hits = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
        for c in np.unique(clause[hits]):
            lo, hi = np.searchsorted(clause, [c, c + 1])
            found = self._clause(symbol[lo:hi], weight[lo:hi], np.diff(quotes[starts[lo:hi]], prepend=quotes[starts[lo]]))
            out[owner[lo], :-1] += found
        return out

    def _clause(self, symbols: np.ndarray, weights: np.ndarray, quotes: np.ndarray) -> np.ndarray:
        step, tell = self.machine.step, self.machine.tell
        state, matches = 0, []
        for s, w, q in zip(symbols.tolist(), weights.tolist(), quotes.tolist()):
            for _ in range(q & 1):
                state = step[state, QUOTE]
            told, state = tell[state, s], step[state, s]
            if told == AIM_BACK:
                if matches and matches[-1][0] == INSULT:
                    matches[-1] = (AIMED, matches[-1][1])
            elif told in KINDS:
                matches.append((told, w))
        return np.array([max((w for k, w in matches if k == kind), default=0.0) for kind in KINDS])


def shape(strengths: np.ndarray) -> np.ndarray:
    """Model inputs: damped sums, and the share of all strength in the words."""
    total = strengths[:, :-1].sum(1)
    return np.column_stack([np.log1p(strengths[:, :-1]), np.log1p(total), np.log1p(1000 * total / (strengths[:, -1] + 20))])


class Model:
    """Lexicon, and the weights of the patterns."""

    def __init__(self, lexicon: Lexicon, bias: float, weights: np.ndarray):
        self.lexicon, self.bias, self.weights = lexicon, bias, weights

    def score(self, strengths: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + shape(strengths) @ self.weights, -30, 30)))


def fit_patterns(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> tuple[float, np.ndarray]:
    """Logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge * max(len(x), 1)] * (x.shape[1] - 1)) / 10
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - penalty @ beta
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(beta)), slope)
    return float(beta[0]), beta[1:]


def learnable(id: Column) -> Column:
    """False for the held-out fold: rows whose crc32 of the id as text leaves 2 when divided by 4. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(4)) != 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, text: str, id: str, max_rows: int) -> DataFrame:
    """(order, text, label) of at most ``max_rows`` rows outside the held-out fold, the first by hash of their ids."""
    chosen = (labels.select(labels[id].alias("l_id"), (labels[label].cast("double") > 0.5).cast("double").alias("label"))
              .where(F.col("label").isNotNull() & learnable(F.col("l_id")))
              .groupBy("l_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("l_id"), "l_id").limit(max_rows))
    return docs.select(docs[id].alias("l_id"), docs[text].alias("text")).join(F.broadcast(chosen), "l_id").select(F.xxhash64("l_id").alias("order"), "text", "label")


def _count_entries(rows: DataFrame) -> DataFrame:
    """(key, p, n): texts of both labels that hold an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers(_BASE)
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False) == 1
            for lo, data, offsets in slices(lowered(batch.column(0)), 4 << 20):
                starts, ends, first = spans(data, offsets)
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                for at, keys in entries(powers, data, starts, ends):
                    order = np.lexsort((owner[at], keys))
                    k, o = keys[order], owner[at][order]
                    once = np.ones(len(k), bool)
                    once[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
                    k, t = k[once], toxic[lo + o[once]]
                    new = np.ones(len(k), bool)
                    new[1:] = k[1:] != k[:-1]
                    if not len(k):
                        continue
                    begin = np.flatnonzero(new)
                    p, size = np.add.reduceat(t.astype(np.int64), begin), np.diff(np.append(begin, len(k)))
                    yield pa.RecordBatch.from_arrays([pa.array(k[begin].view(np.int64)), pa.array(p), pa.array(size - p)], ["key", "p", "n"])

    return rows.select("text", "label").mapInArrow(run, "key long, p long, n long").groupBy("key").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def _places(rows: DataFrame, keys) -> DataFrame:
    """(key, places): next to how many different words toxic texts hold each of the ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers(_BASE)
        for batch in batches:
            for _, data, offsets in slices(lowered(batch.column(0)), 4 << 20):
                starts, ends, _ = spans(data, offsets)
                every = list(entries(powers, data, starts, ends))
                whole = every[-1][1]
                before = np.concatenate([np.zeros(1, np.uint64), whole[:-1]]) if len(whole) else whole
                for at, found in every:
                    hit = np.flatnonzero(_among(keys.value, found) >= 0)
                    pairs = np.unique(np.column_stack([found[hit], before[at[hit]]]), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], ["key", "before"])

    met = rows.where("label = 1").select("text").mapInArrow(run, "key long, before long").distinct()
    return met.groupBy("key").agg(F.count("*").alias("places"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", id: str = "doc_id", max_rows: int = TRAIN_ROWS) -> Model:
    """A model fitted on at most ``max_rows`` labelled rows outside the held-out fold.

    Rows without a label or an id are not used; of repeated labels the highest counts. Without rows of both labels
    nothing is learned and every text scores the share of label 1, or 0 without any. Pattern weights are fitted on strengths that leave each
    text's own count out of its words' weights. The driver gets at most ``LEXICON`` entries and seven numbers a row.
    """
    spark = docs.sparkSession
    rows = labelled(docs, labels, label, text, id, max_rows)
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = size.get(1.0, 0), size.get(0.0, 0)
    nothing = Lexicon(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), toxic, other)
    if not toxic or not other:
        share = toxic / max(toxic + other, 1)
        return Model(nothing, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), np.zeros(len(KINDS) + 2))
    odds = F.log((F.col("p") + 0.5) / (toxic + 1)) - F.log((F.col("n") + 0.5) / (other + 1)) - CAUTION * F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    likely = _count_entries(rows).where(F.col("p") >= LEAST_DOCS).withColumn("w", odds).where(F.col("w") >= LEAST_WEIGHT)
    found = likely.orderBy(F.desc(F.col("w") * F.log1p("p")), "key").limit(LEXICON).toArrow()
    keys, p, n = (found[c].to_numpy() for c in ("key", "p", "n"))
    keys = keys.view(np.uint64)
    varied = _places(rows, spark.sparkContext.broadcast(np.sort(keys))).where(F.col("places") >= LEAST_PLACES).toArrow()
    places = dict(zip(varied["key"].to_numpy().view(np.uint64).tolist(), varied["places"].to_pylist()))
    p = np.minimum(p, [places.get(k, 0) for k in keys.tolist()])
    keep = (p >= LEAST_DOCS) & (log_odds(p, n, toxic, other) >= LEAST_WEIGHT)
    lexicon = Lexicon(keys[keep], p[keep], n[keep], toxic, other)
    shared = spark.sparkContext.broadcast(lexicon)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            label = batch.column(2).to_pylist()
            for lo, data, offsets in slices(lowered(batch.column(1))):
                x = matcher.strengths(data, offsets, label[lo : lo + len(offsets) - 1])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + len(x)], list_array(x.ravel(), np.full(len(x), x.shape[1])), batch.column(2)[lo : lo + len(x)]],
                                                 ["order", "x", "label"])

    sample = rows.mapInArrow(strengths, "order long, x array<double>, label double").orderBy("order").toArrow()
    x = np.array(sample["x"].to_pylist())
    return Model(lexicon, *fit_patterns(shape(x), sample["label"].to_numpy()))


def with_score(docs: DataFrame, model: Model, score: str, text: str = "text") -> DataFrame:
    """``docs`` with the toxicity of every whole text in a new column; a null text scores as the empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most LEXICON entries

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(shared.value.lexicon)
        for column in parts:
            out = np.zeros(len(column))
            for lo in range(0, len(column), 512):
                for at, data, offsets in slices(lowered(column[lo : lo + 512])):
                    x = matcher.strengths(data, offsets)
                    out[lo + at : lo + at + len(x)] = shared.value.score(x)
            yield pa.array(out)

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(score, F.arrow_udf(run, "double")(docs[text]))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    Null and empty texts score like a text without words. Null ids are held out; repeated rows score alike; very long
    texts are read whole; clashing columns are not read; an empty table gives an empty result.
    """
    model = train(docs, labels, text=text, id=id)
    scored = with_score(docs.select(docs[id].alias("id"), docs[text].alias("text")), model, "score")
    return scored.select(F.col("id").alias(id), (~learnable(F.col("id"))).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op11_pattern_toxicity")
def op11(spark, sf_dir):
    """Toxicity of every document."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
