"""Toxicity by class-conditional Kneser-Ney models.

Two models, toxic and ordinary, give every word a probability after the word
before it. Pairs are counted by document frequency over distinct texts; words and
beginnings by continuation, the number of distinct predecessors in the class. A
model takes an absolute discount from each expression (a word after its
predecessor, a word, a word's beginning) and hands it down the chain

    word after predecessor -> word -> beginnings of a word -> shared counts

Expressions of fewer than ``LEAST`` documents are wholly smoothed: all their
mass goes down, so that both models agree on what neither knows. The last step
of a word is its document frequency over the whole corpus, labelled or not,
which both share.

Toxic prose is ordinary prose with some toxic expressions in it, so the toxic
log-likelihood takes a word from the toxic model with probability ``SHARE`` and
from the ordinary one otherwise. The score compares it with the ordinary
log-likelihood, per word.

All labelled texts are counted. Every task holds the most frequent expressions
(``HEAD`` of a level); what touches rarer ones is joined with the whole tables.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxline.llm.common import discard, fold, stored, text_of
from boxline.llm.labelled import labelled_ids, labelled_texts, platt_of
from boxline.sources.session import new_path

LEAST = 4
DISCOUNT = 0.75
SHARE = 0.01
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.5
HEAD = {"pair": 800_000, "history": 300_000, "word": 300_000, **{str(n): 300_000 for n in BEGINNINGS}}

_WORD = re.compile(r"\w+")
_ASCII = {i: c.lower() if _WORD.match(c) else " " for i, c in enumerate(map(chr, range(128)))}
_START = ""  # stands before the first word
_SEEN = 100_000
_CHARACTERS = 12_000_000  # counted together before the shuffle
_VOCABULARY = 300_000


def words_of(text: str) -> list[str]:
    if text.isascii():  # the same words, in a third of the time
        return text.translate(_ASCII).split()
    return _WORD.findall(text.lower())


class _Numbers(dict):
    """Numbers new keys as they come."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


def _numbered(texts: list[str], numbers: dict) -> list[np.ndarray]:
    """Each text's words by number. Each word of a few texts is looked up once."""
    out: list[np.ndarray] = []
    for at in range(0, len(texts), 250):
        found = [words_of(text) for text in texts[at : at + 250]]
        codes = pa.array([w for words in found for w in words], pa.string()).dictionary_encode()
        distinct = codes.dictionary.to_pylist()
        ids = np.fromiter(map(numbers.__getitem__, distinct), np.int64, len(distinct))[codes.indices.to_numpy()]
        out += np.split(ids, np.cumsum([len(words) for words in found])[:-1])
    return out


_MARK = "\x01"  # no word has it


def _events(texts: list[str], targets: list[int]) -> Iterator[pa.RecordBatch]:
    """``word``, ``target``, ``histories`` and ``times``: document counts of the expressions of some texts.

    A word has one row, with its histories joined by spaces and the documents of
    each pair. Marked names among them are levels: the word's own documents, the
    sum over the words after it, and the beginnings that no other word here has,
    whose documents are the word's own. Other beginnings have their own rows.
    """
    numbers = _Numbers({_START: 0})
    ids = _numbered(texts, numbers)
    names, size = list(numbers), len(numbers)
    levels = [_MARK + level for level in ("word", "history", *map(str, BEGINNINGS))]

    def by_target(keys: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(2 * k + t for k, t in zip(keys, targets))])

    def batch(words: list[str], held: list[str], key: np.ndarray, place: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        """Rows by ``key`` (twice the word, and the target) from places among the held names."""
        order = np.argsort(key, kind="stable")
        key, place, times = key[order], place[order], times[order]
        at, first = np.unique(key, return_index=True)
        offsets = pa.array([*first, len(key)], pa.int32())
        histories = pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array(held, pa.string()).take(pa.array(place))), " ")
        columns = [pa.array(words, pa.string()).take(pa.array(at >> 1)), pa.array(at & 1, pa.int32()), histories, pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["word", "target", "histories", "times"])

    single = [np.unique(i) for i in ids]
    documents = np.bincount(by_target(single), minlength=2 * size)
    keys, times = np.unique(by_target([np.unique(i * size + np.concatenate([[0], i[:-1]])) if len(i) else i for i in ids]), return_counts=True)
    target, word, history = keys & 1, (keys >> 1) // size, (keys >> 1) % size
    follows = np.bincount(2 * history + target, weights=times, minlength=2 * size).astype(np.int64)
    found = [(2 * word + target, history, times)]
    for level, n in enumerate((documents, follows)):
        at = np.flatnonzero(n)
        found.append((at, np.full(len(at), size + level), n[at]))
    for level, n in enumerate(BEGINNINGS, 2):
        own = _Numbers({_START: 0})
        start = np.array([own[w[:n]] if len(w) > n else 0 for w in names])
        shared = np.bincount(start) > 1
        shared[0] = False
        at = np.flatnonzero(np.repeat((start > 0) & ~shared[start], 2) & (documents > 0))
        found.append((at, np.full(len(at), size + level), documents[at]))
        held = np.bincount(by_target([(k := np.unique(start[i]))[shared[k]] for i in single]), minlength=2)
        at = np.flatnonzero(held)
        yield batch(list(own), levels, at, np.full(len(at), level), held[at])
    yield batch(names, names + levels, *map(np.concatenate, zip(*found)))


def counts_of(sample: DataFrame, parts: int | None = None) -> DataFrame:
    """``start``, ``level``, ``history``, ``word``, ``toxic`` and ``ordinary``: documents of each class that hold the expression.

    Level ``history`` has the sums over the words after a history. Rows lie by
    ``start``, the first four letters of the word, so that all words of a
    beginning meet without moving again.
    """

    def run(batches):
        texts, targets, held = [], [], 0
        for batch in batches:
            for target, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.append(text)
                targets.append(target)
                held += len(text)
                if held > _CHARACTERS:
                    yield from _events(texts, targets)
                    texts, targets, held = [], [], 0
        if texts:
            yield from _events(texts, targets)

    events = sample.select("target", "text").mapInArrow(run, "word string, target int, histories string, times array<long>")
    placed = events.withColumn("start", F.substring("word", 1, BEGINNINGS[0]))
    placed = placed.repartition(parts, "start") if parts else placed.repartition("start")
    rows = placed.select("start", "word", "target", F.inline(F.arrays_zip(F.split("histories", " ").alias("history"), F.col("times").alias("n"))))
    marked = F.startswith("history", F.lit(_MARK))
    level = F.when(marked, F.substring("history", 2, 10)).otherwise("pair")
    word = F.when(level.isin(*map(str, BEGINNINGS)), F.substring("word", F.lit(1), level.cast("int"))).otherwise(F.col("word"))
    rows = rows.select("start", level.alias("level"), F.when(marked, "").otherwise(F.col("history")).alias("history"), word.alias("word"), "target", "n")
    of = lambda target, name: F.sum(F.when(F.col("target") == target, F.col("n")).otherwise(0)).alias(name)
    return rows.groupBy("start", "level", "history", "word").agg(of(1, "toxic"), of(0, "ordinary"))


def continuations(counts: DataFrame) -> DataFrame:
    """``level``, ``word``, ``toxic`` and ``ordinary``: distinct words of each class that a word, or any word of a beginning, follows.

    ``counts`` has one row per pair, so the first grouping only joins the words
    of a beginning. Both lie inside one ``start``.
    """
    seen = [(F.col(c) > 0).cast("long").alias(c) for c in ("toxic", "ordinary")]
    sums = [F.sum(c).alias(c) for c in ("toxic", "ordinary")]
    pairs = counts.where("level = 'pair'").select("start", "history", "word", *seen)
    words = pairs.groupBy("start", "word").agg(*sums).select(F.lit("word").alias("level"), "word", "toxic", "ordinary")
    beginnings = F.array(*(F.when(F.length("word") > n, F.struct(F.lit(str(n)).alias("level"), F.substring("word", 1, n).alias("word"))) for n in BEGINNINGS))
    to = pairs.where(F.length("word") > min(BEGINNINGS)).select("start", "history", F.explode(beginnings).alias("to"), "toxic", "ordinary").where("to is not null")
    once = to.groupBy("start", "to.level", "to.word", "history").agg(*(F.max(c).alias(c) for c in ("toxic", "ordinary")))
    return words.unionByName(once.groupBy("start", "level", "word").agg(*sums).drop("start"))


def corpus_words(docs: DataFrame, text: str, wanted: list[str] | None = None) -> DataFrame:
    """``word`` and ``documents``: how many documents of the whole corpus hold each word.

    With ``wanted``, the counts of these words, and one row without a word for
    the sum of all others. Counted by parts of many texts before the shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(None if wanted is None else set(wanted))

    def run(batches):
        kept = shared.value
        counts: Counter = Counter()

        def flush():
            words, documents = pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())
            counts.clear()
            return pa.RecordBatch.from_arrays([words, documents], ["word", "documents"])

        for batch in batches:
            for content in batch.column(0).to_pylist():
                words = set(words_of(content))
                if kept is not None:
                    held = words & kept
                    counts[None] += len(words) - len(held)
                    words = held
                counts.update(words)
                if len(counts) > _VOCABULARY:
                    yield flush()
        if counts:
            yield flush()

    found = docs.select(text_of(F.col(f"`{text}`")).alias("text")).mapInArrow(run, "word string, documents long")
    return found.groupBy("word").agg(F.sum("documents").alias("documents"))


class _Values:
    """Both models' values by expression."""

    def __init__(self, index: dict[str, int], values: np.ndarray):
        self.index, self.values = index, values

    def __getitem__(self, key: str) -> np.ndarray:
        return self.values[self.index[key]]


def assemble(lower: dict, histories: tuple, pairs: tuple, down: dict, complete: set[str]) -> dict:
    """Tables for scoring from columns: words or histories as lists, both models' values as arrays of two columns.

    ``lower`` has words and beginnings by level, ``complete`` the levels that are here as a whole.
    The histories and words of ``pairs`` are distinct names and an array of places among them.
    """
    numbers = _Numbers({_START: 0})
    for w in sorted({*lower["word"][0], *histories[0]}):
        numbers[w]
    coded = [np.fromiter(map(numbers.__getitem__, names), np.int64, len(names))[at] for names, at in pairs[:2]]
    numbers, size = dict(numbers), len(numbers)

    def by_number(words: list[str], values: np.ndarray, default: float) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        out, known = np.full((size, 2), default), np.zeros(size, bool)
        out[at], known[at] = values, True
        return out, known

    words, known_word = by_number(*lower["word"], 0.0)
    pair_down, known_history = by_number(*histories, 1.0)
    keys = coded[0] * size + coded[1]
    order = np.argsort(keys)
    tables = {
        "numbers": numbers, "words": _Values(numbers, words), "known_word": known_word, "known_history": known_history,
        "beginnings": {str(n): ({w: i for i, w in enumerate(lower[str(n)][0])}, lower[str(n)][1]) for n in BEGINNINGS},
        "down": down, "complete": complete, "pair_keys": keys[order], "pair_values": pairs[2][order], "pair_down": pair_down,
    }
    tables["values"], tables["open"] = _unpaired(tables, list(numbers), words, known_word)
    return tables


def _unpaired(tables: dict, names: list[str], own: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both models' probabilities of words as multiples of the shared one, and whether an expression in them may be missing here."""
    values, missing = np.ones((len(names), 2)), ~known & ("word" not in tables["complete"])
    for n in BEGINNINGS:
        (index, held), down = tables["beginnings"][str(n)], tables["down"][str(n)]
        longer = np.flatnonzero(np.fromiter((len(w) > n for w in names), bool, len(names)))
        at = np.fromiter((index.get(names[i][:n], -1) for i in longer), np.int64, len(longer))
        found = np.where((at >= 0)[:, None], held[at], 0.0) if len(held) else np.zeros((len(at), 2))
        values[longer] = found + np.array(down) * values[longer]
        if str(n) not in tables["complete"]:
            missing[longer[at < 0]] = True
    return own + np.array(tables["down"]["word"]) * values, missing


def estimate(kept: list[tuple[str, str, str, int, int]], totals: dict[tuple[str, str], tuple[int, int]], documents: dict[str, int], all_documents: int) -> dict:
    """Tables for scoring, from few counts; ``train`` makes the same in Spark.

    ``kept`` has the expressions of at least ``LEAST`` documents with their toxic
    and ordinary counts (pairs by documents, others by continuation), ``totals`` both sums over all expressions of a level and
    history, ``documents`` the corpus counts of kept words and ``all_documents``
    the sum of all words' corpus counts.
    """
    taken: dict[tuple[str, str], list[float]] = {}
    for level, history, _, *counts in kept:
        held = taken.setdefault((level, history), [0.0, 0.0])
        for c, n in enumerate(counts):
            held[c] += max(n - DISCOUNT, 0.0)

    def own(level: str, history: str, counts) -> list[float]:
        sums = totals[level, history]
        return [max(n - DISCOUNT, 0.0) / s if s else 0.0 for n, s in zip(counts, sums)]

    def handed_down(level: str, history: str) -> tuple[float, ...]:
        sums, held = totals.get((level, history), (0, 0)), taken.get((level, history), (0.0, 0.0))
        return tuple(1 - h / s if s else 1.0 for h, s in zip(held, sums))

    def relative(level: str, word: str, counts) -> list[float]:
        """A model's share of an expression, as a multiple of the shared probability."""
        shared = max(documents.get(word, 0), 1) / max(all_documents, 1) if level == "word" else sum(counts) / sum(totals[level, ""])
        return [p / shared for p in own(level, "", counts)]

    column = lambda rows: np.array(rows, float).reshape(-1, 2)
    lower = {level: [(w, relative(level, w, counts)) for at, _, w, *counts in kept if at == level] for level in (*map(str, BEGINNINGS), "word")}
    lower = {level: ([w for w, _ in rows], column([v for _, v in rows])) for level, rows in lower.items()}
    words = set(lower["word"][0])
    pairs = [(a, b, [p * max(all_documents, 1) / max(documents.get(b, 0), 1) for p in own("pair", a, counts)]) for level, a, b, *counts in kept if level == "pair" and a in words | {_START} and b in words]
    histories, seen = sorted({a for a, _, _ in pairs}), sorted(words)
    places = lambda names, column: (names, np.searchsorted(np.array(names, object), np.array(column, object)) if names else np.zeros(0, np.int64))
    return assemble(
        lower, (histories, column([handed_down("pair", a) for a in histories])), (places(histories, [a for a, _, _ in pairs]), places(seen, [b for _, b, _ in pairs]), column([v for *_, v in pairs])),
        {level: handed_down(level, "") for level in lower}, {"pair", "history", *lower},
    )


class Scorer:
    """Compares the two models over whole texts."""

    def __init__(self, tables: dict):
        self.tables = tables
        self._reset()

    def _reset(self) -> None:
        self.numbers = _Numbers(self.tables["numbers"])
        self.values, self.open = self.tables["values"], self.tables["open"]

    def _learn(self) -> None:
        """Values of the words that came up for the first time."""
        new = len(self.numbers) - len(self.values)
        if new:
            names = [w for w, _ in zip(reversed(self.numbers), range(new))][::-1]
            values, missing = _unpaired(self.tables, names, np.zeros((new, 2)), np.zeros(new, bool))
            self.values, self.open = np.concatenate([self.values, values]), np.concatenate([self.open, missing])

    def parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
        """Summed log-likelihood ratios and words of each text, and the pairs left out of the sum, as they need expressions that are not here."""
        tables = self.tables
        known, keys, complete = len(tables["numbers"]), tables["pair_keys"], tables["complete"]
        if len(self.values) > known + _SEEN:
            self._reset()
        numbered = _numbered(texts, self.numbers)
        self._learn()
        lengths = np.array([len(i) for i in numbered], np.int64)
        ids = np.concatenate([np.zeros(0, np.int64), *numbered])
        text = np.repeat(np.arange(len(texts)), lengths)
        before = np.concatenate([np.zeros(1, np.int64), ids])[:-1]
        before[(np.cumsum(lengths) - lengths)[lengths > 0]] = 0
        models, after, missing = self.values[ids], before < known, self.open[ids]
        models[after] *= tables["pair_down"][before[after]]
        if "history" not in complete:
            missing |= ~after
            missing[after] |= ~tables["known_history"][before[after]]
        wanted = np.flatnonzero(after & (ids < known))
        pair = before[wanted] * known + ids[wanted]
        order = np.argsort(pair)  # neighbouring keys are found faster
        wanted, pair = wanted[order], pair[order]
        at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
        hit = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
        models[wanted[hit]] += tables["pair_values"][at[hit]]
        if "pair" not in complete:
            missing[wanted[~hit]] = True
        ratio = np.log1p(SHARE * (models[:, 0] / np.maximum(models[:, 1], 1e-12) - 1))
        sums = np.bincount(text, weights=np.where(missing, 0.0, ratio), minlength=len(texts)).astype(float)
        rest: list[list[dict]] = [[] for _ in texts]
        if missing.any():
            names = list(self.numbers)
            found, n = np.unique(np.stack([text, before, ids])[:, missing], axis=1, return_counts=True)
            for (t, a, b), c in zip(found.T.tolist(), n.tolist()):
                rest[t].append({"history": names[a], "word": names[b], "n": c})
        return sums, lengths, rest

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood ratio per word of each text; 0 without words."""
        sums, lengths, _ = self.parts(texts)
        return sums / np.maximum(lengths, 1)


@dataclass(frozen=True)
class Model:
    """Tables that every task holds, and the frames of all expressions, with both models' values.

    ``lower`` has words and beginnings by level, ``histories`` what a history
    hands down. ``tables["complete"]`` names the levels that the tables hold as a whole.
    """

    tables: dict
    lower: DataFrame
    histories: DataFrame
    pairs: DataFrame

    @property
    def whole(self) -> bool:
        return self.tables["complete"] >= set(HEAD)


def ratios(rows: DataFrame, model: Model) -> DataFrame:
    """``id`` and ``ratio``, the log-likelihood ratio per word, for each row of ``id`` and ``text``.

    What needs expressions that the tables lack is summed by joins with the frames.
    """
    # Plain values only: tasks need not know this module.
    shared = rows.sparkSession.sparkContext.broadcast({name: held for name, held in model.tables.items() if name != "words"})

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                sums, words, rest = scorer.parts(part.column(1).to_pylist())
                rest = pa.array(rest, pa.list_(pa.struct([("history", pa.string()), ("word", pa.string()), ("n", pa.int64())])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums), pa.array(words), rest], ["id", "total", "words", "rest"])

    local = rows.select("id", "text").mapInArrow(run, "id long, total double, words long, rest array<struct<history: string, word: string, n: long>>")
    per_word = F.col("total") / F.greatest("words", F.lit(1))
    if model.whole:
        return local.select("id", per_word.alias("ratio"))
    local = stored(local.withColumn("row", F.monotonically_increasing_id()), "toxicity-parts")
    joined = local.select("row", F.inline("rest"))
    values = [F.lit(1.0), F.lit(1.0)]
    for level in (*map(str, BEGINNINGS), "word"):
        found = model.lower.where(F.col("level") == level).select(F.col("word").alias("_key"), F.col("toxic").alias("_toxic"), F.col("ordinary").alias("_ordinary"))
        key = F.col("word") if level == "word" else F.when(F.length("word") > int(level), F.substring("word", 1, int(level)))
        joined = joined.join(found, key == F.col("_key"), "left")
        down = model.tables["down"][level]
        lower = [F.coalesce(c, F.lit(0.0)) + d * v for c, d, v in zip(("_toxic", "_ordinary"), down, values)]
        lower = lower if level == "word" else [F.when(key.isNotNull(), new).otherwise(v) for new, v in zip(lower, values)]
        joined = joined.select("row", "history", "word", "n", lower[0].alias("_a"), lower[1].alias("_b"))
        values = [F.col("_a"), F.col("_b")]
    histories = model.histories.select("history", F.col("toxic").alias("_down_a"), F.col("ordinary").alias("_down_b"))
    pairs = model.pairs.select("history", "word", F.col("toxic").alias("_own_a"), F.col("ordinary").alias("_own_b"))
    joined = joined.join(histories, "history", "left").join(pairs, ["history", "word"], "left")
    toxic, ordinary = (F.col(f"_{c}") * F.coalesce(f"_down_{c}", F.lit(1.0)) + F.coalesce(f"_own_{c}", F.lit(0.0)) for c in "ab")
    each = F.log1p(SHARE * (toxic / F.greatest(ordinary, F.lit(1e-12)) - 1))
    # Sums of decimals do not depend on the order of rows.
    added = joined.groupBy("row").agg(F.sum((F.col("n") * each).cast("decimal(30,15)")).cast("double").alias("added"))
    whole = local.join(added, "row", "left").withColumn("total", F.col("total") + F.coalesce("added", F.lit(0.0)))
    return whole.select("id", per_word.alias("ratio"))


def _placed(counts: DataFrame, parts: int) -> tuple[DataFrame, str]:
    """Counts written in buckets of their ``start``, so that no later grouping inside one moves them; and the table's name."""
    name = f"expressions_{uuid.uuid4().hex}"
    counts.write.bucketBy(parts, "start").option("path", new_path(counts.sparkSession, "llm-expressions")).saveAsTable(name)
    return counts.sparkSession.table(name), name


def _head(frame: DataFrame, level: str) -> tuple[pa.Table, bool]:
    """The most frequent expressions of a level, at most ``HEAD``, and whether these are all."""
    rows, complete = frame, frame.count() <= HEAD[level]
    if not complete:
        held, least = 0, None
        for n, rows_of_n in frame.groupBy("n").count().orderBy(F.desc("n")).collect():
            held += rows_of_n
            if held > HEAD[level]:
                break
            least = n
        rows = frame.where(F.col("n") >= least) if least is not None else frame.limit(0)
    return rows.drop("n", "level").toArrow(), complete


def _values(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in ("toxic", "ordinary")], axis=1)


def _coded(column: pa.ChunkedArray) -> tuple[list[str], np.ndarray]:
    codes = column.combine_chunks().dictionary_encode()
    return codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)


def _discounted(name: str) -> Column:
    return F.when(F.col(name) > 0, F.col(name) - DISCOUNT).otherwise(0.0)


def fit(docs: DataFrame, texts: DataFrame, text: str) -> Model:
    """The two models from all of ``texts`` (``target``, ``text``), each distinct one once, and the corpus counts."""
    spark = docs.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts, name = _placed(counts_of(texts.dropDuplicates(["target", "text"]), parts), parts)
    follows = stored(continuations(counts), "continuations")
    n = F.col("toxic") + F.col("ordinary")
    kept, classes = counts.where(n >= LEAST), ("toxic", "ordinary")
    pairs = stored(kept.where("level = 'pair'").select("history", "word", *classes), "pairs")
    taken = pairs.groupBy("history").agg(*(F.sum(_discounted(c)).alias(f"_{c}") for c in classes))
    sums = counts.where("level = 'history'").select(F.col("word").alias("history"), *classes).join(taken, "history")
    handed = [F.when(F.col(c) > 0, 1 - F.col(f"_{c}") / F.col(c)).otherwise(1.0).alias(f"_down_{c}") for c in classes]
    sums = stored(sums.select("history", *(F.col(c).alias(f"_sum_{c}") for c in classes), *handed, n.alias("n")), "histories")
    lower = stored(kept.where("level not in ('pair', 'history')").select("level", "word").join(follows, ["level", "word"]), "lower")
    totals = {r[0]: r[1:] for r in follows.groupBy("level").agg(*(F.sum(c) for c in classes)).collect()}
    held = {r[0]: r[1:] for r in lower.groupBy("level").agg(*(F.sum(_discounted(c)) for c in classes)).collect()}
    discard(counts)
    spark.sql(f"DROP TABLE {name}")
    discard(follows)
    levels = [*map(str, BEGINNINGS), "word"]
    down = {level: tuple(1 - h / s if s else 1.0 for h, s in zip(held.get(level, (0, 0)), totals.get(level, (0, 0)))) for level in levels}

    # One pass over the corpus gives the counts of kept words, and in the row without a word the sum of all others.
    words = lower.where("level = 'word'").select("word", F.lit(True).alias("kept"))
    if words.count() <= HEAD["word"]:
        shares = corpus_words(docs, text, words.select("word").toArrow().column(0).to_pylist())
    else:
        marked = corpus_words(docs, text).join(words, "word", "left")
        shares = marked.groupBy(F.when(F.col("kept"), F.col("word")).alias("word")).agg(F.sum("documents").alias("documents"))
    shares = stored(shares, "shares")
    everything = max(shares.agg(F.sum("documents")).first()[0] or 0, 1)
    share = shares.where("word is not null").select("word", (F.greatest("documents", F.lit(1)) / everything).alias("_share"))
    share = words.select("word").join(share, "word", "left").select("word", F.coalesce("_share", F.lit(1 / everything)).alias("_share"))
    own = {c: F.when(F.lit(False), 0.0) for c in classes}
    for level, (toxic, ordinary) in totals.items():
        for c, total in zip(classes, (toxic, ordinary)):
            value = _discounted(c) / float(total) if total else F.lit(0.0)
            shared = F.col("_share") if level == "word" else n / float(toxic + ordinary)
            own[c] = own[c].when(F.col("level") == level, value / shared)
    relative = lower.join(share.withColumn("level", F.lit("word")), ["level", "word"], "left")
    relative = stored(relative.select("level", "word", *(own[c].alias(c) for c in classes), n.alias("n")), "lower-values")
    follow = pairs.join(sums.drop("n"), "history").join(share, "word")
    divided = [F.when(F.col(f"_sum_{c}") > 0, _discounted(c) / F.col(f"_sum_{c}") / F.col("_share")).otherwise(0.0).alias(c) for c in classes]
    values = stored(follow.select("history", "word", *divided, n.alias("n")), "pair-values")
    histories = stored(sums.select("history", *(F.col(f"_down_{c}").alias(c) for c in classes), "n"), "history-values")
    for done in (pairs, sums, lower, shares):
        discard(done)

    heads = {level: _head(relative.where(F.col("level") == level), level) for level in levels}
    heads |= {"history": _head(histories, "history"), "pair": _head(values, "pair")}
    complete = {level for level, (_, whole) in heads.items() if whole}
    columns = {level: (rows.column(0).to_pylist(), _values(rows)) for level, (rows, _) in heads.items() if level != "pair"}
    rows = heads["pair"][0]
    follow = _coded(rows.column("history")), _coded(rows.column("word")), _values(rows)
    tables = assemble({level: columns[level] for level in levels}, columns["history"], follow, down, complete)
    return Model(tables, relative, histories, values)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", column: str = "toxic") -> tuple[dict, float, float, Model]:
    """Tables, slope, intercept and the whole model, from all labelled texts and the corpus counts.

    The last of the folds that may be learned from calibrates; the others are
    counted, each distinct text once.
    """
    texts = labelled_texts(docs, labelled_ids(labels, column), text)
    last = F.col("fold") == 4
    model = fit(docs, texts.where(~last), text)
    held = ratios(texts.where(last).select(F.col("target").cast("long").alias("id"), "text"), model)
    held = stored(held.select(F.col("id").alias("target"), F.col("ratio").alias("score")), "toxicity-held")
    if model.lower.isEmpty():
        held = held.withColumn("score", F.lit(0.0))
    slope, intercept = platt_of(held)
    discard(held)
    return model.tables, slope, intercept, model


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` per document, from whole texts.

    Labels are learned only from rows outside fold 0. Null text counts as empty;
    a text without words gets the score of no evidence; null ids count as held
    out; repeated rows stay. Without labels of both classes every score is the
    same, the share of toxic labels that were seen.
    """
    _, slope, intercept, model = train(docs, labels, text)
    slim = docs.select(F.col("doc_id").cast("long").alias("id"), text_of(F.col(f"`{text}`")).alias("text"))
    at = slope * F.col("ratio") + intercept
    scored = ratios(slim, model).select(F.col("id").alias("doc_id"), (1 / (1 + F.exp(-F.least(F.greatest(at, F.lit(-700.0)), F.lit(700.0))))).alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
