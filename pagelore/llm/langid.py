"""Language identification by unigram pieces, summed over all segmentations.

The pieces are a fixed public vocabulary. Each language has a probability for every piece; a word's probability
is the sum over all ways to cut it into pieces, by the forward algorithm, and a text's is the product over its
words. The probabilities are learned by expectation maximisation over the words of a sample of the labelled
documents (`sample` documents a language in expectation, chosen by a hash of the id); prediction reads every whole text.

Defined results: a word is a run of letters (Unicode category L), in lower case, of any length; a text that is null or
has no letter is `und` with score 0; a null lang is not learned
from; a null doc_id is never learned from; equal scores go to the language first in code-point order; with
nothing to learn from every text is `und`; repeated rows are each scored; more than `most_languages` different
values of lang are refused with an error, since what a worker holds grows with them.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import Scratch, held, settings, tune

#: Nearly letters; what else it takes (fractions, Roman numerals, numbers in circles) is cut out of the few words that have it.
NEARLY, LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
MARK = "▁"
UND = "und"
#: Words longer than this are summed one by one, in logarithms, and not kept: the same sums by another road.
LONG = 64
#: Bytes of the table of words that a worker keeps (there are two generations), words in it, languages at most.
TABLE_BYTES, TABLE_WORDS, MOST_LANGUAGES = 64 << 20, 150_000, 256


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, in lower case."""
    found = NEARLY.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for word in found for part in ((word,) if word.isalpha() else LETTERS.findall(word))]


class Edges(NamedTuple):
    """Pieces in words, in order of the depth of their ends: those of depth d lie from bounds[d - 1] to bounds[d]; first and last are the words' outer places."""

    word: np.ndarray
    source: np.ndarray
    target: np.ndarray
    row: np.ndarray
    bounds: np.ndarray
    first: np.ndarray
    last: np.ndarray
    spelled: list[str]

    def ahead(self, p: np.ndarray) -> np.ndarray:
        """Sums over all ways from a word's first place to each place; p: edges x languages."""
        sums = np.zeros((int(self.last[-1]) + 1, p.shape[1]))
        sums[self.first] = 1.0
        for a, z in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True):
            target = self.target[a:z]
            heads = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            sums[target[heads]] = np.add.reduceat(sums[self.source[a:z]] * p[a:z], heads)
        return sums

    def back(self, q: np.ndarray) -> np.ndarray:
        """Sums over all ways from each place to its word's last; q: one number an edge."""
        sums = np.zeros(int(self.last[-1]) + 1)
        sums[self.last] = 1.0
        for a, z in zip(self.bounds[-2::-1].tolist(), self.bounds[:0:-1].tolist(), strict=True):
            sums[self.source[a:z]] += sums[self.target[a:z]] * q[a:z]  # pieces that end at one place begin at different ones
        return sums


class Pieces:
    """The vocabulary: piece -> row, and its trie as arrays. A character that is no piece is spelled by its bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rows = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i) and not model.is_byte(i)}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.size = model.get_piece_size()
        self.longest = max(map(len, self.rows))
        #: piece -> its row, and -1 for what only ends a piece: where a look-up finds nothing, nothing longer will do
        self.back = {piece[n:]: -1 for piece in self.rows for n in range(1, len(piece))} | self.rows
        begins = {piece[:n] for piece in self.rows for n in range(1, len(piece) + 1)}
        node = {"": 0} | {text: k + 1 for k, text in enumerate(sorted(begins))}
        #: code points of the pieces; steps of the trie (node and letter in one number, sorted), where they lead, and the row of each node
        self.letters = np.array(sorted({ord(c) for c in "".join(self.rows)}), np.int64)
        step = sorted((node[text[:-1]] * len(self.letters) + int(np.searchsorted(self.letters, ord(text[-1]))), at) for text, at in node.items() if text)
        self.steps, self.leads = (np.array(x, np.int64) for x in zip(*step, strict=True))
        self.row_of = np.full(len(node), -1)
        for piece, row in self.rows.items():
            self.row_of[node[piece]] = row

    def edges(self, words: list[str]) -> Edges:
        """Every piece at every place of the marked words, found by walking the trie from all places at once."""
        texts = [MARK + word for word in words]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(texts)), lengths)
        first = np.cumsum(lengths) - lengths
        letter = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        letter[self.letters[letter] != codes] = -1
        left = (first + lengths)[word] - np.arange(len(codes))  # letters from here to the word's end
        at, node, sources, sizes, rows = np.arange(len(codes)), np.zeros(len(codes), np.int64), [], [], []
        alone = np.zeros(len(codes), bool)
        for size in range(1, self.longest + 1):
            good = left[at] >= size
            at, node = at[good], node[good]
            own = letter[at + size - 1]
            key = node * len(self.letters) + own
            found = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            good = (self.steps[found] == key) & (own >= 0)
            at, node = at[good], self.leads[found[good]]
            if not at.size:
                break
            row = self.row_of[node]
            whole = row >= 0
            sources.append(at[whole])
            sizes.append(np.full(len(sources[-1]), size))
            rows.append(row[whole])
            if size == 1:
                alone[at[whole]] = True
        odd = np.flatnonzero(~alone)
        spelled, which = np.unique(codes[odd], return_inverse=True)
        start, wide, row = (np.concatenate(x) for x in ((*sources, odd), (*sizes, np.ones(len(odd), np.int64)), (*rows, self.size + which)))
        # a word of n letters has n + 1 places
        source, target = start + word[start], start + word[start] + wide
        depth = start - first[word[start]] + wide
        order = np.lexsort((target, depth))
        depth = depth[order]
        bounds = np.searchsorted(depth, np.arange(1, (int(depth[-1]) if depth.size else 0) + 2))
        return Edges(word[start][order], source[order], target[order], row[order], bounds, first + np.arange(len(texts)), first + lengths + np.arange(len(texts)), [chr(c) for c in spelled.tolist()])

    def with_spelled(self, p: np.ndarray, spelled: list[str]) -> np.ndarray:
        """p (rows x languages) with a row for each spelled character: the product of its bytes'."""
        extra = [p[[self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]].prod(0) for c in spelled]
        return np.concatenate([p, np.array(extra)]) if extra else p

    def into(self, text: str, j: int) -> list[tuple[int, list[int]]]:
        """(start, rows) of each piece that ends at place j of a marked word; a spelled character has the rows of its bytes."""
        out = []
        for i in range(j - 1, -1, -1):
            if (row := self.back.get(text[i:j])) is None:
                break
            if row >= 0:
                out.append((i, [row]))
        if self.rows.get(text[j - 1]) is None:
            out.append((j - 1, [self.bytes[b] for b in text[j - 1].encode("utf-8", "surrogatepass")]))
        return out

    def long_word(self, word: str, logs: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations, for each column of logs; only the places that a piece can reach are held."""
        text, reach = MARK + word, self.longest
        ahead = np.full((reach + 1, logs.shape[1]), -np.inf)
        ahead[0] = 0.0
        for j in range(1, len(text) + 1):
            edges = self.into(text, j)
            ahead[j % (reach + 1)] = np.logaddexp.reduce([ahead[i % (reach + 1)] + (logs[rows[0]] if len(rows) == 1 else logs[rows].sum(0)) for i, rows in edges], axis=0)
        return ahead[len(text) % (reach + 1)]

    def long_counts(self, word: str, logs: np.ndarray, n: float, counts: np.ndarray) -> None:
        """Adds to counts the expected uses of each piece in n such words. logs and counts: one language."""
        text = MARK + word
        size = len(text)
        ahead, back = np.full(size + 1, -np.inf), np.full(size + 1, -np.inf)
        ahead[0] = back[size] = 0.0
        for j in range(1, size + 1):
            ahead[j] = np.logaddexp.reduce([ahead[i] + logs[rows].sum() for i, rows in self.into(text, j)])
        for j in range(size, 0, -1):
            for i, rows in self.into(text, j):
                one = logs[rows].sum()
                back[i] = np.logaddexp(back[i], back[j] + one)
                np.add.at(counts, rows, n * np.exp(ahead[i] + one + back[j] - ahead[size]))


class Model:
    """Log probabilities by language; words are scored in batches and kept, a bounded number of them."""

    def __init__(self, pieces: Pieces, langs: list[str], logs: np.ndarray, priors: np.ndarray, most: int = TABLE_WORDS):
        self.pieces, self.langs, self.logs, self.priors = pieces, langs, logs, priors
        self.most = most = max(1, min(most, TABLE_BYTES // (8 * max(1, len(langs)))))
        self.p = np.exp(logs)
        self.known: dict[str, int] = {}  # word -> row of the table; the generation before is kept too
        self.table = np.zeros((most, len(langs)))
        self.older, self.older_table = {}, self.table

    def word_logs(self, words: list[str]) -> np.ndarray:
        edges = self.pieces.edges(words)
        done = edges.ahead(self.pieces.with_spelled(self.p, edges.spelled)[edges.row])[edges.last]
        with np.errstate(divide="ignore"):
            out = np.log(done)
        for k in np.flatnonzero((done < 1e-290).any(1)).tolist():  # too small for plain numbers
            out[k] = self.pieces.long_word(words[k], self.logs)
        return out

    def learn_words(self, words: set[str]) -> None:
        """At most `most` words, which the table then has."""
        fresh = list(words.difference(self.known))
        if len(self.known) + len(fresh) > self.most:
            self.older, self.older_table = self.known, self.table
            self.known, fresh = {}, list(words)
            self.table = np.zeros((self.most, len(self.langs)))
        again = [w for w in fresh if w in self.older]
        fresh = [w for w in fresh if w not in self.older]
        for part in (again[a : a + 4096] for a in range(0, len(again), 4096)):
            self._keep(part, self.older_table[[self.older[w] for w in part]])
        for part in (fresh[a : a + 4096] for a in range(0, len(fresh), 4096)):
            self._keep(part, self.word_logs(part))

    def _keep(self, words: list[str], logs: np.ndarray) -> None:
        at = len(self.known)
        self.table[at : at + len(words)] = logs
        self.known.update(zip(words, range(at, at + len(words)), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and posterior of each whole text. Words are looked up some at a time, however long a text is."""
        logs, found = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), bool)
        some, group, waiting = min(self.most, 100_000), [], 0
        for k, text in enumerate(texts):
            words = words_of(text or "")
            found[k] = bool(words and self.langs)
            for a in range(0, len(words) if self.langs else 0, some):
                part = words[a : a + some]
                if waiting + len(part) > some:
                    self._add(logs, group)
                    group, waiting = [], 0
                group.append((k, part))
                waiting += len(part)
        self._add(logs, group)
        out = []
        for k in range(len(texts)):
            own = logs[k] + self.priors
            best = int(np.argmax(own)) if found[k] else -1
            out.append((self.langs[best], float(1 / np.exp(own - own[best]).sum())) if found[k] else (UND, 0.0))
        return out

    def _add(self, logs: np.ndarray, group: list[tuple[int, list[str]]]) -> None:
        """Adds the logs of words to those of their texts."""
        distinct = {w for _, words in group for w in words}
        long = {w: self.pieces.long_word(w, self.logs) for w in distinct if len(w) > LONG}
        self.learn_words(distinct - long.keys())
        for k, words in group:
            if long:
                logs[k] += sum((long[w] for w in words if w in long), 0.0)
                words = [w for w in words if w not in long]
            logs[k] += self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(0)


def pieces_of(path: str) -> Pieces:
    return held(("pieces", path), lambda: Pieces(path))


def expected_counts(pieces: Pieces, p: np.ndarray, lang: np.ndarray, words: list[str], n: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece by each language, over all segmentations of its words. p: pieces x languages."""
    counts = np.zeros_like(p)
    wide = np.fromiter(map(len, words), np.int64, len(words)) > LONG
    slow = np.flatnonzero(wide).tolist()
    short = np.flatnonzero(~wide)
    for part in np.split(short, range(4096, len(short), 4096)):
        if not part.size:
            continue
        edges = pieces.edges([words[k] for k in part])
        own = lang[part][edges.word]
        q = pieces.with_spelled(p, edges.spelled)[edges.row, own]
        ahead, back = edges.ahead(q[:, None])[:, 0], edges.back(q)
        total = ahead[edges.last]
        good = total > 1e-290
        slow += part[~good].tolist()  # too small for plain numbers
        share = np.divide(n[part], total, out=np.zeros(len(part)), where=good)
        uses = ahead[edges.source] * q * back[edges.target] * share[edges.word]
        plain = edges.row < pieces.size
        np.add.at(counts, (edges.row[plain], own[plain]), uses[plain])
        for row, k, use in zip(edges.row[~plain].tolist(), own[~plain].tolist(), uses[~plain].tolist(), strict=True):
            for b in edges.spelled[row - pieces.size].encode("utf-8", "surrogatepass"):
                counts[pieces.bytes[b], k] += use
    logs = np.log(p) if slow else p
    for k in slow:
        pieces.long_counts(words[k], logs[:, lang[k]], n[k], counts[:, lang[k]])
    return counts


def train(docs: DataFrame, vocabulary: str, *, sample: int = 1500, rounds: int = 3, smooth: float = 0.01, most_languages: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probabilities (pieces x languages) and log priors from documents (doc_id, text, lang).

    The sample is `sample` documents a language in expectation. Words are counted in the tasks and by partial
    aggregation; each round sends back at most one number a piece and language, a bound that the vocabulary and `most_languages` set.
    """
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()}
    langs = sorted(totals)
    if len(langs) > most_languages:
        raise ValueError(f"more than {most_languages} languages: a worker could not hold their probabilities")
    if not langs:
        return [], np.zeros((0, 0)), np.zeros(0)
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30))
    limits = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1 << 30, -(-sample * (1 << 30) // totals[k])))])
    chosen = known.where(place < F.try_element_at(limits, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], ["lang", "word", "n"])

    with Scratch(spark) as scratch:
        words = scratch.written(chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
        pieces, where = pieces_of(vocabulary), {k: i for i, k in enumerate(langs)}
        p = np.full((pieces.size, len(langs)), 1.0 / pieces.size)
        for _ in range(rounds):
            sent = spark.sparkContext.broadcast(p.astype(np.float32))  # pieces x languages: the vocabulary and most_languages bound it

            def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                own, total = pieces_of(vocabulary), np.zeros(sent.value.shape)
                for batch in batches:
                    if batch.num_rows:
                        lang = np.array([where[k] for k in batch.column("lang").to_pylist()])
                        total += expected_counts(own, sent.value.astype(float), lang, batch.column("word").to_pylist(), batch.column("n").to_numpy().astype(float))
                row, lang = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[row, lang])], ["row", "lang", "v"])

            with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "20000"}):  # rows of one word
                sums = words.select("lang", "word", "n").mapInArrow(expect, "row int, lang int, v double").groupBy("row", "lang").agg(F.sum("v").alias("v")).toPandas()
            counts = np.zeros_like(p)
            counts[sums["row"].to_numpy(), sums["lang"].to_numpy()] = sums["v"].to_numpy()
            counts += smooth
            p = counts / counts.sum(0)
            sent.unpersist()
    n = np.array([totals[k] for k in langs], float)
    return langs, np.log(p), np.log(n / n.sum())


def _predictor(docs: DataFrame, learn_from: Column, vocabulary: str, sample: int, rounds: int):
    """A function that workers call for their model, trained on the documents that learn_from holds for."""
    spark = docs.sparkSession
    tune(spark)
    langs, logs, priors = train(docs.where(learn_from), vocabulary, sample=sample, rounds=rounds)
    key = uuid.uuid4().hex  # a worker keeps one model, under the key of its call
    sent = spark.sparkContext.broadcast((langs, logs.astype(np.float32), priors))  # pieces x languages: the vocabulary and most_languages bound it

    def load() -> Model:
        names, own, first = sent.value
        return Model(Pieces(vocabulary), names, own.astype(float), first)

    def model() -> Model:
        return held(("language", key), load)

    return model


def identify(docs: DataFrame, learn_from: Column, vocabulary: str, *, sample: int = 1500, rounds: int = 3) -> DataFrame:
    """doc_id, lang_pred, score of every document, learned from the documents that learn_from holds for."""
    model = _predictor(docs, learn_from, vocabulary, sample, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model()
        for batch in batches:
            got = own.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.selectExpr("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def recognised(docs: DataFrame, learn_from: Column, vocabulary: str, *, least: float = 0.5, sample: int = 1500, rounds: int = 3) -> DataFrame:
    """The documents whose language is found with a score of `least` or more, all their columns as they are but for a null lang, which is filled in."""
    model = _predictor(docs, learn_from, vocabulary, sample, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model()
        for batch in batches:
            got = own.predict(batch.column("text").to_pylist())
            at = batch.schema.get_field_index("lang")
            lang = pc.coalesce(batch.column(at), pa.array([g[0] for g in got], batch.schema.field(at).type))
            yield batch.set_column(at, batch.schema.field(at), lang).filter(pa.array([g[0] != UND and g[1] >= least for g in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
