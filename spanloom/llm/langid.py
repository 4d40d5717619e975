"""Language identification by a linear-chain conditional random field over words.

Words carry affix, n-gram and lexicon features; transitions between the languages of
neighbouring words are learned too, from training sequences that switch language at random
places. Forward-backward gives each word a distribution over languages, and the mean of those
is the answer for a text. Sequences are worked on in blocks: the products of a block's
transition matrices are taken for all blocks of a batch at once, then chained, so a text of
any length costs the same number of array operations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import text_of

#: Bounds of the training sample: languages (those with most rows), documents a language, code points of a document that
#: may be drawn, and how many times the sample the first draw leaves.
LANGS, SAMPLE_DOCS, SAMPLE_CHARS, DRAWN = 200, 200, 20_000, 8
#: Hashed features, words of the lexicon a language, words of a training sequence, sequences, passes.
FEATURE_BITS, LEXICON, SEQUENCE, SEQUENCES, PASSES = 16, 400, 24, 6000, 3
FEATURES = 1 << FEATURE_BITS
RATE, DECAY, SEED = 0.25, 1e-6, 7
#: Words of a block; entries of a task's word memo, each of at most PIECE letters; rows that are held as texts at once.
BLOCK, MEMO, HELD = 64, 200_000, 256
WORD = re.compile(r"[^\W\d_]+")
#: Letters of a position of the chain; letters beyond the Latin blocks; runs of one script.
PIECE = 24
BEYOND = re.compile("[\u0250-\u1dff\u2c00-\U0010ffff]")
SCRIPTS = regex.compile(r"[\p{Latin}\p{Common}\p{Inherited}]+|\p{Greek}+|\p{Cyrillic}+|\p{Arabic}+|\p{Hebrew}+|\p{Devanagari}+|\p{Thai}+|\p{Hangul}+|\p{Hiragana}+|\p{Katakana}+|\p{Han}+|.")


def words_of(text: str) -> list[str]:
    """Runs of letters of one script, in lower case; a run of more than PIECE letters makes several."""
    words = WORD.findall(text.lower())
    if BEYOND.search(text):
        words = [part for w in words for part in (SCRIPTS.findall(w) if BEYOND.search(w) else (w,))]
    if max(map(len, words), default=0) > PIECE:
        words = [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    return words


def hashed(kind: int, *letters: np.ndarray) -> np.ndarray:
    """Feature numbers of runs of letters (code points, element by element) of one kind."""
    h = np.full(letters[0].shape, kind, np.uint64)
    for x in letters:
        h = (h + x) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, counts): the hashed features of words, one word after another, and how many each has.

    Prefixes and suffixes to 3, all trigrams with the word's ends, all bigrams, and for words of
    the lexicon the word and its language. Words are rows of a table of code points, so a
    feature of all words is one array operation.
    """
    n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
    if not n:
        return np.empty(0, np.int64), sizes
    width = max(3, int(sizes.max()))
    table = np.zeros((n, width + 2), np.uint64)
    rows = np.repeat(np.arange(n), sizes)
    table[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    each = np.arange(n)
    table[:, 0], table[each, sizes + 1] = ord("<"), ord(">")
    at = lambda back: table[each, np.maximum(sizes - back, 0)]
    found = [hashed(3, table[:, :-2], table[:, 1:-1], table[:, 2:]), hashed(2, table[:, 1:-2], table[:, 2:-1])]
    found += [hashed(9 + k, *(table[:, i] for i in range(1, k + 1)))[:, None] for k in (1, 2, 3)]
    found += [hashed(19 + k, *(at(i) for i in range(k)))[:, None] for k in (1, 2, 3)]
    place = np.arange(width)
    there = [place < sizes[:, None], place[:-1] < sizes[:, None] - 1, np.ones((n, 6), bool)]
    marks = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, n)
    whole = np.zeros(n, np.uint64)
    for k in range(1, width + 1):
        whole = whole * np.uint64(1_000_003) + table[:, k]
    found += [hashed(30, marks.astype(np.uint64))[:, None], hashed(31, whole)[:, None]]
    known = np.repeat((marks >= 0)[:, None], 2, axis=1)
    mask = np.concatenate([*there, known], axis=1)
    return np.concatenate(found, axis=1)[mask], mask.sum(1)


def features_of(word: str, lexicon: dict[str, int]) -> list[int]:
    """The hashed features of one word."""
    return features([word], lexicon)[0].tolist()


@dataclass
class Model:
    """Weights of the field: emissions (features x languages), transitions and starts."""

    langs: list[str]
    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int]
    #: Whether two languages or more had words to tell them by; otherwise all weights are zero.
    fitted: bool = False

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores of words, len(words) x languages."""
        if not words:
            return np.zeros((0, len(self.langs)))
        flat, counts = features(words, self.lexicon)
        return np.add.reduceat(self.emit[flat], np.cumsum(counts) - counts, axis=0)


def sample(labelled: DataFrame) -> DataFrame:
    """lang, text: at most SAMPLE_DOCS documents of each of LANGS languages, drawn by a hash of their ids.

    Only rows of at most SAMPLE_CHARS code points are drawn, so the sample has a bound of
    SAMPLE_DOCS * SAMPLE_CHARS code points a language. A first draw by hash, at a rate that
    the language's number of rows sets, leaves about DRAWN times the sample; only these rows
    are ranked, so a language with most of the rows is no burden at any size.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").where(F.length("text").between(1, SAMPLE_CHARS))
    counts = [(r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()]
    if not counts:
        return rows.select("lang", "text")
    rate = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, DRAWN * SAMPLE_DOCS / n))])
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(1 << 30)) < rate[F.col("lang")] * (1 << 30))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "text"))
    return rows.select("doc_id", "lang", "text", nth.alias("nth")).where(F.col("nth") <= SAMPLE_DOCS).select("lang", "text")


def forward_backward(scores: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (n, t, L) of n sequences of t words, and the summed pair marginals (L, L)."""
    n, t, k = scores.shape
    psi = np.exp(scores - scores.max(2, keepdims=True))
    jump = np.exp(step)
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    alpha[:, 0] = psi[:, 0] * np.exp(start)
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        alpha[:, i] = (alpha[:, i - 1] @ jump) * psi[:, i]
        alpha[:, i] /= alpha[:, i].sum(1, keepdims=True)
    pairs = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        back = psi[:, i + 1] * beta[:, i + 1]
        beta[:, i] = back @ jump.T
        beta[:, i] /= beta[:, i].sum(1, keepdims=True)
        both = alpha[:, i, :, None] * jump * back[:, None, :]
        pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
    marginal = alpha * beta
    return marginal / marginal.sum(2, keepdims=True), pairs


def train(rows: list[tuple[str, str]]) -> Model:
    """Fit the field to (lang, text) rows, the same rows giving the same model.

    Training sequences take runs of words from documents and switch to another language with
    a chance of one in twelve at each word, which is what teaches the transitions.
    """
    rng = np.random.default_rng(SEED)
    rows = sorted(rows)
    langs = sorted({lang for lang, _ in rows})
    k = len(langs)
    pools = [[w for w in (words_of(t) for lang, t in rows if lang == of) if w] for of in langs]
    usable = [i for i, p in enumerate(pools) if p]
    counts: list[dict[str, int]] = []
    for pool in pools:
        seen: dict[str, int] = {}
        for w in (w for doc in pool for w in doc):
            seen[w] = seen.get(w, 0) + 1
        counts.append(seen)
    total = [max(1, sum(c.values())) for c in counts]
    lexicon = {}
    for i, seen in enumerate(counts):
        for w in sorted(seen, key=lambda w: (-seen[w], w))[:LEXICON]:
            share = [c.get(w, 0) / n for c, n in zip(counts, total, strict=True)]
            if share[i] >= 0.6 * sum(share):
                lexicon[w] = i
    model = Model(langs, np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(k), lexicon)
    if len(usable) < 2:
        return model
    model.fitted = True
    sequences, labels = [], np.empty((SEQUENCES, SEQUENCE), np.int64)
    for s in range(SEQUENCES):
        words: list[str] = []
        while len(words) < SEQUENCE:
            at = int(rng.choice(usable))
            doc = pools[at][int(rng.integers(len(pools[at])))]
            run = min(int(rng.geometric(1 / 12)), SEQUENCE - len(words))
            first = int(rng.integers(max(1, len(doc) - run + 1)))
            part = doc[first : first + run]
            labels[s, len(words) : len(words) + len(part)] = at
            words += part
        sequences.append(words)
    drawn = list(dict.fromkeys(w for s in sequences for w in s))
    flat, counts = features(drawn, lexicon)
    known = dict(zip(drawn, np.split(flat, np.cumsum(counts)[:-1]), strict=True))
    sequences = [[known[w] for w in s] for s in sequences]
    size = 200
    for _ in range(PASSES):
        order = rng.permutation(SEQUENCES)
        for b in range(0, SEQUENCES, size):
            batch = order[b : b + size]
            flat = [f for s in batch for f in sequences[s]]
            lengths = np.array([len(f) for f in flat])
            ids = np.concatenate(flat)
            scores = np.add.reduceat(model.emit[ids], np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0).reshape(len(batch), SEQUENCE, k)
            marginal, pairs = forward_backward(scores, model.step, model.start)
            truth = np.eye(k)[labels[batch]]
            error = np.repeat((truth - marginal).reshape(-1, k), lengths, axis=0)
            used, place = np.unique(ids, return_inverse=True)
            change = np.stack([np.bincount(place, error[:, c], used.size) for c in range(k)], 1)
            often = np.bincount(place, minlength=used.size)[:, None]
            model.emit[used] += RATE * change / np.sqrt(often + 1) - DECAY * model.emit[used]
            seen = np.zeros((k, k))
            np.add.at(seen, (labels[batch][:, :-1].ravel(), labels[batch][:, 1:].ravel()), 1)
            model.step += RATE * (seen - pairs) / len(batch)
            model.start += RATE * (truth[:, 0] - marginal[:, 0]).mean(0)
    return model


class Labeller:
    """Marginals of the words of many texts, with a bounded memo of word scores."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.table = np.zeros((1024, len(model.langs)), np.float32)
        top = model.step.max() if model.langs else 0.0
        self.jump = np.exp(model.step - top)
        self.start = np.exp(model.start - (model.start.max() if model.langs else 0.0))

    def rows(self, words: list[str]) -> np.ndarray:
        """Rows of the score table that hold the potentials of words."""
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            if len(self.known) + len(new) > MEMO:
                self.known.clear()
                new = list(dict.fromkeys(words))
            have = len(self.known)
            while len(self.table) < have + len(new):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            scores = np.concatenate([self.model.scores(new[i : i + 8192]) for i in range(0, len(new), 8192)])
            self.table[have : have + len(new)] = np.exp(scores - scores.max(1, keepdims=True)).clip(1e-30)
            self.known.update(zip(new, range(have, have + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text of at least one word, words x languages."""
        k = len(self.model.langs)
        lengths = np.array([len(t) for t in texts])
        flat = self.rows([w for t in texts for w in t])
        blocks = -(-lengths // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)])
        n = int(first[-1])
        place = np.repeat(first[:-1] * BLOCK - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        psi = np.ones((n * BLOCK, k))
        psi[place] = self.table[flat]
        real = np.zeros(n * BLOCK, bool)
        real[place] = True
        psi, real = psi.reshape(n, BLOCK, k), real.reshape(n, BLOCK)
        # all blocks at once: what a block does to any distribution that enters it
        through = np.broadcast_to(np.eye(k), (n, k, k)).copy()
        for i in range(BLOCK):
            on = real[:, i]
            moved = (through[on] @ self.jump) * psi[on, i][:, None, :]
            through[on] = moved / moved.sum((1, 2), keepdims=True)
        # chained block by block; the d-th block of every text in one step
        enter, leave = np.empty((n, k)), np.ones((n, k))
        enter[first[:-1]] = self.entry()
        for d in range(1, int(blocks.max())):
            at = first[:-1][blocks > d] + d
            state = (enter[at - 1][:, None, :] @ through[at - 1])[:, 0]
            enter[at] = state / state.sum(1, keepdims=True)
        for d in range(int(blocks.max()) - 2, -1, -1):
            at = first[:-1][blocks > d + 1] + d
            state = (through[at + 1] @ leave[at + 1][:, :, None])[:, :, 0]
            leave[at] = state / state.sum(1, keepdims=True)
        alpha, beta = np.zeros((n, BLOCK, k)), np.ones((n, BLOCK, k))
        state = enter
        for i in range(BLOCK):
            on = real[:, i]
            moved = (state[on] @ self.jump) * psi[on, i]
            alpha[on, i] = moved / moved.sum(1, keepdims=True)
            state = state.copy() if i == 0 else state
            state[on] = alpha[on, i]
        state = leave
        for i in range(BLOCK - 1, -1, -1):
            on = real[:, i]
            beta[on, i] = state[on]
            moved = (psi[on, i] * state[on]) @ self.jump.T
            state[on] = moved / moved.sum(1, keepdims=True)
        marginal = (alpha * beta).reshape(-1, k)[place]
        marginal /= marginal.sum(1, keepdims=True)
        return np.split(marginal, np.cumsum(lengths)[:-1])

    def entry(self) -> np.ndarray:
        """The state before the first word whose step gives the start weights."""
        state, *_ = np.linalg.lstsq(self.jump.T, self.start, rcond=None)
        state = np.maximum(state, 0)
        return state / state.sum() if state.sum() > 0 else np.full(len(self.start), 1 / len(self.start))


def predict(docs: DataFrame, model: Model, words: bool = False) -> DataFrame:
    """doc_id, lang_pred, score of every whole text, and with `words` the runs of one language.

    score is the mean marginal of the answer over the words. A text that is null or has no
    letter is `und` with score 0; so is every text if the model has no language. runs are
    (lang, first word, number of words), which shows where a text switches. No shuffle.
    """
    kind = "doc_id long, lang_pred string, score double" + ", runs array<struct<lang:string,start:int,words:int>>" * words
    runs_type = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("words", pa.int32())]))
    langs = model.langs

    def labelled(batches):
        tool = Labeller(model)
        for batch in sliced(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, answer, score, marginals in answers(tool, texts):
                cols = [ids.slice(at, len(answer)), pa.array(answer, pa.string()), pa.array(score, pa.float64())]
                if words:
                    cols.append(pa.array([runs_of(m, langs) for m in marginals], runs_type))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score"] + ["runs"] * words)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(labelled, kind)


def sliced(batches):
    """Arrow batches of at most HELD rows: as Python strings, texts take several times their size."""
    for batch in batches:
        for at in range(0, batch.num_rows, HELD):
            yield batch.slice(at, HELD)


def answers(tool: Labeller, texts: list[str], held: int = 100_000):
    """For runs of texts of about `held` words: where it starts, languages, scores, marginals (None without words)."""
    langs, at = tool.model.langs, 0
    while at < len(texts):
        stop, size, found = at, 0, []
        while stop < len(texts) and (size < held or stop == at):
            found.append(words_of(texts[stop] or ""))
            size += len(found[-1])
            stop += 1
        full = [i for i, w in enumerate(found) if w and langs]
        answer, score, marginals = ["und"] * len(found), [0.0] * len(found), [None] * len(found)
        for i, m in zip(full, tool.marginals([found[i] for i in full]) if full else [], strict=True):
            mean = m.mean(0)
            best = int(mean.argmax())
            answer[i], score[i], marginals[i] = langs[best], float(min(1.0, max(0.0, mean[best]))), m
        yield at, answer, score, marginals
        at = stop


def runs_of(marginal: np.ndarray | None, langs: list[str]) -> list[dict]:
    """Runs of words with one most likely language."""
    if marginal is None:
        return []
    path = marginal.argmax(1)
    edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return [{"lang": langs[path[a]], "start": a, "words": b - a} for a, b in zip(edges, edges[1:], strict=False)]


def accepted(docs: DataFrame, model: Model, least: float = 0.4) -> DataFrame:
    """The rows of docs, all columns, whose words are told with a mean confidence of at least `least`.

    The confidence of a word is its largest marginal, whichever language that is, so a text in
    several languages is not held against itself. A model that was not fitted tells nothing: then
    every text with a letter stays. A text that is null or has no letter goes; repeated rows stay
    or go together; all columns are kept, whatever their names; an empty table gives none.
    """
    text = docs.columns.index("text")

    def sure(marginal: np.ndarray | None, letters: bool) -> bool:
        if marginal is None or not model.fitted:
            return letters
        return float(marginal.max(1).mean()) >= least

    def kept(batches):
        tool = Labeller(model)
        for batch in sliced(batches):
            texts = batch.column(text).to_pylist()
            for at, answer, _, marginals in answers(tool, texts):
                part = batch.slice(at, len(answer))
                yield part.filter(pa.array([sure(m, WORD.search(t or "") is not None) for m, t in zip(marginals, texts[at : at + len(answer)], strict=True)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id, as text, leaves 2 by 4."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame) -> Model:
    """The model from the text and lang of the documents that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    drawn = sample(rows.where(~F.coalesce(held_out(), F.lit(False))))
    return train([(r["lang"], r["text"]) for r in drawn.collect()])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fit on the labelled rows, predict every row.

    A null doc_id is not held out. Ties go to the first language by name. Texts of any length
    are read whole; a text's words and their marginals are held at once, the one thing here that
    grows with a text. Repeated rows give repeated rows, an empty table none; other columns,
    whatever their names, are ignored.
    """
    found = predict(docs, fit(docs))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
