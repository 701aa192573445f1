"""Language of documents and of their lines (problem 10).

The classifier averages hashed subword embeddings of a line's words and applies a
linear softmax, all trained by stochastic gradient descent in numpy. As both steps are
linear, embedding table and output layer fold into one table of class scores for
prediction, and a word's scores are summed once for all its occurrences in a batch.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "da", "nb", "sv", "de", "nl", "fr", "es")
#: How a language may be named; a region after the code is ignored.
NAMES = {
    "en": ("en", "eng", "english", "engelsk", "engelska", "englisch"),
    "da": ("da", "dan", "danish", "dansk"),
    "nb": ("nb", "nob", "no", "nor", "norwegian", "norsk", "bokmål", "norsk bokmål", "bokmal"),
    "sv": ("sv", "swe", "swedish", "svenska"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
}
GRAMS = (2, 3, 4, 5)
#: Calibrated probability of being right from which a line in another language is accepted.
ACCEPT = 0.98
_TAG = regex.compile(r"<[^<>\n]{1,200}>")
_BROKEN = regex.compile(r"[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]{1,3}")


def language_of_label(label: Column | str) -> Column:
    """One of the codes in ``LANGUAGES``, or NULL where the label names none of them."""
    label = F.col(label) if isinstance(label, str) else label
    plain = F.lower(F.trim(label))
    known = F.create_map(*[F.lit(x) for code, names in NAMES.items() for n in names for x in (n, code)])
    return F.coalesce(F.try_element_at(known, plain), F.try_element_at(known, F.regexp_extract(plain, r"^([\p{L}]{2,3})[-_]", 1)))


def _mend(found: regex.Match) -> str:
    piece = found.group()
    for encoding in ("latin-1", "cp1252"):
        try:
            return piece.encode(encoding).decode("utf-8")
        except UnicodeError:
            continue
    return piece


def _repaired(text: str) -> str:
    """UTF-8 read as a one-byte code is mended, markup removed and entities resolved; no line feed is added or removed."""
    text = _TAG.sub(" ", _BROKEN.sub(_mend, text))
    if "&" in text:
        text = "\n".join(html.unescape(line).replace("\n", " ").replace("\r", " ") for line in text.split("\n"))
    return unicodedata.normalize("NFC", text)


def plain_texts(texts: pa.Array) -> pa.Array:
    """The texts' letters in lower case and composed form, line by line: all else is a blank; NULL is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    # composing changes a text only where it holds marks
    odd = np.flatnonzero(pc.match_substring_regex(texts, r"[Â-ô<&]|\pM").to_numpy(zero_copy_only=False))
    if len(odd):
        mask = np.zeros(len(texts), bool)
        mask[odd] = True
        mended = [_repaired(t) for t in texts.take(pa.array(odd)).to_pylist()]
        texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(mended, pa.large_string()))
    return pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL\n]+", " ")


@dataclass
class Lines:
    """The lines of some texts as runs of numbered words.

    ``size`` words per line, ``word`` their numbers in ``words``, ``letters`` per line, ``count`` lines per text.
    """

    words: pa.Array
    word: np.ndarray
    size: np.ndarray
    letters: np.ndarray
    count: np.ndarray


def split_lines(plain: pa.Array) -> Lines:
    lines = pc.split_pattern(plain, "\n")
    count = np.diff(lines.offsets.to_numpy())
    parts = pc.split_pattern(lines.flatten(), " ")
    owner = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
    words = parts.flatten()
    full = pc.not_equal(words, "")
    owner, words = owner[full.to_numpy(zero_copy_only=False)], words.filter(full)
    coded = words.dictionary_encode()
    size = np.bincount(owner, minlength=len(parts))
    length = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    letters = np.bincount(owner, weights=length[word], minlength=len(parts)).astype(np.int64) if len(word) else np.zeros(len(parts), np.int64)
    return Lines(coded.dictionary, word, size, letters, count)


def subwords(words: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed runs of 2 to 5 characters of every word between blanks, word by word, and their number per word."""
    joined = " " + " ".join(words.to_pylist()) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = codes == 32
    word = np.cumsum(blank) - 1  # a word's grams start at the blank before it or inside
    found, where = [], []
    rolled = codes.copy()
    inner = np.concatenate([[0], np.cumsum(blank)])
    for n in range(2, max(GRAMS) + 1):
        if len(codes) < n:
            break
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n not in GRAMS:
            continue
        m = len(rolled)
        # no blank but at either end
        whole = inner[n - 1 : n - 1 + m] - inner[1 : 1 + m] == 0 if n > 2 else ~(blank[:m] & blank[1 : m + 1])
        h = rolled[whole] + np.uint64(n)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        found.append((h >> np.uint64(64 - bits)).astype(np.int32))
        where.append(word[:m][whole])
    index, owner = np.concatenate(found), np.concatenate(where)
    return index[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs of ``size`` rows; of empty runs 0."""
    out = np.zeros((len(size), *values.shape[1:]), np.float64)
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(size) - size)[some], axis=0)
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _two_best(logits: np.ndarray) -> np.ndarray:
    """How far the best class is above the second."""
    top = np.partition(logits, -2, axis=1)
    return top[:, -1] - top[:, -2]


def _signs(logits: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """What the chance of being right depends on: the best class's lead, which counts more in a longer line, and the length."""
    return np.stack([np.ones(len(letters)), _two_best(logits) * np.sqrt(letters), np.log1p(letters)], axis=1)


@dataclass
class LanguageModel:
    """Class scores per feature, with the sharpness, calibration and limit of usual leads found on held-out lines."""

    table: np.ndarray
    bits: int
    sharpness: float = 1.0
    right: np.ndarray = field(default_factory=lambda: np.zeros(3))
    usual_lead: float = 0.0

    def line_logits(self, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
        """Mean class scores and subwords of every line."""
        index, grams = subwords(lines.words, self.bits)
        scores = np.concatenate([_sums(self.table[index], grams), grams[:, None]], axis=1)
        sums = _sums(scores[lines.word], lines.size)
        return sums[:, :-1] / np.maximum(sums[:, -1:], 1), sums[:, -1]

    def probabilities(self, logits: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Class probabilities; a mean score counts more in a longer line."""
        return _softmax(self.sharpness * logits * np.sqrt(letters / 40.0)[:, None])

    def confidence(self, logits: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Calibrated probability that the best class is right."""
        return 1 / (1 + np.exp(-np.clip(_signs(logits, letters) @ self.right, -30, 30)))


def _descend(
    lines: Lines, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, bits: int, dim: int, epochs: int, rate: float,
    rng: np.random.Generator, batch: int = 128,
) -> np.ndarray:
    """Stochastic gradient descent over the lines ``rows``; embeddings and layer folded into class scores."""
    embed = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    layer = rng.normal(0, 0.3, (dim, classes)).astype(np.float32)
    seen_e, seen_l = np.full((1 << bits, 1), 1e-6, np.float32), np.full(layer.shape, 1e-6, np.float32)
    index, grams = subwords(lines.words, bits)
    index = index.astype(np.uint16 if bits <= 16 else np.uint32)
    gram_start, line_start = np.cumsum(grams) - grams, np.cumsum(lines.size) - lines.size
    total = _sums(grams[lines.word].astype(np.float64), lines.size)

    def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))

    for _ in range(epochs):
        order = rng.permutation(rows)
        for s in range(0, len(order), batch):
            at = order[s : s + batch]
            size = lines.size[at]
            # every word of the batch once, however often it occurs
            used, which = np.unique(lines.word[runs(line_start[at], size)], return_inverse=True)
            feats = index[runs(gram_start[used], grams[used])]
            word = np.add.reduceat(embed[feats], np.cumsum(grams[used]) - grams[used], axis=0)
            first = np.cumsum(size) - size
            n = total[at, None].astype(np.float32)
            mean = np.add.reduceat(word[which], first, axis=0) / n
            wrong = _softmax(mean @ layer)
            wrong[np.arange(len(at)), y[at]] -= 1
            wrong *= (weight[at] / len(at))[:, None]
            g_layer = mean.T @ wrong
            g_line = np.repeat(((wrong @ layer.T) / n).astype(np.float32), size, axis=0)
            by = np.argsort(which, kind="stable")
            g_word = np.add.reduceat(g_line[by], np.flatnonzero(np.diff(which[by], prepend=-1)), axis=0)
            by = np.argsort(feats, kind="stable")
            sorted_ = feats[by]
            heads = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
            g = np.add.reduceat(np.repeat(g_word, grams[used], axis=0)[by], heads, axis=0)
            rows_e = sorted_[heads]
            seen_e[rows_e] += (g * g).mean(axis=1, keepdims=True)
            embed[rows_e] -= rate * g / np.sqrt(seen_e[rows_e])
            seen_l += (g_layer * g_layer).astype(np.float32)
            layer -= (rate * g_layer / np.sqrt(seen_l)).astype(np.float32)
    return (embed @ layer).astype(np.float32)


def _pieces(lines: Lines, rows: np.ndarray, longest: int, rng: np.random.Generator) -> tuple[Lines, np.ndarray]:
    """Random runs of at most ``longest`` words of some lines, and the line of each: what short lines look like."""
    size = np.minimum(lines.size[rows], rng.integers(1, longest + 1, len(rows)))
    skip = (rng.random(len(rows)) * (lines.size[rows] - size + 1)).astype(np.int64)
    start = (np.cumsum(lines.size) - lines.size)[rows] + skip
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    length = pc.utf8_length(lines.words).to_numpy(zero_copy_only=False)
    word = lines.word[at]
    return Lines(lines.words, word, size, _sums(length[word].astype(np.float64), size).astype(np.int64), np.ones(len(rows), np.int64)), rows


def _fit_right(signs: np.ndarray, right: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton's steps."""
    w = np.zeros(signs.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(signs @ w, -30, 30)))
        step = np.linalg.solve((signs * (p * (1 - p))[:, None]).T @ signs + ridge * np.eye(len(w)), signs.T @ (right - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_language_model(
    clean: list[tuple[str, str]], noisy: list[tuple[str, str]], *, bits: int = 16, dim: int = 16, epochs: int = 5,
    rate: float = 0.1, max_lines: int = 16_000, max_chars: int = 1_500_000, seed: int = 13,
) -> LanguageModel:
    """Train on lines of labelled texts: ``clean`` sentences and texts whose label may be wrong.

    At most ``max_lines`` lines and ``max_chars`` characters are used. Every tenth
    line is held out. After a first fit, lines of ``noisy`` that clearly contradict
    their label are dropped and the model is trained again. The held-out lines, and
    random short runs of their words, then set the sharpness, the
    probability of being right as a function of lead and length (logistic
    regression), and the least lead that is usual in a known language.
    """
    rng = np.random.default_rng(seed)

    def of(labelled: list[tuple[str, str]]) -> tuple[np.ndarray, list[str]]:
        plain = plain_texts(pa.array([t for _, t in labelled], pa.string())).to_pylist()
        return [(lang, line) for (lang, _), t in zip(labelled, plain, strict=True) for line in t.split("\n") if line.strip()]

    rows, more = of(clean), of(noisy)
    sure, room = len(rows), max_chars
    for i in rng.permutation(len(more))[:max_lines]:
        room -= len(more[i][1])
        if room < 0:
            break
        rows.append(more[i])
    if not rows:  # knows nothing: every language is as likely
        return LanguageModel(np.zeros((1 << bits, len(LANGUAGES)), np.float32), bits)
    y = np.array([LANGUAGES.index(r[0]) for r in rows])
    unsure = np.arange(len(rows)) >= sure
    lines = split_lines(pa.array([r[1] for r in rows], pa.large_string()))
    keep, held = np.ones(len(rows), bool), np.arange(len(rows)) % 10 == 9
    for phase in range(2):
        use = np.flatnonzero(keep & ~held)
        share = np.bincount(y[use], minlength=len(LANGUAGES)) / max(len(use), 1)
        weight = (1.0 / np.maximum(share[y], 1e-3)) ** 0.5
        weight = weight / weight[use].mean()
        model = LanguageModel(_descend(lines, use, y, weight, len(LANGUAGES), bits, dim, epochs if phase else 3, rate, rng), bits)
        logits = model.line_logits(lines)[0]
        if phase == 0:
            keep &= ~(unsure & (model.probabilities(logits, lines.letters)[np.arange(len(rows)), y] < 0.1))
    test = np.flatnonzero(keep & held)
    if not len(test):
        return model
    best = None
    for sharp in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.6):
        model.sharpness = sharp
        p = model.probabilities(logits[test], lines.letters[test])
        loss = -np.log(np.maximum(p[np.arange(len(test)), y[test]], 1e-9)).mean()
        if best is None or loss < best[0]:
            best = (loss, sharp)
    model.sharpness = best[1]
    parts, whose = _pieces(lines, np.repeat(test, 4), 8, rng)
    scores, letters = np.concatenate([logits[test], model.line_logits(parts)[0]]), np.concatenate([lines.letters[test], parts.letters])
    right = scores.argmax(axis=1) == y[np.concatenate([test, whose])]
    model.right = _fit_right(_signs(scores, letters), right.astype(float))
    long = test[lines.letters[test] >= 40]
    if len(long):
        model.usual_lead = float(np.quantile(_two_best(logits[long]), 0.002)) / 2
    return model


def label_languages(
    documents: DataFrame, doc: str, text: str, model: LanguageModel, *, accept: float = ACCEPT, chunk_chars: int = 400_000
) -> DataFrame:
    """``(doc, para_no, lang_code, confidence)``: every text, and every line in another language.

    ``para_no`` 0 is the text: the language that most of its letters are in by line,
    with these lines' mean probability, weighted by letters, as confidence. It is NULL, with
    confidence 0, for texts without words (NULL and empty texts too), and, whatever the probability,
    for texts whose lead over the second language is so small that they are in none of the languages.
    A line, counted from 1 with empty lines, has a row where another language than the text's
    has a calibrated probability of at least ``accept`` of being right, which depends on its length
    as the held-out lines showed; no length is left out. Whole texts are read;
    equal texts give equal results, and NULL ids are kept.
    """
    kind = documents.schema[doc].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)  # one bounded table of class scores

    def judge(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
        model = shared.value
        n, m = len(LANGUAGES), len(texts)
        lines = split_lines(plain_texts(texts))
        logits, grams = model.line_logits(lines)
        p = model.probabilities(logits, lines.letters)
        sure = model.confidence(logits, lines.letters)
        top, words = p.argmax(axis=1), lines.letters > 0
        own_text = np.repeat(np.arange(m), lines.count)
        number = np.arange(len(own_text)) - np.repeat(np.cumsum(lines.count) - lines.count, lines.count) + 1
        votes = np.bincount(own_text[words] * n + top[words], weights=lines.letters[words], minlength=m * n).reshape(-1, n)
        mass = np.stack([np.bincount(own_text[words], weights=lines.letters[words] * p[words, c], minlength=m) for c in range(n)], axis=1)
        main = np.where(votes.max(axis=1, keepdims=True) == votes, mass, -1).argmax(axis=1)
        own = words & (top == main[own_text])
        mean = np.bincount(own_text[own], weights=lines.letters[own] * p[own].max(axis=1), minlength=m) / np.maximum(votes[np.arange(m), main], 1)
        # the lead of all its lines together tells whether the text is in a known language at all
        pooled = np.stack([np.bincount(own_text[own], weights=grams[own] * logits[own, c], minlength=m) for c in range(n)], axis=1).astype(np.float64)
        pooled /= np.maximum(np.bincount(own_text[own], weights=grams[own], minlength=m), 1)[:, None]
        known = (votes.sum(axis=1) > 0) & (_two_best(pooled) >= model.usual_lead)
        code = [LANGUAGES[c] if k else None for c, k in zip(main, known, strict=True)]
        other = np.flatnonzero(words & (top != main[own_text]) & (sure >= accept) & (_two_best(logits) >= model.usual_lead))
        return (
            np.concatenate([np.arange(m), own_text[other]]), np.concatenate([np.zeros(m, np.int64), number[other]]),
            code + [LANGUAGES[t] for t in top[other]], np.concatenate([np.where(known, mean, 0.0), sure[other]]),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            block = (np.cumsum(length) - length) // chunk_chars
            edges = np.flatnonzero(np.diff(block, prepend=-1, append=np.inf)) if len(block) else []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                who, para, code, sure = judge(batch.column(1).slice(s, e - s))
                ids = batch.column(0).slice(s, e - s).take(pa.array(who))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(para, pa.int32()), pa.array(code, pa.string()), pa.array(sure, pa.float64())],
                    names=[doc, "para_no", "lang_code", "confidence"],
                )

    source = documents.select(doc, F.col(text).cast("string").alias("_text"))
    return source.mapInArrow(run, f"`{doc}` {kind}, para_no int, lang_code string, confidence double")


def fit_on_documents(
    documents: DataFrame, doc: str, text: str, label: str, samples: DataFrame, sample_label: str, sample_text: str, *,
    max_docs: int = 3_000, max_samples: int = 5_000,
) -> LanguageModel:
    """A model fitted on labelled sentences and at most ``max_docs`` labelled documents.

    The documents are the first by a hash of the id among those whose label names a
    known language; ``max_samples`` bounds the sentences in the same way.
    """
    def first(df: DataFrame, lang: str, body: str, key: Column, n: int) -> list[tuple[str, str]]:
        known = df.select(language_of_label(lang).alias("l"), F.col(body).alias("t"), key.alias("k"))
        known = known.filter(F.col("l").isNotNull() & F.col("t").isNotNull())
        return [(r["l"], r["t"]) for r in known.orderBy("k", "l", "t").limit(n).collect()]

    clean = first(samples, sample_label, sample_text, F.xxhash64(sample_text), max_samples)
    noisy = first(documents, label, text, F.xxhash64(doc), max_docs)
    return fit_language_model(clean, noisy)
