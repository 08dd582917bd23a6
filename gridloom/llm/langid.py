"""The language of documents and of the segments of mixed ones."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ["en", "de", "fr", "es", "pt", "it", "nl"]
#: Names and codes of languages in labels; a label that is not among them names no language.
LABELS = {
    "en": "en", "eng": "en", "english": "en", "de": "de", "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "francais": "fr",
    "es": "es", "spa": "es", "spanish": "es", "español": "es", "espanol": "es", "castellano": "es", "pt": "pt", "por": "pt", "portuguese": "pt", "português": "pt", "portugues": "pt",
    "it": "it", "ita": "it", "italian": "it", "italiano": "it", "nl": "nl", "nld": "nl", "dut": "nl", "dutch": "nl", "nederlands": "nl",
    "sv": "sv", "swe": "sv", "swedish": "sv", "da": "da", "dan": "da", "danish": "da", "no": "no", "nor": "no", "norwegian": "no", "fi": "fi", "fin": "fi", "finnish": "fi", "pl": "pl", "pol": "pl", "polish": "pl", "cs": "cs", "ces": "cs", "cze": "cs", "czech": "cs", "ru": "ru", "rus": "ru", "russian": "ru", "ca": "ca", "cat": "ca", "catalan": "ca", "ro": "ro", "ron": "ro", "rum": "ro", "romanian": "ro", "la": "la", "lat": "la", "latin": "la",
}
#: The bound of the sample that the model is fitted on: expected documents per language, and the longest taken, in characters. Every document is scored, whatever its length.
FIT_DOCUMENTS, FIT_LENGTH = 60, 12_000
#: n-grams of the blended spectrum, hashed dimensions, landmarks per language, ridge.
SPECTRUM, DIMENSIONS, LANDMARKS, RIDGE = (1, 2, 3, 4, 5), 1 << 16, 40, 1e-3
#: Least margin of a line with a language, and of a line of up to FEW words; words or lines worked on at once while fitting.
MARGIN, SURE, FEW, CHUNK = 0.12, 0.72, 3, 1000
#: Lines at the top of a document that hold court, docket and parties.
HEAD_LINES = 3
REMEMBERED = 300_000


def label_code(label: str | None) -> str | None:
    """The two-letter code of the language that a label names, None if it names none."""
    base = re.split(r"[-_ ]", (label or "").strip().lower())[0]
    return LABELS.get(base)


_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
_PAGE = re.compile(r"^\W*[A-Z]{2,5}\b.*·\s*\d+(?:\s*/\s*\d+)?\W*$")
_SMALL = re.compile(r"[a-zß-öø-ÿ]{2}")
_TITLE = re.compile(r"[^\W\d_]{4}")


def speaks(line: str) -> bool:
    """Whether a line can have a language: not a page header, a bare citation or docket, a redaction or a list of names."""
    line = line.strip()
    if not line or _PAGE.match(line):
        return False
    if not _SMALL.search(line):
        return not any(c.isdigit() for c in line) and "█" not in line and bool(_TITLE.search(line)) and " / " not in line
    return not (" / " in line and all(t[0].isupper() or not t[0].isalpha() for t in line.split()))


def _grams(word: str) -> np.ndarray:
    """The hashed n-grams present in a word with its ends marked."""
    w = f" {word} "
    return np.fromiter({crc32(w[i : i + n].encode("utf-8", "surrogatepass")) & (DIMENSIONS - 1) for n in SPECTRUM for i in range(len(w) - n + 1)}, np.int64)


def words_of(token: str) -> list[str]:
    """The words of a token, in lower case and composed."""
    return [unicodedata.normalize("NFC", w).lower() for w in _WORD.findall(token)]


class Vocabulary:
    """Distinct words and, packed one after the other, their n-grams."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.grams: list[np.ndarray] = []

    def __getitem__(self, word: str) -> int:
        i = self.index.get(word)
        if i is None:
            i = self.index[word] = len(self.grams)
            self.grams.append(_grams(word))
        return i

    def scored(self, weights: np.ndarray) -> np.ndarray:
        """For each word the mean of the rows of ``weights`` of its n-grams: with landmarks as columns, the kernel with each."""
        parts = [np.zeros((0, weights.shape[1]), weights.dtype)]
        for lo in range(0, len(self.grams), CHUNK):
            new = self.grams[lo : lo + CHUNK]
            sizes = np.array([len(g) for g in new])
            parts.append((np.add.reduceat(weights[np.concatenate(new)], np.r_[0, np.cumsum(sizes)[:-1]], axis=0) / sizes[:, None]).astype(weights.dtype))
        return np.concatenate(parts)


def _means(word_rows: np.ndarray, lines: list[list[int]]) -> np.ndarray:
    """The mean row of the words of each line."""
    parts = []
    for lo in range(0, len(lines), CHUNK):
        new = lines[lo : lo + CHUNK]
        sizes = np.array([len(x) for x in new])
        flat = np.fromiter((w for x in new for w in x), np.int64, int(sizes.sum()))
        parts.append(np.add.reduceat(word_rows[flat], np.r_[0, np.cumsum(sizes)[:-1]], axis=0) / sizes[:, None])
    return np.concatenate(parts)


def fit(texts: list[str], labels: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(weights, intercept)``: what each n-gram adds to the score of each language.

    Lines are compared by a presence kernel: n-grams count once per word that has them, each word of a line having the same weight, so
    long lines and short ones compare alike; the kernel with a landmark is then the mean over a line's words. Landmarks from all
    languages span a Nyström space, in which one ridge regression per language tells it from the rest. As labels are partly wrong
    and texts partly mixed, a second fit leaves out the lines that the first finds in another language than their label.
    """
    rng = np.random.default_rng(seed)
    vocabulary, lines, y = Vocabulary(), [], []
    for text, label in zip(texts, labels):
        for k, line in enumerate(text.split("\n")):
            if k >= HEAD_LINES and speaks(line):
                ids = [vocabulary[w] for w in words_of(line)]
                if ids:
                    lines.append(ids)
                    y.append(LANGUAGES.index(label))
    target = np.array(y)
    if not lines:
        return np.zeros((DIMENSIONS, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES), np.float32)
    keep = np.ones(len(lines), bool)
    weights = intercept = None
    for _ in range(2):
        chosen = np.concatenate([rng.permutation(np.flatnonzero(keep & (target == c)))[:LANDMARKS] for c in range(len(LANGUAGES))])
        marks = np.zeros((DIMENSIONS, len(chosen)), np.float32)
        for j, i in enumerate(chosen):
            for w in lines[i]:
                g = vocabulary.grams[w]
                marks[g, j] += 1 / (len(g) * len(lines[i]))
        marks /= np.sqrt((marks**2).sum(0)) + 1e-12
        kernel = _means(vocabulary.scored(marks), lines).astype(np.float64)
        square = (marks.T @ marks).astype(np.float64)
        value, vector = np.linalg.eigh(square)
        ok = value > 1e-6 * value[-1]
        project = vector[:, ok] / np.sqrt(value[ok])
        z = kernel[keep] @ project
        want = np.where(target[keep][:, None] == np.arange(len(LANGUAGES)), 1.0, 0.0)
        count = np.bincount(target[keep], minlength=len(LANGUAGES)).astype(float)
        share = (1 / np.maximum(count, 1))[target[keep]]
        share *= len(share) / share.sum()
        middle, base = (z * share[:, None]).sum(0) / share.sum(), (want * share[:, None]).sum(0) / share.sum()
        zc = z - middle
        gram = zc.T @ (zc * share[:, None])
        solved = np.linalg.solve(gram + RIDGE * np.trace(gram) / len(gram) * np.eye(len(gram)), zc.T @ ((want - base) * share[:, None]))
        weights, intercept = (marks @ (project @ solved)).astype(np.float32), (base - middle @ solved).astype(np.float32)
        found = (kernel @ project @ solved + intercept).argmax(1)
        keep = found == target
    return weights, intercept


class Judge:
    """Scores lines with a fitted model; words are remembered."""

    def __init__(self, weights: np.ndarray, intercept: np.ndarray):
        self.weights, self.intercept = weights, intercept
        self.clear()

    def clear(self) -> None:
        self.tokens: dict[str, int] = {}
        self.sums = np.zeros((1024, len(LANGUAGES) + 1), np.float32)

    def _learn(self, tokens: list[str]) -> None:
        """Score new tokens in one batch: the sum over their words, and how many these are."""
        vocabulary, owner = Vocabulary(), []
        start = len(self.tokens)
        for t in tokens:
            self.tokens[t] = len(self.tokens)
            owner.append([vocabulary[w] for w in words_of(t)])
        if len(self.tokens) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros((max(len(self.sums), len(self.tokens)), self.sums.shape[1]), np.float32)])
        rows = vocabulary.scored(self.weights)
        for k, own in enumerate(owner):
            if own:
                self.sums[start + k, :-1] = rows[own].sum(0)
                self.sums[start + k, -1] = len(own)

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(scores, words)`` of each line: the mean score per language, and the number of its words."""
        split = [t.split() for t in texts]
        if len(self.tokens) > REMEMBERED:
            self.clear()
        known = self.tokens
        new = {t for x in split for t in x if t not in known}
        if new:
            self._learn(sorted(new))
        sizes = np.array([len(x) for x in split], np.int64)
        flat = np.fromiter((known[t] for x in split for t in x), np.int64, int(sizes.sum()))
        total = np.zeros((len(texts), len(LANGUAGES) + 1), np.float32)
        some = np.flatnonzero(sizes)
        if len(some):
            total[some] = np.add.reduceat(self.sums[flat], (np.cumsum(sizes) - sizes)[some], axis=0)
        words = total[:, -1]
        return total[:, :-1] / np.maximum(words, 1)[:, None] + self.intercept, words


def segments_of(texts: list[str], judge: Judge) -> list[tuple[str | None, float, list[tuple[int, str, float]]]]:
    """For each text ``(language, confidence, segments)``; language None if no line has words; segments (first line, language, confidence) cover the text from line 1.

    Clear lines alone set the borders of segments; the words of weak lines count for the segment that they are in. Where no line is
    clear, the language with the highest score over all words is taken.
    """
    owner, number, lines = [], [], []
    for d, text in enumerate(texts):
        for k, line in enumerate(text.split("\n")):
            if k >= HEAD_LINES and speaks(line):
                owner.append(d)
                number.append(k + 1)
                lines.append(line)
    scores, words = judge.lines(lines)
    best = scores.argmax(1)
    order = np.sort(scores, 1)
    margin = order[:, -1] - order[:, -2] if len(lines) else np.zeros(0)
    out: list = [[Counter(), []] for _ in texts]
    sure_line = margin >= np.where(words <= FEW, SURE, MARGIN) if len(lines) else margin
    waiting: list[tuple[int, int]] = []  # weak lines since the last clear one: number, row of scores
    last = -1

    def settle(d: int, rest: list[tuple[int, int]]) -> None:
        """The words of weak lines go to the last segment of text d, or all to one language if it has none."""
        if not rest:
            return
        at = [rr for _, rr in rest]
        n = float(words[at].sum())
        if not out[d][1]:
            mean = (scores[at] * words[at][:, None]).sum(0) / n
            b = int(mean.argmax())
            out[d][1].append([rest[0][0], b, float(np.ptp(np.sort(mean)[-2:])) * n, n])
        out[d][0][out[d][1][-1][1]] += n

    for row, (d, k, b, m, w, clear) in enumerate(zip(owner, number, best.tolist(), margin.tolist(), words.tolist(), sure_line.tolist())):
        if d != last:
            settle(last, waiting)
            waiting, last = [], d
        if not w:
            continue
        if not clear:
            waiting.append((k, row))
            continue
        out[d][0][b] += w
        runs = out[d][1]
        if runs and runs[-1][1] == b:
            settle(d, waiting)
        else:
            # weak lines right before a change, such as misread headings, go to the side that they resemble more
            start = k
            for kk, rr in reversed(waiting if runs else []):
                if scores[rr, b] <= scores[rr, runs[-1][1]]:
                    break
                start = kk
            if runs:
                settle(d, [x for x in waiting if x[0] < start])
            runs.append([start, b, 0.0, 0.0])
            settle(d, [x for x in waiting if x[0] >= start or len(runs) == 1])
        runs[-1][2] += m * w
        runs[-1][3] += w
        waiting = []
    settle(last, waiting)
    result = []
    for count, runs in out:
        if not count:
            result.append((None, 0.0, []))
            continue
        top = max(count.items(), key=lambda x: (x[1], -x[0]))[0]
        sure = sum(r[2] for r in runs if r[1] == top) / sum(count.values())
        spans = [(1 if n == 0 else r[0], LANGUAGES[r[1]], min(1.0, r[2] / r[3])) for n, r in enumerate(runs)]
        result.append((LANGUAGES[top], min(1.0, sure), spans))
    return result


def training_sample(df: DataFrame, key: str, text: str, label: str, per_language: int = FIT_DOCUMENTS) -> tuple[list[str], list[str]]:
    """Texts and labels of a bounded sample: of each language about ``per_language`` documents, picked by the hash of their keys, none longer than ``FIT_LENGTH`` characters."""
    codes = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    base = F.try_element_at(codes, F.split(F.lower(F.trim(F.col(label))), "[-_ ]")[0])
    usable = df.select(F.col(key).alias("k"), F.col(text).alias("t"), base.alias("code")).where(F.col("code").isin(LANGUAGES) & F.length("t").between(1, FIT_LENGTH))
    count = {r.code: r.n for r in usable.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not count:
        return [], []
    # so fine that the expected number stays the same for any number of documents
    grid = 1 << 50
    limits = F.create_map(*[F.lit(x) for c, n in count.items() for x in (c, min(grid, grid * per_language // n + 1))])
    rows = usable.where(F.pmod(F.xxhash64("k"), F.lit(grid)) < F.element_at(limits, F.col("code"))).collect()
    rows.sort(key=lambda r: (r.code, r.k))
    return [r.t for r in rows], [r.code for r in rows]


def languages(df: DataFrame, key: str, text: str, label: str, per_language: int = FIT_DOCUMENTS) -> DataFrame:
    """``(key, label_code, lang, confidence, segments array<struct<from_line, lang, confidence>>)`` of each document.

    ``lang`` is the language that most words are in, null for a text without words in a language (null, empty, names only).
    ``segments`` covers a document from line 1, lines without language belonging to the segment before them; one element means one
    language. ``label_code`` is the language that the label names, null if none. The model is fitted here on ``training_sample``;
    with no usable labels every language is null. Documents are scored where they lie, without a shuffle, whole texts throughout.
    """
    texts, labels = training_sample(df, key, text, label, per_language)
    weights, intercept = fit(texts, labels)
    model = df.sparkSession.sparkContext.broadcast((weights, intercept))
    some = bool(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*model.value)
        struct = pa.list_(pa.struct([("from_line", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64())]))
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                found = segments_of([t or "" for t in part.column(1).to_pylist()], judge) if some else [(None, 0.0, [])] * part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([label_code(x) for x in part.column(2).to_pylist()], pa.string()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([[{"from_line": s[0], "lang": s[1], "confidence": s[2]} for s in f[2]] for f in found], struct)],
                    ["key", "label_code", "lang", "confidence", "segments"],
                )

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label"))
    return out.mapInArrow(run, f"key {kind}, label_code string, lang string, confidence double, segments array<struct<from_line:bigint,lang:string,confidence:double>>").withColumnRenamed("key", key)
