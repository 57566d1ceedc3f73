"""Language identification by interpolated Kneser-Ney character models.

A text's letter runs, lower-cased, are words; each is padded to its left and closed to its right, so that a
letter is predicted from the ``ORDER - 1`` before it in its word. For every language an interpolated
Kneser-Ney model is fitted: raw counts at the highest order, continuation counts below, one discount per
order. The models stand side by side in sorted arrays of 64-bit gram hashes, for each order the log
probabilities of all languages and the weights of backing off. The language of the lowest cross-entropy per
letter is chosen.

Rejection is calibrated on labelled documents that the fit has not seen, and on the same documents with their
letters shuffled: a text is rejected where its entropy is nearer to shuffled letters than to its language,
with an allowance for short texts. Every language has a limit: one with fewer than ``LEAST_CALIBRATED`` rightly
predicted documents for the calibration takes it from its own documents of the fit. Their entropy is that of the words
which a model of the other half of the words gives, and so an upper bound of what new texts of the language have; it is
held against the same documents with their letters shuffled, and counts as theirs at most. The deviation of
single texts is then that of all calibrated languages together.

The classifier is fitted on a bounded sample: about ``SAMPLE`` documents of each label for the fit and a
third of that for the calibration, picked by a hash of the id. That bounds what reaches the driver, and the model
that is broadcast. Prediction covers whole texts of all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastro.llm.common import ddl_type, free_name, map_rows, read

ORDER = 4
SAMPLE = 3000
UNKNOWN = "und"
#: Standard deviations of a text's length that its entropy may be above the limit.
ALLOWANCE = 3.0
#: Rightly predicted calibration documents from which on a language's limit and deviation are its own.
LEAST_CALIBRATED = 20
#: Labels from which on the training table is refused.
MOST_LANGUAGES = 2000
#: Words a task remembers the scores of; when full, it starts anew.
REMEMBERED = 150_000

_WORDS = re.compile(r"[^\W\d_]+").findall
_LEFT, _RIGHT = "\x02", "\x03"
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str | None) -> list[str]:
    """Lower-cased runs of letters; runs that hold signs which are no letters, such as fractions, lose them."""
    if not text:
        return []
    return [w for w in _WORDS(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def _hashes(codes: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of code points."""
    h = np.full(len(codes), codes.shape[1], dtype=np.uint64)
    for i in range(codes.shape[1]):
        h = (h ^ codes[:, i].astype(np.uint64)) * _PRIME
        h ^= h >> np.uint64(32)
    return h


def _codes(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All grams of the padded words as rows of code points, and how many each word has."""
    joined = "".join(_LEFT * (order - 1) + w + _RIGHT for w in words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    starts = np.arange(sizes.sum()) + np.repeat(np.arange(len(words)) * (order - 1), sizes)
    return points[starts[:, None] + np.arange(order)], sizes


@dataclass
class Model:
    """keys[n], logp[n]: grams of n letters; contexts[n], weights[n]: what n-letter grams are predicted from."""

    langs: list[str]
    order: int
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    unseen: np.ndarray
    limits: dict[str, tuple[float, float]]

    def of_grams(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last letter in every language."""
        out = np.zeros((len(codes), len(self.langs)), dtype=np.float32)
        left = np.arange(len(codes))
        for n in range(self.order, 0, -1):
            part = codes[left][:, self.order - n:]
            at, found = _find(self.keys[n], _hashes(part))
            out[left[found]] += self.logp[n][at[found]]
            left, part = left[~found], part[~found]
            if not len(left):
                return out
            at, found = _find(self.contexts[n], _hashes(part[:, :-1]))
            out[left[found]] += self.weights[n][at[found]]
        out[left] += self.unseen
        return out

    def of_words(self, words: list[str]) -> np.ndarray:
        """Summed log probability of each word, its end included."""
        codes, sizes = _codes(words, self.order)
        return np.add.reduceat(self.of_grams(codes), np.cumsum(sizes) - sizes, axis=0)

    def rejects(self, lang: str, entropy: float, n: int) -> bool:
        if not self.limits:
            return False  # scoring for the calibration itself, which sets one for every language
        limit, per_letter = self.limits[lang]
        return entropy > limit + ALLOWANCE * (per_letter / n) ** 0.5


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _language(codes: np.ndarray, counts: np.ndarray, order: int, letters_known: int) -> list[dict]:
    """For every order: gram hashes, interpolated probabilities, context hashes and weights of backing off."""
    levels = []
    for n in range(order, 0, -1):
        grams, contexts = _hashes(codes), _hashes(codes[:, :-1])
        ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
        discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        at_context, where = np.unique(contexts, return_inverse=True)
        totals = np.bincount(where, weights=counts)
        weight = discount * np.bincount(where) / totals
        # distinct continuations to the left are the counts of the next lower order
        lower, first, suffix, times = np.unique(_hashes(codes[:, 1:]), return_index=True, return_inverse=True, return_counts=True)
        levels.append({"grams": grams, "codes": codes, "seen": (counts - discount) / totals[where], "back": weight[where], "suffix": suffix, "contexts": at_context, "weights": weight})
        codes, counts = codes[first][:, 1:], times.astype(np.float64)
    below = None
    for level in reversed(levels):  # from one letter up
        beneath = np.full(len(level["grams"]), 1.0 / letters_known) if below is None else below[level["suffix"]]
        level["p"] = below = level["seen"] + level["back"] * beneath
    return levels[::-1]


def _known(counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> int:
    """Different letters, the word's end and one for all others included."""
    return len(np.unique(np.concatenate([c[:, -1] for c, _ in counted.values()]))) + 1


def fit(counted: dict[str, tuple[np.ndarray, np.ndarray]], order: int, known: int | None = None) -> Model:
    """The model of {language: (gram code points, counts)}, without limits of rejection."""
    langs = sorted(counted)
    known = known or _known(counted)
    levels = {lang: _language(*counted[lang], order, known) for lang in langs}
    unseen = np.full(len(langs), np.log(1.0 / known), dtype=np.float32)
    model = Model(langs, order, [np.empty(0, np.uint64)], [np.empty((0, len(langs)), np.float32)], [np.empty(0, np.uint64)], [np.empty((0, len(langs)), np.float32)], unseen, {})
    for n in range(1, order + 1):
        weights = [levels[x][n - 1] for x in langs]
        contexts = np.unique(np.concatenate([w["contexts"] for w in weights]))
        back = np.zeros((len(contexts), len(langs)), dtype=np.float32)
        for j, w in enumerate(weights):
            back[np.searchsorted(contexts, w["contexts"]), j] = np.log(w["weights"])
        # A gram that one language has seen gets its backed-off probability in the others as well.
        keys, first = np.unique(np.concatenate([w["grams"] for w in weights]), return_index=True)
        codes = np.concatenate([w["codes"] for w in weights])[first]
        table = np.empty((len(keys), len(langs)), dtype=np.float32)
        if n > 1:
            at, found = _find(model.keys[n - 1], _hashes(codes[:, 1:]))
            table[:] = model.logp[n - 1][at]  # every suffix of a seen gram has been seen
        else:
            table[:] = unseen
        at, found = _find(contexts, _hashes(codes[:, :-1]))
        table += np.where(found[:, None], back[at], 0)
        for j, w in enumerate(weights):
            table[np.searchsorted(keys, w["grams"]), j] = np.log(w["p"])
        model.keys.append(keys)
        model.logp.append(table)
        model.contexts.append(contexts)
        model.weights.append(back)
    return model


def _gram_counts(order: int):
    """Rows of (text, lang) to (lang, half of the words, gram, n); all of one word are in one half."""

    def rows(columns):
        words: dict[str, Counter] = {}
        for text, lang in zip(*columns):
            words.setdefault(lang, Counter()).update(letters(text))
        out: Counter = Counter()
        for lang, counter in words.items():
            for word, count in counter.items():
                padded = _LEFT * (order - 1) + word + _RIGHT
                half = crc32(word.encode("utf-8", "surrogatepass")) % 2
                for i in range(len(word) + 1):
                    out[lang, half, padded[i:i + order]] += count
        return [[k[0] for k in out], [k[1] for k in out], [k[2] for k in out], list(out.values())]

    return rows


def _counts_of(grams, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram code points, counts) of rows of (gram, n)."""
    codes = np.frombuffer("".join(grams["gram"]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, order)
    return codes, grams["n"].to_numpy(dtype=np.float64)


def _of_other_half(halves: list[tuple[np.ndarray, np.ndarray]], order: int, known: int) -> float:
    """Entropy a letter of each half of a language's words in a model of the other half; infinite where there are no two halves."""
    if len(halves) < 2:
        return np.inf
    total = letters_in = 0.0
    for mine, other in (halves, halves[::-1]):
        total -= float((fit({"": other}, order, known).of_grams(mine[0])[:, 0] * mine[1]).sum(dtype=np.float64))
        letters_in += float(mine[1].sum())
    return total / letters_in


def _shuffled(texts: list[str | None]) -> list[str]:
    """The texts' letters in another order, in words of the same lengths."""
    out = []
    for text in texts:
        words = letters(text)
        mixed = list("".join(words))
        np.random.default_rng(len(mixed)).shuffle(mixed)
        at = np.cumsum([0] + [len(w) for w in words])
        out.append(" ".join("".join(mixed[i:j]) for i, j in zip(at, at[1:])))
    return out


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", order: int = ORDER, sample: int = SAMPLE) -> Model | None:
    """Fit and calibrate. Rows without text, label or letters teach nothing; None where nothing can be learnt."""
    hashed = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col).cast("string")), F.lit(1_000_000))
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lang"), hashed.alias("draw"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}  # one row a label
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels: these are not languages")
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, 1_000_000 * sample * 4 / 3 / n)])
    drawn = rows.where(F.col("draw") < share[F.col("lang")]).select("text", "lang", (F.col("draw") % 4 == 0).alias("calibrate"))
    fitted = drawn.where(~F.col("calibrate")).select("text", "lang")
    grams = map_rows(fitted, "lang string, half int, gram string, n bigint", _gram_counts(order))
    table = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).orderBy("lang", "gram").toPandas()
    counted = {lang: _counts_of(group, order) for lang, group in table.groupby("lang", sort=True)}
    if not counted:
        return None
    model = fit(counted, order)
    held = drawn.where("calibrate").select("text", "lang")
    own = score(held, model, "lang", "text").where("n_letters > 0 and lang = lang_pred").select("lang", "entropy", "n_letters").toPandas()
    mixed = score(held, model, "lang", "text", shuffled=True).where("n_letters > 0").select("lang", "entropy").toPandas()
    spread: list[float] = []
    for lang in model.langs:
        real, noise = own[own["lang"] == lang], mixed[mixed["lang"] == lang]["entropy"].median()
        if len(real) >= LEAST_CALIBRATED:
            mean = real["entropy"].median()
            residuals = ((real["entropy"] - mean) ** 2 * real["n_letters"]).tolist()
            spread += residuals
            # Where shuffled letters are no stranger than texts, the strangest text is the limit.
            model.limits[lang] = (float((mean + noise) / 2 if noise > mean else real["entropy"].max()), _per_letter(residuals))
    rare = [lang for lang in model.langs if lang not in model.limits]
    if rare:
        few = F.col("lang").isin(rare)
        noises = _shuffled_entropies(fitted.where(few), model)
        table = grams.where(few).groupBy("lang", "half", "gram").agg(F.sum("n").alias("n")).orderBy("lang", "half", "gram").toPandas()
        for lang, group in table.groupby("lang", sort=True):
            real = _of_other_half([_counts_of(half, order) for _, half in group.groupby("half", sort=True)], order, _known(counted))
            model.limits[lang] = ((min(real, noises[lang]) + noises[lang]) / 2, _per_letter(spread))
    return model


def _per_letter(residuals: list[float]) -> float:
    """Variance of one letter's entropy; of a normal law, the median square is 0.45 variances."""
    return max(1.0, float(np.median(residuals)) * 2.2) if residuals else 1.0


def _shuffled_entropies(texts: DataFrame, model: Model) -> dict[str, float]:
    """Entropy a letter of each label's texts with their letters shuffled, in the label's own language."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def rows(columns):
        at = {lang: i for i, lang in enumerate(shared.value.langs)}
        nats, counts = [], []
        for text, lang in zip(_shuffled(columns[0]), columns[1]):
            words = letters(text)
            parts = [words[i:i + 2000] for i in range(0, len(words), 2000)]
            nats.append(-sum(float(shared.value.of_words(p)[:, at[lang]].sum(dtype=np.float64)) for p in parts))
            counts.append(sum(map(len, words)) + len(words))
        return [columns[1], nats, counts]

    of_texts = map_rows(texts, "lang string, nats double, n bigint", rows)
    return {r["lang"]: r["nats"] / r["n"] for r in of_texts.groupBy("lang").agg(F.sum("nats").alias("nats"), F.sum("n").alias("n")).collect()}  # one row a label


class _Scorer:
    def __init__(self, model: Model | None):
        self.model, self.rows, self.table = model, {}, None
        self._reset()

    def _reset(self) -> None:
        self.rows = {}
        self.table = np.zeros((1 << 14, len(self.model.langs) if self.model else 1), dtype=np.float32)

    def _learn(self, lists: list[list[str]]) -> None:
        new = list({w for words in lists for w in words if w not in self.rows})
        if len(self.rows) + len(new) > REMEMBERED and self.rows:
            self._reset()
            new = list({w for words in lists for w in words})
        if not new:
            return
        at = len(self.rows)
        while at + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for start in range(0, len(new), 20_000):
            part = new[start:start + 20_000]
            self.table[at + start:at + start + len(part)] = self.model.of_words(part)
        self.rows.update(zip(new, range(at, at + len(new))))

    def score(self, texts: list[str | None]) -> list[list]:
        lists = [letters(t) for t in texts]
        langs, scores, entropies, counts, rejected = [], [], [], [], []
        if self.model:
            self._learn(lists)
        for words in lists:
            n = sum(map(len, words)) + len(words)
            counts.append(n - len(words))
            if not words or not self.model:
                langs.append(UNKNOWN)
                scores.append(0.0)
                entropies.append(None)
                rejected.append(True)
                continue
            at = np.fromiter(map(self.rows.__getitem__, words), dtype=np.int64, count=len(words))
            entropy = -self.table[at].sum(axis=0, dtype=np.float64) / n
            best = int(entropy.argmin())  # of equals the first by name
            lang = self.model.langs[best]
            reject = self.model.rejects(lang, float(entropy[best]), n)
            langs.append(lang)
            rejected.append(reject)
            entropies.append(float(entropy[best]))
            scores.append(0.0 if reject else float(1.0 / np.exp(-(entropy - entropy[best]) * n**0.5).sum()))
        return [langs, scores, entropies, counts, rejected]


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", shuffled: bool = False) -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` (0 to 1), ``entropy`` (nats a letter), ``n_letters``, ``rejected``; one row per document.

    A null text and a text without a letter are ``und`` with a score of 0, and rejected; so is everything if there
    is no model. A rejected text still names its nearest language, with a score of 0. The score is the share of the
    best language among all, each weighed by its entropy over the root of the length. Ties go to the first name.
    ``shuffled`` scores the texts with their letters in another order, for the calibration.
    """
    # A model holds a bounded sample's grams, so its size has a bound too.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(columns, scorer):
        return [columns[0], *scorer.score(_shuffled(columns[1]) if shuffled else columns[1])]

    schema = f"`{id_col}` {ddl_type(docs, id_col)}, lang_pred string, score double, entropy double, n_letters bigint, rejected boolean"
    return map_rows(docs.select(id_col, text_col), schema, rows, lambda: _Scorer(shared.value))


def held_out(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The documents' columns without rejected rows; a missing label is filled in. Learns from rows that are not held out."""
    model = train(docs.where(~F.coalesce(held_out(id_col), F.lit(True))), id_col, text_col, label_col)
    place = free_name(docs, "_row")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(place), F.col(f"`{text_col}`").alias("text"))
    kept = score(whole, model, place, "text").where(~F.col("rejected"))
    label = F.coalesce(F.col(f"{place}.`{label_col}`"), F.col("lang_pred")).alias(label_col)
    return kept.select(*[label if c == label_col else F.col(f"{place}.`{c}`").alias(c) for c in docs.columns])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out("doc_id")))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "entropy", "n_letters", "rejected")


QUERIES = {"op6_language_id": op6_language_id}
ORACLES = {}
