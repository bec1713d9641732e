"""Text cut off by field limits (problem 9): hashed logistic regression trained on artificially cut texts.

Intact texts of a bounded, hash-chosen sample are cut at random places, at the length limits seen in the corpus and with
marks of a cut appended; these are the positives, the texts as they stand the negatives. Features are the closing
characters, words and punctuation, the shape of the last line against the others, unclosed fences and brackets, whether
the last word occurs elsewhere in the corpus, and how the length stands to a limit of its source. Negatives that the
first model is sure about are dropped and the model fitted again. Limits and word counts cover all documents.

Defined results: null, empty and blank texts are never flagged; a null source is one of its own; repeated rows are scored
each; every score depends on the whole corpus and the row alone, so it is the same in any order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import durable
from .tokens import normal_source

#: Texts the classifier is fitted on at most, artificial cuts of each, and size of the hashed feature space.
SAMPLE, CUTS, FEATURES = 12_000, 2, 1 << 15
#: Size of the hashed set of known words, and documents, or share of all documents, that a word must occur in to be known.
WORDS, KNOWN, KNOWN_SHARE = 1 << 20, 3, 2e-5
#: A length is a limit of a source if so much log-likelihood says that more different texts end openly at it than at the
#: lengths around: less is asked of lengths that people choose (tens, thirty-twos, one below a round number).
#: It must have so many times the texts of the lengths around, too.
LIMIT_CHOSEN, LIMIT_ANY, LIMIT_RATIO = 9.0, 14.0, 3.0
#: Cut texts score above it on held-out artificial cuts, intact ones with odd endings below.
THRESHOLD = 0.28

_MARK = re.compile(r"\s*(?:\[(?:\.\.\.|…|[^\]\n]{0,12}(?:cut|clip|trunc|more|snip|abbrev|abridg|omitted|gek|suite|continu|tronqu|recort)[^\]\n]{0,16})\]|\((?:\.\.\.|…|[^)\n]{0,12}(?:cut|clip|trunc|more|snip|continu|tronqu)[^)\n]{0,16})\)|<(?:cut|truncated|snip|more)[^>\n]{0,12}>|…|\.{3,})$", re.I)
_HARD_MARK = re.compile(r"[\[(<]")
_MARKS = ("", "", "", "", " …", "…", "...", " [truncated]", "[...]", " (cut)", " [message clipped]", " [more]")
_WORD = re.compile(r"[^\W\d_]+")
_LAST_TOKEN = re.compile(r"\S+$")
_END = ".!?:;)]}>\"'`»”’*_|/-–—,…"
_BULLET = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s")
_FIELD = re.compile(r"\s*[\w.-]{1,40}:\s")
_HEADING = re.compile(r"\s*#{1,6}\s")


def known_words(documents: DataFrame) -> np.ndarray:
    """Bits of the words that stand in enough documents before their last word; of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, words, total = np.zeros(WORDS, dtype=np.int64), Counter(), 0

        def settle() -> None:
            at = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % WORDS for w in words), dtype=np.int64, count=len(words))
            np.add.at(seen, at, np.fromiter(words.values(), dtype=np.int64, count=len(words)))
            words.clear()

        for b in batches:
            for text in b.column(0).to_pylist():
                parts = text.rsplit(None, 1)
                if len(parts) == 2:
                    words.update(set(_WORD.findall(parts[0].lower())))
            total += b.num_rows
            if len(words) > 1 << 18:
                settle()
        settle()
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(seen[at], total))], names=["w", "n"])

    counts = durable(documents.where("text IS NOT NULL").select("text").mapInArrow(count, "w int, n bigint").groupBy("w").agg(F.sum("n").alias("n")))
    total = counts.where("w = -1").agg(F.sum("n")).first()[0] or 0
    bits = np.zeros(WORDS, dtype=bool)
    bits[[r["w"] for r in counts.where((F.col("w") >= 0) & (F.col("n") >= max(KNOWN, int(KNOWN_SHARE * total)))).select("w").collect()]] = True
    return np.packbits(bits)


def length_limits(documents: DataFrame) -> set[tuple[str, int]]:
    """(source, characters) or (source, -bytes) pairs at which far more different texts end openly than at the lengths around.

    Complete texts of one length, and copies of one text, make no limit.
    """
    open_ = documents.where("text IS NOT NULL").where(F.rtrim("text").rlike(r"[^.!?:;)`\]}>|\s]$"))
    sizes = open_.select(F.coalesce(normal_source(F.col("source")), F.lit("")).alias("source"), F.length("text").alias("c"), (-F.octet_length("text")).alias("b"), F.xxhash64("text").alias("h")).distinct()
    per = sizes.select("source", F.explode(F.array_distinct(F.array("c", "b"))).alias("n")).groupBy("source", "n").agg(F.count(F.lit(1)).alias("k"))
    per = per.withColumn("near", (F.col("n") / 32).cast("int"))
    around = per.groupBy("source", "near").agg(F.sum("k").alias("all"))
    # A limit stands out of the lengths next to it too; the commonest lengths of short texts don't.
    beside = F.sum("k").over(Window.partitionBy("source").orderBy("n").rangeBetween(-2, 2))  # over lengths, not texts
    per = per.withColumn("beside", (beside - F.col("k")) / 4)
    rate = F.greatest((F.col("all") - F.col("k") + 1) / 32, F.col("beside"))
    gain = F.col("k") * F.log(F.col("k") / rate) - (F.col("k") - rate)
    n = F.abs("n")
    chosen = (n % 10 == 0) | (n % 32 == 0) | (n % 50 == 49) | (n % 256 == 255)
    peaks = per.join(around, ["source", "near"]).where((F.col("k") >= LIMIT_RATIO * rate) & (gain >= F.when(chosen, LIMIT_CHOSEN).otherwise(LIMIT_ANY)))
    return {(r["source"], r["n"]) for r in peaks.select("source", "n").collect()}


def _known(bits: np.ndarray, word: str) -> bool:
    h = zlib.crc32(word.lower().encode()) % WORDS
    return bool(bits[h >> 3] >> (7 - (h & 7)) & 1)


def features(text: str, source: str, limits: set[tuple[str, int]], bits: np.ndarray) -> list[int]:
    """Indices of the features that hold for one text."""
    whole = text.rstrip()
    mark = _MARK.search(whole)
    body = whole[: mark.start()] if mark else whole
    size = body.encode("utf-8", "replace") if not body.isascii() else None
    at_limit = (source, len(text)) in limits or (source, -(len(text.encode("utf-8", "replace")))) in limits
    # With a mark, the limit may count the text before it.
    at_limit = at_limit or bool(mark) and ((source, len(body)) in limits or size is not None and (source, -len(size)) in limits)
    lines = body.rsplit("\n", 2)
    last = lines[-1]
    fences = body.count("```")
    in_code = fences % 2 == 1
    token = (_LAST_TOKEN.search(last) or [""])[0]
    word = _WORD.findall(token)
    tail = word[-1] if word else ""
    end = body[-1:] or " "
    kind = "a" if end.islower() else "A" if end.isupper() else "9" if end.isdigit() else "k" if end.isalpha() else end if end in _END else "�" if end == "�" else "?"
    before = lines[-2].strip() if len(lines) > 1 else ""
    shape = "code" if in_code else "sign" if before in ("--", "—", "__") else "fence" if last.strip().startswith("```") else "head" if _HEADING.match(last) else "bullet" if _BULLET.match(last) else "field" if _FIELD.match(last) and len(last) < 90 else "only" if "\n" not in body else "text"
    n = len(last.split())
    size_bin = 0 if n <= 2 else 1 if n <= 4 else 2 if n <= 6 else 3 if n <= 12 else 4
    closed = kind in ".!?"
    # How the document's other lines of the same shape end.
    others = [x.rstrip() for x in body.split("\n")[:-1] if x.strip()]
    same = [x for x in others if bool(_BULLET.match(x)) == (shape == "bullet") and (shape != "field" or _FIELD.match(x))]
    period = -1 if not same else int(10 * sum(x[-1] in ".!?" for x in same) / len(same)) // 4
    sentences = len(re.findall(r"[.!?](?:\s|$)", last))
    opened = max(-1, min(2, last.count("(") - last.count(")"))) + 3 * (last.count("`") % 2) + 6 * (last.count('"') % 2)
    after = last.rstrip()
    began = len(re.split(r"(?<=[.!?])\s+", after)[-1].split()) if sentences and not closed else 0
    known = 2 if not tail else int(_known(bits, tail))
    f = [
        f"k{kind}", f"s{shape}", f"ks{kind}{shape}", f"ksn{kind}{shape}{size_bin}", f"l{at_limit}", f"lk{at_limit}{closed}", f"ls{at_limit}{shape}{closed}", f"lks{at_limit}{shape}{kind}{known}",
        f"w{known}", f"wk{known}{kind}{shape}", f"o{opened}", f"os{opened}{shape}", f"c{in_code}", f"p{period}{closed}", f"ps{period}{shape}{closed}", f"b{min(began, 6)}{closed}", f"bs{min(began, 6)}{shape}{sentences > 0}",
        f"t{tail.lower()}{closed}", f"tt{token[-24:].lower()}", f"e2{body[-2:]}", f"e3{body[-3:]}", f"n{shape}{min(n, 20)}{closed}", f"m{bool(mark)}", f"q{sentences > 0}{shape}{closed}",
        f"sp{len(text) - len(whole)}{closed}", f"2{' '.join(last.lower().split()[-2:])}", f"src{source}{closed}{shape}", f"3{' '.join(last.lower().split()[-3:])}", f"2m{' '.join(last.lower().split()[-2:])}{bool(mark)}",
    ]
    if mark:
        f += [f"mh{bool(_HARD_MARK.search(mark.group()))}", f"mk{mark.group().strip()[:3]}{closed}", f"mw{mark.group().strip().lower()}", f"mks{kind}{known}{mark.group().startswith(' ')}"]
    return [zlib.crc32(x.encode("utf-8", "replace")) % FEATURES for x in f]


def cuts_of(text: str, source: str, limits: set[tuple[str, int]], seed: int) -> list[str]:
    """Artificially cut versions of an intact text."""
    rng = np.random.default_rng(seed & 0x7FFFFFFF)
    out = []
    whole = text.rstrip()
    here = sorted(n for s, n in limits if s == source and 0 < n < len(whole) - 1)
    for _ in range(CUTS):
        if here and rng.random() < 0.5:
            at = int(rng.choice(here))
        elif len(whole) > 40:
            at = int(rng.integers(max(20, len(whole) // 5), len(whole) - 1))
        else:
            continue
        got = whole[:at]
        # A cut right behind a sentence can't be told from an intact text.
        if got.rstrip().endswith((".", "!", "?")) or got.endswith("\n"):
            continue
        if rng.random() < 0.1:  # a cut in bytes, through a character
            out.append(got + "�" * int(rng.integers(1, 3)))
            continue
        out.append(got + _MARKS[int(rng.integers(len(_MARKS)))])
    return out


def is_intact(text: str, source: str, limits: set[tuple[str, int]]) -> bool:
    """Whether a text may serve as an intact example: no sign that only a cut leaves, nor an open end at a limit."""
    whole = text.rstrip()
    mark = _MARK.search(whole)
    if whole.endswith("�") or mark and _HARD_MARK.search(mark.group()):
        return False
    limited = (source, len(text)) in limits or (source, -len(text.encode("utf-8", "replace"))) in limits
    return not (limited and whole[-1:] not in ".!?:;)`")


def _fit(rows: list[list[int]], labels: np.ndarray, keep: np.ndarray, rounds: int = 24) -> np.ndarray:
    """Weights of a logistic regression (last one: bias) by AdaGrad over mini-batches."""
    width = max(len(r) for r in rows)
    index = np.full((len(rows), width), FEATURES, dtype=np.int64)
    for k, r in enumerate(rows):
        index[k, : len(r)] = r
    w, g = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-2)
    bias, gb = 0.0, 1e-2
    rng = np.random.default_rng(7)
    chosen = np.flatnonzero(keep)
    for _ in range(rounds):
        for batch in np.array_split(rng.permutation(chosen), max(1, len(chosen) // 256)):
            x = index[batch]
            p = 1 / (1 + np.exp(-np.clip(w[x].sum(1) + bias, -30, 30)))
            d = p - labels[batch]
            grad = np.bincount(x.ravel(), weights=np.repeat(d / len(batch), width), minlength=FEATURES + 1)
            grad += 1e-5 * w
            grad[FEATURES] = 0
            g += grad**2
            w -= 0.3 * grad / np.sqrt(g)
            gb += d.mean() ** 2
            bias -= 0.3 * d.mean() / gb**0.5
    w[FEATURES] = 0
    return np.append(w, bias)


def score_rows(rows: list[list[int]], weights: np.ndarray) -> np.ndarray:
    """Probabilities of rows of feature indices: one sum over all of them together."""
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    flat = np.fromiter((f for r in rows for f in r), dtype=np.int64, count=int(sizes.sum()))
    sums = np.bincount(np.repeat(np.arange(len(rows)), sizes), weights=weights[flat], minlength=len(rows))
    return 1 / (1 + np.exp(-np.clip(sums + weights[-1], -30, 30)))


class Model:
    """A fitted classifier: weights, length limits and known words, all of bounded size."""

    def __init__(self, weights: np.ndarray, limits: set[tuple[str, int]], bits: np.ndarray):
        self.weights, self.limits, self.bits = weights, limits, bits

    def score(self, text: str, source: str) -> float:
        return float(score_rows([features(text, source, self.limits, self.bits)], self.weights)[0])


def fit(documents: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fitted on at most about ``sample`` texts, chosen by hash; None where no document has a text."""
    texts = documents.where("text IS NOT NULL AND trim(text) != ''").select("text", F.coalesce(normal_source(F.col("source")), F.lit("")).alias("source"), F.xxhash64("text").alias("h"))
    total = texts.count()
    if not total:
        return None
    limits, bits = length_limits(documents), known_words(documents)
    share = min(1.0, sample / total)
    chosen = texts.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, rows = [], []
            for text, source, h in zip(*[c.to_pylist() for c in b.columns]):
                if not is_intact(text, source, limits):
                    continue
                label.append(2 if _MARK.search(text.rstrip()) else 0)
                rows.append(features(text, source, limits, bits))
                for cut in cuts_of(text, source, limits, h):
                    label.append(1)
                    rows.append(features(cut, source, limits, bits))
            yield pa.RecordBatch.from_arrays([pa.array(label, type=pa.int32()), pa.array(rows, type=pa.list_(pa.int32()))], names=["label", "f"])

    got = chosen.mapInArrow(run, "label int, f array<int>").collect()
    got.sort(key=lambda r: (r["label"], r["f"]))
    # Texts that end with dots are kept as negatives whatever the first model says: most of them are complete.
    rows, kinds = [list(r["f"]) for r in got], np.array([r["label"] for r in got])
    labels = (kinds == 1).astype(float)
    keep = np.ones(len(rows), dtype=bool)
    weights = _fit(rows, labels, keep)
    for _ in range(2):
        keep = (kinds > 0) | (score_rows(rows, weights) < 0.6)
        weights = _fit(rows, labels, keep)
    return Model(weights, limits, bits)


def scored(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, source, score, truncated) for every document row that has a text."""
    model = model or fit(documents)
    if model is None:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, source string, score double, truncated boolean")
    rows = documents.where("text IS NOT NULL AND trim(text) != ''").select("doc_id", F.coalesce(normal_source(F.col("source")), F.lit("")).alias("source"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score_rows([features(t, x, model.limits, model.bits) for x, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())], model.weights)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array(s >= THRESHOLD)], names=["doc_id", "source", "score", "truncated"])

    return rows.mapInArrow(run, "doc_id bigint, source string, score double, truncated boolean")


def truncation_rates(scores: DataFrame) -> DataFrame:
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("truncated").cast("int")).alias("truncated"), F.round(F.avg(F.col("truncated").cast("int")), 6).alias("rate"))
