"""Problem 10: abusive, hateful or sexual content, scored for every document.

Method: compression distance. Two zstandard dictionaries are trained, one on windows (sentences) of ordinary
text, one on windows of toxic text; a window's score is how much shorter it compresses with the toxic one, a
document's score that of its worst window. Nothing but reviewers' verdicts tells what is toxic, and those are
given for whole documents: the toxic windows of a harmful document are those that ordinary text doesn't explain
and the dictionary of other harmful documents' windows does, found by alternating between the two.

A trained dictionary keeps what recurs, so a small one isn't misled by single mislabelled documents; its size is
chosen, and the threshold calibrated, on folds of the labelled documents that training hasn't seen.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.session import cut, saved, spread

from .pii import INVISIBLE, LOOKALIKE

#: The classifier is fitted on at most this many labelled documents and windows of theirs, in the order of a hash;
#: a document that alone has a twentieth of the windows allowed isn't used for fitting (it is scored like any other).
MAX_LABELLED, MAX_WINDOWS = 20_000, 400_000
LEVEL, FOLDS, ROUNDS = 19, 4, 3
#: Dictionary sizes in bytes that cross-validation chooses from for ordinary text; the bound of the toxic one.
ORDINARY_BYTES, TOXIC_BYTES = (8_192, 16_384, 32_768, 65_536), 112_640
#: A window is strange if it compresses worse than this share of the windows of unseen fine documents.
STRANGE = 0.9
#: Least gain by the toxic dictionary for a window to stay in it.
GAIN = 0.1
#: What is toxic stands in harmful documents this many times as often as chance has it.
LIFT = 10.0
LONGEST, PIECE = 18, 14
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e", "|": "i"})
_split = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+|[\r\n•|]+|\s{2,}")
_mixed = re.compile(r"\S*(?:[a-z][013457@$!|€8][a-z]|[a-z][013457@$!€8]|[@$013457!][a-z])\S*")
_spaced = re.compile(r"\b(?:[a-z][.\-_*·]){2,}[a-z]\b")
_masked = re.compile(r"[a-z]?\*{2,}[a-z]*")
_odd = re.compile(r"[^a-z\s',.]|\.\S")


def _plain(s: str) -> str:
    """Spacing, dashes, digits for letters and masking undone in one sentence of lower case."""
    s = _spaced.sub(lambda m: re.sub(r"[.\-_*·]", "", m[0]), s)
    s = re.sub(r"([a-z])[-.]{1,3}(?=[a-z][-.])", r"\1", s) if s.count("-") + s.count(".") > 5 else s
    s = _mixed.sub(lambda m: m[0].rstrip(".,!?").translate(_LEET) + m[0][len(m[0].rstrip(".,!?")):], s)
    s = re.sub(r"\d+(?:[.,:/\-]\d+)*", "0", s)
    return _masked.sub("***", s)


def windows(text: str) -> list[str]:
    """The sentences of a text, deobfuscated: lower case, no accents, look-alikes, spacing and stretching undone."""
    out = []
    for part in _split.split(text):
        if not part or not part.strip():
            continue
        s = part
        if not s.isascii():
            s = "".join(LOOKALIKE.get(c, c) for c in s if c not in INVISIBLE)
            s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
        s = s.lower().strip()
        if _odd.search(s):
            s = _plain(s)
        s = re.sub(r"([a-z])\1{2,}", r"\1", s)
        s = re.sub(r"[^\w*'’]+", " ", s).strip()
        if s:
            ws = s.split(" ")
            if len(ws) <= LONGEST:
                out.append(s)
            else:  # running text without stops: overlapping pieces, so that nothing dilutes a passage
                out += [" ".join(ws[i: i + PIECE]) for i in range(0, len(ws) - PIECE // 2, PIECE // 2)]
    return out


class Dictionary:
    """A compressor with a dictionary trained on the given windows, a recurring window weighing by its number.

    most: bytes of the dictionary; share: of the windows' bytes that it may have at most. Where there are too few
    windows to train on, the dictionary is their text itself.
    """

    def __init__(self, texts: list[str], most: int, share: float = 1.0):
        samples = [f"\n{w}\n".encode() for w in texts]
        size = max(256, min(most, int(sum(map(len, samples)) * share)))
        try:
            data = zstandard.train_dictionary(size, samples, level=LEVEL, d=6, k=50, split_point=1.0)
        except zstandard.ZstdError:
            data = zstandard.ZstdCompressionDict(b"".join(samples)[-size:] or b"\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=size, window_log=20, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=3
        )
        self._zip = zstandard.ZstdCompressor(dict_data=data, compression_params=params)
        self._seen: dict[str, int] = {}

    def size(self, window: str) -> int:
        n = self._seen.get(window)
        if n is None:
            if len(self._seen) > 200_000:
                self._seen.clear()
            n = self._seen[window] = len(self._zip.compress(f"\n{window}\n".encode()))
        return n

    def rate(self, window: str) -> float:
        return self.size(window) / (len(window) + 6)


def gain(ordinary: Dictionary, toxic: Dictionary, window: str) -> float:
    """How much shorter the window compresses with the toxic dictionary, over -1 and under 1."""
    a, t = ordinary.size(window), toxic.size(window)
    return (a - t) / max(a + 8, t)


@dataclass
class Model:
    """The windows that both dictionaries are trained on, and the size of the ordinary one."""

    ordinary: list[str]
    toxic: list[str]
    size: int = ORDINARY_BYTES[1]


class Scorer:
    def __init__(self, model: Model):
        self.o, self.t = Dictionary(model.ordinary, model.size, 0.5), Dictionary(model.toxic, TOXIC_BYTES)

    def document(self, found: list[str]) -> float:
        """The score of the most toxic window; -1 for a text without any."""
        return max((gain(self.o, self.t, w) for w in found), default=-1.0)


Labelled = list[tuple[bool, list[str]]]


@dataclass
class Corpus:
    """How many documents there are, and in how many of them each window of a labelled one stands."""

    documents: int
    counts: dict[str, int]


def chance(window: str, harmful: Counter, h: int, corpus: Corpus | None) -> bool:
    """Does a window stand in harmful documents by chance only?

    Of the other documents that have it, as many are labelled harmful as chance has it, rather than LIFT times
    as many: the likelihood ratio of the two Poisson counts says so with a factor of e.
    """
    if corpus is None or not corpus.documents:
        return False
    expected = max(0, corpus.counts.get(window, 0) - 1) * h / corpus.documents
    return (harmful[window] - 1) * math.log(LIFT) - expected * (LIFT - 1) < -1.0


def train(docs: Labelled, corpus: Corpus | None = None, size: int = ORDINARY_BYTES[1]) -> Model:
    """Sorts the windows of labelled documents into ordinary and toxic ones.

    Candidates are the strange windows of harmful documents that aren't there by chance. In every round, toxic
    dictionaries are trained on the chosen windows of all folds but one, and of that fold's candidates those stay
    chosen which they explain better than ordinary text does.
    """
    others = [Dictionary([w for i, (y, ws) in enumerate(docs) if not y and i % FOLDS != g for w in ws], size, 0.5) for g in range(FOLDS)]
    rates = sorted(others[i % FOLDS].rate(w) for i, (y, ws) in enumerate(docs) if not y for w in ws)
    usual = rates[int(len(rates) * STRANGE)] if rates else 0.0
    harmful = Counter(w for y, ws in docs if y for w in ws)
    h = sum(y for y, _ in docs)
    cand = [(i % FOLDS, [w for w in ws if others[i % FOLDS].rate(w) > usual and not chance(w, harmful, h, corpus)]) for i, (y, ws) in enumerate(docs) if y]
    chosen = cand
    for _ in range(ROUNDS):
        seen = [Dictionary([w for f, ws in chosen if f != g for w in ws], TOXIC_BYTES) for g in range(FOLDS)]
        chosen = [(g, [w for w in ws if gain(others[g], seen[g], w) > GAIN]) for g, ws in cand]
    toxic = [w for _, ws in chosen for w in ws]
    taken = set(toxic)
    return Model([w for y, ws in docs if not y for w in ws] + [w for y, ws in docs if y for w in ws if w not in taken], toxic, size)


Held = list[tuple[float, bool]]


def held_out(docs: Labelled, corpus: Corpus | None, size: int, fold: int) -> Held:
    """Scores and verdicts of one fold's documents by a model of all others."""
    s = Scorer(train([x for i, x in enumerate(docs) if i % FOLDS != fold], corpus, size))
    return [(s.document(ws), y) for y, ws in docs[fold::FOLDS]]


def best_f1(held: Held) -> float:
    positive, right, best = sum(y for _, y in held), 0, 0.0
    for n, (_, y) in enumerate(sorted(held, key=lambda x: -x[0]), 1):
        right += y
        best = max(best, 2 * right / (n + positive))
    return best


def threshold(held: Held, scores: dict[float, int]) -> float:
    """The score of the best expected F1 over the whole corpus, whose scores are counted in scores.

    Reviewed documents aren't drawn evenly, so the share of harmful documents in the corpus is estimated: at the score
    that parts the held-out classes best, what the corpus reports beyond the fine documents' rate, relative to what
    harmful documents report beyond it; between a hundredth of the reviewed documents' share and that share. With it,
    the held-out recall and the number of documents reported from the corpus itself, F1 follows for each score.
    """
    h, f, total = sorted(v for v, y in held if y), sorted(v for v, y in held if not y), sum(scores.values())
    if not h or not f or not total:
        return 2.0
    grid = [k / 100 for k in range(1, 100)]
    recall = {t: 1 - bisect_left(h, t) / len(h) for t in grid}
    wrong = {t: 1 - bisect_left(f, t) / len(f) for t in grid}
    reported = {t: sum(n for v, n in scores.items() if v >= t) / total for t in grid}
    parts = max(grid, key=lambda t: (recall[t] - wrong[t], t))
    most = len(h) / len(held)
    gap = recall[parts] - wrong[parts]
    share = min(most, max(most / 100, (reported[parts] - wrong[parts]) / gap)) if gap > 0 else most
    best = max(grid, key=lambda t: (recall[t] / (reported[t] + share), t))
    return best if recall[best] else 2.0


def windowed(documents: DataFrame) -> DataFrame:
    """(doc_id, source, ws): the distinct windows of every document, made once and written down."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "source": b.source, "ws": [list(dict.fromkeys(windows(t or ""))) for t in b.text]})

    rows = documents.select("doc_id", "source", "text").filter("doc_id is not null")
    return saved(spread(rows).mapInPandas(run, "doc_id bigint, source string, ws array<string>"))


def labelled(found: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, most_windows: int = MAX_WINDOWS) -> Labelled:
    """Windows of reviewed documents with the majority of their verdicts; ties and documents only unsure of are left out."""
    votes = (
        labels.filter("doc_id is not null").distinct().groupBy("doc_id")
        .agg(F.count_if(F.col("verdict") == "harmful").alias("h"), F.count_if(F.col("verdict") == "fine").alias("f")).filter("h <> f")
    )
    sample = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", (F.col("h") > F.col("f")).alias("y"))
    docs = cut(found.select("doc_id", "ws").join(F.broadcast(sample), "doc_id").filter(F.size("ws") <= most_windows // 20).dropDuplicates(["doc_id"]))
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over at most MAX_LABELLED narrow rows
    kept = docs.select("doc_id", F.size("ws").alias("n")).withColumn("upto", upto).filter(F.col("upto") <= most_windows).select("doc_id")
    rows = docs.join(F.broadcast(kept), "doc_id").collect()
    rows.sort(key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).digest())
    return [(bool(r["y"]), list(r["ws"])) for r in rows]


def corpus_counts(found: DataFrame, docs: Labelled) -> Corpus:
    """Document counts, over the whole corpus, of the windows that labelled documents have.

    The windows asked for are those of harmful documents, at most MAX_WINDOWS; their hashes go out as one broadcast
    variable, and each partition sends one row for a window and document at most.
    """
    spark = found.sparkSession
    asked = list(dict.fromkeys(w for y, ws in docs if y for w in ws))
    n = found.select("doc_id").distinct().count()
    if not asked:
        return Corpus(n, {})
    few = F.broadcast(spark.createDataFrame([(w,) for w in asked], "w string"))
    rows = found.select("doc_id", F.explode("ws").alias("w")).join(few, "w").groupBy("w").agg(F.count_distinct("doc_id").alias("n")).collect()
    return Corpus(n, {r["w"]: r["n"] for r in rows})


def fit(found: DataFrame, docs: Labelled) -> tuple[Model, Held]:
    """A model of all labelled documents and the held-out scores of its kind.

    Each size and fold is a task of its own; the sizes' best F1 on unseen documents decides, ties go to the smaller.
    """
    spark = found.sparkSession
    corpus = corpus_counts(found, docs)
    shared = spark.sparkContext.broadcast((docs, corpus))
    grid = [(s, k) for s in ORDINARY_BYTES for k in range(FOLDS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b.id:
                size, fold = grid[i]
                got = held_out(*shared.value, size, fold)
                yield pd.DataFrame([(size, v, y) for v, y in got], columns=["size", "v", "y"])

    rows = spark.range(0, len(grid), 1, len(grid)).mapInPandas(run, "size int, v double, y boolean").collect() if docs else []
    by: dict[int, Held] = {s: [] for s in ORDINARY_BYTES}
    for r in rows:
        by[r["size"]].append((r["v"], r["y"]))
    size = max(by, key=lambda s: (best_f1(by[s]), -s))
    return train(docs, corpus, size), by[size]


_scorers: dict[str, Scorer] = {}


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, harmful) for every document; repeated rows count once.

    A null or blank text scores -1. Without a harmful and a fine verdict nothing is harmful. The model, windows of a
    bounded labelled sample, goes out as one broadcast variable; each Python worker builds its compressors once.
    """
    found = windowed(documents)
    docs = labelled(found, labels)
    model, held = fit(found, docs)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    key = hashlib.md5(repr((model.size, len(model.ordinary), model.toxic)).encode()).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(shared.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "source": b.source, "score": [round(_scorers[key].document(list(ws)), 6) for ws in b.ws]})

    scores = cut(spread(found).mapInPandas(run, "doc_id bigint, source string, score double").distinct())
    counts = scores.groupBy(F.floor(F.col("score") * 100).alias("k")).count().collect()
    t = threshold(held, {r["k"] / 100: r["count"] for r in counts})
    return scores.withColumn("harmful", F.col("score") >= t)


def rates(scored: DataFrame) -> DataFrame:
    """(source, documents, harmful, rate) per source; null sources are one group."""
    return scored.groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if("harmful").alias("harmful"), F.round(F.count_if("harmful") / F.count("*"), 6).alias("rate")
    )
