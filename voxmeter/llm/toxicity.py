"""Toxicity: a linear-chain conditional random field tags toxic spans; marginals give document scores and offsets."""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmeter.llm.common import materialize, shingles_of, slices, words_of

WORD = re.compile(r"[^\W_]+")
#: Tokens of a chain that are worked on at once; and tokens of whole texts that the fit takes at once.
BLOCK, FIT_TOKENS = 64, 100_000
#: Weights smaller than this are dropped from a fitted model.
LEAST_WEIGHT = 0.2
#: Words whose weights a task keeps; beyond them it starts anew.
KEPT_WORDS = 150_000
#: The classifier is fitted on so many labelled documents of each class at most: those of the smallest hashes of doc_id.
TOXIC_SAMPLE, CLEAN_SAMPLE = 500, 1500
#: Bytes of the texts of a class that the fit takes at most; texts of more than an eighth of that take no part.
SAMPLE_BYTES = 8 << 20
#: The fit ends when no weight moves by more than this in a round.
LEAST_STEP = 0.01
#: Evidence (likelihood ratio) and lift from which a feature of toxic documents tags its tokens.
EVIDENCE, LIFT = 25.0, 12.0
#: Marginals below this add nothing to a document's score; spans are reported from the second on.
FLOOR, SPAN = 0.05, 0.5
#: Score from which a document is rejected.
REJECT = 0.3
#: Of a labelled text's smallest shingle hashes so many of so many make it a copy, which says nothing new.
COPY_SAME, COPY_OF = 3, 8
#: A beginning or end counts as a feature of its own if it has so many times the evidence of any single word with it.
STEM_GAIN = 1.5
#: Share of toxic texts from which a feature counts without being the one that explains them best.
COMMON = 0.02


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    stay: np.ndarray  # log potentials of tag pairs, 2 x 2


def features(word: str) -> list[str]:
    """The word, its beginnings of 3 to 6 letters, and its end of 3: case does not count."""
    w = word.lower()
    out = ["w" + w, *("p" + w[:n] for n in (3, 4, 5, 6) if len(w) > n)]
    if len(w) > 3:
        out.append("s" + w[-3:])
    return out


def _ahead(odds: np.ndarray, counts: np.ndarray, t: np.ndarray, block: int) -> np.ndarray:
    """Forward messages of chains that lie one after another, as ratios of tag 1 to tag 0, with each token's own odds.

    Chains are whole texts. A step maps the message x to odds * (t01 + x t11) / (t00 + x t10); the maps of the tokens of a
    block multiply as 2 x 2 matrices, for all blocks at once. So the message that enters each block comes from one short
    pass over blocks, and all blocks then go on from it at once: the same messages as token by token.
    """
    n = -(-counts // block)
    doc = np.repeat(np.arange(len(counts)), n)
    head = np.cumsum(n) - n
    rank = np.arange(len(doc)) - head[doc]
    size = np.minimum(block, counts[doc] - rank * block)
    steps = np.arange(size.max())[:, None]
    place = np.minimum((np.cumsum(counts) - counts)[doc] + rank * block + steps, len(odds) - 1)
    o, first, enter = odds[place], rank == 0, np.ones(len(doc))
    passed = np.flatnonzero(rank < n[doc] - 1)  # blocks that another one follows: all of them are full
    if len(passed):
        a, b, c, d = np.ones(len(passed)), np.zeros(len(passed)), np.zeros(len(passed)), np.ones(len(passed))
        held, begins = o[:, passed], first[passed]
        for k in range(block):
            a, b, c, d = t[0, 0] * a + t[1, 0] * c, t[0, 0] * b + t[1, 0] * d, held[k] * (t[0, 1] * a + t[1, 1] * c), held[k] * (t[0, 1] * b + t[1, 1] * d)
            if k == 0:
                a, b, c, d = np.where(begins, 1.0, a), np.where(begins, 0.0, b), np.where(begins, held[0], c), np.where(begins, 0.0, d)
            if k % 8 == 7:
                total = a + b + c + d
                a, b, c, d = a / total, b / total, c / total, d / total
        at = np.zeros(len(doc), np.int64)
        at[passed] = np.arange(len(passed))
        by_size = head[np.argsort(-n, kind="stable")]
        more = np.sort(n)[::-1]
        for r in range(1, int(n.max())):
            now = by_size[: np.searchsorted(-more, -r, "left")] + r
            x, i = enter[now - 1], at[now - 1]
            enter[now] = (c[i] + d[i] * x) / (a[i] + b[i] * x)
    out = np.empty_like(o)
    x = out[0] = np.where(first, o[0], o[0] * (t[0, 1] + enter * t[1, 1]) / (t[0, 0] + enter * t[1, 0]))
    for k in range(1, len(o)):
        x = out[k] = o[k] * (t[0, 1] + x * t[1, 1]) / (t[0, 0] + x * t[1, 0])
    flat = np.empty(len(odds))
    inside = steps < size
    flat[place[inside]] = out[inside]
    return flat


def marginals(emit: np.ndarray, counts: np.ndarray, stay: np.ndarray, block: int = BLOCK, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """P(tag 1) of each token of the chains, by forward-backward over each whole chain; with pairs, expected counts of tag pairs.

    emit: log odds of all chains' tokens, one chain after another; counts: tokens of each. `block` says how many tokens are
    worked on at once, and changes nothing but rounding.
    """
    if not len(emit):
        return np.zeros(0), np.zeros((2, 2)) if pairs else None
    odds, t = np.exp(np.clip(emit, -30, 30)), np.exp(stay)
    counts = counts[counts > 0]
    ahead = _ahead(odds, counts, t, block)
    # The way back is the way ahead along the reversed chain, with its transitions turned around.
    back = _ahead(odds[::-1], counts[::-1], t.T, block)[::-1]
    both = ahead * back / odds
    if not pairs:
        return both / (1 + both), None
    later = np.ones(len(emit), bool)
    later[np.cumsum(counts) - counts] = False
    later = np.flatnonzero(later)
    x, y = ahead[later - 1], back[later]
    joint = np.stack([np.full(len(later), t[0, 0]), t[0, 1] * y, x * t[1, 0], x * t[1, 1] * y])
    return both / (1 + both), (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)


def fit(texts: list[str], toxic: list[int], rounds: int = 40) -> Model | None:
    """A model of labelled texts, or None without texts of both classes.

    Tokens get tags from the labels: in toxic texts, those with a feature that tells toxic texts from clean ones
    (EVIDENCE, LIFT); all others are clean. Copies of a text among the labelled ones count once. The chain's weights maximize the tags' likelihood, by its exact gradient.
    """
    keep = _originals(texts)
    texts, y = [texts[i] for i in keep], np.array(toxic)[keep]
    if not 0 < y.sum() < len(y):
        return None
    number: dict[str, int] = {}
    flat, counts = [], []
    for text in texts:
        ws = [number.setdefault(w.lower(), len(number)) for w in WORD.findall(text or "")]
        flat.append(np.array(ws, np.int32))
        counts.append(len(ws))
    counts, tokens = np.array(counts), np.concatenate(flat)
    if not len(tokens):
        return None
    names: dict[str, int] = {}
    width, ids = np.zeros(len(number), np.int64), array("i")
    for i, w in enumerate(number):
        held = features(w)
        width[i] = len(held)
        ids.extend(names.setdefault(f, len(names)) for f in held)
    feature, n_words, total = np.frombuffer(ids, np.int32), len(number), len(names)
    of = np.repeat(np.arange(n_words, dtype=np.int32), width)
    del number
    at = np.cumsum(width) - width
    # The distinct features of each text.
    own = []
    for ws in flat:
        ws = np.unique(ws)
        n = width[ws]
        own.append(np.unique(feature[np.repeat(at[ws], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]))
    strong, stems = _telling(own, y, total, of, feature, at)
    strong_word = np.bincount(of, strong[feature], n_words) > 0
    shared = stems & strong
    shared[feature[at]] = True
    document = np.repeat(np.arange(len(counts)), counts)
    tags = strong_word[tokens] & (y[document] == 1)
    met = document[1:] == document[:-1]
    seen = np.bincount(2 * tags[:-1][met] + tags[1:][met], minlength=4).reshape(2, 2).astype(float)
    del document, met
    # Whole texts, some thousand tokens at once.
    ends = np.cumsum(counts)
    cuts = [0, *(np.flatnonzero(np.diff(ends // FIT_TOKENS)) + 1).tolist(), len(counts)]
    parts = [(lo, hi, slice(int(ends[lo] - counts[lo]), int(ends[hi - 1]))) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if lo < hi]
    weights, bias, stay = np.zeros(total), -2.0, np.zeros((2, 2))
    grown, grown_bias, grown_stay = np.full(total, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(rounds):
        word_score = np.bincount(of, weights[feature], n_words) + bias
        gap, pairs = np.zeros(n_words), np.zeros((2, 2))
        for lo, hi, part in parts:
            p, two = marginals(word_score[tokens[part]], counts[lo:hi], stay, pairs=True)
            pairs += two
            gap += np.bincount(tokens[part], tags[part] - p, n_words)
        g = np.bincount(feature, gap[of], total) - 0.02 * weights
        g[~shared] = 0
        g_bias, g_stay = gap.sum(), seen - pairs - 0.02 * stay
        grown, grown_bias, grown_stay = grown + g * g, grown_bias + g_bias**2, grown_stay + g_stay**2
        step, step_bias, step_stay = 0.5 * g / np.sqrt(grown), 0.5 * g_bias / grown_bias**0.5, 0.5 * g_stay / np.sqrt(grown_stay)
        weights, bias, stay = weights + step, bias + step_bias, stay + step_stay
        if max(np.abs(step).max(), abs(step_bias), np.abs(step_stay).max()) < LEAST_STEP:
            break
    return Model({f: float(weights[i]) for f, i in names.items() if abs(weights[i]) >= LEAST_WEIGHT}, float(bias), stay)


def _originals(texts: list[str]) -> list[int]:
    """Texts that are no copies of earlier ones."""
    keep, seen = [], {}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        words, _, _, first = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        least = np.sort(shingles_of(words, first, 5)[0])[:COPY_OF].tolist()
        met: dict[int, int] = {}
        for x in least:
            if x in seen:
                met[seen[x]] = met.get(seen[x], 0) + 1
        if not met or max(met.values()) < min(COPY_SAME, len(least)):
            keep.append(i)
            for x in least:
                seen.setdefault(x, i)
    return keep


def _telling(own: list[np.ndarray], y: np.ndarray, features: int, of: np.ndarray, feature: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which features tell toxic texts: greedily the one with the most evidence in texts not yet explained, and common ones.

    Also which features are stems: those that tell more than any single word that has them.
    """
    total = np.array([(y == 0).sum(), (y == 1).sum()])
    share = total[1] / total.sum()
    clean = np.bincount(np.concatenate([x for x, t in zip(own, y, strict=True) if not t]), minlength=features).astype(float)
    left = [x for x, t in zip(own, y, strict=True) if t]
    held = np.bincount(np.concatenate(left), minlength=features).astype(float)

    def evidence(a: np.ndarray) -> np.ndarray:
        p = np.clip(a / np.maximum(a + clean, 1), 1e-9, 1 - 1e-9)
        lifted = (a + 0.5) / total[1] >= LIFT * (clean + 0.5) / total[0]
        return np.where(lifted, 2 * (a * np.log(p / share) + clean * np.log((1 - p) / (1 - share))), 0.0)

    whole = evidence(held)
    word = np.zeros(features, bool)
    word[feature[at]] = True
    best_word = np.zeros(features)
    np.maximum.at(best_word, feature, whole[feature[at]][of])
    stems = ~word & (whole > STEM_GAIN * best_word)
    fits = word | stems
    strong = fits & (whole >= EVIDENCE) & (held >= max(COMMON * total[1], 8))
    while left:
        now = np.where(fits, evidence(np.bincount(np.concatenate(left), minlength=features).astype(float)), 0.0)
        best = int(now.argmax())
        if now[best] < EVIDENCE:
            break
        strong[best] = True
        left = [x for x in left if best not in x]
    return strong, stems


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_sample: int = TOXIC_SAMPLE, clean_sample: int = CLEAN_SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Fit on a bounded sample of labelled documents. labels: doc_id, toxic (null counts as unlabelled).

    Of each class at most toxic_sample and clean_sample documents take part, those of the smallest hashes of doc_id, and of
    these, in that order, as many as hold sample_bytes; texts of more than an eighth of it are left out. Of rows with one
    doc_id the smallest text counts, and the larger label, so the sample is the same whatever the layout.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("id"))
    pick = known.where("toxic = 1").orderBy("h", "id").limit(toxic_sample).unionByName(known.where("toxic = 0").orderBy("h", "id").limit(clean_sample))
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(pick), "id")
    held = materialize(held.groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"), F.max("h").alias("h")).withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0))), "labelled")
    # A row for each document of the sample.
    order = Window.partitionBy("toxic").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = held.where(F.col("bytes") <= sample_bytes // 8).select("id", F.sum("bytes").over(order).alias("sum")).where(F.col("sum") <= sample_bytes)
    rows = held.join(fits.select("id"), "id", "left_semi").select("id", "text", "toxic").toPandas().sort_values("id")
    return fit(rows["text"].tolist(), rows["toxic"].tolist())


def _score(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    number: dict[str, int] = {}
    emit = np.zeros(0, np.float32)
    weight = model.weights.get if model is not None else None
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    for whole in batches:
        for batch in slices(whole, "text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            score, spans = np.zeros(len(texts)), [[] for _ in texts]
            if model is not None:
                if len(number) > KEPT_WORDS:
                    number, emit = {}, emit[:0]
                lists = [WORD.findall(t) for t in texts]
                new = list({w for ws in lists for w in ws if w not in number})
                number.update({w: len(number) + i for i, w in enumerate(new)})
                emit = np.append(emit, np.array([sum(weight(f, 0.0) for f in features(w)) + model.bias for w in new], np.float32))
                counts = np.array([len(ws) for ws in lists], np.int64)
                flat = np.fromiter((number[w] for ws in lists for w in ws), np.int64, counts.sum())
                p, _ = marginals(emit[flat].astype(np.float64), counts, model.stay)
                at = np.flatnonzero(p >= FLOOR)
                doc = np.repeat(np.arange(len(texts)), counts)[at]
                miss = np.ones(len(texts))
                np.multiply.at(miss, doc, 1 - np.minimum(p[at], 1 - 1e-9))
                score = 1 - miss
                begin = np.cumsum(counts) - counts
                for d in np.unique(doc[p[at] >= SPAN]).tolist():
                    own = p[begin[d] : begin[d] + counts[d]].tolist()
                    spans[d] = [{"start": m.start(), "end": m.end(), "score": q} for q, m in zip(own, WORD.finditer(texts[d]), strict=True) if q >= SPAN]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(spans, kind)], names=["doc_id", "score", "spans"])


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: likelier toxic), spans (array of start, end in characters, score) of each row's whole text.

    The score is 1 minus the product of 1 - P(toxic) over tokens of P >= FLOOR; spans are the tokens of P >= SPAN. Null and
    empty texts, and texts without a word, score 0 and have no span; without a model every row does. Rows stay in their
    partitions; null and repeated ids stay as they are; other columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(functools.partial(_score, model=model), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double, spans array<struct<start:int,end:int,score:double>>")
