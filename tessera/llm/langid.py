"""Language identification as multilingual mixture inference.

Every language has a smoothed distribution over byte 3-grams. A document is a mixture: its language proportions
are estimated by expectation-maximisation from the likelihoods of its n-grams, and the set of languages grows
one at a time for as long as the likelihood gains more than a penalty for the added proportion.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh, need, pieces
from ._words import LOWER, buffers

#: Documents a language is learned from, about; chosen by a hash of id and text. A bound, not a cap on what is
#: judged: the model has LANGUAGES x BUCKETS numbers however much text there is.
SAMPLE = 1500
#: Languages a model may have; labels beyond it are an error, since the model goes to every task.
MOST_LANGUAGES = 400
#: Hash buckets of the byte 3-grams, and the added count of each.
BUCKETS, SMOOTH = 1 << 15, 0.5
#: Rounds of EM before the first look, between looks and at most, the share that a language begins with, and the penalty for each further language in units of log(n-grams).
FIRST, ROUNDS, MOST_ROUNDS, BEGIN, PENALTY = 3, 12, 240, 0.05, 4.0
#: Nats that proportions may be short of their best likelihood, as a share of the penalty.
SETTLED = 0.05
#: Bytes judged at once. A longer text is taken alone.
BLOCK = 1 << 21

_FOLD = LOWER.copy()
# Digits and ASCII marks say nothing of the language: they count as a blank.
_FOLD[[c for c in range(128) if not (97 <= c <= 122 or 65 <= c <= 90)]] = 32


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(data: np.ndarray, bounds: np.ndarray):
    """(document, bucket) sorted, with counts, of all 3-grams inside each text; runs of blanks are one."""
    if len(bounds) == 2 and len(data) > 2 * BLOCK:
        return _grams_of_long(data)
    x = _FOLD[data]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | (doc[1:] != doc[:-1])
    x, doc = x[keep].astype(np.uint32), doc[keep]
    if len(x) < 3:
        none = np.zeros(0, np.int64)
        return none, none, none
    g = (x[:-2] * np.uint32(65536) + x[1:-1] * np.uint32(256) + x[2:]) * np.uint32(2654435761) >> np.uint32(17)
    same = doc[2:] == doc[:-2]
    key = np.sort(doc[:-2][same] * BUCKETS + g[same])
    if not len(key):
        none = np.zeros(0, np.int64)
        return none, none, none
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.concatenate([first, [len(key)]]))
    return key[first] // BUCKETS, key[first] % BUCKETS, count


def _grams_of_long(data: np.ndarray):
    """The same for one long text, counted piece by piece; each piece begins with the last two bytes before it."""
    total, tail = np.zeros(BUCKETS, np.int64), np.zeros(0, np.uint8)
    for lo in range(0, len(data), BLOCK):
        x = np.concatenate([tail, _FOLD[data[lo : lo + BLOCK]]])
        keep = np.ones(len(x), dtype=bool)
        keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
        x = x[keep]
        w = x.astype(np.uint32)
        g = (w[:-2] * np.uint32(65536) + w[1:-1] * np.uint32(256) + w[2:]) * np.uint32(2654435761) >> np.uint32(17)
        total += np.bincount(g, minlength=BUCKETS)
        tail = x[-2:]
    at = np.flatnonzero(total)
    return np.zeros(len(at), np.int64), at, total[at]


def _blocks(bounds: np.ndarray):
    """Ranges of documents of about BLOCK bytes."""
    lo = 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + BLOCK, "right")) - 1)
        yield lo, hi
        lo = hi


def _count_batches(batches):
    for batch in pieces(batches):
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        data, bounds = buffers(batch.column("text"))
        total: dict[str, np.ndarray] = {}
        for lo, hi in _blocks(bounds):
            doc, gram, count = _grams(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
            for lang in set(langs[lo:hi]):
                own = (langs[lo:hi] == lang)[doc]
                into = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                into += np.bincount(gram[own], weights=count[own], minlength=BUCKETS).astype(np.int64)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "gram", "n"])


def train(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities of shape buckets x languages) from rows of doc_id, lang, text.

    Rows with a null lang or text are no evidence. About `sample` documents a language are read, chosen by a
    hash of id and text; without any, there are no languages. More than MOST_LANGUAGES labels raise an error.
    """
    rows = need(labelled, doc_id="long", lang="string", text="string").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(have) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} language labels: clean the lang column first")
    share = F.lit(0)
    for lang, n in sorted(have.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 20, -(-(sample << 20) // n)))).otherwise(share)
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 20)) < share)
    counts = chosen.select("lang", "text").mapInArrow(_count_batches, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    table = np.full((BUCKETS, max(1, len(langs))), SMOOTH)
    column = {x: i for i, x in enumerate(langs)}
    table[counts.column("gram").to_numpy(), [column[x] for x in counts.column("lang").to_pylist()]] += counts.column("n").to_numpy()
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def _em(p: np.ndarray, count: np.ndarray, at: np.ndarray, which: np.ndarray, rounds: int, start: np.ndarray | None = None):
    """Proportions (documents x set size) and log-likelihood of each document for its set of languages.

    p: n-gram likelihoods (rows x set size), scaled; count: of each row; at: first row of each document;
    which: document of each row; start: proportions to begin with, else even ones.
    """
    k = p.shape[1]
    n = np.add.reduceat(count, at)
    pi = np.full((len(at), k), 1.0 / k, dtype=np.float32) if start is None else start
    for _ in range(rounds):
        joint = p * pi[which]
        joint *= (count / joint.sum(axis=1))[:, None]
        pi = np.add.reduceat(joint, at, axis=0) / n[:, None]
    mass = np.maximum((p * pi[which]).sum(axis=1), 1e-30)
    return pi, np.add.reduceat(count * np.log(mass), at, dtype=np.float64)


def _rows_of(at: np.ndarray, size: np.ndarray, docs: np.ndarray):
    """(rows, first row of each, document of each row) of the documents chosen, put together."""
    n = size[docs]
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    which = np.repeat(np.arange(len(docs)), n)
    return np.arange(n.sum()) - first[which] + at[docs][which], first, which


def _settle(p: np.ndarray, count: np.ndarray, at: np.ndarray, size: np.ndarray, docs: np.ndarray, sets: np.ndarray, wanted: np.ndarray, n: np.ndarray, start: np.ndarray):
    """(proportions, log-likelihood) of each chosen document for its set (columns of p), settled unless hopeless;
    start: proportions to begin with.

    The likelihood is concave: from any proportions it can still gain no more than the largest, over the set, of
    sum(count * p / mass) - n. Rounds go on until that is small, or too small for the likelihood to reach wanted.
    """
    pi, like = np.zeros(sets.shape, np.float32), np.zeros(len(docs))
    open_ = np.arange(len(docs))
    for rounds in [FIRST, *[ROUNDS] * (MOST_ROUNDS // ROUNDS)]:
        rows, first, which = _rows_of(at, size, docs[open_])
        q, c = p[rows[:, None], sets[open_][which]], count[rows]
        got, score = _em(q, c, first, which, rounds, start)
        pi[open_], like[open_] = got, score
        mass = np.maximum((q * got[which]).sum(axis=1), 1e-30)
        more = np.add.reduceat(q * (c / mass)[:, None], first, axis=0, dtype=np.float64).max(axis=1) - n[open_]
        on = (more > SETTLED * PENALTY * np.log(n[open_] + 1)) & (score + more > wanted[open_])
        if not on.any():
            break
        open_, start = open_[on], got[on]
    return pi, like


def infer(doc: np.ndarray, gram: np.ndarray, count: np.ndarray, logp: np.ndarray, n_docs: int):
    """For each document: proportions over all languages (zero outside its set), and its likelihood's gain in
    nats an n-gram over an even guess among all buckets. Documents without n-grams get zeros."""
    n_lang = logp.shape[1]
    out, gain = np.zeros((n_docs, n_lang), np.float32), np.zeros(n_docs, np.float32)
    if not len(doc):
        return out, gain
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    which = np.repeat(np.arange(len(at)), np.diff(np.concatenate([at, [len(doc)]])))
    ids, c = doc[at], count.astype(np.float32)
    rows = logp[gram]
    # Scaling each n-gram by its best language changes no proportion and keeps single precision safe.
    best = rows.max(axis=1)
    p = np.exp(rows - best[:, None])
    size = np.bincount(which)
    base = np.add.reduceat(c * best, at, dtype=np.float64)
    n = np.add.reduceat(c, at, dtype=np.float64)
    alone = np.add.reduceat(c[:, None] * (rows - best[:, None]), at, axis=0, dtype=np.float64)
    sets, score = alone.argmax(axis=1)[:, None], alone.max(axis=1)
    pi = np.zeros((len(at), n_lang), np.float32)
    pi[np.arange(len(at)), sets[:, 0]] = 1
    live = np.arange(len(at))
    while len(live) and sets.shape[1] < n_lang:
        # Every language that a set lacks is tried; the one of the largest likelihood stays if it beats the penalty.
        # The likelihood is concave, so its slope at a set's own proportions says how much a language can gain at
        # most; one that can't gain the penalty needs no trial.
        wanted = score[live] + PENALTY * np.log(n[live] + 1)
        rows_, first_, which_ = _rows_of(at, size, live)
        mass = np.maximum((p[rows_] * pi[live][which_]).sum(axis=1), 1e-30)
        most = np.add.reduceat(p[rows_] * (c[rows_] / mass)[:, None], first_, axis=0, dtype=np.float64) - n[live][:, None]
        own = np.take_along_axis(most, sets, axis=1).max(axis=1)
        may = np.maximum(most, own[:, None]) > PENALTY * np.log(n[live] + 1)[:, None]
        top, parts, trial = np.full(len(live), -np.inf), np.zeros((len(live), sets.shape[1] + 1), np.float32), np.zeros((len(live), sets.shape[1] + 1), np.int64)
        for lang in range(n_lang):
            lacks = np.flatnonzero((sets != lang).all(axis=1) & may[:, lang])
            if not len(lacks):
                continue
            tried = np.concatenate([sets[lacks], np.full((len(lacks), 1), lang)], axis=1)
            begin = np.take_along_axis(pi[live[lacks]], tried, axis=1) * (1 - BEGIN)
            begin[:, -1] = BEGIN
            prop, like = _settle(p, c, at, size, live[lacks], tried, np.maximum(wanted, top)[lacks], n[live[lacks]], begin)
            up = like > top[lacks]
            top[lacks[up]], parts[lacks[up]], trial[lacks[up]] = like[up], prop[up], tried[up]
        better = top > wanted
        live, sets = live[better], trial[better]
        score[live] = top[better]
        pi[live[:, None], sets] = parts[better]
    out[ids], gain[ids] = pi, (base + score) / n + np.log(BUCKETS)
    return out, gain


PREDICTED = "doc_id long, has_letter boolean, lang_pred string, score double, languages array<string>, shares array<double>, gain double"


def _predict(batches, langs: list[str], logp: np.ndarray):
    for batch in pieces(batches):
        data, bounds = buffers(batch.column("text"))
        letters = batch.column("has_letter").to_pylist()
        preds, scores, sets, shares, gains = [], [], [], [], []
        for lo, hi in _blocks(bounds):
            doc, gram, count = _grams(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
            pi, gain = infer(doc, gram, count, logp, hi - lo)
            for i in range(hi - lo):
                if not letters[lo + i] or not langs:
                    preds.append("und"), scores.append(0.0), sets.append([]), shares.append([]), gains.append(0.0)
                    continue
                if not pi[i].any():  # too short for a single n-gram: the first language, without trust
                    preds.append(langs[0]), scores.append(0.0), sets.append([]), shares.append([]), gains.append(0.0)
                    continue
                top = np.argsort(-pi[i], kind="stable")
                top = [j for j in top if pi[i, j] > 0]
                preds.append(langs[top[0]]), scores.append(float(min(1.0, pi[i, top[0]])))
                sets.append([langs[j] for j in top]), shares.append([float(pi[i, j]) for j in top]), gains.append(float(gain[i]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("has_letter"), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())), pa.array(gains, pa.float64())],
            ["doc_id", "has_letter", "lang_pred", "score", "languages", "shares", "gain"],
        )


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score, languages, shares, gain of every whole text.

    languages and shares: the selected set, largest first; lang_pred its first, score its share. `und` with
    score 0 where the text is null or has no letter, or the model knows no language; a text with a letter but
    no 3-gram gets the first language with score 0. Only the text decides. Repeated rows give repeated rows;
    other columns are ignored; an empty table gives no rows.
    """
    rows = need(docs, doc_id="long", text="string").select("doc_id", "text", F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)).alias("has_letter"))
    return rows.mapInArrow(functools.partial(_predict, langs=model[0], logp=model[1]), PREDICTED).drop("has_letter")


def language_report(docs: DataFrame) -> DataFrame:
    """The columns of op2: learned from documents that are not held out, predicted for all."""
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    out = identify(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.array_join("languages", ",").alias("languages"))


def _keep(batches, langs, logp, least: float, letter: str):
    for batch in pieces(batches):
        data, bounds = buffers(batch.column("text"))
        has = np.array(batch.column(letter).to_pylist(), dtype=bool)
        good = np.zeros(len(has), bool)
        for lo, hi in _blocks(bounds):
            doc, gram, count = _grams(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
            pi, gain = infer(doc, gram, count, logp, hi - lo)
            good[lo:hi] = has[lo:hi] & (~pi.any(axis=1) | (gain >= least))
        yield batch.filter(pa.array(good)).drop_columns([letter])


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], least_gain: float = 0.0) -> DataFrame:
    """The rows of docs in some language of the model, with all their columns, in place: no shuffle, no join.

    Rejected: null texts, texts without a letter, and texts whose n-grams the best mixture explains worse than
    an even guess (by least_gain nats an n-gram). Without any language in the model nothing can be told, and
    only texts without letters go.
    """
    letter = fresh(docs, "__letter")
    marked = docs.withColumn(letter, F.coalesce(F.rlike(F.col("text").cast("string"), F.lit(r"\p{L}")), F.lit(False)))
    if not model[0]:
        return marked.filter(F.col(letter)).drop(letter)
    return marked.mapInArrow(functools.partial(_keep, langs=model[0], logp=model[1], least=least_gain, letter=letter), docs.schema)
