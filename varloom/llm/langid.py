"""Language identification with interpolated Kneser-Ney character models.

Symbols are letters, lower-cased; every run of anything else is one space. The
n-grams of all languages stand in one sorted hash array for each order, with a
log-probability for each language; what an array lacks is backed off through
the weights of its contexts. The language with the lowest cross-entropy for
each symbol wins; a text that is further from it than held-back training texts
of its length are is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.common import U64, bound_batches, materialize
from varloom.llm.ngram import BackoffTable, context_hash, gram_hash, lags_of, sum_rows

SPACE = 32
CHUNK_CHARS = 1 << 18
_LETTER: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, row starts, row lengths, letters in each row); a row with letters starts and ends with a space or a letter."""
    low = [t.lower() for t in texts]
    n = np.array([len(t) for t in low], dtype=np.int64)
    at = np.concatenate(([0], np.cumsum(n)))
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = is_letter()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others
    first = at[:-1][n > 0]
    keep[first] = letter[first]
    sym = np.where(letter, code, SPACE)[keep]
    kept, letters = np.concatenate(([0], np.cumsum(keep))), np.concatenate(([0], np.cumsum(letter)))
    lens = np.diff(kept[at])
    return sym, kept[at[:-1]], lens, np.diff(letters[at])


def pieces(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Successive whole texts of about ``CHUNK_CHARS`` code points."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1])
        if size >= CHUNK_CHARS:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


@dataclass
class Model:
    langs: list[str]
    table: BackoffTable
    centre: np.ndarray
    spread: np.ndarray
    noise: np.ndarray
    limit: float
    #: Symbols beyond this many do not make a prediction surer.
    sure_after: int = 40

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats for each symbol and language, symbols, letters) of each text."""
        sym, starts, lens, letters = symbols(texts)
        if not len(sym):
            return np.zeros((len(texts), len(self.langs))), lens, letters
        logs = self.table.score(lags_of(sym, starts, lens, self.table.order, SPACE))
        return -sum_rows(logs, starts, lens) / np.maximum(lens, 1)[:, None], lens, letters

    def distance(self, entropy: np.ndarray, lang: np.ndarray, lens: np.ndarray) -> np.ndarray:
        return (entropy - self.centre[lang]) / (self.spread[lang] + self.noise[lang] / np.sqrt(np.maximum(lens, 1)))


def gram_counts(train: DataFrame, order: int) -> DataFrame:
    """(lang, n, gram, ctx, suffix, c) for n = 1 to ``order``: counts by the hash of the n-gram, of its context and of its last n-1 symbols."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frame = batch.to_pandas()
            for lang, rows in frame.groupby("lang"):
                for _, texts in pieces(rows["text"].tolist()):
                    sym, starts, lens, _ = symbols(texts)
                    if not len(sym):
                        continue
                    lags = lags_of(sym, starts, lens, order, SPACE)
                    suffix = np.zeros(len(sym), U64)
                    for n in range(1, order + 1):
                        gram = gram_hash(lags, n)
                        keys, first, c = np.unique(gram, return_index=True, return_counts=True)
                        ctx = context_hash([x[first] for x in lags], n)
                        yield pd.DataFrame({"lang": lang, "n": n, "gram": keys.view(np.int64), "ctx": ctx.view(np.int64), "suffix": suffix[first].view(np.int64), "c": c})
                        suffix = gram

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in count(batches):
            yield pa.RecordBatch.from_pandas(frame.astype({"n": np.int32, "c": np.int64}), preserve_index=False)

    parts = train.select("lang", "text").mapInArrow(arrow, "lang string, n int, gram long, ctx long, suffix long, c long")
    return parts.groupBy("lang", "n", "gram").agg(F.first("ctx").alias("ctx"), F.first("suffix").alias("suffix"), F.sum("c").alias("c"))


def kneser_ney(counts: pd.DataFrame, langs: list[str], order: int) -> BackoffTable:
    """The table of the counts of a bounded sample.

    The highest order uses counts, the others the number of symbols that an
    n-gram follows. Each order passes on D * types / total of its mass.
    """
    merged = {n: np.unique(counts["gram"].to_numpy()[counts["n"].to_numpy() == n].view(U64)) for n in range(1, order + 1)}
    contexts = {n: np.unique(counts["ctx"].to_numpy()[counts["n"].to_numpy() == n].view(U64)) for n in range(1, order + 1)}
    p = {n: np.zeros((len(merged[n]), len(langs))) for n in merged}
    passed = {n: np.zeros((len(contexts[n]), len(langs))) for n in merged}
    suffix_row = {}
    for n in range(2, order + 1):
        rows = counts[counts["n"] == n].drop_duplicates("gram").sort_values("gram", key=lambda x: x.to_numpy().view(U64))
        suffix_row[n] = np.searchsorted(merged[n - 1], rows["suffix"].to_numpy().view(U64)), np.searchsorted(contexts[n], rows["ctx"].to_numpy().view(U64))
    for at, lang in enumerate(langs):
        own = {n: x for n, x in counts[counts["lang"] == lang].groupby("n")}
        for n in range(1, order + 1):
            x = own[n]
            gram, ctx = x["gram"].to_numpy().view(U64), x["ctx"].to_numpy().view(U64)
            c = x["c"].to_numpy().astype(float)
            if n < order:  # distinct symbols before it
                after, many = np.unique(own[n + 1]["suffix"].to_numpy().view(U64), return_counts=True)
                row = np.minimum(np.searchsorted(after, gram), len(after) - 1)
                c = np.where(after[row] == gram, many[row], 0).astype(float)
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            ctx_row = np.searchsorted(contexts[n], ctx)
            total, types = np.bincount(ctx_row, c, len(contexts[n])), np.bincount(ctx_row[c > 0], minlength=len(contexts[n]))
            mass = np.where(total > 0, d * types / np.maximum(total, 1), 1.0)
            passed[n][:, at] = mass
            row = np.searchsorted(merged[n], gram)
            top = np.zeros(len(merged[n]))
            top[row] = np.maximum(c - d, 0) / np.maximum(total[ctx_row], 1)
            if n == 1:
                p[1][:, at] = top + mass[0] / (len(merged[1]) + 1)
            else:
                up, of = suffix_row[n]
                p[n][:, at] = top + mass[of] * p[n - 1][up, at]
    log = lambda x: np.log(np.maximum(x, 1e-30)).astype(np.float32)
    floor = np.full(len(langs), -np.log(len(merged[1]) + 1), np.float32)
    return BackoffTable(order, {n: (merged[n], log(p[n])) for n in merged}, {n: (contexts[n], log(passed[n])) for n in merged}, floor)


def sampled(labelled: DataFrame, max_docs: int, held_back: float) -> DataFrame:
    """(text, lang, back): ``max_docs`` different texts of each language at most, those with the smallest hashes.

    Copies of a text in a language are one before they are counted or sent.
    Every (1 / ``held_back``)-th is held back, so a language with fewer texts has none of them.
    """
    h = F.xxhash64(F.lit(17), "text")
    per = labelled.select("lang", h.alias("h")).distinct().groupBy("lang").count()
    unit = 1 << 30
    # Somewhat more than the share that gives max_docs; the rank below is exact.
    share = F.least(F.lit(unit), F.ceil(F.lit(unit) * (max_docs + 6 * max_docs**0.5 + 6) / F.col("count"))).cast("long")
    few = labelled.withColumn("h", h).join(F.broadcast(per.select("lang", share.alias("share"))), "lang")
    few = few.filter(F.pmod("h", F.lit(unit)) < F.col("share")).groupBy("lang", "h").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(unit)), "h"))
    ranked = few.withColumn("rank", rank).filter(F.col("rank") <= max_docs)
    return ranked.select("text", "lang", (F.col("rank") % max(2, round(1 / held_back)) == 0).alias("back"))


def fit(labelled: DataFrame, *, order: int, max_docs: int, held_back: float, tail: float, false_rejects: float) -> Model:
    """A model of the (text, lang) rows, from ``max_docs`` different whole texts of each language at most.

    The texts are those with the smallest hashes, so the bound holds for any
    corpus, and so does the size of the model, which comes to the driver. The
    part ``held_back`` is left out of the counts; on it the rejection is
    fitted: the largest ``tail`` of its distances give an exponential tail, and the
    limit is where that tail falls to ``false_rejects``.
    """
    sample = materialize(sampled(labelled, max_docs, held_back))
    back = F.col("back")
    if sample.isEmpty():
        raise ValueError("no text with a language to learn from")
    counts = gram_counts(sample.filter(~back), order).toArrow().to_pandas()
    langs = sorted(set(counts["lang"]))
    if not langs:
        raise ValueError("the texts to learn from have no letters")
    flat = np.zeros(len(langs))
    model = Model(langs, kneser_ney(counts, langs, order), flat, flat + 1, flat, np.inf)
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            lang = np.array([model.langs.index(x) if x in model.langs else -1 for x in batch.column(1).to_pylist()], dtype=np.int64)
            for first, texts in pieces(batch.column(0).to_pylist()):
                e, lens, letters = model.entropies(texts)
                own = lang[first : first + len(texts)]
                ok = (letters > 0) & (own >= 0)
                yield pa.RecordBatch.from_pydict({"lang": own[ok], "n": lens[ok], "e": e[np.arange(len(own)), own][ok]})

    got = sample.filter(back).select("text", "lang").mapInArrow(measure, "lang long, n long, e double").toArrow().to_pandas()
    centre, spread, noise = np.zeros(len(langs)), np.ones(len(langs)), np.ones(len(langs))
    for i in range(len(langs)):
        own = got[got["lang"] == i]
        if len(own) >= 10:
            centre[i] = own["e"].median()
            long = own[own["n"] >= own["n"].median()]
            spread[i] = max(long["e"].std(), 0.02)
            noise[i] = max(((own["e"] - centre[i]).abs() * np.sqrt(own["n"])).median(), 0.1)
        else:
            centre[i], spread[i] = np.log(30), 1.0
    model = Model(langs, model.table, centre, spread, noise, np.inf)
    away = model.distance(got["e"].to_numpy(), got["lang"].to_numpy(), got["n"].to_numpy()) if len(got) else np.zeros(1)
    from_here = float(np.quantile(away, 1 - tail))
    excess = away[away > from_here] - from_here
    model.limit = from_here + (float(excess.mean()) if len(excess) else 1.0) * float(np.log(tail / false_rejects))
    return model


def identify(
    docs: DataFrame,
    train: Column,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    order: int = 5,
    max_docs: int = 1500,
    held_back: float = 0.2,
    tail: float = 0.05,
    false_rejects: float = 1e-6,
    unknown: str = "und",
) -> DataFrame:
    """Predict each row's language, learning from the rows where ``train`` holds.

    Adds ``lang_pred``, ``score`` (the probability of the language, from 0 to
    1, by the entropies of all languages) and ``rejected`` to all columns of
    ``docs``; columns of these names are replaced.

    A null text or one without a letter is ``unknown``, with score 0 and
    rejected. Rows without a text or language are not learned from, and
    ``lang_col`` is no input of a prediction. Ties go to the language that
    sorts first. ``false_rejects`` is the share of texts in learned languages
    that the rejection may cost. Repeated rows get the same result. With no row to learn from
    a ValueError is raised, unless ``docs`` is empty: then there is no row to return.
    """
    text = F.col(text_col)
    bound_batches(docs.sparkSession)
    old = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    labelled = docs.filter(train & text.isNotNull() & F.col(lang_col).isNotNull()).select(text.alias("text"), F.col(lang_col).alias("lang"))
    if docs.isEmpty():
        return docs.select(*old, F.lit(unknown).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    sent = docs.sparkSession.sparkContext.broadcast(fit(labelled, order=order, max_docs=max_docs, held_back=held_back, tail=tail, false_rejects=false_rejects))

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        model = sent.value
        lang, score, rejected = [], [], []
        for _, part in pieces(texts.to_pylist()):
            e, lens, letters = model.entropies(part)
            best = e.argmin(axis=1)
            least = e[np.arange(len(part)), best]
            odds = np.exp(-(e - least[:, None]) * np.minimum(lens, model.sure_after)[:, None]).sum(axis=1)
            none = letters == 0
            lang.append(np.where(none, unknown, np.array(model.langs, dtype=object)[best]))
            score.append(np.where(none, 0.0, 1 / odds))
            rejected.append(none | (model.distance(least, best, lens) > model.limit))
        cols = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((lang, object), (score, float), (rejected, bool))]
        return pa.StructArray.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1]), pa.array(cols[2])], ["lang", "score", "rejected"])

    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    made = docs.select(F.struct(*old).alias("row"), predict(text).alias("p"))
    return made.select(*[F.col("row")[c].alias(c) for c in names], F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))
