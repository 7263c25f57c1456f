"""Language ID as inference of a mixture: each text is letter trigrams drawn from a few languages in unknown proportions.

Trigrams are hashed to BUCKETS cells. Training sums, in Spark, the cells of labelled texts by language: a table of languages x
BUCKETS. For each text, expectation-maximisation finds the proportions under all languages; then the nested sets of its most
probable 1, 2, ... languages are refitted, and the set of largest log likelihood less a penalty a language is chosen. Sets grow
up to all languages; they end early only where no text can gain, as a log likelihood is at most 0 and the penalty alone is more.

A text with letters and no trigram has the shares in which training texts have the languages. The score is the largest share times
the part of the text's characters whose first byte training has seen: a text in a script that no training text uses has score 0."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 4096
UNKNOWN = "und"
#: Languages at most: the table of languages x BUCKETS goes through the driver and to all tasks.
LANGUAGES = 1000
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes by class: 1-26 letters, 27-63 bytes of characters beyond ASCII, 0 the rest.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 37
#: Bytes with which letters, or characters beyond ASCII, begin.
_LEAD = (_CLASS > 0) & ((np.arange(256) < 128) | (np.arange(256) >= 0xC0))


def _cells(data: np.ndarray) -> np.ndarray:
    """The cell of the trigram from each byte on; those within blanks have cell -1."""
    c = _CLASS[data]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    code = (c[:-2] << 12) | (c[1:-1] << 6) | c[2:]
    cell = (code * 0x9E3779B1 & 0xFFFFFFFF) >> 20
    cell[c[1:-1] == 0] = -1
    return cell


def _row_cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every trigram that lies within one row."""
    cell = _cells(data)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(cell)]
    inside = cell >= 0
    ends = np.concatenate([offsets[1:] - 1, offsets[1:] - 2])
    inside[ends[(ends >= 0) & (ends < len(inside))]] = False
    return row[inside], cell[inside]


def _count_cells(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        col, langs = common.text_column(batch), batch.column("lang").to_pylist()
        for lo, hi, data, offsets in common.byte_blocks(col):
            row, cell = _row_cells(data, offsets)
            names = sorted(set(langs[lo:hi]))
            which = np.array([names.index(x) for x in langs[lo:hi]])
            found = np.bincount(which[row] * BUCKETS + cell, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            lead, text = np.flatnonzero(_LEAD[data]), np.repeat(which, np.diff(offsets))
            leads = np.bincount(text[lead] * 256 + data[lead], minlength=len(names) * 256).reshape(-1, 256)
            found = np.concatenate([found, leads, np.bincount(which, minlength=len(names))[:, None]], axis=1)
            for name, n in zip(names, found, strict=True):
                sums[name] = sums.get(name, 0) + n
    for name, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "cell", "n"])


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(languages in order, log-probability table, share of the texts, which first bytes were seen) from texts with a language; cells smoothed by 1/2.

    Rows without text or language are left out. The driver gets languages x BUCKETS sums, however many texts there are; more
    languages than LANGUAGES are an error."""
    labelled = labelled.select("text", "lang").filter("text is not null and lang is not null")
    sums = labelled.mapInArrow(_count_cells, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    sums = common.checkpointed(sums)
    if sums.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    sums = sums.toPandas()
    langs = sorted(sums["lang"].unique())
    table = np.zeros((len(langs), BUCKETS + 257))
    if len(langs):
        at = {x: k for k, x in enumerate(langs)}
        table[sums["lang"].map(at).to_numpy(), sums["cell"].to_numpy()] += sums["n"].to_numpy()
    cells, texts, seen = table[:, :BUCKETS] + 0.5, table[:, -1], table[:, BUCKETS:-1].sum(axis=0) > 0
    return langs, np.log(cells / cells.sum(axis=1, keepdims=True)), texts / max(texts.sum(), 1), seen


def _fit(share, lik, weight, first, total, rounds):
    """EM for all texts at once; share: text x language, zero where a language is left out. Gives shares and log likelihoods."""
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(weight))))
    for _ in range(rounds):
        part = lik * share[row]
        part *= (weight / np.maximum(part.sum(axis=1), 1e-300))[:, None]
        share = np.add.reduceat(part, first, axis=0) / total[:, None]
    return share, np.add.reduceat(weight * np.log(np.maximum((lik * share[row]).sum(axis=1), 1e-300)), first)


class Mixture:
    """The model as workers apply it; small enough to travel in the function that Spark ships."""

    def __init__(self, langs: list[str], table: np.ndarray, prior: np.ndarray, seen: np.ndarray, penalty: float = 4.0, rounds: int = 8):
        self.langs, self.lik, self.penalty, self.rounds = langs, np.exp(table - table.max(axis=0)) if len(langs) else table, penalty, rounds
        ascii_ = (np.arange(256) < 128) & _LEAD  # these letters stand or fall together
        self.prior, self.seen = prior, np.where(ascii_, seen[ascii_].any(), seen & _LEAD)

    def proportions(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the rows of a block: shares by language (zero rows where there is no trigram), and the number of languages chosen."""
        rows, n = len(offsets) - 1, len(self.langs)
        out, size = np.zeros((rows, n)), np.zeros(rows, int)
        row, cell = _row_cells(data, offsets)
        if not len(row) or not n:
            return out, size
        cells = np.bincount(row * BUCKETS + cell, minlength=rows * BUCKETS)
        at = np.flatnonzero(cells)
        weight, row = cells[at].astype(float), at // BUCKETS
        have, first = np.unique(row, return_index=True)
        lik, total = self.lik.T[at % BUCKETS], np.add.reduceat(weight, first)
        share, _ = _fit(np.full((len(have), n), 1 / n), lik, weight, first, total, self.rounds)
        order = np.argsort(-share, axis=1, kind="stable")
        best = np.full(len(have), -np.inf)
        for k in range(1, n + 1):
            if k > 1 and (best >= -self.penalty * (k - 1) * np.log(total + 1)).all():
                break
            mask = np.zeros_like(share)
            np.put_along_axis(mask, order[:, :k], 1.0, axis=1)
            start = (share + 1e-9) * mask
            fitted, ll = _fit(start / start.sum(axis=1, keepdims=True), lik, weight, first, total, 0 if k == 1 else 4)
            ll -= self.penalty * (k - 1) * np.log(total + 1)
            better = ll > best
            best[better], out[have[better]], size[have[better]] = ll[better], fitted[better], k
        return out, size

    def familiar(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each row, the part of its letters and characters beyond ASCII whose first byte was seen in training."""
        begins, seen = (np.concatenate([[0], np.cumsum(x[data])]) for x in (_LEAD, self.seen))
        return np.diff(seen[offsets]) / np.maximum(np.diff(begins[offsets]), 1)

    def predict(self, texts: pa.Array) -> pa.Array:
        """Per text: the language of the largest share, that share (less for characters not seen in training), how many languages were chosen, and the shares of those, in order of language."""
        langs, scores, sizes, counts, names, shares = [], [], [], [0], [], []
        for lo, hi, data, offsets in common.byte_blocks(texts):
            share, size = self.proportions(data, offsets)
            for text, p, k, f in zip(texts.slice(lo, hi - lo).to_pylist(), share, size, self.familiar(data, offsets), strict=True):
                known = len(self.langs) > 0 and _LETTER.search(text)
                if known and not k:
                    p = self.prior
                top = int(p.argmax()) if known else 0
                langs.append(self.langs[top] if known else UNKNOWN)
                scores.append(float(min(1.0, p[top]) * f) if known else 0.0)
                sizes.append(int(k))
                at = np.flatnonzero(p).tolist() if known else []
                names += [self.langs[x] for x in at]
                shares += p[at].tolist()
                counts.append(len(names))
        each = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["lang", "share"])
        parts = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), each)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int32()), parts], ["lang_pred", "score", "languages", "proportions"])


def predictor(model: Mixture):
    """A column function from text to (lang_pred, score, languages, proportions); all other columns stay in the JVM."""

    @F.arrow_udf("lang_pred string, score double, languages int, proportions array<struct<lang: string, share: double>>")
    def predict(texts: pa.Array) -> pa.Array:
        return model.predict(pa.compute.fill_null(texts, ""))

    return predict


def has_letter(texts: Column) -> Column:
    """Whether a text has a letter, as prediction asks of it; a null text has none."""

    @F.arrow_udf("boolean")
    def found(values: pa.Array) -> pa.Array:
        return pa.array([bool(v and _LETTER.search(v)) for v in values.to_pylist()], pa.bool_())

    return found(texts)


def identify(docs: DataFrame, model: Mixture) -> DataFrame:
    """docs with a column language (lang_pred, score, languages, proportions).

    A null or empty text, or one without a letter, is 'und' with score 0 and no proportions; so is every text where nothing was
    learned (an empty table, or one where every lang is null). A letter or two have no trigram: languages is 0, and the shares are
    those of the training texts. Whole texts are read, however long; repeated rows are answered alike. A column of docs that is
    named language is replaced; all others stay."""
    return docs.withColumn("language", predictor(model)(F.col("text")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.crc_mod("doc_id", 4) == 2
    model = Mixture(*train(docs.filter(~held_out)))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("score"),
        F.col("language.proportions").alias("proportions"),
    )
