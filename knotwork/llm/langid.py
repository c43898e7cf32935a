"""Language ID by mixtures: each document is a blend of languages, found by expectation-maximisation over its n-grams.

Training counts hashed character trigrams per language over all labelled documents of the training folds; the counts are
summed in each task first, so what reaches the driver is (languages x BUCKETS) numbers. A document's proportions start
equal and follow EM; languages are then dropped, weakest first, while the penalised likelihood (log-likelihood less
PENALTY * log(n-grams) per language) gains. The prediction is the language of the largest proportion that stays.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.common import crc_mod, filesystem, map_batches, publish, scratch

BUCKETS, SMOOTHING = 1 << 14, 0.5
ROUNDS, TOLERANCE, PENALTY = 12, 1e-3, 0.5
UNDETERMINED = "und"
#: Characters whose n-grams are counted at a time.
TEXT_BATCH = 1 << 20


def trigram_counts(text: str, batch: int = TEXT_BATCH):
    """(buckets, counts) of the text's hashed trigrams: lower case, runs of non-letters as one space; None without letters.

    A space stands before and behind the text. It is taken in batches that hand on their last two characters, so the
    counts do not depend on them.
    """
    import numpy as np

    total, letters, before, carry, text = None, False, True, np.array([32], np.uint64), text.lower()
    for at in range(0, len(text), batch):
        codes = np.frombuffer(text[at : at + batch].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters(codes)
        letters = letters or bool(letter.any())
        kept = letter | np.concatenate([[before], letter[:-1]])  # of a run of other characters, the first stays as a space
        before = bool(letter[-1])
        c = np.concatenate([carry, np.where(letter, codes, 32)[kept].astype(np.uint64)])
        if at + batch >= len(text):
            c = np.append(c, np.uint64(32))
        carry = c[-2:]
        if len(c) > 2:
            mixed = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ c[2:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
            counts = np.bincount((mixed >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
            total = counts if total is None else total + counts
    if not letters:
        return None
    found = np.flatnonzero(total)
    return found, total[found]


@lru_cache(maxsize=1)
def _letter_table():
    import numpy as np

    return np.array([chr(i).isalpha() for i in range(0x3000)])


def _letters(codes):
    import numpy as np

    table = _letter_table()
    out = table[np.minimum(codes, 0x2FFF)] & (codes < 0x3000)
    for k in np.flatnonzero(codes >= 0x3000):
        out[k] = chr(codes[k]).isalpha()
    return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fold: tuple[int, int] = (5, 0)):
    """(languages, log probabilities [language, bucket]) from documents outside the held-out fold with a language.

    Null texts and texts without letters add nothing. Without any labelled document there are no languages.
    """
    import numpy as np

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).filter((crc_mod(F.col("id"), fold[0]) != fold[1]) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def count(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                found = trigram_counts(batch.column(1)[k].as_py())
                if found is not None:
                    own = sums.setdefault(batch.column(0)[k].as_py(), np.zeros(BUCKETS, np.int64))
                    own[found[0]] += found[1]
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(own[at])], names=["lang", "bucket", "n"])

    # at most BUCKETS rows per language come back
    found = map_batches(rows, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique().tolist())
    table = np.full((len(langs), BUCKETS), SMOOTHING)
    table[found["lang"].map({v: k for k, v in enumerate(langs)}).to_numpy(int), found["bucket"].to_numpy(int)] += found["n"].to_numpy(float)
    return langs, np.log(table / table.sum(1, keepdims=True))


def proportions(counts, logs):
    """(proportions, log-likelihood) of the languages whose log probabilities are the rows of logs."""
    import numpy as np

    top = logs.max(0)
    p = np.exp(logs - top)
    share, n = np.full(len(p), 1 / len(p)), counts.sum()
    for _ in range(ROUNDS if len(p) > 1 else 0):
        resp = share[:, None] * p
        new = (resp * (counts / resp.sum(0))).sum(1) / n
        moved = np.abs(new - share).max()
        share = new
        if moved < TOLERANCE:
            break
    return share, float((counts * (np.log(share @ p) + top)).sum())


def infer(text: str | None, langs: list[str], logs):
    """(language, its proportion, {language: proportion}): the mixture of a whole text.

    UNDETERMINED with score 0 for null texts, texts without a letter, and where no language was learned.
    """
    import numpy as np

    found = trigram_counts(text) if text and langs else None
    if found is None:
        return UNDETERMINED, 0.0, {}
    counts, own = found[1].astype(float), logs[:, found[0]]
    chosen = np.arange(len(langs))
    share, fit = proportions(counts, own)
    price = PENALTY * np.log(counts.sum() + 1)
    while len(chosen) > 1:
        fewer = np.delete(chosen, share.argmin())
        less, less_fit = proportions(counts, own[fewer])
        if less_fit - price * len(fewer) < fit - price * len(chosen):
            break
        chosen, share, fit = fewer, less, less_fit
    best = int(share.argmax())
    return langs[chosen[best]], float(min(max(share[best], 0.0), 1.0)), {langs[c]: float(s) for c, s in zip(chosen, share, strict=True)}


@lru_cache(maxsize=1)
def _model(uri: str):
    import numpy as np

    where, path = filesystem(uri)
    with where.open_input_stream(path) as f:
        head, _, body = f.read().partition(b"\n")
    langs = json.loads(head)
    return langs, np.frombuffer(body, "<f8").reshape(len(langs), -1)


def save(spark: SparkSession, model) -> str:
    """Writes a model to the shared folder, its languages as JSON and then its numbers; the workers read it once."""
    uri = f"{scratch(spark, 'language-model')}/model.bin"
    langs, logs = model
    publish(uri, lambda out: out.write(json.dumps(langs).encode() + b"\n" + logs.astype("<f8").tobytes()))
    return uri


def identify(docs: DataFrame, model_uri: str, id_col: str = "doc_id", text_col: str = "text", fold: tuple[int, int] = (5, 0)) -> DataFrame:
    """One row per row of docs: id_col, held_out, lang_pred, score, mixture (map of the languages that stay)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            langs, logs = _model(model_uri)
            for at in range(0, batch.num_rows, 1024):
                found = [infer(x, langs, logs) for x in batch.column(1).slice(at, 1024).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 1024), pa.array([f[0] for f in found]), pa.array([f[1] for f in found]), pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.float64()))],
                    names=[id_col, "lang_pred", "score", "mixture"],
                )

    rows = map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {kind}, lang_pred string, score double, mixture map<string,double>")
    return rows.withColumn("held_out", crc_mod(F.col(id_col), fold[0]) == fold[1])
