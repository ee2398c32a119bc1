"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of contexts of up to ``ORDER`` bytes with counts of the byte that follows.
A symbol unseen in a context costs the context's escape probability (method C: distinct symbols over
total plus distinct) and is then predicted by the next shorter context, seen symbols excluded, down
to a uniform distribution. With the counts frozen, every context's whole distribution is computed
once; scoring a text adds up exact code lengths, by table lookups over whole batches.

Training reads a bounded sample of labelled rows: the ``LANGUAGES`` most frequent values of ``lang``, about
``ROWS_PER_LANGUAGE`` of each, drawn by a hash of doc_id, of texts up to ``TRAIN_CHARACTERS``, and no
more than ``SAMPLE_CHARACTERS`` in all. The table of code lengths has at most ``TABLE_BYTES``: where more
contexts were seen, the rarer ones are left to shorter contexts. Prediction covers every whole text.

Defined cases: null text or one without a letter gives ``und`` with score 0, as does every text if
nothing could be learned; rows with a null lang are not learned from; a null doc_id counts as the
empty string; ties go to the language that sorts first; rows that repeat are judged one by one; an empty
table gives no rows; other columns stay, except lang_pred and score, which are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import boxed, unboxed
from .storage import SharedFile, open_filesystem, shared_dir
from .tokens import PieceEncoder, batches_of

ORDER = 3
ROWS_PER_LANGUAGE = 400
TRAIN_CHARACTERS = 50_000
LANGUAGES = 200
SAMPLE_CHARACTERS = 50_000_000
TABLE_BYTES = 1 << 29
SLICE_BYTES = 1 << 26  # of code lengths at a time, however long a text and however many languages
MIN_CONTEXT = 3  # longer contexts seen less often, over all languages, are left to the shorter ones
UNDETERMINED = "und"
_START = 0  # symbol of the place before a text; 1: any byte not seen in training


class Model:
    """Frozen code lengths: ``bits[node * symbols + symbol]`` has one column per language."""

    def __init__(self, texts: dict[str, list[str]], table_bytes: int = TABLE_BYTES):
        self.languages = sorted(texts)
        streams = {k: [np.frombuffer(x.encode(), dtype=np.uint8) for x in v] for k, v in texts.items()}
        seen = np.unique(np.concatenate([np.zeros(0, np.uint8), *(x for v in streams.values() for x in v)]))
        self.symbol = np.ones(256, dtype=np.int64)
        self.symbol[seen] = np.arange(2, 2 + len(seen))
        self.symbols = n = 2 + len(seen)
        counts = [self._counts([self.symbol[x] for x in streams[k]]) for k in self.languages]
        # nodes by order; context codes are base-n numbers, the nearest byte last
        least = MIN_CONTEXT
        while True:
            self.nodes = [self._contexts([c[o] for c in counts], o, least) for o in range(ORDER + 1)]
            if sum(map(len, self.nodes)) * n * len(self.languages) * 4 <= table_bytes or not len(self.nodes[-1]):
                break
            least *= 2
        starts = np.cumsum([0, *map(len, self.nodes)])
        table = np.empty((starts[-1], n, len(self.languages)), dtype=np.float32)
        for k, count in enumerate(counts):
            shorter = None
            for o in range(ORDER + 1):
                rows = self._distributions(self.nodes[o], *count[o], shorter, o)
                table[starts[o] : starts[o + 1], :, k] = -np.log2(rows)
                shorter = rows
        self.bits = table.reshape(-1, len(self.languages))
        self.longest = self._longest(starts)

    def _counts(self, streams: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order the codes of (context, symbol) and how often they occur."""
        found = [[] for _ in range(ORDER + 1)]
        for x in streams:
            padded = np.concatenate([np.full(ORDER, _START), x])
            for o in range(ORDER + 1):
                code = np.zeros(len(x), dtype=np.int64)
                for back in range(o, -1, -1):
                    code = code * self.symbols + padded[ORDER - back : len(padded) - back]
                found[o].append(code)
        return [np.unique(np.concatenate([np.zeros(0, np.int64), *x]), return_counts=True) for x in found]

    def _contexts(self, counts, order: int, least: int) -> np.ndarray:
        codes, where = np.unique(np.concatenate([c // self.symbols for c, _ in counts]), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate([t for _, t in counts]), minlength=len(codes))
        return codes[total >= least] if order > 1 else codes

    def _distributions(self, nodes, codes, times, shorter, order) -> np.ndarray:
        n = self.symbols
        if order == 0:
            below = np.full((len(nodes), n), 1.0 / n)
        else:
            suffix = nodes % n ** (order - 1) if order > 1 else np.zeros(len(nodes), np.int64)
            below = shorter[np.searchsorted(self.nodes[order - 1], suffix)]
        own = np.zeros((len(nodes), n))
        kept = np.isin(codes // n, nodes)
        codes, times = codes[kept], times[kept]
        own[np.searchsorted(nodes, codes // n), codes % n] = times
        total, kinds = own.sum(1, keepdims=True), (own > 0).sum(1, keepdims=True)
        unseen = np.where(own > 0, 0.0, below)
        mass = unseen.sum(1, keepdims=True)
        escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
        spread = unseen / np.maximum(mass, 1e-300)
        # where every symbol has been seen there is nothing to escape to
        return np.where(mass > 0, np.where(own > 0, own / np.maximum(total + kinds, 1), escape * spread), own / np.maximum(total, 1))

    def _longest(self, starts) -> np.ndarray:
        """The node of the longest known suffix of every possible context of ``ORDER`` symbols."""
        n, at = self.symbols, np.zeros(1, dtype=np.int32)
        for o in range(1, ORDER + 1):
            at = np.tile(at, n)  # a code of order o has its suffix's node unless it is known itself
            at[self.nodes[o]] = starts[o] + np.arange(len(self.nodes[o]))
        return at

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language; code lengths add up, so texts are taken in slices, each with the context before it."""
        sizes = np.array([len(x) for x in texts], dtype=np.int64)
        gap = bytes(ORDER)
        raw = np.frombuffer(gap + gap.join(texts), dtype=np.uint8)
        begins = np.cumsum(sizes + ORDER) - sizes
        out = np.zeros((len(texts), len(self.languages)))
        step = min(max(1 << 12, SLICE_BYTES // (4 * len(self.languages))), 1 << 20)
        for low in range(ORDER, len(raw), step):
            place = np.arange(low - ORDER, min(low + step, len(raw)))
            text = np.searchsorted(begins, place, side="right") - 1
            inside = (text >= 0) & (place < (begins + sizes)[text])
            x = self.symbol[raw[place]]
            x[~inside] = _START
            context = np.zeros(len(x) - ORDER, dtype=np.int64)
            for back in range(ORDER, 0, -1):
                context = context * self.symbols + x[ORDER - back : len(x) - back]
            rows = self.bits[self.longest[context].astype(np.int64) * self.symbols + x[ORDER:]]
            rows[~inside[ORDER:]] = 0
            own = text[ORDER:]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            np.add.at(out, own[first], np.add.reduceat(rows, first, axis=0, dtype=np.float64))
        return out


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, characters: int = TRAIN_CHARACTERS) -> str | None:
    """The file of a model from a bounded sample of ``docs`` (doc_id, text, lang); None if there is nothing to learn from.

    One task fits it and writes it to the shared folder, so that neither the sample nor the table passes through the
    driver. A repeated attempt writes a file of its own."""
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    usable = rows.filter(F.col("lang").isNotNull() & (F.length("text") <= characters) & F.col("text").rlike(r"\p{L}"))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("characters")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return None
    # a language's share of the sample, by rows and by characters
    share = {r["lang"]: min(1.0, rows_per_language / r["n"], SAMPLE_CHARACTERS / len(sizes) / r["characters"]) for r in sizes}
    draw = F.pmod(F.xxhash64(F.lit("ppm"), "doc_id"), F.lit(1_000_000)) / 1e6
    chosen = F.element_at(F.create_map(*(F.lit(x) for pair in share.items() for x in pair)), F.col("lang"))  # null beyond the languages learned
    folder = shared_dir(docs.sparkSession, "language-model")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: dict[str, list[str]] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                texts.setdefault(lang, []).append(text)
        if texts:
            out = SharedFile(folder, "model.pickle")
            out.write(pickle.dumps(Model(texts), protocol=5))
            out.close()
            yield pd.DataFrame({"uri": [out.uri]})

    found = usable.filter(draw < chosen).select("lang", "text").repartition(1).mapInPandas(fit, "uri string").collect()  # a bounded sample
    return found[0]["uri"] if found else None


_loaded: dict[str, Model] = {}  # a worker keeps the model that it used last


def load(uri: str) -> Model:
    """The model that ``train`` wrote; for use in tasks."""
    if uri not in _loaded:
        _loaded.clear()
        system, path = open_filesystem(uri)
        with system.open_input_stream(path) as source:
            _loaded[uri] = pickle.loads(source.read())
    return _loaded[uri]


def identify(docs: DataFrame, model: str | None) -> DataFrame:
    """Add lang_pred and score (the posterior of the best language under equal priors) to doc_id, text and what else ``docs`` has. model: of ``train``."""
    own = docs.drop("lang_pred", "score")
    uri = model
    if uri is None:
        return own.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})

    @F.pandas_udf("lang_pred string, score double")
    def predict(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        PieceEncoder.forget()  # a worker that has tokenized before keeps some 200 MB of pieces
        model = load(uri)
        for batch in series:
            best, score = np.zeros(len(batch), int), np.zeros(len(batch))
            texts = batch.tolist()
            for part in batches_of(texts, 1 << 18):
                bits = model.code_lengths([x.encode("utf-8", "replace") if x else b"" for x in texts[part]])
                gain = bits - bits.min(axis=1, keepdims=True)
                best[part] = gain.argmin(axis=1)
                score[part] = 1 / np.exp2(-np.minimum(gain, 1000)).sum(axis=1)
            yield pd.DataFrame({"lang_pred": np.array(model.languages, dtype=object)[best], "score": score})

    text = F.col("doc.text")
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    found = boxed(own).withColumn("found", predict(F.when(lettered, text)))
    return unboxed(
        found,
        F.when(lettered, F.col("found.lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(lettered, F.col("found.score")).otherwise(0.0).alias("score"),
    )


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learned from: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify_table(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``, by a model of its rows that are not held out."""
    model = train(docs.select("doc_id", "text", "lang").filter(~held_out()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
