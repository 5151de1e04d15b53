"""Language ID by compression: the language whose dictionary makes the text smallest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

UNKNOWN = "und"
BLOCK = 4096


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def fit(
    docs: DataFrame, sample_docs: int = 4000, dict_bytes: int = 65536, text_chars: int = 2000, max_langs: int = 256, word_chars: int = 64
) -> dict[str, bytes]:
    """(doc_id, text, lang) -> a raw-content dictionary of at most ``dict_bytes`` for each language.

    Learns from rows with text, language and doc_id that aren't held out: of each language at most ``sample_docs`` rows,
    those with the least hashes of doc_id. Words of ``word_chars`` characters at most that most of these use fill one half
    of a dictionary, the most common last, where zstandard finds them cheapest; pieces of ``text_chars`` characters, each
    from a place in a sampled text that a hash of its doc_id tells, fill the other. What the driver gets is bounded by
    languages times ``dict_bytes``, whatever the input; over ``max_langs`` languages raise.
    """
    rows = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"over {max_langs} languages; their dictionaries would not be small")
    if not counts:
        return {}
    spread = 1 << 30
    cut = F.lit(spread)
    for lang, n in counts.items():
        share = min(1.0, (1.2 * sample_docs + 100) / n)
        cut = F.when(F.col("lang") == lang, F.lit(int(share * spread))).otherwise(cut)
    h = F.xxhash64("doc_id")
    thin = rows.where(F.pmod(h, F.lit(spread)) < cut).select("lang", "text", h.alias("h"), "doc_id")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(spread)), "h", "doc_id", "text"))
    sample = materialize(thin.withColumn("nth", nth).where(F.col("nth") <= sample_docs), "sample")
    half = dict_bytes // 2
    texts = sample.where(F.col("nth") <= 2 + 4 * half // text_chars)
    parts: dict[str, list[str]] = {lang: [] for lang in counts}
    at = 1 + F.pmod(F.hash("doc_id"), F.greatest(F.lit(1), F.length("text") - text_chars + 1))
    for r in texts.select("lang", F.substr("text", at, F.lit(text_chars)).alias("part"), "nth").orderBy("lang", "nth").collect():
        parts[r["lang"]].append(r["part"].lower())
    words = sample.select("lang", F.explode(F.array_distinct(F.split(F.lower("text"), "[\\x20\\t-\\r]+"))).alias("word"))
    common = words.where("word <> ''").groupBy("lang", "word").count()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    top = common.where(F.length("word") <= word_chars).withColumn("place", place).where(F.col("place") <= half // 3)
    vocabulary: dict[str, list[str]] = {lang: [] for lang in counts}
    for r in top.orderBy("lang", "place").select("lang", "word").collect():
        vocabulary[r["lang"]].append(r["word"])
    out = {}
    for lang in sorted(counts):
        text, n, chosen = " ".join(parts[lang]).encode()[:half], 0, []
        for word in vocabulary[lang]:
            n += len(word.encode()) + 1
            if n > half:
                break
            chosen.append(word)
        out[lang] = text + b" " + " ".join(reversed(chosen)).encode() + b" "
    return out


class Classifier:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        params = zstd.ZstdCompressionParameters(
            window_log=18, hash_log=15, chain_log=15, search_log=3, min_match=3, strategy=zstd.STRATEGY_BTOPT, write_content_size=False
        )
        self.langs = list(dictionaries)
        self.compressors = []
        for data in dictionaries.values():
            known = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=params)
            self.compressors.append(zstd.ZstdCompressor(dict_data=known, compression_params=params))

    def sizes(self, text: str) -> list[int]:
        """Bytes for the whole text, block by block, so that a long text can't be its own dictionary."""
        raw = text.lower().encode()
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the margin to the next one as a share of the latter's size; the first by name in a tie."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        sizes = self.sizes(text)
        order = np.argsort(sizes, kind="stable")
        best, second = sizes[order[0]], sizes[order[min(1, len(order) - 1)]]
        return self.langs[order[0]], (second - best) / second if len(order) > 1 else 1.0


def classify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.001) -> DataFrame:
    """Adds lang_pred, score (the margin, 0 to 1) and rejected to docs; a column of one of these names is replaced.

    rejected: no letter, a null text, or a margin below ``min_margin``. lang_pred is ``und`` if text is null or has no
    letter. Nothing but the text is looked at. No rows give no rows.
    """
    taken = {"lang_pred", "score", "rejected"}
    kept = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() not in taken))
    at = kept.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column(at)]
            lang, score = [f[0] for f in found], [f[1] for f in found]
            no = [a == UNKNOWN or b < min_margin for a, b in found]
            cols = [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(no, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "lang_pred", "score", "rejected"])

    schema = kept.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(False)}).schema
    return kept.mapInArrow(run, schema)
