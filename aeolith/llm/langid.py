"""Language identification by compression.

A text is encoded with each language's zstandard dictionary of raw content; the smallest frame names the language.
Narrow margins are rejected. Dictionaries are made of a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeolith.llm.common import sampled, small_batches

#: Labelled rows a language that are looked at, those with the least hash of doc_id; bytes of a dictionary; the share of it that one text may fill.
SAMPLE_ROWS, DICT_BYTES, TEXT_SHARE = 300, 128 * 1024, 8
#: A text is encoded twice in one frame: where it saves too little, as a few words do, a frame stays raw and tells nothing; a repeat always saves.
LEVEL, TIMES = 6, 2
#: The second smallest frame must be larger by this share and by this many bytes.
MIN_MARGIN, MIN_BYTES = 0.001, 1
UNDETERMINED = "und"
_OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """Lower-cased words with single blanks between: marks, figures and capitals tell little of a language."""
    return _OTHER.sub(" ", text.lower()).encode()


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """Dictionaries from labelled (doc_id, text, lang). Rows without text or lang teach nothing.

    Of the sampled rows of a language, in the order of their hashes, whole texts fill its dictionary: first those that
    take a TEXT_SHARE-th of it at most, then longer ones; the last is cut where the dictionary ends. Only texts that
    reach it come to the driver, so what it holds is bounded by languages times DICT_BYTES and one text each.
    """
    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang", F.octet_length("text").alias("size"))
    long = (F.col("size") > DICT_BYTES // TEXT_SHARE).alias("long")
    order = Window.partitionBy("lang").orderBy("long", "rank")
    picked = sampled(known, "lang", rows).select("*", long).withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    picked = picked.where(F.col("before") < DICT_BYTES).select("doc_id", "lang", "long", "rank").dropDuplicates(["doc_id", "lang"])
    texts = labelled.where("text IS NOT NULL").select("doc_id", "lang", F.substring("text", 1, DICT_BYTES).alias("text")).join(F.broadcast(picked), ["doc_id", "lang"])
    found: dict[str, list[tuple]] = {}
    for r in texts.collect():
        found.setdefault(r.lang, []).append((r.long, r["rank"], r.text))
    dicts = {}
    for lang, own in sorted(found.items()):
        data = b"\n".join(plain(t) for _, _, t in sorted(own))[:DICT_BYTES]
        if len(data) >= 8:  # zstandard's least
            dicts[lang] = data
    return dicts


class Classifier:
    """Compressors for each language; made once in each Python worker."""

    def __init__(self, dicts: dict[str, bytes], level: int = LEVEL):
        import zstandard as zstd

        def tool(data: bytes) -> zstd.ZstdCompressor:
            d = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            return zstd.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False)

        self.langs = list(dicts)
        self.tools = [tool(data) for data in dicts.values()]

    def sizes(self, text: str) -> list[int]:
        data = (b" " + plain(text)) * TIMES
        return [len(t.compress(data)) for t in self.tools]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (share of its code among all languages' codes), and whether the margin is too narrow."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        ranked = sorted(zip(self.sizes(text), self.langs, strict=True))
        best = ranked[0][0]
        score = 1 / sum(2.0 ** -min(2.0 * (s - best), 1000) for s, _ in ranked)
        margin = ranked[1][0] - best if len(ranked) > 1 else best
        return ranked[0][1], score, margin < max(MIN_BYTES, MIN_MARGIN * best)


def identify(docs: DataFrame, dicts: dict[str, bytes], columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns and lang_pred, score, rejected, from whole texts.

    All texts, short or very long, are encoded by one rule. A null text or one without a letter is ``und`` with score 0 and rejected; so is any text if no language was learned.
    Equal sizes go to the language that sorts first. An empty table gives no rows. Only the named columns and text are read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dicts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Classifier(shared.value)
        for b in batches:
            got = [tool.predict(t.as_py()) for t in b.column(b.schema.get_field_index("_text"))]
            lang, score, rejected = zip(*got, strict=True) if got else ((), (), ())
            kept = [b.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*columns, "lang_pred", "score", "rejected"])

    d = docs.select(*columns, F.col("text").alias("_text"))
    schema = ", ".join(f"`{c}` {k}" for c, k in d.dtypes[:-1]) + ", lang_pred string, score double, rejected boolean"
    return d.mapInArrow(run, schema)
