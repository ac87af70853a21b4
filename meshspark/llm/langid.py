"""Language identification by compression with per-language zstandard raw-content dictionaries.

Every whole text, lower-cased, is compressed once with each language's dictionary, at one level whatever
its length; it belongs to the language whose dictionary makes it smallest.  Equal sizes are told apart
by compression too: the text's words are compressed one by one, and the smallest sum among the
tied languages wins.  The prediction is marked rejected where the runner-up comes within ``margin``
of the best, relative to the size.

What is learnt is bounded: at most ``SAMPLE_DOCS`` texts a language, those with the smallest hash of
id and text, and ``DICT_BYTES`` characters of them.  Texts of any length are sampled: each gives its
beginning, at least ``SLICE`` characters, more where there are fewer texts.  So a language whose texts
are all long is learnt like any other.  Candidates are cut down by a hash threshold before the window that ranks
them, and equal rows count once, so that a language with most of the rows doesn't gather in one task.

Defined edge cases: null texts and texts without a letter (Unicode category L) get ``und`` and score
0; where no training row exists every text gets ``und``; empty texts and texts without a language teach
nothing; languages that are equal in sizes and in sums of words go by name; repeated rows agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

SAMPLE_DOCS, SLICE, DICT_BYTES, LEVEL = 256, 2_048, 262_144, 12
LETTER = regex.compile(r"\p{L}")


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary content by language from rows of ``docs`` (doc_id, text, lang) with non-null lang."""
    h = F.xxhash64("doc_id", "text")
    rows = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select("lang", "text", h.alias("_h"))
    # A row a language.  Four times the sample is expected below the threshold; the smallest hash always is.
    share = F.least(F.lit(1.0), F.lit(4.0 * SAMPLE_DOCS) / F.count(F.lit(1)))
    seen = rows.groupBy("lang").agg(F.greatest(F.min("_h").cast("double"), (2 * share - 1) * float(1 << 63)).alias("_most"))
    few = rows.join(F.broadcast(seen.select(F.col("lang").alias("_l"), "_most")), (F.col("lang") == F.col("_l")) & (F.col("_h").cast("double") <= F.col("_most")))
    few = few.groupBy("lang", "_h").agg(F.min(F.substring("text", 1, DICT_BYTES)).alias("_text"))
    first = Window.partitionBy("lang").orderBy("_h")
    pick = few.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= SAMPLE_DOCS)
    many = F.count(F.lit(1)).over(Window.partitionBy("lang"))
    slice_ = F.greatest(F.lit(SLICE), F.ceil(F.lit(DICT_BYTES) / many)).cast("int")
    got = pick.select("lang", "_n", F.col("_text").substr(F.lit(1), slice_).alias("_text")).collect()  # at most SAMPLE_DOCS slices a language
    out: dict[str, str] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["_n"])):
        out[r["lang"]] = (out.get(r["lang"], "") + " " + r["_text"].lower())[:DICT_BYTES]
    return {k: f"{v} ".encode("utf-8", "replace") for k, v in out.items()}


class Identifier:
    """A compressor for each language; built once per task."""

    def __init__(self, content: dict[str, bytes], margin: float = 0.01):
        self.langs, self.margin, self.made = sorted(content), margin, []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.made.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        """Compressed size of the lower-cased text, framed by spaces, with each language's dictionary."""
        raw = f" {text.lower()} ".encode("utf-8", "replace")
        return [len(c.compress(raw)) for c in self.made]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score in [0, 1] and whether the margin was too narrow to trust."""
        if not self.langs or text is None or not LETTER.search(text):
            return "und", 0.0, True
        sizes = self.sizes(text)
        if len(sizes) == 1:
            return self.langs[0], 1.0, False
        best, second = sorted(sizes)[:2]
        at = sizes.index(best)
        if second == best:
            words = [f" {w} ".encode("utf-8", "replace") for w in text.lower().split()]
            at = min((i for i, s in enumerate(sizes) if s == best), key=lambda i: (sum(len(self.made[i].compress(w)) for w in words), i))
        gap = second - best
        return self.langs[at], 1.0 - 0.5 ** (1 + gap), gap < max(1.0, self.margin * second)


def identify(docs: DataFrame, content: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every whole text of ``docs``."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(content)  # at most DICT_BYTES characters a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Identifier(shipped.value)
        for b in slices(batches):
            got = [of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
