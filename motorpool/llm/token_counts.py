"""Token counts kept in a cache by content and tokenizer.

The cache is a Parquet table of (content digest, tokenizer digest, token count). Texts are looked up by digest; only
texts no row of the cache covers are encoded, each distinct one once, and their counts are appended.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorpool.llm.common import claim, keeps, stretches, text_or_empty, written
from motorpool.llm.pretokens import Unknown, pretokens

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"
# Digests broadcast at most: 32 bytes each, 32 MB in all. More are joined by shuffling.
BROADCAST_DIGESTS = 1_000_000
# Words a worker remembers before it starts anew.
WORDS = 400_000


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer file: another version of a tokenizer never meets the counts of this one."""
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


class WordCounter:
    """Counts tokens with the tokenizers library, asking it once for each distinct word.

    Words are encoded by the library a few thousand at a time, as one text whose words it reports back; special strings
    inside a text are one token each, as is the library's default.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.counts: dict[str, int] = {}

    def _whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _learn(self, words: list[str]) -> None:
        """Letters after a blank keep their borders when joined; all other words are encoded one by one."""
        joined = [w for w in words if w[0] == " " and w[1:].isalpha()]
        for i in range(0, len(joined), 5000):
            part = joined[i : i + 5000]
            encoding = self.tokenizer.encode("".join(part), add_special_tokens=False)
            sizes = [0] * len(part)
            place = encoding.word_ids
            if place and place[-1] == len(part) - 1:
                for w in place:
                    sizes[w] += 1
                self.counts.update(zip(part, sizes))
        left = [w for w in words if w not in self.counts]
        for w, e in zip(left, self.tokenizer.encode_batch(left, add_special_tokens=False)):
            self.counts[w] = len(e.ids)

    def count_all(self, texts: list[str]) -> list[int]:
        cut: list[list[str] | None] = []
        for t in texts:
            try:
                cut.append(None if any(s in t for s in self.special) else pretokens(t))
            except Unknown:
                cut.append(None)
        if len(self.counts) > WORDS:
            self.counts.clear()  # before asking what is missing: all words of these texts have to be known below
        missing = {w for words in cut if words for w in words}.difference(self.counts)
        if missing:
            self._learn(list(missing))
        get = self.counts.__getitem__
        return [self._whole(t) if words is None else sum(map(get, words)) for t, words in zip(texts, cut)]


class PieceCounter:
    """Counts the pieces of a sentencepiece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)

    def count_all(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.processor.encode(texts, num_threads=1)]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> WordCounter | PieceCounter:
    """One counter for each file and worker process. Byte-level files are cut into words, others encoded whole."""
    if path.endswith(".model"):
        return PieceCounter(path)
    from motorpool.llm.bpe import encoder

    try:
        encoder.__wrapped__(path)  # refuses files whose words cannot be cut beforehand
    except (ValueError, KeyError):
        return _WholeTexts(path)
    return WordCounter(path)


keeps(__name__, counter.cache_clear)


class _WholeTexts(WordCounter):
    def count_all(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache; empty if nothing was stored there yet. Asks Spark, so that any file system will do."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        of = counter(path)
        seen: set[bytes] = set()
        for batch in stretches(batches):
            digests, texts = batch.column(0).to_pylist(), batch.column(1)
            fresh = [i for i, d in enumerate(digests) if not (d in seen or seen.add(d))]
            counts = of.count_all([texts[i].as_py() for i in fresh])
            yield pa.RecordBatch.from_arrays(
                [pa.array([digests[i] for i in fresh], pa.binary()), pa.array(counts, pa.int64())], ["content", "n_tokens"]
            )

    return run


def fill_cache(docs: DataFrame, tokenizer_path: str, cache_path: str, *, key: str, text: str, version: str) -> int:
    """Encode the distinct texts the cache lacks and append their counts; returns how many there were.

    A missing digest is paired with the smallest key that has the text, and rows are dealt by digest and key, so that
    copies of one text do not meet in one task and only one of them is encoded.
    """
    spark = docs.sparkSession
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("content")
    whole = text_or_empty(text)
    content = F.unhex(F.sha2(whole, 256))
    wanted = docs.select(content.alias("content"), F.col(key).alias("holder")).groupBy("content").agg(F.min("holder").alias("holder"))
    missing = written(wanted.join(known, "content", "left_anti"), "missing")
    n = missing.count()
    if not n:
        return 0
    side = F.broadcast(missing) if n <= BROADCAST_DIGESTS else missing
    rows = docs.select(content.alias("content"), whole.alias("text"), F.col(key).alias("own"))
    picked = rows.join(
        side.withColumnRenamed("content", "c"), (F.col("content") == F.col("c")) & F.col("own").eqNullSafe(F.col("holder")), "left_semi"
    ).select("content", "text")
    counted = picked.mapInArrow(_encode(tokenizer_path), "content binary, n_tokens long").dropDuplicates(["content"])
    counted.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    return n


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    *,
    limit: int = 512,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every row, through the cache at ``cache_path``.

    Content is normalised as the tokenizer does before it cuts, which for byte-level files is not at all, so that equal
    digests always mean equal counts. Null texts count as empty (0 bytes, 0 tokens). Repeated rows, equal keys with
    unequal texts and null keys are all kept and counted. An empty table gives no rows and leaves the cache as it was.
    """
    version = tokenizer_digest(tokenizer_path)
    fill_cache(docs, tokenizer_path, cache_path, key=key, text=text, version=version)
    whole = text_or_empty(text)
    rows = docs.select(F.col(key), F.unhex(F.sha2(whole, 256)).alias("content"), F.octet_length(whole).cast("long").alias("n_bytes"))
    stored = read_cache(docs.sparkSession, cache_path).where(F.col("tokenizer") == version)
    counts = stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(counts, "content", "left").select(
        key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
