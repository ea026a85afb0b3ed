"""Token budget per slice (problem 1).

A ledger holds the token count of every content under every tokenizer, keyed by the hash of the content and the
hash of the tokenizer. Only contents the ledger hasn't seen are encoded. Totals per slice are kept as cubes that
are brought up to date by signed deltas: a removed or changed text takes its tokens out of its old slice.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.session import folder_exists, list_folder, shared_folder, small_enough, staged

# Fixed value: the pattern by which the byte-level vocabularies cut a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_FILE = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
_ENCODERS: dict = {}


@dataclass(frozen=True)
class TokenizerFile:
    """A vocabulary file and the library that reads it: tiktoken, tokenizers or sentencepiece."""

    path: str = DEFAULT_FILE
    library: str = "tiktoken"
    pattern: str = PIECES

    def content(self) -> bytes:
        with open(self.path, "rb") as f:
            return f.read()

    def digest(self) -> str:
        return hashlib.sha256(b"\0".join([self.library.encode(), self.pattern.encode(), self.content()])).hexdigest()


def _counter(library: str, pattern: str, content: bytes, digest: str):
    """Function from texts to token counts; made once in a worker."""
    if digest in _ENCODERS:
        return _ENCODERS[digest]
    if library == "tiktoken":
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        enc = tiktoken.Encoding(digest, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        count = lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    elif library == "tokenizers":
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(content.decode())
        tok.encode_special_tokens = True
        count = lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    else:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=content)
        count = lambda texts: [len(e) for e in sp.encode(texts, num_threads=1)]
    _ENCODERS[digest] = count
    return count


def counted(df: DataFrame, text: str, tokenizer: TokenizerFile = TokenizerFile()) -> DataFrame:
    """The other columns of df and `tokens`, the number of tokens of the column `text` (null for a null text).

    The text itself is not passed on. Equal texts of a batch are encoded once.
    """
    digest = tokenizer.digest()
    held = df.sparkSession.sparkContext.broadcast((tokenizer.library, tokenizer.pattern, tokenizer.content(), digest))
    rest = [c for c in df.columns if c != text]

    def run(batches):
        count = _counter(*held.value)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).dictionary_encode()
            each = pa.array(count(texts.dictionary.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in rest] + [each.take(texts.indices)], names=[*rest, "tokens"])

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema if f.name != text] + [T.StructField("tokens", T.LongType(), True)])
    return df.mapInArrow(run, schema)


def content_hash(text: str):
    return F.sha2(F.encode(F.col(text), "utf-8"), 256)


def extend_ledger(df: DataFrame, text: str, ledger: DataFrame | None = None, tokenizer: TokenizerFile = TokenizerFile()) -> DataFrame:
    """New ledger rows (content, tokenizer, tokens) for the contents of df that the ledger doesn't hold under this tokenizer.

    Copies are brought together by the hash of their content, where a hot content has been reduced to one row a partition
    before the shuffle, and each content is encoded once. With a ledger, the hashes alone are compared first, and only unseen
    texts move. Null texts have no content and no row.
    """
    src = df.select(F.col(f"`{text}`").cast("string").alias("text")).where("text is not null").withColumn("content", content_hash("text"))
    if ledger is not None:
        seen = ledger.where(F.col("tokenizer") == tokenizer.digest()).select("content")
        unseen = src.select("content").distinct().join(seen, "content", "left_anti")
        unseen = staged(unseen, "unseen")
        src = src.join(F.broadcast(unseen) if small_enough(unseen, 20_000) else unseen, "content", "left_semi")
    rows = counted(src.groupBy("content").agg(F.first("text").alias("text")), "text", tokenizer)
    return rows.select("content", F.lit(tokenizer.digest()).alias("tokenizer"), "tokens")


class Ledger:
    """The ledger kept as a table under a folder from run to run. Every run adds a part of its own, which counts once it is finished.

    A content that two runs added at the same time stands there twice with the same count, so rows() makes it one.
    """

    _SCHEMA = "content string, tokenizer string, tokens long"

    def __init__(self, spark: SparkSession, path: str, tokenizer: TokenizerFile = TokenizerFile()):
        self.spark, self.path, self.tokenizer = spark, path.rstrip("/"), tokenizer

    def rows(self) -> DataFrame:
        parts = [f"{self.path}/{f}" for f in list_folder(self.spark, self.path)]
        parts = [p for p in parts if folder_exists(self.spark, f"{p}/_SUCCESS")]
        if not parts:
            return self.spark.createDataFrame([], self._SCHEMA)
        return self.spark.read.schema(self._SCHEMA).parquet(*parts).dropDuplicates(["content", "tokenizer"])

    def extend(self, df: DataFrame, text: str) -> DataFrame:
        """Add what df has that the ledger hasn't, and return the ledger."""
        known = self.rows() if list_folder(self.spark, self.path) else None
        extend_ledger(df, text, known, self.tokenizer).write.parquet(f"{self.path}/part-{uuid.uuid4().hex}")
        return self.rows()


def empty_cube(spark: SparkSession, slices: list[str]) -> DataFrame:
    return spark.createDataFrame([], ", ".join([*(f"`{s}` string" for s in slices), "texts long", "tokens long"]))


def signed_deltas(before: DataFrame | None, after: DataFrame, key: str, slices: list[str], ledger: DataFrame, tokenizer: TokenizerFile) -> DataFrame:
    """Changes of the cube between two states of a table; both have key, content (null for a null text) and the slices.

    An unchanged row gives nothing, a new one +1, a removed one -1, a changed content or slice one of each.
    """
    columns = [F.col(f"`{key}`").cast("string").alias("__key"), F.col("content"), *[F.col(f"`{s}`").cast("string").alias(s) for s in slices]]
    new = after.select(*columns, F.lit(1).alias("sign"))
    both = new if before is None else new.unionByName(before.select(*columns, F.lit(-1).alias("sign")))
    changed = both.groupBy("__key", "content", *slices).agg(F.sum("sign").alias("sign")).where("sign <> 0")
    counts = ledger.where(F.col("tokenizer") == tokenizer.digest()).select("content", "tokens")
    joined = changed.join(counts, "content", "left")
    return joined.groupBy(*slices).agg(F.sum("sign").alias("texts"), F.sum(F.col("sign") * F.coalesce("tokens", F.lit(0))).alias("tokens"))


def apply_deltas(cube: DataFrame, deltas: DataFrame, slices: list[str]) -> DataFrame:
    """The cube after the deltas; slices left without texts are dropped. Null slice values form slices of their own."""
    both = cube.select(*slices, "texts", "tokens").unionByName(deltas.select(*slices, "texts", "tokens"))
    return both.groupBy(*slices).agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens")).where("texts <> 0")


def state(df: DataFrame, key: str, text: str, slices: list[str]) -> DataFrame:
    """One row per key with the content hash and the slices; a key stored twice counts once. Rows without a key are left out."""
    rows = df.where(F.col(f"`{key}`").isNotNull()).withColumn("content", content_hash(f"`{text}`"))
    return rows.select(f"`{key}`", "content", *[f"`{s}`" for s in slices]).dropDuplicates([key])


def budget(df: DataFrame, key: str, text: str, slices: list[str], tokenizer: TokenizerFile = TokenizerFile(), ledger: Ledger | None = None) -> DataFrame:
    """The cube of a table from nothing: slices, texts (rows with a key; a null text counts with 0 tokens), tokens.

    ledger: the one to read and extend; by default a new one.
    """
    if ledger is None:
        ledger = Ledger(df.sparkSession, f"{shared_folder(df.sparkSession)}/ledger-{uuid.uuid4().hex}", tokenizer)
    deltas = signed_deltas(None, state(df, key, text, slices), key, slices, ledger.extend(df, text), tokenizer)
    return apply_deltas(empty_cube(df.sparkSession, slices), deltas, slices)


def text_tokens(df: DataFrame, key: str, text: str, tokenizer: TokenizerFile = TokenizerFile()) -> DataFrame:
    """row_key, tokens of every text that isn't null; a key stored twice counts once."""
    src = df.select(F.col(f"`{key}`").cast("string").alias("row_key"), F.col(f"`{text}`").cast("string").alias("text"))
    return counted(src.where("row_key is not null and text is not null"), "text", tokenizer).dropDuplicates(["row_key"])
