"""Token ids of a whole corpus by a byte-level BPE vocabulary, through a table of distinct words.

Texts are split into words by the vocabulary's pattern inside Spark.  A word's ids
depend on the word alone, so each distinct word of the corpus is encoded once.  The
ids come back by position: texts are put in blocks of bounded size, a block names
its distinct words once, and inside a block each word position takes the ids of its
word.  Joining blocks and not positions keeps the most frequent words from being a
hot key: a word is at most once in a block.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvern.session import Stage

#: Fixed value: the vocabulary's word pattern, with blanks, letters and digits as in Unicode.
WORDS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that the JVM's Unicode tables don't know; texts with these are encoded whole.
UNKNOWN = r"\p{Cn}"
BLOCK_BITS = 21  # a block holds at most 2 ** (BLOCK_BITS + 1) characters, or one text


def _load(vocabulary: str):
    from tokenizers import Tokenizer  # here, so that without it the rest of the subpackage works

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.encode_special_tokens = True  # their spellings in a text are ordinary text
    return tokenizer


def _encoder(spark, path: str):
    """A function from texts to an array of id lists.  The vocabulary, a file of fixed size, goes to each executor once."""
    shipped = spark.sparkContext.broadcast(Path(path).read_text())

    def encode(texts: list[str], tokenizer) -> pa.Array:
        found = tokenizer.encode_batch(texts, add_special_tokens=False)
        return pa.array([x.ids for x in found], pa.list_(pa.int32()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _load(shipped.value)
        for batch in batches:
            ids = encode(batch.column(1).to_pylist(), tokenizer)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[batch.schema.names[0], "ids"])

    return each


def _blocks(texts: DataFrame, key: str) -> DataFrame:
    """``(key, words, block)``.  Texts of one length class that stand near each other share a block.

    In class c texts have 2 ** c to 2 ** (c + 1) characters and a block spans
    2 ** (BLOCK_BITS - c) rows of a partition, so its size is bounded for any mix of lengths.
    """
    row = F.monotonically_increasing_id()
    kind = F.floor(F.log2(F.greatest(F.length("text"), F.lit(1)))).cast("int")
    near = F.shiftleft(F.call_function("shiftright", row, F.greatest(F.lit(0), F.lit(BLOCK_BITS) - kind)), 6)
    return texts.select(
        key, F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)).alias("words"), (near + F.least(kind, F.lit(63))).alias("block")
    )


def _by_position(texts: pa.Table, entries: pa.Table) -> pa.Table:
    """A block's texts with ids: every word position takes the ids of its word."""
    words = texts["words"].combine_chunks()
    flat, lengths = words.flatten(), words.value_lengths().to_numpy(zero_copy_only=False)
    known, ids = entries["word"].combine_chunks(), entries["ids"].combine_chunks()
    at = pc.index_in(flat, value_set=known)
    if at.null_count:
        raise ValueError("a word of the block has no ids")
    taken = ids.take(at)
    ends = np.concatenate([[0], np.cumsum(taken.value_lengths().to_numpy(zero_copy_only=False))])
    offsets = ends[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int32)
    out = pa.ListArray.from_arrays(pa.array(offsets), taken.flatten().cast(pa.int32()))
    return pa.table([texts.column(0), out], names=[texts.schema.names[0], "ids"])


def encode_corpus(documents: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """``(key, ids)``, a row per row of ``documents``; ``vocabulary`` is the tokenizer's file.

    An empty or null ``text`` gives an empty list.  Texts stay whole, however long;
    repeated texts and keys each give their row; other columns are not read.  Runs
    jobs: the split texts are written to the shared folder, since their blocks must
    not change between the two passes over them.
    """
    spark = documents.sparkSession
    stage = Stage(spark, "tokens")
    encode = _encoder(spark, vocabulary)
    texts = documents.select(key, F.coalesce("text", F.lit("")).alias("text"))
    strange = F.col("text").rlike(UNKNOWN)
    whole = texts.where(strange).mapInArrow(encode, f"{key} {dict(texts.dtypes)[key]}, ids array<int>")

    split = stage.write(_blocks(texts.where(~strange), key), "words")
    again = stage.read(["words"], split)  # a second reading, else the plan takes both sides for one
    pairs = again.select("block", F.explode("words").alias("word")).distinct()
    words = pairs.select("word").distinct().select("word", F.col("word").alias("text"))
    table = words.mapInArrow(encode, "word string, ids array<int>")
    entries = pairs.join(table, "word")
    schema = f"{key} {dict(texts.dtypes)[key]}, ids array<int>"
    joined = split.groupBy("block").cogroup(entries.groupBy("block")).applyInArrow(_only(_by_position, key), schema)
    return joined.unionByName(whole)


def _only(function, key: str):
    def call(left: pa.Table, right: pa.Table) -> pa.Table:
        return function(left.select([key, "words"]), right)

    return call


def piece_table(spark, vocabulary: str) -> DataFrame:
    """``(id, piece)``: the bytes of each id, in hexadecimal; as many rows as the vocabulary has."""
    pieces = json.loads(Path(vocabulary).read_text())["model"]["vocab"]
    back = {shown: byte for byte, shown in enumerate(_alphabet())}
    rows = [(i, bytes(back[x] for x in piece).hex()) for piece, i in pieces.items()]
    return spark.createDataFrame(rows, "id int, piece string")


def _alphabet() -> list[str]:
    """The character that stands for each byte: itself where it is visible, else the next one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


def decode_corpus(encoded: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """``(key, text)`` from ``(key, ids)``, by a join of positions with the id-to-piece table.

    The table has a fixed number of rows, so it is broadcast.  ``key`` must be
    unique; empty and null lists give an empty text.
    """
    pieces = piece_table(encoded.sparkSession, vocabulary)
    at = encoded.select(key, F.posexplode_outer("ids").alias("pos", "id"))
    spelt = at.join(F.broadcast(pieces), "id", "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "piece"))))
    text = F.decode(F.unhex(F.array_join(F.transform(parts, lambda x: x["piece"]), "")), "UTF-8")
    return spelt.groupBy(key).agg(text.alias("text"))
