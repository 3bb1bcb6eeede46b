"""Evaluation passages inside training texts, by rare n-gram seeds and Smith-Waterman alignment.

Every passage of an item of ``MIN_WORDS`` words holds seeds: n-grams that few items
share, and the rarest n-gram of each stretch even where that one is shared.  Seeds
join the n-grams of all texts; the hits of a text with an item mark windows of the
text, and an alignment of words scores each window.  Only the items are ever
gathered; texts that no seed hits are read once and sent nowhere.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvern.session import Stage

GRAM = 5  # words in a seed
RARE = 3  # items that may share a seed
MIN_WORDS = 15  # shortest passage that counts
#: An alignment gives 1 for a word that is the same, -1 for one that differs or is missing.
MIN_SCORE, MIN_IDENTITY = 12, 0.81
TILE = 256  # words; hits of one tile of a text share a window
PAIRS = 64  # windows aligned together
BROADCAST_BYTES = 64 << 20  # size up to which a side of a join is broadcast
SEED_BYTES, WINDOW_BYTES = 24, 40  # of a row


def _plain_letters() -> tuple[str, str]:
    """Characters that stand for one ASCII letter or digit with marks or in another width, and what they stand for."""
    pairs = {"ø": "o", "đ": "d", "ł": "l", "ı": "i", "ð": "d"}
    for code in range(0xA0, 0xFFFF):
        base = unicodedata.normalize("NFKD", chr(code).lower())[:2]
        if base and base[0].isascii() and base[0].isalnum() and (len(base) == 1 or unicodedata.combining(base[1])):
            pairs[chr(code)] = base[0]
    return "".join(pairs), "".join(pairs.values())


def _fold(word: Column) -> Column:
    plain = F.translate(F.regexp_replace(word, f"[{_MARKS}]", ""), *_PLAIN)
    for char, spelt in (("æ", "ae"), ("œ", "oe"), ("ß", "ss"), ("þ", "th")):
        plain = F.replace(plain, F.lit(char), F.lit(spelt))
    return plain


_PLAIN = _plain_letters()
_MARKS = r"\p{M}\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}"


def plain_words(text: Column) -> Column:
    """Lower-case words without marks: spelling variants of one wording give the same words.

    Markup tags part words, combining marks and invisible characters don't.  Only
    words with other than ASCII characters are folded, since folding is dear.
    """
    bare = F.lower(F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, r"<[^<>]{1,200}>", " ")).otherwise(text))
    words = F.regexp_extract_all(bare, F.lit(rf"[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}{_MARKS}]*"), F.lit(0))
    return F.transform(words, lambda w: F.when(F.octet_length(w) == F.char_length(w), w).otherwise(_fold(w)))


def _grams(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``(keep..., pos, gram)``: hashes of the n-grams of ``words``; none where there are fewer words."""
    hashed = rows.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))  # no filter: it would split the text twice
    parts = ", ".join(f"h[i + {k}]" for k in range(GRAM))
    each = f"transform(sequence(0, size(h) - {GRAM}), i -> struct(i AS pos, xxhash64({parts}) AS gram))"
    return hashed.selectExpr(*keep, f"inline(CASE WHEN size(h) >= {GRAM} THEN {each} END)")


def seeds(items: DataFrame) -> DataFrame:
    """``(gram, item_id, at)`` of items ``(item_id, words)``.

    A seed is an n-gram in at most ``RARE`` items, or the one of fewest items in a
    stretch of ``MIN_WORDS`` words: so no passage is without a seed.
    """
    grams = _grams(items, ["item_id"])
    shared = grams.groupBy("gram").agg(F.count_distinct("item_id").alias("shared"))
    counted = grams.join(shared, "gram")
    stretch = f"OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {MIN_WORDS - GRAM} FOLLOWING)"
    marked = counted.selectExpr("item_id", "pos", "gram", "shared", f"min(struct(shared, pos)) {stretch}.pos AS rarest")
    rare = marked.where(F.col("shared") <= RARE).select("item_id", F.col("pos").alias("at"), "gram")
    lowest = marked.select("item_id", F.col("rarest").alias("at")).distinct()
    chosen = lowest.join(marked.select("item_id", F.col("pos").alias("at"), "gram"), ["item_id", "at"])
    return rare.unionByName(chosen).distinct()


def align(texts: list[list[str]], items: list[list[str]]) -> list[tuple[int, int]]:
    """For each pair of word lists the best local alignment: its score and its number of equal words.

    All pairs go together, row by row; gaps along a row are a running maximum.
    Equal words carry a tiny extra, from which their number is read off the best score.
    """
    tiny = 2.0**-20
    wide, high = max(map(len, items)), max(map(len, texts))
    columns = np.full((len(items), wide), -1)
    rows = np.full((len(items), high), -2)
    for k, (text, item) in enumerate(zip(texts, items, strict=True)):
        codes = {w: c for c, w in enumerate(dict.fromkeys(item))}
        columns[k, : len(item)] = [codes[w] for w in item]
        rows[k, : len(text)] = [codes.get(w, -2) for w in text]
    step = np.arange(wide + 1)
    best, above = np.zeros(len(items)), np.zeros((len(items), wide + 1))
    row = np.zeros((len(items), wide + 1))
    for at in range(high):
        same = np.where(columns == rows[:, at : at + 1], 1 + tiny, -1.0)
        row[:, 1:] = np.maximum(np.maximum(above[:, :-1] + same, above[:, 1:] - 1), 0.0)
        above = np.maximum.accumulate(row + step, axis=1) - step
        best = np.maximum(best, above.max(axis=1))
    scores = np.rint(best)
    return [(int(s), round((b - s) / tiny)) for s, b in zip(scores, best, strict=True)]


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        windows, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        order = sorted(range(len(windows)), key=lambda k: len(windows[k]))  # pairs of like length go together
        found = [(0, 0)] * len(order)
        for start in range(0, len(order), PAIRS):
            some = order[start : start + PAIRS]
            for k, result in zip(some, align([windows[k] for k in some], [items[k] for k in some]), strict=True):
                found[k] = result
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([s for s, _ in found], pa.int32()), pa.array([e for _, e in found], pa.int32())],
            names=["doc_id", "item_id", "score", "equal"],
        )


def _sized(side: DataFrame, size: int) -> DataFrame:
    """A side of a join: broadcast below a checked size in bytes, else as the optimizer sees fit."""
    return F.broadcast(side) if size <= BROADCAST_BYTES else side


def leak_scores(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, score, equal)`` of every window of a text that a seed hits.

    Null and empty texts, and texts or items shorter than a seed, give no rows; other
    columns are not read; repeated texts each give their rows.  Runs jobs: seeds and
    candidate windows are counted before they are joined.
    """
    stage = Stage(documents.sparkSession, "leaks")
    words = items.select("item_id", plain_words(F.col("text")).alias("words"))
    seed = stage.write(seeds(words), "seeds")
    texts = documents.select("doc_id", plain_words(F.col("text")).alias("words"))
    hits = _grams(texts, ["doc_id"]).join(_sized(seed, seed.count() * SEED_BYTES), "gram")
    windows = hits.groupBy("doc_id", "item_id", F.floor(F.col("pos") / TILE).alias("tile")).agg(
        F.min(F.col("pos") - F.col("at")).alias("low"), F.max(F.col("pos") - F.col("at")).alias("high")
    )
    found = stage.write(windows, "windows")
    # the texts hit are split into words again; the join comes first, so that no other text is
    texts_hit = documents.select("doc_id", "text").join(_sized(found, found.count() * WINDOW_BYTES), "doc_id")
    texts_hit = texts_hit.withColumn("words", plain_words(F.col("text"))).drop("text")
    item_words = words.select("item_id", F.col("words").alias("item"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    full = texts_hit.join(_sized(item_words, 4 * size), "item_id")  # words take about four times the text
    # low and high are where the item would begin in the text, by its hits.  Each word too many costs one and each equal
    # one gives one, so no alignment gains by reaching farther than the item's own number of words beyond these
    low = F.greatest(F.lit(0), F.col("low") - F.size("item"))
    window = F.slice("words", low + 1, F.col("high") - low + 2 * F.size("item"))
    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, score int, equal int"
    return full.select("doc_id", "item_id", window.alias("window"), "item").mapInArrow(_score, schema)


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, score, identity)``: texts that hold a passage of an item, word for word or lightly altered."""
    differing = F.col("equal") - F.col("score")
    identity = F.col("equal") / F.greatest(F.lit(1), F.col("equal") + differing)
    scored = leak_scores(documents, items).withColumn("identity", identity)
    passed = scored.where((F.col("score") >= MIN_SCORE) & (F.col("identity") >= MIN_IDENTITY))
    best = F.max(F.struct("score", "identity")).alias("best")
    return passed.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")
