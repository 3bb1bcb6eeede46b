"""Texts garbled by a wrong character encoding, found and restored through their near-twins.

A garbled word and a clean one of another text are near-twins: stripped of non-ASCII
characters they are equal.  Words are joined on that stripped pattern with the most
frequent spelling of the pattern, their runs of other characters are aligned, and a
run that a wrong decoding makes of the other tells the transformation.  A
transformation that many patterns show is learnt; how its characters occur in clean
words is counted.  Learnt transformations are then applied to words without a twin.

The counts run over all texts, each once however often it is delivered.  Only tables whose size is bounded by the codecs come
to the driver: the patterns per transformation, and counts per character of these.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvern.llm import codecs_seen
from kvern.session import Stage

MIN_PATTERNS = 3  # patterns that must show a transformation, twice as many as show its reverse
MIN_LETTERS = 2  # characters that a one-byte transformation must be seen to change: names that differ in one letter show just one
CLEARLY = 4  # times as many texts with the clean spelling as with the garbled one, for a pattern to show a transformation
MIN_RELIABILITY = 0.5  # share of a character's texts in which it is garbled
SURE_LETTERS = 4  # ASCII letters of a word from which a verdict without a twin is enough
BROADCAST_BYTES = 64 << 20  # size up to which the verdicts on words are broadcast

_PAIR = "pattern string, garbled string, clean string, transform string, n_garbled bigint, n_clean bigint, changed string"
_VERDICT = "pattern string, form string, restored string, transform string"


def _words(key: str):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, forms, patterns = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text is None or text.isascii() and "&" not in text:
                    continue
                for form, pattern in {(f, p) for f, p, _, _ in codecs_seen.garbled_words(text)}:
                    at.append(k)
                    forms.append(form)
                    patterns.append(pattern)
            keys, same = (batch.column(k).take(pa.array(at, pa.int64())) for k in (0, 2))
            yield pa.RecordBatch.from_arrays([keys, same, pa.array(patterns, pa.string()), pa.array(forms, pa.string())], names=[key, "_text", "pattern", "form"])

    return each


@lru_cache(maxsize=200_000)
def _explained(clean: str, garbled: str) -> frozenset[str]:
    """Transformations that make one run of another."""
    return frozenset(name for name, t in codecs_seen.transformations().items() if garbled in t.garble(clean))


def _transforms_between(clean: str, garbled: str) -> frozenset[str]:
    """Transformations that explain all runs in which two spellings of a pattern differ."""
    sides = codecs_seen.runs(clean), codecs_seen.runs(garbled)
    if len(sides[0]) != len(sides[1]):
        return frozenset()
    common: frozenset[str] | None = None
    for c, g in zip(*sides, strict=True):
        if c != g:
            names = _explained(c, g)
            common = names if common is None else common & names
            if not common:
                return frozenset()
    return common or frozenset()


def _changed(clean: str, garbled: str) -> str:
    """The clean characters of the runs that differ, each once."""
    runs = zip(codecs_seen.runs(clean), codecs_seen.runs(garbled), strict=True)
    return "".join(sorted({x for c, g in runs if c != g for x in c}))


def _explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both ways round: the more frequent spelling is clean as a rule, but not where a garbled text has many copies."""
    for batch in batches:
        rows: list[tuple] = []
        for pattern, form, n, lead, n_lead in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for clean, garbled, a, b in ((lead, form, n_lead, n), (form, lead, n, n_lead)):
                names = _transforms_between(clean, garbled)
                changed = _changed(clean, garbled) if names else ""
                rows += [(pattern, garbled, clean, name, b, a, changed) for name in names]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["pattern", "garbled", "clean", "transform", "n_garbled", "n_clean", "changed"])


def learn(pairs: DataFrame) -> list[str]:
    """Names of the transformations that the twins show, those with most patterns first."""
    clearly = F.col("n_clean") >= CLEARLY * F.col("n_garbled")
    counted = pairs.groupBy("transform").agg(
        F.count_distinct(F.when(clearly, F.col("pattern"))).alias("towards"),
        F.count_distinct(F.when(F.col("n_garbled") >= CLEARLY * F.col("n_clean"), F.col("pattern"))).alias("against"),
        F.count_distinct(F.when(clearly & (F.length("changed") == 1), F.col("changed"))).alias("letters"),
    )
    known = codecs_seen.transformations()
    plain = [n for n, t in known.items() if t.direct]
    enough = F.col("transform").isin(plain) | (F.col("letters") >= MIN_LETTERS)
    rows = counted.where(enough & (F.col("towards") >= MIN_PATTERNS) & (F.col("towards") >= 2 * F.col("against"))).collect()  # a row per codec pair at most
    return [r.transform for r in sorted(rows, key=lambda r: (-r.towards, r.transform))]


def target_characters(pairs: DataFrame, learnt: list[str]) -> frozenset[str]:
    """Characters that the clean sides of twins hold: what a restored word may hold.  At most as many as there are characters."""
    clean = pairs.where(F.col("transform").isin(learnt) & (F.col("n_clean") >= F.col("n_garbled")))
    chars = clean.select("pattern", F.explode(F.array_distinct(F.split("clean", ""))).alias("char"))
    held = chars.groupBy("char").agg(F.count_distinct("pattern").alias("patterns")).where("patterns > 1")
    return frozenset(r.char for r in held.select("char").collect())


def reliability(pairs: DataFrame, ranked: DataFrame, learnt: list[str]) -> dict[tuple[str, str], float]:
    """For each learnt one-byte transformation and character: the share of texts in which the character is garbled.

    Garbled ones are counted over words with twins, clean ones over the most frequent
    spelling of each pattern, unless that is itself a garbled one.  Characters are those of the codecs, so the result has a
    few thousand entries at most.
    """
    known = codecs_seen.transformations()
    chars = {c for name in learnt for c in getattr(known[name], "back", {codecs_seen.LOST: ""})}
    mine = F.filter(F.array_distinct(F.split("form", "")), lambda c: c.isin(sorted(chars))) if chars else F.array()
    bad = pairs.where(F.col("transform").isin(learnt)).where("n_clean >= n_garbled").select("transform", "pattern", F.col("garbled").alias("form"), F.col("n_garbled").alias("n"))
    bad = bad.select("transform", F.explode(mine).alias("char"), "n").groupBy("transform", "char").agg(F.sum("n").alias("n"))
    leads = ranked.where("form = lead").join(_garbled_leads(pairs, learnt), ["pattern", "form"], "left_anti")
    good = leads.select(F.explode(mine).alias("char"), "n").groupBy("char").agg(F.sum("n").alias("n"))
    fine = {r.char: r.n for r in good.collect()}
    return {(r.transform, r.char): r.n / (r.n + fine.get(r.char, 0)) for r in bad.collect()}


def _garbled_leads(pairs: DataFrame, learnt: list[str]) -> DataFrame:
    """``(pattern, form)`` of leading spellings that a learnt transformation makes of a rarer one.

    A one-byte transformation tells nothing where another learnt one makes the rarer spelling of the leading one.
    """
    known = codecs_seen.transformations()
    plain = F.col("transform").isin([n for n in learnt if known[n].direct])
    behind = F.col("n_garbled") > F.col("n_clean")
    told = pairs.where(F.col("transform").isin(learnt))
    sides = told.select("pattern", F.when(behind, F.col("garbled")).otherwise(F.col("clean")).alias("form"), F.when(behind, F.col("clean")).otherwise(F.col("garbled")).alias("other"), behind.alias("behind"), plain.alias("plain"))
    each = sides.groupBy("pattern", "form", "other").agg(F.max(F.col("behind") & F.col("plain")).alias("sure"), F.max("behind").alias("behind"), F.max(~F.col("behind")).alias("ahead"))
    return each.where("sure OR behind AND NOT ahead").select("pattern", "form").distinct()


def _judge(learnt: list[str], shares: dict[tuple[str, str], float], targets: frozenset[str]):
    """A function from spellings to those that are garbled: the first learnt transformation that undoes a spelling wholly."""

    def verdict(form: str) -> tuple[str | None, str] | None:
        known = codecs_seen.transformations()
        for name in learnt:
            t = known[name]
            if t.direct:
                back = t.restore(form)
                if back is not None and all(c in targets for c in back if ord(c) > 127):
                    return back, name
                continue
            odd = [c for c in form if ord(c) > 127]
            if isinstance(t, codecs_seen.Lossy):
                if codecs_seen.LOST in odd and shares.get((name, codecs_seen.LOST), 0) >= MIN_RELIABILITY:
                    return None, name
            elif any(c.isascii() and c.isalpha() for c in form) and all(shares.get((name, c), 0) >= MIN_RELIABILITY for c in odd):
                back = t.restore(form)
                if back is not None:
                    return back, name
        return None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pattern, form in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = verdict(form)
                if found:
                    rows.append((pattern, form, *found))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["pattern", "form", "restored", "transform"])

    return each


def garbled_spellings(documents: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The words of all texts ``(key, pattern, form)`` and the verdicts ``(pattern, form, restored, transform, twin)``.

    ``restored`` is null where nothing tells what was there.  Runs jobs.
    """
    stage = Stage(documents.sparkSession, "garbling")
    kind = dict(documents.dtypes)[key]
    words = stage.write(documents.select(key, "text", F.xxhash64("text").alias("_text")).mapInArrow(_words(key), f"{key} {kind}, _text bigint, pattern string, form string"), "words")
    # a text counts once, however many copies there are: copies are dropped before the shuffle where they lie together
    forms = words.select("pattern", "form", "_text").distinct().groupBy("pattern", "form").agg(F.count("*").alias("n"))
    # spellings of a pattern, not occurrences, share a partition; words without a letter to join on, as of
    # other scripts, have no twins and would all share one
    lettered = F.col("pattern").rlike("[A-Za-z]")
    first = Window.partitionBy("pattern").orderBy(F.col("n").desc(), "form")
    led = forms.where(lettered).select("*", F.first("form").over(first).alias("lead"), F.first("n").over(first).alias("n_lead"))
    single = forms.where(~lettered).select("*", F.col("form").alias("lead"), F.col("n").alias("n_lead"))
    ranked = stage.write(led.unionByName(single), "forms")
    twins = ranked
    others = twins.where("form <> lead").select("pattern", "form", "n", "lead", "n_lead")
    pairs = stage.write(others.mapInArrow(_explain, _PAIR), "pairs")

    learnt = learn(pairs)
    shares = reliability(pairs, ranked, learnt)
    targets = target_characters(pairs, learnt)
    plain = [n for n in learnt if codecs_seen.transformations()[n].direct]
    trusted = F.col("transform").isin(plain) | (F.col("n_clean") >= F.col("n_garbled"))
    rank = F.array_position(F.array(*map(F.lit, learnt)), F.col("transform")) if learnt else F.lit(0)
    by_twin = (
        pairs.where(F.col("transform").isin(learnt) & trusted)
        .groupBy("pattern", F.col("garbled").alias("form"))
        .agg(F.min(F.struct(rank.alias("rank"), F.col("clean").alias("restored"), "transform")).alias("v"))
        .select("pattern", "form", "v.restored", "v.transform")
    )
    alone = ranked.join(by_twin, ["pattern", "form"], "left_anti").select("pattern", "form")
    by_rule = alone.mapInArrow(_judge(learnt, shares, targets), _VERDICT)
    both = by_twin.withColumn("twin", F.lit(True)).unionByName(by_rule.withColumn("twin", F.lit(False)))
    return words.drop("_text"), stage.write(both, "verdicts")


def _hits(words: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The garbled words of each text.

    A verdict without a twin on a word of few ASCII letters ("µm") may be a unit or
    a sign, so it is not ``sure``: it counts where the text has a sure one.
    """
    size = verdicts.agg(F.sum(sum(F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in verdicts.dtypes if kind == "string") + 64)).first()[0] or 0
    few = size <= BROADCAST_BYTES
    known = codecs_seen.transformations()
    plain = [n for n, t in known.items() if t.direct or isinstance(t, codecs_seen.Lossy)]
    long = F.length(F.regexp_replace("form", "[^A-Za-z]", "")) >= SURE_LETTERS
    judged = verdicts.withColumn("sure", F.col("twin") | F.col("transform").isin(plain) | long)
    return words.join(F.broadcast(judged) if few else judged, ["pattern", "form"])


def find_garbled(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key)`` of texts with a garbled word, restorable or not.

    Null, empty and ASCII texts are none; repeated texts each give their row; a key
    that several rows share comes once.  An empty table gives no rows.
    """
    words, verdicts = garbled_spellings(documents, key)
    return _hits(words, verdicts).groupBy(key).agg(F.max("sure").alias("sure")).where("sure").select(key)


def restore_garbled(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, text, restored, left)`` of garbled texts: restored as far as possible, and the words that stay garbled."""
    words, verdicts = garbled_spellings(documents, key)
    changes = _hits(words, verdicts).groupBy(key).agg(
        F.collect_list(F.struct("form", "pattern", "restored")).alias("changes"),
        F.count_if(F.col("restored").isNull()).alias("left"),
        F.max("sure").alias("sure"),
    )
    changes = changes.where("sure").drop("sure")  # a text's list has at most its words
    kind = dict(documents.dtypes)[key]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, changes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                back: dict[tuple[str, str], str] = defaultdict(str)
                for c in changes:
                    if c["restored"] is not None:
                        back[c["form"], c["pattern"]] = c["restored"]
                out, at = [], 0
                for form, pattern, start, end in codecs_seen.garbled_words(text):
                    if (form, pattern) in back:
                        raw = text[start:end]
                        new = raw.replace(form, back[form, pattern]) if form in raw else back[form, pattern]
                        out += [text[at:start], new]
                        at = end
                texts.append("".join(out) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), batch.column(3)], names=[key, "text", "restored", "left"])

    joined = documents.select(key, "text").join(changes, key).select(key, "text", "changes", "left")
    return joined.mapInArrow(each, f"{key} {kind}, text string, restored string, left bigint")
