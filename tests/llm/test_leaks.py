import random

from kvern.llm import leaks
from pyspark.sql import functions as F

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "su", "ty", "vø", "jå") for b in ("bra", "dir", "fos", "gul", "hem", "lik", "mon", "nær", "pis", "rek")]


def naive_align(a, b):
    h = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = (0, 0)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = a[i - 1] == b[j - 1]
            s, e = h[i - 1][j - 1]
            h[i][j] = max((0, 0), (s + (1 if same else -1), e + same), (h[i - 1][j][0] - 1, h[i - 1][j][1]), (h[i][j - 1][0] - 1, h[i][j - 1][1]))
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_plain_table():
    rnd = random.Random(3)
    pairs = [([rnd.choice("abcdefg") for _ in range(rnd.randrange(1, 30))], [rnd.choice("abcdefg") for _ in range(rnd.randrange(1, 20))]) for _ in range(60)]
    got = leaks.align([a for a, _ in pairs], [b for _, b in pairs])
    assert [s for s, _ in got] == [naive_align(a, b)[0] for a, b in pairs]
    assert [e for _, e in got] == [naive_align(a, b)[1] for a, b in pairs]


def words_of(spark, *texts):
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    return [r.w for r in frame.select(leaks.plain_words(F.col("text")).alias("w")).collect()]


def test_spellings_of_one_wording_give_the_same_words(spark):
    got = words_of(spark, "Blåbær i Hårdøsundet, KN-2263!", "BLABAER i <b>Hardosundet</b> KN 2263", "Blåbær i Hå­rdø​sundet—kn 2263", None, "")
    assert got[0] == got[1] == got[2] == ["blabaer", "i", "hardosundet", "kn", "2263"] and got[3] is None and got[4] == []


def corpus(seed=5):
    rnd = random.Random(seed)
    line = lambda n: [rnd.choice(WORDS) + str(rnd.randrange(50)) for _ in range(n)]
    items = [line(60) for _ in range(12)]
    items.append(items[0][:30] + line(30))  # shares a long passage with the first
    template = "kontrollør talte fliser i hall før havnefogd avviste konteiner fordi plomben viste".split()
    items += [template[:6] + line(8) + template[6:] + line(20) for _ in range(8)]
    docs, truth = [], set()
    for d in range(60):
        text = line(80)
        i = rnd.randrange(1, 12)
        if d % 4 == 0:
            at, n = rnd.randrange(30), rnd.randrange(18, 30)
            passage = items[i][at : at + n]
            if d % 8 == 0:
                passage[5] = "annet"
                passage.insert(11, "dessuten")
            text = text[:40] + passage + text[40:]
            truth.add((d, i))
        elif d % 4 == 1:
            text = text[:40] + items[i][10:19] + text[40:]  # too short to count
        elif d % 4 == 2:
            text = text[:20] + template + text[20:]
        docs.append((d, " ".join(text)))
    return docs, [(i, " ".join(x)) for i, x in enumerate(items)], truth


def find(spark, docs, items):
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(*x, "c") for x in items], "item_id bigint, text string, doc_id string")
    return {(r.doc_id, r.item_id) for r in leaks.find_leaks(d, i).collect()}


def test_planted_passages_are_found_and_nothing_else(spark):
    docs, items, truth = corpus()
    assert find(spark, docs, items) == truth


def test_passages_that_many_items_share(spark):
    docs, items, _ = corpus()
    shared = " ".join(f"felles{k}" for k in range(20))
    items = [(i, t + " " + shared) for i, t in items]
    got = find(spark, [(1, "noe foran " + shared + " noe etter")], items)
    assert got == {(1, i) for i, _ in items}


def test_odd_texts_and_empty_tables(spark):
    docs, items, _ = corpus()
    whole = items[3][1]
    odd = [(1, None), (2, ""), (3, "kort"), (4, (whole + " ") * 300), (5, whole), (5, whole)]
    assert find(spark, odd, items + [(99, None), (98, "to ord")]) == {(4, 3), (5, 3)}
    assert find(spark, [], items) == set() and find(spark, odd, []) == set()


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BROADCAST_BYTES", 0)
    docs, items, truth = corpus(8)
    assert find(spark, docs, items) == truth
