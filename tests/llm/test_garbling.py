import random

from kvern.llm import codecs_seen, garbling

SENTENCES = [
    "Økt etterspørsel gjør at vi ansetter nye medarbeidere på kontoret", "Søknaden sendes innen fristen og være så god", "Formålet er å drive handel med røkt ørret", "Verkstedet holder åpent året rundt og får støtte",
    "Kommunen ga løyve på våren før året var omme", "Bedriften er godkjent lærebedrift på sjøsiden", "Avdelingen på øya selger brød og smør året rundt", "Prisen på kjøretøy gikk ned før påske",
]
CLEAN = ["Порт открыт до шести, Гёлин встречает грузы", "Ελιές από το λιμάνι, σ = 0,3", "NÃO HÁ VAGAS NA CÂMARA", "L’équipe reçoit à 7 ½ h, l’île", "§ 3 og ¶ 2 gjelder; √2 ≈ 1,41 og 5 µm ved 20 °C", "ÆØÅ, Ð og þ er lovlige tegn", "året er NFD", "naïve 🙂"]
WAYS = {
    "utf8 as cp1252": lambda t: t.encode().decode("cp1252", "replace"),
    "utf8 as latin1": lambda t: t.encode().decode("latin_1"),
    "utf8 as cp437": lambda t: t.encode().decode("cp437"),
    "utf8 as cp1251": lambda t: t.encode().decode("cp1251", "replace"),
    "latin1 as cp1251": lambda t: t.encode("latin_1").decode("cp1251"),
    "latin1 as cp850": lambda t: t.encode("latin_1").decode("cp850"),
    "latin1 as utf8": lambda t: t.encode("latin_1").decode("utf_8", "replace"),
    "twice": lambda t: t.encode().decode("cp1252", "replace").encode().decode("cp1252", "replace"),
}


def corpus():
    rnd = random.Random(2)
    docs, truth = [], {}
    for d in range(400):
        text = ". ".join(rnd.sample(SENTENCES, 4)) + f". Nr {d}"
        if d % 5 == 0:
            text += ". " + rnd.choice(CLEAN)
        docs.append((d, text))
    for k, (way, garble) in enumerate(WAYS.items()):
        for j in range(8):
            clean = ". ".join(rnd.sample(SENTENCES, 3))
            part = clean.split(". ")
            text = garble(clean) if j % 2 else ". ".join([part[0], garble(part[1]), part[2]])
            docs.append((1000 + k * 10 + j, text))
            truth[1000 + k * 10 + j] = (way, clean)
    return docs, truth


def frame(spark, docs):
    return spark.createDataFrame([(*x, "clash", 3) for x in docs], "doc_id bigint, text string, form string, n int")


def test_garbled_texts_are_found_and_restored(spark):
    docs, truth = corpus()
    out = garbling.restore_garbled(frame(spark, docs)).collect()
    assert {r.doc_id for r in out} == set(truth)
    wrong = {truth[r.doc_id][0] for r in out if r.restored != truth[r.doc_id][1]}
    assert not wrong - {"latin1 as utf8"}  # lost characters can only be guessed
    assert {r.doc_id for r in garbling.find_garbled(frame(spark, docs)).collect()} == set(truth)


def test_odd_texts_copies_and_empty_tables(spark):
    docs, truth = corpus()
    bad = WAYS["utf8 as cp1252"](SENTENCES[0])
    more = docs + [(5000, None), (5001, ""), (5002, "plain ascii"), (5003, bad), (5003, bad), (5004, (SENTENCES[1] + " ") * 3000 + bad)] + [(6000 + k, bad) for k in range(250)]
    got = {r.doc_id for r in garbling.find_garbled(frame(spark, more)).collect()}
    assert got == set(truth) | {5003, 5004} | {6000 + k for k in range(250)}
    assert garbling.find_garbled(frame(spark, [])).count() == 0
    assert garbling.find_garbled(frame(spark, [(1, "bare ascii")])).count() == 0


def test_copies_of_a_text_garbled_in_one_byte_hide_nothing(spark):
    docs, truth = corpus()
    garble = WAYS["latin1 as cp850"]
    copied = [(7000 + k, garble(SENTENCES[0])) for k in range(1500)]
    alone = [(9000, garble("Fløyelsmyke kjøttkaker"))]  # words that stand nowhere else
    got = {r.doc_id for r in garbling.find_garbled(frame(spark, docs + copied + alone)).collect()}
    assert got == set(truth) | {k for k, _ in copied + alone}


def test_undoing_is_the_reverse_of_garbling():
    for name, t in codecs_seen.transformations().items():
        for word in ("søkjer", "Åpning", "lærling"):
            for spelling in t.garble(word):
                if codecs_seen.LOST in spelling or "?" in spelling or spelling == word:
                    continue
                back = t.restore(spelling)
                assert back in (word, None), (name, word, spelling, back)


def test_a_word_of_another_script_is_no_garbling():
    t = codecs_seen.transformations()["utf_8>cp1251"]
    assert t.restore("Гёлин") is None and t.restore("gjГёr") == "gjør"
