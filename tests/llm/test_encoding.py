import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslens.llm import encoding as E

RIGHT = {
    "de": "Für ältere Fahrzeuge darf nicht der Türöffner bei 63 °C über die zweite Klemme versorgt werden – „Größe“ genannt.",
    "fr": "Près de la porte coupe-feu, le châssis élévateur s’écarte légèrement de la tôle protégée; la valeur « même » est conservée.",
    "es": "La bobina del freno se comprobó frente a la válvula pequeña a 39 °C, ¡nunca al revés. ¿Está zona en verde?",
    "pl": "Na końcu trasy w HaulMate moduł łączności nie może się przesuwać w ciągu 37 ms; wartość „zaru” pozostaje ważna.",
    "en": "The worn charging plate drifts away – never the other way round; it’s logged as “zone”, 15 N·m.",
}


def table(rows):
    """What a corpus of these texts, each in many documents, and of garbled ones in a few, has habitually."""
    counts = {}
    for text, n in rows:
        for p in E.places(text):
            counts[p] = counts.get(p, 0) + n
    habits = E.Habits(counts, sum(n for _, n in rows))
    habits.shown()
    return habits


OTHERS = [
    "Old terminals print Ã¼ where zx1 sends ü; that sample is quoted on purpose (25).", "ATENÇÃO – NÃO TOCAR: linha, peça 57.", "CHÂTEAU D’EAU, ÂGE 44 ANS, GRÂCE À x – «À VÉRIFIER».",
    "¿Qué indica? ¡Pare en el andén 84! Â, Ê y Ã no se usan.", "Panel text 充電中 (x) means charging, bay 56.", "Der Aufkleber „СТОП 31“ bleibt, auch ‚x‘.", "├── a\n│   └── zone.map\n└── 5 ÄÖÜ",
    "Bore Ø 24 mm, gap ½ to ¾, film ≤ 24 Å, pull 3 kΩ.", "Łódź: ¹/₃ of 68 µm² at ±6°, µ = 0.68, © x, § 68.", "© 2023 desk\xa0copy", "vehic¬\nles con†act véri\xad\nfié ﬂow", "кнопка СТОП 836", "Mañana é é é",
]


def corpus_habits():
    rows = [(t, 500) for t in RIGHT.values()] + [(t.replace("„", "").replace("“", ""), 200) for t in RIGHT.values()] + [(t.upper(), 50) for t in RIGHT.values()] + [(t, 60) for t in OTHERS]
    rows += [(POLISH, 500), ("Das Ladegerät steht.", 500), ("Die Höhe, Wärme, Käfig, Länge.", 500)]
    for wrong in ("cp1251", "mac_roman", "cp437"):
        rows += [(RIGHT[x].replace("„", "").replace("“", "").encode("cp1252", "ignore").decode(wrong, "ignore"), 2) for x in ("de", "fr", "es")]
    return table(rows + [(POLISH.encode(was).decode("cp1252"), 2) for was in ("cp1250", "iso8859_2")])


POLISH = "Pod pełnym obciążeniem stół podnośny nie może się przesuwać przy 5 mm."


def garble(text, codec, times=1):
    for _ in range(times):
        data = text.encode()
        text = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in data) if codec != "gb18030" else data.decode(codec)
    return text


HABITS = corpus_habits()


@pytest.mark.parametrize("lang", RIGHT)
@pytest.mark.parametrize("codec", ["cp1252", "latin_1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850"])
def test_utf8_misread_comes_back(lang, codec):
    bad = garble(RIGHT[lang], codec)
    text, found, _ = E.repair("plain line\n" + bad, HABITS)
    assert found and text == "plain line\n" + RIGHT[lang]
    assert E.is_garbled(bad, HABITS)


@pytest.mark.parametrize("lang", RIGHT)
def test_twice_misread(lang):
    assert E.repair(garble(RIGHT[lang], "cp1252", 2), HABITS)[0] == RIGHT[lang]


@pytest.mark.parametrize("lang", ["de", "fr", "es"])
@pytest.mark.parametrize("wrong", ["cp1251", "mac_roman", "cp437"])
def test_one_byte_encodings(lang, wrong):
    right = RIGHT[lang].replace("„", "").replace("“", "")
    bad = right.encode("cp1252").decode(wrong)
    assert E.is_garbled(bad, HABITS) and E.repair(bad, HABITS)[0] == right


@pytest.mark.parametrize("was", ["cp1250", "iso8859_2"])
def test_polish_misread_as_western(was):
    right = POLISH
    bad = right.encode(was).decode("cp1252")
    assert E.is_garbled(bad, HABITS) and E.repair(bad, HABITS)[0] == right


@pytest.mark.parametrize("lang", RIGHT)
def test_right_text_stays(lang):
    assert E.repair(RIGHT[lang], HABITS) == (RIGHT[lang], 0, 0) and E.repair(RIGHT[lang].upper(), HABITS)[1] == 0


@pytest.mark.parametrize(
    "text",
    [
        "Old terminals print Ã¼ where zx1 sends ü; that sample is quoted on purpose (25).", "ATENÇÃO – NÃO TOCAR: linha, peça 57.", "CHÂTEAU D’EAU, ÂGE 44 ANS, GRÂCE À x – «À VÉRIFIER».",
        "¿Qué indica? ¡Pare en el andén 84! Â, Ê y Ã no se usan.", "Panel text 充電中 (x) means charging, bay 56.", "Der Aufkleber „СТОП 31“ bleibt, auch ‚x‘.", "├── a\n│   └── zone.map\n└── 5 ÄÖÜ",
        "Bore Ø 24 mm, gap ½ to ¾, film ≤ 24 Å, pull 3 kΩ.", "Łódź: ¹/₃ of 68 µm² at ±6°, µ = 0.68, © x, § 68.", "© 2023 desk\xa0copy", "vehic¬\nles con†act véri\xad\nfié ﬂow", "кнопка СТОП 836", "", "x" * 100_000, "é" * 100_000,
    ],
)
def test_rare_but_right_or_quoted(text):
    assert E.repair(text, HABITS)[:2] == (text, 0) and not E.is_garbled(text, HABITS)


def test_lost_characters_are_told_and_filled_where_known():
    text, found, left = E.repair("Das Ladegerät steht. Das Ladeger�t bleibt � so.", HABITS)
    assert found and "Das Ladegerät bleibt" in text and left == 1


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text_passes(text):
    out, found, left = E.repair(text, HABITS)
    assert (found > 0) == E.is_garbled(text, HABITS) and (found or out == text)


def test_table(spark):
    bad = garble("Für", "cp1252")
    data = [("a", "---\nÃ¼\n---\n" + bad, 12, "x"), ("a", "---\nÃ¼\n---\n" + bad, 12, "x"), ("b", "---\nÃ¼ber\n---\nright", 14, "x"), ("c", None, 0, "x"), (None, bad, 0, "x"), ("d", "", None, "x"), ("e", bad, None, "x")]
    docs = spark.createDataFrame(data, "path string, content string, body_start int, found string")
    assert sorted(r["path"] for r in E.garbled(docs).collect()) == ["a", "e"]
    got = sorted((r["path"] or "", r["content"], r["found"]) for r in E.restored(docs).collect() if r["content"] is not None)
    assert got == [("", "Für", 1), ("a", "---\nÃ¼\n---\nFür", 1), ("a", "---\nÃ¼\n---\nFür", 1), ("b", "---\nÃ¼ber\n---\nright", 0), ("d", "", 0), ("e", "Für", 1)]
    assert E.garbled(docs.limit(0)).count() == 0 and E.restored(docs.limit(0)).count() == 0


def test_spans_lie_in_runs():
    text = "a Ã¼ b ÃƒÂ¼c\nPrÃ¨s é x"
    assert [text[b:e] for b, e, _ in E._spans(text)] == ["Ã¼", "ÃƒÂ¼", "Ã¨"]


def test_a_pair_shown_by_one_character_only_is_none():
    """A dagger in place of a t would be a Polish letter by one pair of encodings, but nothing else speaks for that pair."""
    habits = table([("być stać dać", 900), ("tha† wai†", 5)])
    assert not E.is_garbled("tha† wai† by† da†", habits) and habits.tables == []


def test_places():
    assert E.places("é1 né\t?a?b") == {" é0": 1, "né ": 1, "a?b": 1}
    assert E.places("") == E.places("plain? text") == {}


def test_habits_of_a_table(spark):
    rows = [("Für ältere Fahrzeuge",)] * 30 + [("F³r",)] * 2 + [(None,), ("",)]
    habits = E.habits_of(spark.createDataFrame(rows, "body string"))
    assert habits.count("Für") == 30 and habits.count("F³r") == 2 and habits.documents == 34


def test_places_beyond_those_in_the_dict_count_as_well(spark, monkeypatch):
    """A corpus with more places than the dict takes is judged as if the dict took all."""
    rows = [(t,) for t in [*RIGHT.values()] * 30 + [POLISH] * 120 + [POLISH.encode(was).decode("cp1252") for was in ("cp1250", "iso8859_2")] * 2]
    bodies = spark.createDataFrame(rows, "body string")
    whole = E.habits_of(bodies)
    monkeypatch.setattr(E, "PLACES", 40)
    split = E.habits_of(bodies)
    assert dict(split.counts.items()) == whole.counts and split.tables == whole.tables and split.between == whole.between and split.counts.first and split.counts.rest
    bad = POLISH.encode("cp1250").decode("cp1252")
    assert E.repair(bad, split) == E.repair(bad, whole) and E.repair(bad, split)[0] == POLISH
    docs = spark.createDataFrame([(f"p{i}", t, 0) for i, (t,) in enumerate(rows)], "path string, content string, body_start int")
    found = {r["path"] for r in E.garbled(docs).collect()}
    monkeypatch.undo()
    assert found == {r["path"] for r in E.garbled(docs).collect()} != set()
