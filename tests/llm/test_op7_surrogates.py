import re

from cartloom.llm import op7_surrogates as p

TEXTS = [
    "Write to Ann.Lee@mail.example.org or ANN.LEE@mail.example.org, call +1 (202) 555-0143 or +1 202 555 0143.",
    "ann.lee@mail.example.org again; card 4111 1111 1111 1111 and 4111111111111111, not 4111111111111112; 10.0.0.1 but not 10.0.0.300",
    "Mrs Anna Smith met Mr John Smith. Mrs Smith left. госпожа Иванова пришла. GB82 WEST 1234 5698 7654 32",
    "token = 04dbebab91ab85687d33eeaaf9ac699e1188f962, 078-05-1120",
    "nothing here 2024 and 12 words",
    None,
    "",
]


def run(spark, texts):
    rows = p.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: r for r in rows}


def test_entities_are_replaced_alike_and_in_kind(spark):
    got = run(spark, TEXTS)
    seen = {}
    for i, r in got.items():
        for e in r.entities:
            seen.setdefault(TEXTS[i][e.start : e.end], set()).add(e.replacement)
    assert all(len(v) == 1 for v in seen.values())
    one = {k: next(iter(v)) for k, v in seen.items()}
    assert one["Ann.Lee@mail.example.org"] == one["ann.lee@mail.example.org"] and one["ANN.LEE@mail.example.org"].lower() == one["ann.lee@mail.example.org"]
    assert re.sub(r"\D", "", one["4111 1111 1111 1111"]) == one["4111111111111111"]
    assert p.luhn(one["4111111111111111"][:-1]) == int(one["4111111111111111"][-1])
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", one["+1 (202) 555-0143"]) and re.sub(r"\D", "", one["+1 (202) 555-0143"]) == re.sub(r"\D", "", one["+1 202 555 0143"])
    assert p._iban_rest(one["GB82 WEST 1234 5698 7654 32"].replace(" ", "")) == 1
    assert one["Anna"].endswith("a") and one["John"].endswith("on") and one["Smith"].endswith("er") and re.fullmatch("[А-Я][а-я]+а", one["Иванова"])
    assert re.fullmatch("[0-9a-f]{40}", one["04dbebab91ab85687d33eeaaf9ac699e1188f962"])
    assert "4111111111111112" in got[1].clean_text and "10.0.0.300" in got[1].clean_text and "10.0.0.1 " not in got[1].clean_text
    assert (got[4].clean_text, got[5].clean_text, got[6].clean_text) == (TEXTS[4], None, "")
    assert all(e.kind and got[2].clean_text != TEXTS[2] for e in got[2].entities)


def test_secrets_in_upper_case(spark):
    low, letters, mixed = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "abcdefabcdefabcdefabcdefabcdefab", "Ab1" + "xYz" * 12 + "q"
    texts = [f"token = {low}", f"TOKEN = {low.upper()}", f"key {letters}", f"KEY {letters.upper()}", f"KEY {mixed}", f"KEY {mixed.upper()}", "G" * 40]
    got = run(spark, texts)
    one = [got[i].entities[0].replacement for i in range(6)]
    assert all(len(got[i].entities) == 1 and got[i].entities[0].kind == "secret" and got[i].clean_text.endswith(one[i]) and one[i] not in texts[i] for i in range(6))
    assert re.fullmatch("[0-9a-f]{40}", one[0]) and one[1] == one[0].upper() and re.fullmatch("[0-9a-f]{32}", one[2]) and one[3] == one[2].upper()
    assert re.fullmatch("[A-Z0-9]{40}", one[5]) and got[6].clean_text == texts[6]


def test_collisions_are_drawn_again(spark, monkeypatch):
    # only few numbers can be drawn at first, so many entities collide; each still gets its own, and none that is real
    numbers = [f"078-05-{1000 + i}" for i in range(40)]
    real = {n.replace("-", "") for n in numbers}
    drawn = p.surrogate
    monkeypatch.setattr(p, "surrogate", lambda kind, canonical, attempt=0, key=b"": drawn(kind, canonical, attempt, key) if attempt > 2 else f"07805{1000 + int(canonical[-2:]) % 5 + 10 * attempt}")
    found = spark.createDataFrame([("ssn", n.replace("-", "")) for n in numbers], "kind string, canonical string")
    out = p.replacements(found).collect()
    assert len(out) == 40 == len({r.replacement for r in out}) and not real & {r.replacement for r in out}


def plain(texts):
    """Replacements by a dictionary over all texts, in rounds: a draw counts if it is neither real nor taken, and its least entity gets it."""
    open_ = {e for t in texts if t for e in p.named(t)}
    real, table, attempt = set(open_), {}, 0
    while open_:
        offers = {}
        for kind, canonical in sorted(open_):
            offers.setdefault((kind, p.surrogate(kind, canonical, attempt)), (kind, canonical))
        taken = real | {(kind, made) for (kind, _), made in table.items()}
        table |= {e: made for (kind, made), e in offers.items() if (kind, made) not in taken}
        open_ -= table.keys()
        attempt += 1
        assert attempt < 40
    return [(t, []) if not t else p.replaced(t, table) for t in texts]


ODD = [
    "日本@例え.jp wrote to 日本@例え.jp, a@b.de, b@b.de, c@b.de and .@_.de; ٠٧٨-٠٥-١١٢٠ and ٠٧٨-٠٥-١١٢١",
    "é́a@ñandú.es, Å@Å.se, ﬁ@ﬁ.com; " + ", ".join(f"{c}@x.y" for c in "abcdefghijklmnopqrstuvwxyz0123456789"),
    ", ".join(f"{c}@{d}.io" for c in "αβγ" for d in "ąćę"),
    "Mrs Smith came. Later Smith left, and Anna Smith wrote to smith@smith.org. Smithson stayed.",
    "Herr Äß und Frau 王小明; 王小明 kam. Mr J. No. 4111 1111 1111 1111, ٤١١١١١١١١١١١١١١١",
    "no entity at all", None, "", "Mr", "@", "+" * 30 + "@a.b",
]


def test_any_script_comes_to_an_end_and_equals_a_plain_dictionary(spark):
    texts = [*ODD, *TEXTS]
    got = run(spark, texts)
    want = plain(texts)
    for i, (text, spans) in enumerate(want):
        assert got[i].clean_text == text and [e.asDict() for e in got[i].entities] == spans
    # distinct entities stay distinct, and no real one is left
    surfaces, made = {}, {}
    for i, r in got.items():
        for e in r.entities:
            surfaces.setdefault(e.replacement.lower(), set()).add(re.sub(r"[ ().-]", "", texts[i][e.start : e.end].lower()) if e.kind != "email" else texts[i][e.start : e.end].lower())
            made.setdefault(e.kind, set()).add(e.replacement)
    assert all(len(v) == 1 for v in surfaces.values())
    assert not made["email"] & {texts[i][e.start : e.end].lower() for i, r in got.items() for e in r.entities}
    assert re.search("[\u4e00-\u9fff]", got[0].clean_text.split("@")[0]) and re.search("[٠-٩]{3}-[٠-٩]{2}-[٠-٩]{4}", got[0].clean_text)
    assert len({m.partition("@")[2] for m in made["email"] if m.endswith(".io")}) == 3


def test_a_name_behind_a_title_is_replaced_in_the_whole_text(spark):
    text = ODD[3]
    r = run(spark, [text])[0]
    assert [text[e.start : e.end] for e in r.entities] == ["Smith", "Smith", "Smith", "smith@smith.org"]
    assert "Smith " not in r.clean_text and "Smithson stayed" in r.clean_text and len({e.replacement for e in r.entities}) == 2


def test_texts_that_may_hold_an_entity(spark):
    texts = [*ODD, *TEXTS, "a" * 31, "a" * 32, "F" * 32, "Frau. X", "Sr Y"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    passed = {r.i for r in frame.filter(p.may_hold(frame["t"])).collect()}
    assert {i for i, t in enumerate(texts) if t and p.entities(t)} <= passed


def test_odd_input(odd_docs, no_docs):
    out = p.replace_entities(odd_docs)
    assert out.count() == 5 and out.columns[-2:] == ["clean_text", "entities"]
    assert p.replace_entities(no_docs).collect() == []
