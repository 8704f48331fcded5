from spanlake.llm.p8_garbled import WORD, Restorer, restored

PLAIN = [
    "Müssten Fälle größer sein, fiele die Güte.", "La sélection de résumés où l’ambiguïté est élevée – à vrai dire «très» grande.", "¿Qué métricas? Ningún año mostró señal.",
    "Наконец, машинный перевод требует более аккуратной подготовки.", "Přesnější čtenost však vyžaduje překlady.", "结果表明,准确率对文本摘要的影响超过了。", "the “weak” naïve façade costs €30 – about £9, α ≤ 0.3 and β × 4",
]


def test_plain_texts_are_left_alone():
    r = Restorer()
    for t in [*PLAIN, "AVALIAÇÃO E DISCUSSÃO", "TÂCHERON", "Cf. § 4 and ¶ 2; ± 0.3 µs, ½ of £9, Åse Ðór, ©.", "┌───┬───┐ │ a │", "a &amp; b &eacute;", "", "plain"]:
        assert not r.garbled(t), t
        assert r.restore(t) == t


def test_round_trips():
    r = Restorer()
    for t in PLAIN:
        for wrong in ("latin-1", "cp1252", "mac_roman", "cp437", "cp850"):
            try:
                bad = t.encode("utf-8").decode(wrong)
            except UnicodeDecodeError:
                continue
            assert r.garbled(bad), (wrong, bad)
            assert r.restore(bad) == t, (wrong, bad, r.restore(bad))
    twice = PLAIN[1].encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1")
    assert r.restore(twice) == PLAIN[1]
    assert r.restore("caf&#195;&#169;s") == "cafés"
    assert r.restore(PLAIN[3].encode("cp1251").decode("latin-1")) == PLAIN[3]


def test_partly_and_beyond_repair():
    r = Restorer()
    mixed = PLAIN[0] + "\n\n" + PLAIN[0].encode("utf-8").decode("latin-1")
    assert r.garbled(mixed) and r.restore(mixed) == PLAIN[0] + "\n\n" + PLAIN[0]
    assert r.garbled(PLAIN[0].encode("latin-1").decode("utf-8", "replace"))


def test_parts_around_lost_and_genuine_characters():
    r = Restorer()
    for t in [PLAIN[5], PLAIN[5] + "去掉摘要之后,系统的召回率明显下降。"]:
        bad = t.encode("utf-8").decode("gb18030", "replace")
        assert "\ufffd" in bad and r.garbled(bad)
        got = r.restore(bad)
        assert not set(got) - set(t) - {"\ufffd"} and "准确率对文本" in got, got
        assert got.count("\ufffd") == bad.count("\ufffd")
    assert r.restore("鎽樿�佷箣鍚�,绯荤粺鐨勫彫鍥炵巼") == "摘��之�,系统的召回率".replace("��", "�")
    assert r.restore("结果表明绯荤粺鐨勫彫鍥炵巼") == "结果表明系统的召回率"
    assert r.restore("α–PemmÃ¼ller–Ã©tÃ©") == "α–Pemmüller–été"
    assert r.restore("â€œlegalâ€") == "“legalâ€" and r.restore("dÃ©jÃ") == "déjÃ"
    for t in ["结果表�明,准确率�", "联通�联通", "系统�的召回率"]:
        assert r.restore(t) == t


def test_one_damaged_place_in_a_long_token():
    r = Restorer()
    assert r.restore("KÃ©sia") == "Késia" and r.restore("Ã©choue") == "échoue"
    long = "a-long-compound-of-plain-words" * 10
    assert r.restore(long + "-cafÃ©") == long + "-café"
    for mark in "\ufffd\x81":
        assert r.garbled(long + mark + "x") and r.garbled(PLAIN[5][:-1] * 20 + mark)
    for t in [PLAIN[5] * 20, PLAIN[3].replace(" ", "-") * 20, long]:
        assert not r.garbled(t)


def test_spark(spark):
    bad = PLAIN[0].encode("utf-8").decode("cp1252", "replace")
    rows = [(1, PLAIN[0], "x"), (2, PLAIN[4].encode("utf-8").decode("latin-1"), "x"), (3, None, None), (4, "", ""), (5, bad, "x"), (2, PLAIN[4].encode("utf-8").decode("latin-1"), "x"), (6, "ascii " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, restored string")
    got = sorted((r.doc_id, r.restored) for r in restored(df).collect())
    assert got[:2] == [(2, PLAIN[4])] * 2 and {i for i, _ in got} <= {2, 5}
    assert restored(df.limit(0)).count() == 0


TEXTS = {
    "de": "Die Übersetzung größerer Sätze fällt schwer, weil Wörter über mehrere Äste verteilt sind. Häufig müssen Schlüsse später geprüft werden, außer für kürzere Stücke.",
    "fr": "Les résumés générés paraissent très fidèles, même où la précision décroît. L’évaluation révèle d’où viennent les écarts, grâce à une méthode déjà éprouvée.",
    "es": "La anotación semántica mejoró también en español, aunque según la evaluación más reciente ningún método alcanzó la precisión típica de los demás años.",
    "pt": "A avaliação não é só automática: as questões são também lidas por três pessoas, até que a decisão esteja próxima da média das anotações já concluídas.",
    "cs": "Přesnější překlady však vyžadují úplné slovníky, což je příliš nákladné. Článek proto řeší, jak důvěryhodné shrnutí závisí především na určování významů.",
    "ru": "Если убрать лишние примеры, точность ответов падает почти вдвое. Наконец, машинный перевод требует более аккуратной проверки, как мы показали в другой работе.",
}
NATIVE = {"de": ["cp1252", "cp850", "mac_roman"], "fr": ["cp1252", "cp850", "mac_roman"], "es": ["cp1252", "cp850"], "pt": ["cp1252", "cp850"], "cs": ["cp1250", "iso8859_2", "cp852"], "ru": ["cp1251", "koi8_r", "cp866", "mac_cyrillic"]}


def trained():
    from collections import Counter

    pairs = Counter()
    for t in TEXTS.values():
        for w in WORD.findall(t):
            if not w.isascii():
                low = f" {w.lower()} "
                pairs.update(map("".join, zip(low, low[1:])))
    return Restorer({k: 50 * n for k, n in pairs.items()})


def test_code_pages_of_all_languages():
    r, n, found, back = trained(), 0, 0, 0
    for lang, t in TEXTS.items():
        assert not r.garbled(t) and not r.garbled(t.lower()), lang
        for true in [*NATIVE[lang], "utf-8"]:
            for wrong in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866"):
                for text in (t, t.lower()):
                    try:
                        bad = text.encode(true).decode(wrong)
                    except UnicodeError:
                        continue
                    if bad != text:
                        n += 1
                        found += r.garbled(bad)
                        back += r.garbled(bad) and r.restore(bad) == text
    assert n > 250 and found >= 0.95 * n and back >= 0.85 * n, (n, found, back)


def test_named_cases():
    r = trained()
    for text, true, wrong in [("это простой пример, который показали в другой работе", "koi8_r", "cp1251"), ("это простой пример, который показали в другой работе", "cp1251", "koi8_r"), ("Наконец, машинный перевод требует проверки", "koi8_r", "cp1251"), ("překlady však vyžadují úplné slovníky", "cp1250", "latin-1"), ("překlady však vyžadují úplné slovníky", "iso8859_2", "cp1252"), ("größere Sätze fällt schwer", "cp1252", "mac_roman")]:
        bad = text.encode(true).decode(wrong)
        assert r.garbled(bad) and r.restore(bad) == text, (bad, r.restore(bad))
    assert r.restore("KÃ©sia &#195;&#169;choue") == "Késia échoue"
