import binascii

import numpy as np

from citeloom.llm import langid

EN = ["the cat was on the thing with her", "they were the best of times and the worst", "this is what the other one thought about that"]
DE = ["der Hund und die Katze sind nicht mit dem Haus", "das ist ein sehr schönes Wetter und wir gehen", "ich habe eine Frage zu dem Buch"]
FR = ["le chat est sur la table avec les enfants", "nous sommes des élèves de la grande école", "il y a une chose que je ne sais pas"]
ES = ["el perro y la casa son de los niños", "no me gusta nada lo que está pasando aquí", "una cosa que yo no sé es por qué"]


def rows():
    out, i = [], 0
    for k in range(12):
        for lang, texts in (("en", EN), ("de", DE), ("fr", FR), ("es", ES)):
            out.append((i, f"{texts[k % 3]} {texts[(k + 1) % 3]}", lang))
            i += 1
    return out


def test_predictions(spark):
    data = [*rows(), (900, None, "en"), (901, "123 --- ###", "fr"), (902, "", None), (903, "le chat", None), (None, "der Hund und das Haus", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").selectExpr("*", "1 as score")
    out = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(out) == len(data)
    assert all(out[i].lang_pred == lang for i, _, lang in rows())
    assert all(out[i].held_out == (binascii.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows())
    assert [out[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "fr"]
    assert out[None].held_out is False
    assert all(0 <= r.score <= 1 for r in out.values())
    assert langid.identify(df.limit(0)).count() == 0


def test_labels_of_the_held_out_are_unused(spark):
    data = rows()
    held = [(i, t, "en" if binascii.crc32(str(i).encode()) % 5 == 0 else g) for i, t, g in data]
    a, b = (sorted(map(tuple, langid.identify(spark.createDataFrame(x, "doc_id long, text string, lang string")).select("doc_id", "lang_pred", "score").collect())) for x in (data, held))
    assert a == b


def test_slices_and_order_of_classes():
    v = langid.features("abc " * 10, 512)
    assert abs(np.linalg.norm(v) - 1) < 1e-5 and langid.features("12 3", 512) is None
    m = langid.OneVersusOne(["a"])
    assert m.decide(v) == ("a", 1.0)
