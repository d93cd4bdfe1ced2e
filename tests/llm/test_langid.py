import pandas as pd
from pyspark.sql import functions as F

from test_pairs import TEXTS, model  # noqa: F401

from threadloom.llm import langid


def test_held_out_sentences(model):  # noqa: F811
    said = {"en": "we could look at the report today", "de": "wir könnten heute die seite sehen", "fr": "nous pourrions regarder la page aujourd'hui", "es": "podríamos mirar la página hoy", "ru": "мы могли бы ждать сегодня", "zh": "我們今天可以看報告", "ja": "今日は報告書を見てください"}
    out = langid.analysed(pd.Series(list(said.values())), model)
    assert list(out["main"]) == list(said) and (out["confidence"] > 0.4).all()


def test_segments_and_nothing(model):  # noqa: F811
    mixed = TEXTS["en"] + " " + TEXTS["zh"] + " " + TEXTS["en"]
    quoted = TEXTS["en"] + " il n'y a aucune raison d'attendre les autres. " + TEXTS["en"]
    alone = TEXTS["en"] + " il n'y a aucune raison d'attendre les autres. " + TEXTS["en"]
    out = langid.analysed(pd.Series([mixed, quoted, alone, "", None, "123 !?", TEXTS["ru"]]), model)
    langs = [[s["lang"] for s in x] for x in out["segments"]]
    assert langs == [["en", "zh", "en"], [], ["en", "fr", "en"], [], [], [], []]
    assert list(out["main"][3:]) == [None, None, None, "ru"]


def test_look_alikes_keep_their_language(model):  # noqa: F811
    swapped = TEXTS["en"].replace("a", "а").replace("o", "о").replace("e", "е")
    assert langid.analysed(pd.Series([swapped]), model)["main"][0] == "en"


def test_labels_and_noise(spark):
    labels = ["EN", "en_GB", "English", "zho", "zh-Hant", "und", "", None, "pt-BR", "xx"]
    frame = spark.createDataFrame([(x,) for x in labels], "lang string")
    got = [r["x"] for r in frame.select(langid.label_language(F.col("lang")).alias("x")).collect()]
    assert got == ["en", "en", "en", "zh", "zh", None, None, None, "pt", None]
    text = "Hi.\n\n```py\nx = 1\n```\n\n- id: 5\n| a | b |\n{\"rows\": 1}\n\nBye."
    clean = spark.range(1).select(langid.cleaned(F.lit(text)).alias("x")).first()["x"]
    assert "rows" not in clean and "id" not in clean and "x = 1" not in clean and clean.startswith("hi.") and clean.endswith("bye.")


def test_cases(spark, model):  # noqa: F811
    docs = spark.createDataFrame([(1, TEXTS["en"], "en"), (2, TEXTS["en"], "de"), (3, TEXTS["de"], None), (4, TEXTS["en"] + "\n\n" + TEXTS["ru"], "en"), (5, None, None), (6, " ", "en")], "doc_id long, text string, lang string")
    rows = spark.createDataFrame([(1, "c", "user", TEXTS["fr"]), (2, "c", "assistant", TEXTS["en"] * 3), (3, None, "user", TEXTS["en"] + " " + TEXTS["ja"])], "row_id long, conversation_id string, role string, content string")
    records = spark.createDataFrame([(1, "c", "default", "ok", "en"), (2, "c", "default", "ok", "Français"), (3, "c", "salvage", "ok", None), (4, "d", "default", "ok", None)], "analysis_no long, id string, analysis_schema string, status string, language string")
    got = {(r["place"], r["record_key"], r["segment_no"], r["lang"]) for r in langid.language_cases(docs, rows, records, model).collect()}
    assert got == {("document", "2", 0, "en"), ("document", "3", 0, "de"), ("document", "4", 1, "en"), ("document", "4", 2, "ru"), ("analysis", "1", 0, "fr"), ("message", "3", 1, "en"), ("message", "3", 2, "ja")}
