import pytest
from pyspark.sql import functions as F

from threadloom.llm import pairs
from threadloom.llm.langid import LANGUAGES, train

TEXTS = {
    "en": "the weather is nice today and we could walk to the station. there is no reason to wait for the others. please look at the first page of the report again.",
    "de": "das wetter ist heute schön und wir könnten zum bahnhof gehen. es gibt keinen grund auf die anderen zu warten. bitte sieh dir die erste seite noch einmal an.",
    "fr": "il fait beau aujourd'hui et nous pourrions aller à la gare. il n'y a aucune raison d'attendre les autres. regarde encore la première page du rapport s'il te plaît.",
    "es": "hoy hace buen tiempo y podríamos caminar hasta la estación. no hay motivo para esperar a los demás. mira otra vez la primera página del informe por favor.",
    "pt": "hoje o tempo está bom e poderíamos caminhar até a estação. não há motivo para esperar pelos outros. olha outra vez a primeira página do relatório por favor.",
    "ru": "сегодня хорошая погода и мы могли бы пойти на вокзал. нет причины ждать остальных. посмотри ещё раз первую страницу отчёта пожалуйста.",
    "zh": "今天天氣很好，我們可以走到車站。沒有理由等其他人。請再看一次報告的第一頁。",
    "ja": "今日は天気がいいので駅まで歩けます。ほかの人を待つ理由はありません。報告書の最初のページをもう一度見てください。",
}


@pytest.fixture(scope="module")
def model():
    texts = [t for t in TEXTS.values() for _ in range(30)]
    labels = [LANGUAGES.index(k) for k in TEXTS for _ in range(30)]
    return train(texts, labels)


CASES = [
    ("How is it?", None, "empty"), ("How is it?", " ​\n", "empty"), (None, "It is fine and we could walk to the station.", None),
    ("How is it?", "We could walk to the sta", "truncated"), ("How is it?", "It is fine. Here is the code:\n```py\nx = 1", "truncated"), ("How is it?", "It is (as far as we know", "truncated"),
    ("How is it?", "It is fine:\n\n- First thing\n- Second thing", None), ("How is it?", "It is fine. 🙂", None), ("How is it?", "It is fine.\n```\nx\n```", None), ("How is it?", "今天很好。因為", "truncated"),
    ("How is it?", "It is fine. Contact: a.b@example.org", None), ("How is it?", "It is fine. Phone: +1 212 555 0194", None), ("How is it?", "Fine.\nBest regards,\nAda Bell", None),
    ("How is it?", "I'm sorry, but I can't help with that request.", "refusal"), ("How is it?", "Thanks for asking. I would rather not get into this topic.", "refusal"),
    ("How is it?", "I can't see your screen, but these steps work. Open the page and look at the first report again.", None),
    ("Wie ist es?", "Es tut mir leid, dabei kann ich nicht helfen.", "refusal"), ("？", "很抱歉，我無法協助這個請求。", "refusal"), ("？", "申し訳ありませんが、そのご依頼にはお応えできません。", "refusal"), ("?", "К сожалению, вынужден отклонить эту просьбу.", "refusal"),
    ("How is it?", "How is it?\nHow is it?", "copy"), ("How is it?", "Hmm. Let's stop here; I am declining to continue with this.", "refusal"), ("Et ça ?", "Je dois malheureusement refuser cette demande.", "refusal"),
    ("Please look at the first page of the report.", "PLEASE LOOK AT THE FIRST PAGE OF THE REPORT", "copy"), ("Please look at the first page.", "You asked: Please look at the first page.", "copy"),
    ("Please look at the first page.", "You asked: Please look at the first page.\nThe first page is about the weather and the station.", None),
    ("How is it?", "I cannot help with that. Please call 112 instead.", "refusal"), ("How is it?", "I can't say enough good things about it; here is help: restart the router and share the log.", None), ("How is it?", "I cannot help with that request. I understand that this matters to you. " * 80, "refusal"),
    ("How is it?", "I cannot help with the tax part, but the rest is simple. Open the page, look at the first report and walk to the station.", None), ("How is it?", "I am not able to share opinions on ticket 48213. Our guidelines say so.", "refusal"), ("Wie ist es?", "Das kann ich nicht sagen, ohne die Zahlen zu sehen. Die erste Seite zeigt den Bahnhof und das Wetter.", None),
    ("How is it?", "It is (as far as we know\nfine.\nWe could walk.", "truncated"), ("How is it?", "It is **quite fine.\nWe could walk.", "truncated"), ("How is it?", "He said \"it is fine.\nWe could walk.", "truncated"), ("How is it?", "It is fine :( but (really) fine. Pick a) or b) now.", None),
    ("How is it?", "It is fine. Write to a.b@example.org for the", "truncated"), ("How is it?", "It is fine. Write to a.b@example.org for details", None), ("How is it?", "It is fine. Version 12", "truncated"),
    ("Go?", "Go? " * 60, "copy"), ("Yes?", "Yes!", "copy"),
    (TEXTS["en"], TEXTS["de"], "wrong_language"), (TEXTS["en"], TEXTS["zh"], "wrong_language"), ("Please answer in German: " + TEXTS["en"], TEXTS["de"], None), (TEXTS["es"], TEXTS["es"] + " Nota.", None),
]


def test_rules(spark, model):
    frame = spark.createDataFrame([(i, p, r) for i, (p, r, _) in enumerate(CASES)], "row_id long, prompt string, reply string")
    got = {r["row_id"]: (r["defect"], r["defects"]) for r in pairs.judged(frame, model).collect()}
    wrong = [(CASES[i], got[i]) for i in got if got[i][0] != CASES[i][2]]
    assert not wrong
    assert all((d is None) == (list(every) == []) for d, every in got.values())


def test_long_and_no_rows(spark, model):
    frame = spark.createDataFrame([(1, "q " * 50_000, "word " * 100_000), (1, "q", "word.")], "row_id long, prompt string, reply string")
    assert pairs.judged(frame, model).count() == 2 and pairs.judged(frame.limit(0), model).count() == 0


#: Refusals and answers in wordings that no phrase was taken from.
DECLINED = (
    "Sorry, I cannot provide instructions for that.", "I'm unable to discuss medical dosages. Please talk to a doctor.", "I won't help with that.",
    "That is not something I can do for you.", "I'm not comfortable with this, so I must decline.",
    "As an AI, I am not permitted to share such details.", "I will not write this letter. Perhaps a lawyer can help you.",
    "I can't in good conscience assist with that.", "Unfortunately I have to refuse.", "Leider kann ich dir dabei nicht weiterhelfen.",
    "Ich darf darauf keine Antwort geben.", "Diesen Wunsch lehne ich ab.", "Ich möchte diese Frage nicht beantworten.",
    "Désolé, je ne peux pas répondre à cette demande.", "Je ne suis pas autorisé à fournir ces informations.", "Je préfère ne pas répondre.",
    "Je dois décliner.", "Lo siento, pero no puedo responder a eso.", "No me es posible ayudarte con este asunto.", "Debo rechazar la solicitud.",
    "Lamento, mas não posso responder a isso.", "Não me é possível ajudar com este tema.", "Tenho de recusar.", "抱歉，我不能提供這方面的資訊。", "恕我無法回答這個問題。",
    "我必須婉拒這個要求。", "对不起，我无法协助您完成这个任务。", "申し訳ございませんが、お答えできません。", "その件についてはお断りいたします。", "ご要望には対応できかねます。", "Извините, я не могу помочь с этим.",
    "Я вынужден отказать в этой просьбе.", "К сожалению, не могу ответить на этот вопрос.",
)
ANSWERED = (
    "I can't stress enough how useful a checklist is. Start with the first page and mark what is missing.",
    "You cannot share a folder that is locked, so unlock it first and try again.",
    "We do not provide a printed version, but the file can be downloaded from the second page and printed at home in a few minutes.",
    "The outline is not able to hold more than ten items; move the rest to the next page.", "If you refuse cookies, the page still works.",
    "He declined the offer in March and took the train home.",
    "Ich kann den Fehler nicht sehen, aber die Tabelle zeigt die falsche Spalte in Zeile vier.",
    "Die Frist kann nicht verschoben werden; der Bericht muss am Freitag fertig sein.",
    "Le fichier ne peut pas être ouvert car il est trop grand ; il faut le diviser en deux parties.",
    "No puedo ver la tabla desde aquí, así que abre la segunda hoja y copia la primera columna.",
    "Não posso confirmar a data, por isso veja o calendário na segunda página antes da reunião.", "這個表格無法顯示超過十列，請把其餘的移到下一頁。",
    "この表は十行以上を表示できません。残りは次のページに移してください。", "Этот файл не может быть открыт, потому что он слишком большой; разделите его на две части.",
    "I am unable to open the file you mention; still, the steps are the same: export the sheet, sort by date and remove the empty rows.",
    "Passengers must not smoke on the platform.",
)


def test_refusals_in_unseen_wordings(spark):
    frame = spark.createDataFrame(list(enumerate(DECLINED + ANSWERED)), "i int, t string")
    got = {r["i"]: r["x"] for r in frame.select("i", pairs.refusal(F.lower("t"), F.lit(None).cast("string")).alias("x")).collect()}
    found, false = sum(got[i] for i in range(len(DECLINED))), sum(got[i] for i in range(len(DECLINED), len(got)))
    assert found >= 0.9 * len(DECLINED) and found >= 0.9 * (found + false)
