import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import pii, pii_training
from threadloom.llm.boosting import Boosted


@pytest.fixture(scope="module")
def model():
    return pii.fitted()


CASES = [
    ("Mail me: ada.bell@mail.example, thanks.", {("email", "ada.bell@mail.example")}),
    ("You can reach me at ada_bell [at] mail [dot] example. Bye", {("email", "ada_bell [at] mail [dot] example")}),
    ("My cell is (212) 555-0163.", {("phone", "(212) 555-0163")}), ("連絡先：０９０－００００－3820", {("phone", "０９０－００００－3820")}),
    ("SSN 991-67-1395\nOrder 2024-0315-7781 is closed.", {("id_number", "991-67-1395")}), ("Mi DNI es 00008651-D.", {("id_number", "00008651-D")}),
    ("I live at 194 Kiln Court, second floor.", {("address", "194 Kiln Court")}), ("請寄到青禾路二段441號。", {("address", "青禾路二段441號")}), ("J'habite 69 bis, impasse des Merisiers.", {("address", "69 bis, impasse des Merisiers")}),
    ("My name is Ada Bell-Corin.", {("name", "Ada Bell-Corin")}), ("Bell, Ada asked about the export again.", {("name", "Bell, Ada")}), ("我叫陳雨晴。", {("name", "陳雨晴")}),
    ("Build 4.18.2-rc1 is out. The node 10.0.0.12 answers again. SKU KD-55120-884 is sold out.", set()), ("Project Halvern Ridge starts soon. @channel please read.", set()),
    ("", set()), (None, set()), ("Her SSN, 123-45-6789, leaked.", {("id_number", "123-45-6789")}), ("My IBAN is DE89 3704 0044 0532 0130 00.", set()), ("Sarah Thompson will join us tomorrow.", {("name", "Sarah Thompson")}),
    ("Sent by: Hannah Lee", {("name", "Hannah Lee")}), ("Omar Haddad", {("name", "Omar Haddad")}), ("Klaus Müller", {("name", "Klaus Müller")}), ("Иван Петров", {("name", "Иван Петров")}), ("田中太郎", {("name", "田中太郎")}), ("王小明", {("name", "王小明")}),
]


def test_cases(model):
    got = pii.found_spans([t for t, _ in CASES], False, model)
    assert [{(s["kind"], s["text"]) for s in spans} for spans in got] == [v for _, v in CASES]


def test_held_out_examples(model):
    """Sentences of another seed: most values found, little else."""
    found = missed = extra = 0
    examples = list(pii_training.examples(seed=99))
    uses = pii.WordUses.of_texts(text for text, *_ in examples)
    for text, title, values, topics in examples:
        got = {(s["kind"], s["text"]) for s in pii.found_spans([text], title, model, topics, uses)[0]}
        if title and any(k in ("phone", "id_number") for k, _ in values):
            continue  # alone in a title their forms can't always be told apart
        values = {v for v in values if v[0] != "name" or not v[1].islower()}
        found, missed, extra = found + len(got & values), missed + len(values - got), extra + len({g for g in got - values if not g[1].islower()})
    print(found, missed, extra)
    assert found / (found + missed) > 0.85 and extra / (found + extra) < 0.1


def test_redaction(spark, model):
    frame = spark.createDataFrame([("🙂 My name is Ada Bell. cc ada@mail.example on the reply.",), (None,), ("x" * 200_000,), ("nothing",)], "t string")
    spans = frame.select("t", pii.spans_column(F.col("t")).alias("s")).select("t", "s", pii.redacted(F.col("t"), F.col("s")).alias("r")).collect()
    assert spans[0]["r"] == "🙂 My name is [NAME]. cc [EMAIL] on the reply." and spans[1]["r"] is None and spans[2]["r"] == spans[2]["t"] and spans[3]["s"] == []


def test_tables(spark):
    messages = spark.createDataFrame([(1, "Phone: 617-555-0132 or Phone: 617-555-0132"), (2, None)], "row_id long, content string")
    chats = spark.createDataFrame([(5, "Launch plan (ada@mail.example)"), (6, None)], "load_id long, title string")
    assert {tuple(r) for r in pii.redacted_texts(messages, chats).collect()} == {("message", "1", 2, "Phone: [PHONE] or Phone: [PHONE]"), ("title", "5", 1, "Launch plan ([EMAIL])")}
    rows = pii.personal_data(messages, chats).collect()
    assert sorted((r["place"], r["record_key"], r["found_text"], r["first"]) for r in rows) == [("message", "1", "617-555-0132", False), ("message", "1", "617-555-0132", True), ("title", "5", "ada@mail.example", True)]
    assert pii.personal_data(messages.limit(0), chats.limit(0)).count() == 0


def test_titles_of_rare_and_frequent_parts(spark):
    """A name beside a topic of few titles, and a person and a reloaded conversation in more titles than many a topic."""
    han = [(n, f"{t} ({v})" if v else t) for n, (t, v) in enumerate([("料金表", "鳥巣川涼真")] + [("料金表", None)] * 3 + [("閱讀清單", None)] * 40)]
    latin = [(100 + n, t) for n, t in enumerate(["Export script"] * 3 + ["Ada Bellcor / Export script"] * 9 + ["Ada Bellcor / Budget sheet"] * 9 + ["Budget sheet"] * 3)]
    chats = spark.createDataFrame(han + latin, "load_id long, title string")
    rows = {(r["record_key"], r["found_text"]) for r in pii.personal_data(spark.createDataFrame([], "row_id long, content string"), chats).collect()}
    assert rows == {("0", "鳥巣川涼真")} | {(str(n), "Ada Bellcor") for n in range(103, 121)}


#: Frames that no list of cues and no training sentence was taken from.
UNSEEN = {
    "name": ("We all liked what {} showed us on Monday.", "Nobody has seen {} since the move.", "The keys are with {} downstairs.", "According to {}, the numbers are fine.", "A gift for {} arrived.", "Maybe {} could drive.", "{} bought a boat.", "Who invited {}?", "The answer came from {} at noon.", "I owe {} an apology.", "Gestern war {} bei uns.", "Das Paket für {} liegt hier.", "{} wohnt jetzt in der Stadt.", "Le dossier de {} est prêt.", "{} reviendra lundi.", "La carpeta de {} está lista.", "{} vive cerca.", "O carro de {} avariou.", "A reunião com {} correu bem.", "Yours truly,\n{}"),
    "phone": ("You will find me on {} all day.", "Kontakt per Telefon: {}", "Le portable de secours est le {}.", "Mi celular nuevo es {}.", "Meu telefone novo: {}", "新的手機是{}", "Мой мобильный {}"),
    "id_number": ("The officer wrote down passport {}.", "my social security number is {} btw", "Ausweis Nr. {} ist abgelaufen.", "Mon passeport, {}, est perdu.", "Mi DNI termina así: {}", "O CPF dela é {}"),
    "address": ("They rebuilt the house at {} last year.", "The meeting point is {}.", "Das Büro liegt {}.", "Le magasin du {} ferme.", "La fiesta es en {}.", "A loja fica na {}."),
    "email": ("Ping {} when done.", "Die Einladung ging an {}.", "Mon adresse, {}, a changé.", "Mi correo es {}", "O meu mail é {}", "Моя почта {}"),
}


@pytest.mark.parametrize("kind", UNSEEN)
def test_unseen_frames(model, kind):
    """Each kind in wordings that nothing was fitted on, in a corpus of other sentences; names in lower case are counted apart."""
    examples = list(pii_training.examples(77, {kind: UNSEEN[kind]}))
    uses = pii.WordUses.of_texts([t for t, *_ in pii_training.examples(77)] + [t for t, *_ in examples])
    hits, total, extra = 0, 0, 0
    for text, _, values, _ in examples:
        ((_, value),) = values
        got = {(s["kind"], s["text"]) for s in pii.found_spans([text], False, model, {}, uses)[0]}
        extra += len(got - values)
        if kind != "name" or not value.islower():
            hits, total = hits + (values <= got), total + 1
    print(kind, hits, total, extra)
    assert hits >= 0.9 * total and extra <= 0.1 * total


def test_han_names_in_unseen_frames(model):
    frames = ("{}は休みです。", "明日{}さんと話します。", "{}が担当します。", "作成者：{}")
    texts = [(f.format(n), n) for f in frames for n in ("田中太郎", "鈴木一郎", "佐藤花子")]
    assert sum({(s["kind"], s["text"]) for s in pii.found_spans([t], False, model)[0]} == {("name", n)} for t, n in texts) >= 0.9 * len(texts)


def test_word_uses_equal_in_both_engines(spark):
    texts = ["Then Ada met ada@mail.example, Bell and Corin.\nPut Ada first. it is Über allem, Ada!", "ада и Ада Белл. \"Ada\" (put it) I'd put", "", None, "王小明 said A b"]
    mine = pii.WordUses.of_texts(t for t in texts if t is not None)
    theirs = pii.word_uses(spark.createDataFrame([(t,) for t in texts], "_t string"))
    assert (mine.table == theirs.table).all()
    assert mine.share("ada") > mine.share("put") and mine.shares("nowhere") == (128 / 255, 128 / 255)


def test_lower_case_names_need_a_corpus(model):
    corpus = ["We met Velda Kornmark there.", "then Velda Kornmark called", "ask Velda Kornmark today"] * 5
    found = lambda uses: [s["text"] for s in pii.found_spans(["I spoke with velda kornmark yesterday."], False, model, {}, uses)[0]]
    assert found(pii.WordUses.of_texts(corpus)) == ["velda kornmark"] and found(pii.NOTHING_KNOWN) == []


def test_boosting_learns():
    r = np.random.default_rng(1)
    x = r.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int)
    p = Boosted().fit(x, y).probability(x)
    assert ((p > 0.5) == y).mean() > 0.97 and abs(p.mean() - y.mean()) < 0.05
