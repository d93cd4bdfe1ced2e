"""Problem 4: prompt and reply pairs with defective replies.

Pairs come from the conversations of problem 1. Ordered rules look at each pair: emptiness, unclosed
delimiters and abrupt endings, refusal phrases in eight languages, copied prompts and a mismatch of
script or language. ``defects`` holds every rule that fires, ``defect`` the first.
All rules but the language of Latin-script texts are Column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.textfns import has_visible
from threadloom.llm.langid import LANGUAGES, Model, language_column
from threadloom.session import written

#: Verbs of answering, by which a request would be met.
_EN = r"(?:help|assist|answer|respond|reply|provide|produce|discuss|do|share|continue|comply|engage|fulfil+|support|comment|give|offer|write|go into|get into|advise|handle|process|talk|speak)"
_DE = r"(?:helfen|beantworten|äußern|bereitstellen|antworten|weiterhelfen|unterstützen|dienen|sprechen|liefern|geben|anbieten|nachkommen|eingehen|behandeln)"
_FR = r"(?:aider|répondre|fournir|traiter|donner|proposer|parler|discuter|continuer|produire|assister|satisfaire|accéder)"
_ES = r"(?:ayudar\p{L}*|responder\p{L}*|contestar\p{L}*|ofrecer\p{L}*|tratar|dar\p{L}*|proporcionar\p{L}*|continuar|hablar|atender\p{L}*|compartir\p{L}*|facilitar\p{L}*)"
_PT = r"(?:ajudar\p{L}*|responder\p{L}*|oferecer\p{L}*|tratar|dar|fornecer\p{L}*|continuar|falar|atender\p{L}*|auxiliar\p{L}*|partilhar|compartilhar|prestar)"
_RU = r"(?:помочь|помогать|ответ\p{L}*|отвеч\p{L}*|предостав\p{L}*|дать|давать|обсужд\p{L}*|продолж\p{L}*|говорить|выполн\p{L}*)"
#: Phrases by which a speaker declines, by language: a negation that governs a verb of answering, a few words apart at most, or a verb of refusing.
REFUSALS = {
    "en": rf"(?<!\byou )(?<!\bthey )\b(?:can(?:no|['’])t|can not|won['’]?t|will not|must not|may not|could not|couldn['’]t|do not|don['’]t|(?:am|['’]m|are|['’]re) (?:\p{{L}}+ )?(?:not (?:able|allowed|permitted|going|willing) to|unable to)|not (?:able|allowed|permitted) to|unable to)(?: (?:be|able|to|really|in good conscience|safely|possibly|currently|further)){{0,3}} {_EN}\b"
    rf"|\b(?:have to|must|need to|going to|would like to|['’]?ll) (?:\p{{L}}+ )?(?:decline|refuse|pass)\b|\bi (?:am |must )?(?:\p{{L}}+ )?declin(?:e|ing)\b|\bi refuse\b|\b(?:would|['’]d) rather not\b|\bprefer not to\b|\bnot something i (?:\p{{L}}+ )?(?:may|can|am|will)\b"
    rf"|\b(?:outside|beyond) (?:of )?what i(?:['’]m| am| can| may)\b|\bagainst my (?:guidelines|rules|policy|policies|principles)\b|\b(?:leave|leaving) (?:it|this|that) unanswered\b|\bno can do\b",
    "zh": r"(?:無法|无法|(?<![能可會会])不(?:方便|能|便|可以|願|愿|想|會|会))(?:為您|为您|再|就此|對此|对此)?(?:協助|协助|回答|提供|處理|处理|作答|討論|讨论|回應|回应|幫|帮|談|谈)|恕(?:難|难|無|无|不)|(?:必須|必须|只能|得)(?:拒絕|拒绝|婉拒)|婉拒|不予(?:回答|提供)|超出(?:了)?我",
    "de": rf"\b(?:kann|darf|möchte|will|werde|können|dürfen) (?:ich |wir )?(?:\p{{L}}+ ){{0,4}}(?:nicht|keine\p{{L}}*)\b(?: \p{{L}}+){{0,3}} {_DE}|\bablehnen\b|\blehne (?:ich )?\p{{L}}* ?ab\b|\bübersteigt\b|gehe ich (?:\p{{L}}+ )?nicht ein\b|\bkeine auskunft\b|\bverweiger\p{{L}}+",
    "fr": rf"\bne (?:peux|puis|suis|veux|souhaite|pourrai|dois|saurais) (?:\p{{L}}+ )?pas (?:\p{{L}}+ ){{0,3}}(?:\p{{L}}['’])?{_FR}|\bne pas (?:y |vous )?répondre\b|\bn['’]est pas permis\b|\bne m['’]est pas (?:permis|possible)\b|\bm['’]abst(?:iens|enir)\b|\b(?:dois|préfère|contrainte? de|obligée? de)(?: \p{{L}}+)? (?:refuser|décliner)\b|\bje (?:refuse|décline)\b|sort du cadre|\bje n['’]ai pas le droit\b",
    "es": rf"\bno (?:puedo|debo|voy a|podré|me es posible|quiero) {_ES}|\bno (?:me )?está permitido\b|\bprefiero no\b|\b(?:tengo que|debo|he de) (?:rechazar|declinar|negarme)\b|\bno continúo\b|\bfuera de lo que puedo\b|\bme niego\b",
    "pt": rf"\bnão (?:posso|devo|vou|poderei|consigo|quero) {_PT}|\bnão me é (?:permitido|possível)\b|\bprefiro não\b|\b(?:tenho de|tenho que|preciso|devo) (?:\p{{L}}+ )?(?:recusar|declinar)\b|\b(?:foge|vai além) (?:ao|do) que posso\b|\bfora do que posso\b|\brecuso\b",
    "ja": r"(?:提供|回答|対応|お答え|お応え|お手伝い|お話し|協力|お力添え)(?:は|を|が|に|することは)?(?:でき(?:ません|かねます|ない)|いたしかねます|しかねます)|できかねます|控えさせて|差し控え|お断り|遠慮させて|(?:範囲|権限)を(?:超え|越え)",
    "ru": rf"\bне (?:могу|смогу|вправе|должен|должна|буду|стану|готов\p{{L}}?)(?: \p{{L}}+){{0,2}} {_RU}|вынужден\p{{L}}? (?:\p{{L}}+ )?(?:отклонить|отказать)|отказываюсь|\bне отвечать\b|отвечать не (?:стану|буду)|не дозволен\p{{L}}?|отклонить (?:эту|этот)|за рамки",
}
#: One of these is in every phrase of the same language above, in lower case; a cheap test before the longer one.
REFUSAL_SIGNS = {
    "en": ("can't", "can’t", "won't", "won’t", "couldn't", "couldn’t", "don't", "don’t", "cannot", "cant ", "wont ", "can not", "will not", "must not", "may not", "could not", "do not", "not able", "not allowed", "not permitted", "not going", "not willing", "rather not", "prefer not", "not something", "unable", "declin", "refuse", "to pass", "outside what i", "outside of what i", "beyond what i", "beyond of what i", "against my", "unanswered", "no can do"),
    "de": ("nicht", "keine", "ablehnen", "lehne", "übersteigt", "verweiger"),
    "fr": ("ne peux", "ne puis", "ne suis", "ne veux", "ne souhaite", "ne pourrai", "ne dois", "ne saurais", "ne pas", "pas permis", "ne m'est", "ne m’est", "refus", "déclin", "'abst", "’abst", "sort du cadre", "pas le droit"),
    "es": ("no puedo", "no debo", "no voy", "no podré", "no me ", "no quiero", "no está", "prefiero no", "rechaz", "declin", "negarme", "niego", "fuera de", "no contin"),
    "pt": ("não posso", "não devo", "não vou", "não poderei", "não consigo", "não quero", "não me", "prefiro não", "recus", "declin", "que posso"),
    "zh": ("無法", "无法", "不方便", "不能", "不便", "不可以", "不願", "不愿", "不想", "不會", "不会", "恕", "拒", "不予", "超出"), "ja": ("ません", "かねます", "できない", "控え", "断り", "遠慮", "範囲を", "権限を"),
    "ru": ("не могу", "не смогу", "не вправе", "не долж", "не буду", "не стану", "не готов", "не отвеч", "не дозвол", "вынужден", "отказ", "отклон", "рамки"),
}
#: The stems of the verbs that a German negation governs; the other phrases need none of them.
_GERMAN_STEMS = ("helf", "antwort", "äußer", "bereitstell", "unterstütz", "dien", "sprech", "liefer", "geb", "anbiet", "nachkomm", "geh", "behandel", "auskunft", "lehn", "übersteigt", "verweiger")
#: What a text must hold to be in another alphabet.
_SCRIPTS = {"zh": r"[\x{4e00}-\x{9fff}]", "ja": r"[\x{3040}-\x{30ff}]", "ru": r"[\x{400}-\x{4ff}]"}
#: What stands beside a refusal without answering: courtesies, words about oneself and one's rules, and where else to turn.
COURTESIES = (
    r"\b(?:thanks?|thank you|sorry|apologi[sz]e\w*|apolog(?:y|ies)|understand|interest(?:ed)?|professional|specialist|expert|anything else|something else|on your mind|hmm+|please|regret\w*|unfortunately|happy to|glad to|another (?:topic|question)|hope|appreciate|guidelines?|polic(?:y|ies)|my rules|as an ai|language model|instead|let['’]?s stop|designed to|i wish|safety|different question|lawyer|doctor|physician|therapist|counsel\w*|hotline)\b"
    r"|抱歉|不好意思|諮詢|咨询|專業|专业|其他問題|其他问题|感謝|感谢|謝謝|谢谢|請換|请换|理解|語言模型|语言模型|規定|规定"
    r"|\b(?:entschuldig\w+|leider|danke|fachperson|fachleute|verständnis|tut mir leid|verstehe|sonst noch|bitte|sprachmodell|richtlinien|stattdessen)\b"
    r"|\b(?:désolée?|navrée?|merci|spécialiste|professionnel|comprends|autre (?:chose|question)|malheureusement|modèle de langage|veuillez|règles)\b"
    r"|\b(?:lo siento|gracias|disculpa\w*|lamento|profesional|especialista|entiendo|algo más|por desgracia|modelo de lenguaje|por favor|normas)\b"
    r"|\b(?:desculpe|desculpa|obrigad[oa]|lamento|profissional|especialista|entendo|mais alguma|infelizmente|modelo de linguagem|por favor|regras)\b"
    r"|申し訳|すみません|ありがとう|専門家|ご理解|他に|残念|言語モデル|規定"
    r"|извините|спасибо|сожалению|специалист\w*|понимаю|простите|увы|что-нибудь ещё|языковая модель|пожалуйста|правил\w*"
)
#: Words that part what a speaker declines from what follows.
_CONTRAST = r"(?<=[.!?。！？;；])\s*|\n|,?\s+(?:but|however|yet|instead,|aber|jedoch|mais|cependant|pero|sin embargo|mas|porém|но|однако)\b,?\s*|[，,](?:但|不過|不过)"
ROMANCE = ("fr", "es", "pt")  # a short text of one may be taken for another
SURE = 0.9  # from here on a language stands for the phrases of a refusal
ANSWER_SHARE = 0.3  # a reply whose other sentences hold more of its letters than this answers, whatever it declines
#: Words by which a reply first repeats what was asked.
ECHOES = r"^(?:you (?:asked|wrote|said)|your question(?: was| is)?|the question(?: was| is)?|question|(?:du|sie) (?:fragst|hast gefragt|fragtest)|(?:deine|ihre) frage(?: war| lautet)?|votre question|vous (?:demandez|avez demandé)|tu (?:pregunta|preguntaste)|su pregunta|preguntaste|(?:a )?(?:tua|sua) pergunta|(?:você|vocês) perguntou|perguntou|你的問題是|你的问题是|你問|你问|您的問題是|ご質問(?:は)?|質問|ваш вопрос|твой вопрос|вы спросили|вопрос)\s*[:：]\s*"
#: How a prompt asks for another language, as names of languages after a preposition or verb.
ASKS_LANGUAGE = (
    r"(?i)\b(?:in|into|to|auf|ins|en|em|para o|al|na|по)[ -](?:english|german|french|spanish|portuguese|japanese|russian|chinese|mandarin|englisch\w*|deutsch\w*|französisch\w*|spanisch\w*|portugiesisch\w*|japanisch\w*|russisch\w*|chinesisch\w*|anglais|allemand|français|espagnol|portugais|japonais|russe|chinois|inglés|alemán|francés|español|portugués|japonés|ruso|chino|inglês|alemão|francês|espanhol|português|japonês|russo|chinês|английск\w*|немецк\w*|французск\w*|испанск\w*|португальск\w*|японск\w*|русск\w*|китайск\w*|[а-я]+-?[а-я]*ски)"
    r"|\bпо-(?:английски|немецки|французски|испански|португальски|японски|русски|китайски)"
    r"|(?:用|以|成|譯為|译为|翻成)\s*(?:英文|英語|英语|德文|德語|德语|法文|法語|法语|西班牙文|西班牙語|西班牙语|葡萄牙文|葡萄牙語|日文|日語|日语|俄文|俄語|俄语|中文)|(?:英|ドイツ|フランス|スペイン|ポルトガル|中国|ロシア|日本)語(?:で|に)"
    r"|\b(?:translat|übersetz|tradui|traduc|traduz)\w*|перевед|перевод|翻譯|翻译|翻訳"
)
#: An address, a number or a link that somebody was given: such a note needs no full stop, at its end or a few words on.
CONTACT = r"(?:(?<!\S)[^\s@＠]++[@＠][^\s@＠]+|(?<![^\s(\[])[^\s\[(]++ ?[\[(] ?(?:at|arroba|ät|собака) ?[\])] ?\S+(?: ?[\[(] ?(?:dot|punto|ponto|punkt|точка) ?[\])] ?\S+)*|(?<![\d０-９])[\d０-９][\d０-９ ().+\-－]{4,}|https?://\S+|\b[A-Z]{1,3}\d{5,}\S*|(?<!\d)\d++ \p{Lu}\p{L}*\.?(?: \p{Lu}\p{L}+)+|(?<!\d)\d++(?: bis)?,? (?:rue|avenue|boulevard|bd|impasse|place|chemin|quai)(?: \p{L}+)+|\d[號号])"
_CONTACT_END = rf"(?U){CONTACT}[^\s\p{{L}}\d]*(?:[ ,，]+\p{{L}}+){{0,6}}\s*$|\p{{Lu}}\p{{L}}+,? \d+[a-zA-Z]?\s*$"
#: A version or page number after a word of this kind is no address.
_NO_CONTACT = r"(?iU)\b(?:versi[oó]n|versão|верси\w+|version|seite|page|página|row|table|tabelle|step)\w* \d+\w?\s*$"
#: Words that no sentence ends in.
_HANGING = r"(?iU)(?:^|[\s,，])(?:and|or|but|because|so|so you should|the|an?|of|to|in|for|with|which|that|if|when|while|than|as|e\.g|such as|und|oder|aber|weil|der|die|das|dem|den|ein\w{0,2}|mit|von|zu|für|dass|wenn|zum beispiel|et|ou|mais|parce que|le|la|les|des?|du|une?|pour|avec|que|qui|par exemple|y|o|pero|porque|el|los|las|del|para|con|e|mas|os?|as?|do|da|em|com|по|и|или|но|потому что|что|для|с|в|на|например)\s*$|(?:因為|因为|所以|例如|而且|但是|和|と|が|を|に|は|たとえば)\s*$"
_CLOSED = r"""[.!?。！？…‥][\s"'”’»」』)\]）*_~]*$"""
_ITEM = r"^\s*(?:[-*•]|\d+[.)])\s+\S"


def bare(text: Column) -> Column:
    """Only letters and digits, in lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}]+", ""))


_DELIMITERS = (("(", ")"), ("（", "）"), ("「", "」"), ("『", "』"), ("«", "»"), ("„", "“”"), ("{", "}"))


def _unclosed(marks: Column) -> Column:
    """Whether a text of delimiters alone opens more than it closes, or has an odd number of those that do both."""

    def count(signs: str) -> Column:
        return reduce(lambda n, x: n + F.length(marks) - F.length(F.replace(marks, F.lit(x), F.lit(""))), signs, F.lit(0))

    pairs = reduce(lambda found, p: found | (marks.contains(p[0]) & (count(p[0]) > count(p[1]))), _DELIMITERS, F.lit(False))
    return pairs | (count('"') % 2 == 1) | (count("*") % 4 == 2)


def with_truncation(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``_truncated``: whether the reply breaks off: a code fence, bracket, quotation or bold text that is opened anywhere and not closed, or a last sentence without an end.

    The steps are columns of their own, so that each is computed once a row.
    """
    tail = F.right("reply", F.lit(1)).rlike(r"(?U)[\s\x1c-\x1f\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{FE0F}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]")
    shown = F.regexp_replace("reply", r"(?U)[\s\x1c-\x1f\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{FE0F}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]++$", "")
    rows = pairs.withColumn("_shown", F.coalesce(F.when(tail, shown).otherwise(F.col("reply")), F.lit("")))
    prose = F.regexp_replace(F.regexp_replace("_shown", r"(?s)```.*?```", "\n"), r"\s++$", "")
    rows = rows.withColumn("_prose", F.when(F.col("_shown").contains("```"), prose).otherwise(F.col("_shown")))
    rows = rows.withColumn("_last", F.substring_index("_prose", "\n", -1))
    rows = rows.withColumn("_tail", F.regexp_extract("_last", r"^(?:.*(?:[.!?]\s+|[。！？]))?(.*)$", 1))
    marks = F.regexp_replace(F.regexp_replace("_prose", r"[:;]-?[()]|`[^`\n]*`|(?<!\*)\*(?!\*)|(?m:^\s*[\w]\))", ""), r"[^()（）「」『』«»„“”{}\"*]++", "")
    rows = rows.withColumn("_marks", F.when(F.col("_prose").rlike(r"[(（「『«„{\"*]"), marks).otherwise(F.lit("")))
    last, tail = F.col("_last"), F.col("_tail")
    open_fence = F.col("_shown").contains("```") & (F.size(F.split("_shown", "```", -1)) % 2 == 0)
    closed = last.rlike(_CLOSED)
    data = last.rlike(r"^\s*\|.*\|\s*$|^\s*[{\[].*[}\]]\s*$|^\s*\d{2}:\d{2}:\d{2} \[\w+\]|\{[^{}]*\}\s*$")
    item = last.rlike(_ITEM)
    numbered = last.rlike(r"^\s*\d+[.)]\s") | (F.size(F.split(last, r"\s+")) > 8)
    contact = tail.rlike(_CONTACT_END) & ~tail.rlike(_HANGING) & ~tail.rlike(_NO_CONTACT)
    signed = F.col("_prose").rlike(r"(?U)[,，]\s*\n\s*\p{Lu}\S+(?: \p{Lu}\S*){0,3}\s*$")
    loose = F.when(~closed, has_visible(last) & (~item | numbered) & ~data & ~signed & ~contact).otherwise(F.lit(False))
    broken = open_fence | _unclosed(F.col("_marks")) | (~F.col("_shown").endswith("```") & loose)
    return rows.withColumn("_truncated", broken).drop("_shown", "_prose", "_last", "_tail", "_marks")


def _declines(low: Column, main: Column) -> Column:
    """Whether a text in lower case declines, in its language ``main`` or, where that is null, in any."""

    def test(k: str) -> Column:
        signs = reduce(lambda a, w: a | low.contains(w), REFUSAL_SIGNS[k], F.lit(False))
        if k == "de":
            signs = signs & reduce(lambda a, w: a | low.contains(w), _GERMAN_STEMS, F.lit(False))
        own = main.isNull() | main.isin(*(ROMANCE if k in ROMANCE else (k,)))
        return F.when(own & low.rlike(_SCRIPTS[k]) if k in _SCRIPTS else own, signs & low.rlike(REFUSALS[k])).otherwise(False)

    return reduce(lambda a, b: a | b, map(test, REFUSAL_SIGNS))


def refusal(low: Column, main: Column) -> Column:
    """Whether a reply, given in lower case, declines and gives no answer: of its letters at most ``ANSWER_SHARE`` stand in sentences that neither decline nor are courtesies, whatever its length; ``main`` is its language where that is sure, else null."""
    sentences = F.filter(F.split(low, _CONTRAST), lambda s: s.rlike(r"(?U)[\p{L}]"))
    size = lambda s: F.length(F.regexp_replace(s, r"(?U)[^\p{L}]+", ""))
    idle = lambda s: s.rlike("|".join(REFUSALS.values())) | s.rlike(COURTESIES)
    sums = F.aggregate(
        sentences,
        F.struct(F.lit(0).alias("every"), F.lit(0).alias("answer")),
        lambda a, s: F.struct((a["every"] + size(s)).alias("every"), (a["answer"] + F.when(idle(s), 0).otherwise(size(s))).alias("answer")),
    )
    answers = sums["answer"] > sums["every"] * ANSWER_SHARE
    return F.coalesce(F.when(_declines(low, main), ~answers), F.lit(False))  # a condition, so that the sentences of most replies are never looked at


def said(reply: Column) -> Column:
    """A reply without 'You asked:' and the like in front."""
    return F.regexp_replace(F.regexp_replace(reply, r"(?U)^[\s\x1c-\x1f]++", ""), "(?i)" + ECHOES, "")


def copied(a: Column, b: Column) -> Column:
    """Whether a reply only repeats its prompt, once or more, whole or most of it; both as their bare letters."""
    repeated = (F.length(a) > 0) & (F.length(F.replace(b, a, F.lit(""))) == 0)
    return (F.length(b) > 0) & (repeated | ((F.length(b) * 10 >= F.length(a) * 6) & a.contains(b)))


def _letters_of(result: Column, lang: Column) -> Column:
    return F.coalesce(reduce(lambda rest, i: F.when(lang == LANGUAGES[i], result["letters"][i]).otherwise(rest), range(len(LANGUAGES)), F.lit(0)), F.lit(0))


def judged(pairs: DataFrame, model: Model) -> DataFrame:
    """``pairs`` (row_id, prompt, reply) with ``defects`` (every rule that fires, in order) and ``defect`` (the first or null)."""
    prompt, reply = F.coalesce("prompt", F.lit("")), F.coalesce("reply", F.lit(""))
    read = with_truncation(pairs).withColumns({"_low": F.lower(reply), "_a": bare(prompt), "_b": bare(said(reply)), "_p": language_column(model, prompt), "_r": language_column(model, reply)})
    p, r = F.col("_p"), F.col("_r")
    every = F.aggregate(r["letters"], F.lit(0), lambda n, x: n + x)
    foreign = (
        p["main"].isNotNull()
        & r["main"].isNotNull()
        & (p["main"] != r["main"])
        & (p["confidence"] >= 0.6)
        & (r["confidence"] >= 0.6)
        & (_letters_of(r, p["main"]) * 4 < every)
        & (_letters_of(p, r["main"]) * 4 < F.aggregate(p["letters"], F.lit(0), lambda n, x: n + x))
        & ~prompt.rlike(ASKS_LANGUAGE)
    )
    visible = has_visible(reply)
    rules = {
        "empty": ~visible,
        "copy": visible & copied(F.col("_a"), F.col("_b")),
        "refusal": visible & refusal(F.col("_low"), F.when(r["confidence"] >= SURE, r["main"])),
        "truncated": visible & F.col("_truncated"),
        "wrong_language": visible & foreign,
    }
    fired = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())
    return read.withColumn("defects", fired).withColumn("defect", F.try_element_at("defects", F.lit(1))).drop("_p", "_r", "_truncated", "_low", "_a", "_b")


def prompt_reply_pairs(results: DataFrame, messages: DataFrame) -> DataFrame:
    """(row_id, prompt, reply) of each pair of the rebuilt conversations; texts are fetched by two joins on the row."""
    pairs = results.select(F.explode(F.arrays_zip("prompts", "replies")).alias("p")).select(F.col("p.prompts").alias("_prompt"), F.col("p.replies").alias("row_id"))
    texts = messages.select(F.col("row_id").alias("_row"), F.col("content"))
    asked = pairs.join(texts, F.col("_prompt") == F.col("_row")).select("row_id", F.col("content").alias("prompt"))
    return asked.join(texts, F.col("row_id") == F.col("_row")).select("row_id", "prompt", F.col("content").alias("reply"))


def defective_pairs(results: DataFrame, messages: DataFrame, chats: DataFrame, model: Model) -> DataFrame:
    """(row_id, defect, defects) of the defective replies in conversations of ``chats``.

    Null and blank replies are empty; a reply without a prompt is no pair; rows delivered again count once, by their lowest id.
    """
    ids = chats.where(F.col("id").isNotNull()).select(F.col("id").alias("conversation_id")).distinct()
    own = results.where("outcome in ('kept', 'missing_reply')").join(ids, "conversation_id", "left_semi")
    every = judged(written(prompt_reply_pairs(own, messages), "pairs"), model).select("row_id", "defect", "defects")
    return written(every, "judged").where("defect is not null")  # written first: a filter would have the rules computed twice
