"""Problem 5: personal data in free text, found and replaced by typed placeholders.

High-recall generators propose overlapping spans of each kind by their shape alone: address forms, numbers, street forms, every window of
two to four capitalised words, runs of Han characters between particles or signs, and pairs of lower-case words that the
corpus mostly writes with capitals. Boosted trees judge every span by its format and its context; spans over the calibrated threshold of their kind are
taken, the surest first, without overlap. What stands around a span, such as a word for a telephone, is a feature and never a condition.
The trees are fitted on sentences that ``pii_training`` writes with random values, so no personal data is needed.

How often the corpus writes a word with a capital inside a sentence is counted over all texts in a sketch of fixed size (``WordUses``).
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.boosting import Boosted
from threadloom.session import written

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}
THRESHOLDS = {"email": 0.5, "phone": 0.4, "id_number": 0.4, "address": 0.5, "name": 0.29}
SPANS = "array<struct<kind:string,start:int,end:int,text:string,score:double,first:boolean>>"
PARTS = "array<struct<part:string,alone:double,titles:bigint>>"
#: Parts of titles, in lower case: the share of their uses where they are the whole title, and the number of different titles they stand in.
Parts = Mapping[str, tuple[float, float]]
SLOT_BITS = 20  # the sketch of word uses: at most so many slots, two counters each, whatever the corpus
BEFORE_CHARS, AFTER_CHARS = 40, 28  # how far the features look around a span


def _class(category: str) -> str:
    """The letters of a category in the alphabets that have capitals, as ranges of a character class."""
    points = [i for i in range(0x41, 0x590) if unicodedata.category(chr(i)) == category]
    out: list[list[int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(chr(a) + ("-" + chr(b) if b > a else "") for a, b in out)


_D = "0-9０-９"
_CAP, _LOW = f"[{_class('Lu')}]", f"[{_class('Ll')}]"
_WORD = rf"{_CAP}(?:{_LOW}+|['’]{_CAP}{_LOW}+)(?:-{_CAP}{_LOW}+)*"
_UPPER = rf"{_CAP}{{2,}}(?:-{_CAP}+)*"
_SMALL = rf"{_LOW}{{2,}}(?:-{_LOW}+)*"
_GLUE = r"(?:de la |de los |de las |del |de l['’]|de |des |du |da |do |dos |das |la |le |les |los |las |der |den |dem |am |an |im |in |zur |zum )"
_NUM = rf"[{_D}]{{1,4}}"
_HAN = "一-鿿々ヶ"

#: Words (lower case) that speak for a kind where they stand beside a value.
CUES = {
    "email": "mail email e-mail mailto inbox contact write cc bcc forward correo courriel adresse escribe escríbeme écrire écris schreib endereço envie почта почту пиши пишите",
    "phone": "phone telephone tel mobile cell cellphone call ring text dial fax whatsapp sms number telefon handy nummer rufnummer anrufen ruf mobil téléphone tél portable numéro appelle appelez appeler rappelle teléfono móvil celular número llama llámame marca telefone telemóvel ligue liga телефон тел звоните позвоните позвони номер наберите",
    "id_number": "ssn passport id identity insurance tax tin national national_id tax_id license licence social security steuer ausweis ausweisnummer personalausweis reisepass reisepassnummer pass versicherungsnummer sozialversicherungsnummer steuernummer passeport fiscal identité sécurité sociale dni nie nif nss pasaporte seguridad cpf rg passaporte contribuinte identidade инн снилс паспорт паспорта полис полиса",
    "address": "address addr ship_to live lives lived street ship deliver delivered delivery parcel moved move office house home flat apartment adresse anschrift wohne wohnt wohnen lieferung zustellung habite habitons livraison livrer domicile vivo vive vivimos dirección domicilio entrega entregar moro mora moramos endereço morada адрес живу живёт живем доставка доставьте",
    "name": "name full_name owner named called mr mrs ms dr prof miss sir dear hi hello herr herrn frau heiße heißt name monsieur madame mme mlle nomme appelle llamo llama señor señora sr sra don doña chamo nome senhor senhora зовут господин госпожа regards sincerely cheers wishes yours thanks grüße grüßen gruß cordialement amitiés saludos saludo abraço abraços atenciosamente cumprimentos уважением",
}
#: The same in Han and Kana, where no blanks part words: what a text ends in just before a value.
HAN_CUES = {
    "email": ("信箱", "郵件", "邮箱", "寄到", "寫信到", "メール", "メールは", "メールアドレス", "メールアドレスは"),
    "phone": ("電話", "电话", "手機", "手机", "打", "撥", "電話番号", "電話番号は", "携帯", "携帯は", "連絡先", "連絡先は"),
    "id_number": ("身分證", "身分證字號", "身份证", "身份证号", "身份证号码", "護照", "護照號碼", "护照号码", "健保卡號", "統一編號", "マイナンバー", "マイナンバーは", "個人番号", "個人番号は", "旅券番号", "旅券番号は", "パスポート番号", "パスポート番号は", "免許証番号", "免許証番号は"),
    "address": ("住在", "住", "地址", "地址是", "寄到", "送到", "辦公室在", "住所", "住所は", "届け先", "届け先は"),
    "name": ("我叫", "我是", "名叫", "叫做", "名字是", "姓名", "聯絡", "联系", "聯繫", "敬上", "此致", "名前は", "担当", "担当は", "氏名"),
}
#: Fixed values (lower case): words beside numbers and names that are nobody's.
NOBODY = "order build sku commit version node score rank budget page pages row rows project model release host port ticket invoice no ratio percent least see minutes items steps job projekt modell begriff bestellung rechnung seite projet modèle terme commande facture proyecto modelo término pedido factura página projeto termo fatura проект модель термин заказ счёт страница module service product tool app table feature server called term dienst label"
#: Fixed values (lower case): what people are and do, beside a name.
PERSON = "mr mrs ms dr prof herrn herr frau monsieur madame m mme señora señor sra sr dona senhora senhor colleague colleagues boss manager friend wife husband sister brother doctor neighbour neighbor kollege kollegin chef chefin freund freundin nachbar nachbarin collègue ami amie voisin voisine compañero compañera amigo amiga jefe jefa colega chefe коллега друг подруга сосед соседка said says asked asks called calls wrote writes told tells met emailed thinks wants joined joins signed will has was is sagt sagte fragt fragte schrieb schreibt meint meinte rief kommt hat dit demande demandé écrit appelle pense dijo dice preguntó pregunta escribió llamó disse pergunta perguntou escreveu ligou сказал сказала спросил спросила написал написала звонил звонила with from by for to mit von bei für avec pour chez con para com с от для у and und et y e и"
_KIND_BITS = {k: 1 << i for i, k in enumerate(KINDS)}
_NOBODY_BIT, _PERSON_BIT = 32, 64


def _cue_table() -> dict[str, int]:
    table: dict[str, int] = {}
    for bit, words in [*((_KIND_BITS[k], w) for k, w in CUES.items()), (_NOBODY_BIT, NOBODY), (_PERSON_BIT, PERSON)]:
        for word in words.split():
            table[word] = table.get(word, 0) | bit
    return table


_CUE = _cue_table()
_TOKEN = re.compile(r"[^\W_]+(?:[_\-][^\W_]+)*|[^\w\s]|\n")

_EMAIL = re.compile(
    r"[A-Za-z0-9][A-Za-z0-9._%+\-]*\s?[@＠]\s?[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z0-9]+"
    r"|[A-Za-z0-9][A-Za-z0-9._%+\-]* ?[\[({<] ?(?:at|AT|arroba|ät|собака) ?[\])}>] ?[A-Za-z0-9\-]+(?:(?: ?[\[({<] ?(?:dot|DOT|punto|ponto|point|punkt|точка) ?[\])}>] ?|\.)[A-Za-z0-9\-]+)+"
    r"|[A-Za-z0-9][A-Za-z0-9._%+\-]* (?:at|AT|arroba|собака) [A-Za-z0-9\-]+(?: (?:dot|DOT|punto|ponto|point|punkt|точка) [A-Za-z0-9\-]+)+"
)
_PHONE = re.compile(rf"(?<![A-Za-z0-9_+/=.,\-])[+＋]?[(（]?[{_D}](?:[ .\-/()（）－–]{{0,2}}[{_D}]){{6,14}}(?![A-Za-z0-9_/=]|\.\d)")
_ID = re.compile(rf"(?<![A-Za-z0-9_+/=.,\-])[A-Z]{{0,2}} ?[{_D}][{_D}A-Z]*(?:[ ./](?=[A-Z]*[{_D}])[{_D}A-Z]+|-[{_D}A-Z]+)*(?![A-Za-z0-9_/=]|\.\d)|(?<![A-Za-z0-9_+/=.,\-])[A-Z][0-9A-Z]{{5,}}(?![A-Za-z0-9_/=])")
_STREETS = (
    rf"{_NUM}[A-Za-z]? (?:[NSEW]\. )?(?:{_CAP}[\w'’]+ ){{1,3}}(?:Street|St|Lane|Ln|Road|Rd|Drive|Dr|Avenue|Ave|Boulevard|Blvd|Court|Ct|Way|Place|Terrace|Close|Row|Square|Crescent|Hill)\b",
    rf"(?:{_CAP}[\wäöüß\-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ufer|ring|damm|steig|graben|pfad)|(?:An der|Am|Im|Zum|Zur|Auf der|Unter den) (?:{_CAP}[\wäöüß]+ ?){{1,3}}) ?{_NUM} ?[a-z]?(?![\w])",
    rf"{_NUM}(?: (?:bis|ter|quater))?,? (?:rue|avenue|av\.|boulevard|bd|impasse|chemin|place|allée|quai|route|square|cours|passage|sentier)(?: {_GLUE}?{_CAP}[\w'’\-]+)+",
    rf"(?:Calle|C/|Avda\.|Avda|Avenida|Plaza|Paseo|Camino|Travesía|Ronda|Rua|R\.|Travessa|Largo|Praça|Alameda|Estrada|Beco|Av\.) ?{_GLUE}?(?:{_CAP}[\wáéíóúñçãõâêô]+,? ?(?:{_GLUE})?){{1,4}}(?:n\.º )?{_NUM}(?![\w])",
    r"(?:ул\.|улица|улице|пер\.|переулок|пр\.|проспект|пр-т|наб\.|набережная|бульвар|б-р|площадь|пл\.|шоссе|проезд) ?(?:[А-ЯЁ][а-яё\-]+,? ?){1,3}(?:д\. ?|дом )?[0-9]{1,4}(?:[а-я](?![а-яё]))?",
    rf"[一-鿿]{{1,4}}?(?:路|街|大道)(?:[一二三四五六七八九十{_D}]+段)?(?:[{_D}]+巷)?(?:[{_D}]+弄)?[{_D}]+[號号]",
    rf"[一-鿿ヶケノぁ-んァ-ヴー]{{1,5}}?[{_D}]+丁目(?:[{_D}]+番地?)(?:[{_D}]+号)?",
)
_ADDRESS = [re.compile((r"(?<![\w/+=.\-])" if i < 5 else "") + f"(?:{s})") for i, s in enumerate(_STREETS)]
#: One of these words is in every match of the address form of the same place.
_STREET_WORDS = (
    (" St", " Lane", " Ln", " Ro", " Rd", " Dr", " Av", " Bo", " Bl", " C", " Way", " Pl", " Ter", " Sq", " Hill"),
    ("str", "weg", "gasse", "allee", "platz", "ufer", "ring", "damm", "steig", "graben", "pfad", "An der ", "Am ", "Im ", "Zum ", "Zur ", "Auf der ", "Unter den "),
    ("rue ", "aven", "av.", "boul", "bd ", "impasse ", "chemin ", "place ", "allée ", "quai ", "route ", "square ", "cours ", "passage ", "sentier "),
    ("Calle", "C/", "Avda", "Avenida", "Plaza", "Paseo", "Camino", "Traves", "Ronda", "Rua ", "R.", "Travessa", "Largo", "Pra", "Alameda", "Estrada", "Beco", "Av."),
    ("ул", "пер", "пр", "наб", "бульвар", "б-р", "пл", "шоссе"),
    ("號", "号"),
    ("丁目",),
)
#: One of these is in every address of electronic mail, also where its signs are written out.
_AT_SIGN = re.compile(r"[@＠]|[\[({<] ?(?:at|arroba|ät|собака)\b| (?:at|arroba|собака) \S+ (?:dot|punto|ponto|point|punkt|точка) ", re.I)
_DIGIT = re.compile(f"[{_D}]")
#: Four digits close together, as in every telephone and identity number.
_DENSE = re.compile(rf"[{_D}](?:[^{_D}]{{0,3}}[{_D}]){{3}}")
#: The sign before a word is looked at behind its first letter: a pattern that begins with a class is found faster.
_RUN = re.compile(rf"{_CAP}(?<![^\W\d_].){_WORD[len(_CAP):]}(?:,? (?:{_CAP}\. |(?:de|del|da|dos|van|von|la|le|bin|ibn|di|du) (?:(?:la|las|los|der|den) )?)?{_WORD})+(?: {_CAP}\.)?")
_UPPER_RUN = re.compile(rf"{_CAP}(?<![^\W\d_].){_CAP}+(?:-{_CAP}+)*(?:,? (?:{_CAP}\. )?{_UPPER})+(?: {_CAP}\.)?(?![^\W\d_])")
_TWO_CAPITALS = re.compile(rf"{_CAP}{_CAP},? {_CAP}")
_PIECE = re.compile(rf"{_WORD}|{_UPPER}")
_LOW_WORD = re.compile(rf"{_LOW}(?<![\w'’\-].){_LOW}+(?:-{_LOW}+)*(?![^\W\d_'’])")
_KANA = re.compile("[ぁ-んァ-ヴ]")
_HAN_RUN = re.compile(rf"[{_HAN}]+")
#: Given names that are common in one language or another.
GIVEN = frozenset("James Mary John Sarah Michael Emma David Anna Robert Laura William Emily Thomas Hannah Daniel Julia Mark Jessica Paul Karen Steven Lisa Peter Linda George Nancy Kevin Alice Brian Rachel Adam Olivia Jack Sophie Omar Fatima Ahmed Aisha Mohammed Leila Ali Noor Yusuf Priya Raj Anita Arjun Wei Ming Klaus Jürgen Hans Ursula Wolfgang Heike Stefan Sabine Andreas Petra Lukas Lena Felix Greta Camille Pierre Marie Jean Luc Claire Antoine Chloé Louis Manon Hugo Élise Juan María José Carmen Carlos Lucía Miguel Elena Javier Marta Diego Sofía Pablo Isabel João Ana Pedro Inês Rui Beatriz Tiago Mariana Иван Анна Сергей Мария Дмитрий Ольга Алексей Елена Николай Наталья Павел Татьяна Андрей Ирина Михаил Светлана".split())
#: Characters that begin many family names of Chinese and Japanese.
_FAMILY = frozenset("王李張张陳陈劉刘楊杨黃黄趙赵吳吴周徐孫孙馬马朱胡郭何林高羅罗鄭郑梁謝谢宋唐許许鄧邓韓韩馮冯曹彭曾蕭萧田董潘袁蔡蔣蒋余于杜葉叶程魏蘇苏呂吕丁任盧卢姚沈鍾钟姜崔譚谭陸陆范汪廖石金韋韦賈贾夏付方鄒邹熊白孟秦邱江尹薛雷侯龍龙史陶黎賀贺顧顾毛郝龔龚邵萬万嚴严賴赖洪武莫孔杭桑屠闕厲酆柏霍詹佐鈴木中山小川松井野村藤歐司諸遠近原岡谷池坂長橋三黒鳥雲椿")
#: Characters of many given names, Chinese and Japanese.
_GIVEN_HAN = frozenset("志明偉伟俊傑杰家豪雅婷怡君淑芬美玲惠國国建文宗承翰宇軒轩子涵思雨欣妍詩诗佳慧娟麗丽華华秀英敏靜静強强磊洋勇軍军娜濤涛超剛刚平輝辉桂紅红玉蘭兰鳳凤梅琳素雲云蓮莲雪榮荣霞香月媛瑞凡嘉瓊琼珍貞莉晴哲芸希澄遠禾若安昱寧宁允桐采語芷彤萱語晨睿博浩天宸奕澤泽辰逸恩安琪太郎花一二三美咲翔健陽大輔直樹拓也愛結衣悠真葵誠久雄涼凪沙彩香奈菜優和恵子")
#: Particles, pronouns and verbs that often stand just before or just after a name, in Chinese and Japanese.
_LEFT = frozenset("叫是絡络繫系找給给跟和與与由請请對对向讓让問问見见聽听陪替幫帮等及或、，。：「『（(\"' \n・のはがをにとへもで")
_RIGHT = frozenset("說说問问是在的確确先小女也和跟與与您你請请上下今昨明已會会將将要來来去寫写講讲想提有沒没不還还都給给同老敬，。、！？」』）)\"' \n様氏さはがをにとへもでのくちよ")
_NAME_END = frozenset("様氏さく先小女敬")


@functools.lru_cache(maxsize=65536)
def _starts_none(word: str) -> float:
    """Whether a word begins a sentence or a phrase and no name."""
    return float(bool(_FUNCTION.fullmatch(word)))


#: Words that begin a sentence or a phrase and no name, in seven languages.
_FUNCTION = re.compile(
    r"(?:the|an?|this|that|these|those|my|your|our|his|her|their|its?|i|we|you|he|she|they|in|on|at|by|for|from|to|of|with|without|under|over|after|before|between|about|as|and|or|but|if|when|while|because|so|then|there|here|what|which|who|how|why|where|is|are|was|were|be|do|does|did|can|could|should|would|will|may|must|not|no|yes|all|any|some|each|every|more|only|also|just|please|use|try|make|move|see|note|add|set|get|let|open|read|run|check|next|last|best|kind|many|one|two|first|second"
    r"|der|die|das|den|dem|des|ein\w{0,2}|mein\w*|dein\w*|sein\w*|ihr\w*|unser\w*|kein\w*|dies\w*|jed\w*|ich|du|er|sie|es|wir|und|oder|aber|wenn|weil|dass|als|wie|was|wer|wo|warum|im|am|an|auf|ab|bei|mit|nach|von|vom|vor|zu|zum|zur|für|über|unter|zwischen|ohne|während|nicht|auch|nur|noch|bitte|hier|dann|welche\w*|viele?\w*|liebe\w*|kann\w*|ist|sind|war|hat"
    r"|le|la|les|une?|des|du|de|mon|ma|mes|ton|ta|tes|son|sa|ses|notre|nos|votre|vos|leurs?|ce|cette|ces|je|tu|il|elle|nous|vous|ils|et|ou|mais|si|quand|que|qui|comment|pourquoi|dans|en|sur|sous|avec|sans|pour|par|entre|chez|après|avant|pas|est|sont|peux"
    r"|el|los|las|una?s?|mis?|tus?|sus?|este|esta|estos|estas|ese|esa|yo|y|o|pero|cuando|cómo|qué|por|para|con|sin|sobre|bajo|es|son|no"
    r"|os?|as?|um|uma|uns|umas|meu|minha|seu|sua|nosso|nossa|eu|ele|ela|e|mas|se|como|em|na|nos?|do|da|dos|com|sem|sob|não|são"
    r"|и|а|но|или|если|когда|как|что|кто|где|это|эт\w{1,3}|мой|моя|мои|наш\w*|ваш\w*|он|она|они|мы|вы|я|в|во|на|по|под|над|с|со|из|от|до|для|за|между|без|не|нет)",
    re.I,
)


class WordUses:
    """How the corpus writes its words: for each slot of a sketch the share of all uses that have a capital inside a sentence, and of those without a capital.

    Names have capitals inside sentences too, words that only begin sentences don't. A word goes to the slot of its CRC; words that share a slot blur each
    other, by about one word in ``2**SLOT_BITS`` distinct ones each. A word without evidence has a half of both.
    """

    def __init__(self, slots: np.ndarray | None = None, inside: np.ndarray | None = None, small: np.ndarray | None = None):
        self.table = np.full((1 << SLOT_BITS, 2), 128, np.uint8)
        if slots is not None and len(slots):
            self.table[slots, 0], self.table[slots, 1] = inside, small
        self.known: dict[str, tuple[float, float]] = {}
        self.capital: dict[str, bool] = {}

    def __getstate__(self) -> dict:
        return {"table": self.table, "known": {}, "capital": {}}

    def shares(self, word: str) -> tuple[float, float]:
        """(with a capital inside a sentence, without a capital) of a word in any case."""
        if (found := self.known.get(word)) is None:
            if len(self.known) > 500_000:
                self.known.clear()
            row = self.table[zlib.crc32(word.lower().encode()) & ((1 << SLOT_BITS) - 1)]
            found = self.known[word] = (float(row[0]) / 255, float(row[1]) / 255)
        return found

    def share(self, word: str) -> float:
        return self.shares(word)[0]

    def is_capital(self, word: str) -> bool:
        """Whether a lower-case word is one that mostly has a capital."""
        if (found := self.capital.get(word)) is None:
            if len(self.capital) > 500_000:
                self.capital.clear()
            inside, small = self.shares(word.split("-")[0])
            found = self.capital[word] = small < 0.3 and inside > 0.15
        return found

    @staticmethod
    def of_counts(slots: np.ndarray, small: np.ndarray, inside: np.ndarray, leading: np.ndarray) -> "WordUses":
        every = small + inside + leading + 1
        return WordUses(slots.astype(np.int64), np.round(255 * (inside + 0.5) / every).astype(np.uint8), np.round(255 * (small + 0.5) / every).astype(np.uint8))

    @staticmethod
    def of_texts(texts: Iterable[str]) -> "WordUses":
        """The same count as ``word_uses``, for a list of texts."""
        counts = np.zeros((1 << SLOT_BITS, 3))
        for text in texts:
            for word in _USE.findall("\n" + text):
                bare = word.lstrip(word[0]) if not word[0].isalpha() else word
                counts[zlib.crc32(bare.lower().encode()) & ((1 << SLOT_BITS) - 1), 2 if bare != word else int(word[0].isupper())] += 1
        seen = np.flatnonzero(counts.sum(axis=1))
        return WordUses.of_counts(seen, counts[seen, 0], counts[seen, 1], counts[seen, 2])


#: A word with a capital inside a sentence, one without, or one with a capital elsewhere behind the sign or blank before it.
_USE = re.compile(rf'(?<={_LOW} ){_CAP}{_LOW}+|(?<=[,;] ){_CAP}{_LOW}+|(?<![^\s("“]){_LOW}{{2,}}(?=[\s,;:!?)"”]|\.?(?!\S))|(?:(?<!{_LOW})(?<![,;]) |[\n\d_]|[^\w ]){_CAP}{_LOW}+')
#: The same for the JVM.
_USE_PATTERN = r'(?<=[\p{Ll},;] )\p{Lu}\p{Ll}+|(?<![^\s("“])\p{Ll}{2,}(?=[\s,;:!?)"”]|\.?(?!\S))|(?:(?<![\p{Ll},;]) |[^\p{L} ])\p{Lu}\p{Ll}+'


def word_uses(texts: DataFrame) -> WordUses:
    """The word uses of all rows of ``texts`` (_t): one aggregate to at most ``2**SLOT_BITS`` rows, which come to the driver."""
    lined = F.concat(F.lit("\n"), "_t")
    words = texts.where("_t is not null").select(F.explode(F.regexp_extract_all(lined, F.lit(_USE_PATTERN), 0)).alias("_w"))
    leading = F.col("_w") < "A"  # a sign or blank stands first
    low = F.lower(F.when(leading, F.substring("_w", 2, 1 << 20)).otherwise(F.col("_w")))
    form = F.when(F.col("_w") == low, 0).when(leading, 2).otherwise(1)
    rows = words.select(F.crc32(low).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).cast("int").alias("slot"), form.alias("form"))
    counts = rows.groupBy("slot").agg(*[F.count_if(F.col("form") == i).alias(c) for i, c in enumerate(("small", "inside", "leading"))])
    found = counts.toPandas()
    return WordUses.of_counts(*(found[c].to_numpy(float) for c in ("slot", "small", "inside", "leading")))


def _windows(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Every window of two to four words in a run of words that begin with capitals; a comma only parts one family name from given names."""
    pieces = [m.span() for m in _PIECE.finditer(text, start, end)]
    commas = [text.find(",", a[1], b[0]) >= 0 for a, b in zip(pieces, pieces[1:])]
    for i in range(len(pieces)):
        for j in range(i + 1, min(i + 4, len(pieces))):
            inside = commas[i:j]
            if any(inside[1:]) or (inside[0] and j - i > 2):
                continue
            stop = pieces[j][1]
            yield pieces[i][0], stop
            if inside[0] and j == len(pieces) - 1 and stop < end:
                yield pieces[i][0], end  # an initial at the end


def _small_spans(text: str, uses: WordUses) -> Iterator[tuple[int, int]]:
    """Windows of two or three lower-case words that the corpus mostly writes with capitals."""
    named = {w for w in _LOW_WORD.findall(text) if uses.is_capital(w)}
    if not named:
        return
    spots = [m.span() for m in _LOW_WORD.finditer(text) if m.group() in named]
    for i in range(len(spots) - 1):
        for j in range(i + 1, min(i + 3, len(spots))):
            between = text[spots[j - 1][1] : spots[j][0]]
            if not re.fullmatch(rf",? |{'' if j > i + 1 else ' '}{_LOW}\. ", between):
                break
            yield spots[i][0], spots[j][1]


def _han_spans(text: str) -> Iterator[tuple[int, int]]:
    """Spans of Han characters of the length of a name that begin with a family name's character, or near one at the start of their run; longer ones between signs and particles."""
    kana = bool(_KANA.search(text))
    for m in _HAN_RUN.finditer(text):
        a, b = m.span()
        for i in range(a, b - 1):
            family = text[i] in _FAMILY
            begins = i == a or text[i - 1] in _LEFT
            if family or (kana and begins and not _FAMILY.isdisjoint(text[i + 1 : i + 3])):
                for j in range(i + 2, min(i + (6 if begins or kana else 3), b) + 1):
                    if j - i < 4 or j == b or text[j] in _RIGHT:
                        yield i, j


def _street_forms(text: str) -> Iterator[int]:
    """The address forms that a text may have."""
    for g, words in enumerate(_STREET_WORDS):
        for word in words:
            if word in text:
                yield g
                break


def _spans(text: str, title: bool, uses: WordUses) -> Iterator[tuple[int, int, int, int]]:
    """(kind, start, end, generator) of every candidate."""
    if "@" in text or "＠" in text or _AT_SIGN.search(text):
        for m in _EMAIL.finditer(text):
            yield 0, m.start(), m.end(), 0
    if _DIGIT.search(text):
        for m in _PHONE.finditer(text) if _DENSE.search(text) else ():
            inner = m.group()[:1] in "(（" and not re.search("[)）]", m.group())
            yield 1, m.start() + inner, m.end(), 1
        for m in _ID.finditer(text) if _DENSE.search(text) else ():
            value = m.group()
            lead = len(value) - len(value.lstrip())
            if re.search(r"[+0-9)] ?$", text[max(0, m.start() + lead - 2) : m.start() + lead]):
                continue  # the rest of a longer number
            if len(value.strip()) >= 5 and sum(c.isdigit() for c in value) >= 4:
                yield 2, m.start() + lead, m.end(), 2
        for g in _street_forms(text):
            for m in _ADDRESS[g].finditer(text):
                end = m.end() - (len(m.group()) - len(m.group().rstrip(" ,")))
                yield 3, m.start(), end, 3 + g
                if g > 4:  # no blank parts a street of Han characters from what stands before it: any later start may be right
                    for start in range(m.start() + 1, m.start() + 6):
                        if start < end - 2 and text[start] not in "路街丁" and not text[start].isdigit():
                            yield 3, start, end, 3 + g
    for m in _RUN.finditer(text):
        for start, end in _windows(text, *m.span()):
            yield 4, start, end, 10
    if _TWO_CAPITALS.search(text):
        for m in _UPPER_RUN.finditer(text):
            for start, end in _windows(text, *m.span()):
                yield 4, start, end, 11
    for start, end in _small_spans(text, uses):
        yield 4, start, end, 12
    if not text.isascii():
        for start, end in _han_spans(text):
            yield 4, start, end, 13
    if title:
        for m in _TITLE_HAN.finditer(text):
            yield 4, m.start("v"), m.end("v"), 14
        for m in _TITLE_SMALL.finditer(text):
            yield 4, m.start("v"), m.end("v"), 15


_TITLE_HAN = re.compile(rf"(?:^|[/:：(（]\s?|\s)(?P<v>[{_HAN}]{{2,6}})(?=\s?[/:：(（)）]|\s|$)")
_TITLE_SMALL = re.compile(rf"(?:^|[/:(] ?)(?P<v>{_SMALL}(?: {_LOW}\.)?,? {_SMALL}(?: {_SMALL})?)(?=\)?$| ?[/:(]| {_CAP})")


def _checks(value: str) -> float:
    """How many of the common check rules a number keeps: Luhn, mod 97, mod 11 of a tax number, the letter of a Spanish one."""
    digits = [int(c) for c in value if c.isdecimal()]
    n = len(digits)
    total = 0
    if n >= 8:
        total += sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
        whole = int("".join(map(str, digits)))
        total += n == 15 and (97 - whole // 100 % 97) == whole % 100
        if n == 11:
            first = sum(d * w for d, w in zip(digits, range(10, 1, -1))) * 10 % 11 % 10
            second = sum(d * w for d, w in zip(digits, range(11, 1, -1))) * 10 % 11 % 10
            total += first == digits[9] and second == digits[10]
        if n == 8 and value.strip()[-1:].isalpha():
            total += "TRWAGMYFPDXBNJZSQVHLCKE"[whole % 23] == value.strip()[-1].upper()
    return float(total)


def _beside(text: str, start: int, end: int) -> set[str]:
    """What a title says beside a span, in lower case: the whole rest and its parts."""
    rest = {(text[:start] + text[end:]).strip(" /:：()（）"), *re.split(r"[/:：(（)）\s]+", text[:start] + "/" + text[end:]), *re.split(r"[/:：(（)）]", text[:start] + "/" + text[end:])}
    return {x for x in (y.strip().rstrip(" 0123456789").lower() for y in rest) if x}


def _weights(text: str, start: int, end: int, parts: Parts) -> list[float]:
    """How a span of a title and the most used part beside it are used in all titles; sizes in powers of two, so that only relations count."""
    own = parts.get(text[start:end].lower(), (0.0, 0.0))
    rest = max((parts[x] for x in _beside(text, start, end) if x in parts), key=lambda w: w[1], default=(0.0, 0.0))
    n, m = np.log2(1 + own[1]), np.log2(1 + rest[1])
    return [own[0], float(n), rest[0], float(m), float(m - n)]


_NO_FORMAT, _NO_WEIGHTS, _NO_STANDING = [0.0] * 14, [0.0] * 5, [0.0] * 21


def _format(value: str, kind: int) -> list[float]:
    groups = re.split(r"[^0-9A-Z０-９]+", value.strip("()+（）＋"))
    return [
        float(sum(c.isdigit() for c in value)), float(sum(c.isalpha() for c in value)), float(len(groups)), float(value[:1] in "+＋"), float("(" in value or "（" in value),
        float(sum(c in " -./－" for c in value)), float(bool(re.match(r"(?:19|20)\d\d[-./]\d\d", value))), float(len(groups[0])), float(len(groups[-1])), float(max(map(len, groups))),
        float(value[:1] in "0("), float(next((int(c) for c in value if c.isdecimal()), -1)), _checks(value) if kind in (1, 2) else 0.0, float("." in value),
    ]


def _standing(text: str, start: int, end: int, before: str, after: str, generator: int, uses: WordUses) -> list[float]:
    """What the words of a name-shaped span are elsewhere, and where it stands."""
    value = text[start:end]
    if generator in (13, 14):
        left, right = text[start - 1 : start], text[end : end + 1]
        return [
            float(end - start), float(value[0] in _FAMILY), float(left in _LEFT if left else 2), float(right in _RIGHT if right else 2), float(right in _NAME_END if right else 0),
            float(not left or unicodedata.category(left)[0] in "PZC"), float(not right or unicodedata.category(right)[0] in "PZC"), float("ぁ" <= left <= "ん"), float("ぁ" <= right <= "ん"),
            float(left in _NAME_LEFT if left else 0), sum(c in _GIVEN_HAN for c in value[1:]) / (end - start - 1), float(value[-1] in _GIVEN_HAN), float(end - start > 3 and value[1] in _FAMILY_SECOND), *_NO_STANDING[13:],
        ]
    words = [w for w in value.replace(",", " ").split() if len(w) > 2]
    known = [uses.shares(w.split("-")[0]) for w in words] or [(0.5, 0.5)]
    shares, small = [k[0] for k in known], [k[1] for k in known]
    line_start, line_end = not before or before[-1] == "\n", not after or after[0] == "\n"
    left = before.rstrip(" -*•(\"“„«")
    previous = before[before.rfind(" ", 0, len(before) - 1) + 1 : -1].rstrip(".") if before[-1:] == " " else ""
    found = _NEXT_WORD.match(after)
    following = found.group(1) if found else ""
    previous = previous if previous[:1].isalpha() else ""
    near = lambda w: uses.share(w.split("-")[0]) if w[:1].isupper() else 0.0
    line = text[max(text.rfind("\n", 0, start) + 1, start - 120) : min((text.find("\n", end) + 1 or len(text) + 1) - 1, end + 120)] if value.isupper() else ""
    over = text[max(0, text.rfind("\n", 0, max(0, start - 1)) + 1) : max(0, start - 1)] if line_start and start else ""
    return [
        float(len(words)), shares[0], shares[-1], small[0], max(small), _starts_none(words[0] if words else ""), float(any(_starts_none(w) for w in words[1:])), float("," in value), float("." in value),
        float(value.isupper()) + 2.0 * value.islower(), float("-" in value), float(not left or left[-1] in "\n.!?:;。！？："), float(line_start), float(line_end), near(previous), near(following),
        float(bool(line) and sum(map(str.isupper, line)) > 2 * sum(map(str.islower, line)) and len(line) > 2 * (end - start)), float(over.rstrip().endswith((",", "，", "!")) or 0 < len(over) < 30),
        float(any(w.title() in GIVEN for w in words)),
        float(following[:1].islower()) + 2.0 * (after[:1].isdecimal() or (after[:1] in " -" and after[1:2].isdecimal())), float(previous[:1].islower()),
    ]


_NEXT_WORD = re.compile(r",? ([^\W\d_][\w'’\-]*)")
#: Second characters of many family names of Japanese.
_FAMILY_SECOND = frozenset("藤木橋中本村林田上水崎口川島原野井山沢澤辺部岡谷戸巣")
_NAME_LEFT = frozenset("叫是絡络繫系找跟給")


def _features(text: str, kind: int, start: int, end: int, generator: int, title: bool, parts: Parts, uses: WordUses) -> list[float]:
    value, before, after = text[start:end], text[max(0, start - BEFORE_CHARS) : start], text[end : end + AFTER_CHARS]
    own, others = _KIND_BITS[KINDS[kind]], 31 & ~_KIND_BITS[KINDS[kind]]
    cue = other = nobody = person = 0.0
    near = before[before.rfind("\n") + 1 :] if kind < 3 else before  # a word for a number stands on its line
    said, follows = _TOKEN.findall(near.lower()), _TOKEN.findall(after.lower())
    for distance, word in enumerate(reversed(said[-6:]), 1):
        if bits := _CUE.get(word, 0):
            weight = 1 / distance
            cue, other = max(cue, weight * bool(bits & own)), max(other, weight * bool(bits & others))
            nobody, person = max(nobody, weight * bool(bits & _NOBODY_BIT)), max(person, weight * bool(bits & _PERSON_BIT))
    quoted = before.rstrip("：:，, 　")
    if quoted.endswith(HAN_CUES[KINDS[kind]]):
        cue = 2.0
    elif not quoted.isascii() and any(quoted.endswith(HAN_CUES[k]) for k in KINDS if k != KINDS[kind]):
        other = 2.0
    bits = [_CUE.get(w, 0) for w in follows[:3]]
    key = before.endswith(('": "', "': '", '":"'))
    key_cue = _CUE.get(said[-4], 0) if key and len(said) > 3 else 0
    edge = title and bool(re.search(r"(?:^|[/:：(（] ?)$", before)) or title and bool(re.search(r"^\s?(?:[/:：(（)）]|$)", after))
    return [
        float(kind), float(generator), float(len(value)), cue, other, nobody, person, float(any(b & own for b in bits)), float(any(b & _PERSON_BIT for b in bits)),
        float(key) * (1.0 if key_cue & own else -1.0), float(not before or before[-1] == "\n"), float(not after or after[0] == "\n"), float(title), float(edge),
        *(_format(value, kind) if kind < 4 else _NO_FORMAT), *(_weights(text, start, end, parts) if title and kind == 4 else _NO_WEIGHTS),
        *(_standing(text, start, end, before, after, generator, uses) if kind == 4 else _NO_STANDING),
    ]


NOTHING_KNOWN = WordUses()


def candidates(text: str, title: bool = False, parts: Parts = {}, uses: WordUses = NOTHING_KNOWN) -> tuple[list[tuple[int, int, int]], list[list[float]]]:
    spans, rows = [], []
    for kind, start, end, generator in _spans(text, title, uses):
        if end > start:
            inside = kind == 4 and any(k != 4 and s < end and start < e for k, s, e in spans)  # part of a street or address
            spans.append((kind, start, end))
            rows.append([*_features(text, kind, start, end, generator, title, parts, uses), float(inside)])
    return spans, rows


class Judge:
    """Trees of their own for each kind: the same format speaks for one kind and against another."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        groups = self._groups(x)
        self.trees = {k: Boosted(depth=5, rounds=70).fit(x[groups == k], y[groups == k]) for k in np.unique(groups)}

    @staticmethod
    def _groups(x: np.ndarray) -> np.ndarray:
        """Kinds; names of Han characters have trees apart, as their features mean other things."""
        return x[:, 0] + ((x[:, 1] == 13) | (x[:, 1] == 14))

    def probability(self, x: np.ndarray) -> np.ndarray:
        out, groups = np.zeros(len(x)), self._groups(x)
        for k, trees in self.trees.items():
            rows = groups == k
            out[rows] = trees.probability(x[rows])
        return out


@functools.lru_cache(maxsize=1)
def fitted() -> Judge:
    """The trees, fitted on written examples; the same in every process. A third of the sentences with values is read without knowledge of word uses."""
    from threadloom.llm.pii_training import examples, usual_shares

    written_examples = list(examples())
    uses = WordUses.of_texts(text for text, *_ in written_examples)
    uses.known.update(usual_shares())
    x, y = [], []
    for n, (text, title, values, parts) in enumerate(written_examples):
        spans, rows = candidates(text, title, parts, NOTHING_KNOWN if n % 3 == 0 and values else uses)
        for (kind, start, end), row in zip(spans, rows):
            x.append(row)
            y.append(int((KINDS[kind], text[start:end]) in values))
    return Judge(np.array(x, float), np.array(y))


def _chosen(spans: list, scores: np.ndarray) -> list[tuple[int, int, int, float]]:
    order = sorted(range(len(spans)), key=lambda i: (-round(scores[i], 2), -(spans[i][2] - spans[i][1]), spans[i][1]))
    taken: list[tuple[int, int, int, float]] = []
    for i in order:
        kind, start, end = spans[i]
        if scores[i] >= THRESHOLDS[KINDS[kind]] and all(end <= s or start >= e for _, s, e, _ in taken):
            taken.append((kind, start, end, float(scores[i])))
    return sorted(taken, key=lambda t: t[1])


def found_spans(texts: list[str | None], title: bool, model: Judge, parts: Parts = {}, uses: WordUses = NOTHING_KNOWN) -> list[list[dict]]:
    """The chosen spans of each text, ``first`` where the same value doesn't stand earlier in it; null and blank texts have none."""
    spans, rows, counts = [], [], []
    for text in texts:
        s, r = candidates(text, title, parts, uses) if text else ([], [])
        spans.append(s)
        rows += r
        counts.append(len(s))
    scores = model.probability(np.array(rows, float)) if rows else np.zeros(0)
    out, at = [], 0
    for text, own, n in zip(texts, spans, counts):
        seen: set[tuple[int, str]] = set()
        found = []
        for k, s, e, p in _chosen(own, scores[at : at + n]) if n else ():
            found.append({"kind": KINDS[k], "start": s, "end": e, "text": text[s:e], "score": p, "first": (k, text[s:e]) not in seen})
            seen.add((k, text[s:e]))
        out.append(found)
        at += n
    return out


def spans_column(text: Column, parts: Column | None = None, uses: WordUses = NOTHING_KNOWN) -> Column:
    """The personal data of a text, or of a title with the parts beside it, as an array of spans (offsets in code points). The trees travel with the plan."""
    model = fitted()

    @F.pandas_udf(SPANS)
    def in_text(texts: pd.Series) -> pd.Series:
        return pd.Series(found_spans(texts.where(texts.notna(), None).tolist(), False, model, uses=uses))

    @F.pandas_udf(SPANS)
    def in_title(texts: pd.Series, beside: pd.Series) -> pd.Series:
        known = {p["part"]: (p["alone"], p["titles"]) for row in beside for p in row}
        return pd.Series(found_spans(texts.where(texts.notna(), None).tolist(), True, model, known, uses))

    return in_text(text) if parts is None else in_title(text, parts)


def title_keys(title: Column, uses: WordUses = NOTHING_KNOWN) -> Column:
    """The parts to be weighed for the name-shaped spans of a title: these spans and what stands beside them."""

    def keys(text: str) -> list[str]:
        spans = [(start, end) for kind, start, end, _ in _spans(text, True, uses) if kind == 4 and end > start]
        return sorted({text[s:e].lower() for s, e in spans}.union(*(_beside(text, s, e) for s, e in spans)))

    @F.pandas_udf("array<string>")
    def run(titles: pd.Series) -> pd.Series:
        return titles.map(keys)

    return run(title)


def redacted(text: Column, spans: Column) -> Column:
    """The text with a typed placeholder in each span; null for null, the rest as it stands."""
    pieces = F.aggregate(
        spans,
        F.struct(F.lit(1).alias("at"), F.lit("").alias("done")),
        lambda a, s: F.struct(
            (s["end"] + 1).alias("at"),
            F.concat(a["done"], F.substring(text, a["at"], s["start"] + 1 - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("done"),
        ),
    )
    return F.concat(pieces["done"], F.substring(text, pieces["at"], F.length(text)))


def title_parts(chats: DataFrame) -> DataFrame:
    """(part, alone, titles) of every part of a title, in lower case: the share of its uses where it is the whole title (topics are, names hardly), and the number of different titles it stands in."""
    title = F.lower(F.regexp_replace("title", r"(?U)[\s\d]+$", ""))
    rows = chats.select(title.alias("_t")).where("_t <> ''").groupBy("_t").agg(F.count("*").alias("_n"))
    part = F.explode(F.array_distinct(F.transform(F.split("_t", r"[/:：(（)）]"), lambda p: F.regexp_replace(p, r"(?U)^\s+|[\s\d]+$", "")))).alias("part")
    alone = F.sum(F.when(F.col("part") == F.col("_t"), F.col("_n")).otherwise(0)) / F.sum("_n")
    return rows.select("_t", "_n", part).where("part <> ''").groupBy("part").agg(alone.alias("alone"), F.count("*").alias("titles"))


def weighed_titles(chats: DataFrame, uses: WordUses = NOTHING_KNOWN) -> DataFrame:
    """(record_key, _t, _p) of each title that isn't null, with the weights of the parts its name-shaped spans need, joined by part."""
    rows = chats.where("title is not null").select(F.col("load_id").cast("string").alias("record_key"), F.col("title").alias("_t"))
    keyed = written(rows.withColumn("_k", title_keys(F.col("_t"), uses)), "title-keys")
    none = keyed.where(F.size("_k") == 0).select("record_key", "_t", F.array().cast(PARTS).alias("_p"))
    weight = F.when(F.col("titles").isNotNull(), F.struct("part", "alone", "titles"))
    some = keyed.where(F.size("_k") > 0).select("record_key", "_t", F.explode("_k").alias("part")).join(title_parts(chats), "part", "left")
    return none.unionByName(some.groupBy("record_key", "_t").agg(F.collect_list(weight).cast(PARTS).alias("_p")))


def spotted_texts(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """(place, record_key, _t, spans) of each message and title that isn't null; ``spans`` is empty where nothing is found."""
    texts = messages.where("content is not null").select(F.col("row_id").cast("string").alias("record_key"), F.col("content").alias("_t"))
    uses = word_uses(texts)  # of running text: in titles a name begins the line as any word does
    said = texts.select(F.lit("message").alias("place"), "record_key", "_t", spans_column(F.col("_t"), None, uses).alias("spans"))
    named = weighed_titles(chats, uses)
    return said.unionByName(named.select(F.lit("title").alias("place"), "record_key", "_t", spans_column(F.col("_t"), F.col("_p"), uses).alias("spans")))


def personal_data(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """(place, record_key, kind, found_text, start, first) of each value in messages and titles.

    ``first`` is false where the same value stands earlier in the same row. Null and blank texts have none; equal values in one row come at each place they
    stand; repeated rows give theirs each; an empty table gives none.
    """
    rows = spotted_texts(messages, chats).select("place", "record_key", F.explode("spans").alias("s"))
    return rows.select("place", "record_key", F.col("s.kind").alias("kind"), F.col("s.text").alias("found_text"), F.col("s.start").alias("start"), F.col("s.first").alias("first"))


def redacted_texts(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """(place, record_key, found, redacted): each text with a value in it, once, with placeholders and their number."""
    rows = spotted_texts(messages, chats).where(F.size("spans") > 0)
    return rows.select("place", "record_key", F.size("spans").alias("found"), redacted(F.col("_t"), F.col("spans")).alias("redacted"))
