"""Written training sentences for the detector of personal data: random values in common phrasings, and look-alikes that are nobody's."""

from __future__ import annotations

import random
from collections.abc import Iterator

from threadloom.llm.pii import GIVEN

_PARTS = ("ba", "bel", "cor", "dan", "del", "fa", "gor", "hel", "is", "jo", "ka", "lin", "mar", "nor", "ol", "per", "ros", "sal", "tem", "vin")
_RUSSIAN = ("ан", "бел", "вар", "гор", "дан", "ев", "зар", "ил", "ка", "лев", "ми", "ник", "ол", "пет", "ро", "са", "тим", "фед")
_FAMILY, _GIVEN = "王李陳林黃張吳周徐孫馬胡郭何高羅鄭梁謝宋唐許鄧韓馮曹彭曾蕭田董袁潘蔡蔣余杜葉程蘇魏呂丁沈姚盧姜崔鍾譚陸汪范石廖賈夏付方邹熊白孟秦邱江尹薛杭桑屠闕厲酆柏霍", "文安若雨晴明哲宇瑞芸希澄遠禾嘉怡婷俊傑志偉美玲家豪淑芬建國雅琪承恩子涵"
_RARE = "蘅遙澈岑蘊珩霽朗川舟漪嵐硯錚屹燁棠笙芮玥湛森妤筠"
_JAPANESE = ("佐藤", "鈴木", "高橋", "田中", "伊藤", "山本", "中村", "小林", "加藤", "吉田", "山田", "松本", "井上", "木村", "清水", "山崎", "池田", "橋本", "石川", "前田", "藤田", "岡田", "長谷川", "村上", "近藤", "坂本", "遠藤", "青木", "藤井", "西村", "三浦川", "原田井", "大井戸", "黒木谷")
_JAPANESE_GIVEN = ("太郎", "花子", "一郎", "翔太", "美咲", "健", "陽子", "大輔", "直樹", "さくら", "拓也", "愛", "結衣", "蓮", "悠真", "葵", "誠", "久美子", "雄一")
#: Nouns of daily use: what stands where a name could.
_HAN_NOUNS = ("老師", "客服", "主管", "同事", "會議", "報告", "表格", "清單", "計畫", "預算", "公司", "部門", "文件", "問題", "系統", "高層", "方案", "安排", "明細", "周報", "林木", "馬路", "江邊", "石頭", "白板", "田地", "何時", "程式", "方法表", "雨天", "文章", "何種方式", "高風險", "方便性", "安全性", "許多人", "白名單", "石材廠", "林業局", "程序書", "夏季號", "江水量")
_HAN_ENDINGS = ("流程", "行程", "課程", "對方", "地方", "紅石", "森林", "工程", "過程", "如何", "任何", "長江", "油田", "白馬", "主張", "緊張", "允許", "樹葉", "規范", "剩余", "甘蔡", "古董", "水杭", "高溫", "安全周", "大孟", "海沈")
_KANJI_NOUNS = ("金曜日", "月曜日", "日曜日", "料金", "金額", "今週末", "会議", "記録", "手順", "予算", "資料", "報告書", "担当者", "予定表", "石油", "山道", "川沿", "木材", "村役場", "田植", "原因", "本日", "大会", "小学校", "野球場", "林道", "口座", "橋梁", "島国", "松林", "中心", "井戸水")
#: Phrasings by kind; ``{}`` is the value.
PHRASES = {
    "email": ("E-mail: {}", "Write to {} and I will answer tonight.", "Add {} to the list.", "The invite never arrived in my inbox ({}) today", "Forward this to {}, thanks.", "Mail: {}", "Schreib an {}, danke.", "Envoyez tout à {}.", "Escríbeme a {} mañana.", "郵件地址 {}", "メールアドレス：{}", "Пиши на {} вечером.", '{{"contact": "{}", "n": 3}}', "O endereço {} já não existe.", "Send the slides to {}", "Is {} still your account?", "{} is not in use any more.", "Meine neue Adresse lautet {}."),
    "phone": ("Phone: {}", "Ring {} before nine.", "Our number has been {} since May.", "mobile {} works best", "Fax and phone {}", "Tel: {}", "Telefon {}", "Mein Handy hat die {}.", "Tél. {}", "Rappelle le {} ce soir.", "Móvil {}", "Marca el {} y pide cita.", "Telefone {}", "電話 {}", "手機：{}", "携帯は{}", "Телефон {}", "Наберите {} утром.", '{{"phone": "{}", "n": 3}}', '{{"tel": "{}", "n": 3}}', "You may call {} at any hour.", "They can be reached under {}", "send a text to {}", "the front office picks up at {}", "Erreichbar unter {}.", "On peut me joindre au {}.", "Estoy en el {}.", "Pode ligar para {} amanhã.", "請撥 {} 找我", "{}までお電話ください。", "Мой номер {} не изменился."),
    "id_number": ("SSN: {}", "Passport no. {} is valid.", "Tax no. {}", "Passport number {}", "National ID {} expires soon.", "They copied {} from my insurance card.", "tax id {}", "Steuer-ID: {}", "Reisepass {}", "Numéro fiscal {}", "Passeport n° {}", "DNI {}", "NIE: {}", "Passaporte n.º {} caducou.", "CPF: {}", "護照號碼 {}", "身分證字號 {}", "旅券番号 {}", "ИНН: {}", "Паспорт {}", '{{"passport": "{}", "n": 3}}', '{{"tax_id": "{}", "n": 3}}', "Her SSN, {}, was on the page.", "my passport ({}) was renewed", "the insurance number reads {}", "they asked for my tax number and I gave {}", "Die Versicherungsnummer lautet {}.", "Mein Ausweis trägt die Nummer {}.", "Ma carte d'identité porte le {}.", "El pasaporte es el {}.", "O meu contribuinte é {}.", "我的身分證是{}", "マイナンバーは{}です。", "Номер полиса {}", "the identity card says {}"),
    "address": ("Address: {}", "We moved to {} in spring.", "Deliver everything to {} please.", "My flat at {} is for rent.", "The courier waits in front of {}.", "Anschrift: {}", "Livraison : {}", "Vivo en {} desde enero.", "Moro na {} há anos.", "Rendez-vous devant {}.", "Wir treffen uns vor {}.", "Nos mudamos a {}.", "Chegou a {} ontem.", "On habite {} depuis mai.", "Nachsendung an {}.", "Endereço: {}", "Dirección: {}", "Adresse : {}", '{{"address": "{}", "n": 3}}', '{{"addr": "{}", "n": 3}}', "Please note: {}", "Our branch sits at {} now.", "He grew up near {}.", "Send the box to {}, third door."),
    "name": (
        "Name: {}", "I spoke with {} yesterday.", "{} called twice this morning.", "Our colleague {} wrote the first draft.", "It was {} who noticed.", "Yesterday {} told me to wait.", "Can you forward it to {} today?", "We hired {} in May.", "{} joined the team.", "This is from {}, of course.", "I sat next to {} at lunch.", "Then {} left.", "The letter from {} got lost.", "{} will visit us next week.", "Have you met {}?", "My neighbour is {}.", "Mr {} is waiting.", "Dr. {} signed it.", "Thanks to {} we finished early.", "{}'s desk is empty.", "Ask {} about the keys.", "{} and the others agreed.", "Sent by: {}", "I am {} and I need help.", "My name is {}.", "{}", "Hi {},\nhow are you?", "Dear {}, thank you.", "{} thinks it is fine.", "He showed it to {} first.", "We copied {} and nobody else.", "as {} put it, it is late.", "{} is on leave.", "{} has the key.", "Only {} knows the code.", "Written by {}, last year.", "{} wants a refund.", "Please ask for {} at the desk.",
        "Ich habe {} gestern getroffen.", "{} schrieb gestern dazu.", "Frau {} kommt später.", "Das kam von {} selbst.", "Mein Name ist {}.", "{} hat abgesagt.", "Herr {} ist krank.", "Fragen Sie {}.", "Der Anruf galt {}.", "Wir warten auf {}.", "Mit {} ging es schnell.", "Ich heiße {}.",
        "J'ai vu {} hier.", "{} pense que non.", "Madame {} arrive demain.", "C'est {} qui l'a dit.", "{} a téléphoné ce matin.", "Demandez à {}.", "Le bureau de {} est fermé.", "Je suis {}.", "Avec {}, tout va bien.", "Je m'appelle {}.",
        "Ayer vi a {} en la oficina.", "{} llamó ayer.", "La señora {} viene mañana.", "Me llamo {}.", "Lo dijo {} sin dudar.", "Pregunta por {}.", "{} está enferma.", "Gracias a {} acabamos pronto.",
        "Ontem falei com {} sobre isso.", "{} ligou ontem.", "O senhor {} chegou.", "Chamo-me {}.", "{} não veio.", "Pergunte a {}.", "Foi {} quem disse.",
        "Kind regards,\n{}", "Amitiés,\n{}", "Mit Dank\n{}", "Beste Grüße\n{}", "Best Wishes\n{}", "Cordialement,\n{}", "Sincerely,\n{}", "Thanks,\n{}", "Saludos cordiales,\n{}", "Cumprimentos,\n{}", "С наилучшими пожеланиями,\n{}", '{{"name": "{}", "n": 3}}', '{{"owner": "{}", "n": 3}}', '{{"full_name": "{}"}}',
    ),
}
RUSSIAN_NAMES = ("Вчера я видел {} в офисе.", "{} написал вчера.", "Меня зовут {}.", "Это сказала {}.", "Спросите {} об этом.", "{} уже ушла домой.", "Мы ждём {} с утра.", "Коллега {} заболел.", "С уважением,\n{}", "Письмо от {} потерялось.")
CHINESE_NAMES = (
    "後天{}要出差。", "那本書是{}借的。", "今天早上{}打電話來。", "{}昨天來過。", "{}沒有回信。", "{}先問的。", "剛剛{}走了。", "要先問{}嗎？", "請通知{}。", "麻煩{}處理。", "因為{}不在。", "我覺得{}比較合適。", "請於週五前交給{}處理。", "剛才{}問了這件事。", "當時{}已經走了。",
    "我叫{}。", "我是{}，想問一下。", "昨天和{}開會。", "請找{}說明。", "{}先生已經到了。", "{}說明天可以。", "這是{}的桌子。", "請轉告{}。", "主管是{}。", "{}", "{}和我都同意。", "謝謝\n{}", "「{}」簽了名。", "我跟{}講過了。", "給{}看過。", "{}上個月離職了。", "聯繫{}即可。", "由{}確認", '{{"name": "{}"}}', "負責人：{}")
JAPANESE_NAMES = (
    "来週{}さんと会います。", "今日は{}が休みです。", "昨日、{}が書きました。", "明日の{}さんの予定です。", "作成：{}",
    "私は{}です。", "{}と申します。", "昨日{}さんに会いました。", "{}さんが来ました。", "担当は{}です。", "{}様\nお世話になります。", "これは{}の机です。", "{}に聞いてください。", "{}へ送りました。", "名前は{}です。", "{}", "{}も賛成です。", '{{"name": "{}"}}', "責任者：{}", "{}から電話がありました。")
#: The same places with a noun: nobody.
CHINESE_NOUNS = (
    "今天早上{}很多。", "因為{}不夠，{}也要改。", "當時{}已經完成。", "請於週五前處理{}。", "我覺得{}比{}重要。", "從{}開始，高於{}的部分先不動。", "何時可以看到{}？", "安排好{}之後，方便的話再說。", "程式裡的{}過時了。", "白天看{}，晚上看{}。", "余下的{}不多。", "不許改{}。", "葉子和{}無關。", "只要{}低於四，就不需要{}。", "于是{}變慢了。", "任何{}都可以。", "范圍內的{}都通過。", "江邊的{}和馬上到的{}。", "於高處看{}，許多細節可惜了。", "紀錄與{}對不起來。", "方便的時候看一下{}。", "文章裡提到{}三次。", "石頭上的{}。", "田裡有{}。", "黃色的{}不見了。", "謝謝，{}收到了。", "金額與{}不同。", "周末再看{}。", "常見的{}有三種，程度不同。", "白色那張{}。", "夏天的{}。", "高度和{}。", "路上看到{}。",
    "請找{}說明。", "我是{}。", "這是{}的問題。", "我跟{}講過了。", "給{}看過。", "{}和{}都要改。", "昨天和{}有關。", "{}說明天可以。", "「{}」太長。", "先看{}，再看{}。", "{}", "請把{}移到{}。", "{}出錯時會先有徵兆。", "聯絡{}確認。", "這份{}比較清楚。")
JAPANESE_NOUNS = (
    "明日{}を送ります。", "{}までに決めます。", "{}までにどうしますか。", "今日の{}は少ない。", "来週の{}までに{}を直します。", "高い山と小さい{}。", "中心は{}です。", "松の木と{}。", "井戸と{}。", "本当に{}が必要ですか。", "大切な{}から始めます。", "田中心部の{}。", "山の上の{}を見ました。", "石の{}。", "村の{}。",
    "これは{}です。", "{}の{}を見てください。", "{}が遅れています。", "{}に書きました。", "{}は{}より大切です。", "{}", "担当は{}です。", "{}へ送りました。", "{}と{}を比べます。", "{}も必要です。", "{}から始めます。")
#: Phrasings whose values are no personal data: ``{n}`` a number, ``{W}`` a made-up code name, ``{t}`` a noun.
NOBODY = (
    "Order 2024-{n4}-{n4} is closed.", "Build {n1}.{n2}.{n1}-rc1 is out.", "The node 10.{n1}.0.{n2} answers again.", "SKU KD-{n5}-{n3} is sold out.", "Commit 9f3ac01{n3} fixed it.", "Budget: 1,{n3},{n3} in total.", "It ran from 10:{n2} to 11:{n2}.", "Score {n2}/100, rank 3-{n2}.", "See page {n2}, row {n3} of the plan.",
    "Project {W} {W} starts soon.", "Install {W} {n1}.{n1} first.", "Is {W} faster than {W}?", "Both {W} and {W} need a restart.", "Use {W} here.", "Does {W} crash?", "Unlike {W}, this one works.", "Since {W} changed hands we had no trouble.", "Moving {W} costs more than keeping it.", "Download {W} again.", "Compare {W}-{n2} with {W}.", "Call it {W} for now.", "Even {W} needs care.", "Nobody likes {W}.", "Try {W} with {n3} rows.",
    "Start {W} at noon.", "Stop {W}.", "Give {W} more memory.", "@channel please read this first.", "Use @cached above the function.", "12:30:{n2} [info] job={n3} rows={n5} took={n3}ms", "no. {n9}{n9}", "{W} ran for {n3} days.", "- Das {W}", "- Die {W}", "- La {W}", "- El {W} de {W}", "It took about {n3} minutes and {n2} steps.", "The date was 2023-{n2}-{n2} at 10:00.", "2024-0{n1}-1{n1} 10:00:00", '{{"rows": {n3}, "ok": true}}',
    '{{"label": "{W} {W}"}}', "Invoice {n5}-{n4} and ticket {n5}{n4} are open.", "See {n9}{n5} in the log.", "Im {W} gab es {n3} Punkte.", "Das {W} {W} {n3}", "Version {n1}", "Rows {n5} {n5} {n5} were dropped.", "Halle {W} {W} ist neu.", "Nota: La {W} {W}", "KD-{n9}", "Release {n4}.{n2}.{n2}.{n4} is late.", "Quand {W} tombe, on attend.", "Wenn {W} ausfällt, warten wir.", "Cuando {W} falla, esperamos.", "Quando {W} falha, esperamos.", "Когда {R} падает, мы ждём.",
    "Laden Sie {W} neu.", "Startet {W} neu.", "Relancez {W} ce soir.", "Activez {W}.", "Reinicie {W} hoy.", "Abra {W} agora.", "Запустите {R} снова.", "Выключите {R}.", "When {W} fails, it shows.", "If {W} is off, wait.", "Then {W} of {W} came.", "The {W} {W} is down.", "Our {W} {W} table is slow.", "Projekt {W} {W} läuft.", "Le projet {W} {W} avance.", "El modelo {W} {W} falla.", "Проект {R} {R} идёт.", "The Golden {W} is a boat.",
    "Meine {W} ist neu.", "Der {W} ist neu.", "COULD WE MOVE THE LIST NEXT WEEK?", "PLEASE SEND THE PLAN TODAY.", "Without {W} nothing works.", "Si {W} baja.", "Se {W} fica.", "Если {R} ниже.", "Der Begriff {W} {W} ist neu.", "From {W} to {W}.", "On Monday {W} was slow.", "In March {W} grew.", "{W} {W} is a new product.", "Great {W}!", "# {W} {t}", "## {t}", "{t} {n2}", "{t}: {t}", "- {t}\n- {t}", "{W}: can we move it?", "{W}: Wie geht das?", "{W}: ¿Qué falta?", "{R}: Что дальше?", "Das {t} und die {t} fehlen.", "Zu {t} der {t} gehört das.", "Oft zeigt das {t} den {t} an.", "Der {t} des {t} fehlt.", "Im {t} von {t} steht es.", "Zuerst {t} {t} prüfen.", "Am Anfang der {t} geht alles.", "Heute ist {t} wichtig.", "Erst {t}, dann {t}.", "The label {W}-{n2} is used.", "New York is far.", "Happy Birthday to all.", "Open the File Menu and choose Save As.", "Windows Server and Visual Studio are installed.", "The United Nations met in San Francisco.", "Harvard University replied.", "Monday Morning is busy.", "IBAN DE{n2} {n4} {n4} {n4} {n4} {n2}", "The bank account is {n4} {n4} {n4} {n4}.", "{n4} {n4} {n4} {n4} is a card of the bank.",
    "he said it works and {w} is fine", "we will see what {w} brings", "use, keep and test {w} daily",
)
TITLES = ("{} / {t}", "{t} ({})", "{t}: {}", "{} {t}")
_NOUNS = ("Budget", "Plan", "Tabelle", "Export", "Archiv", "Formular", "Suchliste", "Zeitplan", "Vorlage", "Report", "Garden", "Menu")


def _word(r: random.Random) -> str:
    return "".join(r.choice(_PARTS) for _ in range(r.choice((2, 2, 3))))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _shaped(r: random.Random, shape: str) -> str:
    return "".join(r.choice("0123456789") if c == "#" else r.choice("ABCDEFGHXKL") if c == "?" else c for c in shape)


def _pools(r: random.Random) -> dict[str, list[str]]:
    """Given names, family names and code names that come again and again, as they do in a corpus."""
    russian = lambda: "".join(r.choice(_RUSSIAN) for _ in range(r.choice((2, 2, 3)))).capitalize()
    given = sorted(x for x in GIVEN if x.isascii())
    return {"given": [_word(r).title() if r.random() < 0.6 else r.choice(given) for _ in range(120)], "family": [_word(r).title() for _ in range(160)], "code": [_word(r).title() for _ in range(120)], "verb": [_word(r).title() for _ in range(40)], "noun": [_word(r).title() for _ in range(60)], "russian": [russian() if r.random() < 0.7 else r.choice(("Иван", "Мария", "Сергей", "Ольга", "Павел", "Ирина")) for _ in range(120)]}


def usual_shares(seed: int = 5) -> dict[str, tuple[float, float]]:
    """How a corpus writes the words of the examples of ``seed``: shares of uses with a capital inside a sentence, and without a capital."""
    pools, r = _pools(random.Random(seed)), random.Random(seed + 1)
    ranges = {"verb": (0.0, 0.02, 0.6), "noun": (0.75, 1.0, 0.03), "code": (0.25, 0.98, 0.12), "russian": (0.2, 0.97, 0.12), "family": (0.4, 0.98, 0.12), "given": (0.15, 0.9, 0.12)}
    out = {}
    for pool, (low, high, most) in ranges.items():
        for word in pools[pool]:
            n, inside, small = r.choice((12, 40, 200) if pool in ("verb", "noun") else (1, 2, 3, 5, 12, 40, 200)), r.uniform(low, high), r.uniform(0, most)
            forms = [r.random() for _ in range(n)]
            a, b = sum(f < inside for f in forms), sum(f >= inside and f < inside + small * (1 - inside) for f in forms)
            for form in (word, word.lower(), word.upper()):
                out[form] = ((a + 0.5) / (n + 1), (b + 0.5) / (n + 1))
    return out


def value(kind: str, r: random.Random, pools: dict[str, list[str]] | None = None) -> str:
    if kind == "email":
        at, dot = r.choice((("@", "."), ("@", "."), ("＠", "."), (" [at] ", " [dot] "), (" (at) ", ".")))
        text = f"{_word(r)}{r.choice(('.', '_', '-', '+', ''))}{r.choice((_word(r), _digits(r, 2)))}{at}{_word(r)}{dot}{r.choice(('test', 'example', 'invalid', 'com', 'org'))}"
        return text.upper() if at == "@" and r.random() < 0.15 else text
    if kind == "phone":
        return _shaped(r, r.choice(("+1 ### ### ####", "(###) ###-####", "###-###-####", "###.###.####", "+1##########", "0## #### ####", "+44 20 #### ####", "030 ##### ###", "+49 30 ########", "030/#####-###", "01 ## ## ## ##", "01.##.##.##.##", "+33 1 ## ## ## ##", "6## ### ###", "+34 6## ### ###", "+55 11 9####-####", "(11) 9####-####", "+351 9## ### ###", "09########", "0900-###-###", "+886 900 ### ###", "(02) ####-####", "090-####-####", "+81 90 #### ####", "+7 (900) ###-##-##", "+7##########", "8 900 ### ## ##")))
    if kind == "id_number":
        return _shaped(r, r.choice(("###-##-####", "9##-##-####", "9########", "9## ## ####", "X########", "## ### ### ###", "?#?######", "##XX#####", "# ## ## ## ### ### ##", "########-?", "########?", "XX######", "?#########", "############", "## ## ######", "#### ######", "#### #### ####", "###.###.###-##")))
    if kind == "address":
        a, b, n = _word(r).title(), _word(r).title(), r.randint(1, 480)
        return r.choice((f"{n} {a} {r.choice(('Street', 'Lane', 'Drive', 'Avenue', 'Court', 'Rd'))}", f"{n} W. {a} Blvd", f"{n} Old {a} Rd", f"{a}straße {n}", f"{a}weg {n}", f"Am Alten {a} {n}", f"{n} rue des {a}", f"{n} bis, avenue du {a} {b}", f"Calle del {a} {n}", f"Plaza del {a}, {n}", f"Rua das {a} {n}", f"Travessa da {a}, {n}", f"{n} avenue du {a} {b}", f"{n} rue des {a} {b}", f"{n} bd de la {a}", f"{n} impasse des {a}", f"Calle del {a} {b} {n}", f"Avda. de los {a} {n}", f"Av. do {a} {b} {n}"))
    if kind == "russian_address":
        a = "".join(r.choice(_RUSSIAN) for _ in range(2)).capitalize()
        return r.choice((f"ул. {a}ая, д. {r.randint(1, 480)}", f"ул. {a}ой {a.title()}и, д. {r.randint(1, 480)}", f"{r.choice(('пер.', 'проспект', 'наб.'))} {a}ый, {r.randint(1, 480)}", f"улица {a} {r.randint(1, 480)}"))
    pools = pools or _pools(r)
    first, last = r.choice(pools["given"]), r.choice(pools["family"])
    return _cased(first, last, r, pools)


def _cased(first: str, last: str, r: random.Random, pools: dict[str, list[str]]) -> str:
    if r.random() < 0.2:
        last += "-" + r.choice(pools["family"])
    form = r.random()
    text = f"{last}, {first}" if form < 0.12 else f"{first} {r.choice('ABCDEFGHJKLMNPRST')}. {last}" if form < 0.25 else f"{first} {last} {r.choice(pools['family'])}" if form < 0.32 else f"{first} {last}"
    return text.lower() if r.random() < 0.12 else text.upper() if r.random() < 0.08 else text


def _russian_name(r: random.Random, pools: dict[str, list[str]]) -> str:
    first, last = r.choice(pools["russian"]), r.choice(pools["russian"]) + "ов"
    text = f"{last}, {first}" if r.random() < 0.15 else f"{first} {last}"
    return text.lower() if r.random() < 0.12 else text.upper() if r.random() < 0.08 else text


def _han_name(r: random.Random, japanese: bool) -> str:
    return r.choice(_JAPANESE) + r.choice(_JAPANESE_GIVEN) if japanese else r.choice(_FAMILY) + "".join(r.sample(_GIVEN if r.random() < 0.35 else _RARE, r.choice((1, 2, 2, 2))))


def _fill(text: str, r: random.Random, pools: dict[str, list[str]]) -> str:
    for n in range(1, 10):
        while f"{{n{n}}}" in text:
            text = text.replace(f"{{n{n}}}", _digits(r, n), 1)
    for mark, words in (("{W}", pools["code"]), ("{R}", pools["russian"]), ("{t}", (*_NOUNS, *pools["noun"])), ("{w}", [w.lower() for w in pools["code"]])):
        while mark in text:
            text = text.replace(mark, r.choice(words), 1)
    return text.replace("{{", "{").replace("}}", "}")


def _topic_use(r: random.Random) -> tuple[float, float]:
    """How a topic is used: mostly as a whole title too, in few or many titles; a rare one only here."""
    return (r.uniform(0.3, 1), float(int(2 ** r.uniform(1, 12)))) if r.random() < 0.95 else (0.0, 1.0)


def _name_use(r: random.Random, form: str) -> tuple[float, float]:
    """How a name is used: hardly ever alone, in one title or, of a busy person, in many; before a blank it is no part of its own."""
    if form == "{} {t}" and r.random() < 0.7:
        return 0.0, 0.0
    return 0.0 if r.random() < 0.98 else r.uniform(0, 0.2), float(r.choice((1, 1, 1, 2, 3, int(2 ** r.uniform(1, 8)))))


def examples(seed: int = 5, phrases: dict[str, tuple[str, ...]] | None = None) -> Iterator[tuple[str, bool, set[tuple[str, str]], dict]]:
    """(text, whether a title, true values by kind, use of the parts of titles). ``phrases`` replaces the frames of running text, to test others."""
    r, none = random.Random(seed), {}
    pools = _pools(r)
    for _ in range(10):
        for kind, frames in (phrases or PHRASES).items():
            for phrase in frames + (tuple(f for f in frames if f.startswith("{} ")) * 2 if kind == "name" and not phrases else ()):
                v = value(kind, r, pools)
                lead = _fill(r.choice(NOBODY), r, pools) + r.choice((" ", "\n")) if r.random() < 0.5 and phrase != "{}" else ""
                tail = r.choice((" ", "\n")) + _fill(r.choice(NOBODY), r, pools) if r.random() < 0.4 and phrase != "{}" else ""
                yield lead + phrase.format(v) + tail, False, {(kind, v)}, none
        if phrases:
            continue
        for frames, named in ((RUSSIAN_NAMES, lambda: _russian_name(r, pools)), (CHINESE_NAMES, lambda: _han_name(r, False)), (JAPANESE_NAMES, lambda: _han_name(r, True))):
            for phrase in frames * 4:
                v = named()
                yield phrase.format(v), False, {("name", v)}, none
        for frames, nouns in ((CHINESE_NOUNS, _HAN_NOUNS), (JAPANESE_NOUNS, _KANJI_NOUNS)):
            for phrase in frames * 3:
                yield phrase.format(*r.sample(nouns, 2)), False, set(), none
        for turn in range(200):  # unknown verbs and adverbs around a name, and capitalised ones before a code name
            v, verb, lead = value("name", r, pools), _word(r), r.choice(("Maybe", "Who", "Today", "Perhaps", "Heute", "Hier", "Hoy", "Hoje", _word(r).title() + " and", "that", "the " + _word(r) + " of", _word(r)))
            yield r.choice((f"{lead} {v} {verb} it.", f"{v} {verb} {_word(r)}.", f"{_word(r).title()} {_word(r)} {v}.", f"{_word(r)} {v}, {verb}", f"{_word(r)} {v}?")), False, {("name", v)}, none
            if turn % 3:
                continue
            verb = r.choice(pools["verb"])
            yield _fill(r.choice((f"{verb} {{W}} {_word(r)}.", f"{verb} {{W}}-{{n2}} {_word(r)}.", f"{_word(r)}. {verb} {{W}} {_word(r)} {{n2}}.", f"{verb} {{W}}", f"{_word(r)}: {verb} {{W}} {_word(r)}.")), r, pools), False, set(), none
        for phrase in ("請寄到 a.b@example.org 謝謝。", "好的，謝謝", "謝謝！", "感謝，謝謝你。", "多謝。", "謝謝您的幫忙。"):
            yield phrase, False, {("email", "a.b@example.org")} if "@" in phrase else set(), none
        for noun in _HAN_ENDINGS * 3:
            yield r.choice(("{}看來不錯。", "這是{}還是別的？", "寫一段{}的話。", "{}說明一下。", "整個{}起來很快。", "關於{}與時間", "{}會慢一點。", "先看{}再說。", "這個{}要改。", "{}、清單和其他。", "在{}裡有三個。", "我說{}很好。", "{}的部分", "因為{}也不夠。", "{}已經有了")).format(noun), False, set(), none
        for phrase in NOBODY:
            text = _fill(phrase, r, pools)
            yield text, False, set(), none
            yield text.lower(), False, set(), none
            if r.random() < 0.3:
                yield text.upper() + " " + _fill(r.choice(NOBODY), r, pools).upper(), False, set(), none
        yield " ".join(_word(r) for _ in range(8)).upper() + r.choice(".?:"), False, set(), none
        for phrase in ("請寄到{}。", "包裹送到{}，謝謝。", "我家在{}。", "約在{}見面。", "他住{}。", "我住在{}，二樓。", '{{"addr": "{}", "n": 3}}', "地址：{}", "公司搬到{}了。", "{}"):
            v = "".join(r.sample("松湖青禾文安明雨晴竹溪中民和平", r.choice((1, 2, 2)))) + r.choice(("", "", "東", "西", "一", "北")) + r.choice(("路", "街", "大道")) + r.choice(("", "二段", "12巷")) + f"{r.randint(1, 400)}號"
            yield phrase.format(v), False, {("address", v)}, none
        for phrase in ("Адрес: {}", "Доставьте в {}.", "Мы живём на {}", "Доставка: {}", "Офис переехал: {}"):
            v = value("russian_address", r)
            yield phrase.format(v), False, {("address", v)}, none
        for phrase in ("住所は{}です。", "{}まで送ってください。", "{}に引っ越しました。", "届け先：{}"):
            v = "".join(r.sample("松湖青禾文安明雨晴禾竹溪", 2)) + f"{r.randint(1, 5)}丁目{r.randint(1, 20)}番{r.randint(1, 20)}号"
            yield phrase.format(v), False, {("address", v)}, none
        for kind in PHRASES:
            for form in TITLES * (8 if kind in ("phone", "id_number") else 3):
                v = value(kind, r, pools)
                topic = _word(r).capitalize() + " " + _word(r) if r.random() < 0.7 else "".join(r.sample(_GIVEN, 4))
                yield form.replace("{t}", topic).format(v), True, {(kind, v)}, {topic.lower(): _topic_use(r), v.lower(): _name_use(r, form)}
                v = _han_name(r, r.random() < 0.4)
                topic = "".join(r.sample(_HAN_NOUNS + _KANJI_NOUNS, 1)) + r.choice(("", "表", "清單"))
                yield form.replace("{t}", topic).format(v), True, {("name", v)}, {topic: _topic_use(r), v: _name_use(r, form)}
                topics = {"".join(r.sample(_FAMILY + _GIVEN, r.choice((2, 3, 3, 4, 5, 6)))): (r.uniform(0.3, 1), float(int(2 ** r.uniform(1, 12)))) for _ in range(2)}
                yield form.replace("{t}", min(topics)).format(max(topics)), True, set(), topics
                yield max(topics) + r.choice(("", " 2", " 14")), True, set(), topics
                topic = _word(r).title() + " " + _word(r).title()
                yield topic + r.choice(("", " 2", " / " + _word(r))), True, set(), {topic.lower(): (r.uniform(0.3, 1), float(int(2 ** r.uniform(1, 12))))}
        yield _word(r).capitalize() + " " + _word(r) + " " + _digits(r, 2), True, set(), none
        yield "Das " + _word(r).title() + " " + _digits(r, 2), True, set(), none
        yield _word(r).title() + ": " + "Could you draft a note about " + _word(r) + "?", True, set(), none
