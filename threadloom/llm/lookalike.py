"""Problem 10: one consistent form for texts that look the same but differ in their characters.

A text is exploded to positioned elements: a code point, or a code point with the marks that combine with it. The
mappings (look-alike letters, widths, letters of mathematics and numerals, ligatures, radicals, blanks) are a table made by rule, broadcast and joined.
Elements with marks are exploded to code points, decomposed by a second broadcast table, their marks ordered by class, recomposed, and
the strings rebuilt. Documents are first partitioned by key, so that exploding, joining and rebuilding need no further exchange. No Python runs on rows.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import written

#: Letters of other scripts, phonetic letters and small capitals, and the Latin letters that they look like.
LOOK_ALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԛԝԁҮӏ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνορϲ" "օսհցԼՍՕ" "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ" "ɑɡᴄᴏᴠᴡᴢꜱ",
        "ABESIJKMHOPCTYXaesijopcyxhqwdYl" "ABEZHIKMNOPTYXvopc" "ouhgLUO" "ABCDEGHJKLMPRSTVWZ" "agcovwzs",
    )
)
#: Hyphens that look like the one of ASCII.
HYPHENS = "‐‑"
#: Characters that no reader sees (format characters, fillers).
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u3164\ufeff\uffa0"
#: Where characters with another form lie; the planes between hold unassigned and private ones.
_RANGES = (range(0x80, 0xD800), range(0xE000, 0x20000), range(0x2F800, 0x2FA20))


def _plain(c: str) -> str:
    """What one character looks like."""
    if c in INVISIBLE:
        return ""
    if c in HYPHENS:
        return "-"
    kind = unicodedata.category(c)
    if kind == "Zs":
        return " "
    shown = c
    tag, _, codes = unicodedata.decomposition(c).partition(" ")
    target = "".join(chr(int(x, 16)) for x in codes.split()) if tag.startswith("<") else ""
    wide = tag in ("<wide>", "<narrow>", "<font>") and kind[0] in "LN"
    ligature = tag == "<compat>" and 0xFB00 <= ord(c) <= 0xFB06
    numeral = tag == "<compat>" and kind == "Nl" and target.isascii()
    radical = tag == "<compat>" and 0x2E80 <= ord(c) <= 0x2FDF
    if wide or ligature or radical or numeral:
        shown = unicodedata.normalize("NFKC", target)
    letters = "".join(LOOK_ALIKES.get(x, x) for x in unicodedata.normalize("NFD", shown))
    return unicodedata.normalize("NFC", letters)


@functools.lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """Every character that has another form, with that form: some four thousand entries, by rule."""
    return {c: p for r in _RANGES for c in map(chr, r) if (p := _plain(c)) != c}


@functools.lru_cache(maxsize=1)
def composition() -> dict[str, str]:
    """Each pair of characters that compose, with what they become; Korean syllables, which follow a rule of their own, apart."""
    out = {}
    for c in (c for r in _RANGES for c in map(chr, r)):
        codes = unicodedata.decomposition(c).split()
        if len(codes) == 2 and not codes[0].startswith("<"):
            pair = "".join(chr(int(x, 16)) for x in codes)
            if unicodedata.normalize("NFC", pair) == c:
                out[pair] = c
    return out


@functools.lru_cache(maxsize=1)
def syllables() -> dict[str, str]:
    """The letter sequences of Korean syllables, whole or behind a syllable without its last letter, with the syllable."""
    out = {}
    for i in range(11172):
        c = chr(0xAC00 + i)
        letters = unicodedata.normalize("NFD", c)
        out[letters] = c
        if len(letters) == 3:
            out[chr(0xAC00 + i - i % 28) + letters[2]] = c
    return out


def _class_of(characters: str) -> str:
    """A character class for a regular expression, in ranges."""
    points, out = sorted(map(ord, characters)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in out)


@functools.lru_cache(maxsize=1)
def still_class() -> str:
    """A short character class (few ranges, so fast) of characters that no mapping changes: most of what common texts hold."""
    common = [*range(0x80), *range(0xA1, 0x180), *range(0x410, 0x452), *range(0x3001, 0x3100), *range(0x4E00, 0xA000), 0xFF0C, 0xFF1A, 0xFF1F, 0xFF01, 0x2014, 0x1F642]
    keys = mapping()
    return _class_of("".join(c for c in map(chr, common) if c not in keys and not unicodedata.combining(c)))


@functools.lru_cache(maxsize=1)
def _joining() -> str:
    """The class of characters that may combine with the one before: marks, and the second parts of pairs that are no marks."""
    seconds = {p[1] for p in composition()} | {p[-1] for p in syllables()} | {chr(i) for i in range(0x1161, 0x1176)}
    return r"\p{M}" + _class_of("".join(c for c in seconds if not unicodedata.category(c).startswith("M")))


def _decomposed(c: str) -> list[tuple[str, int]]:
    return [(x, unicodedata.combining(x)) for x in unicodedata.normalize("NFD", mapping().get(c, c))]


def mapping_table(spark: SparkSession) -> DataFrame:
    """(_from, _to): the form of single characters and of Korean letter sequences; some thirty thousand rows, fixed by rule."""
    return spark.createDataFrame([*mapping().items(), *syllables().items()], "_from string, _to string")


def decomposition_table(spark: SparkSession) -> DataFrame:
    """(_from, _parts): for each character that isn't its own decomposition of class 0, its code points with their classes; fixed by rule."""
    hangul = range(0xAC00, 0xD7A4)
    rows = [(c, _decomposed(c)) for r in _RANGES for c in map(chr, r) if ord(c) not in hangul and (c in mapping() or unicodedata.combining(c) or unicodedata.normalize("NFD", c) != c)]
    return spark.createDataFrame(rows, "_from string, _parts array<struct<c:string,k:int>>")


def recomposed(points: Column) -> Column:
    """The string of ordered code points (structs ``c``, ``k`` with their combining class): each mark joins the letter before it where the two compose and no mark of its class or a lower order stands between."""
    pairs = composition()
    known = F.map_from_arrays(F.split(F.lit("\u0001".join(pairs)), "\u0001"), F.split(F.lit("\u0001".join(pairs.values())), "\u0001"))

    def step(a: Column, x: Column) -> Column:
        free = (a["base"] != "") & F.when(x["k"] == 0, a["marks"] == "").otherwise(a["last"] < x["k"])
        one = F.when(free, F.try_element_at(known, F.concat(a["base"], x["c"])))
        starts = one.isNull() & (x["k"] == 0)
        return F.struct(
            F.when(starts, F.concat(a["done"], a["base"], a["marks"])).otherwise(a["done"]).alias("done"),
            F.when(starts, x["c"]).otherwise(F.coalesce(one, a["base"])).alias("base"),
            F.when(starts, F.lit("")).when(one.isNotNull(), a["marks"]).otherwise(F.concat(a["marks"], x["c"])).alias("marks"),
            F.when(starts, F.lit(0)).when(one.isNotNull(), a["last"]).otherwise(x["k"]).alias("last"),
        )

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("base"), F.lit("").alias("marks"), F.lit(0).alias("last"))
    return F.aggregate(points, start, step, lambda a: F.concat(a["done"], a["base"], a["marks"]))


def consistent_form(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form): the form that all texts with the same look share.

    Look-alike letters become Latin, letters and digits of another width or of mathematics and every blank plain, Roman numerals and ligatures their
    letters, hyphens the common one; invisible characters go; accents are composed. Case, accents, digits, punctuation and its width, line breaks and
    the number of blanks stay. A null text has a null form, an empty one an empty form. A key must name one text; where
    its row repeats, an unchanged text has a row for each, a changed one has one. Texts of unchanging characters alone are not exploded.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    touched = F.coalesce(F.col("_text").rlike(rf"[^{still_class()}]"), F.lit(False))
    still = rows.where(~touched).select("_key", F.col("_text").alias("form"))
    shown = F.regexp_replace("_text", f"[{_class_of(INVISIBLE)}]", "")
    spread = rows.where(touched).repartition("_key").dropDuplicates(["_key"]).select("_key", shown.alias("_text"))
    elements = F.posexplode_outer(F.regexp_extract_all("_text", F.lit(rf"(?s).[{_joining()}]*+"), 0)).alias("_pos", "_element")
    table = F.broadcast(mapping_table(spark))  # fixed by rule
    joined = spread.select("_key", elements).join(table, F.col("_element") == F.col("_from"), "left")
    single = (F.length("_element") == 1) | F.col("_to").isNotNull()
    plain = joined.groupBy("_key").agg(F.collect_list(F.when(single, F.struct("_pos", F.coalesce("_to", "_element").alias("_shown")))).alias("_plain"))
    marked = spread.where(F.col("_text").rlike(rf".[{_joining()}]")).select("_key", elements).where(F.length("_element") > 1)
    marked = marked.join(table.select("_from"), F.col("_element") == F.col("_from"), "left_anti")
    points = marked.select("_key", "_pos", F.posexplode(F.split("_element", "")).alias("_at", "_point")).where("_point <> ''")
    parts = F.coalesce("_parts", F.array(F.struct(F.col("_point").alias("c"), F.lit(0).alias("k"))))
    split = points.join(F.broadcast(decomposition_table(spark)), F.col("_point") == F.col("_from"), "left").select("_key", "_pos", "_at", F.posexplode(parts).alias("_sub", "_part"))
    listed = F.array_sort(F.collect_list(F.struct("_at", "_sub", "_part")))
    # a letter of class 0 parts the marks before it from those behind it: marks are ordered by (their letter, class, place)
    letters = F.transform(F.filter("_list", lambda x: x["_part"]["k"] == 0), lambda x: F.struct(x["_at"], x["_sub"]))
    letter_of = lambda x: F.coalesce(F.array_max(F.filter("_letters", lambda b: b <= F.struct(x["_at"], x["_sub"]))), F.struct(F.lit(-1).alias("_at"), F.lit(-1).alias("_sub")))
    placed = F.transform("_list", lambda x: F.struct(letter_of(x).alias("base"), x["_part"]["k"].alias("k"), x["_at"].alias("at"), x["_sub"].alias("sub"), x["_part"]["c"].alias("c")))
    grouped = split.groupBy("_key", "_pos").agg(listed.alias("_list")).withColumn("_letters", letters)
    built = grouped.select("_key", F.struct("_pos", recomposed(F.array_sort(placed)).alias("_shown")).alias("_one")).groupBy("_key").agg(F.collect_list("_one").alias("_marked"))
    every = plain.join(built, "_key", "left")
    whole = F.array_sort(F.when(F.col("_marked").isNull(), F.col("_plain")).otherwise(F.concat("_plain", "_marked")))
    moved = every.select("_key", F.array_join(F.transform(whole, lambda e: e["_shown"]), "").alias("form"))
    return still.unionByName(moved).withColumnRenamed("_key", key)


def looks(documents: DataFrame) -> DataFrame:
    """(doc_id, look, body): digests of the form and the text of each document with a visible character, written; repeated rows of a document count once."""
    forms = consistent_form(documents).withColumnRenamed("doc_id", "_doc")
    seen = forms.where(F.col("form").rlike(r"(?U)[^\s\p{C}]"))
    formed = seen.select("_doc", F.sha2("form", 256).alias("look"))
    texts = documents.select("doc_id", F.sha2("text", 256).alias("body"))
    return written(formed.join(texts, formed["_doc"] == texts["doc_id"]).select("doc_id", "look", "body").distinct(), "looks")


def _mixed(known: DataFrame) -> DataFrame:
    """(look, representative, texts) of the classes with at least two different texts."""
    classes = known.groupBy("look").agg(F.min("doc_id").alias("representative"), F.min("body").alias("_a"), F.max("body").alias("_b"))
    return classes.where("_a <> _b").select("look", "representative")


def look_alike_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, representative) of each document that looks like one with another text, exact copies among them included.

    ``class_id`` is the digest of the form, the representative the lowest document of the class. One row a document, whatever the size of a class.
    """
    known = looks(documents)
    return known.join(_mixed(known), "look").select("doc_id", F.col("look").alias("class_id"), "representative")


def look_alike_pairs(documents: DataFrame) -> DataFrame:
    """(doc_a, doc_b), ``doc_a`` < ``doc_b``: documents that look the same and whose texts differ.

    Texts without a visible character are no case; equal texts are no pair; repeated rows of a document count once. Different texts of a class are
    paired by their digests and then expanded to their documents, so that nothing is joined but what is returned.
    """
    known = looks(documents)
    inside = known.join(_mixed(known).select("look"), "look")
    texts = inside.select("look", "body").distinct()
    a, b = texts.withColumnRenamed("body", "body_a"), texts.withColumnRenamed("body", "body_b")
    different = a.join(b, "look").where("body_a < body_b").select("body_a", "body_b")
    left = different.join(inside.select(F.col("body").alias("body_a"), F.col("doc_id").alias("_one")), "body_a")
    pairs = left.join(inside.select(F.col("body").alias("body_b"), F.col("doc_id").alias("_two")), "body_b")
    return pairs.select(F.least("_one", "_two").alias("doc_a"), F.greatest("_one", "_two").alias("doc_b"))
