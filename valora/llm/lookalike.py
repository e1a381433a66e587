"""Texts that look the same but differ in their characters (problem 1).

Method: look-alike letters, full-width and styled forms, spaces and invisible marks are mapped in
SQL; mapped values are grouped under the accent- and case-sensitive Unicode collation; each class
gets one canonical member, which is joined back.

Texts are compared in the mapped form, in which all look-alikes are Latin; what comes out is the
member's own form, in which letters of other scripts stay where they belong: in a text without
Latin letters, and in words with a letter that has no Latin look-alike. The canonical member is the
smallest own form by code point, one without letters of other scripts before one with them.

Grouping under a collation compares and shuffles whole texts, so it is kept to the texts that need
it: a coarse hash, equal for all texts that the collation could hold equal (base letters only,
everything else outside ASCII dropped), splits the rows into buckets first, and only buckets with
at least two different own forms are grouped under the collation. All others are a class of
their own by plain equality.

Defined results: a null text has a null canonical form; a text that is blank after mapping is its
own canonical form and pairs with nothing; repeated rows share a class; an empty table gives an
empty table; further columns pass through, and added columns carry the prefix `look_`, replacing any so named.
Joiners count as marks without a look but between letters of scripts that they shape.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions import text as T
from valora.functions.text import accent_table
from valora.runtime import BROADCAST_ROWS, keep, small_side, spread_join

# Letters of other scripts whose shape is that of a Latin letter, each with that letter.
CYRILLIC = "АВЕКМНОРСТУХЅІЈҮӀԌԚԜаеорсухѕіјԁԛԝһѵ"
CYRILLIC_AS = "ABEKMHOPCTYXSIJYIGQWaeopcyxsijdqwhv"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳνρ"
GREEK_AS = "ABEZHIKMNOPTYXocjvp"
ARMENIAN = "ՕՍօհոսցզյ"
ARMENIAN_AS = "OUohnugqj"
CHEROKEE = "ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏴ"
CHEROKEE_AS = "DRTiAJEWMHGZbRWSVSLCPKB"
# Spaces that look like a space, hyphens that look like a hyphen.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "‐‑"
# Marks that show nothing; joiners do only where letters are joined.
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200e\u200f"
    "\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
)
JOINERS = "\u200c\u200d"
JOINED = "".join(rf"\p{{Is{x}}}" for x in "Arabic Syriac Nko Mongolian Devanagari Bengali Gurmukhi Gujarati Oriya Tamil Telugu Kannada Malayalam Sinhala".split()) + r"\p{So}\x{FE0F}"
#: Kinds of Unicode's compatibility characters that differ from what they stand for in width or style only.
STYLES = ("<wide>", "<narrow>", "<font>", "<noBreak>")
#: Ligatures and Roman numerals: characters that look like the letters they are made of.
COMPOSED = (range(0xFB00, 0xFB07), range(0x2160, 0x2180))
OTHER_SCRIPTS = r"[\x{370}-\x{58F}\x{13A0}-\x{13FF}\x{AB70}-\x{ABBF}]"


@cache
def style_table() -> tuple[dict[str, str], dict[str, str]]:
    """(single, composed): by Unicode's own data, characters and the one or several that they look like."""
    single, composed = {}, {}
    for c in range(0xA0, 0x20000):
        d = unicodedata.decomposition(chr(c))
        if d.startswith(STYLES) or any(c in r for r in COMPOSED):
            to = unicodedata.normalize("NFKC", chr(c))
            (single if len(to) == 1 else composed)[chr(c)] = to
    return single, {k: v for k, v in composed.items() if any(ord(k) in r for r in COMPOSED)}


@cache
def script_table() -> dict[str, str]:
    """Letters of other scripts and the Latin letters that they look like, accented ones too."""
    out = dict(zip(CYRILLIC + GREEK + ARMENIAN + CHEROKEE, CYRILLIC_AS + GREEK_AS + ARMENIAN_AS + CHEROKEE_AS, strict=True))
    for c in range(0x370, 0x2000):
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1 and d[0] in out:
            to = unicodedata.normalize("NFC", out[d[0]] + d[1:])
            if len(to) == 1:
                out[chr(c)] = to
    return out


#: Characters that any of the tables may hold: all of their keys lie here, and few texts have any.
SUSPECT = r"[\x{A0}\x{AD}\x{180}-\x{10FFFF}]"


def own_characters(df: DataFrame, text_col: str) -> DataFrame:
    """df with look_s (whether a table's character may occur) and look_o, the text with styled forms,
    spaces, hyphens and invisible marks mapped and outer white space dropped.

    Every step is a column of its own projection, so that none is evaluated twice, and only texts
    with a suspect character go through the tables.
    """
    single, composed = style_table()
    table = {**single, **dict.fromkeys(SPACES, " "), **dict.fromkeys(HYPHENS, "-")}
    several = F.col("look_1")
    for c, letters in composed.items():
        several = F.replace(several, F.lit(c), F.lit(letters))
    apart = F.regexp_replace("look_2", rf"(?<![{JOINED}])[{JOINERS}]+|[{JOINERS}]+(?![{JOINED}{JOINERS}])", "")
    out = df.withColumn("look_s", F.col(text_col).rlike(SUSPECT))
    # characters without a counterpart are dropped
    out = out.withColumn("look_1", F.when(F.col("look_s"), F.translate(F.col(text_col), "".join(table) + INVISIBLE, "".join(table.values()))).otherwise(F.col(text_col)))
    out = out.withColumn("look_2", F.when(F.col("look_s") & F.col("look_1").rlike(f"[{''.join(composed)}]"), several).otherwise(F.col("look_1")))
    out = out.withColumn("look_3", F.when(F.col("look_s") & F.col("look_2").rlike(f"[{JOINERS}]"), apart).otherwise(F.col("look_2")))
    return out.withColumn("look_o", T.strip(F.col("look_3"))).drop("look_1", "look_2", "look_3")


def _latin(text: Column) -> Column:
    t = script_table()
    return F.translate(text, "".join(t), "".join(t.values()))


def keyed(df: DataFrame, text_col: str) -> DataFrame:
    """df with look_m (compared form), look_o (own form, null where it is the compared one), look_b
    (bucket), look_h and look_k (hashes of both forms), the last three null if blank, and look_x
    (whether the own form has other scripts)."""
    alien = "[" + OTHER_SCRIPTS[1:-1] + "&&\\p{L}&&[^" + "".join(script_table()) + "]]"
    words = F.split("look_o", r"(?<=[^\p{L}\p{M}])|(?=[^\p{L}\p{M}])")
    mixed = F.array_join(F.transform(words, lambda w: F.when(w.rlike(alien), w).otherwise(_latin(w))), "")
    own = F.when(F.col("look_o").rlike("[A-Za-z]"), F.when(F.col("look_o").rlike(alien), mixed)).otherwise(F.col("look_o"))
    out = own_characters(df, text_col).withColumn("look_x", F.coalesce(F.col("look_s") & F.col("look_o").rlike(OTHER_SCRIPTS), F.lit(False)))
    out = out.withColumn("look_m", F.when(F.col("look_x"), _latin(F.col("look_o"))).otherwise(F.col("look_o")))
    out = out.withColumn("look_o", F.when(F.col("look_x"), own)).withColumn("look_x", F.col("look_x") & F.coalesce("look_o", "look_m").rlike(OTHER_SCRIPTS))
    shown = F.length("look_m") > 0
    base = F.regexp_replace(F.translate(F.col("look_m"), *accent_table()), r"[^\x09-\x0D\x20-\x7E]", "")
    out = out.withColumns(
        {
            # joiners that show are ignored by the collation, so they part the buckets
            "look_b": F.when(shown, F.xxhash64(base, F.when(F.col("look_s"), F.regexp_count("look_m", F.lit(f"[{JOINERS}]"))).otherwise(0))),
            "look_h": F.when(shown, F.xxhash64("look_m")),
        }
    )
    return out.withColumn("look_k", F.when(F.col("look_o").isNull(), F.col("look_h")).when(shown, F.xxhash64("look_o"))).drop("look_s")


def canonical_members(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, look_b, look_h, look_text) of every compared form that is in a bucket with another own form.

    rows: kept rows of keyed(). look_text is the canonical member of the form's class.
    """
    key = [*by, "look_b"]
    mixed = rows.where("look_b IS NOT NULL").groupBy(*key).agg(F.min("look_k").alias("k0"), F.max("look_k").alias("k1"))
    mixed = mixed.where("k0 <> k1").select(*key)
    forms = rows.join(mixed, key, "left_semi").groupBy(*key, "look_h").agg(F.min("look_m").alias("look_m"), F.min(F.struct("look_x", F.coalesce("look_o", "look_m").alias("look_o"))).alias("look_o"))
    canon = forms.groupBy(*(F.col(x).alias(f"c_{x}") for x in key), F.collate("look_m", "UNICODE").alias("look_c")).agg(F.min("look_o").alias("look_o"))
    same = F.collate("look_m", "UNICODE") == F.col("look_c")
    for x in key:
        same &= F.col(x) == F.col(f"c_{x}")
    return forms.drop("look_o").join(canon, same).select(*key, "look_h", F.col("look_o.look_o").cast("string").alias("look_text"))


def canonicalize(df: DataFrame, text_col: str) -> DataFrame:
    """Every row of df with the canonical form of its text in `look_text`."""
    df = df.drop(*(c for c in df.columns if c.startswith("look_")))
    rows = keep(keyed(df, text_col), "p1-rows")
    members = keep(canonical_members(rows, []), "p1-members")
    key = ["look_b", "look_h"]
    hit = rows.join(small_side(members), key, "left")
    return hit.withColumn("look_text", F.coalesce("look_text", "look_o", "look_m")).select(*df.columns, "look_text")


def classes(df: DataFrame, id_col: str, text_col: str, field_name: str) -> DataFrame:
    """Rows of keyed() for differing_members(); form is the hash of the text as stored."""
    t = df.select(F.lit(field_name).alias("field_name"), F.col(id_col).alias("id"), F.col(text_col).alias("look_t"))
    return keyed(t, "look_t").where("look_b IS NOT NULL").withColumn("form", F.xxhash64("look_t")).drop("look_t")


CLASS = ["field_name", "look_b", "look_h"]


def differing_members(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, sizes): the rows (CLASS, id, form) of classes with several stored texts, kept, and
    (CLASS, n, class_id) of these classes, class_id being the smallest id.

    rows: kept rows of classes(). A form joins its class through the canonical member; classes with
    one stored form are dropped, so no group of exact copies is carried along.
    """
    by = ["field_name"]
    members = keep(canonical_members(rows, by), "p1-members")
    named = members.select(*CLASS, F.xxhash64("look_text").alias("canonical"))
    n = members.count()
    row = (
        rows.select(*CLASS, "id", "form")
        .join(small_side(named, n), CLASS, "left")
        .select("field_name", "id", "look_b", F.coalesce("canonical", "look_h").alias("look_h"), "form")
    )
    sizes = row.groupBy(*CLASS).agg(F.min("form").alias("f0"), F.max("form").alias("f1"), F.count(F.lit(1)).alias("n"), F.min("id").alias("class_id"))
    sizes = keep(sizes.where("f0 <> f1").select(*CLASS, "n", "class_id"), "p1-classes")
    k = sizes.count()
    keys = sizes.select(*CLASS)
    member = row.join(small_side(keys, k, 48), CLASS) if k <= BROADCAST_ROWS else spread_join(row, keys, CLASS, ["id"], sizes)
    return keep(member, "p1-pairs"), sizes


def differing_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (field_name, id_a, id_b) of one class whose stored texts differ (see class_members() for
    the same links in as many rows as records)."""
    member, sizes = differing_members(rows)
    a = member.select(*CLASS, F.col("id").alias("id_a"), F.col("form").alias("form_a"))
    b = member.select(*CLASS, F.col("id").alias("id_b"), F.col("form").alias("form_b"))
    return spread_join(a, b, CLASS, ["id_a"], sizes).where("id_a < id_b AND form_a <> form_b").select("field_name", "id_a", "id_b")


def class_members(rows: DataFrame) -> DataFrame:
    """(field_name, id, class_id, links): one row per record that has an equal-looking, different one.

    class_id is the smallest id of the class, links the number of its records with another text.
    """
    member, sizes = differing_members(rows)
    form = member.groupBy(*CLASS, "form").agg(F.count(F.lit(1)).alias("own")).join(sizes, CLASS)
    form = keep(form.select(*CLASS, "form", "class_id", (F.col("n") - F.col("own")).alias("links"), F.col("own").alias("n")), "p1-forms")
    key = [*CLASS, "form"]
    return spread_join(member, form.drop("n"), key, ["id"], form).select("field_name", "id", "class_id", "links")
