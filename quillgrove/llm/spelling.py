"""Spelling variants: words one edit apart, found by bands of letter parity.

A word's mask has a bit for each letter, set where the letter occurs an odd number of times. One
inserted, deleted or replaced letter flips at most two bits, so of three bands that the mask is cut
into at least one is the same. Words meet where a band and the length (or the length less one) are
equal; a distance of one edit is then verified. Bands that many words share are divided by halves of
the words: of the two halves around an edit one stays as it is, so nothing is lost.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrove.llm.store import stored

#: What a run is made of; the hash's divisor that takes a letter out; least length and occurrences.
RUN = r"[A-Za-zÀ-ÿ]"
DROP_EACH = 31
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form has at least so many times its word's occurrences.
RATIO = 10
BANDS, WIDTH = 3, 21
#: Words of a band and length from which on they meet by halves.
CROWD = 256


def runs(docs: DataFrame) -> DataFrame:
    """(word) of documents(doc_id, text): a row for each run that may give a word, A-Z lowered, one letter gone where the hash says so.

    A null doc_id is written as nothing. Runs shorter than a word are left out, as they only get shorter.
    """
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN + "{%d,}" % LEAST_LENGTH), F.lit(0))).alias("run"))
    lowered = found.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    hashed = lowered.select("run", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % DROP_EACH == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)


def counted(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of documents that occur often enough."""
    return runs(docs).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def letter_bits(words: DataFrame) -> dict[str, int]:
    """A bit for each letter: the commonest letters go to the three bands in turn. There are few letters, so the driver ranks them."""
    often = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").count().orderBy(F.desc("count"), "c").collect()
    return {r.c: (k % BANDS) * WIDTH + k // BANDS % WIDTH for k, r in enumerate(often)}


def mask(word: str, bits: dict[str, int]) -> Column:
    """The parity of each letter's number as bits of a long. Letters that share a bit still flip at most two by one edit."""
    flips = [0] * 256
    for c, k in bits.items():
        flips[ord(c)] = 1 << k
    table = F.array(*(F.lit(x).cast("long") for x in flips))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda held, c: held.bitwiseXOR(F.when(c == "", F.lit(0).cast("long")).otherwise(F.get(table, F.ascii(c)))))


def candidates(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, na, b, nb) of words(word, n, mask), each once, of which a band and the length rule agree.

    `a` is the shorter one, or of two of a length the one that comes first.
    """
    size = (1 << WIDTH) - 1
    band = lambda m, k: F.shiftrightunsigned(F.col(m), k * WIDTH).bitwiseAND(F.lit(size))
    length = F.length("word")
    # The length of the shorter word of a pair: this one's own, or one less.
    roles = F.array(F.struct(length.alias("shorter"), F.lit(False).alias("longer")), F.struct((length - 1).alias("shorter"), F.lit(True).alias("longer")))
    bands = F.array(*(F.struct(F.lit(k).alias("band"), band("mask", k).alias("bits")) for k in range(BANDS)))
    dealt = words.select("word", "n", "mask", F.explode(roles).alias("r")).select("*", F.explode(bands).alias("b"))
    dealt = dealt.select("word", "n", "mask", "r.*", "b.*").where(F.col("shorter") >= LEAST_LENGTH)
    crowds = stored(dealt.groupBy("band", "bits", "shorter").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > crowd).drop("rows"), "crowds")
    half = F.floor(F.col("shorter") / 2).cast("int")
    front, back = F.substring("word", F.lit(1), half), F.col("word").substr(F.length("word") - (F.col("shorter") - half) + 1, F.col("shorter"))
    marked = dealt.join(crowds.withColumn("crowded", F.lit(True)), ["band", "bits", "shorter"], "left")
    sides = F.when(F.col("crowded"), F.array(F.struct(F.lit(1).alias("side"), front.alias("part")), F.struct(F.lit(2).alias("side"), back.alias("part")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.lit("").alias("part"))))
    keyed = marked.select("band", "bits", "shorter", "longer", "word", "n", "mask", F.explode(sides).alias("s")).select("*", "s.*").drop("s")
    left = keyed.where("not longer").select("band", "bits", "shorter", "side", "part", F.col("word").alias("a"), F.col("n").alias("na"), F.col("mask").alias("ma"))
    right = keyed.select("band", "bits", "shorter", "side", "part", "longer", F.col("word").alias("b"), F.col("n").alias("nb"), F.col("mask").alias("mb"))
    met = left.join(right, ["band", "bits", "shorter", "side", "part"]).where(F.col("longer") | (F.col("a") < F.col("b")))
    met = met.where(F.bit_count(F.col("ma").bitwiseXOR(F.col("mb"))) <= 2)
    # A pair is kept in the first band that agrees, and by the first half that does.
    first = F.lit(True)
    for k in range(1, BANDS):
        lower = F.lit(True)
        for j in range(k):
            lower = lower & (band("ma", j) != band("mb", j))
        first = first & ((F.col("band") != k) | lower)
    cut = F.floor(F.col("shorter") / 2).cast("int")
    other = (F.col("side") != 2) | (F.substring("a", F.lit(1), cut) != F.substring("b", F.lit(1), cut))
    return met.where(first & other).select("a", "na", "b", "nb")


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, na, b, nb) of words(word, n, mask) exactly one edit apart, each once."""
    return candidates(words, crowd).where(F.levenshtein("a", "b", 1) == 1)


def variants(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of documents(doc_id, text). See the module on how.

    A word's form is its near word that occurs most (of equal ones the smallest), if that is at least ten
    times as often; its root is where forms lead, itself if it has none. Null and empty texts have no
    words; repeated rows count again; an empty table gives no rows; other columns are not looked at.
    """
    words = stored(counted(docs), "words")
    bits = letter_bits(words)
    pairs = stored(near_pairs(words.withColumn("mask", mask("word", bits)), crowd), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("form"))).alias("best"))
    formed = words.join(best, "word", "left").withColumn("fits", F.coalesce(-F.col("best.m") >= F.col("n") * RATIO, F.lit(False)))
    formed = stored(formed.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("fits"), F.col("best.form")).alias("form"), F.when(F.col("fits"), -F.col("best.m")).alias("form_n")), "forms")
    # Each form occurs ten times as often as its word: the commonest word bounds how far forms lead.
    steps = stored(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    most = words.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(max(1.0, math.log10(most)) + 1))):
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = stored(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    out = formed.join(steps, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
