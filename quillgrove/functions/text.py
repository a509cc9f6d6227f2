"""Scalar functions on page texts, titles and section codes, as column expressions.

Lengths that the data model gives in bytes use octet_length, those in characters length. Java's
``\\s`` is ASCII only, so white space is spelled out.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of any script, and what a title or page may keep, as regular expression classes.
SPACE = r"[\s\p{Z}\x{85}]"
UNPRINTABLE = r"[^\p{L}\p{M}\p{N}\p{P}\p{S}\p{Z}\t\n\x0B\f\r\x{85}]"
HEADING = r"###\s*(\d+\.\d+)\s*(.+)"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: Column | str) -> Column:
    """Trims white space of any script; trim() knows the ASCII space alone."""
    return F.regexp_replace(col(text), rf"^{SPACE}+|{SPACE}+$", "")


def one_line(text: Column | str) -> Column:
    """With spaces for line ends, for a prompt whose lines have their places."""
    return F.translate(col(text), "\n\r", "  ")


def clean_text(text: Column | str) -> Column:
    """Without what can't be printed; white space stays."""
    return F.regexp_replace(col(text), UNPRINTABLE, "")


def dots_to_colon(text: Column | str) -> Column:
    """Dot leaders (five dots or more, or five times dot and space) become a colon and a space."""
    plain = F.regexp_replace(col(text), r"\.{5,}", ": ")
    return F.regexp_replace(plain, r"(?:\. ){5,}\.?", ": ")


def page_tags(text: Column | str, number: Column | str) -> Column:
    """A page between the markers that tell where it begins and ends."""
    n = col(number).cast("string")
    return F.concat(F.lit("【第"), n, F.lit("页开始】\n"), col(text), F.lit("\n【第"), n, F.lit("页结束】\n\n"))


def physical_index(text: Column | str) -> Column:
    """The page number in a marker, in <physical_index_N>, physical_index_N or N; null where there is none."""
    own = strip(text)
    bare = F.regexp_replace(own, "[【】]|开始|结束", "")
    marked = F.regexp_extract(bare, r"第(\d+)页", 1)
    has_marker = own.contains("第") & own.contains("页") & (marked != "")
    tagged = F.regexp_replace(F.substring(own, 17, 1_000_000), ">$", "")
    plain = F.when(own.startswith("<physical_index_"), tagged).when(own.startswith("physical_index_"), F.substring(own, 16, 1_000_000)).otherwise(own)
    number = F.regexp_extract(strip(plain), r"^([+-]?\d+)$", 1)
    return F.when(has_marker, marked.try_cast("int")).otherwise(number.try_cast("int"))


def normalize_structure(code: Column | str) -> Column:
    """Digits and dots of a section code: 321 is 3.2.1, but 31 stays; empty parts and leading zeros go."""
    kept = F.regexp_replace(col(code), r"[^\p{Nd}.]", "")
    dotted = F.when(~kept.contains(".") & (F.octet_length(kept) > 2), F.regexp_replace(kept, r"(?<=.)(?=.)", ".")).otherwise(kept)
    parts = F.filter(F.split(dotted, r"\."), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p.try_cast("bigint").cast("string"), p)), ".")


def parent_structure(code: Column | str) -> Column:
    """The code less its last part; '' for a chapter."""
    return F.when(col(code).contains("."), F.regexp_replace(col(code), r"\.[^.]*$", "")).otherwise("")


def normalize_title(title: Column | str) -> Column:
    """Lower case, without punctuation, white space made one space."""
    bare = F.regexp_replace(F.lower(col(title)), r"\p{P}", "")
    return strip(F.regexp_replace(bare, rf"{SPACE}+", " "))


def clean_title(title: Column | str) -> Column:
    """One line, cut at a dash between spaces, printable, of 30 characters at most (cut at a space or comma where there is one)."""
    line = one_line(title)
    for dash in (" - ", " — "):
        line = F.when(line.startswith(dash), line).otherwise(F.regexp_replace(line, f"(?s)^(.+?){dash}.*$", "$1"))
    seen = F.trim(F.regexp_replace(line, r"[^\p{L}\p{M}\p{N}\p{P}\p{S} ]|\x{FFFD}", ""))
    head = F.substring(seen, 1, 30)
    broken = F.regexp_extract(head, "^(.{16,29})[ 、，：]", 1)
    cut = F.regexp_replace(F.when(broken != "", broken).otherwise(head), r"[\p{P} ]+$", "")
    short = F.when(F.length(seen) > 30, cut).otherwise(seen)
    return F.trim(F.regexp_replace(F.regexp_replace(short, ":$", ""), "：$", ""))


def bounded_distance(a: Column | str, b: Column | str, most: int = 3) -> Column:
    """Edit distance in characters, most + 1 where it is more."""
    found = F.levenshtein(col(a), col(b), most)
    return F.when(found < 0, most + 1).otherwise(found)


def digit_changes(a: Column | str, b: Column | str) -> Column:
    """Places, by byte, where both have a digit and not the same one."""
    x, y = col(a).cast("binary"), col(b).cast("binary")
    digit = lambda v: (v >= F.lit(b"0")) & (v <= F.lit(b"9"))
    at = lambda v, k: v.substr(k, F.lit(1))
    shared = F.octet_length(x) - F.greatest(F.lit(0), F.octet_length(x) - F.octet_length(y))
    changed = F.filter(F.sequence(F.lit(1), shared), lambda k: digit(at(x, k)) & digit(at(y, k)) & (at(x, k) != at(y, k)))
    return F.when(x.isNotNull() & y.isNotNull(), F.when(shared > 0, F.size(changed)).otherwise(0))


def titles_match(a: Column | str, b: Column | str, fuzzy: bool = False) -> Column:
    """Whether two titles name one section.

    They do if they are equal when normalised. The rule is meant to allow three edits and one
    changed digit too, but as it has always been applied only titles of up to four characters pass
    it, those of four only if the shorter one's first character occurs in the longer. `fuzzy` allows
    the edits for titles of any length.
    """
    x, y = normalize_title(a), normalize_title(b)
    near = (bounded_distance(x, y) <= 3) & (digit_changes(x, y) <= 1)
    if not fuzzy:
        short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
        near = near & ((F.length(long) < 4) | ((F.length(long) == 4) & F.contains(long, F.substring(short, 1, 1)) & (short != "")))
    return (x == y) | near


def arabic_to_chinese(number: Column | str) -> Column:
    """1 to 99 as Chinese numerals, others as they are."""
    n = col(number)
    digit = lambda c: F.translate(c, "123456789", "一二三四五六七八九")
    tens, ones = F.substring(n, 1, 1), F.substring(n, 2, 1)
    two = F.concat(F.when(tens == "1", "").otherwise(digit(tens)), F.lit("十"), F.when(ones == "0", "").otherwise(digit(ones)))
    return F.when(n.rlike("^[1-9][0-9]$"), two).when(n.rlike("^[1-9]$"), digit(n)).otherwise(n)


def is_chapter_title(title: Column | str) -> Column:
    return col(title).rlike(r"^第[零一二三四五六七八九十百千万\d]+章")


def chapter_number(title: Column | str) -> Column:
    """What stands between 第 and 章, as a Chinese numeral; '' if the title has none."""
    found = strip(F.regexp_extract(col(title), "第(.+?)章", 1))
    return F.when(found.rlike("^[0-9]+$"), arabic_to_chinese(found)).otherwise(found)


def json_fence(reply: Column | str) -> Column:
    """What a reply's ```json fence holds, or the reply itself."""
    inside = F.regexp_extract(col(reply), r"(?s)```json(.*?)(?:```|\z)", 1)
    return strip(F.when(col(reply).contains("```json"), inside).otherwise(col(reply)))


def page_range(start: Column | str, end: Column | str) -> Column:
    return F.when(col(start) == col(end), F.concat(F.lit("page "), col(start).cast("string"))).otherwise(F.concat(F.lit("pages "), col(start).cast("string"), F.lit("-"), col(end).cast("string")))


def node_id(*parts: Column | str) -> Column:
    """A 16-digit id that depends on the parts alone."""
    return F.substring(F.sha2(F.concat_ws("|", *(col(p).cast("string") for p in parts)), 256), 1, 16)


# Code ranges of scripts; in each the language that it stands for.
SCRIPTS: dict[str, tuple[str, str, str]] = {
    "Han": (r"\x{4E00}-\x{9FFF}\x{2E80}-\x{2EFF}\x{F900}-\x{FAFF}\x{3400}-\x{4DBF}", "zh", "Chinese"),
    "Hangul": (r"\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}", "ko", "Korean"),
    "Hiragana": (r"\x{3040}-\x{309F}", "ja", "Japanese"),
    "Katakana": (r"\x{30A0}-\x{30FF}", "ja", "Japanese"),
    "Cyrillic": (r"\x{0400}-\x{052F}", "ru", "Russian"),
    "Arabic": (r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}", "ar", "Arabic"),
    "Devanagari": (r"\x{0900}-\x{097F}", "hi", "Hindi"),
    "Thai": (r"\x{0E00}-\x{0E7F}", "th", "Thai"),
    "Latin": (r"\x{41}-\x{7A}\x{80}-\x{24F}", "en", "English"),
}
DISPLAY = {"zh": "Chinese (中文)", "en": "English", "ja": "Japanese (日本語)", "ko": "Korean (한국어)"}


@functools.cache
def _kinds() -> np.ndarray:
    """By code point a bit for each script, and one for all that counts: neither white space, punctuation nor symbol."""
    kinds = np.zeros(0x110000, np.uint16)
    for k, (ranges, _, _) in enumerate(SCRIPTS.values()):
        for low, high in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", ranges):
            kinds[int(low, 16) : int(high, 16) + 1] |= 1 << k
    kinds |= 1 << len(SCRIPTS)
    skipped = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] in "PSZ"]
    kinds[[*skipped, *b"\t\n\x0b\x0c\r", 0x85]] = 0
    return kinds


#: Characters that are counted at once.
BLOCK = 1 << 20


def _counted(texts: pd.Series) -> pd.DataFrame:
    """Code points of a block of texts looked up at once, and counted up to where each text ends."""
    names, out = ["total", *SCRIPTS], np.zeros((len(texts), 1 + len(SCRIPTS)), np.int32)
    lengths = texts.str.len().to_numpy(np.int64)
    begin = 0
    while begin < len(texts):
        end = begin + max(1, int(np.searchsorted(np.cumsum(lengths[begin:]), BLOCK, "right")))
        found = _kinds()[np.frombuffer("".join(texts.iloc[begin:end]).encode("utf-32-le"), np.uint32)]
        ends, present = np.cumsum(lengths[begin:end]), int(np.bitwise_or.reduce(found, initial=0))
        for at, bit in enumerate([len(SCRIPTS), *range(len(SCRIPTS))]):
            if not present >> bit & 1:
                continue
            upto = np.concatenate(([0], np.cumsum((found >> bit) & 1, dtype=np.int64)))
            out[begin:end, at] = np.diff(upto[ends], prepend=0)
        begin = end
    return pd.DataFrame(out, columns=names)


def script_counts(text: Column | str, sample: int | None = None) -> Column:
    """Characters of each script, and in all, less white space, punctuation and symbols; of the whole text, or its first `sample` characters."""
    whole = F.coalesce(col(text), F.lit(""))
    counted = F.pandas_udf(_counted, ", ".join(f"{name} int" for name in ("total", *SCRIPTS)))
    return counted(whole if sample is None else F.substring(whole, 1, sample))


def with_scripts(texts: DataFrame, text: Column | str = "text", sample: int | None = None) -> DataFrame:
    """texts with their script_counts() as `scripts`. They are generated, so that what reads several of them counts once."""
    return texts.withColumn("scripts", F.explode(F.array(script_counts(text, sample))))


def language(counts: Column | str) -> Column:
    """code, name, script and confidence from script_counts(); ties go to the script that is listed first.

    Han beside kana is Japanese. Latin stands for English, at four fifths of the confidence. Texts
    without a script are taken for English, at none.
    """
    c = col(counts)
    options = F.array(*(F.struct(c[name].alias("n"), F.lit(-k).alias("order"), F.lit(name).alias("script"), F.lit(code).alias("code"), F.lit(full).alias("name")) for k, (name, (_, code, full)) in enumerate(SCRIPTS.items())))
    best = F.array_max(options)
    share = best["n"].cast("double") / c["total"]
    kana = (best["script"] == "Han") & (c["Hiragana"] + c["Katakana"] > 0)
    japanese = kana | best["script"].isin("Hiragana", "Katakana")
    none = (c["total"] == 0) | (best["n"] == 0)
    return F.struct(
        F.when(none, "en").when(japanese, "ja").otherwise(best["code"]).alias("code"),
        F.when(none, "English").when(japanese, "Japanese").otherwise(best["name"]).alias("name"),
        F.when(none, "Latin").when(japanese, "Japanese").otherwise(best["script"]).alias("script"),
        F.when(none, 0.0).when(best["script"] == "Latin", share * 0.8).otherwise(share).alias("confidence"),
    )


def language_name(code: Column | str, name: Column | str) -> Column:
    found = col(name)
    for key, shown in DISPLAY.items():
        found = F.when(col(code) == key, shown).otherwise(found)
    return found
