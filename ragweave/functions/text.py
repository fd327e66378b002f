"""Text functions as column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragweave.plans.config import HEADINGS, REMOVED_SECTIONS

#: The 29 code points that count as white space.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE = r"(?U)[\s\x1c-\x1f]+"
_HEADINGS = "|".join(h.replace(".", r"\.") for h in HEADINGS)
_REMOVED = "|".join(REMOVED_SECTIONS)


def join_wrapped_lines(c: Column) -> Column:
    """A single line break becomes a space; runs of two and more stay."""
    return F.regexp_replace(c, r"\n(?<!\n\n)(?!\n)", " ")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def trim_boilerplate(c: Column) -> Column:
    """What lies between the first START OF and END OF markers, after line joining; a missing one leaves its side open."""
    text = join_wrapped_lines(c)
    start, end = (F.lit(rf"(?id)\*\*\* {word} OF.*?\*\*\*") for word in ("START", "END"))
    first = F.when(F.regexp_instr(text, start) > 0, F.regexp_instr(text, start) + F.length(F.regexp_substr(text, start))).otherwise(F.lit(1))
    stop = F.when(F.regexp_instr(text, end) > 0, F.regexp_instr(text, end)).otherwise(F.length(text) + 1)
    between = F.substring(text, first, F.greatest(F.lit(0), stop - first))
    return strip(F.when(F.contains(text, F.lit("*** ")), between).otherwise(text))


def contents_slice(c: Column) -> Column:
    """From the last TABLE OF CONTENTS on, else from the last CONTENTS on, else the whole text."""

    def last(marker: str) -> Column:
        return F.substring(c, F.length(c) - F.locate(marker[::-1], F.reverse(c)) - len(marker) + 2, F.length(c))

    table, contents = "TABLE OF CONTENTS", "CONTENTS"
    return F.when(F.contains(c, F.lit(table)), last(table)).when(F.contains(c, F.lit(contents)), last(contents)).otherwise(c)


def paragraphs(c: Column) -> Column:
    return F.split(c, "\n\n", -1)


def normalize_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def structural_split(c: Column) -> Column:
    """Blocks that begin at a line with a heading word."""
    return F.split(c, rf"(?iU)\n(?=(?:{_HEADINGS})\s+)", -1)


def is_heading(c: Column) -> Column:
    return c.rlike(rf"(?iU)^(?:{_HEADINGS})\s+[IVXLCDM\d]+")


def is_removed_heading(c: Column, names: tuple[str, ...] = REMOVED_SECTIONS) -> Column:
    """Whether a paragraph begins with the name of a section that is left out."""
    return F.upper(F.substring(c, 1, max(map(len, names)))).rlike("^(?:" + "|".join(names) + ")")


def sentences(c: Column) -> Column:
    """Rule-based sentences: cut at white space after a full stop, exclamation or question mark; empty ones dropped."""
    return F.filter(F.split(c, r"\s(?<=[.!?]\s)\s*", -1), lambda s: s != "")


def source_title(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("_"), F.lit(" ")), F.lit(".txt"), F.lit(""))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, SPACE, -1), lambda w: w != ""))


def has_quoted_span(c: Column) -> Column:
    return c.rlike("(?d)[\"'].*?[\"']")


def stem_hits(c: Column, lexicon: tuple[str, ...]) -> Column:
    """How many of the lexicon's entries occur anywhere in the lower-cased text."""
    return F.size(F.filter(F.array(*(F.lit(w) for w in lexicon)), lambda w: F.contains(F.lower(c), w)))


def display_score(c: Column) -> Column:
    """Four decimals; nothing and zero show as N/A."""
    return F.when(c.isNull() | (c == 0), F.lit("N/A")).otherwise(F.round(c, 4).cast("string"))


def wrap(c: Column, width: int) -> Column:
    """Break lines at white space so that none is longer than width, where words allow."""
    return F.regexp_replace(F.regexp_replace(c, rf"(.{{1,{width}}})(?:\s+|$)", "$1\n"), r"\n$", "")


def fold_sentences(items: Column, limit: int, strict: bool = False, joiner: int = 0) -> Column:
    """Pack sentences greedily: one joins the part at hand while both lengths fit the limit; a longer one stands alone."""

    def fits(buffer: Column, s: Column) -> Column:
        total = F.length(buffer) + F.length(s) + joiner
        return total < limit if strict else total <= limit

    def step(acc: Column, s: Column) -> Column:
        added = F.trim(F.concat_ws(" ", acc["buf"], s))
        full = F.when(acc["buf"] != "", F.concat(acc["out"], F.array(acc["buf"]))).otherwise(acc["out"])
        return F.when(fits(acc["buf"], s), F.struct(added.alias("buf"), acc["out"].alias("out"))).otherwise(F.struct(s.alias("buf"), full.alias("out")))

    start = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(items, start, step, lambda a: F.when(a["buf"] != "", F.concat(a["out"], F.array(a["buf"]))).otherwise(a["out"]))


def sub_chunks(c: Column, limit: int = 800) -> Column:
    """Pieces of a text for an embedder: itself if short, else paragraphs, else packed lines, over-long ones sliced."""

    def slices(line: Column) -> Column:
        count = F.ceil(F.length(line) / limit).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.substring(line, i * limit + 1, F.lit(limit)))

    def lines(p: Column) -> Column:
        def step(acc: Column, line: Column) -> Column:
            done = F.when(acc["buf"] != "", F.concat(acc["out"], F.array(F.trim(acc["buf"])))).otherwise(acc["out"])
            joined = F.when(acc["buf"] != "", F.concat(acc["buf"], F.lit(" "), line)).otherwise(line)
            return (
                F.when(F.length(acc["buf"]) + F.length(line) + 1 <= limit, F.struct(joined.alias("buf"), acc["out"].alias("out")))
                .when(F.length(line) > limit, F.struct(F.lit("").alias("buf"), F.concat(done, slices(line)).alias("out")))
                .otherwise(F.struct(line.alias("buf"), done.alias("out")))
            )

        start = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(F.split(p, "\n", -1), start, step, lambda a: F.when(a["buf"] != "", F.concat(a["out"], F.array(F.trim(a["buf"])))).otherwise(a["out"]))

    parts = F.filter(F.transform(paragraphs(c), strip), lambda p: p != "")
    return F.when(F.length(c) <= limit, F.array(c)).otherwise(F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(lines(p)))))


def porter_stem(word: str) -> str:
    """Stem of a lower-case word by the published suffix-stripping algorithm of 1980."""
    if len(word) <= 2:
        return word

    def consonant(w: str, i: int) -> bool:
        return w[i] not in "aeiou" and not (w[i] == "y" and i > 0 and consonant(w, i - 1))

    def measure(w: str) -> int:
        kinds = "".join("c" if consonant(w, i) else "v" for i in range(len(w)))
        return sum(1 for i in range(1, len(kinds)) if kinds[i - 1 : i + 1] == "vc")

    def vowel(w: str) -> bool:
        return any(not consonant(w, i) for i in range(len(w)))

    def double(w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and consonant(w, len(w) - 1)

    def cvc(w: str) -> bool:
        return len(w) > 2 and consonant(w, len(w) - 3) and not consonant(w, len(w) - 2) and consonant(w, len(w) - 1) and w[-1] not in "wxy"

    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + to
            break
    again = False
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and vowel(word[:-2]):
        word, again = word[:-2], True
    elif word.endswith("ing") and vowel(word[:-3]):
        word, again = word[:-3], True
    if again:
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif measure(word) == 1 and cvc(word):
            word += "e"
    if word.endswith("y") and vowel(word[:-1]):
        word = word[:-1] + "i"
    # Suffixes and what they become.
    second = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
    third = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
    for table in (second, third):
        for suffix in sorted(table, key=len, reverse=True):
            if word.endswith(suffix):
                if measure(word[: -len(suffix)]) > 0:
                    word = word[: -len(suffix)] + table[suffix]
                break
    fourth = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
    for suffix in sorted(fourth, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not cvc(word[:-1]))):
        word = word[:-1]
    return word[:-1] if double(word) and word.endswith("l") and measure(word) > 1 else word
