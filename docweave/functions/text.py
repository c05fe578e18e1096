"""Text functions: scripts, languages, lengths, placeholders, glossary, markup, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scripts counted to tell a language.
SCRIPTS = {"ar": "[\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF]", "ru": "[\u0400-\u04FF]", "zh": "[\u4E00-\u9FFF\u3040-\u30FF\uAC00-\uD7AF]", "en": "[A-Za-z]"}
#: Fixed value: Arabic letters with their presentation forms.
ARABIC = "[\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF\uFB50-\uFDFF\uFE70-\uFEFF]"
#: Kana and hangul.
KANA, HANGUL = "[\u3040-\u30FF]", "[\uAC00-\uD7AF]"
SAMPLE, LEAST = 8000, 8
RTL = ("ar", "fa", "ur", "he")
#: What must survive translation, in order of precedence.
PROTECTED = r"(?U)(\{[^}]+\}|\[\[[^\]]+\]\]|[$€£¥]\s?[\d,.]+|\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|\b\d{4}\b|@[\w.-]+\.\w+)"
SHORTENED = ("heading", "header", "footer", "caption")


def strip(c: Column) -> Column:
    """White space off both ends, any Unicode kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def contains_arabic(c: Column) -> Column:
    return F.coalesce(c.rlike(ARABIC), F.lit(False))


def is_cjk(c: Column) -> Column:
    return F.coalesce(c.rlike(SCRIPTS["zh"]), F.lit(False))


def is_rtl_language(lang: Column) -> Column:
    return F.coalesce(F.substring(F.lower(lang), 1, 2).isin(*RTL), F.lit(False))


def detect_language(c: Column, default: str = "en") -> Column:
    """By script counts over the first SAMPLE characters; the first maximum wins."""
    s = F.substring(c, 1, SAMPLE)
    n = {k: F.regexp_count(s, F.lit(p)) for k, p in SCRIPTS.items()}
    top = F.greatest(*n.values())
    east = F.when(s.rlike(KANA), "ja").when(s.rlike(HANGUL), "ko").otherwise("zh")
    best = F.when(n["ar"] == top, "ar").when(n["ru"] == top, "ru").when(n["zh"] == top, east).otherwise("en")
    return F.when(blank(c) | (top < LEAST), F.lit(default)).otherwise(best)


def max_chars(width: Column, height: Column, font_size: Column) -> Column:
    per_line = F.greatest(F.lit(10), F.floor(width / (font_size * 0.55)).cast("int"))
    return per_line * F.greatest(F.lit(1), F.floor(height / (font_size * 1.25)).cast("int"))


def enforce_length(c: Column, limit: Column, layout_type: Column) -> Column:
    """Cut to limit (0 or null: no limit); short kinds of text end in an ellipsis."""
    cut = F.concat(F.regexp_replace(F.substring(c, F.lit(1), F.greatest(limit - 1, F.lit(0))), r"(?U)\s+$", ""), F.lit("…"))
    over = (F.coalesce(limit, F.lit(0)) > 0) & (F.length(c) > limit)
    return F.when(over & layout_type.isin(*SHORTENED), cut).when(over, F.substring(c, F.lit(1), limit)).otherwise(c)


def protect(c: Column) -> Column:
    """struct<text, kept>: protected stretches become __KEEP_n__, kept holds them in order."""
    kept = F.regexp_extract_all(c, F.lit(PROTECTED), F.lit(1))
    parts = F.split(c, PROTECTED, -1)
    wrapped = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.when(i < F.size(kept), F.concat(F.lit("__KEEP_"), i.cast("string"), F.lit("__"))).otherwise(F.lit("")))), "")
    return F.struct(wrapped.alias("text"), kept.alias("kept"))


def unprotect(c: Column, kept: Column, name: str = "KEEP") -> Column:
    """Placeholders back to what they stand for, also where underscores were lost; the
    highest number first, so that 1 does not match inside 10."""
    order = F.when(F.size(kept) > 0, F.sequence(F.size(kept) - 1, F.lit(0))).otherwise(F.array().cast("array<int>"))

    def back(acc: Column, i: Column) -> Column:
        bare = F.concat(F.lit(f"{name}_"), i.cast("string"))
        for key in (F.concat(F.lit("__"), bare, F.lit("__")), F.concat(F.lit("_"), bare, F.lit("_")), bare):
            acc = F.replace(acc, key, F.get(kept, i))
        return acc

    return F.aggregate(order, c, back)


def wrap_terms(c: Column, terms: Column) -> Column:
    """struct<text, used>: glossary terms (array<struct<term, translation>>), longest first,
    become __GLOSS_n__; used holds their translations in order of n."""
    ordered = F.array_sort(terms, lambda a, b: F.when(F.length(a["term"]) != F.length(b["term"]), F.length(b["term"]) - F.length(a["term"])).when(a["term"] < b["term"], -1).when(a["term"] > b["term"], 1).otherwise(0))
    start = F.struct(c.alias("text"), F.array().cast("array<string>").alias("used"))

    def step(acc: Column, t: Column) -> Column:
        hit = (t["term"] != "") & F.contains(acc["text"], t["term"])
        key = F.concat(F.lit("__GLOSS_"), F.size(acc["used"]).cast("string"), F.lit("__"))
        return F.struct(F.when(hit, F.replace(acc["text"], t["term"], key)).otherwise(acc["text"]).alias("text"), F.when(hit, F.concat(acc["used"], F.array(t["translation"]))).otherwise(acc["used"]).alias("used"))

    return F.aggregate(ordered, start, step)


def unwrap_terms(c: Column, used: Column) -> Column:
    return unprotect(c, used, "GLOSS")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_table_rows(html: Column) -> Column:
    """array<array<string>>: cell texts of each table row, tags off."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    clean = lambda t: strip(F.regexp_replace(t, r"(?s)<[^>]+>", ""))
    return F.filter(F.transform(rows, lambda r: F.transform(cells(r), clean)), lambda r: F.size(r) > 0)


def file_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def region_hash(regions: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("v2:"), F.to_json(regions)), 256), 1, 16)


def effective_text(original: Column, translated: Column, use_translated: bool = True) -> Column:
    return F.when(F.lit(use_translated) & (F.coalesce(translated, F.lit("")) != ""), translated).otherwise(original)


def token_overlap(a: Column, b: Column) -> Column:
    """Distinct shared tokens over the number of a's tokens, at most 0.9."""
    x, y = tokens(F.lower(a)), tokens(F.lower(b))
    return F.least(F.lit(0.9), F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.lit(1)))


def qa_score(original: Column, back: Column, translated: Column) -> Column:
    """Back-translation check: 0 without translation, 1 if equal, 0.75 if one holds the other, else overlap."""
    a, b = strip(F.lower(original)), strip(F.lower(back))
    return F.when(F.coalesce(translated, F.lit("")) == "", 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.75).otherwise(token_overlap(a, b))


def output_name(path: Column, extension: str, translated: bool, semantic: bool = False) -> Column:
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    return F.concat(stem, F.lit(f"_{'translated' if translated else 'original'}{'_semantic' if semantic else ''}.{extension}"))


def first_json(c: Column) -> Column:
    """The widest {...} of a free text."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def parse_translation(content: Column) -> Column:
    """Text of a translator's JSON answer: a string, a known field, or the first of translations."""
    fields = [F.get_json_object(content, f"$.{k}") for k in ("translation", "translated", "text", "output")] + [F.get_json_object(content, "$.translations[0]")]
    plain = F.when(content.rlike(r'^\s*".*"\s*$'), F.from_json(F.concat(F.lit('{"v":'), content, F.lit("}")), "v string")["v"])
    return F.coalesce(plain, *(F.when(~blank(f), f) for f in fields))
