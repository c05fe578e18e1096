"""Requests to translators and vision models as Column expressions, languages by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .style import lookup
from .text import protect

#: Languages by code; fonts that stand in where none is asked for.
LANGUAGES = {"en": "English", "es": "Spanish", "fr": "French", "de": "German", "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "pl": "Polish", "ru": "Russian", "ar": "Arabic", "zh": "Chinese", "ja": "Japanese", "ko": "Korean", "hi": "Hindi", "tr": "Turkish"}
FONTS = {"ar": "DecoType Naskh", "arabic": "DecoType Naskh", "fa": "DecoType Naskh", "ur": "DecoType Naskh", "he": "DecoType Naskh"}
LAYOUT_HINTS = {"heading": "short: it has the room of one heading", "caption": "a short caption, references to figures kept", "header": "very short, brand names as they are", "footer": "very short, page numbers and dates kept", "list": "bullets, numbers and line breaks kept", "quote": "quotation marks and author kept"}
TERMS = REGIONS = 20


def language_label(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in LANGUAGES.items() for v in kv)), F.lower(code)), code)


def font_for(requested: Column, language: Column) -> Column:
    """The font asked for, else the one of the language's script."""
    return F.when(F.coalesce(requested, F.lit("")) != "", requested).otherwise(lookup(F.lower(language), FONTS, "Helvetica"))


def model_installed(model: Column, available: Column) -> Column:
    """Whether a model or one of its tagged forms (name:tag) is there; an empty name is not."""
    return (F.coalesce(model, F.lit("")) != "") & F.exists(available, lambda m: (m == model) | F.startswith(m, F.concat(model, F.lit(":"))))


def term_hint(terms: Column, n: int = TERMS) -> Column:
    """The first n pairs of array<struct<term, translation>> as one sentence; none: empty."""
    pairs = F.transform(F.slice(terms, 1, n), lambda t: F.concat(F.lit('"'), t["term"], F.lit('" → "'), t["translation"], F.lit('"')))
    return F.when(F.size(terms) > 0, F.concat(F.lit("Translate these terms so: "), F.array_join(pairs, ", "), F.lit("."))).otherwise(F.lit(""))


def _glossary(terms: Column | None) -> list[Column]:
    if terms is None:
        return []
    pairs = F.transform(terms, lambda t: F.concat(F.lit('"'), t["term"], F.lit('" → "'), t["translation"], F.lit('"')))
    return [F.when(F.size(terms) > 0, F.concat(F.lit("Terms:\n"), F.array_join(pairs, "\n")))]


_KEEP = "Leave __KEEP_N__ marks, numbers, dates, amounts, addresses, bullets and line breaks as they are. Add no notes."


def single_system(source: Column, target: Column, terms: Column | None = None) -> Column:
    head = F.concat(F.lit("Translate the text from "), language_label(source), F.lit(" into "), language_label(target), F.lit("."))
    return F.concat_ws("\n", head, F.lit(_KEEP), F.lit('Answer with JSON alone: {"translation": "..."}'), *_glossary(terms))


def batch_system(source: Column, target: Column, count: Column, terms: Column | None = None) -> Column:
    head = F.concat(F.lit("Translate all "), count.cast("string"), F.lit(" items from "), language_label(source), F.lit(" into "), language_label(target), F.lit(", each under its id; none is left out, joined or added. Keep within max_chars where it is given: say it shorter, cut no word."))
    return F.concat_ws("\n", head, F.lit(_KEEP), F.lit('Answer with JSON alone: {"translations": [{"id": 0, "text": "..."}]}'), *_glossary(terms))


def single_user(layout_type: Column, text: Column) -> Column:
    hint = lookup(layout_type, LAYOUT_HINTS, None)
    return F.concat_ws("\n", F.concat(F.lit("Kind: "), layout_type), F.when(hint.isNotNull(), F.concat(F.lit("Hint: "), hint)), protect(text)["text"])


def batch_item(number: Column, layout_type: Column, text: Column, max_chars: Column, prev: Column, following: Column) -> Column:
    """One item of a batch request as a struct; absent fields drop out of its JSON."""
    hint = lookup(layout_type, LAYOUT_HINTS, None)
    return F.struct(number.alias("id"), layout_type.alias("type"), protect(text)["text"].alias("text"), hint.alias("hint"), max_chars.alias("max_chars"), F.substring(prev, 1, 120).alias("prev"), F.substring(following, 1, 120).alias("next"))


def batch_user(items: Column) -> Column:
    return F.to_json(F.struct(items.alias("items")))


def region_summary(regions: Column, n: int = REGIONS) -> Column:
    """kind@x,y of the first n regions (struct element_type, x, y), comma-joined."""
    one = lambda r: F.concat(r["element_type"], F.lit("@"), r["x"].cast("int").cast("string"), F.lit(","), r["y"].cast("int").cast("string"))
    return F.array_join(F.transform(F.slice(regions, 1, n), one), ", ")
