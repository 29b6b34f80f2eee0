"""Names and tags of languages: collation and canonical language tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import language_tag

#: Language tags, or their first subtags, that have another one in use now.
LANGUAGE_ALIASES = {
    "in": "id", "iw": "he", "ji": "yi", "jw": "jv", "mo": "ro", "tl": "fil", "sh": "sr-Latn", "scc": "sr", "scr": "hr", "aam": "aas", "aju": "jrb", "ayr": "ay", "cmn": "zh", "swh": "sw", "prs": "fa-AF", "tzm-latn": "zgh-Latn",
    "art-lojban": "jbo", "cel-gaulish": "xtg", "en-gb-oed": "en-GB-oxendict", "i-ami": "ami", "i-bnn": "bnn", "i-hak": "hak", "i-klingon": "tlh", "i-lux": "lb", "i-navajo": "nv", "i-pwn": "pwn", "i-tao": "tao", "i-tay": "tay", "i-tsu": "tsu",
    "no-bok": "nb", "no-nyn": "nn", "sgn-be-fr": "sfb", "sgn-be-nl": "vgt", "sgn-ch-de": "sgg", "zh-guoyu": "zh", "zh-hakka": "hak", "zh-min-nan": "nan", "zh-xiang": "hsn",
    "ara": "ar", "bul": "bg", "cat": "ca", "ces": "cs", "cze": "cs", "dan": "da", "deu": "de", "dut": "nl", "ell": "el", "eng": "en", "est": "et", "fin": "fi", "fra": "fr", "fre": "fr", "ger": "de", "gre": "el", "heb": "he", "hin": "hi", "hrv": "hr", "hun": "hu",
    "ita": "it", "jpn": "ja", "kor": "ko", "lav": "lv", "lit": "lt", "nld": "nl", "nob": "nb", "nno": "nn", "nor": "no", "pol": "pl", "por": "pt", "ron": "ro", "rum": "ro", "rus": "ru", "slk": "sk", "slo": "sk", "slv": "sl", "spa": "es", "srp": "sr", "swe": "sv", "tur": "tr", "ukr": "uk", "vie": "vi", "zho": "zh", "chi": "zh",
}
#: Regions that have another code now.
REGION_ALIASES = {"BU": "MM", "DD": "DE", "FX": "FR", "TP": "TL", "UK": "GB", "YD": "YE", "ZR": "CD"}


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def canonical_tag(text: Column) -> Column:
    """A language tag in its shape, with the longest beginning that has an alias replaced by that, and its
    region too. The rest stays; null stays null."""
    parts = F.split(F.lower(F.replace(F.btrim(text), F.lit("_"), F.lit("-"))), "-")
    known = _table(LANGUAGE_ALIASES)
    begins = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.struct(n.alias("n"), F.try_element_at(known, F.array_join(F.slice(parts, 1, n), "-")).alias("to")))
    found = F.get(F.filter(begins, lambda b: b["to"].isNotNull()), 0)
    replaced = F.when(found.isNull(), F.array_join(parts, "-")).otherwise(F.array_join(F.concat(F.array(found["to"]), F.slice(parts, found["n"] + 1, F.size(parts))), "-"))
    regions = _table(REGION_ALIASES)
    shaped = F.split(language_tag(replaced), "-")
    return F.when(text.isNotNull(), F.array_join(F.transform(shaped, lambda p, i: F.when(i > 0, F.coalesce(F.try_element_at(regions, p), p)).otherwise(p)), "-"))


def collated(text: Column, locale: str = "UNICODE", case: bool = True, accents: bool = True) -> Column:
    """Text that compares by the rules of a locale (uk, de; UNICODE for none in particular) in order, grouping and
    joins; without `case` or `accents`, texts that differ only in these are equal."""
    return F.collate(text, locale + ("" if case else "_CI") + ("" if accents else "_AI"))
