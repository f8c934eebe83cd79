"""Cascading segmentation rule tables: ordered break and no-break rules per language, the first match deciding a position.

A rule is (breaks, before, after): `before` must match text that ends at the position, `after` text that starts there. Positions are after a run of
terminators and the quotes and brackets that close on it. A language's cascade is its own table, then that of its script, then the default one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

NO, YES = False, True

#: Abbreviations (without the last period) that do not end a sentence, by language.
ABBREVIATIONS = {
    "en": "FIG FIGS Fig Figs fig figs No Nos no nos Sec Secs Tab Tabs Pat Pats Dr Prof Mr Mrs Ms Jr Sr St Ref Refs Eq Eqs Ex Exs Vol Ch Art Col cf Cf vs al approx Approx incl excl resp e.g E.g i.e I.e viz ca wt Ser Appl Pub Inc Ltd Co dept",
    "de": "z B d h u a ca Ca bzw Nr Nrn Abb Fig Figs Tab vgl Vgl Dr Prof Hr Fr insb insbes evtl ggf sog gem i.d.R max min Abs Art S Bd lt inkl exkl zzgl Mio Mrd o.g u.a z.B d.h St Str ff Dipl Ing Kap Bsp",
    "fr": "M MM Mme Mlle Dr Pr fig Fig p pp ex c.-à-d cf Cf env Env art Art n no nos vol chap al tab Tab éd réf Réf max min St Ste",
    "es": "Sr Sra Srta Dr Dra Prof p ej pág págs núm núms fig Fig figs aprox Aprox art Art EE UU vol cap ed tel Ud Uds tab Tab máx mín cf Cf",
    "ru": "т е д к п пп рис Рис табл Табл см См ср Ср прибл др пр проф г гг стр с им напр Напр акад доц ст гл руб тыс млн млрд ок ч",
    "ar": "د ص م أ ج ت هـ",
    "hi": "डॉ सं श्री प्रो पं चि मि मी रु कि.मी से",
    "ko": "No Fig FIG Dr vs cf",
    "ja": "No Fig FIG Dr vs cf",
    "zh": "No Fig FIG Dr vs cf",
    "th": "มม ซม กม กก ดร นาย พ.ศ ค.ศ รศ ผศ",
}
#: Abbreviations that no language of the tables uses as a word, for blocks whose language is told wrongly or mixed.
SHARED = "Fig Figs FIG FIGS fig figs Nr Abb vgl Vgl bzw ca Ca insb Dr Dra Prof Sr núm pág aprox Env EE approx cf Cf vs Pat Tab рис табл прибл"
#: German month names after a day's number.
MONTHS_DE = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
TERMINATORS = ".!?…。．！？।॥؟"
CLOSERS = "\"'”’“»«)]）］」』】〉》}"

TABLES: dict[str, list[tuple[bool, str, str]]] = {
    # a single period inside a number or before a lower-case letter
    "inner": [(NO, r"(?:^|[^.!?…。．！？।॥؟])\.", r"[a-zß-öø-ÿ0-9]")],
    "en": [
        (NO, r"\b[A-Z]\.[A-Z]\.", r"\s+(?:Pat|Patent|Patents|Ser|Serial|Appl|Application|Pub|Publication|Department|Government|Army|Navy|Congress|Food)\b"),
        (YES, r"\b[A-Z]\.[A-Z]\.", r"\s+[\"“(\[]?[A-Z0-9]"),
        (YES, r"\b(?:etc|[ap]\.m)\.[\"”’)\]]*", r"\s+[\"“(\[]?[A-Z0-9]"),
    ],
    "de": [
        (NO, r"\b\d{1,2}\.", rf"\s+(?:{MONTHS_DE})\b"),
        (NO, r"(?i:\b(?:im|am|vom|zum|beim|zur|der|die|das|dem|den|des|ab|bis|seit|jede[rsnm]?|sein|ihr))\s+\d{1,3}\.", r"\s"),
        (YES, r"\b(?:usw|etc|o\.ä|u\.ä)\.[\"”“»«)\]]*", r"\s+[\"„»(\[]?[A-ZÄÖÜ0-9]"),
    ],
    "fr": [(YES, r"\betc\.[\"”»)\]]*", r"\s+[\"“«(\[]?[A-ZÀ-Þ0-9]")],
    "es": [(YES, r"\betc\.[\"”»)\]]*", r"\s+[\"“«(\[¿¡]?[A-ZÀ-Þ0-9]"), (YES, r"\bUU\.", r"\s+[A-ZÀ-Þ¿¡]")],
    "ru": [(YES, r"\b(?:и т\. ?[дп]|и др|и пр|кг|см)\.[\"”»)\]]*", r"\s+[\"“«(\[]?[А-ЯЁ]")],
    "zh": [
        (NO, r"…", r""),
        (NO, r"[。！？．.!?][”’」』]", r"\s*[，、；：,;:）)的]"),
    ],
    "ja": [
        (NO, r"…", r""),
        (NO, r"[。！？．.!?][」』”’]", r"\s*[、，,とはがをのにもでや）」』]"),
    ],
    "ko": [(NO, r"[.!?…][\"'”’」』]", r"\S")],
    "hi": [(NO, r"[।.!?…][\"'”’]", r"")],
    "ar": [(NO, r"[.!?؟…][\"'”’»]", r"")],
    "th": [(NO, r"[.…]", r"\s*[\u0e00-\u0e7f]")],
    "cased": [
        (NO, r"\s\.", r"\s"),
        (NO, r"(?:^|[\s(\[\"“„«»'’.-])[A-ZÀ-ÞА-ЯЁ]\.", r"\s+(?:[A-ZÀ-ÞА-ЯЁ]\.|[A-ZÀ-ÞА-ЯЁ][\w’'-]+)"),
        (NO, r"[.!?…][\"'”’“»«]+", r"\s+[^\W\dA-ZÀ-ÞА-ЯЁ_]"),
        (NO, r"", r"\s*[,;:=)\]<>≤≥±×/*^%]"),
        (NO, r"", r"\s+(?:\.\.\.\s*)?[a-zß-öø-ÿа-яё](?![A-ZÀ-ÞА-ЯЁ])"),
        (YES, r"[^\W_]?[)\]\"'”’“»«%°²³]*[.!?…]+[\"'”’“»«)\]]*", r"\s"),
        (YES, r"(?:[^\W\d_]{2}|\d|[)\]%°])[.!?…]+[\"'”’“»«)\]]*", r"[A-ZÀ-ÞА-ЯЁ][a-zß-öø-ÿа-яё’'\s]"),
        (YES, r"[.!?…]+[\"”’“»«)\]]+", r"[A-ZÀ-ÞА-ЯЁ0-9]"),
    ],
    "uncased": [
        (NO, r"\s\.", r"\s"),
        (NO, r"", r"\s*[,;:=،؛<>≤≥±×/*^%]"),
        (YES, r"[.!?…؟]+[\"'”’“»«)\]）]*", r"\s"),
        (YES, r"[^\W\d_a-zA-Z][.؟]+[\"'”’“»«)\]]*", r"[^\W\d_a-zA-Z]"),
        (YES, r"[!?؟.…]+[)\]）]", r"[^\W_]"),
        (YES, r"[^\W\d_][.!?]+", r"[A-Z][a-z]"),
    ],
    "default": [
        (NO, r"[0-9０-９]．", r"[0-9０-９]"),
        (YES, r"[。！？।॥؟．]+[\"'”’“»«)\]）］」』】〉》]*", r""),
    ],
}
CASCADES = {
    "en": ["inner", "default", "en", "abbr", "shared", "cased"], "de": ["inner", "default", "de", "abbr", "shared", "cased"], "fr": ["inner", "default", "fr", "abbr", "shared", "cased"], "es": ["inner", "default", "es", "abbr", "shared", "cased"],
    "ru": ["inner", "default", "ru", "abbr", "shared", "cased"], "zh": ["inner", "zh", "default", "abbr", "shared", "uncased"], "ja": ["inner", "ja", "default", "abbr", "shared", "uncased"], "ko": ["inner", "ko", "default", "abbr", "shared", "uncased"],
    "hi": ["inner", "hi", "default", "abbr", "shared", "uncased"], "ar": ["inner", "ar", "default", "abbr", "shared", "uncased"], "th": ["inner", "th", "default", "abbr", "shared", "uncased"],
}

#: Frequent words that tell languages in Latin script apart.
WORDS = {
    "en": frozenset("the of and is are to in by with that a an for which said wherein claim claims it this was".split()),
    "de": frozenset("der die das und ist ein eine einen einem einer wird werden mit nach dem den im zwischen dadurch dass aus bis nicht es sich man kann ohne wie ergeben vgl bzw nach im liegt besitzt".split()),
    "fr": frozenset("le la les un une des est et dans selon du de ce que en il se par sont sans avec ont été voir comme pour tel l'invention l'écart".split()),
    "es": frozenset("el los las un una es y según porque se del de en con entre hasta que no la está y véase esta este sin sigue lo".split()),
}
SCRIPTS = [
    ("th", re.compile(r"[\u0e00-\u0e7f]")), ("ko", re.compile(r"[\uac00-\ud7a3]")), ("ja", re.compile(r"[\u3040-\u30ff]")), ("hi", re.compile(r"[\u0900-\u097f]")),
    ("ar", re.compile(r"[\u0600-\u06ff]")), ("ru", re.compile(r"[\u0400-\u04ff]")), ("zh", re.compile(r"[\u4e00-\u9fff]")),
]
ANY_SCRIPT = re.compile(r"[\u0400-\u04ff\u0600-\u06ff\u0900-\u097f\u0e00-\u0e7f\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3]")
LATIN = re.compile(r"[A-Za-zÀ-ÿ]+")


@dataclass(frozen=True)
class Rule:
    breaks: bool
    before: re.Pattern | None
    after: re.Pattern | None
    reach: int = 40  # characters before the position that `before` can start at


def _compiled(lang: str) -> list[Rule]:
    rules = []
    for name in CASCADES[lang]:
        if name in ("abbr", "shared"):
            own = (ABBREVIATIONS[lang] if name == "abbr" else SHARED).split()
            words = "|".join(sorted((re.escape(w) for w in own), key=len, reverse=True))
            rules.append(Rule(NO, re.compile(rf"(?:^|[\s(\[\"“„«»'’.,/-])(?:{words})\.\Z"), None, max(map(len, own)) + 2))
        else:
            rules += [Rule(b, re.compile(f"(?:{x})\\Z") if x else None, re.compile(y) if y else None) for b, x, y in TABLES[name]]
    return rules


RULES = {lang: _compiled(lang) for lang in CASCADES}


def block_language(block: str, hint: str | None) -> str:
    """Of the characters themselves: the script decides where it can, frequent words among languages in Latin script; a tie goes to the hint."""
    best = None
    if not block.isascii() and ANY_SCRIPT.search(block):
        counts = {name: len(r.findall(block)) for name, r in SCRIPTS}
        if counts["ja"]:
            counts["ja"] += counts["zh"]
        best = max(counts, key=counts.get)
        others = sum(counts.values()) - (counts["zh"] if counts["ja"] else 0)
        latin = sum(map(len, LATIN.findall(block)))
        if counts[best] < 0.3 * (counts[best] + latin) and counts[best] <= others and latin > 2 * counts[best]:
            best = None
    if best:
        return best
    words = set(block.lower().split())
    votes = {lang: len(own & words) for lang, own in WORDS.items()}
    top = max(votes.values())
    ties = [lang for lang, v in votes.items() if v == top]
    return hint if hint in ties else ties[0]
